"""Far too many small files: consolidation into few well-filled ones, and an audit of earlier packing runs.

``compact`` shuffles the rows under a REBALANCE hint, so that runtime statistics merge or split the output partitions near the
target size, writes them to a folder of their own below the table's, compares the multiset checksum of what lies there with that of
the source, and only then commits: a pointer file is replaced in one step, after which readers see the new folder, and the old one is
deleted last. A run that fails at any point leaves the table as it was. A checksum is the row count with the sums of two independent
64-bit hashes, so order does not matter and a lost, doubled or altered row shows. The source's checksum is observed while it is
written; only if it differs (a stage may have run twice after a loss) is it computed again from the source. The target size is a
setting of a session of its own, so compactions do not disturb each other or their caller.

Defined results: of the versions of one (grp, stem) the latest ``written_at`` counts (a tie goes to the larger ``shard_id``); rows
with a null grp or stem are records of their own key; an empty input commits an empty table.
"""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, Observation, SparkSession
from pyspark.sql import functions as F

from lawloom.session import hadoop_fs, scratch_path

#: Bytes of shuffled data aimed at per output file.
TARGET_BYTES = 64 << 20
#: The file in a table's folder that holds the name of the folder with its rows.
POINTER = "_current"


def _sums(columns: list[str]) -> list:
    def total(seed: int):
        h = F.xxhash64(F.lit(seed), *[F.coalesce(F.col(c).cast("string"), F.lit("\x00null")) for c in columns])
        return F.coalesce(F.sum(h.cast("decimal(38,0)")), F.lit(0).cast("decimal(38,0)"))

    return [F.count(F.lit(1)).alias("n"), total(11).cast("string").alias("a"), total(29).cast("string").alias("b")]


def checksum(df: DataFrame) -> dict:
    """Order-insensitive: count and the sums of two hashes of each row."""
    return df.agg(*_sums(df.columns)).first().asDict()


class ChecksumMismatch(RuntimeError):
    pass


def _own_session(df: DataFrame, target_bytes: int) -> DataFrame:
    """The same rows in a session of their own, whose adaptive execution aims at ``target_bytes``."""
    spark = df.sparkSession
    cloned = spark._jsparkSession.cloneSession()
    own = SparkSession(spark.sparkContext, cloned, {"spark.sql.adaptive.advisoryPartitionSizeInBytes": str(target_bytes), "spark.sql.adaptive.enabled": "true"})
    return DataFrame(spark._jvm.org.apache.spark.sql.classic.Dataset.ofRows(cloned, df._jdf.logicalPlan()), own)


def current_version(spark: SparkSession, path: str) -> str | None:
    """Name of the folder that holds a table's rows; null where none was ever committed."""
    fs, pointer = hadoop_fs(spark, f"{path}/{POINTER}")
    if not fs.exists(pointer):
        return None
    stream = fs.open(pointer)
    try:
        return spark._jvm.org.apache.commons.io.IOUtils.toString(stream, "UTF-8").strip()
    finally:
        stream.close()


def read_compacted(spark: SparkSession, path: str) -> DataFrame:
    version = current_version(spark, path)
    if version is None:
        raise FileNotFoundError(f"no compacted table at {path}")
    return spark.read.parquet(f"{path}/{version}")


def _point_to(spark: SparkSession, path: str, version: str) -> None:
    """Replace the pointer in one step."""
    jvm = spark._jvm
    fs, fresh = hadoop_fs(spark, f"{path}/{POINTER}.{version}")
    stream = fs.create(fresh, True)
    try:
        stream.write(bytearray(version.encode()))
    finally:
        stream.close()
    rename = getattr(jvm.org.apache.hadoop.fs, "Options$Rename")
    how = spark.sparkContext._gateway.new_array(rename, 1)
    how[0] = rename.OVERWRITE
    pointer = jvm.org.apache.hadoop.fs.Path(f"{path}/{POINTER}")
    files = jvm.org.apache.hadoop.fs.FileContext.getFileContext(fs.getUri(), spark._jsc.hadoopConfiguration())
    files.rename(fs.makeQualified(fresh), fs.makeQualified(pointer), how)


def compact(df: DataFrame, path: str, target_bytes: int = TARGET_BYTES) -> DataFrame:
    spark = df.sparkSession
    before, version = current_version(spark, path), f"v-{uuid.uuid4().hex}"
    place = f"{path}/{version}"
    seen = Observation()
    own = _own_session(df, target_bytes)
    own.observe(seen, *_sums(df.columns)).hint("rebalance").write.option("compression", "zstd").parquet(place)
    there = checksum(spark.read.schema(df.schema).parquet(place))
    if there != seen.get and there != checksum(df):
        raise ChecksumMismatch(f"{place} holds {there}")
    _point_to(spark, path, version)
    if before:
        fs, old = hadoop_fs(spark, f"{path}/{before}")
        fs.delete(old, True)
    return spark.read.schema(df.schema).parquet(place)


def current_records(shard_file: DataFrame) -> DataFrame:
    """grp, stem, content, byte_length of the version that counts."""
    newest = F.max_by(F.col("content"), F.struct("written_at", "shard_id"))
    return (
        shard_file.groupBy("grp", "stem")
        .agg(newest.alias("content"))
        .withColumn("byte_length", F.octet_length("content").cast("bigint"))
    )


def pack_shards(shard_file: DataFrame, path: str | None = None, target_bytes: int = TARGET_BYTES) -> DataFrame:
    """Every record once, in few files."""
    path = path or scratch_path(shard_file.sparkSession, "packed")
    return compact(current_records(shard_file), path, target_bytes)


def part_report(spark: SparkSession, path: str) -> DataFrame:
    """file, rows, bytes of content of each part of a packed table."""
    return (
        read_compacted(spark, path)
        .groupBy(F.col("_metadata.file_name").alias("file"))
        .agg(F.count("*").alias("records"), F.sum("byte_length").alias("content_bytes"))
    )


def index_entries(bundle_index: DataFrame) -> DataFrame:
    """One row per (grp, stem) of an index: the number of its entries, and the only one's fit in its part."""
    entries = (
        bundle_index.select("idx_id", "grp", "parts", "part_bytes", "at_list")
        .dropDuplicates(["idx_id"])
        .select("grp", "parts", "part_bytes", F.explode("at_list").alias("x"))
    )
    k = F.col("x.part_no")
    inside = (k >= 0) & (k < F.size("parts"))
    size = F.when(inside, F.get("part_bytes", k))
    fits = F.coalesce(inside & (F.col("x.byte_offset") + F.col("x.byte_length") <= size), F.lit(False))
    return (
        entries.select("grp", F.col("x.stem").alias("stem"), F.col("x.byte_length").alias("said"), fits.alias("fits"))
        .groupBy("grp", "stem")
        .agg(F.count("*").alias("entries"), F.first("said").alias("said"), F.first("fits").alias("fits"))
    )


def index_faults(packed: DataFrame, bundle_index: DataFrame) -> DataFrame:
    """grp, stem, fault: lost, twice, torn or stray, of the packed records against the entries of earlier runs."""
    held = packed.select("grp", "stem", "byte_length", F.lit(True).alias("held"))
    both = held.alias("h").join(
        index_entries(bundle_index).alias("e"), F.expr("h.grp <=> e.grp and h.stem <=> e.stem"), "full_outer"
    )
    torn = ~(F.col("fits") & F.coalesce(F.col("said") == F.col("byte_length"), F.lit(False)))
    fault = (
        F.when(F.col("held").isNull(), "stray")
        .when(F.col("entries").isNull(), "lost")
        .when(F.col("entries") > 1, "twice")
        .when(torn, "torn")
    )
    return both.select(F.coalesce("h.grp", "e.grp").alias("grp"), F.coalesce("h.stem", "e.stem").alias("stem"), fault.alias("fault")).where(
        "fault is not null"
    )


def locate_records(bundle_index: DataFrame, wanted: DataFrame) -> DataFrame:
    """Records (grp, stem) with where an earlier packing run put them: grp, stem, part, byte_offset, byte_length of each entry that lies in its part."""
    at = bundle_index.dropDuplicates(["idx_id"]).select("grp", "parts", "part_bytes", F.explode("at_list").alias("x"))
    k = F.col("x.part_no")
    fits = (k >= 0) & (k < F.size("parts")) & (F.col("x.byte_offset") + F.col("x.byte_length") <= F.get("part_bytes", k))
    held = at.where(fits).select("grp", F.col("x.stem").alias("stem"), F.get("parts", k).alias("part"), F.col("x.byte_offset").alias("byte_offset"), F.col("x.byte_length").alias("byte_length"))
    return wanted.select("grp", "stem").distinct().join(held, ["grp", "stem"])
