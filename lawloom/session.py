"""Session helpers: table access and the shared folder for tables that cut lineage."""

from __future__ import annotations

import atexit
import shutil
import tempfile
import uuid
import zipfile
from pathlib import Path

from pyspark.sql import Column, DataFrame, SparkSession

_made: set[str] = set()


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def shared_root(spark: SparkSession) -> str:
    """The folder all executors share: ``spark.checkpoint.dir``. Only on this one machine, as in tests, may it be unset; then it is a new folder."""
    root = spark.conf.get("spark.checkpoint.dir", None)
    if not root:
        if not spark.sparkContext.master.startswith("local"):
            raise RuntimeError("spark.checkpoint.dir must name a folder that all executors share")
        root = tempfile.mkdtemp(prefix="lawloom-")
        spark.conf.set("spark.checkpoint.dir", root)
        _forget_at_exit(spark, root)
    return root.rstrip("/")


def hadoop_fs(spark: SparkSession, path: str):
    jvm = spark._jvm
    p = jvm.org.apache.hadoop.fs.Path(path)
    return p.getFileSystem(spark._jsc.hadoopConfiguration()), p


def _forget_at_exit(spark: SparkSession, path: str) -> None:
    def drop() -> None:
        try:
            fs, p = hadoop_fs(spark, path)
            fs.delete(p, True)
        except Exception:  # the session may be gone already
            pass

    if path not in _made:
        _made.add(path)
        atexit.register(drop)


def drop_scratch(spark: SparkSession) -> None:
    """Free the tables written so far; for long sessions, once the results that read them are stored. At the end of a session they go by themselves."""
    for path in sorted(_made):
        if "/lawloom-" in path.removeprefix(shared_root(spark)):
            fs, p = hadoop_fs(spark, path)
            fs.delete(p, True)
            _made.discard(path)


def scratch_path(spark: SparkSession, name: str) -> str:
    path = f"{shared_root(spark)}/lawloom-{name}-{uuid.uuid4().hex}"
    _forget_at_exit(spark, path)
    return path


def written(df: DataFrame, name: str, **options: str) -> DataFrame:
    """Write ``df`` to the shared folder and read it back: lineage ends there, and lost executors cost no recomputation."""
    spark = df.sparkSession
    path = scratch_path(spark, name)
    df.write.options(compression="zstd", **options).parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def ship(spark: SparkSession) -> None:
    """Give the package to the executors, once per session, for clusters where it isn't installed. Spark serves the archive itself."""
    context = spark.sparkContext
    if getattr(context, "_lawloom_shipped", False):
        return
    root = Path(__file__).parent
    archive = Path(tempfile.mkdtemp(prefix="lawloom-ship-")) / "lawloom.zip"
    with zipfile.ZipFile(archive, "w", zipfile.ZIP_DEFLATED) as z:
        for p in sorted(root.rglob("*")):
            if p.suffix in (".py", ".tsv"):
                z.write(p, Path("lawloom") / p.relative_to(root))
    context.addPyFile(str(archive))
    atexit.register(shutil.rmtree, archive.parent, True)
    context._lawloom_shipped = True


#: Setting of the session that tells when ``spread`` moves rows: ``auto``, ``always`` or ``never``.
SPREAD = "spark.lawloom.spread"


def spread(df: DataFrame, key: str | Column, source: DataFrame | None = None) -> DataFrame:
    """``df`` over all cores before work that is heavy for its size; its rows are the same in any case, which a test shows. ``source`` is where its rows come from, if not read as they are.

    The setting SPREAD decides. ``never`` leaves rows where they were read; that is also what ``auto`` does, except for inputs with fewer
    splits than there are cores (one small file is one split, whatever its rows cost). ``always`` shuffles. Rows that were spread before they
    got further columns stay where they are: long texts needn't move if what they are made of did.
    """
    spark = df.sparkSession
    when = spark.conf.get(SPREAD, "auto")
    cores = spark.sparkContext.defaultParallelism
    if when == "never" or _is_spread(df) or (when == "auto" and splits(df if source is None else source) >= cores):
        return df
    return df.repartition(cores, key)


def _is_spread(df: DataFrame) -> bool:
    plan = df._jdf.queryExecution().optimizedPlan()
    while plan.nodeName() in ("Project", "Filter"):
        plan = plan.children().head()
    return plan.nodeName() == "RepartitionByExpression"


def splits(df: DataFrame) -> int:
    """In how many pieces the files of ``df`` are read at least."""
    spark = df.sparkSession
    size = int(str(df._jdf.queryExecution().optimizedPlan().stats().sizeInBytes()))
    return max(len(df.inputFiles()), size // spark._jsparkSession.sessionState().conf().filesMaxPartitionBytes())
