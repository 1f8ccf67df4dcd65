"""Bills that arrive as files, read by the same pass as stored ones. Every bill stands for itself, so no state and no watermark is needed."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from lawloom.operators import bills as B
from lawloom.sources.bills import bill_text


def bill_stream(spark: SparkSession, path: str, files_per_trigger: int = 1000) -> DataFrame:
    """doc_id, path, text of files as they come."""
    raw = spark.readStream.format("text").option("wholetext", True).option("maxFilesPerTrigger", files_per_trigger).load(path)
    named = raw.select(F.col("_metadata.file_path").alias("path"), F.col("value").alias("content"))
    return named.select(F.regexp_extract("path", r"([^/]+?)(?:\.[^./]*)?\z", 1).alias("doc_id"), "path", bill_text(F.col("path"), F.col("content")).alias("text"))


def citation_stream(bills: DataFrame) -> DataFrame:
    return B.table(B.analyse(bills), "citations")


def write_tables(bills: DataFrame, out: str, checkpoint: str, names: tuple[str, ...] = ("citations", "sections", "amendments", "ops")) -> StreamingQuery:
    """Each micro-batch read once and appended to a folder per table; the batch number makes a repeated batch overwrite itself."""

    def store(batch: DataFrame, number: int) -> None:
        read = B.analyse(batch).persist()
        try:
            for name in names:
                B.table(read, name).write.mode("overwrite").parquet(f"{out}/{name}/batch={number}")
        finally:
            read.unpersist()

    return bills.writeStream.foreachBatch(store).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
