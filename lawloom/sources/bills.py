"""Bill texts as tables: reading, unwrapping and unifying, all as Column expressions."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from lawloom.functions.text import unify_newlines

# Entities that are decoded, in this order.
ENTITIES = {"&lt;": "<", "&gt;": ">", "&quot;": '"', "&#39;": "'", "&nbsp;": " ", "&amp;": "&"}


def unwrap_page(c: Column) -> Column:
    """The body of the first <pre>, else the whole; without tags, entities decoded."""
    pre = F.regexp_extract(c, r"(?is)<pre[^>]*>(.*?)</pre>", 1)
    found = c.rlike(r"(?is)<pre[^>]*>.*?</pre>")
    out = F.regexp_replace(F.when(found, pre).otherwise(c), r"<[^>]+>", "")
    for entity, char in ENTITIES.items():
        out = F.replace(out, F.lit(entity), F.lit(char))
    return out


def is_page(path: Column, content: Column) -> Column:
    """By the extension, else by a first character ``<``."""
    return F.coalesce(F.lower(path).rlike(r"\.html?\z"), F.lit(False)) | content.rlike(r"\A\s*<")


def bill_text(path: Column, content: Column) -> Column:
    return unify_newlines(F.when(is_page(path, content), unwrap_page(content)).otherwise(content))


def read_bills(spark: SparkSession, path: str) -> DataFrame:
    """doc_id (the file's name without its extension), path, text."""
    raw = spark.read.text(path, wholetext=True).select(F.col("_metadata.file_path").alias("path"), F.col("value").alias("content"))
    name = F.regexp_extract("path", r"([^/]+?)(?:\.[^./]*)?\z", 1)
    return raw.select(name.alias("doc_id"), "path", bill_text(F.col("path"), F.col("content")).alias("text"))


def missing_files(manifest: DataFrame, bills: DataFrame) -> DataFrame:
    """Rows of a manifest (id, ...) whose bill is not among those read."""
    return manifest.join(bills.select(F.col("doc_id").alias("id")), "id", "left_anti")
