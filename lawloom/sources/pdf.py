"""Bill text from a table of positioned glyph runs: doc_id, page, ord, x, y, width, page_width, str."""

from __future__ import annotations

from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lawloom.functions.pdf import Run, page_text


#: Pages whose runs are Python objects at one time.
AT_ONCE = 256


def _texts(b: pa.RecordBatch) -> list[str]:
    lists = b.column("runs")
    ends, (_, *fields) = lists.offsets.to_pylist(), lists.flatten().flatten()
    x, y, width, chars = (f.to_pylist() for f in fields)
    first = ends[0]  # a slice keeps its offsets, but flatten gives its values only
    texts = []
    for start, end, page_width in zip(ends, ends[1:], b.column("page_width").to_pylist()):
        here = range(start - first, end - first)
        texts.append(page_text([Run(x[k], y[k], width[k] or 0, chars[k]) for k in here if x[k] is not None and y[k] is not None], page_width or 0))
    return texts


def _pages(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Rows (doc_id, page, page_width, runs) as rows (doc_id, page, text)."""
    for b in batches:
        texts = [t for k in range(0, b.num_rows, AT_ONCE) for t in _texts(b.slice(k, AT_ONCE))]
        yield pa.RecordBatch.from_arrays([b.column("doc_id"), b.column("page"), pa.array(texts, pa.string())], ["doc_id", "page", "text"])


def page_texts(glyphs: DataFrame) -> DataFrame:
    """doc_id, page, text. The runs of a page are one row; pages go to Python by batches, as a call for each costs more than its text."""
    number = lambda name: F.col(name).cast("double").alias(name)
    run = F.struct("ord", number("x"), number("y"), number("width"), "str")
    pages = glyphs.groupBy(F.col("doc_id").cast("string").alias("doc_id"), F.col("page").cast("int").alias("page"))
    rows = pages.agg(F.max(number("page_width")).alias("page_width"), F.sort_array(F.collect_list(run)).alias("runs"))
    return rows.mapInArrow(_pages, "doc_id string, page int, text string")


def pdf_texts(glyphs: DataFrame) -> DataFrame:
    """doc_id, text: pages in order, a blank line between."""
    pages = page_texts(glyphs).groupBy("doc_id").agg(F.sort_array(F.collect_list(F.struct("page", "text"))).alias("p"))
    return pages.select("doc_id", F.regexp_replace(F.array_join("p.text", "\n\n"), "\n{3,}", "\n\n").alias("text"))


def rejoin_lines(lines: DataFrame) -> DataFrame:
    """Rows (doc_id, page, pos, line) with words that a hyphen broke joined again: islands of lines, each one line."""
    from pyspark.sql import Window

    w = Window.partitionBy("doc_id", "page").orderBy("pos")
    goes_on = F.coalesce(F.lag("line").over(w).rlike(r"[a-z]-\z"), F.lit(False)) & F.col("line").rlike(r"\A[a-z]")
    islands = lines.withColumn("joins", goes_on).withColumn("island", F.sum((~F.col("joins")).cast("int")).over(w))
    last = F.lead("joins").over(w)
    cut = F.when(F.coalesce(last, F.lit(False)), F.regexp_replace("line", r"-\z", "")).otherwise(F.col("line"))
    parts = islands.withColumn("cut", cut).groupBy("doc_id", "page", "island").agg(F.sort_array(F.collect_list(F.struct("pos", "cut"))).alias("xs"))
    return parts.select("doc_id", "page", "island", F.array_join("xs.cut", "").alias("line"))
