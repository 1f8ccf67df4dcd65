"""References to records that do not exist.

Both sides are co-partitioned and sorted on the key and merged linearly (a sort-merge join, whose skewed reference side
adaptive execution may split). A parent key carries the spans of time in which it was held, so that an orphan is told apart as

* ``missing``: no such parent was ever held,
* ``deleted``: it was held before the time of citing, not at it,
* ``late``: it was loaded only after.

Defined results: a reference whose title or section is null or blank is no case; a null ``cited_at`` falls in no span, so the
reference is an orphan with a null period (``missing`` if the parent is unknown, else ``late``); repeated rows count once; rows of
a parent table whose key is null hold nothing; extra columns are ignored; empty tables give orphans only, or nothing.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lawloom.functions.text import slug, squeeze_out


def held_spans(parents: DataFrame, keys: list[str], start: str, end: str) -> DataFrame:
    """One row per key with its distinct spans in time: as many as the key has entries."""
    rows = parents.where(F.col(start).isNotNull()).select(*keys, F.col(start).alias("s"), F.col(end).alias("e")).distinct()
    return rows.groupBy(*keys).agg(
        F.sort_array(F.collect_set(F.struct("s", "e"))).alias("spans"), F.min("s").alias("first_held")
    )


def merge_references(refs: DataFrame, parents: DataFrame, keys: list[str]) -> DataFrame:
    """Left merge on ``keys``; the parent side has one row per key."""
    return refs.join(parents.hint("merge"), keys, "left")


def find_orphans(
    citation: DataFrame, code_title: DataFrame, code_section: DataFrame, code_node: DataFrame, cfr_section: DataFrame
) -> DataFrame:
    """doc_id, cite_id, ref_table (the first table that lacks the target), period (month of citing), reason."""
    refs = (
        citation.where(F.col("kind").isin("usc", "cfr"))
        .select(
            "doc_id",
            "cite_id",
            "kind",
            squeeze_out("title").alias("title"),
            squeeze_out("section").alias("section"),
            squeeze_out("subsection").alias("subsection"),
            "cited_at",
        )
        .where("title <> '' and section <> ''")
    )
    usc = _usc_orphans(refs.where("kind = 'usc'"), code_title, code_section, code_node)
    cfr = _cfr_orphans(refs.where("kind = 'cfr'"), cfr_section)
    return usc.unionByName(cfr).distinct()


def _usc_orphans(refs: DataFrame, code_title: DataFrame, code_section: DataFrame, code_node: DataFrame) -> DataFrame:
    refs = refs.withColumn("slug", slug(F.col("section")))
    titles = code_title.select(squeeze_out("title").alias("title")).where("title <> ''").distinct().withColumn("known", F.lit(True))
    spans = held_spans(
        code_section.select(squeeze_out("title").alias("title"), squeeze_out("slug").alias("slug"), "loaded_at", "removed_at"),
        ["title", "slug"],
        "loaded_at",
        "removed_at",
    )
    # no hint: the planner broadcasts the titles only below its size threshold
    seen = merge_references(refs.join(titles, "title", "left"), spans, ["title", "slug"])
    at = F.col("cited_at")
    held = F.exists("spans", lambda x: (x["s"] <= at) & (x["e"].isNull() | (x["e"] > at)))
    seen = seen.withColumn(
        "ref_table",
        F.when(F.col("known").isNull(), "code_title").when(~F.coalesce(held, F.lit(False)), "code_section"),
    ).withColumn(
        "reason",
        F.when(F.col("known").isNull() | F.col("spans").isNull(), "missing")
        .when(at.isNull() | (F.col("first_held") > at), "late")
        .otherwise("deleted"),
    )
    out = ["doc_id", "cite_id", "ref_table", F.date_format("cited_at", "yyyy-MM").alias("period"), "reason"]
    no_section = seen.where(F.col("ref_table").isNotNull()).select(*out)
    nodes = (
        code_node.select(squeeze_out("title").alias("title"), squeeze_out("slug").alias("slug"), squeeze_out("path").alias("subsection"))
        .where("subsection <> ''")
        .distinct()
    )
    deeper = seen.where("ref_table is null and subsection <> ''").drop("spans", "first_held", "known", "ref_table", "reason")
    no_node = (
        deeper.join(nodes.hint("merge"), ["title", "slug", "subsection"], "left_anti")
        .withColumns({"ref_table": F.lit("code_node"), "reason": F.lit("missing")})
        .select(*out)
    )
    return no_section.unionByName(no_node)


def _cfr_orphans(refs: DataFrame, cfr_section: DataFrame) -> DataFrame:
    issues = (
        cfr_section.select(squeeze_out("title").alias("title"), squeeze_out("number").alias("section"), "as_of")
        .groupBy("title", "section")
        .agg(F.min("as_of").alias("first_issue"), F.lit(True).alias("known"))
    )
    day = F.date_format("cited_at", "yyyy-MM-dd")
    return (
        merge_references(refs, issues, ["title", "section"])
        .where(~F.coalesce(F.col("first_issue") <= day, F.lit(False)))
        .select(
            "doc_id",
            "cite_id",
            F.lit("cfr_section").alias("ref_table"),
            F.date_format("cited_at", "yyyy-MM").alias("period"),
            F.when(F.col("known").isNull(), "missing").otherwise("late").alias("reason"),
        )
    )


def orphan_report(orphans: DataFrame) -> DataFrame:
    """Counts per table, month and reason."""
    return orphans.groupBy("ref_table", "period", "reason").agg(F.count("*").alias("orphans"))
