"""Counts per bill, their difference to recorded ones, and rankings."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

KINDS = ("usc", "act", "publaw", "stat", "cfr", "internal")
OPS = ("strike", "insert", "add-at-end", "replace", "redesignate", "repeal")


def _has(name: str, value: str):
    return lambda x: x[name] == value


def corpus_metrics(analysis: DataFrame) -> DataFrame:
    """doc_id, metric, value. All counts are taken inside the row of the bill; offsets are held against the text where it is read, so nothing is shuffled."""
    of = lambda name, test: F.size(F.filter(name, test)).cast("bigint")
    n = lambda name: F.size(name).cast("bigint")
    spans = F.array_distinct(
        F.transform(F.filter("ops", lambda o: o["start"].isNotNull()), lambda o: F.concat_ws(":", o["type"], o["start"].cast("string"), o["end"].cast("string")))
    )
    metrics = {
        "chars": F.col("n_chars"),
        "sections": n("sections"),
        "divisions": n("divisions"),
        "citations": n("citations"),
        **{f"byKind.{k}": of("citations", _has("kind", k)) for k in KINDS},
        "amendments": n("amendments"),
        "targeted": of("amendments", lambda a: a["target"].isNotNull()),
        "distributed": of("amendments", lambda a: a["distributed"]),
        "steps": of("nav", lambda x: x["nav_kind"] == "step"),
        "refs": of("nav", lambda x: x["nav_kind"] == "ref"),
        "relative": of("all_citations", lambda c: c["relative"]),
        **{f"ops.{k}": of("ops", _has("type", k)) for k in OPS},
        "opSpans": F.size(spans).cast("bigint"),
        "uncoveredVerbs": F.col("uncovered").cast("bigint"),
        "badOffsets": F.col("bad_offsets").cast("bigint"),
        "overlaps": F.col("overlaps").cast("bigint"),
        "badOpOffsets": F.col("bad_op_offsets").cast("bigint"),
    }
    pairs = F.array(*[F.struct(F.lit(k).alias("metric"), v.alias("value")) for k, v in metrics.items()])
    return analysis.select("doc_id", F.inline(pairs))


def metric_changes(now: DataFrame, before: DataFrame) -> DataFrame:
    """Metrics that moved, appeared or went: doc_id, metric, before, now."""
    a, b = now.withColumnRenamed("value", "now"), before.withColumnRenamed("value", "before")
    return a.join(b, ["doc_id", "metric"], "full_outer").where(~F.col("now").eqNullSafe(F.col("before"))).select("doc_id", "metric", "before", "now")


def broken_invariants(metrics: DataFrame) -> DataFrame:
    return metrics.where(F.col("metric").isin("badOffsets", "overlaps", "badOpOffsets") & (F.col("value") > 0))


def most_cited_laws(citation: DataFrame, most: int = 25) -> DataFrame:
    """The public laws cited most: congress, law, cited, rank (ties by number)."""
    counted = citation.where("kind = 'publaw'").groupBy("congress", "law").agg(F.count("*").alias("cited"))
    top = counted.orderBy(F.desc("cited"), F.col("congress").cast("int"), F.col("law").cast("int")).limit(most)
    w = Window.orderBy(F.desc("cited"), F.col("congress").cast("int"), F.col("law").cast("int"))
    return top.withColumn("rank", F.row_number().over(w))


def internal_fates(located: DataFrame) -> DataFrame:
    return located.groupBy("doc_id", "fate").agg(F.count("*").alias("n"))


def impact_rates(resolved: DataFrame) -> DataFrame:
    """Distinct targets and what became of them: kind, targets, hits, no_section, no_subsection, provisions (distinct places reached).

    Rows (kind, cite_key, outcome, place): outcome is hit, no_section or no_subsection.
    """
    rows = resolved.dropDuplicates(["kind", "cite_key"])
    of = lambda name: F.count_if(F.col("outcome") == name)
    return rows.groupBy("kind").agg(
        F.count("*").alias("targets"), of("hit").alias("hits"), of("no_section").alias("no_section"), of("no_subsection").alias("no_subsection"), F.count_distinct(F.when(F.col("outcome") == "hit", F.col("place"))).alias("provisions")
    )
