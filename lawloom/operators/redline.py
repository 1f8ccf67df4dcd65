"""Redlines of many amendments: each amendment of a bill meets the section it amends, and is drawn there.

The nodes of a section are gathered once per section (a section bounds them), joined to the amendments that target it, and drawn
row by row; nothing is grouped by bill or by amendment.
"""

from __future__ import annotations

from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lawloom.functions import redline as rl
from lawloom.functions.text import slug
from lawloom.session import spread

_OUT = (
    "doc_id string, am_id string, title string, slug string, stale boolean, segments array<struct<path:string,kind:string,text:string>>, "
    "outcomes array<struct<op_seq:int,type:string,outcome:string,scope:string,widened:string>>"
)
_FIELDS = ("start", "exact", "all", "at_end", "replaces", "relation", "anchor", "placement", "range_end", "new_section")


def sections_whole(code_section: DataFrame, code_node: DataFrame) -> DataFrame:
    """title, slug, lead, nodes in preorder, of the first entry of each section."""
    first = code_section.groupBy("title", "slug").agg(F.min("entry").alias("entry"), F.min_by("lead", "entry").alias("lead"))
    nodes = code_node.groupBy("title", "slug", "entry").agg(
        F.sort_array(F.collect_set(F.struct("ord", "path", "marker", "heading", "text"))).alias("nodes")
    )
    return first.join(nodes, ["title", "slug", "entry"], "left").drop("entry")


def targeted(analysis: DataFrame) -> DataFrame:
    """doc_id, am_id, title, slug, ops of amendments of a section of the code."""
    ams = analysis.select("doc_id", "ops", F.inline("amendments"))
    return ams.where("target.kind = 'usc' and target.section <> ''").select(
        "doc_id", F.col("id").alias("am_id"), F.col("target.title").alias("title"), slug(F.col("target.section")).alias("slug"),
        F.filter("ops", lambda o: o["am_id"] == F.col("id")).alias("ops"),
    )


def _work(o: dict) -> rl.Work:
    return rl.Work(o["op_seq"], o["type"], o["operand"] or o["text"], scope=o["scope"] or "", from_head=bool(o["scope_from_head"]), **{k: o[k] for k in _FIELDS})


def draw(analysis: DataFrame, code_section: DataFrame, code_node: DataFrame) -> DataFrame:
    """One row per amendment whose section is held: segments and outcomes."""
    return draw_ops(targeted(analysis), code_section, code_node)


def draw_ops(amendments: DataFrame, code_section: DataFrame, code_node: DataFrame) -> DataFrame:
    met = amendments.where("size(ops) > 0").join(sections_whole(code_section, code_node), ["title", "slug"])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            out = []
            for r in b.to_pylist():
                nodes = [rl.Node(n["path"] or "", n["marker"] or "", n["heading"] or "", n["text"] or "") for n in r["nodes"] or []]
                segments, red = rl.draw([_work(o) for o in r["ops"]], r["lead"] or "", nodes)
                out.append({
                    **{k: r[k] for k in ("doc_id", "am_id", "title", "slug")}, "stale": red.stale,
                    "segments": [dict(zip(("path", "kind", "text"), s)) for s in segments],
                    "outcomes": [{"op_seq": o.seq, "type": o.type, "outcome": o.outcome, "scope": o.scope, "widened": o.widened} for o in red.ops],
                })
            yield pa.RecordBatch.from_pylist(out, schema=schema)

    from pyspark.sql.pandas.types import to_arrow_schema
    from pyspark.sql.types import _parse_datatype_string

    schema = to_arrow_schema(_parse_datatype_string(_OUT))
    rows = met.select("doc_id", "am_id", "title", "slug", "lead", "nodes", "ops")
    return spread(rows, "doc_id", amendments).mapInArrow(run, _OUT)


def segments(drawn: DataFrame) -> DataFrame:
    return drawn.select("doc_id", "am_id", "title", "slug", F.posexplode("segments").alias("seg_seq", "s")).select("doc_id", "am_id", "title", "slug", "seg_seq", "s.*")


def outcomes(drawn: DataFrame) -> DataFrame:
    return drawn.select("doc_id", "am_id", "title", "slug", F.inline("outcomes"))


def coverage(outcomes: DataFrame) -> DataFrame:
    """doc_id (null: all), type, outcome, ops: what became of the operations, with totals."""
    return outcomes.rollup("type", "outcome", "doc_id").agg(F.count("*").alias("ops")).where("outcome is not null").select("doc_id", "type", "outcome", "ops")
