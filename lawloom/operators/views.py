"""A bill as rows of what is shown: paragraphs, the tiles of text and citations in them, instructions, and groups of sections."""

from __future__ import annotations

from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_schema
from pyspark.sql.types import _parse_datatype_string

from lawloom.functions import amend, citations, structure, views
from lawloom.session import spread

_VIEW = (
    "doc_id string, paragraphs array<struct<seq:int,start:bigint,`end`:bigint,kind:string,section:string,opens:string,covered_by:string>>, "
    "tiles array<struct<paragraph:int,start:bigint,`end`:bigint,cite_id:string>>, chips array<struct<am_id:string,type:string,n:int>>"
)


def _view(doc_id: str, text: str) -> dict:
    bill = structure.parse_bill(text)
    cites = citations.extract(text)
    found = amend.extract(text, cites, bill)
    paras = views.paragraphs(bill)
    shown = sorted(amend.relative(cites, found), key=lambda c: c.start)
    rows = []
    for k, p in enumerate(paras):
        opens = next((a.id for a in found if p.start <= a.start < p.end), None)
        covered = opens or next((a.id for a in found if p.start < a.end and p.end > a.start), None)
        rows.append({"seq": k, "start": p.start, "end": p.end, "kind": p.kind, "section": p.section, "opens": opens, "covered_by": covered})
    chips: dict[tuple[str, str], int] = {}
    for a in found:
        for o in a.ops:
            chips[a.id, o.type] = chips.get((a.id, o.type), 0) + 1
    tiles = views.tiles(paras, [(c.start, c.end, c.id) for c in shown])
    return {
        "doc_id": doc_id,
        "paragraphs": rows,
        "tiles": [{"paragraph": n, "start": a, "end": b, "cite_id": c} for n, a, b, c in tiles],
        "chips": [{"am_id": i, "type": t, "n": n} for (i, t), n in chips.items()],
    }


def view(bills: DataFrame) -> DataFrame:
    """One row per bill: paragraphs, tiles, chips."""
    schema = to_arrow_schema(_parse_datatype_string(_VIEW))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            rows = [_view(i, t) for i, t in zip(b.column(0).to_pylist(), b.column(1).to_pylist())]
            yield pa.RecordBatch.from_pylist(rows, schema=schema)

    return spread(bills.where("text is not null").select("doc_id", "text"), "doc_id").mapInArrow(run, _VIEW)


def inline_text(c: Column) -> Column:
    """Text as shown on one line; never before spans are cut."""
    return F.regexp_replace(F.regexp_replace(c, r"-\n[ \t]*", "-"), r"\s*\n\s*", " ")


def jump_groups(sections: DataFrame) -> DataFrame:
    """Consecutive sections under the same chain of units: doc_id, grp, chain, first, sections."""
    chain = F.array_join(F.transform("ancestors", lambda a: F.concat_ws("—", a["label"], a["heading"])), " › ")
    w = Window.partitionBy("doc_id").orderBy("seq")
    rows = sections.withColumn("chain", chain).withColumn("new", ~F.coalesce(F.col("chain") == F.lag("chain").over(w), F.lit(False)))
    return (
        rows.withColumn("grp", F.sum(F.col("new").cast("int")).over(w))
        .groupBy("doc_id", "grp", "chain")
        .agg(F.min_by("num", "seq").alias("first"), F.count("*").alias("sections"))
    )


def amending_only(paragraphs: DataFrame) -> DataFrame:
    return paragraphs.where("covered_by is not null")
