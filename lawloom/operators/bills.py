"""One pass over bills, and the tables that come out of it.

``analyse`` reads each text once, in the order structure, citations, instructions, relative citations, which depend on each other
within a document only; so documents never move. Each table is then an ``inline`` of one column. Who wants a single table takes ``rows``,
which does no more than that table needs and hands it over by columns.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import fields

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_schema
from pyspark.sql.types import StructType, _parse_datatype_string

from lawloom.functions import amend, citations, internal, structure
from lawloom.session import spread

_DIVISION = "seq int, label string, heading string, start bigint, rank int"
_SECTION = (
    "seq int, num string, heading string, division string, ancestors array<struct<label:string,heading:string,start:bigint>>, run_in boolean, "
    "start bigint, `end` bigint"
)
_BLOCK = "seq int, start bigint, `end` bigint, phrase boolean"
_MARK = "pos bigint, marker string, depth int"
_CITATION = (
    "id string, kind string, text string, start bigint, `end` bigint, title string, section string, subsection string, ladder array<string>, et_seq boolean, "
    "note boolean, via_act string, sub_from_prose boolean, unit string, part string, congress string, law string, act_name string, act_section string, "
    "act_title string, division string, `where` array<string>, short_title string, volume string, page string, ref_type string, scope string, "
    "inserted struct<start:bigint,end:bigint,phrase:boolean>, implied string, relative boolean, rel_unit string, rel_markers string, rel_from string, "
    "rel_to string, via_amendment string, via_target string, sub_from_head string, inserted_law boolean"
)
_AMENDMENT = (
    "id string, start bigint, `end` bigint, unit string, section string, subsection string, verb string, act_name string, distributed boolean, "
    f"via_instruction bigint, target struct<{', '.join(x for x in ('id:string', 'kind:string', 'title:string', 'section:string', 'subsection:string', 'et_seq:boolean', 'note:boolean', 'congress:string', 'law:string', 'act_name:string', 'act_section:string', 'division:string', 'implied:string'))}>"
)
_OP = (
    "am_id string, op_seq int, type string, text string, start bigint, `end` bigint, operand string, punctuation boolean, all boolean, at_end boolean, "
    "replaces bigint, relation string, anchor string, unit_anchor string, placement string, scope string, scope_from_head boolean, exact boolean, "
    "range_end boolean, new_section boolean, from_units string, to_units string"
)
_NAV = (
    "am_id string, nav_kind string, seq int, start bigint, `end` bigint, text string, unit string, markers string, path string, exact boolean, inserted boolean, "
    "range_from string, range_to string"
)
_LOCATED = "cite_id string, fate string, start bigint, section string, ambiguous boolean, guess boolean"
TABLES = {
    "divisions": _DIVISION,
    "sections": _SECTION,
    "blocks": _BLOCK,
    "marks": _MARK,
    "citations": _CITATION,
    "all_citations": _CITATION,
    "amendments": _AMENDMENT,
    "ops": _OP,
    "nav": _NAV,
    "located": _LOCATED,
}
_HEAD = (
    "doc_id string, n_chars bigint, designation string, short_title string, congress string, uncovered int, bad_offsets int, overlaps int, bad_op_offsets int"
)


def _struct(ddl: str) -> StructType:
    return _parse_datatype_string(ddl)


def schema() -> StructType:
    from pyspark.sql.types import ArrayType

    out = _struct(_HEAD)
    for name, ddl in TABLES.items():
        out = out.add(name, ArrayType(_struct(ddl)))
    return out


def _plain(x, names: list[str], **more) -> dict:
    return {n: getattr(x, n) for n in names if hasattr(x, n)} | more


_CITE_NAMES = [f.name for f in fields(citations.Citation)] + ["ladder"]


def _citation(c: citations.Citation) -> dict:
    out = {n: getattr(c, n) for n in _CITE_NAMES}
    if c.inserted:
        out["inserted"] = {"start": c.inserted.start, "end": c.inserted.end, "phrase": c.inserted.phrase}
    return out


#: How far a pass goes: structure alone, citations too, or everything.
STRUCTURE, CITATIONS, ALL = 0, 1, 2


def read_one(doc_id: str, text: str, depth: int = ALL) -> dict:
    """The tables of one bill; those beyond ``depth`` are left out."""
    bill = structure.parse_bill(text)
    blocks = structure.quoted_blocks(text)
    out = {
        "doc_id": doc_id,
        "n_chars": len(text),
        "designation": bill.designation,
        "short_title": bill.short_title,
        "congress": bill.congress,
        "divisions": [_plain(d, ["label", "heading", "start", "rank"], seq=k) for k, d in enumerate(bill.divisions)],
        "sections": [
            _plain(s, ["num", "heading", "division", "run_in", "start", "end"], seq=k, ancestors=[_plain(d, ["label", "heading", "start"]) for d in s.ancestors])
            for k, s in enumerate(bill.sections)
        ],
        "blocks": [_plain(b, ["start", "end", "phrase"], seq=k) for k, b in enumerate(blocks)],
    }
    if depth == STRUCTURE:
        return out
    cites = citations.extract(text, blocks)
    out["citations"] = [_citation(c) for c in cites]
    if depth == CITATIONS:
        return out
    found = amend.extract(text, cites, bill)
    both = amend.relative(cites, found)
    outline = structure.Outline(text)
    nav = [
        _plain(n, ["start", "end", "text", "unit", "markers", "path", "exact", "inserted"], am_id=a.id, nav_kind=kind, seq=k, range_from=(n.range or (None,))[0], range_to=(n.range or (None,))[-1])
        for a in found
        for kind, rows in (("step", a.steps), ("ref", a.refs))
        for k, n in enumerate(rows)
    ]
    spans = [o for a in found for o in a.ops if o.start is not None and o.text is not None]
    return out | {
        "uncovered": amend.uncovered(text, found),
        "bad_offsets": sum(text[c.start : c.end] != c.text for c in cites),
        "overlaps": sum(b.start < a.end for a, b in zip(cites, cites[1:])),
        "bad_op_offsets": sum(text[o.start : o.end] != o.text for o in spans),
        "marks": [_plain(m, ["pos", "marker", "depth"]) for m in outline.marks],
        "all_citations": [_citation(c) for c in both],
        "amendments": [
            _plain(a, ["id", "start", "end", "unit", "section", "subsection", "verb", "act_name", "distributed", "via_instruction"], target=a.target and _citation(a.target))
            for a in found
        ],
        "ops": [_plain(o, [f.name for f in fields(amend.Op)], am_id=a.id, op_seq=k) for a in found for k, o in enumerate(a.ops)],
        "nav": nav,
        "located": [x for x in internal.fates(bill, outline, both)],
    }


def analyse(bills: DataFrame, depth: int = ALL) -> DataFrame:
    """One row per bill (doc_id, text): its facts, and an array column for each of TABLES, null beyond ``depth``. Null texts have no row."""
    out = schema()
    arrow = to_arrow_schema(out)
    width = 64  # documents are large rows

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            ids, texts = b.column(0).to_pylist(), b.column(1).to_pylist()
            for k in range(0, len(ids), width):
                rows = [read_one(i, t, depth) for i, t in zip(ids[k : k + width], texts[k : k + width])]
                yield pa.RecordBatch.from_pylist(rows, schema=arrow)

    texts = bills.where("text is not null").select("doc_id", "text")
    return (texts if texts.isStreaming else spread(texts, "doc_id")).mapInArrow(run, out)


#: Tables that need more or less of the instructions than the walk.
_DEPTHS = {"amendments": amend.TARGET, "ops": amend.ALL}


def _found(text: str, name: str) -> list[tuple[object, dict]]:
    """What one of TABLES holds of a text, with the fields that the object itself lacks; nothing else is read."""
    if name == "blocks":
        return [(b, {"seq": k}) for k, b in enumerate(structure.quoted_blocks(text))]
    if name == "marks":
        return [(m, {}) for m in structure.Outline(text).marks]
    if name == "citations":
        return [(c, {}) for c in citations.extract(text)]
    if name in ("divisions", "sections"):
        return [(x, {"seq": k}) for k, x in enumerate(getattr(structure.parse_bill(text), name))]
    bill = structure.parse_bill(text) if name == "located" or amend.declares_tax_code(text) else structure.Bill(text)
    cites = citations.extract(text)
    ams = amend.extract(text, cites, bill, _DEPTHS.get(name, amend.WALK))
    if name == "amendments":
        return [(a, {}) for a in ams]
    if name == "ops":
        return [(o, {"am_id": a.id, "op_seq": k}) for a in ams for k, o in enumerate(a.ops)]
    if name == "nav":
        return [
            (n, {"am_id": a.id, "nav_kind": kind, "seq": k, "range_from": (n.range or (None,))[0], "range_to": (n.range or (None,))[-1]})
            for a in ams for kind, steps in (("step", a.steps), ("ref", a.refs)) for k, n in enumerate(steps)
        ]
    both = amend.relative(cites, ams)
    if name == "all_citations":
        return [(c, {}) for c in both]
    return [(None, x) for x in internal.fates(bill, structure.Outline(text), both)]


def _plainly(value, kind: pa.DataType | None = None):
    if isinstance(value, (structure.Block, structure.Division)):
        return vars(value)
    if isinstance(value, citations.Citation):
        return {f.name: getattr(value, f.name) for f in kind} if kind else _citation(value)
    return [_plainly(x) for x in value] if isinstance(value, list) else value


def rows(bills: DataFrame, name: str) -> DataFrame:
    """doc_id and the rows of one of TABLES of bills (doc_id, text)."""
    out = _struct(f"doc_id string, {TABLES[name]}")
    arrow = to_arrow_schema(out)
    width = 512

    def column(field, pairs: list[tuple[object, dict]]) -> pa.Array:
        return pa.array([_plainly(more[field.name] if field.name in more else getattr(x, field.name, None), field.type) for x, more in pairs], field.type)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            ids, texts = b.column(0).to_pylist(), b.column(1).to_pylist()
            for k in range(0, len(ids), width):
                pairs = [(x, {**more, "doc_id": i}) for i, t in zip(ids[k : k + width], texts[k : k + width]) for x, more in _found(t, name)]
                yield pa.RecordBatch.from_arrays([column(f, pairs) for f in arrow], schema=arrow)

    texts = bills.where("text is not null").select("doc_id", "text")
    return (texts if texts.isStreaming else spread(texts, "doc_id")).mapInArrow(run, out)


def table(analysis: DataFrame, name: str) -> DataFrame:
    """doc_id and the rows of one of TABLES."""
    return analysis.select("doc_id", F.inline(name))


def citation_amendments(analysis: DataFrame) -> DataFrame:
    """doc_id, id, start, am_id: the amendment that a citation was composed in, else the one whose target it is; citations of none have no row."""
    own = lambda c: lambda a: F.coalesce(a["id"] == c["via_amendment"], a["target"]["id"] == c["id"])
    told = F.transform("all_citations", lambda c: F.struct(c["id"].alias("id"), c["start"].alias("start"), F.get(F.filter("amendments", own(c)), F.lit(0))["id"].alias("am_id")))
    return analysis.select("doc_id", F.inline(told)).where("am_id is not null")
