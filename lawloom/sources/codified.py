"""Codified law and regulations from XML documents, public laws from their prints, and the library of sample bills."""

from __future__ import annotations

import io
import re
import xml.etree.ElementTree as ET
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_schema
from pyspark.sql.types import _parse_datatype_string

from lawloom.functions.structure import parse_bill, parse_paragraphs
from lawloom.functions.text import slug

# Elements of the format, and limits on what is kept of notes.
CONTAINERS = ("title", "subtitle", "chapter", "subchapter", "part", "subpart", "division")
LEVELS = ("subsection", "paragraph", "subparagraph", "clause", "subclause", "item", "subitem")
SKIPPED = ("num", "heading", "note", "notes", "sourceCredit", "toc", "ref-note")
NOTES_KEPT, NOTE_CHARS = 10, 1200

_SECTION = (
    "title string, section string, doc_order bigint, heading string, lead string, source_credit string, release_point string, "
    "notes array<struct<topic:string,heading:string,text:string>>, ancestors array<struct<type:string,num:string,heading:string,identifier:string>>, "
    "nodes array<struct<ord:int,path:string,parent_path:string,marker:string,level:int,heading:string,text:string>>, error string"
)


def _local(e: ET.Element) -> str:
    return e.tag.rsplit("}", 1)[-1]


def _squeezed(parts: Iterator[str | None]) -> str:
    return " ".join("".join(p for p in parts if p).split())


def _whole(e: ET.Element | None) -> str:
    return "" if e is None else _squeezed(e.itertext())


def _child(e: ET.Element, name: str) -> ET.Element | None:
    return next((c for c in e if _local(c) == name), None)


def _own(e: ET.Element) -> Iterator[str | None]:
    """Text of this level: not of the levels below, nor of numbers, headings and notes."""
    yield e.text
    for c in e:
        if _local(c) not in SKIPPED and _local(c) not in LEVELS:
            yield from _own(c)
        yield c.tail


def _marker(e: ET.Element) -> str:
    num = _child(e, "num")
    raw = _whole(num)
    if m := re.search(r"\(([A-Za-z0-9]+)\)", raw):
        return m[0]
    value = num.get("value") if num is not None else None
    return f"({value})" if value else raw


def _nodes(e: ET.Element, path: str, level: int, out: list[dict]) -> list[dict]:
    for c in e:
        if _local(c) in LEVELS:
            marker = _marker(c)
            out.append({"ord": len(out), "path": path + marker, "parent_path": path, "marker": marker, "level": level, "heading": _whole(_child(c, "heading")), "text": _squeezed(_own(c))})
            _nodes(c, path + marker, level + 1, out)
    return out


def _note(n: ET.Element) -> dict:
    def body() -> Iterator[str | None]:
        yield n.text
        for c in n:
            if _local(c) != "heading":
                yield "".join(c.itertext())
            yield c.tail

    return {"topic": n.get("topic"), "heading": _whole(_child(n, "heading")), "text": _squeezed(body())[:NOTE_CHARS]}


def _section_row(title: str, e: ET.Element, order: int, above: list[dict], release_point: str | None) -> dict:
    num = _child(e, "num")
    return {
        "title": title, "section": (num.get("value") if num is not None else None) or _whole(num).strip("§. "), "doc_order": order, "heading": _whole(_child(e, "heading")),
        "lead": _squeezed(_own(e)), "source_credit": _whole(next((x for x in e.iter() if _local(x) == "sourceCredit"), None)), "release_point": release_point,
        "notes": [x for x in (_note(n) for n in e.iter() if _local(n) == "note") if x["text"]][:NOTES_KEPT], "ancestors": above, "nodes": _nodes(e, "", 1, []), "error": None,
    }


def read_title(title: str, xml: str, release_point: str | None) -> Iterator[dict]:
    """Sections of one title as they close, in order; what is read is let go. Sections quoted inside notes are no sections of the code. If the document breaks off, the last row says so."""
    order, quoted = 0, 0
    open_: list[ET.Element] = []
    above: list[dict | None] = []  # an open container, told once its heading is known; None for other elements
    inside: ET.Element | None = None

    def told(e: ET.Element) -> dict:
        num = _child(e, "num")
        return {"type": _local(e), "num": (num.get("value") if num is not None else None) or _whole(num), "heading": _whole(_child(e, "heading")), "identifier": e.get("identifier")}

    try:
        for event, e in ET.iterparse(io.BytesIO(xml.encode()), ("start", "end")):
            name = _local(e)
            if event == "start":
                if inside is None and not quoted and name == "section" and (e.get("identifier") or "").startswith(f"/us/usc/t{title}/s"):
                    inside = e
                    above = [told(x) for x in open_ if _local(x) in CONTAINERS]
                quoted += inside is None and name in ("note", "notes")
                open_.append(e)
                continue
            open_.pop()
            if e is inside:
                order += 1
                yield _section_row(title, e, order, above, release_point)
                inside = None
                e.clear()
                if open_:
                    open_[-1].remove(e)
            elif inside is None and name in ("note", "notes"):
                quoted -= 1
    except ET.ParseError as broken:
        yield {"title": title, "release_point": release_point, "error": str(broken)}


def _read_documents(documents: DataFrame) -> DataFrame:
    schema = to_arrow_schema(_parse_datatype_string(_SECTION))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for r in b.to_pylist():
                rows: list[dict] = []
                for row in read_title(r["title"], r["xml"], r["release_point"]):
                    rows.append(row)
                    if len(rows) == 256:
                        yield pa.RecordBatch.from_pylist(rows, schema=schema)
                        rows = []
                if rows:
                    yield pa.RecordBatch.from_pylist(rows, schema=schema)

    return documents.where("title is not null and xml is not null").select("title", "xml", "release_point").mapInArrow(run, _SECTION)


def read_code(documents: DataFrame, titles: list[str] | None = None) -> DataFrame:
    """Rows (title, xml, release_point) to sections with their entry numbers and nodes; of ``titles`` only, if given. For documents that break off see ``unreadable``."""
    wanted = documents if titles is None else documents.where(F.col("title").isin(titles))
    keyed = _read_documents(wanted).where("error is null").drop("error").withColumn("slug", slug(F.col("section")))
    return keyed.withColumn("entry", F.row_number().over(Window.partitionBy("title", "slug").orderBy("doc_order")) - 1)


def unreadable(documents: DataFrame) -> DataFrame:
    """title, error of documents that could not be read to their end."""
    return _read_documents(documents).where("error is not null").select("title", "error")


def store_titles(sections: DataFrame, path: str) -> None:
    """Write sections by title; the titles among them replace what was stored of these titles, others stay."""
    sections.write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy("title").parquet(path)


def code_nodes(sections: DataFrame) -> DataFrame:
    return sections.select("title", "slug", "entry", F.inline("nodes"))


def strip_notes(text: Column) -> Column:
    """Without the marginal notes of a public law's print."""
    return F.regexp_replace(text, r"[ \t]*<<NOTE:[\s\S]*?>>[ \t]*", " ")


_LAW = (
    "law_id string, name string, sections array<struct<seq:int,number:string,heading:string,run_in:boolean,ancestors:array<string>,text:string>>, "
    "contents array<struct<seq:int,num:string,heading:string,where_path:array<string>>>"
)


def read_laws(laws: DataFrame) -> DataFrame:
    """Prints of public laws (law_id, text) to one row each: short title, sections with their text, contents (headings of at most 120 characters)."""
    schema = to_arrow_schema(_parse_datatype_string(_LAW))

    def one(law_id: str, text: str) -> dict:
        bill = parse_bill(text)
        return {
            "law_id": law_id, "name": bill.short_title,
            "sections": [
                {"seq": k, "number": x.num, "heading": x.heading, "run_in": x.run_in, "ancestors": [f"{d.label}—{d.heading}" for d in x.ancestors], "text": text[x.start : x.end].rstrip()}
                for k, x in enumerate(bill.sections)
            ],
            "contents": [{"seq": k, "num": x.num, "heading": x.heading[:120], "where_path": [d.label for d in x.ancestors]} for k, x in enumerate(bill.sections)],
        }

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for k in range(0, b.num_rows, 64):
                part = b.slice(k, 64)
                yield pa.RecordBatch.from_pylist([one(i, t) for i, t in zip(part.column(0).to_pylist(), part.column(1).to_pylist())], schema=schema)

    return laws.where("law_id is not null and text is not null").select("law_id", strip_notes(F.col("text")).alias("text")).mapInArrow(run, _LAW)


def law_sections(read: DataFrame) -> DataFrame:
    """law_id, number, slug, entry (of those with one number), heading, run_in, ancestors, text."""
    rows = read.select("law_id", F.inline("sections"))
    w = Window.partitionBy("law_id", "number").orderBy("seq")
    return rows.select("law_id", "number", slug(F.col("number")).alias("slug"), (F.row_number().over(w) - 1).alias("entry"), "heading", "run_in", "ancestors", "text")


def law_contents(read: DataFrame) -> DataFrame:
    """law_id, seq, num, heading, where_path."""
    return read.select("law_id", F.inline("contents"))


def names_agree(name: Column, short_title: Column) -> Column:
    """Equal, one within the other, or most words of the shorter in the longer."""
    flat = lambda c: F.trim(F.regexp_replace(F.lower(c), "[^a-z0-9]+", " "))
    a, b = flat(name), flat(short_title)
    short, long = F.when(F.length(a) < F.length(b), a).otherwise(b), F.when(F.length(a) < F.length(b), b).otherwise(a)
    words = F.filter(F.split(short, " "), lambda w: (F.length(w) > 3) & (w != "act"))
    share = F.size(F.filter(words, lambda w: F.instr(long, w) > 0)) / F.greatest(F.size(words), F.lit(1))
    return short_title.isNull() | (a == b) | F.contains(a, b) | F.contains(b, a) | ((F.size(words) > 0) & (share >= 0.6))


def issue_at(cfr_section: DataFrame, wanted: DataFrame) -> DataFrame:
    """Rows (key, title, number, day) with the issue in force on the day: the latest that is not later."""
    met = wanted.join(cfr_section, ["title", "number"]).where("as_of <= day")
    return met.groupBy("key").agg(F.max_by(F.struct("as_of", "heading", "paragraphs"), "as_of").alias("issue")).select("key", "issue.*")


def split_heading(text: str) -> tuple[str, str]:
    """Number and title of ``§ 12.3 Title.``; no number where the sign is missing."""
    bare = text.strip()
    if not bare.startswith("§"):
        return "", bare
    number, _, title = bare.lstrip("§").strip().partition(" ")
    return number, title.strip().removesuffix(".")


_RULE = "title string, as_of string, part string, number string, heading string, paragraphs array<string>, error string"


def read_rules(documents: DataFrame) -> DataFrame:
    """XML of regulations (title, as_of, xml), a part or a section each, to rows: title, as_of, part, number, heading, paragraphs, error (of documents that break off)."""
    schema = to_arrow_schema(_parse_datatype_string(_RULE))

    def sections(r: dict) -> Iterator[dict]:
        part = None
        same = {"title": r["title"], "as_of": r["as_of"]}
        try:
            for event, e in ET.iterparse(io.BytesIO(r["xml"].encode()), ("start", "end")):
                if event == "start":
                    part = e.get("N") if e.get("TYPE") == "PART" else part
                elif e.get("TYPE") == "SECTION":
                    number, heading = split_heading(_whole(_child(e, "HEAD")))
                    number = number or e.get("N") or ""
                    paragraphs = [t for t in (_whole(c) for c in e if _local(c) in ("P", "FP")) if t]
                    yield {**same, "part": part or number.split(".")[0], "number": number, "heading": heading, "paragraphs": paragraphs}
                    e.clear()
        except ET.ParseError as broken:
            yield {**same, "error": str(broken)}

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for k in range(0, b.num_rows, 64):
                yield pa.RecordBatch.from_pylist([x for r in b.slice(k, 64).to_pylist() for x in sections(r)], schema=schema)

    return documents.where("xml is not null").select("title", "as_of", "xml").mapInArrow(run, _RULE)


def rule_provisions(cfr_section: DataFrame) -> DataFrame:
    """Regulations (reg_id, paragraphs) to provisions in preorder: reg_id, ord, parent, path, marker, level, text."""
    names = ("ord", "parent", "path", "marker", "level", "text")
    out = "reg_id bigint, ord int, parent int, path string, marker string, level int, text string"
    schema = to_arrow_schema(_parse_datatype_string(out))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            rows = [(i, p) for i, ps in zip(b.column(0).to_pylist(), b.column(1).to_pylist()) for p in parse_paragraphs(ps)]
            columns = [[i for i, _ in rows], *([getattr(p, n) for _, p in rows] for n in names)]
            yield pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(columns, schema)], schema=schema)

    return cfr_section.where("paragraphs is not null").select("reg_id", "paragraphs").mapInArrow(run, out)


# Number words of years in preambles.
_ONES = "zero one two three four five six seven eight nine ten eleven twelve thirteen fourteen fifteen sixteen seventeen eighteen nineteen".split()
_TENS = "twenty thirty forty fifty sixty seventy eighty ninety".split()
NOTE_LIMIT = 96


def year_in_words(c: Column) -> Column:
    """2020 of ``two thousand and twenty``; null where a word is none."""
    value = F.create_map(*[F.lit(x) for k, w in enumerate(_ONES) for x in (w, k)], *[F.lit(x) for k, w in enumerate(_TENS, 2) for x in (w, 10 * k)])
    words = F.filter(F.split(F.lower(F.translate(F.coalesce(c, F.lit("")), "-", " ")), r"\s+"), lambda w: (w != "") & (w != "and"))
    two = (F.get(words, F.lit(0)) == "two") & (F.get(words, F.lit(1)) == "thousand")
    nineteen = F.get(words, F.lit(0)) == "nineteen"
    rest = F.slice(words, F.when(two, 3).otherwise(2), F.lit(99))
    total = F.aggregate(rest, F.lit(0), lambda acc, w: acc + F.try_element_at(value, w))
    return F.when(two, 2000 + total).when(nineteen, 1900 + total)


def library(manifest: DataFrame, bills: DataFrame) -> DataFrame:
    """Sample bills (id, name, why; id, text, bytes) with a year in the name and a short note, smallest first by ``bytes``."""
    head = F.regexp_replace(F.substring("text", 1, 4000), r"\s+", " ")
    words = F.regexp_extract(head, r"(?i)day\s+of\s+[A-Z][a-z]+,\s+((?:nineteen|two\s+thousand)[a-z\s-]{0,28}?)(?=[,.]|\s+An\s+Act|\s+Joint\s+Resolution|\z)", 1)
    congress = F.regexp_extract("id", r"-(\d{2,3})-", 1)
    year = F.coalesce(year_in_words(words), F.when(congress != "", 1789 + 2 * (congress.cast("int") - 1)))
    bare = F.regexp_replace("name", r"\s*\((?:enrolled|joint resolution, enrolled)\)\s*\z", "")
    dated = F.when(bare.rlike(r"\b(?:1[89]\d\d|20\d\d)\b"), bare).when(bare.endswith(")"), F.concat(F.regexp_replace(bare, r"\)\z", ""), F.lit(", "), year, F.lit(")"))).otherwise(
        F.concat(bare, F.lit(" ("), year, F.lit(")"))
    )
    why = F.trim(F.regexp_replace(F.regexp_replace(F.coalesce("why", F.lit("")), r"\s+", " "), r"(?i)^~?\d+(?:\.\d+)?\s*[KM]B[.,]?\s*", ""))
    sentence = F.regexp_extract(why, r"^(.{1,95}?(?<![A-Z])\.)\s+[A-Z]", 1)
    cut = F.concat(F.regexp_replace(F.substring(why, 1, NOTE_LIMIT), r" [^ ]*\z", ""), F.lit("…"))
    note = F.when(sentence != "", sentence).when(F.length(why) <= NOTE_LIMIT, why).otherwise(cut)
    return manifest.join(bills.select("id", "text", "bytes"), "id").select("id", dated.alias("name"), year.cast("int").alias("year"), note.alias("note"), "bytes").orderBy("bytes")
