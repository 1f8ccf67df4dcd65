"""Spans of a pattern as Column expressions: marked with two control characters, split, and placed by running lengths."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

_ON, _OFF = "\u0001", "\u0002"
_PATH = r"((?:\([A-Za-z0-9]{1,8}\))*)"
_BLANK = r"[\s\x{A0}]"
#: Forms of citations that a pattern alone can read, for the JVM; with the places of their fields.
CODE = (
    rf"(?i)\b(\d{{1,2}}[A-Z]?){_BLANK}*U\.?{_BLANK}?S\.?{_BLANK}?C\.?{_BLANK}*(?:§+{_BLANK}*)?(\d+[A-Za-z]*(?:[–—-]{_BLANK}*\d+[A-Za-z]*)?){_PATH}"
    rf"({_BLANK}*(?:et{_BLANK}+seq\.?|and{_BLANK}+following))?",
    {"title": 1, "section": 2, "subsection": 3, "more": 4},
)
STATUTES = (rf"(?i)\b(\d{{1,3}}){_BLANK}+Stat\.{_BLANK}*(\d{{1,5}})", {"volume": 1, "page": 2})
LAW = (
    rf"(?i)\b(?:Pub(?:lic)?\.?{_BLANK}*L(?:aw)?\.?|P\.{_BLANK}?L\.){_BLANK}*(?:No\.?{_BLANK}*)?(\d{{1,3}}){_BLANK}*[–—-]{_BLANK}*(\d{{1,4}})",
    {"congress": 1, "law": 2},
)


def spans(text: Column, pattern: str) -> Column:
    """array<struct<start, end, text>> of all matches; nothing of the text moves out of the JVM."""
    clean = F.translate(text, _ON + _OFF, "  ")
    parts = F.split(F.regexp_replace(clean, pattern, _ON + "$0" + _OFF), _ON)
    zero = F.struct(F.lit(0).cast("bigint").alias("at"), F.array().cast("array<struct<start:bigint,end:bigint,text:string>>").alias("out"))

    def step(acc: Column, part: Column) -> Column:
        found = F.substring_index(part, _OFF, 1)
        held = F.contains(part, F.lit(_OFF))
        span = F.struct(acc["at"].alias("start"), (acc["at"] + F.length(found)).alias("end"), found.alias("text"))
        return F.struct(
            (acc["at"] + F.length(part) - held.cast("int")).alias("at"), F.when(held, F.array_append(acc["out"], span)).otherwise(acc["out"]).alias("out")
        )

    return F.aggregate(parts, zero, step, lambda acc: acc["out"])


def find_all(text: Column, pattern: str, groups: dict[str, int]) -> Column:
    """array<struct<start, end, text, group...>>; the groups are read from each match alone."""
    one = lambda m: F.struct(m["start"].alias("start"), m["end"].alias("end"), m["text"].alias("text"), *[F.regexp_extract(m["text"], pattern, k).alias(n) for n, k in groups.items()])
    return F.transform(spans(text, pattern), one)


def lines(text: Column) -> Column:
    """array<struct<pos, start, line>>."""
    parts = F.split(text, "\n")
    zero = F.struct(F.lit(0).cast("bigint").alias("at"), F.array().cast("array<struct<pos:int,start:bigint,line:string>>").alias("out"))

    def step(acc: Column, line: Column) -> Column:
        row = F.struct(F.size(acc["out"]).alias("pos"), acc["at"].alias("start"), line.alias("line"))
        return F.struct((acc["at"] + F.length(line) + 1).alias("at"), F.array_append(acc["out"], row).alias("out"))

    return F.aggregate(parts, zero, step, lambda acc: acc["out"])
