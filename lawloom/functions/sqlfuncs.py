"""Table functions for SQL: ``SELECT ... FROM bill, LATERAL cite(text)``."""

from __future__ import annotations

from collections.abc import Iterator

from pyspark.sql import SparkSession
from pyspark.sql.functions import udtf

from lawloom.functions import amend, citations, structure


@udtf(returnType="id string, kind string, text string, start bigint, end bigint, title string, section string, subsection string")
class Cite:
    def eval(self, text: str) -> Iterator[tuple]:
        for c in citations.extract(text) if text else ():
            yield c.id, c.kind, c.text, c.start, c.end, c.title, c.section, c.subsection


@udtf(returnType="num string, heading string, division string, run_in boolean, start bigint, end bigint")
class Sections:
    def eval(self, text: str) -> Iterator[tuple]:
        for s in structure.parse_bill(text).sections if text else ():
            yield s.num, s.heading, s.division, s.run_in, s.start, s.end


@udtf(returnType="am_id string, verb string, section string, subsection string, start bigint, end bigint, ops int")
class Amendments:
    def eval(self, text: str) -> Iterator[tuple]:
        if text:
            for a in amend.extract(text, citations.extract(text), structure.parse_bill(text)):
                yield a.id, a.verb, a.section, a.subsection, a.start, a.end, len(a.ops)


@udtf(returnType="ord int, parent int, path string, marker string, level int, heading string, text string")
class Provisions:
    def eval(self, text: str) -> Iterator[tuple]:
        for p in structure.parse_provision(text) if text else ():
            yield p.ord, p.parent, p.path, p.marker, p.level, p.heading, p.text


def register(spark: SparkSession) -> None:
    for name, function in {"cite": Cite, "bill_sections": Sections, "bill_amendments": Amendments, "provisions": Provisions}.items():
        spark.udtf.register(name, function)
