"""Queries over generated bill texts whose right answer the generating columns give.

A recipe names a table, columns as SQL that both engines read alike, and a text made of them. Spark makes the text and runs the
operator on it; the check selects the columns without reading any text.
"""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lawloom.operators import bills as B
from lawloom.operators import metrics as M
from lawloom.session import spread, table


@dataclass(frozen=True)
class Recipe:
    source: str
    columns: dict[str, str]
    text: str
    read: Callable[[DataFrame, DataFrame], DataFrame]
    expect: str
    depth: int = B.ALL

    @property
    def base(self) -> str:
        return f"select {', '.join(f'{e} as {n}' for n, e in self.columns.items())} from {self.source}"

    def made(self, spark: SparkSession, d: str) -> DataFrame:
        rows = spread(table(spark, d, self.source), F.expr(self.columns["doc_id"])).selectExpr(*[f"{e} as {n}" for n, e in self.columns.items()])
        return rows.withColumn("text", F.expr(self.text))

    def query(self, spark: SparkSession, d: str) -> DataFrame:
        made = self.made(spark, d)
        return self.read(B.analyse(made, self.depth), made)

    @property
    def oracle(self) -> str:
        return f"with base as ({self.base}), b as (select *, {self.text} as text from base) select {self.expect} from b"


ORDER = {
    "doc_id": "cast(o_orderkey as string)",
    "k": "o_orderkey",
    "t": "cast(1 + o_orderkey % 50 as string)",
    "s": "concat(cast(o_orderkey as string), case o_orderkey % 3 when 0 then '' when 1 then 'a' else 'K' end)",
    "p": "case o_orderkey % 4 when 0 then '' when 1 then '(a)' when 2 then '(a)(2)' else '(b)(1)(C)' end",
    "c": "cast(90 + o_orderkey % 28 as string)",
    "l": "cast(1 + o_custkey % 900 as string)",
    "old": "concat('word', cast(o_custkey as string))",
    "new": "concat('term', cast(o_orderkey as string))",
    "act": "case o_orderkey % 4 when 0 then 'Clean Air Act' when 1 then 'Social Security Act' when 2 then 'Truth in Lending Act' else 'Federal Power Act' end",
    "qo": "case o_orderkey % 4 when 0 then '``' when 1 then '“' when 2 then '\"' else '‘‘' end",
    "qc": "case o_orderkey % 4 when 0 then '''''' when 1 then '”' when 2 then '\"' else '’’' end",
}


def _cites(kind: str, *names: str):
    def read(a: DataFrame, made: DataFrame) -> DataFrame:
        return B.rows(made, "citations").where(F.col("kind") == kind).select("doc_id", *names)

    return read


def _ops(*names: str, where: str = "true"):
    return lambda a, made: B.rows(made, "ops").where(where).select("doc_id", *names)


def _amendments(*names: str):
    return lambda a, made: B.rows(made, "amendments").selectExpr("doc_id", *names)


def _joined(name: str):
    return F.array_join(name, "|").alias(name)


HEAD = "concat('Section ', s, p, ' of the Harbor Act (', t, ' U.S.C. ', s, p, ') is amended')"

RECIPES: dict[str, Recipe] = {
    "usc_citations": Recipe(
        "orders", ORDER, "concat('Under ', t, ' U.S.C. ', s, p, case when k % 2 = 0 then ' et seq.' else '' end, ', the board acts.')",
        _cites("usc", "title", "section", "subsection", "et_seq", "start", "end"),
        "doc_id, t as title, s as section, p as subsection, k % 2 = 0 as et_seq, cast(6 as bigint) as start, cast(6 + length(t) + 8 + length(s) + length(p) + case when k % 2 = 0 then 8 else 0 end as bigint) as \"end\"",
        depth=B.CITATIONS,
    ),
    "usc_long_form": Recipe(
        "orders", ORDER, "concat('As section ', s, p, ' of title ', t, ', United States Code, says.')", _cites("usc", "title", "section", "subsection"),
        "doc_id, t as title, s as section, p as subsection",
        depth=B.CITATIONS,
    ),
    "usc_wrapped": Recipe(
        "orders", ORDER, "concat('See ', t, ' U.S.C. ', cast(k as string), 'c-\n    4', p, ' for it.')", _cites("usc", "title", "section", "subsection"),
        "doc_id, t as title, concat(cast(k as string), 'c-4') as section, p as subsection",
        depth=B.CITATIONS,
    ),
    "cfr_citations": Recipe(
        "orders", ORDER, "concat('Under ', t, case when k % 2 = 0 then ' CFR ' else ' C.F.R. § ' end, c, '.', l, p, ' it is so.')", _cites("cfr", "title", "unit", "part", "section", "subsection"),
        "doc_id, t as title, 'section' as unit, c as part, concat(c, '.', l) as section, p as subsection",
        depth=B.CITATIONS,
    ),
    "public_laws": Recipe(
        "orders", ORDER, "concat('Under ', case k % 3 when 0 then 'Public Law ' when 1 then 'Pub. L. ' else 'P.L. No. ' end, c, '-', l, ', it is so.')", _cites("publaw", "congress", "law"),
        "doc_id, c as congress, l as law",
        depth=B.CITATIONS,
    ),
    "stat_citations": Recipe("orders", ORDER, "concat('(', c, ' Stat. ', l, ')')", _cites("stat", "volume", "page"), "doc_id, c as volume, l as page", depth=B.CITATIONS),
    "act_names": Recipe("orders", ORDER, "concat('No keeper under the ', upper(act), ' pays.')", _cites("act", "act_name"), "doc_id, act as act_name", depth=B.CITATIONS),
    "act_sections": Recipe(
        "orders", ORDER, "concat('Under section ', s, p, ' of part B of title IV of the ', act, ', it is so.')",
        lambda a, made: B.rows(made, "citations").where("kind = 'act'").select("doc_id", "act_name", "act_section", "subsection", _joined("where")),
        "doc_id, act as act_name, s as act_section, p as subsection, 'TITLE IV|PART B' as \"where\"",
        depth=B.CITATIONS,
    ),
    "act_titles": Recipe("orders", ORDER, "concat('Under title XI of the ', act, ', it is so.')", _cites("act", "act_name", "act_title"), "doc_id, act as act_name, 'XI' as act_title", depth=B.CITATIONS),
    "act_divisions": Recipe(
        "orders", ORDER, "concat('Under title II of division B of the ', act, ', it is so.')",
        lambda a, made: B.rows(made, "citations").where("kind = 'act'").select("doc_id", "act_name", "division", _joined("where")),
        "doc_id, act as act_name, 'B' as division, 'DIVISION B|TITLE II' as \"where\"",
        depth=B.CITATIONS,
    ),
    "act_as_code": Recipe(
        "orders", ORDER, "concat('Under section ', s, p, ' of the Internal Revenue Code of 1986, it is so.')", _cites("usc", "title", "section", "subsection", "via_act"),
        "doc_id, '26' as title, s as section, p as subsection, 'Internal Revenue Code of 1986' as via_act",
        depth=B.CITATIONS,
    ),
    "publaw_section_chain": Recipe(
        "orders", ORDER, "concat('Under section ', s, p, ' of title II of div. B of Public Law ', c, '-', l, ', it is so.')",
        lambda a, made: B.rows(made, "citations").where("kind = 'publaw'").select("doc_id", "congress", "law", "act_section", "subsection", "division", _joined("where")),
        "doc_id, c as congress, l as law, s as act_section, p as subsection, 'B' as division, 'DIVISION B|TITLE II' as \"where\"",
        depth=B.CITATIONS,
    ),
    "publaw_paren_form": Recipe(
        "orders", ORDER, "concat('Under section ', s, p, ' of the Harbor Renewal Act (', t, ' U.S.C. 44 note; Public Law ', c, '-', l, '), it is so.')",
        _cites("publaw", "congress", "law", "act_section", "short_title"), "doc_id, c as congress, l as law, s as act_section, 'Harbor Renewal Act' as short_title",
        depth=B.CITATIONS,
    ),
    "internal_refs": Recipe(
        "orders", ORDER, "concat('As section ', s, p, ' of this Act and clause (iv) say, but not subsection (b) of section 9, it is so.')",
        _cites("internal", "ref_type", "section", "subsection", "scope"),
        "doc_id, unnest(['section', 'clause']) as ref_type, unnest([s, '']) as section, unnest([p, '(iv)']) as subsection, unnest(['act', 'section']) as scope",
        depth=B.CITATIONS,
    ),
    "internal_composed": Recipe(
        "orders", ORDER, "concat('As paragraph (3) of section ', s, p, ' of this title says.')", _cites("internal", "ref_type", "section", "subsection", "scope"),
        "doc_id, 'section' as ref_type, s as section, concat(p, '(3)') as subsection, 'title' as scope",
        depth=B.CITATIONS,
    ),
    "note_flag": Recipe(
        "orders", ORDER, "concat('See ', t, ' U.S.C. ', s, case when k % 2 = 0 then ' note' else ' notable' end, '.')", _cites("usc", "title", "section", "note"),
        "doc_id, t as title, s as section, k % 2 = 0 as note",
        depth=B.CITATIONS,
    ),
    "unit_of_code": Recipe(
        "orders", ORDER, "concat('Under subsection (h) of section 7 of the Harbor law (', t, ' U.S.C. ', s, '), it is so.')", _cites("usc", "title", "section", "subsection", "sub_from_prose"),
        "doc_id, t as title, s as section, '(h)' as subsection, true as sub_from_prose",
        depth=B.CITATIONS,
    ),
    "citation_dedupe": Recipe(
        "orders", ORDER, "concat('Under section ', s, ' of title II of the ', act, ' (', t, ' U.S.C. ', s, p, '; Public Law ', c, '-', l, ').')",
        lambda a, made: B.rows(made, "citations").groupBy("doc_id").agg(F.array_join(F.sort_array(F.collect_list("kind")), "|").alias("kinds"), F.max("id").alias("last")),
        "doc_id, case when p = '' then 'publaw|usc' else 'act|publaw|usc' end as kinds, case when p = '' then 'c1' else 'c2' end as last",
        depth=B.CITATIONS,
    ),
    "amend_heads": Recipe(
        "orders", ORDER, f"concat({HEAD}, ' to read otherwise.')", _amendments("unit", "section", "subsection", "verb", "target.title as title", "target.section as target_section", "start"),
        "doc_id, 'Section' as unit, s as section, p as subsection, 'amended' as verb, t as title, s as target_section, cast(0 as bigint) as start",
    ),
    "amend_note_target": Recipe(
        "orders", ORDER, "concat('Section ', s, ' of the Harbor Renewal rules (', t, ' U.S.C. 77 note; Public Law ', c, '-', l, ') is repealed.')",
        _amendments("verb", "target.kind as kind", "target.congress as congress", "target.law as law", "target.act_section as act_section"),
        "doc_id, 'repealed' as verb, 'publaw' as kind, c as congress, l as law, s as act_section",
    ),
    "strike_insert_ops": Recipe(
        "orders", ORDER, f"concat({HEAD}, ' by striking ', qo, old, qc, ' each place it appears and inserting ', qo, new, qc, '.')",
        _ops("op_seq", "type", "text", "all", "start", "replaces"),
        f"doc_id, unnest([0, 1]) as op_seq, unnest(['strike', 'insert']) as type, unnest([old, new]) as text, unnest([true, false]) as \"all\", "
        f"unnest([length({HEAD}) + 13 + length(qo), length({HEAD}) + 13 + 2 * length(qo) + length(old) + length(qc) + 37])::bigint as start, "
        f"unnest([null, length({HEAD}) + 13 + length(qo)])::bigint as replaces",
    ),
    "anchored_inserts": Recipe(
        "orders", ORDER, f"concat({HEAD}, ' by inserting ', case when k % 2 = 0 then 'after ' else 'before ' end, qo, old, qc, ' the following: ', qo, new, qc, '.')",
        _ops("type", "text", "relation", "anchor"), "doc_id, 'insert' as type, new as text, case when k % 2 = 0 then 'after' else 'before' end as relation, old as anchor",
    ),
    "punctuation_ops": Recipe(
        "orders", ORDER, f"concat({HEAD}, ' by striking the period at the end and inserting a semicolon.')", _ops("op_seq", "type", "operand", "at_end"),
        "doc_id, unnest([0, 1]) as op_seq, unnest(['strike', 'insert']) as type, unnest(['.', ';']) as operand, unnest([true, false]) as at_end",
    ),
    "added_blocks": Recipe(
        "orders", ORDER, f"concat({HEAD}, ' by adding at the end the following:\n    ', qo, '(9) ', new, ' is added.', qc, '.')",
        _ops("type", "text", "new_section"), "doc_id, 'add-at-end' as type, concat('(9) ', new, ' is added.') as text, false as new_section",
    ),
    "added_sections": Recipe(
        "orders", ORDER, f"concat('Chapter ', c, ' of title ', t, ', United States Code, is amended by adding at the end the following:\n    ', qo, 'SEC. 9. ', new, '.', qc, '.')",
        _ops("type", "new_section"), "doc_id, 'add-at-end' as type, true as new_section",
    ),
    "replacements": Recipe(
        "orders", ORDER, f"concat({HEAD}, ' to read as follows: ', qo, '(a) ', new, ' it is.', qc, '.')", _ops("type", "text"),
        "doc_id, 'replace' as type, concat('(a) ', new, ' it is.') as text",
    ),
    "redesignations": Recipe(
        "orders", ORDER, f"concat({HEAD}, ' by redesignating paragraphs (2) through (4) as paragraphs (3) through (5).')", _ops("type", "from_units", "to_units"),
        "doc_id, 'redesignate' as type, 'paragraphs (2) through (4)' as from_units, 'paragraphs (3) through (5)' as to_units",
    ),
    "unit_inserts": Recipe(
        "orders", ORDER, f"concat({HEAD}, ' by inserting after paragraph (8) the following:\n    ', qo, '(9) ', new, '.', qc, '.')",
        _ops("type", "text", "unit_anchor", "placement"), "doc_id, 'insert' as type, concat('(9) ', new, '.') as text, '(8)' as unit_anchor, 'after-unit' as placement",
    ),
    "op_scopes": Recipe(
        "orders", {**ORDER, "p": "'(a)'"}, f"concat({HEAD}, '--\n  (1) in paragraph (2)(A), by striking ', qo, old, qc, '; and\n  (2) in subsection (d), by striking ', qo, new, qc, '.')",
        _ops("text", "scope"), "doc_id, unnest([old, new]) as text, unnest(['(a)(2)(A)', '(d)']) as scope",
    ),
    "nav_steps": Recipe(
        "orders", {**ORDER, "p": "'(a)'"},
        f"concat({HEAD}, '--\n  (1) in paragraph (2)(A)--\n    (A) in clause (iii), by striking ', qo, old, qc, '; and\n    (B) in clause (iv), by striking ', qo, new, qc, '; and\n  (2) in subsection (d), by striking ', qo, old, qc, '.')",
        lambda a, made: B.rows(made, "nav").where("nav_kind = 'step'").select("doc_id", "seq", "path"),
        "doc_id, unnest([0, 1, 2, 3]) as seq, unnest(['(a)(2)(A)', '(a)(2)(A)(iii)', '(a)(2)(A)(iv)', '(d)']) as path",
    ),
    "nav_refs": Recipe(
        "orders", {**ORDER, "p": "'(b)'"}, f"concat({HEAD}, ' by redoing paragraphs (1), (3), and (4) as stated.')",
        lambda a, made: B.rows(made, "nav").where("nav_kind = 'ref'").select("doc_id", "seq", "path", "unit"),
        "doc_id, unnest([0, 1, 2]) as seq, unnest(['(b)(1)', '(b)(3)', '(b)(4)']) as path, 'paragraph' as unit",
    ),
    "relative_citations": Recipe(
        "orders", {**ORDER, "p": "'(a)'"}, f"concat({HEAD}, '--\n  (1) in paragraph (7), by striking ', qo, old, qc, '.')",
        lambda a, made: B.rows(made, "all_citations").where("relative").select("doc_id", "title", "section", "subsection", "via_target"),
        "doc_id, t as title, s as section, '(a)(7)' as subsection, concat(t, ' U.S.C. ', s, '(a)') as via_target",
    ),
    "such_section": Recipe(
        "orders", ORDER, f"concat({HEAD}, ' by striking ', qo, old, qc, '.\n\nSubsection (c) of such section is amended by striking ', qo, new, qc, '.')",
        lambda a, made: B.rows(made, "amendments").where("id = 'a1'").selectExpr("doc_id", "target.title as title", "target.section as section", "target.subsection as subsection"),
        "doc_id, t as title, s as section, '(c)' as subsection",
    ),
    "such_title": Recipe(
        "orders", ORDER, f"concat({HEAD}, ' by striking ', qo, old, qc, '.\n\nSection 77 of such title is repealed.')",
        lambda a, made: B.rows(made, "amendments").where("id = 'a1'").selectExpr("doc_id", "target.title as title", "target.section as section"), "doc_id, t as title, '77' as section",
    ),
    "irc_scope": Recipe(
        "orders", ORDER,
        "concat('DIVISION A--FIRST\n\nSEC. 1. REFERENCES.\n\nWhenever in this division a section is meant, it is one of the Internal Revenue Code of 1986.\n\nSEC. 2. ONE.\n\nSection ', s, ' is repealed.\n\nDIVISION B--SECOND\n\nSEC. 3. TWO.\n\nSection ', s, ' is repealed.')",
        _amendments("id", "target.title as title", "target.section as section"), "doc_id, unnest(['a0', 'a1']) as id, unnest(['26', null]) as title, unnest([s, null]) as section",
    ),
    "amend_each_distributed": Recipe(
        "orders", ORDER, "concat('Each of the following provisions is amended by striking ', qo, old, qc, ':\n  (A) Section ', s, ' of title ', t, ', United States Code.\n  (B) Section 8 of title ', t, ', United States Code.\n')",
        _amendments("section", "target.title as title", "distributed"), "doc_id, unnest([s, '8']) as section, t as title, true as distributed",
    ),
    "quoted_blocks": Recipe(
        "orders", ORDER, "concat('It reads:\n    ', qo, '(a) ', new, '\nand more.', qc, '\n', qo, old, qc, ' is a word.')",
        lambda a, made: B.rows(made, "blocks").select("doc_id", "seq", "start", "phrase"),
        "doc_id, unnest([0, 1]) as seq, unnest([14, 14 + 2 * length(qo) - length(qo) + 4 + length(new) + 10 + length(qc) + 1])::bigint as start, unnest([false, true]) as phrase",
        depth=B.STRUCTURE,
    ),
    "outline_marks": Recipe(
        "orders", ORDER, "concat('(a) ', old, ' under paragraph\n(1) may\n  (B)(i) ', new, '\n  (12) end')",
        lambda a, made: B.rows(made, "marks").select("doc_id", "marker", "depth", "pos"),
        "doc_id, unnest(['(a)', '(B)', '(i)', '(12)']) as marker, unnest([0, 2, 3, 1]) as depth, "
        "unnest([0, 4 + length(old) + 27, 4 + length(old) + 30, 4 + length(old) + 34 + length(new) + 3])::bigint as pos",
    ),
    "metric_kinds": Recipe(
        "orders", ORDER, "concat('See ', t, ' U.S.C. ', s, ', ', c, ' Stat. ', l, ', Public Law ', c, '-', l, ', and the ', act, '.')",
        lambda a, made: M.corpus_metrics(a).where("metric in ('byKind.usc', 'byKind.stat', 'byKind.publaw', 'byKind.act', 'citations', 'badOffsets', 'overlaps', 'chars')"),
        "doc_id, unnest(['byKind.usc', 'byKind.stat', 'byKind.publaw', 'byKind.act', 'citations', 'badOffsets', 'overlaps', 'chars']) as metric, unnest([1, 1, 1, 1, 4, 0, 0, length(text)])::bigint as value",
    ),
    "impact_fates": Recipe(
        "orders", ORDER, "concat('SEC. 1. FIRST.\n\n    (a) ', old, '.\n        (1) As paragraph (2) and paragraph (9) say.\n        (2) ', new, '.\n')",
        lambda a, made: M.internal_fates(B.rows(made, "located")), "doc_id, unnest(['inBill', 'unresolved']) as fate, unnest([1, 1])::bigint as n",
    ),
    "internal_locate": Recipe(
        "orders", ORDER, "concat('SEC. 1. FIRST.\n\n    (1) ', old, '.\n        (A) As clause (ii) says.\n            (i) x\n            (ii) ', new, '\n        (B) y\n            (ii) z\n')",
        lambda a, made: B.rows(made, "located").select("doc_id", "fate", "start", "ambiguous", "guess"),
        "doc_id, 'inBill' as fate, cast(16 + 4 + 4 + length(old) + 2 + 33 + 18 + 12 as bigint) as start, false as ambiguous, false as guess",
    ),
}


def queries() -> dict:
    return {n: r.query for n, r in RECIPES.items()}


def oracles() -> dict[str, str]:
    return {n: r.oracle for n, r in RECIPES.items()}
