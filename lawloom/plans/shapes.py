"""Further queries over generated bill texts of several sentences, with noise around what is to be read, and the SQL that knows the answer."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lawloom.operators import bills as B
from lawloom.operators import metrics as M
from lawloom.operators import views
from lawloom.plans.known import HEAD, ORDER, Recipe

NOISE = "concat('The clerk of ', old, ' keeps 5 or 6 books (see page 9; or ask). No section is meant here.\n\n')"
LAW = "concat('Section ', s, p, ' of title ', t, ', United States Code,')"
A = {**ORDER, "p": "'(a)'"}


def _amendments(*names: str):
    return lambda a, made: B.rows(made, "amendments").selectExpr("doc_id", *names)


def _ops(*names: str, where: str = "true"):
    return lambda a, made: B.rows(made, "ops").where(where).select("doc_id", *names)


def _nav(*names: str, where: str):
    return lambda a, made: B.rows(made, "nav").where(where).select("doc_id", *names)


_BILL = (
    "concat(c, 'th CONGRESS\n  H. R. ', l, '\n\nTable of contents for this Act\n\nTITLE I--', upper(old), '\n\nSec. 101. Strings.\n\nmore words.\n\nDIVISION A\n\nGRAND ', upper(new), '\n\n"
    "TITLE II--SHIPS OF\nTHE ', upper(old), '\n\nSEC. 1. SHORT TITLE; LONG\n    NAMES.\n\n  This Act may be cited as the ``Kite-\n   ', new, ' Act''''.\n\n  Sec. 102. Strings of all kinds.\n\n"
    "TITLE III--SAILS\n\nSubtitle A--Of ', new, '\n\nSEC. 2. SAILS.\n\nend')"
)

RECIPES: dict[str, Recipe] = {
    "amend_unit_heads": Recipe(
        "orders", {**ORDER, "u": "case o_orderkey % 5 when 0 then concat('The table of sections for chapter ', cast(90 + o_orderkey % 28 as string), ' of title ', cast(1 + o_orderkey % 50 as string)) "
        "when 1 then 'The analysis for subchapter IV' when 2 then 'Subchapter II' when 3 then 'The Harbor Act of 1994' else 'Part B' end"},
        f"concat({NOISE}, u, ' is ', case when k % 2 = 0 then 'amended by striking ``x''''' else 'repealed' end, '.\n\nAnd more of it.')", _amendments("unit", "verb", "section"),
        "doc_id, u as unit, case when k % 2 = 0 then 'amended' else 'repealed' end as verb, '' as section",
    ),
    "amend_bounds": Recipe(
        "orders", ORDER, f"concat({NOISE}, 'That ', {LAW}, ' is amended by striking ', qo, old, qc, '.\n\nSection 9 of title 5, United States Code, is repealed. ', repeat('More words. ', 300))",
        _amendments("id", "start", "end"),
        f"doc_id, unnest(['a0', 'a1']) as id, unnest([length({NOISE}) + 5, length({NOISE}) + 5 + length({LAW}) + 24 + length(qo) + length(old) + length(qc) + 3])::bigint as start, "
        f"unnest([length({NOISE}) + 5 + length({LAW}) + 24 + length(qo) + length(old) + length(qc) + 3, length({NOISE}) + 5 + length({LAW}) + 24 + length(qo) + length(old) + length(qc) + 3 + 53 + 2500])::bigint as \"end\"",
    ),
    "amend_paths": Recipe(
        "orders", ORDER, f"concat({NOISE}, 'Subsection (h) of section ', s, p, ' of title ', t, ', United States Code, is repealed.')", _amendments("section", "subsection", "target.subsection as cited"),
        "doc_id, s as section, concat(p, '(h)') as subsection, p as cited",
    ),
    "amend_act_name": Recipe(
        "orders", ORDER, f"concat({NOISE}, 'Section ', s, ' of the ', initcap(new), ' Act of 1994 (', t, ' U.S.C. ', s, ') is repealed.')".replace("initcap(new)", "'Term', k"), _amendments("act_name"),
        "doc_id, concat('Term', k, ' Act of 1994') as act_name",
    ),
    "citation_amendments": Recipe(
        "orders", A, f"concat({HEAD}, '--\n  (1) in paragraph (7), by striking ', qo, old, qc, '.\n\nSee 9 U.S.C. 7; it stays. ', {LAW}, ' is repealed.')",
        lambda a, made: B.citation_amendments(a).select("doc_id", "start", "am_id"),
        "doc_id, unnest([strpos(text, concat('(', t, ' U.S.C.')), strpos(text, 'paragraph (7)') - 1, strpos(text, 'stays. ') + 6])::bigint as start, unnest(['a0', 'a0', 'a1']) as am_id",
    ),
    "uncovered_verbs": Recipe(
        "orders", ORDER, f"concat({NOISE}, 'A custom of the port is amended at will.\n\n', {LAW}, ' is repealed.')", lambda a, made: a.select("doc_id", "uncovered"), "doc_id, cast(1 as int) as uncovered",
    ),
    "bill_contents_guard": Recipe(
        "orders", ORDER, _BILL, lambda a, made: B.rows(made, "divisions").select("doc_id", "seq", "label", "heading", "rank"),
        "doc_id, unnest([0, 1, 2, 3]) as seq, unnest(['DIVISION A', 'TITLE II', 'TITLE III', 'Subtitle A']) as label, unnest([concat('GRAND ', upper(new)), concat('SHIPS OF THE ', upper(old)), 'SAILS', concat('Of ', new)]) as heading, unnest([0, 1, 1, 2]) as rank",
        depth=B.STRUCTURE,
    ),
    "bill_run_in_sections": Recipe(
        "orders", ORDER, _BILL,
        lambda a, made: B.rows(made, "sections").select("doc_id", "num", "heading", "run_in", F.array_join(F.transform("ancestors", lambda x: x["label"]), ">").alias("above"), (F.col("end") - F.col("start")).alias("chars")),
        "doc_id, unnest(['1', '102', '2']) as num, unnest(['SHORT TITLE; LONG NAMES', 'Strings of all kinds', 'SAILS']) as heading, unnest([false, true, false]) as run_in, "
        "unnest(['DIVISION A>TITLE II', 'DIVISION A>TITLE II', 'DIVISION A>TITLE III>Subtitle A']) as above, unnest([strpos(text, '  Sec. 102') - strpos(text, 'SEC. 1.'), strpos(text, 'TITLE III') - strpos(text, '  Sec. 102'), length(text) + 1 - strpos(text, 'SEC. 2.')])::bigint as chars",
        depth=B.STRUCTURE,
    ),
    "bill_meta": Recipe(
        "orders", ORDER, _BILL, lambda a, made: a.select("doc_id", "designation", "short_title", "congress"), "doc_id, concat('H. R. ', l) as designation, concat('Kite-', new, ' Act') as short_title, substr(c, greatest(1, length(c) - 2)) as congress",
        depth=B.STRUCTURE,
    ),
    "blocks_of_references": Recipe(
        "orders", ORDER, "concat('It reads:\n    ', qo, '(a) As paragraph (2) says of ', new, '\nand more.', qc, '\nAs clause (iii) says, it does.')",
        lambda a, made: B.rows(made, "citations").where("kind = 'internal'").select("doc_id", "ref_type", F.col("inserted.start").alias("block"), F.col("inserted.phrase").alias("phrase")),
        "doc_id, unnest(['paragraph', 'clause']) as ref_type, unnest([14, null])::bigint as block, unnest([false, null]) as phrase",
        depth=B.CITATIONS,
    ),
    "publaw_divisions": Recipe(
        "orders", ORDER, f"concat({NOISE}, 'Under subtitle C of title II of division B of Public Law ', c, '-', l, ', it is so.')",
        lambda a, made: B.rows(made, "citations").where("kind = 'publaw'").select("doc_id", "congress", "law", "division", F.array_join("where", "|").alias("where")),
        "doc_id, c as congress, l as law, 'B' as division, 'DIVISION B|TITLE II|SUBTITLE C' as \"where\"",
        depth=B.CITATIONS,
    ),
    "instruct_positions": Recipe(
        "orders", A, f"concat({HEAD}, '--\n  (1) in paragraph (2), by striking ', qo, old, qc, '; and\n  (2) by repeating ', qo, new, qc, ' as it stands in paragraph (3), and in the matter preceding subparagraph (B) of paragraph (5), by striking ', qo, new, qc, '.')",
        _nav("nav_kind", "path", "exact", where="true"),
        "doc_id, unnest(['step', 'step', 'ref']) as nav_kind, unnest(['(a)(2)', '(a)(5)', '(a)(3)']) as path, unnest([false, true, false]) as exact",
    ),
    "block_references": Recipe(
        "orders", A, f"concat({HEAD}, ' by adding at the end the following:\n    ', qo, '(3) As paragraph (2) and paragraph (4) of section 9 say of ', new, '.\n    (4) See paragraph (4).', qc, '.')",
        _nav("path", "unit", where="inserted"), "doc_id, '(a)(2)' as path, 'paragraph' as unit",
    ),
    "head_levels": Recipe(
        "orders", ORDER, "concat('Subsection (b) of section ', s, ' of the Harbor rules (', t, ' U.S.C. ', s, ') is amended--\n  (1) in paragraph (2), by striking ', qo, old, qc, '.')",
        lambda a, made: B.rows(made, "all_citations").where("relative").select("doc_id", "section", "subsection", "sub_from_head"), "doc_id, s as section, '(b)(2)' as subsection, '(b)' as sub_from_head",
    ),
    "whole_operations": Recipe(
        "orders", ORDER, f"concat({NOISE}, {LAW}, case when k % 2 = 0 then ' is repealed.' else ' is redesignated as section 77(c) of such title.' end)", _ops("type", "from_units", "to_units"),
        "doc_id, case when k % 2 = 0 then 'repeal' else 'redesignate' end as type, case when k % 2 = 1 then concat('Section ', s, p) end as from_units, case when k % 2 = 1 then 'section 77(c)' end as to_units",
    ),
    "added_levels": Recipe(
        "orders", A, f"concat({HEAD}, '--\n  (1) in paragraph (3)(C), by striking ', qo, old, qc, '; and\n  (2) by adding at the end the following:\n    ', qo, '(D) ', new, ' is added.', qc, '.')",
        _ops("type", "scope"), "doc_id, unnest(['strike', 'add-at-end']) as type, unnest(['(a)(3)(C)', '(a)(3)']) as scope",
    ),
    "replaced_levels": Recipe(
        "orders", A, f"concat({HEAD}, '--\n  (1) by amending paragraph (3) to read as follows:\n    ', qo, '(3) ', new, ' it is.', qc, '; and\n  (2) by striking paragraph (4) and inserting the following:\n    ', qo, '(4) ', old, ' it is.', qc, '.')",
        _ops("type", "text", "scope"), "doc_id, 'replace' as type, unnest([concat('(3) ', new, ' it is.'), concat('(4) ', old, ' it is.')]) as text, unnest(['(a)(3)', '(a)(4)']) as scope",
    ),
    "range_additions": Recipe(
        "orders", ORDER, "concat('The Harbor rules say so. Section 4 of the rules (', t, ' U.S.C. ', s, case when k % 2 = 0 then ' et seq.' else '' end, ') is amended by adding at the end the following:\n    ', qo, '(9) ', new, '.', qc, '.')",
        _ops("type", "range_end"), "doc_id, 'add-at-end' as type, k % 2 = 0 as range_end",
    ),
    "paragraph_instructions": Recipe(
        "orders", ORDER, f"concat('SEC. 1. KITES.\n\n', {LAW}, ' is amended by striking ', qo, old, qc, ' and by striking ', qo, new, qc, '.\n\n    (1) So it is.')",
        lambda a, made: views.amending_only(views.view(made).select("doc_id", F.inline("paragraphs"))).select("doc_id", "seq", "opens", "covered_by"),
        "doc_id, unnest([1, 2]) as seq, unnest(['a0', null]) as opens, 'a0' as covered_by",
    ),
    "operation_chips": Recipe(
        "orders", ORDER, f"concat({LAW}, ' is amended by striking ', qo, old, qc, ' and inserting ', qo, new, qc, ' and by striking ', qo, new, qc, '.')",
        lambda a, made: views.view(made).select("doc_id", F.inline("chips")).select("doc_id", "am_id", "type", "n"), "doc_id, 'a0' as am_id, unnest(['strike', 'insert']) as type, unnest([2, 1]) as n",
    ),
    "reference_fates": Recipe(
        "orders", ORDER,
        "concat('SEC. 1. FIRST.\n\n    (a) ', old, ' under paragraph (1) and paragraph (9).\n        (1) One.\n\n    ', qo, '(3) As paragraph (3), subsection (q), and subparagraph (X) say.\n    (A) ', new, '.', qc, '\n')",
        lambda a, made: M.internal_fates(B.rows(made, "located")), "doc_id, unnest(['inBill', 'unresolved', 'inBlock', 'headAbove', 'declined']) as fate, cast(1 as bigint) as n",
    ),
}


def queries() -> dict:
    return {n: r.query for n, r in RECIPES.items()}


def oracles() -> dict[str, str]:
    return {n: r.oracle for n, r in RECIPES.items()}
