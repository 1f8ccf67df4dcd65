"""Queries of the text-corpus operators on whole tables, with their SQL where SQL can say the same."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from lawloom.llm import canonical, encode, leak, markup, subjects
from lawloom.session import table


def p3_found(spark: SparkSession, d: str) -> DataFrame:
    return markup.found_elements(table(spark, d, "files"))


def p3_clean(spark: SparkSession, d: str) -> DataFrame:
    return markup.clean_files(table(spark, d, "files"))


def p4_found(spark: SparkSession, d: str) -> DataFrame:
    return canonical.same_look_pairs(canonical.provision_rows(table(spark, d, "code_node"), table(spark, d, "cfr_section")))


def p4_groups(spark: SparkSession, d: str) -> DataFrame:
    return canonical.same_look_groups(canonical.provision_rows(table(spark, d, "code_node"), table(spark, d, "cfr_section")))


def p4_forms(spark: SparkSession, d: str) -> DataFrame:
    return canonical.canonical_texts(canonical.provision_rows(table(spark, d, "code_node"), table(spark, d, "cfr_section")))


def p6_ids(spark: SparkSession, d: str) -> DataFrame:
    return encode.encode_corpus(table(spark, d, "documents"))


def p6_decoded(spark: SparkSession, d: str) -> DataFrame:
    return encode.decode_corpus(p6_ids(spark, d))


def p7_found(spark: SparkSession, d: str) -> DataFrame:
    return leak.find_leaks(table(spark, d, "documents"), table(spark, d, "eval_item"))


def p7_paraphrases(spark: SparkSession, d: str) -> DataFrame:
    return leak.find_paraphrases(table(spark, d, "documents"), table(spark, d, "eval_item"))


def _rules(spark: SparkSession, d: str) -> subjects.Rules:
    return subjects.fit_rules(*(table(spark, d, n) for n in ("documents", "doc_label", "subject_area")))


def p8_found(spark: SparkSession, d: str) -> DataFrame:
    return subjects.find_subjects(table(spark, d, "documents"), _rules(spark, d))


def p8_composition(spark: SparkSession, d: str) -> DataFrame:
    return subjects.composition(p8_found(spark, d), table(spark, d, "documents"))


def p8_basis(spark: SparkSession, d: str) -> DataFrame:
    return subjects.basis_report(subjects.subjects_with_basis(table(spark, d, "documents"), _rules(spark, d)))


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    "p3_found": p3_found,
    "p3_clean": p3_clean,
    "p4_found": p4_found,
    "p4_groups": p4_groups,
    "p4_forms": p4_forms,
    "p6_ids": p6_ids,
    "p6_decoded": p6_decoded,
    "p7_found": p7_found,
    "p7_paraphrases": p7_paraphrases,
    "p8_found": p8_found,
    "p8_composition": p8_composition,
    "p8_basis": p8_basis,
}

def _form(x: str) -> str:
    """The canonical form as SQL can say it: characters one for one, those that become several or none, then composition. Enough for these tables."""
    import unicodedata

    one = {c: f for c, f in canonical._properties()[1].items() if len(f) == 1 and not 0xAC00 <= c < 0xD7A4}
    composed = {ord(unicodedata.normalize("NFC", chr(c) + m)): unicodedata.normalize("NFC", f + m) for c, f in one.items() for m in "\u0300\u0301\u0306\u0308" if len(unicodedata.normalize("NFC", chr(c) + m)) == len(unicodedata.normalize("NFC", f + m)) == 1}
    table = {**composed, **one}
    quoted = lambda t: "'" + t.replace("'", "''") + "'"
    out = f"translate({x}, {quoted(''.join(map(chr, table)))}, {quoted(''.join(table.values()))})"
    for c in "ﬀﬁﬂﬃﬄﬅﬆ":
        out = f"replace({out}, '{c}', '{canonical.fold_char(c)}')"
    gone = "".join(f"\\x{{{a:X}}}-\\x{{{b:X}}}" for a, b in canonical.NO_GLYPH)
    return f"nfc_normalize(regexp_replace({out}, '[{gone}]', '', 'g'))"


_FORMS = f"""
with r as (select distinct 'code_node' as src, node_id as id, [text] as parts from code_node where text <> '' union select distinct 'cfr_section', reg_id, paragraphs from cfr_section where len(paragraphs) > 0),
f as (select *, list_transform(parts, lambda x: {_form("x")}) as form from r where id is not null)
"""
_PAIRS = f"""{_FORMS}
select distinct a.src, least(a.id, b.id) as id_a, greatest(a.id, b.id) as id_b from f a join f b on a.src = b.src and a.form = b.form and a.id <> b.id and a.parts <> b.parts
"""
_RUNS = f"""
with w as (select doc_id, regexp_extract_all(lower({_form("text")}), '[\\p{{L}}\\p{{N}}]+') as ws from documents where text is not null and doc_id is not null),
v as (select item_id, regexp_extract_all(lower({_form("passage")}), '[\\p{{L}}\\p{{N}}]+') as ws from eval_item where passage is not null and item_id is not null),
g as (select distinct doc_id, hash(array_to_string(ws[i:i + {leak.RUN - 1}], ' ')) as h from (select *, unnest(range(1, len(ws) - {leak.RUN - 2})) as i from w)),
q as (select distinct item_id, hash(array_to_string(ws[i:i + {leak.RUN - 1}], ' ')) as h from (select *, unnest(range(1, len(ws) - {leak.RUN - 2})) as i from v))
select distinct doc_id, item_id from g join q using (h)
"""

ORACLES: dict[str, str] = {
    "p4_found": _PAIRS,
    "p4_forms": _FORMS + "select distinct src, id, array_to_string(form, chr(10)) as form from f",
    "p7_found": _RUNS,
    "p6_decoded": "select doc_id, coalesce(text, '') as text from documents",
}
