"""Queries of the core operators on whole tables, with their SQL where SQL can say the same."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from lawloom.operators import compaction, orphans, shred
from lawloom.session import table

Query = Callable[[SparkSession, str], DataFrame]


def _orphans(spark: SparkSession, d: str) -> DataFrame:
    names = ("citation", "code_title", "code_section", "code_node", "cfr_section")
    return orphans.find_orphans(*(table(spark, d, n) for n in names))


def p1_found(spark: SparkSession, d: str) -> DataFrame:
    return _orphans(spark, d).select("doc_id", "cite_id", "ref_table", "period")


def p1_report(spark: SparkSession, d: str) -> DataFrame:
    return orphans.orphan_report(_orphans(spark, d))


def p2_found(spark: SparkSession, d: str) -> DataFrame:
    packed = compaction.pack_shards(table(spark, d, "shard_file"))
    return compaction.index_faults(packed, table(spark, d, "bundle_index"))


def p2_packed(spark: SparkSession, d: str) -> DataFrame:
    return compaction.pack_shards(table(spark, d, "shard_file")).select("grp", "stem", "content", "byte_length")


def p5_found(spark: SparkSession, d: str) -> DataFrame:
    return shred.provisions(table(spark, d, "shard_file"))


def p5_provisions(spark: SparkSession, d: str) -> DataFrame:
    return shred.shred_provisions(table(spark, d, "shard_file"), states=True).distinct()


def p5_entries(spark: SparkSession, d: str) -> DataFrame:
    return shred.shred_entries(table(spark, d, "shard_file")).distinct()


def p5_notes(spark: SparkSession, d: str) -> DataFrame:
    return shred.shred_notes(table(spark, d, "shard_file")).distinct()


QUERIES: dict[str, Query] = {
    "p1_found": p1_found,
    "p1_report": p1_report,
    "p2_found": p2_found,
    "p2_packed": p2_packed,
    "p5_found": p5_found,
    "p5_provisions": p5_provisions,
    "p5_entries": p5_entries,
    "p5_notes": p5_notes,
}

_WS = r"[\s\x{85}\x{A0}\x{1680}\x{2000}-\x{200B}\x{2028}\x{2029}\x{202F}\x{205F}\x{3000}\x{FEFF}]+"

_ORPHANS = f"""
with refs as (
  select distinct doc_id, cite_id, kind, regexp_replace(title, '{_WS}', '', 'g') title, regexp_replace(section, '{_WS}', '', 'g') section,
         coalesce(regexp_replace(subsection, '{_WS}', '', 'g'), '') subsection, cited_at
  from citation where kind in ('usc', 'cfr')
), r as (select *, regexp_replace(lower(section), '[^a-z0-9]', '_', 'g') slug from refs where title <> '' and section <> ''),
entry as (select title, slug, min(loaded_at) first_held from code_section group by all),
found as (
  select r.*, case
    when kind = 'usc' and not exists (select 1 from code_title t where t.title = r.title) then 'code_title'
    when kind = 'usc' and not exists (select 1 from code_section s where s.title = r.title and s.slug = r.slug
         and s.loaded_at <= r.cited_at and (s.removed_at is null or s.removed_at > r.cited_at)) then 'code_section'
    when kind = 'usc' and subsection <> '' and not exists (select 1 from code_node n where n.title = r.title and n.slug = r.slug
         and n.path = r.subsection) then 'code_node'
    when kind = 'cfr' and not exists (select 1 from cfr_section c where c.title = r.title and c.number = r.section
         and c.as_of <= strftime(r.cited_at, '%Y-%m-%d')) then 'cfr_section' end ref_table
  from r
), told as (
  select distinct f.doc_id, f.cite_id, f.ref_table, strftime(f.cited_at, '%Y-%m') period, case
    when ref_table in ('code_title', 'code_node') then 'missing'
    when ref_table = 'code_section' then case when e.first_held is null then 'missing' when e.first_held > f.cited_at then 'late' else 'deleted' end
    when exists (select 1 from cfr_section c where c.title = f.title and c.number = f.section) then 'late' else 'missing' end reason
  from found f left join entry e on e.title = f.title and e.slug = f.slug where ref_table is not null
)
"""

_RECORDS = """
with rec as (select grp, stem, arg_max(content, written_at) content, cast(strlen(arg_max(content, written_at)) as bigint) byte_length
  from shard_file group by all)
"""

# An object, a list of objects, or either in a string, as a list; what is neither holds nothing.
_LIST = """case json_type({0}) when 'ARRAY' then cast({0} as json[]) when 'OBJECT' then [{0}] when 'VARCHAR' then case when json_valid({0}->>'$') then
  case json_type(cast({0}->>'$' as json)) when 'ARRAY' then cast(cast({0}->>'$' as json) as json[]) when 'OBJECT' then [cast({0}->>'$' as json)] end end end"""
_ELEMENTS = f"coalesce({_LIST}, [])"
_OBJECTS = f"list_filter({_ELEMENTS}, lambda x: json_type(x) = 'OBJECT' and len(json_keys(x)) > 0)"
_FILES = f"""
with recursive f as (select distinct shard_id, cast(content as json) as j from shard_file where shard_id is not null and json_valid(content) and json_type(content) = 'OBJECT'),
g as (select shard_id, [j] || {_ELEMENTS.format("(j->'also')")} as es from f),
e as (select shard_id, unnest(range(len(es))) as entry, unnest(es) as j from g)
"""
_PROVISIONS = _FILES + f""", top as (select shard_id, entry, {_OBJECTS.format("(j->'tree')")} as kids from e where json_type(j) = 'OBJECT'),
n as (
  select shard_id, entry, [k] as place, x, coalesce(nullif(x->>'path', ''), coalesce(x->>'marker', '')) as path from (select shard_id, entry, unnest(range(len(kids))) as k, unnest(kids) as x from top)
  union all
  select shard_id, entry, place || [k], x, coalesce(nullif(x->>'path', ''), above || coalesce(x->>'marker', '')) from (
    select shard_id, entry, place, path as above, unnest(range(len(kids))) as k, unnest(kids) as x from (select *, {_OBJECTS.format("(x->'children')")} as kids from n))
), p as (select *, cast(row_number() over (partition by shard_id, entry order by place) - 1 as int) as ord from n),
q as (select p.shard_id, cast(p.entry as int) as entry, p.ord, coalesce(u.ord, -1) as parent_ord, p.path, p.x from p left join p u on u.shard_id = p.shard_id and u.entry = p.entry and u.place = p.place[:-2])
"""


def _said(x: str, names: dict[str, str]) -> str:
    """Fields as text; a list of texts is one, line by line."""
    line = "case json_type({0}->'{1}') when 'ARRAY' then array_to_string(list_filter(list_transform(cast({0}->'{1}' as json[]), lambda y: y->>'$'), lambda y: y is not null), chr(10)) else {0}->>'{1}' end as {2}"
    return ", ".join(line.format(x, f, n) for n, f in names.items())


ORACLES: dict[str, str] = {
    "p5_found": _PROVISIONS + "select distinct shard_id, entry, ord, parent_ord, path from q",
    "p5_provisions": _PROVISIONS + "select distinct shard_id, entry, ord, parent_ord, path, " + _said("x", {"marker": "marker", "heading": "heading", "text": "text"})
    + ", case when not list_contains(json_keys(x), 'path') then 'absent' when json_type(x->'path') = 'NULL' then 'null' else 'value' end as path_is from q",
    "p5_entries": _FILES + "select distinct shard_id, cast(entry as int) as entry, " + _said("j", shred.ENTRY) + " from e where json_type(j) = 'OBJECT'",
    "p5_notes": _FILES + f", t as (select shard_id, entry, {_OBJECTS.format("(j->'notes')")} as ns from e where json_type(j) = 'OBJECT'), u as (select shard_id, cast(entry as int) as entry, cast(unnest(range(len(ns))) as int) as note, unnest(ns) as x from t) "
    + "select distinct shard_id, entry, note, " + _said("x", shred.NOTE) + " from u",
    "p1_found": _ORPHANS + "select doc_id, cite_id, ref_table, period from told",
    "p1_report": _ORPHANS + "select ref_table, period, reason, count(*) orphans from told group by all",
    "p2_found": _RECORDS
    + """, e as (select grp, x.stem stem, x.byte_length said, x.part_no k, parts, part_bytes, x.byte_offset o
  from (select *, unnest(at_list) x from (select distinct on (idx_id) * from bundle_index))),
a as (select grp, stem, count(*) n, any_value(said) said,
  bool_and(coalesce(k >= 0 and k < len(parts) and o + said <= part_bytes[k + 1], false)) fits from e group by all),
f as (select coalesce(r.grp, a.grp) grp, coalesce(r.stem, a.stem) stem, case when r.grp is null then 'stray' when n is null then 'lost'
  when n > 1 then 'twice' when not fits or said <> byte_length then 'torn' end fault
  from rec r full join a on r.grp = a.grp and r.stem = a.stem)
select * from f where fault is not null""",
    "p2_packed": _RECORDS + "select * from rec",
}
