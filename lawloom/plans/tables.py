"""Queries over the tables of law, and over tables made from them by SQL that both engines read alike."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from lawloom.functions import scan
from lawloom.functions.citations import popular_names
from lawloom.functions import markers as mk
from lawloom.functions.text import act_slug, slug, squeeze_out, unify_newlines
from lawloom.operators import bills as B
from lawloom.operators import law, metrics, redline, views
from lawloom.session import table
from lawloom.sources import bills as bill_source
from lawloom.sources import codified, pdf, share

QUERIES: dict = {}
ORACLES: dict[str, str] = {}


def query(sql: str | None = None):
    def add(f):
        QUERIES[f.__name__] = f
        if sql:
            ORACLES[f.__name__] = sql
        return f

    return add


# --- lines and texts -------------------------------------------------------------------------------------------------------------


@query("""
with l as (select doc_id, unnest(string_split(text, chr(10))) as line, generate_subscripts(string_split(text, chr(10)), 1) - 1 as pos from (select distinct doc_id, text from documents) where text is not null)
select doc_id, cast(pos as int) as pos, cast(coalesce(sum(length(line) + 1) over (partition by doc_id order by pos rows between unbounded preceding and 1 preceding), 0) as bigint) as start, cast(length(line) as bigint) as len from l
""")
def bill_lines_offsets(spark: SparkSession, d: str) -> DataFrame:
    lines = table(spark, d, "documents").select("doc_id", "text").distinct().where("text is not null").select("doc_id", F.inline(scan.lines(F.col("text"))))
    return lines.select("doc_id", "pos", "start", F.length("line").cast("bigint").alias("len"))


@query("select file_id, length(replace(replace(text, chr(13) || chr(10), chr(10)), chr(13), chr(10))) as chars, md5(replace(replace(text, chr(13) || chr(10), chr(10)), chr(13), chr(10))) as digest from (select distinct file_id, text from files)")
def normalize_newlines(spark: SparkSession, d: str) -> DataFrame:
    text = unify_newlines(F.col("text"))
    return table(spark, d, "files").select("file_id", "text").distinct().select("file_id", F.length(text).cast("bigint").alias("chars"), F.md5(text).alias("digest"))


@query(r"""
with f as (select distinct file_id, text from files where text is not null),
p as (select file_id, case when regexp_matches(text, '(?is)<pre[^>]*>.*?</pre>') then regexp_extract(text, '(?is)<pre[^>]*>(.*?)</pre>', 1) else text end as t from f)
select file_id, md5(replace(replace(replace(replace(replace(replace(regexp_replace(t, '<[^>]+>', '', 'g'), '&lt;', '<'), '&gt;', '>'), '&quot;', '"'), '&#39;', ''''), '&nbsp;', ' '), '&amp;', '&')) as digest from p
""")
def unwrap_pages(spark: SparkSession, d: str) -> DataFrame:
    rows = table(spark, d, "files").select("file_id", "text").distinct().where("text is not null")
    return rows.select("file_id", F.md5(bill_source.unwrap_page(F.col("text"))).alias("digest"))


@query("select doc_id, true as same_raw, true as same_deflated from documents where text is not null")
def share_roundtrip(spark: SparkSession, d: str) -> DataFrame:
    rows = table(spark, d, "documents").where("text is not null").select("doc_id", "text")
    return rows.select(
        "doc_id", (share.decode_raw(share.encode_raw(F.col("text"))) == F.col("text")).alias("same_raw"),
        (share.decode_deflated(share.encode_deflated("text")) == F.col("text")).alias("same_deflated"),
    )


@query(r"""
with c as (select distinct doc_id, cite_id, regexp_replace(lower(section), '[^a-z0-9]', '_', 'g') as slug from citation where section is not null) select * from c
""")
def code_slug(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "citation").where("section is not null").select("doc_id", "cite_id", slug(F.col("section")).alias("slug")).distinct()


@query(r"select distinct act_name, regexp_replace(regexp_replace(lower(act_name), '[^a-z0-9]+', '_', 'g'), '^_|_$', '', 'g') as act_key from citation where act_name is not null")
def act_slugs(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "citation").where("act_name is not null").select("act_name", act_slug(F.col("act_name")).alias("act_key")).distinct()


@query(r"""
with p as (select distinct path, regexp_extract_all(path, '\([A-Za-z0-9]{1,8}\)') as ms from code_node where path is not null)
select path, array_to_string(list_transform(range(0, len(ms) + 1), lambda n: array_to_string(ms[1:n], '')), '|') as ladder,
  case when len(ms) > 0 then array_to_string(ms[1:len(ms) - 1], '') end as widened from p
""")
def subsection_ladder(spark: SparkSession, d: str) -> DataFrame:
    paths = table(spark, d, "code_node").where("path is not null").select("path").distinct()
    return paths.select("path", F.array_join(mk.path_ladder(F.col("path")), "|").alias("ladder"), mk.widened(F.col("path")).alias("widened"))


@query(r"""
select distinct marker, case when regexp_matches(marker, '^\(\d+\)$') then 1 when regexp_matches(marker, '^\([IVXLC]{2,}\)$') then 4 when regexp_matches(marker, '^\([ivxlc]{2,}\)$') then 3
  when regexp_matches(marker, '^\([a-z]{2}\)$') then 5 when regexp_matches(marker, '^\([A-Z]{2}\)$') then 6 when regexp_matches(marker, '^\([ivx]\)$') then 3
  when regexp_matches(marker, '^\([IVX]\)$') then 4 when regexp_matches(marker, '^\([a-z]\)$') then 0 else 2 end as depth from code_node where marker is not null
""")
def marker_depths(spark: SparkSession, d: str) -> DataFrame:
    rows = table(spark, d, "code_node").where("marker is not null").select("marker").distinct()
    return rows.select("marker", mk.marker_depth(F.col("marker")).alias("depth"))


# --- citations and the law -------------------------------------------------------------------------------------------------------


_SCANNED = (
    "select cast(o_orderkey as string) as doc_id, cast(1 + o_orderkey % 50 as string) as t, concat(cast(o_orderkey as string), case o_orderkey % 3 when 0 then '' when 1 then 'a' else 'K' end) as s, "
    "case o_orderkey % 4 when 0 then '' when 1 then '(a)' when 2 then '(a)(2)' else '(b)(1)(C)' end as p from orders"
)


@query(f"""with b as ({_SCANNED}) select doc_id, unnest([t, '9']) as title, unnest([s, '12']) as section, unnest([p, '']) as subsection,
  unnest([4, 4 + length(t) + 8 + length(s) + length(p) + 5])::bigint as start from b""")
def usc_scan(spark: SparkSession, d: str) -> DataFrame:
    """The same pattern without leaving the JVM."""
    rows = _sql(spark, d, _SCANNED, "orders").withColumn("text", F.expr("concat('See ', t, ' U.S.C. ', s, p, ' and 9 USC § 12.')"))
    found = scan.find_all(F.col("text"), *scan.CODE)
    return rows.select("doc_id", F.inline(found)).select("doc_id", "title", "section", "subsection", "start")


@query(r"""
with c as (select distinct doc_id, cite_id, title, regexp_replace(lower(section), '[^a-z0-9]', '_', 'g') as slug from citation where kind = 'usc' and title is not null and section is not null),
h as (select distinct title, slug from code_section)
select c.doc_id, c.title, count(*) as cites, count(h.slug) as held from c left join h on h.title = c.title and h.slug = c.slug group by all
""")
def title_hit_rate(spark: SparkSession, d: str) -> DataFrame:
    cites = table(spark, d, "citation").where("title is not null and section is not null").select("doc_id", "cite_id", "kind", "title", "section")
    return law.title_hits(cites.distinct(), table(spark, d, "code_section"))


@query("""
with c as (select congress, law, count(*) as cited from (select distinct doc_id, cite_id, congress, law from citation where kind = 'publaw') group by all)
select congress, law, cited, cast(row_number() over (order by cited desc, cast(congress as int), cast(law as int)) as int) as "rank" from c qualify "rank" <= 25
""")
def top_public_laws(spark: SparkSession, d: str) -> DataFrame:
    return metrics.most_cited_laws(table(spark, d, "citation").select("doc_id", "cite_id", "kind", "congress", "law").distinct())


_ORIGIN = r"""
with s as (select distinct title, section, source_credit, string_split(source_credit, ';')[1] as first from code_section where source_credit is not null),
e as (select *, nullif(regexp_replace(regexp_extract(first, '^\(\s*((?:[A-Z][a-z]{2,8}\.?\s+\d{1,2},\s+\d{4},\s+ch\.\s+\d+[A-Za-z]?)|(?:Pub\.\s*L\.\s*\d+[-–—]\d+))', 1), '\s+', ' ', 'g'), '') as enacted_as,
  regexp_extract(first, '§{1,2}\s*([0-9][0-9A-Za-z.\-–—]*)', 1) as n1, regexp_extract(first, '§{1,2}\s*[0-9][0-9A-Za-z.\-–—]*\[([0-9][0-9A-Za-z.\-–—]*)\]', 1) as n2,
  regexp_extract(first, '(?s)^(.*?)§{1,2}\s*[0-9]', 1) as head from s),
o as (select title, section, enacted_as, regexp_replace(regexp_replace(lower(enacted_as), '[^a-z0-9]+', '_', 'g'), '^_|_$', '', 'g') as act_key, coalesce(nullif(n2, ''), nullif(n1, '')) as act_section,
  case when not regexp_matches(head, '\bdiv\.?\s+[A-Z]{1,2}\b') then upper(nullif(regexp_extract(head, '(?i)\btitle\s+([IVXLCDM]+|[0-9]+[A-Z]?)\b', 1), '')) end as act_title
  from e where enacted_as is not null and (n1 <> '' or n2 <> '') and not regexp_matches(first, '§\s*[0-9][^,;]*\(part\)'))
"""


@query(_ORIGIN + """, g as (select act_key, act_section, min(enacted_as) as enacted_as, count(distinct title || ':' || section) as claims, min(title) as t, min(section) as s from o group by all)
select act_key, enacted_as, act_section, case when claims = 1 then t end as title, case when claims = 1 then s end as section, claims from g""")
def act_index_build(spark: SparkSession, d: str) -> DataFrame:
    return law.act_sections(law.section_origins(table(spark, d, "code_section")))


@query(_ORIGIN + "select act_key, act_section, count(distinct title || ':' || section) as claims from o group by all having claims > 1")
def act_index_conflicts(spark: SparkSession, d: str) -> DataFrame:
    return law.act_conflicts(law.section_origins(table(spark, d, "code_section")))


@query(_ORIGIN + r""", t as (select act_key, act_title, title, section, min(act_section) as act_section from o where act_title is not null group by all)
select act_key, act_title, cast(row_number() over (partition by act_key, act_title order by try_cast(regexp_extract(act_section, '^(\d+)', 1) as int) nulls last, regexp_extract(act_section, '^\d*(.*)$', 1), title, section) - 1 as int) as seq, title, section from t""")
def act_titles_index(spark: SparkSession, d: str) -> DataFrame:
    return law.act_titles(law.section_origins(table(spark, d, "code_section")))


@query(r"""
with s as (select distinct title, slug, entry, source_credit from code_section where source_credit is not null),
b as (select *, list_filter(list_transform(string_split(regexp_replace(regexp_replace(trim(source_credit), '^\(', ''), '\)$', ''), ';'), lambda x: trim(x)), lambda x: x <> '') as cl from s)
select title, slug, entry, nullif(regexp_extract(cl[1], '(Pub\. L\. \d+[–—-]\d+|[A-Z][a-z]{2,8}\.?\s+\d{1,2},\s+\d{4},\s+ch\.\s+\d+[A-Za-z]?)', 1), '') as enacted_by,
  coalesce(nullif(regexp_extract(cl[1], '§+\s*[0-9][0-9A-Za-z.\-–—]*\[([^\]]+)\]', 1), ''), nullif(regexp_extract(cl[1], '§+\s*([0-9][0-9A-Za-z.\-–—]*)', 1), '')) as act_section,
  cast(greatest(len(cl) - 1, 0) as bigint) as amendments from b
""")
def credit_summary(spark: SparkSession, d: str) -> DataFrame:
    parts = law.credit_summary(F.col("source_credit"))
    rows = table(spark, d, "code_section").where("source_credit is not null").select("title", "slug", "entry", "source_credit").distinct()
    return rows.select("title", "slug", "entry", parts["enacted_by"].alias("enacted_by"), parts["section"].alias("act_section"), parts["amendments"].alias("amendments"))


@query(r"""
with i as (select distinct a.identifier as identifier from (select unnest(ancestors) as a from code_section)),
g as (select identifier, regexp_extract(replace(replace(coalesce(identifier, ''), '–', '-'), '—', '-'), '^/us/usc/t([0-9]+[A-Za-z]?)$', 1) as t from i)
select identifier, case when t <> '' then 'https://www.law.cornell.edu/uscode/text/' || t end as link from g
""")
def crumb_links(spark: SparkSession, d: str) -> DataFrame:
    ids = table(spark, d, "code_section").select(F.explode("ancestors").alias("a")).select("a.identifier").distinct()
    return ids.select("identifier", law.crumb_link(F.col("identifier")).alias("link"))


@query(r"""
with c as (select distinct title, section from citation where kind = 'usc' and title is not null and section is not null)
select title, section, 'https://www.law.cornell.edu/uscode/text/' || title || '/' || section as lii, 'https://www.govinfo.gov/link/uscode/' || title || '/' || section as govinfo from c
""")
def external_links(spark: SparkSession, d: str) -> DataFrame:
    rows = table(spark, d, "citation").where("kind = 'usc' and title is not null and section is not null").select("title", "section").distinct()
    links = law.code_links(F.col("title"), F.col("section"))
    return rows.select("title", "section", links[0].alias("lii"), links[2].alias("govinfo"))


@query("""
with n as (select distinct unnest(notes).topic as topic from code_section)
select topic, case coalesce(trim(topic), '') when '' then 'Note' when 'note' then 'Note' when 'amendments' then 'Amendments' when 'effectiveDate' then 'Effective date' when 'shortTitle' then 'Short title'
  when 'codification' then 'Codification' when 'changeOfName' then 'Change of name' when 'editorialNotes' then 'Editorial note' when 'references' then 'References' when 'repeals' then 'Repeals'
  else upper(lower(regexp_replace(topic, '([a-z0-9])([A-Z])', '\\1 \\2', 'g'))[1]) || lower(regexp_replace(topic, '([a-z0-9])([A-Z])', '\\1 \\2', 'g'))[2:] end as label from n
""")
def note_topics(spark: SparkSession, d: str) -> DataFrame:
    topics = table(spark, d, "code_section").select(F.explode("notes").alias("n")).select("n.topic").distinct()
    return topics.select("topic", law.topic_label(F.col("topic")).alias("label"))


def _code_cites(spark: SparkSession, d: str) -> DataFrame:
    rows = table(spark, d, "citation").where("kind = 'usc' and title is not null and section is not null")
    tidy = rows.select(squeeze_out("title").alias("title"), squeeze_out("section").alias("section"), squeeze_out(F.coalesce("subsection", F.lit(""))).alias("subsection")).distinct()
    # which citations have their first level from an instruction's head alone is not recorded: those of sections of odd length stand for them
    return tidy.withColumns({"cite_key": F.concat_ws("|", "title", "section", "subsection"), "from_head": F.length("section") % 2 == 1})


@query(r"""
with raw as (select distinct regexp_replace(title, '\s+', '', 'g') as title, regexp_replace(section, '\s+', '', 'g') as section, regexp_replace(coalesce(subsection, ''), '\s+', '', 'g') as subsection
  from citation where kind = 'usc' and title is not null and section is not null),
c as (select *, title || '|' || section || '|' || subsection as cite_key, regexp_replace(lower(section), '[^a-z0-9]', '_', 'g') as slug from raw),
s as (select title, slug, count(distinct entry) as entries from code_section group by all)
select cite_key, case
  when s.slug is null and not exists (select 1 from code_title t where t.title = c.title) then 'title_absent'
  when s.slug is null then 'section_absent' else 'held' end as outcome, entries
from c left join s on s.title = c.title and s.slug = c.slug
""")
def usc_held(spark: SparkSession, d: str) -> DataFrame:
    out = law.resolve_code(_code_cites(spark, d), *(table(spark, d, n) for n in ("code_title", "code_section", "code_node")))
    held = F.when(F.col("outcome").isin("title_absent", "section_absent"), F.col("outcome")).otherwise("held")
    return out.select("cite_key", held.alias("outcome"), "entries")


@query(r"""
with raw as (select distinct regexp_replace(title, '\s+', '', 'g') as title, regexp_replace(section, '\s+', '', 'g') as section, regexp_replace(coalesce(subsection, ''), '\s+', '', 'g') as subsection
  from citation where kind = 'usc' and title is not null and section is not null),
c as (select *, title || '|' || section || '|' || subsection as cite_key, regexp_replace(lower(section), '[^a-z0-9]', '_', 'g') as slug, length(section) % 2 = 1 as from_head, regexp_extract_all(subsection, '\([A-Za-z0-9]{1,8}\)') as ms from raw),
s as (select title, slug, heading, coalesce(lead, '') as lead, notes, entries from (select *, count(distinct entry) over (partition by title, slug) as entries from (select *, count(distinct entry) over (partition by title, slug) as x from code_section)) qualify row_number() over (partition by title, slug order by entry) = 1),
n as (select distinct title, slug, path from code_node), b as (select distinct title, slug from code_node),
m as (select c.*, s.slug is not null as held, s.lead, s.heading, s.notes, s.entries, b.slug is not null as has_nodes from c left join s on s.title = c.title and s.slug = c.slug left join b on b.title = c.title and b.slug = c.slug),
t as (
  select cite_key, title, slug, 0 as rank, subsection as path, 'provision' as how, '' as dropped from m where held and subsection <> ''
  union all select cite_key, title, slug, d, array_to_string(ms[d + 1:], ''), 'run_in', array_to_string(ms[1:d], '') from (select *, unnest(range(1, greatest(len(ms), 1))) as d from m where held and subsection <> '')
    where len(list_filter(ms[1:d], lambda x: instr(lead, x) = 0)) = 0
  union all select cite_key, title, slug, 1000, array_to_string(ms[2:], ''), 'head_level', ms[1] from m
    where held and from_head and len(ms) >= 2 and not exists (select 1 from n where n.title = m.title and n.slug = m.slug and n.path = m.ms[1])),
f as (select t.* from t join n on n.title = t.title and n.slug = t.slug and n.path = t.path qualify row_number() over (partition by cite_key order by rank) = 1),
h as (select m.*, coalesce(heading, '') || chr(10) || array_to_string(list_transform(coalesce(notes, []), lambda x: coalesce(x.text, '')), chr(10)) as hay, not has_nodes and trim(lead) = '' as empty from m),
v as (select *, case when empty then coalesce(
  nullif(regexp_replace(regexp_extract(hay, '(?i)\beditorially\s+reclassified\s+as\s+(?:section|chapter)\s+([0-9]+[A-Za-z0-9–\-]*)\s+of\s+Title\s+([0-9]+[A-Z]?)', 2) || ':' || regexp_extract(hay, '(?i)\beditorially\s+reclassified\s+as\s+(?:section|chapter)\s+([0-9]+[A-Za-z0-9–\-]*)\s+of\s+Title\s+([0-9]+[A-Z]?)', 1), '–', '-'), ':'),
  nullif(case when regexp_matches(hay, '(?i)\btransferred\s+to\s+section\s+([0-9]+[A-Za-z0-9–\-]*)\s+of\s+(?:this\s+title|Title\s+[0-9]+[A-Z]?)') then
    coalesce(nullif(regexp_extract(hay, '(?i)\btransferred\s+to\s+section\s+[0-9]+[A-Za-z0-9–\-]*\s+of\s+Title\s+([0-9]+[A-Z]?)', 1), ''), title) || ':' || regexp_extract(hay, '(?i)\btransferred\s+to\s+section\s+([0-9]+[A-Za-z0-9–\-]*)', 1) end, ':')) end as moved_to from h)
select v.cite_key, case when not held and not exists (select 1 from code_title x where x.title = v.title) then 'title_absent' when not held then 'section_absent' when empty and moved_to is not null then 'moved' when empty then 'stub'
  when subsection = '' then 'section' when f.how is not null then f.how else 'focus_missing' end as outcome, f.path as focus_path, f.dropped as dropped, moved_to, entries
from v left join f on f.cite_key = v.cite_key
""")
def usc_outcomes(spark: SparkSession, d: str) -> DataFrame:
    return law.resolve_code(_code_cites(spark, d), *(table(spark, d, n) for n in ("code_title", "code_section", "code_node")))


@query("""
with n as (select distinct title, slug, entry, ord, trim(concat_ws(' ', coalesce(marker, ''), coalesce(text, ''))) as line from code_node)
select title, slug, entry, md5(string_agg(line, chr(10) order by ord, line)) as digest from n group by all
""")
def flatten_text(spark: SparkSession, d: str) -> DataFrame:
    return law.flat_text(table(spark, d, "code_node")).select("title", "slug", "entry", F.md5("text").alias("digest"))


_WANTED = "select distinct cast(node_id as string) as cite_key, title, slug, entry, path from code_node where path is not null"


def _wanted(spark: SparkSession, d: str) -> DataFrame:
    rows = table(spark, d, "code_node").where("path is not null")
    return rows.select(F.col("node_id").cast("string").alias("cite_key"), "title", "slug", "entry", "path").distinct()


@query(rf"""
with w as ({_WANTED}), m as (select *, regexp_extract_all(path, '\([A-Za-z0-9]{{1,8}}\)') as ms from w),
x as (select *, unnest(range(1, len(ms) + 1)) as k from m), y as (select cite_key, title, slug, entry, k - 1 as step, array_to_string(ms[1:k], '') as prefix from x),
f as (select title, slug, entry, path, min(ord) as ord from code_node group by all),
j as (select y.*, f.ord from y left join f on f.title = y.title and f.slug = y.slug and f.entry = y.entry and f.path = y.prefix)
select cite_key, cast(step as int) as step, prefix as path, ord from j qualify bool_and(ord is not null) over (partition by cite_key order by step)
""")
def ancestor_chain(spark: SparkSession, d: str) -> DataFrame:
    return law.ancestor_chain(_wanted(spark, d), table(spark, d, "code_node"))


@query(rf"""
with w as ({_WANTED}), m as (select *, regexp_extract_all(path, '\([A-Za-z0-9]{{1,8}}\)') as ms from w), k as (select *, array_to_string(ms[1:len(ms) - 1], '') as parent from m),
n as (select title, slug, entry, path as node, length(trim(concat_ws(' ', coalesce(marker, ''), coalesce(text, '')))) as chars from (select distinct on (node_id) * from code_node) where path is not null),
s as (select k.cite_key, k.path, k.parent, coalesce(sum(chars), 0) as chars from k left join n on n.title = k.title and n.slug = k.slug and n.entry = k.entry and starts_with(n.node, k.parent) group by all)
select cite_key, case when chars > 6000 then path else parent end as scope from s
""")
def default_scope(spark: SparkSession, d: str) -> DataFrame:
    return law.default_scope(_wanted(spark, d), table(spark, d, "code_node").dropDuplicates(["node_id"]))


@query("""
with w as (select distinct doc_id || ':' || cite_id as key, title, section as number, strftime(cited_at, '%Y-%m-%d') as day from citation where kind = 'cfr' and title is not null and section is not null)
select key, max(as_of) as as_of from w join cfr_section c using (title, number) where as_of <= day group by key
""")
def issue_in_force(spark: SparkSession, d: str) -> DataFrame:
    rows = table(spark, d, "citation").where("kind = 'cfr' and title is not null and section is not null")
    wanted = rows.select(F.concat_ws(":", "doc_id", "cite_id").alias("key"), "title", F.col("section").alias("number"), F.date_format("cited_at", "yyyy-MM-dd").alias("day")).distinct()
    return codified.issue_at(table(spark, d, "cfr_section"), wanted).select("key", "as_of")


@query(rf"""
with w as (select *, array_to_string(ms[1:len(ms) - 1], '') as scope from (select *, regexp_extract_all(path, '\([A-Za-z0-9]{{1,8}}\)') as ms from ({_WANTED}))),
n as (select distinct title, slug, entry, ord, path from code_node where path is not null),
v as (select cite_key, n.ord, n.path as node, case when n.path <> w.path and w.path <> '' and n.path <> '' and starts_with(w.path, n.path) then 'on_path' when n.path = w.path then 'focus'
  when not starts_with(n.path, scope) or n.path = '' then null when w.path = '' or starts_with(n.path, w.path) then 'under' else 'dimmed' end as how
  from w join n on n.title = w.title and n.slug = w.slug and n.entry = w.entry)
select * from v where how is not null
""")
def provision_view(spark: SparkSession, d: str) -> DataFrame:
    return law.provision_view(_wanted(spark, d), table(spark, d, "code_node").select("title", "slug", "entry", "ord", "path").distinct())


_LAWS = (
    "select '117-' || cast(p_partkey % 40 as string) as law_id, cast(p_partkey % 300 as string) as number, cast(p_partkey as int) as entry, "
    "'DIVISION ' || chr(cast(65 + p_partkey % 5 as int)) || '—Harbor ' || p_brand || ' Renewal Act' as d1, 'TITLE ' || case p_partkey % 3 when 0 then 'I' when 1 then 'II' else 'V' end || '—' || p_type as d2 from part"
)
def _names_sql() -> str:
    quoted = lambda x: "'" + x.replace("'", "''") + "'"
    return ", ".join(f"({quoted(a.name)}, {quoted(a.title)}, {quoted(a.section)}, {quoted(a.range)}, {quoted(a.enacted_as)})" for a in popular_names())


#: What a citation asks for beyond the columns of its table, made from the lengths of its keys.
_ASKED = {
    "act_section": "case when kind = 'act' then section when kind = 'publaw' and n % 2 = 0 then law end",
    "act_title": "case when kind = 'act' and section is null then 'I' end",
    "division": "case when kind in ('act', 'publaw') and n % 5 = 0 then chr(cast(65 + n % 7 as int)) end",
    "short_title": "case when kind = 'publaw' and n % 4 = 1 then 'CLEAN AIR ACT' end",
}


def _dispatch_sql() -> str:
    asked = ", ".join(f"{e} as {n}" for n, e in _ASKED.items())
    return _ORIGIN + rf""", laws as ({_LAWS}),
c as (select distinct doc_id, cite_id, kind, title, section, act_name, congress, law, length(cite_id) + length(doc_id) as n from citation),
i as (select *, concat_ws('|', doc_id, cite_id) as cite_key, {asked} from c),
names(act_name, head_title, head_section, act_range, act_enacted) as (values {_names_sql()}),
j as (select i.*, m.head_title, m.head_section, s.head_title as short_no, s.head_section as short_section, case when kind = 'publaw' then 'Pub. L. ' || congress || '-' || law else m.act_enacted end as enacted,
  case when kind = 'publaw' then congress || '-' || law else nullif(regexp_replace(regexp_extract(concat_ws(' ', m.act_enacted, m.act_range), 'Pub\. L\. (\d{{1,3}}[–—-]\d{{1,4}})', 1), '[–—-]', '-'), '') end as law_id,
  case when division is not null and act_section is null then 'DIVISION ' || division end as unit
  from i left join names m on m.act_name = i.act_name left join names s on lower(s.act_name) = lower(i.short_title)),
k as (select *, regexp_replace(regexp_replace(lower(enacted), '[^a-z0-9]+', '_', 'g'), '^_|_$', '', 'g') as act_key from j),
known as (select act_key, act_section, min(title) as to_title, min(section) as to_section from o group by all having count(distinct title || ':' || section) = 1 and min(title) is not null),
t as (select act_key, act_title, title, section, min(act_section) as act_section from o where act_title is not null group by all),
opened as (select act_key, act_title, title as open_title, section as open_section from t qualify row_number() over (partition by act_key, act_title order by try_cast(regexp_extract(act_section, '^(\d+)', 1) as int) nulls last, regexp_extract(act_section, '^\d*(.*)$', 1), title, section) = 1),
units as (select distinct law_id, upper(trim(split_part(d1, '—', 1))) as unit from laws), held as (select distinct law_id, number from laws),
credits as (select title, slug, source_credit from code_section qualify row_number() over (partition by title, slug order by entry) = 1),
r as (select k.*, known.to_title, known.to_section, opened.open_title, opened.open_section, units.unit is not null as unit_held, held.number is not null as text_held, credits.title is not null as has_credit, known.to_section is not null as has_slug,
  regexp_extract(regexp_replace(string_split(regexp_replace(coalesce(credits.source_credit, ''), '^\s*\(', ''), ';')[1], ',\s*as\s+(?:added|amended|renumbered).*$', ''), 'div\.?\s+([A-Z]{{1,2}})', 1) as named
  from k left join known on known.act_key = k.act_key and known.act_section = k.act_section left join opened on opened.act_key = k.act_key and opened.act_title = k.act_title left join units on units.law_id = k.law_id and units.unit = k.unit
  left join held on held.law_id = k.law_id and held.number = k.act_section left join credits on credits.title = known.to_title and credits.slug = regexp_replace(lower(known.to_section), '[^a-z0-9]', '_', 'g')),
w as (select *, case when kind = 'usc' then 'code' when kind = 'cfr' then 'regulation' when kind in ('act', 'publaw') and unit_held then 'law_division' when kind = 'act' and open_title is not null and act_section is null then 'act_title'
  when to_title is not null and (kind = 'act' or (kind = 'publaw' and has_slug and (named = '' or coalesce(division = named, false)))) then 'act_section' when kind in ('act', 'publaw') and text_held then 'law_text'
  when kind = 'act' and head_title is not null then 'act_head' when kind = 'publaw' and short_no is not null then 'act_head' when kind in ('publaw', 'stat') then 'outside' when kind = 'internal' then 'internal' else 'unknown' end as source from r)
select cite_key, source, case when source in ('code', 'regulation') then title when source = 'act_section' then to_title when source = 'act_title' then open_title when source = 'act_head' then coalesce(head_title, short_no) end as to_title,
  case when source in ('code', 'regulation') then section when source = 'act_section' then to_section when source = 'act_title' then open_section when source = 'act_head' then coalesce(head_section, short_section) end as to_section,
  case when source in ('law_division', 'law_text', 'outside') then law_id end as law_id from w"""


@query(_dispatch_sql())
def citation_dispatch(spark: SparkSession, d: str) -> DataFrame:
    cites = table(spark, d, "citation").select("doc_id", "cite_id", "kind", "title", "section", "act_name", "congress", "law").distinct()
    rows = cites.withColumns({"cite_key": F.concat_ws("|", "doc_id", "cite_id"), "n": F.length("cite_id") + F.length("doc_id")})
    rows = rows.withColumns({n: F.expr(e) for n, e in _ASKED.items()}).withColumn("where", F.when(F.col("n") % 2 == 0, F.array(F.concat(F.lit("DIVISION "), "division")))).drop("n")
    origins = law.section_origins(table(spark, d, "code_section"))
    laws = _laws(spark, d)
    toc = laws.select("law_id", F.col("ancestors").alias("where_path"))
    return law.dispatch(rows, law.popular_name_table(spark), law.act_sections(origins), law.act_titles(origins), table(spark, d, "code_section"), laws, toc)


_ASKS = (
    "select cast(s_suppkey as string) as cite_key, '117-' || cast(s_suppkey % 40 as string) as law_id, cast(s_suppkey % 300 as string) as number, "
    "'DIVISION ' || chr(cast(65 + s_suppkey % 7 as int)) as w1, 'TITLE V' as w2, s_suppkey % 2 as deep from supplier"
)


def _sql(spark: SparkSession, d: str, sql: str, *names: str) -> DataFrame:
    return spark.sql(sql.replace(f"from {names[0]}", f"from {{{names[0]}}}"), **{n: table(spark, d, n) for n in names})


def _laws(spark: SparkSession, d: str) -> DataFrame:
    return _sql(spark, d, _LAWS, "part").withColumn("ancestors", F.array("d1", "d2"))


def _asks(spark: SparkSession, d: str) -> DataFrame:
    asks = _sql(spark, d, _ASKS, "supplier")
    return asks.withColumns({"where_path": F.when(F.col("deep") == 1, F.array("w1", "w2")).otherwise(F.array("w1")), "short_title": F.lit(None).cast("string")})


@query(f"""
with e as ({_LAWS}), a as ({_ASKS}), r as (select a.cite_key, e.*, split_part(d1, '—', 1) = w1 and (deep = 0 or split_part(d2, '—', 1) = w2) as hit from a join e on e.law_id = a.law_id and e.number = a.number),
c as (select *, count(*) over (partition by cite_key) as n, sum(hit::int) over (partition by cite_key) as h from r)
select cite_key, law_id, number, entry, n as "of", case when h > 0 and h < n then 'path' end as narrowed_by from c where h = 0 or h = n or hit
""")
def plaw_section_narrow(spark: SparkSession, d: str) -> DataFrame:
    return law.narrow_law_sections(_asks(spark, d), _laws(spark, d))


@query(f"""
with e as ({_LAWS}), a as ({_ASKS}), r as (select a.cite_key, e.law_id, e.number as num, e.entry as seq, deep = 1 and split_part(d2, '—', 1) = w2 as two, deep from a join e on e.law_id = a.law_id and split_part(d1, '—', 1) = w1),
b as (select *, max(two::int) over (partition by cite_key) as best from r)
select cite_key, law_id, num, cast(row_number() over (partition by cite_key order by seq) as int) as "rank", count(*) over (partition by cite_key) as total, cast(deep - best as int) as dropped_levels
from b where two::int = best qualify "rank" <= 20
""")
def plaw_division_shorten(spark: SparkSession, d: str) -> DataFrame:
    toc = _laws(spark, d).select("law_id", F.col("number").alias("num"), F.col("entry").alias("seq"), F.col("ancestors").alias("where_path"))
    return law.law_division(_asks(spark, d), toc)


# --- bills made of many lines ----------------------------------------------------------------------------------------------------

_LINES = (
    "select cast(l_orderkey as string) as doc_id, l_linenumber as n, concat('SEC. ', cast(l_linenumber as string), '. CARGO ', cast(l_partkey as string), '.') as head, "
    "concat('    See ', cast(1 + l_suppkey % 50 as string), ' U.S.C. ', cast(l_partkey as string), '.') as body from lineitem"
)


def _many(spark: SparkSession, d: str) -> DataFrame:
    lines = _sql(spark, d, _LINES, "lineitem")
    made = lines.groupBy("doc_id").agg(F.sort_array(F.collect_list(F.struct("n", "head", "body"))).alias("x"))
    return made.select("doc_id", F.concat(F.lit("TITLE I--SHIPS\n\n"), F.array_join(F.transform("x", lambda r: F.concat_ws("\n\n", r["head"], r["body"])), "\n\n")).alias("text"))


_OFFSETS = f"""
with l as ({_LINES}), o as (select *, 16 + coalesce(sum(length(head) + length(body) + 4) over (partition by doc_id order by n, head, body rows between unbounded preceding and 1 preceding), 0) as place,
  cast(row_number() over (partition by doc_id order by n, head, body) - 1 as int) as seq, count(*) over (partition by doc_id) as many from l)
"""


@query(_OFFSETS + """select doc_id, seq, cast(n as string) as num, regexp_extract(head, '(CARGO [0-9]+)', 1) as heading, 'TITLE I—SHIPS' as division, cast(place as bigint) as start,
  cast(place + length(head) + length(body) + case when seq + 1 < many then 4 else 2 end as bigint) as "end" from o""")
def bill_sections(spark: SparkSession, d: str) -> DataFrame:
    return B.rows(_many(spark, d), "sections").select("doc_id", "seq", "num", "heading", "division", "start", "end")


@query("select distinct cast(l_orderkey as string) as doc_id, 'TITLE I' as label, 'SHIPS' as heading, cast(0 as bigint) as start from lineitem")
def bill_divisions(spark: SparkSession, d: str) -> DataFrame:
    return B.rows(_many(spark, d), "divisions").select("doc_id", "label", "heading", "start")


@query(_OFFSETS + """select doc_id, cast(seq as int) as cite_seq, cast(n as string) as section, cast(place + length(head) + 10 as bigint) as start from o""")
def section_of_offset(spark: SparkSession, d: str) -> DataFrame:
    a = B.analyse(_many(spark, d), B.CITATIONS)
    inside = lambda s: (s["start"] <= F.col("start")) & (F.col("start") < s["end"])
    cites = a.select("doc_id", "sections", F.inline("citations"))
    return cites.select("doc_id", F.substring("id", 2, 9).cast("int").alias("cite_seq"), F.filter("sections", inside)[0]["num"].alias("section"), "start")


@query("select cast(l_orderkey as string) as doc_id, count(*) as cites, count(distinct 1 + l_suppkey % 50) as titles from lineitem group by 1")
def kind_counts_per_bill(spark: SparkSession, d: str) -> DataFrame:
    cites = B.rows(_many(spark, d), "citations").where("kind = 'usc'")
    return cites.groupBy("doc_id").agg(F.count("*").alias("cites"), F.count_distinct("title").alias("titles"))


@query("""
with m as (select cast(l_orderkey as string) as doc_id, unnest(['lines', 'parts']) as metric, unnest([count(*), count(distinct l_partkey)]) as v from lineitem group by l_orderkey),
b as (select doc_id, metric, case when cast(doc_id as bigint) % 7 = 0 then v + 1 else v end as v from m where not (cast(doc_id as bigint) % 11 = 0 and metric = 'parts'))
select coalesce(m.doc_id, b.doc_id) as doc_id, coalesce(m.metric, b.metric) as metric, b.v as before, m.v as now from m full join b on m.doc_id = b.doc_id and m.metric = b.metric where m.v is distinct from b.v
""")
def metrics_baseline_diff(spark: SparkSession, d: str) -> DataFrame:
    n = table(spark, d, "lineitem").groupBy(F.col("l_orderkey").cast("string").alias("doc_id")).agg(F.count("*").alias("lines"), F.count_distinct("l_partkey").alias("parts"))
    now = n.unpivot("doc_id", ["lines", "parts"], "metric", "value")
    k = F.col("doc_id").cast("bigint")
    before = now.where(~((k % 11 == 0) & (F.col("metric") == "parts"))).withColumn("value", F.when(k % 7 == 0, F.col("value") + 1).otherwise(F.col("value")))
    return metrics.metric_changes(now, before)


@query(_OFFSETS + """select doc_id, cast(2 * seq + 1 as int) as seq, cast(place as bigint) as start, cast(n as string) as section, 'section' as kind from o
union all select doc_id, cast(2 * seq + 2 as int), cast(place + length(head) + 2 as bigint), null, 'text' from o union all select distinct doc_id, cast(0 as int), cast(0 as bigint), null, 'division' from o""")
def paragraph_rows(spark: SparkSession, d: str) -> DataFrame:
    v = views.view(_many(spark, d))
    return v.select("doc_id", F.inline("paragraphs")).select("doc_id", "seq", "start", "section", "kind")


@query(_OFFSETS + """select doc_id, cast(2 * seq + 2 as int) as paragraph, cast(place + length(head) + 10 as bigint) as start, 'c' || seq as cite_id from o""")
def paragraph_chips(spark: SparkSession, d: str) -> DataFrame:
    v = views.view(_many(spark, d))
    return v.select("doc_id", F.inline("tiles")).where("cite_id is not null").select("doc_id", "paragraph", "start", "cite_id")


@query("select cast(l_orderkey as string) as doc_id, 'TITLE I—SHIPS' as chain, count(*) as sections from lineitem group by 1")
def jump_groups(spark: SparkSession, d: str) -> DataFrame:
    found = views.jump_groups(B.rows(_many(spark, d), "sections"))
    return found.select("doc_id", "chain", "sections")


# --- redlines --------------------------------------------------------------------------------------------------------------------

_PARTS = "select cast(p_partkey as string) as k, p_name as old, p_brand as new, p_partkey % 3 as way, p_type as kind from part"
_OPS = "array<struct<am_id:string,op_seq:int,type:string,text:string,start:bigint,operand:string,all:boolean,at_end:boolean,replaces:bigint,relation:string,anchor:string,placement:string,scope:string,scope_from_head:boolean,exact:boolean,range_end:boolean,new_section:boolean>>"


def _drawn(spark: SparkSession, d: str) -> DataFrame:
    p = _sql(spark, d, _PARTS, "part")
    section = p.select(F.lit("1").alias("title"), F.col("k").alias("slug"), F.lit(0).alias("entry"), F.lit("").alias("lead"))
    law_text = F.when(F.col("way") == 2, F.concat(F.lit("The item zq"), F.col("k"), F.lit(" is free."))).otherwise(F.concat(F.lit("The item zq"), F.col("k"), F.lit(" and the like are free.")))
    node = p.select(F.lit("1").alias("title"), F.col("k").alias("slug"), F.lit(0).alias("entry"), F.lit(0).alias("ord"), F.lit("(a)").alias("path"), F.lit("").alias("parent_path"), F.lit("(a)").alias("marker"), F.lit("").alias("heading"), law_text.alias("text"))
    op = lambda seq, kind, text, start, replaces: F.struct(
        F.lit("a0").alias("am_id"), F.lit(seq).alias("op_seq"), F.lit(kind).alias("type"), text.alias("text"), F.lit(start).cast("bigint").alias("start"), F.lit(None).cast("string").alias("operand"),
        F.lit(False).alias("all"), F.lit(False).alias("at_end"), F.lit(replaces).cast("bigint").alias("replaces"), F.lit(None).cast("string").alias("relation"), F.lit(None).cast("string").alias("anchor"),
        F.lit(None).cast("string").alias("placement"), F.when(F.col("way") == 1, "(a)(9)").otherwise("(a)").alias("scope"), F.lit(False).alias("scope_from_head"), F.lit(False).alias("exact"),
        F.lit(False).alias("range_end"), F.lit(False).alias("new_section"),
    )
    struck = F.when(F.col("way") == 2, F.lit("and the like are")).otherwise(F.concat(F.lit("zq"), F.col("k")))
    ops = F.array(op(0, "strike", struck, 10, None), op(1, "insert", F.concat(F.lit("xq"), F.col("k")), 20, 10)).cast(_OPS)
    ams = p.select(F.col("k").alias("doc_id"), F.lit("a0").alias("am_id"), F.lit("1").alias("title"), F.col("k").alias("slug"), ops.alias("ops"))
    return redline.draw_ops(ams, section, node)


@query(f"""
with p as ({_PARTS}) select k as doc_id, 'a0' as am_id, '1' as title, k as slug, cast(s.i as int) as seg_seq, '(a)' as path, s.kind as kind, s.text as text from p, lateral (
  select unnest([0, 1, 2, 3]) as i, unnest(['keep', 'del', 'ins', 'keep']) as kind, unnest(['The item ', 'zq' || k, 'xq' || k, ' and the like are free.']) as text where way < 2
  union all select 0, 'keep', 'The item zq' || k || ' is free.' where way = 2) s
""")
def redline_segments(spark: SparkSession, d: str) -> DataFrame:
    return redline.segments(_drawn(spark, d))


@query(f"""
with p as ({_PARTS}) select k as doc_id, 'a0' as am_id, '1' as title, k as slug, unnest([0, 1]) as op_seq, unnest(['strike', 'insert']) as type,
  unnest(case when way = 2 then ['withheld', 'withheld'] else ['drawn', 'drawn'] end) as outcome, '(a)' as scope, case when way = 1 then '(a)(9)' end as widened from p
""")
def redline_outcomes(spark: SparkSession, d: str) -> DataFrame:
    return redline.outcomes(_drawn(spark, d))


@query(f"""
with p as ({_PARTS}), o as (select k as doc_id, unnest(['strike', 'insert']) as type, case when way = 2 then 'withheld' else 'drawn' end as outcome from p)
select doc_id, type, outcome, count(*) as ops from o group by rollup (type, outcome, doc_id) having outcome is not null
""")
def coverage_rollup(spark: SparkSession, d: str) -> DataFrame:
    return redline.coverage(redline.outcomes(_drawn(spark, d)))


# --- glyphs ----------------------------------------------------------------------------------------------------------------------

_GLYPHS = "select cast(l_orderkey as string) as doc_id, l_linenumber as n, concat('part', cast(l_partkey as string)) as word, concat('supp', cast(l_suppkey as string)) as more from lineitem"


@query(f"""
with g as ({_GLYPHS}), o as (select distinct doc_id, n, first_value(word) over w as word, first_value(more) over w as more from g window w as (partition by doc_id, n order by word, more))
select doc_id, cast(1 as int) as page, string_agg(word || ' ' || more, chr(10) order by n) as text from o group by doc_id
""")
def pdf_rows(spark: SparkSession, d: str) -> DataFrame:
    # Lines meet by document, so that its pages need no second shuffle.
    g = _sql(spark, d, _GLYPHS, "lineitem").repartition("doc_id").groupBy("doc_id", "n").agg(F.min(F.struct("word", "more")).alias("w"))
    y = (F.lit(700.0) - F.col("n") * 12).alias("y")
    cells = F.array(F.struct(F.lit(60.0).alias("x"), F.col("w.word").alias("s")), F.struct(F.lit(300.5).alias("x"), F.col("w.more").alias("s")))
    runs = g.select("doc_id", "n", y, F.posexplode(cells).alias("i", "c")).select(
        "doc_id", F.lit(1).alias("page"), (F.col("n") * 10 + F.col("i")).alias("ord"), F.col("c.x").alias("x"), (F.col("y") + F.col("i") * 0.5).alias("y"), F.lit(20.0).alias("width"),
        F.lit(600.0).alias("page_width"), F.col("c.s").alias("str"),
    )
    return pdf.page_texts(runs)


@query("""
select cast(s_suppkey as string) as doc_id, cast(0 as int) as page, cast(unnest([1, 2]) as bigint) as island, unnest(['cargo' || 'es of ' || s_name, 'Next line']) as line from supplier
""")
def dehyphenate(spark: SparkSession, d: str) -> DataFrame:
    rows = table(spark, d, "supplier").select(F.col("s_suppkey").cast("string").alias("doc_id"), F.posexplode(F.array(F.lit("cargo-"), F.concat(F.lit("es of "), "s_name"), F.lit("Next line"))).alias("pos", "line"))
    return pdf.rejoin_lines(rows.withColumn("page", F.lit(0))).select("doc_id", "page", "island", "line")


@query(f"""
with g as ({_GLYPHS}), o as (select distinct doc_id, n, min(word) over (partition by doc_id, n) as word from g), m as (select doc_id, word, row_number() over (partition by doc_id order by o.n) as n, count(*) over (partition by doc_id) as many from o)
select doc_id, string_agg(case when many >= 4 then word else n || ' ' || word end, chr(10) order by n) as text from m group by doc_id
""")
def pdf_gutter(spark: SparkSession, d: str) -> DataFrame:
    """Line numbers in the margin go where at least four of them count up."""
    g = _sql(spark, d, _GLYPHS, "lineitem").groupBy("doc_id", "n").agg(F.min("word").alias("word"))
    g = g.withColumn("n", F.row_number().over(Window.partitionBy("doc_id").orderBy("n")))
    cells = F.array(F.struct(F.lit(40.0).alias("x"), F.col("n").cast("string").alias("s")), F.struct(F.lit(80.0).alias("x"), F.col("word").alias("s")))
    runs = g.select("doc_id", "n", F.posexplode(cells).alias("i", "c")).select(
        "doc_id", F.lit(1).alias("page"), (F.col("n") * 10 + F.col("i")).alias("ord"), F.col("c.x").alias("x"), (F.lit(700.0) - F.col("n") * 12).alias("y"), F.lit(6.0).alias("width"),
        F.lit(600.0).alias("page_width"), F.col("c.s").alias("str"),
    )
    return pdf.pdf_texts(runs)


@query("""
with b as (select cast(o_orderkey as string) as doc_id, 'word' || o_custkey as w from orders)
select doc_id, cast(unnest([0, 1, 2]) as int) as ord, cast(unnest([-1, 0, -1]) as int) as parent, unnest(['(a)', '(a)(1)', '(b)']) as path, unnest(['In general', '', '']) as heading,
  unnest(['The ' || w || ' is.', 'One.', w]) as text from b
""")
def provision_tree(spark: SparkSession, d: str) -> DataFrame:
    from lawloom.functions import sqlfuncs

    sqlfuncs.register(spark)
    rows = table(spark, d, "orders").selectExpr("cast(o_orderkey as string) as doc_id", "concat('SEC. 4. KITES.\n(a) In general.--The word', o_custkey, '\nis.\n  (1) One.\n(b) word', o_custkey) as text")
    return spark.sql("select doc_id, p.ord, p.parent, p.path, p.heading, p.text from {rows}, lateral provisions(text) p", rows=rows)
