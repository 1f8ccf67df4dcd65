"""Queries on the law side: documents and prints read into tables, resolution with every outcome, redlines of every kind, and their SQL."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lawloom.functions import citations
from lawloom.functions.text import slug, squeeze_out
from lawloom.operators import compaction, law, metrics, redline
from lawloom.plans.tables import _ORIGIN, _laws, _sql
from lawloom.session import scratch_path, table
from lawloom.sources import bills as bill_source
from lawloom.sources import codified

QUERIES: dict = {}
ORACLES: dict[str, str] = {}


def query(sql: str):
    def add(f):
        QUERIES[f.__name__] = f
        ORACLES[f.__name__] = sql
        return f

    return add


# --- documents and prints --------------------------------------------------------------------------------------------------------

_TITLES = (
    "select cast(p_partkey % 20 as string) as title, cast(p_partkey as string) as number, p_name as name, p_brand as brand, p_type as kind from part"
)


def _code_documents(spark: SparkSession, d: str, release: str = "119-1") -> DataFrame:
    """One document for each title, of sections made from parts, with a quoted section in a note that is none of the code."""
    rows = _sql(spark, d, _TITLES, "part")
    section = F.concat(
        F.lit("<section identifier='/us/usc/t"), "title", F.lit("/s"), "number", F.lit("'><num value='"), "number", F.lit("'>§ "), "number", F.lit(".</num><heading>"), "name",
        F.lit("</heading><chapeau>Lead of <i>"), "brand", F.lit("</i>:</chapeau><subsection><num value='a'>(a)</num><heading>First</heading><content> One\n  "), "kind",
        F.lit("</content><paragraph><num value='1'>(1)</num><content>Two</content></paragraph></subsection><sourceCredit>(Pub. L. 90–1, § "), "number",
        F.lit(".)</sourceCredit><notes><note topic='amendments'><heading>Amendments</heading><p>By "), "brand", F.lit(".</p><section identifier='/us/usc/t"), "title",
        F.lit("/s0'><num value='0'/></section></note></notes></section>"),
    )
    made = rows.groupBy("title").agg(F.array_join(F.sort_array(F.collect_list(F.struct(F.col("number").cast("bigint").alias("n"), section.alias("x")))).getField("x"), "").alias("x"))
    xml = F.concat(F.lit("<doc xmlns='u'><title identifier='/us/usc/t"), "title", F.lit("'><num value='"), "title", F.lit("'/><heading>Of parts</heading><chapter><num value='1'/><heading>All</heading>"), "x", F.lit("</chapter></title></doc>"))
    return made.select("title", xml.alias("xml"), F.lit(release).alias("release_point"))


@query(f"""select title, number as section, cast(row_number() over (partition by title order by cast(number as bigint)) as bigint) as doc_order, name as heading, 'Lead of ' || brand || ':' as lead,
  '(Pub. L. 90–1, § ' || number || '.)' as source_credit, 'title|chapter' as above, 'amendments:Amendments:By ' || brand || '.' as notes from ({_TITLES})""")
def code_xml_sections(spark: SparkSession, d: str) -> DataFrame:
    rows = codified.read_code(_code_documents(spark, d))
    note = F.array_join(F.transform("notes", lambda n: F.concat_ws(":", n["topic"], n["heading"], n["text"])), "|")
    return rows.select("title", "section", "doc_order", "heading", "lead", "source_credit", F.array_join(F.transform("ancestors", lambda a: a["type"]), "|").alias("above"), note.alias("notes"))


@query(f"""select title, number as slug, cast(0 as int) as entry, unnest([0, 1])::int as ord, unnest(['(a)', '(a)(1)']) as path, unnest(['', '(a)']) as parent_path, unnest(['First', '']) as heading,
  unnest(['One ' || kind, 'Two']) as text from ({_TITLES})""")
def code_xml_nodes(spark: SparkSession, d: str) -> DataFrame:
    nodes = codified.code_nodes(codified.read_code(_code_documents(spark, d)))
    return nodes.select("title", "slug", "entry", "ord", "path", "parent_path", "heading", "text")


@query(f"select title, case when cast(title as int) < 5 then '119-2' else '119-1' end as release_point, count(*) as sections from ({_TITLES}) group by all")
def code_titles_stored(spark: SparkSession, d: str) -> DataFrame:
    """All titles are stored, then some of them again from a later release."""
    path = scratch_path(spark, "titles")
    codified.store_titles(codified.read_code(_code_documents(spark, d)), path)
    codified.store_titles(codified.read_code(_code_documents(spark, d, "119-2"), [str(k) for k in range(5)]), path)
    stored = spark.read.parquet(path).withColumn("title", F.col("title").cast("string"))
    return stored.groupBy("title", "release_point").agg(F.count("*").alias("sections"))


@query("select cast(p_partkey as string) as title from part where p_partkey % 7 = 0")
def code_xml_unreadable(spark: SparkSession, d: str) -> DataFrame:
    xml = F.when(F.col("p_partkey") % 7 == 0, "<doc><title><section>").otherwise("<doc/>")
    docs = table(spark, d, "part").select(F.col("p_partkey").cast("string").alias("title"), xml.alias("xml"), F.lit("1").alias("release_point"))
    return codified.unreadable(docs).select("title")


@query("""select '9' as title, cast(p_partkey as string) as part, p_partkey || '.' || unnest([1, 2]) as number, unnest([p_name, 'Scope']) as heading, unnest(['(a) One ' || p_brand || '.|(1) Two.', 'Flush.']) as paragraphs from part""")
def rule_xml(spark: SparkSession, d: str) -> DataFrame:
    k = F.col("p_partkey").cast("string")
    xml = F.concat(
        F.lit("<DIV5 N='"), k, F.lit("' TYPE='PART'><HEAD>PART</HEAD><DIV8 N='"), k, F.lit(".1' TYPE='SECTION'><HEAD>§ "), k, F.lit(".1 "), "p_name", F.lit(".</HEAD><P>(a) <I>One</I> "), "p_brand",
        F.lit(".</P>\n<FP>(1) Two.</FP><P> </P></DIV8><DIV8 N='"), k, F.lit(".2' TYPE='SECTION'><HEAD>Scope</HEAD><P>Flush.</P></DIV8></DIV5>"),
    )
    docs = table(spark, d, "part").select(F.lit("9").alias("title"), F.lit("2020-01-01").alias("as_of"), xml.alias("xml"))
    return codified.read_rules(docs).select("title", "part", "number", "heading", F.array_join("paragraphs", "|").alias("paragraphs"))


@query("""select o_orderkey as reg_id, unnest(range(9))::int as ord, unnest([-1, -1, 1, 2, 1, -1, -1, 6, 7])::int as parent, unnest(['', '(a)', '(a)(1)', '(a)(1)(i)', '(a)(2)', '(h)', '(i)', '(i)(1)', '(i)(1)(i)']) as path,
  unnest(['Lead ' || o_custkey || '.', 'One.', 'Two.', 'Three.' || chr(10) || 'Flush ' || o_custkey, '', 'x', 'y', 'z', 'w']) as text from orders""")
def rule_provisions(spark: SparkSession, d: str) -> DataFrame:
    lines = [F.concat(F.lit("Lead "), "o_custkey", F.lit(".")), "(a) One.", "(1) Two.", "(i) Three.", F.concat(F.lit(" Flush "), "o_custkey"), "(2)", "(h) x", "(i) y", "(1) z", "(i) w"]
    rows = table(spark, d, "orders").select(F.col("o_orderkey").alias("reg_id"), F.array(*[x if not isinstance(x, str) else F.lit(x) for x in lines]).alias("paragraphs"))
    return codified.rule_provisions(rows).select("reg_id", "ord", "parent", "path", "text")


_PRINT = (
    "concat('Public Law 110-', cast(o_orderkey as string), '\n\nDIVISION A--FIRST\n\nSEC. 1. SHORT TITLE.\n\n  This Act may be cited as the ``Kite ', cast(o_custkey as string), ' Act''''. <<NOTE: 5 USC 1\nnote.>> \n\n"
    "DIVISION B--SECOND\n\nSEC. 1. AGAIN.\n\n  Text ', cast(o_custkey as string), '.\n\nSEC. 2. LAST.\n\nEnd.\n')"
)


def _prints(spark: SparkSession, d: str) -> DataFrame:
    return codified.read_laws(table(spark, d, "orders").select(F.concat(F.lit("110-"), "o_orderkey").alias("law_id"), F.expr(_PRINT).alias("text")))


@query("""select '110-' || o_orderkey as law_id, unnest(['1', '1', '2']) as number, unnest([0, 1, 0])::int as entry, unnest(['SHORT TITLE', 'AGAIN', 'LAST']) as heading, unnest(['DIVISION A—FIRST', 'DIVISION B—SECOND', 'DIVISION B—SECOND']) as above,
  unnest(['SEC. 1. SHORT TITLE.' || chr(10) || chr(10) || '  This Act may be cited as the ``Kite ' || o_custkey || ' Act''''.', 'SEC. 1. AGAIN.' || chr(10) || chr(10) || '  Text ' || o_custkey || '.', 'SEC. 2. LAST.' || chr(10) || chr(10) || 'End.']) as text from orders""")
def law_print_sections(spark: SparkSession, d: str) -> DataFrame:
    return codified.law_sections(_prints(spark, d)).select("law_id", "number", "entry", "heading", F.array_join("ancestors", ">").alias("above"), "text")


@query("select '110-' || o_orderkey as law_id, unnest([0, 1, 2])::int as seq, unnest(['1', '1', '2']) as num, unnest(['DIVISION A', 'DIVISION B', 'DIVISION B']) as above, 'Kite ' || o_custkey || ' Act' as name from orders")
def law_print_contents(spark: SparkSession, d: str) -> DataFrame:
    read = _prints(spark, d)
    return read.select("law_id", "name", F.inline("contents")).select("law_id", "seq", "num", F.array_join("where_path", ">").alias("above"), "name")


@query("select s_suppkey as k, s_suppkey % 4 <> 3 as agree from supplier")
def name_checks(spark: SparkSession, d: str) -> DataFrame:
    """Equal but for marks, one within the other, most words of the shorter in the longer, and no agreement."""
    k = F.col("s_suppkey")
    other = F.when(k % 4 == 0, "the harbor, renewal act").when(k % 4 == 1, "Harbor Renewal Act of 1994").when(k % 4 == 2, "Renewal of Harbors and Quays Act").otherwise("Kite Strings Act")
    name = F.when(k % 4 == 0, "The Harbor Renewal Act").otherwise("Harbor Renewal Act")
    return table(spark, d, "supplier").select(k.alias("k"), codified.names_agree(name, other).alias("agree"))


@query(r"""
with f as (select distinct file_id, path, text from files where text is not null),
p as (select file_id, regexp_matches(lower(path), '\.html?$') or regexp_matches(text, '^\s*<') as page from f) select file_id, coalesce(page, false) as page from p
""")
def sniffed_pages(spark: SparkSession, d: str) -> DataFrame:
    rows = table(spark, d, "files").where("text is not null").select("file_id", "path", "text").distinct()
    return rows.select("file_id", bill_source.is_page(F.col("path"), F.col("text")).alias("page"))


@query("select 'none-' || s_suppkey as id from supplier union select distinct doc_id from citation where doc_id is not null and doc_id not in (select doc_id from files where doc_id is not null and text is not null)")
def missing_bills(spark: SparkSession, d: str) -> DataFrame:
    cited = table(spark, d, "citation").where("doc_id is not null").select(F.col("doc_id").alias("id")).distinct()
    manifest = cited.union(table(spark, d, "supplier").select(F.concat(F.lit("none-"), "s_suppkey")))
    return bill_source.missing_files(manifest, table(spark, d, "files").where("text is not null").select("doc_id").distinct())


@query("""
with s as (select distinct grp, stem from shard_file), e as (select grp, parts, part_bytes, unnest(at_list) as x from (select distinct on (idx_id) * from bundle_index))
select s.grp, s.stem, parts[x.part_no + 1] as part, x.byte_offset as byte_offset, x.byte_length as byte_length from e join s on s.grp = e.grp and s.stem = x.stem
where x.part_no >= 0 and x.part_no < len(parts) and x.byte_offset + x.byte_length <= part_bytes[x.part_no + 1]
""")
def record_places(spark: SparkSession, d: str) -> DataFrame:
    return compaction.locate_records(table(spark, d, "bundle_index"), table(spark, d, "shard_file"))


# --- resolution ------------------------------------------------------------------------------------------------------------------

#: Sections made so that each outcome of a citation comes up, by the remainder of a key by nine.
_CASES = "select cast(o_orderkey as string) as k, o_orderkey % 9 as way from orders"


@query(f"""with c as ({_CASES}) select k as cite_key, ['title_absent', 'section_absent', 'moved', 'stub', 'section', 'provision', 'run_in', 'head_level', 'focus_missing'][way + 1] as outcome,
  case way when 5 then '(a)(1)' when 6 then '(1)' when 7 then '(2)' end as focus_path, case way when 5 then '' when 6 then '(a)' when 7 then '(z)' end as dropped, case way when 2 then '9:77' end as moved_to from c""")
def usc_outcome_cases(spark: SparkSession, d: str) -> DataFrame:
    c = _sql(spark, d, _CASES, "orders")
    way, title = F.col("way"), F.when(F.col("way") == 0, "none").otherwise("1")
    path = F.element_at(F.array(*[F.lit(x) for x in ("", "", "", "", "", "(a)(1)", "(a)(1)", "(z)(2)", "(q)")]), (way + 1).cast("int"))
    cites = c.select(F.col("k").alias("cite_key"), title.alias("title"), F.when(way == 1, F.concat("k", F.lit("x"))).otherwise(F.col("k")).alias("section"), path.alias("subsection"), (way == 7).alias("from_head"))
    note = F.array(F.struct(F.lit("t").alias("topic"), F.lit("").alias("heading"), F.when(way == 2, "Transferred to section 77 of Title 9.").otherwise("").alias("text")))
    lead = F.when(way.isin(2, 3), "").when(way == 6, "The rule is (a) of one kind").otherwise("Lead.")
    sections = c.where("way > 0").select(F.lit("1").alias("title"), F.col("k").alias("slug"), F.lit(0).alias("entry"), F.lit("Heading").alias("heading"), lead.alias("lead"), note.alias("notes"))
    held = F.when(way == 5, F.array(F.lit("(a)"), F.lit("(a)(1)"))).when(way == 6, F.array(F.lit("(1)"))).when(way == 7, F.array(F.lit("(2)"))).when(way == 8, F.array(F.lit("(a)"))).otherwise(F.array().cast("array<string>"))
    nodes = c.select(F.lit("1").alias("title"), F.col("k").alias("slug"), F.lit(0).alias("entry"), F.posexplode(held).alias("ord", "path"))
    titles = spark.createDataFrame([("1",)], "title string")
    return law.resolve_code(cites, titles, sections, nodes).select("cite_key", "outcome", "focus_path", "dropped", "moved_to")


@query(_ORIGIN + """, a as (select distinct enacted_as, act_section from o), w as (select * from a union all select enacted_as, act_section || 'zz' from a),
g as (select act_key, act_section, case when count(distinct title || ':' || section) = 1 then min(title) end as title, case when count(distinct title || ':' || section) = 1 then min(section) end as section from o group by all)
select w.enacted_as, w.act_section, g.title, g.section from w left join g on g.act_key = regexp_replace(regexp_replace(lower(w.enacted_as), '[^a-z0-9]+', '_', 'g'), '^_|_$', '', 'g') and g.act_section = w.act_section""")
def act_section_resolve(spark: SparkSession, d: str) -> DataFrame:
    origins = law.section_origins(table(spark, d, "code_section"))
    held = origins.select("enacted_as", "act_section").distinct()
    wanted = held.union(held.withColumn("act_section", F.concat("act_section", F.lit("zz")))).withColumn("cite_key", F.lit(""))
    return law.resolve_acts(wanted, law.act_sections(origins)).drop("cite_key")


_CITES = r"""
with c as (select distinct doc_id, cite_id, kind, regexp_replace(title, '\s+', '', 'g') as title, regexp_replace(section, '\s+', '', 'g') as section, regexp_replace(coalesce(subsection, ''), '\s+', '', 'g') as subsection, et_seq
  from citation where kind = 'usc' and title is not null and section is not null),
r as (select *, case when not exists (select 1 from code_section s where s.title = c.title and s.slug = regexp_replace(lower(c.section), '[^a-z0-9]', '_', 'g')) then
  case when exists (select 1 from code_title t where t.title = c.title) then 'section_absent' else 'title_absent' end else 'held' end as outcome from c)
"""


def _resolved(spark: SparkSession, d: str) -> DataFrame:
    rows = table(spark, d, "citation").where("kind = 'usc' and title is not null and section is not null")
    cites = rows.select("doc_id", "cite_id", "kind", squeeze_out("title").alias("title"), squeeze_out("section").alias("section"), squeeze_out(F.coalesce("subsection", F.lit(""))).alias("subsection"), "et_seq").distinct()

    def resolve(distinct: DataFrame) -> DataFrame:
        names = ("code_title", "code_section", "code_node")
        return law.resolve_code(distinct.withColumn("from_head", F.lit(False)), *(table(spark, d, n) for n in names)).select("cite_key", "outcome")

    return law.memoised(cites, resolve)


#: Sections of which every third shares its number in the Act with another one.
_CREDITS = "select cast(s_suppkey % 50 as string) as title, cast(s_suppkey as string) as section, concat('(Pub. L. 90-', cast(s_suppkey % 3 as string), ', title II, § ', cast(case s_suppkey % 3 when 0 then s_suppkey - s_suppkey % 6 else s_suppkey end as string), ', Aug. 1, 1970; Pub. L. 99-5, Oct. 2, 1985.)') as source_credit from supplier"


@query(f"""with c as ({_CREDITS}), n as (select 'pub_l_90_' || cast(section as bigint) % 3 as act_key, case cast(section as bigint) % 3 when 0 then cast(section as bigint) - cast(section as bigint) % 6 else cast(section as bigint) end as act_section, title, section from c)
select act_key, cast(act_section as varchar) as act_section, count(distinct title || ':' || section) as claims from n group by all having claims > 1""")
def act_conflict_cases(spark: SparkSession, d: str) -> DataFrame:
    return law.act_conflicts(law.section_origins(_sql(spark, d, _CREDITS, "supplier")))


@query(f"""with c as ({_CREDITS}) select section, 'Pub. L. 90-' || cast(section as bigint) % 3 as enacted_by, cast(null as varchar) as added_by, cast(1 as bigint) as amendments, 'Pub. L. 99-5' as latest_law, 'Oct. 2, 1985' as latest_date from c""")
def credit_clauses(spark: SparkSession, d: str) -> DataFrame:
    rows, told = _sql(spark, d, _CREDITS, "supplier"), law.credit_summary(F.col("source_credit"))
    return rows.select("section", *[told[n].alias(n) for n in ("enacted_by", "added_by", "amendments", "latest_law", "latest_date")])


@query(_CITES + "select doc_id, cite_id, outcome, concat_ws('|', kind, nullif(title, ''), nullif(section, ''), nullif(subsection, ''), case when et_seq then 'etseq' end) as cite_key from r")
def resolution_memo(spark: SparkSession, d: str) -> DataFrame:
    held = F.when(F.col("outcome").isin("title_absent", "section_absent"), F.col("outcome")).otherwise("held")
    return _resolved(spark, d).select("doc_id", "cite_id", held.alias("outcome"), "cite_key")


@query(_CITES + "select kind, case when outcome = 'held' then 'held' else outcome end as outcome, count(*) as cites, cast(0 as bigint) as errors from r group by all")
def citation_export(spark: SparkSession, d: str) -> DataFrame:
    """Written as JSON by kind, and read back."""
    out = law.export_resolved(_resolved(spark, d).select("doc_id", "cite_id", "kind", "title", "section", "outcome"), scratch_path(spark, "export"))
    held = F.when(F.col("outcome").isin("title_absent", "section_absent"), F.col("outcome")).otherwise("held")
    errors = F.count("error") if "error" in out.columns else F.lit(0).cast("bigint")
    return out.groupBy("kind", held.alias("outcome")).agg(F.count("*").alias("cites"), errors.alias("errors"))


@query("""select o_orderkey as k, array_to_string(list_filter([case when o_orderkey % 2 = 0 then 'implied' end, case when o_orderkey % 3 = 0 then 'relative' end, case when o_orderkey % 5 = 0 then 'run_in' end,
  case when o_orderkey % 7 = 0 then 'missing' end, 'links'], lambda x: x is not null), '|') as cards from orders""")
def context_cards(spark: SparkSession, d: str) -> DataFrame:
    k = F.col("o_orderkey")
    flags = {"links": F.lit(True), "missing": k % 7 == 0, "run_in": k % 5 == 0, "relative": k % 3 == 0, "implied": k % 2 == 0}
    rows = table(spark, d, "orders").select(k.alias("k"), *[v.alias(n) for n, v in flags.items()])
    return rows.select("k", F.array_join(law.context_cards(rows.columns), "|").alias("cards"))


_EFFECTS = "select cast(p_partkey as string) as k, p_partkey % 3 as way, p_name as name from part"


@query(f"""with p as ({_EFFECTS}) select k as am_id, unnest([0, 1, 2])::int as op_seq, unnest(case way when 0 then ['stands', 'gone', 'read'] when 1 then ['stands', 'stands', 'read'] else ['no_law', 'no_law', 'no_law'] end) as status,
  unnest(case way when 0 then [true, false, null] when 1 then [true, true, null] else [false, false, null] end) as found, way = 0 as unmatched from p""")
def effect_statuses(spark: SparkSession, d: str) -> DataFrame:
    p = _sql(spark, d, _EFFECTS, "part")
    texts = p.where("way < 2").select(F.lit("1").alias("title"), F.col("k").alias("slug"), F.concat(F.lit("The  “"), "name", F.lit("”\n of item "), "k", F.when(F.col("way") == 1, " and more").otherwise("")).alias("text"))
    one = lambda n, kind, text: F.struct(F.lit(n).alias("op_seq"), F.lit(kind).alias("type"), text.alias("text"))
    struck = F.concat(F.lit("``"), F.upper("name"), F.lit("'' OF"))
    ops = p.select(F.col("k").alias("am_id"), F.lit("1").alias("title"), F.col("k").alias("slug"), F.inline(F.array(one(0, "strike", struck), one(1, "strike", F.lit("and  more")), one(2, "insert", F.lit("x")))))
    return law.effects(ops, texts).select("am_id", "op_seq", "status", "found", "unmatched")


@query(_CITES + r""", u as (select distinct c.kind, r.title, r.section, r.subsection, r.outcome, regexp_replace(lower(r.section), '[^a-z0-9]', '_', 'g') as slug from r join c using (doc_id, cite_id)),
v as (select *, case when outcome <> 'held' then 'no_section' when subsection <> '' and not exists (select 1 from code_node n where n.title = u.title and n.slug = u.slug and n.path = u.subsection) then 'no_subsection' else 'hit' end as fate from u)
select kind, count(*) as targets, count(*) filter (fate = 'hit') as hits, count(*) filter (fate = 'no_section') as no_section, count(*) filter (fate = 'no_subsection') as no_subsection,
  count(distinct title || ':' || slug) filter (fate = 'hit') as provisions from v group by kind
union all
select 'publaw', count(*), count(*) filter (law % 2 = 0), count(*) filter (law % 2 = 1), 0, count(distinct law % 10) filter (law % 2 = 0) from (select distinct cast(law as int) as law from citation where kind = 'publaw' and law is not null and law <> '')
""")
def impact_rates(spark: SparkSession, d: str) -> DataFrame:
    """Of citations of the code, and of public laws whose places are made up by their number."""
    code = table(spark, d, "code_node").select("title", "slug", F.col("path").alias("subsection"), F.lit(True).alias("there")).distinct()
    rows = _resolved(spark, d).withColumn("slug", slug(F.col("section"))).join(code, ["title", "slug", "subsection"], "left")
    absent = F.col("outcome").isin("title_absent", "section_absent")
    fate = F.when(absent, "no_section").when((F.col("subsection") != "") & F.col("there").isNull(), "no_subsection").otherwise("hit")
    usc = rows.select("kind", F.concat_ws("|", "title", "section", "subsection").alias("cite_key"), fate.alias("outcome"), F.concat_ws(":", "title", "slug").alias("place"))
    number = F.col("law").cast("int")
    laws = table(spark, d, "citation").where("kind = 'publaw' and law is not null and law <> ''").select("kind", number.cast("string").alias("cite_key"), F.when(number % 2 == 0, "hit").otherwise("no_section").alias("outcome"), (number % 10).cast("string").alias("place"))
    return metrics.impact_rates(usc.union(laws))


@query("select cast(o_orderkey as string) as doc_id, case o_orderkey % 4 when 0 then 'badOffsets' when 1 then 'overlaps' else 'badOpOffsets' end as metric, cast(o_orderkey % 7 as bigint) as value from orders where o_orderkey % 4 < 3 and o_orderkey % 7 > 0")
def broken_invariants(spark: SparkSession, d: str) -> DataFrame:
    k = F.col("o_orderkey")
    name = F.when(k % 4 == 0, "badOffsets").when(k % 4 == 1, "overlaps").when(k % 4 == 2, "badOpOffsets").otherwise("sections")
    rows = table(spark, d, "orders").select(k.cast("string").alias("doc_id"), name.alias("metric"), (k % 7).cast("bigint").alias("value"))
    return metrics.broken_invariants(rows)


@query("select distinct congress, law, 'https://www.govinfo.gov/link/plaw/' || congress || '/public/' || law as govinfo from citation where kind = 'publaw' and congress is not null and law is not null")
def law_links(spark: SparkSession, d: str) -> DataFrame:
    rows = table(spark, d, "citation").where("kind = 'publaw' and congress is not null and law is not null").select("congress", "law").distinct()
    return rows.select("congress", "law", law.law_links(F.col("congress"), F.col("law"))[0].alias("govinfo"))


@query("select s_suppkey as k, case s_suppkey % 4 when 0 then 'Clean Air Act' when 1 then 'Social Security Act' when 2 then 'Employee Retirement Income Security Act of 1974' end as act_name from supplier")
def acts_found(spark: SparkSession, d: str) -> DataFrame:
    """Names as texts give them, told by the table of Acts."""
    k = F.col("s_suppkey")
    said = F.when(k % 4 == 0, "the CLEAN  AIR Act, as amended").when(k % 4 == 1, "title II of the social\nsecurity act").when(k % 4 == 2, "ERISA").otherwise("Kite Act")

    def run(batches):
        import pyarrow as pa

        for b in batches:
            found = [citations.find_act(x) for x in b.column(1).to_pylist()]
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array([a and a.name for a in found], pa.string())], names=["k", "act_name"])

    return table(spark, d, "supplier").select(k.alias("k"), said.alias("said")).mapInArrow(run, "k bigint, act_name string")


# --- redlines --------------------------------------------------------------------------------------------------------------------

_WAYS = "select cast(p_partkey as string) as k, p_partkey % 7 as way from part"
_BLOCK = "A keeper of every harbor shall count all boats and barges twice"


def _cases(spark: SparkSession, d: str) -> DataFrame:
    """Sections with two provisions, and one amendment each, by way: added, added before, rewritten, rewritten before, stale, one of the last of its kind, lost."""
    p = _sql(spark, d, _WAYS, "part")
    law_a, law_b = F.concat(F.lit("An item zq"), "k", F.lit(" or a kite; or")), F.concat(F.lit(_BLOCK + " in port "), "k", F.lit("."))
    sections = p.select(F.lit("1").alias("title"), F.col("k").alias("slug"), F.lit(0).alias("entry"), F.lit("Lead.").alias("lead"))
    nodes = p.select(F.lit("1").alias("title"), F.col("k").alias("slug"), F.lit(0).alias("entry"), F.inline(F.array(
        *[F.struct(F.lit(n).alias("ord"), F.lit(path).alias("path"), F.lit("").alias("parent_path"), F.lit(path).alias("marker"), F.lit("").alias("heading"), text.alias("text")) for n, path, text in ((0, "(a)", law_a), (1, "(b)", law_b))]
    )))

    def op(seq: int, kind: str, text, scope: str, at_end: bool = False, replaces: int | None = None):
        plain = {"relation": None, "anchor": None, "placement": None, "operand": None}
        return F.struct(
            F.lit("a0").alias("am_id"), F.lit(seq).alias("op_seq"), F.lit(kind).alias("type"), (text if not isinstance(text, str) else F.lit(text)).alias("text"), F.lit(10 * (seq + 1)).cast("bigint").alias("start"),
            *[F.lit(v).cast("string").alias(n) for n, v in plain.items()], F.lit(False).alias("all"), F.lit(at_end).alias("at_end"), F.lit(replaces).cast("bigint").alias("replaces"), F.lit(scope).alias("scope"),
            *[F.lit(False).alias(n) for n in ("scope_from_head", "exact", "range_end", "new_section")],
        )

    ways = [
        [op(0, "add-at-end", "(1) A new one.", "(a)")],
        [op(0, "add-at-end", _BLOCK, "(a)")],
        [op(0, "replace", "(b) Nobody counts anything here, ever, at all, nowhere.", "(b)")],
        [op(0, "replace", _BLOCK, "(b)")],
        [op(0, "strike", "gone words", "(a)"), op(1, "insert", "all boats and barges twice", "(b)", replaces=10)],
        [op(0, "strike", "or", "(a)", at_end=True)],
        [op(0, "strike", "kite", "(q)")],
    ]
    ops = F.when(F.lit(False), F.array(ways[0][0]))
    for n, way in enumerate(ways):
        ops = ops.when(F.col("way") == n, F.array(*way))
    return redline.draw_ops(p.select(F.col("k").alias("doc_id"), F.lit("a0").alias("am_id"), F.lit("1").alias("title"), F.col("k").alias("slug"), ops.alias("ops")), sections, nodes)


@query(f"""with p as ({_WAYS}) select k as doc_id, way = 4 as stale, unnest(case way when 4 then [0, 1] else [0] end)::int as op_seq,
  unnest(case way when 0 then ['drawn'] when 1 then ['applied'] when 2 then ['marked'] when 3 then ['in_force'] when 4 then ['withheld', 'enacted'] when 5 then ['drawn'] else ['lost'] end) as outcome from p""")
def redline_cases(spark: SparkSession, d: str) -> DataFrame:
    return _cases(spark, d).select("doc_id", "stale", F.inline("outcomes")).select("doc_id", "stale", "op_seq", "outcome")


@query(f"""with p as ({_WAYS}), l as (select *, 'An item zq' || k || ' or a kite; or' as a, '{_BLOCK} in port ' || k || '.' as b from p),
s as (select k, way, unnest(case way
  when 0 then [['', 'keep', 'Lead.'], ['(a)', 'keep', a], ['(a)', 'ins', '(1) A new one.'], ['(b)', 'keep', b]]
  when 2 then [['', 'keep', 'Lead.'], ['(a)', 'keep', a], ['(b)', 'ins', '(b) Nobody counts anything here, ever, at all, nowhere.'], ['(b)', 'keep', b]]
  when 3 then [['', 'keep', 'Lead.'], ['(a)', 'keep', a], ['(b)', 'was', '{_BLOCK}'], ['(b)', 'keep', b]]
  when 4 then [['', 'keep', 'Lead.'], ['(a)', 'keep', a], ['(b)', 'keep', 'A keeper of every harbor shall count '], ['(b)', 'was', 'all boats and barges twice'], ['(b)', 'keep', ' in port ' || k || '.']]
  when 5 then [['', 'keep', 'Lead.'], ['(a)', 'keep', 'An item zq' || k || ' or a kite; '], ['(a)', 'del', 'or'], ['(b)', 'keep', b]]
  else [['', 'keep', 'Lead.'], ['(a)', 'keep', a], ['(b)', 'keep', b]] end) as x, way from l)
select k as doc_id, x[1] as path, x[2] as kind, x[3] as text from s""")
def redline_case_segments(spark: SparkSession, d: str) -> DataFrame:
    return redline.segments(_cases(spark, d)).select("doc_id", "path", "kind", "text")


@query("""select s_suppkey as k, 'New ' || s_name || ' words.' || chr(10) || '(b) more' as text from supplier""")
def clean_additions(spark: SparkSession, d: str) -> DataFrame:
    text = F.concat(F.lit("  ``New "), "s_name", F.lit(" words.  \n``(b) more \t"))
    return table(spark, d, "supplier").select(F.col("s_suppkey").alias("k"), law.clean_addition(text).alias("text"))
