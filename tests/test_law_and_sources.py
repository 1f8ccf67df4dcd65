from pyspark.sql import functions as F

from lawloom.functions import sqlfuncs
from lawloom.operators import bills as B
from lawloom.operators import law, redline
from lawloom.sources import bills as source
from lawloom.sources import codified, pdf, share
from lawloom.streaming import bills as stream


def test_credits(spark):
    rows = [
        ("1", "7a", "(July 5, 1949, ch. 338, title V, § 7, 63 Stat. 432; Pub. L. 90–1, § 2, Jan. 2, 1968, 81 Stat. 4.)"),
        ("1", "8", "(Pub. L. 91–2, title II, § 2[7], Mar. 3, 1970, 84 Stat. 5.)"),
        ("1", "9", "(Pub. L. 91–2, § 1 (part), Mar. 3, 1970.)"),
        ("1", "10", "(Pub. L. 91–2, title I, § 931, formerly § 944, Mar. 3, 1970.)"),
        ("1", "11", "(Pub. L. 91–2, § 931, Mar. 3, 1970.)"),
        ("1", "12", "(Pub. L. 91–3, div. C, title IV, § 5, 70 Stat. 4.)"),
        ("1", "13", None),
        ("1", "14", "no credit"),
    ]
    o = law.section_origins(spark.createDataFrame(rows, "title string, section string, source_credit string"))
    got = {(r.section, r.act_key, r.act_section, r.act_title) for r in o.collect()}
    assert got == {
        ("7a", "july_5_1949_ch_338", "7", "V"), ("8", "pub_l_91_2", "7", "II"), ("10", "pub_l_91_2", "931", "I"), ("11", "pub_l_91_2", "931", None), ("12", "pub_l_91_3", "5", None),
    }
    places = {(r.act_key, r.act_section): r.section for r in law.act_sections(o).collect()}
    assert places["pub_l_91_2", "931"] is None and places["pub_l_91_2", "7"] == "8"
    assert [r.claims for r in law.act_conflicts(o).collect()] == [2]
    s = law.credit_summary(F.col("source_credit"))
    one = spark.createDataFrame(rows[:1], "title string, section string, source_credit string").select(*[c.alias(n) for n, c in s.items()]).first()
    assert tuple(one) == ("July 5, 1949, ch. 338", "7", None, 1, "Pub. L. 90–1", "Jan. 2, 1968")


def test_outcomes_of_code_citations(spark):
    titles = spark.createDataFrame([("5",)], "title string")
    sections = spark.createDataFrame(
        [("5", "1", 0, "One", "Here (b) stands.", None), ("5", "1", 1, "Other", "x", None), ("5", "2", 0, "Transferred", "", [("note", "", "It was transferred to section 9–1 of Title 6.")]), ("5", "3", 0, "Omitted", None, None)],
        "title string, slug string, entry int, heading string, lead string, notes array<struct<topic:string,heading:string,text:string>>",
    )
    nodes = spark.createDataFrame([("5", "1", 0, 0, "(a)"), ("5", "1", 0, 1, "(a)(1)"), ("5", "1", 0, 2, "(2)")], "title string, slug string, entry int, ord int, path string")
    asked = [("a", "5", "1", "", False), ("b", "5", "1", "(a)(1)", False), ("c", "5", "1", "(b)(2)", False), ("d", "5", "1", "(z)(2)", True), ("e", "5", "1", "(z)", True), ("f", "5", "2", "", False), ("g", "5", "3", "", False), ("h", "5", "4", "", False), ("i", "6", "4", "", False)]
    got = law.resolve_code(spark.createDataFrame(asked, "cite_key string, title string, section string, subsection string, from_head boolean"), titles, sections, nodes)
    assert sorted((r.cite_key, r.outcome, r.focus_path, r.moved_to) for r in got.collect()) == [
        ("a", "section", None, None), ("b", "provision", "(a)(1)", None), ("c", "run_in", "(2)", None), ("d", "head_level", "(2)", None), ("e", "focus_missing", None, None),
        ("f", "moved", None, "6:9-1"), ("g", "stub", None, None), ("h", "section_absent", None, None), ("i", "title_absent", None, None),
    ]


def test_labels_and_links(spark):
    ids = ["/us/usc/t5", "/us/usc/t42/ch7/schXVIII/ptA", "/us/usc/t5/zz1", "x", None, "/us/usc/t16/ch1–2"]
    got = [r[0] for r in spark.createDataFrame([(x,) for x in ids], "i string").select(law.crumb_link(F.col("i"))).collect()]
    at = "https://www.law.cornell.edu/uscode/text/"
    assert got == [at + "5", at + "42/chapter-7/subchapter-XVIII/part-A", None, None, None, at + "16/chapter-1-2"]
    rows = spark.createDataFrame([("42", "7401 et seq."), ("26", "title 26 generally"), ("23", "Pub. L. 117-58"), ("10", "varies"), ("1", None)], "t string, r string")
    assert [r[0] for r in rows.select(law.range_label(F.col("t"), F.col("r"))).collect()] == [
        "Its sections begin at 42 U.S.C. 7401 et seq.", "Its sections stand all over title 26.", "It is Pub. L. 117-58.", None, None,
    ]
    topics = spark.createDataFrame([("effectiveDate",), ("somethingElseHere",), ("note",), (None,)], "t string")
    assert [r[0] for r in topics.select(law.topic_label(F.col("t"))).collect()] == ["Effective date", "Something else here", "Note", "Note"]


def test_public_law_narrowing(spark):
    entries = [("9-1", "702", k, [f"DIVISION {x}—The {n} Improvement Act", "TITLE VII—MORE"]) for k, (x, n) in enumerate([("A", "Harbor"), ("E", "River"), ("N", "Lake")])]
    laws = spark.createDataFrame(entries, "law_id string, number string, entry int, ancestors array<string>")
    asked = [("n", "9-1", "702", ["DIVISION N"], None), ("x", "9-1", "702", ["DIVISION X"], None), ("t", "9-1", "702", None, "River Improvement Act"), ("all", "9-1", "702", None, None)]
    got = law.narrow_law_sections(spark.createDataFrame(asked, "cite_key string, law_id string, number string, where_path array<string>, short_title string"), laws)
    found = {}
    for r in got.collect():
        found.setdefault(r.cite_key, []).append(r.entry)
    assert {k: sorted(v) for k, v in found.items()} == {"n": [2], "x": [0, 1, 2], "t": [1], "all": [0, 1, 2]}


XML = """<uscDoc xmlns="http://x"><main><title identifier="/us/usc/t5"><num value="5">Title 5</num><heading>PAPERS</heading><chapter identifier="/us/usc/t5/ch1"><num value="1"/><heading>Ink</heading>
<section identifier="/us/usc/t5/s1"><num value="1">§ 1.</num><heading> Ink</heading><chapeau>The ink:</chapeau><subsection><num>(a)</num><heading>Black</heading><content>is <b>black</b>.</content>
<paragraph><num>(1)</num><content>mostly</content></paragraph> tail</subsection><sourceCredit>(Pub. L. 9–1.)</sourceCredit><notes><note topic="x"><heading>Old</heading><p>text</p>
<section identifier="/us/pl/s9"><num>9</num></section></note></notes></section><section identifier="/us/usc/t5/s1"><num value="1"/><heading>Again</heading></section></chapter></title></main></uscDoc>"""


def test_code_from_xml(spark):
    docs = spark.createDataFrame([("5", XML, "119-1"), ("6", "<broken", None), ("7", None, None)], "title string, xml string, release_point string")
    rows = codified.read_code(docs)
    got = sorted(rows.collect(), key=lambda r: r.entry)
    assert [(r.section, r.entry, r.heading, r.lead, r.source_credit) for r in got] == [("1", 0, "Ink", "The ink:", "(Pub. L. 9–1.)"), ("1", 1, "Again", "", "")]
    assert [(a.type, a.num) for a in got[0].ancestors] == [("title", "5"), ("chapter", "1")] and got[0].notes[0].heading == "Old"
    nodes = sorted(codified.code_nodes(rows).collect(), key=lambda r: r.ord)
    assert [(n.path, n.parent_path, n.heading, n.text) for n in nodes] == [("(a)", "", "Black", "is black. tail"), ("(a)(1)", "(a)", "", "mostly")]


def test_pages_and_payloads(spark):
    pages = spark.createDataFrame([("a.htm", "<html><pre>A &lt;b&gt; &amp;lt; c\r\nd</pre></html>"), ("b.txt", "x < y\rz")], "path string, content string")
    assert [r[0] for r in pages.select(source.bill_text(F.col("path"), F.col("content"))).collect()] == ["A <b> &lt; c\nd", "x < y\nz"]
    rows = spark.createDataFrame([("“Curly” — dashes",), ("",), (None,)], "t string")
    raw, packed = share.encode_raw(F.col("t")), share.encode_deflated("t")
    got = rows.select("t", share.decode_raw(raw).alias("a"), share.decode_deflated(packed).alias("b"), packed.rlike("^z[A-Za-z0-9_-]*$").alias("ok")).collect()
    assert all(r.a == r.t and r.b == r.t and r.ok in (True, None) for r in got)


def test_years_in_words(spark):
    words = [("two thousand and twenty",), ("two thousand",), ("nineteen ninety-six",), ("two thousand and so",), ("once",)]
    assert [r[0] for r in spark.createDataFrame(words, "w string").select(codified.year_in_words(F.col("w"))).collect()] == [2020, 2000, 1996, None, None]


def test_library(spark):
    manifest = spark.createDataFrame([("hr1-116-enr", "Kite Act (enrolled)", "1.2 MB. Flies well. More."), ("hr2-104-enr", "Ship Act of 1996", "sails")], "id string, name string, why string")
    bills = spark.createDataFrame([("hr1-116-enr", "the third day of January, two thousand and twenty", 9), ("hr2-104-enr", "none", 5)], "id string, text string, bytes int")
    assert [(r.name, r.year, r.note) for r in codified.library(manifest, bills).collect()] == [("Ship Act of 1996", 1995, "sails"), ("Kite Act (2020)", 2020, "Flies well.")]


def test_stream_reads_what_the_batch_reads(spark, tmp_path):
    src = tmp_path / "in"
    src.mkdir()
    for k in range(3):
        (src / f"b{k}.txt").write_text(f"SEC. 1. KITES.\n\nSee {k + 1} U.S.C. 5(a).\n")
    q = stream.write_tables(stream.bill_stream(spark, str(src)), str(tmp_path / "out"), str(tmp_path / "cp"), ("citations", "sections"))
    q.awaitTermination(120)
    got = {(r.doc_id, r.title) for r in spark.read.parquet(str(tmp_path / "out/citations")).collect()}
    want = {(r.doc_id, r.title) for r in B.table(B.analyse(source.read_bills(spark, str(src))), "citations").collect()}
    assert got == want == {("b0", "1"), ("b1", "2"), ("b2", "3")}


def test_table_functions(spark):
    sqlfuncs.register(spark)
    spark.createDataFrame([("d", "See 5 U.S.C. 9(b)."), ("n", None)], "doc_id string, text string").createOrReplaceTempView("bill")
    assert [tuple(r) for r in spark.sql("select doc_id, c.title, c.subsection from bill, lateral cite(text) c").collect()] == [("d", "5", "(b)")]


def test_redline_of_a_bill(spark):
    text = "Section 1(a) of the Kite Act (5 U.S.C. 1(a)) is amended by striking ``red'' and inserting ``blue''."
    bills = spark.createDataFrame([("d", text), ("e", None)], "doc_id string, text string")
    sections = spark.createDataFrame([("5", "1", 0, "")], "title string, slug string, entry int, lead string")
    nodes = spark.createDataFrame([("5", "1", 0, 0, "(a)", "(a)", "", "A red kite.")], "title string, slug string, entry int, ord int, path string, marker string, heading string, text string")
    drawn = redline.draw(B.analyse(bills), sections, nodes)
    assert [(r.kind, r.text) for r in redline.segments(drawn).orderBy("seg_seq").collect()] == [("keep", "A "), ("del", "red"), ("ins", "blue"), ("keep", " kite.")]
    assert sorted(r.outcome for r in redline.outcomes(drawn).collect()) == ["drawn", "drawn"]


def test_empty_tables(spark):
    bills = spark.createDataFrame([], "doc_id string, text string")
    assert B.table(B.analyse(bills), "ops").count() == 0
    glyphs = spark.createDataFrame([], "doc_id string, page int, ord int, x double, y double, width double, page_width double, str string")
    assert pdf.pdf_texts(glyphs).count() == 0


def test_dispatch_follows_its_order(spark):
    names = spark.createDataFrame(
        [("Kite Act", "16", "80", "80 et seq.", "Pub. L. 90–1"), ("Old Act", "7", "1", "1 et seq.", None)], "act_name string, head_title string, head_section string, act_range string, act_enacted string"
    )
    sections = spark.createDataFrame([("pub_l_90_1", "5", "16", "84"), ("pub_l_90_1", "6", None, None), ("pub_l_99_2", "3", "5", "9")], "act_key string, act_section string, title string, section string")
    titles = spark.createDataFrame([("pub_l_90_1", "IV", 0, "16", "90"), ("pub_l_90_1", "IV", 1, "16", "91")], "act_key string, act_title string, seq int, title string, section string")
    code = spark.createDataFrame([("5", "9", 0, "(Pub. L. 99–2, div. B, § 3.)")], "title string, slug string, entry int, source_credit string")
    plaw = spark.createDataFrame([("90-1", "6"), ("99-2", "3")], "law_id string, number string")
    toc = spark.createDataFrame([("90-1", ["Division B"])], "law_id string, where_path array<string>")
    rows = [
        ("usc", "usc", "5", "9", None, None, None, None, None, None, None, None),
        ("sec", "act", None, None, "Kite Act", "5", None, None, None, None, None, None),
        ("text", "act", None, None, "Kite Act", "6", None, None, None, None, None, None),
        ("title", "act", None, None, "Kite Act", None, "IV", None, None, None, None, None),
        ("div", "act", None, None, "Kite Act", None, None, "B", None, None, None, None),
        ("head", "act", None, None, "Old Act", "5", None, None, None, None, None, None),
        ("agree", "publaw", None, None, None, "3", None, "B", None, "99", "2", None),
        ("differ", "publaw", None, None, None, "3", None, "A", None, "99", "2", None),
        ("named", "publaw", None, None, None, "8", None, None, None, "98", "2", "kite act"),
        ("out", "publaw", None, None, None, "8", None, None, None, "98", "2", None),
        ("in", "internal", None, "4", None, None, None, None, None, None, None, None),
    ]
    schema = "cite_key string, kind string, title string, section string, act_name string, act_section string, act_title string, division string, `where` array<string>, congress string, law string, short_title string"
    got = {r.cite_key: (r.source, r.to_title, r.to_section, r.law_id) for r in law.dispatch(spark.createDataFrame(rows, schema), names, sections, titles, code, plaw, toc).collect()}
    assert got == {
        "usc": ("code", "5", "9", None), "sec": ("act_section", "16", "84", None), "text": ("law_text", None, None, "90-1"), "title": ("act_title", "16", "90", None),
        "div": ("law_division", None, None, "90-1"), "head": ("act_head", "7", "1", None), "agree": ("act_section", "5", "9", None), "differ": ("law_text", None, None, "99-2"),
        "named": ("act_head", "16", "80", None), "out": ("outside", None, None, "98-2"), "in": ("internal", None, None, None),
    }


def test_views_of_a_provision(spark):
    nodes = spark.createDataFrame([("1", "2", 0, k, p) for k, p in enumerate(["(a)", "(a)(1)", "(a)(1)(A)", "(a)(2)", "(b)"])], "title string, slug string, entry int, ord int, path string")
    wanted = spark.createDataFrame([("c", "1", "2", 0, "(a)(1)")], "cite_key string, title string, slug string, entry int, path string")
    assert [r.how for r in law.provision_view(wanted, nodes).orderBy("ord").collect()] == ["on_path", "focus", "under", "dimmed"]
    added = spark.createDataFrame([("``(9) One.  \n    ``(A) Two.",)], "t string")
    assert added.select(law.clean_addition(F.col("t"))).first()[0] == "(9) One.\n    (A) Two."
    ops = spark.createDataFrame([("a", 0, "strike", "RED  kite", "1", "2"), ("a", 1, "strike", "gone", "1", "2"), ("a", 2, "insert", "x", "1", "2")], "am_id string, op_seq int, type string, text string, title string, slug string")
    texts = spark.createDataFrame([("1", "2", "A red\nkite.")], "title string, slug string, text string")
    assert [r.found for r in law.effects(ops, texts).orderBy("op_seq").collect()] == [True, False, None]


def test_pages_go_to_python_by_batches(spark, monkeypatch):
    monkeypatch.setattr(pdf, "AT_ONCE", 2)
    runs = [(f"d{k}", page, ord_, x, 700.0 - 12 * (ord_ // 2), 20.0, 600.0, f"w{k}.{page}.{ord_}") for k in range(3) for page in (1, 2) for ord_, x in enumerate((60.0, 300.5, 60.0, 300.5))]
    runs += [("d0", 3, 0, None, 700.0, 20.0, None, "lost"), ("d0", 4, 0, 60.0, 700.0, None, None, "kept"), ("d0", 4, 1, 300.0, 700.0, 5.0, None, None), (None, None, 0, 60.0, 700.0, 5.0, 600.0, "no page")]
    glyphs = spark.createDataFrame(runs, "doc_id string, page int, ord int, x double, y double, width double, page_width double, str string")
    want = {(f"d{k}", page): f"w{k}.{page}.0 w{k}.{page}.1\nw{k}.{page}.2 w{k}.{page}.3" for k in range(3) for page in (1, 2)} | {("d0", 3): "", ("d0", 4): "kept", (None, None): "no page"}
    pages = pdf.page_texts(glyphs.repartition(1))
    assert {(r.doc_id, r.page): r.text for r in pages.collect()} == want
    assert "FlatMapGroupsInArrow" not in pages._jdf.queryExecution().executedPlan().toString()


def test_pages_of_lines_are_shuffled_once(spark):
    from lawloom.plans import tables

    plan = tables.pdf_rows(spark, "/root/testdata/sf0.001")._jdf.queryExecution().executedPlan().toString()
    assert plan.count("Exchange ") == 1, plan
