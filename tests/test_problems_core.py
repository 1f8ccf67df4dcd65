import json
from datetime import datetime

import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from lawloom.operators import compaction, orphans, shred

T = datetime
CITE = "doc_id string, cite_id string, kind string, title string, section string, subsection string, cited_at timestamp_ntz, note string"


def _tables(spark):
    title = spark.createDataFrame([("1", "x")], "title string, heading string")
    sec = spark.createDataFrame(
        [
            ("1", "5-a", "5_a", 0, T(2020, 1, 1), None),
            ("1", "6", "6", 0, T(2020, 1, 1), T(2020, 6, 1)),
            ("1", "6", "6", 0, T(2020, 1, 1), T(2020, 6, 1)),
            ("1", "7", "7", 0, None, None),
            (None, None, None, None, None, None),
        ],
        "title string, section string, slug string, entry int, loaded_at timestamp_ntz, removed_at timestamp_ntz",
    )
    node = spark.createDataFrame([("1", "5_a", "(a)(1)"), ("1", "5_a", None)], "title string, slug string, path string")
    cfr = spark.createDataFrame([("9", "3.1", "2020-02-02"), ("9", "3.1", None)], "title string, number string, as_of string")
    return title, sec, node, cfr


def test_orphans_name_the_first_table_that_fails(spark):
    at = T(2020, 7, 1)
    rows = [
        ("d", "ok", "usc", " 1", "5-\nA", "(a) (1)", at, "n"),
        ("d", "ok", "usc", " 1", "5-\nA", "(a) (1)", at, "n"),
        ("d", "t", "usc", "2", "5", "", at, "n"),
        ("d", "del", "usc", "1", "6", "", at, "n"),
        ("d", "late", "usc", "1", "5–a", "", T(2019, 1, 1), "n"),
        ("d", "miss", "usc", "1", "99", "", at, "n"),
        ("d", "never", "usc", "1", "7", "", at, "n"),
        ("d", "case", "usc", "1", "5_a", "(A)(1)", at, "n"),
        ("d", "blank", "usc", "1", " ", "", at, "n"),
        ("d", "null", "usc", None, "5", "", at, "n"),
        ("d", "act", "act", "1", "99", "", at, "n"),
        ("d", "c1", "cfr", "9", "3.1", "", T(2020, 2, 2), "n"),
        ("d", "c2", "cfr", "9", "3.1", "", T(2020, 2, 1), "n"),
        ("d", "c3", "cfr", "9", "3.2", "", T(2020, 2, 1), "n"),
        ("d", "nodate", "usc", "1", "5-a", "", None, "n"),
        (None, None, None, None, None, None, None, None),
    ]
    got = orphans.find_orphans(spark.createDataFrame(rows, CITE), *_tables(spark)).collect()
    assert sorted((r.cite_id, r.ref_table, r.period, r.reason) for r in got) == [
        ("c2", "cfr_section", "2020-02", "late"),
        ("c3", "cfr_section", "2020-02", "missing"),
        ("case", "code_node", "2020-07", "missing"),
        ("del", "code_section", "2020-07", "deleted"),
        ("late", "code_section", "2019-01", "late"),
        ("miss", "code_section", "2020-07", "missing"),
        ("never", "code_section", "2020-07", "missing"),
        ("nodate", "code_section", None, "late"),
        ("t", "code_title", "2020-07", "missing"),
    ]


def test_orphans_of_empty_tables(spark):
    title, sec, node, cfr = (x.limit(0) for x in _tables(spark))
    cites = spark.createDataFrame([("d", "a", "usc", "1", "1", "", T(2020, 1, 1), "n")], CITE)
    assert [r.ref_table for r in orphans.find_orphans(cites, title, sec, node, cfr).collect()] == ["code_title"]
    assert orphans.find_orphans(cites.limit(0), title, sec, node, cfr).count() == 0


SHARD = "shard_id bigint, grp string, stem string, content string, written_at timestamp_ntz, path string"
INDEX = "idx_id bigint, grp string, parts array<string>, part_bytes array<bigint>, at_list array<struct<stem:string,part_no:int,byte_offset:bigint,byte_length:bigint>>"


def test_packing_holds_each_record_once_and_names_faults(spark, tmp_path):
    rows = [
        (1, "g", "ok", "{é}", T(2020, 1, 2), "p"),
        (1, "g", "ok", "{é}", T(2020, 1, 2), "p"),
        (2, "g", "ok", None, T(2020, 1, 1), "p"),
        (3, "g", "lost", "{}", T(2020, 1, 1), "p"),
        (4, "g", "twice", "{}", T(2020, 1, 1), "p"),
        (5, "g", "part", "{}", T(2020, 1, 1), "p"),
        (6, "g", "over", "{}", T(2020, 1, 1), "p"),
        (7, "g", "size", "{}", T(2020, 1, 1), "p"),
        (8, None, None, None, None, None),
    ]
    at = [("ok", 0, 0, 4), ("twice", 0, 0, 2), ("twice", 0, 0, 2), ("part", 1, 0, 2), ("over", 0, 9, 2), ("size", 0, 0, 3), ("stray", 0, 0, 1)]
    index = spark.createDataFrame([(1, "g", ["x"], [10], at)] * 2 + [(2, "h", None, None, None)], INDEX)
    path = str(tmp_path / "packed")
    packed = compaction.pack_shards(spark.createDataFrame(rows, SHARD), path)
    assert packed.count() == 7
    assert compaction.part_report(spark, path).count() <= 4
    got = {(r.stem, r.fault) for r in compaction.index_faults(packed, index).collect()}
    want = {("lost", "lost"), ("twice", "twice"), ("part", "torn"), ("over", "torn"), ("size", "torn"), ("stray", "stray"), (None, "lost")}
    assert got == want


def test_packing_an_empty_table(spark, tmp_path):
    packed = compaction.pack_shards(spark.createDataFrame([], SHARD), str(tmp_path / "none"))
    assert packed.count() == 0
    assert compaction.index_faults(packed, spark.createDataFrame([], INDEX)).count() == 0


def test_checksum_sees_a_changed_or_doubled_row(spark):
    a = spark.createDataFrame([("a", 1), ("b", 2)], "x string, y int")
    assert compaction.checksum(a) == compaction.checksum(a.orderBy("y", ascending=False))
    assert compaction.checksum(a) != compaction.checksum(a.union(a.limit(1)))
    assert compaction.checksum(a) != compaction.checksum(a.replace(1, 3))


def brute(shard_id, content):
    out = []
    try:
        record = json.loads(content)
    except ValueError:
        return out

    def objects(v):
        if isinstance(v, str):
            try:
                v = json.loads(v)
            except ValueError:
                return []
        v = [v] if isinstance(v, dict) else v if isinstance(v, list) else []
        return [x for x in v if x and isinstance(x, dict)]

    def walk(nodes, entry, parent, above):
        for x in objects(nodes):
            ord_ = counter[0]
            counter[0] += 1
            path = x.get("path") or above + (x.get("marker") or "")
            out.append((shard_id, entry, ord_, parent, path))
            walk(x.get("children"), entry, ord_, path)

    if isinstance(record, dict):
        others = record.get("also")
        others = [others] if isinstance(others, dict) else others or []
        for k, x in enumerate([record, *others]):
            counter = [0]
            if isinstance(x, dict):
                walk(x.get("tree"), k, -1, "")
    return out


node = st.deferred(
    lambda: st.fixed_dictionaries(
        {},
        optional={
            "marker": st.sampled_from(["(a)", "(1)", None]),
            "path": st.sampled_from(["(z)", "", None]),
            "children": st.one_of(st.none(), kids, kids.map(json.dumps), node, node.map(json.dumps)),
        },
    )
)
kids = st.lists(st.one_of(node, st.none()), max_size=3)


@settings(max_examples=150, deadline=None)
@given(st.lists(st.fixed_dictionaries({}, optional={"tree": kids, "also": st.lists(st.fixed_dictionaries({"tree": kids}), max_size=2)}), max_size=4))
def test_shredding_agrees_with_a_recursive_walk(records):
    contents = [json.dumps(r) for r in records] + [None, "", "{", "[]", "3"]
    b = shred.shred_batch(list(range(len(contents))), contents, ("path", "marker"))
    got = sorted(zip(*(b.column(k).to_pylist() for k in range(5))))
    assert got == sorted(x for k, c in enumerate(contents) if c for x in brute(k, c))


@pytest.mark.parametrize("sf", ["sf0.001"])
def test_shredding_whole_table(spark, sf):
    t = spark.read.parquet(f"/root/testdata/{sf}/shard_file.parquet")
    got = {tuple(r) for r in shred.provisions(t).collect()}
    want = {x for r in t.select("shard_id", "content").collect() if r.content for x in brute(r.shard_id, r.content)}
    assert got == want and got


def test_very_deep_records_are_shredded():
    n = 6000
    chain = '{"path":"p","children":[' * n + "]}" * n
    text = json.dumps({"path": "q", "text": 0})[:-2] + '{"x":[' * n + "1" + "]}" * n + "}"
    contents = [f'{{"tree":{chain}}}', json.dumps({"tree": [{"marker": "(a)", "children": chain}]}), json.dumps({"tree": chain}), f'{{"tree":{chain}', f'{{"tree":[{text}]}}']
    b = shred.shred_batch([1, 2, 3, 4, 5], contents, ("path", "marker", "text"))
    got = list(zip(*(b.column(k).to_pylist() for k in range(5))))
    for shard_id, rows in ((1, n), (2, n + 1), (3, n)):
        assert sorted(r[2:4] for r in got if r[0] == shard_id) == [(k, k - 1) for k in range(rows)]
    assert sum(r[0] == 4 for r in got) == 0 and sum(r[0] == 5 for r in got) == 1
    assert b.column(6).to_pylist()[got.index((5, 0, 0, -1, "q"))] == ('{"x": [' * n + "1" + "]}" * n)


def test_levels_of_leaf_columns():
    """Repetition: 0 a file, 1 an entry, 2 + k a sibling at depth k. Definition: ancestors that exist, then absent, null, value."""
    record = {"tree": [{"path": "p", "children": [{"path": None}, {"marker": "x"}, {}]}, {"path": ""}], "notes": [{"text": "a"}, {"topic": "t"}], "also": [3, {"section": "9"}]}
    s = shred._shredded(shred.Shredder(entry=("section",), note=("text",), leaves=("path", "marker")), [7], [json.dumps(record)])
    column = s.depths[0].columns["path"]
    assert (column.rep, column.full, column.values) == ([0, 2, 1, 1], [4, 4, 0, 1], ["p", ""])
    column = s.depths[1].columns["path"]
    assert (column.rep, column.full, column.values) == ([0, 3, 2], [4, 3, 2], [])
    assert (s.entry.columns["section"].rep, s.entry.columns["section"].full) == ([0, 1, 1], [1, 0, 3])
    assert (s.note.columns["text"].rep, s.note.columns["text"].full) == ([0, 2, 1, 1], [4, 2, 0, 1])
    contents = [json.dumps(record), "{", None, json.dumps({"notes": '{"text":"z"}'})]
    assert [tuple(r.values()) for r in shred.note_batch([7, 8, 9, 10], contents).to_pylist()] == [(7, 0, 0, None, None, "a"), (7, 0, 1, "t", None, None), (10, 0, 0, None, None, "z")]
    assert [(r["shard_id"], r["entry"], r["section"]) for r in shred.entry_batch([7, 8, 9, 10], contents).to_pylist()] == [(7, 0, None), (7, 2, "9"), (10, 0, None)]
    assert shred.shred_batch([7], contents[:1], ("path", "marker"), True).column("path_is").to_pylist() == ["value", "value", "null", "absent"]


def test_compaction_leaves_the_old_table_if_it_fails(spark, tmp_path, monkeypatch):
    path = str(tmp_path / "t")
    a, b = (spark.createDataFrame([(x, k) for k in range(9)], "x string, y int") for x in "ab")
    size = spark.conf.get("spark.sql.adaptive.advisoryPartitionSizeInBytes")
    assert compaction.compact(a, path).count() == 9 and compaction.read_compacted(spark, path).select("x").distinct().first().x == "a"
    with monkeypatch.context() as m:
        m.setattr(compaction, "_point_to", lambda *_: 1 / 0)
        with pytest.raises(ZeroDivisionError):
            compaction.compact(b, path)
    assert compaction.read_compacted(spark, path).select("x").distinct().first().x == "a"
    with monkeypatch.context() as m:
        m.setattr(compaction, "checksum", lambda _, seen=iter(range(9)): {"n": next(seen)})
        with pytest.raises(compaction.ChecksumMismatch):
            compaction.compact(b, path)
    assert compaction.read_compacted(spark, path).count() == 9
    assert compaction.compact(b, path, 1 << 20).count() == 9 and {r.x for r in compaction.read_compacted(spark, path).collect()} == {"b"}
    assert spark.conf.get("spark.sql.adaptive.advisoryPartitionSizeInBytes") == size
    with pytest.raises(FileNotFoundError):
        compaction.read_compacted(spark, str(tmp_path / "none"))


values = st.recursive(st.one_of(st.none(), st.booleans(), st.integers(), st.floats(allow_nan=False), st.text()), lambda x: st.one_of(st.lists(x), st.dictionaries(st.text(), x)))


@settings(max_examples=300, deadline=None)
@given(values, st.integers(0, 60), st.sampled_from(["", ",", "]", "}", "{", "[", ":", '"', " ", "1", "\u00a0"]))
def test_the_deep_reader_and_writer_agree_with_json(value, at, more):
    text = json.dumps(value, ensure_ascii=False)
    assert shred._written(value) == text and shred._deep(f" {text}\n") == value
    text = text[:at] + more + text[at + len(more) :]
    try:
        want = json.loads(text)
    except ValueError:
        with pytest.raises(ValueError):
            shred._deep(text)
    else:
        assert shred._deep(text) == want


def brute_leaves(shard_id, content):
    """(shard_id, entry, ord) to marker, heading and text, by a recursive walk that numbers as ``brute`` does."""

    def objects(v):
        if isinstance(v, str):
            try:
                v = json.loads(v)
            except ValueError:
                return []
        v = [v] if isinstance(v, dict) else v if isinstance(v, list) else []
        return [x for x in v if x and isinstance(x, dict)]

    def leaf(v):
        if isinstance(v, list):
            return "\n".join(x for x in map(leaf, v) if x is not None)
        return v if v is None or isinstance(v, str) else json.dumps(v, ensure_ascii=False)

    def walk(nodes):
        for x in objects(nodes):
            yield tuple(leaf(x.get(n)) for n in ("marker", "heading", "text"))
            yield from walk(x.get("children"))

    try:
        record = json.loads(content)
    except ValueError:
        return {}
    if not isinstance(record, dict):
        return {}
    others = record.get("also")
    others = [others] if isinstance(others, dict) else others or []
    trees = [x.get("tree") if isinstance(x, dict) else None for x in (record, *others)]
    return {(shard_id, k, n): x for k, t in enumerate(trees) for n, x in enumerate(walk(t))}


@pytest.mark.parametrize("sf", ["sf0.001", "sf0.01"])
def test_full_provision_table(spark, sf):
    from lawloom.plans import catalogue

    rows = catalogue.queries()["p5_provisions"](spark, f"/root/testdata/{sf}").collect()
    t = [r for r in spark.read.parquet(f"/root/testdata/{sf}/shard_file.parquet").select("shard_id", "content").collect() if r.content]
    place = {x[:3]: x for r in t for x in brute(r.shard_id, r.content)}
    leaves = {k: v for r in t for k, v in brute_leaves(r.shard_id, r.content).items()}
    assert {tuple(r)[:-1] for r in rows} == {place[k] + v for k, v in leaves.items()} and len(rows) == len(place) == len(leaves)
    assert {r.path_is for r in rows} <= {"value", "absent", "null"}
    assert sum(bool(r.text) for r in rows) > 0.5 * len(rows)
