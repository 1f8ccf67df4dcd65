from itertools import combinations

import numpy as np
from hypothesis import given, settings
from hypothesis import strategies as st

from lawloom.llm import subjects

DOC = "doc_id bigint, text string, subject int"
LABEL = "doc_id bigint, subject string, annotator string"


def test_sentences():
    text = "SEC. 4. A HEADING\n\n    (1) The board shall meet\ntwice a year. (2) It may not rest at all.\n    (3) Whoever comes is seen. Too short."
    assert [s.split()[-1] for s in subjects.sentences(text)] == ["year.", "all.", "seen."]


@settings(max_examples=100, deadline=None)
@given(st.lists(st.tuples(st.sets(st.integers(0, 6), max_size=5), st.integers(0, 1)), max_size=25))
def test_growth_finds_every_frequent_pattern(rows):
    want = {}
    for items, k in rows:
        for n in (1, 2):
            for p in combinations(sorted(items), n):
                want.setdefault(p, [0, 0])[k] += 1
    want = {p: n for p, n in want.items() if sum(n) >= 2}
    got = {}
    for g in range(3):  # three groups
        base = {}
        for items, k in rows:
            items = sorted(items)
            last = max((j for j, i in enumerate(items) if i % 3 == g), default=-1)
            if last >= 0:
                base.setdefault(tuple(items[: last + 1]), np.zeros(2, int))[k] += 1
        out = []
        subjects.grow(base, (), lambda i: i % 3 == g, 2, 2, out)
        got.update({p: n.tolist() for p, n in out})
    assert got == want


def test_redundant_rules_go():
    prior = np.array([0.5, 0.5])
    rules = subjects.prune([((1,), np.array([10, 0])), ((1, 2), np.array([5, 0])), ((2,), np.array([5, 5])), ((2, 3), np.array([0, 4]))], prior)
    assert {p: k for p, (k, _) in rules.items()} == {(1,): 0, (2, 3): 1}


def _corpus(spark):
    farm, rail = "The farmer shall count each cow and plough number {}.", "The driver shall steer each train over rail number {}."
    formal = "This title takes effect on that very day."
    docs = [(k, " ".join([(farm if k % 2 else rail).format(j) for j in range(5)] + [formal]), 0) for k in range(40)]
    labels = [(k, "farming" if k % 2 else "transport", "a") for k in range(30)] + [(0, "transport", "b"), (77, "farming", "a"), (3, None, "a"), (None, "farming", "a")]
    mixed = " ".join([farm.format(1), farm.format(2), rail.format(1), rail.format(2), formal])
    mention = " ".join([farm.format(j) for j in range(9)] + [rail.format(1)])
    docs += [(50, mixed, 0), (51, mention, 0), (52, None, 0), (53, " \n", 0), (54, "", 0), (55, "第二十条", 0), (56, "cow", 0), (57, farm.format(1) * 3000, 0)]
    areas = [("farming", ""), ("transport", ""), ("energy", "")]
    return spark.createDataFrame(docs + docs[:2], DOC), spark.createDataFrame(labels, LABEL), spark.createDataFrame(areas, "subject string, description string")


def test_documents_get_their_subjects(spark):
    d, labels, areas = _corpus(spark)
    rules = subjects.fit_rules(d, labels, areas)
    assert len(rules.formal) == 1
    rows = subjects.find_subjects(d, rules).collect()
    got = {(r.doc_id, r.subject) for r in rows}
    assert len(got) == len(rows)
    assert {x for x in got if x[0] < 40} == {(k, "farming" if k % 2 else "transport") for k in range(40)}
    assert {x for x in got if x[0] >= 50 and x[0] != 55} == {(50, "farming"), (50, "transport"), (51, "farming"), (56, "farming"), (57, "farming")}
    assert sum(x[0] == 55 for x in got) == 1
    assert sum(r.documents for r in subjects.composition(subjects.find_subjects(d, rules), d).collect()) == len(got)


def test_empty_tables(spark):
    d, labels, areas = _corpus(spark)
    assert subjects.find_subjects(d.limit(0), subjects.fit_rules(d, labels, areas)).count() == 0
    one = subjects.find_subjects(d.where("doc_id = 1"), subjects.fit_rules(d, labels.limit(0), areas)).collect()
    assert len(one) == 1
    assert subjects.find_subjects(d, subjects.fit_rules(d, labels, areas.limit(0))).count() == 0


def test_agreement_with_held_out_labels(spark):
    t = {n: spark.read.parquet(f"/root/testdata/sf0.1/{n}.parquet") for n in ("documents", "doc_label", "subject_area")}
    held = t["doc_label"].where("doc_id % 4 = 0")
    rules = subjects.fit_rules(t["documents"], t["doc_label"].where("doc_id % 4 <> 0"), t["subject_area"])
    want = {(r.doc_id, r.subject) for r in held.select("doc_id", "subject").distinct().collect()}
    texts = t["documents"].join(held.select("doc_id").distinct(), "doc_id")
    got = {(r.doc_id, r.subject) for r in subjects.find_subjects(texts, rules).collect()}
    assert len(got & want) > 0.92 * len(got) and len(got & want) > 0.92 * len(want)


@settings(max_examples=100, deadline=None)
@given(st.lists(st.tuples(st.sets(st.integers(0, 5), max_size=5), st.integers(0, 1)), max_size=25))
def test_growth_ends_without_losing_a_rule(rows):
    base = {}
    for items, k in rows:
        if items:
            base.setdefault(tuple(sorted(items)), np.zeros(2, int))[k] += 1
    every, grown, prior = [], [], np.array([0.5, 0.5])
    subjects.grow(base, (), lambda _: True, 2, 6, every)
    subjects.grow(base, (), lambda _: True, 2, None, grown, subjects.mixed)
    assert subjects.prune(grown, prior) == subjects.prune(every, prior)


def test_rules_of_three_words(spark):
    rows = [((0, 1, 2), 0)] * 9 + [(x, 1) for x in ((0, 1), (0, 2), (1, 2)) for _ in range(9)]
    t = spark.createDataFrame([(g, list(x), k) for x, k in rows for g in x], "grp int, items array<int>, label int")
    patterns = {tuple(r["items"]): np.array(r["counts"]) for r in subjects.mine(t, 2).collect()}
    rules = subjects.prune(list(patterns.items()), np.array([0.5, 0.5]))
    assert rules[0, 1, 2][0] == 0
    r = subjects.Rules(["a", "b"], {}, rules, joint=frozenset({0, 1, 2}))
    assert 0 in r.evidence((0, 1, 2)) and 0 not in r.evidence((0, 1))
