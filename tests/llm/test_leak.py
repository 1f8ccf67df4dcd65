import random

import numpy as np
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from lawloom.llm import leak

DOC = "doc_id bigint, text string, item_id int"
ITEM = "item_id bigint, suite string, passage string, question string, answer string"


def brute(docs, items):
    found = set()
    for i, _, p, _, _ in items:
        w = leak.words(p)
        runs = {tuple(w[k : k + leak.RUN]) for k in range(len(w) - leak.RUN + 1)}
        for d, t, _ in docs:
            x = leak.words(t)
            if any(tuple(x[k : k + leak.RUN]) in runs for k in range(len(x) - leak.RUN + 1)):
                found.add((d, i))
    return found


def test_runs_of_every_length_and_alignment(spark):
    rng = random.Random(3)
    vocabulary = [f"w{k}" for k in range(40)]
    items = [(k, "s", " ".join(rng.choices(vocabulary, k=60)), "q", "w1") for k in range(6)]
    items += [(90, "s", None, None, None), (91, "s", "", "", ""), (92, "s", "too short", "q", None), (93, None, items[0][2], "q", "w1")]
    docs = []
    for k in range(120):
        w = rng.choice(items[:6])[2].split()
        n, at = rng.choice([13, 14, 15, 16, 30]), rng.randrange(30)
        noise = [f"x{rng.randrange(9)}" for _ in range(rng.randrange(40))]
        docs.append((k, " ".join(noise) + ",\n" + "  ".join(w[at : at + n]).upper() + " y" * rng.randrange(3), 0))
    docs += [(200, None, 0), (201, "", 0), (202, items[1][2].replace("w", "ｗ").replace(" ", "​ "), 0), docs[0], docs[0]]
    docs.append((203, items[2][2] + " z" * 30_000, 0))
    d, e = spark.createDataFrame(docs, DOC), spark.createDataFrame(items + items[:1], ITEM)
    got = leak.find_leaks(d, e).collect()
    assert len(got) == len({tuple(r) for r in got}) and {tuple(r) for r in got} == brute(docs, items)
    assert (202, 1) in brute(docs, items)


def test_blocks_and_long_passages(spark, monkeypatch):
    """Many small blocks, and passages longer than one, find what one block finds."""
    monkeypatch.setattr(leak, "BLOCK_WORDS", 40)
    rng = random.Random(8)
    vocabulary = [f"w{k}" for k in range(60)]
    items = [(k, "s", " ".join(rng.choices(vocabulary, k=n)), "q", "w1") for k, n in enumerate([20, 39, 40, 41, 150, 15, 14, 3])]
    docs = []
    for k in range(60):
        w = rng.choice(items[:5])[2].split()
        n, at = rng.choice([14, 15, 22]), rng.randrange(len(w))
        docs.append((k, "y " + " ".join(w[at : at + n]) + " z", 0))
    d, e = spark.createDataFrame(docs, DOC), spark.createDataFrame(items, ITEM)
    assert len(list(leak._blocks(e, True))) > 5
    got = [tuple(r) for r in leak.find_leaks(d, e).collect()]
    assert len(got) == len(set(got)) and set(got) == brute(docs, items) and got


def test_empty_tables(spark):
    d = spark.createDataFrame([(1, "a b c", 0)], DOC)
    e = spark.createDataFrame([(1, "s", "a " * 20, "q", "a")], ITEM)
    assert leak.find_leaks(d.limit(0), e).count() == 0
    assert leak.find_leaks(d, e.limit(0)).count() == 0


def test_paraphrase_report(spark):
    passage = " ".join(f"t{k}" for k in range(60))
    other = passage.split()
    for k in range(12, 60, 13):
        other[k] = "changed"
    d = spark.createDataFrame([(1, "so it is " + " ".join(other), 0), (2, "nothing of it", 0)], DOC)
    e = spark.createDataFrame([(5, "s", passage, "q", "t3 t4")], ITEM)
    assert leak.find_leaks(d, e).count() == 0
    (r,) = leak.find_paraphrases(d, e).collect()
    assert (r.doc_id, r.item_id, r.has_answer) == (1, 5, True) and r.lcs_share > 0.9


@settings(max_examples=200, deadline=None)
@given(st.lists(st.integers(1, 4), max_size=12), st.lists(st.integers(1, 4), max_size=12))
def test_common_subsequence(a, b):
    t = np.zeros((len(a) + 1, len(b) + 1), int)
    for i, x in enumerate(a):
        for j, y in enumerate(b):
            t[i + 1, j + 1] = t[i, j] + 1 if x == y else max(t[i, j + 1], t[i + 1, j])
    assert leak.common_subsequence(a, b) == t[-1, -1]


@pytest.mark.parametrize("sf", ["sf0.001"])
def test_whole_tables(spark, sf):
    d, e = (spark.read.parquet(f"/root/testdata/{sf}/{t}.parquet") for t in ("documents", "eval_item"))
    docs = [(r.doc_id, r.text, 0) for r in d.collect()]
    items = [(r.item_id, r.suite, r.passage, r.question, r.answer) for r in e.collect()]
    assert {tuple(r) for r in leak.find_leaks(d, e).collect()} == brute(docs, items)


def brute_paraphrases(docs, items, numbered, retriever, min_windows=2, min_share=0.6):
    """Cosines of all windows of all documents with all windows of all passages, nothing left out before."""
    number, found = numbered, set()
    latent = retriever.latent.astype(np.int64)
    for i, p in items:
        a = [number[w] for w in leak.words(p)]
        x = latent[leak._windows(np.array(a))].sum(axis=1).astype(float)
        for d, t in docs:
            b = [number.get(w, 0) for w in leak.words(t)]
            y = latent[leak._windows(np.array(b))].sum(axis=1).astype(float)
            near = y @ x.T >= leak.MIN_COSINE * np.outer(np.linalg.norm(y, axis=1), np.linalg.norm(x, axis=1)) - 1e-9
            near &= (np.linalg.norm(y, axis=1) > 0)[:, None] & (np.linalg.norm(x, axis=1) > 0)
            starts = np.flatnonzero(near.any(axis=1))
            if len(starts) >= min_windows:
                around = [b[max(0, k * leak.BLOCK - len(a)) : (k + 1) * leak.BLOCK + leak.WINDOW - 1 + len(a)] for k in set((starts // leak.BLOCK).tolist())]
                if max(leak.common_subsequence(a, n) for n in around) >= min_share * len(a) - 1e-9:
                    found.add((d, i))
    return found


def test_paraphrases_of_stated_passages(spark):
    rng = random.Random(4)
    e = spark.read.parquet("/root/testdata/sf0.01/eval_item.parquet").where("passage is not null").orderBy("item_id").limit(40)
    items = [(r.item_id, r.suite, r.passage, r.question, r.answer) for r in e.collect()]
    docs = []
    for d, (_, _, p, _, _) in enumerate(items):
        w = leak.words(p)
        for k in range(0, len(w), 8):  # one word of eight is another one, most often one that no item has
            w[min(len(w) - 1, k + rng.randrange(8))] = rng.choice(["quokka", "zzz", w[0]])
        before, after = (" ".join(rng.choices(["quokka", "of", "the", "act"], k=rng.randrange(200))) for _ in range(2))
        docs.append((d, f"{before} {' '.join(w)} {after}", 0))
    docs.append((99, None, 0))
    d, e = spark.createDataFrame(docs, DOC), spark.createDataFrame(items, ITEM)
    got = {(r.doc_id, r.item_id) for r in leak.find_paraphrases(d, e).collect()}
    assert len(got & {(k, x[0]) for k, x in enumerate(items)}) >= 0.9 * len(items)
    ((vocabulary, block),) = leak._blocks(e, False)
    hashed = leak.hash_words(d)
    retriever, _ = leak._prepared(hashed, hashed.count(), vocabulary, block)
    number = {}
    for _, _, p, _, a in items:
        for w in leak.words(p) + leak.words(a):
            number.setdefault(w, len(number) + 1)
    assert got == brute_paraphrases([x[:2] for x in docs if x[1]], [(x[0], x[2]) for x in items], number, retriever)
