"""The text-corpus operators in one thread of plain Python over the same files."""

from __future__ import annotations

from collections import defaultdict

import pyarrow.parquet as pq

from lawloom.llm import canonical, encode, leak, markup

BASELINES: dict = {}


def baseline(f):
    BASELINES[f.__name__] = f
    return f


def rows(d: str, name: str, *columns: str) -> list[tuple]:
    t = pq.read_table(f"{d}/{name}.parquet", columns=list(columns))
    return list(zip(*(t.column(c).to_pylist() for c in columns)))


@baseline
def p3_found(d: str) -> int:
    files = [x for x in rows(d, "files", "file_id", "text") if x[1]]
    return len({(i, k) for (i, _), own in zip(files, markup.kinds([t for _, t in files])) for k in own})


@baseline
def p4_found(d: str) -> int:
    out = set()
    nodes = [("code_node", i, (t,)) for i, t in rows(d, "code_node", "node_id", "text") if t]
    rules = [("cfr_section", i, tuple(ps)) for i, ps in rows(d, "cfr_section", "reg_id", "paragraphs") if ps]
    forms = defaultdict(set)
    for src, i, parts in nodes + rules:
        forms[src, tuple(x if x is None else canonical.canonical(x) for x in parts)].add((i, parts))
    for (src, _), members in forms.items():
        held = sorted(members, key=lambda x: x[0])
        out |= {(src, a, b) for k, (a, x) in enumerate(held) for b, y in held[k + 1 :] if x != y and a != b}
    return len(out)


@baseline
def p6_ids(d: str) -> int:
    encode_one = encode._encoder(f"{encode.TOKENIZERS}/byte_bpe_50k.tiktoken")
    return sum(len(encode_one(t or "")) for _, t in rows(d, "documents", "doc_id", "text"))


@baseline
def p7_found(d: str) -> int:
    runs = defaultdict(set)
    for i, p in rows(d, "eval_item", "item_id", "passage"):
        w = leak.words(p)
        for k in range(len(w) - leak.RUN + 1):
            runs[tuple(w[k : k + leak.RUN])].add(i)
    out = set()
    for doc, text in rows(d, "documents", "doc_id", "text"):
        w = leak.words(text)
        for k in range(len(w) - leak.RUN + 1):
            for i in runs.get(tuple(w[k : k + leak.RUN]), ()):
                out.add((doc, i))
    return len(out)


@baseline
def p8_found(d: str) -> int:
    """Rules of single words and pairs, counted by hand; the scoring is that of the operator."""
    from collections import Counter
    from itertools import combinations

    import numpy as np

    from lawloom.llm import subjects as S

    names = sorted({s for (s,) in rows(d, "subject_area", "subject") if s})
    index = {s: k for k, s in enumerate(names)}
    labels = defaultdict(set)
    for i, s in rows(d, "doc_label", "doc_id", "subject"):
        if i is not None and s in index:
            labels[i].add(s)
    texts = [x for x in rows(d, "documents", "doc_id", "text") if x[1] and not x[1].isspace()]
    sample = [(t, index[next(iter(labels[i]))]) for i, t in texts if len(labels.get(i, ())) == 1]
    docs: Counter = Counter()
    for t, k in sample:
        docs.update((w, k) for w in set(S._words(canonical.canonical(t).lower())))
    total: dict = defaultdict(lambda: np.zeros(len(names)))
    for (w, k), n in docs.items():
        total[w][k] += n
    prior = np.bincount([k for _, k in sample], minlength=len(names)) + 1.0
    prior /= prior.sum()
    number = {w: k for k, w in enumerate(sorted(w for w, n in total.items() if n.sum() >= 2 and (n / n.sum() / prior).max() >= 2))}
    memo, count = S._Items(number), defaultdict(lambda: np.zeros(len(names), int))
    for t, k in sample:
        for s in S.sentences(t):
            items = memo.of(s)
            for p in [(i,) for i in items] + list(combinations(items, 2)):
                count[p][k] += 1
    found = S.prune([(p, n) for p, n in count.items() if n.sum() >= S.MIN_SUPPORT], prior)
    rules = S.Rules(names, number, {p: (k, float(np.log(c / prior[k]))) for p, (k, c) in found.items()}, 0, frozenset(i for p in found if len(p) > 1 for i in p))
    return len({(i, s) for i, t in texts for s in rules.document(t, memo)[0]})
