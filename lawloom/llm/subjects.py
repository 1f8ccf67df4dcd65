"""Subject areas of documents by class-association rules.

1. Sentences of a bounded sample of labelled documents become transactions: their words that lean to some subject, and the subject of
   a document that has only one label. Formal phrases, which come back word for word under many subjects, are about none.
2. Frequent patterns with their class counts are mined by parallel pattern growth: every transaction is cut into conditional
   transactions per group of items, each group grows its own patterns, so no task needs the whole sample.
3. A pattern becomes a rule for its leading subject if its smoothed confidence suffices; a rule that does not beat a more
   general rule of the same subject is redundant and goes. Rules mined from four fifths of the sample are held against the rest: how
   often rules of some confidence are right there, made monotonous, is the calibrated confidence. The evidence of a rule is the log
   lift of its calibrated confidence.
4. The rules are few and travel to all executors. There every sentence of every document is given to the subject with the most
   evidence, and a document has the subjects that a sixth or more of its sentences are about.

Only the sample for steps 1 to 3 is bounded (MAX_LABELLED documents, those of the smallest hash); step 4 covers all documents and
whole texts without a shuffle.

Defined results: null and blank texts have no row; a text in which no rule matches has the subject whose rules matched most over its
words anywhere in it, and failing all evidence the most frequent subject of the sample (``basis`` tells such guesses apart: share, most,
words, prior); at most three subjects, ties to the more evidence,
then the name; labels that are null or of unknown documents are ignored; repeated rows count once; extra columns are ignored.
"""

from __future__ import annotations

import re
from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass, field
from itertools import combinations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from lawloom.llm.canonical import canonical
from lawloom.session import spread

#: Labelled documents from which rules are mined.
MAX_LABELLED = 4000
#: A pattern needs so many sentences, a rule so much confidence.
MIN_SUPPORT = 2
MIN_CONFIDENCE = 0.6
#: Least evidence that gives a sentence a subject.
MIN_EVIDENCE = 1.0
#: Share of sentences that makes a subject, and the most subjects.
SHARE = 1 / 6
MOST = 3
GROUPS = 64
MEMO = 1_000_000

_breaks = re.compile(r"\n[^\S\n]*\n\s*|(?:(?<=[.!?])|(?<=[.!?][\"”’)]))\s+(?=[\"“‘(¿¡]*[A-ZÀ-ÞŒ]|\(\w{1,5}\)\s)").split
_words = re.compile(r"[^\W\d_]{3,}").findall


_enumerator = re.compile(r"\s*\(\w{1,5}\)\s").match
_runs = re.compile(r"\w+").findall


def phrase(sentence: str) -> str:
    """The words of a sentence, without a number before it."""
    m = _enumerator(sentence)
    return " ".join(_runs(canonical(sentence[m.end() :] if m else sentence).lower()))


def sentences(text: str) -> list[str]:
    """Pieces of running text: without headings in capitals and pieces of fewer than four chunks."""
    out = []
    for s in _breaks(text):
        if s.count(" ") + s.count("\n") >= 3 and not s.isupper():
            out.append(s)
    return out


class _Items(dict):
    """Chunk between white space to the numbers of its items."""

    def __init__(self, number: dict[str, int]) -> None:
        self.number = number

    def __missing__(self, chunk: str) -> tuple[int, ...]:
        if len(self) > MEMO:
            self.clear()
        n = self.number
        found = self[chunk] = tuple(n[w] for w in _words(canonical(chunk).lower()) if w in n)
        return found

    def of(self, sentence: str) -> tuple[int, ...]:
        get = self.__getitem__
        return tuple(sorted({i for c in sentence.split() for i in get(c)}))


@dataclass
class Rules:
    subjects: list[str]
    number: dict[str, int]
    #: pattern to (subject, evidence)
    rules: dict[tuple[int, ...], tuple[int, float]]
    prior: int = 0
    #: items that begin a rule of several words
    joint: frozenset = field(default_factory=frozenset)
    #: formal phrases, and the most chunks of one
    formal: frozenset = field(default_factory=frozenset)
    formal_chunks: int = 0
    #: first item to the rules of several words that begin with it
    longer: dict[int, list[tuple[int, ...]]] = field(init=False, default_factory=dict)

    def __post_init__(self) -> None:
        for p in self.rules:
            if len(p) > 1:
                self.longer.setdefault(p[0], []).append(p)

    def evidence(self, items: tuple[int, ...]) -> dict[int, float]:
        total: dict[int, float] = {}
        rules = self.rules
        for i in items:
            if r := rules.get((i,)):
                total[r[0]] = total.get(r[0], 0.0) + r[1]
        held = self.joint.intersection(items)
        longer = [p for i in held for p in self.longer.get(i, ()) if held.issuperset(p)]
        for p in sorted(longer, key=lambda p: (len(p), p)):
            r = rules[p]
            total[r[0]] = total.get(r[0], 0.0) + r[1]
        return total

    def subject(self, items: tuple[int, ...]) -> int:
        total = self.evidence(items)
        if not total:
            return -1
        best = max(total, key=lambda k: (total[k], -k))
        return best if total[best] >= MIN_EVIDENCE else -1

    def sentence(self, s: str, memo: _Items) -> int:
        if self.formal and len(s.split()) <= self.formal_chunks and phrase(s) in self.formal:
            return -1
        return self.subject(memo.of(s))

    def document(self, text: str, memo: _Items) -> tuple[list[str], str]:
        """Subjects, and what they rest on: the share of sentences, the most sentences, words anywhere, or the sample's most frequent one."""
        found = [self.sentence(s, memo) for s in sentences(text)]
        count = Counter(k for k in found if k >= 0)
        least = SHARE * len(found) - 1e-9
        names = [self.subjects[k] for k, n in sorted(count.items(), key=lambda x: (-x[1], x[0])) if n >= least][:MOST]
        if names:
            return names, "share"
        if count:
            return [self.subjects[min(count, key=lambda k: (-count[k], k))]], "most"
        total = self.evidence(memo.of(text))
        if total:
            return [self.subjects[max(total, key=lambda k: (total[k], -k))]], "words"
        return [self.subjects[self.prior]], "prior"


def _sample(documents: DataFrame, doc_label: DataFrame, subjects: list[str], most: int) -> DataFrame:
    """doc_id, text, labels of the labelled documents with the smallest hashes."""
    labels = (
        doc_label.where(F.col("subject").isin(subjects) & F.col("doc_id").isNotNull())
        .groupBy("doc_id")
        .agg(F.sort_array(F.collect_set("subject")).alias("labels"))
        .orderBy(F.xxhash64("doc_id"), "doc_id")
        .limit(most)
    )
    texts = documents.where("text is not null").select("doc_id", "text")
    return labels.join(texts, "doc_id").select("doc_id", "text", "labels")


def _word_classes(sample: DataFrame, index: dict[str, int]) -> DataFrame:
    """word, label number, documents with it; of documents with one label."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        count: Counter = Counter()
        for b in batches:
            for text, labels in zip(b.column(0).to_pylist(), b.column(1).to_pylist()):
                if len(labels) == 1:
                    count.update((w, index[labels[0]]) for w in {*_words(canonical(text).lower())})
        keys = list(count)
        yield pa.RecordBatch.from_arrays(
            [pa.array([w for w, _ in keys], pa.string()), pa.array([k for _, k in keys], pa.int32()), pa.array(count.values(), pa.int64())],
            names=["word", "label", "docs"],
        )

    counted = sample.select("text", "labels").mapInArrow(run, "word string, label int, docs bigint")
    return counted.groupBy("word", "label").agg(F.sum("docs").alias("docs"))


def leaning_words(sample: DataFrame, subjects: list[str], min_docs: int = 2, min_lift: float = 2.0) -> dict[str, int]:
    """Numbers of the words that stand in documents of one subject clearly more often than such documents are."""
    index = {s: k for k, s in enumerate(subjects)}
    docs = np.zeros(len(subjects))
    for r in sample.where("size(labels) = 1").groupBy(F.col("labels")[0].alias("s")).count().collect():
        docs[index[r["s"]]] = r["count"]
    prior = (docs + 1) / (docs.sum() + len(subjects))
    byword: dict[str, np.ndarray] = {}
    for r in _word_classes(sample, index).collect():  # the vocabulary of the bounded sample
        byword.setdefault(r.word, np.zeros(len(subjects)))[r.label] = r.docs
    kept = [w for w, n in byword.items() if n.sum() >= min_docs and (n / n.sum() / prior).max() >= min_lift]
    return {w: k for k, w in enumerate(sorted(kept, key=lambda w: (-byword[w].sum(), w)))}


def formal_phrases(sample: DataFrame, subjects: list[str], min_docs: int = 4, most: float = 0.5) -> frozenset[str]:
    """Sentences that come back word for word in documents of many subjects."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            pairs = [(p, x[0]) for t, x in zip(b.column(0).to_pylist(), b.column(1).to_pylist()) if len(x) == 1 for p in {phrase(s) for s in sentences(t)}]
            yield pa.RecordBatch.from_arrays([pa.array([p for p, _ in pairs], pa.string()), pa.array([x for _, x in pairs], pa.string())], names=["phrase", "label"])

    told = sample.select("text", "labels").mapInArrow(run, "phrase string, label string").groupBy("phrase", "label").count()
    spread = told.groupBy("phrase").agg(F.sum("count").alias("docs"), F.max("count").alias("one"))
    return frozenset(r.phrase for r in spread.where((F.col("docs") >= min_docs) & (F.col("one") <= most * F.col("docs"))).collect())


def _held_out() -> Column:
    """Sentences of a fifth of the sample's documents, which rules are held against."""
    return F.pmod(F.xxhash64(F.lit(3), "doc_id"), F.lit(5)) == 0


def _sentence_items(sample: DataFrame, number: dict[str, int], subjects: list[str], formal: frozenset) -> DataFrame:
    """doc_id, own (numbers of the document's labels), items: the sentences of the sample but for formal phrases. Read once for all rounds."""
    index = {s: k for k, s in enumerate(subjects)}

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        memo = _Items(number)
        for b in batches:
            ids, owns, lists = [], [], []
            for doc_id, text, labels in zip(*(b.column(k).to_pylist() for k in range(3))):
                own = [index[x] for x in labels]
                for s in sentences(text):
                    if phrase(s) not in formal:
                        ids.append(doc_id)
                        owns.append(own)
                        lists.append(memo.of(s))
            yield pa.RecordBatch.from_arrays([pa.array(ids, pa.int64()), pa.array(owns, pa.list_(pa.int32())), pa.array(lists, pa.list_(pa.int32()))], names=["doc_id", "own", "items"])

    return sample.select("doc_id", "text", "labels").mapInArrow(run, "doc_id bigint, own array<int>, items array<int>")


def _transactions(split: DataFrame, told: Rules | None, held_out: int = 0) -> DataFrame:
    """grp, items, label: the conditional transactions of each group. With ``told``, also sentences of documents with several labels. Labels of sentences held out are raised by ``held_out``."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            groups, lists, classes = [], [], []
            for own, items, out in zip(*(b.column(k).to_pylist() for k in range(3))):
                label = told.subject(tuple(items)) if told else own[0] if len(own) == 1 else -1
                if label not in own:
                    continue
                label += held_out * out
                seen = set()
                for k in range(len(items) - 1, -1, -1):
                    g = items[k] % GROUPS
                    if g not in seen:
                        seen.add(g)
                        groups.append(g)
                        lists.append(items[: k + 1])
                        classes.append(label)
            yield pa.RecordBatch.from_arrays(
                [pa.array(groups, pa.int32()), pa.array(lists, pa.list_(pa.int32())), pa.array(classes, pa.int32())], names=["grp", "items", "label"]
            )

    return split.select("own", "items", _held_out().cast("int")).mapInArrow(run, "grp int, items array<int>, label int")


def grow(base: dict[tuple[int, ...], np.ndarray], suffix: tuple[int, ...], wanted, min_support: int, max_words: int | None, out: list, worth=lambda n: True) -> None:
    """Patterns that end in ``suffix`` from its conditional base (item prefixes with class counts), longer ones where ``worth`` of the counts says so."""
    count: dict[int, np.ndarray] = {}
    for prefix, n in base.items():
        for i in prefix:
            if wanted(i):
                count[i] = count[i] + n if i in count else n
    for i, n in count.items():
        if n.sum() < min_support:
            continue
        pattern = (i, *suffix)
        out.append((pattern, n))
        if (max_words is None or len(pattern) < max_words) and worth(n):
            below: dict[tuple[int, ...], np.ndarray] = {}
            for prefix, m in base.items():
                if i in prefix and (p := prefix[: prefix.index(i)]):
                    below[p] = below[p] + m if p in below else m
            if below:
                grow(below, pattern, lambda _: True, min_support, max_words, out, worth)


def mixed(n: np.ndarray) -> bool:
    """Whether a longer pattern can be a rule that is not redundant: one of a single class only loses confidence as it grows."""
    return np.count_nonzero(n) > 1


def mine(transactions: DataFrame, classes: int, min_support: int = MIN_SUPPORT, max_words: int | None = None, parts: int = 1) -> DataFrame:
    """items, counts by class; without the patterns that hold one of a single class, which would be redundant. Of several ``parts``, whose labels follow one another, all counts are given."""

    def run(key: tuple[pa.Scalar, ...], t: pa.Table) -> pa.Table:
        g = key[0].as_py()
        base: dict[tuple[int, ...], np.ndarray] = {}
        for items, label in zip(t.column("items").to_pylist(), t.column("label").to_pylist()):
            base.setdefault(tuple(items), np.zeros(parts * classes, np.int64))[label] += 1
        out: list = []
        grow(base, (), lambda i: i % GROUPS == g, min_support, max_words, out, lambda n: mixed(n.reshape(parts, classes).sum(axis=0)))
        return pa.table({"items": pa.array([p for p, _ in out], pa.list_(pa.int32())), "counts": pa.array([n.tolist() for _, n in out], pa.list_(pa.int64()))})

    return transactions.groupBy("grp").applyInArrow(run, "items array<int>, counts array<bigint>")


def prune(patterns: list[tuple[tuple[int, ...], np.ndarray]], prior: np.ndarray, min_confidence: float = MIN_CONFIDENCE) -> dict[tuple[int, ...], tuple[int, float]]:
    """Subject and confidence, smoothed towards the prior, of the rules without the redundant ones."""
    rules: dict[tuple[int, ...], tuple[int, float]] = {}
    for p, n in sorted(patterns, key=lambda x: (len(x[0]), x[0])):
        k = int(n.argmax())
        confidence = float((n[k] + prior[k]) / (n.sum() + 1))
        if confidence < min_confidence:
            continue
        general = [rules[q] for m in range(1, len(p)) for q in combinations(p, m) if q in rules]
        if any(c == k and f >= confidence - 0.02 for c, f in general):
            continue
        rules[p] = (k, confidence)
    return rules


#: Classes of confidence in which rules are calibrated.
CLASSES = 20


def monotonous(value: np.ndarray, weight: np.ndarray) -> np.ndarray:
    """The nearest values that never fall (pool adjacent violators)."""
    pools: list[list[float]] = []
    for v, w in zip(value.tolist(), weight.tolist()):
        pools.append([v, w, 1])
        while len(pools) > 1 and pools[-2][0] > pools[-1][0]:
            b, a = pools.pop(), pools.pop()
            w = a[1] + b[1]
            pools.append([(a[0] * a[1] + b[0] * b[1]) / w if w else (a[0] + b[0]) / 2, w, a[2] + b[2]])
    return np.repeat([p[0] for p in pools], [p[2] for p in pools])


def _class_of(confidence: np.ndarray) -> np.ndarray:
    return np.clip(((confidence - MIN_CONFIDENCE) / (1 - MIN_CONFIDENCE) * CLASSES).astype(int), 0, CLASSES - 1)


def calibration(held_out: DataFrame, rules: dict[tuple[int, ...], tuple[int, float]], told: Rules) -> np.ndarray:
    """By class of confidence: how often rules are right in sentences they were not mined from. Classes seen seldom keep their confidence."""
    first: dict[int, list[tuple[int, ...]]] = {}
    for p in rules:
        first.setdefault(p[0], []).append(p)
    sent = held_out.sparkSession.sparkContext.broadcast((rules, first, told))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        rules, first, told = sent.value
        tried, right = np.zeros(CLASSES, np.int64), np.zeros(CLASSES, np.int64)
        for b in batches:
            for own, items in zip(b.column(0).to_pylist(), b.column(1).to_pylist()):
                label = own[0] if len(own) == 1 else told.subject(tuple(items))
                held = set(items)
                matched = [rules[p] for i in items for p in first.get(i, ()) if held.issuperset(p)]
                if label in own and matched:
                    at = _class_of(np.array([c for _, c in matched]))
                    np.add.at(tried, at, 1)
                    np.add.at(right, at, [k == label for k, _ in matched])
        yield pa.RecordBatch.from_arrays([pa.array(range(CLASSES), pa.int32()), pa.array(tried), pa.array(right)], names=["k", "tried", "right"])

    counted = held_out.select("own", "items").mapInArrow(run, "k int, tried bigint, right bigint").groupBy("k").agg(F.sum("tried").alias("tried"), F.sum("right").alias("right"))
    tried, right = np.zeros(CLASSES), np.zeros(CLASSES)
    for r in counted.collect():  # CLASSES rows
        tried[r.k], right[r.k] = r.tried, r.right
    middle = MIN_CONFIDENCE + (np.arange(CLASSES) + 0.5) / CLASSES * (1 - MIN_CONFIDENCE)
    return monotonous((right + 10 * middle) / (tried + 10), tried + 10)


def fit_rules(documents: DataFrame, doc_label: DataFrame, subject_area: DataFrame, most: int = MAX_LABELLED) -> Rules:
    subjects = sorted({r.subject for r in subject_area.select("subject").where("subject is not null").distinct().collect()})
    sample = _sample(documents, doc_label, subjects, most).persist()
    split = None
    try:
        number = leaning_words(sample, subjects)
        formal = formal_phrases(sample, subjects)
        chunks = max((p.count(" ") + 4 for p in formal), default=0)
        split = _sentence_items(sample, number, subjects, formal).persist()

        classes = max(1, len(subjects))

        def pruned(patterns: list[tuple[tuple[int, ...], np.ndarray]]) -> tuple[dict[tuple[int, ...], tuple[int, float]], np.ndarray]:
            single = sum((n for p, n in patterns if len(p) == 1), np.zeros(classes))
            prior = (single + 1) / (single.sum() + len(single))
            return prune(patterns, prior), prior

        def ready(rules: dict, prior: np.ndarray, calibrated: np.ndarray | None = None) -> Rules:
            sure = lambda c: c if calibrated is None else float(calibrated[_class_of(np.array([c]))[0]])
            lifted = {p: (k, float(np.log(sure(c) / prior[k]))) for p, (k, c) in rules.items()}
            return Rules(subjects, number, lifted, int(prior.argmax()), frozenset(i for p in rules if len(p) > 1 for i in p), formal, chunks)

        told = ready(*pruned([(tuple(r["items"]), np.array(r["counts"])) for r in mine(_transactions(split, None), classes).collect()]))
        # one round counts all sentences, and those that are not held out
        both = [(tuple(r["items"]), np.array(r["counts"])) for r in mine(_transactions(split, told, classes), classes, parts=2).collect()]
        final, prior = pruned([(p, n[:classes] + n[classes:]) for p, n in both])
        part, _ = pruned([(p, n[:classes]) for p, n in both if n[:classes].sum() >= MIN_SUPPORT])
        return ready(final, prior, calibration(split.where(_held_out()), part, told))
    finally:
        sample.unpersist()
        if split is not None:
            split.unpersist()


def subjects_with_basis(documents: DataFrame, rules: Rules) -> DataFrame:
    """Distinct doc_id, subject, basis."""
    schema = "doc_id bigint, subject string, basis string"
    texts = documents.where("doc_id is not null and text is not null").select("doc_id", "text")
    if not rules.subjects:
        return documents.sparkSession.createDataFrame([], schema)
    sent = documents.sparkSession.sparkContext.broadcast(rules)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        r = sent.value
        memo = _Items(r.number)
        for b in batches:
            ids, found, rests = [], [], []
            for doc_id, text in zip(b.column(0).to_pylist(), b.column(1)):
                text = text.as_py()
                if not text.isspace() and text:
                    names, basis = r.document(text, memo)
                    ids += [doc_id] * len(names)
                    found += names
                    rests += [basis] * len(names)
            yield pa.RecordBatch.from_arrays([pa.array(ids, pa.int64()), pa.array(found, pa.string()), pa.array(rests, pa.string())], names=["doc_id", "subject", "basis"])

    return spread(texts, "doc_id").mapInArrow(run, schema).distinct()


def find_subjects(documents: DataFrame, rules: Rules) -> DataFrame:
    """Distinct doc_id, subject."""
    return subjects_with_basis(documents, rules).select("doc_id", "subject").distinct()


def basis_report(found: DataFrame) -> DataFrame:
    """basis, documents: how many documents' subjects rest on the share of their sentences, and how many are guesses."""
    return found.groupBy("basis").agg(F.count_distinct("doc_id").alias("documents"))


def composition(found: DataFrame, documents: DataFrame) -> DataFrame:
    """subject, documents, characters: what the corpus is made of."""
    sizes = documents.select("doc_id", F.coalesce(F.length("text"), F.lit(0)).alias("n")).dropDuplicates(["doc_id"])
    return found.join(sizes, "doc_id").groupBy("subject").agg(F.count("*").alias("documents"), F.sum("n").alias("characters"))
