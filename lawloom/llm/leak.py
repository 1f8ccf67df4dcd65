"""Evaluation passages that stand, wholly or in part, in the documents of a corpus.

Latent semantic retrieval over short windows of words, then exact checks:

1. Every document becomes the sequence of the 64-bit hashes of its words; the sequences are written once, whatever is looked for.
2. Items are taken in blocks of at most BLOCK_WORDS words. A block numbers its own words; document frequencies are counted over all
   documents; the TF-IDF windows of the passages get a truncated SVD by a distributed randomised range finder with one power step. Only
   sums per term of the block's vocabulary, which its size bounds, reach the driver.
3. The latent vectors of terms are rounded to integers, so that windows with the same words have exactly the same latent vector. The
   candidates of a document window are the passage windows in its direction: the same signs in all latent coordinates, cosine above a
   threshold. Document windows begin at every WINDOW-th word, passage windows at every word: a run of 2 * WINDOW - 1 common words holds
   a document window wholly, whose words are those of the passage window, cosine 1. So no such run is missed.
4. Candidates are extended word by word to the longest common run.
5. Paraphrases are looked for without directions: windows begin at every word of the document, and each is compared by cosine with all
   windows of a passage. For pairs with several candidate windows, a longest common subsequence and a search for the item's answer are
   made over the neighbourhood of each. Left out before are only stretches that hold too few of the passage's words for the share.

Passages longer than a block are looked for in pieces that overlap by a run; for paraphrases they are blocks of their own.

Defined results: a word is a run of letters and digits of the canonical text in lower case; null, empty and short texts hold no
passage; items whose passage is null or shorter than RUN words are never found; repeated rows count once; extra columns are ignored.
"""

from __future__ import annotations

import re
from collections.abc import Iterator
from itertools import chain

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lawloom.llm.canonical import canonical
from lawloom.session import spread, written

#: Words in common that make a leak, and the window that any such run holds at each alignment.
RUN = 15
WINDOW = 8
#: Latent coordinates, and the further ones of the range finder.
RANK = 32
EXTRA = 8
#: Words of the passages of one block, which travel to the executors with 272 bytes each.
BLOCK_WORDS = 200_000
MIN_COSINE = 0.98
#: Words of one block of a document; the neighbourhood of a candidate window reaches as far as the passage is long from its block.
BLOCK = 16
#: Multiplications of a matrix product that linear algebra libraries do without starting threads.
ONE_THREAD = 1 << 18
#: Entries that a worker remembers before it starts over.
MEMO = 1_000_000

_words = re.compile(r"[^\W_]+").findall


def words(text: str | None) -> list[str]:
    return _words(canonical(text).lower()) if text else []


class _Memo(dict):
    """Chunk between white space to the hashes of its words."""

    def __missing__(self, chunk: str) -> tuple[int, ...]:
        if len(self) > MEMO:
            self.clear()
        found = self[chunk] = tuple(map(word_hash, words(chunk)))
        return found


def word_hash(word: str) -> int:
    return xxhash.xxh3_64_intdigest(word.encode("utf-8", "surrogatepass"))


def hash_words(documents: DataFrame) -> DataFrame:
    """doc_id and the hashes of the words, eight bytes each."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        memo = _Memo()
        for b in batches:
            codes = [np.fromiter(chain.from_iterable(map(memo.__getitem__, t.as_py().split())), np.uint64).tobytes() for t in b.column(1)]
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array(codes, pa.binary())], names=["doc_id", "words"])

    texts = documents.where("doc_id is not null and text is not null").select("doc_id", "text")
    return spread(texts, "doc_id").mapInArrow(run, "doc_id bigint, words binary")


class Vocabulary:
    """Numbers of the words of one block of items; 0 is any other word."""

    BITS = 20

    def __init__(self) -> None:
        self.number: dict[str, int] = {}

    def add(self, text: str | None) -> list[int]:
        n = self.number
        return [n.setdefault(w, len(n) + 1) for w in words(text)]

    def close(self) -> Vocabulary:
        hashes = np.array(list(map(word_hash, self.number)), np.uint64)
        order = np.argsort(hashes)
        self.size = len(hashes)
        self.hashes, self.terms = hashes[order], (order + 1).astype(np.int32)
        self.maybe = np.zeros(1 << self.BITS, bool)
        self.maybe[hashes & np.uint64((1 << self.BITS) - 1)] = True
        del self.number
        return self

    def numbers(self, column: pa.Array) -> list[np.ndarray]:
        """The words of each document of a column, as 32-bit numbers."""
        parts = [np.frombuffer(w.as_py(), np.uint64) for w in column]
        if not parts:
            return []
        whole = np.concatenate(parts)
        out = np.zeros(len(whole), np.int32)
        if self.size:
            at = np.flatnonzero(self.maybe[whole & np.uint64((1 << self.BITS) - 1)])
            found = whole[at]
            place = np.minimum(np.searchsorted(self.hashes, found), self.size - 1)
            out[at] = np.where(self.hashes[place] == found, self.terms[place], 0)
        return np.split(out, np.cumsum([len(p) for p in parts])[:-1])


def document_frequency(hashed: DataFrame, vocabulary: Vocabulary) -> DataFrame:
    """term, df over all documents."""
    sent = hashed.sparkSession.sparkContext.broadcast(vocabulary)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        v = sent.value
        total = np.zeros(v.size + 1, np.int64)
        for b in batches:
            for codes in v.numbers(b.column(0)):
                total[np.unique(codes)] += 1
        at = np.flatnonzero(total)
        yield pa.RecordBatch.from_arrays([pa.array(at, pa.int64()), pa.array(total[at])], names=["term", "df"])

    return hashed.select("words").mapInArrow(run, "term bigint, df bigint").groupBy("term").agg(F.sum("df").alias("df"))


def _windows(codes: np.ndarray) -> np.ndarray:
    return np.lib.stride_tricks.sliding_window_view(codes, WINDOW) if len(codes) >= WINDOW else np.zeros((0, WINDOW), codes.dtype)


def latent_terms(passages: DataFrame, idf: np.ndarray, rank: int = RANK, extra: int = EXTRA) -> np.ndarray:
    """Integer latent vectors by term, of the TF-IDF windows of ``passages`` (words array<int>)."""
    width = min(rank + extra, max(1, len(idf) - 1))
    basis = np.random.default_rng(5).standard_normal((len(idf), width))
    schema = "term bigint, v array<double>"

    def times_gram(q: np.ndarray) -> np.ndarray:
        """(AᵀA) q, with the rows of A where they are."""

        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            sums = np.zeros_like(q)
            for b in batches:
                for w in b.column(0).to_pylist():
                    rows = _windows(np.array(w, np.int64))
                    y = (q[rows] * idf[rows][:, :, None]).sum(axis=1)
                    np.add.at(sums, rows.ravel(), np.repeat(y, WINDOW, axis=0) * idf[rows].reshape(-1, 1))
            at = np.flatnonzero(np.abs(sums).sum(axis=1))
            yield pa.RecordBatch.from_arrays([pa.array(at, pa.int64()), pa.array(list(sums[at]), pa.list_(pa.float64()))], names=["term", "v"])

        parts = passages.select("words").mapInArrow(run, schema)
        added = parts.groupBy("term").agg(*[F.sum(F.col("v")[k]).alias(f"v{k}") for k in range(width)])
        out = np.zeros_like(q)
        for r in added.collect():  # as many rows as the evaluation set has terms
            out[r[0]] = r[1:]
        return out

    q = np.linalg.qr(times_gram(basis))[0]
    image = times_gram(q)
    values, vectors = np.linalg.eigh((q.T @ image + image.T @ q) / 2)
    v = q @ vectors[:, np.argsort(-values)[:rank]]
    return np.rint(v * idf[:, None] * 2**16).astype(np.int32)


class Retriever:
    """Latent windows of the passages of one block of items."""

    def __init__(self, items: list[tuple[int, list[int]]], latent: np.ndarray) -> None:
        self.latent = latent
        self.ids = np.array([i for i, _ in items], np.int64)
        gap = np.full(RUN, -1, np.int32)
        parts, owner = [gap], [np.full(RUN, -1)]
        for k, (_, codes) in enumerate(items):
            parts += [np.array(codes, np.int32), gap]
            owner += [np.full(len(codes), k), np.full(RUN, -1)]
        self.words, self.owner = np.concatenate(parts), np.concatenate(owner)
        at = np.flatnonzero((_windows(self.words) >= 0).all(axis=1))
        vectors = latent[_windows(self.words)[at]].sum(axis=1, dtype=np.int64)
        sign = self._signs(vectors)
        order = np.argsort(sign, kind="stable")
        self.at, self.sign, self.vectors = at[order], sign[order], vectors[order].astype(np.float64)
        self.norm = np.linalg.norm(self.vectors, axis=1)

    @staticmethod
    def _signs(vectors: np.ndarray) -> np.ndarray:
        bits = np.packbits(vectors > 0, axis=1)
        return np.pad(bits, ((0, 0), (0, 8 - bits.shape[1]))).view(np.uint64).ravel()

    def candidates(self, codes: np.ndarray, starts: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(place in codes, place in self.words) of windows in one direction."""
        rows = codes[starts[:, None] + np.arange(WINDOW)]
        keep = (rows > 0).all(axis=1)
        rows, starts = rows[keep], starts[keep]
        vectors = self.latent[rows].sum(axis=1, dtype=np.int64)
        sign = self._signs(vectors)
        lo, hi = np.searchsorted(self.sign, sign, "left"), np.searchsorted(self.sign, sign, "right")
        n = hi - lo
        mine = np.repeat(np.arange(len(n)), n)
        theirs = np.arange(n.sum()) - np.repeat(np.cumsum(n) - n, n) + np.repeat(lo, n)
        a = vectors[mine].astype(np.float64)
        dot = (a * self.vectors[theirs]).sum(axis=1)
        near = dot >= MIN_COSINE * np.linalg.norm(a, axis=1) * self.norm[theirs] - 1e-9
        return starts[mine[near]], self.at[theirs[near]]

    def runs(self, codes: np.ndarray, here: np.ndarray, there: np.ndarray) -> np.ndarray:
        """Length of the common run through each pair of windows, no longer than it must be known; 0 if the windows differ."""
        same = np.ones(len(here), bool)
        for k in range(WINDOW):
            same &= codes[here + k] == self.words[there + k]
        length = np.where(same, WINDOW, 0)
        for step in (-1, 1):
            still, first = same.copy(), -1 if step < 0 else WINDOW
            for k in range(RUN - WINDOW):
                still &= codes[here + first + step * k] == self.words[there + first + step * k]
                length += still
        return length


def _joined(documents: list[np.ndarray]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """The words of documents with gaps between them, the number of the document at each place, and window starts."""
    gap = np.full(RUN, -2, np.int32)
    parts, doc, starts, at = [gap], [np.full(RUN, -1)], [], RUN
    for k, codes in enumerate(documents):
        starts.append(np.arange(at, at + len(codes) - WINDOW + 1, WINDOW))
        parts += [codes, gap]
        doc += [np.full(len(codes), k), np.full(RUN, -1)]
        at += len(codes) + RUN
    return np.concatenate(parts), np.concatenate(doc), np.concatenate(starts) if starts else np.zeros(0, np.int64)


def _pieces(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for b in batches:
        for k in range(0, b.num_rows, 500):
            yield b.slice(k, 500)


def exact_leaks(hashed: DataFrame, vocabulary: Vocabulary, retriever: Retriever) -> DataFrame:
    sent = hashed.sparkSession.sparkContext.broadcast((vocabulary, retriever))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        v, r = sent.value
        for b in _pieces(batches):
            codes, doc, starts = _joined(v.numbers(b.column(1)))
            here, there = r.candidates(codes, starts)
            hit = r.runs(codes, here, there) >= RUN
            pairs = np.unique(np.stack([doc[here[hit]], r.owner[there[hit]]]), axis=1)
            ids = b.column(0).to_numpy()[pairs[0]]
            yield pa.RecordBatch.from_arrays([pa.array(ids, pa.int64()), pa.array(r.ids[pairs[1]], pa.int64())], names=["doc_id", "item_id"])

    return hashed.mapInArrow(run, "doc_id bigint, item_id bigint")


def common_subsequence(a: list[int], b: list[int]) -> int:
    """Length of the longest common subsequence, bit-parallel over ``a``."""
    places: dict[int, int] = {}
    for k, x in enumerate(a):
        places[x] = places.get(x, 0) | 1 << k
    full = (1 << len(a)) - 1
    v = full
    for y in b:
        u = v & places.get(y, 0)
        v = ((v + u) | (v - u)) & full
    return len(a) - v.bit_count()


def _bits(terms: np.ndarray, times: np.ndarray) -> tuple[np.ndarray, np.ndarray, list[np.ndarray]]:
    """At most 64 words, a bit for each, and by 8 bits the number of times that the words of a pattern stand in the passage."""
    values = np.left_shift(np.uint64(1), np.arange(len(terms), dtype=np.uint64))
    patterns = np.arange(256)
    parts = []
    for k in range(0, len(terms), 8):
        parts.append(sum((((patterns >> j) & 1) * n for j, n in enumerate(times[k : k + 8].tolist())), np.zeros(256, np.int64)))
    return terms, values, parts


class Paraphrases:
    """Documents against every window of every passage of one block of items.

    All windows of a document, one beginning at each word, are compared by cosine with all windows of a passage; a word outside the
    vocabulary adds nothing to the vector of its window. Only stretches that cannot reach ``min_share`` are left out before: a common
    subsequence is no longer than the words of the passage, counted as often as they stand there, that occur in the stretch at all.
    """

    def __init__(self, retriever: Retriever, answers: list[list[int]], min_windows: int, min_share: float) -> None:
        self.latent, self.ids, self.answers = retriever.latent, retriever.ids, answers
        self.min_windows, self.min_share = min_windows, min_share
        self.bit = np.zeros(len(self.latent), np.uint64)
        item = retriever.owner[retriever.at]
        norm = np.maximum(retriever.norm, 1e-300)[:, None]
        self.passages = []
        for k in range(len(self.ids)):
            codes = retriever.words[retriever.owner == k]
            mine = (item == k) & (retriever.norm > 0)
            terms, times = np.unique(codes, return_counts=True)
            self.passages.append((codes, terms, times, (retriever.vectors[mine] / norm[mine]).T, [_bits(terms[k : k + 64], times[k : k + 64]) for k in range(0, len(terms), 64)]))

    def _near(self, flat: np.ndarray, last: np.ndarray, blocks: np.ndarray, passage: np.ndarray) -> np.ndarray:
        """The starts, in the given blocks, of windows near a window of the passage; ``last`` is the last start by block."""
        starts = blocks[:, None] * BLOCK + np.arange(BLOCK)
        sums = np.zeros((len(blocks), BLOCK + WINDOW, self.latent.shape[1]))
        np.cumsum(self.latent[flat[blocks[:, None] * BLOCK + np.arange(BLOCK + WINDOW - 1)]], axis=1, out=sums[:, 1:])
        here = starts <= last[blocks][:, None]
        v, starts = (sums[:, WINDOW:] - sums[:, :-WINDOW])[here], starts[here]
        norm = np.linalg.norm(v, axis=1)
        # products small enough to stay in one thread: the cores belong to other tasks
        step = max(1, ONE_THREAD // passage.size)
        best = np.concatenate([(v[k : k + step] @ passage).max(axis=1) for k in range(0, len(v), step)] or [norm])
        return starts[(best >= MIN_COSINE * norm - 1e-9) & (norm > 0)]

    def _rich(self, rows: np.ndarray, begin: np.ndarray, count: np.ndarray, length: int, words: list, least: float) -> np.ndarray:
        """Blocks of the given documents (where they begin, how many blocks) in whose neighbourhood enough of a passage's words stand.

        Of 64 words at a time, a bit each: the bits of a block, of the blocks within the reach of a window at it, and their weight.
        ``rows`` has a column for each block.
        """
        before, after = -(-length // BLOCK), (BLOCK + WINDOW - 2 + length) // BLOCK
        width = before + after + 1
        # documents one behind the other, with room for a window between them
        first = np.cumsum(count + width) - count
        shift = np.repeat(first - np.cumsum(count) + count, count)
        place = np.arange(count.sum()) + shift
        blocks = place + np.repeat(begin - first, count)
        codes = rows[:, blocks]
        weight = np.zeros(len(blocks), np.int64)
        for some, values, table in words:
            self.bit[some] = values
            held = np.zeros(first[-1] + count[-1] + 2 * width, np.uint64)
            held[place] = np.bitwise_or.reduce(self.bit[codes], axis=0)
            self.bit[some] = 0
            reach = 1
            while 2 * reach <= width:
                held[: len(held) - reach] |= held[reach:]
                reach *= 2
            start = place - before
            found = held[start] | held[start + width - reach]
            for j, part in enumerate(table):
                weight += part[(found >> np.uint64(8 * j)) & np.uint64(0xFF)]
        return blocks[weight >= least]

    def find(self, documents: list[np.ndarray]) -> Iterator[tuple[int, int, float, bool]]:
        """(place of the document, place of the item, share, answer there)"""
        size = np.array([len(c) for c in documents])
        count = -(-size // BLOCK)
        begin = np.cumsum(count) - count
        flat = np.zeros(count.sum() * BLOCK + WINDOW, np.int32)
        here = np.zeros((len(self.latent), len(documents)), np.uint8)
        for d, c in enumerate(documents):
            flat[begin[d] * BLOCK : begin[d] * BLOCK + len(c)] = c
            here[c, d] = 1
        owner = np.repeat(np.arange(len(documents)), count)
        end = begin * BLOCK + size
        last = (end - WINDOW)[owner]
        rows = np.ascontiguousarray(flat[: count.sum() * BLOCK].reshape(-1, BLOCK).T)
        held = np.zeros(len(self.latent), bool)
        for k, (codes, terms, times, passage, bits) in enumerate(self.passages):
            least = self.min_share * len(codes) - 1e-9
            able = np.flatnonzero(times @ here[terms] >= least)
            if not len(able) or not passage.size:
                continue
            good = self._rich(rows, begin[able], count[able], len(codes), bits, least)
            if not len(good):
                continue
            near = self._near(flat, last, good, passage)
            found = owner[near // BLOCK]
            held[terms] = True
            for d in np.unique(found).tolist():
                mine = near[found == d]
                if len(mine) < self.min_windows and len(self._near(flat, last, np.arange(begin[d], begin[d] + count[d]), passage)) < self.min_windows:
                    continue
                share, told = 0.0, False
                for b in np.unique(mine // BLOCK).tolist():
                    near_by = flat[max(begin[d] * BLOCK, b * BLOCK - len(codes)) : min(end[d], (b + 1) * BLOCK + WINDOW - 1 + len(codes))]
                    one = common_subsequence(codes.tolist(), near_by[held[near_by]].tolist()) / len(codes)
                    share = max(share, one)
                    if one * len(codes) >= least and self.answers[k] and not told:
                        told = f" {' '.join(map(str, self.answers[k]))} " in f" {' '.join(map(str, near_by.tolist()))} "
                if share * len(codes) >= least:
                    yield d, k, round(share, 3), told
            held[terms] = False


def paraphrase_leaks(hashed: DataFrame, vocabulary: Vocabulary, retriever: Retriever, answers: list[list[int]], min_windows: int, min_share: float) -> DataFrame:
    """doc_id, item_id, lcs_share, has_answer of pairs with several candidate windows."""
    sent = hashed.sparkSession.sparkContext.broadcast((vocabulary, Paraphrases(retriever, answers, min_windows, min_share)))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        v, finder = sent.value
        for b in _pieces(batches):
            ids = b.column(0).to_pylist()
            out = [(ids[d], int(finder.ids[k]), share, told) for d, k, share, told in finder.find(v.numbers(b.column(1)))]
            cols = list(zip(*out)) or [(), (), (), ()]
            types = (pa.int64(), pa.int64(), pa.float64(), pa.bool_())
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(cols, types)], names=["doc_id", "item_id", "lcs_share", "has_answer"])

    return hashed.mapInArrow(run, "doc_id bigint, item_id bigint, lcs_share double, has_answer boolean")


Item = tuple[int, list[int], list[int]]


def _blocks(eval_item: DataFrame, cut: bool) -> Iterator[tuple[Vocabulary, list[Item]]]:
    """The stated items (id, words of the passage, words of the answer), block by block; none of the corpus. With ``cut``, long passages come in pieces."""
    rows = eval_item.where("item_id is not null and passage is not null").select("item_id", "passage", "answer").distinct()
    vocabulary, block, held = Vocabulary(), [], 0
    for r in rows.orderBy("item_id", "passage", "answer").toLocalIterator():
        text = words(r.passage)
        step = BLOCK_WORDS - RUN + 1 if cut else max(1, len(text))
        for at in range(0, max(1, len(text) - (RUN - 1 if cut else 0)), step):
            piece = text[at : at + (BLOCK_WORDS if cut else len(text))]
            if block and held + len(piece) > BLOCK_WORDS:
                yield vocabulary.close(), block
                vocabulary, block, held = Vocabulary(), [], 0
            block.append((r.item_id, vocabulary.add(" ".join(piece)), vocabulary.add(r.answer)))
            held += len(piece)
    if block:
        yield vocabulary.close(), block


def _prepared(hashed: DataFrame, documents: int, vocabulary: Vocabulary, block: list[Item]) -> tuple[Retriever, list[list[int]]]:
    spark = hashed.sparkSession
    idf = np.full(vocabulary.size + 1, np.log(1.0 + documents) + 1)
    for r in document_frequency(hashed, vocabulary).collect():  # as many rows as the block has terms
        idf[r.term] = np.log((1 + documents) / (1 + r.df)) + 1
    passages = spark.createDataFrame([(c,) for _, c, _ in block], "words array<int>").repartition(4)
    kept = [(i, c, a) for i, c, a in block if len(c) >= WINDOW]
    return Retriever([(i, c) for i, c, _ in kept], latent_terms(passages, idf)), [a for *_, a in kept]


def _union(spark, parts: list[DataFrame], schema: str) -> DataFrame:
    out = spark.createDataFrame([], schema)
    for p in parts:
        out = out.unionByName(p)
    return out


def find_leaks(documents: DataFrame, eval_item: DataFrame) -> DataFrame:
    """Distinct doc_id, item_id with a common run of RUN words."""
    hashed = written(hash_words(documents), "words")
    n, parts = hashed.count(), []
    for vocabulary, block in _blocks(eval_item, True):
        retriever, _ = _prepared(hashed, n, vocabulary, block)
        parts.append(exact_leaks(hashed, vocabulary, retriever))
    return _union(documents.sparkSession, parts, "doc_id bigint, item_id bigint").distinct()


def find_paraphrases(documents: DataFrame, eval_item: DataFrame, min_windows: int = 2, min_share: float = 0.6) -> DataFrame:
    """Distinct doc_id, item_id, lcs_share, has_answer of documents near an item in latent space that share most of its words in order."""
    hashed = written(hash_words(documents), "words")
    n, parts = hashed.count(), []
    for vocabulary, block in _blocks(eval_item, False):
        retriever, answers = _prepared(hashed, n, vocabulary, block)
        parts.append(paraphrase_leaks(hashed, vocabulary, retriever, answers, min_windows, min_share))
    schema = "doc_id bigint, item_id bigint, lcs_share double, has_answer boolean"
    return _union(documents.sparkSession, parts, schema).distinct()
