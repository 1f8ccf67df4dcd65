"""Encoding of a corpus with a public byte-level BPE tokenizer, and decoding.

A text is cut into the tokenizer's own pre-tokens. Documents are taken in blocks of bounded size; a block keeps the positions of its
pre-tokens as numbers of its own list of distinct ones. Only these lists are shuffled: distinct pre-tokens of all blocks are encoded once
each, the ids are joined back to the (block, number) pairs, and each block is put together again by position. What is moved thus grows
with the vocabulary of a block and two bytes a position, not with the text. A frequent pre-token stands once in the list of nearly every
block; the join is salted by block, so no task meets all of them.

Decoding explodes ids with their positions, joins the token-byte table on the id (as many rows as the tokenizer has ids, a fixed size)
and concatenates by position.

Defined results: null and empty texts have an empty list; every input row has one output row, repeated rows too; what looks like
a special token is text; an id outside the table decodes to nothing; extra columns are ignored.
"""

from __future__ import annotations

import base64
import os
import re
from collections.abc import Iterator
from itertools import chain

import numpy as np
import pyarrow as pa
import regex
from pyspark import SparkFiles, TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lawloom.session import spread, written

#: Folder of the tokenizer files on the driver, which gives executors the one they need.
TOKENIZERS = "/opt/tokenizers"
#: Characters of text in one block, and the most documents.
BLOCK_CHARS = 4 << 20
BLOCK_DOCS = 50_000
#: Parts in which the blocks' lists meet the encoded pre-tokens.
SALTS = 4
#: Stretches that a block remembers the pre-tokens of, before it starts over.
MEMO = 500_000

# Unicode White_Space, and the public pattern of this family of tokenizers.
_WS = "\t-\r \x85\xa0  -     　"
PRETOKEN = r"'(?:[sdmt]|ll|ve|re)| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"

#: The same pattern with white space spelt out, as the tokenizer understands it.
_PRETOKENS = regex.compile(rf"'(?:[sdmt]|ll|ve|re)| ?\p{{L}}+| ?\p{{N}}+| ?[^{_WS}\p{{L}}\p{{N}}]+|[{_WS}]+(?![^{_WS}])|[{_WS}]+").findall
_stretches = re.compile(f" ?[^{_WS}]+|[{_WS}]+(?![^{_WS}])|[{_WS}]+").findall
_spaced_out = re.compile(f" [{_WS}]|[{_WS}] |^ |^$| $").search


def stretches(text: str) -> list[str]:
    """Pieces that no white space parts, cut where a pre-token always begins. Their concatenation is the text."""
    if _spaced_out(text):
        return _stretches(text)
    first, *rest = text.split(" ")
    return [first, *[" " + x for x in rest]]


def pretokens(text: str) -> list[str]:
    """Pre-tokens, whose concatenation is the text."""
    return [t for s in stretches(text) for t in _PRETOKENS(s)]


class _Numbers(dict):
    """Stretch to the numbers of its pre-tokens in the list of the block."""

    def __init__(self, number: dict[str, int], before: str) -> None:
        self.number, self.before = number, before

    def __missing__(self, stretch: str) -> tuple[int, ...]:
        if len(self) >= MEMO:
            self.clear()
        n = self.number
        found = self[stretch] = tuple(n.setdefault(t, len(n)) for t in _PRETOKENS(self.before + stretch))
        return found


class _Blocks:
    def __init__(self, partition: int) -> None:
        self.partition, self.count = partition, 0
        self.clear()

    def clear(self) -> None:
        self.number: dict[str, int] = {}
        self.spaced, self.plain = _Numbers(self.number, " "), _Numbers(self.number, "")
        self.ids: list = []
        self.codes: list[np.ndarray] = []
        self.chars = 0

    def add(self, doc_id, text: str | None) -> None:
        self.ids.append(doc_id)
        if not text:
            self.codes.append(np.zeros(0, np.uint32))
            return
        self.chars += len(text)
        if _spaced_out(text):
            found = map(self.plain.__getitem__, _stretches(text))
        else:
            first, *rest = text.split(" ")
            found = chain((self.plain[first],), map(self.spaced.__getitem__, rest))
        self.codes.append(np.fromiter(chain.from_iterable(found), np.uint32))

    def flush(self) -> pa.RecordBatch:
        words = list(self.number)
        codes = np.concatenate(self.codes)
        small = codes.astype(np.uint16) if len(words) < 1 << 16 else codes
        batch = pa.RecordBatch.from_arrays(
            [
                pa.array([f"{self.partition}-{self.count}"]),
                pa.array([self.ids], pa.list_(pa.int64())),
                pa.array([[len(c) for c in self.codes]], pa.list_(pa.int32())),
                pa.array([small.tobytes()], pa.binary()),
                pa.array([words], pa.list_(pa.string())),
            ],
            names=["block", "doc_ids", "lengths", "codes", "words"],
        )
        self.count += 1
        self.clear()
        return batch


_BLOCK = "block string, doc_ids array<bigint>, lengths array<int>, codes binary, words array<string>"


def cut_blocks(documents: DataFrame, block_chars: int = BLOCK_CHARS) -> DataFrame:
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        b = _Blocks(TaskContext.get().partitionId())
        for batch in batches:
            for doc_id, text in zip(batch.column(0).to_pylist(), batch.column(1)):
                b.add(doc_id, text.as_py())
                if b.chars >= block_chars or len(b.ids) >= BLOCK_DOCS:
                    yield b.flush()
        if b.ids:
            yield b.flush()

    return spread(documents.select("doc_id", "text"), "doc_id").mapInArrow(run, _BLOCK)


def _ranks(ranks_file: str) -> dict[bytes, int]:
    with open(ranks_file, "rb") as f:
        return {base64.b64decode(a): int(b) for a, b in map(bytes.split, f)}


def _encoder(ranks_file: str):
    import tiktoken

    ranks = _ranks(ranks_file)
    return tiktoken.Encoding("corpus", pat_str=PRETOKEN, mergeable_ranks=ranks, special_tokens={}).encode_ordinary


def encode_words(words: DataFrame, vocabulary: str = "byte_bpe_50k", folder: str = TOKENIZERS) -> DataFrame:
    """word, ids of each row's word."""
    name = f"{vocabulary}.tiktoken"
    words.sparkSession.sparkContext.addFile(os.path.join(folder, name))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encode = _encoder(SparkFiles.get(name))
        for batch in batches:
            words = batch.column(0)
            ids = [encode(w) for w in words.to_pylist()]
            yield pa.RecordBatch.from_arrays([words, pa.array(ids, pa.list_(pa.int32()))], names=["word", "ids"])

    return words.mapInArrow(run, "word string, ids array<int>")


def _assemble(key, blocks: pa.Table, words: pa.Table) -> pa.Table:
    row = {k: blocks.column(k)[0] for k in ("doc_ids", "lengths", "codes")}
    lengths = np.array(row["lengths"].as_py(), np.int64)
    raw = row["codes"].as_py()
    total = int(lengths.sum())
    codes = np.frombuffer(raw, np.uint16 if len(raw) == 2 * total else np.uint32)
    words = words.combine_chunks().sort_by("code")
    column = words.column("ids").combine_chunks()
    ids = (column.chunk(0) if isinstance(column, pa.ChunkedArray) else column) if len(words) else pa.array([], pa.list_(pa.int32()))
    taken = ids.take(pa.array(codes.astype(np.int64)))
    ends = np.concatenate([[0], np.cumsum(lengths)])
    at = taken.offsets.to_numpy(zero_copy_only=False)
    lists = pa.ListArray.from_arrays(pa.array(at[ends].astype(np.int32)), taken.values)
    return pa.table({"doc_id": pa.array(row["doc_ids"].as_py(), pa.int64()), "ids": lists})


def encode_corpus(
    documents: DataFrame, vocabulary: str = "byte_bpe_50k", folder: str = TOKENIZERS, block_chars: int = BLOCK_CHARS
) -> DataFrame:
    """doc_id, ids."""
    blocks = written(cut_blocks(documents, block_chars), "blocks")
    salt = F.pmod(F.xxhash64("block"), F.lit(SALTS))
    listed = blocks.select("block", salt.alias("salt"), F.posexplode("words").alias("code", "word"))
    coded = encode_words(listed.select("word").distinct(), vocabulary, folder).withColumn("salt", F.explode(F.sequence(F.lit(0).cast("bigint"), F.lit(SALTS - 1).cast("bigint"))))
    found = listed.join(coded, ["word", "salt"]).select(F.col("block").alias("of_block"), "code", "ids")
    positions = blocks.select("block", "doc_ids", "lengths", "codes")
    return positions.groupBy("block").cogroup(found.groupBy("of_block")).applyInArrow(_assemble, "doc_id bigint, ids array<int>")


def token_bytes(spark: SparkSession, vocabulary: str = "byte_bpe_50k", folder: str = TOKENIZERS) -> DataFrame:
    """token_id, hex of its bytes; as many rows as the tokenizer has ids."""
    ranks = _ranks(os.path.join(folder, f"{vocabulary}.tiktoken"))
    return spark.createDataFrame(pa.table({"token_id": pa.array(ranks.values(), pa.int32()), "hex": [b.hex().upper() for b in ranks]}))


def decode_corpus(encoded: DataFrame, vocabulary: str = "byte_bpe_50k", folder: str = TOKENIZERS) -> DataFrame:
    """doc_id, text. Rows that are equal are decoded once."""
    table = token_bytes(encoded.sparkSession, vocabulary, folder)
    rows = encoded.groupBy("doc_id", "ids").agg(F.count("*").alias("rows")).withColumn("key", F.struct("doc_id", F.xxhash64("ids"), F.xxhash64(F.lit(7), "ids")))
    placed = rows.select("key", F.posexplode("ids").alias("pos", "token_id")).join(table, "token_id")
    spelt = placed.groupBy("key").agg(F.array_join(F.sort_array(F.collect_list(F.struct("pos", "hex"))).getField("hex"), "").alias("hex"))
    whole = rows.select("key", "rows").join(spelt, "key", "left")
    text = F.decode(F.unhex(F.coalesce("hex", F.lit(""))), "UTF-8")
    return whole.select(F.col("key.doc_id").alias("doc_id"), text.alias("text"), F.explode(F.sequence(F.lit(1), F.col("rows"))).alias("copy")).drop("copy")
