"""Byte-level BPE encoding of a whole corpus with the vocabulary file of a public tokenizer."""

from __future__ import annotations

import base64
from collections.abc import Iterator
from functools import lru_cache

import pyarrow as pa
import pyarrow.compute as pc
import regex
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from issuelake.session import spread

VOCABULARY = "/opt/tokenizers/byte_bpe_50k.tiktoken"
#: Fixed value: how this vocabulary cuts a text into pre-tokens.
PATTERN = r"'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"
#: Pre-tokens remembered by a worker: at most this many, of at most so many characters.
CACHED, CACHED_CHARS = 200_000, 64


class RankQueue:
    """A priority queue over merge ranks: buckets of positions under a hierarchical bitmap.

    A bit of the lowest bitmap level says that the bucket of its rank holds
    something, a bit of each higher level that a word below is not zero. The
    least rank is found by one find-first-set per level, pushes and pops touch
    one word per level, whatever the number of entries.
    """

    BITS = 6

    def __init__(self, ranks: int):
        self.levels: list[list[int]] = []
        n = max(1, ranks)
        while True:
            n = (n + 63) >> self.BITS
            self.levels.append([0] * n)
            if n == 1:
                break
        self.buckets: dict[int, list[int]] = {}

    def push(self, rank: int, position: int) -> None:
        bucket = self.buckets.get(rank)
        if bucket is not None:
            bucket.append(position)
            return
        self.buckets[rank] = [position]
        at = rank
        for level in self.levels:
            word, bit = at >> self.BITS, 1 << (at & 63)
            before = level[word]
            level[word] = before | bit
            if before:
                return
            at = word

    def least(self) -> int:
        """The least rank with a bucket, or -1."""
        if not self.levels[-1][0]:
            return -1
        at = 0
        for level in reversed(self.levels):
            word = level[at]
            at = (at << self.BITS) | ((word & -word).bit_length() - 1)
        return at

    def take(self, rank: int) -> list[int]:
        """Remove and return the whole bucket of `rank`."""
        bucket = self.buckets.pop(rank)
        at = rank
        for level in self.levels:
            word = at >> self.BITS
            level[word] &= ~(1 << (at & 63))
            if level[word]:
                break
            at = word
        return bucket


class Encoder:
    """Text to ids. Special tokens are never recognised: every character is plain text."""

    def __init__(self, path: str = VOCABULARY, pattern: str = PATTERN):
        with open(path, "rb") as f:
            self.ids = {base64.b64decode(a): int(b) for a, b in (line.split() for line in f if line.strip())}
        self.single = [self.ids[bytes([i])] for i in range(256)]
        self.split = regex.compile(pattern).findall
        parts = {i: token for token, i in self.ids.items()}
        self.bytes_of = [parts.get(i, b"") for i in range(max(parts) + 1)]
        self.merged: dict[tuple[int, int], int] = {}
        self.known: dict[str, list[int]] = {}
        self.queue = RankQueue(len(self.bytes_of))

    def pair(self, a: int, b: int) -> int:
        """The id, which is also the merge rank, of two neighbours; -1 if they do not merge."""
        got = self.merged.get((a, b))
        if got is None:
            got = self.ids.get(self.bytes_of[a] + self.bytes_of[b], -1)
            if len(self.merged) < 2_000_000:
                self.merged[a, b] = got
        return got

    def merge(self, raw: bytes) -> list[int]:
        """Apply the merges to one pre-token, the lowest rank first and from left to right.

        The ids form a linked list. Each joinable pair is queued under its
        rank by the position of its left part. An entry is stale, and skipped,
        when its position has been swallowed or its pair has changed.
        """
        single = self.single
        ids = [single[x] for x in raw]
        n = len(ids)
        if n < 2:
            return ids
        after = list(range(1, n + 1))
        before = list(range(-1, n - 1))
        queue, pair = self.queue, self.pair
        for i in range(n - 1):
            r = pair(ids[i], ids[i + 1])
            if r >= 0:
                queue.push(r, i)
        while (rank := queue.least()) >= 0:
            # a merge of this rank makes pairs that contain the new id, so none of the same rank
            for i in sorted(queue.take(rank)):
                j = after[i] if ids[i] >= 0 else n
                if j >= n or pair(ids[i], ids[j]) != rank:
                    continue
                ids[i] = rank
                ids[j] = -1
                k = after[i] = after[j]
                if k < n:
                    before[k] = i
                    r = pair(rank, ids[k])
                    if r >= 0:
                        queue.push(r, i)
                h = before[i]
                if h >= 0:
                    r = pair(ids[h], rank)
                    if r >= 0:
                        queue.push(r, h)
        return [x for x in ids if x >= 0]

    def encode(self, text: str | None) -> list[int]:
        """The ids of a text; an empty and a missing text have none."""
        if not text:
            return []
        known = self.known
        out: list[int] = []
        extend = out.extend
        for word in self.split(text):
            got = known.get(word)
            if got is None:
                raw = word.encode("utf-8", "surrogatepass")
                whole = self.ids.get(raw)
                got = [whole] if whole is not None else self.merge(raw)
                if len(word) <= CACHED_CHARS and len(known) < CACHED:
                    known[word] = got
            extend(got)
        return out


@lru_cache(maxsize=2)
def encoder(path: str = VOCABULARY, pattern: str = PATTERN) -> Encoder:
    """One encoder for each worker process."""
    return Encoder(path, pattern)


def encode_corpus(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", path: str = VOCABULARY, pattern: str = PATTERN) -> DataFrame:
    """`id_col`, ids array<int>: the token ids of each text, in a narrow stage without a shuffle.

    Null and empty texts give an empty list; a null id stays null; repeated
    rows are encoded again; an empty table gives no rows; other columns are
    not read. Texts are never cut, very long pre-tokens included: their merges
    take time in proportion to n log n at most.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        enc = encoder(path, pattern)
        for batch in batches:
            # a few long texts at a time, so that the memory of a worker stays bounded
            for part in _slices(batch):
                offsets, flat = [0], []
                for text in part.column(1).to_pylist():
                    flat.extend(enc.encode(text))
                    offsets.append(len(flat))
                ids = pa.ListArray.from_arrays(pa.array(offsets, pa.int32()), pa.array(flat, pa.int32()))
                yield pa.RecordBatch.from_arrays([part.column(0), ids], names=[id_col, "ids"])

    source = spread(docs.select(F.col(id_col).alias("k"), F.col(text_col).cast("string").alias("t")))
    kind = source.schema["k"].dataType.simpleString()
    return source.mapInArrow(run, f"`{id_col}` {kind}, ids array<int>")


def token_counts(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", path: str = VOCABULARY, pattern: str = PATTERN) -> DataFrame:
    """`id_col`, n_tokens: as encode_corpus, without shipping the ids back."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        enc = encoder(path, pattern)
        for batch in batches:
            for part in _slices(batch):
                counts = [len(enc.encode(text)) for text in part.column(1).to_pylist()]
                yield pa.RecordBatch.from_arrays([part.column(0), pa.array(counts, pa.int64())], names=[id_col, "n_tokens"])

    source = spread(docs.select(F.col(id_col).alias("k"), F.col(text_col).cast("string").alias("t")))
    kind = source.schema["k"].dataType.simpleString()
    return source.mapInArrow(run, f"`{id_col}` {kind}, n_tokens bigint")


def _slices(batch: pa.RecordBatch, chars: int = 4_000_000) -> Iterator[pa.RecordBatch]:
    """Consecutive parts of a batch of about `chars` bytes of text each."""
    start, size = 0, 0
    for i, n in enumerate(pc.binary_length(batch.column(1)).to_pylist()):
        size += n or 0
        if size >= chars:
            yield batch.slice(start, i + 1 - start)
            start, size = i + 1, 0
    if start < batch.num_rows:
        yield batch.slice(start)
