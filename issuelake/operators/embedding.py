"""Texts as vectors: an interface, and an embedder that needs no model."""

from __future__ import annotations

import hashlib
import re
from collections.abc import Callable, Iterator, Sequence
from functools import lru_cache
from typing import Protocol

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

WORD = re.compile(r"[a-z0-9_]+")


class Embedder(Protocol):
    """Anything that turns texts into vectors of one length and of norm 1 (of zeros for a text without words)."""

    dims: int

    def embed_batch(self, texts: Sequence[str | None]) -> np.ndarray: ...


@lru_cache(maxsize=500_000)
def _place(word: str, dims: int) -> tuple[int, int]:
    """Dimension and sign of a word, by the leading hexadecimal digits of its MD5."""
    h = hashlib.md5(word.encode(), usedforsecurity=False).hexdigest()
    return int(h[:6], 16) % dims, 1 - 2 * (int(h[6], 16) % 2)


class HashedWords:
    """Signed counts of the words, each in a dimension that its digest names, scaled to norm 1; with `unit` off the counts themselves, whose products no rounding changes."""

    def __init__(self, dims: int = 768, unit: bool = True):
        self.dims, self.unit = dims, unit

    def embed_batch(self, texts: Sequence[str | None]) -> np.ndarray:
        out = np.zeros((len(texts), self.dims))
        for row, text in zip(out, texts):
            for w in WORD.findall((text or "").lower()):
                at, sign = _place(w, self.dims)
                row[at] += sign
        if not self.unit:
            return out
        norm = np.sqrt((out * out).sum(axis=1, keepdims=True))
        return np.divide(out, norm, out=out, where=norm > 0)


def embedding_text(header: Column, content: Column, most: int = 4000) -> Column:
    """Header, line feed, content, no longer than `most` characters; a missing header is left out."""
    return F.substring(F.concat_ws("\n", header, content), 1, most)


def embedded(rows: DataFrame, id_cols: Sequence[str], text: Column, make: Callable[[], Embedder] = HashedWords, vec_col: str = "embedding", batch: int = 512) -> DataFrame:
    """`id_cols` and the vector of each text, `batch` texts at a time; `make` is called once in each task. Repeated rows stay; null texts give zeros."""
    source = rows.select(*id_cols, text.alias("__text"))
    schema = ", ".join([f"`{c}` {source.schema[c].dataType.simpleString()}" for c in id_cols] + [f"`{vec_col}` array<double>"])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        embedder = make()
        for whole in batches:
            for start in range(0, whole.num_rows, batch):
                b = whole.slice(start, batch)
                m = embedder.embed_batch(b.column(len(id_cols)).to_pylist())
                offsets = pa.array(np.arange(0, m.size + 1, m.shape[1], dtype=np.int32)) if m.size else pa.array([0], pa.int32())
                yield pa.RecordBatch.from_arrays([*[b.column(i) for i in range(len(id_cols))], pa.ListArray.from_arrays(offsets, pa.array(m.ravel()))], names=[*id_cols, vec_col])

    return source.mapInArrow(run, schema)
