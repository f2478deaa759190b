"""Vectorised words, hashes and n-gram fingerprints over Arrow string columns.

A word is a maximal run of bytes other than 0x20 and 0x09-0x0D. UTF-8 continuation bytes
never fall in that range, so working on bytes equals working on code points. Hashes are
64-bit; two different words or windows are taken for equal with probability about 2**-64.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa

U64 = np.uint64
CHUNK_BYTES = 1 << 20
CHUNK_TEXTS = 4096

SPACE = np.zeros(256, dtype=bool)
SPACE[[0x20, 0x09, 0x0A, 0x0B, 0x0C, 0x0D]] = True
LOWER = np.arange(256, dtype=np.uint8)
LOWER[65:91] += 32
_BYTE = np.random.default_rng(20240611).integers(1, 2**63, 256, dtype=np.uint64) * U64(2) + U64(1)
_P, _Q = 0x9E3779B97F4A7C15, 0xC2B2AE3D27D4EB4F


def mix(x: np.ndarray) -> np.ndarray:
    """A bijective 64-bit finaliser."""
    x = (x ^ (x >> U64(30))) * U64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> U64(27))) * U64(0x94D049BB133111EB)
    return x ^ (x >> U64(31))


class _Powers:
    """Powers of an odd number and of its inverse modulo 2**64, grown on demand."""

    def __init__(self, base: int):
        self.base, self.inverse, self.n = base, pow(base, -1, 2**64), 0
        self.up = self.down = np.ones(0, dtype=np.uint64)

    def to(self, n: int) -> tuple[np.ndarray, np.ndarray]:
        if n > self.n:
            self.n = max(n + n // 8, 1 << 16)
            for name, base in (("up", self.base), ("down", self.inverse)):
                p = np.full(self.n, base, dtype=np.uint64)
                p[0] = 1
                setattr(self, name, np.multiply.accumulate(p))
        return self.up[:n], self.down[:n]


_BYTES, _WORDS = _Powers(_P), _Powers(_Q)


@dataclass
class Texts:
    """Some whole documents: their ids, their bytes one after another, and where each begins."""

    ids: np.ndarray
    data: np.ndarray
    at: np.ndarray
    row: int

    def __len__(self) -> int:
        return len(self.ids)


@dataclass
class Words:
    """Words of some documents: byte range, document and hash of each; words of document d are lo[d]:lo[d+1]."""

    start: np.ndarray
    end: np.ndarray
    lo: np.ndarray
    doc: np.ndarray
    hash: np.ndarray


def string_buffers(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """Bytes and int64 offsets of a string column; a null counts as empty."""
    column = column.fill_null("") if column.null_count else column
    wide = column.type in (pa.large_string(), pa.large_binary())
    _, offsets, data = column.buffers()
    at = np.frombuffer(offsets, dtype=np.int64 if wide else np.int32)[column.offset : column.offset + len(column) + 1].astype(np.int64)
    raw = np.frombuffer(data, dtype=np.uint8) if data is not None and data.size else np.zeros(0, dtype=np.uint8)
    return raw[at[0] : at[-1]], at - at[0]


def texts(batch: pa.RecordBatch, text: str = "text", key: str = "doc_id", chunk: int = CHUNK_BYTES) -> Iterator[Texts]:
    """Cuts a batch between rows into parts of about chunk bytes and CHUNK_TEXTS texts; a longer text is a part of its own."""
    if not batch.num_rows:
        return
    data, at = string_buffers(batch.column(text))
    ids = batch.column(key).cast(pa.int64()).fill_null(0).to_numpy(zero_copy_only=False)
    a, n = 0, len(ids)
    while a < n:
        b = min(n, a + CHUNK_TEXTS, max(a + 1, int(np.searchsorted(at, at[a] + chunk, "right")) - 1))
        yield Texts(ids[a:b], data[at[a] : at[b]], at[a : b + 1] - at[a], a)
        a = b


def split(t: Texts, lower: bool = False, hashed: bool = True) -> Words:
    data = LOWER[t.data] if lower else t.data
    n = len(data)
    inside = np.zeros(n + 1, dtype=bool)
    np.logical_not(SPACE[data], out=inside[:n])
    begins = inside[:n].copy()
    begins[1:] &= ~inside[: n - 1] if n else begins[1:]
    ends = inside[:n] & ~inside[1:]
    edge = t.at[1:-1]
    edge = edge[(edge > 0) & (edge < n)]
    begins[edge] = inside[edge]
    ends[edge - 1] = inside[edge - 1]
    start, end = np.flatnonzero(begins), np.flatnonzero(ends) + 1
    lo = np.searchsorted(start, t.at)
    doc = np.repeat(np.arange(len(t)), np.diff(lo))
    return Words(start, end, lo, doc, range_hash(data, start, end) if hashed else np.zeros(0, dtype=np.uint64))


def range_hash(data: np.ndarray, start: np.ndarray, end: np.ndarray) -> np.ndarray:
    """A hash of each byte range data[start:end]; ranges are ascending and do not overlap."""
    if not len(start):
        return np.zeros(0, dtype=np.uint64)
    up, down = _BYTES.to(len(data) + 1)
    value = np.zeros(len(data) + 1, dtype=np.uint64)
    np.multiply(_BYTE[data], up[: len(data)], out=value[: len(data)])
    cut = np.empty(2 * len(start), dtype=np.int64)
    cut[::2], cut[1::2] = start, end
    sums = np.add.reduceat(value, cut)[::2]
    sums[start == end] = 0
    return mix(sums * down[start] + (end - start).astype(np.uint64))


def windows(w: Words, n: int) -> tuple[np.ndarray, np.ndarray]:
    """Index of the first word, and hash, of each window of n words in one document."""
    if len(w.doc) < n:
        return np.zeros(0, dtype=np.int64), np.zeros(0, dtype=np.uint64)
    first = np.flatnonzero(w.doc[: len(w.doc) - n + 1] == w.doc[n - 1 :])
    up, down = _WORDS.to(len(w.hash) + 1)
    total = np.zeros(len(w.hash) + 1, dtype=np.uint64)
    np.cumsum(w.hash * up[: len(w.hash)], out=total[1:])
    return first, mix((total[first + n] - total[first]) * down[first] + U64(n))


def sequence_hash(h: np.ndarray) -> np.uint64:
    """Hash of a whole sequence of word hashes, equal to that of a window of as many words."""
    up, _ = _WORDS.to(len(h))
    return mix(np.array([np.sum(h * up, dtype=np.uint64) + U64(len(h))], dtype=np.uint64))[0]


def first_of_run(*sorted_columns: np.ndarray) -> np.ndarray:
    """True where a row of sorted columns differs from the row before it."""
    n = len(sorted_columns[0])
    out = np.zeros(n, dtype=bool)
    if n:
        out[0] = True
        for c in sorted_columns:
            out[1:] |= c[1:] != c[:-1]
    return out
