"""Vectorised text kernel shared by the corpus operators.

A *word* is a maximal run of ASCII letters, ASCII digits and non-ASCII characters of the lower-cased
text (simple, one-to-one case mapping); everything else separates words.  Null texts have no words.
Words and word n-grams are 64-bit hashes computed with prefix sums, so the cost is a fixed number of
numpy passes over the bytes and no Python loop runs per word.
"""

from __future__ import annotations

import ctypes
import functools
from collections.abc import Callable, Iterator
from typing import NamedTuple

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

U = np.uint64
_BYTE_MULT, _WORD_MULT = 0x9E3779B97F4A7C15, 0xD6E8FEB86659FD93
CHUNK_BYTES = 1 << 18

_IS_WORD = np.zeros(256, bool)
_IS_WORD[48:58] = _IS_WORD[65:91] = _IS_WORD[97:123] = True
_IS_WORD[128:] = True


class Words(NamedTuple):
    """Words of a run of documents: ``offsets[i]:offsets[i+1]`` are those of document i."""

    hashes: np.ndarray
    offsets: np.ndarray

    def doc(self, i: int) -> np.ndarray:
        return self.hashes[self.offsets[i] : self.offsets[i + 1]]


class _Powers:
    """Powers of an odd multiplier mod 2**64 and of its inverse, grown on demand."""

    def __init__(self, mult: int):
        self.mult, self.n = mult, 0

    def get(self, n: int) -> tuple[np.ndarray, np.ndarray]:
        if n > self.n:
            self.n = max(1 << 16, 1 << (n - 1).bit_length())
            inv = pow(self.mult, -1, 1 << 64)
            self.up, self.down = (self._series(m, self.n) for m in (self.mult, inv))
        return self.up[:n], self.down[:n]

    @staticmethod
    def _series(m: int, n: int) -> np.ndarray:
        out = np.ones(n, U)
        size, step = 1, m
        while size < n:
            k = min(size, n - size)
            out[size : size + k] = out[:k] * U(step)
            step, size = step * step % (1 << 64), size * 2
        return out


_BYTES, _WORDS = _Powers(_BYTE_MULT), _Powers(_WORD_MULT)


def mix(x: np.ndarray) -> np.ndarray:
    """A bijective finaliser of 64-bit values."""
    x = x ^ (x >> U(32))
    x = x * U(0xD6E8FEB86659FD93)
    x = x ^ (x >> U(29))
    x = x * U(0x9FB21C651E98DF25)
    return x ^ (x >> U(32))


def raw_bytes(texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """UTF-8 bytes of all texts and their n+1 offsets."""
    texts = texts.cast(pa.large_string()).fill_null("")
    if not len(texts):
        return np.zeros(0, np.uint8), np.zeros(1, np.int64)
    _, off, data = texts.buffers()
    off = np.frombuffer(off, np.int64)[texts.offset : texts.offset + len(texts) + 1]
    raw = np.frombuffer(data, np.uint8)[off[0] : off[-1]] if data is not None else np.zeros(0, np.uint8)
    return raw, off - off[0]


def lower(texts: pa.Array) -> pa.Array:
    return pc.utf8_lower(texts.cast(pa.large_string()).fill_null(""))


def bounds(raw: np.ndarray, off: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """First byte and end byte of every word, and the n+1 offsets of documents in words."""
    inside = np.zeros(len(raw) + 2, bool)
    inside[1:-1] = _IS_WORD[raw]
    start = inside[1:] & ~inside[:-1]
    end = inside[:-1] & ~inside[1:]
    cut = off[1:-1]  # a word never runs across two documents
    cut = cut[(cut > 0) & (cut < len(raw))]
    both = cut[inside[cut] & inside[cut + 1]]
    start[both] = end[both] = True
    s, e = np.flatnonzero(start[:-1]), np.flatnonzero(end)
    return s, e, np.searchsorted(s, off)


def words(texts: pa.Array) -> Words:
    raw, off = raw_bytes(lower(texts))
    s, e, docs = bounds(raw, off)
    up, down = _BYTES.get(len(raw) + 1)
    run = np.zeros(len(raw) + 1, U)
    np.cumsum((raw.astype(U) + U(1)) * up[: len(raw)], out=run[1:])
    return Words(mix((run[e] - run[s]) * down[s]), docs)


def grams(hashes: np.ndarray, k: int) -> np.ndarray:
    """Hash of every run of k words: position p covers words p .. p+k-1."""
    n = len(hashes) - k + 1
    if n <= 0:
        return np.zeros(0, U)
    up, down = _WORDS.get(len(hashes) + 1)
    run = np.zeros(len(hashes) + 1, U)
    np.cumsum(hashes * up[: len(hashes)], out=run[1:])
    return mix((run[k:] - run[:n]) * down[:n])


def gram_positions(offsets: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray]:
    """Positions p of the whole run at which a k-gram stays inside one document, and the document."""
    counts = np.maximum(np.diff(offsets) - k + 1, 0)
    doc = np.repeat(np.arange(len(counts)), counts)
    first = np.concatenate([[0], np.cumsum(counts)])[:-1]
    return np.arange(len(doc)) - first[doc] + offsets[:-1][doc], doc


def chunks(texts: pa.Array, limit: int = CHUNK_BYTES) -> Iterator[tuple[int, int]]:
    """Ranges of rows with about ``limit`` bytes of text each; a longer document is a range of its own."""
    if not len(texts):
        return
    size = np.cumsum(pc.fill_null(pc.binary_length(texts), 0).to_numpy(zero_copy_only=False).astype(np.int64))
    lo = 0
    while lo < len(size):
        before = size[lo - 1] if lo else 0
        hi = max(lo + 1, int(np.searchsorted(size, before + limit, "right")))
        yield lo, hi
        lo = hi


def column(batch: pa.RecordBatch, name: str) -> pa.Array:
    col = batch.column(batch.schema.names.index(name))
    return col.combine_chunks() if isinstance(col, pa.ChunkedArray) else col


def release() -> None:
    """Give what is free back to the system: workers live from task to task, beside a JVM that fills its heap."""
    pa.default_memory_pool().release_unused()
    try:
        ctypes.CDLL(None).malloc_trim(0)
    except (AttributeError, OSError, TypeError):  # only glibc has it
        pass


def tidy(run: Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    """``run``, after which each task gives its memory back."""

    @functools.wraps(run)
    def tidied(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        try:
            yield from run(batches)
        finally:
            release()

    return tidied
