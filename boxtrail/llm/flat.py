"""Flat numpy views of Arrow text batches: words, their hashes and shingles, without a Python object per word.

A batch is cut into slices of bounded bytes, so memory follows the slice and the longest single text, not the batch.
Word and line hashes are 64-bit polynomial hashes over the UTF-8 bytes; two different words of a corpus of 10^7 words
share one with probability below 10^-5, and inside one document the chance is negligible.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

SLICE_BYTES = 2 << 20
U64 = np.uint64
_BASE = 0x9E3779B97F4A7C15 | 1


def mix(values: np.ndarray) -> np.ndarray:
    """Finalizer that spreads every input bit over the word."""
    v = values.astype(U64, copy=True)
    v ^= v >> U64(33)
    v *= U64(0xFF51AFD7ED558CCD)
    v ^= v >> U64(33)
    v *= U64(0xC4CEB9FE1A85EC53)
    v ^= v >> U64(33)
    return v


_BYTE_CODE = mix(np.arange(1, 257, dtype=U64) * U64(_BASE))
_SPACE = np.zeros(256, dtype=bool)
_SPACE[[9, 10, 11, 12, 13, 32]] = True
_LOWER = np.arange(256, dtype=np.uint8)
_LOWER[65:91] += 32
_GRAM_STEPS = mix(np.arange(1001, 1065, dtype=U64)) | U64(1)

_powers = {"up": np.ones(1, dtype=U64), "down": np.ones(1, dtype=U64)}


def _power(kind: str, n: int) -> np.ndarray:
    """The first ``n`` powers of the hash base (or of its inverse modulo 2^64)."""
    if len(_powers[kind]) < n:
        step = _BASE if kind == "up" else pow(_BASE, -1, 1 << 64)
        full = np.full(max(n, SLICE_BYTES + 1), step, dtype=U64)
        full[0] = 1
        _powers[kind] = np.multiply.accumulate(full)
    return _powers[kind][:n]


def slices(batch: pa.RecordBatch, column: str | int, limit: int = SLICE_BYTES) -> Iterator[pa.RecordBatch]:
    """Cut a batch into runs of rows whose texts hold at most ``limit`` bytes (a longer text stands alone)."""
    if not batch.num_rows:
        return
    sizes = pc.fill_null(pc.binary_length(batch.column(column)), 0).to_numpy(zero_copy_only=False)
    total = np.cumsum(sizes)
    start = 0
    while start < len(sizes):
        before = total[start - 1] if start else 0
        stop = max(start + 1, int(np.searchsorted(total, before + limit, side="right")))
        yield batch.slice(start, stop - start)
        start = stop


@dataclass
class Texts:
    """Bytes of several texts in one array; text ``i`` is ``data[bounds[i]:bounds[i + 1]]``."""

    data: np.ndarray
    bounds: np.ndarray

    @property
    def rows(self) -> int:
        return len(self.bounds) - 1

    def per_text(self, flags: np.ndarray) -> np.ndarray:
        """Number of set flags (one per byte) in each text."""
        run = np.concatenate(([0], np.cumsum(flags, dtype=np.int64)))
        return run[self.bounds[1:]] - run[self.bounds[:-1]]


def flat_texts(column: pa.Array, lower: bool = False) -> Texts:
    """Null texts are empty. ``lower`` folds A-Z only."""
    column = pc.fill_null(column, "")
    if pa.types.is_large_string(column.type):
        bounds = np.frombuffer(column.buffers()[1], dtype=np.int64)
    else:
        bounds = np.frombuffer(column.buffers()[1], dtype=np.int32).astype(np.int64)
    bounds = bounds[column.offset : column.offset + len(column) + 1]
    body = column.buffers()[2]
    data = np.frombuffer(body, dtype=np.uint8)[bounds[0] : bounds[-1]] if body is not None else np.zeros(0, np.uint8)
    return Texts(_LOWER[data] if lower else data, bounds - bounds[0])


@dataclass
class Words:
    """Maximal runs of bytes that are not white space: start and end in the flat data, number of their text, hash."""

    start: np.ndarray
    end: np.ndarray
    text: np.ndarray
    code: np.ndarray

    def counts(self, rows: int) -> np.ndarray:
        return np.bincount(self.text, minlength=rows)


def prefix_codes(data: np.ndarray) -> np.ndarray:
    out = np.zeros(len(data) + 1, dtype=U64)
    np.cumsum(_BYTE_CODE[data] * _power("up", len(data)), out=out[1:])
    return out


def span_codes(prefix: np.ndarray, start: np.ndarray, end: np.ndarray) -> np.ndarray:
    """Hashes of the byte spans, the same wherever a span stands."""
    return mix((prefix[end] - prefix[start]) * _power("down", len(prefix))[start] + (end - start).astype(U64))


def words_of(texts: Texts) -> Words:
    solid = ~_SPACE[texts.data]
    if not len(solid):
        none = np.zeros(0, dtype=np.int64)
        return Words(none, none, none, none.astype(U64))
    first = solid.copy()
    first[1:] &= ~solid[:-1]
    edges = texts.bounds[1:-1]
    edges = edges[(edges > 0) & (edges < len(solid))]
    first[edges] = solid[edges]
    last = solid.copy()
    last[:-1] &= ~solid[1:]
    last[edges - 1] = solid[edges - 1]
    start, end = np.flatnonzero(first), np.flatnonzero(last) + 1
    text = np.searchsorted(texts.bounds, start, side="right") - 1
    return Words(start, end, text, span_codes(prefix_codes(texts.data), start, end))


def grams(words: Words, size: int) -> tuple[np.ndarray, np.ndarray]:
    """Positions of the first words of all ``size``-word windows inside one text, and the windows' hashes."""
    n = len(words.code) - size + 1
    if n <= 0:
        return np.zeros(0, dtype=np.int64), np.zeros(0, dtype=U64)
    inside = words.text[:n] == words.text[size - 1 :]
    code = np.zeros(n, dtype=U64)
    for k in range(size):
        code += words.code[k : k + n] * _GRAM_STEPS[k]
    at = np.flatnonzero(inside)
    return at, mix(code[at])


def distinct_per_text(text: np.ndarray, code: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Sorted distinct (text, code)."""
    order = np.lexsort((code, text))
    text, code = text[order], code[order]
    keep = np.ones(len(code), dtype=bool)
    keep[1:] = (text[1:] != text[:-1]) | (code[1:] != code[:-1])
    return text[keep], code[keep]
