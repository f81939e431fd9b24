"""Vector compression by codebooks per part, with an exact integer search for the nearest entry.

Parts and entries are zero-padded to a power of two and turned by an integer Walsh-Hadamard transform. It multiplies every
squared distance by the padded length, so the distances are compared without division or floating point. The coefficients are
taken in order of sequency, where the first ones usually hold most of the distance: squared differences are added up group by
group, and an entry whose sum exceeds the full distance of a known entry is out.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from boxtrail.llm.components import keep
from boxtrail.llm.vectors import integer_vectors, matrix, summed, width
from boxtrail.session import ship_package

PARTS, ENTRIES, ROUNDS = 4, 256, 4
ROWS, FEW = 256, 8


def sequency_order(size: int) -> np.ndarray:
    """Rows of the Walsh-Hadamard matrix of this size (a power of two) by their number of sign changes."""
    rows = np.ones((1, 1), dtype=np.int64)
    while len(rows) < size:
        rows = np.block([[rows, rows], [rows, -rows]])
    return np.argsort((rows[:, 1:] != rows[:, :-1]).sum(1), kind="stable")


def walsh_hadamard(parts: np.ndarray) -> np.ndarray:
    """Integer transform of each row, zero-padded to a power of two, coefficients by sequency."""
    rows, wide = parts.shape
    size = 1 << max(wide - 1, 0).bit_length()
    out = np.zeros((rows, size), dtype=np.int64)
    out[:, :wide] = parts
    step = 1
    while step < size:
        pairs = out.reshape(rows, -1, 2, step)
        one, two = pairs[:, :, 0] + pairs[:, :, 1], pairs[:, :, 0] - pairs[:, :, 1]
        pairs[:, :, 0], pairs[:, :, 1] = one, two
        step *= 2
    return out[:, sequency_order(size)]


def nearest(parts: np.ndarray, entries: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(index, squared distance) of each row's nearest entry; among equal distances the lower index.

    While many entries of a block of rows are left, all of them take the next group of coefficients; once fewer than one in
    ``FEW`` are, only those that are left do.
    """
    x, y = walsh_hadamard(parts), walsh_hadamard(entries)
    size = x.shape[1]
    reach = max(int(np.abs(x).max(initial=0)), int(np.abs(y).max(initial=0)))
    if 4 * size * reach * reach < 1 << 31:
        x, y = x.astype(np.int32), y.astype(np.int32)
    columns = np.ascontiguousarray(y.T)
    index, error = np.zeros(len(x), dtype=np.int64), np.zeros(len(x), dtype=np.int64)
    edges = [0, *(4 << k for k in range(size.bit_length()) if 4 << k < size), size]
    room = np.empty((min(ROWS, len(x)), len(y)), dtype=x.dtype)
    for start in range(0, len(x), ROWS):
        own = x[start : start + ROWS]
        sums, step = np.zeros((len(own), len(y)), dtype=x.dtype), room[: len(own)]
        bound, left = None, None
        for a, b in zip(edges[:-1], edges[1:], strict=True):
            if left is None:
                for c in range(a, b):
                    np.subtract(own[:, c, None], columns[c], out=step)
                    np.multiply(step, step, out=step)
                    sums += step
                if bound is None:
                    bound = ((own - y[sums.argmin(1)]) ** 2).sum(1, dtype=x.dtype)
                stays = sums <= bound[:, None]
                if b == size or stays.sum() * FEW < stays.size:
                    row, entry = np.nonzero(stays)
                    left = sums[row, entry]
            else:
                left = left + ((own[row, a:b] - y[entry, a:b]) ** 2).sum(1, dtype=x.dtype)
                stays = left <= bound[row]
                row, entry, left = row[stays], entry[stays], left[stays]
        # Rows come in order, and the entry that gave a row's bound is never out.
        least = np.minimum.reduceat(left, np.searchsorted(row, np.arange(len(own))))
        best = np.flatnonzero(left == least[row])
        best = best[np.searchsorted(row[best], np.arange(len(own)))]
        index[start : start + ROWS], error[start : start + ROWS] = entry[best], least // size
    return index, error


def check_range(largest: int, wide: int) -> None:
    """Raise ValueError where a transformed squared distance could leave 64 bits."""
    size = 1 << max(wide - 1, 0).bit_length()
    if 4 * size * size * largest * largest >= 1 << 63:
        raise ValueError("vector components are too large for exact 64-bit distances")


def learn_codebooks(vectors: DataFrame, dims: int, parts: int, entries: int, rounds: int) -> np.ndarray:
    """Codebooks (part, entry, place): the first vectors by key, then rounds of assigning all parts and taking floored means."""
    first = vectors.orderBy(F.col("key").asc_nulls_last(), "x").limit(entries).select("x").collect()
    books = np.array([r.x for r in first], dtype=np.int64).reshape(len(first), parts, dims // parts).transpose(1, 0, 2)
    for _ in range(rounds if len(first) else 0):
        sums = summed(vectors, dims, (parts, books.shape[1], dims // parts + 1), lambda x, books=books: part_sums(x, books), int)
        n = sums[:, :, :1]
        books = np.where(n > 0, sums[:, :, 1:] // np.maximum(n, 1), books)
    return books


def part_sums(x: np.ndarray, books: np.ndarray) -> np.ndarray:
    """(part, entry, 1 + place): number and componentwise sum of the parts that each entry is nearest to."""
    parts, entries, wide = books.shape
    out = np.zeros((parts, entries, wide + 1), dtype=np.int64)
    for p in range(parts):
        own = x[:, p * wide : (p + 1) * wide]
        at, _ = nearest(own, books[p])
        order = np.argsort(at, kind="stable")
        used, begin = np.unique(at[order], return_index=True)
        out[p, used, 0] = np.diff(np.append(begin, len(order)))
        out[p, used, 1:] = np.add.reduceat(own[order], begin, axis=0) if wide else 0
    return out


def compress(embeddings: DataFrame, key: str = "vec_id", vector: str = "embedding", label: str = "label", parts: int = PARTS, entries: int = ENTRIES, rounds: int = ROUNDS) -> tuple[DataFrame, np.ndarray]:
    """(rows, codebooks). Rows: key, ``code`` (two hex digits a part), ``error`` and ``label_error`` (sum over the row's label).

    Rows whose vector is null or holds null or non-finite components are dropped; every other row is returned once, also when
    it repeats a key or lacks one. The codebooks start from the first ``entries`` rows by key (nulls last; among equal keys by
    vector); with fewer rows they have fewer entries. Distances that tie go to the lower index. Rows without a label share a
    sum. An empty table gives no rows and codebooks without entries. Other columns are ignored. Vectors of different lengths,
    lengths that ``parts`` does not divide, and components too large for 64-bit distances raise ValueError.
    """
    if not 1 <= entries <= 256:
        raise ValueError("a code has two hex digits, so at most 256 entries")
    vectors = keep(integer_vectors(embeddings, vector, {"key": embeddings[key], "label": embeddings[label]}), "code-vectors")
    n, dims = width(vectors)
    if dims % parts:
        raise ValueError(f"{parts} equal parts cannot be cut from vectors of {dims}")
    wide = dims // parts
    if n and dims:
        check_range(vectors.agg(F.max(F.greatest(F.array_max("x"), -F.array_min("x")))).first()[0], wide)
    books = learn_codebooks(vectors, dims, parts, entries, rounds)
    ship_package(embeddings.sparkSession)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            x = matrix(batch.column(2), dims)
            found = [nearest(x[:, p * wide : (p + 1) * wide], books[p]) for p in range(parts)]
            digits = np.stack([at for at, _ in found], axis=1).astype(np.uint8) if parts else np.zeros((len(x), 0), np.uint8)
            code = pa.array([row.tobytes().hex() for row in digits], pa.string())
            error = sum((e for _, e in found), np.zeros(len(x), np.int64))
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), code, pa.array(error)], names=["key", "label", "code", "error"])

    kinds = [f"{c} {vectors.schema[c].dataType.simpleString()}" for c in ("key", "label")]
    coded = keep(vectors.select("key", "label", "x").mapInArrow(run, f"{kinds[0]}, {kinds[1]}, code string, error bigint"), "codes")
    totals = keep(coded.groupBy("label").agg(F.sum("error").alias("label_error")).withColumnRenamed("label", "same"), "label-errors")
    joined = coded.join(totals, F.col("label").eqNullSafe(F.col("same")))
    return joined.select(F.col("key").alias(key), "code", "error", "label_error"), books
