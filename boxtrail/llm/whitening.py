"""Whitening of embeddings by the principal components of their covariance.

The centred scatter is gathered in one pass of block products. On the driver, where it has the size of a vector squared, a
Cholesky factorisation with diagonal pivoting gives a triangular factor of the covariance; one-sided Jacobi rotations make its
columns orthogonal. Their squared norms are the eigenvalues, the columns themselves, brought to length 1, the components.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from boxtrail.llm.components import keep
from boxtrail.llm.vectors import integer_vectors, matrix, summed, width
from boxtrail.session import ship_package

OFFSET, COMPONENTS = 100_000, 8
MAX_SWEEPS = 60


def pivoted_cholesky(v: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(factor, order): ``factor @ factor.T`` is ``v[order][:, order]``, lower triangular, with as many columns as ``v`` has rank.

    The largest remaining diagonal entry is the pivot; the rest is zero to double precision when none stands out any more.
    """
    a, d = v.astype(np.float64).copy(), len(v)
    order, factor = np.arange(d), np.zeros((d, d))
    least = d * np.finfo(float).eps * max(a.diagonal().max(initial=0.0), 0.0)
    for k in range(d):
        p = k + int(np.argmax(a.diagonal()[k:]))
        if a[p, p] <= least:
            return factor[:, :k], order
        for m in (a, a.T, factor):
            m[[k, p]] = m[[p, k]]
        order[[k, p]] = order[[p, k]]
        factor[k, k] = np.sqrt(a[k, k])
        factor[k + 1 :, k] = a[k + 1 :, k] / factor[k, k]
        a[k + 1 :, k + 1 :] -= np.outer(factor[k + 1 :, k], factor[k + 1 :, k])
    return factor, order


def rounds_of_pairs(n: int) -> list[tuple[np.ndarray, np.ndarray]]:
    """Every pair of 0..n-1 once, in rounds of disjoint pairs: one number stays, the others go round."""
    ring, out = list(range(n + n % 2)), []
    for _ in range(len(ring) - 1):
        pairs = [(min(a, b), max(a, b)) for a, b in zip(ring[: len(ring) // 2], reversed(ring[len(ring) // 2 :]), strict=True) if max(a, b) < n]
        out.append(tuple(np.array(pairs, dtype=np.int64).reshape(-1, 2).T))
        ring = [ring[0], ring[-1], *ring[1:-1]]
    return out


def orthogonal_columns(factor: np.ndarray) -> np.ndarray:
    """The factor times rotations: one-sided Jacobi sweeps until all columns are orthogonal to double precision."""
    g, eps = factor.copy(), np.finfo(float).eps
    rounds = rounds_of_pairs(g.shape[1])
    for _ in range(MAX_SWEEPS):
        turned = False
        for p, q in rounds:
            one, two = g[:, p], g[:, q]
            aa, bb, ab = (one * one).sum(0), (two * two).sum(0), (one * two).sum(0)
            turn = np.abs(ab) > 4 * eps * np.sqrt(aa * bb)
            if not turn.any():
                continue
            turned = True
            p, q, aa, bb, ab = p[turn], q[turn], aa[turn], bb[turn], ab[turn]
            zeta = (bb - aa) / (2 * ab)
            t = np.where(zeta < 0, -1.0, 1.0) / (np.abs(zeta) + np.hypot(1.0, zeta))
            c = 1 / np.hypot(1.0, t)
            one, two = g[:, p], g[:, q]
            g[:, p], g[:, q] = c * one - c * t * two, c * t * one + c * two
        if not turned:
            return g
    raise ArithmeticError("Jacobi sweeps did not converge")


def principal_components(covariance: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(eigenvalues falling, unit eigenvectors as columns), as many as the covariance has rank."""
    factor, order = pivoted_cholesky(covariance)
    g = np.empty_like(factor)
    g[order] = orthogonal_columns(factor)
    norms = np.sqrt((g * g).sum(0))
    fall = np.argsort(-norms, kind="stable")
    return norms[fall] ** 2, g[:, fall] / norms[fall]


@dataclass
class Whitening:
    """What is learned from the fit list: rows, exact sums, eigenvalues, components as columns, trace of the covariance."""

    n: int
    sums: np.ndarray
    values: np.ndarray
    components: np.ndarray
    trace: float

    @property
    def mean(self) -> np.ndarray:
        return np.array([int(s) / self.n for s in self.sums])


def fit(vectors: DataFrame) -> Whitening:
    """Learn from all rows of ``vectors`` (column ``x``)."""
    n, dims = width(vectors)
    if not n or not dims:
        return Whitening(n, np.zeros(dims, np.int64), np.zeros(0), np.zeros((dims, 0)), 0.0)
    sums = summed(vectors, dims, (dims,), lambda x: x.sum(axis=0), int)
    mean = np.array([int(s) / n for s in sums])

    def scatter(x: np.ndarray) -> np.ndarray:
        centred = x - mean
        return centred.T @ centred

    covariance = summed(vectors, dims, (dims, dims), scatter) / n
    covariance = (covariance + covariance.T) / 2
    values, components = principal_components(covariance)
    return Whitening(n, sums, values, components, float(np.trace(covariance)))


def project(vectors: DataFrame, model: Whitening, components: int) -> DataFrame:
    """(key, deviation, whitened): exact squared distance of n * x from the sums, and the whitened coordinates."""
    ship_package(vectors.sparkSession)
    n, sums, mean = model.n, model.sums, model.mean if model.n else model.sums
    basis = model.components[:, :components] / np.sqrt(model.values[:components])
    dims, k = basis.shape

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            x = matrix(batch.column(1), dims)
            # The 64-bit sum is exact modulo 2^64; the same sum in doubles tells whether it fits.
            away = x * np.int64(n) - sums
            fits = (away.astype(np.float64) ** 2).sum(1) < 2.0**63 * (1 - 1e-9)
            white = np.ascontiguousarray((x - mean) @ basis)
            lists = pa.ListArray.from_arrays(pa.array(np.arange(len(x) + 1, dtype=np.int32) * k), pa.array(white.ravel()))
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array((away * away).sum(1), mask=~fits), lists], names=["key", "deviation", "whitened"])

    return vectors.select("key", "x").mapInArrow(run, f"key {vectors.schema['key'].dataType.simpleString()}, deviation bigint, whitened array<double>")


def identity_error(rows: DataFrame, components: int) -> float:
    """The largest absolute entry of the whitened coordinates' covariance minus the identity."""
    if not components:
        return 0.0
    at = [F.get("whitened", F.lit(k)) for k in range(components)]
    cells = [(j, k, F.covar_pop(at[j], at[k])) for j in range(components) for k in range(j + 1)]
    found = rows.agg(*(c.alias(f"c{i}") for i, (_, _, c) in enumerate(cells))).first()
    return max(abs(found[i] - (j == k)) for i, (j, k, _) in enumerate(cells))


def whiten(embeddings: DataFrame, key: str = "vec_id", vector: str = "embedding", components: int = COMPONENTS) -> DataFrame:
    """One row per remaining row and component: key, ``component`` (from 1), ``n``, ``deviation``, ``whitened``, ``explained``, ``identity_error``.

    Rows whose vector is null or holds null or non-finite entries are dropped; all others are the fit list and are returned,
    each once, also when they repeat a key or lack one. Equal eigenvalues keep any orthogonal choice, the same for all rows.
    Components without variance (beyond the rank) are not returned, so equal vectors or a single one give no rows; neither does
    an empty table. ``deviation`` is null where it does not fit into a long. Other columns are ignored. Vectors of different
    lengths raise ValueError.
    """
    vectors = keep(integer_vectors(embeddings, vector, {"key": embeddings[key]}, OFFSET), "whitening-vectors")
    model = fit(vectors)
    k = min(components, len(model.values))
    rows = keep(project(vectors, model, k), "whitened")
    share = F.array(*(F.lit(float(e / model.trace)) for e in model.values[:k])) if k else F.array().cast("array<double>")
    out = rows.select(F.col("key"), "deviation", F.posexplode("whitened").alias("at", "value"))
    return out.select(
        F.col("key").alias(key),
        (F.col("at") + 1).cast("int").alias("component"),
        F.lit(model.n).cast("long").alias("n"),
        "deviation",
        F.col("value").alias("whitened"),
        F.get(share, F.col("at")).alias("explained"),
        F.lit(float(identity_error(rows, k))).alias("identity_error"),
    )
