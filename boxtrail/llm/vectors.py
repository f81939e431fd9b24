"""Embedding rows as exact integer vectors, and sums over them made in one row per task and place."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from boxtrail.session import ship_package

SCALE = 1024
LARGEST = 1 << 52


def whole_rows(column: pa.Array) -> np.ndarray:
    """Which rows hold a vector without null, NaN or infinite components; an empty vector is whole."""
    flat = column.flatten()
    good = pc.is_finite(flat.cast(pa.float64())).fill_null(False).to_numpy(zero_copy_only=False)
    sizes = pc.fill_null(pc.list_value_length(column), 0).to_numpy(zero_copy_only=False)
    bad = np.concatenate(([0], np.cumsum(~good)))
    end = np.cumsum(sizes)
    return column.is_valid().to_numpy(zero_copy_only=False) & (bad[end] == bad[end - sizes])


def integer_vectors(embeddings: DataFrame, vector: str, carry: dict[str, Column], offset: int = 0) -> DataFrame:
    """The carried columns and ``x``: floor(1024 * component) + ``offset`` as longs.

    Rows whose vector is null or holds a null or non-finite component are dropped. Other columns are left out, so none can
    clash. A component beyond 2^52 after scaling raises ValueError.
    """
    ship_package(embeddings.sparkSession)
    rows = embeddings.select(*(c.alias(name) for name, c in carry.items()), embeddings[vector].cast("array<double>").alias("x"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            at = batch.num_columns - 1
            part = batch.filter(pa.array(whole_rows(batch.column(at))))
            column = part.column(at)
            scaled = np.floor(SCALE * column.flatten().to_numpy(zero_copy_only=False))
            if len(scaled) and np.abs(scaled).max() > LARGEST:
                raise ValueError("a vector component is too large for exact integer arithmetic")
            bounds = np.concatenate(([0], np.cumsum(pc.list_value_length(column).to_numpy(zero_copy_only=False))))
            x = pa.ListArray.from_arrays(pa.array(bounds.astype(np.int32)), pa.array(scaled.astype(np.int64) + offset))
            yield pa.RecordBatch.from_arrays([*(part.column(k) for k in range(at)), x], names=part.schema.names)

    named = ", ".join(f"{f.name} {f.dataType.simpleString()}" for f in rows.schema.fields[:-1])
    return rows.mapInArrow(run, f"{named}, x array<bigint>")


def width(vectors: DataFrame) -> tuple[int, int]:
    """(rows, length of the vectors); 0, 0 for an empty table. Vectors of different lengths raise ValueError."""
    n, low, high = vectors.agg(F.count("*"), F.min(F.size("x")), F.max(F.size("x"))).first()
    if n and low != high:
        raise ValueError(f"vectors of different lengths: {low} to {high}")
    return n, high or 0


def matrix(column: pa.Array, dims: int) -> np.ndarray:
    return column.flatten().to_numpy(zero_copy_only=False).reshape(len(column), dims)


def summed(vectors: DataFrame, dims: int, shape: tuple[int, ...], step: Callable[[np.ndarray], np.ndarray], kind: type = float) -> np.ndarray:
    """The sum over all rows of ``step`` (rows x dims in, an array of ``shape`` out).

    Every task adds up its own rows and puts out one row per last axis of the array; Spark adds these, and the driver
    receives as many rows as the array has places before its last axis.
    """
    ship_package(vectors.sparkSession)
    last = shape[-1] if shape else 1
    name = "bigint" if kind is int else "double"

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = None
        for batch in batches:
            if batch.num_rows:
                new = step(matrix(batch.column(0), dims))
                total = new if total is None else total + new
        if total is not None:
            flat = total.reshape(-1, last)
            lists = pa.ListArray.from_arrays(pa.array(np.arange(len(flat) + 1, dtype=np.int32) * last), pa.array(flat.ravel()))
            yield pa.RecordBatch.from_arrays([pa.array(np.arange(len(flat), dtype=np.int32)), lists], names=["place", "v"])

    rows = vectors.select("x").mapInArrow(run, f"place int, v array<{name}>")
    cells = rows.select("place", F.posexplode("v").alias("at", "v")).groupBy("place", "at").agg(F.sum("v").alias("v"))
    out = np.zeros(shape, dtype=np.int64 if kind is int else np.float64).reshape(-1, last)
    for r in cells.groupBy("place").agg(F.sort_array(F.collect_list(F.struct("at", "v"))).alias("cells")).toLocalIterator():
        out[r.place] = [c.v for c in r.cells]
    return out.reshape(shape)
