"""Routing of hot keys: bounded groups go to one task, hot groups to a distributed twin."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame, functions as F

from boxtrail.session import FOLD_ROWS, materialize, setting


def split_hot(df: DataFrame, keys: list[str], limit: int | None = None) -> tuple[DataFrame, DataFrame | None]:
    """(rows of bounded keys, rows of hot keys or None). Nothing is dropped.

    The count is pre-aggregated before its shuffle and reads the key columns only, so it costs one light job. There is at most one
    hot key in ``limit`` rows, so their marks are broadcast: shuffled, all rows of a hot key would meet in one task.
    """
    limit = limit or setting(df.sparkSession, FOLD_ROWS)
    hot = df.groupBy(*keys).count().filter(F.col("count") > limit).select(*keys)
    if not hot.take(1):
        return df, None
    on = [F.col(f"a.{k}").eqNullSafe(F.col(f"h.{k}")) for k in keys]
    rows, marks = df.alias("a"), F.broadcast(hot.alias("h"))
    return rows.join(marks, on, "left_anti"), rows.join(marks, on, "left_semi")


def split_pair(left: DataFrame, right: DataFrame, keys: list[str], limit: int | None = None):
    """((left, right) of bounded keys, (left, right) of hot keys or None) for two sides that meet on ``keys``.

    A key is hot when either side has many rows of it. Both sides are split, so the hot twin spreads hot keys' rows only.
    """
    limit = limit or setting(left.sparkSession, FOLD_ROWS)
    sizes = [side.groupBy(*keys).count().filter(F.col("count") > limit).select(*keys) for side in (left, right)]
    hot = sizes[0].unionByName(sizes[1]).distinct()
    if not hot.take(1):
        return (left, right), None
    return _parted((left, right), hot, keys)


def _parted(sides, hot: DataFrame, keys: list[str]):
    def parts(rows, how):
        on = [F.col(f"a.{k}").eqNullSafe(F.col(f"h.{k}")) for k in keys]
        return rows.alias("a").join(F.broadcast(hot.alias("h")), on, how)

    return tuple(parts(s, "left_anti") for s in sides), tuple(parts(s, "left_semi") for s in sides)


# Buckets of key hashes whose sizes are counted first; with a limit of 1,024 rows they tell some 500 million rows apart.
COUNTED_BUCKETS = 1 << 20


def packed_split(sides: list[DataFrame], keys: list[str], limit: int):
    """A function that parts any sides which are packed by key: (sides of bounded keys, sides of hot keys or None).

    A key is hot when one of ``sides`` has more than ``limit`` rows of it, or when it has a null, which an equi-join does not bring
    together. Sizes are counted by hash first, in at most as many rows as there are buckets a task, and by key only inside the buckets
    that hold more than ``limit`` rows; so the keys of a large table without hot keys are not shuffled for their counts.
    """
    void = F.greatest(*[F.col(k).isNull() for k in keys]) if len(keys) > 1 else F.col(keys[0]).isNull()
    bucket = F.pmod(F.xxhash64(*keys), F.lit(COUNTED_BUCKETS)).cast("int").alias("_bucket")
    slim = [side.select(*keys, bucket, void.alias("_void")) for side in sides]

    def many(rows, by):
        return rows.groupBy(*by).agg(F.count(F.lit(1)).alias("_n"), F.max("_void").alias("_void")).filter(F.col("_void") | (F.col("_n") > limit))

    def united(tables):
        return reduce(DataFrame.unionByName, tables)

    marked = united([side.select("_bucket", "_void", F.lit(i).alias("_side")) for i, side in enumerate(slim)])
    crowded, hot = many(marked, ["_side", "_bucket"]).select("_bucket").distinct(), None
    if crowded.take(1):
        crowded = F.broadcast(materialize(crowded))
        hot = materialize(united([many(side.join(crowded, "_bucket", "left_semi"), keys) for side in slim]).select(*keys).distinct())

    def split(*parts: DataFrame):
        return _parted(parts, hot, keys) if hot is not None and hot.take(1) else (parts, None)

    return split


def union_routes(df: DataFrame, keys: list[str], bounded, hot, limit: int | None = None) -> DataFrame:
    """Apply ``bounded`` to bounded keys and ``hot`` to hot keys, and put the rows together."""
    cold_rows, hot_rows = split_hot(df, keys, limit)
    out = bounded(cold_rows)
    return out if hot_rows is None else out.unionByName(hot(hot_rows))
