"""Order-dependent columns that never put one key, or the whole table, into a single task.

``Ordered`` range-partitions on (keys, order), so a hot key spreads over several partitions, and mends the seams
with one small row per partition. Bounded keys use an ordinary window; ``split_hot`` decides.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window, functions as F

from boxtrail.operators.grid import with_row
from boxtrail.operators.skew import union_routes
from boxtrail.session import WINDOW_ROWS, materialize, setting

PID, POS = "__pid", "__pos"


def _name(order) -> list:
    return [F.col(o) if isinstance(o, str) else o for o in order]


class Ordered:
    """Rows in a total order over range partitions. ``order`` must be unique within a key."""

    def __init__(self, df: DataFrame, keys: list[str], order: list):
        self.keys = keys
        cols = [F.col(k) for k in keys] + _name(order)
        sorted_rows = df.repartitionByRange(*cols).sortWithinPartitions(*cols)
        ident = sorted_rows.withColumn(POS, F.monotonically_increasing_id())
        self.df = materialize(ident.withColumn(PID, F.shiftright(POS, 33)))
        self.group = F.struct(*[F.col(k) for k in keys]) if keys else F.lit(0)

    def _local(self):
        return Window.partitionBy(PID, *self.keys).orderBy(POS)

    def _edges(self) -> DataFrame:
        """First and last key of each partition: one row per partition."""
        return self.df.groupBy(PID).agg(
            F.min_by(self.group, POS).alias("_first"), F.max_by(self.group, POS).alias("_last")
        )

    def running(self, totals: dict[str, Column]) -> DataFrame:
        """Inclusive running sums within each key."""
        frame = self._local().rowsBetween(Window.unboundedPreceding, 0)
        local = self.df.select("*", *[F.sum(c).over(frame).alias(n) for n, c in totals.items()])
        edges = self._edges()
        tails = (
            self.df.join(F.broadcast(edges), PID)
            .filter(self.group.eqNullSafe(F.col("_last")))
            .groupBy(PID)
            .agg(F.first("_last").alias("_key"), *[F.sum(c).alias(f"_t_{n}") for n, c in totals.items()])
            .withColumnRenamed(PID, "_from")
        )
        # What stands before a partition's first key: a prefix sum over one row per partition, heads before their own tails.
        heads = edges.select(F.col("_first").alias("_key"), F.col(PID).alias("_from"), F.lit(0).alias("_kind"))
        both = heads.unionByName(tails.withColumn("_kind", F.lit(1)), allowMissingColumns=True)
        before = Window.partitionBy("_key").orderBy("_from", "_kind").rowsBetween(Window.unboundedPreceding, 0)
        sums = [F.sum(f"_t_{n}").over(before).alias(f"_c_{n}") for n in totals]
        scan = both.select("_key", F.col("_from").alias(PID), "_kind", *sums)
        carry = scan.where("_kind = 0").dropna("all", subset=[f"_c_{n}" for n in totals]).drop("_kind")
        out = local.join(F.broadcast(carry), PID, "left")
        added = F.coalesce(self.group.eqNullSafe(F.col("_key")), F.lit(False))
        fixed = {n: F.col(n) + F.coalesce(F.when(added, F.col(f"_c_{n}")), F.lit(0)) for n in totals}
        return out.withColumns(fixed).drop(PID, POS, "_key", *[f"_c_{n}" for n in totals])

    def latest(self, name: str, value: Column) -> DataFrame:
        """Adds the last value up to each row of its key that is not null; a partition hands on one value."""
        frame = self._local().rowsBetween(Window.unboundedPreceding, 0)
        local = self.df.withColumn(name, F.last(value, ignorenulls=True).over(frame))
        edges = self._edges()
        tails = self.df.withColumn("_v", value).groupBy(PID, self.group.alias("_key")).agg(F.max_by("_v", F.when(F.col("_v").isNotNull(), F.col(POS))).alias("_v"))
        heads = edges.select(F.col("_first").alias("_key"), F.col(PID).alias("_from"), F.lit(0).alias("_kind"))
        own = edges.select(PID, F.col("_last").alias("_end"))
        ends = tails.join(F.broadcast(own), PID).where(F.col("_key").eqNullSafe(F.col("_end"))).select("_key", F.col(PID).alias("_from"), F.lit(1).alias("_kind"), "_v")
        before = Window.partitionBy("_key").orderBy("_from", "_kind").rowsBetween(Window.unboundedPreceding, 0)
        scan = heads.unionByName(ends, allowMissingColumns=True).withColumn("_carry", F.last("_v", ignorenulls=True).over(before))
        carry = scan.where("_kind = 0").select(F.col("_from").alias(PID), F.col("_key"), "_carry")
        out = local.join(F.broadcast(carry), PID, "left")
        handed = F.when(self.group.eqNullSafe(F.col("_key")), F.col("_carry"))
        return out.withColumn(name, F.coalesce(F.col(name), handed)).drop(PID, POS, "_key", "_carry")

    def lag(self, cols: dict[str, Column]) -> DataFrame:
        """Values of the previous row of the same key (null on the first)."""
        local = self.df.withColumns({n: F.lag(c).over(self._local()) for n, c in cols.items()}).withColumn(
            "_rn", F.row_number().over(self._local())
        )
        last = self.df.groupBy(PID).agg(
            F.max_by(F.struct(self.group.alias("_key"), *[c.alias(n) for n, c in cols.items()]), POS).alias("_row")
        )
        seam = last.withColumn("_to", F.lead(PID).over(Window.orderBy(PID))).select(F.col("_to").alias(PID), "_row")
        out = local.join(F.broadcast(seam), PID, "left")
        same = (F.col("_rn") == 1) & self.group.eqNullSafe(F.col("_row._key"))
        fixed = {n: F.when(same, F.col(f"_row.{n}")).otherwise(F.col(n)) for n in cols}
        return out.withColumns(fixed).drop(PID, POS, "_rn", "_row")


def running(df: DataFrame, keys: list[str], order: list, totals: dict[str, Column]) -> DataFrame:
    """Running sums per key, or over the whole table when ``keys`` is empty."""

    def spread(rows):
        return Ordered(rows, keys, order).running(totals)

    def plain(rows):
        frame = Window.partitionBy(*keys).orderBy(*_name(order)).rowsBetween(Window.unboundedPreceding, 0)
        return rows.select("*", *[F.sum(c).over(frame).alias(n) for n, c in totals.items()])

    if not keys:
        return spread(df)
    return union_routes(df, keys, plain, spread, setting(df.sparkSession, WINDOW_ROWS))


def lagged(df: DataFrame, keys: list[str], order: list, cols: dict[str, Column]) -> DataFrame:
    def spread(rows):
        return Ordered(rows, keys, order).lag(cols)

    def plain(rows):
        w = Window.partitionBy(*keys).orderBy(*_name(order))
        return rows.select("*", *[F.lag(c).over(w).alias(n) for n, c in cols.items()])

    if not keys:
        return spread(df)
    return union_routes(df, keys, plain, spread, setting(df.sparkSession, WINDOW_ROWS))


def indexed(df: DataFrame, keys: list[str], order: list, name: str = "rn") -> DataFrame:
    """1-based row number per key (or overall) as a LONG column."""
    return running(df, keys, order, {name: F.lit(1).cast("long")})


def value_ranks(df: DataFrame, keys: list[str], value: Column) -> DataFrame:
    """One row per (keys, value): ``ties`` rows share it, ``below`` rows are smaller, ``n`` is the key's total.

    Equal values are collapsed before the sort, so a value held by a third of the rows is one row here.
    """
    counts = df.filter(value.isNotNull()).groupBy(*keys, value.alias("value")).agg(F.count(F.lit(1)).alias("ties"))
    counts = materialize(counts)  # read by the sampling, the sort and the totals
    cum = running(counts, keys, ["value"], {"upto": F.col("ties")})
    totals = counts.groupBy(*keys).agg(F.sum("ties").alias("n"))
    joined = cum.join(totals, keys) if keys else with_row(cum, totals)
    return joined.withColumn("below", F.col("upto") - F.col("ties"))


def quantiles(df: DataFrame, keys: list[str], value: Column, points: dict[str, float], kind="linear") -> DataFrame:
    """Exact quantiles per key without holding a key's values in one task.

    ``linear`` interpolates; ``nearest`` takes index rint((n-1)q); ``truncated`` takes floor((n-1)q).
    """
    ranks = value_ranks(df, keys, value)
    last = F.col("n") - 1
    aggs = []
    for name, q in points.items():
        target = last * F.lit(float(q))
        if kind == "nearest":
            target = F.rint(target)
        elif kind == "truncated":
            target = F.floor(target)
        low, high = F.floor(target), F.ceil(target)

        def holds(index):
            return (F.col("below") <= index) & (index < F.col("upto"))

        lo = F.max(F.when(holds(low), F.col("value")))
        hi = F.max(F.when(holds(high), F.col("value")))
        frac = F.max(target - F.floor(target))
        aggs.append((lo + (hi - lo) * frac).alias(name))
    return ranks.groupBy(*keys).agg(*aggs)


def top_k(df: DataFrame, keys: list[str], order: list, k: int) -> DataFrame:
    """First ``k`` rows of each key. Spark limits each map task to k rows a key before the shuffle."""
    w = Window.partitionBy(*keys).orderBy(*_name(order))
    return df.withColumn("_k", F.row_number().over(w)).filter(F.col("_k") <= k).drop("_k")
