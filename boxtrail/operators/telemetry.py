"""Latency, count and robust summaries."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F

from boxtrail.operators.grid import with_row
from boxtrail.operators.ordered import lagged, quantiles
from boxtrail.operators.windows import pct_rank_avg  # noqa: F401


def _with(df: DataFrame, other: DataFrame, keys: list[str]) -> DataFrame:
    return df.join(other, keys) if keys else with_row(df, other)


def timing_summary(df: DataFrame, keys: list[str], value: str) -> DataFrame:
    base = df.groupBy(*keys).agg(
        F.avg(value).alias("mean_ms"),
        F.min(value).alias("min_ms"),
        F.max(value).alias("max_ms"),
        (1000.0 / F.avg(value)).alias("mean_fps"),
    )
    q = quantiles(df, keys, F.col(value), {"median_ms": 0.5, "p95_ms": 0.95})
    return _with(base, q, keys)


def count_summary(df: DataFrame, keys: list[str], order: list[str], value: str) -> DataFrame:
    """Minimum, maximum, mean, median and mean absolute change between neighbouring frames."""
    step = lagged(df, keys, order, {"_p": F.col(value)})
    base = step.groupBy(*keys).agg(
        F.min(value).alias("minimum"),
        F.max(value).alias("maximum"),
        F.avg(value).alias("mean"),
        F.coalesce(F.avg(F.abs(F.col(value) - F.col("_p"))), F.lit(0.0)).alias("mean_absolute_frame_delta"),
    )
    return _with(base, quantiles(df, keys, F.col(value).cast("double"), {"median": 0.5}), keys)


def percentile_table(df: DataFrame, keys: list[str], values: list[str], marks=(1, 5, 50, 95, 99)) -> DataFrame:
    """One row per (keys, metric) with p1..p99. Metrics are stacked first, so one sort serves them all."""
    stack = F.explode(F.array(*[F.struct(F.lit(v).alias("metric"), F.col(v).cast("double").alias("v")) for v in values]))
    long = df.select(*keys, stack.alias("s")).select(*keys, "s.metric", "s.v")
    return quantiles(long, [*keys, "metric"], F.col("v"), {f"p{m}": m / 100 for m in marks})


def distribution(df: DataFrame, keys: list[str], value: str) -> DataFrame:
    base = df.groupBy(*keys).agg(F.min(value).alias("minimum"), F.avg(value).alias("mean"), F.max(value).alias("maximum"))
    return _with(base, quantiles(df, keys, F.col(value), {"p05": 0.05, "p95": 0.95}), keys)


def nearest_rank(df: DataFrame, keys: list[str], value: str, kind: str = "nearest") -> DataFrame:
    points = {"minimum": 0.0, "p10": 0.1, "median": 0.5, "p90": 0.9, "maximum": 1.0}
    return quantiles(df, keys, F.col(value), points, kind)


def _median_mad(df: DataFrame, keys: list[str], value: str) -> DataFrame:
    """(median, mad): one row per key."""
    med = quantiles(df, keys, F.col(value).cast("double"), {"median": 0.5})
    dev = _with(df, med, keys).withColumn("_d", F.abs(F.col(value) - F.col("median")))
    return _with(med, quantiles(dev, keys, F.col("_d"), {"mad": 0.5}), keys)


def robust_z(df: DataFrame, keys: list[str], values: list[str]) -> DataFrame:
    """Adds ``z_<value>``: distance from the median in scaled median deviations (scale at least 1e-6).

    All metrics are stacked first, so two sorts serve any number of columns.
    """
    stack = F.explode(F.array(*[F.struct(F.lit(v).alias("metric"), F.col(v).cast("double").alias("v")) for v in values]))
    long = df.select(*keys, stack.alias("_s")).select(*keys, "_s.metric", "_s.v")
    stats = _median_mad(long, [*keys, "metric"], "v")

    def pick(v, col):
        return F.max(F.when(F.col("metric") == v, F.col(col)))

    wide = stats.groupBy(*keys).agg(
        *[pick(v, "median").alias(f"_m_{v}") for v in values], *[pick(v, "mad").alias(f"_d_{v}") for v in values]
    )
    z = {
        f"z_{v}": F.abs(F.col(v) - F.col(f"_m_{v}")) / F.greatest(1.4826 * F.col(f"_d_{v}"), F.lit(1e-6)) for v in values
    }
    return _with(df, wide, keys).withColumns(z).drop(*[f"_{p}_{v}" for p in "md" for v in values])


def robust_threshold(df: DataFrame, keys: list[str], value: str, sigma: float, floor: float) -> DataFrame:
    scale = F.greatest(1.4826 * F.col("mad"), F.lit(1.0))
    stats = _median_mad(df, keys, value)
    return stats.select(*keys, F.greatest(F.lit(floor), F.col("median") + sigma * scale).alias("threshold"))


def uncertainty(thresholds: dict[int, float]) -> Column:
    """Aggregate: how many detections sit near their class threshold."""
    limit = F.create_map(*[F.lit(v) for kv in thresholds.items() for v in (int(kv[0]), float(kv[1]))])
    near = 1.0 - F.abs(F.col("confidence") - limit[F.col("class_id")]) / 0.12
    return F.sum(F.greatest(F.lit(0.0), near))


# Weight of each part of the hard-frame score.
HARD_WEIGHTS = {"cells": 1.4, "droplets": 1.1, "sharpness": 0.35, "brightness": 0.25, "contrast": 0.25}


def hard_score(frames: DataFrame, keys: list[str]) -> DataFrame:
    zed = robust_z(frames, keys, list(HARD_WEIGHTS))
    score = sum((F.col(f"z_{c}") * w for c, w in HARD_WEIGHTS.items()), F.lit(0.0)) + 0.8 * F.col("uncertainty")
    return zed.withColumn("hard_score", score).drop(*[f"z_{c}" for c in HARD_WEIGHTS])


def hardware_summary(reports: DataFrame, keys: list[str] | None = None) -> DataFrame:
    """Verification rollup of frame reports (exact, mismatches, max_error, cycles, latency_ms)."""
    fps = 1000.0 / F.col("latency_ms")
    stats = [
        f(c).alias(f"{p}_{n}")
        for p, c in (("cycles", F.col("cycles")), ("latency_ms", F.col("latency_ms")), ("fps", fps))
        for n, f in (("min", F.min), ("mean", F.avg), ("max", F.max))
    ]
    return reports.groupBy(*(keys or [])).agg(
        F.count_if("exact").alias("frames_exact"),
        F.bool_and("exact").alias("all_exact"),
        F.sum("mismatches").alias("mismatches"),
        F.max("max_error").alias("max_error"),
        *stats,
    )


def run_report(crossings: DataFrame, frames: DataFrame, transactions: DataFrame, keys: list[str], updates: DataFrame | None = None) -> DataFrame:
    """One row per run from its tables, each aggregated before the small results are joined.

    crossings: class_name, verified, edge. frames: lag_frames. transactions: payload_bytes. updates: kind, the rows of a tracked
    table; those of kind ``coasted`` are the updates of confirmed tracks without a detection.
    """
    crossed = crossings.groupBy(*keys).agg(
        F.count_if(F.col("class_name") == "cell").alias("cell_crossings"),
        F.count_if(F.col("class_name") == "droplet").alias("droplet_crossings"),
        F.count_if("verified").alias("verified"),
        F.count_if("edge").alias("edge_hits"),
    )
    lag = frames.groupBy(*keys).agg(F.avg("lag_frames").alias("lag_mean"), F.count(F.lit(1)).alias("frames"))
    lag = _with(lag, quantiles(frames, keys, F.col("lag_frames").cast("double"), {"lag_p95": 0.95}), keys)
    size = transactions.groupBy(*keys).agg(
        F.avg("payload_bytes").alias("payload_mean"), F.max("payload_bytes").alias("payload_max")
    )
    out = _with(_with(crossed, lag, keys), size, keys)
    if updates is not None:
        out = _with(out, updates.groupBy(*keys).agg(F.count_if(F.col("kind") == "coasted").alias("coasted_updates")), keys)
    return out


def command_counts(packets: DataFrame, count: int = 15, prefix: str = "get ") -> DataFrame:
    """The most common commands (a top-k report), and whether each is a plain read."""
    top = packets.groupBy("command").count().orderBy(F.desc("count"), "command").limit(count)
    return top.withColumn("is_get", F.col("command").startswith(prefix))


def compare_vectors(a: DataFrame, b: DataFrame, key: list[str], value: str, by: list[str] | None = None) -> DataFrame:
    """Exact count, mean and maximum absolute error and range of two vectors joined by index."""
    j = a.select(*key, F.col(value).alias("_a")).join(b.select(*key, F.col(value).alias("_b")), key)
    err = F.abs(F.col("_a") - F.col("_b"))
    return j.groupBy(*(by or [])).agg(
        F.count(F.lit(1)).alias("n"),
        F.count_if(err == 0).alias("exact"),
        F.count_if(err <= 1e-6).alias("tolerant"),
        F.avg(err).alias("mae"),
        F.max(err).alias("max_error"),
        F.min("_a").alias("minimum"),
        F.max("_a").alias("maximum"),
    )


def parity_report(df: DataFrame, expected: str, actual: str, ident: str, shown: int = 20) -> DataFrame:
    """Counts, accuracy and the first ``shown`` mismatching ids (the report's own limit)."""
    bad = F.col(expected) != F.col(actual)
    totals = df.agg(
        F.count(F.lit(1)).alias("vectors"),
        F.count_if(~bad).alias("exact"),
        F.count_if(bad).alias("mismatches"),
        (F.count_if(~bad) / F.count(F.lit(1))).alias("accuracy"),
    )
    first = df.filter(bad).select(ident).orderBy(ident).limit(shown)
    listed = first.agg(F.sort_array(F.collect_list(ident)).alias("first_mismatches"))
    return with_row(totals, listed)
