"""Feature tables: candidate to track to sequence."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F

from boxtrail.operators.ordered import lagged, quantiles
from boxtrail.operators.skew import union_routes
from boxtrail.session import FOLD_ROWS, setting


def track_features(cand: DataFrame, keys: list[str], features: list[str], x: str, y: str, score: str) -> DataFrame:
    """One row per track: extent in time, path, best frame (earliest of the best) and mean/std/max of features.

    ``cand`` has one row per (track, frame_index).
    """
    steps = lagged(cand, keys, ["frame_index"], {"_px": F.col(x), "_py": F.col(y)})
    dx, dy = F.col(x) - F.col("_px"), F.col(y) - F.col("_py")
    steps = steps.withColumn("_step", F.sqrt(dx * dx + dy * dy))
    at = F.struct(F.col(x).alias("x"), F.col(y).alias("y"))
    stats = [
        f(c).alias(f"{c}_{n}") for c in features for n, f in (("mean", F.avg), ("std", F.stddev_pop), ("max", F.max))
    ]
    rows = steps.groupBy(*keys).agg(
        F.count(F.lit(1)).alias("hits"),
        F.min("frame_index").alias("first_frame"),
        F.max("frame_index").alias("last_frame"),
        F.max_by("frame_index", F.struct(F.col(score), -F.col("frame_index"))).alias("best_frame"),
        F.max(score).alias("best_proposal_score"),
        F.min_by(at, "frame_index").alias("_s"),
        F.max_by(at, "frame_index").alias("_e"),
        F.coalesce(F.sum("_step"), F.lit(0.0)).alias("path_length_px"),
        F.coalesce(F.avg("_step"), F.lit(0.0)).alias("mean_speed_px_per_frame"),
        F.coalesce(F.max("_step"), F.lit(0.0)).alias("max_speed_px_per_frame"),
        *stats,
    )
    ex, ey = F.col("_e.x") - F.col("_s.x"), F.col("_e.y") - F.col("_s.y")
    duration = F.col("last_frame") - F.col("first_frame") + 1
    return rows.withColumns(
        {
            "duration_frames": duration,
            "persistence_ratio": F.col("hits") / F.greatest(duration, F.lit(1)),
            "start_x_px": F.col("_s.x"),
            "start_y_px": F.col("_s.y"),
            "end_x_px": F.col("_e.x"),
            "end_y_px": F.col("_e.y"),
            "displacement_px": F.sqrt(ex * ex + ey * ey),
            "temporal_status": F.when(F.col("hits") >= 3, "persistent").otherwise("transient"),
        }
    ).drop("_s", "_e")


def track_predictions(cand: DataFrame, keys: list[str], probability: str, min_hits: int, threshold: float) -> DataFrame:
    p = F.avg(probability)
    rows = cand.groupBy(*keys).agg(
        p.alias("probability_mean"), F.max(probability).alias("probability_max"), F.count(F.lit(1)).alias("observations")
    )
    yes = (F.col("observations") >= min_hits) & (F.col("probability_mean") >= threshold)
    return rows.withColumn("predicted", yes.cast("int"))


def sample_weights(df: DataFrame, keys: list[str], confidence: str) -> DataFrame:
    """Adds ``sample_weight``: label confidence shared by the observations of a track (counts join back small)."""
    n = df.groupBy(*keys).agg(F.count(F.lit(1)).alias("_n"))
    return df.join(n, keys).withColumn("sample_weight", F.col(confidence) / F.greatest(F.col("_n"), F.lit(1))).drop("_n")


def cluster_profiles(df: DataFrame, cluster: str, values: list[str]) -> DataFrame:
    """count, mean, exact median and sample std of every value per cluster, one row per (cluster, metric)."""
    stack = F.explode(F.array(*[F.struct(F.lit(v).alias("metric"), F.col(v).cast("double").alias("v")) for v in values]))
    long = df.select(cluster, stack.alias("_s")).select(cluster, "_s.metric", "_s.v")
    base = long.groupBy(cluster, "metric").agg(
        F.count("v").alias("count"), F.avg("v").alias("mean"), F.stddev_samp("v").alias("std")
    )
    return base.join(quantiles(long, [cluster, "metric"], F.col("v"), {"median": 0.5}), [cluster, "metric"])


def finite(c: Column) -> Column:
    """Infinities and NaN become null."""
    return F.when(F.isnan(c) | (F.abs(c) == F.lit(float("inf"))), None).otherwise(c)


def correlation_matrix(df: DataFrame, cols: list[str]) -> DataFrame:
    """(a, b, corr) of every pair in one pass; a row with a missing value leaves only that pair."""
    clean = df.select(*[finite(F.col(c).cast("double")).alias(c) for c in cols])
    pairs = [(a, b) for i, a in enumerate(cols) for b in cols[i:]]
    one = clean.agg(*[F.corr(a, b).alias(f"{i}") for i, (a, b) in enumerate(pairs)])
    rows = F.array(*[F.struct(F.lit(a).alias("a"), F.lit(b).alias("b"), F.col(f"`{i}`").alias("corr")) for i, (a, b) in enumerate(pairs)])
    return one.select(F.explode(rows).alias("r")).select("r.*")


def aggregate_sequences(frames: DataFrame, cand: DataFrame, tracks: DataFrame, keys: list[str]) -> DataFrame:
    """Sequence rollup: each side is aggregated first, then joined; a sequence without candidates gets zeros."""
    f = frames.groupBy(*keys).agg(
        F.min("frame_index").alias("first_frame"),
        F.max("frame_index").alias("last_frame"),
        F.count(F.lit(1)).alias("frames_observed"),
        F.avg("radius_px").alias("radius_mean_px"),
        F.stddev_pop("radius_px").alias("radius_std_px"),
        F.min("radius_px").alias("radius_min_px"),
        F.max("radius_px").alias("radius_max_px"),
    )
    c = cand.groupBy(*keys).agg(F.count(F.lit(1)).alias("candidate_observations"))
    t = tracks.groupBy(*keys).agg(
        F.count(F.lit(1)).alias("candidate_tracks"),
        F.count_if(F.col("hits") >= 3).alias("persistent_candidate_tracks"),
        F.max("best_proposal_score").alias("max_candidate_score"),
    )
    out = f.join(c, keys, "left").join(t, keys, "left")
    return out.fillna(0, ["candidate_observations", "candidate_tracks", "persistent_candidate_tracks"]).fillna(
        0.0, ["max_candidate_score"]
    )


# Observations of one key that are held against each other in one array.
CIRCLE_ROWS = 512


def dominant_circle(obs: DataFrame, keys: list[str], min_obs: int = 12, min_inliers: int = 10) -> DataFrame:
    """Per key: the densest (x, radius) observation, and the medians of the inliers around it.

    An ordinary key's observations are gathered once, in one array. Those of a crowded key collapse to distinct (x, r) with a
    count, and neighbours meet only through bins of the density window. A key with too few observations or inliers gets
    ``state`` telling so and null medians.
    """
    limit = min(setting(obs.sparkSession, FOLD_ROWS), CIRCLE_ROWS)
    out = union_routes(obs, keys, lambda df: _gathered_circle(df, keys), lambda df: _binned_circle(df, keys), limit)
    few, small = F.col("observations") < min_obs, F.coalesce("inliers", F.lit(0)) < min_inliers
    state = F.when(few, "too_few_observations").when(small, "cluster_too_small").otherwise("ok")
    good = state == "ok"
    return out.withColumns(
        {"state": state, "center_x": F.when(good, F.col("center_x")), "radius": F.when(good, F.col("radius"))}
    )


def _middle(values: Column) -> Column:
    """Median of an array without nulls, interpolated; null when it is empty."""
    ordered, last = F.sort_array(values), F.size(values) - 1
    low = F.get(ordered, F.floor(last / 2).cast("int"))
    return low + (F.get(ordered, F.ceil(last / 2).cast("int")) - low) * (last / 2 - F.floor(last / 2))


def _gathered_circle(obs: DataFrame, keys: list[str]) -> DataFrame:
    rows = obs.groupBy(*keys).agg(F.collect_list(F.struct("x", "r", "obs_idx")).alias("_o"))

    def close(a, b, dx, dr):
        return (F.abs(a["x"] - b["x"]) <= dx) & (F.abs(a["r"] - b["r"]) <= dr)

    def rank(a):
        density = F.size(F.filter("_o", lambda b: close(a, b, 12.0, 7.0)))
        return F.struct(density.alias("density"), (-a["obs_idx"]).alias("first"), a["x"].alias("x"), a["r"].alias("r"))

    # An observation without a place is not even near itself; rows of a null key have no neighbours.
    ranked = F.filter(F.transform("_o", rank), lambda a: a["density"] > 0)
    keyed = F.lit(True)
    for k in keys:
        keyed = keyed & F.col(k).isNotNull()
    seeded = rows.withColumn("_s", F.when(keyed, F.array_max(ranked)))
    seeded = seeded.withColumn("_in", F.when(F.col("_s").isNotNull(), F.filter("_o", lambda a: close(a, F.col("_s"), 14.0, 9.0))))
    return seeded.select(
        *keys,
        F.size("_o").cast("long").alias("observations"),
        F.when(F.col("_in").isNotNull(), F.size("_in")).cast("long").alias("inliers"),
        _middle(F.transform("_in", lambda a: a["x"])).alias("center_x"),
        _middle(F.transform("_in", lambda a: a["r"])).alias("radius"),
    )


def _binned_circle(obs: DataFrame, keys: list[str]) -> DataFrame:
    points = obs.groupBy(*keys, "x", "r").agg(F.count(F.lit(1)).alias("n"), F.min("obs_idx").alias("first"))
    step = F.explode(F.array(F.lit(-1), F.lit(0), F.lit(1)))
    a = points.withColumns({"_bx": F.floor(F.col("x") / 12.0), "_br": F.floor(F.col("r") / 7.0)})
    b = points.select(*keys, F.col("x").alias("ox"), F.col("r").alias("orr"), F.col("n").alias("on"))
    b = b.withColumn("_dx", step).withColumn("_dr", step)
    b = b.withColumns({"_bx": F.floor(F.col("ox") / 12.0) + F.col("_dx"), "_br": F.floor(F.col("orr") / 7.0) + F.col("_dr")})
    near = (F.abs(F.col("x") - F.col("ox")) <= 12.0) & (F.abs(F.col("r") - F.col("orr")) <= 7.0)
    dense = a.join(b, [*keys, "_bx", "_br"]).filter(near).groupBy(*keys, "x", "r", "first").agg(F.sum("on").alias("density"))
    seed = dense.groupBy(*keys).agg(F.max_by(F.struct("x", "r"), F.struct("density", -F.col("first"))).alias("_s"))
    total = obs.groupBy(*keys).agg(F.count(F.lit(1)).alias("observations"))
    inliers = obs.join(seed, keys).filter(
        (F.abs(F.col("x") - F.col("_s.x")) <= 14.0) & (F.abs(F.col("r") - F.col("_s.r")) <= 9.0)
    )
    held = inliers.groupBy(*keys).agg(F.count(F.lit(1)).alias("inliers"))
    mx = quantiles(inliers, keys, F.col("x"), {"center_x": 0.5})
    mr = quantiles(inliers, keys, F.col("r"), {"radius": 0.5})
    return total.join(held, keys, "left").join(mx, keys, "left").join(mr, keys, "left")


def inlier_median(obs: DataFrame, keys: list[str], reach: float = 24.0, min_inliers: int = 8) -> DataFrame:
    """Medians over observations within ``reach`` of the plain median x; with too few of them the plain medians stay."""
    first = quantiles(obs, keys, F.col("x"), {"mx": 0.5}).join(quantiles(obs, keys, F.col("r"), {"mr": 0.5}), keys)
    near = obs.join(first, keys).filter(F.abs(F.col("x") - F.col("mx")) <= reach)
    n = near.groupBy(*keys).agg(F.count(F.lit(1)).alias("inliers"))
    again = quantiles(near, keys, F.col("x"), {"ix": 0.5}).join(quantiles(near, keys, F.col("r"), {"ir": 0.5}), keys)
    out = first.join(n, keys, "left").join(again, keys, "left")
    enough = F.coalesce("inliers", F.lit(0)) >= min_inliers
    return out.select(
        *keys,
        F.coalesce("inliers", F.lit(0)).alias("inliers"),
        F.when(enough, F.col("ix")).otherwise(F.col("mx")).alias("center_x"),
        F.when(enough, F.col("ir")).otherwise(F.col("mr")).alias("radius"),
    )
