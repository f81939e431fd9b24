"""Window-style columns over ordered streams. Hot keys are spread by ``operators.ordered``."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window, functions as F

from boxtrail.operators.ordered import Ordered, indexed, lagged, running, value_ranks
from boxtrail.operators.skew import union_routes
from boxtrail.session import WINDOW_ROWS, setting


def pct_rank_avg(df: DataFrame, keys: list[str], value: str, name: str) -> DataFrame:
    """Rank in (0, 1] with the average rank for ties; a missing value gets 0.5."""
    ranks = value_ranks(df, keys, F.col(value))
    rank = (F.col("below") + (F.col("ties") + 1) / 2) / F.col("n")
    table = ranks.select(*keys, F.col("value").alias(value), rank.alias(name))
    # ``value`` values are unique per key here, so the join cannot multiply rows; a hot value is split by AQE.
    return df.join(table, [*keys, value], "left").withColumn(name, F.coalesce(name, F.lit(0.5)))


def trailing(df: DataFrame, keys: list[str], order: list[str], size: int, chunk: Column, aggs) -> DataFrame:
    """Columns over the last ``size`` rows. Each chunk of the order also receives the rows just before it.

    ``aggs(window)`` returns the columns by name. ``chunk`` is a column of the order (frame // 65536, a day) that
    bounds a task; the seam rows it needs from the chunk before are added to it and dropped afterwards.
    """
    numbered = indexed(df, keys, order, "_rn")
    rows = numbered.withColumn("_chunk", F.floor((F.col("_rn") - 1) / chunk))
    # The last size-1 rows of a chunk also travel to the next one.
    near_end = (F.col("_rn") - 1) % chunk >= chunk - (size - 1)
    copies = rows.filter(near_end).withColumn("_chunk", F.col("_chunk") + 1).withColumn("_copy", F.lit(True))
    spread = rows.withColumn("_copy", F.lit(False)).unionByName(copies)
    w = Window.partitionBy(*keys, "_chunk").orderBy("_rn").rowsBetween(-(size - 1), 0)
    return spread.select("*", *[c.alias(n) for n, c in aggs(w).items()]).filter(~F.col("_copy")).drop("_chunk", "_copy")


CHUNK = 65536


def rolling_mean(df: DataFrame, keys: list[str], order: list[str], value: str, size: int, name: str) -> DataFrame:
    out = trailing(df, keys, order, size, F.lit(max(CHUNK, size)), lambda w: {name: F.avg(value).over(w)})
    return out.drop("_rn")


def moving_average(df: DataFrame, keys: list[str], order: list[str], value: str, size: int, name: str) -> DataFrame:
    """Trailing mean of ``size`` values, left edge padded with the first value; short series stay as they are."""
    first = df.groupBy(*keys).agg(
        F.min_by(value, F.struct(*order)).alias("_first"), F.count(F.lit(1)).alias("_n")
    )
    out = trailing(df, keys, order, size, F.lit(max(CHUNK, size)), lambda w: {"_sum": F.sum(value).over(w)})
    pad = F.greatest(F.lit(size) - F.col("_rn"), F.lit(0)) * F.col("_first")
    mean = F.when((F.col("_n") < size) | F.lit(size <= 1), F.col(value)).otherwise((F.col("_sum") + pad) / size)
    return out.join(first, keys).withColumn(name, mean).drop("_rn", "_sum", "_first", "_n")


def step_features(df: DataFrame, keys: list[str], order: list[str], x: str, y: str, radius: str) -> DataFrame:
    """Distance and radius change from the previous row of the key, 0 on the first."""
    prev = {"_px": F.col(x), "_py": F.col(y), "_pr": F.col(radius)}
    rows = lagged(df, keys, order, prev)
    dx, dy = F.col(x) - F.col("_px"), F.col(y) - F.col("_py")
    return rows.withColumns(
        {
            "step_px": F.coalesce(F.sqrt(dx * dx + dy * dy), F.lit(0.0)),
            "radius_change": F.coalesce(F.col(radius) - F.col("_pr"), F.lit(0.0)),
        }
    ).drop("_px", "_py", "_pr")


def segment_sequences(df: DataFrame, keys: list[str], frame: str, y: str, max_missing: int, jump: float) -> DataFrame:
    """Adds ``sequence_id``: a new one on the first row, a gap over ``max_missing``, or a rise of y over ``jump``."""
    rows = lagged(df, keys, [frame], {"_pf": F.col(frame), "_py": F.col(y)})
    new = (
        F.col("_pf").isNull() | (F.col(frame) - F.col("_pf") > max_missing) | (F.col(y) - F.col("_py") > jump)
    ).cast("long")
    flagged = rows.withColumn("_new", new).drop("_pf", "_py")
    return running(flagged, keys, [frame], {"sequence_id": F.col("_new")}).drop("_new")


def bursts(packets: DataFrame, keys: list[str], gap: float, ident: list[str]) -> DataFrame:
    """De-duplicated packets grouped into bursts: a new burst when the pause exceeds ``gap`` seconds."""
    once = packets.groupBy(*keys, *[i for i in ident if i not in keys]).agg(F.min("ts").alias("ts"))
    rows = lagged(once, keys, ["ts", *[i for i in ident if i not in keys]], {"_pt": F.col("ts")})
    new = (F.col("_pt").isNull() | (F.col("ts") - F.col("_pt") > gap)).cast("long")
    order = ["ts", *[i for i in ident if i not in keys]]
    marked = running(rows.withColumn("_new", new), keys, order, {"burst_id": F.col("_new")})
    return marked.groupBy(*keys, "burst_id").agg(
        F.min("ts").alias("start_ts"),
        F.max("ts").alias("end_ts"),
        F.sum("size").alias("bytes"),
        F.count(F.lit(1)).alias("packets"),
        ((F.max("ts") - F.min("ts")) * 1000).alias("ms"),
    )


def temporal_peaks(df: DataFrame, keys: list[str], frame: str, score: str, threshold: float) -> DataFrame:
    """Middle of three consecutive rows with score >= threshold, >= the one before and > the one after."""
    rows = lagged(df, keys, [frame], {"_p1": F.struct(*df.columns)})
    rows = lagged(rows, keys, [frame], {"_p2": F.col("_p1")})
    mid, before = F.col("_p1"), F.col("_p2")
    hit = (
        before.isNotNull()
        & (mid[score] >= threshold)
        & (mid[score] >= before[score])
        & (mid[score] > F.col(score))
    )
    return rows.filter(hit).select("_p1.*")


def cumulative_counts(df: DataFrame, keys: list[str], order: list[str], name: str = "cumulative_count") -> DataFrame:
    return indexed(df, keys, order, name)


def serial_ids(df: DataFrame, order: list, prefix: str, digits: int = 4, keys: list[str] | None = None) -> DataFrame:
    """Serial ids like D0001 in order, numbered across the whole table or per key."""
    rows = indexed(df, keys or [], order, "_n")
    return rows.withColumn("serial_id", F.format_string(f"{prefix}%0{digits}d", "_n")).drop("_n")


def best_in_window(frames: DataFrame, targets: DataFrame, keys: list[str], window: int, score: str) -> DataFrame:
    """For targets in order, the best unused frame within ``window`` (ties: lower frame). No frame is used twice."""
    from boxtrail.operators.greedy import greedy_pairs

    size = max(2 * window, 1)
    near = frames.withColumn("_b", F.explode(F.array(F.floor(F.col("frame_index") / size), F.floor(F.col("frame_index") / size) + 1)))
    # A target at t looks at t-window..t+window: shifted by window, that range starts in its own bin.
    t = targets.withColumn("_b", F.floor((F.col("target") + window) / size))
    gap = F.abs(F.col("frame_index") - F.col("target")) <= window
    edges = near.join(t, [*keys, "_b"]).filter(gap).select(
        *keys, "target", "frame_index", (-F.col(score)).alias("_neg")
    ).distinct()
    taken = greedy_pairs(edges, keys, "target", "frame_index", ["target", "_neg", "frame_index"])
    return taken.select(*keys, "target", "frame_index", (-F.col("_neg")).alias(score))


def latest_result(frames: DataFrame, results: DataFrame, keys: list[str], frame: str, done: str) -> DataFrame:
    """As-of join: for each display frame the latest result finished at or before it, and the lag in frames.

    Results have (keys, ``done``: frame at which it became available, ``result_frame``). Both sides are stacked and
    the last result is carried forward, so nothing is paired. Hot keys carry it across range partitions.
    """
    a = frames.select(*keys, F.col(frame).alias("_t"), F.lit(1).alias("_side"), F.lit(None).cast("long").alias("_r"))
    b = results.select(*keys, F.col(done).alias("_t"), F.lit(0).alias("_side"), F.col("result_frame").cast("long").alias("_r"))
    rows = a.unionByName(b)
    order = ["_t", "_side", "_r"]

    def plain(df):
        w = Window.partitionBy(*keys).orderBy(*order).rowsBetween(Window.unboundedPreceding, 0)
        return df.withColumn("_last", F.last("_r", ignorenulls=True).over(w))

    def spread(df):
        return Ordered(df, keys, order).latest("_last", F.col("_r"))

    joined = union_routes(rows, keys, plain, spread, setting(frames.sparkSession, WINDOW_ROWS))
    lag = F.when(F.col("_last").isNull(), 0).otherwise(F.greatest(F.lit(0), F.col("_t") - F.col("_last")))
    return joined.filter("_side = 1").select(
        *keys, F.col("_t").alias(frame), F.col("_last").alias("latest_result"), lag.alias("lag_frames")
    )
