"""One-to-one association of event streams: upstream/downstream lines and two-source consensus."""

from __future__ import annotations

from pyspark.sql import DataFrame, functions as F

from boxtrail.operators.greedy import greedy_pairs
from boxtrail.operators.ordered import indexed
from boxtrail.operators.skew import split_hot
from boxtrail.session import materialize

EVENT = ["event_id", "frame_index", "center_x", "center_y", "confidence", "velocity_x"]


def _interval_edges(early: DataFrame, late: DataFrame, keys: list[str], low: int, high: int) -> DataFrame:
    """Pairs with low <= late frame - early frame <= high, joined on frame bins (columns prefixed u_ and d_)."""
    size = max(1, high - low + 1)
    u = early.select(*keys, *[F.col(c).alias(f"u_{c}") for c in early.columns if c not in keys])
    d = late.select(*keys, *[F.col(c).alias(f"d_{c}") for c in late.columns if c not in keys])
    u = u.withColumn("_b", F.floor(F.col("u_frame_index") / size))
    first, last = (F.floor((F.col("d_frame_index") - x) / size) for x in (high, low))
    d = d.withColumn("_b", F.explode(F.sequence(first, last)))
    delay = F.col("d_frame_index") - F.col("u_frame_index")
    return u.join(d, [*keys, "_b"]).withColumn("delay", delay).filter(delay.between(low, high)).drop("_b")


def associate_events(
    upstream: DataFrame,
    downstream: DataFrame,
    keys: list[str],
    min_delay: int,
    max_delay: int,
    max_cross: float,
    line_distance: float,
    preserve_order: bool = False,
) -> DataFrame:
    """Each downstream event, in order, takes the best free upstream event of its class; unmatched ones stay with nulls.

    ``keys`` must include the class. The score is the delay error against line distance / speed plus the cross-axis
    share; with ``preserve_order`` the oldest upstream event wins. Events have unique increasing ``event_id`` per key.
    Keys with many pairs walk their events in order once instead, cut at pauses; the number of jobs does not grow with them.
    """
    pairs = _interval_edges(upstream, downstream, keys, min_delay, max_delay)
    cross = F.abs(F.col("d_center_y") - F.col("u_center_y"))
    speed = F.abs(F.col("u_velocity_x"))
    expected = F.when(speed >= 0.25, F.lit(float(line_distance)) / speed).otherwise(F.col("delay").cast("double"))
    score = F.abs(F.col("delay") - expected) / F.greatest(expected, F.lit(1.0)) + cross / max(max_cross, 1.0)
    edges = pairs.withColumn("cross", cross).filter(F.col("cross") <= max_cross).select(
        *keys, "d_frame_index", "d_event_id", "u_frame_index", "u_event_id", score.alias("score"), "delay", "cross"
    )
    prefer = ["u_frame_index", "score"] if preserve_order else ["score", "u_frame_index"]
    order = ["d_frame_index", "d_event_id", *prefer, "u_event_id"]
    cold, hot = split_hot(materialize(edges), keys)
    taken = greedy_pairs(cold, keys, "d_event_id", "u_event_id", [*order, "delay", "cross"])
    links = taken.select(
        *keys, F.col("d_event_id").alias("event_id"), F.col("u_event_id").alias("upstream_id"),
        F.col("delay").alias("delay_frames"), F.col("cross").alias("cross_axis_distance"),
    )
    if hot is not None:
        busy = hot.select(*keys).distinct()
        setting = {"max_delay": max_delay, "max_cross": max_cross, "line_distance": line_distance, "preserve_order": preserve_order}
        links = links.unionByName(_walked_links(upstream.join(busy, keys), downstream.join(busy, keys), keys, min_delay, setting))
    out = downstream.join(links, [*keys, "event_id"], "left")
    return out.withColumn("verified", F.col("upstream_id").isNotNull())


def _walked_links(upstream: DataFrame, downstream: DataFrame, keys: list[str], min_delay: int, setting: dict) -> DataFrame:
    """The links of ``associate_events`` from one ordered pass per key over both sides, whose state is the waiting upstream events."""
    from boxtrail.streaming import kernels
    from boxtrail.streaming.trackers import associate_stream

    def side(df, number):
        cols = [F.col(c) for c in ("event_id", "frame_index", "center_y", "velocity_x")]
        other = [] if "class_id" in keys else [F.lit(0).alias("class_id")]
        rows = df.select(*keys, *cols, *other, F.lit(0.0).alias("confidence"), F.lit(number).alias("side"))
        # What lacks a place or a time is linked with nothing.
        return rows.dropna(subset=["event_id", "frame_index", "center_y"])

    found = associate_stream(side(upstream, 0).unionByName(side(downstream, 1)), keys, kernels.PairConfig(min_delay=min_delay, **setting))
    return found.filter("verified").select(*keys, "event_id", "upstream_id", "delay_frames", "cross_axis_distance")


def consensus(
    first: DataFrame,
    second: DataFrame,
    keys: list[str],
    min_delay: int,
    max_delay: int,
    nominal: float,
    max_cross: float,
) -> DataFrame:
    """Fused events of two sources that arrive in any order (``arrival``: step, ``current_frame``: frame at that step).

    A pair becomes possible when its later side arrives, if neither side has expired by then (first: max_delay frames,
    second: twice that). Taking pairs by (arrival, cost) replays the arrival order exactly, so one greedy pass over
    the whole history gives the stream's answer. ``keys`` includes the class; arrival frames must not go back.
    """
    pairs = _interval_edges(first, second, keys, min_delay, max_delay)
    cross = F.abs(F.col("d_center_y") - F.col("u_center_y"))
    step = F.greatest("u_arrival", "d_arrival")
    now = F.greatest("u_current_frame", "d_current_frame")
    alive = (F.col("u_frame_index") >= now - max_delay) & (F.col("d_frame_index") >= now - 2 * max_delay)
    time_error = F.abs(F.col("delay") - nominal) / max(1.0, max_delay - min_delay)
    mean_conf = 0.5 * (F.col("u_confidence") + F.col("d_confidence"))
    cost = 0.58 * time_error + 0.42 * (cross / max(1.0, max_cross)) - 0.15 * mean_conf
    edges = pairs.withColumn("cross", cross).filter((F.col("cross") <= max_cross) & alive)
    edges = edges.select(
        *keys, step.alias("step"), cost.alias("cost"), "u_arrival", "u_event_id", "d_arrival", "d_event_id",
        "u_frame_index", "d_frame_index", "delay", "cross", "u_confidence", "d_confidence",
    )
    order = ["step", "cost", "u_arrival", "u_event_id", "d_arrival", "d_event_id"]
    rest = ["u_frame_index", "d_frame_index", "delay", "cross", "u_confidence", "d_confidence"]
    taken = greedy_pairs(edges, keys, "u_event_id", "d_event_id", [*order, *rest])
    fused = F.sqrt(F.greatest(F.lit(0.0), F.col("u_confidence") * F.col("d_confidence")))
    rows = taken.withColumn("fused_confidence", fused)
    return indexed(rows, keys, order, "cumulative_count").select(
        *keys, "step", F.col("u_event_id").alias("first_id"), F.col("d_event_id").alias("second_id"),
        F.col("u_frame_index").alias("first_frame"), F.col("d_frame_index").alias("second_frame"),
        F.col("delay").alias("delay_frames"), F.col("cross").alias("cross_axis_distance"), "fused_confidence", "cumulative_count",
    )


def consensus_leftovers(first: DataFrame, second: DataFrame, fused: DataFrame, keys: list[str], max_delay: int) -> DataFrame:
    """Unmatched events per key and side: ``rejected`` once expired at the last arrival, else ``pending``."""
    ends = first.select(*keys, "current_frame").unionByName(second.select(*keys, "current_frame"))
    last = ends.groupBy(*keys).agg(F.max("current_frame").alias("_now"))

    def side(df, ident, name, keep):
        left = df.join(fused.select(*keys, F.col(ident).alias("event_id")), [*keys, "event_id"], "left_anti").join(last, keys)
        gone = F.col("frame_index") < F.col("_now") - keep
        return left.groupBy(*keys).agg(
            F.count_if(gone).alias("rejected"), F.count_if(~gone).alias("pending")
        ).withColumn("side", F.lit(name))

    return side(first, "first_id", "first", max_delay).unionByName(side(second, "second_id", "second", 2 * max_delay))
