"""Tracking operators: each has a table form and a stream form on the same kernel."""

from __future__ import annotations

from pyspark.sql import DataFrame, functions as F
from pyspark.sql.types import StructType

from boxtrail.operators import association as assoc
from boxtrail.operators.ordered import indexed
from boxtrail.streaming import kernels as k
from boxtrail.streaming.replay import replay
from boxtrail.streaming.stateful import Clock, run_stream, run_timed

LINE_OUT = (
    "kind string, frame_index long, track_id long, class_id int, class_name string, confidence double, center_x double, "
    "center_y double, width double, height double, velocity_x double, velocity_y double, hits int, misses int, "
    "confirmed boolean, counted boolean, predicted boolean, last_seen long"
)
OPTIMAL_OUT = (
    "frame_index long, det_idx long, track_id long, class_id int, center_x double, center_y double, crossed boolean"
)
POINT_OUT = (
    "kind string, frame_index long, det_idx long, track_id long, x double, y double, first_frame long, last_frame long, "
    "hits int, mean_score double, max_score double, best_frame long, confidence double, confirmed boolean"
)
SEQUENCE_OUT = "frame_index long, track_id long, x double, y double, velocity double, is_new boolean"
TWO_HIT_OUT = "frame_index long, track_id long, y double, score double"
RING_OUT = "frame_index long, class_id int, y double, first_frame long, delay_frames long, cost double"
ASSOC_OUT = (
    "frame_index long, class_id int, event_id long, upstream_id long, delay_frames long, cross_axis_distance double, verified boolean"
)
CONSENSUS_OUT = (
    "state string, frame_index long, class_id int, first_id long, second_id long, delay_frames long, "
    "cross_axis_distance double, fused_confidence double, cumulative_count long"
)


def _config_of(cfg, key: str | None):
    """One configuration for all sources, or one per value of a key column."""
    if isinstance(cfg, dict):
        return lambda at: cfg[at[key]]
    return lambda at: cfg


def _widest(cfg) -> int:
    return max(c.longest_miss for c in cfg.values()) if isinstance(cfg, dict) else cfg.longest_miss


def _is_stream(df: DataFrame) -> bool:
    return df.isStreaming


def _run(df, keys, tie, kernel, cfg, out, config_key=None, drain=False, renumber=True, frame="frame_index", slack=1, ends=None, clock=None):
    pick = _config_of(cfg, config_key)

    def make(at):
        return kernel(pick(at))

    # A key column is already in front of the output.
    out = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in StructType.fromDDL(out).fields if f.name not in keys)
    if _is_stream(df) and clock is not None:
        return run_timed(df, keys, frame, tie, make, out, clock, _widest(cfg) + slack, drain)
    if _is_stream(df):
        return run_stream(df, keys, frame, tie, make, out)
    return replay(df, keys, frame, tie, make, out, _widest(cfg) + slack, drain, renumber, ends)


def track_lines(
    det: DataFrame, keys: list[str], cfg, region_key: str | None = None, tie: list[str] | None = None, ends: DataFrame | None = None,
    clock: Clock | None = None,
) -> DataFrame:
    """Crossing events (kind ``event``) and, when configured, track observations per frame (kind ``observation``) and
    updates of confirmed tracks without a detection (kind ``coasted``).

    ``det`` has keys, frame_index, class_id, class_name, confidence, x1..y2. ``ends`` (keys, last_frame) is for tables
    whose sources go on without detections after their last row. A stream with a ``clock`` (and a watermark on its column)
    closes frames by event time; without one, the newest frame of a source waits for the next.
    """
    tie = tie or ["det_idx"]
    out = _run(det, keys, tie, k.LineTracker, cfg, LINE_OUT, region_key, ends=ends, clock=clock)
    return out if _is_stream(det) else out.withColumnRenamed("_seg", "segment").withColumnRenamed("_seq", "seq")


def crossing_events(tracked: DataFrame, keys: list[str]) -> DataFrame:
    """Events of a tracked table with running counts per key and class and an id per key in emission order."""
    events = tracked.filter("kind = 'event'")
    order = ["frame_index", "segment", "seq"]
    counted = indexed(events, [*keys, "class_id"], order, "cumulative_count")
    return indexed(counted, keys, order, "event_id").drop("kind", "segment", "seq")


def track_optimal(det: DataFrame, keys: list[str], cfg, tie: list[str] | None = None, clock: Clock | None = None) -> DataFrame:
    out = _run(det, keys, tie or ["det_idx"], k.OptimalTracker, cfg, OPTIMAL_OUT, clock=clock)
    return out if _is_stream(det) else out.drop("_seg", "_seq")


def track_points(points: DataFrame, keys: list[str], cfg, tie: list[str] | None = None, clock: Clock | None = None) -> DataFrame:
    """Observations and finished tracks of scored points (x, y, score). Keys include the sequence, so it resets there."""
    out = _run(points, keys, tie or ["det_idx"], k.PointTracker, cfg, POINT_OUT, drain=True, clock=clock)
    return out if _is_stream(points) else out.drop("_seg", "_seq")


def sequence_filter(points: DataFrame, keys: list[str], cfg) -> DataFrame:
    out = _run(points, keys, ["y"], k.SequenceFilter, cfg, SEQUENCE_OUT, slack=0)
    return out if _is_stream(points) else out.drop("_seg", "_seq")


def two_hit(points: DataFrame, keys: list[str], cfg) -> DataFrame:
    out = _run(points, keys, ["det_idx"], k.TwoHit, cfg, TWO_HIT_OUT)
    return out if _is_stream(points) else out.drop("_seg", "_seq")


def consensus_counter(events: DataFrame, keys: list[str], cfg) -> DataFrame:
    """Agreed events of two per-frame sources (side 0/1, class_id, y, score) with a bounded history."""
    return _run(events, keys, ["side", "class_id", "y"], k.RingConsensus, cfg, RING_OUT, renumber=False, slack=2)


def associate_stream(events: DataFrame, keys: list[str], cfg, clock: Clock | None = None) -> DataFrame:
    """Associator over tagged events (side 0 upstream, 1 downstream); the table form is ``associate_events``."""
    return _run(events, keys, ["side", "event_id"], k.Associator, cfg, ASSOC_OUT, renumber=False, clock=clock)


def consensus_stream(events: DataFrame, keys: list[str], cfg, clock: Clock | None = None) -> DataFrame:
    """Consensus over tagged events in arrival order (frame column ``current_frame``; rows keep ``event_frame``).

    A stream with a ``clock`` rejects every event that stays unmatched, by a timer where no later row does.
    """
    return _run(events, keys, ["side", "event_id"], k.Consensus, cfg, CONSENSUS_OUT, renumber=False, frame="current_frame", slack=2, clock=clock)


def refractory(peaks: DataFrame, keys: list[str], frame: str, wait: int) -> DataFrame:
    """Peaks at least ``wait`` frames after the last emitted one, walked in frame order.

    A source with many peaks is cut at pauses of ``wait`` frames and streamed through in order once, with one frame of state.
    """
    from boxtrail.operators.selection import greedy_keep
    from boxtrail.operators.skew import union_routes

    size = max(int(wait), 1)
    base = F.floor(F.col(frame) / size)

    def conflict(kept, row):
        return F.abs(kept(frame) - row(frame)) < wait

    def bounded(rows):
        return greedy_keep(rows, keys, [frame], [frame], conflict, F.sequence(base, base + 1)).select(*keys, frame)

    def walked(rows):
        cfg = k.WaitConfig(int(wait))
        kept = replay(rows, keys, frame, [], lambda at: k.Refractory(cfg), "kept_frame long", size, renumber=False)
        return kept.select(*keys, F.col("kept_frame").cast(rows.schema[frame].dataType).alias(frame))

    # A peak without a frame or a key is joined to nothing below.
    kept = union_routes(peaks.select(*keys, frame).dropna().distinct(), keys, bounded, walked)
    return peaks.join(kept, [*keys, frame])


def dual_roi_counts(
    det: DataFrame, source: str, region: str, cfg: dict, upstream: str, downstream: str, pair: k.PairConfig
) -> DataFrame:
    """Both regions tracked, then downstream crossings associated with upstream ones; verified rows are the counts.

    ``upstream`` may have no detections at all; its crossings are then unverified.
    """
    keys = [source, region]
    events = crossing_events(track_lines(det, keys, cfg, region), keys)
    by = [source, "class_id"]

    def side(name):
        cols = ["event_id", "frame_index", "center_x", "center_y", "confidence", "velocity_x", "track_id", "class_name"]
        return events.filter(F.col(region) == name).select(*by, *cols)

    linked = assoc.associate_events(
        side(upstream), side(downstream), by, pair.min_delay, pair.max_delay, pair.max_cross, pair.line_distance, pair.preserve_order
    )
    verified = indexed(linked.filter("verified"), by, ["frame_index", "event_id"], "verified_count")
    return linked.join(verified.select(*by, "event_id", "verified_count"), [*by, "event_id"], "left")


def fusion_counts(first: DataFrame, second: DataFrame, source: str, cfg_first, cfg_second, pair: k.PairConfig) -> DataFrame:
    """A tracker per branch, crossings joined by consensus; one row per accepted event."""
    by = [source, "class_id"]

    def crossings(det, cfg):
        rows = crossing_events(track_lines(det, [source], cfg), [source])
        return rows.select(
            *by, "event_id", "frame_index", "center_y", "confidence",
            F.col("frame_index").alias("arrival"), F.col("frame_index").alias("current_frame"),
        )

    return assoc.consensus(
        crossings(first, cfg_first), crossings(second, cfg_second), by,
        pair.min_delay, pair.max_delay, pair.nominal, pair.max_cross,
    )
