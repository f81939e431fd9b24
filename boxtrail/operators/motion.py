"""Inter-frame motion of droplets."""

from __future__ import annotations

from pyspark.sql import DataFrame, functions as F

from boxtrail.operators.greedy import greedy_pairs
from boxtrail.operators.matching import near_pairs
from boxtrail.operators.ordered import lagged, quantiles


def estimate_velocity(det: DataFrame, keys: list[str], max_distance: float = 80.0, max_vertical: float = 30.0) -> DataFrame:
    """Median displacement per frame between each frame and the one before it (keys, frame_index, vx, vy, matches).

    ``det`` has droplet centers (keys, frame_index, det_idx, confidence, x, y). Current boxes, by confidence, take the
    nearest free previous box inside both gates. A frame without matches gets zeros.
    """
    frames = det.select(*keys, "frame_index").distinct()
    links = lagged(frames, keys, ["frame_index"], {"prev_frame": F.col("frame_index")})
    known = links.filter("prev_frame is not null")
    cur = det.join(known, [*keys, "frame_index"]).select(
        *keys, "frame_index", "prev_frame", (-F.col("confidence")).alias("neg"), F.col("det_idx").alias("cur_idx"), "x", "y"
    )
    ahead = known.withColumnRenamed("frame_index", "next_frame").withColumnRenamed("prev_frame", "frame_index")
    prev = det.join(ahead, [*keys, "frame_index"]).select(
        *keys, F.col("next_frame").alias("frame_index"), F.col("det_idx").alias("prev_idx"), "x", "y"
    )
    group = [*keys, "frame_index"]
    pairs = near_pairs(cur, prev, group, ("x", "y"), max_distance)
    gated = pairs.filter(F.abs(F.col("y") - F.col("y_r")) <= max_vertical).select(
        *group, "neg", "cur_idx", "distance", F.col("prev_idx_r").alias("prev_idx"), "prev_frame",
        (F.col("x") - F.col("x_r")).alias("dx"), (F.col("y") - F.col("y_r")).alias("dy"),
    )
    taken = greedy_pairs(gated, group, "cur_idx", "prev_idx", ["neg", "cur_idx", "distance", "prev_idx", "prev_frame", "dx", "dy"])
    span = F.col("frame_index") - F.col("prev_frame")
    moves = taken.select(*group, (F.col("dx") / span).alias("vx"), (F.col("dy") / span).alias("vy"))
    n = moves.groupBy(*group).agg(F.count(F.lit(1)).alias("matches"))
    mx = quantiles(moves, group, F.col("vx"), {"vx": 0.5})
    my = quantiles(moves, group, F.col("vy"), {"vy": 0.5})
    out = frames.join(n, group, "left").join(mx, group, "left").join(my, group, "left")
    return out.fillna(0, ["matches"]).fillna(0.0, ["vx", "vy"])
