"""Merging detections of overlapping tiles into one region."""

from __future__ import annotations

from pyspark.sql import DataFrame, functions as F

from boxtrail.operators.matching import nms
from boxtrail.operators.ordered import lagged


def owned_boxes(det: DataFrame, tiles: DataFrame) -> DataFrame:
    """Region-normalized boxes, each kept only by the tile whose center is nearest (half-open boundaries).

    ``tiles`` has one row per image: source_id, image_id, tile_x, tile_y, tile_w, tile_h.
    """
    mid = F.col("tile_x") + F.col("tile_w") / 2
    rows = tiles.withColumn("_mid", mid)
    rows = lagged(rows, ["source_id"], ["tile_x", "image_id"], {"_before": F.col("_mid")})
    back = {"_nx": -F.col("tile_x"), "_ni": -F.col("image_id")}
    rows = lagged(rows.withColumns(back), ["source_id"], ["_nx", "_ni"], {"_after": F.col("_mid")})
    region = tiles.groupBy("source_id").agg(
        F.min("tile_x").alias("_rx1"),
        F.min("tile_y").alias("_ry1"),
        F.max(F.col("tile_x") + F.col("tile_w")).alias("_rx2"),
        F.max(F.col("tile_y") + F.col("tile_h")).alias("_ry2"),
    )
    bounds = rows.join(region, "source_id").withColumns(
        {"_lo": (F.col("_mid") + F.col("_before")) / 2, "_hi": (F.col("_mid") + F.col("_after")) / 2}
    )
    d = det.join(bounds, "image_id")
    ax1, ax2 = (F.col("tile_x") + F.col(c) * F.col("tile_w") for c in ("x1", "x2"))
    ay1, ay2 = (F.col("tile_y") + F.col(c) * F.col("tile_h") for c in ("y1", "y2"))
    cx = (ax1 + ax2) / 2
    owned = (F.col("_lo").isNull() | (cx >= F.col("_lo"))) & (F.col("_hi").isNull() | (cx < F.col("_hi")))
    rw, rh = F.col("_rx2") - F.col("_rx1"), F.col("_ry2") - F.col("_ry1")
    return d.filter(owned).select(
        "source_id",
        "image_id",
        "class_id",
        "det_idx",
        "confidence",
        ((ax1 - F.col("_rx1")) / rw).alias("x1"),
        ((ay1 - F.col("_ry1")) / rh).alias("y1"),
        ((ax2 - F.col("_rx1")) / rw).alias("x2"),
        ((ay2 - F.col("_ry1")) / rh).alias("y2"),
    )


def merge_tiles(det: DataFrame, tiles: DataFrame, threshold: float = 0.5) -> DataFrame:
    """Owned boxes of all tiles of a source after class-wise suppression."""
    rows = owned_boxes(det, tiles).withColumn("det_idx", F.struct("image_id", "det_idx"))
    kept = nms(rows, threshold, ["source_id", "class_id"])
    return kept.select(
        "source_id",
        "class_id",
        F.col("det_idx.image_id").alias("image_id"),
        F.col("det_idx.det_idx").alias("det_idx"),
        "confidence",
        "x1",
        "y1",
        "x2",
        "y2",
    )
