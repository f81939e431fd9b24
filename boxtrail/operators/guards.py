"""Accept rules that look at a second source: containment, local support, measured circles."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F

from boxtrail.functions import geometry as g
from boxtrail.operators.skew import split_pair
from boxtrail.session import FOLD_ROWS, setting


def associate(
    det: DataFrame,
    expansion: float,
    keep_orphans: bool,
    orphan_threshold: float,
    cell_class: int = 0,
    droplet_class: int = 1,
    keys: list[str] | None = None,
    grid: float = 0.125,
) -> DataFrame:
    """Drop inner-class boxes whose center lies in no expanded outer box, unless they are confident orphans."""
    keys = keys or ["image_id"]
    cells = det.filter(F.col("class_id") == cell_class)
    droplets = det.filter(F.col("class_id") == droplet_class).select(*keys, *g.Box._fields)
    others = det.filter(F.col("class_id") != cell_class)
    sure = keep_orphans & (F.col("confidence") >= orphan_threshold) if keep_orphans else F.lit(False)
    unsure = cells.filter(~sure)
    cx, cy = g.center(g.box("c"))
    inside = g.in_expanded_box(cx, cy, g.box("d"), expansion)

    def semi(rows, boxes, on):
        cond = [F.col(f"c.{k}") == F.col(f"d.{k}") for k in on] + [inside]
        return rows.alias("c").join(boxes.alias("d"), cond, "left_semi")

    cold, hot = split_pair(unsure, droplets, keys)
    held = semi(*cold, keys)
    if hot is not None:
        px, py = g.center(g.box())
        hw, hh = (F.col("x2") - F.col("x1")) * expansion / 2, (F.col("y2") - F.col("y1")) * expansion / 2

        def span(mid, half):
            return F.explode(F.sequence(F.floor((mid - half) / grid), F.floor((mid + half) / grid)))

        rows = hot[0].withColumns({"_bx": F.floor(px / grid), "_by": F.floor(py / grid)})
        boxes = hot[1].withColumn("_bx", span(px, hw)).withColumn("_by", span(py, hh))
        held = held.unionByName(semi(rows, boxes, [*keys, "_bx", "_by"]).drop("_bx", "_by"))
    return others.unionByName(cells.filter(sure)).unionByName(held)


# Support points of one key that a row may look through one by one.
SUPPORT_ROWS = 512


def with_support(rows: DataFrame, support: DataFrame, radius: float, keys: list[str], asks: Column | None = None) -> DataFrame:
    """Adds the strongest support point (response, contrast) within ``radius`` of a row on both axes; ties by (y, x).

    Rows without one, and rows that ``asks`` does not hold for, keep nulls. The points of an ordinary key stand together in one
    array and every row looks through its key's. A crowded key's sides meet on bins of the radius instead, so it is spread over
    its bins: support points of one place collapse to the strongest and rows of one place ask once, so on whole pixels a bin
    holds at most radius x radius of each, however dense it is.
    """
    asks = F.lit(True) if asks is None else asks
    step = float(radius) if radius else 1.0
    points = support.select(*keys, "x", "y", "response", "contrast")
    limit = min(setting(rows.sparkSession, FOLD_ROWS), SUPPORT_ROWS)
    cold, hot = split_pair(rows, points, keys, limit)

    def strongest(found):
        return found.withColumns({c: F.col(f"_best.{c}") for c in ("response", "contrast")}).select(*rows.columns, "response", "contrast")

    point = F.struct("response", (-F.col("y")).alias("_ny"), (-F.col("x")).alias("_nx"), "contrast", "x", "y")
    packed = cold[1].groupBy(*keys).agg(F.collect_list(point).alias("_points"))

    def close(p):
        return (F.abs(F.col("x") - p["x"]) <= radius) & (F.abs(F.col("y") - p["y"]) <= radius)

    best = F.when(asks, F.array_max(F.filter("_points", close)))
    out = strongest(cold[0].join(packed, keys, "left").withColumn("_best", best))
    if hot is None:
        return out

    def binned(df):
        return df.withColumns({"_bx": F.floor(F.col("x") / step), "_by": F.floor(F.col("y") / step)})

    near = F.expr("explode(array(-1L,0L,1L))")
    place = [*keys, "x", "y"]
    peaks = hot[1].groupBy(*place).agg(F.max(F.struct("response", "contrast")).alias("_p")).select(*place, "_p.*")
    pts = binned(peaks).withColumn("_ox", near).withColumn("_oy", near)
    pts = pts.withColumns({"_bx": F.col("_bx") + F.col("_ox"), "_by": F.col("_by") + F.col("_oy")})
    on = [F.col(f"d.{k}") == F.col(f"s.{k}") for k in [*keys, "_bx", "_by"]]
    within = (F.abs(F.col("d.x") - F.col("s.x")) <= radius) & (F.abs(F.col("d.y") - F.col("s.y")) <= radius)
    hits = binned(hot[0].filter(asks).select(*place).distinct()).alias("d").join(pts.alias("s"), [*on, within])
    top = F.struct("s.response", -F.col("s.y"), -F.col("s.x"), "s.contrast")
    found = hits.groupBy(*[F.col(f"d.{k}").alias(k) for k in place]).agg(F.max(top).alias("_best"))
    asked = hot[0].join(found, place, "left").withColumn("_best", F.when(asks, F.col("_best")))
    return out.unionByName(strongest(asked))


def local_support(rows: DataFrame, support: DataFrame, radius: float, keys: list[str]) -> DataFrame:
    """The rows (keys, det_idx) that have a support point within ``radius``, with the strongest one of ``with_support``."""
    # A point's own values may be null, so what was found is told by a value that never is.
    marked = support.withColumn("response", F.struct("response", F.lit(True).alias("_is")))
    found = with_support(rows.select(*keys, "x", "y", "det_idx"), marked, radius, keys).filter("response._is")
    return found.select(*keys, "det_idx", F.col("response.response").alias("response"), "contrast")


def guarded_accept(
    det: DataFrame,
    support: DataFrame,
    low: float,
    high: float,
    min_response: float,
    radius: float,
    min_contrast: float | None = None,
    keys: list[str] | None = None,
) -> DataFrame:
    """Adds ``state`` accepted / guarded / rejected / ignored to detections with a center (x, y).

    High confidence passes. The mid band passes when its strongest nearby support point (keys, x, y, response,
    contrast) is strong enough.
    """
    keys = keys or ["image_id"]
    mid = (F.col("confidence") >= low) & (F.col("confidence") < high)
    asked = with_support(det, support, radius, keys, mid)
    ok = F.col("response") >= min_response
    if min_contrast is not None:
        ok = ok & (F.col("contrast") >= min_contrast)
    state = (
        F.when(F.col("confidence") >= high, "accepted")
        .when(F.col("confidence") < low, "ignored")
        .when(ok, "guarded")
        .otherwise("rejected")
    )
    first = [*keys, "det_idx"]
    return asked.select(*first, *[c for c in det.columns if c not in first], state.alias("state"))


def refine_by_circle(det: DataFrame, circles: DataFrame, keys: list[str] | None = None) -> DataFrame:
    """Replace the droplet nearest to a measured circle by the circle's box and keep cells inside 0.92 of its radius.

    ``det`` has pixel centers (x, y); ``circles`` has one (circle_x, circle_y, radius) per key. Keys without a
    droplet near enough give no rows.
    """
    keys = keys or ["image_id"]
    d = det.join(circles, keys)
    distance = F.hypot(F.col("x") - F.col("circle_x"), F.col("y") - F.col("circle_y"))
    d = d.withColumn("distance", distance)
    key = F.struct("distance", -F.col("confidence"), "det_idx")
    droplet = d.filter("class_id = 1").groupBy(*keys).agg(
        F.min_by(F.struct("det_idx", "distance", "radius"), key).alias("_d")
    )
    gate = F.col("_d.distance") <= F.greatest(F.lit(55.0), F.col("_d.radius") * 1.25)
    chosen = droplet.filter(gate).select(*keys, F.col("_d.det_idx").alias("chosen"))
    joined = d.join(chosen, keys)
    cell = (F.col("class_id") == 0) & (F.col("distance") <= F.col("radius") * 0.92)
    keep = cell | ((F.col("class_id") == 1) & (F.col("det_idx") == F.col("chosen")))
    half = F.col("radius") * 1.04
    is_drop = F.col("class_id") == 1
    return joined.filter(keep).select(
        *keys,
        "class_id",
        "det_idx",
        "confidence",
        F.when(is_drop, F.col("circle_x")).otherwise(F.col("x")).alias("x"),
        F.when(is_drop, F.col("circle_y")).otherwise(F.col("y")).alias("y"),
        F.when(is_drop, half).alias("half_size"),
    )
