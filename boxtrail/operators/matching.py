"""Detection-to-truth pairing, matching rules, suppression and fusion."""

from __future__ import annotations

from pyspark.sql import DataFrame, functions as F

from boxtrail.functions import geometry as g
from boxtrail.operators.greedy import box_cells, disc_cells, fold_keep, fold_pairs, greedy_keep, greedy_pairs
from boxtrail.operators.ordered import top_k
from boxtrail.operators.skew import packed_split, split_pair
from boxtrail.session import FOLD_ROWS, setting

IMAGE_CLASS = ["image_id", "class_id"]
CELL = 0.125
# Boxes of one image and source that may stand in one array next to those of another source.
PACKED_ROWS = 1024


def packed_limit(df: DataFrame) -> int:
    return min(setting(df.sparkSession, FOLD_ROWS), PACKED_ROWS)


def _reach(threshold: float) -> float:
    """How far, in truth sizes, the center of a box with IoU >= threshold can lie from the truth's center."""
    return max(1.0 - threshold, 0.5 + max(0.0, 0.5 - threshold) / threshold)


def _binned(det: DataFrame, gt: DataFrame, keys: list[str], threshold: float, cell: float):
    """Equi-joinable cells: a detection has one (its center), a truth has every cell its partners can be in."""
    reach = _reach(threshold)

    def span(lo, hi):
        mid, half = (F.col(lo) + F.col(hi)) / 2, (F.col(hi) - F.col(lo)) * reach + 1e-9
        return F.sequence(F.floor((mid - half) / cell), F.floor((mid + half) / cell))

    cx, cy = g.center(g.box())
    d = det.withColumns({"_bx": F.floor(cx / cell), "_by": F.floor(cy / cell)})
    t = gt.withColumn("_bx", F.explode(span("x1", "x2"))).withColumn("_by", F.explode(span("y1", "y2")))
    return d, t, [*keys, "_bx", "_by"]


def _join_pairs(d, t, on: list[str], keys: list[str], threshold: float, also=None) -> DataFrame:
    overlap = g.iou(g.box("d"), g.box("t"))
    joined = d.alias("d").join(t.alias("t"), [F.col(f"d.{k}") == F.col(f"t.{k}") for k in on])
    joined = joined if also is None else joined.filter(also)
    return joined.filter(overlap >= threshold).select(
        *[F.col(f"d.{k}").alias(k) for k in keys], "det_idx", "confidence", "gt_idx", overlap.alias("iou")
    )


def pair(
    det: DataFrame, gt: DataFrame, threshold: float, keys: list[str] | None = None, cell: float = CELL
) -> DataFrame:
    """Pairs of one group (image and class) with IoU >= threshold > 0.

    Ordinary images join on the group keys alone. Images with very many boxes join on spatial cells as well, so
    far-apart boxes never meet and the group spreads over many tasks.
    """
    keys = keys or IMAGE_CLASS
    d = det.select(*keys, "det_idx", "confidence", "x1", "y1", "x2", "y2")
    t = gt.select(*keys, "gt_idx", "x1", "y1", "x2", "y2")
    cold, hot = split_pair(d, t, keys)
    out = _join_pairs(*cold, keys, keys, threshold)
    if hot is None:
        return out
    if _reach(threshold) <= 2:
        bd, bt, on = _binned(*hot, keys, threshold, cell)
        return out.unionByName(_join_pairs(bd, bt, on, keys, threshold))
    # A low threshold allows distant centers; boxes then meet in the cells they cover, once, where the overlap starts.
    spread = F.explode(box_cells(cell)).alias("_c")
    bd, bt = (side.select("*", spread) for side in hot)
    start = F.struct(*[F.floor(F.greatest(F.col(f"d.{c}"), F.col(f"t.{c}")) / cell) for c in ("x1", "y1")])
    return out.unionByName(_join_pairs(bd, bt, [*keys, "_c"], keys, threshold, F.col("d._c") == start))


def touching(det: DataFrame, gt: DataFrame, keys: list[str], cell: float = CELL) -> DataFrame:
    """Pairs with any overlap at all. In hot images boxes meet through the cells they cover (pairs may repeat)."""
    overlap = g.iou(g.box("d"), g.box("t"))

    def join(d, t, on):
        joined = d.alias("d").join(t.alias("t"), [F.col(f"d.{k}") == F.col(f"t.{k}") for k in on]).filter(overlap > 0)
        return joined.select(*[F.col(f"t.{k}").alias(k) for k in keys], "gt_idx", overlap.alias("iou"))

    cold, hot = split_pair(det.select(*keys, *g.Box._fields), gt.select(*keys, "gt_idx", *g.Box._fields), keys)
    out = join(*cold, keys)
    if hot is None:
        return out
    spread = F.explode(box_cells(cell))
    return out.unionByName(join(*(side.withColumn("_c", spread) for side in hot), [*keys, "_c"]))


def name_truths(
    det: DataFrame, gt: DataFrame, threshold: float, keys: list[str], pairs: DataFrame | None = None
) -> DataFrame:
    """The truth each detection names: highest overlap, then lowest index (column ``c``: k = -iou, gt_idx, confidence)."""
    pairs = pairs if pairs is not None else pair(det, gt, threshold, keys)
    choice = F.struct((-F.col("iou")).alias("k"), F.col("gt_idx"), F.col("confidence"))
    return pairs.groupBy(*keys, "det_idx").agg(F.min(choice).alias("c"))


def match_best(
    det: DataFrame, gt: DataFrame, threshold: float = 0.5, keys: list[str] | None = None, pairs: DataFrame | None = None
) -> DataFrame:
    """True positives of the best-then-check rule: keys, det_idx, gt_idx, confidence, iou.

    Every detection names its best truth (lowest index on ties); a truth goes to the most confident detection that
    named it, and the others get no second choice. Both steps are plain aggregates on the join's partitioning.
    """
    keys = keys or IMAGE_CLASS
    named = name_truths(det, gt, threshold, keys, pairs)
    claim = F.struct((-F.col("c.confidence")).alias("k"), F.col("det_idx"), F.col("c.k").alias("i"))
    won = named.groupBy(*keys, F.col("c.gt_idx").alias("gt_idx")).agg(F.min(claim).alias("w"))
    return won.select(
        *keys,
        F.col("w.det_idx").alias("det_idx"),
        "gt_idx",
        (-F.col("w.k")).alias("confidence"),
        (-F.col("w.i")).alias("iou"),
    )


def match_greedy_iou(det: DataFrame, gt: DataFrame, threshold: float = 0.5, keys: list[str] | None = None) -> DataFrame:
    """Global greedy rule: pairs by IoU descending, ties to the larger detection, then the larger truth index."""
    keys = keys or IMAGE_CLASS
    edges = pair(det, gt, threshold, keys).select(
        *keys,
        (-F.col("iou")).alias("o1"),
        (-F.col("det_idx")).alias("o2"),
        (-F.col("gt_idx")).alias("o3"),
        "det_idx",
        "gt_idx",
    )
    taken = greedy_pairs(edges, keys, "det_idx", "gt_idx", ["o1", "o2", "o3"])
    return taken.select(*keys, "det_idx", "gt_idx", (-F.col("o1")).alias("iou"))


def near_pairs(left: DataFrame, right: DataFrame, keys: list[str], xy: tuple[str, str], reach: float) -> DataFrame:
    """Rows of both sides whose points lie within ``reach``; hot groups also join on cells. Adds ``distance``."""
    x, y = xy
    cold, hot = split_pair(left, right, keys)
    dx, dy = F.col(f"l.{x}") - F.col(f"r.{x}"), F.col(f"l.{y}") - F.col(f"r.{y}")
    d = F.sqrt(dx * dx + dy * dy)

    def join(a, b, on):
        joined = a.alias("l").join(b.alias("r"), [F.col(f"l.{k}") == F.col(f"r.{k}") for k in on]).filter(d <= reach)
        cols = [F.col(f"l.{c}").alias(c) for c in left.columns]
        return joined.select(*cols, *[F.col(f"r.{c}").alias(f"{c}_r") for c in right.columns if c not in keys], d.alias("distance"))

    out = join(*cold, keys)
    if hot is None:
        return out
    base = hot[0].withColumns({"_bx": F.floor(F.col(x) / reach), "_by": F.floor(F.col(y) / reach)})
    around = F.expr("explode(array(-1,0,1))")
    other = hot[1].withColumn("_bx", F.floor(F.col(x) / reach) + 0).withColumn("_by", F.floor(F.col(y) / reach) + 0)
    other = other.withColumn("_ox", around).withColumn("_oy", around)
    other = other.withColumns({"_bx": F.col("_bx") + F.col("_ox"), "_by": F.col("_by") + F.col("_oy")})
    return out.unionByName(join(base, other, [*keys, "_bx", "_by"]))


def match_center(det: DataFrame, gt: DataFrame, max_distance: float = 0.065, keys: list[str] | None = None) -> DataFrame:
    """In detection order each box takes its nearest free truth within reach (ties: lower truth index)."""
    keys = keys or ["image_id"]
    cx, cy = g.center(g.box())
    a = det.select(*keys, "det_idx", F.lit(None).cast("long").alias("gt_idx"), cx.alias("x"), cy.alias("y"))
    b = gt.select(*keys, F.col("gt_idx").cast("long").alias("gt_idx"), cx.alias("x"), cy.alias("y"))
    edges = near_pairs(a.drop("gt_idx"), b, keys, ("x", "y"), max_distance).select(
        *keys, "det_idx", F.col("distance").alias("o1"), F.col("gt_idx_r").alias("gt_idx")
    )
    return greedy_pairs(edges, keys, "det_idx", "gt_idx", ["det_idx", "o1", "gt_idx"]).withColumnRenamed("o1", "distance")


def nms(
    det: DataFrame,
    threshold: float = 0.45,
    keys: list[str] | None = None,
    pre_topk: int | None = None,
    max_detections: int | None = None,
    cell: float = CELL,
) -> DataFrame:
    """Per-class suppression: by confidence (ties: det_idx), keep a box whose IoU with every kept box is <= threshold."""
    keys = keys or IMAGE_CLASS
    rows = det.withColumn("_neg", -F.col("confidence"))
    if pre_topk:
        rows = top_k(rows, keys, ["_neg", "det_idx"], pre_topk)

    def conflict(old, new):
        a, b = (g.Box(*(f(c) for c in g.Box._fields)) for f in (old, new))
        return g.iou(a, b) > threshold

    kept = greedy_keep(
        rows,
        keys,
        ["_neg", "det_idx"],
        ["x1", "y1", "x2", "y2"],
        conflict,
        box_cells(cell),
        limit=max_detections,
    )
    return kept.select(*keys, "det_idx", (-F.col("_neg")).alias("confidence"), "x1", "y1", "x2", "y2")


def suppress_nearby(
    points: DataFrame,
    keys: list[str],
    score: str,
    ident: str,
    min_distance: float,
    max_count: int | None = None,
    xy: tuple[str, str] = ("x", "y"),
) -> DataFrame:
    """By score descending (ties: ident) keep a point at least ``min_distance`` from every kept point."""
    x, y = xy
    rows = points.withColumn("_neg", -F.col(score))

    def conflict(old, new):
        return F.hypot(old(x) - new(x), old(y) - new(y)) < min_distance

    kept = greedy_keep(
        rows, keys, ["_neg", ident], [x, y], conflict, disc_cells(x, y, float(min_distance)), limit=max_count
    )
    return kept.select(*keys, ident, (-F.col("_neg")).alias(score), x, y)


def fuse_boxes(
    first: DataFrame,
    second: DataFrame,
    keys: list[str] | None = None,
    max_distance: float = 0.055,
    min_iou: float = 0.15,
    cell: float = CELL,
) -> DataFrame:
    """First-source boxes as they are, plus second-source boxes (in their order) that duplicate nothing kept so far."""
    keys = keys or ["image_id"]

    def tag(df, source):
        return df.select(
            *keys, F.lit(source == 0).alias("primary"), F.lit(source).alias("source"), "det_idx", "x1", "y1", "x2", "y2"
        )

    def conflict(old, new):
        a, b = (g.Box(*(f(c) for c in g.Box._fields)) for f in (old, new))
        (ax, ay), (bx, by) = g.center(a), g.center(b)
        return (F.hypot(ax - bx, ay - by) <= max_distance) | (g.iou(a, b) >= min_iou)

    # Boxes in conflict overlap, or have centers within max_distance: pad the covered cells by that much.
    def span(lo, hi):
        return F.sequence(
            F.floor((F.col(lo) - max_distance) / cell), F.floor((F.greatest(F.col(lo), F.col(hi)) + max_distance) / cell)
        )

    cells = F.flatten(
        F.transform(span("x1", "x2"), lambda x: F.transform(span("y1", "y2"), lambda y: F.struct(x, y)))
    )
    rows = tag(first, 0).unionByName(tag(second, 1))
    kept = greedy_keep(rows, keys, ["source", "det_idx"], ["x1", "y1", "x2", "y2"], conflict, cells, seed="primary")
    return kept.drop("primary")


def refine_labels(
    gt: DataFrame,
    teacher: DataFrame,
    match_iou: float,
    blend: float,
    add_confidence: dict[int, float],
    duplicate_iou: float,
    keys: list[str] | None = None,
) -> tuple[DataFrame, DataFrame]:
    """(refined boxes with ``origin`` matched/kept/added, totals per image).

    Truth boxes, in order, take the best free teacher box of their class (ties: larger teacher index) and move
    towards it by ``blend``; confident teacher boxes that overlap nothing refined are then added. Both sources of an ordinary
    image stand in arrays next to each other, packed once and worked through there; crowded images take the rounds.
    """
    keys = keys or ["image_id"]
    by_class = [*keys, "class_id"]
    limits = F.create_map(*[F.lit(v) for kv in add_confidence.items() for v in (int(kv[0]), float(kv[1]))])
    truths = gt.select(*by_class, "gt_idx", *g.Box._fields)
    boxes = teacher.select(*by_class, "det_idx", "confidence", *g.Box._fields, (F.col("confidence") >= limits[F.col("class_id")]).alias("sure"))
    cold, hot = packed_split([boxes, truths], keys, packed_limit(gt))(boxes, truths)
    packed = _refine_packed(cold[1], cold[0], match_iou, blend, duplicate_iou, keys)
    cols = [*by_class, "origin", "idx", *g.Box._fields, "match_iou"]
    refined = packed.select(*keys, F.explode("_kept").alias("_k")).select(*keys, "_k.*").select(*cols)

    def number(what):
        return F.size(F.filter("_kept", what)).cast("long")

    matched = F.filter("_kept", lambda r: r["match_iou"].isNotNull())
    iou_sum = F.aggregate(matched, F.lit(0.0), lambda acc, r: acc + r["match_iou"])
    # Asked of the boxes as they came, as a condition on what was kept would be worked out apart from it.
    totals = packed.where("_any").select(
        *keys,
        number(lambda r: r["origin"] != "added").alias("ground_truth"),
        number(lambda r: r["origin"] == "matched").alias("matched"),
        number(lambda r: r["origin"] == "added").alias("added"),
        F.size("_kept").cast("long").alias("output"),
        F.when(F.size(matched) > 0, iou_sum / F.size(matched)).otherwise(0.0).alias("mean_match_iou"),
    )
    if hot is None:
        return refined, totals
    spread = _refine_spread(hot[1], hot[0], match_iou, blend, duplicate_iou, by_class).select(*cols)
    counted = spread.groupBy(*keys).agg(
        F.count_if(F.col("origin") != "added").alias("ground_truth"),
        F.count_if(F.col("origin") == "matched").alias("matched"),
        F.count_if(F.col("origin") == "added").alias("added"),
        F.count(F.lit(1)).alias("output"),
        F.coalesce(F.avg("match_iou"), F.lit(0.0)).alias("mean_match_iou"),
    )
    return refined.unionByName(spread), totals.unionByName(counted)


def pack(df: DataFrame, keys: list[str], name: str) -> DataFrame:
    """One row a key with its rows in an array; rows that stand by key already stay where they are."""
    return df.groupBy(*keys).agg(F.collect_list(F.struct(*[c for c in df.columns if c not in keys])).alias(name))


def _refine_packed(gt: DataFrame, teacher: DataFrame, match_iou: float, blend: float, duplicate_iou: float, keys: list[str]) -> DataFrame:
    """One row an image of ``refine_labels`` with its boxes in ``_kept``; nothing but the two packed sources is joined."""

    both = pack(gt, keys, "_g").join(pack(teacher, keys, "_t"), keys, "full")
    none = [F.coalesce(c, F.array()) for c in ("_g", "_t")]
    both = both.select(*keys, none[0].alias("_g"), none[1].alias("_t"))
    both = both.withColumn("_any", (F.size("_g") > 0) | F.coalesce(F.exists("_t", lambda d: d["sure"]), F.lit(False)))

    def pairs(t):
        def meet(d):
            overlap = g.iou(g.field_box(d), g.field_box(t))
            return F.struct(t["gt_idx"].alias("gt_idx"), (-overlap).alias("o1"), (-d["det_idx"]).alias("o2"), d["det_idx"].alias("det_idx"), t["class_id"].alias("class_id"))

        near = F.transform(F.filter("_t", lambda d: d["class_id"] == t["class_id"]), meet)
        return F.filter(near, lambda e: (-e["o1"] >= match_iou) & e["gt_idx"].isNotNull() & e["det_idx"].isNotNull())

    both = both.withColumn("_e", F.sort_array(F.flatten(F.transform("_g", pairs))))
    edge = both.schema["_e"].dataType.elementType
    ends = {n: f"struct<c:{edge['class_id'].dataType.simpleString()},i:{edge[n].dataType.simpleString()}>" for n in ("gt_idx", "det_idx")}

    def end(name):
        return lambda e: F.struct(e["class_id"].alias("c"), e[name].alias("i"))

    both = both.withColumn("_links", fold_pairs(F.col("_e"), edge.simpleString(), end("gt_idx"), end("det_idx"), ends["gt_idx"], ends["det_idx"]))

    def box(c, idx, origin, neg, sides, iou):
        out = F.struct(
            F.lit(origin != "added").alias("primary"), neg.cast("double").alias("_neg"), idx.cast("long").alias("idx"), F.lit(origin).alias("origin"),
            *[v.cast("double").alias(n) for n, v in zip(g.Box._fields, sides)], iou.cast("double").alias("match_iou"), c["class_id"].alias("class_id"),
        )
        rank = F.struct(F.lit(-int(origin != "added")).alias("o0"), out["_neg"].alias("o1"), out["idx"].alias("o2"), out["origin"].alias("o3"))
        return F.struct(rank.alias("o"), out.alias("v"))

    def refine(t):
        link = F.get(F.filter("_links", lambda e: (e["class_id"] == t["class_id"]) & (e["gt_idx"] == t["gt_idx"])), F.lit(0))

        def move(d):
            return box(t, t["gt_idx"], "matched", F.lit(0.0), [(1.0 - blend) * t[n] + blend * d[n] for n in g.Box._fields], -link["o1"])

        taken = F.filter("_t", lambda d: (d["class_id"] == t["class_id"]) & (d["det_idx"] == link["det_idx"]))
        return F.when(link.isNull(), F.array(box(t, t["gt_idx"], "kept", F.lit(0.0), [t[n] for n in g.Box._fields], F.lit(None)))).otherwise(F.transform(taken, move))

    def free(d):
        used = F.exists("_links", lambda e: (e["class_id"] == d["class_id"]) & (e["det_idx"] == d["det_idx"]))
        return d["sure"] & ~F.coalesce(used, F.lit(False))

    added = F.transform(F.filter("_t", free), lambda d: box(d, d["det_idx"], "added", -d["confidence"], [d[n] for n in g.Box._fields], F.lit(None)))
    both = both.withColumn("_rows", F.sort_array(F.concat(F.flatten(F.transform("_g", refine)), added)))
    kind = both.schema["_rows"].dataType.elementType["v"].dataType.simpleString()

    def conflict(old, new):
        a, b = (g.Box(*(f(c) for c in g.Box._fields)) for f in (old, new))
        return old("class_id").eqNullSafe(new("class_id")) & (g.iou(a, b) >= duplicate_iou)

    return both.select(*keys, "_any", fold_keep(F.col("_rows"), kind, conflict, seed="primary").alias("_kept"))


def _refine_spread(gt: DataFrame, teacher: DataFrame, match_iou: float, blend: float, duplicate_iou: float, by_class: list[str]) -> DataFrame:
    """The boxes of ``refine_labels`` by joins and rounds."""
    edges = pair(
        teacher, gt.withColumn("confidence", F.lit(0.0)), match_iou, by_class
    ).select(*by_class, "gt_idx", "det_idx", (-F.col("iou")).alias("o1"), (-F.col("det_idx")).alias("o2"))
    matched = greedy_pairs(edges, by_class, "gt_idx", "det_idx", ["gt_idx", "o1", "o2"])
    t = teacher.select(*by_class, "det_idx", *[F.col(c).alias(f"t_{c}") for c in g.Box._fields])
    links = matched.select(*by_class, "gt_idx", "det_idx", (-F.col("o1")).alias("match_iou"))
    joined = gt.select(*by_class, "gt_idx", *g.Box._fields).join(links, [*by_class, "gt_idx"], "left")
    joined = joined.join(t, [*by_class, "det_idx"], "left")
    moved = {
        c: F.when(F.col("det_idx").isNotNull(), (1.0 - blend) * F.col(c) + blend * F.col(f"t_{c}")).otherwise(F.col(c))
        for c in g.Box._fields
    }
    base = joined.withColumns(moved).select(
        *by_class,
        F.col("gt_idx").cast("long").alias("idx"),
        F.when(F.col("det_idx").isNotNull(), "matched").otherwise("kept").alias("origin"),
        F.lit(0.0).alias("_neg"),
        *g.Box._fields,
        "match_iou",
    )
    spare = teacher.join(links.select(*by_class, "det_idx"), [*by_class, "det_idx"], "left_anti").filter("sure")
    extra = spare.select(
        *by_class,
        F.col("det_idx").cast("long").alias("idx"),
        F.lit("added").alias("origin"),
        (-F.col("confidence")).alias("_neg"),
        *g.Box._fields,
        F.lit(None).cast("double").alias("match_iou"),
    )
    rows = base.unionByName(extra).withColumn("primary", F.col("origin") != "added")

    def conflict(old, new):
        a, b = (g.Box(*(f(c) for c in g.Box._fields)) for f in (old, new))
        return g.iou(a, b) >= duplicate_iou

    return greedy_keep(
        rows,
        by_class,
        ["_neg", "idx", "origin"],
        [*g.Box._fields, "match_iou"],
        conflict,
        box_cells(CELL),
        seed="primary",
    )
