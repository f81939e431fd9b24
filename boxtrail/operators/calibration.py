"""Grid search and coordinate descent over detector settings, each step one Spark job."""

from __future__ import annotations

from collections.abc import Iterator
from functools import reduce

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, functions as F

from boxtrail.functions import geometry as g
from boxtrail.operators import matching as m
from boxtrail.operators.grid import with_grid, with_row
from boxtrail.operators.metrics import prf
from boxtrail.operators.skew import packed_split, split_pair
from boxtrail.session import materialize, ship_package

# Settings that share one whole number, a bit each.
WORD = 60


def filter_sweep(det: DataFrame, gt: DataFrame, keep: list[Column], threshold: float = 0.5, split=None) -> DataFrame:
    """tp/fp/fn per grid_id and class when settings only filter detections.

    Which truth a detection names does not depend on the others, and a truth counts once some kept detection names
    it. So boxes are paired once, each detection and each truth gets one bit per setting, and no detection is copied per setting.
    The boxes of an ordinary image stand in arrays next to each other. ``split`` is a ``packed_split`` by image made from
    other tables with the same rows.
    """
    words = {f"_w{at // WORD}": keep[at : at + WORD] for at in range(0, len(keep), WORD)}
    bits = [
        reduce(Column.bitwiseOR, [F.when(c, F.lit(1 << i).cast("long")).otherwise(F.lit(0).cast("long")) for i, c in enumerate(part)]).alias(w)
        for w, part in words.items()
    ]
    rows = det.select(*m.IMAGE_CLASS, "det_idx", "confidence", *g.Box._fields, *bits)
    truths = gt.select(*m.IMAGE_CLASS, "gt_idx", *g.Box._fields)
    split = split or packed_split([det, gt], ["image_id"], m.packed_limit(det))
    cold, hot = split(rows, truths)
    entries = _sweep_packed(*cold, threshold, list(words))
    if hot is not None:
        entries = entries.unionByName(_sweep_spread(*hot, threshold, list(words)))
    flags = {f"k{i}": F.shiftright(f"_w{i // WORD}", i % WORD).bitwiseAND(F.lit(1).cast("long")) for i in range(len(keep))}
    sums = entries.groupBy("class_id").agg(
        *[F.coalesce(F.sum(F.when(F.col("_truth"), c)), F.lit(0)).alias(f"any_{n}") for n, c in flags.items()],
        *[F.coalesce(F.sum(F.when(~F.col("_truth"), c)), F.lit(0)).alias(f"all_{n}") for n, c in flags.items()],
    )
    pairs = F.array(*[F.struct(F.col(f"any_{n}").alias("tp"), F.col(f"all_{n}").alias("nd")) for n in flags])
    found = sums.select("class_id", F.posexplode(pairs).alias("grid_id", "c")).select("class_id", "grid_id", "c.*")
    ng = with_grid(gt.groupBy("class_id").agg(F.count(F.lit(1)).alias("ng")), [{} for _ in keep])
    out = ng.join(found, ["class_id", "grid_id"], "left").fillna(0, ["nd", "tp"])
    return out.select(
        "grid_id", "class_id", "tp", (F.col("nd") - F.col("tp")).alias("fp"), (F.col("ng") - F.col("tp")).alias("fn")
    )


def _sweep_packed(det: DataFrame, gt: DataFrame, threshold: float, words: list[str]) -> DataFrame:
    """A row for every detection and one (``_truth``) for every named truth, with the bits of the settings that keep it."""
    by = ["image_id"]
    # No row here lacks an image. Said of both sides, as a join says it of one: they then read one shuffle of what they come from.
    det, gt = det.filter("image_id is not null"), gt.filter("image_id is not null")
    both = m.pack(det.drop("confidence"), by, "_d").join(m.pack(gt, by, "_t"), by, "left")
    both = both.select("_d", F.coalesce("_t", F.array()).alias("_t"))

    def choices(d):
        def choice(t):
            return F.struct((-g.iou(g.field_box(d), g.field_box(t))).alias("k"), t["gt_idx"].alias("gt_idx"))

        near = F.transform(F.filter("_t", lambda t: t["class_id"] == d["class_id"]), choice)
        return F.filter(near, lambda c: -c["k"] >= threshold)

    def name(d):
        # Detections of one index name one truth together.
        same = F.filter("_d", lambda e: (e["class_id"] == d["class_id"]) & (e["det_idx"] == d["det_idx"]))
        best = F.array_min(F.flatten(F.transform(same, choices)))
        return F.struct(d["class_id"].alias("class_id"), best["gt_idx"].alias("named"), *[d[w].alias(w) for w in words])

    def entry(of, truth, values):
        return F.struct(of["class_id"].alias("class_id"), F.lit(truth).alias("_truth"), *[v.alias(w) for w, v in values.items()])

    def truth(t):
        own = F.filter("_n", lambda n: (n["class_id"] == t["class_id"]) & (n["named"] == t["named"]))
        return entry(t, True, {w: F.aggregate(own, F.lit(0).cast("long"), lambda acc, n: acc.bitwiseOR(n[w])) for w in words})

    named = both.select(F.transform("_d", name).alias("_n"))
    ids = F.transform(F.filter("_n", lambda n: n["named"].isNotNull()), lambda n: F.struct(n["class_id"].alias("class_id"), n["named"].alias("named")))
    every = F.transform("_n", lambda n: entry(n, False, {w: n[w] for w in words}))
    return named.select(F.explode(F.concat(every, F.transform(F.array_distinct(ids), truth))).alias("_e")).select("_e.*")


def _sweep_spread(det: DataFrame, gt: DataFrame, threshold: float, words: list[str]) -> DataFrame:
    """The rows of ``_sweep_packed`` by joins."""
    keys = m.IMAGE_CLASS
    named = m.name_truths(det, gt, threshold, keys).select(*keys, "det_idx", F.col("c.gt_idx").alias("named"))
    rows = det.join(named, [*keys, "det_idx"], "left").select(*keys, "named", *words)
    truths = rows.filter(F.col("named").isNotNull()).groupBy(*keys, "named").agg(*[F.bit_or(w).alias(w) for w in words])
    return rows.select("class_id", F.lit(False).alias("_truth"), *words).unionByName(truths.select("class_id", F.lit(True).alias("_truth"), *words))


def overall(counts: DataFrame) -> DataFrame:
    total = counts.groupBy("grid_id").agg(*[F.sum(c).alias(c) for c in ("tp", "fp", "fn")])
    return total.withColumns(prf(F.col("tp"), F.col("fp"), F.col("fn")))


def guard_policy(rows: DataFrame, base_precision: float | None = None) -> DataFrame:
    """Guarded F1 of each setting: F1*min(1, P/max(.75, base-.08)), or F1*P/.70 below .70 without a base."""
    f1, p = F.col("f1"), F.col("precision")
    if base_precision is None:
        guarded = F.when(p >= 0.70, f1).otherwise(f1 * p / 0.70)
    else:
        guarded = f1 * F.least(F.lit(1.0), p / F.lit(max(0.75, base_precision - 0.08)))
    return rows.withColumn("guarded_f1", guarded)


def pick_guarded(rows: DataFrame, extra=("recall", "precision")) -> DataFrame:
    cols = rows.columns
    key = F.struct("guarded_f1", *[F.col(c) for c in extra], -F.col("grid_id"))
    return rows.agg(F.max_by(F.struct(*cols), key).alias("_b")).select("_b.*")


# The calibration grid of each parameter.
STEPS = {
    "width_scale": [round(0.80 + 0.025 * i, 3) for i in range(21)],
    "height_scale": [round(0.80 + 0.025 * i, 3) for i in range(21)],
    "center_x_offset": [round(-0.04 + 0.005 * i, 3) for i in range(17)],
    "center_y_offset": [round(-0.04 + 0.005 * i, 3) for i in range(17)],
}
NEUTRAL = {"width_scale": 1.0, "height_scale": 1.0, "center_x_offset": 0.0, "center_y_offset": 0.0}


def _edge_clip(b: g.Box) -> g.Box:
    """Lower sides are clipped at 0 and upper sides at 1, each on one side only."""
    return g.Box(
        F.greatest(F.lit(0.0), b.x1), F.greatest(F.lit(0.0), b.y1), F.least(F.lit(1.0), b.x2), F.least(F.lit(1.0), b.y2)
    )


def moved_box(b: g.Box, setting: dict) -> g.Box:
    """The box under a setting's scales about its center, then its offsets."""
    cx, cy = g.center(b)
    w, h = (b.x2 - b.x1) * setting["width_scale"], (b.y2 - b.y1) * setting["height_scale"]
    shifted = g.xywh_to_xyxy(cx + setting["center_x_offset"], cy + setting["center_y_offset"], w, h)
    return _edge_clip(shifted)


SETTINGS_AT_ONCE = 60


def _reach(settings: list[dict]) -> dict:
    """Lowest and highest value of each parameter."""
    return {k: (min(float(s[k]) for s in settings), max(float(s[k]) for s in settings)) for k in NEUTRAL}


def move_pairs(det: DataFrame, gt: DataFrame, reach: dict, cell: float = m.CELL) -> DataFrame:
    """Detections next to the truths that some move within ``reach`` could touch; the pairs of a detection stand together.

    Rows hold both boxes as they are (``t_`` for the truth's), so one set of pairs serves every setting within the reach.
    """
    keys = m.IMAGE_CLASS
    cx, cy = g.center(g.box())
    half = {}
    for axis, size, scale in (("x", F.col("x2") - F.col("x1"), "width_scale"), ("y", F.col("y2") - F.col("y1"), "height_scale")):
        half[axis] = F.greatest(*[size * F.lit(v) for v in reach[scale]]) / 2
    (left, right), (up, down) = reach["center_x_offset"], reach["center_y_offset"]
    outer = _edge_clip(g.Box(cx + left - half["x"], cy + up - half["y"], cx + right + half["x"], cy + down + half["y"]))
    hull = {f"h_{n}": c for n, c in zip(g.Box._fields, outer)}
    d = det.select(*keys, "det_idx", *g.Box._fields, *[c.alias(n) for n, c in hull.items()])
    t = gt.select(*keys, "gt_idx", *g.Box._fields)
    near = (F.col("d.h_x1") < F.col("t.x2")) & (F.col("d.h_x2") > F.col("t.x1")) & (F.col("d.h_y1") < F.col("t.y2")) & (F.col("d.h_y2") > F.col("t.y1"))

    def join(left, right, on, also=None):
        joined = left.alias("d").join(right.alias("t"), [F.col(f"d.{k}") == F.col(f"t.{k}") for k in on]).filter(near)
        joined = joined if also is None else joined.filter(also)
        boxes = [F.col(f"{a}.{n}").alias(f"{p}{n}") for a, p in (("d", ""), ("t", "t_")) for n in g.Box._fields]
        return joined.select(*[F.col(f"d.{k}").alias(k) for k in keys], "det_idx", "gt_idx", *boxes)

    cold, hot = split_pair(d, t, keys)
    pairs = join(*cold, keys)
    if hot is not None:
        def cells(x1, y1, x2, y2):
            across = F.sequence(F.floor(F.col(x1) / cell), F.floor(F.col(x2) / cell))
            down = F.sequence(F.floor(F.col(y1) / cell), F.floor(F.col(y2) / cell))
            return F.explode(F.flatten(F.transform(across, lambda x: F.transform(down, lambda y: F.struct(x.alias("x"), y.alias("y"))))))

        tall = (F.col("h_x1") <= F.col("h_x2")) & (F.col("h_y1") <= F.col("h_y2"))
        left = hot[0].filter(tall).withColumn("_c", cells(*hull))
        right = hot[1].filter("x1 <= x2 and y1 <= y2").withColumn("_c", cells(*g.Box._fields))
        start = [F.floor(F.greatest(F.col(f"d.h_{c}"), F.col(f"t.{c}")) / cell) for c in ("x1", "y1")]
        once = (F.col("d._c.x") == start[0]) & (F.col("d._c.y") == start[1])
        pairs = pairs.unionByName(join(left, right, [*keys, "_c"], once))
    # Spread by detection: an image with many boxes is cut between tasks.
    return pairs.repartition(*keys, "det_idx").sortWithinPartitions(*keys, "det_idx")


def _moved_sides(lo: np.ndarray, hi: np.ndarray, scale: float, offset: float) -> tuple[np.ndarray, np.ndarray]:
    """One axis of ``moved_box``: Spark's greatest and least pass over nulls, which are NaN here."""
    mid, size = (lo + hi) / 2, (hi - lo) * scale
    return np.fmax(0.0, mid + offset - size / 2), np.fmin(1.0, mid + offset + size / 2)


def _named_bits(cols: dict[str, np.ndarray], starts: np.ndarray, settings: list[dict], threshold: float) -> np.ndarray:
    """One bit a setting for every pair: whether its detection names its truth; ``starts`` are each detection's first pairs."""
    of = np.repeat(np.arange(len(starts)), np.diff(np.append(starts, len(cols["gt_idx"]))))
    held, truth, none = np.zeros(len(of), np.int64), cols["gt_idx"], np.iinfo(np.int64).max
    t_area = (cols["t_x2"] - cols["t_x1"]) * (cols["t_y2"] - cols["t_y1"])
    for i, s in enumerate(settings):
        x1, x2 = _moved_sides(cols["x1"], cols["x2"], s["width_scale"], s["center_x_offset"])
        y1, y2 = _moved_sides(cols["y1"], cols["y2"], s["height_scale"], s["center_y_offset"])
        wide = np.minimum(x2, cols["t_x2"]) - np.maximum(x1, cols["t_x1"])
        high = np.minimum(y2, cols["t_y2"]) - np.maximum(y1, cols["t_y1"])
        inter = np.maximum(0.0, wide) * np.maximum(0.0, high)
        union = (x2 - x1) * (y2 - y1) + t_area - inter
        over = np.divide(inter, union, out=np.zeros_like(inter), where=union > 0)
        best = (over >= threshold) & (over == np.maximum.reduceat(over, starts)[of])
        first = np.minimum.reduceat(np.where(best, truth, none), starts)
        held |= np.where(best & (truth == first[of]), np.int64(1) << np.int64(i), np.int64(0))
    return held


def count_moves(pairs: DataFrame, settings: list[dict], threshold: float = 0.5) -> DataFrame:
    """``tp`` per ``grid_id`` from the pairs of ``move_pairs``; a truth holds one bit for each setting that names it."""
    if len(settings) > SETTINGS_AT_ONCE:
        raise ValueError(f"at most {SETTINGS_AT_ONCE} settings at once")
    ship_package(pairs.sparkSession)
    keys = m.IMAGE_CLASS
    sides = [f"{p}{n}" for p in ("", "t_") for n in g.Box._fields]
    settings = [{k: float(s[k]) for k in NEUTRAL} for s in settings]
    least = np.iinfo(np.int64).min

    def whole(column: pa.ChunkedArray) -> np.ndarray:
        return pc.fill_null(column.cast(pa.int64()), int(least)).to_numpy()

    def name(part: pa.Table, starts: np.ndarray) -> pa.Table:
        cols = {n: part.column(n).cast(pa.float64()).to_numpy() for n in sides}
        cols["gt_idx"] = whole(part.column("gt_idx"))
        held = _named_bits(cols, starts, settings, threshold)
        found = part.select([*keys, "gt_idx"]).append_column("held", pa.array(held))
        return found.filter(pa.array((held != 0) & (cols["gt_idx"] != least)))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        open_ = None
        for batch in batches:
            if not batch.num_rows:
                continue
            part = pa.Table.from_batches([batch])
            part = part if open_ is None else pa.concat_tables([open_, part])
            ids = [whole(part.column(c)) for c in (*keys, "det_idx")]
            starts = np.append(0, np.flatnonzero(np.any([v[1:] != v[:-1] for v in ids], axis=0)) + 1)
            # The last detection may go on in the next batch.
            open_ = part.slice(int(starts[-1]))
            if len(starts) > 1:
                yield from name(part.slice(0, int(starts[-1])), starts[:-1]).to_batches()
        if open_ is not None:
            yield from name(open_, np.zeros(1, np.int64)).to_batches()

    ddl = ", ".join(f"{c} {pairs.schema[c].dataType.simpleString()}" for c in (*keys, "gt_idx"))
    held = pairs.mapInArrow(run, f"{ddl}, held long").groupBy(*keys, "gt_idx").agg(F.bit_or("held").alias("held"))
    flags = [F.coalesce(F.sum(F.shiftright("held", i).bitwiseAND(F.lit(1).cast("long"))), F.lit(0)).alias("tp") for i in range(len(settings))]
    return held.agg(F.array(*flags).alias("_tp")).select(F.posexplode("_tp").alias("grid_id", "tp"))


def move_sweep(det: DataFrame, gt: DataFrame, settings: list[dict], threshold: float = 0.5, cell: float = m.CELL) -> DataFrame:
    """``tp`` of the best-then-check rule per ``grid_id`` (position in ``settings``) when settings move the boxes.

    A detection meets the truths that the hull of all its moved boxes touches, once, and a pair is tried under every setting in
    arrays. So neither truths nor detections are copied per setting. A truth counts for a setting when some detection names it.
    Without any named truth all counts are 0.
    """
    return count_moves(move_pairs(det, gt, _reach(settings), cell), settings, threshold)


def _score(pairs: DataFrame, settings: list[dict], threshold: float, sizes: tuple[int, int]) -> list[dict]:
    out = []
    for at in range(0, len(settings), SETTINGS_AT_ONCE):
        part = settings[at : at + SETTINGS_AT_ONCE]
        # One row per setting comes back; a grid has about twenty settings.
        tp = {r["grid_id"]: r["tp"] for r in count_moves(pairs, part, threshold).collect()}
        for i, s in enumerate(part):
            n_det, n_truth = sizes
            out.append(
                dict(
                    s,
                    f1=2.0 * tp[i] / (n_det + n_truth) if n_det + n_truth else 0.0,
                    recall=tp[i] / n_truth if n_truth else 0.0,
                    precision=tp[i] / n_det if n_det else 0.0,
                )
            )
    return out


def calibrate_geometry(det: DataFrame, gt: DataFrame, rounds: int = 3, steps: dict | None = None, threshold=0.5) -> dict:
    """Coordinate descent on box scale and offset; kept only when it beats the neutral setting.

    Boxes are paired once, for the reach of all steps, and every step reads those pairs.
    """
    steps = steps or STEPS
    sizes = (det.count(), gt.count())
    current = dict(NEUTRAL)
    pairs = materialize(move_pairs(det, gt, _reach([NEUTRAL, *[{**NEUTRAL, n: v} for n, values in steps.items() for v in values]])))
    base = _score(pairs, [current], threshold, sizes)[0]
    best = base
    for _ in range(rounds):
        changed = False
        for name, values in steps.items():
            scored = _score(pairs, [{**current, name: v} for v in values], threshold, sizes)
            neutral = NEUTRAL[name]
            top = max(scored, key=lambda s: (s["f1"], s["recall"], s["precision"], -abs(s[name] - neutral)))
            changed |= top[name] != current[name]
            current, best = {k: top[k] for k in NEUTRAL}, top
        if not changed:
            break
    accepted = best["f1"] > base["f1"]
    return {"accepted": accepted, "base_f1": base["f1"], "f1": best["f1"], **(current if accepted else NEUTRAL)}


# Containment settings (expansion, keep confident orphans, orphan threshold).
ASSOCIATION_GRID = [
    (expansion, keep, limit)
    for expansion in (1.0, 1.15, 1.3, 1.5, 2.0)
    for keep, limit in ((False, 1.01), (True, 0.90), (True, 0.95))
]


def association_sweep(det: DataFrame, gt: DataFrame) -> DataFrame:
    """Score all containment settings in one job and flag the accepted one (or none).

    Each inner box is described once by the smallest expansion that holds it; a setting is then a plain filter.
    """
    split = packed_split([det, gt], ["image_id"], m.packed_limit(det))
    need = smallest_expansion(det, max(e for e, _, _ in ASSOCIATION_GRID), split=split)
    other = F.col("class_id") != 0
    keep = [
        other | (F.col("needed") <= e) | (F.col("confidence") >= t if orphans else F.lit(False))
        for e, orphans, t in ASSOCIATION_GRID
    ]
    # A row a setting and class, read for the totals, the inner class and the best setting.
    counts = materialize(filter_sweep(need, gt, [*keep, F.lit(True)], split=split))
    total = overall(counts)
    cell = counts.filter("class_id = 0").withColumns(prf(F.col("tp"), F.col("fp"), F.col("fn")))
    joined = total.join(cell.select("grid_id", F.col("f1").alias("cell_f1")), "grid_id", "left")
    rank = F.struct("f1", "cell_f1", "precision", -F.col("grid_id"))
    unfiltered = F.col("grid_id") == len(ASSOCIATION_GRID)
    ends = joined.agg(
        F.max(F.when(unfiltered, F.col("f1"))).alias("base_f1"),
        F.max(F.when(unfiltered, F.col("cell_f1"))).alias("base_cell_f1"),
        F.max_by(F.when(~unfiltered, F.col("grid_id")), F.when(~unfiltered, rank)).alias("best_id"),
    )
    names = [{"expansion": float(e), "keep_orphans": k, "orphan_threshold": float(t)} for e, k, t in ASSOCIATION_GRID]
    table = F.create_map(*[v for i, r in enumerate(names) for v in (F.lit(i), F.struct(*[F.lit(x).alias(k) for k, x in r.items()]))])
    out = with_row(joined.filter(~unfiltered), ends).withColumn("_s", table[F.col("grid_id")])
    gain = (F.col("f1") - F.col("base_f1") >= 0.005) & (F.col("cell_f1") >= F.col("base_cell_f1"))
    flagged = out.withColumns({"selected": F.col("grid_id") == F.col("best_id"), "accepted": gain})
    return flagged.select("*", "_s.*").drop("best_id", "_s")


def smallest_expansion(det: DataFrame, largest: float, grid: float = 0.125, split=None) -> DataFrame:
    """Adds ``needed``: the smallest expansion at which some outer box holds this inner box's center.

    The boxes of an ordinary image look for each other in one array; ``split`` is a ``packed_split`` by image.
    """
    split = split or packed_split([det], ["image_id"], m.packed_limit(det))
    (cold,), hot = split(det)
    rest = [c for c in det.columns if c != "image_id"]

    def need(d):
        def held(i):
            cx, cy = g.center(g.field_box(i))
            return F.transform(F.filter("_d", lambda o: o["class_id"] == 1), lambda o: _expansion(cx, cy, g.field_box(o)))

        own = F.filter("_d", lambda i: (i["class_id"] == 0) & (i["det_idx"] == d["det_idx"]))
        near = F.filter(F.flatten(F.transform(own, held)), lambda n: n <= largest + 1e-9)
        return F.struct(*[d[c].alias(c) for c in rest], F.array_min(near).alias("needed"))

    found = m.pack(cold, ["image_id"], "_d").select("image_id", F.explode(F.transform("_d", need)).alias("_r"))
    cols = ["image_id", "det_idx", *[c for c in rest if c != "det_idx"], "needed"]
    out = found.select("image_id", "_r.*").select(*cols)
    return out if hot is None else out.unionByName(_expansion_spread(*hot, largest, grid).select(*cols))


def _expansion(cx: Column, cy: Column, outer: g.Box) -> Column:
    """The expansion at which an outer box reaches a center."""
    dx = F.abs(cx - (outer.x1 + outer.x2) / 2) / ((outer.x2 - outer.x1) / 2)
    dy = F.abs(cy - (outer.y1 + outer.y2) / 2) / ((outer.y2 - outer.y1) / 2)
    return F.greatest(dx, dy)


def _expansion_spread(det: DataFrame, largest: float, grid: float) -> DataFrame:
    """``smallest_expansion`` by joins."""
    cx, cy = g.center(g.box())
    inner = det.filter("class_id = 0").select("image_id", "det_idx", cx.alias("px"), cy.alias("py"))
    outer = det.filter("class_id = 1").select("image_id", *g.Box._fields)
    # Outer boxes meet inner centers through cells: an outer box covers the cells of its largest expansion.
    hw, hh = (F.col("x2") - F.col("x1")) * largest / 2, (F.col("y2") - F.col("y1")) * largest / 2

    def span(mid, half):
        return F.explode(F.sequence(F.floor((mid - half) / grid), F.floor((mid + half) / grid)))

    need = _expansion(F.col("px"), F.col("py"), g.box())

    def meet(a, b, on):
        near = a.join(b, on).filter(need <= largest + 1e-9)
        return near.groupBy("image_id", "det_idx").agg(F.min(need).alias("needed"))

    cold, hot = split_pair(inner, outer, ["image_id"])
    found = meet(*cold, ["image_id"])
    if hot is not None:
        b = hot[1].withColumn("_bx", span(cx, hw)).withColumn("_by", span(cy, hh))
        a = hot[0].withColumns({"_bx": F.floor(F.col("px") / grid), "_by": F.floor(F.col("py") / grid)})
        found = found.unionByName(meet(a, b, ["image_id", "_bx", "_by"]))
    return det.join(found, ["image_id", "det_idx"], "left")


def center_constraint(labels: DataFrame, margin: float, by: str = "class_id") -> DataFrame:
    """Allowed range of the label center's y per class: seen range plus a margin, clamped to the frame."""
    return labels.groupBy(by).agg(
        F.greatest(F.lit(0.0), F.min("cy") - margin).alias("center_y_min"),
        F.least(F.lit(1.0), F.max("cy") + margin).alias("center_y_max"),
    )


def filter_confidence(det: DataFrame, thresholds: dict[int, float]) -> DataFrame:
    """Per-class confidence floor; a class without a setting raises."""
    limit = F.create_map(*[F.lit(v) for kv in thresholds.items() for v in (int(kv[0]), float(kv[1]))])
    found = limit[F.col("class_id")]
    missing = F.raise_error(F.concat(F.lit("no threshold for class "), F.col("class_id"))).cast("double")
    return det.filter(F.col("confidence") >= F.when(found.isNotNull(), found).otherwise(missing))


BOUNDS = [f"{n}_{side}" for n in ("center_x", "center_y", "width", "height") for side in ("min", "max")]


def box_constraints(det: DataFrame, constraints: DataFrame) -> DataFrame:
    """Keep boxes inside their class's optional bounds; ``constraints`` has one row per class."""
    have = [b for b in BOUNDS if b in constraints.columns]
    joined = det.join(F.broadcast(constraints.select("class_id", *have)), "class_id", "left")
    cx, cy = g.center(g.box())
    value = {"center_x": cx, "center_y": cy, "width": F.col("x2") - F.col("x1"), "height": F.col("y2") - F.col("y1")}
    ok = F.lit(True)
    for b in have:
        v = value[b.rsplit("_", 1)[0]]
        ok = ok & (F.col(b).isNull() | (v >= F.col(b) if b.endswith("_min") else v <= F.col(b)))
    return joined.filter(ok).select(*det.columns)
