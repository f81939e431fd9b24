"""Matching and selection against plain loops, on ordinary and on hot routes."""

import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from boxtrail.operators import calibration as cal, matching as m, metrics as mt
from boxtrail.operators.skew import split_pair

BOX = "image_id long, class_id int, {0} long, confidence double, x1 double, y1 double, x2 double, y2 double"


def boxes(rng, images, most, name):
    rows = []
    for i in range(images):
        for k in range(rng.randint(0, most)):
            x, y, w, h = rng.uniform(0.1, 0.6), rng.uniform(0.1, 0.6), rng.uniform(0.1, 0.3), rng.uniform(0.1, 0.3)
            rows.append((i, rng.randint(0, 1), k, round(rng.uniform(0.2, 1.0), 6), x, y, x + w, y + h))
    return rows


def iou(a, b):
    a, b = a[4:], b[4:]
    w, h = min(a[2], b[2]) - max(a[0], b[0]), min(a[3], b[3]) - max(a[1], b[1])
    i = max(0, w) * max(0, h)
    return i / ((a[2] - a[0]) * (a[3] - a[1]) + (b[2] - b[0]) * (b[3] - b[1]) - i)


@pytest.fixture(params=["plain", "hot"])
def data(request, spark):
    if request.param == "hot":
        request.getfixturevalue("hot")
    rng = random.Random(11)
    det, gt = boxes(rng, 8, 14, "det"), boxes(rng, 8, 9, "gt")
    return (
        det,
        gt,
        spark.createDataFrame(det, BOX.format("det_idx")),
        spark.createDataFrame(gt, BOX.format("gt_idx")),
    )


def groups(det, gt):
    for key in sorted({r[:2] for r in det} | {r[:2] for r in gt}):
        yield key, [d for d in det if d[:2] == key], [t for t in gt if t[:2] == key]


def test_match_best(data):
    det, gt, d, t = data
    want = set()
    for key, ds, ts in groups(det, gt):
        used = set()
        for x in sorted(ds, key=lambda r: (-r[3], r[2])):
            if ts:
                best = max(range(len(ts)), key=lambda j: (iou(x, ts[j]), -ts[j][2]))
                if iou(x, ts[best]) >= 0.4 and best not in used:
                    used.add(best)
                    want.add((*key, x[2], ts[best][2]))
    got = {tuple(r) for r in m.match_best(d, t, 0.4).select("image_id", "class_id", "det_idx", "gt_idx").collect()}
    assert got == want and want


def test_match_greedy(data):
    det, gt, d, t = data
    want = set()
    for key, ds, ts in groups(det, gt):
        pairs = sorted(((-iou(x, y), -x[2], -y[2]) for x in ds for y in ts if iou(x, y) >= 0.2))
        a, b = set(), set()
        for _, i, j in pairs:
            if i not in a and j not in b:
                a.add(i), b.add(j)
                want.add((*key, -i, -j))
    got = {tuple(r) for r in m.match_greedy_iou(d, t, 0.2).select("image_id", "class_id", "det_idx", "gt_idx").collect()}
    assert got == want and want


def test_match_center(data):
    det, gt, d, t = data
    want = set()
    for i in {r[0] for r in det}:
        free = [r for r in gt if r[0] == i]
        for x in sorted((r for r in det if r[0] == i), key=lambda r: r[2]):
            c = lambda r: ((r[4] + r[6]) / 2, (r[5] + r[7]) / 2)
            near = [(((c(x)[0] - c(y)[0]) ** 2 + (c(x)[1] - c(y)[1]) ** 2) ** 0.5, y[2]) for y in free]
            near = [n for n in near if n[0] <= 0.15]
            if near:
                j = min(near)[1]
                free = [y for y in free if y[2] != j]
                want.add((i, x[2], j))
    got = {tuple(r) for r in m.match_center(d, t, 0.15).select("image_id", "det_idx", "gt_idx").collect()}
    assert got == want and want


@pytest.mark.parametrize("most", [None, 3])
def test_nms(data, most):
    det, _, d, _ = data
    want = set()
    for key, ds, _ in groups(det, []):
        kept = []
        for x in sorted(ds, key=lambda r: (-r[3], r[2])):
            if all(iou(x, k) <= 0.2 for k in kept) and (most is None or len(kept) < most):
                kept.append(x)
        want |= {(*key, k[2]) for k in kept}
    got = {tuple(r) for r in m.nms(d, 0.2, max_detections=most).select("image_id", "class_id", "det_idx").collect()}
    assert got == want


def test_fuse_keeps_first_source(data):
    det, _, d, _ = data
    first, second = d.filter("det_idx % 2 = 0"), d.filter("det_idx % 2 = 1")
    want = set()
    for i in {r[0] for r in det}:
        rows = sorted((r for r in det if r[0] == i), key=lambda r: r[2])
        kept = [r for r in rows if r[2] % 2 == 0]
        for x in (r for r in rows if r[2] % 2):
            far = lambda k: (((x[4] + x[6] - k[4] - k[6]) / 2) ** 2 + ((x[5] + x[7] - k[5] - k[7]) / 2) ** 2) ** 0.5
            if not any(far(k) <= 0.055 or iou(x, k) >= 0.15 for k in kept):
                kept.append(x)
        want |= {(i, k[2]) for k in kept}
    got = {tuple(r) for r in m.fuse_boxes(first, second).select("image_id", "det_idx").collect()}
    assert got == want


def test_low_threshold_pairs(data):
    det, gt, d, t = data
    want = {(*x[:3], y[2]) for x in det for y in gt if x[:2] == y[:2] and iou(x, y) >= 0.05}
    got = [tuple(r) for r in m.pair(d, t, 0.05).select("image_id", "class_id", "det_idx", "gt_idx").collect()]
    assert len(got) == len(set(got)) and set(got) == want


def test_filter_sweep_equals_matching_each_setting(data):
    _, _, d, t = data
    limits = [0.3, 0.6, 0.8]
    rows = cal.filter_sweep(d, t, [F.col("confidence") >= x for x in limits], 0.4).collect()
    got = {(r.grid_id, r.class_id): (r.tp, r.fp, r.fn) for r in rows}
    for i, x in enumerate(limits):
        kept = d.filter(F.col("confidence") >= x)
        for r in mt.match_counts(kept, t, m.match_best(kept, t, 0.4), ["class_id"]).collect():
            assert got[i, r.class_id] == (r.tp, r.fp, r.fn)


def test_refine_labels(spark):
    gt = spark.createDataFrame([(1, 0, 0, 0.10, 0.10, 0.30, 0.30), (1, 0, 1, 0.6, 0.6, 0.8, 0.8)],
                               "image_id long, class_id int, gt_idx long, x1 double, y1 double, x2 double, y2 double")
    teacher = spark.createDataFrame(
        [(1, 0, 0, 0.9, 0.11, 0.10, 0.31, 0.30), (1, 0, 1, 0.95, 0.40, 0.05, 0.55, 0.2), (1, 0, 2, 0.9, 0.41, 0.05, 0.56, 0.2), (1, 1, 3, 0.4, 0.6, 0.6, 0.8, 0.8)],
        BOX.format("det_idx"))
    refined, totals = m.refine_labels(gt, teacher, 0.5, 0.5, {0: 0.5, 1: 0.5}, 0.4)
    rows = {(r.origin, r.idx): r for r in refined.collect()}
    assert rows["matched", 0].x1 == pytest.approx(0.105)
    assert set(rows) == {("matched", 0), ("kept", 1), ("added", 1)}
    t = totals.first()
    assert (t.ground_truth, t.matched, t.added, t.output) == (2, 1, 1, 3)


def test_combined_metrics_known_totals(spark):
    a = spark.createDataFrame([(0.5, 8, 2, 2, 0.8)], "threshold double, tp long, fp long, fn long, f1 double")
    b = spark.createDataFrame([(0.6, 6, 1, 4, 12 / 17)], "threshold double, tp long, fp long, fn long, f1 double")
    r = mt.combined_metrics(a, b).first()
    assert (r.tp, r.fp, r.fn) == (14, 3, 6)
    assert r.f1 == pytest.approx(28 / 37) and r.macro_f1 == pytest.approx((0.8 + 12 / 17) / 2)


def test_binary_known_confusion(spark):
    df = spark.createDataFrame([(0, 0.10), (0, 0.70), (1, 0.80), (1, 0.20)], "label int, p double")
    r = mt.binary_metrics(df, "label", "p", 0.5).first()
    assert (r.tp, r.fp, r.tn, r.fn) == (1, 1, 1, 1) and r.accuracy == 0.5


def test_missing_class_threshold_raises(spark):
    df = spark.createDataFrame([(3, 0.5)], "class_id int, confidence double")
    with pytest.raises(Exception, match="no threshold for class 3"):
        cal.filter_confidence(df, {0: 0.5}).collect()


@pytest.mark.parametrize("route", ["cold", "hot"])
def test_moved_boxes_equal_a_loop(spark, request, route):
    if route == "hot":
        request.getfixturevalue("hot")
    rng = np.random.default_rng(5)

    def boxes(n):
        mid, size = rng.uniform(0, 1, (n, 2)), rng.uniform(0.05, 0.3, (n, 2))
        return np.clip(np.hstack([mid - size / 2, mid + size / 2]), 0, 1)

    truth = boxes(24)
    found = np.clip(truth[rng.integers(0, 24, 40)] + rng.normal(0, 0.02, (40, 4)), 0, 1)
    d = spark.createDataFrame([(i % 3, 1, i, *map(float, b)) for i, b in enumerate(found)], "image_id int, class_id int, det_idx int, x1 double, y1 double, x2 double, y2 double")
    t = spark.createDataFrame([(i % 3, 1, i, *map(float, b)) for i, b in enumerate(truth)], "image_id int, class_id int, gt_idx int, x1 double, y1 double, x2 double, y2 double")
    settings = [{**cal.NEUTRAL, "width_scale": w, "center_x_offset": o} for w in (0.8, 1.0, 1.3) for o in (-0.04, 0.0, 0.03)]
    got = {r.grid_id: r.tp for r in cal.move_sweep(d, t, settings, 0.4).collect()}
    for i, s in enumerate(settings):
        named = set()
        for k, (x1, y1, x2, y2) in enumerate(found):
            mid, half = (x1 + x2) / 2 + s["center_x_offset"], (x2 - x1) * s["width_scale"] / 2
            box = (max(0, mid - half), y1, min(1, mid + half), y2)
            best = (0.0, None)
            for j, g in enumerate(truth):
                if j % 3 == k % 3:
                    inter = max(0, min(box[2], g[2]) - max(box[0], g[0])) * max(0, min(box[3], g[3]) - max(box[1], g[1]))
                    over = inter / ((box[2] - box[0]) * (box[3] - box[1]) + (g[2] - g[0]) * (g[3] - g[1]) - inter)
                    best = max(best, (over, j), key=lambda v: v[0])
            if best[0] >= 0.4:
                named.add(best[1])
        assert got[i] == len(named)
    assert {r.tp for r in cal.move_sweep(d.limit(0), t, settings).collect()} == {0}


def test_one_side_hot(spark, hot):
    left = spark.createDataFrame([(1, 0, 0, 0.9, 0.1, 0.1, 0.3, 0.3)], "image_id int, class_id int, det_idx int, confidence double, x1 double, y1 double, x2 double, y2 double")
    right = spark.createDataFrame([(1, 0, i, 0.1, 0.1, 0.3, 0.3 + i / 100) for i in range(9)], "image_id int, class_id int, gt_idx int, x1 double, y1 double, x2 double, y2 double")
    cold, crowded = split_pair(left, right, ["image_id", "class_id"])
    assert [x.count() for x in (*cold, *crowded)] == [0, 0, 1, 9]
    assert m.pair(left, right, 0.5).count() == 9


def test_local_support_with_repeated_places(spark):
    from boxtrail.operators.guards import local_support

    rng = np.random.default_rng(4)
    support = [(int(k), float(x), float(y), int(r), int(c)) for k, x, y, r, c in zip(*rng.integers(0, [[2], [12], [12], [6], [4]], (5, 400)))]
    rows = [(int(k), i, float(x), float(y)) for i, (k, x, y) in enumerate(zip(*rng.integers(0, [[3], [12], [12]], (3, 60))))]
    rows += [(0, 60, None, 1.0), (1, 61, 2.5, 3.5)]
    found = local_support(
        spark.createDataFrame(rows, "image_id int, det_idx int, x double, y double"),
        spark.createDataFrame([*support, (0, None, 1.0, 9, 9)], "image_id int, x double, y double, response int, contrast int"),
        1.0, ["image_id"],
    )
    got = {(r.image_id, r.det_idx): (r.response, r.contrast) for r in found.collect()}
    want = {}
    for k, i, x, y in rows:
        near = [(r, -b, -a, c) for key, a, b, r, c in support if key == k and x is not None and abs(a - x) <= 1 and abs(b - y) <= 1]
        if near:
            want[k, i] = (max(near)[0], max(near)[3])
    assert got == want and len(want) > 30


def test_one_set_of_pairs_serves_every_setting_across_batches(spark):
    """Pairs for a wide reach give each setting's own counts, also when a detection's pairs lie in several Arrow batches."""
    rng = np.random.default_rng(8)
    shape = "image_id int, class_id int, {} int, x1 double, y1 double, x2 double, y2 double"

    def table(name, n):
        mid, size = rng.uniform(0.3, 0.5, (n, 2)), rng.uniform(0.2, 0.3, (n, 2))
        rows = [(i % 2, 1, i, *map(float, b)) for i, b in enumerate(np.hstack([mid - size / 2, mid + size / 2]))]
        return spark.createDataFrame([*rows, (0, 1, n, None, 0.1, 0.5, 0.5), (0, 1, None, 0.3, 0.3, 0.5, 0.5), rows[0]], shape.format(name))

    d, t = table("det_idx", 30), table("gt_idx", 20)
    settings = [{**cal.NEUTRAL, "width_scale": w, "center_y_offset": o} for w in (0.8, 1.3) for o in (-0.04, 0.03)]
    pairs = cal.move_pairs(d, t, {"width_scale": (0.8, 1.3), "height_scale": (0.8, 1.3), "center_x_offset": (-0.04, 0.04), "center_y_offset": (-0.04, 0.04)})
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", "3")
    try:
        got = {r.grid_id: r.tp for r in cal.count_moves(pairs, settings).collect()}
    finally:
        spark.conf.unset("spark.sql.execution.arrow.maxRecordsPerBatch")
    for i, s in enumerate(settings):
        moved = d.select("image_id", "class_id", "det_idx", *[c.alias(n) for n, c in zip(("x1", "y1", "x2", "y2"), cal.moved_box(m.g.box(), s))])
        on = ["image_id", "class_id"]
        both = moved.alias("d").join(t.alias("t"), on).select(*on, "d.det_idx", "t.gt_idx", m.g.iou(m.g.box("d"), m.g.box("t")).alias("o")).where("o >= 0.5")
        named = both.groupBy(*on, "det_idx").agg(F.min(F.struct(-F.col("o"), "gt_idx"))["gt_idx"].alias("gt_idx")).dropna(subset=["gt_idx"])
        assert got[i] == named.select(*on, "gt_idx").distinct().count() > 0
