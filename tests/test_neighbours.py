"""Neighbours inside ordinary keys are found without copying rows to bins; crowded keys give the same rows."""

import numpy as np
import pytest

from boxtrail.operators import decode, features, guards


def plan(df) -> str:
    return df._jdf.queryExecution().optimizedPlan().toString()


@pytest.fixture(params=["", "2"], ids=["ordinary", "crowded"])
def route(request, spark):
    names = ("boxtrail.hot.foldRows", "boxtrail.hot.windowRows")
    for n in names if request.param else ():
        spark.conf.set(n, request.param)
    yield request.param
    for n in names:
        spark.conf.unset(n)


def test_guarded_accept_looks_through_its_own_points(spark, route):
    rng = np.random.default_rng(6)
    det = [(int(k), i, float(c), float(x), float(y)) for i, (k, c, x, y) in enumerate(zip(*rng.integers(0, [[6], [10], [9], [9]], (4, 80))))]
    det = [(k, i, c / 10, x, y) for k, i, c, x, y in det]
    det += [(0, 80, None, 1.0, 1.0), (0, 81, 0.6, None, 1.0), (None, 82, 0.6, 1.0, 1.0), (0, 83, 0.95, 1.0, 1.0)]
    points = [(int(k), float(x), float(y), int(r), int(c)) for k, x, y, r, c in zip(*rng.integers(0, [[5], [9], [9], [40], [20]], (5, 60)))]
    points += [(0, None, 1.0, 90, 90), (None, 1.0, 1.0, 90, 90), (1, 3.0, 3.0, None, 5)]
    out = guards.guarded_accept(
        spark.createDataFrame(det, "image_id int, det_idx int, confidence double, x double, y double"),
        spark.createDataFrame(points, "image_id int, x double, y double, response int, contrast int"),
        0.5, 0.9, 20, 2, 5,
    )
    assert out.columns == ["image_id", "det_idx", "confidence", "x", "y", "state"]
    assert route or "explode" not in plan(out)
    want = {}
    for k, i, c, x, y in det:
        near = [(r, -b, -a, t) for key, a, b, r, t in points if key == k and None not in (k, x, a) and abs(a - x) <= 2 and abs(b - y) <= 2]
        best = max(near, key=lambda p: (p[0] is not None, p[0] or 0, *p[1:])) if near else (None,)
        strong = best[0] is not None and best[0] >= 20 and best[3] >= 5
        want[i] = "rejected" if c is None else "accepted" if c >= 0.9 else "ignored" if c < 0.5 else "guarded" if strong else "rejected"
    assert {r.det_idx: r.state for r in out.collect()} == want and len(set(want.values())) == 4


def test_local_support_keeps_points_without_a_response(spark, route):
    rows = spark.createDataFrame([(1, i, float(i), 0.0) for i in range(6)], "image_id int, det_idx int, x double, y double")
    points = spark.createDataFrame([(1, 0.0, 0.0, None, 3), (1, 1.0, 0.0, None, 4), (1, 5.0, 0.0, 2, 1)], "image_id int, x double, y double, response int, contrast int")
    found = guards.local_support(rows, points, 1.0, ["image_id"])
    # Of two points without a response the one further left comes first.
    assert sorted(map(tuple, found.collect())) == [(1, 0, None, 3), (1, 1, None, 3), (1, 2, None, 4), (1, 4, 2, 1), (1, 5, 2, 1)]
    assert route or "explode" not in plan(found)


def test_local_peaks_by_ranges_of_cells(spark, route):
    rng = np.random.default_rng(7)
    cells = [(int(k), int(y), int(x), float(v)) for k, y, x, v in zip(*rng.integers(0, [[4], [7], [7], [5]], (4, 90)))]
    cells += [(0, -1, -1, 9.0), (0, 0, 6, 3.0), (0, 1, 0, 8.0), (0, None, 1, 9.0), (None, 1, 1, 9.0), (1, 2, 2, None)]
    df = spark.createDataFrame(cells, "g int, gy int, gx int, v double")
    out = decode.local_peaks(df, ["g"], "v")
    assert out.columns == ["g", "gy", "gx", "v"]
    assert route or "explode" not in plan(out)
    whole = [c for c in cells if None not in c]
    want = [c for c in whole if all(c[3] >= o[3] for o in whole if o[0] == c[0] and abs(o[1] - c[1]) <= 1 and abs(o[2] - c[2]) <= 1)]
    assert sorted(map(tuple, out.collect())) == sorted(want) and len(want) > 10


def test_dominant_circle_in_one_array_a_key(spark, route):
    rng = np.random.default_rng(9)
    obs = [(int(k), i, float(x), float(r)) for i, (k, x, r) in enumerate(zip(*rng.integers([[0], [0], [0]], [[5], [60], [40]], (3, 140))))]
    obs += [(5, 900 + i, float(30 * i), 1.0) for i in range(14)] + [(6, 950, 1.0, 1.0), (7, 960, None, 1.0), (0, 970, None, 2.0), (0, 971, float("nan"), 2.0)]
    obs += [(None, 980 + i, 1.0, 1.0) for i in range(13)]
    out = features.dominant_circle(spark.createDataFrame(obs, "video int, obs_idx int, x double, r double"), ["video"])
    assert out.columns == ["video", "observations", "inliers", "center_x", "radius", "state"]
    assert route or "explode" not in plan(out)
    want = {}
    for k in {o[0] for o in obs}:
        mine = [o for o in obs if o[0] == k]
        placed = [o for o in mine if k is not None and o[2] is not None and o[2] == o[2]]
        near = {o: sum(abs(p[2] - o[2]) <= 12 and abs(p[3] - o[3]) <= 7 for p in placed) for o in placed}
        seed = max(placed, key=lambda o: (near[o], -o[1])) if placed else None
        held = [p for p in placed if abs(p[2] - seed[2]) <= 14 and abs(p[3] - seed[3]) <= 9] if seed else []
        state = "too_few_observations" if len(mine) < 12 else "cluster_too_small" if len(held) < 10 else "ok"
        mid = [float(np.median([p[i] for p in held])) if state == "ok" else None for i in (2, 3)]
        want[k] = (len(mine), len(held) or None, *mid, state)
    assert {r.video: tuple(r)[1:] for r in out.collect()} == want and len({w[-1] for w in want.values()}) == 3
