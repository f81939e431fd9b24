"""Order-dependent helpers give the same rows on ordinary and on hot routes."""

import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from boxtrail.operators import ordered as od, selection as sel, splits as sp, telemetry as tl, windows as wn


@pytest.fixture(params=["plain", "hot"])
def rows(request, spark):
    if request.param == "hot":
        request.getfixturevalue("hot")
    rng = random.Random(3)
    # One key holds most rows.
    data = [(0 if rng.random() < 0.7 else rng.randint(1, 4), i, float(rng.randint(0, 9))) for i in range(200)]
    return data, spark.createDataFrame(data, "k int, i long, v double").repartition(5)


def by_key(data):
    out = {}
    for k, i, v in sorted(data, key=lambda r: r[1]):
        out.setdefault(k, []).append((i, v))
    return out


def test_running_lag_index(rows):
    data, df = rows
    run = {(r.k, r.i): r.s for r in od.running(df, ["k"], ["i"], {"s": F.col("v")}).collect()}
    lag = {(r.k, r.i): r.p for r in od.lagged(df, ["k"], ["i"], {"p": F.col("v")}).collect()}
    for k, items in by_key(data).items():
        total, prev = 0.0, None
        for i, v in items:
            total += v
            assert run[k, i] == total and lag[k, i] == prev
            prev = v
    whole = sorted((r.i, r.rn) for r in od.indexed(df, [], ["i"]).collect())
    assert whole == [(i, i + 1) for i in range(200)]


@pytest.mark.parametrize("kind", ["linear", "nearest", "truncated"])
def test_quantiles(rows, kind):
    data, df = rows
    points = {"a": 0.0, "b": 0.33, "c": 0.5, "d": 0.95, "e": 1.0}
    got = {r.k: r for r in od.quantiles(df, ["k"], F.col("v"), points, kind).collect()}
    for k, items in by_key(data).items():
        v = sorted(x for _, x in items)
        for n, q in points.items():
            if kind == "linear":
                want = float(np.percentile(v, q * 100))
            else:
                at = (len(v) - 1) * q
                want = v[round(at) if kind == "nearest" else int(at)]
            assert got[k][n] == pytest.approx(want)


def test_windows(rows):
    data, df = rows
    roll = {(r.k, r.i): r.m for r in wn.rolling_mean(df, ["k"], ["i"], "v", 4, "m").collect()}
    move = {(r.k, r.i): r.m for r in wn.moving_average(df, ["k"], ["i"], "v", 4, "m").collect()}
    for k, items in by_key(data).items():
        v = [x for _, x in items]
        padded = [v[0]] * 3 + v
        for n, (i, x) in enumerate(items):
            assert roll[k, i] == pytest.approx(np.mean(v[max(0, n - 3) : n + 1]))
            assert move[k, i] == pytest.approx(np.mean(padded[n : n + 4]) if len(v) >= 4 else x)


def test_small_window_chunks(spark):
    df = spark.createDataFrame([(0, i, float(i * i % 7)) for i in range(50)], "k int, i long, v double")
    out = wn.trailing(df, ["k"], ["i"], 5, F.lit(8), lambda w: {"m": F.sum("v").over(w)})
    got = {r.i: r.m for r in out.collect()}
    v = [float(i * i % 7) for i in range(50)]
    assert len(got) == 50 and all(got[n] == sum(v[max(0, n - 4) : n + 1]) for n in range(50))


def test_pct_rank_null_is_half(spark):
    df = spark.createDataFrame([(1, 1.0), (2, 1.0), (3, 3.0), (4, None)], "i int, v double")
    assert {r.i: r.p for r in wn.pct_rank_avg(df, [], "v", "p").collect()} == {1: 0.5, 2: 0.5, 3: 1.0, 4: 0.5}


def test_robust_z(spark):
    v = [1.0, 2.0, 3.0, 10.0]
    df = spark.createDataFrame([(i, x, 5.0) for i, x in enumerate(v)], "i int, a double, b double")
    got = {r.i: (r.z_a, r.z_b) for r in tl.robust_z(df, [], ["a", "b"]).collect()}
    mad = float(np.median(np.abs(np.array(v) - np.median(v))))
    assert all(got[i] == (pytest.approx(abs(x - 2.5) / (1.4826 * mad)), 0.0) for i, x in enumerate(v))


@pytest.mark.parametrize("n,count", [(10, 4), (3, 7), (5, 1), (7, 7)])
def test_evenly_spaced(spark, n, count):
    df = spark.range(n).withColumnRenamed("id", "f")
    got = sorted(r.f for r in sel.evenly_spaced(df, [], ["f"], count).collect())
    want = [(n - 1) // 2] if count == 1 else sorted({round(x) for x in np.linspace(0, n - 1, count)})
    assert got == want


def test_gap_respects_used_frames(rows, spark):
    data, _ = rows
    frames = spark.createDataFrame([(1, i, float(i % 17)) for i in range(60)], "k int, frame_index long, s double")
    used = spark.createDataFrame([(1, 16), (1, 40)], "k int, frame_index long")
    got = [r.frame_index for r in sel.select_with_gap(frames, ["k"], "frame_index", "s", 4, 6, used).collect()]
    kept, want = [16, 40], []
    for i in sorted(range(60), key=lambda x: (-(x % 17), x)):
        if len(want) < 4 and all(abs(i - u) >= 6 for u in kept):
            kept.append(i), want.append(i)
    assert sorted(got) == sorted(want)
    more = [r.frame_index for r in sel.fill_representative(frames, ["k"], "frame_index", used, 2, 5, 6).collect()]
    assert len(more) == 3 and all(abs(a - b) >= 6 for a in more for b in [16, 40, *[m for m in more if m != a]])


@pytest.mark.parametrize("total,gap,seed", [(6, 4, 0), (9, 1, 1), (5, 12, 2), (7, 0, 3)])
def test_spaced_fill_equals_a_loop(spark, total, gap, seed):
    rng = np.random.default_rng(seed)
    frames = {k: sorted({int(x) for x in rng.integers(0, 150, 70)}) for k in range(4)}
    used = {k: [int(x) for x in rng.choice(frames[k], k, replace=False)] for k in range(4)}
    df = spark.createDataFrame([(k, x) for k, f in frames.items() for x in f + f[:5]], "k int, f int")
    old = spark.createDataFrame([(k, x) for k, u in used.items() for x in u], "k int, f int")
    got = sorted((r.k, r.f) for r in sel.fill_representative(df, ["k"], "f", old, 3, total, gap).collect())
    want = []
    for k, f in frames.items():
        taken, need = list(used[k]), total - len(used[k])
        for i in range(need):
            target = f[0] + i * ((f[-1] - f[0]) / max(need - 1, 1))
            free = [x for x in f if all(abs(x - u) >= gap for u in taken)]
            if free:
                taken.append(min(free, key=lambda x: (abs(x - target), x)))
                want.append((k, taken[-1]))
    assert got == sorted(want)


def test_grouped_split_properties(spark):
    rows = spark.createDataFrame([(f"v_{i}", int(i % 3 == 0)) for i in range(60) for _ in range(3)], "g string, y int")
    groups = sp.group_totals(rows, "g", {"n": F.count(F.lit(1)), "pos": F.sum("y")})
    a = {r.g: r.split for r in sp.grouped_split(groups, "g", ["n", "pos"], 40, 1, required={"pos": "both"}, kind="rate").collect()}
    b = {r.g: r.split for r in sp.grouped_split(groups, "g", ["n", "pos"], 40, 1, required={"pos": "both"}, kind="rate").collect()}
    assert a == b and len(a) == 60
    for split, size in (("train", 42), ("valid", 9), ("test", 9)):
        mine = [g for g, s in a.items() if s == split]
        assert len(mine) == size and {int(g[2:]) % 3 == 0 for g in mine} == {True, False}
    one_class = groups.withColumn("pos", F.lit(0))
    with pytest.raises(ValueError, match="no permutation"):
        sp.grouped_split(one_class, "g", ["n", "pos"], 5, 1, required={"pos": "any"})


def test_rows_of_hot_keys_are_marked_without_meeting_in_one_task(spark):
    from boxtrail.operators.skew import split_hot, split_pair

    df = spark.range(40).select((F.col("id") % 2).alias("k"), "id")
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        (cold, hot), (_, pair) = split_hot(df, ["k"], 5), split_pair(df, df, ["k"], 5)
        for part in (cold, hot, *pair):
            plan = part._jdf.queryExecution().executedPlan().toString()
            assert "BroadcastHashJoin" in plan and "SortMergeJoin" not in plan
        assert cold.count() == 0 and hot.count() == 40
    finally:
        spark.conf.unset("spark.sql.autoBroadcastJoinThreshold")
