"""Event-time streams, load shedding, prefix sums over partitions and the matrix of the split search."""

import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from boxtrail.operators import ordered, splits
from boxtrail.streaming import kernels as k, streams as st, trackers as tr
from boxtrail.streaming.feed import as_stream, run_counted, run_to_end
from boxtrail.streaming.stateful import Clock

ORIGIN = 946_684_800_000_000
LINE = k.LineConfig(roi=(0, 0, 300, 100), line_fraction=0.5, minimum_hits=2, max_misses=2, max_center_distance=0.2, hysteresis=0.02, observations=True)
DET = "source long, frame_index long, det_idx long, class_id int, class_name string, confidence double, x1 double, y1 double, x2 double, y2 double"
CLOCK = Clock("ts", 100.0)


def box(source, frame, x, idx=0):
    return (source, frame, idx, 1, "droplet", 0.9, x - 8.0, 30.0, x + 8.0, 50.0)


def feed(df, lag=2, pieces=3, delay=None):
    timed = df.withColumn("ts", st.frame_time("frame_index", 10.0, ORIGIN))
    late = F.pmod(F.xxhash64("source", "frame_index"), F.lit(lag + 1)) * 100
    return as_stream(timed, "ts", (lag + 1) * 100 if delay is None else delay, pieces, late)


def test_line_stream_closes_its_last_frame_and_ends_its_tracks(spark):
    rng = random.Random(4)
    rows = [box(s, start + i, 100.0 + 11 * i + rng.random(), j) for s in (1, 2, 5) for start in (0, 17, 60) for i in range(9) for j in (0,) if rng.random() > 0.1]
    rows += [box(1, 69, 150.0 + 20 * j, j) for j in range(3)]
    df = spark.createDataFrame(rows, DET)
    got = run_to_end(tr.track_lines(feed(df), ["source"], LINE, clock=CLOCK))
    # The table runs on until all tracks have ended, as the stream's timers do.
    ends = df.groupBy("source").agg((F.max("frame_index") + 5).alias("last_frame"))
    table = tr.track_lines(df, ["source"], LINE, ends=ends)
    cols = ["source", "kind", "frame_index", "track_id", "class_id", "hits", "misses", "counted", "center_x"]
    assert sorted(map(tuple, got.select(*cols).collect())) == sorted(map(tuple, table.select(*cols).collect()))
    assert got.where("kind = 'event'").count() > 0 and got.agg(F.max("frame_index")).first()[0] > 69


def test_rows_behind_the_watermark_are_counted(spark):
    rows = [box(1, f, 50.0 + f) for f in range(40)] + [box(2, f, 50.0 + f) for f in range(0, 40, 13)]
    df = spark.createDataFrame(rows, DET).withColumn("ts", st.frame_time("frame_index", 10.0, ORIGIN))
    # Frame 3 arrives three seconds late, far behind a watermark of 0.2 s.
    lag = F.when((F.col("source") == 1) & (F.col("frame_index") == 3), 3000).otherwise(0)
    cfg = k.OptimalConfig(model_width=130.0, line_x=155.0, minimum_hits=2, max_misses=3, max_center_distance=0.25, hysteresis=0.03)
    got, late = run_counted(tr.track_optimal(as_stream(df, "ts", 200, 4, lag), ["source"], cfg, clock=CLOCK))
    assert late == 1
    assert sorted((r.source, r.frame_index) for r in got.collect()) == sorted((r[0], r[1]) for r in rows if r[:2] != (1, 3))


def test_empty_feed(spark):
    cfg = k.PointConfig(max_distance=5.0, max_missed=1)
    none = spark.createDataFrame([], "source long, frame_index long, det_idx long, x double, y double, score double")
    assert run_to_end(tr.track_points(feed(none), ["source"], cfg, clock=CLOCK)).count() == 0


def test_load_shedding_counts_late_batches(spark):
    df = spark.createDataFrame([(s, f, "v") for f in range(30) for s in (1, 2)], "source long, frame_index long, v string")
    timed = df.withColumn("ts", st.frame_time("frame_index", 10.0, ORIGIN))
    # Source 2 sends its newest frames first and all others in the last batch.
    lag = F.when((F.col("source") == 2) & (F.col("frame_index") < 20), 2900 - 100 * F.col("frame_index")).otherwise(F.when(F.col("source") == 2, -100 * F.col("frame_index")).otherwise(0))
    out = run_to_end(st.latest_stream(as_stream(timed, "ts", 60_000, 3, lag), "source", "frame_index"))
    rows = out.collect()
    for s in (1, 2):
        mine = [r for r in rows if r.source == s]
        assert sum(r.dropped + r.sent for r in mine) == max(r.received for r in mine) == 30
        assert max(r.frame_index for r in mine if r.sent) == 29
    assert [r.dropped for r in rows if r.source == 2 and not r.sent] == [20]
    seen = spark.createDataFrame([(1, 28), (2, 29)], "source long, frame_index long")
    assert [(r.source, r.frame_index) for r in st.next_after(out, "source", "frame_index", seen).collect()] == [(1, 29)]


def test_running_sums_across_many_partitions(spark):
    rng = np.random.default_rng(3)
    rows = [(None if key == 3 else int(key), int(i), int(v)) for i, (key, v) in enumerate(zip(rng.choice([0, 0, 0, 1, 2, 3], 400), rng.integers(-9, 9, 400), strict=True))]
    df = spark.createDataFrame(rows, "key long, at long, v long").repartition(7)
    for keys in ([], ["key"]):
        got = {r["at"]: (r.total, r.n) for r in ordered.Ordered(df, keys, ["at"]).running({"total": F.col("v"), "n": F.lit(1).cast("long")}).collect()}
        sums = {}
        for key, at, v in rows:
            own = key if keys else 0
            sums[own] = (sums.get(own, (0, 0))[0] + v, sums.get(own, (0, 0))[1] + 1)
            assert got[at] == sums[own]


@pytest.mark.parametrize("kind", ["squared", "rate"])
def test_matrix_search_equals_rows_of_trials(spark, monkeypatch, kind):
    rng = np.random.default_rng(6)
    rows = [(f"g{i:02d}", int(a) + 1, int(min(b, a))) for i, (a, b) in enumerate(zip(rng.integers(1, 40, 23), rng.integers(0, 9, 23), strict=True))] + [(None, 3, 1)]
    groups = spark.createDataFrame(rows, "g string, total long, hit long")
    args = (groups, "g", ["total", "hit"], 70, 5)
    options = {"weights": {"hit": 4.0}, "required": {"hit": "both"}, "kind": kind, "at_least_one": True}
    fast = sorted(map(str, splits.grouped_split(*args, **options).collect()))
    monkeypatch.setattr(splits, "MATRIX_GROUPS", 0)
    assert fast == sorted(map(str, splits.grouped_split(*args, **options).collect()))
    monkeypatch.undo()
    with pytest.raises(ValueError, match="no permutation"):
        splits.grouped_split(spark.createDataFrame([("a", 1, 1), ("b", 1, 0), ("c", 1, 0)], "g string, total long, hit long"), "g", ["total", "hit"], 20, 1, required={"hit": "any"})


def plain_links(up, down, low, high, reach, line, preserve):
    """The associator written as two loops over a class's events."""
    free, out = list(up), {}
    for d in sorted(down, key=lambda r: (r[1], r[0])):
        best = None
        for u in free:
            delay, cross = d[1] - u[1], abs(d[2] - u[2])
            if low <= delay <= high and cross <= reach:
                want = line / abs(u[3]) if abs(u[3]) >= 0.25 else float(delay)
                score = abs(delay - want) / max(want, 1.0) + cross / max(reach, 1.0)
                rank = (u[1], score, u[0]) if preserve else (score, u[1], u[0])
                best = min(best, (rank, u)) if best else (rank, u)
        out[d[0]] = best[1][0] if best else None
        if best:
            free.remove(best[1])
    return out


@pytest.mark.parametrize("route", ["plain", "hot"])
@pytest.mark.parametrize("preserve", [False, True])
def test_association_walks_busy_keys_once(spark, request, route, preserve):
    from boxtrail.operators import association

    if route == "hot":
        request.getfixturevalue("hot")
    rng = np.random.default_rng(12)
    cols = "source long, event_id long, frame_index long, center_x double, center_y double, confidence double, velocity_x double"
    make = lambda n, base: [(int(s), base + i, int(f), 0.0, float(y), 0.5, float(v)) for i, (s, f, y, v) in enumerate(zip(rng.integers(0, 3, n), np.sort(rng.integers(0, 120, n)), rng.integers(0, 30, n), rng.integers(0, 8, n) / 2, strict=True))]
    up, down = make(90, 0), [*make(90, 1000), (0, 2000, 50, 0.0, None, 0.5, 1.0)]
    out = association.associate_events(spark.createDataFrame(up, cols), spark.createDataFrame(down, cols), ["source"], 1, 12, 14.0, 12.0, preserve)
    found = {(r.source, r.event_id): r.upstream_id for r in out.collect()}
    for s in range(3):
        pick = lambda rows: [(r[1], r[2], r[4], r[6]) for r in rows if r[0] == s and r[4] is not None]
        for event, link in plain_links(pick(up), pick(down), 1, 12, 14.0, 12.0, preserve).items():
            assert found[s, event] == link
    assert found[0, 2000] is None and len(found) == len(down)


@pytest.mark.parametrize("route", ["plain", "hot"])
def test_refractory_walks_in_order(spark, request, route):
    if route == "hot":
        request.getfixturevalue("hot")
    rng = np.random.default_rng(7)
    rows = [(s, int(f), int(f) % 5) for s in (1, 2) for f in np.unique(rng.integers(0, 300, 140))] + [(1, None, 0), (None, 4, 0)]
    got = sorted((r.source, r.frame) for r in tr.refractory(spark.createDataFrame(rows, "source long, frame long, v int"), ["source"], "frame", 7).collect())
    want = []
    for s in (1, 2):
        last = -10**9
        for f in sorted(r[1] for r in rows if r[0] == s and r[1] is not None):
            if f - last >= 7:
                want.append((s, f))
                last = f
    assert got == want


@pytest.mark.parametrize("route", ["plain", "hot"])
def test_last_result_is_carried_over_partitions(spark, request, route):
    from boxtrail.operators.windows import latest_result

    if route == "hot":
        request.getfixturevalue("hot")
        spark.conf.set("spark.sql.shuffle.partitions", "9")
    try:
        frames = [(s, f) for s in (1, 2, 3) for f in range(300)]
        results = [(1, 5, 3), (2, 10, 9), (2, 150, 140), (2, 150, 149), (2, 290, 200)]
        out = latest_result(spark.createDataFrame(frames, "source long, frame long"), spark.createDataFrame(results, "source long, done long, result_frame long"), ["source"], "frame", "done")
        rows = out.collect()
    finally:
        spark.conf.set("spark.sql.shuffle.partitions", "4")
    assert len(rows) == len(frames)
    for r in rows:
        last = max(((d, x) for s, d, x in results if s == r.source and d <= r.frame), default=(None, None))[1]
        assert (r.latest_result, r.lag_frames) == (last, max(0, r.frame - last) if last is not None else 0)


def test_clusters_are_the_best_of_all_starts(spark):
    from pyspark.ml.feature import VectorAssembler

    from boxtrail.operators import learning

    rng = np.random.default_rng(3)
    points = np.concatenate([rng.normal(c, 0.3, (40, 2)) for c in ((0, 0), (6, 0), (0, 6), (6, 6), (3, 12))])
    df = VectorAssembler(inputCols=["a", "b"], outputCol="features").transform(spark.createDataFrame([tuple(map(float, p)) for p in points], "a double, b double"))
    centers, cost = learning.best_centers(df, 5, starts=12)
    out = learning.cluster(df, 5, starts=12).collect()
    assert len(cost) == 12 and np.isclose(sum(r.cluster_distance**2 for r in out), cost.min(), rtol=1e-9)
    assert {frozenset(np.round(c).astype(int).tolist()) for c in centers} and sorted(np.bincount([r.cluster_id for r in out]).tolist()) == [40] * 5
    assert learning.cluster(df.limit(0), 5).count() == 0
    assert {r.cluster_id for r in learning.cluster(df.limit(2), 5).collect()} <= {0, 1}


def test_slug_keeps_letters_of_any_language(spark):
    from boxtrail.functions.stats import slug

    rows = spark.createDataFrame([("  A b--C é9_",), ("__",), (None,)], "t string")
    assert [r[0] for r in rows.select(slug(F.col("t"))).collect()] == ["a_b__c_é9", "", None]
