"""Behaviour cases of trackers and association, and table/stream parity."""

import os
import random
import time

import pytest
from pyspark.sql import functions as F

from boxtrail.operators import association as assoc
from boxtrail.operators.motion import estimate_velocity
from boxtrail.streaming import kernels as k, streams as st, trackers as tr

# A region 400 wide with its line at x = 190; the band around the line is 8 wide on each side.
CFG = k.LineConfig(
    roi=(30, 20, 430, 220), line_fraction=0.4, minimum_hits={"cell": 2, "droplet": 3}, max_misses={"cell": 1, "droplet": 2},
    max_center_distance={"cell": 0.15, "droplet": 0.2}, hysteresis=0.02,
)
DET = "source long, frame_index long, det_idx long, class_id int, class_name string, confidence double, x1 double, y1 double, x2 double, y2 double"


def det(source, frame, x, name="droplet", idx=0):
    return (source, frame, idx, int(name == "droplet"), name, 0.95, x - 10.0, 40.0, x + 10.0, 70.0)


def events(spark, rows, cfg=CFG, last=None):
    df = spark.createDataFrame(rows, DET)
    ends = spark.createDataFrame([(0, last)], "source long, last_frame long") if last is not None else None
    return tr.crossing_events(tr.track_lines(df, ["source"], cfg, ends=ends), ["source"]).orderBy("frame_index").collect()


def track(xs, start=0, source=0):
    return [det(source, start + i, float(x)) for i, x in enumerate(xs)]


@pytest.mark.parametrize(("last_x", "count"), [(196, 0), (200, 1)])
def test_counts_only_beyond_the_band(spark, last_x, count):
    got = events(spark, track([88, 119, 151, 177, last_x]))
    assert [e.cumulative_count for e in got] == [1] * count


@pytest.mark.parametrize(("misses", "same"), [(2, True), (3, False)])
def test_track_lives_for_the_allowed_misses(spark, misses, same):
    """Steps of 14; the gap lies far before the line, so only the track's number tells whether it lived on."""
    xs = [(f, 44.0 + 14 * f) for f in range(3)] + [(f, 44.0 + 14 * f) for f in range(3 + misses, 14)]
    got = events(spark, [det(0, f, x) for f, x in xs])
    assert [e.track_id for e in got] == [1 if same else 2]
    seen = k.LineConfig(**{**CFG.__dict__, "observations": True})
    obs = tr.track_lines(spark.createDataFrame([det(0, f, x) for f, x in xs], DET), ["source"], seen)
    assert {r.predicted for r in obs.filter("kind='observation' and frame_index=3").collect()} <= {True}


@pytest.mark.parametrize(("last", "count"), [(3, 0), (4, 1)])
def test_prediction_crosses_while_the_track_lives(spark, last, count):
    """Three hits in steps of 21 up to 163; the first predicted step stays inside the band, the second is beyond it."""
    assert len(events(spark, [det(0, f, 121.0 + 21 * f) for f in range(3)], last=last)) == count


def test_born_beyond_the_line_or_moving_back(spark):
    assert events(spark, track(range(206, 320, 23))) == []
    assert events(spark, track(range(290, 60, -31))) == []


def test_missing_class_setting_raises(spark):
    with pytest.raises(Exception, match="no tracker setting"):
        events(spark, [det(0, f, 90.0 + f, "other") for f in range(2)])


def test_ids_continue_over_segments(spark):
    rows = track(range(72, 300, 37)) + track(range(60, 300, 33), start=64)
    got = events(spark, rows)
    assert [(e.track_id, e.cumulative_count) for e in got] == [(1, 1), (2, 2)]
    whole = k.LineTracker(CFG)  # one kernel over everything gives the same events
    want = [e for r in rows for e in whole.advance(r[1], [dict(zip([c.split()[0] for c in DET.split(", ")], r))])]
    assert [(e["frame_index"], e["track_id"]) for e in want] == [(e.frame_index, e.track_id) for e in got]


EVENT = "source long, class_id int, event_id long, frame_index long, center_x double, center_y double, confidence double, velocity_x double"


def event(i, frame, cls=1, y=55.0, v=5.0):
    return (0, cls, i, frame, 180.0, y, 0.9, v)


def test_order_is_preserved(spark):
    up = spark.createDataFrame([event(3, 41), event(4, 53), event(5, 66)], EVENT)
    down = spark.createDataFrame([event(9, 71)], EVENT)
    kept = assoc.associate_events(up, down, ["source", "class_id"], 4, 60, 20.0, 120.0, preserve_order=True).first()
    assert kept.verified and kept.upstream_id == 3


def consensus(spark, a, b):
    cols = EVENT + ", arrival long, current_frame long"
    return assoc.consensus(spark.createDataFrame(a, cols), spark.createDataFrame(b, cols), ["source", "class_id"], 2, 20, 8.0, 15.0).collect()


def test_consensus_cases(spark):
    at = lambda e, step, now: (*e, step, now)
    same = consensus(spark, [at(event(1, 10), 1, 10)], [at(event(4, 18), 2, 18)])
    assert len(same) == 1 and same[0].cumulative_count == 1
    assert consensus(spark, [at(event(1, 10, cls=0), 1, 10)], [at(event(4, 18), 2, 18)]) == []
    assert consensus(spark, [at(event(1, 10), 2, 10)], [at(event(4, 8), 1, 8)]) == []
    late = consensus(spark, [at(event(1, 10), 2, 19)], [at(event(4, 18), 1, 18)])
    assert len(late) == 1 and late[0].delay_frames == 8
    two = consensus(spark, [at(event(1, 10), 1, 12), at(event(2, 12), 1, 12)], [at(event(5, 18), 2, 18), at(event(6, 20), 3, 20)])
    assert len(two) == 2


def random_events(seed, n=120):
    rng = random.Random(seed)
    rows = []
    for i in range(n):
        side, frame = rng.randint(0, 1), rng.randint(0, 150)
        now = frame + (rng.randint(0, 4) if side == 0 else 0)
        rows.append((0, rng.randint(0, 1), i, frame, float(rng.randint(0, 20)), round(rng.uniform(0.4, 1), 3), 2.0, now, side))
    return rows


TAGGED = "source long, class_id int, event_id long, event_frame long, center_y double, confidence double, velocity_x double, current_frame long, side int"
PAIR = k.PairConfig(min_delay=2, max_delay=20, nominal=8.0, max_cross=12.0)


@pytest.mark.parametrize("route", ["plain", "hot"])
def test_consensus_equals_the_arrival_loop(spark, request, route):
    if route == "hot":
        request.getfixturevalue("hot")
    rows = random_events(5)
    loop, want = k.Consensus(PAIR), set()
    names = [c.split()[0] for c in TAGGED.split(", ")]
    items = [dict(zip(names, r)) for r in sorted(rows, key=lambda r: (r[7], r[8], r[2]))]
    for now in sorted({r["current_frame"] for r in items}):
        batch = [r for r in items if r["current_frame"] == now]
        want |= {(r["first_id"], r["second_id"]) for r in loop.advance(now, batch) if r["state"] == "fused"}
    df = spark.createDataFrame(rows, TAGGED).withColumn("arrival", F.col("current_frame") * 2 + F.col("side"))
    df = df.withColumnRenamed("event_frame", "frame_index")
    a, b = (df.filter(F.col("side") == i).drop("side") for i in (0, 1))
    got = {(r.first_id, r.second_id) for r in assoc.consensus(a, b, ["source", "class_id"], 2, 20, 8.0, 12.0).collect()}
    assert got == want and len(want) > 10


def test_optimal_tracker(spark):
    cfg = k.OptimalConfig(model_width=384, line_x=230.0, minimum_hits=3, max_misses=3, max_center_distance=0.5, hysteresis=0.04)
    for xs, n in (((100, 170, 220, 260, 300), 1), ((300, 270, 220, 170, 100), 0)):
        df = spark.createDataFrame(track(xs), DET)
        assert tr.track_optimal(df, ["source"], cfg).filter("crossed").count() == n


def test_particle_confirmation(spark):
    cols = "source long, frame_index long, det_idx long, x double, y double, score double"
    cfg = k.PointConfig(max_distance=5.0, max_missed=1, smoothing=0.7, min_hits=3, confidence=0.5)
    df = spark.createDataFrame([(0, 1, 0, 30.0, 28.0, 0.8), (0, 2, 0, 30.5, 28.0, 0.8), (0, 3, 0, 31.0, 28.0, 0.8)], cols)
    rows = tr.track_points(df, ["source"], cfg).filter("kind='observation'").orderBy("frame_index").collect()
    assert [r.confirmed for r in rows] == [False, False, True] and rows[-1].hits == 3


def test_sequence_filter(spark):
    df = spark.createDataFrame([(0, 1, 43.0, 70.0), (0, 2, 47.0, 72.0)], "source long, frame_index long, x double, y double")
    rows = tr.sequence_filter(df, ["source"], k.SequenceConfig(jump=55.0, max_missing=3)).orderBy("frame_index").collect()
    assert [r.x for r in rows] == [43.0, 46.0] and rows[0].track_id == rows[1].track_id == 1


def test_two_hit_emits_once(spark):
    rows = [(0, f, i, y, 30.0) for f in range(3) for i, y in enumerate((20.0 + f, 60.0 + f))]
    df = spark.createDataFrame(rows, "source long, frame_index long, det_idx long, y double, score double")
    got = tr.two_hit(df, ["source"], k.TwoHitConfig(max_motion=6.0)).collect()
    assert [r.frame_index for r in got] == [1, 1]


def test_velocity(spark):
    cols = "source long, frame_index long, det_idx long, confidence double, x double, y double"
    xs = [(20.0, 30.0), (70.0, 32.0), (120.0, 31.0)]
    rows = [(0, 10, i, 0.9, x, y) for i, (x, y) in enumerate(xs)] + [(0, 12, i, 0.9, x + 4, y + 2) for i, (x, y) in enumerate(xs)]
    rows += [(1, 1, 0, 0.9, 5.0, 5.0), (1, 2, 0, 0.9, 205.0, 5.0)]
    got = {(r.source, r.frame_index): (r.vx, r.vy, r.matches) for r in estimate_velocity(spark.createDataFrame(rows, cols), ["source"]).collect()}
    assert got[0, 12] == (2.0, 1.0, 3) and got[0, 10] == (0.0, 0.0, 0) and got[1, 2] == (0.0, 0.0, 0)


def stream_rows(spark, df, path, parts, run):
    """Feed ``df`` as ``parts`` files in time order, one micro-batch each; returns the rows of the stream."""
    pieces = df.collect()
    size = -(-len(pieces) // parts)
    for i in range(parts):
        chunk = pieces[i * size : (i + 1) * size]
        random.Random(i).shuffle(chunk)
        spark.createDataFrame(chunk, df.schema).coalesce(1).write.parquet(f"{path}/in/p{i:03d}")
    src = spark.readStream.schema(df.schema).option("maxFilesPerTrigger", 1).option("recursiveFileLookup", True).parquet(f"{path}/in")
    q = (
        run(src).writeStream.format("parquet").option("checkpointLocation", f"{path}/cp").option("path", f"{path}/out")
        .outputMode("append").trigger(availableNow=True).start()
    )
    q.awaitTermination(240)
    assert q.exception() is None and not q.isActive
    return spark.read.parquet(f"{path}/out")


@pytest.mark.parametrize("parts", [3, 5])
def test_line_tracker_stream_equals_table(spark, tmp_path, parts):
    rng = random.Random(parts)
    rows = []
    for source in range(3):
        for start in (0, 14, 30):
            for i in range(10):
                if rng.random() > 0.15:
                    rows.append(det(source, start + i, 110.0 + 11 * i + rng.random(), rng.choice(["droplet"] * 5 + ["cell"]), i))
        rows += [det(source, 60, 110.0), det(source, 61, 111.0)]
    df = spark.createDataFrame(sorted(rows, key=lambda r: (r[1], r[0], r[2])), DET)
    cfg = k.LineConfig(**{**CFG.__dict__, "observations": True})
    cols = ["source", "kind", "frame_index", "track_id", "class_id", "hits", "misses", "counted"]
    got = stream_rows(spark, df, str(tmp_path), parts, lambda s: tr.track_lines(s, ["source"], cfg))
    # The newest frame of a source waits for the next one, so frame 61 is not out yet.
    table = tr.track_lines(df, ["source"], cfg).filter("frame_index < 61")
    assert sorted(map(tuple, got.select(*cols).collect())) == sorted(map(tuple, table.select(*cols).collect()))
    assert got.filter("kind='event'").count() > 0


def test_consensus_stream_equals_table(spark, tmp_path):
    rows = [r for r in random_events(8) if r[7] <= 140] + [(0, 0, 999, 400, 1.0, 0.5, 2.0, 400, 1)]
    df = spark.createDataFrame(sorted(rows, key=lambda r: r[7]), TAGGED)
    got = stream_rows(spark, df, str(tmp_path), 4, lambda s: tr.consensus_stream(s, ["source", "class_id"], PAIR))
    table = tr.consensus_stream(df, ["source", "class_id"], PAIR)
    pick = lambda d: sorted((r.first_id, r.second_id) for r in d.filter("state='fused'").collect())
    assert pick(got) == pick(table) and pick(got)


def test_latest_stream_never_goes_back(spark, tmp_path):
    df = spark.createDataFrame([(s, f, float(f)) for f in range(12) for s in (1, 2)], "source long, frame long, v double")
    rows = stream_rows(spark, df, str(tmp_path), 4, lambda s: st.latest_stream(s, "source", "frame")).collect()
    for s in (1, 2):
        mine = sorted(r.frame for r in rows if r.source == s)
        assert mine[-1] == 11 and len(mine) <= 4
        assert sum(r.dropped + 1 for r in rows if r.source == s) == 12


def test_session_stream(spark, tmp_path):
    rows = [("a", f"2024-01-01 00:00:{s:02d}.{ms:03d}", 10) for s, ms in ((0, 0), (0, 30), (0, 61), (5, 0), (20, 0))]
    df = spark.createDataFrame(rows, "src string, ts string, size int").withColumn("ts", F.to_timestamp("ts"))
    out = stream_rows(spark, df, str(tmp_path), 2, lambda s: st.burst_sessions(s, ["src"], "30 milliseconds", "1 second"))
    closed = sorted((r.packets, r.bytes) for r in out.collect())
    # Exactly 30 ms stays in the session; 31 ms starts a new one. The last packet's session is still open.
    assert closed == [(1, 10), (1, 10), (2, 20)]


def test_gated_score_scores_once(spark):
    obs = spark.createDataFrame([(1, 5, 2, 0.9), (1, 6, 3, 0.9), (1, 7, 4, 0.9), (2, 5, 2, 0.9)], "track long, frame long, hits int, p double")
    rows = st.gated_score(obs, ["track"], "frame", "hits", 3, F.col("p"), 0.5, 0.5).collect()
    assert [(r.track, r.hits, r.confirmed) for r in rows] == [(1, 3, True)]


def test_confidence_policy_can_be_replaced(spark):
    obs = spark.createDataFrame([(1, 6, 3, 0.9)], "track long, frame long, hits int, p double")
    rows = st.gated_score(obs, ["track"], "frame", "hits", 3, F.col("p"), 0.5, 0.5, policy=lambda p, h, n: p * 0.5).collect()
    assert rows[0].confidence == pytest.approx(0.45) and not rows[0].confirmed


def timed_stream(spark, df, path, run, want, seconds=40):
    """A stream whose state uses clock timers never finishes by itself: wait for ``want`` rows, then stop it."""
    df.coalesce(1).write.parquet(f"{path}/in")
    src = spark.readStream.schema(df.schema).parquet(f"{path}/in")
    out = run(src)
    q = (
        out.writeStream.format("parquet").option("checkpointLocation", f"{path}/cp").option("path", f"{path}/out")
        .outputMode("append").trigger(processingTime="500 milliseconds").start()
    )
    try:
        end = time.time() + seconds
        while time.time() < end and q.exception() is None:
            time.sleep(1)
            if os.path.isdir(f"{path}/out/_spark_metadata"):
                rows = spark.read.schema(out.schema).parquet(f"{path}/out").collect()
                if len(rows) >= want:
                    return rows
    finally:
        q.stop()
    raise AssertionError(f"the stream did not give {want} rows in time")


def test_reassembly_stream(spark, tmp_path):
    from test_sources import PACKET, packets

    payload = bytes(range(13)) * 7
    whole = packets(payload)
    gap = [{**r, "frame_id": 2} for r in packets(payload) if r["chunk_index"] != 1]
    bad = [{**r, "frame_id": 3} for r in packets(payload)]
    bad[1] = {**bad[1], "infer_us": 9}
    rows = [*whole, whole[0], *gap, *bad]
    random.Random(2).shuffle(rows)
    df = spark.createDataFrame(rows, PACKET)
    got = timed_stream(spark, df, str(tmp_path), lambda s: st.reassemble_stream(s, ["frame_id", "roi_id"], 13, 39, 1500), 3)
    assert {r.frame_id: r.state for r in got} == {1: "complete", 2: "timeout", 3: "inconsistent_header"}
    assert bytes(next(r.payload for r in got if r.frame_id == 1)) == payload
