"""Streams in event time: sources share state keys, frames close while rows keep coming, a micro-batch is a whole piece."""

import pickle

import pandas as pd
import pytest
from pyspark.sql import functions as F
from pyspark.sql.types import DoubleType, IntegerType, LongType, StringType, StructField, StructType

from boxtrail.streaming import feed, kernels as k, stateful, streams as st, trackers as tr
from boxtrail.streaming.stateful import Clock

LINE = k.LineConfig(roi=(0, 0, 100, 100), minimum_hits=2, max_misses=3, max_center_distance=0.3, hysteresis=0.02)
COLUMNS = "source long, region string, frame_index long, det_idx long, class_id int, class_name string, confidence double, x1 double, y1 double, x2 double, y2 double"


def walk(source, frames, region="a", kind=0):
    """One box from left to right, across the line at 50 and on to the right, again and again."""
    return [(source, region, f, f, kind, "cell", 0.9, 30.0 + 8 * (f % 7), 40.0, 40.0 + 8 * (f % 7), 50.0) for f in frames]


def test_every_source_keeps_its_rows_beside_one_without_a_key(spark, monkeypatch):
    monkeypatch.setattr(feed, "FILE_ROWS", 20)
    rows = [r for s in range(8) for r in walk(s, range(s % 3, 35))] + walk(1000, range(21), "c", 1) + walk(None, range(14), "b")
    df = spark.createDataFrame(rows, COLUMNS)
    timed = df.withColumn("ts", st.frame_time("frame_index", 10.0, 946_684_800_000_000))
    lag = F.col("det_idx") % 3 * 100
    got, late = feed.run_counted(tr.track_lines(feed.as_stream(timed, "ts", 300, 4, lag), ["source", "region"], LINE, clock=Clock("ts", 100.0)))
    cols = ["source", "region", "frame_index", "track_id", "class_id", "hits", "center_x", "velocity_x"]
    want = tr.track_lines(df, ["source", "region"], LINE).filter("kind = 'event'")
    events = got.filter("kind = 'event'").select(*cols)
    found, expected = (sorted(map(str, t.select(*cols).collect())) for t in (events.dropna(subset=["source"]), want))
    assert found == expected and late == 0
    assert {r.source for r in want.select("source").distinct().collect()} == {*range(8), 1000}
    # The table form puts out nothing for a source without a key; the stream takes it as one more source.
    assert sorted((r.frame_index, r.track_id) for r in events.filter("source is null").collect()) == [(3, 1), (10, 2)]


@pytest.mark.parametrize("rows_a_file", [7, 10**6])
def test_a_batch_is_a_whole_piece(spark, monkeypatch, rows_a_file):
    monkeypatch.setattr(feed, "FILE_ROWS", rows_a_file, raising=False)
    # Nearly all rows arrive in the first and the last of four pieces, one in the third.
    at = [*range(40), 250, *range(360, 400)]
    df = spark.createDataFrame([(1, f) for f in at], "source long, frame_index long").withColumn("ts", st.frame_time("frame_index", 10.0))
    computed = spark.sparkContext.accumulator(0)

    def once(batches):
        for b in batches:
            computed.add(b.num_rows)
            yield b

    out = feed.run_to_end(st.latest_stream(feed.as_stream(df.mapInArrow(once, df.schema), "ts", 100, 4), "source", "frame_index"))
    assert sorted((r.frame_index, r.received) for r in out.collect()) == [(39, 40), (250, 41), (399, 81)]
    assert computed.value == len(at)


class State:
    def __init__(self):
        self.value, self.calls = None, 0

    def get(self):
        self.calls += 1
        return self.value

    def put(self, value):
        self.calls, self.value = self.calls + 1, value

    def clear(self):
        self.put([])

    update = put


class Handle:
    """What a processor asks Spark for, with a count of the calls."""

    def __init__(self):
        self.states, self.timers = {}, []

    def getValueState(self, name, schema):
        return self.states.setdefault(name, State())

    getListState = getValueState

    def registerTimer(self, at):
        self.timers.append(at)

    def deleteTimer(self, at):
        self.timers.remove(at)


class Watermark:
    def __init__(self, ms):
        self.ms = ms

    def getCurrentWatermarkInMs(self):
        return self.ms


def waiting(handle):
    return sum(len(pickle.loads(s[-1])) for s in handle.states["sources"].value if s[-1] is not None)


def test_frames_close_while_rows_keep_coming():
    kinds = {"long": LongType(), "int": IntegerType(), "string": StringType(), "double": DoubleType()}
    fields = [StructField(n, kinds[t]) for n, t in (c.split() for c in COLUMNS.split(", "))][2:]
    pending = StructType([*fields, StructField(stateful.TIME, LongType())])
    out = StructType([StructField(n, kinds.get(t, StringType())) for n, t in (c.split() for c in tr.LINE_OUT.split(", "))])
    processor = stateful.TimedKernelProcessor(["source", "region"], "frame_index", ["det_idx"], lambda at: k.LineTracker(LINE), out, pending, idle_ms=500, drain=False)
    handle = Handle()
    processor.init(handle)
    sources, found = 40, []
    for first in (0, 10, 20):
        rows = [(f'{{"source":{s},"region":"a"}}', *r[2:], r[2] * 100) for s in range(sources) for r in walk(s, range(first, first + 10))]
        part = pd.DataFrame(rows, columns=[stateful.SOURCE, *pending.names])
        before = sum(s.calls for s in handle.states.values())
        found.append(sum(map(len, processor.handleInputRows((5,), iter([part]), Watermark(first * 100 - 201)))))
        # A handful of calls a batch, whatever the number of sources, and no closed frame waits on.
        assert sum(s.calls for s in handle.states.values()) - before <= 4
        assert waiting(handle) == sources * min(first + 10, 12) and len(handle.timers) == 1
    assert found == [0, sources, 2 * sources]
    (at,) = handle.timers
    left = list(processor.handleExpiredTimer((5,), Watermark(10**6), None))
    assert at == 1800 and sum(map(len, left)) and waiting(handle) == 0
