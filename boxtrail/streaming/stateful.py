"""Run a kernel over a stream with transformWithStateInPandas."""

from __future__ import annotations

import json
import math
import pickle
from collections.abc import Callable, Iterator
from dataclasses import dataclass
from itertools import groupby

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle
from pyspark.sql.types import BinaryType, IntegralType, LongType, StringType, StructField, StructType

from boxtrail.session import ship_package


# Schemas are built here, on the driver: a worker has no context to parse DDL text with.
STATE = StructType([StructField("state", StringType())])
TIME = "event_ms"


class KernelProcessor(StatefulProcessor):
    """Feeds one source's rows to its kernel frame by frame.

    Rows of a micro-batch come in any order, and a frame may be cut by the batch boundary: the newest frame waits in
    list state until a newer one arrives. Rows older than the last finished frame are late and are not replayed.
    """

    def __init__(self, keys: list[str], frame: str, tie: list[str], make: Callable, names: list[str], pending: StructType):
        self.keys, self.frame, self.tie, self.make = keys, frame, tie, make
        self.names, self.pending, self.columns = names, pending, pending.names

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.saved = handle.getValueState("kernel", STATE)
        self.waiting = handle.getListState("waiting", self.pending)

    def handleInputRows(self, key, rows: Iterator[pd.DataFrame], timerValues) -> Iterator[pd.DataFrame]:
        kernel = self.make(dict(zip(self.keys, key)))
        if self.saved.exists():
            kernel.restore(json.loads(self.saved.get()[0]))
        items = [dict(zip(self.columns, r)) for r in self.waiting.get()] if self.waiting.exists() else []
        for pdf in rows:
            items += pdf[self.columns].to_dict("records")
        for r in items:
            r[self.frame] = int(r[self.frame])
            r.update(zip(self.keys, key))
        items = [r for r in items if kernel.last is None or r[self.frame] > kernel.last]
        items.sort(key=lambda r: (r[self.frame], *[r[t] for t in self.tie]))
        newest = items[-1][self.frame] if items else None
        keep = [r for r in items if r[self.frame] == newest]
        found, at = [], 0
        ready = items[: len(items) - len(keep)]
        while at < len(ready):
            end = at
            while end < len(ready) and ready[end][self.frame] == ready[at][self.frame]:
                end += 1
            found += kernel.advance(ready[at][self.frame], ready[at:end])
            at = end
        if keep:
            self.waiting.put([tuple(r[c] for c in self.columns) for r in keep])
        self.saved.update((json.dumps(kernel.state(), default=float),))
        if found:
            body = pd.DataFrame([[r.get(n) for n in self.names] for r in found], columns=self.names)
            for i, k in enumerate(self.keys):
                body.insert(i, k, key[i])
            yield body

    def close(self) -> None:
        pass


# Sources share a fixed number of state keys: a worker's round trips, timers and frames in Arrow are paid once a bucket and batch.
# Names do not begin with an underscore: a worker puts the rows of a key into tuples with these names.
BUCKETS = 1024
BUCKET, SOURCE = "bucket__", "source__"
# One row a source; ``due`` is when time alone has something to do for it. Its waiting rows are one value: typed rows of a state are
# turned over one by one on their way to the store and back.
SOURCES = StructType([StructField(SOURCE, StringType()), *STATE.fields, *(StructField(n, LongType()) for n in ("at", "late", "due")), StructField("rows", BinaryType())])
TIMER = StructType([StructField("timer", LongType())])


@dataclass(frozen=True)
class Clock:
    """Event time of a stream: its timestamp column (with a watermark) and the milliseconds between two frames."""

    column: str
    frame_ms: float


class _Source:
    """What one source of a bucket keeps; its kernel is only restored when a batch needs it."""

    def __init__(self, state: str | None = None, at: int | None = None, late: int = 0, due: int | None = None, rows: bytes | None = None):
        self.state, self.at, self.late, self.due, self.rows = state, at, late or 0, due, rows
        self.items: list[dict] = []
        self.kernel = None


def _plain(column: pd.Series, whole: bool) -> list:
    """Values of a column as they come out of a state: whole numbers stay whole beside nulls, which are None there."""
    if whole and column.dtype.kind not in "iub":
        return [None if v is None or v != v else int(v) for v in column.tolist()]
    if column.dtype.kind != "O":
        return column.tolist()
    return [None if v is None or (isinstance(v, float) and v != v) else v for v in column.tolist()]


class TimedKernelProcessor(KernelProcessor):
    """Feeds a source's frames to its kernel once the watermark has passed them.

    Rows wait in state until the watermark has passed their time, so rows of a frame may come in any order and in several
    micro-batches within the watermark's delay, and the newest frame needs no later one. A source is due at its oldest
    waiting frame or, without one, where everything that the kernel still keeps must have ended: it then puts out
    what is left and drops it. Rows that come after their frame was closed are counted in ``late_rows``; those behind the
    watermark are dropped and counted by Spark.

    The sources of a bucket are read and written together, once a batch, and one timer a bucket stands where its first source is
    due. All rows of a batch come before any timer, and rows at or behind its watermark cannot follow, so a bucket with rows closes
    its frames at once; the timer serves buckets without any. One bucket's sources and waiting rows are in memory.
    """

    def __init__(self, keys: list[str], frame: str, tie: list[str], make: Callable, out: StructType, pending: StructType, idle_ms: int, drain: bool):
        super().__init__(keys, frame, tie, make, out.names, pending)
        self.whole = {f.name for f in pending.fields if isinstance(f.dataType, IntegralType)}
        self.whole_out = {f.name for f in out.fields if isinstance(f.dataType, IntegralType)}
        self.idle_ms, self.drain = idle_ms, drain

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.saved = handle.getListState("sources", SOURCES)
        self.timer = handle.getValueState("timer", TIMER)

    def _load(self) -> tuple[int | None, dict[str, _Source]]:
        found = self.timer.get()
        if found is None:
            return None, {}
        return found[0], {name: _Source(*rest) for name, *rest in self.saved.get()}

    def _wake(self, name: str, source: _Source):
        """The source's kernel as it was."""
        if source.kernel is None:
            source.kernel = self.make(json.loads(name))
            if source.state is not None:
                source.kernel.restore(json.loads(source.state))
            if source.rows is not None:
                source.items = [dict(zip(self.columns, values)) for values in pickle.loads(source.rows)]
        return source.kernel

    def _store(self, timer: int | None, sources: dict[str, _Source], now: int) -> None:
        for s in sources.values():
            if s.kernel is None:
                continue
            s.state = json.dumps(s.kernel.state(), default=float)
            s.due = min((int(r[TIME]) for r in s.items), default=None)
            if s.due is None and s.at is not None and s.kernel.alive():
                s.due = s.at + self.idle_ms
            s.rows = pickle.dumps([tuple(r[c] for c in self.columns) for r in s.items], protocol=4) if s.items else None
        self.saved.put([(name, s.state, s.at, s.late, s.due, s.rows) for name, s in sources.items()])
        due = min((s.due for s in sources.values() if s.due is not None), default=None)
        # A timer at or before the watermark would be passed over.
        due = None if due is None else max(due, now + 1)
        self.timer.update((due,))
        if timer == due:
            return
        if timer is not None:
            self.handle.deleteTimer(timer)
        if due is not None:
            self.handle.registerTimer(due)

    def _close(self, name: str, s: _Source, now: int) -> list[dict]:
        """What the frames that the watermark has passed put out, and what ends by time after them."""
        kernel, at_keys = self._wake(name, s), json.loads(name)
        ready = sorted((r for r in s.items if int(r[TIME]) <= now), key=lambda r: (int(r[self.frame]), *[r[t] for t in self.tie]))
        found = []
        for frame, group in groupby(ready, key=lambda r: int(r[self.frame])):
            group = [{**r, self.frame: frame, **at_keys} for r in group]
            found += kernel.advance(frame, group)
            s.at = int(group[0][TIME])
        s.items = [r for r in s.items if int(r[TIME]) > now]
        if not s.items and s.at is not None and kernel.alive() and s.at + self.idle_ms <= now:
            found += kernel.expire()
            if self.drain:
                found += kernel.drain()
                kernel.tracks = {}
        return found

    def _closed(self, sources: dict[str, _Source], now: int) -> Iterator[pd.DataFrame]:
        """Closes every source with something due."""
        rows = []
        for name, s in sources.items():
            if s.kernel is not None or (s.due is not None and s.due <= now):
                rows += [(name, *[r.get(n) for n in self.names], s.late) for r in self._close(name, s, now)]
        if not rows:
            return iter(())
        body = pd.DataFrame(rows, columns=[SOURCE, *self.names, "late_rows"])
        for n in self.whole_out:
            if body[n].dtype.kind not in "iu":
                body[n] = pd.Series([None if v is None or v != v else int(v) for v in (r[1 + self.names.index(n)] for r in rows)], dtype=object)
        return iter([body])

    def handleInputRows(self, key, rows: Iterator[pd.DataFrame], timerValues) -> Iterator[pd.DataFrame]:
        now = timerValues.getCurrentWatermarkInMs()
        timer, sources = self._load()
        for pdf in rows:
            cells = zip(*[_plain(pdf[c], c in self.whole) for c in self.columns])
            for name, values in zip(pdf[SOURCE].tolist(), cells):
                s = sources.setdefault(name, _Source())
                r = dict(zip(self.columns, values))
                r[self.frame] = int(r[self.frame])
                last = self._wake(name, s).last
                if last is not None and r[self.frame] <= last:
                    s.late += 1
                else:
                    s.items.append(r)
        out = self._closed(sources, now)
        self._store(timer, sources, now)
        return out

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[pd.DataFrame]:
        now = timerValues.getCurrentWatermarkInMs()
        _, sources = self._load()
        out = self._closed(sources, now)
        self._store(None, sources, now)
        return out


def run_timed(df: DataFrame, keys: list[str], frame: str, tie: list[str], make, out: str, clock: Clock, longest: int, drain: bool = False) -> DataFrame:
    """Streaming twin of ``replay`` in event time: nothing is left open once the watermark has passed the last frame.

    ``df`` has a watermark on ``clock.column``; ``longest`` is the number of frames after which nothing of a frame is kept.
    One more column, ``late_rows``, counts the rows of the source that came too late so far.
    """
    ship_package(df.sparkSession)
    source = F.to_json(F.struct(*keys), {"ignoreNullFields": "false"})
    rows = df.withColumns({TIME: F.unix_millis(clock.column), SOURCE: source, BUCKET: F.pmod(F.hash(*keys), F.lit(BUCKETS))})
    own = (*keys, clock.column, SOURCE, BUCKET)
    pending = StructType([StructField(f.name, f.dataType) for f in rows.schema.fields if f.name not in own])
    key_ddl = ", ".join(f"`{k}` {df.schema[k].dataType.simpleString()}" for k in keys)
    processor = TimedKernelProcessor(
        keys, frame, tie, make, StructType.fromDDL(out), pending, idle_ms=math.ceil((longest + 1) * clock.frame_ms), drain=drain
    )
    found = rows.groupBy(BUCKET).transformWithStateInPandas(
        statefulProcessor=processor, outputStructType=f"{SOURCE} string, {out}, late_rows long", outputMode="Append", timeMode="EventTime"
    )
    return found.withColumn(SOURCE, F.from_json(SOURCE, key_ddl)).select(f"{SOURCE}.*", *StructType.fromDDL(out).names, "late_rows")


def run_stream(df: DataFrame, keys: list[str], frame: str, tie: list[str], make, out: str, mode: str = "None") -> DataFrame:
    """Streaming twin of ``replay``: same kernels, same output columns, state kept per key in the state store."""
    ship_package(df.sparkSession)
    columns = [c for c in df.columns if c not in keys]
    kinds = {c: df.schema[c].dataType.simpleString() for c in df.columns}
    pending = StructType([StructField(c, df.schema[c].dataType) for c in columns])
    key_ddl = ", ".join(f"`{k}` {kinds[k]}" for k in keys)
    processor = KernelProcessor(keys, frame, tie, make, StructType.fromDDL(out).names, pending)
    return df.groupBy(*keys).transformWithStateInPandas(
        statefulProcessor=processor, outputStructType=f"{key_ddl}, {out}", outputMode="Append", timeMode=mode
    )
