"""Streaming operators that need no tracker: sessions, counts, load shedding, gated scoring, fragment reassembly."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame, functions as F
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle
from pyspark.sql.types import BinaryType, BooleanType, IntegerType, LongType, StructField, StructType

from boxtrail.session import ship_package
from boxtrail.sources.records import LONG_RECORD, MAX_PAYLOAD, MAX_RECORDS


def frame_time(frame: str, fps: float, origin_us: int = 0) -> Column:
    """Event time of a frame, counted from ``origin_us`` (microseconds since 1970); monotone per source."""
    return F.timestamp_micros(F.lit(origin_us) + (F.col(frame) * (1e6 / fps)).cast("long"))


def burst_sessions(packets: DataFrame, keys: list[str], gap: str, delay: str = "1 minute") -> DataFrame:
    """Session windows over packet time; a pause of exactly the gap stays in the session."""
    source = packets.withWatermark("ts", delay) if packets.isStreaming else packets
    return source.groupBy(*keys, F.session_window("ts", gap).alias("w")).agg(
        F.min("ts").alias("start_ts"),
        F.max("ts").alias("end_ts"),
        F.sum("size").alias("bytes"),
        F.count(F.lit(1)).alias("packets"),
    ).drop("w")


def running_counts(events: DataFrame, by: list[str], width: str = "1 second", delay: str = "10 seconds") -> DataFrame:
    """Counts per class and tumbling window (throughput)."""
    source = events.withWatermark("ts", delay) if events.isStreaming else events
    return source.groupBy(F.window("ts", width).alias("w"), *by).agg(F.count(F.lit(1)).alias("n")).select(
        F.col("w.start").alias("window_start"), *by, "n"
    )


def latest_only(batch: DataFrame, source: str, frame: str) -> DataFrame:
    """Newest row per source and how many older ones it replaced; the body of a foreachBatch."""
    cols = [c for c in batch.columns if c != source]
    best = batch.groupBy(source).agg(
        F.max_by(F.struct(*cols), F.struct(frame, *[c for c in cols if c != frame])).alias("_b"), (F.count(F.lit(1)) - 1).alias("dropped")
    )
    return best.select(source, "_b.*", "dropped")


LAST = StructType([StructField("frame", LongType())])


class NewerThan(StatefulProcessor):
    """Per source: keep only the newest row of a micro-batch, and only when it is newer than the last one sent.

    A batch without such a row puts out its count alone (``sent`` false), so rows sent and rows dropped always add up to the
    rows received. ``received`` is their number so far, carried in state.
    """

    def __init__(self, source: str, frame: str, columns: list[str]):
        self.source, self.frame, self.columns = source, frame, columns

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.last = handle.getValueState("last", LAST)
        self.received = handle.getValueState("received", LAST)

    def handleInputRows(self, key, rows: Iterator[pd.DataFrame], timerValues) -> Iterator[pd.DataFrame]:
        best, seen = None, 0
        for pdf in rows:
            seen += len(pdf)
            top = pdf.loc[[pdf[self.frame].idxmax()]]
            if best is None or int(top[self.frame].iloc[0]) > int(best[self.frame].iloc[0]):
                best = top
        total = seen + (self.received.get()[0] if self.received.exists() else 0)
        self.received.update((total,))
        newest = int(best[self.frame].iloc[0])
        sent = not self.last.exists() or newest > self.last.get()[0]
        if sent:
            self.last.update((newest,))
        else:
            best = pd.DataFrame([[key[0] if c == self.source else None for c in self.columns]], columns=self.columns, dtype=object)
        yield best[self.columns].assign(dropped=seen - sent, received=total, sent=sent)

    def close(self) -> None:
        pass


def latest_stream(df: DataFrame, source: str, frame: str) -> DataFrame:
    """Load shedding on a stream: at most one row per source and micro-batch, never an old one, and the counts of all others."""
    ship_package(df.sparkSession)
    ddl = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in df.schema.fields)
    return df.groupBy(source).transformWithStateInPandas(
        statefulProcessor=NewerThan(source, frame, df.columns), outputStructType=f"{ddl}, dropped long, received long, sent boolean", outputMode="Append", timeMode="None"
    )


def next_after(sent: DataFrame, source: str, frame: str, seen: DataFrame) -> DataFrame:
    """For each source of ``seen`` (source, frame): the newest row sent that is newer than the frame seen there, if there is one."""
    asked = seen.select(source, F.col(frame).alias("_seen"))
    newer = sent.where("sent").join(asked, source).where(F.col(frame) > F.col("_seen")).drop("_seen")
    cols = [c for c in newer.columns if c != source]
    return newer.groupBy(source).agg(F.max_by(F.struct(*cols), frame).alias("_b")).select(source, "_b.*")


FRAGMENT = StructType(
    [
        StructField(n, t)
        for n, t in (
            ("total_bytes", IntegerType()), ("chunk_count", IntegerType()), ("record_count", IntegerType()),
            ("infer_us", IntegerType()), ("offset", IntegerType()), ("payload", BinaryType()),
        )
    ]
)
CHUNK_KEY = StructType([StructField("chunk_index", IntegerType())])
DONE = StructType([StructField("done", BooleanType())])


class Reassembler(StatefulProcessor):
    """Collects the fragments of one result. Complete and rejected results come out at once, the rest on a timer.

    A result has a bounded number of chunks, so its state is bounded; the timer also clears what a finished result
    left behind, and late fragments of it are ignored until then.
    """

    def __init__(self, keys: list[str], record_bytes: int, max_payload: int, timeout_ms: int):
        self.keys, self.record_bytes, self.max_payload, self.timeout_ms = keys, record_bytes, max_payload, timeout_ms

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.chunks = handle.getMapState("chunks", CHUNK_KEY, FRAGMENT)
        self.done = handle.getValueState("done", DONE)

    def _problem(self, chunk: int, f: tuple, first: tuple | None) -> str | None:
        total, count, records, _, offset, payload = f
        size = self.max_payload
        good = (
            total <= MAX_RECORDS * self.record_bytes
            and total == records * self.record_bytes
            and count == max(1, -(-total // size))
            and chunk < count
            and offset == chunk * size
            and len(payload) == min(size, total - offset)
        )
        if not good:
            return "invalid_geometry"
        if first is not None and first[:4] != f[:4]:
            return "inconsistent_header"
        if self.chunks.containsKey((chunk,)) and bytes(self.chunks.getValue((chunk,))[5]) != payload:
            return "conflicting_duplicate"
        return None

    def _row(self, key, state: str, f: tuple, payload: bytes | None) -> pd.DataFrame:
        values = [*key, state, f[2], f[3], payload]
        return pd.DataFrame([values], columns=[*self.keys, "state", "record_count", "infer_us", "payload"])

    def _finish(self, key, state: str, f: tuple, payload: bytes | None = None) -> pd.DataFrame:
        self.chunks.clear()
        self.done.update((True,))
        return self._row(key, state, f, payload)

    def handleInputRows(self, key, rows: Iterator[pd.DataFrame], timerValues) -> Iterator[pd.DataFrame]:
        if self.done.exists():
            return
        held = dict(self._held())
        if not held:
            self.handle.registerTimer(timerValues.getCurrentProcessingTimeInMs() + self.timeout_ms)
        names = FRAGMENT.names
        for pdf in rows:
            for r in pdf.to_dict("records"):
                chunk = int(r["chunk_index"])
                f = (*[int(r[n]) for n in names[:5]], bytes(r["payload"]))
                problem = self._problem(chunk, f, next(iter(held.values()), None))
                if problem:
                    yield self._finish(key, problem, f)
                    return
                held[chunk] = f
                self.chunks.updateValue((chunk,), f)
                if len(held) == f[1]:
                    yield self._finish(key, "complete", f, b"".join(held[i][5] for i in sorted(held)))
                    return

    def _held(self):
        for k, v in self.chunks.iterator():
            yield k[0], (*v[:5], bytes(v[5]))

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[pd.DataFrame]:
        held = dict(self._held())
        self.chunks.clear()
        self.done.clear()
        if held:
            yield self._row(key, "timeout", next(iter(held.values())), None)

    def close(self) -> None:
        pass


def reassemble_stream(
    packets: DataFrame, keys: list[str], record_bytes: int = LONG_RECORD, max_payload: int = MAX_PAYLOAD, timeout_ms: int = 1000
) -> DataFrame:
    """Streaming twin of ``sources.records.reassemble``."""
    ship_package(packets.sparkSession)
    ddl = ", ".join(f"`{k}` {packets.schema[k].dataType.simpleString()}" for k in keys)
    return packets.groupBy(*keys).transformWithStateInPandas(
        statefulProcessor=Reassembler(keys, record_bytes, max_payload, timeout_ms),
        outputStructType=f"{ddl}, state string, record_count int, infer_us int, payload binary",
        outputMode="Append",
        timeMode="ProcessingTime",
    )


def first_maturity(observations: DataFrame, keys: list[str], frame: str, hits: str, min_hits: int) -> DataFrame:
    """The observation at which each track first reaches ``min_hits``: the only row worth an expensive model."""
    mature = observations.filter(F.col(hits) >= min_hits)
    cols = [c for c in observations.columns if c not in keys]
    return mature.groupBy(*keys).agg(F.min_by(F.struct(*cols), F.struct(hits, frame)).alias("_b")).select(*keys, "_b.*")


def gated_score(
    observations: DataFrame, keys: list[str], frame: str, hits: str, min_hits: int, probability: Column, gate: float,
    confidence: float, policy: Callable[[Column, Column, int], Column] | None = None,
) -> DataFrame:
    """Score each mature track once; confirmed when the probability and the blended confidence pass.

    ``probability`` is any column over the row (an expression or a pandas UDF); ``policy`` replaces the blend.
    """
    from boxtrail.functions.scores import gated_confidence

    rows = first_maturity(observations, keys, frame, hits, min_hits).withColumn("probability", probability)
    blended = policy(F.col("probability"), F.col(hits), min_hits) if policy else gated_confidence(F.col("probability"), F.col(hits), min_hits)
    return rows.withColumns(
        {"confidence": blended, "confirmed": (F.col("probability") >= gate) & (blended >= confidence)}
    )
