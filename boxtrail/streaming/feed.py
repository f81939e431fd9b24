"""Tables as event-time streams: files in order of arrival, and streams run to their end."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F

from boxtrail.session import keyed_state, scratch_path, settle

BEAT, ARRIVAL = "__beat", "__arrival"
# Rows of one file of a piece.
FILE_ROWS = 200_000


def as_stream(table: DataFrame, clock: str, delay_ms: int, pieces: int = 3, lag_ms: Column | None = None) -> DataFrame:
    """``table`` as a stream of ``pieces`` micro-batches with a watermark on ``clock``, a timestamp.

    A row arrives ``lag_ms`` (at most ``delay_ms``) after its event time, so the pieces are out of order as far as the
    watermark allows. The last piece ends with a heartbeat: a row without content whose time lets the watermark pass every
    frame and every state. It is dropped behind the watermark.

    ``table`` is computed once. Every piece has the same number of files, so that a micro-batch takes one piece.
    """
    spark = table.sparkSession
    arrival = F.unix_millis(clock) + (F.lit(0) if lag_ms is None else lag_ms)
    held = settle(table.withColumn(ARRIVAL, arrival), "arrivals")
    low, high, last, n = held.agg(F.min(ARRIVAL), F.max(ARRIVAL), F.max(clock), F.count(F.lit(1))).first()
    path = scratch_path(spark, "feed")
    rows = held.drop(ARRIVAL).withColumn(BEAT, F.lit(False))
    files = 1
    if last is not None:
        beat = spark.range(1).select((F.lit(last) + F.expr("INTERVAL 1 DAY")).alias(clock), F.lit(True).alias(BEAT))
        width = (high - low) // pieces + 1
        files = -(-n // (pieces * FILE_ROWS))
        for k in range(pieces):
            part = held.where(F.floor((F.col(ARRIVAL) - low) / width) == k).drop(ARRIVAL).withColumn(BEAT, F.lit(False))
            part = part.unionByName(beat, allowMissingColumns=True) if k == pieces - 1 else part
            at = f"{path}/p{k:03d}"
            (part.coalesce(1) if files == 1 else part.repartition(files)).write.parquet(at)
            # A small piece leaves files out; empty ones stand in for them.
            for _ in range(files - len(spark.read.schema(rows.schema).parquet(at).inputFiles()) if files > 1 else 0):
                rows.limit(0).coalesce(1).write.mode("append").parquet(at)
    else:
        rows.write.parquet(f"{path}/p000")
    feed = spark.readStream.schema(rows.schema).option("maxFilesPerTrigger", files).option("recursiveFileLookup", True).parquet(path)
    # A condition on the clock stays above the watermark; one on the mark alone would be pushed below it.
    timed = feed.withWatermark(clock, f"{delay_ms} milliseconds").where(F.when(~F.col(BEAT), F.col(clock)).isNotNull())
    return timed.drop(BEAT)


def run_counted(stream: DataFrame) -> tuple[DataFrame, int]:
    """All rows that the stream puts out until its input is used up, as a table, and the number of rows behind the watermark."""
    spark = stream.sparkSession
    path = scratch_path(spark, "stream")
    sink = stream.writeStream.format("parquet").option("checkpointLocation", f"{path}/checkpoint").option("path", f"{path}/rows")
    with keyed_state(spark):
        query = sink.outputMode("append").trigger(availableNow=True).start()
    query.awaitTermination()
    late = sum(op.numRowsDroppedByWatermark for progress in query.recentProgress for op in progress.stateOperators)
    return spark.read.schema(stream.schema).parquet(f"{path}/rows"), late


def run_to_end(stream: DataFrame) -> DataFrame:
    """The rows of ``run_counted`` alone."""
    return run_counted(stream)[0]
