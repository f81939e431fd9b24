"""Session settings and the shared working folder."""

from __future__ import annotations

import os
import shutil
import tempfile
import threading
import uuid
from collections.abc import Iterator
from contextlib import contextmanager

from pyspark.sql import SparkSession

# Rows of one key that a single task may fold (array in memory) or window (sorted, spillable).
FOLD_ROWS = "boxtrail.hot.foldRows"
WINDOW_ROWS = "boxtrail.hot.windowRows"
DEFAULTS = {FOLD_ROWS: "4096", WINDOW_ROWS: "200000"}

STATE_STORE_CONF = "spark.sql.streaming.stateStore.providerClass"
PARTITIONS_CONF = "spark.sql.shuffle.partitions"
STATE_STORE = "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"


def build_session(app: str = "boxtrail", cpus: str | int | None = None) -> SparkSession:
    """A session for local runs and tests; on a cluster spark-submit supplies its own."""
    cpus = str(cpus or os.environ.get("BENCH_CPUS", "*"))
    parts = str(os.cpu_count() if cpus == "*" else cpus)
    return (
        SparkSession.builder.master(f"local[{cpus}]")
        .appName(app)
        .config("spark.sql.shuffle.partitions", parts)
        .config("spark.sql.adaptive.enabled", "true")
        .config("spark.sql.session.timeZone", "UTC")
        .config("spark.sql.execution.arrow.pyspark.enabled", "true")
        .config(STATE_STORE_CONF, STATE_STORE)
        .config("spark.driver.memory", "8g")
        .config("spark.ui.enabled", "false")
        .getOrCreate()
    )


_STARTING = threading.Lock()


@contextmanager
def keyed_state(spark: SparkSession) -> Iterator[None]:
    """Streams started inside keep their state in RocksDB, the only store with several states and timers per key.

    Every micro-batch opens each state partition once, with a Python worker and a store of its own, so there are at most two
    a core. A stream takes the settings over when it starts; the session has its own values back afterwards.
    """
    with _STARTING:
        before = {name: spark.conf.get(name) for name in (STATE_STORE_CONF, PARTITIONS_CONF)}
        spark.conf.set(STATE_STORE_CONF, STATE_STORE)
        spark.conf.set(PARTITIONS_CONF, min(int(before[PARTITIONS_CONF]), 2 * spark.sparkContext.defaultParallelism))
        try:
            yield
        finally:
            for name, value in before.items():
                spark.conf.set(name, value)


_SHIPPED: set[str] = set()


def ship_package(spark: SparkSession) -> None:
    """Give Python workers this package, once per application (``--py-files`` does the same from outside)."""
    context = spark.sparkContext
    if context.applicationId in _SHIPPED:
        return
    root = os.path.dirname(os.path.abspath(__file__))
    # A stream's processor is also loaded by a Python worker on the driver, which does not look into shipped files.
    paths = [os.path.dirname(root), *filter(None, [context.environment.get("PYTHONPATH")])]
    context.environment["PYTHONPATH"] = os.pathsep.join(paths)
    base = os.path.join(tempfile.mkdtemp(prefix="boxtrail-pkg-"), "boxtrail_package")
    # The archive is read by the driver only; Spark's file server copies it to every executor.
    context.addPyFile(shutil.make_archive(base, "zip", os.path.dirname(root), os.path.basename(root)))
    _SHIPPED.add(context.applicationId)


def setting(spark: SparkSession, name: str) -> int:
    return int(spark.conf.get(name, DEFAULTS[name]))


def shared_dir(spark: SparkSession) -> str:
    """The folder every executor can reach, taken from ``spark.checkpoint.dir``.

    Only a local master, where driver and executors share one disk, falls back to a new temp folder.
    """
    configured = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getCheckpointDir()
    if configured is None:
        if not spark.sparkContext.master.startswith("local"):
            raise RuntimeError("set spark.checkpoint.dir to a folder shared by all executors")
        configured = tempfile.mkdtemp(prefix="boxtrail-")
    if spark.sparkContext.getCheckpointDir() is None:
        spark.sparkContext.setCheckpointDir(configured)
    return configured


def scratch_path(spark: SparkSession, label: str) -> str:
    """A path for one written table in the shared folder; never reused."""
    return os.path.join(shared_dir(spark), "boxtrail", f"{label}-{uuid.uuid4().hex}")


def materialize(df):
    """Cut lineage with a reliable checkpoint, so a lost executor never restarts the loop."""
    shared_dir(df.sparkSession)
    return df.checkpoint(eager=True)


def settle(df, label: str):
    """Write ``df`` to the shared folder as Parquet and read it back, for a wide table that several jobs read."""
    path = scratch_path(df.sparkSession, label)
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)
