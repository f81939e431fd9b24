"""Streams start on a state store that fits them, whatever the session is set to."""

import os
import subprocess
import sys

from pyspark.sql import functions as F

from boxtrail.session import STATE_STORE_CONF
from boxtrail.streaming import streams as st
from boxtrail.streaming.feed import as_stream, run_to_end

HDFS = "org.apache.spark.sql.execution.streaming.state.HDFSBackedStateStoreProvider"


def test_streams_run_on_a_session_with_the_default_state_store(spark):
    before = spark.conf.get(STATE_STORE_CONF)
    spark.conf.set(STATE_STORE_CONF, HDFS)
    try:
        df = spark.createDataFrame([(s, f) for s in (1, 2) for f in range(6)], "source long, frame_index long")
        rows = as_stream(df.withColumn("ts", st.frame_time("frame_index", 10.0)), "ts", 100)
        out = run_to_end(st.latest_stream(rows, "source", "frame_index"))
        last = out.groupBy("source").agg(F.max(F.when(F.col("sent"), F.col("frame_index"))), F.max("received"))
        assert sorted(map(tuple, last.collect())) == [(1, 5, 6), (2, 5, 6)]
        assert spark.conf.get(STATE_STORE_CONF) == HDFS
    finally:
        spark.conf.set(STATE_STORE_CONF, before)


APART = """
import sys
sys.path.insert(0, sys.argv[1])
from boxtrail.session import build_session
from boxtrail.streaming import streams as st
from boxtrail.streaming.feed import as_stream, run_to_end

spark = build_session("apart", 2)
spark.conf.set("spark.sql.shuffle.partitions", "200")
df = spark.createDataFrame([(s, f) for s in (1, 2) for f in range(6)], "source long, frame_index long")
rows = as_stream(df.withColumn("ts", st.frame_time("frame_index", 10.0)), "ts", 100)
out = run_to_end(st.latest_stream(rows, "source", "frame_index"))
assert out.agg({"received": "max"}).first()[0] == 6
assert spark.conf.get("spark.sql.shuffle.partitions") == "200"
spark.stop()
print("all rows")
"""


def test_streams_run_from_a_folder_without_the_package(tmp_path):
    root = os.path.dirname(os.path.dirname(os.path.abspath(__file__)))
    env = {k: v for k, v in os.environ.items() if k != "PYTHONPATH"}
    (tmp_path / "apart.py").write_text(APART)
    done = subprocess.run([sys.executable, "apart.py", root], cwd=tmp_path, env=env, capture_output=True, text=True, timeout=300)
    assert "all rows" in done.stdout, done.stderr[-2000:]
