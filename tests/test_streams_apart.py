"""Streams of points and of tagged events give the rows of their table form in a session started away from the package."""

import os
import subprocess
import sys

APART = """
import sys
sys.path.insert(0, sys.argv[1])
from pyspark.sql import functions as F
from boxtrail.session import build_session
from boxtrail.streaming import kernels as k, streams as st, trackers as tr
from boxtrail.streaming.feed import as_stream, run_to_end
from boxtrail.streaming.stateful import Clock

spark = build_session("apart", 2)
clock = Clock("ts", 100.0)
live = lambda df: as_stream(df.withColumn("ts", st.frame_time("frame_index", 10.0, 946_684_800_000_000)), "ts", 100)


def same(stream, table, cols):
    a, b = (sorted(map(tuple, df.select(*cols).collect()), key=str) for df in (run_to_end(stream), table))
    assert a == b and a, (a, b)


points = spark.createDataFrame(
    [(s, q, 4 * q + f, f, 10.0 * f + s, 5.0, 0.9) for s in (1, 2) for q in (0, 1) for f in range(4)],
    "source_id long, sequence_id long, frame_index long, det_idx long, x double, y double, score double",
)
keys, cfg = ["source_id", "sequence_id"], k.PointConfig(max_distance=14.0, max_missed=2)
for kind, cols in (("track", [*keys, "track_id", "x", "hits", "best_frame"]), ("observation", [*keys, "frame_index", "track_id", "x", "hits"])):
    same(*(tr.track_points(df, keys, cfg, **more).filter(F.col("kind") == kind) for df, more in ((live(points), {"clock": clock}), (points, {}))), cols)

events = spark.createDataFrame(
    [(s, 0, 10 * f + side, f + 6 * side, 50.0, 0.9, 2.0, side) for s in (1, 2) for f in range(5) for side in (0, 1)],
    "source_id long, class_id int, event_id long, frame_index long, center_y double, confidence double, velocity_x double, side int",
)
keys, pair = ["source_id", "class_id"], k.PairConfig(min_delay=1, max_delay=15, nominal=6.0, max_cross=14.0, line_distance=12.0)
cols = [*keys, "event_id", "upstream_id", "delay_frames", "verified"]
same(tr.associate_stream(live(events), keys, pair, clock=clock), tr.associate_stream(events, keys, pair), cols)
spark.stop()
print("all rows")
"""


def test_point_and_event_streams_away_from_the_package(tmp_path):
    root = os.path.dirname(os.path.dirname(os.path.abspath(__file__)))
    env = {name: v for name, v in os.environ.items() if name != "PYTHONPATH"}
    (tmp_path / "apart.py").write_text(APART)
    done = subprocess.run([sys.executable, "apart.py", root], cwd=tmp_path, env=env, capture_output=True, text=True, timeout=400)
    assert "all rows" in done.stdout, done.stderr[-2000:]
