"""Headline queries at $BENCH_SF_DIR on local[$BENCH_CPUS]; prints one JSON line."""

from __future__ import annotations

import json
import os
import sys
import time

sys.path.insert(0, os.path.dirname(os.path.abspath(__file__)))

from boxtrail.plans.catalog import QUERIES  # noqa: E402
from boxtrail.session import build_session  # noqa: E402

HEADLINE = [
    "ag1_detection_metrics",
    "jn2_match_best",
    "jn3_match_greedy_iou",
    "jn4_match_center",
    "so1_nms",
    "jn7_fuse_boxes",
    "jn8_guarded_accept",
    "ag5_ap50",
    "ag6_confidence_sweep",
    "ag9_association_sweep",
    "ag11_track_features",
    "ag16_audit_labels",
    "ag22_percentiles",
    "ag28_hard_score",
    "pr15_decode_grid",
    "pr18_bright_round_gate",
    "wn3_rolling_mean",
    "wn5_segment_sequences",
    "wn6_bursts",
    "jn13_latest_result",
    "jn14_associate_events",
    "jn15_consensus",
    "so8_review_queue",
    "so12_grouped_split",
    "sc13_decode_records",
    "sc15_reassemble",
    "st1_track_lines",
    "st3_track_optimal",
    "st8_track_candidates",
    "st13_dual_roi_counts",
]


def main() -> None:
    sf = os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1")
    spark = build_session("bench", os.environ.get("BENCH_CPUS", "8"))
    spark.sparkContext.setLogLevel("ERROR")
    names = sys.argv[1:] or HEADLINE
    spark.range(1000).selectExpr("sum(id)").collect()  # start the executors before the clock does
    seconds = {}
    for name in names:
        start = time.perf_counter()
        QUERIES[name](spark, sf).write.format("noop").mode("overwrite").save()
        seconds[name] = round(time.perf_counter() - start, 3)
    total = round(sum(seconds.values()), 3)
    print(json.dumps({"metric": "headline_total", "value": total, "unit": "sec", "queries": seconds, "sf": os.path.basename(sf.rstrip("/"))}))


if __name__ == "__main__":
    main()
