"""Null keys, null ends and null boxes give the same rows on the bounded and the distributed route."""

from boxtrail.operators.greedy import greedy_pairs
from boxtrail.operators.matching import nms


def same(df):
    return sorted(map(str, df.collect()))


def test_pairs_with_null_key_and_end(spark, request):
    edges = [(k, a, b, float((a or 0) * 3 % 7 + b)) for k in (None, 1) for a in (0, 1, 2, None) for b in (5, 6, 7)]
    df = spark.createDataFrame(edges, "g long, l long, r long, cost double")
    want = same(greedy_pairs(df, ["g"], "l", "r", ["cost", "l", "r"]))
    request.getfixturevalue("hot")
    assert same(greedy_pairs(df, ["g"], "l", "r", ["cost", "l", "r"])) == want and len(want) == 6


def test_suppression_with_null_box(spark, request):
    boxes = [("i", 0, n, 0.9 - n / 50, 0.05 * n if n != 4 else None, 0.1, 0.05 * n + 0.2, 0.4) for n in range(12)]
    df = spark.createDataFrame(boxes, "image_id string, class_id int, det_idx int, confidence double, x1 double, y1 double, x2 double, y2 double")
    want = same(nms(df).select("det_idx"))
    request.getfixturevalue("hot")
    assert same(nms(df).select("det_idx")) == want and "Row(det_idx=4)" in want
