"""Lenient label lines are split and read once each."""

from boxtrail.sources import labels as lb


def test_lenient_lines_are_split_once(spark):
    lines = ["0 0.5 0.5 0.2 0.4", "  1\t0.25 0.5  0.1 0.2 ", "not a label", "0 0.5 0.5 0.2", "0 0.5 0.5 0.2 0.4 9", "1 a 0.5 0.1 0.1", "1 nan 0.5 0.1 0.1", "", None, "1.7 0.5 0.5 0.2 0.4"]
    rows = spark.createDataFrame([("f", i, v) for i, v in enumerate(lines)] + [("g", 0, lines[0])], "file string, line_no int, value string")
    sizes = spark.createDataFrame([("f", 100, 50)], "file string, width int, height int")
    out = lb.parse_labels_lenient(rows, sizes)
    assert out.columns == ["file", "line_no", "class_id", "x1", "y1", "x2", "y2"]
    got = [tuple(round(v, 6) if isinstance(v, float) else v for v in r) for r in out.collect()]
    assert sorted(got) == [("f", 0, 0, 40.0, 15.0, 60.0, 35.0), ("f", 1, 1, 20.0, 20.0, 30.0, 30.0), ("f", 9, 1, 40.0, 15.0, 60.0, 35.0)]
    assert out._jdf.queryExecution().optimizedPlan().toString().count("split(") == 1
