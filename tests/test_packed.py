"""Boxes of ordinary images are packed and worked through in arrays: no shuffle beyond their own, the same rows as by rounds."""

import random

import pytest
from pyspark.sql import functions as F

from boxtrail.operators import calibration as cal, greedy, matching as m, skew

BOX = "x1 double, y1 double, x2 double, y2 double"


def boxes(seed, again):
    """Truth and detections with nulls in every column, images with one source only; the first rows ``again``."""
    rng = random.Random(seed)

    def some(value, share=0.03):
        return None if rng.random() < share else value

    truth, found = [], []
    for image in [*range(40), None]:
        for i in range(rng.randrange(0, 8)):
            x, y, w, h = rng.random(), rng.random(), 0.1 + rng.random() / 4, 0.1 + rng.random() / 4
            box, kind = [some(round(v, 2), 0.02) for v in (x, y, x + w, y + h)], some(rng.randrange(0, 3))
            odd = image is not None and image % 3 == 0
            if image is None or image % 7:
                truth.append((image, kind, some(rng.randrange(0, 8)) if odd else i, *box))
            for _ in range(rng.randrange(0, 3) if image is None or image % 11 else 0):
                moved = [None if v is None else round(v + rng.choice((-0.02, 0, 0.02)), 2) for v in box]
                found.append((image, kind if rng.random() < 0.9 else some(1), some(rng.randrange(0, 14)) if odd else len(found), some(round(0.5 + rng.random() / 2, 2)), *moved))
    return truth + truth[:again], found + found[:again]


def tables(spark, seed=11, again=0):
    truth, found = boxes(seed, again)
    return spark.createDataFrame(truth, f"image_id long, class_id int, gt_idx long, {BOX}"), spark.createDataFrame(found, f"image_id long, class_id int, det_idx long, confidence double, {BOX}")


def plain(df):
    return sorted(str(tuple(round(v, 9) if isinstance(v, float) else v for v in r)) for r in df.select(*sorted(df.columns)).collect())


def shuffles(df):
    """Shuffles that ran for the rows, without those that were used again."""
    df.collect()
    plan = df._jdf.queryExecution().executedPlan().toString().split("== Initial Plan ==")[0]
    return [line.lstrip(" :+-") for line in plan.splitlines() if line.lstrip(" :+-").startswith("Exchange ")]


def refine(truth, found):
    return m.refine_labels(truth, found, 0.5, 0.5, {0: 0.7, 1: 0.75}, 0.3)


@pytest.mark.parametrize("seed", [11, 12])
def test_refinement_is_the_same_by_arrays_and_by_rounds(spark, request, seed):
    packed = [plain(df) for df in refine(*tables(spark, seed))]
    request.getfixturevalue("hot")
    assert [plain(df) for df in refine(*tables(spark, seed))] == packed
    assert {"added", "kept", "matched"} <= {w for r in packed[0] for w in ("added", "kept", "matched") if w in r}


def test_refinement_of_ordinary_images_moves_nothing(spark, monkeypatch):
    truth, found = tables(spark, again=20)
    # Rows without an image go with the crowded ones.
    truth, found = (df.dropna(subset=["image_id"]).repartition(4, "image_id") for df in (truth, found))
    monkeypatch.setattr(greedy, "materialize", lambda df: pytest.fail("rows were written"))
    for df in refine(truth, found):
        assert len(shuffles(df)) == 2


def test_hot_keys_are_found_by_their_bucket(spark, monkeypatch):
    rows = [(k % 50, k) for k in range(100)] + [(7, k) for k in range(20)] + [(None, 1)]
    left = spark.createDataFrame(rows, "k long, v long")
    right = spark.createDataFrame([(3, k) for k in range(30)], "k long, v long")
    for buckets in (1, 3, 1 << 20):
        monkeypatch.setattr(skew, "COUNTED_BUCKETS", buckets)
        cold, hot = skew.packed_split([left, right], ["k"], 20)(left, right)
        assert {r.k for r in hot[0].collect()} == {3, 7, None} and hot[0].count() == 2 + 22 + 1 and hot[1].count() == 30
        assert cold[0].count() == len(rows) - 25 and cold[1].count() == 0
        assert skew.packed_split([left.filter("k != 7"), right], ["k"], 30)(left)[1] is None


@pytest.mark.parametrize("seed", [11, 14])
def test_sweeps_are_the_same_by_arrays_and_by_joins(spark, request, seed):
    truth, found = tables(spark, seed, again=20)
    # The cells of crowded images take whole boxes only.
    truth, found = truth.dropna(subset=list(m.g.Box._fields)), found.dropna(subset=list(m.g.Box._fields))
    keep = [F.col("confidence") > 0.6 + at / 1000 for at in range(70)] + [F.col("det_idx") % 2 == 0]
    made = [cal.filter_sweep(found, truth, keep), cal.smallest_expansion(found, 2.0), cal.association_sweep(found, truth)]
    packed = [plain(df) for df in made]
    request.getfixturevalue("hot")
    made = [cal.filter_sweep(found, truth, keep), cal.smallest_expansion(found, 2.0), cal.association_sweep(found, truth)]
    assert [plain(df) for df in made] == packed


def test_association_sweep_of_ordinary_images_moves_nothing(spark, monkeypatch):
    truth, found = tables(spark, again=20)
    lines = truth.withColumn("confidence", F.lit(0.95)).repartition(4, "image_id").filter("image_id is not null")
    found = lines.withColumnRenamed("gt_idx", "det_idx")
    written = []
    monkeypatch.setattr(cal, "materialize", lambda df: (written.append(df), df)[1])
    out = cal.association_sweep(found, lines.drop("confidence"))
    assert out.count() == len(cal.ASSOCIATION_GRID) and len(written) == 1
    # Beside the sources' own, here by number, there are two shuffles of a row a class and task.
    assert sum("REPARTITION_BY_NUM" not in line for line in shuffles(written[0])) == 2
    assert written[0].groupBy("class_id").count().where("class_id is not null").agg({"count": "max"}).first()[0] == len(cal.ASSOCIATION_GRID) + 1
