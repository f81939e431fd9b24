import pytest
from pyspark.sql import functions as F

from boxtrail.functions import geometry as g, scores as s


def one(spark, **cols):
    return spark.range(1).select(*[c.alias(n) for n, c in cols.items()]).first().asDict()


def lits(*values):
    return g.Box(*(F.lit(float(v)) for v in values))


def test_iou_guards(spark):
    a, b, empty = lits(0, 0, 2, 2), lits(1, 0, 3, 2), lits(0, 0, 0, 0)
    r = one(spark, same=g.iou(a, a), part=g.iou(a, b), none=g.iou(empty, empty), floor=g.iou(empty, empty, "floor"), eps=g.iou(empty, empty, "epsilon"))
    assert r["same"] == 1 and r["part"] == pytest.approx(1 / 3)
    assert r["none"] == r["floor"] == r["eps"] == 0


def test_scaled_roi_is_half_even_and_checked(spark):
    cfg = dict(reference_width=1280.0, reference_height=800.0, x=611.0, y=419.0, width=154.0, height=115.0)
    roi = g.scaled_roi(F.lit(640.0), F.lit(400.0), cfg)
    assert list(one(spark, **roi._asdict()).values()) == [306, 210, 382, 267]
    bad = g.scaled_roi(F.lit(640.0), F.lit(400.0), {**cfg, "x": 1200.0})
    with pytest.raises(Exception, match="outside the frame"):
        one(spark, **bad._asdict())


@pytest.mark.parametrize("degrees,want", [(270, [130, 240, 170, 280]), (90, [130, 220, 170, 260]), (0, [120, 230, 160, 270])])
def test_rotation(spark, degrees, want):
    turned = g.unrotate(lits(0.2, 0.3, 0.6, 0.7), F.lit(degrees))
    assert list(one(spark, **g.region_to_frame(turned, lits(100, 200, 200, 300))._asdict()).values()) == want


def test_letterbox_inverse(spark):
    box, inside = g.unletterbox(lits(0, 48, 384, 336), lits(611, 419, 765, 534), 384.0, 288.0, 0.0, 48.0)
    r = one(spark, inside=inside, **box._asdict())
    assert r.pop("inside") and list(r.values()) == [611, 419, 765, 534]


def test_translate_drops_barely_visible(spark):
    rows = spark.createDataFrame([(0.30, 0.20), (0.05, 0.20)], "cx double, w double")
    got = rows.select(*[c.alias(n) for n, c in g.translate_label(F.col("cx"), F.col("w"), -0.2).items()]).collect()
    assert [r.keep for r in got] == [True, False]
    assert (got[0].cx, got[0].w) == (pytest.approx(0.10), pytest.approx(0.20))


def test_gate_reasons(spark):
    base = dict(bbox_width=6.0, bbox_height=6.0, pixel_area=24.0, circularity=0.8, solidity=0.9, extent=0.7, blackhat_mean=12.0,
                blackhat_max=30.0, blackhat_threshold=4.0, radial_distance_norm=0.3)
    dim = {**base, "blackhat_max": 15.0, "blackhat_mean": 6.5}
    long = {**base, "bbox_width": 12.0, "bbox_height": 3.0, "circularity": 0.2, "extent": 0.3}
    rows = spark.createDataFrame([base, dim, long]).select(*[c.alias(n) for n, c in s.bright_round_gate().items()]).collect()
    assert rows[0].gate_pass and rows[0].gate_reasons == []
    assert rows[1].gate_reasons == ["dim_peak", "dim_mean"]
    assert rows[2].gate_reasons == ["elongated", "not_circular", "diffuse"]
    assert 0 < rows[2].gate_score < rows[0].gate_score <= 1


def test_weak_labels(spark):
    rows = spark.createDataFrame(
        [(6, 0.9, 0.4, 20.0, 30.0), (1, 0.1, 0.4, 3.0, 4.0), (2, 0.5, 0.4, 9.0, 9.0)],
        "hits int, best_proposal_score double, radial_distance_norm_mean double, local_contrast_gray_mean double, pixel_area_mean double",
    ).withColumns({"video_slug": F.lit("v1"), "droplet_sequence": F.lit(3)})
    got = rows.withColumns(s.weak_labels(3, 0.6, 0.3)).collect()
    assert [r.weak_label for r in got] == [1, 0, -1]
    assert got[0].split_group == "v1_sequence_3" and got[2].weak_label_confidence == 0.0
    assert 0.7 <= got[0].weak_label_confidence <= 1.0
