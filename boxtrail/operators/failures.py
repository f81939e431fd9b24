"""Failure analysis: best overlap per truth, per-image scores, categories, hard cases."""

from __future__ import annotations

from pyspark.sql import DataFrame, functions as F

from boxtrail.functions import geometry as g
from boxtrail.functions.scores import case_priority
from boxtrail.operators import matching as m
from boxtrail.operators.metrics import match_counts, prf


def best_iou_per_truth(det: DataFrame, gt: DataFrame, margin: float, keys: list[str] | None = None) -> DataFrame:
    """Best overlap of each truth box (0 when nothing overlaps) and whether it touches the frame edge."""
    keys = keys or m.IMAGE_CLASS
    best = m.touching(det, gt, keys).groupBy(*keys, "gt_idx").agg(F.max("iou").alias("best"))
    joined = gt.join(best, [*keys, "gt_idx"], "left")
    edge = g.touches_edge(g.box(), g.unit_frame(), margin)
    return joined.select(*keys, "gt_idx", F.coalesce("best", F.lit(0.0)).alias("best_iou"), edge.alias("edge"))


def missed_by_edge(best: DataFrame, threshold: float) -> DataFrame:
    missed = F.col("best_iou") < threshold
    return best.groupBy("class_id").agg(
        F.count(F.lit(1)).alias("truths"),
        F.count_if(missed).alias("missed"),
        F.count_if(missed & F.col("edge")).alias("missed_edge"),
        F.count_if(missed & ~F.col("edge")).alias("missed_interior"),
        F.avg("best_iou").alias("mean_best_iou"),
    )


def per_image_metrics(det: DataFrame, gt: DataFrame, matches: DataFrame) -> DataFrame:
    counts = match_counts(det, gt, matches, ["image_id"])
    ious = matches.groupBy("image_id").agg(F.avg("iou").alias("matched_mean_iou"))
    return counts.join(ious, "image_id", "left").withColumns(prf(F.col("tp"), F.col("fp"), F.col("fn")))


def failure_categories(det: DataFrame, gt: DataFrame) -> DataFrame:
    """Per image and class of the truth: clean at 0.5, clean only at 0.3, or a true error. Pairs are formed once."""
    pairs = m.pair(det, gt, 0.3)
    by = m.IMAGE_CLASS

    def errors(threshold, name):
        found = m.match_best(det, gt, threshold, pairs=pairs.filter(F.col("iou") >= threshold))
        rows = match_counts(det, gt, found, by)
        return rows.select(*by, (F.col("fp") + F.col("fn")).alias(name), (F.col("tp") + F.col("fn")).alias(f"n{name}"))

    both = errors(0.5, "e50").join(errors(0.3, "e30"), by).filter("ne50 > 0")
    category = (
        F.when(F.col("e50") == 0, "clean_iou50").when(F.col("e30") == 0, "localization_only").otherwise("true_detection_error")
    )
    return both.withColumn("category", category)


def hard_cases(per_image: DataFrame, count: int) -> DataFrame:
    """The ``count`` worst images by (F1, more errors, lower overlap), ranked. A top-k, never a full sort."""
    iou = F.coalesce("matched_mean_iou", F.lit(0.0))
    order = [F.round("f1", 9), -(F.col("fp") + F.col("fn")), F.round(iou, 9), F.col("image_id")]
    top = per_image.orderBy(*order).limit(count)
    # One array of ``count`` rows numbers the already limited list.
    packed = top.agg(
        F.array_sort(
            F.collect_list(F.struct(*[o.alias(f"o{i}") for i, o in enumerate(order)], F.struct(*per_image.columns).alias("v")))
        ).alias("a")
    )
    rows = packed.select(F.posexplode("a").alias("pos", "e")).select((F.col("pos") + 1).cast("long").alias("rank"), "e.v.*")
    return rows.withColumn("priority", case_priority(F.col("fp"), F.col("fn"), F.coalesce("matched_mean_iou", F.lit(0.0))))
