"""Gates, composite scores, labels and categories as plain columns."""

from __future__ import annotations

from pyspark.sql import Column, functions as F

from boxtrail.functions.geometry import clamp, num

# Default limits of the bright-round gate.
GATE_LIMITS = {
    "min_blackhat_peak": 20.0,
    "min_blackhat_mean": 8.0,
    "min_peak_ratio": 2.5,
    "min_mean_ratio": 1.5,
    "min_area": 4.0,
    "max_area": 100.0,
    "min_axis_ratio": 0.55,
    "min_circularity": 0.42,
    "min_solidity": 0.55,
    "min_extent": 0.50,
    "max_radial_distance": 0.90,
}


def bright_round_gate(limits: dict | None = None) -> dict[str, Column]:
    """passed, score in 0..1 and the array of failed rules of a candidate row."""
    k = {**GATE_LIMITS, **(limits or {})}

    def field(name):
        return F.coalesce(F.col(name).cast("double"), F.lit(0.0))

    w, h = F.greatest(field("bbox_width"), F.lit(0.0)), F.greatest(field("bbox_height"), F.lit(0.0))
    axis = F.least(w, h) / F.greatest(w, h, F.lit(1.0))
    base = F.greatest(field("blackhat_threshold"), F.lit(1.0))
    peak, mean = field("blackhat_max"), field("blackhat_mean")
    area, circ = field("pixel_area"), field("circularity")
    solid, extent, radial = field("solidity"), field("extent"), field("radial_distance_norm")
    failed = F.array_compact(
        F.array(
            F.when(peak < k["min_blackhat_peak"], "dim_peak"),
            F.when(mean < k["min_blackhat_mean"], "dim_mean"),
            F.when(peak / base < k["min_peak_ratio"], "weak_peak_ratio"),
            F.when(mean / base < k["min_mean_ratio"], "weak_mean_ratio"),
            F.when(~area.between(k["min_area"], k["max_area"]), "area"),
            F.when(axis < k["min_axis_ratio"], "elongated"),
            F.when(circ < k["min_circularity"], "not_circular"),
            F.when(solid < k["min_solidity"], "not_solid"),
            F.when(extent < k["min_extent"], "diffuse"),
            F.when(radial > k["max_radial_distance"], "outside_core"),
        )
    )
    bright = (clamp((peak - 12) / 20) + clamp((mean - 5) / 9) + clamp((peak / base - 2) / 6)) / 3
    shape = (clamp(axis) + clamp(circ) + clamp(solid) + clamp(extent)) / 4
    return {
        "gate_pass": F.size(failed) == 0,
        "gate_score": clamp(0.58 * bright + 0.42 * shape),
        "gate_reasons": failed,
    }


def plausible(radial: Column, dark_blob: Column, motion: Column, motion_floor: float) -> Column:
    """Inside 0.92 of the radius and either a dark blob or strong motion."""
    return (radial <= 0.92) & (dark_blob | (motion >= motion_floor))


def image_status(fp: Column, fn: Column) -> Column:
    return (
        F.when((fp > 0) & (fn > 0), "mixed").when(fn > 0, "miss").when(fp > 0, "false_positive").otherwise("correct")
    )


def case_priority(fp: Column, fn: Column, matched_iou: Column) -> Column:
    return (
        F.when((matched_iou < 0.60) & (fp + fn > 0), "localization_and_label_review")
        .when(fn > fp, "missed_objects")
        .when(fp > fn, "false_or_duplicate_objects")
        .otherwise("balanced_error_review")
    )


def hard_reason(cells: Column, droplets: Column, uncertainty: Column) -> Column:
    reasons = F.array_compact(
        F.array(
            F.when(droplets < 2, "droplet_miss").when(droplets > 3, "droplet_extra"),
            F.when(cells >= 8, "many_cells"),
            F.when((droplets > 0) & (cells / droplets >= 3), "high_cell_ratio"),
            F.when(uncertainty >= 0.5, "near_threshold"),
        )
    )
    return F.when(F.size(reasons) == 0, "visual_outlier").otherwise(F.concat_ws("+", reasons))


def floor_ratio(a: Column, b: Column) -> Column:
    return a / F.greatest(b, F.lit(1.0))


def proposal_score(
    blackhat_mean, blackhat_threshold, temporal_mean, temporal_threshold, contrast, circularity, radial, has_previous
) -> Column:
    """Weighted sum of dark strength, motion, contrast, roundness and closeness to the center."""
    dark = clamp((blackhat_mean - blackhat_threshold) / F.greatest(blackhat_threshold, F.lit(1.0)))
    moving = F.when(has_previous, clamp(temporal_mean / F.greatest(temporal_threshold, F.lit(1.0)))).otherwise(0.0)
    prior = F.when(has_previous, 0.5).otherwise(0.25)
    return clamp(
        0.34 * dark
        + 0.22 * moving
        + 0.16 * clamp(contrast / 25)
        + 0.13 * clamp(circularity)
        + 0.10 * (1 - clamp(radial))
        + 0.05 * prior
    )


def review_priority(best_score, hits, persistence, anomaly_rank, distance_rank) -> Column:
    return (
        0.32 * clamp(best_score)
        + 0.25 * (clamp(hits, 0, 5) / 5)
        + 0.18 * clamp(persistence)
        + 0.15 * anomaly_rank
        + 0.10 * distance_rank
    )


def candidate_priority(dark_contrast, blackhat_peak, gradient, hits, max_score) -> dict[str, Column]:
    score = (
        2.2 * F.greatest(dark_contrast, F.lit(0.0))
        + 1.3 * blackhat_peak
        + 0.35 * gradient
        + 3.0 * F.least(hits, F.lit(5.0))
        + 4.0 * max_score
    )
    tier = F.when(score >= 55, "high").when(score >= 30, "medium").otherwise("low")
    return {"priority": score, "tier": tier}


def track_confidence(mean_score: Column, hits: Column, min_hits: int) -> Column:
    persistence = F.least(hits / max(min_hits + 1, 1), F.lit(1.0))
    return clamp(0.65 * mean_score + 0.35 * persistence)


def gated_confidence(probability: Column, hits: Column, min_hits: int) -> Column:
    persistence = F.least(hits / max(min_hits + 1, 1), F.lit(1.0))
    return clamp(0.80 * probability + 0.20 * persistence)


def weak_labels(min_hits: int, positive_score: float, negative_score: float) -> dict[str, Column]:
    """Label 1 / 0 / -1 with name, source, confidence and split group; a positive overrides a negative."""
    hits, score = F.col("hits"), F.col("best_proposal_score")
    yes = (hits >= min_hits) & (score >= positive_score) & (F.col("radial_distance_norm_mean") <= 0.90)
    no = (
        (hits == 1)
        & (score <= negative_score)
        & (F.col("local_contrast_gray_mean") <= 6.0)
        & (F.col("pixel_area_mean") <= 5.0)
    )
    sure = (
        0.70
        + 0.15 * clamp((hits - min_hits) / 5.0)
        + 0.15 * clamp((score - positive_score) / max(1.0 - positive_score, 1e-6))
    )
    empty = 0.75 + 0.25 * clamp((num(negative_score) - score) / max(negative_score, 1e-6))
    # The two rules do not exclude each other; confidence follows the rule applied last, which is the negative one.
    return {
        "weak_label": F.when(yes, 1).when(no, 0).otherwise(-1),
        "weak_label_name": F.when(yes, "particle").when(no, "background").otherwise("ambiguous"),
        "weak_label_source": F.lit("image_processing_teacher_v1"),
        "weak_label_confidence": F.when(no, empty).when(yes, sure).otherwise(0.0),
        "split_group": F.concat_ws("_sequence_", F.col("video_slug"), F.col("droplet_sequence").cast("int")),
    }
