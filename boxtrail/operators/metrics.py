"""Counts, precision/recall/F1, curves, sweeps and calibration."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F

from boxtrail.operators import ordered
from boxtrail.operators.grid import with_grid, with_row
from boxtrail.session import materialize


def ratio(num: Column, den: Column) -> Column:
    return F.when(den > 0, num / den).otherwise(0.0)


def prf(tp: Column, fp: Column, fn: Column) -> dict[str, Column]:
    p, r = ratio(tp, tp + fp), ratio(tp, tp + fn)
    return {"precision": p, "recall": r, "f1": ratio(2 * p * r, p + r)}


def match_counts(det: DataFrame, gt: DataFrame, matches: DataFrame, by: list[str]) -> DataFrame:
    """tp/fp/fn per ``by``. Three pre-aggregated counts are stacked, so no detail rows are joined again."""

    def count(df, name):
        return df.groupBy(*by).agg(F.count(F.lit(1)).alias(name))

    parts = count(det, "nd").unionByName(count(gt, "ng"), True).unionByName(count(matches, "tp"), True)
    zero = {c: F.coalesce(F.sum(c), F.lit(0)).alias(c) for c in ("nd", "ng", "tp")}
    total = parts.groupBy(*by).agg(*zero.values())
    return total.select(*by, "tp", (F.col("nd") - F.col("tp")).alias("fp"), (F.col("ng") - F.col("tp")).alias("fn"))


def with_total(counts: DataFrame, by: str = "class_id") -> DataFrame:
    """Class rows plus a total row (null class) through ``rollup`` over the already small counts."""
    return counts.rollup(by).agg(*[F.sum(c).alias(c) for c in ("tp", "fp", "fn")])


def detection_metrics(det: DataFrame, gt: DataFrame, matches: DataFrame) -> DataFrame:
    rows = with_total(match_counts(det, gt, matches, ["class_id"]))
    return rows.withColumns(prf(F.col("tp"), F.col("fp"), F.col("fn")))


def binary_counts(df: DataFrame, label: str, score: str, threshold: float, by: list[str] | None = None) -> DataFrame:
    hit, truth = F.col(score) >= threshold, F.col(label) == 1
    agg = {"tp": hit & truth, "fp": hit & ~truth, "tn": ~hit & ~truth, "fn": ~hit & truth}
    return df.groupBy(*(by or [])).agg(*[F.count_if(c).alias(n) for n, c in agg.items()])


def binary_metrics(df: DataFrame, label: str, score: str, threshold: float, by: list[str] | None = None) -> DataFrame:
    rows = binary_counts(df, label, score, threshold, by)
    tp, fp, tn, fn = (F.col(c) for c in ("tp", "fp", "tn", "fn"))
    extra = {
        "accuracy": ratio(tp + tn, tp + fp + tn + fn),
        "specificity": tn / F.greatest(tn + fp, F.lit(1)),
    }
    return rows.withColumns({**prf(tp, fp, fn), **extra})


def _score_totals(df: DataFrame, label: str, score: str) -> DataFrame:
    """Positives and negatives per distinct score with running sums from the top score down."""
    per = df.groupBy((-F.col(score)).alias("neg")).agg(
        F.count_if(F.col(label) == 1).alias("pos"), F.count_if(F.col(label) != 1).alias("negs")
    )
    return ordered.running(per, [], ["neg"], {"ctp": F.col("pos"), "cfp": F.col("negs")})


def roc_auc(df: DataFrame, label: str, score: str) -> DataFrame:
    """Area under the ROC: each positive beats the negatives below it and half of those tied with it."""
    s = _score_totals(df, label, score)
    p, n = F.sum("pos"), F.sum("negs")
    wins = F.sum(F.col("pos") * 1.0 * (F.col("negs") / 2.0)) + p * n - F.sum(F.col("pos") * 1.0 * F.col("cfp"))
    return s.agg((wins / (p * n)).alias("roc_auc"))


def average_precision(df: DataFrame, label: str, score: str) -> DataFrame:
    """Sum of precision times recall gained, one step per distinct score."""
    s = _score_totals(df, label, score)
    step = F.col("pos") * (F.col("ctp") / (F.col("ctp") + F.col("cfp")))
    return s.agg((F.sum(step) / F.sum("pos")).alias("average_precision"))


def pr_curve(det: DataFrame, gt: DataFrame, matches: DataFrame, by: str = "class_id") -> DataFrame:
    """Cumulative precision/recall per detection in confidence order (ties: image_id, det_idx)."""
    flags = det.select("image_id", by, "det_idx", "confidence").join(
        matches.select("image_id", by, "det_idx", F.lit(1).alias("hit")), ["image_id", by, "det_idx"], "left"
    )
    flags = flags.withColumns({"hit": F.coalesce("hit", F.lit(0)), "neg": -F.col("confidence")})
    # The join is written once; sizing, sampling and sorting then read the narrow result.
    cum = ordered.running(
        materialize(flags), [by], ["neg", "image_id", "det_idx"], {"ctp": F.col("hit"), "seen": F.lit(1).cast("long")}
    )
    totals = gt.groupBy(by).agg(F.count(F.lit(1)).alias("n_gt"))
    return cum.join(F.broadcast(totals), by).select(
        by,
        "image_id",
        "det_idx",
        "confidence",
        (F.col("ctp") / F.col("seen")).alias("precision"),
        (F.col("ctp") / F.col("n_gt")).alias("recall"),
    )


def average_precision_101(curve: DataFrame, gt: DataFrame, by: str = "class_id") -> DataFrame:
    """Mean over 101 recall points of the best precision at that recall or beyond, per class.

    Curve rows collapse to the best precision per recall step before meeting the 101 points.
    """
    step = curve.groupBy(by, F.floor(F.col("recall") * 100 + 1e-9).cast("int").alias("reached")).agg(
        F.max("precision").alias("best")
    )
    # At most 101 rows per class on each side of the join below.
    grid = gt.select(by).distinct().withColumn("point", F.explode(F.sequence(F.lit(0), F.lit(100))))
    near = grid.join(step, [by]).filter(F.col("reached") >= F.col("point"))
    best = near.groupBy(by, "point").agg(F.max("best").alias("best"))
    filled = grid.join(best, [by, "point"], "left")
    return filled.groupBy(by).agg(F.avg(F.coalesce("best", F.lit(0.0))).alias("ap"))


def confidence_sweep(det: DataFrame, gt: DataFrame, matches_of, thresholds: list[float], by="class_id") -> DataFrame:
    """tp/fp/fn per class and confidence threshold without repeating the data per threshold.

    Best-then-check at threshold t matches a truth when the most confident detection naming it reaches t, so one
    match run gives every threshold: count matches and detections in bins, then sum from the top.
    """
    edges = F.array(*[F.lit(float(t)) for t in thresholds])
    steps = [{"pos": i + 1, "threshold": float(t)} for i, t in enumerate(thresholds)]

    def bins(df, name):
        reached = F.size(F.filter(edges, lambda t: t <= F.col("confidence")))
        return df.groupBy(by, reached.alias("bin")).agg(F.count(F.lit(1)).alias(name))

    counts = bins(det, "nd").unionByName(bins(matches_of, "tp"), True)
    counts = counts.groupBy(by, "bin").agg(*[F.coalesce(F.sum(c), F.lit(0)).alias(c) for c in ("nd", "tp")])
    base = with_grid(gt.groupBy(by).agg(F.count(F.lit(1)).alias("ng")), steps).drop("grid_id")
    hit = base.join(counts, by, "left").filter((F.col("bin") >= F.col("pos")) | F.col("bin").isNull())
    summed = hit.groupBy(by, "threshold").agg(
        F.coalesce(F.sum("nd"), F.lit(0)).alias("nd"), F.coalesce(F.sum("tp"), F.lit(0)).alias("tp")
    )
    rows = base.join(summed, [by, "threshold"], "left").fillna(0, ["nd", "tp"])
    rows = rows.select(
        by, "threshold", "tp", (F.col("nd") - F.col("tp")).alias("fp"), (F.col("ng") - F.col("tp")).alias("fn")
    )
    return rows.withColumns(prf(F.col("tp"), F.col("fp"), F.col("fn")))


def binary_sweep(df: DataFrame, label: str, score: str, thresholds: list[float]) -> DataFrame:
    """Confusion counts at every threshold from one histogram of scores over the threshold bins."""
    edges = F.array(*[F.lit(float(t)) for t in thresholds])
    reached = F.size(F.filter(edges, lambda t: t <= F.col(score)))
    hist = df.groupBy(reached.alias("bin")).agg(
        F.count_if(F.col(label) == 1).alias("p"), F.count_if(F.col(label) != 1).alias("n")
    )
    joined = with_grid(hist, [{"pos": i + 1, "threshold": float(t)} for i, t in enumerate(thresholds)])
    above = F.col("bin") >= F.col("pos")
    rows = joined.groupBy("threshold").agg(
        F.coalesce(F.sum(F.when(above, F.col("p"))), F.lit(0)).alias("tp"),
        F.coalesce(F.sum(F.when(above, F.col("n"))), F.lit(0)).alias("fp"),
        F.coalesce(F.sum(F.when(~above, F.col("n"))), F.lit(0)).alias("tn"),
        F.coalesce(F.sum(F.when(~above, F.col("p"))), F.lit(0)).alias("fn"),
    )
    tp, fp, tn, fn = (F.col(c) for c in ("tp", "fp", "tn", "fn"))
    return rows.withColumns({**prf(tp, fp, fn), "specificity": tn / F.greatest(tn + fp, F.lit(1))})


def select_threshold(rows: DataFrame, policy: str, by: list[str] | None = None, floor: float = 0.9) -> DataFrame:
    """One row per ``by`` by policy.

    f1_high: F1, then the higher threshold. f1_precision: F1, then precision, then the higher threshold.
    recall_floor: F1 (then precision, specificity, threshold) among rows that reach the recall floor; when none
    does, F1 then recall then precision. shortfall: F1 + 0.08 recall - 0.5 missing recall, lowest threshold on ties.
    precision_floor: recall among rows that reach the precision floor, then F1.
    """
    by = by or []
    f1, p, r, t = (F.col(c) for c in ("f1", "precision", "recall", "threshold"))
    ok_r, ok_p = (r >= floor).cast("int"), (p >= floor).cast("int")
    if policy == "f1_high":
        key = F.struct(f1.alias("a"), t.alias("b"))
    elif policy == "f1_precision":
        key = F.struct(f1.alias("a"), p.alias("b"), t.alias("c"))
    elif policy == "recall_floor":
        spec = F.col("specificity") if "specificity" in rows.columns else F.lit(0.0)
        feasible = r >= floor
        key = F.struct(
            ok_r.alias("a"),
            f1.alias("b"),
            F.when(feasible, p).otherwise(r).alias("c"),
            F.when(feasible, spec).otherwise(p).alias("d"),
            F.when(feasible, t).otherwise(-t).alias("e"),
        )
    elif policy == "shortfall":
        gain = f1 + 0.08 * r - 0.5 * F.greatest(F.lit(0.0), floor - r)
        key = F.struct(gain.alias("a"), (-t).alias("b"))
    elif policy == "precision_floor":
        key = F.struct(ok_p.alias("a"), F.when(p >= floor, r).otherwise(f1).alias("b"), f1.alias("c"), t.alias("d"))
    else:
        raise ValueError(f"unknown policy {policy}")
    cols = [c for c in rows.columns if c not in by]
    best = rows.groupBy(*by).agg(F.max_by(F.struct(*cols), key).alias("_b"))
    return best.select(*by, "_b.*")


def combined_metrics(first: DataFrame, second: DataFrame) -> DataFrame:
    """Micro and macro F1 of every pair of class thresholds. Both inputs are sweep rows (one per threshold)."""
    a = first.select(*[F.col(c).alias(f"{c}_a") for c in ("threshold", "tp", "fp", "fn", "f1")])
    b = second.select(*[F.col(c).alias(f"{c}_b") for c in ("threshold", "tp", "fp", "fn", "f1")])
    # Sweep rows are as many as thresholds: the second list rides along as one array.
    other = b.agg(F.collect_list(F.struct(*b.columns)).alias("_b"))
    both = with_row(a, other).withColumn("_b", F.explode("_b")).select(*a.columns, "_b.*")
    tp, fp, fn = (F.col(f"{c}_a") + F.col(f"{c}_b") for c in ("tp", "fp", "fn"))
    return both.select(
        "threshold_a",
        "threshold_b",
        tp.alias("tp"),
        fp.alias("fp"),
        fn.alias("fn"),
        *[c.alias(n) for n, c in prf(tp, fp, fn).items()],
        ((F.col("f1_a") + F.col("f1_b")) / 2).alias("macro_f1"),
    )
