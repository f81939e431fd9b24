"""Dataset checks: labels, leakage, duplicates, split joins, table differences."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F

from boxtrail.functions import geometry as g
from boxtrail.operators.grid import with_row
from boxtrail.operators.ordered import lagged
from boxtrail.operators.skew import split_pair


def safe_negatives(points: DataFrame, boxes: DataFrame, side: float, keys: list[str]) -> DataFrame:
    """Points far enough from every box of their group: outside 1.2 box sizes and square IoU at most 0.02."""
    w, h = F.col("b.x2") - F.col("b.x1"), F.col("b.y2") - F.col("b.y1")
    cx, cy = g.center(g.box("b"))
    near = (F.abs(F.col("p.x") - cx) / F.greatest(w, F.lit(1.0)) < 1.2) & (
        F.abs(F.col("p.y") - cy) / F.greatest(h, F.lit(1.0)) < 1.2
    )
    touching = g.square_iou(F.col("p.x"), F.col("p.y"), side, g.box("b")) > 0.02

    def anti(p, b, on):
        cond = [F.col(f"p.{k}") == F.col(f"b.{k}") for k in on] + [near | touching]
        return p.alias("p").join(b.alias("b"), cond, "left_anti")

    cold, hot = split_pair(points, boxes, keys)
    out = anti(*cold, keys)
    if hot is None:
        return out
    cell = side * 4

    def span(lo, hi):
        mid, size = (F.col(lo) + F.col(hi)) / 2, F.col(hi) - F.col(lo)
        reach = F.greatest(1.2 * F.greatest(size, F.lit(1.0)), size / 2 + side / 2)
        return F.explode(F.sequence(F.floor((mid - reach) / cell), F.floor((mid + reach) / cell)))

    p = hot[0].withColumns({"_bx": F.floor(F.col("x") / cell), "_by": F.floor(F.col("y") / cell)})
    b = hot[1].withColumn("_bx", span("x1", "x2")).withColumn("_by", span("y1", "y2"))
    return out.unionByName(anti(p, b, [*keys, "_bx", "_by"]).drop("_bx", "_by"))


def assert_unique(df: DataFrame, key: list[str], label: str) -> DataFrame:
    """``df`` unchanged; raises when a key repeats."""
    twice = df.groupBy(*key).count().filter("count > 1").take(1)
    if twice:
        raise ValueError(f"{label}: key {tuple(twice[0])[:-1]} is not unique")
    return df


def join_many_to_one(rows: DataFrame, side: DataFrame, key: list[str]) -> DataFrame:
    """Inner join whose right side must have unique keys."""
    return rows.join(assert_unique(side, key, "right side"), key)


def apply_split(rows: DataFrame, mapping: DataFrame, key: str, strict: bool = False) -> DataFrame:
    """Adds ``split`` from (key, split). Unmapped groups become ``not_used``, or raise when ``strict``.

    A group in two splits raises. The mapping has one row per group; Spark broadcasts it when it is small.
    """
    pairs = mapping.select(key, "split").distinct()
    clash = pairs.groupBy(key).count().filter("count > 1").take(1)
    if clash:
        raise ValueError(f"group {clash[0][0]} appears in more than one split")
    joined = rows.join(pairs, key, "left")
    if strict:
        missing = F.raise_error(F.concat(F.lit("no split for group "), F.col(key).cast("string"))).cast("string")
        return joined.withColumn("split", F.coalesce(F.col("split"), missing))
    return joined.withColumn("split", F.coalesce("split", F.lit("not_used")))


def verify_derived(source: DataFrame, derived: DataFrame, key: str) -> DataFrame:
    """Per source row: same shape, same label hash, and all variants different.

    source: key, width, height, label_text. derived: key, variant, width, height, label_text, content.
    """
    src = source.select(key, F.col("width").alias("sw"), F.col("height").alias("sh"), F.sha2("label_text", 256).alias("_h"))
    out = derived.join(src, key)
    same = (F.col("width") == F.col("sw")) & (F.col("height") == F.col("sh"))
    # Hash first, then one distinct count per source over short digests.
    rows = out.select(
        key, same.alias("shape"), (F.sha2("label_text", 256) == F.col("_h")).alias("label"), F.sha2("content", 256).alias("c")
    )
    return rows.groupBy(key).agg(
        F.count(F.lit(1)).alias("variants"),
        F.bool_and("shape").alias("same_shape"),
        F.bool_and("label").alias("same_labels"),
        (F.count(F.lit(1)) == F.count_distinct("c")).alias("all_distinct"),
    )


def audit_labels(labels: DataFrame, grids: list[tuple[int, int]], by: list[str]) -> DataFrame:
    """Boxes and same-class cell collisions per ``by`` and grid size (width, height).

    Boxes are first counted per (image, class, cell), so a crowded cell is one row in the sum.
    """
    sizes = F.explode(F.array(*[F.struct(F.lit(w).alias("gw"), F.lit(h).alias("gh")) for w, h in grids]))
    rows = labels.select("*", sizes.alias("_g")).select("*", "_g.gw", "_g.gh")
    cx = F.least(F.floor(F.col("cx") * F.col("gw")), F.col("gw") - 1)
    cy = F.least(F.floor(F.col("cy") * F.col("gh")), F.col("gh") - 1)
    cells = rows.groupBy(*by, "gw", "gh", "image_id", "class_id", cx.alias("gx"), cy.alias("gy")).agg(
        F.count(F.lit(1)).alias("n")
    )
    return cells.groupBy(*by, "gw", "gh").agg(F.sum("n").alias("boxes"), F.sum(F.col("n") - 1).alias("collisions"))


def label_totals(labels: DataFrame, by: list[str]) -> DataFrame:
    per_image = labels.groupBy(*by, "image_id").agg(
        F.count(F.lit(1)).alias("n"),
        F.count_if(F.col("class_id") == 0).alias("c0"),
        F.count_if(F.col("class_id") == 1).alias("c1"),
    )
    return per_image.groupBy(*by).agg(
        F.count(F.lit(1)).alias("images"),
        F.sum("n").alias("boxes"),
        F.sum("c0").alias("cell_boxes"),
        F.sum("c1").alias("droplet_boxes"),
    )


def leaked(manifest: DataFrame, key: str, split: str = "split") -> DataFrame:
    """Groups that appear in more than one split, with the splits."""
    pairs = manifest.select(key, split).distinct()
    sets = pairs.groupBy(key).agg(F.sort_array(F.collect_set(split)).alias("splits"))
    return sets.filter(F.size("splits") > 1)


def leakage_audit(manifest: DataFrame, group: str, video: str, profile: str, split: str = "split") -> DataFrame:
    """One row: counts of leaks and PASS or FAIL with the reasons."""
    g1 = leaked(manifest, group, split).agg(F.count(F.lit(1)).alias("group_leakage"))
    v1 = leaked(manifest, video, split).agg(F.count(F.lit(1)).alias("video_leakage"))
    synthetic = (F.col(split) != "train") & (F.col(profile) != "native")
    base = manifest.agg(F.count(F.lit(1)).alias("rows"), F.bool_or(synthetic).alias("synthetic_outside_train"))
    one = with_row(with_row(base, g1), v1)
    reasons = F.array_compact(
        F.array(
            F.when(F.col("group_leakage") > 0, F.concat(F.lit("group_leakage="), F.col("group_leakage"))),
            F.when(F.col("video_leakage") > 0, F.concat(F.lit("video_leakage="), F.col("video_leakage"))),
            F.when(F.col("synthetic_outside_train"), "synthetic_variant_outside_train"),
        )
    )
    return one.withColumns(
        {"failures": F.concat_ws("+", reasons), "status": F.when(F.size(reasons) == 0, "PASS").otherwise("FAIL")}
    )


def profile_stats(manifest: DataFrame, by: str, ratios: dict[str, tuple[str, str]]) -> DataFrame:
    aggs = [F.count(F.lit(1)).alias("images")]
    for name, (a, b) in ratios.items():
        r = F.col(a) / F.greatest(F.col(b), F.lit(1e-6))
        aggs += [F.avg(r).alias(f"mean_{name}"), F.min(r).alias(f"min_{name}"), F.max(r).alias(f"max_{name}")]
    return manifest.groupBy(by).agg(*aggs)


def exact_duplicates(df: DataFrame, content: str) -> DataFrame:
    """Rows minus distinct contents, from per-hash counts."""
    per = df.groupBy(F.sha2(content, 256).alias("h")).count()
    return per.agg(
        F.sum("count").alias("rows"),
        F.count(F.lit(1)).alias("distinct_contents"),
        (F.sum("count") - F.count(F.lit(1))).alias("duplicates"),
    )


def median_hash(vector: Column, first: int = 1) -> Column:
    """64 bits of a vector of 64 values: bit is value > median of the values from index ``first`` on (the constant term is
    skipped). A null vector has no hash, another length is an error."""
    length = F.raise_error(F.concat(F.lit("a hash needs 64 values, not "), F.size(vector).cast("string")))
    vector = F.when(vector.isNull() | (F.size(vector) == 64), vector).otherwise(length)
    values = F.transform(vector, lambda v: v.cast("double"))
    tail = F.array_sort(F.slice(values, first + 1, 64))
    n = F.size(tail)
    median = (tail[F.floor((n - 1) / 2).cast("int")] + tail[F.floor(n / 2).cast("int")]) / 2
    # The median travels in the accumulator, so it is computed once per vector and not once per bit.
    start = F.struct(F.lit(0).cast("long").alias("h"), median.alias("m"))

    def step(acc, v):
        return F.struct(F.shiftleft(acc["h"], 1).bitwiseOR((v > acc["m"]).cast("long")).alias("h"), acc["m"].alias("m"))

    return F.aggregate(values, start, step)["h"]


def near_duplicates(df: DataFrame, keys: list[str], order: str, hash_col: str, ident: str, limit: int = 2) -> DataFrame:
    """Neighbouring rows of a key whose hashes differ in at most ``limit`` bits."""
    rows = lagged(df, keys, [order], {"_ph": F.col(hash_col), "left_id": F.col(ident)})
    distance = F.bit_count(F.col(hash_col).bitwiseXOR(F.col("_ph")))
    return rows.withColumn("hamming", distance).filter(F.col("hamming") <= limit).select(
        *keys, "left_id", F.col(ident).alias("right_id"), "hamming"
    )


def group_stats(df: DataFrame, by: list[str], label: str, values: list[str]) -> DataFrame:
    """Counts per group with one column per label value."""
    return df.groupBy(*by).pivot(label, values).count().fillna(0, values)


def diff_tables(expected: DataFrame, actual: DataFrame, key: list[str]) -> DataFrame:
    """Rows that differ, with ``state`` missing, unexpected or changed."""
    values = [c for c in expected.columns if c not in key]
    e = expected.select(*key, F.struct(*values).alias("expected"))
    a = actual.select(*key, F.struct(*values).alias("actual"))
    j = e.join(a, key, "full_outer")
    state = (
        F.when(F.col("actual").isNull(), "missing")
        .when(F.col("expected").isNull(), "unexpected")
        .when(~F.col("expected").eqNullSafe(F.col("actual")), "changed")
    )
    return j.withColumn("state", state).filter("state is not null")


def merge_segments(first: DataFrame, second: DataFrame, key: str, expected: int, geometry: list[str]) -> DataFrame:
    """Two run segments as one table. The key must start at 0, never go back, cover 0..expected-1 and agree in geometry.

    The order check works on the segments' ranges: the second starts where the first ended or later.
    """
    both = first.withColumn("segment", F.lit(0)).unionByName(second.withColumn("segment", F.lit(1)))
    per = both.groupBy("segment").agg(F.min(key).alias("lo"), F.max(key).alias("hi"))
    shape = both.agg(
        F.min(key).alias("lo"), F.max(key).alias("hi"), F.count_distinct(key).alias("n"),
        F.count_distinct(*geometry).alias("shapes"),
    ).first()
    parts = {r["segment"]: r for r in per.collect()}
    if len(parts) != 2 or parts[1]["lo"] < parts[0]["hi"]:
        raise ValueError("segments overlap or are out of order")
    if (shape["lo"], shape["hi"], shape["n"]) != (0, expected - 1, expected):
        raise ValueError(f"frames {shape['lo']}..{shape['hi']} ({shape['n']}) are not 0..{expected - 1}")
    if shape["shapes"] > 1:
        raise ValueError("segments disagree in geometry")
    return both.drop("segment")


def grid_sample_score(df: DataFrame, keys: list[str], truth: str, score: str, thresholds: dict[int, float]) -> DataFrame:
    """Mean over classes of a sample's F1, which is 1 when truth and prediction are both empty."""
    limit = F.create_map(*[F.lit(v) for kv in thresholds.items() for v in (int(kv[0]), float(kv[1]))])
    hit, real = F.col(score) >= limit[F.col("class_id")], F.col(truth) == 1
    per = df.groupBy(*keys, "class_id").agg(
        F.count_if(hit & real).alias("tp"), F.count_if(hit & ~real).alias("fp"), F.count_if(~hit & real).alias("fn")
    )
    den = 2 * F.col("tp") + F.col("fp") + F.col("fn")
    f1 = F.when(den == 0, 1.0).otherwise(2 * F.col("tp") / den)
    return per.groupBy(*keys).agg(F.avg(f1).alias("sample_score"))
