"""Small statistics used by several feature tables."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F


def histogram_entropy(df: DataFrame, keys: list[str], value: str, bins: int = 64, low=0.0, high=256.0) -> DataFrame:
    """Entropy in bits over equal bins; values collapse to bin counts before the second step."""
    width = (high - low) / bins
    index = F.least(F.floor((F.col(value) - low) / width), F.lit(bins - 1))
    counts = df.groupBy(*keys, index.alias("bin")).agg(F.count(F.lit(1)).alias("c"))
    total = F.sum("c")
    # -sum(p log2 p) = log2(n) - sum(c log2 c) / n
    return counts.groupBy(*keys).agg((F.log2(total) - F.sum(F.col("c") * F.log2("c")) / total).alias("entropy"))


def gray_patch_stats(df: DataFrame, keys: list[str], value: str, bins: int = 64) -> DataFrame:
    """Mean, deviation, median, p10, p90, contrast (p90 - p10) and entropy of the gray values of each key; nulls are outside the mask."""
    from boxtrail.operators.ordered import quantiles

    rows = df.where(F.col(value).isNotNull())
    plain = rows.groupBy(*keys).agg(F.avg(value).alias("mean"), F.stddev_pop(value).alias("std"))
    marks = quantiles(rows, keys, F.col(value).cast("double"), {"median": 0.5, "p10": 0.1, "p90": 0.9})
    out = plain.join(marks, keys).join(histogram_entropy(rows, keys, value, bins), keys)
    return out.withColumn("contrast", F.col("p90") - F.col("p10"))


def slug(text: Column) -> Column:
    """Lower-case letters and digits, every other character an underscore, none at the ends."""
    return F.regexp_replace(F.regexp_replace(F.lower(text), r"[^\p{L}\p{N}]", "_"), "^_+|_+$", "")


def arg_index(values: Column, best: Column) -> Column:
    """0-based index of the first element equal to ``best`` (array_max / array_min of the same array)."""
    return F.array_position(values, best) - 1
