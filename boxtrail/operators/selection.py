"""Choosing rows: spaced samples, diverse picks, review queues, balanced backgrounds."""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame, functions as F

from boxtrail.operators.greedy import greedy_keep
from boxtrail.operators.grid import with_row
from boxtrail.operators.ordered import indexed, top_k
from boxtrail.session import materialize


def spaced_indices(n: Column, count: Column | int, mode: str = "round") -> Column:
    """0-based indices of ``count`` evenly spaced rows of ``n`` (half-even or truncated), in order, without repeats."""
    count = F.lit(count) if isinstance(count, int) else count
    last = (n - 1).cast("double")
    step = last / F.greatest(count - 1, F.lit(1))
    cast = F.rint if mode == "round" else F.floor

    def at(i):
        return F.when(i == count - 1, n - 1).otherwise(cast(i * step).cast("long"))

    many = F.array_distinct(F.transform(F.sequence(F.lit(0).cast("long"), count.cast("long") - 1), at))
    one = F.array(F.floor(last / 2).cast("long") if mode == "round" else F.lit(0).cast("long"))
    return F.when(n <= 0, F.array().cast("array<long>")).when(count == 1, one).otherwise(many)


def evenly_spaced(df: DataFrame, keys: list[str], order: list[str], count: int, mode: str = "round") -> DataFrame:
    """``count`` evenly spaced rows of each key (or of the table) in order."""
    rows = indexed(df, keys, order, "_i")
    sizes = df.groupBy(*keys).agg(F.count(F.lit(1)).alias("_n"))
    want = sizes.select(*keys, F.explode(spaced_indices(F.col("_n"), count, mode)).alias("_w")).withColumn(
        "_i", F.col("_w") + 1
    )
    return rows.join(want, [*keys, "_i"]).drop("_i", "_w")


def every_nth_then_thin(df: DataFrame, keys: list[str], frame: str, every: int, most: int) -> DataFrame:
    """Every n-th frame, thinned to at most ``most`` evenly spaced ones (the middle one when a single is asked)."""
    base = df.filter(F.col(frame) % every == 0)
    if most <= 0:
        return base
    rows = indexed(base, keys, [frame], "_i")
    sizes = base.groupBy(*keys).agg(F.count(F.lit(1)).alias("_n"))
    n = F.col("_n")
    if most == 1:
        pick = F.array(F.floor(n / 2))
    else:
        i = F.sequence(F.lit(0), F.lit(most - 1))
        pick = F.array_distinct(F.transform(i, lambda k: F.rint(k * (n - 1) / (most - 1)).cast("long")))
    pick = F.when(n <= most, F.sequence(F.lit(0).cast("long"), n - 1)).otherwise(pick)
    want = sizes.select(*keys, F.explode(pick).alias("_w")).withColumn("_i", F.col("_w") + 1)
    return rows.join(want, [*keys, "_i"]).drop("_i", "_w")


def select_with_gap(
    df: DataFrame, keys: list[str], frame: str, score: str, count: int, gap: int, used: DataFrame | None = None
) -> DataFrame:
    """Best-scored frames (ties: earlier), each at least ``gap`` from every chosen or already used frame."""
    rows = df.select(*keys, F.col(frame).cast("long").alias(frame), (-F.col(score)).alias("_neg"), F.lit(False).alias("_used"))
    if used is not None:
        old = used.select(*keys, F.col(frame).cast("long").alias(frame), F.lit(0.0).alias("_neg"), F.lit(True).alias("_used"))
        rows = rows.unionByName(old)
    size = max(int(gap), 1)
    base = F.floor(F.col(frame) / size)
    cells = F.sequence(base, base + 1)

    def conflict(kept, row):
        return F.abs(kept(frame) - row(frame)) < gap

    kept = greedy_keep(rows, keys, ["_neg", frame], [frame], conflict, cells, seed="_used")
    new = kept.filter(~F.col("_used")).select(*keys, frame, (-F.col("_neg")).alias(score))
    # The first ``count`` of the greedy order are the ones a loop with an early stop would keep.
    return top_k(new, keys, [F.col(score).desc(), frame], count)


def fill_representative(
    df: DataFrame, keys: list[str], frame: str, used: DataFrame, count: int, total: int, gap: int
) -> DataFrame:
    """Frames nearest to evenly spaced targets that keep ``gap`` from all used ones, up to ``total`` per key.

    A used frame blocks at most 2*gap-1 frames, and fewer than ``total`` are ever used, so a target's nearest free frame is
    among a bounded number of frames on each side of it. One range join brings these together for all targets; a fold per
    key then takes the targets in order. The number of jobs does not depend on the targets.
    """
    frames = df.select(*keys, F.col(frame).cast("long").alias("_f")).dropna().distinct()
    ends = frames.groupBy(*keys).agg(F.min("_f").alias("_first"), F.max("_f").alias("_last"))
    held = used.groupBy(*keys).agg(F.collect_list(F.col(frame).cast("long")).alias("_used"))
    state = ends.join(held, keys, "left").withColumn("_used", F.coalesce("_used", F.array().cast("array<long>")))
    need = F.lit(total) - F.size("_used")
    step = (F.col("_last") - F.col("_first")) / F.greatest(need - 1, F.lit(1))
    targets = F.transform(F.sequence(F.lit(0), need - 1), lambda i: F.col("_first") + i * step)
    state = materialize(state.filter(need > 0).select(*keys, "_used", targets.alias("_targets")))
    # The place of each target among the key's frames: the last frame not after it.
    reach = (total - 1) * max(2 * int(gap) - 1, 0) + 1
    numbered = materialize(indexed(frames, keys, ["_f"], "_n"))
    places = numbered.join(state.select(*keys, "_targets"), keys).groupBy(*keys).agg(
        *[F.max(F.when(F.col("_f") <= F.get("_targets", F.lit(i)), F.col("_n"))).alias(f"_p{i}") for i in range(total)]
    )
    place = F.explode(F.array_compact(F.array(*[F.col(f"_p{i}") for i in range(total)])))
    blocks = F.explode(F.sequence(F.floor((F.col("_p") - reach + 1) / reach), F.floor((F.col("_p") + reach) / reach)))
    wanted = places.select(*keys, place.alias("_p")).select(*keys, blocks.alias("_b")).distinct()
    near = numbered.withColumn("_b", F.floor(F.col("_n") / reach)).join(wanted, [*keys, "_b"])
    choices = near.groupBy(*keys).agg(F.sort_array(F.collect_list("_f")).alias("_near"))

    def take(taken, target):
        free = F.filter("_near", lambda f: F.forall(taken, lambda u: F.abs(u - f) >= gap))
        nearest = F.array_min(F.transform(free, lambda f: F.struct(F.abs(f - target).alias("d"), f.alias("f"))))
        return F.concat(taken, F.array_compact(F.array(nearest["f"])))

    rows = state.join(choices, keys).withColumn("_all", F.aggregate("_targets", F.col("_used"), take))
    return rows.select(*keys, F.explode(F.slice("_all", F.size("_used") + 1, total)).alias(frame))


def diverse_records(
    df: DataFrame, video: str, sequence: str, frame: str, score: str, samples: int, cap: int
) -> DataFrame:
    """Per sequence the best and worst score, then evenly spaced rows, de-duplicated in that order; capped per video."""
    keys = [video, sequence]
    rows = indexed(df, keys, [frame], "_i").withColumn("_i", F.col("_i") - 1)
    stats = rows.groupBy(*keys).agg(
        F.count(F.lit(1)).alias("_n"),
        F.min_by("_i", F.struct(-F.col(score), "_i")).alias("_hi"),
        F.min_by("_i", F.struct(F.col(score), "_i")).alias("_lo"),
    )
    count = F.least(F.lit(samples).cast("long"), F.col("_n"))
    even = F.when(count == 1, F.array(F.lit(0).cast("long"))).otherwise(spaced_indices(F.col("_n"), count))
    order = F.concat(F.array("_hi", "_lo"), even)
    pick = F.slice(F.array_distinct(order), 1, count.cast("int"))
    want = stats.select(*keys, F.explode(pick).alias("_i"))
    chosen = rows.join(want, [*keys, "_i"]).drop("_i")
    return evenly_capped(chosen, [video], [frame, sequence], cap)


def evenly_capped(df: DataFrame, keys: list[str], order: list[str], cap: int) -> DataFrame:
    """All rows of a key that has at most ``cap``; otherwise ``cap`` evenly spaced ones."""
    rows = indexed(df, keys, order, "_i")
    sizes = df.groupBy(*keys).agg(F.count(F.lit(1)).alias("_n"))
    pick = F.when(F.col("_n") <= cap, F.sequence(F.lit(0).cast("long"), F.col("_n") - 1)).otherwise(
        spaced_indices(F.col("_n"), cap)
    )
    want = sizes.select(*keys, F.explode(pick).alias("_w")).withColumn("_i", F.col("_w") + 1)
    return rows.join(want, [*keys, "_i"]).drop("_i", "_w")


def audit_rows(frames: DataFrame, group: str, frame: str, count: int) -> DataFrame:
    """A quota of evenly spaced frames per group, topped up in frame order, cut to ``count`` (the audit's size)."""
    groups = frames.select(group).distinct().count()
    quota = max(1, math.ceil(count / max(groups, 1)))
    picked = _truncated_quota(frames, group, frame, quota)
    have = picked.count()
    if have < count:
        rest = frames.join(picked.select(group, frame), [group, frame], "left_anti")
        picked = picked.unionByName(rest.orderBy(frame, group).limit(count - have).select(*picked.columns))
    return picked.orderBy(frame, group).limit(count)


def _truncated_quota(frames: DataFrame, group: str, frame: str, quota: int) -> DataFrame:
    rows = indexed(frames, [group], [frame], "_i")
    sizes = frames.groupBy(group).agg(F.count(F.lit(1)).alias("_n"))
    pick = spaced_indices(F.col("_n"), F.least(F.lit(quota).cast("long"), F.col("_n")), "truncate")
    want = sizes.select(group, F.explode(pick).alias("_w")).withColumn("_i", F.col("_w") + 1)
    return rows.join(want, [group, "_i"]).drop("_i", "_w").select(*frames.columns)


def review_queue(df: DataFrame, cluster: str, key: str, priority: str, hits: str, count: int) -> DataFrame:
    """``count`` rows per cluster: half persistent, then transient, then the best of the rest; adds ``tier``.

    All three steps are top-k per cluster, so a cluster with most of the rows costs no more than a small one.
    """
    half = count // 2
    order = [F.col(priority).desc(), F.col(key)]
    slim = df.select(cluster, key, priority, hits)
    persistent = top_k(slim.filter(F.col(hits) >= 3), [cluster], order, half).withColumn("tier", F.lit(0))
    taken = persistent.groupBy(cluster).agg(F.count(F.lit(1)).alias("_p"))
    transient = top_k_ranked(slim.filter(F.col(hits) < 3), [cluster], order, count)
    transient = transient.join(taken, cluster, "left").filter(
        F.col("_k") <= count - F.coalesce("_p", F.lit(0))
    )
    first = materialize(persistent.unionByName(transient.drop("_k", "_p").withColumn("tier", F.lit(1))))
    have = first.groupBy(cluster).agg(F.count(F.lit(1)).alias("_h"))
    # At most count rows a cluster are ever marked, so the rest's best 2*count hold every row still needed.
    best = top_k(slim, [cluster], order, 2 * count).join(first.select(cluster, key), [cluster, key], "left_anti")
    more = top_k_ranked(best, [cluster], order, count).join(have, cluster, "left")
    more = more.filter(F.col("_k") <= count - F.coalesce("_h", F.lit(0))).drop("_k", "_h").withColumn("tier", F.lit(2))
    return first.unionByName(more)


def top_k_ranked(df: DataFrame, keys: list[str], order: list, k: int) -> DataFrame:
    from pyspark.sql import Window

    w = Window.partitionBy(*keys).orderBy(*order)
    return df.withColumn("_k", F.row_number().over(w)).filter(F.col("_k") <= k)


def representatives(df: DataFrame, cluster: str, key: str, axes: list[str], hits: str) -> DataFrame:
    """Rows with their distance to the cluster centroid and rank by (distance, more hits, key)."""
    mids = df.groupBy(cluster).agg(*[F.avg(a).alias(f"_m_{a}") for a in axes])
    joined = df.join(mids, cluster)
    square = sum(((F.col(a) - F.col(f"_m_{a}")) * (F.col(a) - F.col(f"_m_{a}")) for a in axes), F.lit(0.0))
    far = joined.withColumn("centroid_distance", F.sqrt(square)).drop(*[f"_m_{a}" for a in axes])
    return indexed(far, [cluster], ["centroid_distance", -F.col(hits), key], "rank")


def review_package(tracks: DataFrame, key: str, confirmed: str = "confirmed") -> DataFrame:
    """Tracks in review order with serial ids P0001.. (confirmed) and U0001.. (uncertain)."""
    rows = tracks.withColumn("suggested_label", F.when(F.col(confirmed), "likely_particle").otherwise("uncertain"))
    order = [-F.col("confidence"), -F.col("hits"), F.col(key)]
    numbered = indexed(rows, ["suggested_label"], order, "_n")
    prefix = F.when(F.col(confirmed), "P").otherwise("U")
    return numbered.withColumn("review_id", F.concat(prefix, F.format_string("%04d", "_n"))).drop("_n")


def seeded_order(seed: int, ident: Column) -> Column:
    """A reproducible shuffle key."""
    return F.md5(F.concat_ws(":", F.lit(str(seed)), ident.cast("string")))


def balance_background(df: DataFrame, ident: str, positive: str, ambiguous: str, ratio: float, seed: int) -> tuple[DataFrame, DataFrame]:
    """(kept rows, one row of counts): all positives, clean backgrounds up to a ratio by shuffle order, no ambiguous ones."""
    pos, amb = F.col(positive), F.col(ambiguous)
    kinds = df.withColumn("_kind", F.when(pos, "positive").when(amb, "ambiguous").otherwise("background"))
    limit = kinds.agg(F.rint(F.count_if(F.col("_kind") == "positive") * ratio).cast("long").alias("_max"))
    clean = kinds.filter("_kind = 'background'").withColumn("_h", seeded_order(seed, F.col(ident)))
    ranked = with_row(indexed(clean, [], ["_h", ident], "_n"), limit).filter(F.col("_n") <= F.col("_max"))
    kept = kinds.filter("_kind = 'positive'").drop("_kind").unionByName(ranked.drop("_kind", "_h", "_n", "_max"))
    counts = kinds.agg(
        F.count(F.lit(1)).alias("source_images"),
        F.count_if(F.col("_kind") == "positive").alias("positive_images"),
        F.count_if(F.col("_kind") == "background").alias("clean_background_candidates"),
        F.count_if(amb).alias("dropped_ambiguous_fragments"),
    )
    stats = with_row(counts, limit).withColumn(
        "selected_background_images", F.least(F.col("_max"), F.col("clean_background_candidates"))
    ).drop("_max")
    return kept, stats.withColumn("selected_images", F.col("positive_images") + F.col("selected_background_images"))
