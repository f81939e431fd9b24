"""Leakage-free splits: trial search over groups, chronological cuts, fixed maps, seeded profiles."""

from __future__ import annotations

import hashlib
import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window, functions as F

from boxtrail.operators.ordered import indexed
from boxtrail.session import materialize, settle, ship_package

SPLITS = ("train", "valid", "test")
# Groups whose totals fit into a task as a matrix, and its cells (trials x groups) that are worked on at a time.
MATRIX_GROUPS, MATRIX_CELLS = 100_000, 1 << 20
# Groups of a range of the hash, about; beyond ``MATRIX_GROUPS`` only the ranges that a cut divides are put in order.
BIN_GROUPS = 20_000
# Trials of one task at most.
TRIALS_A_TASK = 1_000


def group_totals(rows: DataFrame, group: str, measures: dict) -> DataFrame:
    """One row per group with the measures to balance; everything after this works on groups."""
    return rows.groupBy(group).agg(*[c.alias(n) for n, c in measures.items()])


def _marked(groups: DataFrame, group: str, trials: int, seed: int, keep: int | None = None) -> DataFrame:
    numbers = F.sequence(F.lit(0), F.lit(trials - 1)) if keep is None else F.array(F.lit(keep))
    rows = groups.withColumn("trial", F.explode(numbers))
    mark = F.md5(F.concat_ws(":", F.lit(str(seed)), F.col("trial").cast("string"), F.col(group).cast("string")))
    return rows.withColumn("_h", mark)


def _trial_orders(groups: DataFrame, group: str, trials: int, seed: int, keep: int | None = None) -> DataFrame:
    return indexed(_marked(groups, group, trials, seed, keep), ["trial"], ["_h", group], "_pos")


def _bin(n: int) -> Column:
    """First digits of the hash: ranges of the order with at most about ``BIN_GROUPS`` of ``n`` groups each."""
    return F.substring("_h", 1, max(2, math.ceil(math.log(max(n / BIN_GROUPS, 1), 16))))


def _binned(marked: DataFrame, group: str, measures: list[str], cuts: tuple[int, int], n: int) -> tuple[DataFrame, DataFrame]:
    """(bins, rows): the trials' orders cut at ``cuts`` without putting all groups in order.

    Groups are added up by trial and by the first digits of their hash, which is the order's first part: ``bins`` are those that
    lie in one split as a whole. Only the groups of the bins that a cut divides (at most two a trial) are put in order: ``rows``.
    """
    marked = marked.withColumn("_bin", _bin(n))
    found = materialize(marked.groupBy("trial", "_bin").agg(F.count(F.lit(1)).alias("_n"), *[F.sum(m).alias(m) for m in measures]))
    upto = found.withColumn("_pos", F.sum("_n").over(Window.partitionBy("trial").orderBy("_bin")))
    start = F.col("_pos") - F.col("_n")
    first, second = ((start < c) & (F.col("_pos") > c) for c in (cuts[0], cuts[0] + cuts[1]))
    divided = upto.filter(first | second).select("trial", "_bin", start.alias("_start"))
    inside = marked.join(F.broadcast(divided), ["trial", "_bin"])
    place = F.row_number().over(Window.partitionBy("trial", "_bin").orderBy("_h", group)) + F.col("_start")
    return _assign(upto.filter(~(first | second)), cuts), _assign(inside.withColumn("_pos", place), cuts)


def _assign(ordered: DataFrame, cuts: tuple[int, int]) -> DataFrame:
    split = (
        F.when(F.col("_pos") <= cuts[0], "train").when(F.col("_pos") <= cuts[0] + cuts[1], "valid").otherwise("test")
    )
    return ordered.withColumn("split", split)


def _scores(parts: DataFrame, totals: dict, measures: list[str], ratios, weights, required, kind) -> DataFrame:
    per = parts.groupBy("trial", "split").agg(*[F.sum(m).alias(m) for m in measures])
    ratio = F.create_map(*[F.lit(v) for kv in zip(SPLITS, ratios) for v in kv])[F.col("split")]
    err = F.lit(0.0)
    if kind == "squared":
        for m in measures:
            want = F.greatest(F.lit(float(totals[m])) * ratio, F.lit(1.0))
            off = (F.col(m) - F.lit(float(totals[m])) * ratio) / want
            err = err + weights.get(m, 1.0) * off * off
    else:
        size, hit = measures
        rate = totals[hit] / totals[size]
        err = F.abs(F.col(size) / float(totals[size]) - ratio) + 0.8 * F.abs(F.col(hit) / F.col(size) - rate)
    ok = F.lit(True)
    for m, mode in required.items():
        ok = ok & (F.col(m) > 0)
        if mode == "both":
            ok = ok & (F.col(m) < F.col(measures[0]))
    return per.withColumns({"_e": err, "_ok": ok}).groupBy("trial").agg(
        F.sum("_e").alias("score"), (F.bool_and("_ok") & (F.count(F.lit(1)) == 3)).alias("valid")
    )


def grouped_split(
    groups: DataFrame,
    group: str,
    measures: list[str],
    trials: int,
    seed: int,
    ratios: tuple[float, float, float] = (0.70, 0.15, 0.15),
    weights: dict[str, float] | None = None,
    required: dict[str, str] | None = None,
    kind: str = "squared",
    at_least_one: bool = False,
) -> DataFrame:
    """(group, split) of the best of ``trials`` seeded permutations of the groups.

    ``kind`` squared: weighted squared relative error of each measure. ``kind`` rate: measures are (size, positives);
    absolute size error plus 0.8 times the rate error. ``required`` measures must be present (``any``) or present
    with a rest (``both``) in every split. All trials are scored in one job, up to ``MATRIX_GROUPS`` groups from a matrix of
    their totals, beyond that from sums by ranges of the hash. Scores equal to twelve places tie, for the earlier trial.
    """
    one = groups.agg(F.count(F.lit(1)).alias("n"), *[F.sum(m).alias(m) for m in measures]).first()
    n, totals = one["n"], {m: one[m] for m in measures}
    if at_least_one:
        valid, test = max(1, round(n * ratios[1])), max(1, round(n * ratios[2]))
        train = n - valid - test
        if train <= 0:
            raise ValueError("not enough groups for the requested split")
    else:
        train, valid = round(n * ratios[0]), round(n * ratios[1])
    slim = groups.select(group, *measures)
    if n <= MATRIX_GROUPS:
        scored = _matrix_scores(slim, group, measures, trials, seed, (train, valid), totals, ratios, weights or {}, required or {}, kind)
    else:
        slim = settle(slim, "groups")
        bins, rows = _binned(_marked(slim, group, trials, seed), group, measures, (train, valid), n)
        parts = bins.select("trial", "split", *measures).unionByName(rows.select("trial", "split", *measures))
        scored = _scores(parts, totals, measures, ratios, weights or {}, required or {}, kind)
    best = scored.filter("valid").orderBy(F.round("score", 12), "trial").limit(1).collect()
    if not best:
        raise ValueError("no permutation puts every required class into every split")
    if n <= MATRIX_GROUPS:
        return _assign(_trial_orders(slim, group, trials, seed, best[0]["trial"]), (train, valid)).select(group, "split")
    marked = _marked(slim, group, trials, seed, best[0]["trial"])
    bins, rows = _binned(marked, group, [], (train, valid), n)
    whole = marked.withColumn("_bin", _bin(n)).join(F.broadcast(bins.select("_bin", "split")), "_bin")
    return whole.select(group, "split").unionByName(rows.select(group, "split"))


def trial_errors(sums: np.ndarray, sizes: np.ndarray, totals: list[int], ratios, weights: list[float], required: list[str | None], kind: str):
    """(score, valid) of trials from the sums of the measures: ``sums`` (trial, split, measure), ``sizes`` groups per split."""
    share = np.array(ratios)[None, :]
    if kind == "squared":
        score = np.zeros(len(sums))
        for m, (total, weight) in enumerate(zip(totals, weights, strict=True)):
            want = float(total) * share
            score += (weight * ((sums[:, :, m] - want) / np.maximum(want, 1.0)) ** 2).sum(1)
    else:
        size, hit = sums[:, :, 0], sums[:, :, 1]
        rate = hit / np.where(size > 0, size, np.nan)
        score = (np.abs(size / float(totals[0]) - share) + 0.8 * np.abs(rate - totals[1] / totals[0])).sum(1)
    valid = np.full(len(sums), bool((sizes > 0).all()))
    for m, mode in enumerate(required):
        if mode:
            valid &= (sums[:, :, m] > 0).all(1)
        if mode == "both":
            valid &= (sums[:, :, m] < sums[:, :, 0]).all(1)
    return np.where(np.isnan(score), np.inf, score), valid & ~np.isnan(score)


def _matrix_scores(slim: DataFrame, group: str, measures: list[str], trials: int, seed: int, cuts, totals, ratios, weights, required, kind) -> DataFrame:
    """(trial, score, valid) from a matrix of group totals: groups are its rows, trials its columns, and no row is made per both.

    Each task orders the groups by their hash for its own trials and adds up the totals left of every cut.
    """
    spark = slim.sparkSession
    ship_package(spark)
    rows = slim.orderBy(group).select(F.col(group).cast("string").alias("g"), *measures).collect()
    names = [[str(seed), r["g"]] for r in rows]
    values = np.array([[r[m] or 0 for m in measures] for r in rows], dtype=np.float64).reshape(len(rows), len(measures))
    edges = np.clip([0, cuts[0], cuts[0] + cuts[1], len(rows)], 0, len(rows))
    weight, need = [weights.get(m, 1.0) for m in measures], [required.get(m) for m in measures]
    total = [totals[m] for m in measures]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        step = max(1, MATRIX_CELLS // max(1, len(rows)))
        for batch in batches:
            ids = batch.column(0).to_numpy()
            for a in range(0, len(ids), step):
                part = ids[a : a + step]
                marks = (":".join(x for x in (s, str(t), g) if x is not None) for t in part for s, g in names)
                digest = np.frombuffer(b"".join(hashlib.md5(m.encode()).digest() for m in marks), dtype=">u8").reshape(len(part), len(rows), 2)
                sums = np.empty((len(part), 3, len(measures)))
                for k in range(len(part)):
                    order = np.lexsort((digest[k, :, 1], digest[k, :, 0]))
                    run_ = np.concatenate((np.zeros((1, len(measures))), np.cumsum(values[order], axis=0)))
                    sums[k] = run_[edges[1:]] - run_[edges[:-1]]
                score, valid = trial_errors(sums, np.diff(edges), total, ratios, weight, need, kind)
                yield pa.RecordBatch.from_arrays([pa.array(part), pa.array(score), pa.array(valid)], names=["trial", "score", "valid"])

    tasks = max(1, min(spark.sparkContext.defaultParallelism, -(-trials // 16)), -(-trials // TRIALS_A_TASK))
    return spark.range(0, trials, 1, tasks).mapInArrow(run, "trial long, score double, valid boolean")


def chronological_split(df: DataFrame, frame: str, ratios=(0.70, 0.15), clamp: bool = False) -> DataFrame:
    """(frame, split) over the distinct frames in order; cut points are half-even rounded.

    With ``clamp`` every split keeps at least one frame.
    """
    frames = df.select(frame).distinct()
    n = frames.count()
    train, valid = round(n * ratios[0]), round(n * ratios[1])
    if clamp:
        train = min(n - 2, max(1, train))
        valid = min(n - train - 1, max(1, valid))
    return _assign(indexed(frames, [], [frame], "_pos"), (train, valid)).select(frame, "split")


def mapped_split(df: DataFrame, key: str, mapping: dict[str, str]) -> DataFrame:
    """Fixed map from key to split; an unknown key raises."""
    table = F.create_map(*[F.lit(v) for kv in mapping.items() for v in kv])
    found = table[F.col(key)]
    bad = F.raise_error(F.concat(F.lit("no split for "), F.col(key))).cast("string")
    return df.withColumn("split", F.when(found.isNotNull(), found).otherwise(bad))


def assign_profiles(groups: DataFrame, key: list[str], counts: dict[str, int], seed: int) -> DataFrame:
    """Pair shuffled groups with a profile list of the given counts; the numbers must agree."""
    n = groups.count()
    if n != sum(counts.values()):
        raise ValueError(f"{n} groups but {sum(counts.values())} profiles")
    mark = F.md5(F.concat_ws(":", F.lit(str(seed)), *[F.col(k).cast("string") for k in key]))
    ordered = indexed(groups.withColumn("_h", mark), [], ["_h", *key], "_pos")
    label = None
    upto = 0
    for name, c in counts.items():
        upto += c
        label = F.when(F.col("_pos") <= upto, name) if label is None else label.when(F.col("_pos") <= upto, name)
    return ordered.withColumn("profile", label).drop("_h", "_pos")
