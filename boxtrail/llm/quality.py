"""Quality rules: a hashed n-gram log-likelihood ratio between a trusted target and the raw corpus.

Unigrams and bigrams of all documents are hashed into buckets, as many as there are n-grams within fixed bounds. Two smoothed
multinomials, one over the trusted documents and one over all, give each n-gram the weight log(p_target / p_raw); a document's
score is the mean weight of its n-grams. The level of the scores moves with the corpus, so the threshold is learned: a trusted
document is scored without its own counts in the target, as if it were unlabelled, and the threshold parts these scores from
those of documents known to be poor. Nothing is drawn at random.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from boxtrail.llm.flat import Words, distinct_per_text, flat_texts, grams, mix, prefix_codes, slices, span_codes, words_of
from boxtrail.llm.passes import spare
from boxtrail.session import ship_package

BUCKETS, MAX_BUCKETS = 1 << 17, 1 << 20
THRESHOLD = -0.08
SCORE_STEPS = 4096  # steps per unit of score in which the threshold is searched
MARK = "__mark"
TRUSTED_BROADCAST_ROWS = 2_000_000
_SYMBOLS = np.zeros(256, dtype=bool)
_SYMBOLS[list(b"#*$%&|<>")] = True
_SOLID = np.ones(256, dtype=bool)
_SOLID[[9, 10, 11, 12, 13, 32]] = False


def gram_buckets(words: Words, buckets: int) -> tuple[np.ndarray, np.ndarray]:
    """(text number, bucket) of every unigram and bigram."""
    at, pairs = grams(words, 2)
    text = np.concatenate((words.text, words.text[at]))
    code = np.concatenate((mix(words.code ^ np.uint64(0x5BD1)), pairs))
    return text, (code % np.uint64(buckets)).astype(np.int64)


def base_counts(texts, words: Words) -> dict[str, np.ndarray]:
    """The plain counts of each text: words, their code points, symbols, repeated lines, words in repeated 3-word windows."""
    rows, data = texts.rows, texts.data
    out = {"n_words": words.counts(rows)}
    out["word_chars"] = texts.per_text(_SOLID[data] & ((data & 0xC0) != 0x80))
    out["n_symbols"] = texts.per_text(_SYMBOLS[data])

    breaks = np.flatnonzero(data == 10)
    start = np.sort(np.concatenate((texts.bounds[:-1], breaks + 1)), kind="stable")
    end = np.sort(np.concatenate((texts.bounds[1:], breaks)), kind="stable")
    line_text = np.sort(np.concatenate((np.arange(rows), np.searchsorted(texts.bounds, breaks, side="right") - 1)), kind="stable")
    solid = np.concatenate(([0], np.cumsum(_SOLID[data], dtype=np.int64)))
    real = solid[end] > solid[start]
    line_text, start, end = line_text[real], start[real], end[real]
    kept, _ = distinct_per_text(line_text, span_codes(prefix_codes(data), start, end))
    out["n_dup_lines"] = np.bincount(line_text, minlength=rows) - np.bincount(kept, minlength=rows)

    at, code = grams(words, 3)
    order = np.lexsort((code, words.text[at]))
    same = (code[order][1:] == code[order][:-1]) & (words.text[at][order][1:] == words.text[at][order][:-1])
    again = np.zeros(len(at), dtype=bool)
    again[order[1:][same]] = True
    again[order[:-1][same]] = True
    covered = np.zeros(len(words.text), dtype=bool)
    for k in range(3):
        covered[at[again] + k] = True
    out["n_repeat_words"] = np.bincount(words.text[covered], minlength=rows)
    return out


def marks_of(trusted_ids: DataFrame, poor_ids: DataFrame | None, key: str) -> DataFrame:
    """(key, mark) once per key that is not null: true for trusted, false for poor; a key in both is trusted."""
    ids = trusted_ids.select(trusted_ids[key].alias("__key"), F.lit(True).alias(MARK))
    if poor_ids is not None:
        ids = ids.unionByName(poor_ids.select(poor_ids[key].alias("__key"), F.lit(False).alias(MARK)))
    ids = ids.where("__key is not null").groupBy("__key").agg(F.max(MARK).alias(MARK))
    return F.broadcast(ids) if ids.count() <= TRUSTED_BROADCAST_ROWS else ids


def marked(documents: DataFrame, marks: DataFrame, key: str, how: str = "left") -> DataFrame:
    """The rows with all their columns and, last, their key's mark (null without one) under a name that is not taken."""
    own, mark = spare(documents, "__key"), spare(documents, MARK)
    named = marks.select(F.col("__key").alias(own), F.col(MARK).alias(mark))
    return documents.join(named, documents[key] == named[own], how).drop(own)


def gram_counts(rows: DataFrame, buckets: int) -> DataFrame:
    """(bucket, raw, trusted): n-gram counts over all (text, mark) rows and over the trusted; at most ``buckets`` rows."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        raw, good = np.zeros(buckets, np.int64), np.zeros(buckets, np.int64)
        for batch in batches:
            for part in slices(batch, "text"):
                texts = flat_texts(part.column("text"))
                doc, bucket = gram_buckets(words_of(texts), buckets)
                raw += np.bincount(bucket, minlength=buckets)
                mark = part.column(MARK).fill_null(False).to_numpy(zero_copy_only=False)
                good += np.bincount(bucket[mark[doc]], minlength=buckets)
        at = np.flatnonzero(raw)
        yield pa.RecordBatch.from_arrays([pa.array(at), pa.array(raw[at]), pa.array(good[at])], names=["bucket", "raw", "trusted"])

    return rows.mapInArrow(run, "bucket long, raw long, trusted long").groupBy("bucket").agg(F.sum("raw").alias("raw"), F.sum("trusted").alias("trusted"))


@dataclass
class GramModel:
    """Trusted counts, share of the raw corpus and weight log(p_target / p_raw) of each bucket.

    Both shares are smoothed by one count a bucket, spread in the target as the raw corpus is; weights are 0 without trusted text.
    """

    good: np.ndarray
    p_raw: np.ndarray
    weights: np.ndarray

    @classmethod
    def of(cls, raw: np.ndarray, good: np.ndarray) -> GramModel:
        size = len(raw)
        p_raw = (raw + 1) / (raw.sum() + size)
        weights = np.log((good + size * p_raw) / (good.sum() + size) / p_raw) if good.any() else np.zeros(size)
        return cls(good, p_raw, weights)

    def scores(self, doc: np.ndarray, bucket: np.ndarray, rows: int, trusted: np.ndarray | None = None) -> np.ndarray:
        """Mean weight of each text's n-grams. Texts set in ``trusted`` are scored by the target without their own counts."""
        n = np.bincount(doc, minlength=rows)
        out = np.bincount(doc, weights=self.weights[bucket], minlength=rows)
        if trusted is not None and trusted.any() and self.good.any():
            size = len(self.good)
            own = trusted[doc]
            code, count = np.unique(doc[own] * size + bucket[own], return_counts=True)
            text, at = code // size, code % size
            weight = np.log((self.good[at] - count + size * self.p_raw[at]) / (self.good.sum() - n[text] + size) / self.p_raw[at])
            out = np.where(trusted, np.bincount(text, weights=count * weight, minlength=rows), out)
        return out / np.maximum(1, n)


def gram_model(rows: DataFrame, buckets: int | None) -> GramModel:
    """Fitted to (text, mark) rows. Collects one row per bucket, at most ``MAX_BUCKETS`` whatever the corpus holds.

    Without ``buckets`` their number is the power of two from the number of n-grams on, from ``BUCKETS`` to ``MAX_BUCKETS``: buckets
    are remainders, so counts of a larger power fold to those of a smaller one.
    """
    most = buckets or MAX_BUCKETS
    found = gram_counts(rows, most).toArrow()
    at = found.column("bucket").to_numpy()
    raw, good = np.zeros(most), np.zeros(most)
    raw[at], good[at] = found.column("raw").to_numpy(), found.column("trusted").to_numpy()
    if buckets is None:
        size = min(most, max(BUCKETS, 1 << int(raw.sum()).bit_length()))
        raw, good = raw.reshape(-1, size).sum(0), good.reshape(-1, size).sum(0)
    return GramModel.of(raw, good)


NAMES = ["n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words"]


def judge(column: pa.Array, model: GramModel, threshold: float, trusted: np.ndarray | None = None) -> dict[str, np.ndarray]:
    """Base counts, ``base_failed``, ``score`` and ``kept`` of each text of a slice."""
    texts = flat_texts(column)
    words = words_of(texts)
    out = base_counts(texts, words)
    out["score"] = model.scores(*gram_buckets(words, len(model.weights)), texts.rows, trusted)
    out["base_failed"] = (out["n_words"] < 50) | (100 * out["n_repeat_words"] > 50 * out["n_words"])
    out["kept"] = ~out["base_failed"] & (out["score"] >= threshold)
    return out


def best_step(trusted: dict[int, int], poor: dict[int, int]) -> float:
    """The threshold with the largest share of trusted scores reaching it plus share of poor ones below, from counts per step.

    Of equal ones the lowest, moved to the middle of the empty steps below it. Without poor scores it is the lowest trusted one,
    without trusted scores nothing is below it.
    """
    if not trusted:
        return -np.inf
    n_trusted, n_poor = sum(trusted.values()), max(1, sum(poor.values()))
    steps = sorted(set(trusted) | set(poor))
    best, at, kept, below = -1, 0, n_trusted, 0
    for k, step in enumerate(steps):
        if step in trusted and kept * n_poor + below * n_trusted > best:
            best, at = kept * n_poor + below * n_trusted, k
        kept -= trusted.get(step, 0)
        below += poor.get(step, 0)
    low = steps[at - 1] + 1 if at else steps[at]
    return (low + steps[at]) // 2 / SCORE_STEPS


def learned_threshold(labelled: DataFrame, model: GramModel) -> float:
    """``best_step`` of all marked (text, mark) rows that pass the base rules, trusted ones scored without their own counts."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in slices(batch, "text"):
                mark = part.column(MARK).to_numpy(zero_copy_only=False).astype(bool)
                found = judge(part.column("text"), model, -np.inf, mark)
                step = np.floor(found["score"] * SCORE_STEPS).astype(np.int64)[found["kept"]]
                yield pa.RecordBatch.from_arrays([pa.array(mark[found["kept"]]), pa.array(step)], names=["mark", "step"])

    counts: dict[bool, dict[int, int]] = {True: {}, False: {}}
    for mark, step, n in labelled.mapInArrow(run, "mark boolean, step long").groupBy("mark", "step").count().collect():
        counts[mark][step] = n
    return best_step(counts[True], counts[False])


def fit(documents: DataFrame, marks: DataFrame, text: str, key: str, buckets: int | None, threshold: float | None) -> tuple[GramModel, float]:
    slim = documents.select(documents[key].alias("key"), documents[text].alias("text"))
    model = gram_model(marked(slim, marks, "key").select("text", MARK), buckets)
    if threshold is None:
        threshold = learned_threshold(marked(slim, marks, "key", "inner").select("text", MARK), model)
    return model, threshold


def held_out(part: pa.RecordBatch) -> np.ndarray:
    return part.column(part.num_columns - 1).fill_null(False).to_numpy(zero_copy_only=False)


def quality_rules(
    documents: DataFrame,
    trusted_ids: DataFrame,
    text: str = "text",
    key: str = "doc_id",
    buckets: int | None = None,
    threshold: float | None = THRESHOLD,
    poor_ids: DataFrame | None = None,
) -> DataFrame:
    """One row per document: key, base counts, ``base_failed``, ``score`` and ``kept``.

    ``trusted_ids`` names the trusted documents (column ``key``), ``poor_ids`` those known to be poor; nulls and repeats in them
    count once or not at all. With ``threshold`` None it is learned, and trusted documents are scored without their own counts;
    a number is compared with plain scores, whose level depends on the corpus.
    Null and empty texts have zero counts, score 0 and fail the base rule. Without trusted texts every score is 0.
    """
    ship_package(documents.sparkSession)
    marks = marks_of(trusted_ids, poor_ids, key)
    model, least = fit(documents, marks, text, key, buckets, threshold)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in slices(batch, "text"):
                found = judge(part.column("text"), model, least, held_out(part) if threshold is None else None)
                columns = [pa.array(found[n].astype(np.int64)) for n in NAMES] + [pa.array(found[n]) for n in ("base_failed", "score", "kept")]
                yield pa.RecordBatch.from_arrays([part.column("key"), *columns], names=["key", *NAMES, "base_failed", "score", "kept"])

    rows = documents.select(documents[key].alias("key"), documents[text].alias("text"))
    kind = rows.schema["key"].dataType.simpleString()
    schema = f"key {kind}, {', '.join(f'{n} long' for n in NAMES)}, base_failed boolean, score double, kept boolean"
    return marked(rows, marks, "key").select("key", "text", MARK).mapInArrow(run, schema).withColumnRenamed("key", key)


def keep_good(
    documents: DataFrame,
    trusted_ids: DataFrame,
    text: str = "text",
    key: str = "doc_id",
    buckets: int | None = None,
    threshold: float | None = THRESHOLD,
    poor_ids: DataFrame | None = None,
) -> DataFrame:
    """The rows that ``quality_rules`` keeps, with all their columns, whatever these are called."""
    ship_package(documents.sparkSession)
    marks = marks_of(trusted_ids, poor_ids, key)
    model, least = fit(documents, marks, text, key, buckets, threshold)
    at, width = documents.columns.index(text), len(documents.columns)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in slices(batch, at):
                found = judge(part.column(at), model, least, held_out(part) if threshold is None else None)
                yield part.filter(pa.array(found["kept"])).select(list(range(width)))

    return marked(documents, marks, key).mapInArrow(run, documents.schema)
