"""Steps that must not put every row in order, write it or prepare it more often than needed."""

import random

import pytest
from pyspark.ml.feature import Imputer
from pyspark.sql import functions as F

from boxtrail.llm import brown
from boxtrail.operators import learning as ml, splits


@pytest.mark.parametrize("bin_groups", [20_000, 1])
def test_large_split_search_orders_only_divided_ranges(spark, monkeypatch, bin_groups):
    rng = random.Random(3)
    rows = [(k, rng.randrange(1, 9)) for k in range(700)] + [(None, 4)]
    groups = spark.createDataFrame([(g, n, rng.randrange(0, n + 1)) for g, n in rows], "g long, total long, hit long")
    args = (groups, "g", ["total", "hit"], 6, 11, (0.6, 0.2, 0.2))
    want = sorted(map(str, splits.grouped_split(*args, required={"hit": "both"}, kind="rate").collect()))
    monkeypatch.setattr(splits, "MATRIX_GROUPS", 0)
    monkeypatch.setattr(splits, "BIN_GROUPS", bin_groups, raising=False)
    monkeypatch.setattr(splits, "indexed", lambda *a, **k: pytest.fail("all groups were put in order"))
    got = splits.grouped_split(*args, required={"hit": "both"}, kind="rate")
    assert sorted(map(str, got.collect())) == want and len(want) == 701


def test_model_search_fills_missing_values_once(spark, monkeypatch):
    rng = random.Random(5)
    rows = [(float(k % 7), rng.random() if k % 9 else None, k % 7 > 3) for k in range(120)]
    df = spark.createDataFrame(rows, "a double, b double, y boolean").withColumn("y", F.col("y").cast("int"))
    fits, fit = [], Imputer._fit
    monkeypatch.setattr(Imputer, "_fit", lambda self, d: fits.append(1) or fit(self, d))
    grid = {k: v[:1] for k, v in ml.model_grid(120.0, trees=3).items()}
    found, model = ml.model_search(df, df, df, ["a", "b"], "y", grid=grid)
    assert len(fits) == 1 and found.count() == 3
    assert ml.score(df, model).filter(F.col("probability_1").between(0, 1)).count() == 120


def test_numbered_blocks_hold_no_hashes(spark):
    docs = spark.createDataFrame([(k, f"a b c{k} d") for k in range(40)], "doc_id long, text string")
    blocks = brown.keep(brown.to_blocks(docs, "text", "doc_id"), "blocks")
    counts = brown.keep(brown.word_counts(blocks, 8), "counts")
    assert "vocab" not in brown.number_words(blocks, counts, 8).columns
    # Documents are scored from places alone: every training word is known, a word of held-out texts only is not.
    rows = {r.doc_id: r for r in brown.brown_scores(docs).collect()}
    assert {r.n_tokens for r in rows.values()} == {5}
    assert all(r.n_known == (4 if r.held_out else 5) for r in rows.values()) and any(r.held_out for r in rows.values())
