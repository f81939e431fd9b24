"""Single-row joins, fixed-length hashes and the settings of the model search."""

import pytest
from pyspark.sql import functions as F

from boxtrail.operators import datasets as ds, learning as ml
from boxtrail.operators.grid import with_row


def test_one_row_is_added_to_every_row(spark):
    total = spark.range(5).agg(F.sum("id").alias("s"), F.max("id").alias("m"))
    assert [tuple(r) for r in with_row(spark.range(3), total).orderBy("id").collect()] == [(0, 10, 4), (1, 10, 4), (2, 10, 4)]


def test_null_values_and_no_row(spark):
    none = spark.range(0).agg(F.sum("id").alias("s"))
    assert [tuple(r) for r in with_row(spark.range(1), none).collect()] == [(0, None)]
    assert with_row(spark.range(3), spark.range(0).select(F.col("id").alias("k"))).count() == 0


def test_a_second_row_is_an_error(spark):
    with pytest.raises(Exception, match="one row"):
        with_row(spark.range(3), spark.range(2).select(F.col("id").alias("k"))).collect()


def test_hash_needs_64_values(spark):
    rows = spark.range(2).select(F.when(F.col("id") == 0, F.transform(F.sequence(F.lit(1), F.lit(64)), lambda x: x.cast("double"))).alias("v"))
    out = [r[0] for r in rows.select(ds.median_hash(F.col("v"))).collect()]
    # Values 2 .. 64 have the median 33: the last 31 of the 64 bits are set.
    assert out == [(1 << 31) - 1, None]
    long = spark.range(1).select(F.array_repeat(F.lit(1.0), 65).alias("v"))
    with pytest.raises(Exception, match="64 values"):
        long.select(ds.median_hash(F.col("v"))).collect()


def test_strengths_are_of_the_summed_loss(spark):
    models = ml.model_grid(50.0)["logistic_regression"]
    assert [round(1 / (m.getRegParam() * 50.0), 9) for m in models] == list(ml.INVERSE_STRENGTHS)
    assert {m.getNumTrees() for m in ml.model_grid(1.0)["random_forest"]} == {240}
