"""Parameter grids and single-row tables next to big ones, without a Cartesian product of two tables."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F


def grid_array(rows: list[dict]) -> Column:
    """A literal array of settings; ``grid_id`` is the position unless given."""
    full = [{"grid_id": i, **r} for i, r in enumerate(rows)]
    return F.array(*[F.struct(*[F.lit(v).alias(k) for k, v in r.items()]) for r in full])


def with_grid(df: DataFrame, rows: list[dict]) -> DataFrame:
    """Every row under every setting. The grid is a list in the program, so this is an explode, not a join."""
    return df.withColumn("_g", F.explode(grid_array(rows))).select(*df.columns, "_g.*")


def with_row(df: DataFrame, one: DataFrame) -> DataFrame:
    """Add the columns of a one-row aggregate to every row; no row gives no rows, more than one is an error."""
    held = one.agg(F.count(F.lit(1)).alias("_rows"), F.first(F.struct("*")).alias("_one")).filter("_rows > 0")
    checked = F.when(F.col("_rows") == 1, F.col("_one")).otherwise(F.raise_error(F.lit("with_row needs one row")))
    return df.join(F.broadcast(held.select(checked.alias("_one")).select("_one.*")), how="cross")
