"""Result tables, manifests, reports, reviews and point annotations."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, functions as F

from boxtrail.operators.datasets import assert_unique


def write_table(df: DataFrame, path: str, columns: list[str], fmt: str = "parquet", by: list[str] | None = None) -> None:
    """Write a fixed column order; extra columns are ignored. Booleans become 0/1 in text."""
    out = df.select(*columns)
    if fmt == "csv":
        flags = [f.name for f in out.schema.fields if f.dataType.simpleString() == "boolean"]
        out = out.withColumns({c: F.col(c).cast("int") for c in flags})
    writer = out.write.format(fmt)
    if fmt == "csv":
        writer = writer.option("header", True).option("emptyValue", "")
    (writer.partitionBy(*by) if by else writer).save(path)


def write_tables(frames: dict[str, DataFrame], path: str, columns: dict[str, list[str]], fmt="parquet", by=None) -> None:
    for name, df in frames.items():
        write_table(df, f"{path}/{name}", columns[name], fmt, by)


def read_table(spark: SparkSession, path: str, schema: str, fmt: str = "parquet") -> DataFrame:
    """A table with a declared schema; an empty CSV field is null."""
    reader = spark.read.schema(schema)
    return reader.option("header", True).csv(path) if fmt == "csv" else reader.format(fmt).load(path)


def file_manifest(spark: SparkSession, path: str, glob: str = "*") -> DataFrame:
    """SHA-256 and size of every file. Very large files are better hashed where they are made: one file is one row."""
    files = spark.read.format("binaryFile").option("recursiveFileLookup", True).option("pathGlobFilter", glob).load(path)
    return files.select("path", F.col("length").alias("bytes"), F.sha2("content", 256).alias("sha256"))


METRICS = (
    "feature_mode string, best_epoch int, weight_bits int, parameters struct<total:long>, validation struct<macro_f1:double,"
    "per_class:map<string,struct<precision:double,recall:double,f1:double>>>, test struct<macro_f1:double,"
    "per_class:map<string,struct<precision:double,recall:double,f1:double>>>"
)


def load_run_metrics(spark: SparkSession, glob: str, classes: list[str]) -> DataFrame:
    raw = spark.read.schema(METRICS).option("multiLine", True).json(glob)
    run = F.regexp_extract(F.col("_metadata.file_path"), r"([^/]+)/[^/]+$", 1)
    return run_metrics(raw.withColumn("run", run), classes)


def run_metrics(raw: DataFrame, classes: list[str]) -> DataFrame:
    """One row per run with flat per-class metrics; a missing bit width means 32."""
    cols = ["run", "feature_mode", "best_epoch", F.coalesce("weight_bits", F.lit(32)).alias("weight_bits")]
    cols += [F.col("parameters.total").alias("parameters"), F.col("validation.macro_f1").alias("validation_macro_f1")]
    cols.append(F.col("test.macro_f1").alias("test_macro_f1"))
    for part, name in (("validation", "valid"), ("test", "test")):
        for c in classes:
            for m in ("precision", "recall", "f1"):
                cols.append(F.col(f"{part}.per_class")[c][m].alias(f"{name}_{c}_{m}"))
    return raw.select(*cols)


def best_run(rows: DataFrame) -> DataFrame:
    return rows.orderBy(F.desc("validation_macro_f1"), "run").limit(1)


def write_report(df: DataFrame, path: str) -> None:
    """A small report frame as JSON."""
    df.coalesce(1).write.json(path)


def report_json(df: DataFrame, name: str = "report") -> DataFrame:
    return df.select(F.to_json(F.struct(*df.columns)).alias(name))


REVIEW = (
    "review_id string, item_type string, review_status string, reviewed_label string, droplet_sequence int, "
    "best_frame long, points_json string"
)


def read_reviews(spark: SparkSession, path: str) -> DataFrame:
    """Review CSV; a byte-order mark before the first header is tolerated because columns go by position."""
    raw = spark.read.schema(REVIEW).option("header", True).option("enforceSchema", True).option("escape", '"').csv(path)
    return raw.withColumn("review_id", F.regexp_replace("review_id", "^﻿", ""))


def usable_reviews(reviews: DataFrame, labels: tuple = ("particle", "background")) -> DataFrame:
    """Reviewed candidates with a valid label; review ids must be unique."""
    unique = assert_unique(reviews, ["review_id"], "reviews")
    return unique.filter(
        (F.col("item_type") == "candidate") & (F.col("review_status") == "reviewed") & F.col("reviewed_label").isin(*labels)
    )


def review_counts(reviews: DataFrame) -> DataFrame:
    kind = F.concat_ws(":", "item_type", "review_status", F.coalesce("reviewed_label", F.lit("")))
    return reviews.groupBy(kind.alias("kind")).agg(F.count(F.lit(1)).alias("n"))


def explode_points(df: DataFrame, text: str, size: str, ident: list[str]) -> DataFrame:
    """Points of a JSON column, numbered from 1. A point outside the square raises."""
    points = F.from_json(text, "array<struct<x:double,y:double>>")
    rows = df.select(*ident, size, F.posexplode(points).alias("pos", "p"))
    x, y = F.col("p.x").cast("int"), F.col("p.y").cast("int")
    inside = (x >= 0) & (x < F.col(size)) & (y >= 0) & (y < F.col(size))
    bad = F.raise_error(F.concat(F.lit("point outside the region: "), F.to_json(F.struct("p")))).cast("int")
    return rows.select(*ident, (F.col("pos") + 1).alias("point_index"), F.when(inside, x).otherwise(bad).alias("x"), y.alias("y"))
