"""Label text in and out: strict and lenient scans, file-name metadata, label bodies."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, functions as F

from boxtrail.functions import geometry as g
from boxtrail.operators.skew import union_routes


def scan_lines(spark: SparkSession, path: str, suffix: str = "*.txt") -> DataFrame:
    """Lines of label files: file, line_no (1-based), value. One row per file comes in, so a file is one image."""
    text = spark.read.text(path, wholetext=True, pathGlobFilter=suffix, recursiveFileLookup=True)
    named = text.select(F.col("_metadata.file_path").alias("file"), "value")
    return split_lines(named)


def split_lines(bodies: DataFrame) -> DataFrame:
    """(file, value: whole body) to one row per line; an empty body keeps one row with a null line."""
    lines = F.split(F.regexp_replace("value", "\r", ""), "\n")
    return bodies.select("file", F.posexplode_outer(lines).alias("pos", "line")).select(
        "file", (F.col("pos") + 1).cast("int").alias("line_no"), F.col("line").alias("value")
    )


def _fields() -> Column:
    return F.split(F.trim(F.regexp_replace("value", r"\s+", " ")), " ")


def _problem(parts: Column, num_classes: int) -> Column:
    """First broken rule of a line, or null."""
    nums = F.transform(parts, lambda p: p.try_cast("double"))
    cls = nums[0]
    coords = F.slice(nums, 2, 4)
    return (
        F.when(F.size(parts) != 5, "expected 5 fields")
        .when(F.exists(nums, lambda v: v.isNull() | F.isnan(v)), "not a number")
        .when((cls != F.floor(cls)) | (cls < 0) | (cls >= num_classes), "class out of range")
        .when(F.exists(coords, lambda v: (v < 0) | (v > 1)), "coordinate outside 0..1")
        .when((coords[2] <= 0) | (coords[3] <= 0), "empty box")
    )


def _parsed(lines: DataFrame, num_classes: int) -> DataFrame:
    rows = lines.filter(F.trim(F.coalesce("value", F.lit(""))) != "").withColumn("_p", _fields())
    return rows.withColumn("_bad", _problem(F.col("_p"), num_classes))


def _columns(rows: DataFrame) -> DataFrame:
    c = [F.col("_p")[i].try_cast("double") for i in range(5)]
    names = ("cx", "cy", "w", "h")
    return rows.select(
        "file", "line_no", c[0].cast("int").alias("class_id"), *[v.alias(n) for n, v in zip(names, c[1:])]
    )


def parse_labels(lines: DataFrame, num_classes: int, on_error: str = "fail") -> DataFrame:
    """Strict label rows. A bad line raises with file and line, or is left out for ``rejected_labels`` to report."""
    rows = _parsed(lines, num_classes)
    if on_error == "quarantine":
        return _columns(rows.filter("_bad is null"))
    where = F.concat_ws(":", "file", F.col("line_no").cast("string"), F.col("_bad"))
    checked = rows.withColumn("_p", F.when(F.col("_bad").isNull(), F.col("_p")).otherwise(F.raise_error(where).cast("array<string>")))
    return _columns(checked)


def rejected_labels(lines: DataFrame, num_classes: int) -> DataFrame:
    return _parsed(lines, num_classes).filter("_bad is not null").select("file", "line_no", F.col("_bad").alias("reason"))


def read_labels(spark: SparkSession, path: str, num_classes: int, on_error: str = "fail") -> DataFrame:
    return parse_labels(scan_lines(spark, path), num_classes, on_error)


def parse_labels_lenient(lines: DataFrame, sizes: DataFrame) -> DataFrame:
    """Lines with exactly five numbers, as pixel boxes; ``sizes`` has file, width, height."""
    # Out of an explode the numbers are columns of their own; as a filter and its columns every line would be split six times.
    five = F.filter(F.array(_fields()), lambda p: F.size(p) == 5)
    rows = lines.select("*", F.explode(F.transform(five, lambda p: F.transform(p, lambda v: v.try_cast("double")))).alias("_p"))
    rows = _columns(rows).dropna(subset=["class_id", "cx", "cy", "w", "h"]).join(sizes, "file")
    w, h = F.col("width"), F.col("height")
    px = g.xywh_to_xyxy(F.col("cx") * w, F.col("cy") * h, F.col("w") * w, F.col("h") * h)
    return rows.select("file", "line_no", "class_id", *[c.alias(n) for n, c in zip(g.Box._fields, px)])


def parse_names(df: DataFrame, name: str, strict: bool = True) -> DataFrame:
    """Adds source_id, tile_id, tile_x, tile_y and the clean name (export suffix removed) of a file name."""
    n = F.col(name)

    def number(pattern):
        return F.regexp_extract(n, pattern, 1).try_cast("int")

    source = number(r"_?src(\d+)(?:_|\.|$)")
    if strict:
        bad = F.raise_error(F.concat(F.lit("no source id in "), n)).cast("int")
        source = F.when(source.isNotNull(), source).otherwise(bad)
    marker = "_jpg.rf."
    base = F.element_at(F.split(n, "/"), -1)
    clean = F.when(n.contains(marker), F.concat(F.split_part(n, F.lit(marker), F.lit(1)), F.lit(".jpg"))).otherwise(base)
    return df.withColumns(
        {
            "source_id": source,
            "tile_id": F.coalesce(number(r"_tile(\d+)"), F.lit(0)),
            "tile_x": number(r"_x(\d+)"),
            "tile_y": number(r"_y(\d+)"),
            "clean_name": clean,
        }
    )


def label_bodies(boxes: DataFrame, image: str, order: list[str], digits: int = 6) -> DataFrame:
    """One text body per image: clamped center and size of each box in order.

    Ordinary images gather their lines in one array. A crowded image is joined in ordered parts first, so a task
    holds one part's lines at a time before the body itself (which is one row of text by definition of the sink).
    """
    box = g.xyxy_to_xywh(g.Box(*(g.clamp(c) for c in g.box())))
    fmt = "%d" + f" %.{digits}f" * 4
    line = F.format_string(fmt, F.col("class_id"), *box.values())
    rows = boxes.select(image, F.struct(*order).alias("_o"), line.alias("_l"))

    def gather(df):
        body = F.array_join(F.transform(F.sort_array(F.collect_list(F.struct("_o", "_l"))), lambda e: e["_l"]), "\n")
        return df.groupBy(image).agg(body.alias("body"))

    def parts(df):
        from boxtrail.operators.ordered import indexed

        chunked = indexed(df, [image], ["_o"], "_n").withColumn("_part", F.floor(F.col("_n") / 4096))
        body = F.array_join(F.transform(F.sort_array(F.collect_list(F.struct("_n", "_l"))), lambda e: e["_l"]), "\n")
        small = chunked.groupBy(image, "_part").agg(body.alias("_l"))
        whole = F.array_join(F.transform(F.sort_array(F.collect_list(F.struct("_part", "_l"))), lambda e: e["_l"]), "\n")
        return small.groupBy(image).agg(whole.alias("body"))

    return union_routes(rows, [image], gather, parts)


def write_labels(bodies: DataFrame, path: str, split: str | None = None, per_file: bool = False, image: str = "image_id") -> None:
    """Bodies as a compressed table partitioned by split, or one small text file per image for tools that need it."""
    if per_file:
        cols = [split, image] if split else [image]
        bodies.select(*cols, F.col("body").alias("value")).write.partitionBy(*cols).text(path)
        return
    writer = bodies.write
    (writer.partitionBy(split) if split else writer).parquet(path)
