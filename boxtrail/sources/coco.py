"""COCO-style JSON exports."""

from __future__ import annotations

import os
import posixpath
import uuid
from collections.abc import Iterator
from dataclasses import dataclass

import pyarrow as pa
from pyarrow import fs
from pyspark.sql import DataFrame, SparkSession, functions as F
from pyspark.sql.datasource import DataSource, DataSourceReader, InputPartition

from boxtrail.session import ship_package

SCHEMA = (
    "images array<struct<id:long,file_name:string,width:int,height:int>>,"
    "annotations array<struct<id:long,image_id:long,category_id:int,bbox:array<double>>>,"
    "categories array<struct<id:int,name:string>>"
)


FILE = "_annotations.coco.json"
PART_BYTES = 64 << 20


def _open(root: str) -> tuple[fs.FileSystem, str]:
    """File system and path of a folder given as a path or a URI."""
    if "://" in root:
        return fs.FileSystem.from_uri(root)
    return fs.LocalFileSystem(), "/" + root.split(":", 1)[1].lstrip("/") if root.startswith("file:") else os.path.abspath(root)


@dataclass
class Files(InputPartition):
    """(split, path) of the files one task reads."""

    files: list[tuple[str, str]]


class CocoReader(DataSourceReader):
    def __init__(self, root: str):
        self.root = root

    def partitions(self) -> list[Files]:
        """Names and sizes only; files are packed to about ``PART_BYTES`` a task."""
        system, base = _open(self.root)
        infos = system.get_file_info(fs.FileSelector(base, recursive=True))
        found = sorted((i.path, i.size) for i in infos if i.is_file and i.base_name == FILE and posixpath.dirname(posixpath.dirname(i.path)) == base.rstrip("/"))
        parts, size = [], PART_BYTES
        for path, n in found:
            if size + n > PART_BYTES:
                parts.append(Files([]))
                size = 0
            parts[-1].files.append((posixpath.basename(posixpath.dirname(path)), path))
            size += n
        return parts or [Files([])]

    def read(self, partition: Files) -> Iterator[tuple[str, str]]:
        system, _ = _open(self.root)
        for split, path in partition.files:
            with system.open_input_stream(path) as stream:
                yield split, stream.read().decode("utf-8")


class CocoExport(DataSource):
    """``spark.read.format("coco_export").load(root)``: (split, document) of ``<root>/<split>/_annotations.coco.json``.

    Spark's own file index hides names with a leading underscore. Files are opened in the tasks, never copied; the file
    system is found from the path's scheme, and a path without one must be visible to every executor.
    """

    @classmethod
    def name(cls) -> str:
        return "coco_export"

    def schema(self) -> str:
        return "split string, document string"

    def reader(self, schema) -> CocoReader:
        return CocoReader(self.options["path"])


def read_coco(spark: SparkSession, root: str, keep: list[str]) -> tuple[DataFrame, DataFrame]:
    """(images, annotations) of the split files ``<root>/<split>/_annotations.coco.json``. One file is one JSON document."""
    ship_package(spark)
    spark.dataSource.register(CocoExport)
    raw = spark.read.format("coco_export").load(root)
    return coco_tables(raw.select("split", F.from_json("document", SCHEMA).alias("_d")).select("split", "_d.*"), keep)


def write_coco(documents: DataFrame, root: str) -> None:
    """Write one export file per row of (split, images, annotations, categories). A repeated task writes the same file again."""
    ship_package(documents.sparkSession)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        system, base = _open(root)
        for batch in batches:
            for split, document in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                folder = f"{base}/{split}"
                system.create_dir(folder, recursive=True)
                own = f"{folder}/{uuid.uuid4().hex}.tmp"
                with system.open_output_stream(own) as stream:
                    stream.write(document.encode("utf-8"))
                system.move(own, f"{folder}/{FILE}")
            yield pa.RecordBatch.from_arrays([pa.array([batch.num_rows])], names=["n"])

    rows = documents.select("split", F.to_json(F.struct("images", "annotations", "categories")).alias("document"))
    rows.mapInArrow(run, "n long").agg(F.sum("n")).collect()


def coco_tables(raw: DataFrame, keep: list[str]) -> tuple[DataFrame, DataFrame]:
    """Tables from rows with split and the three arrays. Class names are lower-cased; other classes are dropped."""
    img = raw.select("split", F.explode("images").alias("i")).select("split", "i.*")
    ann = raw.select("split", F.explode("annotations").alias("a")).select(
        "split", "a.image_id", "a.category_id", "a.bbox", F.col("a.id").alias("ann_id")
    )
    cat = raw.select("split", F.explode("categories").alias("c")).select(
        "split", F.col("c.id").alias("category_id"), F.lower(F.trim("c.name")).alias("class_name")
    ).distinct()
    kept = ann.join(cat, ["split", "category_id"]).filter(F.col("class_name").isin(keep))
    boxes = kept.select("split", "image_id", "ann_id", "class_name", *[F.col("bbox")[i].alias(n) for i, n in enumerate("xywh")])
    return img.withColumnRenamed("id", "image_id"), boxes


def coco_rows(images: DataFrame, boxes: DataFrame) -> DataFrame:
    """Images left-joined with their boxes, so an image without boxes stays as one row."""
    return images.join(boxes, ["split", "image_id"], "left")


def assert_unique_names(images: DataFrame, name: str = "clean_name") -> DataFrame:
    twice = images.groupBy(name).count().filter("count > 1").take(1)
    if twice:
        raise ValueError(f"duplicate image name {twice[0][0]}")
    return images
