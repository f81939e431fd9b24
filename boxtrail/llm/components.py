"""Connected components by contraction, and tables written to the shared folder."""

from __future__ import annotations

import gc

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from boxtrail.session import scratch_path


def keep(df: DataFrame, label: str, codec: str = "snappy") -> DataFrame:
    """Write ``df`` to the shared folder and read it back: the lineage ends there, and a lost executor costs nothing."""
    path = scratch_path(df.sparkSession, label)
    df.write.parquet(path, compression=codec)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def forget(*tables: DataFrame) -> None:
    """Delete tables written by ``keep`` that nothing reads any more; what was made from them is a written table itself."""
    for table in tables:
        spark = table.sparkSession
        root = scratch_path(spark, "x").rsplit("/", 1)[0]
        for folder in {file.rsplit("/", 1)[0] for file in table.inputFiles()}:
            path = spark._jvm.org.apache.hadoop.fs.Path(folder)
            if path.getParent().getName() == root.rsplit("/", 1)[-1]:
                path.getFileSystem(spark._jsc.hadoopConfiguration()).delete(path, True)


def release(spark: SparkSession) -> None:
    """Let Spark delete the shuffle files of finished jobs now: its cleaner follows the driver's garbage collection, which a
    loop of many small jobs on a large driver hardly ever causes. Data still in use is not touched."""
    gc.collect()
    spark.sparkContext._jvm.System.gc()


def components(links: DataFrame) -> DataFrame:
    """(id, root) for every end of ``links`` (columns a, b); ``root`` is one id of its component, the same for all of it.

    Each round points every vertex at the first of its neighbours and itself and contracts the links. First is the smallest
    id in the two opening rounds and every second one after them, which ends stars; in the others it is the smallest of a
    hash that is new in each round, which shrinks a chain in any order of ids by a constant share, so the rounds grow with
    the logarithm of the longest chain. A vertex with many links is aggregated before the shuffle.
    """
    edges = keep(links.select("a", "b").where("a <> b"), "edges")
    roots, round_ = None, 0
    while not edges.isEmpty():
        both = edges.select(F.col("a").alias("id"), F.col("b").alias("to")).union(edges.select("b", "a"))
        if round_ < 2 or round_ % 2:
            first = F.least("id", F.min("to"))
        else:
            first = F.least(F.struct(F.xxhash64("id", F.lit(round_)).alias("h"), "id"), F.min(F.struct(F.xxhash64("to", F.lit(round_)).alias("h"), F.col("to").alias("id"))))["id"]
        step = keep(both.groupBy("id").agg(first.alias("root")), "step")
        round_ += 1
        if roots is None:
            roots = step
        else:
            moved = step.select(F.col("id").alias("root"), F.col("root").alias("next"))
            old, roots = roots, keep(roots.join(moved, "root", "left").select("id", F.coalesce("next", "root").alias("root")), "roots")
            forget(old)
        a, b = step.select(F.col("id").alias("a"), F.col("root").alias("x")), step.select(F.col("id").alias("b"), F.col("root").alias("y"))
        old = edges
        edges = keep(edges.join(a, "a").join(b, "b").where("x <> y").select(F.least("x", "y").alias("a"), F.greatest("x", "y").alias("b")).distinct(), "edges")
        forget(old)
        if step is not roots:
            forget(step)
    return roots if roots is not None else edges.select(F.col("a").alias("id"), F.col("b").alias("root"))
