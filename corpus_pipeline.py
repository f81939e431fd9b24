"""A corpus pipeline of five stages over ``documents``; each stage's output is written and read again by the next.

A row is known by its id and text together, so rows that repeat an id are told apart. The first four stages return the columns
of ``documents``; ``n_chars``, where present, follows the text.
"""

from __future__ import annotations

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from boxtrail.llm import pii
from boxtrail.llm.bpe import encode_decode
from boxtrail.llm.components import keep
from boxtrail.llm.decontaminate import decontaminate
from boxtrail.llm.neardup import near_duplicates
from boxtrail.llm.passes import replace_text, spare
from boxtrail.llm.quality import keep_good



def with_row(docs: DataFrame) -> tuple[DataFrame, str]:
    """The rows with one more column, and its name, which no other column has."""
    row = spare(docs, "__row")
    return docs.withColumn(row, F.struct(F.col("doc_id").alias("id"), F.xxhash64("text").alias("hash"))), row


def quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Drop documents that fail the base rules or score below the threshold learned from the labels."""
    labels = spark.read.parquet(f"{sf_dir}/labels.parquet")
    return keep_good(docs, labels.where("quality = 1"), threshold=None, poor_ids=labels.where("quality = 0"))


def near_duplicate(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Keep one document of each group of near-duplicates (five words, 0.8); of rows equal in id and text, one."""
    rows, row = with_row(docs)
    dropped = near_duplicates(rows, key=row).where("not kept").select(row)
    repeated = keep(rows.groupBy(row).agg(F.count("*").alias("__n")).where("__n > 1").select(row), "repeated-rows")
    kept = rows.join(dropped, row, "left_anti")
    if repeated.isEmpty():
        return kept.select(*docs.columns)
    once = kept.join(repeated, row, "left_semi").dropDuplicates([row])
    return kept.join(repeated, row, "left_anti").unionByName(once).select(*docs.columns)


def benchmark(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Drop documents that hold a benchmark window."""
    rows, row = with_row(docs)
    hit = decontaminate(rows, spark.read.parquet(f"{sf_dir}/benchmark.parquet"), key=row).where("n_hit > 0").select(row)
    return rows.join(hit, row, "left_anti").select(*docs.columns)


def personal_data(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Put the kind's name in place of every span of personal data."""
    model = pii.train(docs)
    masked = replace_text(docs, "text", lambda texts: [pii.mask_text(t, pii.all_spans(t, model)) for t in texts])
    return masked.withColumn("n_chars", F.length("text").cast(docs.schema["n_chars"].dataType)) if "n_chars" in docs.columns else masked


def encode(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Token ids of every document, checked by decoding them."""
    coded = encode_decode(docs, public_tokenizers.path("byte_bpe_50k.json"))
    return coded.select("doc_id", "n_tokens", "ids", F.sha2("ids", 256).alias("ids_sha256"), F.sha2("decoded", 256).alias("decoded_sha256"))


STAGES = [("quality", quality), ("near_duplicates", near_duplicate), ("decontamination", benchmark), ("personal_data", personal_data), ("encode", encode)]
# Scores, minwise trees and merges have no SQL form; tests hold the stages against brute-force versions.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for name, stage in STAGES[:-1]:
        docs = keep(stage(spark, docs, sf_dir), f"pipeline-{name}")
    return STAGES[-1][1](spark, docs, sf_dir)
