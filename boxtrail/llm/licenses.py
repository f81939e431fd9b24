"""Licence scan by canonical digests.

A text is brought to a canonical form (case, punctuation, copyright lines, equivalent spellings) and its digest is hash-joined
with the digests of known licences. Each line of a text is looked up the same way, so statements inside a longer text count.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from boxtrail.llm.license_texts import known_texts

# Equivalent spellings, after punctuation has become a space.
SPELLINGS = [
    ("licence", "license"),
    ("sub license", "sublicense"),
    ("non commercial", "noncommercial"),
    ("non infringement", "noninfringement"),
    ("acknowledgement", "acknowledgment"),
    ("copyright owner", "copyright holder"),
    ("whilst", "while"),
    ("favour", "favor"),
    ("https", "http"),
]
COPYRIGHT = r"^(copyright( c)? [0-9]{4}|c [0-9]{4}|all rights reserved$)"


def canonical_lines(text: Column) -> Column:
    """Canonical lines without empty and copyright lines; null has none."""
    plain = F.regexp_replace(F.lower(F.coalesce(text, F.lit(""))), r"[^\p{L}\p{N}\n]+", " ")
    for old, new in SPELLINGS:
        plain = F.replace(plain, F.lit(old), F.lit(new))
    lines = F.transform(F.split(plain, "\n"), lambda x: F.trim(x))
    return F.filter(lines, lambda x: (x != "") & ~x.rlike(COPYRIGHT))


def known_digests(spark: SparkSession, known: list[tuple[str, str]] | None = None) -> DataFrame:
    """(digest, license) of the known texts; one row each, a fixed small table."""
    rows = spark.createDataFrame(known or known_texts(), "license string, text string")
    digest = F.sha2(F.concat_ws(" ", canonical_lines(F.col("text"))), 256)
    return rows.select(digest.alias("digest"), "license").groupBy("digest").agg(F.min("license").alias("license"))


def scan_licenses(documents: DataFrame, known: DataFrame, text: str = "text", key: str = "doc_id") -> DataFrame:
    """One row per document row: key, ``text_license`` (of the whole text, null if none), ``line_licenses`` (sorted, distinct),
    ``n_license_lines``.

    Null, empty and all-copyright texts match nothing; an empty table gives none. Rows that repeat a key (null included) keep
    their own matches each; other columns are not read. ``known`` is broadcast, as it holds one row per licence text; one unit
    a row and the matched lines are shuffled.
    """
    lines = documents.select(F.monotonically_increasing_id().alias("uid"), documents[key].alias("key"), canonical_lines(documents[text]).alias("lines"))
    whole = F.struct(F.lit(True).alias("whole"), F.when(F.size("lines") > 0, F.sha2(F.concat_ws(" ", "lines"), 256)).alias("digest"))
    each = F.transform("lines", lambda x: F.struct(F.lit(False).alias("whole"), F.sha2(x, 256).alias("digest")))
    units = lines.select("uid", "key", F.explode(F.concat(F.array(whole), each)).alias("u")).select("uid", "key", "u.*")
    met = units.join(F.broadcast(known), "digest", "left").where("whole or license is not null")
    found = met.groupBy("uid", "key").agg(
        F.min(F.when(F.col("whole"), F.col("license"))).alias("text_license"),
        F.sort_array(F.collect_set(F.when(~F.col("whole"), F.col("license")))).alias("line_licenses"),
        F.count(F.when(~F.col("whole"), 1)).alias("n_license_lines"),
    )
    return found.select(F.col("key").alias(key), "text_license", "line_licenses", "n_license_lines")
