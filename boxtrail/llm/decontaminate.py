"""Benchmark decontamination as a prefix-filtered set join, in DataFrame functions only.

An item window is a run of ``window`` words; a shorter item is one window. Exact containment of a window needs every one of
its shingles, so one necessary prefix token is enough: its rarest shingle over the corpus. The corpus is read once. Each
position whose shingle may belong to the benchmark (a bitmap test, false alarms allowed) is kept with the few words around
it; shingle counts give the rarity order; the prefix join yields candidate starts, position and length bounds discard those
outside the text, and the words themselves are compared.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from boxtrail.session import scratch_path

WINDOW, SHINGLE = 10, 5
BITS_PER_SHINGLE, MOST_BITS = 64, 1 << 23
BROADCAST_BYTES = 32 << 20
UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
SEPARATORS = r"[\x00-\x2F\x3A-\x60\x7B-\x7F]+"


def match_words(text: Column) -> Column:
    """Words of letters, digits and non-ASCII characters, A-Z folded; null has none."""
    plain = F.octet_length(text) == F.length(text)
    folded = F.when(plain, F.lower(text)).otherwise(F.translate(text, UPPER, LOWER))
    return F.array_remove(F.split(F.coalesce(folded, F.lit("")), SEPARATORS), "")


def shingle_at(words: Column, at: Column, size: int) -> Column:
    return F.xxhash64(F.lit(size), *(F.get(words, at + k) for k in range(size)))


def positions(last: Column) -> Column:
    """0 .. last, or nothing if last is negative."""
    return F.when(last >= 0, F.sequence(F.lit(0), last)).otherwise(F.array().cast("array<int>"))


def item_windows(items: DataFrame, text: str, key: str, window: int) -> DataFrame:
    """Distinct windows: ``win``, ``words``, ``len`` and the sorted ids (as strings) of the items that hold them."""
    words = items.select(items[key].cast("string").alias("item"), match_words(items[text]).alias("all")).where("item is not null and size(all) > 0")
    starts = words.select("item", "all", F.explode(positions(F.greatest(F.size("all") - window, F.lit(0)))).alias("at"))
    runs = starts.select("item", F.slice("all", F.col("at") + 1, window).alias("words"))
    runs = runs.groupBy("words").agg(F.sort_array(F.collect_set("item")).alias("items"))
    return runs.select(F.sha2(F.concat_ws(" ", "words"), 256).alias("win"), "words", F.size("words").alias("len"), "items")


def window_shingles(windows: DataFrame, size: int) -> DataFrame:
    """(win, offset, code): every shingle of each window; a window of fewer words has one of its own length."""
    out = None
    for k in range(1, size + 1):
        own = windows.where(F.col("len") == k) if k < size else windows.where(F.col("len") >= size)
        own = own.select("win", "words", F.explode(positions(F.col("len") - k)).alias("offset")).select("win", "offset", shingle_at(F.col("words"), F.col("offset"), k).alias("code"))
        out = own if out is None else out.unionByName(own)
    return out


def presence_bitmap(codes: DataFrame, bits: int) -> Column:
    """One array of longs with a bit set for each code; a scalar subquery of ``bits / 8`` bytes."""
    slot = F.pmod("code", F.lit(bits))
    bit = F.call_function("shiftleft", F.lit(1).cast("long"), F.pmod("code", F.lit(64)).cast("int"))
    words = codes.groupBy(F.shiftright(slot, 6).alias("id")).agg(F.bit_or(bit).alias("word"))
    full = codes.sparkSession.range(bits // 64).join(words, "id", "left").select("id", F.coalesce("word", F.lit(0).cast("long")).alias("word"))
    return full.agg(F.transform(F.array_sort(F.collect_list(F.struct("id", "word"))), lambda x: x["word"]).alias("bitmap")).scalar()


def has_bit(bitmap: Column, code: Column, bits: int) -> Column:
    word = F.get(bitmap, F.shiftright(F.pmod(code, F.lit(bits)), 6).cast("int"))
    return F.call_function("shiftrightunsigned", word, F.pmod(code, F.lit(64)).cast("int")).bitwiseAND(F.lit(1).cast("long")) == 1


def possible_hits(words: Column, size: int, bitmap: Column, bits: int, window: int) -> Column:
    """(pos, code, near) of the positions whose shingle has its bit set; ``near`` holds the words a window there may span."""
    at = F.filter(positions(F.size(words) - size), lambda i: has_bit(bitmap, shingle_at(words, i, size), bits))
    near = lambda i: F.slice(words, F.greatest(i - (window - 1), F.lit(0)) + 1, 2 * window - 1)
    return F.transform(at, lambda i: F.struct(i.alias("pos"), shingle_at(words, i, size).alias("code"), near(i).alias("near")))


def merged_length(spans: Column) -> Column:
    """Words covered by sorted (start, end) spans."""
    start = F.struct(F.lit(0).alias("sum"), F.lit(0).alias("reach"))
    step = lambda a, s: F.struct(
        (a["sum"] + F.greatest(F.lit(0), s["end"] - F.greatest(a["reach"], s["start"]))).alias("sum"), F.greatest(a["reach"], s["end"]).alias("reach")
    )
    return F.aggregate(spans, start, step, lambda a: a["sum"])


def decontaminate(
    documents: DataFrame, items: DataFrame, text: str = "text", key: str = "doc_id", item_text: str = "text", item_key: str = "item_id", window: int = WINDOW, shingle: int = SHINGLE
) -> DataFrame:
    """One row per document row: key, ``n_words``, ``n_hit``, ``items`` (sorted ids as strings) and ``spans`` of hit windows.

    A word is hit when it lies in any occurrence of an item window. Null and empty texts have no words; items without words
    or id are ignored; with no items nothing is hit. Repeated rows are separate documents; other columns are not read.
    Reads the documents once and writes one row per document, with its possible hits, to the shared folder. Windows are
    broadcast only below ``BROADCAST_BYTES``; a larger benchmark is joined by shuffle.
    """
    spark = documents.sparkSession
    path = scratch_path(spark, "benchmark-windows")
    item_windows(items, item_text, item_key, window).write.parquet(path)
    windows = spark.read.parquet(path)
    codes = window_shingles(windows, shingle)
    n_codes, n_bytes = windows.agg(F.coalesce(F.sum("len"), F.lit(0)), F.coalesce(F.sum(F.octet_length(F.concat_ws(" ", "words")) + 24 * F.size("items") + 200), F.lit(0))).first()
    sizes = [r[0] for r in windows.select(F.least("len", F.lit(shingle)).alias("k")).distinct().collect()]  # at most ``shingle`` rows
    bits = min(MOST_BITS, 1 << (max(1, n_codes) * BITS_PER_SHINGLE - 1).bit_length())
    bitmap = presence_bitmap(codes, max(64, bits))

    rows = documents.select(documents[key].alias("key"), match_words(documents[text]).alias("words"), bitmap.alias("bitmap"))
    around = window - 1
    near = [possible_hits(F.col("words"), k, F.col("bitmap"), max(64, bits), window) for k in sizes]
    empty = F.array().cast("array<struct<pos:int,code:bigint,near:array<string>>>")
    path = scratch_path(spark, "benchmark-hits")
    rows.select("key", F.size("words").alias("n_words"), (F.concat(*near) if near else empty).alias("maybe")).withColumn("uid", F.monotonically_increasing_id()).write.parquet(path)
    found = spark.read.parquet(path)

    maybe = found.where("size(maybe) > 0").select("uid", "n_words", F.explode("maybe").alias("m")).select("uid", "n_words", "m.*")
    rarity = maybe.groupBy("code").agg(F.count("*").alias("n"))
    rarest = codes.join(rarity, "code").groupBy("win").agg(F.min(F.struct("n", "offset", "code")).alias("r"))
    prefix = windows.join(rarest, "win").select("words", "len", "items", "r.code", "r.offset")
    if n_bytes <= BROADCAST_BYTES:
        prefix = F.broadcast(prefix)
    start = F.col("pos") - F.col("offset")
    own = F.slice("near", start - F.greatest(F.col("pos") - around, F.lit(0)) + 1, F.col("len"))
    hits = (
        maybe.join(prefix, "code")
        .where((start >= 0) & (start + F.col("len") <= F.col("n_words")))
        .where(own == F.col("words"))
        .select("uid", F.struct(start.alias("start"), (start + F.col("len")).alias("end")).alias("span"), "items")
    )
    per_text = hits.groupBy("uid").agg(F.sort_array(F.collect_set("span")).alias("spans"), F.sort_array(F.array_distinct(F.flatten(F.collect_set("items")))).alias("items"))
    return found.drop("maybe").join(per_text, "uid", "left").select(
        F.col("key").alias(key),
        F.col("n_words").cast("long").alias("n_words"),
        F.coalesce(merged_length(F.col("spans")), F.lit(0)).cast("long").alias("n_hit"),
        F.coalesce("items", F.array().cast("array<string>")).alias("items"),
        "spans",
    )
