"""WARC archives with revisit records: write them deduplicated, read them back, resolve revisits.

Headers are grouped by payload digest to find each payload's original; a later page with the same payload becomes a revisit
record that names the original and carries no payload. Archives go through Spark's text writer, whose line separator is the
record separator, so any file system Spark knows will do.
"""

from __future__ import annotations

import gzip
import hashlib
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from boxtrail.session import ship_package

SMALLEST = 100
SALTS = 32
FILE_BYTES = 16 << 20
END = "\r\n\r\n"
PROFILE = "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"
RECORD = "record_id string, record_type string, page_id string, uri string, date string, payload_digest string, refers_to string, payload binary"


def record_id(page: Column, digest: Column) -> Column:
    """A name-based UUID of page and payload, so a repeated task writes the same id."""
    h = F.md5(F.concat_ws("/", F.coalesce(page.cast("string"), F.lit("-")), digest))
    return F.concat(F.lit("<urn:uuid:"), F.concat_ws("-", *(F.substring(h, a, n) for a, n in ((1, 8), (9, 4), (13, 4), (17, 4), (21, 12)))), F.lit(">"))


def resolve_revisits(pages: DataFrame, key: str = "page_id", url: str = "url", html: str = "html", smallest: int = SMALLEST) -> DataFrame:
    """(page, url, html, payload_bytes, payload_digest, original): ``original`` is the smallest page id of that payload.

    ``original`` is null for payloads under ``smallest`` bytes and for payloads that occur once. Digests with copies are
    joined through salted keys, so a payload that a third of all pages share is spread over ``SALTS`` partitions.
    """
    body = F.coalesce(pages[html], F.lit(""))
    rows = pages.select(pages[key].alias("page"), pages[url].alias("url"), body.alias("html"), F.octet_length(body).cast("long").alias("payload_bytes"), F.sha2(body, 256).alias("payload_digest"))
    large = rows.where(F.col("payload_bytes") >= smallest)
    copies = large.groupBy("payload_digest").agg(F.min("page").alias("original"), F.count("*").alias("n")).where("n > 1").drop("n")
    salted = copies.select("payload_digest", "original", F.explode(F.sequence(F.lit(0), F.lit(SALTS - 1))).alias("salt"))
    return rows.withColumn("salt", F.pmod(F.xxhash64("page", "url"), F.lit(SALTS)).cast("int")).join(salted, ["payload_digest", "salt"], "left").drop("salt")


def warc_records(resolved: DataFrame, date: str = "1970-01-01T00:00:00Z") -> DataFrame:
    """One string per record, without the closing blank lines; headers are made anew.

    A page with a larger id than its payload's original is a revisit, every other page a response (rows that repeat the
    original's id included). A null page or url leaves its header out; line breaks in a url are percent-encoded.
    """
    revisit = F.coalesce(F.col("page") > F.col("original"), F.lit(False))
    digest = F.col("payload_digest")
    http = F.concat(F.lit("HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: "), F.col("payload_bytes").cast("string"), F.lit(END))
    size = F.length(http) + F.when(revisit, 0).otherwise(F.col("payload_bytes"))
    uri = F.replace(F.replace(F.col("url"), F.lit("\r"), F.lit("%0D")), F.lit("\n"), F.lit("%0A"))

    def line(name: str, value: Column) -> Column:
        return F.coalesce(F.concat(F.lit(f"{name}: "), value, F.lit("\r\n")), F.lit(""))

    head = F.concat(
        F.lit("WARC/1.1\r\n"),
        line("WARC-Type", F.when(revisit, "revisit").otherwise("response")),
        line("WARC-Record-ID", record_id(F.col("page"), digest)),
        line("WARC-Date", F.lit(date)),
        line("WARC-Target-URI", uri),
        line("WARC-Payload-Digest", F.concat(F.lit("sha256:"), digest)),
        line("WARC-Profile", F.when(revisit, PROFILE)),
        line("WARC-Refers-To", F.when(revisit, record_id(F.col("original"), digest))),
        line("X-Page-ID", F.col("page").cast("string")),
        line("Content-Type", F.lit("application/http; msgtype=response")),
        line("Content-Length", size.cast("string")),
        F.lit("\r\n"),
    )
    return resolved.select(F.concat(head, http, F.when(revisit, "").otherwise(F.col("html"))).alias("value"))


def write_archives(pages: DataFrame, path: str, key: str = "page_id", url: str = "url", html: str = "html", date: str = "1970-01-01T00:00:00Z") -> None:
    """Write ``pages`` as gzipped WARC files under ``path``; a file holds about ``FILE_BYTES`` of records before packing."""
    mean = pages.agg(F.avg(F.coalesce(F.octet_length(pages[html]), F.lit(0)))).first()[0] or 0
    records = warc_records(resolve_revisits(pages, key, url, html), date)
    records.write.option("compression", "gzip").option("lineSep", END).option("maxRecordsPerFile", max(1, int(FILE_BYTES / (mean + 600)))).text(path)


def parse_archive(content: bytes) -> Iterator[tuple]:
    """The records of one WARC file, gzipped or plain, by their stated lengths (payloads may hold any bytes)."""
    data, at = gzip.decompress(content) if content[:2] == b"\x1f\x8b" else content, 0
    while at < len(data):
        stop = data.index(b"\r\n\r\n", at)
        first, *lines = data[at:stop].decode("utf-8").split("\r\n")
        if not first.startswith("WARC/"):
            raise ValueError(f"no WARC record at byte {at}")
        head = dict(x.split(": ", 1) for x in lines)
        body = data[stop + 4 : stop + 4 + int(head["Content-Length"])]
        at = stop + 4 + int(head["Content-Length"]) + 4
        payload = body[body.index(b"\r\n\r\n") + 4 :]
        yield tuple(head.get(n) for n in ("WARC-Record-ID", "WARC-Type", "X-Page-ID", "WARC-Target-URI", "WARC-Date", "WARC-Payload-Digest", "WARC-Refers-To")) + (payload if head["WARC-Type"] == "response" else None,)


def read_archives(spark: SparkSession, path: str) -> DataFrame:
    """One row per record: id, type, page id, uri, date, payload digest, the record it refers to, payload (null: revisit).

    A response whose payload does not match its digest raises.
    """
    ship_package(spark)
    names = [x.split()[0] for x in RECORD.split(", ")]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        kinds = [pa.binary() if n == "payload" else pa.string() for n in names]
        for batch in batches:
            for content in batch.column("content"):
                rows, size = [], 0
                for row in parse_archive(content.as_py()):
                    if row[-1] is not None and row[5] != "sha256:" + hashlib.sha256(row[-1]).hexdigest():
                        raise ValueError(f"payload of {row[0]} does not match its digest")
                    rows.append(row)
                    size += len(row[-1] or b"")
                    if size > 4 << 20:
                        yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*rows, strict=True), kinds, strict=True)], names=names)
                        rows, size = [], 0
                if rows:
                    yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*rows, strict=True), kinds, strict=True)], names=names)

    files = spark.read.format("binaryFile").option("pathGlobFilter", "part-*").load(path).where("length > 0").select("content")
    return files.mapInArrow(run, RECORD)


def resolved_records(records: DataFrame) -> DataFrame:
    """Every record with the payload's length and digest and, for revisits, the page id of the original response."""
    responses = records.where("record_type = 'response'").groupBy("record_id").agg(F.first("page_id").alias("of_page"), F.first(F.octet_length("payload")).alias("of_bytes"))
    rows = records.select("record_id", "record_type", "page_id", "uri", "payload_digest", "refers_to", F.octet_length("payload").alias("own_bytes"))
    own = rows.where("record_type = 'response'").select("page_id", "uri", "payload_digest", "record_type", F.col("own_bytes").alias("payload_bytes"), F.lit(None).cast("string").alias("refers_to"))
    salted = responses.select(F.col("record_id").alias("refers_to"), "of_page", "of_bytes")
    later = rows.where("record_type = 'revisit'").groupBy("refers_to", "page_id", "uri", "payload_digest").agg(F.count("*").alias("n"))
    later = later.join(salted, "refers_to").select("page_id", "uri", "payload_digest", F.lit("revisit").alias("record_type"), F.col("of_bytes").alias("payload_bytes"), F.col("of_page").alias("refers_to"), F.explode(F.sequence(F.lit(1), F.col("n"))).alias("k"))
    return own.unionByName(later.drop("k"))
