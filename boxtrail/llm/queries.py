"""Registered queries of the operators over whole tables, and their SQL twins where SQL can express them."""

from __future__ import annotations

from collections.abc import Callable

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from boxtrail.llm import licenses, pii, secrets
from boxtrail.llm.bpe import encode_decode
from boxtrail.llm.brown import brown_scores
from boxtrail.llm.decontaminate import decontaminate
from boxtrail.llm.license_texts import known_texts
from boxtrail.llm.neardup import near_duplicates
from boxtrail.llm.quality import quality_rules
from boxtrail.llm.repeats import LENGTH, remove_repeats
from boxtrail.llm.token_counts import count_tokens
from boxtrail.llm.vector_codes import ENTRIES, PARTS, ROUNDS, compress
from boxtrail.llm.warc import read_archives, resolved_records, write_archives
from boxtrail.llm.whitening import whiten
from boxtrail.session import scratch_path

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLES: dict[str, str] = {}


def query(name: str, sql: str | None = None):
    def register(build):
        QUERIES[name] = build
        if sql:
            ORACLES[name] = sql
        return build

    return register


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


@query("op1_token_counts")
def op1(spark, sf_dir):
    return count_tokens(table(spark, sf_dir, "documents"), public_tokenizers.path("word_bpe_49k.json"))


@query("op2_quality_rules")
def op2(spark, sf_dir):
    labels = table(spark, sf_dir, "labels")
    return quality_rules(table(spark, sf_dir, "documents"), labels.where("quality = 1"), threshold=None, poor_ids=labels.where("quality = 0"))


OP3_SQL = r"""
WITH docs AS (
  SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS w
  FROM documents),
items AS (
  SELECT item_id::VARCHAR AS item, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS w
  FROM benchmark),
wins AS (
  SELECT DISTINCT item, array_to_string(w[i:i + 9], ' ') AS win, least(len(w), 10) AS k
  FROM (SELECT item, w, unnest(range(1, greatest(len(w) - 9, 1) + 1)) AS i FROM items WHERE len(w) > 0)),
starts AS (
  SELECT doc_id, k, i, array_to_string(w[i:i + k - 1], ' ') AS win
  FROM (SELECT doc_id, w, k, unnest(range(1, len(w) - k + 2)) AS i FROM docs, (SELECT DISTINCT k FROM wins))),
hits AS (SELECT DISTINCT doc_id, i, starts.k, item FROM starts JOIN wins ON starts.win = wins.win AND starts.k = wins.k),
words AS (SELECT doc_id, count(DISTINCT p) AS n FROM (SELECT doc_id, unnest(range(i, i + k)) AS p FROM (SELECT DISTINCT doc_id, i, k FROM hits)) GROUP BY doc_id),
lists AS (SELECT doc_id, count(*) AS n, string_agg(item, ',' ORDER BY item) AS ids FROM (SELECT DISTINCT doc_id, item FROM hits) GROUP BY doc_id)
SELECT d.doc_id, len(d.w)::BIGINT AS n_words, coalesce(words.n, 0)::BIGINT AS n_hit, coalesce(lists.n, 0)::BIGINT AS n_items,
  sha256(coalesce(lists.ids, '')) AS items_sha256, coalesce(words.n, 0) > 0 AS contaminated
FROM docs d LEFT JOIN words USING (doc_id) LEFT JOIN lists USING (doc_id)
"""


@query("op3_decontaminate", OP3_SQL)
def op3(spark, sf_dir):
    found = decontaminate(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))
    return found.select(
        "doc_id",
        "n_words",
        "n_hit",
        F.size("items").cast("long").alias("n_items"),
        F.sha2(F.array_join("items", ","), 256).alias("items_sha256"),
        (F.col("n_hit") > 0).alias("contaminated"),
    )


OP7_SQL = """
WITH p AS (SELECT page_id, coalesce(html, '') AS body FROM pages),
h AS (SELECT page_id, strlen(body)::BIGINT AS payload_bytes, sha256(body) AS payload_digest FROM p),
f AS (SELECT payload_digest, min(page_id) AS first_id FROM h WHERE payload_bytes >= 100 GROUP BY payload_digest)
SELECT page_id, payload_bytes, payload_digest,
  CASE WHEN page_id > first_id THEN 'revisit' ELSE 'response' END AS record_type,
  CASE WHEN page_id > first_id THEN first_id END AS refers_to
FROM h LEFT JOIN f USING (payload_digest)
"""


@query("op7_warc_revisits", OP7_SQL)
def op7(spark, sf_dir):
    path = scratch_path(spark, "warc")
    write_archives(table(spark, sf_dir, "pages"), path)
    return resolved_records(read_archives(spark, path)).select(
        F.col("page_id").cast("long").alias("page_id"),
        F.col("payload_bytes").cast("long").alias("payload_bytes"),
        F.substring_index("payload_digest", ":", -1).alias("payload_digest"),
        "record_type",
        F.col("refers_to").cast("long").alias("refers_to"),
    )


@query("op9_bpe")
def op9(spark, sf_dir):
    coded = encode_decode(table(spark, sf_dir, "documents"), public_tokenizers.path("byte_bpe_50k.json"))
    return coded.select("doc_id", "n_tokens", F.sha2("ids", 256).alias("ids_sha256"), F.sha2("decoded", 256).alias("decoded_sha256"))


@query("op5_near_duplicates")
def op5(spark, sf_dir):
    return near_duplicates(table(spark, sf_dir, "documents"), percent=85)


@query("op4_brown_scores")
def op4(spark, sf_dir):
    return brown_scores(table(spark, sf_dir, "documents")).drop("perplexity")


def span_list(spans):
    """kind:start:end of each span, comma-joined."""
    return F.array_join(F.transform(spans, lambda s: F.concat_ws(":", s["kind"], s["start"].cast("string"), s["end"].cast("string"))), ",")


def span_digest(found: DataFrame, kinds: tuple[str, ...]) -> DataFrame:
    base = F.filter("spans", lambda s: s["base"])
    named = F.transform(base, lambda s: s["kind"])
    counts = [(F.size(named) - F.size(F.array_remove(named, kind))).cast("long").alias(f"n_{kind}") for kind in kinds]
    return found.select("doc_id", *counts, F.sha2(span_list(base), 256).alias("base_sha256"), span_list(F.col("spans")).alias("spans"))


@query("op6_pii")
def op6(spark, sf_dir):
    documents = table(spark, sf_dir, "documents")
    return span_digest(pii.find_pii(documents, pii.train(documents)), pii.KINDS)


@query("op10_secrets")
def op10(spark, sf_dir):
    documents = table(spark, sf_dir, "documents")
    return span_digest(secrets.find_secrets(documents, secrets.train(documents)), secrets.KINDS[:3])


def license_sql() -> str:
    plain = "regexp_replace(lower(coalesce(text, '')), '[^\\p{L}\\p{N}\\n]+', ' ', 'g')"
    for old, new in licenses.SPELLINGS:
        plain = f"replace({plain}, '{old}', '{new}')"
    lines = f"list_filter(list_transform(string_split({plain}, chr(10)), lambda x: trim(x)), lambda x: x <> '' AND NOT regexp_matches(x, '{licenses.COPYRIGHT}'))"
    values = ", ".join(f"('{i}', '{t}')" for i, t in ((i, t.replace("'", "''")) for i, t in known_texts()))
    return f"""
WITH known AS (SELECT sha256(array_to_string({lines}, ' ')) AS digest, min(license) AS license FROM (VALUES {values}) AS k(license, text) GROUP BY 1),
docs AS (SELECT doc_id, {lines} AS lines FROM documents),
units AS (SELECT doc_id, true AS whole, sha256(array_to_string(lines, ' ')) AS digest FROM docs WHERE len(lines) > 0
  UNION ALL SELECT doc_id, false, sha256(line) FROM (SELECT doc_id, unnest(lines) AS line FROM docs)),
found AS (SELECT doc_id, min(license) FILTER (whole) AS text_license, string_agg(DISTINCT license, ',' ORDER BY license) FILTER (NOT whole) AS line_licenses,
  count(*) FILTER (NOT whole) AS n FROM units JOIN known USING (digest) GROUP BY doc_id)
SELECT d.doc_id, text_license, coalesce(line_licenses, '') AS line_licenses, coalesce(n, 0)::BIGINT AS n_license_lines
FROM documents d LEFT JOIN found USING (doc_id)
"""


@query("op8_licenses", license_sql())
def op8(spark, sf_dir):
    found = licenses.scan_licenses(table(spark, sf_dir, "documents"), licenses.known_digests(spark))
    return found.withColumn("line_licenses", F.array_join("line_licenses", ","))


def code_sql(parts: int, entries: int, rounds: int) -> str:
    step = """
near{k} AS MATERIALIZED (SELECT rid, part, min((xx + yy - 2 * list_inner_product(px, bx))::BIGINT * {entries} + entry) AS m FROM p JOIN b{k} USING (part) GROUP BY rid, part),"""
    update = """
cells{k} AS (SELECT part, m % {entries} AS entry, unnest(px) AS v, generate_subscripts(px, 1) AS pos FROM p JOIN near{k} USING (rid, part)),
sums{k} AS (SELECT part, entry, pos, sum(v)::BIGINT AS s, count(*) AS n FROM cells{k} GROUP BY part, entry, pos),
new{k} AS (SELECT part, entry, list(((s - ((s % n) + n) % n) // n)::DOUBLE ORDER BY pos) AS fresh FROM sums{k} GROUP BY part, entry),
b{next} AS MATERIALIZED (SELECT part, entry, bx, list_inner_product(bx, bx) AS yy FROM (SELECT b.part, b.entry, coalesce(fresh, bx) AS bx FROM b{k} b LEFT JOIN new{k} w ON w.part = b.part AND w.entry = b.entry)),"""
    steps = "".join(step.format(k=k, entries=entries) + (update.format(k=k, next=k + 1, entries=entries) if k < rounds else "") for k in range(rounds + 1))
    return f"""
WITH kept AS MATERIALIZED (
  SELECT row_number() OVER (ORDER BY vec_id NULLS LAST, x) - 1 AS rid, vec_id, label, x FROM (
    SELECT vec_id, label, list_transform(embedding, lambda x: floor(1024 * x::DOUBLE)) AS x FROM embeddings
    WHERE embedding IS NOT NULL AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0)),
p AS MATERIALIZED (SELECT rid, part, px, list_inner_product(px, px) AS xx FROM (
  SELECT rid, part, x[part * (len(x) // {parts}) + 1 : (part + 1) * (len(x) // {parts})] AS px FROM kept, (SELECT unnest(range({parts})) AS part))),
b0 AS MATERIALIZED (SELECT part, rid AS entry, px AS bx, xx AS yy FROM p WHERE rid < {entries}),{steps}
coded AS (SELECT rid, string_agg(printf('%02x', (m % {entries})::INT), '' ORDER BY part) AS code, sum(m // {entries})::BIGINT AS error FROM near{rounds} GROUP BY rid),
digest AS (SELECT sha256(string_agg(v::BIGINT::VARCHAR, ',' ORDER BY part, entry, pos)) AS d FROM (SELECT part, entry, unnest(bx) AS v, generate_subscripts(bx, 1) AS pos FROM b{rounds}))
SELECT vec_id, code, error, sum(error) OVER (PARTITION BY label)::BIGINT AS label_error, d AS codebooks_sha256
FROM kept JOIN coded USING (rid), digest
"""


@query("op11_vector_codes", code_sql(PARTS, ENTRIES, ROUNDS))
def op11(spark, sf_dir):
    rows, books = compress(table(spark, sf_dir, "embeddings"))
    listed = ",".join(map(str, books.ravel().tolist()))
    return rows.withColumn("codebooks_sha256", F.sha2(F.lit(listed).cast("binary"), 256))


# Windows are compared by their md5 digests, two hex digits a byte.
OP12_SQL = f"""
WITH docs AS MATERIALIZED (SELECT row_number() OVER () AS rid, doc_id, hex(encode(coalesce(text, ''))) AS h FROM documents),
wins AS MATERIALIZED (SELECT rid, i, md5_number(substr(h, 2 * i + 1, {2 * LENGTH})) AS w FROM (SELECT rid, h, unnest(range(len(h) // 2 - {LENGTH - 1})) AS i FROM docs)),
hits AS (SELECT rid, i FROM (SELECT rid, i, count(*) OVER (PARTITION BY w) AS n FROM wins) WHERE n > 1),
marks AS (SELECT rid, i, CASE WHEN i - lag(i) OVER (PARTITION BY rid ORDER BY i) <= {LENGTH} THEN 0 ELSE 1 END AS opens FROM hits),
runs AS (SELECT rid, min(i) AS a, max(i) + {LENGTH} AS b FROM (SELECT rid, i, sum(opens) OVER (PARTITION BY rid ORDER BY i) AS run FROM marks) GROUP BY rid, run),
gaps AS (SELECT rid, a, coalesce(lag(b) OVER (PARTITION BY rid ORDER BY a), 0) AS before FROM runs),
tail AS (SELECT rid, max(b) AS b, sum(b - a) AS n, count(*) AS k FROM runs GROUP BY rid),
heads AS (SELECT rid, string_agg(substr(h, 2 * before + 1, 2 * (a - before)), '' ORDER BY a) AS kept FROM gaps JOIN docs USING (rid) GROUP BY rid)
SELECT doc_id, (len(h) // 2)::BIGINT AS n_bytes, coalesce(n, 0)::BIGINT AS n_removed, coalesce(k, 0)::BIGINT AS n_spans,
  sha256(unhex(coalesce(kept, '') || substr(h, 2 * coalesce(b, 0) + 1))) AS kept_sha256
FROM docs LEFT JOIN tail USING (rid) LEFT JOIN heads USING (rid)
"""


@query("op12_repeats", OP12_SQL)
def op12(spark, sf_dir):
    found = remove_repeats(table(spark, sf_dir, "documents"))
    removed = (F.col("n_bytes") - F.octet_length("kept")).cast("long")
    return found.select("doc_id", "n_bytes", removed.alias("n_removed"), F.size("spans").cast("long").alias("n_spans"), F.sha2("kept", 256).alias("kept_sha256"))


@query("op13_whitening")
def op13(spark, sf_dir):
    return whiten(table(spark, sf_dir, "embeddings"))
