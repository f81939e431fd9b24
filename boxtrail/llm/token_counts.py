"""Token counts of whole texts with a public tokenizer, lengths only.

The word tokenizer drops white space and never joins characters across it, so ASCII white space is a safe place to cut:
the count of a text is the sum of the counts of its words. Words are encoded in batches balanced by bytes, each distinct
word once per cache filling; no token ids are kept.
"""

from __future__ import annotations

import functools
import os
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame

from boxtrail.llm.flat import slices
from boxtrail.session import ship_package

BATCH_BYTES = 1 << 18
CACHE_WORDS, CACHE_BYTES = 500_000, 64 << 20


@functools.cache
def load_tokenizer(path: str):
    os.environ["TOKENIZERS_PARALLELISM"] = "false"
    from tokenizers import Tokenizer

    tokenizer = Tokenizer.from_file(path)
    tokenizer.no_truncation()
    tokenizer.no_padding()
    return tokenizer


class WordCounter:
    """Token counts of words, with a cache bounded in words and bytes (emptied when full, so results never depend on it)."""

    def __init__(self, path: str, batch_bytes: int = BATCH_BYTES, cache_words: int = CACHE_WORDS):
        self.tokenizer = load_tokenizer(path)
        self.batch_bytes, self.cache_words = batch_bytes, cache_words
        self.cache: dict[bytes, int] = {}
        self.held = 0

    def learn(self, words: set[bytes]) -> None:
        batch, size = [], 0
        for word in words:
            batch.append(word)
            size += len(word)
            if size >= self.batch_bytes:
                self._encode(batch)
                batch, size = [], 0
        if batch:
            self._encode(batch)

    def _encode(self, batch: list[bytes]) -> None:
        found = self.tokenizer.encode_batch_fast([w.decode() for w in batch], add_special_tokens=False)
        self.cache.update(zip(batch, map(len, found), strict=True))

    def count(self, texts: list[bytes]) -> list[int]:
        split = [t.split() for t in texts]  # bytes.split cuts at ASCII white space only
        seen = set().union(*split)
        new = seen.difference(self.cache)
        size = sum(map(len, new))
        if len(self.cache) + len(new) > self.cache_words or self.held + size > CACHE_BYTES:
            self.cache.clear()
            new, self.held = seen, 0
            size = sum(map(len, new))
        self.held += size
        self.learn(new)
        get = self.cache.__getitem__
        return [sum(map(get, words)) for words in split]


def count_tokens(documents: DataFrame, tokenizer_path: str, text: str = "text", key: str = "doc_id", limit: int = 2048) -> DataFrame:
    """One row per document: key, ``n_bytes``, ``n_tokens``, ``over_limit`` (more than ``limit`` tokens).

    Null and empty texts have 0 bytes and tokens. Repeated rows give repeated rows; other columns are not read, so their
    names cannot clash. Map-only: no shuffle, and a lost executor repeats its own partitions.
    """
    ship_package(documents.sparkSession)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        counter = WordCounter(tokenizer_path)
        for batch in batches:
            for part in slices(batch, "text"):
                texts = [t or b"" for t in part.column("text").cast(pa.binary()).to_pylist()]
                counts = counter.count(texts)
                yield pa.RecordBatch.from_arrays(
                    [part.column("key"), pa.array(map(len, texts), pa.int64()), pa.array(counts, pa.int64()), pa.array([n > limit for n in counts], pa.bool_())],
                    names=["key", "n_bytes", "n_tokens", "over_limit"],
                )

    rows = documents.select(documents[key].alias("key"), documents[text].alias("text"))
    kind = rows.schema["key"].dataType.simpleString()
    return rows.mapInArrow(run, f"key {kind}, n_bytes long, n_tokens long, over_limit boolean").withColumnRenamed("key", key)
