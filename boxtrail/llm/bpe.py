"""Byte-level BPE encoding and decoding in batched numpy merge rounds.

Texts are cut into words by the tokenizer's pattern; each distinct word of a cache filling is encoded once. The symbols of
many words lie in one flat array. A round looks every adjacent pair up in the sorted pair keys by binary search, takes each
word's lowest rank, and merges its occurrences from left to right, until no word has a known pair. A long unbroken word has an
array of its own, in which a round touches only the places of its rank.
"""

from __future__ import annotations

import functools
import heapq
import json
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import DataFrame

from boxtrail.llm.flat import slices
from boxtrail.session import ship_package

# The word pattern of the byte-level vocabulary.
PATTERN = r"'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"
CACHE_WORDS, CACHE_BYTES, LONG_WORD = 300_000, 32 << 20, 512
NONE = np.iinfo(np.int32).max


def byte_letters() -> dict[str, int]:
    """The printable letter that stands for each byte in the vocabulary file, back to the byte."""
    plain = [*range(33, 127), *range(161, 173), *range(174, 256)]
    rest = [b for b in range(256) if b not in set(plain)]
    return {chr(b): b for b in plain} | {chr(256 + k): b for k, b in enumerate(rest)}


class ByteBPE:
    """Tables of one vocabulary file and a bounded cache of encoded words."""

    def __init__(self, path: str, cache_words: int = CACHE_WORDS, cache_bytes: int = CACHE_BYTES):
        with open(path, encoding="utf-8") as f:
            file = json.load(f)
        vocab, letters = file["model"]["vocab"], byte_letters()
        self.special = {t["content"]: t["id"] for t in file["added_tokens"]}
        size = max(max(vocab.values()), *self.special.values()) + 1
        texts = [b""] * size
        for token, i in vocab.items():
            texts[i] = bytes(letters[c] for c in token) if token not in self.special else token.encode()
        for token, i in self.special.items():
            texts[i] = token.encode()
        self.token_bytes = np.frombuffer(b"".join(texts), dtype=np.uint8)
        self.token_at = np.concatenate(([0], np.cumsum([len(t) for t in texts])))
        self.of_byte = np.zeros(256, dtype=np.int64)
        for letter, b in letters.items():
            self.of_byte[b] = vocab[letter]
        pairs = [m if isinstance(m, list) else m.split(" ") for m in file["model"]["merges"]]
        key = np.array([vocab[a] << 32 | vocab[b] for a, b in pairs], dtype=np.int64)
        order = np.argsort(key, kind="stable")
        self.merge_key, self.pair_key, self.pair_rank = key, key[order], order.astype(np.int32)
        self.pair_new = np.array([vocab[a + b] for a, b in pairs], dtype=np.int64)
        self.pattern = regex.compile(PATTERN)
        self.cut = regex.compile("|".join(map(regex.escape, sorted(self.special, key=len, reverse=True)))) if self.special else None
        self.cache_words, self.cache_bytes = cache_words, cache_bytes
        self.forget()

    def forget(self) -> None:
        self.index = {token: k for k, token in enumerate(self.special)}
        self.ids = np.array([*self.special.values()], dtype=np.int64)
        self.at = np.arange(len(self.special) + 1)
        self.held = 0

    def words(self, text: str) -> list[str]:
        """Pattern words; special strings stand alone and split what surrounds them."""
        if self.cut is None or not any(s in text for s in self.special):
            return self.pattern.findall(text)
        out, at = [], 0
        for m in self.cut.finditer(text):
            out += [*self.pattern.findall(text[at : m.start()]), m[0]]
            at = m.end()
        return out + self.pattern.findall(text[at:])

    def rank_of(self, key: np.ndarray) -> np.ndarray:
        """Ranks of pair keys, ``NONE`` where a pair is unknown."""
        found = np.minimum(np.searchsorted(self.pair_key, key), len(self.pair_key) - 1)
        return np.where(self.pair_key[found] == key, self.pair_rank[found], NONE)

    def merge(self, words: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
        """Token ids of all words in one array, and the number of tokens of each."""
        long = [k for k, w in enumerate(words) if len(w) > LONG_WORD]
        if not long:
            return self.merge_flat(words)
        short = [k for k, w in enumerate(words) if len(w) <= LONG_WORD]
        ids, size = self.merge_flat([words[k] for k in short])
        parts = dict(zip(short, np.split(ids, np.cumsum(size)[:-1]), strict=True)) if short else {}
        parts |= {k: self.merge_long(words[k]) for k in long}
        ordered = [parts[k] for k in range(len(words))]
        return np.concatenate(ordered), np.array([*map(len, ordered)], dtype=np.int64)

    def merge_long(self, word: bytes) -> np.ndarray:
        """Token ids of one word. The places of each rank wait in a list, so the work follows the merges, not rounds times length."""
        sym = self.of_byte[np.frombuffer(word, dtype=np.uint8)]
        n = len(sym)
        after, before, alive = np.arange(1, n + 1), np.arange(-1, n - 1), np.ones(n, dtype=bool)
        waiting: dict[int, list[np.ndarray]] = {}
        ranks: list[int] = []

        def enlist(at: np.ndarray) -> None:
            at = at[after[at] < n]
            rank = self.rank_of(sym[at] << 32 | sym[after[at]])
            at, rank = at[rank < NONE], rank[rank < NONE]
            if not len(at):
                return
            order = np.argsort(rank, kind="stable")
            at, rank = at[order], rank[order]
            cuts = np.flatnonzero(np.append(True, rank[1:] != rank[:-1]))
            for r, places in zip(rank[cuts].tolist(), np.split(at, cuts[1:]), strict=True):
                if r not in waiting:
                    heapq.heappush(ranks, r)
                waiting.setdefault(r, []).append(places)

        enlist(np.arange(n))
        while ranks:
            r = heapq.heappop(ranks)
            at = np.unique(np.concatenate(waiting.pop(r)))
            at = at[alive[at]]
            at = at[after[at] < n]
            at = at[(sym[at] << 32 | sym[after[at]]) == self.merge_key[r]]
            if not len(at):
                continue
            at = at[every_second(after[at[:-1]] != at[1:])]
            gone = after[at]
            sym[at], alive[gone] = self.pair_new[r], False
            after[at] = after[gone]
            inner = after[at] < n
            before[after[at[inner]]] = at[inner]
            left = before[at]
            enlist(np.unique(np.concatenate((left[left >= 0], at))))
        return sym[alive]

    def merge_flat(self, words: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
        """All words in one array, a round for the lowest rank of each."""
        size = np.array([len(w) for w in words], dtype=np.int64)
        sym = self.of_byte[np.frombuffer(b"".join(words), dtype=np.uint8)]
        word = np.repeat(np.arange(len(words)), size)
        done_sym, done_word = [], []
        while len(sym):
            left, right = sym[:-1], sym[1:]
            key = left << 32 | right
            rank = np.append(np.where(word[:-1] == word[1:], self.rank_of(key), NONE), NONE)
            first = np.flatnonzero(np.append(True, word[1:] != word[:-1]))
            best = np.minimum.reduceat(rank, first)
            group = np.repeat(np.arange(len(first)), np.diff(np.append(first, len(sym))))
            open_ = (best < NONE)[group]
            done_sym.append(sym[~open_])
            done_word.append(word[~open_])
            take = open_ & (rank == best[group])
            at = np.flatnonzero(take)
            if len(at):
                at = at[every_second(np.diff(at) > 1)]
            sym = sym.copy()
            sym[at] = self.pair_new[rank[at]]
            open_[at + 1] = False
            sym, word = sym[open_], word[open_]
        sym, word = np.concatenate(done_sym or [np.zeros(0, np.int64)]), np.concatenate(done_word or [np.zeros(0, np.int64)])
        order = np.argsort(word, kind="stable")
        return sym[order], np.bincount(word, minlength=len(words))

    def encode(self, texts: list[str]) -> list[np.ndarray]:
        split = [self.words(t) for t in texts]
        seen = set().union(*split)
        new = [w for w in seen if w not in self.index]
        size = sum(map(len, new))
        if len(self.index) + len(new) > self.cache_words or self.held + size > self.cache_bytes:
            self.forget()
            new = [w for w in seen if w not in self.index]
            size = sum(map(len, new))
        if new:
            self.held += size
            ids, size = self.merge([w.encode() for w in new])
            self.index.update(zip(new, range(len(self.index), len(self.index) + len(new)), strict=True))
            self.ids = np.concatenate((self.ids, ids))
            self.at = np.concatenate((self.at, self.at[-1] + np.cumsum(size)))
        get = self.index.__getitem__
        return [gather(self.ids, self.at, np.fromiter(map(get, words), dtype=np.int64, count=len(words))) for words in split]

    def decode(self, ids: np.ndarray) -> str:
        return gather(self.token_bytes, self.token_at, ids).tobytes().decode("utf-8", "replace")


def every_second(apart: np.ndarray) -> np.ndarray:
    """Of occurrences that overlap their predecessor unless ``apart``, every second one of a run, from the left."""
    place = np.arange(len(apart) + 1)
    run = np.maximum.accumulate(np.where(np.append(True, apart), place, 0))
    return (place - run) % 2 == 0


def gather(flat: np.ndarray, at: np.ndarray, rows: np.ndarray) -> np.ndarray:
    """The concatenated slices ``flat[at[r]:at[r + 1]]`` of all rows."""
    size = at[rows + 1] - at[rows]
    total = np.cumsum(size)
    start = np.repeat(at[rows] - np.append(0, total[:-1]), size) if len(rows) else np.zeros(0, dtype=np.int64)
    return flat[start + np.arange(len(start))]


@functools.cache
def load(path: str) -> ByteBPE:
    return ByteBPE(path)


def encode_decode(documents: DataFrame, tokenizer_path: str, text: str = "text", key: str = "doc_id") -> DataFrame:
    """One row per document: key, ``n_tokens``, ``ids`` (little-endian unsigned 32-bit integers), ``decoded`` text.

    Null and empty texts have no ids and decode to an empty text. Special strings in a text become their special token.
    Repeated rows give repeated rows. Map-only; the cache of encoded words is bounded and does not change results.
    """
    ship_package(documents.sparkSession)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        bpe = load(tokenizer_path)
        for batch in batches:
            for part in slices(batch, "text", 1 << 20):
                ids = bpe.encode([t or "" for t in part.column("text").to_pylist()])
                yield pa.RecordBatch.from_arrays(
                    [part.column("key"), pa.array(map(len, ids), pa.int64()), pa.array([i.astype("<u4").tobytes() for i in ids], pa.binary()), pa.array([bpe.decode(i) for i in ids], pa.string())],
                    names=["key", "n_tokens", "ids", "decoded"],
                )

    rows = documents.select(documents[key].alias("key"), documents[text].alias("text"))
    kind = rows.schema["key"].dataType.simpleString()
    return rows.mapInArrow(run, f"key {kind}, n_tokens long, ids binary, decoded string").withColumnRenamed("key", key)
