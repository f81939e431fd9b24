"""Removal of repeated strings against a plain dictionary of all strings."""

import hashlib
from collections import Counter

import numpy as np
import pytest

from boxtrail.llm import queries as llm_queries
from boxtrail.llm import repeats

SCHEMA = "doc_id long, text string, key string, block long, n int"


def plain(texts, length):
    """(kept, spans) of each text."""
    raw = [(t or "").encode() for t in texts]
    seen = Counter(r[i : i + length] for r in raw for i in range(len(r) - length + 1))
    out = []
    for r in raw:
        gone = np.zeros(len(r) + 1, dtype=bool)
        for i in range(len(r) - length + 1):
            if seen[r[i : i + length]] > 1:
                gone[i : i + length] = True
        edge = np.flatnonzero(np.diff(np.concatenate(([False], gone)).astype(int)))
        out.append((bytes(b for b, g in zip(r, gone, strict=False) if not g), tuple(zip(edge[0::2].tolist(), edge[1::2].tolist(), strict=True))))
    return out


def check(spark, texts, length, group=repeats.GROUP, keys=None):
    keys = list(range(len(texts))) if keys is None else keys
    df = spark.createDataFrame([(k, t, "k", 5, 6) for k, t in zip(keys, texts, strict=True)], SCHEMA).repartition(3)
    found = sorted((str(r.doc_id), r.n_bytes, bytes(r.kept), tuple((s.start, s.end) for s in r.spans)) for r in repeats.remove_repeats(df, length=length, group=group).collect())
    expected = sorted((str(k), len((t or "").encode()), *p) for k, t, p in zip(keys, texts, plain(texts, length), strict=True))
    assert found == expected
    return found


def prose(rng, n):
    return " ".join(f"w{int(k)}" for k in rng.integers(0, 400, n))


def test_odd_texts(spark):
    rng = np.random.default_rng(1)
    one = prose(rng, 200)
    texts = [one, one, None, "", "short", one[:150], "é" * 300, "x" * 1000, prose(rng, 90) + one[300:600] + prose(rng, 90), one[100:299], one[100:300], one[100:301] + "!", "Ω≈" + one[50:] + "ç"]
    check(spark, texts, 200, keys=[1, 1, 2, None, None, 3, 4, 5, 6, 7, 8, 9, 10])


@pytest.mark.parametrize("length,group", [(12, repeats.GROUP), (12, 1), (40, 2), (5, 1), (2, 4), (64, 3)])
def test_small_strings_and_split_groups(spark, length, group):
    rng = np.random.default_rng(length + group)
    common = prose(rng, 30)
    texts = [prose(rng, 15) + common[: rng.integers(1, 90)] + prose(rng, 10) for _ in range(12)]
    texts += [common, common, "ab" * 60, "a" * 90, *texts[:2], None, "a\x00b" * 9]
    check(spark, texts, length, group)


def test_pieces_of_long_texts(spark, monkeypatch):
    rng = np.random.default_rng(9)
    text = prose(rng, 3000)
    data = np.frombuffer(text.encode(), np.uint8)
    bounds = np.array([0, 4000, 4100, len(data)])
    monkeypatch.setattr(repeats, "PIECE", 997)
    start, count, place = repeats.find_passages(data, bounds, 100)
    inside = [i for a, b in zip(bounds[:-1], bounds[1:], strict=True) for i in range(a, b - 99)]
    assert [s + k for s, c in zip(start, count, strict=True) for k in range(c)] == inside
    assert ((place >= start + count - 1) & (place + 25 <= start + 100)).all()
    runs = repeats.repeated_strings(repeats.byte_rows(data, np.array([0, 0, 50]), np.array([160, 160, 110])), np.array([70, 70, 20]), np.array([1, 1, 1]), np.array([False] * 3), 100)
    assert [x.tolist() for x in runs] == [[0, 1, 2], [0, 0, 0], [60, 60, 10]]


def test_very_long_text(spark):
    rng = np.random.default_rng(3)
    text = prose(rng, 300_000)
    raw = text.encode()
    assert len(raw) > repeats.PIECE
    df = spark.createDataFrame([(1, text), (2, text[1_040_000:1_050_000]), (3, "y" * 100_000)], "doc_id long, text string")
    found = {r.doc_id: [(s.start, s.end) for s in r.spans] for r in repeats.remove_repeats(df).collect()}
    assert found == {1: [(1_040_000, 1_050_000)], 2: [(0, 10_000)], 3: [(0, 100_000)]}


def test_query_columns_and_empty_table(spark, tmp_path):
    none = spark.createDataFrame([], SCHEMA)
    assert repeats.remove_repeats(none).count() == 0
    with pytest.raises(ValueError, match="bytes only"):
        repeats.remove_repeats(none, length=1)
    rng = np.random.default_rng(5)
    one = prose(rng, 150)
    texts = [one, "new " + one, prose(rng, 80), None]
    spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string").write.parquet(str(tmp_path / "documents.parquet"))
    expected = plain(texts, 200)
    for r in llm_queries.op12(spark, str(tmp_path)).collect():
        kept, spans = expected[r.doc_id]
        assert (r.n_bytes, r.n_removed, r.n_spans, r.kept_sha256) == (len((texts[r.doc_id] or "").encode()), r.n_bytes - len(kept), len(spans), hashlib.sha256(kept).hexdigest())
