"""Vector codes and whitening against plain loops, on rows with nulls, odd components, ties, repeats and other columns."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from boxtrail.llm import queries as llm_queries
from boxtrail.llm import vector_codes, whitening
from boxtrail.llm.vectors import integer_vectors

SCHEMA = "vec_id long, embedding array<float>, label int, key string, x int, code string"


def table_of(spark, vectors, extra=()):
    rows = [(k, [float(c) for c in v], k % 3 if k % 4 else None, "k", 1, "c") for k, v in enumerate(vectors)]
    return spark.createDataFrame([*rows, *((*r, "k", 1, "c") for r in extra)], SCHEMA).repartition(3)


def odd_rows(like):
    broken = [float(c) for c in like]
    return [(900, None, 1), (901, [*broken[:-1], None], 1), (902, [*broken[:-1], float("nan")], 1), (903, [*broken[:-1], float("inf")], 1), (3, broken, 2), (3, broken, 2), (None, broken, None)]


def plain_codes(rows, parts, entries, rounds):
    """Every distance, one after the other."""
    rows = sorted(rows, key=lambda r: (r[0] is None, r[0] or 0, r[2]))
    wide = len(rows[0][2]) // parts
    cut = lambda x, p: x[p * wide : (p + 1) * wide]
    books = [[cut(r[2], p) for r in rows[:entries]] for p in range(parts)]
    best = lambda x, book: min((sum((a - b) ** 2 for a, b in zip(x, e, strict=True)), i) for i, e in enumerate(book))
    for _ in range(rounds):
        for p in range(parts):
            groups = {}
            for r in rows:
                groups.setdefault(best(cut(r[2], p), books[p])[1], []).append(cut(r[2], p))
            books[p] = [[sum(c) // len(c) for c in zip(*groups[i], strict=True)] if i in groups else e for i, e in enumerate(books[p])]
    found = []
    for key, label, x in rows:
        own = [best(cut(x, p), books[p]) for p in range(parts)]
        found.append((key, label, "".join(f"{i:02x}" for _, i in own), sum(e for e, _ in own)))
    totals = {}
    for _, label, _, error in found:
        totals[label] = totals.get(label, 0) + error
    return sorted(((str(k), c, e, totals[label]) for k, label, c, e in found)), books


def floored(vectors, offset=0):
    return [[int(np.floor(1024 * c)) + offset for c in np.float32(v).astype(float)] for v in vectors]


def kept_rows(df):
    rows = [(r.vec_id, r.label, r.embedding) for r in df.collect()]
    rows = [r for r in rows if r[2] is not None and all(c is not None and np.isfinite(c) for c in r[2])]
    return [(k, label, x) for (k, label, _), x in zip(rows, floored([r[2] for r in rows]), strict=True)]


@pytest.mark.parametrize("dims,entries", [(8, 5), (12, 7), (64, 256), (4, 256)])
def test_codes_equal_plain_search(spark, dims, entries):
    rng = np.random.default_rng(dims)
    vectors = rng.normal(0, 0.02, (60, dims)).round(2 if dims == 4 else 4)
    df = table_of(spark, vectors, odd_rows(vectors[5]))
    found, books = vector_codes.compress(df, entries=entries)
    expected, plain = plain_codes(kept_rows(df), 4, entries, 4)
    assert books.tolist() == plain
    assert sorted((str(r.vec_id), r.code, r.error, r.label_error) for r in found.collect()) == expected


def test_nearest_is_exact_and_takes_the_lower_index():
    rng = np.random.default_rng(1)
    for wide in (1, 2, 3, 16, 21):
        parts, entries = rng.integers(-40, 40, (300, wide)), rng.integers(-40, 40, (50, wide))
        entries[30:] = entries[:20]
        full = ((parts[:, None] - entries[None]) ** 2).sum(2)
        at, error = vector_codes.nearest(parts, entries)
        assert (at == full.argmin(1)).all() and (error == full.min(1)).all()
    far = np.array([[1 << 24] * 16, [-(1 << 24)] * 16])
    assert vector_codes.nearest(far, far[::-1])[1].tolist() == [0, 0]


def test_transform_keeps_scaled_distances_in_sequency_order():
    x = np.arange(12).reshape(2, 6)
    t = vector_codes.walsh_hadamard(x)
    assert t.shape == (2, 8) and ((t[0] - t[1]) ** 2).sum() == 8 * ((x[0] - x[1]) ** 2).sum()
    signs = vector_codes.walsh_hadamard(np.eye(8, dtype=np.int64)).T
    assert [int((r[1:] != r[:-1]).sum()) for r in signs] == list(range(8))


def test_codes_of_odd_tables(spark):
    none = spark.createDataFrame([], SCHEMA)
    found, books = vector_codes.compress(none)
    assert found.count() == 0 and books.size == 0
    one = table_of(spark, [[0.5] * 8])
    found, books = vector_codes.compress(one)
    assert [tuple(r) for r in found.collect()] == [(0, "00000000", 0, 0)] and books.shape == (4, 1, 2)
    with pytest.raises(ValueError, match="equal parts"):
        vector_codes.compress(table_of(spark, [[0.5] * 6]))
    with pytest.raises(ValueError, match="different lengths"):
        vector_codes.compress(table_of(spark, [[0.5] * 8, [0.5] * 4]))
    with pytest.raises(ValueError, match="too large"):
        vector_codes.compress(table_of(spark, [[1e9] * 64]))


def test_code_query_and_digest(spark, tmp_path):
    import hashlib

    rng = np.random.default_rng(8)
    table_of(spark, rng.normal(0, 0.1, (300, 8))).write.parquet(str(tmp_path / "embeddings.parquet"))
    found = llm_queries.op11(spark, str(tmp_path)).collect()
    expected, plain = plain_codes(kept_rows(spark.read.parquet(str(tmp_path / "embeddings.parquet"))), 4, 256, 4)
    digest = hashlib.sha256(",".join(str(c) for book in plain for e in book for c in e).encode()).hexdigest()
    assert sorted((str(r.vec_id), r.code, r.error, r.label_error) for r in found) == expected
    assert {r.codebooks_sha256 for r in found} == {digest}


def plain_whitening(x):
    x = np.array(x, dtype=object)
    n, sums = len(x), x.sum(axis=0)
    deviation = [int(((n * r - sums) ** 2).sum()) for r in x]
    centred = np.array([[float(c) for c in r] for r in x - np.array([s / n for s in sums])])
    values, vectors = np.linalg.eigh(centred.T @ centred / n)
    return deviation, centred, values[::-1], vectors[:, ::-1]


def test_whitening_equals_eigenvectors(spark):
    rng = np.random.default_rng(4)
    mixed = rng.normal(0, 1, (400, 12)) @ np.diag(0.7 ** np.arange(12)) @ rng.normal(0, 1, (12, 12))
    df = table_of(spark, mixed, odd_rows(mixed[7]))
    x = [[c + 100000 for c in v] for _, _, v in kept_rows(df)]
    keys = [k for k, _, _ in kept_rows(df)]
    deviation, centred, values, vectors = plain_whitening(x)
    found = {}
    for r in whitening.whiten(df).collect():
        found.setdefault(r.component, []).append((str(r.vec_id), r.deviation, abs(r.whitened)))
        assert r.n == len(x) and r.identity_error <= 1e-4
        assert r.explained == pytest.approx(values[r.component - 1] / values.sum(), rel=1e-9)
    assert set(found) == set(range(1, 9))
    for j, rows in found.items():
        white = np.abs(centred @ vectors[:, j - 1]) / np.sqrt(values[j - 1])
        expected = sorted(zip(map(str, keys), deviation, white.tolist(), strict=True))
        assert [r[:2] for r in sorted(rows)] == [r[:2] for r in expected]
        assert np.allclose([r[2] for r in sorted(rows)], [r[2] for r in expected], atol=1e-8)
    assert whitening.whiten(df).count() == 8 * len(x)


def test_factor_and_rotations():
    rng = np.random.default_rng(2)
    for d, rank in ((1, 1), (5, 5), (9, 4), (32, 31)):
        a = rng.normal(0, 1, (d, rank)) * 10.0 ** rng.uniform(-3, 3, rank)
        v = a @ a.T
        factor, order = whitening.pivoted_cholesky(v)
        assert factor.shape == (d, rank) and np.allclose(factor @ factor.T, v[order][:, order], rtol=1e-10, atol=1e-12 * v.max())
        assert np.allclose(np.triu(factor, 1), 0)
        values, components = whitening.principal_components(v)
        assert np.allclose(components.T @ components, np.eye(rank), atol=1e-9)
        assert np.allclose(v @ components, components * values, atol=1e-9 * v.max())
        assert (np.diff(values) <= 0).all()
    for n in range(1, 9):
        pairs = [(int(a), int(b)) for p, q in whitening.rounds_of_pairs(n) for a, b in zip(p, q, strict=True)]
        assert sorted(pairs) == [(a, b) for a in range(n) for b in range(a + 1, n)]


def test_whitening_of_odd_tables(spark):
    assert whitening.whiten(spark.createDataFrame([], SCHEMA)).count() == 0
    assert whitening.whiten(table_of(spark, [[0.5, 0.25]])).count() == 0
    assert whitening.whiten(table_of(spark, [[0.5, 0.25]] * 9)).count() == 0
    line = whitening.whiten(table_of(spark, [[0.5 * k, 0.25 * k, 3.0] for k in range(5)])).collect()
    assert {r.component for r in line} == {1} and len(line) == 5
    assert [r.explained for r in line] == pytest.approx([1.0] * 5)
    # Deviations beyond a long are null, the others exact.
    wide = whitening.whiten(table_of(spark, [[2.0e6 * k, 1.0] for k in range(41)]))
    x = [[int(1024 * 2.0e6 * k) + 100000, 1024 + 100000] for k in range(41)]
    exact = dict(enumerate(plain_whitening(x)[0]))
    assert all(r.deviation == (exact[r.vec_id] if exact[r.vec_id] < 1 << 63 else None) for r in wide.collect())
    assert any(v >= 1 << 63 for v in exact.values()) and any(v < 1 << 63 for v in exact.values())


def test_integer_vectors_floor_down(spark):
    df = spark.createDataFrame([(1, [-0.0001, 0.0001, -1.0])], "vec_id long, embedding array<float>")
    assert integer_vectors(df, "embedding", {"key": F.col("vec_id")}, 5).first().x == [4, 5, -1019]
