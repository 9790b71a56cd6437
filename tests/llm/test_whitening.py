import math

import numpy as np
import pytest

from shiftwright.llm import queries, whitening

MIDDLE = "/root/testdata/sf0.01"


@pytest.mark.parametrize("seed", range(12))
def test_inertia_counts(seed):
    rng = np.random.default_rng(seed)
    n = int(rng.integers(1, 30))
    a = rng.normal(size=(n, n))
    a = a + a.T
    if seed % 3 == 0:
        np.fill_diagonal(a, 0)
    values = np.linalg.eigvalsh(a)
    for shift in [0.0, *((values[1:] + values[:-1]) / 2)]:
        assert whitening.above(a, shift) == (values > shift).sum()


@pytest.mark.parametrize("kind", ["plain", "repeated", "close", "rank", "one", "scaled", "identity", "wide"])
def test_contour_finds_the_leading_pairs(kind):
    rng = np.random.default_rng(3)
    n = 1 if kind == "one" else 40
    basis, _ = np.linalg.qr(rng.normal(size=(n, n)))
    values = {
        "plain": rng.random(n), "repeated": np.repeat(rng.random(8), 5), "close": 1 + np.arange(n) * 1e-7,
        "rank": np.append(rng.random(3), np.zeros(max(0, n - 3)))[:n], "one": np.array([7.0]), "scaled": rng.random(n) * 1e20,
        "identity": np.ones(n), "wide": 10.0 ** -np.arange(n),
    }[kind]
    v = basis @ np.diag(values) @ basis.T
    v = (v + v.T) / 2
    found, vectors = whitening.leading(v, 8)
    wanted = np.sort(values)[::-1][:8]
    assert np.allclose(found, wanted, rtol=0, atol=1e-13 * n * wanted[0])
    assert np.allclose(vectors.T @ vectors, np.eye(len(found)), atol=1e-13)
    assert np.abs(v @ vectors - vectors * found).max() <= 1e-13 * n * wanted[0]


def test_query_equals_brute_force(spark):
    table = spark.read.parquet(f"{MIDDLE}/embeddings.parquet").collect()
    kept = [r for r in table if r.embedding is not None and all(x is not None and math.isfinite(x) for x in r.embedding)]
    x = [[math.floor(1024 * float(c)) + 100_000 for c in r.embedding] for r in kept]
    n, sums = len(x), [sum(c) for c in zip(*x)]
    v = np.cov(np.array(x, float).T, bias=True)
    values, vectors = np.linalg.eigh(v)
    values, vectors = values[::-1], vectors[:, ::-1]
    scores = (np.array(x, float) - np.array(sums) / n) @ vectors / np.sqrt(values)
    rows = queries.op13_whitening(spark, MIDDLE).collect()
    assert len(rows) == 8 * n
    place = {r.vec_id: i for i, r in enumerate(kept)}
    found = np.zeros((n, 8))
    for r in rows:
        i = place[r.vec_id]
        found[i, r.component - 1] = r.whitened
        assert r.n == n and r.deviation == sum((n * a - s) ** 2 for a, s in zip(x[i], sums))
        assert r.explained == pytest.approx(values[r.component - 1] / np.trace(v), rel=1e-10)
    sign = np.sign((found * scores[:, :8]).sum(axis=0))
    assert np.abs(found * sign - scores[:, :8]).max() < 1e-9
    error = np.abs(np.cov(found.T, bias=True) - np.eye(8)).max()
    assert {r.identity_error for r in rows} == {rows[0].identity_error}
    assert rows[0].identity_error <= 1e-9 and error <= 1e-9


def table(spark, rows):
    return spark.createDataFrame(rows, "vec_id long, embedding array<double>")


def test_edges(spark):
    assert whitening.whiten(table(spark, [])).collect() == []
    odd = [(1, None), (2, [math.nan]), (3, [1.0, None]), (4, [-math.inf, 0.0]), (5, [])]
    assert whitening.whiten(table(spark, odd)).collect() == []
    # One vector, or copies of one: nothing varies.
    for rows in ([(1, [1.0, 2.0])], [(None, [1.0, 2.0])] * 3):
        found = whitening.whiten(table(spark, odd + rows)).collect()
        assert len(found) == 2 * len(rows)
        assert {(r.n, r.deviation, r.whitened, r.explained, r.identity_error) for r in found} == {(len(rows), 0, None, None, None)}
    # Two lengths are two fits; huge components are bounded; a dimension without variance has no whitened value.
    rng = np.random.default_rng(0)
    rows = [(2**62 + i, [float(a), 5.0, float(b)]) for i, (a, b) in enumerate(rng.normal(size=(50, 2)))]
    rows += [(i, [float(i), 1e300 if i == 3 else 0.0]) for i in range(9)]
    found = whitening.whiten(table(spark, rows)).collect()
    assert len(found) == 50 * 3 + 9 * 2
    first = [r for r in found if r.vec_id >= 2**62]
    assert len({r.vec_id for r in first}) == 50 and {r.n for r in first} == {50}
    assert all((r.whitened is None) == (r.component == 3) for r in first)
    assert found[0].identity_error < 1e-9
    for r in found:
        if r.vec_id < 2**62:
            assert r.n == 9 and r.deviation is not None


def test_extra_columns_play_no_part(spark):
    rows = [(i, [float(i % 5), float(i % 3)], i, i, "a") for i in range(30)]
    wide = spark.createDataFrame(rows, "vec_id long, embedding array<double>, dim long, n long, whitened string")
    plain = whitening.whiten(table(spark, [r[:2] for r in rows])).collect()
    assert sorted(whitening.whiten(wide).collect()) == sorted(plain)


def test_sums_of_tasks_do_not_matter(spark):
    rng = np.random.default_rng(2)
    rows = [(i, rng.normal(size=5).tolist()) for i in range(200)]
    one, many = {}, {}
    whitening.whiten(table(spark, rows).coalesce(1), fits=one)
    whitening.whiten(table(spark, rows).repartition(13), fits=many)
    assert (one[5].vectors == many[5].vectors).all() and (one[5].values == many[5].values).all()
