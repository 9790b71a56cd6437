import hashlib
import math

import numpy as np
import pytest

from shiftwright.llm import clustering


def brute(vectors, k, rounds, scale=1024, dim=4):
    """Plain Python: every distance in every round."""
    kept = [(i, [max(-(1 << 27), min(1 << 27, math.floor(max(-1e30, min(1e30, scale * float(x)))))) for x in v]) for i, v in vectors
            if v is not None and len(v) == dim and all(x is not None and math.isfinite(x) for x in v)]
    first = sorted(kept, key=lambda r: (hashlib.sha256(f"3:{'null' if r[0] is None else r[0]}".encode()).hexdigest(), r[1]))
    centroids = [list(x) for _, x in first[:k]]

    def nearest(x):
        return min((sum((a - b) ** 2 for a, b in zip(x, c)), j) for j, c in enumerate(centroids))

    for _ in range(rounds):
        own = [nearest(x)[1] for _, x in kept]
        for j in range(len(centroids)):
            mine = [x for (_, x), o in zip(kept, own) if o == j]
            if mine:
                centroids[j] = [sum(c) // len(mine) for c in zip(*mine)]
    out = [(i, *nearest(x)[::-1]) for i, x in kept]
    total = sum(d for *_, d in out)
    by = {j: sum(d for _, o, d in out if o == j) for j in range(len(centroids))}
    return sorted(((i, j, d, by[j], total, tuple(centroids[j])) for i, j, d in out), key=str)


def rows_of(df):
    return sorted(((r.vec_id, r.cluster, r.distance, r.cluster_inertia, r.inertia, tuple(r.centroid)) for r in df.collect()), key=str)


def table(spark, vectors, parts=3):
    return spark.createDataFrame(vectors, "vec_id long, embedding array<double>").repartition(parts)


@pytest.mark.parametrize("k,rounds,spread", [(1, 2, 1.0), (5, 10, 1.0), (8, 10, 0.02), (3, 0, 1.0), (6, 4, 1e4)])
def test_equals_brute_force(spark, monkeypatch, k, rounds, spread):
    monkeypatch.setattr(clustering, "BLOCK_ROWS", 17)
    rng = np.random.default_rng(k)
    vectors = [(i, (rng.normal(size=4) * spread + rng.integers(0, 3) * spread).tolist()) for i in range(300)]
    found = clustering.cluster(table(spark, vectors), k=k, rounds=rounds, dim=4)
    assert rows_of(found) == brute(vectors, k, rounds)


def test_edges(spark):
    odd = [(1, None), (2, []), (3, [1.0, 2.0, 3.0]), (4, [1.0, None, 0.0, 0.0]), (5, [math.nan, 0.0, 0.0, 0.0]),
           (6, [math.inf, 0.0, 0.0, 0.0])]
    good = [(7, [0.5, -0.5, 0.25, 0.0]), (7, [0.5, -0.5, 0.25, 0.0]), (8, [0.0, 0.0, 0.0, -0.0]), (None, [0.1, 0.1, 0.1, 0.1]),
            (2**62 + 1, [1e300, -1e300, 1e5, 0.0])]
    assert clustering.cluster(table(spark, odd), dim=4).collect() == []
    assert clustering.cluster(spark.createDataFrame([], "vec_id long, embedding array<float>")).collect() == []
    for vectors in (good, odd + good, good * 40):
        assert rows_of(clustering.cluster(table(spark, vectors), k=3, dim=4)) == brute(vectors, 3, 10)


def test_extra_columns_play_no_part(spark):
    vectors = [(i, [float(i % 7), float(i % 3), 0.0, 1.0], i, i) for i in range(40)]
    wide = spark.createDataFrame(vectors, "vec_id long, embedding array<double>, cluster long, x long")
    assert rows_of(clustering.cluster(wide, k=3, dim=4)) == brute([v[:2] for v in vectors], 3, 10)


def test_bounds_save_distances_and_do_not_change_the_result(spark):
    rng = np.random.default_rng(1)
    middles = rng.normal(size=(6, 4)) * 3
    vectors = [(i, (middles[i % 6] + rng.normal(size=4) * 0.3).tolist()) for i in range(3000)]
    report = []
    found = clustering.cluster(table(spark, vectors), k=6, rounds=10, dim=4, report=report)
    assert rows_of(found) == brute(vectors, 6, 10)
    assert report[0] == 3000 * 6
    assert sum(report[1:]) < 0.3 * 10 * 3000 * 6


def test_total_displacement_is_not_the_sum_of_moves():
    # The centroid went away and came back: the stored distance is exact again, nothing is evaluated.
    rows = np.array([[0, 0], [100, 0]])
    history = np.array([[[0, 0], [100, 0]], [[40, 0], [60, 0]], [[0, 0], [100, 0]]])
    own, last, when = np.zeros(2, np.int64), np.zeros((2, 2)), np.full((2, 2), -1, np.int16)
    assert clustering.reassign(rows, own, last, when, history[:1], clustering.moved(history[:1])) == 4
    before = last.copy()
    assert clustering.reassign(rows, own, last, when, history, clustering.moved(history)) == 0
    assert (last == before).all() and own.tolist() == [0, 1]
