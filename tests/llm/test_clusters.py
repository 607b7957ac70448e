"""Clustering against plain loops over all centroids."""

import hashlib
import random

import numpy as np
import pytest

from cadenza.llm import clusters

SCHEMA = "vec_id long, embedding array<float>, label int, cluster string, distance string"


def plain(rows, k=16, rounds=3, size=64, scale=64):
    """(vec_id, cluster, distance, ...) by exact integers and all distances."""
    kept = [(i, [int(np.floor(scale * float(np.float32(v)))) for v in e]) for i, e in rows
            if e is not None and len(e) == size and all(v is not None and np.isfinite(v) for v in e)]
    order = sorted(kept, key=lambda r: (hashlib.sha256(f"1:{r[0]}".encode()).hexdigest(), r[1]))
    centroids = [x for _, x in order[:k]]

    def assign():
        return [min((sum((a - b) ** 2 for a, b in zip(x, c)), n) for n, c in enumerate(centroids)) for _, x in kept]

    for _ in range(rounds):
        found = assign()
        for n in range(len(centroids)):
            mine = [x for (_, x), (_, own) in zip(kept, found) if own == n]
            if mine:
                centroids[n] = [sum(c) // len(mine) for c in zip(*mine)]
    found = assign()
    by = {n: sum(d for d, own in found if own == n) for n in range(len(centroids))}
    text = [hashlib.sha256(",".join(map(str, c)).encode()).hexdigest() for c in centroids]
    return sorted((i, n, d, by[n], sum(by.values()), text[n]) for (i, _), (d, n) in zip(kept, found))


def run(spark, rows, **options):
    frame = spark.createDataFrame([(i, e, 0, "a", "b") for i, e in rows], SCHEMA)
    got = clusters.cluster_vectors(frame, **options).collect()
    return sorted((r.vec_id, r.cluster, r.distance, r.cluster_inertia, r.inertia, r.centroid_sha256) for r in got)


@pytest.mark.parametrize("seed", [1, 2])
def test_equals_plain_version(spark, seed):
    rng = np.random.default_rng(seed)
    heads = rng.normal(size=(5, 64))
    rows = [(k, (heads[k % 5] + rng.normal(size=64) * 0.3 * (k % 3)).tolist()) for k in range(120)]
    assert run(spark, rows) == plain(rows)


def test_ties_repeats_and_odd_rows(spark):
    nan, inf = float("nan"), float("inf")
    rng = random.Random(4)
    rows = [(k, [rng.choice((-0.02, 0.0, 0.02)) for _ in range(3)]) for k in range(60)]
    rows += [(3, [0.02, 0.0, 0.0]), (3, [0.02, 0.0, 0.0]), (70, None), (71, []), (72, [1.0, 2.0]), (73, [1.0, nan, 0.0]), (74, [1.0, inf, 0.0]), (75, [None, 0.0, 0.0])]
    assert run(spark, rows, k=4, size=3) == plain(rows, k=4, size=3)


def test_few_rows_and_none(spark):
    rows = [(5, [1.0, -1.0]), (6, [1.0, -1.0])]
    assert run(spark, rows, size=2) == plain(rows, size=2)
    assert run(spark, [], size=2) == [] == run(spark, [(1, None)], size=2)


def test_null_id_and_huge_components(spark):
    rows = [(None, [1e30, -1e30]), (1, [0.0, 0.0]), (2, [1e30, 1e30])]
    frame = spark.createDataFrame([(i, e, 0, "a", "b") for i, e in rows], SCHEMA)
    got = {r.vec_id: r for r in clusters.cluster_vectors(frame, k=2, size=2).collect()}
    assert len(got) == 3 and all(r.distance >= 0 for r in got.values())


def test_pivot_bounds_only_skip(monkeypatch):
    """Same result as all distances, with fewer of them."""
    rng = np.random.default_rng(7)
    heads = rng.integers(-200, 200, (8, 16))
    x = np.repeat(heads, 50, axis=0) + rng.integers(-3, 4, (400, 16))
    centroids = np.concatenate([heads, heads[:2], x[:1]])
    points = clusters.pivots(centroids, 4)
    far = np.stack([((x - p) ** 2).sum(axis=1) for p in points], axis=1)
    number, best, measured = clusters.nearest(x, far, centroids, points)
    every = ((x[:, None] - centroids[None]) ** 2).sum(axis=2)
    assert (best == every.min(axis=1)).all() and (number == every.argmin(axis=1)).all()
    assert measured < 0.5 * every.size


def test_large_distances_stay_exact():
    x = np.array([[clusters.LIMIT - 1, -clusters.LIMIT], [clusters.LIMIT, -clusters.LIMIT]], np.int64)
    centroids = np.array([[-clusters.LIMIT, clusters.LIMIT], [clusters.LIMIT, -clusters.LIMIT + 1]], np.int64)
    points = clusters.pivots(centroids)
    far = np.stack([((x - p) ** 2).sum(axis=1) for p in points], axis=1)
    number, best, _ = clusters.nearest(x, far, centroids, points)
    assert number.tolist() == [1, 1] and best.tolist() == [2, 1]
