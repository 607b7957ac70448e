"""Clustering of vectors around centroids with a pivot table.

Each vector's distances to a few fixed pivots are stored once.  In every round a centroid's
distances to the same pivots bound its distance to a vector from below (by the triangle
inequality, the largest difference of the two rows); only centroids that the bound does not
rule out get an exact distance, in integers.
"""

from __future__ import annotations

from collections.abc import Callable, Iterable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from cadenza.llm.base import sha
from cadenza.session import stage

SIZE, CENTROIDS, ROUNDS, SCALE = 64, 16, 3, 64
PIVOTS = 8
#: Whole components are held in this range, so that squared distances fit 64 bits.
LIMIT = 2**27


def whole_vectors(embeddings: DataFrame, size: int = SIZE, scale: int = SCALE) -> DataFrame:
    """vec_id and the components as integers ``floor(scale * x)``, of the rows that can be clustered.

    A row goes if its vector is null, has not ``size`` components, or holds a null or
    non-finite one.
    """
    x = F.col("embedding")
    good = x.isNotNull() & (F.size(x) == size) & F.forall(
        x, lambda v: v.isNotNull() & ~F.isnan(v) & (F.abs(v) < F.lit(float("inf")))
    )
    bounded = F.transform(x, lambda v: F.greatest(F.lit(-LIMIT), F.least(F.lit(LIMIT), F.floor(v * scale))).cast("int"))
    rows = embeddings.select("vec_id", F.col("embedding").cast("array<double>").alias("embedding"))
    return rows.where(F.coalesce(good, F.lit(False))).select("vec_id", bounded.alias("x"))


def first_centroids(vectors: DataFrame, k: int = CENTROIDS) -> np.ndarray:
    """The ``k`` vectors with the smallest hash of their id, in order of the hash."""
    order = F.sha2(F.concat(F.lit("1:"), F.col("vec_id").cast("string")), 256)
    some = vectors.select(order.alias("h"), "x").orderBy(F.col("h").asc_nulls_last(), "x").limit(k).collect()
    return np.array([r.x for r in some], np.int64)


def pivots(candidates: np.ndarray, n: int = PIVOTS) -> np.ndarray:
    """Up to ``n`` of the candidates, each the one furthest from those before it."""
    chosen: list[int] = []
    away = np.full(len(candidates), np.inf)
    while len(chosen) < min(n, len(candidates)) and away.max() > 0:
        chosen.append(int(away.argmax()))
        away = np.minimum(away, _squares(candidates, candidates[chosen[-1]]))
    return candidates[chosen]


def _squares(x: np.ndarray, point: np.ndarray) -> np.ndarray:
    """Exact squared distances of rows to one point."""
    difference = x - point
    return np.einsum("ij,ij->i", difference, difference)


def _matrix(column: pa.Array) -> np.ndarray:
    return column.flatten().to_numpy(zero_copy_only=False).astype(np.int64).reshape(len(column), -1)


def pivot_table(vectors: DataFrame, points: np.ndarray) -> DataFrame:
    """``vectors`` with ``far``, the squared distances to each pivot; written once."""

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in filter(len, batches):
            x = _matrix(batch.column("x"))
            far = np.stack([_squares(x, p) for p in points], axis=1)
            ends = pa.array(np.arange(len(x) + 1, dtype=np.int32) * far.shape[1])
            yield pa.RecordBatch.from_arrays(
                [*batch.columns, pa.ListArray.from_arrays(ends, pa.array(far.ravel()))], [*batch.schema.names, "far"]
            )

    schema = T.StructType([*vectors.schema, T.StructField("far", T.ArrayType(T.LongType()))])
    return stage(vectors.mapInArrow(run, schema), "pivots")


def nearest(x: np.ndarray, far: np.ndarray, centroids: np.ndarray, points: np.ndarray) -> tuple[np.ndarray, np.ndarray, int]:
    """Number and squared distance of each row's nearest centroid, and how many distances that took.

    Each row first measures the centroid with the least bound; others are measured in order of
    their number where their bound does not exceed the best distance so far, so that of equally
    near centroids the smaller number wins.
    """
    rows = np.arange(len(x))
    own = np.sqrt(far.astype(np.float64))
    other = np.sqrt(np.stack([_squares(centroids, p) for p in points], axis=1).astype(np.float64))
    bounds = np.zeros((len(x), len(centroids)))
    for k in range(len(points)):
        np.maximum(bounds, np.abs(own[:, k, None] - other[None, :, k]), out=bounds)
    # what rounding may add to a bound
    bounds -= 1e-9 * (1 + max(own.max(initial=0), other.max(initial=0)))
    number = bounds.argmin(axis=1)
    difference = x - centroids[number]
    best = np.einsum("ij,ij->i", difference, difference)
    reach, measured, first = np.sqrt(best.astype(np.float64)), len(x), number.copy()
    for c in range(len(centroids)):
        open_ = rows[(bounds[:, c] <= reach) & (first != c)]
        if not open_.size:
            continue
        measured += len(open_)
        found = _squares(x[open_], centroids[c])
        better = (found < best[open_]) | ((found == best[open_]) & (c < number[open_]))
        at = open_[better]
        best[at], number[at] = found[better], c
        reach[at] = np.sqrt(found[better].astype(np.float64))
    return number, best, measured


def _assigning(centroids: np.ndarray, points: np.ndarray, sums: bool) -> Callable:
    """Arrow function that assigns rows: the rows with their cluster, or sums of each batch."""

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in filter(len, batches):
            x = _matrix(batch.column("x"))
            number, best, _ = nearest(x, _matrix(batch.column("far")), centroids, points)
            if not sums:
                yield pa.RecordBatch.from_arrays(
                    [batch.column("vec_id"), pa.array(number.astype(np.int32)), pa.array(best)], ["vec_id", "cluster", "distance"]
                )
                continue
            for c in np.unique(number):
                mine = x[number == c]
                yield pa.RecordBatch.from_pydict(
                    {"cluster": [int(c)], "n": [len(mine)], "total": [mine.sum(axis=0).tolist()]},
                    pa.schema([("cluster", pa.int32()), ("n", pa.int64()), ("total", pa.list_(pa.int64()))]),
                )

    return run


def _moved(table: DataFrame, centroids: np.ndarray, points: np.ndarray) -> np.ndarray:
    """Centroids after one round: the floor of each cluster's mean; an empty cluster stays."""
    parts = table.select("x", "far").mapInArrow(_assigning(centroids, points, sums=True), "cluster int, n long, total array<long>")
    each = parts.select("cluster", "n", F.posexplode("total").alias("at", "v"))
    found = each.groupBy("cluster", "at").agg(F.sum("n").alias("n"), F.sum("v").alias("v")).collect()
    out = centroids.copy()
    for r in found:
        out[r.cluster, r.at] = r.v // r.n
    return out


def cluster_vectors(embeddings: DataFrame, k: int = CENTROIDS, rounds: int = ROUNDS, size: int = SIZE, scale: int = SCALE) -> DataFrame:
    """vec_id, cluster, distance, cluster_inertia, inertia and centroid_sha256 of each vector clustered.

    Rows that ``whole_vectors`` leaves out have no row in the result; fewer than ``k`` vectors
    make as many clusters, and an empty table none.  Rows that repeat are vectors of their own.
    A null vec_id has no hash and starts a cluster only where ids run out.  Components beyond
    ``LIMIT / scale`` count as that limit.  The driver holds centroids, pivots and the sums of
    each cluster, k * size numbers whatever the table's size.
    """
    vectors = whole_vectors(embeddings, size, scale)
    kind = vectors.schema["vec_id"].dataType.simpleString()
    centroids = first_centroids(vectors, k)
    if not len(centroids):
        empty = f"vec_id {kind}, cluster int, distance long, cluster_inertia long, inertia long, centroid_sha256 string"
        return embeddings.sparkSession.createDataFrame([], empty)
    points = pivots(centroids)
    table = pivot_table(vectors, points)
    for _ in range(rounds):
        centroids = _moved(table, centroids, points)
    last = stage(table.mapInArrow(_assigning(centroids, points, sums=False), f"vec_id {kind}, cluster int, distance long"), "assigned")
    inertia = {r.cluster: r.inertia for r in last.groupBy("cluster").agg(F.sum("distance").alias("inertia")).collect()}
    named = [(c, v, sum(inertia.values()), sha(",".join(map(str, centroids[c].tolist())).encode())) for c, v in inertia.items()]
    facts = embeddings.sparkSession.createDataFrame(named, "cluster int, cluster_inertia long, inertia long, centroid_sha256 string")
    return last.join(F.broadcast(facts), "cluster").select(
        "vec_id", "cluster", "distance", "cluster_inertia", "inertia", "centroid_sha256"
    )
