"""Near-duplicate vectors by an epsilon grid order join.

Unit vectors whose cosine reaches the threshold lie within ``eps`` of each other, and so do
their projections on any principal dimensions.  Cells of width ``eps`` on the leading ones
are cut into blocks of bounded size; only blocks of the same or adjoining cells meet.
Inside a task both sides are sorted by their grid cells and joined by recursion on
intervals of that order; pairs of intervals whose boxes lie further apart are skipped.
"""

from __future__ import annotations

from collections.abc import Iterable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from cadenza.llm.base import key_runs
from cadenza.llm.components import Forest, components
from cadenza.session import stage

THRESHOLD = 0.9
#: Vectors whose principal dimensions stand for all; these only decide what is skipped.
SAMPLE_ROWS = 5_000
#: Dimensions that deal out cells, and dimensions of boxes and sort order inside a task.
LEAD, ORDERED = 3, 8
#: Vectors of a block, and of an interval that is compared at once.
BLOCK, LEAF = 4096, 512


def _matrix(column: pa.ChunkedArray | pa.Array) -> np.ndarray:
    """Rows of a list column whose lists have one length, as unit vectors."""
    column = column.combine_chunks() if isinstance(column, pa.ChunkedArray) else column
    x = column.flatten().to_numpy(zero_copy_only=False).astype(np.float64).reshape(len(column), -1)
    x = x / np.abs(x).max(axis=1, keepdims=True)
    return x / np.linalg.norm(x, axis=1, keepdims=True)


def _axes(vectors: DataFrame) -> dict[int, tuple[np.ndarray, np.ndarray]]:
    """By length of the vectors: centre and leading principal dimensions of a bounded sample."""
    some = vectors.orderBy(F.xxhash64("embedding"), "embedding").limit(SAMPLE_ROWS).select("embedding").toArrow()
    sizes = np.array([len(v) for v in some["embedding"]])
    out = {}
    for size in np.unique(sizes):
        x = _matrix(some["embedding"].take(pa.array(np.flatnonzero(sizes == size))))
        centre = x.mean(axis=0)
        out[int(size)] = (centre, np.linalg.svd(x - centre, full_matrices=False)[2][:ORDERED].T)
    return out


def _placed(x: np.ndarray, axes: dict) -> np.ndarray:
    """Projection on the leading dimensions; vectors of an unseen length are not projected."""
    if x.shape[1] not in axes:
        return np.zeros((len(x), 1))
    centre, basis = axes[x.shape[1]]
    return (x - centre) @ basis


class _Side:
    """Vectors in grid order, with their place in the caller's arrays."""

    def __init__(self, x: np.ndarray, at: np.ndarray, axes: dict, eps: float):
        place = _placed(x, axes)
        order = np.lexsort(np.floor(place / eps).T[::-1])
        self.x, self.place, self.at = x[order], place[order], at[order]

    def box(self, a: int, b: int) -> tuple[np.ndarray, np.ndarray]:
        return self.place[a:b].min(axis=0), self.place[a:b].max(axis=0)


def _join(left: _Side, right: _Side, eps: float, threshold: float) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """Linked places of two sides (one side with itself: each pair once)."""
    same, tasks = left is right, [(0, len(left.at), 0, len(right.at))]
    while tasks:
        a, b, c, d = tasks.pop()
        if b <= a or d <= c:
            continue
        low1, high1 = left.box(a, b)
        low2, high2 = right.box(c, d)
        gap = np.maximum(0, np.maximum(low1 - high2, low2 - high1))
        if gap @ gap > eps * eps:
            continue
        if b - a <= LEAF and d - c <= LEAF:
            i, j = np.nonzero(left.x[a:b] @ right.x[c:d].T >= threshold)
            if same:
                i, j = i[i + a < j + c], j[i + a < j + c]
            if i.size:
                yield left.at[i + a], right.at[j + c]
            continue
        if same and (a, b) == (c, d):
            m = (a + b) // 2
            tasks += [(a, m, a, m), (a, m, m, b), (m, b, m, b)]
        elif b - a >= d - c:
            m = (a + b) // 2
            tasks += [(a, m, c, d), (m, b, c, d)]
        else:
            m = (c + d) // 2
            tasks += [(a, b, c, m), (a, b, m, d)]


def similar_vectors(embeddings: DataFrame, threshold: float = THRESHOLD) -> DataFrame:
    """vec_id, n_links, component_id and kept for each row of (vec_id, embedding).

    Vectors that are null, empty or zero, or hold null or non-finite components, have no
    links; vectors of different lengths never link.  Rows that repeat are vectors of their
    own and link with each other.  A null vec_id never names a component unless all of its
    members are null.
    """
    eps = float(np.sqrt(max(0.0, 2 - 2 * threshold))) + 1e-9
    good = F.col("embedding").isNotNull() & F.exists("embedding", lambda v: v != 0) & F.forall(
        "embedding", lambda v: v.isNotNull() & ~F.isnan(v) & (F.abs(v) < F.lit(float("inf")))
    )
    rows = embeddings.select("vec_id", F.col("embedding").cast("array<double>").alias("embedding"))
    rows = rows.withColumn("good", F.coalesce(good, F.lit(False)))
    found = rows.where("good")
    copies = stage(
        found.groupBy("embedding").agg(F.count("*").alias("n"), F.min("vec_id").alias("first"))
        .withColumn("rep", F.monotonically_increasing_id()),
        "copies",
    )
    shared = rows.sparkSession.sparkContext.broadcast(_axes(copies))

    def cells(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            sizes = np.array([len(v) for v in batch.column("embedding")])
            for size in np.unique(sizes):
                part = batch.take(pa.array(np.flatnonzero(sizes == size)))
                place = _placed(_matrix(part.column("embedding")), shared.value)[:, :LEAD]
                cell = np.zeros((len(part), LEAD), np.int32)
                cell[:, : place.shape[1]] = np.floor(place / eps)
                yield pa.RecordBatch.from_arrays(
                    [*part.columns, pa.array([int(size)] * len(part), pa.int32()), *(pa.array(cell[:, k]) for k in range(LEAD))],
                    [*part.schema.names, "size", *names],
                )

    names = [f"c{k}" for k in range(LEAD)]
    key = ["size", *names]
    placed = stage(
        copies.mapInArrow(cells, "embedding array<double>, n long, first " + copies.schema["first"].dataType.simpleString()
                          + ", rep long, size int, " + ", ".join(f"{c} int" for c in names)),
        "cells",
    )
    counts = placed.groupBy(key).agg(F.ceil(F.count("*") / BLOCK).cast("int").alias("parts"))
    blocks = stage(counts.select(*key, "parts", F.explode(F.sequence(F.lit(0), F.col("parts") - 1)).alias("part")), "blocks")
    # each block asks in its own and the adjoining cells for blocks that follow it
    near = F.array(*[F.lit(k) for k in (-1, 0, 1)])
    asked = blocks.select(*key, F.col("part").alias("part1"))
    for c in names:
        asked = asked.withColumn(f"d_{c}", F.explode(near))
    first, second = F.struct(*names, F.col("part1")), F.struct(*(F.col(f"n_{c}") for c in names), F.col("part"))
    pairs = (
        asked.select("size", *names, "part1", *((F.col(c) + F.col(f"d_{c}")).alias(f"n_{c}") for c in names))
        .join(blocks.select("size", *(F.col(c).alias(f"n_{c}") for c in names), "part"), ["size", *(f"n_{c}" for c in names)])
        .where(first <= second)
        .withColumn("pair", F.xxhash64("size", first, second))
    )
    sides = pairs.select("size", *names, F.col("part1").alias("part"), "pair", F.lit(0).alias("side")).union(
        pairs.where(first != second).select("size", *(F.col(f"n_{c}").alias(c) for c in names), "part", "pair", F.lit(1).alias("side"))
    )
    dealt = (
        placed.join(counts, key)
        .withColumn("part", F.pmod(F.xxhash64("rep"), F.col("parts")).cast("int"))
        .join(sides, [*key, "part"])
        .select("pair", "side", "rep", "n", "embedding")
        .repartition("pair").sortWithinPartitions("pair", "side")
    )

    def joined(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        axes = shared.value
        for rows in key_runs(batches, "pair"):
            x, side = _matrix(rows["embedding"]), rows["side"].to_numpy()
            rep, n = rows["rep"].to_numpy(), rows["n"].to_numpy()
            at = np.arange(len(rep))
            left = _Side(x[side == 0], at[side == 0], axes, eps)
            right = _Side(x[side == 1], at[side == 1], axes, eps) if side.any() else left
            links, forest = np.zeros(len(rep), np.int64), Forest(len(rep))
            for i, j in _join(left, right, eps, threshold):
                np.add.at(links, i, n[j])
                np.add.at(links, j, n[i])
                forest.add(i, j)
            some = np.flatnonzero(links)
            a, b = forest.edges()
            yield pa.RecordBatch.from_arrays(
                [pa.array(np.append(rep[some], rep[a])), pa.array(np.append(links[some], rep[b])),
                 pa.array(np.append(np.zeros(len(some), bool), np.ones(len(a), bool)))],
                ["a", "b", "edge"],
            )

    out = stage(dealt.mapInArrow(joined, "a long, b long, edge boolean"), "joined")
    links = out.where("not edge").groupBy(F.col("a").alias("rep")).agg(F.sum("b").alias("others"))
    linked = components(out.where("edge").select("a", "b"))
    heads = linked.join(copies.select(F.col("rep").alias("node"), "first"), "node")
    least = heads.groupBy("component").agg(F.min("first").alias("component_id"))
    member = linked.join(least, "component").select(F.col("node").alias("rep"), "component_id")
    known = (
        copies.join(links, "rep", "left").join(member, "rep", "left")
        .select(F.col("embedding").alias("_e"), (F.col("n") - 1 + F.coalesce("others", F.lit(0))).alias("n_links"),
                F.coalesce("component_id", "first").alias("component_id"))
    )
    done = found.join(known, F.col("embedding") == F.col("_e")).select("vec_id", "n_links", "component_id")
    rest = rows.where("not good").select("vec_id", F.lit(0).cast("long").alias("n_links"), F.col("vec_id").alias("component_id"))
    return done.union(rest).withColumn("kept", F.col("vec_id").eqNullSafe(F.col("component_id")))
