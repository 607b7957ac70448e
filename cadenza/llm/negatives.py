"""Hard negatives: for each anchor and positive, the best rows of other labels in a score window.

Anchors and rows are dealt to cells of a grid, so that a task holds a block of anchors and a
slice of rows.  Inside a cell the anchors are searched by threshold joins: for a threshold, an
inverted index holds of each anchor only the leading dimensions, those whose omission the
norms of its remaining ones would not excuse; partial scores add up dimension by dimension
and pairs go when the remaining norms cannot lift them over the threshold; what is left gets
its exact integer score.  Thresholds start high and are lowered until every window is full
or its lower end is reached.
"""

from __future__ import annotations

from collections.abc import Iterable, Iterator
from typing import NamedTuple

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from cadenza.llm.base import key_runs
from cadenza.session import stage

POSITIVES, NEGATIVES, SCALE = 5, 5, 256
#: A negative scores at least this share of its positive, in hundredths.
LOWEST = 80
#: Whole components are held in this range, so that scores fit 64 bits.
LIMIT = 2**24
#: Anchors of a block, and least and most rows of a slice: what one task holds.
BLOCK, SLICE = 32_768, (4_096, 131_072)
#: Anchors and rows compared at once, and dimensions added up between two prunings.
TILE, STEP = 2_048, 16
#: Thresholds as shares of the highest score an anchor can reach; the last is its window's end.
SHARES = (0.9, 0.6, 0.3, None)
_LEAST = np.iinfo(np.int64).min // 4


class Rows(NamedTuple):
    """Vectors of a cell; ``row`` is odd where a row has no id."""

    x: np.ndarray
    label: np.ndarray
    id: np.ndarray
    row: np.ndarray


class Found(NamedTuple):
    """The best rows of each window, by window, falling score, id and row."""

    window: np.ndarray
    score: np.ndarray
    id: np.ndarray
    row: np.ndarray


class Index:
    """Leading dimensions of anchors as posting lists: dimension j lists the first ``posted[j]``.

    ``cut`` is the first dimension that an anchor leaves out: the norm of its part from there on,
    times the largest norm of a row's, stays below its threshold, so that a pair which
    reaches the threshold has a positive score in the dimensions before.
    """

    def __init__(self, q: np.ndarray, threshold: np.ndarray, row_norms: np.ndarray):
        rest = _suffix_norms(q)
        covered = rest * row_norms[None, :] < threshold[:, None] * (1 - 1e-9)
        self.cut = np.where(covered.any(axis=1), covered.argmax(axis=1), q.shape[1])
        self.order = np.argsort(-self.cut, kind="stable")
        self.cut, self.q, self.rest = self.cut[self.order], q[self.order], rest[self.order]
        self.threshold = threshold[self.order]
        self.posted = np.searchsorted(-self.cut, -np.arange(q.shape[1]), side="left")
        self.values = np.where(np.arange(q.shape[1])[None, :] < self.cut[:, None], self.q, 0)

    def candidates(self, y: np.ndarray, y_rest: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Pairs (anchor, row) that may reach the threshold: none that does is missing."""
        width = self.q.shape[1]
        need = (self.threshold - 1e-9 * (1 + np.abs(self.threshold)) - 1e-9 * self.rest[:, 0] * y_rest[:, 0].max(initial=0))[:, None]
        live = np.arange(len(y))
        score = np.zeros((len(self.q), len(y)))
        done: list[tuple[np.ndarray, np.ndarray]] = []
        n = int(self.posted[0]) if width else 0
        if n < len(self.q):  # nothing of these is indexed: no row can reach them
            score, need = score[:n], need[:n]
        for a in range(0, width, STEP):
            b = min(a + STEP, width)
            inside = int(self.posted[a])
            if not inside or not live.size:
                break
            score = score[:inside] + self.values[:inside, a:b] @ y[live, a:b].T
            # what the dimensions not yet added can still give; past its cut, an anchor's own rest
            at = np.minimum(self.cut[:inside], b)
            reach = score + self.rest[np.arange(inside), at][:, None] * y_rest[live][:, at].T
            open_ = reach >= need[:inside]
            ended = self.cut[:inside] <= b
            i, j = np.nonzero(open_ & ended[:, None])
            done.append((i, live[j]))
            stays = (open_ & ~ended[:, None]).any(axis=0)
            if not stays.all():
                live, score = live[stays], score[:, stays]
        if not done:
            return np.zeros(0, np.int64), np.zeros(0, np.int64)
        return self.order[np.concatenate([i for i, _ in done])], np.concatenate([j for _, j in done])


def _suffix_norms(x: np.ndarray) -> np.ndarray:
    """Norm of each row's part from every dimension on; the last column is zero."""
    squares = np.cumsum((x * x)[:, ::-1], axis=1)[:, ::-1]
    return np.sqrt(np.concatenate([squares, np.zeros((len(x), 1))], axis=1))


def _scores(q: np.ndarray, y: np.ndarray, i: np.ndarray, j: np.ndarray) -> np.ndarray:
    """Exact scores of pairs."""
    parts = [np.einsum("ij,ij->i", q[i[k : k + 65536]], y[j[k : k + 65536]]) for k in range(0, len(i), 65536)]
    return np.concatenate(parts) if parts else np.zeros(0, np.int64)


def _best(found: Found, k: int) -> Found:
    """The first ``k`` rows of each window."""
    order = np.lexsort((found.row, found.id, -found.score, found.window))
    window = found.window[order]
    first = np.flatnonzero(np.append(True, window[1:] != window[:-1])) if len(window) else np.zeros(0, np.int64)
    rank = np.arange(len(window)) - np.repeat(first, np.diff(np.append(first, len(window))))
    return Found(*(c[order[rank < k]] for c in found))


def _merged(kept: Found, new: Found, windows: int, k: int) -> Found:
    """``kept`` with new rows; only windows that get some are sorted anew."""
    if not len(new.window):
        return kept
    touched = np.zeros(windows, bool)
    touched[new.window] = True
    old = touched[kept.window]
    again = _best(Found(*(np.append(a[old], b) for a, b in zip(kept, new))), k)
    return Found(*(np.append(a[~old], b) for a, b in zip(kept, again)))


def search(anchors: Rows, rows: Rows, owner: np.ndarray, low: np.ndarray, high: np.ndarray, same: bool, k: int) -> Found:
    """For each window (its anchor, lowest and highest score) the ``k`` best rows inside.

    Only rows of the anchor's own label count if ``same``, else only those of others; an
    anchor is no match of itself.  Windows of one anchor follow one another.
    """
    none = np.zeros(0, np.int64)
    kept = Found(none, none, none, none)
    if not len(anchors.x) or not len(rows.x) or not len(owner):
        return kept
    # dimensions that carry most of the anchors come first
    lead = np.argsort(-np.abs(anchors.x).sum(axis=0), kind="stable")
    q, every = anchors.x[:, lead], rows.x[:, lead]
    qf = q.astype(np.float64)
    norm = np.sqrt((qf * qf).sum(axis=1))
    top = np.full(len(q), _LEAST, np.float64)
    np.maximum.at(top, owner, high.astype(np.float64))
    starts = np.searchsorted(owner, np.arange(len(q)))
    ends = np.searchsorted(owner, np.arange(len(q)), side="right")
    has = np.flatnonzero(ends > starts)
    floor = low.copy()

    def lowest() -> np.ndarray:
        """The least score that a window of each anchor still takes."""
        out = np.full(len(q), _LEAST)
        out[has] = np.minimum.reduceat(floor, starts[has])
        return out

    for at in range(0, len(every), TILE):
        y = every[at : at + TILE]
        yf = y.astype(np.float64)
        y_rest = _suffix_norms(yf)
        row_norms = y_rest.max(axis=0)
        most = np.minimum(norm * row_norms[0], top)
        before = np.full(len(q), np.iinfo(np.int64).max)
        ask = has
        for share in SHARES:
            if not len(ask):
                break
            threshold = least = lowest()[ask]
            if share is not None:
                threshold = np.maximum(least, np.where(most[ask] > 0, most[ask] * share, least).astype(np.int64))
            news = []
            for first in range(0, len(ask), TILE):
                mine, wanted = ask[first : first + TILE], threshold[first : first + TILE]
                i, j = Index(qf[mine], wanted.astype(np.float64), row_norms).candidates(yf, y_rest)
                equal = anchors.label[mine[i]] == rows.label[at + j]
                good = (equal if same else ~equal) & (anchors.row[mine[i]] != rows.row[at + j])
                i, j = i[good], j[good]
                score = _scores(q, y, mine[i], j)
                good = (score >= wanted[i]) & (score < before[mine[i]])
                i, j, score = mine[i[good]], j[good] + at, score[good]
                spans = ends[i] - starts[i]
                window = np.repeat(starts[i], spans) + np.arange(spans.sum()) - np.repeat(np.cumsum(spans) - spans, spans)
                score, j = np.repeat(score, spans), np.repeat(j, spans)
                good = (score >= floor[window]) & (score <= high[window])
                news.append((window[good], score[good], rows.id[j[good]], rows.row[j[good]]))
            kept = _merged(kept, Found(*map(np.concatenate, zip(*news))), len(owner), k)
            last = np.full(len(owner), np.iinfo(np.int64).max)
            np.minimum.at(last, kept.window, kept.score)
            floor = np.where(np.bincount(kept.window, minlength=len(owner)) >= k, last, low)
            before[ask] = threshold
            # nothing below a threshold is wanted once all windows are full above it
            ask = ask[(threshold > least) & (lowest()[ask] < threshold)]
    return kept


def _matrix(column: pa.ChunkedArray, width: int) -> np.ndarray:
    """Rows of a list column, shorter ones filled with zeros."""
    column = column.combine_chunks()
    lengths = column.value_lengths().to_numpy(zero_copy_only=False).astype(np.int64)
    out = np.zeros((len(lengths), width), np.int64)
    out[np.arange(width)[None, :] < lengths[:, None]] = column.flatten().to_numpy(zero_copy_only=False)
    return out


def _rows(table: pa.Table, width: int) -> Rows:
    return Rows(_matrix(table["x"], width), *(table[c].to_numpy() for c in ("label", "id", "row")))


def _dealt(rows: DataFrame, anchors: DataFrame, blocks: int, slices: int) -> DataFrame:
    """Each block of anchors with each slice of rows, anchors first."""
    block, part = F.pmod(F.xxhash64("row"), F.lit(blocks)), F.pmod(F.xxhash64("row"), F.lit(slices))
    columns = ("row", "id", "label", "x")
    asked = anchors.select(*columns, "scores", F.lit(0).alias("side"), (block * slices).alias("base"), F.explode(F.sequence(F.lit(0), F.lit(slices - 1))).alias("other"))
    given = rows.select(*columns, F.lit(None).cast("array<long>").alias("scores"), F.lit(1).alias("side"), part.alias("base"), F.explode(F.sequence(F.lit(0), F.lit(blocks - 1))).alias("other"))
    cells = asked.withColumn("cell", F.col("base") + F.col("other")).union(
        given.withColumn("cell", F.col("base") + F.col("other") * slices)
    )
    return cells.drop("base", "other").repartition(blocks * slices, "cell").sortWithinPartitions("cell", "side")


def _searched(dealt: DataFrame, same: bool, k: int) -> DataFrame:
    """(anchor, window, score, id, row): the best rows of each cell for each window."""

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for table in key_runs(batches, "cell"):
            side = table["side"].to_numpy()
            width = int(max(pc.max(pc.list_value_length(table["x"])).as_py() or 0, 1))
            asked = table.filter(pa.array(side == 0))
            anchors, rows = _rows(asked, width), _rows(table.filter(pa.array(side == 1)), width)
            if same:
                owner = np.arange(len(anchors.row))
                number, low, high = np.zeros(len(owner), np.int64), np.full(len(owner), _LEAST), np.full(len(owner), np.iinfo(np.int64).max - 1)
            else:
                scores = asked["scores"].combine_chunks()
                lengths = scores.value_lengths().to_numpy(zero_copy_only=False).astype(np.int64)
                owner, high = np.repeat(np.arange(len(lengths)), lengths), scores.flatten().to_numpy(zero_copy_only=False)
                number = np.arange(len(owner)) - np.repeat(np.cumsum(lengths) - lengths, lengths)
                low = -(-LOWEST * high // 100)
            found = search(anchors, rows, owner, low, high, same, k)
            yield pa.RecordBatch.from_arrays(
                [pa.array(anchors.row[owner[found.window]]), pa.array(number[found.window].astype(np.int32)),
                 *map(pa.array, (found.score, found.id, found.row))],
                ["anchor", "window", "score", "id", "row"],
            )

    return dealt.mapInArrow(run, "anchor long, window int, score long, id long, row long")


def hard_negatives(embeddings: DataFrame, is_anchor: Column, positives: int = POSITIVES, negatives: int = NEGATIVES, scale: int = SCALE) -> DataFrame:
    """anchor_id, positive_id, rank, negative_id, positive_score and negative_score.

    ``embeddings`` has vec_id, label (whole numbers) and embedding; ``is_anchor`` is a condition
    on them.  Components become ``floor(scale * x)`` and scores are inner products of these.
    An anchor's positives are its best other rows of the same label; each gets its best rows of
    other labels that score between ``LOWEST`` hundredths of the positive's score and that
    score.  Ties go by vec_id, a missing one last, then by row.

    Rows with a null label, a null vector or a null or non-finite component take no part, and a
    null condition makes no anchor.  Rows that repeat are rows of their own, each an anchor if
    one is.  Vectors of different lengths are compared as if the shorter went on with zeros, and
    components beyond ``LIMIT / scale`` count as that limit.  A positive with a score below zero
    has no window.  An empty table gives no rows.
    """
    x = F.col("embedding")
    good = x.isNotNull() & F.col("label").isNotNull() & F.forall(
        x, lambda v: v.isNotNull() & ~F.isnan(v) & (F.abs(v) < F.lit(float("inf")))
    )
    bounded = F.transform(x, lambda v: F.greatest(F.lit(-LIMIT), F.least(F.lit(LIMIT), F.floor(v * scale))).cast("int"))
    used = embeddings.select("vec_id", "label", x.cast("array<double>").alias("embedding"), F.coalesce(is_anchor, F.lit(False)).alias("asks"))
    rows = stage(
        used.where(F.coalesce(good, F.lit(False))).select(
            (F.monotonically_increasing_id() * 2 + F.col("vec_id").isNull().cast("int")).alias("row"),
            F.coalesce(F.col("vec_id").cast("long"), F.lit(2**63 - 1)).alias("id"), F.col("label").cast("long").alias("label"),
            bounded.alias("x"), "asks",
        ),
        "negatives",
    )
    anchors = rows.where("asks").withColumn("scores", F.lit(None).cast("array<long>"))
    n_rows, n_anchors = rows.count(), anchors.count()
    blocks = max(1, -(-n_anchors // BLOCK))
    slices = max(1, -(-n_rows // min(max(SLICE[0], 8 * n_anchors // blocks), SLICE[1])))

    def first(found: DataFrame, key: list[str], k: int) -> DataFrame:
        rank = F.row_number().over(Window.partitionBy(*key).orderBy(F.desc("score"), "id", "row"))
        return found.withColumn("rank", rank).where(F.col("rank") <= k)

    own = stage(
        first(_searched(_dealt(rows, anchors, blocks, slices), True, positives), ["anchor"], positives)
        .select(F.col("anchor").alias("row"), "rank", "score", "id", F.col("row").alias("found")),
        "positives",
    )
    # the windows of an anchor, at most ``positives`` of them, in order of rank
    lists = own.groupBy("row").agg(F.transform(F.array_sort(F.collect_list(F.struct("rank", "score"))), lambda s: s["score"]).alias("scores"))
    asked = anchors.drop("scores").join(lists, "row")
    others = first(_searched(_dealt(rows, asked, blocks, slices), False, negatives), ["anchor", "window"], negatives)

    def shown(identity: Column, row: Column) -> Column:
        return F.when(row % 2 == 0, identity)

    named = own.select(
        F.col("row").alias("anchor"), (F.col("rank") - 1).alias("window"),
        shown(F.col("id"), F.col("found")).alias("positive_id"), F.col("score").alias("positive_score"),
    ).join(anchors.select(F.col("row").alias("anchor"), shown(F.col("id"), F.col("row")).alias("anchor_id")), "anchor")
    return others.select(
        "anchor", "window", "rank", shown(F.col("id"), F.col("row")).alias("negative_id"), F.col("score").alias("negative_score")
    ).join(named, ["anchor", "window"]).select("anchor_id", "positive_id", "rank", "negative_id", "positive_score", "negative_score")
