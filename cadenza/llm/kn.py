"""Character models with interpolated Kneser-Ney smoothing in sorted hash arrays.

Texts are lower-cased, everything that is no letter becomes a space, and runs of spaces
become one.  Counts of the longest n-grams are gathered from all training rows by a Spark
aggregation, and so are continuation counts, discounts and probabilities of all orders.  The
model stays in Parquet files and keeps every n-gram; a task reads them once for the texts it
holds and takes what these need into sorted arrays.
"""

from __future__ import annotations

from collections.abc import Iterable, Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.parquet as pq
from pyarrow import fs
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from cadenza.llm.base import pieces
from cadenza.session import stage, stage_files

SPACE = 32
#: Characters of text for which a task reads the model once, at most, and n-grams read at a time.
HELD_CHARS, READ_ROWS = 32_000_000, 65_536
#: Counts by which a context of a class leans on the pooled model.
PRIOR = 20.0
_FACTORS = np.random.default_rng(20).integers(1, 2**63, 16, dtype=np.uint64) * np.uint64(2) + np.uint64(1)
_LETTERS: list[np.ndarray] = []


def _letters() -> np.ndarray:
    """Lower-case letter, or space, of each code unit of the basic plane."""
    if not _LETTERS:
        units = [ord(c.lower()[0]) if c.isalpha() else SPACE for c in map(chr, range(65536))]
        _LETTERS.append(np.array(units, np.uint32).astype(np.uint16))
    return _LETTERS[0]


@dataclass
class Positions:
    """Letter positions of several texts: units, where each text begins, and pad length."""

    units: np.ndarray
    starts: np.ndarray
    pad: int

    def grams(self, order: int) -> np.ndarray:
        """Hash of the n-gram of ``order`` that ends at each position."""
        out = np.zeros(len(self.units), np.uint64)
        wide = self.units.astype(np.uint64)
        for k in range(order):
            out[k:] += wide[: len(wide) - k] * _FACTORS[k]
        return out + np.uint64(order)

    def scored(self) -> np.ndarray:
        """True at positions that belong to a text, not to the pad before it."""
        out = np.ones(len(self.units), bool)
        for k in range(self.pad):
            out[self.starts + k] = False
        return out

    def sums(self, values: np.ndarray) -> np.ndarray:
        """Sum of ``values`` for each text (pads must hold zeros)."""
        return np.add.reduceat(values, self.starts, axis=0)


def positions(texts: list[str], pad: int) -> Positions:
    gap = " " * pad
    joined = gap + gap.join(texts)
    points = np.frombuffer(joined.encode("utf-32-le", "surrogatepass"), np.uint32)
    lengths = np.array([len(t) for t in texts], np.int64) + pad
    starts = np.concatenate([[0], np.cumsum(lengths)[:-1]])
    units = _letters()[np.minimum(points, 65535)]
    if (far := np.flatnonzero(points > 65535)).size:
        for p in np.unique(points[far]):
            units[far[points[far] == p]] = 0xE000 + int(p) % 0x1800 if chr(p).isalpha() else SPACE
    blank = units == SPACE
    keep = np.ones(len(units), bool)
    keep[1:] = ~(blank[1:] & blank[:-1])
    for k in range(pad):
        keep[starts + k] = True
    return Positions(units[keep], (np.cumsum(keep) - 1)[starts], pad)


def text_chunks(batches: Iterable[pa.RecordBatch]) -> Iterator[tuple[pa.RecordBatch, list[str], np.ndarray]]:
    """(rows, their texts, row of each text); a text of any length stays whole, so that no n-gram is lost."""
    for batch in pieces(batches):
        yield batch, [text or "" for text in batch.column("text").to_pylist()], np.arange(len(batch))


def count_grams(rows: DataFrame, order: int) -> DataFrame:
    """(class, gram, n) over all rows of (class, text); gram holds 16-bit units."""

    def partial(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch, parts, owner in text_chunks(batches):
            names = batch.column("class").to_pylist()
            of = np.array([names[k] for k in owner], object)
            for name in dict.fromkeys(names):
                found = positions([parts[k] for k in np.flatnonzero(of == name)], order - 1)
                at = np.flatnonzero(found.scored())
                if not at.size:
                    continue
                _, first, n = np.unique(found.grams(order)[at], return_index=True, return_counts=True)
                window = np.stack([found.units[at[first] - k] for k in range(order - 1, -1, -1)], axis=1)
                raw = np.ascontiguousarray(window).tobytes()
                width = 2 * order
                grams = pa.array([raw[k : k + width] for k in range(0, len(raw), width)], pa.binary())
                yield pa.RecordBatch.from_arrays(
                    [pa.array([name] * len(n), pa.string()), grams, pa.array(n, pa.int64())],
                    ["class", "gram", "n"],
                )

    counted = rows.select("class", "text").mapInArrow(partial, "class string, gram binary, n long")
    return counted.groupBy("class", "gram").agg(F.sum("n").alias("n"))


class SortedHashes:
    """Hashes in ascending order with a table of where each leading-bit bucket begins."""

    def __init__(self, keys: np.ndarray):
        bits = max(1, int(np.ceil(np.log2(len(keys) + 2))) + 1)
        self.keys, self.shift = keys, np.uint64(64 - bits)
        edges = np.arange(2**bits, dtype=np.uint64) << self.shift
        self.begin = np.append(np.searchsorted(keys, edges), len(keys)).astype(np.int32)
        self.deepest = int(np.diff(self.begin).max()) if len(keys) else 0

    def find(self, query: np.ndarray) -> np.ndarray:
        """Place of each hash, or -1."""
        out = np.full(len(query), -1, np.int32)
        if not len(self.keys):
            return out
        bucket = (query >> self.shift).astype(np.int32)
        at, end = self.begin[bucket], self.begin[bucket + 1]
        hit = self.keys[np.minimum(at, len(self.keys) - 1)] == query
        out[hit] = at[hit]
        left = np.flatnonzero(~hit & (end - at > 1))
        for k in range(1, self.deepest):
            if not left.size:
                break
            place = at[left] + k
            same = self.keys[place] == query[left]
            out[left[same]] = place[same]
            left = left[~same & (end[left] - place > 1)]
        return out


def _hash(windows: np.ndarray) -> np.ndarray:
    order = windows.shape[1]
    out = np.zeros(len(windows), np.uint64)
    for k in range(order):
        out += windows[:, order - 1 - k].astype(np.uint64) * _FACTORS[k]
    return out + np.uint64(order)


@dataclass
class Known:
    """The part of a model that some texts need, by order: n-grams and contexts."""

    tables: list[tuple[SortedHashes, np.ndarray]]
    weights: list[tuple[SortedHashes, np.ndarray]]
    floor: np.ndarray

    def log_p(self, found: Positions, at: np.ndarray) -> np.ndarray:
        """Log probability of the unit at each place, one column for each class."""
        out = np.zeros((len(at), len(self.floor)), np.float32)
        open_, where = np.arange(len(at)), at
        for order in range(len(self.tables), 0, -1):
            hashes, values = self.tables[order - 1]
            place = hashes.find(found.grams(order)[where])
            hit = place >= 0
            out[open_[hit]] += values[place[hit]]
            open_, where = open_[~hit], where[~hit]
            if not open_.size:
                return out
            heads, weights = self.weights[order - 1]
            place = heads.find(found.grams(order - 1)[where - 1])
            known = place >= 0
            out[open_[known]] += weights[place[known]]
        out[open_] += self.floor
        return out


def _windows(found: Positions, order: int) -> tuple[np.ndarray, np.ndarray]:
    """Distinct n-grams of the scored places: hashes in ascending order, and units."""
    at = np.flatnonzero(found.scored())
    keys, first = np.unique(found.grams(order)[at], return_index=True)
    return keys, np.stack([found.units[at[first] - k] for k in range(order - 1, -1, -1)], axis=1)


def _picked(files: list[str], wanted: np.ndarray) -> tuple[SortedHashes, np.ndarray]:
    """Rows of a table of (key, values) whose key is wanted; never more than a batch beside them."""
    keys, values = [np.zeros(0, np.uint64)], []
    for uri in files:
        system, path = fs.FileSystem.from_uri(uri)
        with system.open_input_file(path) as file:
            for batch in pq.ParquetFile(file).iter_batches(READ_ROWS):
                key, column = batch.column(0).to_numpy().view(np.uint64), batch.column(1)
                offsets = np.frombuffer(column.buffers()[1], np.int32)[column.offset : column.offset + len(column) + 1]
                data = np.frombuffer(column.buffers()[2], np.uint8)[offsets[0] : offsets[-1]].view(np.float32).reshape(len(key), -1)
                place = np.minimum(np.searchsorted(wanted, key), len(wanted) - 1)
                hit = np.flatnonzero(wanted[place] == key) if len(wanted) else []
                keys.append(key[hit])
                values.append(data[hit])
    key = np.concatenate(keys)
    order = np.argsort(key)
    return SortedHashes(key[order]), np.concatenate(values)[order] if values else np.zeros((0, 1), np.float32)


class KneserNey:
    """Where the log probabilities of all n-grams and the backoff weights of all contexts lie.

    ``shared`` pools the counts of all orders over the classes; what is left to a class are
    its own counts of the longest n-grams, discounted and filled up from the pooled model.
    Classes then differ only where the counts of a class itself speak for it.
    """

    def __init__(self, order: int, classes: list[str], cells: int, units: int):
        self.order, self.classes, self.cells = order, classes, cells
        self.floor = np.full(len(classes), -np.log(units), np.float32)
        self.tables: list[list[str]] = []
        self.weights: list[list[str]] = []

    def known(self, windows: np.ndarray) -> Known:
        """What the model has of these n-grams and of all that they fall back to."""
        tables, weights = [], []
        for order in range(1, self.order + 1):
            own = windows[:, self.order - order :]
            tables.append(_picked(self.tables[order - 1], np.unique(_hash(own))))
            weights.append(_picked(self.weights[order - 1], np.unique(_hash(own[:, :-1]))))
        return Known(tables, weights, self.floor)

    def log_p(self, found: Positions, at: np.ndarray) -> np.ndarray:
        return self.known(_windows(found, self.order)[1]).log_p(found, at)


def known_chunks(
    batches: Iterable[pa.RecordBatch], model: KneserNey
) -> Iterator[tuple[pa.RecordBatch, list[str], np.ndarray, Known]]:
    """``text_chunks`` with what the model knows of them.

    The model is read once for ``HELD_CHARS`` characters, or fewer if these have more than
    ``cells`` distinct n-grams times classes.
    """
    held, chars, pending = [], 0, 0
    keys, windows = [], []

    def compact() -> None:
        nonlocal keys, windows, pending
        one, first = np.unique(np.concatenate(keys), return_index=True)
        keys, windows, pending = [one], [np.concatenate(windows)[first]], 0

    def ready() -> Iterator[tuple[pa.RecordBatch, list[str], np.ndarray, Known]]:
        nonlocal held, chars, keys, windows, pending
        compact()
        known = model.known(windows[0])
        for chunk in held:
            yield *chunk, known
        held, chars, keys, windows, pending = [], 0, [], [], 0

    for batch, parts, owner in text_chunks(batches):
        held.append((batch, parts, owner))
        chars += sum(map(len, parts))
        key, window = _windows(positions(parts, model.order - 1), model.order)
        keys.append(key)
        windows.append(window)
        pending += len(key)
        if pending > max(len(keys[0]), 200_000):
            compact()
        if chars >= HELD_CHARS or sum(map(len, keys)) * len(model.classes) >= model.cells:
            compact()
            if chars >= HELD_CHARS or len(keys[0]) * len(model.classes) >= model.cells:
                yield from ready()
    if held:
        yield from ready()


def _interpolated(level: DataFrame, names: list[str], prior: float = 0.0) -> DataFrame:
    """Adds to the counts ``names`` what an n-gram has of its own (own_) and its context leaves (left_).

    ``prior`` counts more for every context are taken to follow the order below.
    """
    row = level.agg(*[F.sum((F.col(c) == n).cast("long")).alias(f"{c}_{n}") for c in names for n in (1, 2)]).first()
    context = Window.partitionBy("head")
    for c in names:
        ones, twos = row[f"{c}_1"] or 0, row[f"{c}_2"] or 0
        cut = float(np.clip(ones / max(ones + 2 * twos, 1), 0.1, 0.95))
        total, kinds = F.sum(c).over(context), F.sum((F.col(c) > 0).cast("double")).over(context)
        level = level.withColumns({
            f"own_{c}": F.greatest(F.col(c) - cut, F.lit(0.0)) / F.greatest(total + prior, F.lit(1.0)),
            f"left_{c}": F.when(total > 0, (kinds * cut + prior) / (total + prior)).otherwise(1.0),
        })
    return level


def _packed(rows: DataFrame, gram: str, order: int, names: list[str]) -> list[str]:
    """Files of (hash of the n-gram, logarithms as 32-bit numbers), sorted inside."""

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            raw = b"".join(batch.column("gram").to_pylist())
            key = _hash(np.frombuffer(raw, np.uint16).reshape(len(batch), order))
            values = np.log(np.stack([batch.column(c).to_numpy() for c in names], axis=1)).astype(np.float32)
            width, data = 4 * len(names), values.tobytes()
            packed = pa.array([data[k : k + width] for k in range(0, len(data), width)], pa.binary())
            yield pa.RecordBatch.from_arrays([pa.array(key.view(np.int64)), packed], ["key", "packed"])

    packed = rows.select(F.col(gram).alias("gram"), *names).mapInArrow(run, "key long, packed binary")
    path = stage_files(packed.sortWithinPartitions("key"), "model")
    return rows.sparkSession.read.schema("key long, packed binary").parquet(path).inputFiles()


def fit(rows: DataFrame, order: int, cells: int, shared: bool = False) -> KneserNey | None:
    """Model of (class, text) with every n-gram; None without training rows.

    ``cells`` bounds the n-grams times classes that a task looks up at a time.
    """
    counted = stage(count_grams(rows, order), "grams")
    classes = sorted(r["class"] for r in counted.select("class").distinct().collect())
    if not classes:
        return None
    names = [f"n{k}" for k in range(len(classes))]
    of = F.col("class")
    top = counted.groupBy("gram").agg(
        *[F.sum(F.when(of == c, F.col("n")).otherwise(0)).cast("double").alias(n) for n, c in zip(names, classes)]
    )
    lower = ["pool"] if shared else names
    if shared:
        top = top.withColumn("pool", sum(F.col(n) for n in names))
    levels = [stage(top, "counts")]
    for k in range(order - 1, 0, -1):
        # continuation counts: kinds of units seen before what remains
        seen = [F.sum((F.col(n) > 0).cast("double")).alias(n) for n in lower]
        levels.append(stage(levels[-1].groupBy(F.substring("gram", 3, 2 * k).alias("gram")).agg(*seen), "counts"))
    units = levels[-1].count() + 1
    model, below = KneserNey(order, classes, cells, units), None
    for k, level in enumerate(reversed(levels), 1):
        level = _interpolated(level.withColumn("head", F.substring("gram", 1, 2 * (k - 1))), lower)
        own = shared and k == order
        if own:
            level = _interpolated(level, names, PRIOR)
        if below is None:
            level = level.withColumns({f"below_{n}": F.lit(1.0 / units) for n in lower})
        else:
            tails = below.select(F.col("gram").alias("tail"), *[F.col(f"p_{n}").alias(f"below_{n}") for n in lower])
            level = level.withColumn("tail", F.substring("gram", 3, 2 * (k - 1))).join(tails, "tail")
        value = {n: (F.col(f"own_{n}") + F.col(f"left_{n}") * F.col(f"below_{n}"), F.col(f"left_{n}")) for n in lower}
        if own:
            p, left = value["pool"]
            value = {n: (F.col(f"own_{n}") + F.col(f"left_{n}") * p, F.col(f"left_{n}") * left) for n in names}
        ps, ws = [v[0].alias(f"p_{n}") for n, v in value.items()], [v[1].alias(f"w_{n}") for n, v in value.items()]
        below = stage(level.select("gram", "head", *ps, *ws), "level")
        model.tables.append(_packed(below, "gram", k, [f"p_{n}" for n in value]))
        heads = below.groupBy("head").agg(*[F.first(f"w_{n}").alias(f"w_{n}") for n in value])
        model.weights.append(_packed(heads, "head", k - 1, [f"w_{n}" for n in value]))
    return model
