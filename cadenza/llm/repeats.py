"""Removal of byte strings that occur earlier in the corpus, with suffix arrays.

A string of LENGTH bytes has one anchor: its leftmost KEY-byte substring of least hash.
Equal strings have equal anchors at the same distance, so only texts around equal anchors can
share one.  The strings with one anchor form a segment.  Equal segments need no closer
look: all but the first are repeated.  Different segments around equal anchors are compared
by suffix arrays, many small ones at a time.  Nothing is decided by an anchor alone.
"""

from __future__ import annotations

from collections.abc import Iterable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from cadenza.llm.base import key_runs, pieces, sha
from cadenza.llm.suffix import suffix_arrays
from cadenza.session import stage

#: Bytes of a repeated string, and of an anchor.
LENGTH, KEY = 100, 32
#: Bytes of text that a task looks at together; longer texts are read in overlapping parts.
PART = 4_000_000
#: Different segments of one anchor beyond which their strings are grouped by Spark, and anchors
#: of that kind which are broadcast.
HOT, HOT_ANCHORS = 1_000, 100_000
#: Bytes of one suffix array, beyond which its strings are told apart further, and bytes
#: of suffix arrays made at a time.
JOINT, AT_ONCE = 4_096, 2_000_000
_RNG = np.random.default_rng(7)
_SYMBOL = _RNG.integers(1, 2**63, 256, dtype=np.uint64)
_MIX = _RNG.integers(1, 2**62, 5, dtype=np.uint64) * np.uint64(2) + np.uint64(1)
_STEP = np.uint64(0x5851F42D4C957F2D)
_BACK = np.uint64(pow(int(_STEP), -1, 2**64))
_PLACE = np.uint64(0xFFFFFF)
_STRING = _RNG.integers(0, 2**63, (2, LENGTH, 256), dtype=np.uint64) * np.uint64(2) + _RNG.integers(0, 2, (2, LENGTH, 256), dtype=np.uint64)


def _key_hashes(data: np.ndarray) -> np.ndarray:
    """Hash of the KEY bytes from each place on, by doubling."""
    h, width = _SYMBOL[data], 1
    for mix in _MIX:
        h = h[:-width] * mix + h[width:]
        h ^= h >> np.uint64(29)
        width *= 2
    h *= np.uint64(0xBF58476D1CE4E5B9)
    return h ^ (h >> np.uint64(32))


def anchors(data: np.ndarray, begin: np.ndarray, end: np.ndarray):
    """(text, anchor hash, segment hash, first start, last start, anchor place), by place.

    ``begin`` and ``end`` are the texts' places in ``data``; starts are places of strings.
    """
    none = np.zeros(0, np.int64)
    if len(data) < LENGTH:
        return none, none.view(np.uint64), none.view(np.uint64), none, none, none
    keys = _key_hashes(data)
    least = (keys & ~_PLACE) | np.arange(len(keys), dtype=np.uint64)
    width, want = 1, LENGTH - KEY + 1
    while width * 2 <= want:
        least = np.minimum(least[:-width], least[width:])
        width *= 2
    least = np.minimum(least[: len(least) - (want - width)], least[want - width :])
    place = (least & _PLACE).astype(np.int64)
    inside = np.zeros(len(place) + 1, np.int32)
    long = end - begin >= LENGTH
    np.add.at(inside, begin[long], 1)
    np.add.at(inside, end[long] - LENGTH + 1, -1)
    inside = np.cumsum(inside[:-1]) > 0
    change = np.concatenate([[True], (place[1:] != place[:-1]) | (inside[1:] != inside[:-1])])
    first = np.flatnonzero(change)
    last = np.append(first[1:], len(place)) - 1
    kept = inside[first]
    first, last = first[kept], last[kept]
    # hash of data[first : last + LENGTH] from running sums of a polynomial
    power = np.cumprod(np.full(len(data) + 1, _STEP)) * _BACK
    inverse = np.cumprod(np.full(len(data) + 1, _BACK)) * _STEP
    sums = np.concatenate([np.zeros(1, np.uint64), np.cumsum(_SYMBOL[data] * power[:-1])])
    segment = (sums[last + LENGTH] - sums[first]) * inverse[first] * _MIX[0]
    segment ^= (segment >> np.uint64(31)) + (last - first).astype(np.uint64)
    text = np.searchsorted(end, first, side="right")
    return text, keys[place[first]], segment, first, last, place[first]


def _parts(batches: Iterable[pa.RecordBatch]) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray, np.ndarray]]:
    """(bytes, begin, end, id, offset in the text) of several texts or of a part of one."""
    for batch in pieces(batches, size=PART):
        column = batch.column("text").fill_null("")
        offsets = np.frombuffer(column.buffers()[1], np.int32)[column.offset : column.offset + len(column) + 1].astype(np.int64)
        data = np.frombuffer(column.buffers()[2] or b"", np.uint8)[offsets[0] : offsets[-1]]
        begin, end = offsets[:-1] - offsets[0], offsets[1:] - offsets[0]
        ids = batch.column("id").to_numpy()
        if len(data) <= 3 * PART:
            yield data, begin, end, ids, np.zeros(len(ids), np.int64)
            continue
        for a, b, doc in zip(begin.tolist(), end.tolist(), ids):
            for at in range(a, max(a + 1, b - LENGTH + 1), PART):
                part = data[at : min(b, at + PART + LENGTH - 1)]
                yield part, np.array([0]), np.array([len(part)]), np.array([doc]), np.array([at - a])


def _intervals(doc: np.ndarray, first: np.ndarray, last: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Intervals by text and place, adjoining ones as one."""
    order = np.lexsort((first, doc))
    doc, first, last = doc[order], first[order], last[order]
    if not len(doc):
        return doc, first, last
    new = np.concatenate([[True], (doc[1:] != doc[:-1]) | (first[1:] > last[:-1] + 1)])
    at = np.flatnonzero(new)
    return doc[at], first[at], np.maximum.reduceat(last, at)


_ANCHOR = "anchor long, segment long, doc long, first int, last int, place int"


def _anchor_rows(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """One row for each distinct (anchor, segment) of a part: its first place.

    Later places in the same part are repeated for certain; they go on as intervals whose
    anchor place is -1, so that a hot passage has one row for each part, not for each copy.
    """
    for data, begin, end, ids, offset in _parts(batches):
        text, key, segment, first, last, place = anchors(data, begin, end)
        shift = offset[text] - begin[text]
        doc, first, last, place = ids[text], first + shift, last + shift, place + shift
        order = np.lexsort((first, doc, segment, key))
        key, segment, doc, first, last, place = (v[order] for v in (key, segment, doc, first, last, place))
        new = np.concatenate([[True], (key[1:] != key[:-1]) | (segment[1:] != segment[:-1])])[: len(key)]
        origin = np.maximum.accumulate(np.where(new, np.arange(len(key)), 0))
        again = ~new & ((doc != doc[origin]) | (first != first[origin]))
        d, a, b = _intervals(doc[again], first[again], last[again])
        out = (
            np.concatenate([key[new].view(np.int64), d]), np.concatenate([segment[new].view(np.int64), np.zeros(len(d), np.int64)]),
            np.concatenate([doc[new], d]), np.concatenate([first[new], a]), np.concatenate([last[new], b]),
            np.concatenate([place[new], np.full(len(d), -1)]),
        )
        kinds = (pa.int64(), pa.int64(), pa.int64(), pa.int32(), pa.int32(), pa.int32())
        yield pa.RecordBatch.from_arrays(
            [pa.array(v.astype(k.to_pandas_dtype()), k) for v, k in zip(out, kinds)],
            ["anchor", "segment", "doc", "first", "last", "place"],
        )


def _settle(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """From rows by (anchor, segment, doc, first): repeated intervals, and open segments.

    Streams: of a group of any size only its first row and that of the segment are held.
    Open segments keep their place; intervals have place -1.
    """
    held: dict | None = None  # last group: anchor, segment, first row of the segment, pending
    for batch in batches:
        columns = [batch.column(k).to_numpy() for k in ("anchor", "segment", "doc", "first", "last", "place")]
        done = columns[5] < 0
        rows = np.stack([c[~done].astype(np.int64) for c in columns])
        repeated = [np.stack([c[done].astype(np.int64) for c in columns])]
        opened = []
        n = rows.shape[1]
        if n:
            key, segment, doc, first = rows[:4]
            new_key = np.ones(n, bool)
            new_key[1:] = key[1:] != key[:-1]
            new_segment = new_key.copy()
            new_segment[1:] |= segment[1:] != segment[:-1]
            goes_on = held is not None and held["anchor"] == key[0]
            same = goes_on and held["segment"] == segment[0]
            new_key[0], new_segment[0] = not goes_on, not same
            start = np.where(new_segment, np.arange(n), -1)
            origin = np.maximum.accumulate(start)
            own = np.where(origin >= 0, doc[origin], held["row"][2] if same else 0)
            at = np.where(origin >= 0, first[origin], held["row"][3] if same else 0)
            repeated.append(rows[:, ~new_segment & ((doc != own) | (first != at))])
            group = np.cumsum(new_key)  # 0 is the group that goes on
            kinds = np.bincount(group, weights=new_segment, minlength=group[-1] + 1)
            if goes_on:
                if kinds[0] and held["pending"]:
                    opened.append(held["lead"][:, None])
                    held["pending"] = False
                kinds[0] += 1
            opened.append(rows[:, new_segment & (kinds[group] > 1)])
            tail = np.flatnonzero(new_segment)
            row = rows[:, tail[-1]] if len(tail) else held["row"]
            if group[-1] == 0:
                held = held | {"segment": segment[-1], "row": row}
            else:
                lead = np.flatnonzero(new_key)[-1]
                held = {"anchor": key[-1], "segment": segment[-1], "row": row, "lead": rows[:, lead], "pending": kinds[group[-1]] == 1}
        again = np.concatenate(repeated, axis=1)
        d, a, b = _intervals(again[2], again[3], again[4])
        still = np.concatenate(opened, axis=1) if opened else np.zeros((6, 0), np.int64)
        out = (
            np.append(np.zeros(len(d), np.int64), still[0]), np.append(d, still[2]), np.append(a, still[3]),
            np.append(b, still[4]), np.append(np.full(len(d), -1), still[5]),
        )
        kinds = (pa.int64(), pa.int64(), pa.int32(), pa.int32(), pa.int32())
        yield pa.RecordBatch.from_arrays(
            [pa.array(v.astype(k.to_pandas_dtype()), k) for v, k in zip(out, kinds)], ["anchor", "doc", "first", "last", "place"]
        )


class _Piece:
    """Bytes around an anchor whose strings start from..to places from it, and whose they are."""

    __slots__ = ("data", "doc", "anchor", "start", "stop")

    def __init__(self, data: bytes, doc: int, anchor: int, start: int, stop: int):
        self.data, self.doc, self.anchor, self.start, self.stop = data, doc, anchor, start, stop

    def cut(self, low: int, high: int) -> "_Piece | None":
        a, b = max(self.start, low), min(self.stop, high)
        if a > b:
            return None
        return _Piece(self.data[a - self.start : b - self.start + LENGTH], self.doc, self.anchor, a, b)


def _told_apart(group: list[_Piece], low: int, high: int, repeated: list) -> Iterator[list[_Piece]]:
    """Groups of different pieces that can share a string, each small enough for one array.

    Strings that start low..high places from the anchor all hold the same middle part, so
    pieces with different ones share none.  A group that is still too large is told apart by
    half as many starts; at one start only equal pieces are left.  Pieces come by text and
    place, so that of equal ones all but the first are repeated.
    """
    middle = (low + high) // 2
    for a, b in ((low, middle), (middle + 1, high)) if low < high else ((low, high),):
        classes: dict[bytes, list[_Piece]] = {}
        for piece in group:
            if (own := piece.cut(a, b)) is not None:
                skip = b - own.start
                classes.setdefault(own.data[skip : skip + LENGTH - (b - a)], []).append(own)
        for pieces_ in classes.values():
            if len(pieces_) < 2:
                continue
            different: dict[tuple[bytes, int], _Piece] = {}
            for piece in pieces_:
                if (first := different.setdefault((piece.data, piece.start), piece)) is not piece:
                    if (first.doc, first.anchor) != (piece.doc, piece.anchor):
                        repeated.append((piece.doc, piece.anchor + piece.start, piece.anchor + piece.stop))
            if len(different) < 2:
                continue
            some = list(different.values())
            if sum(len(p.data) + 1 for p in some) <= JOINT:
                yield some
            else:
                yield from _told_apart(some, a, b, repeated)


def _by_suffix_arrays(groups: list[list[_Piece]], repeated: list) -> None:
    """Add the repeated strings among the pieces of each group, found in its suffix array."""
    flat = [p for g in groups for p in g]
    lengths = np.array([len(p.data) + 1 for p in flat])
    symbols = np.frombuffer(b"\x00".join(p.data for p in flat) + b"\x00", np.uint8).astype(np.int16) + 2
    ends = np.cumsum(lengths)
    symbols[ends - 1] = 1  # between pieces, and below it the end of each array
    last = np.cumsum([len(g) for g in groups]) - 1
    symbols[ends[last] - 1] = 0
    begin = np.concatenate([[0], ends[last][:-1]])
    order = suffix_arrays(symbols, begin)
    owner = np.repeat(np.arange(len(flat)), lengths)
    within = order - (ends - lengths)[owner[order]]
    whole = within + LENGTH < lengths[owner[order]]
    order, within = order[whole], within[whole]
    if len(order) < 2:
        return
    array = np.repeat(np.arange(len(groups)), [sum(len(p.data) + 1 for p in g) for g in groups])[order]
    equal = array[1:] == array[:-1]
    look = np.flatnonzero(equal)
    view = np.lib.stride_tricks.sliding_window_view(symbols, LENGTH)
    for at in range(0, len(look), 65536):
        k = look[at : at + 65536]
        equal[k] = (view[order[k]] == view[order[k + 1]]).all(axis=1)
    cls = np.concatenate([[0], np.cumsum(~equal)])
    piece = owner[order]
    doc, anchor, start = (np.array([getattr(p, k) for p in flat], np.int64) for k in ("doc", "anchor", "start"))
    place = anchor[piece] + start[piece] + within
    by = np.lexsort((place, doc[piece], cls))
    cls, piece, place = cls[by], piece[by], place[by]
    new = np.concatenate([[True], cls[1:] != cls[:-1]])
    origin = np.maximum.accumulate(np.where(new, np.arange(len(cls)), 0))
    again = (doc[piece] != doc[piece[origin]]) | (place != place[origin])
    repeated.extend(zip(doc[piece[again]].tolist(), place[again].tolist(), place[again].tolist()))


def _compare(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Repeated starts among the segments of each anchor, rows by (anchor, doc, first)."""
    groups, held, repeated = [], 0, []

    def flush() -> pa.RecordBatch:
        nonlocal groups, held, repeated
        if groups:
            _by_suffix_arrays(groups, repeated)
        found = np.array(repeated, np.int64).reshape(-1, 3)
        groups, held, repeated = [], 0, []
        doc, first, last = _intervals(*found.T)
        return pa.RecordBatch.from_arrays(
            [pa.array(doc), pa.array(first.astype(np.int32)), pa.array(last.astype(np.int32))], ["doc", "first", "last"]
        )

    for rows in key_runs(batches, "anchor"):
        columns = (rows[k].to_pylist() for k in ("data", "doc", "place", "first", "last"))
        segments = [_Piece(data, doc, place, first - place, last - place) for data, doc, place, first, last in zip(*columns)]
        for group in _told_apart(segments, KEY - LENGTH, 0, repeated):
            groups.append(group)
            held += sum(len(p.data) + 1 for p in group)
            if held >= AT_ONCE:
                yield flush()
        if len(repeated) > AT_ONCE:
            yield flush()
    yield flush()


def _string_rows(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(a, b, doc, at) of each string of a segment; a and b are 128 bits of hash of its bytes."""
    place = np.arange(LENGTH)
    for batch in batches:
        for begin in range(0, len(batch), 256):
            part = batch.slice(begin, 256)
            hashes, docs, starts = [], [], []
            for data, doc, first in zip(*(part.column(k).to_pylist() for k in ("data", "doc", "first"))):
                strings = np.lib.stride_tricks.sliding_window_view(np.frombuffer(data, np.uint8), LENGTH)
                hashes.append(np.stack([np.bitwise_xor.reduce(table[place, strings], axis=1) for table in _STRING]))
                docs.append(np.full(len(strings), doc))
                starts.append(first + np.arange(len(strings)))
            if hashes:
                a, b = np.concatenate(hashes, axis=1).view(np.int64)
                yield pa.RecordBatch.from_arrays(
                    [pa.array(a), pa.array(b), pa.array(np.concatenate(docs)), pa.array(np.concatenate(starts).astype(np.int32))],
                    ["a", "b", "doc", "at"],
                )


def _by_grouping(segments: DataFrame) -> DataFrame:
    """Repeated starts of the strings of ``segments``, each string a row of its own.

    For anchors with very many surroundings: rows are dealt by string, their first place is a
    partial aggregate, and what only one place has goes before the join.
    """
    strings = stage(segments.mapInArrow(_string_rows, "a long, b long, doc long, at int"), "strings")
    place = F.struct("doc", "at")
    lead = strings.groupBy("a", "b").agg(F.min(place).alias("lead"), F.max(place).alias("tail")).where("lead <> tail")
    again = strings.join(lead.drop("tail"), ["a", "b"]).where(place != F.col("lead"))
    return again.select("doc", F.col("at").alias("first"), F.col("at").alias("last"))


def repeated_starts(docs: DataFrame) -> DataFrame:
    """(doc, first, last): every start of a string of LENGTH bytes that also starts earlier.

    ``docs`` has id (long) and text, and rows of one id have one text.
    """
    dealt = docs.mapInArrow(_anchor_rows, _ANCHOR).repartition("anchor").sortWithinPartitions("anchor", "segment", "doc", "first")
    settled = stage(dealt.mapInArrow(_settle, "anchor long, doc long, first int, last int, place int"), "settled")
    still = settled.where("place >= 0")
    hot = stage(still.groupBy("anchor").agg(F.count("*").alias("n")).where(F.col("n") > HOT).select("anchor", F.lit(True).alias("hot")), "hot")
    n_hot = hot.limit(HOT_ANCHORS + 1).count()
    if n_hot <= HOT_ANCHORS:
        hot = F.broadcast(hot)
    still = still.join(hot, "anchor", "left").withColumn("hot", F.coalesce("hot", F.lit(False)))
    # a document's segments are fewer than its bytes
    opened = still.groupBy("doc").agg(F.collect_set(F.struct("anchor", "first", "last", "place", "hot")).alias("open"))

    def cut(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in pieces(batches):
            out: dict[str, list] = {k: [] for k in ("anchor", "doc", "first", "last", "place", "hot", "data")}
            for doc, text, segments in zip(*(batch.column(k).to_pylist() for k in ("id", "text", "open"))):
                data = (text or "").encode()
                for s in segments:
                    for k in ("anchor", "first", "last", "place", "hot"):
                        out[k].append(s[k])
                    out["doc"].append(doc)
                    out["data"].append(data[s["first"] : s["last"] + LENGTH])
            kinds = (pa.int64(), pa.int64(), pa.int32(), pa.int32(), pa.int32(), pa.bool_(), pa.binary())
            yield pa.RecordBatch.from_arrays([pa.array(v, k) for v, k in zip(out.values(), kinds)], list(out))

    segments = docs.join(opened, F.col("id") == F.col("doc")).select("id", "text", "open").mapInArrow(
        cut, "anchor long, doc long, first int, last int, place int, hot boolean, data binary"
    )
    if n_hot:
        segments = stage(segments, "segments")
    cold = segments.where("not hot").drop("hot").repartition("anchor").sortWithinPartitions("anchor", "doc", "first")
    compared = cold.mapInArrow(_compare, "doc long, first int, last int")
    found = settled.where("place < 0").select("doc", "first", "last").union(compared)
    return found.union(_by_grouping(segments.where("hot"))) if n_hot else found


def _numbered(docs: DataFrame) -> DataFrame:
    """doc_id, text and id: a number for each distinct (doc_id, text) that keeps the order of ids.

    Null ids come first; different texts under one id are ordered by hash.  Where every id has
    one text the id is its own number and no text is moved.
    """
    rows = docs.select("doc_id", "text", F.coalesce(F.col("doc_id").cast("long"), F.lit(-(2**63))).alias("id"))
    text = F.coalesce("text", F.lit(""))
    known = F.struct(F.col("doc_id").isNotNull().alias("k"), F.xxhash64(text).alias("a"), F.xxhash64(F.lit("#"), text).alias("b"))
    hashed = rows.withColumn("h", known)
    each = stage(hashed.groupBy("id", "h").agg(F.lit(1).alias("one")).drop("one"), "texts")
    if each.groupBy("id").count().where("count > 1").isEmpty():
        return rows
    numbers = stage(each.orderBy("id", "h").withColumn("number", F.monotonically_increasing_id()), "numbers")
    return hashed.join(numbers, ["id", "h"]).select("doc_id", "text", F.col("number").alias("id"))


def remove_repeats(docs: DataFrame) -> DataFrame:
    """doc_id, n_bytes, n_removed, n_spans, kept_sha256 and kept (binary) of each row.

    Removed is every byte of a string of LENGTH bytes that starts earlier too: in a document
    of a smaller id, or before in the same one.  A null text is empty; a null id comes before
    all others.  Rows that repeat an id and its text are one document and get one result each;
    different texts under one id, or without any, are documents of their own in the order of
    their hashes.  Texts of any length are read in overlapping parts.
    """
    rows = _numbered(docs)
    gone = (
        repeated_starts(rows.select("id", "text"))
        .groupBy("doc").agg(F.collect_list(F.struct("first", "last")).alias("gone"))
    )
    kind = docs.schema["doc_id"].dataType.simpleString()

    def finish(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in pieces(batches):
            out = []
            for text, gone in zip(batch.column("text").to_pylist(), batch.column("gone")):
                data = (text or "").encode()
                mark = np.zeros(len(data) + 1, np.int32)
                if gone.is_valid and len(gone.values):
                    first, last = (gone.values.field(k).to_numpy().astype(np.int64) for k in ("first", "last"))
                    np.add.at(mark, first, 1)
                    np.add.at(mark, last + LENGTH, -1)
                removed = np.cumsum(mark[:-1]) > 0
                edges = np.diff(removed.astype(np.int8), prepend=0) == 1
                kept = np.frombuffer(data, np.uint8)[~removed].tobytes()
                out.append((len(data), int(removed.sum()), int(edges.sum()), sha(kept), kept))
            kinds = (pa.int64(), pa.int64(), pa.int64(), pa.string(), pa.binary())
            yield pa.RecordBatch.from_arrays(
                [batch.column("doc_id"), *(pa.array([r[k] for r in out], t) for k, t in enumerate(kinds))],
                ["doc_id", "n_bytes", "n_removed", "n_spans", "kept_sha256", "kept"],
            )

    return (
        rows.join(gone, F.col("id") == F.col("doc"), "left").select("doc_id", "text", "gone")
        .mapInArrow(finish, f"doc_id {kind}, n_bytes long, n_removed long, n_spans long, kept_sha256 string, kept binary")
    )
