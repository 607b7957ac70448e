"""Licence scan: ordered signatures behind a keyword prefilter."""

from __future__ import annotations

import re
from bisect import bisect_right
from collections.abc import Iterable, Iterator
from typing import NamedTuple

import pyarrow as pa
from pyspark.sql import DataFrame

from cadenza.llm.base import normal_bytes, pieces
from cadenza.llm.license_rules import RULES

#: Fixed phrases and labels that always count, wherever their words stand.
BASE = ((b"cc by", "cc-by"), (b"general public license", "gpl"), (b"all rights reserved", "reserved"))


class Rule(NamedTuple):
    order: int
    label: str
    priority: int
    pattern: re.Pattern


class Found(NamedTuple):
    label: str
    priority: int
    start: int
    end: int


def _rules() -> dict[bytes, list[Rule]]:
    out: dict[bytes, list[Rule]] = {}
    for order, line in enumerate(filter(None, RULES.splitlines())):
        label, priority, keyword, pattern = (x.strip() for x in line.split(" | ", 3))
        compiled = re.compile(rb"(?<= )(?:" + pattern.encode() + rb")(?= )")
        out.setdefault(keyword.encode(), []).append(Rule(order, label, int(priority), compiled))
    return out


_BY_KEYWORD = _rules()
_KEYWORDS = frozenset(_BY_KEYWORD)


def base_places(normal: bytes) -> list[tuple[int, str]]:
    """(first word, label) of every place of a base phrase, overlapping ones too."""
    padded, out = b" " + normal + b" ", []
    for phrase, label in BASE:
        needle, at, word, counted = b" " + phrase + b" ", -1, 0, 0
        while (at := padded.find(needle, at + 1)) >= 0:
            word, counted = word + padded.count(b" ", counted, at), at
            out.append((word, label))
    return out


def detections(normal: bytes, words: list[bytes]) -> list[Found]:
    """Detections that no other suppresses.

    By falling priority, then falling length, then place and order of the rules; one that
    lies inside an accepted one, both ends included, is suppressed.
    """
    active = _KEYWORDS.intersection(words)
    if not active:
        return []
    padded = b" " + normal + b" "
    spaces, found = None, []
    for keyword in active:
        for rule in _BY_KEYWORD[keyword]:
            for m in rule.pattern.finditer(padded):
                if spaces is None:
                    spaces = [k for k, b in enumerate(padded) if b == 32]
                start = bisect_right(spaces, m.start()) - 1
                end = bisect_right(spaces, m.end() - 1)
                found.append((-rule.priority, start - end, start, rule.order, Found(rule.label, rule.priority, start, end)))
    kept: list[Found] = []
    places = {start: k for k, start in enumerate(sorted({f[2] for f in found}), 1)}
    reach = [-1] * (len(places) + 1)  # Fenwick tree: furthest end of what starts up to a place
    for *_, one in sorted(found):
        at = p = places[one.start]
        covered = -1
        while p:
            covered, p = max(covered, reach[p]), p & (p - 1)
        if covered < one.end:
            kept.append(one)
            while at < len(reach):
                reach[at], at = max(reach[at], one.end), at + (at & -at)
    return sorted(kept, key=lambda f: (f.start, f.end, f.label))


def scan_text(text: str | None) -> tuple[int, list[tuple[int, str]], list[Found]]:
    """Number of words, places of base phrases, and detections of one text."""
    normal = normal_bytes(text)
    words = normal.split()
    return len(words), base_places(normal), detections(normal, words)


def scan_licenses(docs: DataFrame) -> DataFrame:
    """One row per row of ``docs``: counts, labels and the detections as spans of words.

    A null text is empty: no words, null places, empty label strings, score 0.  The score is
    the highest priority over 100, at least a half where a base phrase stands.
    """
    kind = docs.schema["doc_id"].dataType.simpleString()
    schema = (
        f"doc_id {kind}, n_words long, n_base long, first_word long, last_word long, base_labels string, "
        "labels string, score double, spans array<struct<label:string,priority:int,start:long,end:long>>"
    )
    arrow = pa.schema([
        ("n_words", pa.int64()), ("n_base", pa.int64()), ("first_word", pa.int64()), ("last_word", pa.int64()),
        ("base_labels", pa.string()), ("labels", pa.string()), ("score", pa.float64()),
        ("spans", pa.list_(pa.struct([("label", pa.string()), ("priority", pa.int32()), ("start", pa.int64()), ("end", pa.int64())]))),
    ])

    def row(text: str | None) -> tuple:
        n_words, base, found = scan_text(text)
        starts = [at for at, _ in base]
        own = {label for _, label in base}
        score = max([f.priority / 100 for f in found] + [0.5 if base else 0.0])
        return (
            n_words, len(base), min(starts, default=None), max(starts, default=None), ",".join(sorted(own)),
            ",".join(sorted(own | {f.label for f in found})), score, [f._asdict() for f in found],
        )

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in pieces(batches):
            rows = [row(t) for t in batch.column("text").to_pylist()]
            columns = [pa.array([r[k] for r in rows], f.type) for k, f in enumerate(arrow)]
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), *columns], ["doc_id", *arrow.names])

    return docs.select("doc_id", "text").mapInArrow(run, schema)
