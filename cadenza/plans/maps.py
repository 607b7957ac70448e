"""What a chunk of a fold does to any state that enters it, and the composition of such maps.

A rule whose chunks can be summed up this way needs no guess: maps are composed over ever
longer stretches (1, 2, 4, ... chunks), and after as many rounds as the number of chunks has
binary digits, every chunk knows the state that the start of the track leaves it.
"""

from __future__ import annotations

import json
import sys
from collections.abc import Callable
from typing import NamedTuple

import pandas as pd
from pyspark import cloudpickle
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import LongType, StringType

from cadenza.plans.ordered import by_rows, dense_index, scan
from cadenza.session import stage

# the Arrow functions travel with the job, so executors need no copy of this package
cloudpickle.register_pickle_by_value(sys.modules[__name__])


class ChunkMaps(NamedTuple):
    """Maps of one rule.

    ``build`` adds column ``__map`` to a table of chunks (keys, ``__part``, ``__items``);
    ``then(first, second)`` is the map of two stretches after one another; ``leave(map, row)``
    the state behind a stretch that begins a track, ``row`` holding the stretch's last item.
    """

    build: Callable[[DataFrame, list[str]], DataFrame]
    then: Callable[[Column, Column], Column]
    leave: Callable[[Column, Column], Column]


def entry_states(packed: DataFrame, keys: list[str], start: Column, maps: ChunkMaps) -> DataFrame:
    """(keys, ``__part``, ``__in``): the state that enters each chunk."""
    on = [*keys, "__part"]
    longest = packed.groupBy(*keys).agg(F.count(F.lit(1)).alias("n")).agg(F.max("n")).first()[0] or 0
    if longest <= 1:
        return packed.select(*on, start.alias("__in"))
    last = F.element_at("__items", -1).alias("__last")
    chunks = dense_index(maps.build(packed, keys).select(*on, last, "__map"), keys, ["__part"], by_rows("__part"), "__at")
    chunks = stage(chunks, "fold-maps")
    reach = 1
    while reach < longest:
        before = chunks.select(*keys, (F.col("__at") + reach).alias("__at"), F.col("__map").alias("__before"))
        joined = chunks.join(before, [*keys, "__at"], "left")
        both = F.when(F.col("__before").isNull(), F.col("__map")).otherwise(maps.then(F.col("__before"), F.col("__map")))
        chunks = stage(joined.withColumn("__map", both).select(*chunks.columns), "fold-maps")
        reach *= 2
    left = chunks.withColumn("__out", maps.leave(F.col("__map"), F.col("__last")))
    linked = scan(left, keys, ["__part"], by_rows("__part"), lag={"__in": F.col("__out")})
    return linked.select(*on, F.coalesce("__in", start).alias("__in"))


# --- the largest of a constant and of halved sums ------------------------------------------


class Halvings:
    """a -> max(base, (a + sum) >> halvings for each piece): the sweep of a stretch of words.

    Per word the start becomes the largest of three terms in the start ``a`` before it: one without
    it, the midpoint with the word before, and a least step after it.  A maximum of such
    terms stays one when it is halved and shifted, so a stretch of any length has at most one
    piece for each number of halvings.  Pieces that no start up to ``top`` lifts over the
    base are dropped; after some fifty halvings none is left.
    """

    def __init__(self, base: int | None, pieces: dict[int, int], top: int):
        self.base, self.pieces, self.top = base, pieces, top

    @classmethod
    def same(cls, top: int) -> Halvings:
        return cls(None, {0: 0}, top)

    def at(self, a: int) -> int:
        values = [(a + c) >> k for k, c in self.pieces.items()]
        return max(values if self.base is None else [self.base, *values])

    def then(self, later: Halvings) -> Halvings:
        bases = [b for b in (later.base, None if self.base is None else later.at(self.base)) if b is not None]
        pieces: dict[int, int] = {}
        for k, c in self.pieces.items():
            for j, d in later.pieces.items():
                pieces[k + j] = max(pieces.get(k + j, c + (d << k)), c + (d << k))
        out = Halvings(max(bases, default=None), pieces, self.top)
        if out.base is not None:
            out.pieces = {k: c for k, c in pieces.items() if (out.top + c) >> k > out.base}
        return out

    def text(self) -> str:
        return json.dumps([self.base, sorted(self.pieces.items()), self.top])

    @classmethod
    def read(cls, text: str) -> Halvings:
        base, pieces, top = json.loads(text)
        return cls(base, dict(map(tuple, pieces)), top)


def sweep_map(starts: list[int], ends: list[int], end_before: int | None, top: int, least: int, step: int) -> Halvings:
    """The map of the start of the last word, over words with these raw times.

    ``end_before`` is the raw end of the word before them; ``least`` the least length of a word
    and ``step`` the least distance of starts.
    """
    out = Halvings.same(top)
    for start, end in zip(starts, ends):
        base = start if end_before is None else max(start, (end_before + start) >> 1)
        out = out.then(Halvings(base, {1: least + start, 0: step}, top))
        end_before = end
    return out


@F.pandas_udf(StringType())
def sweep_maps(starts: pd.Series, ends: pd.Series, end_before: pd.Series, top: pd.Series, least: pd.Series, step: pd.Series) -> pd.Series:
    rows = zip(starts, ends, end_before, top, least, step)
    return pd.Series([
        sweep_map([int(x) for x in s], [int(x) for x in e], None if pd.isna(b) else int(b), int(t), int(m), int(d)).text()
        for s, e, b, t, m, d in rows
    ])


@F.pandas_udf(StringType())
def maps_joined(first: pd.Series, second: pd.Series) -> pd.Series:
    return pd.Series([None if a is None else Halvings.read(a).then(Halvings.read(b)).text() for a, b in zip(first, second)])


@F.pandas_udf(LongType())
def map_base(text: pd.Series) -> pd.Series:
    return pd.Series([Halvings.read(t).base for t in text])
