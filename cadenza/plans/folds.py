"""Folds whose next step needs the previous *result*, over tracks of any length.

The track is cut into chunks of at most ``size`` rows, and each is folded from its entry
state.  Where a rule gives the maps of its chunks (``plans.maps``) these are composed and
every entry state is known after a logarithmic number of rounds.  Without maps, chunks are folded from
the start of a track; those whose entry differs from the exit state of the chunk before are
folded again, until nothing changes, which takes a round for each chunk that a state
lasts.  The outcome is exactly that of one long fold, yet no task ever holds more than
``size`` rows of a track.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from cadenza.plans.maps import ChunkMaps, entry_states
from cadenza.plans.ordered import by_rows, scan
from cadenza.session import stage

FOLD_ROWS = 1024

Step = Callable[[Column, Column], Column]


def chunked_fold(
    rows: DataFrame,
    keys: list[str],
    index: str,
    fields: list[str],
    start: Column,
    step: Step,
    emit: Callable[[Column, Column, Column], Column],
    size: int | None = None,
    maps: ChunkMaps | None = None,
) -> DataFrame:
    """Fold each track in ``index`` order and emit one row per input row.

    ``start`` is the entry state (a struct), ``step(state, row)`` the next state and
    ``emit(before, row, after)`` the struct emitted.  ``index`` must be unique per track.
    ``maps`` sum up the rule's chunks; with them no chunk is folded twice.
    """
    size = size or FOLD_ROWS
    packed = stage(
        rows.groupBy(*keys, F.expr(f"cast({index} div {size} as bigint)").alias("__part")).agg(
            F.array_sort(F.collect_list(F.struct(index, *fields))).alias("__items")
        ),
        "fold-rows",
    )
    on = [*keys, "__part"]

    states = _settled(packed, keys, start, step) if maps is None else stage(entry_states(packed, keys, start, maps), "fold-state")
    out_type = packed.join(states, on).select(
        emit(F.col("__in"), F.col("__items")[0], F.col("__in")).alias("e")
    ).schema[0].dataType
    final = packed.join(states.select(*on, "__in"), on)

    def grow(acc: Column, row: Column) -> Column:
        after = step(acc["state"], row)
        return F.struct(
            after.alias("state"),
            F.concat(acc["out"], F.array(emit(acc["state"], row, after))).alias("out"),
        )

    seed = F.struct(
        F.col("__in").alias("state"),
        F.array().cast(f"array<{out_type.simpleString()}>").alias("out"),
    )
    return final.select(
        *keys, F.explode(F.aggregate("__items", seed, grow)["out"]).alias("__row")
    ).select(*keys, "__row.*")


def _settled(packed: DataFrame, keys: list[str], start: Column, step: Step) -> DataFrame:
    """Entry states by folding again whatever chunk began with another state than it should."""
    on = [*keys, "__part"]

    def exits(df: DataFrame) -> DataFrame:
        return df.select(*on, "__in", F.aggregate("__items", F.col("__in"), step).alias("__out"))

    states = stage(exits(packed.withColumn("__in", start)), "fold-state")
    while True:
        linked = scan(states, keys, ["__part"], by_rows("__part"), lag={"__prev": F.col("__out")})
        linked = linked.withColumn("__new", F.coalesce("__prev", start))
        stale = linked.filter(~F.col("__new").eqNullSafe(F.col("__in")))
        if stale.isEmpty():
            return states
        redo = exits(packed.join(stale.select(*on, F.col("__new").alias("__in")), on))
        settled = linked.filter(F.col("__new").eqNullSafe(F.col("__in"))).select(*on, "__in", "__out")
        states = stage(settled.unionByName(redo), "fold-state")
