"""Ordered scans over tracks of any length.

A window partitioned by track alone puts a whole track into one task, and one track
may hold a third of all rows.  ``scan`` therefore works on two levels: windows inside
(track, chunk), where a chunk is a bounded stretch of the track, and windows over one
summary row per chunk.  The summary is joined back on (track, chunk), a key that is
never hot.  Results equal the plain one-level window.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from cadenza.session import configure

CHUNK_ROWS = 32_768

_TOTALS = {"sum": F.sum, "min": F.min, "max": F.max}


def by_rows(index: str, size: int | None = None) -> Column:
    """Chunk of a dense per-track row index: at most ``size`` rows each."""
    size = size or CHUNK_ROWS
    return F.expr(f"cast({index} div {size} as bigint)")


def by_time(time: str, width_us: int) -> Column:
    """Chunk of a time column, for rows that have no dense index yet."""
    return F.expr(f"cast(floor({time} / {width_us}) as bigint)")


def scan(
    df: DataFrame,
    keys: list[str],
    order: list[str],
    chunk: Column,
    *,
    lag: dict[str, Column] | None = None,
    lead: dict[str, Column] | None = None,
    last_upto: dict[str, Column] | None = None,
    last_before: dict[str, Column] | None = None,
    first_after: dict[str, Column] | None = None,
    sum_upto: dict[str, Column] | None = None,
    sum_before: dict[str, Column] | None = None,
    max_before: dict[str, Column] | None = None,
    total: dict[str, tuple[str, Column]] | None = None,
) -> DataFrame:
    """Add ordered-track columns; each mapping is ``output name -> value expression``.

    ``lag``/``lead``: value of the neighbouring row.  ``last_upto``/``last_before``/
    ``first_after``: nearest non-null value at or before / before / after the row.
    ``sum_upto``/``sum_before``/``max_before``: running aggregates.  ``total``:
    ``(sum|min|max, expression)`` over the whole track.  ``order`` must be unique
    within a track and ``chunk`` must not decrease along it.
    """
    groups = {
        "lag": lag or {},
        "lead": lead or {},
        "last_upto": last_upto or {},
        "last_before": last_before or {},
        "first_after": first_after or {},
        "sum_upto": sum_upto or {},
        "sum_before": sum_before or {},
        "max_before": max_before or {},
    }
    configure(df.sparkSession)
    total = total or {}
    if "__chunk" in df.columns:
        raise ValueError("__chunk is the scan's own column name")
    # the carried value of each request gets a short internal name
    wanted = [(kind, out, expr) for kind, specs in groups.items() for out, expr in specs.items()]
    values = {f"__v{i}": expr for i, (_, _, expr) in enumerate(wanted)}
    totals = {f"__t{i}": expr for i, (_, expr) in enumerate(total.values())}
    rows = df.withColumns({**values, **totals, "__chunk": chunk})

    # one order column of a fixed-width type keeps the summary in a hash aggregate
    at = F.col(order[0]) if len(order) == 1 else F.struct(*order)
    summary, carry = [], {}
    along = Window.partitionBy(*keys).orderBy("__chunk")
    earlier = along.rowsBetween(Window.unboundedPreceding, -1)
    back = Window.partitionBy(*keys).orderBy(F.col("__chunk").desc())
    later = back.rowsBetween(Window.unboundedPreceding, -1)
    whole = Window.partitionBy(*keys)
    for i, (kind, _, _) in enumerate(wanted):
        v, s, c = F.col(f"__v{i}"), f"__s{i}", f"__c{i}"
        if kind == "lag":
            summary.append(F.max_by(v, at).alias(s))
            carry[c] = F.lag(s).over(along)
        elif kind == "lead":
            summary.append(F.min_by(v, at).alias(s))
            carry[c] = F.lead(s).over(along)
        elif kind in ("last_upto", "last_before"):
            summary.append(F.max_by(v, F.when(v.isNotNull(), at)).alias(s))
            carry[c] = F.last(s, ignorenulls=True).over(earlier)
        elif kind == "first_after":
            summary.append(F.min_by(v, F.when(v.isNotNull(), at)).alias(s))
            carry[c] = F.last(s, ignorenulls=True).over(later)
        elif kind in ("sum_upto", "sum_before"):
            summary.append(F.sum(v).alias(s))
            carry[c] = F.coalesce(F.sum(s).over(earlier), F.lit(0))
        else:
            summary.append(F.max(v).alias(s))
            carry[c] = F.max(s).over(earlier)
    for i, (fn, _) in enumerate(total.values()):
        summary.append(_TOTALS[fn](f"__t{i}").alias(f"__ts{i}"))
        carry[f"__tc{i}"] = _TOTALS[fn](f"__ts{i}").over(whole)

    chunks = rows.groupBy(*keys, "__chunk").agg(*summary)
    chunks = chunks.select(
        *[F.col(k).alias(f"__k{i}") for i, k in enumerate(keys)],
        F.col("__chunk").alias("__kc"),
        *[expr.alias(name) for name, expr in carry.items()],
    )

    inside = Window.partitionBy(*keys, "__chunk").orderBy(*order)
    upto = inside.rowsBetween(Window.unboundedPreceding, 0)
    before = inside.rowsBetween(Window.unboundedPreceding, -1)
    reverse = Window.partitionBy(*keys, "__chunk").orderBy(*[F.col(o).desc() for o in order])
    after = reverse.rowsBetween(Window.unboundedPreceding, -1)
    local = {}
    if groups["lag"]:
        local["__first"] = F.lag(F.lit(1)).over(inside).isNull()
    if groups["lead"]:
        local["__last"] = F.lead(F.lit(1)).over(inside).isNull()
    for i, (kind, _, _) in enumerate(wanted):
        v = F.col(f"__v{i}")
        local[f"__w{i}"] = {
            "lag": lambda v: F.lag(v).over(inside),
            "lead": lambda v: F.lead(v).over(inside),
            "last_upto": lambda v: F.last(v, ignorenulls=True).over(upto),
            "last_before": lambda v: F.last(v, ignorenulls=True).over(before),
            "first_after": lambda v: F.last(v, ignorenulls=True).over(after),
            "sum_upto": lambda v: F.sum(v).over(upto),
            "sum_before": lambda v: F.sum(v).over(before),
            "max_before": lambda v: F.max(v).over(before),
        }[kind](v)
    rows = rows.withColumns(local) if local else rows

    on = [F.col(k) == F.col(f"__k{i}") for i, k in enumerate(keys)]
    joined = rows.join(chunks, on + [F.col("__chunk") == F.col("__kc")], "inner")
    out = {}
    for i, (kind, name, _) in enumerate(wanted):
        w, c = F.col(f"__w{i}"), F.col(f"__c{i}")
        if kind == "lag":
            out[name] = F.when(F.col("__first"), c).otherwise(w)
        elif kind == "lead":
            out[name] = F.when(F.col("__last"), c).otherwise(w)
        elif kind in ("sum_upto", "sum_before"):
            out[name] = F.coalesce(w, F.lit(0)) + c
        elif kind == "max_before":
            out[name] = F.greatest(w, c)
        else:
            out[name] = F.coalesce(w, c)
    for i, name in enumerate(total):
        out[name] = F.col(f"__tc{i}")
    kept = [c for c in df.columns if c not in out]
    return joined.select(*kept, *[expr.alias(name) for name, expr in out.items()])


def dense_index(df: DataFrame, keys: list[str], order: list[str], chunk: Column, name: str) -> DataFrame:
    """Number the rows of each track 0, 1, 2, ... in the given order."""
    return scan(df, keys, order, chunk, sum_before={name: F.lit(1).cast("bigint")})


def nearest_neighbours(
    points: DataFrame,
    targets: DataFrame,
    keys: list[str],
    point_time: str,
    point_id: list[str],
    target_time: str,
    width_us: int,
    payload: list[str] | None = None,
) -> DataFrame:
    """As-of join in both directions.

    Adds ``prev`` (latest target at or before the point) and ``next`` (earliest target
    after it), structs of ``at`` and the payload columns.  Points and targets are
    merged into one ordered track, so the cost is linear and no pairs are formed.
    """
    payload = payload or []
    held = F.struct(F.col(target_time).alias("at"), *payload)
    t = targets.select(
        *keys,
        F.col(target_time).alias("__time"),
        F.lit(0).alias("__side"),
        held.alias("__target"),
        F.lit(None).cast(points.select(F.struct("*")).schema[0].dataType).alias("__point"),
        *[F.lit(None).cast(points.schema[c].dataType).alias(f"__id{i}") for i, c in enumerate(point_id)],
    )
    p = points.select(
        *keys,
        F.col(point_time).alias("__time"),
        F.lit(1).alias("__side"),
        F.lit(None).cast(targets.select(held).schema[0].dataType).alias("__target"),
        F.struct(*points.columns).alias("__point"),
        *[F.col(c).alias(f"__id{i}") for i, c in enumerate(point_id)],
    )
    merged = t.unionByName(p)
    order = ["__time", "__side", *[f"__id{i}" for i in range(len(point_id))]]
    found = scan(
        merged,
        keys,
        order,
        by_time("__time", width_us),
        last_upto={"prev": F.col("__target")},
        first_after={"next": F.col("__target")},
    )
    return found.filter("__side = 1").select("__point.*", "prev", "next")
