"""Joins against one-row-per-key tables when one key may hold a large share of the rows.

Run-time skew splitting needs a bare shuffle on both sides, which a table that was just
aggregated does not offer, so the hot key is spread here by hand.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

SALTS = 32
HOT_SHARE = 1000


def grown(table: DataFrame) -> DataFrame:
    """A side of a join that grows with the catalogue: never sent through the driver.

    Spark judges a table by its files, and a hundredth of its rows' size is usual there for staged
    positions and ids; what would then be broadcast is shuffled and sorted instead.
    """
    return table.hint("merge")


def join_small(
    rows: DataFrame,
    table: DataFrame,
    keys: list[str],
    by: list[str],
    how: str = "inner",
    salts: int = SALTS,
) -> DataFrame:
    """Join rows with a narrow table (one row per key) repeated once per salt.

    The salt of a row is a hash of its ``by`` columns, so a key's rows spread over
    ``salts`` tasks and a retried task assigns them alike.  ``how`` may be inner, left,
    left_semi or left_anti.  Both sides are shuffled: Spark takes the copies for no larger than
    the table, so its own choice would send all of them through the driver.
    """
    salted = rows.withColumn("__salt", F.pmod(F.xxhash64(*by), F.lit(salts)).cast("int"))
    copies = table.withColumn("__salt", F.explode(F.sequence(F.lit(0), F.lit(salts - 1))))
    return salted.join(copies.hint("merge"), [*keys, "__salt"], how).drop("__salt")


def join_unique(rows: DataFrame, table: DataFrame, keys: list[str]) -> DataFrame:
    """Inner join with a wide table (one row per key), hot keys apart.

    A key is hot when it holds at least a thousandth of all rows, so there are never more
    than a thousand of them: that part of the table is broadcast, whatever its size.  The
    rest is shuffled and has no hot key left.
    """
    counts = rows.groupBy(*keys).agg(F.count(F.lit(1)).alias("__n"))
    total = rows.agg(F.count(F.lit(1)).alias("__all")).scalar()
    hot = counts.filter(F.col("__n") * HOT_SHARE >= total).select(*keys)
    few = F.broadcast(table.join(F.broadcast(hot), keys, "left_semi"))
    rest = rows.join(F.broadcast(hot), keys, "left_anti")
    return rows.join(few, keys).unionByName(rest.join(table, keys))
