"""Interval joins through time bins, so that they stay equi-joins on (key, bin)."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def time_bin(value: Column, width: int) -> Column:
    return F.floor(value / F.lit(width)).cast("bigint")


def spread_bins(df: DataFrame, lo: Column, hi: Column, width: int, name: str = "__bin") -> DataFrame:
    """One row per bin an interval touches."""
    return df.filter(hi >= lo).withColumn(
        name, F.explode(F.sequence(time_bin(lo, width), time_bin(hi, width)))
    )


def points_in_intervals(
    points: DataFrame,
    at: str,
    intervals: DataFrame,
    lo: str,
    hi: str,
    keys: list[str],
    width: int,
) -> DataFrame:
    """Inner join of points with the closed intervals holding them.

    A point lies in exactly one bin and the exact predicate is applied after the bin
    match, so no pair can appear twice.
    """
    left = points.withColumn("__bin", time_bin(F.col(at), width))
    right = spread_bins(intervals, F.col(lo), F.col(hi), width)
    return (
        left.join(right, [*keys, "__bin"])
        .filter((F.col(at) >= F.col(lo)) & (F.col(at) <= F.col(hi)))
        .drop("__bin")
    )
