"""Registered queries over the given tables, with SQL that must give the same rows."""

from __future__ import annotations

import importlib
import pkgutil
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

Query = Callable[[SparkSession, str], DataFrame]


def _sections():
    for info in sorted(pkgutil.iter_modules(__path__), key=lambda m: m.name):
        module = importlib.import_module(f"{__name__}.{info.name}")
        if hasattr(module, "QUERIES"):
            yield module


def queries() -> dict[str, Query]:
    return {name: query for section in _sections() for name, query in section.QUERIES.items()}


def oracle_sql() -> dict[str, str]:
    return {name: sql for section in _sections() for name, sql in section.ORACLE.items()}


def flagship(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Captions -> overlaps trimmed -> silences marked -> summary per track."""
    from cadenza.operators.tracks import gap_markers, overlap_trim
    from cadenza.sources.testbed import captions

    marked = gap_markers(overlap_trim(captions(spark, sf_dir)))
    length = F.col("end_us") - F.col("start_us")
    return marked.groupBy("track_id").agg(
        F.count(F.lit(1)).alias("rows"),
        F.count_if("instrumental").alias("music_rows"),
        F.sum(F.when(F.col("instrumental"), length).otherwise(0)).alias("music_us"),
        F.round(F.avg(F.when(~F.col("instrumental"), F.col("confidence"))), 6).alias("mean_confidence"),
    )
