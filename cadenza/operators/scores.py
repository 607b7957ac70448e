"""Quality scores and counts per line and track."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from cadenza.functions.timecode import clamp
from cadenza.plans.skew import grown

LINE = ["track_id", "line_index"]


def line_confidence(lines: DataFrame, words: DataFrame) -> DataFrame:
    """0.55 x share of matched words + 0.45 x mean word confidence; 0.2 without words."""
    scored = words.groupBy(*LINE).agg(
        F.avg(F.col("matched").cast("double")).alias("m"), F.avg("confidence").alias("c")
    )
    value = F.when(F.col("m").isNull(), 0.2).otherwise(clamp(0.55 * F.col("m") + 0.45 * F.col("c"), 0.0, 1.0))
    return lines.join(grown(scored), LINE, "left").select(*LINE, F.round(value, 6).alias("confidence"))


def line_score(captions: DataFrame, words: DataFrame, anchors: DataFrame) -> DataFrame:
    """Final score of each caption from its words, its anchor and its own confidence.

    Anchors are looked up by vocal ordinal, ``line_index`` in all three tables.
    """
    w = words.groupBy(*LINE).agg(
        F.avg((F.col("confidence") >= 0.45).cast("double")).alias("dense"),
        F.avg((F.col("confidence") < 0.3).cast("double")).alias("gaps"),
    )
    a = anchors.groupBy(*LINE).agg(F.min_by("confidence", "anchor_id").alias("anchor"))
    score = (
        0.45 * F.col("dense")
        + 0.2 * (1 - F.col("gaps"))
        + 0.2 * F.coalesce("anchor", F.lit(0.5))
        + 0.15 * F.col("confidence")
    )
    value = (
        F.when(F.col("instrumental"), 1.0).when(F.col("dense").isNull(), 0.2).otherwise(clamp(score, 0.0, 1.0))
    )
    return (
        captions.join(grown(w), LINE, "left").join(grown(a), LINE, "left").select(*LINE, F.round(value, 6).alias("score"))
    )


def sync_summary(captions: DataFrame, dropped: DataFrame) -> DataFrame:
    """Per track: weak lines, mean confidence of sung lines, dropped transcript words.

    ``dropped[track_id, dropped]``.
    """
    sung = ~F.col("instrumental")
    per_track = captions.groupBy("track_id").agg(
        F.count_if(sung & (F.col("confidence") < 0.6)).alias("flagged"),
        F.round(F.coalesce(F.avg(F.when(sung, F.col("confidence"))), F.lit(0.0)), 6).alias("mean_confidence"),
    )
    return per_track.join(dropped, ["track_id"], "left").select(
        "track_id", "flagged", "mean_confidence", F.coalesce("dropped", F.lit(0)).cast("bigint").alias("dropped")
    )


def realign_confidence(lines: DataFrame, words: DataFrame) -> DataFrame:
    """Mean word confidence of each re-timed line, 0.5 without words."""
    mean = words.groupBy(*LINE).agg(F.avg("confidence").alias("c"))
    return lines.join(mean, LINE, "left").select(
        *LINE, F.round(F.coalesce("c", F.lit(0.5)), 6).alias("confidence")
    )


def sheet_counts(lines: DataFrame) -> DataFrame:
    """Sung and blank lines of a sheet, and the length to assume without audio."""
    counted = lines.groupBy("doc_id").agg(
        F.count_if(~F.col("instrumental")).alias("vocal"), F.count_if("instrumental").alias("instrumental")
    )
    return counted.withColumn(
        "estimated_us", F.greatest(F.lit(30_000_000), F.col("vocal") * 3_800_000).cast("bigint")
    )
