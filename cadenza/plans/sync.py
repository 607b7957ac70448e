"""The whole way from sheets and transcripts to timed captions, for a catalogue of tracks.

Stages hand over tables; those read more than once are staged in the shared folder.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from cadenza.functions.text import words_of
from cadenza.functions.timecode import seconds
from cadenza.operators.alignment import align_chain, normalize_tokens
from cadenza.operators.joins import anchor_remap, anchor_warp, match_times, segment_interval_join
from cadenza.operators.repair import transcript_sanitize
from cadenza.operators.scores import line_confidence, line_score, sync_summary
from cadenza.operators.tracks import (
    fragment_merge,
    gap_interpolate,
    gap_markers,
    line_envelope,
    monotone_reject,
    monotone_sweep,
    overlap_trim,
)
from cadenza.plans.ordered import by_rows, dense_index
from cadenza.plans.skew import grown, join_small
from cadenza.session import stage

TRACK = ["track_id"]


@dataclass
class Synced:
    captions: DataFrame
    words: DataFrame
    summary: DataFrame


def sheet_owners(lines: DataFrame, vocabulary: DataFrame) -> DataFrame:
    """Tokens of the sung lines in singing order, with the line and word each belongs to."""
    words = lines.filter(~F.col("instrumental")).select(
        "track_id", F.col("idx").alias("line_index"), F.posexplode(words_of(F.col("text"))).alias("pos", "raw")
    )
    words = stage(words, "sheet-words")
    parts = stage(normalize_tokens(words, vocabulary, False, ("part", "norm", "phonetic", "syllables")), "sheet-parts")
    # a line of text holds fewer words than a chunk, so 256 lines bound one
    return dense_index(parts, TRACK, ["line_index", "pos", "part"], by_rows("line_index", 256), "i")


def run_sync(
    lines: DataFrame,
    heard: DataFrame,
    segments: DataFrame,
    durations: DataFrame,
    vocabulary: DataFrame,
    anchors: DataFrame,
) -> Synced:
    """Time the lines of every track from its transcript.

    ``lines[track_id, idx, text, instrumental]``, ``heard[track_id, j, word, start_us,
    end_us]``, ``segments[track_id, k, start_us, end_us, no_speech_prob]``,
    ``durations[track_id, duration_us]``, ``vocabulary`` from ``token_dim``,
    ``anchors[track_id, line_index, offset_us, confidence, anchor_id]`` by parsed line.
    """
    plausible, dropped = transcript_sanitize(heard, segments, durations)
    owners = stage(sheet_owners(lines, vocabulary), "owners")
    plausible = stage(plausible.withColumnRenamed("word", "raw"), "plausible")
    spoken = stage(normalize_tokens(plausible, vocabulary, True), "spoken-forms")
    spoken = stage(
        dense_index(spoken.withColumnRenamed("j", "spoken"), TRACK, ["spoken"], by_rows("spoken"), "j"), "spoken-tokens"
    )
    path = align_chain(
        owners.select(F.col("track_id").alias("pair_id"), "i", "norm", "phonetic"),
        spoken.select(F.col("track_id").alias("pair_id"), "j", "norm", "phonetic"),
    )
    matches = match_times(
        path.filter("op = 'match'"),
        spoken.select(F.col("track_id").alias("pair_id"), "j", "start_us", "end_us"),
    ).withColumnRenamed("pair_id", "track_id")
    matches = stage(matches, "matches")
    accepted = monotone_reject(matches.select("track_id", "i", "start_us")).filter("accepted")
    timed = matches.join(grown(accepted.select("track_id", "i")), ["track_id", "i"], "left_semi")
    tokens = owners.select("track_id", "i", F.col("syllables").alias("weight")).join(
        grown(timed.select("track_id", "i", "start_us", "end_us", "confidence")), ["track_id", "i"], "left"
    )
    filled = stage(gap_interpolate(tokens.fillna(0.0, ["confidence"]), durations), "filled")
    swept = monotone_sweep(filled.select("track_id", "i", "start_us", "end_us"))
    words = stage(
        owners.join(grown(swept), ["track_id", "i"])
        .join(grown(filled.select("track_id", "i", "confidence", "matched")), ["track_id", "i"])
        .select(
            "track_id",
            "line_index",
            F.col("i").alias("k"),
            F.when(F.col("part") == 0, F.col("raw")).otherwise("").alias("text"),
            "start_us",
            "end_us",
            "confidence",
            "matched",
        ),
        "timed-tokens",
    )
    merged = stage(fragment_merge(words).withColumnRenamed("word_no", "k"), "merged-words")
    captions = _captions(lines, words, merged, durations)
    with_index = merged.join(
        grown(captions.filter(~F.col("instrumental")).select("track_id", "line_index", "idx")), ["track_id", "line_index"]
    ).select("track_id", "idx", "k", "text", "start_us", "end_us", "confidence")
    with_index = stage(with_index, "caption-words")

    widened = segment_interval_join(
        captions.select("track_id", "idx", "start_us", "end_us", "instrumental"), with_index, segments
    )
    ordinals = grown(captions.select("track_id", "idx", "ordinal"))
    located = anchor_remap(anchors, lines.select("track_id", "idx", "instrumental"))
    cap_times, word_times = anchor_warp(
        stage(widened.join(ordinals, ["track_id", "idx"]), "widened"), with_index, located, ordinal="ordinal"
    )
    scores = line_score(
        captions.select("track_id", F.col("ordinal").alias("line_index"), "instrumental", "confidence").filter(
            "line_index is not null"
        ),
        with_index.join(ordinals, ["track_id", "idx"]).select(
            "track_id", F.col("ordinal").alias("line_index"), "confidence"
        ),
        located,
    )
    final = (
        captions.drop("start_us", "end_us", "confidence")
        .join(grown(cap_times), ["track_id", "idx"])
        .join(
            grown(scores.select("track_id", F.col("line_index").alias("ordinal"), "score")), ["track_id", "ordinal"], "left"
        )
        .select(
            "track_id",
            "idx",
            "text",
            "start_us",
            "end_us",
            "instrumental",
            F.coalesce("score", F.lit(1.0)).alias("confidence"),
        )
    )
    timed_words = word_times.join(grown(with_index.drop("start_us", "end_us")), ["track_id", "idx", "k"])
    return Synced(final, timed_words, sync_summary(captions, dropped))


def _captions(lines: DataFrame, words: DataFrame, merged: DataFrame, durations: DataFrame) -> DataFrame:
    """Sung lines with window and confidence, overlaps trimmed, silences marked."""
    windows = line_envelope(merged, durations)
    sung = lines.filter(~F.col("instrumental")).select(
        "track_id", F.col("idx").alias("line_index"), "text"
    )
    confidence = line_confidence(sung.select("track_id", "line_index"), words)
    sung = (
        sung.join(grown(windows), ["track_id", "line_index"], "left")
        .join(grown(confidence), ["track_id", "line_index"])
    )
    sung = (
        join_small(sung, durations, TRACK, ["line_index"])
        .select(
            "track_id",
            F.col("line_index").alias("idx"),
            "line_index",
            "text",
            F.coalesce("start_us", F.lit(0)).alias("start_us"),
            F.coalesce("end_us", F.least(F.lit(seconds(1)), F.col("duration_us"))).alias("end_us"),
            "confidence",
            F.lit(False).alias("instrumental"),
        )
    )
    sung = stage(dense_index(stage(sung, "lines"), TRACK, ["idx"], by_rows("idx"), "ordinal"), "numbered-lines")
    return stage(gap_markers(overlap_trim(sung), carry=("line_index", "ordinal")), "captions")
