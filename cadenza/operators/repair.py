"""Validation and repair of suggested alignments and transcripts."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from cadenza.functions.timecode import clamp, idiv, seconds
from cadenza.plans.ordered import by_rows, scan
from cadenza.plans.ranges import points_in_intervals
from cadenza.plans.skew import grown, join_small
from cadenza.session import stage

TRACK = ["track_id"]
CAPTION = ["track_id", "idx"]

# Fixed values of the checks.
EARLY_US, LATE_US = seconds(0.5), seconds(0.75)
MIN_SPAN_US, MAX_SPAN_US, BACKSTEP_US = seconds(0.5), seconds(15), seconds(0.25)
DEFAULT_CONFIDENCE, MAX_SUGGESTED = 0.6, 0.92
MARGIN, WEAK = 0.05, 0.65
MIN_CAPTION_US, GAP_US, MIN_TRIMMED_US = seconds(0.7), seconds(0.04), seconds(0.5)
MIN_WORD_US = seconds(0.08)
NO_SPEECH, REPEAT_US = 0.6, seconds(0.05)


def suggestion_validate(rows: DataFrame, durations: DataFrame) -> DataFrame:
    """Keep the suggestions of tracks where every row passes, clamped to the track.

    ``rows[track_id, row_id, line_index, start_us, end_us, confidence]`` with the values as
    text.  One bad row rejects its track: not a number, outside the track, a span out of
    bounds, a repeated line, or a start well before the line before it.
    """
    typed = join_small(rows, durations, TRACK, ["row_id"]).select(
        "track_id",
        "row_id",
        F.expr("try_cast(line_index as bigint)").alias("line_index"),
        F.expr("try_cast(start_us as bigint)").alias("start_us"),
        F.expr("try_cast(end_us as bigint)").alias("end_us"),
        F.when(F.col("confidence").isNull(), DEFAULT_CONFIDENCE)
        .otherwise(F.expr("try_cast(confidence as double)"))
        .alias("confidence"),
        "duration_us",
    )
    # one row per line: repeated or unreadable lines only count, whatever their number
    values = F.struct("start_us", "end_us", "confidence", "duration_us")
    lines = typed.groupBy("track_id", F.coalesce("line_index", F.lit(-1).cast("bigint")).alias("line_index")).agg(
        F.count(F.lit(1)).alias("__copies"), F.min_by(values, "row_id").alias("__v")
    ).select("track_id", "line_index", "__copies", "__v.*")
    linked = scan(
        lines,
        TRACK,
        ["line_index"],
        by_rows("line_index"),
        lag={"__prev": F.struct("line_index", "start_us")},
    )
    span = F.col("end_us") - F.col("start_us")
    sound = (
        (F.col("line_index") >= 0)
        & (F.col("__copies") == 1)
        & F.col("confidence").isNotNull()
        & (F.col("start_us") >= -EARLY_US)
        & (F.col("end_us") <= F.col("duration_us") + LATE_US)
        & (span >= MIN_SPAN_US)
        & (span <= MAX_SPAN_US)
    )
    first = F.col("__prev").isNull()
    in_order = first | (
        F.greatest(F.lit(0), F.col("start_us")) >= F.greatest(F.lit(0), F.col("__prev.start_us")) - BACKSTEP_US
    )
    judged = stage(linked.withColumn("__ok", F.coalesce(sound & in_order, F.lit(False))), "suggestions")
    good = judged.groupBy("track_id").agg(F.bool_and("__ok").alias("ok")).filter("ok").select("track_id")
    return join_small(judged, good, TRACK, ["line_index"], "left_semi").select(
        "track_id",
        "line_index",
        F.greatest(F.lit(0), F.col("start_us")).alias("start_us"),
        F.least("end_us", "duration_us").alias("end_us"),
        clamp(F.col("confidence"), 0.0, 1.0).alias("confidence"),
    )


def index_monotone_check(rows: DataFrame) -> DataFrame:
    """A mapping is accepted only if its sheet index strictly increases in array order.

    ``rows[track_id, pos, line_index]`` -> ``[track_id, accepted]``.
    """
    linked = scan(rows, TRACK, ["pos"], by_rows("pos"), lag={"__prev": F.col("line_index")})
    rises = F.col("line_index") > F.coalesce("__prev", F.lit(-1))
    return linked.groupBy("track_id").agg(F.bool_and(rises).alias("accepted"))


def suggestion_merge(captions: DataFrame, rows: DataFrame, durations: DataFrame) -> DataFrame:
    """Take over suggested windows that are about as sure as the caption, or where it is weak.

    ``captions[track_id, idx, start_us, end_us, confidence]`` by vocal ordinal,
    ``rows[track_id, line_index, start_us, end_us, confidence]``.
    """
    s = rows.select(
        "track_id",
        F.col("line_index").alias("idx"),
        F.col("start_us").alias("s_start"),
        F.col("end_us").alias("s_end"),
        F.col("confidence").alias("s_conf"),
    )
    both = join_small(captions.join(s, CAPTION, "left"), durations, TRACK, ["idx"], "left")
    better = F.coalesce(
        (F.col("s_conf") >= F.col("confidence") - MARGIN) | (F.col("s_conf").isNotNull() & (F.col("confidence") < WEAK)),
        F.lit(False),
    )
    start = F.greatest(F.lit(0), F.least("s_start", F.col("duration_us") - MIN_CAPTION_US))
    end = F.least(F.col("duration_us"), F.greatest(start + MIN_CAPTION_US, F.col("s_end")))
    return both.select(
        *CAPTION,
        F.when(better, start).otherwise(F.col("start_us")).alias("start_us"),
        F.when(better, end).otherwise(F.col("end_us")).alias("end_us"),
        F.when(better, F.greatest("confidence", F.least(F.lit(MAX_SUGGESTED), F.col("s_conf"))))
        .otherwise(F.col("confidence"))
        .alias("confidence"),
        better.alias("repaired"),
    )


def repair_monotone(captions: DataFrame) -> DataFrame:
    """Push starts forward to song order and trim ends that run into the next caption.

    A start only ever depends on the starts before it, so it is their running maximum.
    ``trimmed`` marks captions whose words may need ``repair_words``.
    """
    pushed = scan(
        captions, TRACK, ["idx"], by_rows("idx"), max_before={"__top": F.col("start_us")}
    )
    start = F.greatest("start_us", F.coalesce("__top", "start_us"))
    end = F.when(
        F.col("__top") > F.col("start_us"), F.greatest(F.col("__top") + MIN_CAPTION_US, F.col("end_us"))
    ).otherwise(F.col("end_us"))
    pushed = stage(
        pushed.withColumns({"__start": start, "__end": end}).drop("__top", "start_us", "end_us"), "pushed"
    )
    linked = scan(pushed, TRACK, ["idx"], by_rows("idx"), lead={"__next": F.col("__start")})
    limit = F.col("__next") - GAP_US
    trimmed = F.coalesce(F.col("__end") > limit, F.lit(False))
    end = F.when(trimmed, F.greatest(F.col("__start") + MIN_TRIMMED_US, limit)).otherwise(F.col("__end"))
    return linked.select(
        *CAPTION, F.col("__start").alias("start_us"), end.alias("end_us"), trimmed.alias("trimmed")
    )


def repair_words(words: DataFrame, repaired: DataFrame) -> DataFrame:
    """Squeeze the words of trimmed captions into what is left of their window.

    ``words[track_id, idx, k, start_us, end_us]``; windows span one caption's words.
    """
    caps = repaired.select(*CAPTION, F.col("end_us").alias("__end"), "trimmed")
    whole = Window.partitionBy(*CAPTION)
    w = whole.orderBy("k")
    s, e = F.col("start_us"), F.col("end_us")
    known = words.join(caps, CAPTION).withColumns(
        {
            "__first": F.first("start_us").over(w),
            "__last": F.max_by("end_us", "k").over(whole),
            "__row": F.row_number().over(w),
        }
    )
    squeeze = F.col("trimmed") & (F.col("__last") > F.col("__end"))
    room = F.col("__end") - F.col("__first")
    used = F.greatest(F.lit(seconds(0.01)), F.col("__last") - F.col("__first"))
    # the scale is kept between a tenth and one
    scaled = F.when(room >= used, e - s).when(room * 10 <= used, idiv(e - s, 10)).otherwise(
        F.call_function("div", (e - s) * room, used)
    )
    known = known.withColumn("__need", F.greatest(F.lit(MIN_WORD_US), scaled))
    before = F.coalesce(F.sum("__need").over(w.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    at = F.when(F.col("__row") == 1, F.col("__first")).otherwise(F.least(F.col("__end"), F.col("__first") + before))
    known = known.withColumn("__at", at)
    return known.select(
        *CAPTION,
        "k",
        F.when(squeeze, F.col("__at")).otherwise(s).alias("start_us"),
        F.when(squeeze, F.least(F.col("__end"), F.col("__at") + F.col("__need"))).otherwise(e).alias("end_us"),
    )


def transcript_sanitize(
    words: DataFrame, segments: DataFrame, durations: DataFrame
) -> tuple[DataFrame, DataFrame]:
    """Drop implausible transcript words; also count the dropped ones per track.

    Dropped are: empty words, words without length or outside the track, words centred in
    a segment that is probably not speech, and repeats of the word just before (same text,
    starting within 50 ms).  ``words[track_id, j, word, start_us, end_us]``,
    ``segments[track_id, k, start_us, end_us, no_speech_prob]``.
    """
    mid = idiv(F.col("start_us") + F.col("end_us"), 2)
    quiet = segments.filter(F.col("no_speech_prob") > NO_SPEECH).select(
        "track_id", F.col("start_us").alias("__lo"), F.col("end_us").alias("__hi")
    )
    plausible = join_small(words, durations, TRACK, ["j"]).filter(
        (F.trim("word") != "")
        & (F.col("end_us") > F.col("start_us"))
        & (F.col("start_us") >= 0)
        & (F.col("end_us") <= F.col("duration_us"))
    ).select(*words.columns)
    muted = points_in_intervals(
        plausible.select("track_id", "j", mid.alias("__mid")), "__mid", quiet, "__lo", "__hi", TRACK, seconds(30)
    ).select("track_id", "j").distinct()
    spoken = stage(plausible.join(grown(muted), ["track_id", "j"], "left_anti"), "spoken")
    linked = scan(
        spoken, TRACK, ["j"], by_rows("j"), lag={"__prev": F.struct(F.lower("word").alias("w"), "start_us")}
    )
    repeat = (F.lower("word") == F.col("__prev.w")) & (F.col("start_us") - F.col("__prev.start_us") <= REPEAT_US)
    kept = linked.filter(~F.coalesce(repeat, F.lit(False))).select(*words.columns)
    counts = words.groupBy("track_id").agg(F.count(F.lit(1)).alias("heard"))
    left = kept.groupBy("track_id").agg(F.count(F.lit(1)).alias("left"))
    dropped = counts.join(left, TRACK, "left").select(
        "track_id", (F.col("heard") - F.coalesce("left", F.lit(0))).alias("dropped")
    )
    return kept, dropped
