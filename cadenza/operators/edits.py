"""Batch edits: a table of edit requests joined to captions.

``captions[track_id, idx, start_us, end_us, ...]`` are numbered in time order (see
``caption_order``).  A batch holds at most one request per caption and kind.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from cadenza.functions.timecode import idiv, seconds
from cadenza.operators.tracks import proportional_layout
from cadenza.plans.ordered import by_rows, by_time, scan
from cadenza.plans.skew import join_small
from cadenza.session import stage

TRACK = ["track_id"]
CAPTION = ["track_id", "idx"]

# Shortest caption, least gap between captions, gap before a copy.
MIN_CAPTION_US = seconds(0.04)
MIN_GAP_US = seconds(0.02)
COPY_GAP_US = seconds(0.04)
FAR = 2**60


def _within(value: Column, low: Column, high: Column) -> Column:
    return F.greatest(low, F.least(high, value))


def edit_independent(captions: DataFrame, edits: DataFrame, durations: DataFrame) -> DataFrame:
    """Move one edge of a caption; neighbours stay.  ``edits[track_id, idx, edge, value_us]``."""
    both = join_small(captions.join(edits, CAPTION, "left"), durations, TRACK, ["idx"], "left")
    v, edge = F.col("value_us"), F.col("edge")
    start = F.when(edge == "in", _within(v, F.lit(0), F.col("end_us") - MIN_CAPTION_US))
    end = F.when(edge == "out", _within(v, F.col("start_us") + MIN_CAPTION_US, F.col("duration_us")))
    applied = F.coalesce(start, end)
    return both.select(
        *CAPTION,
        F.coalesce(start, "start_us").alias("start_us"),
        F.coalesce(end, "end_us").alias("end_us"),
        F.coalesce(applied != v, F.lit(False)).alias("clamped"),
    )


def edit_ripple(captions: DataFrame, edits: DataFrame, durations: DataFrame) -> DataFrame:
    """Resize or move captions and shift everything later by the same amount.

    ``edits[track_id, idx, kind, value_us]`` with kind ``out`` (new end) or ``move`` (new
    start).  Several edits of a track add up.  Shifts stop where the last caption would
    pass the end of the track; gaps between captions never change.
    """
    both = captions.select(*CAPTION, "start_us", "end_us").join(edits, CAPTION, "left")
    linked = scan(
        both,
        TRACK,
        ["idx"],
        by_rows("idx"),
        lag={"__prev_end": F.col("end_us")},
        total={"__last": ("max", F.col("end_us"))},
    )
    v, kind = F.col("value_us"), F.col("kind")
    shortest = F.col("start_us") + MIN_CAPTION_US
    earliest = F.least(F.col("start_us"), F.coalesce("__prev_end", F.lit(0)))
    delta = (
        F.when(kind == "out", F.greatest(v, shortest) - F.col("end_us"))
        .when(kind == "move", F.greatest(v, earliest) - F.col("start_us"))
        .otherwise(0)
    )
    wanted = F.when(kind == "out", v - F.col("end_us")).when(kind == "move", v - F.col("start_us")).otherwise(0)
    linked = stage(
        linked.withColumns({"__delta": delta, "__wanted": wanted}).drop("value_us"), "ripple"
    )
    summed = scan(linked, TRACK, ["idx"], by_rows("idx"), sum_before={"__before": F.col("__delta")})
    summed = join_small(summed, durations, TRACK, ["idx"])
    room = F.greatest(F.lit(0), F.col("duration_us") - F.col("__last"))
    before = F.least(F.col("__before"), room)
    upto = F.least(F.col("__before") + F.col("__delta"), room)
    return summed.select(
        *CAPTION,
        (F.col("start_us") + F.when(kind == "move", upto).otherwise(before)).alias("start_us"),
        (F.col("end_us") + upto).alias("end_us"),
        F.coalesce(kind.isNotNull() & (upto - before != F.col("__wanted")), F.lit(False)).alias("clamped"),
    )


def edit_roll(captions: DataFrame, edits: DataFrame) -> DataFrame:
    """Move the boundary between a caption and the next one; their total span stays.

    ``edits[track_id, idx, boundary_us]`` name the left caption.  A caption whose two
    boundaries both move gives each of them one half.
    """
    both = captions.select(*CAPTION, "start_us", "end_us").join(edits, CAPTION, "left")
    edited = F.col("boundary_us").isNotNull()
    mid = idiv(F.col("start_us") + F.col("end_us"), 2)
    linked = scan(
        both,
        TRACK,
        ["idx"],
        by_rows("idx"),
        lag={"__prev_edited": edited},
        lead={"__next": F.struct(F.col("end_us").alias("end"), mid.alias("mid"), edited.alias("edited"))},
    )
    low = F.when(F.col("__prev_edited"), mid + MIN_GAP_US).otherwise(F.col("start_us") + MIN_CAPTION_US)
    high = F.when(F.col("__next.edited"), F.col("__next.mid") - MIN_GAP_US).otherwise(
        F.col("__next.end") - MIN_CAPTION_US
    )
    boundary = F.when(edited & F.col("__next").isNotNull(), _within(F.col("boundary_us"), low, high))
    placed = stage(linked.select(*CAPTION, "start_us", "end_us", boundary.alias("__b")), "roll")
    rolled = scan(placed, TRACK, ["idx"], by_rows("idx"), lag={"__left": F.col("__b")})
    return rolled.select(
        *CAPTION,
        F.coalesce("__left", "start_us").alias("start_us"),
        F.coalesce("__b", "end_us").alias("end_us"),
    )


def edit_relink(captions: DataFrame, edits: DataFrame, durations: DataFrame) -> DataFrame:
    """Put captions at new starts, durations kept.  ``edits[track_id, idx, start_to_us]``."""
    both = join_small(captions.join(edits, CAPTION, "left"), durations, TRACK, ["idx"], "left")
    length = F.col("end_us") - F.col("start_us")
    latest = F.greatest(F.lit(0), F.col("duration_us") - length)
    start = F.coalesce(_within(F.col("start_to_us"), F.lit(0), latest), F.col("start_us"))
    start = F.when(F.col("start_to_us").isNull(), F.col("start_us")).otherwise(start)
    return both.select(*CAPTION, start.alias("start_us"), (start + length).alias("end_us"))


def edit_clamp(edits: DataFrame, captions: DataFrame) -> DataFrame:
    """Limit requested times by the neighbouring captions.

    ``edits[track_id, idx, kind, value_us]``, kind one of move, in, out, roll.
    """
    linked = scan(
        captions.select(*CAPTION, "start_us", "end_us"),
        TRACK,
        ["idx"],
        by_rows("idx"),
        lag={"__prev": F.col("end_us")},
        lead={"__next": F.col("start_us")},
    ).join(edits, CAPTION)
    s, e = F.col("start_us"), F.col("end_us")
    after = F.coalesce(F.col("__prev") + MIN_GAP_US, F.lit(0))

    def until(gap: Column) -> Column:
        return F.coalesce(F.col("__next") - gap, F.lit(FAR))

    gap = F.lit(MIN_GAP_US)
    kind = F.col("kind")
    low = F.when(kind.isin("move", "in"), after).otherwise(s + MIN_CAPTION_US)
    high = (
        F.when(kind == "move", until(gap + e - s))
        .when(kind == "in", e - MIN_CAPTION_US)
        .when(kind == "out", until(gap))
        .otherwise(until(F.lit(MIN_CAPTION_US)))
    )
    applied = F.greatest(F.lit(0), _within(F.col("value_us"), low, high))
    return linked.select(*CAPTION, "kind", "value_us", applied.alias("applied_us"))


def caption_split(captions: DataFrame, words: DataFrame, cuts: DataFrame) -> DataFrame:
    """Split captions at a time; words go to the side they start on.

    ``words[track_id, idx, k, text, start_us]``, ``cuts[track_id, idx, at_us]``.  A cut
    outside its caption changes nothing.  The text of a side is joined from its words,
    which one caption's text bounds.
    """
    inside = (F.col("at_us") > F.col("start_us")) & (F.col("at_us") < F.col("end_us"))
    cut = captions.join(cuts, CAPTION, "left").withColumn("at_us", F.when(inside, F.col("at_us")))
    whole = cut.filter(F.col("at_us").isNull()).select(
        *CAPTION, F.lit(0).alias("part"), "start_us", "end_us", "text"
    )
    halves = cut.filter(F.col("at_us").isNotNull()).select(
        *CAPTION,
        F.explode(
            F.array(
                F.struct(F.lit(0).alias("part"), F.col("start_us").alias("start_us"), F.col("at_us").alias("end_us")),
                F.struct(F.lit(1).alias("part"), F.col("at_us").alias("start_us"), F.col("end_us").alias("end_us")),
            )
        ).alias("h"),
        "at_us",
    ).select(*CAPTION, "h.*", "at_us")
    sides = words.select(*CAPTION, "k", F.col("text").alias("word"), F.col("start_us").alias("word_us"))
    mine = (F.col("word_us") >= F.col("at_us")).cast("int") == F.col("part")
    texts = (
        halves.join(sides, CAPTION, "left")
        .groupBy(*CAPTION, "part", "start_us", "end_us")
        .agg(F.array_sort(F.collect_list(F.when(mine, F.struct("k", "word")))).alias("w"))
        .select(
            *CAPTION, "part", "start_us", "end_us", F.array_join(F.transform("w", lambda x: x["word"]), " ").alias("text")
        )
    )
    return whole.unionByName(texts)


def caption_merge(captions: DataFrame, merges: DataFrame) -> DataFrame:
    """Merge chosen captions into one; the others pass through.

    ``merges[track_id, idx, merge_id]``.  The merged row takes the first index, the outer
    times, the joined text and the lowest confidence.
    """
    tagged = captions.join(merges, CAPTION, "left")
    alone = tagged.filter(F.col("merge_id").isNull()).select(
        *CAPTION, "start_us", "end_us", "text", "confidence"
    )
    texts = F.array_sort(F.collect_list(F.struct("idx", "text")))
    merged = (
        tagged.filter(F.col("merge_id").isNotNull())
        .groupBy("track_id", "merge_id")
        .agg(
            F.min("idx").alias("idx"),
            F.min("start_us").alias("start_us"),
            F.max("end_us").alias("end_us"),
            F.array_join(F.transform(texts, lambda x: x["text"]), " ").alias("text"),
            F.min("confidence").alias("confidence"),
        )
        .drop("merge_id")
    )
    return alone.unionByName(merged)


def caption_delete(captions: DataFrame, ids: DataFrame) -> DataFrame:
    """Remove captions and close up the numbering."""
    kept = captions.join(ids.select(*CAPTION), CAPTION, "left_anti")
    return scan(
        kept, TRACK, ["idx"], by_rows("idx"), sum_before={"position": F.lit(1).cast("bigint")}
    )


def caption_duplicate(captions: DataFrame, ids: DataFrame) -> DataFrame:
    """Copy captions to just behind themselves and number everything by time."""
    length = F.col("end_us") - F.col("start_us")
    copies = captions.join(ids.select(*CAPTION), CAPTION, "left_semi").select(
        *CAPTION,
        (F.col("end_us") + COPY_GAP_US).alias("start_us"),
        (F.col("end_us") + COPY_GAP_US + length).alias("end_us"),
        "text",
        F.lit(1).alias("copy"),
    )
    both = captions.select(*CAPTION, "start_us", "end_us", "text", F.lit(0).alias("copy")).unionByName(copies)
    return scan(
        both,
        TRACK,
        ["start_us", "idx", "copy"],
        by_time("start_us", seconds(600)),
        sum_before={"position": F.lit(1).cast("bigint")},
    )


def duplicate_words(words: DataFrame, captions: DataFrame, ids: DataFrame) -> DataFrame:
    """Words of the copies made by ``caption_duplicate``."""
    shift = captions.join(ids.select(*CAPTION), CAPTION, "left_semi").select(
        *CAPTION, (F.col("end_us") - F.col("start_us") + COPY_GAP_US).alias("__shift")
    )
    return words.join(shift, CAPTION).select(
        *CAPTION,
        "k",
        (F.col("start_us") + F.col("__shift")).alias("start_us"),
        (F.col("end_us") + F.col("__shift")).alias("end_us"),
    )


def nudge_frames(captions: DataFrame, nudges: DataFrame, durations: DataFrame, fps: int) -> DataFrame:
    """Move captions by whole frames, rippling the tail.  ``nudges[track_id, idx, frames]``."""
    delta = F.floor(F.col("frames") * 1_000_000 / F.lit(fps) + 0.5).cast("bigint")
    edits = captions.select(*CAPTION, "start_us").join(nudges, CAPTION).select(
        *CAPTION, F.lit("move").alias("kind"), (F.col("start_us") + delta).alias("value_us")
    )
    return edit_ripple(captions, edits, durations)


def relyric(captions: DataFrame, lines: DataFrame, durations: DataFrame) -> DataFrame:
    """Put a new sheet on the timing of a track.

    ``lines[track_id, idx, text, instrumental]``.  With as many sung lines as before, each
    keeps its window and gets the new text; otherwise the sheet is laid out anew over the
    track, or over 3.6 s per line where the track length is unknown.
    """
    sung_lines = lines.filter(~F.col("instrumental"))
    sung_caps = captions.filter(~F.col("instrumental"))
    old = sung_caps.groupBy("track_id").agg(F.count(F.lit(1)).alias("old"))
    new = sung_lines.groupBy("track_id").agg(F.count(F.lit(1)).alias("new"))
    plan = new.join(old, TRACK, "left").join(durations, TRACK, "left")
    guess = F.greatest(F.lit(seconds(30)), F.col("new") * seconds(3.6))
    plan = stage(
        plan.select(
            "track_id",
            F.coalesce(F.col("old") == F.col("new"), F.lit(False)).alias("same"),
            F.when(F.col("duration_us") > 0, F.col("duration_us")).otherwise(guess).alias("duration_us"),
        ),
        "relyric-plan",
    )
    same, other = plan.filter("same"), plan.filter("not same")
    one = F.lit(1).cast("bigint")
    ordered = scan(
        join_small(sung_lines, same.select("track_id"), TRACK, ["idx"], "left_semi").select(*CAPTION, "text"),
        TRACK, ["idx"], by_rows("idx"), sum_before={"order": one},
    ).drop("idx")
    kept = scan(
        join_small(sung_caps, same.select("track_id"), TRACK, ["idx"], "left_semi").select(*CAPTION, "start_us", "end_us"),
        TRACK, ["idx"], by_rows("idx"), sum_before={"order": one},
    ).drop("idx")
    retexted = ordered.join(kept, ["track_id", "order"]).select(
        "track_id", "order", "text", "start_us", "end_us", F.lit(True).alias("kept_window")
    )
    laid = proportional_layout(
        join_small(lines, other.select("track_id"), TRACK, ["idx"], "left_semi"), other.select("track_id", "duration_us")
    ).select("track_id", "order", "text", "start_us", "end_us", F.lit(False).alias("kept_window"))
    return retexted.unionByName(laid)
