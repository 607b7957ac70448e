"""Ordered-track operators: timing rules that look along one track.

All times are BIGINT microseconds.  ``track_id`` keys a track; ``idx`` (captions), ``i``
(tokens) or ``line_index``/``k`` (words in lines) give its order.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from cadenza.functions.text import first_part, let, sung_words, syllables, words_of
from cadenza.functions.timecode import idiv, seconds
from cadenza.plans.folds import chunked_fold
from cadenza.plans.maps import ChunkMaps, map_base, maps_joined, sweep_maps
from cadenza.plans.ordered import by_rows, by_time, scan
from cadenza.plans.skew import join_small
from cadenza.session import stage

# Fixed values of the timing rules.
MIN_WORD_US = seconds(0.08)
MAX_FILLED_WORD_US = seconds(1.25)
MIN_CAPTION_US = seconds(0.7)
LEAD_IN_US, TAIL_OUT_US = seconds(0.06), seconds(0.12)
TRIM_GAP_US, TRIM_FLOOR_US = seconds(0.04), seconds(0.3)
SILENCE_US = seconds(3.5)
BACKSTEP_US = seconds(0.02)
PER_WEIGHT_US = seconds(0.28)
MARK = "♪"

CHUNK_US = seconds(600)
TRACK = ["track_id"]


def monotone_reject(matches: DataFrame, backstep_us: int = BACKSTEP_US) -> DataFrame:
    """Un-match words that start more than ``backstep_us`` before the last accepted one.

    ``matches[track_id, i, start_us]`` -> the same rows with ``accepted``.
    """
    lowest = F.struct(F.lit(-(2**62)).cast("bigint").alias("at"))

    def step(state: Column, row: Column) -> Column:
        kept = row["start_us"] >= state["at"] - backstep_us
        return F.struct(F.when(kept, row["start_us"]).otherwise(state["at"]).alias("at"))

    def emit(before: Column, row: Column, after: Column) -> Column:
        return F.struct(
            row["i"].alias("i"),
            row["start_us"].alias("start_us"),
            (row["start_us"] >= before["at"] - backstep_us).alias("accepted"),
        )

    # a chunk takes in every state that does not bar its highest start, and then always ends
    # the same; any other state passes unchanged
    def build(packed: DataFrame, keys: list[str]) -> DataFrame:
        end = F.aggregate("__items", lowest, step)["at"]
        return packed.withColumn("__map", F.struct(F.array_max("__items.start_us").alias("top"), end.alias("end")))

    def then(first: Column, second: Column) -> Column:
        end = F.when(first["end"] <= second["top"] + backstep_us, second["end"]).otherwise(first["end"])
        return F.struct(F.greatest(first["top"], second["top"]).alias("top"), end.alias("end"))

    maps = ChunkMaps(build, then, lambda m, row: F.struct(m["end"].alias("at")))
    return chunked_fold(matches, TRACK, "i", ["start_us"], lowest, step, emit, maps=maps)


def gap_interpolate(tokens: DataFrame, durations: DataFrame) -> DataFrame:
    """Give each run of unmatched tokens times between its matched neighbours.

    ``tokens[track_id, i, weight, start_us, end_us, confidence]``, times null where
    unmatched; every other column is kept.
    """
    open_ = F.col("start_us").isNull()
    marked = scan(
        join_small(tokens, durations, TRACK, ["i"]),
        TRACK,
        ["i"],
        by_rows("i"),
        sum_before={
            "__run": F.when(open_, 0).otherwise(1).cast("bigint"),
            "__weight_before": F.when(open_, F.col("weight")).otherwise(0).cast("bigint"),
        },
        last_before={"__left": F.col("end_us")},
        first_after={"__right": F.col("start_us")},
    )
    marked = stage(marked, "gap-runs")
    runs = (
        marked.filter(open_)
        .groupBy("track_id", "__run")
        .agg(
            F.min("__weight_before").alias("__base"),
            F.sum("weight").alias("__total"),
            F.count(F.lit(1)).alias("__n"),
        )
    )
    # a track without any transcript is one single run
    rows = join_small(marked.filter(open_), runs, ["track_id", "__run"], ["i"])
    left = F.coalesce("__left", F.lit(0))
    available = F.greatest(F.lit(seconds(0.2)), F.coalesce("__right", "duration_us") - left)
    natural = F.col("__total") * PER_WEIGHT_US
    floor = F.col("__n") * MIN_WORD_US
    room = available - seconds(0.1)
    fitted = F.least(room, F.greatest(natural, floor))
    fitted = F.when(fitted < natural, F.greatest(floor, room)).otherwise(fitted)
    loose = available * 10 > natural * 22
    begin = F.when(loose, left + idiv((available - natural) * 35, 100)).otherwise(left + seconds(0.08))
    span = F.greatest(F.when(loose, natural).otherwise(fitted), floor, F.lit(seconds(0.04)))
    offset = F.col("__weight_before") - F.col("__base")
    filled = (
        rows.withColumns({"__begin": begin, "__span": span, "__off": offset})
        .withColumn("start_us", F.col("__begin") + idiv(F.col("__span") * F.col("__off"), F.col("__total")))
        .withColumn(
            "__stop",
            F.col("__begin") + idiv(F.col("__span") * (F.col("__off") + F.col("weight")), F.col("__total")),
        )
        .withColumn(
            "end_us",
            F.greatest(
                F.col("start_us") + MIN_WORD_US,
                F.least("__stop", F.col("start_us") + MAX_FILLED_WORD_US),
            ),
        )
        .withColumn("confidence", F.lit(0.28))
    )
    kept = marked.filter(~open_)
    return (
        kept.select(*tokens.columns, F.lit(True).alias("matched"))
        .unionByName(filled.select(*tokens.columns, F.lit(False).alias("matched")))
    )


def monotone_sweep(tokens: DataFrame) -> DataFrame:
    """Split overlaps at the midpoint, keep 80 ms per word and 20 ms between starts.

    ``tokens[track_id, i, start_us, end_us]``; a later word sees the earlier ones as
    already changed, hence a fold.  A word's end may still be cut by the word after it.
    """
    nothing = F.lit(None).cast("bigint")
    fresh = F.struct(nothing.alias("start_us"), nothing.alias("end_us"))

    def step(prev: Column, row: Column) -> Column:
        inside = row["start_us"] < prev["end_us"]
        start = F.when(inside, F.shiftright(prev["end_us"] + row["start_us"], 1)).otherwise(row["start_us"])
        end = F.greatest(row["end_us"], start + MIN_WORD_US)
        earliest = prev["start_us"] + BACKSTEP_US
        late = F.greatest(start, F.coalesce(earliest, start))
        return F.struct(
            late.alias("start_us"),
            F.when(late > start, F.greatest(end, late + MIN_WORD_US)).otherwise(end).alias("end_us"),
        )

    def emit(before: Column, row: Column, after: Column) -> Column:
        return F.struct(
            row["i"].alias("i"),
            row["start_us"].alias("__raw"),
            after["start_us"].alias("start_us"),
            after["end_us"].alias("end_us"),
        )

    # behind a word its end follows from its own start and raw end, so the state is its start
    def build(packed: DataFrame, keys: list[str]) -> DataFrame:
        highest = F.array_max(F.transform("__items", lambda w: F.greatest(w["start_us"], w["end_us"])))
        bound = packed.groupBy(*keys).agg(
            (F.max(highest) + F.sum(F.size("__items")) * (MIN_WORD_US + BACKSTEP_US)).alias("__bound")
        )
        ends = scan(
            packed.select(*keys, "__part", F.element_at("__items", -1)["end_us"].alias("__end")),
            keys, ["__part"], by_rows("__part"), lag={"__end_before": F.col("__end")},
        )
        known = packed.join(ends.drop("__end"), [*keys, "__part"]).join(bound, keys)
        fixed = [F.lit(MIN_WORD_US), F.lit(BACKSTEP_US)]
        return known.withColumn("__map", sweep_maps("__items.start_us", "__items.end_us", "__end_before", "__bound", *fixed))

    def leave(m: Column, row: Column) -> Column:
        start = map_base(m)
        return F.struct(start.alias("start_us"), F.greatest(row["end_us"], start + MIN_WORD_US).alias("end_us"))

    maps = ChunkMaps(build, maps_joined, leave)
    swept = chunked_fold(tokens, TRACK, "i", ["start_us", "end_us"], fresh, step, emit, maps=maps)
    linked = scan(stage(swept, "sweep"), TRACK, ["i"], by_rows("i"), lead={"__next": F.col("__raw")})
    cut = F.when(
        F.col("__next") < F.col("end_us"), idiv(F.col("end_us") + F.col("__next"), 2)
    ).otherwise(F.col("end_us"))
    return linked.select("track_id", "i", "start_us", cut.alias("end_us"))


def fragment_merge(words: DataFrame) -> DataFrame:
    """Glue the parts of a contraction (text '') to the word before them in the line.

    ``words[track_id, line_index, k, text, start_us, end_us, confidence]``.  A line is the
    text of one caption, so its window is bounded by one row of the caption table.
    """
    w = Window.partitionBy("track_id", "line_index").orderBy("k")
    numbered = words.withColumn("word_no", F.sum((F.col("text") != "").cast("bigint")).over(w))
    return numbered.groupBy("track_id", "line_index", "word_no").agg(
        F.min_by("text", "k").alias("text"),
        F.min_by("start_us", "k").alias("start_us"),
        F.max_by("end_us", "k").alias("end_us"),
        F.min_by("confidence", "k").alias("confidence"),
    )


def line_envelope(words: DataFrame, durations: DataFrame) -> DataFrame:
    """Caption window of a line from its first and last word."""
    at = F.struct("start_us", "k")
    lines = words.groupBy("track_id", "line_index").agg(
        F.min("start_us").alias("__first"), F.max_by("end_us", at).alias("__last")
    )
    start = F.greatest(F.lit(0), F.col("__first") - LEAD_IN_US)
    end = F.greatest(F.col("__last") + TAIL_OUT_US, F.col("start_us") + MIN_CAPTION_US)
    return (
        join_small(lines, durations, TRACK, ["line_index"])
        .withColumn("start_us", start)
        .select(
            "track_id", "line_index", "start_us", F.least(end, F.col("duration_us")).alias("end_us")
        )
    )


def overlap_trim(captions: DataFrame, width_us: int = CHUNK_US) -> DataFrame:
    """End a caption 40 ms before the next one, yet not before 0.3 s of its own."""
    out = scan(
        captions,
        TRACK,
        ["start_us", "idx"],
        by_time("start_us", width_us),
        lead={"__next": F.col("start_us")},
    )
    limit = F.col("__next") - TRIM_GAP_US
    end = F.when(
        F.col("end_us") > limit, F.greatest(F.col("start_us") + TRIM_FLOOR_US, limit)
    ).otherwise(F.col("end_us"))
    return out.withColumn("end_us", end).drop("__next")


def gap_markers(
    captions: DataFrame,
    min_gap_us: int = SILENCE_US,
    intro: bool = False,
    width_us: int = CHUNK_US,
    carry: tuple[str, ...] = (),
) -> DataFrame:
    """Insert a music row wherever nothing is sung for longer than ``min_gap_us``.

    Captions must not overlap (see ``overlap_trim``).  ``intro`` also marks a late start.
    Rows come back renumbered by time, with the columns named in ``carry`` (null in marks).
    """
    linked = scan(
        captions,
        TRACK,
        ["start_us", "idx"],
        by_time("start_us", width_us),
        lag={"__prev_end": F.col("end_us")},
    )
    opening = F.lit(0) if intro else F.lit(None)
    linked = linked.withColumn("__prev_end", F.coalesce("__prev_end", opening.cast("bigint")))
    gap = F.coalesce(F.col("start_us") - F.col("__prev_end") > min_gap_us, F.lit(False))
    linked = stage(linked.withColumn("__gap", gap), "gap-links")
    numbered = scan(
        linked,
        TRACK,
        ["start_us", "idx"],
        by_time("start_us", width_us),
        sum_upto={"__upto": F.when(F.col("__gap"), 2).otherwise(1).cast("bigint")},
    )
    row = F.struct(
        (F.col("__upto") - 1).alias("idx"),
        "start_us",
        "end_us",
        "text",
        "instrumental",
        "confidence",
        *carry,
    )
    mark = F.struct(
        (F.col("__upto") - 2).alias("idx"),
        F.col("__prev_end").alias("start_us"),
        F.col("start_us").alias("end_us"),
        F.lit(MARK).alias("text"),
        F.lit(True).alias("instrumental"),
        F.lit(1.0).alias("confidence"),
        *[F.lit(None).cast(captions.schema[c].dataType).alias(c) for c in carry],
    )
    rows = F.when(F.col("__gap"), F.array(mark, row)).otherwise(F.array(row))
    return numbered.select("track_id", F.explode(rows).alias("r")).select("track_id", "r.*")


def even_words(lines: DataFrame, words: Column, confidence: Column) -> DataFrame:
    """Equally wide words inside each caption window."""
    n = F.greatest(F.lit(1), F.size("__words"))
    span = F.greatest(F.lit(seconds(0.04)), F.col("end_us") - F.col("start_us"))
    return (
        lines.withColumn("__words", words)
        .withColumns({"__n": n.cast("bigint"), "__span": span, "__conf": confidence})
        .select("track_id", "idx", "start_us", "__n", "__span", "__conf", F.posexplode("__words"))
        .select(
            "track_id",
            "idx",
            F.col("pos").cast("bigint").alias("k"),
            F.col("col").alias("text"),
            (F.col("start_us") + idiv(F.col("__span") * F.col("pos"), F.col("__n"))).alias("start_us"),
            (F.col("start_us") + idiv(F.col("__span") * (F.col("pos") + 1), F.col("__n"))).alias("end_us"),
            F.col("__conf").alias("confidence"),
        )
    )


def caption_words_even(captions: DataFrame) -> DataFrame:
    """Re-time the words of edited captions evenly across their windows."""
    return even_words(captions, sung_words(F.col("text")), F.lit(0.8))


def proportional_layout(lines: DataFrame, durations: DataFrame) -> DataFrame:
    """Spread sung lines over a track by syllable weight, without any transcript.

    ``lines[track_id, idx, text, instrumental]`` -> one row per sung line with its window.
    """
    sung = lines.filter(~F.col("instrumental")).withColumn(
        "__w", syllables(F.regexp_replace("text", "\\s", ""))
    )
    placed = scan(
        sung,
        TRACK,
        ["idx"],
        by_rows("idx"),
        sum_before={"__before": F.col("__w"), "order": F.lit(1).cast("bigint")},
        total={"__total": ("sum", F.col("__w"))},
    )
    placed = join_small(placed, durations, TRACK, ["order"])
    dur = F.col("duration_us")
    lead = F.least(F.lit(seconds(2.4)), idiv(dur * 6, 100))
    tail = F.least(F.lit(seconds(2.8)), idiv(dur * 8, 100))
    usable = F.greatest(F.lit(seconds(1)), dur - lead - tail)
    return (
        placed.withColumns({"__lead": lead, "__usable": usable})
        .withColumn("start_us", F.col("__lead") + idiv(F.col("__usable") * F.col("__before"), F.col("__total")))
        .withColumn(
            "end_us",
            F.col("start_us")
            + F.greatest(
                idiv(F.col("__usable") * F.col("__w") * 82, F.col("__total") * 100),
                F.lit(MIN_CAPTION_US),
            ),
        )
        .select("track_id", "order", "text", "start_us", "end_us", F.lit(0.4).alias("confidence"))
    )


def proportional_words(layout: DataFrame) -> DataFrame:
    """Words of a proportional layout, at least 80 ms each."""
    wspan = F.greatest(F.lit(MIN_WORD_US), idiv(F.col("end_us") - F.col("start_us"), F.col("__n")))
    return (
        layout.withColumn("__words", sung_words(F.col("text")))
        .withColumn("__n", F.greatest(F.lit(1), F.size("__words")).cast("bigint"))
        .withColumn("__wspan", wspan)
        .select("track_id", "order", "start_us", "__wspan", F.posexplode("__words"))
        .select(
            "track_id",
            "order",
            F.col("pos").cast("bigint").alias("k"),
            F.col("col").alias("text"),
            (F.col("start_us") + F.col("__wspan") * F.col("pos")).alias("start_us"),
            (F.col("start_us") + F.col("__wspan") * (F.col("pos") + 1)).alias("end_us"),
        )
    )


def prompt_window(lines: DataFrame, start_index: int = 0, budget: int = 220) -> DataFrame:
    """Join lines from ``start_index`` on while their word count stays within the budget.

    ``lines[doc_id, idx, text]``.  Every line counts at least one word, so the text
    collected per document is bounded by the budget.
    """
    counted = lines.filter(F.col("idx") >= start_index).withColumn(
        "__n", F.size(F.filter(F.split("text", "\\s+"), lambda w: w != "")).cast("bigint")
    )
    running = scan(
        counted, ["doc_id"], ["idx"], by_rows("idx"), sum_upto={"__used": F.col("__n")}
    ).filter(F.col("__used") <= budget)
    joined = F.array_join(
        F.transform(F.array_sort(F.collect_list(F.struct("idx", "text"))), lambda x: x["text"]), " "
    )
    return running.groupBy("doc_id").agg(
        joined.alias("prompt"), F.max("__used").alias("tokens"), F.count(F.lit(1)).alias("lines")
    )


def words_rescale(words: DataFrame, old: DataFrame, new: DataFrame) -> DataFrame:
    """Map words linearly from the old caption windows into the new ones.

    ``old``/``new``: ``[track_id, idx, start_us, end_us]``.
    """
    envelopes = old.select(
        "track_id", "idx", F.col("start_us").alias("__os"), F.col("end_us").alias("__oe")
    ).join(
        new.select("track_id", "idx", F.col("start_us").alias("__ns"), F.col("end_us").alias("__ne")),
        ["track_id", "idx"],
    )
    span = F.greatest(F.lit(100), F.col("__oe") - F.col("__os"))

    def moved(c: str) -> Column:
        return F.col("__ns") + idiv((F.col(c) - F.col("__os")) * (F.col("__ne") - F.col("__ns")), span)

    return words.join(envelopes, ["track_id", "idx"]).select(
        "track_id", "idx", "k", moved("start_us").alias("start_us"), moved("end_us").alias("end_us")
    )


def word_retime(words: DataFrame, edits: DataFrame) -> DataFrame:
    """Set single words to requested times, kept inside their caption and 50 ms long.

    ``words[track_id, idx, k, cap_start_us, cap_end_us, ...]``,
    ``edits[track_id, idx, k, new_start_us, new_end_us]``.
    """
    start = F.greatest("cap_start_us", "new_start_us")
    end = F.least(F.col("cap_end_us"), F.greatest(F.col("__s") + seconds(0.05), F.col("new_end_us")))
    edited = F.col("new_start_us").isNotNull()
    return (
        words.join(edits, ["track_id", "idx", "k"], "left")
        .withColumn("__s", start)
        .select(
            "track_id",
            "idx",
            "k",
            F.when(edited, F.col("__s")).otherwise(F.col("start_us")).alias("start_us"),
            F.when(edited, end).otherwise(F.col("end_us")).alias("end_us"),
        )
    )


def caption_order(captions: DataFrame, width_us: int = CHUNK_US) -> DataFrame:
    """Renumber captions by start time."""
    return scan(
        captions,
        TRACK,
        ["start_us", "idx"],
        by_time("start_us", width_us),
        sum_before={"position": F.lit(1).cast("bigint")},
    )


def line_distribute(lines: DataFrame, matches: DataFrame, window: tuple[str, ...] = ()) -> DataFrame:
    """Place the words of each line inside its window.

    ``lines[track_id, idx, text, start_us, end_us]``; ``matches[track_id, idx, k,
    heard_start_us, heard_end_us]`` holds the transcript time of matched words.  A heard
    time within 0.2 s of the window is used (confidence 0.85); other words get a share of
    the window by weight, from a cursor behind the word before (0.45).  Then overlaps are
    split and short words stretched.  The array folded is one caption's words, which stay in
    its row: only matches are grouped by caption.  Of several matches of a word the earliest counts.
    ``window`` names two columns for the line's own start and end, if they are wanted.
    """
    weight = lambda w: F.greatest(
        F.lit(100),
        syllables(w) * 120 + F.least(F.lit(300), F.length(w) * 15),
    ).cast("bigint")
    heard_times = F.struct("k", F.col("heard_start_us").alias("hs"), F.col("heard_end_us").alias("he"))
    heard = matches.filter("k >= 0").groupBy("track_id", "idx").agg(F.sort_array(F.collect_list(heard_times)).alias("__all"))
    first_of_k = lambda m, i: (i == 0) | (F.get("__all", i - 1)["k"] != m["k"])
    heard = heard.select("track_id", "idx", F.filter("__all", first_of_k).alias("__heard"))
    weighed = F.transform(
        sung_first(F.col("text")),
        lambda w, k: F.struct(
            k.cast("bigint").alias("k"), w["raw"].alias("text"), weight(w["norm"]).alias("weight")
        ),
    )
    packed = (
        lines.select("track_id", "idx", "start_us", "end_us", weighed.alias("__items"))
        .join(heard, ["track_id", "idx"], "left")
        .withColumn("__total", F.aggregate("__items.weight", F.lit(0).cast("bigint"), lambda a, w: a + w))
    )
    lo, hi, total = F.col("start_us"), F.col("end_us"), F.col("__total")
    span = F.greatest(F.lit(seconds(0.2)), hi - lo)
    near = seconds(0.2)
    item = "struct<raw:bigint,start_us:bigint,end_us:bigint,heard:boolean,cursor:bigint,next:int>"

    def place(placed: Column, x: Column) -> Column:
        """Add one word's row, made from the row before; ``let`` keeps terms single and holds no array."""
        return F.concat(placed, F.array(let(F.get(placed, F.size(placed) - 1), lambda last: with_last(last, x))))

    def with_last(last: Column, x: Column) -> Column:
        following = F.coalesce(last["next"], F.lit(0))
        return let(F.get("__heard", following), lambda m: with_match(last, x, following, m))

    def with_match(last: Column, x: Column, following: Column, m: Column) -> Column:
        matched = F.coalesce(m["k"] == x["k"], F.lit(False))
        heard = matched & F.coalesce((m["hs"] >= lo - near) & (m["he"] <= hi + near), F.lit(False))
        start = F.when(heard, F.greatest(lo, m["hs"])).otherwise(F.coalesce(last["cursor"], lo))
        begun = F.struct(heard.alias("heard"), start.alias("start"), (following + matched.cast("int")).alias("next"))
        return let(begun, lambda w: with_start(last, x, m, w))

    def with_start(last: Column, x: Column, m: Column, w: Column) -> Column:
        natural = F.greatest(F.lit(MIN_WORD_US), idiv(x["weight"] * span, total))
        end = F.when(w["heard"], F.least(hi, F.greatest(w["start"] + MIN_WORD_US, m["he"]))).otherwise(
            F.least(hi, w["start"] + natural)
        )
        parted = F.when(w["start"] < last["end_us"], idiv(last["end_us"] + w["start"], 2)).otherwise(w["start"])
        return let(F.struct(end.alias("end"), parted.alias("at")), lambda e: finished(last, w, e))

    def finished(last: Column, w: Column, e: Column) -> Column:
        stretched = F.when(e["end"] - e["at"] < MIN_WORD_US, F.least(hi, e["at"] + MIN_WORD_US)).otherwise(e["end"])
        return F.struct(
            w["start"].alias("raw"),
            e["at"].alias("start_us"),
            stretched.alias("end_us"),
            w["heard"].alias("heard"),
            F.greatest(F.coalesce(last["cursor"], lo) + seconds(0.04), e["end"]).alias("cursor"),
            w["next"].alias("next"),
        )

    placed = packed.withColumn("__rows", F.aggregate("__items", F.array().cast(f"array<{item}>"), place))

    def cut(x: Column, i: Column) -> Column:
        after = F.get("__rows", i + 1)["raw"]
        word = F.get("__items", i)
        end = F.when(after < x["end_us"], idiv(x["end_us"] + after, 2)).otherwise(x["end_us"])
        return F.struct(
            word["k"].alias("k"),
            word["text"].alias("text"),
            x["start_us"].alias("start_us"),
            end.alias("end_us"),
            F.when(x["heard"], 0.85).otherwise(0.45).alias("confidence"),
        )

    bounds = [c.alias(name) for c, name in zip((lo, hi), window)]
    return placed.select("track_id", "idx", *bounds, F.explode(F.transform("__rows", cut)).alias("r")).select(
        "track_id", "idx", "r.*", *window
    )


def sung_first(text: Column) -> Column:
    """Words of a line with the first part of their normal form."""
    return F.transform(
        words_of(text), lambda w: F.struct(w.alias("raw"), F.coalesce(first_part(w), F.lower(w)).alias("norm"))
    )


def line_realign(
    lines: DataFrame, matches: DataFrame, onsets: DataFrame
) -> tuple[DataFrame, DataFrame, DataFrame]:
    """Re-time lines: distribute their words, snap them to onsets, place syllable starts.

    Returns words, syllable starts and line confidences.
    """
    from cadenza.operators.joins import nearest_onset
    from cadenza.operators.scores import realign_confidence
    from cadenza.operators.signals import syllable_starts

    placed = line_distribute(lines, matches, ("line_start_us", "line_end_us"))
    placed = stage(placed.withColumn("n", F.struct("idx", "k")), "placed-words")
    words = nearest_onset(placed, onsets)
    syllabic = words.select("track_id", "n", "start_us", "end_us", syllables(F.col("text")).alias("syllables"))
    starts = syllable_starts(syllabic, onsets).select("track_id", "n.idx", "n.k", "syllable", "start_us")
    scores = realign_confidence(
        lines.select("track_id", F.col("idx").alias("line_index")),
        words.select("track_id", F.col("idx").alias("line_index"), "confidence"),
    )
    return (
        words.select("track_id", "idx", "k", "text", "start_us", "end_us", "confidence", "snapped"),
        starts,
        scores,
    )
