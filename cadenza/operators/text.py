"""Vocabulary, scalar columns and display rules."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from cadenza.functions.text import nfkc, normalized, parts_of, phonetic, syllables, words_of
from cadenza.functions.timecode import clamp, format_timecode, frame_start, parse_timecode, to_frame
from cadenza.plans.skew import join_small
from cadenza.session import stage

OFFSET_LIMIT_US, LEAD_LIMIT_US, DEFAULT_LEAD_US = 2_000_000, 300_000, -40_000
SHORT_BREAK_US = 3_000_000


def raw_tokens(texts: DataFrame, column: str = "text") -> DataFrame:
    """White-space tokens of a text column."""
    return texts.select(F.explode(words_of(F.col(column))).alias("raw"))


def token_dim(tokens: DataFrame) -> DataFrame:
    """Vocabulary table: normal form, phonetic key and syllables of each distinct token.

    The work follows the size of the vocabulary; the corpus is only counted.  Python sees
    the distinct non-ASCII tokens alone.
    """
    return token_forms(stage(tokens.groupBy("raw").agg(F.count(F.lit(1)).alias("freq")), "vocabulary"))


def token_forms(vocab: DataFrame) -> DataFrame:
    """The same for given distinct tokens ``[raw, freq]``; tokens that normalise to nothing leave."""
    foreign = F.col("raw").rlike("[^\\x00-\\x7F]")
    composed = vocab.filter(~foreign).withColumn("__c", F.col("raw")).unionByName(
        vocab.filter(foreign).withColumn("__c", nfkc("raw"))
    )
    return token_columns(composed.withColumn("__norm", normalized(F.col("__c"))))


def token_columns(vocab: DataFrame) -> DataFrame:
    """One row per part of each normal form, with phonetic key and syllable count."""
    return vocab.select("raw", "freq", F.posexplode(parts_of(F.col("__norm"))).alias("part", "norm")).select(
        "raw",
        "freq",
        F.col("part").cast("bigint").alias("part"),
        "norm",
        phonetic(F.col("norm")).alias("phonetic"),
        syllables(F.col("norm")).alias("syllables"),
    )


def timecode_cols(df: DataFrame, us: str, text: str) -> DataFrame:
    return df.withColumns(
        {"timecode": format_timecode(F.col(us)), "parsed_us": parse_timecode(F.col(text))}
    )


def frame_grid_cols(df: DataFrame, us: str, fps: int) -> DataFrame:
    frame = to_frame(F.col(us), fps)
    return df.withColumn("frame", frame).withColumn("frame_us", frame_start(F.col("frame"), fps))


def cased(text: Column, transform: str) -> Column:
    """Display case; ``capitalize`` raises every letter that follows a non-word character."""
    if transform == "uppercase":
        return F.upper(text)
    if transform == "lowercase":
        return F.lower(text)
    if transform == "capitalize":
        runs = F.regexp_extract_all(text, F.lit("([A-Za-z0-9_]+|[^A-Za-z0-9_]+)"), F.lit(1))
        return F.array_join(
            F.transform(runs, lambda r: F.concat(F.upper(F.substring(r, 1, 1)), r.substr(F.lit(2), F.length(r)))),
            "",
        )
    return text


def caption_lines(
    captions: DataFrame, max_chars: int = 32, max_lines: int = 2, transform: str = "none"
) -> DataFrame:
    """Wrap captions into display lines; the last allowed line gets an ellipsis on overflow.

    Where a line breaks depends on the lines before it, so each caption's word array is
    folded (one caption's text bounds the array).
    """
    empty = F.struct(
        F.array().cast("array<string>").alias("lines"),
        F.lit(0).alias("used"),
        F.lit(False).alias("full"),
    )

    def put(acc: Column, word: Column) -> Column:
        size = F.length(word)
        started = acc["used"] > 0
        needed = acc["used"] + size + F.when(started, 1).otherwise(0)
        breaks = started & (needed > max_chars)
        last = F.try_element_at(acc["lines"], F.lit(-1))
        head = F.slice(acc["lines"], 1, F.greatest(F.size(acc["lines"]) - 1, F.lit(0)))
        overflow = breaks & (F.size(acc["lines"]) >= max_lines)
        lines = (
            F.when(acc["full"], acc["lines"])
            .when(overflow, F.concat(head, F.array(F.concat(last, F.lit("…")))))
            .when(breaks | ~started, F.concat(acc["lines"], F.array(word)))
            .otherwise(F.concat(head, F.array(F.concat(last, F.lit(" "), word))))
        )
        return F.struct(
            lines.alias("lines"),
            F.when(breaks, size).otherwise(needed).alias("used"),
            (acc["full"] | overflow).alias("full"),
        )

    wrapped = F.aggregate(words_of(cased(F.col("text"), transform)), empty, put, lambda acc: acc["lines"])
    return captions.select("track_id", "idx", F.posexplode(wrapped)).select(
        "track_id", "idx", F.col("pos").cast("bigint").alias("line_no"), F.col("col").alias("text")
    )


def sync_offset(words: DataFrame, settings: DataFrame) -> DataFrame:
    """Apply each track's global offset and word lead, both kept within their limits.

    ``settings[track_id, offset_us, lead_us]``; a missing value falls back to the default.
    """
    lead = clamp(F.coalesce("lead_us", F.lit(DEFAULT_LEAD_US)), -LEAD_LIMIT_US, LEAD_LIMIT_US)
    offset = clamp(F.coalesce("offset_us", F.lit(0)), -OFFSET_LIMIT_US, OFFSET_LIMIT_US)
    moved = join_small(words, settings, ["track_id"], ["start_us", "end_us"], "left").withColumn(
        "__shift", lead - offset
    )
    return moved.withColumns(
        {
            "start_us": F.greatest(F.lit(0), F.col("start_us") + F.col("__shift")),
            "end_us": F.greatest(F.lit(0), F.col("end_us") + F.col("__shift")),
        }
    ).select(*words.columns)


def word_tier(confidence: Column) -> Column:
    return F.when(confidence >= 0.85, "high").when(confidence >= 0.6, "mid").otherwise("low")


def is_music(text: Column, instrumental: Column) -> Column:
    return instrumental | (F.coalesce(text, F.lit("")) == "") | (F.trim(text) == "♪")


def caption_tier(confidence: Column, text: Column, instrumental: Column) -> Column:
    return (
        F.when(is_music(text, instrumental), "music")
        .when(confidence < 0.35, "weak")
        .when(confidence < 0.6, "low")
        .otherwise("ok")
    )


def confidence_tier(words: DataFrame, captions: DataFrame) -> DataFrame:
    """How many words and captions fall into each confidence tier."""
    w = words.select(F.lit("word").alias("kind"), word_tier(F.col("confidence")).alias("tier"))
    c = captions.select(
        F.lit("caption").alias("kind"),
        caption_tier(F.col("confidence"), F.col("text"), F.col("instrumental")).alias("tier"),
    )
    return w.unionByName(c).groupBy("kind", "tier").agg(F.count(F.lit(1)).alias("n"))


def instrumental_flag(captions: DataFrame, mode: str = "auto") -> DataFrame:
    """Flag music captions and keep the ones the display mode shows."""
    music = is_music(F.col("text"), F.col("instrumental")) | F.lower("text").contains("instrumental")
    flagged = captions.withColumn("music", music)
    if mode == "hidden":
        return flagged.filter(~F.col("music"))
    if mode == "auto":
        return flagged.filter(~F.col("music") | (F.col("end_us") - F.col("start_us") > SHORT_BREAK_US))
    return flagged


def natural_key(text: Column) -> Column:
    """Sort key: letter case ignored, digit runs compared by value, however long they are.

    Runs beyond 20 digits come after all others, by their length and then their digits.
    """
    runs = F.regexp_extract_all(F.lower(text), F.lit("([0-9]+|[^0-9]+)"), F.lit(1))

    def padded(run: Column) -> Column:
        digits = F.regexp_replace(run, "^0+([0-9])", "$1")
        size = F.length(digits)
        return F.when(size <= 20, F.lpad(digits, 20, "0")).otherwise(
            F.concat(F.lit(":"), F.lpad(size.cast("string"), 10, "0"), digits)
        )

    return F.array_join(F.transform(runs, lambda r: F.when(r.rlike("^[0-9]"), padded(r)).otherwise(r)), "")


def natural_sort(df: DataFrame, column: str) -> DataFrame:
    return df.withColumn("sort_key", natural_key(F.col(column))).orderBy("sort_key", column)
