"""Adapters that shape the given parquet tables into the engine's tables.

Each adapter reads whole tables.  Derived tables that many queries share are staged once
per application in the shared folder.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from cadenza.functions.timecode import idiv
from cadenza.plans.ordered import by_time, scan
from cadenza.session import configure, spread, stage

_STAGED: dict[tuple[str, str, str], DataFrame] = {}

DAY_US = 86_400_000_000


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    configure(spark)
    return spark.read.parquet(f"{sf_dir.rstrip('/')}/{name}.parquet")


def texts(spark: SparkSession, sf_dir: str, name: str, *columns: str) -> DataFrame:
    """Chosen columns of a table of texts, over all cores even when it is one small file."""
    return spread(table(spark, sf_dir, name).select(*columns))


def _once(spark: SparkSession, sf_dir: str, name: str, build) -> DataFrame:
    key = (spark.sparkContext.applicationId, sf_dir, name)
    if key not in _STAGED:
        _STAGED[key] = stage(build(), name)
    return _STAGED[key]


def micros(ts: str = "ts"):
    return F.unix_micros(F.col(ts).cast("timestamp"))


def timed_words(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One timed word per event; a user is a track and an hour counts as a second."""

    def build() -> DataFrame:
        ev = table(spark, sf_dir, "events").select(
            F.col("user_id").alias("track_id"),
            "event_id",
            micros().alias("at_us"),
            F.col("event_type").alias("text"),
            F.round(F.col("value") * 100_000).cast("bigint").alias("dur_us"),
        )
        numbered = scan(
            ev,
            ["track_id"],
            ["at_us", "event_id"],
            by_time("at_us", DAY_US),
            sum_before={"n": F.lit(1).cast("bigint")},
            total={"first_us": ("min", F.col("at_us"))},
        )
        start = idiv(F.col("at_us") - F.col("first_us"), 3600)
        return numbered.select(
            "track_id",
            "n",
            start.alias("start_us"),
            (start + F.col("dur_us")).alias("end_us"),
            "text",
            ((F.col("event_id") % 100) / F.lit(100.0)).alias("confidence"),
            "event_id",
        )

    return _once(spark, sf_dir, "timed_words", build)


def captions(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Timed words as captions with a few words of text each."""
    take = F.concat(
        F.col("text"), F.lit(" take "), (F.col("event_id") % 23).cast("string"), F.lit(" don't fade")
    )
    return timed_words(spark, sf_dir).select(
        "track_id",
        F.col("n").alias("idx"),
        "start_us",
        "end_us",
        F.when(F.col("text") == "error", "♪")
        .when(F.col("event_id") % 29 == 0, "Instrumental break")
        .otherwise(take)
        .alias("text"),
        (F.col("text") == "error").alias("instrumental"),
        "confidence",
        "event_id",
    )


def line_words(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Timed words grouped five to a line."""
    return timed_words(spark, sf_dir).select(
        "track_id",
        idiv(F.col("n"), 5).alias("line_index"),
        (F.col("n") % 5).alias("k"),
        "n",
        "text",
        "start_us",
        "end_us",
        "confidence",
        (F.col("confidence") >= 0.3).alias("matched"),
        "event_id",
    )


def durations(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Track length: the latest word end, cut to a whole second."""
    return timed_words(spark, sf_dir).groupBy("track_id").agg(
        (idiv(F.max("end_us"), 1_000_000) * 1_000_000).alias("duration_us")
    )


def sheets(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Documents dressed as sheets: header, section mark, a blank after every 4th line."""
    lines = F.transform(
        F.split("text", "\n"),
        lambda x, i: F.when((i + 1) % 4 == 0, F.concat(x, F.lit("\n"))).otherwise(x),
    )
    return texts(spark, sf_dir, "documents", "doc_id", "text", "source", "lang").select(
        "doc_id",
        F.concat(
            F.lit("## title: "), F.col("source"), F.lit("\n["), F.col("lang"), F.lit("]\n"),
            F.array_join(lines, "\n"),
        ).alias("text"),
    )


BLOCK_LEN = 64


def signal_blocks(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Eight embedding vectors after one another make one signal."""
    return table(spark, sf_dir, "embeddings").select(
        idiv(F.col("vec_id"), 8).alias("track_id"),
        (F.col("vec_id") % 8).alias("block_no"),
        F.col("embedding").cast("array<double>").alias("samples"),
    )


def signals(spark: SparkSession, sf_dir: str) -> DataFrame:
    from cadenza.operators.signals import explode_blocks

    return explode_blocks(signal_blocks(spark, sf_dir), BLOCK_LEN)


def clips(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every vector, halved and disturbed, as a clip of its signal."""
    cut = F.transform(
        F.col("embedding").cast("array<double>"),
        lambda v, i: v * 0.5 + ((i * 7) % 5 - 2) * 0.01,
    )
    return table(spark, sf_dir, "embeddings").select(
        F.col("vec_id").alias("clip_id"),
        idiv(F.col("vec_id"), 8).alias("track_id"),
        cut.alias("clip"),
        ((F.col("vec_id") % 8) * 640_000 + F.col("vec_id") % 3 * 400_000).alias("cursor_us"),
    )


def vocabulary(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Token dimension of the documents and benchmark texts."""
    from cadenza.operators.text import raw_tokens, token_dim

    def build() -> DataFrame:
        both = texts(spark, sf_dir, "documents", "text").unionByName(
            table(spark, sf_dir, "benchmark").select("text")
        )
        return token_dim(raw_tokens(both))

    return _once(spark, sf_dir, "vocabulary", build)


def pairs(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Benchmark items found in documents; the numbers of item and document name the pair."""
    from cadenza.operators.alignment import align_pairs

    def build() -> DataFrame:
        ref = table(spark, sf_dir, "benchmark").select(F.col("item_id").alias("ref_id"), "text")
        hyp = texts(spark, sf_dir, "documents", "doc_id", "text").withColumnRenamed("doc_id", "hyp_id")
        return align_pairs(ref, hyp)

    found = _once(spark, sf_dir, "pairs", build)
    return found.withColumn("pair_id", F.concat_ws(":", "ref_id", "hyp_id"))


def spoken_words(spark: SparkSession, sf_dir: str) -> DataFrame:
    """White-space tokens of the documents of all pairs, two of seven misheard."""
    from cadenza.operators.alignment import tokens

    def build() -> DataFrame:
        found = pairs(spark, sf_dir).select("hyp_id").distinct()
        docs = table(spark, sf_dir, "documents").select(F.col("doc_id").alias("hyp_id"), "text")
        raw, turn = F.col("raw"), F.col("j") % 7
        misheard = F.when(turn == 3, F.concat(F.lit("x"), raw)).when(turn == 5, F.concat(raw, F.lit("o"))).otherwise(raw)
        return tokens(docs.join(found, ["hyp_id"], "left_semi"), "hyp_id", "j").withColumn("raw", misheard)

    return _once(spark, sf_dir, "spoken_words", build)


def pair_vocabulary(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Token dimension of what the pairs' texts hold, which other documents add nothing to."""
    from cadenza.operators.text import raw_tokens, token_dim

    def build() -> DataFrame:
        items = raw_tokens(table(spark, sf_dir, "benchmark").select("text"))
        return token_dim(spoken_words(spark, sf_dir).select("raw").unionByName(items))

    return _once(spark, sf_dir, "pair_vocabulary", build)


def sheet_tokens(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Tokens of the benchmark items of all pairs, contractions in parts."""
    from cadenza.operators.alignment import normalize_tokens, tokens

    def build() -> DataFrame:
        items = table(spark, sf_dir, "benchmark").select(F.col("item_id").alias("ref_id"), "text")
        rows = normalize_tokens(tokens(items, "ref_id", "pos"), pair_vocabulary(spark, sf_dir), False)
        # a sheet is one row of text, so this window is bounded by it
        w = Window.partitionBy("ref_id").orderBy("pos", "part")
        return rows.withColumn("i", F.row_number().over(w).cast("bigint") - 1).join(
            pairs(spark, sf_dir).select("pair_id", "ref_id"), ["ref_id"]
        ).select("pair_id", "ref_id", "i", "norm", "phonetic")

    return _once(spark, sf_dir, "sheet_tokens", build)


def heard_tokens(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Tokens of the documents of all pairs as a transcript that mishears two words of seven."""
    from cadenza.operators.alignment import normalize_tokens

    def build() -> DataFrame:
        found = pairs(spark, sf_dir).select("pair_id", F.col("hyp_id"))
        rows = normalize_tokens(spoken_words(spark, sf_dir), pair_vocabulary(spark, sf_dir), True)
        # a transcript is one document row, so this window is bounded by it
        w = Window.partitionBy("hyp_id").orderBy("spoken")
        rows = rows.withColumnRenamed("j", "spoken").withColumn("j", F.row_number().over(w).cast("bigint") - 1)
        return rows.join(found, ["hyp_id"]).select(
            "pair_id",
            "hyp_id",
            "j",
            "norm",
            "phonetic",
            (F.col("spoken") * 400_000).alias("start_us"),
            (F.col("spoken") * 400_000 + 300_000).alias("end_us"),
        )

    return _once(spark, sf_dir, "heard_tokens", build)
