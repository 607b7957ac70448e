"""Benchmark decontamination with DataFrame functions alone.

The windows of the benchmark are a broadcast hash table whose size is checked; beyond the
bound the same join is shuffled.  A bit table of window hashes sorts out, inside the row,
the places of a text that can start a window; only these become rows, each with its words,
and the join on the words themselves verifies them.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from cadenza.llm.base import WORD, ascii_lower, free_prefix, row_key
from cadenza.session import stage

WINDOW = 10
#: Windows of items, and bytes of their words, up to which their table is broadcast.
BROADCAST_ROWS, BROADCAST_BYTES = 500_000, 64_000_000
#: Words of 32 bits in the table that sorts out places.
BIT_WORDS = 1 << 15


def words(text: Column) -> Column:
    """Words of a text; none for null."""
    return F.coalesce(F.regexp_extract_all(ascii_lower(text), F.lit(f"({WORD})"), F.lit(1)), F.array().cast("array<string>"))


def _slot(array: Column, at: Column, length: int | Column) -> Column:
    """Hash of a window by its first, middle and last word, as a place of the bit table."""
    middle = (F.lit(length) / 2).cast("int")
    return F.pmod(
        F.xxhash64(F.get(array, at), F.get(array, at + middle), F.get(array, at + F.lit(length) - 1)),
        F.lit(BIT_WORDS * 32),
    )


def benchmark_windows(benchmark: DataFrame) -> DataFrame:
    """(length, window, item_id), distinct; a short item is one window, one without words none."""
    split = benchmark.select("item_id", words(F.col("text")).alias("w")).where(F.size("w") > 0)
    length = F.least(F.size("w"), F.lit(WINDOW))
    starts = F.sequence(F.lit(0), F.size("w") - length)
    return (
        split.select("item_id", "w", length.alias("length"), F.explode(starts).alias("at"))
        .select("item_id", "length", F.slice("w", F.col("at") + 1, F.col("length")).alias("part"))
        .select("item_id", "length", F.array_join("part", " ").alias("window"),
                _slot(F.col("part"), F.lit(0), F.col("length")).alias("slot"))
        .distinct()
    )


def scan(docs: DataFrame, benchmark: DataFrame) -> DataFrame:
    """One row per row of ``docs``: doc_id, key (of id and text), n_words, hits and items.

    ``hits`` holds (start, length) of every occurrence of a window, words counted from 0, and
    ``items`` the items these belong to.  Null texts have no words.  Rows that agree in id
    and text are told apart by nothing and stay separate rows with the same result.
    """
    spark = docs.sparkSession
    windows = stage(benchmark_windows(benchmark), "windows")
    lengths = [r["length"] for r in windows.select("length").distinct().collect()]  # ten at most
    bits = windows.groupBy((F.col("slot") / 32).cast("int").alias("k")).agg(
        F.bit_or(F.call_function("shiftleft", F.lit(1), (F.col("slot") % 32).cast("int"))).alias("b")
    )
    # BIT_WORDS numbers whatever the benchmark's size
    filled = spark.range(BIT_WORDS).join(bits, F.col("id") == F.col("k"), "left").select("id", F.coalesce("b", F.lit(0)).alias("b"))
    table = filled.agg(F.array_sort(F.collect_list(F.struct("id", "b"))).alias("t")).select(F.col("t.b").alias("t"))
    by_window = windows.groupBy("window", "length").agg(F.collect_set("item_id").alias("of"))
    size = windows.agg(F.count("*").alias("n"), F.coalesce(F.sum(F.octet_length("window")), F.lit(0)).alias("bytes")).first()
    small = size["n"] <= BROADCAST_ROWS and size["bytes"] <= BROADCAST_BYTES
    by_window = F.broadcast(by_window) if small else by_window

    rows = docs.select("doc_id", row_key().alias("key"), words(F.col("text")).alias("w")).withColumn("row", F.monotonically_increasing_id())
    marked = rows.withColumn("t", table.scalar())

    def places(length: int) -> Column:
        def maybe(at: Column) -> Column:
            slot = _slot(F.col("w"), at, length)
            return F.call_function("shiftright", F.get(F.col("t"), (slot / 32).cast("int")), (slot % 32).cast("int")).bitwiseAND(1) == 1

        found = F.filter(F.sequence(F.lit(0), F.size("w") - length), maybe)
        return F.when(
            F.size("w") >= length,
            F.transform(found, lambda at: F.struct(at.alias("at"), F.lit(length).alias("length"), F.array_join(F.slice("w", at + 1, length), " ").alias("window"))),
        ).otherwise(F.array().cast("array<struct<at:int,length:int,window:string>>"))

    none = F.array().cast("array<struct<at:int,length:int,window:string>>")
    candidates = F.concat(none, *(places(n) for n in lengths))
    slim = marked.select("row", "doc_id", "key", F.size("w").alias("n_words"), candidates.alias("c"))
    one = slim.select("row", "doc_id", "key", "n_words", F.explode_outer("c").alias("c")).select("row", "doc_id", "key", "n_words", "c.*")
    hit = one.join(by_window, ["window", "length"], "left")
    place = F.when(F.col("of").isNotNull(), F.struct("at", "length"))
    return (
        hit.groupBy("row", "doc_id", "key", "n_words")
        .agg(F.collect_list(place).alias("hits"), F.array_distinct(F.flatten(F.collect_set("of"))).alias("items"))
        .drop("row")
    )


def covered(hits: Column) -> Column:
    """Distinct word places inside any of the (at, length) in ``hits``."""
    return F.array_distinct(F.flatten(F.transform(hits, lambda h: F.sequence(h["at"], h["at"] + h["length"] - 1))))


def contamination(docs: DataFrame, benchmark: DataFrame) -> DataFrame:
    """doc_id, n_words, n_hit, n_items, items_sha256 and contaminated for each row."""
    found = scan(docs, benchmark)
    items = F.sort_array(F.transform("items", lambda x: x.cast("string")))
    return found.select(
        "doc_id",
        F.col("n_words").cast("long").alias("n_words"),
        F.size(covered(F.col("hits"))).cast("long").alias("n_hit"),
        F.size("items").cast("long").alias("n_items"),
        F.sha2(F.array_join(items, ","), 256).alias("items_sha256"),
    ).withColumn("contaminated", F.col("n_hit") > 0)


def drop_contaminated(docs: DataFrame, benchmark: DataFrame) -> DataFrame:
    """Rows of ``docs`` without any hit; all columns stay.  Null texts are clean.

    Rows that share an id, or have none, are judged each by its own text.
    """
    own = free_prefix(docs)
    hit = scan(docs, benchmark).where(F.size("hits") > 0).select(F.col("key").alias(f"{own}hit")).distinct()
    keyed = docs.withColumn(f"{own}key", row_key())
    return keyed.join(hit, F.col(f"{own}key") == F.col(f"{own}hit"), "left_anti").drop(f"{own}key")


def remove_spans(docs: DataFrame, benchmark: DataFrame) -> DataFrame:
    """doc_id and the words of each text outside hits, joined by spaces (the other outcome)."""
    found = scan(docs, benchmark).select("key", covered(F.col("hits")).alias("gone")).dropDuplicates(["key"])
    split = docs.select("doc_id", row_key().alias("key"), words(F.col("text")).alias("w"))
    kept = F.filter("w", lambda w, at: ~F.array_contains("gone", at))
    return split.join(found, "key").select("doc_id", F.array_join(kept, " ").alias("text"))
