"""The whole synchronisation over the tables; every step has its own oracle elsewhere."""

from pyspark.sql import functions as F

from cadenza.functions.timecode import idiv
from cadenza.plans.sync import run_sync
from cadenza.session import stage
from cadenza.sources import sheets
from cadenza.sources import testbed as B


_SYNCED = {}


def synced(spark, sf_dir):
    """Result of the run, made once for an application; its parts lie in the shared folder."""
    key = (spark.sparkContext.applicationId, sf_dir)
    if key not in _SYNCED:
        result = run(spark, sf_dir)
        _SYNCED[key] = {part: stage(getattr(result, part), f"sync-{part}") for part in ("captions", "words", "summary")}
    return _SYNCED[key]


def run(spark, sf_dir):
    """Benchmark items as sheets (a line per sentence) against the documents holding them."""
    pairs = B.pairs(spark, sf_dir).select("pair_id", "ref_id", "hyp_id")
    items = B.table(spark, sf_dir, "benchmark").select(F.col("item_id").alias("ref_id"), "text")
    sheet = items.join(pairs, ["ref_id"]).select(
        F.col("pair_id").alias("doc_id"), F.replace("text", F.lit(". "), F.lit(".\n\n")).alias("text")
    )
    lines = stage(sheets.sheet_lines(sheet).withColumnRenamed("doc_id", "track_id"), "sheet")
    heard = B.heard_tokens(spark, sf_dir).select(
        F.col("pair_id").alias("track_id"), "j", F.col("norm").alias("word"), "start_us", "end_us"
    )
    segments = heard.groupBy("track_id", idiv(F.col("j"), 10).alias("k")).agg(
        F.min("start_us").alias("start_us"), F.max("end_us").alias("end_us"), F.lit(0.1).alias("no_speech_prob")
    )
    durations = heard.groupBy("track_id").agg((F.max("end_us") + 2_000_000).alias("duration_us"))
    anchors = lines.filter("idx % 3 = 0").select(
        "track_id",
        F.col("idx").alias("line_index"),
        (F.col("idx") * 3_000_000).alias("offset_us"),
        (F.col("idx") % 10 / 10).alias("confidence"),
        F.col("idx").alias("anchor_id"),
    )
    return run_sync(lines, heard, segments, durations, B.pair_vocabulary(spark, sf_dir), anchors)


QUERIES = {
    "run_sync": lambda s, d: synced(s, d)["captions"],
    "run_sync_words": lambda s, d: synced(s, d)["words"],
    "run_sync_summary": lambda s, d: synced(s, d)["summary"],
}

ORACLE: dict[str, str] = {}
