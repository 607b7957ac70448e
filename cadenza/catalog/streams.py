"""Streaming queries and their oracles: the batch meaning of the same data.

A stream emits a window or phrase once the watermark has passed its end, so the oracles
leave out what is still open when the data ends; onsets have a closing row instead.
"""

import uuid

from pyspark.sql import functions as F

from cadenza.catalog.base_sql import CAPTIONS
from cadenza.catalog.signals import _CANDIDATES, flux
from cadenza.session import configure, shared_folder, stage
from cadenza.sources import testbed as B
from cadenza.streaming import jobs as S

#: Length of a flux frame, and silence after which a track has ended.
HOP_MS, IDLE_MS = 10, 200
EVENT_SCHEMA = (
    "event_id bigint, ts timestamp_ntz, user_id bigint, event_type string, value double, props string"
)


def table_stream(spark, sf_dir, name, schema):
    """A table as a stream; it may be one file or a folder of files, and only a pattern takes both."""
    configure(spark)
    return spark.readStream.schema(schema).parquet(f"{sf_dir.rstrip('/')}/{name}.parque[t]")


def reports(spark, sf_dir):
    return table_stream(spark, sf_dir, "events", EVENT_SCHEMA).select(
        F.col("user_id").alias("job_id"),
        F.col("event_type").alias("stage"),
        (F.get_json_object("props", "$.k").cast("int") / 100.0).alias("progress"),
        F.col("ts").cast("timestamp").alias("ts"),
    )


def progress(spark, sf_dir):
    return S.run_available(S.job_progress(reports(spark, sf_dir), "6 hours", "1 day"), "job-progress")


def latest(spark, sf_dir):
    return S.job_latest(reports(spark, sf_dir), "job-latest")


def dedup(spark, sf_dir):
    schema = "doc_id bigint, text string, lang string, source string, n_chars bigint"
    transcripts = table_stream(spark, sf_dir, "documents", schema).select(
        F.sha2("text", 256).alias("sha"),
        F.lit("m1").alias("model"),
        F.col("lang").alias("language"),
        F.timestamp_seconds(F.col("doc_id") + 1_700_000_000).alias("ts"),
    )
    return S.run_available(S.transcript_dedup(transcripts, "3650 days"), "transcripts")


def spoken_phrases(spark, sf_dir):
    words = table_stream(spark, sf_dir, "events", EVENT_SCHEMA).select(
        F.col("user_id").alias("track_id"),
        F.col("ts").cast("timestamp").alias("ts"),
        (F.round(F.col("value") * 100) * 3.6).alias("length_s"),
    )
    return S.run_available(S.phrases(words, 12_600.0, "1 day"), "phrases")


def replayed(frames, path, slices):
    """A stream of ``frames`` in ``slices`` micro-batches in order of time, and one that ends it."""
    spark = frames.sparkSession
    timed = frames.withColumn("ts", F.timestamp_millis((F.col("frame") + 1) * HOP_MS))
    top = frames.agg(F.max("frame")).first()[0] or 0
    for k in range(slices):
        part = timed.filter((F.col("frame") * slices >= k * (top + 1)) & (F.col("frame") * slices < (k + 1) * (top + 1)))
        part.coalesce(1).write.mode("append").parquet(path)
    end = spark.range(1).select(
        *[F.lit(None).cast(f.dataType).alias(f.name) for f in frames.schema],
        F.timestamp_millis(F.lit((top + 1) * HOP_MS + 10 * IDLE_MS)).alias("ts"),
    )
    end.write.mode("append").parquet(path)
    return spark.readStream.schema(timed.schema).option("maxFilesPerTrigger", 1).parquet(path)


def onsets(spark, sf_dir):
    """Flux frames replayed from a table."""
    frames = stage(flux(spark, sf_dir), "flux-frames")
    path = f"{shared_folder(spark)}/flux-source-{uuid.uuid4().hex}"
    return S.stream_onsets(replayed(frames, path, 2), 4, f"{IDLE_MS} milliseconds", IDLE_MS).withColumn(
        "flux", F.round("flux", 6)
    )


def under_playhead(spark, sf_dir):
    ticks = table_stream(spark, sf_dir, "events", EVENT_SCHEMA).select(
        F.col("user_id").alias("track_id"),
        F.col("event_id").alias("tick_id"),
        (F.col("event_id") * 7_919_000 % 720_000_000).alias("at_us"),
    )
    return S.run_available(S.active_captions(ticks, B.captions(spark, sf_dir)), "ticks")


QUERIES = {
    "stream_job_progress": progress,
    "stream_job_latest": latest,
    "stream_transcript_dedup": dedup,
    "stream_phrases": spoken_phrases,
    "stream_onsets": onsets,
    "stream_active_caption": under_playhead,
}

ORACLE = {
    "stream_job_progress": """
WITH e AS (SELECT *, epoch_us(ts) // 21600000000 * 21600000000 AS w, CAST(json_extract_string(props, '$.k') AS BIGINT) AS k FROM events)
SELECT w AS window_us, event_type AS stage, count(*) AS reports, round(sum(k) / count(*) / 100, 6) AS mean_progress
FROM e WHERE w + 21600000000 <= (SELECT epoch_us(max(ts)) // 1000 * 1000 - 86400000000 FROM events)
GROUP BY w, event_type""",
    "stream_job_latest": """
SELECT user_id AS job_id, event_type AS stage, CAST(json_extract_string(props, '$.k') AS INT) / 100 AS progress, epoch_us(ts) AS updated_us
FROM events QUALIFY row_number() OVER (PARTITION BY user_id ORDER BY ts DESC) = 1""",
    "stream_transcript_dedup": "SELECT DISTINCT sha256(text) AS sha, 'm1' AS model, lang AS language FROM documents",
    "stream_phrases": """
WITH w AS (SELECT user_id AS track_id, epoch_us(ts) AS s, epoch_us(ts) + CAST(round(value * 100) * 3600000 AS BIGINT) + 12600000000 AS e FROM events),
f AS (
  SELECT *, CASE WHEN s > max(e) OVER (PARTITION BY track_id ORDER BY s ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) THEN 1 ELSE 0 END AS fresh
  FROM w
),
g AS (SELECT *, sum(fresh) OVER (PARTITION BY track_id ORDER BY s) AS phrase FROM f)
SELECT track_id, min(s) AS start_us, max(e) AS open_until_us, count(*) AS words FROM g GROUP BY track_id, phrase
HAVING max(e) <= (SELECT epoch_us(max(ts)) // 1000 * 1000 - 86400000000 FROM events)""",
    "stream_onsets": "WITH RECURSIVE " + _CANDIDATES + " SELECT track_id, frame, round(flux, 6) AS flux FROM walk WHERE kept",
    "stream_active_caption": "WITH " + CAPTIONS + """,
t AS (SELECT user_id AS track_id, event_id AS tick_id, event_id * 7919000 % 720000000 AS at_us FROM events)
SELECT t.track_id, tick_id, at_us, idx FROM t JOIN captions c ON c.track_id = t.track_id AND at_us BETWEEN start_us AND end_us""",
}
