"""Loading and upkeep of stored tables: transcripts, documents, assets, caches, jobs."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from cadenza.functions.timecode import format_timecode, half_up
from cadenza.plans.skew import join_unique

TRANSCRIPT_SCHEMA = """
text string, language string, duration double,
words array<struct<word: string, start: double, end: double, probability: double>>,
segments array<struct<start: double, end: double, text: string, avg_logprob: double, no_speech_prob: double>>
"""

DOCUMENT_SCHEMA = """
id string, version string,
meta struct<title: string, artist: string, durationSec: double, fps: double,
            resolution: string, aspectRatio: string, language: string>
"""

# What a stored document may contain.
DOCUMENT_VERSION = 1
RESOLUTIONS = ["1280x720", "1920x1080", "2560x1440", "3840x2160"]
ASPECT_RATIOS = ["16:9", "9:16", "1:1", "4:5", "21:9"]

# What may be uploaded.
MAX_ASSET_BYTES = 80 * 1024 * 1024
MIME_TYPES = [
    "audio/mpeg",
    "audio/wav",
    "audio/wave",
    "audio/x-wav",
    "audio/flac",
    "audio/mp4",
    "audio/aac",
    "audio/ogg",
    "audio/x-m4a",
    "image/jpeg",
    "image/png",
    "image/webp",
    "font/ttf",
    "font/otf",
    "font/woff2",
    "application/octet-stream",
]
EXTENSIONS = "mp3 wav flac m4a aac ogg jpg jpeg png webp ttf otf woff2".split()

CACHE_KEY = ["sha", "model", "language"]


def micros_of(seconds: Column) -> Column:
    return half_up(seconds * 1_000_000)


def transcript_scan(raw: DataFrame) -> tuple[DataFrame, DataFrame, DataFrame]:
    """Parse transcript JSON ``raw[track_id, json]`` into documents, words and segments.

    A document whose word or segment list is malformed keeps its text and gets an empty
    list instead of failing the load.
    """
    t = raw.withColumn("t", F.from_json("json", TRANSCRIPT_SCHEMA, {"mode": "PERMISSIVE"}))
    words = F.coalesce("t.words", F.array().cast(t.schema["t"].dataType["words"].dataType))
    segments = F.coalesce("t.segments", F.array().cast(t.schema["t"].dataType["segments"].dataType))
    docs = t.select(
        "track_id",
        F.coalesce("t.text", F.lit("")).alias("text"),
        F.col("t.language").alias("language"),
        F.size(words).cast("bigint").alias("words"),
        F.size(segments).cast("bigint").alias("segments"),
    )
    word_rows = t.select("track_id", F.posexplode(words)).select(
        "track_id",
        F.col("pos").cast("bigint").alias("j"),
        F.col("col.word").alias("word"),
        micros_of(F.col("col.start")).alias("start_us"),
        micros_of(F.col("col.end")).alias("end_us"),
        F.col("col.probability").alias("probability"),
    )
    segment_rows = t.select("track_id", F.posexplode(segments)).select(
        "track_id",
        F.col("pos").cast("bigint").alias("k"),
        micros_of(F.col("col.start")).alias("start_us"),
        micros_of(F.col("col.end")).alias("end_us"),
        F.col("col.text").alias("text"),
        F.col("col.no_speech_prob").alias("no_speech_prob"),
    )
    return docs, word_rows, segment_rows


def read_transcripts(spark: SparkSession, path: str) -> DataFrame:
    """Transcript files (one JSON document each) as ``[track_id, json]``; the path is the key."""
    return spark.read.text(path, wholetext=True).select(
        F.input_file_name().alias("track_id"), F.col("value").alias("json")
    )


def doc_migrate(raw: DataFrame) -> DataFrame:
    """Bring stored JSON documents ``raw[id, json]`` to the current version.

    A missing or zero version becomes 1.  A document that breaks the schema becomes the
    default document, keeping its id and title.
    """
    doc = F.from_json("json", DOCUMENT_SCHEMA, {"mode": "PERMISSIVE"})
    d = raw.withColumn("d", doc)
    version = F.when(
        F.col("d.version").isNull() | (F.col("d.version") == "0"), F.lit(DOCUMENT_VERSION)
    ).otherwise(F.expr("try_cast(d.version as bigint)"))
    m = "d.meta."
    ok = (
        F.col("d.id").isNotNull()
        & (version >= 0)
        & F.col(m + "title").isNotNull()
        & F.col(m + "artist").isNotNull()
        & (F.col(m + "durationSec") >= 0)
        & (F.col(m + "fps") > 0)
        & F.col(m + "resolution").isin(RESOLUTIONS)
        & F.col(m + "aspectRatio").isin(ASPECT_RATIOS)
    )
    valid = F.coalesce(ok, F.lit(False))

    def pick(good: Column, default) -> Column:
        return F.when(F.col("valid"), good).otherwise(F.lit(default))

    return d.withColumn("valid", valid).select(
        F.coalesce("d.id", "id").alias("id"),
        pick(version, DOCUMENT_VERSION).cast("bigint").alias("version"),
        F.coalesce(m + "title", F.lit("Untitled")).alias("title"),
        pick(F.col(m + "artist"), "Unknown Artist").alias("artist"),
        pick(F.col(m + "durationSec"), 0.0).alias("duration_sec"),
        pick(F.col(m + "fps"), 30.0).alias("fps"),
        "valid",
    )


def doc_upgrade(raw: DataFrame) -> DataFrame:
    """Whole stored documents ``raw[id, json, ...]`` at the current version.

    Gives ``[id, json, changed, valid, captions, ...]``: ``captions`` are those of a valid document as
    they were stored, further columns of ``raw`` stay with their row, so nobody has to join them
    or to parse the document again.

    Documents are VARIANT values, so fields that no schema names (captions, words, settings and
    whatever else a client stored) survive.  A document that needs no change keeps its very
    bytes.  A missing or zero version becomes 1 and nothing else changes.  A document that is
    no object or breaks the schema becomes the default document with its id and title.
    """
    def of(path: str) -> Column:
        return F.try_variant_get("v", "$." + path, "variant")

    def kind(path: str) -> Column:
        return F.coalesce(F.schema_of_variant(of(path)), F.lit("VOID"))

    def text(path: str) -> Column:
        return F.when(kind(path) == "STRING", F.try_variant_get("v", "$." + path, "string"))

    def number(path: str) -> Column:
        return F.when(kind(path).rlike("^(BIGINT|DECIMAL|DOUBLE|FLOAT)"), F.try_variant_get("v", "$." + path, "double"))

    def timed(x: Column) -> Column:
        start, end = (F.try_variant_get(x, f"$.{t}Sec", "double") for t in ("start", "end"))
        return F.try_variant_get(x, "$.text", "string").isNotNull() & (end >= start)

    fresh = of("version").isNull() | (number("version") == 0)
    version = F.when(fresh, F.lit(float(DOCUMENT_VERSION))).otherwise(number("version"))
    ok = (
        text("id").isNotNull()
        & (version >= 0) & (version == F.floor(version))
        & text("meta.title").isNotNull() & text("meta.artist").isNotNull()
        & (number("meta.durationSec") >= 0) & (number("meta.fps") > 0)
        & text("meta.resolution").isin(RESOLUTIONS) & text("meta.aspectRatio").isin(ASPECT_RATIOS)
        & (of("captions").isNull() | F.forall("__captions", lambda x: F.coalesce(timed(x), F.lit(False))))
    )
    d = raw.withColumn("v", F.try_parse_json("json"))
    d = d.withColumn("__captions", F.try_variant_get("v", "$.captions", "array<variant>"))
    d = d.withColumns({"valid": F.coalesce(ok, F.lit(False)), "fresh": F.coalesce(fresh, F.lit(False))})
    fields = F.map_filter(F.try_variant_get("v", "$", "map<string,variant>"), lambda k, _: k != "version")
    set_version = F.create_map(F.lit("version"), F.to_variant_object(F.array(F.lit(DOCUMENT_VERSION))))
    set_version = F.transform_values(set_version, lambda _, one: F.variant_get(one, "$[0]", "variant"))
    default = F.to_json(
        F.struct(
            F.coalesce(text("id"), F.col("id")).alias("id"),
            F.lit(DOCUMENT_VERSION).alias("version"),
            F.struct(
                F.coalesce(F.try_variant_get("v", "$.meta.title", "string"), F.lit("Untitled")).alias("title"),
                F.lit("Unknown Artist").alias("artist"),
                F.lit(0).alias("durationSec"),
                F.lit(30).alias("fps"),
                F.lit(RESOLUTIONS[1]).alias("resolution"),
                F.lit(ASPECT_RATIOS[0]).alias("aspectRatio"),
                F.lit("en").alias("language"),
            ).alias("meta"),
            F.array().cast("array<string>").alias("captions"),
        )
    )
    upgraded = F.to_json(F.to_variant_object(F.map_concat(fields, set_version)))
    return d.select(
        F.when(F.col("valid"), text("id")).otherwise(F.coalesce(text("id"), F.col("id"))).alias("id"),
        F.when(~F.col("valid"), default).when(F.col("fresh"), upgraded).otherwise(F.col("json")).alias("json"),
        (~F.col("valid") | F.col("fresh")).alias("changed"),
        "valid",
        F.when(F.col("valid"), F.col("__captions")).alias("captions"),
        *[c for c in raw.columns if c not in ("id", "json")],
    )


def doc_captions(docs: DataFrame) -> DataFrame:
    """Captions of whole documents ``docs[id, json]``: ``[id, idx, text, start_us, end_us, item]``.

    ``item`` is the caption as it was stored; a document without captions gives no row.  Documents that
    come from ``doc_upgrade`` bring their captions along and are not parsed again.
    """
    parsed = F.try_variant_get(F.try_parse_json("json"), "$.captions", "array<variant>")
    items = F.col("captions") if "captions" in docs.columns else parsed
    return docs.select("id", F.posexplode(items).alias("idx", "item")).select(
        "id",
        F.col("idx").cast("bigint").alias("idx"),
        F.try_variant_get("item", "$.text", "string").alias("text"),
        *_times("item"),
        "item",
    )


def doc_words(captions: DataFrame) -> DataFrame:
    """Words of the captions that ``doc_captions`` gives: ``[id, idx, k, text, start_us, end_us]``."""
    words = F.try_variant_get("item", "$.words", "array<variant>")
    return captions.select("id", "idx", F.posexplode(words).alias("k", "w")).select(
        "id",
        "idx",
        F.col("k").cast("bigint").alias("k"),
        F.try_variant_get("w", "$.text", "string").alias("text"),
        *_times("w"),
    )


def _times(item: str) -> list[Column]:
    return [micros_of(F.try_variant_get(item, f"$.{t}Sec", "double")).alias(f"{t}_us") for t in ("start", "end")]


def asset_files(spark: SparkSession, path: str) -> DataFrame:
    """Files under a path as ``[asset_id, name, mime, size, sha]``; contents stay on the executors."""
    name = F.element_at(F.split("path", "/"), -1)
    return (
        spark.read.format("binaryFile")
        .option("recursiveFileLookup", "true")
        .load(path)
        .select(
            F.col("path").alias("asset_id"),
            name.alias("name"),
            F.lit("").alias("mime"),
            F.col("length").alias("size"),
            F.sha2("content", 256).alias("sha"),
        )
    )


def asset_manifest(files: DataFrame, max_bytes: int = MAX_ASSET_BYTES) -> DataFrame:
    """Accept or reject files by size, MIME type and extension."""
    suffix = F.regexp_extract("name", "[^.](\\.[^.]*)$", 1)
    known = F.col("name").rlike("(?i)\\.(" + "|".join(EXTENSIONS) + ")$")
    odd_type = (F.col("mime") != "") & ~F.col("mime").isin(MIME_TYPES) & ~known
    reason = F.when(F.col("size") > max_bytes, "oversized_upload").when(odd_type, "unsupported_codec")
    return files.select(
        "asset_id",
        "name",
        "mime",
        "size",
        "sha",
        F.when(suffix == "", ".bin").otherwise(suffix).alias("ext"),
        reason.alias("reason"),
        reason.isNull().alias("accepted"),
    )


def asset_dedup(manifest: DataFrame) -> DataFrame:
    """One row per distinct content; the smallest asset id is kept.

    Aggregates combine before the shuffle, so a content held by many assets is no hot key.
    """
    return manifest.groupBy("sha").agg(
        F.min("asset_id").alias("keep_id"), F.count(F.lit(1)).alias("copies"), F.sum("size").alias("bytes")
    )


def cache_misses(want: DataFrame, have: DataFrame) -> DataFrame:
    """Requests whose (sha, model, language) has no transcript yet."""
    return want.join(have.select(*CACHE_KEY), CACHE_KEY, "left_anti")


def cache_unique(have: DataFrame, order: list[str]) -> DataFrame:
    """First transcript of each key; an aggregate, not a window, so hot keys shrink early."""
    rest = [c for c in have.columns if c not in CACHE_KEY]
    return have.groupBy(*CACHE_KEY).agg(
        F.min_by(F.struct(*rest), F.struct(*order)).alias("r")
    ).select(*CACHE_KEY, "r.*")


def cache_hits(want: DataFrame, have: DataFrame, order: list[str]) -> DataFrame:
    """Requests with the stored transcript attached."""
    return join_unique(want, cache_unique(have, order), CACHE_KEY)


def cache_put(have: DataFrame, new: DataFrame, order: list[str]) -> DataFrame:
    """Append transcripts, unique on the cache key; a stored one wins over a new one."""
    both = have.withColumn("stored", F.lit(0)).unionByName(new.withColumn("stored", F.lit(1)))
    return cache_unique(both, ["stored", *order]).drop("stored")


def write_cache(cache: DataFrame, path: str) -> None:
    cache.write.mode("append").partitionBy("model", "language").parquet(path)


def upsert_latest(current: DataFrame, batch: DataFrame, key: list[str], order: list[str]) -> DataFrame:
    """Merge a batch into the current table: the row with the latest order wins per key."""
    rest = [c for c in current.columns if c not in key]
    merged = current.unionByName(batch)
    return merged.groupBy(*key).agg(F.max_by(F.struct(*rest), F.struct(*order)).alias("r")).select(*key, "r.*")


def delete_keys(current: DataFrame, keys: DataFrame, key: list[str]) -> DataFrame:
    return current.join(keys.select(*key), key, "left_anti")


def point_lookup(current: DataFrame, keys: DataFrame, key: list[str]) -> DataFrame:
    return current.join(keys.select(*key), key, "left_semi")


def history_keep_n(versions: DataFrame, key: list[str], order: list[str], n: int = 100) -> DataFrame:
    """Newest ``n`` versions per key.

    The rank filter is pushed below the shuffle (window group limit), so each task passes
    on at most ``n`` rows of a key.
    """
    w = Window.partitionBy(*key).orderBy(*[F.col(c).desc() for c in order])
    return versions.withColumn("age", F.row_number().over(w)).filter(F.col("age") <= n).withColumn(
        "age", F.col("age").cast("bigint")
    )


def top_n_candidates(df: DataFrame, key: list[str], order: list[Column], n: int) -> DataFrame:
    """Best ``n`` rows per group."""
    w = Window.partitionBy(*key).orderBy(*order)
    return df.withColumn("rank", F.row_number().over(w)).filter(F.col("rank") <= n).withColumn(
        "rank", F.col("rank").cast("bigint")
    )


def timed_text(captions: DataFrame) -> DataFrame:
    """Captions as time-coded text lines."""
    return captions.select(
        "track_id",
        "start_us",
        "idx",
        F.concat(
            F.lit("["), format_timecode(F.col("start_us")), F.lit(" --> "),
            format_timecode(F.col("end_us")), F.lit("] "), F.col("text"),
        ).alias("line"),
    )


def export_timed_text(captions: DataFrame, path: str) -> None:
    """Write one folder of text per track, lines in time order.

    Range partitioning lets a long track fill several files, named in time order.
    """
    (
        timed_text(captions)
        .repartitionByRange("track_id", "start_us", "idx")
        .sortWithinPartitions("track_id", "start_us", "idx")
        .select("track_id", F.col("line").alias("value"))
        .write.partitionBy("track_id")
        .text(path)
    )


def job_eta(events: DataFrame) -> DataFrame:
    """Remaining time of each job from its latest progress report.

    ``events[job_id, status, progress, updated_us]``; no estimate up to 5 % progress.
    """
    at = F.col("updated_us")
    latest = events.groupBy("job_id").agg(
        F.max_by(F.struct("status", "progress"), at).alias("r"),
        (F.max(at) - F.min(at)).alias("elapsed_us"),
    )
    p = F.col("r.progress")
    eta = F.when(p > 0.05, half_up(F.col("elapsed_us") * (1 - p) / p))
    return latest.select("job_id", "r.status", "r.progress", "elapsed_us", eta.alias("eta_us"))
