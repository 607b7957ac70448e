"""Queries over stored tables and scores, and their oracles."""

from pyspark.sql import functions as F

from cadenza.catalog.base_sql import CAPTIONS, LINE_WORDS, SHEETS
from cadenza.catalog.text import ORACLE as TEXT_ORACLE
from cadenza.operators import scores as C
from cadenza.operators.text import words_of
from cadenza.sources import sheets as S
from cadenza.sources import tables as T
from cadenza.sources import testbed as B
from cadenza.functions.timecode import idiv


def transcripts(spark, sf_dir):
    """Every conversation turn as transcript JSON; every tenth carries a malformed word list."""
    words = words_of(F.col("text"))
    timed = F.transform(
        words,
        lambda w, j: F.struct(
            w.alias("word"),
            (j * 0.4).alias("start"),
            (j * 0.4 + 0.3).alias("end"),
            (F.lit(1.0) / (j + 1)).alias("probability"),
        ),
    )
    n = F.size(words)
    segment = F.array(
        F.struct(
            F.lit(0.0).alias("start"),
            (n * 0.4).alias("end"),
            F.col("text"),
            ((F.col("conv_id") % 10) / 10.0).alias("no_speech_prob"),
        )
    )
    good = F.to_json(F.struct("text", F.lit("en").alias("language"), timed.alias("words"), segment.alias("segments")))
    bad = F.to_json(F.struct("text", F.lit("n/a").alias("words"), segment.alias("segments")))
    return B.table(spark, sf_dir, "conversations").select(
        F.concat_ws(":", "conv_id", "turn").alias("track_id"),
        F.when(F.col("conv_id") % 10 == 0, bad).otherwise(good).alias("json"),
    )


def stored_documents(spark, sf_dir):
    """Customers as stored project documents of mixed age and health."""
    c = F.col("c_custkey")
    meta = F.to_json(
        F.struct(
            F.when(c % 6 != 4, F.col("c_name")).alias("title"),
            F.col("c_mktsegment").alias("artist"),
            F.col("c_acctbal").alias("durationSec"),
            F.lit(25).alias("fps"),
            F.lit("1920x1080").alias("resolution"),
            F.when(c % 13 == 0, "3:2").otherwise("16:9").alias("aspectRatio"),
        )
    )
    version = (
        F.when(c % 6 == 1, "").when(c % 6 == 0, '"version":0,').when(c % 6 == 5, '"version":"x",').otherwise('"version":2,')
    )
    ident = F.concat(F.lit("p"), c.cast("string"))
    doc = F.concat(F.lit('{"id":"'), ident, F.lit('",'), version, F.lit('"meta":'), meta, F.lit("}"))
    return B.table(spark, sf_dir, "customer").select(
        ident.alias("id"), F.when(c % 11 == 0, "{broken").otherwise(doc).alias("json")
    )


def project_documents(spark, sf_dir):
    """Every document as a whole project: its lines as captions with words, and foreign fields."""
    i = F.col("doc_id")
    part = lambda name, value: value.alias(name)
    split = F.filter(
        F.transform(F.split(F.coalesce("text", F.lit("")), "\n"), lambda line: F.filter(F.split(line, " "), lambda w: w != "")),
        lambda words: F.size(words) > 0,
    )
    caption = lambda words, n: F.struct(
        F.array_join(words, " ").alias("text"),
        part("startSec", n * 2.0),
        part("endSec", n * 2.0 + F.size(words) * 0.25),
        F.transform(
            words,
            lambda w, k: F.struct(
                w.alias("text"), part("startSec", n * 2.0 + k * 0.25), part("endSec", n * 2.0 + k * 0.25 + 0.125)
            ),
        ).alias("words"),
    )
    meta = F.struct(
        F.concat(F.lit("Doc "), i.cast("string")).alias("title"),
        F.lit("Many").alias("artist"),
        part("durationSec", F.lit(12.5)),
        part("fps", F.lit(25)),
        F.lit("1280x720").alias("resolution"),
        F.lit("9:16").alias("aspectRatio"),
    )
    ident = F.concat(F.lit("d"), i.cast("string"))
    body = F.to_json(
        F.struct(
            meta.alias("meta"),
            F.transform(split, caption).alias("captions"),
            F.struct(F.lit(True).alias("snap"), F.struct("lang").alias("nested")).alias("settings"),
            F.col("source").alias("x_note"),
        )
    )
    ages = F.array(*map(F.lit, ["", '"version":0,', '"version":3,', '"version":"x",', '"version":2,']))
    age = F.get(ages, (i % 5).cast("int"))
    json = F.concat(F.lit('{"id":"'), ident, F.lit('",'), age, F.substring(body, 2, 2**31 - 1))
    return B.texts(spark, sf_dir, "documents", "doc_id", "text", "lang", "source").select(
        ident.alias("id"), F.when(i % 11 == 0, F.concat(F.lit("["), json)).otherwise(json).alias("json")
    )


def upgraded_documents(spark, sf_dir):
    """What became of every document, read back from its upgraded JSON."""
    new = T.doc_upgrade(project_documents(spark, sf_dir).withColumn("old", F.col("json")))
    field = lambda path, kind="string": F.try_variant_get("v", "$." + path, kind)
    return new.withColumn("v", F.parse_json("json")).select(
        "id",
        "valid",
        "changed",
        (F.col("json") == F.col("old")).alias("same_bytes"),
        field("version", "bigint").alias("version"),
        field("meta.title").alias("title"),
        field("x_note").alias("note"),
        field("settings.nested.lang").alias("lang"),
        F.size(field("captions", "array<variant>")).cast("bigint").alias("captions"),
    )


def assets(spark, sf_dir):
    def files(table, ident, text, prefix):
        i = F.col(ident)
        ext = F.element_at(F.array(*map(F.lit, [".mp3", ".wav", ".ttf", ".exe"])), (i % 4 + 1).cast("int"))
        mime = F.element_at(
            F.array(*map(F.lit, ["", "audio/mpeg", "text/plain", "video/mp4", "font/ttf"])), (i % 5 + 1).cast("int")
        )
        return B.table(spark, sf_dir, table).select(
            F.concat(F.lit(prefix), F.lpad(i.cast("string"), 12, "0")).alias("asset_id"),
            F.concat(F.lit("f"), i.cast("string"), ext).alias("name"),
            mime.alias("mime"),
            F.octet_length(text).cast("bigint").alias("size"),
            F.sha2(text, 256).alias("sha"),
        )

    return files("pages", "page_id", "html", "p").unionByName(files("documents", "doc_id", "text", "d"))


def requests(spark, sf_dir):
    return B.table(spark, sf_dir, "documents").select(
        "doc_id",
        F.sha2("text", 256).alias("sha"),
        F.when(F.col("doc_id") % 5 == 0, "m2").otherwise("m1").alias("model"),
        F.col("lang").alias("language"),
    )


#: Documents whose transcripts are stored already; those of the others are new.
STORED = "doc_id % 3 = 1"


def stored_transcripts(spark, sf_dir, which):
    return (
        B.table(spark, sf_dir, "documents")
        .filter(which)
        .select(
            F.sha2("text", 256).alias("sha"),
            F.lit("m1").alias("model"),
            F.col("lang").alias("language"),
            F.col("doc_id").alias("result_id"),
            F.col("n_chars").alias("result_chars"),
        )
    )


def job_events(spark, sf_dir):
    return B.table(spark, sf_dir, "events").select(
        F.col("user_id").alias("job_id"),
        F.col("event_type").alias("status"),
        (F.get_json_object("props", "$.k").cast("int") / 100.0).alias("progress"),
        B.micros().alias("updated_us"),
        "event_id",
    )


def upserted(spark, sf_dir):
    jobs = job_events(spark, sf_dir)
    return T.upsert_latest(
        jobs.filter("event_id % 2 = 0"), jobs.filter("event_id % 2 = 1"), ["job_id"], ["updated_us", "event_id"]
    )


def odd_jobs(spark, sf_dir):
    return B.table(spark, sf_dir, "events").filter("event_type = 'signup' and value > 150").select(
        F.col("user_id").alias("job_id")
    )


def lines_of(words):
    return words.select("track_id", "line_index").distinct()


def words_left(spark, sf_dir):
    """Line words with some lines emptied."""
    return B.line_words(spark, sf_dir).filter("line_index % 7 <> 3")


def scored_lines(spark, sf_dir):
    words = B.line_words(spark, sf_dir)
    caps = words.groupBy("track_id", "line_index").agg(
        F.round(F.avg("confidence"), 4).alias("confidence"), (F.max("event_id") % 9 == 0).alias("instrumental")
    )
    anchors = words.filter("k = 0 and event_id % 3 = 0").select(
        "track_id", "line_index", F.col("event_id").alias("anchor_id"), "confidence"
    )
    return C.line_score(caps, words_left(spark, sf_dir), anchors)


def summaries(spark, sf_dir):
    caps = B.captions(spark, sf_dir)
    dropped = caps.filter("event_id % 6 = 0").groupBy("track_id").agg(F.count(F.lit(1)).alias("dropped"))
    return C.sync_summary(caps, dropped)


QUERIES = {
    "transcript_scan": lambda s, d: T.transcript_scan(transcripts(s, d))[1],
    "transcript_segments": lambda s, d: T.transcript_scan(transcripts(s, d))[2],
    "transcript_docs": lambda s, d: T.transcript_scan(transcripts(s, d))[0],
    "doc_migrate": lambda s, d: T.doc_migrate(stored_documents(s, d)),
    "doc_upgrade": upgraded_documents,
    "doc_captions": lambda s, d: T.doc_captions(T.doc_upgrade(project_documents(s, d))).drop("item"),
    "doc_words": lambda s, d: T.doc_words(T.doc_captions(T.doc_upgrade(project_documents(s, d)))),
    "asset_manifest": lambda s, d: T.asset_manifest(assets(s, d), 20_000),
    "asset_dedup": lambda s, d: T.asset_dedup(T.asset_manifest(assets(s, d))),
    "cache_misses": lambda s, d: T.cache_misses(requests(s, d), stored_transcripts(s, d, STORED)),
    "cache_hits": lambda s, d: T.cache_hits(requests(s, d), stored_transcripts(s, d, STORED), ["result_id"]),
    "cache_put": lambda s, d: T.cache_put(
        stored_transcripts(s, d, STORED), stored_transcripts(s, d, f"not ({STORED})"), ["result_id"]
    ),
    "upsert_latest": upserted,
    "delete_keys": lambda s, d: T.delete_keys(job_events(s, d), odd_jobs(s, d), ["job_id"]),
    "point_lookup": lambda s, d: T.point_lookup(job_events(s, d), odd_jobs(s, d), ["job_id"]),
    "history_keep_n": lambda s, d: T.history_keep_n(
        job_events(s, d), ["job_id"], ["updated_us", "event_id"], 20
    ),
    "top_n_candidates": lambda s, d: T.top_n_candidates(
        B.timed_words(s, d).select("track_id", "n", "text", "confidence"),
        ["track_id", "text"],
        [F.col("confidence").desc(), F.col("n")],
        3,
    ),
    "export_timed_text": lambda s, d: T.timed_text(B.captions(s, d)),
    "job_eta": lambda s, d: T.job_eta(job_events(s, d)),
    "line_confidence": lambda s, d: C.line_confidence(lines_of(B.line_words(s, d)), words_left(s, d)),
    "line_score": scored_lines,
    "sync_summary": summaries,
    "realign_confidence": lambda s, d: C.realign_confidence(lines_of(B.line_words(s, d)), words_left(s, d)),
    "sheet_counts": lambda s, d: C.sheet_counts(S.sheet_lines(B.sheets(s, d))),
}

_TURNS = r"""
turns AS (
  SELECT conv_id || ':' || turn AS track_id, conv_id, text,
         list_filter(regexp_split_to_array(text, '[ \t\n\x0B\f\r\x{A0}]+'), lambda w: w <> '') AS w
  FROM conversations
)"""

_DOCS = """
raw AS (
  SELECT *, 'p' || CAST(c_custkey AS VARCHAR) AS id, c_custkey % 11 = 0 AS broken,
         CASE WHEN c_custkey % 6 <> 4 THEN c_name END AS title0
  FROM customer
),
judged AS (
  SELECT *, NOT broken AND c_custkey % 6 NOT IN (4, 5) AND c_acctbal >= 0 AND c_custkey % 13 <> 0 AS valid FROM raw
)"""

_PROJECTS = """
projects AS (
  SELECT 'd' || CAST(doc_id AS VARCHAR) AS id, 'Doc ' || CAST(doc_id AS VARCHAR) AS name, lang, source,
         doc_id % 11 = 0 AS broken, doc_id % 11 <> 0 AND doc_id % 5 <> 3 AS valid, doc_id % 5 AS age,
         list_filter(list_transform(string_split(coalesce(text, ''), chr(10)),
                                    lambda l: list_filter(string_split(l, ' '), lambda w: w <> '')),
                     lambda ws: len(ws) > 0) AS lines
  FROM documents
),
captions AS (
  SELECT id, unnest(lines) AS words, CAST(generate_subscripts(lines, 1) - 1 AS BIGINT) AS idx FROM projects WHERE valid
)"""

_ASSETS = """
src AS (
  SELECT page_id AS i, html AS body, 'p' AS prefix FROM pages UNION ALL SELECT doc_id, text, 'd' FROM documents
),
assets AS (
  SELECT prefix || lpad(CAST(i AS VARCHAR), 12, '0') AS asset_id,
         'f' || CAST(i AS VARCHAR) || ['.mp3', '.wav', '.ttf', '.exe'][i % 4 + 1] AS name,
         ['', 'audio/mpeg', 'text/plain', 'video/mp4', 'font/ttf'][i % 5 + 1] AS mime,
         strlen(body) AS size, sha256(body) AS sha, i
  FROM src
)"""

_CACHE = """
want AS (SELECT doc_id, sha256(text) AS sha, CASE WHEN doc_id % 5 = 0 THEN 'm2' ELSE 'm1' END AS model, lang AS language FROM documents),
stored AS (SELECT doc_id % 3 AS part, sha256(text) AS sha, 'm1' AS model, lang AS language, doc_id AS result_id, n_chars AS result_chars FROM documents)"""

_JOBS = """
jobs AS (
  SELECT user_id AS job_id, event_type AS status, CAST(json_extract_string(props, '$.k') AS INT) / 100 AS progress,
         epoch_us(ts) AS updated_us, event_id
  FROM events
),
odd AS (SELECT user_id AS job_id FROM events WHERE event_type = 'signup' AND value > 150)"""

_TC = """CASE WHEN {0} < 600000000 - 500 THEN '0' ELSE '' END || CAST(({0} + 500) // 60000000 AS VARCHAR) || ':' ||
 lpad(CAST(({0} + 500) // 1000 % 60000 // 1000 AS VARCHAR), 2, '0') || '.' || lpad(CAST(({0} + 500) // 1000 % 1000 AS VARCHAR), 3, '0')"""

ORACLE = {
    "transcript_scan": "WITH " + _TURNS + """
SELECT track_id, j - 1 AS j, word, CAST(floor((j - 1) * 0.4::DOUBLE * 1000000 + 0.5) AS BIGINT) AS start_us,
       CAST(floor(((j - 1) * 0.4::DOUBLE + 0.3::DOUBLE) * 1000000 + 0.5) AS BIGINT) AS end_us, 1.0::DOUBLE / j AS probability
FROM (SELECT track_id, unnest(w) AS word, generate_subscripts(w, 1) AS j FROM turns WHERE conv_id % 10 <> 0)""",
    "transcript_segments": "WITH " + _TURNS + """
SELECT track_id, 0::BIGINT AS k, 0::BIGINT AS start_us, CAST(floor(len(w) * 0.4::DOUBLE * 1000000 + 0.5) AS BIGINT) AS end_us,
       text, CAST(conv_id % 10 AS DOUBLE) / 10 AS no_speech_prob
FROM turns""",
    "transcript_docs": "WITH " + _TURNS + """
SELECT track_id, text, CASE WHEN conv_id % 10 <> 0 THEN 'en' END AS language,
       CASE WHEN conv_id % 10 <> 0 THEN len(w) ELSE 0 END AS words, 1::BIGINT AS segments
FROM turns""",
    "doc_migrate": "WITH " + _DOCS + """
SELECT id, CASE WHEN valid AND c_custkey % 6 IN (2, 3) THEN 2 ELSE 1 END::BIGINT AS version,
       CASE WHEN broken THEN 'Untitled' ELSE coalesce(title0, 'Untitled') END AS title,
       CASE WHEN valid THEN c_mktsegment ELSE 'Unknown Artist' END AS artist,
       CASE WHEN valid THEN c_acctbal ELSE 0 END AS duration_sec,
       CASE WHEN valid THEN 25 ELSE 30 END::DOUBLE AS fps, valid
FROM judged""",
    "doc_upgrade": "WITH " + _PROJECTS + """
SELECT id, valid, NOT valid OR age < 2 AS changed, valid AND age >= 2 AS same_bytes,
       CASE WHEN NOT valid THEN 1 ELSE [1, 1, 3, 1, 2][age + 1] END::BIGINT AS version,
       CASE WHEN broken THEN 'Untitled' ELSE name END AS title, CASE WHEN valid THEN source END AS note,
       CASE WHEN valid THEN lang END AS lang, CASE WHEN valid THEN len(lines) ELSE 0 END::BIGINT AS captions
FROM projects""",
    "doc_captions": "WITH " + _PROJECTS + """
SELECT id, idx, array_to_string(words, ' ') AS text, idx * 2000000 AS start_us, idx * 2000000 + len(words) * 250000 AS end_us
FROM captions""",
    "doc_words": "WITH " + _PROJECTS + """
SELECT id, idx, k, text, idx * 2000000 + k * 250000 AS start_us, idx * 2000000 + k * 250000 + 125000 AS end_us
FROM (SELECT id, idx, unnest(words) AS text, CAST(generate_subscripts(words, 1) - 1 AS BIGINT) AS k FROM captions)""",
    "asset_manifest": "WITH " + _ASSETS + """,
judged AS (
  SELECT *, CASE WHEN size > 20000 THEN 'oversized_upload'
                 WHEN mime IN ('text/plain', 'video/mp4') AND i % 4 = 3 THEN 'unsupported_codec' END AS reason
  FROM assets
)
SELECT asset_id, name, mime, size, sha, name[-4:] AS ext, reason, reason IS NULL AS accepted FROM judged""",
    "asset_dedup": "WITH " + _ASSETS + """
SELECT sha, min(asset_id) AS keep_id, count(*) AS copies, CAST(sum(size) AS BIGINT) AS bytes FROM assets GROUP BY sha""",
    "cache_misses": "WITH " + _CACHE + """
SELECT * FROM want w WHERE NOT EXISTS (
  SELECT 1 FROM stored s WHERE s.part = 1 AND s.sha = w.sha AND s.model = w.model AND s.language = w.language)""",
    "cache_hits": "WITH " + _CACHE + """,
first AS (SELECT sha, model, language, min(result_id) AS result_id, arg_min(result_chars, result_id) AS result_chars
          FROM stored WHERE part = 1 GROUP BY sha, model, language)
SELECT * FROM want JOIN first USING (sha, model, language)""",
    "cache_put": "WITH " + _CACHE + """
SELECT sha, model, language, arg_min(result_id, part * 1000000000 + result_id) AS result_id,
       arg_min(result_chars, part * 1000000000 + result_id) AS result_chars
FROM (SELECT * REPLACE (CASE WHEN part = 1 THEN 1 ELSE 2 END AS part) FROM stored) GROUP BY sha, model, language""",
    "upsert_latest": "WITH " + _JOBS + """
SELECT job_id, status, progress, updated_us, event_id FROM jobs
QUALIFY row_number() OVER (PARTITION BY job_id ORDER BY updated_us DESC, event_id DESC) = 1""",
    "delete_keys": "WITH " + _JOBS + " SELECT * FROM jobs WHERE job_id NOT IN (SELECT job_id FROM odd)",
    "point_lookup": "WITH " + _JOBS + " SELECT * FROM jobs WHERE job_id IN (SELECT job_id FROM odd)",
    "history_keep_n": "WITH " + _JOBS + """
SELECT *, row_number() OVER (PARTITION BY job_id ORDER BY updated_us DESC, event_id DESC) AS age FROM jobs
QUALIFY age <= 20""",
    "top_n_candidates": "WITH " + LINE_WORDS + """
SELECT track_id, n, text, confidence, row_number() OVER (PARTITION BY track_id, text ORDER BY confidence DESC, n) AS rank
FROM timed_words QUALIFY rank <= 3""",
    "export_timed_text": "WITH " + CAPTIONS + "SELECT track_id, start_us, idx, '[' || " + _TC.format("start_us")
    + " || ' --> ' || " + _TC.format("end_us") + " || '] ' || text AS line FROM captions",
    "job_eta": "WITH " + _JOBS + """,
l AS (
  SELECT job_id, arg_max(status, updated_us) AS status, arg_max(progress, updated_us) AS progress,
         max(updated_us) - min(updated_us) AS elapsed_us
  FROM jobs GROUP BY job_id
)
SELECT *, CASE WHEN progress > 0.05 THEN CAST(floor(elapsed_us * (1 - progress) / progress + 0.5) AS BIGINT) END AS eta_us FROM l""",
    "line_confidence": "WITH " + LINE_WORDS + """,
s AS (SELECT track_id, line_index, avg(matched::INT) AS m, avg(confidence) AS c FROM line_words WHERE line_index % 7 <> 3 GROUP BY 1, 2)
SELECT track_id, line_index, round(CASE WHEN m IS NULL THEN 0.2 ELSE greatest(0, least(1, 0.55 * m + 0.45 * c)) END, 6) AS confidence
FROM (SELECT DISTINCT track_id, line_index FROM line_words) LEFT JOIN s USING (track_id, line_index)""",
    "line_score": "WITH " + LINE_WORDS + """,
caps AS (SELECT track_id, line_index, round(avg(confidence), 4) AS c, max(event_id) % 9 = 0 AS instrumental FROM line_words GROUP BY 1, 2),
w AS (SELECT track_id, line_index, avg((confidence >= 0.45)::INT) AS dense, avg((confidence < 0.3)::INT) AS gaps
      FROM line_words WHERE line_index % 7 <> 3 GROUP BY 1, 2),
a AS (SELECT track_id, line_index, arg_min(confidence, event_id) AS anchor FROM line_words WHERE k = 0 AND event_id % 3 = 0 GROUP BY 1, 2)
SELECT track_id, line_index,
       round(CASE WHEN instrumental THEN 1 WHEN dense IS NULL THEN 0.2
                  ELSE greatest(0, least(1, 0.45 * dense + 0.2 * (1 - gaps) + 0.2 * coalesce(anchor, 0.5) + 0.15 * c)) END, 6)::DOUBLE AS score
FROM caps LEFT JOIN w USING (track_id, line_index) LEFT JOIN a USING (track_id, line_index)""",
    "sync_summary": "WITH " + CAPTIONS + """
SELECT track_id, count(*) FILTER (WHERE NOT instrumental AND confidence < 0.6) AS flagged,
       round(coalesce(avg(confidence) FILTER (WHERE NOT instrumental), 0), 6) AS mean_confidence,
       count(*) FILTER (WHERE event_id % 6 = 0) AS dropped
FROM captions GROUP BY track_id""",
    "realign_confidence": "WITH " + LINE_WORDS + """,
s AS (SELECT track_id, line_index, avg(confidence) AS c FROM line_words WHERE line_index % 7 <> 3 GROUP BY 1, 2)
SELECT track_id, line_index, round(coalesce(c, 0.5), 6) AS confidence
FROM (SELECT DISTINCT track_id, line_index FROM line_words) LEFT JOIN s USING (track_id, line_index)""",
    "sheet_counts": "WITH lines AS (" + TEXT_ORACLE["sheet_lines"] + """)
SELECT doc_id, count(*) FILTER (WHERE NOT instrumental) AS vocal, count(*) FILTER (WHERE instrumental) AS instrumental,
       greatest(30000000, count(*) FILTER (WHERE NOT instrumental) * 3800000) AS estimated_us
FROM lines GROUP BY doc_id""",
}
