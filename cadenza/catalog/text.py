"""Sheet, vocabulary and display queries and their oracles."""

from pyspark.sql import functions as F

from cadenza.catalog.base_sql import CAPTIONS, SHEETS, TIMED_WORDS
from cadenza.catalog.text_sql import WS, phonetic_sql, split_words, syllables_sql, vocab_ctes
from cadenza.functions.timecode import idiv
from cadenza.operators import text as X
from cadenza.sources import sheets as S
from cadenza.sources import testbed as B


def timecodes(spark, sf_dir):
    """Stored times, and time codes typed by hand in several forms."""
    k = (F.col("event_id") % 7).cast("int")
    sample = (
        F.when(k == 0, F.concat((F.col("event_id") % 90).cast("string"), F.lit(":02.5")))
        .when(k == 1, (F.col("event_id") % 600).cast("string"))
        .when(k == 2, F.concat(F.lit("-0:03."), (F.col("event_id") % 100).cast("string")))
        .when(k == 3, "1:2:3")
        .when(k == 4, F.lit(" 00:59.999 "))
        .when(k == 5, F.lit("abc"))
        .otherwise("12.")
    )
    words = B.timed_words(spark, sf_dir).select(
        "event_id", (F.col("start_us") - 5_000_000 + F.col("event_id") % 997).alias("at_us"), sample.alias("typed")
    )
    return X.timecode_cols(words, "at_us", "typed")


def settings(spark, sf_dir):
    c = F.col("c_custkey")
    given = c % 4 != 0
    return B.table(spark, sf_dir, "customer").select(
        c.alias("track_id"),
        F.when(given, (c * 37 % 5001 - 2500) * 1000).alias("offset_us"),
        F.when(given, (c * 13 % 801 - 400) * 1000).alias("lead_us"),
    )


def spaced_captions(spark, sf_dir):
    """Captions with longer text, so that lines wrap and overflow."""
    n = (F.col("event_id") % 5 + 1).cast("int")
    return B.captions(spark, sf_dir).select(
        "track_id", "idx", F.array_join(F.array_repeat("text", n), " ").alias("text")
    )


QUERIES = {
    "sheet_lines": lambda s, d: S.sheet_lines(B.sheets(s, d)),
    "sheet_headers": lambda s, d: S.sheet_headers(B.sheets(s, d)),
    "token_dim": lambda s, d: X.token_dim(X.raw_tokens(B.texts(s, d, "documents", "text"))),
    "timecode_cols": timecodes,
    "frame_grid_cols": lambda s, d: X.frame_grid_cols(
        B.timed_words(s, d).select("track_id", "n", "start_us"), "start_us", 30
    ),
    "caption_lines": lambda s, d: X.caption_lines(spaced_captions(s, d)),
    "caption_lines_cased": lambda s, d: X.caption_lines(B.captions(s, d), 12, 3, "capitalize"),
    "sync_offset": lambda s, d: X.sync_offset(
        B.timed_words(s, d).select("track_id", "n", "start_us", "end_us"), settings(s, d)
    ),
    "confidence_tier": lambda s, d: X.confidence_tier(B.timed_words(s, d), B.captions(s, d)),
    "instrumental_flag": lambda s, d: X.instrumental_flag(
        B.captions(s, d).select("track_id", "idx", "start_us", "end_us", "text", "instrumental")
    ),
    "natural_sort": lambda s, d: X.natural_sort(
        B.table(s, d, "pages").select("page_id", "url"), "url"
    ),
}

_LINES = SHEETS + """,
cut AS (
  SELECT doc_id, unnest(p) AS line, generate_subscripts(p, 1) AS pos
  FROM (SELECT doc_id, string_split(replace(text, chr(13) || chr(10), chr(10)), chr(10)) AS p FROM sheets)
),
kinds AS (
  SELECT *, regexp_matches(line, '""" + S.SECTION + """') AS is_section, regexp_matches(line, '""" + S.HEADER + """') AS is_header
  FROM cut
)"""

_WRAP = """
cut AS (
  SELECT track_id, idx, unnest(w) AS word, generate_subscripts(w, 1) AS pos FROM (SELECT track_id, idx, w FROM src)
),
walk AS (
  SELECT track_id, idx, pos, 0 AS line_no, word AS line, length(word) AS used, false AS stop FROM cut WHERE pos = 1
  UNION ALL
  SELECT track_id, idx, pos, line_no + CASE WHEN brk AND NOT ovf THEN 1 ELSE 0 END,
         CASE WHEN ovf THEN line || '…' WHEN brk THEN word ELSE line || ' ' || word END,
         CASE WHEN brk THEN length(word) ELSE used + 1 + length(word) END, ovf
  FROM (SELECT c.*, w.line_no, w.line, w.used, used + 1 + length(c.word) > {chars} AS brk,
               used + 1 + length(c.word) > {chars} AND line_no + 1 >= {lines} AS ovf
        FROM walk w JOIN cut c ON c.track_id = w.track_id AND c.idx = w.idx AND c.pos = w.pos + 1
        WHERE NOT w.stop)
)
SELECT track_id, idx, CAST(line_no AS BIGINT) AS line_no, arg_max(line, pos) AS text
FROM walk GROUP BY track_id, idx, line_no"""

_TC = """regexp_extract(trim(typed, ' '), '^(-?)(?:([0-9]+):)?([0-9]+)(?:\\.([0-9]{1,3}))?$', %d)"""

ORACLE = {
    "sheet_lines": "WITH " + _LINES + f""",
labelled AS (
  SELECT doc_id, pos, is_section OR is_header AS gone,
         regexp_replace(regexp_replace(line, '{S.STAMP}', ''), '^{WS}+|{WS}+$', '', 'g') AS text,
         last_value(CASE WHEN is_section THEN regexp_replace(regexp_extract(line, '{S.SECTION}', 1), '^{WS}+|{WS}+$', '', 'g') END
           IGNORE NULLS) OVER (PARTITION BY doc_id ORDER BY pos) AS section
  FROM kinds
),
bounds AS (SELECT doc_id, min(pos) AS lo, max(pos) AS hi FROM labelled WHERE NOT gone AND text <> '' GROUP BY doc_id)
SELECT doc_id, row_number() OVER (PARTITION BY doc_id ORDER BY pos) - 1 AS idx, text, section, text = '' AS instrumental
FROM labelled JOIN bounds USING (doc_id) WHERE NOT gone AND pos BETWEEN lo AND hi""",
    "sheet_headers": "WITH " + _LINES + f""",
heads AS (
  SELECT doc_id, pos, lower(regexp_extract(line, '{S.HEADER}', 1)) AS kind,
         regexp_replace(regexp_extract(line, '{S.HEADER}', 2), '^{WS}+|{WS}+$', '', 'g') AS value
  FROM kinds WHERE is_header
)
SELECT d.doc_id, arg_max(value, pos) FILTER (WHERE kind = 'title') AS title,
       arg_max(value, pos) FILTER (WHERE kind = 'artist') AS artist
FROM documents d LEFT JOIN heads USING (doc_id) GROUP BY d.doc_id""",
    "token_dim": "WITH tokens AS (SELECT unnest(" + split_words("text") + ") AS raw FROM documents),\n"
    "freqs AS MATERIALIZED (SELECT raw, count(*) AS freq FROM tokens GROUP BY raw),"
    + vocab_ctes("SELECT raw FROM freqs") + f""",
forms AS MATERIALIZED (SELECT DISTINCT norm FROM vocab),
sounds AS MATERIALIZED (SELECT norm, {phonetic_sql('norm')} AS phonetic, {syllables_sql('norm')} AS syllables FROM forms)
SELECT raw, freq, part, norm, phonetic, syllables FROM vocab JOIN freqs USING (raw) JOIN sounds USING (norm)""",
    "timecode_cols": "WITH " + TIMED_WORDS + """,
s AS (
  SELECT event_id, start_us - 5000000 + event_id % 997 AS at_us,
         CASE event_id % 7 WHEN 0 THEN CAST(event_id % 90 AS VARCHAR) || ':02.5'
              WHEN 1 THEN CAST(event_id % 600 AS VARCHAR)
              WHEN 2 THEN '-0:03.' || CAST(event_id % 100 AS VARCHAR)
              WHEN 3 THEN '1:2:3' WHEN 4 THEN ' 00:59.999 ' WHEN 5 THEN 'abc' ELSE '12.' END AS typed
  FROM timed_words
),
ms AS (SELECT *, (abs(at_us) + 500) // 1000 AS ms FROM s)
SELECT event_id, at_us, typed,
       CASE WHEN at_us < 0 THEN '-' ELSE '' END || CASE WHEN ms < 600000 THEN '0' ELSE '' END || CAST(ms // 60000 AS VARCHAR)
         || ':' || lpad(CAST(ms % 60000 // 1000 AS VARCHAR), 2, '0') || '.' || lpad(CAST(ms % 1000 AS VARCHAR), 3, '0') AS timecode,
       CASE WHEN regexp_matches(trim(typed, ' '), '^-?([0-9]+:)?[0-9]+(\\.[0-9]{1,3})?$') THEN
         (CASE WHEN """ + _TC % 1 + """ = '-' THEN -1 ELSE 1 END) *
         ((coalesce(TRY_CAST(""" + _TC % 2 + """ AS BIGINT), 0) * 60 + CAST(""" + _TC % 3 + """ AS BIGINT)) * 1000000
          + CAST(rpad(""" + _TC % 4 + """, 3, '0') AS BIGINT) * 1000) END AS parsed_us
FROM ms""",
    "frame_grid_cols": "WITH " + TIMED_WORDS + """,
f AS (SELECT track_id, n, start_us, CAST(floor(CAST(start_us * 30 AS DOUBLE) / 1000000 + 0.5) AS BIGINT) AS frame FROM timed_words)
SELECT *, CAST(floor(CAST(frame * 1000000 AS DOUBLE) / 30 + 0.5) AS BIGINT) AS frame_us FROM f""",
    "caption_lines": "WITH RECURSIVE " + CAPTIONS + ", src AS (SELECT track_id, idx, "
    + split_words("repeat(text || ' ', event_id % 5 + 1)") + " AS w FROM captions),"
    + _WRAP.format(chars=32, lines=2),
    "caption_lines_cased": "WITH RECURSIVE " + CAPTIONS + """,
src AS (
  SELECT track_id, idx, list_filter(string_split(array_to_string(list_transform(
           regexp_extract_all(text, '[A-Za-z0-9_]+|[^A-Za-z0-9_]+'), lambda r: upper(r[1]) || r[2:]), ''), ' '), lambda w: w <> '') AS w
  FROM captions
),""" + _WRAP.format(chars=12, lines=3),
    "sync_offset": "WITH " + TIMED_WORDS + """,
sh AS (
  SELECT c_custkey AS track_id,
         greatest(-300000, least(300000, CASE WHEN c_custkey % 4 <> 0 THEN (c_custkey * 13 % 801 - 400) * 1000 ELSE -40000 END))
         - greatest(-2000000, least(2000000, CASE WHEN c_custkey % 4 <> 0 THEN (c_custkey * 37 % 5001 - 2500) * 1000 ELSE 0 END)) AS shift
  FROM customer
)
SELECT track_id, n, greatest(0, start_us + coalesce(shift, -40000)) AS start_us, greatest(0, end_us + coalesce(shift, -40000)) AS end_us
FROM timed_words LEFT JOIN sh USING (track_id)""",
    "confidence_tier": "WITH " + CAPTIONS + """,
t AS (
  SELECT 'word' AS kind, CASE WHEN confidence >= 0.85 THEN 'high' WHEN confidence >= 0.6 THEN 'mid' ELSE 'low' END AS tier FROM timed_words
  UNION ALL
  SELECT 'caption', CASE WHEN instrumental OR text = '' OR trim(text) = '♪' THEN 'music' WHEN confidence < 0.35 THEN 'weak'
                         WHEN confidence < 0.6 THEN 'low' ELSE 'ok' END FROM captions
)
SELECT kind, tier, count(*) AS n FROM t GROUP BY kind, tier""",
    "instrumental_flag": "WITH " + CAPTIONS + """,
f AS (SELECT *, instrumental OR text = '' OR trim(text) = '♪' OR contains(lower(text), 'instrumental') AS music FROM captions)
SELECT track_id, idx, start_us, end_us, text, instrumental, music FROM f WHERE NOT music OR end_us - start_us > 3000000""",
    "natural_sort": """
WITH runs AS (
  SELECT page_id, url, unnest(p) AS r, generate_subscripts(p, 1) AS pos
  FROM (SELECT page_id, url, regexp_extract_all(lower(url), '[0-9]+|[^0-9]+') AS p FROM pages)
)
SELECT page_id, url, string_agg(CASE WHEN regexp_matches(r, '^[0-9]') THEN lpad(regexp_replace(r, '^0+([0-9])', '\\1'), 20, '0') ELSE r END,
                                '' ORDER BY pos) AS sort_key
FROM runs GROUP BY page_id, url""",
}
