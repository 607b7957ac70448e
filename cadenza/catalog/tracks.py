"""Ordered-track queries and their oracles."""

from pyspark.sql import functions as F

from cadenza.catalog.base_sql import CAPTIONS, DURATIONS, LINE_WORDS, TIMED_WORDS
from cadenza.catalog.text_sql import split_words, syllables_sql, vocab_ctes
from cadenza.functions.timecode import idiv
from cadenza.operators import tracks as T
from cadenza.sources import testbed as B


def jittered(spark, sf_dir):
    """Words whose starts were shifted by up to 18 s, so that some run backwards."""
    shift = ((F.col("event_id") * 7919) % 13 - 6) * 3_000_000
    start = F.greatest(F.lit(0), F.col("start_us") + shift)
    return B.timed_words(spark, sf_dir).select(
        "track_id",
        F.col("n").alias("i"),
        start.alias("start_us"),
        (start + F.col("end_us") - F.col("start_us")).alias("end_us"),
    )


JITTERED = TIMED_WORDS + """,
jittered AS (
  SELECT track_id, n AS i, greatest(0, start_us + ((event_id * 7919) % 13 - 6) * 3000000) AS start_us,
         greatest(0, start_us + ((event_id * 7919) % 13 - 6) * 3000000) + end_us - start_us AS end_us
  FROM timed_words
)"""


def open_tokens(spark, sf_dir):
    """Tokens of which about half carry no time."""
    timed = F.col("confidence") >= 0.5
    return B.timed_words(spark, sf_dir).select(
        "track_id",
        F.col("n").alias("i"),
        (F.col("event_id") % 4 + 1).alias("weight"),
        F.when(timed, F.col("start_us")).alias("start_us"),
        F.when(timed, F.col("end_us")).alias("end_us"),
        "confidence",
    )


def fragments(spark, sf_dir):
    """Line words where every third event is the second part of a contraction."""
    return B.line_words(spark, sf_dir).withColumn(
        "text", F.when(F.col("event_id") % 3 == 0, "").otherwise(F.col("text"))
    )


def sheet_rows(spark, sf_dir):
    return B.captions(spark, sf_dir).select("track_id", "idx", "text", "instrumental")


def document_lines(spark, sf_dir):
    """Lines of the documents, split inside the row."""
    return B.texts(spark, sf_dir, "documents", "doc_id", "text").select(
        "doc_id", F.posexplode(F.split("text", "\n")).alias("idx", "text")
    ).filter(F.trim("text") != "").withColumn("idx", F.col("idx").cast("bigint"))


def layout(spark, sf_dir):
    return T.proportional_layout(sheet_rows(spark, sf_dir), B.durations(spark, sf_dir))


def rescaled(spark, sf_dir):
    caps = B.captions(spark, sf_dir)
    new = caps.select(
        "track_id",
        "idx",
        (F.col("start_us") + F.col("event_id") % 5 * 100_000).alias("start_us"),
        (F.col("end_us") + F.col("event_id") % 7 * 100_000 + 500_000).alias("end_us"),
    )
    return T.words_rescale(T.caption_words_even(caps), caps, new)


def heard_words(spark, sf_dir):
    """Transcript times for every third word of a caption, some outside its window."""
    return T.caption_words_even(B.captions(spark, sf_dir)).filter((F.col("idx") + F.col("k")) % 3 == 0).select(
        "track_id",
        "idx",
        "k",
        (F.col("start_us") + (F.col("idx") % 9) * 50_000).alias("heard_start_us"),
        (F.col("start_us") + (F.col("idx") % 9) * 50_000 + 300_000).alias("heard_end_us"),
    )


def retimed(spark, sf_dir):
    caps = B.captions(spark, sf_dir).select(
        "track_id", "idx", F.col("start_us").alias("cap_start_us"), F.col("end_us").alias("cap_end_us")
    )
    words = T.caption_words_even(B.captions(spark, sf_dir)).join(caps, ["track_id", "idx"])
    edits = words.filter((F.col("idx") + F.col("k")) % 4 == 0).select(
        "track_id",
        "idx",
        "k",
        (F.col("start_us") - 70_000).alias("new_start_us"),
        (F.col("end_us") - 90_000).alias("new_end_us"),
    )
    return T.word_retime(words, edits)


def realigned(spark, sf_dir):
    from cadenza.catalog.joins import line_onsets

    lines = B.captions(spark, sf_dir).select("track_id", "idx", "text", "start_us", "end_us")
    return T.line_realign(lines, heard_words(spark, sf_dir), line_onsets(spark, sf_dir))


def late_captions(spark, sf_dir):
    """Captions of which every second track begins five seconds late."""
    shift = F.col("track_id") % 2 * 5_000_000
    return B.captions(spark, sf_dir).withColumns({c: F.col(c) + shift for c in ("start_us", "end_us")})


QUERIES = {
    "monotone_reject": lambda s, d: T.monotone_reject(jittered(s, d)),
    "gap_interpolate": lambda s, d: T.gap_interpolate(open_tokens(s, d), B.durations(s, d)),
    "monotone_sweep": lambda s, d: T.monotone_sweep(jittered(s, d)),
    "fragment_merge": lambda s, d: T.fragment_merge(fragments(s, d)),
    "line_envelope": lambda s, d: T.line_envelope(B.line_words(s, d), B.durations(s, d)),
    "overlap_trim": lambda s, d: T.overlap_trim(
        B.captions(s, d).select("track_id", "idx", "start_us", "end_us")
    ),
    "gap_markers": lambda s, d: T.gap_markers(T.overlap_trim(B.captions(s, d))),
    "gap_markers_intro": lambda s, d: T.gap_markers(
        T.overlap_trim(late_captions(s, d)), intro=True
    ),
    "proportional_layout": layout,
    "proportional_words": lambda s, d: T.proportional_words(layout(s, d)),
    "prompt_window": lambda s, d: T.prompt_window(document_lines(s, d), 3, 40),
    "caption_words_even": lambda s, d: T.caption_words_even(B.captions(s, d)),
    "words_rescale": rescaled,
    "word_retime": retimed,
    "line_distribute": lambda s, d: T.line_distribute(
        B.captions(s, d).select("track_id", "idx", "text", "start_us", "end_us"), heard_words(s, d)
    ),
    "line_realign": lambda s, d: realigned(s, d)[0],
    "line_realign_scores": lambda s, d: realigned(s, d)[2],
    "caption_order": lambda s, d: T.caption_order(
        jittered(s, d).withColumnRenamed("i", "idx")
    ),
}

_TRIM = """
linked AS (SELECT *, lead(start_us) OVER (PARTITION BY track_id ORDER BY start_us, idx) AS nxt FROM {src}),
trimmed AS (
  SELECT track_id, idx, start_us,
         CASE WHEN end_us > nxt - 40000 THEN greatest(start_us + 300000, nxt - 40000) ELSE end_us END AS end_us,
         text, instrumental, confidence
  FROM linked
)"""

_MARK = """
gaps AS (
  SELECT *, coalesce(lag(end_us) OVER (PARTITION BY track_id ORDER BY start_us, idx), {opening}) AS prev_end FROM trimmed
),
merged AS (
  SELECT track_id, start_us, end_us, text, instrumental, confidence, idx AS tie, 1 AS side FROM gaps
  UNION ALL
  SELECT track_id, prev_end, start_us, '♪', true, 1.0, idx, 0 FROM gaps WHERE start_us - prev_end > 3500000
)
SELECT track_id, row_number() OVER (PARTITION BY track_id
         ORDER BY CASE WHEN side = 0 THEN end_us ELSE start_us END, tie, side) - 1 AS idx,
       start_us, end_us, text, instrumental, confidence
FROM merged"""

_EVEN = """
sung AS (
  SELECT track_id, idx, start_us, end_us, pos - 1 AS pos, raw
  FROM (SELECT track_id, idx, start_us, end_us, unnest(w) AS raw, generate_subscripts(w, 1) AS pos
        FROM (SELECT *, """ + split_words("text") + """ AS w FROM captions))
),
even0 AS (
  SELECT track_id, idx, raw AS text, start_us, end_us,
         row_number() OVER (PARTITION BY track_id, idx ORDER BY pos, part) - 1 AS k,
         count(*) OVER (PARTITION BY track_id, idx) AS n
  FROM sung JOIN vocab USING (raw)
),
even_words AS (
  SELECT track_id, idx, k, text, start_us + greatest(40000, end_us - start_us) * k // n AS start_us,
         start_us + greatest(40000, end_us - start_us) * (k + 1) // n AS end_us, 0.8::DOUBLE AS confidence
  FROM even0
)"""

_CAPTION_VOCAB = vocab_ctes(f"SELECT unnest({split_words('text')}) AS raw FROM captions")
EVEN_WORDS = CAPTIONS + "," + _CAPTION_VOCAB + "," + _EVEN

_LAYOUT = CAPTIONS + DURATIONS + """,
sung_lines AS (
  SELECT track_id, idx, text, """ + syllables_sql("regexp_replace(text, '\\s', '', 'g')") + """ AS w
  FROM captions WHERE NOT instrumental
),
placed AS (
  SELECT track_id, text, w, row_number() OVER (PARTITION BY track_id ORDER BY idx) - 1 AS ord,
         coalesce(sum(w) OVER (PARTITION BY track_id ORDER BY idx ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS before,
         sum(w) OVER (PARTITION BY track_id) AS total
  FROM sung_lines
),
layout0 AS (
  SELECT *, least(2400000, duration_us * 6 // 100) AS lead_us,
         greatest(1000000, duration_us - least(2400000, duration_us * 6 // 100) - least(2800000, duration_us * 8 // 100)) AS usable
  FROM placed JOIN durations USING (track_id)
),
layout AS (
  SELECT track_id, ord AS "order", text, CAST(lead_us + usable * before // total AS BIGINT) AS start_us,
         CAST(lead_us + usable * before // total + greatest(usable * w * 82 // (total * 100), 700000) AS BIGINT) AS end_us,
         0.4::DOUBLE AS confidence
  FROM layout0
)"""

_DISTRIBUTE = EVEN_WORDS + """,
first_part AS (SELECT raw, norm FROM vocab WHERE part = 0),
dw AS (
  SELECT track_id, idx, pos AS k, raw, start_us AS lo, end_us AS hi,
         greatest(100, """ + syllables_sql("coalesce(norm, lower(raw))") + """ * 120 + least(300, length(coalesce(norm, lower(raw))) * 15)) AS w
  FROM sung LEFT JOIN first_part USING (raw)
),
hw AS (
  SELECT track_id, idx, k, start_us + idx % 9 * 50000 AS hs, start_us + idx % 9 * 50000 + 300000 AS he
  FROM even_words WHERE (idx + k) % 3 = 0
),
dj AS (
  SELECT dw.*, hs, he, coalesce(hs >= lo - 200000 AND he <= hi + 200000, false) AS heard,
         greatest(80000, w * greatest(200000, hi - lo) // sum(w) OVER (PARTITION BY dw.track_id, dw.idx)) AS nat
  FROM dw LEFT JOIN hw USING (track_id, idx, k)
),
place AS (
  SELECT track_id, idx, k, s, e, greatest(lo + 40000, e) AS cur
  FROM (SELECT *, CASE WHEN heard THEN greatest(lo, hs) ELSE lo END AS s,
               CASE WHEN heard THEN least(hi, greatest(greatest(lo, hs) + 80000, he)) ELSE least(hi, lo + nat) END AS e
        FROM dj WHERE k = 0)
  UNION ALL
  SELECT track_id, idx, k, s, e, greatest(cur + 40000, e)
  FROM (SELECT d.track_id, d.idx, d.k, p.cur, CASE WHEN heard THEN greatest(lo, hs) ELSE p.cur END AS s,
               CASE WHEN heard THEN least(hi, greatest(greatest(lo, hs) + 80000, he)) ELSE least(hi, p.cur + nat) END AS e
        FROM place p JOIN dj d ON d.track_id = p.track_id AND d.idx = p.idx AND d.k = p.k + 1)
),
pl AS (SELECT p.track_id, p.idx, p.k, p.s, p.e, d.raw, d.lo, d.hi, d.heard FROM place p JOIN dj d USING (track_id, idx, k)),
smooth AS (
  SELECT track_id, idx, k, s, s AS ns, CASE WHEN e - s < 80000 THEN least(hi, s + 80000) ELSE e END AS ne FROM pl WHERE k = 0
  UNION ALL
  SELECT track_id, idx, k, s, ns, CASE WHEN e - ns < 80000 THEN least(hi, ns + 80000) ELSE e END
  FROM (SELECT p.track_id, p.idx, p.k, p.s, p.e, p.hi, CASE WHEN p.s < m.ne THEN (m.ne + p.s) // 2 ELSE p.s END AS ns
        FROM smooth m JOIN pl p ON p.track_id = m.track_id AND p.idx = m.idx AND p.k = m.k + 1)
),
distributed AS (
  SELECT track_id, idx, k, raw AS text, ns AS start_us,
         CAST(CASE WHEN lead(s) OVER q < ne THEN (ne + lead(s) OVER q) // 2 ELSE ne END AS BIGINT) AS end_us,
         CASE WHEN heard THEN 0.85 ELSE 0.45 END::DOUBLE AS confidence, lo, hi
  FROM smooth JOIN (SELECT track_id, idx, k, raw, lo, hi, heard FROM pl) USING (track_id, idx, k)
  WINDOW q AS (PARTITION BY track_id, idx ORDER BY k)
)"""

_REALIGN = _DISTRIBUTE + """,
o AS (
  SELECT DISTINCT track_id, greatest(0, start_us + ((event_id * 31) % 401 - 200) * 1000) AS tick FROM timed_words
),
best AS (
  SELECT w.track_id, w.idx, w.k, arg_min(tick, abs(tick - w.start_us) * 10 + CASE WHEN tick > w.start_us THEN 1 ELSE 0 END) AS b
  FROM distributed w JOIN o ON o.track_id = w.track_id AND tick BETWEEN w.start_us - 120000 AND w.start_us + 120000 GROUP BY 1, 2, 3
),
t AS (SELECT w.*, b, greatest(lo, least(greatest(lo, hi - 60000), b)) AS s FROM distributed w LEFT JOIN best USING (track_id, idx, k)),
realigned AS (
  SELECT track_id, idx, k, text, CASE WHEN b IS NULL THEN start_us ELSE s END AS start_us,
         CASE WHEN b IS NOT NULL AND abs(s - start_us) > 20000
              THEN greatest(s + 60000, least(s + greatest(60000, end_us - start_us), hi)) ELSE end_us END AS end_us,
         round(CASE WHEN b IS NULL THEN confidence WHEN abs(s - start_us) > 80000 THEN greatest(0.2, confidence - 0.15)
                    ELSE least(1.0, confidence + 0.1) END, 6) AS confidence,
         b IS NOT NULL AS snapped
  FROM t
)"""

ORACLE = {
    "line_distribute": "WITH RECURSIVE " + _DISTRIBUTE
    + " SELECT track_id, idx, k, text, start_us, end_us, confidence FROM distributed",
    "line_realign": "WITH RECURSIVE " + _REALIGN + " SELECT * FROM realigned",
    "line_realign_scores": "WITH RECURSIVE " + _REALIGN + """
SELECT track_id, idx AS line_index, round(coalesce(avg(r.confidence), 0.5), 6) AS confidence
FROM captions c LEFT JOIN realigned r USING (track_id, idx) GROUP BY track_id, idx""",
    "monotone_reject": "WITH RECURSIVE " + JITTERED + """,
walk AS (
  SELECT track_id, i, start_us, start_us AS bar, true AS accepted FROM jittered WHERE i = 0
  UNION ALL
  SELECT j.track_id, j.i, j.start_us, CASE WHEN j.start_us >= bar - 20000 THEN j.start_us ELSE bar END,
         j.start_us >= bar - 20000
  FROM walk w JOIN jittered j ON j.track_id = w.track_id AND j.i = w.i + 1
)
SELECT track_id, i, start_us, accepted FROM walk""",
    "monotone_sweep": "WITH RECURSIVE " + JITTERED + """,
walk AS (
  SELECT track_id, i, start_us AS raw, start_us, greatest(end_us, start_us + 80000) AS end_us FROM jittered WHERE i = 0
  UNION ALL
  SELECT track_id, i, raw, greatest(s, floor_us),
         CASE WHEN floor_us > s THEN greatest(e, s + 80000, floor_us + 80000) ELSE greatest(e, s + 80000) END
  FROM (SELECT j.track_id, j.i, j.start_us AS raw, j.end_us AS e, w.start_us + 20000 AS floor_us,
               CASE WHEN j.start_us < w.end_us THEN (w.end_us + j.start_us) // 2 ELSE j.start_us END AS s
        FROM walk w JOIN jittered j ON j.track_id = w.track_id AND j.i = w.i + 1)
)
SELECT track_id, i, start_us,
       CASE WHEN nxt < end_us THEN (end_us + nxt) // 2 ELSE end_us END AS end_us
FROM (SELECT *, lead(raw) OVER (PARTITION BY track_id ORDER BY i) AS nxt FROM walk)""",
    "gap_interpolate": "WITH " + TIMED_WORDS + DURATIONS + """,
tok AS (
  SELECT track_id, n AS i, event_id % 4 + 1 AS weight, confidence, confidence >= 0.5 AS matched,
         CASE WHEN confidence >= 0.5 THEN start_us END AS s, CASE WHEN confidence >= 0.5 THEN end_us END AS e
  FROM timed_words
),
runs AS (
  SELECT *, count(s) OVER w AS run,
         last_value(e IGNORE NULLS) OVER w AS left_us,
         first_value(s IGNORE NULLS) OVER (PARTITION BY track_id ORDER BY i ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING) AS right_us
  FROM tok WINDOW w AS (PARTITION BY track_id ORDER BY i ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW)
),
sized AS (
  SELECT *, sum(weight) OVER (PARTITION BY track_id, run) AS total, count(*) OVER (PARTITION BY track_id, run) AS n,
         sum(weight) OVER (PARTITION BY track_id, run ORDER BY i) - weight AS off
  FROM runs WHERE s IS NULL
),
room AS (
  SELECT *, coalesce(left_us, 0) AS l, greatest(200000, coalesce(right_us, duration_us) - coalesce(left_us, 0)) AS avail,
         total * 280000 AS nat, n * 80000 AS flr
  FROM sized JOIN durations USING (track_id)
),
block AS (
  SELECT *, CASE WHEN avail * 10 > nat * 22 THEN l + (avail - nat) * 35 // 100 ELSE l + 80000 END AS b,
         greatest(40000, flr, CASE WHEN avail * 10 > nat * 22 THEN nat
              WHEN least(avail - 100000, greatest(nat, flr)) < nat THEN greatest(flr, avail - 100000)
              ELSE least(avail - 100000, greatest(nat, flr)) END) AS span
  FROM room
),
spans AS (SELECT *, b + span * off // total AS fs, b + span * (off + weight) // total AS fe FROM block)
SELECT track_id, i, weight, CAST(fs AS BIGINT) AS start_us,
       CAST(greatest(fs + 80000, least(fe, fs + 1250000)) AS BIGINT) AS end_us, 0.28::DOUBLE AS confidence, false AS matched
FROM spans
UNION ALL
SELECT track_id, i, weight, s, e, confidence, true FROM tok WHERE matched""",
    "fragment_merge": "WITH " + LINE_WORDS + """,
parts AS (
  SELECT *, CASE WHEN event_id % 3 = 0 THEN '' ELSE text END AS t,
         count(*) FILTER (WHERE event_id % 3 <> 0) OVER (PARTITION BY track_id, line_index ORDER BY k) AS word_no
  FROM line_words
)
SELECT track_id, line_index, word_no, arg_min(t, k) AS text, arg_min(start_us, k) AS start_us,
       arg_max(end_us, k) AS end_us, arg_min(confidence, k) AS confidence
FROM parts GROUP BY track_id, line_index, word_no""",
    "line_envelope": "WITH " + LINE_WORDS + DURATIONS + """,
ends AS (
  SELECT track_id, line_index, greatest(0, min(start_us) - 60000) AS start_us, arg_max(end_us, start_us * 10 + k) + 120000 AS e
  FROM line_words GROUP BY track_id, line_index
)
SELECT track_id, line_index, start_us, least(greatest(e, start_us + 700000), duration_us) AS end_us
FROM ends JOIN durations USING (track_id)""",
    "overlap_trim": "WITH " + CAPTIONS + "," + _TRIM.format(src="captions")
    + " SELECT track_id, idx, start_us, end_us FROM trimmed",
    "gap_markers": "WITH " + CAPTIONS + "," + _TRIM.format(src="captions") + "," + _MARK.format(opening="NULL"),
    "gap_markers_intro": "WITH " + CAPTIONS + """,
late AS (SELECT * REPLACE (start_us + track_id % 2 * 5000000 AS start_us, end_us + track_id % 2 * 5000000 AS end_us) FROM captions),"""
    + _TRIM.format(src="late") + "," + _MARK.format(opening="0"),
    "proportional_layout": "WITH " + _LAYOUT + " SELECT * FROM layout",
    "proportional_words": "WITH " + _LAYOUT + "," + _CAPTION_VOCAB + """,
lw AS (
  SELECT track_id, "order", start_us, end_us, unnest(w) AS raw, generate_subscripts(w, 1) AS pos
  FROM (SELECT *, """ + split_words("text") + """ AS w FROM layout)
),
lp AS (
  SELECT *, row_number() OVER (PARTITION BY track_id, "order" ORDER BY pos, part) - 1 AS k,
         greatest(80000, (end_us - start_us) // count(*) OVER (PARTITION BY track_id, "order")) AS wspan
  FROM lw JOIN vocab USING (raw)
)
SELECT track_id, "order", k, raw AS text, start_us + wspan * k AS start_us, start_us + wspan * (k + 1) AS end_us FROM lp""",
    "prompt_window": r"""
WITH lines AS (
  SELECT doc_id, unnest(p) AS text, generate_subscripts(p, 1) - 1 AS idx
  FROM (SELECT doc_id, string_split(text, chr(10)) AS p FROM documents)
),
used AS (
  SELECT *, sum(len(list_filter(regexp_split_to_array(text, '[ \t\n\x0B\f\r]+'), lambda w: w <> '')))
              OVER (PARTITION BY doc_id ORDER BY idx) AS used
  FROM lines WHERE trim(text, ' ') <> '' AND idx >= 3
)
SELECT doc_id, string_agg(text, ' ' ORDER BY idx) AS prompt, CAST(max(used) AS BIGINT) AS tokens, count(*) AS lines
FROM used WHERE used <= 40 GROUP BY doc_id""",
    "caption_words_even": "WITH " + EVEN_WORDS + " SELECT * FROM even_words",
    "words_rescale": "WITH " + EVEN_WORDS + """,
env AS (
  SELECT track_id, idx, start_us AS os, end_us AS oe, start_us + event_id % 5 * 100000 AS ns,
         end_us + event_id % 7 * 100000 + 500000 AS ne
  FROM captions
)
SELECT track_id, idx, k, ns + (start_us - os) * (ne - ns) // greatest(100, oe - os) AS start_us,
       ns + (end_us - os) * (ne - ns) // greatest(100, oe - os) AS end_us
FROM even_words JOIN env USING (track_id, idx)""",
    "word_retime": "WITH " + EVEN_WORDS + """,
w AS (
  SELECT e.*, c.start_us AS cs, c.end_us AS ce, greatest(c.start_us, e.start_us - 70000) AS ns, (idx + k) % 4 = 0 AS edited
  FROM even_words e JOIN captions c USING (track_id, idx)
)
SELECT track_id, idx, k, CASE WHEN edited THEN ns ELSE start_us END AS start_us,
       CASE WHEN edited THEN least(ce, greatest(ns + 50000, end_us - 90000)) ELSE end_us END AS end_us
FROM w""",
    "caption_order": "WITH " + JITTERED + """
SELECT track_id, i AS idx, start_us, end_us,
       row_number() OVER (PARTITION BY track_id ORDER BY start_us, i) - 1 AS position
FROM jittered""",
}
