"""Edit, validation and repair queries and their oracles."""

from pyspark.sql import functions as F

from cadenza.catalog.base_sql import CAPTIONS, DURATIONS, TIMED_WORDS
from cadenza.catalog.text_sql import syllables_sql
from cadenza.catalog.tracks import EVEN_WORDS
from cadenza.functions.timecode import idiv
from cadenza.operators import edits as E
from cadenza.operators import repair as R
from cadenza.operators import tracks as T
from cadenza.sources import testbed as B

def ev():
    return F.col("event_id")



def trimmed(spark, sf_dir):
    return T.overlap_trim(B.captions(spark, sf_dir))


def edits(spark, sf_dir, kinds, every=11):
    """A request for every ``every``-th event, some of them far out of reach."""
    kind = F.element_at(F.array(*map(F.lit, kinds)), (ev() % len(kinds) + 1).cast("int"))
    at_end = kind.isin("out", "roll")
    value = F.when(at_end, F.col("end_us")).otherwise(F.col("start_us")) + ((ev() * 37) % 41 - 20) * 150_000
    return trimmed(spark, sf_dir).filter(ev() % every == 0).select(
        "track_id", "idx", kind.alias("kind"), value.alias("value_us")
    )


def long_tracks(spark, sf_dir):
    """Track lengths with two seconds to spare."""
    return B.durations(spark, sf_dir).withColumn("duration_us", F.col("duration_us") + 2_000_000)


def rolls(spark, sf_dir):
    return edits(spark, sf_dir, ["roll"], 3).select("track_id", "idx", F.col("value_us").alias("boundary_us"))


def relinks(spark, sf_dir):
    return edits(spark, sf_dir, ["move"], 5).select("track_id", "idx", F.col("value_us").alias("start_to_us"))


def chosen(spark, sf_dir, every):
    return B.captions(spark, sf_dir).filter(ev() % every == 0).select("track_id", "idx")


def split(spark, sf_dir):
    caps = B.captions(spark, sf_dir).select("track_id", "idx", "start_us", "end_us", "text")
    cuts = B.captions(spark, sf_dir).filter(ev() % 2 == 0).select(
        "track_id", "idx", (idiv(F.col("start_us") + F.col("end_us"), 2) + ev() % 3 * 400_000).alias("at_us")
    )
    return E.caption_split(caps, T.caption_words_even(B.captions(spark, sf_dir)), cuts)


def merged(spark, sf_dir):
    merges = B.captions(spark, sf_dir).filter(ev() % 2 == 0).select(
        "track_id", "idx", idiv(F.col("idx"), 4).alias("merge_id")
    )
    return E.caption_merge(B.captions(spark, sf_dir), merges)


def nudged(spark, sf_dir):
    nudges = trimmed(spark, sf_dir).filter(ev() % 13 == 0).select(
        "track_id", "idx", (ev() % 9 - 4).alias("frames")
    )
    return E.nudge_frames(trimmed(spark, sf_dir), nudges, long_tracks(spark, sf_dir), 30)


def new_sheet(spark, sf_dir):
    """New text for every track; odd tracks lose some lines."""
    return B.captions(spark, sf_dir).filter((F.col("track_id") % 2 == 0) | (ev() % 17 != 0)).select(
        "track_id", "idx", F.concat(F.lit("new "), F.col("text")).alias("text"), "instrumental"
    )


def suggestions(spark, sf_dir):
    """Suggested windows as text; every 37th track holds something that is no number."""
    bad = (F.col("track_id") % 37 == 5) & (F.col("idx") == 3)
    start = F.col("start_us") + 50_000
    return B.captions(spark, sf_dir).filter(ev() % 4 != 0).select(
        "track_id",
        ev().alias("row_id"),
        F.col("idx").cast("string").alias("line_index"),
        F.when(bad, "soon").otherwise(start.cast("string")).alias("start_us"),
        (start + 900_000 + F.col("track_id") % 5 * 3_000_000 + ev() % 7 * 350_000).cast("string").alias("end_us"),
        F.when(ev() % 5 != 0, (ev() % 130 / F.lit(100.0)).cast("string")).alias("confidence"),
    )


def sure_windows(spark, sf_dir):
    return B.captions(spark, sf_dir).filter(ev() % 4 != 0).select(
        "track_id",
        F.col("idx").alias("line_index"),
        (F.col("start_us") + 50_000).alias("start_us"),
        (F.col("start_us") + 50_000 + ev() % 40 * 100_000).alias("end_us"),
        ((ev() * 7) % 100 / F.lit(100.0)).alias("confidence"),
    )


def merged_windows(spark, sf_dir):
    caps = B.captions(spark, sf_dir).select("track_id", "idx", "start_us", "end_us", "confidence")
    return R.suggestion_merge(caps, sure_windows(spark, sf_dir), B.durations(spark, sf_dir))


def shaken(spark, sf_dir):
    shift = ((ev() * 7919) % 13 - 6) * 1_000_000
    start = F.greatest(F.lit(0), F.col("start_us") + shift)
    return B.captions(spark, sf_dir).select(
        "track_id", "idx", start.alias("start_us"), (start + F.col("end_us") - F.col("start_us")).alias("end_us")
    )


def repaired_words(spark, sf_dir):
    words = T.caption_words_even(B.captions(spark, sf_dir))
    return R.repair_words(words, R.repair_monotone(shaken(spark, sf_dir)))


def heard(spark, sf_dir):
    words = B.timed_words(spark, sf_dir).select(
        "track_id",
        F.col("n").alias("j"),
        F.when(ev() % 31 == 0, " ").otherwise(F.col("text")).alias("word"),
        F.when(ev() % 19 == 0, F.col("end_us")).otherwise(F.col("start_us")).alias("start_us"),
        "end_us",
    )
    again = words.filter((F.col("track_id") + F.col("j")) % 6 == 0).withColumns(
        {"j": F.col("j") * 2 + 1, "start_us": F.col("start_us") + 30_000}
    )
    words = words.withColumn("j", F.col("j") * 2).unionByName(again)
    segments = B.timed_words(spark, sf_dir).filter(ev() % 7 == 0).select(
        "track_id", F.col("n").alias("k"), "start_us", "end_us", F.col("confidence").alias("no_speech_prob")
    )
    return R.transcript_sanitize(words, segments, B.durations(spark, sf_dir))


QUERIES = {
    "edit_independent": lambda s, d: E.edit_independent(
        trimmed(s, d), edits(s, d, ["in", "out"]).withColumnRenamed("kind", "edge"), B.durations(s, d)
    ),
    "edit_ripple": lambda s, d: E.edit_ripple(trimmed(s, d), edits(s, d, ["out", "move"]), long_tracks(s, d)),
    "edit_roll": lambda s, d: E.edit_roll(trimmed(s, d), rolls(s, d)),
    "edit_relink": lambda s, d: E.edit_relink(
        trimmed(s, d).select("track_id", "idx", "start_us", "end_us"), relinks(s, d), B.durations(s, d)
    ),
    "edit_clamp": lambda s, d: E.edit_clamp(edits(s, d, ["move", "in", "out", "roll"], 2), trimmed(s, d)),
    "caption_split": split,
    "caption_merge": merged,
    "caption_delete": lambda s, d: E.caption_delete(
        B.captions(s, d).select("track_id", "idx", "text"), chosen(s, d, 3)
    ),
    "caption_duplicate": lambda s, d: E.caption_duplicate(B.captions(s, d), chosen(s, d, 4)),
    "duplicate_words": lambda s, d: E.duplicate_words(
        T.caption_words_even(B.captions(s, d)), B.captions(s, d), chosen(s, d, 4)
    ),
    "nudge_frames": nudged,
    "relyric": lambda s, d: E.relyric(B.captions(s, d), new_sheet(s, d), B.durations(s, d)),
    "suggestion_validate": lambda s, d: R.suggestion_validate(suggestions(s, d), B.durations(s, d)),
    "index_monotone_check": lambda s, d: R.index_monotone_check(
        B.timed_words(s, d).select(
            "track_id", F.col("n").alias("pos"),
            (F.col("n") + F.when((ev() % 997 == 0), -1).otherwise(0)).alias("line_index"),
        )
    ),
    "suggestion_merge": merged_windows,
    "repair_monotone": lambda s, d: R.repair_monotone(shaken(s, d)),
    "repair_words": repaired_words,
    "transcript_sanitize": lambda s, d: heard(s, d)[0],
    "sanitize_counts": lambda s, d: heard(s, d)[1],
}

_TRIMMED = CAPTIONS + DURATIONS + """,
trimmed AS (
  SELECT track_id, idx, start_us, text, event_id, confidence,
         CASE WHEN end_us > nxt - 40000 THEN greatest(start_us + 300000, nxt - 40000) ELSE end_us END AS end_us
  FROM (SELECT *, lead(start_us) OVER (PARTITION BY track_id ORDER BY start_us, idx) AS nxt FROM captions)
)"""


def _edits(kinds: list[str], every: int) -> str:
    listed = "[" + ", ".join(f"'{k}'" for k in kinds) + "]"
    return f""",
edits AS (
  SELECT track_id, idx, kind,
         CASE WHEN kind IN ('out', 'roll') THEN end_us ELSE start_us END + ((event_id * 37) % 41 - 20) * 150000 AS v
  FROM (SELECT *, {listed}[event_id % {len(kinds)} + 1] AS kind FROM trimmed WHERE event_id % {every} = 0)
)"""


_RIPPLE = """,
j AS (
  SELECT t.track_id, t.idx, t.start_us AS s, t.end_us AS e, kind, v, duration_us + 2000000 AS dur,
         lag(t.end_us) OVER (PARTITION BY t.track_id ORDER BY t.idx) AS pe, max(t.end_us) OVER (PARTITION BY t.track_id) AS top
  FROM trimmed t LEFT JOIN edits USING (track_id, idx) JOIN durations d ON d.track_id = t.track_id
),
dl AS (
  SELECT *, CASE kind WHEN 'out' THEN greatest(v, s + 40000) - e WHEN 'move' THEN greatest(v, least(s, coalesce(pe, 0))) - s ELSE 0 END AS d,
         CASE kind WHEN 'out' THEN v - e WHEN 'move' THEN v - s ELSE 0 END AS want, greatest(0, dur - top) AS room
  FROM j
),
cum AS (SELECT *, sum(d) OVER (PARTITION BY track_id ORDER BY idx) AS c FROM dl),
cap AS (SELECT *, least(c - d, room) AS b, least(c, room) AS u FROM cum)
SELECT track_id, idx, CAST(s + CASE WHEN kind = 'move' THEN u ELSE b END AS BIGINT) AS start_us, CAST(e + u AS BIGINT) AS end_us,
       coalesce(kind IS NOT NULL AND u - b <> want, false) AS clamped
FROM cap"""

_SHAKEN = CAPTIONS + """,
shaken AS (
  SELECT track_id, idx, greatest(0, start_us + ((event_id * 7919) % 13 - 6) * 1000000) AS s,
         greatest(0, start_us + ((event_id * 7919) % 13 - 6) * 1000000) + end_us - start_us AS e
  FROM captions
),
pushed AS (
  SELECT track_id, idx, max(s) OVER w AS ns, CASE WHEN max(s) OVER w > s THEN greatest(max(s) OVER w + 700000, e) ELSE e END AS ne
  FROM shaken WINDOW w AS (PARTITION BY track_id ORDER BY idx)
),
repaired AS (
  SELECT track_id, idx, ns AS start_us, coalesce(ne > nx - 40000, false) AS trimmed,
         CASE WHEN ne > nx - 40000 THEN greatest(ns + 500000, nx - 40000) ELSE ne END AS end_us
  FROM (SELECT *, lead(ns) OVER (PARTITION BY track_id ORDER BY idx) AS nx FROM pushed)
)"""

_HEARD = TIMED_WORDS + DURATIONS + """,
w0 AS (
  SELECT track_id, n, CASE WHEN event_id % 31 = 0 THEN ' ' ELSE text END AS word,
         CASE WHEN event_id % 19 = 0 THEN end_us ELSE start_us END AS start_us, end_us
  FROM timed_words
),
heard AS (
  SELECT track_id, n * 2 AS j, word, start_us, end_us FROM w0
  UNION ALL SELECT track_id, n * 2 + 1, word, start_us + 30000, end_us FROM w0 WHERE (track_id + n) % 6 = 0
),
seg AS (SELECT track_id, start_us AS lo, end_us AS hi FROM timed_words WHERE event_id % 7 = 0 AND confidence > 0.6),
ok AS (
  SELECT h.* FROM heard h JOIN durations d USING (track_id)
  WHERE trim(word, ' ') <> '' AND end_us > start_us AND end_us <= duration_us
    AND NOT EXISTS (SELECT 1 FROM seg s WHERE s.track_id = h.track_id AND (h.start_us + h.end_us) // 2 BETWEEN lo AND hi)
),
kept AS (
  SELECT track_id, j, word, start_us, end_us FROM (
    SELECT *, lag(lower(word)) OVER w AS pw, lag(start_us) OVER w AS ps FROM ok WINDOW w AS (PARTITION BY track_id ORDER BY j))
  WHERE NOT coalesce(lower(word) = pw AND start_us - ps <= 50000, false)
)"""

ORACLE = {
    "edit_independent": "WITH " + _TRIMMED + _edits(["in", "out"], 11) + """,
r AS (
  SELECT t.*, kind, v, CASE kind WHEN 'in' THEN greatest(0, least(end_us - 40000, v)) WHEN 'out' THEN greatest(start_us + 40000, least(duration_us, v)) END AS a
  FROM trimmed t LEFT JOIN edits USING (track_id, idx) JOIN durations d ON d.track_id = t.track_id
)
SELECT track_id, idx, CASE WHEN kind = 'in' THEN a ELSE start_us END AS start_us, CASE WHEN kind = 'out' THEN a ELSE end_us END AS end_us,
       coalesce(a <> v, false) AS clamped FROM r""",
    "edit_ripple": "WITH " + _TRIMMED + _edits(["out", "move"], 11) + _RIPPLE,
    "edit_roll": "WITH " + _TRIMMED + _edits(["roll"], 3) + """,
l AS (
  SELECT t.track_id, t.idx, start_us AS s, end_us AS e, v, lag(v) OVER w AS pv, lead(v) OVER w AS nv,
         lead(end_us) OVER w AS ne, lead((start_us + end_us) // 2) OVER w AS nm
  FROM trimmed t LEFT JOIN edits USING (track_id, idx) WINDOW w AS (PARTITION BY t.track_id ORDER BY t.idx)
),
b AS (
  SELECT *, CASE WHEN v IS NOT NULL AND ne IS NOT NULL THEN
    greatest(CASE WHEN pv IS NULL THEN s + 40000 ELSE (s + e) // 2 + 20000 END,
             least(CASE WHEN nv IS NULL THEN ne - 40000 ELSE nm - 20000 END, v)) END AS b
  FROM l
)
SELECT track_id, idx, coalesce(lag(b) OVER (PARTITION BY track_id ORDER BY idx), s) AS start_us, coalesce(b, e) AS end_us FROM b""",
    "edit_relink": "WITH " + _TRIMMED + _edits(["move"], 5) + """
SELECT t.track_id, t.idx, coalesce(greatest(0, least(greatest(0, duration_us - (end_us - start_us)), v)), start_us) AS start_us,
       coalesce(greatest(0, least(greatest(0, duration_us - (end_us - start_us)), v)), start_us) + end_us - start_us AS end_us
FROM (SELECT t.*, v FROM trimmed t JOIN edits USING (track_id, idx)
      UNION ALL SELECT t.*, NULL FROM trimmed t WHERE event_id % 5 <> 0) t JOIN durations d ON d.track_id = t.track_id""".replace(
        "coalesce(greatest(0, least(greatest(0, duration_us - (end_us - start_us)), v)), start_us)",
        "CASE WHEN v IS NULL THEN start_us ELSE greatest(0, least(greatest(0, duration_us - (end_us - start_us)), v)) END",
    ),
    "edit_clamp": "WITH " + _TRIMMED + _edits(["move", "in", "out", "roll"], 2) + """,
l AS (SELECT *, lag(end_us) OVER w AS p, lead(start_us) OVER w AS nx FROM trimmed WINDOW w AS (PARTITION BY track_id ORDER BY idx))
SELECT track_id, idx, kind, v AS value_us,
       greatest(0, CASE kind
         WHEN 'move' THEN greatest(coalesce(p + 20000, 0), least(v, coalesce(nx - 20000 - (end_us - start_us), v)))
         WHEN 'in' THEN greatest(coalesce(p + 20000, 0), least(v, end_us - 40000))
         WHEN 'out' THEN greatest(start_us + 40000, least(v, coalesce(nx - 20000, v)))
         ELSE greatest(start_us + 40000, least(v, coalesce(nx - 40000, v))) END) AS applied_us
FROM l JOIN edits USING (track_id, idx)""",
    "caption_split": "WITH " + EVEN_WORDS + """,
c AS (
  SELECT *, CASE WHEN event_id % 2 = 0 AND (start_us + end_us) // 2 + event_id % 3 * 400000 < end_us AND (start_us + end_us) // 2 + event_id % 3 * 400000 > start_us
              THEN (start_us + end_us) // 2 + event_id % 3 * 400000 END AS cut
  FROM captions
),
h AS (
  SELECT track_id, idx, 0 AS part, start_us, cut AS end_us, cut FROM c WHERE cut IS NOT NULL
  UNION ALL SELECT track_id, idx, 1, cut, end_us, cut FROM c WHERE cut IS NOT NULL
)
SELECT h.track_id, h.idx, h.part, any_value(h.start_us) AS start_us, any_value(h.end_us) AS end_us,
       coalesce(string_agg(CASE WHEN (w.start_us >= cut)::INT = part THEN w.text END, ' ' ORDER BY k), '') AS text
FROM h LEFT JOIN even_words w ON w.track_id = h.track_id AND w.idx = h.idx GROUP BY h.track_id, h.idx, h.part
UNION ALL SELECT track_id, idx, 0, start_us, end_us, text FROM c WHERE cut IS NULL""",
    "caption_merge": "WITH " + CAPTIONS + """
SELECT track_id, idx, start_us, end_us, text, confidence FROM captions WHERE event_id % 2 = 1
UNION ALL
SELECT track_id, min(idx), min(start_us), max(end_us), string_agg(text, ' ' ORDER BY idx), min(confidence)
FROM captions WHERE event_id % 2 = 0 GROUP BY track_id, idx // 4""",
    "caption_delete": "WITH " + CAPTIONS + """
SELECT track_id, idx, text, row_number() OVER (PARTITION BY track_id ORDER BY idx) - 1 AS position FROM captions WHERE event_id % 3 <> 0""",
    "caption_duplicate": "WITH " + CAPTIONS + """,
b AS (
  SELECT track_id, idx, start_us, end_us, text, 0::INT AS copy FROM captions
  UNION ALL SELECT track_id, idx, end_us + 40000, end_us + 40000 + end_us - start_us, text, 1 FROM captions WHERE event_id % 4 = 0
)
SELECT *, row_number() OVER (PARTITION BY track_id ORDER BY start_us, idx, copy) - 1 AS position FROM b""",
    "duplicate_words": "WITH " + EVEN_WORDS + """
SELECT w.track_id, w.idx, k, w.start_us + c.end_us - c.start_us + 40000 AS start_us, w.end_us + c.end_us - c.start_us + 40000 AS end_us
FROM even_words w JOIN captions c USING (track_id, idx) WHERE event_id % 4 = 0""",
    "nudge_frames": "WITH " + _TRIMMED + """,
edits AS (
  SELECT track_id, idx, 'move' AS kind, start_us + CAST(floor((event_id % 9 - 4) * 1000000 / 30 + 0.5) AS BIGINT) AS v
  FROM trimmed WHERE event_id % 13 = 0
)""" + _RIPPLE,
    "relyric": "WITH " + CAPTIONS + DURATIONS + """,
fresh AS (SELECT track_id, idx, 'new ' || text AS text FROM captions WHERE (track_id % 2 = 0 OR event_id % 17 <> 0) AND NOT instrumental),
n AS (
  SELECT track_id, f.new, o.old, duration_us
  FROM (SELECT track_id, count(*) AS new FROM fresh GROUP BY 1) f
  JOIN (SELECT track_id, count(*) AS old FROM captions WHERE NOT instrumental GROUP BY 1) o USING (track_id) JOIN durations USING (track_id)
),
a AS (SELECT track_id, text, row_number() OVER (PARTITION BY track_id ORDER BY idx) - 1 AS ord FROM fresh),
b AS (SELECT track_id, start_us, end_us, row_number() OVER (PARTITION BY track_id ORDER BY idx) - 1 AS ord FROM captions WHERE NOT instrumental),
w AS (SELECT track_id, text, ord, """ + syllables_sql("regexp_replace(text, '\\s', '', 'g')") + """ AS w FROM a JOIN n USING (track_id) WHERE old <> new),
p AS (
  SELECT w.*, sum(w) OVER (PARTITION BY track_id ORDER BY ord) - w AS before, sum(w) OVER (PARTITION BY track_id) AS total,
         least(2400000, duration_us * 6 // 100) AS l,
         greatest(1000000, duration_us - least(2400000, duration_us * 6 // 100) - least(2800000, duration_us * 8 // 100)) AS u
  FROM w JOIN n USING (track_id)
)
SELECT track_id, ord AS "order", text, start_us, end_us, true AS kept_window FROM a JOIN b USING (track_id, ord) JOIN n USING (track_id) WHERE old = new
UNION ALL
SELECT track_id, ord, text, CAST(l + u * before // total AS BIGINT),
       CAST(l + u * before // total + greatest(u * w * 82 // (total * 100), 700000) AS BIGINT), false FROM p""",
    "suggestion_validate": "WITH " + CAPTIONS + DURATIONS + """,
s AS (
  SELECT track_id, idx AS line_index, CASE WHEN track_id % 37 = 5 AND idx = 3 THEN NULL ELSE start_us + 50000 END AS s,
         start_us + 50000 + 900000 + track_id % 5 * 3000000 + event_id % 7 * 350000 AS e,
         CASE WHEN event_id % 5 <> 0 THEN CAST(event_id % 130 AS DOUBLE) / 100 ELSE 0.6 END AS c, duration_us
  FROM captions JOIN durations USING (track_id) WHERE event_id % 4 <> 0
),
l AS (SELECT *, lag(s) OVER (PARTITION BY track_id ORDER BY line_index) AS ps, row_number() OVER (PARTITION BY track_id ORDER BY line_index) AS r FROM s),
good AS (
  SELECT track_id FROM l GROUP BY track_id
  HAVING bool_and(coalesce(e <= duration_us + 750000 AND e - s BETWEEN 500000 AND 15000000 AND (r = 1 OR s >= ps - 250000), false))
)
SELECT track_id, line_index, s AS start_us, least(e, duration_us) AS end_us, least(1, c)::DOUBLE AS confidence FROM l JOIN good USING (track_id)""",
    "index_monotone_check": "WITH " + TIMED_WORDS + """,
l AS (SELECT track_id, n AS pos, n + CASE WHEN event_id % 997 = 0 THEN -1 ELSE 0 END AS i FROM timed_words)
SELECT track_id, bool_and(i > p) AS accepted
FROM (SELECT *, coalesce(lag(i) OVER (PARTITION BY track_id ORDER BY pos), -1) AS p FROM l) GROUP BY track_id""",
    "suggestion_merge": "WITH " + CAPTIONS + DURATIONS + """,
j AS (
  SELECT *, start_us + 50000 AS ss, start_us + 50000 + event_id % 40 * 100000 AS se, CAST((event_id * 7) % 100 AS DOUBLE) / 100 AS sc
  FROM captions JOIN durations USING (track_id)
),
k AS (
  SELECT *, event_id % 4 <> 0 AND (sc >= confidence - 0.05 OR confidence < 0.65) AS fix, greatest(0, least(ss, duration_us - 700000)) AS ns FROM j
)
SELECT track_id, idx, CASE WHEN fix THEN ns ELSE start_us END AS start_us,
       CASE WHEN fix THEN least(duration_us, greatest(ns + 700000, se)) ELSE end_us END AS end_us,
       CASE WHEN fix THEN greatest(confidence, least(0.92, sc)) ELSE confidence END AS confidence, fix AS repaired
FROM k""",
    "repair_monotone": "WITH " + _SHAKEN + " SELECT track_id, idx, start_us, end_us, trimmed FROM repaired",
    "repair_words": "WITH RECURSIVE " + EVEN_WORDS + "," + _SHAKEN[len(CAPTIONS) + 1:] + """,
k AS (
  SELECT w.track_id, w.idx, w.k, w.start_us AS s, w.end_us AS e, r.end_us AS cap_end,
         arg_min(w.start_us, w.k) OVER p AS f, trimmed AND arg_max(w.end_us, w.k) OVER p > r.end_us AS sq, arg_max(w.end_us, w.k) OVER p AS l
  FROM even_words w JOIN repaired r USING (track_id, idx) WINDOW p AS (PARTITION BY w.track_id, w.idx)
),
need AS (
  SELECT *, greatest(80000, CASE WHEN cap_end - f >= greatest(10000, l - f) THEN e - s
                                 WHEN (cap_end - f) * 10 <= greatest(10000, l - f) THEN (e - s) // 10
                                 ELSE (e - s) * (cap_end - f) // greatest(10000, l - f) END) AS nd
  FROM k
),
walk AS (
  SELECT track_id, idx, k, f AS ns, least(cap_end, f + nd) AS ne FROM need WHERE k = 0
  UNION ALL
  SELECT n.track_id, n.idx, n.k, w.ne, least(n.cap_end, w.ne + n.nd)
  FROM walk w JOIN need n ON n.track_id = w.track_id AND n.idx = w.idx AND n.k = w.k + 1
)
SELECT track_id, idx, k, CASE WHEN sq THEN ns ELSE s END AS start_us, CASE WHEN sq THEN ne ELSE e END AS end_us
FROM need JOIN walk USING (track_id, idx, k)""",
    "transcript_sanitize": "WITH " + _HEARD + " SELECT * FROM kept",
    "sanitize_counts": "WITH " + _HEARD + """
SELECT track_id, count(*) - any_value(coalesce(c, 0)) AS dropped
FROM heard LEFT JOIN (SELECT track_id, count(*) AS c FROM kept GROUP BY 1) USING (track_id) GROUP BY track_id""",
}
