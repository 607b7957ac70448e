"""Time-join queries and their oracles."""

from pyspark.sql import functions as F

from cadenza.catalog.base_sql import CAPTIONS, LINE_WORDS, TIMED_WORDS
from cadenza.catalog.tracks import EVEN_WORDS
from cadenza.operators import joins as J
from cadenza.operators import tracks as T
from cadenza.sources import testbed as B


def segments(spark, sf_dir):
    """Every seventh event opens a speech segment of its own length and a half."""
    return B.timed_words(spark, sf_dir).filter("event_id % 7 = 0").select(
        "track_id",
        F.col("n").alias("k"),
        "start_us",
        (F.col("start_us") + F.expr("(end_us - start_us) * 3 div 2")).alias("end_us"),
    )


def line_onsets(spark, sf_dir):
    return B.timed_words(spark, sf_dir).select(
        "track_id", F.greatest(F.lit(0), F.col("start_us") + ((F.col("event_id") * 31) % 401 - 200) * 1000).alias("at_us")
    )


def words_in_lines(spark, sf_dir):
    words = B.line_words(spark, sf_dir)
    lines = words.groupBy("track_id", "line_index").agg(
        (F.min("start_us") + 20_000).alias("line_start_us"), F.max("start_us").alias("line_end_us")
    )
    return words.join(lines, ["track_id", "line_index"]).select(
        "track_id", "n", "start_us", "end_us", "confidence", "line_start_us", "line_end_us"
    )


def snapped(spark, sf_dir):
    caps = B.captions(spark, sf_dir)
    times = caps.filter("event_id % 2 = 0").select(
        "track_id",
        F.col("event_id").alias("id"),
        (F.col("start_us") + ((F.col("event_id") * 17) % 301 - 150) * 1000).alias("at_us"),
    )
    targets = J.snap_targets(caps).withColumnRenamed("at_us", "target_us")
    return J.snap_nearest(times, targets, F.lit(J.snap_radius(90)))


def anchors(spark, sf_dir):
    return B.timed_words(spark, sf_dir).filter("n % 5 = 0").select(
        "track_id",
        F.col("n").alias("line_index"),
        (F.col("start_us") + (F.col("event_id") % 7 - 3) * 100_000).alias("offset_us"),
        "confidence",
        F.col("event_id").alias("anchor_id"),
    )


def remapped(spark, sf_dir):
    lines = B.captions(spark, sf_dir).select("track_id", "idx", "instrumental")
    return J.anchor_remap(anchors(spark, sf_dir), lines)


def warped(spark, sf_dir):
    caps = B.captions(spark, sf_dir)
    words = T.caption_words_even(caps)
    return J.anchor_warp(
        caps.select("track_id", "idx", "start_us", "end_us"),
        words.select("track_id", "idx", "k", "start_us", "end_us"),
        anchors(spark, sf_dir),
    )


def widened(spark, sf_dir):
    caps = B.captions(spark, sf_dir).select("track_id", "idx", "start_us", "end_us", "instrumental")
    words = T.caption_words_even(B.captions(spark, sf_dir).filter("event_id % 5 <> 0"))
    return J.segment_interval_join(caps, words, segments(spark, sf_dir))


def styles(spark, sf_dir):
    base = B.table(spark, sf_dir, "region").select(
        F.col("r_regionkey").alias("base_id"),
        (F.col("r_regionkey") * 4 + 24).alias("font_size"),
        F.col("r_name").alias("fill"),
        (F.col("r_regionkey") + 30).alias("max_chars"),
    )
    odd = F.col("n_nationkey") % 2 == 1
    projects = B.table(spark, sf_dir, "nation").select(
        F.col("n_nationkey").alias("project_id"),
        F.when(F.col("n_nationkey") % 6 == 0, 99).otherwise(F.col("n_regionkey")).alias("base_id"),
        F.when(~odd, F.col("n_nationkey") + 50).alias("font_size"),
        F.when(~odd, F.col("n_name")).alias("fill"),
        F.lit(None).cast("int").alias("max_chars"),
    )
    c = F.col("c_custkey")
    captions = B.table(spark, sf_dir, "customer").select(
        c.alias("caption_id"),
        F.col("c_nationkey").alias("project_id"),
        F.when(c % 3 == 0, (c % 90).cast("int")).alias("font_size"),
        F.when(c % 5 == 0, F.col("c_mktsegment")).alias("fill"),
        F.when(c % 7 == 0, 20).alias("max_chars"),
    )
    return J.style_cascade(base, projects, captions, ["font_size", "fill", "max_chars"], 0)


def attached(spark, sf_dir):
    words = B.line_words(spark, sf_dir)
    lines = words.groupBy("track_id", "line_index").agg((F.max("event_id") % 9 == 0).alias("instrumental"))
    kept = words.filter("line_index % 7 <> 3").select("track_id", "line_index", "k", "text", "start_us", "end_us")
    return J.word_line_join(lines, kept)


def collected(spark, sf_dir):
    words = B.timed_words(spark, sf_dir)
    clips = words.select(
        F.col("event_id").alias("clip_id"),
        (F.col("n") % 11 - 1).alias("line_index"),
        (F.col("text") == "error").alias("instrumental"),
        (F.col("event_id") % 3 == 0).alias("locked"),
        F.when(F.col("event_id") % 4 != 0, F.col("start_us")).alias("offset_us"),
        F.col("confidence").alias("score"),
    )
    located = words.filter("event_id % 5 <> 0").select(
        F.col("event_id").alias("clip_id"), (F.col("start_us") + 1000).alias("offset_us"), "confidence"
    )
    return J.anchor_collect(clips, located)


QUERIES = {
    "segment_interval_join": widened,
    "window_words": lambda s, d: J.window_words(B.captions(s, d), B.timed_words(s, d)),
    "nearest_onset": lambda s, d: J.nearest_onset(words_in_lines(s, d), line_onsets(s, d)),
    "snap_targets": lambda s, d: J.snap_targets(B.captions(s, d)),
    "snap_nearest": snapped,
    "anchor_remap": remapped,
    "anchor_warp": lambda s, d: warped(s, d)[0],
    "anchor_warp_words": lambda s, d: warped(s, d)[1],
    "frame_active": lambda s, d: J.frame_active(
        # every third caption has no words of its own
        B.captions(s, d), T.caption_words_even(B.captions(s, d).filter("idx % 3 <> 0")), 4, 100_000, -40_000
    ),
    "style_cascade": styles,
    "word_line_join": attached,
    "anchor_collect": collected,
}

_TARGETS = """
targets AS (
  SELECT DISTINCT track_id, unnest([0, start_us, end_us]) AS at_us FROM captions
)"""

_WARP = """
hits AS (
  SELECT c.track_id, c.start_us AS tick, a.start_us + (a.event_id % 7 - 3) * 100000 - c.start_us AS fix
  FROM timed_words a JOIN captions c ON c.track_id = a.track_id AND c.idx = a.n
  WHERE a.n % 5 = 0 AND a.confidence >= 0.35
),
hit AS (SELECT track_id, tick, any_value(fix) AS fix FROM hits GROUP BY track_id, tick),
near AS (
  SELECT p.*, a.tick AS aat, a.fix AS afix, b.tick AS bat, b.fix AS bfix
  FROM points p
  ASOF LEFT JOIN hit a ON a.track_id = p.track_id AND p.t >= a.tick
  ASOF LEFT JOIN hit b ON b.track_id = p.track_id AND p.t < b.tick
),
fixed AS (
  SELECT track_id, idx, k, edge, t,
         CASE WHEN aat IS NOT NULL AND bat IS NOT NULL
              THEN afix + CAST(trunc((bfix - afix)::DECIMAL(38,0) * (t - aat) / greatest(1, bat - aat)) AS BIGINT)
              ELSE coalesce(afix, bfix) END AS fix
  FROM near
),
moved AS (SELECT *, coalesce(greatest(0, t + fix), t) AS w FROM fixed),
pairs AS (
  SELECT track_id, idx, k, min(w) FILTER (WHERE edge = 0) AS s, min(w) FILTER (WHERE edge = 1) AS e, bool_or(fix IS NOT NULL) AS f
  FROM moved GROUP BY track_id, idx, k
)"""

ORACLE = {
    "segment_interval_join": "WITH " + EVEN_WORDS + """,
seg AS (
  SELECT track_id, n AS k, start_us AS lo, start_us + (end_us - start_us) * 3 // 2 AS hi FROM timed_words WHERE event_id % 7 = 0
),
c AS (
  SELECT track_id, idx, CAST(sum(start_us + end_us) // (2 * count(*)) AS BIGINT) AS mid, arg_min(start_us, k) AS f, arg_max(end_us, k) AS l
  FROM even_words JOIN (SELECT track_id, idx FROM captions WHERE event_id % 5 <> 0 AND NOT instrumental) USING (track_id, idx)
  GROUP BY track_id, idx
),
ranked AS (
  SELECT c.*, lo, hi, row_number() OVER (PARTITION BY track_id, idx ORDER BY
           CASE WHEN mid BETWEEN lo AND hi THEN 0 ELSE 1 END,
           CASE WHEN mid BETWEEN lo AND hi THEN 0 ELSE abs(lo - mid) END, lo, seg.k) AS r
  FROM c JOIN seg USING (track_id)
),
first_seg AS (SELECT track_id, min(lo) AS fs FROM seg GROUP BY track_id)
SELECT track_id, idx,
       CASE WHEN fs IS NULL THEN start_us WHEN f IS NOT NULL THEN greatest(0, least(f - 80000, lo))
            ELSE greatest(0, greatest(fs - 350000, start_us)) END AS start_us,
       CASE WHEN fs IS NULL THEN end_us
            WHEN f IS NOT NULL THEN greatest(l + 150000, least(hi, greatest(0, least(f - 80000, lo)) + 12000000))
            ELSE greatest(greatest(fs - 350000, start_us) + 1200000, end_us) END AS end_us
FROM captions LEFT JOIN (SELECT * FROM ranked WHERE r = 1) USING (track_id, idx) LEFT JOIN first_seg USING (track_id)""",
    "window_words": "WITH " + CAPTIONS + """
SELECT c.track_id, c.idx, w.n FROM captions c JOIN timed_words w
  ON c.track_id = w.track_id AND w.start_us >= c.start_us - 350000 AND w.end_us <= c.end_us + 500000
  AND w.start_us <= c.end_us + 500000""",
    "nearest_onset": "WITH " + LINE_WORDS + """,
w AS (
  SELECT *, min(start_us) OVER p + 20000 AS ls, max(start_us) OVER p AS le FROM line_words
  WINDOW p AS (PARTITION BY track_id, line_index)
),
o AS (
  SELECT DISTINCT track_id, greatest(0, start_us + ((event_id * 31) % 401 - 200) * 1000) AS at FROM timed_words
),
best AS (
  SELECT w.track_id, w.n, arg_min(o.at, abs(o.at - w.start_us) * 10 + CASE WHEN o.at > w.start_us THEN 1 ELSE 0 END) AS b
  FROM w JOIN o ON o.track_id = w.track_id AND o.at BETWEEN w.start_us - 120000 AND w.start_us + 120000
  GROUP BY w.track_id, w.n
),
t AS (SELECT w.*, b, greatest(ls, least(greatest(ls, le - 60000), b)) AS s FROM w LEFT JOIN best USING (track_id, n))
SELECT track_id, n, CASE WHEN b IS NULL THEN start_us ELSE s END AS start_us,
       CASE WHEN b IS NOT NULL AND abs(s - start_us) > 20000
            THEN greatest(s + 60000, least(s + greatest(60000, end_us - start_us), le)) ELSE end_us END AS end_us,
       round(CASE WHEN b IS NULL THEN confidence WHEN abs(s - start_us) > 80000 THEN greatest(0.2, confidence - 0.15)
                  ELSE least(1.0, confidence + 0.1) END, 6) AS confidence,
       b IS NOT NULL AS snapped
FROM t""",
    "snap_targets": "WITH " + CAPTIONS + "," + _TARGETS + " SELECT * FROM targets",
    "snap_nearest": "WITH " + CAPTIONS + "," + _TARGETS + """,
p AS (SELECT track_id, event_id AS id, start_us + ((event_id * 17) % 301 - 150) * 1000 AS t FROM captions WHERE event_id % 2 = 0),
best AS (
  SELECT p.track_id, id, arg_min(at_us, abs(at_us - t) * 10 + CASE WHEN at_us > t THEN 1 ELSE 0 END) AS b
  FROM p JOIN targets g ON g.track_id = p.track_id AND abs(at_us - t) < 88889 GROUP BY p.track_id, id
)
SELECT track_id, id, t AS at_us, greatest(0, coalesce(b, t)) AS snapped_us FROM p LEFT JOIN best USING (track_id, id)""",
    "anchor_remap": "WITH " + CAPTIONS + """,
v AS (SELECT track_id, idx, row_number() OVER (PARTITION BY track_id ORDER BY idx) - 1 AS ordinal FROM captions WHERE NOT instrumental)
SELECT a.track_id, v.ordinal AS line_index, a.start_us + (a.event_id % 7 - 3) * 100000 AS offset_us, a.confidence, a.event_id AS anchor_id
FROM timed_words a JOIN v ON v.track_id = a.track_id AND v.idx = a.n WHERE a.n % 5 = 0""",
    "anchor_warp": "WITH " + CAPTIONS + """,
points AS (
  SELECT track_id, idx, 0 AS k, 0 AS edge, start_us AS t FROM captions
  UNION ALL SELECT track_id, idx, 0, 1, end_us FROM captions
),""" + _WARP + """
SELECT track_id, idx, s AS start_us, CASE WHEN f THEN greatest(s + 40000, e) ELSE e END AS end_us FROM pairs""",
    "anchor_warp_words": "WITH " + EVEN_WORDS + """,
points AS (
  SELECT track_id, idx, k, 0 AS edge, start_us AS t FROM even_words
  UNION ALL SELECT track_id, idx, k, 1, end_us FROM even_words
),""" + _WARP + """
SELECT track_id, idx, k, s AS start_us, CASE WHEN f THEN greatest(s + 80000, e) ELSE e END AS end_us FROM pairs""",
    "frame_active": "WITH " + EVEN_WORDS + """,
f AS (
  SELECT track_id, idx, unnest(range(greatest(0, CAST(ceil((start_us - 150000) * 4 / 1000000) AS BIGINT)),
                                     CAST(floor((end_us - 50000) * 4 / 1000000) AS BIGINT) + 1)) AS frame FROM captions
)
SELECT track_id, frame, idx,
       count(*) FILTER (WHERE frame * 250000 + 100000 < start_us - 40000) AS future,
       count(*) FILTER (WHERE frame * 250000 + 100000 >= greatest(start_us, end_us) - 40000) AS past,
       count(*) FILTER (WHERE frame * 250000 + 100000 >= start_us - 40000 AND frame * 250000 + 100000 < end_us - 40000) AS active
FROM f LEFT JOIN even_words USING (track_id, idx) GROUP BY track_id, frame, idx""",
    "style_cascade": """
WITH p AS (
  SELECT n_nationkey AS project_id, CASE WHEN n_nationkey % 6 = 0 OR r_regionkey IS NULL THEN 0 ELSE n_regionkey END AS base_id,
         CASE WHEN n_nationkey % 2 = 0 THEN n_nationkey + 50 END AS font_size, CASE WHEN n_nationkey % 2 = 0 THEN n_name END AS fill
  FROM nation LEFT JOIN region ON r_regionkey = n_regionkey
)
SELECT c_custkey AS caption_id, c_nationkey AS project_id,
       CAST(coalesce(CASE WHEN c_custkey % 3 = 0 THEN c_custkey % 90 END, p.font_size, r_regionkey * 4 + 24) AS INT) AS font_size,
       coalesce(CASE WHEN c_custkey % 5 = 0 THEN c_mktsegment END, p.fill, r_name) AS fill,
       CAST(CASE WHEN c_custkey % 7 = 0 THEN 20 ELSE r_regionkey + 30 END AS INT) AS max_chars
FROM customer JOIN p ON p.project_id = c_nationkey JOIN region ON r_regionkey = p.base_id""",
    "word_line_join": "WITH " + LINE_WORDS + """,
l AS (SELECT track_id, line_index FROM line_words GROUP BY 1, 2 HAVING max(event_id) % 9 <> 0),
w AS (SELECT track_id, line_index, k, text, start_us, end_us FROM line_words WHERE line_index % 7 <> 3)
SELECT * FROM l LEFT JOIN w USING (track_id, line_index)""",
    "anchor_collect": "WITH " + TIMED_WORDS + """,
c AS (SELECT *, n % 11 - 1 AS line_index, event_id % 3 = 0 AND event_id % 4 <> 0 AS placed FROM timed_words WHERE n % 11 > 0 OR text = 'error')
SELECT event_id AS clip_id, line_index, CASE WHEN placed THEN start_us ELSE start_us + 1000 END AS offset_us, confidence
FROM c WHERE placed OR (event_id % 5 <> 0 AND confidence >= 0.35)""",
}
