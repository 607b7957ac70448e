"""Alignment queries and their oracles.

Paths of the dynamic programmes have no oracle SQL; ``align_score`` checks their totals, and
the tests compare paths with brute force on small fixtures.
"""

from pyspark.sql import functions as F

from cadenza.catalog.text_sql import phonetic_sql, split_words, vocab_ctes
from cadenza.operators import alignment as A
from cadenza.operators import joins as J
from cadenza.sources import testbed as B


def found_pairs(spark, sf_dir):
    ref = B.table(spark, sf_dir, "benchmark").select(F.col("item_id").alias("ref_id"), "text")
    hyp = B.texts(spark, sf_dir, "documents", "doc_id", "text").withColumnRenamed("doc_id", "hyp_id")
    return A.align_pairs(ref, hyp)


def coverage(spark, sf_dir):
    pairs = B.pairs(spark, sf_dir).select("pair_id", "ref_id", "hyp_id")
    return A.asr_coverage(pairs, B.sheet_tokens(spark, sf_dir), B.heard_tokens(spark, sf_dir))


def fuzzy(spark, sf_dir):
    vocabulary = B.vocabulary(spark, sf_dir)
    return A.fuzzy_token_join(vocabulary, vocabulary, both_orders=False)


def blocks(spark, sf_dir):
    return A.align_blocks(B.sheet_tokens(spark, sf_dir), B.heard_tokens(spark, sf_dir))


def timed_matches(spark, sf_dir):
    path = A.block_matches(blocks(spark, sf_dir)).withColumn("score", (F.col("i") % 10) / F.lit(5.0))
    return J.match_times(path, B.heard_tokens(spark, sf_dir))


QUERIES = {
    "align_pairs": found_pairs,
    "asr_coverage": coverage,
    "fuzzy_token_join": fuzzy,
    "align_blocks": blocks,
    "align_chain": lambda s, d: A.align_chain(B.sheet_tokens(s, d), B.heard_tokens(s, d)),
    "align_affine": lambda s, d: A.align_affine(B.sheet_tokens(s, d), B.heard_tokens(s, d)),
    "align_score": lambda s, d: A.align_score(B.sheet_tokens(s, d), B.heard_tokens(s, d)),
    "match_times": timed_matches,
}

_PAIRS = f"""
dw AS (SELECT doc_id AS hyp_id, {split_words('lower(text)')} AS w FROM documents),
bw AS (SELECT item_id AS ref_id, {split_words('lower(text)')} AS w FROM benchmark),
bm AS (SELECT ref_id, w, least(5, len(w)) AS m FROM bw WHERE len(w) > 0),
bs AS (SELECT DISTINCT ref_id, array_to_string(w[p:p + m - 1], ' ') AS s FROM bm, LATERAL (SELECT unnest(range(1, len(w) - m + 2)) AS p)),
dm AS (SELECT hyp_id, w, m FROM dw, (SELECT DISTINCT m FROM bm)),
ds AS (SELECT DISTINCT hyp_id, array_to_string(w[p:p + m - 1], ' ') AS s FROM dm, LATERAL (SELECT unnest(range(1, len(w) - m + 2)) AS p)),
bn AS (SELECT ref_id, count(*) AS n FROM bs GROUP BY ref_id),
pairs AS (
  SELECT ref_id, hyp_id, round(count(*) / any_value(n), 6) AS containment
  FROM bs JOIN ds USING (s) JOIN bn USING (ref_id) GROUP BY ref_id, hyp_id HAVING count(*) >= 0.5 * any_value(n)
)"""

_RAW = f"""
tb AS (SELECT item_id AS ref_id, unnest(w) AS raw, generate_subscripts(w, 1) - 1 AS pos FROM (SELECT item_id, {split_words('text')} AS w FROM benchmark)),
td AS (SELECT doc_id AS hyp_id, unnest(w) AS raw, generate_subscripts(w, 1) - 1 AS pos FROM (SELECT doc_id, {split_words('text')} AS w FROM documents))"""

_HEARD = _RAW.replace("td AS (SELECT", "td0 AS (SELECT") + """,
td AS (SELECT hyp_id, pos, CASE pos % 7 WHEN 3 THEN 'x' || raw WHEN 5 THEN raw || 'o' ELSE raw END AS raw FROM td0)"""

_TOKENS = _PAIRS + "," + _HEARD + "," + vocab_ctes("SELECT raw FROM tb UNION ALL SELECT raw FROM td") + """,
sheet0 AS (SELECT ref_id, norm, row_number() OVER (PARTITION BY ref_id ORDER BY pos, part) - 1 AS i FROM tb JOIN vocab USING (raw)),
heard0 AS (
  SELECT hyp_id, norm, pos, row_number() OVER (PARTITION BY hyp_id ORDER BY pos) - 1 AS j
  FROM td JOIN vocab USING (raw) WHERE part = 0 AND hyp_id IN (SELECT hyp_id FROM pairs)
),
sheet AS (SELECT ref_id || ':' || hyp_id AS pair_id, i, norm FROM sheet0 JOIN pairs USING (ref_id)),
heard AS (SELECT ref_id || ':' || hyp_id AS pair_id, j, pos, norm FROM heard0 JOIN pairs USING (hyp_id))"""

_BLOCKS = _TOKENS + """,
rg AS (SELECT pair_id, i, norm || ' ' || lead(norm, 1) OVER w || ' ' || lead(norm, 2) OVER w AS g FROM sheet WINDOW w AS (PARTITION BY pair_id ORDER BY i)),
hg AS (SELECT pair_id, j, norm || ' ' || lead(norm, 1) OVER w || ' ' || lead(norm, 2) OVER w AS g FROM heard WINDOW w AS (PARTITION BY pair_id ORDER BY j)),
ru AS (SELECT pair_id, g, min(i) AS i FROM rg WHERE g IS NOT NULL GROUP BY pair_id, g HAVING count(*) = 1),
hu AS (SELECT pair_id, g, min(j) AS j FROM hg WHERE g IS NOT NULL GROUP BY pair_id, g HAVING count(*) = 1),
seeds AS (SELECT pair_id, i, j, i - j AS d FROM ru JOIN hu USING (pair_id, g)),
ordered AS (SELECT pair_id, i, j, row_number() OVER (PARTITION BY pair_id ORDER BY i) AS n FROM seeds),
walk AS (
  SELECT pair_id, 0::BIGINT AS n, []::BIGINT[] AS js, []::BIGINT[] AS best, []::BIGINT[] AS prev FROM ordered WHERE n = 1
  UNION ALL
  SELECT pair_id, n, list_append(js, j), list_append(best, 1 + coalesce(list_max(fit), 0)),
         list_append(prev, CASE WHEN coalesce(list_max(fit), 0) = 0 THEN 0 ELSE list_position(fit, list_max(fit)) END)
  FROM (
    SELECT w.pair_id, o.n, o.j, w.js, w.best, w.prev,
           list_transform(range(1, o.n), lambda p: CASE WHEN w.js[p] < o.j THEN w.best[p] ELSE 0 END) AS fit
    FROM walk w JOIN ordered o ON o.pair_id = w.pair_id AND o.n = w.n + 1
  )
),
ends AS (SELECT pair_id, best, prev FROM walk QUALIFY row_number() OVER (PARTITION BY pair_id ORDER BY n DESC) = 1),
back AS (
  SELECT pair_id, list_position(best, list_max(best))::BIGINT AS n, prev FROM ends
  UNION ALL
  SELECT pair_id, prev[n], prev FROM back WHERE prev[n] > 0
),
chain AS (SELECT pair_id, i, j, i - j AS d FROM back JOIN ordered USING (pair_id, n)),
runs AS (SELECT *, i - row_number() OVER (PARTITION BY pair_id, d ORDER BY i) AS run FROM chain),
b3 AS (SELECT pair_id, min(i) AS i0, min(j) AS j0, count(*) AS n FROM runs GROUP BY pair_id, d, run),
cut AS (
  SELECT *, greatest(0, coalesce(max(i0 + n + 2) OVER w - i0, 0), coalesce(max(j0 + n + 2) OVER w - j0, 0)) AS c
  FROM b3 WINDOW w AS (PARTITION BY pair_id ORDER BY i0 ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING)
),
blocks AS (SELECT pair_id, i0 + c AS i0, j0 + c AS j0, n + 2 - c AS len FROM cut WHERE n + 2 - c > 0)"""

# one row of the programme a step, all pairs at once; costs in millionths
_TOTALS = f""",
forms AS (SELECT DISTINCT norm, {phonetic_sql('norm')} AS k, {{plain}} AS p, length(norm) AS n FROM vocab),
alike AS (
  SELECT a.norm AS na, b.norm AS nb,
         round(0.65::DOUBLE * (1 - levenshtein(a.p, b.p) / greatest(a.n, b.n, 1))
               + 0.35::DOUBLE * CASE WHEN a.k <> '' AND a.k = b.k THEN 1.0 WHEN a.k <> '' AND left(a.k, 1) = left(b.k, 1) THEN 0.4 ELSE 0 END
               + CASE WHEN a.n >= 3 AND b.n >= 3 AND left(a.norm, 3) = left(b.norm, 3) THEN 0.15 ELSE 0 END, 12) AS x, a.n AS n
  FROM (SELECT DISTINCT s.norm AS na, h.norm AS nb FROM sheet s JOIN heard h USING (pair_id)) JOIN forms a ON a.norm = na JOIN forms b ON b.norm = nb
),
gain AS (
  SELECT na, nb, round_even(1000000 * CASE WHEN na = nb THEN CASE WHEN n >= 4 THEN 2.4 ELSE 2.0 END WHEN x >= 0.65 THEN 1.0 + (x - 0.65) * 2
                                      WHEN x >= 0.35 THEN 0.15 + (x - 0.35) * 1.5 ELSE -0.8 - (0.35 - x) * 1.5 END, 0)::BIGINT AS g FROM alike
),
width AS (SELECT pair_id, max(j) + 1 AS m FROM heard GROUP BY pair_id),
grid AS (
  SELECT pair_id, 0::BIGINT AS i, u.j AS j, CASE WHEN u.j = 0 THEN 0 ELSE -150000 - (u.j - 1) * 20000 END::BIGINT AS d,
         CASE WHEN u.j = 0 THEN -400000 ELSE -1000000000000000 END::BIGINT AS r, -150000 - greatest(u.j - 1, 0) * 20000 AS h
  FROM width JOIN (SELECT DISTINCT pair_id FROM sheet) USING (pair_id), unnest(range(0, m + 1)) AS u(j)
  UNION ALL
  SELECT pair_id, i, j, d, r,
         coalesce(max(greatest(d, r) + j * 20000) OVER (PARTITION BY pair_id ORDER BY j ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING)
                  - 150000 - (j - 1) * 20000, -1000000000000000)::BIGINT AS h
  FROM (
    SELECT o.pair_id, o.i + 1 AS i, o.j,
           CASE WHEN o.j = 0 THEN -400000 - o.i * 80000 ELSE lag(greatest(o.d, o.r, o.h)) OVER (PARTITION BY o.pair_id ORDER BY o.j) + g.g END::BIGINT AS d,
           CASE WHEN o.j = 0 THEN -400000 - o.i * 80000 ELSE greatest(greatest(o.d, o.h) - 400000, o.r - 80000) END::BIGINT AS r
    FROM grid o JOIN sheet s ON s.pair_id = o.pair_id AND s.i = o.i LEFT JOIN heard t ON t.pair_id = o.pair_id AND t.j = o.j - 1
         LEFT JOIN gain g ON g.na = s.norm AND g.nb = t.norm
  )
)
SELECT pair_id, round(greatest(d, r, h) / 1000000, 6)::DOUBLE AS score FROM grid
QUALIFY row_number() OVER (PARTITION BY pair_id ORDER BY i DESC, j DESC) = 1"""

# the oracle's edit distance counts bytes, so the accented letters get one-byte stand-ins
_PLAIN = "translate({0}, 'èéñßêçíäüöóáàâîôûëïúùœæøåì', 'ABCDEFGHIJKLMNOPQRSTUVWXYZ')"

_TOTALS = _TOTALS.replace("{plain}", _PLAIN.format("norm"))

ORACLE = {
    "align_pairs": "WITH " + _PAIRS + " SELECT * FROM pairs",
    "asr_coverage": "WITH " + _TOKENS + """,
s AS (SELECT DISTINCT pair_id, norm FROM sheet),
h AS (SELECT DISTINCT pair_id, norm, 1 AS hit FROM heard)
SELECT pair_id, round(count(hit) / count(*), 6) AS coverage FROM s LEFT JOIN h USING (pair_id, norm)
GROUP BY pair_id HAVING round(count(hit) / count(*), 6) >= 0.15""",
    "fuzzy_token_join": "WITH " + _RAW + "," + vocab_ctes("SELECT raw FROM tb UNION ALL SELECT raw FROM td") + f""",
words AS (SELECT norm, {phonetic_sql('norm')} AS k, {_PLAIN.format('norm')} AS p, length(norm) AS n,
  list_reduce(list_prepend(0::BIGINT, list_transform(string_split(norm, ''), lambda c: 1::BIGINT << (ascii(c) % 61))), lambda x, y: x | y) AS letters
  FROM (SELECT DISTINCT norm FROM vocab)),
a AS (SELECT * FROM words),
cand AS (
  SELECT a.norm AS na, b.norm AS nb, a.k AS ka, b.k AS kb, a.p AS pa, b.p AS pb, a.n AS la, b.n AS lb FROM a JOIN words b ON a.k = b.k AND a.k <> ''
  UNION
  SELECT a.norm, b.norm, a.k, b.k, a.p, b.p, a.n, b.n FROM a JOIN words b ON left(a.norm, 3) = left(b.norm, 3) AND a.n >= 3 AND b.n >= 3
  UNION
  SELECT a.norm, b.norm, a.k, b.k, a.p, b.p, a.n, b.n FROM a JOIN words b ON a.norm = b.norm
  UNION
  SELECT a.norm, b.norm, a.k, b.k, a.p, b.p, a.n, b.n FROM a JOIN words b
    ON left(a.k, 1) = left(b.k, 1) AND a.k <> '' AND least(a.n, b.n) >= 0.78 * greatest(a.n, b.n)
    AND greatest(bit_count(a.letters & ~b.letters), bit_count(b.letters & ~a.letters)) <= 0.22 * greatest(a.n, b.n)
),
sim AS (
  SELECT *, 0.65::DOUBLE * (1 - levenshtein(pa, pb) / greatest(la, lb, 1))
         + 0.35::DOUBLE * CASE WHEN ka <> '' AND ka = kb THEN 1.0 WHEN ka <> '' AND left(ka, 1) = left(kb, 1) THEN 0.4 ELSE 0 END
         + CASE WHEN la >= 3 AND lb >= 3 AND left(na, 3) = left(nb, 3) THEN 0.15 ELSE 0 END AS x
  FROM cand
),
scored AS (
  SELECT na, nb, round(CASE WHEN na = nb THEN CASE WHEN la >= 4 THEN 2.4 ELSE 2.0 END
                            WHEN x >= 0.65 THEN 1.0 + (x - 0.65) * 2 WHEN x >= 0.35 THEN 0.15 + (x - 0.35) * 1.5
                            ELSE -0.8 - (0.35 - x) * 1.5 END, 6)::DOUBLE AS score
  FROM sim
)
SELECT na AS norm_a, nb AS norm_b, score FROM scored WHERE score >= 1 AND na <= nb""",
    "align_blocks": "WITH RECURSIVE " + _BLOCKS + " SELECT * FROM blocks",
    "align_score": "WITH RECURSIVE " + _TOKENS + _TOTALS,
    "match_times": "WITH RECURSIVE " + _BLOCKS + """,
m AS (SELECT pair_id, i0 + o AS i, j0 + o AS j FROM (SELECT *, unnest(range(len)) AS o FROM blocks))
SELECT pair_id, i, j, pos * 400000 AS start_us, greatest(pos * 400000 + 80000, pos * 400000 + 300000) AS end_us,
       greatest(0.15, least(1, (i % 10) / 5))::DOUBLE AS confidence
FROM m JOIN heard USING (pair_id, j)""",
}
