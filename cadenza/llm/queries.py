"""One query for each operator, over its whole table, and SQL where it can say the same."""

from __future__ import annotations

from collections.abc import Callable

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from cadenza.llm import (
    bpe, clusters, decontaminate, language, licenses, linededup, negatives, quality, repeats, secrets, simhash, toxicity, vectors,
)
from cadenza.llm.base import fold, table

#: Vocabulary of the tokenizer; its file is read where it lies.
VOCABULARY = "byte_bpe_multi_50k.tiktoken"


def op1_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    held_out = fold(F.col("doc_id"), 4) == 2
    model = language.fit_language(docs.where(~held_out))
    return language.identify(docs.select("doc_id", "text"), model).select(
        "doc_id", held_out.alias("held_out"), "lang_pred", "score", "n_chars", "entropy", "rejected"
    )


def op2_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text", "source")
    return linededup.remove_boilerplate(docs).select(
        "doc_id", "n_lines", "n_removed", F.sha2(F.coalesce("text", F.lit("")), 256).alias("kept_sha256")
    )


def op3_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    held_out = fold(F.col("doc_id"), 5) == 0
    model = toxicity.fit_toxicity(docs.where(~held_out), table(spark, sf_dir, "labels"))
    scored = toxicity.score_toxicity(docs, model)
    return scored.select("doc_id", held_out.alias("held_out"), "score", "predicted", "ratio")


def op4_license_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    return licenses.scan_licenses(table(spark, sf_dir, "documents")).drop("spans")


def op5_secret_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    return secrets.find_secrets(docs, secrets.fit_network(docs))


def op6_embedding_neardup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return vectors.similar_vectors(table(spark, sf_dir, "embeddings"))


def op7_suffix_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return repeats.remove_repeats(table(spark, sf_dir, "documents")).drop("kept")


def op8_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    return decontaminate.contamination(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))


def op9_simhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    return simhash.near_duplicates(table(spark, sf_dir, "documents"))


def op10_byte_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    return bpe.token_digests(docs, public_tokenizers.path(VOCABULARY), public_tokenizers.PATTERN)


def op11_centroid_clusters(spark: SparkSession, sf_dir: str) -> DataFrame:
    return clusters.cluster_vectors(table(spark, sf_dir, "embeddings"))


def op12_hard_negatives(spark: SparkSession, sf_dir: str) -> DataFrame:
    label = F.when(F.col("vec_id") % 7 == 0, (F.col("label") + 1) % 10).otherwise(F.col("label"))
    rows = table(spark, sf_dir, "embeddings").select("vec_id", "embedding", label.alias("label"))
    return negatives.hard_negatives(rows, F.col("vec_id") % 100 == 0)


def op13_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = quality.ledger(table(spark, sf_dir, "documents"))
    base_failed = ~quality.passes(quality.policy("base"))
    kept = ~base_failed & quality.passes(quality.policy("web"))
    return rows.select(
        "doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words",
        base_failed.alias("base_failed"), kept.alias("kept"), "failed",
    )


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    named = (
        op1_language_id, op2_line_dedup, op3_toxicity, op4_license_scan, op5_secret_scan, op6_embedding_neardup,
        op7_suffix_dedup, op8_decontamination, op9_simhash, op10_byte_bpe, op11_centroid_clusters, op12_hard_negatives, op13_quality_rules,
    )
    return {q.__name__: q for q in named}


OP2_SQL = """
WITH split AS (
  SELECT doc_id, source, text, string_split(text, chr(10)) AS parts FROM documents
), lines AS (
  SELECT doc_id, coalesce(source, '') AS site, u.i AS i, trim(parts[u.i]) AS line
  FROM split, unnest(range(1, len(parts) + 1)) AS u(i)
  WHERE length(trim(parts[u.i])) >= 12
), common AS (
  SELECT line, min((doc_id, i)) AS lead FROM lines GROUP BY line HAVING count(DISTINCT site) >= 10
), gone AS (
  SELECT doc_id, list(i) AS places FROM lines JOIN common USING (line) WHERE (doc_id, i) <> lead GROUP BY doc_id
)
SELECT doc_id, coalesce(len(parts), 0)::BIGINT AS n_lines, coalesce(len(places), 0)::BIGINT AS n_removed,
       sha256(coalesce(array_to_string([p FOR p, k IN parts IF NOT list_contains(coalesce(places, []), k)], chr(10)), '')) AS kept_sha256
FROM split LEFT JOIN gone USING (doc_id)
"""

OP6_SQL = """
WITH RECURSIVE good AS (
  SELECT vec_id, embedding::DOUBLE[] AS e FROM embeddings
  WHERE embedding IS NOT NULL AND len(list_filter(embedding, lambda v: v IS NULL OR isnan(v) OR isinf(v))) = 0
    AND len(list_filter(embedding, lambda v: v <> 0)) > 0
), links AS (
  SELECT a.vec_id AS a, b.vec_id AS b FROM good a JOIN good b ON a.vec_id <> b.vec_id AND len(a.e) = len(b.e)
  WHERE list_cosine_similarity(a.e, b.e) >= 0.9
), reach AS (
  SELECT a, b FROM links UNION SELECT r.a, l.b FROM reach r JOIN links l ON l.a = r.b
), n AS (SELECT a AS vec_id, count(*) AS n_links FROM links GROUP BY a
), c AS (SELECT a AS vec_id, min(b) AS low FROM reach GROUP BY a)
SELECT vec_id, coalesce(n_links, 0)::BIGINT AS n_links, least(vec_id, coalesce(low, vec_id)) AS component_id,
       vec_id = least(vec_id, coalesce(low, vec_id)) AS kept
FROM embeddings LEFT JOIN n USING (vec_id) LEFT JOIN c USING (vec_id)
"""

OP7_SQL = """
WITH h AS (SELECT doc_id, hex(encode(coalesce(text, ''))) AS x, length(hex(encode(coalesce(text, '')))) // 2 AS n FROM documents
), starts AS (
  SELECT doc_id, n, u.i AS i, md5(substr(x, 2 * u.i + 1, 200)) AS w FROM h, unnest(range(0, n - 99)) AS u(i) WHERE n >= 100
), again AS (
  SELECT doc_id, i FROM (SELECT doc_id, i, row_number() OVER (PARTITION BY w ORDER BY doc_id, i) AS k FROM starts) WHERE k > 1
), runs AS (
  SELECT doc_id, i, CASE WHEN i <= lag(i) OVER (PARTITION BY doc_id ORDER BY i) + 100 THEN 0 ELSE 1 END AS new FROM again
), spans AS (
  SELECT doc_id, min(i) AS a, max(i) + 100 AS b
  FROM (SELECT doc_id, i, sum(new) OVER (PARTITION BY doc_id ORDER BY i) AS g FROM runs) GROUP BY doc_id, g
), gaps AS (
  SELECT doc_id, a, b, coalesce(lag(b) OVER (PARTITION BY doc_id ORDER BY a), 0) AS before,
         row_number() OVER (PARTITION BY doc_id ORDER BY a DESC) = 1 AS last FROM spans
), kept AS (
  SELECT doc_id, sum(b - a) AS removed, count(*) AS spans,
         string_agg(substr(x, 2 * before + 1, 2 * (a - before)) || CASE WHEN last THEN substr(x, 2 * b + 1) ELSE '' END, '' ORDER BY a) AS x
  FROM gaps JOIN h USING (doc_id) GROUP BY doc_id
)
SELECT doc_id, n::BIGINT AS n_bytes, coalesce(removed, 0)::BIGINT AS n_removed, coalesce(spans, 0)::BIGINT AS n_spans,
       sha256(unhex(coalesce(kept.x, h.x))) AS kept_sha256
FROM h LEFT JOIN kept USING (doc_id)
"""

OP8_SQL = r"""
WITH d AS (
  SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS w FROM documents
), b AS (
  SELECT item_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS w FROM benchmark
), windows AS (
  SELECT DISTINCT item_id, least(len(w), 10) AS size, array_to_string(w[u.i : u.i + least(len(w), 10) - 1], ' ') AS x
  FROM b, unnest(range(1, len(w) - least(len(w), 10) + 2)) AS u(i) WHERE len(w) > 0
), sizes AS (SELECT DISTINCT size FROM windows
), places AS (
  SELECT doc_id, size, u.i AS i, array_to_string(w[u.i : u.i + size - 1], ' ') AS x
  FROM d JOIN sizes ON len(w) >= size, unnest(range(1, len(w) - size + 2)) AS u(i)
), hits AS (SELECT doc_id, i, size, item_id FROM places JOIN windows USING (size, x)
), words AS (
  SELECT doc_id, count(DISTINCT p) AS n FROM (SELECT DISTINCT doc_id, i, size FROM hits), unnest(range(i, i + size)) AS v(p) GROUP BY doc_id
), items AS (
  SELECT doc_id, count(*) AS n, string_agg(item_id, ',' ORDER BY item_id) AS ids
  FROM (SELECT DISTINCT doc_id, item_id::VARCHAR AS item_id FROM hits) GROUP BY doc_id
)
SELECT doc_id, len(w)::BIGINT AS n_words, coalesce(words.n, 0)::BIGINT AS n_hit, coalesce(items.n, 0)::BIGINT AS n_items,
       sha256(coalesce(ids, '')) AS items_sha256, coalesce(words.n, 0) > 0 AS contaminated
FROM d LEFT JOIN words USING (doc_id) LEFT JOIN items USING (doc_id)
"""


_OP11_ROUND = """, a{n} AS (
  SELECT v.vec_id, min(({distance}, c)) AS best FROM v CROSS JOIN c{n} GROUP BY v.vec_id
), m{n} AS (
  SELECT best[2] AS c, i, ((sum(x[i]) - ((sum(x[i]) % count(*)) + count(*)) % count(*)) / count(*))::BIGINT AS m
  FROM a{n} JOIN v USING (vec_id), unnest(range(1, 65)) AS u(i) GROUP BY ALL
), c{next} AS (
  SELECT c{n}.c, coalesce(z.y, c{n}.y) AS y FROM c{n} LEFT JOIN (SELECT c, list(m ORDER BY i) AS y FROM m{n} GROUP BY c) z USING (c)
)"""
_DISTANCE = "list_sum(list_transform(range(1, 65), lambda i: (x[i] - y[i]) * (x[i] - y[i])))::BIGINT"

#: Three rounds of assignment and floored means, then the last assignment.
OP11_SQL = (
    """
WITH v AS (
  SELECT vec_id, list_transform(embedding, lambda e: floor(64 * e::DOUBLE)::BIGINT) AS x FROM embeddings
  WHERE len(embedding) = 64 AND len(list_filter(embedding, lambda e: e IS NULL OR isnan(e) OR isinf(e))) = 0
), c0 AS (
  SELECT row_number() OVER (ORDER BY h) - 1 AS c, x AS y FROM (SELECT sha256('1:' || vec_id) AS h, x FROM v ORDER BY h LIMIT 16)
)"""
    + "".join(_OP11_ROUND.format(n=n, next=n + 1, distance=_DISTANCE) for n in range(3))
    + f"""
, done AS (SELECT v.vec_id, min(({_DISTANCE}, c)) AS best FROM v CROSS JOIN c3 GROUP BY v.vec_id)
SELECT vec_id, best[2]::INTEGER AS cluster, best[1] AS distance, (sum(best[1]) OVER (PARTITION BY best[2]))::BIGINT AS cluster_inertia,
       (sum(best[1]) OVER ())::BIGINT AS inertia, sha256(array_to_string(y, ',')) AS centroid_sha256
FROM done JOIN c3 ON c3.c = best[2]
"""
)

OP12_SQL = """
WITH v AS (
  SELECT vec_id, CASE WHEN vec_id % 7 = 0 THEN (label + 1) % 10 ELSE label END AS label,
         list_transform(embedding, lambda e: floor(256 * e::DOUBLE)) AS x
  FROM embeddings WHERE label IS NOT NULL AND embedding IS NOT NULL
    AND len(list_filter(embedding, lambda e: e IS NULL OR isnan(e) OR isinf(e))) = 0
), s AS (
  SELECT a.vec_id AS anchor_id, b.vec_id AS id, a.label = b.label AS same, list_inner_product(a.x, b.x)::BIGINT AS score
  FROM v a JOIN v b ON a.vec_id % 100 = 0 AND a.vec_id <> b.vec_id
), p AS (
  SELECT anchor_id, id AS positive_id, score AS positive_score FROM s WHERE same
  QUALIFY row_number() OVER (PARTITION BY anchor_id ORDER BY score DESC, id) <= 5
)
SELECT p.anchor_id, positive_id, (row_number() OVER (PARTITION BY p.anchor_id, positive_id ORDER BY score DESC, id))::INTEGER AS rank,
       id AS negative_id, positive_score, score AS negative_score
FROM p JOIN s ON s.anchor_id = p.anchor_id AND NOT same AND 80 * positive_score <= 100 * score AND score <= positive_score
QUALIFY rank <= 5
"""

OP13_SQL = r"""
WITH d AS (
  SELECT row_number() OVER () AS r, doc_id, coalesce(text, '') AS text, regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+') AS w FROM documents
), lines AS (
  SELECT r, line, count(*) AS n FROM (SELECT r, unnest(string_split(text, chr(10))) AS line FROM d)
  WHERE regexp_matches(line, '[^\x20\x09-\x0D]') GROUP BY ALL
), l AS (
  SELECT r, sum(n) AS n_lines, sum(n * length(line)) AS line_chars, sum(n - 1) AS n_dup, sum((n - 1) * length(line)) AS dup_chars,
         sum(n) FILTER (regexp_matches(line, '^[\x20\x09-\x0D]*[-*•–·]')) AS bullets,
         sum(n) FILTER (regexp_matches(line, '(\.\.\.|…)[\x20\x09-\x0D]*$')) AS ellipses
  FROM lines GROUP BY r
), places AS (
  SELECT r, u.i AS i, w[u.i : u.i + 2] AS x FROM d, unnest(range(1, len(w) - 1)) AS u(i)
), twice AS (
  SELECT r, i FROM places QUALIFY count(*) OVER (PARTITION BY r, x) > 1
), again AS (
  SELECT r, count(DISTINCT i + k) AS n FROM twice, (VALUES (0), (1), (2)) AS o(k) GROUP BY r
), m AS (
  SELECT doc_id, len(w)::BIGINT AS n_words, coalesce(list_sum(list_transform(w, lambda v: length(v))), 0)::BIGINT AS word_chars,
         length(regexp_replace(text, '[^#*$%&|<>]', '', 'g'))::BIGINT AS n_symbols,
         coalesce(n_dup, 0)::BIGINT AS n_dup_lines, coalesce(again.n, 0)::BIGINT AS n_repeat_words,
         coalesce(n_lines, 0) AS n_lines, coalesce(line_chars, 0) AS line_chars, coalesce(dup_chars, 0) AS dup_chars,
         coalesce(bullets, 0) AS bullets, coalesce(ellipses, 0) AS ellipses,
         len(list_filter(w, lambda v: regexp_matches(v, '[^\x00-\x40\x5B-\x60\x7B-\x7F]'))) AS letters,
         len(list_filter(w, lambda v: regexp_full_match(v, '[^a-z]*[A-Z][^a-z]*[A-Z][^a-z]*'))) AS capitals,
         coalesce(list_max(list_transform(w, lambda v: length(v))), 0) AS longest
  FROM d LEFT JOIN l USING (r) LEFT JOIN again USING (r)
), f AS (
  SELECT *, [n_words < 50, 100 * n_repeat_words > 50 * n_words, n_words > 100000, word_chars < 3 * n_words, word_chars > 10 * n_words,
             10 * n_symbols > n_words, 10 * bullets > 9 * n_lines, 10 * ellipses > 3 * n_lines, 10 * letters < 8 * n_words,
             10 * n_dup_lines > 3 * n_lines, 5 * dup_chars > line_chars, 2 * capitals > n_words, longest > 1000,
             word_chars < 2 * n_words, word_chars > 20 * n_words] AS bad
  FROM m
)
SELECT doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, bad[1] OR bad[2] AS base_failed,
       NOT (bad[1] OR bad[2] OR bad[3] OR bad[6] OR bad[7] OR bad[8] OR bad[9] OR bad[11] OR bad[12] OR bad[13] OR bad[14] OR bad[15]) AS kept,
       list_sum(list_transform(range(1, 16), lambda i: CASE WHEN bad[i] THEN (1 << (i - 1)::INTEGER) ELSE 0 END))::BIGINT AS failed
FROM f
"""


def oracle_sql() -> dict[str, str]:
    return {
        "op2_line_dedup": OP2_SQL, "op6_embedding_neardup": OP6_SQL, "op7_suffix_dedup": OP7_SQL, "op8_decontamination": OP8_SQL,
        "op11_centroid_clusters": OP11_SQL, "op12_hard_negatives": OP12_SQL, "op13_quality_rules": OP13_SQL,
    }
