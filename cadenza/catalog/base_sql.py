"""The adapters of ``cadenza.sources.testbed`` as SQL, for the oracle queries."""

TIMED_WORDS = """
timed_words AS (
  SELECT user_id AS track_id,
         row_number() OVER (PARTITION BY user_id ORDER BY ts, event_id) - 1 AS n,
         (epoch_us(ts) - min(epoch_us(ts)) OVER (PARTITION BY user_id)) // 3600 AS start_us,
         (epoch_us(ts) - min(epoch_us(ts)) OVER (PARTITION BY user_id)) // 3600
           + CAST(round(value * 100000) AS BIGINT) AS end_us,
         event_type AS text,
         CAST(event_id % 100 AS DOUBLE) / 100 AS confidence,
         event_id
  FROM events
)"""

CAPTIONS = TIMED_WORDS + """,
captions AS (
  SELECT track_id, n AS idx, start_us, end_us,
         CASE WHEN text = 'error' THEN '♪'
              WHEN event_id % 29 = 0 THEN 'Instrumental break'
              ELSE text || ' take ' || CAST(event_id % 23 AS VARCHAR) || ' don''t fade' END AS text,
         text = 'error' AS instrumental, confidence, event_id
  FROM timed_words
)"""

LINE_WORDS = TIMED_WORDS + """,
line_words AS (
  SELECT track_id, n // 5 AS line_index, n % 5 AS k, n, text, start_us, end_us, confidence,
         confidence >= 0.3 AS matched, event_id
  FROM timed_words
)"""

DURATIONS = """,
durations AS (
  SELECT track_id, max(end_us) // 1000000 * 1000000 AS duration_us FROM timed_words GROUP BY track_id
)"""

SHEETS = """
sheets AS (
  SELECT doc_id,
         '## title: ' || source || chr(10) || '[' || lang || ']' || chr(10) ||
         array_to_string(list_transform(string_split(text, chr(10)),
           lambda x, i: CASE WHEN i % 4 = 0 THEN x || chr(10) ELSE x END), chr(10)) AS text
  FROM documents
)"""
