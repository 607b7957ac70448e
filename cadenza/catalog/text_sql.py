"""Token normalisation as SQL, written for the oracle queries."""

from cadenza.functions.text import CONTRACTIONS, ONES, PHONETIC_LETTERS, PHONETIC_RULES, SPACE, SYMBOLS, TENS

WS = SPACE


def _case(subject: str, mapping: dict[str, str]) -> str:
    arms = " ".join(f"WHEN '{k}' THEN '{v}'" for k, v in mapping.items())
    return f"CASE {subject} {arms} ELSE s END"


def _list(words: list[str]) -> str:
    return "[" + ", ".join(f"'{w}'" for w in words) + "]"


def vocab_ctes(raw_source: str) -> str:
    """CTEs ending in ``vocab(raw, part, norm)`` over the distinct ``raw`` of a query."""
    return f"""
v0 AS (SELECT DISTINCT raw FROM ({raw_source})),
v1 AS (SELECT raw, regexp_replace(lower(nfc_normalize(raw)), '^{WS}+|{WS}+$', '', 'g') AS s FROM v0),
v2 AS (SELECT raw, {_case('s', SYMBOLS)} AS s FROM v1),
below_thousand AS (
  SELECT i, CASE WHEN i < 20 THEN {_list(ONES)}[i + 1]
                 WHEN i < 100 THEN {_list(TENS)}[i // 10 - 1] || CASE WHEN i % 10 = 0 THEN '' ELSE {_list(ONES)}[i % 10 + 1] END
                 ELSE {_list(ONES)}[i // 100 + 1] || 'hundred' ||
                      CASE WHEN i % 100 = 0 THEN ''
                           WHEN i % 100 < 20 THEN {_list(ONES)}[i % 100 + 1]
                           ELSE {_list(TENS)}[i % 100 // 10 - 1] || CASE WHEN i % 10 = 0 THEN '' ELSE {_list(ONES)}[i % 10 + 1] END END
            END AS words
  FROM range(1000) t(i)
),
v_pieces AS (
  SELECT raw, unnest(p) AS piece, generate_subscripts(p, 1) AS pos
  FROM (SELECT raw, regexp_extract_all(s, '[0-9]+|[^0-9]+') AS p FROM v2 WHERE regexp_matches(s, '[0-9]'))
),
v_bare AS (
  SELECT raw, pos, piece,
         CASE WHEN regexp_matches(piece, '^[0-9]') THEN regexp_replace(piece, '^0+([0-9])', '\\1') END AS bare
  FROM v_pieces
),
v_num AS (SELECT *, CASE WHEN length(bare) <= 6 THEN CAST(bare AS INTEGER) END AS num FROM v_bare),
v_spelled AS (
  SELECT raw, string_agg(CASE WHEN bare IS NULL THEN piece
                              WHEN num IS NULL THEN bare
                              WHEN num < 1000 THEN lo.words
                              ELSE hi.words || 'thousand' || CASE WHEN num % 1000 = 0 THEN '' ELSE lo.words END END,
                         '' ORDER BY pos) AS s
  FROM v_num LEFT JOIN below_thousand lo ON lo.i = num % 1000 LEFT JOIN below_thousand hi ON hi.i = num // 1000
  GROUP BY raw
),
v3 AS (SELECT v2.raw, coalesce(v_spelled.s, v2.s) AS s FROM v2 LEFT JOIN v_spelled USING (raw)),
v4 AS (SELECT raw, regexp_replace(s, '[^\\p{{L}}\\p{{N}}''’-]', '', 'g') AS s FROM v3),
v5 AS (
  SELECT raw, array_to_string(list_transform(
           list_filter(range(1, length(s) + 1), lambda i: i < 3 OR s[i] <> s[i - 1] OR s[i] <> s[i - 2]),
           lambda i: s[i]), '') AS s
  FROM v4
),
v6 AS (SELECT raw, replace(s, '’', '''') AS s FROM v5),
v7 AS (SELECT raw, {_case("replace(s, '''', '')", CONTRACTIONS)} AS s FROM v6),
vocab AS MATERIALIZED (
  SELECT raw, unnest(p) AS norm, generate_subscripts(p, 1) - 1 AS part
  FROM (SELECT raw, list_filter(string_split(s, ' '), lambda x: x <> '') AS p FROM v7)
)"""


def syllables_sql(word: str) -> str:
    letters = f"regexp_replace(lower({word}), '[^a-z]', '', 'g')"
    stem = f"regexp_replace({letters}, '([^laeiouy]es|ed|[^laeiouy]e)$', '')"
    return f"greatest(1, len(regexp_extract_all({stem}, '[aeiouy]{{1,2}}')))"


def phonetic_sql(word: str) -> str:
    key = f"regexp_replace(upper(replace({word}, 'ß', 'ss')), '[^A-Z]', '', 'g')"
    for pattern, code in PHONETIC_RULES:
        key = f"regexp_replace({key}, '{pattern}', '{code}', 'g')"
    for group, code in PHONETIC_LETTERS.items():
        key = f"regexp_replace({key}, '[{group}]', '{code}', 'g')"
    key = f"regexp_replace({key}, '[A-Z_]', '', 'g')"
    return f"upper(replace(regexp_extract(replace({key}, 'q', 'k~'), '^.{{0,6}}~?'), '~', 's'))"


def split_words(text: str) -> str:
    return f"list_filter(regexp_split_to_array({text}, '{WS}+'), lambda w: w <> '')"
