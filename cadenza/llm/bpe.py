"""Byte-level BPE in DuckDB recursive queries, one connection for each Python worker.

Each partition's distinct pieces of text become token-position rows.  A recursive query
joins them with the merge table and contracts each piece's leftmost pair of least rank until
no pair is left; an ordered aggregation of the tokens' bytes decodes.
"""

from __future__ import annotations

import base64
import re
import unicodedata
from collections.abc import Iterable, Iterator

import duckdb
import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import DataFrame

from cadenza.llm.base import pieces, sha

#: Pieces that a worker remembers; it starts anew beyond that.
REMEMBERED = 400_000
#: Pieces and bytes of one query (a longer piece stands alone), and bytes from which a piece
#: takes the query for long ones.
AT_ONCE, BYTES_AT_ONCE, LONG = 20_000, 1_000_000, 64
#: Bytes of text whose pieces are looked up together.
TOGETHER = 4_000_000
#: Code points below this have their classes spelled out, for the faster standard matcher.
LATIN = 0x250

# token-position rows: piece w, place i, token id, next token nx
_SHORT = """
WITH RECURSIVE s(w, i, id, nx, done) AS (
  SELECT w, i, id, nx, false FROM start
  UNION ALL
  SELECT s.w, CASE WHEN s.i > b.place THEN s.i - 1 ELSE s.i END,
         CASE WHEN s.i = b.place + 1 THEN b.rank ELSE s.id END,
         CASE WHEN s.i = b.place - 1 THEN b.rank ELSE s.nx END,
         b.w IS NULL
  FROM s LEFT JOIN (
    SELECT w, (best // 4294967296)::INTEGER AS rank, (best % 4294967296)::INTEGER AS place
    FROM (SELECT s.w, min(m.rank::BIGINT * 4294967296 + s.i) AS best
          FROM s JOIN merges m ON m.pair = s.id::BIGINT * 65536 + s.nx
          WHERE NOT s.done GROUP BY s.w)
  ) b ON b.w = s.w
  WHERE NOT s.done AND (b.w IS NULL OR s.i <> b.place)
)"""
# The same for long pieces, many places at once; i is the token's first byte and a contracted
# token's place keeps -1.  What happens elsewhere reaches a place only through one growing
# token, and no token is longer than {reach} bytes.  So a place is contracted as soon as no
# rank within {reach} bytes before and twice that behind it comes first.  Equal ranks before it do
# no harm where the new token makes no better pair with what stands beside it (calm); of
# a run of overlapping places every second one is taken, once the run's start is settled.
_LONG = """
WITH RECURSIVE s(w, i, id) USING KEY (w, i) AS (
  SELECT w, i, id FROM start
  UNION
  (WITH live AS (
    SELECT w, i, id, lead(id) OVER o AS nx, lead(i) OVER o AS ni, lag(id) OVER o AS pv, lead(id, 2) OVER o AS nn
    FROM recurring.s WHERE id >= 0 WINDOW o AS (PARTITION BY w ORDER BY i)
  ), ranked AS (
    SELECT l.*, m.rank, CASE WHEN NOT m.free THEN m.rank END AS bound,
           lag(m.rank) OVER (PARTITION BY l.w ORDER BY l.i) IS DISTINCT FROM m.rank AS begins
    FROM live l LEFT JOIN merges m ON m.pair = l.id::BIGINT * 65536 + l.nx
  ), judged AS (
    SELECT p.w, p.i, p.ni, p.rank, sum(p.begins::INTEGER) OVER (PARTITION BY p.w ORDER BY p.i) AS run,
           coalesce(least(a.rank, b.rank, c.rank) >= p.rank, true) AS calm
    FROM ranked p
    LEFT JOIN merges a ON a.pair = p.pv::BIGINT * 65536 + p.bound
    LEFT JOIN merges b ON b.pair = p.bound::BIGINT * 65536 + p.nn
    LEFT JOIN merges c ON c.pair = p.bound::BIGINT * 65536 + p.bound
    WHERE p.rank IS NOT NULL
  ), seen AS (
    SELECT *,
           coalesce(min(2 * rank + calm::INTEGER) OVER (PARTITION BY w ORDER BY i RANGE BETWEEN {reach} PRECEDING AND 1 PRECEDING)
                    > 2 * rank, true) AS settled,
           coalesce(min(rank) OVER (PARTITION BY w ORDER BY i RANGE BETWEEN 1 FOLLOWING AND {twice} FOLLOWING)
                    >= rank, true) AS first
    FROM judged
  ), runs AS (
    SELECT *, row_number() OVER r AS nth, first_value(settled) OVER r AS open,
           bool_and(calm) OVER (PARTITION BY w, run) AS even
    FROM seen WINDOW r AS (PARTITION BY w, run ORDER BY i)
  ), chosen AS (
    SELECT w, i, ni, rank FROM runs WHERE first AND open AND (nth = 1 OR (even AND nth % 2 = 1))
  )
  SELECT w, i, rank AS id FROM chosen UNION ALL SELECT w, ni, -1 FROM chosen)
), s_done AS (SELECT w, i, id FROM s WHERE id >= 0)"""
_RESULT = """
SELECT w, string_agg(t.mark, ',' ORDER BY i) AS marks
FROM {table} s JOIN tokens t ON t.id = s.id {where} GROUP BY w"""


def read_ranks(path: str) -> dict[bytes, int]:
    with open(path, "rb") as lines:
        return {base64.b64decode(token): int(rank) for token, rank in map(bytes.split, lines)}


def _latin(pattern: str) -> re.Pattern | None:
    """The split pattern for texts below LATIN, with classes spelled out; None if it differs."""
    known = r"""'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"""
    if pattern != known:
        return None
    by: dict[str, str] = {"L": "", "N": "", "Z": ""}
    for c in map(chr, range(LATIN)):
        kind = "Z" if c in "\t\n\x0b\x0c\r\x85" or unicodedata.category(c)[0] == "Z" else unicodedata.category(c)[0]
        if kind in by:
            by[kind] += re.escape(c)
    space, letter, number = by["Z"], by["L"], by["N"]
    return re.compile(
        f" ?[{letter}]+|'(?:s|t|re|ve|m|ll|d)| ?[{number}]+| ?[^{space}{letter}{number}]+|[{space}]+(?![^{space}])|[{space}]+"
    )


def _portions(todo: list[tuple[str, bytes]]) -> Iterator[list[tuple[str, bytes]]]:
    part, size = [], 0
    for word, data in todo:
        if part and (len(part) == AT_ONCE or size + len(data) > BYTES_AT_ONCE):
            yield part
            part, size = [], 0
        part.append((word, data))
        size += len(data)
    if part:
        yield part


class Codec:
    """Encodes and decodes pieces of text; remembers what it has met."""

    def __init__(self, ranks: dict[bytes, int], pattern: str):
        self.ranks = ranks
        self.any, self.latin = regex.compile(pattern), _latin(pattern)
        self.above = re.compile(f"[^\x00-{chr(LATIN - 1)}]")
        self.byte = np.array([ranks[bytes([b])] for b in range(256)], np.int32)
        self.ids: dict[str, bytes] = {}
        self.decoded: dict[str, bytes] = {}
        pair, rank, least = [], [], {}
        for token, r in ranks.items():
            for k in range(1, len(token)):
                a, b = ranks.get(token[:k]), ranks.get(token[k:])
                if a is not None and b is not None:
                    pair.append(a * 65536 + b)
                    rank.append(r)
                    least[a], least[b] = min(r, least.get(a, r)), min(r, least.get(b, r))
        if len(ranks) >= 65536:
            raise ValueError("token ids take 16 bits here")
        reach = max(map(len, ranks))
        self.short = _SHORT + _RESULT.format(table="s", where="WHERE done")
        self.long = _LONG.format(reach=reach, twice=2 * reach) + _RESULT.format(table="s_done", where="")
        self.base = duckdb.connect(config={"threads": 1, "memory_limit": "400MB", "temp_directory": ""})
        merges = pa.table({"pair": pa.array(pair, pa.int64()), "rank": pa.array(rank, pa.int32()),
                           "free": pa.array([least.get(r, r + 1) > r for r in rank])})
        # a token's id and its bytes, so that one ordered aggregation brings both
        tokens = pa.table({"id": pa.array(list(ranks.values()), pa.int32()), "mark": [f"{r},{t.hex()}" for t, r in ranks.items()]})
        for name, rows in (("merges", merges), ("tokens", tokens)):
            self.base.register("given", rows)
            self.base.execute(f"CREATE TABLE {name} AS SELECT * FROM given")
            self.base.unregister("given")

    def split(self, text: str) -> list[str]:
        latin = self.latin is not None and not self.above.search(text)
        return (self.latin if latin else self.any).findall(text)

    def _query(self, words: list[bytes], query: str) -> Iterator[tuple[int, str]]:
        lengths = np.array([len(w) for w in words], np.int64)
        ids = self.byte[np.frombuffer(b"".join(words), np.uint8)]
        ends = np.cumsum(lengths)
        owner = np.repeat(np.arange(len(words), dtype=np.int32), lengths)
        place = (np.arange(len(ids)) - (ends - lengths)[owner]).astype(np.int32)
        after = np.append(ids[1:], -1).astype(np.int32)
        after[ends - 1] = -1
        self.base.register("start", pa.table({"w": owner, "i": place, "id": ids, "nx": after}))
        got = self.base.execute(query).fetchnumpy()
        self.base.unregister("start")
        return zip(got["w"].tolist(), got["marks"].tolist())

    def learn(self, words: list[str]) -> None:
        """Remember ids and decoded bytes of distinct pieces that are not known yet."""
        by_query: dict[str, list[tuple[str, bytes]]] = {self.short: [], self.long: []}
        for word in words:
            data = word.encode("utf-8", "surrogatepass")
            if (rank := self.ranks.get(data)) is not None:  # a piece that is a token is not merged
                self.ids[word], self.decoded[word] = b"%d" % rank, data
            else:
                by_query[self.long if len(data) > LONG else self.short].append((word, data))
        for query, todo in by_query.items():
            for part in _portions(todo):
                for w, marks in self._query([data for _, data in part], query):
                    marks = marks.split(",")
                    self.ids[part[w][0]] = ",".join(marks[::2]).encode()
                    self.decoded[part[w][0]] = bytes.fromhex("".join(marks[1::2]))

    def encode(self, texts: list[str]) -> Iterator[tuple[int, bytes, bytes]]:
        """Number of ids, ids joined by commas, and decoded bytes of each text."""
        split = [self.split(t) for t in texts]
        new = set().union(*split).difference(self.ids)
        if len(self.ids) + len(new) > REMEMBERED:
            self.ids, self.decoded = {}, {}
            new = set().union(*split)
        self.learn(sorted(new))
        for words in split:
            ids = b",".join(map(self.ids.__getitem__, words))
            yield (ids.count(b",") + 1 if words else 0), ids, b"".join(map(self.decoded.__getitem__, words))


_CODECS: dict[tuple[str, str], Codec] = {}


def codec(path: str, pattern: str) -> Codec:
    """One codec for each worker process and vocabulary."""
    if (path, pattern) not in _CODECS:
        _CODECS[path, pattern] = Codec(read_ranks(path), pattern)
    return _CODECS[path, pattern]


def encode_documents(docs: DataFrame, path: str, pattern: str, keep: tuple[str, ...] = ("doc_id",)) -> DataFrame:
    """Columns ``keep``, ids (array of int) and decoded text of each row, for storing.

    A null text is empty: no ids and an empty decoded text.  Repeated rows give repeated
    rows, no rows no rows.  Texts of any length are encoded whole, in time that grows with
    their length also where no space breaks them.
    """
    kinds = ", ".join(f"`{k}` {docs.schema[k].dataType.simpleString()}" for k in keep)

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in pieces(batches, size=TOGETHER):
            got = list(codec(path, pattern).encode([t or "" for t in batch.column("text").to_pylist()]))
            ids = [np.array(i.split(b","), np.int32) if i else np.zeros(0, np.int32) for _, i, _ in got]
            yield pa.RecordBatch.from_arrays(
                [*(batch.column(k) for k in keep), pa.array(ids, pa.list_(pa.int32())),
                 pa.array([d.decode("utf-8", "replace") for _, _, d in got])],
                [*keep, "ids", "decoded"],
            )

    return docs.select(*keep, "text").mapInArrow(run, f"{kinds}, ids array<int>, decoded string")


def token_digests(docs: DataFrame, path: str, pattern: str) -> DataFrame:
    """doc_id, n_tokens, ids_sha256 and decoded_sha256 of each row, as ``encode_documents`` gives them."""
    kind = docs.schema["doc_id"].dataType.simpleString()

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in pieces(batches, size=TOGETHER):
            got = [(n, sha(i), sha(d)) for n, i, d in codec(path, pattern).encode([t or "" for t in batch.column("text").to_pylist()])]
            n, ids, decoded = zip(*got)
            yield pa.RecordBatch.from_arrays(
                [batch.column("doc_id"), pa.array(n, pa.int64()), pa.array(ids), pa.array(decoded)],
                ["doc_id", "n_tokens", "ids_sha256", "decoded_sha256"],
            )

    return docs.select("doc_id", "text").mapInArrow(
        run, f"doc_id {kind}, n_tokens long, ids_sha256 string, decoded_sha256 string"
    )
