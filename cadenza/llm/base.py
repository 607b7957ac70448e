"""Small helpers that the operators of this subpackage share."""

from __future__ import annotations

import hashlib
from collections.abc import Iterable, Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: Characters of text that a task holds as Python objects at once.
CHUNK_CHARS = 1_000_000
#: ASCII letters, for lower-casing A-Z and nothing else.
UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
#: Fixed pattern of a word: ASCII digits, lower-case letters, everything beyond ASCII.
WORD = r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+"
#: Maps bytes of a text to bytes of its words: A-Z lower-cased, what is no word to a space.
WORD_BYTES = bytes(
    b + 32 if 65 <= b <= 90 else b if b >= 128 or 48 <= b <= 57 or 97 <= b <= 122 else 32
    for b in range(256)
)


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def ascii_lower(text: Column) -> Column:
    return F.translate(text, UPPER, LOWER)


def fold(doc_id: Column, n: int) -> Column:
    """Remainder of the CRC-32 of the id as text; -1 for a null id."""
    return F.coalesce(F.crc32(doc_id.cast("string")) % n, F.lit(-1)).cast("int")


def row_key() -> Column:
    """Tells apart rows that differ in id or text (nulls included)."""
    return F.md5(F.concat_ws(" ", F.coalesce(F.col("doc_id").cast("string"), F.lit("null")), F.col("text")))


def free_prefix(docs: DataFrame) -> str:
    """Beginning of names that no column of ``docs`` has."""
    prefix = "_x_"
    while any(c.lower().startswith(prefix) for c in docs.columns):
        prefix = "_" + prefix
    return prefix


def sha(data: bytes) -> str:
    return hashlib.sha256(data).hexdigest()


def normal_bytes(text: str | None) -> bytes:
    """The words of a text, each two with one space between."""
    return b" ".join((text or "").encode().translate(WORD_BYTES).split())


def pieces(batches: Iterable[pa.RecordBatch], column: str = "text", size: int = CHUNK_CHARS) -> Iterator[pa.RecordBatch]:
    """Cut batches so that no piece holds many more than ``size`` bytes of ``column``."""
    for batch in batches:
        lengths = pc.binary_length(batch.column(column)).to_pylist()
        begin = held = 0
        for k, length in enumerate(lengths):
            held += length or 0
            if held >= size:
                yield batch.slice(begin, k + 1 - begin)
                begin, held = k + 1, 0
        if begin < len(lengths):
            yield batch.slice(begin)


def key_runs(batches: Iterable[pa.RecordBatch], key: str) -> Iterator[pa.Table]:
    """Tables of the rows that share ``key``; such rows must follow one another."""
    held: list[pa.RecordBatch] = []
    for batch in batches:
        values = batch.column(key).to_numpy(zero_copy_only=False)
        if not len(values):
            continue
        cuts = [0, *(np.flatnonzero(values[1:] != values[:-1]) + 1).tolist(), len(values)]
        for a, b in zip(cuts[:-1], cuts[1:]):
            if held and held[0].column(key)[0].as_py() != values[a]:
                yield pa.Table.from_batches(held)
                held = []
            held.append(batch.slice(a, b - a))
    if held:
        yield pa.Table.from_batches(held)
