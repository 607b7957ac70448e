"""SimHash near-duplicates by tiled exact comparison.

Distinct fingerprints are compared, never copies.  Two of them that differ in at most four
of 64 bits agree in at least one of five bands, so tiles are cut inside (band, value); a
value with many fingerprints is cut further by the number of set bits, and tile pairs whose
numbers differ beyond the radius are never formed.
"""

from __future__ import annotations

from collections.abc import Iterable, Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from cadenza.llm.base import UPPER, free_prefix, key_runs, pieces, row_key
from cadenza.llm.components import Forest, components
from cadenza.session import stage

SHINGLE, SEED, RADIUS = 4, 42, 4
#: Bits of the five bands, lowest first.
BANDS = (13, 13, 13, 13, 12)
#: Fingerprints of a tile.
TILE = 2048
_BLANK = b"\t\n\x0b\x0c\r "
_LOWER = bytes(b + 32 if chr(b) in UPPER else 32 if b in _BLANK else b for b in range(256))
_BYTE_BITS = np.unpackbits(np.arange(256, dtype=np.uint8)[:, None], axis=1, bitorder="little").astype(np.int64)


def fingerprint(text: str | None) -> int:
    """64-bit SimHash over word shingles; 0 without words."""
    data = b" ".join((text or "").encode("utf-8", "surrogatepass").translate(_LOWER).split(b" "))
    data = b" ".join(filter(None, data.split(b" ")))
    if not data:
        return 0
    gaps = np.flatnonzero(np.frombuffer(data, np.uint8) == 32)
    starts = np.concatenate([[0], gaps + 1])
    ends = np.concatenate([gaps, [len(data)]])
    width = min(SHINGLE, len(starts))
    digest = xxhash.xxh64_intdigest
    hashes = [digest(data[a:b], SEED) for a, b in zip(starts[: len(starts) - width + 1].tolist(), ends[width - 1 :].tolist())]
    lanes = np.array(hashes, np.uint64).view(np.uint8).reshape(-1, 8)
    if len(hashes) > 256:
        ones = np.concatenate([np.bincount(lanes[:, k], minlength=256) @ _BYTE_BITS for k in range(8)])
    else:
        ones = np.unpackbits(lanes, axis=1, bitorder="little").sum(axis=0, dtype=np.int64)
    return int.from_bytes(np.packbits(2 * ones > len(hashes), bitorder="little").tobytes(), "little")


def fingerprints(docs: DataFrame) -> DataFrame:
    """(doc_id, key, fp): what tells rows apart, and the bits of the fingerprint as a long."""
    kind = docs.schema["doc_id"].dataType.simpleString()

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in pieces(batches):
            fp = np.array([fingerprint(t) for t in batch.column("text").to_pylist()], np.uint64).view(np.int64)
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), batch.column("key"), pa.array(fp)], ["doc_id", "key", "fp"])

    return docs.select("doc_id", "text", row_key().alias("key")).mapInArrow(run, f"doc_id {kind}, key string, fp long")


def _tile_links(left: np.ndarray, right: np.ndarray, same: bool) -> tuple[np.ndarray, np.ndarray]:
    """A forest of the links between two tiles (or within one), by exclusive-or and bit counts."""
    both = left if same else np.concatenate([left, right])
    shift, forest = 0 if same else len(left), Forest(len(both))
    for at in range(0, len(left), 256):
        near = np.bitwise_count(left[at : at + 256, None] ^ right[None, :]) <= RADIUS
        a, b = np.nonzero(near)
        if a.size:
            forest.add(a + at, b + shift)
    a, b = forest.edges()
    return both[a], both[b]


def link_forest(values: DataFrame) -> DataFrame:
    """(a, b): links between the distinct fingerprints ``fp`` that connect all near ones."""
    begin, bands = 0, []
    for k, width in enumerate(BANDS):
        value = F.shiftrightunsigned("fp", begin).bitwiseAND((1 << width) - 1).cast("int")
        bands.append(F.struct(F.lit(k).alias("band"), value.alias("value")))
        begin += width
    rows = values.select("fp", F.explode(F.array(*bands)).alias("b")).select("fp", "b.*")
    rows = rows.withColumn("ones", F.bit_count("fp").cast("int"))
    sizes = rows.groupBy("band", "value", "ones").agg(F.count("*").alias("n"))
    large = (
        sizes.groupBy("band", "value").agg(F.sum("n").alias("all")).where(F.col("all") > TILE)
    )
    # tiles of a large value: one for each number of set bits and TILE fingerprints
    tiles = stage(
        sizes.join(large, ["band", "value"])
        .select("band", "value", "ones", F.explode(F.sequence(F.lit(0), F.ceil(F.col("n") / TILE).cast("int") - 1)).alias("part"),
                F.ceil(F.col("n") / TILE).cast("int").alias("parts")),
        "tiles",
    )
    left = tiles.select("band", "value", F.col("ones").alias("o1"), F.col("part").alias("p1"))
    right = tiles.select("band", "value", F.col("ones").alias("o2"), F.col("part").alias("p2"))
    pairs = left.join(right, ["band", "value"]).where(
        (F.col("o2") - F.col("o1")).between(0, RADIUS) & ((F.col("o1") < F.col("o2")) | (F.col("p1") <= F.col("p2")))
    ).withColumn("pair", F.xxhash64("band", "value", "o1", "p1", "o2", "p2"))
    parts = tiles.select("band", "value", "ones", "parts").distinct()
    big = rows.join(parts, ["band", "value", "ones"]).withColumn("part", F.pmod(F.xxhash64("fp"), F.col("parts")).cast("int"))
    sides = pairs.select("band", "value", F.col("o1").alias("ones"), F.col("p1").alias("part"), "pair", F.lit(0).alias("side")).union(
        pairs.where((F.col("o1") != F.col("o2")) | (F.col("p1") != F.col("p2")))
        .select("band", "value", F.col("o2").alias("ones"), F.col("p2").alias("part"), "pair", F.lit(1).alias("side"))
    )
    from_big = big.join(sides, ["band", "value", "ones", "part"]).select("pair", "side", "fp")
    is_large = large.select("band", "value", F.lit(True).alias("large"))
    small = rows.join(is_large, ["band", "value"], "left_anti")
    from_small = small.select(
        F.xxhash64("band", "value").alias("pair"), F.lit(0).alias("side"), "fp"
    )
    dealt = from_small.union(from_big).repartition("pair").sortWithinPartitions("pair", "side", "fp")

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for rows in key_runs(batches, "pair"):
            side, fp = rows["side"].to_numpy(), rows["fp"].to_numpy().view(np.uint64)
            same = not side.any()
            left, right = (fp, fp) if same else (fp[side == 0], fp[side == 1])
            if len(fp) > 1:
                a, b = _tile_links(left, right, same)
                if a.size:
                    yield pa.RecordBatch.from_arrays([pa.array(a.view(np.int64)), pa.array(b.view(np.int64))], ["a", "b"])

    return dealt.mapInArrow(run, "a long, b long").distinct()


def near_duplicates(docs: DataFrame) -> DataFrame:
    """doc_id, fingerprint and component_id (smallest id reachable) of each row.

    Null and empty texts have fingerprint zero and link like any other.  Rows with a null id
    take part; the smallest id of a component leaves nulls aside unless there is no other.
    """
    return _grouped(docs).select("doc_id", F.lower(F.lpad(F.hex("fp"), 16, "0")).alias("fingerprint"), "component_id")


def _grouped(docs: DataFrame) -> DataFrame:
    """(doc_id, key, fp, component_id, keeper); keeper is the key of the row that its group keeps."""
    rows = stage(fingerprints(docs), "fingerprints")
    lead = F.struct(F.col("doc_id").isNull(), "doc_id", "key")
    values = stage(rows.groupBy("fp").agg(F.min(lead).alias("lead")), "values")
    linked = components(link_forest(values.select("fp")))
    least = (
        linked.join(values, linked["node"] == values["fp"])
        .groupBy("component").agg(F.min("lead").alias("least"))
    )
    by_value = (
        values.join(linked, values["fp"] == linked["node"], "left")
        .join(least, "component", "left")
        .select("fp", F.coalesce("least", "lead").alias("least"))
        .select("fp", F.col("least.doc_id").alias("component_id"), F.col("least.key").alias("keeper"))
    )
    return rows.join(by_value, "fp").select("doc_id", "key", "fp", "component_id", "keeper")


def keep_one(docs: DataFrame) -> DataFrame:
    """Rows of ``docs`` without near-duplicates: exactly one row of each group stays.

    It is the one with the smallest id, nulls last; of different texts under that id, one
    chosen by hash.  Rows that share an id, or have none, but lie in different groups all
    stay.
    """
    own = free_prefix(docs)
    found = _grouped(docs).where(F.col("key") == F.col("keeper")).select(F.col("key").alias(f"{own}keeper")).distinct()
    keyed = docs.withColumn(f"{own}key", row_key())
    kept = keyed.join(found, F.col(f"{own}key") == F.col(f"{own}keeper"), "left_semi")
    # only rows that repeat an id and its text share a key
    return kept.dropDuplicates([f"{own}key"]).drop(f"{own}key")
