"""Aligning reference text with transcripts.

Token tables are ``ref[pair_id, i, norm, phonetic]`` and ``hyp[pair_id, j, norm, phonetic]``.
Everything grouped by pair is bounded by the two texts of that pair.
"""

from __future__ import annotations

import sys
from collections.abc import Iterator
from decimal import ROUND_HALF_UP, Decimal
from functools import cached_property

import numpy as np
import pandas as pd
import pyarrow as pa
import pyarrow.compute as pc
from pyspark import cloudpickle
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, DoubleType, LongType, StringType, StructType

from cadenza.functions.text import words_of
from cadenza.operators.text import token_forms
from cadenza.plans.skew import grown
from cadenza.session import configure, stage

# the Arrow function travels with the job, so executors need no copy of this package
cloudpickle.register_pickle_by_value(sys.modules[__name__])

# Fixed values of token similarity and of the gap costs (per gap: opening, each further token).
EXACT, LONG_BONUS, LONG_LENGTH = 2.0, 0.4, 4
EDIT_SHARE, SOUND_SHARE, SAME_FIRST_SOUND, PREFIX_BONUS, PREFIX = 0.65, 0.35, 0.4, 0.15, 3
STRONG, WEAK = 0.65, 0.35
REF_GAP, HYP_GAP = (-0.40, -0.08), (-0.15, -0.02)
LANDMARK_REWARD = 4.0
MIN_COVERAGE = 0.15
SCALE = 1_000_000
_NEVER = -(10**15)

# Cells whose ways are held at once, stretches that a longer programme is cut into, and bytes
# of similarities that are kept.
CELLS, PARTS, KEPT_BYTES = 4_000_000, 8, 64_000_000

SEED = 3
COMMON_SHARE = 10_000
# Rows of one key that one task of a token join takes, keys above that which are broadcast, pairs
# compared at once, tokens of a tile, pairs of a batch, and letters of the longest token held as bits.
GROUP_ROWS, HOT_KEYS, COMPARED = 1_000, 10_000, 131_072
TILE, BATCH_ROWS, LONG = 512, 500_000, 64


# --- which texts belong together -----------------------------------------------------


def wide_hash(*values: Column) -> Column:
    """128 bits of hash."""
    return F.struct(F.xxhash64(*values).alias("a"), F.xxhash64(F.lit("#"), *values).alias("b"))


def word_runs(k: int) -> Column:
    """Hashes of the runs of ``k`` words in array ``w``; null for fewer words."""
    runs = F.transform(
        F.sequence(F.lit(0), F.size("w") - k),
        lambda p: wide_hash(*[F.get("w", p + d) for d in range(k)]),
    )
    return F.when(F.size("w") >= k, runs)


def shingles(texts: DataFrame, idents: list[str], runs: Column) -> DataFrame:
    """``runs`` of lower-case words of each text as hashes, repeats included."""
    hashed = F.transform(words_of(F.lower("text")), lambda w: F.xxhash64(w))
    return texts.select(*idents, hashed.alias("w")).select(*idents, F.explode(runs).alias("s"))


def align_pairs(ref: DataFrame, hyp: DataFrame, k: int = 5, least: float = 0.5) -> DataFrame:
    """Pairs where at least the share ``least`` of the reference's word runs occurs in a transcript.

    ``ref[ref_id, text]``, ``hyp[hyp_id, text]``.  The transcripts are read once and reduced
    to the runs that occur in some reference; texts themselves are never shuffled.  Exact
    copies are then treated as one and multiplied at the end.  A pair that reaches the
    share must have one of the reference's rarest runs in common, so only those go through
    the candidate join; runs found everywhere never meet.  A reference of fewer than ``k``
    words, but not none, is one run.
    """
    whole_or_k = F.coalesce(*[F.when(F.size("w") == m, word_runs(m)) for m in range(1, k)], word_runs(k))
    ref_runs = stage(shingles(ref, ["ref_id"], whole_or_k).distinct(), "ref-shingles")
    # at most k numbers: the lengths of run that occur in references
    sizes = ref.select(F.least(F.lit(k), F.size(words_of(F.lower("text")))).alias("m")).distinct()
    lengths = sorted(r["m"] for r in sizes.collect() if r["m"] and r["m"] > 0) or [k]
    every_length = F.flatten(F.array_compact(F.array(*[word_runs(m) for m in lengths])))
    content = hyp.select("hyp_id", "text", wide_hash(F.col("text")).alias("h"))
    known = stage(
        shingles(content, ["hyp_id", "h"], every_length).join(ref_runs.select("s").distinct(), ["s"], "left_semi"),
        "known-shingles",
    )
    copies = known.select("h", "hyp_id").distinct()
    held = known.select("h", "s").distinct()
    spread = held.groupBy("s").agg(F.count(F.lit(1)).alias("df"))
    # a reference is one row of text, so these windows are bounded by it
    whole = Window.partitionBy("ref_id")
    ranked = (
        ref_runs.join(spread, ["s"], "left")
        .withColumn("df", F.coalesce("df", F.lit(0)))
        .withColumns({"rank": F.row_number().over(whole.orderBy("df", "s")), "n": F.count(F.lit(1)).over(whole)})
    )
    ranked = stage(ranked, "ranked-shingles")
    needed = F.ceil(F.col("n") * least)
    rare = ranked.filter((F.col("rank") <= F.col("n") - needed + 1) & (F.col("df") > 0))
    candidates = rare.select("ref_id", "s").join(held, ["s"]).select("ref_id", "h").distinct()
    shared = (
        candidates.join(ranked.select("ref_id", "s", "n"), ["ref_id"])
        .join(held, ["h", "s"])
        .groupBy("ref_id", "h", "n")
        .agg(F.count(F.lit(1)).alias("c"))
        .filter(F.col("c") >= F.col("n") * least)
    )
    return shared.join(copies, ["h"]).select(
        "ref_id", "hyp_id", F.round(F.col("c") / F.col("n"), 6).alias("containment")
    )


def tokens(texts: DataFrame, ident: str, position: str) -> DataFrame:
    return texts.select(ident, F.posexplode(words_of(F.col("text"))).alias(position, "raw")).withColumn(
        position, F.col(position).cast("bigint")
    )


def normalize_tokens(
    rows: DataFrame,
    vocabulary: DataFrame,
    first_part_only: bool,
    columns: tuple[str, ...] = ("part", "norm", "phonetic"),
) -> DataFrame:
    """Attach norm and phonetic key from a ``token_dim`` table.

    Tokens that the table does not list are normalised here, once each; only tokens whose
    normal form is empty leave.  The reference side keeps every part of a contraction, the
    transcript side the first.  Tokens that make up at least a ten-thousandth of the table's
    text, at most ten thousand of them, are broadcast; the shuffle then has no hot word left.
    """
    new = rows.select("raw").distinct().join(grown(vocabulary.select("raw").distinct()), ["raw"], "left_anti")
    # read by both branches below, and dear to make
    new = stage(token_forms(new.withColumn("freq", F.lit(0).cast("bigint"))), "new-forms")
    wanted = ["raw", "freq", *dict.fromkeys(("part", *columns))]
    parts = vocabulary.select(*wanted).unionByName(new.select(*wanted))
    parts = parts.filter("part = 0") if first_part_only else parts
    total = vocabulary.filter("part = 0").agg(F.sum("freq").alias("all")).scalar()
    common = F.coalesce(F.col("freq") * COMMON_SHARE >= total, F.lit(False)) & (F.col("freq") > 0)
    parts = parts.select("raw", *columns, common.alias("common"))
    frequent = F.broadcast(parts.filter("common").drop("common"))
    rare = parts.filter("not common").drop("common")
    rest = rows.join(F.broadcast(frequent.select("raw").distinct()), ["raw"], "left_anti")
    return rows.join(frequent, ["raw"]).unionByName(rest.join(grown(rare), ["raw"]))


def asr_coverage(pairs: DataFrame, ref: DataFrame, hyp: DataFrame, least: float = MIN_COVERAGE) -> DataFrame:
    """Share of a sheet's distinct words that its transcript contains.

    ``pairs[pair_id, ref_id, hyp_id]``, ``ref[ref_id, norm]``, ``hyp[hyp_id, norm]``.
    """
    sheet = pairs.join(ref.select("ref_id", "norm").distinct(), ["ref_id"])
    heard = hyp.join(pairs.select("hyp_id").distinct(), ["hyp_id"], "left_semi").select(
        "hyp_id", "norm", F.lit(1).alias("heard")
    ).distinct()
    both = sheet.join(heard, ["hyp_id", "norm"], "left")
    share = F.count("heard") / F.count(F.lit(1))
    return both.groupBy("pair_id").agg(F.round(share, 6).alias("coverage")).filter(F.col("coverage") >= least)


# --- token similarity ------------------------------------------------------------------


def likeness(norm_a: Column, norm_b: Column, key_a: Column, key_b: Column) -> Column:
    """Weighted share of equal letters and sounds, with a bonus for an equal start."""
    return _likeness(norm_a, norm_b, key_a, key_b, F.levenshtein(norm_a, norm_b))


def _likeness(norm_a: Column, norm_b: Column, key_a: Column, key_b: Column, edits: Column) -> Column:
    longest = F.greatest(F.length(norm_a), F.length(norm_b), F.lit(1))
    sound = (
        F.when((key_a != "") & (key_a == key_b), 1.0)
        .when((key_a != "") & (F.substring(key_a, 1, 1) == F.substring(key_b, 1, 1)), SAME_FIRST_SOUND)
        .otherwise(0.0)
    )
    prefix = F.when(_same_start(norm_a, norm_b), PREFIX_BONUS).otherwise(0.0)
    return EDIT_SHARE * (1 - edits / longest) + SOUND_SHARE * sound + prefix


def _same_start(norm_a: Column, norm_b: Column) -> Column:
    return (
        (F.length(norm_a) >= PREFIX)
        & (F.length(norm_b) >= PREFIX)
        & (F.substring(norm_a, 1, PREFIX) == F.substring(norm_b, 1, PREFIX))
    )


def graded(alike: Column) -> Column:
    """Likeness on the scoring scale, in three bands."""
    return (
        F.when(alike >= STRONG, 1.0 + (alike - STRONG) * 2.0)
        .when(alike >= WEAK, 0.15 + (alike - WEAK) * 1.5)
        .otherwise(-0.8 - (WEAK - alike) * 1.5)
    )


def similarity(norm_a: Column, norm_b: Column, key_a: Column, key_b: Column) -> Column:
    """Score of two tokens: above 1 alike, 0.15 to 0.6 doubtful, below -0.8 different."""
    alike = likeness(norm_a, norm_b, key_a, key_b)
    return F.when(norm_a == norm_b, exact_score(norm_a)).otherwise(graded(alike))


def exact_score(norm: Column) -> Column:
    return EXACT + F.when(F.length(norm) >= LONG_LENGTH, LONG_BONUS).otherwise(0.0)


def _grouped(left: DataFrame, right: DataFrame, rows: int | None = None, *order: str) -> DataFrame:
    """Rows ``[group, norm, key]`` of both sides, sorted by group, in it by side, and then by ``order``.

    A group with more left rows than ``rows`` (``GROUP_ROWS``) is dealt to several, with a copy of its right rows each.  The
    tables are small beside the pairs they make, so their number of partitions is set here
    and not left to their size.
    """
    spark = left.sparkSession
    rows = rows or GROUP_ROWS
    n = max(int(spark.conf.get("spark.sql.shuffle.partitions")), 4 * spark.sparkContext.defaultParallelism)
    sizes = left.groupBy("group").agg(F.count(F.lit(1)).alias("__rows")).filter(F.col("__rows") > rows)
    hot = stage(sizes.select("group", F.ceil(F.col("__rows") / F.lit(rows)).cast("int").alias("__parts")), "hot-keys")
    if hot.limit(HOT_KEYS + 1).count() <= HOT_KEYS:
        hot = F.broadcast(hot)
    parts = F.coalesce("__parts", F.lit(1))
    dealt = left.join(hot, "group", "left").withColumn("part", F.pmod(F.xxhash64("norm"), parts).cast("int"))
    copies = right.join(hot, "group", "left").withColumn("part", F.explode(F.sequence(F.lit(0), parts - 1)))
    sided = lambda df, side: df.select(F.xxhash64("group", "part").alias("group"), F.lit(side).cast("byte").alias("side"), "norm", "key")
    return sided(dealt, 0).unionByName(sided(copies, 1)).repartition(n, "group").sortWithinPartitions("group", "side", *order)


def _segments(need: float) -> dict[str, Column]:
    """Edits that a token of length ``__n`` and a shorter one may differ by, and segment ``__g`` of it.

    The segments, one for each edit, divide what follows the first three letters.
    """
    edits = F.floor(F.col("__n") * (1.0 - need) + 1e-9).cast("int")
    rest = F.col("__n") - PREFIX
    cut = lambda g: PREFIX + F.floor(rest * g / edits).cast("int")
    return {"edits": edits, "from": cut(F.col("__g")), "to": cut(F.col("__g") + 1)}


def _near_first_sound(longer: DataFrame, shorter: DataFrame, need: float) -> DataFrame:
    """Tokens that may have one first sound, no common start and the share ``need`` of equal letters, by group.

    ``longer`` tokens are as long as the ``shorter`` ones or longer.  Tokens with different
    first three letters have an edit there.  With as many segments of the rest of the longer one as
    there may be edits, the first segment at which edits so far fall behind the parts so far
    is free of edits, with one edit before it for each part before it.  So the shorter token has it
    too, shifted by no more than those, and from the end by no more than what edits are left.
    """
    at = _segments(need)
    segment, left = F.col("__g"), at["edits"] - 1 - F.col("__g")
    group = lambda seg: F.xxhash64(F.substring("key", 1, 1), "__n", "__g", seg).alias("group")
    size = F.length("norm")
    cut = (
        longer.filter("key <> ''").withColumn("__n", size).filter(at["edits"] >= 1)
        .withColumn("__g", F.explode(F.sequence(F.lit(0), at["edits"] - 1)))
        .select(group(F.substring(F.col("norm"), at["from"] + 1, at["to"] - at["from"])), "norm", "key")
    )
    tried = (
        shorter.filter("key <> ''")
        .withColumn("__n", F.explode(F.sequence(size, F.greatest(size, F.floor(size / F.lit(need) + 1e-9).cast("int")))))
        .filter((at["edits"] >= 1) & (F.col("__n") - size <= at["edits"]))
        .withColumn("__g", F.explode(F.sequence(F.lit(0), at["edits"] - 1)))
        .withColumn("__low", F.greatest(-segment - 1, size - F.col("__n") - left))
        .withColumn("__high", F.least(segment + 1, size - F.col("__n") + left))
        .filter("__low <= __high")
        .withColumn("__shift", F.explode(F.sequence(F.col("__low"), F.col("__high"))))
        .withColumn("__at", at["from"] + F.col("__shift"))
        .filter((F.col("__at") >= 0) & (F.col("__at") + at["to"] - at["from"] <= size))
        .select(group(F.substring(F.col("norm"), F.col("__at") + 1, at["to"] - at["from"])), "norm", "key")
    )
    return _grouped(cut, tried)


class _Words:
    """Tokens of a batch as numbers for letters, keys and first sounds; letters of long tokens are left out."""

    def __init__(self, rows: pa.Table):
        self.norms = rows["norm"].combine_chunks()
        self.lengths = pc.utf8_length(self.norms).to_numpy().astype(np.int64)
        self.rank = pc.rank(self.norms, tiebreaker="dense").to_numpy().astype(np.int64)
        keys = pc.fill_null(rows["key"].combine_chunks(), "")
        self.keys = pc.dictionary_encode(keys).indices.to_numpy()
        self.sounds = _codes(keys, 1)[:, 0]
        codes = _codes(self.norms, int(min(self.lengths.max(initial=1), LONG)))
        # the start's letters as one number; tokens without a whole start have numbers of their own
        letters = _codes(self.norms, PREFIX).astype(np.uint64)
        self.starts = letters[:, 0] << np.uint64(42) | letters[:, 1] << np.uint64(21) | letters[:, 2]
        short = np.flatnonzero(self.lengths < PREFIX)
        self.starts[short] = np.uint64(1 << 63) + short.astype(np.uint64)
        known = np.zeros(int(codes.max(initial=0)) + 1, dtype=bool)
        known[codes] = True
        # a row for each place, so that a place's letters lie together
        self.letters = np.ascontiguousarray((np.cumsum(known) - 1)[codes].T)
        self.alphabet = int(known.sum())
        self.codes = codes

    def places(self, kind: type, used: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """For each used token and letter the bits of its places, and where each token's begin."""
        mine = np.flatnonzero(np.bincount(used, minlength=len(self.lengths)))
        table = np.zeros((len(mine), self.alphabet), dtype=kind)
        for at in range(int(self.lengths[mine].max(initial=0))):
            some = np.flatnonzero(self.lengths[mine] > at)
            table[some, self.letters[at, mine[some]]] |= kind(1 << at)
        begins = np.zeros(len(self.lengths), dtype=np.int64)
        begins[mine] = np.arange(len(mine)) * self.alphabet
        return table.ravel(), begins

    @cached_property
    def found(self) -> tuple[np.ndarray, np.ndarray]:
        """Bits for letters found at all and found again, by the last six bits of their codes."""
        once, twice = (np.zeros(len(self.lengths), dtype=np.uint64) for _ in range(2))
        for at in range(self.codes.shape[1]):
            some = np.flatnonzero(self.lengths > at)
            bit = np.uint64(1) << (self.codes[some, at] & np.uint32(63)).astype(np.uint64)
            twice[some] |= once[some] & bit
            once[some] |= bit
        return once, twice

    def sound(self, i: np.ndarray, j: np.ndarray) -> np.ndarray:
        """2 for equal keys, 1 for equal first sounds, else 0."""
        first = (self.sounds[i] != 0) & (self.sounds[i] == self.sounds[j])
        return first.astype(np.int8) + (first & (self.keys[i] == self.keys[j]))


def _codes(texts: pa.Array, width: int) -> np.ndarray:
    """The first ``width`` letters of each text, zeros behind its end."""
    cut = pc.utf8_slice_codeunits(texts, 0, width)
    # all texts are decoded at once, not one by one
    letters = b"".join(pc.binary_join(pa.ListArray.from_arrays(pa.array([0, len(cut)], pa.int32()), cut.cast(pa.binary())), b"").to_pylist())
    letters = letters.decode("utf-8", "surrogatepass").encode("utf-32-le", "surrogatepass")
    out = np.zeros((len(cut), width), dtype=np.uint32)
    out[np.arange(width) < pc.utf8_length(cut).to_numpy()[:, None]] = np.frombuffer(letters, dtype=np.uint32)
    return out


def _kind(length: int) -> type:
    return np.uint8 if length <= 8 else np.uint16 if length <= 16 else np.uint32 if length <= 32 else np.uint64


def _advance(eq: np.ndarray, rises: np.ndarray, stays: np.ndarray) -> None:
    """One letter of every text: bits say where the distance rises, and where it does not fall, from one place of the pattern to the next."""
    same = eq & rises
    same += rises
    same ^= rises
    same |= eq
    np.bitwise_or(same, rises, out=eq)
    eq &= stays
    eq += eq  # where the distance does not rise with this letter
    np.bitwise_and(same, rises, out=rises)
    rises += rises
    np.invert(same, out=same)
    same &= stays
    np.bitwise_or(eq, same, out=stays)
    eq &= same
    rises |= eq


def _levels(words: _Words, rows: np.ndarray) -> list[tuple]:
    """Letters behind the common start of tokens sorted by length, place by place; neighbours that begin alike share a row.

    A level says which tokens end before it, in which rows, from which rows the next ones
    come (nothing if from each its own), and their letters.
    """
    lengths = words.lengths[rows] - PREFIX
    row, count, begin, out = np.zeros(len(rows), dtype=np.int64), 1, 0, []
    differ = np.zeros(len(rows), dtype=bool)
    for step in range(int(lengths[-1]) + 1):
        end = int(np.searchsorted(lengths, step, side="right"))
        ended = row[begin:end].copy()
        if end == len(rows):
            out.append((begin, end, ended, None, None))
            break
        letters = words.letters[PREFIX + step].take(rows)
        differ[1:] |= letters[1:] != letters[:-1]
        fresh = differ[end:].copy()
        fresh[0] = True
        first = np.flatnonzero(fresh) + end
        before = row[first]
        own = len(before) == count and before[0] == 0 and before[-1] == count - 1 and bool((np.diff(before) == 1).all())
        out.append((begin, end, ended, None if own else before, letters[first]))
        row[end:] = np.cumsum(fresh) - 1
        count, begin = len(first), end
    return out


def _columns(words: _Words, rows: np.ndarray, width: int) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray]]:
    """Tokens sorted by length, by the bits they need and up to ``width`` at a time, with the bits of each letter's places and of all places."""
    rows = rows[np.argsort(words.lengths[rows], kind="stable")]
    sizes = words.lengths[rows] - PREFIX
    needed = np.searchsorted([8, 16, 32], sizes)
    for bits in np.unique(needed).tolist():
        first, last = (int(np.searchsorted(needed, bits, side=side)) for side in ("left", "right"))
        for begin in range(first, last, width):
            some, m = rows[begin : min(begin + width, last)], sizes[begin : min(begin + width, last)]
            kind = _kind(int(m[-1]))
            places = np.zeros((words.alphabet, len(some)), dtype=kind)
            for at in range(int(m[-1])):
                held = np.flatnonzero(m > at)
                places[words.letters[PREFIX + at, some[held]], held] |= kind(1 << at)
            whole = np.array([(1 << k) - 1 for k in m.tolist()], dtype=kind)
            yield some, places, whole


def _edits(levels: list[tuple], places: np.ndarray, whole: np.ndarray) -> np.ndarray:
    """Edits behind the common start between the tokens of ``levels`` in rows and those of ``places`` in columns."""
    rises, stays = (np.full((1, len(whole)), ~whole.dtype.type(0)) for _ in range(2))
    out = np.empty((levels[-1][1], len(whole)), dtype=np.uint8)
    for step, (begin, end, ended, before, letters) in enumerate(levels):
        if end > begin:
            edits = np.bitwise_count(rises & whole)
            edits -= np.bitwise_count(~stays & whole)
            edits += np.uint8(step)
            out[begin:end] = edits.take(ended, axis=0)
        if letters is not None:
            if before is not None:
                rises, stays = rises.take(before, axis=0), stays.take(before, axis=0)
            _advance(places.take(letters, axis=0), rises, stays)
    return out


def _edits_of_pairs(words: _Words, i: np.ndarray, j: np.ndarray) -> np.ndarray:
    """Edits between the tokens of each pair, none of them long."""
    out = np.zeros(len(i), dtype=np.int64)
    swap = words.lengths[i] < words.lengths[j]
    pattern, text = np.where(swap, j, i), np.where(swap, i, j)
    kinds = np.searchsorted([16, 32], words.lengths[pattern])
    for number, kind in enumerate((np.uint16, np.uint32, np.uint64)):
        some = np.flatnonzero(kinds == number)
        if not len(some):
            continue
        some = some[np.argsort(words.lengths[text[some]], kind="stable")]
        p, t = pattern[some], text[some]
        places, begins = words.places(kind, p)
        lengths, rows = words.lengths[t], begins[p]
        rises, stays = (np.full(len(some), ~kind(0)) for _ in range(2))
        for step in range(int(lengths[-1])):
            begin = int(np.searchsorted(lengths, step, side="right"))
            _advance(places.take(rows[begin:] + words.letters[step].take(t[begin:])), rises[begin:], stays[begin:])
        whole = ~kind(0) >> (8 * kind().itemsize - words.lengths[p]).astype(kind)
        out[some] = lengths + np.bitwise_count(rises & whole) - np.bitwise_count(~stays & whole).astype(np.int64)
    return out


def _edits_of_long(words: _Words, i: np.ndarray, j: np.ndarray) -> np.ndarray:
    """Edits between the tokens of each pair, of any length; a whole number holds a token's bits."""
    known: dict[tuple[str, str], int] = {}
    for pattern, text in zip(words.norms.take(pa.array(i, pa.int64())).to_pylist(), words.norms.take(pa.array(j, pa.int64())).to_pylist()):
        if (pattern, text) in known:
            continue
        whole, places = (1 << len(pattern)) - 1, {}
        for at, c in enumerate(pattern):
            places[c] = places.get(c, 0) | 1 << at
        rises, falls = whole, 0
        for c in text:
            eq = places.get(c, 0)
            xh = (((eq & rises) + rises) ^ rises) | eq
            up, down = (falls | ~(xh | rises)) << 1 | 1, (rises & xh) << 1
            eq |= falls
            rises, falls = (down | ~(eq | up)) & whole, up & eq & whole
        known[pattern, text] = len(text) + rises.bit_count() - falls.bit_count()
    pairs = zip(words.norms.take(pa.array(i, pa.int64())).to_pylist(), words.norms.take(pa.array(j, pa.int64())).to_pylist())
    return np.array([known[pair] for pair in pairs], dtype=np.int64)


class _Scale:
    """Scores by edits, length of the longer token, sound (2 key, 1 first sound, 0) and common start."""

    SOUNDS = (0.0, SAME_FIRST_SOUND, 1.0)

    def __init__(self, least: float):
        self.least, self.target = least, STRONG + (least - 1.0) / 2.0
        sound, longest, edits = (x.ravel() for x in np.indices((3, LONG + 1, LONG + 1)))
        self.table = np.array([self._scores(edits, longest, sound, start).reshape(3, LONG + 1, LONG + 1) for start in (False, True)])

    def _scores(self, edits: np.ndarray, longest: np.ndarray, sound: np.ndarray, start: bool) -> np.ndarray:
        alike = EDIT_SHARE * (1 - edits / np.maximum(longest, 1)) + SOUND_SHARE * np.array(self.SOUNDS)[sound] + (PREFIX_BONUS if start else 0.0)
        score = np.where((edits <= longest) & (alike >= STRONG), 1.0 + (alike - STRONG) * 2.0, 0.0)
        values, which = np.unique(score, return_inverse=True)
        # rounded as Spark rounds
        values = np.array([float(Decimal(repr(v)).quantize(Decimal("0.000001"), ROUND_HALF_UP)) for v in values.tolist()])
        return np.where(values >= self.least, values, np.nan)[which]

    def most(self, longest: np.ndarray, sound: int, start: bool) -> np.ndarray:
        """Edits that may still reach the score; negative for none."""
        need = (self.target - SOUND_SHARE * self.SOUNDS[sound] - (PREFIX_BONUS if start else 0.0)) / EDIT_SHARE
        return np.minimum(np.floor(longest * (1.0 - need) + 1e-9), longest).astype(np.int64)

    def scores(self, edits: np.ndarray, longest: np.ndarray, sound: np.ndarray, start: bool) -> np.ndarray:
        if longest.max(initial=0) <= LONG:
            return self.table[int(start), sound, longest, edits]
        return self._scores(edits, longest, sound, start)


def _batch(words: _Words, i: np.ndarray, j: np.ndarray, scores: np.ndarray, order: str) -> pa.RecordBatch:
    """Pairs with a score, as they are, swapped, the smaller token first or in both orders."""
    good = np.flatnonzero(~np.isnan(scores))
    i, j, scores = i[good], j[good], scores[good]
    if order == "smaller":
        swap = words.rank[i] > words.rank[j]
        i, j = np.where(swap, j, i), np.where(swap, i, j)
    elif order == "swapped":
        i, j = j, i
    elif order == "both":
        i, j, scores = np.concatenate([i, j]), np.concatenate([j, i]), np.concatenate([scores, scores])
    taken = lambda k: words.norms.take(pa.array(k, pa.int64()))
    return pa.RecordBatch.from_arrays([taken(i), taken(j), pa.array(scores, pa.float64())], ["norm_a", "norm_b", "score"])


def _compared_long(words: _Words, i: np.ndarray, j: np.ndarray, scale: _Scale, start: bool, order: str) -> pa.RecordBatch:
    longest, sound = np.maximum(words.lengths[i], words.lengths[j]), words.sound(i, j)
    return _batch(words, i, j, scale.scores(_edits_of_long(words, i, j), longest, sound, start), order)


def _alike(words: _Words, left: np.ndarray, right: np.ndarray, itself: bool, scale: _Scale, order: str) -> Iterator[pa.RecordBatch]:
    """Pairs of tokens of one start that reach the score; the tokens are compared in tiles."""
    right = right[np.lexsort((words.rank[right], words.lengths[right]))]
    for k in left[words.lengths[left] > LONG].tolist():
        others = right[(words.lengths[right] > words.lengths[k]) | (words.rank[right] > words.rank[k]) & (words.lengths[right] == words.lengths[k])] if itself else right[words.rank[right] != words.rank[k]]
        longest = np.maximum(words.lengths[others], words.lengths[k])
        others = others[np.abs(words.lengths[others] - words.lengths[k]) <= scale.most(longest, 2, True)]
        yield _compared_long(words, np.full(len(others), k), others, scale, True, order)
    left = left[words.lengths[left] <= LONG]
    lengths = words.lengths[right]
    for m in np.unique(words.lengths[left]).tolist() if lengths.max(initial=0) > LONG else []:
        mine = left[words.lengths[left] == m]
        for k in right[(lengths > LONG) & (lengths - m <= scale.most(lengths, 2, True))].tolist():
            yield _compared_long(words, mine, np.full(len(mine), k), scale, True, order)
    right, lengths = right[lengths <= LONG], lengths[lengths <= LONG]
    columns = list(_columns(words, left, COMPARED // TILE))
    # edits from which on a pair is out
    limits = [(np.maximum(scale.most(np.arange(LONG + 1), k, True), -1) + 1).astype(np.uint8) for k in range(3)]
    found, rows, begin = [], 0, 0
    while begin < len(right):
        # tokens of one length, if there are enough of them
        end = min(begin + TILE, int(np.searchsorted(lengths, lengths[begin], side="right")))
        if end - begin < TILE // 4:
            end = min(begin + TILE // 4, len(right))
        them, size, begin = right[begin:end], lengths[begin:end, None], end
        levels = _levels(words, them)
        sounds, keys = words.sounds[them][:, None], words.keys[them][:, None]
        size = size[:1] if size[0] == size[-1] else size
        for some, places, whole in columns:
            m = words.lengths[some]
            if itself and size[-1, 0] < m[0]:
                break
            m = m[:1] if m[0] == m[-1] else m
            longest = np.maximum(size, m)
            above = [limit[longest] for limit in limits]
            if not (np.abs(size - m) < above[2]).any():
                continue
            edits, heard = _edits(levels, places, whole), words.sounds[some]
            good = edits < above[1]
            if not (heard[0] and (heard == heard[0]).all() and (sounds == heard[0]).all()):
                good &= (sounds == heard) & (heard != 0)
                good |= edits < above[0]
            good |= (edits < above[2]) & (keys == np.where(heard != 0, words.keys[some], -1))
            if not itself:
                good &= words.rank[some] != words.rank[them][:, None]
            elif size[0, 0] <= m[-1]:  # of one table each pair is met from its shorter token
                good &= (size > m) | (size == m) & (words.rank[some] < words.rank[them][:, None])
            at = np.flatnonzero(good)
            if not len(at):
                continue
            j, i = np.divmod(at, len(some))
            i, j = some[i], them[j]
            longest = np.maximum(words.lengths[i], words.lengths[j])
            found.append((i, j, scale.scores(edits.ravel()[at], longest, words.sound(i, j), True)))
            rows += len(i)
            if rows >= BATCH_ROWS:
                yield _batch(words, *(np.concatenate(part) for part in zip(*found)), order)
                found, rows = [], 0
    if found:
        yield _batch(words, *(np.concatenate(part) for part in zip(*found)), order)


def _with_one_start(a: DataFrame, b: DataFrame, itself: bool, least: float, order: str) -> DataFrame:
    """Pairs of an equal 3-letter start that reach the score; a task holds one part of a start and a batch of right tokens."""
    begun = lambda df: df.filter(F.length("norm") >= PREFIX).select(F.xxhash64(F.substring("norm", 1, PREFIX)).alias("group"), "norm", "key")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        group, held, scale = None, [], _Scale(least)
        for batch in batches:
            groups, sides = batch.column("group").to_numpy(), batch.column("side").to_numpy()
            ends = np.append(np.flatnonzero((np.diff(groups) != 0) | (np.diff(sides) != 0)) + 1, len(groups)).tolist()
            begin = 0
            for end in ends if len(groups) else []:
                piece, own, side, begin = batch.slice(begin, end - begin), groups[begin], sides[begin], end
                if side == 0:
                    if own != group:
                        group, held = own, []
                    held.append(piece)
                elif own == group:
                    words = _Words(pa.Table.from_batches([*held, piece]))
                    starts = np.unique(words.starts, return_inverse=True)[1]
                    rows, first = np.arange(len(starts)), len(starts) - piece.num_rows
                    for start in np.unique(starts).tolist():  # one, unless hashes of two are equal
                        ours = rows[starts == start]
                        yield from _alike(words, ours[ours < first], ours[ours >= first], itself, scale, order)

    # neighbours that begin alike are compared together
    return _grouped(begun(a), begun(b), 4 * GROUP_ROWS, "norm").mapInArrow(run, "norm_a string, norm_b string, score double")


def _paired(rows: DataFrame, itself: bool, least: float, sound: int, longer: str, order: str) -> DataFrame:
    """Pairs inside the groups of ``rows`` of the given sound and no common start that reach the score.

    ``longer`` says for pairs of the first sound whether left tokens may be as long as right ones
    (``as``) or must be longer (``more``).  What a group of the last batch holds on the left is kept.
    """

    def met(words: _Words, i: np.ndarray, j: np.ndarray, scale: _Scale) -> pa.RecordBatch:
        # the tests one after another, each on what the one before has left
        apart = words.starts[i] != words.starts[j]
        i, j = i[apart], j[apart]
        la, lb = words.lengths[i], words.lengths[j]
        ordered = lambda x, y: words.rank[x] < words.rank[y] if itself else words.rank[x] != words.rank[y]
        if sound == 2:
            good = ordered(i, j)
        else:
            good = la > lb
            if longer == "as":
                level = np.flatnonzero(la == lb)
                good[level] = ordered(i[level], j[level])
        longest = np.maximum(la, lb)
        most = scale.most(np.arange(int(longest.max(initial=0)) + 1), sound, False)[longest]
        good &= np.abs(la - lb) <= most
        some = np.flatnonzero(good)
        i, j, longest, most = i[some], j[some], longest[some], most[some]
        if sound == 1:
            once, twice = words.found
            alone = lambda bits, x, y: np.bitwise_count(bits[x] & ~bits[y])
            for _ in range(2):
                good = (alone(once, i, j) + alone(twice, i, j) <= most) | (longest > LONG)
                # and the other way round
                j, i, longest, most = i[good], j[good], longest[good], most[good]
        some = np.flatnonzero(words.sound(i, j) == sound)
        i, j, longest = i[some], j[some], longest[some]
        edits = np.zeros(len(some), dtype=np.int64)
        short = longest <= LONG
        edits[short] = _edits_of_pairs(words, i[short], j[short])
        edits[~short] = _edits_of_long(words, i[~short], j[~short])
        return _batch(words, i, j, scale.scores(edits, longest, np.full(len(some), sound), False), order)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        scale, held = _Scale(least), None
        for batch in batches:
            rows = pa.Table.from_batches([batch] if held is None else [*held.to_batches(), batch])
            groups, sides = rows["group"].to_numpy(), rows["side"].to_numpy()
            if not len(groups):
                continue
            last = int(np.searchsorted(groups, groups[-1]))
            held = rows.slice(last, int((sides[last:] == 0).sum())) if sides[last] == 0 else None
            number = np.append(0, np.cumsum(groups[1:] != groups[:-1]))
            size = np.bincount(number, weights=sides == 0).astype(np.int64)
            both = np.flatnonzero((size > 0) & (np.bincount(number, weights=sides == 1) > 0))
            kept = np.flatnonzero(np.isin(number, both))
            if not len(kept):
                continue
            words, sides = _Words(rows.take(pa.array(kept))), sides[kept]
            number, size = np.searchsorted(both, number[kept]), size[both]
            starts = np.searchsorted(number, np.arange(len(both)))
            right = np.flatnonzero(sides == 1)
            ends = np.cumsum(size[number[right]])
            begin = 0
            while begin < len(right):
                done = int(ends[begin - 1]) if begin else 0
                end = max(begin + 1, int(np.searchsorted(ends, done + COMPARED, side="right")))
                some = right[begin:end]
                counts = size[number[some]]
                before = np.repeat(np.cumsum(counts) - counts, counts)
                i = np.repeat(starts[number[some]], counts) + np.arange(len(before)) - before
                yield met(words, i, np.repeat(some, counts), scale)
                begin = end

    return rows.mapInArrow(run, "norm_a string, norm_b string, score double")


def fuzzy_token_join(a: DataFrame, b: DataFrame, least: float = 1.0, both_orders: bool = True) -> DataFrame:
    """All pairs of distinct tokens ``[norm, phonetic]`` that score ``least`` or more (1 at least).

    Four disjoint joins: equal tokens, equal 3-letter starts, and without these equal phonetic
    keys or equal first sounds; nothing else can reach a score of 1.  Tokens with an equal start
    meet where their lengths allow the score, and only what follows the start is compared.  Tokens
    of one first sound alone must be so alike that they share a segment near its place.  If
    both sides are the same table, each pair is scored once and given in both orders, or
    without ``both_orders`` in one, the smaller token first (scores are symmetric).
    """
    if least < 1.0:
        raise ValueError("tokens that share neither sound nor start are only ruled out from a score of 1 on")
    itself = a is b
    distinct = lambda df: df.select("norm", F.col("phonetic").alias("key")).distinct()
    a = stage(distinct(a), "tokens")
    b = a if itself else stage(distinct(b), "tokens")
    norms = lambda df, side: df.select(F.col("norm").alias(f"norm_{side}"))
    exact = exact_score(F.col("norm_a")).alias("score")
    equal = norms(a, "a").join(norms(b, "b"), F.col("norm_a") == F.col("norm_b")).select("norm_a", "norm_b", exact).filter(exact >= least)
    order = "plain" if not itself else "both" if both_orders else "smaller"
    need = (STRONG + (least - 1.0) / 2.0 - SOUND_SHARE * SAME_FIRST_SOUND) / EDIT_SHARE
    keyed = lambda df: df.filter("key <> ''").select(F.xxhash64("key").alias("group"), "norm", "key")
    scored = _with_one_start(a, b, itself, least, order)
    scored = scored.unionByName(_paired(_grouped(keyed(a), keyed(b)), itself, least, 2, "", order))
    # found once for each segment that two tokens share
    scored = scored.unionByName(_paired(_near_first_sound(a, b, need), itself, least, 1, "as", order).distinct())
    if not itself:
        scored = scored.unionByName(_paired(_near_first_sound(b, a, need), itself, least, 1, "more", "swapped").distinct())
    return equal.unionByName(scored)


# --- dynamic programming for short stretches -------------------------------------------


def _distances(word: str, table: np.ndarray, lengths: np.ndarray) -> np.ndarray:
    """Edit distance of one word to all rows of a padded character table."""
    width = table.shape[1]
    row = np.broadcast_to(np.arange(width + 1), (len(lengths), width + 1)).copy()
    for n, ch in enumerate(word, 1):
        turn = np.empty_like(row)
        turn[:, 0] = n
        np.minimum(row[:, 1:] + 1, row[:, :-1] + (table != ord(ch)), out=turn[:, 1:])
        # insertions run along the row: a running minimum once the step cost is taken off
        steps = np.arange(width + 1)
        row = np.minimum.accumulate(turn - steps, axis=1) + steps
    return row[np.arange(len(lengths)), lengths]


class _Tokens:
    """Distinct tokens of one side, ready to be scored against a token of the other."""

    def __init__(self, norms: list[str], keys: list[str]):
        self.lengths = np.array([len(w) for w in norms])
        self.table = np.zeros((len(norms), max(1, self.lengths.max(initial=0))), dtype=np.int64)
        for r, w in enumerate(norms):
            self.table[r, : len(w)] = [ord(ch) for ch in w]
        self.keys = np.array(keys, dtype=object)
        self.firsts = np.array([k[:1] for k in keys], dtype=object)
        self.starts = np.array([w[:PREFIX] if len(w) >= PREFIX else "" for w in norms], dtype=object)
        self.norms = np.array(norms, dtype=object)

    def scores(self, w: str, k: str) -> np.ndarray:
        """Similarity of one token to all of these, in millionths."""
        edit = 1 - _distances(w, self.table, self.lengths) / np.maximum(np.maximum(self.lengths, len(w)), 1)
        sound = np.where(self.keys == k, 1.0, np.where(self.firsts == k[:1], SAME_FIRST_SOUND, 0.0)) if k else 0.0
        bonus = np.where(self.starts == w[:PREFIX], PREFIX_BONUS, 0.0) if len(w) >= PREFIX else 0.0
        alike = np.round(EDIT_SHARE * edit + SOUND_SHARE * sound + bonus, 12)
        graded = np.where(
            alike >= STRONG,
            1.0 + (alike - STRONG) * 2.0,
            np.where(alike >= WEAK, 0.15 + (alike - WEAK) * 1.5, -0.8 - (WEAK - alike) * 1.5),
        )
        graded = np.where(self.norms == w, EXACT + (LONG_BONUS if len(w) >= LONG_LENGTH else 0.0), graded)
        return np.round(graded * SCALE).astype(np.int32)


def _scores(norms, keys, other_norms, other_keys):
    """Similarity of each left token to all right tokens, in millionths."""
    right = _Tokens(list(other_norms), list(other_keys))
    return [right.scores(w, k) for w, k in zip(norms, keys)]


class _Affine:
    """Rows of the dynamic programme for two token lists under affine gap costs.

    Costs are whole millionths, so rows can be filled with running maxima and ties fall the
    same way everywhere: match, then reference gap.  A row needs only the row before it, and
    its first columns only those of that row.
    """

    def __init__(self, ref_norms, ref_keys, hyp_norms, hyp_keys, landmarks=None):
        self.ref, self.landmarks = list(zip(ref_norms, ref_keys)), landmarks or {}
        right: dict[str, tuple[int, str]] = {}
        self.places = np.empty(len(hyp_norms), dtype=np.int64)
        for j, (w, k) in enumerate(zip(hyp_norms, hyp_keys)):
            self.places[j] = right.setdefault(w, (len(right), k))[0]
        self.tokens = _Tokens(list(right), [k for _, k in right.values()])
        self.known: dict[str, np.ndarray] = {}
        self.left: dict[str, str] = {}
        for w, k in self.ref:
            self.left.setdefault(w, k)

    def scores(self, i: int) -> np.ndarray:
        """Similarity of reference token ``i`` to the distinct tokens; the last ones are kept."""
        w = self.ref[i][0]
        if w not in self.known:
            if len(self.known) * 4 * max(1, len(self.tokens.norms)) >= KEPT_BYTES:
                self.known.pop(next(iter(self.known)))
            self.known[w] = self.tokens.scores(w, self.left[w])
        return self.known[w]

    def first(self, m: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Row 0 up to column ``m``: best totals that end in a match, a reference gap, a transcript gap."""
        at = np.arange(m + 1)
        ho, he = (round(c * SCALE) for c in HYP_GAP)
        match = np.concatenate([[0], ho + (at[1:] - 1) * he])
        ref_gap = np.full(m + 1, _NEVER)
        ref_gap[0] = round(REF_GAP[0] * SCALE)
        return match, ref_gap, ho + np.maximum(at - 1, 0) * he

    def row(self, i: int, above: tuple[np.ndarray, np.ndarray, np.ndarray]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Row ``i`` (from 1) from the row above, over the same columns."""
        (ro, re), (ho, he) = [[round(c * SCALE) for c in costs] for costs in (REF_GAP, HYP_GAP)]
        match, ref_gap, hyp_gap = above
        m = len(match) - 1
        at = np.arange(m + 1)
        gain = self.scores(i - 1)[self.places[:m]].astype(np.int64)
        marks = np.atleast_1d(np.array(self.landmarks.get(i - 1, []), dtype=np.int64))
        gain[marks[marks < m]] += round(LANDMARK_REWARD * SCALE)
        up = np.maximum(np.maximum(match, hyp_gap) + ro, ref_gap + re)
        new_match = np.empty(m + 1, dtype=np.int64)
        new_match[1:] = np.maximum(np.maximum(match, ref_gap), hyp_gap)[:-1] + gain
        new_match[0] = up[0] = ro + (i - 1) * re
        opened = np.maximum.accumulate(np.maximum(new_match, up) - at * he)
        new_hyp = np.full(m + 1, _NEVER)
        new_hyp[1:] = opened[:-1] + ho + (at[1:] - 1) * he
        return new_match, up, new_hyp

    def back(self, above, begin: int, end: int, j: int, path: list) -> int:
        """Walk from row ``end``, column ``j`` to row ``begin`` and return the column there.

        ``above`` is row ``begin``.  Few rows are filled and kept whole; of many only a handful
        spread over them, and the stretch behind each is then walked on its own, up to the
        column where the path enters it.  So memory grows with the two lengths and not with
        their product.
        """
        above = tuple(part[: j + 1] for part in above)
        if (end - begin) * (j + 1) > CELLS and end - begin > 1:
            cuts = sorted({begin + (end - begin) * p // PARTS for p in range(PARTS)})
            kept, now = [], above
            for i in range(begin, cuts[-1] + 1):
                now = now if i == begin else self.row(i, now)
                if i in cuts:
                    kept.append(now)
            for a, b in zip(reversed(cuts), [end, *reversed(cuts[1:])]):
                j = self.back(kept.pop(), a, b, j, path)
            return j
        ways = []
        for i in range(begin + 1, end + 1):
            above = match, up, hyp = self.row(i, above)
            best = np.maximum(np.maximum(match, up), hyp)
            way = np.where(best == match, 1, np.where(best == up, 2, 3)).astype(np.int8)
            way[0] = 2
            ways.append(way)
        i = end
        while i > begin:
            turn = ways[i - begin - 1][j]
            if turn == 1:
                i, j = i - 1, j - 1
                path.append(("match", i, j, int(self.scores(i)[self.places[j]]) / SCALE))
            elif turn == 2:
                i -= 1
                path.append(("lyric-gap", i, None, 0.0))
            else:
                j -= 1
                path.append(("asr-gap", None, j, 0.0))
        return j


def affine_path(ref_norms, ref_keys, hyp_norms, hyp_keys, landmarks=None):
    """Best alignment of two token lists under affine gap costs: ``(op, i, j, score)`` in order.

    At every cell the walk back takes the best of the three ways into it.
    """
    n, m = len(ref_norms), len(hyp_norms)
    if n == 0 or m == 0:
        return [("lyric-gap", i, None, 0.0) for i in range(n)] + [("asr-gap", None, j, 0.0) for j in range(m)]
    programme, path = _Affine(ref_norms, ref_keys, hyp_norms, hyp_keys, landmarks), []
    j = programme.back(programme.first(m), 0, n, m, path)
    path += [("asr-gap", None, k, 0.0) for k in range(j - 1, -1, -1)]
    return path[::-1]


def affine_total(ref_norms, ref_keys, hyp_norms, hyp_keys) -> int:
    """Total of the best alignment, in millionths."""
    n, m = len(ref_norms), len(hyp_norms)
    edge = lambda costs, k: round(costs[0] * SCALE) + (k - 1) * round(costs[1] * SCALE) if k else 0
    if n == 0 or m == 0:
        return edge(REF_GAP, n) + edge(HYP_GAP, m)
    programme = _Affine(ref_norms, ref_keys, hyp_norms, hyp_keys)
    now = programme.first(m)
    for i in range(1, n + 1):
        now = programme.row(i, now)
    return int(max(part[-1] for part in now))


CELL = (
    StructType()
    .add("op", StringType())
    .add("i", LongType())
    .add("j", LongType())
    .add("score", DoubleType())
)


def _lists(parts: list[pa.StructArray], kinds: list[tuple[str, pa.DataType]]) -> pa.ListArray:
    """One list for each part; cells stay columns, which take a small part of what Python objects do."""
    ends = np.cumsum([0, *map(len, parts)])
    return pa.ListArray.from_arrays(pa.array(ends, pa.int32()), pa.concat_arrays([pa.array([], pa.struct(kinds)), *parts]))


_CELL = [("op", pa.string()), ("i", pa.int64()), ("j", pa.int64()), ("score", pa.float64())]


@F.arrow_udf(ArrayType(CELL))
def _affine(rn: pa.Array, rk: pa.Array, hn: pa.Array, hk: pa.Array, li: pa.Array, lj: pa.Array) -> pa.Array:
    cells = []
    for row in zip(rn, rk, hn, hk, li, lj):
        *texts, at, to = (x.as_py() for x in row)
        # tokens outside the group have no place in it; one token may have several landmarks
        known: dict[int, list[int]] = {}
        for i, j in zip(at, to):
            if i >= 0 and j >= 0:
                known.setdefault(int(i), []).append(int(j))
        columns = list(zip(*affine_path(*texts, landmarks=known))) or [()] * len(_CELL)
        arrays = [pa.array(values, kind) for values, (_, kind) in zip(columns, _CELL)]
        cells.append(pa.StructArray.from_arrays(arrays, [name for name, _ in _CELL]))
    return _lists(cells, _CELL)


def _packed(rows: DataFrame, keys: list[str], position: str, prefix: str) -> DataFrame:
    return rows.groupBy(*keys).agg(
        F.array_sort(F.collect_list(F.struct(position, "norm", "phonetic"))).alias(prefix)
    )


def _align_groups(ref: DataFrame, hyp: DataFrame, keys: list[str], landmarks: DataFrame | None = None) -> DataFrame:
    """Run the dynamic programme on every group of two token lists."""
    empty = F.array()
    both = _packed(ref, keys, "i", "r").join(_packed(hyp, keys, "j", "h"), keys, "full")
    if landmarks is None:
        both = both.withColumn("marks", empty.cast("array<struct<i:bigint,j:bigint>>"))
    else:
        marks = landmarks.groupBy(*keys).agg(F.array_sort(F.collect_set(F.struct("i", "j"))).alias("marks"))
        both = both.join(marks, keys, "left").withColumn(
            "marks", F.coalesce("marks", empty.cast("array<struct<i:bigint,j:bigint>>"))
        )
    both = both.withColumns(
        {
            "r": F.coalesce("r", empty.cast(both.schema["r"].dataType)),
            "h": F.coalesce("h", empty.cast(both.schema["h"].dataType)),
        }
    )
    field = lambda c, f: F.transform(c, lambda x: x[f])
    # landmarks name positions; the programme wants places in the two lists
    index = lambda side, pos: F.transform(
        "marks", lambda x: F.array_position(field(side, pos), x[pos]) - 1
    )
    cells = _affine(
        field("r", "norm"),
        field("r", "phonetic"),
        field("h", "norm"),
        field("h", "phonetic"),
        index("r", "i"),
        index("h", "j"),
    )
    rows = both.withColumn("cells", cells).select(*keys, "r", "h", F.posexplode("cells").alias("step", "c"))
    # positions inside the group back to positions inside the pair
    i = F.when(F.col("c.i").isNotNull(), F.get("r", F.col("c.i").cast("int"))["i"])
    j = F.when(F.col("c.j").isNotNull(), F.get("h", F.col("c.j").cast("int"))["j"])
    return rows.select(
        *keys,
        F.col("step").cast("bigint").alias("step"),
        F.col("c.op").alias("op"),
        i.alias("i"),
        j.alias("j"),
        F.col("c.score").alias("score"),
    )


def align_affine(ref: DataFrame, hyp: DataFrame, landmarks: DataFrame | None = None) -> DataFrame:
    """Align whole pairs by dynamic programming: ``[pair_id, step, op, i, j, score]``.

    Exact, quadratic in time and linear in memory; ``align_chain`` is the way for long texts.
    ``landmarks[pair_id, i, j]`` reward token pairs known to belong together.
    """
    return _align_groups(ref, hyp, ["pair_id"], landmarks)


@F.pandas_udf(LongType())
def _totals(rn: pd.Series, rk: pd.Series, hn: pd.Series, hk: pd.Series) -> pd.Series:
    return pd.Series([affine_total(*[list(x) for x in row]) for row in zip(rn, rk, hn, hk)])


def align_score(ref: DataFrame, hyp: DataFrame) -> DataFrame:
    """Best total over all alignments of a pair: ``[pair_id, score]``."""
    both = _packed(ref, ["pair_id"], "i", "r").join(_packed(hyp, ["pair_id"], "j", "h"), ["pair_id"])
    total = _totals("r.norm", "r.phonetic", "h.norm", "h.phonetic")
    return both.select("pair_id", F.round(total / SCALE, 6).alias("score"))


# --- chaining for long texts -------------------------------------------------------------


def _grams(rows: DataFrame, position: str, side: int, k: int, keys: tuple[str, ...]) -> DataFrame:
    w = Window.partitionBy(*keys).orderBy(position)
    parts = [F.lead("norm", d).over(w) for d in range(k)]
    # tokens taken out between two others end a run
    whole = F.lead(position, k - 1).over(w) == F.col(position) + k - 1
    return (
        rows.withColumn("gram", F.array(*parts)).withColumn("whole", whole)
        .filter("whole")
        .select(*keys, "gram", F.lit(side).alias("side"), F.col(position).alias("pos"))
    )


def heaviest_chain(first: np.ndarray, second: np.ndarray) -> np.ndarray:
    """Places of the longest sequence of points that increases in both coordinates.

    No two points share a coordinate.  A Fenwick tree over the second coordinate gives each
    point its best predecessor, of equally good ones the first, in logarithmic time.
    """
    n = len(first)
    order = np.argsort(first, kind="stable")
    rank = np.empty(n, dtype=np.int64)
    rank[np.argsort(second, kind="stable")] = np.arange(1, n + 1)
    tree = [(0, 0)] * (n + 1)  # longest chain so far and minus its last place in order
    length, before = [0] * n, [-1] * n
    for k, point in enumerate(order.tolist()):
        at = int(rank[point])
        best, p = (0, 0), at - 1
        while p > 0:
            best = max(best, tree[p])
            p -= p & -p
        length[k] = best[0] + 1
        before[k] = -best[1] if best[0] else -1
        mine, p = (length[k], -k), at
        while p <= n:
            tree[p] = max(tree[p], mine)
            p += p & -p
    chain, k = [], max(range(n), key=lambda k: (length[k], -k)) if n else -1
    while k >= 0:
        chain.append(int(order[k]))
        k = before[k]
    return np.array(chain[::-1], dtype=np.int64)


@F.arrow_udf(ArrayType(StructType().add("i", LongType()).add("j", LongType())))
def _chained(points: pa.Array) -> pa.Array:
    out = []
    for seeds in points:
        i, j = (seeds.values.field(c).to_numpy() for c in ("i", "j"))
        chain = heaviest_chain(i, j)
        out.append(pa.StructArray.from_arrays([pa.array(i[chain]), pa.array(j[chain])], ["i", "j"]))
    return _lists(out, [("i", pa.int64()), ("j", pa.int64())])


def align_blocks(ref: DataFrame, hyp: DataFrame, k: int = SEED, keys: tuple[str, ...] = ("pair_id",)) -> DataFrame:
    """Diagonal runs of seeds, a seed being ``k`` tokens unique in both texts of a pair.

    One aggregate finds the seeds (no join of occurrences); the largest set of seeds that
    stand in the same order on both sides stays, so that of two crossing runs the heavier
    one does.  ``[pair_id, i0, j0, len]`` with ``len`` in tokens; blocks never overlap or cross.
    With further ``keys`` a seed must be unique in both parts of a pair that share them.
    """
    configure(ref.sparkSession)
    grams = _grams(ref, "i", 0, k, keys).unionByName(_grams(hyp, "j", 1, k, keys))
    side = F.col("side")
    seeds = grams.groupBy(*keys, "gram").agg(
        F.count_if(side == 0).alias("nr"),
        F.count_if(side == 1).alias("nh"),
        F.min(F.when(side == 0, F.col("pos"))).alias("i"),
        F.min(F.when(side == 1, F.col("pos"))).alias("j"),
    ).filter("nr = 1 and nh = 1")
    # the seeds of a pair are fewer than its tokens
    packed = seeds.groupBy(*keys).agg(F.array_sort(F.collect_list(F.struct("i", "j"))).alias("seeds"))
    kept = packed.select(*keys, F.explode(_chained("seeds")).alias("s")).select(*keys, "s.i", "s.j")
    diagonal = Window.partitionBy(*keys, "d").orderBy("i")
    runs = kept.withColumn("d", F.col("i") - F.col("j")).withColumn(
        "run", F.col("i") - F.row_number().over(diagonal)
    )
    blocks = runs.groupBy(*keys, "d", "run").agg(
        F.min("i").alias("i0"), F.min("j").alias("j0"), (F.count(F.lit(1)) + k - 1).alias("len")
    )
    return _without_overlap(blocks.select("pair_id", "i0", "j0", "len"))


def _without_overlap(blocks: DataFrame) -> DataFrame:
    """Cut block starts that reach into the block before."""
    past = Window.partitionBy("pair_id").orderBy("i0").rowsBetween(Window.unboundedPreceding, -1)
    over = F.greatest(
        F.lit(0),
        F.coalesce(F.max(F.col("i0") + F.col("len")).over(past) - F.col("i0"), F.lit(0)),
        F.coalesce(F.max(F.col("j0") + F.col("len")).over(past) - F.col("j0"), F.lit(0)),
    )
    return (
        blocks.withColumn("cut", over)
        .select(
            "pair_id",
            (F.col("i0") + F.col("cut")).alias("i0"),
            (F.col("j0") + F.col("cut")).alias("j0"),
            (F.col("len") - F.col("cut")).alias("len"),
        )
        .filter("len > 0")
    )


def block_matches(blocks: DataFrame) -> DataFrame:
    """Token pairs of the blocks."""
    return blocks.select(
        "pair_id", "i0", "j0", F.explode(F.sequence(F.lit(0).cast("bigint"), F.col("len") - 1)).alias("o")
    ).select("pair_id", (F.col("i0") + F.col("o")).alias("i"), (F.col("j0") + F.col("o")).alias("j"))


def _placed(rows: DataFrame, position: str, blocks: DataFrame) -> DataFrame:
    """Tokens with the number of the gap they lie in (blocks begun before them), and their block if they are matched.

    Block starts go through one window with the tokens: blocks never overlap, so that the last
    one begun is a token's own or has ended.  Matched tokens are not listed and nothing is joined, so
    that no table of them, small as its blocks are on disk, can be broadcast.
    """
    marks = blocks.filter("pair_id is not null").select(
        "pair_id", F.col(f"{position}0").alias(position), F.struct("i0", "j0", "len").alias("begun")
    )
    past = Window.partitionBy("pair_id").orderBy(position)
    last = F.last("begun", ignorenulls=True).over(past)
    tokens_and_marks = rows.select("pair_id", position, "norm", "phonetic").unionByName(marks, allowMissingColumns=True)
    placed = tokens_and_marks.withColumns({"gap": F.count("begun").over(past), "block": last}).filter("begun is null")
    own = F.col(position) < F.col(f"block.{position}0") + F.col("block.len")
    return placed.select("pair_id", "gap", position, "norm", "phonetic", F.when(own, F.col("block")).alias("block"))


def _stretches(ref: DataFrame, hyp: DataFrame, blocks: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Tokens of both sides outside the blocks, with the stretch they lie in."""
    return tuple(_placed(rows, p, blocks).filter("block is null").drop("block") for rows, p in ((ref, "i"), (hyp, "j")))


def align_chain(ref: DataFrame, hyp: DataFrame, k: int = SEED) -> DataFrame:
    """Align long pairs: chained blocks of unique seeds, then dynamic programming between them.

    ``[pair_id, op, i, j, score]``.  Every token of both texts appears exactly once.  The
    stretches between blocks are seeded again, with runs down to two tokens, before what is
    left of them is aligned; only that is quadratic in time, and in memory nothing is.  The
    outcome can differ from one global programme where a seed is misleading.
    """
    ref, hyp = stage(ref, "ref-tokens"), stage(hyp, "hyp-tokens")
    blocks = stage(align_blocks(ref, hyp, k), "blocks")
    # a run that occurs twice in a text may be the only one of its kind in a stretch
    for shorter in range(k, 1, -1):
        found = align_blocks(*_stretches(ref, hyp, blocks), shorter, ("pair_id", "gap"))
        blocks = stage(blocks.unionByName(found), "blocks")
    matched = _placed(ref, "i", blocks).filter("block is not null")
    sure = matched.select(
        "pair_id",
        F.lit("match").alias("op"),
        "i",
        (F.col("block.j0") + F.col("i") - F.col("block.i0")).alias("j"),
        exact_score(F.col("norm")).alias("score"),
    )
    r, h = _stretches(ref, hyp, blocks)
    between = _align_groups(r, h, ["pair_id", "gap"]).select("pair_id", "op", "i", "j", "score")
    return sure.unionByName(between)
