"""Quality rules as a ledger: measured once, failed rules as bits, policies applied afterwards.

``ledger`` reads each text once and keeps its measurements and one bit for each failed rule.
A policy is a mask of rules under a name and a version; applying one, comparing two, or
asking what a single rule costs are integer operations on the ledger and read no text.
"""

from __future__ import annotations

import re
from collections.abc import Iterable, Iterator
from typing import NamedTuple

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from cadenza.llm.base import pieces

#: Fixed pattern of a word: what ASCII white space separates.
WORD = re.compile(r"[^\x20\x09-\x0D]+")
SPACE = re.compile(r"[\x20\x09-\x0D]")
SPACES = " \t\n\v\f\r"
SYMBOLS = "#*$%&|<>"
#: Words that begin a list entry, and ends of a line that breaks off.
BULLETS = ("-", "*", "•", "–", "·")
ELLIPSES = ("...", "…")
LETTER = re.compile(r"[^\x00-\x40\x5B-\x60\x7B-\x7F]")
CAPITALS = re.compile(r"[^a-z]*[A-Z][^a-z]*[A-Z][^a-z]*\Z")
#: Characters whose words are held as objects at once.
PART = 1_000_000

MEASURES = (
    "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words",
    "n_lines", "line_chars", "dup_line_chars", "n_bullet_lines", "n_ellipsis_lines", "n_letter_words", "n_capital_words", "longest_word",
)


class Rule(NamedTuple):
    """A rule fails where ``fails``, SQL over the measurements, is true.

    A bit belongs to its rule for ever: another limit is another rule with a bit of its own, so
    that ledgers written earlier keep their meaning.
    """

    bit: int
    name: str
    fails: str


RULES = (
    Rule(0, "few_words", "n_words < 50"),
    Rule(1, "repeated_windows", "100 * n_repeat_words > 50 * n_words"),
    Rule(2, "many_words", "n_words > 100000"),
    Rule(3, "short_words", "word_chars < 3 * n_words"),
    Rule(4, "long_words", "word_chars > 10 * n_words"),
    Rule(5, "symbols", "10 * n_symbols > n_words"),
    Rule(6, "bullet_lines", "10 * n_bullet_lines > 9 * n_lines"),
    Rule(7, "ellipsis_lines", "10 * n_ellipsis_lines > 3 * n_lines"),
    Rule(8, "few_letters", "10 * n_letter_words < 8 * n_words"),
    Rule(9, "repeated_lines", "10 * n_dup_lines > 3 * n_lines"),
    Rule(10, "repeated_line_chars", "5 * dup_line_chars > line_chars"),
    Rule(11, "capitals", "2 * n_capital_words > n_words"),
    Rule(12, "endless_word", "longest_word > 1000"),
    Rule(13, "short_words_wide", "word_chars < 2 * n_words"),
    Rule(14, "long_words_wide", "word_chars > 20 * n_words"),
)
BASE = ("few_words", "repeated_windows")


class Policy(NamedTuple):
    name: str
    version: int
    rules: tuple[str, ...]

    def mask(self) -> int:
        bits = {r.name: r.bit for r in RULES}
        return sum(1 << bits[name] for name in set(self.rules))


#: ``web`` 1 has the usual limits for English pages; 2 widens those that languages with long or
#: short words would fail, and leaves repeated lines to their share of characters, as one repeated
#: line of three is no fault of a short text.
POLICIES = (
    Policy("base", 1, BASE),
    Policy("web", 1, (*BASE, "many_words", "short_words", "long_words", "symbols", "bullet_lines", "ellipsis_lines", "few_letters", "repeated_lines", "repeated_line_chars", "capitals")),
    Policy("web", 2, (*BASE, "many_words", "short_words_wide", "long_words_wide", "symbols", "bullet_lines", "ellipsis_lines", "few_letters", "repeated_line_chars", "capitals", "endless_word")),
)


def policy(name: str, version: int | None = None) -> Policy:
    """The policy of that version, or the newest one."""
    found = [p for p in POLICIES if p.name == name and version in (None, p.version)]
    if not found:
        raise ValueError(f"no policy {name} {version}")
    return max(found, key=lambda p: p.version)


def _word_numbers(text: str) -> tuple[np.ndarray, list[str]]:
    """A number for each word of a text, and the distinct words by number."""
    numbers: dict[str, int] = {}
    parts, at = [], 0
    while at < len(text):
        gap = SPACE.search(text, at + PART)
        end = gap.start() if gap else len(text)
        words = WORD.findall(text, at, end)
        parts.append(np.fromiter((numbers.setdefault(w, len(numbers)) for w in words), np.int64, len(words)))
        at = end
    return np.concatenate(parts) if parts else np.zeros(0, np.int64), list(numbers)


def _repeated(ids: np.ndarray) -> int:
    """Words inside a window of three that the text holds at least twice."""
    if len(ids) < 4:
        return 0
    base = int(ids.max()) + 1
    pairs = ids[:-2] * base + ids[1:-1]
    if base > 1 << 20:  # three such numbers do not fit into one
        pairs = np.unique(pairs, return_inverse=True)[1]
    _, at, counts = np.unique(pairs * base + ids[2:], return_inverse=True, return_counts=True)
    twice, covered = counts[at] > 1, np.zeros(len(ids), bool)
    for k in range(3):
        covered[k : k + len(twice)] |= twice
    return int(covered.sum())


def measure(text: str | None) -> tuple[int, ...]:
    """The measurements of one text in the order of ``MEASURES``."""
    text = text or ""
    ids, words = _word_numbers(text)
    often = np.bincount(ids, minlength=len(words))
    seen: set[str] = set()
    lines = line_chars = dup_lines = dup_chars = bullets = ellipses = 0
    for line in text.split("\n"):
        bare = line.strip(SPACES)
        if bare:
            lines += 1
            line_chars += len(line)
            if line in seen:
                dup_lines += 1
                dup_chars += len(line)
            else:
                seen.add(line)
            bullets += bare.startswith(BULLETS)
            ellipses += bare.endswith(ELLIPSES)
    return (
        len(ids), len(text) - sum(map(text.count, SPACES)), sum(map(text.count, SYMBOLS)), dup_lines, _repeated(ids),
        lines, line_chars, dup_chars, bullets, ellipses,
        int(often[[bool(LETTER.search(w)) for w in words]].sum()) if words else 0,
        int(often[[bool(CAPITALS.match(w)) for w in words]].sum()) if words else 0,
        max(map(len, words), default=0),
    )


def ledger(docs: DataFrame) -> DataFrame:
    """doc_id, the measurements, and ``failed``: a long with the bit of each failed rule.

    One row for each row of ``docs`` (repeated rows and null ids included), in one pass without
    a shuffle.  A null text measures like an empty one: all zero, so that only ``few_words``
    fails.  Texts are measured whole; a task holds the words of a million characters at once,
    and a number for each word of its text.
    """
    kind = docs.schema["doc_id"].dataType.simpleString()

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in pieces(batches):
            values = np.array([measure(t.as_py()) for t in batch.column("text")], np.int64).reshape(-1, len(MEASURES))
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), *map(pa.array, values.T)], ["doc_id", *MEASURES])

    measured = docs.select("doc_id", F.col("text").cast("string").alias("text")).mapInArrow(
        run, f"doc_id {kind}, " + ", ".join(f"{m} long" for m in MEASURES)
    )
    bits = [F.when(F.expr(r.fails), F.lit(1 << r.bit)).otherwise(F.lit(0)).cast("long") for r in RULES]
    failed = bits[0]
    for bit in bits[1:]:
        failed = failed.bitwiseOR(bit)
    return measured.withColumn("failed", failed)


def passes(rules: Policy) -> Column:
    """Whether a ledger row fails no rule of a policy."""
    return F.col("failed").bitwiseAND(F.lit(rules.mask())) == 0


def apply_policy(rows: DataFrame, rules: Policy) -> DataFrame:
    """A ledger with ``kept`` and the names of the policy's rules that a row fails."""
    names = [F.when(F.col("failed").bitwiseAND(F.lit(1 << r.bit)) != 0, F.lit(r.name)) for r in RULES if r.name in rules.rules]
    return rows.withColumn("kept", passes(rules)).withColumn(
        "reasons", F.filter(F.array(*names), lambda n: n.isNotNull()) if names else F.array().cast("array<string>")
    )


def ablations(rows: DataFrame, rules: Policy) -> DataFrame:
    """What each rule of a policy does: one row for each.

    ``n_failed`` rows fail the rule, ``n_only`` fail no other rule of the policy (they return
    if it goes), ``n_kept`` stay under the whole policy and ``n_without`` without the rule.
    Equal bit sets are counted first, so that what is compared with the rules is their number
    of distinct sets and not the corpus.  An empty ledger gives zeros.
    """
    mask, spark = rules.mask(), rows.sparkSession
    sets = rows.groupBy(F.col("failed").bitwiseAND(F.lit(mask)).alias("failed")).agg(F.count("*").alias("n"))
    own = [(r.name, 1 << r.bit) for r in RULES if r.name in rules.rules]
    each = F.explode(F.array(*(F.struct(F.lit(name).alias("rule"), F.lit(bit).cast("long").alias("bit")) for name, bit in own)))
    hit = sets.select("failed", "n", each.alias("r")).select("failed", "n", "r.*")
    fails, alone, none = F.col("failed").bitwiseAND(F.col("bit")) != 0, F.col("failed") == F.col("bit"), F.col("failed") == 0

    def total(condition: Column, name: str) -> Column:
        return F.sum(F.when(condition, F.col("n")).otherwise(0)).alias(name)

    counted = hit.groupBy("rule").agg(total(fails, "n_failed"), total(alone, "n_only"), total(none, "n_kept"))
    listed = spark.createDataFrame(own, "rule string, bit long")
    zero = [F.coalesce(c, F.lit(0)).alias(c) for c in ("n_failed", "n_only", "n_kept")]
    return (
        listed.join(counted, "rule", "left").select(F.lit(rules.name).alias("policy"), F.lit(rules.version).alias("version"), "rule", *zero)
        .withColumn("n_without", F.col("n_kept") + F.col("n_only"))
    )


def common_failures(rows: DataFrame, by: str) -> DataFrame:
    """For each value of ``by``: rows, bits that any row fails and bits that all rows fail."""
    return rows.groupBy(by).agg(
        F.count("*").alias("n_rows"), F.bit_or("failed").alias("any_failed"), F.bit_and("failed").alias("all_failed")
    )


def changed(rows: DataFrame, old: Policy, new: Policy) -> DataFrame:
    """The rows that two policies judge differently, with both verdicts."""
    return rows.withColumn("kept_old", passes(old)).withColumn("kept_new", passes(new)).where("kept_old <> kept_new")
