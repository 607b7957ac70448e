"""The quality ledger against plain counting, and its policies."""

import random

import pytest

from cadenza.llm import quality
from cadenza.llm.quality import MEASURES, RULES, Policy

SCHEMA = "doc_id long, text string, lang string, failed string, n_words string"


def plain(text):
    """Base measurements by loops over characters, lines and windows."""
    text = text or ""
    words, word = [], ""
    for c in text + " ":
        if c in " \t\n\v\f\r":
            if word:
                words.append(word)
            word = ""
        else:
            word += c
    lines = [x for x in text.split("\n") if any(c not in " \t\n\v\f\r" for c in x)]
    windows = [tuple(words[k : k + 3]) for k in range(len(words) - 2)]
    inside = {k + d for k, w in enumerate(windows) if windows.count(w) > 1 for d in range(3)}
    return len(words), sum(map(len, words)), sum(c in "#*$%&|<>" for c in text), len(lines) - len(set(lines)), len(inside)


TEXTS = [
    None, "", " \n\t", "one", "a b c a b c", "a a a a", "x\nx\n x\nx\r\n\nx", "## a|b <c> $5 100% *&", "  \x1c a\x1cb  c",
    "a\x1fb a\x1fb a\x1fb a\x1fb a\x1fb", "ONE TWO three", "- a\n* b\n• c", "well...\nno…\nyes", "Straße ÉTÉ \U00020000",
]


@pytest.mark.parametrize("part", [3, 1_000_000])
def test_measures_equal_plain_counts(part, monkeypatch):
    monkeypatch.setattr(quality, "PART", part)
    rng = random.Random(3)
    made = ["".join(rng.choice("ab #\n\t.é") for _ in range(rng.randrange(200))) for _ in range(150)]
    for text in TEXTS + made:
        assert quality.measure(text)[:5] == plain(text), text


def test_other_measures():
    got = dict(zip(MEASURES, quality.measure("- one TWO\n  - AB9 4%\nso ...\nso ...\n...")))
    want = {
        "n_lines": 5, "line_chars": 9 + 10 + 6 + 6 + 3, "dup_line_chars": 6, "n_bullet_lines": 2, "n_ellipsis_lines": 3,
        "n_letter_words": 5, "n_capital_words": 2, "longest_word": 3,
    }
    assert {k: got[k] for k in want} == want


def test_many_distinct_words_in_one_text():
    n = (1 << 20) + 5
    words = [f"{k:x}" for k in range(n)]
    text = " ".join([*words, *words[:4], "x", *words[7:9]])
    got = dict(zip(MEASURES, quality.measure(text)))
    assert got["n_words"] == n + 7 and got["n_repeat_words"] == 8


def test_ledger_rows_and_bits(spark):
    rows = [(k, t, "en", "x", "y") for k, t in enumerate(TEXTS)] + [(None, "a", None, None, None), (3, "one", "en", "x", "y"), (3, "one", "en", "x", "y")]
    got = quality.ledger(spark.createDataFrame(rows, SCHEMA)).collect()
    assert len(got) == len(rows) and sum(r.doc_id == 3 for r in got) == 3
    by = {r.doc_id: r for r in got}
    for k, text in enumerate(TEXTS):
        values = dict(zip(MEASURES, quality.measure(text)))
        assert {m: by[k][m] for m in MEASURES} == values
        assert by[k].failed == sum(1 << r.bit for r in RULES if eval(r.fails, {}, dict(values)))
    assert by[0].n_words == 0 and by[0].failed == 1 == by[1].failed
    assert by[None].n_words == 1


def test_long_text_and_empty_table(spark):
    long = "lorem ipsum dolor sit amet " * 400_000
    got = quality.ledger(spark.createDataFrame([(1, long)], "doc_id long, text string")).first()
    assert got.n_words == got.n_repeat_words == 2_000_000 and got.failed & 2
    empty = quality.ledger(spark.createDataFrame([], SCHEMA))
    assert empty.count() == 0
    assert {tuple(r)[3:] for r in quality.ablations(empty, quality.policy("web")).collect()} == {(0, 0, 0, 0)}


def test_bits_are_never_shared():
    assert len({r.bit for r in RULES}) == len({r.name for r in RULES}) == len(RULES) and max(r.bit for r in RULES) < 63


def test_policies_by_version():
    assert quality.policy("web").version == 2 and quality.policy("web", 1).version == 1
    with pytest.raises(ValueError):
        quality.policy("web", 9)


@pytest.fixture(scope="module")
def rows(spark):
    docs = spark.read.parquet("/root/testdata/sf0.001/documents.parquet")
    return quality.ledger(docs).join(docs.select("doc_id", "source"), "doc_id").cache()


def test_apply_policy(rows):
    rules = Policy("own", 1, ("few_words", "capitals"))
    for r in quality.apply_policy(rows, rules).collect():
        want = [x.name for x in RULES if x.name in rules.rules and r.failed >> x.bit & 1]
        assert r.reasons == want and r.kept == (not want)


def test_ablations_equal_policies_without_a_rule(rows):
    rules = quality.policy("web", 1)
    total = rows.count()
    got = {r.rule: r for r in quality.ablations(rows, rules).collect()}
    assert set(got) == set(rules.rules)
    kept = rows.where(quality.passes(rules)).count()
    for name in rules.rules:
        without = Policy("w", 1, tuple(x for x in rules.rules if x != name))
        alone = Policy("a", 1, (name,))
        assert got[name].n_kept == kept and got[name].n_without == rows.where(quality.passes(without)).count()
        assert got[name].n_failed == total - rows.where(quality.passes(alone)).count()


def test_common_failures_and_changes(rows):
    every = rows.collect()
    for r in quality.common_failures(rows, "source").collect():
        own = [x.failed for x in every if x.source == r.source]
        low, high = -1, 0
        for bits in own:
            low, high = low & bits, high | bits
        assert (r.n_rows, r.any_failed, r.all_failed) == (len(own), high, low)
    old, new = quality.policy("base"), quality.policy("web")
    want = {x.doc_id for x in every if (x.failed & old.mask() == 0) != (x.failed & new.mask() == 0)}
    assert {r.doc_id for r in quality.changed(rows, old, new).collect()} == want and want


def test_clean_documents_stay(spark):
    """Of documents labelled good the base rules drop some short ones; the policy drops no other."""
    docs = spark.read.parquet("/root/testdata/sf0.01/documents.parquet")
    labels = spark.read.parquet("/root/testdata/sf0.01/labels.parquet")
    judged = quality.apply_policy(quality.ledger(docs), quality.policy("web")).join(labels, "doc_id").collect()
    base = quality.policy("base").mask()
    good = [r for r in judged if r.quality == 1 and not r.failed & base]
    bad = [r for r in judged if r.quality == 0]
    assert sum(not r.kept for r in good) == 0 and sum(not r.kept for r in bad) > 0.95 * len(bad) > 0
