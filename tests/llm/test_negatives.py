"""Hard negatives against a plain search over all pairs."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from cadenza.llm import negatives

SCHEMA = "vec_id long, embedding array<float>, label int, score string, anchor string"


def plain(rows, ask, positives=5, n=5, scale=256):
    """All rows of the result, by scoring every pair."""
    used = [(i, [int(np.floor(scale * float(np.float32(v)))) for v in e], lab) for i, e, lab in rows
            if lab is not None and e is not None and all(v is not None and np.isfinite(v) for v in e)]
    out = []
    for at, (i, x, lab) in enumerate(used):
        if i is None or not ask(i):
            continue
        scored = sorted((-sum(a * b for a, b in zip(x, y)), j is None, j or 0, k) for k, (j, y, _) in enumerate(used) if k != at)
        mine = [s for s in scored if used[s[3]][2] == lab][:positives]
        others = [s for s in scored if used[s[3]][2] != lab]
        for p in mine:
            fit = [s for s in others if 80 * -p[0] <= 100 * -s[0] <= 100 * -p[0]][:n]
            out += [(i, used[p[3]][0], r + 1, used[s[3]][0], -p[0], -s[0]) for r, s in enumerate(fit)]
    return sorted(out, key=repr)


def run(spark, rows, every=10):
    frame = spark.createDataFrame([(i, e, lab, "a", "b") for i, e, lab in rows], SCHEMA)
    got = negatives.hard_negatives(frame, F.col("vec_id") % every == 0)
    names = ("anchor_id", "positive_id", "rank", "negative_id", "positive_score", "negative_score")
    return sorted((tuple(r[c] for c in names) for r in got.collect()), key=repr)


@pytest.fixture(params=["whole", "small"])
def tiles(request, monkeypatch):
    if request.param == "small":
        for name, value in (("TILE", 7), ("STEP", 2), ("BLOCK", 4), ("SLICE", (16, 16))):
            monkeypatch.setattr(negatives, name, value)


def test_equals_plain_version(spark, tiles):
    rng = np.random.default_rng(1)
    heads = rng.normal(size=(4, 12))
    rows = []
    for k in range(130):
        v = heads[k % 4] + rng.normal(size=12) * 0.4 if k % 3 else rng.normal(size=12)
        rows.append((k, (v / np.linalg.norm(v)).tolist(), int(rng.integers(0, 3))))
    assert run(spark, rows) == plain(rows, lambda i: i % 10 == 0)


def test_ties_copies_and_odd_rows(spark, tiles):
    nan, inf = float("nan"), float("inf")
    rng = np.random.default_rng(2)
    rows = [(k, rng.choice([0.0, 0.25, -0.25], 4).tolist(), int(rng.integers(0, 2))) for k in range(60)]
    rows += [(7, [0.25, 0.25, 0.0, 0.0], k % 2) for k in range(9)]
    rows += [(20, [0.25, 0.0, 0.0, 0.0], 1)] * 2 + [(None, [0.25, 0.25, 0.25, 0.25], 0), (None, [0.25, 0.25, 0.25, 0.25], 1)]
    rows += [(100, None, 1), (110, [nan, 0.0, 0.0, 0.0], 1), (120, [inf, 0.0, 0.0, 0.0], 0), (130, [None, 1.0, 0.0, 0.0], 0), (140, [1.0, 1.0, 1.0, 1.0], None)]
    rows += [(150, [], 0), (160, [0.5, 0.5], 1), (170, [0.0, 0.0, 0.0, 0.0], 1)]
    assert run(spark, rows) == plain(rows, lambda i: i % 10 == 0)


def test_few_rows_and_none(spark):
    assert run(spark, []) == [] == run(spark, [(10, [1.0], 1)])
    lonely = [(10, [1.0, 0.0], 1), (11, [1.0, 0.0], 2), (12, [0.9, 0.1], 1)]
    assert run(spark, lonely) == plain(lonely, lambda i: i % 10 == 0) == []
    lonely[1] = (11, [0.85, 0.0], 2)
    assert run(spark, lonely) == plain(lonely, lambda i: i % 10 == 0) != []


def test_negative_and_huge_scores(spark):
    rows = [(0, [-1.0, 0.0], 1), (1, [1.0, 0.0], 1), (2, [1.0, 0.1], 2), (3, [0.0, 0.0], 1), (4, [0.0, 1.0], 2)]
    assert run(spark, rows) == plain(rows, lambda i: i % 10 == 0)
    huge = [(0, [3e4, 1e30], 1), (1, [3e4, 3e4], 1), (2, [1e30, 2e4], 2)]
    run(spark, huge)


@pytest.mark.parametrize("threshold", [-(10**6), 0, 5_000, 30_000, 10**9])
def test_index_misses_no_pair(threshold):
    rng = np.random.default_rng(5)
    q, y = rng.integers(-60, 60, (40, 24)).astype(float), rng.integers(-60, 60, (70, 24)).astype(float)
    y[:5] = 0
    rest = negatives._suffix_norms(y)
    index = negatives.Index(q, np.full(40, float(threshold)), rest.max(axis=0))
    found = set(zip(*(c.tolist() for c in index.candidates(y, rest))))
    want = set(zip(*(c.tolist() for c in np.nonzero(q @ y.T >= threshold))))
    assert want <= found
    if threshold == 30_000:
        assert len(found) < 0.2 * 40 * 70 and (index.cut < 24).all()
