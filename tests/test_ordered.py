"""Two-level scans, as-of joins and folds against their plain meaning."""

import random

import pytest
from hypothesis import HealthCheck, given, settings
from hypothesis import strategies as st
from pyspark.sql import Window
from pyspark.sql import functions as F

from cadenza.operators.signals import onset_thin
from cadenza.operators.tracks import monotone_reject, monotone_sweep
from cadenza.plans import folds, maps
from cadenza.plans.folds import chunked_fold
from cadenza.plans.ordered import by_time, nearest_neighbours, scan

tracks = st.lists(
    st.tuples(st.integers(0, 2), st.integers(0, 60), st.one_of(st.none(), st.integers(-9, 9))),
    min_size=1,
    max_size=40,
)


@settings(max_examples=8, deadline=None, suppress_health_check=[HealthCheck.function_scoped_fixture])
@given(tracks)
def test_scan_equals_plain_windows(spark, rows, data):
    df = spark.createDataFrame(
        [(t, at, i, v) for i, (t, at, v) in enumerate(data)], "track_id bigint, at bigint, id bigint, v bigint"
    )
    v = F.col("v")
    got = scan(
        df,
        ["track_id"],
        ["at", "id"],
        by_time("at", 7),
        lag={"a": v},
        lead={"b": v},
        last_upto={"c": v},
        last_before={"d": v},
        first_after={"e": v},
        sum_upto={"f": F.coalesce(v, F.lit(0))},
        sum_before={"g": F.lit(1).cast("bigint")},
        max_before={"h": v},
        total={"i": ("sum", v), "j": ("min", v), "k": ("max", v)},
    )
    w = Window.partitionBy("track_id").orderBy("at", "id")
    before = w.rowsBetween(Window.unboundedPreceding, -1)
    after = w.rowsBetween(1, Window.unboundedFollowing)
    whole = Window.partitionBy("track_id")
    want = df.withColumns(
        {
            "a": F.lag("v").over(w),
            "b": F.lead("v").over(w),
            "c": F.last("v", True).over(w),
            "d": F.last("v", True).over(before),
            "e": F.first("v", True).over(after),
            "f": F.sum(F.coalesce(v, F.lit(0))).over(w),
            "g": F.row_number().over(w).cast("bigint") - 1,
            "h": F.max("v").over(before),
            "i": F.sum("v").over(whole),
            "j": F.min("v").over(whole),
            "k": F.max("v").over(whole),
        }
    )
    assert rows(got, *want.columns) == rows(want)


def test_neighbours_prefer_nothing_over_other_tracks(spark):
    points = spark.createDataFrame([(1, 0, 50), (2, 1, 50)], "track_id bigint, id bigint, at bigint")
    targets = spark.createDataFrame([(1, 40), (1, 50), (1, 61)], "track_id bigint, t bigint")
    got = {
        r.id: (r.prev and r.prev["at"], r.next and r.next["at"])
        for r in nearest_neighbours(points, targets, ["track_id"], "at", ["id"], "t", 10).collect()
    }
    assert got == {0: (50, 61), 1: (None, None)}


def test_reject_over_many_chunks(spark):
    """One track of 3000 words, far longer than a chunk of the fold."""
    rng = random.Random(3)
    starts, at = [], 0
    for _ in range(3000):
        at += rng.randint(-30_000, 40_000)
        starts.append(max(0, at))
    df = spark.createDataFrame([(1, i, s) for i, s in enumerate(starts)], "track_id bigint, i bigint, start_us bigint")
    want, last = [], None
    for s in starts:
        ok = last is None or s >= last - 20_000
        want.append(ok)
        last = s if ok else last
    got = [r.accepted for r in monotone_reject(df).orderBy("i").collect()]
    assert got == want and False in want


def test_sweep_over_many_chunks(spark):
    rng = random.Random(4)
    words = [(i * 50_000 + rng.randint(-90_000, 90_000), rng.randint(10_000, 400_000)) for i in range(1500)]
    words = [(max(0, s), max(0, s) + d) for s, d in words]
    df = spark.createDataFrame(
        [(1, i, s, e) for i, (s, e) in enumerate(words)], "track_id bigint, i bigint, start_us bigint, end_us bigint"
    )
    done = [list(w) for w in words]
    for k, cur in enumerate(done):
        prev = done[k - 1] if k else None
        if prev and cur[0] < prev[1]:
            prev[1] = cur[0] = (prev[1] + cur[0]) // 2
        cur[1] = max(cur[1], cur[0] + 80_000)
        if prev and cur[0] < prev[0] + 20_000:
            cur[0] = prev[0] + 20_000
            cur[1] = max(cur[1], cur[0] + 80_000)
    got = [[r.start_us, r.end_us] for r in monotone_sweep(df).orderBy("i").collect()]
    assert got == done


def test_thinning_keeps_the_distance(spark):
    rng = random.Random(5)
    frames = sorted(rng.sample(range(5000), 2500))
    df = spark.createDataFrame([(1, f, 0.5) for f in frames], "track_id bigint, frame bigint, flux double")
    want, last = [], -99
    for f in frames:
        if f - last >= 7:
            want.append(f)
            last = f
    assert [r.frame for r in onset_thin(df, 7).orderBy("frame").collect()] == want


def test_fold_whose_state_never_forgets(spark):
    """A running total needs every chunk's entry state: the slowest case, still exact."""
    df = spark.createDataFrame([(1, i, i % 5) for i in range(40)], "track_id bigint, i bigint, v bigint")
    start = F.struct(F.lit(0).cast("bigint").alias("sum"))
    step = lambda s, x: F.struct((s["sum"] + x["v"]).alias("sum"))
    emit = lambda a, x, b: F.struct(x["i"].alias("i"), b["sum"].alias("sum"))
    got = chunked_fold(df, ["track_id"], "i", ["v"], start, step, emit, size=4).orderBy("i").collect()
    assert [r["sum"] for r in got] == [sum(j % 5 for j in range(i + 1)) for i in range(40)]


def test_early_outlier_costs_no_round_per_chunk(spark, monkeypatch):
    staged = []
    real = folds.stage
    monkeypatch.setattr(folds, "stage", lambda df, name: staged.append(name) or real(df, name))
    monkeypatch.setattr(folds, "FOLD_ROWS", 4)
    n = 400
    starts = [(1, i, 50_000_000 if i == 1 else i * 1000) for i in range(n)]
    got = monotone_reject(spark.createDataFrame(starts, "track_id bigint, i bigint, start_us bigint")).filter("accepted")
    assert sorted(r.i for r in got.collect()) == [0, 1]
    assert staged.count("fold-state") <= 3


def plain_sweep(words):
    out, before = [], None
    for s, e in words:
        start = (before[1] + s) // 2 if before and s < before[1] else s
        end = max(e, start + 80_000)
        if before and before[0] + 20_000 > start:
            start = before[0] + 20_000
            end = max(end, start + 80_000)
        out.append((start, end))
        before = out[-1]
    return out


def plain_thin(frames, distance):
    kept = []
    for f in frames:
        if not kept or f - kept[-1] >= distance:
            kept.append(f)
    return kept


def plain_reject(starts):
    bar, out = -(2**62), []
    for s in starts:
        out.append(s >= bar - 20_000)
        bar = s if out[-1] else bar
    return out


def rounds(monkeypatch, run):
    """Result of a fold and how many tables of maps it staged."""
    staged = []
    real = maps.stage
    with monkeypatch.context() as m:
        m.setattr(maps, "stage", lambda df, name: staged.append(name) or real(df, name))
        m.setattr(folds, "FOLD_ROWS", 4)
        return run(), staged.count("fold-maps")


def test_map_of_a_stretch_is_the_sweep():
    rng = random.Random(3)
    for n in (1, 2, 5, 40):
        for scale in (1_000, 60_000, 3_000_000):
            starts = [rng.randrange(scale) + k * rng.choice((0, 15_000, 30_000)) for k in range(n)]
            ends = [s + rng.randrange(150_000) for s in starts]
            top = 10**9
            cut = rng.randrange(n + 1)
            one = maps.sweep_map(starts[:cut], ends[:cut], 77_000, top, 80_000, 20_000)
            two = maps.sweep_map(starts[cut:], ends[cut:], ends[cut - 1] if cut else 77_000, top, 80_000, 20_000)
            joined = maps.Halvings.read(one.text()).then(two)
            assert len(joined.pieces) < 64
            for a in [0, 1, 20_001, 80_000, 500_000, 3_000_001, 40_000_000, 999_999_999, *(rng.randrange(10**7) for _ in range(20))]:
                before = (a, max(77_000, a + 80_000))
                for s, e in zip(starts, ends):
                    mid = (before[1] + s) // 2 if s < before[1] else s
                    start = max(mid, before[0] + 20_000)
                    before = (start, max(e, start + 80_000))
                assert joined.at(a) == before[0]


@pytest.mark.parametrize("outlier", [0, 10**9])
def test_sweep_that_never_forgets_takes_few_rounds(spark, monkeypatch, outlier):
    """A first word far too late pushes every later one: 50 chunks, a handful of rounds."""
    rng = random.Random(9)
    words = [(outlier + 1_000_000, outlier + 1_100_000)] + [(s := k * 19_000 + rng.randrange(9_000), s + rng.randrange(120_000)) for k in range(199)]
    other = [(k * 300_000, k * 300_000 + rng.randrange(500_000)) for k in range(3)]
    rows = [(t, i, s, e) for t, track in ((1, words), (2, other)) for i, (s, e) in enumerate(track)]
    df = spark.createDataFrame(rows, "track_id bigint, i bigint, start_us bigint, end_us bigint")
    got, staged = rounds(monkeypatch, lambda: monotone_sweep(df).orderBy("track_id", "i").collect())
    assert [r.start_us for r in got] == [s for track in (words, other) for s, _ in plain_sweep(track)]
    assert staged <= 8


@pytest.mark.parametrize("distance", [1, 3, 4, 9, 40])
def test_thin_by_maps(spark, monkeypatch, distance):
    rng = random.Random(distance)
    frames = sorted(rng.sample(range(400), 150)) + [900, 901, 5000]
    df = spark.createDataFrame([(1, f, 0.5) for f in frames], "track_id bigint, frame bigint, flux double")
    got, staged = rounds(monkeypatch, lambda: onset_thin(df, distance).orderBy("frame").collect())
    assert [r.frame for r in got] == plain_thin(frames, distance) and staged <= 9


def test_reject_by_maps(spark, monkeypatch):
    rng = random.Random(1)
    starts = [int(k * 30_000 + rng.gauss(0, 60_000)) + (2_000_000 if k == 20 else 0) for k in range(160)]
    df = spark.createDataFrame([(1, k, s) for k, s in enumerate(starts)], "track_id bigint, i bigint, start_us bigint")
    got, staged = rounds(monkeypatch, lambda: monotone_reject(df).orderBy("i").collect())
    assert [r.accepted for r in got] == plain_reject(starts) and staged <= 7
