"""Signals: onsets, snapping, syllables, clip location and summaries."""

import math
import random

import numpy as np
import pytest

from cadenza.operators import signals as G
from cadenza.operators.joins import frame_active, nearest_onset, snap_nearest, snap_radius
from pyspark.sql import functions as F

RATE = 44_100


@pytest.fixture(scope="module")
def pulses(spark):
    """Two seconds with bursts at 0.5 s and 1.2 s."""
    signal = np.zeros(2 * RATE)
    for at, gain in ((0.5, 0.95), (1.2, 0.85)):
        signal[round(RATE * at) : round(RATE * at) + 500] += gain * np.sin(np.arange(500) * 0.2)
    blocks = [(1, b, signal[b * 4410 : (b + 1) * 4410].tolist()) for b in range(20)]
    df = spark.createDataFrame(blocks, "track_id bigint, block_no bigint, samples array<double>")
    return G.explode_blocks(df, 4410)


def test_bursts_are_found(pulses):
    found = [r.at_us / 1e6 for r in G.detect_onsets(pulses, RATE).collect()]
    assert any(abs(t - 0.5) < 0.08 for t in found) and any(abs(t - 1.2) < 0.08 for t in found)
    assert len(found) < 10


def test_words_snap_inside_their_line(spark):
    onsets = spark.createDataFrame([(1, 1_020_000), (1, 2_050_000), (1, 2_490_000), (1, 3_120_000)], "track_id bigint, at_us bigint")
    words = spark.createDataFrame(
        [
            (1, 0, 1_000_000, 1_600_000, 0.8, 800_000, 2_500_000),
            (1, 1, 2_480_000, 2_700_000, 0.8, 800_000, 2_500_000),
            (1, 2, 900_000, 1_200_000, 0.8, 800_000, 2_500_000),
            (1, 3, 1_500_000, 1_700_000, 0.8, 800_000, 2_500_000),
        ],
        "track_id bigint, n bigint, start_us bigint, end_us bigint, confidence double, line_start_us bigint, line_end_us bigint",
    )
    got = {r.n: r for r in nearest_onset(words, onsets).collect()}
    assert (got[0].start_us, got[0].end_us, got[0].confidence) == (1_020_000, 1_600_000, 0.9)
    assert got[1].start_us == 2_440_000  # kept 60 ms before the line ends
    assert (got[2].start_us, got[2].confidence) == (1_020_000, 0.65)
    assert not got[3].snapped and got[3].start_us == 1_500_000


def test_snap_takes_the_nearest_target(spark):
    times = spark.createDataFrame([(1, i, t) for i, t in enumerate([95_000, 150_000, 100_000, -40_000])], "track_id bigint, id bigint, at_us bigint")
    targets = spark.createDataFrame([(1, t) for t in (0, 100_000, 200_000)], "track_id bigint, target_us bigint")
    got = [r.snapped_us for r in snap_nearest(times, targets, F.lit(snap_radius(100))).orderBy("id").collect()]
    assert got == [100_000, 100_000, 100_000, 0]


def test_syllables_divide_or_follow_onsets(spark):
    words = spark.createDataFrame(
        [(1, 0, 1_000_000, 2_000_000, 4), (1, 1, 3_000_000, 4_000_000, 3), (1, 2, 5_000_000, 5_500_000, 1)],
        "track_id bigint, n bigint, start_us bigint, end_us bigint, syllables bigint",
    )
    onsets = spark.createDataFrame([(1, t) for t in (3_300_000, 3_500_000, 3_990_000)], "track_id bigint, at_us bigint")
    got = {}
    for r in G.syllable_starts(words, onsets).orderBy("n", "syllable").collect():
        got.setdefault(r.n, []).append(r.start_us)
    assert got == {
        0: [1_000_000, 1_250_000, 1_500_000, 1_750_000],
        1: [3_000_000, 3_300_000, 3_500_000],
        2: [5_000_000],
    }


@pytest.mark.parametrize("block_len", [64, 400, 1000])
def test_known_delay(spark, block_len):
    """A clip of 80 samples at delay 220 of 1000, whatever the block length."""
    clip = np.sin(2 * np.pi * 40 * np.arange(80) / 1000)
    master = np.zeros(1000)
    master[220:300] = clip
    blocks = spark.createDataFrame(
        [(1, b, master[b * block_len : (b + 1) * block_len].tolist()) for b in range(math.ceil(1000 / block_len))],
        "track_id bigint, block_no bigint, samples array<double>",
    )
    clips = spark.createDataFrame([(7, 1, clip.tolist(), 200_000)], "clip_id bigint, track_id bigint, clip array<double>, cursor_us bigint")
    for hit in (
        G.lag_xcorr(blocks, clips, block_len),
        G.lag_xcorr_coarse(blocks, clips, block_len, 300),
        G.clip_search_window(blocks, clips, block_len, 300),
    ):
        r = hit.first()
        assert abs(r.lag - 220) < 2 and r.confidence > 0.7


def test_long_clips_take_the_transform_way():
    rng = np.random.default_rng(5)
    master, clip = rng.normal(size=4000), rng.normal(size=900)
    master[1234 : 1234 + 900] += 3 * clip
    lag, value, local, own = G._best_lag(master, 0, 3000, 0, 4000, clip, 1)
    plain = [float(master[p : p + 900] @ clip) for p in range(3000)]
    assert lag == int(np.argmax(plain)) == 1234 and abs(value - max(plain)) < 1e-6


def test_loudness_summaries(spark):
    rng = random.Random(2)
    v = [rng.uniform(-1, 1) for _ in range(1000)]
    df = spark.createDataFrame([(1, i, x) for i, x in enumerate(v)], "track_id bigint, pos bigint, v double")
    peaks = {r.bucket: r.peak for r in G.waveform_peaks(df, 30).collect()}
    assert peaks == {b: max(abs(x) for x in v[b * 33 : b * 33 + 33]) for b in range(30)}
    down = [r.v for r in G.downsample(df, 441, 160).orderBy("pos").collect()]
    assert down == [v[i * 441 // 160] for i in range(1000 * 160 // 441)]
    hop, frame = G.frame_sizes(1000)
    rms = {r.frame: r.rms for r in G.frame_rms(df, 1000).collect()}
    assert len(rms) == (1000 - frame) // hop
    assert all(abs(rms[f] - math.sqrt(sum(x * x for x in v[f * hop : f * hop + frame]) / frame)) < 1e-6 for f in rms)


def test_captions_without_words_are_drawn(spark):
    captions = spark.createDataFrame(
        [(1, 0, 0, 1_000_000, "two words"), (1, 1, 1_000_000, 2_000_000, "also two"), (1, 2, 2_000_000, 3_000_000, "")],
        "track_id bigint, idx bigint, start_us bigint, end_us bigint, text string",
    ).withColumn("confidence", F.lit(0.5)).withColumn("instrumental", F.lit(False))
    words = spark.createDataFrame([(1, 0, 0, 900_000)], "track_id bigint, idx bigint, start_us bigint, end_us bigint")
    got = {(r.idx, r.frame): (r.future, r.past, r.active) for r in frame_active(captions, words, 4).collect()}
    assert got[0, 2] == (0, 0, 1) and got[1, 5] == (1, 0, 1) and got[1, 7] == (0, 1, 1) and got[2, 9] == (0, 0, 0)


def test_frames_between_two_changes_are_counted_once(spark):
    captions = spark.createDataFrame(
        [(1, 0, 0, 3_000_000, "one two"), (1, 1, 1_000_001, 999_999, "x"), (1, 2, 500_000, 700_000, "♪"), (1, 3, 0, 100_000, None)],
        "track_id bigint, idx bigint, start_us bigint, end_us bigint, text string",
    )
    words = spark.createDataFrame(
        [(1, 0, 33_333, 33_334), (1, 0, 33_334, 2_000_000), (1, 0, 1_500_000, 1_400_000), (1, 0, 9_000_000, 9_500_000), (1, 0, None, 5)],
        "track_id bigint, idx bigint, start_us bigint, end_us bigint",
    )
    for offset, lead in ((0, 0), (100_000, -40_000)):
        active = frame_active(captions, words, 30, offset, lead)
        got = {(r.idx, r.frame): (r.future, r.past, r.active) for r in active.collect()}
        spans = {0: [tuple(r[2:]) for r in words.collect()], 1: [(1_000_001, 1_040_001)], 2: [], 3: []}
        want = {}
        for _, idx, start, end, _ in captions.collect():
            for frame in range(0, 200):
                if start - 50_000 <= frame * 1_000_000 / 30 + offset <= end + 50_000:
                    at = int(frame * 1_000_000 / 30 + 0.5) + offset - lead
                    known = [(s, e) for s, e in spans[idx] if s is not None]
                    want[idx, frame] = (
                        sum(at < s for s, _ in known),
                        sum(at >= s and at >= e for s, e in known),
                        sum(s <= at < e for s, e in known),
                    )
        assert got == want
    plan = frame_active(captions, words, 30)._jdf.queryExecution().optimizedPlan().toString()
    assert "filter(" not in plan.split("Join")[0].split("explode(sequence")[0]
