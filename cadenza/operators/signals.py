"""Sampled signals: energy, onsets, spectra and clip location.

``samples[track_id, pos, v]`` is a signal with one row per sample, ``blocks[track_id,
block_no, samples]`` the same in arrays of one fixed length.  Sample rows are combined on
the map side before any shuffle; a long track spreads over its blocks.
"""

from __future__ import annotations

import math
import sys

import numpy as np
import pandas as pd
from pyspark import cloudpickle
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.types import DoubleType, LongType, StructType

from cadenza.functions.timecode import clamp, half_up, idiv
from cadenza.plans.folds import chunked_fold
from cadenza.plans.maps import ChunkMaps
from cadenza.plans.ordered import by_rows, scan
from cadenza.plans.ranges import points_in_intervals
from cadenza.plans.skew import join_small
from cadenza.session import stage

# the Arrow function travels with the job, so executors need no copy of this package
cloudpickle.register_pickle_by_value(sys.modules[__name__])

TRACK = ["track_id"]

# Fixed values of onset detection.
FLUX_FLOOR, PEAK_RADIUS = 0.12, 7
THRESHOLD_GAIN, THRESHOLD_BASE = 1.35, 0.05
MIN_PEAK_DISTANCE_MS = 45

# Fixed values of the spectrum and its bands.
SPECTRUM_GAIN, SPECTRUM_TILT = 4.5, 1.5
BASS_END, MID_END, BAND_BINS = 6, 20, 48
KICK_GAIN, KICK_POWER = 1.5, 1.6

# Fixed values of clip location.
COARSE_FACTOR, COARSE_FLOOR, REFINE_PAD_S, DIRECT_BELOW_S = 4, 0.25, 0.5, 2.0
SEARCH_BACK_S, SEARCH_AHEAD_S = 1.5, 12.0
TINY = 1e-12


def explode_blocks(blocks: DataFrame, block_len: int) -> DataFrame:
    return blocks.select("track_id", "block_no", F.posexplode("samples")).select(
        "track_id",
        (F.col("block_no") * block_len + F.col("pos")).cast("bigint").alias("pos"),
        F.col("col").cast("double").alias("v"),
    )


def track_lengths(samples: DataFrame) -> DataFrame:
    return samples.groupBy("track_id").agg((F.max("pos") + 1).alias("len"))


def block_lengths(blocks: DataFrame, block_len: int) -> DataFrame:
    return blocks.groupBy("track_id").agg(
        F.max(F.col("block_no") * block_len + F.size("samples")).cast("bigint").alias("len")
    )


# --- energy and onsets -------------------------------------------------------------


def frame_sizes(rate: int, hop_ms: float = 10, frame_ms: float = 25) -> tuple[int, int]:
    hop = max(1, math.floor(hop_ms / 1000 * rate))
    return hop, max(hop, math.floor(frame_ms / 1000 * rate))


def frame_rms(samples: DataFrame, rate: int, hop_ms: float = 10, frame_ms: float = 25) -> DataFrame:
    """Energy of overlapping frames.

    Squares are first summed into cells (the common divisor of hop and frame), so that
    overlapping frames add up cells, not samples.
    """
    hop, frame = frame_sizes(rate, hop_ms, frame_ms)
    cell = math.gcd(hop, frame)
    step, width = hop // cell, frame // cell
    cells = samples.groupBy("track_id", idiv(F.col("pos"), cell).alias("c")).agg(
        F.sum(F.col("v") * F.col("v")).alias("e"), (F.max("pos") + 1).alias("top")
    )
    cells = stage(cells, "energy-cells")
    lengths = cells.groupBy("track_id").agg(F.max("top").alias("len"))
    first = F.greatest(F.lit(0).cast("bigint"), F.ceil((F.col("c") - width + 1) / F.lit(step)).cast("bigint"))
    frames = (
        cells.withColumn("frame", F.explode(F.sequence(first, idiv(F.col("c"), step))))
        .groupBy("track_id", "frame")
        .agg(F.round(F.sqrt(F.sum("e") / frame), 6).alias("rms"))
    )
    count = F.floor((F.col("len") - frame) / F.lit(hop))
    return join_small(frames, lengths, TRACK, ["frame"]).filter(F.col("frame") < count).drop("len")


def energy_flux(rms: DataFrame) -> DataFrame:
    """Rise of energy from frame to frame, relative to the track's largest rise."""
    rise = F.greatest(F.lit(0.0), F.col("rms") - F.coalesce("__prev", "rms"))
    risen = scan(rms, TRACK, ["frame"], by_rows("frame"), lag={"__prev": F.col("rms")}).select(
        "track_id", "frame", rise.alias("__rise")
    )
    peak = scan(
        stage(risen, "flux"), TRACK, ["frame"], by_rows("frame"), total={"__peak": ("max", F.col("__rise"))}
    )
    return peak.select(
        "track_id", "frame", (F.col("__rise") / F.greatest(F.lit(1e-6), "__peak")).alias("flux")
    )


def with_halo(df: DataFrame, index: str, radius: int, size: int = 4096) -> DataFrame:
    """Chunks of a dense index, each also holding ``radius`` rows of its neighbours."""
    own = idiv(F.col(index), size)
    offset = F.col(index) % size
    chunks = F.array_compact(
        F.array(
            own,
            F.when((offset < radius) & (own > 0), own - 1),
            F.when(offset >= size - radius, own + 1),
        )
    )
    return df.withColumn("__own", own).withColumn("__chunk", F.explode(chunks))


def onset_candidates(flux: DataFrame) -> DataFrame:
    """Local flux maxima above a moving threshold."""
    w = Window.partitionBy("track_id", "__chunk").orderBy("frame")
    near = w.rowsBetween(-PEAK_RADIUS, PEAK_RADIUS)
    seen = with_halo(flux, "frame", PEAK_RADIUS).withColumns(
        {
            "__b1": F.lag("flux", 1).over(w),
            "__b2": F.lag("flux", 2).over(w),
            "__a1": F.lead("flux", 1).over(w),
            "__a2": F.lead("flux", 2).over(w),
            "__mean": F.avg("flux").over(near),
        }
    )
    v = F.col("flux")
    peak = (v > F.col("__b1")) & (v > F.col("__b2")) & (v >= F.col("__a1")) & (v >= F.col("__a2"))
    loud = (v >= FLUX_FLOOR) & (v >= F.col("__mean") * THRESHOLD_GAIN + THRESHOLD_BASE)
    return seen.filter((F.col("__own") == F.col("__chunk")) & peak & loud).select("track_id", "frame", "flux")


def onset_thin(candidates: DataFrame, min_frames: int) -> DataFrame:
    """Keep candidates at least ``min_frames`` after the last kept one."""
    start = F.struct(F.lit(-(2**62)).cast("bigint").alias("at"))

    def step(state: Column, row: Column) -> Column:
        far = row["frame"] - state["at"] >= min_frames
        return F.struct(F.when(far, row["frame"]).otherwise(state["at"]).alias("at"))

    def emit(before: Column, row: Column, after: Column) -> Column:
        return F.struct(
            row["frame"].alias("frame"),
            row["flux"].alias("flux"),
            (row["frame"] - before["at"] >= min_frames).alias("kept"),
        )

    # the last kept frame before a chunk decides which of its first candidates is kept first, and
    # that one decides the rest: (first, pieces of (limit, end)), a state up to a limit leaving as end
    def build(packed: DataFrame, keys: list[str]) -> DataFrame:
        first = F.get("__items", F.lit(0))["frame"]
        near = F.filter("__items", lambda c: c["frame"] < first + min_frames)
        heads = F.slice("__items", 1, F.size(near) + 1)
        pieces = F.transform(heads, lambda c: F.struct(
            (c["frame"] - min_frames).alias("limit"),
            F.aggregate("__items", F.struct((c["frame"] - min_frames).alias("at")), step)["at"].alias("end"),
        ))
        return packed.withColumn("__map", F.struct(first.alias("first"), pieces.alias("pieces")))

    def through(pieces: Column, at: Column) -> Column:
        return F.coalesce(F.get(F.filter(pieces, lambda p: at <= p["limit"]), F.lit(0))["end"], at)

    def then(one: Column, two: Column) -> Column:
        seen = F.element_at(one["pieces"], -1)["limit"]
        moved = F.transform(one["pieces"], lambda p: F.struct(p["limit"].alias("limit"), through(two["pieces"], p["end"]).alias("end")))
        # states that pass the first stretch unchanged lie above its limits and below its first candidate
        more = F.filter(two["pieces"], lambda p, k: (p["limit"] > seen) & (
            (k == 0) | (F.get(two["pieces"], k - 1)["limit"] < one["first"])
        ) & (seen < one["first"] - 1))
        return F.struct(one["first"].alias("first"), F.concat(moved, more).alias("pieces"))

    maps = ChunkMaps(build, then, lambda m, row: F.struct(F.get(m["pieces"], F.lit(0))["end"].alias("at")))
    return (
        chunked_fold(candidates, TRACK, "frame", ["flux"], start, step, emit, maps=maps)
        .filter("kept")
        .select("track_id", "frame", "flux")
    )


def detect_onsets(
    samples: DataFrame,
    rate: int,
    hop_ms: float = 10,
    frame_ms: float = 25,
    min_peak_distance_ms: float = MIN_PEAK_DISTANCE_MS,
) -> DataFrame:
    """Onset times of every track."""
    hop, _ = frame_sizes(rate, hop_ms, frame_ms)
    flux = energy_flux(stage(frame_rms(samples, rate, hop_ms, frame_ms), "frames"))
    kept = onset_thin(onset_candidates(flux), max(1, math.floor(min_peak_distance_ms / hop_ms)))
    return kept.select(
        "track_id", half_up(F.col("frame") * hop * 1_000_000 / F.lit(rate)).alias("at_us")
    )


def syllable_starts(words: DataFrame, onsets: DataFrame) -> DataFrame:
    """Start times of the syllables of each word.

    ``words[track_id, n, start_us, end_us, syllables]``.  The first onsets inside a word
    are used when there are enough and all lie 30 ms away from its ends; otherwise the
    word is divided evenly.
    """
    on = ["track_id", "n"]
    margin = 30_000
    many = words.filter("syllables > 1")
    inside = points_in_intervals(
        onsets.distinct(), "at_us", many, "start_us", "end_us", TRACK, 30_000_000
    )
    w = Window.partitionBy(*on).orderBy("at_us")
    first = inside.withColumn("rank", F.row_number().over(w)).filter(F.col("rank") <= F.col("syllables") - 1)
    usable = (F.col("at_us") > F.col("start_us") + margin) & (F.col("at_us") < F.col("end_us") - margin)
    heard = (
        first.filter(usable)
        .groupBy(*on, "syllables")
        .agg(F.array_sort(F.collect_list("at_us")).alias("__at"))
        .filter(F.size("__at") == F.col("syllables") - 1)
        .drop("syllables")
    )
    count = F.greatest(F.lit(1), F.col("syllables"))
    span = F.greatest(F.lit(40_000), F.col("end_us") - F.col("start_us"))
    even = F.transform(
        F.sequence(F.lit(0).cast("bigint"), count - 1), lambda i: F.col("start_us") + idiv(span * i, count)
    )
    starts = F.when(
        F.col("__at").isNotNull(), F.concat(F.array("start_us"), F.col("__at"))
    ).otherwise(even)
    return (
        words.join(heard, on, "left")
        .select(*on, F.posexplode(starts))
        .select(*on, F.col("pos").cast("bigint").alias("syllable"), F.col("col").alias("start_us"))
    )


# --- summaries ---------------------------------------------------------------------


def waveform_peaks(samples: DataFrame, buckets: int = 1800) -> DataFrame:
    """Largest absolute amplitude in each of ``buckets`` equal stretches of a track."""
    lengths = track_lengths(samples)
    step = F.greatest(F.lit(1).cast("bigint"), idiv(F.col("len"), buckets))
    peaks = (
        join_small(samples, lengths, TRACK, ["pos"])
        .groupBy("track_id", idiv(F.col("pos"), step).alias("bucket"))
        .agg(F.max(F.abs("v")).alias("peak"))
    )
    grid = lengths.select(
        "track_id", F.explode(F.sequence(F.lit(0).cast("bigint"), F.lit(buckets - 1).cast("bigint"))).alias("bucket")
    )
    return grid.join(peaks, ["track_id", "bucket"], "left").select(
        "track_id", "bucket", F.coalesce("peak", F.lit(0.0)).alias("peak")
    )


def downsample(samples: DataFrame, from_rate: int, to_rate: int) -> DataFrame:
    """Nearest-earlier-sample resampling; each sample lists the output places it fills."""
    lengths = track_lengths(samples)
    first = idiv(F.col("pos") * to_rate + (from_rate - 1), from_rate)
    last = idiv((F.col("pos") + 1) * to_rate + (from_rate - 1), from_rate) - 1
    size = F.greatest(F.lit(1).cast("bigint"), idiv(F.col("len") * to_rate, from_rate))
    filled = samples.filter(last >= first).withColumn("i", F.explode(F.sequence(first, last)))
    return (
        join_small(filled, lengths, TRACK, ["i"])
        .filter(F.col("i") < size)
        .select("track_id", F.col("i").alias("pos"), "v")
    )


def spectrum_bins(
    samples: DataFrame, rate: int, fps: int, window: int = 2048, bins: int = BAND_BINS, min_samples: int = 64
) -> DataFrame:
    """Level of each bin in the window around every video frame."""
    lengths = track_lengths(samples)
    total = F.ceil(F.col("len") * fps / F.lit(rate)).cast("bigint")
    frames = lengths.select(
        "track_id", "len", F.explode(F.sequence(F.lit(0).cast("bigint"), total - 1)).alias("frame")
    )
    centre = half_up(F.col("frame") * rate / F.lit(fps))
    start = F.greatest(F.lit(0).cast("bigint"), centre - window // 2)
    end = F.least(F.col("len"), start + window)
    frames = frames.withColumn("lo", start).withColumn("hi", end - 1).withColumn("size", end - F.col("lo"))
    frames = frames.withColumn("step", idiv(F.col("size"), bins)).drop("len")
    grid = frames.select(
        "track_id", "frame", F.explode(F.sequence(F.lit(0).cast("bigint"), F.lit(bins - 1).cast("bigint"))).alias("bin")
    )
    wide = frames.filter(F.col("size") > min_samples)
    level = (
        points_in_intervals(samples, "pos", wide, "lo", "hi", TRACK, window)
        .withColumn("bin", idiv(F.col("pos") - F.col("lo"), F.col("step")))
        .filter(F.col("bin") < bins)
        .groupBy("track_id", "frame", "bin")
        .agg(F.sqrt(F.sum(F.col("v") * F.col("v")) / F.count(F.lit(1))).alias("rms"))
    )
    boost = 1 + F.col("bin") / F.lit(bins) * SPECTRUM_TILT
    value = F.coalesce(clamp(F.col("rms") * SPECTRUM_GAIN * boost, 0.0, 1.0), F.lit(0.0))
    return grid.join(level, ["track_id", "frame", "bin"], "left").select(
        "track_id", "frame", "bin", F.round(value, 6).alias("value")
    )


def band_energy(bins: DataFrame) -> DataFrame:
    """Bass, mid and high level of each frame, and the kick drawn from the bass.

    Levels are added as whole millionths, so the sums do not depend on their order.
    """
    b, v = F.col("bin"), F.round(F.col("value") * 1_000_000).cast("bigint")

    def band(low: int, high: int, size: Column) -> Column:
        return F.sum(F.when((b >= low) & (b < high), v).otherwise(0)) / size / F.lit(1_000_000)

    rest = F.greatest(F.lit(1), F.count(F.lit(1)) - MID_END)
    levels = bins.filter(b < BAND_BINS).groupBy("track_id", "frame").agg(
        band(0, BASS_END, F.lit(BASS_END)).alias("bass"),
        band(BASS_END, MID_END, F.lit(MID_END - BASS_END)).alias("mid"),
        band(MID_END, BAND_BINS, rest).alias("high"),
    )
    kick = F.pow(F.greatest(F.lit(0.0), F.col("bass") * KICK_GAIN), F.lit(KICK_POWER))
    return levels.withColumn("kick", F.round(kick, 5))


# --- locating clips ----------------------------------------------------------------


HIT = (
    StructType()
    .add("lag", LongType())
    .add("value", DoubleType())
    .add("local", DoubleType())
    .add("own", DoubleType())
)


def _best_lag(samples, base, block_len, region_start, region_end, clip, factor):
    """Best lag of one clip inside one block of its master, or None.

    Returns (lag in steps of ``factor`` from the region start, product sum, local energy).
    """
    skip = max(region_start - base, 0)
    skip += -(base + skip - region_start) % factor
    first = (base + skip - region_start) // factor
    steps = (region_end - region_start) // factor
    stop = min(-(-(base + block_len - region_start) // factor), max(1, steps - 1))
    needle = clip[: len(clip) // factor * factor].reshape(-1, factor).mean(axis=1)
    if stop <= first or len(needle) == 0:
        return None
    view = samples[skip : min(len(samples), region_start + steps * factor - base)]
    view = view[: len(view) // factor * factor].reshape(-1, factor).mean(axis=1)
    need = stop - first + len(needle) - 1
    view = np.pad(view[:need], (0, max(0, need - len(view))))
    if len(needle) * (stop - first) > 1 << 16:
        size = 1 << (need + len(needle) - 1).bit_length()
        spectrum = np.fft.rfft(view, size) * np.conj(np.fft.rfft(needle, size))
        products = np.fft.irfft(spectrum, size)[: stop - first]
    else:
        products = np.correlate(view, needle, "valid")
    k = int(np.argmax(products))
    local = view[k : k + len(needle)]
    return first + k, float(products[k]), float(local @ local), float(needle @ needle)


@F.pandas_udf(HIT)
def best_lag(
    samples: pd.Series,
    base: pd.Series,
    block_len: pd.Series,
    region_start: pd.Series,
    region_end: pd.Series,
    clip: pd.Series,
    factor: pd.Series,
) -> pd.DataFrame:
    rows = [
        _best_lag(np.asarray(s, float), b, n, lo, hi, np.asarray(c, float), f) or (None,) * 4
        for s, b, n, lo, hi, c, f in zip(samples, base, block_len, region_start, region_end, clip, factor)
    ]
    return pd.DataFrame(rows, columns=["lag", "value", "local", "own"]).astype({"lag": "Int64"})


def block_windows(blocks: DataFrame, block_len: int, reach: int) -> DataFrame:
    """Each block with the ``reach`` samples behind it, so that clips may cross its end."""
    more = -(-reach // block_len)
    spread = blocks.withColumn(
        "to", F.explode(F.sequence(F.greatest(F.lit(0), F.col("block_no") - more), F.col("block_no")))
    )
    parts = F.array_sort(F.collect_list(F.struct("block_no", "samples")))
    return (
        spread.groupBy("track_id", F.col("to").alias("block_no"))
        .agg(parts.alias("p"))
        .select("track_id", "block_no", F.flatten(F.transform("p", lambda x: x["samples"])).alias("samples"))
    )


def _correlate(windows: DataFrame, jobs: DataFrame, block_len: int, factor: int) -> DataFrame:
    """Best hit of each job ``[clip_id, track_id, clip, region_start, region_end]``.

    A job visits only the blocks of its region; each visit is one row keyed by (track,
    block), so clips of one long master spread over the cluster.
    """
    visits = jobs.withColumn(
        "block_no",
        F.explode(
            F.sequence(
                idiv(F.col("region_start"), block_len),
                idiv(F.greatest(F.col("region_start"), F.col("region_end") - 1), block_len),
            )
        ),
    )
    scored = visits.join(windows, ["track_id", "block_no"]).select(
        "clip_id",
        best_lag(
            "samples",
            F.col("block_no") * block_len,
            F.lit(block_len),
            "region_start",
            "region_end",
            "clip",
            F.lit(factor),
        ).alias("h"),
    )
    best = scored.filter(F.col("h.lag").isNotNull()).groupBy("clip_id").agg(
        F.max_by("h", F.struct(F.round("h.value", 9), -F.col("h.lag"))).alias("h")
    )
    power = F.greatest(F.lit(TINY), F.col("h.own") * F.greatest(F.lit(TINY), F.col("h.local")))
    return best.select(
        "clip_id",
        F.col("h.lag").alias("lag"),
        F.round(clamp(F.col("h.value") / F.sqrt(power), 0.0, 1.0), 6).alias("confidence"),
    )


def _reach(clips: DataFrame) -> int:
    """Longest clip in samples (one number)."""
    return clips.agg(F.max(F.size("clip"))).first()[0] or 1


def lag_xcorr(blocks: DataFrame, clips: DataFrame, block_len: int) -> DataFrame:
    """Where each clip lies in its master: lag of the largest product sum.

    ``clips[clip_id, track_id, clip]`` -> ``[clip_id, lag, confidence]``.
    """
    lengths = block_lengths(blocks, block_len)
    jobs = join_small(clips, lengths, TRACK, ["clip_id"]).select(
        "clip_id", "track_id", "clip", F.lit(0).cast("bigint").alias("region_start"), F.col("len").alias("region_end")
    )
    return _correlate(block_windows(blocks, block_len, _reach(clips)), jobs, block_len, 1)


def _two_stage(blocks: DataFrame, jobs: DataFrame, block_len: int, rate: int, reach: int) -> DataFrame:
    """Coarse search on averaged samples, then a fine one around the hit.

    Short masters and short regions are searched directly.
    """
    windows = stage(block_windows(blocks, block_len, reach + COARSE_FACTOR), "signal-windows")
    direct = (F.col("len") < rate * DIRECT_BELOW_S) | (
        F.col("region_end") - F.col("region_start") < rate * DIRECT_BELOW_S
    )
    jobs = stage(jobs.withColumn("direct", direct), "clip-jobs")
    coarse = stage(_correlate(windows, jobs.filter(~F.col("direct")), block_len, COARSE_FACTOR), "coarse-hits")
    found = jobs.join(coarse, ["clip_id"]).withColumn(
        "at", F.col("region_start") + F.col("lag") * COARSE_FACTOR
    )
    weak = found.filter(F.col("confidence") < COARSE_FLOOR).select(
        "clip_id", F.col("at").alias("lag"), "confidence"
    )
    pad = math.floor(rate * REFINE_PAD_S + 0.5)
    narrowed = found.filter(F.col("confidence") >= COARSE_FLOOR).select(
        "clip_id",
        "track_id",
        "clip",
        F.greatest(F.lit(0).cast("bigint"), F.col("at") - pad).alias("region_start"),
        F.least(F.col("len"), F.col("at") + F.size("clip") + pad).alias("region_end"),
    )
    fine_jobs = narrowed.unionByName(jobs.filter("direct").select(*narrowed.columns))
    fine = _correlate(windows, fine_jobs, block_len, 1).join(
        fine_jobs.select("clip_id", "region_start"), ["clip_id"]
    ).select("clip_id", (F.col("region_start") + F.col("lag")).alias("lag"), "confidence")
    return weak.unionByName(fine)


def lag_xcorr_coarse(blocks: DataFrame, clips: DataFrame, block_len: int, rate: int) -> DataFrame:
    """``lag_xcorr`` in two stages over whole masters."""
    jobs = join_small(clips, block_lengths(blocks, block_len), TRACK, ["clip_id"]).select(
        "clip_id",
        "track_id",
        "clip",
        F.lit(0).cast("bigint").alias("region_start"),
        F.col("len").alias("region_end"),
        "len",
    )
    return _two_stage(blocks, jobs, block_len, rate, _reach(clips))


def clip_search_window(blocks: DataFrame, clips: DataFrame, block_len: int, rate: int) -> DataFrame:
    """Two-stage location inside a window around ``cursor_us`` of each clip."""
    cursor = F.col("cursor_us") / F.lit(1_000_000)
    start = F.greatest(F.lit(0), F.floor((cursor - SEARCH_BACK_S) * rate)).cast("bigint")
    end = F.least(F.col("len"), F.ceil((cursor + SEARCH_AHEAD_S) * rate)).cast("bigint")
    jobs = join_small(clips, block_lengths(blocks, block_len), TRACK, ["clip_id"]).select(
        "clip_id",
        "track_id",
        "clip",
        F.least(start, end).alias("region_start"),
        end.alias("region_end"),
        "len",
    )
    return _two_stage(blocks, jobs, block_len, rate, _reach(clips))
