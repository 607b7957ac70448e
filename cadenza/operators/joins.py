"""Joins on time: as-of, interval, anchor and frame joins.

Every join here is an equi-join on (track, time bin) or an ordered scan, so a long track
spreads over many tasks and no pairs are formed beyond the ones that match.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from cadenza.functions.text import let, sung_words
from cadenza.functions.timecode import clamp, idiv, seconds
from cadenza.plans.ordered import by_rows, nearest_neighbours, scan
from cadenza.plans.ranges import points_in_intervals
from cadenza.plans.skew import grown, join_small
from cadenza.session import stage

TRACK = ["track_id"]
BIN_US = seconds(30)
CHUNK_US = seconds(600)

# Fixed values of the matching rules.
MIN_SCORE, MAX_SCORE = 0.15, 1.0
MIN_WORD_US = seconds(0.08)
ONSET_WINDOW_US = seconds(0.12)
ONSET_MIN_US = seconds(0.06)
ANCHOR_FLOOR = 0.35


def match_times(path: DataFrame, heard: DataFrame) -> DataFrame:
    """Give matched tokens the time of their transcript word.

    ``path[pair_id, i, j, score]`` (matches only), ``heard[pair_id, j, start_us, end_us]``.
    """
    return path.join(grown(heard), ["pair_id", "j"]).select(
        "pair_id",
        "i",
        "j",
        "start_us",
        F.greatest(F.col("start_us") + MIN_WORD_US, F.col("end_us")).alias("end_us"),
        clamp(F.col("score"), MIN_SCORE, MAX_SCORE).alias("confidence"),
    )


def segment_interval_join(captions: DataFrame, words: DataFrame, segments: DataFrame) -> DataFrame:
    """Widen captions to the speech segment their words lie in, else to the nearest one.

    ``captions[track_id, idx, start_us, end_us, instrumental]``, ``words[track_id, idx, k,
    start_us, end_us]``, ``segments[track_id, k, start_us, end_us]``.  Captions without
    words are only kept from starting before the first segment.
    """
    on = ["track_id", "idx"]
    centre = words.groupBy(*on).agg(
        idiv(F.sum(F.col("start_us") + F.col("end_us")), F.count(F.lit(1)) * 2).alias("mid"),
        F.min_by("start_us", "k").alias("first_us"),
        F.max_by("end_us", "k").alias("last_us"),
    )
    sung = captions.filter(~F.col("instrumental")).select(*on).join(grown(centre), on)
    sung = stage(sung, "caption-centres")
    seg = segments.select(
        "track_id", F.col("k").alias("seg_k"), F.col("start_us").alias("seg_lo"), F.col("end_us").alias("seg_hi")
    )
    held = F.struct("seg_lo", "seg_hi")
    inside = points_in_intervals(sung, "mid", seg, "seg_lo", "seg_hi", TRACK, BIN_US).groupBy(*on).agg(
        F.min_by(held, F.struct("seg_lo", "seg_k")).alias("inside")
    )
    # segments that start together: the first one stands for them
    starts = seg.groupBy("track_id", "seg_lo").agg(F.min_by("seg_hi", "seg_k").alias("seg_hi"))
    near = nearest_neighbours(sung, starts, TRACK, "mid", ["idx"], "seg_lo", CHUNK_US, ["seg_hi"])
    before, after = F.col("mid") - F.col("prev.at"), F.col("next.at") - F.col("mid")
    nearest = F.when(before.isNull() | (after < before), F.col("next")).otherwise(F.col("prev"))
    placed = near.select(
        *on, "first_us", "last_us", nearest["at"].alias("near_lo"), nearest["seg_hi"].alias("near_hi")
    ).join(grown(inside), on, "left")
    first = seg.groupBy("track_id").agg(F.min("seg_lo").alias("first_seg"))
    lo = F.coalesce("inside.seg_lo", "near_lo")
    hi = F.coalesce("inside.seg_hi", "near_hi")
    joined = join_small(captions.join(grown(placed), on, "left"), first, TRACK, ["idx"], "left")
    start = F.greatest(F.lit(0), F.least(F.col("first_us") - seconds(0.08), lo))
    quiet = F.greatest(F.col("first_seg") - seconds(0.35), F.col("start_us"))
    has_words = F.col("first_us").isNotNull()
    heard = F.col("first_seg").isNotNull()
    new_start = (
        F.when(~heard, F.col("start_us")).when(has_words, start).otherwise(F.greatest(F.lit(0), quiet))
    )
    new_end = (
        F.when(~heard, F.col("end_us"))
        .when(has_words, F.greatest(F.col("last_us") + seconds(0.15), F.least(hi, start + seconds(12))))
        .otherwise(F.greatest(quiet + seconds(1.2), F.col("end_us")))
    )
    return joined.select(*on, new_start.alias("start_us"), new_end.alias("end_us"))


def window_words(
    lines: DataFrame, words: DataFrame, before_us: int = seconds(0.35), after_us: int = seconds(0.5)
) -> DataFrame:
    """Words lying inside the widened window of each line: ``[track_id, idx, n]`` pairs."""
    windows = lines.select(
        "track_id",
        "idx",
        (F.col("start_us") - before_us).alias("__lo"),
        (F.col("end_us") + after_us).alias("__hi"),
    )
    found = points_in_intervals(
        words.select("track_id", "n", F.col("start_us").alias("__at"), F.col("end_us").alias("__end")),
        "__at",
        windows,
        "__lo",
        "__hi",
        TRACK,
        BIN_US,
    )
    return found.filter(F.col("__end") <= F.col("__hi")).select("track_id", "idx", "n")


def nearest_onset(words: DataFrame, onsets: DataFrame, window_us: int = ONSET_WINDOW_US) -> DataFrame:
    """Move word starts to the nearest onset within the window; the earlier one on a tie.

    ``words[track_id, n, start_us, end_us, confidence, line_start_us, line_end_us]``,
    ``onsets[track_id, at_us]``.  The new start stays inside the line.  Further columns of ``words``
    stay with their row.
    """
    own = ["track_id", "n", "start_us", "end_us", "confidence", "line_start_us", "line_end_us"]
    near = nearest_neighbours(words, onsets.distinct(), TRACK, "start_us", ["n"], "at_us", CHUNK_US)
    start = F.col("start_us")
    left, right = start - F.col("prev.at"), F.col("next.at") - start
    best = (
        F.when((left <= window_us) & (right.isNull() | (left <= right)), F.col("prev.at"))
        .when(right <= window_us, F.col("next.at"))
    )
    latest = F.greatest(F.col("line_start_us"), F.col("line_end_us") - ONSET_MIN_US)
    moved = near.withColumn("__to", F.greatest(F.col("line_start_us"), F.least(latest, best)))
    moved = moved.withColumn("__to", F.when(best.isNotNull(), F.col("__to")))
    delta = F.abs(F.col("__to") - start)
    keep = F.greatest(F.lit(ONSET_MIN_US), F.col("end_us") - start)
    end = F.greatest(F.col("__to") + ONSET_MIN_US, F.least(F.col("__to") + keep, F.col("line_end_us")))
    confidence = F.when(
        delta > seconds(0.08), F.greatest(F.lit(0.2), F.col("confidence") - 0.15)
    ).otherwise(F.least(F.lit(1.0), F.col("confidence") + 0.1))
    snapped = F.col("__to").isNotNull()
    return moved.select(
        "track_id",
        "n",
        F.coalesce("__to", "start_us").alias("start_us"),
        F.when(snapped & (delta > seconds(0.02)), end).otherwise(F.col("end_us")).alias("end_us"),
        F.round(F.when(snapped, confidence).otherwise(F.col("confidence")), 6).alias("confidence"),
        snapped.alias("snapped"),
        *[c for c in words.columns if c not in own],
    )


def even_windows(words: Column) -> Column:
    """Equally wide windows of a caption's words, as :func:`cadenza.operators.tracks.even_words` gives them."""
    span = F.greatest(F.lit(seconds(0.04)), F.col("end_us") - F.col("start_us"))

    def windows(w: Column) -> Column:
        edge = lambda k: F.col("start_us") + idiv(span * k, F.size(w))
        return F.transform(w, lambda _, k: F.struct(edge(k).alias("start_us"), edge(k + 1).alias("end_us")))

    return let(words, windows)


def snap_targets(captions: DataFrame) -> DataFrame:
    """Zero and every caption edge of a track, as one target list."""
    edges = F.explode(F.array(F.lit(0).cast("bigint"), F.col("start_us"), F.col("end_us")))
    return captions.select("track_id", edges.alias("at_us")).distinct()


def snap_radius(pixels_per_second: float, pixels: int = 8) -> int:
    """Snap radius of a zoom level: a fixed number of screen pixels."""
    return round(pixels / pixels_per_second * 1_000_000)


def snap_nearest(times: DataFrame, targets: DataFrame, radius: Column) -> DataFrame:
    """Snap times to the nearest target closer than the radius, else keep them; never below 0.

    ``times[track_id, id, at_us]``, ``targets[track_id, target_us]``.
    """
    near = nearest_neighbours(
        times.withColumn("__r", radius), targets, TRACK, "at_us", ["id"], "target_us", CHUNK_US
    )
    left = F.col("at_us") - F.col("prev.at")
    right = F.col("next.at") - F.col("at_us")
    best = F.when(
        (left < F.col("__r")) & (right.isNull() | (left <= right)), F.col("prev.at")
    ).when(right < F.col("__r"), F.col("next.at")).otherwise(F.col("at_us"))
    return near.select("track_id", "id", "at_us", F.greatest(F.lit(0), best).alias("snapped_us"))


def anchor_remap(anchors: DataFrame, lines: DataFrame) -> DataFrame:
    """Replace the parsed line index of anchors by the ordinal among sung lines.

    Anchors on blank lines or unknown lines drop out.
    """
    sung = (~F.col("instrumental")).cast("bigint")
    ordinals = scan(
        lines.select("track_id", "idx", "instrumental"), TRACK, ["idx"], by_rows("idx"), sum_before={"ordinal": sung}
    ).filter(~F.col("instrumental"))
    return anchors.join(
        grown(ordinals.select("track_id", F.col("idx").alias("line_index"), "ordinal")), ["track_id", "line_index"]
    ).drop("line_index").withColumnRenamed("ordinal", "line_index")


def anchor_warp(
    captions: DataFrame,
    words: DataFrame,
    anchors: DataFrame,
    min_confidence: float = ANCHOR_FLOOR,
    ordinal: str = "idx",
) -> tuple[DataFrame, DataFrame]:
    """Correct times piecewise linearly between anchors, flat outside them.

    ``anchors[track_id, line_index, offset_us, confidence, anchor_id]`` say where the sung
    line ``line_index`` really starts.  Of several anchors on one line the first counts.
    ``ordinal`` names the caption column that counts sung lines (null on music rows).
    """
    hits = anchors.filter(F.col("confidence") >= min_confidence).groupBy("track_id", "line_index").agg(
        F.min_by("offset_us", "anchor_id").alias("offset_us")
    )
    lines = captions.filter(F.col(ordinal).isNotNull()).select(
        "track_id", F.col(ordinal).alias("line_index"), F.col("start_us").alias("at")
    )
    hits = (
        hits.join(grown(lines), ["track_id", "line_index"])
        .groupBy("track_id", "at")
        .agg(F.min_by(F.col("offset_us") - F.col("at"), "line_index").alias("fix"))
    )

    return (
        _warped(captions, hits, ["idx"], seconds(0.04)),
        _warped(words, hits, ["idx", "k"], MIN_WORD_US),
    )


def _warped(rows: DataFrame, hits: DataFrame, ident: list[str], least: int) -> DataFrame:
    """Rows ``[track_id, *ident, start_us, end_us]`` corrected by ``hits[track_id, at, fix]``."""
    edge = F.explode(
        F.array(
            F.struct(F.lit(0).alias("edge"), F.col("start_us").alias("t")),
            F.struct(F.lit(1).alias("edge"), F.col("end_us").alias("t")),
        )
    )
    points = rows.select("track_id", *ident, edge.alias("e")).select("track_id", *ident, "e.*")
    near = nearest_neighbours(points, hits, TRACK, "t", [*ident, "edge"], "at", CHUNK_US, ["fix"])
    a, b, t = F.col("prev"), F.col("next"), F.col("t")
    between = a["fix"] + F.call_function(
        "div", (b["fix"] - a["fix"]) * (t - a["at"]), F.greatest(F.lit(1).cast("bigint"), b["at"] - a["at"])
    )
    fix = F.coalesce(F.when(a.isNotNull() & b.isNotNull(), between), a["fix"], b["fix"])
    warped = near.select(
        "track_id",
        *ident,
        "edge",
        F.coalesce(F.greatest(F.lit(0), t + fix), t).alias("t"),
        fix.isNotNull().alias("fixed"),
    )
    both = warped.groupBy("track_id", *ident).agg(
        F.min(F.when(F.col("edge") == 0, F.col("t"))).alias("start_us"),
        F.min(F.when(F.col("edge") == 1, F.col("t"))).alias("end_us"),
        F.bool_or("fixed").alias("fixed"),
    )
    kept = F.greatest(F.col("start_us") + least, F.col("end_us"))
    return both.select(
        "track_id", *ident, "start_us", F.when(F.col("fixed"), kept).otherwise(F.col("end_us")).alias("end_us")
    )


def frame_active(
    captions: DataFrame, words: DataFrame, fps: int, offset_us: int = 0, lead_us: int = 0
) -> DataFrame:
    """Captions drawn on each video frame, with their words counted by state.

    ``captions[track_id, idx, start_us, end_us, text, ...]``; one without a row in ``words``
    gets its words evenly, one without any word is drawn with no word in any state.  A
    caption lists its own frames and holds its words as one array, so frames meet neither
    captions nor words in a join, and no frame row is shuffled.  Words change state on few of a
    caption's frames: they are counted once for each run of frames between two changes.
    """
    on = ["track_id", "idx"]

    def from_frame(us: Column) -> Column:
        """First frame whose time is ``us`` or later; frame times are rounded half up."""
        return F.ceil((us - offset_us + lead_us - F.lit(0.5)) * fps / F.lit(1_000_000)).cast("bigint")

    def states(start: Column, end: Column) -> Column:
        return F.struct(from_frame(start).alias("begun"), from_frame(end).alias("over"))

    own = words.groupBy(*on).agg(F.collect_list(states(F.col("start_us"), F.col("end_us"))).alias("__own"))
    margin = seconds(0.05)
    first = F.ceil((F.col("start_us") - margin - offset_us) * fps / F.lit(1_000_000)).cast("bigint")
    last = F.floor((F.col("end_us") + margin - offset_us) * fps / F.lit(1_000_000)).cast("bigint")
    drawn = captions.select(
        *on, "start_us", "end_us", "text", F.greatest(F.lit(0), first).alias("__a"), last.alias("__b")
    ).filter("__b >= __a")
    even = F.transform(even_windows(sung_words(F.col("text"))), lambda w: states(w["start_us"], w["end_us"]))
    none = F.array().cast("array<struct<begun:bigint,over:bigint>>")
    held = drawn.join(own, on, "left").select(*on, "__a", "__b", F.coalesce("__own", even, none).alias("__words"))
    changes = F.filter(
        F.concat("__words.begun", "__words.over"), lambda f: (f > F.col("__a")) & (f <= F.col("__b"))
    )
    cut = held.select(
        *on, "__b", "__words", F.sort_array(F.array_distinct(F.concat(F.array("__a"), changes))).alias("__cuts")
    )

    def count(state) -> Column:
        return F.size(F.filter("__words", state)).cast("bigint")

    def run(f: Column, i: Column) -> Column:
        return F.struct(
            f.alias("from"),
            F.coalesce(F.get("__cuts", i + 1) - 1, F.col("__b")).alias("to"),
            count(lambda w: f < w["begun"]).alias("future"),
            count(lambda w: (f >= w["begun"]) & (f >= w["over"])).alias("past"),
            count(lambda w: (f >= w["begun"]) & (f < w["over"])).alias("active"),
        )

    runs = cut.select(*on, F.explode(F.transform("__cuts", run)).alias("r")).select(*on, "r.*")
    return runs.select(
        "track_id", F.explode(F.sequence("from", "to")).alias("frame"), "idx", "future", "past", "active"
    )


def style_cascade(
    base: DataFrame, projects: DataFrame, captions: DataFrame, columns: list[str], default_id: int
) -> DataFrame:
    """Effective settings per caption: base, then project override, then caption override.

    A project naming an unknown base gets the default base (one row, a scalar subquery).
    """
    b = base.select(F.col("base_id"), F.struct(*columns).alias("__base"))
    fallback = b.filter(F.col("base_id") == default_id).select("__base").scalar()
    p = projects.select("project_id", "base_id", F.struct(*columns).alias("__project"))
    resolved = p.join(b, ["base_id"], "left").select(
        "project_id", F.coalesce(F.col("__base"), fallback).alias("__base"), "__project"
    )
    c = captions.select("caption_id", "project_id", F.struct(*columns).alias("__caption"))
    return join_small(c, resolved, ["project_id"], ["caption_id"], "left").select(
        "caption_id",
        "project_id",
        *[F.coalesce(f"__caption.{x}", f"__project.{x}", f"__base.{x}").alias(x) for x in columns],
    )


def word_line_join(lines: DataFrame, words: DataFrame) -> DataFrame:
    """Timed words with their sheet line; sung lines without words stay, music lines leave."""
    sung = lines.filter(~F.col("instrumental")).drop("instrumental")
    return sung.join(words, ["track_id", "line_index"], "left")


def anchor_collect(clips: DataFrame, located: DataFrame, floor: float = ANCHOR_FLOOR) -> DataFrame:
    """Anchors from clips already placed and from clips located with enough confidence.

    ``clips[clip_id, line_index, instrumental, locked, offset_us, score]``,
    ``located[clip_id, offset_us, confidence]``.
    """
    usable = clips.filter((F.col("line_index") >= 0) | F.col("instrumental"))
    placed = F.col("locked") & F.col("offset_us").isNotNull()
    ready = usable.filter(placed).select(
        "clip_id", "line_index", "offset_us", F.col("score").alias("confidence")
    )
    fresh = (
        usable.filter(~placed)
        .select("clip_id", "line_index")
        .join(located.filter(F.col("confidence") >= floor), ["clip_id"])
        .select("clip_id", "line_index", "offset_us", "confidence")
    )
    return ready.unionByName(fresh)
