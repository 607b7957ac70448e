"""Streaming jobs.  Each transformation is one function used on streams and batches alike."""

from __future__ import annotations

import bisect
import sys
import uuid
from collections.abc import Iterator

import pandas as pd
from pyspark import cloudpickle
from pyspark.errors import AnalysisException
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle
from pyspark.sql.types import StructType

from cadenza.operators.signals import (
    FLUX_FLOOR,
    PEAK_RADIUS,
    THRESHOLD_BASE,
    THRESHOLD_GAIN,
    with_halo,
)
from cadenza.plans.ranges import points_in_intervals
from cadenza.session import shared_folder, stage
from cadenza.sources.tables import upsert_latest

# the stateful processors travel with the job, so executors need no copy of this package
cloudpickle.register_pickle_by_value(sys.modules[__name__])

CHUNK = 4096
#: Several columns of state and timers need this store.
STATE_STORE = "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"


def run_available(stream: DataFrame, label: str, reports: list | None = None) -> DataFrame:
    """Run a stream over everything there is, into a parquet table, and read that table.

    Output and progress log live in the shared folder; the file sink commits each
    micro-batch once, so a restarted query neither repeats nor loses rows.  ``reports``
    receives the progress reports of the micro-batches.
    """
    spark = stream.sparkSession
    base = f"{shared_folder(spark)}/{label}-{uuid.uuid4().hex}"
    spark.conf.set("spark.sql.streaming.stateStore.providerClass", STATE_STORE)
    query = (
        stream.writeStream.format("parquet")
        .outputMode("append")
        .option("path", f"{base}/out")
        .option("checkpointLocation", f"{base}/progress")
        .trigger(availableNow=True)
        .start()
    )
    query.awaitTermination()
    if reports is not None:
        reports += query.recentProgress
    return spark.read.schema(stream.schema).parquet(f"{base}/out")


def job_progress(events: DataFrame, width: str, delay: str) -> DataFrame:
    """Progress reports per stage and tumbling window; later than ``delay`` is too late.

    ``events[job_id, stage, progress, ts]``.  Progress is added up in whole per cent.
    """
    return (
        events.withWatermark("ts", delay)
        .groupBy(F.window("ts", width).alias("w"), "stage")
        .agg(
            F.count(F.lit(1)).alias("reports"),
            F.sum(F.round(F.col("progress") * 100).cast("bigint")).alias("percent"),
        )
        .select(
            F.unix_micros("w.start").alias("window_us"),
            "stage",
            "reports",
            F.round(F.col("percent") / F.col("reports") / 100, 6).alias("mean_progress"),
        )
    )


def job_log(events: DataFrame) -> DataFrame:
    """Reports as they are appended to the job log."""
    return events.select("job_id", "stage", "progress", F.unix_micros("ts").alias("updated_us"))


class LatestTable:
    """Newest row of each key, kept up to date by micro-batches.

    Rows lie in ``buckets`` by a hash of the key.  A micro-batch writes new files for the
    buckets it touches only, under its own number, and then commits: one small file that
    says which number each bucket's files have.  Readers follow the newest commit, so a batch
    is seen whole or not at all.  A batch that was committed before changes nothing, and one
    that stopped half-way overwrites its own files when it comes again.  Batch numbers are
    those of one streaming query, whose progress log belongs beside the table.
    """

    def __init__(self, schema: StructType, path: str, key: list[str], order: list[str], buckets: int = 16):
        self.schema, self.path, self.key, self.order, self.buckets = schema, path, key, order, buckets

    def _commits(self, spark: SparkSession) -> DataFrame | None:
        try:
            return spark.read.schema("bucket int, version bigint, batch bigint").parquet(f"{self.path}/commits")
        except AnalysisException:  # nothing has been committed
            return None

    def _versions(self, spark: SparkSession) -> tuple[int, dict[int, int]]:
        """Newest committed batch (-1 if none) and the version of each bucket's files."""
        commits = self._commits(spark)
        if commits is None:
            return -1, {}
        newest = commits.agg(F.max("batch")).first()[0]
        rows = commits.filter(F.col("batch") == newest).filter("bucket is not null").collect()
        return newest, {r["bucket"]: r["version"] for r in rows}

    def _files(self, spark: SparkSession, versions: dict[int, int]) -> DataFrame:
        paths = [f"{self.path}/rows/version={v}/bucket={b}" for b, v in sorted(versions.items())]
        return spark.read.schema(self.schema).parquet(*paths) if paths else spark.createDataFrame([], self.schema)

    def read(self, spark: SparkSession) -> DataFrame:
        """The table as of the newest commit."""
        return self._files(spark, self._versions(spark)[1])

    def merge(self, batch: DataFrame, number: int) -> None:
        """Take in one micro-batch; for ``foreachBatch``."""
        spark = batch.sparkSession
        newest, versions = self._versions(spark)
        if number <= newest:
            return
        bucket = F.pmod(F.xxhash64(*self.key), F.lit(self.buckets)).cast("int")
        rows = stage(upsert_latest(batch.limit(0), batch, self.key, self.order).select(*self.schema.names), "batch")
        # at most one number for each bucket
        touched = {r["bucket"] for r in rows.select(bucket.alias("bucket")).distinct().collect()}
        if touched:
            old = self._files(spark, {b: v for b, v in versions.items() if b in touched})
            merged = upsert_latest(old, rows, self.key, self.order).withColumn("bucket", bucket)
            merged.repartition("bucket").write.mode("overwrite").partitionBy("bucket").parquet(f"{self.path}/rows/version={number}")
        self._commit(spark, number, versions | {b: number for b in touched})

    def _commit(self, spark: SparkSession, number: int, versions: dict[int, int]) -> None:
        # one file, renamed into place; without any bucket a row that only names the batch
        rows = [(b, v, number) for b, v in sorted(versions.items())] or [(None, None, number)]
        frame = spark.createDataFrame(rows, "bucket int, version bigint, batch bigint")
        frame.coalesce(1).write.mode("append").parquet(f"{self.path}/commits")


def job_latest(events: DataFrame, label: str, reports: list | None = None) -> DataFrame:
    """Current state of each job after all reports there are: merged batch by batch."""
    spark = events.sparkSession
    base = f"{shared_folder(spark)}/{label}-{uuid.uuid4().hex}"
    log = job_log(events)
    current = LatestTable(log.schema, f"{base}/table", ["job_id"], ["updated_us"])
    query = (
        log.writeStream.foreachBatch(current.merge)
        .option("checkpointLocation", f"{base}/progress")
        .trigger(availableNow=True)
        .start()
    )
    query.awaitTermination()
    if reports is not None:
        reports += query.recentProgress
    return current.read(spark)


def transcript_dedup(transcripts: DataFrame, delay: str) -> DataFrame:
    """First transcript of each (sha, model, language) within the delay."""
    keys = ["sha", "model", "language"]
    return transcripts.withWatermark("ts", delay).dropDuplicatesWithinWatermark(keys).select(*keys)


def phrases(words: DataFrame, silence_s: float, delay: str) -> DataFrame:
    """Words of a track joined to phrases that end when nothing follows for ``silence_s``.

    ``words[track_id, ts, length_s]``.  A word keeps its phrase open for its own length
    plus the silence.
    """
    open_for = F.make_interval(secs=(F.col("length_s") + silence_s).cast("decimal(18,6)"))
    return (
        words.withWatermark("ts", delay)
        .groupBy("track_id", F.session_window("ts", open_for).alias("w"))
        .agg(F.count(F.lit(1)).alias("words"))
        .select(
            "track_id",
            F.unix_micros("w.start").alias("start_us"),
            F.unix_micros("w.end").alias("open_until_us"),
            "words",
        )
    )


def _peaks(frames: list[int], flux: list[float], first: int, last: int) -> list[tuple[int, float]]:
    """Candidates among the places ``first`` to ``last`` of one stretch of frames."""
    found = []
    for k in range(max(first, 2), min(last, len(flux) - 3) + 1):
        v = flux[k]
        if v >= FLUX_FLOOR and v > flux[k - 1] and v > flux[k - 2] and v >= flux[k + 1] and v >= flux[k + 2]:
            near = flux[max(0, k - PEAK_RADIUS) : k + PEAK_RADIUS + 1]
            if v >= sum(near) / len(near) * THRESHOLD_GAIN + THRESHOLD_BASE:
                found.append((frames[k], v))
    return found


class _Timed(StatefulProcessor):
    """One value of state for each key, and one event-time timer: when its next row can be settled.

    A subclass says in ``settled`` what rows and state give at a watermark, what state stays
    (none: the key is forgotten) and when it wants to be asked again.
    """

    state_schema: str
    columns: tuple[str, ...]

    def init(self, handle: StatefulProcessorHandle) -> None:
        self._handle = handle
        self._held = handle.getValueState("held", self.state_schema)

    def handleInputRows(self, key, rows, timerValues) -> Iterator[pd.DataFrame]:
        yield from self._turn(key, rows, timerValues)

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[pd.DataFrame]:
        yield from self._turn(key, (), timerValues)

    def _turn(self, key, rows, timer_values) -> Iterator[pd.DataFrame]:
        upto = timer_values.getCurrentWatermarkInMs()
        old = self._held.get() if self._held.exists() else None
        new, again, found = self.settled(key, old, rows, upto)
        for timer in list(self._handle.listTimers()):
            self._handle.deleteTimer(timer)
        if new is None:
            self._held.clear()
        else:
            self._held.update(new)
            self._handle.registerTimer(max(again, upto + 1))
        if found:
            # the engine takes no row from before the watermark
            ready = pd.to_datetime(max(upto + 1, 0), unit="ms")
            yield pd.DataFrame([(key[0], *row, ready) for row in found], columns=["track_id", *self.columns, "ready"])

    def settled(self, key, old, rows, upto: int):
        raise NotImplementedError

    def close(self) -> None:
        pass


class _Candidates(_Timed):
    """Onset candidates of one stretch of frames, each decided once the frames behind it are settled.

    Frames up to the watermark are settled: none that lies before them can still come.  Where
    the watermark is ``idle`` past the last frame the track has ended, and the last frames are
    decided without any behind them.
    """

    state_schema = "undecided bigint, frames array<bigint>, flux array<double>, at array<bigint>"
    columns = ("frame", "flux", "at")

    def __init__(self, idle_ms: int):
        self.idle_ms = idle_ms

    def settled(self, key, old, rows, upto):
        low, high = int(key[1]) * CHUNK, int(key[1]) * CHUNK + CHUNK - 1
        undecided, *held = old if old else (low, [], [], [])
        held = list(zip(*held))
        for part in rows:
            part = part[part["ts"].notna()]
            at = part["ts"].astype("datetime64[ms]").astype("int64")
            held += zip(part["frame"].tolist(), part["flux"].tolist(), at.tolist())
        held.sort()
        if not held:
            return None, 0, []
        frames, flux, at = (list(c) for c in zip(*held))
        settled = bisect.bisect_right(at, upto)
        ended = at[-1] + self.idle_ms <= upto
        first = bisect.bisect_left(frames, undecided)
        last = min(len(frames) if ended else settled - PEAK_RADIUS, bisect.bisect_right(frames, high)) - 1
        times = dict(zip(frames, at))
        found = [(f, v, times[f]) for f, v in _peaks(frames, flux, first, last)]
        if ended or last >= 0 and frames[last] >= high:
            return None, 0, found
        first = max(first, last + 1)
        kept = max(0, first - PEAK_RADIUS)
        undecided = max(undecided, frames[last] + 1) if last >= 0 else undecided
        wait = at[first + PEAK_RADIUS] if first + PEAK_RADIUS < len(at) else at[-1] + self.idle_ms
        return (undecided, frames[kept:], flux[kept:], at[kept:]), wait, found


class _Thinned(_Timed):
    """Candidates of a track at least ``min_frames`` after the last kept one, in order of time.

    A candidate waits until the watermark is ``idle`` past it; by then those before it have
    come from all stretches.  The last kept one is forgotten when no candidate can be near it.
    """

    state_schema = "last bigint, last_at bigint, frames array<bigint>, flux array<double>, at array<bigint>"
    columns = ("frame", "flux")

    def __init__(self, min_frames: int, idle_ms: int):
        self.min_frames, self.idle_ms = min_frames, idle_ms

    def settled(self, key, old, rows, upto):
        last, last_at, *held = old if old else (None, None, [], [], [])
        held = list(zip(*held))
        for part in rows:
            held += zip(part["frame"].tolist(), part["flux"].tolist(), part["at"].tolist())
        held.sort()
        found = []
        while held and held[0][2] + self.idle_ms <= upto:
            frame, flux, at = held.pop(0)
            if last is None or frame - last >= self.min_frames:
                found.append((frame, flux))
                last, last_at = frame, at
        if not held and (last is None or last_at + 2 * self.idle_ms <= upto):
            return None, 0, found
        wait = held[0][2] + self.idle_ms if held else last_at + 2 * self.idle_ms
        columns = [list(c) for c in zip(*held)] or [[], [], []]
        return (last, last_at, *columns), wait, found


def onset_peaks(flux: DataFrame, delay: str, idle_ms: int) -> DataFrame:
    """Onset candidates ``[track_id, frame, flux, at, ready]`` of a stream of flux frames.

    ``flux[track_id, frame, flux, ts]``: numbered frames and their times, which grow with the
    number; rows may come out of order by less than ``delay``.  A row without a frame or track
    only carries the time on, which closes tracks that have ended; one without a time is left out.  State is kept for each stretch
    of frames, each also receiving the frames around it, so that neither a group nor its
    state grows with the track; it is dropped with the stretch's last frame or ``idle_ms`` after
    its track's last one.
    """
    # one condition on all columns: a filter on frames alone would move below the watermark
    timed = flux.withWatermark("ts", delay).filter("(frame is not null and track_id is not null) or ts is null")
    return (
        with_halo(timed, "frame", PEAK_RADIUS, CHUNK)
        .select("track_id", "__chunk", "frame", "flux", "ts")
        .groupBy("track_id", "__chunk")
        .transformWithStateInPandas(
            _Candidates(idle_ms),
            "track_id bigint, frame bigint, flux double, at bigint, ready timestamp",
            "append",
            "eventTime",
            eventTimeColumnName="ready",
        )
    )


def onsets(flux: DataFrame, min_frames: int, delay: str, idle_ms: int) -> DataFrame:
    """Onsets of a flux stream as ``onset_peaks`` takes it: candidates with a minimum distance.

    ``idle_ms`` must be longer than ``min_frames`` and than the frames that decide a peak.
    """
    thinned = (
        onset_peaks(flux, delay, idle_ms)
        .groupBy("track_id")
        .transformWithStateInPandas(
            _Thinned(min_frames, idle_ms),
            "track_id bigint, frame bigint, flux double, ready timestamp",
            "append",
            "eventTime",
            eventTimeColumnName="ready",
        )
    )
    return thinned.select("track_id", "frame", "flux")


def stream_onsets(flux: DataFrame, min_frames: int, delay: str, idle_ms: int) -> DataFrame:
    """All onsets of a flux stream that ends."""
    return run_available(onsets(flux, min_frames, delay, idle_ms), "onsets")


def active_captions(ticks: DataFrame, captions: DataFrame) -> DataFrame:
    """Captions under the playhead: ticks ``[track_id, tick_id, at_us]`` against a static table."""
    held = captions.select("track_id", "idx", F.col("start_us").alias("lo"), F.col("end_us").alias("hi"))
    return points_in_intervals(ticks, "at_us", held, "lo", "hi", ["track_id"], 30_000_000).select(
        "track_id", "tick_id", "at_us", "idx"
    )
