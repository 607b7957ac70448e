"""Streams fed in several micro-batches give what one batch gives."""

import datetime as dt
import random

import pytest
from pyspark.sql import functions as F

from cadenza.catalog.signals import flux
from cadenza.catalog.streams import dedup, replayed
from cadenza.operators.signals import onset_candidates, onset_thin
from cadenza.streaming import jobs as S

SF_DIR = "/root/testdata/sf0.001"


def in_pieces(spark, df, path, column, pieces=4):
    """Write ``df`` as files in the order of ``column``, one file per micro-batch later on."""
    top = df.agg(F.max(column)).first()[0] + 1
    for p in range(pieces):
        part = df.filter((F.col(column) * pieces / top >= p) & (F.col(column) * pieces / top < p + 1))
        part.coalesce(1).write.mode("append").parquet(path)
    return spark.readStream.schema(df.schema).option("maxFilesPerTrigger", 1).parquet(path)


def held(reports):
    """Rows of state that each stateful step holds after the last micro-batch."""
    return [o["numRowsTotal"] for o in reports[-1]["stateOperators"]]


@pytest.mark.parametrize("chunk", [16, 4096])
def test_onsets_over_micro_batches_leave_no_state(spark, tmp_path, rows, monkeypatch, chunk):
    monkeypatch.setattr(S, "CHUNK", chunk)
    frames = flux(spark, SF_DIR).cache()
    reports = []
    stream = replayed(frames, str(tmp_path / "f"), 4)
    got = S.run_available(S.onsets(stream, 4, "200 milliseconds", 200), "onsets-test", reports)
    want = onset_thin(onset_candidates(frames), 4)
    assert rows(got) == rows(want) and want.count() > 20
    assert max(sum(o["numRowsTotal"] for o in r["stateOperators"]) for r in reports) > 0
    assert held(reports) == [0, 0] and len({r["batchId"] for r in reports}) >= 5


def test_onsets_of_frames_out_of_order(spark, tmp_path, rows):
    """Frames in any order within the delay, tracks of different lengths, rows without a frame."""
    rng = random.Random(5)
    values = [(t, f, round(rng.random() ** 3, 6)) for t, n in ((1, 60), (2, 3), (3, 40), (None, 12)) for f in range(n)]
    frames = spark.createDataFrame(values, "track_id bigint, frame bigint, flux double").cache()
    path = str(tmp_path / "o")
    schema = "track_id bigint, frame bigint, flux double, ts timestamp"
    shuffled = sorted(values, key=lambda r: r[1] + rng.uniform(0, 9))
    at = lambda ms: dt.datetime(2024, 1, 1) + dt.timedelta(milliseconds=ms)
    for k in range(0, len(shuffled), 25):
        part = [(*r, at(10 * r[1])) for r in shuffled[k : k + 25]]
        spark.createDataFrame(part, schema).coalesce(1).write.mode("append").parquet(path)
    spark.createDataFrame([(None, None, None, at(60_000))], schema).coalesce(1).write.mode("append").parquet(path)
    reports = []
    stream = spark.readStream.schema(schema).option("maxFilesPerTrigger", 1).parquet(path)
    got = S.run_available(S.onsets(stream, 4, "150 milliseconds", 200), "onsets-order-test", reports)
    assert rows(got) == rows(onset_thin(onset_candidates(frames), 4)) and held(reports) == [0, 0]


def job_table(spark, path):
    schema = spark.createDataFrame([], "job_id bigint, stage string, updated_us bigint").schema
    table = S.LatestTable(schema, str(path), ["job_id"], ["updated_us"], buckets=3)
    return table, lambda *reports: spark.createDataFrame(reports, schema)


def test_a_batch_that_comes_again_changes_nothing(spark, tmp_path, rows):
    table, batch = job_table(spark, tmp_path)
    assert rows(table.read(spark)) == []
    table.merge(batch(), 0)
    assert rows(table.read(spark)) == []
    table.merge(batch((1, "a", 10), (2, "a", 11), (1, "b", 12)), 1)
    table.merge(batch((1, "old", 5), (3, "c", 20), (None, "n", 1)), 2)
    want = [(1, "b", 12), (2, "a", 11), (3, "c", 20), (None, "n", 1)]
    assert rows(table.read(spark)) == want
    table.merge(batch((1, "z", 99)), 2)
    table.merge(batch((9, "z", 99)), 1)
    assert rows(table.read(spark)) == want


def test_a_batch_that_stopped_half_way_is_taken_whole(spark, tmp_path, rows, monkeypatch):
    table, batch = job_table(spark, tmp_path)
    table.merge(batch(*[(k, "a", k) for k in range(20)]), 0)
    before = rows(table.read(spark))

    def stop(*_):
        raise RuntimeError("stopped before the commit")

    with monkeypatch.context() as m:
        m.setattr(S.LatestTable, "_commit", stop)
        with pytest.raises(RuntimeError):
            table.merge(batch((1, "b", 100), (77, "b", 100)), 1)
    assert rows(table.read(spark)) == before
    table.merge(batch((1, "c", 101)), 1)
    assert rows(table.read(spark)) == sorted([r for r in before if r[0] != 1] + [(1, "c", 101)], key=repr)


def test_only_touched_buckets_are_written(spark, tmp_path):
    table, batch = job_table(spark, tmp_path)
    table.merge(batch(*[(k, "a", k) for k in range(50)]), 0)
    table.merge(batch((1, "b", 100)), 1)
    assert sorted(table._versions(spark)[1].values()) == [0, 0, 1]
    assert len(list((tmp_path / "rows" / "version=1").glob("bucket=*"))) == 1


def test_latest_over_micro_batches(spark, tmp_path, rows):
    start = dt.datetime(2024, 1, 1)
    schema = "job_id bigint, stage string, progress double, ts timestamp"
    reports = [(k % 7, f"s{k}", k / 40, start + dt.timedelta(seconds=k * 37 % 40)) for k in range(40)]
    path = str(tmp_path / "j")
    for k in range(0, 40, 10):
        spark.createDataFrame(reports[k : k + 10], schema).coalesce(1).write.mode("append").parquet(path)
    stream = spark.readStream.schema(schema).option("maxFilesPerTrigger", 1).parquet(path)
    batches = []
    got = S.job_latest(stream, "latest-test", batches)
    newest = {}
    for job, stage_, _, ts in reports:
        newest[job] = max(newest.get(job, (start, "")), (ts, stage_))
    assert len(batches) >= 4
    assert rows(got, "job_id", "stage") == sorted((job, s) for job, (_, s) in newest.items())


def test_dedup_over_micro_batches(spark, tmp_path):
    df = spark.range(40).select(
        F.concat(F.lit("s"), (F.col("id") % 7).cast("string")).alias("sha"), F.lit("m").alias("model"),
        F.lit("en").alias("language"), F.timestamp_seconds("id").alias("ts"), "id",
    )
    stream = in_pieces(spark, df, str(tmp_path / "d"), "id")
    assert S.run_available(S.transcript_dedup(stream, "1 day"), "dedup-test").count() == 7


def test_late_reports_are_dropped(spark, tmp_path):
    at = lambda h, m=0: dt.datetime(2024, 1, 1, h, m)
    schema = "job_id bigint, stage string, progress double, ts timestamp"
    path = str(tmp_path / "p")
    first = [(1, "A", 0.2, at(1)), (1, "A", 0.4, at(1, 30))]
    late = [(1, "A", 1.0, at(1, 45)), (1, "A", 1.0, at(12))]
    # rows count as late one micro-batch after the watermark has passed them
    for batch in (first, [(1, "A", 0.9, at(9))], [(1, "A", 0.7, at(9, 30))], late):
        spark.createDataFrame(batch, schema).coalesce(1).write.mode("append").parquet(path)
    stream = spark.readStream.schema(schema).option("maxFilesPerTrigger", 1).parquet(path)
    got = S.run_available(S.job_progress(stream, "1 hour", "2 hours"), "late-test").orderBy("window_us").collect()
    assert [(r.reports, r.mean_progress) for r in got] == [(2, 0.3), (2, 0.8)]


def test_phrases_close_after_silence(spark, tmp_path):
    start = dt.datetime(2024, 1, 1)
    words = [(1, start + dt.timedelta(seconds=s), length) for s, length in [(0, 1.0), (4, 0.5), (20, 1.0), (90, 1.0)]]
    path = str(tmp_path / "w")
    spark.createDataFrame(words, "track_id bigint, ts timestamp, length_s double").coalesce(1).write.parquet(path)
    stream = spark.readStream.schema("track_id bigint, ts timestamp, length_s double").parquet(path)
    got = S.run_available(S.phrases(stream, 3.5, "10 seconds"), "phrase-test").orderBy("start_us").collect()
    assert [r.words for r in got] == [2, 1]


def test_a_table_in_a_folder_of_files_is_streamed_whole(spark, tmp_path, rows):
    spark.read.parquet(f"{SF_DIR}/documents.parquet").repartition(3).write.parquet(str(tmp_path / "documents.parquet"))
    got = rows(dedup(spark, str(tmp_path)))
    assert got == rows(dedup(spark, SF_DIR)) and len(got) > 100
