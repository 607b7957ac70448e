"""Edits, repairs and stored tables on small fixtures."""

import hashlib
import json

import pytest
from pyspark.sql import functions as F

from cadenza.operators import edits as E
from cadenza.operators import repair as R
from cadenza.operators import tracks as T
from cadenza.sources import tables as S

CAPS = "track_id bigint, idx bigint, start_us bigint, end_us bigint"


def us(s):
    return round(s * 1_000_000)


def caps(spark, *spans):
    return spark.createDataFrame([(1, i, us(a), us(b)) for i, (a, b) in enumerate(spans)], CAPS)


def edit(spark, idx, kind, value, name="kind"):
    return spark.createDataFrame([(1, idx, kind, us(value))], f"track_id bigint, idx bigint, {name} string, value_us bigint")


def length(spark, s):
    return spark.createDataFrame([(1, us(s))], "track_id bigint, duration_us bigint")


def spans(df):
    return [(r.start_us / 1e6, r.end_us / 1e6) for r in df.orderBy("idx").collect()]


def test_ripple_keeps_gaps(spark):
    df = E.edit_ripple(caps(spark, (3, 5), (5.5, 6.5), (7.25, 9)), edit(spark, 0, "out", 5.75), length(spark, 40))
    assert spans(df) == [(3, 5.75), (6.25, 7.25), (8, 9.75)]
    assert not any(r.clamped for r in df.collect())


def test_ripple_stops_at_the_end(spark):
    df = E.edit_ripple(caps(spark, (21, 23), (23.5, 24.5)), edit(spark, 0, "out", 31), length(spark, 25))
    assert spans(df) == [(21, 23.5), (24, 25)]
    assert [r.clamped for r in df.orderBy("idx").collect()] == [True, False]


def test_move_shifts_the_tail(spark):
    df = E.edit_ripple(caps(spark, (4, 7), (8, 8.5)), edit(spark, 0, "move", 4.25), length(spark, 40))
    assert spans(df) == [(4.25, 7.25), (8.25, 8.75)]


def test_roll_keeps_the_span(spark):
    rolls = spark.createDataFrame([(1, 0, us(5.75))], "track_id bigint, idx bigint, boundary_us bigint")
    assert spans(E.edit_roll(caps(spark, (3, 5), (5, 8)), rolls)) == [(3, 5.75), (5.75, 8)]


def test_independent_leaves_neighbours(spark):
    df = E.edit_independent(caps(spark, (5, 6), (9, 11)), edit(spark, 0, "out", 7.25, "edge"), length(spark, 40))
    assert spans(df) == [(5, 7.25), (9, 11)]


def test_ripple_over_a_track_longer_than_a_chunk(spark):
    n = 9000
    track = spark.range(n).select(
        F.lit(1).cast("bigint").alias("track_id"), F.col("id").alias("idx"),
        (F.col("id") * 1_000_000).alias("start_us"), (F.col("id") * 1_000_000 + 500_000).alias("end_us"),
    )
    df = E.edit_ripple(track, edit(spark, 10, "out", 10.75), length(spark, n + 100))
    moved = df.filter("idx > 10").select((F.col("start_us") - F.col("idx") * 1_000_000).alias("d")).distinct().collect()
    assert [r.d for r in moved] == [250_000]


def test_delete_and_duplicate(spark):
    captions = caps(spark, (0, 1), (2, 3), (4, 5)).withColumn("text", F.col("idx").cast("string"))
    ids = spark.createDataFrame([(1, 1)], "track_id bigint, idx bigint")
    assert [r.position for r in E.caption_delete(captions, ids).orderBy("idx").collect()] == [0, 1]
    copies = E.caption_duplicate(captions, ids).orderBy("position").collect()
    assert [(r.start_us / 1e6, r.copy) for r in copies] == [(0, 0), (2, 0), (3.04, 1), (4, 0)]


def test_sweep_and_fill_leave_words_in_order(spark):
    tokens = spark.createDataFrame(
        [(1, 0, 1, None, None, 0.0), (1, 1, 2, us(5), us(5.4), 0.9), (1, 2, 3, None, None, 0.0), (1, 3, 1, None, None, 0.0), (1, 4, 1, us(6), us(6.2), 0.8)],
        "track_id bigint, i bigint, weight bigint, start_us bigint, end_us bigint, confidence double",
    )
    filled = T.gap_interpolate(tokens, length(spark, 10))
    got = T.monotone_sweep(filled.select("track_id", "i", "start_us", "end_us")).orderBy("i").collect()
    assert all(a.end_us <= b.start_us for a, b in zip(got, got[1:]))
    assert all(r.end_us - r.start_us >= 79_999 for r in got)
    assert got[0].start_us == us((5 - 0.28) * 0.35)


def test_one_bad_suggestion_rejects_its_track(spark):
    rows = spark.createDataFrame(
        [(1, 0, "0", "1000000", "3000000", None), (1, 1, "1", "3000000", "5000000", "2"),
         (2, 2, "0", "1000000", "3000000", None), (2, 3, "0", "3000000", "5000000", None),
         (3, 4, "0", "later", "3000000", None)],
        "track_id bigint, row_id bigint, line_index string, start_us string, end_us string, confidence string",
    )
    lengths = spark.createDataFrame([(t, us(4.5)) for t in (1, 2, 3)], "track_id bigint, duration_us bigint")
    got = [(r.track_id, r.line_index, r.end_us, r.confidence) for r in R.suggestion_validate(rows, lengths).orderBy("line_index").collect()]
    assert got == [(1, 0, us(3), 0.6), (1, 1, us(4.5), 1.0)]


def test_old_documents(spark):
    good = '{"id":"p1","version":0,"meta":{"title":"T","artist":"A","durationSec":1.5,"fps":25,"resolution":"1280x720","aspectRatio":"1:1"}}'
    raw = spark.createDataFrame([("p1", good), ("p2", '{"id":"p2","meta":{"title":"Kept"}}'), ("p3", "{")], "id string, json string")
    got = {r.id: (r.version, r.title, r.artist, r.valid) for r in S.doc_migrate(raw).collect()}
    assert got == {"p1": (1, "T", "A", True), "p2": (1, "Kept", "Unknown Artist", False), "p3": (1, "Untitled", "Unknown Artist", False)}


def test_whole_documents_keep_what_no_schema_names(spark):
    meta = '"meta":{"title":"T","artist":"A","durationSec":1.5,"fps":25,"resolution":"1280x720","aspectRatio":"1:1"}'
    word = '{"text":"la","startSec":0.5,"endSec":0.75,"hint":[1,null]}'
    caption = '{"text":"la","startSec":0.5,"endSec":1,"words":[' + word + ']}'
    rest = meta + ',"captions":[' + caption + '],"own":{"a":[1,{"b":"\u00fc"}],"n":null}'
    same = '{ "version" : 2, "id":"same", ' + rest + "}"
    docs = {
        "same": same,
        "zero": '{"id":"zero","version":0,' + rest + "}",
        "none": '{"id":"none",' + rest + "}",
        "late": '{"id":"late","version":1,' + meta + ',"captions":[{"text":"x","startSec":2,"endSec":1}]}',
        "text": '{"id":"text","version":"1",' + meta + "}",
        "list": "[1]",
        "cut": '{"id":',
        "void": None,
    }
    raw = spark.createDataFrame(list(docs.items()), "id string, json string")
    got = {r.id: r for r in S.doc_upgrade(raw).collect()}
    assert got["same"].json == same and not got["same"].changed
    for name in ("zero", "none"):
        want = json.loads(docs[name]) | {"version": 1}
        assert json.loads(got[name].json) == want and got[name].changed and got[name].valid
    for name, title in (("late", "T"), ("text", "T"), ("list", "Untitled"), ("cut", "Untitled"), ("void", "Untitled")):
        new = json.loads(got[name].json)
        assert not got[name].valid and (new["id"], new["version"], new["meta"]["title"], new["captions"]) == (name, 1, title, [])
    captions = S.doc_captions(S.doc_upgrade(raw))
    assert {(r.id, r.idx, r.start_us, r.end_us) for r in captions.collect()} == {(n, 0, us(0.5), us(1)) for n in ("same", "zero", "none")}
    assert {(r.id, r.k, r.text, r.end_us) for r in S.doc_words(captions).collect()} == {(n, 0, "la", us(0.75)) for n in ("same", "zero", "none")}
    assert S.doc_upgrade(raw.limit(0)).count() == 0


def test_files_to_manifest(spark, tmp_path):
    (tmp_path / "a.mp3").write_bytes(b"one")
    (tmp_path / "b.wav").write_bytes(b"one")
    (tmp_path / "noext").write_bytes(b"x" * 50)
    manifest = S.asset_manifest(S.asset_files(spark, str(tmp_path)), max_bytes=20)
    got = {r.name: (r.ext, r.sha, r.reason) for r in manifest.collect()}
    one = hashlib.sha256(b"one").hexdigest()
    assert got["a.mp3"] == (".mp3", one, None) and got["noext"][0::2] == (".bin", "oversized_upload")
    assert sorted(r.copies for r in S.asset_dedup(manifest).collect()) == [1, 2]


def test_transcript_files(spark, tmp_path):
    (tmp_path / "a.json").write_text('{"text":"hi","words":[{"word":"hi","start":0.5,"end":0.9}]}')
    (tmp_path / "b.json").write_text('{"text":"kept","words":"none"}')
    docs, words, segments = S.transcript_scan(S.read_transcripts(spark, str(tmp_path)))
    assert sorted((r.text, r.words, r.segments) for r in docs.collect()) == [("hi", 1, 0), ("kept", 0, 0)]
    assert [(r.start_us, r.end_us) for r in words.collect()] == [(500_000, 900_000)]


def test_export_is_in_time_order(spark, tmp_path):
    n = 300
    captions = spark.range(n).select(
        (F.col("id") % 2).alias("track_id"), F.col("id").alias("idx"), ((n - F.col("id")) * 1_000_000).alias("start_us"),
        ((n - F.col("id")) * 1_000_000 + 1).alias("end_us"), F.col("id").cast("string").alias("text"),
    )
    S.export_timed_text(captions, str(tmp_path / "out"))
    for track in (0, 1):
        files = sorted((tmp_path / "out" / f"track_id={track}").glob("part-*"))
        lines = [line for f in files for line in f.read_text().splitlines()]
        assert [int(line.rsplit(" ", 1)[1]) for line in lines] == sorted(range(track, n, 2), reverse=True)


def test_cache_is_written_by_key(spark, tmp_path):
    rows = spark.createDataFrame([("s", "m", "en", 2), ("s", "m", "en", 1), ("s", "m", "de", 3)], "sha string, model string, language string, result_id bigint")
    unique = S.cache_unique(rows, ["result_id"])
    S.write_cache(unique, str(tmp_path / "cache"))
    back = spark.read.parquet(str(tmp_path / "cache"))
    assert sorted((r.language, r.result_id) for r in back.collect()) == [("de", 3), ("en", 1)]


@pytest.mark.parametrize("n", [3, 100])
def test_history_is_limited_before_the_shuffle(spark, n):
    df = spark.range(1000).select((F.col("id") % 2).alias("k"), "id")
    kept = S.history_keep_n(df, ["k"], ["id"], n)
    assert kept.count() == 2 * n
    assert "WindowGroupLimit" in kept._jdf.queryExecution().executedPlan().toString()
