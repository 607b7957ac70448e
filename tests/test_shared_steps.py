"""Steps that many queries share do no more than their readers need."""

from pyspark.sql import functions as F

from cadenza.session import configure
from cadenza.sources import testbed as B

SF_DIR = "/root/testdata/sf0.001"


def test_explode_computes_its_array_once(spark):
    taken = configure(spark).range(3).select(F.explode(F.transform(F.sequence(F.lit(0), "id"), lambda x: x * 2)))
    assert "Filter" not in taken._jdf.queryExecution().executedPlan().toString()


def test_tokens_of_pairs_need_no_vocabulary_of_all_documents(spark, monkeypatch):
    monkeypatch.setattr(B, "_STAGED", {})
    assert B.heard_tokens(spark, SF_DIR).count() > 0 and B.sheet_tokens(spark, SF_DIR).count() > 0
    assert "vocabulary" not in {name for _, _, name in B._STAGED}


def test_upgraded_documents_are_neither_joined_nor_parsed_again(spark):
    from cadenza.catalog import stored
    from cadenza.sources import tables

    plan = lambda df: df._jdf.queryExecution().optimizedPlan().toString()
    assert "Join" not in plan(stored.upgraded_documents(spark, SF_DIR))
    raw = spark.createDataFrame([("a", '{"id":"a"}', 7)], "id string, json string, note int")
    upgraded = tables.doc_upgrade(raw)
    assert [(r.note, r.valid, r.captions) for r in upgraded.collect()] == [(7, False, None)]
    assert plan(tables.doc_words(tables.doc_captions(upgraded))).count("parseJson") == plan(upgraded.select("valid")).count("parseJson")


def test_words_of_a_line_stay_in_its_row(spark):
    from cadenza.operators.tracks import line_distribute

    lines = spark.createDataFrame(
        [(1, 0, "don't stop", 0, 2_000_000), (1, 1, "", 0, 5), (1, 2, "go", 0, 900_000)],
        "track_id bigint, idx bigint, text string, start_us bigint, end_us bigint",
    )
    matches = spark.createDataFrame(
        [(1, 0, 1, 1_200_000, 1_500_000), (1, 0, 1, 1_300_000, 1_600_000), (1, 0, 9, 0, 1), (1, 2, -1, 0, 1)],
        "track_id bigint, idx bigint, k bigint, heard_start_us bigint, heard_end_us bigint",
    )
    placed = line_distribute(lines, matches)
    got = sorted((r.idx, r.k, r.text, r.start_us, r.confidence) for r in placed.collect())
    assert got == [(0, 0, "don't", 0, 0.45), (0, 1, "stop", 1_200_000, 0.85), (2, 0, "go", 0, 0.45)]
    assert placed._jdf.queryExecution().optimizedPlan().toString().count("Generate") == 1


def test_warped_captions_read_no_words(spark):
    from cadenza.catalog import joins

    plan = joins.warped(spark, SF_DIR)[0]._jdf.queryExecution().optimizedPlan().toString()
    assert "posexplode" not in plan


def test_realigned_words_are_not_joined_with_themselves(spark):
    from cadenza.catalog import tracks

    words, _, scores = tracks.realigned(spark, SF_DIR)
    for df in (words, scores):
        plan = df._jdf.queryExecution().optimizedPlan().toString()
        assert "snapped-words" not in plan and "[track_id" in plan
    # one join of the ordered scan, of its rows with its chunks
    assert words._jdf.queryExecution().optimizedPlan().toString().count("Join") == 1


def test_what_grows_in_the_sync_is_not_broadcast(spark, monkeypatch):
    """Tables of words, lines and tokens are small files at first; only their rows tell how large they are."""
    import re

    from cadenza.operators.alignment import normalize_tokens
    from cadenza.operators.joins import match_times
    from cadenza.operators.text import raw_tokens, token_dim
    from cadenza.plans import sync

    plan = lambda df: df._jdf.queryExecution().executedPlan().toString()
    grows = lambda df: re.findall(r"BroadcastHashJoin \[(?:\w+#\d+L?, )*(?:i|j|k|idx|line_index|raw)#.*", plan(df))
    staged = {}
    monkeypatch.setattr(sync, "stage", lambda df, label, own=sync.stage: staged.setdefault(label, []).append(df) or own(df, label))
    verse = "seven lanterns swing above our harbour"
    lines = spark.createDataFrame(
        [(t, k, verse, False) for t in (1, 2) for k in range(3)], "track_id bigint, idx bigint, text string, instrumental boolean"
    )
    heard = spark.createDataFrame(
        [(t, j, w, j * 400_000, j * 400_000 + 300_000) for t in (1, 2) for j, w in enumerate((verse + " hey").split() * 3)],
        "track_id bigint, j bigint, word string, start_us bigint, end_us bigint",
    )
    segments = spark.createDataFrame(
        [(t, 0, 0, 9_000_000, 0.1) for t in (1, 2)],
        "track_id bigint, k bigint, start_us bigint, end_us bigint, no_speech_prob double",
    )
    durations = spark.createDataFrame([(1, 10_000_000), (2, 10_000_000)], "track_id bigint, duration_us bigint")
    anchors = spark.createDataFrame(
        [(1, 0, 0, 0.5, 0)], "track_id bigint, line_index bigint, offset_us bigint, confidence double, anchor_id bigint"
    )
    vocabulary = sync.stage(token_dim(raw_tokens(lines.select("text"))), "vocabulary")
    # as if read from files, which are small for their rows
    tables = [sync.stage(t, "given") for t in (lines, heard, segments, durations)]
    result = sync.run_sync(*tables, vocabulary, sync.stage(anchors, "given"))
    assert result.captions.filter("not instrumental").count() == 6
    assert result.words.select("track_id", "idx", "k").distinct().count() == result.words.count() == 36
    found = {f"{label} {n}": grows(df) for label, dfs in staged.items() for n, df in enumerate(dfs)}
    words = tables[1].withColumnRenamed("word", "raw")
    path = sync.stage(spark.range(9).selectExpr("1L AS pair_id", "id AS i", "id AS j", "1D AS score"), "path")
    found["times"] = grows(match_times(path, tables[1].withColumnRenamed("track_id", "pair_id")))
    found["words"] = grows(result.words)
    # the frequent words, at most ten thousand, are meant to be
    assert len([j for j in grows(normalize_tokens(words, vocabulary, True)) if "LeftAnti" not in j]) == 1
    steps = {"matches", "filled", "timed-tokens", "caption-words", "lines", "times", "words"}
    assert not {name: joins for name, joins in found.items() if joins and name.split()[0] in steps}
