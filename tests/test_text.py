"""Words, sheets and time codes with hand-derived expectations."""

import pytest
from pyspark.sql import functions as F

from cadenza.functions import text as X
from cadenza.functions.timecode import format_timecode, parse_timecode
from cadenza.operators.text import caption_lines, natural_sort, raw_tokens, token_dim
from cadenza.sources.sheets import sheet_headers, sheet_lines


def one(spark, column, value):
    return spark.createDataFrame([(value,)], "x string").select(column(F.col("x"))).first()[0]


@pytest.mark.parametrize(
    "raw, norm",
    [
        ("Hello,", "hello"),
        ("I'm", "i am"),
        ("don’t", "do not"),
        ("ill", "i will"),
        ("21", "twentyone"),
        ("007", "seven"),
        ("1000", "onethousand"),
        ("999999", "ninehundredninetyninethousandninehundredninetynine"),
        ("1234567", "1234567"),
        ("1000000", "100"),  # larger numbers keep their digits, and repeats collapse later
        ("a1b22", "aonebtwentytwo"),
        ("&", "and"),
        ("soooo", "soo"),
        ("--", "--"),
        ("(!)", ""),
        ("rock'n'roll", "rock'n'roll"),
    ],
)
def test_normal_form(spark, raw, norm):
    assert one(spark, X.normalized, raw) == norm


@pytest.mark.parametrize(
    "word, key",
    [
        ("knight", "NKT"),
        ("thought", "0KT"),
        ("church", "XRX"),
        ("phone", "FN"),
        ("bridge", "PRJ"),
        ("mission", "MSN"),
        ("nation", "NXN"),
        ("xylo", "SL"),
        ("taxi", "TKS"),
        ("extravagant", "AKSTRF"),
        ("bodofolomox", "PTFLMKS"),
        ("aha", "AH"),
        ("away", "AA"),
        ("wrote", "RT"),
        ("abcdefghij", "APKTFJ"),
        ("été", "T"),
        ("123", ""),
    ],
)
def test_phonetic_key(spark, word, key):
    assert one(spark, X.phonetic, word) == key


@pytest.mark.parametrize("word, n", [("fire", 1), ("generation", 4), ("the", 1), ("loved", 1), ("日本", 1), ("beautiful", 4)])
def test_syllables(spark, word, n):
    assert one(spark, X.syllables, word) == n


def test_vocabulary_composes_foreign_tokens(spark):
    df = spark.createDataFrame([("ﬁre ﬁre fire Ｈｉ I'm",)], "text string")
    got = {(r.raw, r.part, r.norm, r.freq) for r in token_dim(raw_tokens(df)).collect()}
    assert got == {("ﬁre", 0, "fire", 2), ("fire", 0, "fire", 1), ("Ｈｉ", 0, "hi", 1), ("I'm", 0, "i", 1), ("I'm", 1, "am", 1)}


SHEET = "\r\n".join(
    ["", "## Title: One", "## title :  Two ", "## ARTIST: Someone", "[Verse 1]", "  first line ", "", "[00:12.50] timed line",
     "[00:15]", "loose line", "## note: kept", "[Chorus]  ", "last line", "", ""]
)


def test_sheet(spark, rows):
    docs = spark.createDataFrame([(1, SHEET), (2, "\n\n"), (3, "")], "doc_id bigint, text string")
    assert rows(sheet_lines(docs)) == rows(
        spark.createDataFrame(
            [
                (1, 0, "first line", "Verse 1", False),
                (1, 1, "", "Verse 1", True),
                (1, 2, "timed line", "Verse 1", False),
                (1, 3, "loose line", "00:15", False),
                (1, 4, "## note: kept", "00:15", False),
                (1, 5, "last line", "Chorus", False),
            ],
            "doc_id bigint, idx bigint, text string, section string, instrumental boolean",
        )
    )
    assert rows(sheet_headers(docs)) == [(1, "Two", "Someone"), (2, None, None), (3, None, None)]


def test_timecodes(spark):
    df = spark.createDataFrame(
        [(0,), (61_999_600,), (-1_500_000,), (6_000_000_000,)], "us bigint"
    ).select(format_timecode(F.col("us")))
    assert [r[0] for r in df.collect()] == ["00:00.000", "01:02.000", "-00:01.500", "100:00.000"]
    texts = ["1:02.5", "75", "-0:03.25", "x", "1:2:3", " 00:59.999 ", "1.2345"]
    parsed = spark.createDataFrame([(t,) for t in texts], "t string").select(parse_timecode(F.col("t")))
    assert [r[0] for r in parsed.collect()] == [62_500_000, 75_000_000, -3_250_000, None, None, 59_999_000, None]


def test_display_lines(spark):
    df = spark.createDataFrame(
        [(1, 0, "one two three four five six seven"), (1, 1, "short"), (1, 2, "")], "track_id bigint, idx bigint, text string"
    )
    got = [(r.idx, r.line_no, r.text) for r in caption_lines(df, 10, 2).orderBy("idx", "line_no").collect()]
    assert got == [(0, 0, "one two"), (0, 1, "three four…"), (1, 0, "short")]


def test_natural_order(spark):
    df = spark.createDataFrame([("Take 10",), ("take 9",), ("take 09b",), ("Alpha",)], "t string")
    assert [r.t for r in natural_sort(df, "t").collect()] == ["Alpha", "take 9", "take 09b", "Take 10"]


def test_natural_order_of_long_numbers(spark):
    long = ["1" + "0" * 19 + "9", "1" + "0" * 19 + "1", "2" * 19, "0" * 30 + "7"]
    df = spark.createDataFrame([(t,) for t in long], "t string")
    assert [r.t for r in natural_sort(df, "t").collect()] == sorted(long, key=int)


def test_parts_are_counted_as_normal_forms_split(spark):
    words = [
        "", "'", "-", "...", "&", " % ", "#1", "plain", "Don't", "DON’T", "d.o.n.t", "dooont", "illl", "i'm!", "1d",
        "(gonna)", "gonnna", "gon-na", "rock'n'roll", "23", "0012", "1234567", "é", "♪", "...aint", "İm", "ID", "x" * 40,
    ]
    df = spark.createDataFrame([(w,) for w in words], "w string")
    w = F.col("w")
    parts = X.parts_of(X.normalized(w))
    got = df.select("w", X.part_count(w).alias("n"), F.size(parts).alias("want")).collect()
    assert [(r.w, r.n) for r in got] == [(r.w, r.want) for r in got]
    got = df.select("w", X.first_part(w).alias("p"), F.try_element_at(parts, F.lit(1)).alias("want")).collect()
    assert [(r.w, r.p) for r in got] == [(r.w, r.want) for r in got]
