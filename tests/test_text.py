"""Golden cases of the scalar functions and word windows."""

import pytest
from pyspark.sql import functions as F

from chalkline.functions import text as T
from chalkline.functions.windows import prompt_chunks, window_step, word_windows


def one(spark, column, **values):
    row = spark.createDataFrame([tuple(values.values())], ", ".join(
        f"{k} {'double' if isinstance(v, float) else 'bigint' if isinstance(v, int) else 'string'}" for k, v in values.items()
    ))
    return row.select(column.alias("x")).head()["x"]


def starts(spark, n_words, size, step):
    df = spark.createDataFrame([(1, " ".join(f"w{i}" for i in range(n_words)))], "lecture_id bigint, transcript string")
    return [(r.start, len(r.chunk.split())) for r in word_windows(df, "transcript", size, step, ["lecture_id"]).collect()]


def test_windows(spark):
    assert starts(spark, 500, 500, window_step(500, 50)) == [(0, 500), (450, 50)]
    assert starts(spark, 25, 10, window_step(10, 10)) == [(0, 10), (10, 10), (20, 5)]
    assert starts(spark, 0, 50, 25) == []


@pytest.mark.parametrize("n", [1, 24, 25, 26, 49, 50, 51, 333])
def test_windows_cover_every_word(spark, n):
    found = starts(spark, n, 50, 25)
    assert [s for s, _ in found] == list(range(0, n, 25))
    assert [k for _, k in found] == [min(50, n - s) for s in range(0, n, 25)]


def test_prompt_chunks(spark):
    rows = [(1, "a  b\n c"), (2, "a b c  d e"), (3, "")]
    df = spark.createDataFrame(rows, "lecture_id bigint, transcript string")
    got = sorted((r.lecture_id, r.chunk_idx, r.chunk) for r in prompt_chunks(df, "transcript", 3, ["lecture_id"]).collect())
    assert got == [(1, 0, "a  b\n c"), (2, 0, "a b c"), (2, 1, "d e"), (3, 0, "")]


@pytest.mark.parametrize("text", [" a b\n", "", " \t", "a b", "a\x1cb c", "　x"])
def test_words_are_those_of_str_split(spark, text):
    assert one(spark, T.words("t"), t=text) == text.split()


@pytest.mark.parametrize("title, want", [("Room-20251008 0805-1", "2025-10-08"), ("ID 123456789", "1234-56-78"), ("none 1234", None)])
def test_title_date(spark, title, want):
    assert one(spark, T.title_date("t"), t=title) == want


@pytest.mark.parametrize("stem, want", [("08-10-2025_X", "08-10-2025"), ("X", "unknown"), ("abcdefghij_X", "abcdefghij")])
def test_stem_date(spark, stem, want):
    assert one(spark, T.stem_date("t"), t=stem) == want


def test_notes_name(spark):
    name = lambda suffix: T.notes_name(F.col("c"), F.col("d"), F.lit(suffix))
    assert one(spark, name("P1"), c="A/B: C", d="2025-10-08") == "08-10-2025_AB C - P1.pdf"
    assert one(spark, name(""), c=" X ", d="today") == "today_X.pdf"


@pytest.mark.parametrize("course, want", [("Analisi 2", "analisi_2"), ("A-B", "a_b"), ("AI", "ai_course"), ("C++", "c_course"), ("é" * 70, "é" * 63)])
def test_collection_name(spark, course, want):
    assert one(spark, T.collection_name("t"), t=course) == want


@pytest.mark.parametrize("t, want", [(125.7, "02:05"), (3725.0, "62:05")])
def test_clock(spark, t, want):
    assert one(spark, T.clock("t"), t=t) == want


def test_one_decimal_rounds_exact_binary_values_half_even(spark):
    values = [i * 0.05 for i in range(2000)] + [10.35, 0.25, 0.35, 10.25, 1e6 + 0.05, 5399.95]
    df = spark.createDataFrame([(v,) for v in values], "v double").select("v", T.one_decimal("v").alias("s"))
    assert [(r.v, r.s) for r in df.collect() if r.s != f"{r.v:.1f}"] == []


@pytest.mark.parametrize("line, want", [("well-known", True), ("f(x)", False), ("F(x)", True), ("plain words", False), ("sum of", True), ("summary", False), ("5 dB", True), ("α", True)])
def test_mathematical(spark, line, want):
    assert one(spark, T.is_mathematical("t"), t=line) is want


@pytest.mark.parametrize("text, want", [("[05min] x = 2", ["[05min]", "x = 2"]), ("a[i] = 3", ["a[i]", "= 3"]), (" \n a \n", ["a"])])
def test_line_split(spark, text, want):
    assert one(spark, T.split_lines("t"), t=text) == want


def test_overlap_coefficient(spark):
    def sim(a, b):
        return one(spark, T.overlap_coefficient(T.word_set("a"), T.word_set("b")), a=a, b=b)

    line = " ".join("abcdefghij")
    assert sim(line, "a b c d e f g " + " ".join(f"z{i}" for i in range(9))) == 0.7
    assert sim("== ++", "a b") == 0.0
    assert sim("Étude d'été x_1", "ÉTUDE D ÉTÉ X_1") == 1.0


@pytest.mark.parametrize("url, want", [("/x.MP4", False), ("/app.tsx", True), ("/StreamURL?a", True), ("/a.m3u8", True), ("/page", False)])
def test_media(spark, url, want):
    assert one(spark, T.is_media_request("t"), t=url) is want


def test_fences(spark):
    assert one(spark, T.strip_fences("t"), t="```latex\n\\x\n```\n") == "\\x"
    assert one(spark, T.strip_fences("t"), t="```\na\n```tex\nb ```  \nc") == "a\nb \nc"
    assert one(spark, T.parse_verdict("t"), t='```json\n{"include": true, "caption": "c"}\n```')["include"] is True
    assert one(spark, T.parse_verdict("t"), t="nope")["include"] is None


def test_resolve_date(spark):
    date = lambda g, f: one(spark, T.resolve_date(F.col("g"), F.lit("today"), F.lit(f).cast("string")), g=g)
    assert date("today", "2025-01-01") == "2025-01-01"
    assert date("1999-09-09", "2025-01-01") == "1999-09-09"
    assert date("today", None) == "today"


def test_lecture_day_reads_both_notations(spark):
    day = lambda t: str(one(spark, T.lecture_day("t"), t=t))
    assert day("2025-10-08") == day("08-10-2025") == "2025-10-08"
    assert day("unknown") == "None"
