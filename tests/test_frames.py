"""Frame analytics: golden cases."""

import pytest
from pyspark.sql import functions as F

from chalkline.operators import frames


def test_frame_type_edges(spark):
    rows = [(181.0, 59.0), (181.0, 60.0), (79.0, 10.0), (80.0, 10.0), (180.0, 1.0)]
    df = frames.with_frame_type(spark.createDataFrame(rows, "gray_mean double, gray_std double"))
    assert [r.frame_type for r in df.collect()] == ["slide", "tablet", "blackboard", "tablet", "tablet"]


def test_route(spark):
    df = spark.createDataFrame([(200.0, 1.0), (100.0, 1.0), (10.0, 1.0)], "gray_mean double, gray_std double")
    plan = lambda v: [(r.engine, r.preprocess) for r in frames.ocr_route(df, v).collect()]
    assert plan(True) == [("standard", "none"), ("vision", "none"), ("vision", "contrast")]
    assert plan(False) == [("standard", "none"), ("standard", "equalise"), ("standard", "equalise")]


BLOCKS = "lecture_id bigint, frame_index int, blocks array<struct<text: string, confidence: double>>"


def test_block_filter_and_text(spark):
    rows = [(1, 0, [("ab", 0.3), (" a ", 0.9), ("ab", 0.31), ("cd", 1.0)]), (1, 1, [("x", 0.9)])]
    df = spark.createDataFrame(rows, BLOCKS)
    assert [r.raw_text for r in frames.frame_text(df).collect()] == ["ab cd"]
    assert tuple(frames.frame_summary(df).head()) == (1, 1, 2)


def test_histogram_and_distance(spark):
    rows = [(1, v) for v in (0, 3, 4, 255)] + [(2, 200)] * 3 + [(3, 0)] * 5
    h = {r.id: r.hist for r in frames.histogram(spark.createDataFrame(rows, "id bigint, v int")).collect()}
    assert (h[1][0], h[1][1], h[1][63], sum(h[1])) == (2, 1, 1, 4) and len(h[1]) == 64
    df = spark.createDataFrame([(h[1], h[1]), (h[2], h[3])], "a array<double>, b array<double>")
    got = [r[0] for r in df.select(frames.bhattacharyya(F.col("a"), F.col("b"))).collect()]
    assert got == pytest.approx([0.0, 1.0], abs=1e-7)
    out = frames.histogram(spark.createDataFrame([(4, 999), (4, -1)], "id bigint, v int")).head().hist
    empty = spark.createDataFrame([(out, h[1]), (out, out)], "a array<double>, b array<double>")
    assert sum(out) == 0 and [r[0] for r in empty.select(frames.bhattacharyya(F.col("a"), F.col("b"))).collect()] == [1.0, 1.0]


def test_top_candidates_order_and_optional_bound(spark):
    rows = [(1, 0.5, 1.0, "a"), (1, 0.5, 2.0, "a"), (1, 0.01, 3.0, "a"), (1, 0.5, 2.0, "b")]
    df = spark.createDataFrame(rows, "lecture_id bigint, score double, timestamp_sec double, image_path string")
    top = frames.top_candidates(df, n=3).orderBy("rank").collect()
    assert [(r.timestamp_sec, r.image_path) for r in top] == [(2.0, "b"), (2.0, "a"), (1.0, "a")]
    assert frames.top_candidates(df, min_score=0.05).count() == 3


def test_figures_are_numbered_after_acceptance(spark):
    rows = [(1, i, 60.0 * i, '{"include": %s, "caption": "c%d"}' % (str(i % 2 == 1).lower(), i)) for i in range(6)] + [(1, 9, 0.0, "nope")]
    df = spark.createDataFrame(rows, "lecture_id bigint, ord bigint, timestamp_sec double, raw string")
    got = [(r.filename, r.caption, r.reason) for r in frames.named_figures(df).orderBy("ord").collect()]
    assert got == [("fig_01_01m00s.jpg", "c1", ""), ("fig_02_03m00s.jpg", "c3", ""), ("fig_03_05m00s.jpg", "c5", "")]
    assert tuple(frames.figure_summary(df).head()) == (1, 3, 7)


def test_numbers_cross_blocks(spark):
    df = spark.createDataFrame([(k, i * 3) for k in (1, 2) for i in range(50)], "k bigint, o bigint")
    got = frames.number_within(df, "k", "o", "n", block_rows=10).collect()
    assert all(r.n == r.o // 3 + 1 for r in got)
