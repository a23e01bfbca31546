"""Golden cases and properties of the operators over time."""

import random

from pyspark.sql import functions as F

from chalkline.operators import change, temporal
from chalkline.operators.concat import ordered_concat

FRAME = "lecture_id bigint, frame_index int, timestamp_sec double, image_path string, raw_text string, is_slide boolean"
SEGMENT = "lecture_id bigint, id int, start_sec double, end_sec double, text string"
ALIGNED = "lecture_id bigint, frame_index int, timestamp_sec double, speech string, ocr_text string"
LOOKUP = "call_id bigint, lecture_id bigint, timestamp_seconds double, window_seconds double"
FIGURE = "lecture_id bigint, ord bigint, timestamp_sec double, latex_path string, caption string"


def frames_at(spark, *times, lecture=1):
    return spark.createDataFrame([(lecture, i, float(t), "p", "x", True) for i, t in enumerate(times)], FRAME)


def speech_at(spark, t, segments):
    rows = [(1, i, float(a), float(b), x) for i, (a, b, x) in enumerate(segments)]
    return temporal.align(frames_at(spark, t), spark.createDataFrame(rows, SEGMENT)).head()["speech"]


def test_align_edges(spark):
    assert speech_at(spark, 100, [(70, 75, "a")]) == ""
    assert speech_at(spark, 100, [(60, 100, "a")]) == "a"
    assert speech_at(spark, 10000, [(0, 9999, "a")]) == ""
    assert speech_at(spark, 9999, [(0, 9999, "a"), (9980, 9990, "b")]) == "a b"


def naive_pairs(frames, segments, window=30.0):
    return sorted(
        (f[0], f[1], s[1]) for f in frames for s in segments
        if f[0] == s[0] and (abs(s[2] - f[2]) < window or s[2] <= f[2] <= s[3])
    )


def test_binned_join_equals_plain_join_with_a_hot_lecture(spark):
    rng = random.Random(3)
    frames, segments = [], []
    for i in range(900):
        lecture = 7 if rng.random() < 0.6 else rng.randrange(20)
        frames.append((lecture, i, round(rng.uniform(-50, 4000), rng.choice([0, 1, 5])), "p", "x", True))
        start = round(rng.uniform(-40, 4000), rng.choice([0, 1, 5]))
        length = rng.choice([0.0, 4.0, 18.0, 29.9, 64.0, 500.0, 9999.0])
        segments.append((lecture, i, start, start + length, "t"))
    got = temporal.align_pairs(spark.createDataFrame(frames, FRAME), spark.createDataFrame(segments, SEGMENT))
    assert sorted(tuple(r) for r in got.collect()) == naive_pairs(frames, segments)


def test_lookup_window_is_inclusive_and_has_two_messages(spark):
    aligned = spark.createDataFrame([(1, 0, 160.0, "s", " x "), (1, 1, 400.0, "s", " ")], ALIGNED)
    calls = [(1, 1, 100.0, 60.0), (2, 1, 99.0, 60.0), (3, 1, 400.0, None), (4, 9, 0.0, None)]
    got = {r.call_id: r.result for r in temporal.ocr_at(spark.createDataFrame(calls, LOOKUP), aligned).collect()}
    assert got == {
        1: "[02:40] x",
        2: "No OCR data found within 60.0s of timestamp 99.0s.",
        3: "Frames found near 400.0s but no OCR text extracted.",
        4: "No OCR data found within 60s of timestamp 0.0s.",
    }


def test_first_not_nearest(spark):
    aligned = spark.createDataFrame([(1, 0, 75.0, "early", ""), (1, 1, 99.0, "near", ""), (1, 2, 500.0, "", "")], ALIGNED)
    got = temporal.first_context(frames_at(spark, 100, 45, 510), aligned)
    assert {r.timestamp_sec: r.speech for r in got.collect()} == {100.0: "early", 45.0: "", 510.0: ""}


def test_nearest_figure_tie_and_none(spark):
    figures = spark.createDataFrame([(1, 2, 15.0, "b", "B"), (1, 1, 5.0, "a", "A")], FIGURE)
    calls = spark.createDataFrame([(1, 1, 10.0, None), (2, 2, 10.0, None)], LOOKUP)
    got = {r.call_id: r.result for r in temporal.nearest_figure(calls, figures).collect()}
    assert got[1] == "Closest figure (5s away):\n  latex_path: a\n  caption: A\n  timestamp: 5.0s"
    assert got[2] == "No figures available."


def test_nearest_figure_equals_scan(spark):
    rng = random.Random(5)
    figures = [(rng.choice([1, 1, 1, 2]), i, float(rng.randrange(9000)), f"p{i}", "c") for i in range(60)]
    calls = [(i, rng.choice([1, 1, 2, 3]), float(rng.randrange(9500)), None) for i in range(300)]
    got = temporal.nearest_figure(spark.createDataFrame(calls, LOOKUP), spark.createDataFrame(figures, FIGURE))
    for r in got.collect():
        own = [f for f in figures if f[0] == r.lecture_id]
        if own:
            best = min(own, key=lambda f: abs(f[2] - r.timestamp_seconds))
            assert f"latex_path: {best[3]}\n" in r.result


def test_stride_sample_stops_at_an_unreadable_frame(spark):
    rows = [(lecture, i, not (lecture == 1 and i == 60)) for lecture in (1, 2) for i in range(0, 100)]
    df = spark.createDataFrame(rows, "lecture_id bigint, frame_idx bigint, readable boolean")
    got = temporal.stride_sample(df, fps=2.0, interval=10.0).collect()
    assert sorted((r.lecture_id, r.frame_idx, r.timestamp_sec) for r in got) == [
        (1, 0, 0.0), (1, 20, 10.0), (1, 40, 20.0), (2, 0, 0.0), (2, 20, 10.0), (2, 40, 20.0), (2, 60, 30.0), (2, 80, 40.0)
    ]
    own = temporal.stride_sample(df.withColumn("fps", F.col("lecture_id").cast("double")), interval=30.0).collect()
    assert sorted((r.lecture_id, r.frame_idx, r.timestamp_sec) for r in own) == [
        (1, 0, 0.0), (1, 30, 30.0), (2, 0, 0.0), (2, 60, 30.0)
    ]


def kept(values, threshold):
    out, last = [], None
    for i, v in enumerate(values):
        if last is None or abs(v - last) > threshold:
            out.append(i)
            last = v
    return out


def series(spark, lectures):
    rows = [(k, i, float(v)) for k, values in lectures.items() for i, v in enumerate(values)]
    return spark.createDataFrame(rows, "lecture_id bigint, ord bigint, score double")


def test_change_points_golden(spark):
    df = series(spark, {1: [1, 1.1, 5, 5.2, 9], 2: [0, 0.6, 1.2, 1.8]})
    got = sorted((r.lecture_id, r.score) for r in change.change_points(df, 1.0).collect())
    assert got == [(1, 1.0), (1, 5.0), (1, 9.0), (2, 0.0), (2, 1.2)]


def test_change_points_do_not_depend_on_blocks(spark):
    rng = random.Random(11)
    drift, walk = [i * 0.3 for i in range(700)], [0.0]
    for _ in range(900):
        walk.append(walk[-1] + rng.gauss(0, 1))
    lectures = {1: drift, 2: walk, 3: [rng.gauss(0, 5) for _ in range(800)], 4: [1.0] * 300, 5: [3.0]}
    for block in (7, 64, 100000):
        got = change.change_points(series(spark, lectures), 2.0, block_rows=block).collect()
        want = sorted((k, i) for k, v in lectures.items() for i in kept(v, 2.0))
        assert sorted((r.lecture_id, r.ord) for r in got) == want


def test_a_series_goes_on_from_an_earlier_one(spark):
    rng = random.Random(12)
    whole = {k: [rng.gauss(0, 3) for _ in range(400)] for k in (1, 2)}
    df = series(spark, whole)
    head = change.change_points(df.where("ord < 150"), 2.0, block_rows=64)
    last = head.groupBy("lecture_id").agg(F.max_by("score", "ord").alias("score"))
    tail = change.change_points(df.where("ord >= 150"), 2.0, block_rows=64, entering=last)
    got = sorted((r.lecture_id, r.ord) for r in head.union(tail).collect())
    assert got == sorted((k, i) for k, v in whole.items() for i in kept(v, 2.0))


def test_block_summary_is_exact():
    import numpy as np

    rng = np.random.default_rng(0)
    for trial in range(600):
        n = int(rng.integers(1, 120))
        values = [rng.normal(0, 5, n), np.cumsum(rng.normal(0, 1, n)), np.arange(n) * 0.3, rng.integers(0, 5, n) * 1.0][trial % 4]
        entering, threshold = float(rng.normal(0, 5)), float(rng.choice([0.5, 1.0, 3.0]))
        mask = change.kept_rows(values, threshold, entering)
        left = values[mask][-1] if mask.any() else entering
        assert change.apply_summary(change.block_summary(values, threshold), entering, threshold) == left


def test_histogram_changes_equal_a_fold(spark):
    import numpy as np

    rng = np.random.default_rng(4)
    base = rng.random((6, 16))
    rows, want = [], []
    for lecture, n in ((1, 150), (2, 40)):
        last, scene = None, 0
        for i in range(n):
            scene = int(rng.integers(0, 6)) if rng.random() < 0.1 else scene
            h = base[scene] + rng.random(16) * 0.3
            rows.append((lecture, i, [float(x) for x in h]))
            if last is None or np.sqrt(max(0.0, 1 - np.sqrt(h * last).sum() / np.sqrt(h.sum() * last.sum()))) > 0.12:
                want.append((lecture, i))
                last = h
    df = spark.createDataFrame(rows, "lecture_id bigint, ord bigint, hist array<double>")
    for block in (16, 4096):
        got = change.histogram_changes(df, 0.12, block_rows=block)
        assert sorted((r.lecture_id, r.ord) for r in got.collect()) == want


def drifting(n):
    """A slow drift: what is kept depends on every kept row before it. Some rows are empty."""
    import numpy as np

    rows = []
    for i in range(n):
        h = np.exp(-0.5 * ((np.arange(32) - 4 - i * 0.02) / 3.0) ** 2)
        rows.append((1, i, [0.0] * 32 if i % 97 == 50 else [float(x) for x in h]))
    return rows


def test_drift_over_a_hundred_blocks_is_exact_in_a_bounded_number_of_jobs(spark):
    import numpy as np

    rows, want, last = drifting(800), [], None
    for _, i, h in rows:
        h = np.array(h)
        mass = 0.0 if last is None else np.sqrt(h.sum() * last.sum())
        if last is None or np.sqrt(max(0.0, 1 - (np.sqrt(h * last).sum() / mass if mass else 0.0))) > 0.2:
            want.append(i)
            last = h
    df = spark.createDataFrame(rows, "lecture_id bigint, ord bigint, hist array<double>")
    tracker, group = spark.sparkContext.statusTracker(), "drift"
    spark.sparkContext.setJobGroup(group, group)
    got = sorted(r.ord for r in change.histogram_changes(df, 0.2, block_rows=8).collect())
    jobs = len(tracker.getJobIdsForGroup(group))
    spark.sparkContext.setLocalProperty("spark.jobGroup.id", None)
    assert got == want and 10 < len(want) < 200
    assert jobs < 60


def test_lookups_near_the_same_frames_share_one_answer(spark, monkeypatch):
    joined = []

    def recorded(df, *args, **kwargs):
        joined.append(df.count())
        return ordered_concat(df, *args, **kwargs)

    monkeypatch.setattr(temporal, "ordered_concat", recorded)
    aligned = spark.createDataFrame(
        [(1, 0, 10.0, "s", "a"), (1, 1, 20.0, "s", "b"), (1, 2, 20.0, "s", None), (1, 3, 500.0, "s", "c"), (2, 0, 20.0, "s", "d")], ALIGNED
    )
    calls = [(i, 1, 15.0 + i / 100, 30.0) for i in range(200)] + [(200, 1, 20.0, 0.0), (201, 2, None, None), (202, 2, 20.0, 5.0)]
    got = {r.call_id: r.result for r in temporal.ocr_at(spark.createDataFrame(calls, LOOKUP), aligned).collect()}
    assert {got[i] for i in range(200)} == {"[00:10] a\n[00:20] b"}
    assert (got[200], got[201], got[202]) == ("[00:20] b", "[00:20] d", "[00:20] d")
    assert joined == [3 + 2 + 1]
