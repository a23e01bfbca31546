"""Files in, files out, versioned tables and the streaming forms."""

import json
import random

import pytest
from pyspark.sql import functions as F

from chalkline.operators import change, temporal
from chalkline.session import scratch, shared_dir, written
from chalkline.sources import keyed, readers, writers
from chalkline.streaming import jobs


def test_transcripts(spark, tmp_path):
    (tmp_path / "my lecture.txt").write_text("a\nb é\n", encoding="utf-8")
    assert [tuple(r) for r in readers.read_transcripts(spark, str(tmp_path)).collect()] == [("my lecture", "a\nb é\n")]


def test_segments(spark, tmp_path):
    doc = {"language": "it", "source": "v.mp4", "segments": [{"id": 0, "start": 0, "end": 1.5, "text": "x"}, {"id": 1, "start": 2, "end": 3, "text": "y"}]}
    (tmp_path / "L1_segments.json").write_text(json.dumps(doc, indent=2))
    got = readers.read_segments(spark, str(tmp_path))
    assert [tuple(r) for r in got.orderBy("id").collect()] == [("L1", "it", "v.mp4", 0, 0.0, 1.5, "x"), ("L1", "it", "v.mp4", 1, 2.0, 3.0, "y")]
    out = shared_dir(spark, "test")
    writers.write_segments(got.withColumn("text", F.concat(F.lit(" "), "text")), out)
    assert sorted(map(tuple, readers.read_segments(spark, out, multiline=False).collect())) == sorted(map(tuple, got.collect()))


def test_ocr_frames(spark, tmp_path):
    record = {"frame_index": 0, "timestamp_sec": 1.0, "image_path": "a.jpg", "raw_text": "t", "blocks": [{"text": "t", "confidence": 0.5}], "is_slide": True}
    (tmp_path / "L_ocr.json").write_text(json.dumps([record, {**record, "frame_index": 1, "raw_text": " "}], indent=2))
    got = readers.read_ocr_frames(spark, str(tmp_path))
    assert [(r.lecture_id, r.frame_index, r.blocks[0].confidence) for r in got.orderBy("frame_index").collect()] == [("L", 0, 0.5), ("L", 1, 0.5)]
    out = shared_dir(spark, "test")
    writers.write_ocr_frames(got, out)
    assert [r.frame_index for r in readers.read_ocr_table(spark, out).collect()] == [0]


@pytest.mark.parametrize("change_record", [lambda r: {**r, "extra": 1}, lambda r: {k: v for k, v in r.items() if k != "is_slide"}])
def test_ocr_frames_are_strict(spark, tmp_path, change_record):
    record = {"frame_index": 0, "timestamp_sec": 1.0, "image_path": "a", "raw_text": "t", "blocks": [], "is_slide": True}
    (tmp_path / "L_ocr.json").write_text(json.dumps([change_record(record)]))
    with pytest.raises(Exception, match="missing or unknown"):
        readers.read_ocr_frames(spark, str(tmp_path)).collect()
    lines = tmp_path / "lines"
    lines.mkdir()
    (lines / "a.json").write_text(json.dumps({"lecture_id": "L", "frame": record}) + "\n")
    assert [r.raw_text for r in readers.read_ocr_frames(spark, str(lines), lines=True).collect()] == ["t"]
    (lines / "b.json").write_text(json.dumps({"lecture_id": "L", "frame": change_record(record)}) + "\n")
    with pytest.raises(Exception, match="missing or unknown"):
        readers.read_ocr_frames(spark, str(lines), lines=True).collect()


def test_catalogue_images_and_logs(spark, tmp_path):
    for name in ("08-10-2025_Control Systems.pdf", "x.txt", "f.jpg"):
        (tmp_path / name).write_text("content")
    assert [r.stem for r in readers.list_notes(spark, str(tmp_path)).collect()] == ["08-10-2025_Control Systems"]
    assert [r.image_path.rsplit("/", 1)[1] for r in readers.list_images(spark, str(tmp_path)).collect()] == ["f.jpg"]
    (tmp_path / "logs").mkdir()
    (tmp_path / "logs" / "b1.log").write_text("one\n! two\n")
    log = [tuple(r) for r in readers.read_log(spark, str(tmp_path / "logs")).collect()]
    assert log[:2] == [("b1", 0, "one"), ("b1", 1, "! two")]


def test_versions(spark):
    path = shared_dir(spark, "test")

    def run(version, *rows):
        writers.write_version(spark.createDataFrame(rows, "k string, o int, v string"), path, version, ["k"], ["o"])

    run(1, ("a", 1, "old"), ("a", 2, "new"), ("b", 1, "b"))
    run(2, ("a", 1, "second"))
    run(2, ("a", 1, "again"))
    read = lambda p: sorted((r.k, r.v) for r in writers.read_versions(spark, p, ["k"]).collect())
    assert read(path) == [("a", "again"), ("b", "b")]
    run(3, ("c", 1, "c"), ("b", 1, "newer"))
    writers.fold_versions(spark, path, 2, ["k"])
    assert read(path) == [("a", "again"), ("b", "newer"), ("c", "c")]
    for _ in range(2):  # also by a batch that is repeated
        writers.fold_versions(spark, path, 3, ["k"])
    run(4, ("c", 1, "last"))
    assert read(path) == [("a", "again"), ("b", "newer"), ("c", "last")]
    equal = spark.createDataFrame([("x", 1, "p"), ("x", 1, "q")], "k string, o int, v string")
    assert writers.latest_per_key(equal, ["k"], ["o"]).collect() == writers.latest_per_key(equal.orderBy("v"), ["k"], ["o"]).collect()


def test_figures_sink(spark):
    path = shared_dir(spark, "test")
    row = spark.createDataFrame([(1, 2.0, "f", "c", "r", "p")], "lecture_id bigint, timestamp_sec double, filename string, caption string, reason string, latex_path string")
    writers.write_figures(row, path)
    assert spark.read.json(path).head()["timestamp"] == 2.0


def stream_in_two_batches(spark, first, second, run):
    """Run once over ``first``, then again from the checkpoint over ``second``."""
    source, base = shared_dir(spark, "in"), shared_dir(spark, "run")
    for batch in (first, second):
        batch.coalesce(1).write.mode("append").parquet(source)
        run(spark.readStream.schema(first.schema).parquet(source), base)
    return base


def test_change_stream_takes_late_rows(spark):
    rows = lambda *x: spark.createDataFrame([(k, o, float(v)) for k, o, v in x], "lecture_id bigint, ord bigint, score double")
    first = rows((1, 2, 1), (1, 3, 1.1), (1, 9, 5), (2, 0, 3))
    second = rows((1, 10, 5.2), (1, 11, 9), (1, 5, 50), (1, 0, 4.5), (3, 7, 1), (2, 0, 3))  # late, earlier than all, repeated
    base = stream_in_two_batches(
        spark, first, second, lambda s, b: jobs.change_batches(s, 1.0, f"{b}/out", f"{b}/cp", block_rows=4).awaitTermination()
    )
    got = sorted(map(tuple, jobs.kept_changes(spark, f"{base}/out").select("lecture_id", "ord", "score").collect()))
    whole = first.union(second).distinct()
    assert got == sorted(map(tuple, change.change_points(whole, 1.0).select("lecture_id", "ord", "score").collect()))
    assert (1, 5, 50.0) in got and (1, 0, 4.5) in got


def test_change_stream_keeps_rows_without_a_lecture(spark):
    rows = lambda *x: spark.createDataFrame([(k, o, float(v)) for k, o, v in x], "lecture_id bigint, ord bigint, score double")
    named, far = [(1, 1), (2, 1.2), (5, 9), (6, 9.1), (9, 2)], 2**53 + 1
    first = rows(*((k, o, v) for k in (None, far) for o, v in named[1:4]))
    second = rows(*((k, o, v) for k in (None, far) for o, v in (named[0], named[4])))
    base = stream_in_two_batches(
        spark, first, second, lambda s, b: jobs.change_batches(s, 1.0, f"{b}/out", f"{b}/cp").awaitTermination()
    )
    got = jobs.kept_changes(spark, f"{base}/out").select("lecture_id", "ord", "score").collect()
    assert sorted(map(tuple, got), key=repr) == sorted([(k, o, float(v)) for k in (None, far) for o, v in ((1, 1), (5, 9), (9, 2))], key=repr)


def test_index_stream(spark):
    rows = lambda *x: spark.createDataFrame(x, "lecture_id bigint, course string, lecture_date string, source string, transcript string")
    first = rows((1, "C", "d", "transcript", "old"), (2, "C", "e", "transcript", "kept"))
    second = rows((3, "C", "d", "transcript", "new"))
    base = stream_in_two_batches(
        spark, first, second, lambda s, b: jobs.index_stream(s, f"{b}/index", f"{b}/cp").awaitTermination()
    )
    got = keyed.read_table(spark, f"{base}/index")
    assert sorted((r.id, r.document, len(r.embedding)) for r in got.collect()) == [
        ("C_d_transcript_0", "new", 64), ("C_e_transcript_0", "kept", 64)
    ]


def test_align_stream_takes_rows_in_any_order(spark):
    frame = "lecture_id bigint, frame_index int, timestamp_sec double, raw_text string, is_slide boolean, image_path string"
    segment = "lecture_id bigint, id int, start_sec double, end_sec double, text string"
    frames = [(k, i, i * 40.0, f"r{i}", False, f"p{i}") for k in (1, 2, 3, None) for i in range(30)]
    segments = [(k, i, i * 90.0, i * 90.0 + 5, f"t{i}") for k in (1, 2) for i in range(10)] + [(1, 50, 0.0, 9999.0, "all")]
    # lecture 2 comes whole a day late, lecture 1 gets its long segment and some early frames late, 3 has no speech
    late_frame = lambda f: f[0] == 2 or (f[0] == 1 and f[1] % 4 == 0)
    late_segment = lambda s: s[0] == 2 or s[1] >= 50
    parts = [([f for f in frames if late_frame(f) == late], [s for s in segments if late_segment(s) == late]) for late in (False, True)]
    sources = {name: shared_dir(spark, name) for name in ("frames", "segments", "run")}
    for some_frames, some_segments in parts:
        spark.createDataFrame(some_frames, frame).coalesce(1).write.mode("append").parquet(sources["frames"])
        spark.createDataFrame(some_segments, segment).coalesce(1).write.mode("append").parquet(sources["segments"])
        jobs.align_stream(
            spark.readStream.schema(frame).parquet(sources["frames"]), spark.readStream.schema(segment).parquet(sources["segments"]),
            f"{sources['run']}/out", f"{sources['run']}/cp",
        ).awaitTermination()
    want = temporal.align(spark.createDataFrame(frames, frame), spark.createDataFrame(segments, segment))
    got = jobs.aligned_frames(spark, f"{sources['run']}/out").select(*want.columns)
    assert sorted(map(tuple, got.collect()), key=repr) == sorted(map(tuple, want.collect()), key=repr)
    assert got.where("speech = ''").count() >= 30 and got.where("lecture_id IS NULL").count() == 30


def test_scopes_clean_up(spark, tmp_path):
    with scratch(spark, f"file://{tmp_path}"):
        inside = written(spark.range(5), "rows")
        assert inside.count() == 5 and list(tmp_path.rglob("*.parquet"))
    assert not list(tmp_path.rglob("*.parquet"))


def test_change_stream_equals_the_batch_form_at_every_step(spark):
    """Many small blocks, rows in random order, values replaced, and each batch repeated after a failure within it."""
    rng = random.Random(11)
    schema = "lecture_id bigint, ord bigint, score double"
    rows = [(k, o, float(rng.randrange(8))) for k in (None, 1, 2) for o in range(-20, 60)]
    rng.shuffle(rows)
    source, base, known = shared_dir(spark, "in"), shared_dir(spark, "run"), {}
    start = lambda: jobs.change_batches(
        spark.readStream.schema(schema).parquet(source), 2.0, f"{base}/out", f"{base}/cp", block_rows=8
    )
    for at in range(0, len(rows), 80):
        batch = rows[at : at + 80] + [(k, o, v + 3.0) for k, o, v in rows[max(0, at - 5) : at]]
        known |= {(k, o): v for k, o, v in batch}
        spark.createDataFrame(batch, schema).coalesce(1).write.mode("append").parquet(source)
        with pytest.MonkeyPatch.context() as patch:
            patch.setattr(jobs, "kept_per_block", lambda *_: 1 / 0)  # fails when rows and blocks are already put in
            with pytest.raises(Exception, match="ZeroDivision"):
                start().awaitTermination()
        start().awaitTermination()
        whole = spark.createDataFrame([(-1 if k is None else k, o, v) for (k, o), v in known.items()], schema)
        want = {(None if r.lecture_id == -1 else r.lecture_id, r.ord, r.score) for r in change.change_points(whole, 2.0).collect()}
        got = [tuple(r) for r in jobs.kept_changes(spark, f"{base}/out").select("lecture_id", "ord", "score").collect()]
        assert len(got) == len(set(got)) and set(got) == want


def test_change_stream_reads_and_rewrites_what_a_batch_changes(spark):
    """A late row of one lecture: other blocks' buckets stay as they are and are not opened."""
    schema = "lecture_id bigint, ord bigint, score double"
    base, source = shared_dir(spark, "run"), shared_dir(spark, "in")
    first = [(k, o, float(o % 32)) for k in range(40) for o in range(64)]
    states = []
    for rows in (first, [(7, 20, 30.0)]):
        spark.createDataFrame(rows, schema).coalesce(1).write.mode("append").parquet(source)
        stream = spark.readStream.schema(schema).parquet(source)
        jobs.change_batches(stream, 1.0, f"{base}/out", f"{base}/cp", block_rows=16).awaitTermination()
        states.append({n: keyed.snapshot(spark, f"{base}/out/{n}") for n in ("rows", "kept")})
    touched = spark.createDataFrame([('{"lecture_id":7}', 1)], "lecture_id string, _block bigint")
    for name in ("rows", "kept"):
        before, after = (s[name] for s in states)
        assert before.rows == after.rows and len(before.files) > 8
        assert 0 < len(after.places - before.places) <= 2
        opened = keyed.read_matching(spark, f"{base}/out/{name}", before, touched).inputFiles()
        assert 0 < len(opened) <= 1


FRAME = "lecture_id bigint, frame_index int, timestamp_sec double, raw_text string, is_slide boolean, image_path string"
SEGMENT = "lecture_id bigint, id int, start_sec double, end_sec double, text string"


def align_batches(spark, batches):
    """Run the streaming alignment over (frames, segments) batch by batch; the folder of its tables after each."""
    sources = {name: shared_dir(spark, name) for name in ("frames", "segments", "run")}
    for frames, segments in batches:
        spark.createDataFrame(frames, FRAME).coalesce(1).write.mode("append").parquet(sources["frames"])
        spark.createDataFrame(segments, SEGMENT).coalesce(1).write.mode("append").parquet(sources["segments"])
        jobs.align_stream(
            spark.readStream.schema(FRAME).parquet(sources["frames"]), spark.readStream.schema(SEGMENT).parquet(sources["segments"]),
            f"{sources['run']}/out", f"{sources['run']}/cp",
        ).awaitTermination()
        yield f"{sources['run']}/out"


def test_align_stream_follows_frames_that_move(spark):
    """A frame comes again at another time, with and without a time, then speech reaches where it lay and where it lies."""
    frame = lambda i, t, text: (1, i, t, text, False, "p")
    speech = lambda i, t: (1, i, t, t + 5.0, f"t{i}")
    batches = [
        ([frame(0, 10.0, "a"), frame(1, 9000.0, "b"), frame(2, None, "c")], []),
        ([frame(0, 9000.0, "a2"), frame(1, None, "b2"), frame(2, 10.0, "c2")], [speech(0, 9001.0)]),
        ([], [speech(1, 9.0), speech(2, 8999.0), (1, 3, 0.0, 1e9, "all")]),
    ]
    frames, segments = {}, []
    for (new_frames, new_segments), path in zip(batches, align_batches(spark, batches)):
        frames |= {f[1]: f for f in new_frames}
        segments += new_segments
        want = temporal.align(spark.createDataFrame(list(frames.values()), FRAME), spark.createDataFrame(segments, SEGMENT))
        got = jobs.aligned_frames(spark, path).select(*want.columns)
        assert sorted(map(tuple, got.collect()), key=repr) == sorted(map(tuple, want.collect()), key=repr)


def test_align_stream_reads_and_rewrites_what_a_batch_touches(spark):
    """One late segment: frames and aligned rows of other stretches stay where they are."""
    frames = [(k, i, i * 400.0, f"r{i}", False, "p") for k in range(20) for i in range(40)]
    segments = [(k, i, i * 400.0, i * 400.0 + 5, f"t{i}") for k in range(20) for i in range(0, 40, 2)]
    states = []
    for path in align_batches(spark, [(frames, segments), ([], [(7, 99, 5200.0, 5205.0, "late")])]):
        states.append({n: keyed.snapshot(spark, f"{path}/{n}") for n in ("frames", "segments", "aligned")})
    before, after = states
    assert before["frames"].places == after["frames"].places and len(before["frames"].files) > 8
    for name in ("segments", "aligned"):
        assert 0 < len(after[name].places - before[name].places) <= 2 < len(before[name].files)
    row = jobs.aligned_frames(spark, path).where("lecture_id = 7 AND frame_index = 13").head()
    assert row.speech == "late" and after["aligned"].rows == len(frames)
