"""Keyed tables: rows against a dictionary, what a run rewrites, what readers see, what is removed."""

import random
from pathlib import Path

import pytest
from pyspark.sql import functions as F

from chalkline.operators import retrieval
from chalkline.session import shared_dir
from chalkline.sources import keyed, writers

SCHEMA = "c string, k bigint, at int, text string"
KEYS = ["c", "k"]


def put(spark, path, run, rows, **more):
    return keyed.upsert(spark.createDataFrame(rows, SCHEMA), path, run, KEYS, ["at"], **more)


def read(spark, path, number=None):
    return sorted(map(tuple, keyed.read_table(spark, path, number).collect()), key=repr)


def folders(path):
    """Bucket folders on disk, and everything else below ``data``."""
    data = Path(path.removeprefix("file://")) / "data"
    return {(int(p.name.partition("=")[2]), p.parent.name) for p in data.glob("*/_bucket=*")}, {p.name for p in data.iterdir()}


def test_rows_are_those_of_a_dictionary(spark):
    path, rng, want, numbers = shared_dir(spark, "keyed"), random.Random(5), {}, []
    for run in range(4):
        rows = [
            (rng.choice(["a", "b", "hot", "hot", None]), rng.choice([None, *range(40)]), rng.randrange(3), f"{run} {i}")
            for i in range(60)
        ]
        rows = list({(c, k, at): (c, k, at, text) for c, k, at, text in rows}.values())  # no ties in ``at``
        state = put(spark, path, run, rows + rows, bucket_rows=4)  # repeated rows; the table grows on the way
        for row in sorted(rows, key=lambda r: r[2]):
            want[row[:2]] = row
        assert read(spark, path) == sorted(want.values(), key=repr)
        assert state.rows == len(want) and state.rows <= state.buckets * 4
        numbers.append(state.buckets)
    assert numbers == sorted(numbers) and numbers[-1] > keyed.LEAST_BUCKETS
    alive = set().union(*(keyed.snapshot(spark, path, n).places for n in keyed.snapshots(spark, path)))
    assert folders(path) == (alive, {folder for _, folder in alive})


def test_equal_rows_give_one_whatever_their_order(spark):
    tied = [("a", 1, 0, "p"), ("a", 1, 0, "q")]
    got = []
    for rows in (tied, tied[::-1]):
        path = shared_dir(spark, "keyed")
        put(spark, path, 0, rows)
        got.append(read(spark, path))
    assert got[0] == got[1] and len(got[0]) == 1


def test_a_run_counts_once(spark):
    path = shared_dir(spark, "keyed")
    put(spark, path, 0, [("a", 1, 0, "old"), ("a", 2, 0, "kept")])
    put(spark, path, 1, [("a", 1, 0, "first try"), ("a", 3, 0, "only in the first try")])
    for _ in range(keyed.KEEP_SNAPSHOTS + 1):  # the state it starts from stays
        put(spark, path, 1, [("a", 1, 0, "new")])
    assert read(spark, path) == [("a", 1, 0, "new"), ("a", 2, 0, "kept")]
    with pytest.raises(ValueError, match="comes after"):
        put(spark, path, 0, [("a", 1, 0, "old")])
    again = shared_dir(spark, "keyed")
    for text in "xy":
        put(spark, again, 0, [("a", len(text), 0, text)])
    assert read(spark, again) == [("a", 1, 0, "y")]


def test_empty_runs_and_tables(spark):
    path = shared_dir(spark, "keyed")
    with pytest.raises(FileNotFoundError):
        keyed.read_table(spark, path)
    put(spark, path, 0, [])
    assert read(spark, path) == [] and keyed.read_table(spark, path).columns == ["c", "k", "at", "text"]
    put(spark, path, 1, [("a", 1, 0, "x")])
    put(spark, path, 2, [])
    assert read(spark, path) == [("a", 1, 0, "x")]
    other = spark.createDataFrame([("a", 1)], "c string, k bigint")
    with pytest.raises(ValueError, match="columns"):
        keyed.upsert(other, path, 3, KEYS, ["k"])
    turned = spark.createDataFrame([("y", 0, 1, "a")], "text string, at int, k int, c string")  # int for bigint hashes otherwise
    keyed.upsert(turned, path, 3, KEYS, ["at"])
    assert read(spark, path) == [("a", 1, 0, "y")]


def test_a_lecture_rewrites_the_buckets_of_its_chunks(spark):
    lecture = "lecture_id bigint, course string, lecture_date string, source string, transcript string"
    rows = [(i, f"C{i % 3}", f"day {i}", "transcript", "some words " * 400) for i in range(60)]
    path = shared_dir(spark, "index")

    def index(run, rows):
        chunks = retrieval.index_chunks(spark.createDataFrame(rows, lecture), 100, 0)
        return chunks.count(), keyed.upsert(chunks, path, run, ["collection", "id"], ["lecture_id"], bucket_rows=8)

    _, before = index(0, rows)
    chunks, after = index(1, [(7, "C1", "day 7", "transcript", "other words " * 150)])
    fresh = after.places - before.places
    assert len(before.files) > 5 * chunks and 0 < len(fresh) <= chunks == 3
    assert before.places - after.places == {p for p in before.places if p[0] in {b for b, _ in fresh}}
    assert after.rows == before.rows


def test_readers_see_a_run_whole_or_not_at_all(spark, monkeypatch):
    path = shared_dir(spark, "keyed")
    first = put(spark, path, 0, [("a", i, 0, "old") for i in range(50)])
    pinned = keyed.read_table(spark, path, first.number)

    def lost(*_):
        raise OSError("the driver is lost before the manifest is named")

    with monkeypatch.context() as patch:
        patch.setattr(keyed, "_publish", lost)
        with pytest.raises(OSError):
            put(spark, path, 1, [("a", 1, 0, "half"), ("b", 1, 0, "half")])
    assert {r[3] for r in read(spark, path)} == {"old"}
    assert folders(path)[1] > {folder for _, folder in first.places}  # it did write its rows
    second = put(spark, path, 1, [("a", 1, 0, "new")])
    assert pinned.where("text = 'old'").count() == 50 == pinned.count()
    assert [r[3] for r in read(spark, path) if r[1] == 1] == ["new"]
    assert folders(path)[1] == {folder for _, folder in first.places | second.places}
    with pytest.raises(RuntimeError, match="another run"):
        keyed._publish(spark, path, second)
    for run in range(2, 2 + keyed.KEEP_SNAPSHOTS):
        put(spark, path, run, [("a", 1, run, "newer")])
    assert first.number not in keyed.snapshots(spark, path)


def test_rows_are_shuffled_by_bucket_once(spark):
    """Beside the ranking of the run's own rows there is one exchange: the rank and the write use the same buckets."""
    rows = spark.createDataFrame([("a", 1, 0, "x", True)], SCHEMA + ", _new boolean")
    dealt = rows.withColumn("_bucket", F.pmod(F.xxhash64(*KEYS), F.lit(16)).cast("int")).repartition("_bucket")
    ranked = retrieval.latest_per_key(dealt, ["_bucket", *KEYS], ["_new"])
    assert ranked._jdf.queryExecution().executedPlan().toString().count("Exchange ") == 1


def test_half_written_versions_are_not_read(spark):
    path = shared_dir(spark, "versions")
    row = lambda text: spark.createDataFrame([("a", 1, 0, text)], SCHEMA)
    writers.write_version(row("whole"), path, 0, KEYS, ["at"])
    writers.write_version(row("half"), path, 1, KEYS, ["at"])
    (Path(path.removeprefix("file://")) / "version=1" / "_SUCCESS").unlink()
    assert [r.text for r in writers.read_versions(spark, path, KEYS).collect()] == ["whole"]
    with pytest.raises(FileNotFoundError):
        writers.read_versions(spark, f"{path}/none", KEYS)
