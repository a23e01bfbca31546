"""Keyed tables that are kept up to date: rows lie in hash buckets of their keys (or of some of them), and a manifest
names the folder that holds each bucket.

A run puts its rows in by rewriting the buckets it touches and nothing else, then publishes the next manifest by
renaming one file. Readers follow one manifest from start to end, so they see a run whole or not at all, and what a
failed run left behind is never read. The number of buckets doubles with the table, which keeps a bucket a task's work.

Layout below the table's path: ``data/<folder>/_bucket=<b>/*.parquet`` and ``manifest/<number>.json``. There is one
writer at a time; readers may come at any time.
"""

from __future__ import annotations

import json
import uuid
from dataclasses import asdict, dataclass

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

from chalkline.operators.retrieval import latest_per_key
from chalkline.session import remove

BUCKET_ROWS = 65536
LEAST_BUCKETS = 16
KEEP_SNAPSHOTS = 3


@dataclass(frozen=True)
class Snapshot:
    """One state of a table. ``files`` has (bucket, folder, rows) for each bucket with rows; ``base`` is the number
    of the state that the run started from."""

    number: int
    run: int
    base: int | None
    keys: list[str]
    by: list[str]
    buckets: int
    schema: str
    files: list[tuple[int, str, int]]

    @property
    def rows(self) -> int:
        return sum(rows for _, _, rows in self.files)

    @property
    def places(self) -> set[tuple[int, str]]:
        return {(bucket, folder) for bucket, folder, _ in self.files}


def _located(spark: SparkSession, path: str):
    target = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    return target.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()), target


def _names(spark: SparkSession, path: str) -> list[str]:
    files, folder = _located(spark, path)
    return [s.getPath().getName() for s in files.listStatus(folder)] if files.exists(folder) else []


def snapshots(spark: SparkSession, path: str) -> list[int]:
    """The numbers of the states that can be read, oldest first."""
    names = _names(spark, f"{path}/manifest")
    return sorted(int(n.removesuffix(".json")) for n in names if n.endswith(".json") and n[:1].isdigit())


def snapshot(spark: SparkSession, path: str, number: int | None = None) -> Snapshot | None:
    """A state of the table, the newest by default; None if there is no table yet."""
    if number is None:
        number = max(snapshots(spark, path), default=None)
        if number is None:
            return None
    files, target = _located(spark, _manifest(path, number))
    stream = files.open(target)
    try:
        stored = json.loads(spark.sparkContext._jvm.org.apache.commons.io.IOUtils.toString(stream, "UTF-8"))
    finally:
        stream.close()
    return Snapshot(**{**stored, "files": [tuple(f) for f in stored["files"]]})


def state_before(spark: SparkSession, path: str, run: int) -> Snapshot | None:
    """The state that a run starts from, also if that run is repeated; None if there is none."""
    head = snapshot(spark, path)
    if head is not None and run < head.run:
        raise ValueError(f"{path}: run {run} comes after run {head.run}")
    if head is None or run > head.run:
        return head
    return None if head.base is None else snapshot(spark, path, head.base)


def _manifest(path: str, number: int) -> str:
    return f"{path}/manifest/{number:010d}.json"


def _publish(spark: SparkSession, path: str, state: Snapshot) -> None:
    """Make a state the newest, in one step: its manifest gets its name when it is complete."""
    files, draft = _located(spark, f"{path}/manifest/draft-{uuid.uuid4().hex}")
    target = _located(spark, _manifest(path, state.number))[1]
    stream = files.create(draft, False)
    stream.write(bytearray(json.dumps(asdict(state)).encode()))
    stream.close()
    if files.exists(target) or not files.rename(draft, target):
        files.delete(draft, False)
        raise RuntimeError(f"{path}: another run published state {state.number}")


def _schema(state: Snapshot) -> StructType:
    return StructType.fromJson(json.loads(state.schema))


def _read(spark: SparkSession, path: str, state: Snapshot, places: set[tuple[int, str]]) -> DataFrame:
    if not places:
        return spark.createDataFrame([], _schema(state))
    return spark.read.schema(_schema(state)).parquet(*(f"{path}/data/{folder}/_bucket={b}" for b, folder in sorted(places)))


def read_table(spark: SparkSession, path: str, number: int | None = None) -> DataFrame:
    """The table as one state has it, the newest by default. Runs that come later do not change what is read; the
    files of a state last until ``KEEP_SNAPSHOTS`` newer ones are published."""
    state = snapshot(spark, path, number)
    if state is None:
        raise FileNotFoundError(f"no keyed table at {path}")
    return _read(spark, path, state, state.places)


def _bucket(by: list[str], buckets: int) -> Column:
    return F.pmod(F.xxhash64(*by), F.lit(buckets)).cast("int")


def read_matching(spark: SparkSession, path: str, state: Snapshot, wanted: DataFrame) -> DataFrame:
    """The rows of a state whose bucket columns, null ones too, occur in ``wanted``. Only the buckets they fall in are read."""
    types = _schema(state)
    wanted = wanted.select(*(F.col(c).cast(types[c].dataType).alias(c) for c in state.by))  # a hash depends on the type
    asked = wanted.toDF(*(f"_w_{c}" for c in state.by)).distinct()
    # at most as many as there are buckets
    numbers = {r[0] for r in wanted.select(_bucket(state.by, state.buckets)).distinct().collect()}
    rows = _read(spark, path, state, {p for p in state.places if p[0] in numbers})
    return rows.join(asked, [F.col(c).eqNullSafe(F.col(f"_w_{c}")) for c in state.by], "left_semi")


def upsert(
    df: DataFrame, path: str, run: int, keys: list[str], order: list[str], by: list[str] | None = None,
    bucket_rows: int = BUCKET_ROWS,
) -> Snapshot:
    """Put the rows of a run into the table at ``path``, which the first run creates.

    A row replaces that of the same keys; keys that the run does not name remain. Null keys are keys like others. Of a
    run's own rows with equal keys the one greatest in ``order`` counts, as in ``latest_per_key``. Repeating the newest
    run starts again from the state before it, so that run counts once; a run older than the newest is refused. An
    empty run publishes the same rows. Columns must be the table's, in any order, and are cast to its types. ``by`` names the keys that buckets are
    made of, all by default; with fewer, rows that agree in them lie together and can be read together.
    """
    spark, by = df.sparkSession, by or keys
    head, base = snapshot(spark, path), state_before(spark, path, run)
    if base is not None:
        types = _schema(base)
        fields = types.fieldNames()
        if sorted(fields) != sorted(df.columns) or (base.keys, base.by) != (keys, by):
            raise ValueError(f"{path}: the table has columns {fields} and keys {base.keys}")
        df = df.select(*(F.col(f.name).cast(f.dataType).alias(f.name) for f in types))

    staged = f"{path}/data/staged-{uuid.uuid4().hex}"
    latest_per_key(df, keys, order).write.parquet(staged)
    batch = spark.read.schema(df.schema).parquet(staged)
    buckets = base.buckets if base is not None else LEAST_BUCKETS
    sizes = {r[0]: r[1] for r in batch.groupBy(_bucket(by, buckets)).count().collect()}  # a row per bucket at most
    count = sum(sizes.values())
    while count + (base.rows if base is not None else 0) > buckets * bucket_rows:
        buckets *= 2
    grown = base is not None and buckets > base.buckets
    old = {f for f in base.files if grown or f[0] in sizes} if base is not None else set()

    merged = batch.withColumn("_new", F.lit(True))
    if old:
        before = _read(spark, path, base, {(b, folder) for b, folder, _ in old})
        merged = merged.unionByName(before.withColumn("_new", F.lit(False)))
    folder = f"{run}-{uuid.uuid4().hex}"
    files = [f for f in base.files if f not in old] if base is not None else []
    if count or old:
        # dealt by bucket once; the ranking by keys and the write keep that partitioning
        dealt = merged.withColumn("_bucket", _bucket(by, buckets)).repartition("_bucket")
        rows = latest_per_key(dealt, ["_bucket", *keys], ["_new"]).drop("_new")
        rows.write.partitionBy("_bucket").parquet(f"{path}/data/{folder}")
        written = spark.read.parquet(f"{path}/data/{folder}").groupBy("_bucket").count().collect()
        files += [(r["_bucket"], folder, r["count"]) for r in written]
    state = Snapshot(
        (head.number if head is not None else 0) + 1, run, base.number if base is not None else None, keys, by, buckets,
        df.schema.json(), sorted(files),
    )
    _publish(spark, path, state)
    remove(spark, staged)
    _clean(spark, path, state)
    return state


def _clean(spark: SparkSession, path: str, newest: Snapshot) -> None:
    """Remove states beyond those kept, the buckets only they name, and what failed runs left."""
    numbers = snapshots(spark, path)
    kept = {newest.number: newest} | {
        n: snapshot(spark, path, n) for n in numbers if n in numbers[-KEEP_SNAPSHOTS:] or n == newest.base
    }
    alive = set().union(*(s.places for s in kept.values()))
    folders = {folder for _, folder in alive}
    for n in numbers:
        if n not in kept:
            dead = snapshot(spark, path, n).places - alive
            remove(spark, _manifest(path, n))
            for b, folder in dead:
                if folder in folders:
                    remove(spark, f"{path}/data/{folder}/_bucket={b}")
    for folder in _names(spark, f"{path}/data"):
        if folder not in folders:
            remove(spark, f"{path}/data/{folder}")
