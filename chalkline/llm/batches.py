"""Adding columns to a table with a function over Arrow batches of texts."""

from __future__ import annotations

import ctypes
from collections.abc import Callable, Iterator, Sequence
from contextlib import contextmanager

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import StructField, StructType

#: Rows handed to a function at a time, so that what it holds stays small whatever the batch size is.
SLICE = 2000

TextFunction = Callable[[list[str]], Sequence[Sequence]]


def free_unused() -> None:
    """Give back to the system what Arrow and numpy have freed: a worker lives on after its task, beside the next one's."""
    pa.default_memory_pool().release_unused()
    trim = getattr(ctypes.CDLL(None), "malloc_trim", None)  # of the GNU C library
    if trim is not None:
        trim(0)


@contextmanager
def small_batches(spark: SparkSession, rows: int = 1000) -> Iterator[None]:
    """Jobs that run inside send Python workers so many rows at a time at most: a batch of whole texts is held several times, by
    the JVM and by the worker. The session's own setting comes back at the end."""
    name = "spark.sql.execution.arrow.maxRecordsPerBatch"
    before = spark.conf.get(name)
    spark.conf.set(name, str(min(rows, int(before)) if int(before) > 0 else rows))
    try:
        yield
    finally:
        spark.conf.set(name, before)


def with_text_columns(
    df: DataFrame, fields: list[StructField], make: Callable[[], TextFunction], text: str = "text"
) -> DataFrame:
    """``df`` with the columns ``fields``, computed from the text column by the function ``make()`` gives.

    ``make`` runs once per task. Its function takes a list of texts, null ones as empty, and
    returns one sequence per field. Columns of ``df`` with the names of new ones are replaced; all others
    pass through unchanged. There is no shuffle.
    """
    names = [f.name for f in fields]
    base = df.drop(*names)
    schema = StructType([*base.schema.fields, *fields])
    position = base.columns.index(text)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark.sql.pandas.types import to_arrow_type

        types = [to_arrow_type(f.dataType) for f in fields]
        work = make()
        for batch in batches:
            for at in range(0, batch.num_rows, SLICE):
                part = batch.slice(at, SLICE)
                texts = [t or "" for t in part.column(position).to_pylist()]
                new = [pa.array(values, type=kind) for values, kind in zip(work(texts), types)]
                yield pa.RecordBatch.from_arrays([*part.columns, *new], names=[*part.schema.names, *names])
            free_unused()

    return base.mapInArrow(run, schema)


def least_hashes(df: DataFrame, place: Column, most: int) -> int:
    """A bound that at most ``most`` rows of ``df`` have hashes (``place``, a bigint hash of a row) under or at.

    It is the hash of that rank. Hashes that are far above it, going by the number of rows, are left out before
    they are ranked, so what meets in one task stays small for any number of rows and tasks. Where equal hashes cross the rank, as of
    rows that are repeated, all of them stay out.
    """
    total = df.count()
    if total <= most:
        return 2**63 - 1
    far = -(2**63) + min(2**64 - 1, (4 * most + 100) * 2**64 // total)
    hashes = df.select(place.alias("h")).where(F.col("h") <= far)
    ranked = hashes.groupBy("h").count().orderBy("h").limit(most + 1).collect()
    low, held = -(2**63), 0
    for r in ranked:
        held += r["count"]
        if held > most:
            break
        low = r.h
    return low
