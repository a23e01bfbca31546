"""Where jobs may put intermediate tables and checkpoints."""

from __future__ import annotations

import uuid
from collections.abc import Iterator
from contextlib import contextmanager

from pyspark.sql import DataFrame, SparkSession

_SETTING = "spark.checkpoint.dir"
_scopes: list[str] = []  # folders of open scopes, the innermost last


def shared_root(spark: SparkSession) -> str:
    """The folder that all executors share: the open scope's, or the one ``spark.checkpoint.dir`` names, or else the
    warehouse."""
    if _scopes:
        return _scopes[-1]
    return (spark.conf.get(_SETTING, None) or spark.conf.get("spark.sql.warehouse.dir")).rstrip("/")


def shared_dir(spark: SparkSession, purpose: str) -> str:
    """A fresh directory for intermediate data below the shared folder."""
    return f"{shared_root(spark)}/chalkline/{purpose}-{uuid.uuid4().hex}"


def written(df: DataFrame, purpose: str) -> DataFrame:
    """Cut the lineage of ``df`` through a table in the shared folder."""
    spark = df.sparkSession
    path = shared_dir(spark, purpose)
    df.write.parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def remove(spark: SparkSession, path: str) -> None:
    """Delete a folder of intermediate data through the file system it lies in."""
    jvm = spark.sparkContext._jvm
    target = jvm.org.apache.hadoop.fs.Path(path)
    target.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(target, True)


@contextmanager
def scratch(spark: SparkSession, folder: str | None = None) -> Iterator[str]:
    """Everything operators write inside the scope goes below one folder, which is removed at its end.

    Results must be read or written inside the scope. ``folder`` defaults to a fresh one in the shared folder.
    """
    own = f"{(folder or shared_root(spark)).rstrip('/')}/scope-{uuid.uuid4().hex}"
    _scopes.append(own)
    try:
        yield own
    finally:
        _scopes.remove(own)
        remove(spark, own)
