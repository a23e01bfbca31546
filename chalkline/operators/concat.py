"""Ordered string concatenation per group, in two bounded levels."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def ordered_concat(
    df: DataFrame, keys: list[str], order: list[str], text: str, sep: str, bucket: Column, name: str,
    keep_empty: bool = False,
) -> DataFrame:
    """Join ``text`` per ``keys`` in ``order`` with ``sep``; null texts are left out.

    ``bucket`` must not decrease along ``order``. Rows are first sorted and joined within
    (keys, bucket), which spreads a hot group over many tasks, and only the joined pieces meet
    in the group's final row. A group of null texts only has no row, or ``''`` with ``keep_empty``.
    """
    rows = df if keep_empty else df.where(F.col(text).isNotNull())
    joined = F.when(F.col("_n") > 0, F.array_join(F.col("_rows._text"), sep))
    pieces = (
        rows.select(*keys, bucket.alias("_bucket"), F.struct(*order, F.col(text).alias("_text")).alias("_row"))
        .groupBy(*keys, "_bucket")
        .agg(F.sort_array(F.collect_list("_row")).alias("_rows"), F.count("_row._text").alias("_n"))
        .select(*keys, F.struct("_bucket", joined.alias("_text")).alias("_piece"))
    )
    return (
        pieces.groupBy(*keys)
        .agg(F.sort_array(F.collect_list("_piece")).alias("_pieces"))
        .select(*keys, F.array_join(F.col("_pieces._text"), sep).alias(name))
    )
