"""Best-fit packing of documents into bins under conflicts.

A bin holds at most one document of a source and one of a duplicate cluster. Documents are dealt to shards by
hash, whatever their source, and each shard is packed from its largest document down: open bins are ordered by what
is left in them, and the search starts at the tightest bin that has room and goes on through its
successors until one has neither the document's source nor its cluster in its bitmaps.
"""

from __future__ import annotations

from bisect import insort

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

CAPACITY = 8192
SHARD_DOCS = 2048


def best_fit(sizes: list[int], sources: list[int], clusters: list[int], capacity: int) -> list[tuple[int, int]]:
    """(bin, offset) per item, for items in the order given.

    ``sources`` and ``clusters`` are small numbers, -1 for none (no conflict). Bins of equal residual are tried by
    their numbers.
    """
    bins: list[tuple[int, int]] = []  # bitmaps of a bin
    by_residual: dict[int, list[int]] = {}
    filled = 0  # bit r: some open bin has residual r
    out = []
    for size, source, cluster in zip(sizes, sources, clusters):
        has = (1 << source if source >= 0 else 0, 1 << cluster if cluster >= 0 else 0)
        rest, residual, found = filled >> size, size, -1
        while rest:
            step = (rest & -rest).bit_length() - 1
            residual += step
            for at, number in enumerate(by_residual[residual]):
                if not (bins[number][0] & has[0] or bins[number][1] & has[1]):
                    found = number
                    break
            if found >= 0:
                break
            residual += 1
            rest >>= step + 1
        if found < 0:
            found, residual = len(bins), capacity
            bins.append((0, 0))
        else:
            same = by_residual[residual]
            del same[at]
            if not same:
                del by_residual[residual]
                filled &= ~(1 << residual)
        out.append((found, capacity - residual))
        bins[found] = (bins[found][0] | has[0], bins[found][1] | has[1])
        left = residual - size
        if left not in by_residual:
            by_residual[left] = []
            filled |= 1 << left
        insort(by_residual[left], found)
    return out


def pack(
    docs: DataFrame,
    size: str = "size",
    source: str = "source",
    cluster: str = "cluster",
    key: str = "doc_id",
    capacity: int = CAPACITY,
    shard_docs: int = SHARD_DOCS,
) -> DataFrame:
    """(key, piece, piece_offset, size, shard, bin, bin_offset) for every piece of every document.

    A document longer than ``capacity`` is cut: its full pieces fill bins of their own (their bins are
    numbered after the shard's shared ones), and the rest is packed like any other document. Nothing is dropped: a
    document of size 0 (or null, which counts as 0) is one piece of size 0 and takes part in
    conflicts. A null source or cluster conflicts with nothing. Repeated rows are packed each for itself;
    without a cluster they do not conflict unless their source does. Equal sizes are taken in the order of keys
    (null first). Other columns are ignored. The number of shards follows the number of documents, so
    a shard stays at about ``shard_docs`` rows without texts.
    """
    rows = docs.select(
        F.col(key).alias("key"), F.coalesce(F.col(size), F.lit(0)).cast("long").alias("size"),
        F.col(source).cast("string").alias("source"), F.col(cluster).cast("string").alias("cluster"),
    )
    shards = max(1, -(-docs.select(key).count() // shard_docs))
    # equal rows are numbered, so that they spread, and a row's shard depends on nothing but the rows
    what = ["key", "size", "source", "cluster"]
    counted = rows.groupBy(*what).agg(F.count("*").alias("_rows"))
    numbered = counted.withColumn("_no", F.explode(F.sequence(F.lit(1).cast("long"), F.col("_rows"))))
    dealt = numbered.select(*what, F.pmod(F.xxhash64(*what, "_no"), F.lit(shards)).cast("long").alias("shard"))
    names = ["key", "piece", "piece_offset", "size", "shard", "bin", "bin_offset"]

    def fill(table: pa.Table) -> pa.Table:
        keys, sizes, sources, clusters, shard = (c.to_pylist() for c in table.columns)
        order = sorted(range(len(keys)), key=lambda i: (keys[i] is not None, keys[i] or 0, sizes[i]))
        order.sort(key=lambda i: -(sizes[i] % capacity))
        small = [i for i in order if sizes[i] % capacity or not sizes[i]]
        codes = [pd.factorize(np.array([c[i] for i in small], object))[0].tolist() for c in (sources, clusters)]
        placed = best_fit([sizes[i] % capacity for i in small], *codes, capacity)
        rows = [
            (keys[i], sizes[i] // capacity, sizes[i] - sizes[i] % capacity, sizes[i] % capacity, shard[i], *place)
            for i, place in zip(small, placed)
        ]
        number = 1 + max((b for b, _ in placed), default=-1)
        for i in order:
            for piece in range(sizes[i] // capacity):
                rows.append((keys[i], piece, piece * capacity, capacity, shard[i], number, 0))
                number += 1
        return pa.table([pa.array(c, pa.int64()) for c in zip(*rows)], names)

    packed = dealt.groupBy("shard").applyInArrow(fill, ", ".join(f"{n} long" for n in names))
    return packed.withColumnRenamed("key", key)
