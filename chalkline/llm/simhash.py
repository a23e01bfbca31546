"""SimHash fingerprints and near-duplicate classes from pivot distance tables.

Two fingerprints that differ in at most r bits have distances to any reference fingerprint that
differ by at most r. Each fingerprint therefore carries its distances to a set of references. Inside
a bucket, rows are swept in the order of the first distance while it stays within r, pairs whose
largest coordinate difference passes r are discarded, and the survivors are verified on all 64
bits.

Distances to references of random bits alone are too much alike to cut down all pairs of a corpus,
so buckets come from the bits themselves: of r + 2 runs of bits at least two agree between
fingerprints with r differing bits, and every pair of runs is one bucket key. No link is lost.
"""

from __future__ import annotations

from collections.abc import Iterator
from itertools import combinations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import LongType, StructField

from chalkline.llm.batches import SLICE, free_unused, small_batches, with_text_columns
from chalkline.llm.components import connected
from chalkline.session import written

SHINGLE = 4
MAX_BITS = 4
SEED = 42
PIVOTS = 16
#: Buckets with more fingerprints are worked on in blocks of this size, two at a time.
BUCKET_ROWS = 16384


def fingerprint(text: str, shingle: int = SHINGLE) -> int:
    """The fingerprint of a text as a signed 64-bit number."""
    from xxhash import xxh64_intdigest

    words = text.encode().lower().split()  # of bytes: A-Z only, cut at ASCII white space only
    if not words:
        return 0
    n = max(1, len(words) - shingle + 1)
    hashes = np.fromiter((xxh64_intdigest(b" ".join(words[i : i + shingle]), SEED) for i in range(n)), np.uint64, n)
    # bytes side by side, so that bits are counted column by column
    bits = np.unpackbits(hashes.astype("<u8").view(np.uint8).reshape(n, 8), axis=1, bitorder="little")
    over = bits.sum(axis=0, dtype=np.int64) * 2 > n
    return int(np.packbits(over, bitorder="little").view("<i8")[0])


def with_fingerprints(docs: DataFrame, shingles: dict[str, int], text: str = "text") -> DataFrame:
    """``docs`` with a bigint fingerprint per entry of ``shingles`` (column name: words of a shingle).

    A bit is set if it is set in over half the shingle hashes. Words are cut at ASCII white space, A-Z are
    lower-cased, shingles count as often as they occur; a shorter text is one shingle, a text without words
    (or null) has fingerprint 0.
    """

    def make():
        return lambda texts: [[fingerprint(t, n) for t in texts] for n in shingles.values()]

    return with_text_columns(docs, [StructField(name, LongType()) for name in shingles], make, text)


def _prints(rows: DataFrame, shingles: dict[str, int]) -> DataFrame:
    """(key, fingerprints) of (key, text); texts do not come back from the tasks' workers."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for at in range(0, batch.num_rows, SLICE):
                part = batch.slice(at, SLICE)
                texts = [t or "" for t in part.column(1).to_pylist()]
                new = [pa.array([fingerprint(t, n) for t in texts], pa.int64()) for n in shingles.values()]
                yield pa.RecordBatch.from_arrays([part.column(0), *new], ["key", *shingles])
            free_unused()

    kind = rows.schema["key"].dataType.simpleString()
    return rows.mapInArrow(run, ", ".join([f"key {kind}", *(f"{name} long" for name in shingles)]))


def _keys(max_bits: int) -> Column:
    """The bucket keys of a fingerprint, one bigint per pair of bit runs: the pair's number above the bits."""
    runs = max_bits + 2
    edges = [64 * i // runs for i in range(runs + 1)]
    cut = [
        F.shiftrightunsigned("fp", edges[i]).bitwiseAND(F.lit((1 << (edges[i + 1] - edges[i])) - 1)) for i in range(runs)
    ]
    width = edges[1] + 1  # no run is longer
    return F.array(*(
        F.lit(k << (2 * width)) + F.shiftleft(cut[i], width) + cut[j] for k, (i, j) in enumerate(combinations(range(runs), 2))
    ))


def pivot_table(n: int = PIVOTS) -> np.ndarray:
    """The reference fingerprints: n pseudo-random numbers, always the same."""
    return np.random.default_rng(SEED).integers(-(2**63), 2**63, n, dtype=np.int64)


def pivot_distances(fp: np.ndarray, pivots: np.ndarray) -> np.ndarray:
    """The table of distances, a row per fingerprint and a column per pivot."""
    return np.bitwise_count((fp[:, None] ^ pivots[None, :]).view(np.uint64))


def _differ(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    return np.bitwise_count((a ^ b).view(np.uint64))


def _links(
    bucket: np.ndarray, prints: list[np.ndarray], table: np.ndarray, bits: list[int]
) -> np.ndarray:
    """Verified links (pairs of row numbers) among rows sorted by bucket and first distance, at most one less per
    bucket than it has rows: pairs that links before them connect are left out."""
    n = len(bucket)
    parent = list(range(n))

    def find(i: int) -> int:
        while parent[i] != i:
            parent[i] = i = parent[parent[i]]
        return i

    root, out = np.arange(n), []
    left, lag = np.arange(n), 0
    coordinates = table.astype(np.int16)
    while len(left):
        lag += 1
        left = left[left + lag < n]
        right = left + lag
        near = (bucket[left] == bucket[right]) & (coordinates[right, 0] - coordinates[left, 0] <= bits[0])
        left, right = left[near], right[near]  # sorted: who is out of reach now stays out
        apart = root[left] != root[right]
        i, j = left[apart], right[apart]
        for c in range(1, table.shape[1]):
            if len(i) < 64:
                break
            close = np.abs(coordinates[i, c] - coordinates[j, c]) <= bits[0]
            i, j = i[close], j[close]
        for values, most in zip(prints, bits):
            close = _differ(values[i], values[j]) <= most
            i, j = i[close], j[close]
        joined = False
        for a, b in zip(i.tolist(), j.tolist()):
            ra, rb = find(a), find(b)
            if ra != rb:
                parent[max(ra, rb)] = min(ra, rb)
                out.append((a, b))
                joined = True
        if joined:
            root = np.array(parent)
            while not np.array_equal(up := root[root], root):
                root = up
            parent = root.tolist()
    return np.array(out, np.int64).reshape(-1, 2)


def fingerprint_links(
    prints: DataFrame, max_bits: int = MAX_BITS, other_bits: int | None = None, bucket_rows: int = BUCKET_ROWS
) -> DataFrame:
    """(a, b): links between distinct rows of ``prints`` (fp, and other where ``other_bits`` is given).

    Two are linked if their fp differ in at most ``max_bits`` bits and their other fingerprints in at most
    ``other_bits``. Each bucket yields verified links that connect its classes, not all pairs. Buckets over ``bucket_rows``
    are dealt out as pairs of blocks, so a task never holds a whole hot bucket.
    """
    names = ["fp"] if other_bits is None else ["fp", "other"]
    bits = [max_bits] if other_bits is None else [max_bits, other_bits]
    pivots = pivot_table()
    keyed = prints.select(*names, F.explode(_keys(max_bits)).alias("bucket"))
    counts = keyed.groupBy("bucket").count().where(F.col("count") > bucket_rows)
    blocks = counts.select("bucket", F.ceil(F.col("count") * 2 / bucket_rows).alias("blocks"))
    n_blocks = F.coalesce("blocks", F.lit(1).cast("long"))
    own = F.pmod(F.xxhash64(*names), n_blocks)
    tasks = F.transform(
        F.sequence(F.lit(0).cast("long"), n_blocks - 1), lambda o: F.least(own, o) * F.lit(1 << 20) + F.greatest(own, o)
    )
    place = ["bucket", "block"]
    first = F.bit_count(F.col("fp").bitwiseXOR(F.lit(int(pivots[0]))))
    ordered = (
        keyed.join(blocks, "bucket", "left")
        .withColumn("block", F.explode(tasks))
        .select(*place, *names)
        .repartition(*place)
        .sortWithinPartitions(*place, first, *names)
    )

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: np.ndarray | None = None

        def links(rows: np.ndarray) -> pa.RecordBatch:
            fresh = np.append(True, (rows[:2, 1:] != rows[:2, :-1]).any(axis=0))
            values = list(rows[2:])
            at = _links(np.cumsum(fresh), values, pivot_distances(values[0], pivots), bits)
            ends = [v[at[:, side]] for side in (0, 1) for v in values]
            return pa.RecordBatch.from_arrays([pa.array(e) for e in ends], ends_named)

        for batch in batches:
            if not batch.num_rows:
                continue
            rows = np.stack([c.to_numpy(zero_copy_only=False) for c in batch.columns])
            rows = rows if held is None else np.concatenate([held, rows], axis=1)
            # the last bucket may go on in the next batch
            cut = int(np.flatnonzero((rows[:2] == rows[:2, -1:]).all(axis=0))[0])
            held = rows[:, cut:]
            if cut:
                yield links(rows[:, :cut])
        if held is not None and held.shape[1]:
            yield links(held)

    ends_named = [f"{side}_{n}" for side in "ab" for n in names]
    found = ordered.mapInArrow(run, ", ".join(f"{n} long" for n in ends_named))
    return found.select(*(_node(names, f"{side}_").alias(side) for side in "ab")).distinct()


def _node(names: list[str], prefix: str = "") -> Column:
    return F.struct(*(F.col(prefix + n).alias(n) for n in names)) if len(names) > 1 else F.col(prefix + names[0])


def with_components(
    docs: DataFrame,
    shingle: int = SHINGLE,
    max_bits: int = MAX_BITS,
    other_shingle: int | None = None,
    other_bits: int | None = None,
    text: str = "text",
    key: str = "doc_id",
) -> DataFrame:
    """(key, fp, component_id) per row: the smallest key reachable over links of fingerprints.

    With ``other_shingle`` a second fingerprint, over longer or shorter shingles, has to agree to ``other_bits``. Rows
    keep their number: repeated rows and null keys stay, each with its class. A class whose keys are all null
    has a null component_id. Texts that are null, empty or without words have fingerprint 0 and are linked
    like any other. Copies meet once, as one distinct fingerprint. Only key and text are read.
    """
    shingles = {"fp": shingle} if other_shingle is None else {"fp": shingle, "other": other_shingle}
    names = list(shingles)
    rows = docs.select(F.col(key).alias("key"), F.col(text).alias("text"))
    with small_batches(rows.sparkSession):
        prints = written(_prints(rows, shingles), "fingerprints")
    distinct = written(prints.groupBy(*names).agg(F.min("key").alias("least")), "distinct-fingerprints")
    roots = connected(fingerprint_links(distinct, max_bits, other_bits))
    rooted = distinct.withColumn("node", _node(names)).join(roots, "node", "left")
    rooted = rooted.withColumn("root", F.coalesce("root", "node"))
    least = rooted.groupBy("root").agg(F.min("least").alias("component_id"))
    classes = rooted.join(least, "root").select(*names, "component_id")
    return prints.join(classes, names, "left").select(F.col("key").alias(key), "fp", "component_id")


def hex_fingerprint(fp: Column) -> Column:
    """16 lowercase hex digits of a bigint fingerprint."""
    return F.lower(F.lpad(F.hex(fp), 16, "0"))
