"""Benchmark items inside documents: size-partitioned MinHash containment search, verified exactly.

An item counts as contained if a document holds at least ``threshold`` of the item's distinct
word shingles, however long the document is. Of an item with n shingles a document may then miss fewer than
m = floor((1 - threshold) n) + 1, so one of the item's m least shingle hashes (its MinHash sketch) is among
the document's. Items are partitioned by size; a partition's sketch length follows from its largest size, so a
sketch is never too short and no contained item is missed. Documents that meet a sketch are then compared
with the item's shingles themselves.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from chalkline.session import written

SHINGLE = 5
THRESHOLD = 0.8


def words(text: str) -> Column:
    """Lower-cased runs of letters and digits; none for null."""
    found = F.split(F.lower(F.coalesce(text, F.lit(""))), r"[^\p{L}\p{N}]+")
    return F.filter(found, lambda w: w != "")


def _shingles(found: Column, size: int, of) -> Column:
    """``of`` a shingle's words, for each shingle; a shorter text is one shingle, an empty one none."""
    n = F.size(found)
    starts = F.when(n > 0, F.sequence(F.lit(1), F.greatest(n - (size - 1), F.lit(1)))).otherwise(F.array())
    return F.transform(starts, lambda i: of([F.get(found, i - 1 + k) for k in range(size)]))


def _hashes(found: Column, size: int) -> Column:
    return _shingles(found, size, lambda ws: F.xxhash64(*ws))


def _strings(found: Column, size: int) -> Column:
    return F.array_distinct(_shingles(found, size, lambda ws: F.concat_ws(" ", *ws)))


def item_shingles(items: DataFrame, size: int, text: str, item: str) -> DataFrame:
    """(item_id, shingle, n_shingles), distinct shingles of every item with words; one row per item_id and shingle.

    Rows that share an item_id are one item with the shingles of all of them."""
    cut = items.select(F.col(item).alias("item_id"), words(text).alias("w"))
    rows = cut.select("item_id", F.explode(_strings(F.col("w"), size)).alias("shingle")).distinct()
    sizes = rows.groupBy(F.col("item_id").alias("_item")).agg(F.count("*").alias("n_shingles"))
    return rows.join(sizes, F.col("item_id").eqNullSafe(F.col("_item"))).select("item_id", "shingle", "n_shingles")


def sketches(shingles: DataFrame, threshold: float) -> DataFrame:
    """(item_id, hash): of each item the least hashes, as many as its size partition needs."""
    hashed = shingles.select("item_id", "n_shingles", F.xxhash64(F.split("shingle", " ")).alias("hash"))
    # partitions end at powers of two
    largest = F.pow(F.lit(2), F.ceil(F.log2("n_shingles")))
    length = F.floor((1 - threshold) * largest + 1e-9).cast("int") + 1
    per_item = hashed.groupBy("item_id", length.alias("length")).agg(F.sort_array(F.collect_set("hash")).alias("hashes"))
    return per_item.select("item_id", F.explode(F.slice("hashes", F.lit(1), F.col("length"))).alias("hash"))


def contained_items(
    docs: DataFrame,
    items: DataFrame,
    size: int = SHINGLE,
    threshold: float = THRESHOLD,
    text: str = "text",
    key: str = "doc_id",
    item: str = "item_id",
) -> DataFrame:
    """(key, item_id, n_shared, n_shingles, containment): every item that a document contains.

    Shared and own shingles are counted as distinct word sequences. Texts are compared without case,
    punctuation and white space. A text of fewer words than a shingle is one shingle, so such an item
    is found only where that is the whole document; items and documents that are null or without words are
    never found. Rows that share a key count as one document, null keys included. Empty tables give no rows. Only the named
    columns are read.
    """
    # words are a column of their own: within a lambda they would be cut again for every shingle
    named = docs.select(F.col(key).alias("_doc"), words(text).alias("_words"))
    shingles = written(item_shingles(items, size, text, item), "item-shingles")
    probes = named.select("_doc", F.explode(_hashes(F.col("_words"), size)).alias("hash"))
    wanted = sketches(shingles, threshold)
    met = written(probes.join(wanted, "hash").select("_doc", "item_id").distinct(), "candidates")
    suspects = met.select(F.col("_doc").alias("_suspect")).distinct()
    held = (
        named.join(suspects, F.col("_doc").eqNullSafe(F.col("_suspect")), "left_semi")
        .select("_doc", F.explode(_strings(F.col("_words"), size)).alias("shingle"))
    )
    # an item's shingles are joined before the candidates, so a common shingle meets the items only
    same = held.join(shingles, "shingle")
    shared = same.groupBy("_doc", "item_id", "n_shingles").agg(F.count_distinct("shingle").alias("n_shared"))
    verified = shared.withColumn("containment", F.col("n_shared") / F.col("n_shingles"))
    return verified.where(F.col("containment") >= threshold).select(
        F.col("_doc").alias(key), "item_id", "n_shared", "n_shingles", "containment"
    )
