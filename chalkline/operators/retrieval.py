"""Chunk index, vector retrieval within a collection, and the context text made from it."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.types import MapType, StringType, StructField, StructType

from chalkline import fixed_values as V
from chalkline.functions.text import collection_name, lecture_day, stem_date, word_prefix
from chalkline.functions.vectors import Embedding, hashed_embedding
from chalkline.functions.windows import window_step, word_windows
from chalkline.operators.concat import ordered_concat
from chalkline.session import written

QUERY_BLOCK_BYTES = 8 << 20
INDEX_BLOCK_BYTES = 32 << 20
#: Queries whose contexts are put together at a time, and bytes of the passages that a task holds for them.
PASSAGE_BLOCK_QUERIES, PASSAGE_BLOCK_BYTES = 2048, 32 << 20
#: Queries compared (and rows given contexts) at a time at most, and distances held at a time (a few arrays of so many numbers).
_SLICE, _DISTANCES = 256, 1 << 20


# --- index ----------------------------------------------------------------------------

def index_chunks(
    lectures: DataFrame,
    size: int = V.INDEX_CHUNK_WORDS,
    overlap: int = V.INDEX_OVERLAP_WORDS,
    embedding: Embedding | None = None,
) -> DataFrame:
    """Index rows of (lecture_id, course, lecture_date, source, transcript) rows."""
    keep = ["lecture_id", "course", "lecture_date", "source"]
    chunks = word_windows(lectures, "transcript", size, window_step(size, overlap), keep)
    rows = chunks.select(
        "lecture_id",
        F.concat_ws("_", "course", "lecture_date", "source", F.col("pos").cast("string")).alias("id"),
        collection_name("course").alias("collection"),
        "course",
        "lecture_date",
        lecture_day("lecture_date").alias("lecture_day"),
        "source",
        F.col("pos").alias("chunk_index"),
        F.col("chunk").alias("document"),
    )
    return rows if embedding is None else rows.withColumn("embedding", embedding(F.col("document")))


def latest_per_key(df: DataFrame, keys: list[str], order: list[str]) -> DataFrame:
    """The row with the greatest ``order`` per key; of rows with an equal one, that with the greatest hash.

    The rank is limited before the shuffle, so of a key's copies one per task travels.
    """
    columns = df.columns
    best = Window.partitionBy(*keys).orderBy(*(F.desc(c) for c in order), F.desc("_tie"))
    simple = [c for c in columns if not isinstance(df.schema[c].dataType, MapType)]
    ranked = df.withColumn("_tie", F.xxhash64(*simple)).withColumn("_rank", F.row_number().over(best))
    return ranked.where(F.col("_rank") == 1).select(*columns)


def upsert(base: DataFrame, batch: DataFrame, order: list[str], replace: bool = False) -> DataFrame:
    """``base`` with the rows of ``batch`` put in by ``id``; rows the batch does not name remain.

    A shorter re-indexed text therefore leaves its old tail chunks, unless ``replace`` first
    drops every old chunk of the same (course, lecture_date, source).
    """
    keys = ["course", "lecture_date", "source"] if replace else ["id"]
    named = batch.select("collection", *keys).distinct()
    kept = base.join(named, ["collection", *keys], "left_anti")
    return kept.unionByName(latest_per_key(batch, ["collection", "id"], order))


def index_lectures(lectures: DataFrame, embedding: Embedding | None = None) -> DataFrame:
    """The index of all lectures. Lectures with the same course, date and source share ids, and
    the one indexed last wins."""
    chunks = latest_per_key(index_chunks(lectures), ["collection", "id"], ["lecture_id"])
    return chunks.withColumn("embedding", (embedding or hashed_embedding())(F.col("document")))


def index_counts(lectures: DataFrame) -> DataFrame:
    """Chunks added per lecture."""
    return index_chunks(lectures).groupBy("lecture_id").agg(F.count("*").alias("chunks"))


def page_texts(pages: DataFrame) -> DataFrame:
    """Non-empty pages of a file in page order, separated by a blank line."""
    filled = pages.where(F.coalesce("text", F.lit("")) != "")
    return ordered_concat(
        filled, ["file_id"], ["page_no"], "text", "\n\n", F.floor(F.col("page_no") / 256), "transcript"
    )


def matching_files(files: DataFrame, course: str | Column) -> DataFrame:
    """Files whose stem contains the course name, whatever the case."""
    name = F.lit(course) if isinstance(course, str) else course
    return files.where(F.contains(F.lower("stem"), F.lower(name)))


def page_lectures(pages: DataFrame, files: DataFrame, course: str | Column) -> DataFrame:
    """Files of a course as rows to index: page texts with the date taken from the file name."""
    name = F.lit(course) if isinstance(course, str) else course
    chosen = matching_files(files, name).select("file_id", name.alias("course"), stem_date("stem").alias("lecture_date"))
    return page_texts(pages).join(chosen, "file_id").select(
        F.col("file_id").alias("lecture_id"), "course", "lecture_date", F.lit("pdf").alias("source"), "transcript"
    )


def collection_counts(index: DataFrame) -> DataFrame:
    return index.groupBy("collection").agg(F.count("*").alias("chunks"))


def indexed_courses(courses: DataFrame, index: DataFrame) -> DataFrame:
    """The rows of ``courses`` (course, ...) whose collection has at least one chunk."""
    held = index.select(F.col("collection").alias("_held"))
    return courses.join(held, collection_name("course") == F.col("_held"), "left_semi")


# --- nearest chunks -------------------------------------------------------------------

def _nearest(queries: pd.DataFrame, rows: pd.DataFrame, k: int) -> pd.DataFrame:
    """The k nearest rows of one block for each query of one block: squared distance, then id."""
    rows = rows.sort_values("id")
    x = np.stack(rows.pop("embedding").to_numpy()).astype(float, copy=False)  # in place of one array per row
    x_norms = (x**2).sum(axis=1)[None, :]
    dated = "before" in queries and "day" in rows
    k = min(k, len(rows))
    picks, owners, distances = [], [], []
    step = max(1, min(_SLICE, _DISTANCES // len(rows)))
    for at in range(0, len(queries), step):
        part = queries.iloc[at : at + step]
        q = np.stack(part["embedding"].to_numpy()).astype(float)
        d = np.round(np.maximum((q**2).sum(axis=1)[:, None] + x_norms - 2.0 * (q @ x.T), 0.0), 6)
        if dated:
            before = part["before"].to_numpy(dtype=float)[:, None]
            day = rows["day"].to_numpy(dtype=float)[None, :]
            d[~((day < before) | np.isnan(before))] = np.inf
        bound = np.partition(d, k - 1, axis=1)[:, k - 1]
        for i, row in enumerate(d):
            near = np.flatnonzero((row <= bound[i]) & np.isfinite(row))
            near = near[np.argsort(row[near], kind="stable")[:k]]
            picks.append(near)
            owners.append(np.full(len(near), at + i))
            distances.append(row[near])
    return pd.DataFrame(
        {"query_id": queries["query_id"].to_numpy()[np.concatenate(owners)],
         "id": rows["id"].to_numpy()[np.concatenate(picks)], "distance": np.concatenate(distances)}
    )


def vector_topk(queries: DataFrame, index: DataFrame, k: int = V.RETRIEVAL_TOP) -> DataFrame:
    """(query_id, collection, id, distance, rank) of the k nearest chunks in a query's collection.

    ``queries`` is (query_id, collection, embedding) and may carry ``before_day``, which leaves
    only chunks of earlier days and needs ``lecture_day`` on the index; ``index`` is (collection, id, embedding[, lecture_day]).

    Both sides of a collection are cut into blocks of bounded bytes and every pair of blocks is one piece
    of work, so a hot collection becomes many equal pieces. A piece gives at most k rows per query; pairs are
    never rows.
    """
    dated = "before_day" in queries.columns
    if dated and "lecture_day" not in index.columns:
        raise ValueError("queries have before_day, but the index has no lecture_day")
    asked = queries.select(
        "query_id", "collection", "embedding", *([F.unix_date("before_day").alias("before")] if dated else [])
    )
    rows = index.select("collection", "id", "embedding", *([F.unix_date("lecture_day").alias("day")] if dated else []))
    types = {f.name: f.dataType.simpleString() for f in [*asked.schema, *rows.schema]}
    out = f"query_id {types['query_id']}, collection {types['collection']}, id {types['id']}, distance double"

    def blocks_of(df: DataFrame, block_bytes: int, name: str) -> DataFrame:
        size = F.sum(8 * F.size("embedding") + 64)
        return df.groupBy("collection").agg(F.greatest(F.ceil(size / block_bytes), F.lit(1)).alias(name))

    grid = blocks_of(asked, QUERY_BLOCK_BYTES, "_nq").join(blocks_of(rows, INDEX_BLOCK_BYTES, "_ni"), "collection")

    def others(n: str) -> Column:
        return F.explode(F.sequence(F.lit(0).cast("bigint"), F.col(n) - 1))

    asked = asked.join(grid, "collection").withColumn(
        "_q", F.pmod(F.xxhash64("query_id"), F.col("_nq"))
    ).withColumn("_i", others("_ni")).drop("_nq", "_ni")
    rows = rows.join(grid, "collection").withColumn(
        "_i", F.pmod(F.xxhash64("id"), F.col("_ni"))
    ).withColumn("_q", others("_nq")).drop("_nq", "_ni")

    def meet(q: pd.DataFrame, x: pd.DataFrame) -> pd.DataFrame:
        if q.empty or x.empty:
            return pd.DataFrame({"query_id": [], "collection": [], "id": [], "distance": []})
        return _nearest(q, x, k).assign(collection=q["collection"].iloc[0])[
            ["query_id", "collection", "id", "distance"]
        ]

    # renamed afresh: both sides may come from one table
    asked, rows = asked.toDF(*asked.columns), rows.toDF(*rows.columns)
    near = (
        asked.groupBy("collection", "_q", "_i")
        .cogroup(rows.groupBy("collection", "_q", "_i"))
        .applyInPandas(meet, out)
    )
    best = Window.partitionBy("query_id").orderBy("distance", "id")
    return near.withColumn("rank", F.row_number().over(best)).where(F.col("rank") <= k)


def _passages(index: DataFrame) -> DataFrame:
    """(collection, id, _text): the passage of a chunk under its date and source; chunks that share an id are one passage."""
    block = F.format_string(V.CONTEXT_PASSAGE, "lecture_date", "source", "document").alias("_block")
    texts = index.select("collection", "id", block).groupBy("collection", "id").agg(F.sort_array(F.collect_list("_block")).alias("_blocks"))
    return texts.select("collection", "id", F.array_join("_blocks", V.BLOCK_SEPARATOR).alias("_text"))


def _placed(found: DataFrame, index: DataFrame) -> DataFrame:
    """``found`` (query_id, collection, id, rank) with the block that a query is put in.

    Queries of one collection (that of the nearest passage) share blocks: a bounded number of queries to a block, and fewer where
    its passages would take up more than a bounded number of bytes.
    """
    nearest = F.col("rank") == 1
    homed = found.join(found.where(nearest).select("query_id", F.col("collection").alias("_home")), "query_id")
    uses = homed.groupBy("_home", "collection", "id").agg(F.count("*").alias("_uses"), F.count_if(nearest).alias("_queries"))
    size = F.sum(F.coalesce(F.octet_length("document"), F.lit(0)).cast("long") + 64).alias("_size")
    sized = uses.join(index.groupBy("collection", "id").agg(size), ["collection", "id"])
    by_queries = F.ceil(F.sum("_queries") / PASSAGE_BLOCK_QUERIES)
    by_bytes = F.ceil(F.sum(F.col("_size") * F.col("_uses")) / PASSAGE_BLOCK_BYTES)
    by_bytes = F.when(F.sum("_size") > PASSAGE_BLOCK_BYTES, by_bytes).otherwise(1)
    grid = sized.groupBy("_home").agg(F.greatest(by_queries, by_bytes).alias("_n"))
    block = F.xxhash64("_home", F.pmod(F.xxhash64("query_id"), F.col("_n")))
    return homed.join(grid, "_home").select(*found.columns, block.alias("_block"))


def _with_contexts(rows: DataFrame, passages: DataFrame, own: list[str]) -> DataFrame:
    """The columns ``own`` of ``rows`` (_block, _places, _asked, ...) and their context, made of the passages (_block, _pos, _text).

    The rows of a block follow its passages, so a task holds the passages of one block and looks at rows one by one.
    """
    marks = ["_places", "_asked", *own]
    blank = [F.lit(None).cast(rows.schema[c].dataType).alias(c) for c in marks]
    nothing = [F.lit(None).cast("int").alias("_pos"), F.lit(None).cast("string").alias("_text")]
    both = passages.select("_block", "_pos", "_text", *blank).unionByName(rows.select("_block", *nothing, *marks))
    dealt = both.repartition("_block").sortWithinPartitions("_block", F.asc_nulls_last("_pos"))
    fields = [StructField(c, rows.schema[c].dataType) for c in own]

    def join(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        block, held = None, {}
        for batch in batches:
            for at in range(0, batch.num_rows, _SLICE):
                part = batch.slice(at, _SLICE)
                contexts = []
                for b, pos, text, places, asked in zip(*(part.column(i).to_pylist() for i in range(5))):
                    if b != block:
                        block, held = b, {}
                    if pos is not None:
                        held[pos] = text
                    else:
                        contexts.append(V.BLOCK_SEPARATOR.join(held[p] for p in places or ()) if asked else None)
                if contexts:
                    kept = part.filter(part.column(1).is_null())
                    yield pa.RecordBatch.from_arrays([*kept.columns[5:], pa.array(contexts, pa.string())], [*own, "context"])

    return dealt.mapInArrow(join, StructType([*fields, StructField("context", StringType())]))


def context_text(queries: DataFrame, index: DataFrame, k: int = V.RETRIEVAL_TOP, rows: DataFrame | None = None) -> DataFrame:
    """(query_id, context): the passages found, nearest first, each under its date and source;
    ``''`` where a collection has none.

    With ``rows`` (query_id, ...), these rows and their context, as a left join gives them: null for ids that are not asked. A
    context is put together where its row is: a passage goes once to a block of queries, however many of them found it.
    """
    found = written(vector_topk(queries, index, k).select("query_id", "collection", "id", "rank"), "found")
    placed = written(_placed(found, index), "placed")
    in_block = Window.partitionBy("_block").orderBy("collection", "id")
    needed = placed.select("_block", "collection", "id").distinct().withColumn("_pos", F.row_number().over(in_block) - 1)
    needed = written(needed, "needed")
    places = placed.join(needed, ["_block", "collection", "id"]).groupBy("query_id", "_block").agg(
        F.sort_array(F.collect_list(F.struct("rank", "_pos"))).alias("_found")
    )
    places = places.select("query_id", "_block", F.col("_found._pos").alias("_places"))
    asked = queries.select("query_id").join(places, "query_id", "left").withColumn("_asked", F.lit(True))
    meant = asked if rows is None else rows.join(asked, "query_id", "left")
    # rows without passages are dealt out one by one
    meant = meant.withColumn("_block", F.coalesce("_block", F.xxhash64("query_id")))
    passages = needed.join(_passages(index), ["collection", "id"])
    return _with_contexts(meant, passages, ["query_id"] if rows is None else rows.columns)


def lecture_queries(lectures: DataFrame, embedding: Embedding | None = None, before: bool = False) -> DataFrame:
    """One query per lecture: its first 200 words. ``before`` limits it to earlier days; without
    it a lecture that was indexed before also finds its own chunks."""
    extra = [lecture_day("lecture_date").alias("before_day")] if before else []
    return lectures.select(
        F.col("lecture_id").alias("query_id"),
        collection_name("course").alias("collection"),
        *extra,
        (embedding or hashed_embedding())(word_prefix("transcript")).alias("embedding"),
    )
