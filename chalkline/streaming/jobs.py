"""Incremental forms of change detection, indexing and alignment.

Every job works in micro-batches that are runs of keyed tables: a batch reads and rewrites the buckets it touches, and a
repeated batch counts once. Rows may come in any order and however late: nothing is dropped.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming.query import StreamingQuery

from chalkline import fixed_values as V
from chalkline.functions.vectors import Embedding, hashed_embedding
from chalkline.operators.change import BLOCK_KEY, BLOCK_ROWS, block_entries, block_summaries, kept_per_block
from chalkline.operators.retrieval import index_chunks, latest_per_key
from chalkline.operators.temporal import PAD_SEC, align, align_pairs, band_pairs
from chalkline.session import scratch, written
from chalkline.sources.keyed import Snapshot, read_matching, read_table, state_before, upsert


def _run(stream: DataFrame, put, checkpoint: str) -> StreamingQuery:
    """Process what is there, batch by batch, and stop."""
    return (
        stream.writeStream.foreachBatch(put)
        .option("checkpointLocation", checkpoint)
        .trigger(availableNow=True)
        .start()
    )


def _null_safe(left: DataFrame, right: DataFrame, keys: list[str], how: str = "inner") -> DataFrame:
    """An equi-join in which a null key meets a null key; of two key columns the left one stays."""
    named = right.select(*(F.col(c).alias(f"_r_{c}" if c in keys else c) for c in right.columns))
    on = [F.col(k).eqNullSafe(F.col(f"_r_{k}")) for k in keys]
    return left.join(named, on, how).drop(*(f"_r_{k}" for k in keys))


def change_batches(
    series: DataFrame, threshold: float, path: str, checkpoint: str, value: str = "score", order: str = "ord",
    block_rows: int = BLOCK_ROWS,
) -> StreamingQuery:
    """Streaming change points; :func:`kept_changes` reads the result.

    A lecture's series is cut into blocks, ranges of its integer ``order``, and what is known of them is kept in keyed
    tables below ``path``: ``rows`` by block, ``blocks`` with a block's summary and the value that enters it, ``kept``
    with the rows kept in it. A batch puts its rows in, summarises the blocks it touches, composes the summaries of their
    lectures, and marks again only the touched blocks and those that another value enters now. So a late row corrects
    everything behind it without reading what it does not change. A row that is delivered again for the same place replaces
    the earlier one. Rows without a lecture are one series, rows without a place are refused; below ``path`` lectures are named by a JSON text, which
    is never null. Every step starts from the state before its batch, so that a repeated batch gives what it gave.
    """
    kind = series.schema["lecture_id"].dataType.simpleString()
    paths = {name: f"{path}/{name}" for name in ("rows", "blocks", "kept")}

    def keep(batch: DataFrame, batch_id: int) -> None:
        spark = batch.sparkSession
        place = F.coalesce(F.col(order), F.raise_error(F.lit(f"a row has no {order}")).cast("bigint"))
        new = batch.select(
            F.to_json(F.struct("lecture_id")).alias("lecture_id"), place.alias(order), F.col(value).cast("double").alias(value)
        ).withColumn("_block", F.floor(F.col(order) / block_rows))
        with scratch(spark, path):
            new = written(new, "new")
            rows = upsert(new, paths["rows"], batch_id, [*BLOCK_KEY, order], [value], by=BLOCK_KEY)
            own = read_matching(spark, paths["rows"], rows, new).withColumn("_start", F.lit(None).cast("double"))
            fresh = written(block_summaries(own, threshold, value, order), "summaries").drop("start")
            known = fresh.withColumn("enter", F.lit(None).cast("double")).withColumn("_fresh", F.lit(True))
            before = state_before(spark, paths["blocks"], batch_id)
            if before is not None:
                others = read_matching(spark, paths["blocks"], before, fresh).join(fresh, BLOCK_KEY, "left_anti")
                known = known.unionByName(others.withColumn("_fresh", F.lit(False)))
            summaries = known.select(*BLOCK_KEY, F.lit(None).cast("double").alias("start"), "first", "vs", "ls")
            changed = known.join(block_entries(summaries, threshold), BLOCK_KEY).where(
                F.col("_fresh") | ~F.col("enter").eqNullSafe(F.col("_enter"))
            )
            changed = written(changed.select(*BLOCK_KEY, "first", "vs", "ls", F.col("_enter").alias("enter")), "changed")
            upsert(changed, paths["blocks"], batch_id, BLOCK_KEY, ["enter"], by=["lecture_id"])
            due = read_matching(spark, paths["rows"], rows, changed).join(
                changed.select(*BLOCK_KEY, F.col("enter").alias("_enter")), BLOCK_KEY
            ).withColumn("_start", F.lit(None).cast("double"))
            found = kept_per_block(due, threshold, value, order)
            lecture = F.from_json("lecture_id", f"lecture_id {kind}")["lecture_id"]
            found = found.select(
                *BLOCK_KEY, lecture.alias("_lecture"),
                F.arrays_zip(F.col("orders").alias(order), F.col("kept").alias(value)).alias("kept"),
            )
            upsert(found, paths["kept"], batch_id, BLOCK_KEY, ["_block"])

    return _run(series, keep, checkpoint)


def kept_changes(spark: SparkSession, path: str) -> DataFrame:
    """The rows kept so far, as of the newest batch that has ended."""
    kept = read_table(spark, f"{path}/kept").select(F.col("_lecture").alias("lecture_id"), F.explode("kept").alias("_row"))
    return kept.select("lecture_id", "_row.*")


def index_stream(
    lectures: DataFrame, path: str, checkpoint: str, embedding: Embedding | None = None
) -> StreamingQuery:
    """Index lectures, with their vectors, as they come: each micro-batch is one run of the keyed table at ``path`` and
    rewrites the buckets its chunks fall in. A repeated batch counts once."""
    embed = embedding or hashed_embedding()

    def put(batch: DataFrame, batch_id: int) -> None:
        upsert(index_chunks(batch, embedding=embed), path, batch_id, ["collection", "id"], ["lecture_id"])

    return _run(lectures, put, checkpoint)


FRAME_FIELDS = ["frame_index", "timestamp_sec", "raw_text", "is_slide", "image_path"]
SEGMENT_FIELDS = ["id", "start_sec", "end_sec", "text"]
FRAME_KEY, SEGMENT_KEY = ["lecture_id", "frame_index"], ["lecture_id", "id"]
#: Rows of one lecture and one such stretch of time lie together.
STORE_BIN_SEC = 4096.0
PLACE_FRAMES = 4096


def _time_bin(seconds: str | Column, width: float | Column = STORE_BIN_SEC) -> Column:
    return F.floor((F.col(seconds) if isinstance(seconds, str) else seconds) / width).cast("bigint")


def _level_width() -> Column:
    return F.lit(STORE_BIN_SEC) * F.pow(F.lit(2.0), F.col("_level"))


def align_stream(
    frames: DataFrame, segments: DataFrame, path: str, checkpoint: str, window: float = V.ALIGN_WINDOW_SEC
) -> StreamingQuery:
    """Streaming alignment with complete rows, frames without speech among them; :func:`aligned_frames` reads them.

    Both streams are kept in keyed tables below ``path``, by lecture and stretch of time: ``frames`` and ``aligned`` by the
    frame's, ``segments`` by the two or three that cover the segment, of a width that fits its length. A batch reads the
    stretches its new segments reach for frames, and those of the frames that are new or reached for segments; it aligns
    these frames and rewrites the buckets they lie in. So its cost follows what it touches, not the age of the streams.
    There is no bound on the length of a segment, on lateness or on the order of lectures. A frame that is delivered again
    replaces the earlier one, also at another time: ``places`` has where each frame lies, and where it lay a mark takes its
    place. As in :func:`align`, frames without a lecture or a time have no speech. Every step starts from the state
    before its batch, so that a repeated batch gives what it gave.
    """
    sides = {"_frame": (frames, FRAME_FIELDS), "_segment": (segments, SEGMENT_FIELDS)}

    def tagged(side: str):
        stream = sides[side][0]
        columns = []
        for name, (source, fields) in sides.items():
            kind = source.select(F.struct(*fields).alias("x")).schema["x"].dataType
            columns.append((F.struct(*fields) if name == side else F.lit(None).cast(kind)).alias(name))
        return stream.select("lecture_id", *columns)

    def put(batch: DataFrame, batch_id: int) -> None:
        spark = batch.sparkSession
        new_frames = batch.where("_frame IS NOT NULL").select("lecture_id", "_frame.*")
        new_segments = batch.where("_segment IS NOT NULL").select("lecture_id", "_segment.*")
        with scratch(spark, path):
            new_frames = latest_per_key(new_frames, FRAME_KEY, ["timestamp_sec"]).withColumn("_bin", _time_bin("timestamp_sec"))
            new_frames = written(new_frames, "new-frames")
            new_segments = written(latest_per_key(new_segments, SEGMENT_KEY, ["start_sec"]), "new-segments")
            moved = _moved_frames(spark, path, new_frames, batch_id)
            frames_now = upsert(
                new_frames.withColumn("_gone", F.lit(False)).unionByName(moved, allowMissingColumns=True),
                f"{path}/frames", batch_id, ["lecture_id", "_bin", "frame_index"], ["timestamp_sec"], by=["lecture_id", "_bin"],
            )
            bins_now = upsert(new_frames.select("lecture_id", "_bin").distinct(), f"{path}/bins", batch_id, ["lecture_id", "_bin"], [], by=["lecture_id"])
            segments_now, levels = _put_segments(spark, path, new_segments, batch_id, window)

            lo, hi = F.col("start_sec") - window - PAD_SEC, F.greatest("end_sec", F.col("start_sec") + window) + PAD_SEC
            ranges = new_segments.select("lecture_id", _time_bin(lo).alias("_first"), _time_bin(hi).alias("_last")).distinct()
            held = read_matching(spark, f"{path}/bins", bins_now, new_segments)
            first, last = F.col("_first"), F.col("_last")
            reached = band_pairs(held.withColumnRenamed("_bin", "_at"), ranges, ["lecture_id"], "_at", first, last, F.col("_at").between(first, last))
            reached = written(reached.select("lecture_id", F.col("_at").alias("_bin")).distinct(), "reached")
            near = read_matching(spark, f"{path}/frames", frames_now, reached).where("NOT _gone").drop("_gone")
            again = align_pairs(near, new_segments, window).select(*FRAME_KEY).distinct()
            again = _null_safe(_null_safe(near, again, FRAME_KEY, "left_semi"), new_frames, FRAME_KEY, "left_anti")
            due = written(new_frames.unionByName(again), "due")

            asked = due.select("lecture_id", "timestamp_sec", F.explode(F.array(*map(F.lit, levels))).alias("_level")) if levels else None
            known = new_segments
            if asked is not None:
                wanted = asked.select("lecture_id", "_level", _time_bin("timestamp_sec", _level_width()).alias("_bin")).distinct()
                known = read_matching(spark, f"{path}/segments", segments_now, wanted).dropDuplicates(SEGMENT_KEY)
            found = align(due, known, window).withColumn("_bin", _time_bin("timestamp_sec")).withColumn("_gone", F.lit(False))
            upsert(
                found.unionByName(moved.select("lecture_id", "_bin", "frame_index", "_gone"), allowMissingColumns=True),
                f"{path}/aligned", batch_id, ["lecture_id", "_bin", "frame_index"], ["timestamp_sec"], by=["lecture_id", "_bin"],
            )

    return _run(tagged("_frame").unionByName(tagged("_segment")), put, checkpoint)


def _moved_frames(spark: SparkSession, path: str, new: DataFrame, batch_id: int) -> DataFrame:
    """Marks (lecture_id, _bin, frame_index, _gone) where frames of the batch lay before, if it was elsewhere."""
    block = F.floor(F.col("frame_index") / PLACE_FRAMES).alias("_block")
    placed = new.select("lecture_id", block, "frame_index", "_bin")
    before = state_before(spark, f"{path}/places", batch_id)
    if before is None:
        moved = placed.where("false")
    else:
        old = read_matching(spark, f"{path}/places", before, placed)
        now = placed.select(*FRAME_KEY, F.col("_bin").alias("_now"))
        moved = _null_safe(old, now, FRAME_KEY).where(~F.col("_bin").eqNullSafe(F.col("_now")))
    moved = written(moved.select("lecture_id", "_bin", "frame_index", F.lit(True).alias("_gone")), "moved")
    upsert(placed, f"{path}/places", batch_id, ["lecture_id", "_block", "frame_index"], ["_bin"], by=["lecture_id", "_block"])
    return moved


def _put_segments(
    spark: SparkSession, path: str, new: DataFrame, batch_id: int, window: float
) -> tuple[Snapshot, list[int]]:
    """Put segments under the stretches that frames near them lie in; the state and the levels of width in use, a few dozen at
    most. Segments without a start are near no frame."""
    lo, hi = F.col("start_sec") - window - PAD_SEC, F.greatest("end_sec", F.col("start_sec") + window) + PAD_SEC
    level = F.greatest(F.lit(0), F.ceil(F.log2((hi - lo) / STORE_BIN_SEC))).cast("int")
    bins = F.sequence(_time_bin(lo, _level_width()), _time_bin(hi, _level_width()))
    filed = new.withColumn("_level", level).withColumn("_bin", F.explode(bins))
    place = ["lecture_id", "_level", "_bin"]
    state = upsert(filed, f"{path}/segments", batch_id, [*place, "id"], ["start_sec"], by=place)
    levels = upsert(filed.select("_level").distinct(), f"{path}/levels", batch_id, ["_level"], [])
    return state, sorted(r[0] for r in read_table(spark, f"{path}/levels", levels.number).collect())


def aligned_frames(spark: SparkSession, path: str) -> DataFrame:
    """The newest aligned row of every frame, as of the newest batch that has ended."""
    return read_table(spark, f"{path}/aligned").where("NOT _gone").drop("_bin", "_gone")
