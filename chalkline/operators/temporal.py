"""Operators over lecture time: interval joins, nearest rows, sampling.

Interval joins never fall back to "all rows of one lecture": each interval is filed under a
time bin whose width fits it (two bins at most, a third by rounding), each point under one bin
per width in use, and the two meet on (lecture, width, bin). A hot lecture is thereby spread
over as many keys as it has bins, and adaptive execution splits what is still uneven.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from chalkline import fixed_values as V
from chalkline.functions.text import clock, one_decimal, strip, whole_number
from chalkline.operators.concat import ordered_concat
from chalkline.session import written

BASE_BIN_SEC = 64.0
PAD_SEC = 1.0


def band_pairs(
    points: DataFrame, intervals: DataFrame, on: list[str], point: str, lo: Column, hi: Column, condition: Column
) -> DataFrame:
    """Pairs of points and intervals with equal ``on`` columns that satisfy ``condition``.

    ``lo`` and ``hi`` must enclose every point the condition can accept; they are padded here, so
    rounding at the edges cannot lose a pair. Each pair comes out once, because an interval has
    one bin width and a point has one bin of that width.
    """
    lo, hi = lo - PAD_SEC, hi + PAD_SEC
    level = F.greatest(F.lit(0), F.ceil(F.log2((hi - lo) / BASE_BIN_SEC))).cast("int")
    width = F.lit(BASE_BIN_SEC) * F.pow(F.lit(2.0), F.col("_level"))
    binned = intervals.withColumn("_level", level).withColumn(
        "_bin", F.explode(F.sequence(F.floor(lo / width), F.floor(hi / width)))
    )
    # a few dozen integers at most: one per doubling of the longest interval
    levels = intervals.select(F.collect_set(level)).scalar()
    placed = points.withColumn("_level", F.explode(levels)).withColumn("_bin", F.floor(F.col(point) / width))
    return placed.join(binned, [*on, "_level", "_bin"]).where(condition).drop("_level", "_bin")


def _speech_pairs(frames: DataFrame, segments: DataFrame, window: float) -> DataFrame:
    t, start, end = F.col("timestamp_sec"), F.col("start_sec"), F.col("end_sec")
    return band_pairs(
        frames.select("lecture_id", "frame_index", "timestamp_sec"),
        segments.select("lecture_id", "id", "start_sec", "end_sec", "text"),
        ["lecture_id"],
        "timestamp_sec",
        start - window,
        F.greatest(end, start + window),
        (F.abs(start - t) < window) | ((start <= t) & (t <= end)),
    )


def align_pairs(frames: DataFrame, segments: DataFrame, window: float = V.ALIGN_WINDOW_SEC) -> DataFrame:
    """The (frame, segment) pairs behind :func:`align`."""
    return _speech_pairs(frames, segments, window).select("lecture_id", "frame_index", "id")


def join_speech(frames: DataFrame, pairs: DataFrame) -> DataFrame:
    """Frames with the texts of their paired segments, joined in segment order."""
    speech = ordered_concat(
        pairs, ["lecture_id", "frame_index"], ["id"], "text", " ", F.floor(F.col("id") / 4096), "speech"
    )
    return frames.join(speech, ["lecture_id", "frame_index"], "left").select(
        "lecture_id",
        "frame_index",
        "timestamp_sec",
        F.coalesce("speech", F.lit("")).alias("speech"),
        F.col("raw_text").alias("ocr_text"),
        "is_slide",
        "image_path",
    )


def align(frames: DataFrame, segments: DataFrame, window: float = V.ALIGN_WINDOW_SEC) -> DataFrame:
    """Each frame with the speech near it: segments that start less than ``window`` seconds away
    or that contain the frame's time, joined in segment order; ``''`` if there are none."""
    return join_speech(frames, _speech_pairs(frames, segments, window))


def aligned_without_ocr(segments: DataFrame) -> DataFrame:
    """The aligned form of speech alone: one row per segment at its start."""
    return segments.select(
        "lecture_id",
        F.col("id").alias("frame_index"),
        F.col("start_sec").alias("timestamp_sec"),
        F.col("text").alias("speech"),
        F.lit("").alias("ocr_text"),
        F.lit(False).alias("is_slide"),
        F.lit(None).cast("string").alias("image_path"),
    )


def segments_or_whole(lectures: DataFrame, segments: DataFrame) -> DataFrame:
    """Segments, and for lectures without any a single one that spans the whole lecture."""
    whole = lectures.join(segments, "lecture_id", "left_anti").select(
        "lecture_id",
        F.lit(0).alias("id"),
        F.lit(0.0).alias("start_sec"),
        F.lit(V.WHOLE_LECTURE_END_SEC).alias("end_sec"),
        F.col("transcript").alias("text"),
    )
    known = segments.join(lectures.select("lecture_id"), "lecture_id", "left_semi")
    return known.select("lecture_id", "id", "start_sec", "end_sec", "text").unionByName(whole)


def rebuild_transcript(aligned: DataFrame) -> DataFrame:
    """Non-empty speech of a lecture in time order. Speech shared by frames is repeated."""
    spoken = aligned.where(F.col("speech") != "")
    return ordered_concat(
        spoken, ["lecture_id"], ["timestamp_sec", "frame_index"], "speech", " ",
        F.floor(F.col("timestamp_sec") / 600), "transcript",
    )


def _first_per_time(rows: DataFrame, payload: list[str], order: list[str]) -> DataFrame:
    """One row per (lecture, time): the first in list order. Reduces copies before any join."""
    first = F.min_by(F.struct(*payload), F.struct(*order))
    return rows.groupBy("lecture_id", "timestamp_sec").agg(first.alias("_first"))


def first_context(candidates: DataFrame, aligned: DataFrame, window: float = V.ALIGN_WINDOW_SEC) -> DataFrame:
    """Speech of the earliest aligned row less than ``window`` seconds from each candidate.

    Earliest, not nearest; an empty speech counts as found; ``''`` if there is none.
    """
    entries = _first_per_time(aligned, ["speech"], ["frame_index"]).select(
        "lecture_id", F.col("timestamp_sec").alias("_at"), F.col("_first.speech").alias("speech")
    )
    t = F.col("timestamp_sec")
    pairs = band_pairs(
        entries,
        candidates.select("lecture_id", "timestamp_sec").distinct(),
        ["lecture_id"], "_at", t - window, t + window, F.abs(F.col("_at") - t) < window,
    )
    found = pairs.groupBy("lecture_id", "timestamp_sec").agg(F.min_by("speech", "_at").alias("speech"))
    return candidates.join(found, ["lecture_id", "timestamp_sec"], "left").withColumn(
        "speech", F.coalesce("speech", F.lit(""))
    )


def ocr_at(lookups: DataFrame, aligned: DataFrame) -> DataFrame:
    """Text answer per lookup: OCR of the aligned rows within its window (inclusive), with clock
    labels; one message if no row is near and another if the near rows have no text. A call
    without a time asks for second 0, one without a window for the default one."""
    t = F.coalesce("timestamp_seconds", F.lit(0.0))
    window = F.coalesce("window_seconds", F.lit(float(V.LOOKUP_WINDOW_SEC)))
    asking = lookups.withColumn("_at", t).withColumn("_window", window)
    key, span = ["lecture_id", "_at", "_window"], ["lecture_id", "_from", "_to"]
    # the times near a lookup are consecutive, so lookups between the same two of them share an answer: texts are joined once per answer
    near = band_pairs(
        aligned.select("lecture_id", "timestamp_sec").distinct(),
        asking.select(*key).distinct(), ["lecture_id"], "timestamp_sec",
        F.col("_at") - F.col("_window"), F.col("_at") + F.col("_window"),
        F.abs(F.col("timestamp_sec") - F.col("_at")) <= F.col("_window"),
    )
    spans = near.groupBy(*key).agg(F.min("timestamp_sec").alias("_from"), F.max("timestamp_sec").alias("_to"))
    spans = written(spans, "lookup-spans")
    pairs = band_pairs(
        aligned.select("lecture_id", "frame_index", "timestamp_sec", "ocr_text"), spans.select(*span).distinct(),
        ["lecture_id"], "timestamp_sec", F.col("_from"), F.col("_to"),
        (F.col("_from") <= F.col("timestamp_sec")) & (F.col("timestamp_sec") <= F.col("_to")),
    )
    text = strip("ocr_text")
    line = F.when(text != "", F.format_string(V.OCR_LINE, clock("timestamp_sec"), text))
    # rows without text count as near and add no line, so one aggregate answers both questions
    answers = ordered_concat(
        pairs.withColumn("_line", line), span, ["timestamp_sec", "frame_index"], "_line", "\n",
        F.floor(F.col("timestamp_sec") / 600), "_lines", keep_empty=True,
    ).withColumn("_near", F.lit(True))
    shown_window = F.coalesce(F.col("window_seconds").cast("string"), F.lit(str(V.LOOKUP_WINDOW_SEC)))
    shown_time = F.coalesce(F.col("timestamp_seconds").cast("string"), F.lit("0"))
    return (
        asking.join(spans, key, "left").join(answers, span, "left")
        .withColumn(
            "result",
            F.when(F.col("_near").isNull(), F.format_string(V.NO_OCR_NEAR, shown_window, shown_time))
            .when(F.col("_lines") == "", F.format_string(V.NO_OCR_TEXT, shown_time))
            .otherwise(F.col("_lines")),
        )
        .drop("_at", "_window", "_from", "_to", "_near", "_lines")
    )


def neighbours(probes: DataFrame, targets: DataFrame, bin_sec: float = 600.0) -> DataFrame:
    """For each (lecture_id, at) probe the last target at or before it and the first one after it.

    ``targets`` has ``lecture_id, at, target`` with distinct times per lecture. Both sides are
    merged by time within (lecture, bin); what lies beyond a bin's edge comes from one summary
    row per bin. No pairs are formed and no lecture is sorted as a whole.
    """
    target_type = targets.schema["target"].dataType
    merged = (
        targets.select("lecture_id", "at", F.lit(0).alias("_side"), "target")
        .unionByName(
            probes.select("lecture_id", "at", F.lit(1).alias("_side"), F.lit(None).cast(target_type).alias("target"))
        )
        .withColumn("_bin", F.floor(F.col("at") / bin_sec))
    )
    in_bin = Window.partitionBy("lecture_id", "_bin")
    upto = in_bin.orderBy("at", "_side").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    after = in_bin.orderBy(F.desc("at"), F.desc("_side")).rowsBetween(Window.unboundedPreceding, Window.currentRow)
    local = (
        merged.withColumn("_prev", F.last("target", ignorenulls=True).over(upto))
        .withColumn("_next", F.last("target", ignorenulls=True).over(after))
        .where(F.col("_side") == 1)
    )
    time_of_target = F.when(F.col("_side") == 0, F.col("at"))
    bins = merged.groupBy("lecture_id", "_bin").agg(
        F.max_by("target", time_of_target).alias("_last"), F.min_by("target", time_of_target).alias("_first")
    )
    per_lecture = Window.partitionBy("lecture_id")
    before_bin = per_lecture.orderBy("_bin").rowsBetween(Window.unboundedPreceding, -1)
    after_bin = per_lecture.orderBy(F.desc("_bin")).rowsBetween(Window.unboundedPreceding, -1)
    edges = bins.select(
        "lecture_id", "_bin",
        F.last("_last", ignorenulls=True).over(before_bin).alias("_before"),
        F.last("_first", ignorenulls=True).over(after_bin).alias("_after"),
    )
    return local.join(edges, ["lecture_id", "_bin"]).select(
        "lecture_id", "at",
        F.coalesce("_prev", "_before").alias("prev"),
        F.coalesce("_next", "_after").alias("next"),
    )


def nearest_figure(lookups: DataFrame, figures: DataFrame) -> DataFrame:
    """Text answer per lookup: the figure nearest in time, the first in list order on a tie. A call
    without a time asks for second 0."""
    asking = lookups.withColumn("_at", F.coalesce("timestamp_seconds", F.lit(0.0)))
    targets = _first_per_time(figures, ["timestamp_sec", "ord", "latex_path", "caption"], ["ord"]).select(
        "lecture_id", F.col("timestamp_sec").alias("at"), F.col("_first").alias("target")
    )
    probes = asking.select("lecture_id", F.col("_at").alias("at")).distinct()
    near = neighbours(probes, targets)
    t = F.col("at")
    d_prev, d_next = F.abs(F.col("prev.timestamp_sec") - t), F.abs(F.col("next.timestamp_sec") - t)
    use_prev = F.col("next").isNull() | (d_prev < d_next) | ((d_prev == d_next) & (F.col("prev.ord") < F.col("next.ord")))
    best = near.select(
        "lecture_id", F.col("at").alias("_at"),
        F.when(F.col("prev").isNotNull() & use_prev, F.col("prev")).otherwise(F.col("next")).alias("_fig"),
    )
    fig_time = F.col("_fig.timestamp_sec")
    text = F.format_string(
        V.NEAREST_FIGURE, whole_number(F.abs(fig_time - F.col("_at"))),
        F.col("_fig.latex_path"), F.col("_fig.caption"), one_decimal(fig_time),
    )
    return (
        asking.join(best, ["lecture_id", "_at"], "left")
        .withColumn("result", F.when(F.col("_fig").isNull(), V.NO_FIGURES).otherwise(text))
        .drop("_fig", "_at")
    )


def stride_sample(frames: DataFrame, fps: str | float = "fps", interval: float = V.FRAME_INTERVAL_SEC) -> DataFrame:
    """Every ``max(1, int(fps · interval))``-th frame with its time.

    ``fps`` is a column, as recordings differ, or one number for all. A lecture's sample ends before the first sampled
    frame that is not ``readable``.
    """
    rate = F.col(fps).cast("double") if isinstance(fps, str) else F.lit(float(fps))
    step = F.greatest(F.lit(1).cast("bigint"), (rate * interval).cast("bigint"))
    hits = frames.withColumn("_rate", rate).where(F.col("frame_idx") % step == 0)
    broken = hits.where(~F.col("readable")).groupBy("lecture_id").agg(F.min("frame_idx").alias("_stop"))
    return (
        hits.join(broken, "lecture_id", "left")
        .where(F.col("_stop").isNull() | (F.col("frame_idx") < F.col("_stop")))
        .withColumn("timestamp_sec", F.col("frame_idx") / F.col("_rate"))
        .drop("_stop", "_rate", "readable")
    )
