"""Frame analytics: brightness classes, OCR blocks, histograms, candidates, figures."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from chalkline import fixed_values as V
from chalkline.functions.text import figure_name, parse_verdict, strip


def kept_blocks(blocks: str = "blocks") -> Column:
    """OCR blocks above the confidence bound whose trimmed text has more than one character."""
    return F.filter(
        F.col(blocks), lambda b: (b["confidence"] > V.OCR_MIN_CONFIDENCE) & (F.length(strip(b["text"])) > 1)
    )


def frame_text(frames: DataFrame) -> DataFrame:
    """Frames with filtered blocks and their texts joined in block order; frames without text go."""
    kept = frames.withColumn("blocks", kept_blocks())
    return kept.withColumn("raw_text", F.array_join(F.col("blocks.text"), " ")).where(strip("raw_text") != "")


def frame_summary(frames: DataFrame) -> DataFrame:
    """Frames with text and all frames, per lecture."""
    text = F.array_join(F.transform(kept_blocks(), lambda b: b["text"]), " ")
    return frames.groupBy("lecture_id").agg(
        F.count_if(strip(text) != "").alias("frames_with_text"), F.count("*").alias("frames")
    )


def frame_type() -> Column:
    mean, std = F.col("gray_mean"), F.col("gray_std")
    return (
        F.when((mean > V.SLIDE_MIN_MEAN) & (std < V.SLIDE_MAX_STD), "slide")
        .when(mean < V.BLACKBOARD_MAX_MEAN, "blackboard")
        .otherwise("tablet")
    )


def with_frame_type(stats: DataFrame) -> DataFrame:
    typed = stats.withColumn("frame_type", frame_type())
    return typed.withColumn("is_slide", F.col("frame_type") == "slide").withColumn(
        "is_bright", F.col("gray_mean") > V.LEGACY_SLIDE_MIN_MEAN
    )


def ocr_route(stats: DataFrame, vision: bool) -> DataFrame:
    """The OCR work plan: which engine reads a frame and how the image is prepared for it."""
    kind = F.col("frame_type")
    handwriting = (kind != "slide") & F.lit(vision)
    return (
        with_frame_type(stats)
        .withColumn("engine", F.when(handwriting, "vision").otherwise("standard"))
        .withColumn(
            "preprocess",
            F.when(handwriting & (kind == "blackboard"), "contrast")
            .when(handwriting | (kind == "slide"), "none")
            .otherwise("equalise"),
        )
    )


def frames_present(frames: DataFrame, files: DataFrame) -> DataFrame:
    """OCR frames whose image is in the file listing."""
    return frames.join(files.select("image_path"), "image_path", "left_semi").select(*frames.columns)


def histogram(values: DataFrame, bins: int = V.HISTOGRAM_BINS, upper: int = 256) -> DataFrame:
    """Dense ``bins``-bin histogram of ``v`` over [0, upper) per ``id``; all zero for an id without such values."""
    place = F.when((F.col("v") >= 0) & (F.col("v") < upper), F.floor(F.col("v") * bins / upper).cast("int"))
    counted = values.groupBy("id", place.alias("bin")).agg(F.count("*").alias("n"))
    entry = F.when(F.col("bin").isNotNull(), F.struct("bin", "n"))
    per_id = counted.groupBy("id").agg(F.map_from_entries(F.collect_list(entry)).alias("_m"))
    dense = F.transform(F.sequence(F.lit(0), F.lit(bins - 1)), lambda b: F.coalesce(F.col("_m")[b], F.lit(0)))
    return per_id.select("id", dense.cast("array<double>").alias("hist"))


def bhattacharyya(a: Column, b: Column) -> Column:
    """Histogram distance in [0, 1]; independent of the scale of either histogram. 1 if one is empty."""

    def total(x: Column) -> Column:
        return F.aggregate(x, F.lit(0.0), lambda acc, v: acc + v)

    shared = total(F.zip_with(a, b, lambda x, y: F.sqrt(x * y)))
    mass = F.sqrt(total(a) * total(b))
    return F.sqrt(F.greatest(F.lit(0.0), 1.0 - F.when(mass > 0, shared / mass).otherwise(F.lit(0.0))))


def density_score(masks: DataFrame) -> DataFrame:
    return masks.groupBy("id").agg((F.avg("mask") / 255.0).alias("score"))


def top_candidates(
    frames: DataFrame, n: int = V.MAX_CANDIDATES, min_score: float | None = None
) -> DataFrame:
    """The ``n`` highest-scoring frames per lecture. ``min_score`` is off by default: the
    pipeline accepts such a bound but never applies it."""
    if min_score is not None:
        frames = frames.where(F.col("score") >= min_score)
    best = Window.partitionBy("lecture_id").orderBy(F.desc("score"), F.desc("timestamp_sec"), F.desc("image_path"))
    return frames.withColumn("rank", F.row_number().over(best)).where(F.col("rank") <= n)


def accepted_figures(verdicts: DataFrame) -> DataFrame:
    """Verdict rows that parse and say include."""
    return (
        verdicts.withColumn("_v", parse_verdict("raw"))
        .where(F.col("_v.include"))
        .select(
            *[c for c in verdicts.columns if c != "raw"],
            F.coalesce("_v.caption", F.lit("")).alias("caption"),
            F.coalesce("_v.reason", F.lit("")).alias("reason"),
        )
    )


def number_within(df: DataFrame, key: str, order: str, name: str, block_rows: int = 65536) -> DataFrame:
    """Consecutive numbers from 1 per ``key`` along the integer column ``order``.

    Numbers are taken within blocks of ``order`` values and shifted by the sizes of the earlier
    blocks, so a hot key is not sorted in one task.
    """
    blocked = df.withColumn("_block", F.floor(F.col(order) / block_rows))
    sizes = blocked.groupBy(key, "_block").agg(F.count("*").alias("_n"))
    earlier = Window.partitionBy(key).orderBy("_block").rowsBetween(Window.unboundedPreceding, -1)
    shift = sizes.select(key, "_block", F.coalesce(F.sum("_n").over(earlier), F.lit(0)).alias("_shift"))
    local = F.row_number().over(Window.partitionBy(key, "_block").orderBy(order))
    return (
        blocked.withColumn("_local", local)
        .join(shift, [key, "_block"])
        .withColumn(name, (F.col("_local") + F.col("_shift")).cast("bigint"))
        .drop("_block", "_local", "_shift")
    )


def named_figures(verdicts: DataFrame) -> DataFrame:
    """Accepted figures, numbered in order of acceptance, with file name and document path."""
    numbered = number_within(accepted_figures(verdicts), "lecture_id", "ord", "figure_no")
    named = numbered.withColumn("filename", figure_name(F.col("figure_no"), F.col("timestamp_sec")))
    return named.withColumn("latex_path", F.format_string(V.FIGURE_PATH, "filename"))


def figure_summary(verdicts: DataFrame) -> DataFrame:
    """Figures selected and candidates seen, per lecture."""
    return verdicts.groupBy("lecture_id").agg(
        F.count_if(F.coalesce(parse_verdict("raw")["include"], F.lit(False))).alias("selected"),
        F.count("*").alias("candidates"),
    )
