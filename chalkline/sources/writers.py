"""Sinks. Tables of streams are kept as versions: each batch writes its rows below its own version number (again, if it
is repeated), readers take the newest row per key of the versions that are complete, and :func:`fold_versions` folds
them when there are many. Tables that are read and revised for long are in :mod:`chalkline.sources.keyed`."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from chalkline.functions.text import strip
from chalkline.operators.retrieval import latest_per_key

DOC_SEGMENTS = 1000


def clean_segments(segments: DataFrame) -> DataFrame:
    return segments.withColumn("text", strip("text"))


def segment_documents(segments: DataFrame, language: str = "language") -> DataFrame:
    """``{lecture_id, language, source, segments}`` documents of at most 1000 segment numbers, so
    that a long lecture is several documents and not one large group."""
    entry = F.struct(
        "id", F.col("start_sec").alias("start"), F.col("end_sec").alias("end"), strip("text").alias("text")
    )
    return (
        segments.withColumn("_part", F.floor(F.col("id") / DOC_SEGMENTS))
        .groupBy("lecture_id", "_part")
        .agg(
            F.any_value(language).alias("language"),
            F.any_value("source").alias("source"),
            F.sort_array(F.collect_list(entry)).alias("segments"),
        )
        .select(F.col("lecture_id").cast("string").alias("lecture_id"), "language", "source", "segments")
    )


def write_segments(segments: DataFrame, path: str) -> None:
    segment_documents(segments).write.mode("overwrite").json(path)


def write_transcripts(lectures: DataFrame, path: str) -> None:
    lectures.select("lecture_id", strip("transcript").alias("transcript")).write.mode("overwrite").parquet(path)


def write_transcript_files(lectures: DataFrame, path: str) -> None:
    """One text file per lecture, in a folder that names it."""
    texts = lectures.select("lecture_id", strip("transcript").alias("value"))
    texts.write.mode("overwrite").partitionBy("lecture_id").text(path)


def write_ocr_frames(frames: DataFrame, path: str) -> None:
    """Frames with text, one JSON record per line, every field in it, null ones too."""
    fields = ["frame_index", "timestamp_sec", "image_path", "raw_text", "blocks", "is_slide"]
    (
        frames.where(strip("raw_text") != "")
        .select(F.col("lecture_id").cast("string").alias("lecture_id"), F.struct(*fields).alias("frame"))
        .write.mode("overwrite")
        .option("ignoreNullFields", False)
        .json(path)
    )


def write_figures(figures: DataFrame, path: str) -> None:
    fields = [F.col("timestamp_sec").alias("timestamp"), "filename", "caption", "reason", "latex_path"]
    figures.select("lecture_id", *fields).write.mode("overwrite").json(path)


def write_version(df: DataFrame, path: str, version: int, keys: list[str], order: list[str]) -> None:
    """Write a run's rows as one version; repeating the run replaces exactly that version."""
    latest_per_key(df, keys, order).write.mode("overwrite").parquet(f"{path}/version={version}")


def _complete(spark: SparkSession, path: str) -> list[int]:
    """The versions below a folder whose write has ended."""
    folder = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    files = folder.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())
    if not files.exists(folder):
        return []
    named = [s.getPath() for s in files.listStatus(folder) if s.getPath().getName().startswith("version=")]
    done = [p for p in named if files.exists(spark.sparkContext._jvm.org.apache.hadoop.fs.Path(p, "_SUCCESS"))]
    return sorted(int(p.getName().partition("=")[2]) for p in done)


def _versions(spark: SparkSession, path: str, upto: int | None = None) -> DataFrame:
    """The complete versions, all or those up to a number; what a running or failed write has so far is left out."""
    fold = max((v for v in _complete(spark, f"{path}/folded") if upto is None or v < upto), default=None)
    wanted = [v for v in _complete(spark, path) if (upto is None or v <= upto) and (fold is None or v > fold)]
    parts = [
        spark.read.option("basePath", path).parquet(*(f"{path}/version={v}" for v in wanted)).withColumn(
            "version", F.col("version").cast("int")
        )
    ] if wanted else []
    if fold is not None:
        parts.append(spark.read.parquet(f"{path}/folded/version={fold}").withColumn("version", F.lit(fold)))
    if not parts:
        raise FileNotFoundError(f"no complete version at {path}")
    return parts[0] if len(parts) == 1 else parts[0].unionByName(parts[1])


def read_versions(spark: SparkSession, path: str, keys: list[str]) -> DataFrame:
    """The newest row per key; keys that later runs do not name remain."""
    return latest_per_key(_versions(spark, path), keys, ["version"]).drop("version")


def fold_versions(spark: SparkSession, path: str, upto: int, keys: list[str]) -> None:
    """Fold the versions up to ``upto`` into one table, which readers then start from.

    It builds on the fold before, so a repeated batch may fold again."""
    folded = latest_per_key(_versions(spark, path, upto), keys, ["version"]).drop("version")
    folded.write.mode("overwrite").parquet(f"{path}/folded/version={upto}")
