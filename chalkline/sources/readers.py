"""Scans of the pipeline's files as tables. The file stem names the lecture."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

SEGMENT_DOC = (
    "lecture_id STRING, language STRING, source STRING, "
    "segments ARRAY<STRUCT<id: INT, start: DOUBLE, end: DOUBLE, text: STRING>>"
)
OCR_FRAME = (
    "STRUCT<frame_index: INT, timestamp_sec: DOUBLE, image_path: STRING, raw_text: STRING, "
    "blocks: ARRAY<STRUCT<text: STRING, confidence: DOUBLE>>, is_slide: BOOLEAN>"
)
# every line end text files may use, as str.splitlines knows them
LINE_END = r"\r\n|[\n\r\x0b\x0c\x1c\x1d\x1e\x85\u2028\u2029]"
OCR_FIELDS = ["blocks", "frame_index", "image_path", "is_slide", "raw_text", "timestamp_sec"]


def stem(path: str | Column, suffix: str = "") -> Column:
    """File name without directory, extension and ``suffix``."""
    path = F.col(path) if isinstance(path, str) else path
    name = F.url_decode(F.replace(F.substring_index(path, "/", -1), F.lit("+"), F.lit("%2B")))
    return F.regexp_replace(F.regexp_replace(name, r"\.[^.]*$", ""), suffix + "$", "")


def read_transcripts(spark: SparkSession, path: str) -> DataFrame:
    """(lecture_id, transcript), one row per UTF-8 text file; folders named ``lecture_id=…`` name their lecture."""
    files = spark.read.text(path, wholetext=True)
    named = F.col("lecture_id").cast("string") if "lecture_id" in files.columns else stem("_metadata.file_path")
    return files.select(named.alias("lecture_id"), F.col("value").alias("transcript"))


def read_segments(spark: SparkSession, path: str, multiline: bool = True) -> DataFrame:
    """One row per segment of ``{language, source, segments}`` documents.

    Reads both one pretty-printed document per file (the stem then names the lecture) and, with
    ``multiline=False``, the one-document-per-line files of :func:`write_segments`.
    """
    docs = spark.read.schema(SEGMENT_DOC).option("multiLine", multiline).json(path)
    lecture = F.coalesce("lecture_id", stem("_metadata.file_path", "_segments"))
    return docs.select(
        lecture.alias("lecture_id"), "language", "source", F.explode("segments").alias("s")
    ).select(
        "lecture_id", "language", "source", "s.id",
        F.col("s.start").alias("start_sec"), F.col("s.end").alias("end_sec"), "s.text",
    )


def read_ocr_frames(spark: SparkSession, path: str, lines: bool = False) -> DataFrame:
    """One row per OCR frame; a record with a missing or unknown field is an error.

    Reads JSON arrays, one file per lecture, or with ``lines`` the records that
    :func:`chalkline.sources.writers.write_ocr_frames` puts one to a line with their lecture.
    """
    fail_fast = {"mode": "FAILFAST"}

    def strict(text: Column, kind: str, keys: Column, lecture: Column) -> Column:
        return F.when(keys, F.from_json(text, kind, fail_fast)).otherwise(
            F.raise_error(F.concat(F.lit("OCR record with missing or unknown fields: "), lecture))
        )

    def has_fields(record: Column) -> Column:
        return F.sort_array(F.map_keys(record)) == F.array(*map(F.lit, OCR_FIELDS))

    if lines:
        known = F.from_json("value", "lecture_id STRING, frame MAP<STRING, STRING>", fail_fast)
        named = spark.read.text(path).select("value", known.alias("k"))
        right = F.coalesce(has_fields(F.col("k.frame")), F.lit(False))
        record = strict(F.col("value"), f"frame {OCR_FRAME}", right, F.coalesce("k.lecture_id", F.lit("")))
        return named.select(F.col("k.lecture_id").alias("lecture_id"), record["frame"].alias("r")).select("lecture_id", "r.*")
    files = spark.read.text(path, wholetext=True).withColumn("lecture_id", stem("_metadata.file_path", "_ocr"))
    right = F.forall(F.from_json("value", "ARRAY<MAP<STRING, STRING>>", fail_fast), has_fields)
    records = strict(F.col("value"), f"ARRAY<{OCR_FRAME}>", right, F.col("lecture_id"))
    return files.select("lecture_id", F.explode(records).alias("r")).select("lecture_id", "r.*")


def read_ocr_table(spark: SparkSession, path: str) -> DataFrame:
    """The line form written by :func:`write_ocr_frames`."""
    return spark.read.schema(f"lecture_id STRING, frame {OCR_FRAME}").json(path).select("lecture_id", "frame.*")


def read_figures(spark: SparkSession, path: str) -> DataFrame:
    """The figure manifest, one JSON record per line."""
    fields = "lecture_id STRING, timestamp DOUBLE, filename STRING, caption STRING, reason STRING, latex_path STRING"
    return spark.read.schema(fields).json(path)


def list_notes(spark: SparkSession, path: str) -> DataFrame:
    """(path, stem) of the PDF files below ``path``; file contents are not read."""
    files = spark.read.format("binaryFile").option("pathGlobFilter", "*.pdf").load(path)
    return files.select("path", stem("path").alias("stem"))


def list_images(spark: SparkSession, path: str) -> DataFrame:
    files = spark.read.format("binaryFile").option("pathGlobFilter", "*.{jpg,png}").load(path)
    return files.select(F.col("path").alias("image_path"))


def read_log(spark: SparkSession, path: str) -> DataFrame:
    """(build_id, line_no, value) of build logs, one build per file."""
    files = spark.read.text(path, wholetext=True)
    return files.select(
        stem("_metadata.file_path").alias("build_id"),
        F.posexplode(F.split("value", LINE_END)).alias("line_no", "value"),
    )
