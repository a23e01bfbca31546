"""Overlapping word windows of a text column: one pass per row, no shuffle."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from chalkline.functions.text import words


def window_step(size: int, overlap: int) -> int:
    return size - overlap if overlap < size else size


def word_windows(df: DataFrame, text: str, size: int, step: int, keep: list[str]) -> DataFrame:
    """One row per window with ``pos``, ``start``, ``n_words`` (of the text) and ``chunk``.

    Windows start at 0, step, 2·step … below the number of words, so the last ones may be short.
    The words are split once per text; the windows are cut inside the row before they are
    exploded, so no row ever carries the whole text again.
    """
    split = df.select(*keep, words(text).alias("_words"))
    n = F.size("_words")
    starts = F.when(n > 0, F.sequence(F.lit(0), n - 1, F.lit(step))).otherwise(F.array().cast("array<int>"))
    cut: Column = F.transform(
        starts,
        lambda start, pos: F.struct(
            pos.alias("pos"),
            start.alias("start"),
            F.array_join(F.slice(F.col("_words"), start + 1, size), " ").alias("chunk"),
        ),
    )
    return split.select(*keep, n.alias("n_words"), F.explode(cut).alias("_w")).select(*keep, "n_words", "_w.*")


def prompt_chunks(df: DataFrame, text: str, size: int, keep: list[str]) -> DataFrame:
    """Non-overlapping chunks; a text of at most ``size`` words stays one untouched chunk.

    A text without any word is still one chunk, because it still gets a prompt.
    """
    split = df.select(*keep, F.col(text).alias("_text"), words(text).alias("_words"))
    n = F.size("_words")
    cut = F.transform(
        F.sequence(F.lit(0), n - 1, F.lit(size)),
        lambda start: F.array_join(F.slice(F.col("_words"), start + 1, size), " "),
    )
    chunks = F.when(n <= size, F.array("_text")).otherwise(cut)
    return split.select(*keep, n.alias("n_words"), F.posexplode(chunks).alias("chunk_idx", "chunk"))
