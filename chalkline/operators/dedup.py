"""Removal of slide lines that were already spoken, by exact set similarity.

A line is a duplicate if its word set and that of some transcript window overlap by more than a
threshold of the smaller set. Comparing all lines with all windows is avoided exactly: if ``m``
is the size of the smaller set, a hit shares at least ``floor(threshold · m) + 1`` words, so at
least one of any ``m - floor(threshold · m)`` words of the smaller set is in the other set.
Only those few words — the rarest — are looked up in the inverted index of the other side.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from chalkline import fixed_values as V
from chalkline.functions.text import (
    clean_line,
    is_mathematical,
    minute_tag,
    normalised,
    overlap_coefficient,
    split_lines,
    strip,
    word_set,
)
from chalkline.functions.windows import word_windows
from chalkline.operators.concat import ordered_concat
from chalkline.session import written


def _probe_length(size: Column, threshold: float) -> Column:
    return (size - F.floor(size * F.lit(threshold) - 1e-9)).cast("int")


def _digest(words: str | Column) -> Column:
    return F.coalesce(F.unhex(F.md5(F.array_join(words, " "))), F.lit(b""))


def _set_id(text: str) -> Column:
    return _digest(word_set(text))


def _line_sets(lines: DataFrame, on: list[str], text: str) -> DataFrame:
    """Each distinct word set of the lines once: a slide shown again is not compared again. Written, because it is read
    several times, and every time would shuffle the words."""
    sets = lines.select(*on, word_set(text).alias("_lset")).withColumn("_lid", _digest("_lset"))
    sets = sets.groupBy(*on, "_lid").agg(F.any_value("_lset").alias("_lset")).withColumn("_lsize", F.size("_lset"))
    return written(sets, "line-sets")


# words travel as hashes; sets of one side are filed under even ones, probes of the other side under odd ones
def _filed(word: Column) -> Column:
    return F.xxhash64(word).bitwiseAND(F.lit(-2).cast("bigint"))


def _marked(filed: Column) -> Column:
    return filed.bitwiseOR(F.lit(1).cast("bigint"))


def similar_pairs(lsets: DataFrame, windows: DataFrame, on: list[str], window_key: list[str], threshold: float) -> DataFrame:
    """(``on``, ``_lid``, ``window_key``, ``similarity``) of every line set and window above the threshold.

    Windows keep their word sets in place (``_wset``) and send out only (word, key) rows. A line's words go out once; those
    that no window of the same ``on`` has stop there, and only their number is needed further on. Words and line sets are
    64-bit hashes on the way, so rows are short whatever the words; candidates are verified on the words.
    """
    wsize = F.size("_wset")
    plain = F.transform("_wset", _filed)
    line = F.xxhash64("_lset").alias("_line")
    words = windows.select(*on, F.explode(plain).alias("_token"))
    common = words.groupBy(*on, "_token").agg(F.count("*").alias("_n"))
    ltok = lsets.select(*on, line, "_lsize", F.explode(F.transform("_lset", _filed)).alias("_token"))
    hits = written(ltok.join(common, [*on, "_token"]), "line-words")

    # a line no larger than the window: the line's rarest words against all window words; the words left out are the rarest
    own = Window.partitionBy(*on, "_line")
    rank = F.row_number().over(own.orderBy("_n", "_token")) + F.col("_lsize") - F.count("*").over(own)
    lprobe = hits.withColumn("_r", rank).where(F.col("_r") <= _probe_length(F.col("_lsize"), threshold))

    # a larger line: the window's longest words, which stand in for the rarest, against all line
    # words; windows as large as the largest line have no such partner and send nothing
    largest = lsets.agg(F.max("_lsize")).scalar()
    by_length = F.sort_array(F.transform("_wset", lambda w: F.struct((-F.length(w)).alias("k"), w.alias("w"))))
    longest = F.transform(
        F.slice(by_length, F.lit(1), _probe_length(wsize, threshold)), lambda p: _marked(_filed(p["w"]))
    )
    sent = F.when(wsize < largest, F.concat(plain, longest)).otherwise(plain)

    held = [*on, "_line", "_lsize", "_token"]
    index = lprobe.select(*held).unionByName(hits.select(*held).withColumn("_token", _marked(F.col("_token"))))
    probes = windows.select(*on, *window_key, wsize.alias("_wsize"), F.explode(sent).alias("_token"))
    line_is_larger = F.col("_wsize") < F.col("_lsize")
    is_marked = F.col("_token").bitwiseAND(F.lit(1).cast("bigint")) == 1
    met = probes.join(index, [*on, "_token"]).where(line_is_larger == is_marked)
    candidates = met.select(*on, "_line", *window_key).distinct()
    return (
        candidates.join(lsets.select(*on, "_lid", line, "_lset"), [*on, "_line"])
        .join(windows.select(*on, *window_key, "_wset"), [*on, *window_key])
        .withColumn("similarity", overlap_coefficient(F.col("_lset"), F.col("_wset")))
        .where(F.col("similarity") > threshold)
        .select(*on, "_lid", *window_key, "similarity")
    )


def spoken_windows(transcripts: DataFrame, min_words: int = 1) -> DataFrame:
    """The transcript windows lines are compared with. The last ones may be short, down to one
    word, and then match easily; ``min_words`` above 1 leaves such windows out."""
    windows = word_windows(transcripts, "transcript", V.DEDUP_WINDOW, V.DEDUP_STEP, ["lecture_id"])
    if min_words > 1:
        windows = windows.where(F.col("n_words") - F.col("start") >= min_words)
    return windows


def _window_sets(transcripts: DataFrame, min_words: int) -> DataFrame:
    return spoken_windows(transcripts, min_words).select("lecture_id", "start", word_set("chunk").alias("_wset"))


def _compared(lines: DataFrame, transcripts: DataFrame, min_words: int) -> DataFrame:
    """The window sets of the lectures that have lines, written once: they are read several times, and hold no text.

    The lectures' ids are written, so that Spark knows their size: a short list goes to the transcripts, which stay in place."""
    named = written(lines.select("lecture_id").distinct(), "lectures-with-lines")
    shown = transcripts.select("lecture_id", "transcript").join(named, "lecture_id", "left_semi")
    return written(_window_sets(shown, min_words), "window-sets")


def duplicate_pairs(
    lines: DataFrame, transcripts: DataFrame, threshold: float = V.SIMILARITY_THRESHOLD, min_window_words: int = 1
) -> DataFrame:
    """Every (lecture_id, line_id, start) above the threshold: lines against the windows of their own lecture."""
    on = ["lecture_id"]
    windows = _compared(lines, transcripts, min_window_words)
    pairs = similar_pairs(_line_sets(lines, on, "line"), windows, on, ["start"], threshold)
    named = lines.select("lecture_id", "line_id", _set_id("line").alias("_lid"))
    return pairs.join(named, ["lecture_id", "_lid"]).select("lecture_id", "line_id", "start", "similarity")


def novel_lines(
    lines: DataFrame,
    transcripts: DataFrame,
    text: str = "line",
    threshold: float = V.SIMILARITY_THRESHOLD,
    min_window_words: int = 1,
) -> DataFrame:
    """Lines that no window of the same lecture's transcript repeats.

    The lines and the word sets of the windows they meet are read several times, so both are written once.
    """
    on = ["lecture_id"]
    lines = written(lines, "lines")
    windows = _compared(lines, transcripts, min_window_words)
    spoken = similar_pairs(
        _line_sets(lines, on, text), windows, on, ["start"], threshold
    ).select("lecture_id", "_lid")
    tagged = lines.withColumn("_lid", _set_id(text))
    return tagged.join(spoken, ["lecture_id", "_lid"], "left_anti").drop("_lid")


def distinct_ocr(aligned: DataFrame) -> DataFrame:
    """Distinct trimmed OCR text per lecture with the place of its first occurrence."""
    text = strip("ocr_text")
    at = F.struct("timestamp_sec", "frame_index")
    return (
        aligned.select("lecture_id", "timestamp_sec", "frame_index", text.alias("ocr_text"))
        .where(F.col("ocr_text") != "")
        .groupBy("lecture_id", "ocr_text")
        .agg(F.min(at).alias("_at"))
        .select("lecture_id", "_at.*", "ocr_text")
        .withColumn("entry", F.concat(minute_tag("timestamp_sec"), F.lit(" "), F.col("ocr_text")))
    )


def joined_ocr(entries: DataFrame) -> DataFrame:
    return ordered_concat(
        entries, ["lecture_id"], ["timestamp_sec", "frame_index"], "entry", "\n",
        F.floor(F.col("timestamp_sec") / 600), "ocr_text",
    )


def ocr_lines(texts: DataFrame, text: str, order: list[str]) -> DataFrame:
    """One row per split line, ordered by ``order`` and then ``line_no``."""
    return texts.select("lecture_id", *order, F.posexplode(split_lines(text)).alias("line_no", "line"))


def filter_lines(
    lines: DataFrame,
    transcripts: DataFrame,
    order: list[str],
    threshold: float = V.SIMILARITY_THRESHOLD,
    math_only: bool = False,
    min_window_words: int = 1,
) -> DataFrame:
    """Cleaned lines worth keeping, one row each: at least three characters, mathematical if so
    asked, not already spoken, and the first of their kind in the lecture.

    The mathematical test looks at the spelling and comes before "first of its kind", which does
    not; the similarity test depends on lower-cased words only, so it gives one answer per kind
    and may safely follow.
    """
    clean = lines.select("lecture_id", *order, clean_line("line").alias("line")).where(F.length("line") >= 3)
    if math_only:
        clean = clean.where(is_mathematical("line"))
    first = (
        clean.groupBy("lecture_id", normalised("line").alias("_key"))
        .agg(F.min(F.struct(*order, "line")).alias("_row"))
        .select("lecture_id", "_row.*")
    )
    return novel_lines(first, transcripts, "line", threshold, min_window_words)


def joined_lines(kept: DataFrame, order: list[str], bucket: Column) -> DataFrame:
    return ordered_concat(kept, ["lecture_id"], order, "line", "\n", bucket, "ocr_filtered")


def filter_summary(lines: DataFrame, kept: DataFrame) -> DataFrame:
    """Lines in and unique lines out, per lecture."""
    entries = lines.groupBy("lecture_id").agg(F.count("*").alias("lines_in"))
    unique = kept.groupBy("lecture_id").agg(F.count("*").alias("lines_out"))
    return entries.join(unique, "lecture_id", "left").select(
        "lecture_id", "lines_in", F.coalesce("lines_out", F.lit(0)).alias("lines_out")
    )
