"""Keyword passage search and the dispatch of lookup calls."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from chalkline import fixed_values as V
from chalkline.functions.text import words
from chalkline.operators.temporal import nearest_figure, ocr_at


def search_passages(
    lectures: DataFrame,
    queries: DataFrame,
    k: int = V.SEARCH_TOP,
    size: int = V.SEARCH_WINDOW,
    step: int = V.SEARCH_STEP,
) -> DataFrame:
    """The k best windows of a query's lecture, by the number of query words they contain.

    A query word counts as often as the query repeats it, and as soon as it is a substring of the
    lower-cased window. ``queries`` is (query_id, lecture_id, query).

    A query meets its lecture in one join; windows are scored and ranked inside that row, and only the text of the
    winners leaves it. Nothing is shuffled afterwards.
    """
    asked = queries.select("query_id", "lecture_id", words(F.lower("query")).alias("_terms"))
    met = lectures.select("lecture_id", words("transcript").alias("_words")).join(asked, "lecture_id")
    n = F.size("_words")
    starts = F.when(n > 0, F.sequence(F.lit(0), n - 1, F.lit(step))).otherwise(F.array().cast("array<int>"))

    def text(start: Column) -> Column:
        return F.array_join(F.slice(F.col("_words"), start + 1, size), " ")

    def score(window: Column) -> Column:
        return F.size(F.filter(F.col("_terms"), lambda term: F.contains(window, term))).cast("bigint")

    lowered = F.transform(starts, lambda start: F.lower(text(start)))
    scored = F.transform(lowered, lambda window, i: F.struct((-score(window)).alias("score"), (i * step).alias("start")))
    best = F.slice(F.sort_array(F.filter(scored, lambda w: w["score"] < 0)), 1, k)
    ranked = met.select("query_id", "lecture_id", "_words", F.posexplode(best).alias("_pos", "_w"))
    start = F.col("_w.start")
    return ranked.select(
        "query_id", "lecture_id", (F.col("_pos") + 1).alias("rank"), start.alias("start"), (-F.col("_w.score")).alias("score"),
        F.bround(F.lit(100.0) * start / n, 0).cast("int").alias("position_pct"), text(start).alias("passage"),
    )


def passage_block(found: DataFrame) -> DataFrame:
    """(query_id, lecture_id, result): the passages of a search as one text, best first."""
    block = F.format_string(V.PASSAGE, "position_pct", "passage")
    return (
        found.select("query_id", "lecture_id", F.struct("rank", block.alias("block")).alias("_b"))
        .groupBy("query_id", "lecture_id")
        .agg(F.sort_array(F.collect_list("_b")).alias("_bs"))
        .select("query_id", "lecture_id", F.array_join(F.col("_bs.block"), V.BLOCK_SEPARATOR).alias("result"))
    )


def search_answers(lookups: DataFrame, lectures: DataFrame) -> DataFrame:
    """Text answer per search call; equal questions to one lecture are searched once."""
    asked = lookups.select("lecture_id", F.coalesce("query", F.lit("")).alias("query")).distinct()
    asked = asked.withColumn("query_id", F.struct("lecture_id", "query"))
    blocks = passage_block(search_passages(lectures, asked))
    answers = blocks.select("query_id.lecture_id", "query_id.query", "result")
    return (
        lookups.withColumn("_q", F.coalesce("query", F.lit("")))
        .join(answers.withColumnRenamed("query", "_q"), ["lecture_id", "_q"], "left")
        .drop("_q")
        .withColumn("result", F.coalesce("result", F.lit(V.NO_PASSAGES)))
    )


def read_calls(calls: DataFrame) -> DataFrame:
    """(call_id, lecture_id, tool, query, timestamp_seconds, window_seconds) of calls whose ``input`` is a JSON text.

    A field that is missing, null or not of its type (a number may be given as text) is null, as all are where the input is null or no JSON
    object; the lookups then take their defaults. Every call stays one row.
    """
    given = F.try_parse_json("input")
    fields = {"query": "string", "timestamp_seconds": "double", "window_seconds": "double"}
    return calls.select(
        "call_id", "lecture_id", "tool", *(F.try_variant_get(given, f"$.{name}", kind).alias(name) for name, kind in fields.items())
    )


def dispatch(lookups: DataFrame, lectures: DataFrame, aligned: DataFrame, figures: DataFrame) -> DataFrame:
    """(call_id, tool, result): one row per lookup call, each kind of call answered as a set.

    A call of an unknown kind, or of none, is told so.
    """
    answers = [
        search_answers(lookups.where(F.col("tool") == "search_transcript"), lectures),
        ocr_at(lookups.where(F.col("tool") == "get_ocr_at_timestamp"), aligned),
        nearest_figure(lookups.where(F.col("tool") == "get_figure_at_timestamp"), figures),
    ]
    known = F.coalesce(
        F.col("tool").isin("search_transcript", "get_ocr_at_timestamp", "get_figure_at_timestamp"), F.lit(False)
    )
    shown = F.coalesce("tool", F.lit("None"))
    answers.append(lookups.where(~known).withColumn("result", F.format_string(V.UNKNOWN_TOOL, shown)))
    out = answers[0].select("call_id", "tool", "result")
    for answer in answers[1:]:
        out = out.unionByName(answer.select("call_id", "tool", "result"))
    return out
