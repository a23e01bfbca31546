"""One query per operator over the driver's tables."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming.query import StreamingQuery

from chalkline.functions import text as T
from chalkline.functions.vectors import hashed_embedding
from chalkline.functions.windows import prompt_chunks
from chalkline.operators import change, dedup, frames, lookups, prompts, retrieval, temporal
from chalkline.operators.concat import ordered_concat
from chalkline.plans.fixtures import view
from chalkline.session import shared_dir, written
from chalkline.sources import keyed, readers, writers
from chalkline.streaming import jobs

Query = Callable[[SparkSession, str], DataFrame]
QUERIES: dict[str, Query] = {}

CHANGE_THRESHOLD = 50.0
SCENE_THRESHOLD = 0.14
PROMPT_WORDS = 1000


def query(fn: Query) -> Query:
    QUERIES[fn.__name__] = fn
    return fn


class _Tables:
    """Attribute access to the views of one data directory."""

    def __init__(self, spark: SparkSession, sf_dir: str):
        self._at = spark, sf_dir

    def __getattr__(self, name: str) -> DataFrame:
        return view(*self._at, name)

    @property
    def noted_lectures(self) -> DataFrame:
        """Lectures to write notes for: all with a transcript file, and one of its own for every odd conversation, which has
        only aligned speech."""
        return self.lectures.select("lecture_id", "course", "lecture_date", "transcript").unionByName(self.untranscribed)

    @property
    def aligned(self) -> DataFrame:
        return temporal.align(self.ocr_frames, self.segments)

    @property
    def noted_aligned(self) -> DataFrame:
        """Aligned rows of the lectures to write notes for."""
        own = F.when(F.col("lecture_id") % 2 == 1, -1 - F.col("lecture_id")).otherwise(F.col("lecture_id"))
        return self.aligned.withColumn("lecture_id", own)

    @property
    def blocks(self) -> DataFrame:
        block = lambda w, i: F.struct(
            w.alias("text"),
            (((F.col("frame_index") * 31 + i * 37) % 100).cast("double") / 100.0).alias("confidence"),
        )
        return self.ocr_frames.withColumn("blocks", F.transform(T.words("raw_text"), block))

    @property
    def sourced(self) -> DataFrame:
        return self.lectures.withColumn("source", F.lit("transcript"))

    @property
    def slide_lines(self) -> DataFrame:
        """Slide lines of each conversation: the assistant's turns, split."""
        return dedup.ocr_lines(self.ocr_frames, "raw_text", ["frame_index"])

    @property
    def spoken(self) -> DataFrame:
        """Transcript of each conversation: the user's turns in order."""
        return ordered_concat(
            self.spoken_turns, ["lecture_id"], ["id"], "text", " ", F.floor(F.col("id") / 4096), "transcript"
        )


def _tables(spark: SparkSession, sf_dir: str) -> _Tables:
    return _Tables(spark, sf_dir)


# --- scans, sources, sinks --------------------------------------------------------------

@query
def segments_scan(spark, sf_dir):
    t = _tables(spark, sf_dir)
    named = t.segments.join(t.lectures.select("lecture_id", "language"), "lecture_id").withColumn(
        "source", F.concat(F.lit("lecture_"), F.col("lecture_id").cast("string"), F.lit(".mp4"))
    )
    path = shared_dir(spark, "segments")
    writers.write_segments(named, path)
    return readers.read_segments(spark, path, multiline=False).withColumn(
        "lecture_id", F.col("lecture_id").cast("bigint")
    )


@query
def transcripts_scan(spark, sf_dir):
    path = shared_dir(spark, "transcripts")
    writers.write_transcript_files(_tables(spark, sf_dir).spoken, path)
    return readers.read_transcripts(spark, path).select(
        F.col("lecture_id").cast("bigint").alias("lecture_id"), T.strip("transcript").alias("transcript")
    )


@query
def ocr_frames_file(spark, sf_dir):
    path = shared_dir(spark, "ocr-frames")
    writers.write_ocr_frames(frames.frame_text(_tables(spark, sf_dir).blocks), path)
    read = readers.read_ocr_frames(spark, path, lines=True)
    return read.select(
        F.col("lecture_id").cast("bigint").alias("lecture_id"), "frame_index", "timestamp_sec", "image_path", "raw_text",
        "is_slide", F.size("blocks").alias("n_blocks"),
    )


@query
def figures_manifest(spark, sf_dir):
    path = shared_dir(spark, "figures")
    writers.write_figures(frames.named_figures(_tables(spark, sf_dir).verdicts), path)
    return readers.read_figures(spark, path).withColumn("lecture_id", F.col("lecture_id").cast("bigint"))


@query
def segments_or_whole(spark, sf_dir):
    t = _tables(spark, sf_dir)
    return temporal.segments_or_whole(t.lectures, t.segments)


@query
def segments_clean(spark, sf_dir):
    return writers.clean_segments(_tables(spark, sf_dir).segments)


@query
def catalogue_match(spark, sf_dir):
    return retrieval.matching_files(_tables(spark, sf_dir).files, "high").select("id", "stem")


@query
def notes_upsert(spark, sf_dir):
    lectures = _tables(spark, sf_dir).lectures

    def notes(rows: DataFrame, suffix: str | None, document) -> DataFrame:
        s = F.lit(suffix).cast("string")
        return rows.select(
            "lecture_id", T.notes_name(F.col("course"), F.col("lecture_date"), s).alias("notes_key"),
            document.alias("document"),
        )

    first = notes(lectures, None, F.col("transcript"))
    revised = notes(lectures.where(F.col("language") == "fr"), None, F.concat(F.lit("Revised. "), F.col("transcript")))
    parts = notes(lectures.where(F.col("language") == "de"), "Part 2", F.concat(F.lit("Continued. "), F.col("transcript")))
    path = shared_dir(spark, "notes")
    for run, rows in enumerate([first, revised.unionByName(parts)]):
        keyed.upsert(rows, path, run, ["notes_key"], ["lecture_id"])
    return keyed.read_table(spark, path)


INDEX_COLUMNS = ["id", "collection", "course", "lecture_date", "source", "chunk_index", "document"]


@query
def index_upsert(spark, sf_dir):
    t = _tables(spark, sf_dir)
    again = t.sourced.where(F.col("language") != "en").withColumn(
        "transcript", F.concat(F.lit("Second reading: "), F.col("transcript"))
    )
    path = shared_dir(spark, "index")
    for run, lectures in enumerate([t.sourced, again]):
        chunks = retrieval.index_chunks(lectures, embedding=hashed_embedding())
        keyed.upsert(chunks, path, run, ["collection", "id"], ["lecture_id"])
    return keyed.read_table(spark, path).select(*INDEX_COLUMNS, _signature())


# --- projections, filters ---------------------------------------------------------------

@query
def ocr_block_filter(spark, sf_dir):
    kept = F.posexplode(frames.kept_blocks()).alias("kept_no", "b")
    return _tables(spark, sf_dir).blocks.select("lecture_id", "frame_index", kept).select(
        "lecture_id", "frame_index", "kept_no", "b.text", "b.confidence"
    )


@query
def ocr_frame_text(spark, sf_dir):
    return frames.frame_text(_tables(spark, sf_dir).blocks).select(
        "lecture_id", "frame_index", "raw_text", F.size("blocks").alias("n_blocks")
    )


@query
def frame_type(spark, sf_dir):
    return frames.with_frame_type(_tables(spark, sf_dir).frame_stats).select(
        "lecture_id", "frame_type", "is_slide", "is_bright",
        F.round("gray_mean", 4).alias("gray_mean"), F.round("gray_std", 4).alias("gray_std"),
    )


@query
def ocr_route(spark, sf_dir):
    stats = _tables(spark, sf_dir).frame_stats
    plans = [frames.ocr_route(stats, v).withColumn("vision", F.lit(v)) for v in (False, True)]
    return plans[0].unionByName(plans[1]).select("lecture_id", "vision", "frame_type", "engine", "preprocess")


@query
def media_requests(spark, sf_dir):
    return _tables(spark, sf_dir).requests.where(T.is_media_request("url"))


@query
def math_lines(spark, sf_dir):
    lines = dedup.ocr_lines(_tables(spark, sf_dir).lectures, "transcript", [])
    return lines.where(T.is_mathematical("line"))


@query
def aligned_no_ocr(spark, sf_dir):
    return temporal.aligned_without_ocr(_tables(spark, sf_dir).segments).drop("image_path", "frame_index")


@query
def resolve_date(spark, sf_dir):
    return _tables(spark, sf_dir).titles.select(
        "id", T.resolve_date(F.col("given_date"), F.col("default_date"), T.title_date("title")).alias("lecture_date")
    )


@query
def log_errors(spark, sf_dir):
    return prompts.log_errors(_tables(spark, sf_dir).log_lines)


# --- joins over time --------------------------------------------------------------------

@query
def align(spark, sf_dir):
    return _tables(spark, sf_dir).aligned


@query
def first_context(spark, sf_dir):
    t = _tables(spark, sf_dir)
    return temporal.first_context(t.frame_scores, t.aligned).select("lecture_id", "ord", "timestamp_sec", "speech")


@query
def ocr_at(spark, sf_dir):
    t = _tables(spark, sf_dir)
    return temporal.ocr_at(t.lookups, t.aligned).select("call_id", "result")


@query
def nearest_figure(spark, sf_dir):
    t = _tables(spark, sf_dir)
    return temporal.nearest_figure(t.lookups, t.figures).select("call_id", "result")


@query
def frames_present(spark, sf_dir):
    t = _tables(spark, sf_dir)
    return frames.frames_present(t.ocr_frames, t.image_files).select("lecture_id", "frame_index", "image_path")


@query
def lookup_dispatch(spark, sf_dir):
    t = _tables(spark, sf_dir)
    return lookups.dispatch(lookups.read_calls(t.lookup_calls), t.lectures, t.aligned, t.figures)


@query
def rebuild_transcript(spark, sf_dir):
    return temporal.rebuild_transcript(_tables(spark, sf_dir).aligned)


@query
def stride_sample(spark, sf_dir):
    sampled = temporal.stride_sample(_tables(spark, sf_dir).frame_series)
    return sampled.select(
        "lecture_id", "frame_idx", "timestamp_sec",
        T.frame_name(F.col("frame_idx"), F.col("timestamp_sec")).alias("image_name"),
    )


# --- de-duplication ---------------------------------------------------------------------

@query
def dup_pairs(spark, sf_dir):
    t = _tables(spark, sf_dir)
    lines = t.slide_lines.withColumn("line_id", F.col("frame_index") * 4096 + F.col("line_no"))
    told = ordered_concat(t.segments, ["lecture_id"], ["id"], "text", " ", F.floor(F.col("id") / 4096), "transcript")
    return dedup.duplicate_pairs(lines, told).withColumn("similarity", F.round("similarity", 6))


@query
def novel_lines(spark, sf_dir):
    t = _tables(spark, sf_dir)
    return dedup.novel_lines(t.slide_lines, t.spoken)


def _filtered(t: _Tables, math_only: bool) -> DataFrame:
    order = ["frame_index", "line_no"]
    kept = dedup.filter_lines(t.slide_lines, t.spoken, order, math_only=math_only)
    joined = dedup.joined_lines(kept, order, F.floor(F.col("frame_index") / 4096))
    every = t.ocr_frames.select("lecture_id").distinct()
    return every.join(joined, "lecture_id", "left").select(
        "lecture_id", F.coalesce("ocr_filtered", F.lit("")).alias("ocr_filtered")
    )


@query
def ocr_filter(spark, sf_dir):
    return _filtered(_tables(spark, sf_dir), math_only=False)


@query
def ocr_filter_math(spark, sf_dir):
    return _filtered(_tables(spark, sf_dir), math_only=True)


@query
def filter_summary(spark, sf_dir):
    t = _tables(spark, sf_dir)
    lines = t.slide_lines
    return dedup.filter_summary(lines, dedup.filter_lines(lines, t.spoken, ["frame_index", "line_no"]))


@query
def ocr_distinct(spark, sf_dir):
    return dedup.joined_ocr(dedup.distinct_ocr(_tables(spark, sf_dir).aligned))


@query
def ocr_split(spark, sf_dir):
    return dedup.ocr_lines(_tables(spark, sf_dir).lectures, "transcript", [])


@query
def overlap_coeff(spark, sf_dir):
    t = _tables(spark, sf_dir)
    said = t.segments.select("lecture_id", (F.col("id") + 1).alias("frame_index"), T.word_set("text").alias("said"))
    shown = t.ocr_frames.select("lecture_id", "frame_index", T.word_set("raw_text").alias("shown"))
    return shown.join(said, ["lecture_id", "frame_index"]).select(
        "lecture_id", "frame_index",
        F.round(T.overlap_coefficient(F.col("shown"), F.col("said")), 6).alias("similarity"),
    )


# --- aggregations -----------------------------------------------------------------------

@query
def page_concat(spark, sf_dir):
    return retrieval.page_texts(_tables(spark, sf_dir).page_text)


@query
def collection_counts(spark, sf_dir):
    chunks = retrieval.index_chunks(_tables(spark, sf_dir).sourced)
    return retrieval.collection_counts(chunks.select("collection", "id").distinct())


@query
def collection_exists(spark, sf_dir):
    """Titles whose course has an index, among all titles."""
    t = _tables(spark, sf_dir)
    courses = t.lectures.select("lecture_id", "course").unionByName(
        t.titles.select(F.col("id").alias("lecture_id"), "course")
    )
    return retrieval.indexed_courses(courses, retrieval.index_chunks(t.sourced.where(F.col("lecture_id") % 2 == 0)))


@query
def corpus_summary(spark, sf_dir):
    t = _tables(spark, sf_dir)
    counts = t.segments.groupBy("lecture_id").agg(F.count("*").alias("segments"))
    return t.lectures.join(counts, "lecture_id", "left").select(
        "lecture_id", "language",
        F.size(T.words("transcript")).cast("bigint").alias("n_words"),
        F.coalesce("segments", F.lit(0)).alias("segments"),
    )


@query
def frame_summary(spark, sf_dir):
    return frames.frame_summary(_tables(spark, sf_dir).blocks)


@query
def figure_summary(spark, sf_dir):
    return frames.figure_summary(_tables(spark, sf_dir).verdicts)


@query
def index_summary(spark, sf_dir):
    counts = retrieval.index_counts(_tables(spark, sf_dir).sourced)
    total = counts.agg(F.sum("chunks").alias("chunks")).select(F.lit(-1).cast("bigint").alias("lecture_id"), "chunks")
    return counts.unionByName(total)


@query
def histogram64(spark, sf_dir):
    hist = frames.histogram(_tables(spark, sf_dir).samples)
    return hist.select("id", F.posexplode("hist").alias("bin", "n")).withColumn("n", F.col("n").cast("bigint"))


@query
def hist_distance(spark, sf_dir):
    hist = frames.histogram(_tables(spark, sf_dir).samples)
    after = hist.select((F.col("id") - 1).alias("id"), F.col("hist").alias("next_hist"))
    return hist.join(after, "id").select(
        "id", F.round(frames.bhattacharyya(F.col("hist"), F.col("next_hist")), 6).alias("distance")
    )


@query
def density_score(spark, sf_dir):
    return frames.density_score(_tables(spark, sf_dir).samples).withColumn("score", F.round("score", 6))


@query
def merge_responses(spark, sf_dir):
    return prompts.merge_responses(_tables(spark, sf_dir).responses)


@query
def clean_response(spark, sf_dir):
    return _tables(spark, sf_dir).responses.select("lecture_id", "chunk_idx", T.strip_fences("raw").alias("document"))


# --- windows and sequences --------------------------------------------------------------

@query
def chunks_index(spark, sf_dir):
    return retrieval.index_chunks(_tables(spark, sf_dir).sourced).select("lecture_id", *INDEX_COLUMNS)


@query
def chunks_dedup(spark, sf_dir):
    return dedup.spoken_windows(_tables(spark, sf_dir).lectures).select("lecture_id", "start", "chunk")


@query
def chunks_prompt(spark, sf_dir):
    return prompt_chunks(_tables(spark, sf_dir).lectures, "transcript", PROMPT_WORDS, ["lecture_id"])


@query
def passage_search(spark, sf_dir):
    t = _tables(spark, sf_dir)
    return lookups.search_passages(t.lectures, t.queries)


@query
def change_points(spark, sf_dir):
    return change.change_points(_tables(spark, sf_dir).frame_scores, CHANGE_THRESHOLD)


@query
def scene_changes(spark, sf_dir):
    """Change points of histogram series: one histogram per supplier, ten series of suppliers."""
    hists = frames.histogram(_tables(spark, sf_dir).samples)
    series = hists.select((F.col("id") % 10).alias("lecture_id"), F.col("id").alias("ord"), "hist")
    return change.histogram_changes(series, SCENE_THRESHOLD)


@query
def figure_names(spark, sf_dir):
    return frames.named_figures(_tables(spark, sf_dir).verdicts)


@query
def accepted_figures(spark, sf_dir):
    return frames.accepted_figures(_tables(spark, sf_dir).verdicts)


@query
def top_candidates(spark, sf_dir):
    return frames.top_candidates(_tables(spark, sf_dir).frame_scores).select(
        "lecture_id", "rank", "score", "timestamp_sec", "image_path"
    )


@query
def query_prefix(spark, sf_dir):
    return _tables(spark, sf_dir).lectures.select(
        "lecture_id", T.word_prefix("transcript").alias("query"), T.char_prefix("transcript").alias("shown")
    )


@query
def first_media(spark, sf_dir):
    media = _tables(spark, sf_dir).requests.where(T.is_media_request("url"))
    return media.groupBy("session_id").agg(F.min_by("url", "seq").alias("url"))


# --- retrieval --------------------------------------------------------------------------

def _vector_queries(t: _Tables) -> DataFrame:
    """Every vector asks for its neighbours in its collection."""
    return t.vectors.select(F.col("id").alias("query_id"), "collection", "embedding")


@query
def vector_topk(spark, sf_dir):
    t = _tables(spark, sf_dir)
    return retrieval.vector_topk(_vector_queries(t), t.vectors)


@query
def lecture_context(spark, sf_dir):
    t = _tables(spark, sf_dir)
    texts = t.lectures.select(
        F.col("lecture_id").alias("id"), "lecture_date", F.lit("transcript").alias("source"),
        F.col("transcript").alias("document"),
    )
    return retrieval.context_text(_vector_queries(t), t.vectors.join(texts, "id"))


@query
def hashed_vectors(spark, sf_dir):
    embed = hashed_embedding()
    rows = _tables(spark, sf_dir).lectures.select("lecture_id", embed(F.col("transcript")).alias("v"))
    # outer: a plain explode would add a size test below, which runs the embedding a second time
    return rows.select("lecture_id", F.posexplode_outer("v").alias("dim", "x")).where(F.col("x") > 0).withColumn(
        "x", F.round("x", 6)
    )


@query
def index_lectures(spark, sf_dir):
    return retrieval.index_lectures(_tables(spark, sf_dir).sourced).select(*INDEX_COLUMNS, _signature())


def _signature():
    """Position-weighted sum of a vector's parts, to compare embeddings as one number."""
    parts = F.transform("embedding", lambda x, i: x * (i + 1))
    return F.round(F.aggregate(parts, F.lit(0.0), lambda a, x: a + x), 4).alias("embedding_sum")


@query
def index_pages(spark, sf_dir):
    t = _tables(spark, sf_dir)
    files = t.files.withColumnRenamed("id", "file_id")
    pages = retrieval.page_lectures(t.page_text, files, F.col("course"))
    return retrieval.index_lectures(pages).select(*INDEX_COLUMNS, _signature())


# --- scalar functions -------------------------------------------------------------------

@query
def title_date(spark, sf_dir):
    return _tables(spark, sf_dir).titles.select("id", T.title_date("title").alias("lecture_date"))


@query
def stem_date(spark, sf_dir):
    return _tables(spark, sf_dir).files.select("id", T.stem_date("stem").alias("lecture_date"))


@query
def notes_name(spark, sf_dir):
    suffix = F.when(F.col("id") % 3 == 0, F.lit("Part: 1")).when(F.col("id") % 3 == 1, F.lit(""))
    return _tables(spark, sf_dir).titles.select(
        "id", T.notes_name(F.col("course"), F.col("given_date"), suffix).alias("file_name")
    )


@query
def collection_name(spark, sf_dir):
    return _tables(spark, sf_dir).titles.select("id", T.collection_name("course").alias("collection"))


@query
def clock_label(spark, sf_dir):
    return _tables(spark, sf_dir).frame_scores.select(
        "ord", T.clock("timestamp_sec").alias("clock"), T.minute_tag("timestamp_sec").alias("minute")
    )


# --- prompts ----------------------------------------------------------------------------

@query
def prompt_table(spark, sf_dir):
    t = _tables(spark, sf_dir)
    aligned = written(t.noted_aligned, "aligned")
    return prompts.prompt_table(t.noted_lectures, aligned, t.figures, chunk_words=PROMPT_WORDS)


@query
def prompt_table_whole(spark, sf_dir):
    """The prompt table with chunks of the default size."""
    t = _tables(spark, sf_dir)
    return prompts.prompt_table(t.noted_lectures, written(t.noted_aligned, "aligned"), t.figures)


@query
def prompt_table_context(spark, sf_dir):
    """Prompts with context: every lecture asks the index of all lectures of its course."""
    t = _tables(spark, sf_dir)
    index = written(retrieval.index_lectures(t.sourced), "index")
    asked = retrieval.lecture_queries(t.lectures)
    aligned = written(t.noted_aligned, "aligned")

    def contexts(rows: DataFrame) -> DataFrame:
        named = rows.withColumnRenamed("lecture_id", "query_id")
        return retrieval.context_text(asked, index, rows=named).withColumnRenamed("query_id", "lecture_id")

    return prompts.prompt_table(t.noted_lectures, aligned, t.figures, contexts, chunk_words=PROMPT_WORDS)


# --- streaming --------------------------------------------------------------------------

def _stream(spark: SparkSession, sf_dir: str, table: str) -> DataFrame:
    """A driver table read as a stream of files."""
    schema = spark.read.parquet(f"{sf_dir}/{table}.parquet").schema
    return spark.readStream.schema(schema).option("pathGlobFilter", f"{table}.parquet").parquet(sf_dir)


def _run_batches(inputs: list[tuple[DataFrame, list]], start: Callable[..., StreamingQuery], purpose: str) -> None:
    """Run a streaming job as rows arrive: of each input the rows of one condition after the other.

    Every batch is written by all tasks of its scan; the job then takes up all files it has not seen as one micro-batch.
    """
    spark = inputs[0][0].sparkSession
    paths = [shared_dir(spark, purpose) for _ in inputs]
    for k in range(len(inputs[0][1])):
        for path, (df, batches) in zip(paths, inputs):
            df.where(batches[k]).write.parquet(f"{path}/batch={k}")
        streams = [spark.readStream.schema(df.schema).parquet(f"{path}/batch=*") for path, (df, _) in zip(paths, inputs)]
        start(*streams).awaitTermination()


def _thirds(number: Column) -> Column:
    """0, 1 or 2 for every row, also with a null or negative number."""
    return F.pmod(F.coalesce(number, F.lit(0)), F.lit(3))


def _ranges(place: Column, bounds: list) -> list[Column]:
    """Conditions for the ranges that ascending bounds end, one of which every row meets; null is in the first."""
    over = [F.coalesce(place > bound, F.lit(False)) for bound in bounds]
    return [~over[0], *(a & ~b for a, b in zip(over, over[1:])), over[-1]]


def _scores(events: DataFrame) -> DataFrame:
    return events.select(F.col("user_id").alias("lecture_id"), F.col("event_id").alias("ord"), F.col("value").alias("score"))


@query
def change_points_stream(spark, sf_dir):
    """Change points of a stream whose rows arrive late: every third row first, then the rest."""
    scores = _scores(spark.read.parquet(f"{sf_dir}/events.parquet"))
    third, path = _thirds(F.col("ord")), shared_dir(spark, "changes-stream")
    _run_batches(
        [(scores, [third == 0, third == 2, third == 1])],
        lambda series: jobs.change_batches(series, CHANGE_THRESHOLD, path, f"{path}/checkpoint"), "late-scores",
    )
    return jobs.kept_changes(spark, path)


@query
def change_points_batches(spark, sf_dir):
    path = shared_dir(spark, "changes-batches")
    series = _scores(_stream(spark, sf_dir, "events"))
    jobs.change_batches(series, CHANGE_THRESHOLD, path, f"{path}/checkpoint").awaitTermination()
    return jobs.kept_changes(spark, path)


@query
def index_upsert_stream(spark, sf_dir):
    """The index of lectures that arrive in three batches."""
    rows = spark.read.parquet(f"{sf_dir}/documents.parquet").select(
        F.col("doc_id").alias("lecture_id"), F.col("source").alias("course"),
        F.expr("CAST(DATE '2024-01-01' + CAST(doc_id % 365 AS INT) AS STRING)").alias("lecture_date"),
        F.lit("transcript").alias("source"), F.col("text").alias("transcript"),
    )
    thirds = rows.select(F.percentile_approx("lecture_id", [1 / 3, 2 / 3]).alias("p"))
    low, high = thirds.select(F.col("p")[0]).scalar(), thirds.select(F.col("p")[1]).scalar()
    path = shared_dir(spark, "index-stream")
    _run_batches(
        [(rows, _ranges(F.col("lecture_id"), [low, high]))],
        lambda series: jobs.index_stream(series, f"{path}/index", f"{path}/checkpoint"), "new-lectures",
    )
    return keyed.read_table(spark, f"{path}/index").select(*INDEX_COLUMNS, _signature())


@query
def align_stream(spark, sf_dir):
    """Alignment of streams with segments that span a lecture and lectures that arrive after later ones."""
    t = _tables(spark, sf_dir)
    late = _thirds(F.col("lecture_id")) == 1
    path = shared_dir(spark, "align-stream")
    _run_batches(
        [(t.ocr_frames, [~late, late]), (t.long_segments, [late, ~late])],
        lambda frames, segments: jobs.align_stream(frames, segments, path, f"{path}/checkpoint"), "frames-and-segments",
    )
    return jobs.aligned_frames(spark, path)
