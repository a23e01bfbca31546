"""Retrieval, passage search and lookups against brute force; prompts and merged documents."""

import random
import tracemalloc

import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

from chalkline import fixed_values as V
from chalkline.functions.vectors import hashed_embedding
from chalkline.operators import lookups, prompts, retrieval

LECTURE = "lecture_id bigint, course string, lecture_date string, source string, transcript string"


def vectors(rng, n, hot_share=0.4):
    out = []
    for i in range(n):
        v = rng.normal(size=8)
        collection = "hot" if rng.random() < hot_share else f"c{int(rng.integers(0, 4))}"
        out.append((collection, f"id{i:05d}", [float(x) for x in v / np.linalg.norm(v)], int(rng.integers(0, 100))))
    out[5] = (out[4][0], out[5][1], out[4][2], out[5][3])  # equal vectors: the id decides
    return out


@pytest.mark.parametrize("block_bytes", [1000, 1 << 25])
@pytest.mark.parametrize("dated", [False, True])
def test_topk_equals_scan_with_a_hot_collection(spark, monkeypatch, block_bytes, dated):
    monkeypatch.setattr(retrieval, "QUERY_BLOCK_BYTES", block_bytes)
    monkeypatch.setattr(retrieval, "INDEX_BLOCK_BYTES", 6 * block_bytes)
    rows = vectors(np.random.default_rng(1), 400)
    day = F.date_add(F.lit("2024-01-01").cast("date"), F.col("day"))
    index = spark.createDataFrame(rows, "collection string, id string, embedding array<double>, day int").withColumn("lecture_day", day)
    asked = index.where("substr(id, 6, 1) < '4'").select(F.col("id").alias("query_id"), "collection", "embedding", "lecture_day")
    asked = asked.withColumnRenamed("lecture_day", "before_day") if dated else asked.drop("lecture_day")
    got = {}
    for r in retrieval.vector_topk(asked, index, 3).collect():
        got.setdefault(r.query_id, []).append((r.rank, r.distance, r.id))
    by_id = {r[1]: r for r in rows}
    for q in (r.query_id for r in asked.collect()):
        collection, _, v, d = by_id[q]
        pool = [r for r in rows if r[0] == collection and (not dated or r[3] < d)]
        near = sorted((round(float(((np.array(r[2]) - np.array(v)) ** 2).sum()), 6), r[1]) for r in pool)[:3]
        assert [(x[1], x[2]) for x in sorted(got.get(q, []))] == near


def test_dated_queries_need_a_dated_index(spark):
    index = spark.createDataFrame([("a", "1", [1.0])], "collection string, id string, embedding array<double>")
    asked = index.select(F.col("id").alias("query_id"), "collection", "embedding", F.current_date().alias("before_day"))
    with pytest.raises(ValueError, match="lecture_day"):
        retrieval.vector_topk(asked, index)


def test_indexed_courses(spark):
    index = spark.createDataFrame([("signals_course",), ("signals_course",)], "collection string")
    courses = spark.createDataFrame([("Signals Course",), ("signals-course",), ("other",)], "course string")
    assert sorted(r.course for r in retrieval.indexed_courses(courses, index).collect()) == ["Signals Course", "signals-course"]


def test_few_results_and_no_collection(spark):
    index = spark.createDataFrame(
        [("a", "1", [1.0], "d", "s", "text")],
        "collection string, id string, embedding array<double>, lecture_date string, source string, document string",
    )
    asked = spark.createDataFrame([(1, "a", [1.0]), (2, "b", [1.0])], "query_id bigint, collection string, embedding array<double>")
    got = {r.query_id: r.context for r in retrieval.context_text(asked, index).collect()}
    assert got == {1: "[Lecture d, s]\ntext", 2: ""}


@pytest.mark.parametrize("queries, size", [(3, 32 << 20), (10**6, 300), (10**6, 32 << 20)])
def test_contexts_reach_their_rows_by_blocks(spark, monkeypatch, queries, size):
    """Rows with contexts next to a join with contexts; a passage goes to a block once, and not to every query that found it."""
    monkeypatch.setattr(retrieval, "PASSAGE_BLOCK_QUERIES", queries)
    monkeypatch.setattr(retrieval, "PASSAGE_BLOCK_BYTES", size)
    moved, with_contexts = [], retrieval._with_contexts
    monkeypatch.setattr(retrieval, "_with_contexts", lambda r, p, own: (moved.append(p.count()), with_contexts(r, p, own))[1])
    rng = np.random.default_rng(3)
    index = [(f"c{i % 3}", f"id{i}", rng.normal(size=4).tolist(), f"day {i}", "s", f"passage {i} " * 5) for i in range(12)]
    index += [(*index[0][:5], "again under one id"), (None, "id", [0.0] * 4, "d", "s", "x"), ("c1", "id13", [9.0] * 4, None, "s", None)]
    asked = [(q, f"c{q % 4}", rng.normal(size=4).tolist()) for q in range(60)] + [(7, "c0", [1.0] * 4), (None, "c1", [1.0] * 4)]
    index_df = spark.createDataFrame(index, "collection string, id string, embedding array<double>, lecture_date string, source string, document string")
    asked_df = spark.createDataFrame(asked, "query_id bigint, collection string, embedding array<double>")
    texts = {}
    for c, i, _, day, source, document in index:
        texts.setdefault((c, i), []).append(f"[Lecture {day or 'null'}, {source}]\n{document or 'null'}")
    found = {}
    for r in retrieval.vector_topk(asked_df, index_df, 3).orderBy("rank").collect():
        found.setdefault(r.query_id, []).extend(sorted(texts[r.collection, r.id]))
    context = {q: V.BLOCK_SEPARATOR.join(found.get(q, []) if q is not None else []) for q, _, _ in asked}
    got = retrieval.context_text(asked_df, index_df, 3).collect()
    assert sorted(map(tuple, got), key=repr) == sorted(((q, context[q]) for q, _, _ in asked), key=repr)
    rows = [(q, n, [q]) for n, q in enumerate([*range(0, 70, 2), 7, 7, None, 10])]
    rows_df = spark.createDataFrame(rows, "query_id bigint, n int, more array<int>")
    twice = [(*r, context.get(r[0]) if r[0] is not None else None) for r in rows for _ in range(2 if r[0] == 7 else 1)]
    got = retrieval.context_text(asked_df, index_df, 3, rows=rows_df)
    assert got.columns == ["query_id", "n", "more", "context"]
    assert sorted(map(tuple, got.collect()), key=repr) == sorted(twice, key=repr)
    if queries > 60 and size > 300:
        assert max(moved) <= len(texts)


def lecture(spark, *rows):
    return spark.createDataFrame([(i, c, d, "transcript", t) for i, (c, d, t) in enumerate(rows)], LECTURE)


def documents(index):
    return {r.id: r.document for r in index.collect()}


def test_upsert_twice_is_once_and_keeps_old_tails(spark):
    old = retrieval.index_chunks(lecture(spark, ("A B", "2024-01-01", "a b c d"), ("Z", "x", "z")), size=2, overlap=0)
    new = retrieval.index_chunks(lecture(spark, ("A B", "2024-01-01", "x")), size=2, overlap=0)
    once = retrieval.upsert(old, new, ["lecture_id"])
    assert documents(once) == documents(retrieval.upsert(once, new, ["lecture_id"]))
    assert documents(once) == {"A B_2024-01-01_transcript_0": "x", "A B_2024-01-01_transcript_1": "c d", "Z_x_transcript_0": "z"}
    replaced = retrieval.upsert(old, new, ["lecture_id"], replace=True)
    assert documents(replaced) == {"A B_2024-01-01_transcript_0": "x", "Z_x_transcript_0": "z"}


def test_courses_with_one_safe_name_share_a_collection(spark):
    index = retrieval.index_chunks(lecture(spark, ("A B", "1", "x"), ("A-B", "1", "y")))
    assert {r.collection for r in index.collect()} == {"a_b"}
    assert [tuple(r) for r in retrieval.collection_counts(index).collect()] == [("a_b", 2)]


def test_hashed_vectors_have_unit_length(spark):
    df = spark.createDataFrame([("Some words, some MORE words",), ("",)], "t string")
    v = [np.array(r.v) for r in df.select(hashed_embedding(16)(F.col("t")).alias("v")).collect()]
    assert np.linalg.norm(v[0]) == pytest.approx(1.0) and np.linalg.norm(v[1]) == 0.0


def search(text, query):
    """Expected (start, score, position, passage) rows: one row per window that holds anything."""
    tokens, asked, rows = text.split(), query.lower().split(), []
    for start in range(0, len(tokens), 50):
        passage = " ".join(tokens[start:start + 100])
        score = len([w for w in asked if passage.lower().find(w) >= 0])
        rows.append((start, score, round(100 * start / len(tokens)), passage))
    return sorted((r for r in rows if r[1]), key=lambda r: (-r[1], r[0]))[:3]


def test_search_equals_scan(spark):
    rng = random.Random(8)
    stems = ["art", "start", "Smart", "of", "o", "the", "théâtre", "x=1", "(a)", "zebra"]
    texts = {i: " ".join(rng.choice(stems) + rng.choice(["", "s", ","]) for _ in range(rng.choice([0, 3, 60, 410]))) for i in range(6)}
    asked = {1: "art art", 2: "ZEB of", 3: "missing", 4: "theat é", 5: "x=1 (a start", 6: ""}
    lectures = spark.createDataFrame(list(texts.items()), "lecture_id bigint, transcript string")
    rows = [(10 * q + k, k, x) for q, x in asked.items() for k in texts]
    queries = spark.createDataFrame(rows, "query_id bigint, lecture_id bigint, query string")
    got = {}
    for r in lookups.search_passages(lectures, queries).collect():
        got.setdefault((r.query_id // 10, r.lecture_id), []).append((r["rank"], r.start, r.score, r.position_pct, r.passage))
    want = {(q, k): search(t, x) for q, x in asked.items() for k, t in texts.items()}
    assert {k: [x[1:] for x in sorted(v)] for k, v in got.items()} == {k: v for k, v in want.items() if v}


def test_repeated_query_words_and_half_even_position(spark):
    text = " ".join(["x"] * 60 + ["start"] + ["y"] * 339)
    lectures = spark.createDataFrame([(1, text)], "lecture_id bigint, transcript string")
    rows = lookups.search_passages(lectures, spark.createDataFrame([(1, 1, "art art")], "query_id bigint, lecture_id bigint, query string")).collect()
    assert sorted((r.start, r.score, r.position_pct) for r in rows) == [(0, 2, 0), (50, 2, 12)]


def test_calls_from_json(spark):
    inputs = [
        '{"query": "a \\"b\\"", "timestamp_seconds": 5}', '{"timestamp_seconds": 7.5, "window_seconds": "30", "more": [1]}',
        '{"query": null, "timestamp_seconds": "soon", "window_seconds": {}}', '{"query": 3}', "{}", "[1, 2]", '"text"', "not json", "", None,
    ]
    calls = spark.createDataFrame([(i, None, "x", t) for i, t in enumerate(inputs)], "call_id bigint, lecture_id bigint, tool string, input string")
    got = lookups.read_calls(calls).orderBy("call_id").collect()
    none = (None, None, None)
    assert [tuple(r)[3:] for r in got] == [('a "b"', 5.0, None), (None, 7.5, 30.0), none, ("3", None, None), *[none] * 6]
    assert got[0].asDict().keys() == {"call_id", "lecture_id", "tool", "query", "timestamp_seconds", "window_seconds"}


def test_dispatch(spark):
    lectures = spark.createDataFrame([(1, "alpha beta")], "lecture_id bigint, transcript string")
    aligned = spark.createDataFrame([(1, 0, 5.0, "s", "ocr")], "lecture_id bigint, frame_index int, timestamp_sec double, speech string, ocr_text string")
    figures = spark.createDataFrame([(1, 0, 7.4, "p", "c")], "lecture_id bigint, ord bigint, timestamp_sec double, latex_path string, caption string")
    calls = [
        (1, 1, "search_transcript", "BETA", 0.0, None), (2, 1, "search_transcript", "gamma", 0.0, None),
        (3, 1, "get_ocr_at_timestamp", None, 5.0, None), (4, 1, "get_figure_at_timestamp", None, 5.0, None), (5, 1, "other", None, 0.0, None),
        (6, 1, None, None, None, None), (7, 1, "get_ocr_at_timestamp", None, None, 4.0), (8, 1, "get_figure_at_timestamp", None, None, None),
    ]
    df = spark.createDataFrame(calls, "call_id bigint, lecture_id bigint, tool string, query string, timestamp_seconds double, window_seconds double")
    got = {r.call_id: r.result for r in lookups.dispatch(df, lectures, aligned, figures).collect()}
    assert got == {
        1: "[Position: ~0% through lecture]\nalpha beta", 2: V.NO_PASSAGES, 3: "[00:05] ocr",
        4: "Closest figure (2s away):\n  latex_path: p\n  caption: c\n  timestamp: 7.4s", 5: "Unknown tool: other",
        6: "Unknown tool: None", 7: "No OCR data found within 4.0s of timestamp 0s.",
        8: "Closest figure (7s away):\n  latex_path: p\n  caption: c\n  timestamp: 7.4s",
    }


def test_fixed_messages():
    """The texts that readers of the answers know, spelled out."""
    assert V.NO_PASSAGES == "No matching passages found for the query."
    assert V.NO_FIGURES == "No figures available."
    assert V.UNKNOWN_TOOL % "x" == "Unknown tool: x"
    assert V.BLOCK_SEPARATOR == "\n\n---\n\n"
    assert V.WHOLE_LECTURE_END_SEC == 9999.0 and V.RETRIEVAL_TOP == 5 and V.SEARCH_TOP == 3


def test_a_whole_prompt_spelled_out(spark):
    lectures = spark.createDataFrame([(1, "C", "D", "one two")], "lecture_id bigint, course string, lecture_date string, transcript string")
    aligned = spark.createDataFrame(
        [(1, 0, 65.0, "s", "E = m")], "lecture_id bigint, frame_index int, timestamp_sec double, speech string, ocr_text string"
    )
    figures = spark.createDataFrame([(1, 0, 61.0, "p", "c")], "lecture_id bigint, ord bigint, timestamp_sec double, latex_path string, caption string")
    contexts = spark.createDataFrame([(1, "CTX")], "lecture_id bigint, context string")
    assert prompts.prompt_table(lectures, aligned, figures, contexts).head().prompt == (
        "Convert the following lecture transcript into complete, comprehensive LaTeX notes.\n"
        "Write with a bookish, refined academic style — not a transcript dump, but polished notes a student would enjoy reading.\n"
        "Cover EVERY topic discussed — do not skip or summarise any part of the lecture.\n"
        "\nCourse: C\nDate: D\n\n--- FULL TRANSCRIPT ---\none two\n"
        "\n--- ADDITIONAL MATHEMATICAL CONTENT FROM SLIDES/BLACKBOARD ---\n"
        "(These are formulas and equations written by the professor that were NOT spoken aloud.\n"
        "Integrate them naturally into the notes where contextually appropriate.)\nE = m\n"
        "\n--- FIGURES TO INCLUDE ---\n"
        "The following figures have been extracted from the lecture slides/video.\n"
        "For each figure, insert it at the appropriate point in the notes using this LaTeX template:\n"
        "\n\\begin{{figure}}[h]\n\\centering\n\\includegraphics[width=0.6\\textwidth]{{LATEX_PATH}}\n\\caption{{CAPTION}}\n\\end{{figure}}\n"
        "\nReplace LATEX_PATH and CAPTION with the values below.\n"
        "Insert each figure near the section where the corresponding topic is discussed (use the timestamp as a guide).\n\n"
        "[01:01] latex_path=p caption=c\n"
        "\nCRITICAL: Use ONLY the exact latex_path values listed above. Never invent or modify figure filenames.\n"
        "\n--- CONTEXT FROM PREVIOUS LECTURES IN THIS COURSE ---\n"
        "(Use this context to maintain consistency with terminology, notation, and concepts\n"
        "introduced in previous lectures. Reference prior material where appropriate.)\nCTX\n"
        "\nProduce the complete .tex file now, covering the entire lecture:"
    )


def test_prompt_sections(spark):
    lectures = spark.createDataFrame(
        [(1, "C", "D", "one two three"), (2, "C", "D", None)], "lecture_id bigint, course string, lecture_date string, transcript string"
    )
    aligned = spark.createDataFrame(
        [(1, 0, 65.0, "s", "E = m"), (2, 0, 9.0, "second", ""), (2, 1, 4.0, "first", "")],
        "lecture_id bigint, frame_index int, timestamp_sec double, speech string, ocr_text string",
    )
    figures = spark.createDataFrame([(1, 0, 61.0, "p", "c")], "lecture_id bigint, ord bigint, timestamp_sec double, latex_path string, caption string")
    contexts = spark.createDataFrame([(1, "CTX"), (2, "")], "lecture_id bigint, context string")
    table = prompts.prompt_table(lectures, aligned, figures, contexts, chunk_words=2)
    got = {(r.lecture_id, r.chunk_idx): r.prompt for r in table.collect()}
    head = V.PROMPT_HEAD + "C\nDate: D" + V.PROMPT_TRANSCRIPT
    assert got == {
        (1, 0): head + "one two\n" + V.PROMPT_OCR_HEAD + "E = m\n" + V.PROMPT_FIGURES_HEAD
        + "[01:01] latex_path=p caption=c\n" + V.PROMPT_FIGURES_TAIL + V.PROMPT_CONTEXT_HEAD + "CTX\n" + V.PROMPT_TAIL,
        (1, 1): head + "three\n" + V.PROMPT_TAIL,
        (2, 0): head + "first second\n" + V.PROMPT_TAIL,
    }


def test_merge(spark):
    doc = "\\documentclass{x}\n\\begin{document}\n%s\n\\end{document}"
    rows = [(1, 0, "x"), (1, 1, "y"), (2, 0, doc % "a"), (2, 1, doc % "b"), (3, 0, "```latex\n" + doc % "c" + "\n```")]
    df = spark.createDataFrame(rows, "lecture_id bigint, chunk_idx int, raw string")
    got = {r.lecture_id: r.document for r in prompts.merge_responses(df).collect()}
    assert got[1] == V.DEFAULT_PREAMBLE + "\n\nx" + V.BODY_SEPARATOR + "y" + V.DOCUMENT_END
    assert got[2] == "\\documentclass{x}\n\\begin{document}\n\na" + V.BODY_SEPARATOR + "b" + V.DOCUMENT_END
    assert got[3] == doc % "c"


def test_log_errors(spark):
    df = spark.createDataFrame([("a", 2, "! B"), ("a", 1, "! A"), ("a", 3, "ok !"), ("b", 0, "fine")], "build_id string, line_no bigint, value string")
    got = {r.build_id: r.errors for r in prompts.log_errors(df).collect()}
    assert got == {"a": "! A\n! B", "b": V.UNKNOWN_BUILD_ERROR}


def _peak_mb(run):
    tracemalloc.start()
    try:
        run()
        return tracemalloc.get_traced_memory()[1] / 2**20
    finally:
        tracemalloc.stop()


def test_memory_of_a_block_of_distances_is_bounded():
    rng = np.random.default_rng(1)
    index = pd.DataFrame({"id": np.arange(20_000), "embedding": list(rng.random((20_000, 4)))})
    asked = pd.DataFrame({"query_id": np.arange(300), "embedding": list(rng.random((300, 4)))})
    found = []
    assert _peak_mb(lambda: found.append(retrieval._nearest(asked, index, 3))) < 60
    x, q = (np.stack(df["embedding"].to_numpy()) for df in (index, asked))
    d = np.round(((q[:, None, :] - x[None, :, :]) ** 2).sum(axis=2), 6)
    assert found[0]["id"].tolist() == np.argsort(d, axis=1, kind="stable")[:, :3].ravel().tolist()


def test_memory_of_a_batch_of_embeddings_is_bounded(spark):
    embed = hashed_embedding()
    count = next(c.cell_contents for c in embed.__closure__ if callable(c.cell_contents)).func
    rng = np.random.default_rng(2)
    buckets = pd.Series([rng.integers(0, 64, n, dtype=np.int32) for n in [500] * 6000 + [0, 3]])
    found = []
    assert _peak_mb(lambda: found.append(count(buckets))) < 20
    want = np.stack([np.bincount(b, minlength=64) for b in buckets]).astype(float)
    norms = np.sqrt((want**2).sum(axis=1))
    assert np.array_equal(np.stack(found[0]), want / np.where(norms > 0, norms, 1.0)[:, None])
