"""Every registered query next to its check SQL on the smallest tables, and the shapes of plans."""

import os
import re
import shutil
import subprocess
import sys
from pathlib import Path

import duckdb
import pytest

import __spark_entry__ as entry
from chalkline.operators import lookups
from chalkline.plans.fixtures import view
from chalkline.plans.oracles import ORACLES as SQL
from chalkline.plans.queries import QUERIES

SF = "/root/testdata/sf0.001"
TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations"


@pytest.fixture(scope="module")
def db():
    con = duckdb.connect()
    for table in TABLES.split():
        con.sql(f"CREATE VIEW {table} AS SELECT * FROM '{SF}/{table}.parquet'")
    return con


def rows_of(columns, rows):
    order = sorted(range(len(columns)), key=lambda i: columns[i])
    return sorted((tuple(r[i] for i in order) for r in rows), key=repr)


def test_every_query_has_check_sql():
    assert sorted(QUERIES) == sorted(SQL)


@pytest.mark.parametrize("name", sorted(QUERIES))
def test_query_equals_check_sql(spark, db, name):
    df = QUERIES[name](spark, SF)
    result = db.execute(SQL[name])
    columns = [d[0] for d in result.description]
    assert sorted(df.columns) == sorted(columns)
    got = rows_of(df.columns, df.collect())
    assert got and got == rows_of(columns, result.fetchall())


COPY = """
import sys
sys.path.insert(0, {copy!r})
import __spark_entry__ as entry
print(*sorted(entry.queries()))
print(*sorted(entry.oracle_sql()))
"""


@pytest.mark.parametrize("gone", [("chalkline/llm", "tests/llm"), ("chalkline/llm", "tests/llm", "corpus_pipeline.py")])
def test_entry_without_training_data_operators(tmp_path, gone):
    """A copy of the repository without their folders, in a process of its own."""
    left = shutil.ignore_patterns(".git", "__pycache__", *(Path(g).name for g in gone))
    copy = tmp_path / "copy"
    shutil.copytree(Path(entry.__file__).parent, copy, ignore=left)
    run = subprocess.run(
        [sys.executable, "-c", COPY.format(copy=str(copy))], cwd=tmp_path, capture_output=True, text=True,
        env={k: v for k, v in os.environ.items() if k != "PYTHONPATH"},
    )
    assert run.returncode == 0, run.stderr
    assert [line.split() for line in run.stdout.splitlines()] == [sorted(QUERIES), sorted(SQL)]


def test_entry(spark):
    assert entry.entry(spark).columns == ["lecture_id", "chunk_idx", "prompt"]


def test_views_leave_no_rows_out(spark):
    big = "/root/testdata/sf0.1"
    read = lambda name: spark.read.parquet(f"{big}/{name}.parquet")
    asked = view(spark, big, "queries")
    assert asked.select("query").distinct().count() == read("benchmark").select("text").distinct().count()
    assert asked.count() == read("documents").count()
    spoken = view(spark, big, "long_segments")
    assert spoken.count() == read("conversations").count()
    assert spoken.select("lecture_id").distinct().count() == read("conversations").select("conv_id").distinct().count()


def plan(spark, name):
    return QUERIES[name](spark, SF)._jdf.queryExecution().executedPlan().toString()


IN_PYTHON = {
    "change_points", "scene_changes", "hashed_vectors", "index_lectures", "index_pages", "index_upsert",
    "index_upsert_stream", "vector_topk", "lecture_context", "prompt_table_context",
}


@pytest.mark.parametrize("name", sorted(set(QUERIES) - IN_PYTHON - {"segments_scan", "notes_upsert", "align_stream"}))
def test_no_python_and_no_cross_join(spark, name):
    text = plan(spark, name)
    assert not re.search(r"Python|InPandas|CartesianProduct|BroadcastNestedLoopJoin", text)


def test_topk_limits_before_the_shuffle(spark):
    assert "WindowGroupLimit" in plan(spark, "top_candidates")


def test_passages_are_ranked_without_a_shuffle_of_windows(spark):
    asked = spark.createDataFrame([], "query_id bigint, lecture_id bigint, query string")  # without the view that binds items to lectures
    found = lookups.search_passages(view(spark, SF, "lectures"), asked)
    text = found._jdf.queryExecution().executedPlan().toString()
    assert "Window" not in text and "Aggregate" not in text and text.count("Generate") == 1


def test_scans_read_only_what_they_need(spark):
    assert re.search(r"ReadSchema: struct<event_id:bigint,user_id:bigint,value:double>", plan(spark, "top_candidates"))
    assert "PushedFilters: [IsNotNull(role), EqualTo(role,assistant)" in plan(spark, "ocr_distinct")
