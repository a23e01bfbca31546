"""Tree search next to brute force."""

import math

import numpy as np
import pytest
from pyspark.sql import functions as F

from chalkline.llm import vector_search as V

K = 5


def true_nearest(rows, asks, k=K):
    out = {}
    for qid, q in rows:
        if not asks(qid):
            continue
        found = []
        for vid, v in rows:
            if vid != qid:
                score = (q * v).sum() / (np.sqrt((q * q).sum()) * np.sqrt((v * v).sum()))
                found.append((-score, vid))
        out[qid] = sorted(found)[:k]
    return out


@pytest.fixture(scope="module")
def clustered():
    rng = np.random.default_rng(5)
    centres = rng.normal(size=(12, 16))
    rows = [(i, (centres[rng.integers(12)] * (1 if i % 3 else 0.2) + 0.3 * rng.normal(size=16))) for i in range(3000)]
    return rows + [(3000 + i, rows[7][1]) for i in range(12)]  # copies of one vector


def table(spark, rows):
    return spark.createDataFrame([(i, [float(x) for x in v], "x") for i, v in rows], "vec_id long, embedding array<double>, score string")


def test_recall_and_exact_scores(spark, clustered):
    found = V.nearest(table(spark, clustered), F.col("vec_id") % 50 == 0, K, block_rows=64).collect()
    want = true_nearest(clustered, lambda i: i % 50 == 0)
    assert len(found) == K * len(want)
    hits = 0
    vectors = dict(clustered)
    for q in want:
        rows = sorted((r for r in found if r.query_id == q), key=lambda r: r.rank)
        assert [r.rank for r in rows] == list(range(1, K + 1))
        assert rows == sorted(rows, key=lambda r: (-r.score, r.vec_id))
        for r in rows:
            a, b = vectors[q], vectors[r.vec_id]
            assert math.isclose(r.score, a @ b / math.sqrt((a @ a) * (b @ b)), rel_tol=1e-12)
        hits += len({r.vec_id for r in rows} & {v for _, v in want[q]})
    assert hits >= 0.9 * K * len(want)


def test_ties_go_to_smaller_ids(spark, clustered):
    found = V.nearest(table(spark, clustered), F.col("vec_id") == 7, K).collect()
    assert [r.vec_id for r in sorted(found, key=lambda r: r.rank)] == [3000, 3001, 3002, 3003, 3004]


def test_odd_vectors_take_no_part(spark):
    nan, inf = float("nan"), float("inf")
    rows = [
        (0, [1.0, 0.0]), (1, [1.0, 1.0]), (2, None), (3, []), (4, [0.0, 0.0]), (5, [nan, 1.0]), (6, [inf, 1.0]),
        (7, [None, 1.0]), (8, [1.0, 2.0, 3.0]), (None, [1.0, 0.0]), (9, [-2.0, 0.0]),
    ]
    vectors = spark.createDataFrame(rows, "vec_id long, embedding array<double>")
    found = sorted((r.query_id, r.rank, r.vec_id, round(r.score, 12)) for r in V.nearest(vectors, F.lit(True), K).collect())
    half = round(math.sqrt(0.5), 12)
    assert found == [(0, 1, 1, half), (0, 2, 9, -1.0), (1, 1, 0, half), (1, 2, 9, -half), (9, 1, 1, -half), (9, 2, 0, -1.0)]


def test_empty_and_single(spark):
    empty = spark.createDataFrame([], "vec_id long, embedding array<float>")
    assert V.nearest(empty, F.lit(True)).count() == 0
    assert V.nearest(spark.createDataFrame([(1, [1.0])], "vec_id long, embedding array<double>"), F.lit(True)).count() == 0


def test_repeated_keys(spark):
    rows = spark.createDataFrame([(1, [1.0, 0.0]), (1, [1.0, 0.0]), (2, [1.0, 1.0]), (2, [1.0, 1.0])], "vec_id long, embedding array<double>")
    found = V.nearest(rows, F.col("vec_id") == 1, K).collect()
    assert {r.vec_id for r in found} == {2}


def test_traversal_meets_every_leaf_once(clustered):
    x = V._unit(np.array([v for _, v in clustered]))
    tree = V.Tree.fit(x, 16, 64)
    order = list(tree.traverse(x[0]))
    assert sorted(order) == list(range(tree.leaves)) and tree.leaves > 20
    assert tree.assign(x).max() < tree.leaves


def test_small_leaves_are_not_enough(spark):
    rng = np.random.default_rng(8)
    rows = [(i, np.eye(8)[i % 4] + 0.01 * rng.normal(size=8)) for i in range(400)]
    outliers = [(1000 + i, np.eye(8)[4 + i] + 0.01 * rng.normal(size=8)) for i in range(3)]
    repeated = [(1000, outliers[0][1])] * 7
    fit = V.Tree.fit
    with pytest.MonkeyPatch.context() as patch:
        # leaves of a few rows, and a calibration that ends at the first
        patch.setattr(V.Tree, "fit", staticmethod(lambda x: fit(x, leaf_rows=8)))
        patch.setattr(V, "calibrated_visits", lambda *_: 1)
        found = V.nearest(table(spark, rows + outliers + repeated), F.col("vec_id") >= 1000, K).collect()
    for q in {1000, 1001, 1002}:
        assert sorted(r["rank"] for r in found if r.query_id == q) == list(range(1, K + 1))
        assert q not in {r.vec_id for r in found if r.query_id == q}
    few = V.nearest(table(spark, rows[:3]), F.lit(True), K).collect()
    assert len(few) == 3 * 2
