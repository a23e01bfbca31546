"""Nearest vectors by cosine over a hierarchical k-means tree with best-bin-first traversal.

The tree is fitted on a bounded sample; every row is filed under its leaf. A query takes leaves off a priority
queue of nodes, nearest centre first, and widens its visit to as many leaves as calibration queries, whose
true neighbours are known from brute force over all rows, need for the recall asked for. Rows of a leaf are held in
blocks, so a leaf of any size is many tasks. Scores are exact cosines of the original vectors.
"""

from __future__ import annotations

import heapq
import math
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from chalkline.session import written

SAMPLE_ROWS = 20_000
CALIBRATION_QUERIES = 200
BRANCH = 8
LEAF_ROWS = 512
RECALL = 0.97
BLOCK_ROWS = 4096
#: What the order of sums may change in a dot product of unit vectors.
_SLACK = 1e-9


def _kmeans(x: np.ndarray, k: int, rng: np.random.Generator, rounds: int = 12) -> np.ndarray:
    centres = x[rng.choice(len(x), k, replace=False)]
    for _ in range(rounds):
        own = np.argmax(x @ centres.T - 0.5 * (centres**2).sum(1), axis=1)
        held = np.bincount(own, minlength=k)
        sums = np.zeros_like(centres)
        np.add.at(sums, own, x)
        moved = np.where(held[:, None] > 0, sums / np.maximum(held, 1)[:, None], centres)
        if np.allclose(moved, centres):
            break
        centres = moved
    return centres


@dataclass
class Tree:
    """children[i] are the nodes below node i (none: a leaf); node 0 is the root."""

    centres: np.ndarray
    children: list[np.ndarray]
    leaf_no: np.ndarray  # number of a leaf, -1 for inner nodes

    @property
    def leaves(self) -> int:
        return int(self.leaf_no.max()) + 1

    @classmethod
    def fit(cls, x: np.ndarray, branch: int = BRANCH, leaf_rows: int = LEAF_ROWS, seed: int = 7) -> Tree:
        """A tree over unit vectors; a node of at most ``leaf_rows`` or of equal vectors is a leaf."""
        rng = np.random.default_rng(seed)
        centres, children, todo = [x.mean(axis=0)], [np.zeros(0, np.int64)], [(0, np.arange(len(x)))]
        while todo:
            node, rows = todo.pop()
            if len(rows) <= leaf_rows or (x[rows] == x[rows[0]]).all():
                continue
            found = _kmeans(x[rows], min(branch, len(rows)), rng)
            own = np.argmax(x[rows] @ found.T - 0.5 * (found**2).sum(1), axis=1)
            kinds = np.unique(own)
            if len(kinds) < 2:
                continue
            below = []
            for kind in kinds:
                below.append(len(centres))
                centres.append(found[kind])
                children.append(np.zeros(0, np.int64))
                todo.append((below[-1], rows[own == kind]))
            children[node] = np.array(below)
        leaf_no = np.full(len(centres), -1)
        ends = [i for i, c in enumerate(children) if not len(c)]
        leaf_no[ends] = np.arange(len(ends))
        return cls(np.array(centres), children, leaf_no)

    def assign(self, x: np.ndarray) -> np.ndarray:
        """The leaf of every vector, by the nearest child at each level."""
        at = np.zeros(len(x), np.int64)
        todo = [0] if len(x) else []
        while todo:
            node = todo.pop()
            below = self.children[node]
            if not len(below):
                continue
            rows = np.flatnonzero(at == node)
            c = self.centres[below]
            at[rows] = below[np.argmax(x[rows] @ c.T - 0.5 * (c**2).sum(1), axis=1)]
            todo += np.unique(at[rows]).tolist()
        return self.leaf_no[at]

    def traverse(self, q: np.ndarray) -> Iterator[int]:
        """Leaves in best-bin-first order."""
        queue = [(0.0, 0)]
        while queue:
            _, node = heapq.heappop(queue)
            below = self.children[node]
            if not len(below):
                yield int(self.leaf_no[node])
            else:
                far = ((self.centres[below] - q) ** 2).sum(axis=1)
                for d, child in zip(far.tolist(), below.tolist()):
                    heapq.heappush(queue, (d, child))


def _unit(x: np.ndarray) -> np.ndarray:
    return x / np.sqrt((x * x).sum(axis=1))[:, None]


def _matrix(column: pa.Array) -> np.ndarray:
    """Rows of a list column as one matrix."""
    n = len(column)
    return column.flatten().to_numpy(zero_copy_only=False).astype(np.float64).reshape(n, -1) if n else np.zeros((0, 1))


def usable(vector: Column) -> Column:
    """Whether a vector takes part: not null or empty, all components finite, length above zero."""
    v = F.transform(vector, lambda x: x.cast("double"))
    finite = F.forall(v, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < math.inf))
    square = F.aggregate(v, F.lit(0.0), lambda a, x: a + x * x)
    return F.coalesce(finite & (square > 0) & (square < math.inf), F.lit(False))


def best_rows(q_ids: np.ndarray, q: np.ndarray, ids: np.ndarray, x: np.ndarray, k: int) -> list[tuple[int, int, float]]:
    """(query, id, cosine) of each query's k best rows, ties to smaller ids, its own id left out.

    A fast product picks the rows that may be among the k best; their cosines are then summed in a fixed order, so that equal vectors
    have equal scores.
    """
    out = []
    unit, q_unit = _unit(x), _unit(q)
    norms, q_norms = np.sqrt((x * x).sum(axis=1)), np.sqrt((q * q).sum(axis=1))
    for at in range(0, len(q), 256):
        close = q_unit[at : at + 256] @ unit.T
        close[q_ids[at : at + 256, None] == ids[None, :]] = -np.inf
        for i, row in enumerate(close, at):
            low = np.partition(row, len(row) - k)[len(row) - k] if len(row) > k else -np.inf
            may = np.flatnonzero((row >= low - _SLACK) & (row > -np.inf))
            score = (x[may] * q[i]).sum(axis=1) / (norms[may] * q_norms[i])
            for j in np.lexsort((ids[may], -score))[:k]:
                out.append((int(q_ids[i]), int(ids[may[j]]), float(score[j])))
    return out


def _pairs(rows: list[tuple[int, int, float]]) -> pa.Table:
    columns = list(zip(*rows)) or [[], [], []]
    kinds = (pa.int64(), pa.int64(), pa.float64())
    return pa.table([pa.array(c, t) for c, t in zip(columns, kinds)], ["query_id", "vec_id", "score"])


_FOUND = "query_id long, vec_id long, score double"


def _ranked(found: DataFrame, k: int) -> DataFrame:
    order = Window.partitionBy("query_id").orderBy(F.desc("score"), "vec_id")
    return found.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= k)


def brute_force(rows: DataFrame, q_ids: np.ndarray, q: np.ndarray, k: int) -> DataFrame:
    """The true k best of a bounded set of queries over all rows (vec_id, v), in blocks of rows."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if batch.num_rows:
                ids, x = batch.column(0).to_numpy(), _matrix(batch.column(1))
                yield from _pairs(best_rows(q_ids, q, ids, x, k)).to_batches()

    return _ranked(rows.select("vec_id", "v").mapInArrow(run, _FOUND), k)


def calibrated_visits(tree: Tree, q: np.ndarray, wanted: list[list[int]], recall: float) -> int:
    """The least number of leaves that, visited best bin first, hold a share ``recall`` of the true neighbours.

    ``wanted`` has the leaves of each query's true neighbours. Visits widen until the last of them is met.
    """
    met = []
    for x, leaves in zip(q, wanted):
        left = list(leaves)
        for visit, leaf in enumerate(tree.traverse(x), 1):
            met += [visit] * left.count(leaf)
            left = [w for w in left if w != leaf]
            if not left:
                break
    if not met:
        return tree.leaves
    return int(sorted(met)[math.ceil(recall * len(met)) - 1])


def leaves_to_visit(tree: Tree, x: np.ndarray, visits: int, leaf_rows: dict[int, int], least: int) -> list[int]:
    """The first ``visits`` leaves, and more until they hold ``least`` rows or there are no more."""
    order, held = [], 0
    for leaf in tree.traverse(x):
        if len(order) >= visits and held >= least:
            break
        order.append(leaf)
        held += leaf_rows.get(leaf, 0)
    return order


def nearest(
    vectors: DataFrame, is_query: Column, k: int = 5, recall: float = RECALL, sample_rows: int = SAMPLE_ROWS,
    calibration: int = CALIBRATION_QUERIES, block_rows: int = BLOCK_ROWS, vector: str = "embedding", key: str = "vec_id",
) -> DataFrame:
    """(query_id, rank, vec_id, score): the k nearest rows found for every row that ``is_query`` selects.

    The index holds every row; ``sample_rows`` bounds what the tree is fitted on and ``calibration`` the queries that set how far
    it is searched. Vectors that are null, empty, zero or hold a null or non-finite component take no part, nor do those
    whose number of components is not the most frequent one, or whose key is null. Keys are expected to be unique: rows that repeat
    a key are candidates each of their own, and none is a candidate for a query of that key. Other columns are
    ignored; an empty table gives no rows.
    """
    spark = vectors.sparkSession
    schema = "query_id long, rank int, vec_id long, score double"
    good = vectors.where(usable(F.col(vector)) & F.col(key).isNotNull()).select(
        F.col(key).cast("long").alias("vec_id"), F.transform(vector, lambda x: x.cast("double")).alias("v"),
        F.coalesce(is_query, F.lit(False)).alias("asks"),
    )
    widths = good.groupBy(F.size("v").alias("width")).count().orderBy(F.desc("count"), "width").limit(1).collect()
    if not widths:
        return spark.createDataFrame([], schema)
    good = good.where(F.size("v") == widths[0].width)

    fitted = good.orderBy(F.xxhash64("vec_id"), "vec_id").limit(sample_rows).select("vec_id", "v").toArrow()
    x = _matrix(fitted.column(1).combine_chunks())
    tree = Tree.fit(_unit(x))
    trial_ids, trial = fitted.column(0).to_numpy()[:calibration], x[:calibration]

    def file_rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            leaves = tree.assign(_unit(_matrix(batch.column(1)))) if batch.num_rows else np.zeros(0, np.int64)
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(leaves, pa.int64())], [*batch.schema.names, "leaf"])

    index = written(good.mapInArrow(file_rows, "vec_id long, v array<double>, asks boolean, leaf long"), "vector-index")
    truth = brute_force(index, trial_ids, trial, k)
    leaves = {r.query_id: r.leaves for r in truth.join(index.select("vec_id", "leaf"), "vec_id").groupBy("query_id").agg(F.collect_list("leaf").alias("leaves")).collect()}
    visits = calibrated_visits(tree, _unit(trial), [leaves.get(int(i), []) for i in trial_ids], recall)

    # a query's own key is no candidate, however often it is repeated
    leaf_rows = {r.leaf: r["count"] for r in index.groupBy("leaf").count().collect()}
    own = index.groupBy("vec_id").agg(F.count("*").alias("own"))
    asking = index.where("asks").select("vec_id", "v").join(own, "vec_id")

    def visit(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            units = _unit(_matrix(batch.column(1))) if batch.num_rows else []
            for i, u in enumerate(units):
                order = leaves_to_visit(tree, u, visits, leaf_rows, k + batch.column(2)[i].as_py())
                yield pa.RecordBatch.from_arrays(
                    [pa.array(order, pa.int64()), batch.column(0).take(pa.array([i] * len(order))), batch.column(1).take(pa.array([i] * len(order)))],
                    ["leaf", "query_id", "q"],
                )

    asked = asking.mapInArrow(visit, "leaf long, query_id long, q array<double>")

    # rows of a leaf in blocks, its queries in blocks: every pair of blocks is one task
    sizes = index.groupBy("leaf").agg(F.ceil(F.count("*") / block_rows).cast("long").alias("blocks"))
    loads = asked.groupBy("leaf").agg(F.ceil(F.count("*") / block_rows).cast("long").alias("loads"))
    grid = sizes.join(loads, "leaf")
    filed = index.join(grid, "leaf").select(
        "leaf", F.pmod(F.xxhash64("vec_id"), F.col("blocks")).alias("block"),
        F.explode(F.sequence(F.lit(0).cast("long"), F.col("loads") - 1)).alias("load"), "vec_id", "v",
    )
    sent = asked.join(grid, "leaf").select(
        "leaf", F.explode(F.sequence(F.lit(0).cast("long"), F.col("blocks") - 1)).alias("block"),
        F.pmod(F.xxhash64("query_id"), F.col("loads")).alias("load"), "query_id", "q",
    )
    names = ("leaf", "block", "load")

    def meet(rows: pa.Table, queries: pa.Table) -> pa.Table:
        if not rows.num_rows or not queries.num_rows:
            return _pairs([])
        ids, v = rows.column("vec_id").to_numpy(), _matrix(rows.column("v").combine_chunks())
        q_ids, q = queries.column("query_id").to_numpy(), _matrix(queries.column("q").combine_chunks())
        return _pairs(best_rows(q_ids, q, ids, v, k))

    found = filed.groupBy(*names).cogroup(sent.groupBy(*names)).applyInArrow(meet, _FOUND)
    return _ranked(found, k).select("query_id", F.col("rank").cast("int").alias("rank"), "vec_id", "score")
