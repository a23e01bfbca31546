"""Change points of an ordered series: a row is kept if it differs from the last *kept* row.

The rule is sequential, but a block of rows acts on the last kept value in a compact way: an
entering value either survives the block or is replaced at the first row that differs from it,
and such a row is always a new maximum or minimum of the block so far. So one pass summarises
all blocks side by side, a short fold over the summaries tells each block what enters it, and a
second pass over the blocks, again side by side, marks the kept rows. A hot lecture is many
blocks; nothing but the summaries of one lecture ever meets in one row.
"""

from __future__ import annotations

from itertools import islice

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from chalkline.session import written

BLOCK_ROWS = 65536
BLOCK_KEY = ["lecture_id", "_block"]
_CHUNK = 256


def next_change(values: np.ndarray, start: int, last: float, threshold: float) -> int:
    """Index of the first value from ``start`` on that differs from ``last`` by more than the
    threshold; the length of the series if there is none."""
    n, size = len(values), _CHUNK
    while start < n:
        hits = np.abs(values[start : start + size] - last) > threshold
        if hits.any():
            return start + int(hits.argmax())
        start, size = start + size, size * 4
    return n


def kept_rows(values: np.ndarray, threshold: float, last: float | None) -> np.ndarray:
    """Mask of the kept rows of a series entered with ``last`` (None: keep the first row)."""
    mask = np.zeros(len(values), dtype=bool)
    at = 0 if last is None else next_change(values, 0, last, threshold)
    while at < len(values):
        mask[at] = True
        at = next_change(values, at + 1, values[at], threshold)
    return mask


def block_summary(values: np.ndarray, threshold: float) -> list[tuple[float, float]]:
    """(value, leaving value) rows: an entering value is replaced at the first listed value that
    differs from it by more than the threshold and the block is then left with the second."""
    running_max = np.maximum.accumulate(values)
    running_min = np.minimum.accumulate(values)
    # once the range exceeds twice the threshold, no entering value can have survived
    settled = np.flatnonzero(running_max - running_min > 2 * threshold * (1 + 1e-9))
    stop = int(settled[0]) + 1 if len(settled) else len(values)
    is_record = np.ones(stop, dtype=bool)
    is_record[1:] = (values[1:stop] > running_max[: stop - 1]) | (values[1:stop] < running_min[: stop - 1])

    leaves: dict[int, float] = {}
    summary: list[tuple[float, float]] = []
    for record in np.flatnonzero(is_record):
        path, at = [], int(record)
        while at < len(values) and at not in leaves:
            path.append(at)
            at = next_change(values, at + 1, values[at], threshold)
        leaving = leaves[at] if at < len(values) else float(values[path[-1]])
        leaves.update(dict.fromkeys(path, leaving))
        summary.append((float(values[record]), leaving))
    return _compact(summary)


def _compact(summary: list[tuple[float, float]]) -> list[tuple[float, float]]:
    """Of neighbouring entries with the same leaving value only the extremes matter."""
    out: list[tuple[float, float]] = []
    i = 0
    while i < len(summary):
        j = i
        while j < len(summary) and summary[j][1] == summary[i][1]:
            j += 1
        run = [v for v, _ in summary[i:j]]
        out += [(v, summary[i][1]) for v in dict.fromkeys((min(run), max(run)))]
        i = j
    return out


def apply_summary(summary: list[tuple[float, float]], entering: float, threshold: float) -> float:
    for value, leaving in summary:
        if abs(value - entering) > threshold:
            return leaving
    return entering


def change_points(
    series: DataFrame,
    threshold: float,
    value: str = "score",
    order: str = "ord",
    block_rows: int = BLOCK_ROWS,
    entering: DataFrame | None = None,
) -> DataFrame:
    """Kept rows of each lecture's series, as (lecture_id, ``order``, ``value``).

    ``order`` is an integer, distinct within the lecture; blocks are ranges of it. ``entering``
    (lecture_id, ``value``) is the last kept value where a series goes on from an earlier one.
    """
    schema = series.select("lecture_id", order, F.col(value).cast("double").alias(value)).schema
    blocked = series.select(
        "lecture_id", order, F.col(value).cast("double").alias(value),
        F.floor(F.col(order) / block_rows).alias("_block"),
    )
    if entering is None:
        blocked = blocked.withColumn("_start", F.lit(None).cast("double"))
    else:
        before = entering.select("lecture_id", F.col(value).cast("double").alias("_start"))
        blocked = blocked.join(before, "lecture_id", "left")

    # only lectures of several blocks need summaries
    spans = blocked.groupBy("lecture_id").agg(F.min("_block").alias("_b0"), F.max("_block").alias("_b1"))
    long_lectures = spans.where(F.col("_b0") < F.col("_b1")).select("lecture_id")

    summaries = block_summaries(blocked.join(long_lectures, "lecture_id", "left_semi"), threshold, value, order)
    entered = blocked.join(block_entries(summaries, threshold), BLOCK_KEY, "left")

    def mark(batches):
        parts: list[tuple] = []
        waiting = 0
        for key, orders, values in marked_blocks(batches, threshold, value, order):
            parts.append((np.full(len(orders), key[0]), orders, values))
            waiting += len(orders)
            if waiting > 8192:
                yield _frame(parts, ["lecture_id", order, value])
                parts, waiting = [], 0
        if parts:
            yield _frame(parts, ["lecture_id", order, value])

    return in_order(entered, BLOCK_KEY, [order]).mapInPandas(mark, schema)


def block_summaries(blocked: DataFrame, threshold: float, value: str, order: str) -> DataFrame:
    """One row per block of (lecture_id, _block, _start, ``order``, ``value``) rows: what leaves it when nothing
    entered (``first``), and the entries of :func:`block_summary` (``vs`` are followed by ``ls``)."""
    key_type = blocked.schema["lecture_id"].dataType.simpleString()

    def summarise(batches):
        def row(key, start, values):
            listed = block_summary(values, threshold)
            first = values[kept_rows(values, threshold, None)][-1]
            return (*key, start, first, [v for v, _ in listed], [leaving for _, leaving in listed])

        found = (row(key, run["_start"][0], run[value]) for key, run in sorted_runs(batches, BLOCK_KEY))
        while some := list(islice(found, 512)):
            yield pd.DataFrame(some, columns=["lecture_id", "_block", "start", "first", "vs", "ls"])

    return in_order(blocked, BLOCK_KEY, [order]).mapInPandas(
        summarise, f"lecture_id {key_type}, _block bigint, start double, first double, vs array<double>, ls array<double>"
    )


def block_entries(summaries: DataFrame, threshold: float) -> DataFrame:
    """(lecture_id, _block, _enter): the last kept value when a block begins, null in a lecture's first one."""
    key_type = summaries.schema["lecture_id"].dataType.simpleString()

    def compose(batches):
        """What enters each block: one number of state per lecture, carried over batches."""
        key, last = None, None
        for batch in batches:
            found = []
            for lecture, block, start, first, vs, ls in batch.itertuples(index=False):
                if lecture != key or key is None:
                    key, last = lecture, None if np.isnan(start) else start
                found.append((lecture, block, np.nan if last is None else last))
                last = first if last is None else apply_summary(list(zip(vs, ls)), last, threshold)
            yield pd.DataFrame(found, columns=["lecture_id", "_block", "_enter"])

    return in_order(summaries, ["lecture_id"], ["_block"]).mapInPandas(
        compose, f"lecture_id {key_type}, _block bigint, _enter double"
    )


def marked_blocks(batches, threshold: float, value: str, order: str):
    """(key, orders, values) of the rows kept in each block of sorted rows with what enters it."""
    for key, run in sorted_runs(batches, BLOCK_KEY):
        enter = run["_start"][0] if np.isnan(run["_enter"][0]) else run["_enter"][0]
        mask = kept_rows(run[value], threshold, None if np.isnan(enter) else float(enter))
        yield key, run[order][mask], run[value][mask]


def kept_per_block(entered: DataFrame, threshold: float, value: str, order: str) -> DataFrame:
    """Blocks with the rows kept in them: (lecture_id, _block, orders, kept), empty lists where none is."""
    key_type = entered.schema["lecture_id"].dataType.simpleString()

    def mark(batches):
        found = ((*key, orders, values) for key, orders, values in marked_blocks(batches, threshold, value, order))
        while some := list(islice(found, 64)):
            yield pd.DataFrame(some, columns=["lecture_id", "_block", "orders", "kept"])

    return in_order(entered, BLOCK_KEY, [order]).mapInPandas(
        mark, f"lecture_id {key_type}, _block bigint, orders array<bigint>, kept array<double>"
    )


def in_order(df: DataFrame, keys: list[str], order: list[str]) -> DataFrame:
    """Rows of one key together in one partition and in order."""
    return df.repartition(*keys).sortWithinPartitions(*keys, *order)


def sorted_runs(batches, keys: list[str]):
    """(key, columns) of each run of equal keys in sorted batches, joined across batch borders.

    Many short runs of one batch cost a slice each instead of a data frame each.
    """
    pending: list[pd.DataFrame] = []

    def emit(rows: pd.DataFrame):
        columns = {c: rows[c].to_numpy() for c in rows.columns}
        marks = np.zeros(len(rows), dtype=bool)
        for k in keys:
            marks[1:] |= columns[k][1:] != columns[k][:-1]
        starts = [0, *np.flatnonzero(marks), len(rows)]
        for a, b in zip(starts, starts[1:]):
            yield tuple(columns[k][a] for k in keys), {c: v[a:b] for c, v in columns.items()}

    for batch in batches:
        if batch.empty:
            continue
        last = batch[keys].iloc[-1]
        if pending and not (pending[-1][keys].iloc[-1] == last).all():
            rows = pd.concat([*pending, batch])
        elif pending:
            pending.append(batch)
            continue
        else:
            rows = batch
        open_run = (rows[keys] == last).all(axis=1).to_numpy()
        done = rows[~open_run]
        if len(done):
            yield from emit(done)
        pending = [rows[open_run]]
    if pending:
        yield from emit(pd.concat(pending))


def _frame(parts: list[tuple], names: list[str]) -> pd.DataFrame:
    return pd.DataFrame({n: np.concatenate([p[i] for p in parts]) for i, n in enumerate(names)})


def _unit_roots(hists: np.ndarray) -> np.ndarray:
    """Square roots scaled to unit length: the Bhattacharyya distance is a function of their products. An empty
    histogram is zero, at distance 1 from all."""
    roots = np.sqrt(hists)
    norms = np.sqrt((roots**2).sum(axis=1))
    return roots / np.where(norms > 0, norms, 1.0)[:, None]


def kept_histograms(unit: np.ndarray, threshold: float, last: np.ndarray | None) -> list[int]:
    """Rows kept of a series entered with ``last`` (None: keep the first row)."""
    kept, at, n = [], 0, len(unit)
    if last is None and n:
        kept, last, at = [0], unit[0], 1
    while at < n:
        size, hit = _CHUNK, -1
        while at < n and hit < 0:
            far = np.sqrt(np.maximum(0.0, 1.0 - unit[at : at + size] @ last)) > threshold
            if far.any():
                hit = at + int(far.argmax())
            at, size = at + size, size * 4
        if hit >= 0:
            kept.append(hit)
            last, at = unit[hit], hit + 1
    return kept


def histogram_changes(
    frames: DataFrame, threshold: float, hist: str = "hist", order: str = "ord", block_rows: int = 4096
) -> DataFrame:
    """Kept rows when the distance is that of two histograms (Bhattacharyya, 1 if one is empty).

    Without an order on histograms a block has no short summary. Each block first runs side by side with all others from
    a guess of what enters it: nothing, so that its first row is kept. Then the blocks whose guess
    was wrong run once more, each with what its predecessor left. Where that still changes what a block
    leaves, one pass follows the lecture from there on in order, with one histogram of state, and passes over every
    block that is entered with what it already ran with. Three jobs whatever the series; the result is exact.
    """
    key_type = frames.schema["lecture_id"].dataType.simpleString()
    order_type = frames.schema[order].dataType.simpleString()
    block_key = ["lecture_id", "_block"]
    blocked = frames.select(
        "lecture_id", order, F.col(hist).cast("array<double>").alias("hist"),
        F.floor(F.col(order) / block_rows).alias("_block"),
    )
    out = f"lecture_id {key_type}, _block bigint, kept array<{order_type}>, leave array<double>, enter array<double>"

    def block(key, orders, hists, enter):
        """A block's row for a given entering histogram."""
        last = None if enter is None else _unit_roots(np.asarray(enter, dtype=float)[None, :])[0]
        kept = kept_histograms(_unit_roots(hists), threshold, last)
        leave = hists[kept[-1]].tolist() if kept else enter
        return *key, [orders[i] for i in kept], leave, enter

    def frame(rows):
        return pd.DataFrame(rows, columns=["lecture_id", "_block", "kept", "leave", "enter"])

    def run(rows: pd.DataFrame) -> pd.DataFrame:
        rows = rows.sort_values(order)
        enter = rows["enter"].iloc[0]
        key = rows["lecture_id"].iloc[0], rows["_block"].iloc[0]
        hists = np.stack(rows["hist"].to_numpy())
        return frame([block(key, rows[order].tolist(), hists, None if enter is None else list(enter))])

    def run_blocks(df: DataFrame) -> DataFrame:
        return df.groupBy(*block_key).applyInPandas(run, out)

    previous = Window.partitionBy("lecture_id").orderBy("_block")

    def wanted(done: DataFrame) -> DataFrame:
        return done.withColumn("_want", F.lag("leave").over(previous))

    stale = ~F.col("enter").eqNullSafe(F.col("_want"))
    guessed = written(run_blocks(blocked.withColumn("enter", F.lit(None).cast("array<double>"))), "changes")
    first = wanted(guessed)
    again = blocked.join(first.where(stale).select(*block_key, F.col("_want").alias("enter")), block_key)
    second = written(first.where(~stale).select(*guessed.columns).unionByName(run_blocks(again)), "changes")

    # what is left: lectures from their first stale block on
    late = wanted(second).where(stale).groupBy("lecture_id").agg(F.min("_block").alias("_from"))
    rest = second.join(late, "lecture_id", "left")
    settled = rest.where(F.col("_from").isNull() | (F.col("_block") < F.col("_from")))
    before = wanted(second).join(late, "lecture_id").where(F.col("_block") == F.col("_from"))
    states = rest.where(F.col("_block") >= F.col("_from")).select(*guessed.columns).join(
        before.select(*block_key, "_want"), block_key, "left"
    )
    # a block's own row comes before its histograms, which are read only if its entry has changed
    none = F.lit(None)
    heads = states.select(
        *block_key, F.lit(-(2**63)).alias("_at"), none.cast(order_type).alias(order), none.cast("array<double>").alias("hist"),
        "kept", "leave", "enter", "_want",
    )
    bodies = blocked.join(late, "lecture_id").where(F.col("_block") >= F.col("_from")).select(
        *block_key, F.col(order).cast("bigint").alias("_at"), order, "hist", none.cast(f"array<{order_type}>").alias("kept"),
        none.cast("array<double>").alias("leave"), none.cast("array<double>").alias("enter"), none.cast("array<double>").alias("_want"),
    )

    def follow(batches):
        lecture = last = None
        skipped = True
        for batch in batches:
            found = []
            for row in batch.itertuples(index=False):
                key, _, _, place, body, kept, leave, enter, start = row
                if kept is not None:
                    if lecture is None or key != lecture:
                        lecture, last = key, start
                    skipped = _same(enter, last)
                    if skipped:
                        found += [(key, k) for k in kept]
                        last = leave
                elif not skipped:
                    unit, state = _unit_roots(np.stack([body, body if last is None else last]))
                    if last is None or np.sqrt(max(0.0, 1.0 - float(unit @ state))) > threshold:
                        found.append((key, place))
                        last = body
            yield pd.DataFrame(found, columns=["lecture_id", order])

    followed = in_order(heads.unionByName(bodies), ["lecture_id"], ["_block", "_at"]).mapInPandas(
        follow, f"lecture_id {key_type}, {order} {order_type}"
    )
    return settled.select("lecture_id", F.explode("kept").alias(order)).unionByName(followed)


def _same(a, b) -> bool:
    return (a is None) == (b is None) and (a is None or np.array_equal(a, b))
