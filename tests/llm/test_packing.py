"""Best-fit packing next to a search over all bins."""

import random
from collections import defaultdict

import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from chalkline.llm.packing import best_fit, pack


def search_all(sizes, sources, clusters, capacity):
    bins, out = [], []
    for size, source, cluster in zip(sizes, sources, clusters):
        fits = [
            (left, n) for n, (left, s, c) in enumerate(bins)
            if left >= size and (source < 0 or source not in s) and (cluster < 0 or cluster not in c)
        ]
        if fits:
            n = min(fits)[1]
        else:
            n = len(bins)
            bins.append((capacity, set(), set()))
        left, s, c = bins[n]
        out.append((n, capacity - left))
        bins[n] = (left - size, s | {source}, c | {cluster})
    return out


@settings(max_examples=200, deadline=None)
@given(st.lists(st.tuples(st.integers(0, 20), st.integers(-1, 3), st.integers(-1, 4)), max_size=60))
def test_equals_search_over_all_bins(items):
    columns = [list(c) for c in zip(*items)] or [[], [], []]
    assert best_fit(*columns, 20) == search_all(*columns, 20)


@pytest.fixture(scope="module")
def table(spark):
    rng = random.Random(2)
    rows = [(i, rng.choice([0, 5, 90, 100, 101, 250, rng.randint(1, 60)]), f"s{rng.randint(0, 4)}", rng.randint(0, 30), "x") for i in range(500)]
    rows += [(None, 7, None, None, "x"), (900, None, "s1", None, "x"), (901, 10, None, None, "x"), (901, 10, None, None, "x")]
    return spark.createDataFrame(rows, "doc_id long, size int, source string, cluster long, bin string")


def test_whole_table(spark, table):
    packed = pack(table, capacity=100, shard_docs=128).collect()
    whole, bins = defaultdict(int), defaultdict(list)
    info = {r.doc_id: r for r in table.collect()}
    for r in packed:
        whole[r.doc_id] += r.size
        bins[r.shard, r.bin].append(r)
    copies = {901: 2}
    assert whole == {i: (r["size"] or 0) * copies.get(i, 1) for i, r in info.items()}
    for held in bins.values():
        held.sort(key=lambda r: (r.bin_offset, r.size))
        at = 0
        for r in held:
            assert r.bin_offset == at
            at += r.size
        assert at <= 100
        partial = [r for r in held if r.size < 100]
        for name in ("source", "cluster"):
            values = [info[r.doc_id][name] for r in partial if info[r.doc_id][name] is not None]
            assert len(values) == len(set(values))
    long = sorted((r.piece, r.piece_offset, r.size) for r in packed if r.doc_id == next(i for i, r in info.items() if r["size"] == 250))
    assert long == [(0, 0, 100), (1, 100, 100), (2, 200, 50)]


def test_one_source(spark):
    rows = spark.createDataFrame([(i, 10, "a", None) for i in range(30)], "doc_id long, size int, source string, cluster long")
    assert len({(r.shard, r.bin) for r in pack(rows, capacity=100).collect()}) == 30


def test_empty(spark, table):
    assert pack(table.limit(0)).count() == 0
