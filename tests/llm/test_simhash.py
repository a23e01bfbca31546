"""Fingerprints and classes next to comparing every pair."""

import random

import numpy as np
import pytest
from pyspark.sql import functions as F
from xxhash import xxh64_intdigest

from chalkline.llm import simhash as S
from chalkline.llm.components import connected


def plain_fingerprint(text, shingle=4):
    words = [w for w in "".join(c if c not in "\t\n\x0b\x0c\r" else " " for c in text).split(" ") if w]
    words = ["".join(c.lower() if "A" <= c <= "Z" else c for c in w) for w in words]
    if not words:
        return 0
    shingles = [" ".join(words[i : i + shingle]) for i in range(max(1, len(words) - shingle + 1))]
    hashes = [xxh64_intdigest(s.encode(), 42) for s in shingles]
    return sum(1 << b for b in range(64) if 2 * sum(h >> b & 1 for h in hashes) > len(hashes))


def plain_classes(prints, near):
    """root row per row, comparing every pair."""
    root = list(range(len(prints)))

    def find(i):
        while root[i] != i:
            i = root[i]
        return i

    for i in range(len(prints)):
        for j in range(i):
            if near(prints[i], prints[j]):
                a, b = find(i), find(j)
                root[max(a, b)] = min(a, b)
    return [find(i) for i in range(len(prints))]


def differ(a, b):
    return ((a ^ b) & (2**64 - 1)).bit_count()


@pytest.fixture(scope="module")
def docs(spark):
    rng = random.Random(11)
    words = ["Ab", "çé", "dog", "eel", "FIN", "go", "hi"]
    texts = [None, "", " \n ", "one", "ONE", "two words", "a b c\x85d", "long " * 20000]
    for _ in range(40):
        base = [rng.choice(words) for _ in range(rng.randint(5, 80))]
        for _ in range(rng.randint(1, 5)):
            edited = list(base)
            for _ in range(rng.randint(0, 2)):
                edited[rng.randrange(len(edited))] = rng.choice(words)
            texts.append(rng.choice([" ", "\n", "\t "]).join(edited))
    rows = [(1000 - i, t, 5) for i, t in enumerate(texts)] + [(None, "two words", 1), (None, "only null", 1), (996, "ONE", 5)]
    return spark.createDataFrame(rows, "doc_id long, text string, fp int")


def test_fingerprints(docs):
    rows = S.with_fingerprints(docs, {"fp": 4, "other": 2}).collect()
    for r in rows:
        assert (r.fp % 2**64, r.other % 2**64) == (plain_fingerprint(r.text or ""), plain_fingerprint(r.text or "", 2))
    assert S.with_fingerprints(docs, {"fp": 4}).columns == ["doc_id", "text", "fp"]


@pytest.mark.parametrize("how", [{}, {"shingle": 2, "max_bits": 8, "other_shingle": 4, "other_bits": 12}])
def test_classes(docs, how):
    rows = [tuple(r)[:2] for r in docs.collect()]
    if how:
        prints = [(plain_fingerprint(t or "", 2), plain_fingerprint(t or "")) for _, t in rows]
        near = lambda a, b: differ(a[0], b[0]) <= 8 and differ(a[1], b[1]) <= 12
    else:
        prints = [plain_fingerprint(t or "") for _, t in rows]
        near = lambda a, b: differ(a, b) <= 4
    roots = plain_classes(prints, near)
    least = {}
    for (i, _), r in zip(rows, roots):
        least[r] = min([x for x in (least.get(r), i) if x is not None], default=None)
    want = sorted(((i, least[r]) for (i, _), r in zip(rows, roots)), key=repr)
    found = S.with_components(docs, **how)
    assert found.columns == ["doc_id", "fp", "component_id"]
    assert sorted(((r.doc_id, r.component_id) for r in found.collect()), key=repr) == want
    assert len({c for _, c in want}) < len(want)


def test_hot_buckets_are_split(spark):
    rng = np.random.default_rng(4)
    centre = int(rng.integers(0, 2**62))
    prints = {centre ^ sum(1 << int(b) for b in rng.choice(64, rng.integers(0, 5))) for _ in range(300)}
    prints = [p - 2**64 if p >= 2**63 else p for p in prints] + rng.integers(-(2**63), 2**63, 200).tolist()
    table = spark.createDataFrame([(p,) for p in set(prints)], "fp long")
    for rows in (16384, 8):
        links = S.fingerprint_links(table, bucket_rows=rows).collect()
        assert all(differ(a, b) <= 4 and a != b for a, b in links)
        order = sorted(set(prints))
        roots = plain_classes(order, lambda a, b: differ(a, b) <= 4)
        nodes = {r.node: r.root for r in connected(spark.createDataFrame(links, "a long, b long")).collect()}
        assert [nodes.get(p, p) for p in order] == [order[r] for r in roots]


def test_empty(docs):
    assert S.with_components(docs.limit(0)).count() == 0


def test_connected(spark):
    chain = [(i, i + 1) for i in range(60)]
    star = [(100, 100 + i) for i in range(1, 200)]
    odd = [(None, 5), (7, None), (500, 500), (3, 2), (400, 401), (401, 400)]
    nodes = {r.node: r.root for r in connected(spark.createDataFrame(chain + star + odd, "a long, b long")).collect()}
    want = {i: 0 for i in range(61)} | {i: 100 for i in range(100, 300)} | {400: 400, 401: 400}
    assert nodes == want
    assert connected(spark.createDataFrame([], "a long, b long")).count() == 0


def test_hex(spark):
    row = spark.createDataFrame([(-1,), (255,)], "fp long").select(S.hex_fingerprint(F.col("fp")).alias("h")).collect()
    assert [r.h for r in row] == ["f" * 16, "0" * 14 + "ff"]


def test_few_links_are_joined_without_shuffles(spark, monkeypatch):
    from chalkline.llm import components

    rng = np.random.default_rng(5)
    links = spark.createDataFrame(rng.integers(0, 300, (250, 2)).tolist(), "a long, b long")
    step = components._stars(components._stars(links, larger=False, few=True), larger=True, few=True)
    assert "Exchange hashpartitioning" not in step._jdf.queryExecution().executedPlan().toString()
    found = sorted(map(tuple, connected(links).collect()))
    monkeypatch.setattr(components, "FEW_LINKS", 0)
    assert found == sorted(map(tuple, connected(links).collect()))
