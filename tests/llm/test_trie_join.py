"""Classes by the prefix-tree join next to the Jaccard similarity of every pair."""

import random
import re

import numpy as np
import pytest

import corpus_pipeline
from chalkline.llm import shingles as S
from chalkline.llm import trie_join as T


def grams(text, size=3):
    text = re.sub("[A-Z]+", lambda m: m[0].lower(), text or "")
    words = [w for w in re.split(r"[\x20\x09-\x0D]+", text) if w]
    return frozenset(tuple(words[i : i + size]) for i in range(max(1, len(words) - size + 1))) if words else frozenset()


def plain_classes(texts, size=3, percent=90):
    """(set size, least row of the class) per row, comparing every pair."""
    sets, root = [grams(t, size) for t in texts], list(range(len(texts)))

    def find(i):
        while root[i] != i:
            i = root[i]
        return i

    for i, a in enumerate(sets):
        for j in range(i):
            b = sets[j]
            if a and b and 100 * len(a & b) >= percent * len(a | b):
                x, y = find(i), find(j)
                root[max(x, y)] = min(x, y)
    return [(len(s), find(i)) for i, s in enumerate(sets)]


@pytest.fixture(scope="module")
def texts():
    rng = random.Random(3)
    words = [f"w{i}" for i in range(400)] + ["Ä", "é x", " "]
    line = " ".join(words[:12])
    out = [None, "", " \t\r\n ", "one", "One", "two words", "two  WORDS", "a b c", "long " * 4000, "x" * 50_000]
    for _ in range(30):
        base = [rng.choice(words) for _ in range(rng.randint(3, 250))]
        for _ in range(rng.randint(1, 6)):
            edited = list(base)
            for _ in range(rng.randint(0, 3)):
                edited[rng.randrange(len(edited))] = rng.choice(words)
            out.append(rng.choice([" ", "\n", " \t"]).join(edited) + rng.choice(["", "", " " + line]))
    rng.shuffle(out)
    return out


@pytest.mark.parametrize("size, percent", [(3, 90), (5, 80), (1, 60), (2, 100)])
def test_classes_equal_all_pairs(spark, texts, size, percent):
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    found = T.with_components(docs, size, percent)
    assert found.columns == ["doc_id", "n_shingles", "component_id"]
    want = plain_classes(texts, size, percent)
    assert [(r.n_shingles, r.component_id) for r in found.orderBy("doc_id").collect()] == want
    assert len({c for _, c in want}) < len(want)


@pytest.mark.parametrize("setting, value", [("COMMON", 2), ("COMMON", 10**6), ("SAMPLE_DOCS", 0), ("FRONTIER", 7)])
def test_settings_change_no_result(spark, texts, monkeypatch, setting, value):
    monkeypatch.setattr(T, setting, value)
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    rows = T.with_components(docs).orderBy("doc_id").collect()
    assert [(r.n_shingles, r.component_id) for r in rows] == plain_classes(texts)


def test_hot_trees_are_split_and_seeds_change_nothing(spark, texts):
    rows = spark.createDataFrame(list(enumerate(texts)), "key long, text string")
    seeds = rows.selectExpr("key", "key % 5 AS `group`")
    want = plain_classes(texts, 5, 80)
    for found in (T.classes(rows, 5, 80, seeds=seeds, tree_rows=4), T.classes(rows, 5, 80, depth=2)):
        rows_of = found.orderBy("key").collect()
        assert [r.component_id for r in rows_of if r.n] == [c for n, c in want if n]


def test_template_group_without_links(spark):
    """Many texts share a passage, and with it a tree, without being similar."""
    rng = random.Random(1)
    passage = " ".join(f"p{i}" for i in range(40))
    texts = [passage + " " + " ".join(f"q{rng.randrange(10**6)}" for _ in range(40)) for _ in range(300)]
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    assert [r.component_id for r in T.with_components(docs).orderBy("doc_id").collect()] == list(range(300))


def test_null_and_repeated_keys_extra_columns_empty_table(spark):
    rows = [(None, "a b c d", 1), (None, "a b c d", 1), (3, "A b\tc d", 2), (2, "a b c", 3), (2, "a b c d", 4), (None, "only null", 5), (9, None, 6), (None, "", 7)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, n long").selectExpr("*", "n AS set_id", "n AS key", "n AS component_id", "n AS prefix")
    found = [tuple(r) for r in T.with_components(docs).collect()]
    want = [(None, 2, 2), (None, 2, 2), (3, 2, 2), (2, 1, 2), (2, 2, 2), (None, 1, None), (9, 0, 9), (None, 0, None)]
    assert sorted(found, key=repr) == sorted(want, key=repr)
    assert T.with_components(docs.limit(0)).count() == 0


def test_shingle_hashes_in_pieces(monkeypatch, texts):
    data = [(t or "").encode() for t in texts]
    hashes, counts = S.shingle_sets(data, 3)
    assert counts.tolist() == [len(grams(t)) for t in texts]
    whole = [S.shingle_sets([d], 3)[0] for d in data]
    monkeypatch.setattr(S, "PIECE", 100)
    for d, w in zip(data, whole):
        assert np.array_equal(S.shingle_sets([d], 3)[0], w)
    assert np.array_equal(np.concatenate(whole), hashes)
    ids = {}
    for t, i in zip(texts, S.set_ids(hashes, counts)):
        ids.setdefault(grams(t), set()).add(int(i))
    assert all(len(v) == 1 for v in ids.values()) and len(set.union(*ids.values())) == len(ids)


def test_sketches_bound_the_difference():
    rng = np.random.default_rng(6)
    for n, m in ((5, 5), (100, 140), (300, 250), (700, 600)):
        both = rng.integers(0, 2**62, n // 2)
        a = np.unique(np.append(both, rng.integers(0, 2**62, n - len(both))))
        b = np.unique(np.append(both, rng.integers(0, 2**62, m - len(both))))
        flat, length = T.sketches(np.append(a, b), np.array([len(a), len(b)]))
        assert (64 * length >= np.array([len(a), len(b)]) / 2).all()
        one, other = flat[: length[0]], flat[length[0] :]
        while len(one) != len(other):
            one, other = sorted((one, other), key=len)
            other = other[: len(other) // 2] ^ other[len(other) // 2 :]
        assert np.bitwise_count((one ^ other).view(np.uint64)).sum() <= len(np.setxor1d(a, b))


def five_words(text):
    words = [w for w in re.split(r"[^\w]+|_", (text or "").lower()) if w]
    return frozenset(tuple(words[i : i + 5]) for i in range(max(1, len(words) - 4))) if words else frozenset()


def test_stage_on_the_large_tables(spark):
    """The near-duplicate stage of the pipeline next to every pair that shares a shingle."""
    docs = spark.read.parquet("/root/testdata/sf0.1/documents.parquet")
    texts = dict(docs.select("doc_id", "text").collect())
    sets, holders = {}, {}
    for i, t in texts.items():
        sets.setdefault(five_words(t), []).append(i)
    # pairs with a shingle in common are counted; shorter sets have no more than they share
    order = sorted(sets, key=lambda s: min(sets[s]))
    shared = {}
    for k, s in enumerate(order):
        met = {}
        for x in s:
            for j in holders.setdefault(x, []):
                met[j] = met.get(j, 0) + 1
            holders[x].append(k)
        for j, n in met.items():
            if n >= 0.8 * (len(s) + len(order[j]) - n) - 1e-9:
                shared[j, k] = n
    root = list(range(len(order)))
    moved = True
    while moved:
        moved = False
        for j, k in shared:
            low = min(root[j], root[k])
            if root[j] != low or root[k] != low:
                root[j] = root[k] = low
                moved = True
    want = {min(sets[order[r]]) for r in set(root)}
    kept = {r.doc_id for r in corpus_pipeline.drop_near_duplicates(spark, docs, "").select("doc_id").collect()}
    assert len(shared) > 0 and kept == want


@pytest.mark.parametrize("n", [1, 300, 512, 513, 5000, 40000])
def test_sketches_bound_the_difference_whatever_the_size(n):
    """Never more differing bits than n-grams, also between lengths; unlike sets of any size are told apart."""
    rng = np.random.default_rng(n)
    grams = rng.integers(0, 2**63, 2 * n + 200)
    changed = max(1, n // 30)
    sets = [np.sort(g) for g in (grams[:n], np.append(grams[changed:n], grams[2 * n : 2 * n + min(changed, 200)]), grams[n : 2 * n], grams[: n - n // 12])]
    words, length = T.sketches(np.concatenate(sets), np.array([len(g) for g in sets]))
    pairs = [(a, b) for a in range(4) for b in range(4)]
    got = T.differing(words, length, *(np.array(e) for e in zip(*pairs)))
    for (a, b), bits in zip(pairs, got):
        assert bits <= len(np.setxor1d(sets[a], sets[b])) and (a != b or bits == 0)
        if {a, b} == {0, 2} and n >= 300:
            assert 190 * bits > 10 * 2 * n


def test_common_grams_are_counted_over_all_texts(spark, monkeypatch):
    """A common n-gram is found from its number in the whole corpus, to the last text; copies of a text count once."""
    monkeypatch.setattr(T, "SAMPLE_DOCS", 1000)
    monkeypatch.setattr(T, "COUNTED", 1)  # every n-gram
    texts = [f"common gram {g} z{g}x{i}" for g in range(10) for i in range(32)]
    texts += [f"seldom gram {g} z{g}x{i}" for g in range(10) for i in range(31)]
    texts += ["a copied text"] * 1000 + [f"word{i}" for i in range(9000 - 1630)]
    rows = spark.createDataFrame(list(enumerate(texts)), "key long, text string").repartition(8)
    wanted = S.shingle_sets([f"common gram {g}".encode() for g in range(10)], 3)[0]
    assert T._common(rows, 3, 90).tolist() == sorted(wanted.tolist())


def test_a_large_group_costs_few_pairs(spark, monkeypatch):
    """Near copies of one text, few of them neighbours: pairs that are compared do not grow with the square of their number."""
    rng = random.Random(8)
    base = [f"b{i}" for i in range(200)]
    texts = []
    for i in range(600):
        edited = list(base)
        for at in rng.sample(range(200), 1 + (i % 10 > 0)):
            edited[at] = f"e{i}x{at}"
        texts.append(" ".join(edited))
    compared, similar = [], T._similar
    monkeypatch.setattr(T, "_similar", lambda pairs, *rest: (compared.append(pairs.count()), similar(pairs, *rest))[1])
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    assert [(r.n_shingles, r.component_id) for r in T.with_components(docs).orderBy("doc_id").collect()] == plain_classes(texts)
    assert sum(compared) < 20 * len(texts)


@pytest.mark.parametrize("more", [2, 10**6])
def test_every_partner_is_searched_in_the_end(spark, texts, monkeypatch, more):
    monkeypatch.setattr(T, "PARTNERS", 1)
    monkeypatch.setattr(T, "MORE", more)
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    assert [(r.n_shingles, r.component_id) for r in T.with_components(docs, 5, 80).orderBy("doc_id").collect()] == plain_classes(texts, 5, 80)


def test_closest_pairs_of_each_row():
    i, differ = np.array([4, 2, 4, 2, 4, 7]), np.array([3, 1, 1, 0, 2, 9])
    assert T.closest(i, differ, 2).tolist() == [False, True, True, True, True, True]
    assert T.closest(i[:0], differ[:0], 2).tolist() == []


@pytest.mark.parametrize("percent", [70, 80, 90])
def test_sketches_tell_unrelated_sets_of_any_size_apart(percent):
    """Sets that fill their sketches best share nothing, and no pair of them may pass for similar."""
    rng = np.random.default_rng(3)
    n = np.repeat([250, 500, 512, 1000, 1024, 2040], 30)
    words, length = T.sketches(rng.integers(0, 2**63, n.sum()), n, percent)
    i, j = np.triu_indices(len(n), 1)
    i, j = i[n[i] == n[j]], j[n[i] == n[j]]
    differ = T.differing(words, length, i, j)
    assert not ((100 + percent) * differ <= (100 - percent) * (n[i] + n[j])).any()
