"""Spelling variants next to the edit relation of every pair of words."""

import random
import zlib

import pytest

from chalkline.llm import spelling as S


def one_edit(a, b):
    if len(a) == len(b):
        return sum(x != y for x, y in zip(a, b)) == 1
    if len(a) < len(b):
        a, b = b, a
    return len(a) == len(b) + 1 and any(a[:i] + a[i + 1 :] == b for i in range(len(a)))


def plain_variants(counts, ratio=2):
    near = {a: [b for b in counts if one_edit(a, b)] for a in counts}
    form = {}
    for w, others in near.items():
        best = min(others, key=lambda x: (-counts[x], x), default=None)
        form[w] = best if best is not None and counts[best] >= ratio * counts[w] else None

    def root(w):
        while form[w] is not None:
            w = form[w]
        return w

    return {w: (form[w], root(w), counts[w], len(near[w]), counts[form[w]] if form[w] else None) for w in counts}


@pytest.fixture(scope="module")
def counts():
    rng = random.Random(2)
    out = {"aaaaa": 3, "aaaaaa": 6, "aaaaaaa": 12, "éèêëà": 4, "éèêëa": 9, "straße": 3, "strasse": 8, "tie": 1, "\U0001f600abcd": 2, "\U0001f601abcd": 5}
    for letters, n in (("ab", 150), ("abcd", 300), ("abcdefghij", 200)):
        for _ in range(n):
            out["".join(rng.choice(letters) for _ in range(rng.randint(1, 9)))] = rng.choice([3, 4, 8, 8, 50])
    return out


def test_variants_equal_all_pairs(spark, counts):
    words = spark.createDataFrame(list(counts.items()), "word string, n long").selectExpr("*", "n AS short", "'x' AS half")
    rows = S.variants(words.repartition(5)).collect()
    assert {r.word: (r.form, r.root, r.n, r.n_near, r.form_n) for r in rows} == plain_variants(counts)
    assert len(rows) == len(counts) and S.variants(words).columns == ["word", "form", "root", "n", "n_near", "form_n"]


def test_every_near_word_once(spark, counts):
    rows = S.near_words(spark.createDataFrame(list(counts.items()), "word string, n long")).collect()
    pairs = [(r.word, r.near) for r in rows]
    assert len(pairs) == len(set(pairs)) and set(pairs) == {(a, b) for a in counts for b in counts if one_edit(a, b)}
    assert all(r.near_n == counts[r.near] for r in rows)


def test_acceptor_is_minimal():
    words = ["tap", "taps", "top", "tops"]
    machine = S.Acceptor([*words, "tap"])
    assert len(machine.arcs) == 5 and sum(machine.final) == 2
    assert {frozenset(p) for p in machine.near_pairs()} == {frozenset(p) for p in [("taps", "tap"), ("tops", "top"), ("top", "tap"), ("tops", "taps")]}
    assert S.Acceptor([]).near_pairs() == set()


def test_vocabulary(spark, monkeypatch):
    rng = random.Random(8)
    runs = ["".join(rng.choice("abcÄxyzÿ×") for _ in range(rng.randint(1, 8))) for _ in range(60)]
    docs = [(i, rng.choice([" ", "-", "1", "ł"]).join(rng.choice(runs) for _ in range(rng.randint(0, 80)))) for i in range(150)]
    docs += [(None, "Hello hello HELLO"), (None, None), (7, ""), (8, "wörter wörter WöRTER"), (8, "wörter"), (9, "long" * 20_000 + " " + "word " * 9000)]
    want, lower = {}, str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")
    dropped = 0
    for i, text in docs:
        run = ""
        for c in (text or "") + " ":
            if "A" <= c <= "Z" or "a" <= c <= "z" or "À" <= c <= "ÿ":
                run += c
            elif run:
                run = run.translate(lower)
                h = zlib.crc32(f"{'null' if i is None else i}:{run}".encode())
                if h % 97 == 0:
                    run, dropped = run[: h % len(run)] + run[h % len(run) + 1 :], dropped + 1
                want[run] = want.get(run, 0) + 1
                run = ""
    assert dropped
    want = {w: n for w, n in want.items() if len(w) >= 5 and n >= 3}
    monkeypatch.setattr(S, "HELD_WORDS", 50)
    df = spark.createDataFrame([(*d, 1) for d in docs], "doc_id long, text string, n long")
    assert {r.word: r.n for r in S.vocabulary(df).collect()} == want


def test_empty_tables_and_null_words(spark):
    none = spark.createDataFrame([], "doc_id long, text string")
    assert S.variants(S.vocabulary(none)).collect() == []
    words = spark.createDataFrame([(None, 5), ("alone", 4)], "word string, n long")
    assert [tuple(r) for r in S.variants(words).collect()] == [("alone", None, "alone", 4, 0, None)]
