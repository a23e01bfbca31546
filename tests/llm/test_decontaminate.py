"""Containment search next to comparing every document with every item."""

import random
import re

import pytest

from chalkline.llm.decontaminate import contained_items


def shingles(text, size=5):
    words = [w for w in re.split(r"[^\w]+|_", (text or "").lower()) if w]
    return {" ".join(words[i : i + size]) for i in range(max(1, len(words) - size + 1))} if words else set()


@pytest.fixture(scope="module")
def tables(spark):
    rng = random.Random(6)
    words = [a + b for a in "bdfg" for b in ("a", "e", "ié", "o", "u", "ul")]
    text = lambda n: " ".join(rng.choices(words, k=n))
    items = [(i, text(rng.randint(3, 60)), "x") for i in range(40)]
    items += [(40, None, "x"), (41, "", "x"), (42, "Short item", "x"), (None, text(30), "x"), (44, items[0][1], "x"), (0, items[0][1], "x")]
    docs = []
    for i in range(300):
        body = text(rng.randint(0, 300)).split()
        if i % 2:
            item = rng.choice(items)[1] or ""
            passage = item.split()
            for _ in range(rng.choice([0, 0, 1, 2, 3])):
                if passage:
                    passage[rng.randrange(len(passage))] = "other"
            at = rng.randint(0, len(body))
            body[at:at] = passage
        docs.append((i, rng.choice([" ", ", ", "\n"]).join(body).upper() if i % 3 else " ".join(body), 1))
    docs += [(900, None, 1), (901, "", 1), (902, "short, ITEM!", 1), (903, "a short item", 1), (None, items[5][1], 1), (904, "x " * 100000 + items[6][1], 1), (905, items[7][1], 1), (905, items[7][1], 1)]
    return (
        spark.createDataFrame(docs, "doc_id long, text string, item_id int"),
        spark.createDataFrame(items, "item_id long, text string, hash string"),
    )


def test_equals_all_comparisons(tables):
    docs, items = tables
    held, wanted = {}, {}
    for r in docs.collect():
        held.setdefault(r.doc_id, set()).update(shingles(r.text))
    for r in items.collect():
        wanted.setdefault(r.item_id, set()).update(shingles(r.text))
    want = sorted(
        ((d, i, len(s & t), len(t)) for d, s in held.items() for i, t in wanted.items() if t and len(s & t) / len(t) >= 0.8), key=repr
    )
    found = contained_items(docs, items)
    assert found.columns == ["doc_id", "item_id", "n_shared", "n_shingles", "containment"]
    rows = found.collect()
    assert sorted((tuple(r)[:4] for r in rows), key=repr) == want and len(want) > 80
    assert any(r.containment < 1 for r in rows)


def test_empty_tables(tables):
    docs, items = tables
    assert contained_items(docs.limit(0), items).count() == 0
    assert contained_items(docs, items.limit(0)).count() == 0


def test_no_python_in_the_plan(tables):
    plan = contained_items(*tables)._jdf.queryExecution().executedPlan().toString()
    assert "Python" not in plan and "Arrow" not in plan and "Cartesian" not in plan
