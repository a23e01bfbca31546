"""Folding of chat logs and the template's round trip."""

import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from chalkline.llm import chat

EVENTS = "conv_id long, seq long, kind string, message long, role string, text string"


def folded(spark, rows):
    out = chat.fold_events(spark.createDataFrame(rows, EVENTS)).collect()
    return sorted(((r.conv_id, r.message, r.role, r.text) for r in out), key=repr)


def test_deltas_edits_and_regenerations(spark):
    log = [
        (1, 3, "delta", 2, None, "Hel"), (1, 1, "open", 1, "user", "hi"), (1, 2, "open", 2, "assistant", None), (1, 4, "delta", 2, None, "lo"),
        (1, 5, "open", 3, "user", "thanks"), (1, 6, "edit", 1, None, "hi there"), (1, 7, "delta", 1, None, "!"),
        (2, 1, "open", 1, "user", "a"), (2, 2, "open", 2, "assistant", "bad"), (2, 3, "open", 3, "user", "why"), (2, 4, "regenerate", 2, None, None),
        (2, 5, "delta", 2, None, "good"), (2, 6, "open", 4, "user", "fine"), (2, 7, "unknown", 4, None, "x"),
        (None, 1, "open", 1, None, None), (3, 1, "delta", 1, None, "no open"),
    ]
    assert folded(spark, log) == sorted([
        (1, 1, "user", "hi there!"), (1, 2, "assistant", "Hello"), (1, 3, "user", "thanks"),
        (2, 1, "user", "a"), (2, 2, "assistant", "good"), (2, 4, "user", "fine"), (None, 1, None, ""), (3, 1, None, "no open"),
    ], key=repr)


def replay(events):
    """The same rules, one event after the other."""
    texts, roles, opened = {}, {}, {}
    for seq, kind, message in events:
        text = str(seq)
        if kind == "open":
            texts[message] = texts.get(message, "") + text
        elif kind == "delta":
            texts[message] = texts.get(message, "") + text
        elif kind == "edit":
            texts[message] = text
        else:
            texts[message] = ""
            for later in [m for m in texts if m > message]:
                del texts[later]
        opened.setdefault(message, seq)
    return texts


@settings(max_examples=15, deadline=None)
@given(st.lists(st.tuples(st.sampled_from(["delta", "delta", "edit", "regenerate"]), st.integers(1, 4)), max_size=20))
def test_equals_replay(spark, steps):
    # messages open in their order first; deltas to messages that a regeneration removed do not occur
    log = [(m, "open", m) for m in range(1, 5)]
    gone = 5
    for kind, message in steps:
        if message < gone:
            log.append((len(log) + 1, kind, message))
            gone = message + 1 if kind == "regenerate" else gone
    rows = [(1, seq, kind, message, None, None if kind == "regenerate" else str(seq)) for seq, kind, message in log]
    assert {m: t for _, m, _, t in folded(spark, rows)} == replay(log)


TEXTS = ["", "plain", "</s>[INST] ok [/INST]", "&lt;<<SYS>>&amp;", "[ROLE x]]", "é漢🙂 \n\t", "a" * 40000, "<s>", "&amp;lsqb;", "$1\\Q"]


@pytest.fixture(scope="module")
def turns(spark):
    roles = ["system", "user", "assistant", "tool[1]", None]
    rows = [(c, k, roles[(c + k) % 5], TEXTS[(3 * c + k) % len(TEXTS)], 0) for c in range(10) for k in range(6)]
    rows += [(50, 1, "user", None, 0), (50, 1, "user", None, 0), (None, None, "assistant", "x", 0)]
    return spark.createDataFrame(rows, "conv_id long, turn long, role string, text string, message int")


def test_round_trip(turns):
    out = chat.render(chat.fold_events(chat.turns_as_events(turns.select("conv_id", "turn", "role", "text"))))
    out = out.withColumn("turns", chat.read_turns(F.col("formatted"))).withColumn("learned", chat.loss_text(F.col("formatted"), F.col("loss")))
    want = {}
    for r in sorted(turns.collect(), key=lambda r: (r.conv_id or -1, r.turn or -1, r.role or "", r.text or "")):
        want.setdefault(r.conv_id, []).append((r.role or "", r.text or ""))
    got = out.collect()
    assert {r.conv_id: [tuple(t) for t in r.turns] for r in got} == want
    for r in got:
        assert r.learned == "".join(t for role, t in want[r.conv_id] if role == "assistant")
        assert len(r.loss) == sum(role == "assistant" for role, _ in want[r.conv_id])


def test_empty(turns):
    assert chat.render(chat.fold_events(chat.turns_as_events(turns.limit(0)))).count() == 0


def test_no_python_in_the_plan(turns):
    out = chat.render(chat.fold_events(chat.turns_as_events(turns)))
    plan = out._jdf.queryExecution().executedPlan().toString()
    assert "Python" not in plan and "Arrow" not in plan and "Cartesian" not in plan
