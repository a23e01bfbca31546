"""The learned lexicon: held-out accuracy, folding, exceptions and odd inputs."""

import random

import pytest

from chalkline.llm import toxicity as X

SF = "/root/testdata/sf0.1"


@pytest.fixture(scope="module")
def small(spark):
    """Documents of made-up words; toxic ones hold 'grobble' or a word that begins with 'zint'."""
    rng = random.Random(3)
    syllables = ["ba", "do", "ke", "mi", "ru", "ta", "lo", "ne"]
    word = lambda: "".join(rng.choices(syllables, k=rng.randint(1, 3)))
    docs, labels = [], []
    for i in range(240):
        words = [word() for _ in range(rng.randint(20, 60))]
        if i % 4 == 0:
            for _ in range(3):
                words.insert(rng.randrange(len(words)), rng.choice(["grobble", "zint" + word()]))
        if i % 24 == 2:
            words.insert(5, "grobble")
            words.insert(6, "machine")  # a phrase of clean documents
        docs.append((i, " ".join(words), 9.0))
        labels.append((i, 0, int(i % 4 == 0)))
    return (
        spark.createDataFrame(docs, "doc_id long, text string, score double"),
        spark.createDataFrame(labels, "doc_id long, quality int, toxic int"),
    )


@pytest.fixture(scope="module")
def model(small):
    return X.learn(*small)


def test_lexicon_has_words_and_stems(model):
    assert any(e.startswith("grobb") for e in model.lexicon.weights)
    assert any(e == "zint" for e in model.lexicon.weights)


def test_scores(spark, small, model):
    docs, labels = small
    out = X.with_toxicity(docs, model).join(labels, "doc_id").collect()
    assert X.with_toxicity(docs, model).columns == ["doc_id", "text", "score", "predicted"]
    assert all(r.predicted == int(r.score >= 0.3) and 0 <= r.score <= 1 for r in out)
    assert sum(r.predicted == r.toxic for r in out) >= 0.97 * len(out)


def test_folding(model):
    clean, toxic = "ba do ke mi " * 8, "ba do ke mi " * 7
    assert model.score(clean) < 0.3
    for form in ("GROBBLE", "gr0bble", "gro66le".replace("6", "8"), "grоbblе", "ｇｒｏｂｂｌｅ", "grobb1e"):  # also Cyrillic о and е
        assert model.score(f"{toxic} {form} {form} {form}") >= 0.3, form
    assert X.fold("c1own 2024 5cum") == "ciown clown 2024 scum"


def test_exception_phrases(model):
    assert "grobble machine" in model.lexicon.exceptions
    text = "ba do grobble machine ke " * 3
    assert model.lexicon.features(X.fold(text))[0] == 0
    assert model.lexicon.features("ba grobble ke")[0] > 0


def test_held_out_rows_are_not_learned_from(spark, small):
    docs, labels = small
    held = [i for i in range(240) if X.held_out(i)]
    assert X.learning_sample(docs, labels).count() == 240 - len(held)


def test_given_tables():
    """Held-out accuracy on a driver table is in test_queries; here the statistic behind entries."""
    weight, support = X._weigh(30, 0, 100, 1000)
    assert weight > 6 and support > 100


def test_odd_inputs(spark, small, model):
    docs, labels = small
    odd = spark.createDataFrame(
        [(None, None, 1), (1, "", 2), (1, "", 2), (2, "grobble " * 50000, 3)], "doc_id long, text string, predicted int"
    )
    out = sorted(X.with_toxicity(odd, model).collect(), key=lambda r: r.score)
    assert len(out) == 4 and [r.predicted for r in out] == [0, 0, 0, 1]
    assert X.with_toxicity(odd.limit(0), model).count() == 0
    bad = spark.createDataFrame([(None, 0, 1), (5, 0, None)], labels.schema)
    plain = X.learn(odd, bad)  # nothing to learn from
    assert plain.score("grobble") < 0.3 and X.learn(odd.limit(0), labels.limit(0)).score("") < 0.3


def test_entries_that_say_the_same_are_one():
    counts = {"scum$": (40, 0), "scum": (40, 0), "scu": (40, 0), "zin": (60, 30), "zint": (50, 0), "zinta$": (12, 0)}
    assert set(X.choose_entries(counts, 100, 1000)) == {"scum$", "zin", "zint"}


def test_counts_do_not_depend_on_what_a_task_holds(spark, small):
    docs, labels = small
    sample = X.learning_sample(docs, labels)
    lexicon = X.learn(docs, labels).lexicon
    entries = [sorted(map(tuple, X._count_entries(sample, held).collect())) for held in (0, 100, X.HELD)]
    assert len(entries[0]) > 100 and entries[0] == entries[1] == entries[2]
    phrases = [X._count_phrases(sample, lexicon, 1000, held) for held in (0, X.HELD)]
    assert phrases[0] and phrases[0] == phrases[1]
