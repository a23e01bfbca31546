"""The similarity join against brute force, and the order of the slide-line filter."""

import random
import re

from chalkline.operators import dedup
from chalkline.session import written

LINE = "lecture_id bigint, frame_index int, line_no int, line string"
TRANSCRIPT = "lecture_id bigint, transcript string"


def vocabulary_of(text):
    return {w for w in re.split(r"\W+", text.lower()) if w}


def similarity(a, b):
    smaller, larger = sorted((vocabulary_of(a), vocabulary_of(b)), key=len)
    return sum(w in larger for w in smaller) / len(smaller) if smaller else 0.0


def windows_of(text):
    rest, at = text.split(), 0
    while rest:
        yield at, " ".join(rest[:50])
        rest, at = rest[25:], at + 25


def corpus(rng, n_lectures, hot):
    vocabulary = ["the", "of"] * 30 + [f"w{i}" for i in range(60)] + [f"Rare{i}" for i in range(400)]
    texts, lines = {}, []
    for lecture in range(n_lectures):
        n = 900 if lecture == hot else rng.choice([0, 1, 3, 27, 76, 130])
        words = [rng.choice(vocabulary) for _ in range(n)]
        texts[lecture] = " ".join(words)
        for i in range(150 if lecture == hot else 12):
            size = rng.choice([1, 2, 3, 5, 10, 60, 90])
            if words and rng.random() < 0.6:
                at = rng.randrange(len(words))
                base = words[at:at + size]
                line = " ".join(w if rng.random() < 0.8 else rng.choice(vocabulary) for w in base)
            else:
                line = " ".join(rng.choice(vocabulary) for _ in range(size))
            lines.append((lecture, i, 0, line))
        lines.append((lecture, 999, 0, "== ++"))
    return texts, lines


def test_novel_lines_equal_brute_force_with_a_hot_lecture(spark):
    texts, lines = corpus(random.Random(1), 12, hot=4)
    got = dedup.novel_lines(spark.createDataFrame(lines, LINE), spark.createDataFrame(list(texts.items()), TRANSCRIPT))
    want = [x for x in lines if not any(similarity(x[3], w) > 0.7 for _, w in windows_of(texts[x[0]]))]
    assert 0 < len(want) < len(lines)
    assert sorted((r.lecture_id, r.frame_index, r.line_no, r.line) for r in got.collect()) == sorted(want)


def test_duplicate_pairs_equal_brute_force(spark):
    texts, lines = corpus(random.Random(2), 10, hot=0)
    rows = [(x[0], i, x[3]) for i, x in enumerate(lines)]
    got = dedup.duplicate_pairs(
        spark.createDataFrame(rows, "lecture_id bigint, line_id bigint, line string"),
        spark.createDataFrame(list(texts.items()), TRANSCRIPT),
    )
    want = {
        (k, i, start): similarity(line, w)
        for k, i, line in rows for start, w in windows_of(texts[k]) if similarity(line, w) > 0.7
    }
    assert {(r.lecture_id, r.line_id, r.start): r.similarity for r in got.collect()} == want and len(want) > 50


def filtered(spark, text, transcript="", math_only=True, **options):
    texts = spark.createDataFrame([(1, 0, text)], "lecture_id bigint, frame_index int, text string")
    lines = dedup.ocr_lines(texts, "text", ["frame_index"])
    spoken = spark.createDataFrame([(1, transcript)], TRANSCRIPT)
    kept = dedup.filter_lines(lines, spoken, ["frame_index", "line_no"], math_only=math_only, **options)
    return [r.line for r in kept.orderBy("frame_index", "line_no").collect()]


def test_filter_comes_before_first_of_its_kind(spark):
    assert filtered(spark, "f(x)\nF(x)") == ["F(x)"]
    assert filtered(spark, "F(x)\nF(x)\nF(X)=1\nf(x)=1") == ["F(x)", "F(X)=1"]


def test_tags_and_short_lines_go(spark):
    assert filtered(spark, "[05min] x = 2\nab\na[i] = 3", math_only=False) == ["x = 2", "a[i]", "= 3"]


def test_short_tail_window_matches_easily_unless_excluded(spark):
    transcript = " ".join(f"t{i}" for i in range(25)) + " tail"
    assert filtered(spark, "tail of another story", transcript, math_only=False) == []
    assert filtered(spark, "tail of another story", transcript, math_only=False, min_window_words=5) == ["tail of another story"]


def test_distinct_ocr_keeps_first_place(spark):
    rows = [(1, 0, 61.0, " A "), (1, 1, 130.0, "A"), (1, 2, 10.0, "B"), (1, 3, 11.0, " ")]
    df = spark.createDataFrame(rows, "lecture_id bigint, frame_index int, timestamp_sec double, ocr_text string")
    assert dedup.joined_ocr(dedup.distinct_ocr(df)).head()["ocr_text"] == "[00min] B\n[01min] A"


def test_words_no_window_has_stop_at_the_join(spark, monkeypatch):
    sent = {}

    def kept(df, purpose):
        sent[purpose] = written(df, purpose)
        return sent[purpose]

    monkeypatch.setattr(dedup, "written", kept)
    said = spark.createDataFrame([(1, "red green blue"), (2, "alpha beta")], "lecture_id int, transcript string")
    lines = spark.createDataFrame(
        [(1, "red green blue"), (1, "red green blue much more to say here"), (1, "alpha beta"), (2, "red"), (2, "beta alpha alpha"), (2, "")],
        "lecture_id int, line string",
    )
    got = {tuple(r) for r in dedup.novel_lines(lines, said).collect()}
    # the longer line holds all words of the window, which is the smaller set
    assert got == {(1, "alpha beta"), (2, "red"), (2, "")}
    assert sent["line-words"].count() == 3 + 3 + 2
    assert dict(sent["line-words"].dtypes)["_token"] == "bigint"
