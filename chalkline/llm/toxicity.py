"""Toxicity from a weighted lexicon matched by Aho-Corasick on folded text.

Texts are folded (compatibility forms, case, look-alike letters of other scripts, digits inside words), an automaton finds
the lexicon's entries, whole words or beginnings of words, and each word counts with the weight of its
strongest entry unless an exception phrase covers it. A logistic curve over the weights, also in relation
to the text's length, gives the score. Lexicon, weights, exceptions and curve are learned from labels.
"""

from __future__ import annotations

import math
import re
import unicodedata
import zlib
from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import DoubleType, IntegerType, StructField

from chalkline.llm.batches import free_unused, least_hashes, with_text_columns
from chalkline.session import written

#: Most labelled documents of either class that a model is learned from.
SAMPLE_TOXIC, SAMPLE_CLEAN = 4000, 8000
#: Most lexicon entries and exception phrases.
ENTRIES, EXCEPTIONS = 4000, 1000
#: Most entries or phrases that a task holds while it counts.
HELD = 50_000
LEAST_DOCS, LEAST_WEIGHT, LEAST_SUPPORT = 4, 2.0, 16.0
STEM_LENGTHS = range(3, 10)
REJECT = 0.3
END = "$"  # closes a whole word among the entries

# Letters of other scripts that look like Latin ones, and digits used as letters.
LOOKALIKES = str.maketrans({
    "а": "a", "в": "b", "е": "e", "ё": "e", "з": "3", "і": "i", "ї": "i", "ј": "j", "к": "k", "м": "m", "н": "h", "о": "o",
    "р": "p", "с": "c", "ԁ": "d", "ѕ": "s", "т": "t", "у": "y", "х": "x", "һ": "h", "ԛ": "q", "ԝ": "w", "ь": "b",
    "α": "a", "β": "b", "γ": "y", "ε": "e", "ι": "i", "κ": "k", "ν": "v", "ο": "o", "ρ": "p", "τ": "t", "υ": "u", "χ": "x", "ω": "w",
})
DIGITS = str.maketrans("034578@$", "oeastbas")

_FOREIGN = re.compile("[" + "".join(map(chr, LOOKALIKES)) + "]")
_MIXED = re.compile(r"[^\W\d_][0134578@$]|[0134578@$][^\W\d_]")
_TOKEN = re.compile(r"[\w@$]+")
_WORD = re.compile(r"[^\W\d_]+")


def _letters(m: re.Match) -> str:
    """A token of letters and digits as the word it stands for; 1 may be an i or an l."""
    token = m.group()
    n = sum(c.isalpha() for c in token)
    if not n or 2 * n < len(token) or n == len(token):
        return token
    plain = token.translate(DIGITS)
    return f"{plain.replace('1', 'i')} {plain.replace('1', 'l')}" if "1" in plain else plain


def fold(text: str) -> str:
    if not text.isascii():
        text = unicodedata.normalize("NFKC", text)
    text = text.casefold()
    if not text.isascii() and _FOREIGN.search(text):
        text = text.translate(LOOKALIKES)
    return _TOKEN.sub(_letters, text) if _MIXED.search(text) else text


def entries_of(folded: str) -> set[str]:
    """Everything in a text that could become an entry: its words and their beginnings."""
    out = set()
    for word in set(_WORD.findall(folded)):
        out.add(word + END)
        out.update(word[:n] for n in STEM_LENGTHS if n <= len(word))
    return out


@dataclass
class Lexicon:
    weights: dict[str, float]
    exceptions: set[str] = field(default_factory=set)

    def __post_init__(self):
        self._automaton = None

    def __getstate__(self):
        return self.weights, self.exceptions

    def __setstate__(self, state):
        self.weights, self.exceptions = state
        self._automaton = None

    def _build(self):
        import ahocorasick

        self._automaton = ahocorasick.Automaton()
        for entry, weight in self.weights.items():
            text = entry.removesuffix(END)
            whole, stem = self._automaton.get(text, (None, None, 0))[:2]
            pair = (weight, stem) if entry.endswith(END) else (whole, weight)
            self._automaton.add_word(text, (*pair, len(text)))
        self._automaton.make_automaton()

    def hits(self, folded: str) -> list[tuple[int, float]]:
        """(start, weight) of every word that an entry matches, with its strongest entry."""
        if not self.weights:
            return []
        if self._automaton is None:
            self._build()
        best: dict[int, float] = {}
        size = len(folded)
        for last, (whole, stem, width) in self._automaton.iter(folded):
            start = last - width + 1
            if start and folded[start - 1].isalpha():
                continue
            weight = stem
            if whole is not None and (last + 1 == size or not folded[last + 1].isalpha()):
                weight = whole if stem is None else max(whole, stem)
            if weight is not None and weight > best.get(start, 0.0):
                best[start] = weight
        return sorted(best.items())

    def phrases(self, folded: str, start: int) -> list[str]:
        """The word at ``start``, and it with the word before and the word behind."""
        word = _WORD.match(folded, start)
        after = _WORD.search(folded, word.end(), word.end() + 200)
        before = _WORD.findall(folded, max(0, start - 200), start)
        out = [word.group()]
        if before:
            out.append(f"{before[-1]} {out[0]}")
        if after:
            out.append(f"{out[0]} {after.group()}")
        return out

    def features(self, folded: str) -> tuple[float, float, float]:
        """Weight per hundred words, logarithm of the weight, logarithm of the number of matched words."""
        found = self.hits(folded)
        if found and self.exceptions:
            found = [(s, w) for s, w in found if self.exceptions.isdisjoint(self.phrases(folded, s))]
        total = sum(w for _, w in found)
        words = folded.count(" ") + folded.count("\n") + 1
        return min(100 * total / words, 50.0), math.log1p(total), math.log1p(len(found))


@dataclass
class Model:
    lexicon: Lexicon
    curve: list[float]  # intercept and a factor per feature

    def score(self, text: str) -> float:
        x = self.lexicon.features(fold(text))
        z = self.curve[0] + sum(c * v for c, v in zip(self.curve[1:], x))
        return 1 / (1 + math.exp(-max(-500.0, min(500.0, z))))


def held_out(doc_id) -> bool:
    return zlib.crc32(str(doc_id).encode()) % 4 == 2


def learning_sample(docs: DataFrame, labels: DataFrame, toxic: int = SAMPLE_TOXIC, clean: int = SAMPLE_CLEAN) -> DataFrame:
    """(half, label, text): labelled documents outside the held-out quarter, at most so many of either class.

    They are chosen by a hash of the id. Of documents that agree in two minima over their word shingles, near copies
    of one another, one is taken, so that a text that was copied often does not lend its words weight. Null ids,
    labels and texts are left out; an id with contradicting labels counts as toxic.
    """
    known = labels.where("doc_id IS NOT NULL AND toxic IS NOT NULL").groupBy("doc_id").agg(F.max("toxic").alias("label"))
    # to learn from: where the remainder of the checksum is not that of the held-out quarter
    known = known.where(F.crc32(F.encode(F.col("doc_id").cast("string"), "utf-8")) % 4 != 2)
    place = F.xxhash64("doc_id")
    bounds = {label: least_hashes(known.where(F.col("label") == label), place, most) for label, most in ((1, toxic), (0, clean))}
    ids = known.where(
        ((F.col("label") == 1) & (place <= bounds[1])) | ((F.col("label") == 0) & (place <= bounds[0]))
    )
    # written, so that Spark knows how few they are and sends them to the documents instead of shuffling texts
    ids = written(ids, "sample-ids")
    texts = docs.where("text IS NOT NULL").select("doc_id", "text").join(ids, "doc_id")
    texts = texts.withColumn("words", F.split("text", r"\s+"))  # a column: inside a lambda it would be cut again and again
    words = F.col("words")
    shingles = F.transform(F.sequence(F.lit(0), F.greatest(F.size(words) - 3, F.lit(0))), lambda i: F.xxhash64(F.slice(words, i + 1, 3)))
    marked = texts.select("doc_id", "label", "text", shingles.alias("s")).select(
        "doc_id", "label", "text", F.array_min("s").alias("least"), F.array_max("s").alias("most")
    )
    one = marked.groupBy("least", "most", "label").agg(F.min_by(F.struct("doc_id", "text"), "doc_id").alias("d"))
    return one.select((F.xxhash64("d.doc_id", F.lit(1)) % 2 == 0).alias("half"), "label", F.col("d.text").alias("text"))


def _weigh(pos: int, neg: int, n_pos: int, n_neg: int) -> tuple[float, float]:
    """Log odds ratio (smoothed) and the likelihood-ratio statistic of an entry."""
    weight = math.log((pos + 0.5) / (n_pos - pos + 0.5)) - math.log((neg + 0.5) / (n_neg - neg + 0.5))
    g, n, row = 0.0, n_pos + n_neg, pos + neg
    for seen, expected in (
        (pos, row * n_pos / n), (neg, row * n_neg / n),
        (n_pos - pos, (n - row) * n_pos / n), (n_neg - neg, (n - row) * n_neg / n),
    ):
        if seen:
            g += 2 * seen * math.log(seen / expected)
    return weight, g


def _qualifies(pos: str, neg: str, n_pos: int, n_neg: int) -> Column:
    """Whether an entry passes the tests of :func:`choose_entries`, as a column (a little wider, for the last bits)."""
    if not n_pos or not n_neg:
        return F.lit(False)
    pos, neg = F.expr(pos), F.expr(neg)
    weight = F.log((pos + 0.5) / (n_pos - pos + 0.5)) - F.log((neg + 0.5) / (n_neg - neg + 0.5))
    n, row, support = n_pos + n_neg, pos + neg, F.lit(0.0)
    for seen, expected in (
        (pos, row * n_pos / n), (neg, row * n_neg / n), (n_pos - pos, (n - row) * n_pos / n), (n_neg - neg, (n - row) * n_neg / n),
    ):
        support = support + F.when(seen > 0, 2 * seen * F.log(seen / expected)).otherwise(0.0)
    return (pos >= LEAST_DOCS) & (weight >= LEAST_WEIGHT - 1e-9) & (support >= LEAST_SUPPORT - 1e-9)


def choose_entries(counts: dict[str, tuple[int, int]], n_pos: int, n_neg: int, most: int = ENTRIES) -> dict[str, float]:
    """Entries with their weights.

    Of a word's beginnings that say the same, one is kept: a shorter one with the same documents gives way to the longer, and a
    longer one gives way to a shorter that holds in clearly more documents at no worse a rate.
    """
    if not n_pos or not n_neg:
        return {}
    good = {}
    for entry, (pos, neg) in counts.items():
        if pos >= LEAST_DOCS:
            weight, support = _weigh(pos, neg, n_pos, n_neg)
            if weight >= LEAST_WEIGHT and support >= LEAST_SUPPORT:
                good[entry] = weight, support
    drop = set()
    for entry in good:
        pos, neg = counts[entry]
        text = entry.removesuffix(END)
        for n in range(STEM_LENGTHS[0], len(text) + (entry != text)):
            short = text[:n]
            if short not in good:
                continue
            p, q = counts[short]
            if pos >= 0.95 * p and neg <= q:
                drop.add(short)
            elif p >= 1.1 * pos and (q + 0.5) / p <= 1.5 * (neg + 0.5) / pos:
                drop.add(entry)
    kept = sorted((e for e in good if e not in drop), key=lambda e: (-good[e][1], e))[:most]
    return {e: good[e][0] for e in kept}


def _count_entries(sample: DataFrame, held: int = HELD) -> DataFrame:
    """(entry, pos0, neg0, pos1, neg1): documents per half and class that hold an entry; the row of entry "" has all."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        counts = [Counter() for _ in range(4)]

        def counted() -> pa.RecordBatch:
            names = list(set().union(*counts))
            columns = [pa.array(names, pa.string()), *(pa.array([c[e] for e in names], pa.int64()) for c in counts)]
            for c in counts:
                c.clear()
            return pa.RecordBatch.from_arrays(columns, ["entry", "pos0", "neg0", "pos1", "neg1"])

        for batch in batches:
            for half, label, text in zip(*(c.to_pylist() for c in batch.columns)):
                counts[2 * half + (label != 1)].update({"", *entries_of(fold(text))})
                if sum(map(len, counts)) > held:  # the sum over all parts follows
                    yield counted()
        yield counted()
        free_unused()

    parts = sample.select("half", "label", "text").mapInArrow(run, "entry string, pos0 long, neg0 long, pos1 long, neg1 long")
    return parts.groupBy("entry").agg(*(F.sum(c).alias(c) for c in ("pos0", "neg0", "pos1", "neg1")))


def _count_phrases(sample: DataFrame, lexicon: Lexicon, most: int, held: int = HELD) -> set[str]:
    """Phrases around matched words that clean documents hold, and toxic ones never."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        pos, neg = Counter(), Counter()

        def counted() -> pa.RecordBatch:
            names = list(set(pos) | set(neg))
            columns = [pa.array(names, pa.string()), pa.array([pos[p] for p in names], pa.int64()), pa.array([neg[p] for p in names], pa.int64())]
            pos.clear()
            neg.clear()
            return pa.RecordBatch.from_arrays(columns, ["phrase", "pos", "neg"])

        for batch in batches:
            for _, label, text in zip(*(c.to_pylist() for c in batch.columns)):
                folded = fold(text)
                here = {p for s, _ in lexicon.hits(folded) for p in lexicon.phrases(folded, s)}
                (pos if label == 1 else neg).update(here)
                if len(pos) + len(neg) > held:
                    yield counted()
        yield counted()
        free_unused()

    parts = sample.select("half", "label", "text").mapInArrow(run, "phrase string, pos long, neg long")
    sums = parts.groupBy("phrase").agg(F.sum("pos").alias("pos"), F.sum("neg").alias("neg"))
    rows = sums.where("pos = 0 AND neg >= 2").orderBy(F.desc("neg"), "phrase").limit(most).select("phrase").collect()
    return {r.phrase for r in rows}


def _fit_curve(x: np.ndarray, y: np.ndarray, ridge: float = 1.0, steps: int = 50) -> list[float]:
    """Logistic regression by Newton steps."""
    a = np.column_stack([np.ones(len(x)), x])
    w = np.zeros(a.shape[1])
    penalty = ridge * np.eye(len(w))
    penalty[0, 0] = 1e-3
    for _ in range(steps):
        p = 1 / (1 + np.exp(-np.clip(a @ w, -30, 30)))
        gradient = a.T @ (p - y) + penalty @ w
        move = np.linalg.solve((a * (p * (1 - p))[:, None]).T @ a + penalty, gradient)
        w -= np.clip(move, -5, 5)
        if np.abs(move).max() < 1e-8:
            break
    return w.tolist()


def learn(docs: DataFrame, labels: DataFrame, exceptions: tuple[str, ...] = ()) -> Model:
    """A model from documents (doc_id, text) and labels (doc_id, toxic).

    Counting runs in Spark; the driver receives candidate entries and the features of the learning sample, both
    of bounded number. The curve is fitted on features that each half of the sample gets from the other half's lexicon, so it
    does not trust entries more than new texts bear out. Further exception phrases may be given, as words in their folded form. Without
    both classes among the labels every score is that of the only class (0 without labels).
    """
    sample = written(learning_sample(docs, labels), "labelled")
    counted = written(_count_entries(sample), "entries")
    totals = counted.where(F.col("entry") == "").first()
    p0, n0, p1, n1 = (totals.pos0, totals.neg0, totals.pos1, totals.neg1) if totals else (0, 0, 0, 0)
    if not p0 + p1 or not n0 + n1:
        rate = 30.0 if p0 + p1 else -30.0
        return Model(Lexicon({}), [rate, 0.0, 0.0, 0.0])
    # all that one of the three lexicons can take: as many as a sample of bounded size supports, whatever the corpus
    may = _qualifies("pos0", "neg0", p0, n0) | _qualifies("pos1", "neg1", p1, n1)
    may |= _qualifies("pos0 + pos1", "neg0 + neg1", p0 + p1, n0 + n1)
    strong = counted.where((F.col("entry") != "") & may)
    rows = {r.entry: (r.pos0, r.neg0, r.pos1, r.neg1) for r in strong.collect()}
    halves = [
        Lexicon(choose_entries({e: (r[2], r[3]) for e, r in rows.items()}, p1, n1)),
        Lexicon(choose_entries({e: (r[0], r[1]) for e, r in rows.items()}, p0, n0)),
    ]
    lexicon = Lexicon(choose_entries({e: (r[0] + r[2], r[1] + r[3]) for e, r in rows.items()}, p0 + p1, n0 + n1))
    lexicon.exceptions = _count_phrases(sample, lexicon, EXCEPTIONS) | set(exceptions)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            got = [(float(label == 1), *halves[half].features(fold(text))) for half, label, text in zip(*(c.to_pylist() for c in batch.columns))]
            columns = zip(*got) if got else [[]] * 4
            yield pa.RecordBatch.from_arrays([pa.array(c, pa.float64()) for c in columns], ["y", "a", "b", "c"])

    seen = np.array(sample.select("half", "label", "text").mapInArrow(run, "y double, a double, b double, c double").collect())
    return Model(lexicon, _fit_curve(seen[:, 1:], seen[:, 0]))


def with_toxicity(docs: DataFrame, model: Model, reject: float = REJECT, text: str = "text") -> DataFrame:
    """``docs`` with score (0 to 1) and predicted (1 from ``reject`` on).

    Every whole text is scored, a null one as empty; nothing but the text enters a score. Rows are neither dropped nor
    merged; existing columns of these names are replaced.
    """
    fields = [StructField("score", DoubleType()), StructField("predicted", IntegerType())]

    def make():
        def work(texts: list[str]):
            scores = [model.score(t) for t in texts]
            return scores, [int(s >= reject) for s in scores]

        return work

    return with_text_columns(docs, fields, make, text)
