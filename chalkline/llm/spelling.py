"""Groups of words that differ by one edit: the vocabulary's acceptor, a one-edit transducer and the acceptor again.

The composition accepts the pairs of words one insertion, deletion or replacement apart. It is enumerated by
partitions of its initial states: of two words one edit apart either the first or the second half of the shorter one is
common to both at its place, so one partition holds the words that leave the start by the same half, read from
that end. Within a partition the words are a minimised acceptor, and since the two copies are in one state until the edit,
the composition follows single states up to it and pairs of states behind it, where only what both accept is left.
"""

from __future__ import annotations

import re
import zlib
from collections import Counter
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from chalkline.session import written

#: What a word is made of, and which runs lose a code point.
RUN = re.compile("[A-Za-zÀ-ÿ]+")
LOWER = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")
DROP = 97
LEAST_LENGTH, LEAST_COUNT, RATIO = 5, 3, 2
#: Distinct words that a task counts before it passes them on.
HELD_WORDS = 200_000


# --- vocabulary -------------------------------------------------------------------------

def read_run(doc_id, run: str) -> str:
    """The word a lower-cased run of a document stands for: one run in 97, by checksum, loses a code point."""
    h = zlib.crc32(f"{doc_id}:{run}".encode())
    if h % DROP:
        return run
    at = h % len(run)
    return run[:at] + run[at + 1 :]


def vocabulary(
    docs: DataFrame, least_length: int = LEAST_LENGTH, least_count: int = LEAST_COUNT, text: str = "text", key: str = "doc_id"
) -> DataFrame:
    """(word, n): the words of whole texts with at least so many code points and occurrences.

    A word is a run of Latin letters (A-Z, a-z and U+00C0 to U+00FF), A-Z lower-cased, after :func:`read_run`. Null and empty texts
    have none; a null key reads as the text "null"; repeated rows count as often as they occur. Counts are added up in
    every task before they are shuffled. Only key and text are read.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        counts: Counter[str] = Counter()

        def rows() -> pa.RecordBatch:
            return pa.RecordBatch.from_arrays(
                [pa.array(list(counts), pa.string()), pa.array(list(counts.values()), pa.int64())], ["word", "n"]
            )

        for batch in batches:
            for doc_id, body in zip(*(c.to_pylist() for c in batch.columns)):
                for word, n in Counter(RUN.findall((body or "").translate(LOWER))).items():
                    word = read_run("null" if doc_id is None else doc_id, word)
                    if len(word) >= least_length:
                        counts[word] += n
                if len(counts) > HELD_WORDS:
                    yield rows()
                    counts.clear()
        yield rows()

    parts = docs.select(key, text).mapInArrow(run, "word string, n long")
    return parts.groupBy("word").agg(F.sum("n").alias("n")).where(F.col("n") >= least_count)


# --- automata ---------------------------------------------------------------------------

class Acceptor:
    """The minimised acceptor of a set of words: states are numbers, equal right languages are one state."""

    def __init__(self, words: list[str]):
        self.arcs: list[dict[str, int]] = []
        self.final: list[bool] = []
        self._known: dict[tuple, int] = {}
        self._shared: dict[tuple[int, int], tuple[str, ...]] = {}
        self._edits: dict[int, list[tuple[str, str]]] = {}
        words = sorted(set(words))
        self.start = self._state(words, 0, 0, len(words)) if words else None

    def _state(self, words: list[str], depth: int, lo: int, hi: int) -> int:
        """The state after the first ``depth`` code points of words[lo:hi], which they share."""
        final = len(words[lo]) == depth
        arcs, at = {}, lo + final
        while at < hi:
            c, end = words[at][depth], at + 1
            while end < hi and words[end][depth] == c:
                end += 1
            arcs[c] = self._state(words, depth + 1, at, end)
            at = end
        known = (final, *arcs.items())
        if known not in self._known:
            self._known[known] = len(self.arcs)
            self.arcs.append(arcs)
            self.final.append(final)
        return self._known[known]

    def shared(self, p: int, q: int) -> tuple[str, ...]:
        """What both states accept."""
        pair = (p, q) if p <= q else (q, p)
        if pair not in self._shared:
            a, b = self.arcs[p], self.arcs[q]
            out = [""] if self.final[p] and self.final[q] else []
            for c in a.keys() & b.keys():
                out += [c + rest for rest in self.shared(a[c], b[c])]
            self._shared[pair] = tuple(out)
        return self._shared[pair]

    def edits(self, state: int) -> list[tuple[str, str]]:
        """Pairs of endings from ``state`` whose first code point is the edit: replaced, or in the first one only."""
        if state not in self._edits:
            arcs, out = list(self.arcs[state].items()), []
            for i, (c, p) in enumerate(arcs):
                for d, q in arcs[:i]:
                    out += [(c + rest, d + rest) for rest in self.shared(p, q)]
                out += [(c + rest, rest) for rest in self.shared(p, state)]
            self._edits[state] = out
        return self._edits[state]

    def near_pairs(self) -> set[tuple[str, str]]:
        """All pairs of accepted words one edit apart, the longer one first."""
        out: set[tuple[str, str]] = set()
        todo = [("", self.start)] if self.start is not None else []
        while todo:
            read, state = todo.pop()
            out.update((read + a, read + b) for a, b in self.edits(state))
            todo += [(read + c, q) for c, q in self.arcs[state].items()]
        return out


# --- pairs ------------------------------------------------------------------------------

def near_words(words: DataFrame) -> DataFrame:
    """(word, near, near_n): for every word of (word, n) the words one edit away, each once, in both directions.

    A partition is (length of the shorter word, half, the half's code points); a pair has one shorter length, and where both halves
    agree the first one counts, so no pair is found twice.
    """
    size = F.length("word")
    lengths = F.explode(F.array(size, size - 1)).alias("short")
    keyed = words.select("word", "n", lengths)
    first = F.floor(F.col("short") / 2).cast("int")
    ends = F.array(
        F.struct(F.lit(True).alias("front"), F.substring("word", F.lit(1), first).alias("half")),
        F.struct(F.lit(False).alias("front"), F.substring("word", first - F.col("short"), F.col("short") - first).alias("half")),
    )
    rows = keyed.where("short > 0").select("word", "n", "short", F.explode(ends).alias("e")).select("short", "e.*", "word", "n")
    place = ["short", "front", "half"]
    # of longer words alone there is no pair; this also spares sending partitions of one word to Python
    alive = rows.groupBy(*place).agg(F.count("*").alias("c"), F.min(F.length("word")).alias("l"))
    alive = alive.where((F.col("c") > 1) & (F.col("l") == F.col("short"))).select(*place)
    dealt = rows.join(alive, place).select(*place, "word", "n").repartition(*place).sortWithinPartitions(*place)

    def pairs(short: int, front: bool, counts: dict[str, int]) -> Iterator[tuple[str, str]]:
        half = short // 2 if front else short - short // 2
        cut = (lambda w: w[half:]) if front else (lambda w: w[: len(w) - half][::-1])
        whole = {cut(w): w for w in counts}
        for a, b in Acceptor(list(whole)).near_pairs():
            a, b = whole[a], whole[b]
            if len(b) == short and (front or a[: short // 2] != b[: short // 2]):
                yield a, b
                yield b, a

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        at, counts, found = None, {}, []

        def rows_of(found: list[tuple[str, str, int]]) -> pa.RecordBatch:
            columns = list(zip(*found)) or [[], [], []]
            kinds = (pa.string(), pa.string(), pa.int64())
            return pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(columns, kinds)], ["word", "near", "near_n"])

        for batch in batches:
            for short, front, half, word, n in zip(*(c.to_pylist() for c in batch.columns)):
                if (short, front, half) != at:
                    if counts:
                        found += [(a, b, counts[b]) for a, b in pairs(*at[:2], counts)]
                    at, counts = (short, front, half), {}
                counts[word] = n
                if len(found) > 50_000:
                    yield rows_of(found)
                    found = []
        if counts:
            found += [(a, b, counts[b]) for a, b in pairs(*at[:2], counts)]
        yield rows_of(found)

    return dealt.mapInArrow(run, "word string, near string, near_n long")


def roots(forms: DataFrame) -> DataFrame:
    """(word, root) of (word, form): where following forms ends. Every round doubles the steps; forms have no cycles."""
    state = written(forms.select("word", F.col("form").alias("root")), "roots")
    while True:
        ahead = state.select(F.col("word").alias("root"), F.col("root").alias("_next"))
        jumped = state.join(ahead, "root", "left").select("word", F.coalesce("_next", "root").alias("root"), F.col("_next").isNotNull().alias("_moved"))
        state = written(jumped, "roots")
        if state.where("_moved").isEmpty():
            return state.select("word", "root")
        state = state.drop("_moved")


def variants(words: DataFrame, ratio: int = RATIO) -> DataFrame:
    """(word, form, root, n, n_near, form_n) for every word of (word, n), words distinct.

    ``n_near`` is how many words are one edit away. ``form`` is the one of largest n (ties: smallest in code-point order), if
    that n is at least ``ratio`` times the word's own; else null, and form_n with it. ``root`` is where following forms ends, the
    word itself if it has none. A null word is ignored, no words give no rows. Only word and n are read.
    """
    held = written(words.where("word IS NOT NULL").select("word", "n"), "vocabulary")
    # text order is that of code points
    best = F.min(F.struct((-F.col("near_n")).alias("m"), F.col("near")))
    near = near_words(held).groupBy("word").agg(F.count("*").alias("n_near"), best.alias("b"))
    joined = held.join(near, "word", "left")
    fits = -F.col("b.m") >= ratio * F.col("n")
    formed = written(joined.select(
        "word", "n", F.coalesce("n_near", F.lit(0)).cast("long").alias("n_near"), F.when(fits, F.col("b.near")).alias("form"),
        F.when(fits, -F.col("b.m")).alias("form_n"),
    ), "forms")
    ends = roots(formed.where("form IS NOT NULL"))
    return formed.join(ends, "word", "left").select(
        "word", "form", F.coalesce("root", "word").alias("root"), "n", "n_near", "form_n"
    )
