"""Secrets in texts: fixed patterns, and strings that look random to a pair of Markov models.

One model holds the character transitions of random strings, the other those of ordinary identifiers and words; a
string is reported if its mean log-likelihood ratio per character passes a threshold. Both
models are counted from labelled samples.
"""

from __future__ import annotations

import math
import re
from collections.abc import Iterable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import LongType, StringType, StructField

from chalkline.llm.batches import least_hashes, with_text_columns

# The base patterns.
ASSIGN = re.compile(
    r"""(?i:password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", re.ASCII
)
ACCESS = re.compile(r"AKIA[A-Z0-9]+")
HEX = re.compile(r"[0-9a-f]{32,}")  # whole runs of [0-9a-f] of this length
ASSIGN_LEAST, ACCESS_LEAST = 8, 16
KINDS = ("assign", "access", "hex", "random")

#: Strings the models judge.
CANDIDATE = re.compile(r"[A-Za-z0-9+/_=-]{20,}")
IDENTIFIER = re.compile(r"[A-Za-z][A-Za-z0-9_-]{5,}")
#: Mean log-likelihood ratio per transition (nats) from which a string counts as random.
THRESHOLD = 0.75
#: Observations that the distribution of single characters is worth in each state.
BACKOFF = 10.0
#: Most documents that labelled samples are taken from.
SAMPLE_DOCS = 4000

_SYMBOLS = "abcdefghijklmnopqrstuvwxyzABCDEFGHIJKLMNOPQRSTUVWXYZ0123456789+/_=-."
_CODE = np.full(128, len(_SYMBOLS), np.int64)
_CODE[[ord(c) for c in _SYMBOLS]] = np.arange(len(_SYMBOLS))
STATES = len(_SYMBOLS) + 1

Span = tuple[int, int, int]  # start, kind, end


def base_spans(text: str) -> list[Span]:
    """The spans of the fixed patterns, leftmost and non-overlapping per kind."""
    out = [(m.start(), 0, m.end()) for m in ASSIGN.finditer(text) if m.end() - m.start(1) >= ASSIGN_LEAST]
    out += [(m.start(), 1, m.end()) for m in ACCESS.finditer(text) if m.end() - m.start() >= ACCESS_LEAST]
    out += [(m.start(), 2, m.end()) for m in HEX.finditer(text)]
    return sorted(out)


def written_spans(spans: Iterable[Span]) -> str:
    return ",".join(f"{KINDS[kind]}:{start}:{end}" for start, kind, end in spans)


def transitions(text: str) -> np.ndarray:
    """The states a string passes through, two rows: from and to."""
    codes = np.frombuffer(text.encode("ascii", "replace"), np.uint8)
    states = np.where(codes < 128, _CODE[np.minimum(codes, 127)], STATES - 1)
    return np.stack([states[:-1], states[1:]])


def labelled_strings(text: str) -> Iterator[tuple[int, str]]:
    """(1, random string) for what the patterns found, (0, word) for words elsewhere."""
    spans = base_spans(text)
    for start, kind, end in spans:
        value = ASSIGN.match(text, start).group(1) if kind == 0 else text[start:end]
        yield 1, value
    taken = [(s, e) for s, _, e in spans]
    at = 0
    for m in IDENTIFIER.finditer(text):
        while at < len(taken) and taken[at][1] <= m.start():
            at += 1
        if at == len(taken) or m.end() <= taken[at][0]:
            yield 0, m.group()


def labelled_samples(docs: DataFrame, most: int = SAMPLE_DOCS, text: str = "text", key: str = "doc_id") -> DataFrame:
    """(label, string): labelled strings of at most ``most`` documents, those with the least hashes of key and text.

    Only hashes are ranked; the documents below a rank are then read in place, so no text is shuffled.
    """
    place = F.xxhash64(key, text)
    low = least_hashes(docs, place, most)
    chosen = docs.select(F.col(text).alias("text"), place.alias("h")).where(F.col("h") <= low)
    chosen = chosen.select("text")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            pairs = [p for t in batch.column(0).to_pylist() for p in labelled_strings(t or "")]
            yield pa.RecordBatch.from_arrays(
                [pa.array([p[0] for p in pairs], pa.int32()), pa.array([p[1] for p in pairs], pa.string())], ["label", "string"]
            )

    return chosen.mapInArrow(run, "label int, string string")


def fit(samples: DataFrame) -> np.ndarray:
    """The log-likelihood ratio of every transition, from (label, string): 1 random, 0 ordinary.

    Transition counts are added up in Spark; the driver gets one number per label and transition. In the model of a
    label without samples all transitions are alike. Null labels and strings are ignored.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        counts = np.zeros((2, STATES, STATES), np.int64)
        for batch in batches:
            for label, string in zip(*(c.to_pylist() for c in batch.columns)):
                np.add.at(counts[int(label == 1)], tuple(transitions(string)), 1)
        at = np.argwhere(counts)
        names = ["label", "a", "b", "n"]
        yield pa.RecordBatch.from_arrays([pa.array(c) for c in (*at.T, counts[tuple(at.T)])], names)

    rows = samples.select("label", "string").where("label IS NOT NULL AND string IS NOT NULL")
    per_task = rows.mapInArrow(run, "label long, a long, b long, n long")
    counts = np.zeros((2, STATES, STATES))
    for r in per_task.groupBy("label", "a", "b").agg(F.sum("n").alias("n")).collect():
        counts[r.label, r.a, r.b] += r.n
    # rare states lean on how often a character occurs at all
    single = (counts.sum(axis=1) + 1) / (counts.sum(axis=(1, 2)) + STATES)[:, None]
    logs = np.log((counts + BACKOFF * single[:, None, :]) / (counts.sum(axis=2, keepdims=True) + BACKOFF))
    return logs[1] - logs[0]


def ratio(string: str, model: np.ndarray) -> float:
    """Mean log-likelihood ratio per transition."""
    steps = transitions(string)
    return float(model[steps[0], steps[1]].mean()) if steps.size else -math.inf


def random_spans(text: str, base: list[Span], model: np.ndarray, threshold: float = THRESHOLD) -> list[Span]:
    """Random-looking strings outside the base spans, which are sorted; both are walked once."""
    out, at, reach = [], 0, 0
    for m in CANDIDATE.finditer(text):
        while at < len(base) and base[at][0] < m.end():
            reach, at = max(reach, base[at][2]), at + 1
        if reach <= m.start() and ratio(m.group(), model) >= threshold:
            out.append((m.start(), 3, m.end()))
    return out


def with_secrets(
    docs: DataFrame, model: np.ndarray, threshold: float = THRESHOLD, text: str = "text"
) -> DataFrame:
    """``docs`` with n_assign, n_access, n_hex, base_spans and spans.

    Spans are ``kind:start:end`` in code points, end exclusive, by start and then kind, joined by commas. A null or
    empty text has none. Rows are neither dropped nor merged; existing columns of these names are replaced.
    """
    fields = [StructField(n, LongType()) for n in ("n_assign", "n_access", "n_hex")]
    fields += [StructField(n, StringType()) for n in ("base_spans", "spans")]

    def make():
        def work(texts: list[str]):
            out = [[] for _ in fields]
            for t in texts:
                base = base_spans(t)
                every = sorted(base + random_spans(t, base, model, threshold))
                kinds = [k for _, k, _ in base]
                for column, value in zip(out, [*(kinds.count(k) for k in range(3)), written_spans(base), written_spans(every)]):
                    column.append(value)
            return out

        return work

    return with_text_columns(docs, fields, make, text)


def redacted(text: Column | str, spans: Column | str, mask: str = "[SECRET]") -> Column:
    """The text with its spans replaced by ``mask``; overlapping spans become one."""
    text, spans = (F.col(c) if isinstance(c, str) else c for c in (text, spans))
    ends = F.transform(
        F.filter(F.split(spans, ","), lambda s: s != ""),
        lambda s: F.struct(F.split_part(s, F.lit(":"), F.lit(2)).cast("int").alias("a"), F.split_part(s, F.lit(":"), F.lit(3)).cast("int").alias("b")),
    )
    start = F.struct(F.lit("").alias("out"), F.lit(0).alias("done"))
    folded = F.aggregate(
        ends, start,
        lambda acc, e: F.struct(
            F.when(e["a"] >= acc["done"], F.concat(acc["out"], F.substring(text, acc["done"] + 1, e["a"] - acc["done"]), F.lit(mask)))
            .otherwise(acc["out"]).alias("out"),
            F.greatest(acc["done"], e["b"]).alias("done"),
        ),
        lambda acc: F.concat(acc["out"], F.substring(text, acc["done"] + 1, F.length(text))),
    )
    return F.when(F.coalesce(spans, F.lit("")) == "", text).otherwise(folded)
