"""Token ids in Re-Pair compressed shards with random access.

A shard holds the ids of consecutive documents. Frequent adjacent pairs become nonterminals, round
by round, and the shard stores the rules, the expansion length of every nonterminal and the
sequence that is left. Any range of ids is decoded by finding its symbols from the lengths and
expanding only those.

Layout of a shard, little-endian: magic, then base id, number of rules, symbols and documents as
u32; rules as pairs of u32; expansion lengths as u32; the symbol width (2 or 4 bytes) as u32; the
symbols; the documents' lengths as u32.
"""

from __future__ import annotations

import struct
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from chalkline.llm.pieces import table

TOKENIZER = "byte_bpe_50k.json"
END_ID = 0
SHARD_TOKENS = 1 << 20
RULES_PER_ROUND = 1024
LEAST_COUNT = 32
MAGIC = b"RPAIRv1\0"
_TEXTS = 500

SHARD_SCHEMA = "part long, seq long, n_tokens long, doc_ids array<long>, shard binary"


def compress(
    ids: np.ndarray, base: int, rounds: int | None = None, per_round: int = RULES_PER_ROUND, least: int = LEAST_COUNT
) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(symbols, rules, expansion lengths): symbols from ``base`` on stand for pairs of symbols.

    Each round counts all adjacent pairs and replaces the ``per_round`` most frequent ones that
    occur ``least`` times or more; where chosen pairs overlap, the leftmost is replaced. It ends when no pair is that
    frequent, or after ``rounds``.
    """
    symbols = ids
    rules = np.zeros((0, 2), np.int64)
    while len(symbols) > 1 and (rounds is None or rounds > 0):
        rounds = None if rounds is None else rounds - 1
        # a pair is one number; 32 bits hold it while symbols fit 16
        kind, shift = (np.uint32, 16) if base + len(rules) + per_round <= 1 << 16 else (np.uint64, 32)
        symbols = symbols.astype(kind)
        pairs = (symbols[:-1] << kind(shift)) | symbols[1:]
        ordered = np.sort(pairs)
        first = np.flatnonzero(np.append(True, ordered[1:] != ordered[:-1]))
        count = np.diff(first, append=len(ordered))
        often = np.flatnonzero(count >= least)
        if not len(often):
            break
        often = often[np.argsort(-count[often], kind="stable")[:per_round]]
        chosen = np.sort(ordered[first[often]])
        # the chosen pairs as a small table: rows for their left symbols, columns for their right ones
        left, right = chosen >> kind(shift), chosen & kind((1 << shift) - 1)
        size = base + len(rules)
        row, column = np.zeros(size, np.int32), np.zeros(size, np.int32)
        rows, columns = np.unique(left), np.unique(right)
        row[rows], column[columns] = np.arange(1, len(rows) + 1), np.arange(1, len(columns) + 1)
        table = np.full((len(rows) + 1) * (len(columns) + 1), -1, np.int32)
        table[row[left] * (len(columns) + 1) + column[right]] = np.arange(len(chosen))
        found = table[row[symbols[:-1]] * (len(columns) + 1) + column[symbols[1:]]]
        at = np.flatnonzero(found >= 0)
        rule = found[at]
        # of neighbouring hits, every other one counts
        starts = np.append(True, np.diff(at) != 1)
        run = np.flatnonzero(starts)
        even = (np.arange(len(at)) - np.repeat(run, np.diff(run, append=len(at)))) % 2 == 0
        at, rule = at[even], rule[even]
        symbols[at] = (base + len(rules) + rule).astype(kind)
        keep = np.ones(len(symbols), bool)
        keep[at + 1] = False
        symbols = symbols[keep]
        rules = np.concatenate([rules, np.stack([left, right], 1).astype(np.int64)])
    lengths = np.ones(len(rules), np.int64)
    for i, (a, b) in enumerate(rules.tolist()):
        lengths[i] = (lengths[a - base] if a >= base else 1) + (lengths[b - base] if b >= base else 1)
    return symbols.astype(np.int64), rules, lengths


def expand(symbols: np.ndarray, rules: np.ndarray, base: int) -> np.ndarray:
    """The ids that symbols stand for."""
    while (inner := symbols >= base).any():
        width = 1 + inner
        out = np.repeat(symbols, width)
        at = (np.cumsum(width) - width)[inner]
        pair = rules[symbols[inner] - base]
        out[at], out[at + 1] = pair[:, 0], pair[:, 1]
        symbols = out
    return symbols


def expand_all(symbols: np.ndarray, rules: np.ndarray, lengths: np.ndarray, base: int) -> np.ndarray:
    """As :func:`expand`, for many symbols: every rule is expanded once and copied from there, unless rules are longer
    than the ids."""
    inner = symbols >= base
    width = np.ones(len(symbols), np.int64)
    width[inner] = lengths[symbols[inner] - base]
    if lengths.sum() > width.sum():
        return expand(symbols, rules, base)
    # one place for every id that is a symbol itself, then the rules
    table = np.concatenate([np.arange(base), expand(np.arange(base, base + len(rules)), rules, base)])
    start = symbols.copy()
    start[inner] = (base + np.cumsum(lengths) - lengths)[symbols[inner] - base]
    return table[np.repeat(start - np.cumsum(width) + width, width) + np.arange(width.sum())]


def pack(documents: list[np.ndarray], base: int) -> bytes:
    """The bytes of a shard."""
    symbols, rules, lengths = compress(np.concatenate(documents), base)
    width = 2 if base + len(rules) <= 1 << 16 else 4
    head = struct.pack("<4I", base, len(rules), len(symbols), len(documents))
    sizes = np.array([len(d) for d in documents], "<u4")
    return b"".join([
        MAGIC, head, rules.astype("<u4").tobytes(), lengths.astype("<u4").tobytes(), struct.pack("<I", width),
        symbols.astype(f"<u{width}").tobytes(), sizes.tobytes(),
    ])


class Shard:
    """Reader of a shard's bytes."""

    def __init__(self, data: bytes):
        if data[:8] != MAGIC:
            raise ValueError("not a shard")
        self.base, n_rules, n_symbols, n_docs = struct.unpack_from("<4I", data, 8)
        at = 24
        self.rules = np.frombuffer(data, "<u4", 2 * n_rules, at).reshape(-1, 2).astype(np.int64)
        at += 8 * n_rules
        self.lengths = np.frombuffer(data, "<u4", n_rules, at).astype(np.int64)
        at += 4 * n_rules
        (width,) = struct.unpack_from("<I", data, at)
        self.symbols = np.frombuffer(data, f"<u{width}", n_symbols, at + 4).astype(np.int64)
        self.sizes = np.frombuffer(data, "<u4", n_docs, at + 4 + width * n_symbols).astype(np.int64)
        inner = self.symbols >= self.base
        reach = np.ones(n_symbols, np.int64)
        reach[inner] = self.lengths[self.symbols[inner] - self.base]
        self.ends = np.cumsum(reach)
        self.doc_ends = np.cumsum(self.sizes)

    def ids(self, start: int, stop: int) -> np.ndarray:
        """Ids ``start`` to ``stop`` of the shard, expanding only the symbols that hold them."""
        if stop <= start:
            return np.zeros(0, np.int64)
        first = int(np.searchsorted(self.ends, start, "right"))
        last = int(np.searchsorted(self.ends, stop - 1, "right"))
        before = int(self.ends[first - 1]) if first else 0
        return expand(self.symbols[first : last + 1], self.rules, self.base)[start - before : stop - before]

    def all_ids(self) -> np.ndarray:
        """Ids of the whole shard."""
        return expand_all(self.symbols, self.rules, self.lengths, self.base)

    def document(self, k: int) -> np.ndarray:
        """Ids of the k-th document, the end id with it."""
        return self.ids(int(self.doc_ends[k] - self.sizes[k]), int(self.doc_ends[k]))


def write_shards(
    docs: DataFrame, path: str, tokenizer: str = TOKENIZER, end_id: int = END_ID, shard_tokens: int = SHARD_TOKENS
) -> None:
    """Encode whole texts, append ``end_id`` to each, and write shards in ascending doc_id order.

    The table at ``path`` has one row per shard: (part, seq) is its place in the order, doc_ids names
    its documents. A shard closes once it has ``shard_tokens`` ids, so only a longer document makes
    a longer shard. A null text is empty (just the end id), null doc_ids come first, rows that
    share a doc_id stay apart and are ordered by their texts' hash. Only doc_id and text are read; other columns
    are ignored. An empty input writes an empty table.
    """
    rows = docs.select("doc_id", F.coalesce("text", F.lit("")).alias("text"))
    order = [F.col("doc_id").asc_nulls_first(), F.xxhash64("text")]
    dealt = rows.repartitionByRange(*order).sortWithinPartitions(*order)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        pieces = table(tokenizer)
        base = pieces.tokenizer.get_vocab_size(with_added_tokens=True)
        part, seq, names, held, total = TaskContext.get().partitionId(), 0, [], [], 0

        def row() -> pa.RecordBatch:
            values = [[part], [seq], [total], [names], [pack(held, base)]]
            kinds = [pa.int64(), pa.int64(), pa.int64(), pa.list_(pa.int64()), pa.binary()]
            return pa.RecordBatch.from_arrays(
                [pa.array(v, k) for v, k in zip(values, kinds)], ["part", "seq", "n_tokens", "doc_ids", "shard"]
            )

        for batch in batches:
            for at in range(0, batch.num_rows, _TEXTS):
                doc_ids, texts = (c.to_pylist() for c in batch.slice(at, _TEXTS).columns)
                for doc_id, ids in zip(doc_ids, pieces.ids(texts)):
                    names.append(doc_id)
                    held.append(np.append(ids, np.int32(end_id)))
                    total += len(held[-1])
                    if total >= shard_tokens:
                        yield row()
                        seq, names, held, total = seq + 1, [], [], 0
        if held:
            yield row()

    dealt.mapInArrow(run, SHARD_SCHEMA).write.mode("overwrite").parquet(path)


def read_documents(spark: SparkSession, path: str) -> DataFrame:
    """(doc_id, start, n_tokens, ids_crc32, shard_part, shard_seq, doc_no) per document, decoded from the shards.

    ``start`` counts the ids of all documents before, ``ids_crc32`` is over the ids as little-endian
    u32. Places of shards come from two small sums, over parts and within a part.
    """
    shards = spark.read.schema(SHARD_SCHEMA).parquet(path)
    sizes = shards.select("part", "seq", "n_tokens")
    parts = sizes.groupBy("part").agg(F.sum("n_tokens").alias("part_tokens"))
    part_start = F.sum("part_tokens").over(Window.orderBy("part")) - F.col("part_tokens")
    within = Window.partitionBy("part").orderBy("seq")
    places = sizes.withColumn("within", F.sum("n_tokens").over(within) - F.col("n_tokens")).join(
        parts.select("part", part_start.alias("part_start")), "part"
    ).select("part", "seq", (F.col("part_start") + F.col("within")).alias("shard_start"))
    fields = "doc_id long, part long, seq long, doc_no long, before long, n_tokens long, ids_crc32 long"

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for r in batch.to_pylist():
                shard = Shard(r["shard"])
                n = len(shard.sizes)
                # all of them, so the shard is expanded at once
                ids = shard.all_ids().astype("<u4")
                crcs = [zlib.crc32(d) for d in np.split(ids, shard.doc_ends[:-1])]
                columns = [r["doc_ids"], [r["part"]] * n, [r["seq"]] * n, range(n), shard.doc_ends - shard.sizes, shard.sizes, crcs]
                names = ["doc_id", "part", "seq", "doc_no", "before", "n_tokens", "ids_crc32"]
                yield pa.RecordBatch.from_arrays([pa.array(c, pa.int64()) for c in columns], names)

    decoded = shards.select("part", "seq", "doc_ids", "shard").mapInArrow(run, fields)
    return decoded.join(places, ["part", "seq"]).select(
        "doc_id", (F.col("shard_start") + F.col("before")).alias("start"), "n_tokens", "ids_crc32",
        F.col("part").alias("shard_part"), F.col("seq").alias("shard_seq"), "doc_no",
    )
