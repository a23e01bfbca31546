"""Classes of texts whose word n-gram sets are similar: a prefix-tree join, verified exactly.

All n-grams have one global order: common ones last, by hash otherwise. They are counted over all texts, among the n-grams that
hashes alone would put first in a set. A set is stored as a path of
a trie in that order. Two sets with a Jaccard similarity of p percent share an n-gram among the first
n - ceil(p n / 100) + 1 of each (their prefixes), so the trie is dealt out by n-gram: the tree of an n-gram holds, of every
set with it in its prefix, the path that follows. A tree is traversed with all its sets at once, level by level: sets
with the same path so far share a node and the overlap found on the way, and a subtree is left as soon as the
overlap and what remains of both sides, by the shortest and longest sets below, cannot reach the similarity. Pairs that are left are
compared by parity sketches (bits that an odd number of n-grams set: no more of them differ than n-grams), and then verified on the whole sets.

Classes, not pairs, are wanted: neighbours in a tree (or in seed groups that the caller knows) are verified first,
and only sets that these links do not connect are then searched. A search goes in rounds: a set names its closest partners of a tree,
links found among them join classes, and sets that had more partners are searched again between classes, with more partners each.
So a large group of similar sets costs a few pairs a set, not all its pairs, and none is left out. Sets are compared by 63-bit n-gram hashes. The order
decides how much work is done, never the result.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from chalkline.llm.batches import free_unused, small_batches
from chalkline.llm.components import connected
from chalkline.llm.shingles import set_ids, shingle_sets, text_groups
from chalkline.session import written

SIZE, PERCENT = 3, 90
#: A common n-gram is in so many sets of a corpus of so many texts, and in up to ``GROWTH`` times as many sets of a larger one; at
#: most so many, the most frequent, are sent to the tasks. The first ones of a set by hash, one in so many, are counted, or its prefix.
COMMON, SAMPLE_DOCS, GROWTH, MOST_COMMON, COUNTED = 4, 20_000, 8, 1_000_000, 5
#: Neighbours are verified first if they meet in one tree of so many that a set is in.
OFTEN = 3
#: Tokens of a path that travel with it; what lies deeper is left to verification.
DEPTH = 32
#: 64-bit words of a sketch at least, how many n-grams a bit of a longer one stands for at most, and the share of a sketch's bits that
#: similar sets may differ in at most: sets that share nothing differ in nearly half of them.
LEAST_WORDS, BIT_GRAMS, FAR = 4, 2, 0.25
#: Words of sketches that are compared at a time.
COMPARED = 1 << 20
#: Trees of more sets are worked on in blocks of this size, two at a time.
TREE_ROWS = 16_384
#: Pairs of a set and a node that are looked at together.
FRONTIER = 30_000
#: Partners that a set names in a tree in the first round, and how many times as many in the next.
PARTNERS, MORE = 2, 8
_END = np.int64(2**63 - 1)
_LATE = np.int64(-(2**63))


# --- sets -------------------------------------------------------------------------------

def prefix_length(n, percent: int):
    """First n-grams of a set of ``n`` of which a similar set must share one; 0 of an empty set."""
    return np.where(n > 0, n - -(-percent * n // 100) + 1, 0)


def _hashed(rows: DataFrame, size: int) -> DataFrame:
    """(set_id, shingles) per row of (key, text)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part, texts in text_groups(batch, 1):
                hashes, counts = shingle_sets(texts, size)
                columns = [pa.array(set_ids(hashes, counts)), _lists(hashes, counts)]
                yield pa.RecordBatch.from_arrays(columns, ["set_id", "shingles"])

    return rows.mapInArrow(run, "set_id long, shingles array<bigint>")


def _first_grams(rows: DataFrame, size: int, percent: int) -> DataFrame:
    """(set_id, grams) per row of (key, text): the n-grams that come first in the set by hash alone, as many as its prefix has, or more."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part, texts in text_groups(batch, 1):
                hashes, n = shingle_sets(texts, size)
                length = np.maximum(prefix_length(n, percent), n // COUNTED)
                within = np.arange(len(hashes)) - np.repeat(np.cumsum(n) - n, n) < np.repeat(length, n)
                columns = [pa.array(set_ids(hashes, n)), _lists(hashes[within], length)]
                yield pa.RecordBatch.from_arrays(columns, ["set_id", "grams"])

    return rows.mapInArrow(run, "set_id long, grams array<bigint>")


def _common(rows: DataFrame, size: int, percent: int) -> np.ndarray:
    """Sorted hashes of n-grams that many sets hold among their first. Every text is counted, copies once."""
    least = COMMON * min(GROWTH, max(1.0, rows.count() / max(1, SAMPLE_DOCS)))
    sets = _first_grams(rows, size, percent).dropDuplicates(["set_id"])
    counts = sets.select(F.explode("grams").alias("h")).groupBy("h").count().where(F.col("count") >= least)
    most = counts.orderBy(F.desc("count"), "h").limit(MOST_COMMON).select("h").toArrow()
    return np.sort(most.column(0).to_numpy())


def bit_grams(percent: int) -> float:
    """N-grams that a bit of a sketch stands for at most, a power of two: the less similar sets need be, the more bits tell them
    from others."""
    grams = BIT_GRAMS
    while 2 * grams * (100 - percent) > FAR * (100 + percent):
        grams /= 2
    return grams


def sketches(hashes: np.ndarray, n: np.ndarray, percent: int = PERCENT) -> tuple[np.ndarray, np.ndarray]:
    """Parity sketches of sets and their lengths in 64-bit words, a power of two that grows with the set: a sketch of
    fixed length fills up, and two long sets then look alike.

    A sketch is that of half its length once its halves are joined by exclusive or."""
    grams = bit_grams(percent)
    words = np.maximum(n / (64 * grams), LEAST_WORDS)
    length = 2 ** np.ceil(np.log2(words)).astype(np.int64)
    bits = 64 * length
    at = np.repeat(np.cumsum(bits) - bits, n) + (hashes & np.repeat(bits - 1, n))
    odd = np.bincount(at, minlength=int(bits.sum())) & 1
    return np.packbits(odd.astype(bool), bitorder="little").view("<i8"), length


def differing(words: np.ndarray, length: np.ndarray, i: np.ndarray, j: np.ndarray) -> np.ndarray:
    """Bits in which the sketches of rows ``i`` and ``j`` differ, the longer one of a pair folded once; 0 where lengths are
    further apart. ``words`` has the sketches one behind the other."""
    start = np.cumsum(length) - length
    found = np.zeros(len(i), np.int64)
    short = np.minimum(length[i], length[j])
    for m in np.unique(short):
        chosen = np.flatnonzero((short == m) & (np.maximum(length[i], length[j]) <= 2 * m))
        for at in range(0, len(chosen), max(1, COMPARED // int(m))):
            some = chosen[at : at + max(1, COMPARED // int(m))]
            both = np.zeros((len(some), m), np.int64)
            for end in (i[some], j[some]):
                place = start[end][:, None] + np.arange(m)
                both ^= words[place]
                twice = length[end] == 2 * m
                both[twice] ^= words[place[twice] + m]
            found[some] = np.bitwise_count(both.view(np.uint64)).sum(axis=1, dtype=np.int64)
    return found


def _lists(values: np.ndarray, length: np.ndarray) -> pa.Array:
    return pa.ListArray.from_arrays(pa.array(np.append(0, np.cumsum(length)), pa.int32()), pa.array(values, pa.int64()))


def _prefixes(rows: DataFrame, size: int, percent: int, common: np.ndarray) -> DataFrame:
    """(key, set_id, n, sketch, prefix) per row of (key, text); a prefix is ascending in the global order."""
    held = rows.sparkSession.sparkContext.broadcast(common)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        often = held.value
        for batch in batches:
            for part, texts in text_groups(batch, 1):
                hashes, n = shingle_sets(texts, size)
                at = np.minimum(np.searchsorted(often, hashes), max(len(often) - 1, 0))
                late = often[at] == hashes if len(often) else np.zeros(len(hashes), bool)
                tokens = np.where(late, hashes, hashes | _LATE)  # negative numbers come first
                ends, length = np.cumsum(n), prefix_length(n, percent)
                tokens = tokens[np.lexsort((tokens, np.repeat(np.arange(len(n)), n)))]
                within = np.arange(len(tokens)) - np.repeat(ends - n, n) < np.repeat(length, n)
                columns = [
                    part.column(0), pa.array(set_ids(hashes, n)), pa.array(n), _lists(*sketches(hashes, n, percent)),
                    _lists(tokens[within], length),
                ]
                yield pa.RecordBatch.from_arrays(columns, ["key", "set_id", "n", "sketch", "prefix"])

    kind = rows.schema["key"].dataType.simpleString()
    return rows.mapInArrow(run, f"key {kind}, set_id long, n long, sketch array<bigint>, prefix array<bigint>")


# --- traversal --------------------------------------------------------------------------

def tree_pairs(
    tree: np.ndarray, paths: np.ndarray, n: np.ndarray, rest: np.ndarray, root: np.ndarray, percent: int,
    frontier: int = FRONTIER,
) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """(i, j) row numbers, i < j, of sets that may be similar, in trees that are sorted by path; all partners j of an i come at once.

    ``tree`` numbers the trees (ascending), ``paths`` has a row of ascending tokens per set, filled up with _END, ``n`` is the size of a
    set and ``rest`` how many of its n-grams follow the one the tree belongs to. Pairs of one ``root`` are left out.
    """
    rows, depth = paths.shape
    length = (paths != _END).sum(axis=1)
    fresh = np.ones(rows, bool)
    fresh[1:] = tree[1:] != tree[:-1]
    levels = []  # per level: first row of each node, and the least and greatest of what lies below
    for d in range(depth + 1):
        if d:
            fresh[1:] |= paths[1:, d - 1] != paths[:-1, d - 1]
        lo = np.flatnonzero(fresh)
        levels.append({
            "lo": lo, "hi": np.append(lo[1:], rows), "token": paths[lo, d - 1] if d else None,
            "n0": np.minimum.reduceat(n, lo), "n1": np.maximum.reduceat(n, lo), "rest": np.maximum.reduceat(rest, lo),
            "r0": np.minimum.reduceat(root, lo), "r1": np.maximum.reduceat(root, lo),
        })
    # children of a node are neighbours on the level below
    for above, below in zip(levels, levels[1:]):
        above["child"] = np.searchsorted(below["lo"], above["lo"])
        above["children"] = np.searchsorted(below["lo"], above["hi"]) - above["child"]

    top = levels[0]
    own = np.repeat(np.arange(len(top["lo"])), top["hi"] - top["lo"])
    load = np.cumsum((top["hi"] - top["lo"])[own])
    at = 0
    while at < rows:
        end = max(at + 1, int(np.searchsorted(load, (load[at - 1] if at else 0) + frontier, "right")))
        probe, node = np.arange(at, end), own[at:end]
        overlap, used = np.ones(len(probe), np.int64), np.zeros(len(probe), np.int64)
        at, found = end, []
        for d in range(depth + 1):
            level = levels[d]
            read = d - (level["token"][node] == _END) if d else 0  # an end is no n-gram
            bound = np.minimum(rest[probe] - used, np.where(used < length[probe], level["rest"][node] - read, rest[probe]))
            go = (100 + percent) * (overlap + bound) >= percent * (n[probe] + level["n0"][node])
            go &= (100 * level["n1"][node] >= percent * n[probe]) & (percent * level["n0"][node] <= 100 * n[probe])
            go &= level["hi"][node] > probe + 1
            go &= (level["r0"][node] != root[probe]) | (level["r1"][node] != root[probe])
            probe, node, overlap, used = probe[go], node[go], overlap[go], used[go]
            ended = (level["token"][node] == _END) if d else np.zeros(len(node), bool)
            if d == depth:
                ended = np.ones(len(node), bool)
            if ended.any():
                found.append(_leaves(probe[ended], overlap[ended], used[ended], level, node[ended], n, rest, root, percent))
                probe, node, overlap, used = probe[~ended], node[~ended], overlap[~ended], used[~ended]
            if not len(probe) or d == depth:
                break
            many = level["children"][node]
            probe, overlap, used = np.repeat(probe, many), np.repeat(overlap, many), np.repeat(used, many)
            node = np.repeat(level["child"][node] - (np.cumsum(many) - many), many) + np.arange(many.sum())
            token = levels[d + 1]["token"][node]
            ahead = np.minimum((paths[probe] < token[:, None]).sum(axis=1), length[probe])
            ahead = np.where(token == _END, used, ahead)
            met = (ahead < length[probe]) & (paths[probe, np.minimum(ahead, depth - 1)] == token)
            overlap, used = overlap + met, ahead + met
        if found:
            yield tuple(np.concatenate(e) for e in zip(*found))


def _leaves(probe, overlap, used, level, node, n, rest, root, percent) -> tuple[np.ndarray, np.ndarray]:
    """Pairs of sets and the rows of leaves that no bound rules out."""
    lo = np.maximum(level["lo"][node], probe + 1)
    many = np.maximum(level["hi"][node] - lo, 0)
    i = np.repeat(probe, many)
    j = np.repeat(lo - (np.cumsum(many) - many), many) + np.arange(many.sum())
    most = np.repeat(overlap, many) + rest[i] - np.repeat(used, many)
    may = (100 + percent) * most >= percent * (n[i] + n[j])
    may &= (percent * n[i] <= 100 * n[j]) & (percent * n[j] <= 100 * n[i]) & (root[i] != root[j])
    return i[may], j[may]


def closest(i: np.ndarray, differ: np.ndarray, most: int) -> np.ndarray:
    """Which pairs are among the ``most`` of their ``i`` that differ least."""
    order = np.lexsort((differ, i))
    ordered = i[order]
    kept = np.zeros(len(i), bool)
    kept[order] = np.arange(len(i)) - np.searchsorted(ordered, ordered) < most
    return kept


def _traversed(rows: DataFrame, percent: int, most: int) -> DataFrame:
    """Distinct pairs (a, b), a < b, of rows (token, block, path, sketch, set_id, root, n, rest) whose sketches
    allow the similarity: at most ``most`` of a set in a tree, the closest by sketches. Ends of the others come as (a, token, block)."""
    place = ["token", "block"]
    ordered = rows.repartition(*place).sortWithinPartitions(*place, "path", "set_id")
    columns = ordered.select(*place, "set_id", "root", "n", "rest", "sketch", "path")
    names = ["a", "b", *place]

    def pairs(rows: list[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        table = pa.Table.from_batches(rows).combine_chunks()
        token, block, ids, root, n, rest = (table.column(i).to_numpy() for i in range(6))
        sketch, listed = (table.column(c).combine_chunks() for c in (6, 7))
        words, (length, width) = sketch.flatten().to_numpy(), (
            pa.compute.list_value_length(c).to_numpy(zero_copy_only=False).astype(np.int64) for c in (sketch, listed)
        )
        paths = np.full((len(ids), max(1, int(width.max(initial=0)))), _END)
        paths[np.repeat(np.arange(len(ids)), width), np.arange(width.sum()) - np.repeat(np.cumsum(width) - width, width)] = (
            listed.flatten().to_numpy()
        )
        fresh = np.ones(len(ids), bool)
        fresh[1:] = (token[1:] != token[:-1]) | (block[1:] != block[:-1])
        over = np.zeros(len(ids), bool)
        for i, j in tree_pairs(np.cumsum(fresh), paths, n, rest, root, percent):
            differ = differing(words, length, i, j)
            may = (100 + percent) * differ <= (100 - percent) * (n[i] + n[j])
            i, j = i[may], j[may]
            kept = closest(i, differ[may], most)
            over[i[~kept]] = over[j[~kept]] = True
            i, j = i[kept], j[kept]
            if len(i):
                a, b = np.unique(np.sort(np.stack([ids[i], ids[j]]), axis=0), axis=1)
                none = pa.nulls(len(a), pa.int64())
                yield pa.RecordBatch.from_arrays([pa.array(a), pa.array(b), none, none], names)
        if over.any():
            yield pa.RecordBatch.from_arrays(
                [pa.array(ids[over]), pa.nulls(int(over.sum()), pa.int64()), pa.array(token[over]), pa.array(block[over])], names
            )

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[pa.RecordBatch] = []
        for batch in batches:
            if not batch.num_rows:
                continue
            token, block = batch.column(0).to_numpy(), batch.column(1).to_numpy()
            # the last tree may go on in the next batch
            cut = int(np.flatnonzero((token == token[-1]) & (block == block[-1]))[0])
            last = held[-1] if held else None
            over = held and (cut or (last.column(0)[-1].as_py(), last.column(1)[-1].as_py()) != (token[-1], block[-1]))
            if over or cut:
                yield from pairs([*held, batch.slice(0, cut)])
                held = []
            held.append(batch.slice(cut))
        if held:
            yield from pairs(held)
        free_unused()

    return columns.mapInArrow(run, "a long, b long, token long, block long").distinct()


# --- the join ---------------------------------------------------------------------------

def _with_neighbours(rows: DataFrame, group: list[str], percent: int) -> DataFrame:
    """``rows`` with the set before (of a group's sets by size) where sizes allow a link, and whether a set on either side does."""
    order = Window.partitionBy(*group).orderBy("n", "set_id")
    sized = rows.withColumn("_set", F.lag("set_id").over(order)).withColumn("_n", F.lag("n").over(order))
    sized = sized.withColumn("_next", F.lead("n").over(order))
    behind = F.coalesce(100 * F.col("_n") >= percent * F.col("n"), F.lit(False))
    ahead = F.coalesce(100 * F.col("n") >= percent * F.col("_next"), F.lit(False))
    near = F.when(behind & (F.col("_set") != F.col("set_id")), F.col("_set")).alias("neighbour")
    return sized.select(*rows.columns, near, F.col("_n").alias("neighbour_n"), (behind | ahead).alias("alive"))


def _met(rows: DataFrame) -> DataFrame:
    """(a, b, met, n), a < b: neighbours, how often they are, and the size of the smaller."""
    a, b = F.least("set_id", "neighbour").alias("a"), F.greatest("set_id", "neighbour").alias("b")
    ends = rows.where("neighbour IS NOT NULL").select(a, b, "neighbour_n")
    return ends.groupBy("a", "b").agg(F.count("*").alias("met"), F.min("neighbour_n").alias("n"))


def _possible(pairs: DataFrame, sets: DataFrame, percent: int) -> DataFrame:
    """The pairs whose sketches allow the similarity."""
    one, other = (sets.select(F.col("set_id").alias(e), F.col("n").alias(f"n{e}"), F.col("sketch").alias(f"s{e}")) for e in "ab")
    both = pairs.join(one, "a").join(other, "b")

    def halved(sketch: str, by: str) -> Column:
        """A sketch of twice the other's length as one of that length."""
        m = F.size(by)
        parts = F.zip_with(F.slice(sketch, F.lit(1), m), F.slice(sketch, m + 1, m), lambda x, y: x.bitwiseXOR(y))
        return F.when(F.size(sketch) == 2 * m, parts).otherwise(F.col(sketch))

    bits = F.zip_with(halved("sa", "sb"), halved("sb", "sa"), lambda x, y: F.bit_count(x.bitwiseXOR(y)))
    differ = F.aggregate(bits, F.lit(0), lambda total, x: total + x)  # null where lengths are further apart
    may = F.coalesce((100 + percent) * differ.cast("long") <= (100 - percent) * (F.col("na") + F.col("nb")), F.lit(True))
    return both.where(may).select("a", "b")


def _similar(pairs: DataFrame, shingles: DataFrame, percent: int) -> DataFrame:
    """The pairs whose whole sets (set_id, shingles) are similar."""
    one, other = (shingles.select(F.col("set_id").alias(e), F.col("shingles").alias(f"_{e}")) for e in "ab")
    both = pairs.join(one, "a").join(other, "b").withColumn("same", F.size(F.array_intersect("_a", "_b")).cast("long"))
    return both.where(100 * F.col("same") >= percent * (F.size("_a") + F.size("_b") - F.col("same"))).select("a", "b")


def _suspects(pairs: DataFrame, sets: DataFrame, rows: DataFrame, size: int) -> DataFrame:
    """(set_id, shingles) of the ends of ``pairs``: their texts are read again, one key of each set."""
    ends = pairs.select(F.explode(F.array("a", "b")).alias("set_id")).distinct()
    named = written(sets.join(ends, "set_id").select("set_id", F.col("least").alias("_key")), "suspects")
    texts = rows.join(named.select("_key").distinct(), F.col("key").eqNullSafe(F.col("_key")), "left_semi")
    found = _hashed(texts, size).join(named.select("set_id"), "set_id", "left_semi")
    return written(found.dropDuplicates(["set_id"]), "suspect-sets")


def _apart(rows: DataFrame, place: list[str]) -> DataFrame:
    """The rows (set_id, root, ...) of trees that hold sets of two roots or more."""
    trees = rows.groupBy(*place).agg(F.min("root").alias("_r0"), F.max("root").alias("_r1")).where("_r0 < _r1")
    return rows.join(trees.select(*place), place, "left_semi")


def classes(
    rows: DataFrame, size: int = SIZE, percent: int = PERCENT, seeds: DataFrame | None = None, tree_rows: int = TREE_ROWS,
    depth: int = DEPTH,
) -> DataFrame:
    """(key, set_id, n, component_id) per row of (key, text), as :func:`with_components` defines it.

    ``seeds`` (key, group) names groups of rows that are likely similar, such as those of another method: neighbours within them
    are verified first. They decide how much is left to search, never the result.
    """
    with small_batches(rows.sparkSession):
        return _classes(rows, size, percent, seeds, tree_rows, depth)


def _classes(rows: DataFrame, size: int, percent: int, seeds: DataFrame | None, tree_rows: int, depth: int) -> DataFrame:
    prints = written(_prefixes(rows, size, percent, _common(rows, size, percent)), "prefixes")
    sets = written(
        prints.groupBy("set_id").agg(F.min("key").alias("least"), *(F.first(c).alias(c) for c in ("n", "sketch", "prefix"))),
        "distinct-sets",
    )
    # n-grams that are in the prefix of one set alone go at once
    tokens = sets.select("set_id", "n", F.posexplode("prefix").alias("place", "token"))
    shared = tokens.groupBy("token").agg(F.count("*").alias("held")).where(F.col("held") > 1)
    # in a tree of one block, a set whose neighbours by size are too small and too large has no partner
    block = F.pmod("set_id", F.ceil(F.col("held") / tree_rows))
    near = _with_neighbours(tokens.join(shared, "token").withColumn("_block", block), ["token", "_block"], percent)
    met = written(near.where(F.col("alive") | (F.col("held") > tree_rows)).drop("alive", "_block"), "shared-tokens")
    # similar sets are neighbours in most trees of their prefixes; those that meet by a passage are left to the traversal
    first = _met(met).where(F.col("met") * OFTEN * 100 >= (100 - percent) * F.col("n")).select("a", "b")
    if seeds is not None:
        known = prints.where("n > 0").join(seeds, "key").select("group", "set_id", "n").distinct()
        total = known.groupBy("group").agg(F.count("*").alias("held")).where(F.col("held") > 1)
        known = known.join(total, "group").withColumn("_block", block)
        first = first.unionByName(_met(_with_neighbours(known, ["group", "_block"], percent)).select("a", "b")).distinct()
    first = _possible(first, sets, percent)
    first = written(first, "neighbours")
    links = written(_similar(first, _suspects(first, sets, rows, size), percent), "links")

    roots = connected(links)
    rooted = met.drop("neighbour", "neighbour_n").join(roots, F.col("set_id") == F.col("node"), "left").withColumn("root", F.coalesce("root", "set_id"))
    rooted = written(rooted.drop("node"), "rooted-tokens")
    own = F.pmod(F.xxhash64("set_id"), F.col("_blocks"))
    grid = F.transform(
        F.sequence(F.lit(0).cast("long"), F.col("_blocks") - 1), lambda o: F.least(own, o) * F.lit(1 << 20) + F.greatest(own, o)
    )
    many = F.when(F.col("held") > tree_rows, F.ceil(2 * F.col("held") / tree_rows)).otherwise(1).cast("long")
    paths = sets.select("set_id", "sketch", "prefix")
    searched = _apart(rooted, ["token"]).withColumn("_blocks", many).withColumn("block", F.explode(grid))
    known, most = first, PARTNERS
    while True:
        dealt = searched.join(paths, "set_id").select(
            "token", "block", "set_id", "root", "n", (F.col("n") - F.col("place") - 1).alias("rest"),
            "sketch", F.slice("prefix", F.col("place") + 2, F.lit(depth)).alias("path"),
        )
        found = written(_traversed(dealt, percent, most), "pairs")
        second = written(found.where("b IS NOT NULL").select("a", "b").join(known, ["a", "b"], "left_anti"), "new-pairs")
        links = written(links.unionByName(_similar(second, _suspects(second, sets, rows, size), percent)), "links")
        nodes = connected(links)
        over = found.where("b IS NULL").select(F.col("a").alias("set_id"), "token", "block")
        if over.isEmpty():
            break
        # sets with more partners, in trees that still hold two classes
        again = rooted.drop("root").join(over, ["token", "set_id"])
        again = again.join(nodes, F.col("set_id") == F.col("node"), "left").withColumn("root", F.coalesce("root", "set_id"))
        searched = written(_apart(again.drop("node"), ["token", "block"]), "searched-tokens")
        if searched.isEmpty():
            break
        known, most = known.unionByName(second), most * MORE

    named = sets.select("set_id", "least").join(nodes, F.col("set_id") == F.col("node"), "left")
    named = named.select("set_id", "least", F.coalesce("root", "set_id").alias("root"))
    least = named.groupBy("root").agg(F.min("least").alias("component_id"))
    found = named.join(least, "root").select("set_id", "component_id")
    return prints.select("key", "set_id", "n").join(found, "set_id", "left")


def with_components(
    docs: DataFrame, size: int = SIZE, percent: int = PERCENT, text: str = "text", key: str = "doc_id"
) -> DataFrame:
    """(key, n_shingles, component_id) per row: the size of its n-gram set, and the smallest key reachable over links.

    Two rows are linked if 100 * intersection >= percent * union of their distinct n-grams of words (white-space runs, A-Z
    lower-cased). A text of fewer words than ``size`` is one n-gram; a text that is null, empty or without words has none and is linked with
    nothing, so its component is its own key. Rows keep their number: repeated rows and null keys stay, each with its class; a
    class whose keys are all null has a null component_id. An empty table gives no rows. Only key and text are read.
    """
    rows = docs.select(F.col(key).alias("key"), F.col(text).alias("text"))
    found = classes(rows, size, percent)
    component = F.when(F.col("n") > 0, F.col("component_id")).otherwise(F.col("key"))
    return found.select(F.col("key").alias(key), F.col("n").alias("n_shingles"), component.alias("component_id"))
