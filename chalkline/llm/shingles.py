"""Hashes of the word shingles of texts, computed on whole byte buffers.

Words are the runs between ASCII white space, with A-Z lower-cased. Word hashes come from sums over the bytes of many
texts at once, shingle hashes from those of their words; a text is read in pieces, so a very long one costs
8 bytes per word and no more. Hashes have 63 bits: two different shingles are taken for one with a chance of 1e-19.
"""

from __future__ import annotations

import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa

from chalkline.llm.batches import free_unused

#: Bytes of text that are hashed at a time.
PIECE = 1 << 18
_SPACE_BYTE = re.compile(rb"[\x20\x09-\x0D]")
_SPACE = np.zeros(256, bool)
_SPACE[[0x20, 0x09, 0x0A, 0x0B, 0x0C, 0x0D]] = True
_LOWER = np.arange(256, dtype=np.uint8)
_LOWER[ord("A") : ord("Z") + 1] += 32
_BASE = 0x9E3779B97F4A7C15
_powers = [np.zeros(0, np.uint64)] * 2


def mix(x: np.ndarray) -> np.ndarray:
    """A bijection of 64 bits that spreads every bit."""
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


def _power_tables(n: int) -> list[np.ndarray]:
    """Powers of the base and of its inverse modulo 2**64."""
    if len(_powers[0]) < n:
        size = max(n, PIECE + 1024)
        for i, base in enumerate((_BASE, pow(_BASE, -1, 1 << 64))):
            factors = np.full(size, base, np.uint64)
            factors[0] = 1
            _powers[i] = np.cumprod(factors)
    return _powers


def _words_of(data: bytes) -> tuple[np.ndarray, np.ndarray]:
    """(hash, start) of every word of a piece."""
    read = np.frombuffer(data, np.uint8)
    inside = np.zeros(len(read) + 2, np.int8)
    inside[1:-1] = ~_SPACE[read]
    edge = np.diff(inside)
    starts, ends = np.flatnonzero(edge == 1), np.flatnonzero(edge == -1)
    up, down = _power_tables(len(read))
    sums = np.zeros(len(read) + 1, np.uint64)
    np.cumsum((_LOWER[read].astype(np.uint64) + np.uint64(1)) * up[: len(read)], out=sums[1:])
    return mix((sums[ends] - sums[starts]) * down[starts] + (ends - starts).astype(np.uint64)), starts


def _pieces(text: bytes) -> Iterator[bytes]:
    """The text cut at white space, in pieces of about PIECE bytes (longer only for a longer word)."""
    at = 0
    while len(text) - at > PIECE:
        gap = _SPACE_BYTE.search(text, at + PIECE)
        if gap is None:
            break
        yield text[at : gap.start()]
        at = gap.start()
    yield text[at:]


def word_hashes(texts: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
    """The hashes of all words of ``texts``, and the number of words of each text."""
    if len(texts) == 1:
        parts = [_words_of(p)[0] for p in _pieces(texts[0])]
        return np.concatenate(parts), np.array([sum(map(len, parts))], np.int64)
    hashes, starts = _words_of(b"\n".join(texts))
    ends = np.cumsum(np.array([len(t) + 1 for t in texts], np.int64))
    return hashes, np.diff(np.searchsorted(starts, ends), prepend=0)


def shingle_sets(texts: list[bytes], size: int) -> tuple[np.ndarray, np.ndarray]:
    """The distinct shingle hashes of texts, sorted within each, as one array and their number per text.

    A text of fewer words than a shingle is one shingle, a text without words none.
    """
    words, counts = word_hashes(texts)
    first = np.cumsum(counts) - counts
    doc = np.repeat(np.arange(len(texts)), counts)
    place = np.arange(len(words)) - first[doc]
    start = np.flatnonzero((place + size <= counts[doc]) | (place == 0))
    doc = doc[start]
    used = np.minimum(counts[doc], size)
    hashes = used.astype(np.uint64)
    for j in range(size):
        on = j < used
        step = mix(hashes + words[np.where(on, start + j, start)] * np.uint64(0xD6E8FEB86659FD93))
        hashes = np.where(on, step, hashes)
    hashes >>= np.uint64(1)
    order = np.lexsort((hashes, doc))
    hashes, doc = hashes[order].view(np.int64), doc[order]
    fresh = np.ones(len(doc), bool)
    fresh[1:] = (hashes[1:] != hashes[:-1]) | (doc[1:] != doc[:-1])
    return hashes[fresh], np.bincount(doc[fresh], minlength=len(texts)).astype(np.int64)


def set_ids(hashes: np.ndarray, counts: np.ndarray) -> np.ndarray:
    """One number per set; equal sets have equal numbers."""
    sums = np.zeros(len(hashes) + 1, np.uint64)
    np.cumsum(mix(hashes.view(np.uint64) + np.uint64(0x632BE59BD9B4E019)), out=sums[1:])
    ends = np.cumsum(counts)
    return mix(sums[ends] - sums[ends - counts] + counts.astype(np.uint64)).view(np.int64)


def text_groups(batch: pa.RecordBatch, column: int) -> Iterator[tuple[pa.RecordBatch, list[bytes]]]:
    """Slices of a batch with their texts (null: empty), each of about PIECE bytes or of one long text."""
    texts = batch.column(column).cast(pa.large_binary())
    sizes = np.cumsum(np.nan_to_num(pa.compute.binary_length(texts).to_numpy(zero_copy_only=False).astype(float)))
    at = 0
    while at < batch.num_rows:
        before = sizes[at - 1] if at else 0.0
        end = max(at + 1, int(np.searchsorted(sizes, before + PIECE, "right")))
        yield batch.slice(at, end - at), [t or b"" for t in texts.slice(at, end - at).to_pylist()]
        at = end
    free_unused()
