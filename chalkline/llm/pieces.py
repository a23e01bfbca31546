"""Token ids and counts of texts, each distinct pre-token encoded once per worker.

With a byte-level tokenizer no piece crosses the space in front of a word: a text falls into its
first word and further words with their leading space, and its ids are the ids of these one after
another. Two cases are different and such texts are encoded as a whole: a space with white space
on both sides (it may join the run before it), and text that holds an added token's string.
"""

from __future__ import annotations

import os
import re
from functools import cache
from pathlib import Path

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

#: A space inside or at the end of a run of white space.
_INNER_SPACE = re.compile(r"\s (?:\s|\Z)")
#: Longer words are encoded, but not remembered.
_LONG = 200
#: Words that are encoded as one text: few enough for what the library holds of a text to stay in the processor's cache.
_JOINED = 200


def resolve(name: str) -> str:
    """The file of a tokenizer: a path, or the name of one of the public tokenizers."""
    if Path(name).is_absolute():
        return name
    import public_tokenizers

    return public_tokenizers.path(name)


class PieceTable:
    """Remembered pre-tokens with their ids; forgets all when ``bound`` is passed."""

    def __init__(self, name: str, bound: int = 1_000_000):
        from tokenizers import Tokenizer
        from tokenizers.pre_tokenizers import ByteLevel

        # a task has one core: threads of the library's own take those of other tasks, and wait for one another
        os.environ.setdefault("TOKENIZERS_PARALLELISM", "false")
        self.tokenizer = Tokenizer.from_file(resolve(name))
        self.bound = bound
        added = self.tokenizer.get_added_tokens_decoder()
        self.split = next(((i, t.content) for i, t in added.items() if t.special and not (t.lstrip or t.rstrip or t.single_word)), None)
        self.added = [t.content for t in added.values()]
        self.separable = (
            self.split is not None
            and self.tokenizer.normalizer is None
            and isinstance(self.tokenizer.pre_tokenizer, ByteLevel)
            and not self.tokenizer.pre_tokenizer.add_prefix_space
            and not any(" " in x for x in self.added)
        )
        #: Whether a piece begins with a space.
        vocabulary = self.tokenizer.get_vocab()
        self.spaced = np.zeros(max(vocabulary.values()) + 1, bool)
        self.spaced[[i for piece, i in vocabulary.items() if piece.startswith("\u0120")]] = True
        self.clear()

    def clear(self) -> None:
        self.code: dict[str, int] = {}
        self.start, self.size = np.zeros(1024, np.int64), np.zeros(1024, np.int64)
        self.flat, self.used = np.zeros(4096, np.int32), 0

    def whole(self, text: str) -> list[int]:
        return self.tokenizer.encode(text, add_special_tokens=False).ids

    def _learn(self, words: list[str]) -> None:
        """Encode words, thousands to a text: set apart by their spaces, or by an added token's string those with white space
        at an end, the first words of texts among them."""
        within = [w for w in words if w and w.strip() == w]
        if len(within) < len(words):
            apart = [*set(words).difference(within)]
            mark, between = self.split
            ids = self._joined(between, [w[:-1] if w[-1:] == " " else " " + w for w in apart], mark)
            self._remember(apart, ids[ids != mark], np.diff(np.flatnonzero(np.append(ids, mark) == mark), prepend=-1) - 1)
        if within:
            ids = self._joined(" ", within)
            starts = np.flatnonzero(self.spaced[ids])
            self._remember(within, ids, np.diff(starts, append=len(ids)))

    def _joined(self, between: str, words: list[str], mark: int | None = None) -> np.ndarray:
        """Ids of words with a string between them, in front of all if it is a space; ``mark`` comes between texts."""
        first = " " if mark is None else ""
        joined = [first + between.join(words[at : at + _JOINED]) for at in range(0, len(words), _JOINED)]
        found = self.tokenizer.encode_batch_fast(joined, add_special_tokens=False)
        ids = np.concatenate([np.array(x, np.int32) for e in found for x in (e.ids, [mark] if mark is not None else [])])
        return ids if mark is None else ids[:-1]

    def _remember(self, words: list[str], pieces: np.ndarray, sizes: np.ndarray) -> None:
        n = len(self.code)
        while n + len(words) > len(self.start):
            self.start, self.size = np.resize(self.start, 2 * len(self.start)), np.resize(self.size, 2 * len(self.size))
        while self.used + len(pieces) > len(self.flat):
            self.flat = np.resize(self.flat, 2 * len(self.flat))
        self.flat[self.used : self.used + len(pieces)] = pieces
        self.start[n : n + len(words)] = self.used + np.cumsum(sizes) - sizes
        self.size[n : n + len(words)] = sizes
        self.used += len(pieces)
        self.code.update(zip(words, range(n, n + len(words))))

    def codes(self, texts: list[str]) -> list[np.ndarray | list[int]]:
        """Per text the codes of its pre-tokens (an array), or its ids (a list) where it had to be
        encoded as a whole."""
        if len(self.code) > self.bound:
            self.clear()
        # words as the dictionary has them: without the space in front, the first one with a space behind
        plain, heads, tails = [], [], []
        for k, text in enumerate(texts):
            if not text or (self.separable and not (_INNER_SPACE.search(text) or any(a in text for a in self.added))):
                head, space, tail = text.partition(" ")
                plain.append(k)
                heads.append(head + " " if head else None)
                tails.append(tail if space else None)
        # words that occur many times in these texts are looked up once
        listed = pc.split_pattern(pa.array(tails, pa.large_string()), " ")
        in_tail = pc.fill_null(pc.list_value_length(listed), 0).to_numpy().astype(np.int64)
        coded = pc.list_flatten(listed).dictionary_encode()
        rest, words = coded.indices.to_numpy(), coded.dictionary.to_numpy(zero_copy_only=False).tolist()
        code_of = self._codes_of([*words, *(h for h in heads if h is not None)])
        flat, firsts = code_of[: len(words)][rest], iter(code_of[len(words) :].tolist())
        found: list[np.ndarray | None] = [None] * len(texts)
        for k, head, end, n in zip(plain, heads, np.cumsum(in_tail).tolist(), in_tail.tolist()):
            codes = flat[end - n : end]
            codes = codes if head is None else np.append(next(firsts), codes)
            if not (codes < 0).any():
                found[k] = codes
        return [self.whole(t) if c is None else c for t, c in zip(texts, found)]

    def _codes_of(self, words: list[str]) -> np.ndarray:
        """Codes of words, new ones learned; -1 of words that are too long to be remembered."""
        codes = [*map(self.code.get, words)]
        missing = [at for at, code in enumerate(codes) if code is None]
        if new := {words[at] for at in missing if len(words[at]) <= _LONG}:
            self._learn(list(new))
        for at in missing:
            codes[at] = self.code.get(words[at], -1)
        return np.array(codes, np.int64)

    def counts(self, texts: list[str]) -> list[int]:
        """Pieces per text, without their ids."""
        return [int(self.size[c].sum()) if isinstance(c, np.ndarray) else len(c) for c in self.codes(texts)]

    def ids(self, texts: list[str]) -> list[np.ndarray]:
        """Ids per text."""
        out = []
        for c in self.codes(texts):
            if isinstance(c, list):
                out.append(np.array(c, np.int32))
                continue
            size = self.size[c]
            before = np.cumsum(size) - size
            out.append(self.flat[np.repeat(self.start[c] - before, size) + np.arange(size.sum())])
        return out


@cache
def table(name: str) -> PieceTable:
    """The worker's table for a tokenizer; lives as long as the worker process."""
    return PieceTable(name)
