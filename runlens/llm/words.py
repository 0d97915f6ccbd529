"""Words of many texts at once, as numpy arrays over code points.

A word is a maximal run of characters other than blank, tab, line feed, vertical tab, form feed
and carriage return. Texts are handled in blocks of a bounded number of characters, so the
memory of a task follows the block and the longest single text, not the number of rows.
"""

from __future__ import annotations

from collections.abc import Iterator, Sequence

import numpy as np

BLOCK_CHARS = 1_000_000
POLY_A, POLY_B = 31, 0x9E3779B1
BIGRAM = 0x85EBCA6B
SPREAD = 2654435761


def blocks(texts: Sequence[str], chars: int = BLOCK_CHARS) -> Iterator[tuple[int, int]]:
    """Ranges of consecutive texts that hold about ``chars`` characters; at least one text each."""
    first, size = 0, 0
    for i, text in enumerate(texts):
        if i > first and size + len(text) > chars:
            yield first, i
            first, size = i, 0
        size += len(text)
    if first < len(texts):
        yield first, len(texts)


class Words:
    """Word boundaries of a block of texts.

    ``cps``: code points of all texts; ``text_start``: where each text begins, with the total at
    the end; ``start``, ``end``: character range of every word; ``doc``: its text; ``first``:
    index of each text's first word, with the total at the end.
    """

    def __init__(self, texts: Sequence[str]) -> None:
        self.n = len(texts)
        self.cps = np.frombuffer("".join(texts).encode("utf-32-le", "surrogatepass"), dtype=np.uint32)
        self.text_start = np.zeros(self.n + 1, dtype=np.int64)
        np.cumsum([len(t) for t in texts], out=self.text_start[1:])
        size = len(self.cps)
        self.inside = (self.cps != 32) & ((self.cps < 9) | (self.cps > 13))
        edge = np.zeros(size + 1, dtype=bool)
        edge[self.text_start] = True
        before = np.empty(size, dtype=bool)
        after = np.empty(size, dtype=bool)
        if size:
            before[0], before[1:] = False, self.inside[:-1]
            after[-1], after[:-1] = False, self.inside[1:]
        self.start = np.flatnonzero(self.inside & (~before | edge[:-1]))
        self.end = np.flatnonzero(self.inside & (~after | edge[1:])) + 1
        self.length = self.end - self.start
        self.first = np.searchsorted(self.start, self.text_start)
        self.count = np.diff(self.first)
        self.doc = np.repeat(np.arange(self.n), self.count)

    def per_text(self, per_word: np.ndarray) -> np.ndarray:
        """Sum over the words of each text."""
        total = np.concatenate([[0], np.cumsum(per_word)])
        return total[self.first[1:]] - total[self.first[:-1]]

    def chars_per_text(self, mask: np.ndarray) -> np.ndarray:
        """Number of marked characters of each text."""
        total = np.concatenate([[0], np.cumsum(mask)])
        return total[self.text_start[1:]] - total[self.text_start[:-1]]

    def hashes(self, multiplier: int = POLY_A, dtype=np.uint32, values: np.ndarray | None = None,
               keep: np.ndarray | None = None) -> np.ndarray:
        """Polynomial hash of every word, modulo the width of ``dtype``.

        ``values`` replaces the code points (for example lower-cased ones), ``keep`` leaves
        characters out; a word without kept characters hashes to 0.
        """
        if not len(self.start):
            return np.zeros(0, dtype=dtype)
        used = self.inside if keep is None else self.inside & keep
        counts = np.concatenate([[0], np.cumsum(used)])
        length = counts[self.end] - counts[self.start]
        chars = (self.cps if values is None else values)[used].astype(dtype)
        begin = np.concatenate([[0], np.cumsum(length)])
        powers = np.ones(int(length.max(initial=0)) + 1, dtype=dtype)
        with np.errstate(over="ignore"):
            powers[1:] = np.multiply.accumulate(np.full(len(powers) - 1, multiplier, dtype=dtype), dtype=dtype)
            to_end = np.repeat(begin[1:], length) - 1 - np.arange(len(chars))
            total = np.concatenate([np.zeros(1, dtype), np.cumsum(chars * powers[to_end], dtype=dtype)])
            return total[begin[1:]] - total[begin[:-1]]

    def windows(self, size: int) -> np.ndarray:
        """Index of the first word of every run of ``size`` words inside one text."""
        last = len(self.start) - size + 1
        if last <= 0:
            return np.zeros(0, dtype=np.int64)
        return np.flatnonzero(self.doc[:last] == self.doc[size - 1:])


def mixed(x: np.ndarray) -> np.ndarray:
    """A 64-bit finaliser: every output bit depends on every input bit."""
    with np.errstate(over="ignore"):
        x = x.astype(np.uint64)
        x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
        x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
        return x ^ (x >> np.uint64(31))


def word_keys(words: Words) -> np.ndarray:
    """A 64-bit key per word from two independent polynomial hashes."""
    with np.errstate(over="ignore"):
        return mixed(words.hashes(POLY_B, np.uint64)) ^ mixed(words.hashes(1_000_003, np.uint64) + np.uint64(77))


def repeated_words(words: Words, size: int = 3, keys: np.ndarray | None = None) -> np.ndarray:
    """Marks the words that lie in a window of ``size`` words found twice or more in their text."""
    at = words.windows(size)
    marked = np.zeros(len(words.start), dtype=bool)
    if not len(at):
        return marked
    keys = word_keys(words) if keys is None else keys
    with np.errstate(over="ignore"):
        window = mixed(words.doc[at].astype(np.uint64) + np.uint64(1))
        for k in range(size):
            window = mixed(window * np.uint64(3) + keys[at + k])
    order = np.argsort(window, kind="stable")
    ranked = window[order]
    same = ranked[1:] == ranked[:-1]
    twice = np.zeros(len(at), dtype=bool)
    twice[order[1:][same]] = True
    twice[order[:-1][same]] = True
    for k in range(size):
        marked[at[twice] + k] = True
    return marked
