"""Periodic runs of the words of a text, by longest common extensions over a difference cover.

A run of period p and length at least 4 p holds a pair of positions (i, i + p) with i a multiple
of 3 p, so the pairs of that harmonic grid, n/3 + n/6 + n/9 + ... of them, meet every run. How far
a pair agrees to the right and to the left gives the whole run around it.

Agreements are looked up, not scanned. Only suffixes at positions that are in a difference cover
modulo 64 are sorted: any two positions have a common shift below 64 after which both are in the
cover. Up to that shift words are compared; from there on the agreement is the least common
prefix between the two sorted suffixes, by a sparse table of range minima.

Texts are handled in blocks, one after the other in one array with marks between them that equal
nothing else, so no run or agreement leaves its text.
"""

from __future__ import annotations

import re
from collections.abc import Sequence
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql.types import ArrayType, LongType, StructType

from runlens.llm.arrow import map_batches, texts_of
from runlens.llm.words import blocks

WORD = re.compile("[^\x20\x09-\x0d]+")
COVER_SIDE = 8
COVER = COVER_SIDE**2
#: Runs have at least this many words, and this many periods.
LEAST_WORDS, LEAST_PERIODS = 6, 4
#: Grid pairs looked at together.
PAIRS = 1_000_000
RUN = StructType().add("start", LongType()).add("length", LongType()).add("period", LongType())


@lru_cache(maxsize=1)
def _cover() -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """The cover's residues, the place of each residue among them (-1: not in it), and the least
    common shift into the cover for every pair of residues."""
    residues = np.array(sorted({*range(COVER_SIDE), *range(0, COVER, COVER_SIDE)}))
    place = np.full(COVER, -1)
    place[residues] = np.arange(len(residues))
    shift = np.full((COVER, COVER), -1)
    a, b = np.meshgrid(np.arange(COVER), np.arange(COVER), indexing="ij")
    for h in reversed(range(COVER)):
        shift[(place[(a + h) % COVER] >= 0) & (place[(b + h) % COVER] >= 0)] = h
    return residues, place, shift


def _refined(rank: np.ndarray, among: np.ndarray, by: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Ranks after ties ``among`` equal ranks are ordered by another key; who is still tied.

    A rank is the number of smaller elements, so those of one rank lie next to each other.
    """
    sorted_by = np.lexsort((by, rank[among]))
    order, key = among[sorted_by], by[sorted_by]
    old = rank[order]
    new_rank = np.concatenate([[True], old[1:] != old[:-1]])
    new_key = new_rank | np.concatenate([[True], key[1:] != key[:-1]])
    at = np.arange(len(order))
    first_rank = np.maximum.accumulate(np.where(new_rank, at, 0))
    first_key = np.maximum.accumulate(np.where(new_key, at, 0))
    rank = rank.copy()
    rank[order] = old + first_key - first_rank
    alone = new_key & np.concatenate([new_key[1:], [True]])
    return rank, order[~alone]


class Extensions:
    """Longest common extensions to the right of positions in an array of numbers from 1."""

    def __init__(self, ids: np.ndarray) -> None:
        self.n = len(ids)
        self.ids = np.concatenate([ids, np.zeros(2 * COVER, dtype=ids.dtype)])
        residues, self.place, self.shift = _cover()
        self.rows = self.n // COVER + 1
        # sample number: (place of the residue) * rows + position // COVER
        position = (residues[:, None] + COVER * np.arange(self.rows)[None, :]).ravel()
        inside = position < self.n
        position = np.minimum(position, self.n)
        size = len(position)
        rank, tied = np.zeros(size, dtype=np.int64), np.flatnonzero(inside)
        rank[tied] = size - len(tied)  # samples behind the end are all equal and come first
        for t in range(COVER):
            if not len(tied):
                break
            rank, tied = _refined(rank, tied, self.ids[position[tied] + t])
        levels, step = [rank], 1
        while len(tied) and step < self.rows:
            nxt = tied + step
            known = (nxt // self.rows == tied // self.rows)
            rank, tied = _refined(rank, tied, np.where(known, rank[np.where(known, nxt, 0)] + 1, 0))
            levels.append(rank)
            step *= 2
        self.order = np.argsort(rank, kind="stable")
        self.at = np.empty(size, dtype=np.int64)
        self.at[self.order] = np.arange(size)
        self.table = self._minima(self._neighbours(levels, position))

    def _neighbours(self, levels: list[np.ndarray], position: np.ndarray) -> np.ndarray:
        """Common prefixes of samples next to each other in order: blocks by level, then words."""
        a, b = self.order[:-1].copy(), self.order[1:].copy()
        end_a, end_b = (a // self.rows + 1) * self.rows, (b // self.rows + 1) * self.rows
        count = np.zeros(len(a), dtype=np.int64)
        for level in reversed(range(len(levels))):
            rank = levels[level]
            same = (a < end_a) & (b < end_b)
            same[same] = rank[a[same]] == rank[b[same]]
            same &= (position[np.minimum(a, len(position) - 1)] < self.n) & (a != b)
            jump = np.where(same, 1 << level, 0)
            a, b, count = a + jump, b + jump, count + jump * COVER
        alive = np.flatnonzero((a < end_a) & (b < end_b))
        i, j = position[a[alive]], position[b[alive]]
        count[alive] += self._compared(i, j, np.full(len(i), COVER))[0]
        return count

    def _minima(self, row: np.ndarray) -> list[np.ndarray]:
        table, width = [row], 1
        while 2 * width <= len(row):
            table.append(np.minimum(table[-1][:-width], table[-1][width:]))
            width *= 2
        return table

    def _compared(self, i: np.ndarray, j: np.ndarray, most: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Equal words from i and j on, up to ``most`` of them; which pairs came that far."""
        count, alive = np.zeros(len(i), dtype=np.int64), np.arange(len(i))
        t = 0
        while len(alive):
            alive = alive[most[alive] > t]
            a, b = i[alive] + t, j[alive] + t
            alive = alive[(self.ids[a] == self.ids[b]) & (a < self.n) & (b < self.n)]
            t += 1
            count[alive] = t
        return count, count == most

    def __call__(self, i: np.ndarray, j: np.ndarray) -> np.ndarray:
        """How many words agree from i and from j on; i and j differ and are at most the length."""
        most = self.shift[i % COVER, j % COVER]
        count, far = self._compared(i, j, most)
        far = np.flatnonzero(far & (i + most < self.n) & (j + most < self.n))
        if len(far):
            a, b = i[far] + most[far], j[far] + most[far]
            ranks = [self.at[self.place[x % COVER] * self.rows + x // COVER] for x in (a, b)]
            low, high = np.minimum(*ranks), np.maximum(*ranks)
            level = np.frexp((high - low).astype(np.float64))[1] - 1
            more = np.empty(len(far), dtype=np.int64)
            for k in np.unique(level):
                at = level == k
                more[at] = np.minimum(self.table[k][low[at]], self.table[k][high[at] - (1 << int(k))])
            count[far] += more
        return count


def _grid(ends: np.ndarray, periods: np.ndarray):
    """Pairs (i, p), i a multiple of 3 p and i + p below the end for p, in bounded parts."""
    stride = (LEAST_PERIODS - 1) * periods
    total = np.cumsum(np.maximum(0, -(-(ends - periods) // stride)))
    for first in range(0, int(total[-1]) if len(total) else 0, PAIRS):
        number = np.arange(first, min(first + PAIRS, int(total[-1])))
        which = np.searchsorted(total, number, side="right")
        within = number - np.where(which > 0, total[which - 1], 0)
        yield within * stride[which], periods[which]


def runs_of(texts: Sequence[np.ndarray]) -> np.ndarray:
    """Rows (text, start, length, period) of all runs, by text, start, period.

    A text is an array of numbers from 0, equal ones for equal words. A run is a stretch of
    smallest period q and at least max(6, 4 q) words that neither neighbouring word continues.
    """
    nothing = np.zeros((0, 4), dtype=np.int64)
    sizes = np.array([len(t) for t in texts], dtype=np.int64)
    order = np.argsort(-sizes, kind="stable")
    order = order[sizes[order] >= LEAST_WORDS]
    if not len(order):
        return nothing
    words = 1 + max(int(texts[k].max()) for k in order)
    parts = [p for n, k in enumerate(order) for p in (texts[k] + 1, [words + 1 + n])]
    ids = np.concatenate(parts).astype(np.int32)
    starts = np.concatenate([[0], np.cumsum(sizes[order] + 1)])
    periods = np.arange(1, sizes[order[0]] // LEAST_PERIODS + 1)
    # texts come by falling length: those long enough for a period are a prefix
    long_enough = np.searchsorted(-sizes[order], -np.maximum(LEAST_WORDS, LEAST_PERIODS * periods), side="right")
    right = left = None
    found = []
    for i, p in _grid(starts[long_enough], periods):
        same = ids[i] == ids[i + p]
        i, p = i[same], p[same]
        if not len(i):
            continue
        if right is None:
            right, left = Extensions(ids), Extensions(ids[::-1].copy())
        after = right(i, i + p)
        before = left(len(ids) - i, len(ids) - i - p)
        length = before + after + p
        keep = length >= np.maximum(LEAST_WORDS, LEAST_PERIODS * p)
        found.append(np.stack([i - before, length, p], axis=1)[keep])
    if not found:
        return nothing
    runs = np.unique(np.concatenate(found), axis=0)
    # the same stretch with a multiple of its period comes behind the smallest period
    runs = runs[np.concatenate([[True], (runs[1:, :2] != runs[:-1, :2]).any(axis=1)])] if len(runs) else runs
    own = np.searchsorted(starts, runs[:, 0], side="right") - 1
    rows = np.column_stack([order[own], runs[:, 0] - starts[own], runs[:, 1], runs[:, 2]])
    return rows[np.lexsort((rows[:, 3], rows[:, 1], rows[:, 0]))]


def _batch(texts: Sequence[str], collapse: bool) -> tuple[list[list[dict]], list[str]]:
    found: list[list[dict]] = []
    short: list[str] = []
    for first, last in blocks(texts):
        split = [WORD.findall(t) for t in texts[first:last]]
        memory: dict[str, int] = {}
        numbers = [np.array([memory.setdefault(w, len(memory)) for w in ws], dtype=np.int64) for ws in split]
        here: list[list[dict]] = [[] for _ in split]
        drop: dict[int, np.ndarray] = {}
        for k, start, length, period in runs_of(numbers).tolist():
            here[k].append({"start": start, "length": length, "period": period})
            if k not in drop:
                drop[k] = np.zeros(len(split[k]) + 1, dtype=np.int64)
            drop[k][start + period] += 1
            drop[k][start + length] -= 1
        found += here
        if collapse:
            for k, ws in enumerate(split):
                kept = ws if k not in drop else [w for w, d in zip(ws, np.cumsum(drop[k]).tolist()) if not d]
                short.append(" ".join(kept))
    return found, short


def find_runs(docs: DataFrame, text: str = "text", runs: str = "runs", collapsed: str | None = "collapsed") -> DataFrame:
    """The documents without their text, with their runs and with the text that is left without repeats.

    ``runs`` lists (start, length, period) in words by start, then period. ``collapsed`` (None: left
    out) joins with blanks the words that stay: of each run the first period, and all outside of
    runs. Words are maximal stretches without blanks and the control characters 9 to 13. Null,
    empty and blank texts have no runs and an empty ``collapsed``. Rows are independent of each
    other: repeated rows and ids and null ids get a result each. Columns of the input that have the
    names of the results give way to them; an empty table gives an empty one.
    """
    taken = {text, runs, *([collapsed] if collapsed else [])}
    kept = [f for f in docs.schema if f.name not in taken]

    def fn(batch: pa.RecordBatch) -> pa.RecordBatch:
        found, short = _batch(texts_of(batch, text), collapsed is not None)
        listed = pa.array(found, pa.list_(pa.struct([(n, pa.int64()) for n in ("start", "length", "period")])))
        columns = [batch.column(batch.schema.get_field_index(f.name)) for f in kept] + [listed]
        names = [f.name for f in kept] + [runs]
        if collapsed:
            columns, names = [*columns, pa.array(short, pa.string())], [*names, collapsed]
        return pa.RecordBatch.from_arrays(columns, names=names)

    out = StructType([*kept]).add(runs, ArrayType(RUN))
    if collapsed:
        out = out.add(collapsed, "string")
    return map_batches(docs.select(text, *[f"`{f.name}`" for f in kept]), fn, out)
