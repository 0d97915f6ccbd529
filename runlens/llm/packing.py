"""Packing documents into fixed windows by non-negative least squares over length combinations.

Documents are cut into full windows and one rest. Lengths are rounded up to ``grain`` tokens, which
leaves a histogram of few classes whatever the corpus. Every combination of at most three classes
that fills the window exactly is a column; non-negative least squares finds how often to use each
so that the histogram is used up. The counts are rounded, what they do not cover is packed greedily
from the largest class down. Only the histogram reaches the driver; documents find their sequence
by their rank inside their class.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from runlens.functions.scale import bucketed_rank
from runlens.llm import tokens
from runlens.llm.arrow import map_batches, stored, texts_of
from runlens.llm.words import blocks

WINDOW = 2048
GRAIN = 8
DEPTH = 3
RANK_BUCKETS = 1024
PIECE = "doc_id long, start long, length long, ids_crc32 long, doc_tokens long"


# ---------------------------------------------------------------- the plan, from the histogram


def combinations(total: int, depth: int = DEPTH) -> list[tuple[int, ...]]:
    """All descending tuples of at most ``depth`` positive classes that sum to ``total``."""

    def fill(left: int, most: int, slots: int) -> Iterator[tuple[int, ...]]:
        if left == 0:
            yield ()
        elif slots:
            for c in range(min(left, most), 0, -1):
                if c * slots >= left:
                    for rest in fill(left - c, c, slots - 1):
                        yield (c, *rest)

    return list(fill(total, total, depth))


def nnls(a: np.ndarray, b: np.ndarray, tolerance: float = 1e-9) -> np.ndarray:
    """min |a x - b| over x >= 0 by active sets: columns enter by gradient, leave at the bound."""
    x, active = np.zeros(a.shape[1]), np.zeros(a.shape[1], dtype=bool)
    scale = max(float(np.abs(b).max(initial=0)), 1.0)
    for _ in range(3 * a.shape[1]):
        gradient = np.where(active, -np.inf, a.T @ (b - a @ x))
        enter = int(np.argmax(gradient))
        if gradient[enter] <= tolerance * scale:
            break
        active[enter] = True
        while True:
            chosen = np.flatnonzero(active)
            part = a[:, chosen]
            best = np.linalg.solve(part.T @ part + 1e-10 * np.eye(len(chosen)), part.T @ b)
            if len(best) == 0 or best.min() > tolerance * scale * 1e-3:
                x[:] = 0
                x[chosen] = best
                break
            low = best <= tolerance * scale * 1e-3
            now = x[chosen]
            step = np.min(now[low] / np.maximum(now[low] - best[low], 1e-300))
            moved = now + step * (best - now)
            moved[low & (moved <= tolerance * scale)] = 0
            x[chosen] = np.maximum(moved, 0)
            drop = chosen[low & (x[chosen] <= tolerance * scale * 1e-3)]
            if not len(drop):
                drop = chosen[[int(np.argmin(best))]]
            x[drop], active[drop] = 0, False
            if enter in drop and len(drop) == 1:
                return x
    return x


def plan(histogram: dict[int, int], total: int, depth: int = DEPTH) -> list[tuple[dict[int, int], int]]:
    """(pieces per class, number of sequences) patterns that use up the histogram exactly."""
    left = np.zeros(total + 1, dtype=np.int64)
    for c, n in histogram.items():
        left[c] = n
    columns = combinations(total, depth)
    a = np.zeros((total, len(columns)))
    for j, combination in enumerate(columns):
        for c in combination:
            a[c - 1, j] += 1
    patterns = []
    repeats = np.floor(nnls(a, left[1:].astype(float)) + 0.5).astype(np.int64)
    for j in np.argsort(-repeats, kind="stable"):
        if repeats[j] <= 0:
            break
        used = {c: int(a[c - 1, j]) for c in set(columns[j])}
        count = min(int(repeats[j]), *(int(left[c]) // k for c, k in used.items()))
        if count > 0:
            patterns.append((used, count))
            for c, k in used.items():
                left[c] -= count * k
    while left.any():
        space, used = total, {}
        for c in np.flatnonzero(left)[::-1].tolist():
            k = min(int(left[c]), space // c)
            if k:
                used[c] = k
                space -= k * c
        count = min(int(left[c]) // k for c, k in used.items())
        patterns.append((used, count))
        for c, k in used.items():
            left[c] -= count * k
    return patterns


def slots(patterns: list[tuple[dict[int, int], int]]) -> list[tuple[int, int, int, int, int, int]]:
    """(class, first rank, end rank, pieces per sequence, first sequence, first slot) intervals.

    The pieces of a class are numbered from 0; every pattern takes the next ranks of its classes.
    """
    out, taken, sequence = [], {}, 0
    for used, count in patterns:
        slot = 0
        for c, k in sorted(used.items(), reverse=True):
            first = taken.get(c, 0)
            taken[c] = first + k * count
            out.append((c, first, taken[c], k, sequence, slot))
            slot += k
        sequence += count
    return out


# ---------------------------------------------------------------- documents


def pieces(docs: DataFrame, vocabulary: str, end_id: int, window: int = WINDOW) -> DataFrame:
    """Full windows and the rest of every document: doc_id, start, length, ids_crc32, doc_tokens."""

    def run(batch: pa.RecordBatch) -> pa.RecordBatch:
        encode, texts, keys = tokens.byte_level(vocabulary), texts_of(batch), batch.column(0).to_pylist()
        rows = []
        end = np.array([end_id], dtype="<u4")
        for a, b in blocks(texts):
            for key, ids in zip(keys[a:b], encode(texts[a:b])):
                ids = np.concatenate([ids, end])
                for at in range(0, len(ids), window):
                    part = ids[at:at + window]
                    rows.append((key, at, len(part), zlib.crc32(part.tobytes()), len(ids)))
        columns = list(zip(*rows)) or [[]] * 5
        return pa.RecordBatch.from_arrays([pa.array(c, pa.int64()) for c in columns],
                                          ["doc_id", "start", "length", "ids_crc32", "doc_tokens"])

    return map_batches(docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text")), run, PIECE)


def place(cut: DataFrame, window: int = WINDOW, grain: int = GRAIN) -> DataFrame:
    """Adds sequence_id and offset to pieces of at most ``window`` tokens."""
    spark: SparkSession = cut.sparkSession
    if window % grain:
        raise ValueError("grain must divide the window")
    classed = cut.withColumn("cls", F.expr(f"CAST((length + {grain - 1}) DIV {grain} AS INT)"))
    histogram = {r["cls"]: r["count"] for r in classed.groupBy("cls").count().collect()}  # window / grain rows
    table = spark.createDataFrame(
        slots(plan(histogram, window // grain)),
        "cls int, low long, high long, per long, first_sequence long, first_slot long")
    order = F.xxhash64("doc_id", "start", "ids_crc32")
    ranked = bucketed_rank(classed.withColumn("h", order), ["cls"], F.pmod("h", F.lit(RANK_BUCKETS)),
                           [F.col(c) for c in ("h", "doc_id", "start", "ids_crc32", "doc_tokens")], "rn")
    rank = F.col("rn") - 1
    seated = ranked.join(F.broadcast(table.withColumnRenamed("cls", "c")),
                         (F.col("cls") == F.col("c")) & (rank >= F.col("low")) & (rank < F.col("high")))
    since = rank - F.col("low")
    seated = seated.withColumn("sequence_id", F.col("first_sequence") + (since - F.pmod(since, "per")) / F.col("per"))
    seated = seated.withColumn("sequence_id", F.col("sequence_id").cast("long")).withColumn(
        "slot", F.col("first_slot") + F.pmod(since, "per"))
    before = Window.partitionBy("sequence_id").orderBy("slot").rowsBetween(Window.unboundedPreceding, -1)
    return seated.withColumn("offset", F.coalesce(F.sum("length").over(before), F.lit(0).cast("long"))).select(
        *cut.columns, "sequence_id", "offset")


def pack(docs: DataFrame, vocabulary: str, end_id: int = 1, window: int = WINDOW, grain: int = GRAIN) -> DataFrame:
    """One row per piece: doc_id, start, length, ids_crc32, doc_tokens, sequence_id, offset.

    Every id of every row, its end id included, lies in exactly one piece. A null or empty text
    has the end id alone. Rows without an id and repeated rows are documents like any other. Other
    columns are not read; an empty table gives no rows. The slot table that is broadcast has a row
    for each class of each pattern, a number that depends on window and grain only.
    """
    return place(stored(pieces(docs, vocabulary, end_id, window), "pieces"), window, grain)
