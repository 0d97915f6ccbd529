"""Passage features for the trained models: shape counts and hashed words.

A text is cut into passages of ``PASSAGE`` words; a text without words is one empty passage.
Features look at the text alone.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from runlens.llm.arrow import map_batches, stored, texts_of
from runlens.llm.words import Words, blocks, repeated_words, word_keys

PASSAGE = 64
HASHED = 32
CELLS = 4096
SHAPES = 16
WIDTH = SHAPES + HASHED
SAMPLE_PARTS = 64


def _letters() -> tuple[np.ndarray, np.ndarray]:
    """Upper-case and alphanumeric marks of the basic plane; beyond it all counts as alphanumeric."""
    chars = [chr(c) for c in range(0x10000)]
    return (np.array([c.isupper() for c in chars] + [False]), np.array([c.isalnum() for c in chars] + [True]))


_UPPER, _ALNUM = _letters()
_SIGNS = np.random.default_rng(7).standard_normal((CELLS, HASHED)).astype(np.float32)


class Passages:
    """``x``: a row of features per passage; ``doc``: its text; ``first``: each text's first passage."""

    def __init__(self, texts: list[str]) -> None:
        words = Words(texts)
        per = np.maximum(1, -(-words.count // PASSAGE))
        self.first = np.concatenate([[0], np.cumsum(per)])
        self.doc = np.repeat(np.arange(words.n), per)
        number = np.arange(len(self.doc)) - self.first[self.doc]
        begin = np.minimum(words.first[self.doc] + number * PASSAGE, words.first[self.doc + 1])
        stop = np.minimum(begin + PASSAGE, words.first[self.doc + 1])
        size = stop - begin

        def over_words(values: np.ndarray) -> np.ndarray:
            total = np.concatenate([np.zeros((1, *values.shape[1:]), values.dtype), np.cumsum(values, axis=0)])
            return total[stop] - total[begin]

        def by_word(mask: np.ndarray) -> np.ndarray:
            total = np.concatenate([[0], np.cumsum(mask)])
            return total[words.end] - total[words.start]

        cps = np.minimum(words.cps, 0x10000)
        keys = word_keys(words)
        low, upper, alnum = words.cps, by_word(_UPPER[cps]), by_word(_ALNUM[cps])
        digits = by_word((low >= 48) & (low <= 57))
        symbols = by_word(np.isin(low, np.array([ord(c) for c in "#*$%&|<>"], dtype=np.uint32)))
        shouts = by_word((low == 33) | (low == 63))
        again = np.zeros(len(keys), dtype=bool)
        again[1:] = (keys[1:] == keys[:-1]) & (words.doc[1:] == words.doc[:-1])
        home = np.repeat(np.arange(len(self.doc)), size)
        order = np.lexsort((keys, home))
        same = (keys[order][1:] == keys[order][:-1]) & (home[order][1:] == home[order][:-1])
        seen = np.zeros(len(keys), dtype=bool)
        seen[order[1:][same]] = True
        lines = np.concatenate([[0], np.cumsum(low == 10)])
        n, chars = np.maximum(size, 1), np.maximum(over_words(words.length), 1)
        edge = np.append(words.start, len(low))
        broken = lines[edge[stop]] - lines[edge[begin]]
        shapes = [
            size / PASSAGE, chars / n / 10, over_words(upper) / chars, over_words(digits) / chars,
            over_words(symbols) / chars, over_words(shouts) / chars,
            over_words(words.length - alnum - symbols - shouts) / chars, over_words(upper * 2 > words.length) / n,
            over_words(again) / n, over_words(repeated_words(words, 3, keys)) / n, over_words(seen) / n,
            over_words(words.length == 1) / n, over_words(by_word(low > 127)) / chars, np.minimum(broken / n, 1),
            over_words(words.length > 25) / n, np.log1p(words.count[self.doc]) / 10,
        ]
        cell = (keys >> np.uint64(20)).astype(np.int64) % CELLS
        hashed = np.zeros((len(self.doc), HASHED), dtype=np.float32)
        filled = np.flatnonzero(size)
        if len(filled):
            hashed[filled] = np.add.reduceat(_SIGNS[cell], begin[filled], axis=0)
        self.x = np.column_stack([*shapes, hashed / np.sqrt(n)[:, None]]).astype(np.float32)


def labelled_sample(labels: DataFrame, column: str, limit: int) -> DataFrame:
    """(doc_id, label) of at most ``limit`` labelled ids, by hash of the id; an id labelled twice
    has its larger label, null ids and labels are left out."""
    one = (labels.select(F.col("doc_id").cast("long").alias("doc_id"), F.col(column).cast("int").alias("label"))
           .dropna().groupBy("doc_id").agg(F.max("label").alias("label")))
    return one.orderBy(F.xxhash64("doc_id", F.lit(11)), "doc_id").limit(limit)


def stored_sample(docs: DataFrame, ids: DataFrame, purpose: str) -> DataFrame:
    """(doc_id, label, text, n_words) of the documents named by ``ids`` (doc_id, label), written once.

    ``ids`` is a sample of a bounded number of rows. The texts are read from all documents a
    single time; whatever is fitted reads them from the shared folder.
    """
    picked = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text").join(F.broadcast(ids), "doc_id")

    def count(batch: pa.RecordBatch) -> pa.RecordBatch:
        texts, n = texts_of(batch), []
        for a, b in blocks(texts):
            n += Words(texts[a:b]).count.tolist()
        return pa.RecordBatch.from_arrays([*batch.columns, pa.array(n, pa.int64())], [*batch.schema.names, "n_words"])

    schema = "doc_id long, label int, text string, n_words long"
    kept = stored(map_batches(picked.select("doc_id", "label", "text"), count, schema), purpose)
    return kept.repartition(SAMPLE_PARTS, "doc_id")  # small files would be read by one or two tasks


def within_budget(sample: DataFrame, words: int, salt: int, by_label: bool = False) -> DataFrame:
    """The documents of a stored sample that models are fitted on, always whole ones.

    Those, in the order of a hash of the id, that still fit ``words`` words together (``by_label``:
    words of each label); a document that is longer than what is left is passed over.
    """
    sizes = sample.groupBy("doc_id", "label").agg(F.sum("n_words").alias("n")).orderBy(F.xxhash64("doc_id", F.lit(salt)), "doc_id").collect()
    left: dict[int | None, int] = {}
    chosen = []
    for r in sizes:  # at most as many as the sample has documents
        kind = r["label"] if by_label else None
        if r["n"] <= left.setdefault(kind, words):
            left[kind] -= r["n"]
            chosen.append((r["doc_id"],))
    ids = sample.sparkSession.createDataFrame(chosen, "doc_id long")
    return sample.join(F.broadcast(ids), "doc_id", "left_semi").select("doc_id", "label", "text")
