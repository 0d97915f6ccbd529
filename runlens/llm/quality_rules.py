"""Quality rules: simple counts of a text, and a hashed n-gram log-likelihood ratio.

Words and word pairs are hashed to ``buckets`` cells. Over all documents the cells are counted
once for the whole corpus and once for the trusted documents; the two smoothed multinomials give
a weight log(target / raw) per cell, held as whole millionths. A document's score is the mean
weight of its n-grams. Only the cell counts, at most ``buckets`` rows each, reach the driver.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from runlens.llm.arrow import map_batches, texts_of
from runlens.llm.words import BIGRAM, SPREAD, Words, blocks, repeated_words

BUCKET_BITS = 16
SMOOTHING = 1.0
MICRO = 1_000_000
#: Mean weight, in millionths, from which a document is kept: below it a tenth of a nat per n-gram
#: speaks against the trusted multinomial.
THRESHOLD_MICRO = -100_000
MIN_WORDS = 50
#: The filter that trusted texts are found by has 2^FILTER_BITS bits, whatever the number of trusted ids.
FILTER_BITS = 24
SYMBOLS = "#*$%&|<>"
BASE = ["n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words"]
BLANKS = " \t\n\x0b\x0c\r"


def base_counts(words: Words, texts: list[str]) -> dict[str, np.ndarray]:
    """The plain counts of each text of a block."""
    symbols = np.isin(words.cps, np.array([ord(c) for c in SYMBOLS], dtype=np.uint32))
    repeats = []
    for text in texts:
        lines = [line for line in text.split("\n") if line.strip(BLANKS)] if "\n" in text else ()
        repeats.append(len(lines) - len(set(lines)))
    return {
        "n_words": words.count, "word_chars": words.per_text(words.length), "n_symbols": words.chars_per_text(symbols),
        "n_dup_lines": np.array(repeats, dtype=np.int64), "n_repeat_words": words.per_text(repeated_words(words)),
    }


def cells(words: Words, bits: int) -> tuple[np.ndarray, np.ndarray]:
    """(cell, text number) of every word and every pair of neighbouring words."""
    single = words.hashes()
    pair = words.windows(2)
    with np.errstate(over="ignore"):
        both = single[pair] * np.uint32(BIGRAM) + single[pair + 1]
        hashes = np.concatenate([single, both]) * np.uint32(SPREAD)
    return (hashes >> np.uint32(32 - bits)).astype(np.int64), np.concatenate([words.doc, words.doc[pair]])


def cell_counts(docs: DataFrame, name: str, bits: int = BUCKET_BITS) -> DataFrame:
    """(cell, ``name``): how often the n-grams of all texts fall into each cell."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        count = np.zeros(1 << bits, dtype=np.int64)
        for batch in batches:
            texts = texts_of(batch)
            for a, b in blocks(texts):
                count += np.bincount(cells(Words(texts[a:b]), bits)[0], minlength=1 << bits)
        at = np.flatnonzero(count)
        yield pa.RecordBatch.from_arrays([pa.array(at), pa.array(count[at])], ["cell", "n"])

    return docs.select("text").mapInArrow(run, "cell long, n long").groupBy("cell").agg(F.sum("n").alias(name))


def cell_weights(target_counts: DataFrame, raw_counts: DataFrame, bits: int = BUCKET_BITS,
                 smoothing: float = SMOOTHING) -> np.ndarray:
    """log(target / raw) of every cell in whole millionths; collects one row per cell and kind."""
    target, raw = np.zeros(1 << bits), np.zeros(1 << bits)
    for into, counts in ((target, target_counts), (raw, raw_counts)):
        for cell, n in counts.collect():
            into[cell] = n
    wide = smoothing * (1 << bits)
    ratio = np.log((target + smoothing) / (target.sum() + wide)) - np.log((raw + smoothing) / (raw.sum() + wide))
    return np.rint(ratio * MICRO).astype(np.int64)


def bloom_filter(ids: DataFrame, column: str, bits: int = FILTER_BITS) -> bytes:
    """A Bloom filter of 2^bits bits with two hashes, filled by Spark; its size does not depend on the ids.

    Collects at most one row per 64 bits. A filter that is too small for the ids lets more through.
    """
    cell = F.explode(F.array(*_probes(F.col(column), bits)))
    words = ids.select(cell.alias("cell")).groupBy(F.shiftright("cell", 6).alias("word")).agg(
        F.bit_or(F.call_function("shiftleft", F.lit(1).cast("long"), F.col("cell").bitwiseAND(F.lit(63)).cast("int"))).alias("set"))
    found = words.toArrow()
    table = np.zeros(1 << (bits - 6), dtype="<i8")
    table[found.column("word").to_numpy()] = found.column("set").to_numpy()
    return table.tobytes()


def _probes(value: Column, bits: int) -> list[Column]:
    return [F.pmod(F.xxhash64(value, F.lit(k)), F.lit(1 << bits)) for k in (1, 2)]


def may_contain(spark: SparkSession, value: Column, filter_: bytes) -> Column:
    """Whether the filter holds both bits of a value; only hashes of the value travel to Python."""
    shared = spark.sparkContext.broadcast(np.frombuffer(filter_, dtype=np.uint8))  # its size is a parameter

    @F.pandas_udf("boolean")
    def held(first: pd.Series, second: pd.Series) -> pd.Series:
        hit = np.ones(len(first), dtype=bool)
        for cell in (first.to_numpy(), second.to_numpy()):
            hit &= (shared.value[cell >> 3] >> (cell & 7).astype(np.uint8)) & 1 == 1
        return pd.Series(hit)

    return held(*_probes(value, (len(filter_) * 8).bit_length() - 1))


def judge(docs: DataFrame, weights: np.ndarray, threshold_micro: int = THRESHOLD_MICRO,
          bits: int = BUCKET_BITS) -> DataFrame:
    """doc_id, the base counts, base_failed, llr_micro (sum), n_grams and kept for every row."""
    shared = docs.sparkSession.sparkContext.broadcast(weights)  # one number per cell

    def run(batch: pa.RecordBatch) -> pa.RecordBatch:
        texts, out = texts_of(batch), []
        for a, b in blocks(texts):
            words = Words(texts[a:b])
            found = base_counts(words, texts[a:b])
            cell, doc = cells(words, bits)
            total = np.concatenate([[0], np.cumsum(shared.value[cell[np.argsort(doc, kind="stable")]])])
            grams = np.bincount(doc, minlength=words.n)
            upto = np.concatenate([[0], np.cumsum(grams)])
            found |= {"llr_micro": total[upto[1:]] - total[upto[:-1]], "n_grams": grams}
            out.append(found)
        names = [*BASE, "llr_micro", "n_grams"]
        merged = {n: np.concatenate([o[n] for o in out]).astype(np.int64) if out else np.zeros(0, np.int64) for n in names}
        return pa.RecordBatch.from_arrays([batch.column(0), *[pa.array(merged[n]) for n in names]], ["doc_id", *names])

    schema = "doc_id long, " + ", ".join(f"{n} long" for n in [*BASE, "llr_micro", "n_grams"])
    rows = map_batches(docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text")), run, schema)
    failed = (F.col("n_words") < MIN_WORDS) | (100 * F.col("n_repeat_words") > 50 * F.col("n_words"))
    passes = F.col("llr_micro") >= F.lit(threshold_micro).cast("long") * F.col("n_grams")
    return rows.withColumn("base_failed", failed).withColumn("kept", ~failed & passes)


def score(docs: DataFrame, trusted_ids: DataFrame, threshold_micro: int = THRESHOLD_MICRO,
          bits: int = BUCKET_BITS) -> DataFrame:
    """Rules for every row of ``docs``, with the documents named in ``trusted_ids`` as target.

    A document is kept if it does not fail the base rules and its mean weight is at least the
    threshold. A null or empty text has no words and fails. Rows without an id are never trusted;
    repeated rows are rows like any other, repeated ids in ``trusted_ids`` count once. Other
    columns are not read; an empty table gives no rows. Without any trusted document all weights
    measure the raw counts alone, so a target has to be given for the ratio to mean anything.
    """
    trusted = trusted_ids.select(F.col("doc_id").cast("long").alias("doc_id")).where("doc_id IS NOT NULL")
    texts = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text")
    # what the filter lets through is joined exactly, so a false positive costs a text's move and nothing else
    kept = texts.where(may_contain(docs.sparkSession, F.col("doc_id"), bloom_filter(trusted, "doc_id")))
    target = kept.join(trusted.hint("merge"), "doc_id", "left_semi")  # the same join at every size
    weights = cell_weights(cell_counts(target, "target", bits), cell_counts(docs, "raw", bits), bits)
    return judge(docs, weights, threshold_micro, bits)
