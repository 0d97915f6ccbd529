"""Near-duplicate groups by SimHash fingerprints and multi-index hashing.

A fingerprint has 64 bits. Two fingerprints that differ in at most 3 bits differ in at most one
bit in their lower or in their upper 32 bits. So every fingerprint is stored under both halves,
and looked up under the 33 values of the radius-1 ball around each of its halves; the distance of
what is found is then computed in full. No bucket is capped: where a half is shared by more than
``crowded`` different fingerprints, the same method is applied once more to the 16-bit halves of
the other 32 bits, which bounds what one lookup finds by the 2^16 values that are left.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from runlens.llm.arrow import map_batches, stored, texts_of

SEED = 42
WIDTH = 3
DISTANCE = 3
CROWDED = 256


def fingerprint(text: str, width: int = WIDTH) -> int:
    """Unsigned 64-bit SimHash of a text's word shingles; 0 for a text without words."""
    words = text.encode("utf-8", "surrogatepass").lower().split()
    if not words:
        return 0
    digest = xxhash.xxh64_intdigest
    if len(words) <= width:
        hashes = [digest(b" ".join(words), SEED)]
    else:
        hashes = [digest(b" ".join(s), SEED) for s in zip(*[words[k:] for k in range(width)])]
    ones = np.zeros(64, dtype=np.int64)
    values = np.array(hashes, dtype="<u8").view(np.uint8).reshape(-1, 8)
    for at in range(0, len(values), 65_536):
        ones += np.unpackbits(values[at:at + 65_536], axis=1, bitorder="little").sum(axis=0, dtype=np.int64)
    return int(np.packbits(2 * ones > len(hashes), bitorder="little").view("<u8")[0])


def fingerprints(docs: DataFrame, key: str = "doc_id", text: str = "text", width: int = WIDTH) -> DataFrame:
    """(doc_id, fp) for every row; ``fp`` is the fingerprint as a signed long."""

    def run(batch: pa.RecordBatch) -> pa.RecordBatch:
        fps = np.array([fingerprint(t, width) for t in texts_of(batch)], dtype=np.uint64).view(np.int64)
        return pa.RecordBatch.from_arrays([batch.column(0), pa.array(fps, pa.int64())], ["doc_id", "fp"])

    return map_batches(docs.select(F.col(key).cast("long").alias("doc_id"), F.col(text).alias("text")), run, "doc_id long, fp long")


def _halves(value: Column, bits: int) -> tuple[Column, Column]:
    """Lower and upper part of a number of 2 * ``bits`` bits, the upper one marked by one more bit."""
    mask = F.lit((1 << bits) - 1)
    low = value.bitwiseAND(mask)
    high = F.shiftrightunsigned(value, bits).bitwiseAND(mask)
    return low, high.bitwiseOR(F.lit(1 << (bits + 1)))


def _stored_keys(value: Column, bits: int) -> Column:
    return F.array(*_halves(value, bits))


def _ball_keys(value: Column, bits: int) -> Column:
    """Every key at distance 0 or 1 from either half."""
    flips = [0] + [1 << b for b in range(bits)]
    return F.array(*[half.bitwiseXOR(F.lit(f)) for half in _halves(value, bits) for f in flips])


def links(fps: DataFrame, crowded: int = CROWDED, distance: int = DISTANCE) -> DataFrame:
    """Pairs (a, b), a < b, of distinct fingerprints that differ in at most ``distance`` (<= 3) bits."""
    if not 0 <= distance <= 3:
        raise ValueError("radius-1 balls in two segments cover at most 3 differing bits")
    one = fps.select("fp").distinct()
    entries = one.select("fp", F.explode(_stored_keys(F.col("fp"), 32)).alias("key"))
    probes = one.select(F.col("fp").alias("a"), F.explode(_ball_keys(F.col("fp"), 32)).alias("key"))
    sizes = entries.groupBy("key").agg(F.count(F.lit(1)).alias("n")).where(F.col("n") > crowded).select("key")
    near = (F.col("a") < F.col("b")) & (F.bit_count(F.col("a").bitwiseXOR(F.col("b"))) <= distance)
    calm = entries.join(sizes, "key", "left_anti").withColumnRenamed("fp", "b")
    found = probes.join(calm, "key").where(near).select("a", "b")

    def other(value: Column) -> Column:
        """The 32 bits that the key does not fix."""
        high = F.col("key").bitwiseAND(F.lit(1 << 33)) != 0
        mask = F.lit((1 << 32) - 1)
        return F.when(high, value.bitwiseAND(mask)).otherwise(F.shiftrightunsigned(value, 32).bitwiseAND(mask))

    busy_entries = entries.join(sizes, "key", "left_semi").withColumnRenamed("fp", "b")
    busy_probes = probes.join(sizes, "key", "left_semi")
    finer = busy_entries.select("key", "b", F.explode(_stored_keys(other(F.col("b")), 16)).alias("fine")).join(
        busy_probes.select("key", "a", F.explode(_ball_keys(other(F.col("a")), 16)).alias("fine")), ["key", "fine"])
    return found.unionByName(finer.where(near).select("a", "b")).distinct()


def components(edges: DataFrame) -> DataFrame:
    """(node, root): for every node of an edge its component's smallest node.

    Alternates the large-star and small-star steps until the edges no longer change. Each step is
    one aggregation and one join over edges; each round is written to the shared folder.
    """
    edges = stored(edges.select(F.col("a").alias("u"), F.col("b").alias("v")), "links")
    state = _state(edges)
    while True:
        both = edges.unionByName(edges.select(F.col("v").alias("u"), F.col("u").alias("v")))
        least = both.groupBy("u").agg(F.least(F.min("v"), F.col("u")).alias("m"))
        large = both.join(least, "u").where(F.col("v") > F.col("u")).select(
            F.col("v").alias("u"), F.col("m").alias("v")).where(F.col("u") != F.col("v")).distinct()
        down = large.select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v"))
        least = down.groupBy("u").agg(F.min("v").alias("m"))
        small = down.join(least, "u").select(F.explode(F.array(
            F.struct(F.col("u").alias("u"), F.col("m").alias("v")), F.struct(F.col("v").alias("u"), F.col("m").alias("v"))
        )).alias("e")).select("e.*").where(F.col("u") != F.col("v")).distinct()
        edges = stored(small, "links")
        now = _state(edges)
        if now == state:
            break
        state = now
    heads = edges.select(F.col("v").alias("node"), F.col("v").alias("root")).distinct()
    return edges.select(F.col("u").alias("node"), F.col("v").alias("root")).unionByName(heads)


def _state(edges: DataFrame) -> tuple:
    row = edges.agg(F.count(F.lit(1)).alias("n"),
                    F.sum(F.xxhash64("u", "v").cast("decimal(20,0)")).alias("h")).first()
    return row["n"], row["h"]


def near_duplicates(docs: DataFrame, key: str = "doc_id", text: str = "text", crowded: int = CROWDED) -> DataFrame:
    """One row per document: doc_id, fingerprint (16 hex digits), component_id, component_docs.

    ``component_id`` is the smallest id of the documents that are reachable over links.
    A null text counts as empty, an empty text has fingerprint 0 and is linked like any other.
    Repeated rows and ids are rows like others; a row without an id belongs to its component
    without naming it (a component of such rows alone has a null id). Other columns are not read.
    An empty table gives an empty result.
    """
    rows = stored(fingerprints(docs, key, text), "fingerprints")
    nodes = rows.groupBy("fp").agg(F.min("doc_id").alias("least"), F.count(F.lit(1)).alias("docs"))
    roots = components(links(rows, crowded))
    placed = nodes.join(roots, nodes.fp == roots.node, "left").select(
        "fp", "least", "docs", F.coalesce("root", "fp").alias("root"))
    heads = placed.groupBy("root").agg(F.min("least").alias("component_id"), F.sum("docs").alias("component_docs"))
    named = placed.join(heads, "root").select("fp", "component_id", "component_docs")
    return rows.join(named, "fp").select(
        "doc_id", F.lower(F.lpad(F.hex("fp"), 16, "0")).alias("fingerprint"), "component_id", "component_docs")


def linked_by_brute_force(values: list[int], distance: int = DISTANCE) -> Iterator[tuple[int, int]]:
    """All linked pairs, by comparing each with each; for tests."""
    for i, a in enumerate(values):
        for b in values[i + 1:]:
            if (a ^ b).bit_count() <= distance:
                yield (a, b)
