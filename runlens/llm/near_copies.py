"""Near copies by five-word shingles: multi-index hashing of wide SimHash fingerprints, then exact similarity.

Two texts are near copies if the sets of their five-word shingles have a Jaccard similarity of 0.8
or more. At that similarity a fingerprint bit differs with probability 0.15, so the balls that
find all of them are large; but the bits that differ are those whose sums lie next to zero. A
fingerprint has seven segments of 24 bits; in each the ball is enumerated over the ``DOUBT`` bits
with the smallest sums, and a text is stored under every key of its balls. Two texts meet where
the differing bits of a segment are doubtful in one or the other, which a segment gives in 0.37 of
the pairs at a similarity of 0.8 and in 0.86 at 0.95; seven segments give it in 0.96 and nearly 1.
What meets is compared over the complete fingerprint, then by its shingles. ``SEGMENT_BITS`` says how
many texts share a key by chance: 24 bits keep that small up to some ten million texts.

Keys that more than ``CROWDED`` fingerprints share stand for a group of copies: there every member
first meets the smallest one, and of all that a text met it is first compared with the ``NEAREST``
ones before it, so that pairs grow with the members of a group, not with their square. Links make
components. The others that met, whatever their number, are compared after that where their components
differ; within a component they cannot change anything. So the groups are those of all pairs that met.
Of a crowd of looser copies these are many; a bound of their similarity (``SKETCHES``) that is never
too low keeps most of them from a comparison by shingles.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from runlens.llm.arrow import map_batches, stored, texts_of
from runlens.llm.simhash import components
from runlens.llm.words import POLY_B, Words, blocks, mixed

WIDTH = 5
SIMILARITY = 0.8
SEGMENTS, SEGMENT_BITS, DOUBT = 7, 24, 4
PARTS = ("p0", "p1", "p2")
#: Differing bits of the first 64, and of all 192, up to which a pair is compared by its shingles: some three
#: standard deviations above what a similarity of 0.8 gives.
FIRST_DISTANCE, DISTANCE = 20, 45
CROWDED = 16
#: Smaller nodes that a node is compared with at first.
NEAREST = 8
#: Parities of the number of shingles in each of 512 classes. Every bit that differs is a shingle that only one text has.
SKETCHES = tuple(f"s{k}" for k in range(8))
#: Shingles whose bits are summed at a time.
PIECE = 8192


def shingles(words: Words, width: int = WIDTH) -> tuple[np.ndarray, np.ndarray]:
    """(hash, text) of the different shingles of every text, by text, then hash.

    A shingle is ``width`` words in a row, A-Z taken as a-z; a text of fewer words is one shingle.
    """
    lower = np.where((words.cps >= 65) & (words.cps <= 90), words.cps + 32, words.cps)
    with np.errstate(over="ignore"):
        keys = mixed(words.hashes(POLY_B, np.uint64, lower)) ^ mixed(words.hashes(1_000_003, np.uint64, lower) + np.uint64(77))
        size = np.minimum(words.count, width)
        per = np.where(words.count > 0, words.count - size + 1, 0)
        doc = np.repeat(np.arange(words.n), per)
        first = words.first[doc] + np.arange(len(doc)) - np.repeat(np.cumsum(per) - per, per)
        found = mixed(size[doc].astype(np.uint64))
        for k in range(width):
            inside = k < size[doc]
            at = np.minimum(first + k, max(len(keys) - 1, 0))
            found = np.where(inside, mixed(found * np.uint64(3) + keys[at]), found) if len(keys) else found
    order = np.lexsort((found, doc))
    found, doc = found[order], doc[order]
    new = np.ones(len(doc), dtype=bool)
    new[1:] = (found[1:] != found[:-1]) | (doc[1:] != doc[:-1])
    return found[new], doc[new]


def sketches(n: int, found: np.ndarray, doc: np.ndarray) -> np.ndarray:
    """``SKETCHES`` of ``n`` texts by their ``shingles``."""
    classes = 64 * len(SKETCHES)
    counts = np.bincount(doc * classes + (found % np.uint64(classes)).astype(np.int64), minlength=n * classes).reshape(n, classes)
    return np.packbits((counts & 1).astype(np.uint8), axis=1, bitorder="little").view("<u8").reshape(-1, len(SKETCHES))


def signatures(words: Words, known: tuple[np.ndarray, np.ndarray] | None = None) -> tuple[np.ndarray, np.ndarray]:
    """Fingerprints (three 64-bit numbers) and keys of the texts of a block.

    A fingerprint bit is the majority of the shingles' bits; a text without words has fingerprint
    zero. Keys: segment number and segment, for all settings of its ``DOUBT`` least certain bits. ``known``: the shingles, if they are there.
    """
    found, doc = shingles(words) if known is None else known
    with np.errstate(over="ignore"):
        wide = np.column_stack([mixed(found + np.uint64(k) * np.uint64(0x632BE59BD9B4E019)) for k in range(len(PARTS))])
    sums = np.zeros((words.n, 64 * len(PARTS)), dtype=np.int32)
    count = np.bincount(doc, minlength=words.n)
    for at in range(0, len(wide), PIECE):
        bits = np.unpackbits(wide[at:at + PIECE].view(np.uint8).reshape(-1, 8 * len(PARTS)), axis=1, bitorder="little")
        here = doc[at:at + PIECE]
        begin = np.flatnonzero(np.concatenate([[True], here[1:] != here[:-1]]))
        sums[here[begin]] += np.add.reduceat(bits, begin, axis=0, dtype=np.int32)
    balance = 2 * sums - count[:, None]
    ones = balance > 0
    prints = np.packbits(ones, axis=1, bitorder="little").view("<u8").reshape(-1, len(PARTS))
    keys = np.empty((words.n, SEGMENTS, 1 << DOUBT), dtype=np.int64)
    settings = (np.arange(1 << DOUBT)[:, None] >> np.arange(DOUBT)) & 1
    weights = 1 << np.arange(SEGMENT_BITS, dtype=np.int64)
    for s in range(SEGMENTS):
        span = slice(s * SEGMENT_BITS, (s + 1) * SEGMENT_BITS)
        value = ones[:, span] @ weights
        doubt = np.sort(np.argsort(np.abs(balance[:, span]), axis=1, kind="stable")[:, :DOUBT], axis=1)
        masks = weights[doubt]
        keys[:, s] = (value & ~masks.sum(axis=1))[:, None] + masks @ settings.T + (s << SEGMENT_BITS)
    return prints, keys.reshape(words.n, -1).astype(np.int32)


def meetings(nodes: DataFrame, crowded: int = CROWDED, first: int = FIRST_DISTANCE) -> DataFrame:
    """(key, a, b, gap): which of ``nodes`` (node, p0, p1, p2, keys) share a key; ``gap`` counts the differing bits of p0.

    The first 64 bits travel with the keys, so that nodes that meet by chance part where they meet.
    Of a key with up to ``crowded`` nodes all pairs a < b with a gap of at most ``first`` are listed,
    each once and with a null key; of a key with more every node b, whatever its gap, beside the key's smallest one.
    """
    entries = nodes.select("node", "p0", F.explode("keys").alias("key")).repartition("key")
    crowds = entries.groupBy("key").agg(F.count(F.lit(1)).alias("n"), F.min(F.struct("node", "p0")).alias("least")).where(
        F.col("n") > crowded).select("key", F.col("least.node").alias("a"), F.col("least.p0").alias("x"))
    lists = entries.join(crowds, "key", "left_anti").groupBy("key").agg(F.collect_list(F.struct("node", "p0")).alias("m")).where(
        F.size("m") > 1)

    def partners(one):
        gap = lambda other: F.bit_count(other["p0"].bitwiseXOR(one["p0"]))
        near = F.filter("m", lambda other: (other["node"] > one["node"]) & (gap(other) <= first))
        return F.transform(near, lambda other: F.struct(one["node"].alias("a"), other["node"].alias("b"), gap(other).alias("gap")))

    met = lists.select(F.explode(F.flatten(F.transform("m", partners))).alias("e")).select("e.a", "e.b", "e.gap").distinct()
    star = entries.join(crowds, "key").select("key", "a", F.col("node").alias("b"), F.bit_count(F.col("x").bitwiseXOR(F.col("p0"))).alias("gap"))
    return star.unionByName(met.withColumn("key", F.lit(None).cast("int")))


def ranked(met: DataFrame, first: int = FIRST_DISTANCE) -> DataFrame:
    """(b, near): the smaller nodes that each node met, (gap, a), by their gaps. A node meets a bounded number under each of its keys."""
    return met.where((F.col("a") < F.col("b")) & (F.col("gap") <= first)).groupBy("b").agg(
        F.array_sort(F.collect_set(F.struct("gap", "a"))).alias("near"))


def nearest(met: DataFrame, first: int = FIRST_DISTANCE) -> DataFrame:
    """(a, b): of the smaller nodes that a node met, the ``NEAREST`` ones."""
    return ranked(met, first).select(F.explode(F.slice("near", 1, NEAREST)["a"]).alias("a"), "b")


def others(met: DataFrame, placed: DataFrame, similarity: float = SIMILARITY, first: int = FIRST_DISTANCE, distance: int = DISTANCE) -> DataFrame:
    """(a, b): all pairs that met beside the ``nearest`` ones, of different roots, that are close and may be similar.

    ``placed``: node, prints, n (shingles), sketches, root. Of a crowded key with one root nothing is
    left. Of one with more, all nodes outside its most frequent root meet all nodes of other roots.
    """
    known = [c for c in placed.columns if c != "node"]

    def of(side: str, *names: str) -> DataFrame:
        return placed.select(F.col("node").alias(side), *[F.col(c).alias(side + c) for c in names or known])

    def differing(names) -> Column:
        return sum((F.bit_count(F.col(f"a{c}").bitwiseXOR(F.col(f"b{c}"))) for c in names), F.lit(0))

    away = (F.col("aroot") != F.col("broot")) & (differing(PARTS) <= distance)
    # at a similarity of s at most (1 - s) / (1 + s) of both texts' shingles are in one text only; rounding may let a pair through
    alike = differing(SKETCHES) * F.lit(1 + similarity) <= F.lit(1 - similarity) * (F.col("an") + F.col("bn")) + F.lit(1e-6)
    rest = ranked(met, first).where(F.size("near") > NEAREST).select(
        "b", F.slice("near", F.lit(NEAREST + 1), F.size("near"))["a"].alias("rest"))
    listed = rest.join(of("b", *PARTS, "root"), "b").withColumn("_a", F.explode("rest")).drop("rest")
    listed = listed.join(of("a", *PARTS, "root"), (F.col("_a") == F.col("a")) & away).select("a", "b")
    listed = listed.join(of("a", "n", *SKETCHES), "a").join(of("b", "n", *SKETCHES).withColumnRenamed("b", "_b"), (F.col("b") == F.col("_b")) & alike)
    # a row per node, with the crowded keys it stands under, of which there are SEGMENTS << DOUBT at most
    crowd = stored(met.where(F.col("key").isNotNull()).groupBy(F.col("b").alias("node")).agg(
        F.collect_list("key").alias("keys")).join(placed, "node"), "crowds")
    counts = crowd.select("root", F.explode("keys").alias("key")).groupBy("key", "root").agg(F.count(F.lit(1)).alias("n"))
    several = counts.groupBy("key").agg(
        F.count(F.lit(1)).alias("roots"), F.max(F.struct("n", "root"))["root"].alias("main")).where(F.col("roots") > 1).select("key", "main")
    outside = stored(counts.join(several, "key").where(F.col("root") != F.col("main")).select("key", "main", F.col("root").alias("aroot")), "outside")
    one = crowd.join(outside.select(F.col("aroot").alias("root")).distinct(), "root", "left_semi").select(
        F.explode("keys").alias("key"), F.col("node").alias("a"), *[F.col(c).alias("a" + c) for c in known]).join(outside, ["key", "aroot"])
    two = crowd.select(F.explode("keys").alias("key"), F.col("node").alias("b"), *[F.col(c).alias("b" + c) for c in known])
    once = (F.col("broot") == F.col("main")) | (F.col("a") < F.col("b"))
    gap = F.bit_count(F.col(f"a{PARTS[0]}").bitwiseXOR(F.col(f"b{PARTS[0]}")))
    across = one.join(two, (one["key"] == two["key"]) & once & (gap <= first) & away & alike)
    return listed.select("a", "b").unionByName(across.select("a", "b")).select(
        F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b")).distinct()


def close(pairs: DataFrame, nodes: DataFrame, distance: int = DISTANCE) -> DataFrame:
    """The pairs (a, b) that differ in at most ``distance`` bits of the complete fingerprint."""
    prints = nodes.select("node", *PARTS)
    both = pairs.join(prints.toDF("a", *[f"x{p}" for p in PARTS]), "a").join(prints.toDF("b", *[f"y{p}" for p in PARTS]), "b")
    apart = sum((F.bit_count(F.col(f"x{p}").bitwiseXOR(F.col(f"y{p}"))) for p in PARTS), F.lit(0))
    return both.where(apart <= distance).select("a", "b")


def links(nodes: DataFrame, crowded: int = CROWDED, first: int = FIRST_DISTANCE, distance: int = DISTANCE) -> DataFrame:
    """Pairs (a, b), a < b, that are compared first: the ``nearest`` of the ``meetings`` of ``nodes`` that are ``close``."""
    return close(nearest(meetings(nodes, crowded, first), first), nodes, distance)


def similar(pairs: DataFrame, texts: DataFrame, similarity: float = SIMILARITY) -> DataFrame:
    """The pairs (a, b) whose texts (node, text) have at least that Jaccard similarity of shingles."""

    def run(batch: pa.RecordBatch) -> pa.RecordBatch:
        found, out = texts_of(batch), []
        for a, b in blocks(found):
            hashes, doc = shingles(Words(found[a:b]))
            out += np.split(hashes.view(np.int64), np.cumsum(np.bincount(doc, minlength=b - a))[:-1])
        return pa.RecordBatch.from_arrays([batch.column(0), pa.array(out, pa.list_(pa.int64()))], ["node", "shingles"])

    sets = stored(map_batches(texts.select("node", "text"), run, "node long, shingles array<long>"), "shingles")
    both = pairs.join(sets.toDF("a", "sa"), "a").join(sets.toDF("b", "sb"), "b")
    common = F.size(F.array_intersect("sa", "sb"))
    return both.where(common >= F.lit(similarity) * (F.size("sa") + F.size("sb") - common)).select("a", "b")


def row_key(key: str, text: str) -> Column:
    """Names a row by its id and a digest of its text; never null."""
    part = lambda c: F.coalesce(c, F.lit("null"))
    return F.concat_ws(":", part(F.col(key).cast("string")), part(F.sha2(F.col(text).cast("binary"), 256)))


def one_of_each_group(docs: DataFrame, key: str = "doc_id", text: str = "text", similarity: float = SIMILARITY,
                      crowded: int = CROWDED) -> DataFrame:
    """The documents, all columns, with exactly one row of every group of near copies.

    Rows are told apart by id and text, so unrelated texts under one id all stay. Of a group the row
    with the smallest id stays, of equal ids the one with the smallest text digest, of equal texts
    the smallest by the other columns (of types with an order, so no maps). A row without an id
    stays only if its group has no row with one. Null, empty and blank texts are one group, texts of
    fewer than five words are copies if they have the same words. An empty table gives an empty one.
    """
    hidden = "_row"
    while hidden in docs.columns:
        hidden += "_"
    named = docs.withColumn(hidden, row_key(key, text))

    def run(batch: pa.RecordBatch) -> pa.RecordBatch:
        found, prints, keys = texts_of(batch), [np.zeros((0, len(PARTS)), np.uint64)], [np.zeros((0, SEGMENTS << DOUBT), np.int32)]
        sizes, bits = [np.zeros(0, np.int64)], [np.zeros((0, len(SKETCHES)), np.uint64)]
        for a, b in blocks(found):
            words = Words(found[a:b])
            some = shingles(words)
            for whole, part in zip((prints, keys, sizes, bits), (*signatures(words, some), np.bincount(some[1], minlength=b - a), sketches(b - a, *some))):
                whole.append(part)
        fp, every, sketch = np.concatenate(prints).view(np.int64), np.concatenate(keys), np.concatenate(bits).view(np.int64)
        listed = pa.ListArray.from_arrays(pa.array(np.arange(0, every.size + 1, every.shape[1], dtype=np.int32)), pa.array(every.ravel()))
        parts = [pa.array(np.ascontiguousarray(numbers[:, k])) for numbers in (fp, sketch) for k in range(numbers.shape[1])]
        return pa.RecordBatch.from_arrays([batch.column(0), batch.column(2), pa.array(np.concatenate(sizes)), *parts, listed],
                                          ["doc_id", "row", "n", *PARTS, *SKETCHES, "keys"])

    read = named.select(F.col(key).cast("long").alias("doc_id"), F.col(text).alias("text"), F.col(hidden).alias("row"))
    rows = map_batches(read, run, f"doc_id long, row string, n long, {' long, '.join((*PARTS, *SKETCHES))} long, keys array<int>")
    nodes = stored(rows.groupBy(*PARTS).agg(
        F.min(F.struct(F.col("doc_id").isNull().alias("unnamed"), "doc_id", "row", "n", *SKETCHES)).alias("head"), F.min("keys").alias("keys")
    ).withColumn("node", F.xxhash64(*PARTS)), "nodes")
    met = stored(meetings(nodes, crowded), "met")

    def linked(pairs: DataFrame) -> DataFrame:
        here = pairs.select(F.col("a").alias("node")).unionByName(pairs.select(F.col("b").alias("node"))).distinct()
        # written, so that its size is known before the texts are joined: those of few nodes need no shuffle of all texts
        wanted = stored(nodes.join(here, "node", "left_semi").select("node", F.col("head.row").alias(hidden)), "wanted")
        texts = named.join(wanted, hidden).groupBy("node").agg(F.min(text).alias("text"))
        return similar(pairs, texts, similarity)

    roots = components(linked(stored(close(nearest(met), nodes), "pairs")))
    # written, as the comparisons read it many times: the driver plans and follows a join for each of them otherwise
    placed = stored(nodes.join(roots, "node", "left").select(
        "node", *PARTS, "head.n", *[f"head.{c}" for c in SKETCHES], F.coalesce("root", "node").alias("root")), "placed")
    rest = stored(others(met, placed, similarity), "others")
    if not rest.isEmpty():
        known = roots.where(F.col("node") != F.col("root")).select(F.col("root").alias("a"), F.col("node").alias("b"))
        roots = components(known.unionByName(linked(rest)))
    heads = nodes.join(roots, "node", "left").select(F.coalesce("root", "node").alias("root"), "head")
    kept = heads.groupBy("root").agg(F.min("head").alias("head")).select(F.col("head.row").alias(hidden))
    return named.join(kept, hidden, "left_semi").groupBy(hidden).agg(
        F.min(F.struct(*[F.col(f"`{c}`") for c in docs.columns])).alias("_kept")).select("_kept.*")
