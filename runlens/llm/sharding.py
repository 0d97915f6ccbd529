"""Shards that each hold the mixture of the sources: proportional stratified interleaving.

The rows of a source are ranked in a seeded hash order; rank r of n (from 1) stands at the
fraction (2r - 1) / 2n. All rows are put in the order of that fraction and the order is cut into
equal runs. Every run then holds each source in proportion, to within about one row.
Both rankings count buckets first and sort only inside a bucket, so a source with a third of all
rows is spread like the rest.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from runlens.functions.scale import bucketed_rank, seeded_hash
from runlens.llm.arrow import stored

SEED = 20240
FRACTIONS = 16_384


def interleave(docs: DataFrame, shards: int = 8, seed: int = SEED, source: str = "source") -> DataFrame:
    """doc_id, source, size, text_crc32, position, shard, slot for every row.

    ``size`` is the UTF-8 length plus 1. Positions are gapless from 0 over all rows, slots over
    each shard; shard sizes differ by at most one row. Null sources are one source of their own,
    a null text counts as empty, rows without an id and repeated rows are rows like any other
    (equal rows are interchangeable). Other columns are not read; an empty table gives no rows.
    """
    body = F.coalesce(F.col("text"), F.lit("")).cast("binary")
    rows = docs.select(
        F.col("doc_id").cast("long").alias("doc_id"),
        F.coalesce(F.concat(F.lit("s"), F.col(source).cast("string")), F.lit("n")).alias("stratum"),
        (F.octet_length(body) + 1).cast("long").alias("size"), F.crc32(body).alias("text_crc32"))
    # texts are read once; the rankings below run over the narrow rows
    digest = seeded_hash(seed, F.col("doc_id"), F.col("text_crc32"), F.col("size"))
    rows = stored(rows.withColumn("digest", digest).withColumn("bucket", F.substring("digest", 1, 3)), "shard-rows")
    # rank within the stratum: rows before the row's hash bucket, from counts, and a sort inside it
    whole = Window.partitionBy("stratum")
    earlier = whole.orderBy("bucket").rowsBetween(Window.unboundedPreceding, -1)
    counts = rows.groupBy("stratum", "bucket").agg(F.count(F.lit(1)).alias("here"))
    counts = counts.select("stratum", "bucket", F.coalesce(F.sum("here").over(earlier), F.lit(0)).alias("before"),
                           F.sum("here").over(whole).alias("n"))
    inside = Window.partitionBy("stratum", "bucket").orderBy("digest", "doc_id", "text_crc32", "size")
    r = F.col("before") + F.row_number().over(inside)
    placed = rows.join(counts, ["stratum", "bucket"]).withColumn(
        "at", (2 * r - 1).cast("double") / (2 * F.col("n"))).drop("digest", "bucket", "before", "n")
    placed = bucketed_rank(stored(placed, "shard-fractions"), [], F.floor(F.col("at") * FRACTIONS),
                           [F.col("at"), F.col("stratum")], "p")
    total = rows.count()
    cut = placed.withColumn("position", F.col("p") - 1)
    cut = cut.withColumn("shard", F.expr(f"CAST(position * {shards} DIV {max(total, 1)} AS INT)"))
    first = F.expr(f"(shard * {total}L + {shards - 1}) DIV {shards}")
    return cut.select("doc_id", F.when(F.col("stratum") != "n", F.expr("substring(stratum, 2)")).alias("source"),
                      "size", "text_crc32", "position", "shard", (F.col("position") - first).alias("slot"))
