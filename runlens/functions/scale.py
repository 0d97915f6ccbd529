"""Exact group-wise ranks, quantiles and digests that never put a whole group into one task.

A plain ``row_number().over(partitionBy(key))`` sorts all rows of a key in one task, which does
not work when one key holds a third of the data. The helpers here cut every group into buckets
that follow the order, count the buckets, and sort only inside a bucket.
"""

from __future__ import annotations

from collections.abc import Callable, Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

HASH_BUCKET_HEX = 3


def seeded_hash(*parts: Column | str | int) -> Column:
    """SHA-256 hex of the parts joined by ':'; the order every seeded pick uses."""
    cols = [p if isinstance(p, Column) else F.lit(str(p)) for p in parts]
    return F.sha2(F.concat_ws(":", *[c.cast("string") for c in cols]), 256)


def bucket_offsets(df: DataFrame, keys: Sequence[str], bucket: str) -> DataFrame:
    """Per (keys, bucket): the number of rows of the group in earlier buckets (``_before``)."""
    w = Window.partitionBy(*keys).orderBy(bucket).rowsBetween(Window.unboundedPreceding, -1)
    counts = df.groupBy(*keys, bucket).agg(F.count(F.lit(1)).alias("_n"))
    return counts.withColumn("_before", F.coalesce(F.sum("_n").over(w), F.lit(0)))


def bucketed_rank(
    df: DataFrame,
    keys: Sequence[str],
    bucket: Column,
    order: Sequence[Column],
    name: str = "rn",
    limit: str | int | None = None,
) -> DataFrame:
    """Exact 1-based rank inside ``keys``; ``bucket`` must be monotone in ``order``.

    With ``limit`` (a number or a column name) only ranks up to it are returned, and buckets
    that lie wholly beyond it are dropped before any sort.
    """
    rows = df.withColumn("_bucket", bucket)
    offsets = bucket_offsets(rows, keys, "_bucket")
    joined = rows.join(offsets, [*keys, "_bucket"])
    bound = None
    if limit is not None:
        bound = F.col(limit) if isinstance(limit, str) else F.lit(limit)
        joined = joined.where(F.col("_before") < bound)
    w = Window.partitionBy(*keys, "_bucket").orderBy(*order)
    ranked = joined.withColumn(name, F.col("_before") + F.row_number().over(w))
    if bound is not None:
        ranked = ranked.where(F.col(name) <= bound)
    return ranked.drop("_bucket", "_before", "_n")


def hash_rank(
    df: DataFrame,
    keys: Sequence[str],
    digest: str,
    tie: Sequence[str],
    name: str = "rn",
    limit: str | int | None = None,
) -> DataFrame:
    """Rank by a hex digest column: its first digits are the (even) buckets."""
    return bucketed_rank(
        df,
        keys,
        F.substring(digest, 1, HASH_BUCKET_HEX),
        [F.col(digest), *[F.col(t) for t in tie]],
        name,
        limit,
    )


def value_cell(value: Column, parts: int) -> Column:
    """Cell of a double, monotone in its value: every power of two is cut into ``parts`` equal cells.

    The cells follow the magnitude, so outliers of any size leave the other values spread out.
    """
    size = F.abs(value)
    power = F.greatest(F.lit(-1074.0), F.least(F.lit(1023.0), F.floor(F.log2(size)).cast("double")))
    within = F.least(F.lit(float(parts)), F.floor((size / F.pow(F.lit(2.0), power) - 1) * parts).cast("double"))
    cell = ((power + 1100) * parts + within).cast("long")
    return F.when(value > 0, cell).when(value < 0, -cell).otherwise(F.lit(0).cast("long"))


def exact_quantiles(
    df: DataFrame,
    keys: Sequence[str],
    value: str,
    picks: dict[str, Callable[[Column], Column]],
    buckets: int = 1024,
    levels: int = 2,
) -> DataFrame:
    """Exact order statistics per group, one row per group with one column per pick.

    ``picks`` maps a column name to a function from the group size to a 0-based position.
    The first level counts cells that follow the magnitude (``value_cell``); the rows of the cells
    that hold a pick are counted by value, and each further level cuts what is left of a pick into
    ``buckets`` equal-width cells; only the values of the last cell are sorted. A hot group or outliers of
    several scales therefore leave few rows to sort.
    """
    values = df.where(F.col(value).isNotNull()).select(*keys, F.col(value).cast("double").alias("_v"))
    cells = values.withColumn("_b", value_cell(F.col("_v"), buckets)).withColumn("_c", F.lit(1))

    def with_cell(frame: DataFrame) -> DataFrame:
        width = F.col("_hi") - F.col("_lo")
        position = F.floor((F.col("_v") - F.col("_lo")) / width * buckets)
        return frame.withColumn("_b", F.when(width > 0, F.least(F.lit(buckets - 1), position)).otherwise(F.lit(0)))

    def histogram(frame: DataFrame, by: Sequence[str]) -> DataFrame:
        w = Window.partitionBy(*by).orderBy("_b").rowsBetween(Window.unboundedPreceding, -1)
        cells = frame.groupBy(*by, "_b").agg(F.sum("_c").alias("_n"), F.min("_v").alias("_lo"), F.max("_v").alias("_hi"))
        return cells.withColumn("_before", F.coalesce(F.sum("_n").over(w), F.lit(0)))

    def hits(cells: DataFrame) -> DataFrame:
        inside = (F.col("_before") <= F.col("_pos")) & (F.col("_pos") < F.col("_before") + F.col("_n"))
        return cells.where(inside).select(
            *keys, "_pick", "_b", (F.col("_pos") - F.col("_before")).alias("_pos"), "_lo", "_hi"
        )

    def wanted(cells: DataFrame) -> DataFrame:
        """The picks of a group, whose positions follow from its size, beside each of its cells."""
        size = F.sum("_n").over(Window.partitionBy(*keys))
        picked = F.explode(F.array(*[
            F.struct(F.lit(n).alias("pick"), f(F.col("_size")).cast("long").alias("pos")) for n, f in picks.items()
        ]))
        return cells.withColumn("_size", size).select("*", picked.alias("_p")).select(
            *cells.columns, F.col("_p.pick").alias("_pick"), F.col("_p.pos").alias("_pos"))

    state = hits(wanted(histogram(cells, keys)))
    near = [*keys, "_pick", "_pos", "_lo", "_hi", "_v"]
    rows = cells.join(state, [*keys, "_b"]).groupBy(*near).agg(F.count(F.lit(1)).alias("_c"))
    for _ in range(levels - 1):
        rows = with_cell(rows)
        by = [*keys, "_pick", "_pos"]
        state = hits(histogram(rows, by))
        rows = rows.select(*keys, "_pick", "_b", "_v", "_c").join(state, [*keys, "_pick", "_b"]).drop("_b")
    w = Window.partitionBy(*keys, "_pick").orderBy("_v")
    picked = rows.withColumn("_cum", F.sum("_c").over(w)).where(
        (F.col("_cum") > F.col("_pos")) & (F.col("_cum") - F.col("_c") <= F.col("_pos"))
    )
    return picked.groupBy(*keys).agg(
        *[F.max(F.when(F.col("_pick") == n, F.col("_v"))).alias(n) for n in picks]
    )


def median_picks(prefix: str) -> dict[str, Callable[[Column], Column]]:
    """The two middle positions; their mean is the exact median."""
    return {
        f"{prefix}_lo": lambda n: F.floor((n - 1) / 2),
        f"{prefix}_hi": lambda n: F.floor(n / 2),
    }


def nearest_rank(q: float) -> Callable[[Column], Column]:
    """Position ``round(q * (n - 1))`` with half-even rounding."""
    return lambda n: F.bround(F.lit(q) * (n - 1), 0)


def member_digest(
    df: DataFrame,
    keys: Sequence[str],
    item: str,
    exact: Callable[[Column], Column],
    text: Callable[[Column], Column] | None = None,
) -> DataFrame:
    """One order-independent digest per group: columns ``keys``, ``members``, ``digest``.

    SHA-256 over a list is sequential, so the digest has two levels at every size: members are
    spread over 65,536 hash buckets, the sorted members of every bucket are hashed, and the digest
    is ``exact`` of the sorted list of (bucket, bucket digest). Every member counts, no task sees
    a whole group. ``text`` turns a member into the text that is hashed.
    """
    as_text = text or (lambda x: x.cast("string"))
    return (
        df.select(*keys, F.col(item).alias("_item"))
        .withColumn("_b", F.substring(F.sha2(as_text(F.col("_item")), 256), 1, 4))
        .groupBy(*keys, "_b")
        .agg(F.count(F.lit(1)).alias("_n"), F.array_sort(F.collect_list("_item")).alias("_items"))
        .withColumn("_d", F.sha2(F.concat_ws("\n", F.transform("_items", as_text)), 256))
        .groupBy(*keys)
        .agg(F.sum("_n").alias("members"), F.array_sort(F.collect_list(F.concat("_b", "_d"))).alias("_ds"))
        .select(*keys, "members", exact(F.col("_ds")).alias("digest"))
    )


def prior_value(
    probes: DataFrame,
    events: DataFrame,
    keys: Sequence[str],
    step: str,
    order: str,
    value: str,
    block: int = 256,
) -> DataFrame:
    """As-of lookup: the ``value`` of the last event with a smaller ``step`` than the probe.

    Events of one step count in ``order``. Steps are cut into blocks: inside a block the value
    comes from a window, from earlier blocks it is carried by a window over one row per block.
    """
    blocks = F.floor(F.col(step) / block).alias("_block")
    last = events.groupBy(*keys, step).agg(F.max_by(value, order).alias("_val"))
    per_block = last.groupBy(*keys, blocks).agg(F.max_by("_val", step).alias("_last"))
    filled = probes.select(*keys, blocks).distinct().join(per_block, [*keys, "_block"], "full")
    carry = filled.withColumn(
        "_carry",
        F.last("_last", ignorenulls=True).over(
            Window.partitionBy(*keys).orderBy("_block").rowsBetween(Window.unboundedPreceding, -1)
        ),
    ).select(*keys, "_block", "_carry")
    marks = last.select(*keys, step, "_val", F.lit(None).alias("_probe")).unionByName(
        probes.select(*keys, step, F.lit(None).alias("_val"), F.struct(*probes.columns).alias("_probe"))
    ).withColumn("_block", F.floor(F.col(step) / block))
    within = Window.partitionBy(*keys, "_block").orderBy(step).rangeBetween(Window.unboundedPreceding, -1)
    found = (
        marks.withColumn("_in", F.last("_val", ignorenulls=True).over(within))
        .where(F.col("_probe").isNotNull())
        .join(carry, [*keys, "_block"], "left")
    )
    return found.select("_probe.*", F.coalesce("_in", "_carry").alias(f"prior_{value}"))


def bucketed_running_sum(
    df: DataFrame, keys: Sequence[str], bucket: Column, order: Sequence[Column], value: str, name: str
) -> DataFrame:
    """Sum of ``value`` over the strictly earlier rows of the group, without sorting whole groups."""
    rows = df.withColumn("_bucket", bucket)
    w = Window.partitionBy(*keys).orderBy("_bucket").rowsBetween(Window.unboundedPreceding, -1)
    carry = (
        rows.groupBy(*keys, "_bucket")
        .agg(F.sum(value).alias("_sum"))
        .withColumn("_carry", F.coalesce(F.sum("_sum").over(w), F.lit(0)))
        .drop("_sum")
    )
    inner = Window.partitionBy(*keys, "_bucket").orderBy(*order).rowsBetween(Window.unboundedPreceding, -1)
    return (
        rows.join(carry, [*keys, "_bucket"])
        .withColumn(name, F.col("_carry") + F.coalesce(F.sum(value).over(inner), F.lit(0)))
        .drop("_bucket", "_carry")
    )
