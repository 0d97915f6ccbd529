"""Mapping file lines and patch hunks to components.

The line-in-span join is a range join: both sides are cut into blocks of 64 lines, so it becomes
an equi-join on (file, block) with the range as the remaining condition.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

c = F.col
BLOCK = 64


def locate_lines(lines: DataFrame, spans: DataFrame, owners: DataFrame, order: str = "component") -> DataFrame:
    """(file, line, components, exact, tier) for every line that can be located.

    ``lines``: file, line; ``spans``: file, component, kind, start_line, end_line; ``owners``:
    file, component. The narrowest non-file span wins and ties keep every component; then the
    whole-file spans; then the file list, which is not exact. ``order`` names the column that
    orders the components of a place.
    """
    named = [c(order).alias("o"), c("component").alias("component")]
    names = F.array_sort(F.collect_set(F.struct(*named)))["component"]
    spans = spans.select("file", "component", "kind", "start_line", "end_line", *({order} - {"component"})).distinct()
    wanted = lines.select("file", "line").distinct().withColumn("_block", F.floor(c("line") / BLOCK))
    blocks = F.explode(F.sequence(F.floor(c("start_line") / BLOCK), F.floor(c("end_line") / BLOCK)))
    cut = spans.where(c("kind") != "file").withColumn("_block", blocks)
    inside = (
        wanted.join(cut, ["file", "_block"])
        .where(c("line").between(c("start_line"), c("end_line")))
        .groupBy("file", "line", (c("end_line") - c("start_line")).alias("_width"))
        .agg(names.alias("_c"))
        .groupBy("file", "line")
        .agg(F.min_by("_c", "_width").alias("_narrow"))
    )
    whole = spans.where(c("kind") == "file").groupBy("file").agg(names.alias("_whole"))
    listed = owners.groupBy("file").agg(names.alias("_listed"))
    return (
        wanted.drop("_block")
        .join(inside, ["file", "line"], "left")
        .join(whole, "file", "left")
        .join(listed, "file", "left")
        .withColumn("components", F.coalesce("_narrow", "_whole", "_listed"))
        .where(c("components").isNotNull())
        .withColumn("exact", c("_narrow").isNotNull() | c("_whole").isNotNull())
        .withColumn("tier", F.when(c("_narrow").isNotNull(), "span").when(c("_whole").isNotNull(), "file").otherwise("list"))
        .select("file", "line", "components", "exact", "tier")
    )


def hunks_to_components(hunks: DataFrame, spans: DataFrame, owners: DataFrame, order: str = "component") -> DataFrame:
    """(hunk_id, components, exact) per hunk; created files map by the file list.

    ``hunks``: hunk_id, file, status, old_start, old_lines. A mapping is exact when every line
    of the hunk was located exactly and there is at least one component.
    """
    last = c("old_start") + F.greatest(c("old_lines"), F.lit(1)) - 1
    lines = hunks.where(c("status") != "created").select(
        "hunk_id", "file", F.explode(F.sequence(c("old_start"), last)).alias("line")
    )
    places = locate_lines(lines, spans, owners, order)
    mapped = lines.join(places, ["file", "line"], "left").select(
        "hunk_id", F.explode_outer("components").alias("component"), F.coalesce("exact", F.lit(False)).alias("exact")
    )
    created = (
        hunks.where(c("status") == "created")
        .join(owners, "file", "left")
        .select("hunk_id", "component", F.lit(False).alias("exact"))
    )
    both = mapped.unionByName(created)
    if order != "component":
        places_of = owners.select("component", order).unionByName(spans.select("component", order)).distinct()
        both = both.join(places_of, "component", "left")
    found = F.array_compact(F.array_sort(F.collect_set(F.struct(c(order).alias("o"), c("component"))))["component"])
    return both.groupBy("hunk_id").agg(found.alias("components"), F.bool_and("exact").alias("exact")).withColumn(
        "exact", c("exact") & (F.size("components") > 0)
    )
