"""Judge agreement, blind probes and leakage rates."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from runlens.functions import text as tx

c = F.col


def _agreement(a: Column, b: Column) -> tuple[Column, Column]:
    """Compared pairs (both verdicts present) and agreeing pairs."""
    return F.count_if(a.isNotNull() & b.isNotNull()), F.count_if(a == b)


def judge_agreement(verdicts: DataFrame, keys: Sequence[str], a: str, b: str) -> DataFrame:
    """Compared, agreeing and disagreement share of two verdict columns; NULLs are not compared."""
    compared, agree = _agreement(c(a), c(b))
    out = verdicts.groupBy(*keys).agg(compared.alias("compared"), agree.alias("agree"))
    return out.withColumn("disagreement", 1 - F.try_divide(c("agree"), c("compared")))


def judge_self_consistency(verdicts: DataFrame, judges: dict[str, tuple[str, str]], keys: Sequence[str] = ()) -> DataFrame:
    """Per judge: artifacts, re-judged ones, and the share with the same verdict.

    ``judges`` maps a name to (original verdict column, repeated verdict column).
    """
    aggs = [F.count(F.lit(1)).alias("_n")]
    for name, (first, again) in judges.items():
        compared, same = _agreement(c(first), c(again))
        aggs += [compared.alias(f"_c_{name}"), same.alias(f"_s_{name}")]
    rows = F.explode(
        F.array(
            *[
                F.struct(
                    F.lit(name).alias("judge"), c("_n").alias("artifacts"), c(f"_c_{name}").alias("rejudged"),
                    F.try_divide(c(f"_s_{name}"), c(f"_c_{name}")).alias("self_consistency"),
                )
                for name in judges
            ]
        )
    )
    return verdicts.groupBy(*keys).agg(*aggs).select(*keys, rows.alias("_r")).select(*keys, "_r.*")


def probe_scores(records: DataFrame) -> DataFrame:
    """Hits, tool precision and recall, and category hit of each probe answer.

    ``records``: task_top3, guessed_tools, required_tools (arrays), assigned_task, origin_task,
    guessed_category, true_category.
    """
    guessed, truth = F.array_distinct("guessed_tools"), F.array_distinct("required_tools")
    hits = F.size(F.array_intersect(guessed, truth))
    first = F.try_element_at("task_top3", F.lit(1))
    no = F.lit(False)
    return records.select(
        "*",
        F.coalesce(first == c("assigned_task"), no).alias("hit_top1"),
        F.array_contains(F.slice("task_top3", 1, 3), c("assigned_task")).alias("hit_top3"),
        F.coalesce(first == c("origin_task"), no).alias("origin_hit_top1"),
        F.array_contains(F.slice("task_top3", 1, 3), c("origin_task")).alias("origin_hit_top3"),
        F.try_divide(hits, F.size(guessed)).alias("tool_precision"),
        F.try_divide(hits, F.size(truth)).alias("tool_recall"),
        (F.lower(tx.strip(c("guessed_category"))) == F.lower(tx.strip(c("true_category")))).alias("category_hit"),
    )


def _rate(flag: str) -> Column:
    return F.avg(c(flag).cast("double"))


def chance_rates(pools: DataFrame) -> DataFrame:
    """(source, chance_top1, chance_top3): hits of blind guesses, from the pool of a source's last run.

    ``pools``: source, run_id, pool_size (tasks a guess could name). An empty pool counts as one task.
    """
    size = F.greatest(F.lit(1), F.max_by("pool_size", "run_id")).cast("double")
    return pools.groupBy("source").agg((1 / size).alias("chance_top1"), F.least(F.lit(1.0), 3 / size).alias("chance_top3"))


def probe_rates(scored: DataFrame, keys: Sequence[str] = ("source", "arm"), pools: DataFrame | None = None) -> DataFrame:
    """Hit rates and mean tool precision and recall over answers without an error; NULLs ignored.

    With ``pools`` (see ``chance_rates``) also what chance would give.
    """
    rates = scored.where(c("error").isNull()).groupBy(*keys).agg(
        F.count(F.lit(1)).alias("n"),
        _rate("hit_top1").alias("task_top1"),
        _rate("hit_top3").alias("task_top3"),
        _rate("origin_hit_top1").alias("origin_top1"),
        F.avg("tool_precision").alias("tool_precision"),
        F.avg("tool_recall").alias("tool_recall"),
        _rate("category_hit").alias("category_hit"),
    )
    return rates if pools is None else rates.join(chance_rates(pools), "source", "left")


def pair_probe_arms(scored: DataFrame, keys: Sequence[str] = ("source", "run_id", "cluster_id")) -> DataFrame:
    """Reference against system answers of one cluster, as one aggregation; both must exist."""
    def of(arm: str, flag: str) -> Column:
        return F.max(F.when(c("arm") == arm, c(flag).cast("int")))

    rows = scored.where(c("error").isNull() & c("arm").isin("reference", "system")).groupBy(*keys).agg(
        of("reference", "hit_top1").alias("ref_top1"), of("system", "hit_top1").alias("self_top1"),
        of("reference", "hit_top3").alias("ref_top3"), of("system", "hit_top3").alias("self_top3"),
    )
    return (
        rows.where(c("ref_top1").isNotNull() & c("self_top1").isNotNull())
        .withColumn("gap_top1", c("ref_top1") - c("self_top1"))
        .withColumn("gap_top3", c("ref_top3") - c("self_top3"))
    )


def leakage_rates(probes: DataFrame, components: DataFrame, keys: Sequence[str] = ("source", "run_id")) -> DataFrame:
    """Top-1 and top-3 hit rates over non-error probes, and the chance rate 1 / eligible components."""
    eligible = components.where(c("patchable") & c("where_eligible")).agg(F.count(F.lit(1))).scalar()
    hit = lambda ok: F.when(c("error").isNull(), ok.cast("double"))
    top1 = F.coalesce(F.try_element_at("top3", F.lit(1)) == c("true_component"), F.lit(False))
    top3 = F.array_contains(F.slice("top3", 1, 3), c("true_component"))
    return probes.groupBy(*keys).agg(
        F.count_if(c("error").isNull()).alias("n"), F.avg(hit(top1)).alias("top1_rate"), F.avg(hit(top3)).alias("top3_rate")
    ).withColumn("chance_top1", 1 / F.greatest(F.lit(1), eligible))
