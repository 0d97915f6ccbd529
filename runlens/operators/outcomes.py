"""Failure families: infrastructure and task outcomes are never merged, budget is its own family."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from runlens import fixed

c = F.col


def classify_failures(rollouts: DataFrame) -> DataFrame:
    """Rollouts that did not pass or carry an error family, with ``family`` and ``reason``.

    ``passed`` is NULL for an unscored rollout, which counts as not passed.
    """
    passed = F.coalesce(c("passed"), F.lit(False))
    return (
        rollouts.where(~passed | (c("error_family") != "none"))
        .withColumn(
            "family",
            F.when(c("error_family") == "infra", "infra")
            .when(c("error_family") == "budget", "budget")
            .otherwise("task"),
        )
        .withColumn(
            "reason",
            F.when(c("error_family") == "infra", F.coalesce(c("error"), c("error_kind"), F.lit("infra")))
            .when(c("error_family") == "budget", F.coalesce(c("error"), F.lit("budget exhausted")))
            .when(c("passed").isNull(), F.lit("not scored"))
            .otherwise(c("score_reason")),
        )
        .withColumn("kind", F.coalesce(c("error_kind"), c("task_failure")))
        .withColumn("passed", passed)
    )


def classify_rollout_error(rollouts: DataFrame, usd_cap: float | None = None) -> DataFrame:
    """``error_family`` and ``error_kind``; the first matching rule wins.

    Order: failed worker, usage mismatch, infrastructure exit, budget exit, cost over the cap.
    """
    over = F.lit(False) if usd_cap is None else F.coalesce(c("usd") > F.lit(usd_cap), F.lit(False))
    worker, mismatch = ~c("worker_ok"), c("usage_mismatch")
    infra = c("exit_reason").isin(fixed.INFRA_EXITS)
    budget = c("exit_reason").isin(fixed.BUDGET_EXITS) | over
    return rollouts.withColumn(
        "error_family",
        F.when(worker | mismatch | infra, "infra").when(budget, "budget").otherwise("none"),
    ).withColumn(
        "error_kind",
        F.when(worker, F.coalesce(c("worker_error"), F.lit("policy_worker_error")))
        .when(mismatch, "usage_mismatch")
        .when(infra, c("exit_reason"))
        .when(budget, fixed.BUDGET_EXHAUSTED),
    )


def reason_family(df: DataFrame, reason: str = "reason") -> DataFrame:
    """Ordered pattern rules -> ``family`` and ``kind``; a reason no rule knows is an error."""
    unknown = F.raise_error(F.concat(F.lit("unknown scorer reason: "), F.substring(reason, 1, 200)))

    def first(position: int) -> Column:
        out = None
        for rule in fixed.REASON_RULES:
            hit = c(reason).rlike(rule[0])
            out = F.when(hit, rule[position]) if out is None else out.when(hit, rule[position])
        return out.otherwise(unknown)

    return df.withColumn("family", first(1)).withColumn("kind", first(2))


def usage_mismatch(rollouts: DataFrame, usage: DataFrame, key: str = "rollout_id") -> DataFrame:
    """Rollouts whose recorded token totals differ from the sums over their model calls."""
    sums = usage.select(
        key, c("prompt_tokens").alias("step_prompt"), c("completion_tokens").alias("step_completion")
    )
    return (
        rollouts.join(sums, key, "left")
        .fillna(0, ["step_prompt", "step_completion"])
        .where(
            (c("step_prompt") != F.coalesce(c("meta_prompt"), F.lit(0)))
            | (c("step_completion") != F.coalesce(c("meta_completion"), F.lit(0)))
        )
    )
