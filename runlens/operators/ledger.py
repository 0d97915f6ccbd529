"""Cost accounting over the append-only ledger. Money is summed as DECIMAL, order never matters."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from runlens import fixed

c = F.col


def _count(event: str, *extra: Column) -> Column:
    cond = c("event") == event
    for e in extra:
        cond = cond & e
    return F.count_if(cond)


def _sum(event: str, column: str) -> Column:
    return F.coalesce(F.sum(F.when(c("event") == event, c(column))), F.lit(0))


def partial_columns() -> list[Column]:
    """The ledger totals as aggregate expressions, money as DECIMAL: what can be added up further.

    Search and policy spend stay apart from ``usd``; budget exhaustion is not a task failure.
    """
    budget = c("error_kind").eqNullSafe(F.lit(fixed.BUDGET_EXHAUSTED))
    return [
        _count("call").alias("calls"),
        _count("call", c("cached")).alias("cached_calls"),
        _count("infra_retry").alias("infra_retries"),
        _count("infra_failure").alias("infra_failures"),
        _count("task_failure", ~budget).alias("task_failures"),
        _count("task_failure", budget).alias("budget_exhausted"),
        _sum("call", "prompt_tokens").cast("bigint").alias("prompt_tokens"),
        _sum("call", "completion_tokens").cast("bigint").alias("completion_tokens"),
        _sum("call", "usd").alias("usd"),
        _count("search").alias("search_calls"),
        _sum("search", "usd").alias("search_usd"),
        _count("policy").alias("policy_rollouts"),
        _sum("policy", "prompt_tokens").cast("bigint").alias("policy_prompt_tokens"),
        _sum("policy", "completion_tokens").cast("bigint").alias("policy_completion_tokens"),
        _sum("policy", "usd").alias("policy_usd"),
    ]


#: Columns of the totals that are money.
MONEY = ("usd", "search_usd", "policy_usd")


def summed(partials: DataFrame, keys: Sequence[str]) -> DataFrame:
    """Totals per key from any number of partial totals."""
    names = [n for n in partials.columns if n not in (*keys, "batch")]
    sums = {n: F.sum(n).cast("double" if n in MONEY else "bigint").alias(n) for n in names}
    return partials.groupBy(*keys).agg(*sums.values())


def ledger_summary(ledger: DataFrame, keys: Sequence[str] = ("run_id",)) -> DataFrame:
    totals = ledger.groupBy(*keys).agg(*partial_columns())
    return totals.withColumns({n: c(n).cast("double") for n in MONEY})


def ledger_summary_resumed(ledger: DataFrame, done: DataFrame, keys: Sequence[str] = ("run_id",)) -> DataFrame:
    """Totals without the rows of attempts that never finished (rows without an attempt stay)."""
    finished = ledger.where(c("rollout_uid").isNotNull()).join(
        done.select("rollout_uid"), "rollout_uid", "left_semi"
    )
    kept = ledger.where(c("rollout_uid").isNull()).unionByName(finished)
    return ledger_summary(kept, keys)


def spend_by_arm(ledger: DataFrame, keys: Sequence[str] = ("run_id",)) -> DataFrame:
    return (
        ledger.where(c("event").isin(fixed.SPEND_EVENTS))
        .groupBy(*keys, "arm")
        .agg(F.sum("usd").cast("double").alias("usd"))
    )


def budget_state(ledger: DataFrame, cap: float, keys: Sequence[str] = ()) -> DataFrame:
    """Spend of the counted events against a cap; ``reached`` from the cap itself on."""
    return (
        ledger.where(c("event").isin(fixed.SPEND_EVENTS))
        .groupBy(*keys)
        .agg(F.coalesce(F.sum("usd"), F.lit(0)).cast("double").alias("spent"))
        .withColumn("cap", F.lit(float(cap)))
        .withColumn("reached", c("spent") >= c("cap"))
    )
