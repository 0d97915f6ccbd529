"""Pass metrics and per-run profiles."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from runlens import fixed
from runlens.functions import scale

c = F.col
RUN = ["source", "run_id"]


def final_attempts(rollouts: DataFrame, keys: Sequence[str] = ("source", "run_id", "task_id", "replicate")) -> DataFrame:
    """The last attempt of every replicate.

    The filter on rank 1 lets Spark cut every key to one row per partition before the shuffle.
    """
    w = Window.partitionBy(*keys).orderBy(c("attempt").desc())
    return rollouts.withColumn("_rn", F.row_number().over(w)).where(c("_rn") == 1).drop("_rn")


def trials_for(source: Column) -> Column:
    """Benchmark trial count of a source."""
    out = F.lit(fixed.DEFAULT_TRIALS)
    for name, trials in fixed.TRIALS_BY_SOURCE.items():
        out = F.when(source == name, trials).otherwise(out)
    return out


def task_results(rollouts: DataFrame, k: int) -> DataFrame:
    """One row per (source, run, task) over final attempts; an unscored replicate is a non-pass."""
    passed = F.coalesce(c("passed"), F.lit(False))
    return (
        final_attempts(rollouts)
        .groupBy(*RUN, "task_id")
        .agg(
            F.count(F.lit(1)).alias("replicates"),
            (F.bool_and(passed) & (F.count(F.lit(1)) == k)).alias("pass_hat_k"),
            F.bool_or(passed).alias("pass_at_k"),
            F.avg("value").alias("mean_value"),
            F.count("passed").alias("scored"),
            F.count_if(passed).alias("passed"),
            F.count_if(c("error_family") == "infra").alias("infra"),
            F.count_if(c("error_family") == "budget").alias("budget"),
            F.count("task_failure").alias("task_failures"),
        )
        .withColumn("k", F.lit(k))
        .withColumn("benchmark_k", trials_for(c("source")))
        .withColumn("benchmark_valid", c("k") == c("benchmark_k"))
    )


def run_summary(results: DataFrame) -> DataFrame:
    """Per (run, source) rates over task results."""
    n = F.count(F.lit(1))
    return results.groupBy(*RUN).agg(
        n.alias("tasks"),
        F.bool_and("benchmark_valid").alias("benchmark_valid"),
        (F.count_if("pass_hat_k") / n).alias("pass_hat_k_rate"),
        (F.count_if("pass_at_k") / n).alias("pass_at_k_rate"),
        (F.sum("passed") / F.greatest(F.lit(1), F.sum("scored"))).alias("rollout_pass_rate"),
        (F.coalesce(F.sum("mean_value"), F.lit(0.0)) / F.greatest(F.lit(1), F.count("mean_value"))).alias("mean_value"),
        F.sum("infra").alias("infra_rollouts"),
        F.sum("budget").alias("budget_rollouts"),
        F.sum("task_failures").alias("task_failure_rollouts"),
    )


def source_metrics(tasks: DataFrame, scores: DataFrame) -> DataFrame:
    """Per-source pass rate and mean value of one score per task; unknown task ids are an error."""
    known = tasks.select("task_id", "source")
    joined = scores.join(known, "task_id", "left").withColumn(
        "source",
        F.coalesce(
            c("source"),
            F.raise_error(F.concat(F.lit("score for unknown task id: "), c("task_id").cast("string"))),
        ),
    )
    n = F.count(F.lit(1))
    return joined.groupBy("source").agg(
        n.alias("n"),
        F.count_if("passed").alias("passed"),
        (F.count_if("passed") / n).alias("pass_rate"),
        F.avg("value").alias("mean_value"),
        F.count("task_failure").alias("task_failures"),
    )


def macro_rate(metrics: DataFrame, weights: DataFrame | None = None) -> DataFrame:
    """Weighted mean of the source rates; equal weights without a table, a missing one is an error."""
    if weights is None:
        weighted = metrics.withColumn("weight", F.lit(1.0))
    else:
        weighted = metrics.join(weights.select("source", "weight"), "source", "left").withColumn(
            "weight",
            F.coalesce(c("weight"), F.raise_error(F.concat(F.lit("macro weight missing: "), c("source")))),
        )
    return weighted.agg(
        F.sum("n").alias("n_scored"),
        F.try_divide(F.sum(c("pass_rate") * c("weight")), F.sum("weight")).alias("macro"),
    )


def counts_by(tasks: DataFrame, column: str) -> DataFrame:
    return tasks.groupBy(column).agg(F.count(F.lit(1)).alias("tasks"))


def dist_stats(df: DataFrame, keys: Sequence[str], values: dict[str, str]) -> DataFrame:
    """Mean, exact median, maximum and total of each value; groups without values keep NULLs.

    ``values`` maps a column prefix to a value column.
    """
    basic = df.groupBy(*keys).agg(*[
        agg
        for prefix, value in values.items()
        for agg in (
            F.try_divide(F.sum(value).cast("double"), F.count(value)).alias(f"{prefix}_mean"),
            F.max(value).cast("double").alias(f"{prefix}_max"),
            F.sum(value).cast("double").alias(f"{prefix}_total"),
        )
    ])
    return basic.join(medians(df, keys, values), list(keys), "left")


def medians(df: DataFrame, keys: Sequence[str], values: dict[str, str]) -> DataFrame:
    """Exact medians ``<prefix>_median`` of several value columns in one pass over stacked values."""
    stacked = df.select(*keys, F.explode(F.array(*[
        F.struct(F.lit(prefix).alias("_name"), c(value).cast("double").alias("_value")) for prefix, value in values.items()
    ])).alias("_s")).select(*keys, "_s.*")
    mid = scale.exact_quantiles(stacked, [*keys, "_name"], "_value", scale.median_picks("_m"))
    return mid.groupBy(*keys).agg(*[
        F.max(F.when(c("_name") == prefix, (c("_m_lo") + c("_m_hi")) / 2)).alias(f"{prefix}_median") for prefix in values
    ])


def kind_histogram(df: DataFrame, keys: Sequence[str], kind: str, name: str) -> DataFrame:
    """Counts per kind as sorted JSON text; only the (short) list of kinds is collected."""
    item = F.concat(F.lit('"'), c(kind), F.lit('": '), c("_n").cast("string"))
    return (
        df.groupBy(*keys, kind)
        .agg(F.count(F.lit(1)).alias("_n"))
        .groupBy(*keys)
        .agg(F.array_sort(F.collect_list(F.struct(c(kind).alias("k"), item.alias("t")))).alias("_l"))
        .withColumn(name, F.concat(F.lit("{"), F.concat_ws(", ", c("_l.t")), F.lit("}")))
        .drop("_l")
    )


def _grains(rollouts: DataFrame, values: dict[str, str]) -> DataFrame:
    """Rollouts counted per (run, task), and infra failures per (run, kind), in one pass.

    ``_grain`` is 0 for the rows of a task and 1 for those of a kind.
    """
    infra = c("error_family") == "infra"
    rows = rollouts.select(
        *RUN, "task_id", "passed", "search_calls", "partial", "error_kind", *values.values(),
        infra.alias("_infra"), F.when(infra, F.coalesce(c("error_kind"), F.lit("infra"))).alias("_kind"))
    task, kind = [c(x) for x in (*RUN, "task_id")], [c(x) for x in (*RUN, "_kind")]
    return rows.groupingSets([task, kind], *[c(x) for x in (*RUN, "task_id", "_kind")]).agg(
        F.grouping("task_id").cast("int").alias("_grain"),
        F.count(F.lit(1)).alias("rollouts"),
        F.count("passed").alias("scored"),
        F.count_if(F.coalesce(c("passed"), F.lit(False))).alias("passed"),
        F.sum("search_calls").alias("search_calls"),
        F.count_if(c("error_kind") == "usage_mismatch").alias("usage_mismatch"),
        F.count_if("partial").alias("partial"),
        F.count_if("_infra").alias("_infra"),
        *[agg for prefix, value in values.items() for agg in (
            F.sum(value).alias(f"_{prefix}_sum"), F.count(value).alias(f"_{prefix}_n"), F.max(value).alias(f"_{prefix}_max"))],
    )


def run_costs(rollouts: DataFrame, ledger: DataFrame | None = None, failures: DataFrame | None = None,
              tasks: DataFrame | None = None) -> DataFrame:
    """One profile row per (source, run) without medians: counts, costs, wall clocks and failures.

    ``tasks`` holds (source, run_id, task_id, pass_hat_k). Each table is read once. The rows of all
    of them, rollouts already counted per task and kind, meet in one aggregation per run. What
    comes from a table that is left out is zero.
    """
    values = {"policy_usd": "usd", "wall_s": "duration_seconds"}
    rows = _grains(rollouts, values).drop("task_id")
    empty = F.lit(None)
    money = empty.cast("decimal(18,6)")
    rows = rows.withColumns({"_hat": empty.cast("boolean"), "event": empty.cast("string"), "arm": empty.cast("string"),
                             "cached": empty.cast("boolean"), "_usd": money, "family": empty.cast("string")})
    given = []
    if tasks is not None:
        given.append(tasks.select(*RUN, c("pass_hat_k").alias("_hat")))
    if ledger is not None:
        given.append(ledger.select(*RUN, "event", "arm", "cached", c("usd").alias("_usd")))
    if failures is not None:
        given.append(failures.select(*RUN, "family"))
    for part in given:
        rows = rows.unionByName(part, allowMissingColumns=True)
    call, policy, per_task = c("event") == "call", c("event") == "policy", c("_grain") == 0
    judge, other = call & (c("arm") == "judge"), c("family") != "infra"
    of_task = lambda x: F.when(per_task, c(x))
    spent = lambda when: F.coalesce(F.sum(F.when(when, c("_usd"))), F.lit(0)).cast("double")
    kinds = F.array_sort(F.collect_list(F.when((c("_grain") == 1) & (c("_infra") > 0), F.struct(c("_kind").alias("k"), c("_infra").alias("n")))))
    listed = F.transform(kinds, lambda x: F.concat(F.lit('"'), x["k"], F.lit('": '), x["n"].cast("string")))
    return rows.groupBy(*RUN).agg(
        F.count_if(per_task).alias("tasks"),
        *[F.sum(of_task(x)).alias(x) for x in ("rollouts", "scored", "passed", "search_calls", "usage_mismatch", "partial")],
        *[agg for prefix in values for agg in (
            F.try_divide(F.sum(of_task(f"_{prefix}_sum")).cast("double"), F.sum(of_task(f"_{prefix}_n"))).alias(f"{prefix}_mean"),
            F.max(of_task(f"_{prefix}_max")).cast("double").alias(f"{prefix}_max"),
            F.sum(of_task(f"_{prefix}_sum")).cast("double").alias(f"{prefix}_total"))],
        F.count_if("_hat").alias("pass_hat_k_tasks"),
        spent(judge).alias("judge_usd"),
        F.count_if(judge).alias("judge_calls"),
        F.count_if(judge & c("cached")).alias("judge_cached"),
        spent(call & (c("arm") == "diagnosis")).alias("diagnosis_usd"),
        spent(policy & (c("arm") == "replay")).alias("replay_usd"),
        F.count_if(policy & (c("arm") == "replay")).alias("replay_rollouts"),
        spent(c("event") == "search").alias("search_usd"),
        F.count_if(other).alias("harness_failures"),
        F.count_if(~other).alias("infra_failures"),
        F.count_if(c("family") == "budget").alias("budget_failures"),
        F.concat(F.lit("{"), F.array_join(listed, ", "), F.lit("}")).alias("infra"),
    ).where(c("tasks") > 0)


def run_aggregate(rollouts: DataFrame, ledger: DataFrame, failures: DataFrame, tasks: DataFrame) -> DataFrame:
    """``run_costs`` with the exact medians of policy cost and wall clock."""
    costs = run_costs(rollouts, ledger, failures, tasks)
    return costs.join(medians(rollouts, RUN, {"policy_usd": "usd", "wall_s": "duration_seconds"}), RUN, "left")


def baseline_table(rollouts: DataFrame, k: int) -> DataFrame:
    """Per (source, run): tasks, rollouts, rollout pass rate and pass^k rate.

    Tasks and rollouts count every attempt; the rollout rate has the scored attempts below it.
    """
    totals = rollouts.groupBy(*RUN).agg(
        F.count(F.lit(1)).alias("rollouts"),
        F.try_divide(F.count_if(F.coalesce(c("passed"), F.lit(False))), F.count("passed")).alias("rollout_pass_rate"),
    )
    rates = task_results(rollouts, k).groupBy(*RUN).agg(
        F.count(F.lit(1)).alias("tasks"),
        (F.count_if("pass_hat_k") / F.count(F.lit(1))).alias("pass_hat_k_rate"),
    )
    return rates.join(totals, RUN).select(*RUN, "tasks", "rollouts", "rollout_pass_rate", "pass_hat_k_rate")


def cost_table(runs: DataFrame) -> DataFrame:
    """Unit costs per run from ``run_costs`` rows."""
    total = sum((F.coalesce(c(x), F.lit(0.0)) for x in ("judge_usd", "replay_usd", "diagnosis_usd", "search_usd")),
                F.coalesce(c("policy_usd_total"), F.lit(0.0)))
    return runs.select(
        *RUN,
        "rollouts",
        F.try_divide(F.coalesce(c("policy_usd_total"), F.lit(0.0)), c("rollouts")).alias("policy_usd_per_rollout"),
        F.try_divide(c("judge_usd"), c("rollouts")).alias("judge_usd_per_rollout"),
        "replay_usd", "diagnosis_usd", "search_usd",
        total.alias("total_usd"),
    )


def infra_table(runs: DataFrame) -> DataFrame:
    return runs.select(*RUN, "infra_failures", "infra", "usage_mismatch", "partial", "budget_failures")


def cost_per_rollout(costs: DataFrame) -> DataFrame:
    """Mean policy + judge unit cost over the seed-like runs (reference runs end in ``-ref``)."""
    unit = c("policy_usd_per_rollout") + c("judge_usd_per_rollout")
    return costs.where(~c("run_id").endswith("-ref") & unit.isNotNull()).agg(F.avg(unit).alias("cost_per_rollout"))
