"""Report tables: stage times, pilot costs, failure types, funnel and design costs."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from runlens import fixed
from runlens.functions.numbers import let
from runlens.operators.metrics import RUN, trials_for

c = F.col
#: Failure types that re-opening can change.
REOPENED_TYPES = (*fixed.FAILURE_TYPES, "unresolved")


def zero(column: str) -> Column:
    return F.coalesce(c(column), F.lit(0))


def attach_scores(records: DataFrame, scores: DataFrame, keys: Sequence[str]) -> DataFrame:
    """Rollout records with their score columns; NULL where a record was never scored."""
    return records.join(scores, list(keys), "left")


# ------------------------------------------------------------------ stage log


def stage_times(log: DataFrame, spans: dict[str, tuple[str, str]]) -> DataFrame:
    """Per run: seconds from the last start to the last end event of every span.

    "Last" is by ``ord`` (file order); floor 0; NULL when either event is missing.
    """
    names = sorted({e for pair in spans.values() for e in pair})
    rows = log.where(c("event").isin(names)).groupBy("run_id").agg(
        *[F.max_by(c("ts").cast("timestamp"), F.when(c("event") == e, c("ord"))).alias(f"_{e}") for e in names]
    )
    # max_by over an all-NULL ordering gives NULL, which is the missing event
    def seconds(start: str, end: str) -> Column:
        return F.greatest(F.lit(0.0), (F.unix_micros(f"_{end}") - F.unix_micros(f"_{start}")) / 1e6)

    return rows.select(
        "run_id",
        *[
            F.when(c(f"_{a}").isNotNull() & c(f"_{b}").isNotNull(), seconds(a, b)).alias(name)
            for name, (a, b) in spans.items()
        ],
    )


def stage_seconds(log: DataFrame, start: str, end: str) -> DataFrame:
    return stage_times(log, {"seconds": (start, end)})


def pilot_time(log: DataFrame, runs: DataFrame, profiles: DataFrame, replayed: DataFrame, workers: int = 4) -> DataFrame:
    """Per source: wall seconds of run, reference run, replay and diagnosis, and the rollout wall sum.

    ``runs``: source, run_id, reference_run_id; ``profiles``: source, rollouts, wall_s_total;
    ``replayed``: source, failures_replayed.
    """
    times = stage_times(log, {
        "run_wall_s": ("run_start", "run_done"),
        "replay_wall_s": ("replay_start", "replay_done"),
        "diagnosis_wall_s": ("run_done", "diagnosis_done"),
    })
    refs = times.select(c("run_id").alias("reference_run_id"), c("run_wall_s").alias("reference_wall_s"))
    return (
        runs.join(times, "run_id", "left")
        .join(refs, "reference_run_id", "left")
        .join(profiles.select("source", "rollouts", c("wall_s_total").alias("rollout_wall_sum_s")), "source", "left")
        .join(replayed, "source", "left")
        .select(
            "source", "rollouts", F.lit(workers).alias("workers"), "run_wall_s", "rollout_wall_sum_s", "reference_wall_s",
            "replay_wall_s", F.try_divide(c("replay_wall_s"), c("failures_replayed")).alias("replay_wall_s_per_failure"),
            "diagnosis_wall_s",
        )
    )


# ------------------------------------------------------------------ pilot cost


def pilot_cost(
    runs: DataFrame, references: DataFrame, failures: DataFrame, replays: DataFrame, genuineness: DataFrame
) -> DataFrame:
    """Per-source cost profile with unit costs per failed task and per replayed failure.

    ``runs`` and ``references`` are ``run_aggregate`` rows (one run per source each); ``failures``
    holds (source, task_id, family); ``replays`` (source, failure_type, usd).
    """
    failed = (
        failures.where(c("family") != "infra").groupBy("source", "task_id").agg(F.count(F.lit(1)).alias("_n"))
        .groupBy("source").agg(F.count(F.lit(1)).alias("failed_tasks"))
    )
    ref = references.select(
        "source", c("rollouts").alias("reference_rollouts"),
        (zero("policy_usd_total") + zero("judge_usd")).alias("reference_usd"), c("diagnosis_usd").alias("_ref_diag"),
    )
    replay = replays.groupBy("source").agg(
        F.count(F.lit(1)).alias("failures_replayed"), F.sum("usd").cast("double").alias("_replay"),
        *[F.count_if(c("failure_type") == x).alias(f"ft_{x}") for x in fixed.FAILURE_TYPES],
    )
    genuine = genuineness.groupBy("source").agg(F.count_if(c("verdict") == "genuine").alias("genuine_references"))
    out = runs
    for part in (failed, ref, replay, genuine):
        out = out.join(part, "source", "left")
    replay_usd, diag = zero("_replay"), zero("diagnosis_usd") + zero("_ref_diag")
    count = lambda x: zero(x).alias(x)
    return out.select(
        "source", "tasks", "rollouts",
        F.try_divide(c("passed"), c("scored")).alias("rollout_pass_rate"),
        F.try_divide(c("pass_hat_k_tasks"), c("tasks")).alias("pass_hat_k_rate"),
        "policy_usd_mean", "policy_usd_median", "policy_usd_max", zero("policy_usd_total").alias("policy_usd_total"),
        "wall_s_mean", "wall_s_median", "wall_s_max", "judge_usd", "judge_calls", "judge_cached", "harness_failures",
        count("failed_tasks"), count("reference_rollouts"), zero("reference_usd").alias("reference_usd"),
        F.try_divide(zero("reference_usd"), zero("failed_tasks")).alias("reference_usd_per_failed_task"),
        count("genuine_references"), count("failures_replayed"), replay_usd.alias("replay_usd"),
        F.try_divide(replay_usd, zero("failures_replayed")).alias("replay_usd_per_failure"),
        "replay_rollouts", diag.alias("diagnosis_usd"),
        F.try_divide(diag, zero("failures_replayed")).alias("diagnosis_usd_per_failure"),
        *[count(f"ft_{x}") for x in fixed.FAILURE_TYPES],
        "infra_failures", "usage_mismatch", "partial", "search_calls", "search_usd",
        (zero("policy_usd_total") + c("judge_usd") + zero("reference_usd") + replay_usd + diag + c("search_usd")).alias("source_total_usd"),
    )


def extrapolate_cost(
    pilot: DataFrame, times: DataFrame, heldout: int = fixed.HELDOUT_PER_SOURCE, workers: int = 4
) -> DataFrame:
    """Unit costs of the pilot times the planned sizes, one row per source and a TOTAL row.

    ``times``: source, replay_wall_s_per_failure. Units of a pilot without failures are zero.
    """
    tasks, passes = fixed.VALIDATION_TASKS_PER_SOURCE, fixed.PASSES_PLANNED
    rows = pilot.join(times.select("source", "replay_wall_s_per_failure"), "source", "left")
    rows = rows.select(
        "*",
        (trials_for(c("source")) * (tasks * passes)).cast("bigint").alias("b1_rollouts"),
        (trials_for(c("source")) * (heldout * passes)).cast("bigint").alias("b2_rollouts"),
        F.coalesce(1 - c("rollout_pass_rate"), F.lit(0.0)).alias("rollout_fail_rate"),
        F.coalesce(c("policy_usd_mean"), F.lit(0.0)).alias("_unit"),
        F.coalesce(F.try_divide(c("judge_usd"), c("rollouts")), F.lit(0.0)).alias("_judge"),
        F.coalesce(F.try_divide(c("failed_tasks"), c("tasks")), F.lit(0.0)).alias("_failed_share"),
    ).withColumns({
        "expected_failures": c("b1_rollouts") * c("rollout_fail_rate"),
        "expected_failed_tasks": F.lit(tasks * passes) * c("_failed_share"),
    }).withColumns({
        "policy_usd_b1": c("b1_rollouts") * c("_unit"),
        "policy_usd_b2": c("b2_rollouts") * c("_unit"),
        "judge_usd_est": (c("b1_rollouts") + c("b2_rollouts")) * c("_judge"),
        "reference_usd_est": c("expected_failed_tasks") * zero("reference_usd_per_failed_task"),
        "replay_usd_est": c("expected_failures") * zero("replay_usd_per_failure"),
        "diagnosis_usd_est": c("expected_failures") * zero("diagnosis_usd_per_failure"),
    })
    total = sum((c(x) for x in ("policy_usd_b2", "judge_usd_est", "reference_usd_est", "replay_usd_est", "diagnosis_usd_est")), c("policy_usd_b1"))
    wall = zero("wall_s_mean")
    hours = (
        (c("b1_rollouts") + c("b2_rollouts")) * wall / workers
        + c("expected_failures") * zero("replay_wall_s_per_failure") / workers
        + c("reference_usd_est") / F.greatest(c("_unit"), F.lit(1e-9)) * wall / workers
    ) / 3600
    rows = rows.withColumns({"total_usd": total, "wall_hours": hours})
    sums = ["b1_rollouts", "b2_rollouts", "expected_failures", "policy_usd_b1", "policy_usd_b2", "judge_usd_est",
            "reference_usd_est", "replay_usd_est", "diagnosis_usd_est", "total_usd", "wall_hours"]
    rates = ["rollout_fail_rate", "expected_failed_tasks"]
    is_total = F.grouping("source") == 1
    return rows.rollup("source").agg(
        is_total.alias("_total"), *[F.sum(x).alias(x) for x in sums],
        *[F.when(~is_total, F.max(x)).alias(x) for x in rates],
    ).withColumn("source", F.when(c("_total"), "TOTAL").otherwise(c("source"))).drop("_total")


# ------------------------------------------------------------------ failures and replays


def failure_type_counts(results: DataFrame, keys: Sequence[str] = ("source",), types: Sequence[str] = tuple(fixed.FAILURE_TYPES)) -> DataFrame:
    """Dense counts: every type appears for every source, 0 when absent."""
    counts = results.groupBy(*keys).agg(*[F.count_if(c("failure_type") == x).alias(f"_{x}") for x in types])
    rows = F.explode(F.array(*[F.struct(F.lit(x).alias("failure_type"), c(f"_{x}").alias("count")) for x in types]))
    return counts.select(*keys, rows.alias("_r")).select(*keys, "_r.*")


def reference_rates(failures: DataFrame, genuineness: DataFrame) -> DataFrame:
    """Distinct failed tasks against reference verdicts per source."""
    failed = (
        failures.where(c("family") != "infra").groupBy("source", "task_id").agg(F.count(F.lit(1)).alias("_n"))
        .groupBy("source").agg(F.count(F.lit(1)).alias("failed_tasks"))
    )
    verdicts = genuineness.groupBy("source").agg(
        F.count(F.lit(1)).alias("references"),
        *[F.count_if(c("verdict") == v).alias(v) for v in ("genuine", "shortcut", "undetermined")],
    )
    return failed.join(verdicts, "source", "full").fillna(
        0, ["failed_tasks", "references", "genuine", "shortcut", "undetermined"]
    )


def replay_table(replays: DataFrame, full_candidates: DataFrame) -> DataFrame:
    """Per source: replayed and validated failures, types, mean candidates, and the mean control
    pass fraction over full-arms candidates whose control arm ran and was scored.

    ``replays``: source, failure_type, oracle_step, candidates; ``full_candidates``: source,
    failure_key, k, ctl_passed, ctl_scored, ctl_skipped.
    """
    base = replays.groupBy("source").agg(
        F.count(F.lit(1)).alias("failures_replayed"), F.count("oracle_step").alias("oracle_validated"),
        *[F.count_if(c("failure_type") == x).alias(x) for x in fixed.FAILURE_TYPES],
        F.avg("candidates").alias("mean_candidates"),
    )
    ran = ~c("ctl_skipped") & (c("ctl_scored") > 0)
    per_failure = full_candidates.groupBy("source", "failure_key").agg(
        F.sum(F.when(ran, c("ctl_passed") / c("k"))).alias("_s"), F.count_if(ran).alias("_n")
    )
    full = per_failure.groupBy("source").agg(
        F.count(F.lit(1)).alias("full_arms_failures"),
        F.try_divide(F.sum("_s"), F.sum("_n")).alias("control_pass_fraction_mean"),
    )
    return base.join(full, "source", "left").fillna(0, ["full_arms_failures"])


def escalation_table(log: DataFrame, candidates: DataFrame) -> DataFrame:
    """Per (source, run): reopened failures and candidates, changed types and oracle steps, the
    histogram of verdict transitions, and cost.

    ``log``: source, run_id, type_before, type_after, oracle_before, oracle_after, usd;
    ``candidates``: source, run_id, before, after.
    """
    base = log.groupBy(*RUN).agg(
        F.count(F.lit(1)).alias("failures_reopened"),
        F.count_if(~c("type_before").eqNullSafe(c("type_after"))).alias("failure_type_changed"),
        F.count_if(~c("oracle_before").eqNullSafe(c("oracle_after"))).alias("oracle_step_changed"),
        F.sum("usd").cast("double").alias("usd"),
    )
    move = F.concat_ws("->", "before", "after")
    moves = candidates.groupBy(*RUN, move.alias("_m")).agg(F.count(F.lit(1)).alias("_n")).groupBy(*RUN).agg(
        F.sum("_n").alias("candidates_reopened"),
        F.concat(F.lit("{"), F.concat_ws(", ", F.array_sort(F.collect_list(
            F.concat(F.lit('"'), c("_m"), F.lit('": '), c("_n").cast("string"))))), F.lit("}")).alias("verdict_transitions"),
    )
    return base.join(moves, RUN, "left").fillna(0, ["candidates_reopened"]).fillna({"verdict_transitions": "{}"})


def histogram_text(items: Column) -> Column:
    """``item=count;...`` of an array of texts, by item; a null item reads None."""
    named = F.transform(items, lambda x: F.coalesce(x, F.lit("None")))
    return let(F.array_sort(named), lambda every: F.array_join(F.transform(F.array_distinct(every), lambda x: F.concat(
        x, F.lit("="), F.size(F.filter(every, lambda y: y == x)).cast("string"))), ";"))


def drift_table(replays: DataFrame) -> DataFrame:
    """One line per replayed failure: its verdict, how its candidates went and why replays drifted.

    ``replays``: source, failure_key, failure_type, oracle_step, oracle_step_basis, usd,
    ``candidates`` (array of structs with step, status and the arms ``substitute`` and
    ``control``, each with an array ``rollouts`` of structs with status) and ``drift_reports``
    (map of report id -> struct with an array ``drifts`` of structs with reason). Adds candidates
    (their number), statuses (``step:status;...`` in the order of the candidates),
    unreplayable_trials and drift_reasons. All of it is folded within the row.
    """
    def unreplayable(candidate: Column) -> Column:
        trials = F.concat(*[F.coalesce(candidate[arm]["rollouts"]["status"], F.array().cast("array<string>")) for arm in ("substitute", "control")])
        return F.size(F.filter(trials, lambda x: x == "unreplayable"))

    every = F.coalesce(c("candidates"), F.array())
    statuses = F.transform(every, lambda x: F.concat(x["step"].cast("string"), F.lit(":"), x["status"]))
    lost = F.aggregate(every, F.lit(0), lambda total, x: total + unreplayable(x))
    reports = F.coalesce(F.map_values("drift_reports"), F.array())
    reasons = F.flatten(F.transform(reports, lambda r: F.coalesce(r["drifts"]["reason"], F.array().cast("array<string>"))))
    return replays.select(
        "source", "failure_key", "failure_type", "oracle_step", "oracle_step_basis", F.size(every).alias("candidates"),
        F.array_join(statuses, ";").alias("statuses"), lost.alias("unreplayable_trials"),
        histogram_text(reasons).alias("drift_reasons"), c("usd").cast("double").alias("usd"))


def reopened_types(before: DataFrame, after: DataFrame, candidates: DataFrame, types: Sequence[str] = REOPENED_TYPES) -> DataFrame:
    """(source, failure_type, before, after): failures per type before and after marginal verdicts were re-opened.

    ``before`` and ``after``: source, run_id, failure_key, failure_type; a run without earlier
    results counts with its present ones on both sides, one without present results not at all.
    Two more lines per source count the candidates (source, run_id, status, confirmed) that were
    tried: confirmed ones, and those left at the fixed number of trials; their ``before`` is NULL.
    """
    present = after.select(*RUN).distinct()
    older = before.join(present, RUN, "left_semi")
    unchanged = after.join(before.select(*RUN).distinct(), RUN, "left_anti")
    earlier = older.select(*RUN, "failure_type").unionByName(unchanged.select(*RUN, "failure_type"))
    marked = earlier.select("source", "failure_type", F.lit("before").alias("_side")).unionByName(
        after.select("source", "failure_type", F.lit("after").alias("_side")))
    counts = marked.groupBy("source").agg(*[
        F.count_if((c("failure_type") == x) & (c("_side") == side)).alias(f"_{x}_{side}") for x in types for side in ("before", "after")])
    tried = candidates.where(~c("status").isin("skipped", "unreplayable")).join(present, RUN, "left_semi").groupBy("source").agg(
        F.count_if(F.coalesce(c("confirmed"), F.lit(False))).alias("_yes"), F.count_if(~F.coalesce(c("confirmed"), F.lit(False))).alias("_no"))

    def line(name: str, first: Column, second: Column) -> Column:
        return F.struct(F.lit(name).alias("failure_type"), first.cast("long").alias("before"), second.cast("long").alias("after"))

    lines = [line(x, c(f"_{x}_before"), c(f"_{x}_after")) for x in types]
    lines += [line(name, F.lit(None), F.coalesce(c(flag), F.lit(0))) for name, flag in
              (("candidates_confirmed_n>=5", "_yes"), ("candidates_unconfirmed_fixed_k", "_no"))]
    return counts.join(tried, "source", "left").select("source", F.explode(F.array(*lines)).alias("_l")).select("source", "_l.*")


def failure_priority(failures: DataFrame) -> DataFrame:
    """Adds ``priority``: how often the failure's task failed over all passes (sort by it descending)."""
    counts = failures.groupBy("task_id").agg(F.count(F.lit(1)).alias("priority"))
    return failures.join(counts, "task_id")


# ------------------------------------------------------------------ funnel


def measurability_funnel(
    rollouts: DataFrame, failures: DataFrame, genuineness: DataFrame, replays: DataFrame, clusters: DataFrame, assignments: DataFrame
) -> DataFrame:
    """17 counts per source from rollouts to feasible arms.

    ``replays``: source, failure_type, has_positive, has_unresolved (one bucket per failure:
    unreplayable, positive, unresolved, negative); ``clusters``: source, members;
    ``assignments``: source, arm, impossible.
    """
    n = F.count(F.lit(1))
    harness = failures.where(c("family") != "infra").groupBy("source", "task_id").agg(n.alias("_n"))
    dead = c("failure_type") == "unreplayable"
    positive = ~dead & c("has_positive")
    open_ = ~dead & ~c("has_positive") & c("has_unresolved")
    parts = [
        harness.groupBy("source").agg(F.sum("_n").alias("failed_rollouts"), n.alias("failed_tasks")),
        genuineness.groupBy("source").agg(F.count_if(c("verdict") == "genuine").alias("genuine_references")),
        replays.groupBy("source").agg(
            n.alias("replayable"), F.count_if(positive).alias("validated_positive"),
            F.count_if(~dead & ~c("has_positive") & ~c("has_unresolved")).alias("validated_negative"),
            F.count_if(open_).alias("unresolved"), F.count_if(dead).alias("unreplayable"),
        ),
        clusters.groupBy("source").agg(n.alias("clusters"), F.count_if(c("members") >= 2).alias("clusters_ge2")),
        assignments.groupBy("source").agg(
            *[F.count_if((c("arm") == a) & c("impossible").isNull()).alias("feasible_" + a.replace("corrupt_", "")) for a in fixed.FUNNEL_ARMS]
        ),
    ]
    out = rollouts.groupBy("source").agg(n.alias("rollouts"))
    for part in parts:
        out = out.join(part, "source", "left")
    return out.fillna(0)


# ------------------------------------------------------------------ design costs


def seed_runs_cost(heldout: DataFrame, mining: DataFrame) -> DataFrame:
    """Per source: mean spend of a held-out pass and mean cost of a diagnosis call.

    Both are ledgers with source, run_id, event, arm, usd.
    """
    passes = heldout.groupBy(*RUN).agg(F.sum("usd").alias("_u")).groupBy("source").agg(
        (F.sum("_u").cast("double") / F.count(F.lit(1))).alias("pass_usd")
    )
    calls = mining.where((c("event") == "call") & (c("arm") == "diagnosis")).groupBy("source").agg(
        (F.sum("usd").cast("double") / F.count(F.lit(1))).alias("call_usd")
    )
    return passes.join(calls, "source", "full")


def design_costs(
    costs: DataFrame, effects: DataFrame, ns: Sequence[int] = (7, 8, 10, 14), ks: Sequence[int] = (3, 5), passes: Sequence[int] = (1, 2),
    arms: int = fixed.THRESHOLDS["e2_arms_m32"], meaningful: float = fixed.THRESHOLDS["delta_meaningful_points"],
) -> DataFrame:
    """Cost of every design (N, k, passes) per source, with its smallest detectable effect.

    ``costs`` come from ``seed_runs_cost``; ``effects``: source, n, k, passes, mde. The grid is a
    parameter and is exploded from a literal. A source without pass costs has NULL costs.
    """
    grid = F.explode(F.array(*[
        F.struct(F.lit(n).alias("n"), F.lit(k).alias("k"), F.lit(p).alias("passes")) for n in ns for k in ks for p in passes
    ]))
    rows = costs.select("source", "pass_usd", "call_usd", grid.alias("g")).select("source", "pass_usd", "call_usd", "g.*")
    rows = rows.join(effects, ["source", "n", "k", "passes"], "left")
    cost = F.lit(arms) * c("n") * c("k") * (zero("call_usd") + c("passes") * c("pass_usd"))
    return rows.select(
        "source", "n", "k", "passes", "mde", cost.alias("cost_usd"),
        F.coalesce(c("mde") <= meaningful, F.lit(False)).alias("meets_threshold"),
    )


def mde_choice(designs: DataFrame, budget: float | None, meaningful: float = fixed.THRESHOLDS["delta_meaningful_points"]) -> DataFrame:
    """One design per source: the cheapest within budget and target, else the smallest effect
    within budget, else the cheapest. Designs without an effect are no candidates."""
    cost = F.coalesce(c("cost_usd"), F.lit(0.0))
    within = F.lit(True) if budget is None else c("cost_usd").isNull() | (c("cost_usd") <= budget)
    tier = F.when(within & (c("mde") <= meaningful), 0).when(within, 1).otherwise(2)
    key = F.struct(
        tier.alias("tier"),
        F.when(tier == 1, c("mde")).otherwise(cost).alias("a"),
        F.when(tier == 0, F.lit(0.0)).when(tier == 1, cost).otherwise(c("mde")).alias("b"),
        "n", "k", "passes", "mde", "cost_usd",
    )
    best = designs.where(c("mde").isNotNull()).groupBy("source").agg(F.min(key).alias("_b"))
    choice = F.format_string("N=%d k=%d passes=%d", c("_b.n"), c("_b.k"), c("_b.passes"))
    return best.select(
        "source", choice.alias("choice"), "_b.mde", "_b.cost_usd",
        (c("_b.tier") == 0).alias("meets_d8"), (c("_b.tier") < 2).alias("within_budget"),
    )


# ------------------------------------------------------------------ parity tables


def parity_table(pooled: DataFrame) -> DataFrame:
    """The final round per source with its status text."""
    return pooled.select(
        "source", "rounds", "final_generation_seed", "n", "mean_difference", "reference_higher", "coherent_higher",
        "ties", "sign_test_p", F.when(c("ok"), "ok").otherwise("PERSISTENT VIOLATION").alias("status"),
    )


def coherent_table(generated: DataFrame, scores: DataFrame, pooled: DataFrame) -> DataFrame:
    """Every generated diagnosis of the final round of its source, with its scores where it has any.

    ``generated``: source, run_id, cluster_id, decoy_component, decoy_step, step_basis, cause_label,
    severity, generation_seed; ``scores``: source, cluster_id, generation_seed, reference_score,
    coherent_score, error. A diagnosis without a score row is kept with NULL scores.
    """
    final = pooled.select("source", c("final_generation_seed").alias("generation_seed"))
    kept = generated.join(final, ["source", "generation_seed"], "left_semi")
    given = scores.select("source", "cluster_id", "generation_seed", "reference_score", "coherent_score", "error")
    return kept.join(given, ["source", "cluster_id", "generation_seed"], "left").select(
        "source", "run_id", "cluster_id", "decoy_component", "decoy_step", "step_basis", "cause_label", "severity",
        "generation_seed", "reference_score", "coherent_score", "error")
