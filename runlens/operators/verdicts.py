"""Verdicts on divergence candidates from repeated trials.

All stages of the schedule are conditional counts of one aggregation per (failure, step), so a
candidate's trials are never collected or replicated per stage.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from runlens import fixed

c = F.col
EPS = fixed.EPS
CANDIDATE = ["failure_key", "step"]


def decide(p_sub: Column, p_ctl: Column) -> Column:
    """positive / negative / undecided from the pass fractions of one stage."""
    d = p_sub - p_ctl
    positive = (
        (p_sub + EPS >= fixed.POSITIVE_SUB_MIN)
        & (p_ctl <= fixed.POSITIVE_CTL_MAX + EPS)
        & (d + EPS >= fixed.POSITIVE_D_MIN)
    )
    negative = (p_sub <= fixed.NEGATIVE_SUB_MAX + EPS) | (d <= fixed.NEGATIVE_D_MAX + EPS)
    return F.when(positive, "positive").when(negative, "negative").otherwise("undecided")


def arm_stats(trials: DataFrame, keys: Sequence[str] = tuple(CANDIDATE)) -> DataFrame:
    """Counts per arm with the pass fraction (unscored = non-pass) and the held fraction
    ((passed + unscored) / k, what a control arm is held to)."""
    def status(*names: str) -> Column:
        return F.count_if(c("status").isin(list(names)))

    out = trials.groupBy(*keys, "arm").agg(
        F.count(F.lit(1)).alias("k"),
        status("passed").alias("passed"),
        status("passed", "failed").alias("scored"),
        status("unreplayable").alias("unreplayable"),
        status("infra").alias("infra"),
        status("inapplicable").alias("inapplicable"),
    )
    return out.withColumn("pass_fraction", c("passed") / c("k")).withColumn(
        "held_fraction", (c("passed") + c("k") - c("scored")) / c("k")
    )


def trial_stages(trials: DataFrame, schedule: Sequence[int] = tuple(fixed.SCHEDULE)) -> DataFrame:
    """Per candidate and stage n: counts over the first n trials of each arm, as columns
    ``sub_<n>``, ``sub_passed_<n>``, ``sub_unreplayable_<n>``, ``ctl_<n>``, ``ctl_passed_<n>``, ``ctl_scored_<n>``."""
    aggs = []
    for n in schedule:
        sub = (c("arm") == "substitute") & (c("idx") <= n)
        ctl = (c("arm") == "control") & (c("idx") <= n)
        passed, scored = c("status") == "passed", c("status").isin("passed", "failed")
        aggs += [
            F.count_if(sub).alias(f"sub_{n}"),
            F.count_if(sub & passed).alias(f"sub_passed_{n}"),
            F.count_if(sub & (c("status") == "unreplayable")).alias(f"sub_unreplayable_{n}"),
            F.count_if(ctl).alias(f"ctl_{n}"),
            F.count_if(ctl & passed).alias(f"ctl_passed_{n}"),
            F.count_if(ctl & scored).alias(f"ctl_scored_{n}"),
        ]
    return trials.groupBy(*CANDIDATE).agg(*aggs)


def schedule_verdicts(
    trials: DataFrame, schedule: Sequence[int] = tuple(fixed.SCHEDULE), economize: bool = True
) -> DataFrame:
    """(failure_key, step, verdict, n, confirmed, control_skipped) of the adaptive schedule.

    A stage is evaluated where its trials exist. The first stage from n = 5 on with a decision
    confirms. With ``economize`` the control arm is skipped while the substitute arm passes at
    most 40% up to n = 5. All first-stage substitutes unreplayable: unreplayable. A schedule
    that ends without a confirmed decision keeps its last one unconfirmed, or is unresolved.
    NULL verdict: fewer trials than the first stage needs.
    """
    first = schedule[0]
    rows = trial_stages(trials, schedule)
    skip, available = F.lit(economize), F.lit(True)
    stages: list[tuple[int, str, str]] = []
    for n in schedule:
        p_sub = c(f"sub_passed_{n}") / F.lit(n)
        p_ctl = (c(f"ctl_passed_{n}") + F.lit(n) - c(f"ctl_scored_{n}")) / F.lit(n)
        low = p_sub <= fixed.NEGATIVE_SUB_MAX + EPS
        skip = (skip & low) if n <= fixed.CONFIRM_N else F.lit(False)
        rows = rows.withColumn(f"_skip_{n}", skip)
        here = (c(f"sub_{n}") >= n) & (c(f"_skip_{n}") | (c(f"ctl_{n}") >= n))
        available = available & here
        rows = rows.withColumn(f"_ok_{n}", available)
        rows = rows.withColumn(
            f"_d_{n}",
            F.when(c(f"_ok_{n}"), F.when(c(f"_skip_{n}"), "control_skipped").otherwise(decide(p_sub, p_ctl))),
        )
        stages.append((n, f"_d_{n}", f"_ok_{n}"))
        skip, available = c(f"_skip_{n}"), c(f"_ok_{n}")
    unreplayable = (c(f"sub_{first}") >= first) & (c(f"sub_unreplayable_{first}") == first)
    stop_n = F.when(unreplayable, F.lit(first))
    for n, d, _ in stages:
        if n >= fixed.CONFIRM_N:
            stop_n = stop_n.when(c(d).isin("positive", "negative", "control_skipped"), n)
    last_n = F.lit(None).cast("int")
    for n, _, ok in stages:
        last_n = F.when(c(ok), n).otherwise(last_n)
    rows = rows.withColumn("_stop", stop_n).withColumn("n", F.coalesce(c("_stop"), last_n))
    decision = F.lit(None).cast("string")
    for n, d, _ in stages:
        decision = F.when(c("n") == n, c(d)).otherwise(decision)
    verdict = (
        F.when(unreplayable, "unreplayable")
        .when(decision.isin("positive", "negative"), decision)
        .when(decision == "control_skipped", "negative")
        .when(decision == "undecided", "unresolved")
    )
    rows = rows.withColumn("verdict", verdict).withColumn("control_skipped", F.coalesce(decision == "control_skipped", F.lit(False)))
    confirmed = c("_stop").isNotNull() | (c("n") >= fixed.SCHEDULE[-1]) | (
        (c("n") >= fixed.CONFIRM_N) & (c("verdict") != "unresolved"))
    return rows.select(
        *CANDIDATE, "verdict", "n", F.coalesce(confirmed, F.lit(False)).alias("confirmed"), "control_skipped"
    )


def _fractions() -> tuple[Column, Column]:
    p_sub = F.try_divide(c("sub_passed"), c("k"))
    p_ctl = F.try_divide(c("ctl_passed") + c("k") - c("ctl_scored"), c("k"))
    return F.coalesce(p_sub, F.lit(0.0)), F.coalesce(p_ctl, F.lit(0.0))


def legacy_verdict() -> Column:
    """Verdict of a candidate: the recorded one, else from fixed-k counts with the same thresholds."""
    p_sub, p_ctl = _fractions()
    decision = decide(p_sub, p_ctl)
    return (
        F.when(c("verdict").isNotNull(), c("verdict"))
        .when(c("status") == "skipped", "skipped")
        .when(c("status") == "unreplayable", "unreplayable")
        .when(c("ctl_skipped"), F.when(p_sub <= fixed.NEGATIVE_SUB_MAX + EPS, "negative").otherwise("unresolved"))
        .when(decision == "undecided", "unresolved")
        .otherwise(decision)
    )


def legacy_verdicts(candidates: DataFrame) -> DataFrame:
    return candidates.withColumn("verdict", legacy_verdict())


def needs_escalation(candidates: DataFrame) -> DataFrame:
    """Marginal fixed-k candidates to re-open: substitute 2 of 3, control held 1 of 3 with
    substitute >= 2, or undecided under the thresholds."""
    p_sub, p_ctl = _fractions()
    held = c("ctl_passed") + c("k") - c("ctl_scored")
    marginal = (c("sub_passed") == 2) | (
        ~c("ctl_skipped") & (((held == 1) & (c("sub_passed") >= 2)) | (decide(p_sub, p_ctl) == "undecided"))
    )
    return candidates.where(
        c("verdict").isNull() & ~c("status").isin("skipped", "unreplayable") & (c("k") == 3) & marginal
    )


def unconfirmed(candidates: DataFrame) -> DataFrame:
    """Scorable candidates whose verdict was not confirmed at n >= 5."""
    return candidates.where(~c("status").isin("skipped", "unreplayable") & ~c("confirmed"))


def confirm_targets(members: DataFrame, candidates: DataFrame, oracle: DataFrame, min_members: int) -> DataFrame:
    """(run_id, failure_key, step) to confirm for clusters with enough members over all passes.

    Representatives: all unconfirmed candidates; other members: the unconfirmed one at the
    oracle step. ``members``: cause_label, component, run_id, failure_key, is_representative.
    """
    key = ["cause_label", "component"]
    big = members.groupBy(*key).agg(F.count(F.lit(1)).alias("_n")).where(c("_n") >= min_members).select(*key)
    rows = members.join(big, key, "left_semi").select("run_id", "failure_key", "is_representative")
    rows = rows.join(oracle.select("failure_key", "oracle_step"), "failure_key", "left")
    open_ = unconfirmed(candidates).select("failure_key", "step")
    return (
        rows.join(open_, "failure_key")
        .where(c("is_representative") | (c("step") == c("oracle_step")))
        .select("run_id", "failure_key", "step")
        .distinct()
    )


def failure_type(candidates: DataFrame, keys: Sequence[str] = ("failure_key",)) -> DataFrame:
    """Failure type from candidate verdicts, in order of precedence."""
    rows = candidates.withColumn("_v", legacy_verdict())
    live = c("status") != "skipped"
    control = live & ~c("ctl_skipped") & (c("ctl_scored") > 0)
    flags = rows.groupBy(*keys).agg(
        F.count_if(live & (c("status") != "unreplayable")).alias("_live"),
        F.count_if(live & (c("_v") == "positive")).alias("_pos"),
        F.count_if(live & (c("_v") == "unresolved")).alias("_open"),
        F.count_if(control).alias("_ctl"),
        F.count_if(control & (c("ctl_passed") / c("k") > fixed.CONTROL_MAX)).alias("_ctl_high"),
        F.min(F.when(live & (c("_v") == "positive"), c("step"))).alias("_first_positive"),
        F.max(F.when(c("divergence") != "argument_variant", c("step"))).alias("_last_class"),
        F.max("step").alias("_last_any"),
    )
    kind = (
        F.when(c("_live") == 0, "unreplayable")
        .when(c("_pos") > 0, "deterministic")
        .when(c("_open") > 0, "unresolved")
        .when(c("_ctl") == 0, "unreplayable")
        .when(c("_ctl_high") == c("_ctl"), "stochastic")
        .otherwise("unrepairable")
    )
    return flags.withColumn("failure_type", kind)


def oracle_step(candidates: DataFrame, keys: Sequence[str] = ("failure_key",)) -> DataFrame:
    """Failure type, oracle step and its basis.

    Deterministic: the earliest positive step. Stochastic: the manifestation step, which is the
    last class divergence, else the last candidate. Candidates run by step within each kind, so
    the last one is the one with the largest step.
    """
    typed = failure_type(candidates, keys)
    manifestation = F.coalesce("_last_class", "_last_any")
    step = F.when(c("failure_type") == "deterministic", c("_first_positive")).when(
        c("failure_type") == "stochastic", manifestation
    )
    basis = (
        F.when(c("failure_type") == "deterministic", "sufficient")
        .when((c("failure_type") == "stochastic") & manifestation.isNotNull(), "manifestation")
        .otherwise("unvalidated")
    )
    return typed.select(
        *keys, "failure_type", manifestation.alias("manifestation_step"), step.alias("oracle_step"), basis.alias("oracle_step_basis")
    )
