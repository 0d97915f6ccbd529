"""Rule-based component attribution of divergences, and the rule without a reference."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from runlens import fixed
from runlens.functions import scale

c = F.col


def component_table(spark: SparkSession) -> DataFrame:
    """The fixed component dimension with each component's activity rule."""
    rows = [
        (name, layer, patchable, eligible, files, fixed.ACTIVITY_RULES.get(name, "every"), i)
        for i, (name, layer, patchable, eligible, files) in enumerate(fixed.COMPONENTS)
    ]
    return spark.createDataFrame(
        rows,
        "component string, layer string, patchable boolean, where_eligible boolean, files array<string>, "
        "activity string, position int",
    )


def rule_table(spark: SparkSession) -> DataFrame:
    """rule -> note and the candidate components that are eligible and patchable."""
    allowed = {n for n, _, patchable, eligible, _ in fixed.COMPONENTS if patchable and eligible}
    rows = [
        (rule, [x for x in names if x in allowed], fixed.RULE_NOTES[rule])
        for rule, names in fixed.RULE_COMPONENTS.items()
    ]
    return spark.createDataFrame(rows, "rule string, candidate_components array<string>, rule_note string")


def _chain(rules: list[tuple[Column, str]], last: str) -> Column:
    out = F.when(rules[0][0], rules[0][1])
    for cond, rule in rules[1:]:
        out = out.when(cond, rule)
    return out.otherwise(last)


def prior_observation(candidates: DataFrame, observations: DataFrame) -> DataFrame:
    """Adds ``prior_result``: the last observation before the divergence step (NULL: none).

    ``observations``: pair_id, step, ord, result (a struct or a text).
    """
    return scale.prior_value(candidates, observations, ["pair_id"], "step", "ord", "result")


def unsupported_answer(answers: DataFrame, observations: DataFrame, key: str = "pair_id") -> DataFrame:
    """(key, unsupported): the first answer holds numbers and no observation contains any of them.

    ``answers``: key, answer and, where there may be several, step and idx (the first counts). A
    number starts with a digit and goes on with digits, points and commas, so it can only stand
    inside such a stretch of an observation: each observation is cut down to its different
    stretches before it is joined, once, to the numbers of its run.
    """
    order = [c(x) for x in ("step", "idx") if x in answers.columns]
    first = answers.groupBy(key).agg(F.min(F.struct(*order, F.coalesce(c("answer"), F.lit("")).alias("answer"))).alias("_a"))
    numbers = first.select(
        key, F.array_distinct(F.regexp_extract_all("_a.answer", F.lit(f"(?U)({fixed.ANSWER_NUMBER})"), F.lit(1))).alias("_numbers"))
    stretches = F.array_distinct(F.regexp_extract_all("text", F.lit(r"(?U)([\d.,]+)"), F.lit(1)))
    digits = observations.select(key, F.array_join(F.filter(stretches, lambda x: x.rlike(r"(?U)\d")), " ").alias("_digits"))
    seen = (
        digits.where(c("_digits") != "")
        .join(numbers.where(F.size("_numbers") > 0), key)
        .where(F.exists("_numbers", lambda n: c("_digits").contains(n)))
        .select(key).distinct().withColumn("_seen", F.lit(True))
    )
    return numbers.join(seen, key, "left").select(key, ((F.size("_numbers") > 0) & c("_seen").isNull()).alias("unsupported"))


def reference_tools_missing(acts: DataFrame) -> DataFrame:
    """(pair_id, tools_missing): the reference used a tool the failed run never called."""
    failed = c("side") == "failed"
    return (
        acts.groupBy("pair_id", "name")
        .agg(
            F.bool_or(~failed & (c("klass") == "tool")).alias("_wanted"),
            F.bool_or(failed).alias("_called"),
        )
        .groupBy("pair_id")
        .agg(F.bool_or(c("_wanted") & ~c("_called")).alias("tools_missing"))
    )


def step_flags(observations: DataFrame) -> DataFrame:
    """Per (pair, step) of the failed run: a shell timeout, and an unknown-tool reply."""
    return observations.groupBy("pair_id", "step").agg(
        F.bool_or(F.coalesce(c("timed_out"), F.lit(False))).alias("timeout_here"),
        F.bool_or(F.lower(F.coalesce(c("text"), F.lit(""))).contains("unknown tool")).alias("unknown_tool_here"),
    )


def attribute(
    candidates: DataFrame, acts: DataFrame, observations: DataFrame, answers: DataFrame, rules: DataFrame
) -> DataFrame:
    """Rule and eligible candidate components of every divergence candidate.

    ``candidates`` come from ``align_pairs``; ``acts`` are both runs' actions; ``observations``
    are the failed run's tool results (pair_id, step, ord, name, text, timed_out, exit_code,
    truncated); ``answers`` the failed run's finish answers (pair_id, step, answer).
    """
    results = observations.withColumn("result", F.struct(
        F.coalesce(c("timed_out"), F.lit(False)).alias("timed_out"), "exit_code", "truncated"))
    rows = prior_observation(candidates, results)
    rows = rows.join(step_flags(observations), ["pair_id", "step"], "left")
    rows = rows.join(reference_tools_missing(acts), "pair_id", "left")
    at_step = candidates.where(c("divergence") == "premature_finish").select("pair_id", "step")
    finish = answers.join(at_step, ["pair_id", "step"], "left_semi")
    unsupported = unsupported_answer(finish, observations.where(c("name") != fixed.FINISH_TOOL))
    rows = rows.join(unsupported, "pair_id", "left")
    kind, no = c("divergence"), F.lit(False)
    prior_failed = F.coalesce(c("prior_result.timed_out") | (c("prior_result.exit_code") != 0), c("prior_result.timed_out"), no)
    rule = _chain(
        [
            ((kind == "error") | ((F.coalesce(c("exit_reason"), F.lit("")) == "model_call_error") & (c("f_actions") == 0)), "R5"),
            (kind == "budget", "R6"),
            (F.coalesce(c("timeout_here"), no), "R7"),
            (kind == "no_tool_call", "R4"),
            ((kind == "premature_finish") & F.coalesce(c("unsupported"), no), "R3a"),
            (kind == "premature_finish", "R3"),
            (F.coalesce(c("unknown_tool_here"), no), "R8"),
            (kind == "early", "R10"),
            (kind == "missing_mutation", "R9"),
            (c("f_tool") & F.coalesce(c("tools_missing"), no), "R2a"),
            (c("f_tool"), "R2"),
            (prior_failed, "R1a"),
            (F.coalesce(c("prior_result.truncated"), no), "R1b"),
        ],
        "R1",
    )
    return (
        rows.withColumn("rule", rule)
        .join(rules, "rule")
        .select("pair_id", "ordinal", "step", "divergence", "rule", "candidate_components", "rule_note")
    )


def attribute_system(runs: DataFrame, rules: DataFrame) -> DataFrame:
    """Rule from the failed run's own evidence.

    ``runs``: exit_reason, last_is_finish, unsupported, any_failed_result, any_truncated.
    """
    no = F.lit(False)
    rule = _chain(
        [
            (c("exit_reason").isin(fixed.INFRA_EXITS), "R5"),
            (c("exit_reason").isin(fixed.BUDGET_EXITS), "R6"),
            (c("exit_reason") == "assistant_no_tool_call", "R4"),
            (c("last_is_finish") & F.coalesce(c("unsupported"), no), "R3a"),
            (c("last_is_finish"), "R3"),
            (F.coalesce(c("any_failed_result"), no), "R1a"),
            (F.coalesce(c("any_truncated"), no), "R1b"),
        ],
        "R1",
    )
    return runs.withColumn("rule", rule).join(rules, "rule")
