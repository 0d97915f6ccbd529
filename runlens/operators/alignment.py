"""Step-by-step alignment of a failed run with a reference run.

The comparison is relational: one aggregation per (pair, step) holds both sides, every step gets
its kind, and the first terminal step of a pair cuts the rest.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from runlens import fixed
from runlens.functions import scale
from runlens.functions import text as tx

c = F.col


def align_steps(acts: DataFrame) -> DataFrame:
    """Both sides of every step of a pair (a full outer join on the step, as one aggregation).

    ``acts``: pair_id, side (failed / reference), step, idx, name, klass, identity, exact. The
    actions collected are those of one assistant message on each side.
    """
    mutates = (c("klass") == "shell_mut") | ((c("klass") == "tool") & ~tx.is_read_only_tool(c("name")))
    out = []
    for short, side in (("f", "failed"), ("r", "reference")):
        here = c("side") == side
        out += [
            F.count_if(here).alias(f"{short}_actions"),
            F.array_sort(F.collect_list(F.when(here, c("identity")))).alias(f"{short}_class_key"),
            F.array_sort(F.collect_list(F.when(here, F.struct("idx", "exact"))))["exact"].alias(f"{short}_exact_key"),
        ]
        for flag, cond in {
            "final": c("klass") == "final",
            "finish": c("klass") == "finish",
            "opaque": c("klass") == "shell_opaque",
            "mutates": mutates,
            "tool": c("klass") == "tool",
        }.items():
            out.append(F.coalesce(F.bool_or(F.when(here, cond)), F.lit(False)).alias(f"{short}_{flag}"))
    return acts.groupBy("pair_id", "step").agg(*out)


def divergence_kind() -> tuple[Column, Column]:
    """Kind and note of a step whose class keys differ and where both sides act; order matters."""
    f_end, r_end = c("f_final") | c("f_finish"), c("r_final") | c("r_finish")
    known = ~(c("f_opaque") | c("r_opaque"))
    rules = [
        (c("f_final") & c("r_finish"), "no_tool_call",
         fixed.ENDED_WITHOUT_FINISH),
        (f_end & ~r_end & c("f_final"), "no_tool_call", fixed.STOPPED_EARLY),
        (f_end & ~r_end, "premature_finish", fixed.STOPPED_EARLY),
        (r_end & ~f_end, "late_finish", fixed.REFERENCE_DONE_HERE),
        (known & c("r_mutates") & ~c("f_mutates"), "missing_mutation",
         fixed.ONLY_INSPECTED),
        (known & c("f_mutates") & ~c("r_mutates"), "extra_mutation",
         fixed.ONLY_REFERENCE_INSPECTED),
        (c("step") == 1, "early", fixed.FIRST_DIFFERS),
        (F.lit(True), "different_action", fixed.OTHER_TARGET),
    ]

    def pick(position: int) -> Column:
        out = F.when(rules[0][0], rules[0][position])
        for rule in rules[1:]:
            out = out.when(rule[0], rule[position])
        return out

    return pick(1), pick(2)


def classified_steps(steps: DataFrame, exits: DataFrame) -> DataFrame:
    """Every step with ``divergence`` (NULL: no candidate), ``note`` and ``terminal``."""
    kind, note = divergence_kind()
    f_gone, r_gone = c("f_actions") == 0, c("r_actions") == 0
    finished = F.coalesce(c("exit_reason").isin(fixed.FINISHED_EXITS), F.lit(False))
    class_differs = c("f_class_key") != c("r_class_key")
    exact_differs = c("f_exact_key") != c("r_exact_key")
    f_end = c("f_final") | c("f_finish")
    divergence = (
        F.when(f_gone & finished, F.lit(None))
        .when(f_gone & (F.coalesce(c("exit_reason"), F.lit("")) == "model_call_error"), "error")
        .when(f_gone, "budget")
        .when(r_gone & f_end, F.lit(None))
        .when(r_gone, "late_finish")
        .when(class_differs, kind)
        .when(exact_differs & c("r_tool"), "argument_variant")
    )
    text = (
        F.when(f_gone, F.concat(
            F.lit("failed run ended with "), F.coalesce(c("exit_reason"), F.lit("None")),
            F.lit(" before step "), c("step").cast("string")))
        .when(r_gone, F.lit(fixed.REFERENCE_DONE))
        .when(class_differs, note)
        .otherwise(fixed.OTHER_ARGUMENTS)
    )
    return (
        steps.join(exits, "pair_id", "left")
        .withColumn("exact_differs", exact_differs)
        .withColumn("divergence", divergence)
        .withColumn("note", F.when(c("divergence").isNotNull(), text))
        .withColumn("terminal", f_gone | r_gone | (class_differs & c("divergence").isin(
            "premature_finish", "no_tool_call", "late_finish")))
    )


def visible_steps(classified: DataFrame) -> DataFrame:
    """Steps up to the first terminal one of their pair, both bounds included."""
    stop = classified.where("terminal").groupBy("pair_id").agg(F.min("step").alias("_stop"))
    return classified.join(stop, "pair_id", "left").where(
        c("_stop").isNull() | (c("step") <= c("_stop"))
    ).drop("_stop")


def align_pairs(acts: DataFrame, exits: DataFrame) -> DataFrame:
    """Ordered divergence candidates per pair: class divergences by step, then argument variants."""
    found = visible_steps(classified_steps(align_steps(acts), exits)).where(c("divergence").isNotNull())
    rows = found.select(
        "pair_id", "step", "divergence", "note", "exit_reason", "f_actions", "f_tool", "f_finish",
        (c("divergence") == "argument_variant").cast("int").alias("variant"),
    )
    bucket = c("variant") * F.lit(2**40) + F.floor(c("step") / 256)
    return scale.bucketed_rank(rows, ["pair_id"], bucket, [c("variant"), c("step")], "ordinal")


def alignment_summary(acts: DataFrame, exits: DataFrame) -> DataFrame:
    """Per pair: lengths of both runs, first exact and first class divergence."""
    classified = classified_steps(align_steps(acts), exits)
    lengths = classified.groupBy("pair_id").agg(
        F.coalesce(F.max(F.when(c("f_actions") > 0, c("step"))), F.lit(0)).alias("failed_steps"),
        F.coalesce(F.max(F.when(c("r_actions") > 0, c("step"))), F.lit(0)).alias("reference_steps"),
    )
    firsts = visible_steps(classified).groupBy("pair_id").agg(
        F.min(F.when(c("exact_differs"), c("step"))).alias("t_exact"),
        F.min(F.when(c("divergence").isNotNull() & (c("divergence") != "argument_variant"), c("step"))).alias("t_class"),
    )
    return lengths.join(firsts, "pair_id", "left")


def failures_with_reference(failures: DataFrame, references: DataFrame) -> DataFrame:
    """Non-infrastructure failures joined to the first genuine reference of their task.

    ``failures``: task_id, replicate, attempt, family, exit_reason; ``references``: task_id,
    replicate, attempt, verdict. The first reference is the one of the lowest replicate.
    """
    genuine = (
        references.where(c("verdict") == "genuine")
        .groupBy("task_id")
        .agg(F.min(F.struct("replicate", "attempt")).alias("_ref"))
        .select("task_id", c("_ref.replicate").alias("reference_replicate"), c("_ref.attempt").alias("reference_attempt"))
    )
    return failures.where(c("family") != "infra").join(genuine, "task_id")


def first_candidates(candidates: DataFrame, n: int = fixed.MAX_CANDIDATES, key: str = "pair_id") -> DataFrame:
    return candidates.where(c("ordinal") <= n)
