"""Failure clusters by (cause label, component) and what is known about them."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from runlens import fixed
from runlens.functions import scale
from runlens.functions import text as tx

c = F.col
KEY = ["cause_label", "component"]


def severity_rank(severity: Column) -> Column:
    out = F.lit(None).cast("int")
    for name, rank in fixed.SEVERITY_RANK.items():
        out = F.when(severity == name, rank).otherwise(out)
    return out


def failure_clusters(diagnoses: DataFrame, keys: Sequence[str] = ()) -> DataFrame:
    """One row per cluster; ``keys`` (for example source) keep separate cluster sets apart.

    The representative has the highest severity, then the earliest step (a missing step last),
    then the smallest key. Members are counted, never collected, so a hot cluster is one
    partial aggregate per task; singletons are kept.
    """
    rank = F.struct(
        (-severity_rank(c("severity"))).alias("s"),
        F.coalesce(c("step"), F.lit(fixed.NO_STEP_RANK)).cast("long").alias("t"),
        c("failure_key").alias("k"),
    )
    per_type = F.coalesce(c("failure_type"), F.lit("unvalidated"))
    types = (
        diagnoses.groupBy(*keys, *KEY, per_type.alias("_type"))
        .agg(
            F.count(F.lit(1)).alias("_n"),
            F.count_if("oracle_validated").alias("_validated"),
            F.min(rank).alias("_best"),
        )
    )
    text = F.concat_ws(",", F.array_sort(F.collect_list(F.concat_ws("=", "_type", c("_n").cast("string")))))
    worst = F.lit(None).cast("string")
    for name, value in fixed.SEVERITY_RANK.items():
        worst = F.when(F.min("_best")["s"] == -value, name).otherwise(worst)
    return types.groupBy(*keys, *KEY).agg(
        F.sum("_n").alias("members"),
        F.min("_best")["k"].alias("representative"),
        worst.alias("max_severity"),
        F.sum("_validated").alias("oracle_validated_members"),
        text.alias("failure_types"),
    )


def cluster_ids(diagnoses: DataFrame, keys: Sequence[str] = ()) -> DataFrame:
    """Cluster id: 'c' + first 8 hex digits of SHA-256 over canonical JSON of cause, component and
    the two-level digest of the members (``scale.member_digest``)."""
    def exact(items: Column) -> Column:
        doc = F.concat(
            F.lit('{"cause":'), tx.json_string(c("cause_label")), F.lit(',"component":'), tx.json_string(c("component")),
            F.lit(',"members":'), tx.json_list(items), F.lit("}"),
        )
        return F.concat(F.lit("c"), F.substring(F.sha2(doc, 256), 1, 8))

    return scale.member_digest(diagnoses, [*keys, *KEY], "failure_key", exact).select(
        *keys, *KEY, "members", c("digest").alias("cluster_id")
    )


def membership_hash(diagnoses: DataFrame, keys: Sequence[str] = ()) -> DataFrame:
    """One hash over all clusters: two-level digest of their entries {id, members}, by (cause, component).

    The members of a cluster enter as the SHA-256 of their own two-level digest, so no row ever
    holds all failures.
    """
    ids = cluster_ids(diagnoses, keys).drop("members")
    joined = lambda parts: F.sha2(F.concat_ws("\n", parts), 256)
    listed = scale.member_digest(diagnoses, [*keys, *KEY], "failure_key", joined)
    entry = F.concat(F.lit('{"id":'), tx.json_string(c("cluster_id")), F.lit(',"members":"'), c("digest"), F.lit('"}'))
    items = listed.join(ids, [*keys, *KEY]).select(*keys, F.struct(*KEY, entry.alias("text")).alias("_item"))
    return scale.member_digest(items, keys, "_item", joined, lambda x: x["text"]).select(
        *keys, c("digest").alias("membership_sha256"), c("members").alias("clusters")
    )


def cluster_sizes(clusters: DataFrame, keys: Sequence[str] = ("source",)) -> DataFrame:
    """(keys, size, n): how many clusters have each size."""
    return clusters.groupBy(*keys, c("members").alias("size")).agg(F.count(F.lit(1)).alias("n"))


def printed_sizes(sizes: DataFrame, keys: Sequence[str] = ("source",)) -> DataFrame:
    """The list of all sizes, descending, as a report prints it: as long as the number of clusters,
    so for reports of few clusters only."""
    listed = F.flatten(F.transform(F.sort_array(F.collect_list(F.struct("size", "n")), asc=False),
                                   lambda x: F.array_repeat(x["size"].cast("string"), x["n"].cast("int"))))
    return sizes.groupBy(*keys).agg(F.concat(F.lit("["), F.concat_ws(", ", listed), F.lit("]")).alias("sizes"))


def cluster_table(clusters: DataFrame, keys: Sequence[str] = ("source",)) -> DataFrame:
    """Per source: clusters, singleton and deterministic fractions, clusters with two members."""
    n = F.count(F.lit(1))
    return clusters.groupBy(*keys).agg(
        n.alias("n_clusters"),
        (F.count_if(c("members") == 1) / n).alias("singleton_fraction"),
        (F.count_if(c("failure_types").contains("deterministic=")) / n).alias("deterministic_fraction"),
        F.count_if(c("members") >= 2).alias("clusters_with_two"),
    )


def feasible_by_key(assignments: DataFrame, clusters: DataFrame) -> DataFrame:
    """(cause_label, component, run_id, arm, feasibility) from assignments; unknown clusters are an error."""
    joined = assignments.where(~c("arm").isin("reference", "system")).join(
        clusters.select("cluster_id", *KEY), "cluster_id", "left"
    )
    unknown = F.raise_error(F.concat(F.lit("assignment for unknown cluster "), c("cluster_id")))
    return joined.select(
        F.coalesce(c("cause_label"), unknown).alias("cause_label"),
        "component", "run_id", "arm",
        F.when(c("impossible").isNull(), "feasible").otherwise(F.concat(F.lit("impossible: "), c("impossible"))).alias("feasibility"),
    )


def primary_clusters(clusters: DataFrame, feasibility: DataFrame, arms: Sequence[str] = tuple(fixed.PRIMARY_ARMS)) -> DataFrame:
    """Clusters with >= 2 members, a validated member, and a run in which every arm is feasible.

    Arms are counted, so a missing arm counts as infeasible.
    """
    ok = (
        feasibility.where(c("arm").isin(list(arms)) & c("feasibility").startswith("feasible"))
        .select(*KEY, "run_id", "arm")
        .distinct()
        .groupBy(*KEY, "run_id")
        .agg(F.count(F.lit(1)).alias("_arms"))
        .where(c("_arms") == len(arms))
        .select(*KEY)
        .distinct()
    )
    return clusters.where((c("members") >= 2) & (c("oracle_validated_members") > 0)).join(ok, KEY, "left_semi")


def cluster_tools(acts: DataFrame, members: DataFrame) -> DataFrame:
    """(cluster_id, tool): tools of the runs of a cluster; any shell class counts as the shell tool.

    ``acts``: rollout_id, klass, name; ``members``: cluster_id, rollout_id.
    """
    name = F.when(c("klass") == "tool", c("name")).when(c("klass").isin(fixed.SHELL_CLASSES), fixed.SHELL_TOOL)
    used = acts.select("rollout_id", name.alias("tool")).where(c("tool").isNotNull()).distinct()
    return used.join(members.select("cluster_id", "rollout_id").distinct(), "rollout_id").select("cluster_id", "tool").distinct()


def cluster_activity(representatives: DataFrame, activity: DataFrame, verdicts: DataFrame) -> DataFrame:
    """(cluster_id, component, step, verdict): activity of the representative with its step verdicts.

    ``representatives``: cluster_id, rollout_id; ``activity``: rollout_id, component, step;
    ``verdicts``: rollout_id, step, verdict. Steps without a verdict have NULL.
    """
    rows = representatives.join(activity, "rollout_id")
    return rows.join(verdicts.select("rollout_id", "step", "verdict"), ["rollout_id", "step"], "left").select(
        "cluster_id", "component", "step", "verdict"
    )


def component_ambiguity(diagnoses: DataFrame, keys: Sequence[str] = ("source",)) -> DataFrame:
    """Rule-determined share, candidate-set sizes, and clusters whose members all have one candidate."""
    sizes = diagnoses.groupBy(*keys, "n_candidates").agg(
        F.count(F.lit(1)).alias("_n"), F.count_if(c("attribution") == "rule").alias("_rule")
    )
    text = F.concat_ws(", ", F.array_sort(F.collect_list(F.struct(
        "n_candidates", F.concat(F.lit('"'), c("n_candidates").cast("string"), F.lit('": '), c("_n").cast("string")).alias("t"))))["t"])
    per_source = sizes.groupBy(*keys).agg(
        F.sum("_n").alias("failures"),
        (F.sum("_rule") / F.sum("_n")).alias("rule_determined_fraction"),
        (1 - F.sum("_rule") / F.sum("_n")).alias("llm_chosen_fraction"),
        F.concat(F.lit("{"), text, F.lit("}")).alias("candidate_set_sizes"),
    )
    per_cluster = ambiguity_clusters(diagnoses, keys).groupBy(*keys).agg(
        F.count(F.lit(1)).alias("clusters"), F.count_if("component_unique").alias("clusters_component_unique")
    )
    return per_source.join(per_cluster, list(keys))


def ambiguity_clusters(diagnoses: DataFrame, keys: Sequence[str] = ("source",)) -> DataFrame:
    return diagnoses.groupBy(*keys, *KEY).agg(
        F.count(F.lit(1)).alias("members"),
        F.bool_and(c("n_candidates") == 1).alias("component_unique"),
        F.max("n_candidates").alias("max_candidate_set"),
        F.count_if(c("attribution") == "llm").alias("llm_chosen_members"),
    )
