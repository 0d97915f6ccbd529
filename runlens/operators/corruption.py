"""Deterministic corruption arms over clusters: decoys, donors, application and audit.

Every pick is the smallest SHA-256 of ``cluster:arm:seed:value``, so it needs no random state and
is an aggregate, not a sort. Donors come from rank arithmetic over hash order, never from
pairing all clusters with each other.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from runlens import fixed
from runlens.functions import scale

c = F.col


def _eligible(components: DataFrame) -> DataFrame:
    return components.where(c("patchable") & c("where_eligible"))


def exclusion_sets(clusters: DataFrame, candidates: DataFrame, candidate_set: bool = True) -> DataFrame:
    """(cluster_id, component) a decoy may never be: the true component and the rule's candidates."""
    own = clusters.select("cluster_id", "component")
    if not candidate_set:
        return own.distinct()
    return own.unionByName(candidates.select("cluster_id", "component")).distinct()


def decoy_pool(
    clusters: DataFrame, components: DataFrame, candidates: DataFrame, activity: DataFrame, candidate_set: bool = True
) -> DataFrame:
    """(cluster_id, component, tier) of every allowed decoy that acts, ``near`` in the true layer, else ``far``.

    Starts from the activity, so nothing pairs all clusters with all components; how many decoys
    a cluster may have, active or not, is a matter of counts (``pool_sizes``).
    """
    banned = exclusion_sets(clusters, candidates, candidate_set)
    rows = _active_decoys(clusters, components, banned, activity)
    return rows.select(
        "cluster_id", "component", F.when(c("same_layer"), "near").otherwise("far").alias("tier")).distinct()


def pool_sizes(clusters: DataFrame, components: DataFrame, banned: DataFrame) -> DataFrame:
    """(cluster_id, pool): allowed decoys per cluster, from counts alone."""
    eligible = _eligible(components).select("component")
    total = eligible.agg(F.count(F.lit(1))).scalar()
    lost = banned.join(eligible, "component").groupBy("cluster_id").agg(F.count(F.lit(1)).alias("_lost"))
    return clusters.select("cluster_id").join(lost, "cluster_id", "left").select(
        "cluster_id", (total - F.coalesce(c("_lost"), F.lit(0))).alias("pool")
    )


def _active_decoys(clusters: DataFrame, components: DataFrame, banned: DataFrame, activity: DataFrame) -> DataFrame:
    """(cluster_id, component, step, same_layer) of allowed decoys at the steps they act."""
    layers = components.select("component", c("layer").alias("_true_layer"))
    true = clusters.select("cluster_id", "component").join(layers, "component", "left").select("cluster_id", "_true_layer")
    return (
        activity.select("cluster_id", "component", "step")
        .join(_eligible(components).select("component", "layer"), "component")
        .join(banned, ["cluster_id", "component"], "left_anti")
        .join(true, "cluster_id")
        .select("cluster_id", "component", "step", (c("layer") == c("_true_layer")).alias("same_layer"))
    )


def _pick(rows: DataFrame, arm: str, seed: int, extra: list[str]) -> DataFrame:
    """Best rank, then the component and its step of smallest hash; all by aggregation."""
    of_component = scale.seeded_hash(c("cluster_id"), arm, seed, c("component"))
    of_step = scale.seeded_hash(c("cluster_id"), arm, seed, c("component"), c("step"))
    best = F.min(F.struct(of_step.alias("h"), c("step").alias("step")))
    per_component = rows.groupBy("cluster_id", "_rank", "component", *extra).agg(best["step"].alias("step"))
    ordered = F.struct("_rank", of_component.alias("h"), "component", "step", *extra)
    return per_component.groupBy("cluster_id").agg(F.min(ordered).alias("_p")).select("cluster_id", "_p.*").drop("h")


def decoy_distance(assignments: DataFrame, components: DataFrame, true: str = "true_component", decoy: str = "decoy_component") -> DataFrame:
    """Adds ``same_layer`` and ``same_file`` between the true component and the decoy."""
    has_files = "files" in components.columns
    side = lambda name: components.select(
        c("component").alias(name), c("layer").alias(f"_{name}_layer"),
        *([c("files").alias(f"_{name}_files")] if has_files else []),
    )
    rows = assignments.join(side(true), true, "left").join(side(decoy), decoy, "left")
    same_file = F.arrays_overlap(f"_{true}_files", f"_{decoy}_files") if has_files else F.lit(None).cast("boolean")
    out = rows.withColumn("same_layer", c(f"_{true}_layer") == c(f"_{decoy}_layer")).withColumn("same_file", same_file)
    return out.drop(*[x for x in out.columns if x.startswith(f"_{true}_") or x.startswith(f"_{decoy}_")])


def where_picks(
    clusters: DataFrame, components: DataFrame, candidates: DataFrame, activity: DataFrame, verdicts: DataFrame,
    seed: int, variants: dict[str, tuple[str, bool]],
) -> DataFrame:
    """One struct column per variant (name -> tier, use the candidate set): decoy, step, fallback, reason.

    All variants share one scan of the active decoys and differ only in the aggregates.
    """
    in_set = candidates.select("cluster_id", "component").distinct().withColumn("_set", F.lit(True))
    own = exclusion_sets(clusters, candidates, candidate_set=False)
    sufficient = verdicts.where(c("verdict") == "positive").select("cluster_id", "step").distinct()
    rows = (
        _active_decoys(clusters, components, own, activity)
        .join(sufficient, ["cluster_id", "step"], "left_anti")
        .join(in_set, ["cluster_id", "component"], "left")
    )
    tiers = sorted({tier for tier, _ in variants.values()})
    def best_step(tier: str) -> Column:
        h = scale.seeded_hash(c("cluster_id"), f"corrupt_where_{tier}", seed, c("component"), c("step"))
        return F.min(F.struct(h.alias("h"), c("step").alias("step")))["step"].alias(f"_step_{tier}")

    per_component = rows.groupBy("cluster_id", "component", "same_layer", "_set").agg(*[best_step(x) for x in tiers])

    def pick(name: str, tier: str, candidate_set: bool) -> Column:
        h = scale.seeded_hash(c("cluster_id"), f"corrupt_where_{tier}", seed, c("component"))
        first = c("same_layer") if tier == "near" else ~c("same_layer")
        order = F.struct(
            F.when(first, 0).otherwise(1).alias("rank"), h.alias("h"), c("component").alias("component"),
            c(f"_step_{tier}").alias("step"), "same_layer",
        )
        allowed = c("_set").isNull() if candidate_set else F.lit(True)
        return F.min(F.when(allowed, order)).alias(f"_{name}")

    picked = per_component.groupBy("cluster_id").agg(*[pick(n, x, s) for n, (x, s) in variants.items()])
    out = clusters.select("cluster_id", c("component").alias("true_component")).join(picked, "cluster_id", "left")
    for wanted in sorted({s for _, s in variants.values()}):
        banned = exclusion_sets(clusters, candidates, wanted)
        out = out.join(pool_sizes(clusters, components, banned).withColumnRenamed("pool", f"_pool_{wanted}"), "cluster_id")

    def result(name: str, tier: str, candidate_set: bool) -> Column:
        p = c(f"_{name}")
        return F.struct(
            F.lit(f"corrupt_where_{tier}").alias("arm"), p["component"].alias("decoy_component"), p["step"].alias("decoy_step"),
            p["same_layer"].alias("same_layer"), (p["rank"] > 0).alias("distance_fallback"),
            F.when(c(f"_pool_{candidate_set}") <= 0, fixed.NO_DECOY).when(p.isNull(), fixed.NOT_ACTIVE).alias("impossible"),
        ).alias(name)

    return out.select("cluster_id", "true_component", *[result(n, x, s) for n, (x, s) in variants.items()])


def corrupt_where(
    clusters: DataFrame, components: DataFrame, candidates: DataFrame, activity: DataFrame, verdicts: DataFrame,
    tiers: Sequence[str] = ("near", "far"), seed: int = 0, candidate_set: bool = True,
) -> DataFrame:
    """A decoy component and step per cluster and tier: requested tier first, the other as a flagged fallback.

    The step must be one where the decoy acts and which is no validated-positive step.
    ``activity``: cluster_id, component, step; ``verdicts``: cluster_id, step, verdict.
    """
    variants = {tier: (tier, candidate_set) for tier in tiers}
    rows = where_picks(clusters, components, candidates, activity, verdicts, seed, variants)
    return rows.select("cluster_id", "true_component", F.explode(F.array(*tiers)).alias("_r")).select(
        "cluster_id", "true_component", "_r.*")


def corrupt_coherent(
    clusters: DataFrame, components: DataFrame, candidates: DataFrame, activity: DataFrame, verdicts: DataFrame, seed: int
) -> DataFrame:
    """A decoy at a validated-negative step, else at a step outside the sufficient set (``step_basis``)."""
    banned = exclusion_sets(clusters, candidates)
    flags = verdicts.groupBy("cluster_id", "step").agg(
        F.bool_or(c("verdict") == "negative").alias("_neg"), F.bool_or(c("verdict") == "positive").alias("_pos")
    )
    rows = _active_decoys(clusters, components, banned, activity).join(flags, ["cluster_id", "step"], "left")
    rank = F.when(c("_neg"), 0).when(~F.coalesce(c("_pos"), F.lit(False)), 1)
    picked = _pick(rows.withColumn("_rank", rank).where(c("_rank").isNotNull()), "coherent_wrong", seed, ["same_layer"])
    out = (
        clusters.select("cluster_id", c("component").alias("true_component"))
        .join(pool_sizes(clusters, components, banned), "cluster_id")
        .join(picked, "cluster_id", "left")
    )
    return out.select(
        "cluster_id", F.lit("coherent_wrong").alias("arm"), "true_component", c("component").alias("decoy_component"),
        c("step").alias("decoy_step"), "same_layer",
        F.when(c("_rank") == 0, "validated_negative").when(c("_rank") == 1, "not_sufficient").alias("step_basis"),
        F.when(c("pool") <= 0, fixed.NO_DECOY).when(c("component").isNull(), fixed.NOT_COHERENT).alias("impossible"),
    )


def donors(clusters: DataFrame, value: Column, arm: str, seed: int) -> DataFrame:
    """(cluster_id, arm, origin_cluster, impossible): another cluster whose value differs.

    Distinct values are put in a cycle by hash and every value takes its donors from the next
    one; within a value, clusters are ranked by hash and take the donor of the same rank modulo
    the donor count. Ranks come from bucket counts, so no task sees all clusters.
    """
    rows = clusters.select("cluster_id", F.sha2(value, 256).alias("_v")).withColumn(
        "_h", scale.seeded_hash(seed, arm, c("cluster_id")))
    sizes = rows.groupBy("_v").agg(F.count(F.lit(1)).alias("_size")).withColumn("_all", F.lit(0)).withColumn(
        "_vh", scale.seeded_hash(seed, arm, c("_v")))
    ring = scale.hash_rank(sizes, ["_all"], "_vh", ["_v"], "_pos")
    values = sizes.agg(F.count(F.lit(1))).scalar()
    following = ring.select(
        F.when(c("_pos") == 1, values).otherwise(c("_pos") - 1).alias("_pos"),
        c("_v").alias("_next"), c("_size").alias("_next_size"),
    )
    step = ring.select("_v", "_pos").join(following, "_pos").where(c("_next") != c("_v")).select("_v", "_next", "_next_size")
    ranked = scale.hash_rank(rows, ["_v"], "_h", ["cluster_id"], "_r")
    origin = ranked.select(c("_v").alias("_next"), c("_r").alias("_dr"), c("cluster_id").alias("origin_cluster"))
    takers = ranked.join(step, "_v", "left").withColumn("_dr", (c("_r") - 1) % c("_next_size") + 1)
    return takers.join(origin, ["_next", "_dr"], "left").select(
        "cluster_id", F.lit(arm).alias("arm"), "origin_cluster",
        F.when(c("origin_cluster").isNull(), fixed.NO_DONOR).alias("impossible"),
    )


def corrupt_why(clusters: DataFrame, seed: int) -> DataFrame:
    return donors(clusters, F.concat_ws("\u0000", "cause_label", "mechanism"), "corrupt_why", seed)


def corrupt_how(clusters: DataFrame, seed: int) -> DataFrame:
    return donors(clusters, c("fix_hint"), "corrupt_how", seed)


def shuffle_all(clusters: DataFrame, seed: int) -> DataFrame:
    return donors(clusters, c("cluster_id"), "shuffled", seed)


def apply_assignment(clusters: DataFrame, assignments: DataFrame) -> DataFrame:
    """The diagnosis each arm receives: WHERE from the decoy, WHY / HOW / all from the donor.

    ``clusters``: cluster_id, component, step, cause_label, mechanism, fix_hint, severity;
    ``assignments``: cluster_id, arm, decoy_component, decoy_step, origin_cluster, impossible.
    Impossible assignments yield no row; reference and system pass the diagnosis on unchanged.
    """
    arms = {name: corruption for name, corruption, _ in fixed.ARMS}
    kind = F.lit(None).cast("string")
    for name, corruption in arms.items():
        kind = F.when(c("arm") == name, corruption).otherwise(kind)
    fields = ["component", "step", "cause_label", "mechanism", "fix_hint", "severity"]
    donor = clusters.select(c("cluster_id").alias("origin_cluster"), *[c(f).alias(f"_d_{f}") for f in fields])
    rows = (
        assignments.where(c("impossible").isNull())
        .withColumn("corruption", kind)
        .join(clusters.select("cluster_id", *fields), "cluster_id")
        .join(donor, "origin_cluster", "left")
    )
    whole = c("corruption") == "all"
    decoy = c("corruption").isin("where", "coherent")

    def value(field: str) -> Column:
        out = F.when(whole, c(f"_d_{field}"))
        if field == "component":
            out = out.when(decoy, c("decoy_component"))
        elif field == "step":
            out = out.when(decoy, c("decoy_step"))
        elif field in ("cause_label", "mechanism"):
            out = out.when(c("corruption") == "why", c(f"_d_{field}"))
        elif field == "fix_hint":
            out = out.when(c("corruption") == "how", c(f"_d_{field}"))
        return out.otherwise(c(field)).alias(field)

    label = F.when(whole, "shuffled").when(c("arm") == "system", "system").when(
        c("corruption") == "none", "reference").otherwise("corrupted")
    return rows.select("cluster_id", "arm", "corruption", label.alias("diagnosis_source"), "origin_cluster", *[value(f) for f in fields])


def decoy_exclusion_audit(
    clusters: DataFrame, components: DataFrame, candidates: DataFrame, activity: DataFrame, verdicts: DataFrame, seed: int
) -> DataFrame:
    """Per cluster and tier: the decoy of the old rule (not the true component) and of the new
    rule (not in the candidate set), and whether the new rule loses feasibility."""
    variants = {f"{age}_{tier}": (tier, age == "new") for tier in ("near", "far") for age in ("old", "new")}
    rows = where_picks(clusters, components, candidates, activity, verdicts, seed, variants)
    both = F.explode(F.array(*[
        F.struct(F.lit(x).alias("tier"), c(f"old_{x}").alias("old"), c(f"new_{x}").alias("new")) for x in ("near", "far")
    ]))
    rows = rows.select("cluster_id", both.alias("_r")).select("cluster_id", "_r.*")
    in_set = candidates.select("cluster_id", c("component").alias("old_decoy")).distinct().withColumn("_in", F.lit(True))
    rows = rows.withColumn("old_decoy", c("old.decoy_component")).join(in_set, ["cluster_id", "old_decoy"], "left")
    reason = c("new.impossible")
    return rows.select(
        "cluster_id", "tier", "old_decoy", c("_in").isNotNull().alias("old_decoy_in_candidate_set"),
        c("new.decoy_component").alias("new_decoy"),
        F.when(reason.isNull(), "feasible").otherwise(F.concat(F.lit("impossible: "), reason)).alias("new_feasibility"),
        (c("old.impossible").isNull() & reason.isNotNull()).alias("lost"),
    )


def decoy_audit_summary(audit: DataFrame, sources: DataFrame, candidates: DataFrame) -> DataFrame:
    """Per source and tier of ``decoy_exclusion_audit``: clusters, old decoys inside the candidate set,
    feasibility lost, decoys changed, and the mean size of the candidate sets.

    ``sources``: cluster_id, source.
    """
    sizes = candidates.select("cluster_id", "component").distinct().groupBy("cluster_id").agg(F.count(F.lit(1)).alias("_n"))
    rows = audit.join(sources, "cluster_id").join(sizes, "cluster_id", "left")
    return rows.groupBy("source", "tier").agg(
        F.count(F.lit(1)).alias("clusters"),
        F.count_if("old_decoy_in_candidate_set").alias("old_decoys_in_candidate_set"),
        F.count_if("lost").alias("feasibility_lost"),
        F.count_if(~c("old_decoy").eqNullSafe(c("new_decoy"))).alias("decoys_changed"),
        F.avg(F.coalesce(c("_n"), F.lit(0))).alias("candidate_set_size_mean"),
    )
