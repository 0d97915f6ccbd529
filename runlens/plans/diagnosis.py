"""Queries: clusters, corruption arms, verdicts and dispatches."""

from __future__ import annotations

from pyspark.sql import functions as F

from runlens.operators import clusters as clu
from runlens.operators import corruption as cor
from runlens.operators import dispatches as dsp
from runlens.operators import verdicts as ver
from runlens.plans.registry import query

c = F.col

RANK = "CASE severity WHEN 'low' THEN 0 WHEN 'medium' THEN 1 WHEN 'high' THEN 2 ELSE 3 END"
CLUSTERS = f"""SELECT cause_label, component, COUNT(*) AS members, ARG_MIN(failure_key, ROW(-({RANK}), COALESCE(step, 1000000), failure_key)) AS representative,
 ARG_MAX(severity, {RANK}) AS max_severity, COUNT(*) FILTER (WHERE oracle_validated) AS oracle_validated_members FROM diagnoses GROUP BY cause_label, component"""
TYPES = """SELECT cause_label, component, STRING_AGG(ft || '=' || n, ',' ORDER BY ft) AS failure_types FROM
 (SELECT cause_label, component, COALESCE(failure_type, 'unvalidated') AS ft, COUNT(*) AS n FROM diagnoses GROUP BY cause_label, component, COALESCE(failure_type, 'unvalidated')) GROUP BY cause_label, component"""


@query("failure_clusters", f"SELECT a.*, b.failure_types FROM ({CLUSTERS}) a JOIN ({TYPES}) b ON a.cause_label = b.cause_label AND a.component = b.component")
def _(t):
    return clu.failure_clusters(t.view("diagnoses"))


def digest_sql(keys, item, order, table):
    """Two-level member digest: per group the number of members and the sorted bucket digests ``d``."""
    return f"""SELECT {keys}SUM(n) AS members, LIST(b || sha256(body) ORDER BY b || sha256(body)) AS parts FROM
 (SELECT {keys}SUBSTR(sha256({item}), 1, 4) AS b, COUNT(*) AS n, STRING_AGG({item}, CHR(10) ORDER BY {order}) AS body FROM {table} GROUP BY {keys}SUBSTR(sha256({item}), 1, 4)) {f'GROUP BY {keys[:-2]}' if keys else ''}"""


IDS = f"""SELECT *, '["' || ARRAY_TO_STRING(parts, '","') || '"]' AS list, sha256(ARRAY_TO_STRING(parts, CHR(10))) AS digest FROM ({digest_sql('cause_label, component, ', 'failure_key', 'failure_key', 'diagnoses')})"""
WITH_ID = f"""SELECT *, 'c' || SUBSTR(sha256('{{"cause":"' || cause_label || '","component":"' || component || '","members":' || list || '}}'), 1, 8) AS cluster_id FROM ({IDS})"""


@query("cluster_id", f"SELECT cause_label, component, CAST(members AS BIGINT) AS members, cluster_id FROM ({WITH_ID})")
def _(t):
    return clu.cluster_ids(t.view("diagnoses"))


@query("membership_hash", f"""
WITH e AS (SELECT cause_label, component, '{{"id":"' || cluster_id || '","members":"' || digest || '"}}' AS entry FROM ({WITH_ID}))
SELECT sha256(ARRAY_TO_STRING(parts, CHR(10))) AS membership_sha256, CAST(members AS BIGINT) AS clusters FROM ({digest_sql('', 'entry', 'cause_label, component, entry', 'e')})""")
def _(t):
    return clu.membership_hash(t.view("diagnoses"))


@query("cluster_table", """
SELECT source, COUNT(*) AS n_clusters, '[' || STRING_AGG(CAST(members AS STRING), ', ' ORDER BY members DESC) || ']' AS sizes,
 ROUND(COUNT(*) FILTER (WHERE members = 1) / COUNT(*), 6) AS singleton_fraction, ROUND(COUNT(*) FILTER (WHERE det > 0) / COUNT(*), 6) AS deterministic_fraction,
 COUNT(*) FILTER (WHERE members >= 2) AS clusters_with_two FROM
 (SELECT source, cause_label, component, COUNT(*) AS members, COUNT(*) FILTER (WHERE failure_type = 'deterministic') AS det FROM diagnoses GROUP BY source, cause_label, component) GROUP BY source""")
def _(t):
    clusters = clu.failure_clusters(t.view("diagnoses"), ["source"])
    rows = clu.cluster_table(clusters).join(clu.printed_sizes(clu.cluster_sizes(clusters)), "source")
    return rows.withColumn("singleton_fraction", F.round("singleton_fraction", 6)).withColumn(
        "deterministic_fraction", F.round("deterministic_fraction", 6))


@query("cluster_sizes", """
SELECT source, members AS size, COUNT(*) AS n FROM (SELECT source, cause_label, component, COUNT(*) AS members FROM diagnoses GROUP BY source, cause_label, component) GROUP BY source, members""")
def _(t):
    return clu.cluster_sizes(clu.failure_clusters(t.view("diagnoses"), ["source"]))


FEAS = """SELECT c.cause_label, c.component, a.run_id, a.arm, CASE WHEN a.impossible IS NULL THEN 'feasible' ELSE 'impossible: ' || a.impossible END AS feasibility
 FROM arm_assignments a JOIN clusters c ON a.cluster_id = c.cluster_id"""


@query("feasible_by_key", FEAS)
def _(t):
    return clu.feasible_by_key(t.view("arm_assignments"), t.view("clusters"))


@query("primary_clusters", f"""
SELECT a.cause_label, a.component, a.members FROM ({CLUSTERS}) a WHERE members >= 2 AND oracle_validated_members > 0 AND EXISTS
 (SELECT 1 FROM (SELECT cause_label, component, run_id, COUNT(DISTINCT arm) AS arms FROM ({FEAS}) WHERE feasibility = 'feasible' AND arm <> 'coherent_wrong' GROUP BY cause_label, component, run_id) f
  WHERE f.cause_label = a.cause_label AND f.component = a.component AND f.arms = 5)""")
def _(t):
    feas = clu.feasible_by_key(t.view("arm_assignments"), t.view("clusters"))
    return clu.primary_clusters(clu.failure_clusters(t.view("diagnoses")), feas).select("cause_label", "component", "members")


TOOL_ACTS = """SELECT conv_id AS rollout_id, CASE LENGTH(text) % 6 WHEN 0 THEN 'shell_ro' WHEN 1 THEN 'shell_mut' WHEN 2 THEN 'shell_opaque' WHEN 3 THEN 'finish' WHEN 4 THEN 'final' ELSE 'tool' END AS klass,
 'tool_' || CAST(LENGTH(text) % 4 AS STRING) AS name FROM conversations"""
CLUSTER_RUNS = "SELECT 'c' || CAST(conv_id % 13 AS STRING) AS cluster_id, conv_id AS rollout_id FROM conversations GROUP BY conv_id"


@query("cluster_tools", f"""
SELECT DISTINCT m.cluster_id, CASE WHEN a.klass = 'tool' THEN a.name ELSE 'run_shell_command' END AS tool FROM ({TOOL_ACTS}) a JOIN ({CLUSTER_RUNS}) m ON a.rollout_id = m.rollout_id
WHERE a.klass IN ('tool','shell_ro','shell_mut','shell_opaque')""")
def _(t):
    return clu.cluster_tools(t.sql(TOOL_ACTS), t.sql(CLUSTER_RUNS))


REPRESENTATIVES = "SELECT cluster_id, cluster_id AS rollout_id FROM clusters"


@query("cluster_activity", """
SELECT a.cluster_id, a.component, a.step, v.verdict FROM cluster_activity a LEFT JOIN cluster_verdicts v ON a.cluster_id = v.cluster_id AND a.step = v.step""")
def _(t):
    act = t.view("cluster_activity").withColumnRenamed("cluster_id", "rollout_id")
    verdicts = t.view("cluster_verdicts").withColumnRenamed("cluster_id", "rollout_id")
    return clu.cluster_activity(t.sql(REPRESENTATIVES), act, verdicts)


@query("component_ambiguity", """
WITH s AS (SELECT source, COUNT(*) AS failures, COUNT(*) FILTER (WHERE attribution = 'rule') / COUNT(*) AS rule_share FROM diagnoses GROUP BY source),
h AS (SELECT source, '{' || STRING_AGG('"' || n_candidates || '": ' || n, ', ' ORDER BY n_candidates) || '}' AS candidate_set_sizes FROM (SELECT source, n_candidates, COUNT(*) AS n FROM diagnoses GROUP BY source, n_candidates) GROUP BY source),
k AS (SELECT source, COUNT(*) AS clusters, COUNT(*) FILTER (WHERE only_one) AS clusters_component_unique FROM (SELECT source, cause_label, component, BOOL_AND(n_candidates = 1) AS only_one FROM diagnoses GROUP BY source, cause_label, component) GROUP BY source)
SELECT s.source, failures, ROUND(rule_share, 6) AS rule_determined_fraction, ROUND(1 - rule_share, 6) AS llm_chosen_fraction, candidate_set_sizes, clusters, clusters_component_unique
FROM s JOIN h ON s.source = h.source JOIN k ON s.source = k.source""")
def _(t):
    rows = clu.component_ambiguity(t.view("diagnoses"))
    return rows.withColumn("rule_determined_fraction", F.round("rule_determined_fraction", 6)).withColumn(
        "llm_chosen_fraction", F.round("llm_chosen_fraction", 6))


@query("ambiguity_clusters", """
SELECT source, cause_label, component, COUNT(*) AS members, BOOL_AND(n_candidates = 1) AS component_unique, MAX(n_candidates) AS max_candidate_set,
 COUNT(*) FILTER (WHERE attribution = 'llm') AS llm_chosen_members FROM diagnoses GROUP BY source, cause_label, component""")
def _(t):
    return clu.ambiguity_clusters(t.view("diagnoses"))


# ------------------------------------------------------------------ corruption

SEED = 0
POOL = """banned AS (SELECT cluster_id, component FROM clusters UNION SELECT cluster_id, component FROM cluster_candidates),
eligible AS (SELECT component, layer FROM components WHERE patchable AND where_eligible),
pool AS (SELECT c.cluster_id, e.component, e.layer = t.layer AS same_layer FROM clusters c JOIN components t ON c.component = t.component CROSS JOIN eligible e
 WHERE NOT EXISTS (SELECT 1 FROM banned b WHERE b.cluster_id = c.cluster_id AND b.component = e.component)),
loose AS (SELECT c.cluster_id, e.component, e.layer = t.layer AS same_layer FROM clusters c JOIN components t ON c.component = t.component CROSS JOIN eligible e WHERE e.component <> c.component)"""


ACTIVE = "(SELECT * FROM pool p WHERE EXISTS (SELECT 1 FROM cluster_activity a WHERE a.cluster_id = p.cluster_id AND a.component = p.component))"


@query("decoy_pool", f"WITH {POOL} SELECT cluster_id, component, CASE WHEN same_layer THEN 'near' ELSE 'far' END AS tier FROM {ACTIVE}")
def _(t):
    return cor.decoy_pool(t.view("clusters"), t.view("components"), t.view("cluster_candidates"), t.view("cluster_activity"))


@query("pool_sizes", f"WITH {POOL} SELECT c.cluster_id, COUNT(p.component) AS pool FROM clusters c LEFT JOIN pool p ON c.cluster_id = p.cluster_id GROUP BY c.cluster_id")
def _(t):
    return cor.pool_sizes(t.view("clusters"), t.view("components"), cor.exclusion_sets(t.view("clusters"), t.view("cluster_candidates")))


def where_sql(tier, name, pool="pool"):
    first = "p.same_layer" if tier == "near" else "NOT p.same_layer"
    arm = f"corrupt_where_{tier}"
    return f"""{name}_act AS (SELECT p.cluster_id, p.component, a.step, p.same_layer, CASE WHEN {first} THEN 0 ELSE 1 END AS rnk FROM {pool} p JOIN cluster_activity a ON p.cluster_id = a.cluster_id AND p.component = a.component
 WHERE NOT EXISTS (SELECT 1 FROM cluster_verdicts v WHERE v.cluster_id = a.cluster_id AND v.step = a.step AND v.verdict = 'positive')),
{name}_pick AS (SELECT * FROM (SELECT *, ROW_NUMBER() OVER (PARTITION BY cluster_id ORDER BY rnk, sha256(cluster_id || ':{arm}:{SEED}:' || component), component, sha256(cluster_id || ':{arm}:{SEED}:' || component || ':' || step)) AS rn FROM {name}_act) WHERE rn = 1),
{name} AS (SELECT c.cluster_id, '{arm}' AS arm, c.component AS true_component, k.component AS decoy_component, k.step AS decoy_step, k.same_layer, k.rnk > 0 AS distance_fallback,
 CASE WHEN NOT EXISTS (SELECT 1 FROM {pool} p WHERE p.cluster_id = c.cluster_id) THEN 'no eligible decoy component outside the candidate set' WHEN k.cluster_id IS NULL THEN 'no decoy component active outside the sufficient set' END AS impossible
 FROM clusters c LEFT JOIN {name}_pick k ON c.cluster_id = k.cluster_id)"""


def where_args(t):
    return (t.view("clusters"), t.view("components"), t.view("cluster_candidates"), t.view("cluster_activity"), t.view("cluster_verdicts"))


@query("corrupt_where", f"WITH {POOL}, {where_sql('near', 'near_arm')}, {where_sql('far', 'far_arm')} SELECT * FROM near_arm UNION ALL SELECT * FROM far_arm")
def _(t):
    return cor.corrupt_where(*where_args(t), ("near", "far"), SEED)


COHERENT = f"""WITH {POOL}, act AS (SELECT p.cluster_id, p.component, a.step, p.same_layer, CASE WHEN v.verdict = 'negative' THEN 0 WHEN v.verdict IS NULL OR v.verdict <> 'positive' THEN 1 END AS rnk
 FROM pool p JOIN cluster_activity a ON p.cluster_id = a.cluster_id AND p.component = a.component LEFT JOIN cluster_verdicts v ON v.cluster_id = a.cluster_id AND v.step = a.step),
pick AS (SELECT * FROM (SELECT *, ROW_NUMBER() OVER (PARTITION BY cluster_id ORDER BY rnk, sha256(cluster_id || ':coherent_wrong:{SEED}:' || component), component, sha256(cluster_id || ':coherent_wrong:{SEED}:' || component || ':' || step)) AS rn FROM act WHERE rnk IS NOT NULL) WHERE rn = 1)
SELECT c.cluster_id, 'coherent_wrong' AS arm, c.component AS true_component, k.component AS decoy_component, k.step AS decoy_step, k.same_layer, CASE k.rnk WHEN 0 THEN 'validated_negative' WHEN 1 THEN 'not_sufficient' END AS step_basis,
 CASE WHEN NOT EXISTS (SELECT 1 FROM pool p WHERE p.cluster_id = c.cluster_id) THEN 'no eligible decoy component outside the candidate set'
  WHEN k.cluster_id IS NULL THEN 'no decoy component active at a validated-negative step or outside the sufficient set' END AS impossible
FROM clusters c LEFT JOIN pick k ON c.cluster_id = k.cluster_id"""


@query("corrupt_coherent", COHERENT)
def _(t):
    return cor.corrupt_coherent(*where_args(t), SEED)


def donor_sql(value, arm):
    return f"""SELECT t.cluster_id, '{arm}' AS arm, d.cluster_id AS origin_cluster, CASE WHEN d.cluster_id IS NULL THEN 'no other cluster with a different value' END AS impossible FROM
 (SELECT cluster_id, v, ROW_NUMBER() OVER (PARTITION BY v ORDER BY sha256('{SEED}:{arm}:' || cluster_id), cluster_id) AS r FROM (SELECT cluster_id, sha256({value}) AS v FROM clusters)) t
JOIN (SELECT v, LEAD(v, 1, first_v) OVER (ORDER BY h, v) AS nv FROM (SELECT v, h, FIRST_VALUE(v) OVER (ORDER BY h, v) AS first_v FROM
  (SELECT DISTINCT sha256({value}) AS v, sha256('{SEED}:{arm}:' || sha256({value})) AS h FROM clusters))) n ON t.v = n.v
LEFT JOIN (SELECT cluster_id, v, ROW_NUMBER() OVER (PARTITION BY v ORDER BY sha256('{SEED}:{arm}:' || cluster_id), cluster_id) AS r, COUNT(*) OVER (PARTITION BY v) AS size FROM (SELECT cluster_id, sha256({value}) AS v FROM clusters)) d
 ON d.v = n.nv AND n.nv <> n.v AND d.r = (t.r - 1) % d.size + 1"""


WHY, HOW, ALL = donor_sql("cause_label || CHR(0) || mechanism", "corrupt_why"), donor_sql("fix_hint", "corrupt_how"), donor_sql("cluster_id", "shuffled")


@query("corrupt_why", WHY)
def _(t):
    return cor.corrupt_why(t.view("clusters"), SEED)


@query("corrupt_how", HOW)
def _(t):
    return cor.corrupt_how(t.view("clusters"), SEED)


@query("shuffle_all", ALL)
def _(t):
    return cor.shuffle_all(t.view("clusters"), SEED)


@query("apply_assignment", f"""
WITH {POOL}, {where_sql('near', 'near_arm')}, a AS (SELECT cluster_id, arm, decoy_component, decoy_step, NULL AS origin_cluster FROM near_arm WHERE impossible IS NULL
 UNION ALL SELECT cluster_id, arm, NULL, NULL, origin_cluster FROM ({HOW}) WHERE impossible IS NULL UNION ALL SELECT cluster_id, arm, NULL, NULL, origin_cluster FROM ({ALL}) WHERE impossible IS NULL)
SELECT a.cluster_id, a.arm, CASE a.arm WHEN 'shuffled' THEN 'all' WHEN 'corrupt_how' THEN 'how' ELSE 'where' END AS corruption, CASE a.arm WHEN 'shuffled' THEN 'shuffled' ELSE 'corrupted' END AS diagnosis_source, a.origin_cluster,
 CASE a.arm WHEN 'shuffled' THEN d.component WHEN 'corrupt_where_near' THEN a.decoy_component ELSE c.component END AS component, CASE a.arm WHEN 'shuffled' THEN d.members WHEN 'corrupt_where_near' THEN a.decoy_step ELSE c.members END AS step,
 CASE a.arm WHEN 'shuffled' THEN d.cause_label ELSE c.cause_label END AS cause_label, CASE a.arm WHEN 'shuffled' THEN d.mechanism ELSE c.mechanism END AS mechanism,
 CASE WHEN a.arm IN ('shuffled', 'corrupt_how') THEN d.fix_hint ELSE c.fix_hint END AS fix_hint, CASE a.arm WHEN 'shuffled' THEN d.severity ELSE c.severity END AS severity
FROM a JOIN clusters c ON a.cluster_id = c.cluster_id LEFT JOIN clusters d ON a.origin_cluster = d.cluster_id""")
def _(t):
    clusters = t.view("clusters").withColumn("step", c("members"))
    none = lambda n, k: F.lit(None).cast(k).alias(n)
    near = cor.corrupt_where(*where_args(t), ("near",), SEED).select(
        "cluster_id", "arm", "decoy_component", "decoy_step", none("origin_cluster", "string"), "impossible")
    donors = cor.corrupt_how(clusters, SEED).unionByName(cor.shuffle_all(clusters, SEED)).select(
        "cluster_id", "arm", none("decoy_component", "string"), none("decoy_step", "bigint"), "origin_cluster", "impossible")
    return cor.apply_assignment(clusters, near.unionByName(donors))


@query("decoy_distance", f"""
WITH {POOL} SELECT p.cluster_id, c.component AS true_component, p.component AS decoy_component, a.layer = b.layer AS same_layer FROM {ACTIVE} p JOIN clusters c ON p.cluster_id = c.cluster_id
JOIN components a ON c.component = a.component JOIN components b ON p.component = b.component""")
def _(t):
    pool = cor.decoy_pool(t.view("clusters"), t.view("components"), t.view("cluster_candidates"), t.view("cluster_activity"))
    rows = pool.withColumnRenamed("component", "decoy_component").join(
        t.view("clusters").select("cluster_id", c("component").alias("true_component")), "cluster_id")
    return cor.decoy_distance(rows, t.view("components")).select("cluster_id", "true_component", "decoy_component", "same_layer")


def audit_sql(tier):
    return f"""SELECT o.cluster_id, '{tier}' AS tier, o.decoy_component AS old_decoy, COALESCE(EXISTS (SELECT 1 FROM cluster_candidates s WHERE s.cluster_id = o.cluster_id AND s.component = o.decoy_component), FALSE) AS old_decoy_in_candidate_set,
 n.decoy_component AS new_decoy, COALESCE('impossible: ' || n.impossible, 'feasible') AS new_feasibility, o.impossible IS NULL AND n.impossible IS NOT NULL AS lost
FROM old_{tier} o JOIN new_{tier} n ON o.cluster_id = n.cluster_id"""


@query("decoy_exclusion_audit", f"""
WITH {POOL}, {where_sql('near', 'new_near')}, {where_sql('far', 'new_far')}, {where_sql('near', 'old_near', 'loose')}, {where_sql('far', 'old_far', 'loose')}
{audit_sql('near')} UNION ALL {audit_sql('far')}""")
def _(t):
    return cor.decoy_exclusion_audit(*where_args(t), SEED)


@query("decoy_audit_summary", f"""
WITH {POOL}, {where_sql('near', 'new_near')}, {where_sql('far', 'new_far')}, {where_sql('near', 'old_near', 'loose')}, {where_sql('far', 'old_far', 'loose')}, a AS ({audit_sql('near')} UNION ALL {audit_sql('far')}),
s AS (SELECT cluster_id, COUNT(DISTINCT component) AS n FROM cluster_candidates GROUP BY cluster_id)
SELECT c.cause_label AS source, a.tier, COUNT(*) AS clusters, COUNT(*) FILTER (WHERE old_decoy_in_candidate_set) AS old_decoys_in_candidate_set, COUNT(*) FILTER (WHERE lost) AS feasibility_lost,
 COUNT(*) FILTER (WHERE old_decoy IS DISTINCT FROM new_decoy) AS decoys_changed, ROUND(AVG(COALESCE(s.n, 0)), 6) AS candidate_set_size_mean
FROM a JOIN clusters c ON a.cluster_id = c.cluster_id LEFT JOIN s ON a.cluster_id = s.cluster_id GROUP BY c.cause_label, a.tier""")
def _(t):
    audit = cor.decoy_exclusion_audit(*where_args(t), SEED)
    sources = t.view("clusters").select("cluster_id", c("cause_label").alias("source"))
    out = cor.decoy_audit_summary(audit, sources, t.view("cluster_candidates"))
    return out.withColumn("candidate_set_size_mean", F.round("candidate_set_size_mean", 6))


# ------------------------------------------------------------------ verdicts


@query("arm_stats", """
SELECT failure_key, step, arm, k, passed, scored, unreplayable, infra, inapplicable, ROUND(passed / k, 6) AS pass_fraction, ROUND((passed + k - scored) / k, 6) AS held_fraction FROM
(SELECT failure_key, step, arm, COUNT(*) AS k, COUNT(*) FILTER (WHERE status = 'passed') AS passed, COUNT(*) FILTER (WHERE status IN ('passed','failed')) AS scored,
 COUNT(*) FILTER (WHERE status = 'unreplayable') AS unreplayable, CAST(0 AS BIGINT) AS infra, CAST(0 AS BIGINT) AS inapplicable FROM trials GROUP BY failure_key, step, arm)""")
def _(t):
    rows = ver.arm_stats(t.view("trials"))
    return rows.withColumn("pass_fraction", F.round("pass_fraction", 6)).withColumn("held_fraction", F.round("held_fraction", 6))


def stage_cols():
    parts = []
    for n in (3, 5, 8, 12):
        parts += [f"COUNT(*) FILTER (WHERE arm = 'substitute' AND idx <= {n}) AS sub_{n}",
                  f"COUNT(*) FILTER (WHERE arm = 'substitute' AND idx <= {n} AND status = 'passed') AS sub_passed_{n}",
                  f"COUNT(*) FILTER (WHERE arm = 'substitute' AND idx <= {n} AND status = 'unreplayable') AS sub_unreplayable_{n}",
                  f"COUNT(*) FILTER (WHERE arm = 'control' AND idx <= {n}) AS ctl_{n}",
                  f"COUNT(*) FILTER (WHERE arm = 'control' AND idx <= {n} AND status = 'passed') AS ctl_passed_{n}",
                  f"COUNT(*) FILTER (WHERE arm = 'control' AND idx <= {n} AND status IN ('passed','failed')) AS ctl_scored_{n}"]
    return ", ".join(parts)


STAGES = f"SELECT failure_key, step, {stage_cols()} FROM trials GROUP BY failure_key, step"


@query("trial_stages", STAGES)
def _(t):
    return ver.trial_stages(t.view("trials"))


def decide_sql(sub, ctl):
    return f"""CASE WHEN {sub} + 1e-9 >= 0.6 AND {ctl} <= 0.34 + 1e-9 AND {sub} - {ctl} + 1e-9 >= 0.4 THEN 'positive' WHEN {sub} <= 0.4 + 1e-9 OR {sub} - {ctl} <= 0.1 + 1e-9 THEN 'negative' ELSE 'undecided' END"""


@query("decide", f"""
SELECT failure_key, step, {decide_sql('s', 'k')} AS decision FROM (SELECT failure_key, step,
 COUNT(*) FILTER (WHERE arm = 'substitute' AND status = 'passed') / COUNT(*) FILTER (WHERE arm = 'substitute') AS s,
 COUNT(*) FILTER (WHERE arm = 'control' AND status <> 'failed') / COUNT(*) FILTER (WHERE arm = 'control') AS k FROM trials GROUP BY failure_key, step HAVING COUNT(DISTINCT arm) = 2)""")
def _(t):
    arms = ver.arm_stats(t.view("trials"))
    both = arms.groupBy("failure_key", "step").agg(
        F.max(F.when(c("arm") == "substitute", c("pass_fraction"))).alias("p_sub"),
        F.max(F.when(c("arm") == "control", c("held_fraction"))).alias("p_ctl"))
    return both.where(c("p_sub").isNotNull() & c("p_ctl").isNotNull()).select(
        "failure_key", "step", ver.decide(c("p_sub"), c("p_ctl")).alias("decision"))


def pc(n):
    return decide_sql(f"(sub_passed_{n} / {n}.0)", f"((ctl_passed_{n} + {n} - ctl_scored_{n}) / {n}.0)")


SCHEDULE = f"""WITH st AS ({STAGES}),
a AS (SELECT *, sub_passed_3 / 3.0 <= 0.4 + 1e-9 AS low3, sub_passed_3 / 3.0 <= 0.4 + 1e-9 AND sub_passed_5 / 5.0 <= 0.4 + 1e-9 AS low5 FROM st),
b AS (SELECT *, sub_3 >= 3 AND (low3 OR ctl_3 >= 3) AS ok3 FROM a), e AS (SELECT *, ok3 AND sub_5 >= 5 AND (low5 OR ctl_5 >= 5) AS ok5 FROM b),
g AS (SELECT *, ok5 AND sub_8 >= 8 AND ctl_8 >= 8 AS ok8 FROM e), h AS (SELECT *, ok8 AND sub_12 >= 12 AND ctl_12 >= 12 AS ok12 FROM g),
d AS (SELECT *, CASE WHEN ok3 THEN CASE WHEN low3 THEN 'control_skipped' ELSE {pc(3)} END END AS d3, CASE WHEN ok5 THEN CASE WHEN low5 THEN 'control_skipped' ELSE {pc(5)} END END AS d5,
 CASE WHEN ok8 THEN {pc(8)} END AS d8, CASE WHEN ok12 THEN {pc(12)} END AS d12, sub_3 >= 3 AND sub_unreplayable_3 = 3 AS dead FROM h),
s AS (SELECT *, CASE WHEN dead THEN 3 WHEN d5 <> 'undecided' THEN 5 WHEN d8 <> 'undecided' THEN 8 WHEN d12 <> 'undecided' THEN 12 END AS stop_n,
 CASE WHEN ok12 THEN 12 WHEN ok8 THEN 8 WHEN ok5 THEN 5 WHEN ok3 THEN 3 END AS last_n FROM d),
n AS (SELECT *, COALESCE(stop_n, last_n) AS n FROM s), v AS (SELECT *, CASE n WHEN 3 THEN d3 WHEN 5 THEN d5 WHEN 8 THEN d8 WHEN 12 THEN d12 END AS dec FROM n),
w AS (SELECT *, CASE WHEN dead THEN 'unreplayable' WHEN dec IN ('positive','negative') THEN dec WHEN dec = 'control_skipped' THEN 'negative' WHEN dec = 'undecided' THEN 'unresolved' END AS verdict FROM v)"""


@query("schedule_verdicts", SCHEDULE + """
SELECT failure_key, step, verdict, n, COALESCE(stop_n IS NOT NULL OR n >= 12 OR (n >= 5 AND verdict <> 'unresolved'), FALSE) AS confirmed, COALESCE(dec = 'control_skipped', FALSE) AS control_skipped FROM w""")
def _(t):
    return ver.schedule_verdicts(t.view("trials"))


SUB, CTL = "(sub_passed / 3.0)", "((ctl_passed + 3 - ctl_scored) / 3.0)"
VERDICT = f"""CASE WHEN verdict IS NOT NULL THEN verdict WHEN status = 'skipped' THEN 'skipped' WHEN status = 'unreplayable' THEN 'unreplayable'
 WHEN ctl_skipped THEN CASE WHEN {SUB} <= 0.4 + 1e-9 THEN 'negative' ELSE 'unresolved' END WHEN {decide_sql(SUB, CTL)} = 'undecided' THEN 'unresolved' ELSE {decide_sql(SUB, CTL)} END"""


@query("legacy_verdicts", f"SELECT failure_key, step, {VERDICT} AS verdict FROM candidates")
def _(t):
    return ver.legacy_verdicts(t.view("candidates")).select("failure_key", "step", "verdict")


@query("needs_escalation", f"""
SELECT failure_key, step FROM candidates WHERE verdict IS NULL AND status NOT IN ('skipped','unreplayable') AND (sub_passed = 2 OR (NOT ctl_skipped AND
 ((ctl_passed + 3 - ctl_scored = 1 AND sub_passed >= 2) OR {decide_sql(SUB, CTL)} = 'undecided')))""")
def _(t):
    return ver.needs_escalation(t.view("candidates")).select("failure_key", "step")


@query("unconfirmed", "SELECT failure_key, step FROM candidates WHERE status NOT IN ('skipped','unreplayable') AND NOT confirmed")
def _(t):
    return ver.unconfirmed(t.view("candidates")).select("failure_key", "step")


FLAGS = f"""SELECT failure_key, source, COUNT(*) FILTER (WHERE status NOT IN ('skipped','unreplayable')) AS live, COUNT(*) FILTER (WHERE status <> 'skipped' AND v = 'positive') AS pos,
 COUNT(*) FILTER (WHERE status <> 'skipped' AND v = 'unresolved') AS opn, COUNT(*) FILTER (WHERE status <> 'skipped' AND NOT ctl_skipped AND ctl_scored > 0) AS ctl,
 COUNT(*) FILTER (WHERE status <> 'skipped' AND NOT ctl_skipped AND ctl_scored > 0 AND ctl_passed > 1) AS ctl_high, MIN(step) FILTER (WHERE status <> 'skipped' AND v = 'positive') AS first_pos,
 MAX(step) FILTER (WHERE divergence <> 'argument_variant') AS last_class, MAX(step) AS last_any FROM (SELECT *, {VERDICT} AS v FROM candidates) GROUP BY failure_key, source"""
TYPED = f"""SELECT *, CASE WHEN live = 0 THEN 'unreplayable' WHEN pos > 0 THEN 'deterministic' WHEN opn > 0 THEN 'unresolved' WHEN ctl = 0 THEN 'unreplayable' WHEN ctl_high = ctl THEN 'stochastic' ELSE 'unrepairable' END AS failure_type FROM ({FLAGS})"""


@query("failure_type", f"SELECT failure_key, failure_type FROM ({TYPED})")
def _(t):
    return ver.failure_type(t.view("candidates")).select("failure_key", "failure_type")


ORACLE = f"""SELECT failure_key, failure_type, COALESCE(last_class, last_any) AS manifestation_step, CASE failure_type WHEN 'deterministic' THEN first_pos WHEN 'stochastic' THEN COALESCE(last_class, last_any) END AS oracle_step,
 CASE failure_type WHEN 'deterministic' THEN 'sufficient' WHEN 'stochastic' THEN 'manifestation' ELSE 'unvalidated' END AS oracle_step_basis FROM ({TYPED})"""


@query("oracle_step", ORACLE)
def _(t):
    return ver.oracle_step(t.view("candidates"))


MEMBERS = """SELECT cause_label, component, run_id, failure_key, ROW_NUMBER() OVER (PARTITION BY cause_label, component, run_id ORDER BY failure_key) = 1 AS is_representative FROM diagnoses"""


@query("confirm_targets", f"""
WITH m AS ({MEMBERS}), big AS (SELECT cause_label, component FROM m GROUP BY cause_label, component HAVING COUNT(*) >= 2)
SELECT DISTINCT m.run_id, m.failure_key, x.step FROM m JOIN big ON m.cause_label = big.cause_label AND m.component = big.component JOIN candidates x ON x.failure_key = m.failure_key LEFT JOIN ({ORACLE}) o ON o.failure_key = m.failure_key
WHERE x.status NOT IN ('skipped','unreplayable') AND NOT x.confirmed AND (m.is_representative OR x.step = o.oracle_step)""")
def _(t):
    cands = t.view("candidates")
    return ver.confirm_targets(t.sql(MEMBERS), cands, ver.oracle_step(cands), 2)


# ------------------------------------------------------------------ dispatches

RECOVERY = """SELECT rollout_id, CASE WHEN errors = 0 THEN 1.0 ELSE CAST(FORMAT('{:.2f}', GREATEST(recovered / errored, CAST(FORMAT('{:.2f}', LEAST((n - errors) / n, 0.5)) AS DOUBLE))) AS DOUBLE) END AS robustness FROM
(SELECT rollout_id, SUM(n) AS n, SUM(errors) AS errors, COUNT(*) FILTER (WHERE errors > 0) AS errored, COUNT(*) FILTER (WHERE recovered) AS recovered FROM
 (SELECT d.rollout_id, d.tool_name, COUNT(*) AS n, COUNT(*) FILTER (WHERE response_status >= 400) AS errors, BOOL_OR(response_status < 400 AND seen) AS recovered FROM
  (SELECT *, COALESCE(MAX(CASE WHEN response_status >= 400 THEN 1 ELSE 0 END) OVER (PARTITION BY rollout_id, tool_name ORDER BY ord ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) = 1 AS seen FROM dispatches) d
  GROUP BY d.rollout_id, d.tool_name) GROUP BY rollout_id)"""


@query("recovery_rate", RECOVERY)
def _(t):
    return dsp.recovery_rate(t.view("dispatches"))


AGENTS = "SELECT DISTINCT user_id AS rollout_id, user_id % 6 AS task_id FROM events"
CHECKS = """SELECT user_id % 6 AS task_id, event_type AS component, 0.25 * (1 + user_id % 6 % 3) AS weight, event_type AS tool_name, CAST(1 + user_id % 6 * 4 AS INT) AS min_calls, 5.0 AS total_weight FROM events WHERE event_type <> 'view' GROUP BY user_id % 6, event_type"""
FORBIDDEN = "SELECT DISTINCT user_id % 6 AS task_id, 'signup' AS tool_name FROM events WHERE user_id % 6 = 2"


@query("satisfied_tool_score", f"""
WITH calls AS (SELECT rollout_id, tool_name, COUNT(*) AS n FROM dispatches WHERE response_status < 400 GROUP BY rollout_id, tool_name),
k AS (SELECT a.rollout_id, a.task_id, CAST(SUM(CASE WHEN COALESCE(x.n, 0) >= q.min_calls THEN q.weight ELSE 0 END) AS DOUBLE) / 5.0 AS completion FROM ({AGENTS}) a LEFT JOIN ({CHECKS}) q ON a.task_id = q.task_id
 LEFT JOIN calls x ON x.rollout_id = a.rollout_id AND x.tool_name = q.tool_name GROUP BY a.rollout_id, a.task_id),
s AS (SELECT k.*, r.robustness, CASE WHEN k.task_id = 2 AND EXISTS (SELECT 1 FROM calls x WHERE x.rollout_id = k.rollout_id AND x.tool_name = 'signup') THEN 0.0 ELSE 1.0 END AS safety FROM k JOIN ({RECOVERY}) r ON k.rollout_id = r.rollout_id)
SELECT rollout_id, ROUND(completion, 4) AS completion, CAST(robustness AS DOUBLE) AS robustness, CAST(safety AS DOUBLE) AS safety, CAST(FORMAT('{{:.4f}}', safety * (0.8::DOUBLE * completion + 0.2::DOUBLE * robustness)) AS DOUBLE) AS value FROM s""")
def _(t):
    return dsp.satisfied_tool_score(t.sql(AGENTS), t.view("dispatches"), t.sql(CHECKS), t.sql(FORBIDDEN))


REQUIRED = "SELECT DISTINCT user_id % 6 AS task_id, event_type AS tool_name FROM events WHERE event_type IN ('purchase', 'error', 'click')"


@query("missing_required_tools", f"""
SELECT a.rollout_id, q.tool_name FROM ({AGENTS}) a JOIN ({REQUIRED}) q ON a.task_id = q.task_id
WHERE NOT EXISTS (SELECT 1 FROM dispatches d WHERE d.rollout_id = a.rollout_id AND d.tool_name = q.tool_name AND d.response_status < 400)""")
def _(t):
    return dsp.missing_required_tools(t.sql(AGENTS), t.sql(REQUIRED), t.view("dispatches"))


EVIDENCE = """SELECT doc_id, CASE doc_id % 4 WHEN 0 THEN 'claw_eval' WHEN 1 THEN 'gdpval' WHEN 2 THEN 'browsecomp' ELSE 'hle' END AS source, n_chars % 3 AS missing_tools, n_chars % 4 AS deliverables, n_chars % 2 AS gathering,
 n_chars % 5 AS executed, 1 + n_chars % 6 AS steps, n_chars % 7 AS observations, CASE WHEN n_chars % 8 = 0 THEN NULL ELSE n_chars % 8 <> 1 END AS g2, CASE WHEN n_chars % 9 = 0 THEN NULL ELSE n_chars % 9 <> 1 END AS g3 FROM documents"""


@query("genuineness", f"""
SELECT doc_id, g1, g4, CASE WHEN NOT g1 OR g2 = FALSE OR g3 = FALSE THEN 'shortcut' WHEN g4 AND g2 AND g3 THEN 'genuine' ELSE 'undetermined' END AS verdict FROM
(SELECT *, CASE source WHEN 'claw_eval' THEN missing_tools = 0 WHEN 'gdpval' THEN deliverables > 0 WHEN 'browsecomp' THEN gathering > 0 ELSE executed > 0 END AS g1, steps >= 2 AND observations >= 1 AS g4 FROM ({EVIDENCE}))""")
def _(t):
    return dsp.genuineness(t.sql(EVIDENCE)).select("doc_id", "g1", "g4", "verdict")
