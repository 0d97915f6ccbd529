"""Queries: statistics over passes, agreement, probes, report tables and decisions."""

from __future__ import annotations

from pyspark.sql import functions as F

from runlens.operators import agreement as agr
from runlens.operators import decisions as dec
from runlens.operators import report as rep
from runlens.operators import stats as sta
from runlens.plans import runs
from runlens.plans.registry import query
from runlens.plans.runs import rounded

c = F.col

# ------------------------------------------------------------------ passes


def cells_sql(view):
    return f"""SELECT a.source, a.run_id AS run_a, b.run_id AS run_b, COUNT(*) FILTER (WHERE a.pass_hat_k AND b.pass_hat_k) AS n11, COUNT(*) FILTER (WHERE a.pass_hat_k AND NOT b.pass_hat_k) AS n10,
 COUNT(*) FILTER (WHERE NOT a.pass_hat_k AND b.pass_hat_k) AS n01, COUNT(*) FILTER (WHERE NOT a.pass_hat_k AND NOT b.pass_hat_k) AS n00
 FROM ({view}) a JOIN ({view}) b ON a.source = b.source AND a.task_id = b.task_id AND a.run_id < b.run_id GROUP BY a.source, a.run_id, b.run_id"""


def bootstrap_sql(cells, n=2000):
    return f"""WITH cells AS ({cells}), sized AS (SELECT *, n11 + n10 + n01 + n00 AS m FROM cells),
seeds AS (SELECT s.*, r.rep, ('0x' || SUBSTR(sha256('0:' || source || ':' || run_a || ':' || run_b || ':' || r.rep), 1, 8))::BIGINT AS base FROM sized s JOIN (SELECT UNNEST(RANGE({n})) AS rep) r ON TRUE),
slots AS (SELECT *, UNNEST(RANGE(m)) AS slot FROM seeds),
h0 AS (SELECT source, run_a, run_b, m, n10, n01, rep, (base + slot * 2654435761) & 4294967295 AS h FROM slots),
h1 AS (SELECT * REPLACE ((XOR(h, h >> 15) * 739982445) & 4294967295 AS h) FROM h0), h2 AS (SELECT * REPLACE ((XOR(h, h >> 12) * 695872825) & 4294967295 AS h) FROM h1),
draws AS (SELECT *, XOR(h, h >> 15) % m AS pick FROM h2),
deltas AS (SELECT source, run_a, run_b, m, rep, ABS(SUM(CASE WHEN pick < n10 THEN 1 WHEN pick < n10 + n01 THEN -1 ELSE 0 END)) AS d FROM draws GROUP BY source, run_a, run_b, m, rep),
ranked AS (SELECT *, ROW_NUMBER() OVER (PARTITION BY source, run_a, run_b ORDER BY d, rep) - 1 AS rn FROM deltas),
boot AS (SELECT source, run_a, run_b, MAX(d / m * 100) FILTER (WHERE rn = {int(0.025 * n)}) AS ci_low, MAX(d / m * 100) FILTER (WHERE rn = {min(n - 1, int(0.975 * n))}) AS ci_high FROM ranked GROUP BY source, run_a, run_b)"""


TP = "SELECT source, run_id, task_id, pass_hat_k FROM task_passes"
TP3 = """SELECT p_brand AS source, 'p' || CAST(1 + l_linenumber % 3 AS STRING) AS run_id, l_partkey AS task_id, MIN(CASE WHEN l_returnflag = 'R' AND l_quantity < 20.5 THEN 0 ELSE 1 END) = 1 AS pass_hat_k
 FROM lineitem JOIN part ON l_partkey = p_partkey GROUP BY p_brand, l_linenumber % 3, l_partkey"""


@query("pair_passes", cells_sql(TP3))
def _(t):
    return sta.pair_passes(t.sql(TP3))


@query("bootstrap_delta", bootstrap_sql(cells_sql(TP)) + " SELECT source, run_a, run_b, ROUND(ci_low, 6) AS ci_low, ROUND(ci_high, 6) AS ci_high FROM boot")
def _(t):
    return rounded(sta.bootstrap_delta(sta.pair_passes(t.view("task_passes"))), "ci_low", "ci_high")


@query("aa_band", bootstrap_sql(cells_sql(TP3)) + """,
pairs AS (SELECT s.source, s.run_a, s.run_b, s.m AS tasks, (n11 + n00) / s.m AS agreement, ABS(n10 - n01) / s.m * 100 AS delta_points, b.ci_low, b.ci_high
 FROM sized s JOIN boot b ON s.source = b.source AND s.run_a = b.run_a AND s.run_b = b.run_b),
summary AS (SELECT source, NULL AS run_a, NULL AS run_b, ARG_MIN(tasks, run_a || run_b) AS tasks, AVG(CAST(FORMAT('{:.4f}', agreement) AS DOUBLE)) AS agreement, AVG(delta_points) AS delta_points,
 MIN(CAST(FORMAT('{:.2f}', ci_low) AS DOUBLE)) AS ci_low, MAX(CAST(FORMAT('{:.2f}', ci_high) AS DOUBLE)) AS ci_high FROM pairs GROUP BY source)
SELECT source, run_a, run_b, tasks, ROUND(agreement, 6) AS agreement, ROUND(delta_points, 6) AS delta_points, ROUND(ci_low, 6) AS ci_low, ROUND(ci_high, 6) AS ci_high FROM (SELECT * FROM pairs UNION ALL SELECT * FROM summary)""")
def _(t):
    return rounded(sta.aa_band(t.sql(TP3)), "agreement", "delta_points", "ci_low", "ci_high")


@query("seed_noise", """
WITH d AS (SELECT a.source, ABS(a.rate - b.rate) AS d FROM pass_rates a JOIN pass_rates b ON a.source = b.source AND a.run_id < b.run_id),
o AS (SELECT source, d, ROW_NUMBER() OVER (PARTITION BY source ORDER BY d) - 1 AS rn, COUNT(*) OVER (PARTITION BY source) AS n FROM d),
q AS (SELECT source, COUNT(*) AS pairs, AVG(d) AS abs_delta_mean, MAX(d) FILTER (WHERE rn = ROUND_EVEN(0.9::DOUBLE * (n - 1), 0)) AS p90, MAX(d) FILTER (WHERE rn = ROUND_EVEN(0.95::DOUBLE * (n - 1), 0)) AS p95 FROM o GROUP BY source)
SELECT p.source, p.passes, ROUND(p.mean_rate, 6) AS mean_rate, ROUND(p.sd, 6) AS sigma_seed, q.pairs, ROUND(q.abs_delta_mean, 6) AS abs_delta_mean, ROUND(q.p90, 6) AS abs_delta_p90, ROUND(q.p95, 6) AS abs_delta_p95
FROM (SELECT source, COUNT(*) AS passes, AVG(rate) AS mean_rate, STDDEV_SAMP(rate) AS sd FROM pass_rates GROUP BY source) p LEFT JOIN q ON p.source = q.source""")
def _(t):
    return rounded(sta.seed_noise(t.view("pass_rates")), "mean_rate", "sigma_seed", "abs_delta_mean", "abs_delta_p90", "abs_delta_p95")


@query("nearest_rank_pct", """
SELECT source, MAX(v) FILTER (WHERE rn = ROUND_EVEN(0.9::DOUBLE * (n - 1), 0)) AS pct FROM
(SELECT o_orderpriority AS source, o_totalprice AS v, ROW_NUMBER() OVER (PARTITION BY o_orderpriority ORDER BY o_totalprice) - 1 AS rn, COUNT(*) OVER (PARTITION BY o_orderpriority) AS n FROM orders) GROUP BY source""")
def _(t):
    return sta.nearest_rank_pct(t.base("orders").withColumnRenamed("o_orderpriority", "source"), ["source"], "o_totalprice", 0.9)


def p_sql(pos, neg):
    return f"""CASE WHEN {pos} + {neg} > 0 THEN LEAST(1.0, 2 * LIST_SUM([EXP(LGAMMA({pos} + {neg} + 1) - LGAMMA(i + 1) - LGAMMA({pos} + {neg} - i + 1) - ({pos} + {neg}) * LN(2.0)) FOR i IN RANGE(LEAST({pos}, {neg}) + 1)])) END"""


SIGNS = """SELECT source, COUNT(*) FILTER (WHERE d > 0) AS positive, COUNT(*) FILTER (WHERE d < 0) AS negative FROM (SELECT source, reference_score - coherent_score AS d FROM score_pairs) GROUP BY source"""


@query("sign_test", f"SELECT source, positive, negative, ROUND({p_sql('positive', 'negative')}, 6) AS p FROM ({SIGNS})")
def _(t):
    effects = t.view("score_pairs").withColumn("diff", c("reference_score") - c("coherent_score"))
    return rounded(sta.sign_test(effects, ["source"]), "p")


def parity_sql(keys, source="score_pairs"):
    return f"""SELECT *, CONCAT_WS('; ', CASE WHEN n = 0 THEN 'no scored pairs' END, CASE WHEN ABS(mean_difference) > 0.3 + 1e-9 THEN 'mean difference ' || PRINTF('%+.2f', mean_difference) || ' outside +-0.3' END,
  CASE WHEN sign_test_p < 0.1 THEN 'sign test p=' || PRINTF('%.3f', sign_test_p) || ' < 0.1' END) AS reasons FROM
 (SELECT *, {p_sql('reference_higher', 'coherent_higher')} AS sign_test_p FROM (SELECT {keys}, COUNT(d) AS n, AVG(d) AS mean_difference, COUNT(*) FILTER (WHERE d > 0) AS reference_higher,
  COUNT(*) FILTER (WHERE d < 0) AS coherent_higher, COUNT(*) FILTER (WHERE d = 0) AS ties FROM (SELECT *, reference_score - coherent_score AS d FROM {source}) GROUP BY {keys}))"""


@query("parity", f"""SELECT source, n, ROUND(mean_difference, 6) AS mean_difference, reference_higher, coherent_higher, ties, ROUND(sign_test_p, 6) AS sign_test_p, reasons, reasons = '' AS ok FROM ({parity_sql('source')})""")
def _(t):
    return rounded(sta.parity(t.view("score_pairs")), "mean_difference", "sign_test_p")


POOLED = f"""SELECT b.*, f.rounds FROM ({parity_sql('source, generation_seed')}) b JOIN (SELECT source, final, (SELECT COUNT(DISTINCT generation_seed) FROM score_pairs s WHERE s.source = x.source AND s.generation_seed <= x.final) AS rounds FROM
 (SELECT source, COALESCE(MIN(generation_seed) FILTER (WHERE reasons = ''), MAX(generation_seed)) AS final FROM ({parity_sql('source, generation_seed')}) GROUP BY source) x) f
 ON b.source = f.source AND b.generation_seed = f.final"""


@query("pooled_parity", f"""
SELECT source, generation_seed AS final_generation_seed, rounds, n, ROUND(mean_difference, 6) AS mean_difference, ROUND(sign_test_p, 6) AS sign_test_p, reasons = '' AS ok, reasons <> '' AS persistent_violation FROM ({POOLED})""")
def _(t):
    rows = sta.pooled_parity(t.view("score_pairs"))
    return rounded(rows, "mean_difference", "sign_test_p").select(
        "source", "final_generation_seed", "rounds", "n", "mean_difference", "sign_test_p", "ok", "persistent_violation")


@query("parity_table", f"""
SELECT source, rounds, generation_seed AS final_generation_seed, n, ROUND(mean_difference, 6) AS mean_difference, reference_higher, coherent_higher, ties, ROUND(sign_test_p, 6) AS sign_test_p,
 CASE WHEN reasons = '' THEN 'ok' ELSE 'PERSISTENT VIOLATION' END AS status FROM ({POOLED})""")
def _(t):
    return rounded(rep.parity_table(sta.pooled_parity(t.view("score_pairs"))), "mean_difference", "sign_test_p")


GENERATED = """SELECT 'b' || CAST(doc_id % 4 AS STRING) AS source, 'p' || CAST(1 + doc_id % 2 AS STRING) AS run_id, doc_id AS cluster_id, source AS decoy_component, 1 + n_chars % 7 AS decoy_step,
 CASE WHEN n_chars % 2 = 0 THEN 'validated_negative' ELSE 'not_sufficient' END AS step_basis, lang AS cause_label, CASE WHEN n_chars % 3 = 0 THEN 'high' ELSE 'low' END AS severity, doc_id % 3 AS generation_seed FROM documents"""
COHERENT_SCORES = "SELECT *, CASE WHEN reference_score IS NULL THEN 'no reference score' END AS error FROM score_pairs"


@query("coherent_table", f"""
SELECT g.*, s.reference_score, s.coherent_score, s.error FROM ({GENERATED}) g JOIN ({POOLED}) p ON g.source = p.source AND g.generation_seed = p.generation_seed
LEFT JOIN ({COHERENT_SCORES}) s ON s.source = g.source AND s.cluster_id = g.cluster_id AND s.generation_seed = g.generation_seed""")
def _(t):
    return rep.coherent_table(t.sql(GENERATED), t.sql(COHERENT_SCORES), sta.pooled_parity(t.view("score_pairs")))


EFFECTS = "SELECT conv_id, turn, LENGTH(text) % 17 - 7.5 AS effect FROM conversations"


@query("sign_flip_p", f"""
WITH e AS (SELECT conv_id, CAST(effect AS DOUBLE) AS effect, ROW_NUMBER() OVER (PARTITION BY conv_id ORDER BY turn) - 1 AS i, COUNT(*) OVER (PARTITION BY conv_id) AS n FROM ({EFFECTS})),
g AS (SELECT conv_id, ABS(SUM(effect)) AS observed, MAX(n) AS n FROM e GROUP BY conv_id), k AS (SELECT g.*, UNNEST(RANGE(CAST(POWER(2, n) AS BIGINT))) AS code FROM g),
s AS (SELECT k.conv_id, k.code, k.n, k.observed, ABS(SUM(CASE WHEN (k.code >> e.i) & 1 = 1 THEN e.effect ELSE -e.effect END)) AS total FROM k JOIN e ON k.conv_id = e.conv_id GROUP BY k.conv_id, k.code, k.n, k.observed)
SELECT conv_id, n, ROUND(AVG(CASE WHEN total >= observed - 1e-12 THEN 1.0 ELSE 0.0 END), 6) AS p FROM s GROUP BY conv_id, n""")
def _(t):
    return rounded(sta.sign_flip_p(t.sql(EFFECTS), ["conv_id"]), "p")


# ------------------------------------------------------------------ agreement and probes


@query("judge_agreement", """
SELECT source, compared, agree, ROUND(1 - agree / compared, 6) AS disagreement FROM
(SELECT source, COUNT(*) FILTER (WHERE text_passed IS NOT NULL AND vision_passed IS NOT NULL) AS compared, COUNT(*) FILTER (WHERE text_passed = vision_passed) AS agree FROM judge_verdicts GROUP BY source)""")
def _(t):
    return rounded(agr.judge_agreement(t.view("judge_verdicts"), ["source"], "text_passed", "vision_passed"), "disagreement")


CONSISTENCY = """SELECT 'text' AS judge, COUNT(*) AS artifacts, COUNT(*) FILTER (WHERE text_again IS NOT NULL) AS rejudged, COUNT(*) FILTER (WHERE text_again = text_passed) / COUNT(text_again) AS self_consistency FROM judge_verdicts
UNION ALL SELECT 'vision', COUNT(*), COUNT(*) FILTER (WHERE vision_again IS NOT NULL AND vision_passed IS NOT NULL), COUNT(*) FILTER (WHERE vision_again = vision_passed) / COUNT(*) FILTER (WHERE vision_again IS NOT NULL AND vision_passed IS NOT NULL) FROM judge_verdicts"""
JUDGES = {"text": ("text_passed", "text_again"), "vision": ("vision_passed", "vision_again")}


@query("judge_self_consistency", f"SELECT judge, artifacts, rejudged, ROUND(self_consistency, 6) AS self_consistency FROM ({CONSISTENCY})")
def _(t):
    return rounded(agr.judge_self_consistency(t.view("judge_verdicts"), JUDGES), "self_consistency")


def scored_probes(t):
    rows = t.view("probe_records")
    tools = lambda a, b: F.array_compact(F.array(a, b))
    return agr.probe_scores(rows.select(
        "*", F.array("guess1", "guess2", "guess3").alias("task_top3"), tools("tool_a", "tool_b").alias("guessed_tools"),
        tools("need_a", "need_b").alias("required_tools")))


SCORED = """SELECT *, guess1 = assigned_task AS hit_top1, assigned_task IN (guess1, guess2, guess3) AS hit_top3, guess1 = origin_task AS origin_hit_top1, origin_task IN (guess1, guess2, guess3) AS origin_hit_top3,
 hits / NULLIF(guessed, 0) AS tool_precision, hits / NULLIF(needed, 0) AS tool_recall, LOWER(TRIM(guessed_category)) = LOWER(TRIM(true_category)) AS category_hit FROM
(SELECT *, CASE WHEN tool_a IS NULL THEN 0 WHEN tool_a = tool_b THEN 1 ELSE 2 END AS guessed, CASE WHEN need_a IS NULL THEN 0 WHEN need_a = need_b THEN 1 ELSE 2 END AS needed,
 CASE WHEN tool_a IS NULL OR need_a IS NULL THEN 0 ELSE CASE WHEN tool_a IN (need_a, need_b) THEN 1 ELSE 0 END + CASE WHEN tool_b <> tool_a AND tool_b IN (need_a, need_b) THEN 1 ELSE 0 END END AS hits FROM probe_records)"""
SCORE_COLS = "source, run_id, cluster_id, arm, hit_top1, hit_top3, origin_hit_top1, origin_hit_top3, ROUND(tool_precision, 6) AS tool_precision, ROUND(tool_recall, 6) AS tool_recall, category_hit"


@query("probe_scores", f"SELECT {SCORE_COLS} FROM ({SCORED})")
def _(t):
    return rounded(scored_probes(t), "tool_precision", "tool_recall").select(
        "source", "run_id", "cluster_id", "arm", "hit_top1", "hit_top3", "origin_hit_top1", "origin_hit_top3",
        "tool_precision", "tool_recall", "category_hit")


POOLS = "SELECT source, run_id, COUNT(DISTINCT assigned_task) AS pool_size FROM probe_records GROUP BY source, run_id"


@query("probe_rates", f"""
SELECT source, arm, COUNT(*) AS n, ROUND(AVG(CAST(hit_top1 AS INT)), 6) AS task_top1, ROUND(AVG(CAST(hit_top3 AS INT)), 6) AS task_top3, ROUND(AVG(CAST(origin_hit_top1 AS INT)), 6) AS origin_top1,
 ROUND(AVG(tool_precision), 6) AS tool_precision, ROUND(AVG(tool_recall), 6) AS tool_recall, ROUND(AVG(CAST(category_hit AS INT)), 6) AS category_hit,
 ROUND(1.0 / GREATEST(1, ANY_VALUE(pool_size)), 6) AS chance_top1, ROUND(LEAST(1.0, 3.0 / GREATEST(1, ANY_VALUE(pool_size))), 6) AS chance_top3
FROM ({SCORED}) LEFT JOIN (SELECT source, ARG_MAX(pool_size, run_id) AS pool_size FROM ({POOLS}) GROUP BY source) USING (source) WHERE error IS NULL GROUP BY source, arm""")
def _(t):
    rates = agr.probe_rates(scored_probes(t), pools=t.sql(POOLS))
    return rounded(rates, "task_top1", "task_top3", "origin_top1", "tool_precision", "tool_recall", "category_hit", "chance_top1", "chance_top3")


@query("pair_probe_arms", f"""
SELECT a.source, a.run_id, a.cluster_id, CAST(a.hit_top1 AS INT) AS ref_top1, CAST(b.hit_top1 AS INT) AS self_top1, CAST(a.hit_top3 AS INT) AS ref_top3, CAST(b.hit_top3 AS INT) AS self_top3,
 CAST(a.hit_top1 AS INT) - CAST(b.hit_top1 AS INT) AS gap_top1, CAST(a.hit_top3 AS INT) - CAST(b.hit_top3 AS INT) AS gap_top3
FROM ({SCORED}) a JOIN ({SCORED}) b ON a.source = b.source AND a.run_id = b.run_id AND a.cluster_id = b.cluster_id WHERE a.arm = 'reference' AND b.arm = 'system' AND a.error IS NULL AND b.error IS NULL""")
def _(t):
    return agr.pair_probe_arms(scored_probes(t))


LEAKS = """SELECT d.source AS true_component, 'b' || CAST(doc_id % 4 AS STRING) AS source, 'p1' AS run_id, 'src' || CAST(n_chars % 20 AS STRING) AS g1, 'src' || CAST(n_chars % 7 AS STRING) AS g2, 'src' || CAST(doc_id % 20 AS STRING) AS g3,
 CASE WHEN n_chars % 10 = 0 THEN 'bad' END AS error FROM documents d"""


@query("leakage_rates", f"""
SELECT source, run_id, COUNT(*) FILTER (WHERE error IS NULL) AS n, ROUND(AVG(CASE WHEN error IS NULL THEN CAST(g1 = true_component AS INT) END), 6) AS top1_rate,
 ROUND(AVG(CASE WHEN error IS NULL THEN CAST(true_component IN (g1, g2, g3) AS INT) END), 6) AS top3_rate, ROUND(1 / (SELECT COUNT(*) FROM components WHERE patchable AND where_eligible), 6) AS chance_top1 FROM ({LEAKS}) GROUP BY source, run_id""")
def _(t):
    rows = t.sql(LEAKS).withColumn("top3", F.array("g1", "g2", "g3"))
    return rounded(agr.leakage_rates(rows, t.view("components")), "top1_rate", "top3_rate", "chance_top1")


# ------------------------------------------------------------------ report tables

SCORE_ROWS = "SELECT source, run_id, task_id, replicate, attempt, passed, value FROM rollouts WHERE passed IS NOT NULL"


@query("attach_scores", "SELECT source, run_id, task_id, replicate, attempt, steps, passed, ROUND(value, 6) AS value FROM rollouts")
def _(t):
    keys = ["source", "run_id", "task_id", "replicate", "attempt"]
    records = t.view("rollouts").select(*keys, "steps")
    return rounded(rep.attach_scores(records, t.sql(SCORE_ROWS), keys), "value")


@query("stage_seconds", """
SELECT run_id, ROUND(CASE WHEN s IS NOT NULL AND e IS NOT NULL THEN GREATEST(0.0, (EPOCH_US(e) - EPOCH_US(s)) / 1000000.0) END, 6) AS seconds FROM
(SELECT run_id, ARG_MAX(ts, ord) FILTER (WHERE event = 'run_start') AS s, ARG_MAX(ts, ord) FILTER (WHERE event = 'run_done') AS e FROM stage_log WHERE event IN ('run_start', 'run_done') GROUP BY run_id)""")
def _(t):
    return rounded(rep.stage_seconds(t.view("stage_log"), "run_start", "run_done"), "seconds")


RUN_NAMES = """SELECT DISTINCT p_brand AS source, 'p' || CAST(1 + p_size % 10 AS STRING) AS run_id, 'p' || CAST(11 + p_size % 10 AS STRING) AS reference_run_id FROM part"""
ONE_RUN = f"SELECT source, MIN(run_id) AS run_id, MIN(reference_run_id) AS reference_run_id FROM ({RUN_NAMES}) q GROUP BY source"
REPLAYS = """SELECT p_brand AS source, CAST(l_orderkey AS STRING) || '/r' || CAST(l_linenumber AS STRING) || '/' ||
 CAST(ROW_NUMBER() OVER (PARTITION BY l_orderkey, l_linenumber ORDER BY l_suppkey, l_partkey, l_extendedprice, l_quantity, l_discount, l_tax, l_shipdate, l_returnflag, l_linestatus) AS STRING) AS failure_key, CAST(l_quantity AS INT) AS q,
 CASE CAST(l_quantity AS INT) % 5 WHEN 0 THEN 'deterministic' WHEN 1 THEN 'stochastic' WHEN 2 THEN 'unrepairable' WHEN 3 THEN 'unreplayable' ELSE 'unresolved' END AS failure_type,
 CASE WHEN CAST(l_quantity AS INT) % 5 < 2 THEN 1 + l_suppkey % 4 END AS oracle_step, 1 + l_suppkey % 5 AS candidates, CAST(l_extendedprice AS DECIMAL(18,6)) AS usd FROM lineitem JOIN part ON l_partkey = p_partkey"""
GENUINE = """SELECT p_brand AS source, l_partkey AS task_id, CASE WHEN l_quantity < 20.5 THEN 'genuine' WHEN l_quantity < 40.5 THEN 'shortcut' ELSE 'undetermined' END AS verdict FROM lineitem JOIN part ON l_partkey = p_partkey"""
TIMES_SQL = f"""SELECT run_id, {', '.join(f"CASE WHEN {a} IS NOT NULL AND {b} IS NOT NULL THEN GREATEST(0.0, (EPOCH_US({b}) - EPOCH_US({a})) / 1000000.0) END AS {n}" for n, a, b in
 (('run_wall_s', 'run_start', 'run_done'), ('replay_wall_s', 'replay_start', 'replay_done'), ('diagnosis_wall_s', 'run_done', 'diagnosis_done')))} FROM
 (SELECT run_id, {', '.join(f"ARG_MAX(ts, ord) FILTER (WHERE event = '{e}') AS {e}" for e in ('run_start', 'run_done', 'replay_start', 'replay_done', 'diagnosis_done'))} FROM stage_log GROUP BY run_id)"""
PILOT_TIME = f"""SELECT r.source, w.rollouts, 4 AS workers, t.run_wall_s, w.wall AS rollout_wall_sum_s, f.run_wall_s AS reference_wall_s, t.replay_wall_s, t.replay_wall_s / p.n AS replay_wall_s_per_failure, t.diagnosis_wall_s
FROM ({ONE_RUN}) r LEFT JOIN ({TIMES_SQL}) t ON r.run_id = t.run_id LEFT JOIN ({TIMES_SQL}) f ON r.reference_run_id = f.run_id
LEFT JOIN (SELECT source, COUNT(*) AS rollouts, SUM(duration_seconds) AS wall FROM rollouts WHERE run_id = 'p1' GROUP BY source) w ON r.source = w.source
LEFT JOIN (SELECT source, COUNT(*) AS n FROM ({REPLAYS}) GROUP BY source) p ON r.source = p.source"""
TIME_COLS = ["run_wall_s", "rollout_wall_sum_s", "reference_wall_s", "replay_wall_s", "replay_wall_s_per_failure", "diagnosis_wall_s"]


def pilot_times(t):
    walls = t.view("rollouts").where(c("run_id") == "p1").groupBy("source").agg(
        F.count(F.lit(1)).alias("rollouts"), F.sum("duration_seconds").alias("wall_s_total"))
    replayed = t.sql(REPLAYS).groupBy("source").agg(F.count(F.lit(1)).alias("failures_replayed"))
    return rep.pilot_time(t.view("stage_log"), t.sql(ONE_RUN), walls, replayed)


@query("pilot_time", f"SELECT * REPLACE ({', '.join(f'ROUND({m}, 4) AS {m}' for m in TIME_COLS)}) FROM ({PILOT_TIME})")
def _(t):
    rows = pilot_times(t)
    for m in TIME_COLS:
        rows = rows.withColumn(m, F.round(m, 4))
    return rows


PILOT = f"""SELECT r.source, r.tasks, r.rollouts, r.passed / r.scored AS rollout_pass_rate, r.pass_hat_k_tasks / r.tasks AS pass_hat_k_rate, r.policy_usd_mean, r.policy_usd_median, r.policy_usd_max, r.policy_usd_total,
 r.wall_s_mean, r.wall_s_median, r.wall_s_max, r.judge_usd, r.judge_calls, r.judge_cached, r.harness_failures, COALESCE(f.n, 0) AS failed_tasks, COALESCE(x.rollouts, 0) AS reference_rollouts,
 COALESCE(x.policy_usd_total + x.judge_usd, 0) AS reference_usd, COALESCE(x.policy_usd_total + x.judge_usd, 0) / NULLIF(f.n, 0) AS reference_usd_per_failed_task, COALESCE(g.n, 0) AS genuine_references, COALESCE(p.n, 0) AS failures_replayed,
 COALESCE(p.usd, 0) AS replay_usd, COALESCE(p.usd, 0) / NULLIF(p.n, 0) AS replay_usd_per_failure, r.replay_rollouts, r.diagnosis_usd + COALESCE(x.diagnosis_usd, 0) AS diagnosis_usd,
 (r.diagnosis_usd + COALESCE(x.diagnosis_usd, 0)) / NULLIF(p.n, 0) AS diagnosis_usd_per_failure, COALESCE(p.a, 0) AS ft_deterministic, COALESCE(p.b, 0) AS ft_stochastic, COALESCE(p.c, 0) AS ft_unrepairable, COALESCE(p.d, 0) AS ft_unreplayable,
 r.infra_failures, r.usage_mismatch, r.partial, r.search_calls, r.search_usd,
 r.policy_usd_total + r.judge_usd + COALESCE(x.policy_usd_total + x.judge_usd, 0) + COALESCE(p.usd, 0) + r.diagnosis_usd + COALESCE(x.diagnosis_usd, 0) + r.search_usd AS source_total_usd
FROM (SELECT * FROM ({runs.RUN_AGG}) WHERE run_id = 'p1') r LEFT JOIN (SELECT * FROM ({runs.RUN_AGG}) WHERE run_id = 'p2') x ON r.source = x.source
LEFT JOIN (SELECT source, COUNT(DISTINCT task_id) AS n FROM ({runs.FAILS}) WHERE run_id = 'p1' AND family <> 'infra' GROUP BY source) f ON r.source = f.source
LEFT JOIN (SELECT source, COUNT(*) AS n, CAST(SUM(usd) AS DOUBLE) AS usd, COUNT(*) FILTER (WHERE failure_type = 'deterministic') AS a, COUNT(*) FILTER (WHERE failure_type = 'stochastic') AS b,
 COUNT(*) FILTER (WHERE failure_type = 'unrepairable') AS c, COUNT(*) FILTER (WHERE failure_type = 'unreplayable') AS d FROM ({REPLAYS}) GROUP BY source) p ON r.source = p.source
LEFT JOIN (SELECT source, COUNT(*) FILTER (WHERE verdict = 'genuine') AS n FROM ({GENUINE}) GROUP BY source) g ON r.source = g.source"""
PILOT_COLS = ["rollout_pass_rate", "pass_hat_k_rate", "policy_usd_mean", "policy_usd_median", "policy_usd_total", "wall_s_mean", "wall_s_median", "judge_usd", "reference_usd",
              "reference_usd_per_failed_task", "replay_usd", "replay_usd_per_failure", "diagnosis_usd", "diagnosis_usd_per_failure", "search_usd", "source_total_usd"]


def pilot_profile(t):
    profiles = runs.run_profiles(t)
    return rep.pilot_cost(profiles.where(c("run_id") == "p1"), profiles.where(c("run_id") == "p2"),
                          t.sql(runs.FAILS).where(c("run_id") == "p1"), t.sql(REPLAYS), t.sql(GENUINE))


@query("pilot_cost", f"SELECT * REPLACE ({', '.join(f'ROUND({m}, 4) AS {m}' for m in PILOT_COLS)}) FROM ({PILOT})")
def _(t):
    rows = pilot_profile(t)
    for m in PILOT_COLS:
        rows = rows.withColumn(m, F.round(m, 4))
    return rows


EXTRA_COLS = ["expected_failures", "policy_usd_b1", "policy_usd_b2", "judge_usd_est", "reference_usd_est", "replay_usd_est", "diagnosis_usd_est", "total_usd", "wall_hours"]
EXTRAPOLATED = f"""WITH pilot AS ({PILOT}), times AS ({PILOT_TIME}),
u AS (SELECT p.*, COALESCE(t.replay_wall_s_per_failure, 0) AS rw, 64 AS b1, 60 AS b2, COALESCE(1 - p.rollout_pass_rate, 0) AS fail, COALESCE(p.policy_usd_mean, 0) AS unit, p.judge_usd / p.rollouts AS ju, p.failed_tasks / p.tasks AS fs FROM pilot p LEFT JOIN times t ON p.source = t.source),
e AS (SELECT source, CAST(b1 AS BIGINT) AS b1_rollouts, CAST(b2 AS BIGINT) AS b2_rollouts, fail AS rollout_fail_rate, 64 * fs AS expected_failed_tasks, b1 * fail AS expected_failures, b1 * unit AS policy_usd_b1, b2 * unit AS policy_usd_b2, (b1 + b2) * ju AS judge_usd_est,
 64 * fs * COALESCE(reference_usd_per_failed_task, 0) AS reference_usd_est, b1 * fail * COALESCE(replay_usd_per_failure, 0) AS replay_usd_est, b1 * fail * COALESCE(diagnosis_usd_per_failure, 0) AS diagnosis_usd_est, unit, rw, wall_s_mean FROM u),
x AS (SELECT *, policy_usd_b1 + policy_usd_b2 + judge_usd_est + reference_usd_est + replay_usd_est + diagnosis_usd_est AS total_usd,
 ((b1_rollouts + b2_rollouts) * wall_s_mean / 4 + expected_failures * rw / 4 + reference_usd_est / GREATEST(unit, 1e-9) * wall_s_mean / 4) / 3600 AS wall_hours FROM e)"""


@query("extrapolate_cost", f"""{EXTRAPOLATED}
SELECT source, b1_rollouts, b2_rollouts, ROUND(rollout_fail_rate, 4) AS rollout_fail_rate, ROUND(expected_failed_tasks, 4) AS expected_failed_tasks, {', '.join(f'ROUND({m}, 3) AS {m}' for m in EXTRA_COLS)} FROM x
UNION ALL SELECT 'TOTAL', CAST(SUM(b1_rollouts) AS BIGINT), CAST(SUM(b2_rollouts) AS BIGINT), NULL, NULL, {', '.join(f'ROUND(SUM({m}), 3)' for m in EXTRA_COLS)} FROM x""")
def _(t):
    rows = rep.extrapolate_cost(pilot_profile(t), pilot_times(t))
    for m in EXTRA_COLS:
        rows = rows.withColumn(m, F.round(m, 3))
    return rows.withColumn("rollout_fail_rate", F.round("rollout_fail_rate", 4)).withColumn(
        "expected_failed_tasks", F.round("expected_failed_tasks", 4))


@query("failure_type_counts", f"""
SELECT s.source, y.failure_type, COUNT(r.failure_key) AS count FROM (SELECT DISTINCT source FROM ({REPLAYS})) s CROSS JOIN (SELECT UNNEST(['deterministic','stochastic','unrepairable','unreplayable']) AS failure_type) y
LEFT JOIN ({REPLAYS}) r ON r.source = s.source AND r.failure_type = y.failure_type GROUP BY s.source, y.failure_type""")
def _(t):
    return rep.failure_type_counts(t.sql(REPLAYS))


@query("reference_rates", f"""
SELECT COALESCE(f.source, g.source) AS source, COALESCE(f.failed_tasks, 0) AS failed_tasks, COALESCE(g."references", 0) AS "references", COALESCE(genuine, 0) AS genuine, COALESCE(shortcut, 0) AS shortcut, COALESCE(undetermined, 0) AS undetermined FROM
(SELECT source, COUNT(DISTINCT task_id) AS failed_tasks FROM ({runs.FAILS}) WHERE family <> 'infra' GROUP BY source) f FULL JOIN
(SELECT source, COUNT(*) AS "references", COUNT(*) FILTER (WHERE verdict = 'genuine') AS genuine, COUNT(*) FILTER (WHERE verdict = 'shortcut') AS shortcut, COUNT(*) FILTER (WHERE verdict = 'undetermined') AS undetermined FROM ({GENUINE}) GROUP BY source) g ON f.source = g.source""")
def _(t):
    return rep.reference_rates(t.sql(runs.FAILS), t.sql(GENUINE))


BRAND_CANDS = "SELECT 'Brand#' || CAST(1 + CAST(SUBSTR(source, 2) AS INT) AS STRING) AS source, failure_key, k, ctl_passed, ctl_scored, ctl_skipped FROM candidates"


@query("replay_table", f"""
SELECT a.source, failures_replayed, oracle_validated, deterministic, stochastic, unrepairable, unreplayable, ROUND(mean_candidates, 6) AS mean_candidates, COALESCE(b.n, 0) AS full_arms_failures, ROUND(b.m, 6) AS control_pass_fraction_mean FROM
(SELECT source, COUNT(*) AS failures_replayed, COUNT(oracle_step) AS oracle_validated, COUNT(*) FILTER (WHERE failure_type = 'deterministic') AS deterministic, COUNT(*) FILTER (WHERE failure_type = 'stochastic') AS stochastic,
 COUNT(*) FILTER (WHERE failure_type = 'unrepairable') AS unrepairable, COUNT(*) FILTER (WHERE failure_type = 'unreplayable') AS unreplayable, AVG(candidates) AS mean_candidates FROM ({REPLAYS}) GROUP BY source) a
LEFT JOIN (SELECT source, COUNT(DISTINCT failure_key) AS n, AVG(ctl_passed / 3) FILTER (WHERE NOT ctl_skipped AND ctl_scored > 0) AS m FROM ({BRAND_CANDS}) GROUP BY source) b ON a.source = b.source""")
def _(t):
    return rounded(rep.replay_table(t.sql(REPLAYS), t.sql(BRAND_CANDS)), "mean_candidates", "control_pass_fraction_mean")


REOPENED = f"""SELECT source, 'p1' AS run_id, failure_key, failure_type AS type_before, CASE WHEN q % 3 = 0 THEN 'unresolved' ELSE failure_type END AS type_after, oracle_step AS oracle_before,
 CASE WHEN q % 4 = 0 THEN NULL ELSE oracle_step END AS oracle_after, usd FROM ({REPLAYS}) z"""
MOVES = f"""SELECT source, 'p1' AS run_id, CASE q % 3 WHEN 0 THEN 'positive' WHEN 1 THEN 'negative' ELSE 'unresolved' END AS before, CASE q % 5 WHEN 0 THEN 'positive' WHEN 1 THEN 'negative' ELSE 'unresolved' END AS after FROM ({REPLAYS}) z"""


@query("escalation_table", f"""
SELECT a.*, m.candidates_reopened, m.verdict_transitions FROM (SELECT source, run_id, COUNT(*) AS failures_reopened, COUNT(*) FILTER (WHERE type_before IS DISTINCT FROM type_after) AS failure_type_changed,
 COUNT(*) FILTER (WHERE oracle_before IS DISTINCT FROM oracle_after) AS oracle_step_changed, ROUND(CAST(SUM(usd) AS DOUBLE), 6) AS usd FROM ({REOPENED}) GROUP BY source, run_id) a
JOIN (SELECT source, run_id, CAST(SUM(n) AS BIGINT) AS candidates_reopened, '{{' || STRING_AGG('"' || move || '": ' || n, ', ' ORDER BY '"' || move || '": ' || n) || '}}' AS verdict_transitions FROM
 (SELECT source, run_id, before || '->' || after AS move, COUNT(*) AS n FROM ({MOVES}) GROUP BY source, run_id, before || '->' || after) GROUP BY source, run_id) m ON a.source = m.source AND a.run_id = m.run_id""")
def _(t):
    return rounded(rep.escalation_table(t.sql(REOPENED), t.sql(MOVES)), "usd")


@query("drift_reasons", f"""
SELECT source, failure_key, failure_type, oracle_step, CASE WHEN oracle_step IS NULL THEN 'none' ELSE 'replay' END AS oracle_step_basis, 2 AS candidates,
 '1:' || CASE WHEN q % 3 = 0 THEN 'skipped' ELSE 'tested' END || ';' || (2 + q % 5) || ':tested' AS statuses, CASE WHEN q % 3 = 0 THEN 0 ELSE 1 END + CASE WHEN q % 6 = 1 THEN 2 ELSE 0 END AS unreplayable_trials,
 CASE q % 4 WHEN 0 THEN '' WHEN 1 THEN 'exit_code_differs=2' WHEN 2 THEN 'exit_code_differs=1;mutating_or_quoted_output_differs=2' ELSE 'mutating_or_quoted_output_differs=1' END AS drift_reasons,
 CAST(usd AS DOUBLE) AS usd FROM ({REPLAYS})""")
def _(t):
    drift = lambda *names: F.struct(F.array(*[F.struct(F.lit(n).alias("reason")) for n in names]).alias("drifts"))
    e, m = "exit_code_differs", "mutating_or_quoted_output_differs"
    none = F.struct(F.array().cast("array<struct<reason:string>>").alias("drifts"))
    case = lambda *reports: F.create_map(*[x for i, r in enumerate(reports) for x in (F.lit(f"r{i}"), r)])
    k = c("q") % 4
    reports = (F.when(k == 0, case(none, none)).when(k == 1, case(drift(e), drift(e)))
               .when(k == 2, case(drift(e, m), drift(m))).otherwise(case(none, drift(m))))

    def arm(*statuses):
        return F.struct(F.array(*[F.struct(x.alias("status")) for x in statuses]).alias("rollouts"))

    def candidate(step, status, substitute, control):
        return F.struct(step.cast("int").alias("step"), status.alias("status"), substitute.alias("substitute"), control.alias("control"))

    lost, ok = F.lit("unreplayable"), F.lit("passed")
    skipped = c("q") % 3 == 0
    candidates = F.array(
        candidate(F.lit(1), F.when(skipped, "skipped").otherwise("tested"), arm(F.when(skipped, ok).otherwise(lost), ok), arm(ok)),
        candidate(2 + c("q") % 5, F.lit("tested"), arm(F.when(c("q") % 6 == 1, lost).otherwise(ok)), arm(F.when(c("q") % 6 == 1, lost).otherwise(ok), ok)))
    rows = t.sql(REPLAYS).withColumns({
        "oracle_step_basis": F.when(c("oracle_step").isNull(), "none").otherwise("replay"), "drift_reports": reports, "candidates": candidates})
    return rep.drift_table(rows)


EARLIER = f"""SELECT source, CASE WHEN q % 2 = 0 THEN 'p1' ELSE 'p2' END AS run_id, failure_key, failure_type FROM ({REPLAYS}) z"""
LATER = f"""SELECT source, CASE WHEN q % 2 = 0 THEN 'p1' ELSE 'p3' END AS run_id, failure_key, CASE WHEN q % 3 = 0 AND failure_type = 'unresolved' THEN 'stochastic' ELSE failure_type END AS failure_type FROM ({REPLAYS}) z"""
TRIED = f"""SELECT source, CASE WHEN q % 2 = 0 THEN 'p1' ELSE 'p3' END AS run_id, CASE q % 4 WHEN 0 THEN 'skipped' WHEN 1 THEN 'unreplayable' ELSE 'tested' END AS status, q % 5 = 2 AS confirmed FROM ({REPLAYS}) z"""


@query("reopened_types", f"""
WITH b AS (SELECT source, failure_type FROM ({EARLIER}) WHERE run_id = 'p1' UNION ALL SELECT source, failure_type FROM ({LATER}) WHERE run_id = 'p3'), a AS (SELECT source, failure_type FROM ({LATER})),
s AS (SELECT DISTINCT source FROM a), y AS (SELECT UNNEST(['deterministic','stochastic','unrepairable','unreplayable','unresolved']) AS failure_type),
k AS (SELECT source, COUNT(*) FILTER (WHERE confirmed) AS yes, COUNT(*) FILTER (WHERE NOT confirmed) AS no FROM ({TRIED}) WHERE status = 'tested' GROUP BY source)
SELECT s.source, y.failure_type, (SELECT COUNT(*) FROM b WHERE b.source = s.source AND b.failure_type = y.failure_type) AS before, (SELECT COUNT(*) FROM a WHERE a.source = s.source AND a.failure_type = y.failure_type) AS after FROM s, y
UNION ALL SELECT s.source, 'candidates_confirmed_n>=5', NULL, COALESCE(yes, 0) FROM s LEFT JOIN k USING (source) UNION ALL SELECT s.source, 'candidates_unconfirmed_fixed_k', NULL, COALESCE(no, 0) FROM s LEFT JOIN k USING (source)""")
def _(t):
    return rep.reopened_types(t.sql(EARLIER), t.sql(LATER), t.sql(TRIED))


@query("failure_priority", f"SELECT f.source, f.run_id, f.task_id, f.replicate, f.attempt, n.priority FROM ({runs.FAILS}) f JOIN (SELECT task_id, COUNT(*) AS priority FROM ({runs.FAILS}) GROUP BY task_id) n ON f.task_id = n.task_id")
def _(t):
    return rep.failure_priority(t.sql(runs.FAILS)).select("source", "run_id", "task_id", "replicate", "attempt", "priority").orderBy(
        c("priority").desc(), "source", "run_id", "task_id", "replicate", "attempt")


FUNNEL_REPLAYS = f"SELECT *, q % 3 = 0 AS has_positive, q % 4 = 0 AS has_unresolved FROM ({REPLAYS}) z"
FUNNEL_CLUSTERS = "SELECT 'Brand#' || CAST(1 + LENGTH(component) * members % 25 AS STRING) AS source, members FROM clusters"
FUNNEL_ARMS = "SELECT 'Brand#' || CAST(1 + c.members % 25 AS STRING) AS source, a.arm, a.impossible FROM arm_assignments a JOIN clusters c ON a.cluster_id = c.cluster_id"
FEASIBLE = {"corrupt_where_near": "feasible_where_near", "corrupt_where_far": "feasible_where_far", "corrupt_why": "feasible_why", "corrupt_how": "feasible_how", "shuffled": "feasible_shuffled", "coherent_wrong": "feasible_coherent_wrong"}
FUNNEL_COLS = ["failed_rollouts", "failed_tasks", "genuine_references", "replayable", "validated_positive", "validated_negative", "unresolved", "unreplayable", "clusters", "clusters_ge2", *FEASIBLE.values()]


@query("measurability_funnel", f"""
SELECT r.source, r.rollouts, {', '.join(f'COALESCE({x}, 0) AS {x}' for x in FUNNEL_COLS)} FROM (SELECT source, COUNT(*) AS rollouts FROM rollouts GROUP BY source) r
LEFT JOIN (SELECT source, COUNT(*) AS failed_rollouts, COUNT(DISTINCT task_id) AS failed_tasks FROM ({runs.FAILS}) WHERE family <> 'infra' GROUP BY source) f ON r.source = f.source
LEFT JOIN (SELECT source, COUNT(*) FILTER (WHERE verdict = 'genuine') AS genuine_references FROM ({GENUINE}) GROUP BY source) g ON r.source = g.source
LEFT JOIN (SELECT source, COUNT(*) AS replayable, COUNT(*) FILTER (WHERE b = 1) AS validated_positive, COUNT(*) FILTER (WHERE b = 3) AS validated_negative, COUNT(*) FILTER (WHERE b = 2) AS unresolved, COUNT(*) FILTER (WHERE b = 0) AS unreplayable FROM
 (SELECT source, CASE WHEN failure_type = 'unreplayable' THEN 0 WHEN has_positive THEN 1 WHEN has_unresolved THEN 2 ELSE 3 END AS b FROM ({FUNNEL_REPLAYS})) GROUP BY source) p ON r.source = p.source
LEFT JOIN (SELECT source, COUNT(*) AS clusters, COUNT(*) FILTER (WHERE members >= 2) AS clusters_ge2 FROM ({FUNNEL_CLUSTERS}) GROUP BY source) k ON r.source = k.source
LEFT JOIN (SELECT source, {', '.join(f"COUNT(*) FILTER (WHERE arm = '{a}' AND impossible IS NULL) AS {n}" for a, n in FEASIBLE.items())} FROM ({FUNNEL_ARMS}) GROUP BY source) h ON r.source = h.source""")
def _(t):
    return rep.measurability_funnel(t.view("rollouts"), t.sql(runs.FAILS), t.sql(GENUINE), t.sql(FUNNEL_REPLAYS), t.sql(FUNNEL_CLUSTERS), t.sql(FUNNEL_ARMS))


COSTS = f"""SELECT a.source, a.pass_usd, b.call_usd FROM (SELECT source, CAST(SUM(u) AS DOUBLE) / COUNT(*) AS pass_usd FROM (SELECT source, run_id, SUM(usd) AS u FROM ({runs.RUN_LEDGER}) GROUP BY source, run_id) GROUP BY source) a
FULL JOIN (SELECT source, CAST(SUM(usd) AS DOUBLE) / COUNT(*) AS call_usd FROM ({runs.RUN_LEDGER}) WHERE event = 'call' AND arm = 'diagnosis' GROUP BY source) b ON a.source = b.source"""


@query("seed_runs_cost", f"SELECT source, ROUND(pass_usd, 6) AS pass_usd, ROUND(call_usd, 6) AS call_usd FROM ({COSTS})")
def _(t):
    ledger = t.sql(runs.RUN_LEDGER)
    return rounded(rep.seed_runs_cost(ledger, ledger), "pass_usd", "call_usd")


MDE_ROWS = """SELECT source, n, k, passes, CASE WHEN parts % 7 = 0 THEN NULL ELSE CAST(size % 90 AS DOUBLE) / 10 / k + n % 3 END AS mde FROM
 (SELECT source, parts, size, n, k, EACH(1, 2) AS passes FROM (SELECT source, parts, size, n, EACH(3, 5) AS k FROM (SELECT source, parts, size, EACH(7, 8, 10, 14) AS n FROM
  (SELECT p_brand AS source, COUNT(*) AS parts, CAST(SUM(p_size) AS BIGINT) AS size FROM part GROUP BY p_brand) a) b) d) e"""
DESIGNS = f"""SELECT c.source, g.n, g.k, g.passes, m.mde, 11 * g.n * g.k * (COALESCE(c.call_usd, 0) + g.passes * c.pass_usd) AS cost_usd, COALESCE(m.mde <= 3.0, FALSE) AS meets_threshold FROM ({COSTS}) c
CROSS JOIN (SELECT n, k, passes FROM (SELECT UNNEST([7,8,10,14]) AS n) CROSS JOIN (SELECT UNNEST([3,5]) AS k) CROSS JOIN (SELECT UNNEST([1,2]) AS passes)) g LEFT JOIN ({MDE_ROWS}) m ON m.source = c.source AND m.n = g.n AND m.k = g.k AND m.passes = g.passes"""


def designs_of(t):
    ledger = t.sql(runs.RUN_LEDGER)
    return rep.design_costs(rep.seed_runs_cost(ledger, ledger), t.sql(MDE_ROWS))


@query("design_costs", f"SELECT source, n, k, passes, ROUND(mde, 6) AS mde, ROUND(cost_usd, 4) AS cost_usd, meets_threshold FROM ({DESIGNS})")
def _(t):
    return rounded(designs_of(t), "mde").withColumn("cost_usd", F.round("cost_usd", 4))


BUDGET = 1_000_000.0
CHOICE = f"""SELECT * FROM (SELECT source, 'N=' || n || ' k=' || k || ' passes=' || passes AS choice, mde, cost_usd, tier = 0 AS meets_d8, tier < 2 AS within_budget,
 ROW_NUMBER() OVER (PARTITION BY source ORDER BY tier, CASE tier WHEN 1 THEN mde ELSE cost_usd END, CASE tier WHEN 0 THEN 0 WHEN 1 THEN cost_usd ELSE mde END, n, k, passes) AS rn FROM
 (SELECT *, CASE WHEN cost_usd <= {BUDGET} AND mde <= 3.0 THEN 0 WHEN cost_usd <= {BUDGET} THEN 1 ELSE 2 END AS tier FROM ({DESIGNS}) WHERE mde IS NOT NULL)) WHERE rn = 1"""


@query("mde_choice", f"SELECT source, choice, ROUND(mde, 6) AS mde, ROUND(cost_usd, 4) AS cost_usd, meets_d8, within_budget FROM ({CHOICE})")
def _(t):
    return rounded(rep.mde_choice(designs_of(t), BUDGET), "mde").withColumn("cost_usd", F.round("cost_usd", 4))


# ------------------------------------------------------------------ decisions

CALIBRATION = """SELECT CASE k WHEN 0 THEN 'browsecomp' WHEN 1 THEN 'hle' WHEN 2 THEN 'gdpval' ELSE 'claw_eval' END AS source, k AS position, CAST(good AS DOUBLE) / n AS pass_rate, CAST(n % 64 AS DOUBLE) / 8 AS aa_delta_points,
 CASE WHEN k = 0 THEN NULL ELSE CAST(good % 96 AS DOUBLE) / 8 END AS heldout_delta_points, good % 12 AS clusters_with_two, 2 + n % 7 AS primary_clusters, k <> 1 AS has_runs FROM
 (SELECT doc_id % 4 AS k, COUNT(*) AS n, COUNT(CASE WHEN n_chars % 2 = 0 THEN 1 END) AS good FROM documents GROUP BY doc_id % 4) q"""
EXTRAS = f"""SELECT CAST(7.25 AS DOUBLE) AS cost_per_rollout, MAX(CASE WHEN judge = 'text' THEN self_consistency END) AS judge_self_consistency, MAX(CASE WHEN judge = 'vision' THEN self_consistency END) AS judge_self_consistency_vision,
 CAST(0.25 AS DOUBLE) AS vision_disagreement, MAX(rejudged) AS vision_compared FROM ({CONSISTENCY})"""
RULES = f"""WITH cal AS (SELECT *, has_runs AND pass_rate BETWEEN 0.1 AND 0.9 AND aa_delta_points <= 5 AND clusters_with_two >= 6 AS enters FROM ({CALIBRATION})),
ext AS ({EXTRAS}), wide AS (SELECT MAX(aa_delta_points) AS w FROM cal WHERE has_runs AND source NOT IN ('browsecomp', 'hle')),
tot AS (SELECT CAST(COALESCE(SUM(primary_clusters) FILTER (WHERE enters), 0) AS BIGINT) AS inc, CAST(COALESCE(SUM(primary_clusters) FILTER (WHERE has_runs), 0) AS BIGINT) AS prim, '[' || COALESCE(STRING_AGG('''' || source || '''', ', ' ORDER BY position) FILTER (WHERE enters), '') || ']' AS names FROM cal),
choice AS ({CHOICE}), par AS ({parity_sql('source')}), rules AS (
SELECT 'D1:' || source AS rule, CASE WHEN has_runs THEN PRINTF('pass_rate=%.4f aa_delta=%.2f clusters_with_two=%d', pass_rate, aa_delta_points, clusters_with_two) ELSE 'no B1 runs' END AS observed, CASE WHEN NOT has_runs THEN 'not evaluable' WHEN enters THEN 'enters E2' ELSE 'excluded' END AS decision FROM cal
UNION ALL SELECT 'D2:' || source, 'primary_clusters=' || primary_clusters, primary_clusters || ' primary; rest secondary' FROM cal WHERE has_runs
UNION ALL SELECT 'D3:' || source, CASE WHEN has_runs THEN PRINTF('aa_delta=%.2f widest_other=%.2f', aa_delta_points, w) ELSE 'missing A/A data' END, CASE WHEN NOT has_runs THEN 'not evaluable' WHEN enters AND aa_delta_points <= 2 * GREATEST(w, 1e-9) THEN 'stays in E2' ELSE 'descriptive only' END FROM cal, wide WHERE source IN ('browsecomp', 'hle')
UNION ALL SELECT 'D1prime', 'primary_clusters_in_included_sources=' || inc || ' (min 8); included=' || names, CASE WHEN inc >= 8 THEN 'E2 starts' ELSE '{dec.PIVOT}' END FROM tot
UNION ALL SELECT 'D4', CASE WHEN 8 * prim * 3 * 7.25 <= 600 THEN PRINTF('projected_usd(k=3)=%.2f budget=600.0', CAST(8 * prim * 3 * 7.25 AS DOUBLE)) ELSE PRINTF('projected_usd(k=2)=%.2f budget=600.0', CAST(8 * prim * 2 * 7.25 AS DOUBLE)) END, CASE WHEN 8 * prim * 3 * 7.25 <= 600 THEN 'k=3' ELSE 'k=2' END FROM tot
UNION ALL SELECT 'D5:' || source, CASE WHEN has_runs AND heldout_delta_points IS NOT NULL THEN PRINTF('heldout_delta=%.2f', heldout_delta_points) ELSE 'no held-out A/A' END, CASE WHEN NOT has_runs OR heldout_delta_points IS NULL THEN 'not evaluable' WHEN heldout_delta_points > 5 THEN '45/source' ELSE '30/source' END FROM cal
UNION ALL SELECT 'D6', PRINTF('text_self_consistency=%.4f', judge_self_consistency) || ' (Flash re-judge replaced by P1)', CASE WHEN judge_self_consistency < 0.9 THEN '2-of-3 judge vote' ELSE 'single judge' END FROM ext
UNION ALL SELECT 'D7', PRINTF('vision_self_consistency=%.4f text_vs_vision_disagreement=%.4f compared=%d', judge_self_consistency_vision, vision_disagreement, vision_compared), CASE WHEN judge_self_consistency_vision >= 0.9 AND vision_disagreement >= 0.1 THEN '{dec.VISION_PRIMARY}' ELSE '{dec.TEXT_PRIMARY}' END FROM ext
UNION ALL SELECT 'D8:' || source, choice || PRINTF(' MDE=%.2f points cost=%.2f USD (delta_meaningful=3.0)', mde, cost_usd), CASE WHEN meets_d8 THEN '{dec.D8_MEETS}' WHEN within_budget THEN '{dec.D8_BEST}' || PRINTF('%.2f points', mde) ELSE '{dec.D8_NONE}' || PRINTF('%.2f points', mde) END FROM choice
UNION ALL SELECT 'COH-WRONG:' || source, CASE WHEN reasons = '' THEN 'parity ok' ELSE 'parity not reached' END, CASE WHEN reasons = '' THEN 'arm admitted' ELSE 'persistent parity violation recorded; arm reported with the caveat' END FROM par)"""


def rules_of(t):
    extras = agr.judge_self_consistency(t.view("judge_verdicts"), JUDGES)
    of = lambda j: F.max(F.when(c("judge") == j, c("self_consistency")))
    extras = extras.agg(
        of("text").alias("judge_self_consistency"), of("vision").alias("judge_self_consistency_vision"), F.max("rejudged").alias("vision_compared"),
    ).withColumns({"cost_per_rollout": F.lit(7.25), "vision_disagreement": F.lit(0.25)})
    return dec.decision_rules(
        t.sql(CALIBRATION), extras, rep.mde_choice(designs_of(t), BUDGET), sta.parity(t.view("score_pairs")).select("source", "ok"), budget=600.0)


@query("decision_rules", RULES + " SELECT rule, observed, decision FROM rules")
def _(t):
    return rules_of(t)


@query("compare_conditions", f"""
SELECT 'D1prime2:' || source AS rule, CASE WHEN other IS NULL THEN 'low=' || n || ' max=unknown' ELSE 'primary clusters: low=' || n || ' max=' || other || ' (ties go to max)' END AS observed,
 CASE WHEN other IS NULL THEN 'not evaluable: comparison decisions.csv missing' ELSE 'E2 under ' || CASE WHEN n > other THEN 'low' ELSE 'max' END || ' with N=' || GREATEST(n, other) || '{dec.CONDITION_TAIL}' END AS decision
FROM (SELECT source, primary_clusters AS n, CASE WHEN source = 'gdpval' THEN NULL ELSE 4 END AS other FROM ({CALIBRATION}) WHERE has_runs)""")
def _(t):
    this = rules_of(t)
    other = this.where(c("rule").startswith("D2:") & (c("rule") != "D2:gdpval")).withColumn("observed", F.lit("primary_clusters=4"))
    return dec.compare_conditions(this, other, "low", "max")
