"""Queries: outcomes, metrics, ledger, pricing, tasks, sampling and set operations."""

from __future__ import annotations

from pyspark.sql import functions as F

from runlens.operators import ledger as led
from runlens.operators import metrics as met
from runlens.operators import outcomes as out
from runlens.operators import pricing as pri
from runlens.operators import tasks as tsk
from runlens.plans.registry import query

c = F.col

FINAL = """SELECT * FROM (SELECT r.*, ROW_NUMBER() OVER (PARTITION BY source, run_id, task_id, replicate ORDER BY attempt DESC) AS rn FROM rollouts r) f WHERE rn = 1"""
RESULTS = f"""SELECT source, run_id, task_id, COUNT(*) AS replicates,
 BOOL_AND(COALESCE(passed, FALSE)) AND COUNT(*) = 3 AS pass_hat_k, BOOL_OR(COALESCE(passed, FALSE)) AS pass_at_k,
 AVG(value) AS mean_value, COUNT(passed) AS scored, COUNT(*) FILTER (WHERE passed) AS passed,
 COUNT(*) FILTER (WHERE error_family = 'infra') AS infra, COUNT(*) FILTER (WHERE error_family = 'budget') AS budget,
 COUNT(task_failure) AS task_failures, 3 AS k, CASE WHEN source = 'claw_eval' THEN 3 ELSE 1 END AS benchmark_k
 FROM ({FINAL}) GROUP BY source, run_id, task_id"""


def rounded(df, *columns):
    for name in columns:
        df = df.withColumn(name, F.round(c(name), 6))
    return df


# ------------------------------------------------------------------ outcomes


@query("classify_failures", """
SELECT source, run_id, task_id, replicate, attempt,
 CASE error_family WHEN 'infra' THEN 'infra' WHEN 'budget' THEN 'budget' ELSE 'task' END AS family,
 CASE error_family WHEN 'infra' THEN COALESCE(error_kind, 'infra') WHEN 'budget' THEN 'budget exhausted'
   ELSE CASE WHEN passed IS NULL THEN 'not scored' ELSE 'verdict ' || task_id END END AS reason,
 COALESCE(error_kind, task_failure) AS kind, COALESCE(passed, FALSE) AS passed
FROM rollouts WHERE NOT COALESCE(passed, FALSE) OR error_family <> 'none'""")
def _(t):
    rows = t.view("rollouts").withColumn("error", F.lit(None).cast("string")).withColumn(
        "score_reason", F.concat(F.lit("verdict "), c("task_id").cast("string")))
    return out.classify_failures(rows).select(
        "source", "run_id", "task_id", "replicate", "attempt", "family", "reason", "kind", "passed")


EXITS = """SELECT *, CASE CAST(steps AS INT) % 6 WHEN 0 THEN 'max_steps' WHEN 1 THEN 'model_call_error'
 WHEN 2 THEN 'rollout_wall_clock_timeout' ELSE 'finished' END AS exit_reason,
 steps % 13 <> 0 AS worker_ok, steps % 11 = 0 AS usage_mismatch FROM rollouts"""


@query("classify_rollout_error", f"""
SELECT run_id, task_id, replicate, attempt,
 CASE WHEN NOT worker_ok THEN 'infra' WHEN usage_mismatch THEN 'infra' WHEN exit_reason = 'model_call_error' THEN 'infra'
  WHEN exit_reason IN ('max_steps','rollout_wall_clock_timeout') THEN 'budget' WHEN usd > 60000 THEN 'budget' ELSE 'none' END AS error_family,
 CASE WHEN NOT worker_ok THEN 'policy_worker_error' WHEN usage_mismatch THEN 'usage_mismatch' WHEN exit_reason = 'model_call_error' THEN exit_reason
  WHEN exit_reason IN ('max_steps','rollout_wall_clock_timeout') THEN 'budget_exhausted' WHEN usd > 60000 THEN 'budget_exhausted' END AS error_kind
FROM ({EXITS})""")
def _(t):
    rows = t.sql(EXITS).withColumn("worker_error", F.lit(None).cast("string"))
    return out.classify_rollout_error(rows, usd_cap=60000).select(
        "run_id", "task_id", "replicate", "attempt", "error_family", "error_kind")


REASONS = """SELECT doc_id, CASE n_chars % 8 WHEN 0 THEN 'judge_error: unparseable ' || lang WHEN 1 THEN 'llm_as_judge: matches'
 WHEN 2 THEN 'hle_judge: incorrect' WHEN 3 THEN 'rubric_file_judge(text-only): 3.0/10 pts, 1 file' WHEN 4 THEN 'claw_grader: C=0.50'
 WHEN 5 THEN 'claw_grader_error: ' || source WHEN 6 THEN 'web_hackle_violation: x' ELSE 'file_equals' END AS reason FROM documents"""


@query("reason_family", f"""
SELECT family, kind, COUNT(*) AS n FROM (SELECT
 CASE WHEN reason LIKE 'judge_error: %' OR reason LIKE 'claw_grader_error: %' THEN 'infra' WHEN reason LIKE 'web_hackle%' THEN 'task' ELSE 'judged' END AS family,
 CASE WHEN reason LIKE 'judge_error: %' THEN 'judge_error' WHEN reason LIKE 'claw_grader_error: %' THEN 'grader_error' WHEN reason LIKE 'web_hackle%' THEN 'hackle_violation'
  WHEN reason LIKE 'llm_as%' THEN 'llm_as_judge' WHEN reason LIKE 'hle_judge%' THEN 'hle_judge' WHEN reason LIKE 'rubric%' THEN 'rubric_file_judge'
  WHEN reason LIKE 'claw_grader: C=%' THEN 'claw_grader' ELSE 'file_equals' END AS kind FROM ({REASONS})) GROUP BY family, kind""")
def _(t):
    return out.reason_family(t.sql(REASONS)).groupBy("family", "kind").agg(F.count(F.lit(1)).alias("n"))


META = """SELECT rollout_id, SUM(prompt_tokens) + CASE WHEN rollout_id % 3 = 0 THEN 1 ELSE 0 END AS meta_prompt,
 SUM(completion_tokens) AS meta_completion FROM turns WHERE role = 'assistant' GROUP BY rollout_id"""


@query("usage_mismatch", f"""
SELECT m.rollout_id, CAST(s.p AS BIGINT) AS step_prompt, CAST(m.meta_prompt AS BIGINT) AS meta_prompt FROM ({META}) m
JOIN (SELECT rollout_id, SUM(prompt_tokens) AS p FROM turns WHERE role = 'assistant' GROUP BY rollout_id) s ON m.rollout_id = s.rollout_id
WHERE s.p <> m.meta_prompt""")
def _(t):
    from runlens.operators import trajectory as trj

    calls = trj.flat_model_calls(t.view("turns"))
    return out.usage_mismatch(t.sql(META), trj.step_usage(calls)).select("rollout_id", "step_prompt", "meta_prompt")


# ------------------------------------------------------------------ metrics


@query("final_attempts", f"SELECT source, run_id, task_id, replicate, attempt, passed FROM ({FINAL})")
def _(t):
    return met.final_attempts(t.view("rollouts")).select("source", "run_id", "task_id", "replicate", "attempt", "passed")


@query("task_results", f"""
SELECT source, run_id, task_id, replicates, pass_hat_k, pass_at_k, ROUND(mean_value, 6) AS mean_value, scored, passed, infra, budget,
 task_failures, k, benchmark_k, k = benchmark_k AS benchmark_valid FROM ({RESULTS})""")
def _(t):
    return rounded(met.task_results(t.view("rollouts"), 3), "mean_value")


@query("run_summary", f"""
SELECT source, run_id, COUNT(*) AS tasks, BOOL_AND(k = benchmark_k) AS benchmark_valid,
 ROUND(COUNT(*) FILTER (WHERE pass_hat_k) / COUNT(*), 6) AS pass_hat_k_rate, ROUND(COUNT(*) FILTER (WHERE pass_at_k) / COUNT(*), 6) AS pass_at_k_rate,
 ROUND(SUM(passed) / GREATEST(1, SUM(scored)), 6) AS rollout_pass_rate, ROUND(COALESCE(SUM(mean_value), 0) / GREATEST(1, COUNT(mean_value)), 6) AS mean_value,
 CAST(SUM(infra) AS BIGINT) AS infra_rollouts, CAST(SUM(budget) AS BIGINT) AS budget_rollouts, CAST(SUM(task_failures) AS BIGINT) AS task_failure_rollouts
FROM ({RESULTS}) GROUP BY source, run_id""")
def _(t):
    return rounded(met.run_summary(met.task_results(t.view("rollouts"), 3)),
                   "pass_hat_k_rate", "pass_at_k_rate", "rollout_pass_rate", "mean_value")


SCORES = """SELECT o_orderkey AS task_id, o_totalprice < 250000 AS passed, o_totalprice / 1000.0 AS value,
 CASE WHEN o_custkey % 9 = 0 THEN 'empty_answer' END AS task_failure FROM orders"""
SRC_METRICS = f"""SELECT t.source, COUNT(*) AS n, COUNT(*) FILTER (WHERE s.passed) AS passed, COUNT(*) FILTER (WHERE s.passed) / COUNT(*) AS pass_rate,
 AVG(s.value) AS mean_value, COUNT(s.task_failure) AS task_failures FROM ({SCORES}) s JOIN tasks t ON s.task_id = t.task_id GROUP BY t.source"""


@query("source_metrics", f"SELECT source, n, passed, ROUND(pass_rate, 6) AS pass_rate, ROUND(mean_value, 6) AS mean_value, task_failures FROM ({SRC_METRICS})")
def _(t):
    return rounded(met.source_metrics(t.view("tasks"), t.sql(SCORES)), "pass_rate", "mean_value")


@query("macro_rate", f"""
SELECT CAST(SUM(n) AS BIGINT) AS n_scored, ROUND(SUM(pass_rate * LENGTH(source)) / SUM(LENGTH(source)), 6) AS macro FROM ({SRC_METRICS})""")
def _(t):
    weights = t.view("tasks").select("source").distinct().withColumn("weight", F.length("source").cast("double"))
    return rounded(met.macro_rate(met.source_metrics(t.view("tasks"), t.sql(SCORES)), weights), "macro")


@query("counts_by_source", "SELECT source, COUNT(*) AS tasks FROM tasks GROUP BY source")
def _(t):
    return met.counts_by(t.view("tasks"), "source")


DOMAINS = "SELECT t.*, CASE SUBSTR(source, 1, 1) WHEN '1' THEN 'search' WHEN '2' THEN 'search' WHEN '3' THEN 'office' ELSE 'general' END AS domain FROM tasks t"


@query("counts_by_domain", f"SELECT domain, COUNT(*) AS tasks FROM ({DOMAINS}) GROUP BY domain")
def _(t):
    return met.counts_by(t.sql(DOMAINS), "domain")


@query("baseline_table", f"""
SELECT a.source, a.run_id, b.tasks, a.rollouts, ROUND(a.rate, 6) AS rollout_pass_rate, ROUND(b.hat, 6) AS pass_hat_k_rate FROM
 (SELECT source, run_id, COUNT(*) AS rollouts, COUNT(*) FILTER (WHERE passed) / NULLIF(COUNT(passed), 0) AS rate FROM rollouts GROUP BY source, run_id) a
JOIN (SELECT source, run_id, COUNT(*) AS tasks, COUNT(*) FILTER (WHERE pass_hat_k) / COUNT(*) AS hat FROM ({RESULTS}) GROUP BY source, run_id) b
ON a.source = b.source AND a.run_id = b.run_id""")
def _(t):
    return rounded(met.baseline_table(t.view("rollouts"), 3), "rollout_pass_rate", "pass_hat_k_rate")


@query("dist_stats", """
SELECT source, ROUND(CAST(SUM(usd) AS DOUBLE) / COUNT(usd), 6) AS usd_mean, ROUND(MEDIAN(CAST(usd AS DOUBLE)), 6) AS usd_median,
 CAST(MAX(usd) AS DOUBLE) AS usd_max, ROUND(CAST(SUM(usd) AS DOUBLE), 6) AS usd_total FROM rollouts GROUP BY source""")
def _(t):
    return rounded(met.dist_stats(t.view("rollouts"), ["source"], {"usd": "usd"}), "usd_mean", "usd_median", "usd_total")


RUN_LEDGER = """SELECT 'Brand#' || CAST(1 + user_id % 25 AS STRING) AS source, 'p' || CAST(1 + event_id % 2 AS STRING) AS run_id,
 CASE event_type WHEN 'click' THEN 'call' WHEN 'view' THEN 'policy' WHEN 'purchase' THEN 'search' WHEN 'signup' THEN 'call' ELSE 'infra_failure' END AS event,
 CASE event_id % 3 WHEN 0 THEN 'judge' WHEN 1 THEN 'diagnosis' ELSE 'replay' END AS arm, event_id % 5 = 0 AS cached, CAST(value AS DECIMAL(18,6)) AS usd FROM events"""
FAILS = """SELECT source, run_id, task_id, replicate, attempt, error_kind, CASE error_family WHEN 'infra' THEN 'infra' WHEN 'budget' THEN 'budget' ELSE 'task' END AS family
 FROM rollouts WHERE NOT COALESCE(passed, FALSE) OR error_family <> 'none'"""
RUN_AGG = f"""SELECT b.*, h.pass_hat_k_tasks, COALESCE(l.judge_usd, 0) AS judge_usd, COALESCE(l.judge_calls, 0) AS judge_calls, COALESCE(l.judge_cached, 0) AS judge_cached,
 COALESCE(l.diagnosis_usd, 0) AS diagnosis_usd, COALESCE(l.replay_usd, 0) AS replay_usd, COALESCE(l.replay_rollouts, 0) AS replay_rollouts, COALESCE(l.search_usd, 0) AS search_usd,
 COALESCE(f.harness_failures, 0) AS harness_failures, COALESCE(f.infra_failures, 0) AS infra_failures, COALESCE(f.budget_failures, 0) AS budget_failures, COALESCE(i.infra, '{{}}') AS infra
FROM (SELECT source, run_id, COUNT(DISTINCT task_id) AS tasks, COUNT(*) AS rollouts, COUNT(passed) AS scored, COUNT(*) FILTER (WHERE passed) AS passed,
  CAST(SUM(search_calls) AS BIGINT) AS search_calls, COUNT(*) FILTER (WHERE error_kind = 'usage_mismatch') AS usage_mismatch, COUNT(*) FILTER (WHERE partial) AS partial,
  CAST(SUM(usd) AS DOUBLE) / COUNT(usd) AS policy_usd_mean, MEDIAN(CAST(usd AS DOUBLE)) AS policy_usd_median, CAST(MAX(usd) AS DOUBLE) AS policy_usd_max, CAST(SUM(usd) AS DOUBLE) AS policy_usd_total,
  AVG(duration_seconds) AS wall_s_mean, MEDIAN(duration_seconds) AS wall_s_median, MAX(duration_seconds) AS wall_s_max, SUM(duration_seconds) AS wall_s_total
  FROM rollouts GROUP BY source, run_id) b
JOIN (SELECT source, run_id, COUNT(*) FILTER (WHERE pass_hat_k) AS pass_hat_k_tasks FROM task_passes GROUP BY source, run_id) h ON b.source = h.source AND b.run_id = h.run_id
LEFT JOIN (SELECT source, run_id, CAST(SUM(usd) FILTER (WHERE event = 'call' AND arm = 'judge') AS DOUBLE) AS judge_usd, COUNT(*) FILTER (WHERE event = 'call' AND arm = 'judge') AS judge_calls,
  COUNT(*) FILTER (WHERE event = 'call' AND arm = 'judge' AND cached) AS judge_cached, CAST(SUM(usd) FILTER (WHERE event = 'call' AND arm = 'diagnosis') AS DOUBLE) AS diagnosis_usd,
  CAST(SUM(usd) FILTER (WHERE event = 'policy' AND arm = 'replay') AS DOUBLE) AS replay_usd, COUNT(*) FILTER (WHERE event = 'policy' AND arm = 'replay') AS replay_rollouts,
  CAST(SUM(usd) FILTER (WHERE event = 'search') AS DOUBLE) AS search_usd FROM ({RUN_LEDGER}) GROUP BY source, run_id) l ON b.source = l.source AND b.run_id = l.run_id
LEFT JOIN (SELECT source, run_id, COUNT(*) FILTER (WHERE family <> 'infra') AS harness_failures, COUNT(*) FILTER (WHERE family = 'infra') AS infra_failures,
  COUNT(*) FILTER (WHERE family = 'budget') AS budget_failures FROM ({FAILS}) GROUP BY source, run_id) f ON b.source = f.source AND b.run_id = f.run_id
LEFT JOIN (SELECT source, run_id, '{{' || STRING_AGG('"' || kind || '": ' || n, ', ' ORDER BY kind) || '}}' AS infra FROM
  (SELECT source, run_id, error_kind AS kind, COUNT(*) AS n FROM rollouts WHERE error_family = 'infra' GROUP BY source, run_id, error_kind) GROUP BY source, run_id) i ON b.source = i.source AND b.run_id = i.run_id"""
MONEY = ["policy_usd_mean", "policy_usd_median", "policy_usd_total", "wall_s_mean", "wall_s_median", "wall_s_total",
         "judge_usd", "diagnosis_usd", "replay_usd", "search_usd"]


def run_profiles(t):
    return met.run_aggregate(t.view("rollouts"), t.sql(RUN_LEDGER), t.sql(FAILS), t.view("task_passes"))


@query("run_aggregate", f"SELECT * REPLACE ({', '.join(f'ROUND({m}, 6) AS {m}' for m in MONEY)}) FROM ({RUN_AGG})")
def _(t):
    return rounded(run_profiles(t), *MONEY)


COST = f"""SELECT source, run_id, rollouts, policy_usd_total / rollouts AS policy_usd_per_rollout, judge_usd / rollouts AS judge_usd_per_rollout,
 replay_usd, diagnosis_usd, search_usd, policy_usd_total + judge_usd + replay_usd + diagnosis_usd + search_usd AS total_usd FROM ({RUN_AGG})"""
COST_COLS = ["policy_usd_per_rollout", "judge_usd_per_rollout", "replay_usd", "diagnosis_usd", "search_usd", "total_usd"]


@query("cost_table", f"SELECT source, run_id, rollouts, {', '.join(f'ROUND({m}, 4) AS {m}' for m in COST_COLS)} FROM ({COST})")
def _(t):
    df = met.cost_table(met.run_costs(t.view("rollouts"), ledger=t.sql(RUN_LEDGER)))
    for m in COST_COLS:
        df = df.withColumn(m, F.round(m, 4))
    return df


@query("infra_table", f"SELECT source, run_id, infra_failures, infra, usage_mismatch, partial, budget_failures FROM ({RUN_AGG})")
def _(t):
    return met.infra_table(met.run_costs(t.view("rollouts"), failures=t.sql(FAILS)))


@query("cost_per_rollout", f"""
SELECT ROUND(AVG(policy_usd_per_rollout + judge_usd_per_rollout), 4) AS cost_per_rollout FROM ({COST}) WHERE run_id <> 'p2'""")
def _(t):
    costs = met.cost_table(met.run_costs(t.view("rollouts"), ledger=t.sql(RUN_LEDGER))).withColumn(
        "run_id", F.when(c("run_id") == "p2", "p2-ref").otherwise(c("run_id")))
    return met.cost_per_rollout(costs).withColumn("cost_per_rollout", F.round("cost_per_rollout", 4))


# ------------------------------------------------------------------ ledger and pricing

LEDGER_COLS = """COUNT(*) FILTER (WHERE event = 'call') AS calls, COUNT(*) FILTER (WHERE event = 'call' AND cached) AS cached_calls,
 COUNT(*) FILTER (WHERE event = 'infra_retry') AS infra_retries, COUNT(*) FILTER (WHERE event = 'infra_failure') AS infra_failures,
 COUNT(*) FILTER (WHERE event = 'task_failure' AND error_kind <> 'budget_exhausted') AS task_failures,
 COUNT(*) FILTER (WHERE event = 'task_failure' AND error_kind = 'budget_exhausted') AS budget_exhausted,
 CAST(COALESCE(SUM(prompt_tokens) FILTER (WHERE event = 'call'), 0) AS BIGINT) AS prompt_tokens,
 CAST(COALESCE(SUM(completion_tokens) FILTER (WHERE event = 'call'), 0) AS BIGINT) AS completion_tokens,
 ROUND(CAST(COALESCE(SUM(usd) FILTER (WHERE event = 'call'), 0) AS DOUBLE), 6) AS usd,
 COUNT(*) FILTER (WHERE event = 'search') AS search_calls, ROUND(CAST(COALESCE(SUM(usd) FILTER (WHERE event = 'search'), 0) AS DOUBLE), 6) AS search_usd,
 COUNT(*) FILTER (WHERE event = 'policy') AS policy_rollouts,
 CAST(COALESCE(SUM(prompt_tokens) FILTER (WHERE event = 'policy'), 0) AS BIGINT) AS policy_prompt_tokens,
 CAST(COALESCE(SUM(completion_tokens) FILTER (WHERE event = 'policy'), 0) AS BIGINT) AS policy_completion_tokens,
 ROUND(CAST(COALESCE(SUM(usd) FILTER (WHERE event = 'policy'), 0) AS DOUBLE), 6) AS policy_usd"""


@query("ledger_summary", f"SELECT run_id, {LEDGER_COLS} FROM ledger GROUP BY run_id")
def _(t):
    return rounded(led.ledger_summary(t.view("ledger")), "usd", "search_usd", "policy_usd")


DONE = "SELECT DISTINCT CAST(user_id AS STRING) || '-' || CAST(event_id % 3 AS STRING) AS rollout_uid FROM events WHERE event_id % 7 < 3 AND user_id % 2 = 0"


@query("ledger_summary_resumed", f"""
SELECT run_id, {LEDGER_COLS} FROM ledger WHERE rollout_uid IS NULL OR rollout_uid IN (SELECT rollout_uid FROM ({DONE})) GROUP BY run_id""")
def _(t):
    return rounded(led.ledger_summary_resumed(t.view("ledger"), t.sql(DONE)), "usd", "search_usd", "policy_usd")


@query("spend_by_arm", """
SELECT run_id, arm, ROUND(CAST(SUM(usd) AS DOUBLE), 6) AS usd FROM ledger WHERE event IN ('call','policy','search') GROUP BY run_id, arm""")
def _(t):
    return rounded(led.spend_by_arm(t.view("ledger")), "usd")


@query("budget_state", """
SELECT run_id, ROUND(CAST(SUM(usd) AS DOUBLE), 6) AS spent, CAST(5000.0 AS DOUBLE) AS cap, CAST(SUM(usd) AS DOUBLE) >= 5000.0 AS reached
FROM ledger WHERE event IN ('call','policy','search') GROUP BY run_id""")
def _(t):
    return rounded(led.budget_state(t.view("ledger"), 5000.0, ["run_id"]), "spent")


MODEL_USAGE = """SELECT event_id, ts, prompt_tokens, completion_tokens, cache_hit_prompt_tokens,
 CASE event_id % 3 WHEN 0 THEN 'deepseek-v4-flash' WHEN 1 THEN 'deepseek-v4-pro' ELSE 'deepseek-v4-flash-vision-exp' END AS model FROM ledger"""


@query("price_usage", f"""
SELECT event_id, tier, ROUND((cache_hit_prompt_tokens * hit + (prompt_tokens - cache_hit_prompt_tokens) * miss + completion_tokens * output) / 1000000, 6) AS usd FROM
(SELECT *, CASE WHEN tier = 'peak' THEN 2 ELSE 1 END * CASE WHEN model = 'deepseek-v4-pro' THEN CAST(0.022 AS DOUBLE) ELSE 0.007 END AS hit,
  CASE WHEN tier = 'peak' THEN 2 ELSE 1 END * CASE WHEN model = 'deepseek-v4-pro' THEN CAST(0.66 AS DOUBLE) ELSE 0.22 END AS miss,
  CASE WHEN tier = 'peak' THEN 2 ELSE 1 END * CASE WHEN model = 'deepseek-v4-pro' THEN CAST(1.98 AS DOUBLE) ELSE 0.66 END AS output FROM
 (SELECT *, CASE WHEN isodow(ts) <= 5 AND ((hour(ts) >= 1 AND hour(ts) < 4) OR (hour(ts) >= 6 AND hour(ts) < 10)) THEN 'peak' ELSE 'off_peak' END AS tier FROM ({MODEL_USAGE})))""")
def _(t):
    return rounded(pri.price_usage(t.sql(MODEL_USAGE), pri.model_rates(t.spark)), "usd").select("event_id", "tier", "usd")


SEARCHES = "SELECT event_id, CASE WHEN event_id >= 0 THEN 'serper' ELSE run_id END AS provider, prompt_tokens % 7 AS queries FROM ledger WHERE event = 'search'"


@query("price_searches", f"SELECT event_id, queries, ROUND(queries * CAST(0.001 AS DOUBLE), 6) AS usd, '2026-09-05.1' AS pricing_version FROM ({SEARCHES})")
def _(t):
    return rounded(pri.price_searches(t.sql(SEARCHES), pri.search_rates(t.spark)), "usd").select(
        "event_id", "queries", "usd", "pricing_version")


# ------------------------------------------------------------------ tasks, sampling, sets

RAW_TASKS = """SELECT CASE o_orderkey % 5 WHEN 0 THEN 'bc-' WHEN 1 THEN 'hle-' WHEN 2 THEN 'gdpval-' WHEN 3 THEN 'claw-' ELSE 'apex-' END || CAST(o_orderkey AS STRING) AS id,
 CASE o_orderkey % 5 WHEN 0 THEN 'search' WHEN 1 THEN 'search' WHEN 2 THEN 'office' WHEN 3 THEN 'general' ELSE 'office' END AS domain,
 CASE WHEN o_orderkey % 7 = 0 THEN CASE o_orderkey % 5 WHEN 0 THEN 'browsecomp' WHEN 1 THEN 'hle' WHEN 2 THEN 'gdpval' WHEN 3 THEN 'claw' ELSE 'apex' END END AS canary,
 'gold ' || CAST(o_orderkey AS STRING) AS evaluator, 'raw' AS raw, o_totalprice AS value FROM orders"""
NORM = f"""SELECT *, CASE SUBSTR(id, 1, 2) WHEN 'bc' THEN 'browsecomp' WHEN 'hl' THEN 'hle' WHEN 'gd' THEN 'gdpval' WHEN 'cl' THEN 'claw_eval' ELSE 'apex' END AS source,
 SUBSTR(id, 1, 4) = 'apex' AS excluded FROM ({RAW_TASKS})"""


@query("normalise_tasks", f"SELECT id, source, domain, excluded FROM ({NORM})")
def _(t):
    return tsk.normalise_tasks(t.sql(RAW_TASKS)).select("id", "source", "domain", "excluded")


@query("select_tasks", f"SELECT id, source, domain FROM ({NORM}) WHERE NOT excluded AND domain IN ('office','general') AND source IN ('gdpval','apex')")
def _(t):
    return tsk.select_tasks(tsk.normalise_tasks(t.sql(RAW_TASKS)), ["office", "general"], ["gdpval", "apex"]).select("id", "source", "domain")


@query("public_view", f"SELECT id, source, domain, excluded, ROUND(value, 2) AS value FROM ({NORM})")
def _(t):
    return tsk.public_view(tsk.normalise_tasks(t.sql(RAW_TASKS))).select("id", "source", "domain", "excluded", F.round("value", 2).alias("value"))


def quota_sql(n):
    return f"""SELECT source, n, floor_q + CASE WHEN rn <= left_over THEN 1 ELSE 0 END AS quota FROM
 (SELECT source, n, floor_q, {n} - SUM(floor_q) OVER () AS left_over, ROW_NUMBER() OVER (ORDER BY q - floor_q DESC, source) AS rn FROM
  (SELECT source, n, q, CAST(FLOOR(q) AS BIGINT) AS floor_q FROM (SELECT source, n, {n} * n / SUM(n) OVER () AS q FROM
   (SELECT source, COUNT(*) AS n FROM tasks WHERE NOT excluded GROUP BY source))))"""


@query("allocate", f"SELECT source, n, CAST(quota AS BIGINT) AS quota FROM ({quota_sql(523)})")
def _(t):
    counts = t.view("tasks").where(~c("excluded")).groupBy("source").agg(F.count(F.lit(1)).alias("n"))
    return tsk.allocate(counts, 523)


def hashed(seed, where):
    return f"""SELECT t.*, ROW_NUMBER() OVER (PARTITION BY source ORDER BY sha256('{seed}:' || source || ':' || task_id), task_id) AS rn FROM tasks t WHERE NOT excluded AND {where}"""


@query("stratified_sample", f"""
SELECT h.source, h.task_id, h.split FROM ({hashed(3, 'TRUE')}) h JOIN ({quota_sql(523)}) q ON h.source = q.source WHERE h.rn <= q.quota""")
def _(t):
    return tsk.stratified_sample(t.view("tasks"), 523, 3).select("source", "task_id", "split")


@query("sample_per_source", f"SELECT source, task_id, split FROM ({hashed(0, 'TRUE')}) WHERE rn <= 24")
def _(t):
    return tsk.sample_per_source(t.view("tasks"), 24, 0).select("source", "task_id", "split")


SPLITS = f"""WITH dev AS (SELECT source, task_id FROM ({hashed(0, "split = 'evaluation'")}) WHERE rn <= 24),
held AS (SELECT source, task_id FROM (SELECT t.*, ROW_NUMBER() OVER (PARTITION BY source ORDER BY sha256('0:' || source || ':' || task_id), task_id) AS rn FROM tasks t
  WHERE NOT excluded AND split = 'evaluation' AND task_id NOT IN (SELECT task_id FROM dev)) WHERE rn <= 30),
split_rows AS (SELECT source, 'validation' AS split, task_id FROM tasks WHERE NOT excluded AND split = 'validation'
 UNION ALL SELECT source, 'eval_dev', task_id FROM dev UNION ALL SELECT source, 'heldout', task_id FROM held)"""


def splits_of(t):
    return tsk.build_splits(t.view("tasks"), 24, 30, 0)


@query("build_splits", SPLITS + " SELECT source, split, task_id FROM split_rows")
def _(t):
    return splits_of(t)


@query("split_sizes", SPLITS + " SELECT source, split, COUNT(*) AS tasks FROM split_rows GROUP BY source, split")
def _(t):
    return tsk.split_sizes(splits_of(t))


@query("mining_pool", SPLITS + " SELECT DISTINCT source, task_id FROM split_rows WHERE split <> 'heldout'")
def _(t):
    return tsk.mining_pool(splits_of(t))


@query("eval_rest", SPLITS + " SELECT source, task_id FROM tasks WHERE NOT excluded AND split = 'evaluation' AND task_id NOT IN (SELECT task_id FROM split_rows)")
def _(t):
    return tsk.eval_rest(t.view("tasks"), splits_of(t))


@query("all_tasks", "SELECT source, task_id, split FROM tasks")
def _(t):
    tasks = t.view("tasks").select("source", "task_id", "split")
    return tsk.all_tasks(tasks.where(c("split") == "validation"), tasks.where(c("split") == "evaluation"))


OVERLAPPING = """SELECT source, 'a' AS split, task_id FROM tasks UNION ALL SELECT source, 'b' AS split, task_id FROM tasks WHERE task_id % 5 = 0"""


@query("split_overlaps", "SELECT source, task_id, CAST(2 AS BIGINT) AS splits FROM tasks WHERE task_id % 5 = 0")
def _(t):
    return tsk.split_overlaps(t.sql(OVERLAPPING))


PASS_TASKS = "SELECT p_brand AS source, CASE l_linestatus WHEN 'F' THEN 'p1' ELSE 'p2' END AS run_id, l_orderkey AS task_id FROM lineitem JOIN part ON l_partkey = p_partkey"


@query("common_tasks", f"""
SELECT source, task_id FROM ({PASS_TASKS}) WHERE run_id = 'p1' INTERSECT SELECT source, task_id FROM ({PASS_TASKS}) WHERE run_id = 'p2'""")
def _(t):
    return tsk.common_tasks(t.sql(PASS_TASKS))


FAIL_KEYS = "SELECT source, run_id, CAST(task_id AS STRING) || '/' || CAST(replicate AS STRING) || '/' || CAST(attempt AS STRING) AS failure_key FROM rollouts WHERE NOT COALESCE(passed, FALSE)"


@query("failure_subset", f"""
WITH f AS ({FAIL_KEYS}), q AS (SELECT CASE WHEN (SELECT COUNT(*) FROM f) <= 333 THEN (SELECT COUNT(*) FROM f) ELSE 333 // (SELECT COUNT(DISTINCT source) FROM f) END AS quota),
r AS (SELECT f.*, ROW_NUMBER() OVER (PARTITION BY source ORDER BY sha256('0:' || source || ':' || run_id || ':' || failure_key), run_id, failure_key) AS rn FROM f),
a AS (SELECT source, run_id, failure_key FROM r, q WHERE rn <= quota),
b AS (SELECT source, run_id, failure_key, ROW_NUMBER() OVER (ORDER BY run_id, failure_key, source) AS rn FROM r, q WHERE r.rn > quota)
SELECT * FROM a UNION ALL SELECT source, run_id, failure_key FROM b WHERE rn <= 333 - (SELECT COUNT(*) FROM a)""")
def _(t):
    return tsk.failure_subset(t.sql(FAIL_KEYS), 333, 0)


@query("calibration_sample", """
WITH u AS (SELECT *, ROW_NUMBER() OVER (PARTITION BY source ORDER BY sha256('b7:' || source || ':' || run_id || ':' || task_id || ':' || replicate || ':' || attempt), run_id, task_id, replicate, attempt) AS rn
 FROM rollouts WHERE passed IS NOT NULL AND error_family <> 'infra')
SELECT source, run_id, task_id, replicate, attempt FROM u WHERE rn <= GREATEST(1, 60 // (SELECT COUNT(DISTINCT source) FROM u)) ORDER BY source, rn LIMIT 60""")
def _(t):
    return tsk.calibration_sample(t.view("rollouts"), 60).select("source", "run_id", "task_id", "replicate", "attempt")
