"""Views that give the star-schema test tables the shapes the operators expect.

The SQL uses only syntax Spark SQL and DuckDB share, so the same text feeds an operator here and
the check there; ``EACH(a, b, ...)`` stands for one row per literal, which the two spell
differently. Views may use other views of this module.
"""

from __future__ import annotations

import re

BASE_TABLES = [
    "region", "nation", "customer", "supplier", "part", "orders", "lineitem",
    "events", "documents", "embeddings", "pages", "benchmark", "labels", "conversations",
]

K = "CAST(regexp_extract(props, '[0-9]+', 0) AS INT)"

VIEWS: dict[str, str] = {
    # run logs: pass = line status, task = part, source = brand
    "rollouts": """
SELECT p_brand AS source, CASE WHEN l_linestatus = 'F' THEN 'p1' ELSE 'p2' END AS run_id,
       l_partkey AS task_id, 1 + (l_linenumber - 1) % 3 AS replicate,
       CAST(ROW_NUMBER() OVER (PARTITION BY l_partkey, l_linestatus, 1 + (l_linenumber - 1) % 3
         ORDER BY l_shipdate, l_orderkey, l_linenumber, l_suppkey, l_extendedprice, l_quantity, l_discount, l_tax, l_returnflag) AS BIGINT) AS attempt,
       CASE WHEN l_tax < 0.005 THEN 'infra' WHEN l_tax > 0.075 THEN 'budget' ELSE 'none' END AS error_family,
       CASE WHEN l_tax < 0.005 THEN CASE WHEN l_quantity < 25.5 THEN 'policy_worker_error' ELSE 'usage_mismatch' END
            WHEN l_tax > 0.075 THEN 'budget_exhausted' END AS error_kind,
       CASE WHEN l_tax < 0.005 THEN NULL ELSE l_returnflag <> 'R' END AS passed,
       CASE WHEN l_tax < 0.005 THEN NULL ELSE 1.0 - l_discount END AS value,
       CASE WHEN l_tax >= 0.005 AND l_discount > 0.085 THEN 'empty_answer' END AS task_failure,
       CAST(l_quantity AS INT) AS steps, CAST(l_extendedprice AS DECIMAL(18,6)) AS usd,
       CAST(l_quantity * 2 AS DOUBLE) AS duration_seconds, l_discount < 0.015 AS partial,
       CAST(l_quantity AS INT) % 3 AS search_calls, l_shipdate AS started_at
FROM lineitem JOIN part ON l_partkey = p_partkey""",
    "tasks": """
SELECT o_orderkey AS task_id, o_orderpriority AS source,
       CASE WHEN o_orderstatus = 'F' THEN 'validation' ELSE 'evaluation' END AS split,
       o_orderstatus = 'P' AND o_orderkey % 10 = 0 AS excluded
FROM orders""",
    "ledger": f"""
SELECT event_id, ts, CAST(user_id % 5 AS STRING) AS run_id, CAST(user_id AS STRING) AS unit_id,
       CASE event_type WHEN 'click' THEN 'call' WHEN 'view' THEN 'policy' WHEN 'error' THEN 'infra_failure'
            WHEN 'purchase' THEN 'search' ELSE 'task_failure' END AS event,
       CASE user_id % 3 WHEN 0 THEN 'judge' WHEN 1 THEN 'diagnosis' ELSE 'replay' END AS arm,
       {K} * 100 AS prompt_tokens, {K} * 7 AS completion_tokens, {K} * 25 AS cache_hit_prompt_tokens,
       {K} % 5 = 0 AS cached,
       CASE WHEN event_id % 4 = 0 THEN 'budget_exhausted' ELSE 'empty_answer' END AS error_kind,
       CASE WHEN event_id % 6 = 0 THEN NULL ELSE CAST(user_id AS STRING) || '-' || CAST(event_id % 3 AS STRING) END AS rollout_uid,
       CAST(value AS DECIMAL(18,6)) AS usd
FROM events""",
    "dispatches": f"""
SELECT user_id AS rollout_id, event_type AS tool_name, ts, event_id AS ord,
       CASE WHEN event_type = 'error' OR {K} % 5 = 0 THEN 500 ELSE 200 END AS response_status
FROM events""",
    # one row per (pair, side, step); a pair is two conversations
    "step_actions": """
SELECT CAST(FLOOR(conv_id / 2.0) AS BIGINT) AS pair_id,
       CASE WHEN conv_id % 2 = 0 THEN 'failed' ELSE 'reference' END AS side, turn + 1 AS step, 0 AS idx,
       CASE LENGTH(text) % 6 WHEN 0 THEN 'shell_ro' WHEN 1 THEN 'shell_mut' WHEN 2 THEN 'shell_opaque'
            WHEN 3 THEN 'finish' WHEN 4 THEN 'final' ELSE 'tool' END AS klass,
       CASE LENGTH(text) % 6 WHEN 3 THEN 'finish' WHEN 4 THEN '__final__'
            WHEN 5 THEN CASE WHEN LENGTH(text) % 4 < 2 THEN 'todo_list_tasks' ELSE 'todo_update_task' END
            ELSE 'run_shell_command' END AS name,
       CAST(LENGTH(text) % 6 AS STRING) || ':' || CAST(LENGTH(text) % 4 AS STRING) AS identity, text AS exact
FROM conversations""",
    "pair_exits": """
SELECT DISTINCT CAST(FLOOR(conv_id / 2.0) AS BIGINT) AS pair_id,
       CASE CAST(FLOOR(conv_id / 2.0) AS BIGINT) % 4 WHEN 0 THEN 'finished' WHEN 1 THEN 'max_steps'
            WHEN 2 THEN 'model_call_error' ELSE 'rollout_wall_clock_timeout' END AS exit_reason
FROM conversations""",
    # flat step entries of a rollout: even turns speak, odd turns are tool results
    "turns": """
SELECT conv_id AS rollout_id, turn AS ord, CAST(FLOOR(turn / 2.0) AS BIGINT) + 1 AS step,
       CASE WHEN turn % 2 = 0 THEN 'assistant' ELSE 'tool' END AS role, LENGTH(text) AS n, text AS content,
       CASE WHEN LENGTH(text) % 4 = 1 THEN 'todo_list_tasks' WHEN LENGTH(text) % 4 = 2 THEN 'finish' ELSE 'run_shell_command' END AS tool_name,
       CASE LENGTH(text) % 5 WHEN 0 THEN 'ls -la  notes' WHEN 1 THEN 'cp a.txt out' || CAST(LENGTH(text) % 9 AS STRING) || '.txt'
            WHEN 2 THEN 'python3 build.py --n ' || CAST(LENGTH(text) % 7 AS STRING) WHEN 3 THEN 'echo hi > report.md ;'
            ELSE 'curl -s https://host' || CAST(LENGTH(text) % 3 AS STRING) || '.example.com/x && true' END AS command,
       CASE WHEN LENGTH(text) % 7 = 0 THEN 1 ELSE 0 END AS exit_code, LENGTH(text) % 11 = 0 AS timed_out,
       LENGTH(text) * 3 AS prompt_tokens, LENGTH(text) % 50 AS completion_tokens, LENGTH(text) * CASE WHEN LENGTH(text) % 3 = 0 THEN 4 ELSE 1 END AS cached_tokens,
       LENGTH(text) % 2 = 0 AS reasons
FROM conversations""",
    "trials": """
SELECT l_partkey AS failure_key, CASE WHEN l_linenumber <= 4 THEN 1 ELSE 2 END AS step,
       CASE WHEN l_linestatus = 'F' THEN 'substitute' ELSE 'control' END AS arm,
       ROW_NUMBER() OVER (PARTITION BY l_partkey, l_linestatus, CASE WHEN l_linenumber <= 4 THEN 1 ELSE 2 END
         ORDER BY l_shipdate, l_orderkey, l_linenumber, l_suppkey, l_extendedprice, l_quantity, l_discount, l_tax, l_returnflag) AS idx,
       CASE WHEN l_quantity < 4.5 THEN 'unreplayable' WHEN l_returnflag = 'R' THEN 'failed' ELSE 'passed' END AS status
FROM lineitem""",
    "diagnoses": """
SELECT CAST(d.doc_id AS STRING) || '/r1/1' AS failure_key, 'b' || CAST(d.doc_id % 4 AS STRING) AS source,
       'p' || CAST(1 + d.doc_id % 2 AS STRING) AS run_id, d.lang AS cause_label, d.source AS component,
       CASE WHEN d.n_chars % 9 = 0 THEN NULL ELSE 1 + d.n_chars % 7 END AS step,
       CASE d.n_chars % 4 WHEN 0 THEN 'low' WHEN 1 THEN 'medium' WHEN 2 THEN 'high' ELSE 'critical' END AS severity,
       CASE d.n_chars % 5 WHEN 0 THEN 'deterministic' WHEN 1 THEN 'stochastic' WHEN 2 THEN 'unrepairable' WHEN 3 THEN 'unreplayable' END AS failure_type,
       CASE WHEN d.n_chars % 3 = 0 THEN 'llm' ELSE 'rule' END AS attribution,
       l.quality = 1 AS oracle_validated, 1 + d.n_chars % 3 AS n_candidates, d.text AS mechanism,
       'fix ' || CAST(d.n_chars % 13 AS STRING) AS fix_hint
FROM documents d JOIN labels l ON d.doc_id = l.doc_id""",
    "components": """
SELECT component, 'layer' || CAST(n % 7 AS STRING) AS layer, n % 10 <> 9 AS patchable, n % 7 <> 6 AS where_eligible
FROM (SELECT DISTINCT source AS component, CAST(SUBSTR(source, 4) AS INT) AS n FROM documents) x""",
    # one row per cluster with its representative's values
    "clusters": """
SELECT 'c' || cause_label || '-' || component AS cluster_id, cause_label, component, members, mechanism, fix_hint, severity
FROM (SELECT cause_label, component, mechanism, fix_hint, severity, COUNT(*) OVER (PARTITION BY cause_label, component) AS members,
             ROW_NUMBER() OVER (PARTITION BY cause_label, component
               ORDER BY CASE severity WHEN 'low' THEN 0 WHEN 'medium' THEN -1 WHEN 'high' THEN -2 ELSE -3 END, COALESCE(step, 1000000), failure_key) AS rn
      FROM diagnoses) x WHERE rn = 1""",
    # candidate set of a cluster beyond its own component
    "cluster_candidates": """
SELECT c.cluster_id, d.component FROM clusters c
JOIN (SELECT DISTINCT lang AS cause_label, source AS component FROM documents WHERE n_chars % 3 = 0) d ON c.cause_label = d.cause_label""",
    "cluster_activity": """
SELECT DISTINCT c.cluster_id, d.component, 1 + d.r % 6 AS step
FROM clusters c JOIN (SELECT DISTINCT lang, source AS component, n_chars % 12 AS r FROM documents) d
  ON c.cause_label = d.lang AND (d.r + c.members) % 4 = 0""",
    "cluster_verdicts": """
SELECT DISTINCT c.cluster_id, 1 + d.doc_id % 6 AS step,
       CASE WHEN d.doc_id % 6 < 2 THEN 'positive' WHEN d.doc_id % 6 < 4 THEN 'negative' ELSE 'unresolved' END AS verdict
FROM clusters c JOIN documents d ON c.cause_label = d.lang AND c.component = d.source""",
    "spans": """
SELECT p_brand AS file, p_type AS component, CASE WHEN p_partkey % 11 = 0 THEN 'file' ELSE 'function' END AS kind,
       p_size AS start_line, p_size + p_partkey % 10 AS end_line
FROM part""",
    "lines": """
SELECT DISTINCT p_brand AS file, CAST(l_quantity AS INT) AS line FROM lineitem JOIN part ON l_partkey = p_partkey""",
    "file_owners": "SELECT DISTINCT 'Brand#' || CAST(p_size AS STRING) AS file, p_type AS component FROM part",
    "judge_verdicts": """
SELECT doc_id, 'b' || CAST(doc_id % 4 AS STRING) AS source, quality = 1 AS text_passed,
       CASE WHEN doc_id % 10 = 0 THEN NULL ELSE toxic = 0 END AS vision_passed,
       CASE WHEN doc_id % 7 = 0 THEN NULL ELSE doc_id % 13 <> 0 END AS text_again,
       CASE WHEN doc_id % 5 = 0 THEN NULL ELSE doc_id % 3 <> 0 END AS vision_again
FROM labels""",
    "score_pairs": """
SELECT 'b' || CAST(doc_id % 4 AS STRING) AS source, doc_id AS cluster_id, doc_id % 3 AS generation_seed,
       CASE WHEN doc_id % 17 = 0 THEN NULL ELSE 1 + n_chars % 5 END AS reference_score,
       1 + (n_chars * 7 + doc_id) % 5 AS coherent_score FROM documents""",
    # one row per task and pass: did all three replicates pass
    "task_passes": """
SELECT source, run_id, task_id, COUNT(*) = 3 AND MIN(CASE WHEN passed THEN 1 ELSE 0 END) = 1 AS pass_hat_k,
       MAX(CASE WHEN passed THEN 1 ELSE 0 END) = 1 AS pass_at_k
FROM (SELECT source, run_id, task_id, replicate, passed,
             ROW_NUMBER() OVER (PARTITION BY run_id, task_id, replicate ORDER BY attempt DESC) AS rn FROM rollouts) x
WHERE rn = 1 GROUP BY source, run_id, task_id""",
    # four held-out passes per source
    "pass_rates": """
SELECT p_brand AS source, 'p' || CAST(1 + l_linenumber % 4 AS STRING) AS run_id,
       100.0 * CAST(COUNT(CASE WHEN l_returnflag <> 'R' THEN 1 END) AS DOUBLE) / COUNT(*) AS rate
FROM lineitem JOIN part ON l_partkey = p_partkey GROUP BY p_brand, l_linenumber % 4""",
    "stage_log": """
SELECT event_id AS ord, ts, 'p' || CAST(1 + user_id % 20 AS STRING) AS run_id,
       CASE event_type WHEN 'click' THEN 'run_start' WHEN 'view' THEN 'run_done' WHEN 'purchase' THEN 'replay_start'
            WHEN 'signup' THEN 'replay_done' ELSE 'diagnosis_done' END AS event
FROM events WHERE NOT (user_id % 20 = 7 AND event_type = 'view')""",
    # fixed-k results: one row per (failure, candidate step)
    "candidates": """
SELECT CAST(l_orderkey AS STRING) || '/r' || CAST(rn AS STRING) || '/1' AS failure_key, 'b' || CAST(l_orderkey % 4 AS STRING) AS source,
       l_linenumber AS step, l_partkey % 5 AS ordinal_salt,
       CASE l_partkey % 7 WHEN 0 THEN 'argument_variant' WHEN 1 THEN 'early' ELSE 'different_action' END AS divergence,
       CASE l_partkey % 11 WHEN 0 THEN 'skipped' WHEN 1 THEN 'unreplayable' ELSE 'tested' END AS status,
       3 AS k, l_suppkey % 4 AS sub_passed, 3 AS sub_scored,
       l_partkey % 4 AS ctl_passed, CASE WHEN l_partkey % 13 = 0 THEN 0 ELSE 3 END AS ctl_scored,
       l_partkey % 3 = 0 AS ctl_skipped,
       CASE WHEN l_tax > 0.065 THEN 'positive' WHEN l_tax > 0.055 THEN 'unresolved' END AS verdict,
       l_tax > 0.065 AS confirmed, CAST(l_extendedprice AS DECIMAL(18,6)) AS usd
FROM (SELECT l.*, ROW_NUMBER() OVER (PARTITION BY l_orderkey, l_linenumber
        ORDER BY l_partkey, l_suppkey, l_extendedprice, l_quantity, l_discount, l_tax, l_shipdate, l_returnflag, l_linestatus) AS rn
      FROM lineitem l) x""",
    # feasibility of the corruption arms of a cluster in a run
    "arm_assignments": """
SELECT cluster_id, run_id, arm,
       CASE WHEN (members + LENGTH(arm) + LENGTH(component) + CASE run_id WHEN 'p1' THEN 0 ELSE 4 END) % 9 = 0 THEN 'no donor' END AS impossible
FROM (SELECT cluster_id, members, component, run_id,
             EACH('corrupt_where_near', 'corrupt_where_far', 'corrupt_why', 'corrupt_how', 'shuffled', 'coherent_wrong') AS arm
      FROM (SELECT cluster_id, members, component, EACH('p1', 'p2') AS run_id FROM clusters) x) y""",
    "probe_records": """
SELECT 'b' || CAST(CAST(FLOOR(doc_id / 3.0) AS BIGINT) % 4 AS STRING) AS source, 'p' || CAST(1 + CAST(FLOOR(doc_id / 3.0) AS BIGINT) % 2 AS STRING) AS run_id,
       'c' || CAST(CAST(FLOOR(doc_id / 3.0) AS BIGINT) AS STRING) AS cluster_id,
       CASE doc_id % 3 WHEN 0 THEN 'reference' WHEN 1 THEN 'system' ELSE 'shuffled' END AS arm,
       CAST(doc_id % 5 AS STRING) AS assigned_task, CAST(doc_id % 4 AS STRING) AS origin_task,
       CAST(n_chars % 5 AS STRING) AS guess1, CAST(n_chars % 7 AS STRING) AS guess2, CAST(n_chars % 3 AS STRING) AS guess3,
       CASE WHEN n_chars % 6 = 0 THEN NULL ELSE 't' || CAST(n_chars % 4 AS STRING) END AS tool_a,
       CASE WHEN n_chars % 6 = 0 THEN NULL ELSE 't' || CAST(n_chars % 5 AS STRING) END AS tool_b,
       CASE WHEN doc_id % 9 = 0 THEN NULL ELSE 't' || CAST(doc_id % 4 AS STRING) END AS need_a,
       CASE WHEN doc_id % 9 = 0 THEN NULL ELSE 't' || CAST(doc_id % 3 AS STRING) END AS need_b,
       CASE WHEN doc_id % 8 = 0 THEN NULL ELSE ' ' || UPPER(lang) END AS guessed_category, lang AS true_category,
       CASE WHEN n_chars % 19 = 0 THEN 'malformed' END AS error
FROM documents""",
}


def views_used(sql: str) -> list[str]:
    """Views named in a text, dependencies first."""
    found: list[str] = []

    def visit(text: str) -> None:
        for name in VIEWS:
            if name not in found and re.search(rf"\b{name}\b", text):
                visit(re.sub(rf"\b{name}\b", "", VIEWS[name]))
                found.append(name)

    visit(sql)
    return found


def with_views(sql: str, spark: bool = False) -> str:
    """The query with the views it uses as leading common table expressions."""
    names = views_used(sql)
    body = sql.strip()
    if names:
        ctes = ",\n".join(f"{n} AS ({VIEWS[n].strip()})" for n in names)
        body = f"WITH {ctes},\n{body[5:]}" if body.upper().startswith("WITH ") else f"WITH {ctes}\n{body}"
    return re.sub(r"\bEACH\(([^()]*)\)", r"EXPLODE(ARRAY(\1))" if spark else r"UNNEST([\1])", body)
