"""Queries: strict readers on derived text, run names, logs, traces, hashes, scalars, streams."""

from __future__ import annotations

from pyspark.sql import functions as F

from runlens.functions import text as tx
from runlens.operators import metrics as met
from runlens.plans import runs
from runlens.plans.registry import query
from runlens.plans.runs import rounded
from runlens.session import shared_dir
from runlens.sources import jsonl, logs
from runlens.sources import runs as src
from runlens.streaming import jobs

c = F.col

# ------------------------------------------------------------------ JSON

ROW = "event_id bigint, run_id string, event string, arm string, cached boolean, prompt_tokens bigint, usd double, rollout_uid string"
ROW_SQL = "SELECT event_id, run_id, event, arm, cached, CAST(prompt_tokens AS BIGINT) AS prompt_tokens, CAST(usd AS DOUBLE) AS usd, rollout_uid FROM ledger"


@query("scan_jsonl_strict", ROW_SQL)
def _(t):
    rows = t.sql(ROW_SQL)
    lines = rows.select(F.explode(F.array(F.to_json(F.struct("*")), F.lit("  "))).alias("value"))
    return jsonl.parse_jsonl_strict(lines, ROW, ["event_id", "run_id", "event", "arm"])


RECORDS = """SELECT CAST(l_partkey AS STRING) AS task_id, CAST(l_linenumber AS STRING) AS replicate, CAST(ROW_NUMBER() OVER (PARTITION BY l_partkey, l_linenumber
 ORDER BY l_orderkey, l_suppkey, l_extendedprice, l_quantity, l_discount, l_tax, l_shipdate, l_returnflag, l_linestatus) AS INT) AS attempt, l_quantity AS steps, l_tax AS usd, l_returnflag <> 'R' AS passed,
 1.0 - l_discount AS value, l_linestatus = 'F' AS scored FROM lineitem"""


@query("scan_json_records", f"""
SELECT task_id, replicate, attempt, CAST(steps AS BIGINT) AS steps, CASE WHEN scored THEN passed END AS passed, CASE WHEN scored THEN ROUND(value, 6) END AS value FROM ({RECORDS})""")
def _(t):
    rows = t.sql(RECORDS)
    folder = F.concat_ws("/", F.lit("runs/p1/rollouts"), "task_id", "replicate", F.concat(F.lit("attempt_"), c("attempt").cast("string")))
    done = rows.select(F.concat(folder, F.lit("/done.json")).alias("file"),
                       F.to_json(F.struct("task_id", "replicate", "attempt", c("steps").cast("bigint").alias("steps"))).alias("value"))
    scores = rows.where("scored").select(F.concat(folder, F.lit("/score.json")).alias("file"), F.to_json(F.struct("passed", "value")).alias("value"))
    out = jsonl.records_from_texts(done, scores, "task_id string, replicate string, attempt int, steps bigint", "passed boolean, value double")
    return out.select("task_id", "replicate", "attempt", "steps", "score.passed", F.round("score.value", 6).alias("value"))


@query("scan_json_list", """
SELECT event_id, 'a' AS kind, user_id AS n FROM events UNION ALL SELECT event_id, event_type, user_id + 1 FROM events""")
def _(t):
    pair = F.array(F.struct(F.lit("a").alias("kind"), c("user_id").alias("n")), F.struct(c("event_type").alias("kind"), (c("user_id") + 1).alias("n")))
    texts = t.base("events").select("event_id", F.to_json(pair).alias("value"))
    return jsonl.list_from_text(texts, "kind string, n bigint", ["event_id"])


# ------------------------------------------------------------------ runs, hashes, report files

NAMES = """SELECT DISTINCT 'e0b-b' || CAST(1 + p_size % 2 AS STRING) || '-' || REPLACE(p_brand, '#', '-') || '-p' || CAST(1 + p_partkey % 12 AS STRING) || CASE WHEN p_partkey % 5 = 0 THEN '-ref' WHEN p_partkey % 7 = 0 THEN '-x' ELSE '' END AS run_id FROM part"""


@query("scan_runs", f"""
SELECT run_id, SUBSTR(run_id, 5, 2) AS block, REGEXP_EXTRACT(run_id, '^e0b-b[12]-(.+)-p[0-9]+(-ref)?$', 1) AS source, CAST(REGEXP_EXTRACT(run_id, '-p([0-9]+)(-ref)?$', 1) AS INT) AS pass, run_id LIKE '%-ref' AS is_ref
FROM ({NAMES}) WHERE run_id NOT LIKE '%-x'""")
def _(t):
    return src.parse_run_names(t.sql(NAMES), "e0b")


FILES = "SELECT source AS tree, lang || '/' || CAST(doc_id % 3 AS STRING) || '/' || CAST(doc_id AS STRING) || '.txt' AS path, text FROM documents"


@query("table_hash", f"""
WITH f AS (SELECT tree, STRING_SPLIT(path, '/') AS k, path || CHR(0) || STRLEN(text) || CHR(0) || sha256(text) AS item FROM ({FILES})),
b AS (SELECT tree, SUBSTR(sha256(item), 1, 4) AS b, COUNT(*) AS n, sha256(STRING_AGG(item, CHR(10) ORDER BY k, item)) AS d FROM f GROUP BY tree, SUBSTR(sha256(item), 1, 4))
SELECT tree, CAST(SUM(n) AS BIGINT) AS members, sha256(STRING_AGG(b || d, '' ORDER BY b || d)) AS digest FROM b GROUP BY tree""")
def _(t):
    files = t.sql(FILES).select("tree", "path", c("text").cast("binary").alias("content"))
    return src.table_hash(files, ["tree"])


@query("write_report_csv", f"""
SELECT source || ',' || run_id || ',' || COUNT(*) || ',' || COUNT(passed) || ',' || CASE WHEN COUNT(*) % 2 = 0 THEN '' ELSE CONCAT(CHR(34), 'a,', CHR(34), CHR(34), 'b', CHR(34), CHR(34), CHR(34)) END AS line FROM rollouts GROUP BY source, run_id""")
def _(t):
    counts = t.view("rollouts").groupBy("source", "run_id").agg(
        F.count(F.lit(1)).alias("rollouts"), F.count("passed").alias("scored"))
    table = counts.withColumn("note", F.when(c("rollouts") % 2 != 0, 'a,"b"'))
    path = shared_dir(t.spark, "report")
    src.write_report_csv(table, path, ["source", "run_id"])
    back = t.spark.read.option("header", "true").option("escape", '"').csv(path)
    return back.select(src.report_line(table.columns, back).alias("line"))


# ------------------------------------------------------------------ logs and traces

LINES = """SELECT conv_id, turn, LENGTH(text) AS n, '12:00:00 [INFO] [+ ' || CAST(turn AS STRING) || '.5s] ' || CASE LENGTH(text) % 8
 WHEN 0 THEN 'step ' || CAST(turn AS STRING) || ' - model returned in 1.5s, tokens=' || CAST(LENGTH(text) + 3 AS STRING) || ' (prompt=' || CAST(LENGTH(text) AS STRING) || ', completion=3)'
 WHEN 1 THEN 'step ' || CAST(turn AS STRING) || ' - shell exit=' || CASE WHEN turn % 2 = 0 THEN '-1' ELSE 'None' END || ' in 0.25s: ls -la'
 WHEN 2 THEN 'step ' || CAST(turn AS STRING) || ' - SHELL TIMEOUT after 30.0s: sleep 99'
 WHEN 3 THEN 'step ' || CAST(turn AS STRING) || ' - finish called'
 WHEN 4 THEN 'step ' || CAST(turn AS STRING) || ' - no tool calls, finishing with content answer'
 WHEN 5 THEN 'step ' || CAST(turn AS STRING) || ' - MODEL CALL ERROR after 2.0s: boom'
 WHEN 6 THEN 'rollout end exit_reason=finished steps=' || CAST(turn AS STRING) || ' duration=9.5s total_tokens=77 errors=0' ELSE 'noise' END AS value FROM conversations"""
EVENT_NULLS = "NULL AS command, NULL AS exit_code, NULL AS timed_out"


def log_lines(t):
    return t.sql(LINES).select(c("conv_id").alias("file"), c("turn").alias("ord"), "value")


@query("scan_rollout_log", f"""
WITH l AS ({LINES})
SELECT conv_id AS file, turn AS ord, 0 AS sub, 'model_call' AS kind, turn AS step, NULL AS name, {EVENT_NULLS}, 1.5 AS seconds, turn + 0.5 AS elapsed, n AS prompt_tokens, NULL AS error FROM l WHERE n % 8 = 0
UNION ALL SELECT conv_id, turn, 0, 'tool_call', turn, 'run_shell_command', 'ls -la', NULL, NULL, NULL, turn + 0.5, NULL, NULL FROM l WHERE n % 8 = 1
UNION ALL SELECT conv_id, turn, 1, 'observation', turn, 'run_shell_command', NULL, CASE WHEN turn % 2 = 0 THEN -1 END, FALSE, 0.25, turn + 0.5, NULL, NULL FROM l WHERE n % 8 = 1
UNION ALL SELECT conv_id, turn, 0, 'tool_call', turn, 'run_shell_command', 'sleep 99', NULL, NULL, NULL, turn + 0.5, NULL, NULL FROM l WHERE n % 8 = 2
UNION ALL SELECT conv_id, turn, 1, 'observation', turn, 'run_shell_command', NULL, NULL, TRUE, 30.0, turn + 0.5, NULL, NULL FROM l WHERE n % 8 = 2
UNION ALL SELECT conv_id, turn, 0, 'tool_call', turn, 'finish', NULL, NULL, NULL, NULL, turn + 0.5, NULL, NULL FROM l WHERE n % 8 = 3
UNION ALL SELECT conv_id, turn, 0, 'model_call', turn, NULL, NULL, NULL, NULL, 2.0, turn + 0.5, NULL, 'boom' FROM l WHERE n % 8 = 5""".replace("1.5 AS seconds, turn + 0.5", "CAST(1.5 AS DOUBLE) AS seconds, CAST(turn + 0.5 AS DOUBLE)"))
def _(t):
    return logs.rollout_log_events(log_lines(t)).select(
        "file", "ord", "sub", "kind", "step", "name", "command", "exit_code", "timed_out", "seconds", "elapsed", "prompt_tokens", "error")


@query("rollout_log_final", f"""
WITH l AS ({LINES}), e AS (SELECT conv_id, MAX(turn) AS t FROM l WHERE n % 8 = 6 GROUP BY conv_id), k AS (SELECT conv_id, MAX(turn) AS t FROM l WHERE n % 8 = 5 GROUP BY conv_id),
m AS (SELECT l.conv_id, MAX(l.turn) AS step FROM l LEFT JOIN e ON l.conv_id = e.conv_id WHERE l.n % 8 = 0 AND l.turn > COALESCE(e.t, -1) GROUP BY l.conv_id)
SELECT f.conv_id AS file, CASE WHEN e.t IS NULL AND k.t IS NULL THEN CASE WHEN f.quiet THEN 'assistant_no_tool_call' END WHEN COALESCE(e.t, -1) > COALESCE(k.t, -1) THEN 'finished' ELSE 'model_call_error' END AS exit_reason,
 GREATEST(COALESCE(e.t, 0), COALESCE(m.step, 0)) AS steps, CASE WHEN e.t IS NOT NULL THEN CAST(9.5 AS DOUBLE) END AS duration_seconds, CASE WHEN e.t IS NOT NULL THEN CAST(77 AS BIGINT) END AS total_tokens
FROM (SELECT conv_id, BOOL_OR(n % 8 = 4) AS quiet FROM l GROUP BY conv_id) f LEFT JOIN e ON f.conv_id = e.conv_id LEFT JOIN k ON f.conv_id = k.conv_id LEFT JOIN m ON f.conv_id = m.conv_id""")
def _(t):
    return logs.rollout_log_final(log_lines(t))


TRACE = """SELECT 'f' || CAST(CAST(FLOOR(event_id / 100.0) AS BIGINT) AS STRING) AS file,
 event_id % 100 + CASE WHEN event_id % 37 = 3 THEN 5000 ELSE 1 END AS seq, CASE WHEN event_id % 211 = 210 THEN 'other' ELSE 'run' END AS run_id,
 CASE WHEN event_id % 307 = 5 THEN 2 ELSE 1 END AS schema_version FROM events"""
VIOLATIONS = f"""WITH x AS ({TRACE})
SELECT file, seq, 'gap' AS kind FROM x WHERE seq <> 1 AND NOT EXISTS (SELECT 1 FROM x y WHERE y.file = x.file AND y.seq = x.seq - 1)
UNION ALL SELECT file, seq, 'run_id' FROM x WHERE run_id <> (SELECT ARG_MIN(y.run_id, y.seq) FROM x y WHERE y.file = x.file) UNION ALL SELECT file, seq, 'schema_version' FROM x WHERE schema_version <> 1"""


LINED = f"SELECT x.*, ROW_NUMBER() OVER (PARTITION BY file ORDER BY (seq * 7) % 5 + seq, seq) AS line FROM ({TRACE}) x"


@query("validate_trace", f"""{VIOLATIONS}
UNION ALL SELECT file, seq, 'order' FROM (SELECT file, seq, LAG(seq) OVER (PARTITION BY file ORDER BY line) AS before FROM ({LINED})) WHERE seq < before""")
def _(t):
    return logs.validate_trace(t.sql(LINED))


# ------------------------------------------------------------------ scalars


@query("failure_key_parts", """
SELECT l_orderkey, l_linenumber, COUNT(*) AS n, 'a/b-' || l_partkey % 10 AS task, 'r' || l_linenumber AS replicate, CAST(l_suppkey % 3 AS INT) AS attempt FROM lineitem GROUP BY l_orderkey, l_linenumber, l_partkey % 10, l_suppkey % 3""")
def _(t):
    task = F.concat(F.lit("a/b-"), (c("l_partkey") % 10).cast("string"))
    key = tx.failure_key(task, F.concat(F.lit("r"), c("l_linenumber").cast("string")), c("l_suppkey") % 3)
    rows = t.base("lineitem").select("l_orderkey", "l_linenumber", key.alias("key"))
    parts = tx.split_failure_key(c("key"))
    return rows.groupBy("l_orderkey", "l_linenumber", "key").agg(F.count(F.lit(1)).alias("n")).select(
        "l_orderkey", "l_linenumber", "n", parts[0].alias("task"), parts[1].alias("replicate"), parts[2].alias("attempt"))


@query("one_line", r"""
SELECT doc_id, CASE WHEN LENGTH(flat) <= 100 THEN flat ELSE SUBSTR(flat, 1, 99) || '…' END AS line FROM (SELECT doc_id, TRIM(REGEXP_REPLACE(text, '\s+', ' ', 'g')) AS flat FROM documents)""")
def _(t):
    return t.base("documents").select("doc_id", tx.one_line(c("text")).alias("line"))


@query("canonical_json", """
SELECT user_id, sha256('["' || event_type || '","user ' || user_id || '"]') AS sha FROM (SELECT DISTINCT user_id, event_type FROM events)""")
def _(t):
    rows = t.base("events").select("user_id", "event_type").distinct()
    doc = tx.json_list(F.array(c("event_type"), F.concat(F.lit("user "), c("user_id").cast("string"))))
    return rows.select("user_id", F.sha2(doc, 256).alias("sha"))


ANSWERS = """SELECT event_id, CASE event_id % 5 WHEN 0 THEN props WHEN 1 THEN '```json' || CHR(10) || props || CHR(10) || '```' WHEN 2 THEN 'Sure: ' || props || ' done' WHEN 3 THEN 'no object' ELSE '[1, 2]' END AS answer, props FROM events"""


@query("json_from_text", f"SELECT event_id, CASE WHEN event_id % 5 < 3 THEN CAST(REGEXP_EXTRACT(props, '[0-9]+') AS INT) END AS k FROM ({ANSWERS})")
def _(t):
    return t.sql(ANSWERS).select("event_id", F.get_json_object(tx.json_object_text(c("answer")), "$.k").cast("int").alias("k"))


# ------------------------------------------------------------------ streaming


def ledger_stream(t):
    """The ledger view over the events file read as a stream."""
    from runlens import adapters

    jobs.read_table_stream(t.spark, f"{t.folder}/events.parquet").createOrReplaceTempView("runlens_events_stream")
    text = adapters.VIEWS["ledger"].replace("FROM events", "FROM runlens_events_stream")
    return t.spark.sql(text).withColumn("ts", c("ts").cast("timestamp"))


@query("stream_spend_guard", """
WITH s AS (SELECT run_id, ts, event_id, SUM(usd) OVER (PARTITION BY run_id ORDER BY ts, event_id) AS spent FROM ledger WHERE event IN ('call','policy','search')),
x AS (SELECT *, ROW_NUMBER() OVER (PARTITION BY run_id ORDER BY ts, event_id) AS rn FROM s WHERE spent >= 5000)
SELECT run_id, ts, event_id, ROUND(CAST(spent AS DOUBLE), 6) AS spent, CAST(5000 AS DOUBLE) AS cap FROM x WHERE rn = 1""")
def _(t):
    return rounded(jobs.stream_spend_guard(ledger_stream(t), 5000.0), "spent")


@query("stream_ledger_summary", f"SELECT DATE_TRUNC('hour', ts) AS window_start, run_id, {runs.LEDGER_COLS} FROM ledger GROUP BY DATE_TRUNC('hour', ts), run_id")
def _(t):
    return rounded(jobs.stream_ledger_summary(ledger_stream(t)), "usd", "search_usd", "policy_usd")


@query("stream_trace_gaps", VIOLATIONS)
def _(t):
    jobs.read_table_stream(t.spark, f"{t.folder}/events.parquet").createOrReplaceTempView("runlens_events_stream")
    trace = t.spark.sql(TRACE.replace("FROM events", "FROM runlens_events_stream"))
    return jobs.standing(jobs.run_available(jobs.stream_trace_gaps(trace), "trace", work=lambda batch, number, out: jobs.spans_of(batch)))
