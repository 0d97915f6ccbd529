"""Queries: trajectories, alignment, attribution, text and spans."""

from __future__ import annotations

from pyspark.sql import functions as F

from runlens import fixed
from runlens.operators import alignment as aln
from runlens.operators import attribution as att
from runlens.operators import render as ren
from runlens.operators import spans as spn
from runlens.operators import trajectory as trj
from runlens.plans.registry import query

c = F.col

# ------------------------------------------------------------------ trajectories


def entries_of(t):
    """Nested entry rows built from the flat turns."""
    turns = t.view("turns")
    speaks = c("role") == "assistant"
    number = (c("n") % 5).cast("string")
    title = (
        F.when(c("n") % 4 == 0, F.concat(number, F.lit(".0")))
        .when(c("n") % 4 == 1, F.concat(F.lit('9, "title": '), number))
        .when(c("n") % 4 == 2, F.concat(F.lit('{"b":['), number, F.lit(',2e1] , "a":"x\\u0041"}')))
        .otherwise(number)
    )
    arguments = (
        F.when(c("tool_name") == "todo_list_tasks", F.concat(
            F.lit('{"title": '), title, F.lit(', "task_id": "t'), (c("n") % 3).cast("string"), F.lit('"}')))
        .when(c("tool_name") == "finish", F.concat(F.lit('{"answer": "A  '), c("n").cast("string"), F.lit('"}')))
        .otherwise(F.to_json(F.struct("command")))
    )
    call = F.struct(c("ord").cast("string").alias("id"), c("tool_name").alias("name"), arguments.alias("arguments"))
    none = F.array().cast("array<struct<id:string,name:string,arguments:string>>")
    return turns.select(
        "rollout_id", "ord", "step", "role",
        F.when(speaks, F.struct(
            "content", F.when(c("reasons"), "because").alias("reasoning_content"),
            F.when(c("n") % 6 == 0, none).otherwise(F.array(call)).alias("tool_calls"))).alias("message"),
        F.when(~speaks, call).alias("tool_call"),
        F.when(~speaks, F.struct(
            "content", F.lit(None).cast("string").alias("stdout"), F.lit(None).cast("string").alias("stderr"),
            c("exit_code"), c("timed_out").alias("timeout"), F.lit(0.1).alias("duration_seconds"))).alias("tool_output"),
        F.when(speaks, F.struct("prompt_tokens", "completion_tokens", "cached_tokens")).alias("token_usage"),
        c("ord").cast("double").alias("completed_at"),
    )


@query("trajectory_events", """
SELECT rollout_id, CAST(ord AS BIGINT) AS ord, 0 AS sub, CASE role WHEN 'assistant' THEN 'model_call' ELSE 'tool_call' END AS kind, step,
 CASE role WHEN 'tool' THEN tool_name END AS name, CASE role WHEN 'assistant' THEN prompt_tokens END AS prompt_tokens FROM turns
UNION ALL SELECT rollout_id, ord, 1, 'observation', step, tool_name, NULL FROM turns WHERE role = 'tool'
UNION ALL SELECT DISTINCT rollout_id, -1, 0, 'rollout_start', NULL, NULL, NULL FROM turns
UNION ALL SELECT DISTINCT rollout_id, 4611686018427387904, 0, 'final', NULL, NULL, NULL FROM turns
UNION ALL SELECT DISTINCT rollout_id, 4611686018427387904, 1, 'rollout_end', NULL, NULL, NULL FROM turns""")
def _(t):
    entries = entries_of(t)
    meta = entries.groupBy("rollout_id").agg(F.max("step").alias("steps")).select(
        "rollout_id", F.lit("finished").alias("exit_reason"), F.lit("").alias("final_answer"), "steps",
        F.lit(1.0).alias("duration_seconds"),
        F.struct(F.lit(0).alias("prompt_tokens")).alias("token_usage"))
    events = trj.trajectory_events(entries, meta)
    tokens = F.get_json_object("payload", "$.usage.prompt_tokens").cast("bigint")
    return events.select("rollout_id", "ord", "sub", "kind", "step", "name",
                         F.when(c("kind") == "model_call", tokens).alias("prompt_tokens"))


@query("step_usage", """
SELECT rollout_id, COUNT(*) AS steps, CAST(SUM(prompt_tokens) AS BIGINT) AS prompt_tokens, CAST(SUM(completion_tokens) AS BIGINT) AS completion_tokens,
 CAST(SUM(LEAST(cached_tokens, prompt_tokens)) AS BIGINT) AS cache_hit_prompt_tokens, COUNT(*) FILTER (WHERE reasons) AS reasoning_steps
FROM turns WHERE role = 'assistant' GROUP BY rollout_id""")
def _(t):
    return trj.step_usage(trj.model_calls(entries_of(t)))


NORMAL = "CASE n % 5 WHEN 0 THEN 'ls -la notes' WHEN 3 THEN 'echo hi > report.md' WHEN 4 THEN REPLACE(command, ' && true', '') ELSE command END"
KLASS = """CASE WHEN n % 6 = 0 THEN 'final' WHEN tool_name = 'finish' THEN 'finish' WHEN tool_name = 'todo_list_tasks' THEN 'tool'
 WHEN n % 5 IN (1, 3) THEN 'shell_mut' WHEN n % 5 = 2 THEN 'shell_opaque' ELSE 'shell_ro' END"""


@query("actions", f"""
SELECT rollout_id, step, idx, name, klass, CASE klass WHEN 'shell_mut' THEN 'shell_mut:' || CASE n % 5 WHEN 1 THEN 'out' || (n % 9) || '.txt' ELSE 'report.md' END
  WHEN 'shell_opaque' THEN 'shell_opaque:' || cmd WHEN 'tool' THEN name || ':{{"task_id": "t' || (n % 3) || '"}}' ELSE klass END AS identity,
 CASE klass WHEN 'final' THEN 'final:' || LOWER(TRIM(REGEXP_REPLACE(content, '\\s+', ' ', 'g'))) WHEN 'finish' THEN 'finish:a ' || n
  WHEN 'tool' THEN name || ':{{"task_id": "t' || (n % 3) || '", "title": ' || CASE n % 4 WHEN 0 THEN (n % 5) || '.0'
   WHEN 2 THEN '{{"a": "xA", "b": [' || (n % 5) || ', 20.0]}}' ELSE CAST(n % 5 AS VARCHAR) END || '}}' ELSE 'shell:' || cmd END AS exact
FROM (SELECT rollout_id, step, 0 AS idx, n, content, {NORMAL} AS cmd, {KLASS} AS klass, CASE WHEN n % 6 = 0 THEN '__final__' ELSE tool_name END AS name
 FROM turns WHERE role = 'assistant')""")
def _(t):
    return trj.actions(entries_of(t)).drop("command", "answer")


@query("classify_shell", f"""
SELECT rollout_id, ord, {NORMAL} AS command, CASE WHEN n % 5 IN (1, 3) THEN 'shell_mut' WHEN n % 5 = 2 THEN 'shell_opaque' ELSE 'shell_ro' END AS klass FROM turns""")
def _(t):
    from runlens.functions import text as tx

    command = tx.normalise_command(c("command"))
    return t.view("turns").select("rollout_id", "ord", command.alias("command"), tx.classify_shell(command).alias("klass"))


RULE_VALUES = ", ".join(f"('{n}', '{fixed.ACTIVITY_RULES.get(n, 'every')}')" for n, *_ in fixed.COMPONENTS)


@query("active_steps", f"""
WITH comp(component, activity) AS (VALUES {RULE_VALUES}),
s AS (SELECT rollout_id, step, BOOL_OR(role = 'assistant') AS every, BOOL_OR(role = 'tool') AS tool, BOOL_OR(role = 'tool' AND tool_name = 'run_shell_command') AS shell,
 BOOL_OR(role = 'tool' AND (timed_out OR exit_code <> 0)) AS failed FROM turns GROUP BY rollout_id, step),
r AS (SELECT rollout_id, MAX(step) AS last_step, BOOL_OR(failed) AS any_failed FROM s GROUP BY rollout_id)
SELECT s.rollout_id, comp.component, s.step FROM s JOIN r ON s.rollout_id = r.rollout_id JOIN comp ON
 (activity = 'every' AND every) OR (activity = 'tool' AND tool) OR (activity = 'shell' AND shell) OR (activity = 'last' AND step = last_step)
 OR (activity = 'failed_result' AND CASE WHEN any_failed THEN failed ELSE every END)""")
def _(t):
    return trj.active_steps(entries_of(t), att.component_table(t.spark))


COMMANDS = """SELECT page_id AS rollout_id, 1 AS step, 'b' || CAST(page_id % 4 AS STRING) AS source, 'run_shell_command' AS name,
 CASE page_id % 5 WHEN 0 THEN 'curl -s https://google.SERPER.dev/search -d q=' || url WHEN 1 THEN 'wget ' || url || ' ' || url ELSE CASE page_id % 3 WHEN 0 THEN 'cat ' || url ELSE 'curl ' || url END END AS command FROM pages"""
HOSTS = f"""SELECT source, host, COUNT(*) AS commands FROM (SELECT DISTINCT rollout_id, source, host FROM
 (SELECT rollout_id, source, UNNEST(REGEXP_EXTRACT_ALL(command, 'https?://([a-zA-Z0-9_.-]+)', 1)) AS host FROM ({COMMANDS}) WHERE command LIKE '%curl%' OR command LIKE '%wget%')) GROUP BY source, host"""


@query("web_hosts", HOSTS)
def _(t):
    return trj.web_hosts(t.sql(COMMANDS), ["source"])


@query("top_hosts", f"""SELECT source, host, commands, CAST(rank AS INT) AS rank FROM (SELECT source, host, commands, ROW_NUMBER() OVER (PARTITION BY source ORDER BY commands DESC, host) AS rank FROM ({HOSTS})) WHERE rank <= 8""")
def _(t):
    return trj.top_hosts(trj.web_hosts(t.sql(COMMANDS), ["source"]), ["source"])


@query("approx_search_calls", f"SELECT rollout_id, step, sha256(command) AS command_sha256 FROM ({COMMANDS}) WHERE rollout_id % 5 = 0")
def _(t):
    return trj.approx_search_calls(t.sql(COMMANDS))


REPLAYED = """SELECT doc_id, text, CASE WHEN doc_id % 3 = 0 THEN 'todo_list_tasks' ELSE 'run_shell_command' END AS name, 0 AS recorded_exit,
 CASE WHEN n_chars % 11 = 0 THEN 1 ELSE 0 END AS fresh_exit, n_chars % 2 = 0 AS mutated, n_chars % 5 = 0 AS quoted, n_chars % 3 AS recorded_value, doc_id % 3 AS fresh_value FROM documents"""


@query("mask_and_compare", f"""
SELECT doc_id, recorded_value = fresh_value AS output_equal, CASE WHEN name = 'run_shell_command' AND recorded_exit <> fresh_exit THEN 'exit_code_differs'
 WHEN recorded_value <> fresh_value AND (mutated OR quoted) THEN 'mutating_or_quoted_output_differs' WHEN recorded_value <> fresh_value THEN 'warning' ELSE 'equal' END AS outcome FROM ({REPLAYED})""")
def _(t):
    def output(day, pid, value, folder, shape):
        """The document's text with volatile parts, as streams, as JSON with streams, or as plain content."""
        head = F.concat(F.lit(f"at {day}T01:02:03 pid={pid} value "), c(value).cast("string"), F.lit(f"  in {folder}/"), c("doc_id").cast("string"), F.lit(" "))
        body = F.concat(head, F.coalesce(c("text"), F.lit("")))
        none = F.lit(None).cast("string")
        decoded = F.to_json(F.struct(body.alias("stdout"), F.lit(f"made /tmp/x{pid}/log").alias("stderr")))
        return F.struct(F.when(shape == 0, none).when(shape == 1, decoded).otherwise(body).alias("content"),
                        F.when(shape == 0, body).alias("stdout"), F.when(shape == 0, f"made /tmp/x{pid}/log").alias("stderr"))

    shape = c("doc_id") % 3
    pairs = t.sql(REPLAYED).withColumns({
        "recorded": output("2024-01-02", 5123, "recorded_value", "/data/run-1(a)", shape), "fresh": output("2025-03-04", 7, "fresh_value", "/replay/w", shape),
        "workspaces": F.array(F.lit("/data/run-1(a)"), F.lit("/replay/w"), F.lit(None))})
    return trj.mask_and_compare(pairs).select("doc_id", "output_equal", "outcome")


SPOKEN = """SELECT conv_id AS rollout_id, turn AS step, text AS heard,
 text || CASE WHEN conv_id % 3 = 0 THEN ' ' || COALESCE(LAG(text) OVER (PARTITION BY conv_id ORDER BY turn), '') ELSE '' END AS said FROM conversations"""


CUTOFFS = "SELECT conv_id AS rollout_id, CAST(MAX(turn) + 1 - conv_id % 3 AS INT) AS cutoff FROM conversations GROUP BY conv_id"


@query("quoted_later", f"""
WITH x AS (SELECT p.*, k.cutoff FROM ({SPOKEN}) p JOIN ({CUTOFFS}) k ON p.rollout_id = k.rollout_id WHERE step < cutoff),
o AS (SELECT rollout_id, step, heard FROM x WHERE step % 2 = 1), s AS (SELECT rollout_id, step, said FROM x WHERE step % 2 = 0),
l AS (SELECT rollout_id, step, TRIM(UNNEST(STRING_SPLIT(heard, CHR(10)))) AS line FROM o)
SELECT o.rollout_id, o.step, EXISTS (SELECT 1 FROM l JOIN s ON l.rollout_id = s.rollout_id WHERE l.rollout_id = o.rollout_id AND l.step = o.step AND LENGTH(l.line) >= 12
 AND s.step > l.step AND CONTAINS(s.said, l.line)) AS quoted FROM o""")
def _(t):
    rows = t.sql(SPOKEN)
    none, shape = F.lit(None).cast("string"), F.length("heard") % 3
    listens = c("step") % 2 == 1
    shown = F.struct(
        F.when(shape == 0, F.to_json(F.struct(F.lit(1).alias("n"), c("heard").alias("out")))).when(shape == 1, c("heard")).alias("content"),
        F.when(shape == 2, c("heard")).otherwise("").alias("stdout"), none.alias("stderr"))
    calls = F.array().cast("array<struct<id:string,name:string,arguments:string>>")
    message = F.struct(F.when(shape == 0, c("said")).alias("content"), F.when(shape == 1, c("said")).alias("reasoning_content"), F.when(
        shape == 2, F.array(F.struct(F.lit("a").alias("id"), F.lit("b").alias("name"), c("said").alias("arguments")))).otherwise(calls).alias("tool_calls"))
    entries = rows.select("rollout_id", "step", F.when(listens, "tool").otherwise("assistant").alias("role"),
                          F.when(listens, shown).alias("tool_output"), F.when(~listens, message).alias("message"))
    heard, said = trj.observations(entries), trj.spoken_texts(entries)
    return trj.quoted_later(heard, said, t.sql(CUTOFFS)).drop("cutoff")


# ------------------------------------------------------------------ alignment

MUT = "({s}.klass = 'shell_mut' OR ({s}.klass = 'tool' AND {s}.name <> 'todo_list_tasks'))"
ALIGN = f"""WITH f AS (SELECT * FROM step_actions WHERE side = 'failed'), r AS (SELECT * FROM step_actions WHERE side = 'reference'),
s AS (SELECT COALESCE(f.pair_id, r.pair_id) AS pair_id, COALESCE(f.step, r.step) AS step, f.klass AS fk, r.klass AS rk, f.identity AS fi, r.identity AS ri,
 f.exact AS fe, r.exact AS re, f.name AS fname, r.name AS rname, {MUT.format(s='f')} AS fm, {MUT.format(s='r')} AS rm
 FROM f FULL JOIN r ON f.pair_id = r.pair_id AND f.step = r.step),
k AS (SELECT s.*, e.exit_reason, CASE WHEN fk IS NULL AND e.exit_reason = 'finished' THEN NULL WHEN fk IS NULL AND e.exit_reason = 'model_call_error' THEN 'error'
 WHEN fk IS NULL THEN 'budget' WHEN rk IS NULL AND fk IN ('finish','final') THEN NULL WHEN rk IS NULL THEN 'late_finish'
 WHEN fi <> ri THEN CASE WHEN fk = 'final' AND rk = 'finish' THEN 'no_tool_call' WHEN fk = 'final' AND rk NOT IN ('finish','final') THEN 'no_tool_call'
  WHEN fk = 'finish' AND rk NOT IN ('finish','final') THEN 'premature_finish' WHEN rk IN ('finish','final') AND fk NOT IN ('finish','final') THEN 'late_finish'
  WHEN fk <> 'shell_opaque' AND rk <> 'shell_opaque' AND rm AND NOT fm THEN 'missing_mutation' WHEN fk <> 'shell_opaque' AND rk <> 'shell_opaque' AND fm AND NOT rm THEN 'extra_mutation'
  WHEN step = 1 THEN 'early' ELSE 'different_action' END
 WHEN fe <> re AND rk = 'tool' THEN 'argument_variant' END AS divergence FROM s LEFT JOIN pair_exits e ON s.pair_id = e.pair_id),
z AS (SELECT k.*, fk IS NULL OR rk IS NULL OR COALESCE(fi <> ri AND divergence IN ('premature_finish','no_tool_call','late_finish'), FALSE) AS terminal FROM k),
v AS (SELECT z.* FROM z WHERE step <= COALESCE((SELECT MIN(y.step) FROM z y WHERE y.pair_id = z.pair_id AND y.terminal), 1000000)),
cand AS (SELECT pair_id, step, divergence, exit_reason, fk, ROW_NUMBER() OVER (PARTITION BY pair_id ORDER BY CASE WHEN divergence = 'argument_variant' THEN 1 ELSE 0 END, step) AS ordinal FROM v WHERE divergence IS NOT NULL)
"""


@query("align_steps", ALIGN + """
SELECT pair_id, step, CAST(CASE WHEN fk IS NULL THEN 0 ELSE 1 END AS BIGINT) AS f_actions, CAST(CASE WHEN rk IS NULL THEN 0 ELSE 1 END AS BIGINT) AS r_actions,
 COALESCE(fi, '') AS f_key, COALESCE(ri, '') AS r_key, COALESCE(fm, FALSE) AS f_mutates, COALESCE(rm, FALSE) AS r_mutates FROM s""")
def _(t):
    return aln.align_steps(t.view("step_actions")).select(
        "pair_id", "step", "f_actions", "r_actions", F.concat_ws(",", "f_class_key").alias("f_key"),
        F.concat_ws(",", "r_class_key").alias("r_key"), "f_mutates", "r_mutates")


@query("divergence_kind", ALIGN + " SELECT divergence, terminal, COUNT(*) AS n FROM z GROUP BY divergence, terminal")
def _(t):
    rows = aln.classified_steps(aln.align_steps(t.view("step_actions")), t.view("pair_exits"))
    return rows.groupBy("divergence", "terminal").agg(F.count(F.lit(1)).alias("n"))


@query("align_pairs", ALIGN + " SELECT pair_id, ordinal, step, divergence FROM cand")
def _(t):
    return aln.align_pairs(t.view("step_actions"), t.view("pair_exits")).select("pair_id", "ordinal", "step", "divergence")


@query("alignment_summary", ALIGN + """
SELECT z.pair_id, COALESCE(MAX(step) FILTER (WHERE fk IS NOT NULL), 0) AS failed_steps, COALESCE(MAX(step) FILTER (WHERE rk IS NOT NULL), 0) AS reference_steps,
 (SELECT MIN(step) FROM v WHERE v.pair_id = z.pair_id AND fe IS DISTINCT FROM re) AS t_exact,
 (SELECT MIN(step) FROM cand WHERE cand.pair_id = z.pair_id AND divergence <> 'argument_variant') AS t_class FROM z GROUP BY z.pair_id""")
def _(t):
    return aln.alignment_summary(t.view("step_actions"), t.view("pair_exits"))


@query("first_candidates", ALIGN + " SELECT pair_id, ordinal, step, divergence FROM cand WHERE ordinal <= 2")
def _(t):
    found = aln.align_pairs(t.view("step_actions"), t.view("pair_exits"))
    return aln.first_candidates(found, 2).select("pair_id", "ordinal", "step", "divergence")


REFS = """SELECT l_partkey AS task_id, l_linenumber AS replicate, l_suppkey AS attempt,
 CASE WHEN l_quantity < 20.5 THEN 'genuine' WHEN l_quantity < 40.5 THEN 'shortcut' ELSE 'undetermined' END AS verdict FROM lineitem"""
FAILED = """SELECT source, run_id, task_id, replicate, attempt, CASE error_family WHEN 'infra' THEN 'infra' WHEN 'budget' THEN 'budget' ELSE 'task' END AS family,
 'finished' AS exit_reason FROM rollouts WHERE NOT COALESCE(passed, FALSE)"""


@query("failures_with_reference", f"""
SELECT f.source, f.run_id, f.task_id, f.replicate, f.attempt, g.replicate AS reference_replicate, g.attempt AS reference_attempt FROM ({FAILED}) f JOIN
 (SELECT task_id, replicate, attempt FROM (SELECT *, ROW_NUMBER() OVER (PARTITION BY task_id ORDER BY replicate, attempt) AS rn FROM ({REFS}) WHERE verdict = 'genuine') WHERE rn = 1) g
 ON f.task_id = g.task_id WHERE f.family <> 'infra'""")
def _(t):
    return aln.failures_with_reference(t.sql(FAILED), t.sql(REFS)).select(
        "source", "run_id", "task_id", "replicate", "attempt", "reference_replicate", "reference_attempt")


# ------------------------------------------------------------------ attribution

OBS = """SELECT CAST(FLOOR(conv_id / 2.0) AS BIGINT) AS pair_id, turn + 1 AS step, turn AS ord,
 CASE WHEN LENGTH(text) % 6 = 3 THEN 'finish' ELSE 'run_shell_command' END AS name,
 text || CASE WHEN LENGTH(text) % 13 = 0 THEN ' Unknown Tool x' ELSE '' END || CASE WHEN LENGTH(text) % 3 = 0 THEN ' 77' ELSE '' END AS text, LENGTH(text) % 11 = 0 AS timed_out,
 CASE WHEN LENGTH(text) % 7 = 0 THEN 2 ELSE 0 END AS exit_code, LENGTH(text) % 5 = 0 AS truncated FROM conversations WHERE conv_id % 2 = 0"""
ANSWERS = """SELECT CAST(FLOOR(conv_id / 2.0) AS BIGINT) AS pair_id, turn + 1 AS step, CASE WHEN LENGTH(text) % 4 = 0 THEN 'no numbers' ELSE 'it is 77 of 12.5' END AS answer
 FROM conversations WHERE conv_id % 2 = 0 AND LENGTH(text) % 6 = 3"""


@query("prior_observation", f"""
SELECT p.pair_id, p.step, (SELECT MAX_BY(o.truncated, o.step) FROM ({OBS}) o WHERE o.pair_id = p.pair_id AND o.step < p.step) AS prior_result
FROM (SELECT pair_id, step FROM step_actions WHERE side = 'reference') p""")
def _(t):
    probes = t.view("step_actions").where(c("side") == "reference").select("pair_id", "step")
    return att.prior_observation(probes, t.sql(OBS).withColumn("result", c("truncated")))


@query("unsupported_answer", f"""
SELECT a.pair_id, MIN_BY(a.answer, a.step) LIKE '%77%' AND NOT EXISTS (SELECT 1 FROM ({OBS}) o WHERE o.pair_id = a.pair_id AND (CONTAINS(o.text, '77') OR CONTAINS(o.text, '12.5'))) AS unsupported
FROM ({ANSWERS}) a GROUP BY a.pair_id""")
def _(t):
    return att.unsupported_answer(t.sql(ANSWERS), t.sql(OBS))


RULE_SQL = f"""{ALIGN}, obs AS ({OBS}), ans AS ({ANSWERS}),
flags AS (SELECT d.*, COALESCE((SELECT BOOL_OR(timed_out) FROM obs o WHERE o.pair_id = d.pair_id AND o.step = d.step), FALSE) AS timeout_here,
 COALESCE((SELECT BOOL_OR(CONTAINS(LOWER(text), 'unknown tool')) FROM obs o WHERE o.pair_id = d.pair_id AND o.step = d.step), FALSE) AS unknown_here,
 COALESCE((SELECT BOOL_OR(CONTAINS(answer, '77')) FROM ans a WHERE a.pair_id = d.pair_id AND a.step = d.step), FALSE)
  AND NOT EXISTS (SELECT 1 FROM obs o WHERE o.pair_id = d.pair_id AND o.name <> 'finish' AND (CONTAINS(o.text, '77') OR CONTAINS(o.text, '12.5'))) AS unsupported,
 EXISTS (SELECT 1 FROM r WHERE r.pair_id = d.pair_id AND r.klass = 'tool' AND r.name NOT IN (SELECT f.name FROM f WHERE f.pair_id = d.pair_id)) AS tools_missing,
 (SELECT MAX_BY(timed_out OR exit_code <> 0, step) FROM obs o WHERE o.pair_id = d.pair_id AND o.step < d.step) AS prior_failed,
 (SELECT MAX_BY(truncated, step) FROM obs o WHERE o.pair_id = d.pair_id AND o.step < d.step) AS prior_truncated FROM cand d)
SELECT pair_id, ordinal, step, divergence, CASE WHEN divergence = 'error' OR (exit_reason = 'model_call_error' AND fk IS NULL) THEN 'R5' WHEN divergence = 'budget' THEN 'R6'
 WHEN timeout_here THEN 'R7' WHEN divergence = 'no_tool_call' THEN 'R4' WHEN divergence = 'premature_finish' THEN CASE WHEN unsupported THEN 'R3a' ELSE 'R3' END
 WHEN unknown_here THEN 'R8' WHEN divergence = 'early' THEN 'R10' WHEN divergence = 'missing_mutation' THEN 'R9' WHEN fk = 'tool' THEN CASE WHEN tools_missing THEN 'R2a' ELSE 'R2' END
 WHEN prior_failed THEN 'R1a' WHEN prior_truncated THEN 'R1b' ELSE 'R1' END AS rule FROM flags"""


@query("attribute", RULE_SQL)
def _(t):
    found = aln.align_pairs(t.view("step_actions"), t.view("pair_exits"))
    out = att.attribute(found, t.view("step_actions"), t.sql(OBS), t.sql(ANSWERS), att.rule_table(t.spark))
    return out.select("pair_id", "ordinal", "step", "divergence", "rule")


SYSTEM = """SELECT doc_id, CASE n_chars % 7 WHEN 0 THEN 'model_call_error' WHEN 1 THEN 'max_steps' WHEN 2 THEN 'assistant_no_tool_call' WHEN 3 THEN 'rollout_wall_clock_timeout' ELSE 'finished' END AS exit_reason,
 n_chars % 5 < 2 AS last_is_finish, n_chars % 3 = 0 AS unsupported, n_chars % 4 = 0 AS any_failed_result, n_chars % 11 < 4 AS any_truncated FROM documents"""


@query("attribute_system", f"""
SELECT doc_id, CASE WHEN exit_reason = 'model_call_error' THEN 'R5' WHEN exit_reason IN ('max_steps','rollout_wall_clock_timeout') THEN 'R6' WHEN exit_reason = 'assistant_no_tool_call' THEN 'R4'
 WHEN last_is_finish AND unsupported THEN 'R3a' WHEN last_is_finish THEN 'R3' WHEN any_failed_result THEN 'R1a' WHEN any_truncated THEN 'R1b' ELSE 'R1' END AS rule FROM ({SYSTEM})""")
def _(t):
    return att.attribute_system(t.sql(SYSTEM), att.rule_table(t.spark)).select("doc_id", "rule")


# ------------------------------------------------------------------ text


@query("step_blocks", r"""
WITH e AS (SELECT rollout_id, step, role, tool_name, n, reasons, ord, exit_code, timed_out, TRIM(REGEXP_REPLACE(content, '\s+', ' ', 'g')) AS flat,
 CASE WHEN tool_name = 'todo_list_tasks' THEN '{"title": ' || CASE n % 4 WHEN 0 THEN (n % 5) || '.0' WHEN 1 THEN '9, "title": ' || (n % 5)
   WHEN 2 THEN '{"b":[' || (n % 5) || ',2e1] , "a":"x' || CHR(92) || 'u0041"}' ELSE CAST(n % 5 AS VARCHAR) END || ', "task_id": "t' || (n % 3) || '"}' WHEN tool_name = 'finish' THEN '{"answer": "A ' || n || '"}'
  ELSE '{"command":"' || TRIM(REGEXP_REPLACE(command, '\s+', ' ', 'g')) || '"}' END AS args FROM turns),
l AS (SELECT rollout_id, step, CASE WHEN role = 'assistant' THEN CASE WHEN reasons THEN '  reasoning: because' || CHR(10) ELSE '' END
  || '  says: ' || CASE WHEN LENGTH(flat) <= 300 THEN flat ELSE SUBSTR(flat, 1, 299) || '…' END || CASE WHEN n % 6 = 0 THEN '' ELSE CHR(10) || '  call ' || tool_name || '(' || args || ')' END
 ELSE '  observation[' || tool_name || ']: ' || CASE WHEN LENGTH(flat) <= 240 THEN flat ELSE SUBSTR(flat, 1, 239) || '…' END END AS lines, ord FROM e)
SELECT rollout_id, step, 'step ' || step || ':' || CHR(10) || STRING_AGG(lines, CHR(10) ORDER BY ord) AS text FROM l GROUP BY rollout_id, step""")
def _(t):
    return ren.step_blocks(entries_of(t))


BUDGET = 1200
BLOCKS = "SELECT conv_id AS rollout_id, turn + 1 AS step, 'step ' || CAST(turn + 1 AS STRING) || ': ' || text AS text FROM conversations"


@query("condense_steps", f"""
WITH b AS (SELECT rollout_id, step, text, LENGTH(text) AS len, ROW_NUMBER() OVER (PARTITION BY rollout_id ORDER BY step) - 1 AS pos, COUNT(*) OVER (PARTITION BY rollout_id) AS n,
  SUM(LENGTH(text)) OVER (PARTITION BY rollout_id) + COUNT(*) OVER (PARTITION BY rollout_id) - 1 AS total FROM ({BLOCKS})),
d AS (SELECT rollout_id, pos FROM (SELECT *, COALESCE(SUM(len + 1) OVER (PARTITION BY rollout_id ORDER BY ABS(pos - n / 2.0), pos ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS gone
  FROM b WHERE total > {BUDGET} AND pos >= 2 AND pos < n - 2) WHERE total - gone > {BUDGET}),
k AS (SELECT b.*, pos - COALESCE(LAG(pos) OVER (PARTITION BY rollout_id ORDER BY pos), -1) - 1 AS gap FROM b WHERE NOT EXISTS (SELECT 1 FROM d WHERE d.rollout_id = b.rollout_id AND d.pos = b.pos))
SELECT rollout_id, STRING_AGG(CASE WHEN gap > 0 THEN '  … ' || gap || ' step(s) omitted …' || CHR(10) || text ELSE text END, CHR(10) ORDER BY pos) AS text FROM k GROUP BY rollout_id""")
def _(t):
    return ren.condense_steps(t.sql(BLOCKS), budget=BUDGET)


NAMED = """SELECT doc_id, 'The tool_router in agent/loop.py sent ' || source || ' to `finish` and Finisher, finish ' || lang || ' agent/loop.pyx ' || text AS mechanism,
 'fix ' || source || ' in the loop' AS fix_hint FROM documents"""
TOKENS = {"tool_router": "component", "agent/loop.py": "path", "finish": "tool", "loop": "component", "src1": "routine", "src12": "setting"}


def strip_sql():
    """Boundaries as captured neighbours, replaced twice because RE2 has no lookaround."""
    out = "mechanism"
    for token, klass in sorted(TOKENS.items(), key=lambda kv: -len(kv[0])):
        edge = r"[^\p{L}\p{M}\p{Nd}\p{Pc}/]" if "/" in token else r"[^\p{L}\p{M}\p{Nd}\p{Pc}]"
        for _ in range(2):
            out = f"REGEXP_REPLACE({out}, '(^|{edge}){token.replace('.', chr(92) + '.')}({edge}|$)', '\\1[{klass}]\\2', 'g')"
    return f"REGEXP_REPLACE({out}, '`\\[(\\w+)\\]`', '[\\1]', 'g')"


def count_sql(klass):
    return f"CAST((LENGTH(out) - LENGTH(REPLACE(out, '[{klass}]', ''))) / {len(klass) + 2} AS INT) AS mechanism_{klass}"


@query("strip_identifiers", f"""
SELECT doc_id, out AS mechanism, fix_hint, {', '.join(count_sql(k) for k in sorted(set(TOKENS.values())))} FROM (SELECT doc_id, fix_hint, {strip_sql()} AS out FROM ({NAMED}))""")
def _(t):
    return ren.strip_identifiers(t.sql(NAMED), "mechanism", TOKENS)


CAPPED = r"""SELECT doc_id, source, TRIM(REGEXP_REPLACE(text, '\s+', ' ', 'g')) AS flat FROM documents"""


@query("field_caps", f"SELECT source, CAST(GREATEST(20, MAX(LENGTH(flat))) AS INT) AS text_cap FROM ({CAPPED}) GROUP BY source")
def _(t):
    return ren.field_caps(t.base("documents"), ["source"], ["text"])


@query("fit_text", f"""
SELECT doc_id, CASE WHEN LENGTH(flat) <= 120 THEN flat ELSE REGEXP_REPLACE(CASE WHEN CONTAINS(SUBSTR(flat, 1, 120), ' ') THEN REGEXP_REPLACE(SUBSTR(flat, 1, 120), ' [^ ]*$', '') ELSE SUBSTR(flat, 1, 120) END, '[ ,;:]+$', '') || '.' END AS fitted
FROM ({CAPPED})""")
def _(t):
    return t.base("documents").select("doc_id", ren.fit_text(c("text"), F.lit(120)).alias("fitted"))


MARKED = """SELECT failure_key, component AS cluster_id, component, step, severity, cause_label, attribution,
 CASE WHEN step % 3 = 0 THEN 'zztool and zztools in `zztool` ' ELSE '' END || mechanism AS mechanism, fix_hint || ' of zz/thing.py (zztool)' AS fix_hint FROM diagnoses"""
MARKS = {"zztool": "tool", "zz/thing.py": "path", "never": "routine"}
FITTED = """CASE WHEN LENGTH({f}) <= {cap} THEN {f} ELSE REGEXP_REPLACE(CASE WHEN CONTAINS(SUBSTR({f}, 1, {cap}), ' ')
 THEN REGEXP_REPLACE(SUBSTR({f}, 1, {cap}), ' [^ ]*$', '') ELSE SUBSTR({f}, 1, {cap}) END, '[ ,;:]+$', '') || '.' END"""


@query("render_diagnosis", f"""
WITH x AS (SELECT *, TRIM(REGEXP_REPLACE(REPLACE(mechanism, 'zztool and zztools in `zztool` ', '[tool] and zztools in [tool] '), '\\s+', ' ', 'g')) AS m,
  REPLACE(REPLACE(fix_hint, 'zz/thing.py', '[path]'), '(zztool)', '([tool])') AS h FROM ({MARKED})),
k AS (SELECT cluster_id, GREATEST(20, MAX(LENGTH(m))) AS m_cap, GREATEST(20, MAX(LENGTH(h))) AS h_cap FROM x WHERE attribution = 'rule' GROUP BY cluster_id),
f AS (SELECT x.*, COALESCE(m_cap, LENGTH(m)) AS m_cap, COALESCE(h_cap, LENGTH(h)) AS h_cap FROM x LEFT JOIN k ON x.cluster_id = k.cluster_id),
y AS (SELECT *, {FITTED.format(f='m', cap='m_cap')} AS fm, {FITTED.format(f='h', cap='h_cap')} AS fh FROM f)
SELECT failure_key, 'DIAGNOSIS' || CHR(10) || 'WHERE: component `' || component || '`, step ' || COALESCE(CAST(step AS STRING), 'unknown') || CHR(10) || 'SEVERITY: ' || severity || CHR(10)
 || 'WHY (' || cause_label || '): ' || fm || CHR(10) || 'HOW: ' || fh AS text, CAST(LENGTH(fm) AS INT) AS mechanism_length, CAST(LENGTH(fh) AS INT) AS fix_hint_length,
 LENGTH(m) > m_cap AS mechanism_cut, LENGTH(h) > h_cap AS fix_hint_cut, 1 AS placeholder_path, 0 AS placeholder_routine, 1 + CASE WHEN step % 3 = 0 THEN 2 ELSE 0 END AS placeholder_tool FROM y""")
def _(t):
    rows = t.sql(MARKED)
    done = ren.render_diagnoses(rows, MARKS, ren.caps_of(rows.where(c("attribution") == "rule"), MARKS))
    return done.select("failure_key", "text", *[f"{f}_{x}" for x in ("length", "cut") for f in ren.TEXT_FIELDS],
                       *[f"placeholder_{k}" for k in sorted(set(MARKS.values()))])


ARM_TEXTS = """SELECT source AS cluster_id, CAST(doc_id AS STRING) AS arm, text AS mechanism, 'fix the  ' || lang || ' zzthing' AS fix_hint, lang FROM documents"""


@query("rendered_lengths", f"""
WITH s AS (SELECT cluster_id, arm, lang, TRIM(REGEXP_REPLACE(mechanism, '\\s+', ' ', 'g')) AS m, REPLACE(TRIM(REGEXP_REPLACE(fix_hint, '\\s+', ' ', 'g')), 'zzthing', '[routine]') AS h FROM ({ARM_TEXTS})),
k AS (SELECT cluster_id, GREATEST(20, MAX(LENGTH(m))) AS m_cap, GREATEST(20, MAX(LENGTH(h))) AS h_cap FROM s WHERE lang = 'en' GROUP BY cluster_id)
SELECT cluster_id, arm, CAST(LENGTH({FITTED.format(f='m', cap='m_cap')}) AS INT) AS mechanism_length, CAST(LENGTH({FITTED.format(f='h', cap='h_cap')}) AS INT) AS fix_hint_length,
 LENGTH(m) > m_cap AS mechanism_cut, LENGTH(h) > h_cap AS fix_hint_cut FROM s JOIN k USING (cluster_id)""")
def _(t):
    arms, tokens = t.sql(ARM_TEXTS), {"zzthing": "routine"}
    return ren.rendered_lengths(arms, tokens, ren.caps_of(arms.where(c("lang") == "en"), tokens))


CAUSES = """SELECT doc_id, CASE n_chars % 4 WHEN 0 THEN 'argument_error' WHEN 1 THEN ' Wrong_Target ' WHEN 2 THEN 'other: Odd Thing ' || lang ELSE 'context_loss' END AS cause_label FROM documents"""


@query("normalise_cause", f"""
SELECT doc_id, CASE WHEN cause_label LIKE 'other:%' THEN 'other:' || LOWER(TRIM(SUBSTR(cause_label, 7))) ELSE LOWER(TRIM(cause_label)) END AS cause_label FROM ({CAUSES})""")
def _(t):
    return ren.normalise_cause(t.sql(CAUSES))


# ------------------------------------------------------------------ spans

LOCATED = """loc AS (SELECT l.file, l.line, COALESCE(a.c, b.c, o.c) AS components, a.c IS NOT NULL OR b.c IS NOT NULL AS exact,
 CASE WHEN a.c IS NOT NULL THEN 'span' WHEN b.c IS NOT NULL THEN 'file' ELSE 'list' END AS tier FROM wanted l
LEFT JOIN (SELECT file, line, MIN_BY(c, width) AS c FROM (SELECT w.file, w.line, end_line - start_line AS width, STRING_AGG(DISTINCT component, ',' ORDER BY component) AS c
  FROM wanted w JOIN spans s ON w.file = s.file AND s.kind <> 'file' AND w.line BETWEEN s.start_line AND s.end_line GROUP BY w.file, w.line, end_line - start_line) GROUP BY file, line) a ON l.file = a.file AND l.line = a.line
LEFT JOIN (SELECT file, STRING_AGG(DISTINCT component, ',' ORDER BY component) AS c FROM spans WHERE kind = 'file' GROUP BY file) b ON l.file = b.file
LEFT JOIN (SELECT file, STRING_AGG(DISTINCT component, ',' ORDER BY component) AS c FROM file_owners GROUP BY file) o ON l.file = o.file
WHERE COALESCE(a.c, b.c, o.c) IS NOT NULL)"""
FAR_LINES = "SELECT DISTINCT file, line FROM (SELECT file, line FROM lines UNION ALL SELECT file, line + 40 FROM lines UNION ALL SELECT 'Brand#' || CAST(line AS STRING), line FROM lines) q"


@query("locate_lines", f"WITH wanted AS ({FAR_LINES}), {LOCATED} SELECT * FROM loc")
def _(t):
    out = spn.locate_lines(t.sql(FAR_LINES), t.view("spans"), t.view("file_owners"))
    return out.withColumn("components", F.concat_ws(",", "components"))


HUNKS = """SELECT p_partkey AS hunk_id, CASE WHEN p_partkey % 9 = 0 THEN 'Brand#' || CAST(26 + p_partkey % 30 AS STRING) ELSE p_brand END AS file,
 CASE p_partkey % 7 WHEN 0 THEN 'created' ELSE 'modified' END AS status, p_size AS old_start, CAST(p_partkey % 5 AS INT) AS old_lines FROM part"""


@query("hunks_to_components", f"""
WITH h AS ({HUNKS}), x AS (SELECT hunk_id, file, UNNEST(RANGE(old_start, old_start + GREATEST(old_lines, 1))) AS line FROM h WHERE status <> 'created'),
wanted AS (SELECT DISTINCT file, line FROM x), {LOCATED},
m AS (SELECT x.hunk_id, UNNEST(COALESCE(STRING_SPLIT(loc.components, ','), [NULL])) AS component, COALESCE(loc.exact, FALSE) AS exact FROM x LEFT JOIN loc ON x.file = loc.file AND x.line = loc.line
 UNION ALL SELECT h.hunk_id, o.component, FALSE FROM h LEFT JOIN file_owners o ON h.file = o.file WHERE h.status = 'created')
SELECT hunk_id, COALESCE(STRING_AGG(DISTINCT component, ',' ORDER BY component), '') AS components, BOOL_AND(exact) AND COUNT(component) > 0 AS exact FROM m GROUP BY hunk_id""")
def _(t):
    out = spn.hunks_to_components(t.sql(HUNKS), t.view("spans"), t.view("file_owners"))
    return out.withColumn("components", F.concat_ws(",", "components"))
