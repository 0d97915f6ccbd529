"""Trajectories, alignment and attribution against hand values."""

import random
import re
import time

import pytest
from pyspark.sql import functions as F

from runlens.functions import shell
from runlens.functions import text as tx
from runlens.operators import alignment as aln
from runlens.operators import attribution as att
from runlens.operators import render as ren
from runlens.operators import trajectory as trj
from tests.shapes import FIND, READ, entries, finish, frame, move, send, sh

c = F.col
DONE = finish("moved and sent")
SORT, PLAN = sh("sort -k2 prices.tsv | uniq"), sh("python3 plan.py --week 3")
# name -> (failed steps, reference steps, exit reason, candidates in order, t_exact, t_class)
CASES = {
    # nothing differs; a read-only command or an answer may read differently without being another action
    "agree": ([[SORT], [FIND], [READ], [move("e7", "mon")], [send("m4", "hi")], [DONE]],
              [[SORT], [FIND], [READ], [move("e7", "mon")], [send("m4", "hi")], [DONE]], "finished", [], None, None),
    "same_class": ([[SORT], [FIND], [finish("Moved AND sent")]], [[sh("wc -l prices.tsv")], [FIND], [finish("sent, then moved")]], "finished", [], 1, None),
    "same_answer": ([[FIND], [finish(" Moved  and\nsent ")]], [[FIND], [DONE]], "finished", [], None, None),
    # arguments: other days of the same event, twice; another order of calls; another text of a number
    "two_variants": ([[FIND], [move("e7", "mon")], [move("e9", "mon")], [DONE]], [[FIND], [move("e7", "tue")], [move("e9", "wed")], [DONE]], "finished",
                     [(2, "argument_variant"), (3, "argument_variant")], 2, None),
    "order_of_calls": ([[FIND, move("e7", "mon")], [DONE]], [[move("e7", "mon"), FIND], [DONE]], "finished", [(1, "argument_variant")], 1, None),
    "number_text": ([[move("e7", 1)], [DONE]], [[move("e7", 1.0)], [DONE]], "finished", [(1, "argument_variant")], 1, None),
    # class divergences come first, whatever their step
    "variant_last": ([[move("e7", "mon")], [send("m4", "hi")], [DONE]], [[move("e7", "tue")], [READ], [DONE]], "finished",
                     [(2, "extra_mutation"), (1, "argument_variant")], 1, 2),
    "three_kinds": ([[SORT], [READ], [move("e9", "mon")], [PLAN], [move("e7", "mon")], [DONE]],
                    [[SORT], [send("m4", "hi")], [move("e7", "mon")], [sh("python3 plan.py --week 4")], [move("e7", "fri")], [DONE]], "finished",
                    [(2, "missing_mutation"), (3, "different_action"), (4, "different_action"), (5, "argument_variant")], 2, 2),
    # the first step
    "other_start": ([[READ], [sh("touch stamp")], [DONE]], [[FIND], [sh("touch mark")], [DONE]], "finished",
                    [(1, "early"), (2, "different_action")], 1, 1),
    "script_first": ([[PLAN], [READ], [DONE]], [[move("e7", "mon")], [READ], [DONE]], "finished", [(1, "early")], 1, 1),
    "changed_first": ([[sh("mv draft.txt sent.txt")], [DONE]], [[FIND], [DONE]], "finished", [(1, "extra_mutation")], 1, 1),
    # ends
    "stopped": ([[FIND], [move("e7", "mon")], [DONE]], [[FIND], [move("e7", "mon")], [send("m4", "hi")], [READ], [DONE]], "finished",
                [(3, "premature_finish")], 3, 3),
    "said": ([[FIND], [send("m4", "hi")], "It is sent."], [[FIND], [send("m4", "hi")], [DONE]], "assistant_no_tool_call", [(3, "no_tool_call")], 3, 3),
    "went_on": ([[FIND], [FIND], [send("m4", "hi")], [DONE]], [[FIND], [DONE]], "finished", [(2, "late_finish")], 2, 2),
    "outlived": ([[FIND], [READ], [move("e1", "sat")], [READ]], [[FIND], [READ]], "max_steps", [(3, "late_finish")], 3, 3),
    "ran_out": ([[FIND], [send("m1", "x")], [FIND]], [[FIND], [READ], [FIND], [send("m4", "hi")], [DONE]], "rollout_wall_clock_timeout",
                [(2, "extra_mutation"), (4, "budget")], 2, 2),
    "broke": ([[FIND], [READ]], [[FIND], [READ], [move("e7", "mon")], [DONE]], "model_call_error", [(3, "error")], 3, 3),
    "left_quietly": ([[FIND], [READ]], [[FIND], [READ], [DONE]], "finished", [], 3, None),
}


def pair_actions(spark, cases):
    frames = frame(spark, *[entries(f"{name}|{side}", case[i]) for name, case in cases.items() for i, side in enumerate(("failed", "reference"))])
    return trj.actions(frames).withColumn("pair_id", F.substring_index("rollout_id", "|", 1)).withColumn(
        "side", F.substring_index("rollout_id", "|", -1))


def exits(rows, cases):
    return rows("pair_id string, exit_reason string", [(n, k[2]) for n, k in cases.items()])


def test_alignment_cases(spark, rows):
    acts = pair_actions(spark, CASES).cache()
    found = {}
    for r in aln.align_pairs(acts, exits(rows, CASES)).orderBy("pair_id", "ordinal").collect():
        found.setdefault(r.pair_id, []).append((r.step, r.divergence))
    summary = {r.pair_id: r for r in aln.alignment_summary(acts, exits(rows, CASES)).collect()}
    for name, (failed, reference, _, expected, t_exact, t_class) in CASES.items():
        assert found.get(name, []) == expected, name
        assert (summary[name].t_exact, summary[name].t_class) == (t_exact, t_class), name
        assert (summary[name].failed_steps, summary[name].reference_steps) == (len(failed), len(reference)), name


def test_actions_identity_and_classes(spark):
    steps = [[move("e7", "mon"), FIND], [("clock", None)], "closing  Words", [sh("cp a.tsv  b.tsv ; ")]]
    out = trj.actions(frame(spark, entries("r", steps))).orderBy("step", "idx").collect()
    assert [r.klass for r in out] == ["tool", "tool", "tool", "final", "shell_mut"]
    assert (out[0].identity, out[0].exact) == ('calendar_move_event:{"event_id": "e7"}', 'calendar_move_event:{"day": "mon", "event_id": "e7"}')
    assert (out[1].identity, out[1].exact) == ("calendar_find_event:{}", 'calendar_find_event:{"limit": 3, "query": "review"}')
    assert (out[2].identity, out[2].exact) == ("clock:{}", 'clock:{"value": null}')
    assert out[3].exact == "final:closing words" and (out[4].identity, out[4].exact) == ("shell_mut:b.tsv", "shell:cp a.tsv b.tsv")


def test_arguments_that_are_no_object_are_kept(spark):
    texts = {"clock": "half past", "list_one": "[1, 2.0]", "show": None, "get_x": '{"id": 1, "id": "two", "z": {"b": 1e1, "a": []}}', "finish": '{"answer": 42}'}
    (row, *_), out = entries("r", [[FIND]]), {}
    calls = [(f"c{i}", name, text) for i, (name, text) in enumerate(texts.items())]
    for r in trj.actions(frame(spark, [(*row[:4], (row[4][0], None, calls), *row[5:])])).collect():
        out[r.name] = (r.identity, r.exact)
    assert out == {"clock": ("clock:{}", 'clock:{"raw": "half past"}'), "list_one": ("list_one:{}", 'list_one:{"value": [1, 2.0]}'),
                   "show": ("show:{}", 'show:{"value": null}'), "finish": ("finish", "finish:42"),
                   "get_x": ('get_x:{"id": "two"}', 'get_x:{"id": "two", "z": {"a": [], "b": 10.0}}')}


@pytest.mark.parametrize(("command", "klass"), [
    ("head -5 notes.md | sort", "shell_ro"), ("date >> logs/run.log", "shell_mut"), ("wc -l data.csv 2>&1", "shell_ro"),
    ("sed -i -e 's/x/y/g' conf.ini", "shell_mut"), ("python3 tools/check.py --report", "shell_opaque"),
    ("bash deploy.sh prod", "shell_opaque"), ("./bin/start.sh", "shell_opaque"),
    ("cut -f1 table.tsv | python3 -c 'print(1)'", "shell_opaque"),
    ("python3 gen.py > table.tsv", "shell_mut"), ("find . -name notes.md && grep -c x notes.md", "shell_ro"), ("touchpad list", "shell_ro"),
])
def test_shell_classes(rows, command, klass):
    assert rows("c string", [(command,)]).select(tx.classify_shell(c("c"))).first()[0] == klass


@pytest.mark.parametrize(("command", "targets"), [
    ("mv 'my notes.md' archive/notes.md", "archive/notes.md"),
    ("ln -s base.cfg link.cfg ;", "base.cfg"),
    ("cp one two &&", "two"),
    ("date >> logs/run.log; wc -l logs/run.log", "logs/run.log"),
    ("rm -rf build dist || true", "build,dist"),
    ('touch "a b.txt" c\\ d.txt', "a b.txt,c d.txt"),
    ('tee "say \\"hi\\".txt" | cat', 'say "hi".txt'),
    ("mkdir -p x 'y", "'y,x"),
    ("chmod +x run.sh | tee log.txt", "+x,log.txt,run.sh"),
    ("cp lonely", ""),
    ("", ""),
])
def test_write_targets(rows, command, targets):
    assert rows("c string", [(command,)]).select(shell.write_targets(c("c"))).first()[0] == targets


def test_normal_form_of_a_command(rows):
    assert rows("c string", [("  git\t status  && true",)]).select(tx.normalise_command(c("c"))).first()[0] == "git status"


def observations(frames):
    return frames.where(c("role") == "tool").select(
        F.substring_index("rollout_id", "|", 1).alias("pair_id"), "step", "ord", c("tool_call.name").alias("name"),
        c("tool_output.content").alias("text"), c("tool_output.timeout").alias("timed_out"), c("tool_output.exit_code").alias("exit_code"),
        F.concat(F.coalesce("tool_output.stdout", F.lit("")), F.coalesce("tool_output.stderr", F.lit(""))).contains("[truncated").alias("truncated"))


OTHER_FILE = ([[SORT], [sh("mv draft.txt sent.txt")], [DONE]], [[SORT], [sh("mv draft.txt final.txt")], [DONE]], "finished")
# name -> (failed, reference, exit reason, outputs of the failed run, rules of its candidates in order)
RULES = {
    "only looked, then wrote elsewhere": ([[FIND], [READ], [sh("mv draft.txt sent.txt")], [DONE]],
                                          [[FIND], [send("m4", "hi")], [sh("mv draft.txt final.txt")], [DONE]], "finished", {}, ["R9", "R1"]),
    "wrote elsewhere": (*OTHER_FILE, {}, ["R1"]),
    "after a failed command": (*OTHER_FILE, {1: {"stdout": "", "stderr": "no such file", "exit_code": 3}}, ["R1a"]),
    "after a cut output": (*OTHER_FILE, {1: {"stdout": "a\tb\n[truncated 9000 bytes]", "stderr": "", "exit_code": 0}}, ["R1b"]),
    "timeout": (*OTHER_FILE, {2: {"stdout": "", "stderr": "", "timeout": True}}, ["R7"]),
    "never used the other tool": ([[FIND], [move("e9", "mon")], [DONE]], [[FIND], [send("m4", "hi")], [DONE]], "finished", {}, ["R2a"]),
    "other event": ([[FIND], [move("e9", "mon")], [move("e7", "mon")], [DONE]], [[FIND], [move("e7", "mon")], [move("e7", "mon"), FIND], [DONE]],
                    "finished", {}, ["R2", "R2"]),
    "a tool that is not there": ([[FIND], [("calendar_shift", {"event_id": "e7"})], [DONE]], [[FIND], [READ], [DONE]], "finished",
                                 {2: {"content": "error: Unknown Tool calendar_shift"}}, ["R8"]),
    "stopped": ([[FIND], [DONE]], [[FIND], [send("m4", "hi")], [DONE]], "finished", {}, ["R3"]),
    "stopped with a number from nowhere": ([[FIND], [finish("the sum is 20,715")]], [[FIND], [send("m4", "hi")], [DONE]], "finished",
                                           {1: {"content": "20 and 715"}}, ["R3a"]),
    "stopped with a number it had seen": ([[FIND], [finish("the sum is 20,715")]], [[FIND], [send("m4", "hi")], [DONE]], "finished",
                                          {1: {"content": "total=20,715.50"}}, ["R3"]),
    "said": ([[FIND], "It is sent."], [[FIND], [send("m4", "hi")], [DONE]], "assistant_no_tool_call", {}, ["R4"]),
    "broke": ([[FIND]], [[FIND], [send("m4", "hi")], [DONE]], "model_call_error", {}, ["R5"]),
    "ran out, after a detour": ([[FIND], [READ]], [[FIND], [send("m4", "hi")], [READ], [DONE]], "max_steps", {}, ["R9", "R6"]),
    "other start, then another week": ([[READ], [PLAN], [DONE]], [[FIND], [sh("python3 plan.py --week 4")], [DONE]], "finished", {}, ["R10", "R1"]),
}


def test_attribution_rules(spark, rows):
    failed = frame(spark, *[entries(f"{n}|failed", k[0], k[3]) for n, k in RULES.items()])
    reference = frame(spark, *[entries(f"{n}|reference", k[1]) for n, k in RULES.items()])
    acts = trj.actions(failed.unionByName(reference)).withColumn("pair_id", F.substring_index("rollout_id", "|", 1)).withColumn(
        "side", F.substring_index("rollout_id", "|", -1)).cache()
    answers = acts.where((c("side") == "failed") & (c("klass") == "finish")).select("pair_id", "step", "answer")
    found = aln.align_pairs(acts, exits(rows, RULES))
    out = att.attribute(found, acts, observations(failed), answers, att.rule_table(spark))
    rules, parts = {}, {}
    for r in out.orderBy("pair_id", "ordinal").collect():
        rules.setdefault(r.pair_id, []).append(r.rule)
        parts[r.rule] = r.candidate_components
    assert rules == {n: k[4] for n, k in RULES.items()}
    assert parts["R1b"] == ["observation_shaping"]
    assert set(parts["R1"]) == {"system_prompt", "task_prompt", "context_window", "planner"}


def test_active_steps_fall_back_without_failed_results(spark):
    ok = entries("ok", [[FIND], [SORT], "done"])
    bad = entries("bad", [[READ], [SORT]], {2: {"stdout": "", "stderr": "", "exit_code": 1}})
    out = {}
    for r in trj.active_steps(frame(spark, ok, bad), att.component_table(spark)).collect():
        out.setdefault((r.rollout_id, r.component), set()).add(r.step)
    assert out[("ok", "tool_shell")] == {2} and out[("ok", "tool_router")] == {1, 2}
    assert out[("ok", "completion_policy")] == {3} and out[("ok", "error_handling")] == {1, 2, 3}
    assert out[("bad", "error_handling")] == {2} and out[("ok", "planner")] == {1, 2, 3}


def test_unknown_role_is_an_error(spark):
    rows = entries("r", [[FIND]])
    bad = frame(spark, [(*rows[0][:3], "narrator", *rows[0][4:])])
    meta = spark.createDataFrame([("r", "finished", "", 1, 1.0)], "rollout_id string, exit_reason string, final_answer string, steps long, duration_seconds double").withColumn(
        "token_usage", F.struct(F.lit(1).alias("prompt_tokens")))
    with pytest.raises(Exception, match="unknown trajectory role"):
        trj.trajectory_events(bad, meta).collect()


def condense_reference(blocks, budget, keep=()):
    """Drop blocks one by one from the middle outwards until the text fits."""
    if sum(len(b) for _, b in blocks) + len(blocks) - 1 <= budget:
        return "\n".join(b for _, b in blocks)
    n = len(blocks)
    safe = {i for i in range(n) if i < 2 or i >= n - 2} | {i for i, (s, _) in enumerate(blocks) for k in keep if abs(s - k) <= 1}
    alive = set(range(n))
    for i in sorted((i for i in range(n) if i not in safe), key=lambda i: (abs(i - n / 2), i)):
        if sum(len(blocks[j][1]) for j in alive) + len(alive) - 1 <= budget:
            break
        alive.discard(i)
    out, last = [], -1
    for i in sorted(alive):
        if i - last > 1:
            out.append(f"  … {i - last - 1} step(s) omitted …")
        out.append(blocks[i][1])
        last = i
    return "\n".join(out)


@pytest.mark.parametrize("budget", [40, 200, 900, 5000])
def test_condense_matches_one_by_one_dropping(spark, rows, budget):
    blocks = {f"r{n}": [(s, f"step {s}: " + "x" * ((s * 7 + n) % 23)) for s in range(1, n + 1)] for n in (1, 2, 3, 5, 40, 900)}
    frame_ = rows("rollout_id string, step long, text string", [(r, s, t) for r, b in blocks.items() for s, t in b])
    keep = rows("rollout_id string, step long", [("r40", 9), ("r900", 300)])
    out = {r.rollout_id: r.text for r in ren.condense_steps(frame_, budget, keep).collect()}
    kept = {"r40": (9,), "r900": (300,)}
    for name, b in blocks.items():
        assert out[name] == condense_reference(b, budget, kept.get(name, ())), name


def test_strip_and_fit(rows):
    tokens = ren.identifier_tokens(
        files=["agent/loop.py"], symbols=["agent/actions.py:ToolRouter.execute@timeout", "harness.json:max_steps"],
        tools=["todo_list_tasks"], layers=["context"], components=["loop"])
    assert tokens["ToolRouter"] == "routine" and tokens["max_steps"] == "setting" and tokens["loop"] == "component"
    df = rows("t string", [("In agent/loop.py the `ToolRouter` of loop skips todo_list_tasks, not reloop or loopé.",)])
    out = ren.strip_identifiers(df, "t", tokens).first()
    assert out.t == "In [path] the [routine] of [component] skips [tool], not reloop or loopé."
    assert (out.t_path, out.t_routine, out.t_component, out.t_tool, out.t_setting) == (1, 1, 1, 1, 0)
    fit = lambda text, cap: rows("t string", [(text,)]).select(ren.fit_text(c("t"), F.lit(cap))).first()[0]
    assert fit("  short   text ", 20) == "short text"
    assert fit("a longer text, that must be cut", 15) == "a longer text."
    assert fit("unbreakable" * 3, 12) == "unbreakableu."


def test_quoted_later_and_prior_value(rows):
    obs = rows("rollout_id string, step int, text string", [("r", 1, "short\n  the total is 4711 units  "), ("r", 2, "nothing to quote here")])
    said = rows("rollout_id string, step int, text string", [("r", 1, "the total is 4711 units"), ("r", 3, "so the total is 4711 units now"), ("r", 5, "nothing to quote here")])
    cut = rows("rollout_id string, cutoff int", [("r", 4)])
    out = {r.step: r.quoted for r in trj.quoted_later(obs, said, cut).collect()}
    assert out == {1: True, 2: False}


def test_quotes_across_tabs_and_line_ends(rows):
    obs = rows("rollout_id string, step int, text string", [("r", 1, "head\u2028\tindented line of text\u00a0\x0bother"), ("r", 2, "short one")])
    said = rows("rollout_id string, step int, text string", [("r", 2, "x indented line of text y"), ("r", 3, "short one")])
    cut = rows("rollout_id string, cutoff int", [("r", 9)])
    assert {r.step: r.quoted for r in trj.quoted_later(obs, said, cut).collect()} == {1: True, 2: False}


def test_strip_and_lines_follow_unicode(rows):
    text = "\t\u00a0\u2003a b\x1f\x85"
    assert rows("c string", [(text,)]).select(tx.strip(c("c"))).first()[0] == text.strip() == "a b"
    many = "a\r\nb\rc\nd\x0be\x0cf\x1cg\x1dh\x1ei\x85j\u2028k\u2029l"
    assert rows("c string", [(many,)]).select(tx.lines(c("c"))).first()[0] == many.splitlines()


def sequential(text, tokens):
    """Token after token, longest first."""
    counts = dict.fromkeys(tokens.values(), 0)
    for token, klass in sorted(tokens.items(), key=lambda kv: -len(kv[0])):
        edge = r"[\w/]" if "/" in token or "." in token else r"\w"
        text, n = re.subn(rf"(?<!{edge}){re.escape(token)}(?!{edge})", f"[{klass}]", text)
        counts[klass] += n
    return re.sub(r"`\[(\w+)\]`", r"[\1]", text), counts


def test_strip_equals_token_after_token(spark):
    """Tokens inside tokens, beside each other, across each other and inside placeholders."""
    rng = random.Random(3)
    tokens = {"a.b": "path", "b.c.d": "path", "a": "tool", "tool": "component", "path": "layer", "a/b": "path", "foo": "routine",
              "foo.bar": "setting", "é": "tool", "x-y": "tool", "x": "layer", "component": "tool", "$1(": "path", "[q": "layer"}
    bits = [*"abcdéxy./`-_[] ", "foo", "bar", "tool", "path", "component", "$1(", "q"]
    texts = ["".join(rng.choice(bits) for _ in range(rng.randrange(25))) for _ in range(600)]
    df = spark.createDataFrame([*enumerate(texts), (-1, None)], "i int, t string")
    for r in ren.strip_identifiers(df, "t", tokens).collect():
        text, counts = sequential(texts[r.i], tokens) if r.i >= 0 else (None, dict.fromkeys(tokens.values(), 0))
        assert (r.t, {k: r[f"t_{k}"] for k in counts}) == (text, counts)


def test_a_large_vocabulary_is_one_projection(spark):
    tokens = {f"pkg{i}/mod{i}.py": "path" for i in range(150)} | {f"Part{i}Of": "routine" for i in range(150)}
    df = spark.createDataFrame([("see pkg7/mod7.py and Part149Of, not Part14Of1",)], "t string")
    started = time.perf_counter()
    out = ren.strip_identifiers(df, "t", tokens)
    plan = out._jdf.queryExecution().optimizedPlan().toString()
    assert time.perf_counter() - started < 3
    assert plan.count("Project") <= 2
    assert tuple(out.first()) == ("see [path] and [routine], not Part14Of1", 1, 1)


def test_extra_names_give_way_to_the_manifest():
    tokens = ren.identifier_tokens(files=["harness.json"], components=["injected_tools"], extra=["harness.json", "injected_tools", "Runner"])
    assert (tokens["harness.json"], tokens["injected_tools"], tokens["Runner"]) == ("path", "component", "routine")


def test_rendering_strips_caps_and_counts(rows):
    ddl = "cluster_id string, id int, component string, step int, severity string, cause_label string, mechanism string, fix_hint string"
    df = rows(ddl, [("c", 1, "planner", None, "high", "lost", "the Router of agent/run.py never   asks again", "call Router, then stop"),
                    ("c", 2, "planner", 4, "low", "lost", "short Router", None)])
    tokens = {"Router": "routine", "agent/run.py": "path"}
    out = {r.id: r for r in ren.render_diagnoses(df, tokens).collect()}
    assert out[1].text == ("DIAGNOSIS\nWHERE: component `planner`, step unknown\nSEVERITY: high\n"
                           "WHY (lost): the [routine] of [path] never asks again\nHOW: call [routine], then stop")
    assert (out[1].mechanism_length, out[1].mechanism_cut, out[1].placeholder_path, out[1].placeholder_routine) == (40, False, 1, 2)
    assert out[2].text.endswith("step 4\nSEVERITY: low\nWHY (lost): short [routine]\nHOW: ") and out[2].fix_hint_length == 0
    caps = rows("cluster_id string, mechanism_cap int, fix_hint_cap int", [("c", 22, 20)])
    out = {r.id: r for r in ren.render_diagnoses(df, tokens, caps).collect()}
    assert "WHY (lost): the [routine] of.\nHOW: call [routine]." in out[1].text
    assert (out[1].mechanism_cut, out[1].fix_hint_cut, out[2].mechanism_cut) == (True, True, False)
    assert (out[1].mechanism_length, out[1].fix_hint_length) == (17, 15)
    uncapped = ren.render_diagnoses(df, tokens, caps.where("cluster_id = 'other'")).collect()
    assert not any(r.mechanism_cut or r.fix_hint_cut for r in uncapped)


def test_numbers_of_the_first_answer(rows):
    answers = rows("pair_id string, step int, idx int, answer string, n int", [
        ("whole", 3, 0, "about 4,711.5 units", 1), ("inside", 3, 0, "12", 1), ("none", 3, 0, "no number", 1), ("null", 3, 0, None, 1),
        ("first", 4, 0, "99", 1), ("first", 3, 1, "88", 1), ("first", 3, 0, "77", 1), ("dot", 3, 0, "7.", 1), ("arabic", 3, 0, "\u0664\u0662", 1),
        ("alone", 3, 0, "5", 1), ("either", 3, 0, "1 and 2", 1)])
    seen = rows("pair_id string, text string", [
        ("whole", "x4,711.50y"), ("inside", "31.25 then 3124"), ("none", "1"), ("first", "99 and 88"), ("first", None), ("dot", "7 7, .7"),
        ("arabic", "=\u0664\u0662="), ("either", "..., 3"), ("either", "v2"), ("other", "5")])
    out = {r.pair_id: r.unsupported for r in att.unsupported_answer(answers, seen).collect()}
    assert out == {"whole": False, "inside": False, "none": False, "null": False, "first": True, "dot": True, "arabic": False,
                   "alone": True, "either": False}


RESULT = "struct<content:string,stdout:string,stderr:string>"
SHAPES = [  # result -> text to compare, text to quote
    (("c", "out", None), "out\n--stderr--\n", "out"),
    (("c", "", "err"), "\n--stderr--\nerr", "err"),
    (("c", "out", "err"), "out\n--stderr--\nerr", "out\nerr"),
    ((None, "", ""), "\n--stderr--\n", ""),
    (("plain", None, None), "plain", "plain"),
    (('{"stdout": "a\\nb", "exit": 0}', None, None), "a\nb\n--stderr--\n", "a\nb"),
    (('{"stderr": null, "x": "y"}', None, None), "\n--stderr--\nNone", "y"),
    (('{"result": "r", "n": 1, "b": "s"}', None, None), '{"result": "r", "n": 1, "b": "s"}', "s\nr"),
    (('["stdout"]', None, None), '["stdout"]', '["stdout"]'),
    (('{"result": "r"}', "", ""), "\n--stderr--\n", "r"),
    ((None, None, None), "", ""),
]


def test_text_of_a_result(rows):
    df = rows(f"i int, o {RESULT}", [(i, o) for i, (o, _, _) in enumerate(SHAPES)])
    got = {r.i: (r.a, r.b) for r in trj.with_output_text(trj.with_output_text(df, "o", "a"), "o", "b", quotable=True).collect()}
    assert got == {i: (a, b) for i, (_, a, b) in enumerate(SHAPES)}


def test_workspaces_and_volatile_parts_are_masked(rows):
    ddl = f"i int, name string, recorded_exit int, fresh_exit int, mutated boolean, quoted boolean, recorded {RESULT}, fresh {RESULT}, workspaces array<string>"
    shell, ok = "run_shell_command", (0, 0, False, False)
    df = rows(ddl, [
        (1, shell, *ok, (None, "in /w(1)/a at 10:11:12", None), ('{"stdout": "in /new/a  at 01:02:03"}', None, None), ["/w(1)", "/new", None]),
        (2, shell, *ok, (None, "in /w(1)/a", None), (None, "in /new/b", None), ["/w(1)", "/new", ""]),
        (3, shell, 0, 1, False, False, (None, "x", None), (None, "x", None), None),
        (4, "tool", 0, 1, True, False, ("x", None, None), ("y", None, None), []),
    ])
    assert {r.i: r.outcome for r in trj.mask_and_compare(df.fillna({})).collect() if r.i != 3} == {
        1: "equal", 2: "warning", 4: "mutating_or_quoted_output_differs"}
    assert trj.mask_and_compare(df.drop("workspaces")).where("i = 3").first().outcome == "exit_code_differs"


def test_observations_and_spoken_texts_of_entries(spark):
    df = frame(spark, entries("r", [[sh("ls -la notes")], "the words of the reply"], {1: {"content": '{"out": "a line that is long", "n": 2}'}}))
    assert [(r.step, r.text) for r in trj.observations(df).collect()] == [(1, "a line that is long")]
    assert sorted((r.step, r.text) for r in trj.spoken_texts(df).collect()) == [(1, '{"command": "ls -la notes"}'), (2, "the words of the reply")]
