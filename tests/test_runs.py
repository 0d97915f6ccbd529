"""Metrics, ledger, pricing, sampling, sources and exact helpers against hand values."""

import hashlib
import json
import random
import statistics

import pytest
from pyspark.sql import functions as F

from runlens import schemas
from runlens.functions import numbers, scale
from runlens.functions import text as tx
from runlens.operators import dispatches as dsp
from runlens.operators import ledger as led
from runlens.operators import metrics as met
from runlens.operators import outcomes as out_
from runlens.operators import pricing as pri
from runlens.operators import tasks as tsk
from runlens.sources import jsonl, logs
from runlens.sources import runs as src

c = F.col
ROLL = "source string, run_id string, task_id string, replicate string, attempt int, passed boolean, value double, error_family string, task_failure string"


def rollouts(rows, *items):
    return rows(ROLL, [("claw_eval", "p1", "t", rep, att, ok, v, fam, None) for rep, att, ok, v, fam in items])


@pytest.mark.parametrize(("items", "k", "hat", "any_", "extra"), [
    ([("r1", 1, True, 1.0, "none"), ("r2", 1, True, 1.0, "none"), ("r3", 1, True, 1.0, "none")], 3, True, True, {"benchmark_valid": True}),
    ([("r1", 1, True, 1.0, "none"), ("r2", 1, False, 0.2, "none"), ("r3", 1, True, 1.0, "none")], 3, False, True, {"mean_value": pytest.approx(2.2 / 3)}),
    ([("r1", 1, True, 1.0, "none"), ("r2", 1, None, None, "infra")], 2, False, True, {"infra": 1, "scored": 1, "benchmark_valid": False}),
    ([("r1", 1, True, 1.0, "none")], 2, False, True, {}),
    ([("r1", 1, False, 0.0, "none"), ("r1", 2, True, 1.0, "none"), ("r2", 1, True, 1.0, "none")], 2, True, True, {"replicates": 2}),
])
def test_pass_hat_k(rows, items, k, hat, any_, extra):
    r = met.task_results(rollouts(rows, *items), k).first()
    assert (r.pass_hat_k, r.pass_at_k) == (hat, any_)
    for name, value in extra.items():
        assert r[name] == value, name


def test_ledger_families_stay_apart(rows):
    ddl = "run_id string, event string, arm string, cached boolean, prompt_tokens long, completion_tokens long, usd decimal(18,6), error_kind string, rollout_uid string"
    from decimal import Decimal as D

    df = rows(ddl, [
        ("r", "call", "judge", True, 10, 2, D("0.5"), None, None), ("r", "call", "judge", False, 5, 1, D("0.25"), None, "u1"),
        ("r", "policy", "base", False, 100, 20, D("3"), None, "u1"), ("r", "search", "base", False, 0, 0, D("0.001"), None, "u2"),
        ("r", "task_failure", "base", False, 0, 0, D("0"), "budget_exhausted", None), ("r", "task_failure", "base", False, 0, 0, D("0"), None, None),
        ("r", "infra_retry", "base", False, 0, 0, D("0"), None, None)])
    s = led.ledger_summary(df).first()
    assert (s.calls, s.cached_calls, s.usd, s.policy_usd, s.search_usd) == (2, 1, 0.75, 3.0, 0.001)
    assert (s.task_failures, s.budget_exhausted, s.infra_retries, s.infra_failures) == (1, 1, 1, 0)
    done = rows("rollout_uid string", [("u1",)])
    assert led.ledger_summary_resumed(df, done).first().search_calls == 0
    assert led.budget_state(df, 3.751, ["run_id"]).first().reached


@pytest.mark.parametrize(("ts", "tier"), [
    ("2026-09-02 02:00:00", "peak"), ("2026-09-02 01:00:00", "peak"), ("2026-09-02 04:00:00", "off_peak"),
    ("2026-09-02 07:30:00", "peak"), ("2026-09-02 12:00:00", "off_peak"), ("2026-09-05 02:00:00", "off_peak"),
    ("2026-09-02 03:59:59.999999", "peak"),
])
def test_tier_edges(spark, ts, tier):
    assert spark.sql(f"SELECT TIMESTAMP '{ts}' AS ts").select(pri.pricing_tier(c("ts"))).first()[0] == tier


def test_cost_splits_cache_hits_and_rejects_unknown_models(spark, rows):
    rates = pri.model_rates(spark, [("fake", "off_peak", 1.0, 2.0, 4.0), ("fake", "peak", 2.0, 4.0, 8.0)])
    use = lambda model: rows("model string, prompt_tokens long, completion_tokens long, cache_hit_prompt_tokens long", [(model, 1_000_000, 500_000, 250_000)]).withColumn(
        "ts", F.expr("TIMESTAMP '2026-09-02 12:00:00'"))
    r = pri.price_usage(use("fake"), rates).first()
    assert r.tier == "off_peak" and r.usd == pytest.approx(0.25 + 1.5 + 2.0)
    with pytest.raises(Exception, match="no pricing for model nope"):
        pri.price_usage(use("nope"), rates).collect()


@pytest.mark.parametrize(("counts", "n", "expected"), [
    ({"a": 32, "b": 32, "c": 32, "d": 32}, 20, {"a": 5, "b": 5, "c": 5, "d": 5}),
    ({"a": 128, "b": 128, "c": 64, "d": 64}, 12, {"a": 4, "b": 4, "c": 2, "d": 2}),
    ({"a": 3, "b": 3, "c": 3}, 4, {"a": 2, "b": 1, "c": 1}),
])
def test_allocate(rows, counts, n, expected):
    df = rows("source string, n long", list(counts.items()))
    assert {r.source: r.quota for r in tsk.allocate(df, n).collect()} == expected


def test_allocate_more_than_there_is(rows):
    with pytest.raises(Exception, match="cannot sample 3"):
        tsk.allocate(rows("source string, n long", [("a", 2)]), 3).collect()


def test_samples_nest_and_ignore_order(rows):
    data = [(f"{s}-{i:03d}", s, i % 9 == 0) for s in ("a", "b") for i in range(60)]
    ids = lambda df: sorted(r.task_id for r in df.collect())
    frame = rows("task_id string, source string, excluded boolean", data)
    shuffled = rows("task_id string, source string, excluded boolean", random.Random(1).sample(data, len(data)))
    small, big = ids(tsk.sample_per_source(frame, 5, 0)), ids(tsk.sample_per_source(frame, 9, 0))
    assert set(small) < set(big) and small == ids(tsk.sample_per_source(shuffled, 5, 0))
    assert small != ids(tsk.sample_per_source(frame, 5, 1))
    assert not {t for t, _, e in data if e} & set(big)
    with pytest.raises(Exception, match="cannot sample 99"):
        tsk.sample_per_source(frame, 99, 0).collect()
    whole = ids(tsk.stratified_sample(frame, 12, 3))
    assert len(whole) == 12 and sum(t.startswith("a") for t in whole) == 6


def test_failure_subset_takes_all_when_few(rows):
    data = [("a", "r1", f"k{i}") for i in range(7)] + [("b", "r1", "z")]
    df = rows("source string, run_id string, failure_key string", data)
    assert tsk.failure_subset(df, 8, 0).count() == 8
    picked = tsk.failure_subset(df, 6, 0).collect()
    assert len(picked) == 6 and sum(r.source == "b" for r in picked) == 1


def test_normalise_tasks_errors(rows):
    ddl = "id string, domain string, canary string"
    good = tsk.normalise_tasks(rows(ddl, [("bc-1", "search", None), ("x-1", "general", "claw"), ("apex-1", "office", None)]))
    assert {r.id: (r.source, r.excluded) for r in good.collect()} == {"bc-1": ("browsecomp", False), "x-1": ("claw_eval", False), "apex-1": ("apex", True)}
    for bad, text in (([("zz-1", "search", None)], "cannot determine source"), ([("bc-1", "office", None)], "disagrees"), ([("bc-1", "search", None)] * 2, "duplicate task id")):
        with pytest.raises(Exception, match=text):
            tsk.normalise_tasks(rows(ddl, bad)).collect()


def test_reason_rules(rows):
    df = rows("reason string", [("hle_judge: incorrect — wrong value",), ("claw_grader: no trajectory path on task",), ("apex_grader: 3/6 criteria passed",), ("final_answer_exact",)])
    out = {r.reason: (r.family, r.kind) for r in out_.reason_family(df).collect()}
    assert out["hle_judge: incorrect — wrong value"] == ("judged", "hle_judge")
    assert out["claw_grader: no trajectory path on task"] == ("infra", "missing_trajectory")
    with pytest.raises(Exception, match="unknown scorer reason"):
        out_.reason_family(rows("reason string", [("new text",)])).collect()


def test_recovery_and_partial_score(rows):
    calls = {"ok": [("a", 200)], "back": [("a", 500), ("a", 200)], "floor": [("a", 500)] + [("b", 200)] * 9, "none": [("a", 500)],
             "part": [("list", 200), ("update", 200), ("update", 500)], "bad": [("list", 200), ("delete", 200)]}
    df = rows("rollout_id string, tool_name string, response_status int, ord int", [(r, t, s, i) for r, cs in calls.items() for i, (t, s) in enumerate(cs)])
    rates = {r.rollout_id: r.robustness for r in dsp.recovery_rate(df).collect()}
    assert (rates["ok"], rates["back"], rates["floor"], rates["none"], rates["part"]) == (1.0, 1.0, 0.5, 0.0, 0.5)
    runs = rows("rollout_id string, task_id string", [("part", "t"), ("bad", "t"), ("silent", "t")])
    checks = rows("task_id string, component string, weight double, tool_name string, min_calls int, total_weight double",
                  [("t", "listing", 0.15, "list", 1, 1.0), ("t", "updates", 0.25, "update", 2, 1.0)])
    out = {r.rollout_id: r for r in dsp.satisfied_tool_score(runs, df, checks, rows("task_id string, tool_name string", [("t", "delete")])).collect()}
    assert out["part"].completion == 0.15 and out["part"].value == round(0.8 * 0.15 + 0.2 * 0.5, 4)
    assert out["bad"].safety == 0.0 and out["bad"].value == 0.0
    assert out["silent"].robustness == 1.0 and out["silent"].value == 0.2


# ------------------------------------------------------------------ exact helpers


def test_rounding_matches_binary_half_even(rows):
    rng = random.Random(0)
    xs = [0.125, 0.375, 0.285, 2.675, 1.005, 0.025, 0.0, 1e-20, -2.675, 123456.789] + [rng.random() * 10 ** rng.randint(-6, 6) for _ in range(500)]
    df = rows("x double", [(x,) for x in xs])
    for r in df.select("x", numbers.exact_round(c("x"), 2).alias("r"), numbers.fixed_digits(c("x"), 2).alias("t")).collect():
        assert r.r == round(r.x, 2) and r.t == f"{r.x:.2f}"


def test_canonical_json_text(rows):
    texts = ["plain", 'q"uo\\te', "é\n\t\x01\x7f", "😀x", "a/b"]
    df = rows("s string", [(s,) for s in texts])
    for r in df.select("s", tx.json_string(c("s")).alias("j"), tx.json_list(F.array("s", "s")).alias("l")).collect():
        assert r.j == json.dumps(r.s)
        assert r.l == json.dumps([r.s, r.s], separators=(",", ":"))


def test_hash_rank_is_a_plain_ranking(rows):
    data = [("hot" if i % 3 else f"g{i % 5}", i) for i in range(3000)]
    df = rows("k string, i int", data).withColumn("h", scale.seeded_hash(7, c("k"), c("i")))
    digest = lambda k, i: hashlib.sha256(f"7:{k}:{i}".encode()).hexdigest()
    want = {}
    for k in {k for k, _ in data}:
        for rank, i in enumerate(sorted((i for kk, i in data if kk == k), key=lambda i: digest(k, i)), start=1):
            want[i] = rank
    assert {r.i: r.rn for r in scale.hash_rank(df, ["k"], "h", ["i"]).collect()} == want
    assert {r.i for r in scale.hash_rank(df, ["k"], "h", ["i"], limit=50).collect()} == {i for i, r in want.items() if r <= 50}


def test_exact_quantiles_with_outliers_and_ties(rows):
    rng = random.Random(2)
    groups = {"hot": [rng.random() for _ in range(4000)] + [1e9], "ties": [3.0] * 500 + [7.0] * 499, "one": [5.0], "two": [1.0, 2.0]}
    df = rows("k string, v double", [(k, v) for k, vs in groups.items() for v in vs])
    picks = {**scale.median_picks("m"), "p90": scale.nearest_rank(0.9)}
    for r in scale.exact_quantiles(df, ["k"], "v", picks, buckets=16).collect():
        vs = sorted(groups[r.k])
        assert (r.m_lo + r.m_hi) / 2 == statistics.median(vs)
        assert r.p90 == vs[round(0.9 * (len(vs) - 1))]


def test_exact_quantiles_with_outliers_of_two_scales_and_both_signs(rows):
    rng = random.Random(5)
    vs = [rng.random() for _ in range(3000)] + [1e18] * 3 + [1e9, 2e9, -1e18, -3e-300, 0.0, 5e-324] + [-rng.random() for _ in range(500)]
    df = rows("k string, v double", [("hot", v) for v in vs])
    picks = {f"q{i}": scale.nearest_rank(i / 40) for i in range(41)}
    got = scale.exact_quantiles(df, ["k"], "v", picks, buckets=64).first()
    assert [got[f"q{i}"] for i in range(41)] == [sorted(vs)[round(i / 40 * (len(vs) - 1))] for i in range(41)]


def test_member_digest_of_large_groups_counts_every_member(rows):
    base = [("hot", f"m{i}") for i in range(500)] + [("cold", "a"), ("cold", "b")]
    exact = lambda items: F.sha2(F.concat_ws(",", items), 256)
    run = lambda data: {r.k: r.digest for r in scale.member_digest(rows("k string, m string", data), ["k"], "m", exact).collect()}
    sha = lambda text: hashlib.sha256(text.encode()).hexdigest()
    buckets = {}
    for member in sorted(f"m{i}" for i in range(70_000)):
        buckets.setdefault(sha(member)[:4], []).append(member)
    base = [("hot", f"m{i}") for i in range(70_000)] + base[500:]
    found = run(base)
    assert found["cold"] == sha(",".join(sorted(sha(m)[:4] + sha(m) for m in "ab")))
    assert found["hot"] == sha(",".join(sorted(b + sha("\n".join(ms)) for b, ms in buckets.items())))
    assert found["hot"] == run(base[::-1])["hot"] != run(base[1:])["hot"]


def test_prior_value_over_block_borders(rows):
    events = rows("k string, step int, ord int, v string", [("a", 1, 0, "x"), ("a", 1, 1, "y"), ("a", 600, 2, "z"), ("b", 5, 0, "q")])
    probes = rows("k string, step int, tag int", [("a", 1, 1), ("a", 2, 2), ("a", 599, 3), ("a", 601, 4), ("a", 5000, 5), ("b", 5, 6), ("c", 9, 7)])
    out = {r.tag: r.prior_v for r in scale.prior_value(probes, events, ["k"], "step", "ord", "v").collect()}
    assert out == {1: None, 2: "y", 3: "y", 4: "z", 5: "z", 6: None, 7: None}


# ------------------------------------------------------------------ sources


def test_strict_jsonl(spark, tmp_path):
    path = tmp_path / "a.jsonl"
    good = {"seq": 1, "run_id": "r", "schema_version": 1, "ts": "2026-09-02T02:00:00Z", "kind": "k", "payload": "{}"}
    path.write_text(json.dumps(good) + "\n\n" + json.dumps({**good, "seq": 2}) + "\n")
    assert [r.seq for r in jsonl.scan_jsonl_strict(spark, str(path), schemas.TRACE, schemas.TRACE_REQUIRED).orderBy("seq").collect()] == [1, 2]
    for text, match in (("{oops", "not a JSON object"), ("[1]", "not a JSON object"), (json.dumps({**good, "extra": 1}), "unknown field"),
                        (json.dumps({k: v for k, v in good.items() if k != "kind"}), "missing field"), (json.dumps({**good, "seq": "x"}), "(?i)malformed|parse")):
        path.write_text(json.dumps(good) + "\n" + text + "\n")
        with pytest.raises(Exception, match=match):
            jsonl.scan_jsonl_strict(spark, str(path), schemas.TRACE, schemas.TRACE_REQUIRED).select("seq").collect()


def test_record_files_and_lists(spark, tmp_path):
    for task, rep, sub, scored in (("t2", "r1", "", True), ("t1", "r1", "", False), ("t1", "r1", "attempt_2", True)):
        folder = tmp_path / "rollouts" / task / rep / sub
        folder.mkdir(parents=True, exist_ok=True)
        (folder / "done.json").write_text(json.dumps({"task_id": task, "replicate": rep, "attempt": 2 if sub else 1}, indent=1))
        if scored:
            (folder / "score.json").write_text(json.dumps({"passed": True, "value": 0.5}))
    out = jsonl.scan_json_records(spark, str(tmp_path), "task_id string, replicate string, attempt int", "passed boolean, value double").collect()
    assert [(r.task_id, r.attempt, r.score.passed if r.score else None) for r in out] == [("t1", 1, None), ("t1", 2, True), ("t2", 1, True)]
    (tmp_path / "list.json").write_text('[{"a": 1},\n {"a": 2}]')
    assert jsonl.scan_json_list(spark, str(tmp_path / "list.json"), "a int").count() == 2
    assert jsonl.scan_json_list(spark, str(tmp_path / "none.json"), "a int").count() == 0


def test_run_folders(spark, tmp_path):
    for name in ("e0b-b1-hle-p10", "e0b-b1-hle-p2", "e0b-b1-hle-p2-ref", "e0b-b2-hle-p1", "e0b-b1-claw_eval-p1", "e0b-b1-hle-p3"):
        (tmp_path / name).mkdir()
        if name != "e0b-b1-hle-p3":
            (tmp_path / name / "manifest.json").write_text("{}")
    names = lambda ref: [r.run_id for r in src.scan_runs(spark, str(tmp_path), "e0b", "b1", "hle", ref).collect()]
    assert names(False) == ["e0b-b1-hle-p2", "e0b-b1-hle-p10"] and names(True) == ["e0b-b1-hle-p2-ref"]


def test_tree_hash_and_report_file(spark, rows, tmp_path):
    tree = tmp_path / "tree"
    files = {"a/x.txt": b"one", "a-b/x.txt": b"two", "z.bin": bytes(range(256))}
    for name, data in files.items():
        (tree / name).parent.mkdir(parents=True, exist_ok=True)
        (tree / name).write_bytes(data)
    sha = lambda data: hashlib.sha256(data).hexdigest()
    lines = [f"{name}\x00{len(data)}\x00{sha(data)}".encode() for name, data in files.items()]
    want = sha("".join(sorted(sha(line)[:4] + sha(line) for line in lines)).encode())
    assert src.scan_table_hash(spark, str(tree)).first().digest == want
    table = rows("source string, n int, note string", [("b", 2, None), ("a", 1, 'x,"y"')])
    src.write_report_csv(table, str(tmp_path / "csv"), ["source"])
    part = next((tmp_path / "csv").glob("part-*.csv"))
    assert part.read_text() == 'source,n,note\na,1,"x,""y"""\nb,2,\n'


def test_rollout_log(spark, tmp_path):
    (tmp_path / "rollout.log").write_text(
        "12:00:00 [INFO] [+  1.5s] step 1 - model returned in 1.2s, tokens=15 (prompt=10, completion=5)\n"
        "12:00:01 [INFO] [+  2.0s] step 1 - shell exit=-9 in 0.1s: ls -la\n"
        "12:00:01 [WARNING] [+  2.5s] step 2 - SHELL TIMEOUT after 30.0s: sleep 99\nnoise\n"
        "12:00:02 [ERROR] [+  3.0s] step 3 - MODEL CALL ERROR after 2.0s: boom\n")
    lines = logs.read_log_lines(spark, str(tmp_path))
    events = logs.rollout_log_events(lines).orderBy("ord", "sub").collect()
    assert [e.kind for e in events] == ["model_call", "tool_call", "observation", "tool_call", "observation", "model_call"]
    assert events[0].prompt_tokens == 10 and events[2].exit_code == -9 and events[4].timed_out and events[5].error == "boom"
    final = logs.rollout_log_final(lines).first()
    assert (final.exit_reason, final.steps, final.duration_seconds) == ("model_call_error", 1, None)


def test_trace_violations(rows):
    df = rows("file string, seq long, run_id string, schema_version int", [("f", 1, "r", 1), ("f", 3, "r", 1), ("f", 4, "x", 2), ("g", 2, "r", 1), ("h", 1, "r", 1), ("h", 1, "r", 1)])
    assert {(r.file, r.seq, r.kind) for r in logs.validate_trace(df).collect()} == {
        ("f", 3, "gap"), ("f", 4, "run_id"), ("f", 4, "schema_version"), ("g", 2, "gap"), ("h", 1, "duplicate")}


def test_trace_lines_in_another_order_and_the_expected_run(rows):
    lines = [("f", 1, 1), ("f", 2, 3), ("f", 3, 2), ("f", 4, 4)] + [("g", n, n) for n in range(1, 700)]
    df = rows("file string, line long, seq long", lines).withColumn("run_id", F.lit("r")).withColumn("schema_version", F.lit(1))
    assert [tuple(r) for r in logs.validate_trace(df).collect()] == [("f", 2, "order")]
    other = {(r.file, r.seq) for r in logs.validate_trace(df.drop("line"), run_id="x").collect()}
    assert other == {(f, s) for f, _, s in lines}
