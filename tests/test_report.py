"""Report tables against hand values."""

from pyspark.sql import functions as F

from runlens.operators import agreement as agr
from runlens.operators import report as rep

ARM = "struct<rollouts:array<struct<status:string>>>"
REPLAYS = (f"source string, failure_key string, failure_type string, oracle_step int, oracle_step_basis string, usd decimal(18,6), "
           f"candidates array<struct<step:int,status:string,substitute:{ARM},control:{ARM}>>, "
           "drift_reports map<string,struct<drifts:array<struct<reason:string>>>>")


def arm(*statuses):
    return ([(s,) for s in statuses],)


def test_drift_table(rows):
    from decimal import Decimal

    drifts = {"a": ([("z",), ("exit",), (None,)],), "b": ([("exit",)],), "c": (None,), "d": ([],)}
    df = rows(REPLAYS, [
        ("s", "k1", "stochastic", 3, "replay", Decimal("1.5"),
         [(3, "tested", arm("unreplayable", "passed"), arm("unreplayable")), (9, "skipped", (None,), None)], drifts),
        ("s", "k2", "unreplayable", None, "none", None, [], {}), ("s", "k3", None, None, None, None, None, None)])
    out = {r.failure_key: tuple(r)[2:] for r in rep.drift_table(df).collect()}
    assert out["k1"] == ("stochastic", 3, "replay", 2, "3:tested;9:skipped", 2, "None=1;exit=2;z=1", 1.5)
    assert out["k2"] == ("unreplayable", None, "none", 0, "", 0, "", None)
    assert out["k3"][3:7] == (0, "", 0, "")


def test_reopened_types(rows):
    ddl = "source string, run_id string, failure_key string, failure_type string"
    before = rows(ddl, [("s", "p1", "a", "unresolved"), ("s", "p1", "b", "stochastic"), ("s", "gone", "c", "stochastic"), ("only", "p1", "d", "stochastic")])
    after = rows(ddl, [("s", "p1", "a", "deterministic"), ("s", "p1", "b", "stochastic"), ("s", "p2", "e", "unrepairable"), ("t", "p1", "f", None)])
    tried = rows("source string, run_id string, status string, confirmed boolean", [
        ("s", "p1", "tested", True), ("s", "p1", "tested", False), ("s", "p1", "tested", None), ("s", "p1", "skipped", True), ("s", "gone", "tested", True)])
    out = {(r.source, r.failure_type): (r.before, r.after) for r in rep.reopened_types(before, after, tried).collect()}
    assert {k[0] for k in out} == {"s", "t"} and len(out) == 14
    assert out["s", "unresolved"] == (1, 0) and out["s", "deterministic"] == (0, 1) and out["s", "stochastic"] == (1, 1)
    assert out["s", "unrepairable"] == (1, 1)
    assert out["s", "candidates_confirmed_n>=5"] == (None, 1) and out["s", "candidates_unconfirmed_fixed_k"] == (None, 2)
    assert out["t", "candidates_confirmed_n>=5"] == (None, 0)


def test_scores_and_coherent_rows_without_a_match(rows):
    records = rows("task int, steps int", [(1, 5), (2, 6)])
    assert {r.task: r.value for r in rep.attach_scores(records, rows("task int, value double", [(1, 0.5), (9, 1.0)]), ["task"]).collect()} == {1: 0.5, 2: None}
    generated = rows("source string, run_id string, cluster_id long, decoy_component string, decoy_step int, step_basis string, cause_label string, "
                     "severity string, generation_seed long", [("s", "p", 1, "d", 1, "b", "c", "low", 0), ("s", "p", 2, "d", 1, "b", "c", "low", 0),
                                                               ("s", "p", 3, "d", 1, "b", "c", "low", 1)])
    scores = rows("source string, cluster_id long, generation_seed long, reference_score int, coherent_score int, error string", [("s", 1, 0, 3, 2, None)])
    pooled = rows("source string, final_generation_seed long", [("s", 0)])
    out = {r.cluster_id: (r.reference_score, r.coherent_score) for r in rep.coherent_table(generated, scores, pooled).collect()}
    assert out == {1: (3, 2), 2: (None, None)}


def test_chance_rates(rows):
    pools = rows("source string, run_id string, pool_size long", [("s", "p1", 100), ("s", "p2", 4), ("t", "p1", 2), ("e", "p1", 0)])
    assert {r.source: (r.chance_top1, r.chance_top3) for r in agr.chance_rates(pools).collect()} == {"s": (0.25, 0.75), "t": (0.5, 1.0), "e": (1.0, 1.0)}
    scored = rows("source string, arm string, error string, tool_precision double, tool_recall double", [("s", "a", None, 1.0, 0.5), ("u", "a", None, 1.0, 0.5)])
    flags = scored.withColumns({x: F.lit(True) for x in ("hit_top1", "hit_top3", "origin_hit_top1", "category_hit")})
    assert {r.source: (r.task_top1, r.chance_top1) for r in agr.probe_rates(flags, pools=pools).collect()} == {"s": (1.0, 0.25), "u": (1.0, None)}
