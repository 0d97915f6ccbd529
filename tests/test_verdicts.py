"""Clusters, corruption, verdicts, statistics and decisions against hand values."""

import itertools
import math
from fractions import Fraction

import numpy as np
import pytest
from pyspark.sql import functions as F

from runlens import fixed
from runlens.operators import attribution as att
from runlens.operators import clusters as clu
from runlens.operators import corruption as cor
from runlens.operators import decisions as dec
from runlens.operators import dispatches as dsp
from runlens.operators import report as rep
from runlens.operators import spans as spn
from runlens.operators import stats as sta
from runlens.operators import verdicts as ver

c = F.col
CALIBRATION = (
    "source string, position int, pass_rate double, aa_delta_points double, heldout_delta_points double, "
    "clusters_with_two int, primary_clusters int, has_runs boolean"
)
EXTRAS = "cost_per_rollout double, judge_self_consistency double, judge_self_consistency_vision double, vision_disagreement double, vision_compared int"
DIAG = "failure_key string, cause_label string, component string, step int, severity string, failure_type string, oracle_validated boolean"
DIAGNOSES = [
    ("a/r1/1", "argument_error", "system_prompt", 3, "medium", "deterministic", True),
    ("a/r2/1", "argument_error", "system_prompt", 5, "high", "stochastic", True),
    ("b/r1/1", "context_loss", "verifier", None, "low", "deterministic", True),
    ("c/r1/1", "wrong_target", "tool_router", 2, "critical", None, False),
]


def test_cluster_representative_and_id(rows):
    import hashlib
    import json

    df = rows(DIAG, DIAGNOSES)
    by = {r.component: r for r in clu.failure_clusters(df).collect()}
    assert len(by) == 3 and by["system_prompt"].representative == "a/r2/1" and by["system_prompt"].max_severity == "high"
    assert by["system_prompt"].failure_types == "deterministic=1,stochastic=1" and by["tool_router"].failure_types == "unvalidated=1"
    ids = {r.component: r.cluster_id for r in clu.cluster_ids(df).collect()}
    sha = lambda x: hashlib.sha256(x.encode()).hexdigest()
    parts = sorted(sha(m)[:4] + sha(m) for m in ("a/r1/1", "a/r2/1"))
    doc = {"cause": "argument_error", "component": "system_prompt", "members": parts}
    text = json.dumps(doc, sort_keys=True, separators=(",", ":"))
    assert ids["system_prompt"] == "c" + hashlib.sha256(text.encode()).hexdigest()[:8]
    again = clu.membership_hash(rows(DIAG, DIAGNOSES[::-1])).first()
    assert clu.membership_hash(df).first() == again and again.clusters == 3


def corruption_inputs(spark, rows, steps=(1, 2, 3, 4, 5, 6)):
    comps = att.component_table(spark)
    data = [("c1", "system_prompt", "argument_error", "m1", "f1", 2), ("c2", "verifier", "context_loss", "m2", "f1", 3), ("c3", "tool_router", "wrong_target", "m3", "f3", 4)]
    clusters = rows("cluster_id string, component string, cause_label string, mechanism string, fix_hint string, step int", data).withColumn("severity", F.lit("low"))
    candidates = rows("cluster_id string, component string", [("c1", "task_prompt"), ("c1", "planner")])
    activity = clusters.select("cluster_id").join(comps.select("component")).withColumn("step", F.explode(F.array(*[F.lit(s) for s in steps])))
    verdicts = rows("cluster_id string, step int, verdict string", [("c1", 2, "positive"), ("c2", 3, "positive"), ("c3", 4, "positive"), ("c1", 5, "negative")])
    return clusters, comps, candidates, activity, verdicts


def test_where_corruption(spark, rows):
    args = corruption_inputs(spark, rows)
    picks = {(r.cluster_id, r.arm): r for r in cor.corrupt_where(*args, seed=1).collect()}
    layer = {r.component: (r.layer, r.patchable and r.where_eligible) for r in args[1].collect()}
    for (cluster, arm), r in picks.items():
        assert r.impossible is None and r.decoy_component != r.true_component and layer[r.decoy_component][1]
        assert r.same_layer == (layer[r.decoy_component][0] == layer[r.true_component][0])
        near = arm.endswith("near")
        assert r.distance_fallback == (near and r.true_component == "verifier")  # alone in its layer
        assert r.same_layer == (near and not r.distance_fallback)
    assert picks[("c1", "corrupt_where_near")].decoy_component not in ("task_prompt", "planner")
    assert {picks[(k, "corrupt_where_near")].decoy_step for k in ("c1",)} <= {1, 3, 4, 5, 6}
    other = {(r.cluster_id, r.arm): (r.decoy_component, r.decoy_step) for r in cor.corrupt_where(*args, seed=2).collect()}
    assert other != {k: (r.decoy_component, r.decoy_step) for k, r in picks.items()}
    stuck = corruption_inputs(spark, rows, steps=(2,))
    assert {r.cluster_id: r.impossible for r in cor.corrupt_where(*stuck, ("near",), 1).collect()}["c1"] == fixed.NOT_ACTIVE
    banned = args[1].select(F.lit("c1").alias("cluster_id"), "component")
    assert {r.cluster_id: r.impossible for r in cor.corrupt_where(args[0], args[1], banned, *args[3:]).collect()}["c1"] == fixed.NO_DECOY


def test_coherent_prefers_validated_negative_steps(spark, rows):
    out = {r.cluster_id: r for r in cor.corrupt_coherent(*corruption_inputs(spark, rows), seed=0).collect()}
    assert (out["c1"].step_basis, out["c1"].decoy_step) == ("validated_negative", 5)
    assert out["c2"].step_basis == "not_sufficient" and out["c2"].decoy_step != 3


def test_donors_differ_and_cover(rows):
    data = [(f"c{i}", "cause", f"m{i % 3}", "same" if i < 40 else "other") for i in range(60)]
    df = rows("cluster_id string, cause_label string, mechanism string, fix_hint string", data)
    hint = {d[0]: d[3] for d in data}
    how = cor.corrupt_how(df, 0).collect()
    assert len(how) == 60 and all(hint[r.cluster_id] != hint[r.origin_cluster] for r in how)
    assert len({r.origin_cluster for r in how if hint[r.cluster_id] == "same"}) == 20
    assert sorted(r.origin_cluster for r in cor.shuffle_all(df, 0).collect()) == sorted(d[0] for d in data)
    lonely = cor.corrupt_how(df.where(c("fix_hint") == "same"), 0)
    assert {r.impossible for r in lonely.collect()} == {fixed.NO_DONOR}


def schedule_reference(sub, ctl, economize, schedule=(3, 5, 8, 12)):
    """The stages run one after the other on recorded trials."""
    stages, used = [], False
    for n in schedule:
        if len(sub) < n:
            break
        if n == schedule[0] and all(s == "unreplayable" for s in sub[:n]):
            return "unreplayable", n, True
        p_sub = sum(s == "passed" for s in sub[:n]) / n
        if economize and not used and n <= 5 and p_sub <= 0.4 + 1e-9:
            stages.append((n, "control_skipped"))
            if n >= 5:
                return "negative", n, True
            continue
        if len(ctl) < n:
            break
        used = True
        p_ctl = sum(s != "failed" for s in ctl[:n]) / n
        d = p_sub - p_ctl
        if p_sub + 1e-9 >= 0.6 and p_ctl <= 0.34 + 1e-9 and d + 1e-9 >= 0.4:
            decision = "positive"
        else:
            decision = "negative" if p_sub <= 0.4 + 1e-9 or d <= 0.1 + 1e-9 else "undecided"
        stages.append((n, decision))
        if n >= 5 and decision != "undecided":
            return decision, n, True
    if not stages:
        return None, None, False
    n, decision = stages[-1]
    verdict = {"control_skipped": "negative", "undecided": "unresolved"}.get(decision, decision)
    return verdict, n, n >= 12 or (n >= 5 and verdict != "unresolved")


@pytest.mark.parametrize("economize", [True, False])
def test_schedule_matches_a_step_by_step_run(rows, economize):
    rng = np.random.default_rng(5)
    cases = {}
    for i in range(400):
        p, q = rng.random(), rng.random()
        arm = lambda rate, n: [str(rng.choice(["passed", "failed", "unreplayable"], p=[rate * 0.9, (1 - rate) * 0.9, 0.1])) for _ in range(n)]
        cases[f"k{i}"] = (arm(p, int(rng.integers(0, 13))), arm(q, int(rng.integers(0, 13))))
    cases["dead"] = (["unreplayable"] * 3, [])
    data = [(k, 1, a, i, s) for k, pair in cases.items() for a, arm_ in zip(("substitute", "control"), pair) for i, s in enumerate(arm_, start=1)]
    out = {r.failure_key: (r.verdict, r.n, r.confirmed) for r in ver.schedule_verdicts(
        rows("failure_key string, step int, arm string, idx int, status string", data), economize=economize).collect()}
    for k, (sub, ctl) in cases.items():
        if k in out:
            assert out[k] == schedule_reference(sub, ctl, economize), (k, sub, ctl)


def test_failure_types_and_oracle(rows):
    ddl = "failure_key string, step int, divergence string, status string, k int, sub_passed int, sub_scored int, ctl_passed int, ctl_scored int, ctl_skipped boolean, verdict string, confirmed boolean"
    row = lambda key, step, sub, ctl, kind="different_action", status="tested", skipped=False, scored=3, verdict=None: (
        key, step, kind, status, 3, sub, 3, ctl, scored, skipped, verdict, False)
    df = rows(ddl, [
        row("det", 4, 3, 0), row("det", 2, 3, 0), row("sto", 1, 2, 2), row("sto", 3, 1, 3), row("sto", 9, 0, 2, kind="argument_variant"),
        row("unr", 1, 0, 0), row("unr", 2, 0, 1), row("gone", 1, 0, 0, status="unreplayable"), row("open", 1, 2, 1, skipped=True),
        row("dark", 1, 0, 0, skipped=True), row("skip", 1, 0, 0, status="skipped")])
    out = {r.failure_key: (r.failure_type, r.oracle_step, r.oracle_step_basis) for r in ver.oracle_step(df).collect()}
    assert out == {
        "det": ("deterministic", 2, "sufficient"), "sto": ("stochastic", 3, "manifestation"), "unr": ("unrepairable", None, "unvalidated"),
        "gone": ("unreplayable", None, "unvalidated"), "open": ("unresolved", None, "unvalidated"), "dark": ("unreplayable", None, "unvalidated"),
        "skip": ("unreplayable", None, "unvalidated")}


def test_genuineness(rows):
    ddl = "k string, source string, missing_tools int, deliverables int, gathering int, executed int, steps int, observations int, g2 boolean, g3 boolean"
    df = rows(ddl, [("a", "claw_eval", 0, 0, 0, 0, 3, 2, True, True), ("b", "claw_eval", 1, 0, 0, 0, 3, 2, True, True), ("c", "gdpval", 0, 1, 0, 0, 3, 2, None, False),
                    ("d", "hle", 0, 0, 0, 1, 1, 2, True, True), ("e", "hle", 0, 0, 0, 1, 2, 1, None, None), ("f", "browsecomp", 0, 0, 0, 4, 3, 2, True, True)])
    out = {r.k: r.verdict for r in dsp.genuineness(df).collect()}
    assert out == {"a": "genuine", "b": "shortcut", "c": "shortcut", "d": "undetermined", "e": "undetermined", "f": "shortcut"}


# ------------------------------------------------------------------ statistics


def test_sign_flip(rows):
    df = rows("g string, effect double", [("p", 1.0), ("p", 2.0), ("p", 3.0), ("n", -1.0), ("n", -2.0), ("n", -3.0), ("z", 0.0), ("z", 0.0)])
    assert {r.g: r.p for r in sta.sign_flip_p(df, ["g"]).collect()} == {"p": 0.25, "n": 0.25, "z": 1.0}
    y = [0.3, -1.2, 2.5, 0.7, 1.9, -0.4, 3.3]
    brute = np.mean([abs(sum(s * v for s, v in zip(signs, y))) >= abs(sum(y)) - 1e-12 for signs in itertools.product((1, -1), repeat=len(y))])
    assert sta.sign_flip_p(rows("g string, effect double", [("y", v) for v in y]), ["g"]).first().p == pytest.approx(brute)
    with pytest.raises(Exception, match="limited to n <= 20"):
        sta.sign_flip_p(rows("g string, effect double", [("y", 1.0)] * 21), ["g"]).collect()


@pytest.mark.parametrize(("pos", "neg", "p"), [(5, 0, 2 / 32), (0, 0, None), (3, 3, 1.0), (1, 4, 0.375)])
def test_sign_test(rows, pos, neg, p):
    got = rows("a int, b int", [(pos, neg)]).select(sta.sign_test_p(c("a"), c("b")).alias("p")).first().p
    assert got == (None if p is None else pytest.approx(p))


def test_sign_test_of_many_pairs_does_not_underflow(rows):
    got = rows("a int, b int", [(2600, 2400)]).select(sta.sign_test_p(c("a"), c("b")).alias("p")).first().p
    assert 0.0045 < got < 0.0050


@pytest.mark.parametrize(("pos", "neg"), [(7, 30), (400, 600), (17, 16), (5000, 5500), (524_000, 524_000), (600_000, 598_900), (40, 3000)])
def test_sign_test_is_within_a_billionth_of_the_exact_value(rows, pos, neg):
    m, k = pos + neg, min(pos, neg)
    logs = [math.lgamma(m + 1) - math.lgamma(i + 1) - math.lgamma(m - i + 1) - m * math.log(2) for i in range(max(0, k - 20_000), k + 1)]
    want = min(1.0, 2 * math.fsum(math.exp(x) for x in logs))
    got = rows("a int, b int", [(pos, neg)]).select(sta.sign_test_p(c("a"), c("b")).alias("p")).first().p
    assert got == pytest.approx(want, abs=1e-9, rel=1e-8)


def test_sign_test_of_few_pairs_is_exact(rows):
    counts = [(m, k) for m in [*range(1, 41), 63, 64, 127, 128, 129, 255, 400, 1000] for k in {0, 1, 2, m // 8, m // 3, m // 2 - 1, m // 2} if 0 <= k <= m // 2]
    df = rows("a int, b int", [(k, m - k) for m, k in counts]).select("a", "b", sta.sign_test_p(c("a"), c("b")).alias("p"))
    for r in df.collect():
        m = r.a + r.b
        want = min(1.0, float(Fraction(2 * sum(math.comb(m, i) for i in range(r.a + 1)), 2**m)))
        assert r.p == pytest.approx(want, abs=1e-12, rel=1e-6 if want > 1e-12 else 1), (m, r.a)


def test_sign_test_of_billions_of_pairs(rows):
    data = [(3_000_000_000, 2_900_000_000), (3_000_000_000, 3_000_000_000), (3_000_050_000, 2_999_950_000)]
    got = [r.p for r in rows("a long, b long", data).select(sta.sign_test_p(c("a"), c("b")).alias("p")).collect()]
    z = 99_999 / math.sqrt(6e9)
    assert got[0] < 1e-9 and got[1] == 1.0 and got[2] == pytest.approx(math.erfc(z / math.sqrt(2)), abs=1e-9)


def test_bootstrap_draws_do_not_depend_on_the_run_length(rows):
    df = rows("source string, run_a string, run_b string, n11 long, n10 long, n01 long, n00 long", [("s", "p1", "p2", 200, 60, 40, 100), ("same", "p1", "p2", 5, 0, 0, 5)])
    drawn = {r.source: r for r in sta.bootstrap_delta(df).collect()}
    assert drawn == {r.source: r for r in sta.bootstrap_delta(df, draws_per_row=7).collect()}
    assert (drawn["same"].ci_low, drawn["same"].ci_high) == (0.0, 0.0)
    assert 0.0 <= drawn["s"].ci_low < 1.2 and 9.0 < drawn["s"].ci_high < 10.8  # sd: about 2.46 points around 5
    large = [("l", "p1", "p2", 40_000, 12_000, 8_000, 20_000)]  # far above one run of draws
    r = sta.bootstrap_delta(rows("source string, run_a string, run_b string, n11 long, n10 long, n01 long, n00 long", large), n=200).first()
    assert 4.5 < r.ci_low < 5.0 < r.ci_high < 5.5


# ---- fixed values: published pass rates, pass outcomes, bands and decisions
PASS_RATES = {
    "gdpval": ([80.00, 86.67, 76.67, 86.67, 83.33], (82.67, 4.35, 10, 5.33, 10.00, 10.00)),
    "claw_eval": ([66.67, 70.00, 70.00, 63.33, 66.67, 70.00, 60.00, 70.00], (67.08, 3.75, 28, 4.17, 10.00, 10.00)),
}
# source -> outcomes of two passes (both, first only, second only, neither), agreement, delta, upper bound
OUTCOMES = {
    "browsecomp": ((5, 2, 1, 2), 0.7000, 10.00, 40.00),
    "hle": ((11, 6, 3, 12), 0.7188, 9.38, 28.12),
    "gdpval": ((43, 2, 6, 5), 0.8571, 7.14, 16.07),
    "claw_eval": ((38, 2, 4, 12), 0.8929, 3.57, 12.50),
}
# source, pass rate, delta, held-out delta, clusters with two, primary clusters
CALIBRATED = [
    ("browsecomp", 0.6833, 10.0, None, 0, 0), ("hle", 0.4844, 9.375, None, 0, 0),
    ("gdpval", 0.8466, 400 / 56, 200 / 30, 1, 1), ("claw_eval", 0.8214, 200 / 56, 100 / 30, 6, 6),
]
DESIGNS = [
    ("claw_eval", 7, 3, 1, 7.50, 451.05), ("claw_eval", 8, 3, 1, 6.75, 515.48), ("claw_eval", 10, 3, 1, 5.75, 644.35),
    ("claw_eval", 14, 3, 2, 4.25, 1801.87), ("gdpval", 7, 3, 1, 7.50, 597.70), ("gdpval", 8, 3, 1, 7.00, 683.09),
]
D8_TAIL = "no configuration within owner_budget_usd reaches delta_meaningful: best available within the budget; the paper states the exclusion bound "
DECIDED = {
    "D1:browsecomp": ("pass_rate=0.6833 aa_delta=10.00 clusters_with_two=0", "excluded"),
    "D1:hle": ("pass_rate=0.4844 aa_delta=9.38 clusters_with_two=0", "excluded"),
    "D1:gdpval": ("pass_rate=0.8466 aa_delta=7.14 clusters_with_two=1", "excluded"),
    "D1:claw_eval": ("pass_rate=0.8214 aa_delta=3.57 clusters_with_two=6", "enters E2"),
    "D2:browsecomp": ("primary_clusters=0", "0 primary; rest secondary"),
    "D2:hle": ("primary_clusters=0", "0 primary; rest secondary"),
    "D2:gdpval": ("primary_clusters=1", "1 primary; rest secondary"),
    "D2:claw_eval": ("primary_clusters=6", "6 primary; rest secondary"),
    "D3:browsecomp": ("aa_delta=10.00 widest_other=7.14", "descriptive only"),
    "D3:hle": ("aa_delta=9.38 widest_other=7.14", "descriptive only"),
    "D1prime": (
        "primary_clusters_in_included_sources=6 (min 8); included=['claw_eval']",
        "pivot required: (i) policy reasoning_effort low (deviation stated) or (ii) build M2b web freeze and re-admit browsecomp",
    ),
    "D4": ("projected_usd(k=3)=10.79 budget=600.0", "k=3"),
    "D5:browsecomp": ("no held-out A/A", "not evaluable"),
    "D5:hle": ("no held-out A/A", "not evaluable"),
    "D5:gdpval": ("heldout_delta=6.67", "45/source"),
    "D5:claw_eval": ("heldout_delta=3.33", "30/source"),
    "D6": ("text_self_consistency=0.9855 (Flash re-judge replaced by P1)", "single judge"),
    "D7": (
        "vision_self_consistency=1.0000 text_vs_vision_disagreement=0.0625 compared=256",
        "gdpval E2 primary judge = text (deepseek-v4-pro); vision reported as secondary",
    ),
    "D8:claw_eval": ("N=8 k=3 passes=1 MDE=6.75 points cost=515.48 USD (delta_meaningful=3.0)", D8_TAIL + "6.75 points"),
    "D8:gdpval": ("N=7 k=3 passes=1 MDE=7.50 points cost=597.70 USD (delta_meaningful=3.0)", D8_TAIL + "7.50 points"),
    "COH-WRONG:claw_eval": ("parity ok", "arm admitted"),
    "COH-WRONG:gdpval": ("parity ok", "arm admitted"),
}


def test_seed_noise_of_published_passes(rows):
    data = [(s, f"p{i}", r) for s, (rates, _) in PASS_RATES.items() for i, r in enumerate(rates)]
    out = {r.source: r for r in sta.seed_noise(rows("source string, run_id string, rate double", data)).collect()}
    for source, (rates, want) in PASS_RATES.items():
        r = out[source]
        got = (r.mean_rate, r.sigma_seed, r.pairs, r.abs_delta_mean, r.abs_delta_p90, r.abs_delta_p95)
        assert r.passes == len(rates) and got == pytest.approx(want, abs=0.011)
    alone = sta.seed_noise(rows("source string, run_id string, rate double", [("x", "p1", 50.0)])).first()
    assert (alone.passes, alone.mean_rate, alone.pairs) == (1, None, None)


def test_aa_band_of_published_outcomes(rows):
    kinds = ((True, True), (True, False), (False, True), (False, False))
    data = []
    for source, (counts, *_) in OUTCOMES.items():
        for (a, b), n in zip(kinds, counts):
            for i in range(n):
                data += [(source, "p1", f"{a}{b}{i}", a), (source, "p2", f"{a}{b}{i}", b)]
    data.append(("hle", "p1", "only in one pass", True))
    out = {r.source: r for r in sta.aa_band(rows("source string, run_id string, task_id string, pass_hat_k boolean", data)).collect()}
    for source, (counts, agreement, delta, high) in OUTCOMES.items():
        r = out[source]
        assert r.tasks == sum(counts) and r.agreement == pytest.approx(agreement, abs=6e-5)
        assert r.delta_points == pytest.approx(delta, abs=6e-3)
        assert r.ci_low == 0.0 and abs(r.ci_high - high) < 4  # another random generator


def test_published_decisions(rows):
    calibration = rows(CALIBRATION, [(s, i, rate, d, held, two, prim, True) for i, (s, rate, d, held, two, prim) in enumerate(CALIBRATED)])
    extras = rows(EXTRAS, [(10.79 / (8 * 7 * 3), 0.9855, 1.0, 0.0625, 256)])
    choices = rep.mde_choice(rows("source string, n int, k int, passes int, mde double, cost_usd double", DESIGNS), 600.0)
    parity = rows("source string, ok boolean", [("gdpval", True), ("claw_eval", True)])
    out = {r.rule: (r.observed, r.decision) for r in dec.decision_rules(calibration, extras, choices, parity, 600.0).collect()}
    assert out == DECIDED


def test_decisions_without_data(rows):
    calibration = rows(CALIBRATION, [("hle", 0, 0.5, None, None, 9, 2, True), ("gdpval", 1, None, None, None, 0, 0, False)])
    extras = rows(EXTRAS, [(None, None, None, None, None)])
    out = {r.rule: (r.observed, r.decision) for r in dec.decision_rules(calibration, extras, budget=600.0).collect()}
    assert out["D1:gdpval"] == ("no B1 runs", "not evaluable") and out["D3:hle"] == ("missing A/A data", "not evaluable")
    assert out["D4"] == ("primary_clusters=2 budget=600.0", "not evaluable: owner_budget_usd not set")
    assert out["D6"] == ("no judge calibration", "not evaluable") and out["D5:hle"] == ("no held-out A/A", "not evaluable")


def test_lines_and_hunks(rows):
    spans = rows("file string, component string, kind string, start_line int, end_line int", [
        ("a.py", "outer", "class", 1, 400), ("a.py", "inner", "function", 100, 120), ("a.py", "twin", "function", 110, 130), ("b.py", "whole", "file", 1, 50)])
    owners = rows("file string, component string", [("a.py", "outer"), ("b.py", "whole"), ("c.md", "docs"), ("c.md", "more")])
    lines = rows("file string, line int", [("a.py", 5), ("a.py", 105), ("a.py", 115), ("a.py", 900), ("b.py", 7), ("c.md", 1), ("d.txt", 1)])
    out = {(r.file, r.line): (r.components, r.exact) for r in spn.locate_lines(lines, spans, owners).collect()}
    assert out == {("a.py", 5): (["outer"], True), ("a.py", 105): (["inner"], True), ("a.py", 115): (["inner", "twin"], True),
                   ("a.py", 900): (["outer"], False), ("b.py", 7): (["whole"], True), ("c.md", 1): (["docs", "more"], False)}
    hunks = rows("hunk_id int, file string, status string, old_start int, old_lines int", [
        (1, "a.py", "modified", 99, 3), (2, "a.py", "modified", 399, 4), (3, "c.md", "created", 0, 0), (4, "d.txt", "modified", 1, 1), (5, "b.py", "modified", 3, 0)])
    got = {r.hunk_id: (r.components, r.exact) for r in spn.hunks_to_components(hunks, spans, owners).collect()}
    assert got == {1: (["inner", "outer"], True), 2: (["outer"], False), 3: (["docs", "more"], False), 4: ([], False), 5: (["whole"], True)}
