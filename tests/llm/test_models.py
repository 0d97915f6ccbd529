"""Trained operators: held-out accuracy, exact inference and gradients, exact round trips."""

import itertools
import random
from collections import Counter

import numpy as np
import pytest
from pyspark.sql import functions as F

import corpus_pipeline
from runlens.llm import mixing, near_copies, pii, quality_mil, quality_rules, queries, toxicity
from runlens.llm.words import Words, repeated_words
from tests.llm.tables import FOLDER, edge, labels

WIDER = FOLDER.replace("sf0.001", "sf0.01")


def judged(spark, name, column):
    known = spark.read.parquet(f"{WIDER}/labels.parquet")
    return queries.queries()[name](spark, WIDER).join(known, "doc_id").toPandas().rename(columns={column: "truth"})


@pytest.mark.parametrize("name, column, least", [("op4_attention_mil_quality", "quality", 0.9), ("op6_crf_toxicity", "toxic", 0.85)])
def test_held_out_accuracy(spark, name, column, least):
    got = judged(spark, name, column)
    held = got[got.held_out]
    assert len(held) > 30 and held.score.between(0, 1).all()
    for kind in (0, 1):
        assert (held[held.truth == kind].predicted == kind).mean() >= least


def test_mil_gradients_are_those_of_the_loss():
    rng = np.random.default_rng(0)
    x, first, y = rng.normal(size=(9, 4)), np.array([0, 2, 7]), np.array([1.0, 0.0, 1.0])
    shape = {"w": (4, 3), "b": (3,), "v": (3, 2), "u": (3, 2), "a": (2,), "c": (3,), "d": (1,)}
    model = quality_mil.Model({k: rng.normal(size=s) for k, s in shape.items()}, np.zeros(4), np.ones(4))

    def loss():
        z = model.forward(x, first)["logit"]
        return float((np.log1p(np.exp(z)) - y * z).sum())

    f = model.forward(x, first)
    assert np.allclose(np.add.reduceat(f["weight"], first), 1)
    grads = model.backward(f, first, quality_mil.sigmoid(f["logit"]) - y)
    for k, g in grads.items():
        for at in np.ndindex(model.p[k].shape):
            model.p[k][at] += 1e-6
            up = loss()
            model.p[k][at] -= 2e-6
            slope = (up - loss()) / 2e-6
            model.p[k][at] += 1e-6
            assert abs(slope - g[at]) < 1e-4


@pytest.mark.parametrize("segment", [2, 3, 32])
def test_crf_marginals_equal_enumeration(monkeypatch, segment):
    monkeypatch.setattr(toxicity, "SEGMENT", segment)
    rng = np.random.default_rng(1)
    words = Words(["a b c d e f g", "h", "", "i j k l m n o p"])
    energy, trans = rng.normal(size=16), rng.normal(size=(2, 2))
    prob, joint, logs = toxicity.marginals(energy, trans, *toxicity.segments(words), pairs=True)
    want, pairs, partition = [], np.zeros((2, 2)), 0.0
    for part in (energy[:7], energy[7:8], energy[8:]):
        weight, share, both = 0.0, np.zeros(len(part)), np.zeros((2, 2))
        for state in itertools.product((0, 1), repeat=len(part)):
            v = np.exp(np.dot(part, state) + sum(trans[a, b] for a, b in zip(state, state[1:])))
            weight, share = weight + v, share + v * np.array(state)
            for a, b in zip(state, state[1:]):
                both[a, b] += v
        want.append(share / weight)
        pairs += both / weight
        partition += np.log(weight)
    assert np.allclose(prob, np.concatenate(want)) and np.allclose(joint, pairs)
    if segment == 32:
        assert np.isclose(logs.sum(), partition)


def test_scores_against_one_document_at_a_time(spark):
    """The scored table against a plain forward pass over the passages of each text."""
    docs = spark.read.parquet(f"{FOLDER}/documents.parquet").unionByName(edge(spark).select("doc_id", "text", "lang", "source", "n_chars"))
    model = quality_mil.train(docs, spark.read.parquet(f"{WIDER}/labels.parquet"), "quality")
    p = model.p
    got = Counter((r["doc_id"], round(r["score"], 9), r["passages"], r["attention_top"]) for r in quality_mil.score(docs, model).collect())
    want = Counter()
    for r in docs.select("doc_id", "text").collect():
        hidden, gates = [], []
        for row in quality_mil.Passages([r["text"] or ""]).x:
            h = np.tanh(((row - model.mean) / model.scale) @ p["w"] + p["b"])
            hidden.append(h)
            gates.append(float((np.tanh(h @ p["v"]) / (1 + np.exp(-(h @ p["u"])))) @ p["a"]))
        attention = np.exp(np.array(gates) - max(gates))
        attention /= attention.sum()
        logit = sum(a * h for a, h in zip(attention, hidden)) @ p["c"] + p["d"][0]
        want[r["doc_id"], round(float(1 / (1 + np.exp(-logit))), 9), len(hidden), int(attention.argmax())] += 1
    strangers = sum(((got - want) + (want - got)).values())
    assert sum(got.values()) == sum(want.values()) and strangers <= 4


def test_rare_toxic_words_beside_a_frequent_one(spark):
    """One word in 400 documents, another in 30: neither frequency nor number cuts the second off."""
    rng = random.Random(1)
    vocabulary = ["".join(rng.choice("abdeginorstu") for _ in range(rng.randint(2, 8))) for _ in range(400)]

    def text(extra=None):
        words = [rng.choice(vocabulary) for _ in range(rng.randint(30, 160))]
        return " ".join([*words[:9], *([extra] if extra else []), *words[9:]])

    rows = [(text("vilewordx"), 1) for _ in range(400)] + [(text("grimthingz"), 1) for _ in range(30)] + [(text(), 0) for _ in range(570)]
    docs = spark.createDataFrame([(i, t) for i, (t, _) in enumerate(rows)], "doc_id long, text string")
    known = spark.createDataFrame([(i, label) for i, (_, label) in enumerate(rows)], "doc_id long, toxic int")
    field = toxicity.train(docs, known)
    new = [text("vilewordx") for _ in range(20)] + [text("grimthingz") for _ in range(20)] + [text() for _ in range(100)]
    scored = toxicity.score(spark.createDataFrame([*enumerate(new)], "doc_id long, text string"), field).collect()
    hits = {r["doc_id"] for r in scored if r["score"] >= 0.5}
    assert len(hits & set(range(20))) >= 18 and len(hits & set(range(20, 40))) >= 18 and len(hits - set(range(40))) <= 2


def test_units_by_significance_alone(spark):
    """A word in every toxic document and few others, beside one as rare as chance allows."""
    rng = random.Random(2)
    texts = [(f"{'awful' if i % 2 else 'other'} " + " ".join(rng.choice("abcdefgh") + rng.choice("abcdefgh") for _ in range(20)), i % 2) for i in range(200)]
    texts[1] = (texts[1][0] + " onlyonce", 1)
    sample = spark.createDataFrame([(i, label, t) for i, (t, label) in enumerate(texts)], "doc_id long, label int, text string")
    found = set(toxicity.toxic_units(sample).tolist())
    words = toxicity.Words(["awful onlyonce other"])
    awful, once, other = toxicity.units(words)[:, 0].tolist()
    assert awful in found and once not in found and other not in found
    assert len(toxicity.toxic_units(sample.where("label = 1"))) == 0 and len(toxicity.toxic_units(sample.limit(0))) == 0


def test_open_tokens_follow_neither_label():
    """The gradient of a chain without known labels is zero; held tokens count like labels."""
    rng = np.random.default_rng(4)
    cells = rng.integers(0, 64, (96, len(toxicity.KINDS))).astype(np.uint32)
    gold = np.full(96, -1, dtype=np.int8)
    gold[:32] = rng.integers(0, 2, 32)
    with_open = toxicity.fit_field(cells, gold, np.array([32, 32, 32]), bits=6, epochs=3)
    alone = toxicity.fit_field(cells[:32], gold[:32], np.array([32]), bits=6, epochs=3)
    assert np.corrcoef(with_open.weights, alone.weights)[0, 1] > 0.9


def test_the_chains_reach_the_driver_in_pieces(spark, monkeypatch):
    kind, whole, parts = type(spark.range(0)), [], []
    to_arrow, pieces = kind.toArrow, getattr(toxicity, "pieces", None)
    monkeypatch.setattr(kind, "toArrow", lambda self: (whole.append(t := to_arrow(self)), t)[1])

    def counted(df):
        for piece in pieces(df, 16):
            parts.append(len(piece))
            yield piece

    monkeypatch.setattr(toxicity, "pieces", counted, raising=False)
    docs = spark.read.parquet(f"{WIDER}/documents.parquet")
    toxicity.train(docs, spark.read.parquet(f"{WIDER}/labels.parquet"))
    assert whole and not any({"cells", "gold"} & set(t.column_names) for t in whole)
    assert len(parts) > 10 and max(parts) <= 16


def test_toxic_spans_point_at_the_words(spark):
    docs = spark.read.parquet(f"{WIDER}/documents.parquet")
    field = toxicity.train(docs, spark.read.parquet(f"{WIDER}/labels.parquet"))
    text = "Nothing here but one idiot, and a MORON!! at the énd \U0001f600 stupid"
    row = toxicity.score(spark.createDataFrame([(1, text)], "doc_id long, text string"), field).first()
    assert [text[s["start"]:s["end"]] for s in row["spans"]] == [s["text"] for s in row["spans"]]
    assert {"idiot,", "MORON!!", "stupid"} <= {s["text"] for s in row["spans"]} and row["score"] > 0.5


def test_repeated_words_by_hand():
    texts = ["a b c a b c d", "x y z", "q q q q", "", "a b c"]
    marked = repeated_words(Words(texts))
    assert marked.tolist() == [True] * 6 + [False] + [False] * 3 + [True] * 4 + [False] * 3


def test_rules_follow_the_definitions(spark):
    rows = {r["doc_id"]: r for r in quality_rules.score(edge(spark).where("doc_id <> 5"), edge(spark).limit(0)).collect()}
    assert (rows[10]["n_words"], rows[10]["n_dup_lines"], rows[10]["n_symbols"]) == (9, 2, 4)
    assert rows[3]["n_words"] == 0 and rows[3]["base_failed"] and not rows[3]["kept"]
    assert rows[8]["n_repeat_words"] == 40 and rows[8]["base_failed"]
    assert rows[7]["word_chars"] == 15


@pytest.mark.parametrize("bits", [8, 16])
def test_the_filter_of_trusted_ids_misses_none(spark, bits):
    rng = np.random.default_rng(3)
    ids = [0, -1, 2**63 - 1, -(2**63), *map(int, rng.integers(-(2**62), 2**62, 300))]
    kept = spark.createDataFrame([(i,) for i in ids] * 2, "doc_id long")
    made = quality_rules.bloom_filter(kept, "doc_id", bits)
    assert len(made) == 2**bits // 8
    assert kept.where(quality_rules.may_contain(spark, F.col("doc_id"), made)).count() == 2 * len(ids)
    strangers = spark.range(5000).where(quality_rules.may_contain(spark, F.col("id"), made)).count()
    assert strangers < (5001 if bits == 8 else 50)
    nothing = quality_rules.bloom_filter(kept.limit(0), "doc_id", bits)
    assert kept.where(quality_rules.may_contain(spark, F.col("doc_id"), nothing)).count() == 0


def test_rates_meet_the_targets(spark):
    rng = np.random.default_rng(0)
    units = [rng.multinomial(mixing.GRID, rng.dirichlet([2, 1, 0.5])).tolist() for _ in range(500)]
    rows = spark.createDataFrame([(i, int(t), u) for i, (t, u) in enumerate(zip(rng.integers(0, 900, 500), units))],
                                 "doc_id long, n_tokens long, units array<long>")
    targets = {"a": 0.45, "b": 0.33, "c": 0.22}
    mixture = mixing.solve(rows, targets)
    got = rows.withColumn("rate", mixture.rate(F.col("units"))).toPandas()
    shares = np.array(got.units.tolist()) / mixing.GRID
    reached = (shares * (got.n_tokens * got.rate).to_numpy()[:, None]).sum(axis=0) / got.n_tokens.sum()
    assert np.abs(reached - list(targets.values())).max() < 0.01 and got.rate.between(0, mixing.MOST_COPIES).all()
    r = np.ones(500)
    for d in mixture.directions():  # the same steps in numpy
        r = np.clip(r - (shares @ d + mixture.pull * (r - 1)) / (1 + mixture.pull), 0, mixing.MOST_COPIES)
    assert np.abs(r - got.rate).max() < 1e-9


def test_an_unreachable_target_stays_bounded(spark):
    rows = spark.createDataFrame([(i, 100, [256, 0]) for i in range(50)] + [(99, 1, [0, 256])], "doc_id long, n_tokens long, units array<long>")
    with pytest.warns(UserWarning, match="not reached"):
        mixture = mixing.solve(rows, {"a": 0.1, "b": 0.9}, most=4.0)
    got = rows.withColumn("rate", mixture.rate(F.col("units"))).toPandas()
    assert got.rate.between(0, 4).all() and got.rate.iloc[-1] > 3.9


@pytest.mark.parametrize("rare, goal", [([0, 256], 0.07), ([0, 256], 0.5), ([20, 236], 0.3)])
def test_rare_domains_reach_their_targets(spark, rare, goal):
    rows = spark.createDataFrame([(i, 100, [256, 0] if i % 100 else rare) for i in range(1000)],
                                 "doc_id long, n_tokens long, units array<long>")
    mixture = mixing.solve(rows, {"a": 1 - goal, "b": goal})
    got = rows.selectExpr("n_tokens", "units", "units[1] / 256 AS b").withColumn("rate", mixture.rate(F.col("units")))
    sums = got.selectExpr("sum(n_tokens * rate * b)", "sum(n_tokens * rate)", "sum(n_tokens)").first()
    assert mixture.reached and abs(sums[0] / sums[2] - goal) < 1e-3 and abs(sums[1] / sums[2] - 1) < 1e-3


def test_an_impossible_target_is_reported(spark):
    rows = spark.createDataFrame([(i, 100, [250, 6] if i % 10 else [56, 200]) for i in range(100)], "doc_id long, n_tokens long, units array<long>")
    with pytest.warns(UserWarning, match="not reached"):
        mixture = mixing.solve(rows, {"a": 0.05, "b": 0.95})
    assert not mixture.reached and mixture.most == mixing.MOST_COPIES and mixture.residual > 0.1
    units = rows.select("doc_id", "n_tokens", "units")
    assert (units.withColumn("rate", mixture.rate(F.col("units"))).toPandas().rate <= mixing.MOST_COPIES).all()


def test_tokens_are_those_of_packing(spark):
    from runlens.llm import packing, tokens

    docs = spark.createDataFrame([(1, "x" * 3000), (2, "日本語" * 400), (3, ""), (4, "two words")], "doc_id long, text string")
    rated, _, _ = mixing.mix(docs, queries.label_domains(labels(spark, [])), queries.TARGETS)
    want = {r["doc_id"]: r["doc_tokens"] - 1 for r in packing.pack(docs, tokens.public_path("byte_bpe_50k.json")).collect()}  # without the end mark
    assert {r["doc_id"]: r["n_tokens"] for r in rated.collect()} == want and want[1] > 100


def test_domains_are_learned(spark):
    docs = spark.read.parquet(f"{WIDER}/documents.parquet")
    known = queries.label_domains(spark.read.parquet(f"{WIDER}/labels.parquet"))
    rated, mixture, _ = mixing.mix(docs, known, queries.TARGETS)
    got = rated.join(known, "doc_id").toPandas()
    best = np.array(list(queries.TARGETS))[np.array(got.units.tolist()).argmax(axis=1)]
    assert (best == got.domain).mean() > 0.9
    whole = rated.agg(F.sum(F.col("rate") * F.col("n_tokens")), F.sum(F.col("copies") * F.col("n_tokens")), F.sum("n_tokens")).first()
    assert abs(whole[0] / whole[2] - 1) < 0.02 and abs(whole[1] / whole[2] - 1) < 0.1


def test_pipeline_stages_take_effect(spark):
    docs = spark.read.parquet(f"{WIDER}/documents.parquet")
    known = spark.read.parquet(f"{WIDER}/labels.parquet")
    stages, seen = dict(corpus_pipeline.STAGES), docs
    for name in ("toxicity", "near_dedup", "pii", "mixing"):
        before, seen = seen, stages[name](spark, seen, WIDER).cache()
        assert seen.columns == docs.columns and seen.dtypes == docs.dtypes
        ids = lambda df: {r["doc_id"] for r in df.select("doc_id").collect()}
        gone = ids(before) - ids(seen)
        if name == "toxicity":
            scores = toxicity.score(before, toxicity.train(before, known.where(queries.bucket_of(F.col("doc_id"), 5) != 0)))
            assert gone == {r["doc_id"] for r in scores.where("score >= 0.5").collect()} and gone
        elif name == "near_dedup":
            assert ids(near_copies.one_of_each_group(before)) == ids(seen) and gone
        elif name == "pii":
            texts = {r["doc_id"]: r["text"] for r in before.collect()}
            for r in seen.collect():
                assert r["text"] == pii.replaced(texts[r["doc_id"]], pii.DEMONSTRATION_KEY)[0] and r["n_chars"] == len(r["text"])
            assert not gone
        else:
            plan, _, _ = mixing.mix(before, queries.label_domains(known), corpus_pipeline.TARGETS)
            want = {r["doc_id"]: r["copies"] for r in plan.collect() if r["copies"]}
            assert want == {r["doc_id"]: r["count"] for r in seen.groupBy("doc_id").count().collect()}
    packed = stages["packing"](spark, seen, WIDER)
    assert packed.where("start = 0").count() == seen.count()


def test_labels_with_nulls_and_conflicts(spark):
    docs = edge(spark)
    known = labels(spark, [(5, 1, 0, ""), (5, 0, 1, ""), (None, 1, 1, ""), (4, None, None, ""), (8, 0, 1, ""), (7, 1, 0, "")])
    assert quality_mil.score(docs, quality_mil.train(docs, known, "quality")).count() == docs.count()
    assert toxicity.score(docs, toxicity.train(docs, known)).count() == docs.count()
