"""Defined results of every operator for nulls, empty and long texts, repeats, empty tables, clashing columns."""

import pytest

from runlens.llm import mixing, near_copies, packing, pii, quality_mil, quality_rules, sharding, simhash, token_files, tokens, toxicity
from tests.llm.tables import EDGE_TEXTS, edge, empty, labels

N = len(EDGE_TEXTS)
LABELS = [(1, 1, 0, "x"), (4, 1, 0, "x"), (5, 0, 0, "x"), (5, 1, 0, "x"), (8, 0, 1, "x"), (9, None, None, "x"), (None, 1, 1, "x")]
TARGETS = {"good": 0.8, "toxic": 0.2}


def domains(frame):
    return frame.selectExpr("doc_id", "CASE WHEN toxic = 1 THEN 'toxic' WHEN quality = 1 THEN 'good' END AS domain")


OPERATORS = {
    "rules": lambda d, l: quality_rules.score(d, l.where("quality = 1")),
    "packing": lambda d, l: packing.pack(d, tokens.public_path("byte_bpe_50k.json")),
    "mil": lambda d, l: quality_mil.score(d, quality_mil.train(d, l, "quality")),
    "pii": lambda d, l: pii.pseudonymise(d, report="found"),
    "toxicity": lambda d, l: toxicity.score(d, toxicity.train(d, l)),
    "sharding": lambda d, l: sharding.interleave(d),
    "token_files": lambda d, l: token_files.round_trip(d, tokens.public_path("word_bpe_49k.json"), 2),
    "simhash": lambda d, l: simhash.near_duplicates(d),
    "mixing": lambda d, l: mixing.mix(d, domains(l), TARGETS)[0],
}


@pytest.mark.parametrize("name", OPERATORS)
def test_every_row_has_its_result(spark, name):
    out = OPERATORS[name](edge(spark), labels(spark, LABELS)).toPandas()
    if name == "packing":
        assert out[out.start == 0].shape[0] == N
        assert out.groupby("sequence_id").length.sum().max() <= packing.WINDOW
    else:
        assert len(out) == N
    assert out.doc_id.isna().sum() == 2
    for column in {"score", "rate"} & set(out.columns) if name != "pii" else ():
        assert out[column].between(0, mixing.MOST_COPIES).all()


@pytest.mark.parametrize("name", OPERATORS)
def test_empty_tables(spark, name):
    assert OPERATORS[name](empty(spark), labels(spark, LABELS)).count() == 0
    assert OPERATORS[name](empty(spark), labels(spark, [])).count() == 0


@pytest.mark.parametrize("name", ["rules", "mil", "toxicity", "mixing"])
def test_without_labels(spark, name):
    assert OPERATORS[name](edge(spark), labels(spark, [])).count() == N


def test_one_row_of_each_group(spark):
    """Empty tables, null ids, repeated rows, unrelated texts of one id, other columns."""
    assert near_copies.one_of_each_group(empty(spark)).count() == 0
    out = near_copies.one_of_each_group(edge(spark)).collect()
    assert sorted((r["doc_id"] is None, r["doc_id"] or 0, r["text"]) for r in out if r["text"] not in (None, "")) == sorted(
        (d is None, d or 0, t) for d, t in {(d, t) for d, t in EDGE_TEXTS} if t and t.split() and (d, t) != (6, "same text here"))
    assert [r["doc_id"] for r in out if not (r["text"] or "").split()] == [1]  # texts without words are one group


def test_filters_carry_all_columns(spark):
    docs, known = edge(spark), labels(spark, LABELS)
    for out in (toxicity.without_toxic(docs, toxicity.train(docs, known)), near_copies.one_of_each_group(docs), pii.pseudonymise(docs),
                mixing.apply(docs, domains(known), TARGETS)):
        assert out.schema.names == docs.columns
        assert {f.dataType.simpleString() for f in out.schema} == {f.dataType.simpleString() for f in docs.schema}
        out.count()
