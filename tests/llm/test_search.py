"""Exact search against all pairs, and the given queries against their SQL."""

from fractions import Fraction

import pytest

import __spark_entry__ as entry_module
from runlens.llm import queries, topk
from tests.compare import diff, duck
from tests.llm.tables import FOLDER


@pytest.fixture(scope="module")
def con():
    return duck(FOLDER)


@pytest.mark.parametrize("name", sorted(queries.oracles()))
def test_query_matches_sql(spark, con, name):
    error, count = diff(queries.queries()[name](spark, FOLDER), con, queries.oracles()[name])
    assert error is None, error
    assert count > 0


def test_all_are_registered():
    names = entry_module.queries()
    assert "pipeline" in names
    assert all(sum(n.startswith(f"op{k}_") for n in names) == 1 for k in range(1, 14))


def brute_force(rows, queries_, k):
    """Every row against every other one, in whole numbers."""
    good = [(i, [Fraction(256 * Fraction(x)).__floor__() for x in v]) for i, v in rows
            if i is not None and v is not None and all(x is not None and abs(x) != float("inf") and x == x for x in v)]
    out = []
    for at, (q, qv) in enumerate(good):
        if q in queries_:
            found = sorted((-sum(a * b for a, b in zip(qv, cv)), c) for other, (c, cv) in enumerate(good) if other != at)[:k]
            out += [(q, r, c, max(-(2**63), min(2**63 - 1, -s))) for r, (s, c) in enumerate(found, 1)]
    return sorted(out)


def search(spark, rows, queries_, k, **sizes):
    df = spark.createDataFrame([(i, v, 1, "x") for i, v in rows], "vec_id long, embedding array<double>, id int, score string")
    got = topk.top_k(df.where(df.vec_id.isin(*queries_)), df, k, **sizes)
    return sorted(tuple(r) for r in got.collect())


@pytest.mark.parametrize("sizes", [(2048, 8192), (3, 4)])
def test_topk_ties_nulls_and_blocks(spark, sizes):
    rows = [(i, [float((i * 7 + j * 3) % 5 - 2) / 4 for j in range(6)]) for i in range(40)]
    rows += [(100 + i, [0.25] * 6) for i in range(12)]  # ties
    rows += [(0, rows[0][1]), (0, rows[1][1]), (7, rows[7][1]), (7, rows[7][1]), (20, [x + 0.001 for x in rows[20][1]])]  # repeated rows and ids
    rows += [(200, None), (201, [None] * 6), (202, [float("nan")] * 6), (203, [float("inf")] * 6), (None, [1.0] * 6), (204, [0.0] * 6),
             (205, []), (206, [0.25, -0.5])]
    asked = {0, 20, 100, 200, 205}
    assert search(spark, rows, asked, 5, query_block=sizes[0], candidate_block=sizes[1]) == brute_force(rows, asked, 5)


@pytest.mark.parametrize("block", [8192, 2])
def test_topk_large_components_are_candidates(spark, block):
    rows = [(1, [1.0, 2.0]), (2, [1e9, 1.0]), (3, [-1e9, 4.0]), (4, [1e300, -1e300]), (5, [2.0**62, 2.0**61]), (6, [-(2.0**70), 0.0]),
            (7, [1.7e308, 1.7e308]), (8, [-1.7e308, 1.0]), (9, [3.0, 3.0]), (10, [1e-300, -1e-300])]
    asked = set(range(1, 11))
    got = search(spark, rows, asked, 4, query_block=block, candidate_block=block)
    assert got == brute_force(rows, asked, 4)
    assert (1, 2, 4, -(2**63)) not in got and [r for r in search(spark, rows[:2], {1}, 5)] == [(1, 1, 2, 256 * 256 * 10**9 + 256 * 512)]


def test_topk_few_candidates_and_empty_tables(spark):
    one = spark.createDataFrame([(0, [1.0, 2.0]), (1, [1.0])], "vec_id long, embedding array<double>")
    assert [tuple(r) for r in topk.top_k(one.where("vec_id = 0"), one, 5).collect()] == [(0, 1, 1, 65536)]
    none = one.where("vec_id = 9")
    assert topk.top_k(none, one, 5).count() == 0 and topk.top_k(one, none, 5).count() == 0
