"""Every registered query against its SQL on the smallest tables."""

import os

import pytest

import __spark_entry__ as entry_module
from runlens.plans import catalogue
from tests.compare import diff, duck

FOLDER = os.environ.get("RUNLENS_TEST_DATA", "/root/testdata/sf0.001")
QUERIES, ORACLES = catalogue.queries(), catalogue.oracles()


@pytest.fixture(scope="module")
def con():
    return duck(FOLDER)


def test_every_query_has_its_check():
    assert set(QUERIES) == set(ORACLES)
    assert set(QUERIES) <= set(entry_module.queries()) and set(ORACLES) <= set(entry_module.oracle_sql())


@pytest.mark.parametrize("name", sorted(QUERIES))
def test_query_matches_sql(spark, con, name):
    error, count = diff(QUERIES[name](spark, FOLDER), con, ORACLES[name])
    assert error is None, error
    assert count > 0


def test_entry_is_the_baseline_table(spark):
    out = entry_module.entry(spark)
    assert out.columns == ["source", "run_id", "tasks", "rollouts", "rollout_pass_rate", "pass_hat_k_rate"]
    assert out.count() > 0
