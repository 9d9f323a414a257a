"""Every query that has SQL gives the rows of its SQL."""

import os

import pytest

from millrace.plans import details, rules, stores  # noqa: F401  (register their queries)
from millrace.plans.registry import ORACLES, QUERIES

from .compare import connect, same

SF = os.environ.get("TEST_SF_DIR", "/root/testdata/sf0.001")


@pytest.fixture(scope="module")
def con():
    return connect(SF)


@pytest.mark.parametrize("name", sorted(ORACLES))
def test_rows_match_sql(spark, con, name):
    assert same(QUERIES[name](spark, SF), con, ORACLES[name]) == ""


@pytest.mark.parametrize("name", sorted(set(QUERIES) - set(ORACLES)))
def test_runs(spark, name):
    assert QUERIES[name](spark, SF).count() > 0
