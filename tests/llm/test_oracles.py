"""Registered corpus queries give the rows of their SQL; the others give a row a document."""

import pytest

from millrace.llm.registry import ORACLES, QUERIES

from ..compare import connect, same
from .edge import SF


@pytest.mark.parametrize("name", sorted(set(ORACLES) - {"op4_passages", "op9_chat", "op11_ranked"}))
def test_rows_match_sql(spark, name):
    assert same(QUERIES[name](spark, SF), connect(SF), ORACLES[name]) == ""


@pytest.mark.parametrize("name", sorted(set(QUERIES) - set(ORACLES) - {"op12_forest", "op13_alignment"}))
def test_one_row_a_document(spark, name):
    assert QUERIES[name](spark, SF).count() == 200
