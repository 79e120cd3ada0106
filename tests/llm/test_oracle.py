"""Queries with reference SQL give its rows."""

import compare
import data
import pytest
from layerscan.llm.queries import ORACLE, QUERIES


@pytest.mark.parametrize("name", ORACLE)
def test_query_equals_sql(spark, name):
    assert compare.differences(QUERIES[name](spark, data.SMALL), compare.duck(data.SMALL), ORACLE[name]) is None
