"""Registered queries that have a SQL twin, against it."""

import pytest

from keyclock.llm import queries
from tests.compare import compare, connect


@pytest.mark.parametrize("name", sorted(queries.ORACLE))
def test_query_equals_sql(spark, sf_dir, name):
    assert compare(spark, sf_dir, connect(sf_dir), name, queries.QUERIES[name], queries.ORACLE[name]) is None
