"""Every registered query against its SQL twin."""

import os

import pytest

import __spark_entry__ as entry
from keyclock.plans import catalog
from tests.compare import compare, connect


#: too few rows are late at sf0.001 to tell anything
SPARSE = {"interval_join_late_left", "interval_join_late_right"}


@pytest.fixture(scope="module")
def con(sf_dir):
    return connect(sf_dir)


def test_every_query_has_sql():
    own = {q for q in entry.queries() if not q.startswith("op") and q != "pipeline"}
    assert own <= set(entry.oracle_sql())
    assert set(entry.oracle_sql()) <= set(entry.queries())


def test_entry(spark):
    df = entry.entry(spark)
    assert df.columns == ["W_S", "Watermark", "W_K", "W_E", "Elements"]
    assert df.count() > 0


@pytest.mark.parametrize("name", sorted(catalog.QUERIES))
def test_query_equals_sql(spark, sf_dir, con, name):
    if name in SPARSE:
        sf_dir = os.path.join(os.path.dirname(sf_dir), "sf0.01")
        con = connect(sf_dir)
    assert compare(spark, sf_dir, con, name, catalog.QUERIES[name], catalog.ORACLE[name]) is None
