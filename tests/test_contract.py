"""Every registered query against its SQL twin, at the smallest scale factor."""

import check
import pytest

import __spark_entry__ as entry
from fleetlens.plans.registry import load_all

FOLDER = "/root/testdata/sf0.001"
OWN = set(load_all())
QUERIES = {name: build for name, build in entry.queries().items() if name in OWN}
SQLS = {name: sql for name, sql in entry.oracle_sql().items() if name in OWN}


@pytest.fixture(scope="module")
def con():
    return check.connect(FOLDER)


def test_every_query_has_a_twin():
    assert set(SQLS) == set(QUERIES)


@pytest.mark.parametrize("name", list(QUERIES))
def test_matches_sql(spark, con, name):
    names, rows = check.spark_rows(QUERIES[name](spark, FOLDER))
    assert (names, rows) == check.oracle(con, SQLS[name])


def test_flagship(spark):
    assert entry.entry(spark).count() > 0
