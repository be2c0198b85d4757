"""Every registered query beside its SQL, on the smallest tables."""

import os

import pytest

import __spark_entry__ as entry
from compare import check, duck

SF = "/root/testdata/sf0.001"
QUERIES, ORACLE = entry.queries(), entry.oracle_sql()


@pytest.fixture(scope="module")
def con():
    return duck(SF)


def test_sql_belongs_to_queries():
    assert set(ORACLE) <= set(QUERIES)


@pytest.mark.skipif(not os.path.isdir(SF), reason="test tables are not here")
@pytest.mark.parametrize("name", list(QUERIES))
def test_query(spark, con, name):
    result = check(name, QUERIES[name], ORACLE.get(name), spark, con, SF)
    assert result.startswith(("ok", "rows")), result


def test_flagship(spark):
    rows = entry.entry(spark).collect()
    assert rows and rows[0].priority == max(r.priority for r in rows)
