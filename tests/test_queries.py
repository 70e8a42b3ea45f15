"""Every registered query against its oracle on the smallest tables."""

import os

import pytest

import __spark_entry__ as entry
from checks.compare import difference, oracle

SF = "/root/testdata/sf0.001"

if not os.path.isdir(SF):
    pytest.skip("no test tables", allow_module_level=True)


@pytest.fixture(scope="module")
def db():
    return oracle(SF)


# Those of the training-data operators have tests of their own.
@pytest.mark.parametrize("name", sorted(set(entry.queries()) - set(entry.LLM_QUERIES)))
def test_query(spark, db, name):
    build, sql = entry.queries()[name], entry.oracle_sql().get(name)
    if sql is None:
        assert build(spark, SF).count() > 0
    else:
        assert difference(spark, db, build, sql, SF) is None


def test_entry(spark):
    assert entry.entry(spark).columns == ["org_id", "eval", "frd", "rows"]
