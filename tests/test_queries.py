"""Every query of the catalog against its SQL statement, over the smallest tables."""

import pytest

import __spark_entry__ as entry
from check_oracle import compare
from prefmill.plans import catalog

SF = "/root/testdata/sf0.001"
SQL = entry.oracle_sql()


def test_every_query_has_a_statement():
    assert set(catalog.QUERIES) <= set(SQL) <= set(entry.queries())


@pytest.mark.parametrize("name", sorted(catalog.QUERIES))
def test_query_matches_sql(spark, name):
    assert compare(spark, SF, name, SQL[name]).startswith("ok")


def test_entry(spark):
    df = entry.entry(spark)
    assert df.columns == ["instance_id", "pair_idx", "prompt", "chosen", "rejected"]
    assert df.count() > 0


@pytest.mark.parametrize("name", sorted(catalog.QUERIES))
def test_no_cartesian_product(spark, name):
    plan = entry.queries()[name](spark, SF)._jdf.queryExecution().executedPlan().toString()
    assert "CartesianProduct" not in plan and "NestedLoopJoin" not in plan
