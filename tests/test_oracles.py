"""Every registered query against its SQL on the smallest tables, and its plan."""

import pytest

import __spark_entry__ as spark_entry
import tools_check

SF_DIR = "/root/testdata/sf0.001"
QUERIES = spark_entry.queries()
ORACLE = spark_entry.oracle_sql()


@pytest.fixture(scope="module")
def con():
    return tools_check.connect(SF_DIR)


@pytest.mark.parametrize("name", sorted(QUERIES))
def test_query(spark, con, name):
    df = QUERIES[name](spark, SF_DIR)
    plan = df._jdf.queryExecution().executedPlan().toString()
    assert "CartesianProduct" not in plan and "NestedLoopJoin" not in plan
    got = df.toPandas()
    if name in ORACLE:
        assert tools_check.difference(got, con.execute(ORACLE[name]).df()) == ""
    else:
        assert len(got)


def test_entry(spark):
    assert spark_entry.entry(spark).count() > 0


def test_every_oracle_has_a_query():
    assert set(ORACLE) <= set(QUERIES)
