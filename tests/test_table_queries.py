"""Every registered query against its SQL twin on the test tables.

Broadcasting is switched off, so the results are those of the shuffle joins that
large tables get, and every plan is checked for shapes that do not scale.
"""

import os

import pytest

import oracle
from folium.table_queries import ORACLE, QUERIES

FOLDER = os.environ.get("TEST_SF_DIR", "/root/testdata/sf0.001")


@pytest.fixture(scope="module")
def con():
    return oracle.connect(FOLDER)


def test_every_query_has_a_twin():
    assert set(QUERIES) == set(ORACLE)


@pytest.fixture(scope="module")
def shuffling(spark):
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    spark.conf.set("spark.sql.adaptive.autoBroadcastJoinThreshold", "-1")
    yield spark
    spark.conf.unset("spark.sql.autoBroadcastJoinThreshold")
    spark.conf.unset("spark.sql.adaptive.autoBroadcastJoinThreshold")


@pytest.mark.parametrize("name", sorted(QUERIES))
def test_query_equals_sql(shuffling, con, name):
    df = QUERIES[name](shuffling, FOLDER)
    plan = df._jdf.queryExecution().executedPlan().toString()
    for shape in ("CartesianProduct", "BroadcastNestedLoopJoin", "Python", "Pandas"):
        assert shape not in plan
    assert oracle.compare(df, con, ORACLE[name]) is None


def test_entry_points(spark):
    import __spark_entry__ as entry

    assert entry.entry(spark).count() > 0
    assert QUERIES.keys() <= entry.queries().keys() and ORACLE.keys() <= entry.oracle_sql().keys()
    assert entry.oracle_sql().keys() <= entry.queries().keys()
