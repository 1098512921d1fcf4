"""Every query of the subpackage: equal to its SQL twin where there is one."""

import pytest

import oracle
from folium.llm.queries import ORACLE, QUERIES

FOLDER = "/root/testdata/sf0.001"


@pytest.mark.parametrize("name", sorted(ORACLE))
def test_query_equals_sql(spark, name):
    assert oracle.compare(QUERIES[name](spark, FOLDER), oracle.connect(FOLDER), ORACLE[name]) is None


@pytest.mark.parametrize("name", ["op1_url_filter", "op4_quality_rules", "op6_chat_formatting"])
def test_native_plans_run_no_python(spark, name):
    plan = QUERIES[name](spark, FOLDER)._jdf.queryExecution().executedPlan().toString()
    for shape in ("Python", "Pandas", "Arrow", "CartesianProduct", "NestedLoop"):
        assert shape not in plan


def test_entry_lists_the_queries():
    import __spark_entry__ as entry

    assert set(QUERIES) <= set(entry.queries()) and "pipeline" in entry.queries()
    assert sorted(int(n[2:].split("_")[0]) for n in QUERIES) == list(range(1, 14))
    assert set(entry.oracle_sql()) <= set(entry.queries())


@pytest.mark.parametrize("name", sorted(QUERIES))
def test_empty_tables(spark, tmp_path, name):
    for table in ("documents", "labels", "pages", "benchmark", "conversations", "embeddings"):
        spark.read.parquet(f"{FOLDER}/{table}.parquet").limit(0).write.parquet(f"{tmp_path}/{table}.parquet")
    rows = QUERIES[name](spark, str(tmp_path)).collect()
    assert [r["conv_id"] for r in rows] == ([-7] if name.startswith("op6") else [])
