"""Operators on tables in which one category and one publication hold a third of all rows."""

import random
from collections import Counter, defaultdict

import pytest
from pyspark.sql import functions as F

from folium import columns as c
from folium import table_queries as T
from folium.operators import bridges as B
from folium.operators import facets as X
from folium.operators import profile as P
from folium.operators import summaries as S
from folium.operators import territory as R


@pytest.fixture(scope="module")
def rows():
    rnd = random.Random(11)
    out = []
    for i in range(6000):
        pub = "hot" if i % 3 == 0 else f"p{rnd.randint(0, 400)}"
        category = "Otros" if i % 3 == 1 else f"c{rnd.randint(0, 50)}"
        out.append((f"r{i}", i, pub, category))
    return out


@pytest.fixture(scope="module")
def bridge(spark, rows):
    pairs = sorted({(p, k) for _r, _o, p, k in rows})
    return spark.createDataFrame(pairs, f"{c.PUB} string, {c.CATEGORY} string")


def test_relation_summary(spark, rows, bridge):
    scope = spark.createDataFrame(sorted({(p,) for _r, _o, p, _k in rows if p != "p7"}), f"{c.PUB} string")
    expected = defaultdict(set)
    for _r, _o, p, k in rows:
        if p != "p7":
            expected[k].add(p)
    got = {r[c.CATEGORY]: r[c.COUNT] for r in S.relation_summary(bridge, scope).collect()}
    assert got == {k: len(v) for k, v in expected.items()}
    no_others = {r[c.CATEGORY] for r in S.relation_summary(bridge, scope, include_others=False).collect()}
    assert no_others == set(expected) - {"Otros"}
    ranked = [(-r[c.COUNT], r[c.CATEGORY]) for r in S.relation_summary(bridge, scope).collect()]
    assert ranked == sorted(ranked)


def test_summary_of_an_absent_column_is_empty(spark, bridge):
    assert S.simple_summary(bridge, "nada").count() == 0
    assert S.drilldown_summary(bridge, bridge, None, "nada").count() == 0


@pytest.mark.parametrize("width", [64, 1_000_000])
def test_remap(spark, rows, width):
    records = spark.createDataFrame([(r, o, k) for r, o, _p, k in rows], f"{c.RECORD} string, {c.ORD} long, {c.CATEGORY} string")
    mapping = spark.createDataFrame([(r, p) for r, _o, p, _k in rows], f"{c.RECORD} string, {c.PUB} string")
    expected, seen = {}, defaultdict(int)
    for r, _o, p, k in rows:
        if (p, k) not in expected:
            seen[p] += 1
            expected[p, k] = (r, seen[p])
    got = B.remap_bridge(records, mapping, width=width).collect()
    assert {(r[c.PUB], r[c.CATEGORY]): (r[c.RECORD], r[c.CATEGORY_ORDER]) for r in got} == expected
    assert len(got) == len(expected)


def test_consolidated_column_and_cardinality(spark, rows, bridge):
    categories = defaultdict(set)
    for _r, _o, p, k in rows:
        categories[p].add(k)
    scope = bridge.select(c.PUB).distinct()
    got = {r[c.PUB]: r["x"] for r in B.consolidated_column(bridge, scope, "x").collect()}
    assert got == {p: "; ".join(sorted(v)) for p, v in categories.items()}
    (card,) = P.bridge_cardinality({"d": bridge}).collect()
    sizes = [len(v) for v in categories.values()]
    assert tuple(card)[1:] == (sum(sizes), len(sizes), sum(n > 1 for n in sizes), max(sizes))


def test_bridge_facet_keeps_each_publication_once(spark, rows):
    repeated = spark.createDataFrame([(p, k) for _r, _o, p, k in rows], f"{c.PUB} string, {c.CATEGORY} string")
    pubs = repeated.select(c.PUB).distinct()
    got = [r[0] for r in X.bridge_filter(pubs, repeated, ["Otros", "c1"]).collect()]
    assert len(got) == len(set(got))
    assert set(got) == {p for _r, _o, p, k in rows if k in ("Otros", "c1")}


def test_territory(spark, rows):
    territory = spark.createDataFrame(
        [(r, o, k, k, k != "Otros") for r, o, _p, k in rows],
        f"{c.RECORD} string, {c.ORD} long, {c.DEP_KEY} string, {c.DEP_NAME} string, {c.ON_MAP} boolean",
    )
    mapping = spark.createDataFrame([(r, p) for r, _o, p, _k in rows], f"{c.RECORD} string, {c.PUB} string")
    base = spark.createDataFrame([(k, k, k, k) for k in ("c0", "c1", "Otros", "zz")], f"{c.DEP_ID} string, {c.DEP_NAME} string, {c.DEP_KEY} string, {c.DEP_CAPITAL} string")
    got = {r[c.DEP_KEY]: r["publicaciones_unicas"] for r in R.consolidate_territory(territory, base, mapping)[c.T_MAP].collect()}
    count = lambda key: len({p for _r, _o, p, k in rows if k == key})
    assert got == {"c0": count("c0"), "c1": count("c1"), "Otros": 0, "zz": 0}


def test_bridges_lie_in_slices_by_publication(spark, tmp_path, monkeypatch):
    """With more input than a slice a core, every part holds few publications, whatever the number of cores."""
    lines = [(i % 97 if i % 3 else 0, i % 11, i % 5) for i in range(6000)] + [(None, 1, 1), (5, None, None)] * 2
    tables = {
        "lineitem": (lines, "l_orderkey long, l_partkey long, l_suppkey long"),
        "part": ([(i, f"B{i % 3}", f"T{i % 7}") for i in range(11)] * 2, "p_partkey long, p_brand string, p_type string"),
        "supplier": ([(i, i) for i in range(5)], "s_suppkey long, s_nationkey int"),
        "nation": ([(i, f"N{i}", i % 2) for i in range(5)], "n_nationkey int, n_name string, n_regionkey int"),
    }
    for name, (rows, schema) in tables.items():
        spark.createDataFrame(rows, schema).write.parquet(f"{tmp_path}/{name}.parquet")
    folder = str(tmp_path)
    makers = [T.type_bridge, T.brand_bridge, T.order_territory]
    before = [Counter(map(tuple, make(spark, folder).collect())) for make in makers]
    counts = T.bridge_cardinality(spark, folder).orderBy("dimension").collect()
    monkeypatch.setattr(T, "SLICE_BYTES", 100)
    assert T.slices(spark, folder, "lineitem") > spark.sparkContext.defaultParallelism
    for make, was in zip(makers, before):
        bridge = make(spark, folder)
        assert Counter(map(tuple, bridge.collect())) == was and max(was.values()) == 1
        at = bridge.select(c.PUB, F.spark_partition_id().alias("part")).groupBy(c.PUB).agg(F.count_distinct("part").alias("parts"))
        assert bridge.rdd.getNumPartitions() == T.slices(spark, folder, "lineitem")
        assert at.agg(F.max("parts")).first()[0] == 1
    assert T.bridge_cardinality(spark, folder).orderBy("dimension").collect() == counts
    types = {(pub, f"T{part % 7}") for pub, part, _ in lines if part is not None}
    per = Counter(pub for pub, _ in types)
    assert tuple(counts[1]) == ("tipos", len(types), len(per), sum(n > 1 for n in per.values()), max(per.values()))
    # Counted where the rows lie: after the two exchanges of each bridge only the sums move.
    plan = T.bridge_cardinality(spark, folder)._jdf.queryExecution().executedPlan().toString()
    assert plan.count(" hashpartitioning(") == 5 and plan.count("REPARTITION_BY_NUM") == 4
