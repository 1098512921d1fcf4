"""Bounded group operators against brute force, and checks that must raise."""

import random

import re

import pytest
from pyspark.errors import PySparkException
from pyspark.sql import functions as F

from folium import columns as c
from folium.operators import checks as K
from folium.operators import groups as G
from folium.operators.bridges import remap_bridge


def skewed(n=3000, seed=3):
    """A third of the rows in one group; unique ordinals in random order."""
    rnd = random.Random(seed)
    ords = rnd.sample(range(10 * n), n)
    return [("hot" if i % 3 == 0 else f"g{rnd.randint(0, 40)}", rnd.randint(0, 30), o) for i, o in enumerate(ords)]


@pytest.mark.parametrize("width", [7, 500, 1_000_000])
def test_group_ordinal_equals_brute_force(spark, width):
    rows = skewed()
    got = G.group_ordinal(spark.createDataFrame(rows, "g string, v int, o long"), ["g"], "o", "n", width).collect()
    seen, expected = {}, {}
    for g, _v, o in sorted(rows, key=lambda r: r[2]):
        seen[g] = seen.get(g, 0) + 1
        expected[o] = seen[g]
    assert {r["o"]: r["n"] for r in got} == expected


@pytest.mark.parametrize("width", [11, 1_000_000])
def test_group_head_equals_brute_force(spark, width):
    rows = skewed()
    frame = spark.createDataFrame(rows, "g string, v int, o long")
    got = G.attach_group_head(frame, ["g"], "o", "first", "size", width).collect()
    assert len(got) == len(rows)
    for r in got:
        group = [o for g, _v, o in rows if g == r["g"]]
        assert (r["first"], r["size"]) == (min(group), len(group))


def test_rows_without_a_group_form_one(spark):
    frame = spark.createDataFrame([(None, 5), ("a", 3), (None, 2)], "g string, o long")
    heads = G.attach_group_head(frame, ["g"], "o", "first", "size").collect()
    assert sorted((r["o"], r["first"], r["size"]) for r in heads) == [(2, 2, 2), (3, 3, 1), (5, 2, 2)]
    numbers = G.group_ordinal(frame, ["g"], "o", "n").collect()
    assert sorted((r["o"], r["n"]) for r in numbers) == [(2, 1), (3, 1), (5, 2)]


def test_a_record_whose_publication_is_null_stops_the_bridge(spark):
    bridge = spark.createDataFrame([("r1", "x", 1), ("r2", "y", 2)], f"{c.RECORD} string, {c.CATEGORY} string, {c.ORD} long")
    known = spark.createDataFrame([("r1", "p"), ("r2", None)], f"{c.RECORD} string, {c.PUB} string")
    # Two stages read the checked rows; Spark names both failures if they come at once.
    with pytest.raises(Exception, match="without a publication"):
        remap_bridge(bridge, known).collect()


def test_keep_first_and_null_keys(spark):
    rows = [("a", 5), ("a", 2), (None, 9), (None, 7), ("b", 1)]
    got = G.keep_first(spark.createDataFrame(rows, "k string, o int"), ["k"], ["o"]).collect()
    assert sorted((str(r["k"]), r["o"]) for r in got) == [("None", 7), ("a", 2), ("b", 1)]


def test_keep_first_limits_before_the_shuffle(spark):
    frame = spark.range(1000).selectExpr("id % 3 AS k", "id AS o").repartition(4)
    plan = G.keep_first(frame, ["k"], ["o"])._jdf.queryExecution().executedPlan().toString()
    assert plan.count("WindowGroupLimit") == 2


def test_joined_values(spark):
    rows = [(1, "b", 1), (1, "a", 2), (1, "b", 3), (1, " ", 4), (1, None, 5), (2, "Áncash", 1), (2, "Otros", 2), (3, None, 1)]
    frame = spark.createDataFrame(rows, "g int, v string, o int")
    first = {r["g"]: r["x"] for r in G.joined_first_seen(frame, ["g"], F.trim("v"), "o", "x").collect()}
    assert first == {1: "b; a", 2: "Áncash; Otros"}
    ordered = {r["g"]: r["x"] for r in G.joined_sorted(frame, ["g"], F.trim("v"), "x").collect()}
    assert ordered == {1: "a; b", 2: "Otros; Áncash"}


def test_checks_pass_and_raise(spark):
    left = spark.createDataFrame([(1, "a"), (2, "b")], "k int, x string")
    right = spark.createDataFrame([(1, "p"), (2, "q")], "k int, y string")
    twice = right.union(right)
    assert K.join_one_to_one(left, right, ["k"], "left", "m").count() == 2
    assert sorted(map(tuple, K.join_covering(left, right, ["k"], "m").collect())) == [(1, "a", "p"), (2, "b", "q")]
    assert sorted(map(tuple, K.join_no_orphans(left, right, ["k"], "m").collect())) == [(1, "a", "p"), (2, "b", "q")]
    bad = [
        K.join_one_to_one(left, twice, ["k"], "left", "m"),
        K.join_many_to_one(left, twice, ["k"], "inner", "m"),
        K.join_no_orphans(left, right.filter("k = 1"), ["k"], "m"),
        K.join_covering(left, right.filter("k = 1"), ["k"], "m"),
        K.join_covering(left.filter("k = 1"), right, ["k"], "m"),
    ]
    for frame in bad:
        # A filter that only keeps matched rows must not hide the violation.
        for use in (frame, frame.filter("x IS NOT NULL AND y IS NOT NULL AND x <> 'zzz'")):
            with pytest.raises(PySparkException):
                use.collect()


def test_a_check_reads_only_the_columns_it_needs(spark, tmp_path):
    wide = spark.range(20).selectExpr("id AS k", *[f"id * {i} AS c{i}" for i in range(12)])
    wide.write.parquet(f"{tmp_path}/wide")
    stored = spark.read.parquet(f"{tmp_path}/wide")
    checks = [
        K.unique_by(stored, ["k"], "m"),
        K.raise_when(stored, F.col("k").isNull(), "m"),
        K.raise_when_any(stored, F.col("k").isNull(), "m"),
        K.join_covering(stored, spark.range(20).withColumnRenamed("id", "k"), ["k"], "m"),
    ]
    for checked in checks:
        plan = checked.select("c3")._jdf.queryExecution().executedPlan().toString()
        schemas = re.findall(r"ReadSchema: struct<(.*?)>", plan)
        assert set(schemas) <= {"k:bigint,c3:bigint", "k:bigint", "c3:bigint"} and schemas
        assert checked.select("c3").count() == 20
    # Beside the data path, a later filter still reaches the scan.
    plan = K.raise_when_any(stored, F.col("k").isNull(), "m").filter("c3 = 6").select("c5")
    assert "EqualTo(c3,6)" in plan._jdf.queryExecution().executedPlan().toString()
    with pytest.raises(PySparkException, match="broken"):
        K.raise_when_any(stored, F.col("k") > 18, "broken").filter("c3 = 6").collect()


def test_a_verified_key_is_checked_once(spark, tmp_path):
    kept = []

    def store(df):
        df.write.parquet(f"{tmp_path}/{len(kept)}")
        kept.append(df)
        return spark.read.parquet(f"{tmp_path}/{len(kept) - 1}")

    left = spark.createDataFrame([(1, "a"), (2, None)], "k int, x string")
    right = spark.createDataFrame([(1, "p"), (2, "q")], "k int, y string")
    known = K.store_keyed(right, ["k"], "repeats", store, needed=["y"], covers=left)
    joins = [
        K.join_many_to_one(left, known, ["k"], "left", "m"),
        K.join_no_orphans(left, known, ["k"], "m", needed="y"),
        K.join_one_to_one(K.store_keyed(left, ["k"], "repeats", store), known, ["k"], "inner", "m"),
        K.join_covering(K.store_keyed(left, ["k"], "repeats", store), known.select("k", "y"), ["k"], "m"),
    ]
    for joined in joins:
        assert "Window" not in joined._jdf.queryExecution().executedPlan().toString()
        assert sorted(map(tuple, joined.collect())) == [(1, "a", "p"), (2, None, "q")]
    # A key that is checked holds for further key columns too, but not for fewer.
    both = K.store_keyed(left.withColumn("j", F.lit(1)), ["k", "j"], "m", store)
    assert "Window" in K.one_row_a_key(both, ["k"], "m")._jdf.queryExecution().executedPlan().toString()
    assert known.filter(F.col("k") == 1).table.count() == 1
    with pytest.raises(K.SchemaError):
        known.select("y")
    broken = [
        lambda: K.store_keyed(right.union(right), ["k"], "repeats", store),
        lambda: K.store_keyed(left, ["k"], "empty", store, needed=["x"]),
        lambda: K.store_keyed(right.filter("k = 1"), ["k"], "uncovered", store, covers=left),
        lambda: K.store_keyed(right, ["k"], "uncovered", store, covers=left.filter("k = 1")),
        lambda: K.store_keyed(spark.createDataFrame([(None,), (None,)], "k int"), ["k"], "nulls", store),
    ]
    for write in broken:
        with pytest.raises(PySparkException):
            write()


def test_report_shapes(spark):
    child = spark.createDataFrame([(1,), (1,), (3,), (None,)], "k int")
    parent = spark.createDataFrame([(1,), (2,)], "k int")
    assert [r["k"] for r in K.orphans(child, parent, "k").collect()] == [3]
    sides = {r["k"]: r["only_in"] for r in K.key_differences(child.dropna(), parent, "k").collect()}
    assert sides == {3: "left", 2: "right"}
    assert [(r["k"], r["n"]) for r in K.duplicate_keys(child, ["k"]).collect()] == [(1, 2)]
    assert [r["k"] for r in K.outside_domain(child, "k", [1]).collect()] == [3]


def test_required_columns(spark):
    frame = spark.createDataFrame([(1,)], "` a ` int")
    assert K.strip_headers(frame).columns == ["a"]
    with pytest.raises(K.SchemaError, match="b"):
        K.require_columns(frame, ["b"])
