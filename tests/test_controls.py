"""Compiled controls against plain counting, with nulls and repeated keys."""

import random
import re

from pyspark.sql import functions as F

import catalogue
from folium import columns as c
from folium.operators.controls import Controls
from folium.plans import consolidate as L
from folium.plans.validate import Expectations, validate


def rows_of(out):
    return {r["control"]: (r["resultado"], r["cantidad"]) for r in out.rows().collect()}


def test_controls_equal_plain_counts(spark):
    rnd = random.Random(5)
    values = ["a", "b", "c", "d", None]
    one = [(rnd.randrange(12) if rnd.random() < 0.9 else None, rnd.choice(values), rnd.choice("xy")) for _ in range(60)]
    two = [(rnd.randrange(14) if rnd.random() < 0.9 else None, rnd.choice(values), "z") for _ in range(40)]
    left = spark.createDataFrame(one, "k int, v string, w string")
    right = spark.createDataFrame(two, "k int, v string, w string")
    inside = F.col("w") == "x"
    out = Controls(spark)
    out.none("none", left, F.col("v") == "a")
    out.none("never", left, F.col("v") == "zzz")
    out.total("total", left, 55)
    out.total("part", right, 3, F.col("v") == "b")
    out.domain("domain", left, "v", ["a", "b", "e"], exact=True, within=inside)
    out.required("required", right, "v", ["a", "q", "r"], "d")
    counts = {v: sum(r[1] == v for r in one) for v in values[:4]}
    out.distribution("right", left, "v", counts, "d")
    wrong = {"a": counts["a"], "b": counts["b"] + 1, "q": 4}
    out.distribution("wrong", left, "v", wrong, "d")
    out.key("key", left, ["k"])
    out.key("pair", left, ["k", "v"])
    out.key_without_nulls("nulls", right, "k")
    out.reference("inside", left, right, "k", "d")
    out.same_keys("same", right, left, "k", "d")
    out.no_row("own", left.filter("k = 3"), "d")

    twice = lambda keys: len({k for k in keys if keys.count(k) > 1})
    kl, kr = {r[0] for r in one}, {r[0] for r in two}
    seen = {r[1] for r in one if r[2] == "x"} - {None}
    want = {
        "none": counts["a"],
        "never": 0,
        "total": 5,
        "part": abs(sum(r[1] == "b" for r in two) - 3),
        "domain": len(seen - {"a", "b", "e"}),
        "domain (completo)": len({"a", "b", "e"} - seen),
        "required": len({"a", "q", "r"} - {r[1] for r in two}),
        "right": 0,
        "wrong": sum(counts.get(v, 0) != wrong.get(v, 0) for v in {*counts, *wrong}),
        "key": twice([r[0] for r in one]),
        "pair": twice([r[:2] for r in one]),
        "nulls": twice([r[0] for r in two]),
        "nulls (nulos)": sum(r[0] is None for r in two),
        "inside": len(kl - kr - {None}),
        "same": len((kl ^ kr) - {None}) + (None in kl) + (None in kr),
        "own": sum(r[0] == 3 for r in one),
    }
    assert rows_of(out) == {k: ("OK" if n == 0 else "ERROR", n) for k, n in want.items()}
    details = {r["control"]: r["detalle"] for r in out.rows().collect()}
    assert details["total"] == "Esperado 55, obtenido 60" and details["domain"] == "Valores fuera del dominio"


def test_no_rows_and_no_controls(spark):
    none = spark.createDataFrame([], "k int, v string")
    out = Controls(spark)
    out.total("total", none, 2)
    out.key("key", none, ["k"])
    out.reference("inside", none, none, "k", "d")
    out.distribution("counts", none, "v", {"a": 1}, "d")
    assert rows_of(out) == {"total": ("ERROR", 2), "key": ("OK", 0), "inside": ("OK", 0), "counts": ("ERROR", 1)}
    assert Controls(spark).rows().count() == 0


def test_a_catalogue_is_scanned_once_a_purpose(spark, tmp_path):
    found = {}
    for name, df in L.consolidate(catalogue.inputs(spark)).items():
        df.write.parquet(f"{tmp_path}/{name}")
        found[name] = spark.read.parquet(f"{tmp_path}/{name}")
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    spark.conf.set("spark.sql.adaptive.enabled", "false")
    try:
        expected = Expectations(publications=9, records=13, repository_decisions=2)
        plan = validate(spark, found, expected)._jdf.queryExecution().executedPlan().toString()
    finally:
        spark.conf.unset("spark.sql.autoBroadcastJoinThreshold")
        spark.conf.set("spark.sql.adaptive.enabled", "true")
    assert len(re.findall(rf"{re.escape(str(tmp_path))}/{c.T_PUBLICATIONS}\b", plan)) <= 5
    assert len(re.findall(r"(?<!Reused)\bExchange ", plan)) <= 16
