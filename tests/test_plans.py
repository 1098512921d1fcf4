"""Shapes the plans must keep at scale."""

import re

import pytest

from folium.table_queries import QUERIES

FOLDER = "/root/testdata/sf0.001"


def plan_of(spark, name):
    """Physical plan as it would be with every table too large to broadcast."""
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    spark.conf.set("spark.sql.adaptive.enabled", "false")
    try:
        return QUERIES[name](spark, FOLDER)._jdf.queryExecution().executedPlan().toString()
    finally:
        spark.conf.unset("spark.sql.autoBroadcastJoinThreshold")
        spark.conf.set("spark.sql.adaptive.enabled", "true")


@pytest.mark.parametrize("name", ["host_classifier", "title_rules", "marker_prefix_exact_class", "migrate_values", "normalize_key"])
def test_row_level_work_never_shuffles(spark, name):
    plan = plan_of(spark, name)
    # Roles that join two test tables shuffle for that join only.
    joins = len(re.findall(r"SortMergeJoin", plan))
    assert len(re.findall(r"\bExchange\b", plan)) == 2 * joins


def test_summary_counts_without_shuffling_by_category_rows(spark):
    plan = plan_of(spark, "relation_summary")
    # The bridge leaves the semi join partitioned by publication; only partial counts move by category.
    assert plan.count("LeftSemi") == 1
    assert "partial_count(distinct" in plan


def test_pruned_columns_and_pushed_filters(spark):
    plan = plan_of(spark, "faceted_publications")
    assert "o_totalprice" not in plan and "l_extendedprice" not in plan
    scan = next(line for line in plan.splitlines() if "FileScan" in line and "o_orderpriority" in line)
    assert "IsNotNull(o_orderpriority)" in scan and "IsNotNull(o_orderkey)" in scan


def test_ordinals_and_heads_are_sliced(spark):
    plan = plan_of(spark, "remap_bridge")
    assert "WindowGroupLimit" in plan
    assert re.search(r"row_number\(\) windowspecdefinition\(ID_PUBLICACION_PROPUESTA#\d+L?, _slice", plan)


# Scans, exchanges and pattern searches of plans whose checks share the exchange of their join.
LIMITS = {
    "build_decisions": (1, 1, 3),
    "covering_decisions": (2, 2, 3),
    "consolidate_publications": (4, 8, 0),
    "precedence_level": (2, 3, 0),
    "checked_inner_join": (2, 2, 0),
    "audit_current": (1, 2, 0),
}


@pytest.mark.parametrize("name", sorted(LIMITS))
def test_checks_read_nothing_twice(spark, name):
    plan = plan_of(spark, name)
    counts = (len(re.findall(x, plan)) for x in (r"FileScan", r"(?<!Reused)\bExchange ", r"RLIKE"))
    assert all(n <= most for n, most in zip(counts, LIMITS[name]))


def test_facet_options_read_each_bridge_once(spark, tmp_path):
    from folium import table_queries as T
    from folium.operators.facets import facet_options

    def kept(name, df):
        df.write.parquet(f"{tmp_path}/{name}")
        return spark.read.parquet(f"{tmp_path}/{name}")

    pubs = kept("pubs", T.orders_as_publications(spark, FOLDER))
    bridges = {k: kept(k, b) for k, b in T.facet_bridges(spark, FOLDER).items()}
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    spark.conf.set("spark.sql.adaptive.enabled", "false")
    try:
        options = facet_options(pubs, bridges, T.selection(), lambda df: kept("reached", df))
        plan = options._jdf.queryExecution().executedPlan().toString()
    finally:
        spark.conf.unset("spark.sql.autoBroadcastJoinThreshold")
        spark.conf.set("spark.sql.adaptive.enabled", "true")
    # The reaches for the scalar facets, and, with the bridges, for those behind 2 and 3 choices.
    assert len(re.findall("FileScan", plan)) <= 6 and len(re.findall(r"(?<!Reused)\bExchange ", plan)) <= 12
    assert options.count() == QUERIES["facet_options"](spark, FOLDER).count()


def test_profiles_move_digests(spark):
    plan = plan_of(spark, "text_profile")
    assert len(re.findall("FileScan", plan)) <= 4
    assert not re.search(r"Exchange hashpartitioning\([^)]*valor", plan)
    partial = [line for line in plan.splitlines() if "partial_any_value" in line or "partial_first" in line]
    assert partial and all(re.search(r"keys?=\[orden#\d+, _rank", line) for line in partial)


def test_parts_and_whole_meet_the_bridge_in_one_join(spark):
    # The roles join lineitem with part, and orders with what they bring; the operator adds one join.
    assert len(re.findall("Join ", plan_of(spark, "scalar_vs_bridge"))) <= 4
