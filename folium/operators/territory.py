"""Territorial relations and department summaries."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from folium import columns as c
from folium.functions import text as t
from folium.operators.bridges import as_is
from folium.operators.checks import Keyed, join_many_to_one, plain, require_columns
from folium.operators.groups import joined_sorted, keep_first
from folium.operators.summaries import indicator_rows

_BASE = [c.DEP_ID, c.DEP_NAME, c.DEP_KEY, c.DEP_CAPITAL]


def on_map(territory: DataFrame) -> DataFrame:
    """Relations that cross the map; a null flag is not on the map."""
    require_columns(territory, [c.ON_MAP], c.T_TERRITORY)
    return territory.filter(F.coalesce(F.col(c.ON_MAP), F.lit(False)))


def off_map(territory: DataFrame) -> DataFrame:
    require_columns(territory, [c.ON_MAP], c.T_TERRITORY)
    return territory.filter(~F.coalesce(F.col(c.ON_MAP), F.lit(False)))


def visible_territory(territory: DataFrame, scope: DataFrame) -> DataFrame:
    """Territorial relations of the publications in scope."""
    return territory.join(scope.select(c.PUB), c.PUB, "left_semi")


def complete_with_zero(base: DataFrame, counts: DataFrame, columns: list[str]) -> DataFrame:
    """Every row of the base with its counts, zero where there is none.

    Null keys match each other.  The counts have at most one row per key.
    """
    renamed = counts.withColumnRenamed(c.DEP_KEY, "_key")
    joined = base.join(renamed, base[c.DEP_KEY].eqNullSafe(renamed["_key"]), "left").drop("_key")
    return joined.withColumns({x: F.coalesce(F.col(x), F.lit(0)).cast("long") for x in columns})


def department_summary(scope: DataFrame, territory: DataFrame, base: DataFrame) -> DataFrame:
    """Distinct publications in scope for every department of the base."""
    counts = (
        visible_territory(on_map(territory), scope)
        .groupBy(c.DEP_KEY)
        .agg(F.count_distinct(c.PUB).alias(c.COUNT))
        .filter(F.col(c.DEP_KEY).isNotNull())
    )
    return complete_with_zero(base.select(*_BASE), counts, [c.COUNT])


def consolidated_regions(territory: DataFrame, scope: DataFrame) -> DataFrame:
    """Sorted distinct department names per publication, map relations only."""
    rows = visible_territory(on_map(territory), scope)
    return joined_sorted(rows, [c.PUB], F.col(c.DEP_NAME), c.CONSOLIDATED_REGIONS)


def territorial_detail(territory: DataFrame, scope: DataFrame) -> DataFrame:
    """Distinct (publication, region) on the map, in order."""
    return (
        visible_territory(on_map(territory), scope)
        .select(c.PUB, F.col(c.DEP_NAME).alias("REGION_ESTUDIO"))
        .distinct()
        .orderBy(c.PUB, "REGION_ESTUDIO")
    )


def region_lookup(keys: list[str], regions: DataFrame, order: str) -> DataFrame:
    """Map keys to the category that normalises to each of them and comes first by ``order``.

    ``posicion`` keeps the order of the asked keys; keys without a category are
    left out.  Only asked keys reach the aggregate.
    """
    folded = t.fold_upper(F.col(c.CATEGORY))
    category = t.unicode_trim(F.col(c.CATEGORY))
    first = F.min_by(category, F.col(order))
    found = (
        regions.filter(F.col(c.CATEGORY).isNotNull())
        .withColumn(c.DEP_KEY, folded)
        .filter(F.col(c.DEP_KEY).isin(*keys))
        .groupBy(c.DEP_KEY)
        .agg(first.alias(c.CATEGORY))
    )
    position = F.array_position(F.array(*[F.lit(k) for k in keys]), F.col(c.DEP_KEY)).cast("int")
    return found.select(position.alias("posicion"), c.DEP_KEY, c.CATEGORY)


def territory_counts(territory: DataFrame, distinct_of: str = c.PUB, record: str = c.RECORD) -> DataFrame:
    """Rows and distinct publications per department key, null keys included."""
    counts = territory.groupBy(c.DEP_KEY).agg(
        F.count(record).alias(c.TERRITORY_COUNTS[0]),
        F.count_distinct(distinct_of).alias(c.TERRITORY_COUNTS[1]),
    )
    return counts.withColumn(c.TERRITORY_COUNTS[2], F.col(c.TERRITORY_COUNTS[1]))


def consolidate_territory(
    territory: DataFrame,
    base: DataFrame,
    record_map: DataFrame | Keyed,
    order: str = c.ORD,
    store: Callable[[DataFrame], DataFrame] = as_is,
) -> dict[str, DataFrame]:
    """Territory at publication grain, its map counts and its coverage.

    The relations are read by all three tables; ``store`` may write them down.
    """
    mapped = join_many_to_one(
        territory.drop(c.PUB),
        record_map.select(c.RECORD, c.PUB),
        [c.RECORD],
        "inner",
        "the record map repeats a record",
    )
    expanded = store(keep_first(mapped, [c.PUB, c.DEP_KEY], [F.col(order)]))
    crossed = on_map(expanded)
    counts = territory_counts(crossed).filter(F.col(c.DEP_KEY).isNotNull())
    departments = complete_with_zero(base.select(*_BASE), counts, c.TERRITORY_COUNTS)

    relations = expanded.agg(
        F.count(F.lit(1)).alias("relaciones_territoriales"),
        F.count_distinct(F.when(F.coalesce(F.col(c.ON_MAP), F.lit(False)), F.col(c.PUB))).alias(
            "publicaciones_con_departamento"
        ),
    )
    coverage = (
        indicator_rows(plain(record_map).agg(F.count_distinct(c.PUB).alias("publicaciones_consolidadas")))
        .unionByName(indicator_rows(relations))
        .unionByName(
            indicator_rows(
                departments.agg(
                    F.count_if(F.col("publicaciones_unicas") > 0).alias("departamentos_con_datos")
                )
            )
        )
    )
    return {c.T_TERRITORY: expanded, c.T_MAP: departments, c.T_COVERAGE: coverage}
