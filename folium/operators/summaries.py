"""Distinct-publication counts.

``count_distinct`` is planned on (category, id) first and on the category last,
so a category that holds a third of all rows is spread over the ids.
"""

from __future__ import annotations

from collections.abc import Mapping

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from folium import columns as c
from folium.functions import text as t
from folium.operators.bridges import bridge_of_class, clean_bridge, visible_bridge


def by_count(df: DataFrame, *keys: str, count: str = c.COUNT) -> DataFrame:
    """Largest count first; ties by key, so the order is defined."""
    return df.orderBy(F.desc(count), *[F.asc(f"`{k}`") for k in keys])


def simple_summary(df: DataFrame, column: str, ordered: bool = True) -> DataFrame:
    """Distinct publications per non-blank value of a scalar column; none when it is absent."""
    value = F.col(f"`{column}`") if column in df.columns else F.lit(None).cast("string")
    counts = (
        df.filter(t.non_empty(value))
        .groupBy(t.unicode_trim(value).alias(column))
        .agg(F.count_distinct(c.PUB).alias(c.COUNT))
    )
    return by_count(counts, column) if ordered else counts


def relation_summary(
    bridge: DataFrame, scope: DataFrame, include_others: bool = True, ordered: bool = True
) -> DataFrame:
    """Distinct publications in scope per category of a bridge."""
    counts = (
        visible_bridge(bridge, scope, include_others)
        .groupBy(c.CATEGORY)
        .agg(F.count_distinct(c.PUB).alias(c.COUNT))
    )
    return by_count(counts, c.CATEGORY) if ordered else counts


def class_summary(
    bridge: DataFrame, scope: DataFrame, class_column: str, value: str, include_others: bool = True
) -> DataFrame:
    """Summary of the categories that belong to one class."""
    return relation_summary(bridge_of_class(bridge, class_column, value), scope, include_others)


def rankings(
    sources: Mapping[str, tuple[DataFrame, Column | None]], scope: DataFrame, include_others: bool = True
) -> DataFrame:
    """``(tabla, categoria, count)`` of many relation and class summaries in one aggregate.

    A source is a bridge and the condition its rows must meet, or none.  A bridge that serves
    several rankings is read once; all of them meet the scope in one semi join.
    """
    shared: dict[int, tuple[DataFrame, list[Column]]] = {}
    for name, (bridge, condition) in sources.items():
        tag = F.lit(name) if condition is None else F.when(condition, F.lit(name))
        shared.setdefault(id(bridge), (bridge, []))[1].append(tag)
    every = None
    for bridge, tags in shared.values():
        part = clean_bridge(bridge, include_others).select(
            c.PUB, F.explode(F.array_compact(F.array(*tags))).alias("tabla"), c.CATEGORY
        )
        every = part if every is None else every.unionAll(part)
    seen = every.join(scope.select(c.PUB), c.PUB, "left_semi")
    return seen.groupBy("tabla", c.CATEGORY).agg(F.count_distinct(c.PUB).alias(c.COUNT))


def one_ranking(ranked: DataFrame, name: str) -> DataFrame:
    """One table out of :func:`rankings`, largest first."""
    return by_count(ranked.filter(F.col("tabla") == name).drop("tabla"), c.CATEGORY)


def drilldown_summary(
    filtered: DataFrame,
    full: DataFrame,
    kind: str | None,
    column: str,
    subtype: str | None = None,
) -> DataFrame:
    """Summary of the filtered frame, or of the whole type when that one is empty.

    Both branches are one plan: the fallback rows survive only while the filtered
    summary has no row, tested by a scalar subquery instead of a driver action.
    """
    summary = simple_summary(filtered, column, ordered=False)
    if not kind:
        return by_count(summary, column)
    whole = full.filter(t.unicode_trim(F.col(c.PUBLIC_TYPE)) == kind)
    if subtype:
        whole = whole.filter(t.unicode_trim(F.col(c.PUBLIC_SUBTYPE)) == subtype)
    present = t.non_empty(F.col(f"`{column}`")) if column in filtered.columns else F.lit(False)
    found = filtered.agg(F.count_if(present)).scalar()
    fallback = simple_summary(whole, column, ordered=False).filter(found == 0)
    return by_count(summary.unionByName(fallback), column)


def year_series(df: DataFrame) -> DataFrame:
    """Distinct publications per year and type; rows without a year or type are left out."""
    return (
        df.select(c.PUB, t.to_year(F.col(c.YEAR)).alias(c.YEAR), c.PUBLIC_TYPE)
        .filter(F.col(c.YEAR).isNotNull() & F.col(c.PUBLIC_TYPE).isNotNull())
        .groupBy(c.YEAR, c.PUBLIC_TYPE)
        .agg(F.count_distinct(c.PUB).alias(c.COUNT))
        .orderBy(c.YEAR, c.PUBLIC_TYPE)
    )


def year_bounds(df: DataFrame) -> DataFrame:
    """One row: smallest and largest year."""
    year = t.to_number(F.col(c.YEAR))
    return df.agg(F.min(year).cast("int").alias("min_year"), F.max(year).cast("int").alias("max_year"))


def value_counts(df: DataFrame, *columns: str, count: str = c.COUNT, keep_null: bool = True) -> DataFrame:
    """Rows per value combination; null combinations kept unless asked otherwise."""
    cols = [F.col(f"`{x}`") for x in columns]
    if not keep_null:
        df = df.dropna(subset=list(columns))
    return by_count(df.groupBy(*cols).agg(F.count(F.lit(1)).alias(count)), *columns, count=count)


def top_k(summary: DataFrame, key: str, k: int = 12) -> DataFrame:
    """The ``k`` largest categories, smallest first for display (k between 5 and 25)."""
    return by_count(summary, key).limit(k).orderBy(F.asc(c.COUNT), F.desc(f"`{key}`"))


def preview(df: DataFrame, columns: list[str] | None = None, rows: int = 500) -> DataFrame:
    """First rows by publication id, visible columns only."""
    visible = [x for x in (columns or c.EXPLORE_COLUMNS) if x in df.columns]
    return df.orderBy(c.PUB).limit(rows).select(*[F.col(f"`{x}`") for x in visible])


def indicator_rows(row: DataFrame, name: str = "indicador", value: str = "valor") -> DataFrame:
    """Turn a one-row aggregate into (indicator, value) rows."""
    pairs = [F.struct(F.lit(x).alias(name), F.col(f"`{x}`").alias(value)) for x in row.columns]
    return row.select(F.inline(F.array(*pairs)))


def kpis(
    scope: DataFrame,
    departments: DataFrame,
    areas: DataFrame,
    repository_classes: DataFrame,
    include_others: bool = True,
) -> DataFrame:
    """The four headline indicators as rows.

    The area count never includes ``otros``; the class count follows the switch.
    """
    sources = [
        ("areas_tematicas", clean_bridge(areas, include_others=False)),
        ("clases_repositorio", clean_bridge(repository_classes, include_others)),
    ]
    tagged = None
    for name, bridge in sources:
        part = bridge.select(c.PUB, F.lit(name).alias("indicador"), c.CATEGORY)
        tagged = part if tagged is None else tagged.unionAll(part)
    # Both bridges meet the scope in one semi join; their categories are told apart by the indicator.
    seen = tagged.join(scope.select(c.PUB), c.PUB, "left_semi").select("indicador", c.CATEGORY).distinct()
    of = lambda name: F.count_if(F.col("indicador") == name).alias(name)
    counted = seen.agg(*[of(name) for name, _ in sources])
    parts = [
        ("publicaciones", scope.agg(F.count_distinct(c.PUB).alias("valor"))),
        ("departamentos", departments.agg(F.count_if(F.col(c.COUNT) > 0).alias("valor"))),
    ]
    out = None
    for name, df in parts:
        row = df.select(F.lit(name).alias("indicador"), "valor")
        out = row if out is None else out.unionByName(row)
    return out.unionByName(indicator_rows(counted, "indicador", "valor"))
