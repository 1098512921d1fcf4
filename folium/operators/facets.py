"""Faceted filtering.

A :class:`Selection` holds the chosen values; :func:`faceted` turns it into one
lazy plan: scalar facets become pushed-down predicates, bridge facets become
semi joins on the publication id (all on the same key, so the filtered frame is
shuffled once for the whole chain).
"""

from __future__ import annotations

from collections.abc import Callable, Mapping
from dataclasses import dataclass, field

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from folium import columns as c
from folium import fixed_values as fv
from folium.functions import text as t
from folium.operators.bridges import as_is, clean_bridge
from folium.operators.summaries import year_bounds

# Order matters: every facet lists the options left by the ones before it.
SCALAR_FACETS = [c.PUBLIC_TYPE, c.LANGUAGE, c.SCOPE]
BRIDGE_FACETS = [
    "base",
    "repositorio_clase",
    "repositorio",
    "region",
    "institucion_clase",
    "institucion",
    "eje",
    "area",
]


@dataclass(frozen=True)
class Selection:
    """Chosen facet values; an empty choice does not filter."""

    years: tuple[int, int] | None = None
    scalars: Mapping[str, list[str]] = field(default_factory=dict)
    detail: str | None = None
    bridges: Mapping[str, list[str]] = field(default_factory=dict)
    include_others: bool = True

    def chosen(self, column: str) -> list[str]:
        return list(self.scalars.get(column, []))

    @property
    def types(self) -> list[str]:
        return self.chosen(c.PUBLIC_TYPE)


def unique_only(df: DataFrame) -> DataFrame:
    """Rows flagged for unique counting; everything when there is no flag."""
    if c.UNIQUE_FLAG not in df.columns:
        return df
    return df.filter(t.is_unique_flag(F.col(c.UNIQUE_FLAG)))


def in_years(df: DataFrame, years: tuple[int, int] | None) -> DataFrame:
    """Inclusive year range.

    The full range is no filter, so rows without a year survive it; any narrower
    range drops them.  The comparison with the full range is a scalar subquery.
    """
    if years is None:
        return df
    low, high = years
    bounds = year_bounds(df)
    narrower = bounds.select(
        F.coalesce(
            (F.col("min_year") < F.col("max_year"))
            & ~((F.col("min_year") == low) & (F.col("max_year") == high)),
            F.lit(False),
        )
    ).scalar()
    inside = F.coalesce(t.to_number(F.col(c.YEAR)).between(low, high), F.lit(False))
    return df.filter(inside | ~narrower)


def in_values(column: str, chosen: list[str]) -> Column:
    """Trimmed value is among the chosen ones; a null counts as blank.

    Blank is never an option, so the scan may skip nulls.
    """
    value = F.col(f"`{column}`")
    if "" in chosen:
        return t.unicode_trim(F.coalesce(value.cast("string"), F.lit(""))).isin(*chosen)
    return value.isNotNull() & t.unicode_trim(value).isin(*chosen)


def _scalar_steps(df: DataFrame, selection: Selection) -> list[str]:
    """Scalar facets that are shown for this selection, in order."""
    steps = [x for x in SCALAR_FACETS if x in df.columns]
    if fv.THESIS in selection.types:
        steps += [c.GRADE, c.LEVEL]
    if selection.types:
        steps.append(c.PUBLIC_SUBTYPE)
    return steps


def scalar_filters(df: DataFrame, selection: Selection) -> DataFrame:
    df = in_years(df, selection.years)
    for column in _scalar_steps(df, selection):
        if selection.chosen(column):
            df = df.filter(in_values(column, selection.chosen(column)))
    return df


def detail_filter(df: DataFrame, detail: str | None) -> DataFrame:
    """Drill-down equality, not trimmed."""
    return df.filter(F.col(c.POSTGRAD_DETAIL) == detail) if detail else df


def bridge_filter(df: DataFrame, bridge: DataFrame, chosen: list[str]) -> DataFrame:
    """Publications that have any of the chosen categories."""
    if not chosen:
        return df
    hits = bridge.filter(t.unicode_trim(F.col(c.CATEGORY)).isin(*chosen)).select(c.PUB)
    return df.join(hits, c.PUB, "left_semi")


def bridge_filters(df: DataFrame, bridges: Mapping[str, DataFrame], selection: Selection) -> DataFrame:
    for key in BRIDGE_FACETS:
        if key in bridges:
            df = bridge_filter(df, bridges[key], list(selection.bridges.get(key, [])))
    return df


def faceted(publications: DataFrame, bridges: Mapping[str, DataFrame], selection: Selection) -> DataFrame:
    """Publications that pass the flag, the scalar facets, the drill-down and the bridges."""
    df = scalar_filters(unique_only(publications), selection)
    return bridge_filters(detail_filter(df, selection.detail), bridges, selection)


@dataclass(frozen=True)
class _Step:
    """A facet and the number of active choices before it."""

    facet: str
    needed: int


def _steps(df: DataFrame, bridges: Mapping[str, DataFrame], selection: Selection):
    """The facets shown, scalar and by bridge, and the conditions of the active choices, all in order.

    A condition is a column of the publication, or the key of a bridge facet.
    """
    scalar: list[_Step] = []
    tagged: list[_Step] = []
    active: list[Column | str] = []
    for column in _scalar_steps(df, selection):
        scalar.append(_Step(column, len(active)))
        if selection.chosen(column):
            active.append(in_values(column, selection.chosen(column)))
    if selection.detail:
        active.append(F.col(c.POSTGRAD_DETAIL) == selection.detail)
    for key in BRIDGE_FACETS:
        if key in bridges:
            tagged.append(_Step(key, len(active)))
            if selection.bridges.get(key):
                active.append(key)
    # A choice that no facet stands behind narrows no option.
    return scalar, tagged, active[: max((x.needed for x in [*scalar, *tagged]), default=0)]


def _hits(bridges: Mapping[str, DataFrame], selection: Selection, keys: list[str]) -> DataFrame:
    """For each publication that any chosen category meets: which of these facets do."""
    every = None
    for key in keys:
        chosen = t.unicode_trim(F.col(c.CATEGORY)).isin(*selection.bridges[key])
        part = bridges[key].filter(chosen).select(c.PUB, F.lit(key).alias("_facet"))
        every = part if every is None else every.unionAll(part)
    met = [F.bool_or(F.col("_facet") == key).alias(f"_met_{key}") for key in keys]
    return every.groupBy(c.PUB).agg(*met)


def facet_options(
    publications: DataFrame,
    bridges: Mapping[str, DataFrame],
    selection: Selection,
    store: Callable[[DataFrame], DataFrame] = as_is,
) -> DataFrame:
    """``(facet, value)`` options of every facet, each under the narrowing before it.

    The active choices form a chain.  Each publication gets its *reach*, the number of choices
    at the chain's start that it meets, from one aggregate over the relations with a chosen
    category; a facet with n choices before it lists the values of publications that
    reach n.  So every bridge is read once for its values, and all of them are joined with the
    publications in one go.  Scalar and bridge facets both read the reaches, which ``store`` may
    write down.
    """
    df = in_years(unique_only(publications), selection.years)
    scalar, tagged, active = _steps(df, bridges, selection)
    by_bridge = [x for x in active if isinstance(x, str)]
    if by_bridge:
        df = df.join(_hits(bridges, selection, by_bridge), c.PUB, "left")
    reach = F.lit(len(active))
    for i, condition in reversed(list(enumerate(active))):
        met = F.col(f"_met_{condition}") if isinstance(condition, str) else condition
        reach = F.when(F.coalesce(met, F.lit(False)), reach).otherwise(i)
    reached = store(df.select(c.PUB, *[F.col(f"`{x.facet}`") for x in scalar], reach.alias("_reach")))

    pairs = [
        F.when(
            F.col("_reach") >= x.needed,
            F.struct(F.lit(x.facet).alias("facet"), t.unicode_trim(F.col(f"`{x.facet}`").cast("string")).alias("value")),
        )
        for x in scalar
    ]
    parts = []
    if pairs:
        rows = reached.select(F.inline(F.array_compact(F.array(*pairs))))
        parts.append(rows.filter(F.col("value").isNotNull() & (F.col("value") != "")))
    relations = None
    for x in tagged:
        part = clean_bridge(bridges[x.facet]).select(
            c.PUB, F.lit(x.facet).alias("facet"), F.col(c.CATEGORY).alias("value"), F.lit(x.needed).alias("_needed")
        )
        relations = part if relations is None else relations.unionAll(part)
    if relations is not None:
        known = reached.select(F.col(c.PUB).alias("_pub"), "_reach")
        near = (F.col(c.PUB) == F.col("_pub")) & (F.col("_reach") >= F.col("_needed"))
        parts.append(relations.join(known, near, "left_semi").select("facet", "value"))
    out = parts[0]
    for part in parts[1:]:
        out = out.unionByName(part)
    return out.distinct().orderBy("facet", "value")
