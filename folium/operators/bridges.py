"""Publication-category bridges.

A bridge is one row per (publication, category).  Publications are counted by
distinct id over the bridge, never by row sums, and bridges are joined to
publications on the publication id only.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from folium import columns as c
from folium.functions import text as t
from folium.operators.checks import Keyed, join_no_orphans, plain
from folium.operators.groups import SLICE_ROWS, group_ordinal, joined_sorted, keep_first


def clean_bridge(bridge: DataFrame, include_others: bool = True) -> DataFrame:
    """Trim categories and drop blank ones (null included), optionally ``otros`` too."""
    category = t.unicode_trim(F.col(c.CATEGORY))
    keep = F.col(c.CATEGORY).isNotNull() & (F.col(c.CATEGORY) != "")
    if not include_others:
        keep &= ~t.is_others(F.col(c.CATEGORY))
    return bridge.withColumn(c.CATEGORY, category).filter(keep)


def bridge_of_class(bridge: DataFrame, class_column: str, value: str) -> DataFrame:
    """Rows of one class; empty when the bridge has no such class column."""
    if class_column not in bridge.columns:
        return bridge.filter(F.lit(False))
    return bridge.filter(t.unicode_trim(F.col(class_column)) == value)


def bridge_from_column(bridge: DataFrame, column: str) -> DataFrame:
    """Distinct (publication, value of the column) as a bridge of its own."""
    value = F.col(f"`{column}`") if column in bridge.columns else F.lit(None).cast("string")
    return (
        bridge.select(c.PUB, t.unicode_trim(value).alias(c.CATEGORY))
        .filter(F.col(c.PUB).isNotNull() & t.non_empty(F.col(c.CATEGORY)))
        .distinct()
    )


def visible_bridge(bridge: DataFrame, scope: DataFrame, include_others: bool = True) -> DataFrame:
    """Cleaned bridge rows of the publications in scope (semi join on the id)."""
    return clean_bridge(bridge, include_others).join(scope.select(c.PUB), c.PUB, "left_semi")


def consolidated_column(bridge: DataFrame, scope: DataFrame, out: str) -> DataFrame:
    """Sorted distinct categories per publication; ``Otros`` is always kept."""
    visible = visible_bridge(bridge, scope, include_others=True)
    return joined_sorted(visible, [c.PUB], F.col(c.CATEGORY), out)


def as_is(df: DataFrame) -> DataFrame:
    return df


def remap_bridge(
    bridge: DataFrame,
    record_map: DataFrame | Keyed,
    order: str = c.ORD,
    width: int = SLICE_ROWS,
    store: Callable[[DataFrame], DataFrame] = as_is,
) -> DataFrame:
    """Bridge from record grain to publication grain.

    Each (publication, category) keeps its first record; categories are then
    numbered in the order in which the publication's records brought them.
    Numbering reads the kept rows twice; ``store`` may write them down in between.
    """
    mapped = join_no_orphans(
        bridge.drop(c.PUB, c.CATEGORY_ORDER),
        record_map.select(c.RECORD, c.PUB),
        [c.RECORD],
        "bridge holds records without a publication",
        needed=c.PUB,
    )
    first = store(keep_first(mapped, [c.PUB, c.CATEGORY], [F.col(order)]))
    numbered = group_ordinal(first, [c.PUB], order, c.CATEGORY_ORDER, width)
    front = [c.PUB, c.RECORD]
    return numbered.select(*front, *[F.col(f"`{x}`") for x in numbered.columns if x not in front])


def bridge_from_records(
    records: DataFrame | Keyed,
    record_map: DataFrame | Keyed,
    column: str,
    order: str = c.ORD,
    store: Callable[[DataFrame], DataFrame] = as_is,
) -> DataFrame:
    """Publication bridge of a single-valued record column."""
    rows = plain(records)
    extra = [c.MASTER_KEY] if c.MASTER_KEY in rows.columns else []
    source = rows.select(
        c.RECORD, *extra, F.col(f"`{column}`"), F.col(f"`{column}`").alias(c.CATEGORY), order
    )
    return remap_bridge(source, record_map, order, store=store)
