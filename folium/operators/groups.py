"""Order-dependent group operators that stay bounded when one group is huge.

A group may hold a third of all rows, so nothing here lets one task take a whole
group; rows without a group form one.  The input ordinal is a unique whole number (the loader's row number), so
``(group, ordinal // width)`` holds at most ``width`` rows whatever the skew;
per-group totals are put together from one small row per such slice.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from folium import columns as c
from folium.operators.checks import join_null_safe, raise_when

SLICE_ROWS = 1_000_000
REPEATED = "an ordinal repeats"


def keep_first(df: DataFrame, keys: list[str], order: list[str | Column]) -> DataFrame:
    """First row per key in the given order; null keys form one group.

    ``row_number() = 1`` is planned with a group limit before the shuffle, so each
    map task sends at most one row per key and a hot key costs nothing extra.
    """
    rank = F.row_number().over(Window.partitionBy(*[F.col(f"`{k}`") for k in keys]).orderBy(*order))
    return df.withColumn("_rank", rank).filter(F.col("_rank") == 1).drop("_rank")


def _slice(order: str, width: int) -> Column:
    return F.expr(f"`{order}` div {width}")


def group_ordinal(
    df: DataFrame,
    group: list[str],
    order: str = c.ORD,
    out: str = c.CATEGORY_ORDER,
    width: int = SLICE_ROWS,
) -> DataFrame:
    """Running number 1, 2, ... of each row within its group, by unique ordinal.

    A repeated ordinal in a group stops the job: it stands beside its twin in the slice.
    """
    sliced = df.withColumn("_slice", _slice(order, width))
    before = (
        sliced.groupBy(*group, "_slice")
        .agg(F.count(F.lit(1)).alias("_rows"))
        .withColumn(
            "_before",
            F.coalesce(
                F.sum("_rows").over(
                    Window.partitionBy(*group)
                    .orderBy("_slice")
                    .rowsBetween(Window.unboundedPreceding, -1)
                ),
                F.lit(0),
            ),
        )
        .drop("_rows")
    )
    within = Window.partitionBy(*group, "_slice").orderBy(order)
    numbered = join_null_safe(sliced, before, [*group, "_slice"]).withColumns(
        {out: (F.col("_before") + F.row_number().over(within)).cast("int"), "_last": F.lag(order).over(within)}
    )
    return (
        raise_when(numbered, F.col("_last") == F.col(f"`{order}`"), REPEATED)
        .select(*[F.col(f"`{x}`") for x in df.columns if x != out], out)
    )


def attach_group_head(
    df: DataFrame,
    group: list[str],
    order: str,
    head: str,
    size: str | None = None,
    width: int = SLICE_ROWS,
) -> DataFrame:
    """Add the smallest ordinal (and optionally the row count) of each row's group.

    The group value is joined back per slice, never per whole group.
    """
    sliced = df.withColumn("_slice", _slice(order, width))
    per_slice = sliced.groupBy(*group, "_slice").agg(
        F.min(order).alias("_min"), F.max(order).alias("_max"), F.count(F.lit(1)).alias("_rows")
    )
    # More rows than whole numbers between the ends: without this a slice could be of any size.
    crowded = F.col("_rows") > F.col("_max") - F.col("_min") + 1
    per_slice = raise_when(per_slice, crowded, REPEATED).drop("_max")
    whole = Window.partitionBy(*group)
    values = {head: F.min("_min").over(whole)}
    if size:
        values[size] = F.sum("_rows").over(whole)
    totals = per_slice.withColumns(values).drop("_min", "_rows")
    return join_null_safe(sliced, totals, [*group, "_slice"]).drop("_slice")


def joined_first_seen(
    df: DataFrame, group: list[str], value: Column, order: str | Column, out: str, sep: str = "; "
) -> DataFrame:
    """Distinct non-blank values of a group joined in order of first appearance.

    Repeats are removed by a partial aggregate before the per-group list is built,
    so the list is as long as the result cell, not as the group.
    """
    firsts = (
        df.select(*group, value.alias("_value"), F.col(order).alias("_at") if isinstance(order, str) else order.alias("_at"))
        .filter(F.col("_value").isNotNull() & (F.col("_value") != ""))
        .groupBy(*group, "_value")
        .agg(F.min("_at").alias("_at"))
    )
    ordered = F.array_sort(F.collect_list(F.struct("_at", "_value")))
    return firsts.groupBy(*group).agg(
        F.array_join(F.transform(ordered, lambda x: x["_value"]), sep).alias(out)
    )


def joined_sorted(
    df: DataFrame, group: list[str], value: Column, out: str, sep: str = "; "
) -> DataFrame:
    """Distinct non-blank values of a group joined in code-point order."""
    values = (
        df.select(*group, value.alias("_value"))
        .filter(F.col("_value").isNotNull() & (F.col("_value") != ""))
        .distinct()
    )
    return values.groupBy(*group).agg(
        F.array_join(F.array_sort(F.collect_list("_value")), sep).alias(out)
    )
