"""Checked joins and key constraints.

A check that must stop a job is part of the plan.  It is a filter whose condition raises
and which the optimizer may not look into: column pruning passes through it, but no filter
from further down slips below it, so no outer join beneath it can be turned into an
inner one and no row escapes the check.

A key is checked where its rows lie together anyway: the exchange and the order by key that
a join needs also show a second row of a key, so no input is read or computed twice.
A table that many joins use is stored once by :func:`store_keyed`, whose handle
(:class:`Keyed`) joins accept without checking again; later filters reach its scan.

Checks that only report live in :mod:`folium.plans.validate`.
"""

from __future__ import annotations

from collections.abc import Callable, Iterable
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from folium.functions.rules import opaque
from folium.session import stored


class SchemaError(ValueError):
    """A table lacks required columns."""


def require_columns(df: DataFrame, required: Iterable[str], what: str = "table") -> DataFrame:
    missing = [x for x in required if x not in df.columns]
    if missing:
        raise SchemaError(f"{what} lacks required columns: {', '.join(sorted(missing))}")
    return df


def strip_headers(df: DataFrame) -> DataFrame:
    return df.toDF(*[x.strip() for x in df.columns])


def raise_when(df: DataFrame, bad: Column, message: str | Column) -> DataFrame:
    """Pass every row through; the job fails on the first row for which ``bad`` holds.

    Only the columns that ``bad`` and later steps need are read.
    """
    text = F.lit(message) if isinstance(message, str) else message
    fine = ~F.coalesce(bad, F.lit(False))
    return df.filter(F.when(opaque(fine), F.lit(True)).otherwise(F.raise_error(text).cast("boolean")))


def raise_when_any(df: DataFrame, bad: Column, message: str) -> DataFrame:
    """Pass every row through unless ``bad`` holds for a row of the table, then fail.

    For stored tables: an aggregate beside the data path reads the columns of ``bad`` alone,
    and later filters still reach the scan of the rows.
    """
    broken = df.agg(F.count_if(bad).alias("_bad")).scalar()
    return df.filter(F.when(broken == 0, F.lit(True)).otherwise(F.raise_error(F.lit(message)).cast("boolean")))


def unique_by(df: DataFrame, keys: list[str], message: str) -> DataFrame:
    """The rows of ``df``; the job fails when a key repeats, null keys included.

    The rows are dealt and sorted by key, as the join that follows needs them, and
    the second row of a key raises at once, so a key with many rows is never held.
    """
    by = [F.col(f"`{k}`") for k in keys]
    numbered = df.withColumn("_nth", F.row_number().over(Window.partitionBy(*by).orderBy(*by)))
    return raise_when(numbered, F.col("_nth") > 1, message).drop("_nth")


@dataclass(frozen=True)
class Keyed:
    """A stored table whose key was checked once, while it was written."""

    table: DataFrame
    keys: tuple[str, ...]

    def select(self, *columns: str | Column) -> Keyed:
        """The same rows with other columns, of which the key must be one."""
        return Keyed(require_columns(self.table.select(*columns), self.keys), self.keys)

    def filter(self, condition: Column) -> Keyed:
        """Some of the rows; their key is as unique as it was."""
        return Keyed(self.table.filter(condition), self.keys)


def store_keyed(
    df: DataFrame,
    keys: list[str],
    message: str,
    store: Callable[[DataFrame], DataFrame] = stored,
    needed: Iterable[str] = (),
    covers: DataFrame | Keyed | None = None,
) -> Keyed:
    """Store a table and check, in the plan that writes it, that its key is unique.

    Columns in ``needed`` may not be null.  With ``covers`` the write also fails unless that
    table holds exactly the same keys.
    """
    rows = unique_by(df, keys, message)
    for column in needed:
        rows = raise_when(rows, F.col(f"`{column}`").isNull(), f"{message}: {column} is empty")
    if covers is not None:
        other = (covers.table if isinstance(covers, Keyed) else covers).select(*[F.col(f"`{k}`") for k in keys])
        rows = join_covering(rows, Keyed(other, tuple(keys)) if isinstance(covers, Keyed) else other, keys, message)
    return Keyed(store(rows.select(*[F.col(f"`{x}`") for x in df.columns])), tuple(keys))


def plain(side: DataFrame | Keyed) -> DataFrame:
    return side.table if isinstance(side, Keyed) else side


def one_row_a_key(side: DataFrame | Keyed, keys: list[str], message: str) -> DataFrame:
    """The side's rows, checked unless they come from a table that was."""
    if isinstance(side, Keyed) and set(side.keys) <= set(keys):
        return side.table
    return unique_by(plain(side), keys, message)


def join_null_safe(left: DataFrame, right: DataFrame, keys: list[str]) -> DataFrame:
    """Inner join in which null keys meet null keys; the key columns stay once.

    Planned as a hash or sort join like any other equality.
    """
    other = right.withColumnsRenamed({k: f"_right_{k}" for k in keys})
    same = [F.col(f"`{k}`").eqNullSafe(F.col(f"`_right_{k}`")) for k in keys]
    return left.join(other, same).drop(*[f"_right_{k}" for k in keys])


def join_one_to_one(
    left: DataFrame | Keyed, right: DataFrame | Keyed, keys: list[str], how: str, message: str
) -> DataFrame:
    return one_row_a_key(left, keys, message).join(one_row_a_key(right, keys, message), keys, how)


def join_many_to_one(
    left: DataFrame, right: DataFrame | Keyed, keys: list[str], how: str, message: str
) -> DataFrame:
    return left.join(one_row_a_key(right, keys, message), keys, how)


def join_no_orphans(
    left: DataFrame, right: DataFrame | Keyed, keys: list[str], message: str, needed: str | None = None
) -> DataFrame:
    """Many-to-one left join that fails when a left row finds no partner.

    With ``needed`` it also fails when the partner's value in that column is null.
    """
    found = F.lit(True) if needed is None else F.col(f"`{needed}`").isNotNull()
    marked = one_row_a_key(right, keys, message).withColumn("_found", F.when(found, F.lit(True)))
    joined = left.join(marked, keys, "left")
    return raise_when(joined, F.col("_found").isNull(), message).drop("_found")


def join_covering(
    left: DataFrame | Keyed, right: DataFrame | Keyed, keys: list[str], message: str
) -> DataFrame:
    """One-to-one join that fails unless both sides hold exactly the same keys."""
    a = one_row_a_key(left, keys, message).withColumn("_l", F.lit(True))
    b = one_row_a_key(right, keys, message).withColumn("_r", F.lit(True))
    joined = a.join(b, keys, "full_outer")
    bad = F.col("_l").isNull() | F.col("_r").isNull()
    return raise_when(joined, bad, message).drop("_l", "_r")


# --------------------------------------------------------------------------
# Reporting shapes
# --------------------------------------------------------------------------
def duplicate_keys(df: DataFrame, keys: list[str]) -> DataFrame:
    """Keys that occur more than once, with their count."""
    return (
        df.groupBy(*[F.col(f"`{k}`") for k in keys])
        .agg(F.count(F.lit(1)).alias("n"))
        .filter(F.col("n") > 1)
    )


def orphans(child: DataFrame, parent: DataFrame, key: str, parent_key: str | None = None) -> DataFrame:
    """Distinct child keys that the parent lacks; distinct first, so a hot key is one row."""
    keys = child.select(F.col(f"`{key}`").alias(key)).filter(F.col(f"`{key}`").isNotNull()).distinct()
    known = parent.select(F.col(f"`{parent_key or key}`").alias(key))
    return keys.join(known, key, "left_anti")


def key_differences(left: DataFrame, right: DataFrame, key: str) -> DataFrame:
    """Keys held by only one side, with the side that holds them."""
    side = lambda df, name: df.select(F.col(f"`{key}`").alias(key)).distinct().withColumn(name, F.lit(True))
    both = side(left, "_l").join(side(right, "_r"), key, "full_outer")
    return both.filter(F.col("_l").isNull() | F.col("_r").isNull()).select(
        key, F.when(F.col("_r").isNull(), "left").otherwise("right").alias("only_in")
    )


def outside_domain(df: DataFrame, column: str, allowed: Iterable) -> DataFrame:
    """Distinct non-null values that are not allowed."""
    value = F.col(f"`{column}`")
    return df.filter(value.isNotNull() & ~value.isin(*allowed)).select(value.alias(column)).distinct()
