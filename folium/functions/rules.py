"""Ordered rules: the first rule that matches decides.

A rule list is declared as data and turned into one lazy ``CASE``, so a
classifier runs inside the scan stage: no join, no shuffle, no Python worker.
Exact lists become hash-set ``IN`` tests.

A folded key is read by dozens of tests.  :func:`bind` computes such values once
per row: the optimizer may not look into them (:func:`opaque`), so it neither copies them
into their consumers nor pushes filters through, but it drops those that nobody reads.
"""

from __future__ import annotations

from collections.abc import Iterable
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from folium import fixed_values as fv


def bind(df: DataFrame, values: dict[str, Column]) -> DataFrame:
    """Add columns that are computed once per row however often they are read, and not at all if never."""
    return df.select("*", *[opaque(value).alias(name) for name, value in values.items()])


def opaque(value: Column) -> Column:
    """The value, which the optimizer must compute where it stands: not folded, copied or moved."""
    return F.when(F.spark_partition_id() >= 0, value)


def quoted(value: str) -> str:
    """SQL string literal."""
    return "'" + value.replace("\\", "\\\\").replace("'", "\\'") + "'"


def _struct_sql(names: Iterable[str], values: Iterable[str]) -> str:
    pairs = (f"{quoted(n)}, {quoted(v)}" for n, v in zip(names, values))
    return f"named_struct({', '.join(pairs)})"


@dataclass(frozen=True)
class KeyRule:
    """Rule over a folded key; any of the three tests may fire it."""

    outcome: tuple[str, ...]
    exact: tuple[str, ...] = ()
    prefixes: tuple[str, ...] = ()
    markers: tuple[str, ...] = ()

    def test(self, key: str) -> str:
        tests = [f"startswith({key}, {quoted(p)})" for p in self.prefixes]
        tests += [f"contains({key}, {quoted(m)})" for m in self.markers]
        if self.exact:
            tests.insert(0, f"{key} IN ({', '.join(quoted(v) for v in self.exact)})")
        return " OR ".join(tests)


def first_match(
    key: str, rules: Iterable[KeyRule], names: Iterable[str], default: tuple[str, ...]
) -> Column:
    """Struct of the first rule that the key column meets, else ``default``."""
    names = list(names)
    arms = "\n".join(f"WHEN {rule.test(key)} THEN {_struct_sql(names, rule.outcome)}" for rule in rules)
    return F.expr(f"CASE {arms} ELSE {_struct_sql(names, default)} END")


def class_lookup(col: Column, table: dict[str, tuple], names: Iterable[str]) -> Column:
    """Struct looked up by class; null when the class is unknown."""
    names = list(names)
    pairs = ", ".join(f"{quoted(k)}, {_struct_sql(names, v)}" for k, v in table.items())
    return F.try_element_at(F.expr(f"map({pairs})"), col)


def regex(pattern: str, ignore_case: bool = False) -> str:
    """Pattern with Unicode word boundaries, digits and spaces."""
    return ("(?iuU)" if ignore_case else "(?U)") + pattern


def first_pattern(text: Column, labels: Iterable[str], patterns: dict[str, str] = fv.TYPE_PATTERNS) -> Column:
    """``(label, found)`` of the first pattern, in table order, that occurs in the text."""
    wanted = set(labels)
    hits = []
    for label, pattern in patterns.items():
        if label in wanted:
            found = F.regexp_extract(text, regex(pattern), 0)
            hits.append(F.when(found != "", F.struct(F.lit(label).alias("label"), found.alias("found"))))
    return F.coalesce(*hits)
