"""Controls over many tables, counted together.

A control is declared on the table it concerns.  All that can be seen row by row
(predicates, totals, domains, required values, expected counts) becomes one set of *marks* of a
row, so a table is scanned once for it, and the marks of all tables meet in one aggregate,
folded map-side.  Keys of all tables meet in one aggregate over (control, key), and
references over one key meet in one aggregate that knows, for each key, the tables that
hold it.  Only what compares rows of two tables in another way keeps a plan of its own.
Nothing is collected, and no set of values or keys is held in one row.
"""

from __future__ import annotations

from collections.abc import Iterable, Mapping
from dataclasses import dataclass, field

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from folium.operators.profile import control_row, union_all

ERROR = "ERROR"
_RESULT = "control string, resultado string, cantidad long, detalle string"


@dataclass(frozen=True)
class _Marked:
    """A control by marks: how its number follows from rows, kinds and matches of its marks."""

    name: str
    detail: str
    number: Column
    told: Column | None = None


@dataclass
class Controls:
    """Collects controls; :meth:`rows` gives one row each."""

    spark: SparkSession
    _marks: dict[int, tuple[DataFrame, list[Column]]] = field(default_factory=dict)
    _marked: list[_Marked] = field(default_factory=list)
    #: (mark, value, count or null) that a control expects.
    _wanted: list[tuple[int, str, int | None]] = field(default_factory=list)
    _keys: list[tuple[str, str, DataFrame]] = field(default_factory=list)
    #: By the key that is referred to: the tables that hold it, and the references.
    _holders: dict[str, dict[int, tuple[DataFrame, str]]] = field(default_factory=dict)
    _references: list[tuple[str, str, str, str, int, int]] = field(default_factory=list)
    _parts: list[DataFrame] = field(default_factory=list)

    # ---- marks -----------------------------------------------------------
    def _mark(self, df: DataFrame, condition: Column, value: Column | None, control: _Marked) -> None:
        mark = len(self._marked)
        text = F.lit(None).cast("string") if value is None else value.cast("string")
        entry = F.when(condition, F.struct(F.lit(mark).alias("mark"), text.alias("value")))
        self._marks.setdefault(id(df), (df, []))[1].append(entry)
        self._marked.append(control)

    def none(self, name: str, df: DataFrame, bad: Column, detail: str = "Filas que incumplen") -> None:
        """No row for which ``bad`` holds."""
        self._mark(df, bad, None, _Marked(name, detail, F.col("rows")))

    def total(self, name: str, df: DataFrame, expected: int, condition: Column | None = None) -> None:
        """As many rows as expected."""
        told = F.concat(F.lit(f"Esperado {expected}, obtenido "), F.col("rows").cast("string"))
        number = F.abs(F.col("rows") - F.lit(expected))
        self._mark(df, F.lit(True) if condition is None else condition, None, _Marked(name, "", number, told))

    def no_value(self, name: str, df: DataFrame, value: Column, bad: Column, detail: str) -> None:
        """No value for which ``bad`` holds; counts the different ones."""
        self._mark(df, bad & value.isNotNull(), value, _Marked(name, detail, F.col("kinds")))

    def domain(
        self, name: str, df: DataFrame, column: str, allowed: Iterable[str], exact: bool = False, within: Column | None = None
    ) -> None:
        """Only allowed values, among the rows ``within``; with ``exact`` every one of them too."""
        allowed, value = list(allowed), F.col(f"`{column}`")
        inside = F.lit(True) if within is None else within
        self.no_value(name, df, value, inside & ~value.isin(*allowed), "Valores fuera del dominio")
        if exact:
            self.required(f"{name} (completo)", df, column, allowed, "Valores requeridos ausentes", within)

    def required(
        self, name: str, df: DataFrame, column: str, values: Iterable[str], detail: str, within: Column | None = None
    ) -> None:
        """Each of the values occurs."""
        values, value = list(values), F.col(f"`{column}`")
        inside = F.lit(True) if within is None else within
        number = F.lit(len(set(values))) - F.col("kinds")
        self._mark(df, inside & value.isin(*values), value, _Marked(name, detail, number))

    def distribution(
        self, name: str, df: DataFrame, column: str, expected: Mapping[str, int], detail: str, within: Column | None = None
    ) -> None:
        """Each value occurs as often as expected, and no other one occurs."""
        value, mark = F.col(f"`{column}`"), len(self._marked)
        self._wanted += [(mark, v, n) for v, n in expected.items()]
        # Values that are wanted or there, less those with the right count.
        number = F.lit(len(expected)) + F.col("kinds") - F.col("known") - F.col("right")
        inside = F.lit(True) if within is None else within
        self._mark(df, inside & value.isNotNull(), value, _Marked(name, detail, number))

    def _mark_rows(self) -> DataFrame:
        marks = None
        for df, entries in self._marks.values():
            part = df.select(F.explode(F.array_compact(F.array(*entries))).alias("m")).select("m.mark", "m.value")
            marks = part if marks is None else marks.unionAll(part)
        by_value = marks.groupBy("mark", "value").agg(F.count(F.lit(1)).alias("n"))
        wanted = [
            F.struct(F.lit(m).alias("mark"), F.lit(v).alias("value"), F.lit(n).cast("long").alias("n"))
            for m, v, n in self._wanted
        ]
        known = right = F.lit(False)
        if wanted:
            right = F.array_contains(F.array(*wanted), F.struct("mark", "value", "n"))
            pairs = [F.struct(x["mark"].alias("mark"), x["value"].alias("value")) for x in wanted]
            known = F.array_contains(F.array(*pairs), F.struct("mark", "value"))
        counts = by_value.groupBy("mark").agg(
            F.sum("n").alias("rows"),
            F.count("value").alias("kinds"),
            F.count_if(known).alias("known"),
            F.count_if(right).alias("right"),
        )
        declared = self.spark.createDataFrame(
            [(i, m.name, m.detail) for i, m in enumerate(self._marked)], "mark int, control string, detalle string"
        )
        # One row a control on both sides.
        found = declared.join(counts, "mark", "left").fillna(0, ["rows", "kinds", "known", "right"])
        number, told = F.lit(None).cast("long"), F.col("detalle")
        for i, m in enumerate(self._marked):
            number = F.when(F.col("mark") == i, m.number.cast("long")).otherwise(number)
            if m.told is not None:
                told = F.when(F.col("mark") == i, m.told).otherwise(told)
        return _judged(found, number, told)

    # ---- keys ------------------------------------------------------------
    def key(self, name: str, df: DataFrame, keys: list[str], detail: str = "Claves repetidas") -> None:
        """No key twice; null keys count as one key.  Counts the repeated ones."""
        values = F.to_json(F.array(*[F.col(f"`{k}`").cast("string") for k in keys]))
        self._keys.append((name, detail, df.select(F.lit(len(self._keys)).alias("which"), values.alias("key"))))

    def key_without_nulls(self, name: str, df: DataFrame, key: str) -> None:
        self.key(name, df, [key])
        self.none(f"{name} (nulos)", df, F.col(f"`{key}`").isNull(), "Claves nulas")

    def _key_rows(self) -> DataFrame:
        every = self._keys[0][2]
        for _, _, df in self._keys[1:]:
            every = every.unionAll(df)
        repeated = (
            every.groupBy("which", "key").agg(F.count(F.lit(1)).alias("n")).filter(F.col("n") > 1)
            .groupBy("which").agg(F.count(F.lit(1)).alias("n"))
        )
        declared = self.spark.createDataFrame(
            [(i, name, detail) for i, (name, detail, _) in enumerate(self._keys)],
            "which int, control string, detalle string",
        )
        found = declared.join(repeated, "which", "left")
        return _judged(found, F.coalesce("n", F.lit(0)), F.col("detalle"))

    # ---- references ------------------------------------------------------
    def _holder(self, key: str, df: DataFrame) -> int:
        holders = self._holders.setdefault(key, {})
        holders.setdefault(id(df), (df, key))
        return list(holders).index(id(df))

    def reference(self, name: str, child: DataFrame, parent: DataFrame, key: str, detail: str) -> None:
        """Every key of the child, null ones aside, stands in the parent.  Counts different keys."""
        self._references.append((name, detail, "inside", key, self._holder(key, child), self._holder(key, parent)))

    def same_keys(self, name: str, left: DataFrame, right: DataFrame, key: str, detail: str) -> None:
        """Both tables hold the same keys; a null key is missing on the other side."""
        self._references.append((name, detail, "same", key, self._holder(key, left), self._holder(key, right)))

    def _reference_rows(self, key: str) -> DataFrame:
        every = None
        for bit, (df, _) in enumerate(self._holders[key].values()):
            part = df.select(F.col(f"`{key}`").cast("string").alias("key"), F.lit(1 << bit).cast("long").alias("held"))
            every = part if every is None else every.unionAll(part)
        held = every.groupBy("key").agg(F.bit_or("held").alias("held"))
        own = [r for r in self._references if r[3] == key]

        def broken(kind: str, a: int, b: int) -> Column:
            in_a, in_b = (F.col("held").bitwiseAND(1 << x) != 0 for x in (a, b))
            if kind == "inside":
                return (F.col("key").isNotNull() & in_a & ~in_b).cast("long")
            both = in_a.cast("long") + in_b.cast("long")
            return F.when(F.col("key").isNull(), both).otherwise(both % 2)

        sums = held.agg(
            *[F.coalesce(F.sum(broken(kind, a, b)), F.lit(0)).alias(f"n{i}") for i, (_, _, kind, _, a, b) in enumerate(own)]
        )
        rows = [
            F.struct(F.lit(name).alias("control"), F.lit(detail).alias("detalle"), F.col(f"n{i}").alias("n"))
            for i, (name, detail, *_rest) in enumerate(own)
        ]
        return _judged(sums.select(F.inline(F.array(*rows))), F.col("n"), F.col("detalle"))

    # ---- the rest --------------------------------------------------------
    def no_row(self, name: str, violations: DataFrame, detail: str) -> None:
        """A control with a plan of its own: the frame must be empty."""
        self._parts.append(control_row(name, ERROR, detail, violations))

    def rows(self) -> DataFrame:
        """``(control, resultado, cantidad, detalle)``, one row a control."""
        parts = list(self._parts)
        if self._marked:
            parts.append(self._mark_rows())
        if self._keys:
            parts.append(self._key_rows())
        parts += [self._reference_rows(key) for key in self._holders]
        return union_all(parts) if parts else self.spark.createDataFrame([], _RESULT)


def _judged(found: DataFrame, number: Column, detail: Column) -> DataFrame:
    judged = found.select("control", number.cast("long").alias("cantidad"), detail.alias("detalle"))
    return judged.select("control", F.when(F.col("cantidad") == 0, "OK").otherwise(ERROR).alias("resultado"), "cantidad", "detalle")
