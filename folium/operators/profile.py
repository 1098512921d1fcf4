"""Catalogue audit: column profile, bridge cardinality, multi-valued listing, controls."""

from __future__ import annotations

from collections.abc import Mapping

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from folium import columns as c
from folium.functions import text as t
from folium.functions.rules import opaque
from folium.operators.checks import duplicate_keys
from folium.operators.groups import joined_sorted


#: Characters of a value by which equally frequent ones are ordered, before their digest.
PREFIX = 64


def column_profile(df: DataFrame, columns: list[str] | None = None, top: int = 5) -> DataFrame:
    """Per column: rows, non-empty, empty, % empty, distinct values, most frequent values.

    One unpivot and one aggregate on (column, digest of the value) serve every statistic; a
    value that fills a third of the table is folded map-side, and a long one moves as its
    16-byte digest and first characters.  Only the ``top`` values of each column are then
    read again, by digest.  Equally frequent values come in order of their first 64
    characters, and of their digest if those are equal too.
    """
    columns = columns or df.columns

    def unpivoted(*fields: str) -> DataFrame:
        pairs = []
        for i, x in enumerate(columns, 1):
            value = F.when(t.non_empty(F.col(f"`{x}`")), F.col(f"`{x}`").cast("string"))
            parts = {
                "orden": F.lit(i),
                "campo": F.lit(x),
                "_digest": F.unhex(F.md5(value.cast("binary"))),
                "_prefix": F.substring(value, 1, PREFIX),
                "valor": value,
            }
            pairs.append(F.struct(*[parts[name].alias(name) for name in fields]))
        return df.select(F.inline(F.array(*pairs)))

    values = (
        unpivoted("orden", "campo", "_digest", "_prefix")
        .groupBy("orden", "campo", "_digest", "_prefix")
        .agg(F.count(F.lit(1)).alias("n"))
    )
    filled = F.col("_digest").isNotNull()
    totals = values.groupBy("orden", "campo").agg(
        F.sum("n").alias("filas"),
        F.coalesce(F.sum(F.when(filled, F.col("n"))), F.lit(0)).alias("no_vacios"),
        F.coalesce(F.sum(F.when(~filled, F.col("n"))), F.lit(0)).alias("vacios"),
        F.count_if(filled).alias("valores_unicos"),
    )
    rank = F.row_number().over(Window.partitionBy("orden").orderBy(F.desc("n"), "_prefix", "_digest"))
    # Opaque, so that totals and ranks go on from one exchange.
    chosen = values.filter(opaque(filled)).withColumn("_rank", rank).filter(F.col("_rank") <= top)
    # At most ``top`` rows a column, so sending them to every task is bounded.
    chosen = F.broadcast(chosen.select("orden", "_digest", "_rank", "n"))
    frequent = (
        unpivoted("orden", "_digest", "valor")
        .join(chosen, ["orden", "_digest"])
        .groupBy("orden", "_rank", "n")
        .agg(F.any_value("valor").alias("valor"))
        .groupBy("orden")
        .agg(F.array_sort(F.collect_list(F.struct("_rank", "valor", "n"))).alias("_top"))
        .select(
            "orden",
            F.array_join(
                F.transform(
                    "_top",
                    lambda x: F.concat(x["valor"], F.lit(" ["), x["n"].cast("string"), F.lit("]")),
                ),
                " || ",
            ).alias("valores_frecuentes"),
        )
    )
    share = F.round(F.lit(100.0) * F.col("vacios") / F.col("filas"), 2)
    return totals.join(frequent, "orden", "left").select(
        "orden",
        "campo",
        "filas",
        "no_vacios",
        "vacios",
        share.alias("porcentaje_vacios"),
        "valores_unicos",
        F.coalesce("valores_frecuentes", F.lit("")).alias("valores_frecuentes"),
    )


def bridge_cardinality(bridges: Mapping[str, DataFrame]) -> DataFrame:
    """Relations, publications, multi-valued publications and maximum, for all bridges in one job.

    Each bridge is counted by publication on its own, where its rows lie if they lie by publication.
    """
    counts = [
        bridge.groupBy(c.PUB).agg(F.count(F.lit(1)).alias("n")).select(F.lit(name).alias("dimension"), "n")
        for name, bridge in bridges.items()
    ]
    return union_all(counts).groupBy("dimension").agg(
        F.sum("n").alias("relaciones"),
        F.count(F.lit(1)).alias("publicaciones"),
        F.count_if(F.col("n") > 1).alias("publicaciones_multivalor"),
        F.max("n").alias("max_categorias_por_publicacion"),
    )


def multivalued_listing(
    publications: DataFrame, bridge: DataFrame, scalar: str, out: str = "REGIONES_DIMENSION"
) -> DataFrame:
    """Publications with more than one category: scalar value beside the joined set."""
    many = (
        bridge.select(c.PUB, c.CATEGORY)
        .distinct()
        .groupBy(c.PUB)
        .agg(F.count(F.lit(1)).alias("_n"))
        .filter(F.col("_n") > 1)
        .select(c.PUB)
    )
    joined = joined_sorted(bridge.join(many, c.PUB, "left_semi"), [c.PUB], F.col(c.CATEGORY), out)
    extra = [c.REPRESENTATIVE] if c.REPRESENTATIVE in publications.columns else []
    return publications.select(c.PUB, F.col(f"`{scalar}`"), *extra).join(joined, c.PUB).select(
        c.PUB, F.col(f"`{scalar}`"), out, *extra
    )


def scalar_outside_bridge(
    publications: DataFrame, bridge: DataFrame, scalar: str, separator: str = "; "
) -> DataFrame:
    """Publications whose scalar value is not a category of their bridge.

    ``completo`` compares the whole text, as published; ``partes`` compares each of
    the joined parts, which clears scalars that merely hold several categories.
    """
    value = F.col(f"`{scalar}`")
    parts = F.split(value, separator)
    # The whole text and its parts, each told apart by what it is, meet the bridge in one join.
    asked = F.transform(
        F.array_distinct(F.concat(F.array(value), parts)),
        lambda x: F.struct(x.alias("_asked"), (x == value).alias("_is_whole"), F.array_contains(parts, x).alias("_is_part")),
    )
    rows = publications.filter(t.non_empty(value)).select(c.PUB, value.alias("_whole"), F.inline(asked))
    known = bridge.select(F.col(c.PUB).alias("_pub"), F.col(c.CATEGORY).alias("_known"))
    same = (F.col(c.PUB) == F.col("_pub")) & (F.col("_asked") == F.col("_known"))
    missing = F.col("_pub").isNull()
    found = rows.join(known, same, "left").groupBy(c.PUB, F.col("_whole").alias(scalar)).agg(
        F.bool_or(F.col("_is_whole") & missing).alias("fuera_completo"),
        F.bool_or(F.col("_is_part") & missing).alias("fuera_partes"),
    )
    return found.filter(F.col("fuera_completo") | F.col("fuera_partes"))


def control_row(control: str, severity: str, detail: str, violations: DataFrame, count: Column | None = None) -> DataFrame:
    """One control: OK when nothing violates it, otherwise its severity and the count."""
    number = (F.count(F.lit(1)) if count is None else count).cast("long")
    return violations.agg(number.alias("cantidad")).select(
        F.lit(control).alias("control"),
        F.when(F.col("cantidad") == 0, "OK").otherwise(F.lit(severity)).alias("resultado"),
        "cantidad",
        F.lit(detail).alias("detalle"),
    )


def control_rows(named: list[tuple[str, str, str]], violations: DataFrame) -> DataFrame:
    """Several controls (name, severity, detail) over one count."""
    rows = [
        F.struct(
            F.lit(control).alias("control"),
            F.when(F.col("cantidad") == 0, "OK").otherwise(F.lit(severity)).alias("resultado"),
            F.col("cantidad"),
            F.lit(detail).alias("detalle"),
        )
        for control, severity, detail in named
    ]
    return violations.agg(F.count(F.lit(1)).alias("cantidad")).select(F.inline(F.array(*rows)))


def union_all(parts: list[DataFrame]) -> DataFrame:
    out = parts[0]
    for part in parts[1:]:
        out = out.unionByName(part, allowMissingColumns=True)
    return out


def group_size_mismatches(publications: DataFrame, record_map: DataFrame) -> DataFrame:
    """Publications whose declared group size differs from the rows of the map."""
    actual = record_map.groupBy(c.PUB).agg(F.count(F.lit(1)).alias("_rows"))
    return publications.select(c.PUB, t.to_number(F.col(c.GROUP_SIZE)).alias("_said")).join(
        actual, c.PUB, "left"
    ).filter(~F.col("_said").eqNullSafe(F.col("_rows").cast("double")))


def inconsistent_representatives(record_map: DataFrame) -> DataFrame:
    """Groups of the map that name more than one representative, or none.

    Minimum and maximum differ exactly when there are several, so no distinct set
    has to be held.
    """
    return (
        record_map.groupBy(c.PUB)
        .agg(F.min(c.REPRESENTATIVE).alias("_a"), F.max(c.REPRESENTATIVE).alias("_b"))
        .filter(F.col("_a").isNull() | (F.col("_a") != F.col("_b")))
        .select(c.PUB)
    )


def several_categories(bridge: DataFrame) -> DataFrame:
    """Publications with more than one category: minimum and maximum differ, so no set is held."""
    ends = bridge.groupBy(c.PUB).agg(F.min(c.CATEGORY).alias("_a"), F.max(c.CATEGORY).alias("_b"))
    return ends.filter(F.col("_a") != F.col("_b")).select(c.PUB)


def catalogue_audit(
    publications: DataFrame, record_map: DataFrame, regions: DataFrame, scalar: str = c.REGION
) -> DataFrame:
    """The published control table of the catalogue."""
    several = several_categories(regions)
    outside = scalar_outside_bridge(publications, regions, scalar)
    return union_all(
        [
            control_row("Unicidad ID_PUBLICACION_PROPUESTA", "ERROR", "Duplicados en BD_APP", duplicate_keys(publications, [c.PUB])),
            control_row(
                "Consistencia REGISTROS_EN_GRUPO",
                "ERROR",
                "No coincide con REGISTRO_PUBLICACION",
                group_size_mismatches(publications, record_map),
            ),
            control_row(
                "Consistencia representante",
                "ERROR",
                "Representante inconsistente dentro del mapeo",
                inconsistent_representatives(record_map),
            ),
            control_row(
                "Región principal no contenida en dimensión",
                "ERROR",
                "REGION_NORM_SUGERIDA no aparece en DIM_REGIONES_NORMALIZADAS",
                outside.filter("fuera_completo"),
            ),
            # One count serves two controls.
            control_rows(
                [
                    (
                        "Publicaciones con múltiples regiones",
                        "ADVERTENCIA",
                        "DIM_REGIONES_NORMALIZADAS conserva más de una categoría",
                    ),
                    (
                        "Pérdida potencial al exportar región escalar",
                        "ALTO",
                        "Publicaciones multirregionales reducidas a REGION_NORM_SUGERIDA en BD_APP",
                    ),
                ],
                several,
            ),
        ]
    )
