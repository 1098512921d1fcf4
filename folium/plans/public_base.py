"""Public unique base and its territory, keyed by the bibliographic master key."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from folium import columns as c
from folium.functions import text as t
from folium.operators.checks import require_columns
from folium.operators.facets import unique_only
from folium.operators.groups import keep_first
from folium.operators.profile import union_all
from folium.operators.summaries import indicator_rows
from folium.operators.territory import complete_with_zero, off_map, on_map, territory_counts


def unique_public_base(df: DataFrame, order: str = c.ORD) -> DataFrame:
    """First flagged row per master key; rows without a key collapse into one.

    The row ordinal is the loader's (``tables.read_ordered``).
    """
    work = unique_only(require_columns(df, [order], "public base"))
    if c.MASTER_KEY in work.columns:
        work = keep_first(work, [c.MASTER_KEY], [F.col(order)])
    if c.UNIQUE_FLAG in work.columns:
        work = work.withColumn(c.UNIQUE_FLAG, F.lit("SI"))
    return work


def recode_empties(df: DataFrame, columns: list[str] | None = None) -> tuple[DataFrame, DataFrame]:
    """Blanks of the categorical columns become ``Otros``; and how many there were.

    All counts come from one pass over the table.
    """
    present = [x for x in (columns or c.RECODED_COLUMNS) if x in df.columns]
    recoded = df.withColumns({x: t.otros_if_empty(F.col(f"`{x}`")) for x in present})
    blanks = df.agg(*[F.count_if(~t.non_empty(F.col(f"`{x}`"))).alias(x) for x in present])
    return recoded, indicator_rows(blanks, "campo", "vacios_recodificados_como_otros")


def public_territory(
    base: DataFrame, territory: DataFrame, departments: DataFrame, order: str = c.ORD
) -> dict[str, DataFrame]:
    """Territory of the public base: one relation per (chosen record, department).

    ``base`` holds one row per master key, as :func:`unique_public_base` leaves it.
    """
    chosen = base.select(c.MASTER_KEY, F.col(c.RECORD).alias("_chosen")).dropna()
    expanded = territory.join(chosen, c.MASTER_KEY)
    expanded = expanded.withColumn(c.RECORD, F.col("_chosen")).drop("_chosen")
    if c.UNIQUE_FLAG in expanded.columns:
        expanded = expanded.withColumn(c.UNIQUE_FLAG, F.lit("SI"))
    expanded = keep_first(expanded, [c.RECORD, c.DEP_KEY], [F.col(order)])
    crossed = on_map(expanded)
    counts = territory_counts(crossed, distinct_of=c.MASTER_KEY)
    public_map = complete_with_zero(
        departments.select(c.DEP_ID, c.DEP_NAME, c.DEP_KEY, c.DEP_CAPITAL), counts, c.TERRITORY_COUNTS
    )
    outside = off_map(expanded)
    uncrossed = outside.select(*[x for x in (c.DEP_BASE, c.DEP_KEY) if x in outside.columns]).distinct()

    crossing = expanded.agg(
        F.count(F.lit(1)).alias("relaciones_territoriales_publicas"),
        F.count_if(F.coalesce(F.col(c.ON_MAP), F.lit(False))).alias("relaciones_territoriales_en_geojson"),
    )
    coverage = union_all(
        [
            indicator_rows(base.agg(F.count(F.lit(1)).alias("publicaciones_unicas"))),
            indicator_rows(crossing),
            indicator_rows(
                public_map.agg(
                    F.count_if(F.col("publicaciones_bibliograficas") > 0).alias("departamentos_con_datos")
                )
            ),
            indicator_rows(uncrossed.agg(F.count(F.lit(1)).alias("departamentos_sin_cruce_geojson"))),
        ]
    )
    return {
        c.T_MAP: public_map,
        c.T_COVERAGE: coverage,
        c.T_TERRITORY: expanded,
        c.T_UNCROSSED: uncrossed,
    }


def public_summary(original: DataFrame, public: DataFrame, recoded: DataFrame, sources: dict[str, str]) -> DataFrame:
    """Indicators of the public base, as text rows."""
    spark = original.sparkSession
    names = [("archivo_fuente_app", ""), ("archivo_fuente_territorial", "")]
    head = spark.createDataFrame(
        [(n, sources.get(n, d)) for n, d in names], "indicador string, valor string"
    )
    parts = [
        head,
        indicator_rows(original.agg(F.count(F.lit(1)).alias("filas_base_original"))),
        indicator_rows(
            public.agg(
                F.count(F.lit(1)).alias("filas_publicas_unicas"),
                F.count_distinct(c.MASTER_KEY).alias("publicaciones_unicas"),
            )
        ),
        indicator_rows(
            recoded.agg(
                F.sum("vacios_recodificados_como_otros").alias("campos_categoricos_vacios_recodificados")
            )
        ),
    ]
    return union_all([p.select("indicador", F.col("valor").cast("string").alias("valor")) for p in parts])


def build_public_base(
    df: DataFrame,
    territory: DataFrame,
    departments: DataFrame,
    sources: dict[str, str] | None = None,
    features: DataFrame | None = None,
) -> dict[str, DataFrame]:
    """The public base, its territory and both summaries.

    ``features`` are the departments' map features (``tables.read_departments``), which go
    into the base as they are.
    """
    df = df.toDF(*[x.strip() for x in df.columns])
    unique = unique_public_base(df)
    public, recoded = recode_empties(unique)
    return {
        c.T_PUBLICATIONS: public,
        "RESUMEN_BASE_PUBLICA": public_summary(df, public, recoded, sources or {}),
        "CAMPOS_OTROS": recoded,
        **public_territory(public, territory, departments),
        **({} if features is None else {c.T_DEP_GEOJSON: features}),
    }


__all__ = [
    "build_public_base",
    "public_summary",
    "public_territory",
    "recode_empties",
    "unique_public_base",
]
