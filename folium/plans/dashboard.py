"""Dashboard result sets and the public export of a selection."""

from __future__ import annotations

from collections.abc import Mapping

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from folium import columns as c
from folium import fixed_values as fv
from folium.functions import text as t
from folium.operators.bridges import as_is, bridge_from_column, clean_bridge, consolidated_column
from folium.operators.checks import require_columns, strip_headers
from folium.operators.classify import (
    normalize_hierarchy,
    with_default_institution_classes,
    with_default_repository_classes,
)
from folium.operators.facets import Selection, faceted, unique_only
from folium.operators.summaries import (
    drilldown_summary,
    kpis,
    one_ranking,
    rankings,
    simple_summary,
    top_k,
    year_series,
)
from folium.operators.territory import (
    consolidated_regions,
    department_summary,
    territorial_detail,
)
from folium.session import stored

# Bridge key -> table it comes from.
BRIDGE_TABLES = {
    "base": c.DIM_DATABASES,
    "repositorio": c.DIM_REPOSITORIES,
    "area": c.DIM_AREAS,
    "eje": c.DIM_AXES,
    "linea": c.DIM_LINES,
    "region": c.DIM_REGIONS,
    "institucion": c.DIM_INSTITUTIONS,
}


def load_publications(df: DataFrame) -> DataFrame:
    """Stripped headers, normalised hierarchy, required columns, unique rows."""
    df = normalize_hierarchy(strip_headers(df))
    return unique_only(require_columns(df, c.REQUIRED_DASHBOARD, c.T_PUBLICATIONS))


def load_bridges(tables: Mapping[str, DataFrame]) -> dict[str, DataFrame]:
    """Cleaned bridges by key, with the two class bridges derived from their columns."""
    bridges = {key: clean_bridge(tables[name]) for key, name in BRIDGE_TABLES.items() if name in tables}
    if "repositorio" in bridges:
        bridges["repositorio"] = with_default_repository_classes(bridges["repositorio"])
        bridges["repositorio_clase"] = bridge_from_column(bridges["repositorio"], c.REPO_PUBLIC_CLASS)
    if "institucion" in bridges:
        bridges["institucion"] = with_default_institution_classes(bridges["institucion"])
        bridges["institucion_clase"] = bridge_from_column(bridges["institucion"], c.INST_PUBLIC_CLASS)
    return bridges


#: Rankings of institutions: class column and class.
INSTITUTION_RANKINGS = {
    "universidades_publicas": (c.INST_CLASS, fv.INST_PUBLIC_UNIVERSITY),
    "universidades_privadas": (c.INST_CLASS, fv.INST_PRIVATE_UNIVERSITY),
    "universidades_extranjeras": (c.INST_CLASS, fv.INST_FOREIGN_UNIVERSITY),
    "entidades_publicas": (c.INST_CLASS, fv.INST_STATE),
    "centros_investigacion": (c.INST_PUBLIC_CLASS, "Centro de investigación / cooperación"),
    "revistas_mal_ubicadas": (c.INST_CLASS, fv.INST_JOURNAL),
}
PLAIN_RANKINGS = ("base", "repositorio_clase", "institucion_clase", "area", "eje")
#: Column of a drill-down table that names the whole path of a category.
PATH = "Jerarquía"


def _ranking_sources(bridges: Mapping[str, DataFrame], repository_class: str | None):
    """The bridge and the condition of every ranking that these bridges allow."""

    def of_class(bridge: DataFrame, column: str, value: str):
        known = F.col(f"`{column}`") if column in bridge.columns else F.lit(None).cast("string")
        return bridge, t.unicode_trim(known) == value

    sources = {key: (bridges[key], None) for key in PLAIN_RANKINGS if key in bridges}
    if repository_class and "repositorio" in bridges:
        sources["repositorio"] = of_class(bridges["repositorio"], c.REPO_PUBLIC_CLASS, repository_class)
    if "institucion" in bridges:
        for name, (column, value) in INSTITUTION_RANKINGS.items():
            sources[name] = of_class(bridges["institucion"], column, value)
    return sources


def dashboard(
    publications: DataFrame,
    bridges: Mapping[str, DataFrame],
    territory: DataFrame,
    departments: DataFrame,
    selection: Selection,
    chart_type: str | None = None,
    repository_class: str | None = None,
    persist: bool = True,
    top: int = 12,
) -> dict[str, DataFrame]:
    """Every summary of one interaction, over one filtered frame.

    ``publications`` and ``bridges`` come from the loaders above.  The filtered frame, cut to
    the columns the summaries read, the department counts and the one aggregate behind all
    rankings are each written down once (``persist``) as stored tables, which nobody has to
    release.  Drill-down tables name the path of each category in ``Jerarquía``.
    """
    store = stored if persist else as_is
    wanted = [
        c.PUB,
        c.YEAR,
        c.PUBLIC_TYPE,
        c.PUBLIC_SUBTYPE,
        c.POSTGRAD_DETAIL,
    ]
    scope = faceted(publications, bridges, selection)
    scope = store(scope.select(*[x for x in wanted if x in scope.columns]))
    others = selection.include_others
    regions = store(department_summary(scope, territory, departments))
    out = {
        "filtradas": scope,
        "tipo": simple_summary(scope, c.PUBLIC_TYPE),
        "subtipo": drilldown_summary(scope, publications, chart_type, c.PUBLIC_SUBTYPE),
        "serie": year_series(scope),
        "departamentos": regions,
        "departamentos_principales": top_k(regions, c.DEP_NAME, top),
        "mapa": publications_on_map(territory, scope),
    }
    if chart_type:
        out["subtipo"] = out["subtipo"].withColumn(PATH, t.path_label(chart_type, F.col(c.PUBLIC_SUBTYPE)))
    if c.POSTGRAD_DETAIL in scope.columns:
        details = drilldown_summary(scope, publications, chart_type, c.POSTGRAD_DETAIL, fv.POSTGRAD_THESIS)
        path = t.path_label(fv.THESIS, fv.POSTGRAD_THESIS, F.col(c.POSTGRAD_DETAIL))
        out["detalle_posgrado"] = details.withColumn(PATH, path)
    sources = _ranking_sources(bridges, repository_class)
    if sources:
        ranked = store(rankings(sources, scope, others))
        out |= {name: one_ranking(ranked, name) for name in sources}
    if "repositorio" in out:
        out["repositorio"] = out["repositorio"].withColumn(
            PATH, t.path_label(repository_class, F.col(c.CATEGORY))
        )
    if "area" in bridges and "repositorio_clase" in bridges:
        out["indicadores"] = kpis(scope, regions, bridges["area"], bridges["repositorio_clase"], others)
    return out


def publications_on_map(territory: DataFrame, scope: DataFrame) -> DataFrame:
    """How many publications in scope have a department, as a number and as a label."""
    rows = territory.filter(F.coalesce(F.col(c.ON_MAP), F.lit(False))).join(
        scope.select(c.PUB), c.PUB, "left_semi"
    )
    return rows.agg(F.count_distinct(c.PUB).alias("publicaciones")).withColumn(
        "etiqueta", t.thousands(F.col("publicaciones"))
    )


def public_export(
    scope: DataFrame, bridges: Mapping[str, DataFrame], territory: DataFrame
) -> DataFrame:
    """Flat public view of the filtered publications.

    Multi-valued relations come as one sorted, ``; ``-joined column each; only
    columns on the public list leave.  All joins are on the publication id.
    """
    flat = scope.join(consolidated_regions(territory, scope), c.PUB, "left")
    for key, out in c.CONSOLIDATED_EXPORT.items():
        if key in bridges:
            flat = flat.join(consolidated_column(bridges[key], scope, out), c.PUB, "left")
        else:
            flat = flat.withColumn(out, F.lit(None).cast("string"))
    return flat.select(*[F.col(f"`{x}`") for x in c.PUBLIC_EXPORT if x in flat.columns])


def export_bundle(
    scope: DataFrame, bridges: Mapping[str, DataFrame], territory: DataFrame, departments: DataFrame
) -> dict[str, DataFrame]:
    """The four tables of a filtered download."""
    return {
        "Datos_filtrados": public_export(scope, bridges, territory),
        "Resumen_tipo": simple_summary(scope, c.PUBLIC_TYPE),
        "Resumen_region": department_summary(scope, territory, departments),
        "Detalle_territorial": territorial_detail(territory, scope),
    }
