"""Document-type audit, decisions and the postgraduate hierarchy."""

from __future__ import annotations

from datetime import datetime

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from folium import columns as c
from folium import fixed_values as fv
from folium.functions import text as t
from folium.functions.rules import bind
from folium.operators.checks import join_covering, join_many_to_one, raise_when, require_columns, unique_by
from folium.operators.classify import binary_type, postgraduate_detail, propose_types
from folium.operators.profile import union_all
from folium.operators.summaries import indicator_rows, value_counts
from folium.session import stored
from folium.sources.tables import append_trace, committed

AUDIT_COLUMNS = [
    c.PUB,
    c.RAW_TYPE,
    c.RAW_LEVEL,
    c.PUBLIC_TYPE,
    c.PUBLIC_SUBTYPE,
    c.TITLE,
    c.JOURNAL,
    c.REPOSITORY,
    c.DOI,
    c.VOLUME,
    c.ISSUE,
    c.URL,
]
AUDIT_COUNT = "PUBLICACIONES"


def audit_types(publications: DataFrame) -> DataFrame:
    """The full audit: source columns, proposal and change flags. The source is not changed."""
    require_columns(publications, AUDIT_COLUMNS, c.T_PUBLICATIONS)
    return bind(propose_types(publications.select(*[F.col(f"`{x}`") for x in AUDIT_COLUMNS])), change_flags())


def change_flags() -> dict:
    """Does the proposal change the type or subtype; is the title empty."""
    blank = F.lit("")
    return {
        "CAMBIO_TIPO": F.coalesce(F.col(c.PUBLIC_TYPE), blank) != F.col(c.PROPOSED_TYPE),
        "CAMBIO_SUBTIPO": F.coalesce(F.col(c.PUBLIC_SUBTYPE), blank) != F.col(c.PROPOSED_SUBTYPE),
        "TITULO_VACIO": ~t.is_present(F.col(c.TITLE)),
    }


def audit_indicators(audit: DataFrame) -> DataFrame:
    """Nine quality indicators from one pass over the audit."""
    row = audit.agg(
        F.count(F.lit(1)).alias("Publicaciones auditadas"),
        F.count_distinct(F.col(c.RAW_TYPE)).alias("Tipos originales distintos"),
        F.count_if("TITULO_VACIO").alias("Títulos vacíos"),
        F.count_if("CAMBIO_TIPO").alias("Cambios de tipo candidatos"),
        F.count_if("CAMBIO_SUBTIPO").alias("Cambios de subtipo candidatos"),
        F.count_if(F.col(c.NEEDS_REVIEW) == "SI").alias("Revisión manual requerida"),
        F.count_if(F.col(c.CONFIDENCE) == "Alta").alias("Confianza alta"),
        F.count_if(F.col(c.CONFIDENCE) == "Media").alias("Confianza media"),
        F.count_if(F.col(c.CONFIDENCE) == "Baja").alias("Confianza baja"),
    )
    return indicator_rows(row, "INDICADOR", "VALOR")


def manual_review(audit: DataFrame) -> DataFrame:
    return audit.filter(F.col(c.NEEDS_REVIEW) == "SI")


def type_audit_report(audit: DataFrame) -> dict[str, DataFrame]:
    """The seven tables of the audit, from the full audit of :func:`audit_types`.

    Hand in the audit as a written or persisted table: six tables aggregate it and
    classification should run once.
    """
    spark = audit.sparkSession
    return {
        "INDICADORES": audit_indicators(audit),
        "CLASIFICACION_ACTUAL": value_counts(audit, c.PUBLIC_TYPE, c.PUBLIC_SUBTYPE, count=AUDIT_COUNT),
        "CLASIFICACION_PROPUESTA": value_counts(
            audit, c.PROPOSED_TYPE, c.PROPOSED_SUBTYPE, c.CONFIDENCE, count=AUDIT_COUNT
        ),
        "RESUMEN_REGLAS": value_counts(audit, c.RULE, c.NEEDS_REVIEW, count=AUDIT_COUNT),
        "REGLAS": spark.createDataFrame(fv.AUDIT_PRINCIPLES, "REGLA string, DESCRIPCION string"),
        "REVISION_MANUAL": manual_review(audit),
        "AUDITORIA_COMPLETA": audit,
    }


# --------------------------------------------------------------------------
# Decisions
# --------------------------------------------------------------------------
def build_decisions(audit: DataFrame, group_events: bool = False) -> DataFrame:
    """Decision per publication; fails on missing or repeated ids and on empty decisions."""
    require_columns(audit, [c.PUB, c.PROPOSED_TYPE, c.PROPOSED_SUBTYPE], "audit")
    decisions = audit.select(c.PUB, c.PROPOSED_TYPE, c.PROPOSED_SUBTYPE)
    if group_events:
        event = F.coalesce(F.col(c.PROPOSED_TYPE) == fv.EVENT_PUBLICATION, F.lit(False)) | F.coalesce(
            F.col(c.PROPOSED_SUBTYPE).isin(fv.EVENT_SUBTYPES[:2]), F.lit(False)
        )
        decisions = decisions.select(
            c.PUB,
            F.when(event, fv.ARTICLE).otherwise(F.col(c.PROPOSED_TYPE)).alias(c.PROPOSED_TYPE),
            F.when(event, fv.EVENT_PUBLICATION).otherwise(F.col(c.PROPOSED_SUBTYPE)).alias(c.PROPOSED_SUBTYPE),
        )
    decisions = decisions.withColumn(
        c.PROPOSED_SUBTYPE,
        t.recode(F.col(c.PROPOSED_SUBTYPE), {fv.POSTGRAD_UNSPECIFIED: fv.POSTGRAD_THESIS}),
    )
    decisions = raise_when(decisions, F.col(c.PUB).isNull(), "the audit has rows without an id")
    decisions = unique_by(decisions, [c.PUB], "the audit repeats an id")
    empty = F.col(c.PROPOSED_TYPE).isNull() | F.col(c.PROPOSED_SUBTYPE).isNull()
    return raise_when(decisions, empty, "a decision lacks type or subtype")


def apply_decisions(publications: DataFrame, decisions: DataFrame) -> DataFrame:
    """Overwrite type and subtype; every publication needs a decision and every decision a publication."""
    require_columns(publications, [c.PUB, c.PUBLIC_TYPE, c.PUBLIC_SUBTYPE], c.T_PUBLICATIONS)
    joined = join_covering(
        publications,
        decisions.select(c.PUB, c.PROPOSED_TYPE, c.PROPOSED_SUBTYPE),
        [c.PUB],
        "publications and decisions do not cover each other",
    )
    return joined.withColumns(
        {c.PUBLIC_TYPE: F.col(c.PROPOSED_TYPE), c.PUBLIC_SUBTYPE: F.col(c.PROPOSED_SUBTYPE)}
    ).select(*[F.col(f"`{x}`") for x in publications.columns])


def decision_trace(decisions: DataFrame, master: str = "", audit: str = "") -> DataFrame:
    """Trace of an application: when, from what, how many, and the types decided."""
    spark = decisions.sparkSession
    schema = "INDICADOR string, VALOR string"
    head = spark.createDataFrame(
        [
            ("fecha_aplicacion", datetime.now().isoformat(timespec="seconds")),
            ("maestro_origen", master),
            ("auditoria_origen", audit),
        ],
        schema,
    )
    updated = indicator_rows(
        decisions.agg(F.count(F.lit(1)).alias("publicaciones_actualizadas")), "INDICADOR", "VALOR"
    )
    columns = spark.createDataFrame(
        [("columnas_actualizadas", f"{c.PUBLIC_TYPE}; {c.PUBLIC_SUBTYPE}")], schema
    )
    types = value_counts(decisions, c.PROPOSED_TYPE, keep_null=False).select(
        F.concat(F.lit("tipo_"), F.col(c.PROPOSED_TYPE)).alias("INDICADOR"), F.col(c.COUNT).alias("VALOR")
    )
    return union_all(
        [x.select("INDICADOR", F.col("VALOR").cast("string").alias("VALOR")) for x in (head, updated, columns, types)]
    )


# --------------------------------------------------------------------------
# Postgraduate hierarchy
# --------------------------------------------------------------------------
def apply_postgraduate_hierarchy(publications: DataFrame) -> DataFrame:
    """Detail, subtype and level of postgraduate theses."""

    def source(name: str):
        return F.col(f"`{name}`") if name in publications.columns else F.lit(None).cast("string")

    detail = postgraduate_detail(*[source(n) for n in (c.PUBLIC_TYPE, c.PUBLIC_SUBTYPE, c.LEVEL, c.SUMMARY)])
    marked = publications.withColumn(c.POSTGRAD_DETAIL, detail)
    detail = F.col(c.POSTGRAD_DETAIL)
    level = (
        F.when(detail == fv.MASTER_THESIS, "Maestría")
        .when(detail == fv.DOCTORAL_THESIS, "Doctorado")
        .when(detail == fv.NOT_IDENTIFIED, fv.LEVEL_NOT_IDENTIFIED)
        .otherwise(source(c.LEVEL))
    )
    return marked.withColumns(
        {
            c.PUBLIC_SUBTYPE: F.when(detail.isNotNull(), fv.POSTGRAD_THESIS).otherwise(F.col(c.PUBLIC_SUBTYPE)),
            c.LEVEL: level,
        }
    )


def run_type_decisions(
    publications: DataFrame, audit: DataFrame, root: str, run: str, group_events: bool = False, hierarchy: bool = True
) -> str:
    """Apply the audit's decisions, and the postgraduate hierarchy, and leave one trace a run.

    Writes ``tipos=<run>/BD_APP`` and the decisions, then the run's trace under
    ``TRAZABILIDAD_TIPOS``.  A run whose trace is committed writes nothing when repeated.
    """
    spark = publications.sparkSession
    out, traces = f"{root.rstrip('/')}/tipos={run}", f"{root.rstrip('/')}/{c.T_TRACE}"
    if committed(spark, f"{traces}/run={run}"):
        return out
    decisions = stored(build_decisions(audit, group_events))
    updated = apply_decisions(publications, decisions)
    if hierarchy:
        updated = apply_postgraduate_hierarchy(updated)
    updated.write.mode("overwrite").parquet(f"{out}/{c.T_PUBLICATIONS}")
    updated = spark.read.parquet(f"{out}/{c.T_PUBLICATIONS}")
    trace = decision_trace(decisions, f"{root.rstrip('/')}/{c.T_PUBLICATIONS}", run)
    if hierarchy:
        decisions = merge_hierarchy(decisions, updated)
        trace = trace.unionByName(hierarchy_trace(updated))
    decisions.write.mode("overwrite").parquet(f"{out}/DECISIONES")
    append_trace(trace, traces, run)
    return out


def unexpected_distribution(df: DataFrame, column: str, expected: dict[str, int]) -> DataFrame:
    """Values whose count differs from the expected one, missing and extra values included."""
    spark = df.sparkSession
    wanted = spark.createDataFrame(list(expected.items()), f"`{column}` string, esperado long")
    actual = (
        df.filter(F.col(column).isNotNull()).groupBy(column).agg(F.count(F.lit(1)).alias("obtenido"))
    )
    return actual.join(wanted, column, "full_outer").filter(~F.col("esperado").eqNullSafe(F.col("obtenido")))


def merge_hierarchy(decisions: DataFrame, publications: DataFrame) -> DataFrame:
    """Decisions with the type, subtype and detail of the updated publications."""
    updates = publications.select(c.PUB, c.PUBLIC_TYPE, c.PUBLIC_SUBTYPE, c.POSTGRAD_DETAIL).withColumnsRenamed(
        {c.PUBLIC_TYPE: c.PROPOSED_TYPE, c.PUBLIC_SUBTYPE: c.PROPOSED_SUBTYPE}
    )
    kept = decisions.drop(c.PROPOSED_TYPE, c.PROPOSED_SUBTYPE, c.POSTGRAD_DETAIL)
    return join_many_to_one(kept, updates, [c.PUB], "left", "publications repeat an id")


def hierarchy_trace(publications: DataFrame) -> DataFrame:
    spark = publications.sparkSession
    head = spark.createDataFrame(
        [("jerarquia_posgrado_aplicada", datetime.now().isoformat(timespec="seconds"))],
        "INDICADOR string, VALOR string",
    )
    counts = value_counts(publications, c.POSTGRAD_DETAIL, keep_null=False).select(
        F.concat(F.lit("detalle_posgrado_"), F.col(c.POSTGRAD_DETAIL)).alias("INDICADOR"),
        F.col(c.COUNT).cast("string").alias("VALOR"),
    )
    return head.unionByName(counts)


# --------------------------------------------------------------------------
# Binary type
# --------------------------------------------------------------------------
def with_binary_type(df: DataFrame, source: str = c.RAW_TYPE) -> DataFrame:
    require_columns(df, [source])
    return df.withColumn(c.BINARY_TYPE, binary_type(F.col(f"`{source}`")))


def binary_type_counts(df: DataFrame) -> DataFrame:
    """Both labels with their rows, zero included."""
    row = df.agg(
        F.count_if(F.col(c.BINARY_TYPE) == fv.THESIS).alias(fv.THESIS),
        F.count_if(F.col(c.BINARY_TYPE) == fv.SCIENTIFIC_ARTICLE).alias(fv.SCIENTIFIC_ARTICLE),
    )
    return indicator_rows(row, c.BINARY_TYPE, "conteo")
