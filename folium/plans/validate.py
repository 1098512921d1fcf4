"""Data-quality job over a catalogue: one control row per constraint.

Everything that shows in a row is counted in one scan a table, all keys in one aggregate and
all references to publications in another (:mod:`folium.operators.controls`).  Nothing is
collected.
"""

from __future__ import annotations

from collections.abc import Mapping
from dataclasses import dataclass, field

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from folium import columns as c
from folium import fixed_values as fv
from folium.functions import text as t
from folium.operators.controls import ERROR, Controls
from folium.operators.profile import group_size_mismatches, inconsistent_representatives

REQUIRED_TABLES = [
    c.T_PUBLICATIONS,
    c.T_RECORDS,
    c.T_RECORD_MAP,
    c.T_REVIEWED,
    c.T_ACADEMIC_AUDIT,
    c.T_INSTITUTION_AUDIT,
    c.T_REPOSITORY_AUDIT,
    c.T_ID_REGISTRY,
    c.T_ID_MERGES,
    *c.DIMENSIONS,
    c.T_MAP,
    c.T_TERRITORY,
]

REQUIRED_COLUMNS = {
    c.T_PUBLICATIONS: c.REQUIRED_MAIN,
    **{name: [c.PUB, c.CATEGORY] for name in c.DIMENSIONS},
    c.DIM_REPOSITORIES: [
        c.PUB,
        c.CATEGORY,
        c.REPO_PUBLIC_CLASS,
        c.REPO_PUBLIC_RULE,
        c.REPO_PUBLIC_REVIEW,
        c.REPO_CLASS,
        c.REPO_IS_UNIVERSITY,
    ],
    c.DIM_INSTITUTIONS: [
        c.PUB,
        c.CATEGORY,
        c.INST_CLASS,
        c.INST_IS_UNIVERSITY,
        c.INST_PUBLIC_CLASS,
        c.INST_PUBLIC_SUBCLASS,
    ],
    c.T_INSTITUTION_AUDIT: [c.RECORD, "INSTITUCION_ORIGINAL", "REVISTA_FINAL", "INSTITUCION_FINAL"],
    c.T_REPOSITORY_AUDIT: [
        c.PUB,
        c.REQUEST_OLD,
        c.REQUEST_NEW,
        c.REQUEST_CLASS,
        "CLASE_PUBLICA_ANTERIOR",
        "CLASE_PUBLICA_FINAL",
        c.RULE,
    ],
}


@dataclass(frozen=True)
class Expectations:
    """Expected values of a snapshot; ``None`` skips a check."""

    publications: int | None = fv.EXPECTED_PUBLICATIONS
    records: int | None = fv.EXPECTED_RECORDS
    repository_decisions: int | None = fv.EXPECTED_REPOSITORY_DECISIONS
    postgraduate: Mapping[str, int] | None = field(default_factory=lambda: dict(fv.EXPECTED_POSTGRAD))
    events: int | None = fv.EXPECTED_EVENTS
    repository_rules: list[str] | None = field(default_factory=lambda: list(fv.REPOSITORY_REQUEST_RULES))


def structure_controls(spark: SparkSession, tables: Mapping[str, DataFrame]) -> DataFrame:
    """Required tables and columns; compares names only, so no data is read."""
    rows = []
    for name in REQUIRED_TABLES:
        present = name in tables
        rows.append((f"Tabla {name}", "OK" if present else ERROR, int(not present), "Tabla requerida"))
        if present:
            missing = [x for x in REQUIRED_COLUMNS.get(name, []) if x not in tables[name].columns]
            rows.append(
                (
                    f"Columnas {name}",
                    ERROR if missing else "OK",
                    len(missing),
                    "Faltan: " + ", ".join(missing) if missing else "Columnas requeridas",
                )
            )
    return spark.createDataFrame(rows, "control string, resultado string, cantidad long, detalle string")


def row_controls(df: DataFrame, predicates: Mapping[str, Column]) -> DataFrame:
    """Rows that break each predicate, all counted in one pass."""
    row = df.agg(*[F.count_if(F.coalesce(bad, F.lit(False))).alias(n) for n, bad in predicates.items()])
    pairs = [F.struct(F.lit(n).alias("control"), F.col(f"`{n}`").alias("cantidad")) for n in predicates]
    return row.select(F.inline(F.array(*pairs))).select(
        "control",
        F.when(F.col("cantidad") == 0, "OK").otherwise(ERROR).alias("resultado"),
        "cantidad",
        F.lit("Filas que incumplen").alias("detalle"),
    )


def missing_values(df: DataFrame, column: str, required: list[str]) -> DataFrame:
    """Required values that never occur; one pass, one flag per value."""
    flags = df.agg(
        *[F.coalesce(F.bool_or(F.col(f"`{column}`") == v), F.lit(False)).alias(f"v{i}") for i, v in enumerate(required)]
    )
    pairs = [F.struct(F.lit(v).alias(column), F.col(f"v{i}").alias("found")) for i, v in enumerate(required)]
    return flags.select(F.inline(F.array(*pairs))).filter(~F.col("found")).select(column)


def publication_controls(out: Controls, df: DataFrame, expected: Expectations) -> None:
    subtype, detail = F.col(c.PUBLIC_SUBTYPE), F.col(c.POSTGRAD_DETAIL)
    postgraduate = F.coalesce(subtype == fv.POSTGRAD_THESIS, F.lit(False))
    thesis = F.col(c.TYPE_NORM) == fv.THESIS
    out.key_without_nulls(f"Clave {c.PUB}", df, c.PUB)
    out.key_without_nulls(f"Clave {c.FINGERPRINT}", df, c.FINGERPRINT)
    out.domain("Tipo público", df, c.PUBLIC_TYPE, fv.PUBLIC_TYPES, exact=True)
    out.domain("Subtipo público", df, c.PUBLIC_SUBTYPE, fv.PUBLIC_SUBTYPES)
    out.domain(
        "Detalle de posgrado", df, c.POSTGRAD_DETAIL, fv.EXPECTED_POSTGRAD, exact=True, within=postgraduate
    )
    out.none("Subtipo ausente", df, subtype.isNull())
    out.none("Detalle fuera de posgrado", df, ~postgraduate & detail.isNotNull())
    not_thesis = ~F.coalesce(thesis, F.lit(False))
    out.none(
        "Grado o nivel fuera de tesis", df, not_thesis & (F.col(c.GRADE).isNotNull() | F.col(c.LEVEL).isNotNull())
    )
    out.none("Grado de tesis", df, thesis & ~F.col(c.GRADE).isin(fv.PUBLIC_GRADES))
    out.none("Nivel de tesis", df, thesis & ~F.col(c.LEVEL).isin(fv.PUBLIC_LEVELS))
    if c.DATABASE in df.columns:
        out.none("Prefijo numérico en base", df, t.has_numeric_prefix(F.col(c.DATABASE)))
    if expected.publications is not None:
        out.total("Total de publicaciones", df, expected.publications)
    if expected.postgraduate is not None:
        out.distribution(
            "Distribución de posgrado",
            df,
            c.POSTGRAD_DETAIL,
            expected.postgraduate,
            "Detalles con conteo inesperado",
            within=postgraduate,
        )
    if expected.events is not None:
        out.total("Publicaciones de evento", df, expected.events, subtype == fv.EVENT_PUBLICATION)


def record_controls(out: Controls, tables: Mapping[str, DataFrame], expected: Expectations) -> None:
    publications = tables[c.T_PUBLICATIONS]
    if c.T_ID_REGISTRY in tables:
        registry = tables[c.T_ID_REGISTRY]
        out.key("Clave de identidad", registry, [c.IDENTITY_KEY])
        out.reference(
            "Registro maestro cubre publicaciones", publications, registry, c.PUB, "Publicaciones sin clave"
        )
    if c.T_RECORDS in tables:
        out.key("Clave de registros", tables[c.T_RECORDS], [c.RECORD])
        if expected.records is not None:
            out.total("Total de registros", tables[c.T_RECORDS], expected.records)
    if c.T_RECORD_MAP in tables:
        record_map = tables[c.T_RECORD_MAP]
        out.key("Clave de la relación", record_map, [c.RECORD])
        out.same_keys("Relación cubre publicaciones", record_map, publications, c.PUB, "Claves en un solo lado")
        if expected.records is not None:
            out.total("Total de la relación", record_map, expected.records)
        if c.GROUP_SIZE in publications.columns:
            out.no_row("Tamaño de grupo", group_size_mismatches(publications, record_map), "No coincide con la relación")
        if c.REPRESENTATIVE in record_map.columns:
            out.no_row("Representante", inconsistent_representatives(record_map), "Representante inconsistente")


def bridge_controls(out: Controls, name: str, bridge: DataFrame, publications: DataFrame) -> None:
    out.key(f"{name} sin duplicados", bridge, [c.PUB, c.CATEGORY], "Relaciones repetidas")
    out.reference(f"{name} sin huérfanos", bridge, publications, c.PUB, "Publicaciones inexistentes")
    if name == c.DIM_REPOSITORIES:
        public = F.col(c.REPO_PUBLIC_CLASS)
        out.domain("Clase técnica de repositorio", bridge, c.REPO_CLASS, fv.REPOSITORY_CLASSES)
        out.domain("Repositorio universitario", bridge, c.REPO_IS_UNIVERSITY, fv.UNIVERSITY_FLAGS)
        out.domain(
            "Clase pública de repositorio", bridge, c.REPO_PUBLIC_CLASS, fv.PUBLIC_REPOSITORY_CLASSES, exact=True
        )
        out.domain("Revisión de repositorio", bridge, c.REPO_PUBLIC_REVIEW, fv.REVIEW_FLAGS)
        out.none(
            "Pendientes permanecen en Otros",
            bridge,
            (F.col(c.REPO_PUBLIC_REVIEW) == "Si") & ~F.coalesce(public == fv.OTHERS, F.lit(False)),
        )
        category = t.unicode_trim(F.col(c.CATEGORY))
        out.no_value(
            "Solo Otros queda en la clase Otros",
            bridge,
            category,
            (public == fv.OTHERS) & (category != fv.OTHERS),
            "Fuentes identificables en Otros",
        )
    if name == c.DIM_INSTITUTIONS:
        out.domain("Clase técnica de institución", bridge, c.INST_CLASS, fv.INSTITUTION_CLASSES)
        out.domain("Es universidad", bridge, c.INST_IS_UNIVERSITY, fv.UNIVERSITY_FLAGS)
        out.domain("Clase pública de institución", bridge, c.INST_PUBLIC_CLASS, fv.PUBLIC_INSTITUTION_CLASSES)
        out.domain("Subclase universitaria", bridge, c.INST_PUBLIC_SUBCLASS, fv.UNIVERSITY_SUBCLASSES)
        out.required(
            "Clases públicas principales",
            bridge,
            c.INST_PUBLIC_CLASS,
            fv.REQUIRED_PUBLIC_INSTITUTION_CLASSES,
            "Clases requeridas ausentes",
        )
        out.none("Sin revistas mal ubicadas", bridge, F.col(c.INST_CLASS) == fv.INST_JOURNAL)


def requests_not_reflected(audit: DataFrame, bridge: DataFrame) -> DataFrame:
    """Audited requests whose new name does not carry the requested class."""
    carried = bridge.select(
        c.PUB, F.col(c.CATEGORY).alias(c.REQUEST_NEW), F.col(c.REPO_PUBLIC_CLASS).alias("_carried")
    )
    return audit.join(carried, [c.PUB, c.REQUEST_NEW], "left").filter(
        ~F.coalesce(F.col("_carried") == F.col(c.REQUEST_CLASS), F.lit(False))
    )


def repository_audit_controls(out: Controls, tables: Mapping[str, DataFrame], expected: Expectations) -> None:
    audit = tables[c.T_REPOSITORY_AUDIT]
    out.key("Clave de decisiones de repositorio", audit, [c.PUB])
    out.none("Otros no se reclasifica", audit, t.is_others(F.col(c.REQUEST_OLD)))
    if expected.repository_decisions is not None:
        out.total("Total de decisiones de repositorio", audit, expected.repository_decisions)
    if expected.repository_rules is not None:
        out.domain("Regla de repositorio", audit, c.RULE, expected.repository_rules)
    if c.DIM_REPOSITORIES in tables:
        out.no_row(
            "Solicitudes reflejadas",
            requests_not_reflected(audit, tables[c.DIM_REPOSITORIES]),
            "Nombre o clase no coincide",
        )


def validate(
    spark: SparkSession, tables: Mapping[str, DataFrame], expected: Expectations | None = None
) -> DataFrame:
    """Control table ``(control, resultado, cantidad, detalle)`` of a catalogue.

    Tables with missing columns are reported by the structure rows and skipped by
    the rest, so one broken table does not hide the state of the others.  Publications are
    scanned five times at most (marks, two keys, references, group sizes), each time for
    the columns concerned; every other table twice to four times.
    """
    expected = expected or Expectations()

    def usable(name: str) -> bool:
        return name in tables and all(x in tables[name].columns for x in REQUIRED_COLUMNS.get(name, []))

    out = Controls(spark)
    if usable(c.T_PUBLICATIONS):
        publications = tables[c.T_PUBLICATIONS]
        publication_controls(out, publications, expected)
        record_controls(out, tables, expected)
        for name in c.DIMENSIONS:
            if usable(name):
                bridge_controls(out, name, tables[name], publications)
        if usable(c.T_REPOSITORY_AUDIT):
            repository_audit_controls(out, tables, expected)
        if c.T_TERRITORY in tables:
            out.reference(
                f"{c.T_TERRITORY} sin huérfanos", tables[c.T_TERRITORY], publications, c.PUB, "Publicaciones inexistentes"
            )
    return structure_controls(spark, tables).unionByName(out.rows())


class ValidationError(AssertionError):
    """A catalogue breaks its contract."""


def assert_valid(controls: DataFrame) -> None:
    """Raise when any control is not OK, naming every one that isn't.

    The table has one row per control of the contract, whatever the catalogue's size.
    """
    failed = controls.filter(F.col("resultado") == ERROR).orderBy("control").collect()
    if failed:
        raise ValidationError("; ".join(f"{r['control']}: {r['cantidad']} ({r['detalle']})" for r in failed))
