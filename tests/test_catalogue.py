"""The whole run on the synthetic catalogue, its dashboard, export and validation."""

import pytest
from pyspark.errors import PySparkException
from pyspark.sql import functions as F

import catalogue
from folium import columns as c
from folium import fixed_values as fv
from folium.operators.facets import Selection, facet_options, faceted
from folium.operators.profile import catalogue_audit, column_profile
from folium.plans import consolidate as L
from folium.plans import dashboard as D
from folium.plans import public_base as U
from folium.plans import types as Y
from folium.plans.validate import Expectations, ValidationError, assert_valid, validate
from folium.sources import snapshots, tables

LOOSE = Expectations(None, None, None, None, None)


@pytest.fixture(scope="module")
def snapshot(spark, tmp_path_factory):
    return L.run_consolidation(catalogue.inputs(spark), str(tmp_path_factory.mktemp("base")), "20260702_000000")


@pytest.fixture(scope="module")
def found(spark, snapshot):
    return tables.read_snapshot(spark, snapshot)


def by_pub(df, *columns):
    return {r[c.PUB]: tuple(r[x] for x in columns) if len(columns) > 1 else r[columns[0]] for r in df.collect()}


def test_publications(found):
    pubs = found[c.T_PUBLICATIONS]
    assert pubs.count() == 9
    assert pubs.columns[:5] == [c.PUB, c.REPRESENTATIVE, c.GROUP_SIZE, c.GROUP_RULES, c.STATE]
    databases = by_pub(pubs, c.DATABASE)
    assert databases["P1"] == "Zeta; Alfa"  # order of first appearance, prefixes removed
    assert databases["P2"] == "Alfa; Cóndor"
    rows = by_pub(pubs, c.RECORD, c.PUBLIC_TYPE, c.PUBLIC_SUBTYPE, c.UNIQUE_FLAG)
    assert rows["P1"] == ("R02", "Artículo", fv.SCIENTIFIC_ARTICLE, "SI")
    assert rows["P4"] == ("R08", "Artículo", fv.EVENT_PUBLICATION, "SI")
    assert rows["P2"] == ("R04", "Tesis", "Tesis de posgrado", "SI")
    grades = by_pub(pubs, c.GRADE, c.LEVEL)
    assert grades["P2"] == ("Posgrado", "Maestría")
    assert grades["P3"] == ("Posgrado", "Doctorado")  # any thesis record of the group counts
    assert grades["P6"] == ("Otros", "Otros")
    assert grades["P7"] == ("Posgrado", "Otros")
    assert grades["P8"] == ("Pregrado", "Suficiencia profesional")
    assert grades["P1"] == (None, None)
    assert by_pub(pubs, c.FINGERPRINT)["P9"] == "hP9"


def test_audits(found):
    conflict = found[c.T_ACADEMIC_AUDIT].collect()
    assert [(r[c.PUB], r["VALORES_ORIGEN"], r["TIPO_CONFLICTO"]) for r in conflict] == [
        ("P2", "Maestría | Pregrado", "grados_contradictorios")
    ]
    moved = {r[c.RECORD]: r for r in found[c.T_INSTITUTION_AUDIT].collect()}
    assert set(moved) == {"R08", "R09"}
    assert moved["R08"]["INSTITUCION_FINAL"] == "Sociedad Geográfica de Lima"
    assert moved["R08"]["REVISTA_FINAL"] == "Boletín de la Sociedad Geográfica de Lima"
    assert (moved["R09"]["INSTITUCION_FINAL"], moved["R09"]["REVISTA_FINAL"]) == ("Otros", "Rev B")
    requests = {r[c.PUB]: r for r in found[c.T_REPOSITORY_AUDIT].collect()}
    assert requests["P3"]["CLASE_PUBLICA_ANTERIOR"] == "Otros"
    assert requests["P3"]["CLASE_TECNICA_FINAL"] == fv.REPO_JOURNAL
    assert requests["P5"]["ARCHIVO_DECISION"] == "solicitud.csv"


def test_bridges(found):
    repos = {(r[c.PUB], r[c.CATEGORY]): r for r in found[c.DIM_REPOSITORIES].collect()}
    assert {k for k in repos if k[0] == "P1"} == {("P1", "Scopus"), ("P1", "Alicia")}
    assert repos["P1", "Alicia"][c.CATEGORY_ORDER] == 2 and repos["P1", "Scopus"][c.RECORD] == "R01"
    assert repos["P3", "Portal nuevo"][c.REPO_PUBLIC_CLASS] == "Revistas"
    assert repos["P5", "PeerJ"][c.REPO_CLASS] == fv.REPO_SEARCH
    assert repos["P3", "Otros"][c.REPO_PUBLIC_REVIEW] == "Si"
    institutions = {(r[c.PUB], r[c.CATEGORY]): r[c.INST_CLASS] for r in found[c.DIM_INSTITUTIONS].collect()}
    assert institutions["P4", "Sociedad Geográfica de Lima"] == fv.INST_SOCIETY
    assert len([k for k in institutions if k[0] == "P1"]) == 3
    databases = found[c.DIM_DATABASES].filter(F.col(c.PUB) == "P1").orderBy(c.CATEGORY_ORDER).collect()
    assert [r[c.CATEGORY] for r in databases] == ["Zeta", "Alfa"]


def test_territory_and_summary(found):
    counts = {r[c.DEP_KEY]: r["publicaciones_unicas"] for r in found[c.T_MAP].collect()}
    assert counts == {"ANCASH": 3, "UCAYALI": 4, "TACNA": 0}
    coverage = {r["indicador"]: r["valor"] for r in found[c.T_COVERAGE].collect()}
    assert coverage["publicaciones_consolidadas"] == "9" and coverage["departamentos_con_datos"] == "2"
    summary = {r["indicador"]: r["valor"] for r in found[c.T_SUMMARY].collect()}
    assert len(summary) == 17
    assert summary["registros_origen"] == "13" and summary["registros_redundantes"] == "4"
    assert summary["tesis_con_campos_academicos"] == "6" and summary["articulos_de_conferencia"] == "0"
    assert summary["migraciones_institucion_revista"] == "2" and summary["base_homologada"] == "registros"
    contract = {r["hoja"]: r["clave"] for r in found[c.T_CONTRACT].collect()}
    assert contract[c.T_TERRITORY] == f"{c.PUB} + {c.DEP_KEY}" and contract[c.DIM_AREAS] == f"{c.PUB} + categoria"


def test_dashboard_scenario(found):
    """Load, narrow the years, reset, pick theses, drill down, filter a region, clear."""
    pubs = D.load_publications(found[c.T_PUBLICATIONS])
    bridges = D.load_bridges(found)
    run = lambda sel, **kw: D.dashboard(pubs, bridges, found[c.T_TERRITORY], found[c.T_MAP], sel, persist=False, **kw)
    kpi = lambda out: {r["indicador"]: r["valor"] for r in out["indicadores"].collect()}

    everything = run(Selection())
    assert kpi(everything) == {"publicaciones": 9, "departamentos": 2, "areas_tematicas": 2, "clases_repositorio": 5}
    narrowed = run(Selection(years=(2001, 2010)))
    assert kpi(narrowed)["publicaciones"] == 3
    assert kpi(run(Selection(years=(2001, 2016))))["publicaciones"] == 9  # the full range keeps the undated one
    theses = run(Selection(scalars={c.PUBLIC_TYPE: ["Tesis"]}), chart_type="Tesis", repository_class="Revistas")
    assert {r[c.PUBLIC_SUBTYPE]: r[c.COUNT] for r in theses["subtipo"].collect()}["Tesis de posgrado"] == 3
    assert {r[c.POSTGRAD_DETAIL] for r in theses["detalle_posgrado"].collect()} == set(fv.EXPECTED_POSTGRAD)
    ucayali = Selection(scalars={c.PUBLIC_TYPE: ["Tesis"]}, bridges={"region": ["Ucayali"]})
    options = facet_options(pubs, bridges, ucayali).filter("facet = 'region'").collect()
    assert "Ucayali" in {r["value"] for r in options}
    assert {r[0] for r in faceted(pubs, bridges, ucayali).select(c.PUB).collect()} == {"P2", "P7", "P8"}
    hidden = run(Selection(include_others=False))
    assert kpi(hidden)["clases_repositorio"] == 4
    assert {r[c.CATEGORY] for r in hidden["repositorio_clase"].collect()} == set(fv.PUBLIC_REPOSITORY_CLASSES) - {"Otros"}
    levels = Selection(scalars={c.PUBLIC_TYPE: ["Tesis"], c.LEVEL: ["Maestría"]})
    assert [r[0] for r in faceted(pubs, bridges, levels).select(c.PUB).collect()] == ["P2"]
    # Level facets exist only while theses are selected.
    assert faceted(pubs, bridges, Selection(scalars={c.LEVEL: ["Maestría"]})).count() == 9
    assert faceted(pubs, bridges, Selection(detail=fv.MASTER_THESIS)).count() == 1


def test_export(spark, found, tmp_path):
    pubs, bridges = D.load_publications(found[c.T_PUBLICATIONS]), D.load_bridges(found)
    bundle = D.export_bundle(pubs, bridges, found[c.T_TERRITORY], found[c.T_MAP])
    flat = bundle["Datos_filtrados"]
    assert flat.count() == 9
    assert c.FINGERPRINT not in flat.columns and c.MASTER_KEY not in flat.columns
    row = flat.filter(F.col(c.PUB) == "P3").first()
    assert row[c.CONSOLIDATED_REGIONS] == "Ucayali; Áncash"
    assert row["REPOSITORIOS_CONSOLIDADOS"] == "Otros; Portal nuevo"
    assert bundle["Detalle_territorial"].filter(F.col(c.PUB) == "P3").count() == 2
    tables.write_bundle(bundle, str(tmp_path / "descarga"))
    again = tables.read_table(spark, str(tmp_path / "descarga" / "Datos_filtrados.csv"))
    assert again.count() == 9 and again.columns == flat.columns


def test_good_catalogue_is_valid(spark, found):
    good = dict(found)
    # A mixed group carries thesis fields on a representative that is no thesis: reported, as it should be.
    report = {r["control"]: r["cantidad"] for r in validate(spark, good, LOOSE).collect() if r["resultado"] == "ERROR"}
    assert report == {"Grado o nivel fuera de tesis": 1}
    pubs = good[c.T_PUBLICATIONS]
    thesis = F.col(c.TYPE_NORM) == "Tesis"
    good[c.T_PUBLICATIONS] = pubs.withColumns({x: F.when(thesis, F.col(x)) for x in (c.GRADE, c.LEVEL)})
    assert_valid(validate(spark, good, LOOSE))
    with pytest.raises(ValidationError, match="Total de publicaciones"):
        assert_valid(validate(spark, good, Expectations(records=None, postgraduate=None, events=None)))


def _set(column, value, where):
    return lambda df: df.withColumn(column, F.when(F.expr(where), F.lit(value)).otherwise(F.col(column)))


CORRUPTIONS = [
    (c.T_PUBLICATIONS, lambda df: df.union(df.filter(F.col(c.PUB) == "P1")), f"Clave {c.PUB}"),
    (c.T_PUBLICATIONS, _set(c.FINGERPRINT, None, f"{c.PUB} = 'P1'"), f"Clave {c.FINGERPRINT} (nulos)"),
    (c.T_PUBLICATIONS, _set(c.PUBLIC_TYPE, "Libro", f"{c.PUB} = 'P1'"), "Tipo público"),
    (c.T_PUBLICATIONS, _set(c.PUBLIC_TYPE, "Artículo", "true"), "Tipo público (completo)"),
    (c.T_PUBLICATIONS, _set(c.PUBLIC_SUBTYPE, "Raro", f"{c.PUB} = 'P1'"), "Subtipo público"),
    (c.T_PUBLICATIONS, _set(c.PUBLIC_SUBTYPE, None, f"{c.PUB} = 'P1'"), "Subtipo ausente"),
    (c.T_PUBLICATIONS, _set(c.POSTGRAD_DETAIL, "x", f"{c.PUB} = 'P1'"), "Detalle fuera de posgrado"),
    (c.T_PUBLICATIONS, _set(c.GRADE, "x", f"{c.PUB} = 'P2'"), "Grado de tesis"),
    (c.T_PUBLICATIONS, _set(c.LEVEL, "x", f"{c.PUB} = 'P2'"), "Nivel de tesis"),
    (c.T_PUBLICATIONS, _set(c.DATABASE, "7. Alfa", f"{c.PUB} = 'P2'"), "Prefijo numérico en base"),
    (c.T_PUBLICATIONS, _set(c.GROUP_SIZE, "9", f"{c.PUB} = 'P2'"), "Tamaño de grupo"),
    (c.T_ID_REGISTRY, lambda df: df.filter(F.col(c.PUB) != "P1"), "Registro maestro cubre publicaciones"),
    (c.T_ID_REGISTRY, lambda df: df.union(df), "Clave de identidad"),
    (c.T_RECORDS, lambda df: df.union(df), "Clave de registros"),
    (c.T_RECORD_MAP, lambda df: df.filter(F.col(c.PUB) != "P9"), "Relación cubre publicaciones"),
    (c.T_RECORD_MAP, _set(c.REPRESENTATIVE, "R99", f"{c.RECORD} = 'R01'"), "Representante"),
    (c.DIM_AREAS, lambda df: df.union(df), f"{c.DIM_AREAS} sin duplicados"),
    (c.DIM_AREAS, _set(c.PUB, "P99", f"{c.PUB} = 'P1'"), f"{c.DIM_AREAS} sin huérfanos"),
    (c.DIM_REPOSITORIES, _set(c.REPO_CLASS, "x", f"{c.PUB} = 'P1'"), "Clase técnica de repositorio"),
    (c.DIM_REPOSITORIES, _set(c.REPO_PUBLIC_CLASS, "Revistas", f"{c.REPO_PUBLIC_CLASS} = 'Otros'"), "Pendientes permanecen en Otros"),
    (c.DIM_REPOSITORIES, _set(c.REPO_PUBLIC_CLASS, "Otros", f"{c.PUB} = 'P1'"), "Solo Otros queda en la clase Otros"),
    (c.DIM_REPOSITORIES, _set(c.REPO_PUBLIC_REVIEW, "x", f"{c.PUB} = 'P1'"), "Revisión de repositorio"),
    (c.DIM_REPOSITORIES, _set(c.REPO_PUBLIC_CLASS, "Repositorios institucionales", f"{c.PUB} = 'P5'"), "Solicitudes reflejadas"),
    (c.DIM_INSTITUTIONS, _set(c.INST_CLASS, fv.INST_JOURNAL, f"{c.PUB} = 'P1'"), "Sin revistas mal ubicadas"),
    (c.DIM_INSTITUTIONS, _set(c.INST_PUBLIC_CLASS, "Otros", "true"), "Clases públicas principales"),
    (c.DIM_INSTITUTIONS, _set(c.INST_PUBLIC_SUBCLASS, "x", f"{c.PUB} = 'P1'"), "Subclase universitaria"),
    (c.T_REPOSITORY_AUDIT, _set(c.REQUEST_OLD, " OTROS", f"{c.PUB} = 'P3'"), "Otros no se reclasifica"),
    (c.T_REPOSITORY_AUDIT, _set(c.RULE, "x", f"{c.PUB} = 'P3'"), "Regla de repositorio"),
    (c.T_TERRITORY, _set(c.PUB, "P99", f"{c.PUB} = 'P1'"), f"{c.T_TERRITORY} sin huérfanos"),
]


def test_each_corruption_is_found(spark, found):
    """One run per position: the n-th corruption of every table at once."""
    per_table = {}
    for name, corrupt, control in CORRUPTIONS:
        per_table.setdefault(name, []).append((corrupt, control))
    for turn in range(max(map(len, per_table.values()))):
        broken, wanted = dict(found), set()
        for name, cases in per_table.items():
            if turn < len(cases):
                broken[name] = cases[turn][0](found[name])
                wanted.add(cases[turn][1])
        report = validate(spark, broken, LOOSE)
        failed = {r["control"] for r in report.collect() if r["resultado"] == "ERROR"}
        assert wanted <= failed, wanted - failed


def test_missing_table_and_column(spark, found):
    broken = {k: v for k, v in found.items() if k != c.DIM_AXES}
    broken[c.DIM_REPOSITORIES] = broken[c.DIM_REPOSITORIES].drop(c.REPO_CLASS)
    failed = {r["control"] for r in validate(spark, broken, LOOSE).collect() if r["resultado"] == "ERROR"}
    assert {f"Tabla {c.DIM_AXES}", f"Columnas {c.DIM_REPOSITORIES}"} <= failed


@pytest.mark.parametrize(
    "request_row",
    [
        ("P1", "No existe", "x", "Revistas"),
        ("P3", "OTROS", "x", "Revistas"),
        ("P3", "Blog raro", "x", "Otra"),
        ("P3", "Blog raro", "x", None),
        ("P3", "Blog raro", "Otros", "Revistas"),
    ],
)
def test_bad_requests_raise(spark, found, request_row):
    rows = catalogue.table(spark, [c.PUB, c.REQUEST_OLD, c.REQUEST_NEW, c.REQUEST_CLASS], [request_row])
    bridge = found[c.DIM_REPOSITORIES].withColumn(
        c.CATEGORY, F.when(F.col(c.CATEGORY) == "Portal nuevo", "Blog raro").otherwise(F.col(c.CATEGORY))
    )
    with pytest.raises(PySparkException):
        L.apply_repository_requests(bridge, rows, "r")[0].collect()


def test_request_cannot_repeat_or_match_twice(spark, found):
    columns = [c.PUB, c.REQUEST_OLD, c.REQUEST_NEW, c.REQUEST_CLASS]
    twice = catalogue.table(spark, columns, [("P1", "Scopus", "x", "Revistas"), ("P1", "Alicia", "y", "Revistas")])
    with pytest.raises(PySparkException):
        L.apply_repository_requests(found[c.DIM_REPOSITORIES], twice, "r")[0].collect()
    bridge = found[c.DIM_REPOSITORIES]
    padded = bridge.union(bridge.withColumn(c.CATEGORY, F.concat(F.col(c.CATEGORY), F.lit(" "))))
    one = catalogue.table(spark, columns, [("P1", "Scopus", "x", "Revistas")])
    with pytest.raises(PySparkException):
        L.apply_repository_requests(padded, one, "r")[0].collect()


def test_a_log_of_batches_equals_one_by_one(spark, found):
    columns = [c.PUB, c.REQUEST_OLD, c.REQUEST_NEW, c.REQUEST_CLASS]
    one = catalogue.table(spark, [*columns, "NOTA"], [("P1", "Scopus", "Nuevo", "Revistas", "n1"), ("P2", "UNALM", "Portal", "Buscadores académicos", "n2")])
    two = catalogue.table(spark, columns, [("P1", " Nuevo", "Otro nuevo", "Buscadores académicos"), ("P4", "SERFOR", "Sitio", "Revistas")])
    three = catalogue.table(spark, columns, [("P1", "Alicia", "Scopus", "Revistas")])  # a name that the first batch freed
    bridge = found[c.DIM_REPOSITORIES]
    batches = [(one, "regla 1", "uno.csv"), (two, "regla 2", "dos.csv"), (three, "regla 3", "tres.csv")]
    updated, audit = L.apply_request_log(bridge, batches)
    step, audits = bridge, []
    for requests, rule, source in batches:
        step, part = L.apply_repository_requests(step, requests, rule, source)
        audits.append(part)
    rows = lambda df: sorted(map(str, df.select(sorted(df.columns)).collect()))
    assert rows(updated) == rows(step) and updated.columns == bridge.columns
    whole = audits[0]
    for part in audits[1:]:
        whole = whole.unionByName(part, allowMissingColumns=True)
    assert rows(audit) == rows(whole)
    chain = audit.filter((F.col(c.PUB) == "P1") & (F.col(c.RULE) == "regla 2")).first()
    assert chain["CLASE_PUBLICA_ANTERIOR"] == "Revistas" and chain["NOTA"] is None
    # What one by one refuses, the log refuses.
    for later in [("P1", "Scopus", "x", "Revistas"), ("P1", "Alicia", "Nuevo", "Revistas"), ("P99", "a", "x", "Revistas")]:
        bad = catalogue.table(spark, columns, [later])
        for result in L.apply_request_log(bridge, [batches[0], (bad, "r", "")]):
            with pytest.raises(Exception, match="expected one match|repeats a publication"):
                result.collect()


def test_decisions_and_hierarchy(spark, found):
    pubs = found[c.T_PUBLICATIONS]
    updated = Y.apply_postgraduate_hierarchy(pubs)
    details = by_pub(updated, c.POSTGRAD_DETAIL, c.LEVEL)
    assert details["P7"] == (fv.MASTER_THESIS, "Maestría") and details["P9"] == (fv.DOCTORAL_THESIS, "Doctorado")
    assert details["P6"] == (None, "Otros")
    expected = {fv.MASTER_THESIS: 2, fv.DOCTORAL_THESIS: 1}
    assert Y.unexpected_distribution(updated, c.POSTGRAD_DETAIL, expected).count() == 0
    assert Y.unexpected_distribution(updated, c.POSTGRAD_DETAIL, fv.EXPECTED_POSTGRAD).count() == 3
    decisions = pubs.select(
        c.PUB, F.lit("Artículo").alias(c.PROPOSED_TYPE), F.lit("Artículo de conferencia").alias(c.PROPOSED_SUBTYPE)
    )
    built = Y.build_decisions(decisions, group_events=True)
    assert {r[c.PROPOSED_SUBTYPE] for r in built.collect()} == {fv.EVENT_PUBLICATION}
    assert Y.apply_decisions(pubs, built).count() == 9
    with pytest.raises(PySparkException):
        Y.apply_decisions(pubs, built.filter(F.col(c.PUB) != "P1")).collect()
    with pytest.raises(PySparkException):
        Y.build_decisions(decisions.withColumn(c.PROPOSED_TYPE, F.lit(None).cast("string"))).collect()
    trace = {r["INDICADOR"]: r["VALOR"] for r in Y.decision_trace(built, "m", "a").collect()}
    assert trace["publicaciones_actualizadas"] == "9" and trace["tipo_Artículo"] == "9"
    assert {r[0] for r in Y.hierarchy_trace(updated).collect()} >= {f"detalle_posgrado_{fv.MASTER_THESIS}"}
    merged = Y.merge_hierarchy(built, updated)
    assert merged.columns == [c.PUB, c.PROPOSED_TYPE, c.PROPOSED_SUBTYPE, c.POSTGRAD_DETAIL]


def test_public_base(spark, found):
    records = found[c.T_RECORDS].withColumn(c.UNIQUE_FLAG, F.when(F.col(c.RECORD) == "R01", "NO").otherwise("si"))
    records = records.withColumn(c.MASTER_KEY, F.when(~F.col(c.RECORD).isin("R12", "R13"), F.col(c.MASTER_KEY)))
    keys = records.select(c.RECORD, c.MASTER_KEY)
    territory = catalogue.inputs(spark).territory.join(keys, c.RECORD).withColumn(c.DEP_BASE, F.col(c.DEP_NAME))
    out = U.build_public_base(records, territory, found[c.T_MAP], {"archivo_fuente_app": "x"})
    public = out[c.T_PUBLICATIONS]
    assert {r[c.RECORD] for r in public.collect()} == {"R02", "R04", "R06", "R08", "R09", "R10", "R11", "R12"}
    assert public.filter(F.col(c.RECORD) == "R10").first()[c.INSTITUTION] == "Otros"
    coverage = {r[0]: r[1] for r in out[c.T_COVERAGE].collect()}
    assert coverage["publicaciones_unicas"] == 8 and coverage["departamentos_sin_cruce_geojson"] == 1
    summary = {r[0]: r[1] for r in out["RESUMEN_BASE_PUBLICA"].collect()}
    assert summary["filas_base_original"] == "13" and summary["publicaciones_unicas"] == "7"
    counts = {r[c.DEP_KEY]: r["publicaciones_bibliograficas"] for r in out[c.T_MAP].collect()}
    assert counts == {"ANCASH": 2, "UCAYALI": 3, "TACNA": 0}


def test_audit_tables(spark, found):
    pubs = found[c.T_PUBLICATIONS]
    controls = {r["control"]: (r["resultado"], r["cantidad"]) for r in
                catalogue_audit(pubs, found[c.T_RECORD_MAP], found[c.DIM_REGIONS]).collect()}
    assert controls["Unicidad ID_PUBLICACION_PROPUESTA"] == ("OK", 0)
    assert controls["Publicaciones con múltiples regiones"] == ("ADVERTENCIA", 1)
    assert controls["Región principal no contenida en dimensión"] == ("ERROR", 1)
    profile = {r["campo"]: r for r in column_profile(pubs, [c.PUB, c.LEVEL]).collect()}
    assert profile[c.LEVEL]["vacios"] == 3 and profile[c.LEVEL]["porcentaje_vacios"] == 33.33
    assert profile[c.LEVEL]["valores_frecuentes"].startswith("Doctorado [2] || Otros [2]")


def test_snapshots_and_sources(spark, found, snapshot, tmp_path):
    root = snapshot.rsplit("/", 1)[0]
    assert snapshots.latest_snapshot(spark, root).endswith("snapshot=20260702_000000")
    # A newer one that was never finished has no summary and doesn't count.
    tables.write_snapshot({c.T_PUBLICATIONS: found[c.T_PUBLICATIONS]}, root, "20990101_000000")
    assert snapshots.latest_snapshot(spark, root).endswith("snapshot=20260702_000000")
    assert set(snapshots.table_names(spark, snapshot)) == set(found)
    assert tables.read_optional(spark, snapshot, "NO_EXISTE", [c.PUB, c.ON_MAP]).columns == [c.PUB, c.ON_MAP]
    import os

    for i, name in enumerate(["BD_1.csv", "BD_2_publica_unica.csv", "~$BD_3.csv"]):
        path = tmp_path / name
        path.write_bytes("﻿ a ,b\n1,\"x, y\"\n".encode())
        os.utime(path, (1000 + i, 1000 + i))
    assert snapshots.latest_file(spark, str(tmp_path), "*BD_*.csv").endswith("BD_2_publica_unica.csv")
    chosen = snapshots.latest_file(spark, str(tmp_path), "*BD_*.csv", without="PUBLICA_UNICA")
    assert chosen.endswith("BD_1.csv")
    read = tables.read_table(spark, chosen)
    assert read.columns == ["a", "b"] and read.first()["b"] == "x, y"
    assert snapshots.latest_file(spark, str(tmp_path), "NADA*", required=False) is None
    with pytest.raises(FileNotFoundError):
        snapshots.latest_file(spark, str(tmp_path), "NADA*")
    (tmp_path / "map.geojson").write_text(
        '{"type": "x", "features": [\n {"properties": {"DEPARTAMEN": "Áncash"}}, {"properties": {}}]}', encoding="utf-8"
    )
    features = tables.read_geojson(spark, str(tmp_path / "map.geojson")).collect()
    assert [(r["DEPARTAMEN"], r[c.DEP_KEY]) for r in features] == [("Áncash", "ANCASH"), (None, "")]
    tables.append_trace(spark.createDataFrame([("a", "b")], "indicador string, valor string"), str(tmp_path / "traza"))
    tables.append_trace(spark.createDataFrame([("c", "d")], "indicador string, valor string"), str(tmp_path / "traza"))
    assert tables.read_table(spark, str(tmp_path / "traza")).count() == 2


@pytest.mark.parametrize("suffix", ["csv", "parquet"])
def test_loader_numbers_rows_by_file_and_place(spark, tmp_path, suffix):
    """Files of several sizes, read with tiny splits: the numbers are those of the rows as they stand."""
    want, number = {}, 0
    for f, n in enumerate([300, 1, 0, 700]):
        rows = [(f"{f}-{i}",) for i in range(n)]
        folder = tmp_path / f"part{f}"
        writer = spark.createDataFrame(rows, "v string").coalesce(1).write.option("header", True)
        getattr(writer, suffix)(str(folder))
        for v, in rows:
            number += 1
            want[v] = number
    spark.conf.set("spark.sql.files.maxPartitionBytes", "512")
    try:
        folders = [str(tmp_path / f"part{f}") for f in (0, 1, 3)]
        read = spark.read.format(suffix).option("header", True).load(folders)
        got = {r["v"]: r[c.ORD] for r in tables.with_row_ordinal(read).collect()}
    finally:
        spark.conf.unset("spark.sql.files.maxPartitionBytes")
    assert got == want
