"""Runs from folders alone, their traces, and what a repeated run leaves."""

import json

import pytest
from pyspark.sql import functions as F

import catalogue
from folium import columns as c
from folium.operators import groups as G
from folium.plans import consolidate as L
from folium.plans import types as Y
from folium.sources import manifest, snapshots, tables


def write(df, path):
    """One CSV file with a header, as the inputs come."""
    df.coalesce(1).write.option("header", True).csv(str(path))


@pytest.fixture(scope="module")
def folders(spark, tmp_path_factory):
    root = tmp_path_factory.mktemp("entradas")
    own = catalogue.inputs(spark)
    plain = lambda df: df.drop(c.ORD).coalesce(1)
    write(plain(own.records).limit(2), root / "limpieza/ejecucion_1/DATOS_HOMOLOGADOS.csv")
    diagnosis = root / "deduplicacion/ejecucion_1"
    write(own.record_map, diagnosis / f"{c.T_RECORD_MAP}.csv")
    write(own.reviewed, diagnosis / f"{c.T_REVIEWED}.csv")
    own.proposed_ids.write.parquet(str(diagnosis / "PUBLICACIONES_PROPUESTAS"))
    write(own.id_registry, diagnosis / f"{c.T_ID_REGISTRY}.csv")
    write(own.id_merges, diagnosis / f"{c.T_ID_MERGES}.csv")
    territory = root / "territorio/BD_APP_TERRITORIAL_1_PUBLICA_UNICA"
    write(plain(own.territory.orderBy(c.ORD)), territory / f"{c.T_TERRITORY}.csv")
    write(own.departments, territory / f"{c.T_MAP}.csv")
    previous = root / "tecnicas/BD_APP_FINAL_1_HOMOLOGADA"
    for name, bridge in own.bridges.items():
        plain(bridge.orderBy(c.ORD)).write.parquet(str(previous / name))
    (requests, _, _), = own.requests
    write(requests.limit(1), root / "tecnicas/repositorios_reclasificados_solicitados.csv")
    write(requests.exceptAll(requests.limit(1)), root / "tecnicas/repositorios_reclasificados_evaluacion.csv")
    write(own.type_decisions, root / "tecnicas/clasificacion_tipos_publicacion_auditada.csv")
    # Written last, so this cleaning run is the newest.
    write(plain(own.records.orderBy(c.ORD)), root / "limpieza/ejecucion_2/DATOS_HOMOLOGADOS.csv")
    return root


def test_folders_in_snapshot_and_trace_out_twice(spark, folders, tmp_path):
    out = str(tmp_path / "catalogo")
    chosen = manifest.resolve(spark, str(folders))
    assert chosen.folders["base_homologada"].endswith("limpieza/ejecucion_2")
    assert [rule for _, rule in chosen.requests] == ["REP_SOLICITADA_20260630", "REP_EVALUADA_20260630"]
    one = L.run_from_folders(spark, str(folders), out, "20260101_000000")
    two = L.run_from_folders(spark, str(folders), out, "20260101_000001")
    assert snapshots.latest_snapshot(spark, out).endswith("20260101_000001")
    a, b = tables.read_snapshot(spark, one), tables.read_snapshot(spark, two)
    rows = lambda df: sorted(map(str, df.collect()))
    assert set(a) == set(b) and len(a[c.T_RECORDS].columns) > 5
    for name in a:
        if name != c.T_SUMMARY:
            assert rows(a[name]) == rows(b[name]), name
    # The same rows as a run whose inputs were put together by hand.
    by_hand = L.consolidate(catalogue.inputs(spark))
    pubs = lambda df: sorted(map(str, df.select(c.PUB, c.DATABASE, c.PUBLIC_TYPE, c.PUBLIC_SUBTYPE, c.GRADE).collect()))
    assert pubs(a[c.T_PUBLICATIONS]) == pubs(by_hand[c.T_PUBLICATIONS])
    names = lambda df: sorted(map(str, df.select(c.PUB, c.CATEGORY, c.CATEGORY_ORDER, c.REPO_PUBLIC_RULE).collect()))
    hand = by_hand[c.DIM_REPOSITORIES].withColumn(
        c.REPO_PUBLIC_RULE, F.when(F.col(c.REPO_PUBLIC_RULE).startswith("REP_"), "r").otherwise(F.col(c.REPO_PUBLIC_RULE))
    )
    ours = a[c.DIM_REPOSITORIES].withColumn(
        c.REPO_PUBLIC_RULE, F.when(F.col(c.REPO_PUBLIC_RULE).startswith("REP_"), "r").otherwise(F.col(c.REPO_PUBLIC_RULE))
    )
    assert names(ours) == names(hand)
    # A repeated run writes nothing twice.
    trace = spark.read.parquet(f"{out}/{c.T_RUNS}")
    before = rows(trace)
    assert L.run_from_folders(spark, str(folders), out, "20260101_000000") == one
    assert rows(spark.read.parquet(f"{out}/{c.T_RUNS}")) == before
    told = {r["indicador"]: r["valor"] for r in trace.collect()}
    assert told["registros_origen"] == "13" and told["fuente_base_homologada"].endswith("ejecucion_2")


def test_what_is_missing_is_named(spark, folders, tmp_path):
    with pytest.raises(FileNotFoundError, match="FALTA"):
        manifest.resolve(spark, str(folders), manifest.Layout(records="FALTA"))
    with pytest.raises(FileNotFoundError):
        manifest.resolve(spark, str(tmp_path))
    without = manifest.resolve(spark, str(folders), manifest.Layout(reviewed_types="otro"))
    assert without.reviewed_types is None


def test_a_broken_off_trace_is_replaced(spark, tmp_path):
    path = str(tmp_path / "traza")
    one = spark.createDataFrame([("a", "1")], "indicador string, valor string")
    tables.append_trace(one, path, "r1")
    tables.append_trace(one.union(one), path, "r1")
    assert spark.read.parquet(path).count() == 1
    (tmp_path / "traza/run=r1/_SUCCESS").unlink()
    tables.append_trace(one.union(one), path, "r1")
    tables.append_trace(one, path, "r2")
    assert {(r["run"], r["count"]) for r in spark.read.parquet(path).groupBy("run").count().collect()} == {("r1", 2), ("r2", 1)}


def test_type_runs_leave_one_trace(spark, tmp_path):
    found = L.consolidate(catalogue.inputs(spark))
    pubs = found[c.T_PUBLICATIONS]
    audit = pubs.select(c.PUB, F.col(c.PUBLIC_TYPE).alias(c.PROPOSED_TYPE), F.lit("Tesis de posgrado").alias(c.PROPOSED_SUBTYPE))
    for _ in range(2):
        out = Y.run_type_decisions(pubs, audit, str(tmp_path), "r1")
    assert spark.read.parquet(f"{out}/{c.T_PUBLICATIONS}").count() == 9
    assert c.POSTGRAD_DETAIL in spark.read.parquet(f"{out}/DECISIONES").columns
    trace = spark.read.parquet(f"{tmp_path}/{c.T_TRACE}").collect()
    assert sum(r["INDICADOR"] == "publicaciones_actualizadas" for r in trace) == 1
    assert any(r["INDICADOR"].startswith("detalle_posgrado_") for r in trace)


def test_map_features_round_trip(spark, tmp_path):
    shapes = ['{"type":"Polygon","coordinates":[[[-77.10,-9.000],[1e-7,12345678901234567890.5]]]}', '{"type":"Point","coordinates":[]}']
    features = [f'{{"type":"Feature","properties":{{"DEPARTAMEN":"Áncash","n":{i}.50}},"geometry":{g}}}' for i, g in enumerate(shapes)]
    features.append('{"type":"Feature","properties":{"DEPARTAMEN":null},"geometry":null}')
    path = tmp_path / "map.geojson"
    path.write_text('{"type":"FeatureCollection",\n"features":[' + ",\n".join(features) + "]}", encoding="utf-8")
    table = tables.read_departments(spark, str(path))
    rows = table.orderBy(c.ORD).collect()
    assert [r[c.GEOMETRY] for r in rows] == [*shapes, None]
    assert [r[c.DEP_KEY] for r in rows] == ["ANCASH", "ANCASH", ""]
    tables.write_geojson(table, str(tmp_path / "out"))
    text = [r["value"] for r in spark.read.text(str(tmp_path / "out")).collect()]
    assert text == features and json.loads(text[0])["geometry"]["type"] == "Polygon"


def test_repeated_ordinals_stop_the_job(spark):
    rows = [("a", 1), ("a", 2), ("a", 2), ("b", 2)]
    frame = spark.createDataFrame(rows, "g string, o long")
    with pytest.raises(Exception, match=G.REPEATED):
        G.group_ordinal(frame, ["g"], "o", "n").collect()
    crowded = spark.createDataFrame([("a", 7)] * 5, "g string, o long")
    with pytest.raises(Exception, match=G.REPEATED):
        G.attach_group_head(crowded, ["g"], "o", "first").collect()
    assert G.group_ordinal(frame.distinct(), ["g"], "o", "n").count() == 3
