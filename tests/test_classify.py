"""One case per rule branch, and the names whose class depends on rule order."""

import pytest
from pyspark.sql import functions as F

from folium import columns as c
from folium import fixed_values as fv
from folium.operators import classify as C
from folium.plans import types as Y

INSTITUTIONS = {
    None: (fv.UNCLASSIFIED, "Indeterminado", "Otros", "No aplica"),
    " Otros ": (fv.UNCLASSIFIED, "Indeterminado", "Otros", "No aplica"),
    "Boletín de la Sociedad Geográfica de Lima": (fv.INST_JOURNAL, "No", "Revista / boletín mal ubicado", "No aplica"),
    "Sociedad Geográfica": (fv.INST_SOCIETY, "No", "Centro de investigación / cooperación", "No aplica"),
    "Instituto Nacional de Innovación  Agraria": (fv.INST_STATE, "No", "Instituto público / entidad estatal", "No aplica"),
    "Ministerio de Salud": (fv.INST_STATE, "No", "Instituto público / entidad estatal", "No aplica"),
    "International Institute of Social Studies": (fv.INST_CENTRE, "No", "Centro de investigación / cooperación", "No aplica"),
    "Centro de Datos": (fv.INST_CENTRE, "No", "Centro de investigación / cooperación", "No aplica"),
    "Universidad de Lima": (fv.INST_PRIVATE_UNIVERSITY, "Si", "Universidad nacional", "Privada"),
    "Universidad de Puno": (fv.INST_PUBLIC_UNIVERSITY, "Si", "Universidad nacional", "Pública"),
    "Universidad Nacional Agraria La Molina": (fv.INST_PUBLIC_UNIVERSITY, "Si", "Universidad nacional", "Pública"),
    "Universidad de Chile": (fv.INST_FOREIGN_UNIVERSITY, "Si", "Universidad extranjera", "Extranjera"),
    "Yale University": (fv.INST_FOREIGN_UNIVERSITY, "Si", "Universidad extranjera", "Extranjera"),
    "Pontificia Universidad Nueva": (fv.INST_PRIVATE_UNIVERSITY, "Si", "Universidad nacional", "Privada"),
    "Instituto Nuevo": (fv.INST_CENTRE, "No", "Centro de investigación / cooperación", "No aplica"),
    "Museo": (fv.UNCLASSIFIED, "Indeterminado", "Otros", "No aplica"),
    # Order decides: listed as private and as foreign; the national prefix fires before the foreign list.
    "Universidad Católica de Loja": (fv.INST_PRIVATE_UNIVERSITY, "Si", "Universidad nacional", "Privada"),
    "Universidad Nacional de La Plata": (fv.INST_PUBLIC_UNIVERSITY, "Si", "Universidad nacional", "Pública"),
    "Universidad Nacional del Comahue": (fv.INST_PUBLIC_UNIVERSITY, "Si", "Universidad nacional", "Pública"),
    "Universidad Nacional Dong Hwa": (fv.INST_PUBLIC_UNIVERSITY, "Si", "Universidad nacional", "Pública"),
}

REPOSITORIES = {
    None: (fv.UNCLASSIFIED, "Indeterminado", "Otros"),
    "Repositorio": (fv.UNCLASSIFIED, "Indeterminado", "Otros"),
    "google  scholar": (fv.REPO_SEARCH, "No", "Buscadores académicos"),
    "ResearchGate.": (fv.REPO_NETWORK, "No", "Buscadores académicos"),
    "SciELO": (fv.REPO_AGGREGATOR, "No", "Buscadores académicos"),
    "Scopus": (fv.REPO_INDEX, "No", "Buscadores académicos"),
    "Revista peruana": (fv.REPO_JOURNAL, "No", "Revistas"),
    "Checklist": (fv.REPO_JOURNAL, "No", "Revistas"),
    "Taylor & Francis": (fv.REPO_PUBLISHER, "No", "Revistas"),
    "Digital Library X": (fv.REPO_ARCHIVE, "No", "Repositorios institucionales"),
    "Dominio público": (fv.REPO_ARCHIVE, "No", "Repositorios institucionales"),
    "SERFOR": (fv.REPO_PUBLIC, "No", "Repositorios institucionales"),
    "Pucp": (fv.REPO_UNIVERSITY, "Si", "Repositorios universitarios"),
    "UNALM": (fv.REPO_UNIVERSITY, "Si", "Repositorios universitarios"),
    "Repositorio UX": (fv.REPO_UNIVERSITY, "Si", "Repositorios universitarios"),
    "Universidad X": (fv.REPO_UNIVERSITY, "Si", "Repositorios universitarios"),
    "Blog": (fv.UNCLASSIFIED, "Indeterminado", "Otros"),
    "Wiley Online Library": (fv.REPO_PUBLISHER, "No", "Revistas"),
    "ETH Zurich's Research Collection": (fv.REPO_ARCHIVE, "No", "Repositorios institucionales"),
}


def test_institutions(spark):
    frame = spark.createDataFrame([(k,) for k in INSTITUTIONS], f"{c.CATEGORY} string")
    got = {r[0]: tuple(r)[1:] for r in C.classify_institutions(frame).collect()}
    assert got == INSTITUTIONS


def test_every_listed_institution_matches_plain_rules(spark):
    names = fv.PRIVATE_UNIVERSITIES + fv.FOREIGN_UNIVERSITIES + fv.RESEARCH_CENTRES + fv.PUBLIC_ENTITIES
    frame = spark.createDataFrame([(k,) for k in names], f"{c.CATEGORY} string")
    got = {r[c.CATEGORY]: r[c.INST_CLASS] for r in C.classify_institutions(frame).collect()}
    assert all(got[n] == fv.INST_PRIVATE_UNIVERSITY for n in fv.PRIVATE_UNIVERSITIES)
    assert all(got[n] == fv.INST_CENTRE for n in fv.RESEARCH_CENTRES)
    assert all(got[n] == fv.INST_STATE for n in fv.PUBLIC_ENTITIES)


def test_repositories(spark):
    frame = spark.createDataFrame([(k,) for k in REPOSITORIES], f"{c.CATEGORY} string")
    rows = C.classify_repositories(frame).collect()
    got = {r[c.CATEGORY]: (r[c.REPO_CLASS], r[c.REPO_IS_UNIVERSITY], r[c.REPO_PUBLIC_CLASS]) for r in rows}
    assert got == REPOSITORIES
    pending = {r[c.CATEGORY]: (r[c.REPO_PUBLIC_RULE], r[c.REPO_PUBLIC_REVIEW]) for r in rows}
    assert pending["Blog"] == ("REP_PUBLICA_005_PENDIENTE_REVISION", "Si")
    assert pending["SERFOR"] == ("REP_PUBLICA_002", "No")


def test_default_class_columns(spark):
    bare = spark.createDataFrame([(1, "x")], f"{c.PUB} int, {c.CATEGORY} string")
    row = C.with_default_repository_classes(bare).first()
    assert (row[c.REPO_CLASS], row[c.REPO_PUBLIC_CLASS]) == (fv.UNCLASSIFIED, "Otros")
    row = C.with_default_institution_classes(bare).first()
    assert (row[c.INST_PUBLIC_CLASS], row[c.INST_PUBLIC_SUBCLASS]) == ("Otros", "No aplica")


@pytest.mark.parametrize(
    "value, label",
    [("TÉSIS doctoral", "Tesis"), (" tesis", "Tesis"), ("Artículo", fv.SCIENTIFIC_ARTICLE), (None, fv.SCIENTIFIC_ARTICLE)],
)
def test_binary_type(spark, value, label):
    frame = spark.createDataFrame([(value,)], f"`{c.RAW_TYPE}` string")
    tagged = Y.with_binary_type(frame)
    assert tagged.first()[c.BINARY_TYPE] == label
    counts = {r[0]: r[1] for r in Y.binary_type_counts(tagged).collect()}
    assert counts == {"Tesis": int(label == "Tesis"), fv.SCIENTIFIC_ARTICLE: int(label != "Tesis")}


# title, journal, url, raw type, raw level -> type, subtype, confidence, review, rule, evidence
TITLES = [
    ("x", None, None, "Tesis", "Maestría", "Tesis", "Tesis de maestría", "Alta", "NO", "TESIS_NIVEL_ORIGINAL",
     "Tipo original=Tesis; nivel original=Maestría"),
    ("x", None, None, "TESIS ", "Otros", "Tesis", fv.THESIS_LEVEL_UNKNOWN, "Baja", "SI", "TESIS_NIVEL_ORIGINAL",
     "Tipo original=Tesis; nivel original=Otros"),
    ("x", None, None, "Tesis", None, "Tesis", fv.THESIS_LEVEL_UNKNOWN, "Baja", "SI", "TESIS_NIVEL_ORIGINAL",
     "Tipo original=Tesis; nivel original=nan"),
    ("x", None, None, "Artículo de Conferencia", None, "Artículo", fv.EVENT_PUBLICATION, "Alta", "NO",
     "EVENTO_TIPO_ORIGINAL", "Tipo original=Artículo de conferencia"),
    ("Actas del Congreso", None, None, "Artículo", None, "Artículo", fv.EVENT_PUBLICATION, "Media", "SI",
     "EVENTO_POR_TITULO", "Indicador en título: congreso"),
    ("Actas del Congreso", "Rev", None, "Artículo", None, "Artículo", fv.SCIENTIFIC_ARTICLE, "Baja", "SI",
     "ALERTA_CONTEXTO_SIN_RECLASIFICAR", "Indicador solo en metadatos contextuales: congreso; señales: revista"),
    ("Informe Técnico 3", None, None, "Artículo", None, "Documento técnico", "Informe técnico", "Media", "SI",
     "TECNICO_POR_TITULO", "Indicador en título: informe tecnico; sin señales editoriales"),
    ("Informe Técnico 3", "Rev", None, "Artículo", None, "Artículo", fv.SCIENTIFIC_ARTICLE, "Baja", "SI",
     "TECNICO_CON_CONFLICTO_EDITORIAL", "Indicador en título: informe tecnico; conflicto con revista"),
    ("Un libro", None, None, "Artículo", None, "Libro", "Libro o monografía", "Media", "SI", "LIBRO_POR_TITULO",
     "Indicador en título: libro"),
    ("Un libro", None, "http://scielo.org/x", "Artículo", None, "Artículo", fv.SCIENTIFIC_ARTICLE, "Media", "SI",
     "LIBRO_CON_CONFLICTO_EDITORIAL", "Indicador bibliográfico en título: libro; conflicto con portal editorial"),
    ("A systematic review", None, None, "Artículo", None, "Artículo", "Artículo de revisión", "Media", "SI",
     "SUBTIPO_POR_TITULO", "Indicador en título: systematic review; señales: ninguna"),
    ("A systematic review", "Rev", None, "Artículo", None, "Artículo", "Artículo de revisión", "Media", "SI",
     "SUBTIPO_POR_TITULO", "Indicador en título: systematic review; señales: revista"),
    ("Nota breve", None, None, "Artículo", None, "Artículo", "Nota científica", "Media", "SI", "SUBTIPO_POR_TITULO",
     "Indicador en título: nota breve; señales: ninguna"),
    ("The dataset", None, None, "Artículo", None, "Datos de investigación", "Conjunto de datos", "Media", "SI",
     "SUBTIPO_POR_TITULO", "Indicador en título: dataset; señales: ninguna"),
    ("The dataset", "Rev", None, "Artículo", None, "Artículo", fv.SCIENTIFIC_ARTICLE, "Media", "SI",
     "DATOS_CON_CONFLICTO_EDITORIAL", "Indicador en título: dataset; conflicto con revista"),
    ("Algo", "Boletín técnico", None, "Artículo", None, "Artículo", fv.SCIENTIFIC_ARTICLE, "Baja", "SI",
     "ALERTA_CONTEXTO_SIN_RECLASIFICAR", "Indicador solo en metadatos contextuales: boletin tecnico; señales: revista"),
    ("Algo", "Rev", "https://link.springer.com/article/1", "Artículo", None, "Artículo", fv.SCIENTIFIC_ARTICLE,
     "Media", "NO", "ARTICULO_POR_DEFECTO", "revista, portal editorial"),
    ("Algo", "Otros", None, "Artículo", None, "Artículo", fv.SCIENTIFIC_ARTICLE, "Baja", "SI", "ARTICULO_POR_DEFECTO",
     "Sin señales editoriales estructuradas"),
]


def test_type_rules(spark):
    rows = [
        (i, kind, level, "Artículo", None, title, journal, None, None, None, None, url)
        for i, (title, journal, url, kind, level, *_rest) in enumerate(TITLES)
    ]
    schema = ", ".join(f"`{x}` {'int' if x == c.PUB else 'string'}" for x in Y.AUDIT_COLUMNS)
    audit = Y.audit_types(spark.createDataFrame(rows, schema)).orderBy(c.PUB).collect()
    for row, case in zip(audit, TITLES):
        got = (row[c.PROPOSED_TYPE], row[c.PROPOSED_SUBTYPE], row[c.CONFIDENCE], row[c.NEEDS_REVIEW], row[c.RULE], row[c.EVIDENCE])
        assert got == case[5:], case[0]
    assert audit[0]["CAMBIO_TIPO"] and audit[-1]["CAMBIO_SUBTIPO"] and not audit[-1]["CAMBIO_TIPO"]


@pytest.mark.parametrize(
    "kind, subtype, level, summary, detail",
    [
        ("Artículo", fv.MASTER_THESIS, None, None, None),
        (None, fv.MASTER_THESIS, None, None, None),
        (" Tesis ", fv.MASTER_THESIS, None, None, fv.MASTER_THESIS),
        ("Tesis", "x", "Maestría", None, fv.MASTER_THESIS),
        ("Tesis", fv.DOCTORAL_THESIS, None, None, fv.DOCTORAL_THESIS),
        ("Tesis", "x", "Doctorado", "maestría", fv.DOCTORAL_THESIS),
        ("Tesis", "Tesis de pregrado", None, "Grado de MAGÍSTER en", fv.MASTER_THESIS),
        ("Tesis", "Tesis de pregrado", None, "Ph. D. thesis", fv.DOCTORAL_THESIS),
        ("Tesis", "Tesis de pregrado", None, "submaestrías", None),
        ("Tesis", fv.POSTGRAD_THESIS, None, None, fv.NOT_IDENTIFIED),
        ("Tesis", "Tesis de pregrado", None, None, None),
    ],
)
def test_postgraduate_detail(spark, kind, subtype, level, summary, detail):
    frame = spark.createDataFrame([(kind, subtype, level, summary)], "k string, s string, l string, r string")
    got = frame.select(C.postgraduate_detail(*[F.col(x) for x in "kslr"]).alias("d")).first()["d"]
    assert got == detail


def test_hierarchy_normalisation(spark):
    rows = [
        (1, fv.EVENT_PUBLICATION, "x", None, None),
        (2, "Artículo", " Ponencia o memoria de evento ", None, None),
        (3, "Tesis", fv.MASTER_THESIS, "previo", None),
        (4, "Tesis", fv.POSTGRAD_UNSPECIFIED, None, "Doctorado"),
        (5, "Tesis", fv.POSTGRAD_THESIS, None, None),
        (6, "Tesis", fv.POSTGRAD_THESIS, "previo", "Maestría"),
        (7, "Tesis", "Tesis de pregrado", None, "Maestría"),
        (8, None, None, None, None),
    ]
    schema = f"i int, {c.PUBLIC_TYPE} string, {c.PUBLIC_SUBTYPE} string, {c.POSTGRAD_DETAIL} string, {c.LEVEL} string"
    got = {r["i"]: (r[c.PUBLIC_TYPE], r[c.PUBLIC_SUBTYPE], r[c.POSTGRAD_DETAIL])
           for r in C.normalize_hierarchy(spark.createDataFrame(rows, schema)).collect()}
    assert got == {
        1: ("Artículo", fv.EVENT_PUBLICATION, None),
        2: ("Artículo", fv.EVENT_PUBLICATION, None),
        3: ("Tesis", fv.POSTGRAD_THESIS, fv.MASTER_THESIS),
        4: ("Tesis", fv.POSTGRAD_THESIS, fv.DOCTORAL_THESIS),
        5: ("Tesis", fv.POSTGRAD_THESIS, fv.NOT_IDENTIFIED),
        6: ("Tesis", fv.POSTGRAD_THESIS, "previo"),
        7: ("Tesis", "Tesis de pregrado", None),
        8: (None, None, None),
    }
