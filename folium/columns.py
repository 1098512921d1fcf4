"""Column and table names of the catalogue.

Fixed values: these names are the public data contract, so they are kept
verbatim (accents, spaces and punctuation included).
"""

from __future__ import annotations

# Keys ---------------------------------------------------------------------
RECORD = "ID_REGISTRO_ANALISIS"
PUB = "ID_PUBLICACION_PROPUESTA"
REPRESENTATIVE = "ID_REGISTRO_REPRESENTATIVO"
MASTER_KEY = "CLAVE_BIBLIOGRAFICA_MASTER"
IDENTITY_KEY = "CLAVE_IDENTIDAD"
FINGERPRINT = "HUELLA_PUBLICACION_PERSISTENTE"
FINGERPRINT_METHOD = "METODO_HUELLA"
GROUP_SIZE = "REGISTROS_EN_GRUPO"
GROUP_RULES = "REGLAS_AGRUPACION"
STATE = "ESTADO"

# Ordinal of a row in its source table, written by the loader and persisted.
ORD = "_orden_original"

# Record columns -----------------------------------------------------------
DATABASE = "Nombre de Base de datos"
TITLE = "General_ Título"
AUTHORS = "General_ Autor(es)"
SUMMARY = "General_ Resumen"
YEAR = "General_ Año"
RAW_TYPE = "General_ Tipo de Publicación"
TYPE_NORM = "TIPO_PUBLICACION_NORM"
RAW_LEVEL = "General_ Tipo de tesis Pre/Posgrado"
INSTITUTION = "General_ Institución/Universidad"
JOURNAL = "General_ Nombre de revista"
REPOSITORY = "General_ Repositorio"
DOI = "General_ DOI"
VOLUME = "General_ Volume"
ISSUE = "General_ Issue"
URL = "General_ Enlace"
LANGUAGE = "General_ Idioma"
SCOPE = "General_ Publicación Nacional/Extranjera"
REGION = "REGION_NORM_SUGERIDA"
BINARY_TYPE = "Categoria_Tesis_Articulo"

# Public publication columns -----------------------------------------------
UNIQUE_FLAG = "USAR_PARA_CONTEO_UNICO"
PUBLIC_TYPE = "TIPO_PUBLICACION_PUBLICO"
PUBLIC_SUBTYPE = "SUBTIPO_PUBLICACION_PUBLICO"
POSTGRAD_DETAIL = "DETALLE_TESIS_POSGRADO_PUBLICO"
GRADE = "GRADO_ACADEMICO_PUBLICO"
LEVEL = "NIVEL_ACADEMICO_PUBLICO"

# Bridge columns -------------------------------------------------------------
CATEGORY = "categoria"
CATEGORY_ORDER = "orden_categoria"
COUNT = "Publicaciones"

REPO_CLASS = "CLASE_REPOSITORIO"
REPO_IS_UNIVERSITY = "ES_REPOSITORIO_UNIVERSITARIO"
REPO_PUBLIC_CLASS = "CLASE_REPOSITORIO_PUBLICA"
REPO_PUBLIC_RULE = "REGLA_CLASIFICACION_REPOSITORIO_PUBLICA"
REPO_PUBLIC_REVIEW = "REQUIERE_REVISION_REPOSITORIO"

INST_CLASS = "CLASE_INSTITUCION"
INST_IS_UNIVERSITY = "ES_UNIVERSIDAD"
INST_PUBLIC_CLASS = "CLASE_INSTITUCION_PUBLICA"
INST_PUBLIC_SUBCLASS = "SUBCLASE_UNIVERSIDAD_PUBLICA"

# Territory -------------------------------------------------------------------
DEP_KEY = "DEP_KEY"
DEP_NAME = "DEPARTAMEN_GEO"
DEP_ID = "IDDPTO"
DEP_CAPITAL = "CAPITAL"
DEP_BASE = "DEPARTAMENTO_BASE"
ON_MAP = "DEP_EN_GEOJSON"
TERRITORY_COUNTS = [
    "registros_territoriales",
    "publicaciones_unicas",
    "publicaciones_bibliograficas",
]

# Decisions --------------------------------------------------------------------
PROPOSED_TYPE = "TIPO_PROPUESTO"
PROPOSED_SUBTYPE = "SUBTIPO_PROPUESTO"
CONFIDENCE = "CONFIANZA_PROPUESTA"
NEEDS_REVIEW = "REQUIERE_REVISION_MANUAL"
EVIDENCE = "EVIDENCIA_CLASIFICACION"
RULE = "REGLA_APLICADA"
REQUEST_OLD = "Repositorio_original"
REQUEST_NEW = "Repositorio_actualizado"
REQUEST_CLASS = "Categoria_nueva"

# Map features
PROPERTIES = "PROPIEDADES"
GEOMETRY = "GEOMETRIA"

# Tables -------------------------------------------------------------------------
T_PUBLICATIONS = "BD_APP"
T_RECORDS = "REGISTROS_ORIGEN"
T_RECORD_MAP = "REGISTRO_PUBLICACION"
T_REVIEWED = "DECISIONES_REVISADAS"
T_ACADEMIC_AUDIT = "AUDITORIA_ACADEMICA"
T_INSTITUTION_AUDIT = "AUDITORIA_INSTITUCIONES"
T_REPOSITORY_AUDIT = "AUDITORIA_REPOSITORIOS"
T_ID_REGISTRY = "REGISTRO_MAESTRO_IDS"
T_ID_MERGES = "FUSIONES_IDS"
T_SUMMARY = "RESUMEN_ADAPTACION"
T_CONTRACT = "CONTRATO_DATOS"
T_TRACE = "TRAZABILIDAD_TIPOS"
T_MAP = "MAPA_DEPARTAMENTOS"
T_TERRITORY = "REGIONES_EXPANDIDAS"
T_COVERAGE = "COBERTURA_REGION"
T_UNCROSSED = "REGIONES_NO_CRUZADAS"
T_DEP_GEOJSON = "DEPARTAMENTOS_GEOJSON"
T_RUNS = "TRAZABILIDAD_EJECUCIONES"

DIM_REPOSITORIES = "DIM_REPOSITORIOS"
DIM_AREAS = "DIM_AREAS_TEMATICAS"
DIM_AXES = "DIM_EJES_TEMATICOS"
DIM_LINES = "DIM_LINEAS_INVESTIGACION"
DIM_REGIONS = "DIM_REGIONES_NORMALIZADAS"
DIM_INSTITUTIONS = "DIM_INSTITUCIONES"
DIM_DATABASES = "DIM_BASES_DOCUMENTALES"
DIMENSIONS = [
    DIM_REPOSITORIES,
    DIM_AREAS,
    DIM_AXES,
    DIM_LINES,
    DIM_REGIONS,
    DIM_INSTITUTIONS,
    DIM_DATABASES,
]

# Column lists of the jobs ----------------------------------------------------------
REQUIRED_DASHBOARD = [PUBLIC_TYPE, YEAR, PUB]

EXPLORE_COLUMNS = [
    TITLE,
    AUTHORS,
    PUB,
    YEAR,
    PUBLIC_TYPE,
    PUBLIC_SUBTYPE,
    REGION,
    INSTITUTION,
    REPOSITORY,
    "DOI_NORM",
    URL,
]

# Consolidated export column -> bridge key of the dashboard.
CONSOLIDATED_EXPORT = {
    "base": "BASES_DOCUMENTALES_CONSOLIDADAS",
    "repositorio": "REPOSITORIOS_CONSOLIDADOS",
    "institucion": "INSTITUCIONES_CONSOLIDADAS",
    "area": "AREAS_TEMATICAS_CONSOLIDADAS",
    "eje": "EJES_TEMATICOS_CONSOLIDADOS",
    "linea": "LINEAS_INVESTIGACION_CONSOLIDADAS",
}
CONSOLIDATED_REGIONS = "REGIONES_ESTUDIO_CONSOLIDADAS"

PUBLIC_EXPORT = [
    PUB,
    TITLE,
    AUTHORS,
    YEAR,
    SUMMARY,
    "General_ Palabras clave del documento",
    LANGUAGE,
    DOI,
    URL,
    PUBLIC_TYPE,
    PUBLIC_SUBTYPE,
    GRADE,
    LEVEL,
    POSTGRAD_DETAIL,
    SCOPE,
    "General_ Tipo de contenido (TD=texto disponible, TN=Texto no disponible)",
    JOURNAL,
    VOLUME,
    ISSUE,
    "General_ Page start",
    "General_ Page end",
    "General_ Número de páginas",
    "General_ Lugar de Publicación",
    "BASES_DOCUMENTALES_CONSOLIDADAS",
    "REPOSITORIOS_CONSOLIDADOS",
    "INSTITUCIONES_CONSOLIDADAS",
    "General_ SIGLAS UNIVERSIDAD/INSTITUCIÓN",
    CONSOLIDATED_REGIONS,
    "Ubicación_Ambito de estudio/Tipo de ecosistema (acuático, terrestre)",
    "Ubicación_Localidad (comunidad campesina u otros)",
    "Ubicación_Distrito",
    "Ubicación_Provincia",
    "Especie_Nombre científico",
    "AREAS_TEMATICAS_CONSOLIDADAS",
    "EJES_TEMATICOS_CONSOLIDADOS",
    "LINEAS_INVESTIGACION_CONSOLIDADAS",
]

# Categorical columns whose blanks become "Otros" in the public base.
RECODED_COLUMNS = [
    DATABASE,
    REPOSITORY,
    RAW_TYPE,
    RAW_LEVEL,
    INSTITUTION,
    "General_ SIGLAS UNIVERSIDAD/INSTITUCIÓN",
    JOURNAL,
    LANGUAGE,
    "General_ Lugar de Publicación",
    SCOPE,
    "General_ Tipo de contenido (TD=texto disponible, TN=Texto no disponible)",
    "Ubicación_Ambito de estudio/Tipo de ecosistema (acuático, terrestre)",
    "Ubicación_Región de estudio",
    "Ubicación_Localidad (comunidad campesina u otros)",
    "Ubicación_Distrito",
    "Ubicación_Provincia",
    "Especie_Nombre científico",
    "ANIFFS: Eje Temático",
    "ANIFFS: Área Temática",
    "ANIFFS: Linea de investigación",
    BINARY_TYPE,
    TYPE_NORM,
    REGION,
]

REQUIRED_MAIN = [
    TYPE_NORM,
    PUBLIC_TYPE,
    PUBLIC_SUBTYPE,
    POSTGRAD_DETAIL,
    YEAR,
    UNIQUE_FLAG,
    GRADE,
    LEVEL,
    FINGERPRINT,
    PUB,
]
