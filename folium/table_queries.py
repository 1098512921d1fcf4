"""Queries of the catalogue operators over the test tables, each with its SQL twin.

The test tables are not bibliographic, so every table plays a role: ``orders`` are
publications (or records of a customer), ``lineitem`` with ``part`` and
``supplier`` gives many-valued bridges and the territory, ``documents`` are source
records grouped by equal text, ``pages`` carry titles and addresses, ``labels``
are reviewed decisions.  Renaming happens here; the operators stay untouched.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from folium import columns as c
from folium import fixed_values as fv
from folium.functions import text as t
from folium.functions.rules import bind, first_pattern
from folium.operators import bridges as B
from folium.operators import checks as K
from folium.operators import classify as C
from folium.operators import facets as X
from folium.operators import groups as G
from folium.operators import profile as P
from folium.operators import summaries as S
from folium.operators import territory as R
from folium.operators.controls import Controls
from folium.plans import consolidate as L
from folium.plans import dashboard as D
from folium.plans import public_base as U
from folium.plans import types as Y
from folium.plans import validate as V
from folium.session import stored

Query = Callable[[SparkSession, str], DataFrame]
QUERIES: dict[str, Query] = {}
ORACLE: dict[str, str] = {}


def query(name: str, sql: str | None = None):
    def register(fn: Query) -> Query:
        QUERIES[name] = fn
        if sql is not None:
            ORACLE[name] = sql
        return fn

    return register


def q(name: str) -> str:
    """SQL identifier."""
    return '"' + name + '"'


def s(value: str) -> str:
    """SQL string."""
    return "'" + value.replace("'", "''") + "'"


def sql_list(values) -> str:
    return ", ".join(s(v) for v in values)


# Declared, so that opening a table never starts a job to read file footers.
SCHEMAS = {
    "nation": "n_nationkey int, n_name string, n_regionkey int",
    "customer": "c_custkey long, c_name string, c_nationkey int, c_acctbal double, c_mktsegment string",
    "supplier": "s_suppkey long, s_name string, s_nationkey int, s_acctbal double",
    "part": "p_partkey long, p_name string, p_brand string, p_type string, p_size int, p_retailprice double",
    "orders": "o_orderkey long, o_custkey long, o_orderstatus string, o_totalprice double, "
    "o_orderdate timestamp_ntz, o_orderpriority string",
    "lineitem": "l_orderkey long, l_partkey long, l_suppkey long, l_linenumber int, l_quantity double, "
    "l_extendedprice double, l_discount double, l_tax double, l_returnflag string, l_linestatus string, "
    "l_shipdate timestamp_ntz",
    "events": "event_id long, ts timestamp_ntz, user_id long, event_type string, value double, props string",
    "documents": "doc_id long, text string, lang string, source string, n_chars long",
    "labels": "doc_id long, quality int, toxic int",
    "pages": "page_id long, url string, html string",
}


def read(spark: SparkSession, folder: str, table: str) -> DataFrame:
    return spark.read.schema(SCHEMAS[table]).parquet(f"{folder}/{table}.parquet")


#: Bytes of a Parquet file whose rows one task may hold as keys at a time.
SLICE_BYTES = 4_000_000


def slices(spark: SparkSession, folder: str, table: str) -> int:
    """Tasks to spread a table's rows over; 0 where a core's share is within a slice anyway."""
    where = spark._jvm.org.apache.hadoop.fs.Path(f"{folder}/{table}.parquet")
    size = where.getFileSystem(spark._jsc.hadoopConfiguration()).getContentSummary(where).getLength()
    tasks = -(-size // SLICE_BYTES)
    if tasks <= spark.sparkContext.defaultParallelism:
        return 0
    # With fewer than the session's own number joins would deal the rows out once more.
    return max(tasks, int(spark.conf.get("spark.sql.shuffle.partitions")))


def distinct_by_publication(rows: DataFrame, tasks: int) -> DataFrame:
    """Distinct rows; in so many parts by publication, so that joins and groups by it stay in them.

    Left to itself Spark makes as many tasks as there are cores, each with all its keys in
    memory.  Repeats meet by the whole row first, so no task takes all lines of a huge
    publication, and nothing is held before that exchange.
    """
    if not tasks:
        return rows.distinct()
    return rows.repartition(tasks, *[F.col(f"`{x}`") for x in rows.columns]).distinct().repartition(tasks, c.PUB)


# ==========================================================================
# Roles
# ==========================================================================
def orders_as_publications(spark: SparkSession, folder: str) -> DataFrame:
    return read(spark, folder, "orders").select(
        F.col("o_orderkey").alias(c.PUB),
        F.col("o_orderpriority").alias(c.PUBLIC_TYPE),
        F.col("o_orderstatus").alias(c.PUBLIC_SUBTYPE),
        F.year("o_orderdate").cast("string").alias(c.YEAR),
        F.when(F.col("o_orderstatus") == "P", "no").otherwise("si").alias(c.UNIQUE_FLAG),
    )


PUBS = f"""pubs AS (
  SELECT o_orderkey AS pub, o_orderpriority AS kind, o_orderstatus AS sub,
         CAST(year(o_orderdate) AS INTEGER) AS yr
  FROM orders)"""


def part_bridge(spark: SparkSession, folder: str, *columns: str) -> DataFrame:
    """Distinct (order, part attributes)."""
    lines = read(spark, folder, "lineitem").select(F.col("l_orderkey").alias(c.PUB), "l_partkey")
    parts = read(spark, folder, "part").select("p_partkey", *columns)
    rows = lines.join(parts, F.col("l_partkey") == F.col("p_partkey")).select(c.PUB, *columns)
    return distinct_by_publication(rows, slices(spark, folder, "lineitem"))


def type_bridge(spark: SparkSession, folder: str) -> DataFrame:
    return part_bridge(spark, folder, "p_type").withColumnRenamed("p_type", c.CATEGORY)


def brand_bridge(spark: SparkSession, folder: str) -> DataFrame:
    return part_bridge(spark, folder, "p_brand").withColumnRenamed("p_brand", c.CATEGORY)


TYPES = """types AS (
  SELECT DISTINCT l_orderkey AS pub, p_type AS cat FROM lineitem JOIN part ON l_partkey = p_partkey)"""
BRANDS = """brands AS (
  SELECT DISTINCT l_orderkey AS pub, p_brand AS cat FROM lineitem JOIN part ON l_partkey = p_partkey)"""


def supply(spark: SparkSession, folder: str) -> DataFrame:
    """Order lines with the department of their supplier; Africa is off the map."""
    lines = read(spark, folder, "lineitem").select("l_orderkey", "l_suppkey")
    suppliers = read(spark, folder, "supplier").select("s_suppkey", "s_nationkey")
    nations = read(spark, folder, "nation").select("n_nationkey", "n_name", "n_regionkey")
    return (
        lines.join(suppliers, F.col("l_suppkey") == F.col("s_suppkey"))
        .join(nations, F.col("s_nationkey") == F.col("n_nationkey"))
        .select(
            "l_orderkey",
            F.col("n_nationkey").alias(c.DEP_KEY),
            F.col("n_name").alias(c.DEP_NAME),
            (F.col("n_regionkey") != 0).alias(c.ON_MAP),
        )
    )


SUPPLY = """supply AS (
  SELECT l_orderkey, n_nationkey AS dep, n_name AS dep_name, n_regionkey <> 0 AS on_map
  FROM lineitem JOIN supplier ON l_suppkey = s_suppkey JOIN nation ON s_nationkey = n_nationkey)"""


def order_territory(spark: SparkSession, folder: str) -> DataFrame:
    rows = supply(spark, folder).withColumnRenamed("l_orderkey", c.PUB)
    return distinct_by_publication(rows, slices(spark, folder, "lineitem"))


def departments(spark: SparkSession, folder: str) -> DataFrame:
    return read(spark, folder, "nation").select(
        F.col("n_nationkey").alias(c.DEP_ID),
        F.col("n_name").alias(c.DEP_NAME),
        F.col("n_nationkey").alias(c.DEP_KEY),
        F.concat(F.lit("C"), F.col("n_regionkey").cast("string")).alias(c.DEP_CAPITAL),
    )


DEP_COLUMNS = f"""n_nationkey AS {q(c.DEP_ID)}, n_name AS {q(c.DEP_NAME)},
  n_nationkey AS {q(c.DEP_KEY)}, 'C' || CAST(n_regionkey AS VARCHAR) AS {q(c.DEP_CAPITAL)}"""


def customer_record_map(spark: SparkSession, folder: str) -> DataFrame:
    """Orders are records, their customer is the publication."""
    return read(spark, folder, "orders").select(
        F.col("o_orderkey").alias(c.RECORD), F.col("o_custkey").alias(c.PUB)
    )


def document_records(spark: SparkSession, folder: str) -> DataFrame:
    lang = F.col("lang")
    return read(spark, folder, "documents").select(
        F.col("doc_id").alias(c.RECORD),
        F.col("doc_id").alias(c.ORD),
        F.col("source").alias(c.DATABASE),
        F.when(lang == "de", fv.THESIS)
        .when(lang == "es", fv.CONFERENCE_ARTICLE)
        .otherwise(fv.ARTICLE)
        .alias(c.TYPE_NORM),
        lang.alias(c.LANGUAGE),
        "n_chars",
    )


def document_map(spark: SparkSession, folder: str) -> DataFrame:
    """Records with equal text form a publication named by its first record.

    Texts are compared by digest, so whole texts are never shuffled, and the narrow
    map is stored, because the jobs and their checks read it several times.
    """
    keyed = read(spark, folder, "documents").select(
        F.col("doc_id").alias(c.RECORD), F.col("doc_id").alias(c.ORD), F.sha2("text", 256).alias("_text")
    )
    grouped = G.attach_group_head(keyed, ["_text"], c.ORD, c.PUB, c.GROUP_SIZE)
    several = F.col(c.GROUP_SIZE) > 1
    record_map = grouped.select(
        c.RECORD,
        c.ORD,
        c.PUB,
        F.col(c.PUB).alias(c.REPRESENTATIVE),
        c.GROUP_SIZE,
        F.when(several, "TEXTO_IGUAL").alias(c.GROUP_RULES),
        F.when(several, "agrupado").otherwise("sin_coincidencia").alias(c.STATE),
    )
    return stored(record_map)


DOCMAP = """docmap AS (
  SELECT doc_id, source, lang, n_chars,
         min(doc_id) OVER (PARTITION BY text) AS pub, count(*) OVER (PARTITION BY text) AS n
  FROM documents)"""


def selection() -> X.Selection:
    return X.Selection(
        years=(1996, 1999),
        scalars={c.PUBLIC_TYPE: ["1-URGENT", "2-HIGH"], c.PUBLIC_SUBTYPE: ["O"]},
        bridges={"area": ["PROMO", "SMALL"], "region": ["NATION_1", "NATION_2", "NATION_3", "NATION_4"]},
    )


def facet_bridges(spark: SparkSession, folder: str) -> dict[str, DataFrame]:
    regions = order_territory(spark, folder).select(c.PUB, F.col(c.DEP_NAME).alias(c.CATEGORY))
    return {"area": type_bridge(spark, folder), "region": regions, "base": brand_bridge(spark, folder)}


# ==========================================================================
# Summaries
# ==========================================================================
@query(
    "type_summary",
    f"""WITH {PUBS} SELECT trim(kind) AS {q(c.PUBLIC_TYPE)}, count(DISTINCT pub) AS {q(c.COUNT)}
    FROM pubs WHERE kind IS NOT NULL AND trim(kind) <> '' AND sub <> 'P' GROUP BY 1""",
)
def type_summary(spark, folder):
    return S.simple_summary(X.unique_only(orders_as_publications(spark, folder)), c.PUBLIC_TYPE)


@query(
    "relation_summary",
    f"""WITH {PUBS}, {TYPES} SELECT cat AS {q(c.CATEGORY)}, count(DISTINCT pub) AS {q(c.COUNT)}
    FROM types JOIN pubs USING (pub) WHERE sub <> 'P' GROUP BY 1""",
)
def relation_summary(spark, folder):
    scope = X.unique_only(orders_as_publications(spark, folder))
    return S.relation_summary(type_bridge(spark, folder), scope)


@query(
    "relation_summary_no_others",
    f"""WITH {PUBS}, {TYPES} SELECT cat AS {q(c.CATEGORY)}, count(DISTINCT pub) AS {q(c.COUNT)}
    FROM types JOIN pubs USING (pub) WHERE sub <> 'P' AND cat NOT IN ('PROMO', 'LARGE') GROUP BY 1""",
)
def relation_summary_no_others(spark, folder):
    scope = X.unique_only(orders_as_publications(spark, folder))
    category = F.col(c.CATEGORY)
    bridge = type_bridge(spark, folder).withColumn(
        c.CATEGORY,
        F.when(category == "PROMO", " OTROS ").when(category == "LARGE", " \t").otherwise(category),
    )
    return S.relation_summary(bridge, scope, include_others=False)


@query(
    "class_restricted_summary",
    f"""WITH {PUBS} SELECT p_brand AS {q(c.CATEGORY)}, count(DISTINCT l_orderkey) AS {q(c.COUNT)}
    FROM lineitem JOIN part ON l_partkey = p_partkey JOIN pubs ON pub = l_orderkey
    WHERE p_type = 'PROMO' AND sub <> 'P' GROUP BY 1""",
)
def class_restricted_summary(spark, folder):
    bridge = part_bridge(spark, folder, "p_brand", "p_type").withColumnRenamed("p_brand", c.CATEGORY)
    scope = X.unique_only(orders_as_publications(spark, folder))
    return S.class_summary(bridge, scope, "p_type", "PROMO")


@query(
    "class_relation_distinct",
    f"""SELECT DISTINCT l_orderkey AS {q(c.PUB)}, p_type AS {q(c.CATEGORY)}
    FROM lineitem JOIN part ON l_partkey = p_partkey WHERE p_type <> 'LARGE'""",
)
def class_relation_distinct(spark, folder):
    bridge = part_bridge(spark, folder, "p_brand", "p_type")
    clazz = F.col("p_type")
    return B.bridge_from_column(
        bridge.withColumn("p_type", F.when(clazz == "LARGE", "  ").otherwise(F.concat(clazz, F.lit(" ")))), "p_type"
    )


@query(
    "drilldown_fallback",
    f"""WITH {PUBS}
    SELECT 'directo' AS nivel, sub AS {q(c.PUBLIC_SUBTYPE)}, count(DISTINCT pub) AS {q(c.COUNT)}
    FROM pubs WHERE kind = '2-HIGH' AND yr = 1998 GROUP BY 2
    UNION ALL
    SELECT 'respaldo', sub, count(DISTINCT pub) FROM pubs WHERE kind = '1-URGENT' GROUP BY 2""",
)
def drilldown_fallback(spark, folder):
    pubs = orders_as_publications(spark, folder)
    some = pubs.filter((F.col(c.PUBLIC_TYPE) == "2-HIGH") & (F.col(c.YEAR) == "1998"))
    none = pubs.filter(F.col(c.YEAR) == "1900")
    direct = S.drilldown_summary(some, pubs, "2-HIGH", c.PUBLIC_SUBTYPE)
    backup = S.drilldown_summary(none, pubs, "1-URGENT", c.PUBLIC_SUBTYPE)
    return direct.withColumn("nivel", F.lit("directo")).unionByName(
        backup.withColumn("nivel", F.lit("respaldo"))
    )


_SELECTED = f"""{PUBS}, {TYPES}, {SUPPLY}, flagged AS (SELECT * FROM pubs WHERE sub <> 'P'),
  y AS (SELECT * FROM flagged WHERE yr BETWEEN 1996 AND 1999),
  k AS (SELECT * FROM y WHERE kind IN ('1-URGENT', '2-HIGH')),
  u AS (SELECT * FROM k WHERE sub IN ('O')),
  r AS (SELECT * FROM u WHERE pub IN (SELECT l_orderkey FROM supply
        WHERE dep_name IN ('NATION_1', 'NATION_2', 'NATION_3', 'NATION_4'))),
  a AS (SELECT * FROM r WHERE pub IN (SELECT pub FROM types WHERE cat IN ('PROMO', 'SMALL')))"""


@query(
    "faceted_publications",
    f"""WITH {_SELECTED} SELECT pub AS {q(c.PUB)}, kind AS {q(c.PUBLIC_TYPE)}, sub AS {q(c.PUBLIC_SUBTYPE)},
    yr AS anio FROM a""",
)
def faceted_publications(spark, folder):
    found = X.faceted(orders_as_publications(spark, folder), facet_bridges(spark, folder), selection())
    return found.select(c.PUB, c.PUBLIC_TYPE, c.PUBLIC_SUBTYPE, t.to_year(F.col(c.YEAR)).alias("anio"))


@query(
    "facet_options",
    f"""WITH {_SELECTED}, {BRANDS}
    SELECT DISTINCT {s(c.PUBLIC_TYPE)} AS facet, kind AS value FROM y
    UNION ALL SELECT DISTINCT {s(c.PUBLIC_SUBTYPE)}, sub FROM k
    UNION ALL SELECT DISTINCT 'base', cat FROM brands WHERE pub IN (SELECT pub FROM u)
    UNION ALL SELECT DISTINCT 'region', dep_name FROM supply WHERE l_orderkey IN (SELECT pub FROM u)
    UNION ALL SELECT DISTINCT 'area', cat FROM types WHERE pub IN (SELECT pub FROM r)""",
)
def facet_options(spark, folder):
    return X.facet_options(orders_as_publications(spark, folder), facet_bridges(spark, folder), selection(), stored)


@query(
    "full_year_range",
    f"""SELECT o_orderkey AS {q(c.PUB)} FROM orders""",
)
def full_year_range(spark, folder):
    """The full range is no filter: publications without a year stay."""
    pubs = orders_as_publications(spark, folder).withColumn(
        c.YEAR, F.when(F.col(c.PUBLIC_SUBTYPE) == "F", "s/f").otherwise(F.col(c.YEAR))
    )
    return X.in_years(pubs, (1995, 2001)).select(c.PUB)


@query(
    "year_type_series",
    f"""WITH {PUBS} SELECT yr AS {q(c.YEAR)}, kind AS {q(c.PUBLIC_TYPE)}, count(DISTINCT pub) AS {q(c.COUNT)}
    FROM pubs WHERE sub <> 'F' GROUP BY 1, 2""",
)
def year_type_series(spark, folder):
    year, sub = F.col(c.YEAR), F.col(c.PUBLIC_SUBTYPE)
    pubs = orders_as_publications(spark, folder).withColumn(
        c.YEAR, F.when(sub == "F", "nan").when(sub == "O", F.concat(year, F.lit(".0"))).otherwise(year)
    )
    return S.year_series(pubs)


@query(
    "year_bounds",
    f"""WITH {PUBS} SELECT min(yr) AS min_year, max(yr) AS max_year FROM pubs""",
)
def year_bounds(spark, folder):
    return S.year_bounds(orders_as_publications(spark, folder))


@query(
    "kpis",
    f"""WITH {PUBS}, {TYPES}, {BRANDS}, {SUPPLY}, v AS (SELECT pub FROM pubs WHERE sub <> 'P')
    SELECT 'publicaciones' AS indicador, count(DISTINCT pub) AS valor FROM v
    UNION ALL SELECT 'departamentos', count(DISTINCT dep) FROM supply JOIN v ON pub = l_orderkey WHERE on_map
    UNION ALL SELECT 'areas_tematicas', count(DISTINCT cat) FROM types JOIN v USING (pub) WHERE cat <> 'PROMO'
    UNION ALL SELECT 'clases_repositorio', count(DISTINCT cat) FROM brands JOIN v USING (pub)""",
)
def kpis(spark, folder):
    scope = X.unique_only(orders_as_publications(spark, folder))
    category = F.col(c.CATEGORY)
    areas = type_bridge(spark, folder).withColumn(
        c.CATEGORY, F.when(category == "PROMO", fv.OTHERS).otherwise(category)
    )
    regions = R.department_summary(scope, order_territory(spark, folder), departments(spark, folder))
    return S.kpis(scope, regions, areas, brand_bridge(spark, folder))


@query(
    "top_k",
    f"""WITH {BRANDS} SELECT * FROM (SELECT cat AS {q(c.CATEGORY)}, count(DISTINCT pub) AS {q(c.COUNT)}
    FROM brands GROUP BY 1 ORDER BY 2 DESC, 1 ASC LIMIT 12)""",
)
def top_k(spark, folder):
    scope = orders_as_publications(spark, folder)
    summary = S.relation_summary(brand_bridge(spark, folder), scope, ordered=False)
    return S.top_k(summary, c.CATEGORY)


@query(
    "preview",
    f"""WITH {PUBS} SELECT pub AS {q(c.PUB)}, CAST(yr AS VARCHAR) AS {q(c.YEAR)}, kind AS {q(c.PUBLIC_TYPE)},
    sub AS {q(c.PUBLIC_SUBTYPE)} FROM pubs ORDER BY pub LIMIT 500""",
)
def preview(spark, folder):
    return S.preview(orders_as_publications(spark, folder))


@query(
    "value_counts",
    f"""SELECT CASE WHEN o_orderstatus = 'P' THEN NULL ELSE o_orderpriority END AS {q(c.PUBLIC_TYPE)},
    o_orderstatus AS {q(c.PUBLIC_SUBTYPE)}, count(*) AS {q(c.COUNT)} FROM orders GROUP BY 1, 2""",
)
def value_counts(spark, folder):
    pubs = orders_as_publications(spark, folder).withColumn(
        c.PUBLIC_TYPE, F.when(F.col(c.PUBLIC_SUBTYPE) != "P", F.col(c.PUBLIC_TYPE))
    )
    return S.value_counts(pubs, c.PUBLIC_TYPE, c.PUBLIC_SUBTYPE)


# ==========================================================================
# Territory
# ==========================================================================
@query(
    "department_summary",
    f"""WITH {PUBS}, {SUPPLY}, n AS (SELECT dep, count(DISTINCT l_orderkey) AS n FROM supply
      JOIN pubs ON pub = l_orderkey WHERE on_map AND sub <> 'P' GROUP BY 1)
    SELECT {DEP_COLUMNS}, coalesce(n, 0) AS {q(c.COUNT)} FROM nation LEFT JOIN n ON dep = n_nationkey""",
)
def department_summary(spark, folder):
    scope = X.unique_only(orders_as_publications(spark, folder))
    return R.department_summary(scope, order_territory(spark, folder), departments(spark, folder))


_CUSTOMER_TERRITORY = f"""{SUPPLY}, firsts AS (
  SELECT o_custkey AS pub, dep, on_map, min(l_orderkey) AS rec
  FROM supply JOIN orders ON o_orderkey = l_orderkey GROUP BY 1, 2, 3)"""


def customer_territory(spark, folder) -> dict[str, DataFrame]:
    territory = supply(spark, folder).select(
        F.col("l_orderkey").alias(c.RECORD), F.col("l_orderkey").alias(c.ORD), c.DEP_KEY, c.ON_MAP
    )
    return R.consolidate_territory(territory, departments(spark, folder), customer_record_map(spark, folder))


@query(
    "territory_relations",
    f"""WITH {_CUSTOMER_TERRITORY} SELECT rec AS {q(c.RECORD)}, pub AS {q(c.PUB)}, dep AS {q(c.DEP_KEY)},
    on_map AS {q(c.ON_MAP)} FROM firsts""",
)
def territory_relations(spark, folder):
    return customer_territory(spark, folder)[c.T_TERRITORY].select(c.RECORD, c.PUB, c.DEP_KEY, c.ON_MAP)


@query(
    "territory_counts",
    f"""WITH {_CUSTOMER_TERRITORY}, n AS (SELECT dep, count(rec) AS a, count(DISTINCT pub) AS b
      FROM firsts WHERE on_map GROUP BY 1)
    SELECT {DEP_COLUMNS}, coalesce(a, 0) AS registros_territoriales, coalesce(b, 0) AS publicaciones_unicas,
    coalesce(b, 0) AS publicaciones_bibliograficas FROM nation LEFT JOIN n ON dep = n_nationkey""",
)
def territory_counts(spark, folder):
    return customer_territory(spark, folder)[c.T_MAP]


@query(
    "territory_coverage",
    f"""WITH {_CUSTOMER_TERRITORY}
    SELECT 'publicaciones_consolidadas' AS indicador, count(DISTINCT o_custkey) AS valor FROM orders
    UNION ALL SELECT 'relaciones_territoriales', count(*) FROM firsts
    UNION ALL SELECT 'publicaciones_con_departamento', count(DISTINCT pub) FROM firsts WHERE on_map
    UNION ALL SELECT 'departamentos_con_datos', count(DISTINCT dep) FROM firsts WHERE on_map""",
)
def territory_coverage(spark, folder):
    return customer_territory(spark, folder)[c.T_COVERAGE]


@query(
    "territory_detail",
    f"""WITH {PUBS}, {SUPPLY} SELECT DISTINCT l_orderkey AS {q(c.PUB)}, dep_name AS "REGION_ESTUDIO"
    FROM supply JOIN pubs ON pub = l_orderkey WHERE on_map AND sub <> 'P'""",
)
def territory_detail(spark, folder):
    scope = X.unique_only(orders_as_publications(spark, folder))
    return R.territorial_detail(order_territory(spark, folder), scope)


@query(
    "publications_on_map",
    f"""WITH {PUBS}, {SUPPLY}, n AS (SELECT count(DISTINCT l_orderkey) AS n FROM supply JOIN pubs
      ON pub = l_orderkey WHERE on_map AND sub <> 'P')
    SELECT n AS publicaciones, replace(format('{{:,}}', n), ',', ' ') AS etiqueta FROM n""",
)
def publications_on_map(spark, folder):
    scope = X.unique_only(orders_as_publications(spark, folder))
    return D.publications_on_map(order_territory(spark, folder), scope)


@query(
    "region_lookup",
    f"""WITH k AS (SELECT * FROM (VALUES (1, 'NATION_20'), (2, 'NATION_X'), (3, 'NATION_3')) AS v(pos, key)),
    b AS (SELECT l_orderkey AS pub, replace(n_name, 'A', 'á') AS cat
      FROM lineitem JOIN supplier ON l_suppkey = s_suppkey JOIN nation ON s_nationkey = n_nationkey)
    SELECT CAST(pos AS INTEGER) AS posicion, key AS {q(c.DEP_KEY)}, min_by(cat, pub) AS {q(c.CATEGORY)}
    FROM k JOIN b ON upper(strip_accents(cat)) = key GROUP BY 1, 2""",
)
def region_lookup(spark, folder):
    bridge = order_territory(spark, folder).select(
        c.PUB, F.replace(F.col(c.DEP_NAME), F.lit("A"), F.lit("á")).alias(c.CATEGORY)
    )
    return R.region_lookup(["NATION_20", "NATION_X", "NATION_3"], bridge, c.PUB)


# ==========================================================================
# Consolidation
# ==========================================================================
_DOC_TYPE = f"""CASE d.lang WHEN 'de' THEN 'Tesis' WHEN 'es' THEN 'Artículo de conferencia' ELSE 'Artículo' END"""


@query(
    "record_map",
    f"""WITH {DOCMAP} SELECT doc_id AS {q(c.RECORD)}, pub AS {q(c.PUB)}, n AS {q(c.GROUP_SIZE)} FROM docmap""",
)
def record_map(spark, folder):
    return document_map(spark, folder).select(c.RECORD, c.PUB, c.GROUP_SIZE)


@query(
    "consolidate_publications",
    f"""WITH {DOCMAP}, first_db AS (SELECT pub, source, min(doc_id) AS first_id FROM docmap GROUP BY 1, 2),
    db AS (SELECT pub, string_agg(source, '; ' ORDER BY first_id) AS dbs FROM first_db GROUP BY 1)
    SELECT d.pub AS {q(c.PUB)}, d.doc_id AS {q(c.REPRESENTATIVE)}, d.n AS {q(c.GROUP_SIZE)},
      CASE WHEN d.n > 1 THEN 'TEXTO_IGUAL' END AS {q(c.GROUP_RULES)},
      CASE WHEN d.n > 1 THEN 'agrupado' ELSE 'sin_coincidencia' END AS {q(c.STATE)},
      d.doc_id AS {q(c.RECORD)}, {_DOC_TYPE} AS {q(c.TYPE_NORM)}, d.lang AS {q(c.LANGUAGE)}, d.n_chars AS n_chars,
      dbs AS {q(c.DATABASE)}, 'SI' AS {q(c.UNIQUE_FLAG)},
      CASE WHEN d.lang = 'de' THEN 'Tesis' ELSE 'Artículo' END AS {q(c.PUBLIC_TYPE)},
      CASE d.lang WHEN 'de' THEN NULL WHEN 'es' THEN 'Publicación de evento científico'
        ELSE 'Artículo científico' END AS {q(c.PUBLIC_SUBTYPE)}
    FROM docmap d JOIN db ON db.pub = d.pub WHERE d.doc_id = d.pub""",
)
def consolidate_publications(spark, folder):
    return L.build_publications(document_records(spark, folder), document_map(spark, folder))


@query(
    "remap_bridge",
    f"""WITH {DOCMAP}, f AS (SELECT pub, source, min(doc_id) AS rec FROM docmap GROUP BY 1, 2)
    SELECT pub AS {q(c.PUB)}, rec AS {q(c.RECORD)}, source AS {q(c.CATEGORY)},
    CAST(row_number() OVER (PARTITION BY pub ORDER BY rec) AS INTEGER) AS {q(c.CATEGORY_ORDER)} FROM f""",
)
def remap_bridge(spark, folder):
    bridge = B.bridge_from_records(document_records(spark, folder), document_map(spark, folder), c.DATABASE)
    return bridge.select(c.PUB, c.RECORD, c.CATEGORY, c.CATEGORY_ORDER)


_EXPORTED = f"""{PUBS}, {TYPES}, {BRANDS}, {SUPPLY},
  dt AS (SELECT pub, string_agg(DISTINCT cat, '; ' ORDER BY cat) AS v FROM types GROUP BY 1),
  db AS (SELECT pub, string_agg(DISTINCT cat, '; ' ORDER BY cat) AS v FROM brands GROUP BY 1),
  dr AS (SELECT l_orderkey AS pub, string_agg(DISTINCT dep_name, '; ' ORDER BY dep_name) AS v
         FROM supply WHERE on_map GROUP BY 1)"""


@query(
    "consolidated_export",
    f"""WITH {_EXPORTED} SELECT pub AS {q(c.PUB)}, CAST(yr AS VARCHAR) AS {q(c.YEAR)}, kind AS {q(c.PUBLIC_TYPE)},
    sub AS {q(c.PUBLIC_SUBTYPE)}, db.v AS "BASES_DOCUMENTALES_CONSOLIDADAS",
    CAST(NULL AS VARCHAR) AS "REPOSITORIOS_CONSOLIDADOS", CAST(NULL AS VARCHAR) AS "INSTITUCIONES_CONSOLIDADAS",
    dr.v AS {q(c.CONSOLIDATED_REGIONS)}, dt.v AS "AREAS_TEMATICAS_CONSOLIDADAS",
    CAST(NULL AS VARCHAR) AS "EJES_TEMATICOS_CONSOLIDADOS", CAST(NULL AS VARCHAR) AS "LINEAS_INVESTIGACION_CONSOLIDADAS"
    FROM pubs LEFT JOIN dt USING (pub) LEFT JOIN db USING (pub) LEFT JOIN dr USING (pub) WHERE sub <> 'P'""",
)
def consolidated_export(spark, folder):
    scope = X.unique_only(orders_as_publications(spark, folder))
    bridges = {"base": brand_bridge(spark, folder), "area": type_bridge(spark, folder)}
    return D.public_export(scope, bridges, order_territory(spark, folder))


_LEVEL_OF = {
    "1-URGENT": "Doctorado",
    "2-HIGH": "Maestría",
    "3-MEDIUM": " Pregrado ",
    "4-NOT SPECIFIED": "Posgrado no especificado",
    "5-LOW": "No aplica",
}
_LEVELS = f"""lv AS (SELECT o_custkey AS pub, CASE o_orderpriority WHEN '1-URGENT' THEN 'Doctorado'
    WHEN '2-HIGH' THEN 'Maestría' WHEN '3-MEDIUM' THEN 'Pregrado'
    WHEN '4-NOT SPECIFIED' THEN 'Posgrado no especificado' END AS level
  FROM orders WHERE o_orderstatus = 'F'),
  agg AS (SELECT pub, bool_or(level = 'Doctorado') AS d, bool_or(level = 'Maestría') AS m,
    bool_or(level = 'Pregrado') AS p, bool_or(level = 'Posgrado no especificado') AS g,
    count(DISTINCT level) AS n, string_agg(DISTINCT level, ' | ' ORDER BY level) AS vals FROM lv GROUP BY 1),
  res AS (SELECT pub, vals, n, p AND (d OR m OR g) AS clash,
    CASE WHEN d OR m THEN 'Posgrado' WHEN p THEN 'Pregrado' WHEN g THEN 'Posgrado' ELSE 'Otros' END AS grade,
    CASE WHEN d THEN 'Doctorado' WHEN m THEN 'Maestría' WHEN p THEN 'Pregrado' ELSE 'Otros' END AS lev FROM agg)"""


def customer_levels(spark, folder) -> tuple[DataFrame, DataFrame]:
    records = read(spark, folder, "orders").select(
        F.col("o_orderkey").alias(c.RECORD),
        F.when(F.col("o_orderstatus") == "F", fv.THESIS).otherwise(fv.ARTICLE).alias(c.TYPE_NORM),
        t.lookup(F.col("o_orderpriority"), _LEVEL_OF).alias(c.RAW_LEVEL),
    )
    return L.derive_academic_fields(records, customer_record_map(spark, folder))


@query(
    "precedence_level",
    f"""WITH {_LEVELS} SELECT pub AS {q(c.PUB)}, grade AS {q(c.GRADE)}, lev AS {q(c.LEVEL)} FROM res""",
)
def precedence_level(spark, folder):
    return customer_levels(spark, folder)[0]


@query(
    "level_conflicts",
    f"""WITH {_LEVELS} SELECT pub AS {q(c.PUB)}, vals AS "VALORES_ORIGEN", grade AS {q(c.GRADE)}, lev AS {q(c.LEVEL)},
    CASE WHEN clash THEN 'grados_contradictorios' ELSE 'niveles_multiples' END AS "TIPO_CONFLICTO",
    {s(fv.CONFLICT_RULE)} AS "REGLA" FROM res WHERE n > 1""",
)
def level_conflicts(spark, folder):
    return customer_levels(spark, folder)[1]


@query(
    "family_superset",
    f"""WITH {_LEVELS} SELECT pub AS {q(c.PUB)} FROM res WHERE clash""",
)
def family_superset(spark, folder):
    conflicts = customer_levels(spark, folder)[1]
    return conflicts.filter(F.col("TIPO_CONFLICTO") == fv.CONFLICT_CONTRADICTORY).select(c.PUB)


@query(
    "keep_first_unique",
    f"""WITH d AS (SELECT doc_id, CASE WHEN source = 'src0' THEN NULL ELSE source || '/' || lang END AS mk
      FROM documents WHERE lang <> 'fr')
    SELECT min(doc_id) AS {q(c.RECORD)}, mk AS {q(c.MASTER_KEY)}, 'SI' AS {q(c.UNIQUE_FLAG)} FROM d GROUP BY mk""",
)
def keep_first_unique(spark, folder):
    docs = read(spark, folder, "documents")
    key = F.when(F.col("source") != "src0", F.concat_ws("/", "source", "lang"))
    frame = docs.select(
        F.col("doc_id").alias(c.RECORD),
        F.col("doc_id").alias(c.ORD),
        key.alias(c.MASTER_KEY),
        F.when(F.col("lang") == "fr", " si").otherwise("si").alias(c.UNIQUE_FLAG),
    )
    return U.unique_public_base(frame).select(c.RECORD, c.MASTER_KEY, c.UNIQUE_FLAG)


def orders_with_blanks(spark, folder) -> DataFrame:
    status, priority = F.col("o_orderstatus"), F.col("o_orderpriority")
    return read(spark, folder, "orders").select(
        F.col("o_orderkey").alias(c.PUB),
        F.when(status == "F", " \t").when(status == "O", F.concat(F.lit(" "), priority)).alias(c.LANGUAGE),
        F.when(priority != "5-LOW", priority).alias(c.JOURNAL),
    )


@query(
    "recode_empties",
    f"""SELECT {s(c.LANGUAGE)} AS campo, count(*) FILTER (o_orderstatus <> 'O') AS vacios_recodificados_como_otros
    FROM orders UNION ALL SELECT {s(c.JOURNAL)}, count(*) FILTER (o_orderpriority = '5-LOW') FROM orders""",
)
def recode_empties(spark, folder):
    return U.recode_empties(orders_with_blanks(spark, folder))[1]


@query(
    "recoded_values",
    f"""SELECT o_orderkey AS {q(c.PUB)}, CASE WHEN o_orderstatus = 'O' THEN o_orderpriority ELSE 'Otros' END
    AS {q(c.LANGUAGE)}, CASE WHEN o_orderpriority = '5-LOW' THEN 'Otros' ELSE o_orderpriority END AS {q(c.JOURNAL)}
    FROM orders""",
)
def recoded_values(spark, folder):
    return U.recode_empties(orders_with_blanks(spark, folder))[0]


# Customers are master keys: the first order of a customer is the chosen record.
_PUBLIC_TERRITORY = f"""{SUPPLY}, base AS (
    SELECT o_custkey AS mk, min(o_orderkey) AS rec FROM orders WHERE o_orderstatus <> 'P' GROUP BY 1),
  ex AS (SELECT DISTINCT mk, rec, dep, on_map FROM supply JOIN orders ON o_orderkey = l_orderkey
    JOIN base ON mk = o_custkey)"""


def customer_public_territory(spark, folder) -> dict[str, DataFrame]:
    orders = read(spark, folder, "orders")
    frame = orders.select(
        F.col("o_orderkey").alias(c.RECORD),
        F.col("o_orderkey").alias(c.ORD),
        F.col("o_custkey").alias(c.MASTER_KEY),
        F.when(F.col("o_orderstatus") == "P", "NO").otherwise("SI").alias(c.UNIQUE_FLAG),
    )
    keys = orders.select("o_orderkey", F.col("o_custkey").alias(c.MASTER_KEY))
    territory = (
        supply(spark, folder)
        .join(keys, F.col("l_orderkey") == F.col("o_orderkey"))
        .select(
            F.col("l_orderkey").alias(c.RECORD),
            F.col("l_orderkey").alias(c.ORD),
            c.MASTER_KEY,
            c.DEP_KEY,
            F.col(c.DEP_NAME).alias(c.DEP_BASE),
            c.ON_MAP,
        )
    )
    return U.public_territory(U.unique_public_base(frame), territory, departments(spark, folder))


@query(
    "lookup_remap",
    f"""WITH {_PUBLIC_TERRITORY} SELECT mk AS {q(c.MASTER_KEY)}, rec AS {q(c.RECORD)}, dep AS {q(c.DEP_KEY)} FROM ex""",
)
def lookup_remap(spark, folder):
    return customer_public_territory(spark, folder)[c.T_TERRITORY].select(c.MASTER_KEY, c.RECORD, c.DEP_KEY)


@query(
    "public_territory",
    f"""WITH {_PUBLIC_TERRITORY}, n AS (SELECT dep, count(rec) AS a, count(DISTINCT mk) AS b FROM ex
      WHERE on_map GROUP BY 1)
    SELECT {DEP_COLUMNS}, coalesce(a, 0) AS registros_territoriales, coalesce(b, 0) AS publicaciones_unicas,
    coalesce(b, 0) AS publicaciones_bibliograficas FROM nation LEFT JOIN n ON dep = n_nationkey""",
)
def public_territory(spark, folder):
    return customer_public_territory(spark, folder)[c.T_MAP]


@query(
    "public_coverage",
    f"""WITH {_PUBLIC_TERRITORY}
    SELECT 'publicaciones_unicas' AS indicador, count(*) AS valor FROM base
    UNION ALL SELECT 'relaciones_territoriales_publicas', count(*) FROM ex
    UNION ALL SELECT 'relaciones_territoriales_en_geojson', count(*) FROM ex WHERE on_map
    UNION ALL SELECT 'departamentos_con_datos', count(DISTINCT dep) FROM ex WHERE on_map
    UNION ALL SELECT 'departamentos_sin_cruce_geojson', count(DISTINCT dep) FROM ex WHERE NOT on_map""",
)
def public_coverage(spark, folder):
    return customer_public_territory(spark, folder)[c.T_COVERAGE]


@query(
    "uncrossed_departments",
    f"""WITH {_PUBLIC_TERRITORY} SELECT DISTINCT n_name AS {q(c.DEP_BASE)}, dep AS {q(c.DEP_KEY)}
    FROM ex JOIN nation ON n_nationkey = dep WHERE NOT on_map""",
)
def uncrossed_departments(spark, folder):
    return customer_public_territory(spark, folder)[c.T_UNCROSSED]


# ==========================================================================
# Text
# ==========================================================================
def sql_upper(x: str) -> str:
    return rf"trim(regexp_replace(replace(strip_accents(upper({x})), 'ẞ', 'SS'), '\s+', ' ', 'g'))"


def sql_lower(x: str) -> str:
    return rf"trim(regexp_replace(replace(strip_accents(lower({x})), 'ß', 'ss'), '\s+', ' ', 'g'))"


@query("normalize_key", f"SELECT doc_id, {sql_upper('text')} AS clave FROM documents")
def normalize_key(spark, folder):
    return read(spark, folder, "documents").select("doc_id", t.fold_upper(F.col("text")).alias("clave"))


@query("normalize_lower", f"SELECT page_id, {sql_lower('html')} AS clave FROM pages")
def normalize_lower(spark, folder):
    return read(spark, folder, "pages").select("page_id", t.fold_lower(F.col("html")).alias("clave"))


@query("normalize_nfd", "SELECT doc_id, strip_accents(lower(trim(text, ' \t\n\r'))) AS texto FROM documents")
def normalize_nfd(spark, folder):
    return read(spark, folder, "documents").select("doc_id", t.strip_marks_lower(F.col("text")).alias("texto"))


@query("unicode_trim", "SELECT page_id, trim(html, ' \t\n\r') AS texto FROM pages")
def unicode_trim(spark, folder):
    padded = F.concat(F.lit(" \t \n"), F.col("html"), F.lit("　\r \u0085"))
    return read(spark, folder, "pages").select("page_id", t.unicode_trim(padded).alias("texto"))


@query(
    "otros_test",
    """SELECT doc_id, source IN ('src1', 'src2') AS es_otros, source IN ('src1', 'src2', 'src3', 'src4') AS vacio,
    lower(trim(text)) = 'otros' AS texto_otros,
    coalesce(lower(trim(text)) IN ('', 'otros', 'no aplica'), true) AS texto_vacio FROM documents""",
)
def otros_test(spark, folder):
    source, text = F.col("source"), F.col("text")
    value = (
        F.when(source == "src1", "Otros")
        .when(source == "src2", "\u00a0 OTROS\t")
        .when(source == "src3", " No aplica ")
        .when(source == "src4", "")
        .otherwise(source)
    )
    return read(spark, folder, "documents").select(
        "doc_id",
        t.is_others(value).alias("es_otros"),
        t.is_empty_category(value).alias("vacio"),
        t.is_others(text).alias("texto_otros"),
        t.is_empty_category(text).alias("texto_vacio"),
    )


@query(
    "database_name_cleanup",
    """SELECT doc_id, CASE source WHEN 'src1' THEN 'Cóndor' WHEN 'src2' THEN 'Diagnóstico Madre de Dios'
    ELSE source || ' ' || lang END AS base FROM documents""",
)
def database_name_cleanup(spark, folder):
    source = F.col("source")
    raw = (
        F.when(source == "src1", "Condor")
        .when(source == "src2", "Diagnostico \t Madre de Dios ")
        .otherwise(F.concat(source, F.lit(" \n "), F.col("lang")))
    )
    numbered = F.concat(F.lit(" "), F.col("doc_id").cast("string"), F.lit(".  "), raw)
    return read(spark, folder, "documents").select("doc_id", t.database_name(numbered).alias("base"))


@query(
    "path_labels",
    """SELECT o_orderkey, o_orderpriority || ' › ' || o_orderstatus || ' › ' || CAST(year(o_orderdate) AS VARCHAR) AS ruta,
    CAST(year(o_orderdate) AS VARCHAR) AS hoja, o_orderstatus || ' › ' || CAST(year(o_orderdate) AS VARCHAR) AS resto
    FROM orders""",
)
def path_labels(spark, folder):
    path = t.path_label(F.col("o_orderpriority"), F.col("o_orderstatus"), F.year("o_orderdate"))
    return (
        read(spark, folder, "orders")
        .select("o_orderkey", path.alias("ruta"))
        .withColumns({"hoja": t.path_leaf(F.col("ruta")), "resto": t.path_rest(F.col("ruta"))})
    )


@query(
    "thousands_label",
    """SELECT o_orderkey, replace(format('{:,}', CAST(floor(o_totalprice) AS BIGINT)), ',', ' ') AS total,
    o_orderpriority AS texto FROM orders""",
)
def thousands_label(spark, folder):
    return read(spark, folder, "orders").select(
        "o_orderkey",
        t.thousands(F.col("o_totalprice")).alias("total"),
        t.thousands(F.col("o_orderpriority")).alias("texto"),
    )


@query(
    "unique_flag_filter",
    f"SELECT o_orderkey AS {q(c.PUB)} FROM orders WHERE o_orderstatus = 'O'",
)
def unique_flag_filter(spark, folder):
    status = F.col(c.PUBLIC_SUBTYPE)
    pubs = orders_as_publications(spark, folder).withColumn(
        c.UNIQUE_FLAG, F.when(status == "O", "Si").when(status == "F", "SI ")
    )
    return X.unique_only(pubs).select(c.PUB)


@query("non_empty_filter", f"SELECT o_orderkey AS {q(c.PUB)} FROM orders WHERE o_orderstatus = 'O'")
def non_empty_filter(spark, folder):
    return orders_with_blanks(spark, folder).filter(t.non_empty(F.col(c.LANGUAGE))).select(c.PUB)


@query(
    "value_mapping",
    """SELECT o_orderkey, CASE o_orderpriority WHEN '1-URGENT' THEN 'Urgente' ELSE o_orderpriority END AS reemplazo,
    CASE o_orderpriority WHEN '1-URGENT' THEN 'Urgente' WHEN '2-HIGH' THEN 'Alta' END AS mapeo,
    CASE o_orderstatus WHEN 'F' THEN 'cerrado' ELSE 'abierto' END AS estado FROM orders""",
)
def value_mapping(spark, folder):
    priority = F.col("o_orderpriority")
    return read(spark, folder, "orders").select(
        "o_orderkey",
        t.recode(priority, {"1-URGENT": "Urgente"}).alias("reemplazo"),
        t.lookup(priority, {"1-URGENT": "Urgente", "2-HIGH": "Alta"}).alias("mapeo"),
        t.lookup(F.col("o_orderstatus"), {"F": "cerrado"}, F.lit("abierto")).alias("estado"),
    )


@query("json_property", "SELECT event_id, regexp_extract(props, '\"k\": ([0-9]+)', 1) AS k FROM events")
def json_property(spark, folder):
    return read(spark, folder, "events").select("event_id", F.get_json_object("props", "$.k").alias("k"))


# ==========================================================================
# Classifiers
# ==========================================================================
# Host prefix and top-level domain -> repository name, one per class.
_REPOSITORY_OF = {
    ("blog", "com"): "Google Scholar",
    ("blog", "net"): "ResearchGate.",
    ("blog", "org"): "  Alicia",
    ("m", "com"): "Revista  de Biología",
    ("m", "net"): "PeerJ",
    ("m", "org"): "Digital Library",
    ("www", "com"): "Serfor",
    ("www", "net"): "Universidad de Lima",
    ("www", "org"): "Repositorio UNALM",
}
_REPOSITORY_CLASS_OF = {
    ("blog", "com"): (fv.REPO_SEARCH, "No"),
    ("blog", "net"): (fv.REPO_NETWORK, "No"),
    ("blog", "org"): (fv.REPO_AGGREGATOR, "No"),
    ("m", "com"): (fv.REPO_JOURNAL, "No"),
    ("m", "net"): (fv.REPO_PUBLISHER, "No"),
    ("m", "org"): (fv.REPO_ARCHIVE, "No"),
    ("www", "com"): (fv.REPO_PUBLIC, "No"),
    ("www", "net"): (fv.REPO_UNIVERSITY, "Si"),
    ("www", "org"): (fv.REPO_UNIVERSITY, "Si"),
}
_HOST = "regexp_extract(url, '^https?://([^/?#]+)', 1)"
_HOST_KEY = f"regexp_extract({_HOST}, '^([^.]+)', 1) || '.' || regexp_extract({_HOST}, '([^.]+)$', 1)"


def _sql_case(on: str, values: dict, default: str) -> str:
    arms = " ".join(f"WHEN {s(a + '.' + b)} THEN {s(v)}" for (a, b), v in values.items())
    return f"CASE {on} {arms} ELSE {default} END"


def page_repositories(spark, folder) -> DataFrame:
    host = F.regexp_extract("url", "^https?://([^/?#]+)", 1)
    key = F.concat_ws(".", F.substring_index(host, ".", 1), F.substring_index(host, ".", -1))
    names = {f"{a}.{b}": v for (a, b), v in _REPOSITORY_OF.items()}
    return read(spark, folder, "pages").select(
        F.col("page_id").alias(c.PUB), t.lookup(key, names, host).alias(c.CATEGORY)
    )


_REPO_SQL = f"""r AS (SELECT page_id,
  {_sql_case(_HOST_KEY, _REPOSITORY_OF, _HOST)} AS cat,
  {_sql_case(_HOST_KEY, {k: v for k, (v, _) in _REPOSITORY_CLASS_OF.items()}, s(fv.UNCLASSIFIED))} AS cls,
  {_sql_case(_HOST_KEY, {k: v for k, (_, v) in _REPOSITORY_CLASS_OF.items()}, "'Indeterminado'")} AS uni
  FROM pages), rp AS (SELECT *, CASE
    WHEN cls IN ({sql_list([fv.REPO_SEARCH, fv.REPO_NETWORK, fv.REPO_INDEX, fv.REPO_AGGREGATOR])}) THEN 1
    WHEN cls IN ({sql_list([fv.REPO_PUBLIC, fv.REPO_ARCHIVE])}) THEN 2
    WHEN cls = {s(fv.REPO_UNIVERSITY)} THEN 3
    WHEN cls IN ({sql_list([fv.REPO_PUBLISHER, fv.REPO_JOURNAL])}) THEN 4 ELSE 5 END AS rule FROM r),
  rc AS (SELECT page_id, cat, cls, uni, CASE rule WHEN 1 THEN 'Buscadores académicos'
    WHEN 2 THEN 'Repositorios institucionales' WHEN 3 THEN 'Repositorios universitarios' WHEN 4 THEN 'Revistas'
    ELSE 'Otros' END AS pub_cls, CASE WHEN rule = 5 THEN 'REP_PUBLICA_005_PENDIENTE_REVISION'
    ELSE 'REP_PUBLICA_00' || rule END AS rule_id, CASE WHEN rule = 5 THEN 'Si' ELSE 'No' END AS rev FROM rp)"""


@query(
    "host_classifier",
    f"""WITH {_REPO_SQL} SELECT page_id AS {q(c.PUB)}, cat AS {q(c.CATEGORY)}, cls AS {q(c.REPO_CLASS)},
    uni AS {q(c.REPO_IS_UNIVERSITY)}, pub_cls AS {q(c.REPO_PUBLIC_CLASS)}, rule_id AS {q(c.REPO_PUBLIC_RULE)},
    rev AS {q(c.REPO_PUBLIC_REVIEW)} FROM rc""",
)
def host_classifier(spark, folder):
    return C.classify_repositories(page_repositories(spark, folder))


@query(
    "host_public_class",
    f"""WITH {_REPO_SQL} SELECT pub_cls AS {q(c.CATEGORY)}, count(DISTINCT page_id) AS {q(c.COUNT)} FROM rc GROUP BY 1""",
)
def host_public_class(spark, folder):
    bridge = B.bridge_from_column(C.classify_repositories(page_repositories(spark, folder)), c.REPO_PUBLIC_CLASS)
    scope = read(spark, folder, "pages").select(F.col("page_id").alias(c.PUB))
    return S.relation_summary(bridge, scope)


# First word of a part name -> institution template around the second word.
_INSTITUTION_OF = {
    "red": ("Boletín del {}", fv.INST_JOURNAL, "No"),
    "blue": ("Sociedad de {}", fv.INST_SOCIETY, "No"),
    "hot": ("Ministerio de {}", fv.INST_STATE, "No"),
    "cold": ("Centro  de {}", fv.INST_CENTRE, "No"),
    "new": ("Universidad Nacional de {}", fv.INST_PUBLIC_UNIVERSITY, "Si"),
    "old": ("{} University", fv.INST_FOREIGN_UNIVERSITY, "Si"),
    "small": ("Pontificia Universidad {}", fv.INST_PRIVATE_UNIVERSITY, "Si"),
    "large": ("Instituto {}", fv.INST_CENTRE, "No"),
}


def part_institutions(spark, folder) -> DataFrame:
    first, second = F.substring_index("p_name", " ", 1), F.substring_index("p_name", " ", -1)
    templates = {k: v[0] for k, v in _INSTITUTION_OF.items()}
    name = F.replace(t.lookup(first, templates), F.lit("{}"), second)
    return read(spark, folder, "part").select(F.col("p_partkey").alias(c.PUB), name.alias(c.CATEGORY))


_FIRST, _SECOND = "split_part(p_name, ' ', 1)", "split_part(p_name, ' ', 2)"
_INST_NAME = (
    f"CASE {_FIRST} "
    + " ".join(f"WHEN {s(k)} THEN replace({s(v[0])}, '{{}}', {_SECOND})" for k, v in _INSTITUTION_OF.items())
    + " END"
)
_INST_SQL = f"""i AS (SELECT p_partkey, {_INST_NAME} AS cat,
  CASE {_FIRST} {" ".join(f"WHEN {s(k)} THEN {s(v[1])}" for k, v in _INSTITUTION_OF.items())} END AS cls,
  CASE {_FIRST} {" ".join(f"WHEN {s(k)} THEN {s(v[2])}" for k, v in _INSTITUTION_OF.items())} END AS uni FROM part),
  ip AS (SELECT *, CASE WHEN cls IN ({sql_list([fv.INST_PUBLIC_UNIVERSITY, fv.INST_PRIVATE_UNIVERSITY])})
      THEN 'Universidad nacional'
    WHEN cls = {s(fv.INST_FOREIGN_UNIVERSITY)} THEN 'Universidad extranjera'
    WHEN cls = {s(fv.INST_STATE)} THEN 'Instituto público / entidad estatal'
    WHEN cls = {s(fv.INST_JOURNAL)} THEN 'Revista / boletín mal ubicado'
    ELSE 'Centro de investigación / cooperación' END AS pub_cls,
    CASE cls WHEN {s(fv.INST_PUBLIC_UNIVERSITY)} THEN 'Pública' WHEN {s(fv.INST_PRIVATE_UNIVERSITY)} THEN 'Privada'
      WHEN {s(fv.INST_FOREIGN_UNIVERSITY)} THEN 'Extranjera' ELSE 'No aplica' END AS sub FROM i)"""


@query(
    "marker_prefix_exact_class",
    f"""WITH {_INST_SQL} SELECT p_partkey AS {q(c.PUB)}, cat AS {q(c.CATEGORY)}, cls AS {q(c.INST_CLASS)},
    uni AS {q(c.INST_IS_UNIVERSITY)}, pub_cls AS {q(c.INST_PUBLIC_CLASS)}, sub AS {q(c.INST_PUBLIC_SUBCLASS)} FROM ip""",
)
def marker_prefix_exact_class(spark, folder):
    return C.classify_institutions(part_institutions(spark, folder))


@query(
    "public_class_lookup",
    f"""WITH {_INST_SQL} SELECT p_partkey AS {q(c.PUB)}, cls AS {q(c.INST_CLASS)}, pub_cls AS {q(c.INST_PUBLIC_CLASS)},
    sub AS {q(c.INST_PUBLIC_SUBCLASS)} FROM ip""",
)
def public_class_lookup(spark, folder):
    bridge = C.classify_institutions(part_institutions(spark, folder)).select(c.PUB, c.INST_CLASS)
    return C.with_default_institution_classes(bridge)


def part_records(spark, folder) -> DataFrame:
    brand = F.col("p_brand")
    journal = (
        F.when(brand == "Brand#1", "Otros").when(brand == "Brand#2", " ").when(brand != "Brand#3", brand)
    )
    named = part_institutions(spark, folder)
    parts = read(spark, folder, "part").select(F.col("p_partkey").alias(c.PUB), "p_name", journal.alias(c.JOURNAL))
    return named.join(parts, c.PUB).select(
        F.col(c.PUB).alias(c.RECORD),
        F.when(F.col("p_name") == "red ring", "Boletín del Instituto del Mar del Perú")
        .otherwise(F.col(c.CATEGORY))
        .alias(c.INSTITUTION),
        c.JOURNAL,
    )


_MIGRATED = f"""m AS (SELECT p_partkey, p_name LIKE 'red %' AS moved,
    CASE WHEN p_name = 'red ring' THEN 'Boletín del Instituto del Mar del Perú' ELSE {_INST_NAME} END AS inst,
    CASE p_brand WHEN 'Brand#1' THEN 'Otros' WHEN 'Brand#2' THEN ' ' WHEN 'Brand#3' THEN NULL ELSE p_brand END AS jour,
    p_brand IN ('Brand#1', 'Brand#2', 'Brand#3') AS blank FROM part),
  f AS (SELECT *, CASE WHEN moved AND blank THEN inst ELSE jour END AS jour2,
    CASE WHEN NOT moved THEN inst WHEN p_name2 THEN 'Instituto del Mar del Perú' ELSE 'Otros' END AS inst2
    FROM (SELECT *, inst = 'Boletín del Instituto del Mar del Perú' AS p_name2 FROM m))"""


@query(
    "migrate_values",
    f"""WITH {_MIGRATED} SELECT p_partkey AS {q(c.RECORD)}, inst2 AS {q(c.INSTITUTION)}, jour2 AS {q(c.JOURNAL)} FROM f""",
)
def migrate_values(spark, folder):
    return L.migrate_misplaced_journals(part_records(spark, folder))[0]


@query(
    "migrate_audit",
    f"""WITH {_MIGRATED} SELECT p_partkey AS {q(c.RECORD)}, CAST(NULL AS VARCHAR) AS {q(c.MASTER_KEY)},
    inst AS "INSTITUCION_ORIGINAL", jour AS "REVISTA_ORIGINAL", jour2 AS "REVISTA_FINAL", inst2 AS "INSTITUCION_FINAL",
    CASE WHEN blank THEN 'migrado_a_nombre_revista' ELSE 'conservado' END AS "ACCION_REVISTA",
    {s(fv.JOURNAL_RULE)} AS "REGLA" FROM f WHERE moved""",
)
def migrate_audit(spark, folder):
    return L.migrate_misplaced_journals(part_records(spark, folder))[1]


# ==========================================================================
# Document types
# ==========================================================================
# Remainder of the page id -> words put before the page's own title.
_TITLE_WORDS = [
    "",
    "Informe Técnico: ",
    "Working paper, ",
    "Protocolo ",
    "Plan nacional ",
    "Capítulo del libro: ",
    "Monografía ",
    "Revisión sistemática ",
    "Nota breve: ",
    "Congreso ",
    "Data  Set ",
    "Diagnóstico ",
    "Guía práctica ",
]
# Remainder of the page id by 7 -> address put before the page's own address.
_ADDRESSES = [
    "",
    "https://www.scielo.org/",
    "https://NCBI.nlm.nih.gov/pmc/articles/",
    "https://link.springer.com/article/",
    "",
    "",
    "",
]


def _pick(values: list[str], index: Column) -> Column:
    return F.get(F.array(*[F.lit(v) for v in values]), F.pmod(index, F.lit(len(values))).cast("int"))


def page_publications(spark, folder) -> DataFrame:
    page = F.col("page_id")
    title = F.regexp_extract("html", "<title>([^<]*)</title>", 1)
    return read(spark, folder, "pages").select(
        page.alias(c.PUB),
        _pick(["Artículo", "Artículo", "Tesis", "Artículo de Conferencia", "Artículo"], page).alias(c.RAW_TYPE),
        _pick(["Maestría", "Doctorado", "otros", "x"], F.floor(page / 5)).alias(c.RAW_LEVEL),
        _pick(["Artículo", "Tesis"], page).alias(c.PUBLIC_TYPE),
        F.when(F.pmod(page, F.lit(3)) != 0, fv.SCIENTIFIC_ARTICLE).alias(c.PUBLIC_SUBTYPE),
        F.concat(_pick(_TITLE_WORDS, page), title).alias(c.TITLE),
        _pick(["", "Otros", "No aplica", "Boletín técnico", "", " "], page).alias(c.JOURNAL),
        F.lit("Congreso virtual").alias(c.REPOSITORY),
        F.when(F.pmod(page, F.lit(11)) == 0, "10.1/x").alias(c.DOI),
        F.lit(None).cast("string").alias(c.VOLUME),
        F.when(F.pmod(page, F.lit(17)) == 0, "4").alias(c.ISSUE),
        F.concat(_pick(_ADDRESSES, page), F.col("url")).alias(c.URL),
    )


def _sql_pick(values: list[str], index: str) -> str:
    return f"list_extract([{sql_list(values)}], CAST(({index}) % {len(values)} AS INTEGER) + 1)"


def sql_present(x: str) -> str:
    return f"({sql_lower(f'coalesce({x}, {chr(39)}{chr(39)})')} NOT IN ('', 'otros', 'no aplica', 'nan'))"


def _sql_label(text: str, labels: list[str]) -> str:
    arms = " ".join(
        f"WHEN regexp_matches({text}, {s(p)}) THEN {s(k)}" for k, p in fv.TYPE_PATTERNS.items() if k in labels
    )
    return f"CASE {arms} END"


def _sql_found(text: str, labels: list[str]) -> str:
    arms = " ".join(
        f"WHEN regexp_matches({text}, {s(p)}) THEN regexp_extract({text}, {s(p)}, 0)"
        for k, p in fv.TYPE_PATTERNS.items()
        if k in labels
    )
    return f"CASE {arms} END"


_HINTS = [*fv.TECHNICAL_SUBTYPES, fv.EVENT_SUBTYPE, *fv.BOOK_SUBTYPES]
_DOMAIN_SQL = ", ".join(f"CASE WHEN contains(url_l, {s(k)}) THEN {s(v)} END" for k, v in fv.EDITORIAL_DOMAINS.items())
_PAGE_SQL = f"""src AS (SELECT page_id, {_sql_pick(["Artículo", "Artículo", "Tesis", "Artículo de Conferencia", "Artículo"], "page_id")} AS raw_type,
    {_sql_pick(["Maestría", "Doctorado", "otros", "x"], "page_id // 5")} AS raw_level,
    {_sql_pick(["Artículo", "Tesis"], "page_id")} AS cur_type,
    CASE WHEN page_id % 3 <> 0 THEN 'Artículo científico' END AS cur_sub,
    {_sql_pick(_TITLE_WORDS, "page_id")} || regexp_extract(html, '<title>([^<]*)</title>', 1) AS title,
    {_sql_pick(["", "Otros", "No aplica", "Boletín técnico", "", " "], "page_id")} AS journal,
    'Congreso virtual' AS repository, CASE WHEN page_id % 11 = 0 THEN '10.1/x' END AS doi,
    CAST(NULL AS VARCHAR) AS volume, CASE WHEN page_id % 17 = 0 THEN '4' END AS issue,
    {_sql_pick(_ADDRESSES, "page_id")} || url AS url FROM pages),
  low AS (SELECT *, {sql_lower("raw_type")} AS type_l, {sql_lower("raw_level")} AS level_l, {sql_lower("title")} AS title_l,
    {sql_lower("url")} AS url_l, concat_ws(' | ', CASE WHEN {sql_present("title")} THEN {sql_lower("title")} END,
      CASE WHEN {sql_present("repository")} THEN {sql_lower("repository")} END,
      CASE WHEN {sql_present("journal")} THEN {sql_lower("journal")} END,
      CASE WHEN {sql_present("url")} THEN {sql_lower("url")} END) AS context FROM src),
  sig AS (SELECT *, list_filter([CASE WHEN {sql_present("journal")} THEN 'revista' END,
      CASE WHEN {sql_present("doi")} THEN 'doi' END, CASE WHEN {sql_present("volume")} THEN 'volumen' END,
      CASE WHEN {sql_present("issue")} THEN 'numero' END, {_DOMAIN_SQL}], lambda x: x IS NOT NULL) AS raw_signals FROM low),
  sig2 AS (SELECT *, list_filter(raw_signals, lambda x, i: list_position(raw_signals, x) = i) AS signals FROM sig),
  hits AS (SELECT *, len(signals) > 0 AS ed, array_to_string(signals, ', ') AS sg,
    {_sql_found("title_l", [fv.EVENT_SUBTYPE])} AS event_f,
    {_sql_label("title_l", fv.TECHNICAL_SUBTYPES)} AS tech_l, {_sql_found("title_l", fv.TECHNICAL_SUBTYPES)} AS tech_f,
    {_sql_label("title_l", fv.BOOK_SUBTYPES)} AS book_l, {_sql_found("title_l", fv.BOOK_SUBTYPES)} AS book_f,
    {_sql_label("title_l", fv.SPECIAL_SUBTYPES)} AS spec_l, {_sql_found("title_l", fv.SPECIAL_SUBTYPES)} AS spec_f,
    {_sql_found("context", _HINTS)} AS hint_f FROM sig2),
  ruled AS (SELECT *, CASE WHEN type_l = 'tesis' THEN 'TESIS_NIVEL_ORIGINAL'
    WHEN type_l = 'articulo de conferencia' THEN 'EVENTO_TIPO_ORIGINAL'
    WHEN event_f IS NOT NULL AND NOT ed THEN 'EVENTO_POR_TITULO'
    WHEN tech_f IS NOT NULL AND ed THEN 'TECNICO_CON_CONFLICTO_EDITORIAL'
    WHEN tech_f IS NOT NULL THEN 'TECNICO_POR_TITULO'
    WHEN book_f IS NOT NULL AND ed THEN 'LIBRO_CON_CONFLICTO_EDITORIAL'
    WHEN book_f IS NOT NULL THEN 'LIBRO_POR_TITULO'
    WHEN spec_l = 'Conjunto de datos' AND ed THEN 'DATOS_CON_CONFLICTO_EDITORIAL'
    WHEN spec_f IS NOT NULL THEN 'SUBTIPO_POR_TITULO'
    WHEN hint_f IS NOT NULL THEN 'ALERTA_CONTEXTO_SIN_RECLASIFICAR' ELSE 'ARTICULO_POR_DEFECTO' END AS rule FROM hits),
  prop AS (SELECT *,
    CASE rule WHEN 'TESIS_NIVEL_ORIGINAL' THEN 'Tesis' WHEN 'TECNICO_POR_TITULO' THEN 'Documento técnico'
      WHEN 'LIBRO_POR_TITULO' THEN 'Libro' WHEN 'SUBTIPO_POR_TITULO' THEN
      CASE WHEN spec_l = 'Conjunto de datos' THEN 'Datos de investigación' ELSE 'Artículo' END ELSE 'Artículo' END AS p_type,
    CASE WHEN rule = 'TESIS_NIVEL_ORIGINAL' THEN CASE level_l WHEN 'maestria' THEN 'Tesis de maestría'
        WHEN 'doctorado' THEN 'Tesis doctoral' ELSE 'Tesis de nivel no especificado' END
      WHEN rule LIKE 'EVENTO_%' THEN 'Publicación de evento científico' WHEN rule = 'TECNICO_POR_TITULO' THEN tech_l
      WHEN rule = 'LIBRO_POR_TITULO' THEN book_l WHEN rule = 'SUBTIPO_POR_TITULO' THEN spec_l
      ELSE 'Artículo científico' END AS p_sub,
    CASE WHEN rule = 'TESIS_NIVEL_ORIGINAL' THEN CASE WHEN level_l IN ('maestria', 'doctorado') THEN 'Alta' ELSE 'Baja' END
      WHEN rule = 'EVENTO_TIPO_ORIGINAL' THEN 'Alta'
      WHEN rule IN ('TECNICO_CON_CONFLICTO_EDITORIAL', 'ALERTA_CONTEXTO_SIN_RECLASIFICAR') THEN 'Baja'
      WHEN rule = 'ARTICULO_POR_DEFECTO' AND NOT ed THEN 'Baja' ELSE 'Media' END AS conf,
    CASE WHEN rule = 'TESIS_NIVEL_ORIGINAL' THEN CASE WHEN level_l IN ('maestria', 'doctorado') THEN 'NO' ELSE 'SI' END
      WHEN rule = 'EVENTO_TIPO_ORIGINAL' THEN 'NO' WHEN rule = 'ARTICULO_POR_DEFECTO' AND ed THEN 'NO' ELSE 'SI' END AS rev,
    CASE rule WHEN 'TESIS_NIVEL_ORIGINAL' THEN 'Tipo original=Tesis; nivel original=' || raw_level
      WHEN 'EVENTO_TIPO_ORIGINAL' THEN 'Tipo original=Artículo de conferencia'
      WHEN 'EVENTO_POR_TITULO' THEN 'Indicador en título: ' || event_f
      WHEN 'TECNICO_CON_CONFLICTO_EDITORIAL' THEN 'Indicador en título: ' || tech_f || '; conflicto con ' || sg
      WHEN 'TECNICO_POR_TITULO' THEN 'Indicador en título: ' || tech_f || '; sin señales editoriales'
      WHEN 'LIBRO_CON_CONFLICTO_EDITORIAL' THEN 'Indicador bibliográfico en título: ' || book_f || '; conflicto con ' || sg
      WHEN 'LIBRO_POR_TITULO' THEN 'Indicador en título: ' || book_f
      WHEN 'DATOS_CON_CONFLICTO_EDITORIAL' THEN 'Indicador en título: ' || spec_f || '; conflicto con ' || sg
      WHEN 'SUBTIPO_POR_TITULO' THEN 'Indicador en título: ' || spec_f || '; señales: ' || CASE WHEN ed THEN sg ELSE 'ninguna' END
      WHEN 'ALERTA_CONTEXTO_SIN_RECLASIFICAR' THEN 'Indicador solo en metadatos contextuales: ' || hint_f || '; señales: '
        || CASE WHEN ed THEN sg ELSE 'ninguna' END
      ELSE CASE WHEN ed THEN sg ELSE 'Sin señales editoriales estructuradas' END END AS evid FROM ruled)"""


def page_audit(spark, folder) -> DataFrame:
    return Y.audit_types(page_publications(spark, folder))


@query(
    "title_rules",
    f"""WITH {_PAGE_SQL} SELECT page_id AS {q(c.PUB)}, p_type AS {q(c.PROPOSED_TYPE)}, p_sub AS {q(c.PROPOSED_SUBTYPE)},
    conf AS {q(c.CONFIDENCE)}, rev AS {q(c.NEEDS_REVIEW)}, rule AS {q(c.RULE)} FROM prop""",
)
def title_rules(spark, folder):
    return page_audit(spark, folder).select(
        c.PUB, c.PROPOSED_TYPE, c.PROPOSED_SUBTYPE, c.CONFIDENCE, c.NEEDS_REVIEW, c.RULE
    )


@query("evidence_text", f"WITH {_PAGE_SQL} SELECT page_id AS {q(c.PUB)}, evid AS {q(c.EVIDENCE)} FROM prop")
def evidence_text(spark, folder):
    return page_audit(spark, folder).select(c.PUB, c.EVIDENCE)


@query("signal_list", f"WITH {_PAGE_SQL} SELECT page_id AS {q(c.PUB)}, sg AS senales FROM hits")
def signal_list(spark, folder):
    folded = C.with_folded(page_publications(spark, folder))
    return folded.select(c.PUB, F.array_join(C.folded_signals(), ", ").alias("senales"))


@query("context_text", f"WITH {_PAGE_SQL} SELECT page_id AS {q(c.PUB)}, context AS contexto FROM low")
def context_text(spark, folder):
    folded = C.with_folded(page_publications(spark, folder))
    return folded.select(c.PUB, C.folded_context().alias("contexto"))


@query(
    "first_pattern",
    f"""WITH d AS (SELECT doc_id, {sql_lower("text || ' | congreso ' || lang || ' handbook'")} AS x FROM documents)
    SELECT doc_id, {_sql_label("x", list(fv.TYPE_PATTERNS))} AS etiqueta, {_sql_found("x", list(fv.TYPE_PATTERNS))} AS hallado
    FROM d""",
)
def first_pattern_query(spark, folder):
    text = F.concat(F.col("text"), F.lit(" | congreso "), F.col("lang"), F.lit(" handbook"))
    docs = bind(read(spark, folder, "documents").select("doc_id", "text", "lang"), {"_key": t.fold_lower(text)})
    hit = bind(docs, {"_hit": first_pattern(F.col("_key"), list(fv.TYPE_PATTERNS))})
    return hit.select("doc_id", F.col("_hit.label").alias("etiqueta"), F.col("_hit.found").alias("hallado"))


@query(
    "change_flags",
    f"""WITH {_PAGE_SQL} SELECT page_id AS {q(c.PUB)}, coalesce(cur_type, '') <> p_type AS "CAMBIO_TIPO",
    coalesce(cur_sub, '') <> p_sub AS "CAMBIO_SUBTIPO", NOT {sql_present("title")} AS "TITULO_VACIO" FROM prop""",
)
def change_flags(spark, folder):
    return page_audit(spark, folder).select(c.PUB, "CAMBIO_TIPO", "CAMBIO_SUBTIPO", "TITULO_VACIO")


@query("manual_review", f"WITH {_PAGE_SQL} SELECT page_id AS {q(c.PUB)}, rule AS {q(c.RULE)} FROM prop WHERE rev = 'SI'")
def manual_review(spark, folder):
    return Y.manual_review(page_audit(spark, folder)).select(c.PUB, c.RULE)


@query(
    "audit_summary",
    f"""WITH {_PAGE_SQL} SELECT p_type AS {q(c.PROPOSED_TYPE)}, p_sub AS {q(c.PROPOSED_SUBTYPE)},
    conf AS {q(c.CONFIDENCE)}, count(*) AS "PUBLICACIONES" FROM prop GROUP BY 1, 2, 3""",
)
def audit_summary(spark, folder):
    return Y.type_audit_report(page_audit(spark, folder))["CLASIFICACION_PROPUESTA"]


@query(
    "audit_rules",
    f"""WITH {_PAGE_SQL} SELECT rule AS {q(c.RULE)}, rev AS {q(c.NEEDS_REVIEW)}, count(*) AS "PUBLICACIONES"
    FROM prop GROUP BY 1, 2""",
)
def audit_rules(spark, folder):
    return Y.type_audit_report(page_audit(spark, folder))["RESUMEN_REGLAS"]


@query(
    "audit_current",
    f"""WITH {_PAGE_SQL} SELECT cur_type AS {q(c.PUBLIC_TYPE)}, cur_sub AS {q(c.PUBLIC_SUBTYPE)},
    count(*) AS "PUBLICACIONES" FROM prop GROUP BY 1, 2""",
)
def audit_current(spark, folder):
    return Y.type_audit_report(page_audit(spark, folder))["CLASIFICACION_ACTUAL"]


@query(
    "audit_indicators",
    f"""WITH {_PAGE_SQL}, a AS (SELECT *, coalesce(cur_type, '') <> p_type AS ct, coalesce(cur_sub, '') <> p_sub AS cs FROM prop)
    SELECT 'Publicaciones auditadas' AS "INDICADOR", count(*) AS "VALOR" FROM a
    UNION ALL SELECT 'Tipos originales distintos', count(DISTINCT raw_type) FROM a
    UNION ALL SELECT 'Títulos vacíos', count(*) FROM a WHERE NOT {sql_present("title")}
    UNION ALL SELECT 'Cambios de tipo candidatos', count(*) FROM a WHERE ct
    UNION ALL SELECT 'Cambios de subtipo candidatos', count(*) FROM a WHERE cs
    UNION ALL SELECT 'Revisión manual requerida', count(*) FROM a WHERE rev = 'SI'
    UNION ALL SELECT 'Confianza alta', count(*) FROM a WHERE conf = 'Alta'
    UNION ALL SELECT 'Confianza media', count(*) FROM a WHERE conf = 'Media'
    UNION ALL SELECT 'Confianza baja', count(*) FROM a WHERE conf = 'Baja'""",
)
def audit_indicators(spark, folder):
    return Y.audit_indicators(page_audit(spark, folder))


@query(
    "build_decisions",
    f"""WITH {_PAGE_SQL} SELECT page_id AS {q(c.PUB)}, p_type AS {q(c.PROPOSED_TYPE)}, p_sub AS {q(c.PROPOSED_SUBTYPE)}
    FROM prop""",
)
def build_decisions(spark, folder):
    """Audited proposals, first relabelled with the older event and thesis labels."""
    audit = page_audit(spark, folder)
    event = F.col(c.PROPOSED_SUBTYPE) == fv.EVENT_PUBLICATION
    older = audit.withColumns(
        {
            c.PROPOSED_TYPE: F.when(event, fv.EVENT_PUBLICATION).otherwise(F.col(c.PROPOSED_TYPE)),
            c.PROPOSED_SUBTYPE: F.when(event, "Ponencia o memoria de evento").otherwise(F.col(c.PROPOSED_SUBTYPE)),
        }
    )
    return Y.build_decisions(older, group_events=True)


def _document_type(text: Column) -> Column:
    lang = F.col("lang")
    word = F.when(lang == "es", "TÉSIS de maestría ").when(lang == "de", "Artículo ").otherwise("")
    return F.concat(word, text)


_BINARY = """b AS (SELECT doc_id, CASE WHEN contains(strip_accents(lower(CASE lang WHEN 'es' THEN 'TÉSIS de maestría '
    WHEN 'de' THEN 'Artículo ' ELSE '' END || text)), 'tesis') THEN 'Tesis' ELSE 'Artículo científico' END AS k FROM documents)"""


@query("binary_type", f"WITH {_BINARY} SELECT doc_id, k AS {q(c.BINARY_TYPE)} FROM b")
def binary_type(spark, folder):
    docs = read(spark, folder, "documents").withColumn(c.RAW_TYPE, _document_type(F.col("text")))
    return Y.with_binary_type(docs).select("doc_id", c.BINARY_TYPE)


@query(
    "binary_type_counts",
    f"""WITH {_BINARY} SELECT 'Tesis' AS {q(c.BINARY_TYPE)}, count(*) FILTER (k = 'Tesis') AS conteo FROM b
    UNION ALL SELECT 'Artículo científico', count(*) FILTER (k <> 'Tesis') FROM b""",
)
def binary_type_counts(spark, folder):
    docs = read(spark, folder, "documents").withColumn(c.RAW_TYPE, _document_type(F.col("text")))
    return Y.binary_type_counts(Y.with_binary_type(docs))


_SUBTYPE_OF = {
    "1-URGENT": "Ponencia o memoria de evento",
    "2-HIGH": fv.MASTER_THESIS,
    "3-MEDIUM": fv.DOCTORAL_THESIS,
    "4-NOT SPECIFIED": fv.POSTGRAD_UNSPECIFIED,
    "5-LOW": "Tesis de pregrado",
}


@query(
    "hierarchy_normalization",
    f"""WITH o AS (SELECT o_orderkey AS pub, o_orderstatus AS st, o_orderpriority AS pr,
      o_orderstatus = 'P' OR o_orderpriority = '1-URGENT' AS ev, o_custkey % 3 AS m FROM orders)
    SELECT pub AS {q(c.PUB)}, CASE WHEN ev THEN 'Artículo' ELSE 'Tesis' END AS {q(c.PUBLIC_TYPE)},
    CASE WHEN ev THEN 'Publicación de evento científico' WHEN pr = '5-LOW' THEN 'Tesis de pregrado'
      ELSE 'Tesis de posgrado' END AS {q(c.PUBLIC_SUBTYPE)},
    CASE WHEN ev OR pr = '5-LOW' THEN NULL WHEN pr = '2-HIGH' THEN 'Tesis de maestría'
      WHEN pr = '3-MEDIUM' THEN 'Tesis doctoral' WHEN m = 0 THEN 'Tesis de maestría' WHEN m = 1 THEN 'Tesis doctoral'
      ELSE 'No identificados' END AS {q(c.POSTGRAD_DETAIL)},
    CASE m WHEN 0 THEN 'Maestría' WHEN 1 THEN 'Doctorado' END AS {q(c.LEVEL)} FROM o""",
)
def hierarchy_normalization(spark, folder):
    third = F.pmod(F.col("o_custkey"), F.lit(3))
    frame = read(spark, folder, "orders").select(
        F.col("o_orderkey").alias(c.PUB),
        F.when(F.col("o_orderstatus") == "P", fv.EVENT_PUBLICATION).otherwise(fv.THESIS).alias(c.PUBLIC_TYPE),
        t.lookup(F.col("o_orderpriority"), _SUBTYPE_OF).alias(c.PUBLIC_SUBTYPE),
        F.when(third == 0, "Maestría").when(third == 1, "Doctorado").alias(c.LEVEL),
    )
    return C.normalize_hierarchy(frame)


def document_theses(spark, folder) -> DataFrame:
    source, lang = F.col("source"), F.col("lang")
    opening = (
        F.when(source == "src1", "Tesis de MAESTRÍA. ")
        .when(source == "src2", "A Ph. D. dissertation; ")
        .when(source == "src3", "master’s thesis ")
        .otherwise("")
    )
    return read(spark, folder, "documents").select(
        F.col("doc_id").alias(c.PUB),
        F.when(lang == "en", fv.ARTICLE).otherwise(" Tesis").alias(c.PUBLIC_TYPE),
        F.when(source == "src4", fv.DOCTORAL_THESIS)
        .when(lang == "es", fv.POSTGRAD_THESIS)
        .otherwise("Tesis de pregrado")
        .alias(c.PUBLIC_SUBTYPE),
        F.when(source == "src5", "Maestría").alias(c.LEVEL),
        F.concat(opening, F.col("text")).alias(c.SUMMARY),
    )


_MASTER = "(?i)" + fv.MASTER_SUMMARY
_DOCTOR = "(?i)" + fv.DOCTORAL_SUMMARY
_THESES = f"""th AS (SELECT doc_id AS pub, lang <> 'en' AS thesis, CASE WHEN source = 'src4' THEN 'Tesis doctoral'
      WHEN lang = 'es' THEN 'Tesis de posgrado' ELSE 'Tesis de pregrado' END AS sub,
    CASE WHEN source = 'src5' THEN 'Maestría' END AS lev,
    CASE source WHEN 'src1' THEN 'Tesis de MAESTRÍA. ' WHEN 'src2' THEN 'A Ph. D. dissertation; '
      WHEN 'src3' THEN 'master’s thesis ' ELSE '' END || text AS summary FROM documents),
  de AS (SELECT *, CASE WHEN NOT thesis THEN NULL WHEN lev = 'Maestría' THEN 'Tesis de maestría'
      WHEN sub = 'Tesis doctoral' THEN 'Tesis doctoral'
      WHEN regexp_matches(summary, {s(_MASTER)}) THEN 'Tesis de maestría'
      WHEN regexp_matches(summary, {s(_DOCTOR)}) THEN 'Tesis doctoral'
      WHEN sub = 'Tesis de posgrado' THEN 'No identificados' END AS det FROM th)"""


@query(
    "postgrad_detail",
    f"""WITH {_THESES} SELECT pub AS {q(c.PUB)}, CASE WHEN det IS NULL THEN sub ELSE 'Tesis de posgrado' END AS {q(c.PUBLIC_SUBTYPE)},
    CASE det WHEN 'Tesis de maestría' THEN 'Maestría' WHEN 'Tesis doctoral' THEN 'Doctorado'
      WHEN 'No identificados' THEN 'No identificado' ELSE lev END AS {q(c.LEVEL)}, det AS {q(c.POSTGRAD_DETAIL)} FROM de""",
)
def postgrad_detail(spark, folder):
    return Y.apply_postgraduate_hierarchy(document_theses(spark, folder)).select(
        c.PUB, c.PUBLIC_SUBTYPE, c.LEVEL, c.POSTGRAD_DETAIL
    )


@query(
    "raw_regex_detail",
    f"""WITH {_THESES} SELECT pub AS {q(c.PUB)}, regexp_matches(summary, {s(_MASTER)}) AS maestria,
    regexp_matches(summary, {s(_DOCTOR)}) AS doctorado FROM th""",
)
def raw_regex_detail(spark, folder):
    summary = F.col(c.SUMMARY)
    return document_theses(spark, folder).select(
        c.PUB,
        C.summary_mentions_master(summary).alias("maestria"),
        C.summary_mentions_doctorate(summary).alias("doctorado"),
    )


@query(
    "merge_hierarchy",
    f"""WITH {_THESES} SELECT doc_id AS {q(c.PUB)}, quality AS nota, CASE WHEN thesis THEN ' Tesis' ELSE 'Artículo' END
      AS {q(c.PROPOSED_TYPE)}, CASE WHEN det IS NULL THEN sub ELSE 'Tesis de posgrado' END AS {q(c.PROPOSED_SUBTYPE)},
      det AS {q(c.POSTGRAD_DETAIL)} FROM labels LEFT JOIN de ON pub = doc_id""",
)
def merge_hierarchy(spark, folder):
    decisions = read(spark, folder, "labels").select(
        F.col("doc_id").alias(c.PUB), F.col("quality").alias("nota"), F.lit("x").alias(c.PROPOSED_TYPE)
    )
    return Y.merge_hierarchy(decisions, Y.apply_postgraduate_hierarchy(document_theses(spark, folder)))


@query(
    "unexpected_distribution",
    f"""WITH {_THESES}, n AS (SELECT det, count(*) AS n FROM de WHERE det IS NOT NULL GROUP BY 1),
    e AS (SELECT * FROM (VALUES ('Tesis de maestría', 54), ('Tesis doctoral', 24), ('No identificados', 389), ('Ausente', 1)) AS v(det, e))
    SELECT coalesce(n.det, e.det) AS {q(c.POSTGRAD_DETAIL)}, CAST(n AS BIGINT) AS obtenido, CAST(e AS BIGINT) AS esperado
    FROM n FULL JOIN e ON n.det = e.det WHERE n IS DISTINCT FROM e""",
)
def unexpected_distribution(spark, folder):
    theses = Y.apply_postgraduate_hierarchy(document_theses(spark, folder))
    return Y.unexpected_distribution(theses, c.POSTGRAD_DETAIL, {**fv.EXPECTED_POSTGRAD, "Ausente": 1})


# ==========================================================================
# Decisions and requests
# ==========================================================================
@query(
    "apply_decisions",
    f"""SELECT d.doc_id AS {q(c.PUB)}, CASE WHEN quality = 1 THEN 'Artículo' ELSE lang END AS {q(c.PUBLIC_TYPE)},
    CASE WHEN quality = 1 THEN CASE WHEN toxic = 0 THEN 'Nota científica' END ELSE source END AS {q(c.PUBLIC_SUBTYPE)}
    FROM documents d LEFT JOIN labels l ON l.doc_id = d.doc_id""",
)
def apply_decisions(spark, folder):
    """A decision with a type overwrites both columns, its empty subtype included."""
    pubs = read(spark, folder, "documents").select(
        F.col("doc_id").alias(c.PUB), F.col("lang").alias(c.PUBLIC_TYPE), F.col("source").alias(c.PUBLIC_SUBTYPE)
    )
    decisions = read(spark, folder, "labels").select(
        F.col("doc_id").alias(c.PUB),
        F.when(F.col("quality") == 1, fv.ARTICLE).alias(c.PROPOSED_TYPE),
        F.when(F.col("toxic") == 0, "Nota científica").alias(c.PROPOSED_SUBTYPE),
    )
    return L.apply_type_decisions(pubs, decisions)


@query(
    "covering_decisions",
    f"""WITH {_PAGE_SQL} SELECT page_id AS {q(c.PUB)}, p_type AS {q(c.PUBLIC_TYPE)}, p_sub AS {q(c.PUBLIC_SUBTYPE)} FROM prop""",
)
def covering_decisions(spark, folder):
    pubs = page_publications(spark, folder).select(c.PUB, c.PUBLIC_TYPE, c.PUBLIC_SUBTYPE)
    return Y.apply_decisions(pubs, Y.build_decisions(page_audit(spark, folder)))


def source_bridge(spark, folder) -> DataFrame:
    bridge = read(spark, folder, "documents").select(
        F.col("doc_id").alias(c.PUB),
        F.col("doc_id").alias(c.ORD),
        F.concat(F.lit(" Repositorio U"), F.col("source")).alias(c.CATEGORY),
        F.lit(1).alias(c.CATEGORY_ORDER),
    )
    return C.classify_repositories(bridge)


def source_requests(spark, folder) -> DataFrame:
    docs = read(spark, folder, "documents").select("doc_id", "source")
    labels = read(spark, folder, "labels")
    return labels.join(docs, "doc_id").select(
        F.col("doc_id").alias(c.PUB),
        F.concat(F.lit("Repositorio U"), F.col("source"), F.lit(" ")).alias(c.REQUEST_OLD),
        F.concat(F.lit("Portal "), F.col("source")).alias(c.REQUEST_NEW),
        F.when(F.col("quality") == 1, fv.PUB_JOURNALS)
        .when(F.col("toxic") == 1, fv.PUB_SEARCH)
        .otherwise(fv.PUB_INSTITUTIONAL)
        .alias(c.REQUEST_CLASS),
    )


_REQUESTED = f"""rq AS (SELECT d.doc_id, source, quality IS NOT NULL AS hit, CASE WHEN quality = 1 THEN 'Revistas'
    WHEN toxic = 1 THEN 'Buscadores académicos' ELSE 'Repositorios institucionales' END AS cls
  FROM documents d LEFT JOIN labels l ON l.doc_id = d.doc_id),
  rt AS (SELECT *, CASE cls WHEN 'Revistas' THEN {s(fv.REPO_JOURNAL)} WHEN 'Buscadores académicos' THEN {s(fv.REPO_SEARCH)}
    ELSE {s(fv.REPO_PUBLIC)} END AS tech FROM rq)"""


@query(
    "requested_updates",
    f"""WITH {_REQUESTED} SELECT doc_id AS {q(c.PUB)},
    CASE WHEN hit THEN 'Portal ' || source ELSE ' Repositorio U' || source END AS {q(c.CATEGORY)},
    CAST(1 AS INTEGER) AS {q(c.CATEGORY_ORDER)},
    CASE WHEN hit THEN tech ELSE 'Repositorio universitario' END AS {q(c.REPO_CLASS)},
    CASE WHEN hit THEN 'No' ELSE 'Si' END AS {q(c.REPO_IS_UNIVERSITY)},
    CASE WHEN hit THEN cls ELSE 'Repositorios universitarios' END AS {q(c.REPO_PUBLIC_CLASS)},
    CASE WHEN hit THEN 'REP_EVALUADA' ELSE 'REP_PUBLICA_003' END AS {q(c.REPO_PUBLIC_RULE)},
    'No' AS {q(c.REPO_PUBLIC_REVIEW)} FROM rt""",
)
def requested_updates(spark, folder):
    bridge, _ = L.apply_repository_requests(
        source_bridge(spark, folder), source_requests(spark, folder), "REP_EVALUADA"
    )
    return bridge.drop(c.ORD)


@query(
    "decision_audit",
    f"""WITH {_REQUESTED} SELECT doc_id AS {q(c.PUB)}, 'Repositorio U' || source AS {q(c.REQUEST_OLD)},
    'Portal ' || source AS {q(c.REQUEST_NEW)}, cls AS {q(c.REQUEST_CLASS)},
    'Repositorio universitario' AS "CLASE_TECNICA_ANTERIOR", 'Repositorios universitarios' AS "CLASE_PUBLICA_ANTERIOR",
    'No' AS "REQUIERE_REVISION_ANTERIOR", tech AS "CLASE_TECNICA_FINAL", cls AS "CLASE_PUBLICA_FINAL",
    'REP_EVALUADA' AS {q(c.RULE)}, 'labels' AS "ARCHIVO_DECISION" FROM rt WHERE hit""",
)
def decision_audit(spark, folder):
    _, audit = L.apply_repository_requests(
        source_bridge(spark, folder), source_requests(spark, folder), "REP_EVALUADA", "labels"
    )
    return audit


@query(
    "verification_join",
    f"""WITH {_REQUESTED} SELECT doc_id AS {q(c.PUB)}, 'Portal ' || source AS {q(c.REQUEST_NEW)},
    cls AS {q(c.REQUEST_CLASS)} FROM rt WHERE hit AND cls = 'Revistas'""",
)
def verification_join(spark, folder):
    """Requests checked against a bridge in which the journal requests were undone."""
    bridge, audit = L.apply_repository_requests(
        source_bridge(spark, folder), source_requests(spark, folder), "REP_EVALUADA"
    )
    undone = bridge.withColumn(
        c.REPO_PUBLIC_CLASS,
        F.when(F.col(c.REPO_PUBLIC_CLASS) != fv.PUB_JOURNALS, F.col(c.REPO_PUBLIC_CLASS)).otherwise(fv.OTHERS),
    )
    return V.requests_not_reflected(audit, undone).select(c.PUB, c.REQUEST_NEW, c.REQUEST_CLASS)


@query(
    "union_audits",
    """SELECT doc_id, quality, CAST(NULL AS INTEGER) AS toxic FROM labels
    UNION ALL SELECT doc_id, CAST(NULL AS INTEGER), toxic FROM labels""",
)
def union_audits(spark, folder):
    labels = read(spark, folder, "labels").select(
        "doc_id", F.col("quality").cast("int").alias("quality"), F.col("toxic").cast("int").alias("toxic")
    )
    return P.union_all([labels.select("doc_id", "quality"), labels.select("doc_id", "toxic")])


# ==========================================================================
# Profile and quality
# ==========================================================================
@query(
    "column_profile",
    f"""WITH b AS (SELECT CASE WHEN o_orderstatus = 'O' THEN ' ' || o_orderpriority WHEN o_orderstatus = 'F' THEN ' ' END AS l,
      CASE WHEN o_orderpriority <> '5-LOW' THEN o_orderpriority END AS j, CAST(o_custkey AS VARCHAR) AS k FROM orders),
    v AS (SELECT 1 AS orden, 'idioma' AS campo, nullif(l, ' ') AS val FROM b UNION ALL
      SELECT 2, 'revista', j FROM b UNION ALL SELECT 3, 'cliente', k FROM b),
    c AS (SELECT orden, campo, val, count(*) AS n FROM v GROUP BY 1, 2, 3),
    r AS (SELECT *, row_number() OVER (PARTITION BY campo ORDER BY n DESC, val) AS rk FROM c WHERE val IS NOT NULL)
    SELECT CAST(c.orden AS INTEGER) AS orden, c.campo AS campo, CAST(sum(c.n) AS BIGINT) AS filas,
      CAST(coalesce(sum(c.n) FILTER (c.val IS NOT NULL), 0) AS BIGINT) AS no_vacios,
      CAST(coalesce(sum(c.n) FILTER (c.val IS NULL), 0) AS BIGINT) AS vacios,
      round(100.0::DOUBLE * coalesce(sum(c.n) FILTER (c.val IS NULL), 0) / sum(c.n), 2) AS porcentaje_vacios,
      count(c.val) AS valores_unicos, any_value(t.txt) AS valores_frecuentes
    FROM c JOIN (SELECT campo, string_agg(val || ' [' || n || ']', ' || ' ORDER BY rk) AS txt FROM r WHERE rk <= 5 GROUP BY 1) t
      ON t.campo = c.campo GROUP BY 1, 2""",
)
def column_profile(spark, folder):
    status, priority = F.col("o_orderstatus"), F.col("o_orderpriority")
    frame = read(spark, folder, "orders").select(
        F.when(status == "O", F.concat(F.lit(" "), priority)).when(status == "F", " ").alias("idioma"),
        F.when(priority != "5-LOW", priority).alias("revista"),
        F.col("o_custkey").cast("string").alias("cliente"),
    )
    return P.column_profile(frame)


@query(
    "text_profile",
    """WITH v AS (SELECT 1 AS orden, 'url' AS campo, url AS val FROM pages UNION ALL SELECT 2, 'html', html FROM pages
      UNION ALL SELECT 1, 'text', text FROM documents UNION ALL SELECT 2, 'source', source FROM documents),
    f AS (SELECT orden, campo, CASE WHEN trim(val) <> '' THEN val END AS val FROM v),
    c AS (SELECT orden, campo, val, count(*) AS n FROM f GROUP BY 1, 2, 3),
    r AS (SELECT *, row_number() OVER (PARTITION BY campo ORDER BY n DESC, val[1:64], md5(val)) AS rk
      FROM c WHERE val IS NOT NULL)
    SELECT CAST(c.orden AS INTEGER) AS orden, c.campo AS campo, CAST(sum(c.n) AS BIGINT) AS filas,
      CAST(coalesce(sum(c.n) FILTER (c.val IS NOT NULL), 0) AS BIGINT) AS no_vacios,
      CAST(coalesce(sum(c.n) FILTER (c.val IS NULL), 0) AS BIGINT) AS vacios,
      round(100.0::DOUBLE * coalesce(sum(c.n) FILTER (c.val IS NULL), 0) / sum(c.n), 2) AS porcentaje_vacios,
      count(c.val) AS valores_unicos, any_value(t.txt) AS valores_frecuentes
    FROM c JOIN (SELECT campo, string_agg(val || ' [' || n || ']', ' || ' ORDER BY rk) AS txt FROM r WHERE rk <= 5 GROUP BY 1) t
      ON t.campo = c.campo GROUP BY 1, 2""",
)
def text_profile(spark, folder):
    """Profile of whole pages and documents; texts move as digests."""
    pages = P.column_profile(read(spark, folder, "pages"), ["url", "html"])
    return pages.unionByName(P.column_profile(read(spark, folder, "documents"), ["text", "source"]))


@query(
    "bridge_cardinality",
    f"""WITH {TYPES}, {BRANDS}, n AS (SELECT 'tipos' AS dimension, pub, count(*) AS n FROM types GROUP BY 1, 2
      UNION ALL SELECT 'marcas', pub, count(*) FROM brands GROUP BY 1, 2)
    SELECT dimension, CAST(sum(n) AS BIGINT) AS relaciones, count(*) AS publicaciones,
    count(*) FILTER (n > 1) AS publicaciones_multivalor, max(n) AS max_categorias_por_publicacion FROM n GROUP BY 1""",
)
def bridge_cardinality(spark, folder):
    return P.bridge_cardinality({"tipos": type_bridge(spark, folder), "marcas": brand_bridge(spark, folder)})


@query(
    "multivalued_listing",
    f"""WITH {PUBS}, {TYPES} SELECT pub AS {q(c.PUB)}, kind AS {q(c.REGION)},
    string_agg(DISTINCT cat, '; ' ORDER BY cat) AS "REGIONES_DIMENSION" FROM pubs JOIN types USING (pub)
    GROUP BY 1, 2 HAVING count(DISTINCT cat) > 1""",
)
def multivalued_listing(spark, folder):
    pubs = orders_as_publications(spark, folder).withColumnRenamed(c.PUBLIC_TYPE, c.REGION)
    return P.multivalued_listing(pubs, type_bridge(spark, folder), c.REGION)


def orders_with_region(spark, folder) -> DataFrame:
    """Scalar category beside the bridge: single, joined pair, or outside the bridge."""
    first = (
        type_bridge(spark, folder)
        .groupBy(c.PUB)
        .agg(F.min(c.CATEGORY).alias("_a"), F.max(c.CATEGORY).alias("_b"))
    )
    status = F.col(c.PUBLIC_SUBTYPE)
    return (
        orders_as_publications(spark, folder)
        .join(first, c.PUB, "left")
        .select(
            c.PUB,
            F.when(status == "O", F.col("_a"))
            .when(status == "F", F.concat_ws("; ", "_a", "_b"))
            .otherwise("NINGUNA")
            .alias(c.REGION),
        )
    )


_SCALAR = f"""{PUBS}, {TYPES}, ab AS (SELECT pub, min(cat) AS a, max(cat) AS b FROM types GROUP BY 1),
  sc AS (SELECT pub, CASE sub WHEN 'O' THEN a WHEN 'F' THEN concat_ws('; ', a, b) ELSE 'NINGUNA' END AS val
    FROM pubs LEFT JOIN ab USING (pub)),
  ou AS (SELECT pub, val, NOT EXISTS (SELECT 1 FROM types x WHERE x.pub = sc.pub AND x.cat = val) AS w,
    EXISTS (SELECT 1 FROM (SELECT unnest(string_split(val, '; ')) AS p) s WHERE NOT EXISTS
      (SELECT 1 FROM types x WHERE x.pub = sc.pub AND x.cat = s.p)) AS p FROM sc WHERE val IS NOT NULL AND trim(val) <> '')"""


@query(
    "scalar_vs_bridge",
    f"""WITH {_SCALAR} SELECT pub AS {q(c.PUB)}, val AS {q(c.REGION)}, w AS fuera_completo, p AS fuera_partes
    FROM ou WHERE w OR p""",
)
def scalar_vs_bridge(spark, folder):
    return P.scalar_outside_bridge(orders_with_region(spark, folder), type_bridge(spark, folder), c.REGION)


@query(
    "controls",
    f"""WITH {_SCALAR}, many AS (SELECT pub FROM types GROUP BY 1 HAVING count(*) > 1),
    n AS (SELECT pub, count(*) AS n FROM types GROUP BY 1),
    r AS (SELECT 1 AS i, 0 AS cantidad UNION ALL
      SELECT 2, count(*) FROM pubs LEFT JOIN n USING (pub) WHERE coalesce(n, 0) <> coalesce(n, 1) UNION ALL
      SELECT 3, 0 UNION ALL SELECT 4, count(*) FROM many UNION ALL SELECT 5, count(*) FROM ou WHERE w UNION ALL
      SELECT 6, count(*) FROM many),
    d AS (SELECT * FROM (VALUES
      (1, 'Unicidad ID_PUBLICACION_PROPUESTA', 'ERROR', 'Duplicados en BD_APP'),
      (2, 'Consistencia REGISTROS_EN_GRUPO', 'ERROR', 'No coincide con REGISTRO_PUBLICACION'),
      (3, 'Consistencia representante', 'ERROR', 'Representante inconsistente dentro del mapeo'),
      (4, 'Publicaciones con múltiples regiones', 'ADVERTENCIA', 'DIM_REGIONES_NORMALIZADAS conserva más de una categoría'),
      (5, 'Región principal no contenida en dimensión', 'ERROR', 'REGION_NORM_SUGERIDA no aparece en DIM_REGIONES_NORMALIZADAS'),
      (6, 'Pérdida potencial al exportar región escalar', 'ALTO', 'Publicaciones multirregionales reducidas a REGION_NORM_SUGERIDA en BD_APP')
      ) AS v(i, control, sev, detalle))
    SELECT control, CASE WHEN cantidad = 0 THEN 'OK' ELSE sev END AS resultado, CAST(cantidad AS BIGINT) AS cantidad, detalle
    FROM r JOIN d ON r.i = d.i""",
)
def controls(spark, folder):
    """Record map: the (order, category) relations; orders without one count as a mismatch."""
    bridge = type_bridge(spark, folder)
    pubs = orders_with_region(spark, folder)
    sizes = bridge.groupBy(c.PUB).agg(F.count(F.lit(1)).cast("string").alias(c.GROUP_SIZE))
    pubs = pubs.join(sizes, c.PUB, "left").withColumn(c.GROUP_SIZE, F.coalesce(c.GROUP_SIZE, F.lit("1")))
    mapping = bridge.select(c.PUB, F.col(c.PUB).alias(c.REPRESENTATIVE))
    return P.catalogue_audit(pubs, mapping, bridge)


@query(
    "orphans",
    f"""WITH {PUBS}, {TYPES} SELECT pub AS {q(c.PUB)} FROM pubs WHERE pub NOT IN (SELECT pub FROM types)""",
)
def orphans(spark, folder):
    return K.orphans(orders_as_publications(spark, folder), type_bridge(spark, folder), c.PUB)


@query(
    "key_coverage",
    f"""WITH {PUBS}, {TYPES}, a AS (SELECT pub FROM pubs WHERE sub <> 'P'), b AS (SELECT DISTINCT pub FROM types WHERE cat = 'PROMO')
    SELECT coalesce(a.pub, b.pub) AS {q(c.PUB)}, CASE WHEN b.pub IS NULL THEN 'left' ELSE 'right' END AS only_in
    FROM a FULL JOIN b ON a.pub = b.pub WHERE a.pub IS NULL OR b.pub IS NULL""",
)
def key_coverage(spark, folder):
    promo = type_bridge(spark, folder).filter(F.col(c.CATEGORY) == "PROMO")
    return K.key_differences(X.unique_only(orders_as_publications(spark, folder)), promo, c.PUB)


@query(
    "duplicate_keys",
    """SELECT o_custkey, count(*) AS n FROM orders GROUP BY 1 HAVING count(*) > 1""",
)
def duplicate_keys(spark, folder):
    return K.duplicate_keys(read(spark, folder, "orders").select("o_custkey"), ["o_custkey"])


@query(
    "domain_difference",
    """SELECT DISTINCT o_orderpriority FROM orders WHERE o_orderpriority NOT IN ('1-URGENT', '2-HIGH', '9-NONE')
    UNION ALL SELECT '9-NONE'""",
)
def domain_difference(spark, folder):
    """Values that are not allowed, and allowed values that never occur."""
    orders = read(spark, folder, "orders").select("o_orderpriority")
    allowed = ["1-URGENT", "2-HIGH", "9-NONE"]
    return K.outside_domain(orders, "o_orderpriority", allowed).unionByName(
        V.missing_values(orders, "o_orderpriority", allowed)
    )


@query(
    "row_controls",
    """SELECT 'implicacion' AS control, CASE WHEN n = 0 THEN 'OK' ELSE 'ERROR' END AS resultado, n AS cantidad,
      'Filas que incumplen' AS detalle
    FROM (SELECT count(*) FILTER (o_orderstatus = 'P' AND o_orderpriority <> '5-LOW') AS n FROM orders)
    UNION ALL SELECT 'estado conocido', 'OK', 0, 'Filas que incumplen'""",
)
def row_controls(spark, folder):
    status, priority = F.col("o_orderstatus"), F.col("o_orderpriority")
    return V.row_controls(
        read(spark, folder, "orders"),
        {
            "implicacion": (status == "P") & (priority != "5-LOW"),
            "estado conocido": ~status.isin("P", "F", "O"),
        },
    )


@query(
    "checked_inner_join",
    """SELECT o_orderkey, o_custkey, c_mktsegment FROM orders JOIN customer ON c_custkey = o_custkey""",
)
def checked_inner_join(spark, folder):
    orders = read(spark, folder, "orders").select("o_orderkey", "o_custkey")
    customers = read(spark, folder, "customer").select(F.col("c_custkey").alias("o_custkey"), "c_mktsegment")
    return K.join_many_to_one(orders, customers, ["o_custkey"], "inner", "customer key repeats")


# ==========================================================================
# Compiled controls
# ==========================================================================
def _control(name: str, number: str, detail: str) -> str:
    return f"SELECT {s(name)} AS control, {number} AS cantidad, {detail} AS detalle"


def _controls_sql(rows: list[str]) -> str:
    return f"""SELECT control, CASE WHEN cantidad = 0 THEN 'OK' ELSE 'ERROR' END AS resultado, cantidad, detalle
    FROM ({" UNION ALL ".join(rows)})"""


def _count_sql(table: str, condition: str = "true") -> str:
    return f"(SELECT count(*) FILTER ({condition}) FROM {table})"


def _total_sql(name: str, expected: int, table: str, condition: str = "true") -> str:
    found = _count_sql(table, condition)
    return _control(name, f"abs({found} - {expected})", f"'Esperado {expected}, obtenido ' || {found}")


@query(
    "control_marks",
    _controls_sql(
        [
            _total_sql("total de pedidos", 10, "orders"),
            _total_sql("pedidos pendientes", 0, "orders", "o_orderstatus = 'Z'"),
            _control("tipo ausente", _count_sql("orders", "o_orderstatus = 'P'"), "'Filas que incumplen'"),
            _control(
                "detalle solo en terminados",
                _count_sql("orders", "o_orderstatus NOT IN ('F', 'P')"),
                "'Filas que incumplen'",
            ),
            _control(
                "prefijo numérico", _count_sql("orders", "o_orderpriority LIKE '1-%'"), "'Filas que incumplen'"
            ),
            _control(
                "valor prohibido", _count_sql("orders", "o_orderpriority = '5-LOW'"), "'Filas que incumplen'"
            ),
            _control(
                "estado permitido",
                "(SELECT count(DISTINCT o_orderstatus) FROM orders WHERE o_orderstatus NOT IN ('F', 'X'))",
                "'Valores fuera del dominio'",
            ),
            _control(
                "estado permitido (completo)",
                "2 - (SELECT count(DISTINCT o_orderstatus) FROM orders WHERE o_orderstatus IN ('F', 'X'))",
                "'Valores requeridos ausentes'",
            ),
            _control(
                "distribución",
                """(SELECT count(*) FROM (SELECT o_orderstatus AS v, count(*) AS n FROM orders GROUP BY 1)
                  FULL JOIN (VALUES ('F', 1), ('X', 2)) w(v, m) USING (v) WHERE n IS DISTINCT FROM m)""",
                "'Conteos inesperados'",
            ),
            _control(
                "solo marcas grandes",
                """(SELECT count(DISTINCT p_brand) FROM part WHERE p_size > 40 AND p_brand <> 'Brand#11')""",
                "'Valores fuera de la clase'",
            ),
            _control(
                "tamaño conocido", _count_sql("part", "p_size IS NULL"), "'Filas que incumplen'"
            ),
        ]
    ),
)
def control_marks(spark, folder):
    """Totals, completeness, conditional nulls, formats, forbidden values, domains and counts of two tables."""
    orders, parts = read(spark, folder, "orders"), read(spark, folder, "part")
    status, priority = F.col("o_orderstatus"), F.col("o_orderpriority")
    out = Controls(spark)
    out.total("total de pedidos", orders, 10)
    out.total("pedidos pendientes", orders, 0, status == "Z")
    out.none("tipo ausente", orders, F.when(status != "P", priority).isNull())
    out.none("detalle solo en terminados", orders, (status != "F") & F.when(status != "P", priority).isNotNull())
    out.none("prefijo numérico", orders, t.has_numeric_prefix(F.regexp_replace(priority, "^1-", "1. ")))
    out.none("valor prohibido", orders, priority == "5-LOW")
    out.domain("estado permitido", orders, "o_orderstatus", ["F", "X"], exact=True)
    out.distribution("distribución", orders, "o_orderstatus", {"F": 1, "X": 2}, "Conteos inesperados")
    out.no_value(
        "solo marcas grandes",
        parts,
        F.col("p_brand"),
        (F.col("p_size") > 40) & (F.col("p_brand") != "Brand#11"),
        "Valores fuera de la clase",
    )
    out.none("tamaño conocido", parts, F.col("p_size").isNull())
    return out.rows()


@query(
    "control_keys",
    _controls_sql(
        [
            _control("clave de pedidos", "0", "'Claves repetidas'"),
            _control(
                "clave de clientes",
                "(SELECT count(*) FROM (SELECT o_custkey FROM orders GROUP BY 1 HAVING count(*) > 1))",
                "'Claves repetidas'",
            ),
            _control(
                "relación sin duplicados",
                """(SELECT count(*) FROM (SELECT l_orderkey, l_returnflag FROM lineitem GROUP BY 1, 2
                  HAVING count(*) > 1))""",
                "'Relaciones repetidas'",
            ),
            _control(
                "líneas sin pedido",
                """(SELECT count(DISTINCT l_orderkey) FROM lineitem WHERE l_orderkey NOT IN (
                  SELECT o_orderkey FROM orders WHERE o_orderstatus <> 'P'))""",
                "'Claves inexistentes'",
            ),
            _control(
                "pedidos y líneas",
                """(SELECT count(*) FROM (SELECT DISTINCT o_orderkey AS k FROM orders WHERE o_orderstatus <> 'P') a
                  FULL JOIN (SELECT DISTINCT l_orderkey AS k FROM lineitem) b USING (k)
                  WHERE a.k IS NULL OR b.k IS NULL)""",
                "'Claves en un solo lado'",
            ),
        ]
    ),
)
def control_keys(spark, folder):
    """Keys of three tables in one aggregate, and references between two of them in another."""
    orders = read(spark, folder, "orders").withColumnRenamed("o_orderkey", "l_orderkey")
    known, lines = orders.filter("o_orderstatus <> 'P'"), read(spark, folder, "lineitem")
    out = Controls(spark)
    out.key("clave de pedidos", orders, ["l_orderkey"])
    out.key("clave de clientes", orders, ["o_custkey"])
    out.key("relación sin duplicados", lines, ["l_orderkey", "l_returnflag"], "Relaciones repetidas")
    out.reference("líneas sin pedido", lines, known, "l_orderkey", "Claves inexistentes")
    out.same_keys("pedidos y líneas", known, lines, "l_orderkey", "Claves en un solo lado")
    return out.rows()


# ==========================================================================
# The whole result set of a dashboard
# ==========================================================================
_BRAND_CLASS = {
    "Brand#11": fv.INST_PUBLIC_UNIVERSITY,
    "Brand#12": fv.INST_PRIVATE_UNIVERSITY,
    "Brand#13": fv.INST_FOREIGN_UNIVERSITY,
    "Brand#21": fv.INST_STATE,
    "Brand#22": fv.INST_JOURNAL,
}
_CENTRE = "Centro de investigación / cooperación"


def theses(spark: SparkSession, folder: str) -> DataFrame:
    """Urgent orders are theses, high ones postgraduate theses; the status is the grade."""
    priority, status = F.col("o_orderpriority"), F.col("o_orderstatus")
    thesis = priority.isin("1-URGENT", "2-HIGH")
    return read(spark, folder, "orders").select(
        F.col("o_orderkey").alias(c.PUB),
        F.year("o_orderdate").cast("string").alias(c.YEAR),
        F.when(thesis, fv.THESIS).otherwise(fv.ARTICLE).alias(c.PUBLIC_TYPE),
        F.when(priority == "2-HIGH", fv.POSTGRAD_THESIS).otherwise(priority).alias(c.PUBLIC_SUBTYPE),
        status.alias(c.GRADE),
        F.concat(F.lit(" "), F.year("o_orderdate").cast("string")).alias(c.LEVEL),
        F.when(priority == "2-HIGH", F.when(status == "F", fv.MASTER_THESIS).otherwise(fv.NOT_IDENTIFIED)).alias(
            c.POSTGRAD_DETAIL
        ),
    )


THESES = f"""theses AS (
  SELECT o_orderkey AS pub, CAST(year(o_orderdate) AS INTEGER) AS yr, o_orderstatus AS grade,
    CASE WHEN o_orderpriority IN ('1-URGENT', '2-HIGH') THEN 'Tesis' ELSE 'Artículo' END AS kind,
    CASE WHEN o_orderpriority = '2-HIGH' THEN 'Tesis de posgrado' ELSE o_orderpriority END AS sub,
    CASE WHEN o_orderpriority = '2-HIGH' THEN
      CASE WHEN o_orderstatus = 'F' THEN {s(fv.MASTER_THESIS)} ELSE {s(fv.NOT_IDENTIFIED)} END END AS det
  FROM orders)"""


def dashboard_bridges(spark: SparkSession, folder: str) -> dict[str, DataFrame]:
    brands = brand_bridge(spark, folder)
    kind = F.lit("Otra")
    for brand, value in _BRAND_CLASS.items():
        kind = F.when(F.col(c.CATEGORY) == brand, value).otherwise(kind)
    centre = F.when(F.col(c.CATEGORY) == "Brand#31", _CENTRE).otherwise("Otra")
    institutions = brands.withColumns({c.INST_CLASS: kind, c.INST_PUBLIC_CLASS: centre})
    types = type_bridge(spark, folder)
    repositories = types.withColumn(c.REPO_PUBLIC_CLASS, F.substring(c.CATEGORY, 1, 1))
    return {
        "area": types,
        "base": brands,
        "institucion": institutions,
        "repositorio": repositories,
        "repositorio_clase": B.bridge_from_column(repositories, c.REPO_PUBLIC_CLASS),
    }


def _ranked(name: str, source: str, condition: str = "true", label: str = "NULL") -> str:
    return f"""SELECT {s(name)} AS tabla, CAST(cat AS VARCHAR) AS clave, {label} AS ruta, count(DISTINCT pub) AS valor
    FROM {source} JOIN x USING (pub) WHERE {condition} GROUP BY 2, 3"""


@query(
    "dashboard_set",
    f"""WITH {THESES}, {TYPES}, {BRANDS}, {SUPPLY}, x AS (SELECT * FROM theses WHERE kind = 'Tesis' AND grade IN ('F', 'O')),
    d AS (SELECT n_name AS cat, count(DISTINCT l_orderkey) AS n FROM nation LEFT JOIN (
      SELECT dep, l_orderkey FROM supply JOIN x ON pub = l_orderkey WHERE on_map) ON dep = n_nationkey GROUP BY 1)
    SELECT 'tipo' AS tabla, kind AS clave, NULL AS ruta, count(*) AS valor FROM x GROUP BY 2
    UNION ALL SELECT 'subtipo', sub, 'Tesis › ' || sub, count(*) FROM x GROUP BY 2
    UNION ALL SELECT 'detalle_posgrado', det, 'Tesis › Tesis de posgrado › ' || det, count(*) FROM x
      WHERE det IS NOT NULL GROUP BY 2
    UNION ALL SELECT 'serie', CAST(yr AS VARCHAR), NULL, count(*) FROM x GROUP BY 2
    UNION ALL SELECT 'departamentos', cat, NULL, n FROM d
    UNION ALL (SELECT 'departamentos_principales', cat, NULL, n FROM d ORDER BY n DESC, cat LIMIT 6)
    UNION ALL SELECT 'mapa', 'publicaciones', NULL, count(DISTINCT pub) FROM supply JOIN x ON pub = l_orderkey WHERE on_map
    UNION ALL SELECT 'indicadores', 'publicaciones', NULL, count(*) FROM x
    UNION ALL SELECT 'indicadores', 'departamentos', NULL, count(*) FROM d WHERE n > 0
    UNION ALL SELECT 'indicadores', 'areas_tematicas', NULL, count(DISTINCT cat) FROM types JOIN x USING (pub)
    UNION ALL SELECT 'indicadores', 'clases_repositorio', NULL, count(DISTINCT cat[1]) FROM types JOIN x USING (pub)
    UNION ALL {_ranked("area", "types")} UNION ALL {_ranked("base", "brands")}
    UNION ALL {_ranked("repositorio_clase", "(SELECT pub, cat[1] AS cat FROM types)")}
    UNION ALL {_ranked("repositorio", "types", "cat[1] = 'S'", "'S › ' || cat")}
    UNION ALL {_ranked("universidades_publicas", "brands", "cat = 'Brand#11'")}
    UNION ALL {_ranked("universidades_privadas", "brands", "cat = 'Brand#12'")}
    UNION ALL {_ranked("universidades_extranjeras", "brands", "cat = 'Brand#13'")}
    UNION ALL {_ranked("entidades_publicas", "brands", "cat = 'Brand#21'")}
    UNION ALL {_ranked("revistas_mal_ubicadas", "brands", "cat = 'Brand#22'")}
    UNION ALL {_ranked("centros_investigacion", "brands", "cat = 'Brand#31'")}""",
)
def dashboard_set(spark, folder):
    """All tables of one interaction, as rows of (table, key, path, number)."""
    tables = D.dashboard(
        theses(spark, folder),
        dashboard_bridges(spark, folder),
        order_territory(spark, folder),
        departments(spark, folder),
        X.Selection(scalars={c.PUBLIC_TYPE: [fv.THESIS], c.GRADE: ["F", "O"]}),
        chart_type=fv.THESIS,
        repository_class="S",
        top=6,
    )
    tables["mapa"] = tables["mapa"].select(F.lit("publicaciones").alias("clave"), F.col("publicaciones").alias(c.COUNT))
    keys = {
        "tipo": c.PUBLIC_TYPE,
        "subtipo": c.PUBLIC_SUBTYPE,
        "detalle_posgrado": c.POSTGRAD_DETAIL,
        "serie": c.YEAR,
        "departamentos": c.DEP_NAME,
        "departamentos_principales": c.DEP_NAME,
        "mapa": "clave",
        "indicadores": "indicador",
    }
    rows = []
    for name, df in tables.items():
        if name != "filtradas":
            path = F.col(D.PATH) if D.PATH in df.columns else F.lit(None)
            value = F.col("valor") if name == "indicadores" else F.col(c.COUNT)
            key = F.col(keys.get(name, c.CATEGORY)).cast("string").alias("clave")
            rows.append(df.select(F.lit(name).alias("tabla"), key, path.cast("string").alias("ruta"), value.alias("valor")))
    return P.union_all(rows)


@query(
    "thesis_facets",
    f"""WITH {THESES}, {BRANDS} SELECT pub AS {q(c.PUB)}, 'Otro / no clasificado' AS clase FROM theses
    WHERE kind = 'Tesis' AND grade IN ('F', 'O') AND yr IN (1996, 1997) AND det = {s(fv.NOT_IDENTIFIED)}
    AND pub IN (SELECT pub FROM brands WHERE cat IN ('Brand#11', 'Brand#22'))""",
)
def thesis_facets(spark, folder):
    """Facets that only theses show, the drill-down and a bridge without class columns."""
    chosen = X.Selection(
        scalars={c.PUBLIC_TYPE: [fv.THESIS], c.GRADE: ["F", "O"], c.LEVEL: ["1996", "1997"]},
        detail=fv.NOT_IDENTIFIED,
        bridges={"repositorio": ["Brand#11", "Brand#22"]},
    )
    plain = C.with_default_repository_classes(brand_bridge(spark, folder))
    found = X.faceted(theses(spark, folder), {"repositorio": plain}, chosen).select(c.PUB)
    return found.join(plain.select(c.PUB, F.col(c.REPO_CLASS).alias("clase")).distinct(), c.PUB)


@query(
    "request_classes",
    _controls_sql(
        [
            _control(
                "clase de solicitud",
                "(SELECT count(*) FROM labels l JOIN documents USING (doc_id) WHERE quality = 0 AND toxic = 0)",
                "'Filas que incumplen'",
            ),
            _control(
                "Otros no se reclasifica",
                "(SELECT count(*) FROM labels l JOIN documents USING (doc_id) WHERE quality = 1)",
                "'Filas que incumplen'",
            ),
        ]
    ),
)
def request_classes(spark, folder):
    """Requests whose class is not allowed (null ones too), and requests for the exact value Otros."""
    asked = source_requests(spark, folder)
    public = F.col(c.REQUEST_CLASS)
    asked = asked.withColumns(
        {
            c.REQUEST_OLD: F.when(public == fv.PUB_JOURNALS, " OTROS").otherwise(F.col(c.REQUEST_OLD)),
            c.REQUEST_CLASS: F.when(public != fv.PUB_INSTITUTIONAL, public),
        }
    )
    out = Controls(spark)
    allowed = F.coalesce(F.col(c.REQUEST_CLASS).isin(list(fv.REQUESTED_REPOSITORY)), F.lit(False))
    out.none("clase de solicitud", asked, ~allowed)
    out.none("Otros no se reclasifica", asked, t.is_others(F.col(c.REQUEST_OLD)))
    return out.rows()
