"""Readers and writers of catalogue tables.

Values are text unless the contract says otherwise; schemas are never inferred.
"""

from __future__ import annotations

from collections.abc import Mapping
from datetime import datetime

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from folium import columns as c
from folium.functions import text as t
from folium.operators.checks import strip_headers
from folium.session import stored
from folium.sources import snapshots

# Columns that are not text.
TYPED = {
    c.ON_MAP: T.BooleanType(),
    c.CATEGORY_ORDER: T.IntegerType(),
    c.ORD: T.LongType(),
    c.COUNT: T.LongType(),
    **{name: T.LongType() for name in c.TERRITORY_COUNTS},
}

GEOJSON_SCHEMA = "features array<struct<properties: string, geometry: string>>"


def text_schema(names: list[str]) -> T.StructType:
    return T.StructType([T.StructField(n, TYPED.get(n, T.StringType())) for n in names])


def as_text(df: DataFrame) -> DataFrame:
    """Contract types: text everywhere but the typed columns."""
    return df.select(
        *[F.col(f"`{x}`").cast(TYPED.get(x.strip(), T.StringType())).alias(x) for x in df.columns]
    )


def read_csv(spark: SparkSession, path: str, multi_line: bool = False) -> DataFrame:
    """CSV with a header; every column is text and a byte-order mark is ignored.

    ``multi_line`` is for cells that hold line ends; a file is then read by one task.
    """
    return strip_headers(
        spark.read.option("header", True).option("multiLine", multi_line).option("escape", '"').csv(path)
    )


def read_table(spark: SparkSession, path: str, columns: list[str] | None = None) -> DataFrame:
    """One table; the suffix decides the format (Parquet unless it says CSV or JSON).

    JSON lines need the names of their columns; their types are the contract's.
    """
    lower = path.lower().rstrip("/")
    if lower.endswith(".csv"):
        return read_csv(spark, path)
    if lower.endswith((".json", ".jsonl")):
        if columns is None:
            raise ValueError("name the columns of a JSON table")
        return spark.read.schema(text_schema(columns)).json(path)
    return strip_headers(as_text(spark.read.parquet(path)))


def with_row_ordinal(df: DataFrame, order: str = c.ORD) -> DataFrame:
    """A table just read from files, with the number of each row: files by path, rows as they stand.

    The rows are stored once with their place in their file part, so the numbers don't
    depend on how a later job reads them.  Only one row a part takes part in the running
    sum; the rows themselves are joined, never sorted as a whole.
    """
    placed = stored(
        df.select(
            *[F.col(f"`{x}`") for x in df.columns if x != order],
            F.col("_metadata.file_path").alias("_file"),
            F.col("_metadata.file_block_start").alias("_block"),
            F.monotonically_increasing_id().alias("_at"),
        )
    )
    parts = placed.groupBy("_file", "_block").agg(F.min("_at").alias("_first"), F.count(F.lit(1)).alias("_rows"))
    earlier = Window.orderBy("_file", "_block").rowsBetween(Window.unboundedPreceding, -1)
    before = parts.select("_file", "_block", "_first", F.coalesce(F.sum("_rows").over(earlier), F.lit(0)).alias("_before"))
    number = (F.col("_before") + F.col("_at") - F.col("_first") + 1).alias(order)
    kept = [F.col(f"`{x}`") for x in placed.columns if x not in ("_file", "_block", "_at")]
    return placed.join(before, ["_file", "_block"]).select(*kept, number)


def read_ordered(spark: SparkSession, path: str, columns: list[str] | None = None) -> DataFrame:
    """:func:`read_table` with the row ordinal that consolidation and the public base need."""
    return with_row_ordinal(read_table(spark, path, columns))


def read_snapshot(spark: SparkSession, snapshot: str, names: list[str] | None = None) -> dict[str, DataFrame]:
    """Every table of a snapshot, or the named ones that exist."""
    present = snapshots.table_names(spark, snapshot)
    wanted = present if names is None else [n for n in names if n in present]
    return {n: read_table(spark, f"{snapshot.rstrip('/')}/{n}") for n in wanted}


def read_optional(spark: SparkSession, snapshot: str, name: str, columns: list[str]) -> DataFrame:
    """The table, or an empty frame with the declared columns when it is absent."""
    found = read_snapshot(spark, snapshot, [name])
    return found.get(name, spark.createDataFrame([], text_schema(columns)))


def read_geojson(spark: SparkSession, path: str) -> DataFrame:
    """Map features with their department name and normalised key."""
    return read_departments(spark, path).select("DEPARTAMEN", c.DEP_KEY)


def read_departments(spark: SparkSession, path: str) -> DataFrame:
    """Map features as rows: place in the file, name, key, and properties and geometry as they are written.

    Nested values are read as text, so their numbers and their nesting stay as they stand.
    """
    features = (
        spark.read.schema(GEOJSON_SCHEMA)
        .option("multiLine", True)
        .json(path)
        .select(F.posexplode("features").alias("_place", "feature"))
    )
    name = F.get_json_object("feature.properties", "$.DEPARTAMEN")
    return features.select(
        (F.col("_place") + 1).cast("long").alias(c.ORD),
        name.alias("DEPARTAMEN"),
        t.fold_upper(name).alias(c.DEP_KEY),
        F.col("feature.properties").alias(c.PROPERTIES),
        F.col("feature.geometry").alias(c.GEOMETRY),
    )


def feature_text() -> Column:
    """One feature as a line of GeoJSON text, from the columns of :func:`read_departments`."""
    part = lambda name: F.coalesce(F.col(name), F.lit("null"))
    return F.concat(
        F.lit('{"type":"Feature","properties":'), part(c.PROPERTIES), F.lit(',"geometry":'), part(c.GEOMETRY), F.lit("}")
    )


def write_geojson(departments: DataFrame, path: str) -> None:
    """The features as lines of GeoJSON text, in order of their place in the file they came from.

    A map has as many features as there are departments, so one file is written.
    """
    departments.coalesce(1).sortWithinPartitions(c.ORD).select(feature_text().alias("value")).write.mode(
        "errorifexists"
    ).text(path)


def new_timestamp() -> str:
    return datetime.now().strftime("%Y%m%d_%H%M%S")


def snapshot_path(root: str, timestamp: str) -> str:
    return f"{root.rstrip('/')}/snapshot={timestamp}"


def write_snapshot(
    tables: Mapping[str, DataFrame],
    root: str,
    timestamp: str | None = None,
    by_publication: bool = False,
    mode: str = "errorifexists",
) -> str:
    """Write every table under ``snapshot=<timestamp>/<table>`` as Parquet, the summary last.

    A snapshot counts as complete once its summary is there.  ``by_publication`` clusters tables that hold publication ids on them, so later
    joins on the id read ranges that line up.
    """
    snapshot = snapshot_path(root, timestamp or new_timestamp())
    for name, df in sorted(tables.items(), key=lambda x: x[0] == c.T_SUMMARY):
        if by_publication and c.PUB in df.columns:
            df = df.repartitionByRange(c.PUB).sortWithinPartitions(c.PUB)
        df.write.mode(mode).parquet(f"{snapshot}/{name}")
    return snapshot


def write_csv(df: DataFrame, path: str) -> None:
    """CSV with a header; Spark writes UTF-8 without a byte-order mark."""
    df.write.mode("errorifexists").option("header", True).option("escape", '"').csv(path)


def write_bundle(tables: Mapping[str, DataFrame], path: str, csv_of: str = "Datos_filtrados") -> None:
    """The tables of a filtered download, plus the data table as CSV."""
    for name, df in tables.items():
        df.write.mode("errorifexists").parquet(f"{path.rstrip('/')}/{name}")
    if csv_of in tables:
        write_csv(tables[csv_of], f"{path.rstrip('/')}/{csv_of}.csv")


def append_trace(trace: DataFrame, path: str, run: str | None = None) -> None:
    """Append one run's trace rows.

    With a run id the rows lie in ``run=<id>`` and are written once: a repeated run, finding
    them committed, leaves them as they are, and one that broke off while writing is replaced.
    """
    spark = trace.sparkSession
    rows = trace.withColumn("momento", F.date_format(F.current_timestamp(), "yyyy-MM-dd'T'HH:mm:ss"))
    if run is None:
        rows.write.mode("append").parquet(path)
    elif not committed(spark, own := f"{path.rstrip('/')}/run={run}"):
        rows.write.mode("overwrite").parquet(own)


def committed(spark: SparkSession, path: str) -> bool:
    """Whether a table's write has ended: its commit marker is there."""
    marker = spark._jvm.org.apache.hadoop.fs.Path(f"{path.rstrip('/')}/_SUCCESS")
    return marker.getFileSystem(spark._jsc.hadoopConfiguration()).exists(marker)
