"""Snapshot discovery.

Listing goes through Spark's file source (path and modification time only, file
contents are never read), so it works on any storage the session can read.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.utils import AnalysisException

from folium import columns as c

TEMPORARY_PREFIX = "~$"


def list_files(spark: SparkSession, root: str, pattern: str = "*", recursive: bool = False) -> DataFrame:
    """``(path, name, modified)`` of the files under ``root``, temporary files left out."""
    name = F.element_at(F.split("path", "/"), -1)
    return (
        spark.read.format("binaryFile")
        .option("pathGlobFilter", pattern)
        .option("recursiveFileLookup", str(recursive).lower())
        .load(root)
        .select("path", name.alias("name"), F.col("modificationTime").alias("modified"))
        .filter(~F.col("name").startswith(TEMPORARY_PREFIX))
    )


def _newest(df: DataFrame, value: str, order: Column) -> str | None:
    row = df.agg(F.max_by(value, order).alias("v")).first()
    return None if row is None else row["v"]


def latest_file(
    spark: SparkSession,
    root: str,
    pattern: str,
    without: str | None = None,
    required: bool = True,
) -> str | None:
    """Newest file that matches; ``without`` drops names that contain a text (any case)."""
    try:
        files = list_files(spark, root, pattern)
        if without:
            files = files.filter(~F.upper("name").contains(without.upper()))
        found = _newest(files, "path", F.struct("modified", "path"))
    except AnalysisException:
        found = None
    if found is None and required:
        raise FileNotFoundError(f"no file {pattern} under {root}")
    return found


def latest_directory(spark: SparkSession, root: str, prefix: str) -> str:
    """Child directory with the given prefix that holds the newest file."""
    child = F.regexp_extract("path", f"^(.*/{prefix}[^/]*)/", 1)
    try:
        files = list_files(spark, root, recursive=True).withColumn("dir", child)
        found = _newest(files.filter(F.col("dir") != ""), "dir", F.struct("modified", "dir"))
    except AnalysisException:
        found = None
    if found is None:
        raise FileNotFoundError(f"no directory {prefix}* under {root}")
    return found


def latest_snapshot(spark: SparkSession, root: str) -> str:
    """The newest complete snapshot: one whose summary, written last, has been committed.

    Only the small files of one summary a snapshot are listed.
    """
    path = F.regexp_extract("path", rf"^(.*/snapshot=[^/]*)/{c.T_SUMMARY}/", 1)
    try:
        summaries = list_files(spark, f"{root.rstrip('/')}/snapshot=*/{c.T_SUMMARY}", "*.parquet")
        found = _newest(summaries.withColumn("dir", path), "dir", F.col("dir"))
    except AnalysisException:
        found = None
    if not found:
        raise FileNotFoundError(f"no complete snapshot under {root}")
    return found


def table_names(spark: SparkSession, snapshot: str) -> list[str]:
    """Tables of a snapshot: its child directories that hold data files."""
    base = snapshot.rstrip("/").split("/")[-1]
    child = F.regexp_extract("path", f"/{base}/([^/]+)/", 1)
    files = list_files(spark, snapshot, recursive=True).select(child.alias("t")).distinct()
    return sorted(r["t"] for r in files.collect() if r["t"])
