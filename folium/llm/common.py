"""Small helpers shared by the operators of this subpackage."""

from __future__ import annotations

import gc
import os
import uuid
from collections.abc import Callable, Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from folium.session import shared_folder

#: White space that parts words: space and the controls from tab to carriage return.
SPACES = "[\\x20\\x09-\\x0D]+"
ROOT = os.path.dirname(os.path.dirname(os.path.dirname(os.path.abspath(__file__))))


def let_workers_import(spark: SparkSession) -> None:
    """Python workers find this package where the driver has it, if they don't by themselves."""
    known = spark.sparkContext.environment
    folders = [f for f in known.get("PYTHONPATH", "").split(os.pathsep) if f]
    if ROOT not in folders:
        known["PYTHONPATH"] = os.pathsep.join([*folders, ROOT])


def read(spark: SparkSession, sf_dir: str, table: str) -> DataFrame:
    let_workers_import(spark)
    return spark.read.parquet(f"{sf_dir}/{table}.parquet")


def let(value: Column, body: Callable[[Column], Column]) -> Column:
    """``body(value)`` with the value computed once a row, however often the body names it."""
    return F.transform(F.array(value), body).getItem(0)


def sliced(batches: Iterator[pa.RecordBatch], rows: int = 1000) -> Iterator[pa.RecordBatch]:
    """All rows, in batches of so many, so that a worker's texts take little memory at a time."""
    for batch in batches:
        for at in range(0, batch.num_rows, rows):
            yield batch.slice(at, rows)


def words(text: Column) -> Column:
    """The words of a text, in order; none for null.

    Splitting at one character is several times faster than at a pattern, so line ends
    become spaces first, and only texts with rarer white space meet the pattern.
    """
    whole = F.coalesce(text, F.lit(""))
    rare = F.lit(False)
    for c in "\t\x0b\x0c\r":
        rare = rare | F.contains(whole, F.lit(c))
    plain = F.when(rare, F.regexp_replace(whole, SPACES, " ")).otherwise(F.replace(whole, F.lit("\n"), F.lit(" ")))
    return F.array_remove(F.split(plain, " "), "")


def fresh(df: DataFrame, name: str) -> str:
    """A column name that the frame doesn't have yet."""
    taken = {x.lower() for x in df.columns}
    while name.lower() in taken:
        name += "_"
    return name


def bucket(key: Column, buckets: int) -> Column:
    """crc32 of the key as text, modulo; null stays null."""
    return F.crc32(key.cast("string").cast("binary")) % buckets


def _at(spark: SparkSession, path: str):
    where = spark._jvm.org.apache.hadoop.fs.Path(path)
    return where, where.getFileSystem(spark._jsc.hadoopConfiguration())


def work_folder(spark: SparkSession) -> str:
    """A new folder in the shared one for tables that an operator writes; it goes when the driver ends."""
    path = f"{shared_folder(spark)}/work-{uuid.uuid4().hex}"
    where, system = _at(spark, path)
    system.mkdirs(where)
    system.deleteOnExit(where)
    return path


def written(df: DataFrame, path: str) -> DataFrame:
    """The frame read again from the table it is written to."""
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def deleted(spark: SparkSession, path: str) -> None:
    """Remove a written table that nothing reads any more."""
    where, system = _at(spark, path)
    system.delete(where, True)


def release_shuffles(spark: SparkSession) -> None:
    """Let Spark remove the shuffle files of jobs that have ended.

    It does so when the driver's garbage is collected, which may otherwise be long after.
    """
    gc.collect()
    spark._jvm.System.gc()
