"""Sharding by rendezvous hashing of a stable record key over weighted shards.

Every shard draws a number for every key, from a hash of key and shard alone, and the key
goes to the shard with the best one.  With h the hash as a number between 0 and 1 and w the
shard's weight, the draw is w / -ln(h), so a shard wins a share of w over the sum of weights.
A further shard changes no other shard's draw: records only move into it, and about as many
as its share.  A shard that goes away gives up only its own records.

The shard of a row is an expression over its key; no row needs another one.  To write the
shards, rows are dealt by range of (shard, key, checksum of the text), so each file holds a
run of one shard's records in that order, and a shard's files are read by part number.  A
record's slot is its file's offset in the shard plus its place in the file, both known from
the files themselves: offsets come from one count a file, and no window runs over a shard.
The row's place in its partition is the last of the range keys, so that even copies of one
record, all of which belong in one shard, spread over many tasks.

Defined cases: a null key is a key of its own (the empty one), so rows without a key share a
shard; rows that repeat a key share its shard, and each has its own slot; a null text has no
bytes; texts are written whole.  Columns of the input called like a column that is added,
in any case, are left out.  An empty table has no shards' files and gives no rows.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from folium.llm.common import fresh, work_folder
from folium.session import stored

SHARDS = 40
#: Hex digits of the hash that make the drawn number; 52 bits, so a double holds it.
DIGITS = 13
#: Files whose offsets are sent to every task; a longer list is joined by shuffle.
SENT = 1_000_000


def draw(key: Column, shard: Column, weight: Column) -> Column:
    """What a shard offers for a key; the largest offer wins."""
    digest = F.md5(F.concat(F.coalesce(key.cast("string"), F.lit("")), F.lit("|"), shard.cast("string")))
    part = (F.conv(F.substring(digest, 1, DIGITS), 16, 10).cast("double") + 0.5) / float(16**DIGITS)
    return weight / -F.log(part)


def shard_of(key: Column, weights: Sequence[float]) -> Column:
    """Number of the shard that wins the key; equal offers go to the smaller number."""
    if not weights or any(w <= 0 for w in weights):
        raise ValueError("every shard needs a weight above 0")
    shards = F.array(*[F.struct(F.lit(i).alias("shard"), F.lit(float(w)).alias("weight")) for i, w in enumerate(weights)])
    offers = F.transform(
        shards, lambda s: F.struct(draw(key, s["shard"], s["weight"]).alias("offer"), (-s["shard"]).alias("last"))
    )
    return -F.array_max(offers)["last"]


def assigned(docs: DataFrame, weights: Sequence[float] = (1.0,) * SHARDS, key: str = "doc_id") -> DataFrame:
    """The rows with their ``shard``."""
    own = [c for c in docs.columns if c.lower() != "shard"]
    return docs.select(*own, shard_of(F.col(key), weights).cast("int").alias("shard"))


def checksum(text: str) -> Column:
    return F.crc32(F.coalesce(F.col(text), F.lit("")).cast("binary"))


def write_shards(
    docs: DataFrame,
    folder: str,
    weights: Sequence[float] = (1.0,) * SHARDS,
    key: str = "doc_id",
    text: str = "text",
) -> None:
    """Write the records as ``folder/shard=<n>/part-<m>``, each shard's in order of key and checksum."""
    own = docs.drop(*[c for c in docs.columns if c.lower() == "slot"])
    rows = assigned(own, weights, key)
    place = fresh(rows, "_place")
    rows = rows.withColumn(place, F.monotonically_increasing_id())
    order = ["shard", key, checksum(text), place]
    dealt = rows.repartitionByRange(*order).sortWithinPartitions(*order)
    dealt.drop(place).write.partitionBy("shard").parquet(folder)


def read_shards(spark: SparkSession, folder: str, schema: str) -> DataFrame:
    """The records of written shards with ``shard`` and ``slot``, gapless from 0 in each shard.

    ``schema`` names the columns to read.
    """
    at = F.struct(
        F.regexp_extract("_metadata.file_name", r"part-(\d+)", 1).cast("long").alias("part"),
        # A task goes on in a further file where the session limits the records of one.
        F.regexp_extract("_metadata.file_name", r"c(\d+)\.", 1).cast("int").alias("more"),
    )
    rows = spark.read.schema(f"{schema}, shard int").parquet(folder)
    files = stored(rows.groupBy("shard", at.alias("file")).agg(F.count(F.lit(1)).alias("records")))
    before = Window.partitionBy("shard").orderBy("file").rowsBetween(Window.unboundedPreceding, -1)
    offsets = files.select("shard", "file", F.coalesce(F.sum("records").over(before), F.lit(0)).alias("offset"))
    if files.count() <= SENT:
        offsets = F.broadcast(offsets)
    placed = rows.select("*", at.alias("file"), F.col("_metadata.row_index").alias("place"))
    return placed.join(offsets, ["shard", "file"]).select(
        *rows.columns, (F.col("offset") + F.col("place")).alias("slot")
    )


def digests(docs: DataFrame, weights: Sequence[float] = (1.0,) * SHARDS) -> DataFrame:
    """Size, checksum and place of every document, from written shards, and its shard were there one more."""
    spark = docs.sparkSession
    folder = f"{work_folder(spark)}/shards"
    write_shards(docs.select("doc_id", "text"), folder, weights)
    back = read_shards(spark, folder, "doc_id long, text string")
    return back.select(
        "doc_id",
        (F.coalesce(F.octet_length("text"), F.lit(0)) + 16).cast("long").alias("size"),
        checksum("text").alias("text_crc32"),
        F.lit("key").alias("law"),
        "shard",
        "slot",
        shard_of(F.col("doc_id"), [*weights, 1.0]).cast("int").alias("grown_shard"),
    )
