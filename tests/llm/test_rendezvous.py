"""Rendezvous shards against a plain reckoning of every draw."""

import hashlib
import math
import zlib

import pytest
from pyspark.sql import functions as F

from folium.llm import rendezvous
from helpers import ODD, documents


def winner(key, weights):
    def offer(i):
        digest = hashlib.md5(f"{'' if key is None else key}|{i}".encode()).hexdigest()
        return weights[i] / -math.log((int(digest[:13], 16) + 0.5) / 2**52)

    return max(range(len(weights)), key=lambda i: (offer(i), -i))


def test_digests_equal_plain_reckoning(spark):
    docs = documents(spark, [*ODD, (None, "no id"), (None, None), (3, "again"), (3, "again"), *[(i, f"t{i}") for i in range(100, 700)]])
    rows = rendezvous.digests(docs).collect()
    want = []
    for d in docs.collect():
        data = (d["text"] or "").encode()
        want.append((d["doc_id"], len(data) + 16, zlib.crc32(data), "key", winner(d["doc_id"], [1.0] * 40), winner(d["doc_id"], [1.0] * 41)))
    order = lambda r: tuple((x is None, x or 0) for x in r[:3])
    got = [(r["doc_id"], r["size"], r["text_crc32"], r["law"], r["shard"], r["grown_shard"]) for r in rows]
    assert sorted(got, key=order) == sorted(want, key=order)
    for shard in range(40):
        own = sorted((r["slot"], r["doc_id"] is not None, r["doc_id"] or 0, r["text_crc32"]) for r in rows if r["shard"] == shard)
        assert [o[0] for o in own] == list(range(len(own)))
        assert [o[1:] for o in own] == sorted(o[1:] for o in own)
    assert all(r["grown_shard"] in (r["shard"], 40) for r in rows)


def test_weights_share_the_keys(spark):
    weights = [1.0, 2.0, 5.0]
    docs = spark.range(8000).select(F.col("id").alias("doc_id"), F.lit("theirs").alias("SHARD"))
    out = rendezvous.assigned(docs, weights)
    assert out.columns == ["doc_id", "shard"]
    rows = {r["doc_id"]: r["shard"] for r in out.collect()}
    assert all(rows[k] == winner(k, weights) for k in range(0, 8000, 37))
    share = [sum(s == i for s in rows.values()) / 8000 for i in range(3)]
    assert all(abs(a - w / 8) < 0.02 for a, w in zip(share, weights))
    # A shard that goes away gives up only its own keys.
    fewer = {r["doc_id"]: r["shard"] for r in rendezvous.assigned(docs, weights[:2]).collect()}
    assert all(fewer[k] == s for k, s in rows.items() if s < 2)
    with pytest.raises(ValueError):
        rendezvous.assigned(docs, [1.0, 0.0])


def test_copies_of_one_record_spread_over_tasks(spark, tmp_path):
    docs = spark.range(0, 6000, 1, 8).select(F.when(F.col("id") % 3 > 0, F.lit(5)).otherwise(F.col("id")).alias("doc_id"), F.lit("same").alias("text"))
    spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "false")
    try:
        rendezvous.write_shards(docs, f"{tmp_path}/s", [1.0] * 4)
    finally:
        spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "true")
    rows = rendezvous.read_shards(spark, f"{tmp_path}/s", "doc_id long, text string")
    hot = spark.read.parquet(f"{tmp_path}/s").where("doc_id = 5").groupBy("_metadata.file_path").count().collect()
    assert sum(r["count"] for r in hot) == 4000 and max(r["count"] for r in hot) < 1500
    assert {r["n"] - r["m"] for r in rows.groupBy("shard").agg(F.count("*").alias("n"), F.max("slot").alias("m")).collect()} == {1}
    assert rows.groupBy("shard", "slot").count().where("count > 1").count() == 0


def test_files_of_limited_length_keep_slots(spark, tmp_path):
    spark.conf.set("spark.sql.files.maxRecordsPerFile", "7")
    try:
        rendezvous.write_shards(documents(spark, [f"t{i}" for i in range(200)]), f"{tmp_path}/s", [1.0] * 3)
    finally:
        spark.conf.unset("spark.sql.files.maxRecordsPerFile")
    rows = rendezvous.read_shards(spark, f"{tmp_path}/s", "doc_id long, text string").collect()
    assert len(rows) == 200
    for shard in range(3):
        own = sorted((r["slot"], r["doc_id"]) for r in rows if r["shard"] == shard)
        assert [s for s, _ in own] == list(range(len(own))) and [d for _, d in own] == sorted(d for _, d in own)


def test_all_columns_are_written(spark, tmp_path):
    docs = documents(spark, ["a", "b"]).withColumn("Slot", F.lit("theirs")).withColumn("_place", F.lit("kept"))
    rendezvous.write_shards(docs, f"{tmp_path}/s")
    back = spark.read.parquet(f"{tmp_path}/s")
    assert sorted(back.columns) == sorted([*documents(spark, []).columns, "_place", "shard"])
    assert {r["_place"] for r in back.collect()} == {"kept"}


def test_empty_table(spark):
    assert rendezvous.digests(documents(spark, [])).collect() == []
