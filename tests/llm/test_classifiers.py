"""Toxicity and language: accuracy on the folds that they don't learn from, and odd rows."""

from pyspark.sql import functions as F

from folium.llm import language_id, toxicity
from folium.llm.common import read
from helpers import ODD, documents

FOLDER, LARGER = "/root/testdata/sf0.01", "/root/testdata/sf0.1"


def test_toxicity_on_the_held_out_fold(spark):
    docs, labels = read(spark, LARGER, "documents"), read(spark, LARGER, "labels")
    rows = toxicity.judged(docs, labels).join(labels, "doc_id").where("held_out")
    got = {(r["toxic"], r["predicted"]): r["count"] for r in rows.groupBy("toxic", "predicted").count().collect()}
    assert got[1, 1] >= 0.75 * (got[1, 1] + got.get((1, 0), 0))
    assert got.get((0, 1), 0) <= 0.03 * got[0, 0]


def test_held_out_labels_change_nothing(spark):
    docs, labels = read(spark, FOLDER, "documents"), read(spark, FOLDER, "labels")
    held = F.crc32(F.col("doc_id").cast("string").cast("binary")) % 4 == 2
    flipped = labels.withColumn("toxic", F.when(held, 1 - F.col("toxic")).otherwise(F.col("toxic")))
    assert sorted(map(tuple, toxicity.judged(docs, labels).collect())) == sorted(
        map(tuple, toxicity.judged(docs, flipped).collect())
    )


def test_toxicity_of_odd_rows(spark):
    docs = documents(spark, [*ODD, (None, "you stupid idiot"), (None, "fine words")])
    none = spark.createDataFrame([], "doc_id long, quality int, toxic int")
    one = spark.createDataFrame([(3, 1, 1), (3, 1, None), (None, 0, 1)], "doc_id long, quality int, toxic int")
    for labels in (none, one):
        rows = toxicity.judged(docs, labels).collect()
        assert len(rows) == docs.count() and all(r["score"] == 0.0 and r["predicted"] == 0 for r in rows)
        kept = toxicity.keep(docs, labels)
        assert kept.columns == docs.columns and kept.count() == docs.count()


def test_obfuscated_words_are_found():
    found = dict(zip(toxicity.FEATURES, toxicity.Features(frozenset()).of("You 1d!ot, st00pid m*ron stuuuupid!!")))
    assert found["insults"] > 0 and found["hidden"] > 0 and found["near_second_person"] > 0
    plain = dict(zip(toxicity.FEATURES, toxicity.Features(frozenset()).of("A plain text without any of it.")))
    assert plain["insults"] == plain["hidden"] == 0


def test_language_on_the_held_out_fold(spark):
    docs = read(spark, FOLDER, "documents")
    rows = language_id.predicted(docs).join(docs.select("doc_id", "lang"), "doc_id").where("held_out")
    right = rows.where("lang = lang_pred").count()
    assert right >= 0.97 * rows.count()


def test_language_of_odd_rows(spark):
    learn = [(i, w * 20) for i, w in enumerate(["the house and garden ", "das Haus und Garten ", "la maison et le jardin "] * 8)]
    docs = documents(spark, [*learn, (100, None), (101, ""), (102, "123 !?"), (None, "the house"), (103, "x" * 100000)])
    lang = F.when(F.col("text").startswith("the"), "en").when(F.col("text").startswith("das"), "de").when(F.col("text").startswith("la"), "fr")
    rows = language_id.predicted(docs.withColumn("lang", lang)).collect()
    got = {r["doc_id"]: (r["lang_pred"], r["score"]) for r in rows}
    assert got[100] == got[101] == got[102] == ("und", 0.0)
    assert got[None][0] == "en" and got[103][0] in ("en", "de", "fr")
    assert all(0 <= s <= 1 for _, s in got.values())
    only = language_id.predicted(docs.withColumn("lang", F.lit("de"))).where("doc_id = 103").first()
    assert only["lang_pred"] == "de"
    none = language_id.predicted(docs.withColumn("lang", F.lit(None).cast("string"))).collect()
    assert {r["lang_pred"] for r in none} == {"und"}


def test_a_rare_language_is_learned(spark, monkeypatch):
    monkeypatch.setattr(language_id, "LEARN", 60)
    monkeypatch.setattr(language_id, "LEAST", 20)
    docs = documents(spark, [f"the house and the tree number {i} are here" for i in range(400)] + ["talo ja puu ovat tässä nyt"] * 6)
    docs = docs.withColumn("lang", F.when(F.col("doc_id") < 400, F.lit("en")).otherwise(F.lit("fi")))
    rows = language_id.learning(docs).groupBy("lang").count().collect()
    found = {r["lang"]: r["count"] for r in rows}
    assert found["fi"] == docs.where("doc_id >= 400 AND crc32(cast(cast(doc_id AS string) AS binary)) % 5 <> 0").count()
    assert 10 <= found["en"] <= 60


def test_a_text_travels_once(spark):
    """Among the columns that stay or beside them, each worker gets a text one time, and few texts at once."""
    docs = documents(spark, ODD).selectExpr("doc_id AS _0", "text AS _1")
    rows = toxicity.with_features(docs, frozenset(), ["_0", "_1"], "_1")
    assert rows.columns == ["_0", "_1", "features"]
    beside = toxicity.with_features(documents(spark, ODD), frozenset(), ["doc_id"])
    assert beside.columns == ["doc_id", "features"]
    got, other = ({r[0]: r["features"] for r in x.collect()} for x in (rows, beside))
    assert got == other and len(got) == len(ODD)
    assert {r["_0"]: r["_1"] for r in rows.collect()} == dict(enumerate(ODD))
    # Ids and texts go in, and nothing else.
    sent = rows._jdf.queryExecution().analyzed().children().head().output()
    assert sent.length() == 2
