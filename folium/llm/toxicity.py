"""Toxicity by gradient-boosted trees over dense features, calibrated by isotonic regression.

Features are rates over a whole text: densities of fixed and of learned lexicons, how
near their words stand to second-person words, words in capitals, punctuation, and words
spelled to hide (digits or signs among letters, stretched letters), with the lexicon
words found under such spelling.  Text is the only input.

The classifier is fitted on at most about ``LEARN`` labelled documents, taken by a hash
of their ids: two folds teach the lexicon and the trees, the third the calibration.  The
fourth fold is never read with its labels.  Everything else covers all documents: one
pass without a shuffle.

Defined cases: a null or empty text has all rates zero and gets the score of such texts;
documents without labels of both kinds to learn from all score 0; repeated rows each
keep their row; of several labels of one id the highest counts.
"""

from __future__ import annotations

import math
import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.ml.classification import GBTClassifier
from pyspark.ml.functions import array_to_vector, vector_to_array
from pyspark.ml.regression import IsotonicRegression
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from folium.llm.common import bucket, sliced
from folium.session import stored

#: Labelled documents that the classifier learns from, at most about.
LEARN = 20_000
#: Of four folds by crc32 of the id: the one held out, and the one that calibrates.
FOLDS, HELD_OUT, CALIBRATES = 4, 2, 3
#: Words of the learned lexicon, at most, and what one must show: documents and share toxic.
LEARNED, LEAST_DOCS, LEAST_SHARE, TOXIC_SHARE = 200, 5, 0.02, 0.6
THRESHOLD = 0.3
NEAR = 4

# Common words of abuse by kind, and second-person words, in four languages.
INSULTS = frozenset(
    "idiot idiots moron morons stupid dumb fool fools loser losers clown clowns trash garbage scum pathetic "
    "worthless disgusting ugly coward liar freak jerk creep dumbass imbecile ignorant retard pig rat vermin filth "
    "dummkopf trottel arschloch schwein depp blödmann abschaum wertlos erbärmlich widerlich "
    "imbécile crétin connard salaud abruti débile minable ordure "
    "idiota estúpido imbécil tonto basura asqueroso cabrón patético inútil".split()
)
THREATS = frozenset(
    "kill die hurt destroy shoot stab burn hang beat punish murder töten sterben umbringen schlagen "
    "tuer mourir frapper crève matar morir golpear".split()
)
PROFANITY = frozenset(
    "damn hell crap shit bullshit fuck fucking bitch bastard ass asshole scheisse scheiße verdammt fick "
    "merde putain bordel foutre mierda joder puta coño".split()
)
SECOND_PERSON = frozenset(
    "you your yours yourself u ur du dich dir dein deine ihr euch tu te toi ton ta vous votre usted ustedes tú ti".split()
)
LEET = str.maketrans("013457@$!|", "oieastasii")

INSULT, THREAT, PROFANE, TAUGHT, SECOND, CAPITALS, HIDDEN = (1 << i for i in range(7))
LEXICON = INSULT | THREAT | PROFANE | TAUGHT
FEATURES = (
    "insults", "threats", "profanity", "taught", "distinct_hits", "log_hits", "near_second_person", "second_person",
    "capitals", "exclamations", "questions", "punctuation", "hidden", "log_words", "hits_share",
)
REMEMBERED = 400_000
OUTER = ".,;:!?\"'()[]{}<>*_-`/\\|#%&~^+=…"
MIXED = re.compile(r"[^\W\d_][^\w\s'’.,-]+[^\W\d_]|[^\W\d_]\d+[^\W\d_]|(\w)\1{3,}")
STRETCH = re.compile(r"(.)\1{2,}")


class Features:
    def __init__(self, learned: frozenset[str]):
        self.learned = learned
        #: Word as written -> (its flags, its plain form if it is in a lexicon).
        self.known: dict[str, int] = {}

    def _kind(self, word: str) -> int:
        return (
            INSULT * (word in INSULTS)
            | THREAT * (word in THREATS)
            | PROFANE * (word in PROFANITY)
            | TAUGHT * (word in self.learned)
            | SECOND * (word in SECOND_PERSON)
        )

    def _flags(self, written: str) -> int:
        core = written.strip(OUTER)
        plain = core.lower()
        flags = self._kind(plain)
        if len(core) > 2 and core.isupper():
            flags |= CAPITALS
        if MIXED.search(core):
            flags |= HIDDEN
            if not flags & LEXICON:
                shown = plain.translate(LEET)
                letters = "".join(c for c in shown if c.isalpha())
                flags |= self._kind(shown) | self._kind(letters) | self._kind(STRETCH.sub(r"\1", letters))
        if len(self.known) >= REMEMBERED:
            self.known.clear()
        self.known[written] = flags
        return flags

    def of(self, text: str | None) -> list[float]:
        text = text or ""
        words = text.split()
        flags = list(map(self.known.get, words))
        if None in flags:
            flags = [self._flags(w) if f is None else f for w, f in zip(words, flags)]
        n = max(len(words), 1)
        marks = np.array(flags, dtype=np.int64)
        hits = np.flatnonzero(marks & LEXICON)
        second = np.flatnonzero(marks & SECOND)
        near = 0
        if len(hits) and len(second):
            i = np.searchsorted(second, hits)
            after = np.abs(second[np.minimum(i, len(second) - 1)] - hits)
            before = np.abs(second[np.maximum(i - 1, 0)] - hits)
            near = int((np.minimum(after, before) <= NEAR).sum())
        per_100 = lambda flag: 100.0 * int(np.count_nonzero(marks & flag)) / n
        signs = text.count("!"), text.count("?"), sum(map(text.count, ";:*#$%&|"))
        return [
            per_100(INSULT), per_100(THREAT), per_100(PROFANE), per_100(TAUGHT),
            float(len({words[i].strip(OUTER).lower() for i in hits})), math.log1p(len(hits)),
            near / max(len(hits), 1), per_100(SECOND), per_100(CAPITALS),
            *(100.0 * s / n for s in signs), per_100(HIDDEN), math.log1p(len(words)), len(hits) / n,
        ]


def with_features(docs: DataFrame, learned: frozenset[str], columns: list[str], text: str = "text") -> DataFrame:
    """These columns of every document, and its features; the text travels once, among them or beside."""
    sent = columns if text in columns else [*columns, text]
    text_at = sent.index(text)
    schema = docs.select(*columns).schema.add("features", T.ArrayType(T.DoubleType()))

    def rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        features = Features(learned)
        for batch in sliced(batches):
            found = pa.array([features.of(t) for t in batch.column(text_at).to_pylist()], pa.list_(pa.float64()))
            yield pa.RecordBatch.from_arrays([*batch.columns[: len(columns)], found], names=[*columns, "features"])

    return docs.select(*sent).mapInArrow(rows, schema)


def labelled(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """doc_id, text, toxic, fold of the documents to learn from; the held-out fold isn't among them."""
    known = (
        labels.where("doc_id IS NOT NULL AND toxic IS NOT NULL")
        .withColumn("fold", bucket(F.col("doc_id"), FOLDS))
        .where(F.col("fold") != HELD_OUT)
        .groupBy("doc_id", "fold")
        .agg(F.max("toxic").cast("int").alias("toxic"))
    )
    known = stored(known)
    share = min(1.0, LEARN / max(known.count(), 1))
    some = known.where(F.pmod(F.xxhash64("doc_id"), F.lit(1_000_000)) < int(share * 1_000_000))
    # About LEARN rows of three numbers at most, whatever the number of labels.
    return docs.select("doc_id", "text").join(F.broadcast(some), "doc_id")


def learned_lexicon(learn: DataFrame) -> frozenset[str]:
    """Words that mostly toxic documents use, of the documents that teach."""

    def words(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for text, toxic in zip(batch["text"].to_pylist(), batch["toxic"].to_pylist()):
                kinds = {w.strip(OUTER).lower() for w in (text or "").split()} - {""}
                yield pa.RecordBatch.from_arrays(
                    [pa.array(kinds, pa.string()), pa.array([toxic] * len(kinds), pa.int32())], names=["word", "toxic"]
                )

    total = learn.agg(F.sum("toxic").alias("n")).first()["n"] or 0
    counted = learn.select("text", "toxic").mapInArrow(words, "word string, toxic int").groupBy("word").agg(
        F.sum("toxic").alias("hits"), F.count("*").alias("docs")
    )
    least = max(LEAST_DOCS, LEAST_SHARE * total)
    chosen = counted.where((F.col("hits") >= least) & (F.col("hits") >= TOXIC_SHARE * F.col("docs")))
    return frozenset(r["word"] for r in chosen.orderBy(F.desc("hits"), "word").limit(LEARNED).collect())


class Model:
    """Lexicon, trees and calibration; trees None where there was nothing to learn."""

    def __init__(self, docs: DataFrame, labels: DataFrame):
        rows = stored(labelled(docs, labels))
        teach = rows.where(F.col("fold") != CALIBRATES)
        kinds = {(r["fold"] == CALIBRATES, r["toxic"]) for r in rows.select("fold", "toxic").distinct().collect()}
        self.trees = self.calibration = None
        self.lexicon: frozenset[str] = frozenset()
        if not {(False, 0), (False, 1)} <= kinds:
            return
        self.lexicon = learned_lexicon(teach)
        table = stored(with_features(rows, self.lexicon, ["toxic", "fold"]))
        table = table.select(
            F.col("toxic").cast("double").alias("label"), "fold", array_to_vector("features").alias("features")
        )
        booster = GBTClassifier(maxIter=20, maxDepth=4, stepSize=0.2, minInstancesPerNode=5, maxBins=64, seed=11)
        self.trees = booster.fit(table.where(F.col("fold") != CALIBRATES))
        calibrates = table.where(F.col("fold") == CALIBRATES) if {(True, 0), (True, 1)} <= kinds else table
        raw = vector_to_array("probability").getItem(1).alias("raw")
        judged = self.trees.transform(calibrates).select(raw, "label")
        self.calibration = IsotonicRegression(featuresCol="raw", labelCol="label", predictionCol="score").fit(judged)

    def score(self, docs: DataFrame, columns: list[str], text: str = "text") -> DataFrame:
        """These columns of every document, and the score of its text."""
        if self.trees is None:
            return docs.select(*columns, F.lit(0.0).alias("score"))
        table = with_features(docs, self.lexicon, columns, text)
        table = table.withColumn("features", array_to_vector("features"))
        judged = self.trees.transform(table).withColumn("raw", vector_to_array("probability").getItem(1))
        bounded = F.greatest(F.lit(0.0), F.least(F.lit(1.0), F.col("score"))).alias("score")
        return self.calibration.transform(judged).select(*columns, bounded)


def judged(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """doc_id, held_out, score, predicted of every document."""
    scores = Model(docs, labels).score(docs, ["doc_id"])
    return scores.select(
        "doc_id",
        F.coalesce(bucket(F.col("doc_id"), FOLDS) == HELD_OUT, F.lit(False)).alias("held_out"),
        "score",
        (F.col("score") >= THRESHOLD).cast("int").alias("predicted"),
    )


def keep(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """The documents that aren't predicted toxic, with the columns they came with."""
    names = {name: f"_{i}" for i, name in enumerate(docs.columns)}
    text = next(y for x, y in names.items() if x.lower() == "text")
    renamed = docs.select(*(F.col(f"`{x}`").alias(y) for x, y in names.items()))
    scores = Model(docs, labels).score(renamed, list(names.values()), text)
    kept = scores.where(F.col("score") < THRESHOLD)
    return kept.select(*(F.col(y).alias(x) for x, y in names.items()))
