"""Language identification by hierarchy: family first, then one-versus-one within it.

A text's features are counts of its byte bigrams and trigrams (lower case, everything
but letters as a space), hashed into ``SIZE`` places, damped by a square root and scaled
to length one.  A linear support vector machine for each pair of families votes on the
family; machines for each pair of that family's languages then vote on the language.
Ties go to the larger sum of margins, then to the smaller name.

The machines are fitted on at most about ``LEARN`` documents, or ``LEAST`` a language if
there are many languages, an equal number of each, taken by a hash of their ids; a
language with no more documents than that is learned from all of them; everything else covers all documents in one pass without a shuffle.  Weights are
``SIZE`` numbers a pair, whatever the input.

Defined cases: a text that is null or has no letter is ``und`` with score 0; with one
learned language all others get it; with none, all are ``und``; a null id isn't held out
and isn't learned from.
"""

from __future__ import annotations

import re
from collections.abc import Iterator
from itertools import combinations

import numpy as np
import pyarrow as pa
from pyspark.ml.classification import LinearSVC
from pyspark.ml.functions import array_to_vector
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from folium.llm.common import bucket
from folium.session import stored

#: Documents that the machines learn from, at most about.
LEARN = 8_000
#: Documents of each language, at least, however many languages there are.
LEAST = 200
FOLDS, HELD_OUT = 5, 0
SIZE = 2048

# Language codes by family.
FAMILIES = {
    "germanic": "af da de en fo is lb nl nn no sv yi".split(),
    "romance": "ca es fr gl it la oc pt ro".split(),
    "slavic": "be bg bs cs hr mk pl ru sk sl sr uk".split(),
    "uralic": "et fi hu".split(),
    "turkic": "az kk tr uz".split(),
    "semitic": "am ar he mt".split(),
    "indic": "bn gu hi mr ne pa ur".split(),
    "sinitic": "yue zh".split(),
}
FAMILY_OF = {code: family for family, codes in FAMILIES.items() for code in codes}

LETTER = re.compile(r"[^\W\d_]")
#: ASCII characters that aren't letters become spaces.
PLAIN = bytes(b if chr(b).isalpha() or b > 127 else 32 for b in range(256))


def family_of(lang: str) -> str:
    """The family of a code, regional parts aside; an unlisted language is a family of its own."""
    return FAMILY_OF.get(re.split("[-_]", lang.lower())[0], lang)


def features(text: str) -> np.ndarray:
    data = b" " + b" ".join(text.lower().encode().translate(PLAIN).split()) + b" "
    codes = np.frombuffer(data, dtype=np.uint8).astype(np.uint32)
    two = codes[:-1] * np.uint32(257) + codes[1:]
    three = two[:-1] * np.uint32(263) + codes[2:] + np.uint32(1 << 28)
    places = (np.concatenate((two, three)) * np.uint32(2654435761)) >> np.uint32(21)
    counts = np.sqrt(np.bincount(places, minlength=SIZE))
    return counts / max(np.sqrt((counts**2).sum()), 1e-9)


def learning(docs: DataFrame) -> DataFrame:
    """lang, family, features of the documents to learn from; the held-out fold isn't among them."""
    known = docs.where("lang IS NOT NULL AND text IS NOT NULL").where(bucket(F.col("doc_id"), FOLDS) != HELD_OUT)
    # One row a language; the number of machines grows with the square of that anyway.
    sizes = {r["lang"]: r["count"] for r in known.groupBy("lang").count().collect()}
    each = max(LEARN / max(len(sizes), 1), LEAST)
    draws = 1 << 40
    limits = [F.lit(x) for lang, n in sorted(sizes.items()) for x in (lang, int(draws * min(1.0, each / n)))]
    limit = F.create_map(*limits)[F.col("lang")] if limits else F.lit(0)
    some = known.where(F.pmod(F.xxhash64("doc_id"), F.lit(draws)) < limit)

    def rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            kept = [(g, t) for g, t in zip(batch["lang"].to_pylist(), batch["text"].to_pylist()) if LETTER.search(t)]
            yield pa.RecordBatch.from_arrays(
                [
                    pa.array([g for g, _ in kept], pa.string()),
                    pa.array([family_of(g) for g, _ in kept], pa.string()),
                    pa.array([features(t) for _, t in kept], pa.list_(pa.float64())),
                ],
                names=["lang", "family", "features"],
            )

    return some.select("lang", "text").mapInArrow(rows, "lang string, family string, features array<double>")


def _machines(rows: DataFrame, column: str, names: list[str]) -> list[tuple[str, str, np.ndarray, float]]:
    """(a, b, weights, intercept) of each pair: positive margins vote for a."""
    found = []
    for a, b in combinations(sorted(names), 2):
        pair = rows.where(F.col(column).isin(a, b)).select(
            (F.col(column) == a).cast("double").alias("label"), array_to_vector("features").alias("features")
        )
        fit = LinearSVC(maxIter=40, regParam=1e-4, standardization=False).fit(pair)
        found.append((a, b, fit.coefficients.toArray(), float(fit.intercept)))
    return found


class Hierarchy:
    """The fitted machines, without anything of Spark, to be sent to tasks."""

    def __init__(self, docs: DataFrame):
        rows = stored(learning(docs))
        seen = rows.select("family", "lang").distinct().collect()
        self.langs: dict[str, list[str]] = {}
        for family, lang in sorted((r["family"], r["lang"]) for r in seen):
            self.langs.setdefault(family, []).append(lang)
        self.families = _machines(rows, "family", list(self.langs))
        self.within = {f: _machines(rows, "lang", langs) for f, langs in self.langs.items()}

    @staticmethod
    def _vote(machines, names: list[str], x: np.ndarray) -> tuple[str, float]:
        """The winner, and the least margin by which it beats another."""
        if len(names) == 1:
            return names[0], np.inf
        wins = dict.fromkeys(sorted(names), 0)
        total, least = dict.fromkeys(names, 0.0), dict.fromkeys(names, np.inf)
        for a, b, weights, intercept in machines:
            margin = float(weights @ x) + intercept
            wins[a if margin > 0 else b] += 1
            for name, m in ((a, margin), (b, -margin)):
                total[name] += m
                least[name] = min(least[name], m)
        best = max(wins, key=lambda k: (wins[k], total[k]))
        return best, least[best]

    def predict(self, text: str | None) -> tuple[str, float]:
        if not self.langs or text is None or not LETTER.search(text):
            return "und", 0.0
        x = features(text)
        family, first = self._vote(self.families, list(self.langs), x)
        lang, second = self._vote(self.within[family], self.langs[family], x)
        sure = lambda margin: 1.0 / (1.0 + np.exp(-2.0 * np.clip(margin, -20, 20)))
        return lang, float(sure(first) * sure(second))


def predicted(docs: DataFrame) -> DataFrame:
    """doc_id, held_out, lang_pred, score of every document."""
    model = Hierarchy(docs)

    def rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            found = [model.predict(t) for t in batch["text"].to_pylist()]
            columns = [
                batch["doc_id"],
                pa.array([g for g, _ in found], pa.string()),
                pa.array([s for _, s in found], pa.float64()),
            ]
            yield pa.RecordBatch.from_arrays(columns, names=["doc_id", "lang_pred", "score"])

    found = docs.select("doc_id", "text").mapInArrow(rows, "doc_id long, lang_pred string, score double")
    held_out = F.coalesce(bucket(F.col("doc_id"), FOLDS) == HELD_OUT, F.lit(False))
    return found.select("doc_id", held_out.alias("held_out"), "lang_pred", "score")
