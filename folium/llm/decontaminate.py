"""Benchmark decontamination by spaced-seed hashing.

A mask keeps some words of a short window and ignores the others, so windows that differ
only at ignored places have the same hash.  The masks below hit every stretch of
``STRETCH`` words that agrees with an item but for up to ``CHANGED`` substituted words (a
test goes through all cases).  Hits of a document and an item on the same diagonal are
verified word by word: a document is contaminated where such a stretch lies in it.
Items of under ``STRETCH`` words must occur whole, with one substitution from nine words
on; items of under ``LEAST`` words must be a document's whole text; a single word names
nothing.

Words are compared without case and outer punctuation.

The benchmark's hashes are sent to all tasks only while there are at most ``SENT`` of
them, counted first; documents are then judged in one pass without a shuffle.  Beyond
that, hashes of documents and items meet in a join and the verified pairs come back.
Both ways judge rows, not ids, and give the same results.

Defined cases: null or empty texts have no words and are clean; null ids stay null; of
rows that share an id ``clean`` drops the contaminated ones alone and ``leaks`` gives
their best overlap; repeated items count as one each; an empty benchmark leaves
everything clean and an empty table stays empty; long texts are searched whole; columns
beside those read are kept, whatever their names.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from folium.llm.common import fresh, let_workers_import
from folium.llm.word_codes import WordCodes
from folium.session import stored

STRETCH, CHANGED = 13, 2
LEAST = 5
MASKS = ("11101011", "110100111")
SHORT_MASK = "1111"
#: Hashes and words of a benchmark that tasks may hold.
SENT = 4_000_000

_MIX = np.random.default_rng(20).integers(1, 2**63, 16, dtype=np.uint64) * np.uint64(2) + np.uint64(1)
PUNCTUATION = b".,;:!?\"'()[]{}<>*_-`/\\|#$%&~^+=@"


def _codes() -> WordCodes:
    return WordCodes(lambda w: w.strip(PUNCTUATION))


def _words(codes: WordCodes, text: bytes | None) -> np.ndarray:
    found = codes.of(text)
    return found[found != 0]


def seeds(words: np.ndarray, mask: str) -> np.ndarray:
    """The hash under a mask at each place where its window fits."""
    n = len(words) - len(mask) + 1
    if n <= 0:
        return np.empty(0, dtype=np.uint64)
    total = np.full(n, len(mask), dtype=np.uint64)
    for i, keep in enumerate(mask):
        if keep == "1":
            total += words[i : i + n] * _MIX[i]
    total ^= total >> np.uint64(31)
    return total * _MIX[15]


def allowed(n: int) -> int:
    """Substitutions that an item of n words may have."""
    return CHANGED if n >= STRETCH else int(n >= 9)


def item_masks(n: int) -> tuple[str, ...]:
    if n >= LEAST:
        return MASKS if n >= STRETCH else (SHORT_MASK,)
    return ("1" * n,) if n > 1 else ()


def text_masks(n: int) -> tuple[str, ...]:
    """The masks that meet those of any item that a text of n words may hold."""
    return (*MASKS, SHORT_MASK) if n >= LEAST else item_masks(n)


def overlap(doc: np.ndarray, item: np.ndarray, shift: int) -> tuple[int, int, int] | None:
    """The best agreeing stretch on a diagonal: (agreeing words, first word in the document, words).

    None unless some stretch of the item has no more substitutions than allowed.
    """
    n = len(item)
    if n < LEAST and len(doc) != n:
        return None
    first, last = max(0, -shift), min(n, len(doc) - shift)
    length = min(n, STRETCH)
    if last - first < length:
        return None
    same = doc[first + shift : last + shift] == item[first:last]
    sums = np.concatenate(([0], np.cumsum(same)))
    good = np.flatnonzero(sums[length:] - sums[:-length] >= length - allowed(n))
    if not len(good):
        return None
    inside = np.zeros(len(same) + 1, dtype=np.int64)
    np.add.at(inside, good, 1)
    np.add.at(inside, good + length, -1)
    covered = np.cumsum(inside[:-1]) > 0
    places = np.flatnonzero(covered)
    return int((same & covered).sum()), int(places[0] + first + shift), int(covered.sum())


def _rank(got: tuple[int, int, int]) -> tuple[int, int, int]:
    return got[0], -got[1], got[2]


def best_overlap(doc: np.ndarray, item: np.ndarray) -> tuple[int, int, int] | None:
    """The best of the overlaps on the diagonals where the two share a hash."""
    shifts: set[int] = set()
    for mask in item_masks(len(item)):
        own, other = seeds(item, mask), seeds(doc, mask)
        order = np.argsort(own, kind="stable")
        low, high = (np.searchsorted(own[order], other, side) for side in ("left", "right"))
        for place in np.flatnonzero(low < high):
            shifts.update(int(place) - int(j) for j in order[low[place] : high[place]])
    return max(filter(None, (overlap(doc, item, s) for s in shifts)), key=_rank, default=None)


class Items:
    """A benchmark as arrays: the words of its items and the places of each hash."""

    def __init__(self, rows: list[tuple[int | None, bytes | None]]):
        codes = _codes()
        self.ids, self.words = [], []
        hashes, places = [], []
        for item_id, text in sorted(set(rows), key=lambda r: (r[0] is None, r[0] or 0, r[1] or b"")):
            words = _words(codes, text)
            for mask in item_masks(len(words)):
                found = seeds(words, mask)
                hashes.append(found)
                places.append(np.stack([np.full(len(found), len(self.ids)), np.arange(len(found))]))
            self.ids.append(item_id)
            self.words.append(words)
        every = np.concatenate(hashes) if hashes else np.empty(0, dtype=np.uint64)
        order = np.argsort(every, kind="stable")
        self.item, self.place = np.concatenate(places, axis=1)[:, order] if hashes else np.empty((2, 0), dtype=int)
        self.hashes, self.starts, self.counts = np.unique(every[order], return_index=True, return_counts=True)
        #: Marks the upper bits that occur, so that most windows cost one look.
        self.seen = np.zeros(1 << 20, dtype=bool)
        self.seen[self.hashes >> np.uint64(44)] = True

    def diagonals(self, words: np.ndarray) -> set[tuple[int, int]]:
        """(item, shift) of every hit; the shift is the place in the text less that in the item."""
        found: set[tuple[int, int]] = set()
        if not len(self.hashes):
            return found
        for mask in text_masks(len(words)):
            h = seeds(words, mask)
            at = np.flatnonzero(self.seen[h >> np.uint64(44)])
            if not len(at):
                continue
            k = np.searchsorted(self.hashes, h[at])
            ok = (k < len(self.hashes)) & (self.hashes[np.minimum(k, len(self.hashes) - 1)] == h[at])
            for place, key in zip(at[ok].tolist(), k[ok].tolist()):
                for j in range(self.starts[key], self.starts[key] + self.counts[key]):
                    found.add((int(self.item[j]), place - int(self.place[j])))
        return found

    def leaks(self, words: np.ndarray) -> list[tuple[int | None, int, int, int, int]]:
        """(item_id, agreeing words, first word, words, words of the item), the best of each item."""
        best: dict[int, tuple[int, int, int]] = {}
        for item, shift in self.diagonals(words):
            got = overlap(words, self.words[item], shift)
            if got and (item not in best or _rank(got) > _rank(best[item])):
                best[item] = got
        return [(self.ids[i], *got, len(self.words[i])) for i, got in sorted(best.items())]


PAIRS = "doc_id long, item_id long, matched_words int, first_word int, stretch_words int, item_words int"


def _binary(column: pa.Array) -> list[bytes | None]:
    return pc.cast(column, pa.binary()).to_pylist()


def _fits(benchmark: DataFrame) -> bool:
    """Whether the items' words, and so at most two hashes each, are few enough to send."""
    size = benchmark.agg(F.sum(F.size(F.split("text", r"\s+")) + F.lit(1)).alias("n")).first()["n"]
    return 3 * (size or 0) <= SENT


def _sent(benchmark: DataFrame) -> list[tuple[int | None, bytes | None]]:
    rows = benchmark.select("item_id", F.col("text").cast("binary").alias("text")).collect()
    return [(r["item_id"], None if r["text"] is None else bytes(r["text"])) for r in rows]


def _one_pass(docs: DataFrame, benchmark: DataFrame) -> DataFrame:
    held = docs.sparkSession.sparkContext.broadcast(_sent(benchmark))

    def find(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        items, codes = Items(held.value), _codes()
        for batch in batches:
            rows = []
            for doc_id, text in zip(batch["doc_id"].to_pylist(), _binary(batch["text"])):
                rows += [(doc_id, *leak) for leak in items.leaks(_words(codes, text))]
            yield _pairs(rows)

    return docs.select("doc_id", "text").mapInArrow(find, PAIRS)


def _pairs(rows: list[tuple]) -> pa.RecordBatch:
    kinds = [pa.int64(), pa.int64(), pa.int32(), pa.int32(), pa.int32(), pa.int32()]
    columns = list(zip(*rows)) if rows else [()] * len(kinds)
    names = [x.split()[0] for x in PAIRS.split(", ")]
    return pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(columns, kinds)], names=names)


def _joined(docs: DataFrame, benchmark: DataFrame, row: str) -> DataFrame:
    """The same pairs, with the key of the document's row, where the benchmark is too large to send.

    Hashes of rows and items meet in a join; pairs that share one are verified whole.
    """

    def hashed(key: str, masks_of):
        def emit(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            codes = _codes()
            for batch in batches:
                for row_id, text in zip(batch[key].to_pylist(), _binary(batch["text"])):
                    words = _words(codes, text)
                    for mask in masks_of(len(words)):
                        found = np.unique(seeds(words, mask)).astype(np.int64)
                        ids = pa.array(np.full(len(found), row_id, dtype=np.int64))
                        yield pa.RecordBatch.from_arrays([ids, pa.array(found)], names=[key, "seed"])

        return emit

    items = stored(
        benchmark.select("item_id", "text").distinct().withColumn("item", F.monotonically_increasing_id())
    )
    texts = docs.select(F.col(row).alias("row"), "doc_id", "text")
    train = texts.select("row", "text").mapInArrow(hashed("row", text_masks), "row long, seed long")
    test = items.select("item", "text").mapInArrow(hashed("item", item_masks), "item long, seed long")
    pairs = train.join(test, "seed").select("row", "item").distinct()
    both = pairs.join(texts.withColumnRenamed("text", "doc_text"), "row").join(
        items.withColumnRenamed("text", "item_text"), "item"
    )

    def verify(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        codes = _codes()
        for batch in batches:
            rows, keys = [], []
            columns = (batch[c].to_pylist() for c in ("row", "doc_id", "item_id"))
            for key, doc_id, item_id, doc, item in zip(*columns, _binary(batch["doc_text"]), _binary(batch["item_text"])):
                words = _words(codes, item)
                got = best_overlap(_words(codes, doc), words)
                if got:
                    rows.append((doc_id, item_id, *got, len(words)))
                    keys.append(key)
            found = _pairs(rows)
            yield pa.RecordBatch.from_arrays(
                [pa.array(keys, pa.int64()), *found.columns], names=["row", *found.schema.names]
            )

    wanted = both.select("row", "doc_id", "item_id", "doc_text", "item_text")
    return wanted.mapInArrow(verify, f"row long, {PAIRS}")


def leaks(docs: DataFrame, benchmark: DataFrame) -> DataFrame:
    """One row per contaminated document and item, with the best overlap."""
    let_workers_import(docs.sparkSession)
    if _fits(benchmark):
        found = _one_pass(docs, benchmark)
    else:
        rows = stored(docs.select("doc_id", "text").withColumn("row", F.monotonically_increasing_id()))
        found = _joined(rows, benchmark, "row").drop("row")
    best = F.max_by(
        F.struct("matched_words", "first_word", "stretch_words", "item_words"),
        F.struct("matched_words", -F.col("first_word"), "stretch_words", "item_words"),
    )
    return found.groupBy("doc_id", "item_id").agg(best.alias("best")).select("doc_id", "item_id", "best.*")


def clean(docs: DataFrame, benchmark: DataFrame) -> DataFrame:
    """The documents without any overlap, with the columns they came with."""
    let_workers_import(docs.sparkSession)
    if not _fits(benchmark):
        row = fresh(docs, "_row")
        rows = stored(docs.withColumn(row, F.monotonically_increasing_id()))
        found = _joined(rows, benchmark, row).select(F.col("row").alias(row)).distinct()
        return rows.join(found, row, "left_anti").select(*docs.columns)
    held = docs.sparkSession.sparkContext.broadcast(_sent(benchmark))
    at = docs.columns.index("text")

    def keep(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        items, codes = Items(held.value), _codes()
        for batch in batches:
            yield batch.filter(pa.array([not items.leaks(_words(codes, t)) for t in _binary(batch.column(at))]))

    return docs.mapInArrow(keep, docs.schema)
