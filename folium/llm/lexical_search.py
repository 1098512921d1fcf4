"""Ranked lexical search over all documents, by classes of equal bags.

For a block of items only the terms of those items matter, so a document is its bag: the
counts of the items' terms in it, and its length factor m.  Documents of equal bag and m get
equal scores for every item.  Bags are hashed, the hash deals them out and the whole bag and
m, compared beside it, verify the class, so equal hashes of different bags stay apart.  Each
class is scored once for all items; it carries its size, which counts towards the documents
of a term, and its ``k`` smallest ids: a class gives a ranking no more members than that, in
ascending order.  The best classes of each partition meet in one ranking an item, where
they are expanded into their members.

A document's text is read whole, in one pass a block of items; what is shuffled are bags,
and of equal ones only a count and k ids a task.  Items come in blocks of about
``BLOCK`` terms, so what is sent to tasks has a bound however large the benchmark; every
block sees all documents.  Weights and scores are whole numbers of 64 bits.

Defined cases: a null or empty text has no terms and counts in nothing; a document counts as
often as its rows, and may then stand in a ranking as often; null ids come last among equal
scores; rows of an item equal in id and text are one item, and with different texts each has
its ranking; an item without terms has none, nor has any item if no document has a term.
Columns other than id and text are not read, whatever their names.
"""

from __future__ import annotations

import math
from collections import Counter
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from folium.llm.common import deleted, let_workers_import, work_folder, written

#: Terms of the items of a block, about.
BLOCK = 1 << 18
#: Scores of classes and items, and postings, that a task holds at once.
CELLS = 1 << 21

# A-Z become lower case, whatever else below 128 is no letter or digit becomes a space.
_FOLDED = bytes(
    c + 32 if 65 <= c <= 90 else c if c >= 128 or 48 <= c <= 57 or 97 <= c <= 122 else 32 for c in range(256)
)


def terms(text: bytes | None) -> list[bytes]:
    """The terms of a text in UTF-8, in order."""
    return (text or b"").translate(_FOLDED).split()


def _texts(batch: pa.RecordBatch) -> list[bytes | None]:
    return pc.cast(batch["text"], pa.binary()).to_pylist()


class Items:
    """The items of a block: number of each term, and the items that hold it."""

    def __init__(self, rows: list[tuple[int | None, list[bytes]]]):
        self.ids = [item_id for item_id, _ in rows]
        self.numbers = {t: i for i, t in enumerate(sorted({t for _, held in rows for t in held}))}
        pairs = np.array([(self.numbers[t], i) for i, (_, held) in enumerate(rows) for t in held], dtype=np.int64)
        pairs = pairs.reshape(-1, 2)[np.lexsort(pairs.reshape(-1, 2).T[::-1])]
        self.items = pairs[:, 1]
        self.sizes = np.bincount(pairs[:, 0], minlength=len(self.numbers))
        self.starts = np.cumsum(self.sizes) - self.sizes


def _item_terms(benchmark: DataFrame, folder: str) -> DataFrame:
    def emit(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            held = [sorted(set(terms(t))) for t in _texts(batch)]
            kinds = pa.list_(pa.binary())
            yield pa.RecordBatch.from_arrays([batch["item_id"], pa.array(held, kinds)], names=["item_id", "terms"])

    items = benchmark.select(F.col("item_id").cast("long").alias("item_id"), "text").distinct()
    return written(items.mapInArrow(emit, "item_id long, terms array<binary>").where(F.size("terms") > 0), folder)


def _bags(docs: DataFrame, numbers) -> DataFrame:
    """Id, number of terms and bag of each document with a term."""

    def emit(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        number = numbers.value.get
        for batch in batches:
            ids, lengths, bags = [], [], []
            for doc_id, text in zip(batch["doc_id"].to_pylist(), _texts(batch)):
                held = terms(text)
                if held:
                    counts = Counter(map(number, held))
                    counts.pop(None, None)
                    ids.append(doc_id)
                    lengths.append(len(held))
                    bags.append(np.array(sorted(counts.items()), dtype=np.int32).tobytes())
            yield pa.RecordBatch.from_arrays(
                [pa.array(ids, pa.int64()), pa.array(lengths, pa.int64()), pa.array(bags, pa.binary())],
                names=["doc_id", "n", "bag"],
            )

    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text")
    return rows.mapInArrow(emit, "doc_id long, n long, bag binary")


def classes(bags: DataFrame, n_docs: int, n_terms: int, k: int) -> DataFrame:
    """One row a class of equal m and bag: its size and its k smallest ids, ascending, null last."""
    m = F.expr(f"10 + CAST((90 * CAST(n AS DECIMAL(38, 0)) * {n_docs}) DIV {n_terms} AS LONG)")
    rows = bags.where(F.length("bag") > 0).select("doc_id", m.alias("m"), "bag")
    rows = rows.select("doc_id", F.xxhash64("m", "bag").alias("hash"), "m", "bag")
    key = ["hash", "m", "bag"]
    sizes = rows.groupBy(*key).agg(F.count(F.lit(1)).alias("size"))
    first = Window.partitionBy(*key).orderBy(F.col("doc_id").asc_nulls_last())
    heads = rows.withColumn("place", F.row_number().over(first)).where(F.col("place") <= k)
    members = F.transform(F.array_sort(F.collect_list(F.struct("place", "doc_id"))), lambda x: x["doc_id"])
    return sizes.join(heads.groupBy(*key).agg(members.alias("members")), key).select("m", "bag", "size", "members")


def _holders(found: DataFrame, n_terms: int) -> np.ndarray:
    """The documents that hold each term of the block."""

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros(n_terms, dtype=np.int64)
        for batch in batches:
            for bag, size in zip(batch["bag"].to_pylist(), batch["size"].to_pylist()):
                total[np.frombuffer(bag, dtype=np.int32)[::2]] += size
        at = np.flatnonzero(total)
        yield pa.RecordBatch.from_arrays([pa.array(at, pa.int64()), pa.array(total[at])], names=["term", "docs"])

    parts = found.select("bag", "size").mapInArrow(count, "term long, docs long")
    out = np.zeros(n_terms, dtype=np.int64)
    for r in parts.groupBy("term").agg(F.sum("docs").alias("docs")).collect():
        out[r["term"]] = r["docs"]
    return out


class Best:
    """The k best classes so far of each item, by score and then by their first member."""

    def __init__(self, k: int, n_items: int):
        self.k = k
        self.least = np.ones(n_items, dtype=np.int64)
        self.item = self.score = self.first = np.empty(0, dtype=np.int64)
        self.unnamed = np.empty(0, dtype=bool)
        self.members = np.empty(0, dtype=object)

    def add(self, scores: np.ndarray, members: list[list[int | None]]) -> None:
        row, item = np.nonzero(scores >= self.least)
        if not len(row):
            return
        held = np.empty(len(members), dtype=object)
        held[:] = members
        first = np.array([x[0] or 0 for x in members], dtype=np.int64)
        unnamed = np.array([x[0] is None for x in members])
        self.item = np.concatenate([self.item, item])
        self.score = np.concatenate([self.score, scores[row, item]])
        self.first = np.concatenate([self.first, first[row]])
        self.unnamed = np.concatenate([self.unnamed, unnamed[row]])
        self.members = np.concatenate([self.members, held[row]])
        order = np.lexsort((self.first, self.unnamed, -self.score, self.item))
        items = self.item[order]
        starts = np.searchsorted(items, items)
        rank = np.arange(len(items)) - starts
        order, rank = order[rank < self.k], rank[rank < self.k]
        self.item, self.score, self.first = self.item[order], self.score[order], self.first[order]
        self.unnamed, self.members = self.unnamed[order], self.members[order]
        full = rank == self.k - 1
        self.least[self.item[full]] = self.score[full]


def _scores(bags: list[bytes], m: np.ndarray, items: Items, weights: np.ndarray) -> np.ndarray:
    """Scores of some classes for all items."""
    held = [np.frombuffer(b, dtype=np.int32) for b in bags]
    pairs = np.concatenate(held).reshape(-1, 2).astype(np.int64)
    term, tf = pairs[:, 0], pairs[:, 1]
    row = np.repeat(np.arange(len(bags)), [len(b) // 2 for b in held])
    part = weights[term] * ((1_000_000_000 * tf) // (1000 * tf + 8 * m[row]))
    times = items.sizes[term]
    ends = np.cumsum(times)
    posting = np.arange(ends[-1]) + np.repeat(items.starts[term] - (ends - times), times)
    out = np.zeros((len(bags), len(items.ids)), dtype=np.int64)
    np.add.at(out, (np.repeat(row, times), items.items[posting]), np.repeat(part, times))
    return out


def _ranked(found: DataFrame, items, weights: np.ndarray, k: int) -> DataFrame:
    """The k best classes of each item in each partition."""

    def rank(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own: Items = items.value
        best = Best(k, len(own.ids))
        for batch in batches:
            bags, members = batch["bag"].to_pylist(), batch["members"].to_pylist()
            m = batch["m"].to_numpy()
            # A class makes at most as many postings as the block has, and as many scores as there are items.
            work = np.array([own.sizes[np.frombuffer(b, dtype=np.int32)[::2]].sum() for b in bags]) + len(own.ids)
            part = np.cumsum(work) // CELLS
            for i in np.unique(part):
                a, b = np.searchsorted(part, [i, i + 1])
                best.add(_scores(bags[a:b], m[a:b], own, weights), members[a:b])
        yield pa.RecordBatch.from_arrays(
            [pa.array(best.item, pa.int64()), pa.array(best.score), pa.array(best.members.tolist(), pa.list_(pa.int64()))],
            names=["item", "score", "members"],
        )

    return found.select("m", "bag", "members").mapInArrow(rank, "item long, score long, members array<long>")


def weight(n_docs: int, holders: int) -> int:
    return math.floor(1000 * math.log((2 * n_docs + 2) / (2 * holders + 1)))


def _one_block(docs: DataFrame, items: Items, folder: str, k: int) -> DataFrame | None:
    """The best documents of a block's items, not yet cut to k an item."""
    spark = docs.sparkSession
    context = spark.sparkContext
    bags = written(_bags(docs, context.broadcast(items.numbers)), f"{folder}/bags")
    n_docs, n_terms = bags.agg(F.count(F.lit(1)), F.sum("n")).first()
    if not n_docs:
        return None
    found = written(classes(bags, n_docs, n_terms, k), f"{folder}/classes")
    weights = np.array([weight(n_docs, h) for h in _holders(found, len(items.numbers)).tolist()], dtype=np.int64)
    best = written(_ranked(found, context.broadcast(items), weights, k), f"{folder}/best")
    for name in ("bags", "classes"):
        deleted(spark, f"{folder}/{name}")
    return best


def search(docs: DataFrame, benchmark: DataFrame, k: int = 10) -> DataFrame:
    """The k best documents of each item: ``item_id, rank, doc_id, score``."""
    spark = docs.sparkSession
    let_workers_import(spark)
    folder = work_folder(spark)
    held = _item_terms(benchmark, f"{folder}/items")
    blocks = math.ceil((held.agg(F.sum(F.size("terms"))).first()[0] or 0) / BLOCK)
    parts = []
    for b in range(blocks):
        own = held.where(F.pmod(F.xxhash64("item_id", "terms"), F.lit(blocks)) == b).collect()
        rows = sorted(((r["item_id"], [bytes(t) for t in r["terms"]]) for r in own), key=lambda r: (r[0] or 0, r[1]))
        best = _one_block(docs, items := Items(rows), f"{folder}/{b}", k) if rows else None
        if best is not None:
            ids = spark.createDataFrame(list(enumerate(items.ids)), "item long, item_id long")
            parts.append(best.join(ids, "item").select(F.lit(b).alias("block"), "item", "item_id", "score", "members"))
    if not parts:
        return spark.createDataFrame([], "item_id long, rank int, doc_id long, score long")
    every = parts[0]
    for part in parts[1:]:
        every = every.unionByName(part)
    expanded = every.select("block", "item", "item_id", "score", F.explode("members").alias("doc_id"))
    order = Window.partitionBy("block", "item").orderBy(F.desc("score"), F.col("doc_id").asc_nulls_last())
    ranked = expanded.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= k)
    return ranked.select("item_id", "rank", "doc_id", "score")
