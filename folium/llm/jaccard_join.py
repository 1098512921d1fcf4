"""Exact Jaccard join of word-shingle sets as a metric-space join.

Jaccard distance is a metric, so pivots with triangle-inequality windows find every pair
within ``1 - 0.8`` without comparing all pairs:

1.  Equal sets form a class at once; only its smallest id goes on.
2.  *Outer pivots* are the single shingles, rarest first.  A document is as near to each
    of its shingles as to any other, so its Voronoi region is a tie, and the window that
    catches its partners is the tie's start: a partner lacks at most ``n - ceil(0.8 n)``
    of n shingles, so the pair meets at one of the first ``n - ceil(0.8 n) + 1``.  The
    document is replicated to those regions.  Shingles of no other document fill places
    of the window without making a region, so a text with more than a fifth of its own
    leaves here: passages that many texts share make no pairs.
3.  *Opening*: every document is compared with the pivot (the smallest id) of its most
    populous region alone.  A large group of near copies becomes one class by as many pairs
    as it has documents, and its many other regions are done before any pair of theirs.
4.  *Inner pivots*: in a region one document is compared with all others.  Those within
    the distance are linked.  The rest, and those linked ones whose distance is within the
    window of the rest, form the next, smaller region, whose pivots are the document
    nearest to the last one and one of the rest; and so on recursively.  Documents that
    are already connected need no further comparison.  Where all but a few documents of a
    region are of one class, those few meet all others of the region at once, within the
    windows; so do, after the last round, the documents of any region that is left.
5.  Connected components over the links give each document's class.

The first pass (step 2 on the quarter of the hashes that sort first) sheds most
documents while shuffling only that quarter; the second sees whole sets of the rest.
No region is gathered in one task: regions are rows, pairs come from joins that adaptive
execution can split, and counts are summed before shuffles.

Defined cases: a text without words has no set, links with nothing and is its own class;
under five words the whole sequence is one element; rows that share an id are one
document, whose set is the union of theirs, and each of them is returned; a null id stays
null and links with nothing.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from folium.llm.common import deleted, release_shuffles, work_folder, written
from folium.llm.word_codes import WordCodes
from folium.session import stored

SHINGLE = 5
#: Hashes are 63 bits; those below this bound stand first and are shuffled in the first pass.
FIRST = 1 << 61
#: Documents outside a region's largest class, up to so many, meet the whole region at once.
FEW = 64
#: Documents of a region that meet those few in one task.
SLICE = 1024
#: Rounds of inner pivots, before the remaining pairs of a region are compared directly.
ROUNDS = 12
#: Ids that may be sent to all tasks; more are joined by a shuffle.
SENT_IDS = 4_000_000
#: Keys of equal sets (some 30 bytes each), and hashes of sets, that may be.
SENT_KEYS = 1_000_000
SENT_HASHES = 2_000_000

_MIX = np.random.default_rng(5).integers(1, 2**63, SHINGLE + 1, dtype=np.uint64) * np.uint64(2) + np.uint64(1)


def shingle_set(words: np.ndarray) -> np.ndarray:
    """Sorted 63-bit hashes of the distinct shingles of a sequence of word codes."""
    if not len(words):
        return np.empty(0, dtype=np.int64)
    width = min(len(words), SHINGLE)
    n = len(words) - width + 1
    h = np.full(n, width, dtype=np.uint64)
    for i in range(width):
        h = (h ^ (h >> np.uint64(29))) * _MIX[SHINGLE] + words[i : i + n] * _MIX[i]
    h = (h ^ (h >> np.uint64(32))) * _MIX[SHINGLE]
    return np.unique(((h ^ (h >> np.uint64(29))) >> np.uint64(1)).astype(np.int64))


def window(n):
    """How many of n shingles, in any fixed order, meet one of every partner."""
    return n - (4 * n + 4) // 5 + 1


def _lists(values: list[np.ndarray]) -> pa.ListArray:
    ends = np.cumsum([0] + [len(v) for v in values], dtype=np.int64)
    flat = np.concatenate(values) if values else np.empty(0, dtype=np.int64)
    return pa.ListArray.from_arrays(pa.array(ends, pa.int32()), pa.array(flat, pa.int64()))


def _sketch(ids: pa.Array, sets: list[np.ndarray]) -> pa.RecordBatch:
    size, keys, first, lists = [], [], [], []
    for found in sets:
        below = int(np.searchsorted(found, FIRST))
        size.append(len(found))
        keys.append(hashlib.md5(found.tobytes()).digest())
        first.append(below)
        lists.append(found[: max(below, window(len(found)))])
    return pa.RecordBatch.from_arrays(
        [ids, pa.array(size, pa.int64()), pa.array(keys, pa.binary()), pa.array(first, pa.int64()), _lists(lists)],
        names=["doc_id", "n", "set_key", "n_first", "first"],
    )


_SKETCH = "doc_id long, n long, set_key binary, n_first long, first array<long>"


def _sketches(docs: DataFrame) -> DataFrame:
    """doc_id, n, set_key, n_first and the hashes of the first pass, of every row."""

    def rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        codes = WordCodes()
        for batch in batches:
            texts = pc.cast(batch["text"], pa.binary()).to_pylist()
            yield _sketch(batch["doc_id"], [shingle_set(codes.of(t)) for t in texts])

    return docs.select("doc_id", "text").mapInArrow(rows, _SKETCH)


def _whole_sets(docs: DataFrame) -> DataFrame:
    def rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        codes = WordCodes()
        for batch in batches:
            sets = [shingle_set(codes.of(t)) for t in pc.cast(batch["text"], pa.binary()).to_pylist()]
            yield pa.RecordBatch.from_arrays([batch["doc_id"], _lists(sets)], names=["rep", "shingles"])

    return docs.select("doc_id", "text").mapInArrow(rows, "rep long, shingles array<long>")


def _united(docs: DataFrame) -> DataFrame:
    """(rep, shingles): the sorted union of the sets of the rows of each id."""
    hashes = _whole_sets(docs).select("rep", F.explode_outer("shingles").alias("hash")).distinct()
    return hashes.groupBy("rep").agg(F.sort_array(F.collect_list("hash")).alias("shingles"))


def _sketches_of_sets(sets: DataFrame) -> DataFrame:
    """What _sketches gives, of (rep, shingles)."""

    def rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            yield _sketch(batch["rep"], [np.array(x, dtype=np.int64) for x in batch["shingles"].to_pylist()])

    return sets.mapInArrow(rows, _SKETCH)


def _among(rows: DataFrame, ids: DataFrame, how: str) -> DataFrame:
    """Rows whose doc_id is (left_semi) or isn't (left_anti) among stored ids.

    The ids are sent to all tasks while few, which is counted; else both sides shuffle.
    """
    return rows.join(F.broadcast(ids) if ids.count() <= SENT_IDS else ids, "doc_id", how)


def _shared(rows: DataFrame) -> DataFrame:
    """(hash, rep) rows whose hash has several rows, with that number."""
    often = rows.groupBy("hash").agg(F.count("*").alias("df")).where("df > 1")
    return rows.join(often, "hash")


def _survivors(sketches: DataFrame, copies: DataFrame) -> DataFrame:
    """doc_id of the representatives that the first pass can't shed."""
    reps = _among(sketches.where("doc_id IS NOT NULL AND n > 0"), copies, "left_anti")
    rows = reps.select(F.explode("first").alias("hash"), F.col("doc_id").alias("rep"))
    met = _shared(rows).groupBy("rep").agg(F.count_if(F.col("hash") < FIRST).alias("met"))
    sizes = reps.select("doc_id", "n", "n_first")
    return (
        sizes.join(met.withColumnRenamed("rep", "doc_id"), "doc_id")
        .where(F.col("n_first") - F.col("met") < window_of(F.col("n")))
        .select("doc_id")
        .distinct()
    )


def window_of(n: Column) -> Column:
    return n - F.floor((4 * n + 4) / 5) + 1


def _regions(sets: DataFrame, folder: str) -> DataFrame:
    """(region, rep, n): the windows of outer pivots, rarest first, without repeated regions."""
    rows = sets.select("rep", F.size("shingles").cast("long").alias("n"), F.explode("shingles").alias("hash"))
    met = (
        _shared(rows)
        .groupBy("rep", "n")
        .agg(F.sort_array(F.collect_list(F.struct("df", "hash"))).alias("met"))
        .withColumn("left", window_of(F.col("n")) - (F.col("n") - F.size("met")))
        .where("left > 0")
    )
    own = F.col("n") - F.size("met")
    starts = F.posexplode(F.slice("met", F.lit(1), F.col("left").cast("int"))).alias("i", "x")
    placed = met.select("rep", "n", own.alias("own"), starts)
    return _distinct_regions(
        placed.select(F.col("x.hash").alias("region"), "rep", "n", (F.col("own") + F.col("i") + 1).alias("place")),
        folder,
    )


def _distinct_regions(placed: DataFrame, folder: str) -> DataFrame:
    """Regions of two documents or more; of regions with the same documents one stays.

    A pair of sizes n and m has at least 4/9 (n + m) shingles in common, so it also meets
    at one of the first n - ceil(4/9 (n + m)) + 1 of n: with the smallest size m of a
    region, places beyond that can't matter there.
    """
    placed = written(placed, f"{folder}/placed")
    least = placed.groupBy("region").agg(F.min("n").alias("m"))
    partner = F.greatest(F.col("m"), F.floor((4 * F.col("n") + 4) / 5))
    within = F.col("place") <= F.col("n") - F.floor((4 * (F.col("n") + partner) + 8) / 9) + 1
    members = written(placed.join(least, "region").where(within).drop("m", "place"), f"{folder}/within")
    deleted(placed.sparkSession, f"{folder}/placed")
    kept = (
        members.groupBy("region")
        .agg(
            F.count("*").alias("docs"),
            F.bit_xor(F.xxhash64("rep")).alias("a"),
            F.bit_xor(F.xxhash64("rep", F.lit(7))).alias("b"),
        )
        .where("docs > 1")
        .groupBy("docs", "a", "b")
        .agg(F.min("region").alias("region"))
    )
    distinct = written(members.join(kept.select("region", "docs"), "region"), f"{folder}/regions")
    deleted(placed.sparkSession, f"{folder}/within")
    release_shuffles(placed.sparkSession)
    return distinct


def _opening(regions: DataFrame, sets: DataFrame, folder: str) -> DataFrame:
    """Links of each document with the smallest one of its most populous region."""
    pivots = regions.groupBy("region").agg(F.min("rep").alias("pivot"))
    widest = regions.groupBy("rep").agg(F.max_by("region", F.struct("docs", "region")).alias("region"))
    pairs = widest.join(pivots, "region").select(F.col("pivot").alias("a"), F.col("rep").alias("b"))
    return _close(pairs.where("a <> b"), sets, folder).where(LINKED).select("a", "b")


def _sets_of(sets: DataFrame, ids: DataFrame, side: str) -> DataFrame:
    """The sets of some stored ids, as columns of one side of a pair.

    Only the ids meet all sets, so sets that no pair names are read but not shuffled.
    """
    own = _among(sets.withColumnRenamed("rep", "doc_id"), ids.withColumnRenamed(side, "doc_id"), "left_semi")
    return own.select(F.col("doc_id").alias(side), F.col("shingles").alias(f"set_{side}"))


def _close(pairs: DataFrame, sets: DataFrame, folder: str) -> DataFrame:
    """Distinct pairs (a, b) with the exact size of intersection and union.

    Side ``a`` is the one with fewer different ids; its sets are sent to all tasks while they
    are few, which is counted.
    """
    pairs = written(pairs.distinct(), f"{folder}/pairs")
    ids = {s: written(pairs.select(s).distinct(), f"{folder}/{s}") for s in "ab"}
    few = _sets_of(sets, ids["a"], "a")
    if (few.agg(F.sum(F.size("set_a"))).first()[0] or 0) <= SENT_HASHES:
        few = F.broadcast(few)
    both = pairs.join(_sets_of(sets, ids["b"], "b"), "b").join(few, "a")
    common = F.size(F.array_intersect("set_a", "set_b"))
    return both.withColumn("common", common).withColumn(
        "united", F.size("set_a") + F.size("set_b") - F.col("common")
    ).select("a", "b", "common", "united")


LINKED = "100 * common >= 80 * united"
#: The join's distance, with room for rounding.
MARGIN = 0.2 + 1e-9


def components(links: DataFrame, turns: int | None = None) -> DataFrame:
    """(id, component): the smallest id connected with each, by stars that grow and merge.

    Every turn links each node's larger neighbours, then its smaller ones, to the smallest
    of them, until nothing changes.  After a given number of turns the ids are of the same
    component, but perhaps not its smallest.  All rows are edges, so a node of many links
    is summed before the shuffle.
    """

    def least(edges: DataFrame, both: bool) -> DataFrame:
        arcs = edges.select("a", "b")
        if both:
            arcs = arcs.unionByName(edges.select(F.col("b").alias("a"), F.col("a").alias("b")))
        low = arcs.groupBy("a").agg(F.min("b").alias("low")).withColumn("low", F.least("a", "low"))
        joined = arcs.join(low, "a")
        if both:
            return joined.where("b > a").select(F.col("b").alias("a"), F.col("low").alias("b")).distinct()
        rest = joined.where("b > low").select(F.col("b").alias("a"), F.col("low").alias("b"))
        return low.select("a", F.col("low").alias("b")).unionByName(rest).distinct()

    spark = links.sparkSession
    folder = work_folder(spark)
    edges = links.select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).where("a <> b").distinct()
    state, done = None, 0
    while True:
        edges = written(least(least(edges, True), False), f"{folder}/{done}")
        deleted(spark, f"{folder}/{done - 1}")
        done += 1
        now = None if turns else edges.agg(F.count("*"), F.sum(F.xxhash64("a", "b").cast("decimal(38,0)"))).first()
        if done == turns or now is not None and now == state:
            return edges.groupBy("a").agg(F.min("b").alias("component")).withColumnRenamed("a", "id")
        state = now


def _named(members: DataFrame, classes: DataFrame) -> DataFrame:
    """Members with the class their document is in so far; regions of one class are done."""
    return (
        members.join(classes.select(F.col("id").alias("rep"), "component"), "rep", "left")
        .withColumn("class", F.coalesce("component", "rep"))
        .drop("component")
    )


def _classes(sets: DataFrame) -> DataFrame:
    """(id, component) of the linked documents."""
    spark = sets.sparkSession
    folder = work_folder(spark)
    regions = _regions(sets, folder)
    links = written(_opening(regions, sets, f"{folder}/opening"), f"{folder}/links")
    members = written(_named(regions.drop("docs"), components(links, turns=4)), f"{folder}/members")
    for done in ("opening", "regions"):
        deleted(spark, f"{folder}/{done}")
    share = F.col("common") / F.col("united")
    for turn in range(ROUNDS + 1):
        # The document nearest to the last pivot lies towards the middle of its neighbours;
        # the smallest of those not linked to it opens up the rest.
        near = F.lit(0.0) if turn == 0 else share
        rest = F.lit(None).cast("long") if turn == 0 else F.when(~F.expr(LINKED), F.col("rep"))
        # By class first, so that a region's documents are counted before they meet.
        still = (
            members.groupBy("region", "class")
            .agg(F.count("*").alias("docs"), F.max(F.struct(near, -F.col("rep"))).alias("near"), F.min(rest).alias("other"))
            .groupBy("region")
            .agg(
                F.sum("docs").alias("docs"),
                F.max("docs").alias("most"),
                F.max_by("class", F.struct(F.col("docs"), -F.col("class"))).alias("top"),
                F.max("near").alias("near"),
                F.min("other").alias("other"),
            )
            .where("docs > most")
            .withColumn("pivot", -F.col("near.col2"))
            .drop("near")
        )
        now = f"{folder}/{turn}"
        active = written(members.join(still, "region"), f"{now}/active")
        if active.isEmpty():
            break
        by_pivot = F.lit(True) if turn == 0 else (F.col("docs") - F.col("most") > FEW) & F.lit(turn < ROUNDS)
        stars = active.where(by_pivot)
        pairs = stars.select(F.explode(F.array("pivot", "other")).alias("a"), F.col("rep").alias("b"))
        starred = written(_close(pairs.where("a <> b"), sets, f"{now}/stars"), f"{now}/starred")
        found = starred.where(LINKED).select("a", "b")
        if turn:
            found = found.unionByName(_direct(active.where(~by_pivot), sets, f"{now}/direct"))
        links = written(links.unionByName(found).distinct(), f"{folder}/links{turn}")
        if stars.isEmpty():
            break
        # The next region: what isn't linked to the pivot, and what is and may link to that.
        seen = (
            stars.where((F.col("rep") != F.col("pivot")) & ~F.col("rep").eqNullSafe(F.col("other")))
            .select("region", "rep", "n", "pivot")
            .join(starred.withColumnsRenamed({"a": "pivot", "b": "rep"}), ["pivot", "rep"])
        )
        edge = seen.groupBy("region").agg(F.max(F.when(~F.expr(LINKED), share)).alias("edge"))
        left = seen.join(edge, "region").where(share <= F.col("edge") + MARGIN).drop("pivot", "edge")
        members = written(_named(left, components(links, turns=2)), f"{folder}/members{turn}")
        # What this turn wrote for itself, and what the next one replaces, isn't read any more.
        last = turn - 1 if turn else ""
        for done in (now, f"{folder}/links{last}", f"{folder}/members{last}"):
            deleted(spark, done)
        release_shuffles(spark)
    return components(links)


def _direct(members: DataFrame, sets: DataFrame, folder: str) -> DataFrame:
    """Links of documents outside their region's largest class with those of other classes.

    A region's documents are dealt over slices, each of which meets all that stand outside:
    rows grow with the region's size times those few, and no task takes a whole large region.
    """
    share = F.col("common") / F.col("united")
    slices = F.ceil(F.col("docs") / SLICE)
    every = members.select(
        "region",
        F.pmod(F.xxhash64("rep"), slices).alias("slice"),
        F.col("rep").alias("b"),
        F.col("n").alias("nb"),
        F.col("class").alias("cb"),
        share.alias("sb"),
    )
    outside = members.where(F.col("class") != F.col("top")).select(
        "region",
        F.explode(F.sequence(F.lit(0).cast("long"), slices - 1)).alias("slice"),
        F.col("rep").alias("a"),
        F.col("n").alias("na"),
        F.col("class").alias("ca"),
        share.alias("sa"),
        "top",
    )
    fits = (
        (F.col("ca") != F.col("cb"))
        # Two that stand outside meet once.
        & ((F.col("cb") == F.col("top")) | (F.col("a") < F.col("b")))
        & (5 * F.col("na") >= 4 * F.col("nb"))
        & (5 * F.col("nb") >= 4 * F.col("na"))
        # Distances of linked documents to the last pivot differ by the join's own at most.
        & (F.abs(F.col("sa") - F.col("sb")) <= MARGIN)
    )
    pairs = outside.join(every, ["region", "slice"]).where(fits).select("a", "b")
    return _close(pairs, sets, folder).where(LINKED).select("a", "b")


def joined(docs: DataFrame) -> DataFrame:
    """doc_id, n_shingles, component_id of every row."""
    docs = docs.select("doc_id", "text")
    by_row = sketches = stored(_sketches(docs))
    # From here on an id has one row, with the union of the sets of its rows.
    repeated = stored(sketches.where("doc_id IS NOT NULL").groupBy("doc_id").count().where("count > 1").select("doc_id"))
    united = None
    if not repeated.isEmpty():
        united = stored(_united(_among(docs, repeated, "left_semi")))
        sketches = stored(_among(sketches, repeated, "left_anti").unionByName(_sketches_of_sets(united)))
        docs = _among(docs, repeated, "left_anti")
    # Only keys of several rows meet the rows; sent to all tasks while few, a hot one needs no shuffle.
    groups = sketches.where("n > 0").groupBy("set_key").agg(F.min("doc_id").alias("rep"), F.count("*").alias("rows"))
    equal = stored(groups.where("rows > 1").drop("rows"))
    if equal.count() <= SENT_KEYS:
        equal = F.broadcast(equal)
    own = sketches.select("doc_id", F.col("n").alias("n_shingles"), "set_key").join(equal, "set_key", "left")
    own = stored(own.select("doc_id", "n_shingles", F.coalesce("rep", "doc_id").alias("rep")))
    copies = stored(own.where("doc_id <> rep").select("doc_id").distinct())
    survivors = stored(_survivors(sketches, copies))
    sets = _whole_sets(_among(docs, survivors, "left_semi"))
    if united is not None:
        sets = sets.unionByName(united.join(survivors.withColumnRenamed("doc_id", "rep"), "rep", "left_semi"))
    sets = stored(sets)
    own = own.join(_classes(sets).withColumnRenamed("id", "rep"), "rep", "left")
    named = F.coalesce("component", "rep", "doc_id")
    own = own.select("doc_id", "n_shingles", F.when(F.col("doc_id").isNotNull(), named).alias("component_id"))
    if united is None:
        return own
    own = stored(own)
    again = _among(by_row, repeated, "left_semi").select("doc_id").join(own, "doc_id")
    return _among(own, repeated, "left_anti").unionByName(again)


def first_of_each(docs: DataFrame) -> DataFrame:
    """The documents without those that a smaller id of their class stands for."""
    gone = stored(joined(docs).where("doc_id <> component_id").select("doc_id").distinct())
    return _among(docs, gone, "left_anti").select(*docs.columns)
