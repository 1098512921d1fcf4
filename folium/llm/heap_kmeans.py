"""Exact k-means over integer vectors with heap-ordered bounds.

Every vector holds one number: the gap between a lower bound of its distance to any other
centroid and an upper bound of the distance to its own.  When centroids move, the gap of each
member of a cluster shrinks by at most the cluster's move plus the largest move of another
one.  The sum of those shrinkages is the cluster's *drift*; a gap is filed as gap + drift, so
nothing that is filed needs an update.  Each cluster keeps its filed gaps in a heap: in a
round, only vectors whose filed gap is at or below the drift are popped, compared with all
centroids in exact integers, and filed again.  All others provably keep their centroid.

On Spark the vectors lie in blocks of at most ``BLOCK``; a cluster's heap is one heap for
each block.  A round reads the last round's blocks, pops, and writes the blocks and what the
vectors that changed add to the integer sums of their clusters; the sums meet in one small
aggregate (k times components + 1 rows).  Blocks are rows of a table in the shared folder, so a
lost executor costs the round's own tasks.  The table before is deleted once the next one is
written.  Vectors are never shuffled, so neither copies nor a large cluster make a large task.

Defined cases: vectors with another number of components, or with a null or non-finite one,
are left out; with fewer than k vectors there are as many centroids as vectors; without any
the result is empty.  Rows that repeat an id are vectors of their own, and so are rows
without an id, which come last among the seeds.  Equal distances go to the smaller number.
A component of 2^19 or more in size counts as 2^19: beyond it, squared distances don't fit a
long.  Columns other than the id and the vector are not read, whatever their names.
"""

from __future__ import annotations

import hashlib
import heapq
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from folium.llm.common import deleted, let_workers_import, work_folder, written
from folium.session import stored

#: Vectors of a block: a quarter of a megabyte at 64 components.
BLOCK = 1024
#: Components in size at most, after scaling.
LARGEST = 2**27
SCALE = 256
#: Part of the distances by which a gap is taken shorter, far above the rounding of doubles.
ROUNDING = 1e-9

BLOCKS = "ids array<long>, vectors binary, owner binary, filed binary, places binary, ends binary, sums binary"


def kept(vectors: DataFrame, size: int, id_column: str, vector_column: str) -> DataFrame:
    """Id and vector, as doubles, of the rows with ``size`` finite components."""
    vector = F.col(vector_column).cast("array<double>")
    finite = F.forall(vector, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf")))
    return (
        vectors.select(F.col(id_column).alias("vec_id"), vector.alias("vector"))
        .where(F.size("vector") == size)
        .where(finite)
    )


def scaled(values: np.ndarray) -> np.ndarray:
    return np.clip(np.floor(SCALE * values), -LARGEST, LARGEST).astype(np.int64)


def seeds(vectors: DataFrame, k: int, salt: str) -> np.ndarray:
    """The k vectors with the smallest hash of their id, in that order."""
    key = F.sha2(F.concat(F.lit(salt), F.col("vec_id").cast("string")), 256)
    rows = vectors.orderBy(key.asc_nulls_last(), "vector").limit(k).collect()
    return scaled(np.array([r["vector"] for r in rows], dtype=np.float64))


def squared(x: np.ndarray, c: np.ndarray) -> np.ndarray:
    """Exact squared distances of all x to all c."""
    size = np.abs(x).max(initial=0) + np.abs(c).max(initial=0)
    if x.shape[1] * int(size) ** 2 < 2**53:  # every partial sum is a whole number that a double holds
        a, b = x.astype(np.float64), c.astype(np.float64)
        return ((a * a).sum(1)[:, None] - 2 * (a @ b.T) + (b * b).sum(1)).astype(np.int64)
    return np.stack([((x - row) ** 2).sum(1) for row in c], axis=1)


def shrinkage(old: np.ndarray, new: np.ndarray) -> np.ndarray:
    """By how much a gap in each cluster can shrink as centroids move."""
    moves = np.sqrt(((new - old) ** 2).sum(1).astype(np.float64))
    order = np.argsort(moves)
    others = np.full(len(moves), moves[order[-1]])
    others[order[-1]] = moves[order[-2]] if len(moves) > 1 else 0.0
    return (moves + others) * (1 + ROUNDING)


class Block:
    """Some vectors, the cluster of each, and one heap a cluster of (filed gap, place)."""

    def __init__(self, vectors: np.ndarray, owner: np.ndarray, heaps: list[list[tuple[float, int]]]):
        self.vectors, self.owner, self.heaps = vectors, owner, heaps
        self.popped = 0

    @classmethod
    def fresh(cls, vectors: np.ndarray, k: int) -> Block:
        """Nothing is known yet: every gap has expired."""
        heaps = [[(-np.inf, i) for i in range(len(vectors))], *[[] for _ in range(k - 1)]]
        return cls(vectors, np.full(len(vectors), -1, dtype=np.int32), heaps)

    def expired(self, drift: np.ndarray) -> list[int]:
        out = []
        for heap, limit in zip(self.heaps, (drift * (1 + ROUNDING)).tolist()):
            while heap and heap[0][0] <= limit:
                out.append(heapq.heappop(heap)[1])
        return out

    def step(self, centroids: np.ndarray, drift: np.ndarray) -> np.ndarray:
        """Rescan what has expired; what it adds to the sums and, last, the counts of the clusters."""
        k, size = centroids.shape
        sums = np.zeros((k, size + 1), dtype=np.int64)
        places = np.array(self.expired(drift), dtype=np.int64)
        self.popped = len(places)
        if not len(places):
            return sums
        x = self.vectors[places].astype(np.int64)
        far = squared(x, centroids)
        near = far.argmin(1)
        own = np.sqrt(far[np.arange(len(x)), near].astype(np.float64))
        far[np.arange(len(x)), near] = np.iinfo(np.int64).max
        other = np.sqrt(far.min(1).astype(np.float64)) if k > 1 else np.full(len(x), np.inf)
        gap = other - own - ROUNDING * (np.where(np.isinf(other), 0, other) + own + 1)
        for filed, to, place in zip((gap + drift[near]).tolist(), near.tolist(), places.tolist()):
            heapq.heappush(self.heaps[to], (filed, place))
        before = self.owner[places]
        moved = before != near
        whole = np.hstack([x, np.ones((len(x), 1), dtype=np.int64)])[moved]
        np.add.at(sums, near[moved], whole)
        had = before[moved] >= 0
        np.subtract.at(sums, before[moved][had], whole[had])
        self.owner[places] = near
        return sums

    def row(self, ids: list, sums: np.ndarray) -> dict:
        entries = [entry for heap in self.heaps for entry in heap]
        return {
            "ids": ids,
            "vectors": self.vectors.astype(np.int32).tobytes(),
            "owner": self.owner.astype(np.int32).tobytes(),
            "filed": np.array([e[0] for e in entries], dtype=np.float64).tobytes(),
            "places": np.array([e[1] for e in entries], dtype=np.int32).tobytes(),
            "ends": np.cumsum([len(heap) for heap in self.heaps]).astype(np.int32).tobytes(),
            "sums": sums.tobytes(),
        }

    @classmethod
    def of(cls, row: dict, size: int) -> Block:
        filed = np.frombuffer(row["filed"], dtype=np.float64).tolist()
        places = np.frombuffer(row["places"], dtype=np.int32).tolist()
        entries = list(zip(filed, places))
        ends = np.frombuffer(row["ends"], dtype=np.int32).tolist()
        heaps = [entries[a:b] for a, b in zip([0, *ends], ends)]
        owner = np.frombuffer(row["owner"], dtype=np.int32).copy()
        return cls(np.frombuffer(row["vectors"], dtype=np.int32).reshape(-1, size), owner, heaps)


_KINDS = pa.schema(
    [("ids", pa.list_(pa.int64()))]
    + [(n, pa.binary()) for n in ("vectors", "owner", "filed", "places", "ends", "sums")]
)


def _first_blocks(vectors: DataFrame, centroids: np.ndarray) -> DataFrame:
    def build(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        k, size = centroids.shape
        for batch in batches:
            for start in range(0, batch.num_rows, BLOCK):
                part = batch.slice(start, BLOCK)
                values = part["vector"].flatten().to_numpy(zero_copy_only=False).reshape(-1, size)
                block = Block.fresh(scaled(values), k)
                sums = block.step(centroids, np.zeros(k))
                yield pa.RecordBatch.from_pylist([block.row(part["vec_id"].to_pylist(), sums)], schema=_KINDS)

    return vectors.select(F.col("vec_id").cast("long").alias("vec_id"), "vector").mapInArrow(build, BLOCKS)


def _next_blocks(blocks: DataFrame, centroids: np.ndarray, drift: np.ndarray) -> DataFrame:
    def turn(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for i in range(batch.num_rows):
                row = batch.slice(i, 1).to_pylist()[0]
                block = Block.of(row, centroids.shape[1])
                sums = block.step(centroids, drift)
                yield pa.RecordBatch.from_pylist([block.row(row["ids"], sums)], schema=_KINDS)

    return blocks.mapInArrow(turn, BLOCKS)


def _added(blocks: DataFrame, shape: tuple[int, int]) -> np.ndarray:
    """What the blocks add to the sums of all clusters: one number for each component and count."""

    def add_up(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros(shape[0] * shape[1], dtype=np.int64)
        for batch in batches:
            for sums in batch["sums"].to_pylist():
                total += np.frombuffer(sums, dtype=np.int64)
        at = np.flatnonzero(total)
        yield pa.RecordBatch.from_arrays([pa.array(at, pa.int64()), pa.array(total[at])], names=["place", "total"])

    parts = blocks.select("sums").mapInArrow(add_up, "place long, total long")
    out = np.zeros(shape[0] * shape[1], dtype=np.int64)
    for r in parts.groupBy("place").agg(F.sum("total").alias("total")).collect():
        out[r["place"]] = r["total"]
    return out.reshape(shape)


def _members(blocks: DataFrame, centroids: np.ndarray) -> DataFrame:
    def emit(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for ids, vectors, owner in zip(*(batch[c].to_pylist() for c in ("ids", "vectors", "owner"))):
                x = np.frombuffer(vectors, dtype=np.int32).reshape(len(ids), -1).astype(np.int64)
                own = np.frombuffer(owner, dtype=np.int32)
                distance = ((x - centroids[own]) ** 2).sum(1)
                yield pa.RecordBatch.from_arrays(
                    [pa.array(ids, pa.int64()), pa.array(own), pa.array(distance)], names=["vec_id", "cluster", "distance"]
                )

    return blocks.select("ids", "vectors", "owner").mapInArrow(emit, "vec_id long, cluster int, distance long")


def _digest(centroid: np.ndarray) -> str:
    return hashlib.sha256(",".join(map(str, centroid.tolist())).encode()).hexdigest()


def clustered(
    vectors: DataFrame,
    k: int = 40,
    rounds: int = 5,
    size: int = 64,
    salt: str = "2:",
    id_column: str = "vec_id",
    vector_column: str = "embedding",
) -> DataFrame:
    """Cluster and squared distance of every kept vector, with its cluster's and the whole inertia."""
    spark = vectors.sparkSession
    let_workers_import(spark)
    own = kept(vectors, size, id_column, vector_column)
    centroids = seeds(own, k, salt)
    if not len(centroids):
        empty = "vec_id long, cluster int, distance long, cluster_inertia long, inertia long, centroid_sha256 string"
        return spark.createDataFrame([], empty)
    folder = work_folder(spark)
    drift = np.zeros(len(centroids))
    sums = np.zeros((len(centroids), size + 1), dtype=np.int64)
    blocks = written(_first_blocks(own, centroids), f"{folder}/0")
    for turn in range(1, rounds + 1):
        sums += _added(blocks, sums.shape)
        moved = centroids.copy()
        full = sums[:, -1] > 0
        moved[full] = sums[full, :-1] // sums[full, -1:]
        if (moved == centroids).all():
            break  # the same centroids give the same clusters
        drift = drift + shrinkage(centroids, moved)
        centroids = moved
        blocks = written(_next_blocks(blocks, centroids, drift), f"{folder}/{turn}")
        deleted(spark, f"{folder}/{turn - 1}")
    members = stored(_members(blocks, centroids))
    deleted(spark, folder)
    # One row a cluster, so what is collected and sent is bounded by k.
    inertia = dict(members.groupBy("cluster").agg(F.sum("distance")).collect())
    rows = [(i, own, sum(inertia.values()), _digest(centroids[i])) for i, own in sorted(inertia.items())]
    clusters = spark.createDataFrame(rows, "cluster int, cluster_inertia long, inertia long, centroid_sha256 string")
    return members.join(F.broadcast(clusters), "cluster").select(
        "vec_id", "cluster", "distance", "cluster_inertia", "inertia", "centroid_sha256"
    )
