"""Heap-bounded k-means against plain rounds over all vectors."""

import hashlib
import math

import numpy as np
import pytest

from folium.llm import heap_kmeans

SCHEMA = "vec_id long, embedding array<double>, cluster string, label int"


def frame(spark, rows):
    return spark.createDataFrame([(i, v, "theirs", None) for i, v in rows], SCHEMA).repartition(3)


def brute(rows, k, rounds, size):
    rows = [(i, v) for i, v in rows if v is not None and len(v) == size and all(x is not None and math.isfinite(x) for x in v)]
    key = lambda r: (r[0] is None, hashlib.sha256(f"2:{r[0]}".encode()).hexdigest() if r[0] is not None else "", r[1])
    ints = lambda v: [min(max(math.floor(256 * x), -(2**27)), 2**27) for x in v]
    centroids = [ints(v) for _, v in sorted(rows, key=key)[:k]]
    own = [ints(v) for _, v in rows]
    for turn in range(rounds + 1):
        far = [[sum((a - b) ** 2 for a, b in zip(v, c)) for c in centroids] for v in own]
        near = [f.index(min(f)) for f in far]
        if turn < rounds:
            for j in range(len(centroids)):
                if held := [v for v, c in zip(own, near) if c == j]:
                    centroids[j] = [sum(x) // len(held) for x in zip(*held)]
    digest = [hashlib.sha256(",".join(map(str, c)).encode()).hexdigest() for c in centroids]
    distance = [f[c] for f, c in zip(far, near)]
    of = lambda j: sum(d for d, c in zip(distance, near) if c == j)
    return [(i, c, d, of(c), sum(distance), digest[c]) for (i, _), c, d in zip(rows, near, distance)]


def ordered(rows):
    return sorted(map(tuple, rows), key=lambda r: (r[0] is None, r[0] or 0, r[1:]))


def vectors(seed, n, size, spread=0.05, around=6):
    rng = np.random.default_rng(seed)
    middle = rng.normal(size=(around, size))
    return [(i, (middle[i % around] + spread * rng.normal(size=size)).tolist()) for i in range(n)]


@pytest.mark.parametrize("seed,k,spread", [(1, 6, 0.05), (2, 9, 0.6), (3, 1, 0.3), (4, 5, 3.0)])
def test_equals_plain_rounds(spark, monkeypatch, seed, k, spread):
    monkeypatch.setattr(heap_kmeans, "BLOCK", 16)
    rows = vectors(seed, 150, 5, spread)
    rows += rows[:40] + [(900 + i, rows[7][1]) for i in range(60)]  # copies of rows and of a vector
    got = heap_kmeans.clustered(frame(spark, rows), k=k, rounds=4, size=5).collect()
    assert ordered(got) == ordered(brute(rows, k, 4, 5))


def test_odd_vectors(spark):
    rows = vectors(5, 12, 4)
    rows += [(None, [0.5] * 4), (None, [0.25] * 4), (50, None), (51, [1.0] * 3), (52, [1.0] * 5), (53, [])]
    rows += [(54, [float("nan"), 0.0, 0.0, 0.0]), (55, [float("inf"), 0.0, 0.0, 0.0]), (56, [None, 0.0, 0.0, 0.0])]
    rows += [(57, [1e6, -1e6, 0.0, 0.0]), (58, [-0.001] * 4)]
    got = heap_kmeans.clustered(frame(spark, rows), k=4, rounds=3, size=4).collect()
    assert ordered(got) == ordered(brute(rows, 4, 3, 4))
    # Fewer vectors than centroids.
    few = rows[:3]
    got = heap_kmeans.clustered(frame(spark, few), k=40, rounds=5, size=4).collect()
    assert ordered(got) == ordered(brute(few, 40, 5, 4))
    assert heap_kmeans.clustered(frame(spark, []), k=4, size=4).count() == 0


def test_ties_go_to_the_smaller_number():
    far = heap_kmeans.squared(np.array([[0, 0], [4, 0]]), np.array([[2, 0], [-2, 0], [2, 0]]))
    assert far.tolist() == [[4, 4, 4], [4, 36, 4]]
    block = heap_kmeans.Block.fresh(np.array([[0, 0], [4, 0]], dtype=np.int32), 3)
    block.step(np.array([[2, 0], [-2, 0], [2, 0]]), np.zeros(3))
    assert block.owner.tolist() == [0, 0]


def test_large_components_are_exact():
    big = np.array([[2**27, -(2**27)], [2**27 - 1, 5]])
    exact = [[sum((int(a) - int(b)) ** 2 for a, b in zip(x, c)) for c in big] for x in big]
    assert heap_kmeans.squared(big, big).tolist() == exact


def test_only_expired_gaps_are_rescanned():
    rng = np.random.default_rng(7)
    middle = 1000 * rng.normal(size=(5, 8))
    points = np.repeat(middle, 200, axis=0) + rng.normal(size=(1000, 8))
    points = points.astype(np.int32)
    block = heap_kmeans.Block.fresh(points, 5)
    centroids = middle.astype(np.int64)
    block.step(centroids, np.zeros(5))
    assert block.popped == 1000
    moved = centroids + 1
    drift = heap_kmeans.shrinkage(centroids, moved)
    block.step(moved, drift)
    assert block.popped == 0
    # The heaps survive being written and read, and a long drift expires them all.
    again = heap_kmeans.Block.of(block.row(list(range(1000)), np.zeros((5, 9), dtype=np.int64)), 8)
    assert again.heaps == block.heaps and all(h == sorted(h) for h in map(sorted, again.heaps))
    again.step(moved, drift + 1e6)
    assert again.popped == 1000
