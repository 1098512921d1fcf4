"""Ranked search against scores reckoned document by document."""

import math
import random
import re
from collections import Counter

import pytest
from pyspark.sql import functions as F

from folium.llm import lexical_search
from helpers import ODD, documents, frame


def split(text):
    low = "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text or "")
    return re.findall(r"[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+", low)


def brute(docs, items, k=10):
    bags = [(d, Counter(split(t))) for d, t in docs if split(t)]
    n_docs, total = len(bags), sum(sum(b.values()) for _, b in bags)
    out = []
    for item_id, text in set(items):
        ranked = []
        for doc_id, bag in bags:
            m = 10 + (90 * sum(bag.values()) * n_docs) // total
            score = 0
            for term in set(split(text)) & set(bag):
                w = math.floor(1000 * math.log((2 * n_docs + 2) / (2 * sum(term in b for _, b in bags) + 1)))
                score += w * ((1_000_000_000 * bag[term]) // (1000 * bag[term] + 8 * m))
            if score > 0:
                ranked.append((-score, doc_id is None, doc_id or 0))
        out += [(item_id, i + 1, None if none else d, -s) for i, (s, none, d) in enumerate(sorted(ranked)[:k])]
    return out


def ordered(rows):
    return sorted(map(tuple, rows), key=lambda r: tuple((x is None, x or 0) for x in (r[0], r[1], r[3], r[2])))


def prose(rng, n, size):
    return " ".join(f"W{min(rng.randrange(size), rng.randrange(size))}" for _ in range(n))


@pytest.mark.parametrize("seed,block,cells", [(1, 1 << 18, 1 << 21), (2, 40, 300)])
def test_equals_brute_force(spark, monkeypatch, seed, block, cells):
    monkeypatch.setattr(lexical_search, "BLOCK", block)
    monkeypatch.setattr(lexical_search, "CELLS", cells)
    rng = random.Random(seed)
    docs = [(i, prose(rng, rng.randrange(1, 60), 80)) for i in range(300)]
    docs += [(1000 - i, "w1 w2 W3, same bag") for i in range(80)]  # a class larger than a ranking
    docs += [(2000 + i, "bag same w3-w2 w1") for i in range(40)]  # of the same class, other words between
    docs += [(5, "w1 w2"), (5, "w1 w2"), (None, "w1 w2"), (None, "w79 w78 w77")]
    items = [(i, prose(rng, 20, 90)) for i in range(12)] + [(3, "w1 w2 w3"), (3, "w1 w2 w3"), (None, "W5 w6"), (99, "w1"), (98, "unseen")]
    held = frame(spark, items, "item_id long, text string")
    got = lexical_search.search(documents(spark, docs).repartition(5), held).collect()
    assert ordered(got) == ordered(brute(docs, items))


def test_odd_texts(spark):
    docs = list(enumerate(ODD)) + [(50, "É é ß 漢字 [\\]^_`{|}~ a@b 0-9"), (51, "ÀB àb \x7f\x80x  y"), (None, None)]
    items = [(1, "a x É"), (2, "é 漢字 end"), (3, None), (4, ""), (5, " -- "), (6, "same TEXT here"), (7, "àb \x80x 0 9"), (8, "y  y")]
    rows = documents(spark, docs).withColumn("rank", F.lit("theirs")).withColumn("m", F.lit(1))
    held = frame(spark, items, "item_id long, text string").withColumn("doc_id", F.lit("theirs"))
    got = lexical_search.search(rows, held)
    assert got.columns == ["item_id", "rank", "doc_id", "score"]
    assert ordered(got.collect()) == ordered(brute(docs, items))


def test_nothing_to_rank(spark):
    none, items = documents(spark, []), frame(spark, [(1, "a")], "item_id long, text string")
    assert lexical_search.search(none, items).collect() == []
    assert lexical_search.search(documents(spark, [None, "", "--"]), items).collect() == []
    assert lexical_search.search(documents(spark, ["a"]), items.limit(0)).collect() == []


def test_equal_bags_are_one_class(spark):
    rows = [(i, 3, b"\x01\x00\x00\x00\x02\x00\x00\x00") for i in range(30, 0, -1)] + [(None, 3, b"\x01\x00\x00\x00\x02\x00\x00\x00")]
    rows += [(99, 400, b"\x01\x00\x00\x00\x02\x00\x00\x00"), (7, 3, b"\x01\x00\x00\x00\x01\x00\x00\x00"), (8, 3, b"")]
    bags = spark.createDataFrame(rows, "doc_id long, n long, bag binary")
    got = sorted((r["size"], r["members"]) for r in lexical_search.classes(bags, 34, 500, 3).collect())
    assert got == [(1, [7]), (1, [99]), (31, [1, 2, 3])]
