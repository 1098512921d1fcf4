import random
from collections import Counter
from itertools import combinations

import numpy as np
import pytest

from folium.llm import decontaminate as D
from helpers import ODD, documents, frame, prose

ITEM = "item_id long, text string, extra string"


def test_masks_hit_every_allowed_substitution():
    words = np.arange(1, D.STRETCH + 1, dtype=np.uint64) * np.uint64(7919)
    for k in range(D.CHANGED + 1):
        for places in combinations(range(D.STRETCH), k):
            other = words.copy()
            other[list(places)] += np.uint64(1)
            assert any((D.seeds(words, m) == D.seeds(other, m)).any() for m in D.MASKS), places
    for n in range(D.LEAST, D.STRETCH):
        for place in range(n) if D.allowed(n) else [None]:
            other = words[:n].copy()
            if place is not None:
                other[place] += np.uint64(1)
            assert any((D.seeds(words[:n], m) == D.seeds(other, m)).any() for m in D.item_masks(n))


def cases(spark):
    item = [f"q{i}" for i in range(30)]
    changed = item[:]
    changed[4] = changed[10] = changed[20] = "other"
    texts = [
        prose(1, 80) + " " + " ".join(item).upper() + "! " + prose(2, 50),
        "x " + ", ".join(changed) + " y",
        " ".join(item[5:18]),
        " ".join(item[5:17]),
        " ".join(w if i % 4 else "no" for i, w in enumerate(item)),
        prose(3, 300),
        "one two three four five six",
        "one two three four six",
        *ODD,
        (None, " ".join(item)),
        (0, " ".join(item)),
    ]
    items = [(7, " ".join(item), "e"), (8, "One two three four five six.", "e"), (9, None, ""), (10, "a", ""), (7, " ".join(item), "e")]
    return documents(spark, texts), spark.createDataFrame(items, ITEM)


@pytest.mark.parametrize("sent", [D.SENT, 0])
def test_planted_overlaps(spark, monkeypatch, sent):
    monkeypatch.setattr(D, "SENT", sent)
    docs, items = cases(spark)
    got = {(r["doc_id"], r["item_id"]): r["matched_words"] for r in D.leaks(docs, items).collect()}
    assert got == {(0, 7): 30, (1, 7): 27, (2, 7): 13, (6, 8): 6, (None, 7): 30}
    kept = D.clean(docs, items)
    assert kept.columns == docs.columns
    assert sorted(r["doc_id"] for r in kept.collect()) == [3, 4, 5, 7, *range(8, 8 + len(ODD))]


def plain(text):
    cut = ".,;:!?\"'()[]{}<>*_-`/\\|#$%&~^+=@"
    return [w for w in (x.strip(cut) for x in (text or "").lower().split()) if w]


def holds(text, item):
    """Whether a text holds an item, by trying every place of both."""
    doc, item = plain(text), plain(item)
    n = len(item)
    if n < D.LEAST:
        return n > 1 and doc == item
    length = min(n, D.STRETCH)
    return any(
        sum(x != y for x, y in zip(doc[i : i + length], item[j : j + length])) <= D.allowed(n)
        for i in range(len(doc) - length + 1)
        for j in range(n - length + 1)
    )


@pytest.mark.parametrize("sent", [D.SENT, 0])
def test_equals_exhaustive_search(spark, monkeypatch, sent):
    monkeypatch.setattr(D, "SENT", sent)
    rng = random.Random(11)
    items = [(i % 37, " ".join(f"t{rng.randrange(12)}" for _ in range(rng.choice([1, 2, 3, 4, 5, 7, 9, 12, 13, 16, 30])))) for i in range(44)]
    items += [(None, "capital of France"), (3, None), (4, "")]
    rows = []
    for k in range(160):
        words = [f"t{rng.randrange(12)}" for _ in range(rng.randrange(4, 25))]
        if k % 2:
            words = (rng.choice(items)[1] or "").split()
            words = [w if rng.random() > 0.1 else "other" for w in words]
            words = prose(k, rng.randrange(12)).split() + words + prose(k + 500, rng.randrange(12)).split()
        # A third of the rows share an id, another third have none.
        rows.append(((None, 5, k)[k % 3], " ".join(words)))
    rows += [(None, "Capital of France!"), (5, "the capital of France"), (5, "clean"), (5, "clean"), (None, "clean")]
    docs = frame(spark, [(i, t, n) for n, (i, t) in enumerate(rows)], "doc_id long, text string, _row int")
    benchmark = spark.createDataFrame([(i, t, "e") for i, t in items], ITEM)
    want = {(d, i) for d, text in rows for i, item in items if holds(text, item)}
    assert len(want) > 30 and (None, None) in want
    got = D.leaks(docs, benchmark)
    assert {(r["doc_id"], r["item_id"]) for r in got.collect()} == want
    kept = D.clean(docs, benchmark)
    assert kept.columns == docs.columns
    stays = Counter((d, text, n) for n, (d, text) in enumerate(rows) if not any(holds(text, item) for _, item in items))
    assert Counter(map(tuple, kept.collect())) == stays and len(stays) > 20


def test_sent_and_joined_overlaps_are_the_same(spark, monkeypatch):
    docs, items = cases(spark)
    one_pass = sorted(map(str, D.leaks(docs, items).collect()))
    monkeypatch.setattr(D, "SENT", 0)
    assert sorted(map(str, D.leaks(docs, items).collect())) == one_pass
    assert D.leaks(docs.limit(0), items).count() == 0 and D.clean(docs, items.limit(0)).count() == docs.count()
