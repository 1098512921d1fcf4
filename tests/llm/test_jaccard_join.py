import random
import re
from itertools import combinations

import pytest

from folium.llm import jaccard_join as J
from helpers import ODD, documents, frame, prose


def brute(rows):
    """(shingles, component) by id, from the definition."""
    sets = {}
    for i, text in rows:
        text = (text or "").translate(str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"))
        w = re.findall(r"[^\x20\x09-\x0D]+", text)
        sets[i] = {tuple(w[k : k + 5]) for k in range(max(len(w) - 4, 1))} if w else set()
    root = {i: i for i in sets}

    def find(i):
        while root[i] != i:
            i = root[i]
        return i

    for a, b in combinations(sorted(sets), 2):
        if sets[a] and sets[b] and 100 * len(sets[a] & sets[b]) >= 80 * len(sets[a] | sets[b]):
            x, y = find(a), find(b)
            root[max(x, y)] = min(x, y)
    return {i: (len(s), find(i)) for i, s in sets.items()}


def edited(text, rng, share):
    return " ".join(f"e{rng.randrange(10**9)}" if rng.random() < share else w for w in text.split())


def corpus(seed):
    """Copies, near copies around the limit, chains, shared passages and boilerplate."""
    rng = random.Random(seed)
    texts = list(ODD)
    passage, line = prose(seed, 60), prose(seed + 1, 12)
    for k in range(6):
        base = prose(100 * seed + k, rng.randrange(30, 160))
        texts += [base, base.upper(), base] + [edited(base, rng, s) for s in (0.005, 0.01, 0.02, 0.03, 0.04)] * 3
        chain = base
        for _ in range(6):
            chain = edited(chain, rng, 0.012)
            texts.append(chain)
    for k in range(30):
        own = prose(9000 + 100 * seed + k, rng.randrange(5, 60))
        texts += [own + " " + passage, line + " " + own, passage + " " + line + f" v{k % 3}"]
    texts += ["a b c", "a b c", "A B c", "a b c d", "a b c d e", "a b c d e"]
    rng.shuffle(texts)
    return texts


@pytest.mark.parametrize("seed", [1, 2])
@pytest.mark.parametrize("few, rounds, slices", [(64, 12, 1024), (0, 2, 3), (3, 12, 2), (16, 1, 1024)])
def test_equals_brute_force(spark, monkeypatch, seed, few, rounds, slices):
    monkeypatch.setattr(J, "FEW", few)
    monkeypatch.setattr(J, "SLICE", slices)
    monkeypatch.setattr(J, "ROUNDS", rounds)
    texts = corpus(seed)
    want = brute(list(enumerate(texts)))
    got = {r["doc_id"]: (r["n_shingles"], r["component_id"]) for r in J.joined(documents(spark, texts)).collect()}
    assert got == want


def test_ids_sent_or_joined_alike(spark, monkeypatch):
    docs = documents(spark, corpus(3))
    whole = sorted(map(tuple, J.joined(docs).collect()))
    monkeypatch.setattr(J, "SENT_IDS", -1)
    assert sorted(map(tuple, J.joined(docs).collect())) == whole


def test_null_and_repeated_ids(spark):
    text = prose(5, 50)
    docs = documents(spark, [(None, text), (4, text), (4, text), (9, text), (7, ""), (8, None)])
    got = sorted((r["doc_id"] or -1, r["component_id"]) for r in J.joined(docs).collect())
    assert got == [(-1, None), (4, 4), (4, 4), (7, 7), (8, 8), (9, 4)]
    assert sorted(r["doc_id"] or -1 for r in J.first_of_each(docs).collect()) == [-1, 4, 4, 7, 8]


def test_repeated_rows_lose_no_links(spark):
    rng, rows = random.Random(7), []
    for k in range(8):
        base = prose(700 + k, 119)
        rows += [(10 * k, base), (10 * k + 1, edited(base, rng, 0.01))] * 2
    got = J.joined(documents(spark, rows)).collect()
    want = brute(rows)
    assert sorted(map(tuple, got)) == sorted((i, *want[i]) for i, _ in rows)
    assert sum(i != c for i, _, c in got) > 4


def test_an_id_with_several_texts_has_their_union(spark):
    a, b, c = prose(31, 80), prose(32, 80), prose(33, 80)
    # 5 and 6 hold a and b; 7 holds b alone, 8 a passage of neither; 9 has no words in one row.
    rows = [(5, a), (5, b), (6, b), (6, a), (6, a), (7, b), (8, c), (9, ""), (9, c), (3, ""), (3, None)]
    got = sorted(map(tuple, J.joined(documents(spark, rows)).collect()))
    assert got == sorted([(5, 152, 5)] * 2 + [(6, 152, 5)] * 3 + [(7, 76, 7), (8, 76, 8)] + [(9, 76, 8)] * 2 + [(3, 0, 3)] * 2)


def test_keeps_clashing_columns(spark):
    docs = frame(spark, [(1, "a b", 5, 6), (2, "a b", 7, 8)], "doc_id long, text string, rep int, component_id int")
    assert [tuple(r) for r in J.first_of_each(docs).collect()] == [(1, "a b", 5, 6)]


def test_window_meets_every_partner():
    for n in range(1, 400):
        e = n - -(-4 * n // 5)
        assert J.window(n) == e + 1
