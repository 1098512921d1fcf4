import random
import zlib

import numpy as np
import public_tokenizers
import pyarrow as pa
from tokenizers import Tokenizer

from folium.llm import token_grammar as G
from helpers import ODD, documents, prose

PATH = public_tokenizers.path("byte_bpe_50k.json")
LIBRARY = Tokenizer.from_file(PATH)


def test_cached_tokenizer_equals_the_library(monkeypatch):
    monkeypatch.setattr(G, "REMEMBERED", 40)
    own, rng = G.CachedTokenizer(PATH), random.Random(1)
    texts = ["a  b", "a \n b\n\nc", " x", "x ", "\n", "\t a\tb", "<|endoftext|> a <|endoftext|>b c", "a\xa0 b", "x\x1c y", "It's, you. 1.", "ª º"]
    texts += ["".join(rng.choice("abé's t \n<|>.,12#\t\xa0漢") for _ in range(rng.randrange(50))) for _ in range(2000)]
    for text in [*texts, *[t or "" for t in ODD]]:
        assert own.encode(text).tolist() == LIBRARY.encode(text, add_special_tokens=False).ids


def test_texts_at_once_equal_the_library(monkeypatch):
    monkeypatch.setattr(G, "PORTION", 300)
    monkeypatch.setattr(G, "AT_ONCE", 3)
    rng = random.Random(4)
    words = ["it", "It's", "don't.", "été", "ß!", "漢字。", "a1,", "(x)", "end.\"", "<|endoftext|>", "...", "'s", "l'", "e\u0301,", "ǅ", ""]
    texts = [rng.choice(" \n").join(rng.choice(words) for _ in range(rng.randrange(30))) for _ in range(600)]
    texts += ["".join(rng.choice([*words, " ", "\n", "  ", "\t"]) for _ in range(20)) for _ in range(600)]
    batch = pa.RecordBatch.from_pydict({"text": pa.array([None, "", *texts, *ODD], pa.string())}).slice(1)
    own, parts = G.CachedTokenizer(PATH), list(G._portions(batch))
    assert len(parts) > 50 and sum(p.num_rows for p in parts) == batch.num_rows
    got = [x.tolist() for p in parts for x in own.encode_all(p["text"])]
    assert got == [LIBRARY.encode(t or "", add_special_tokens=False).ids for t in batch["text"].to_pylist()]


def test_a_word_goes_to_the_model_once_whatever_marks_follow(monkeypatch):
    own, asked = G.CachedTokenizer(PATH), []
    model = own._words
    monkeypatch.setattr(own, "_words", lambda words: asked.extend(words) or model(words))
    for text in ("a word. word, word; word\nword! word... word\nword?", "a word: word"):
        assert own.encode(text).tolist() == LIBRARY.encode(text, add_special_tokens=False).ids
    assert sorted(asked) == [" word", "a", "word"]


def test_compression_round_trip_and_random_access():
    rng = np.random.default_rng(1)
    docs = [np.append(rng.integers(0, 6, n), 2).astype("<u4") for n in (0, 1, 700, 3000, 0, 5000)] + [np.full(999, 7, "<u4")]
    row = G._row(0, 0, list(enumerate(docs)), 50257).to_pylist()[0]
    shard = G.Shard(row)
    assert len(shard.rules) and len(shard.symbols) < 0.6 * sum(map(len, docs))
    for i, doc in enumerate(docs):
        assert (shard.document(i) == doc).all()
        for _ in range(20):
            a = int(rng.integers(0, len(doc)))
            b = int(rng.integers(a, len(doc))) + 1
            assert (shard.ids(i, a, b) == doc[a:b]).all()
    for k, (left, right) in enumerate(shard.rules):
        assert shard.lengths[k] == len(G.expand(np.array([left, right]), shard.rules, shard.base))


def test_rounds_go_on_until_no_pair_is_frequent():
    rng = np.random.default_rng(2)
    passage, pairs = rng.integers(0, 50000, 400), [(60000 + i, 60500 + i) for i in range(50)]
    docs = [np.append(passage, 2).astype("<u4")] * 600 + [np.append(np.full(4096, 7), 2).astype("<u4")]
    docs += [np.append(np.tile(p, (20, 1)) + np.array([[0, 0]] * 20), 2).astype("<u4") for p in pairs]
    docs.append(np.append(np.tile((9, 11), 40000), 2).astype("<u4"))
    shard = G.Shard(G._row(0, 0, list(enumerate(docs)), 70000).to_pylist()[0])
    for i, doc in enumerate(docs):
        assert (shard.document(i) == doc).all()
    # Whole documents become a few symbols, not an eighth of their ids.
    assert len(shard.symbols) < 4000
    starts = shard.starts
    seen = {}
    for i in range(len(docs)):
        part, k = shard.symbols[starts[i] : starts[i + 1]].tolist(), 0
        while k < len(part) - 1:
            pair = (part[k], part[k + 1])
            seen[pair] = seen.get(pair, 0) + 1
            # Of three equal symbols only one pair counts.
            k += 2 if part[k] == part[k + 1] and part[k + 1 : k + 3] == [part[k]] * 2 else 1
    assert max(seen.values()) < G.LEAST


def _counts(symbols, last):
    """How often each pair occurs without overlap."""
    seen, k = {}, 0
    while k < len(symbols) - 1:
        if not last[k]:
            pair = symbols[k], symbols[k + 1]
            seen[pair] = seen.get(pair, 0) + 1
            if len({*pair}) == 1 and not last[k + 1] and symbols[k + 2] == pair[0]:
                k += 1
        k += 1
    return seen


def test_no_pair_stays_frequent_whatever_the_symbols():
    rng = np.random.default_rng(5)
    for trial in range(60):
        ids = rng.integers(0, [2, 3, 9, 300][trial % 4], 3000).astype("<u4")
        if trial % 3 == 0:
            ids = np.tile(ids[:70], 40)
        ends = rng.random(len(ids)) < [0.3, 0.01, 0][trial % 3]
        ends[-1] = True
        base = [300, 1 << 31][trial % 2]
        symbols, last, rules, lengths = G.compress(ids, ends, base)
        assert max(_counts(symbols.tolist(), last.tolist()).values(), default=0) < G.LEAST
        assert (G.expand(symbols, rules, base) == ids).all()
        if base == 300:
            assert (G.expand_all(symbols, rules, lengths, base) == ids).all()
        sizes = np.where(symbols < base, 1, np.append(lengths, 1)[np.where(symbols < base, -1, symbols.astype(np.int64) - base)])
        assert (np.cumsum(sizes)[last] - 1 == np.flatnonzero(ends)).all()


def test_later_rounds_count_only_what_may_have_become_frequent(monkeypatch):
    # A passage of 1,024 ids is named in ten rounds or more; the rest of the shard lies still.
    rng = np.random.default_rng(6)
    passage, rest = rng.integers(0, 50000, 1024), rng.integers(0, 50000, 200_000)
    ids = np.concatenate([rest, np.tile(np.append(passage, 2), 20)]).astype("<u4")
    counted, in_order = [], G._in_order
    monkeypatch.setattr(G, "_in_order", lambda keys, bits: counted.append(len(keys)) or in_order(keys, bits))
    symbols, _, rules, _ = G.compress(ids, np.arange(len(ids)) == len(ids) - 1, 50257)
    assert (G.expand(symbols, rules, 50257) == ids).all() and len(symbols) < len(rest) + 100
    assert len(counted) > 10 and sum(counted) < 1.5 * len(ids)


def test_keys_in_order_whether_they_leave_room_for_places_or_not():
    rng = np.random.default_rng(7)
    for bits in (20, 34, 62):
        keys = rng.integers(0, 40, 500).astype(np.uint64) << np.uint64(bits - 6)
        got, order = G._in_order(keys, bits)
        assert (order == np.argsort(keys, kind="stable")).all() and (got == keys[order]).all()


def test_symbols_of_every_width():
    for width in (2, 3, 4):
        values = np.array([0, 1, 255, 256, (1 << 8 * width) - 1], dtype=np.uint32)
        assert len(G.packed(values, width)) == 5 * width
        assert (G.unpacked(G.packed(values, width), width) == values).all()


def test_frames_equal_brute_force(spark, monkeypatch):
    texts = [*ODD, *[prose(i, 300) for i in range(40)], (5, "same id"), (None, "no id")]
    docs = documents(spark, texts)
    monkeypatch.setattr(G, "SHARD", 2000)
    got = G.digests(docs, PATH, 2).collect()
    rows = sorted(
        ((r["doc_id"], r["text"]) for r in docs.collect()),
        key=lambda r: (r[0] is not None, r[0] or 0, r[1] is not None, r[1] or ""),
    )
    start, want = 0, []
    for doc_id, text in rows:
        ids = np.array(LIBRARY.encode(text or "", add_special_tokens=False).ids + [2], dtype="<u4")
        want.append((doc_id, start, len(ids), zlib.crc32(ids.tobytes())))
        start += len(ids)
    assert sorted(map(tuple, got), key=lambda r: r[1]) == want
