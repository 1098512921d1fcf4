import hashlib
import random

import numpy as np
import public_tokenizers
from tokenizers import Tokenizer

from folium.llm import bpe
from helpers import ODD, documents

PATH = public_tokenizers.path("word_bpe_49k.json")
LIBRARY = Tokenizer.from_file(PATH)
TEXTS = [
    "Don't I'LL we've x's", "a\x1cb c\x1f", "<|endoftext|> x<|startoftext|>y <|ENDOFTEXT|>", "ΑΣ ΣΑΣ İstanbul ﬁ ǅ é ́x",
    "日本語 漢字 한국어 😀👍🏽 12½²", "a" * 500 + " " + "ab" * 300 + " " + "é" * 200, " x\u2009y\u200bz q\ufeff", "#" * 300, "ẞ ſ K Å",
]


def test_equals_the_library():
    rng = random.Random(1)
    noise = ["".join(rng.choice("abcdeEé'st \n<|>12#$ßΣİ́\x1d漢😀_-") for _ in range(rng.randrange(80))) for _ in range(1500)]
    own = bpe.vocabulary(PATH)
    for text in [*TEXTS, *[t or "" for t in ODD], *noise]:
        ids = LIBRARY.encode(text, add_special_tokens=False).ids
        packed = own.encode(text)
        assert np.frombuffer(packed, "<u4").tolist() == ids
        assert own.decode(packed) == LIBRARY.decode(ids, skip_special_tokens=False)


def test_scan_and_heap_agree():
    own, rng = bpe.vocabulary(PATH), random.Random(2)
    for _ in range(300):
        word = "".join(rng.choice("aaabthein") for _ in range(rng.randrange(1, 90)))
        data = word.encode()
        parts = [own.inner[b] for b in data[:-1]] + [own.last[data[-1]]]
        assert own._scanned(parts[:]) == own._heaped(parts[:])


def test_forgetting_changes_nothing(monkeypatch):
    own = bpe.WordBpe(PATH)
    whole = [own.encode(t) for t in TEXTS]
    monkeypatch.setattr(bpe, "REMEMBERED", 2)
    assert [own.encode(t) for t in TEXTS] == whole


def test_frames(spark):
    docs = documents(spark, [*ODD, (None, "no id"), (3, "again")])
    rows = bpe.digests(docs, PATH).collect()
    assert len(rows) == docs.count()
    want = sorted(
        hashlib.sha256(np.array(LIBRARY.encode(t or "", add_special_tokens=False).ids, dtype="<u4").tobytes()).hexdigest()
        for t in [*ODD, "no id", "again"]
    )
    assert sorted(r["ids_sha256"] for r in rows) == want
    back = bpe.decoded(bpe.encoded(docs, PATH), PATH).where("doc_id = 7").first()["text"]
    assert back == LIBRARY.decode(LIBRARY.encode(ODD[7]).ids)


def test_idle_workers_remember_nothing(spark):
    """Workers outlive the task; what they remembered would be missing to the next stage."""
    docs = documents(spark, [f"word{i} other{i}" for i in range(400)]).repartition(8)
    assert bpe.digests(docs, PATH).where("n_tokens > 0").count() == 400

    def left(batches):
        import pyarrow as pa

        for _ in batches:
            yield pa.RecordBatch.from_arrays([pa.array([len(bpe.vocabulary(PATH).known)], pa.int64())], names=["n"])

    found = docs.select("doc_id").mapInArrow(left, "n long").collect()
    assert found and all(r["n"] == 0 for r in found)
