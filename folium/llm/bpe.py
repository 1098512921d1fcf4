"""Byte-pair encoding and decoding with a given vocabulary, equal to the public library.

A word of up to ``SHORT`` symbols is merged in a contiguous rank array: one list holds
the starts of its parts, a parallel list the rank of each adjacent pair.  The lowest
rank is found by a scan, its right boundary deleted, and the two neighbouring ranks
looked up again.  Scanning is quadratic, so longer words use a heap over linked parts
with the same order of merges.

White space separates words in this vocabulary and is dropped, so a text is a sequence
of independent chunks.  Each task keeps the packed ids of the chunks it has met, in a
table of bounded size that is emptied when full and when the task ends: workers live on
idle, and their memory then is another stage's.

Defined cases: a null text counts as empty and gives no ids; rows repeat as they come.
"""

from __future__ import annotations

import heapq
import json
import re
import unicodedata
from collections.abc import Iterator
from contextlib import contextmanager
from functools import lru_cache
from hashlib import sha256

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

from folium.llm.common import sliced

#: Symbols of a word that is merged by scanning.
SHORT = 64
#: Chunks that a task remembers.
REMEMBERED = 400_000
NO_RANK = 1 << 60
#: White space of Python's split that the vocabulary's pattern doesn't count as such.
SEPARATORS = re.compile("[\x1c-\x1f]")


def byte_letters() -> list[str]:
    """The printable letter that stands for each byte in the vocabulary.

    Bytes that print as themselves keep their letter; the rest take the letters from
    256 on, in order.
    """
    plain = {*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)}
    rest = iter(range(0x100, 0x200))
    return [chr(b) if b in plain else chr(next(rest)) for b in range(256)]


class WordBpe:
    """A vocabulary file with word ends, read once a worker."""

    def __init__(self, path: str):
        import regex
        from tokenizers import Tokenizer

        with open(path, encoding="utf-8") as f:
            spec = json.load(f)
        model = spec["model"]
        self.vocab: dict[str, int] = model["vocab"]
        self.end: str = model["end_of_word_suffix"] or ""
        pairs = [tuple(m) if isinstance(m, list) else tuple(m.split(" ")) for m in model["merges"]]
        ids = self.vocab
        #: (left id, right id) -> (rank, id of the merged part)
        self.merges = {(ids[a], ids[b]): (rank, ids[a + b]) for rank, (a, b) in enumerate(pairs)}
        self.special = {x["content"]: x["id"] for x in spec["added_tokens"]}
        letters = byte_letters()
        self.inner = [ids.get(x) for x in letters]
        self.last = [ids.get(x + self.end) for x in letters]
        pattern = spec["pre_tokenizer"]["pretokenizers"][0]["pattern"]["Regex"]
        self.pieces = regex.compile(pattern)
        self.marks = re.compile("(" + "|".join(map(re.escape, self.special)) + ")") if self.special else None
        self.tokens = np.array(
            [t for t, _ in sorted({**self.vocab, **self.special}.items(), key=lambda x: x[1])], dtype=object
        )
        self.normalizer = Tokenizer.from_file(path).normalizer
        self.known: dict[str, bytes] = {}

    def normalized(self, text: str) -> str:
        """As the vocabulary's own normalizer; letters whose case depends on their place go to it."""
        if text.isascii():
            return text.lower()
        if unicodedata.is_normalized("NFC", text) and "İ" not in text and "Σ" not in text:
            return text.lower()
        return self.normalizer.normalize_str(text)

    def word(self, piece: str) -> list[int]:
        data = piece.encode()
        parts = [self.inner[b] for b in data[:-1]] + [self.last[data[-1]]]
        return self._scanned(parts) if len(parts) <= SHORT else self._heaped(parts)

    def _scanned(self, parts: list[int]) -> list[int]:
        merges, none = self.merges, (NO_RANK, 0)
        ranks = [merges.get(pair, none) for pair in zip(parts, parts[1:])]
        while ranks:
            best = min(ranks)
            if best is none:
                break
            i = ranks.index(best)
            parts[i] = best[1]
            del parts[i + 1], ranks[i]
            if i:
                ranks[i - 1] = merges.get((parts[i - 1], parts[i]), none)
            if i < len(ranks):
                ranks[i] = merges.get((parts[i], parts[i + 1]), none)
        return parts

    def _heaped(self, parts: list[int]) -> list[int]:
        n = len(parts)
        after, before = list(range(1, n + 1)), list(range(-1, n - 1))
        heap = []

        def offer(i: int) -> None:
            if i >= 0 and after[i] < n and (m := self.merges.get((parts[i], parts[after[i]]))):
                heapq.heappush(heap, (m[0], i, parts[i], parts[after[i]], m[1]))

        for i in range(n - 1):
            offer(i)
        while heap:
            _, i, left, right, merged = heapq.heappop(heap)
            j = after[i] if parts[i] is not None else n
            if j >= n or parts[i] != left or parts[j] != right:
                continue
            parts[i], parts[j] = merged, None
            after[i] = after[j]
            if after[i] < n:
                before[after[i]] = i
            offer(before[i])
            offer(i)
        return [p for p in parts if p is not None]

    def _chunk(self, chunk: str) -> bytes:
        ids: list[int] = []
        for section in self.marks.split(chunk) if self.marks and "<|" in chunk else (chunk,):
            if section in self.special:
                ids.append(self.special[section])
            else:
                for piece in self.pieces.findall(self.normalized(section)):
                    ids += self.word(piece)
        return np.array(ids, dtype="<u4").tobytes()

    def encode(self, text: str) -> bytes:
        """The ids of a text as little-endian unsigned 32-bit integers."""
        if SEPARATORS.search(text):
            chunks = [c for c in re.split(r"[^\S\x1c-\x1f]+", text) if c]
        else:
            chunks = text.split()
        known, out = self.known, []
        for chunk in chunks:
            ids = known.get(chunk)
            if ids is None:
                if len(known) >= REMEMBERED:
                    known.clear()
                ids = known[chunk] = self._chunk(chunk)
            out.append(ids)
        return b"".join(out)

    def decode(self, ids: bytes) -> str:
        """The library's text of ids: this vocabulary names no decoder, so parts stand apart."""
        return " ".join(self.tokens[np.frombuffer(ids, dtype="<u4")])


@lru_cache(maxsize=2)
def vocabulary(path: str) -> WordBpe:
    return WordBpe(path)


@contextmanager
def remembering(path: str) -> Iterator[WordBpe]:
    """The vocabulary, with the chunks it meets remembered until the task's rows end."""
    bpe = vocabulary(path)
    try:
        yield bpe
    finally:
        bpe.known.clear()


def encoded(docs: DataFrame, path: str) -> DataFrame:
    """doc_id and the packed ids of each text."""

    def encode(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        with remembering(path) as bpe:
            for batch in sliced(batches):
                ids = [bpe.encode(t or "") for t in batch["text"].to_pylist()]
                yield pa.RecordBatch.from_arrays([batch["doc_id"], pa.array(ids, pa.binary())], names=["doc_id", "ids"])

    return docs.select("doc_id", "text").mapInArrow(encode, "doc_id long, ids binary")


def decoded(rows: DataFrame, path: str) -> DataFrame:
    """doc_id and the text of packed ids."""

    def decode(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        bpe = vocabulary(path)
        for batch in batches:
            texts = [bpe.decode(x or b"") for x in batch["ids"].to_pylist()]
            yield pa.RecordBatch.from_arrays([batch["doc_id"], pa.array(texts, pa.string())], names=["doc_id", "text"])

    return rows.select("doc_id", "ids").mapInArrow(decode, "doc_id long, text string")


def digests(docs: DataFrame, path: str) -> DataFrame:
    """doc_id, n_tokens, ids_sha256, decoded_sha256: each text encoded, and its ids decoded again."""

    def row(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        with remembering(path) as bpe:
            for batch in sliced(batches):
                n, of_ids, of_text = [], [], []
                for text in batch["text"].to_pylist():
                    ids = bpe.encode(text or "")
                    n.append(len(ids) // 4)
                    of_ids.append(sha256(ids).hexdigest())
                    of_text.append(sha256(bpe.decode(ids).encode()).hexdigest())
                columns = [batch["doc_id"], pa.array(n, pa.int64()), pa.array(of_ids), pa.array(of_text)]
                yield pa.RecordBatch.from_arrays(columns, names=["doc_id", "n_tokens", "ids_sha256", "decoded_sha256"])

    return docs.select("doc_id", "text").mapInArrow(
        row, "doc_id long, n_tokens long, ids_sha256 string, decoded_sha256 string"
    )
