"""Token ids in grammar-compressed binary shards (Re-Pair).

Documents are dealt out by ranges of doc_id, tokenized, and cut into shards of whole
documents.  In each shard the frequent pairs of neighbouring symbols are replaced by
nonterminals, again and again, until no pair occurs ``LEAST`` times without overlap; pairs
never cross the end of a document.  Where chosen pairs overlap, the more frequent one is
replaced.  A shard's row holds

- ``symbols``: the compressed sequence, ``width`` bytes a symbol, little-endian;
- ``rules``: for each nonterminal, from ``base`` on, its two symbols (32 bits each);
- ``lengths``: for each nonterminal, how many ids it expands to (32 bits each);
- ``doc_ids``, ``doc_symbols``, ``doc_tokens``: per document (64 bits each; a null id is
  flagged in ``null_ids``).

so any document, or any range of its ids, is decoded without the rest of the shard.
Shards are rows of a Parquet table: Spark's own commit keeps them whole when tasks rerun.

Defined cases: a null or empty text is its end id alone; documents of one id stand in
order of their texts; null ids come first; an empty table gives no shard.
"""

from __future__ import annotations

import os
import re
import zlib
from array import array
from collections.abc import Iterator
from functools import lru_cache
from itertools import chain, compress as selected

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from folium.llm.bpe import byte_letters
from folium.session import stored

#: Ids of a shard, from which on it is closed; a longer document is a shard of its own.
SHARD = 1 << 20
#: A pair is replaced if it occurs at least so often.
LEAST = 12
#: Symbols of two bytes, and of three.
NARROW, MIDDLE = 1 << 16, 1 << 24
REMEMBERED = 500_000
CUT = re.compile(r"(?<=\S)(?= \S)")
#: White space at an end, next to other white space, or other than space and line end.
UNEVEN = (
    r"\A[ \n]|[ \n]\z|[ \n][ \n]|[\t\x0b\x0c\r\x1c-\x1f\x{85}\x{a0}\x{1680}"
    r"\x{2000}-\x{200a}\x{2028}\x{2029}\x{202f}\x{205f}\x{3000}]"
)
#: A word, with or without the space before it; marks right after it, at the end of a chunk.
#: The library's pattern has nothing to cut in either.
MARKS = "!\"#$%&'()*+,-./:;<=>?@[\\]^_`{|}~"
WORD, MARKED = r"\A ?\p{L}+\z", r"\A ?\p{L}+[!-/:-@\[-`{-~]+\z"
#: Bytes of text that are tokenized at a time, and words that the library gets at a time.
PORTION, AT_ONCE = 4 << 20, 50


class CachedTokenizer:
    """The tokenizers library over the distinct chunks of texts.

    Its pattern never joins a character with a space that follows it, so a text may be
    cut before a single space, and around a single line end, between other characters.
    Marks after a chunk's word are cut off too.  The ids of a word, marks or other chunk are
    remembered in two generations: when the younger one is full it becomes the older, and
    what is still in use moves over.
    """

    def __init__(self, path: str):
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        from tokenizers import Tokenizer
        from tokenizers.pre_tokenizers import CharDelimiterSplit

        self.library = Tokenizer.from_file(path)
        self.library.no_truncation()
        self.library.no_padding()
        self.vocabulary = self.library.get_vocab_size(with_added_tokens=True)
        #: The same model for words that are cut and spelt in its letters already.
        self.model = Tokenizer(self.library.model)
        self.model.pre_tokenizer = CharDelimiterSplit(" ")
        self.young: dict[str, bytes] = {}
        self.old: dict[str, bytes] = {}
        self.line_end = self._library(["\n"])[0]
        self.letters = dict(enumerate(byte_letters()))

    def _words(self, words: list[str]) -> list[bytes]:
        """Ids of words; a line end, which none of them has, parts them."""
        if not words:
            return []
        spelt = "\n".join(words).encode().decode("latin-1").translate(self.letters).split(self.letters[10])
        part = f" {self.letters[10]} "
        lines = [part.join(spelt[i : i + AT_ONCE]) + part for i in range(0, len(spelt), AT_ONCE)]
        found = self.model.encode_batch_fast(lines, add_special_tokens=False)
        ids = np.fromiter(chain.from_iterable(e.ids for e in found), dtype="<u4")
        ends = np.flatnonzero(ids == np.frombuffer(self.line_end, dtype="<u4")[0]) * 4
        data = ids.tobytes()
        return [data[a:b] for a, b in zip([0, *(ends[:-1] + 4).tolist()], ends.tolist())]

    def _library(self, chunks: list[str]) -> list[bytes]:
        found = self.library.encode_batch_fast(chunks, add_special_tokens=False)
        return [array("I", e.ids).tobytes() for e in found]

    def _new(self, chunks: list[str]) -> list[bytes]:
        alone = pc.match_substring_regex(pa.array(chunks, pa.string()), WORD).to_pylist()
        rest = [c for c, a in zip(chunks, alone) if not a]
        if not rest:
            return self._words(chunks)
        words, rest = iter(self._words([*selected(chunks, alone)])), iter(self._library(rest))
        return [next(words if a else rest) for a in alone]

    def _ids(self, chunks: list[str]) -> list[bytes]:
        ids = list(map(self.young.get, chunks))
        missing = [k for k, i in enumerate(ids) if i is None]
        if not missing:
            return ids
        wanted = [chunks[k] for k in missing]
        found = list(map(self.old.get, wanted))
        new = iter(self._new([c for c, i in zip(wanted, found) if i is None]))
        found = [next(new) if i is None else i for i in found]
        if len(self.young) + len(found) > REMEMBERED:
            self.old, self.young = self.young, {}
        self.young.update(zip(wanted, found))
        for k, i in zip(missing, found):
            ids[k] = i
        return ids

    def _joined(self, chunks: pa.Array, first: np.ndarray, lines: bool) -> list[np.ndarray]:
        """Ids of texts, from their chunks one after the other and where each text begins.

        lines: a chunk without a space before it has a line end there, but a text's first.
        Each distinct chunk is put together from that, its word and the marks after it.
        """
        coded = chunks.dictionary_encode()
        chunks, code = coded.dictionary, coded.indices.to_numpy()
        marked = pc.match_substring_regex(chunks, MARKED)
        words = pc.if_else(marked, pc.ascii_rtrim(chunks, MARKS), chunks).dictionary_encode()
        marks = pc.replace_substring_regex(chunks.filter(marked), r"\A ?\p{L}+", "").dictionary_encode()
        ids = [x for p in (words, marks) for x in p.dictionary.to_numpy(zero_copy_only=False)]
        ids = [self.line_end, *self._ids(ids)]
        size = np.fromiter(map(len, ids), dtype=np.int64, count=len(ids)) // 4
        start = np.cumsum(size) - size
        part = np.zeros((len(chunks), 3), dtype=np.int64)
        part[:, 1] = words.indices.to_numpy() + 1
        marked = np.flatnonzero(marked)
        part[marked, 2] = marks.indices.to_numpy() + 1 + len(words.dictionary)
        sizes = size[part]
        sizes[:, 0] = ~np.asarray(pc.starts_with(chunks, " ")) if lines else 0
        sizes[:, 2] *= part[:, 2] > 0
        values = _runs(np.frombuffer(b"".join(ids), dtype="<u4"), start[part].ravel(), sizes.ravel())
        size = sizes.sum(axis=1)
        start, size = (np.cumsum(size) - size)[code], size[code]
        if lines:
            start[first] += 1
            size[first] -= 1
        return np.split(_runs(values, start, size), np.cumsum(np.add.reduceat(size, first))[:-1])

    def _even(self, texts: pa.Array) -> list[np.ndarray]:
        """Words with the space before them; a line's first has none, but its line end."""
        words = pc.split_pattern(pc.replace_substring(texts, " ", "\n "), "\n")
        return self._joined(words.flatten(), words.offsets.to_numpy()[:-1], lines=True)

    def _uneven(self, texts: list[str]) -> list[np.ndarray]:
        """Other white space, or more than one in a row: cut only where that is safe."""
        chunks = [CUT.split(t) for t in texts]
        ends = np.cumsum([len(c) for c in chunks])
        first = np.concatenate(([0], ends[:-1]))
        return self._joined(pa.array(chain.from_iterable(chunks), pa.string()), first, lines=False)

    def encode_all(self, texts: pa.Array) -> list[np.ndarray]:
        """The ids of each text; null is empty."""
        texts = pc.fill_null(texts, "")
        uneven = pc.match_substring_regex(texts, UNEVEN)
        even, odd = texts.filter(pc.invert(uneven)), texts.filter(uneven).to_pylist()
        even, odd = iter(self._even(even) if len(even) else []), iter(self._uneven(odd) if odd else [])
        return [next(odd if u else even) for u in uneven.to_pylist()]

    def encode(self, text: str) -> np.ndarray:
        return self.encode_all(pa.array([text], pa.string()))[0]


def _runs(values: np.ndarray, start: np.ndarray, size: np.ndarray) -> np.ndarray:
    """So many values from each start on, one after the other."""
    at = np.repeat(start - np.cumsum(size) + size, size)
    at += np.arange(len(at))
    return values[at]


@lru_cache(maxsize=2)
def tokenizer(path: str) -> CachedTokenizer:
    return CachedTokenizer(path)


def _second_of_runs(at: np.ndarray, right: np.ndarray, equal: np.ndarray) -> np.ndarray:
    """Places, among these, of a run of equal symbols whose pair overlaps the one before that counts."""
    k = np.flatnonzero(equal)
    first = np.ones(len(k), dtype=bool)
    first[1:] = right[k[:-1]] != at[k[1:]]
    number = np.arange(len(k))
    start = np.maximum.accumulate(np.where(first, number, 0))
    return k[(number - start) % 2 == 1]


def _in_order(keys: np.ndarray, bits: int) -> tuple[np.ndarray, np.ndarray]:
    """The keys, of so many bits, in ascending order, and where each stood; equal ones stay in order."""
    places = len(keys).bit_length()
    if bits + places > 64:
        order = np.argsort(keys, kind="stable")
        return keys[order], order
    both = keys << np.uint64(places)
    both |= np.arange(len(keys), dtype=np.uint64)
    both.sort()
    order = (both & np.uint64((1 << places) - 1)).view(np.int64)
    both >>= np.uint64(places)
    return both, order


def compress(ids: np.ndarray, ends: np.ndarray, base: int):
    """Re-Pair of a shard: (symbols, ends, rules, lengths).

    ids: all ids of the shard; ends: True at the last id of each document.  Symbols are
    linked to their neighbours.  The first round counts all pairs; a later one those that
    were frequent in the round before it, and those next to a symbol made there: any other
    pair was rare, and only replacing makes pairs, of the new symbols alone.
    """
    n = none = len(ids)
    symbols, alive = np.append(ids.astype(np.uint32), np.uint32(0)), np.ones(n, dtype=bool)
    # The neighbours within the document; ``none`` is a place beyond all.
    after, before = np.arange(1, n + 2), np.arange(-1, n)
    after[:n][ends] = none
    before[:1] = none
    before[1:][ends] = none
    rules, sizes = [np.empty((0, 2), dtype=np.int64)], np.empty(0, dtype=np.int64)
    marked = np.zeros(n + 1, dtype=bool)
    at = np.flatnonzero(after[:n] != none)
    while len(at):
        top = base + len(sizes)
        bits = top.bit_length()
        right = after[at]
        one, two = symbols[at], symbols[right]
        second = _second_of_runs(at, right, one == two)
        overlapped = at[second]
        pairs = one.astype(np.uint64)
        pairs <<= np.uint64(bits)
        pairs |= two
        del one, two
        # They go last, as a pair that doesn't occur, and don't count.
        pairs[second] = (1 << 2 * bits) - 1
        pairs, order = _in_order(pairs, 2 * bits)
        pairs, order = pairs[: len(at) - len(second)], order[: len(at) - len(second)]
        start = np.flatnonzero(np.concatenate(([True], pairs[1:] != pairs[:-1])))
        counts = np.diff(np.append(start, len(pairs)))
        often = np.flatnonzero(counts >= LEAST)
        if not len(often):
            break
        # The most frequent first, equal ones by their symbols.
        often = often[np.argsort(-counts[often], kind="stable")]
        rank_of = np.full(len(start), -1, dtype=np.int32)
        rank_of[often] = np.arange(len(often))
        rank = np.full(len(at), -1, dtype=np.int32)
        rank[order] = np.repeat(rank_of, counts)
        frequent = np.flatnonzero(rank >= 0)
        at, right, rank = at[frequent], right[frequent], rank[frequent]
        # Of overlapping pairs the more frequent is replaced; the first one wins everywhere.
        apart = right[:-1] != at[1:]
        wins = np.ones(len(at), dtype=bool)
        wins[1:] &= apart | (rank[1:] < rank[:-1])
        wins[:-1] &= apart | (rank[:-1] <= rank[1:])
        wins = np.flatnonzero(wins)
        used = np.bincount(rank[wins], minlength=len(often))
        wins = wins[(used >= LEAST)[rank[wins]]]
        name = np.cumsum(used >= LEAST) - 1 + top
        made = pairs[start[often[used >= LEAST]]]
        made = np.stack((made >> np.uint64(bits), made & np.uint64((1 << bits) - 1)), axis=1).astype(np.int64)
        rules.append(made)
        known = np.concatenate((sizes, [1]))
        sizes = np.concatenate((sizes, known[np.where(made < base, -1, made - base)].sum(axis=1)))
        places, gone = at[wins], right[wins]
        symbols[places] = name[rank[wins]]
        alive[gone] = False
        after[places] = beyond = after[gone]
        before[beyond] = places
        marked[at] = marked[overlapped] = True
        marked[gone] = False
        marked[places] = marked[before[places]] = True
        marked[none] = False
        at = np.flatnonzero(marked)
        marked[at] = False
        at = at[after[at] != none]
    left = np.flatnonzero(alive)
    return symbols[left], after[left] == none, np.concatenate(rules).astype("<u4"), sizes.astype("<u4")


def packed(symbols: np.ndarray, width: int) -> bytes:
    """Little-endian, so many bytes a symbol."""
    return np.ascontiguousarray(symbols.astype("<u4").view(np.uint8).reshape(-1, 4)[:, :width]).tobytes()


def unpacked(data: bytes, width: int) -> np.ndarray:
    wide = np.zeros((len(data) // width, 4), dtype=np.uint8)
    wide[:, :width] = np.frombuffer(data, dtype=np.uint8).reshape(-1, width)
    return wide.view("<u4").reshape(-1)


def expand(symbols: np.ndarray, rules: np.ndarray, base: int) -> np.ndarray:
    """The ids that symbols stand for, level by level."""
    symbols = symbols.astype(np.int64)
    pairs = rules.astype(np.int64)
    while True:
        named = symbols >= base
        if not named.any():
            return symbols.astype("<u4")
        starts = np.cumsum(1 + named) - (1 + named)
        wide = np.repeat(symbols, 1 + named)
        rule = pairs[symbols[named] - base]
        wide[starts[named]], wide[starts[named] + 1] = rule[:, 0], rule[:, 1]
        symbols = wide


def expand_all(symbols: np.ndarray, rules: np.ndarray, lengths: np.ndarray, base: int) -> np.ndarray:
    """As ``expand``, for a whole shard: what a symbol stands for is spelt out once."""
    used = np.zeros(base + len(rules), dtype=bool)
    used[symbols] = True
    used = np.flatnonzero(used)
    size = np.concatenate((np.ones(base, dtype=np.int64), lengths))
    start = np.zeros(len(size), dtype=np.int64)
    start[used] = np.cumsum(size[used]) - size[used]
    return _runs(expand(used, rules, base), start[symbols], size[symbols])


COLUMNS = (
    "part int, shard int, base int, width int, n_tokens long, symbols binary, rules binary, lengths binary, "
    "doc_ids binary, null_ids binary, doc_symbols binary, doc_tokens binary"
)
_NAMES = [x.split()[0] for x in COLUMNS.split(", ")]
_KINDS = [pa.int32()] * 4 + [pa.int64()] + [pa.binary()] * 7


def _row(part: int, shard: int, docs: list[tuple[int | None, np.ndarray]], base: int) -> pa.RecordBatch:
    sizes = np.array([len(ids) for _, ids in docs], dtype="<i8")
    ends = np.zeros(int(sizes.sum()), dtype=bool)
    ends[np.cumsum(sizes) - 1] = True
    symbols, last, rules, lengths = compress(np.concatenate([ids for _, ids in docs]), ends, base)
    per_doc = np.diff(np.concatenate(([0], np.flatnonzero(last) + 1))).astype("<i8")
    width = 2 if base + len(rules) <= NARROW else 3 if base + len(rules) <= MIDDLE else 4
    values = [
        part, shard, base, width, int(sizes.sum()), packed(symbols, width), rules.tobytes(),
        lengths.tobytes(), np.array([i or 0 for i, _ in docs], dtype="<i8").tobytes(),
        np.array([i is None for i, _ in docs], dtype=np.uint8).tobytes(), per_doc.tobytes(), sizes.tobytes(),
    ]
    return pa.RecordBatch.from_arrays([pa.array([v], k) for v, k in zip(values, _KINDS)], names=_NAMES)


def _portions(batch: pa.RecordBatch) -> Iterator[pa.RecordBatch]:
    """All rows, in batches of about so many bytes of text."""
    sizes = pc.fill_null(pc.binary_length(batch["text"]), 0).to_numpy(zero_copy_only=False).astype(np.int64)
    cuts = np.flatnonzero(np.diff((np.cumsum(sizes) - sizes) // PORTION, prepend=-1)).tolist()
    for a, b in zip(cuts, [*cuts[1:], batch.num_rows]):
        yield batch.slice(a, b - a)


def shards(docs: DataFrame, path: str, end_id: int) -> DataFrame:
    """The compressed shards of all documents, in ascending order of (part, shard)."""

    def build(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encoder, part = tokenizer(path), TaskContext.get().partitionId()
        held, tokens, shard = [], 0, 0
        for batch in (x for b in batches for x in _portions(b)):
            for doc_id, ids in zip(batch["doc_id"].to_pylist(), encoder.encode_all(batch["text"])):
                ids = np.append(ids, np.uint32(end_id))
                held.append((doc_id, ids))
                tokens += len(ids)
                if tokens >= SHARD:
                    yield _row(part, shard, held, encoder.vocabulary)
                    held, tokens, shard = [], 0, shard + 1
        if held:
            yield _row(part, shard, held, encoder.vocabulary)

    ordered = docs.select("doc_id", "text").repartitionByRange("doc_id").sortWithinPartitions("doc_id", "text")
    return ordered.mapInArrow(build, COLUMNS)


class Shard:
    """One row, for reading."""

    def __init__(self, row: dict):
        read = lambda name, kind: np.frombuffer(row[name], dtype=kind)
        self.base = row["base"]
        self.symbols = unpacked(row["symbols"], row["width"])
        self.rules, self.lengths = read("rules", "<u4").reshape(-1, 2), read("lengths", "<u4")
        missing = read("null_ids", np.uint8)
        self.doc_ids = [None if m else int(i) for i, m in zip(read("doc_ids", "<i8"), missing)]
        self.doc_tokens = read("doc_tokens", "<i8")
        self.starts = np.concatenate(([0], np.cumsum(read("doc_symbols", "<i8"))))

    def document(self, i: int) -> np.ndarray:
        return expand(self.symbols[self.starts[i] : self.starts[i + 1]], self.rules, self.base)

    def ids(self, i: int, first: int, end: int) -> np.ndarray:
        """Ids first to end of a document: only the symbols that reach into them are expanded."""
        part = self.symbols[self.starts[i] : self.starts[i + 1]].astype(np.int64)
        long = part >= self.base
        sizes = np.ones(len(part), dtype=np.int64)
        sizes[long] = self.lengths[part[long] - self.base]
        ends = np.cumsum(sizes)
        a = int(np.searchsorted(ends, first, side="right"))
        b = int(np.searchsorted(ends, end, side="left")) + 1
        skipped = int(ends[a - 1]) if a else 0
        return expand(part[a:b], self.rules, self.base)[first - skipped : end - skipped]


def documents(table: DataFrame) -> DataFrame:
    """doc_id, part, shard, place in the shard, ids before it there, and its ids."""

    def read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for row in (r for b in batches for r in b.to_pylist()):
            shard = Shard(row)
            n = len(shard.doc_ids)
            before = np.cumsum(shard.doc_tokens) - shard.doc_tokens
            # All of a shard's documents at once; each also stands alone (Shard.document).
            ids = expand_all(shard.symbols, shard.rules, shard.lengths, shard.base)
            crc = [zlib.crc32(ids[a : a + k]) for a, k in zip(before.tolist(), shard.doc_tokens.tolist())]
            yield pa.RecordBatch.from_arrays(
                [
                    pa.array(shard.doc_ids, pa.int64()), pa.array([row["part"]] * n, pa.int32()),
                    pa.array([row["shard"]] * n, pa.int32()), pa.array(before, pa.int64()),
                    pa.array(shard.doc_tokens, pa.int64()), pa.array(crc, pa.int64()),
                ],
                names=["doc_id", "part", "shard", "before", "n_tokens", "ids_crc32"],
            )

    return table.mapInArrow(
        read, "doc_id long, part int, shard int, before long, n_tokens long, ids_crc32 long"
    )


def index(table: DataFrame) -> DataFrame:
    """part, shard and the number of ids in all earlier shards.

    Sums run over the shards of a part, and over the parts: two short lists, not one long.
    """
    sizes = table.select("part", "shard", "n_tokens")
    earlier = lambda w: F.coalesce(F.sum("n_tokens").over(w), F.lit(0))
    rows = lambda w: w.rowsBetween(Window.unboundedPreceding, -1)
    parts = sizes.groupBy("part").agg(F.sum("n_tokens").alias("n_tokens"))
    starts = parts.select("part", earlier(rows(Window.orderBy("part"))).alias("part_start"))
    inner = sizes.select("part", "shard", earlier(rows(Window.partitionBy("part").orderBy("shard"))).alias("in_part"))
    return inner.join(starts, "part").select(
        "part", "shard", (F.col("part_start") + F.col("in_part")).alias("shard_start")
    )


def digests(docs: DataFrame, path: str, end_id: int) -> DataFrame:
    """doc_id, start, n_tokens, ids_crc32 of every document, read back from the written shards."""
    table = stored(shards(docs, path, end_id))
    return (
        documents(table)
        .join(index(table), ["part", "shard"])
        .select("doc_id", (F.col("shard_start") + F.col("before")).alias("start"), "n_tokens", "ids_crc32")
    )
