"""64-bit codes of words, the same in every process; equal words have equal codes."""

from __future__ import annotations

from collections.abc import Callable

import numpy as np
from xxhash import xxh3_64_intdigest

#: Words that a worker remembers; the table is emptied when full.
REMEMBERED = 500_000


class WordCodes:
    def __init__(self, plain: Callable[[bytes], bytes] | None = None):
        """plain: what of a word counts; words of which nothing counts get code 0."""
        self.plain = plain
        self.known: dict[bytes, int] = {}

    def _code(self, word: bytes) -> int:
        kept = self.plain(word) if self.plain else word
        if len(self.known) >= REMEMBERED:
            self.known.clear()
        code = self.known[word] = xxh3_64_intdigest(kept) or 1 if kept else 0
        return code

    def of(self, text: bytes | None) -> np.ndarray:
        """Codes of the words of a UTF-8 text in order; A-Z count as a-z.

        Bytes part at the six white space characters of ASCII only.
        """
        words = (text or b"").lower().split()
        codes = list(map(self.known.get, words))
        if None in codes:
            codes = [self._code(w) if c is None else c for w, c in zip(words, codes)]
        return np.array(codes, dtype=np.uint64)
