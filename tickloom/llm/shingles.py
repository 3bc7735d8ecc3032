"""Distinct word shingles of texts as arrays of 64-bit hashes."""

from __future__ import annotations

import numpy as np
import xxhash

from tickloom.llm.common import words

WIDTH = 5
_MIX = np.uint64(0x9E3779B97F4A7C15)


class Shingles:
    """Shingle hashes of texts; word hashes are remembered and forgotten at ``limit`` words."""

    def __init__(self, width: int = WIDTH, limit: int = 500_000) -> None:
        self.width, self.limit = width, limit
        self.known: dict[bytes, int] = {}

    def word_hashes(self, text: str) -> np.ndarray:
        got, known = words(text.encode()), self.known
        try:
            return np.array([known[w] for w in got], np.uint64)
        except KeyError:
            if len(known) > self.limit:
                known.clear()
            for w in got:
                if w not in known:
                    known[w] = xxhash.xxh3_64_intdigest(w)
            return np.array([known[w] for w in got], np.uint64)

    def distinct(self, text: str) -> np.ndarray:
        """Sorted distinct shingles; all words are one shingle where they are fewer, none where there are no words."""
        h = self.word_hashes(text)
        width = min(self.width, len(h))
        if not width:
            return h
        n = len(h) - width + 1
        out = np.full(n, width, np.uint64)
        for k in range(width):
            out = (out ^ h[k : k + n]) * _MIX
            out ^= out >> np.uint64(29)
        return np.unique(out)
