"""Helpers that run inside tasks: word hashing, n-gram hashing and Arrow plumbing."""

from __future__ import annotations

from collections.abc import Iterable, Iterator

import numpy as np
import pyarrow as pa
import xxhash

#: Hashed words kept by a task before its table is emptied; bounds memory, never results.
WORD_CACHE = 200_000

_MIX = np.uint64(0x9E3779B97F4A7C15)


class WordHasher:
    """64-bit word hashes through a bounded table."""

    def __init__(self, limit: int = WORD_CACHE):
        self.limit = limit
        self.known: dict[str, int] = {}

    def ids(self, words: list[str]) -> np.ndarray:
        known = self.known
        try:
            return np.array([known[w] for w in words], dtype=np.uint64)
        except KeyError:
            if len(known) > self.limit:
                known.clear()
            for w in words:
                if w not in known:
                    known[w] = xxhash.xxh64_intdigest(w.encode("utf-8", "surrogatepass"))
            return np.array([known[w] for w in words], dtype=np.uint64)


def mix(x: np.ndarray) -> np.ndarray:
    """A finaliser that spreads every input bit over all output bits."""
    x = x ^ (x >> np.uint64(33))
    x = x * np.uint64(0xFF51AFD7ED558CCD)
    x = x ^ (x >> np.uint64(29))
    x = x * np.uint64(0xC4CEB9FE1A85EC53)
    return x ^ (x >> np.uint64(32))


def gram_hashes(words: np.ndarray, n: int) -> np.ndarray:
    """Hashes of all runs of n words; one hash of all words where there are fewer than n."""
    if not len(words):
        return words
    n = min(n, len(words))
    out = np.zeros(len(words) - n + 1, dtype=np.uint64)
    for i in range(n):
        out = out * _MIX + words[i : len(words) - n + 1 + i]
    return mix(out + np.uint64(n))


def slices(batches: Iterable[pa.RecordBatch], rows: int = 512) -> Iterator[pa.RecordBatch]:
    """Arrow batches cut to a few hundred rows, so that a task's temporary arrays stay small."""
    for batch in batches:
        for i in range(0, batch.num_rows, rows):
            yield batch.slice(i, rows)


def texts(column: pa.Array) -> list[str]:
    """Python strings; null is the empty text."""
    return [t or "" for t in column.to_pylist()]
