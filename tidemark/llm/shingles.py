"""Word shingles as sorted arrays of 64-bit hashes, in numpy."""

from __future__ import annotations

from collections.abc import Iterator
from functools import reduce

import numpy as np
import pandas as pd
import xxhash

MUL1, MUL2 = np.uint64(0xBF58476D1CE4E5B9), np.uint64(0x94D049BB133111EB)
S30, S27, S31 = np.uint64(30), np.uint64(27), np.uint64(31)


def mix(x: np.ndarray) -> np.ndarray:
    """A bijection of 64-bit numbers that spreads every bit."""
    x = (x ^ (x >> S30)) * MUL1
    x = (x ^ (x >> S27)) * MUL2
    return x ^ (x >> S31)


def in_parts(batches: Iterator[pd.DataFrame], rows: int = 1000) -> Iterator[pd.DataFrame]:
    """Batches in parts of at most ``rows`` rows, so that what is made of them stays small."""
    for b in batches:
        for k in range(0, len(b), rows):
            yield b.iloc[k : k + rows]


class WordHashes(dict):
    """Hashes of words (bytes); those of the first ``limit`` different ones are kept."""

    limit = 1 << 16

    def __missing__(self, word: bytes) -> int:
        h = xxhash.xxh3_64_intdigest(word)
        if len(self) < self.limit:
            self[word] = h
        return h


def words_of(text: str | None) -> list[bytes]:
    """What ASCII white space leaves of the text, with A-Z lower-cased."""
    return text.encode("utf-8", "surrogatepass").lower().split() if text else []


def shingle_set(text: str | None, size: int, hashes: WordHashes) -> np.ndarray:
    """Sorted hashes of the distinct shingles; fewer words than ``size`` make one shingle, no words none."""
    words = words_of(text)
    if not words:
        return np.empty(0, np.uint64)
    h = np.fromiter(map(hashes.__getitem__, words), np.uint64, len(words))
    n = max(1, len(h) - size + 1)
    parts = [h[k : k + n] for k in range(min(size, len(h)))]
    return np.unique(reduce(lambda a, b: mix(a) + b, parts[1:], mix(parts[0] + np.uint64(len(parts)))))
