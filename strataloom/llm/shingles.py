"""Bags of word shingles of the texts of a block."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa

from strataloom.llm.words import U64, Words, grams, salted


def bags(texts: pa.Array | pa.ChunkedArray, size: int = 5) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """Of each text the sorted distinct hashes of its runs of `size` words, and how often each stands in it.

    A text of fewer words has one shingle of all its words; a text without words has none.
    """
    words = Words(texts)
    h = words.hashes()
    runs = grams(h, size)
    for a, b in zip(words.first[:-1], words.first[1:]):
        n = int(b - a)
        if n >= size:
            yield np.unique(runs[a : b - size + 1], return_counts=True)
        elif n:
            yield salted(grams(h[a:b], n)[:1], n), np.ones(1, np.int64)
        else:
            yield np.zeros(0, U64), np.zeros(0, np.int64)
