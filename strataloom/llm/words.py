"""Words of texts as flat arrays: a word is a run of bytes other than space and 0x09-0x0D.

Everything works on an Arrow text column at once, so that a task spends tens of nanoseconds a word.
Null texts count as empty.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash

U64 = np.uint64
BASE = 0x9E3779B97F4A7C15 | 1
BLOCK = 1 << 20
LONG_WORD = 1 << 12
SPACE = np.zeros(256, dtype=bool)
SPACE[[0x20, *range(0x09, 0x0E)]] = True
FOLD = np.arange(256, dtype=np.uint8)
FOLD[65:91] += 32


def _powers(base: int) -> np.ndarray:
    steps = np.full(BLOCK + LONG_WORD + 1, base, dtype=U64)
    steps[0] = 1
    return np.cumprod(steps, dtype=U64)


_TABLES: dict[str, np.ndarray] = {}


def _tables() -> tuple[np.ndarray, np.ndarray]:
    if not _TABLES:
        _TABLES["up"] = _powers(BASE)
        _TABLES["down"] = _powers(pow(BASE, -1, 1 << 64))
    return _TABLES["up"], _TABLES["down"]


def mix(x: np.ndarray) -> np.ndarray:
    """A bijection of 64-bit numbers that spreads every bit."""
    x = x ^ (x >> U64(31))
    x = x * U64(0xBF58476D1CE4E5B9)
    x = x ^ (x >> U64(29))
    x = x * U64(0x94D049BB133111EB)
    return x ^ (x >> U64(32))


def salted(x: np.ndarray, salt: int) -> np.ndarray:
    return mix(x + U64((salt * 0xD1B54A32D192ED03 + 0x2545F4914F6CDD1D) & 0xFFFFFFFFFFFFFFFF))


def raw_bytes(texts: pa.Array | pa.ChunkedArray) -> tuple[np.ndarray, np.ndarray]:
    """All bytes of the texts one after another, and where each text starts (one offset more than texts)."""
    if isinstance(texts, pa.ChunkedArray):
        texts = texts.cast(pa.large_string()).combine_chunks()
    texts = texts.cast(pa.large_string()).fill_null("")
    if isinstance(texts, pa.ChunkedArray):
        texts = pa.concat_arrays(texts.chunks)
    if not len(texts):
        return np.zeros(0, np.uint8), np.zeros(1, np.int64)
    _, where, held = texts.buffers()
    offsets = np.frombuffer(where, np.int64)[texts.offset : texts.offset + len(texts) + 1]
    data = np.frombuffer(held, np.uint8)[offsets[0] : offsets[-1]] if held is not None else np.zeros(0, np.uint8)
    return data, offsets - offsets[0]


class Words:
    """starts, ends: byte places of all words; first: the first word of each text, and the count at the end."""

    def __init__(self, texts: pa.Array | pa.ChunkedArray, fold: bool = False):
        data, offsets = raw_bytes(texts)
        self.data = FOLD[data] if fold else data
        self.offsets = offsets
        n = len(data)
        word = ~SPACE[data]
        head, tail = np.ones(n, bool), np.ones(n, bool)
        if n:
            np.logical_not(word[:-1], out=head[1:])
            np.logical_not(word[1:], out=tail[:-1])
            head[offsets[:-1][offsets[:-1] < n]] = True
            tail[offsets[1:][offsets[1:] > 0] - 1] = True
        self.starts = np.flatnonzero(word & head)
        self.ends = np.flatnonzero(word & tail) + 1
        self.first = np.searchsorted(self.starts, offsets)

    def __len__(self) -> int:
        return len(self.starts)

    @property
    def counts(self) -> np.ndarray:
        return np.diff(self.first)

    def text_of_word(self) -> np.ndarray:
        return np.repeat(np.arange(len(self.first) - 1), self.counts)

    def room(self) -> np.ndarray:
        """Words from each word to the end of its text, itself included."""
        return np.repeat(self.first[1:], self.counts) - np.arange(len(self))

    def hashes(self) -> np.ndarray:
        up, down = _tables()
        out = np.zeros(len(self), U64)
        size = self.ends - self.starts
        usual = np.flatnonzero(size <= LONG_WORD)
        s, e = self.starts[usual], self.ends[usual]
        at = 0
        while at < len(usual):
            lo = s[at]
            to = max(at + 1, int(np.searchsorted(s, lo + BLOCK)))
            piece = self.data[lo : e[to - 1]].astype(U64)
            sums = np.zeros(len(piece) + 1, U64)
            np.cumsum((piece + U64(1)) * up[: len(piece)], out=sums[1:])
            out[usual[at:to]] = (sums[e[at:to] - lo] - sums[s[at:to] - lo]) * down[s[at:to] - lo]
            at = to
        out = mix(out + size.astype(U64) * U64(0xA0761D6478BD642F))
        for i in np.flatnonzero(size > LONG_WORD):
            out[i] = xxhash.xxh3_64_intdigest(self.data[self.starts[i] : self.ends[i]].tobytes())
        return out


def grams(h: np.ndarray, k: int) -> np.ndarray:
    """Hash of the k words from each word on; as long as h, with zeros at the end where k words don't fit.

    Runs are doubled: a run of 2j words joins two runs of j.
    """
    n = max(0, len(h) - k + 1)
    total, done, size, run = None, 0, 1, h
    while True:
        if k & size:
            part = run[done : done + n]
            total = part.copy() if total is None else mix(total * U64(0x9FB21C651E98DF25) + part)
            done += size
        if done == k:
            break
        run = mix(run[: len(run) - size] * U64(0x9FB21C651E98DF25) + run[size:]) if len(run) > size else run[:0]
        size *= 2
    out = np.zeros(len(h), U64)
    out[:n] = total[:n]
    return out


def slices(batches: Iterator[pa.RecordBatch], column: str, size: int = 4 << 20) -> Iterator[pa.RecordBatch]:
    """The same rows in pieces of about `size` bytes of text, a row at least."""
    for batch in batches:
        if not batch.num_rows:
            continue
        _, offsets = raw_bytes(batch.column(column))
        at = 0
        while at < batch.num_rows:
            to = max(at + 1, int(np.searchsorted(offsets, offsets[at] + size, side="right")) - 1)
            yield batch.slice(at, to - at)
            at = to


def ids_of(column: pa.Array | pa.ChunkedArray) -> np.ndarray:
    """Integer ids; a null id counts as the largest."""
    held = column.cast(pa.int64()).fill_null(np.iinfo(np.int64).max)
    return held.to_numpy(zero_copy_only=False) if isinstance(held, pa.Array) else held.to_numpy()
