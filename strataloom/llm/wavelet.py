"""Wavelet matrix of a sequence of token ids: bit-planes with rank and select.

Plane 0 holds the highest bit of every id in order; then all ids are parted stably by this bit, zeros first, and
the next plane holds the next bit. Rank directories count the ones before every 512 bits.

File format of one sequence, all numbers little-endian: `WMX1`, ids (uint64), bits of an id (uint32), then for
each plane the number of zeros (uint64), the directory (uint32 each), and the plane, 8 bits a byte, the first
bit highest, padded to whole bytes.
"""

from __future__ import annotations

import struct

import numpy as np

MAGIC = b"WMX1"
SUPER = 512
#: ones in each byte value
ONES = np.unpackbits(np.arange(256, dtype=np.uint8)[:, None], axis=1).sum(axis=1).astype(np.uint8)


class WaveletMatrix:
    def __init__(self, size: int, width: int, planes: list[np.ndarray], zeros: list[int], directories: list[np.ndarray] | None = None):
        self.size, self.width, self.planes, self.zeros = size, width, planes, zeros
        self.directories = directories or [_directory(p) for p in planes]

    @classmethod
    def build(cls, ids: np.ndarray, width: int = 16) -> WaveletMatrix:
        ids = np.asarray(ids)
        if len(ids) and int(ids.max()) >> width:
            raise ValueError(f"an id needs more than {width} bits")
        held = ids.astype(np.uint16 if width <= 16 else np.uint32)
        planes, zeros = [], []
        for level in range(width - 1, -1, -1):
            bit = ((held >> level) & 1).astype(bool)
            planes.append(np.packbits(bit))
            low = held[~bit]
            zeros.append(len(low))
            held = np.concatenate((low, held[bit]))
        return cls(len(ids), width, planes, zeros)

    def ids(self) -> np.ndarray:
        """The whole sequence: the planes are put back from the last to the first."""
        held = np.zeros(self.size, np.uint16 if self.width <= 16 else np.uint32)
        for level in range(self.width - 1, -1, -1):
            bit = np.unpackbits(self.planes[level], count=self.size).view(bool)
            back = np.empty_like(held)
            back[~bit] = held[: self.zeros[level]]
            back[bit] = held[self.zeros[level] :]
            back |= bit.astype(held.dtype) << (self.width - 1 - level)
            held = back
        return held

    def _bit(self, level: int, at: int) -> int:
        return (int(self.planes[level][at >> 3]) >> (7 - (at & 7))) & 1

    def rank1(self, level: int, at: int) -> int:
        """Ones of a plane before place `at`."""
        plane, group = self.planes[level], at // SUPER
        start = group * SUPER >> 3
        count = int(self.directories[level][group]) + int(ONES[plane[start : at >> 3]].sum())
        return count + (int(ONES[plane[at >> 3] >> (8 - (at & 7))]) if at & 7 else 0)

    def select(self, level: int, bit: int, k: int) -> int:
        """Place of the k-th (from 0) zero or one of a plane."""
        places = np.arange(len(self.directories[level])) * SUPER
        counts = self.directories[level].astype(np.int64)
        counts = counts if bit else np.minimum(places, self.size) - counts
        group = int(np.searchsorted(counts, k, side="right")) - 1
        start = group * SUPER
        bits = np.unpackbits(self.planes[level][start >> 3 : (start + SUPER) >> 3])[: self.size - start]
        return start + int(np.flatnonzero(bits == bit)[k - int(counts[group])])

    def access(self, at: int) -> int:
        """The id at a place."""
        if not 0 <= at < self.size:
            raise IndexError(at)
        value = 0
        for level in range(self.width):
            bit, ones = self._bit(level, at), self.rank1(level, at)
            value = value << 1 | bit
            at = self.zeros[level] + ones if bit else at - ones
        return value

    def _range(self, value: int, low: int, high: int) -> tuple[int, int]:
        for level in range(self.width):
            a, b = self.rank1(level, low), self.rank1(level, high)
            low, high = (self.zeros[level] + a, self.zeros[level] + b) if value >> (self.width - 1 - level) & 1 else (low - a, high - b)
        return low, high

    def count(self, value: int, low: int = 0, high: int | None = None) -> int:
        """How often an id stands in places low to high (not included)."""
        a, b = self._range(value, low, self.size if high is None else high)
        return b - a

    def find(self, value: int, k: int) -> int:
        """Place of the k-th (from 0) occurrence of an id."""
        a, b = self._range(value, 0, self.size)
        if not 0 <= k < b - a:
            raise IndexError(k)
        at = a + k
        for level in range(self.width - 1, -1, -1):
            bit = value >> (self.width - 1 - level) & 1
            at = self.select(level, bit, at - self.zeros[level] if bit else at)
        return at

    def to_bytes(self) -> bytes:
        parts = [MAGIC, struct.pack("<QI", self.size, self.width)]
        for plane, zeros, directory in zip(self.planes, self.zeros, self.directories):
            parts += [struct.pack("<Q", zeros), directory.astype("<u4").tobytes(), plane.tobytes()]
        return b"".join(parts)

    @classmethod
    def from_bytes(cls, held: bytes) -> WaveletMatrix:
        if held[:4] != MAGIC:
            raise ValueError("not a wavelet matrix")
        size, width = struct.unpack_from("<QI", held, 4)
        at, planes, zeros, directories = 16, [], [], []
        groups, length = -(-size // SUPER) + 1, -(-size // 8)
        for _ in range(width):
            zeros.append(struct.unpack_from("<Q", held, at)[0])
            directories.append(np.frombuffer(held, "<u4", groups, at + 8))
            at += 8 + 4 * groups
            planes.append(np.frombuffer(held, np.uint8, length, at))
            at += length
        return cls(size, width, planes, zeros, directories)


def _directory(plane: np.ndarray) -> np.ndarray:
    """Ones before each group of SUPER bits, one entry more than full groups."""
    step = SUPER >> 3
    ones = ONES[plane].astype(np.uint32)
    padded = np.pad(ones, (0, -len(ones) % step)).reshape(-1, step).sum(axis=1, dtype=np.uint32)
    return np.concatenate(([0], np.cumsum(padded, dtype=np.uint32))).astype(np.uint32)
