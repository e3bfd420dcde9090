"""Pairs inside groups of any size, met block by block: what a task holds is bounded, and it only emits links that join."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def block_pairs(members: DataFrame, group: str, node: str, size: str, block: int) -> DataFrame:
    """Every member once for each pair of blocks that its own block is part of: adds own, low, high.

    A group of `size` members has ceil(size / block) blocks, dealt by a hash of the node.
    """
    blocks = F.greatest(F.lit(1), F.ceil(F.col(size) / block)).cast("int")
    own = F.pmod(F.xxhash64(F.col(node), F.lit(7)), F.col("__blocks")).cast("int")
    dealt = members.withColumn("__blocks", blocks).withColumn("own", own)
    dealt = dealt.withColumn("__other", F.explode(F.sequence(F.lit(0), F.col("__blocks") - 1)))
    return dealt.withColumn("low", F.least("own", "__other")).withColumn("high", F.greatest("own", "__other")).drop("__blocks", "__other")


def task_key(group: str, tasks: int):
    """Deals pairs of blocks over `tasks` tasks."""
    return F.pmod(F.xxhash64(F.col(group), F.col("low"), F.col("high")), F.lit(tasks)).cast("int")


def runs(table: pa.Table, group: str) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """Of each pair of blocks the rows of the one and the rows of the other; twice the same rows for a block with itself."""
    keys = [table[c].to_numpy() for c in ("high", "low", group)]
    order = np.lexsort(keys)
    change = np.zeros(len(order), bool)
    change[:1] = True
    for k in keys:
        change[1:] |= k[order][1:] != k[order][:-1]
    starts = np.flatnonzero(change)
    own, low, high = (table[c].to_numpy() for c in ("own", "low", "high"))
    for a, b in zip(starts, np.append(starts[1:], len(order))):
        rows = order[a:b]
        if low[rows[0]] == high[rows[0]]:
            yield rows, rows
        else:
            yield rows[own[rows] == low[rows[0]]], rows[own[rows] == high[rows[0]]]


class Sets:
    """Union-find over rows."""

    def __init__(self, *rows: np.ndarray):
        self.up = {int(x): int(x) for part in rows for x in part}

    def top(self, x: int) -> int:
        while self.up[x] != x:
            self.up[x] = self.up[self.up[x]]
            x = self.up[x]
        return x

    def join(self, x: int, y: int) -> bool:
        x, y = self.top(x), self.top(y)
        self.up[max(x, y)] = min(x, y)
        return x != y


def spanning_links(left: np.ndarray, right: np.ndarray, near: Callable[[int, np.ndarray], np.ndarray]) -> Iterator[tuple[int, int]]:
    """Links between rows of the two sides that join two sets; near(row, rows) tells which of the rows are linked to it.

    Rows that are in one set already are not compared: their link would join nothing.
    """
    same, sets = left is right, Sets(left, right)
    left, right = left.tolist(), right.tolist()
    for i, x in enumerate(left):
        top = sets.top(x)
        others = np.array([y for y in (left[i + 1 :] if same else right) if sets.top(y) != top], np.int64)
        if len(others):
            for y in others[near(x, others)].tolist():
                if sets.join(x, y):
                    yield x, y
