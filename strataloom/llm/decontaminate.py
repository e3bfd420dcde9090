"""Benchmark decontamination by pigeonhole edit matching.

Texts and test items are compared in lower case with single spaces. An item of m characters may differ in
e = floor(m * error_rate) single-character edits. It is cut into e + 1 pieces: a passage within e edits
holds one piece unchanged. Pieces are found by one automaton run over a text, and the place around a hit
is verified with Myers' bit-parallel edit distance, over twice as many pieces each time: of two halves
with n and k pieces and at most n + k - 1 edits, one has fewer edits than pieces, so a true passage has a
piece around which every larger part is within its own budget, and a chance hit ends after a few characters.
"""

from __future__ import annotations

from collections import defaultdict
from collections.abc import Iterator

import ahocorasick
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

ERROR_RATE = 0.1
BLOCK_CHARS = 2_000_000
MATCHES = "array<struct<item_id: long, distance: int, from_char: int, to_char: int>>"
ARROW_MATCHES = pa.list_(pa.struct([("item_id", pa.int64()), ("distance", pa.int32()), ("from_char", pa.int32()), ("to_char", pa.int32())]))


def normal(text: str | None) -> str:
    return " ".join((text or "").lower().split())


def myers(pattern: str, text: str) -> tuple[int, int]:
    """Least edit distance of the pattern to any part of the text, and the end of the first such part."""
    m = len(pattern)
    if not m:
        return 0, 0
    full, top = (1 << m) - 1, 1 << (m - 1)
    places: dict[str, int] = defaultdict(int)
    for i, c in enumerate(pattern):
        places[c] |= 1 << i
    up, down, score = full, 0, m
    best, end = m, 0
    for j, c in enumerate(text):
        equal = places.get(c, 0)
        vertical = equal | down
        across = (((equal & up) + up) ^ up) | equal
        plus = down | (full & ~(across | up))
        minus = up & across
        if plus & top:
            score += 1
        elif minus & top:
            score -= 1
        plus <<= 1
        minus <<= 1
        up = (minus | ~(vertical | plus)) & full
        down = plus & vertical & full
        if score < best:
            best, end = score, j + 1
    return best, end


def _parts(cuts: list[int], piece: int) -> list[tuple[int, int, int]]:
    """The parts around a piece from small to large, without the whole: from, to, edits allowed."""
    low, high, out = 0, len(cuts) - 1, []
    while high - low > 1:
        if high - low < len(cuts) - 1:
            out.append((cuts[low], cuts[high], high - low - 1))
        middle = (low + high) // 2
        low, high = (low, middle) if piece < middle else (middle, high)
    return out[::-1]


class Matcher:
    """The automaton of the pieces of one block of items."""

    def __init__(self, items: list[tuple[int, str]], error_rate: float):
        self.items = []
        self.pieces = ahocorasick.Automaton()
        held: dict[str, list[tuple[int, int, list]]] = defaultdict(list)
        for item_id, text in items:
            if not text:
                continue
            m, e = len(text), int(len(text) * error_rate)
            cuts = [m * i // (e + 1) for i in range(e + 2)]
            for i, (a, b) in enumerate(zip(cuts, cuts[1:])):
                held[text[a:b]].append((len(self.items), a, _parts(cuts, i)))
            self.items.append((item_id, text, e))
        for piece, uses in held.items():
            self.pieces.add_word(piece, (len(piece), uses))
        if held:
            self.pieces.make_automaton()

    def _holds(self, text: str, item: str, at: int, parts: list[tuple[int, int, int]]) -> bool:
        """Whether every part is within its budget where the item would start at `at`."""
        return all(myers(item[a:b], text[max(0, at + a - k) : max(0, at + b + k)])[0] <= k for a, b, k in parts)

    def matches(self, text: str) -> list[dict]:
        """The best place of every item within its budget; the leftmost end of those as good."""
        if not self.items:
            return []
        hits: dict[int, list[tuple[int, list]]] = defaultdict(list)
        for last, (length, uses) in self.pieces.iter(text):
            for k, offset, parts in uses:
                hits[k].append((last + 1 - length - offset, parts))
        out = []
        for k in sorted(hits):
            item_id, item, e = self.items[k]
            best = None
            for run in _runs(sorted(hits[k], key=lambda hit: hit[0]), 2 * e):
                if not any(self._holds(text, item, at, parts) for at, parts in run):
                    continue
                at = max(0, run[0][0] - e)
                part = text[at : run[-1][0] + len(item) + e]
                distance, end = myers(item, part)
                if distance <= e and (best is None or distance < best[0]):
                    best = (distance, at, at + end)
            if best is not None:
                distance, at, end = best
                back = myers(item[::-1], text[at:end][::-1])[1]
                out.append({"item_id": item_id, "distance": distance, "from_char": end - back, "to_char": end})
        return out


def _runs(hits: list[tuple[int, list]], gap: int) -> Iterator[list[tuple[int, list]]]:
    run = [hits[0]]
    for hit in hits[1:]:
        if hit[0] - run[-1][0] > gap:
            yield run
            run = []
        run.append(hit)
    yield run


def item_blocks(items: DataFrame, item_col: str, text_col: str, size: int = BLOCK_CHARS) -> Iterator[list[tuple[int, str]]]:
    """Items in blocks of at most `size` characters (an item at least), fetched one after another."""
    block, held = [], 0
    for row in items.select(F.col(item_col).cast("long"), F.col(text_col).cast("string")).where(F.col(text_col).isNotNull()).toLocalIterator():
        text = normal(row[1])
        if block and held + len(text) > size:
            yield block
            block, held = [], 0
        block.append((row[0], text))
        held += len(text)
    if block:
        yield block


def leaks(docs: DataFrame, items: DataFrame, text_col: str = "text", item_col: str = "item_id", item_text_col: str = "text", error_rate: float = ERROR_RATE) -> Column:
    """Column of `docs`: the items found in a text, each with its least distance and where it stands.

    Every document meets every block of items inside its own task; nothing is shuffled, and a task holds one
    block's automaton at a time. Null and empty texts hold no item; null and empty items are in no text. Places
    are characters of the text in lower case with single spaces.
    """
    context, found = docs.sparkSession.sparkContext, []
    for block in item_blocks(items, item_col, item_text_col):
        shared = context.broadcast(block)
        held: list[Matcher] = []

        @F.arrow_udf(MATCHES)
        def match(texts, shared=shared, held=held):
            if not held:
                held.append(Matcher(shared.value, error_rate))
            return pa.array([held[0].matches(normal(t)) for t in texts.to_pylist()], ARROW_MATCHES)

        found.append(match(F.col(text_col).cast("string")))
    return F.flatten(F.array(*found)) if found else F.array().cast(MATCHES)


def contaminated(docs: DataFrame, items: DataFrame, id_col: str = "doc_id", text_col: str = "text", **options) -> DataFrame:
    """One row for every document and item found in it: id, item_id, distance, from_char, to_char.

    Rows with one id are separate documents. An empty table of documents or items gives no rows.
    """
    found = docs.select(F.col(id_col).alias(id_col), F.explode(leaks(docs, items, text_col, **options)).alias("m"))
    return found.select(id_col, "m.*")
