"""Documents as pieces of tokens, packed into as few sequences of a fixed length as best-fit finds after a reduction.

Lengths are whole numbers up to the capacity, so the instance is a histogram of as many counts, however many pieces
there are. On it Martello and Toth's dominance rules fix sequences that some best packing has as well, and best-fit
decreasing packs the rest; both handle all pieces of one length at once. Spark cuts and counts the pieces, numbers
those of a length, and looks their place up in the plan.
"""

from __future__ import annotations

import os
import re
import uuid
import zlib
from array import array
from collections.abc import Iterator, Mapping
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark import TaskContext
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from strataloom.llm.tokens import MARKS, byte_letters
from strataloom.llm.words import slices
from strataloom.session import shared_folder

CACHED_UNITS, LONG_UNIT = 500_000, 64
#: Bytes of text encoded together.
SLICE = 8 << 20
#: Unicode white space, as the tokenizer's own splitting takes it.
WHITE = "\t-\r \x85\xa0\u1680\u2000-\u200a\u2028\u2029\u202f\u205f\u3000"
#: A word with the one space before it; a run of white space but for its last character before a word; any other run.
UNIT = re.compile(f" ?[^{WHITE}]+|[{WHITE}]+(?![^{WHITE}])|[{WHITE}]+")
#: Letters of the first blocks of Unicode with or without a space before them, and punctuation after them.
LETTERS = "[A-Za-z\xaa\xb5\xba\xc0-\xd6\xd8-\xf6\xf8-\u017f]+"
PLAIN = re.compile(f"( ?{LETTERS})([{re.escape(MARKS)}]*)")
RANKS = 1 << 43


class Encoder:
    """Ids of texts by a byte-level tokenizer, whose tokens never reach over white space but for one space before a word.

    Where no two blanks stand together a text is its words after single spaces, so the distinct words of many texts are encoded
    and the rest is looked up. Plain letters with punctuation after them are two pre-tokens, whose letters go to the tokenizer's merges
    directly and are kept; any other word is cut into UNITs, and a text that holds a special token is encoded as a whole.
    """

    def __init__(self, path: str):
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_file(path)
        self.model = self.tokenizer.model
        self.special = [t.content for t in self.tokenizer.get_added_tokens_decoder().values()]
        self.odd = "|".join([f"[{WHITE}][{WHITE}]", *map(re.escape, self.special)])
        self.kept, self.byte_letters = {}, byte_letters()

    def trim(self) -> None:
        if len(self.kept) > CACHED_UNITS:
            self.kept.clear()

    def _plain(self, text: str) -> bytes:
        return array("I", self.tokenizer.encode(text, add_special_tokens=False).ids).tobytes()

    def _letters(self, letters: str) -> bytes:
        """Letters, with or without a space before them, as one pre-token."""
        ids = self.kept.get(letters)
        if ids is None:
            if letters.isascii():  # all but the space stand for themselves
                word = letters.replace(" ", self.byte_letters[32])
            else:
                word = letters.encode().decode("latin-1").translate(self.byte_letters)
            ids = self.kept[letters] = array("I", [t.id for t in self.model.tokenize(word)]).tobytes()
        return ids

    def _marks(self, marks: str) -> bytes:
        ids = self.kept.get(marks)
        if ids is None:
            ids = self.kept[marks] = self._plain(marks)
        return ids

    def _unit(self, unit: str) -> bytes:
        """A word with or without the space before it, or white space."""
        plain = PLAIN.fullmatch(unit) if len(unit) <= LONG_UNIT else None
        if plain is None:
            return self._plain(unit)
        letters, marks = plain.groups()
        return self._letters(letters) + self._marks(marks) if marks else self._letters(letters)

    def encode(self, text: str | None) -> bytes:
        if not text:
            return b""
        if any(s in text for s in self.special):
            return self._plain(text)
        return b"".join(map(self._unit, UNIT.findall(text)))

    def _words(self, words: pa.Array) -> tuple[np.ndarray, np.ndarray]:
        """Ids of distinct words, each after a space, one after another; and how many each has."""
        cores = pc.utf8_rtrim(words, MARKS)
        plain = pc.and_(pc.match_substring_regex(cores, f"^{LETTERS}$"), pc.less_equal(pc.utf8_length(words), LONG_UNIT))
        letters = cores.filter(plain).dictionary_encode()
        marks = pc.replace_substring_regex(words.filter(plain), f"^{LETTERS}", "").dictionary_encode()
        known = [self._letters(f" {x}") for x in letters.dictionary.to_pylist()]
        known += [self._marks(x) if x else b"" for x in marks.dictionary.to_pylist()]
        odd = [self.encode(f" {x}") for x in words.filter(pc.invert(plain)).to_pylist()]
        # every word is two parts, the second of an odd one empty
        parts = np.full((len(words), 2), len(known) + len(odd))
        at = plain.to_numpy(zero_copy_only=False)
        parts[at, 0] = letters.indices.to_numpy()
        parts[at, 1] = len(letters.dictionary) + marks.indices.to_numpy().astype(np.int64)
        parts[~at, 0] = len(known) + np.arange(len(odd))
        ids, sizes = _strung(*_flat([*known, *odd, b""]), parts.ravel())
        return ids, sizes.reshape(-1, 2).sum(axis=1)

    def encode_all(self, texts: pa.Array, end: int) -> Iterator[np.ndarray]:
        """Ids of each text with the end id after them, in order."""
        texts = texts.cast(pa.large_string()).fill_null("")
        odd = pc.match_substring_regex(texts, self.odd).to_numpy(zero_copy_only=False)
        usual = texts.filter(pa.array(~odd))
        split = pc.split_pattern(usual, " ")
        coded = split.flatten().dictionary_encode()
        codes, ends = coded.indices.to_numpy().astype(np.int64), np.cumsum(split.value_lengths().to_numpy().astype(np.int64))
        # a text's first word has no space before it; the end id is a word of its own after the last
        firsts = [self.encode(t) for t in pc.list_element(split, 0).to_pylist()] if len(usual) else []
        end_id = array("I", [end]).tobytes()
        codes[np.append(0, ends[:-1])[: len(firsts)]] = len(coded.dictionary) + np.arange(len(firsts))
        codes = np.insert(codes, ends, len(coded.dictionary) + len(firsts))
        ends = ends + np.arange(1, len(ends) + 1)
        words, rest = self._words(coded.dictionary), _flat([*firsts, end_id])
        ids, each = _strung(*map(np.concatenate, zip(words, rest)), codes)
        bounds = np.append(0, np.cumsum(each)[ends - 1]) if len(ends) else np.zeros(1, np.int64)
        row = 0
        for k, alone in enumerate(odd.tolist()):
            if alone:
                yield np.frombuffer(self.encode(texts[k].as_py()) + end_id, np.uint32)
            else:
                yield ids[bounds[row] : bounds[row + 1]]
                row += 1


def _flat(held: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
    """32-bit ids one after another, and how many each entry has."""
    return np.frombuffer(b"".join(held), np.uint32), np.fromiter(map(len, held), np.int64, len(held)) >> 2


def _strung(flat: np.ndarray, sizes: np.ndarray, codes: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The entries of a flat table strung together in the order of `codes`, and their sizes."""
    each = sizes[codes]
    total = np.cumsum(each)
    shift = (np.cumsum(sizes) - sizes)[codes] - (total - each)
    return flat[np.repeat(shift, each) + np.arange(total[-1] if len(total) else 0)], each


_ENCODERS: dict[str, Encoder] = {}


def encoder(path: str) -> Encoder:
    """One encoder a Python worker, which keeps its units from task to task."""
    os.environ["TOKENIZERS_PARALLELISM"] = "false"
    if path not in _ENCODERS:
        _ENCODERS[path] = Encoder(path)
    return _ENCODERS[path]


def cuts(n: int, capacity: int) -> list[tuple[int, int]]:
    """(start, end) of the pieces of n ids: whole pieces of `capacity`, what is left over in front of them."""
    if n <= capacity:
        return [(0, n)]
    first = n % capacity
    starts = [*([0] if first else []), *range(first, n, capacity)]
    return list(zip(starts, [*starts[1:], n]))


PIECE = {"id": pa.int64(), "piece": pa.int32(), "start": pa.int64(), "length": pa.int64(), "ids_crc32": pa.int64(), "part": pa.int32(), "turn": pa.int64()}


def _cut(path: str, end_id: int, capacity: int, keep_ids: bool):
    def pieces(batches):
        held_words, part, seen = encoder(path), TaskContext.get().partitionId(), np.zeros(capacity + 1, np.int64)
        for batch in slices(batches, "text", SLICE):
            held_words.trim()
            rows = {k: [] for k in PIECE} | ({"ids": []} if keep_ids else {})
            for key, ids in zip(batch.column("id").to_pylist(), held_words.encode_all(batch.column("text"), end_id)):
                for k, (at, to) in enumerate(cuts(len(ids), capacity)):
                    held = ids[at:to].tobytes()
                    row = (key, k, at, to - at, zlib.crc32(held), part, seen[to - at], held)
                    seen[to - at] += 1
                    for column, value in zip(rows.values(), row):
                        column.append(value)
            yield pa.record_batch([pa.array(v, PIECE.get(k, pa.binary())) for k, v in rows.items()], list(rows))

    return pieces


def token_pieces(docs: DataFrame, tokenizer: str, capacity: int = 2048, id_col: str = "doc_id", text_col: str = "text", end_id: int = 0, keep_ids: bool = False) -> DataFrame:
    """Pieces (id, piece, start, length, ids_crc32, part, turn) of every document, written below the checkpoint folder.

    A document is its ids and `end_id`; only one longer than `capacity` is cut, into pieces of `capacity` with the
    remainder in front. `turn` counts the pieces of one length within a task's `part`. With `keep_ids` the ids are kept as
    little-endian 32-bit numbers. Texts are read once, whole, and not shuffled.
    """
    known = docs.select(F.col(id_col).cast("long").alias("id"), F.col(text_col).cast("string").alias("text"))
    schema = "id long, piece int, start long, length long, ids_crc32 long, part int, turn long" + (", ids binary" if keep_ids else "")
    path = f"{shared_folder(docs.sparkSession).rstrip('/')}/pieces-{uuid.uuid4().hex}"
    known.mapInArrow(_cut(tokenizer, end_id, capacity, keep_ids), schema).write.parquet(path)
    return docs.sparkSession.read.parquet(path)


@dataclass
class Kind:
    """`count` sequences of one make-up: (length, copies, offset of the first copy) of what stands in them."""

    count: int
    held: list[tuple[int, int, int]] = field(default_factory=list)
    used: int = 0

    def plus(self, length: int, copies: int, count: int) -> Kind:
        """`count` sequences like this one with that many more copies."""
        return Kind(count, [*self.held, (length, copies, self.used)], self.used + length * copies)


def _made(count: int, lengths: list[int]) -> Kind:
    kind = Kind(count)
    for length in sorted(set(lengths), reverse=True):
        kind = kind.plus(length, lengths.count(length), count)
    return kind


class Instance:
    """Counts of lengths, from which whole sets are taken."""

    def __init__(self, counts: Mapping[int, int], capacity: int):
        self.capacity = capacity
        self.counts = [0] * (capacity + 1)
        for length, n in counts.items():
            if not 1 <= length <= capacity:
                raise ValueError(f"length {length} does not fit a sequence of {capacity}")
            self.counts[length] += n

    def _without(self, length: int) -> list[int]:
        rest = self.counts.copy()
        rest[length] -= 1
        return rest

    def _set_for(self, j: int) -> list[int] | None:
        """Lengths of a set with one piece of length j that dominates every other set with it, or None if none is proven."""
        room, rest = self.capacity - j, self._without(j)
        fits, left = 0, room  # how many of the smallest pieces go in with it; three are as good as more
        for length in range(1, room + 1):
            if rest[length] and length <= left:
                more = min(rest[length], left // length, 3 - fits)
                fits, left = fits + more, left - more * length
            if fits == 3 or length > left:
                break
        if fits == 0:
            return [j]
        largest = next(length for length in range(room, 0, -1) if rest[length])
        if largest == room or fits == 1:
            return [j, largest]
        if fits > 2:
            return None
        a, b = self._best_pair(rest, room)
        if largest >= a + b:
            return [j, largest]
        # any two that fit with j are no longer, one by one, than (a, b): then the three dominate
        if largest == a:
            beyond = [length for length in range(b + 1, room + 1) for _ in range(min(rest[length], 2))][:2]
            if len(beyond) < 2 or sum(beyond) > room:
                return [j, a, b]
        return None

    @staticmethod
    def _best_pair(rest: list[int], room: int) -> tuple[int, int]:
        """The two pieces of greatest total length that fit, the longer first, the longest one where totals are equal."""
        best, low = (0, 0), 1
        for a in range(room, 0, -1):
            if not rest[a]:
                continue
            for b in range(min(a, room - a), 0, -1):
                if rest[b] > (a == b):
                    best = max(best, (a, b), key=lambda p: (sum(p), p[0]))
                    break
        return best

    def reduce(self) -> list[Kind]:
        """Take out sets that dominate all others with their longest piece, until no rule applies any more."""
        fixed, before = [], None
        while before != sum(self.counts):
            before = sum(self.counts)
            for j in range(self.capacity, 0, -1):
                while self.counts[j]:
                    lengths = self._set_for(j)
                    if lengths is None:
                        break
                    # the rule holds on as long as pieces of all its lengths are there
                    times = min(self.counts[length] // lengths.count(length) for length in set(lengths))
                    for length in lengths:
                        self.counts[length] -= times
                    fixed.append(_made(times, lengths))
        return fixed

    def best_fit(self) -> list[Kind]:
        """Pack what is left, longest first, each piece where it leaves least room."""
        open_: list[list[Kind]] = [[] for _ in range(self.capacity + 1)]
        for length in range(self.capacity, 0, -1):
            left, self.counts[length] = self.counts[length], 0
            for room in range(length, self.capacity + 1):
                each, waiting = room // length, open_[room]
                while left and waiting:
                    kind = waiting.pop()
                    # sequences filled up with this length, then one with what is left of it, the others as they were
                    full = min(kind.count, left // each)
                    rest = left - full * each if full < kind.count else 0
                    left -= full * each + rest
                    for copies, count in ((each, full), (rest, 1 if rest else 0), (0, kind.count - full - (1 if rest else 0))):
                        if count:
                            done = kind.plus(length, copies, count) if copies else Kind(count, kind.held, kind.used)
                            open_[self.capacity - done.used].append(done)
                if not left:
                    break
            each = self.capacity // length
            for copies, count in ((each, left // each), (left % each, 1)):
                if copies and count:
                    done = Kind(0).plus(length, copies, count)
                    open_[self.capacity - done.used].append(done)
        return [kind for kinds in open_ for kind in kinds]


def packing_plan(counts: Mapping[int, int], capacity: int) -> list[Kind]:
    """Kinds of sequences that hold all pieces: those fixed by dominance, then best-fit decreasing."""
    instance = Instance(counts, capacity)
    return instance.reduce() + instance.best_fit()


def least_sequences(counts: Mapping[int, int], capacity: int) -> int:
    """Martello and Toth's second bound: no packing has fewer sequences."""
    held = sorted((length, n) for length, n in counts.items() if n)
    best = 0
    for small in sorted({0, *(length for length, _ in held if length <= capacity // 2)}):
        alone = sum(n for length, n in held if length > capacity - small)
        half = [(length, n) for length, n in held if capacity / 2 < length <= capacity - small]
        rest = sum(length * n for length, n in held if small <= length <= capacity / 2)
        room = sum((capacity - length) * n for length, n in half)
        best = max(best, alone + sum(n for _, n in half) + max(0, -((room - rest) // capacity)))
    return best


def _lookup(kinds: list[Kind]) -> dict[str, np.ndarray]:
    """Runs of equal places by (length, rank): pieces of one length fill the kinds one after another."""
    rows, taken, first = [], {}, 0
    for kind in kinds:
        for length, copies, offset in kind.held:
            at = taken.get(length, 0)
            rows.append((length * RANKS + at, at, copies, first, offset))
            taken[length] = at + copies * kind.count
        first += kind.count
    if any(n >= RANKS for n in taken.values()):
        raise ValueError("too many pieces of one length")
    return dict(zip(("key", "at", "copies", "first", "offset"), np.array(sorted(rows), np.int64).reshape(-1, 5).T))


def _placed(plan: dict[str, np.ndarray]):
    def place(batches):
        for batch in batches:
            length, rank = (batch.column(c).to_numpy() for c in ("length", "rank"))
            row = np.searchsorted(plan["key"], length * RANKS + rank, side="right") - 1
            k = rank - plan["at"][row]
            kept = [n for n in batch.schema.names if n != "rank"]
            found = {"sequence_id": plan["first"][row] + k // plan["copies"][row], "offset": plan["offset"][row] + k % plan["copies"][row] * length}
            yield pa.record_batch([batch.column(n) for n in kept] + [pa.array(v, pa.int64()) for v in found.values()], [*kept, *found])

    return place


def packed(pieces: DataFrame, capacity: int = 2048) -> DataFrame:
    """pieces, without part and turn, with the `sequence_id` and the `offset` in it of each.

    The histogram comes to the driver and its plan goes to the tasks: `capacity` counts, and per kind of sequence the
    few lengths in it, however many pieces there are. Pieces of one length are numbered by their task's count and the
    tasks' running totals, so a frequent length is no one task's.
    """
    each = pieces.groupBy("part", "length").agg(F.count(F.lit(1)).alias("__n"))
    before = Window.partitionBy("length").orderBy("part").rowsBetween(Window.unboundedPreceding, -1)
    base = each.select("part", "length", F.coalesce(F.sum("__n").over(before), F.lit(0)).alias("__base"))
    counts = {r["length"]: r["n"] for r in pieces.groupBy("length").agg(F.count(F.lit(1)).alias("n")).collect()}
    plan = _lookup(packing_plan(counts, capacity))
    numbered = pieces.join(base, ["part", "length"]).withColumn("rank", F.col("__base") + F.col("turn")).drop("part", "turn", "__base")
    schema = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in numbered.schema if f.name != "rank")
    return numbered.mapInArrow(_placed(plan), f"{schema}, sequence_id long, offset long")


def pack_documents(docs: DataFrame, tokenizer: str, capacity: int = 2048, id_col: str = "doc_id", text_col: str = "text", end_id: int = 0, keep_ids: bool = False) -> DataFrame:
    """One row a piece: id, piece, start, length, ids_crc32, sequence_id, offset, and with `keep_ids` its ids.

    Sequences hold at most `capacity` ids and are filled from 0 without gaps. A null text counts as empty and is the end id alone. Texts of any
    length are encoded whole, then cut. Null ids stay null; rows with one id are separate documents, numbered from piece 0
    each; equal rows get places of their own. An empty table gives no rows. Other columns are ignored.
    """
    out = packed(token_pieces(docs, tokenizer, capacity, id_col, text_col, end_id, keep_ids), capacity)
    names = [id_col if c == "id" else c for c in out.columns]
    return out.toDF(*names).select(id_col, "piece", "start", "length", "ids_crc32", "sequence_id", "offset", *(["ids"] if keep_ids else []))


def token_sequences(pieces: DataFrame) -> DataFrame:
    """(sequence_id, n_tokens, ids): packed pieces with their ids put together, one row a sequence of bounded length."""
    held = pieces.groupBy("sequence_id").agg(F.sum("length").alias("n_tokens"), F.array_sort(F.collect_list(F.struct("offset", "ids"))).alias("held"))
    return held.select("sequence_id", "n_tokens", F.aggregate("held", F.lit(b""), lambda out, p: F.concat(out, p["ids"])).alias("ids"))
