"""Scores of a hierarchical Pitman-Yor language model of words after words.

A restaurant stands for the whole word before (none at the start of a text); its parent for that word's last
byte, shared by all words that end so; the root for no context; below it lies the uniform
choice among the words seen in training and one for all others. A customer of a restaurant is a token, a
table sends one customer to the parent.

The word decides all dishes that one seating of it touches, so seats are sampled apart for each hash bucket
of words. Documents are dealt into chunks by a hash of their id; a chunk sends the distinct words and pairs of
words of its texts, each once with its training count, and gets back their counts and probabilities. A
restaurant's dishes lie in many buckets: each bucket sends what it holds of a restaurant to that restaurant's
home, another bucket by hash, and gets back the whole corpus's customers and tables.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from strataloom.llm.repeats import chunk_count
from strataloom.llm.seating import TINY, Seating
from strataloom.llm.words import U64, Words, mix

END = U64(0x5E2D58D8B3BCDF1B)
CLASSES = 1 << 8
SENT = "bucket int, chunk int, words binary, counts binary, word_pairs binary, rooms binary, pair_room binary, pair_count binary"
HELD = "bucket int, home int, level int, room binary, customers binary, tables binary, ones long, twos long"
TOLD = "chunk int, bucket int, counts binary, scores binary, n_train long, n_words long"
DEEPEST = -1  # level of rows that tell of the deepest restaurants one by one; 0 of all together
ROOM = ("level", "room", "customers", "tables", "ones", "twos")
RESULT = "id long, held_out boolean, n_tokens long, n_known long, train_tokens long, base_score double, score double"


def _packed(x: np.ndarray) -> bytes:
    """The bytes of numbers by place, compressed: first, second... bytes of all."""
    if not len(x):
        return b""
    return x.nbytes.to_bytes(8, "little") + pa.compress(np.ascontiguousarray(x.view(np.uint8).reshape(len(x), -1).T).tobytes(), codec="zstd", asbytes=True)


def _unpacked(x: bytes, dtype) -> np.ndarray:
    if not x:
        return np.zeros(0, dtype)
    held = np.frombuffer(pa.decompress(x[8:], int.from_bytes(x[:8], "little"), codec="zstd", asbytes=True), np.uint8)
    return np.ascontiguousarray(held.reshape(np.dtype(dtype).itemsize, -1).T).view(dtype).ravel()


class Tokens:
    """Of a chunk: its distinct words in the order of their buckets, its distinct (word, word before), and both of each token."""

    def __init__(self, texts, buckets: int):
        words = Words(texts, fold=True)
        texts_ = len(words.first) - 1
        at = np.arange(len(words)) + words.text_of_word()
        ends = words.first[1:] + np.arange(texts_)
        n = len(words) + texts_
        token, place = np.full(n, END, U64), np.full(n, -1)
        token[at], place[at] = words.hashes(), np.arange(len(words))
        self.text = np.repeat(np.arange(texts_), words.counts + 1)
        self.sizes = words.counts + 1
        assert n == 0 or ends[-1] == n - 1
        known, first, word = np.unique(token, return_index=True, return_inverse=True)
        bucket = ((known >> U64(32)) % U64(buckets)).astype(np.int32)
        order = np.argsort(bucket, kind="stable")
        spot = np.empty(len(known), np.int64)
        spot[order] = np.arange(len(known))
        self.words, self.bucket = known[order], bucket[order]
        self.word = spot[word]
        before = np.r_[len(known), self.word[:-1]][:n]
        before[words.first[:-1] + np.arange(texts_)] = len(known)  # nothing comes before the first
        self.size = len(known) + 1
        self.pairs, self.pair = np.unique(self.word * self.size + before, return_inverse=True)
        self.rooms = np.append(self._contexts(words, place[first[order]]), 0)

    def _contexts(self, words: Words, place: np.ndarray) -> np.ndarray:
        """The restaurant after each word: its last two bytes, and 48 bits of its hash over them if it has more."""
        out, held = np.zeros(len(place), np.int64), place >= 0
        starts, ends = words.starts[place[held]], words.ends[place[held]]
        last = words.data[ends - 1].astype(np.int64)
        second = np.where(ends - starts > 1, words.data[np.maximum(ends - 2, 0)], 0).astype(np.int64)
        longer = np.where(ends - starts > 2, self.words[held] & U64(0xFFFFFFFFFFFF0000), U64(0))
        out[held] = longer.view(np.int64) | second << 8 | last
        return out


def _sent(chunk: int, tokens: Tokens, train: np.ndarray) -> pa.Table:
    learnt = train[tokens.text]
    counts = np.bincount(tokens.word[learnt], minlength=len(tokens.words)).astype(np.int32)
    pair_count = np.bincount(tokens.pair[learnt], minlength=len(tokens.pairs)).astype(np.int32)
    pair_word, before = np.divmod(tokens.pairs, tokens.size)
    word_pairs = np.bincount(pair_word, minlength=len(tokens.words)).astype(np.int32)
    room = tokens.rooms[before]
    cut = np.flatnonzero(np.r_[True, tokens.bucket[1:] != tokens.bucket[:-1]]) if len(tokens.bucket) else np.zeros(0, np.int64)
    to = np.r_[cut[1:], len(tokens.bucket)] if len(cut) else cut
    low, high = np.searchsorted(pair_word, cut), np.searchsorted(pair_word, to)
    rows = list(zip(cut, to, low, high))
    rooms = [np.unique(room[c:d], return_inverse=True) for _, _, c, d in rows]
    return pa.table(
        {
            "bucket": pa.array(tokens.bucket[cut], pa.int32()),
            "chunk": pa.array(np.full(len(cut), chunk, np.int32)),
            "words": pa.array([_packed(tokens.words[a:b]) for a, b, _, _ in rows], pa.binary()),
            "counts": pa.array([_packed(counts[a:b]) for a, b, _, _ in rows], pa.binary()),
            "word_pairs": pa.array([_packed(word_pairs[a:b]) for a, b, _, _ in rows], pa.binary()),
            "rooms": pa.array([_packed(known) for known, _ in rooms], pa.binary()),
            "pair_room": pa.array([_packed(at.astype(np.int32)) for _, at in rooms], pa.binary()),
            "pair_count": pa.array([_packed(pair_count[c:d]) for _, _, c, d in rows], pa.binary()),
        }
    )


class Dishes:
    """All words of a bucket with their counts, and the dishes of the three levels, deepest first; `ids` are the deepest restaurants."""

    def __init__(self, table: pa.Table):
        def column(name, dtype):
            return [_unpacked(x, dtype) for x in table[name].to_pylist()]

        words, rooms, room = column("words", U64), column("rooms", np.int64), column("pair_room", np.int32)
        known, self.word = np.unique(np.concatenate(words), return_inverse=True)
        self.counts = np.bincount(self.word, np.concatenate(column("counts", np.int32)), len(known)).astype(np.int64)
        of = np.repeat(self.word, np.concatenate(column("word_pairs", np.int32)))
        self.ids, at = np.unique(np.concatenate(rooms), return_inverse=True)
        at = at[np.concatenate([r + s for r, s in zip(room, np.cumsum([0, *map(len, rooms)]))])]
        pairs, self.pair = np.unique(of * len(self.ids) + at, return_inverse=True)
        self.customers = np.bincount(self.pair, np.concatenate(column("pair_count", np.int32)), len(pairs)).astype(np.int64)
        of, at = np.divmod(pairs, max(1, len(self.ids)))
        near, up = np.unique(of * CLASSES + (self.ids[at] & (CLASSES - 1)), return_inverse=True)
        self.rooms = [self.ids[at], near % CLASSES, np.zeros(len(known), np.int64)]
        self.up = [up, near // CLASSES]
        self.word_ends, self.pair_ends = np.cumsum([0, *map(len, words)]), np.cumsum([0, *map(len, room)])

    def levels(self) -> list[np.ndarray]:
        """Customers of the dishes of each level while every dish has one table."""
        out = [self.customers]
        for up, room in zip(self.up, self.rooms[1:]):
            out.append(np.bincount(up, out[-1] > 0, len(room)).astype(np.int64))
        return out


def tally(table: pa.Table) -> pa.Table:
    """Of a bucket: customers and tables of each restaurant at first, and dishes with one and with two customers."""
    dishes, rows = Dishes(table), []
    for level, (room, customers) in enumerate(zip(dishes.rooms, dishes.levels())):
        held, at = np.unique(room, return_inverse=True)
        parts = [np.bincount(at, x, len(held)) for x in (customers, customers > 0, customers == 1, customers == 2)]
        rows.append(np.c_[np.full(len(held), level), held, np.stack(parts, axis=1).astype(np.int64)])
    out = np.concatenate(rows)
    return pa.table({n: pa.array(out[:, i]) for i, n in enumerate(ROOM)})


def _dealt(rooms: np.ndarray, homes: int) -> tuple[np.ndarray, np.ndarray]:
    """Restaurants in the order of their homes, and where each home's begin and the last one's end."""
    home = (mix(rooms.view(U64)) >> U64(32)) % U64(homes)
    order = np.argsort(home, kind="stable")
    return order, np.searchsorted(home[order], np.arange(homes + 1))


def _held_rows(rows: list[tuple]) -> pa.Table:
    kinds = [pa.int32(), pa.int32(), pa.int32(), pa.binary(), pa.binary(), pa.binary(), pa.int64(), pa.int64()]
    return pa.table({f.split()[0]: pa.array([r[i] for r in rows], kind) for i, (f, kind) in enumerate(zip(HELD.split(", "), kinds))})


def held_by_home(bucket: int, table: pa.Table, homes: int) -> pa.Table:
    """`tally` of a bucket as rows of arrays: one for each home of the deepest restaurants, and for home 0 the other levels and the deepest level's totals."""
    told = tally(table)
    level, room, customers, tables, ones, twos = (told[c].to_numpy() for c in ROOM)
    rows = []
    for i in range(3):
        own = np.flatnonzero(level == i)
        if i == 0:
            order, ends = _dealt(room[own], homes)
            for home in np.flatnonzero(np.diff(ends)):
                at = own[order[ends[home] : ends[home + 1]]]
                rows.append((bucket, int(home), DEEPEST, _packed(room[at]), _packed(customers[at]), _packed(tables[at]), 0, 0))
        held = (np.zeros(1, np.int64), customers[own].sum(keepdims=True), tables[own].sum(keepdims=True)) if i == 0 else (room[own], customers[own], tables[own])
        rows.append((bucket, 0, i, *map(_packed, held), int(ones[own].sum()), int(twos[own].sum())))
    return _held_rows(rows)


def whole_rooms(home: int, table: pa.Table) -> pa.Table:
    """Restaurants of a home over all buckets: the deepest ones' for each bucket in the order it sent them, the others and totals whole for every bucket."""
    rows, level = [], table["level"].to_numpy()
    for i in np.unique(level):
        own = table.filter(pa.array(level == i))
        ids, customers, tables = ([_unpacked(x, np.int64) for x in own[c].to_pylist()] for c in ("room", "customers", "tables"))
        known, at = np.unique(np.concatenate(ids), return_inverse=True)
        whole = [np.bincount(at, np.concatenate(x), len(known)).astype(np.int64) for x in (customers, tables)]
        ends = np.cumsum([0, *map(len, ids)])
        if i != DEEPEST:
            packed, ones, twos = [*map(_packed, (known, *whole))], *(int(own[c].to_numpy().sum()) for c in ("ones", "twos"))
        for bucket, a, b in zip(own["bucket"].to_pylist(), ends, ends[1:]):
            rows.append((bucket, home, int(i), None, *(_packed(x[at[a:b]]) for x in whole), 0, 0) if i == DEEPEST else (bucket, home, int(i), *packed, ones, twos))
    return _held_rows(rows)


def _seat(dishes: Dishes, rooms: list[dict], n_words: int, sweeps: int, burn_in: int, strength: float, seed: int) -> np.ndarray:
    """Probability of each dish of the deepest level, averaged over the sweeps after `burn_in`.

    A sweep reseats every customer of every dish: shares of the dishes are drawn from the root down, then customers are
    seated from the deepest level up, tables coming in as customers of the parent. A restaurant's tables in other buckets
    are taken to have changed like this bucket's own of that level.
    """
    rng = np.random.default_rng(seed)
    place = [np.searchsorted(rooms[0]["ids"], dishes.rooms[0]), *dishes.rooms[1:]]
    seats = [Seating(c, r["discount"], rng) for c, r in zip(dishes.levels(), rooms)]
    sizes = [len(r["tables"]) for r in rooms]
    first = [max(1, int(s.tables.sum())) for s in seats]

    def held(i: int, what: str) -> np.ndarray:
        return np.bincount(place[i], getattr(seats[i], what), sizes[i])

    apart = {(i, w): rooms[i][w] - held(i, w) for i in range(3) for w in ("tables", "customers")}  # in other buckets
    uniform = np.full(len(place[2]), 1.0 / (n_words + 1))
    summed = np.zeros(len(place[0]))

    def tables(i: int) -> np.ndarray:
        return apart[i, "tables"] * (seats[i].tables.sum() / first[i]) + held(i, "tables")

    def customers(i: int) -> np.ndarray:
        grown = seats[i - 1].tables.sum() / first[i - 1] if i else 1.0  # each table below is a customer here
        return apart[i, "customers"] * grown + held(i, "customers")

    def predictive(i: int) -> np.ndarray:
        below = uniform if i == 2 else predictive(i + 1)[dishes.up[i]]
        own = np.maximum(seats[i].customers - seats[i].discount * seats[i].tables, 0.0)
        spare = (strength + rooms[i]["discount"] * tables(i))[place[i]]
        return (own + spare * below) / (strength + customers(i)[place[i]])

    for sweep in range(sweeps):
        # from the root down, the share of each dish in its restaurant; given these, dishes are seated apart from each other
        weights, share = [], uniform
        for i in (2, 1, 0):
            discount = rooms[i]["discount"]
            weights.append((discount * rng.standard_gamma(strength / discount + np.maximum(tables(i), 0.0)))[place[i]] * share)
            if i:
                mass = seats[i].masses(weights[-1])
                own = np.bincount(place[i], mass, sizes[i])
                total = strength + customers(i)
                here = np.bincount(place[i], seats[i].customers - discount * seats[i].tables + weights[-1], sizes[i])
                share = (mass / np.maximum(own + rng.standard_gamma(np.maximum(total - here, TINY)), TINY)[place[i]])[dishes.up[i - 1]]
        come = dishes.customers
        for i in range(3):
            seats[i].reseat(come, weights[2 - i])
            seats[i].renew(weights[2 - i])
            if i < 2:  # every table is a customer of the parent
                come = np.bincount(dishes.up[i], seats[i].tables, len(dishes.rooms[i + 1])).astype(np.int64)
        if sweep >= burn_in:
            summed += predictive(0)
    return summed / (sweeps - burn_in)


def _rooms(model: pa.Table) -> tuple[list[dict], int, int]:
    """ids, customers, tables and discount of each level's restaurants; training tokens; training words. From rows of `tally`."""
    rows = np.array([[r[c] for c in ROOM] for r in model["rooms"][0].as_py()], np.int64).reshape(-1, 6)
    return _levels([[r[:, 1], r[:, 2], r[:, 3], r[:, 4].sum(), r[:, 5].sum()] for r in (rows[rows[:, 0] == i] for i in range(3))])


def _levels(held: list[list]) -> tuple[list[dict], int, int]:
    """As `_rooms`, from the ids, customers and tables of each level's restaurants and their dishes with one and two customers."""
    rooms = []
    for level, (ids, customers, tables, ones, twos) in enumerate(held):
        room = {"ids": ids, "customers": customers.astype(float), "tables": tables.astype(float), "discount": min(0.95, max(0.1, (ones + 1) / (ones + 2 * twos + 2)))}
        if level:  # numbered by their bytes
            for c in ("customers", "tables"):
                room[c] = np.bincount(ids, room[c], (0, CLASSES, 1)[level])
        rooms.append(room)
    return rooms, int(rooms[0]["customers"].sum()), int(rooms[2]["tables"].sum())


def _told_rooms(dishes: Dishes, told: pa.Table, homes: int) -> tuple[list[dict], int, int]:
    """As `_rooms`, of the restaurants of a bucket: the deepest ones' totals in the order they were sent, the others' of all homes."""
    level = told["level"].to_numpy()

    def joined(rows: pa.Table, name: str) -> np.ndarray:
        return np.concatenate([np.zeros(0, np.int64), *(_unpacked(x, np.int64) for x in rows[name].to_pylist())])

    held = []
    for i in range(3):
        rows = told.filter(pa.array(level == i))
        held.append([joined(rows, "room"), joined(rows, "customers"), joined(rows, "tables"), int(rows["ones"].to_numpy().sum()), int(rows["twos"].to_numpy().sum())])
    n_train = int(held[0][1].sum())
    answers = told.filter(pa.array(level == DEEPEST)).sort_by("home")
    order, _ = _dealt(dishes.ids, homes)
    held[0][0] = dishes.ids
    for i, name in ((1, "customers"), (2, "tables")):
        held[0][i] = np.empty(len(order), np.int64)
        held[0][i][order] = joined(answers, name)
    rooms, _, n_words = _levels(held)
    return rooms, n_train, n_words


def lm_scores(
    docs: DataFrame,
    learn: Column,
    id_col: str = "doc_id",
    text_col: str = "text",
    sweeps: int = 6,
    burn_in: int = 2,
    strength: float = 20.0,
    chunks: int | None = None,
    seed: int = 11,
) -> DataFrame:
    """One row a document: id, held_out, n_tokens, n_known, train_tokens, base_score, score.

    The model learns from the rows where `learn` holds, all of them, and scores every whole text. Tokens are the
    words, A-Z in lower case, and one end. base_score is the add-one score by word counts; score is the sum of
    log10 of the model's probabilities. Perplexity of a set is 10 ** -(sum of score / sum of n_tokens).

    Discounts come from the numbers of dishes with one and two customers. Seats start at one table a dish and
    are Gibbs-sampled `sweeps` times, all customers each time; probabilities are averaged over the sweeps after `burn_in`. Words are
    told apart by 64-bit hashes. A null or empty text is its end alone; a null id is kept; rows with one id are
    separate documents. Without training rows every token has probability 1. An empty table gives no rows.
    """
    chunks = chunks or chunk_count(docs)
    key = F.col(id_col).cast("long")
    base = docs.select(
        F.pmod(F.xxhash64(key, F.col(text_col).cast("string")), F.lit(chunks)).cast("int").alias("chunk"), key.alias("id"), F.col(text_col).cast("string").alias("text"), F.coalesce(learn, F.lit(False)).alias("learnt")
    )

    def count(key, table):
        return _sent(key[0].as_py(), Tokens(table["text"], chunks), table["learnt"].to_numpy())

    def seat(key, table, model):
        if not table.num_rows:
            return pa.table({"chunk": pa.array([], pa.int32()), "bucket": pa.array([], pa.int32()), "counts": pa.array([], pa.binary()), "scores": pa.array([], pa.binary()), "n_train": pa.array([], pa.int64()), "n_words": pa.array([], pa.int64())})
        order = pa.array(np.argsort(table["chunk"].to_numpy(), kind="stable"))
        table = table.take(order)
        dishes = Dishes(table)
        rooms, n_train, n_words = _told_rooms(dishes, model, chunks)
        scores = np.log10(_seat(dishes, rooms, n_words, sweeps, burn_in, strength, seed + key[0].as_py())).astype(np.float32)[dishes.pair]
        counts = dishes.counts[dishes.word]
        n = table.num_rows
        return pa.table(
            {
                "chunk": table["chunk"],
                "bucket": table["bucket"],
                "counts": pa.array([_packed(counts[a:b]) for a, b in zip(dishes.word_ends, dishes.word_ends[1:])], pa.binary()),
                "scores": pa.array([_packed(scores[a:b]) for a, b in zip(dishes.pair_ends, dishes.pair_ends[1:])], pa.binary()),
                "n_train": pa.array(np.full(n, n_train)),
                "n_words": pa.array(np.full(n, n_words)),
            }
        )

    def score(key, table, told):
        tokens = Tokens(table["text"], chunks)
        order = np.argsort(told["bucket"].to_numpy(), kind="stable")
        parts = told["counts"].to_pylist(), told["scores"].to_pylist()
        counts = np.concatenate([_unpacked(parts[0][i], np.int64) for i in order])[tokens.word]
        scores = np.concatenate([_unpacked(parts[1][i], np.float32) for i in order]).astype(np.float64)[tokens.pair]
        n_train, n_words = told["n_train"][0].as_py(), told["n_words"][0].as_py()
        n = table.num_rows
        base = np.bincount(tokens.text, np.log10(counts + 1.0), n) - tokens.sizes * np.log10(n_train + n_words + 1.0)
        return pa.table(
            {
                "id": table["id"],
                "held_out": pa.array(~table["learnt"].to_numpy()),
                "n_tokens": pa.array(tokens.sizes.astype(np.int64)),
                "n_known": pa.array(np.bincount(tokens.text, counts > 0, n).astype(np.int64)),
                "train_tokens": pa.array(np.full(n, n_train)),
                "base_score": pa.array(base),
                "score": pa.array(np.bincount(tokens.text, scores, n)),
            }
        )

    sent = base.groupBy("chunk").applyInArrow(count, SENT)
    held = sent.groupBy("bucket").applyInArrow(lambda key, table: held_by_home(key[0].as_py(), table, chunks), HELD)
    model = held.groupBy("home").applyInArrow(lambda key, table: whole_rooms(key[0].as_py(), table), HELD)
    told = sent.groupBy("bucket").cogroup(model.groupBy("bucket")).applyInArrow(seat, TOLD)
    return base.groupBy("chunk").cogroup(told.groupBy("chunk")).applyInArrow(score, RESULT).withColumnRenamed("id", id_col)
