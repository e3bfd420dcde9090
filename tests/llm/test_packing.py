import random
import zlib
from array import array
from collections import Counter, defaultdict

import numpy as np
import public_tokenizers
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from strataloom.llm.packing import Encoder, Instance, cuts, least_sequences, pack_documents, packing_plan, token_sequences

PATH = public_tokenizers.path("byte_bpe_50k.json")


def fewest(lengths, capacity):
    """The least number of bins, by trying everything."""
    lengths = sorted(lengths, reverse=True)
    best = [len(lengths)]

    def place(i, bins):
        if len(bins) >= best[0]:
            return
        if i == len(lengths):
            best[0] = len(bins)
            return
        for room in sorted({b for b in bins if b >= lengths[i]}):
            k = bins.index(room)
            place(i + 1, bins[:k] + [room - lengths[i]] + bins[k + 1 :])
        place(i + 1, bins + [capacity - lengths[i]])

    place(0, [])
    return best[0]


def unpacked(kinds, capacity):
    out = Counter()
    for kind in kinds:
        at = 0
        for length, copies, offset in kind.held:
            assert offset == at and copies > 0
            at += length * copies
            out[length] += copies * kind.count
        assert at == kind.used <= capacity and kind.count > 0
    return out


@settings(max_examples=150, deadline=None)
@given(st.lists(st.integers(1, 20), max_size=9), st.just(20))
def test_reduction_loses_no_best_packing(lengths, capacity):
    instance = Instance(Counter(lengths), capacity)
    fixed = instance.reduce()
    rest = [length for length, n in enumerate(instance.counts) for _ in range(n)]
    assert sum(k.count for k in fixed) + fewest(rest, capacity) == fewest(lengths, capacity)
    assert unpacked(fixed, capacity) + Counter(rest) == Counter(lengths)
    assert least_sequences(Counter(lengths), capacity) <= fewest(lengths, capacity)


def one_by_one(lengths, capacity):
    rooms = []
    for length in sorted(lengths, reverse=True):
        fit = [r for r in rooms if r >= length]
        if fit:
            rooms.remove(min(fit))
            rooms.append(min(fit) - length)
        else:
            rooms.append(capacity - length)
    return sorted(rooms)


@settings(max_examples=150, deadline=None)
@given(st.lists(st.integers(1, 50), max_size=120))
def test_best_fit_in_bulk_equals_one_piece_at_a_time(lengths):
    kinds = Instance(Counter(lengths), 50).best_fit()
    assert unpacked(kinds, 50) == Counter(lengths)
    assert sorted(50 - k.used for k in kinds for _ in range(k.count)) == one_by_one(lengths, 50)


def test_large_instances_come_near_the_bound():
    r = np.random.default_rng(5)
    lengths = Counter(np.clip(r.lognormal(5.5, 1.3, 300_000).astype(int), 1, 2048).tolist())
    kinds = packing_plan(lengths, 2048)
    assert unpacked(kinds, 2048) == lengths
    bound = least_sequences(lengths, 2048)
    assert bound <= sum(k.count for k in kinds) <= 1.001 * bound + 1
    assert len(kinds) < 20_000


def test_fixed_sets():
    # exact pairs go together, a piece beside which nothing fits stands alone
    instance = Instance({9: 3, 1: 2, 10: 4, 6: 1, 5: 1}, 10)
    fixed = instance.reduce()
    assert sum(k.count for k in fixed) == 4 + 3 + 2 and not any(instance.counts)
    with pytest.raises(ValueError):
        Instance({11: 1}, 10)


def test_cuts():
    assert cuts(5, 5) == [(0, 5)] and cuts(6, 5) == [(0, 1), (1, 6)] and cuts(10, 5) == [(0, 5), (5, 10)] and cuts(1, 5) == [(0, 1)]


TEXTS = ["", " ", "  ", "a", " a", "a  b", "don't we'll I'M", "x\n\n y", "x\n\ny", "a \n b", "tail  ", "\t\ta", "日本語 テキスト", "é\u00a0b", "a\u3000 b", "a \u2003b", "123 4567", "!?! (x)", "😀😀 x", "a<|endoftext|>b",
         "x  <|endoftext|>  y", "\u180e a", "a\x1cb \x1f c", "\x85x", "e\u0301 \u0301", "a\r\n b", " " * 50 + "x", "a" * 5000, "\u200b \u200d", "ſ's \u2019s 's"]


def test_encoder_equals_the_tokenizer():
    held = Encoder(PATH)
    r = random.Random(4)
    plain = lambda t: array("I", held.tokenizer.encode(t, add_special_tokens=False).ids).tobytes()
    for _ in range(4000):
        text = "".join(r.choice(TEXTS) + r.choice(["", " ", "\n", "  ", "\u00a0"]) for _ in range(r.randint(0, 6)))
        assert held.encode(text) == plain(text), repr(text)
    alphabet = [" ", " ", "\n", "a", "b", "'", "s", "1", ".", "é", "\u2009", "語", "\u0300", "<|"]
    for _ in range(4000):
        text = "".join(r.choice(alphabet) for _ in range(r.randint(0, 14)))
        assert held.encode(text) == plain(text), repr(text)


def test_documents_packed(spark):
    r = random.Random(2)
    rows = [(i, r.choice(["", "word ", "some longer words, "]) * r.choice([0, 1, 5, 40, 300])) for i in range(300)]
    rows += [(400, None), (401, "lorem ipsum " * 30_000), (5, rows[5][1]), (None, "x"), (None, "x"), (None, None), (402, "z" * 200_000)]
    clash = {c: F.lit("c") for c in ("id", "part", "turn", "rank", "piece", "length", "start", "ids")}
    docs = spark.createDataFrame(rows, "doc_id long, text string").repartition(7).withColumns(clash)
    out = pack_documents(docs, PATH, 64, keep_ids=True)
    found = out.collect()
    held = Encoder(PATH)
    expected = Counter()
    for d, t in rows:
        ids = array("I", held.tokenizer.encode(t or "", add_special_tokens=False).ids + [0]).tobytes()
        for k, (a, b) in enumerate(cuts(len(ids) // 4, 64)):
            expected[d, k, a, b - a, zlib.crc32(ids[4 * a : 4 * b]), ids[4 * a : 4 * b]] += 1
    assert Counter((x.doc_id, x.piece, x.start, x.length, x.ids_crc32, bytes(x.ids)) for x in found) == expected
    by = defaultdict(list)
    for x in found:
        by[x.sequence_id].append((x.offset, x.length, bytes(x.ids)))
    for held_ in by.values():
        at = 0
        for offset, length, _ in sorted(held_):
            assert offset == at
            at += length
        assert at <= 64
    assert len(by) <= least_sequences(Counter(x.length for x in found), 64) + 1
    whole = {s.sequence_id: bytes(s.ids) for s in token_sequences(out).collect()}
    assert whole.keys() == by.keys()
    assert all(Counter(p for *_, p in held_).keys() and len(whole[s]) == 4 * sum(n for _, n, _ in held_) and all(whole[s][4 * o :].startswith(p) for o, _, p in held_) for s, held_ in by.items())
    assert pack_documents(docs.limit(0), PATH).count() == 0
