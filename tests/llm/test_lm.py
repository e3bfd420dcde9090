import math
import random
import re
from collections import Counter

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from strataloom.llm.lm import Dishes, Tokens, _rooms, _seat, _sent, _told_rooms, held_by_home, lm_scores, tally, whole_rooms
from strataloom.llm.seating import Seating, unseen_mass

WORD = re.compile(rb"[^\x20\x09-\x0D]+")
LOW = bytes.maketrans(bytes(range(65, 91)), bytes(range(97, 123)))


def tokens(text):
    return WORD.findall((text or "").encode().translate(LOW)) + [b""]


def corpus(n=300):
    r = random.Random(8)
    tongues = [["the", "of", "House", "tree%d", "cat%d"], ["der", "und", "Haus", "baum%d", "katze%d"]]
    out = []
    for d in range(n):
        words = r.choice(tongues)
        picked = (r.choice(words) for _ in range(r.randint(0, 60)))
        out.append((d, " ".join(w % r.randint(0, 300) if "%" in w else w for w in picked)))
    return out + [(1000, None), (1001, ""), (1002, "Ünder ÉTÉ é"), (5, out[5][1]), (None, "the house")]


def test_seating_keeps_its_counts():
    r = np.random.default_rng(2)
    customers = np.array([0, 1, 2, 50, 7])
    s = Seating(customers, 0.5, r)
    for _ in range(200):
        s.move(np.arange(5), lambda d: np.full(len(d), 3.0))
        assert (s.customers == customers).all()
        assert (np.bincount(s.dish, s.size, 5) == customers).all() and (np.bincount(s.dish, minlength=5) == s.tables).all()
        assert (s.tables[1:] >= 1).all() and (s.tables <= customers).all()
    assert s.tables[3] > 1


def test_seating_follows_the_restaurant():
    """Mean tables of one dish of c customers against the exact distribution, from the chain rule of the process."""
    c, discount, weight = 6, 0.5, 0.4  # weight: (strength + discount * tables elsewhere) * base, held fixed
    ways = {1: 1.0}  # Stirling-like numbers of seatings of k customers at t tables
    for k in range(1, c):
        new = Counter()
        for t, x in ways.items():
            new[t] += x * (k - discount * t)
            new[t + 1] += x
        ways = new
    total = {t: x * weight**t for t, x in ways.items()}
    exact = sum(t * x for t, x in total.items()) / sum(total.values())
    s = Seating(np.full(4000, c), discount, np.random.default_rng(3))
    seen = []
    for step in range(80):
        s.move(np.arange(4000), lambda d: np.full(len(d), weight))
        if step >= 40:
            seen.append(s.tables.mean())
    assert abs(np.mean(seen) - exact) < 0.02


def test_base_score_and_gain(spark):
    data = corpus()
    docs = spark.createDataFrame(data, "doc_id long, text string").withColumns({"id": F.lit("x"), "chunk": F.lit(1), "learnt": F.lit(2)})
    learn = (F.col("doc_id") % 4 != 1) | F.col("doc_id").isNull()
    out = lm_scores(docs, learn, chunks=5).collect()
    assert len(out) == len(data)
    trained = [t for d, t in data if d is None or d % 4 != 1]
    counts = Counter(w for t in trained for w in tokens(t))
    n, v = sum(counts.values()), len(counts)
    texts = {d: t for d, t in data}
    for r in out:
        t = tokens(texts[r.doc_id])
        assert r.held_out == (r.doc_id is not None and r.doc_id % 4 == 1)
        assert (r.n_tokens, r.n_known, r.train_tokens) == (len(t), sum(counts[w] > 0 for w in t), n)
        assert math.isclose(r.base_score, sum(math.log10((counts[w] + 1) / (n + v + 1)) for w in t), rel_tol=1e-9)
        assert r.score < 0
    held = [r for r in out if r.held_out]
    assert sum(r.score for r in held) > sum(r.base_score for r in held)
    again = {(r.doc_id, r.n_tokens): r.score for r in lm_scores(docs.repartition(3), learn, chunks=5).collect()}
    assert all(math.isclose(again[r.doc_id, r.n_tokens], r.score, rel_tol=1e-9) for r in out)


def test_probabilities_sum_to_one():
    """After one context, all training words, the end and one unknown word share probability 1."""
    train = ["a b", "a c", "a b c", "b a", "a b b", "c a b"]
    probes = [f"a {w}" for w in ["a", "b", "c", "zz"]] + ["a"]
    tokens_ = Tokens(pa.array(train + probes), 1)
    sent = _sent(0, tokens_, np.arange(len(train + probes)) < len(train))
    rows = [{n: v for n, v in r.items()} for r in tally(sent).to_pylist()]
    rooms, n_train, n_words = _rooms(pa.table({"rooms": [rows]}))
    assert (n_train, n_words) == (sum(len(tokens(t)) for t in train), 4)
    dishes = Dishes(sent)
    p = _seat(dishes, rooms, n_words, 3, 2, 2.0, 1)
    after_a = dishes.rooms[0] == ord("a")
    assert after_a.sum() == 5 and abs(p[after_a].sum() - 1) < 1e-9


def test_no_training_rows_and_empty_table(spark):
    docs = spark.createDataFrame([(1, "a b"), (2, None)], "doc_id long, text string")
    out = lm_scores(docs, F.lit(False)).collect()
    assert all(abs(r.score) < 1e-6 and r.base_score == 0 and r.train_tokens == 0 for r in out) and len(out) == 2
    assert lm_scores(docs.limit(0), F.lit(True)).count() == 0


def exact_tables(c, discount, weight, most):
    """Chances of 1 to `most` tables of a dish with c customers, by adding customers one by one."""
    ways = np.zeros(most + 1)
    ways[1] = 1.0
    t = np.arange(most + 1)
    for k in range(1, c):
        ways = ways * (k - discount * t) + np.r_[0.0, ways[:-1] * weight]
        ways /= ways.sum()
    return ways


@pytest.mark.parametrize("c, discount, weight", [(2, 0.5, 0.4), (6, 0.8, 3.0), (40, 0.3, 0.02), (40, 0.6, 30.0), (10_000, 0.5, 2.0), (10_000, 0.7, 20.0)])
def test_reseating_all_customers_follows_the_exact_law(c, discount, weight):
    """From one table a dish a few steps lead to the exact distribution of tables, with thousands of customers too."""
    n = 1500
    exact = exact_tables(c, discount, weight, min(c, 400))
    mean = (exact * np.arange(len(exact))).sum()
    deviation = np.sqrt((exact * np.arange(len(exact)) ** 2).sum() - mean**2)
    s = Seating(np.r_[np.full(n, c), 0, 1], discount, np.random.default_rng(5))
    for _ in range(20):
        s.reseat(s.customers, np.full(n + 2, weight))
        s.renew(np.full(n + 2, weight))
        assert (np.bincount(s.dish, s.size, n + 2) == s.customers).all() and (s.customers == np.r_[np.full(n, c), 0, 1]).all()
        assert (np.bincount(s.dish, minlength=n + 2) == s.tables).all() and (s.size > 0).all() and (s.tables[n:] == [0, 1]).all()
    assert abs(s.tables[:n].mean() - mean) < 4 * deviation / math.sqrt(n)
    assert abs((s.tables[:n] == 1).mean() - exact[1]) < 4 * math.sqrt(exact[1] * (1 - exact[1]) / n) + 1e-3


def test_reseating_takes_more_or_fewer_customers():
    s = Seating(np.array([1, 50, 9000, 3]), 0.6, np.random.default_rng(1))
    for customers in ([7, 1, 20_000, 2], [1, 60, 2, 2], [1, 1, 1, 900]):
        s.reseat(np.array(customers), np.array([1.0, 1e-9, 500.0, 0.0]))
        assert (np.bincount(s.dish, s.size, 4) == customers).all() and (s.tables >= 1).all()


def test_unseen_mass_has_its_mean_and_spread():
    for weight, d in ((0.05, 0.5), (2.0, 0.8), (30.0, 0.3)):
        u = unseen_mass(np.full(100_000, weight), d, np.random.default_rng(4))
        assert abs(u.mean() - weight) < 5 * math.sqrt(weight * (1 - d) / 100_000) and abs(u.var() / (weight * (1 - d)) - 1) < 0.15


def test_a_frequent_pair_leaves_its_first_table(monkeypatch):
    """A pair of thousands of tokens takes as many tables as its exact law gives, after all sweeps, not one more a sweep."""
    train = ["xa b"] * 4000 + [f"xa w{i}" for i in range(300)] + [f"y{c} b" for c in "cdefgh" for _ in range(50)]
    sent = _sent(0, Tokens(pa.array(train), 1), np.ones(len(train), bool))
    rooms, _, n_words = _rooms(pa.table({"rooms": [tally(sent).to_pylist()]}))
    dishes = Dishes(sent)
    held = []
    monkeypatch.setattr("strataloom.llm.lm.Seating", lambda *args: held.append(Seating(*args)) or held[-1])
    _seat(dishes, rooms, n_words, 6, 2, 20.0, 1)
    at = np.argmax(dishes.customers * (dishes.rooms[0] == (ord("x") << 8 | ord("a"))))
    assert dishes.customers[at] == 4000 and held[0].customers[at] == 4000
    assert (held[1].customers == np.bincount(dishes.up[0], held[0].tables)).all() and (held[2].customers == np.bincount(dishes.up[1], held[1].tables)).all()
    assert held[0].tables[at] > 7


def seated(train, probes, buckets, sweeps=3):
    """log10 probability of each token of the probes, all buckets' restaurants met by way of their homes."""
    texts = train + probes
    tokens_ = Tokens(pa.array(texts), buckets)
    sent = _sent(0, tokens_, np.arange(len(texts)) < len(train))
    parts = {b: sent.filter(pa.array(sent["bucket"].to_numpy() == b)) for b in sent["bucket"].to_pylist()}
    held = pa.concat_tables(held_by_home(b, part, buckets) for b, part in parts.items())
    whole = pa.concat_tables(whole_rooms(h, held.filter(pa.array(held["home"].to_numpy() == h))) for h in set(held["home"].to_pylist()))
    scores, rooms = [], {}
    for b, part in parts.items():
        dishes = Dishes(part)
        rooms[b], n_train, n_words = _told_rooms(dishes, whole.filter(pa.array(whole["bucket"].to_numpy() == b)), buckets)
        scores.append(np.log10(_seat(dishes, rooms[b], n_words, sweeps, 1, 2.0, b))[dishes.pair])
    return np.concatenate(scores)[tokens_.pair], tokens_, rooms, n_train, n_words


def test_contexts_are_whole_words():
    """Words that end alike are told apart as contexts, in any script."""
    train = ["xxnight moon", "yynight sword"] * 200 + ["ночь луна", "речь слово"] * 200
    scores, tokens_, *_ = seated(train, ["xxnight moon", "xxnight sword", "ночь луна", "речь луна"], 1)
    second = [scores[tokens_.text == len(train) + i][1] for i in range(4)]
    assert second[0] > second[1] + 1 and second[2] > second[3] + 1


def test_restaurants_count_all_buckets():
    """Customers and tables of a restaurant are those of the whole corpus in every bucket that holds some of it, whichever its dishes."""
    train = [t for _, t in corpus(120) if t]
    followed, pairs, near = Counter(), set(), set()
    for t in train:
        words = tokens(t)
        for before, word in zip([b"", *words], words):
            followed[before] += 1
            pairs.add((before, word))
            near.add((before[-1:], word))
    tables, above = Counter(before for before, _ in pairs), Counter(last for last, _ in near)
    name = {}
    for w in followed:
        held = Tokens(pa.array([f"{w.decode()} x" if w else "x"]), 1)
        name[int(held.rooms[held.word[0]]) if w else 0] = w
    for buckets in (1, 7):
        _, _, rooms, n_train, n_words = seated(train, [], buckets, 2)
        assert n_train == sum(followed.values()) and n_words == len({w for _, w in pairs})
        for b in rooms:
            words = [name[int(i)] for i in rooms[b][0]["ids"]]
            assert rooms[b][0]["customers"].tolist() == [followed[w] for w in words] and rooms[b][0]["tables"].tolist() == [tables[w] for w in words]
            assert rooms[b][1]["tables"][ord("e")] == above[b"e"] and rooms[b][1]["customers"].sum() == len(pairs)


def test_texts_that_occur_twice_are_scored_apart(spark):
    """A learnt text whose like occurs elsewhere in the corpus is likelier than others, whichever chunks the two are in."""
    r = random.Random(3)
    words = [f"{a}{b}{c}" for a in ("ka", "lo", "mi", "nu") for b in ("re", "sa", "to") for c in ("n", "r", "st", "th", "e")]
    texts = [" ".join(r.choice(words) for _ in range(60)) for _ in range(240)]
    docs = spark.createDataFrame([*enumerate(texts), *((1000 + i, texts[i]) for i in range(40))], "doc_id long, text string")
    score = {x.doc_id: x.score / x.n_tokens for x in lm_scores(docs, F.col("doc_id") % 7 != 2, chunks=4).collect()}
    learnt = [i for i in range(240) if i % 7 != 2]
    twice, once = ([score[i] for i in learnt if (i < 40) == both] for both in (True, False))
    assert sum(x > max(sorted(once)[: -len(once) // 10]) for x in twice) > 0.8 * len(twice)
