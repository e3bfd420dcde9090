import random
from collections import Counter

import numpy as np
from pyspark.sql import functions as F

from strataloom.llm.bagminhash import signature
from strataloom.llm.neardup import near_duplicates, one_of_each


def test_signature_estimates_weighted_similarity():
    r = np.random.default_rng(5)
    for _ in range(6):
        elements = np.unique(r.integers(1, 2**63, 60).astype(np.uint64))
        a, b = r.integers(0, 9, len(elements)), r.integers(0, 9, len(elements))
        a[:30] = b[:30]
        exact = np.minimum(a, b).sum() / np.maximum(a, b).sum()
        size = 4000
        same = (signature(elements[a > 0], a[a > 0], size) == signature(elements[b > 0], b[b > 0], size)).mean()
        assert abs(same - exact) < 4 * np.sqrt(exact * (1 - exact) / size) + 1e-9


def bag(text):
    w = (text or "").split()
    if not w:
        return Counter()
    return Counter(tuple(w[i : i + 5]) for i in range(len(w) - 4)) if len(w) >= 5 else Counter([tuple(w)])


def brute(rows):
    up = list(range(len(rows)))

    def top(x):
        while up[x] != x:
            x = up[x]
        return x

    bags = [bag(t) for _, t in rows]
    for i in range(len(rows)):
        for j in range(i):
            both = sum((bags[i] & bags[j]).values())
            every = sum((bags[i] | bags[j]).values())
            if (rows[i][1] or "") == (rows[j][1] or "") or every and both / every >= 0.8:
                a, b = top(i), top(j)
                up[max(a, b)] = min(a, b)
    low = {}
    for i, (d, _) in enumerate(rows):
        low[top(i)] = min(low.get(top(i), d), d)
    return sorted((d, low[top(i)]) for i, (d, _) in enumerate(rows))


def corpus(seed, n=120):
    r = random.Random(seed)
    word = lambda: "w%d" % r.randint(0, 3000)
    seeds = [[word() for _ in range(r.randint(1, 120))] for _ in range(20)]
    rows = []
    for d in range(n):
        w = list(r.choice(seeds))
        for _ in range(r.choice([0, 0, 1, 2, 3])):
            at = r.randrange(len(w))
            w[at : at + r.randint(0, 1)] = [word()]
        rows.append((d, r.choice([" ", "\n"]).join(w)))
    hot = [word() for _ in range(150)]
    for d in range(n, 2 * n):  # one large group whose copies differ more from each other than from their source
        w = list(hot)
        for _ in range(r.choice([1, 2, 3, 4, 6])):
            w[r.randrange(len(w))] = word()
        rows.append((d, " ".join(w)))
    return rows + [(900, " ".join(["la"] * 300)), (901, " ".join(["la"] * 330)), (902, " ".join(["la"] * 600))]


def test_brute_force(spark):
    rows = corpus(1) + [(1000, None), (1001, ""), (1002, " \n"), (1003, "two words"), (1004, "two  words"), (3, corpus(1)[3][1]), (1005, "x " * 50_000)]
    docs = spark.createDataFrame(rows, "doc_id long, text string").repartition(4).withColumns({"content": F.lit(1), "first": F.lit("f"), "size": F.lit(0)})
    for block in (512, 16):
        out = near_duplicates(docs, block=block).collect()
        assert sorted((r.doc_id, r.class_id) for r in out) == brute(rows)
        assert all(r.kept == (r.doc_id == r.class_id) for r in out)
    kept = one_of_each(docs)
    assert kept.columns == docs.columns
    assert sorted(r.doc_id for r in kept.collect()) == sorted({c for _, c in brute(rows)})


def test_null_ids_and_empty_table(spark):
    docs = spark.createDataFrame([(None, "a b c d e f"), (4, "a b c d e f"), (None, "q")], "doc_id long, text string")
    assert sorted((str(r.doc_id), str(r.class_id)) for r in near_duplicates(docs).collect()) == [("4", "4"), ("None", "4"), ("None", "None")]
    assert one_of_each(docs).count() == 2
    assert near_duplicates(docs.limit(0)).count() == 0


def test_unrelated_texts_that_share_an_id_are_all_kept(spark):
    rows = [(None, "a b c d e f"), (None, "p q r s t u"), (None, "p q r s t u"), (None, ""), (7, "g h i j k l"), (7, "m n o v w x"), (9, "m n o v w x")]
    kept = one_of_each(spark.createDataFrame(rows, "doc_id long, text string")).collect()
    assert sorted((str(r.doc_id), r.text) for r in kept) == sorted(
        [("None", "a b c d e f"), ("None", "p q r s t u"), ("None", ""), ("7", "g h i j k l"), ("7", "m n o v w x")]
    )
