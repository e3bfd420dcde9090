import random

from pyspark.sql import functions as F

from strataloom.llm.decontaminate import contaminated, myers, normal


def distance(pattern, text):
    column = list(range(len(pattern) + 1))
    best = column[-1]
    for c in text:
        before, column[0] = column[0], 0
        for i in range(1, len(pattern) + 1):
            before, column[i] = column[i], min(column[i] + 1, column[i - 1] + 1, before + (pattern[i - 1] != c))
        best = min(best, column[-1])
    return best


def edited(text, edits, r):
    s = list(text)
    for _ in range(edits):
        at = r.randrange(len(s))
        kind = r.random()
        if kind < 0.4:
            s[at] = r.choice("abcé ")
        elif kind < 0.7:
            del s[at]
        else:
            s.insert(at, r.choice("xyz"))
    return "".join(s)


def test_myers_against_table():
    r = random.Random(3)
    for _ in range(300):
        p = "".join(r.choice("abc") for _ in range(r.randint(1, 90)))
        t = edited("".join(r.choice("abc") for _ in range(5)) + p, r.randint(0, 9), r) + "cab"
        found, end = myers(p, t)
        assert found == distance(p, t) == distance(p, t[:end])


def test_brute_force(spark):
    r = random.Random(4)
    words = ["alpha", "beta", "gamma", "dél", "of", "the", "X", "rho"]
    text = lambda n: " ".join(r.choice(words) + str(r.randrange(30)) for _ in range(n))
    items = [(i, text(r.randint(6, 30))) for i in range(8)] + [(8, None), (9, ""), (10, "ab"), (3, text(12))]
    docs = []
    for d in range(90):
        t = text(r.randint(0, 60))
        if d % 2:
            t += "\n" + edited(r.choice([x for _, x in items[:8]]), r.randint(0, 20), r).upper() + "  " + text(5)
        docs.append((d, t))
    docs += [(100, None), (101, ""), (5, docs[5][1]), (102, "q" * 100_000 + items[0][1])]
    held = spark.createDataFrame(docs, "doc_id long, text string").withColumns({"item_id": F.lit("clash"), "distance": F.lit(1)})
    bench = spark.createDataFrame(items, "item_id long, text string").withColumn("doc_id", F.lit(0))
    got = sorted((x.doc_id, x.item_id, x.distance) for x in contaminated(held, bench).collect())
    expected = []
    for d, t in docs:
        for i, item in items:
            if item:
                k = distance(normal(item), normal(t))
                if k <= int(len(normal(item)) * 0.1):
                    expected.append((d, i, k))
    assert got == sorted(expected) and len(got) > 20
    for x in contaminated(held, bench).collect():
        part = normal(dict(docs)[x.doc_id])[x.from_char : x.to_char]
        assert min(distance(normal(t), part) for i, t in items if i == x.item_id) == x.distance
    assert contaminated(held.limit(0), bench).count() == 0 and contaminated(held, bench.limit(0)).count() == 0
