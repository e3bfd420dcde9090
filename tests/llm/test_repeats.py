import random
import re

from strataloom.llm.repeats import chunked, remove_repeats

WORD = re.compile(r"[^\x20\x09-\x0D]+")


def brute(rows, window):
    first = {}
    for d, t in rows:
        w = WORD.findall(t or "")
        for i in range(len(w) - window + 1):
            k = tuple(w[i : i + window])
            first[k] = min(first.get(k, d), d)
    out = []
    for d, t in rows:
        w = WORD.findall(t or "")
        gone = set()
        for i in range(len(w) - window + 1):
            if first[tuple(w[i : i + window])] < d:
                gone.update(range(i, i + window))
        out.append((d, len(w), len(gone), " ".join(x for i, x in enumerate(w) if i not in gone)))
    return sorted(out)


def corpus(seed, n=60):
    r = random.Random(seed)
    vocabulary = ["w%d" % i for i in range(40)] + ["é", "ünder", "x y"]
    passages = [[r.choice(vocabulary) for _ in range(r.randint(5, 30))] for _ in range(6)]
    rows = []
    for d in range(n):
        w = []
        for _ in range(r.randint(0, 6)):
            w += r.choice(passages) if r.random() < 0.5 else [r.choice(vocabulary) for _ in range(r.randint(1, 20))]
        rows.append((d, r.choice([" ", "\n", " \t\x0b "]).join(w)))
    return rows


def test_brute_force(spark):
    rows = corpus(1) + [(100, None), (101, ""), (102, " \n "), (103, "only five words are here"), (3, corpus(1)[5][1]), (3, corpus(1)[5][1])]
    rows += [(200 + i, "the same long passage of sixteen words stands in every one of these many rows again") for i in range(40)]
    rows += [(300, "a" * 200_000 + " " + " ".join(["b"] * 50)), (301, " ".join(["b"] * 30) + " " + "a" * 200_000)]
    docs = spark.createDataFrame(rows, "doc_id long, text string").withColumn("chunk", docs_note()).withColumn("id", docs_note())
    got = sorted(map(tuple, remove_repeats(docs).select("doc_id", "n_words", "n_removed", "kept_text").collect()))
    assert got == brute(rows, 13)


def docs_note():
    from pyspark.sql import functions as F

    return F.lit("clash")


def test_spans_and_small_windows(spark):
    rows = corpus(2, 30)
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    out = remove_repeats(docs, window=4, seed=2, chunks=3).collect()
    assert sorted((r.doc_id, r.n_words, r.n_removed, r.kept_text) for r in out) == brute(rows, 4)
    assert all(sum(s.to_word - s.from_word for s in r.spans) == r.n_removed for r in out)


def test_null_id_and_empty_table(spark):
    text = " ".join("w%d" % i for i in range(20))
    docs = spark.createDataFrame([(None, text), (7, text), (None, text)], "doc_id long, text string")
    assert sorted((r.doc_id or -1, r.n_removed) for r in remove_repeats(docs).collect()) == [(-1, 20), (-1, 20), (7, 0)]
    assert remove_repeats(docs.limit(0)).count() == 0


def test_null_ids_are_dealt_over_all_chunks(spark):
    """A third of the rows without an id: no chunk holds them all, and results are those of one chunk."""
    rows = [(None if i % 3 == 0 else i, f"w{i} " + " ".join(f"x{(i * k) % 50}" for k in range(30))) for i in range(600)]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    sizes = [r["count"] for r in chunked(docs, "doc_id", "text", 16).groupBy("chunk").count().collect()]
    assert len(sizes) == 16 and max(sizes) < 3 * 600 / 16
    assert remove_repeats(docs).count() == 600
