import math
import random
import re
import zlib
from collections import Counter
from hashlib import sha256

from pyspark.sql import functions as F

from strataloom.llm import resample
from strataloom.llm.resample import target_resample

WORD = re.compile(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+")


def features(text, most):
    small = "".join(c.lower() if "A" <= c <= "Z" else c for c in text or "")
    words = WORD.findall(small)
    runs = [" ".join(words[i : i + k]) for k in range(1, most + 1) for i in range(len(words) - k + 1)]
    return len(words), [zlib.crc32(r.encode()) for r in runs]


def plain(docs, target, most=1, buckets=10_000, least=20, percent=10):
    """(id, n_words, n_features, weight, score, rank) of every document, by the definition."""
    held = [(d, *features(t, most)) for d, t in docs]
    s, t = Counter(), Counter()
    for _, _, runs in held:
        s.update(r % buckets for r in runs)
    for text in target:
        t.update(r % buckets for r in features(text, most)[1])
    S, T = sum(s.values()), sum(t.values())
    gain = lambda b: math.floor(1000 * math.log((t[b] + 1) * (S + buckets) / ((s[b] + 1) * (T + buckets))))
    out = []
    for d, n, runs in held:
        weight = math.floor(sum(gain(r % buckets) for r in runs) / len(runs)) if runs else 0
        h = int(sha256(f"2024:{'' if d is None else d}".encode()).hexdigest()[:8], 16)
        out.append([d, n, len(runs), weight, weight + math.floor(-1000 * math.log(-math.log((h + 0.5) / 2**32))), None])
    able = sorted((r for r in out if r[1] >= least), key=lambda r: (-r[4], r[0] is None, r[0] or 0))
    for k, r in enumerate(able[: percent * len(able) // 100]):
        r[5] = k + 1
    return sorted(map(tuple, out), key=repr)


def corpus(seed=1, n=400):
    r = random.Random(seed)
    vocabulary = ["the", "The", "THE", "a1", "straße", "ÄÖ", "x_y", "don't", "日本", "日本 語", "é", " nb", "...", "tab\tbed", "new\nline", "😀", "3.14"]
    docs = [(i, r.choice(["", " ", " "]).join([" ", *(r.choice(vocabulary) + " " for _ in range(r.choice([0, 3, 19, 20, 25, 60])))])) for i in range(n)]
    docs += [(n, None), (n + 1, ""), (n + 2, "word " * 60_000), (None, "w " * 30), (None, "w " * 30), (None, None), (5, docs[5][1]), (n + 3, "q" * 300_000), (-7, "\x00\x1f\x7f")]
    return docs, [r.choice(vocabulary) + " straße the 日本" for _ in range(20)] + [None, ""]


def rows(df):
    return sorted((tuple(r[c] for c in ("doc_id", "n_words", "n_features", "weight", "score", "rank")) for r in df.collect()), key=repr)


def frames(spark, docs, target):
    # columns of other meaning whose names the operator uses itself
    extra = {"id": F.lit("x"), "score": F.lit("y"), "rank": F.lit(1), "n": F.lit(2), "ties": F.lit(3)}
    return spark.createDataFrame(docs, "doc_id long, text string").repartition(5).withColumns(extra), spark.createDataFrame([(t,) for t in target], "text string")


def test_against_the_definition(spark):
    docs, target = corpus()
    a, b = frames(spark, docs, target)
    assert rows(target_resample(a, b)) == plain(docs, target)
    assert rows(target_resample(a, b, most=3, buckets=97, least_words=3, percent=55)) == plain(docs, target, 3, 97, 3, 55)


def test_equal_rows_fill_ranks_in_pieces(spark, monkeypatch):
    monkeypatch.setattr(resample, "RUN", 7)
    docs = [(None, "w " * 30)] * 200 + [(i, "v " * 30) for i in range(50)] + [(9, "v " * 30)] * 30
    a, b = frames(spark, docs, ["v"])
    out = target_resample(a, b, percent=100)
    assert sorted(r.rank for r in out.collect()) == list(range(1, 281))
    assert rows(out) == plain(docs, ["v"], percent=100)


def test_empty_tables(spark):
    a, b = frames(spark, [(1, "a " * 20), (2, "b")], ["a"])
    assert target_resample(a.limit(0), b).count() == 0
    assert rows(target_resample(a, b.limit(0), percent=100)) == plain([(1, "a " * 20), (2, "b")], [], percent=100)


def test_draw_prefers_the_target(spark):
    r = random.Random(3)
    target = ["math proof lemma theorem " * 5] * 10
    docs = [(i, " ".join(r.choice(["math", "proof", "lemma", "theorem"] if i % 10 == 0 else ["buy", "cheap", "now", "sale"]) for _ in range(30))) for i in range(1000)]
    a, b = frames(spark, docs, target)
    drawn = [x.doc_id for x in target_resample(a, b).where("rank IS NOT NULL").collect()]
    assert len(drawn) == 100 and sum(d % 10 == 0 for d in drawn) >= 90
