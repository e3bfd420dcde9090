import random
import zlib

from pyspark.sql import functions as F

from strataloom.llm import quality


def made(spark, n=500, seed=0):
    r = random.Random(seed)
    words = ["w%d" % i for i in range(400)]
    docs, labels = [], []
    for d in range(n):
        good = r.random() < 0.7
        w = [r.choice(words) for _ in range(r.randint(5, 60))]
        if not good:
            w = [x + r.choice(["$$$", "%%%"]) for x in w] if r.random() < 0.5 else [w[0]] * len(w)
        docs.append((d, " ".join(w)))
        labels.append((d, int(good)))
    return spark.createDataFrame(docs, "doc_id long, text string"), spark.createDataFrame(labels, "doc_id long, quality int")


def test_held_out_accuracy_and_reruns(spark):
    docs, labels = made(spark)
    model = quality.train(docs, labels.where(~quality.held_out()))
    again = quality.train(docs.repartition(5), labels.repartition(3).where(~quality.held_out()))
    assert (model.weights == again.weights).all() and model.bias == again.bias
    out = quality.with_score(docs, model).join(labels, "doc_id").withColumn("held", quality.held_out()).collect()
    assert all(r.held == (zlib.crc32(str(r.doc_id).encode()) % 5 == 0) for r in out)
    held = [r for r in out if r.held]
    assert sum((r.score >= 0.5) == r.quality for r in held) / len(held) > 0.95


def test_odd_rows(spark):
    docs, labels = made(spark, 120)
    odd = spark.createDataFrame([(None, "a b"), (1000, None), (1001, ""), (1002, "x " * 100_000), (3, "again"), (3, "again")], "doc_id long, text string")
    docs = docs.union(odd).withColumns({"score_": F.lit("s"), "quality": F.lit(9), "turn": F.lit(1), "y": F.lit(2)})
    labels = labels.union(spark.createDataFrame([(1001, None), (None, 1)], labels.schema)).withColumns({"text": F.lit("t"), "lang": F.lit("l")})
    model = quality.train(docs, labels)
    out = quality.with_score(docs, model)
    assert out.columns == docs.columns + ["score"]
    assert out.count() == 126 and out.where("score < 0 OR score > 1 OR score IS NULL").count() == 0
    assert quality.with_score(docs.limit(0), model).count() == 0
    empty = quality.train(docs, labels.limit(0))
    assert {r.score for r in quality.with_score(docs, empty).collect()} == {0.5}
