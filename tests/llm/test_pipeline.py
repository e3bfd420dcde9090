import random
from collections import Counter

import corpus_pipeline
from strataloom.llm.decontaminate import normal
from tests.llm.test_decontaminate import distance
from tests.llm.test_neardup import brute as classes

SCHEMA = "doc_id long, text string, lang string, source string, n_chars long, shard string, score double"


def tables(spark, folder, empty=False):
    r = random.Random(12)
    word = lambda: "w%d" % r.randint(0, 900)
    bench = [(i, " ".join(word() for _ in range(25))) for i in range(5)]
    docs, labels = [], []
    for d in range(150):
        good = r.random() < 0.75
        w = [word() for _ in range(r.randint(20, 80))]
        if not good:
            w = [x + "$$$" for x in w]
        text = " ".join(w)
        if d % 15 == 4:
            text += " " + r.choice(bench)[1]
        if d % 15 == 9 and docs:
            text = docs[r.randrange(len(docs))][1] + r.choice(["", " one more"])
        docs.append((d, text, "en", r.choice(["a", "b", "b", None]), len(text), "x", 0.5))
        labels.append((d, int("$" not in text), 0))
    docs += [(200, None, None, None, None, None, None), (201, "", "en", "a", 0, "x", 0.0), docs[3], docs[3]]
    spark.createDataFrame(docs[:0] if empty else docs, SCHEMA).write.parquet(f"{folder}/documents.parquet")
    spark.createDataFrame(labels[:0] if empty else labels, "doc_id long, quality int, toxic int").write.parquet(f"{folder}/labels.parquet")
    spark.createDataFrame(bench, "item_id long, text string").write.parquet(f"{folder}/benchmark.parquet")
    return docs, dict(bench)


def stages(spark, folder):
    held = spark.read.parquet(f"{folder}/documents.parquet")
    for k, (name, stage) in enumerate(corpus_pipeline.STAGES):
        out = stage(spark, held, str(folder))
        if k < 4:
            assert out.columns == held.columns
        out.write.parquet(f"{folder}/out{k}")
        before, held = held, spark.read.parquet(f"{folder}/out{k}")
        yield name, before.collect(), held.collect()


def test_each_stage_on_its_own_input(spark, tmp_path):
    docs, bench = tables(spark, tmp_path)
    seen = {}
    for name, before, after in stages(spark, tmp_path):
        seen[name] = len(after)
        if name == "quality_classifier":
            kept = {r.doc_id for r in after}
            good = {d[0] for d in docs if d[1] and "$" not in d[1]}
            assert len(good - kept) <= 2 and len({d[0] for d in docs if d[1] and "$" in d[1]} & kept) <= 2
        elif name == "minhash_near_dedup":
            expected = classes([(r.doc_id, r.text) for r in before])
            assert sorted(r.doc_id for r in after) == sorted({c for _, c in expected})
        elif name == "decontamination":
            leaks = lambda t: any(distance(normal(b), normal(t)) <= int(len(normal(b)) * 0.1) for b in bench.values())
            assert sorted(r.doc_id for r in after) == sorted(r.doc_id for r in before if not leaks(r.text))
            assert len(after) < len(before)
        elif name == "mixing":
            turns = Counter(r.doc_id for r in after)
            assert set(turns) <= {r.doc_id for r in before if (r.text or "").split()} and set(turns.values()) <= {1, 2}
            words = lambda rows: sum(len((r.text or "").split()) for r in rows)
            assert abs(words(after) - 1.5 * words(before)) < 0.1 * words(before)
        else:
            assert Counter(r.doc_id for r in before) == Counter(r.doc_id for r in after)
            place = {}
            assert all(place.setdefault((r.text_crc32, r.size), r.shard) == r.shard for r in after)
    assert list(seen) == [n for n, _ in corpus_pipeline.STAGES]


def test_run_over_empty_documents(spark, tmp_path):
    tables(spark, tmp_path, empty=True)
    assert corpus_pipeline.run(spark, str(tmp_path)).count() == 0
