import random
from collections import defaultdict

import duckdb

from strataloom.llm.mixing import SQL, mix_sources, mixed_documents


def rows(seed=0, n=300):
    r = random.Random(seed)
    out = []
    for d in range(n):
        source = r.choice(["b", "a", "c", "ä", None, "hot", "hot", "hot"])
        out.append((d, None if d == 7 else " ".join(["w"] * r.choice([0, 1, 5, 30, 400 if d % 50 == 0 else 3])), source))
    return out


def made(spark, data):
    return spark.createDataFrame(data, "doc_id long, text string, source string")


def check(out, data):
    by = defaultdict(list)
    for r in out:
        by[r.source].append(r)
        assert 0 <= r.taken <= 2 * r.size
    order = sorted(by, key=lambda s: (s is None, (s or "").encode()))
    total = sum(r.size for r in out)
    weights = {s: [5, 2, 1][i % 3] for i, s in enumerate(order)}
    cap = {s: 2 * sum(r.size for r in by[s]) for s in by}
    open_, target, left = set(by), {}, 1.5 * total
    while True:
        level = left / sum(weights[s] for s in open_)
        over = [s for s in open_ if weights[s] * level >= cap[s]]
        if not over:
            break
        for s in over:
            target[s] = cap[s]
            left -= cap[s]
            open_.discard(s)
    target |= {s: weights[s] * level for s in open_}
    for s, held in by.items():
        assert abs(held[0].target - target[s]) < 1e-6 * max(1, target[s])
        assert abs(sum(r.taken for r in held) - target[s]) <= 1
    assert len(out) == len(data)


def test_targets_and_words_taken(spark):
    data = rows()
    docs = made(spark, data)
    out = mix_sources(docs).collect()
    check(out, data)
    assert sorted(mix_sources(docs.repartition(7)).collect(), key=str) == sorted(out, key=str)
    starts = [r.mix_start for r in out if r.mix_start is not None]
    assert len(set(starts)) == len(starts) and min(starts) == 0


def test_same_rows_as_sql(spark):
    docs = made(spark, rows(3))
    held = docs.toPandas()
    held["doc_id"] = held["doc_id"].astype("int64")
    con = duckdb.connect()
    con.register("documents", held)
    names = ["doc_id", "size", "source_size", "target", "taken", "mix_start"]
    expected = sorted(con.sql(f"SELECT {', '.join(names)} FROM ({SQL})").fetchall(), key=str)
    assert sorted((tuple(r) for r in mix_sources(docs).select(*names).collect()), key=str) == expected


def test_repeated_ids_clashing_columns_empty_table(spark):
    data = [(1, "a b c", "x"), (1, "a b c", "x"), (None, "d e", "x"), (2, "", "y"), (3, None, "y")]
    from pyspark.sql import functions as F

    docs = made(spark, data).withColumns({"size": F.lit("s"), "target": F.lit(0), "key": F.lit(1), "bin": F.lit(2), "taken": F.lit(3)})
    out = mix_sources(docs).collect()
    assert len(out) == 5 and sum(r.taken for r in out) == 12
    assert mix_sources(docs.limit(0)).count() == 0
    turns = mixed_documents(docs)
    assert turns.columns == docs.columns
    assert sorted(str(r.doc_id) for r in turns.collect()) == ["1", "1", "1", "None"]  # 12 words: one row twice, one and a third of the other, one row once
