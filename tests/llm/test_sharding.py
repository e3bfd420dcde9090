import random
import zlib

from pyspark.sql import functions as F

from strataloom.llm.sharding import differencing, shard_documents


def test_differencing_balances_and_tracks_places():
    r = random.Random(1)
    for n, shards in ((1, 4), (3, 4), (40, 3), (500, 16)):
        sizes = [r.randint(1, 1000) for _ in range(n)]
        found = differencing([[s] + [0] * (shards - 1) for s in sizes], shards)
        sums = [0] * shards
        for s, places in zip(sizes, found):
            assert sorted(places) == list(range(shards))
            sums[places[0]] += s
        assert max(sums) - min(sums) <= max(sizes)
        if n == 500:
            assert max(sums) - min(sums) <= 3
    partial = [[5, 9, 1], [4, 4, 4], [10, 0, 0]]
    sums = [0, 0, 0]
    for p, places in zip(partial, differencing(partial, 3)):
        for i, s in enumerate(p):
            sums[places[i]] += s
    assert sorted(sums) == [9, 13, 15]  # 10 + 1, 0 + 5, 0 + 9, then 4 each


def test_documents(spark):
    r = random.Random(2)
    data = [(d, "x" * r.randint(0, 500) + str(d % 150)) for d in range(600)] + [(5, "same"), (5, "same"), (None, "same"), (700, None), (701, ""), (702, "é" * 100_000)]
    docs = spark.createDataFrame(data, "doc_id long, text string").withColumns({"key": F.lit(0), "shard": F.lit("s"), "bytes": F.lit(1)})
    for block in (50_000, 20):
        out = shard_documents(docs, block_groups=block).collect()
        assert len(out) == len(data)
        sums, places, slots = [0] * 16, {}, {}
        for row in out:
            sums[row.shard] += row.size
            assert places.setdefault((row.text_crc32, row.size), row.shard) == row.shard
            slots.setdefault(row.shard, []).append(row.slot)
        assert all(sorted(s) == list(range(len(s))) for s in slots.values())
        rest = sorted(sums)[:-1]  # one shard holds the long text alone
        assert max(rest) - min(rest) <= 0.02 * max(rest)
        assert sum(sums) == sum(len((t or "").encode()) + 1 for _, t in data)
        assert {(r.doc_id, r.text_crc32) for r in out} == {(d, zlib.crc32((t or "").encode())) for d, t in data}
    assert shard_documents(docs.limit(0)).count() == 0
