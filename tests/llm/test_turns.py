import random
import zlib
from collections import defaultdict
from hashlib import sha256

import pytest
from pyspark.sql import functions as F

from strataloom.llm.turns import conversation_nodes, end_digests, prefix_trie, rebuilt

COLUMNS = ("conv_id", "depth", "parent_conv_id", "n_convs", "n_children", "n_leaves", "saved_tokens", "ends_sha256")
SCHEMA = "conv_id long, turn long, role string, text string"


def sequences(data):
    """Rebuilt turns of every conversation, by the definition; data has no two rows of one conversation and turn."""
    by = defaultdict(list)
    for c, turn, role, text in data:
        if c is not None:
            by[c].append((turn is not None, turn or 0, role or "", text or ""))
    by = {c: [t[2:] for t in sorted(held)] for c, held in by.items()}
    out = {}
    for c, own in by.items():
        base = c - (abs(c) % 100) * (1 if c >= 0 else -1)
        h = zlib.crc32(str(c).encode()) % 6
        out[c] = by.get(base, [])[:h] + own[h:]
    return out


def plain(seqs):
    members = defaultdict(list)
    for c, s in seqs.items():
        for d in range(len(s) + 1):
            members[tuple(s[:d])].append(c)
    children = defaultdict(list)
    for node in members:
        if node:
            children[node[:-1]].append(node)
    out = []
    for node in sorted(members, key=len, reverse=True):
        below = [x for x in members if x[: len(node)] == node]
        saved = sum((len(members[x]) - 1) * len(x[-1][1]) for x in below if x)
        ends = ",".join(str(c) for c in sorted(members[node]) if len(seqs[c]) == len(node))
        out.append((min(members[node]), len(node), min(members[node[:-1]]) if node else None, len(members[node]), len(children[node]),
                    sum(not children[x] for x in below), saved, sha256(ends.encode()).hexdigest()))
    return sorted(out, key=repr)


def rows(df):
    return sorted((tuple(r[c] for c in COLUMNS) for r in df.collect()), key=repr)


def made(seed, convs, longest):
    r = random.Random(seed)
    out = []
    for c in convs:
        if r.random() < 0.1:
            continue
        for t in range(r.choice([0, 1, 2, 3, 5, 7, longest])):
            out.append((c, None if t == 0 and r.random() < 0.3 else t, r.choice(["user", "bot", None, ""]), r.choice(["a", "b", "", None, "ä😀", "long " * 3])))
    r.shuffle(out)
    return out


def frame(spark, data):
    extra = {c: F.lit("x") for c in ("family", "own", "head", "hi", "lo", "ids", "n", "node", "shard", "depth")}
    return spark.createDataFrame(data, SCHEMA).repartition(3).withColumns(extra)


@pytest.mark.parametrize("seed", [1, 2])
def test_against_the_definition(spark, seed):
    data = made(seed, [*range(95, 320), *range(-120, 20), 10**15 + 7], 20) + [(None, 0, "user", "lost"), (None, None, None, None)]
    data += [(400, t, "user", "same") for t in range(40)] + [(c, t, "user", "same") for c in range(401, 460) for t in range(40)]
    assert rows(conversation_nodes(frame(spark, data))) == plain(sequences(data))


@pytest.mark.parametrize("shard_turns", [1, 3, 17, 1000])
def test_shards_of_any_size_give_one_trie(spark, shard_turns):
    data = made(7, range(0, 400), 50)
    trie = prefix_trie(rebuilt(frame(spark, data)), shard_turns)
    nodes = trie.nodes.join(end_digests(trie.members), ["end1", "end2"], "left")
    nodes = nodes.withColumn("ends_sha256", F.coalesce("ends_sha256", F.lit(sha256(b"").hexdigest())))
    assert rows(nodes) == plain(sequences(data))


def test_a_hot_conversation_and_copies(spark):
    data = [(100, t, "user", f"{t % 7}") for t in range(700)] + [(c, 0, "user", "hello") for c in range(1000, 1400)]
    out = {(r.conv_id, r.depth): r for r in conversation_nodes(frame(spark, data)).collect()}
    seqs = sequences(data)
    assert out[100, len(seqs[100])].n_leaves == 1 and out[100, 0].n_convs == 401
    same = [c for c in range(1000, 1400) if seqs[c] == seqs[1000]]
    assert out[min(same), len(seqs[1000])].ends_sha256 == sha256(",".join(map(str, sorted(same))).encode()).hexdigest()
    assert sum(r.n_convs for r in out.values() if r.depth == 1) == sum(len(s) > 0 for s in seqs.values())


def test_ties_very_long_texts_and_empty_tables(spark):
    data = [(0, 1, "b", "y" * 300_000), (0, 1, "a", "x"), (0, 1, "a", "x"), (0, 2, "a", "z"), (7, 0, None, None)]
    once = rows(conversation_nodes(frame(spark, data)))
    assert once == rows(conversation_nodes(frame(spark, data[::-1])))
    # equal turns stand by role, so the long text is the third turn of conversation 0
    sequence = [r[0] for r in rebuilt(frame(spark, data)).where("conv_id = 0").select(F.transform("turns", lambda t: t["chars"])).collect()]
    assert sequence == [[1, 1, 300_000, 1]]
    assert conversation_nodes(frame(spark, data).limit(0)).count() == 0
    assert conversation_nodes(frame(spark, [(None, 1, "a", "b")])).count() == 0
