"""Sharding by Karmarkar-Karp differencing: documents of equal text stay together, shards get nearly equal bytes."""

from __future__ import annotations

import heapq

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from strataloom.llm.spread import hex_bin, running_before
from strataloom.session import cut_lineage

BLOCK_GROUPS = 50_000
FAN_IN = 1024


def differencing(parts: list[list[int]], shards: int) -> list[list[int]]:
    """The shard of each place of each partial partition, after all are combined.

    A partial partition is a list of `shards` sums. The two with the largest spread are combined again and
    again, the larger sums of one with the smaller sums of the other. Ties go by position in `parts`.
    """
    ordered, places = [], []
    for sums in parts:
        order = sorted(range(shards), key=lambda i: (-sums[i], i))
        ordered.append([sums[i] for i in order])
        places.append(order)
    heap = [(s[-1] - s[0], i) for i, s in enumerate(ordered)]
    heapq.heapify(heap)
    sums, joins = dict(enumerate(ordered)), []
    top = len(parts)
    while len(heap) > 1:
        a, b = heapq.heappop(heap)[1], heapq.heappop(heap)[1]
        joined = [x + y for x, y in zip(sums.pop(a), reversed(sums.pop(b)))]
        order = sorted(range(shards), key=lambda i: -joined[i])
        joined = [joined[i] for i in order]
        sums[top] = joined
        joins.append((a, b, order))
        heapq.heappush(heap, (joined[-1] - joined[0], top))
        top += 1
    final = {top - 1: list(range(shards))}
    for k in range(len(joins) - 1, -1, -1):
        a, b, order = joins[k]
        own = final.pop(len(parts) + k)
        at = [0] * shards
        for rank, i in enumerate(order):
            at[i] = own[rank]
        final[a] = at
        final[b] = at[::-1]
    out = []
    for i, order in enumerate(places):
        at = [0] * shards
        for rank, place in enumerate(order):
            at[place] = final[i][rank]
        out.append(at)
    return out


def _groups_to_places(shards: int):
    def place(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values(["bytes", "key"], ascending=[False, True], kind="stable")
        found = differencing([[int(n)] + [0] * (shards - 1) for n in pdf["bytes"]], shards)
        return pd.DataFrame({"key": pdf["key"].to_numpy(), "bytes": pdf["bytes"].to_numpy(), "block": pdf["block"].to_numpy(), "place": [f[0] for f in found]})

    return place


def _blocks_to_places(shards: int):
    def place(pdf: pd.DataFrame) -> pd.DataFrame:
        blocks = sorted(pdf["block"].unique())
        sums = {b: [0] * shards for b in blocks}
        for b, p, n in zip(pdf["block"], pdf["place"], pdf["bytes"]):
            sums[b][p] = int(n)
        found = differencing([sums[b] for b in blocks], shards)
        rows = [(b, p, f[p]) for b, f in zip(blocks, found) for p in range(shards)]
        return pd.DataFrame(rows, columns=["block", "place", "shard"])

    return place


def group_shards(groups: DataFrame, shards: int = 16, block_groups: int = BLOCK_GROUPS) -> DataFrame:
    """(key, shard) of groups (key, bytes); key is a hexadecimal hash.

    Blocks of about `block_groups` groups are differenced apart. What is left of a block is a partial
    partition of `shards` sums; up to 1,024 of them are differenced together, and so on to one.
    """
    blocks = max(1, -(-groups.count() // block_groups))
    placed = cut_lineage(
        groups.withColumn("block", F.pmod(F.xxhash64("key"), F.lit(blocks)))
        .groupBy("block")
        .applyInPandas(_groups_to_places(shards), "key string, bytes long, block long, place int")
    )
    while blocks > 1:
        sums = placed.groupBy("block", "place").agg(F.sum("bytes").alias("bytes")).withColumn("upper", F.floor(F.col("block") / FAN_IN))
        moves = sums.groupBy("upper").applyInPandas(_blocks_to_places(shards), "block long, place int, shard int")
        placed = placed.join(moves, ["block", "place"]).select("key", "bytes", F.floor(F.col("block") / FAN_IN).alias("block"), F.col("shard").alias("place"))
        blocks = -(-blocks // FAN_IN)
        placed = cut_lineage(placed)
    return placed.select("key", F.col("place").alias("shard"))


def shard_documents(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", shards: int = 16, block_groups: int = BLOCK_GROUPS) -> DataFrame:
    """One row a document: id, size, text_crc32, shard, slot.

    size: bytes of the text and 1. Documents of equal text are one indivisible group; groups are spread by
    differencing, so a shard is larger than others only where one group alone is larger than a share.
    Slots count a shard's documents from 0 in the order of the md5 of their id. A null text counts as
    empty; rows with one id are separate documents. An empty table gives no rows.
    """
    text = F.coalesce(F.col(text_col).cast("string"), F.lit(""))
    seen = docs.select(
        F.col(id_col).alias("id"),
        (F.octet_length(text) + 1).cast("long").alias("size"),
        F.crc32(F.encode(text, "utf-8")).alias("text_crc32"),
        F.substring(F.sha2(text, 256), 1, 40).alias("key"),
        F.md5(F.coalesce(F.col(id_col).cast("string"), F.lit(""))).alias("turn"),
    )
    seen = cut_lineage(seen)
    groups = seen.groupBy("key").agg(F.sum("size").alias("bytes"))
    placed = seen.join(group_shards(groups, shards, block_groups), "key").withColumn("bin", hex_bin(F.col("turn"))).withColumn("one", F.lit(1).cast("long"))
    out = running_before(placed, ["shard"], "bin", ["turn", "text_crc32", "size"], "one", "slot")
    return out.select(F.col("id").alias(id_col), "size", "text_crc32", "shard", "slot")
