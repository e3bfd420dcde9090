"""Embedding near-dedup by p-stable hashing of normalised vectors, with exact cosine checks."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from strataloom.llm.blocks import block_pairs, runs, spanning_links, task_key
from strataloom.llm.components import components
from strataloom.llm.words import U64, mix, salted
from strataloom.session import cut_lineage

TABLES, PROJECTIONS, WIDTH = 96, 18, 2.0
BLOCK = 512


def _unit_vectors(column: pa.Array | pa.ChunkedArray) -> tuple[np.ndarray, np.ndarray]:
    """Rows that hold a vector, and the vectors at length 1, in double precision."""
    lists = column.to_pylist()
    rows, held = [], []
    for i, v in enumerate(lists):
        if v and None not in v:
            x = np.array(v, np.float64)
            scale = np.abs(x).max()
            if np.isfinite(scale) and scale > 0:
                x = x / scale
                rows.append(i)
                held.append(x / np.sqrt(x @ x))
    return np.array(rows, np.int64), held


def hashed(tables: int, projections: int, width: float, seed: int):
    """Of a block of vectors: key, the vector at length 1 as bytes of doubles, the bucket of every table."""
    made: dict[int, tuple[np.ndarray, np.ndarray]] = {}

    def family(size: int) -> tuple[np.ndarray, np.ndarray]:
        if size not in made:
            r = np.random.default_rng([seed, size])
            made[size] = r.normal(size=(size, tables * projections)), r.uniform(0, width, tables * projections)
        return made[size]

    def place(batches):
        for batch in batches:
            rows, vectors = _unit_vectors(batch.column("vector"))
            sizes = np.array([len(v) for v in vectors])
            buckets = np.zeros((len(rows), tables), np.int64)
            for size in np.unique(sizes):
                own = np.flatnonzero(sizes == size)
                lines, shift = family(int(size))
                cells = np.floor((np.stack([vectors[i] for i in own]) @ lines + shift) / width).astype(np.int64).view(U64)
                cells = cells.reshape(len(own), tables, projections)
                h = np.full((len(own), tables), int(size), U64) + np.arange(tables, dtype=U64) * U64(1_000_003)
                for j in range(projections):
                    h = mix(h * U64(0x9FB21C651E98DF25) + cells[:, :, j])
                buckets[own] = salted(h, 9).view(np.int64)
            yield pa.record_batch(
                {
                    "id": batch.column("id").take(pa.array(rows)),
                    "unit": pa.array([v.tobytes() for v in vectors], pa.binary()),
                    "buckets": pa.array(list(buckets), pa.list_(pa.int64())),
                }
            )

    return place


def _matrix(table: pa.Table) -> np.ndarray:
    held = [np.frombuffer(x, np.float64) for x in table["unit"].to_pylist()]
    wide = max(map(len, held), default=0)
    return np.stack([np.pad(x, (0, wide - len(x))) for x in held]) if held else np.zeros((0, 1))


def _joining(threshold: float):
    def links(table: pa.Table) -> pa.Table:
        units, nodes, found = _matrix(table), table["node"].to_numpy(), []
        for left, right in runs(table, "bucket"):
            found += spanning_links(left, right, lambda x, others: units[others] @ units[x] >= threshold)
        at = np.array(found, np.int64).reshape(-1, 2)
        return pa.table({"a": pa.array(nodes[at[:, 0]]), "b": pa.array(nodes[at[:, 1]])})

    return links


def _counting(threshold: float):
    def counts(table: pa.Table) -> pa.Table:
        units, nodes, weight = _matrix(table), table["node"].to_numpy(), table["copies"].to_numpy()
        total = np.zeros(len(nodes), np.int64)
        for left, right in runs(table, "component"):
            near = units[left] @ units[right].T >= threshold
            if left is right:
                np.fill_diagonal(near, False)
                total[left] += near @ weight[left]
            else:
                total[left] += near @ weight[right]
                total[right] += near.T @ weight[left]
        return pa.table({"node": pa.array(nodes), "links": pa.array(total)})

    return counts


def near_vectors(
    vectors: DataFrame,
    id_col: str = "vec_id",
    vector_col: str = "embedding",
    threshold: float = 0.9,
    tables: int = TABLES,
    projections: int = PROJECTIONS,
    width: float = WIDTH,
    seed: int = 1,
    block: int = BLOCK,
) -> DataFrame:
    """One row a vector: id, n_links, component_id, kept.

    1. Vectors equal after scaling to length 1 are one node that counts its copies.
    2. In each table a node falls into the bucket of its `projections` quantised random projections. Nodes of
       a bucket meet in blocks; a pair with cosine >= threshold is a link, listed if it joins two sets
       of the task. Links give the components.
    3. Nodes of a component meet in blocks, where every pair with cosine >= threshold is counted, not listed.

    A pair at cosine 0.9 shares a bucket with probability 0.94 at the usual parameters, one at 0.95 with 0.9999;
    once its component is found by any chain of links it is counted for certain. Vectors of different
    length, null and zero ones and those that hold null or non-finite components link with nothing; a null
    id counts as the largest. Rows with one id are separate vectors. An empty table gives no rows.
    """
    tasks = 2 * int(vectors.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    last = 2**63 - 1
    known = vectors.select(F.coalesce(F.col(id_col).cast("long"), F.lit(last)).alias("id"), F.col(vector_col).cast("array<double>").alias("vector"))
    placed = known.mapInArrow(hashed(tables, projections, width, seed), "id long, unit binary, buckets array<long>")
    placed = cut_lineage(placed.withColumn("node", F.xxhash64("unit")))
    copies = placed.groupBy("node").agg(F.count("*").alias("copies"), F.min("id").alias("first"))
    nodes = cut_lineage(placed.select("node", "unit", "buckets").dropDuplicates(["node"]).join(copies, "node"))

    members = nodes.select("node", F.explode("buckets").alias("bucket"))
    shared = members.join(members.groupBy("bucket").agg(F.count("*").alias("size")).where("size > 1"), "bucket")
    met = block_pairs(shared, "bucket", "node", "size", block).join(nodes.select("node", "unit"), "node")
    links = met.groupBy(task_key("bucket", tasks).alias("task")).applyInArrow(_joining(threshold), "a long, b long")
    found = cut_lineage(components(links))

    grown = found.join(found.groupBy("component").agg(F.count("*").alias("size")), "component").join(nodes.select("node", "unit", "copies"), "node")
    met = block_pairs(grown, "component", "node", "size", block)
    counted = met.groupBy(task_key("component", tasks).alias("task")).applyInArrow(_counting(threshold), "node long, links long")
    counted = counted.groupBy("node").agg(F.sum("links").alias("links"))

    told = nodes.select("node", "copies", "first").join(found, "node", "left").withColumn("component", F.coalesce("component", "node"))
    told = told.join(told.groupBy("component").agg(F.min("first").alias("component_id")), "component").join(counted, "node", "left")
    told = told.select("node", "component_id", (F.coalesce("links", F.lit(0)) + F.col("copies") - 1).alias("n_links"))
    linked = placed.select("id", "node").join(told, "node").select("id", "n_links", "component_id")
    # Vectors that link with nothing were not placed; they are their own component.
    own = F.transform("vector", lambda x: F.coalesce(x, F.lit(float("nan"))))
    finite = F.forall(own, lambda x: ~F.isnan(x) & (F.abs(x) != float("inf")))
    usable = F.coalesce(finite & F.exists(own, lambda x: x != 0), F.lit(False))
    alone = known.where(~usable).select("id", F.lit(0).cast("long").alias("n_links"), F.col("id").alias("component_id"))
    out = linked.union(alone)
    return out.select(F.nullif("id", F.lit(last)).alias(id_col), "n_links", F.nullif("component_id", F.lit(last)).alias("component_id"), (F.col("id") == F.col("component_id")).alias("kept"))


#: The rows of op6 over `embeddings`, whose ids are unique, from all pairs.
SQL = """
WITH RECURSIVE held AS (SELECT vec_id, CAST(embedding AS DOUBLE[]) AS e FROM embeddings),
usable AS (
  SELECT vec_id, e, sqrt(list_dot_product(e, e)) AS norm FROM held
  WHERE len(e) > 0 AND len([x FOR x IN e IF x IS NULL OR NOT isfinite(x)]) = 0 AND len([x FOR x IN e IF x <> 0]) > 0),
pairs AS (
  SELECT a.vec_id AS a, b.vec_id AS b FROM usable a JOIN usable b ON a.vec_id <> b.vec_id AND len(a.e) = len(b.e)
  WHERE list_dot_product(a.e, b.e) / (a.norm * b.norm) >= 0.9),
reached AS (SELECT a AS vec_id, b AS other FROM pairs UNION SELECT r.vec_id, p.b FROM reached r JOIN pairs p ON p.a = r.other),
least AS (SELECT vec_id, min(other) AS other FROM reached GROUP BY vec_id),
links AS (SELECT a AS vec_id, count(*) AS n FROM pairs GROUP BY a)
SELECT h.vec_id, coalesce(n, 0) AS n_links, least(h.vec_id, coalesce(other, h.vec_id)) AS component_id, h.vec_id = least(h.vec_id, coalesce(other, h.vec_id)) AS kept
FROM held h LEFT JOIN links USING (vec_id) LEFT JOIN least USING (vec_id)
"""
