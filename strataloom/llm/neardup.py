"""Near-duplicate documents by BagMinHash: signatures in bands, buckets met in blocks, bags compared exactly."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from strataloom.llm.bagminhash import signature
from strataloom.llm.blocks import block_pairs, runs, spanning_links, task_key
from strataloom.llm.components import components
from strataloom.llm.shingles import bags
from strataloom.llm.words import U64, mix, salted, slices
from strataloom.session import cut_lineage

BANDS, ROWS = 24, 5
BLOCK = 512
LAST_ID = 2**63 - 1


def signed(shingle: int, bands: int, rows: int):
    """Of a block of texts: content, bucket of every band, a 16-bit print of every component; only texts with words."""

    def sign(batches):
        for batch in slices(batches, "text"):
            content, buckets, prints = [], [], []
            for key, (elements, weights) in zip(batch.column("content").to_pylist(), bags(batch.column("text"), shingle)):
                if not len(elements):
                    continue
                parts = signature(elements, weights, bands * rows).reshape(bands, rows)
                h = mix(parts[:, 0])
                for j in range(1, rows):
                    h = mix(h * U64(0x9FB21C651E98DF25) + parts[:, j])
                content.append(key)
                buckets.append(salted(h + np.arange(bands, dtype=U64), 5).view(np.int64))
                prints.append((mix(parts.ravel()) & U64(0xFFFF)).astype(np.uint16).tobytes())
            yield pa.record_batch(
                {
                    "content": pa.array(content, pa.int64()),
                    "buckets": pa.array(buckets, pa.list_(pa.int64())),
                    "prints": pa.array(prints, pa.binary()),
                }
            )

    return sign


def _prints(table: pa.Table, components_: int) -> np.ndarray:
    return np.frombuffer(b"".join(table["prints"].to_pylist()), np.uint16).reshape(-1, components_)


def _emitted(nodes: np.ndarray, links: list[tuple[int, int]]) -> pa.Table:
    at = np.array(links, np.int64).reshape(-1, 2)
    return pa.table({"a": pa.array(nodes[at[:, 0]]), "b": pa.array(nodes[at[:, 1]])})


def _likely(least: int, size: int):
    """Links between members of a bucket whose signatures agree in `least` components or more."""

    def links(table: pa.Table) -> pa.Table:
        prints, nodes, found = _prints(table, size), table["content"].to_numpy(), []
        near = lambda x, others: (prints[others] == prints[x]).sum(axis=1) >= least
        for left, right in runs(table, "bucket"):
            found += spanning_links(left, right, near)
        return _emitted(nodes, found)

    return links


class Bags:
    """Bags of a task's texts, their elements numbered, so that one bag meets many others at once."""

    def __init__(self, texts: pa.ChunkedArray | pa.Array, shingle: int):
        held = [(e.copy(), w) for e, w in bags(texts, shingle)]
        sizes = np.array([len(e) for e, _ in held], np.int64)
        self.starts = np.cumsum(np.r_[0, sizes])
        elements, self.numbers = np.unique(np.concatenate([np.zeros(0, U64), *(e for e, _ in held)]), return_inverse=True)
        self.weights = np.concatenate([np.zeros(0, np.int64), *(w for _, w in held)])
        self.totals = np.array([int(w.sum()) for _, w in held], np.int64)
        self.counts = np.zeros(len(elements), np.int64)

    def overlaps(self, x: int, others: np.ndarray, piece: int = 1 << 21) -> np.ndarray:
        """Weighted Jaccard similarity of bag x with each of the others; no bag may be empty."""
        own = slice(self.starts[x], self.starts[x + 1])
        self.counts[self.numbers[own]] = self.weights[own]
        both, at = np.zeros(len(others), np.int64), 0
        sizes = self.starts[others + 1] - self.starts[others]
        ends = np.cumsum(sizes)
        while at < len(others):
            to = max(at + 1, int(np.searchsorted(ends, (ends[at - 1] if at else 0) + piece)))
            n = sizes[at:to]
            first = np.cumsum(n) - n
            flat = np.repeat(self.starts[others[at:to]] - first, n) + np.arange(int(n.sum()))
            both[at:to] = np.add.reduceat(np.minimum(self.counts[self.numbers[flat]], self.weights[flat]), first)
            at = to
        self.counts[self.numbers[own]] = 0
        return both / (self.totals[x] + self.totals[others] - both)


def _certain(least: int, size: int, shingle: int, threshold: float):
    """Links between likely near-duplicates whose bags overlap by `threshold` or more."""

    def links(table: pa.Table) -> pa.Table:
        prints, nodes, found = _prints(table, size), table["content"].to_numpy(), []
        _, rows, bag = np.unique(nodes, return_index=True, return_inverse=True)
        held = Bags(table["text"].take(pa.array(rows)), shingle)

        def near(x, others):
            good = (prints[others] == prints[x]).sum(axis=1) >= least
            at = np.flatnonzero(good)
            if len(at):
                good[at] = held.overlaps(int(bag[x]), bag[others[at]]) >= threshold
            return good

        for left, right in runs(table, "likely"):
            found += spanning_links(left, right, near)
        return _emitted(nodes, found)

    return links


def _known(docs: DataFrame, id_col: str, text_col: str) -> DataFrame:
    """id (null: the largest), text, content; content is a 64-bit hash of the text."""
    text = F.coalesce(F.col(text_col).cast("string"), F.lit(""))
    return docs.select(F.coalesce(F.col(id_col).cast("long"), F.lit(LAST_ID)).alias("id"), text.alias("text"), F.xxhash64(text).alias("content"))


def text_classes(
    docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", shingle: int = 5, threshold: float = 0.8, bands: int = BANDS, rows: int = ROWS, block: int = BLOCK
) -> DataFrame:
    """One row a distinct text: content, first (its smallest id), class (told by a content of it), class_id; see near_duplicates."""
    size = bands * rows
    least = int(np.floor(size * threshold - 4 * np.sqrt(size * threshold * (1 - threshold))))
    tasks = 2 * int(docs.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    known = _known(docs, id_col, text_col)

    prints = known.select("content", "text").mapInArrow(signed(shingle, bands, rows), "content long, buckets array<long>, prints binary")
    nodes = cut_lineage(prints.groupBy("content").agg(F.first("buckets").alias("buckets"), F.first("prints").alias("prints")))
    firsts = cut_lineage(known.groupBy("content").agg(F.min("id").alias("first")))

    members = nodes.select("content", F.explode("buckets").alias("bucket"))
    shared = members.join(members.groupBy("bucket").agg(F.count("*").alias("size")).where("size > 1"), "bucket")
    met = block_pairs(shared, "bucket", "content", "size", block).join(nodes.select("content", "prints"), "content")
    likely = met.groupBy(task_key("bucket", tasks).alias("task")).applyInArrow(_likely(least, size), "a long, b long")
    likely = cut_lineage(components(likely).withColumnsRenamed({"node": "content", "component": "likely"}))

    grown = likely.join(likely.groupBy("likely").agg(F.count("*").alias("size")), "likely")
    grown = grown.join(firsts, "content").join(nodes.select("content", "prints"), "content")
    texts = known.select("content", F.col("id").alias("first"), "text")
    grown = grown.join(texts, ["content", "first"]).dropDuplicates(["content", "first"])
    met = block_pairs(grown, "likely", "content", "size", block)
    links = met.groupBy(task_key("likely", tasks).alias("task")).applyInArrow(_certain(least, size, shingle, threshold), "a long, b long")
    found = components(links).withColumnsRenamed({"node": "content", "component": "class"})

    classes = firsts.join(found, "content", "left").withColumn("class", F.coalesce("class", "content"))
    return classes.join(classes.groupBy("class").agg(F.min("first").alias("class_id")), "class").select("content", "first", "class", "class_id")


def near_duplicates(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", **options) -> DataFrame:
    """One row a document: id, class_id, kept.

    Two documents are linked if the bags of their runs of `shingle` words (repeats counted; a shorter text is
    one run) overlap by `threshold` or more, as intersection over union. class_id is the smallest id
    reachable by links; kept marks the documents with this id.

    1. Documents of equal text are one node from here on, told by a 64-bit hash of the text.
    2. Nodes that share a bucket of any band meet in blocks of `block`. A pair is likely if the signatures agree
       in all but as many components as four standard deviations allow at the threshold.
    3. Nodes connected by likely pairs meet in blocks once more, and likely pairs are compared exactly.

    A task of 2 or 3 lists a link only if it joins two sets of the task, so a group of n near copies gives
    about n links for each block, not n*n. A pair at the threshold is missed with probability
    (1 - threshold**rows)**bands, 7e-5 at the usual parameters. Texts without words, null ones too, are linked
    with their equals only (null equals empty); a null id counts as the largest. An empty table gives no rows.
    """
    classes = text_classes(docs, id_col, text_col, **options).select("content", "class_id")
    out = _known(docs, id_col, text_col).select("id", "content").join(classes, "content")
    return out.select(F.nullif("id", F.lit(LAST_ID)).alias(id_col), F.nullif("class_id", F.lit(LAST_ID)).alias("class_id"), (F.col("id") == F.col("class_id")).alias("kept"))


def one_of_each(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", **options) -> DataFrame:
    """The documents, all their columns, with one left of each class: one row of its smallest (id, content).

    Classes are told apart by their own key, as unrelated texts may share an id and all null ids count as one.
    """
    kept = text_classes(docs, id_col, text_col, **options).groupBy("class").agg(F.min(F.struct("first", "content")).alias("one"))
    kept = kept.select(F.col("one.first").alias("__first"), F.col("one.content").alias("__content"))
    text = F.coalesce(F.col(text_col).cast("string"), F.lit(""))
    keyed = docs.withColumn("__first", F.coalesce(F.col(id_col).cast("long"), F.lit(LAST_ID))).withColumn("__content", F.xxhash64(text))
    return keyed.join(kept, ["__first", "__content"], "left_semi").dropDuplicates(["__first", "__content"]).select(*docs.columns)
