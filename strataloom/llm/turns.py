"""A trie of conversations: every shared opening of turns as a node, with its members and what sharing it would save.

Turns are told by a 128-bit hash of (role, text). Distinct sequences of turns are range-partitioned and cut into
shards of bounded size. A shard's sequences become padded matrices of turn codes; a lexsort orders them, column changes
or-ed from left to right mark where nodes start, and ``reduceat`` aggregates every depth from the deepest up. Nodes that
touch the first or last row of a shard may go on in the next one; they are put together by the hash of their turns.
"""

from __future__ import annotations

import uuid
from dataclasses import dataclass
from hashlib import blake2b, sha256

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from strataloom.session import cut_lineage, shared_folder

WIDTH = 16
SHARD_TURNS = 1 << 19
VALUES = ["conv_id", "n_convs", "n_children", "n_leaves", "whole", "once"]
SHARD = "shard long, depth int, parent_conv_id long, " + ", ".join(f"{c} long" for c in VALUES)
SHARD += ", own long, leaf boolean, first boolean, last boolean, node binary, parent binary, end1 long, end2 long"


@dataclass
class Trie:
    """nodes: one row a node, `end1` and `end2` naming its sequence if conversations end there; members: id and sequence of each conversation."""

    nodes: DataFrame
    members: DataFrame


def stored(df: DataFrame) -> DataFrame:
    """The rows written as Parquet below the checkpoint folder and read again."""
    path = f"{shared_folder(df.sparkSession).rstrip('/')}/trie-{uuid.uuid4().hex}"
    df.write.parquet(path)
    return df.sparkSession.read.parquet(path)


def rebuilt(turns: DataFrame, family: int = 100, heads: int = 6) -> DataFrame:
    """(conv_id, turns) of every conversation c, its opening taken from the first conversation of its family.

    turns: conv_id, turn, role, text. With h = crc32(decimal c) % `heads`, c gets the first h turns of conversation
    c - c % `family` (all if it has fewer, none if there is none), then its own turns after its first h. Turns stand in the order of
    `turn`, null first, equal ones by role, then by the hash of role and text. A turn is (hi, lo, chars): the 128-bit hash of role
    and text and the code points of the text, null counting as empty. Rows without conv_id belong to no conversation.
    A conversation is one row. Its turns are read, hashed and shuffled once, without their text.
    """
    role, text = (F.coalesce(F.col(c).cast("string"), F.lit("")) for c in ("role", "text"))
    key = F.col("conv_id").cast("long")
    parts = [
        key.alias("conv_id"),
        (key - key % family).alias("family"),
        F.struct(
            F.col("turn").cast("long").alias("turn"),
            role.alias("role"),
            F.xxhash64(F.lit(1), role, text).alias("hi"),
            F.xxhash64(F.lit(2), text, role).alias("lo"),
            F.length(text).alias("chars"),
        ).alias("turn"),
    ]
    # dealt by family, so that neither the grouping nor the join moves the turns again
    rows = turns.where(key.isNotNull()).select(*parts).repartition("family")
    plain = F.transform(F.sort_array(F.collect_list("turn")), lambda t: F.struct(t["hi"].alias("hi"), t["lo"].alias("lo"), t["chars"].alias("chars")))
    own = rows.groupBy("family", "conv_id").agg(plain.alias("own"))
    first = own.where(F.col("conv_id") == F.col("family")).select("family", F.slice("own", 1, max(heads - 1, 1)).alias("head"))
    h = (F.crc32(F.col("conv_id").cast("string").cast("binary")) % heads).cast("int")
    head = F.coalesce(F.slice("head", F.lit(1), h), F.array().cast("array<struct<hi: bigint, lo: bigint, chars: int>>"))
    return own.join(first, "family", "left").select("conv_id", F.concat(head, F.slice("own", h + 1, F.size("own"))).alias("turns"))


def _codes(hi: np.ndarray, lo: np.ndarray) -> np.ndarray:
    """Numbers from 1 on in the order of (hi, lo), equal for equal pairs."""
    order = np.lexsort((lo, hi))
    fresh = np.ones(len(order), bool)
    fresh[1:] = (hi[order][1:] != hi[order][:-1]) | (lo[order][1:] != lo[order][:-1])
    out = np.empty(len(order), np.int64)
    out[order] = np.cumsum(fresh)
    return out


def _cells(values: np.ndarray, starts: np.ndarray, size: np.ndarray, rows: np.ndarray, block: int) -> np.ndarray:
    """A padded matrix: values of columns block * WIDTH and on of the given rows, zeros where a row is shorter."""
    held = np.minimum(size[rows] - block * WIDTH, WIDTH)
    line = np.repeat(np.arange(len(rows)), held)
    column = np.arange(len(line)) - np.repeat(np.cumsum(held) - held, held)
    out = np.zeros((len(rows), WIDTH), values.dtype)
    out[line, column] = values[(starts[rows] + block * WIDTH)[line] + column]
    return out


def _order(codes: np.ndarray, starts: np.ndarray, size: np.ndarray) -> np.ndarray:
    """Order of the rows by their codes, a sequence before those it begins; from the last block of columns to the first."""
    place = np.zeros(len(size), np.int64)
    for block in range((int(size.max(initial=0)) - 1) // WIDTH, -1, -1):
        rows = np.flatnonzero(size > block * WIDTH)
        cells = _cells(codes, starts, size, rows, block)
        found = np.lexsort([place[rows], *cells.T[::-1]])
        place[rows[found]] = np.arange(1, len(rows) + 1)
    return np.argsort(place, kind="stable")


def _path_keys(hi: np.ndarray, lo: np.ndarray) -> list[bytes]:
    """128-bit hashes of the first 0, 1, 2... turns."""
    held, out = blake2b(digest_size=16), []
    out.append(held.digest())
    for pair in np.stack([hi, lo], axis=1).astype("<i8"):
        held.update(pair.tobytes())
        out.append(held.digest())
    return out


class Shard:
    """The nodes of some distinct sequences, as arrays by depth. `rows` holds conv_id, n, end1 and end2 of each sequence."""

    def __init__(self, hi, lo, chars, size, rows: dict[str, np.ndarray]):
        starts = np.cumsum(size) - size
        codes = _codes(hi, lo)
        order = _order(codes, starts, size)
        self.size, self.starts = size[order], starts[order]
        self.rows = {k: v[order] for k, v in rows.items()}
        self.hi, self.lo, self.codes, self.chars = hi, lo, codes, chars
        self._mark()

    def _mark(self) -> None:
        """Per block: its rows, their cells, and where a node starts at each column."""
        self.blocks = []
        changed = np.zeros(len(self.size), bool)
        changed[0] = True
        for block in range((int(self.size.max()) - 1) // WIDTH + 1):
            rows = np.flatnonzero(self.size > block * WIDTH)
            cells = _cells(self.codes, self.starts, self.size, rows, block)
            before = np.zeros_like(cells)
            follows = np.flatnonzero(rows[1:] == rows[:-1] + 1) + 1
            before[follows] = cells[follows - 1]
            mask = cells != before
            mask[:, 0] |= changed[rows]
            np.logical_or.accumulate(mask, axis=1, out=mask)
            changed[rows] = mask[:, -1]
            self.blocks.append((rows, cells != 0, mask))

    def levels(self):
        """(depth, first rows, one past the last rows, values) of the nodes of each depth, the deepest first, the root last."""
        n_rows = len(self.size)
        whole, once, leaves = (np.zeros(n_rows, np.int64) for _ in range(3))
        below, self._deeper = np.zeros(n_rows, np.int64), np.zeros(0, np.int64)  # 1 where a node one deeper starts
        n, ids = self.rows["n"], self.rows["conv_id"]
        for block in range(len(self.blocks) - 1, -1, -1):
            rows, held, mask = self.blocks[block]
            for column in range(WIDTH - 1, -1, -1):
                depth = block * WIDTH + column + 1
                runs = np.flatnonzero(mask[:, column])
                real = held[runs, column]
                if not real.any():
                    continue
                width = np.diff(np.append(runs, len(rows)))
                yield depth, *self._level(depth, rows, runs, real, width, whole, once, leaves, below, n, ids)
        every = np.arange(n_rows)
        yield 0, *self._level(0, every, np.zeros(1, np.int64), np.ones(1, bool), np.array([n_rows]), whole, once, leaves, below, n, ids)

    def _level(self, depth, rows, runs, real, width, whole, once, leaves, below, n, ids):
        at, width = rows[runs[real]], width[real]
        members = np.add.reduceat(n[rows], runs)[real]
        own = self.chars[self.starts[at] + depth - 1].astype(np.int64) if depth else np.zeros(1, np.int64)
        leaf = (width == 1) & (self.size[at] == depth)
        whole[at] += members * own
        once[at] += own
        leaves[at] += leaf
        values = {
            "conv_id": np.minimum.reduceat(ids[rows], runs)[real],
            "n_convs": members,
            "n_children": np.add.reduceat(below[rows], runs)[real],
            "n_leaves": np.add.reduceat(leaves[rows], runs)[real],
            "whole": np.add.reduceat(whole[rows], runs)[real],
            "once": np.add.reduceat(once[rows], runs)[real],
            "own": own,
            "leaf": leaf,
        }
        values |= {k: self.rows[k][at] for k in ("end1", "end2")} | {"open": self.size[at] != depth}
        below[self._deeper] = 0
        below[at] = 1
        self._deeper = at
        return at, at + width, values

    def table(self, shard: int) -> pa.RecordBatch:
        """One row a node in the columns of SHARD; nodes at either end of the shard carry their hash, and so do their children's parents."""
        paths = [_path_keys(*(x[self.starts[r] : self.starts[r] + self.size[r]] for x in (self.hi, self.lo))) for r in (0, -1)]
        out, deeper = [], None
        for depth, at, to, values in self.levels():
            first, last = at == 0, to == len(self.size)
            node = np.full(len(at), None, object)
            node[last], node[first] = paths[1][depth] if last.any() else None, paths[0][depth] if first.any() else None
            level = values | {"depth": np.full(len(at), depth), "first": first, "last": last, "node": node, "at": at}
            if deeper is not None:
                up = np.searchsorted(at, deeper["at"], side="right") - 1
                deeper["parent"], deeper["parent_conv_id"] = node[up], values["conv_id"][up]
            out.append(level)
            deeper = level
        deeper["parent"], deeper["parent_conv_id"] = np.full(1, None, object), np.zeros(1, np.int64)
        whole = {k: np.concatenate([level[k] for level in out]) for k in out[0]}
        whole["shard"] = np.full(len(whole["at"]), shard)
        columns = []
        for field in SHARD.split(", "):
            name, kind = field.split()
            made = {"long": pa.int64(), "int": pa.int32(), "boolean": pa.bool_(), "binary": pa.binary()}[kind]
            empty = whole["depth"] == 0 if name == "parent_conv_id" else whole["open"] if name in ("end1", "end2") else None
            columns.append(pa.array(whole[name], made, mask=empty))
        return pa.record_batch(columns, [f.split()[0] for f in SHARD.split(", ")])


def _sharded(shard_turns: int):
    def flat(column, kind):
        return column.flatten().to_numpy(zero_copy_only=False).astype(kind, copy=False)

    def shard(number, held):
        batch = pa.concat_batches(held) if len(held) > 1 else held[0]
        ids = flat(batch.column("ids"), np.int64)
        rows = {k: batch.column(k).to_numpy() for k in ("conv_id", "n", "end1", "end2")}
        size = batch.column("chars").value_lengths().to_numpy().astype(np.int64)
        return Shard(ids[0::2], ids[1::2], flat(batch.column("chars"), np.int64), size, rows).table(number)

    def shards(batches):
        number, held, turns = TaskContext.get().partitionId() << 32, [], 0
        for batch in batches:
            ends = np.cumsum(batch.column("chars").value_lengths().to_numpy().astype(np.int64) + 1)
            at = 0
            while at < batch.num_rows:
                done = int(ends[at - 1]) if at else 0
                to = max(at + 1, int(np.searchsorted(ends, done + shard_turns - turns, side="right")))
                held.append(batch.slice(at, to - at))
                turns += int(ends[to - 1]) - done
                at = to
                if turns >= shard_turns or at < batch.num_rows:
                    yield shard(number, held)
                    number, held, turns = number + 1, [], 0
        if held:
            yield shard(number, held)

    return shards


def _joined_ends(parts: DataFrame) -> DataFrame:
    """Nodes at the ends of shards, put together: what a node counted twice because it goes on over a gap is taken off.

    Over the gap between two shards go the nodes that the last row before it and the first row after it share. Each was
    counted on both sides: in its own sums, in those of all nodes above it, and as its parent's child. A sequence that
    ends right before the gap and is continued after it looked like a leaf.
    """
    edge = parts.where("node IS NOT NULL")
    # one narrow row a shard
    order = edge.select("shard").distinct().select("shard", F.row_number().over(Window.orderBy("shard")).alias("gap"))
    left = edge.where("last").join(order, "shard").select("gap", "node", "depth", "own", "leaf")
    right = edge.where("first").join(order, "shard").select((F.col("gap") - 1).alias("gap"), "node")
    over = left.join(right, ["gap", "node"])
    down = Window.partitionBy("gap").orderBy(F.desc("depth"))
    shared = over.select(
        "node",
        F.sum("own").over(down).alias("once"),
        F.max(F.col("leaf").cast("long")).over(down).alias("n_leaves"),
        (F.row_number().over(down) > 1).cast("long").alias("n_children"),
    )
    taken = shared.groupBy("node").agg(*[F.sum(c).alias(f"__{c}") for c in ("once", "n_leaves", "n_children")])
    sums = [F.sum(c).alias(c) for c in ("n_convs", "n_children", "n_leaves", "whole", "once")]
    merged = edge.groupBy("node").agg(F.min("conv_id").alias("conv_id"), *sums, *[F.max(c).alias(c) for c in ("depth", "parent", "end1", "end2")])
    merged = merged.join(taken, "node", "left")
    return merged.select(
        "node", "parent", "depth", "conv_id", "n_convs", "whole", "end1", "end2",
        *[(F.col(c) - F.coalesce(f"__{c}", F.lit(0))).alias(c) for c in ("n_children", "n_leaves", "once")],
    )


def prefix_trie(sequences: DataFrame, shard_turns: int = SHARD_TURNS) -> Trie:
    """The trie of sequences (conv_id, turns), unique by conv_id, a turn being (hi, lo, chars) as `rebuilt` makes them.

    nodes: conv_id (smallest member), depth, parent_conv_id (null for the root), n_convs, n_children, n_leaves (childless
    nodes below it, itself included), saved_tokens (over it and all nodes below it, members less one times code
    points of the last turn), end1 and end2 (name of the sequence if members end at the node, else null).
    members: conv_id, end1, end2.

    Equal sequences are counted first, so that copies of one conversation are one row of a shard. A shard is closed at
    `shard_turns` turns and one sequence is never cut, so a task holds that many turns or one conversation. Turns, sequences and
    nodes are told by 128-bit hashes. An empty table gives no nodes, turnless conversations alone give the root.
    """
    spark = sequences.sparkSession
    ids = F.flatten(F.transform("turns", lambda t: F.array(t["hi"], t["lo"])))
    held = sequences.select("conv_id", ids.alias("ids"), F.transform("turns", lambda t: t["chars"]).alias("chars"))
    held = stored(held.withColumns({f"end{k}": F.xxhash64(F.lit(k), "ids") for k in (1, 2)}))
    distinct = held.groupBy("end1", "end2").agg(F.min("conv_id").alias("conv_id"), F.count(F.lit(1)).alias("n"), F.first("ids").alias("ids"), F.first("chars").alias("chars"))
    turns = held.agg(F.sum(F.size("chars") + F.lit(1).cast("long")).alias("n")).first()["n"] or 0
    count = max(int(spark.conf.get("spark.sql.shuffle.partitions")), -(-turns // shard_turns))
    # Spark's order lets a task cut its range into shards as rows come
    ranged = distinct.repartitionByRange(count, "ids").sortWithinPartitions("ids")
    parts = stored(ranged.mapInArrow(_sharded(shard_turns), SHARD))
    edge = cut_lineage(_joined_ends(parts))
    shown = ["conv_id", "depth", "parent_conv_id", "n_convs", "n_children", "n_leaves", (F.col("whole") - F.col("once")).alias("saved_tokens"), "end1", "end2"]
    above = edge.select(F.col("node").alias("parent"), F.col("conv_id").alias("parent_conv_id"))
    ends = edge.join(above, "parent", "left").select(*shown)
    inner = parts.where("node IS NULL")
    # a parent at the end of a shard is looked up by shard, so that no parent is one key of all its children
    own = parts.where("node IS NOT NULL").select("shard", "node").join(edge.select("node", F.col("conv_id").alias("__up")), "node")
    under = inner.where("parent IS NOT NULL").join(own.withColumnRenamed("node", "parent"), ["shard", "parent"])
    under = under.withColumn("parent_conv_id", F.col("__up")).select(*shown)
    nodes = inner.where("parent IS NULL").select(*shown).unionByName(under).unionByName(ends)
    return Trie(nodes, held.select("conv_id", "end1", "end2"))


def _digests(batches):
    """SHA-256 of each sequence's members as they come, sorted: a group of any size passes batch by batch."""
    key, held = None, None
    for batch in batches:
        a, b = (batch.column(c).to_numpy() for c in ("end1", "end2"))
        names = batch.column("conv_id").cast(pa.string()).to_pylist()
        fresh = np.flatnonzero(np.append(True, (a[1:] != a[:-1]) | (b[1:] != b[:-1]))) if len(a) else []
        done = []
        for at, to in zip(fresh, [*fresh[1:], len(a)]):
            own, text = (int(a[at]), int(b[at])), ",".join(names[at:to]).encode()
            if own == key:
                held.update(b"," + text)
                continue
            if key is not None:
                done.append((*key, held.hexdigest()))
            key, held = own, sha256(text)
        yield _digest_rows(done)
    if key is not None:
        yield _digest_rows([(*key, held.hexdigest())])


def _digest_rows(rows) -> pa.RecordBatch:
    kinds = {"end1": pa.int64(), "end2": pa.int64(), "ends_sha256": pa.string()}
    return pa.record_batch([pa.array([r[i] for r in rows], kind) for i, kind in enumerate(kinds.values())], list(kinds))


def end_digests(members: DataFrame) -> DataFrame:
    """(end1, end2, ends_sha256): SHA-256 of the decimal ids of each sequence's conversations, ascending, comma-joined.

    A digest is a chain, so one sequence's ids pass through one task; that task holds one batch of them.
    """
    ordered = members.repartition("end1", "end2").sortWithinPartitions("end1", "end2", "conv_id")
    return ordered.mapInArrow(_digests, "end1 long, end2 long, ends_sha256 string")


def conversation_nodes(turns: DataFrame) -> DataFrame:
    """The nodes of the rebuilt conversations, each with the digest of the conversations that end there."""
    trie = prefix_trie(rebuilt(turns))
    nodes = trie.nodes.join(end_digests(trie.members), ["end1", "end2"], "left")
    return nodes.drop("end1", "end2").withColumn("depth", F.col("depth").cast("long")).withColumn("ends_sha256", F.coalesce("ends_sha256", F.sha2(F.lit("").cast("binary"), 256)))


#: SQL of `conversation_nodes`: nodes by the running hash of their turns, subtrees by the paths of smallest members.
SQL = r"""WITH crc AS (SELECT list_transform(range(0, 256), lambda i: list_reduce(range(0, 8), lambda c, k: CASE WHEN c & 1 = 1 THEN xor(c >> 1, 3988292384) ELSE c >> 1 END, i)) AS tab),
t AS (SELECT conv_id, coalesce(role, '') AS role, coalesce(text, '') AS text, row_number() OVER (PARTITION BY conv_id ORDER BY turn NULLS FIRST, role, text) AS pos FROM conversations WHERE conv_id IS NOT NULL),
i AS (SELECT conv_id, conv_id - conv_id % 100 AS base, xor(list_reduce(list_transform(range(0, length(conv_id::VARCHAR)), lambda k: ascii(substr(conv_id::VARCHAR, k + 1, 1))::BIGINT), lambda c, x: xor(c >> 8, tab[(xor(c, x) & 255) + 1]), 4294967295::BIGINT), 4294967295) % 6 AS h
 FROM (SELECT DISTINCT conv_id FROM t), crc),
rb AS (SELECT i.conv_id, 0 AS own, pos, role, text FROM i JOIN t ON t.conv_id = base WHERE pos <= h UNION ALL SELECT i.conv_id, 1, pos, role, text FROM i JOIN t USING (conv_id) WHERE pos > h),
m AS (SELECT conv_id, row_number() OVER (PARTITION BY conv_id ORDER BY own, pos) AS depth, length(text) AS chars, md5(length(role)::VARCHAR || ':' || role || text) AS m FROM rb),
p AS (SELECT conv_id, depth, chars, md5(string_agg(m, '') OVER (PARTITION BY conv_id ORDER BY depth)) AS node FROM m UNION ALL SELECT conv_id, 0, 0, 'root' FROM i),
nd AS (SELECT node, depth, min(conv_id) AS conv_id, count(*) AS n_convs, max(chars) AS chars FROM p GROUP BY 1, 2),
pa AS (SELECT nd.node, u.node AS above FROM nd JOIN p u ON u.conv_id = nd.conv_id AND u.depth = nd.depth - 1),
ch AS (SELECT above AS node, count(*) AS n_children FROM pa GROUP BY 1),
st AS (SELECT u.node, count(*) FILTER (WHERE ch.node IS NULL) AS n_leaves, sum((nd.n_convs - 1) * nd.chars) AS saved FROM nd JOIN p u ON u.conv_id = nd.conv_id AND u.depth <= nd.depth LEFT JOIN ch ON ch.node = nd.node GROUP BY 1),
en AS (SELECT node, sha256(string_agg(conv_id::VARCHAR, ',' ORDER BY conv_id)) AS ends FROM p JOIN (SELECT conv_id, max(depth) AS depth FROM p GROUP BY 1) USING (conv_id, depth) GROUP BY 1)
SELECT nd.conv_id, nd.depth::BIGINT AS depth, up.conv_id AS parent_conv_id, nd.n_convs, coalesce(n_children, 0)::BIGINT AS n_children, n_leaves::BIGINT AS n_leaves, saved::BIGINT AS saved_tokens, coalesce(ends, sha256('')) AS ends_sha256
 FROM nd LEFT JOIN pa USING (node) LEFT JOIN nd up ON up.node = pa.above LEFT JOIN ch ON ch.node = nd.node JOIN st ON st.node = nd.node LEFT JOIN en ON en.node = nd.node"""
