"""Mixing sources to target weights by weighted fair queueing."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from strataloom.llm.spread import BINS, hex_bin, running_before
from strataloom.session import cut_lineage

WEIGHTS = (5, 2, 1)


def word_count(text: str | Column) -> Column:
    """Runs of bytes other than space and 0x09-0x0D; null texts have none."""
    return F.coalesce(F.regexp_count(F.col(text) if isinstance(text, str) else text, F.lit(r"[^\x20\x09-\x0D]+")), F.lit(0)).cast("long")


def source_targets(sizes: DataFrame, weights: tuple[float, ...] = WEIGHTS, budget: float = 1.5, epochs: int = 2) -> DataFrame:
    """One row a source: source, source_size, target.

    Sources in code point order, null last, weigh `weights` in turn and share `budget` times all sizes. A
    target stops at `epochs` times its source's size; what is over is shared again by weight. In the
    order of size for weight the stopped sources come first, so one pass of running sums finds them: the
    level rises up to the first source that does not stop, whose level is shared by all from there on.
    """
    held = sizes.groupBy("source").agg(F.sum("size").alias("source_size"))
    whole = Window.partitionBy(F.lit(0))
    turn = F.row_number().over(whole.orderBy(F.col("source").asc_nulls_last())) - 1
    held = held.withColumn("weight", F.element_at(F.array(*[F.lit(float(w)) for w in weights]), (turn % len(weights) + 1).cast("int")))
    held = held.withColumn("cap", (F.col("source_size") * epochs).cast("double")).withColumn("budget", F.sum("source_size").over(whole) * F.lit(float(budget)))
    by_room = whole.orderBy(F.col("cap") / F.col("weight"), F.col("source").asc_nulls_last())
    stopped = F.coalesce(F.sum("cap").over(by_room.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0.0))
    held = held.withColumn("level", (F.col("budget") - stopped) / F.sum("weight").over(by_room.rowsBetween(0, Window.unboundedFollowing)))
    held = held.withColumn("open_level", F.max(F.when(F.col("cap") > F.col("weight") * F.col("level"), F.col("level"))).over(whole))
    target = F.when(F.col("cap") <= F.col("weight") * F.col("level"), F.col("cap")).otherwise(F.col("weight") * F.col("open_level"))
    return held.select("source", "source_size", target.alias("target"))


def mix_sources(
    docs: DataFrame,
    id_col: str = "doc_id",
    text_col: str = "text",
    source_col: str = "source",
    weights: tuple[float, ...] = WEIGHTS,
    budget: float = 1.5,
    epochs: int = 2,
) -> DataFrame:
    """One row a document: id, source, size, source_size, target, taken, mix_start.

    Within a source documents come in the order of the md5 of their id, as often as there are epochs. A turn
    of a document finishes at virtual time (words of its source up to and with it) / (target of its
    source). All turns are range-sorted by that time; `mix_start` is the number of words in the mix
    before the document's first turn, null if it has none. The mix ends at the budget, which is
    virtual time 1; a document then in service gives the words its source still owes.

    A null text has no words and is never taken; a null source is a source of its own; rows with one id are
    separate documents. An empty table gives no rows; where no text has words, all targets are 0.
    """
    sized = docs.select(
        F.col(id_col).alias("id"), F.col(source_col).alias("source"), word_count(F.col(text_col)).alias("size"), F.md5(F.coalesce(F.col(id_col).cast("string"), F.lit(""))).alias("key")
    )
    sized = cut_lineage(sized.withColumn("bin", hex_bin(F.col("key"))))
    targets = source_targets(sized, weights, budget, epochs).withColumnRenamed("source", "__source")
    placed = running_before(sized, ["source"], "bin", ["key", "size"], "size", "before")
    placed = placed.join(targets, placed["source"].eqNullSafe(targets["__source"])).drop("__source")

    share = F.floor("target").cast("long")
    turns = [F.greatest(F.lit(0).cast("long"), F.least(F.col("size"), share - F.col("source_size") * e - F.col("before"))) for e in range(epochs)]
    placed = placed.withColumns({f"turn_{e}": t for e, t in enumerate(turns)})
    total = turns[0] * 0
    for e in range(epochs):
        total = total + F.col(f"turn_{e}")
    placed = cut_lineage(placed.withColumn("taken", total))

    finish = [F.least(F.lit(1.0), F.try_divide(F.col("source_size") * e + F.col("before") + F.col("size"), F.col("target"))) for e in range(epochs)]
    entries = placed.select("*", F.explode(F.array(*[F.struct(F.lit(e).alias("epoch"), finish[e].alias("finish"), F.col(f"turn_{e}").alias("words")) for e in range(epochs)])).alias("t"))
    entries = entries.select("id", "source", "size", "source_size", "target", "taken", "key", "t.epoch", "t.finish", "t.words").where("words > 0")
    entries = entries.withColumn("time_bin", F.floor(F.col("finish") * BINS).cast("int"))
    queued = running_before(entries, [], "time_bin", ["finish", "source", "key", "size", "epoch"], "words", "mix_start").where("epoch = 0")
    names = ["id", "source", "size", "source_size", "target", "taken"]
    out = queued.select(*names, "mix_start").union(placed.where("turn_0 = 0").select(*names, F.lit(None).cast("long")))
    return out.withColumnRenamed("id", id_col).withColumnRenamed("source", source_col)


def mixed_documents(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", source_col: str = "source", **options) -> DataFrame:
    """The documents of the mix, all their columns: each stands as often as the mix takes its words, rounded half up.

    Documents without words, and those of which the mix takes less than half, are not in it.
    """
    own = Window.partitionBy("__id", "__source", "__size")
    told = mix_sources(docs, id_col, text_col, source_col, **options).where("taken > 0")
    told = told.select(
        F.col(id_col).alias("__id"),
        F.col(source_col).alias("__source"),
        F.col("size").alias("__size"),
        F.floor(F.col("taken") / F.col("size") + 0.5).cast("int").alias("__turns"),
        F.row_number().over(Window.partitionBy(id_col, source_col, "size").orderBy("taken", "mix_start")).alias("__copy"),
    )
    keyed = docs.withColumns({"__id": F.col(id_col), "__source": F.col(source_col), "__size": word_count(F.col(text_col))})
    keyed = keyed.withColumn("__copy", F.row_number().over(own.orderBy(F.xxhash64(text_col))))
    same = None
    for c in ("__id", "__source", "__size", "__copy"):
        test = keyed[c].eqNullSafe(told[c])
        same = test if same is None else same & test
    joined = keyed.join(told, same).where("__turns > 0")
    return joined.select(*[keyed[c] for c in docs.columns], F.explode(F.sequence(F.lit(1), F.col("__turns"))).alias("__turn")).drop("__turn")


#: The rows of mix_sources over `documents` at its usual parameters.
SQL = r"""
WITH sized AS (
  SELECT doc_id, source, coalesce(len(regexp_extract_all(text, '[^\x20\x09-\x0D]+')), 0) AS size, md5(coalesce(CAST(doc_id AS VARCHAR), '')) AS key
  FROM documents),
held AS (
  SELECT source, CAST(sum(size) AS BIGINT) AS source_size,
         (ARRAY[5.0::DOUBLE, 2.0::DOUBLE, 1.0::DOUBLE])[1 + (row_number() OVER (ORDER BY source ASC NULLS LAST) - 1) % 3] AS weight
  FROM sized GROUP BY source),
roomy AS (
  SELECT *, CAST(source_size * 2 AS DOUBLE) AS cap, CAST(sum(source_size) OVER () AS DOUBLE) * 1.5::DOUBLE AS budget FROM held),
levels AS (
  SELECT *, (budget - coalesce(sum(cap) OVER (ORDER BY cap / weight, source ASC NULLS LAST ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0.0::DOUBLE))
            / sum(weight) OVER (ORDER BY cap / weight, source ASC NULLS LAST ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING) AS level
  FROM roomy),
opened AS (SELECT *, max(CASE WHEN cap > weight * level THEN level END) OVER () AS open_level FROM levels),
targets AS (
  SELECT source, source_size, CASE WHEN cap <= weight * level THEN cap ELSE weight * open_level END AS target FROM opened),
placed AS (
  SELECT s.*, t.source_size, t.target,
         CAST(coalesce(sum(size) OVER (PARTITION BY s.source ORDER BY key, size ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS BIGINT) AS before
  FROM sized s JOIN targets t ON s.source IS NOT DISTINCT FROM t.source),
turns AS (
  SELECT p.*, e.epoch, least(1.0::DOUBLE, (source_size * e.epoch + before + size) / target) AS finish,
         greatest(0, least(size, CAST(floor(target) AS BIGINT) - source_size * e.epoch - before)) AS words
  FROM placed p, (VALUES (0), (1)) e(epoch)),
queued AS (
  SELECT *, CAST(coalesce(sum(words) OVER (ORDER BY finish, source ASC NULLS FIRST, key, size, epoch ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS BIGINT) AS at
  FROM turns WHERE words > 0),
taken AS (
  SELECT doc_id, source, size, source_size, target, key, before,
         CAST(sum(words) AS BIGINT) AS taken
  FROM turns GROUP BY doc_id, source, size, source_size, target, key, before)
SELECT t.doc_id, CAST(t.size AS BIGINT) AS size, t.source_size, t.target, t.taken, q.at AS mix_start
FROM taken t LEFT JOIN queued q ON q.epoch = 0 AND q.doc_id = t.doc_id AND q.before = t.before AND q.source IS NOT DISTINCT FROM t.source
"""
