"""Exact ranks, positions, quantiles and running totals inside groups of any size.

A window partitioned by period alone sends a whole period to one task. Everything here works on
*tallies* (distinct values with counts, combined map-side), which are range-partitioned by group and
value: Spark samples the keys themselves, so a group of any size, with any kind of key, is cut into as many
even ranges as its rows fill. A running sum inside (group, range) plus the totals of the group's ranges
before it gives the position.

The ranged tally is written to the checkpoint folder once. It fixes the ranges for both of its readers, and it ends
the plan: what is ranked is read once, however many ranks are built on each other.
"""

from __future__ import annotations

from collections.abc import Callable, Mapping, Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window as W

from strataloom.functions.numbers import as_col
from strataloom.session import cut_lineage

def rank_input(c: str | Column, digits: int = 9) -> Column:
    """Computed doubles are rounded before ranking, so that ties do not depend on summation order."""
    return F.round(as_col(c), digits)


def _before(w: str, part: Sequence[str], order: str) -> Column:
    span = W.partitionBy(*part).orderBy(order).rowsBetween(W.unboundedPreceding, -1)
    return F.coalesce(F.sum(w).over(span), F.lit(0))


def cumulate(dist: DataFrame, by: Sequence[str], order: Sequence[str], weight: str | None = None) -> DataFrame:
    """Add ``below`` (weight of the rows ordered before) and ``n`` (weight of the group).

    ``order`` must be unique inside a group. Group columns must not be null.
    """
    by = list(by)
    src = dist.withColumn("__w", F.col(weight) if weight else F.lit(1).cast("bigint"))
    ranged = cut_lineage(src.repartitionByRange(*by, *order).withColumn("__range", F.spark_partition_id()))
    totals = ranged.groupBy(*by, "__range").agg(F.sum("__w").alias("__rw"))
    group = W.partitionBy(*by)
    totals = totals.select(*by, "__range", _before("__rw", by, "__range").alias("__base"), F.sum("__rw").over(group).alias("n"))
    inside = W.partitionBy(*by, "__range").orderBy(*order).rowsBetween(W.unboundedPreceding, 0)
    placed = ranged.join(totals, [*by, "__range"])
    return placed.select(*dist.columns, (F.sum("__w").over(inside) - F.col("__w") + F.col("__base")).alias("below"), "n")


def tally(df: DataFrame, by: Sequence[str], value: str) -> DataFrame:
    """Distinct non-null values of a group with their counts (``ties``)."""
    return df.where(F.col(value).isNotNull()).groupBy(*by, value).agg(F.count(F.lit(1)).alias("ties"))


def tally_ranks(df: DataFrame, by: Sequence[str], value: str) -> DataFrame:
    """(by, value, ties, below, n): everything needed for any tie rule."""
    return cumulate(tally(df, by, value), by, [value], "ties")


# Rank formulas over (below, ties, n). Ascending unless named otherwise.
def pct_average(below: Column, ties: Column, n: Column) -> Column:
    return (below + (ties + 1) / 2) / n


def average_rank(below: Column, ties: Column, n: Column) -> Column:
    return below + (ties + 1) / 2


def average_rank_desc(below: Column, ties: Column, n: Column) -> Column:
    return n - below - ties + (ties + 1) / 2


def min_rank_desc(below: Column, ties: Column, n: Column) -> Column:
    return n - below - ties + 1


def share_below(below: Column, ties: Column, n: Column) -> Column:
    """Percentage strictly below, over n."""
    return below * F.lit(100.0) / n


def share_below_others(below: Column, ties: Column, n: Column) -> Column:
    """Share strictly below, over n - 1; 0.5 for a lone value."""
    return F.when(n > 1, below / (n - 1)).otherwise(F.lit(0.5))


def midrank(below: Column, ties: Column, n: Column) -> Column:
    """(average rank - 1) / (n - 1); 0.5 for a lone value."""
    return F.when(n > 1, (below + (ties - 1) / 2) / (n - 1)).otherwise(F.lit(0.5))


Formula = Callable[[Column, Column, Column], Column]


def long_values(df: DataFrame, keep: Sequence[str], cols: Sequence[str]) -> DataFrame:
    """(keep..., feature, value) with one row per column and input row."""
    pairs = [F.struct(F.lit(c).alias("feature"), F.col(c).cast("double").alias("value")) for c in cols]
    return df.select(*keep, F.explode(F.array(*pairs)).alias("__p")).select(*keep, "__p.feature", "__p.value")


def row_ranks(rows: DataFrame, by: Sequence[str], value: str, salt: str) -> DataFrame:
    """Add ``__below``, ``__ties`` and ``__n`` to rows; the rows themselves are ranged, so no rank is joined back by value.

    Rows go to even ranges of (group, value, salt), so that a value of any number of rows is cut as well. A range ranks its own
    rows; what it shares with its neighbours are its first and its last value, whose place and ties follow from all ranges'
    totals. Values must not be null; in a null group all three are null.
    """
    by = list(by)
    ranged = cut_lineage(rows.repartitionByRange(*by, value, salt).withColumn("__range", F.spark_partition_id()))
    spans = ranged.groupBy(*by, "__range", value).agg(F.count(F.lit(1)).alias("__c")).groupBy(*by, "__range").agg(
        F.sum("__c").alias("__rows"),
        F.min(value).alias("__first"),
        F.max(value).alias("__last"),
        F.min_by("__c", value).alias("__cf"),
        F.max_by("__c", value).alias("__cl"),
    )
    spans = cut_lineage(spans.withColumns({"__base": _before("__rows", by, "__range"), "__n": F.sum("__rows").over(W.partitionBy(*by))}))
    lone = F.col("__first") == F.col("__last")
    ends = F.array(
        F.struct(F.col("__first").alias("v"), F.col("__base").alias("below"), F.col("__cf").alias("c")),
        F.struct(F.col("__last").alias("v"), (F.col("__base") + F.col("__rows") - F.col("__cl")).alias("below"), F.when(lone, 0).otherwise(F.col("__cl")).alias("c")),
    )
    ends = spans.select(*by, F.explode(ends).alias("e")).groupBy(*by, F.col("e.v").alias("__v")).agg(F.min("e.below").alias("b"), F.sum("e.c").alias("t"))
    for end in ("__first", "__last"):
        spans = spans.join(ends.select(*by, F.col("__v").alias(end), F.struct("b", "t").alias(f"{end}_at")), [*by, end])
    inside = W.partitionBy(*by, "__range").orderBy(value)
    # one window tells both: rows below, and rows up to and with the value
    placed = ranged.withColumns({"__b": F.rank().over(inside) - 1, "__upto": F.count(F.lit(1)).over(inside)}).withColumn("__t", F.col("__upto") - F.col("__b"))
    placed = placed.join(spans, [*by, "__range"], "left")
    own = F.struct((F.col("__base") + F.col("__b")).alias("b"), F.col("__t").alias("t"))
    spot = F.when(F.col(value) == F.col("__first"), F.col("__first_at")).when(F.col(value) == F.col("__last"), F.col("__last_at")).otherwise(own)
    placed = placed.withColumn("__spot", spot)
    return placed.select(*rows.columns, F.col("__spot.b").alias("__below"), F.when(F.col("__n").isNotNull(), F.col("__spot.t")).alias("__ties"), "__n")


def rank_within(
    df: DataFrame,
    keys: Sequence[str],
    by: Sequence[str],
    outputs: Mapping[str, tuple[str, Formula]],
) -> DataFrame:
    """Add rank columns: ``outputs`` maps a new column to (source column, formula).

    All sources are ranked together in long form: one shuffle by (group, feature, value), one back by row. The first
    feature's row carries the other columns, so ``df`` is read once. Null stays null and is not counted, nor is a row of a null group.
    ``keys`` identify a row and include ``by``.
    """
    keys, by = list(keys), list(by)
    sources = sorted({src for src, _ in outputs.values()})
    rest = [c for c in df.columns if c not in by]
    pairs = [F.struct(F.lit(i).alias("f"), (F.col(c).cast("double") + F.lit(0.0)).alias("v")) for i, c in enumerate(sources)]
    long = df.withColumn("__id", F.monotonically_increasing_id()).withColumn("__p", F.explode(F.array(*pairs)))
    known = F.col("__p.v").isNotNull()
    long = long.where(known | (F.col("__p.f") == 0)).select(
        *by,
        # rows that only carry are a feature of their own
        F.when(known, F.col("__p.f")).otherwise(len(sources)).alias("__src"),
        F.coalesce("__p.v", F.lit(0.0)).alias("__val"),
        "__id",
        *[F.when(F.col("__p.f") == 0, F.col(c)).alias(c) for c in rest],
    )
    ranked = row_ranks(long, [*by, "__src"], "__val", "__id")
    aggs = [F.first(c, ignorenulls=True).alias(c) for c in rest]
    for out, (src, rule) in outputs.items():
        counted = (F.col("__src") == sources.index(src)) & F.col("__n").isNotNull()
        aggs.append(F.max(F.when(counted, rule(F.col("__below"), F.col("__ties"), F.col("__n")))).alias(out))
    back = ranked.groupBy(*by, "__id").agg(*aggs)
    return back.select(*keys, *[c for c in df.columns if c not in keys], *outputs)


def pct_rank(df: DataFrame, keys: Sequence[str], by: Sequence[str], cols: Sequence[str], suffix: str = "__pct") -> DataFrame:
    """Average-tie percentile rank in (0, 1] within ``by``; null stays null."""
    return rank_within(df, keys, by, {f"{c}{suffix}": (c, pct_average) for c in cols})


def ordinal(df: DataFrame, by: Sequence[str], value: str, tie: str, out: str, descending: bool = True) -> DataFrame:
    """Unique rank 1..n by ``value`` (null rows are dropped) with ``tie`` ascending inside equal values."""
    rows = df.where(F.col(value).isNotNull())
    ranked = tally_ranks(rows, by, value)
    ahead = F.col("n") - F.col("below") - F.col("ties") if descending else F.col("below")
    ranked = ranked.select(*by, value, ahead.alias("__ahead"))
    spot = cumulate(rows, [*by, value], [tie]).drop("n").withColumnRenamed("below", "__in_tie")
    return (
        spot.join(ranked, [*by, value])
        .withColumn(out, (F.col("__ahead") + F.col("__in_tie") + 1).cast("bigint"))
        .drop("__ahead", "__in_tie")
    )


def key_positions(df: DataFrame, by: Sequence[str], key: str, out: str = "slot") -> DataFrame:
    """Number the rows of a group 1..n by a key that is unique inside it; also adds ``n``."""
    placed = cumulate(df, by, [key])
    return placed.withColumn(out, (F.col("below") + 1).cast("bigint")).drop("below")


def group_quantiles(df: DataFrame, by: Sequence[str], value: str, quantiles: Mapping[str, float]) -> DataFrame:
    """Exact linear-interpolation quantiles per group, from tallies (no group is held in memory)."""
    ranked = tally_ranks(df, by, value)
    aggs = []
    for name, q in quantiles.items():
        spot = (F.col("n") - 1) * F.lit(float(q))
        holds = lambda k: (F.col("below") <= k) & (k < F.col("below") + F.col("ties"))
        aggs += [
            F.max(F.when(holds(F.floor(spot)), F.col(value))).alias(f"__l_{name}"),
            F.max(F.when(holds(F.ceil(spot)), F.col(value))).alias(f"__u_{name}"),
            F.max(spot - F.floor(spot)).alias(f"__f_{name}"),
        ]
    out = ranked.groupBy(*by).agg(F.max("n").alias("n"), *aggs)
    lerp = lambda k: F.col(f"__l_{k}") + (F.col(f"__u_{k}") - F.col(f"__l_{k}")) * F.col(f"__f_{k}")
    return out.select(*by, "n", *[lerp(k).alias(k) for k in quantiles])


def group_order_stats(df: DataFrame, by: Sequence[str], value: str, picks: Mapping[str, float]) -> DataFrame:
    """Element floor(q * n) of the sorted group (0-based) per named q."""
    ranked = tally_ranks(df, by, value)
    aggs = []
    for name, q in picks.items():
        k = F.floor(F.col("n") * F.lit(float(q)))
        aggs.append(F.max(F.when((F.col("below") <= k) & (k < F.col("below") + F.col("ties")), F.col(value))).alias(name))
    return ranked.groupBy(*by).agg(F.max("n").alias("n"), *aggs)


def with_group_stats(df: DataFrame, by: Sequence[str], *aggs: Column) -> DataFrame:
    """Join group aggregates back. The aggregate is combined map-side; no row window over the group."""
    return df.join(df.groupBy(*by).agg(*aggs), list(by), "left")
