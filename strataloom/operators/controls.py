"""Negative and positive controls as operations on a panel: permuted columns and masks, noise, reordered values, faults, differences.

Positions are taken in groups of any size (`ranking.cumulate`), and every random order is that of a keyed hash, so results
don't depend on partitioning.
"""

from __future__ import annotations

import math
from collections.abc import Callable, Mapping, Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window as W

from strataloom.functions.keys import HASH_DIGITS, keyed_hash
from strataloom.functions.numbers import finite_or_null
from strataloom.operators.ranking import cumulate, group_quantiles
from strataloom.session import cut_lineage

UNIT = float(16**HASH_DIGITS)


def _slots(rows: DataFrame, by: list[str], order: Sequence[str]) -> DataFrame:
    return cumulate(rows, by, order).withColumn("__slot", F.col("below")).drop("below", "n")


def _shuffled(rows: DataFrame, by: list[str], keys: list[str], value: str, seed: int) -> DataFrame:
    """(keys, value): each row has the value of another of its group: the one at its place by key stands at that place in hash order."""
    rest = [k for k in keys if k not in by]
    hashed = rows.withColumn("__h", keyed_hash(F.lit(str(seed)), *keys))
    given = _slots(hashed.select(*by, *rest, "__h", value), by, ["__h", *rest]).select(*by, "__slot", value)
    return _slots(rows.select(*by, *rest), by, rest).join(given, [*by, "__slot"]).drop("__slot")


def permute_column(df: DataFrame, col: str, by: Sequence[str], keys: Sequence[str], seed: int) -> DataFrame:
    """df with the known values of a column shuffled inside each group; nulls stay where they are. `keys` identify a row."""
    by, keys = list(by), list(dict.fromkeys([*by, *keys]))
    known = df.where(F.col(col).isNotNull()).select(*keys, F.col(col).alias("__v"))
    moved = _shuffled(known, by, keys, "__v", seed)
    return df.join(moved, keys, "left").withColumn(col, F.col("__v")).drop("__v")


def permute_mask(df: DataFrame, cols: Sequence[str], by: Sequence[str], keys: Sequence[str], seed: int) -> DataFrame:
    """(keys, missing: array<boolean> by column): whole rows of missing flags shuffled inside each group."""
    by, keys = list(by), list(dict.fromkeys([*by, *keys]))
    flags = df.select(*keys, F.array(*[F.col(c).isNull() for c in cols]).alias("missing"))
    return _shuffled(flags, by, keys, "missing", seed)


def apply_mask(df: DataFrame, mask: DataFrame, cols: Sequence[str], keys: Sequence[str]) -> DataFrame:
    """df with each column null where the row's mask says so; rows without a mask are kept as they are."""
    hit = df.join(mask, list(keys), "left")
    return hit.withColumns({c: F.when(~F.coalesce(F.get("missing", F.lit(i)), F.lit(False)), F.col(c)) for i, c in enumerate(cols)}).drop("missing")


def gaussian(seed: int, *parts: str | Column) -> Column:
    """A standard normal number of the seed and the parts, from two hashed uniforms."""
    one, two = ((keyed_hash(F.lit(str(seed)), F.lit(str(k)), *parts) + 0.5) / UNIT for k in (1, 2))
    return F.sqrt(-2 * F.log(one)) * F.cos(2 * math.pi * two)


def noise_panel(df: DataFrame, cols: Sequence[str], keys: Sequence[str], seed: int) -> DataFrame:
    """df with every cell of the columns, null or not, replaced by noise of its keys and column; keys and other columns stay."""
    return df.withColumns({c: gaussian(seed, F.lit(c), *keys) for c in cols})


def rank_matched(df: DataFrame, col: str, latent: str, by: Sequence[str], keys: Sequence[str]) -> DataFrame:
    """df with a column's own known values of each group put in the order of `latent` (null last, keys breaking ties); nulls stay."""
    by, keys = list(by), list(dict.fromkeys([*by, *keys]))
    rest = [k for k in keys if k not in by]
    known = df.where(F.col(col).isNotNull()).select(*by, *rest, F.col(col).alias("__v"), F.col(latent).alias("__l"), F.col(latent).isNull().alias("__n"))
    known = cut_lineage(known)
    values = _slots(known.select(*by, *rest, "__v"), by, ["__v", *rest]).select(*by, "__slot", "__v")
    wanted = _slots(known.drop("__v"), by, ["__n", "__l", *rest]).select(*keys, "__slot")
    moved = wanted.join(values, [*by, "__slot"]).select(*keys, "__v")
    return df.join(moved, keys, "left").withColumn(col, F.col("__v")).drop("__v")


def attenuation(checkpoints: DataFrame, by: Sequence[str] = ("model",), stage: str = "stage", ic: str = "ic") -> DataFrame:
    """checkpoints (by, stage, ic), stages ascending from the injected one, with ratio_to_injected and ratio_to_previous; a zero or missing base gives null."""
    order = W.partitionBy(*by).orderBy(stage)
    first = F.first(ic).over(order.rowsBetween(W.unboundedPreceding, 0))
    ratio = lambda base: F.try_divide(F.col(ic), F.nullif(base, F.lit(0.0)))
    place = F.row_number().over(order)
    return checkpoints.withColumns({"ratio_to_injected": F.when(place > 1, ratio(first)), "ratio_to_previous": F.when(place > 1, ratio(F.lag(ic).over(order)))})


# ---- faults ------------------------------------------------------------------------------------------

FAULTS = ("future_value", "rotated_target", "leaked_column", "outcome_selected_rows", "duplicated_period")


def inject_fault(df: DataFrame, kind: str, feature: str, target: str = "target", entity: str = "entity", period: str = "period") -> DataFrame:
    """A copy of the panel with one fault.

    future_value: the feature's value of the entity's next period stands in each period that has one. rotated_target: an
    entity's known targets move on by one of its periods, the last to the first. leaked_column: a new column `leaked` repeats the target.
    outcome_selected_rows: only rows without a target or with one at or above their period's median stay. duplicated_period: every row of
    the first period stands twice.
    """
    if kind == "future_value":
        later = df.select(entity, (F.col(period) - 1).alias(period), F.col(feature).alias("__f"), F.lit(True).alias("__hit"))
        return df.join(later, [entity, period], "left").withColumn(feature, F.when(F.col("__hit"), F.col("__f")).otherwise(F.col(feature))).drop("__f", "__hit")
    if kind == "rotated_target":
        known = df.where(F.col(target).isNotNull()).select(entity, period, F.col(target).alias("__t"))
        order, whole = W.partitionBy(entity).orderBy(period), W.partitionBy(entity)
        before = F.coalesce(F.lag("__t").over(order), F.max_by("__t", period).over(whole))
        moved = known.select(entity, period, before.alias("__t"))
        return df.join(moved, [entity, period], "left").withColumn(target, F.col("__t")).drop("__t")
    if kind == "leaked_column":
        return df.withColumn("leaked", F.col(target))
    if kind == "outcome_selected_rows":
        middle = group_quantiles(df.select(period, finite_or_null(target).alias("__t")), [period], "__t", {"__m": 0.5}).drop("n")
        return df.join(middle, period, "left").where(F.col(target).isNull() | (F.col(target) >= F.col("__m"))).drop("__m")
    if kind == "duplicated_period":
        first = df.agg(F.min(period).alias("__first"))
        return df.join(F.broadcast(first)).withColumn("__k", F.explode(F.when(F.col(period) == F.col("__first"), F.array(F.lit(1), F.lit(2))).otherwise(F.array(F.lit(1))))).drop("__first", "__k")
    raise ValueError(f"no such fault: {kind}")


def frame_diff(a: DataFrame, b: DataFrame, keys: Sequence[str], cols: Sequence[str]) -> DataFrame:
    """(column, changed, only_left, only_right, equal): cells of common keys that differ, null being equal to null; keys of one side only.

    Keys are unique on both sides; see `multiset_diff` for panels that may repeat them.
    """
    keys = list(keys)
    left = a.select(*keys, F.struct(*[F.col(c).alias(c) for c in cols]).alias("__a"))
    right = b.select(*keys, F.struct(*[F.col(c).alias(c) for c in cols]).alias("__b"))
    both = left.join(right, keys, "full")
    common = F.col("__a").isNotNull() & F.col("__b").isNotNull()
    counts = [F.struct(F.lit(c).alias("column"), F.count_if(common & ~F.col(f"__a.{c}").eqNullSafe(F.col(f"__b.{c}"))).alias("changed")).alias(f"c{i}") for i, c in enumerate(cols)]
    row = both.agg(*counts, F.count_if(F.col("__b").isNull()).alias("only_left"), F.count_if(F.col("__a").isNull()).alias("only_right"))
    out = row.select(F.explode(F.array(*[f"c{i}" for i in range(len(cols))])).alias("c"), "only_left", "only_right").select("c.*", "only_left", "only_right")
    return out.withColumn("equal", (F.col("changed") == 0) & (F.col("only_left") == 0) & (F.col("only_right") == 0))


def multiset_diff(a: DataFrame, b: DataFrame, by: Sequence[str], cols: Sequence[str]) -> DataFrame:
    """(by, differing): how many rows of a group stand more often on one side than on the other, as values of `cols`."""
    side = lambda df, sign: df.select(*by, *cols).groupBy(*by, *cols).agg((F.count(F.lit(1)) * sign).alias("__n"))
    net = side(a, 1).unionByName(side(b, -1)).groupBy(*by, *cols).agg(F.sum("__n").alias("__n"))
    return net.groupBy(*by).agg(F.sum(F.abs("__n")).alias("differing"))


Guard = Callable[[DataFrame], DataFrame]


def fault_matrix(df: DataFrame, feature: str, guards: Mapping[str, Guard], faults: Sequence[str] = FAULTS, **names: str) -> DataFrame:
    """(fault, guard, violations, clean_violations, detected): what each guard finds in the panel with each fault, and in the clean one.

    A guard gives the rows it objects to. A fault is detected where its panel has objections and the clean one has none.
    """
    found = None
    for fault in ("clean", *faults):
        panel = df if fault == "clean" else inject_fault(df, fault, feature, **names)
        for name, guard in guards.items():
            row = guard(panel).agg(F.count(F.lit(1)).alias("violations")).select(F.lit(fault).alias("fault"), F.lit(name).alias("guard"), "violations")
            found = row if found is None else found.unionByName(row)
    found = cut_lineage(found)
    clean = found.where("fault = 'clean'").select("guard", F.col("violations").alias("clean_violations"))
    return found.where("fault <> 'clean'").join(clean, "guard").withColumn("detected", (F.col("violations") > 0) & (F.col("clean_violations") == 0))
