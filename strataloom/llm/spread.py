"""Running totals over keys of any size: no group or order is ever brought into one task."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

BINS = 4096


def hex_bin(key: Column) -> Column:
    """Bin of a hexadecimal hash; its order is the order of the hashes."""
    return F.conv(F.substring(key, 1, 3), 16, 10).cast("int")


def running_before(df: DataFrame, groups: list[str], bin_col: str, order: list[str], value: str, out: str) -> DataFrame:
    """`out`: the sum of `value` over the rows of the group that stand before this one.

    `bin_col` must follow `order`: rows of a smaller bin come first. Sums of whole bins are carried over, and
    only the rows of one bin are ordered together, so a hot group is cut into as many tasks as it has bins.
    """
    keys = [*groups, bin_col]
    named = {k: f"__at_{i}" for i, k in enumerate(keys)}
    totals = df.groupBy(*[F.col(k).alias(named[k]) for k in keys]).agg(F.sum(value).alias("__sum"))
    before = Window.partitionBy(*([named[g] for g in groups] or [F.lit(0)])).orderBy(named[bin_col]).rowsBetween(Window.unboundedPreceding, -1)
    totals = totals.withColumn("__base", F.coalesce(F.sum("__sum").over(before), F.lit(0))).drop("__sum")
    same = None
    for k in keys:
        test = df[k].eqNullSafe(totals[named[k]])
        same = test if same is None else same & test
    inside = Window.partitionBy(*keys).orderBy(*order).rowsBetween(Window.unboundedPreceding, -1)
    joined = df.join(totals, same).withColumn(out, F.col("__base") + F.coalesce(F.sum(value).over(inside), F.lit(0)))
    return joined.drop("__base", *named.values())
