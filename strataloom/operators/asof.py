"""As-of joins by one running window per (key, time bucket)."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window as W


def asof_join(
    left: DataFrame,
    right: DataFrame,
    by: Sequence[str],
    left_on: str,
    right_on: str,
    payload: Sequence[str],
    direction: str = "backward",
    allow_exact: bool = True,
    tolerance: str | None = None,
    bucket: str | None = None,
) -> DataFrame:
    """For each left row the nearest right row of the same key before (or after) it.

    ``right`` is unique on (by, right_on). Adds ``payload`` and ``right_on``, null when there is no match
    or it is further away than ``tolerance`` (an interval text such as '7 days'). Rows with a null key or
    stamp stay without a match.

    Both sides are laid into one frame and scanned once, so each side is read once and a chain of lookups
    grows by one window each. ``bucket`` (a date_trunc unit) bounds a task to one bucket of one key: only the
    last (first) right row of every bucket is carried across buckets. Without it a key's whole series is
    one window, which is right for series bounded by the calendar (one row per day).
    """
    by = list(by)
    back = direction == "backward"
    item = F.struct(F.col(right_on).alias("__at"), *[F.col(c).alias(c) for c in payload])
    # 0 before 1 in the scan order decides whether an equal stamp is visible.
    order = 0 if allow_exact else 1
    rows_r = right.select(*by, F.col(right_on).alias("__t"), F.lit(order).alias("__o"), item.alias("__v"))
    rows_r = rows_r.where(F.col("__t").isNotNull())
    whole = F.struct(*[F.col(c).alias(c) for c in left.columns])
    rows_l = left.select(*by, F.col(left_on).alias("__t"), F.lit(1 - order).alias("__o"), whole.alias("__l"))
    rows = rows_r.unionByName(rows_l, allowMissingColumns=True)
    t = F.col("__t").asc() if back else F.col("__t").desc()
    if bucket is None:
        span = W.partitionBy(*by).orderBy(t, "__o").rowsBetween(W.unboundedPreceding, 0)
        seen = rows.withColumn("__hit", F.last("__v", ignorenulls=True).over(span))
    else:
        rows = rows.withColumn("__b", F.date_trunc(bucket, "__t"))
        pick = F.max_by if back else F.min_by
        edge = rows.groupBy(*by, "__b").agg(
            pick(F.when(F.col("__v").isNotNull(), F.col("__v")), F.when(F.col("__v").isNotNull(), F.col("__t"))).alias("__e")
        )
        b = F.col("__b").asc() if back else F.col("__b").desc()
        carry = F.last("__e", ignorenulls=True).over(W.partitionBy(*by).orderBy(b).rowsBetween(W.unboundedPreceding, -1))
        edge = edge.select(*by, "__b", carry.alias("__c"))
        span = W.partitionBy(*by, "__b").orderBy(t, "__o").rowsBetween(W.unboundedPreceding, 0)
        seen = rows.withColumn("__hit", F.last("__v", ignorenulls=True).over(span)).join(edge, [*by, "__b"], "left")
        seen = seen.withColumn("__hit", F.coalesce("__hit", "__c"))
    ok = F.col("__hit").isNotNull()
    for c in [*by, "__t"]:
        ok = ok & F.col(c).isNotNull()
    if tolerance:
        gap = F.expr(f"interval {tolerance}")
        at = F.col("__hit.__at")
        ok = ok & ((at >= F.col("__t") - gap) if back else (at <= F.col("__t") + gap))
    picked = [F.when(ok, F.col(f"__hit.{c}")).alias(c) for c in payload]
    out = seen.where(F.col("__l").isNotNull())
    return out.select(*[F.col(f"__l.{c}").alias(c) for c in left.columns], *picked, F.when(ok, F.col("__hit.__at")).alias(right_on))
