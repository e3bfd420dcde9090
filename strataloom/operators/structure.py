"""Structure of a panel's columns: common support, components and effective rank of correlations, eligibility, tails."""

from __future__ import annotations

from collections.abc import Mapping, Sequence

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from strataloom.functions.numbers import finite_or_null
from strataloom.operators.ranking import group_quantiles, long_values
from strataloom.session import cut_lineage


def support_overlap(df: DataFrame, cols: Sequence[str]) -> DataFrame:
    """(a, b, both): rows that have both columns, for every pair a < b and every column with itself; one aggregate."""
    known = {c: finite_or_null(c).isNotNull() for c in cols}
    pairs = [(a, b) for i, a in enumerate(cols) for b in cols[i:]]
    row = df.agg(*[F.struct(F.lit(a).alias("a"), F.lit(b).alias("b"), F.count_if(known[a] & known[b]).alias("both")).alias(f"p{i}") for i, (a, b) in enumerate(pairs)])
    return row.select(F.explode(F.array(*[f"p{i}" for i in range(len(pairs))])).alias("p")).select("p.*")


def overlap_summary(overlap: DataFrame) -> DataFrame:
    """One row over the pairs of different columns: pairs, minimum, maximum, mean, median, population_std."""
    return overlap.where("a <> b").agg(
        F.count(F.lit(1)).alias("pairs"), F.min("both").alias("minimum"), F.max("both").alias("maximum"), F.avg("both").alias("mean"), F.percentile("both", F.lit(0.5)).alias("median"), F.stddev_pop("both").alias("population_std")
    )


def component_labels(nodes: DataFrame, edges: DataFrame, node: str = "node") -> DataFrame:
    """(node, label): the smallest node reachable over edges (a, b).

    A round gives every node the smallest label among its own, its neighbours' and its label's own, so paths shorten by half or more; rounds are
    checkpointed and stop when no label changes.
    """
    both = edges.select("a", "b").unionByName(edges.select(F.col("b").alias("a"), F.col("a").alias("b"))).where("a <> b").distinct()
    both = cut_lineage(both)
    labels = cut_lineage(nodes.select(F.col(node).alias("v"), F.col(node).alias("label")))
    while True:
        near = both.join(labels, both["b"] == labels["v"]).groupBy("a").agg(F.min("label").alias("near"))
        step = labels.join(near, F.col("v") == F.col("a"), "left").select("v", F.col("label").alias("old"), F.least("label", F.coalesce("near", "label")).alias("label"))
        step = cut_lineage(step)
        own = step.select(F.col("v").alias("label"), F.col("label").alias("further"))
        new = cut_lineage(step.join(own, "label").select("v", "old", F.least("label", "further").alias("label")))
        labels = new.select("v", "label")
        if new.where(F.col("label") != F.col("old")).isEmpty():
            return labels.select(F.col("v").alias(node), "label")


def threshold_components(correlations: DataFrame, threshold: float) -> DataFrame:
    """(component, members, size, edge_count, min_abs_corr, median_abs_corr) of the graph of |correlation| >= threshold.

    correlations: (a, b, correlation), each pair once, a column with itself for its membership. Least and median are over all pairs of members; null for one.
    """
    size = F.abs("correlation")
    nodes = correlations.select(F.col("a").alias("node")).unionByName(correlations.select(F.col("b").alias("node"))).distinct()
    labels = cut_lineage(component_labels(nodes, correlations.where((F.col("a") != F.col("b")) & (size >= threshold))))
    of = lambda side: labels.select(F.col("node").alias(side), F.col("label").alias(f"__{side}"))
    inside = correlations.where("a <> b").join(of("a"), "a").join(of("b"), "b").where("__a = __b")
    pairs = inside.groupBy(F.col("__a").alias("component")).agg(F.count_if(size >= threshold).alias("edge_count"), F.min(size).alias("min_abs_corr"), F.percentile(size, F.lit(0.5)).alias("median_abs_corr"))
    out = labels.groupBy(F.col("label").alias("component")).agg(F.array_sort(F.collect_list("node")).alias("members"), F.count(F.lit(1)).alias("size"))
    return out.join(pairs, "component", "left").withColumn("edge_count", F.coalesce("edge_count", F.lit(0)))


def spectrum(matrix: np.ndarray) -> tuple[float, float]:
    """Participation ratio and spectral effective rank of a correlation matrix; eigenvalues within 1e-8 of the largest count as 0."""
    values = np.linalg.eigvalsh((matrix + matrix.T) / 2)
    if values.min() < -1e-8 * values.max():
        raise ValueError("the matrix has a negative eigenvalue")
    values = np.where(np.abs(values) <= 1e-8 * values.max(), 0.0, values)
    share = values[values > 0] / values.sum()
    return float(values.sum() ** 2 / (values * values).sum()), float(np.exp(-(share * np.log(share)).sum()))


def effective_rank(correlations: DataFrame) -> DataFrame:
    """One row: columns, participation_ratio, effective_rank, of correlations (a, b, correlation) as of one aggregate.

    The matrix has as many cells as columns squared and comes to the driver; rows never do. A missing correlation gives nulls.
    """
    held = {(r["a"], r["b"]): r["correlation"] for r in correlations.collect()}
    names = sorted({n for pair in held for n in pair})
    cell = lambda a, b: 1.0 if a == b else held.get((a, b), held.get((b, a)))
    cells = [[cell(a, b) for b in names] for a in names]
    known = bool(names) and all(v is not None for row in cells for v in row)
    ratio, rank = spectrum(np.array(cells)) if known else (None, None)
    return correlations.sparkSession.createDataFrame([(len(names), ratio, rank)], "columns int, participation_ratio double, effective_rank double")


def support_eligibility(df: DataFrame, windows: Mapping[str, Sequence[int]], cols: Sequence[str], period: str = "period", least: int = 2) -> DataFrame:
    """(feature, window, least_support, eligible, eligible_everywhere): a column needs `least` values in every period of every window."""
    spans = df.sparkSession.createDataFrame([(w, int(p)) for w, periods in windows.items() for p in periods], f"window string, {period} int")
    counts = df.groupBy(period).agg(*[F.count(finite_or_null(c)).alias(c) for c in cols])
    # as many rows as periods of windows
    held = spans.join(counts, period, "left")
    long = long_values(held.fillna(0, list(cols)), ["window"], cols)
    each = long.groupBy("feature", "window").agg(F.min("value").cast("long").alias("least_support")).withColumn("eligible", F.col("least_support") >= least)
    return each.join(each.groupBy("feature").agg(F.bool_and("eligible").alias("eligible_everywhere")), "feature")


def window_missingness(df: DataFrame, windows: Mapping[str, Sequence[int]], cols: Sequence[str], period: str = "period") -> DataFrame:
    """(window, feature, total_rows, known, missing, missing_rate) over the rows of each window's periods."""
    spans = df.sparkSession.createDataFrame([(w, int(p)) for w, periods in windows.items() for p in periods], f"window string, {period} int")
    counts = df.groupBy(period).agg(F.count(F.lit(1)).alias("__rows"), *[F.count(finite_or_null(c)).alias(c) for c in cols])
    total = spans.join(counts, period).groupBy("window").agg(F.sum("__rows").alias("total_rows"), *[F.sum(c).alias(c) for c in cols])
    out = long_values(total, ["window", "total_rows"], cols).withColumn("known", F.col("value").cast("long")).drop("value")
    return out.withColumn("missing", F.col("total_rows") - F.col("known")).withColumn("missing_rate", F.col("missing") / F.col("total_rows"))


# ---- tails -------------------------------------------------------------------------------------------


def tail_thresholds(train: DataFrame, cols: Sequence[str], q: float) -> DataFrame:
    """(feature, n, low, high, status): quantiles q and 1 - q of a column's training values; `insufficient_support` where (n - 1) q < 1."""
    long = long_values(train, [], cols).withColumn("value", finite_or_null("value"))
    out = group_quantiles(long, ["feature"], "value", {"low": q, "high": 1 - q})
    ready = (F.col("n") - 1) * q >= 1
    return out.withColumns({c: F.when(ready, F.col(c)) for c in ("low", "high")}).withColumn("status", F.when(ready, "ready").otherwise("insufficient_support"))


def _bounds(thresholds: DataFrame, cols: Sequence[str]) -> DataFrame:
    of = lambda c: F.max(F.when(F.col("feature") == c, F.struct("low", "high"))).alias(f"__{c}")
    return thresholds.agg(*[of(c) for c in cols])


def _tailed(df: DataFrame, thresholds: DataFrame, cols: Sequence[str], low, high) -> DataFrame:
    # one row of thresholds
    wide = df.join(F.broadcast(_bounds(thresholds, cols)))
    cell = lambda c: F.when(F.col(c) < F.col(f"__{c}.low"), low(c)).when(F.col(c) > F.col(f"__{c}.high"), high(c)).otherwise(F.col(c))
    return wide.withColumns({c: cell(c) for c in cols}).drop(*[f"__{c}" for c in cols])


def winsorise(df: DataFrame, thresholds: DataFrame, cols: Sequence[str]) -> DataFrame:
    """Values strictly outside a column's thresholds become the threshold; columns without thresholds stay."""
    return _tailed(df, thresholds, cols, lambda c: F.col(f"__{c}.low"), lambda c: F.col(f"__{c}.high"))


def trim(df: DataFrame, thresholds: DataFrame, cols: Sequence[str]) -> DataFrame:
    """Values strictly outside a column's thresholds become null."""
    return _tailed(df, thresholds, cols, lambda c: F.lit(None), lambda c: F.lit(None))


def tail_audit(df: DataFrame, thresholds: DataFrame, cols: Sequence[str], by: Sequence[str] = ("role",)) -> DataFrame:
    """(by, feature, n, below, above, affected_share, status): cells outside the thresholds; `no_op` where none is."""
    long = long_values(df, list(by), cols).withColumn("value", finite_or_null("value")).where("value IS NOT NULL")
    # one row a column
    hit = long.join(F.broadcast(thresholds.select("feature", "low", "high")), "feature", "left")
    out = hit.groupBy(*by, "feature").agg(F.count(F.lit(1)).alias("n"), F.count_if(F.col("value") < F.col("low")).alias("below"), F.count_if(F.col("value") > F.col("high")).alias("above"))
    affected = F.col("below") + F.col("above")
    return out.withColumn("affected_share", affected / F.col("n")).withColumn("status", F.when(affected > 0, "ready").otherwise("no_op"))


def surface_delta(stress: DataFrame, baseline: DataFrame, keys: Sequence[str] = ("model", "split"), alpha: float = 0.05) -> DataFrame:
    """(keys, delta_ic, delta_n, verdict_changed) of two surfaces (keys, ic, n, p_value)."""
    side = lambda df, tag: df.select(*keys, *[F.col(c).alias(f"{c}_{tag}") for c in ("ic", "n", "p_value")])
    both = side(stress, "s").join(side(baseline, "b"), list(keys))
    verdict = (F.col("p_value_s") < alpha) != (F.col("p_value_b") < alpha)
    return both.select(*keys, (F.col("ic_s") - F.col("ic_b")).alias("delta_ic"), (F.col("n_s") - F.col("n_b")).alias("delta_n"), verdict.alias("verdict_changed"))
