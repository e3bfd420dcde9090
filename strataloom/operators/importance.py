"""How much each column says of a target, by several methods, each brought to 0..1 over the columns."""

from __future__ import annotations

from collections.abc import Sequence

import numpy as np
from pyspark.ml.classification import LogisticRegression, RandomForestClassifier
from pyspark.ml.clustering import KMeans
from pyspark.ml.evaluation import ClusteringEvaluator
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window as W

from strataloom.functions.numbers import finite_or_null, guarded_corr
from strataloom.operators.models import Linear, _square, assembled, column_moments, product_sums, solve, standardised
from strataloom.operators.ranking import average_rank, group_quantiles, long_values, rank_within
from strataloom.session import cut_lineage

METHODS = ("pearson", "spearman", "mutual_information", "lasso", "forest", "elimination", "cluster", "shap")


def median_filled(df: DataFrame, cols: Sequence[str]) -> DataFrame:
    """Columns with their median for missing values, 0 where there is none."""
    long = long_values(df, [], cols).withColumn("value", finite_or_null("value"))
    middle = group_quantiles(long, ["feature"], "value", {"m": 0.5})
    row = middle.agg(*[F.coalesce(F.max(F.when(F.col("feature") == c, F.col("m"))), F.lit(0.0)).alias(f"__{c}") for c in cols])
    # one row
    wide = df.join(F.broadcast(row))
    return wide.withColumns({c: F.coalesce(finite_or_null(c), F.col(f"__{c}")) for c in cols}).drop(*[f"__{c}" for c in cols])


def correlations(df: DataFrame, cols: Sequence[str], keys: Sequence[str], target: str) -> DataFrame:
    """(feature, pearson, spearman): absolute correlations with the target, 0 where undefined."""
    ranks = {f"r_{c}": (c, average_rank) for c in [*cols, target]}
    rows = rank_within(df.select(*keys, *cols, target), keys, [], ranks)
    size = lambda a, b: F.coalesce(F.abs(guarded_corr(a, b)), F.lit(0.0))
    row = rows.agg(*[F.struct(F.lit(c).alias("feature"), size(c, target).alias("pearson"), size(f"r_{c}", f"r_{target}").alias("spearman")).alias(f"c{i}") for i, c in enumerate(cols)])
    return row.select(F.explode(F.array(*[f"c{i}" for i in range(len(cols))])).alias("c")).select("c.*")


def mutual_information(df: DataFrame, cols: Sequence[str], keys: Sequence[str], target: str, bins: int = 10) -> DataFrame:
    """(feature, mutual_information) in nats between the bins of a column and of the target.

    A value's bin is the share of rows below it, in tenths; equal values share a bin. Joint counts are one aggregate of at most
    columns x bins x bins rows.
    """
    place = lambda below, ties, n: F.floor(below * bins / n)
    rows = rank_within(df.select(*keys, *cols, target), keys, [], {f"b_{c}": (c, place) for c in [*cols, target]})
    pairs = [F.struct(F.lit(c).alias("feature"), F.col(f"b_{c}").alias("x"), F.col(f"b_{target}").alias("y")) for c in cols]
    cells = rows.select(F.explode(F.array(*pairs)).alias("p")).select("p.*").where("x IS NOT NULL AND y IS NOT NULL").groupBy("feature", "x", "y").agg(F.count(F.lit(1)).alias("n"))
    total = lambda *by: F.sum("n").over(W.partitionBy("feature", *by))
    part = F.col("n") / total() * F.log(F.col("n") * total() / (total("x") * total("y")))
    return cells.withColumn("part", part).groupBy("feature").agg(F.greatest(F.lit(0.0), F.sum("part")).alias("mutual_information"))


def eliminated(rows: DataFrame, cols: Sequence[str], label: str, keep: int) -> set[str]:
    """The columns left when the one of least absolute logistic coefficient goes, again and again; `rows` has vectors' columns standardised or not."""
    left = list(cols)
    while len(left) > keep:
        fitted = LogisticRegression(regParam=0.0, maxIter=100, standardization=False, labelCol=label).fit(assembled(rows, left).select("features", label))
        left.pop(int(np.argmin(np.abs(fitted.coefficients.toArray()))))
    return set(left)


def silhouette(rows: DataFrame, col: str, seed: int = 42) -> float:
    """(1 + silhouette) / 2 of two clusters of one column; 0 for fewer than six rows or one value."""
    seen = rows.agg(F.count(F.lit(1)).alias("n"), F.min(col).alias("low"), F.max(col).alias("high")).first()
    if seen["n"] < 6 or seen["low"] == seen["high"]:
        return 0.0
    held = assembled(rows.select(col), [col])
    made = KMeans(k=2, seed=seed).fit(held).transform(held)
    if made.select("prediction").distinct().count() < 2:
        return 0.0
    return max(0.0, (ClusteringEvaluator().evaluate(made) + 1) / 2)


def importances(df: DataFrame, cols: Sequence[str], keys: Sequence[str], target: str, trees: int = 300, seed: int = 42) -> DataFrame:
    """(feature, method, raw, normalised) for every column and method; `keys` identify a row.

    Missing values count as the column's median. pearson and spearman: absolute correlations. mutual_information: of tenths. lasso:
    absolute coefficient of standardised columns at 0.01. forest: importance for the target at or above its median; shap repeats it, as no
    tree explainer is here. elimination: 1 for the half of the columns that a logistic model keeps. cluster: silhouette of two clusters.
    normalised: least 0, greatest 1 over the columns, 0.5 where all are equal.
    """
    spark, cols = df.sparkSession, list(cols)
    rows = cut_lineage(median_filled(df.select(*keys, *cols, F.col(target).alias("__y")), [*cols, "__y"]))
    middle = group_quantiles(rows, [], "__y", {"__m": 0.5}).drop("n")
    rows = cut_lineage(rows.join(F.broadcast(middle)).withColumn("label", (F.col("__y") >= F.col("__m")).cast("double")).drop("__m"))
    raw = {m: dict.fromkeys(cols, 0.0) for m in METHODS}
    n, classes = rows.agg(F.count(F.lit(1)), F.count_distinct("label")).first()
    if n:
        for r in correlations(rows, cols, keys, "__y").join(mutual_information(rows, cols, keys, "__y"), "feature").collect():
            for m in ("pearson", "spearman", "mutual_information"):
                raw[m][r["feature"]] = r[m]
        z = standardised(rows, cols, column_moments(rows, cols))
        sums = product_sums(z, [f"z_{c}" for c in cols], [], "__y").first()["sums"]
        raw["lasso"] = dict(zip(cols, np.abs(solve(_square(np.array(sums), len(cols) + 2), Linear("lasso", 0.01, 1.0))[1]).tolist()))
        raw["cluster"] = {c: silhouette(rows, c, seed) for c in cols}
    if n and classes > 1:
        forest = RandomForestClassifier(numTrees=trees, seed=seed).fit(assembled(rows, cols).select("features", "label"))
        raw["forest"] = raw["shap"] = dict(zip(cols, forest.featureImportances.toArray().tolist()))
        kept = eliminated(rows, cols, "label", max(1, len(cols) // 2))
        raw["elimination"] = {c: float(c in kept) for c in cols}
    out = spark.createDataFrame([(c, m, float(raw[m][c])) for m in METHODS for c in cols], "feature string, method string, raw double")
    return out.withColumn("normalised", minmax_share("raw", "method"))


def minmax_share(value: str, by: str) -> Column:
    """Place of a value between the least and the greatest of its group; 0.5 where they are within 1e-12."""
    whole = W.partitionBy(by)
    low, high = F.min(value).over(whole), F.max(value).over(whole)
    return F.when(high - low <= 1e-12, 0.5).otherwise((F.col(value) - low) / (high - low))


def mean_importance(found: DataFrame, methods: Sequence[str] = METHODS) -> DataFrame:
    """(feature, score, methods): mean of the normalised importances over the named methods."""
    return found.where(F.col("method").isin(list(methods))).groupBy("feature").agg(F.avg("normalised").alias("score"), F.count(F.lit(1)).alias("methods"))


def strongest(found: DataFrame) -> DataFrame:
    """(method, feature): each method's first column, by name where equal."""
    return found.groupBy("method").agg(F.min_by("feature", F.struct((-F.col("normalised")).alias("d"), "feature")).alias("feature"))


