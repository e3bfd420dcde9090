"""Fitted models: walk-forward folds, linear models from distributed sums, Spark ML trees and logistic regression, ensembles.

Rows are (entity, period, features..., target), the target being realised in `target_period`. Linear models need only sums of
products, so one aggregate per target period serves every fold: sums of a fold's training periods are added up, rows
are not copied from fold to fold.
"""

from __future__ import annotations

from collections.abc import Mapping, Sequence
from dataclasses import dataclass
from functools import reduce

import numpy as np
from pyspark.ml.classification import GBTClassifier, LogisticRegression, RandomForestClassifier
from pyspark.ml.feature import VectorAssembler
from pyspark.ml.functions import vector_to_array
from pyspark.ml.regression import GBTRegressor, RandomForestRegressor
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from strataloom.functions.keys import keyed_hash
from strataloom.functions.numbers import finite_or_null
from strataloom.session import cut_lineage

CENTRE = 0.5


def walk_forward(df: DataFrame, tests: Sequence[int], period: str = "period", target_period: str = "target_period") -> DataFrame:
    """Rows once for every fold they serve: (split, role, all columns). Fold t trains on targets realised by t and tests on rows of period t."""
    folds = df.sparkSession.createDataFrame([(int(t),) for t in tests], "split int")
    trains, tested = F.col(target_period) <= F.col("split"), F.col(period) == F.col("split")
    # one row a fold, written out by the caller
    out = df.join(F.broadcast(folds), trains | tested)
    return out.withColumn("role", F.when(tested, "test").otherwise("train"))


def last_tests(df: DataFrame, count: int = 3, period: str = "period", target: str = "target") -> list[int]:
    """The last periods whose targets are realised: as many rows come back as folds are asked for."""
    rows = df.where(F.col(target).isNotNull()).select(period).distinct().orderBy(F.desc(period)).limit(count).collect()
    return sorted(r[0] for r in rows)


# ---- linear models -----------------------------------------------------------------------------------


@dataclass(frozen=True)
class Linear:
    """Least squares with a penalty: alpha / 2 of the squares where l1_ratio is None (not divided by the rows), else per row of absolute values and squares."""

    name: str
    alpha: float = 0.0
    l1_ratio: float | None = None


LINEAR_FAMILY = (Linear("linear_regression"), Linear("ridge", 1.0), Linear("lasso", 0.1, 1.0), Linear("elasticnet", 0.1, 0.5))


def filled(df: DataFrame, cols: Sequence[str], value: float = CENTRE) -> DataFrame:
    return df.withColumns({c: F.coalesce(finite_or_null(c), F.lit(float(value))) for c in cols})


def product_sums(df: DataFrame, cols: Sequence[str], by: Sequence[str], target: str = "target") -> DataFrame:
    """(by, n, sums): sums of products of 1, the columns and the target, upper triangle in row order. Rows without a finite target are left out."""
    rows = df.withColumn(target, finite_or_null(target)).where(F.col(target).isNotNull())
    parts = [F.lit(1.0), *[F.col(c).cast("double") for c in cols], F.col(target).cast("double")]
    sums = [F.sum(a * b) for i, a in enumerate(parts) for b in parts[i:]]
    return rows.groupBy(*by).agg(F.count(F.lit(1)).alias("n"), F.array(*sums).alias("sums"))


def _square(sums: np.ndarray, k: int) -> np.ndarray:
    out = np.zeros((k, k))
    out[np.triu_indices(k)] = sums
    return out + np.triu(out, 1).T


def solve(products: np.ndarray, model: Linear, rounds: int = 5000) -> tuple[float, np.ndarray]:
    """Intercept and coefficients from the matrix of products of (1, columns, target)."""
    n, mean = products[0, 0], products[0, 1:] / products[0, 0]
    spread = products[1:, 1:] - n * np.outer(mean, mean)
    gram, cross = spread[:-1, :-1], spread[:-1, -1]
    if model.l1_ratio is None:
        coef = np.linalg.pinv(gram + model.alpha * np.eye(len(gram)), hermitian=True) @ cross
    else:
        coef, gram, cross = np.zeros(len(gram)), gram / n, cross / n
        flat, square = model.alpha * model.l1_ratio, model.alpha * (1 - model.l1_ratio)
        for _ in range(rounds):
            before = coef.copy()
            for j in range(len(coef)):
                pull = cross[j] - gram[j] @ coef + gram[j, j] * coef[j]
                size = gram[j, j] + square
                coef[j] = np.sign(pull) * max(abs(pull) - flat, 0) / size if size > 0 else 0.0
            if np.abs(coef - before).max(initial=0) < 1e-12:
                break
    return float(mean[-1] - mean[:-1] @ coef), coef


def linear_folds(df: DataFrame, cols: Sequence[str], tests: Sequence[int], models: Sequence[Linear] = LINEAR_FAMILY, target: str = "target", target_period: str = "target_period") -> DataFrame:
    """(split, model, n, intercept, coef): every model fitted on each fold's training rows, a coefficient per column.

    The sums come to the driver, one row a target period, whatever the rows. Columns without a value count as the centre of ranks, 0.5.
    A fold of fewer than two rows has no model.
    """
    held = product_sums(filled(df, cols), cols, [target_period], target).collect()
    k, out = len(cols) + 2, []
    for t in tests:
        sums = [np.array(r["sums"]) for r in held if r[target_period] is not None and r[target_period] <= t]
        products = _square(np.sum(sums, axis=0), k) if sums else np.zeros((k, k))
        if products[0, 0] < 2:
            continue
        for model in models:
            intercept, coef = solve(products, model)
            out.append((int(t), model.name, int(products[0, 0]), intercept, coef.tolist()))
    return df.sparkSession.createDataFrame(out, "split int, model string, n long, intercept double, coef array<double>")


def dot(cols: Sequence[str], coef: str = "coef") -> Column:
    return reduce(lambda a, b: a + b, [F.col(c) * F.get(coef, F.lit(i)) for i, c in enumerate(cols)])


def predict_linear(df: DataFrame, cols: Sequence[str], fitted: DataFrame, target: str = "target", period: str = "period", keep: Sequence[str] = ("entity",)) -> DataFrame:
    """(keep, period, model, y_true, y_pred) of the test rows of each fold. `fitted` has one row a fold and model and is broadcast."""
    rows = filled(df, cols).join(F.broadcast(fitted.withColumnRenamed("split", period)), period)
    return rows.select(*keep, period, "model", F.col(target).alias("y_true"), (F.col("intercept") + dot(cols)).alias("y_pred"))


# ---- trees -------------------------------------------------------------------------------------------


def forest_regressor(trees: int = 200, depth: int = 4, seed: int = 42) -> RandomForestRegressor:
    return RandomForestRegressor(numTrees=trees, maxDepth=depth, seed=seed, featureSubsetStrategy="all", labelCol="target")


def boosting_regressor(rounds: int = 120, depth: int = 2, seed: int = 42) -> GBTRegressor:
    return GBTRegressor(maxIter=rounds, maxDepth=depth, seed=seed, stepSize=0.1, labelCol="target")


def assembled(df: DataFrame, cols: Sequence[str]) -> DataFrame:
    return VectorAssembler(inputCols=list(cols), outputCol="features", handleInvalid="error").transform(df)


def predict_trees(df: DataFrame, cols: Sequence[str], tests: Sequence[int], models: Mapping[str, object], target: str = "target", period: str = "period", target_period: str = "target_period", keep: Sequence[str] = ("entity",)) -> DataFrame:
    """(keep, period, model, y_true, y_pred): Spark ML regressors fitted per fold on the rows whose targets are realised by then."""
    rows = filled(df, cols).withColumn("target", finite_or_null(target))
    rows = cut_lineage(assembled(rows.select(*dict.fromkeys([*keep, period, target_period, *cols, "target"])), cols))
    out = []
    for t in tests:
        train = rows.where((F.col(target_period) <= t) & F.col("target").isNotNull()).select("features", "target")
        test = rows.where(F.col(period) == t)
        for name, estimator in models.items():
            scored = estimator.fit(train).transform(test)
            out.append(scored.select(*keep, period, F.lit(name).alias("model"), F.col("target").alias("y_true"), F.col("prediction").alias("y_pred")))
    return reduce(DataFrame.unionByName, out)


# ---- classification ----------------------------------------------------------------------------------


def column_moments(df: DataFrame, cols: Sequence[str]) -> dict[str, tuple[float, float]]:
    """Mean of the known values and population deviation after filling with it, of each column; two numbers a column."""
    cells = [F.struct(F.avg(finite_or_null(c)).alias("m"), F.coalesce(F.stddev_pop(finite_or_null(c)), F.lit(0.0)).alias("s"), (F.count(finite_or_null(c)) / F.count(F.lit(1))).alias("share")).alias(c) for c in cols]
    row = df.agg(*cells).first()
    # filling with the mean shrinks the variance by the share of known values
    return {c: (row[c].m or 0.0, (row[c].s or 0.0) * float(np.sqrt(row[c].share or 0.0))) for c in cols}


def standardised(df: DataFrame, cols: Sequence[str], moments: Mapping[str, tuple[float, float]]) -> DataFrame:
    """Columns z_<c>: filled with the mean, less the mean, over the deviation (1 where it is 0)."""
    return df.withColumns({f"z_{c}": (F.coalesce(finite_or_null(c), F.lit(moments[c][0])) - moments[c][0]) / (moments[c][1] or 1.0) for c in cols})


def training_cutoff(df: DataFrame, share: float = 0.8, period: str = "period") -> DataFrame:
    """One row (cutoff): the last of the oldest `share` of periods, the first period at least."""
    periods = F.array_sort(F.collect_set(period))
    return df.agg(F.get(periods, F.greatest(F.lit(1), F.floor(F.size(periods) * F.lit(share))).cast("int") - 1).alias("cutoff"))


@dataclass
class Logistic:
    intercept: float
    coef: list[float]
    moments: dict[str, tuple[float, float]]
    rows: int


def fit_logistic(train: DataFrame, cols: Sequence[str], label: str = "label", c: float = 1.0, least: int = 4, balanced: bool = False) -> Logistic | None:
    """Logistic regression on standardised, mean-filled columns; None for fewer than `least` rows or one class.

    With `balanced` both classes weigh the same.
    """
    train = train.where(F.col(label).isNotNull())
    seen = train.agg(F.count(F.lit(1)).alias("n"), F.count_distinct(label).alias("classes"), F.sum(F.col(label).cast("double")).alias("up")).first()
    if seen["n"] < least or seen["classes"] < 2:
        return None
    moments = column_moments(train, cols)
    rows = assembled(standardised(train, cols, moments), [f"z_{x}" for x in cols]).select("features", F.col(label).cast("double").alias("label"))
    even = F.when(F.col("label") == 1, seen["n"] / (2 * seen["up"])).otherwise(seen["n"] / (2 * (seen["n"] - seen["up"])))
    rows = rows.withColumn("weight", even if balanced else F.lit(1.0))
    model = LogisticRegression(weightCol="weight", regParam=1 / (c * seen["n"]), standardization=False, maxIter=500, tol=1e-10).fit(rows)
    return Logistic(float(model.intercept), [float(v) for v in model.coefficients], moments, seen["n"])


def logistic_scores(df: DataFrame, cols: Sequence[str], model: Logistic, keep: Sequence[str]) -> DataFrame:
    """(keep, probability, score, contributions): contributions map a column to coefficient times standardised value.

    Rows without any known column have nulls.
    """
    rows = standardised(df, cols, model.moments)
    parts = [F.round(F.col(f"z_{c}") * w, 4) for c, w in zip(cols, model.coef)]
    margin = reduce(lambda a, b: a + b, [F.col(f"z_{c}") * w for c, w in zip(cols, model.coef)]) + model.intercept
    known = reduce(lambda a, b: a | b, [finite_or_null(c).isNotNull() for c in cols])
    p = 1 / (1 + F.exp(-margin))
    named = F.map_from_arrays(F.array(*[F.lit(c) for c in cols]), F.array(*parts))
    return rows.select(*keep, F.when(known, p).alias("probability"), F.when(known, F.round(p * 100, 2)).alias("score"), F.when(known, named).alias("contributions"))


SUCCESS_ROWS = 20


def success_scores(df: DataFrame, cols: Sequence[str], keys: Sequence[str], label: str = "label", folds: int = 5, seed: int = 42, forest: tuple[int, int] = (300, 8), boosting: tuple[int, int] = (250, 5)) -> DataFrame:
    """(keys, model, probability) of an elastic net, a balanced forest and boosted trees, each row scored by models that never saw it.

    Rows are dealt to `folds` by a hash of their keys; a fold's rows are scored by models of the other folds. A model needs
    20 labelled rows and both classes; without them the fold has no scores. Rows without any known column are neither learnt nor scored.
    The elastic net is least squares on the label, its prediction cut to 0..1.
    """
    known = reduce(lambda a, b: a | b, [finite_or_null(c).isNotNull() for c in cols])
    rows = df.where(known).withColumn("__fold", F.pmod(keyed_hash(F.lit(str(seed)), *keys), F.lit(folds)).cast("int"))
    rows = cut_lineage(rows.select(*keys, *cols, F.col(label).cast("double").alias("label"), "__fold"))
    z, out = [f"z_{c}" for c in cols], []
    for fold in range(folds):
        train, test = rows.where((F.col("__fold") != fold) & F.col("label").isNotNull()), rows.where(F.col("__fold") == fold)
        seen = train.agg(F.count(F.lit(1)).alias("n"), F.sum("label").alias("up")).first()
        n, up = seen["n"], seen["up"] or 0.0
        if n < SUCCESS_ROWS or up in (0.0, float(n)):
            continue
        moments = column_moments(train, cols)
        train, test = standardised(train, cols, moments), standardised(test, cols, moments)
        sums = product_sums(train, z, [], "label").first()["sums"]
        intercept, coef = solve(_square(np.array(sums), len(z) + 2), Linear("elasticnet", 0.05, 0.5))
        fit = sum((F.col(c) * float(w) for c, w in zip(z, coef)), F.lit(intercept))
        out.append(test.select(*keys, F.lit("elasticnet").alias("model"), F.least(F.lit(1.0), F.greatest(F.lit(0.0), fit)).alias("probability")))
        weight = F.when(F.col("label") == 1, n / (2 * up)).otherwise(n / (2 * (n - up)))
        train, test = assembled(train, z).withColumn("weight", weight), assembled(test, z)
        models = {
            "random_forest": RandomForestClassifier(numTrees=forest[0], maxDepth=forest[1], minInstancesPerNode=3, seed=seed, weightCol="weight"),
            "boosting": GBTClassifier(maxIter=boosting[0], maxDepth=boosting[1], stepSize=0.05, subsamplingRate=0.9, seed=seed),
        }
        for name, estimator in models.items():
            scored = estimator.fit(train.select("features", "label", "weight")).transform(test)
            out.append(scored.select(*keys, F.lit(name).alias("model"), F.get(vector_to_array("probability"), F.lit(1)).alias("probability")))
    if not out:
        return rows.limit(0).select(*keys, F.lit("").alias("model"), F.lit(0.0).alias("probability"))
    return reduce(DataFrame.unionByName, out)


#: The ensemble's weights by model.
ENSEMBLE_WEIGHTS = {"elasticnet": 0.2, "random_forest": 0.2, "boosting": 0.2, "sarimax": 0.2, "tft": 0.2}


def ensemble(scores: DataFrame, keys: Sequence[str], weights: Mapping[str, float] = ENSEMBLE_WEIGHTS) -> DataFrame:
    """(keys, probability, score, models): weighted mean of the models that have a probability, their weights brought to a sum of 1."""
    table = F.create_map(*[F.lit(v) for pair in weights.items() for v in pair])
    rows = scores.withColumn("__w", F.when(F.col("probability").isNotNull(), table[F.col("model")])).where("__w IS NOT NULL")
    mean = F.try_divide(F.sum(F.col("probability") * F.col("__w")), F.sum("__w"))
    return rows.groupBy(*keys).agg(F.round(mean, 4).alias("probability"), F.round(mean * 100, 2).alias("score"), F.array_sort(F.collect_set("model")).alias("models"))
