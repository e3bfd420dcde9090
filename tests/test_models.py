import math
import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from strataloom.operators import models as M

COLS = ["a", "b", "c"]


def data(n=400, seed=1):
    r = np.random.default_rng(seed)
    rows = []
    for i in range(n):
        a, b, c = r.random(3)
        period = 2000 + i % 6
        rows.append((i, period, period + 1, float(a), None if i % 17 == 0 else float(b), float(c), float(3 * a - 2 * b + 0.1 * r.normal()) if i % 23 else None))
    return rows


def frame(spark, rows):
    return spark.createDataFrame(rows, "entity long, period int, target_period int, a double, b double, c double, target double").repartition(4)


def arrays(rows, keep):
    held = [r for r in rows if keep(r) and r[6] is not None]
    x = np.array([[0.5 if v is None else v for v in r[3:6]] for r in held])
    return x, np.array([r[6] for r in held])


def test_walk_forward_folds(spark):
    out = M.walk_forward(frame(spark, data()), [2003, 2005]).collect()
    for r in out:
        assert (r.role == "test" and r.period == r.split) or (r.role == "train" and r.target_period <= r.split)
    assert {(r.split, r.role) for r in out} == {(s, k) for s in (2003, 2005) for k in ("train", "test")}
    assert M.last_tests(frame(spark, data()), 2) == [2004, 2005]


def test_linear_family_against_its_definition(spark):
    rows = data()
    fitted = {(r.split, r.model): r for r in M.linear_folds(frame(spark, rows), COLS, [2003, 2005]).collect()}
    for t in (2003, 2005):
        x, y = arrays(rows, lambda r: r[2] <= t)
        one = np.column_stack([np.ones(len(x)), x])
        plain = np.linalg.lstsq(one, y, rcond=None)[0]
        assert np.allclose([fitted[t, "linear_regression"].intercept, *fitted[t, "linear_regression"].coef], plain)
        xc, yc = x - x.mean(axis=0), y - y.mean()
        assert np.allclose(fitted[t, "ridge"].coef, np.linalg.solve(xc.T @ xc + np.eye(3), xc.T @ yc))
        for name, alpha, l1 in (("lasso", 0.1, 1.0), ("elasticnet", 0.1, 0.5)):
            w = np.array(fitted[t, name].coef)
            slope = xc.T @ (yc - xc @ w) / len(x) - alpha * (1 - l1) * w
            # at the optimum the slope is alpha * l1 towards a coefficient and no more than that where it is 0
            assert all(abs(g - alpha * l1 * np.sign(v)) < 1e-9 if v else abs(g) <= alpha * l1 + 1e-9 for g, v in zip(slope, w))
            assert abs(fitted[t, name].intercept - (y.mean() - x.mean(axis=0) @ w)) < 1e-9
        assert fitted[t, "ridge"].n == len(x)


def test_linear_predictions(spark):
    rows = data()
    df = frame(spark, rows)
    fitted = M.linear_folds(df, COLS, [2005])
    coef = {r.model: r for r in fitted.collect()}
    out = M.predict_linear(df, COLS, fitted).collect()
    known = {r[0]: r for r in rows}
    assert len(out) == 4 * sum(r[1] == 2005 for r in rows)
    for r in out:
        x = [0.5 if v is None else v for v in known[r.entity][3:6]]
        assert abs(r.y_pred - coef[r.model].intercept - np.dot(x, coef[r.model].coef)) < 1e-9 and r.y_true == known[r.entity][6]


def test_constant_columns_and_short_folds(spark):
    rows = [(i, 2000, 2001, 1.0, 2.0, float(i), float(2 * i)) for i in range(5)]
    fitted = {r.model: r for r in M.linear_folds(frame(spark, rows), COLS, [2000, 2001]).collect()}
    assert np.allclose(fitted["linear_regression"].coef, [0, 0, 2]) and {r.split for r in fitted.values()} == {2001}
    assert M.linear_folds(frame(spark, rows[:1]), COLS, [2001]).count() == 0


def test_trees_learn_a_step(spark):
    r = random.Random(3)
    rows = []
    for i in range(600):
        a, period = r.random(), 2000 + i % 3
        rows.append((i, period, period + 1, a, r.random(), r.random(), 5.0 if a > 0.5 else -5.0))
    out = M.predict_trees(frame(spark, rows), COLS, [2002], {"forest": M.forest_regressor(20), "boosting": M.boosting_regressor(30)}).collect()
    assert len(out) == 400
    for name in ("forest", "boosting"):
        errors = [abs(x.y_true - x.y_pred) for x in out if x.model == name]
        assert sum(errors) / len(errors) < 0.8


def test_logistic_against_newton(spark):
    r = np.random.default_rng(5)
    rows = []
    for i in range(300):
        a, b = r.normal(size=2)
        rows.append((i, float(a), None if i % 11 == 0 else float(b), 7.0, int(r.random() < 1 / (1 + math.exp(-2 * a + b)))))
    df = spark.createDataFrame(rows, "id long, a double, b double, c double, label int")
    model = M.fit_logistic(df, COLS)
    x = np.array([[np.nan if v is None else v for v in row[1:4]] for row in rows], float)
    x = np.where(np.isnan(x), np.nanmean(x, axis=0), x)
    spread = x.std(axis=0)
    z = (x - x.mean(axis=0)) / np.where(spread > 0, spread, 1)
    y = np.array([row[4] for row in rows])
    one = np.column_stack([np.ones(len(z)), z])
    w = np.zeros(4)
    for _ in range(50):
        p = 1 / (1 + np.exp(-one @ w))
        penalty = np.diag([0, 1, 1, 1])
        w -= np.linalg.solve(one.T @ (one * (p * (1 - p))[:, None]) + penalty, one.T @ (p - y) + penalty @ w)
    assert np.allclose([model.intercept, *model.coef], w, atol=1e-4)
    out = {s.id: s for s in M.logistic_scores(df, COLS, model, ["id"]).collect()}
    for i in (0, 5, 11):
        assert abs(out[i].probability - 1 / (1 + math.exp(-one[i] @ w))) < 1e-4
        assert abs(out[i].contributions["a"] - w[1] * z[i, 0]) < 1e-3
    assert M.fit_logistic(df.where("label = 1"), COLS) is None and M.fit_logistic(df.limit(3), COLS) is None
    nothing = M.logistic_scores(df.limit(1).withColumns({c: F.lit(None).cast("double") for c in COLS}), COLS, model, ["id"]).first()
    assert nothing.probability is None


def test_success_scores_never_saw_the_row(spark):
    r = random.Random(2)
    rows = [(i, r.random(), r.random(), r.random()) for i in range(160)]
    rows = [(*row, float(row[1] > 0.5)) for row in rows]
    df = spark.createDataFrame(rows, "id long, a double, b double, c double, label double")
    out = M.success_scores(df, COLS, ["id"], folds=2, forest=(20, 4), boosting=(10, 3)).collect()
    assert len(out) == 3 * len(rows)
    for name in ("elasticnet", "random_forest", "boosting"):
        held = {x.id: x.probability for x in out if x.model == name}
        assert all(0 <= p <= 1 for p in held.values())
        assert sum((held[row[0]] > 0.5) == row[4] for row in rows) > 0.85 * len(rows)
    assert M.success_scores(df.limit(10), COLS, ["id"], folds=2).count() == 0


def test_ensemble_weights_are_renormalised(spark):
    scores = spark.createDataFrame([(1, "elasticnet", 0.2), (1, "boosting", 0.8), (1, "random_forest", None), (2, "random_forest", 0.4), (3, "other", 0.9)], "id int, model string, probability double")
    out = {r.id: r for r in M.ensemble(scores, ["id"], {"elasticnet": 1.0, "boosting": 3.0, "random_forest": 2.0}).collect()}
    assert out[1].probability == pytest.approx(0.65) and out[1].score == 65.0 and out[1].models == ["boosting", "elasticnet"]
    assert out[2].probability == 0.4 and 3 not in out
