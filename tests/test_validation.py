import random

import numpy as np
import pytest

from strataloom.operators import models as M
from strataloom.operators import validation as V


def test_classification_report_against_pairs(spark):
    r = random.Random(1)
    rows = [(i, g, r.randrange(2), r.choice([0.1, 0.4, 0.5, 0.6, r.random()])) for i in range(80) for g in "ab"]
    rows += [(i, "one", 1, 0.7) for i in range(5)] + [(900, "a", None, 0.5), (901, "a", 1, None)]
    out = {x.g: x for x in V.classification_report(spark.createDataFrame(rows, "id int, g string, label int, probability double"), ["g"], ["id"]).collect()}
    for g in "ab":
        held = [(y, p) for _, h, y, p in rows if h == g and y is not None and p is not None]
        up, down = [p for y, p in held if y], [p for y, p in held if not y]
        auc = sum((a > b) + (a == b) / 2 for a in up for b in down) / (len(up) * len(down))
        tp, fp = sum(p >= 0.5 for p in up), sum(p >= 0.5 for p in down)
        assert out[g].auc == pytest.approx(auc) and (out[g].tp, out[g].fp, out[g].fn, out[g].tn) == (tp, fp, len(up) - tp, len(down) - fp)
        assert out[g].f1 == pytest.approx(2 * tp / (tp + fp + len(up))) and out[g].n == len(held)
    assert out["one"].auc is None and out["one"].recall == 1 and out["one"].accuracy == 1


def bins(spark, values, **kw):
    rows = [(f"e{i}", i % 3, float(v) if v is not None else None, float(i % 7), 0.5) for i, v in enumerate(values)]
    return V.calibration_bins(spark.createDataFrame(rows, "entity string, period int, confidence double, rank_error double, feature_coverage double"), **kw).orderBy("confidence_bin").collect()


def test_bins_never_split_ties(spark):
    values = [1] * 50 + [2] * 3 + list(range(3, 30))
    out = bins(spark, values)
    edges = np.unique(np.quantile(values, np.linspace(0, 1, 11)))
    want = [max(1, sum(e < v for e in edges)) for v in values]
    assert [(x.confidence_bin, x.n_model_rows) for x in out] == [(k, want.count(k)) for k in sorted(set(want))]
    assert out[0].confidence_min == 1 and sum(x.n_model_rows for x in out) == len(values)
    inside = [i for i, k in enumerate(want) if k == out[-1].confidence_bin]
    assert out[-1].median_rank_error == np.median([i % 7 for i in inside])


def test_one_value_is_not_estimable_and_missing_values_have_no_bin(spark):
    out = bins(spark, [4, 4, None, 4])
    assert [(x.confidence_bin, x.calibration_status, x.n_model_rows) for x in out] == [(1, "not_estimable", 3)]
    assert bins(spark, [None]) == []
    # the quantiles of 1, 2, 2 at 0, a half and 1 are 1 and 2: one bin from 1 to 2
    assert [x.n_model_rows for x in bins(spark, [1, 2, 2])] == [3]


def test_agreement_of_runs(spark):
    rows = [("g", 1, "a", 1), ("g", 1, "b", 2), ("g", 1, "c", 3), ("g", 3, "b", 1), ("g", 3, "a", 2), ("g", 3, "z", 3), ("g", 9, "q", 1)]
    out = {x.run: x for x in V.topk_agreement(spark.createDataFrame(rows, "g string, run int, entity string, rank int"), 3, by=["g"]).collect()}
    assert out[3].previous_run == 1 and out[3].overlap_at_k == pytest.approx(2 / 3) and out[3].rank_stability == pytest.approx(1 - 1 / 3)
    assert out[9].previous_run == 3 and out[9].overlap_at_k == 0 and out[9].rank_stability is None and 1 not in out


def test_backtest_diagnostics(spark):
    rows = [(1, "baseline", 0.1), (1, "ml", 0.3), (1, "ml", None), (2, "baseline", 0.2), (2, "baseline", 0.4), (2, "ml", 0.35)]
    out = {x.split: x for x in V.backtest_diagnostics(spark.createDataFrame(rows, "split int, kind string, spearman double")).collect()}
    assert out[1].ml_beats_baseline and out[2].ml_beats_baseline and out[None].consistent and not out[None].weak_backtest
    worse = spark.createDataFrame([*rows, (3, "baseline", 0.5)], "split int, kind string, spearman double")
    total = [x for x in V.backtest_diagnostics(worse).collect() if x.split is None][0]
    assert not total.consistent and total.weak_backtest


def test_balanced_logistic_moves_the_middle(spark):
    r = np.random.default_rng(3)
    rows = [(float(a), int(r.random() < 1 / (1 + np.exp(3 - a)))) for a in r.normal(size=400)]
    df = spark.createDataFrame(rows, "a double, label int")
    plain, even = M.fit_logistic(df, ["a"]), M.fit_logistic(df, ["a"], balanced=True)
    assert plain.intercept < -1.5 < even.intercept < 1


def test_coverage_status(spark):
    rows = spark.createDataFrame([("a", 1), ("b", 1)], "entity string, period int")
    cover = V.feature_coverage(spark.createDataFrame([("a", 1, 2.0, None)], "entity string, period int, x double, y double"), ["x", "y"], ["entity", "period"])
    out = {r.entity: (r.feature_coverage, r.coverage_status) for r in V.join_coverage(rows, cover, ["entity", "period"]).collect()}
    assert out == {"a": (0.5, "observed"), "b": (None, "missing_input_row")}
