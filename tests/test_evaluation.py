import math

from pyspark.sql import functions as F

from strataloom.operators import evaluation as E
from strataloom.operators import resampling as G

SCHEMA = "entity string, period int, model string, y_true double, y_pred double"


def preds(spark, year=2023, model="m", scale=1.0):
    pairs = {"A": (1, 2), "B": (2, 1), "C": (3, 3), "D": (4, 4), "E": (5, 5)}
    return spark.createDataFrame([(e, year, model, float(t), scale * p) for e, (t, p) in pairs.items()], SCHEMA)


def test_correlation_and_pool(spark):
    one = preds(spark)
    assert math.isclose(E.spearman_ic(one).first().ic, 0.9)
    perfect = spark.createDataFrame([(e, 2024, "m", float(i), float(i)) for i, e in enumerate("ABCDE")], SCHEMA)
    both = one.unionByName(perfect)
    assert math.isclose(E.pooled_ic(E.spearman_ic(both)).first().pooled_ic, 0.95)
    flat = spark.createDataFrame([(e, 2025, "m", 1.0, 1.0) for e in "ABC"], SCHEMA)
    assert E.pooled_ic(E.spearman_ic(both.unionByName(flat))).first().pooled_ic is None
    noise = spark.createDataFrame([("X", 2023, "m", None, 1.0), ("Y", 2023, "m", float("nan"), 2.0), ("Z", 2023, "m", 3.0, float("inf"))], SCHEMA)
    assert math.isclose(E.spearman_ic(one.unionByName(noise).repartition(5)).first().ic, 0.9)
    m = E.split_metrics(one, 2).first()
    assert (m.n, m.mae, m.precision_at_k, m.top_mean, m.median_true, m.directional_acc) == (5, 0.4, 1.0, 4.5, 3.0, 1.0)


def test_models_against_each_other(spark):
    up = spark.createDataFrame([(e, 2023, "model_a", 0.0, float(i)) for i, e in enumerate("ABCDE", 1)], SCHEMA)
    down = spark.createDataFrame([(e, 2023, "model_b", 0.0, float(-i)) for i, e in enumerate("ABCDE", 1)], SCHEMA)
    ranks = E.prediction_ranks(up.unionByName(down))
    out = {(r.row_model, r.column_model): r for r in E.model_rank_correlation(ranks).collect()}
    assert math.isclose(out["model_a", "model_b"].correlation, -1.0) and out["model_a", "model_b"].shared == 5
    spread = {r.entity: r for r in E.entity_rank_spread(ranks, 2).collect()}
    assert (spread["A"].rank_spread, spread["A"].rank_iqr, spread["C"].rank_spread) == (4.0, 2.0, 0.0)
    assert E.entity_rank_spread(ranks, 3).first().status == "insufficient_data_missing_model_rank"


def test_baskets_turnover_costs(spark):
    base = [("A", 30.0, 0.1), ("B", 20.0, 0.9), ("C", 10.0, 0.5), ("D", -5.0, 0.2)]
    rows = spark.createDataFrame([(e, 2024, "m", t, p) for e, t, p in base], SCHEMA)
    members = E.topk_basket(rows, 2)
    assert [r.entity for r in members.orderBy("position").collect()] == ["B", "C"]
    assert E.basket_returns(members).first().gross == 15.0
    gone = spark.createDataFrame([("A", 2024, "m", 30.0, 0.1), ("B", 2024, "m", 20.0, None), ("C", 2024, "m", None, 0.5), ("D", 2024, "m", -5.0, 0.2)], SCHEMA)
    r = E.basket_returns(E.topk_basket(gone, 2)).first()
    assert (r.gross, r.missing_realised) == (None, 1)
    held = {2023: "ABCD", 2024: "ABEF", 2026: "ABEF", 2027: "WXYZ"}
    members = spark.createDataFrame([("m", y, e, i, 1.0) for y, names in held.items() for i, e in enumerate(names)], "model string, period int, entity string, position int, y_true double")
    assert [r.turnover for r in E.basket_turnover(members).orderBy("period").collect()] == [None, 0.5, 0.0, 1.0]
    returns = spark.createDataFrame([("m", 1, 4, 5.0, 0), ("m", 2, 4, None, 1)], "model string, period int, basket_size int, gross double, missing_realised int")
    turn = spark.createDataFrame([("m", 1, 0.75), ("m", 2, 0.5)], "model string, period int, turnover double")
    out = {(r.period, r.cost_bps): (r.drag, r.net) for r in E.cost_scenarios(returns, turn, [0, 10_000]).collect()}
    assert out == {(1, 0.0): (0.0, 5.0), (1, 10_000.0): (75.0, -70.0), (2, 0.0): (None, None), (2, 10_000.0): (None, None)}


def test_null_summary_and_family(spark):
    observed = spark.createDataFrame([("m", 1.0)], "model string, ic double")
    null = spark.createDataFrame([("m", i, v) for i, v in enumerate([-2.0, 0.5, 1.0])] + [("m", 9, None)], "model string, draw int, ic double")
    s = G.null_summary(observed, null, null).first()
    assert s.p_value == 0.75 and s.draws == 3 and math.isclose(s.null_percentile, 100 * 2.5 / 3)
    tests = spark.createDataFrame([("b", 0.01), ("a", 0.01), ("base", 0.001)], "model string, p_value double")
    out = {r.model: r for r in G.family_correction(tests, ["a", "b"]).collect()}
    assert out["a"].headline and not out["b"].headline and out["a"].adjusted_p == 0.02 and out["base"].adjusted_p is None


def test_draws_do_not_depend_on_partitions(spark):
    rows = preds(spark).unionByName(preds(spark, 2024))
    for draw in (G.permutation_null, G.bootstrap_dist):
        first = sorted(map(tuple, draw(rows, 30, 7).collect()), key=str)
        assert len(first) == 60 and first == sorted(map(tuple, draw(rows.repartition(7), 30, 7).collect()), key=str)
        assert first != sorted(map(tuple, draw(rows, 30, 8).collect()), key=str)
    values = [r.ic for r in G.permutation_null(rows, 400, 1).collect()]
    assert abs(sum(values) / len(values)) < 0.06


def test_rebuilt_board_and_several_targets(spark):
    rows = [(f"e{i}", p, m, float(i), float(i * i % 7)) for m in ("a", "b") for p in (1, 2) for i in range(8)]
    pred = spark.createDataFrame(rows, "entity string, period int, model string, y_true double, y_pred double")
    board = E.split_metrics(pred)
    stored = board.where("NOT (model = 'b' AND period = 2)").withColumn("rmse", F.when(F.col("model") == "a", F.col("rmse") + 1e-12).otherwise(F.col("rmse") * 2))
    stored = stored.unionByName(stored.limit(1).withColumn("model", F.lit("gone")))
    out = {(r.model, r.period, r.metric): r.status for r in E.rebuild_leaderboard(pred, stored).collect()}
    assert out["a", 1, "rmse"] == "match" and out["b", 1, "rmse"] == "mismatch" and out["b", 1, "mae"] == "match"
    assert out["b", 2, "spearman"] == "missing_stored" and {s for (m, _, _), s in out.items() if m == "gone"} == {"missing_rows"}
    boards = {"x": spark.createDataFrame([("a", 0.1), ("a", 0.3), ("b", 0.1)], "model string, spearman double"), "y": spark.createDataFrame([("a", None), ("b", -0.5)], "model string, spearman double")}
    found = {(r.target, r.model): (r.splits, r.mean, r.best_model) for r in E.multi_target(boards).collect()}
    assert found == {("x", "a"): (2, 0.2, True), ("x", "b"): (1, 0.1, False), ("y", "a"): (0, None, False), ("y", "b"): (1, -0.5, True)}


def test_split_metrics_ranks_once_and_follows_plain_sorting(spark, monkeypatch):
    from statistics import median

    from strataloom.operators import ranking as R

    written, cut = [], R.cut_lineage
    monkeypatch.setattr(R, "cut_lineage", lambda df: written.append(1) or cut(df))
    rows = [(f"e{i:02}", p, "m", float(i * 7 % (5 + p)), float(i * 5 % 4)) for p, n in ((1, 20), (2, 21), (3, 3)) for i in range(n)]
    rows += [("e0", 4, "m", 1.0, 2.0), ("e1", 1, None, 1.0, 2.0), ("gone", 1, "m", None, 9.0)]
    out = {r.period: r for r in E.split_metrics(spark.createDataFrame(rows, "entity string, period int, model string, y_true double, y_pred double")).collect()}
    assert len(written) <= 2 and set(out) == {1, 2, 3}
    for p, r in out.items():
        own = [(e, t, y) for e, q, m, t, y in rows if q == p and m and t is not None]
        top = {e for e, _, _ in sorted(own, key=lambda x: (-x[2], x[0]))[:5]}
        best = {e for e, _, _ in sorted(own, key=lambda x: (-x[1], x[0]))[:5]}
        mt, mp = median(t for _, t, _ in own), median(y for _, _, y in own)
        assert r.n == len(own) and r.median_true == mt and abs(r.precision_at_k - len(top & best) / 5) < 1e-12
        assert abs(r.top_mean - sum(t for e, t, _ in own if e in top) / len(top)) < 1e-9
        assert abs(r.directional_acc - sum((y > mp) == (t > mt) for _, t, y in own) / len(own)) < 1e-12


def test_scores_are_written_once_before_they_are_ranked(spark):
    """Ranking samples its input before it reads it: neither reading works the panel out again."""
    from strataloom.plans import panels as P

    plan = P.predictions(spark, "/root/testdata/sf0.001")._jdf.queryExecution().executedPlan().toString()
    assert "Exchange" not in plan and "FileScan" not in plan and "Scan ExistingRDD" in plan


def test_spread_of_ranks_takes_one_percentile(spark):
    ranks = spark.createDataFrame([("A", 1, m, r) for m, r in zip("xyz", (1.0, 2.5, 7.0))] + [("B", 1, "x", 2.0)], "entity string, period int, model string, rank double")
    out = E.entity_rank_spread(ranks, 3)
    assert {r.entity: (r.ranked_models, r.rank_spread, r.rank_iqr) for r in out.collect()} == {"A": (3, 6.0, 3.0), "B": (1, None, None)}
    assert out._jdf.queryExecution().optimizedPlan().toString().count("percentile(") == 1
