"""Queries: evaluation of the baseline predictions, and permutation and bootstrap tests."""

from pyspark.sql import functions as F

from strataloom.operators import evaluation as E
from strataloom.operators import influence as L
from strataloom.operators import resampling as G
from strataloom.plans import panels as P
from strataloom.plans.registry import query, rounded

#: Draws of the permutation and bootstrap tests: the least corrected p of a family of two is 2 / 10,001.
DRAWS, SEED = 10_000, 42


def sql_corr(a: str, b: str) -> str:
    return f"CASE WHEN count(*) >= 3 AND stddev_pop({a}) > 0 AND stddev_pop({b}) > 0 THEN covar_pop({a}, {b}) / (stddev_pop({a}) * stddev_pop({b})) END"


_RANKS = f"""{P.PREDICTIONS}, rk AS (SELECT entity, period, model, y_true, y_pred, {P.sql_avg_rank('y_true', 'model, period')} AS rt, {P.sql_avg_rank('y_pred', 'model, period')} AS rp
 FROM preds WHERE y_true IS NOT NULL AND y_pred IS NOT NULL)"""
_IC = f"{_RANKS}, ics AS (SELECT model, period, count(*) AS n, {sql_corr('rt', 'rp')} AS ic FROM rk GROUP BY 1, 2)"


@query("spearman_ic", f"WITH {_IC} SELECT model, period, n, round(ic, 9) AS ic FROM ics")
def _(spark, sf):
    return rounded(E.spearman_ic(P.predictions(spark, sf)), 9)


@query(
    "pooled_ic",
    f"WITH {_IC} SELECT model, count(*) AS periods, round(CASE WHEN count(ic) = count(*) THEN avg(ic) END, 9) AS pooled_ic FROM ics GROUP BY 1",
)
def _(spark, sf):
    return rounded(E.pooled_ic(E.spearman_ic(P.predictions(spark, sf))), 9)


@query(
    "split_metrics",
    f"""WITH {_RANKS}, o AS (SELECT *, row_number() OVER (PARTITION BY model, period ORDER BY y_pred DESC, entity) AS pp, row_number() OVER (PARTITION BY model, period ORDER BY y_true DESC, entity) AS pt,
 median(y_true) OVER (PARTITION BY model, period) AS mt, median(y_pred) OVER (PARTITION BY model, period) AS mp FROM rk)
SELECT model, period, count(*) AS n, round(avg(abs(y_true - y_pred)), 6) AS mae, round(sqrt(avg((y_true - y_pred) * (y_true - y_pred))), 6) AS rmse, round({sql_corr('rt', 'rp')}, 9) AS spearman,
 round(count(*) FILTER (WHERE pp <= 5 AND pt <= 5) / 5, 6) AS precision_at_k, round(avg(y_true) FILTER (WHERE pp <= 5), 6) AS top_mean, round(max(mt), 6) AS median_true,
 round(avg(CAST((y_pred > mp) = (y_true > mt) AS INTEGER)), 6) AS directional_acc FROM o GROUP BY 1, 2 HAVING count(*) >= 3""",
)
def _(spark, sf):
    out = E.split_metrics(P.predictions(spark, sf))
    digits = {"mae": 6, "rmse": 6, "spearman": 9, "precision_at_k": 6, "top_mean": 6, "median_true": 6, "directional_acc": 6}
    return out.select("model", "period", "n", *[(F.round(c, d) + 0.0).alias(c) for c, d in digits.items()])


_PR = f"""{P.PREDICTIONS}, pr AS (SELECT entity, period, model, {P.sql_avg_rank('y_pred', 'model, period')} AS rank FROM preds)"""


@query(
    "model_rank_correlation",
    f"""WITH {_PR}, c AS (SELECT a.period, a.model AS row_model, b.model AS column_model, count(*) FILTER (WHERE a.rank IS NOT NULL AND b.rank IS NOT NULL) AS shared, {sql_corr('a.rank', 'b.rank')} AS r
 FROM pr a JOIN pr b ON a.entity = b.entity AND a.period = b.period GROUP BY 1, 2, 3)
SELECT period, row_model, column_model, shared, round(r, 9) AS correlation, CASE WHEN shared < 3 THEN 'insufficient_data_fewer_than_3_shared_ranked_tickers' WHEN r IS NULL THEN 'insufficient_data_constant_or_nonfinite_rank' ELSE 'complete' END AS status FROM c""",
)
def _(spark, sf):
    return rounded(E.model_rank_correlation(E.prediction_ranks(P.predictions(spark, sf))), 9)


@query(
    "entity_rank_spread",
    f"""WITH {_PR} SELECT entity, period, count(rank) AS ranked_models, CASE WHEN count(rank) = 3 THEN max(rank) - min(rank) END AS rank_spread,
 CASE WHEN count(rank) = 3 THEN round(quantile_cont(rank, 0.75) - quantile_cont(rank, 0.25), 6) END AS rank_iqr, CASE WHEN count(rank) = 3 THEN 'complete' ELSE 'insufficient_data_missing_model_rank' END AS status FROM pr GROUP BY 1, 2""",
)
def _(spark, sf):
    return rounded(E.entity_rank_spread(E.prediction_ranks(P.predictions(spark, sf)), 3))


_BASKET = f"""{P.PREDICTIONS}, b0 AS (SELECT model, period, entity, y_true, row_number() OVER (PARTITION BY model, period ORDER BY y_pred DESC, entity) AS position FROM preds WHERE y_pred IS NOT NULL),
bk AS (SELECT * FROM b0 WHERE position <= 10 QUALIFY count(*) OVER (PARTITION BY model, period) = 10),
pd AS (SELECT model, period, lag(period) OVER (PARTITION BY model ORDER BY period) AS before FROM (SELECT DISTINCT model, period FROM bk)),
tv AS (SELECT p.model, p.period, CASE WHEN p.before IS NOT NULL THEN 1 - (SELECT count(*) FROM bk a JOIN bk b ON a.model = b.model AND a.entity = b.entity WHERE a.model = p.model AND a.period = p.period AND b.period = p.before) / 10 END AS turnover FROM pd p)"""


@query("topk_basket", f"WITH {_BASKET} SELECT model, period, entity, CAST(position AS INTEGER) AS position FROM bk")
def _(spark, sf):
    return E.topk_basket(P.predictions(spark, sf), 10).drop("y_true")


@query("basket_turnover", f"WITH {_BASKET} SELECT model, period, round(turnover, 6) AS turnover FROM tv")
def _(spark, sf):
    return rounded(E.basket_turnover(E.topk_basket(P.predictions(spark, sf), 10)))


@query(
    "cost_scenarios",
    f"""WITH {_BASKET}, g AS (SELECT model, period, avg(y_true) AS gross FROM bk GROUP BY 1, 2), s AS (SELECT unnest([0.0::DOUBLE, 25.0::DOUBLE, 100.0::DOUBLE]) AS cost_bps),
c AS (SELECT g.*, turnover, cost_bps, CASE WHEN cost_bps = 0 THEN 0.0 ELSE turnover * cost_bps / 100 END AS drag FROM g JOIN tv USING (model, period), s)
SELECT model, period, cost_bps, round(gross, 4) AS gross, round(drag, 6) AS drag, round(gross - drag, 4) AS net FROM c""",
)
def _(spark, sf):
    members = E.topk_basket(P.predictions(spark, sf), 10)
    out = E.cost_scenarios(E.basket_returns(members), E.basket_turnover(members), [0, 25, 100])
    return out.select("model", "period", "cost_bps", F.round("gross", 4).alias("gross"), (F.round("drag", 6) + 0.0).alias("drag"), F.round("net", 4).alias("net"))


@query(
    "feature_correlation",
    f"""WITH {P.RANKED}, """
    + "c AS ("
    + " UNION ALL ".join(
        f"SELECT '{a}' AS a, '{b}' AS b, count(*) AS shared, {sql_corr(f'{a}__pct', f'{b}__pct')} AS r FROM ranked WHERE {a}__pct IS NOT NULL AND {b}__pct IS NOT NULL"
        for i, a in enumerate(P.FEATURES)
        for b in P.FEATURES[i:]
    )
    + ") SELECT a, b, shared, round(r, 9) AS correlation FROM c",
)
def _(spark, sf):
    cols = [f"{c}__pct" for c in P.FEATURES]
    plain = lambda c: F.regexp_replace(c, "__pct$", "").alias(c)
    return rounded(E.feature_correlation(P.ranked(spark, sf), cols).select(plain("a"), plain("b"), "shared", "correlation"), 9)


@query("permutation_null")
def _(spark, sf):
    return rounded(G.pooled_draws(G.permutation_null(P.predictions(spark, sf), DRAWS, SEED)), 9)


@query("bootstrap_dist")
def _(spark, sf):
    return rounded(G.pooled_draws(G.bootstrap_dist(P.predictions(spark, sf), DRAWS, SEED)), 9)


def _significance(spark, sf, scope):
    return G.analyze(P.predictions(spark, sf), DRAWS, SEED).where(F.col("scope") == scope).drop("scope")


@query("analyze_model")
def _(spark, sf):
    return rounded(_significance(spark, sf, "pooled").drop("period"), 9)


@query("split_significance")
def _(spark, sf):
    return rounded(_significance(spark, sf, "split"), 9)


@query("family_correction")
def _(spark, sf):
    return rounded(G.family_correction(_significance(spark, sf, "pooled").select("model", "p_value"), ["equal_weight", "robust_median"]), 9)


@query("null_histogram")
def _(spark, sf):
    null = G.permutation_null(P.predictions(spark, sf), DRAWS, SEED)
    return G.null_histogram(null.withColumn("ic", F.round("ic", 9)))


@query(
    "panel_balance",
    f"""WITH {P.PREDICTIONS} SELECT model, count(DISTINCT entity) AS entities, count(DISTINCT period) AS periods, count(*) AS observations,
 CASE WHEN count(y_true) < count(*) OR count(y_pred) < count(*) THEN 'unusable_values' WHEN count(DISTINCT entity) * count(DISTINCT period) <> count(*) THEN 'inconsistent_coverage' ELSE 'complete' END AS status FROM preds GROUP BY 1""",
)
def _(spark, sf):
    return G.panel_balance(P.predictions(spark, sf))


@query("cluster_bootstrap")
def _(spark, sf):
    return rounded(G.cluster_bootstrap(P.yearly_predictions(spark, sf), DRAWS, SEED), 9)


@query("trajectory_permutation")
def _(spark, sf):
    return rounded(G.trajectory_permutation(P.yearly_predictions(spark, sf), DRAWS, SEED), 9)


@query("rank_stability")
def _(spark, sf):
    return rounded(G.rank_stability(P.yearly_predictions(spark, sf), 2_000, SEED), 9)


_LOO = f"""{_IC}, pairs AS (SELECT a.model, a.period, a.entity, b.y_true, b.y_pred FROM rk a JOIN rk b ON a.model = b.model AND a.period = b.period AND a.entity <> b.entity),
lr AS (SELECT model, period, entity, {P.sql_avg_rank('y_true', 'model, period, entity')} AS rt, {P.sql_avg_rank('y_pred', 'model, period, entity')} AS rp FROM pairs),
li AS (SELECT model, period, entity, {sql_corr('rt', 'rp')} AS loo_ic FROM lr GROUP BY 1, 2, 3),
pl AS (SELECT model, count(*) AS periods, CASE WHEN count(ic) = count(*) THEN avg(ic) END AS pooled_ic FROM ics GROUP BY 1),
fl AS (SELECT rk.model, rk.period, rk.entity, ic, loo_ic, pooled_ic, CASE WHEN pooled_ic IS NOT NULL THEN round((loo_ic - ic) / periods, 9) END AS delta FROM rk JOIN ics USING (model, period) JOIN pl USING (model) LEFT JOIN li USING (model, period, entity))"""


@query("leave_one_out", f"WITH {_LOO} SELECT model, period, entity, round(ic, 8) AS ic, round(loo_ic, 8) AS loo_ic FROM fl")
def _(spark, sf):
    return rounded(L.leave_one_out(P.predictions(spark, sf)).drop("n"), 8)


@query(
    "influence",
    f"WITH {_LOO} SELECT model, period, entity, round(pooled_ic, 8) AS pooled_ic, round(delta, 7) AS delta, CASE WHEN delta > 0 THEN 'positive' WHEN delta < 0 THEN 'negative' WHEN delta = 0 THEN 'zero' END AS sign FROM fl",
)
def _(spark, sf):
    out = L.influence(P.predictions(spark, sf)).select("model", "period", "entity", "pooled_ic", "delta", "sign")
    return out.withColumns({"pooled_ic": F.round("pooled_ic", 8), "delta": F.round("delta", 7) + 0.0})


@query(
    "jackknife",
    f"""WITH {_LOO}, v AS (SELECT model, fl.pooled_ic, CASE WHEN fl.pooled_ic IS NOT NULL THEN fl.pooled_ic + (loo_ic - ic) / periods END AS x FROM fl JOIN pl USING (model)),
j AS (SELECT model, max(pooled_ic) AS pooled_ic, count(x) AS n, min(x) AS low, max(x) AS high, avg(x) AS mean, CASE WHEN count(x) > 0 THEN coalesce(stddev_samp(x), 0) END AS std, quantile_cont(x, 0.025) AS p2_5, quantile_cont(x, 0.5) AS median,
 quantile_cont(x, 0.975) AS p97_5, (count(x) - 1) * avg(x - pooled_ic) AS bias FROM v GROUP BY 1)
SELECT model, round(pooled_ic, 7) AS pooled_ic, n, round(low, 7) AS low, round(high, 7) AS high, round(mean, 7) AS mean, round(std, 7) AS std, round(p2_5, 7) AS p2_5, round(median, 7) AS median, round(p97_5, 7) AS p97_5, round(bias, 7) AS bias,
 round((n - 1) * std / sqrt(n), 7) AS std_error, CASE WHEN pooled_ic IS NULL THEN 'insufficient_data_model_pooled_ic_undefined' WHEN n = 0 THEN 'insufficient_data_no_defined_resamples' ELSE 'complete' END AS status FROM j""",
)
def _(spark, sf):
    return rounded(L.jackknife(L.influence(P.predictions(spark, sf))), 7)


@query(
    "influence_concentration",
    f"""WITH {_LOO}, o AS (SELECT model, abs(delta) AS a, row_number() OVER (PARTITION BY model ORDER BY abs(delta) DESC) AS place FROM fl WHERE delta IS NOT NULL)
SELECT model, count(*) AS observations, round(sum(a) FILTER (WHERE place <= 5) / sum(a), 6) AS top_share FROM o GROUP BY 1""",
)
def _(spark, sf):
    return rounded(L.influence_concentration(L.influence(P.predictions(spark, sf))))
