"""Queries: validation of scores, calibration, classification, agreement of rankings, feature reports."""

from pyspark.sql import functions as F
from pyspark.sql.window import Window as W

from strataloom.operators import models as M
from strataloom.operators import validation as V
from strataloom.operators.evaluation import split_metrics
from strataloom.operators.ranking import group_quantiles
from strataloom.plans import panels as P
from strataloom.plans.catalogue_eval import sql_corr
from strataloom.plans.catalogue_models import PCT, linear_predictions
from strataloom.plans.registry import query, rounded


def _equal_weight(spark, sf):
    return P.yearly_predictions(spark, sf).where("model = 'equal_weight'")


_EW = f"{P.YEARLY_PREDICTIONS}, ew AS (SELECT entity, period, y_true, y_pred FROM preds WHERE model = 'equal_weight' AND y_pred IS NOT NULL)"


@query(
    "score_validation",
    f"""WITH {_EW}, r AS (SELECT *, {P.sql_avg_rank('y_pred', 'period')} AS rs, {P.sql_avg_rank('y_true', 'period')} AS ro, row_number() OVER (PARTITION BY period ORDER BY y_pred DESC, entity) AS ps,
 row_number() OVER (PARTITION BY period ORDER BY y_true DESC, entity) AS po, count(*) OVER (PARTITION BY period) AS n FROM ew),
v AS (SELECT period, max(n) AS n, {sql_corr('y_pred', 'y_true')} AS pearson, {sql_corr('rs', 'ro')} AS spearman, {', '.join(f"CASE WHEN max(n) >= {k} THEN round(count(*) FILTER (WHERE ps <= {k} AND po <= {k}) / {k}, 3) END AS hit_at_{k}" for k in (5, 10, 20))},
 CASE WHEN max(n) >= 10 THEN avg(y_true) FILTER (WHERE ps <= greatest(1, n // 5)) END AS high_mean, CASE WHEN max(n) >= 10 THEN avg(y_true) FILTER (WHERE ps > n - greatest(1, n // 5)) END AS low_mean FROM r GROUP BY 1)
SELECT period, n, round(pearson, 6) AS pearson, round(spearman, 6) AS spearman, hit_at_5, hit_at_10, hit_at_20, round(high_mean, 4) AS high_mean, round(low_mean, 4) AS low_mean, round(high_mean - low_mean, 4) AS spread,
 CASE WHEN spearman > 0.1 THEN 'worked' WHEN spearman < -0.1 THEN 'failed' ELSE 'neither' END AS verdict FROM v""",
)
def _(spark, sf):
    out = V.score_validation(_equal_weight(spark, sf), "y_pred", "y_true")
    return out.withColumns({c: F.round(c, d) + 0.0 for c, d in (("pearson", 6), ("spearman", 6), ("high_mean", 4), ("low_mean", 4), ("spread", 4))})


_ERR = f"""{_EW}, er AS (SELECT entity, period, y_pred AS confidence, abs({P.sql_avg_rank('y_pred', 'period', True)} - ({P.sql_avg_rank('y_true', 'period', True)})) AS rank_error FROM ew),
cv AS (SELECT entity, period, (CAST(revenue IS NOT NULL AS INT) + CAST(quantity IS NOT NULL AS INT) + CAST(discount IS NOT NULL AS INT) + CAST(returned IS NOT NULL AS INT)) / 4 AS feature_coverage FROM years WHERE period < 1996),
rows_ AS (SELECT er.*, feature_coverage, CASE WHEN feature_coverage IS NULL THEN 'missing_input_row' ELSE 'observed' END AS coverage_status FROM er LEFT JOIN cv USING (entity, period))"""


def _errors(spark, sf):
    errors = V.rank_errors(_equal_weight(spark, sf).where("y_pred IS NOT NULL"))
    coverage = V.feature_coverage(P.supplier_year(spark, sf).where("period < 1996"), P.FEATURES, ["entity", "period"])
    return V.join_coverage(errors.withColumn("confidence", F.col("y_pred")), coverage, ["entity", "period"])


@query("rank_errors", f"WITH {_ERR} SELECT entity, period, round(rank_error, 6) AS rank_error, feature_coverage, coverage_status FROM rows_")
def _(spark, sf):
    return rounded(_errors(spark, sf).select("entity", "period", "rank_error", "feature_coverage", "coverage_status"))


@query(
    "calibration_bins",
    f"""WITH {_ERR}, q AS (SELECT least(10, count(DISTINCT confidence)) AS q FROM rows_), ed AS (SELECT list_sort(list(DISTINCT e)) AS edges FROM (SELECT quantile_cont(confidence, [i / 10 FOR i IN range(0, 11)]) AS es FROM rows_), unnest(es) t(e)),
b AS (SELECT *, greatest(1, len(list_filter(edges, lambda e: e < confidence))) AS confidence_bin FROM rows_, ed)
SELECT confidence_bin::INTEGER AS confidence_bin, 'estimated' AS calibration_status, round(min(confidence), 6) AS confidence_min, round(max(confidence), 6) AS confidence_max, round(avg(confidence), 6) AS mean_confidence, count(*) AS n_model_rows,
 count(DISTINCT (entity, period)) AS n_entity_periods, round(avg(rank_error), 6) AS mean_rank_error, round(median(rank_error), 6) AS median_rank_error, round(avg(feature_coverage), 6) AS mean_feature_coverage FROM b GROUP BY 1""",
)
def _(spark, sf):
    return rounded(V.calibration_bins(_errors(spark, sf)))


def _labelled(spark, sf):
    """Outcome above its period's median as the label, the score as the probability."""
    rows = P.yearly_predictions(spark, sf).where("y_pred IS NOT NULL")
    middle = group_quantiles(rows.where("model = 'equal_weight'"), ["period"], "y_true", {"__m": 0.5}).drop("n")
    return rows.join(middle, "period").withColumn("label", (F.col("y_true") > F.col("__m")).cast("int"))


@query(
    "classification_report",
    f"""WITH {P.YEARLY_PREDICTIONS}, l0 AS (SELECT *, median(y_true) FILTER (WHERE model = 'equal_weight') OVER (PARTITION BY period) AS m FROM preds WHERE y_pred IS NOT NULL),
l AS (SELECT *, CAST(y_true > m AS INT) AS y, {P.sql_avg_rank('y_pred', 'model')} AS rk, y_pred >= 0.5 AS s FROM l0),
c AS (SELECT model, count(*) AS n, sum(y)::BIGINT AS positives, count(*) FILTER (WHERE NOT s AND y = 0) AS tn, count(*) FILTER (WHERE s AND y = 0) AS fp, count(*) FILTER (WHERE NOT s AND y = 1) AS fn, count(*) FILTER (WHERE s AND y = 1) AS tp,
 sum(rk) FILTER (WHERE y = 1) AS r, avg(y_pred) AS mp, avg(y) AS ma FROM l GROUP BY 1)
SELECT model, n, positives, round((tp + tn) / n, 6) AS accuracy, round(tp / (tp + fp), 6) AS "precision", round(tp / (tp + fn), 6) AS recall, round(2 * tp / (2 * tp + fp + fn), 6) AS f1, round((r - positives * (positives + 1) / 2) / (positives * (n - positives)), 6) AS auc,
 tn, fp, fn, tp, round(mp, 6) AS mean_predicted, round(ma, 6) AS mean_actual, round(abs(mp - ma), 6) AS calibration_gap FROM c""",
)
def _(spark, sf):
    return rounded(V.classification_report(_labelled(spark, sf), ["model"], ["entity", "period"], probability="y_pred"))


@query("time_split_validation")
def _(spark, sf):
    df = P.yearly_ranked(spark, sf).where(F.col("target").isNotNull()).withColumn("label", (F.col("target") > F.col("revenue")).cast("int"))
    df = df.join(F.broadcast(M.training_cutoff(df, 0.7)))
    model = M.fit_logistic(df.where("period <= cutoff"), P.FEATURES, balanced=True)
    test = df.where("period > cutoff")
    scored = M.logistic_scores(test, P.FEATURES, model, ["entity", "period", "label"]) if model else test.select("entity", "period", "label", F.lit(None).cast("double").alias("probability"))
    return rounded(V.classification_report(scored, [], ["entity", "period"]))


@query(
    "topk_agreement",
    f"""WITH {_EW}, r AS (SELECT entity, period, row_number() OVER (PARTITION BY period ORDER BY y_pred DESC, entity) AS r FROM ew QUALIFY r <= 10), p AS (SELECT period AS run, lag(period) OVER (ORDER BY period) AS previous_run FROM (SELECT DISTINCT period FROM r))
SELECT run, previous_run, round(count(b.r) / 10, 6) AS overlap_at_k, CASE WHEN count(b.r) > 0 THEN round(greatest(0, 1 - avg(abs(a.r - b.r)) / 10), 6) END AS rank_stability
 FROM p JOIN r a ON a.period = run LEFT JOIN r b ON b.period = previous_run AND b.entity = a.entity WHERE previous_run IS NOT NULL GROUP BY 1, 2""",
)
def _(spark, sf):
    order = W.partitionBy("period").orderBy(F.desc("y_pred"), "entity")
    top = _equal_weight(spark, sf).where("y_pred IS NOT NULL").withColumn("rank", F.row_number().over(order)).where("rank <= 10")
    return rounded(V.topk_agreement(top.withColumnRenamed("period", "run")))


@query("backtest_diagnostics")
def _(spark, sf):
    board = split_metrics(linear_predictions(spark, sf))
    kind = F.when(F.col("model").isin("equal_weight", "momentum", "robust_median"), "baseline").otherwise("ml")
    return rounded(V.backtest_diagnostics(board.select(F.col("period").alias("split"), kind.alias("kind"), "spearman")), 6)


_FOLDS = f"""{P.YEARLY_RANKED}, rt AS (SELECT * FROM ranked WHERE target IS NOT NULL), t AS (SELECT DISTINCT period AS split FROM rt ORDER BY 1 DESC LIMIT 3),
lg AS ({" UNION ALL ".join(f"SELECT split, entity, period, '{c}' AS feature, {c}__pct AS x, target AS y FROM rt JOIN t ON target_period <= split WHERE {c}__pct IS NOT NULL" for c in P.FEATURES)}),
rk AS (SELECT split, feature, {P.sql_avg_rank('x', 'split, feature')} AS rx, {P.sql_avg_rank('y', 'split, feature')} AS ry FROM lg),
st AS (SELECT split, feature, abs({sql_corr('rx', 'ry')}) AS r FROM rk GROUP BY 1, 2)"""


@query("feature_stability", f"WITH {_FOLDS} SELECT feature, round(avg(r), 6) AS mean_abs_spearman, round(coalesce(stddev_samp(r), 0), 6) AS std_abs_spearman, count(r) AS splits_observed FROM st GROUP BY 1")
def _(spark, sf):
    df = P.yearly_ranked(spark, sf).where(F.col("target").isNotNull())
    train = M.walk_forward(df, M.last_tests(df)).where("role = 'train'")
    out = V.feature_stability(train, PCT, ["entity", "period"])
    return rounded(out.withColumn("feature", F.regexp_replace("feature", "__pct$", "")))


@query(
    "coverage_impact",
    f"""WITH {P.RANKED}, c AS (SELECT target, (CAST(revenue IS NOT NULL AS INT) + CAST(quantity IS NOT NULL AS INT) + CAST(discount IS NOT NULL AS INT) + CAST(returned IS NOT NULL AS INT)) / 4 AS s FROM ranked WHERE target IS NOT NULL)
SELECT CASE WHEN s <= 0.5 THEN 'low' WHEN s <= 0.8 THEN 'medium' ELSE 'high' END AS coverage_bucket, count(*) AS n, round(avg(target), 4) AS mean_target, round(median(target), 4) AS median_target FROM c GROUP BY 1""",
)
def _(spark, sf):
    return rounded(V.coverage_impact(P.targets(spark, sf), P.FEATURES), 4)
