"""Queries: walk-forward evaluation, fitted models, next-label and success scores."""

from pyspark.sql import functions as F

from strataloom.operators import evaluation as E
from strataloom.operators import importance as I
from strataloom.operators import models as M
from strataloom.operators.panel import next_period_target
from strataloom.plans import panels as P
from strataloom.plans.registry import query, rounded

PCT = [f"{c}__pct" for c in P.FEATURES]


def _panel(spark, sf):
    return P.yearly_ranked(spark, sf).where(F.col("target").isNotNull())


@query(
    "walk_forward",
    f"""WITH {P.YEARLY_RANKED}, r AS (SELECT * FROM ranked WHERE target IS NOT NULL), t AS (SELECT DISTINCT period AS split FROM r ORDER BY 1 DESC LIMIT 3)
SELECT split, CASE WHEN period = split THEN 'test' ELSE 'train' END AS role, count(*) AS n, min(period) AS first_period, max(target_period) AS last_target, round(avg(target), 4) AS mean_target
 FROM r JOIN t ON target_period <= split OR period = split GROUP BY 1, 2""",
)
def _(spark, sf):
    df = _panel(spark, sf)
    out = M.walk_forward(df, M.last_tests(df)).groupBy("split", "role")
    return out.agg(F.count(F.lit(1)).alias("n"), F.min("period").alias("first_period"), F.max("target_period").alias("last_target"), F.round(F.avg("target"), 4).alias("mean_target"))


def linear_predictions(spark, sf):
    df = _panel(spark, sf)
    tests = M.last_tests(df)
    return M.predict_linear(df, PCT, M.linear_folds(df, PCT, tests)).unionByName(P.baseline_predictions(df.where(F.col("period").isin(tests))))


@query("walk_forward_linear")
def _(spark, sf):
    return rounded(linear_predictions(spark, sf))


@query("walk_forward_metrics")
def _(spark, sf):
    return rounded(E.split_metrics(linear_predictions(spark, sf)))


@query("linear_coefficients")
def _(spark, sf):
    df = _panel(spark, sf)
    fitted = M.linear_folds(df, PCT, M.last_tests(df))
    return rounded(fitted.select("split", "model", "n", "intercept", F.posexplode("coef").alias("place", "coefficient")))


@query("walk_forward_trees")
def _(spark, sf):
    df = _panel(spark, sf)
    return rounded(M.predict_trees(df, PCT, M.last_tests(df), {"random_forest": M.forest_regressor(), "gradient_boosting": M.boosting_regressor()}))


def _labelled(spark, sf):
    """Next year's revenue above this year's as the label; the last year has none."""
    df = P.yearly_ranked(spark, sf)
    return df.withColumn("label", F.when(F.col("target").isNotNull(), (F.col("target") > F.col("revenue")).cast("int")))


@query("logistic_next_label")
def _(spark, sf):
    df = _labelled(spark, sf)
    known = df.where(F.col("label").isNotNull())
    train = known.join(F.broadcast(M.training_cutoff(known)), F.col("period") <= F.col("cutoff")).drop("cutoff")
    model = M.fit_logistic(train, P.FEATURES)
    if model is None:
        return df.select("entity", "period", F.lit(None).cast("double").alias("probability"), F.lit(None).cast("double").alias("score"), F.lit("rule_based").alias("label_used")).limit(0)
    out = M.logistic_scores(df, P.FEATURES, model, ["entity", "period"])
    return rounded(out.select("entity", "period", "probability", "score", *[F.col("contributions")[c].alias(f"from_{c}") for c in P.FEATURES]), 4)


def _success(spark, sf):
    return M.success_scores(_labelled(spark, sf), P.FEATURES, ["entity", "period"], folds=2)


@query("success_family")
def _(spark, sf):
    return rounded(_success(spark, sf), 4)


@query(
    "ensemble",
    f"""WITH {P.YEARLY_RANKED}, s AS (SELECT entity, period, 'elasticnet' AS model, revenue__pct AS p FROM ranked UNION ALL SELECT entity, period, 'random_forest', returned__pct FROM ranked UNION ALL SELECT entity, period, 'unknown', quantity__pct FROM ranked)
SELECT entity, period, round(sum(p * 0.2) / sum(0.2), 4) AS probability, round(100 * sum(p * 0.2) / sum(0.2), 2) AS score, list_sort(list(model))::VARCHAR AS models FROM s WHERE p IS NOT NULL AND model <> 'unknown' GROUP BY 1, 2""",
)
def _(spark, sf):
    models = {"elasticnet": "revenue__pct", "random_forest": "returned__pct", "unknown": "quantity__pct"}
    scores = F.explode(F.array(*[F.struct(F.lit(m).alias("model"), F.col(c).alias("probability")) for m, c in models.items()]))
    out = M.ensemble(P.yearly_ranked(spark, sf).select("entity", "period", scores.alias("s")).select("entity", "period", "s.*"), ["entity", "period"])
    return out.withColumn("models", F.concat(F.lit("["), F.array_join("models", ", "), F.lit("]")))


@query(
    "mutual_information",
    f"""WITH {P.YEARLY_RANKED}, r AS (SELECT * FROM ranked WHERE target IS NOT NULL), b AS ({" UNION ALL ".join(f"SELECT '{c}' AS feature, floor((rank() OVER (ORDER BY {c}) - 1) * 10 / count(*) OVER ()) AS x, entity, period FROM r WHERE {c} IS NOT NULL" for c in P.FEATURES)}),
t AS (SELECT entity, period, floor((rank() OVER (ORDER BY target) - 1) * 10 / count(*) OVER ()) AS y FROM r), c AS (SELECT feature, x, y, count(*) AS n FROM b JOIN t USING (entity, period) GROUP BY 1, 2, 3),
m AS (SELECT *, sum(n) OVER (PARTITION BY feature) AS s, sum(n) OVER (PARTITION BY feature, x) AS sx, sum(n) OVER (PARTITION BY feature, y) AS sy FROM c)
SELECT feature, round(sum(n / s * ln(n * s / (sx * sy))), 6) AS mutual_information FROM m GROUP BY 1""",
)
def _(spark, sf):
    return rounded(I.mutual_information(_panel(spark, sf), P.FEATURES, ["entity", "period"], "target"))


@query("feature_importance")
def _(spark, sf):
    return rounded(I.importances(_panel(spark, sf), P.FEATURES, ["entity", "period"], "target"))


def _target_board(spark, sf, column):
    """Metrics of the linear models and baselines for next year's value of one column."""
    df = P.yearly_ranked(spark, sf).drop("target", "target_period")
    df = next_period_target(df, "entity", "period", column).where(F.col("target").isNotNull())
    tests = M.last_tests(df)
    pred = M.predict_linear(df, PCT, M.linear_folds(df, PCT, tests)).unionByName(P.baseline_predictions(df.where(F.col("period").isin(tests))))
    return E.split_metrics(pred)


@query("multi_target_eval")
def _(spark, sf):
    return rounded(E.multi_target({c: _target_board(spark, sf, c) for c in ("revenue", "quantity", "discount")}))


@query(
    "leaderboard_rebuild",
    f"""WITH {P.YEARLY_PREDICTIONS}, u AS (SELECT * FROM preds WHERE y_true IS NOT NULL AND y_pred IS NOT NULL), b AS (SELECT model, period, count(*) AS n, avg(abs(y_true - y_pred)) AS mae FROM u GROUP BY 1, 2 HAVING count(*) >= 3),
s AS (SELECT model, period, n::DOUBLE AS n, CASE WHEN model = 'momentum' THEN mae + 1 ELSE mae END AS mae FROM b WHERE period <> 1994),
l AS (SELECT coalesce(b.model, s.model) AS model, coalesce(b.period, s.period) AS period, m.metric, CASE m.metric WHEN 'n' THEN s.n ELSE s.mae END AS stored, CASE m.metric WHEN 'n' THEN b.n ELSE b.mae END AS rebuilt, s.model IS NULL AS gone FROM b LEFT JOIN s ON s.model = b.model AND s.period = b.period, (VALUES ('n'), ('mae')) m(metric))
SELECT model, period, metric, round(stored, 6) AS stored, round(rebuilt, 6) AS rebuilt, CASE WHEN gone THEN 'missing_stored' WHEN abs(stored - rebuilt) <= 1e-6 * greatest(1, abs(stored)) THEN 'match' ELSE 'mismatch' END AS status FROM l""",
)
def _(spark, sf):
    """A stored board with one model's errors changed and one year left out, against the rows it came from."""
    pred = P.yearly_predictions(spark, sf)
    stored = E.split_metrics(pred).where("period <> 1994").select("model", "period", "n", (F.col("mae") + F.when(F.col("model") == "momentum", 1).otherwise(0)).alias("mae"))
    return rounded(E.rebuild_leaderboard(pred, stored).where(F.col("metric").isin("n", "mae")))
