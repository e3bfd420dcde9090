"""Queries: leave-eight-out, cohorts, monotone confidence, forward test, rejection rates, equivalence."""

from pyspark.sql import functions as F

from strataloom.operators import inference as N
from strataloom.operators import resampling as G
from strataloom.operators.evaluation import spearman_ic
from strataloom.operators.validation import rank_errors
from strataloom.plans import panels as P
from strataloom.plans.catalogue_eval import SEED, sql_corr
from strataloom.plans.registry import query, rounded, table


@query("leave_eight_out")
def _(spark, sf):
    return rounded(N.distribution_summary(N.leave_k_out(P.yearly_predictions(spark, sf), 2_000, SEED), "pooled_ic"))


@query(
    "cohort_ic",
    f"""WITH {P.YEARLY_PREDICTIONS}, u AS (SELECT p.* FROM preds p JOIN supplier ON s_suppkey = entity WHERE s_acctbal > 5000 AND y_true IS NOT NULL AND y_pred IS NOT NULL),
rk AS (SELECT model, period, {P.sql_avg_rank('y_true', 'model, period')} AS rt, {P.sql_avg_rank('y_pred', 'model, period')} AS rp FROM u), i AS (SELECT model, period, count(*) AS n, {sql_corr('rt', 'rp')} AS ic FROM rk GROUP BY 1, 2),
e AS (SELECT d.model, d.period, coalesce(n, 0) AS n, CASE WHEN n >= 10 THEN ic END AS ic, CASE WHEN coalesce(n, 0) < 10 THEN 'insufficient_data_below_min_cohort_n' WHEN ic IS NULL THEN 'insufficient_data_ic_undefined' ELSE 'complete' END AS status FROM (SELECT DISTINCT model, period FROM preds) d LEFT JOIN i USING (model, period))
SELECT model, period, n, round(ic, 9) AS ic, status FROM e UNION ALL SELECT model, NULL, sum(n)::BIGINT, round(CASE WHEN count(ic) = count(*) THEN avg(ic) END, 9), CASE WHEN count(ic) = count(*) THEN 'complete' ELSE 'insufficient_data_partial_cohort' END FROM e GROUP BY 1""",
)
def _(spark, sf):
    members = table(spark, sf, "supplier").where("s_acctbal > 5000").select(F.col("s_suppkey").alias("entity"))
    return rounded(N.cohort_ic(P.yearly_predictions(spark, sf), members), 9)


@query("monotonicity")
def _(spark, sf):
    errors = rank_errors(P.yearly_predictions(spark, sf)).withColumn("key", F.concat_ws("|", "entity", "period"))
    return rounded(N.monotonicity(errors, 2_000, SEED, "y_pred", key="key"))


@query("forward_test")
def _(spark, sf):
    """The last year's scores, frozen, against the outcomes realised after them."""
    rows = P.yearly_predictions(spark, sf).where("model = 'equal_weight'")
    last = rows.join(F.broadcast(rows.agg(F.max("period").alias("period"))), "period")
    return rounded(N.forward_test(last.select("entity", F.col("y_pred").alias("score")), last.select("entity", F.col("y_true").alias("outcome")), 10_000, SEED), 9)


@query("rejection_rates")
def _(spark, sf):
    """Permutation tests of every month as repetitions of each model."""
    tests = G.analyze(P.predictions(spark, sf), 2_000, SEED).where("scope = 'split'")
    return rounded(N.rejection_rates(tests.select(F.col("model").alias("control"), "p_value")))


_IC = f"""{P.PREDICTIONS}, rk AS (SELECT model, period, {P.sql_avg_rank('y_true', 'model, period')} AS rt, {P.sql_avg_rank('y_pred', 'model, period')} AS rp FROM preds WHERE y_true IS NOT NULL AND y_pred IS NOT NULL),
ic AS (SELECT model, period, {sql_corr('rt', 'rp')} AS ic FROM rk GROUP BY 1, 2)"""


@query(
    "equivalence_summary",
    f"""WITH {_IC}, m AS (SELECT model, count(ic) AS n, avg(ic) AS mean_ic, coalesce(stddev_samp(ic) / sqrt(count(ic)), 0) * 1.6448536269514722 AS e FROM ic GROUP BY 1)
SELECT model, n, round(mean_ic, 6) AS mean_ic, round(mean_ic - e, 6) AS low, round(mean_ic + e, 6) AS high, 0.05::DOUBLE AS delta, mean_ic - e >= -0.05 AND mean_ic + e <= 0.05 AS equivalent_to_zero FROM m""",
)
def _(spark, sf):
    return rounded(N.equivalence_summary(spearman_ic(P.predictions(spark, sf)), 0.05))


@query(
    "rejection_bounds",
    f"""WITH RECURSIVE {_IC}, c AS (SELECT model AS control, count(*) AS repetitions, count(ic) AS analyzable, count(*) FILTER (WHERE ic < 0.05) AS rejections FROM ic GROUP BY 1),
b AS (SELECT control, analyzable, rejections, 0 AS x, analyzable * ln(0.95) AS lg FROM c UNION ALL SELECT control, analyzable, rejections, x + 1, lg + ln((analyzable - x) / (x + 1)) + ln(0.05 / 0.95) FROM b WHERE x + 1 < rejections),
t AS (SELECT control, CASE WHEN any_value(rejections) <= 0 THEN 1 ELSE greatest(0, 1 - sum(exp(lg))) END AS tail FROM b GROUP BY 1),
w AS (SELECT *, rejections / analyzable AS p, 3.8414588206941254 AS z2 FROM c)
SELECT control, repetitions, analyzable, rejections, round(p, 6) AS rate, round(greatest(0, ((p + z2 / (2 * analyzable)) - sqrt(z2) * sqrt(p * (1 - p) / analyzable + z2 / (4 * analyzable * analyzable))) / (1 + z2 / analyzable)), 6) AS wilson_low,
 round(least(1, ((p + z2 / (2 * analyzable)) + sqrt(z2) * sqrt(p * (1 - p) / analyzable + z2 / (4 * analyzable * analyzable))) / (1 + z2 / analyzable)), 6) AS wilson_high, round(tail, 6) AS upper_tail, tail < 0.01 AS fails FROM w JOIN t USING (control)""",
)
def _(spark, sf):
    """The same bounds on months' correlations in place of p-values, which SQL can follow."""
    reps = spearman_ic(P.predictions(spark, sf)).select(F.col("model").alias("control"), F.col("ic").alias("p_value"))
    return rounded(N.rejection_rates(reps))
