"""Further inference on rank correlations: leave-k-out draws, cohorts, monotone confidence, forward tests, rejection rates, equivalence."""

from __future__ import annotations

import math
from collections.abc import Sequence
from statistics import NormalDist

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from strataloom.functions.numbers import finite_or_null, guarded_corr
from strataloom.operators import draws as D
from strataloom.operators import resampling as G
from strataloom.operators.evaluation import MIN_ROWS, with_ranks
from strataloom.operators.ranking import cumulate
from strataloom.session import cut_lineage

BY = ["model", "period"]


# ---- leave k out -------------------------------------------------------------------------------------


def removed_slots(groups: DataFrame, draws: int, seed: int, k: int) -> DataFrame:
    """(model, period, draw, slot): k distinct observations of a model's `groups` (model, period, n) for every draw.

    Observations are numbered through a model's periods; a draw's are where its keyed bijection sends 0..k-1, so none is taken
    twice. Models with fewer than k observations have none.
    """
    spans = cumulate(groups.withColumnRenamed("n", "__rows"), ["model"], ["period"], "__rows").withColumnRenamed("below", "__from")
    spans = groups.join(spans.select("model", "period", "__from"), BY)
    whole = G.keyed(groups.groupBy("model").agg(F.sum("n").alias("n")), seed, []).where(F.col("n") >= k)

    def chosen(batches):
        for batch in batches:
            for row in range(batch.num_rows):
                one = batch.slice(row, 1)
                key, n = one.column("key")[0].as_py(), one.column("n")[0].as_py()
                for d in D.steps(k, 0, draws):
                    at = D.permuted(D.draw_keys(key, d), np.arange(k), n)
                    same = pa.array(np.zeros(at.size, np.int64))
                    yield pa.record_batch([one.column("model").take(same), pa.array(np.repeat(d, k), pa.int32()), pa.array(at.ravel(), pa.int64())], ["model", "draw", "at"])

    picks = whole.mapInArrow(chosen, f"{D.schema_of(groups, ['model'])}draw int, at long")
    hit = picks.join(spans, "model").where((F.col("at") >= F.col("__from")) & (F.col("at") < F.col("__from") + F.col("n")))
    return hit.select("model", "period", "draw", (F.col("at") - F.col("__from") + 1).alias("slot"))


def _without():
    def evaluate(batches):
        for batch in batches:
            for row in range(batch.num_rows):
                one = batch.slice(row, 1)
                x, y = (one.column(c).flatten().to_numpy(zero_copy_only=False) for c in ("x", "y"))
                gone = one.column("gone")[0].as_py()
                out = []
                for g in gone:
                    keep = np.ones(len(x), bool)
                    keep[np.array(g["slots"]) - 1] = False
                    zx, zy = (D.standard(D.average_ranks(v[keep])) if keep.sum() >= MIN_ROWS else None for v in (x, y))
                    out.append(float(zx @ zy) if zx is not None and zy is not None else None)
                same = pa.array(np.zeros(len(gone), np.int64))
                columns = [one.column(c).take(same) for c in BY] + [pa.array([g["draw"] for g in gone], pa.int32()), pa.array(out, pa.float64())]
                yield pa.record_batch(columns, [*BY, "draw", "ic"])

    return evaluate


def leave_k_out(pred: DataFrame, draws: int, seed: int, k: int = 8, entity: str = "entity") -> DataFrame:
    """(model, draw, pooled_ic): pooled rank correlation without k observations of the model, drawn from all its periods.

    Only the periods that lose one are ranked anew; the others' correlations are kept. Null if a period's is undefined. A period's rows are one row of
    arrays, its draws are dealt in chunks.
    """
    placed = G.place(pred, BY, entity)
    seen = cut_lineage(placed.groupBy(*BY).agg(F.max("n").alias("n"), guarded_corr("true_rank", "pred_rank", MIN_ROWS).alias("ic")))
    gone = removed_slots(seen.select(*BY, "n"), draws, seed, k)
    lost = cut_lineage(gone.groupBy(*BY, "draw").agg(F.collect_list("slot").alias("slots")))
    packed = F.array_sort(F.collect_list(F.struct("slot", F.col("y_true").alias("x"), F.col("y_pred").alias("y"))))
    held = placed.groupBy(*BY, "n").agg(packed.alias("held")).select(*BY, "n", F.col("held.x").alias("x"), F.col("held.y").alias("y"))
    width = F.greatest(F.lit(D.LEAST_DRAWS), F.floor(F.lit(D.UNIT_CELLS) / F.col("n"))).cast("int")
    chunks = lost.join(seen.select(*BY, "n"), BY).groupBy(*BY, F.floor(F.col("draw") / width).alias("chunk")).agg(F.collect_list(F.struct("draw", "slots")).alias("gone"))
    units = chunks.join(held, BY).repartition(*BY, "chunk").select(*BY, "x", "y", "gone")
    new = units.mapInArrow(_without(), f"{D.schema_of(placed, BY)}draw int, ic double")
    # a draw's pooled value: all periods' own, those that lost a row replaced
    parts = new.join(seen.select(*BY, F.col("ic").alias("__old")), BY).groupBy("model", "draw").agg(
        F.sum("ic").alias("new"), F.sum("__old").alias("old"), F.count_if(F.col("ic").isNull()).alias("undefined"), F.count_if(F.col("__old").isNull()).alias("was_undefined")
    )
    whole = seen.groupBy("model").agg(F.sum("ic").alias("total"), F.count(F.lit(1)).alias("periods"), F.count_if(F.col("ic").isNull()).alias("missing"))
    out = parts.join(whole, "model")
    good = (F.col("undefined") == 0) & (F.col("missing") == F.col("was_undefined"))
    return out.select("model", "draw", F.when(good, (F.col("total") - F.coalesce("old", F.lit(0.0)) + F.col("new")) / F.col("periods")).alias("pooled_ic"))


def distribution_summary(values: DataFrame, value: str, by: Sequence[str] = ("model",)) -> DataFrame:
    """(by, count, mean, std, min, p2_5, median, p97_5, max, status) of the defined values; std is 0 for one value."""
    quantiles = [F.percentile(value, F.lit(q)).alias(c) for c, q in (("p2_5", 0.025), ("median", 0.5), ("p97_5", 0.975))]
    out = values.groupBy(*by).agg(
        F.count(value).alias("count"), F.avg(value).alias("mean"), F.when(F.count(value) > 0, F.coalesce(F.stddev_samp(value), F.lit(0.0))).alias("std"), F.min(value).alias("min"), *quantiles, F.max(value).alias("max")
    )
    return out.withColumn("status", F.when(F.col("count") > 0, "complete").otherwise("insufficient_data_no_defined_resamples"))


# ---- cohorts, confidence, forward test ---------------------------------------------------------------


def cohort_ic(pred: DataFrame, members: DataFrame, least: int = 10, entity: str = "entity") -> DataFrame:
    """(model, period, n, ic, status) on the members (column entity) alone, and with period null the pooled value, withheld if a period has fewer than `least`."""
    inside = pred.join(members.select(entity).distinct(), entity, "left_semi")
    periods = pred.select(*BY).distinct()
    each = with_ranks(inside, BY, entity).groupBy(*BY).agg(F.count(F.lit(1)).alias("n"), guarded_corr("true_rank", "pred_rank", MIN_ROWS).alias("ic"))
    each = periods.join(each, BY, "left").withColumn("n", F.coalesce("n", F.lit(0)))
    few = F.col("n") < least
    each = each.withColumn("status", F.when(few, "insufficient_data_below_min_cohort_n").when(F.col("ic").isNull(), "insufficient_data_ic_undefined").otherwise("complete"))
    each = each.withColumn("ic", F.when(~few, F.col("ic")))
    whole = each.groupBy("model").agg(F.sum("n").alias("n"), F.when(F.count("ic") == F.count(F.lit(1)), F.avg("ic")).alias("ic"))
    whole = whole.withColumn("status", F.when(F.col("ic").isNull(), "insufficient_data_partial_cohort").otherwise("complete"))
    return each.unionByName(whole.withColumn("period", F.lit(None).cast(each.schema["period"].dataType)))


def monotonicity(rows: DataFrame, draws: int, seed: int, confidence: str = "confidence", error: str = "rank_error", by: Sequence[str] = ("model",), key: str = "entity") -> DataFrame:
    """(by, observed, ci_low, ci_high, usable_draws, status): rank correlation of confidence with less error, and its bootstrap interval.

    `key` identifies a row of a group. Not estimable where either has one value.
    """
    by = list(by)
    pairs = rows.select(*by, F.col(key).alias("entity"), finite_or_null(confidence).alias("y_true"), (-finite_or_null(error)).alias("y_pred"))
    placed = G.place(pairs, by)
    seen = placed.groupBy(*by).agg(guarded_corr("true_rank", "pred_rank", MIN_ROWS).alias("observed"))
    dist = G.bootstrap_dist(pairs, draws, seed, by, placed=placed)
    ends = [F.percentile("ic", F.lit(q)).alias(c) for c, q in (("ci_low", 0.025), ("ci_high", 0.975))]
    out = seen.join(dist.groupBy(*by).agg(*ends, F.count("ic").alias("usable_draws")), by, "left")
    ok = F.col("observed").isNotNull() & (F.col("usable_draws") > 0)
    return out.withColumns({c: F.when(ok, F.col(c)) for c in ("ci_low", "ci_high")}).withColumn("status", F.when(ok, "estimated").otherwise("not_estimable"))


def forward_test(frozen: DataFrame, outcomes: DataFrame, draws: int, seed: int, entity: str = "entity", score: str = "score", outcome: str = "outcome", alpha: float = 0.05) -> DataFrame:
    """One row: frozen and usable entities, ic, p_value, distinguishable, interpretation, of a ranking made before its outcomes.

    Both are unique by entity. Every frozen entity is accounted for; those without a finite outcome are not ranked. Without an outcome at all nothing is
    computed (`outcomes_absent`).
    """
    rows = frozen.select(entity, finite_or_null(score).alias("y_pred")).join(outcomes.select(entity, finite_or_null(outcome).alias("y_true")), entity, "left")
    rows = cut_lineage(rows.select(F.col(entity).alias("entity"), F.lit("frozen").alias("model"), F.lit(0).alias("period"), "y_true", "y_pred"))
    sizes = rows.agg(F.count(F.lit(1)).alias("frozen"), F.count(F.when(F.col("y_pred").isNotNull(), F.col("y_true"))).alias("usable"))
    placed = G.place(rows)
    seen = placed.groupBy("model").agg(F.round(guarded_corr("true_rank", "pred_rank", MIN_ROWS), 12).alias("ic"))
    null = G.permutation_null(rows, draws, seed, placed=placed).join(seen.withColumnRenamed("ic", "__o"), "model")
    p = null.groupBy("model").agg(F.when(F.max("__o").isNotNull(), G.two_sided_p(F.col("__o"), F.round("ic", 12))).alias("p_value"))
    out = sizes.join(seen.join(p, "model"), F.lit(True), "left")
    sign = F.when(F.col("ic") > 0, "positive").otherwise("negative")
    out = out.withColumn("distinguishable", F.col("p_value") < alpha)
    cell = F.concat(sign, F.when(F.col("distinguishable"), "_and_statistically_distinguishable").otherwise("_and_not_distinguishable"))
    status = F.when(F.col("usable") == 0, "outcomes_absent").when(F.col("ic").isNull(), "undefined").otherwise(cell)
    return out.select("frozen", "usable", "ic", "p_value", "distinguishable", status.alias("interpretation"))


# ---- repetitions -------------------------------------------------------------------------------------


def wilson(successes: Column, trials: Column, confidence: float = 0.95) -> Column:
    """Struct (low, high) of the score interval of a share."""
    z = NormalDist().inv_cdf(0.5 + confidence / 2)
    share, whole = successes / trials, 1 + z * z / trials
    centre = (share + z * z / (2 * trials)) / whole
    radius = z * F.sqrt(share * (1 - share) / trials + z * z / (4 * trials * trials)) / whole
    return F.struct(F.greatest(F.lit(0.0), centre - radius).alias("low"), F.least(F.lit(1.0), centre + radius).alias("high"))


def upper_tail(trials: Column, p: float, least: Column) -> Column:
    """P(X >= least) of a binomial: log terms from log p(0) on, one ratio after another."""
    start = F.struct((trials * math.log1p(-p)).alias("log"), F.lit(0.0).alias("below"))

    def step(held, x):
        term = held["log"]
        following = term + F.log((trials - x) / (x + 1.0)) + math.log(p / (1 - p))
        return F.struct(following.alias("log"), (held["below"] + F.exp(term)).alias("below"))

    smaller = F.aggregate(F.sequence(F.lit(0).cast("long"), least - 1), start, step)["below"]
    return F.when(least <= 0, 1.0).when(least > trials, 0.0).otherwise(F.greatest(F.lit(0.0), 1 - smaller))


def rejection_rates(reps: DataFrame, alpha: float = 0.05, by: Sequence[str] = ("control",), gate: float = 0.01) -> DataFrame:
    """(by, repetitions, analyzable, rejections, rate, wilson_low, wilson_high, upper_tail, fails) of repetitions' p-values.

    A repetition without a p-value is not analyzable. `upper_tail`: chance of as many rejections at rate alpha; a control fails below `gate`.
    """
    out = reps.groupBy(*by).agg(F.count(F.lit(1)).alias("repetitions"), F.count("p_value").alias("analyzable"), F.count_if(F.col("p_value") < alpha).alias("rejections"))
    n, k = F.col("analyzable"), F.col("rejections")
    out = out.withColumn("rate", F.try_divide(k, n)).withColumn("__w", F.when(n > 0, wilson(k, n))).withColumn("upper_tail", F.when(n > 0, upper_tail(n, alpha, k)))
    return out.select(*by, "repetitions", "analyzable", "rejections", "rate", F.col("__w.low").alias("wilson_low"), F.col("__w.high").alias("wilson_high"), "upper_tail", (F.col("upper_tail") < gate).alias("fails"))


def equivalence_summary(reps: DataFrame, delta: float, by: Sequence[str] = ("model",), value: str = "ic") -> DataFrame:
    """(by, n, mean_ic, low, high, delta, equivalent_to_zero): mean and its 90 % interval by repetitions; equivalent if inside -delta..delta."""
    z = NormalDist().inv_cdf(0.95)
    error = F.coalesce(F.stddev_samp(value) / F.sqrt(F.count(value)), F.lit(0.0)) * z
    out = reps.groupBy(*by).agg(F.count(value).alias("n"), F.avg(value).alias("mean_ic"), (F.avg(value) - error).alias("low"), (F.avg(value) + error).alias("high"))
    return out.withColumn("delta", F.lit(float(delta))).withColumn("equivalent_to_zero", (F.col("low") >= -delta) & (F.col("high") <= delta))
