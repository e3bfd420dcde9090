"""Validation of scores: hits and spreads by period, rank errors, calibration bins, classification, agreement of rankings."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from strataloom.functions.numbers import finite_or_null, guarded_corr
from strataloom.operators.ranking import average_rank, average_rank_desc, group_quantiles, ordinal, rank_within, tally_ranks


def score_validation(df: DataFrame, score: str = "score", outcome: str = "outcome", entity: str = "entity", period: str = "period", ks: Sequence[int] = (5, 10, 20)) -> DataFrame:
    """Per period: n, pearson, spearman, hit_at_k, high_mean, low_mean, spread, verdict.

    Rows need both values. A hit is an entity among the k highest by score and by outcome, entity ascending inside ties; null for fewer than
    k rows. The quintiles are the n // 5 lowest and highest by score (null under ten rows). verdict: `worked` above a rank
    correlation of 0.1, `failed` below -0.1.
    """
    rows = df.select(period, entity, finite_or_null(score).alias("s"), finite_or_null(outcome).alias("o")).where("s IS NOT NULL AND o IS NOT NULL")
    rows = rank_within(rows, [period, entity], [period], {"rs": ("s", average_rank), "ro": ("o", average_rank)})
    rows = ordinal(ordinal(rows, [period], "s", entity, "ps"), [period], "o", entity, "po")
    rows = rows.join(rows.groupBy(period).agg(F.count(F.lit(1)).alias("n")), period)
    fifth = F.greatest(F.lit(1), F.floor(F.col("n") / 5))
    hits = [F.when(F.max("n") >= k, F.round(F.count_if((F.col("ps") <= k) & (F.col("po") <= k)) / k, 3)).alias(f"hit_at_{k}") for k in ks]
    mean = lambda cond: F.when(F.max("n") >= 10, F.avg(F.when(cond, F.col("o"))))
    out = rows.groupBy(period).agg(
        F.max("n").alias("n"),
        guarded_corr("s", "o", 3).alias("pearson"),
        guarded_corr("rs", "ro", 3).alias("spearman"),
        *hits,
        mean(F.col("ps") <= fifth).alias("high_mean"),
        mean(F.col("ps") > F.col("n") - fifth).alias("low_mean"),
    )
    verdict = F.when(F.col("spearman") > 0.1, "worked").when(F.col("spearman") < -0.1, "failed").otherwise("neither")
    return out.withColumn("spread", F.col("high_mean") - F.col("low_mean")).withColumn("verdict", verdict)


def rank_errors(pred: DataFrame, by: Sequence[str] = ("model", "period"), entity: str = "entity") -> DataFrame:
    """pred with predicted_rank, realized_rank (descending, average ties, missing values unranked) and rank_error."""
    rows = pred.withColumns({"y_true": finite_or_null("y_true"), "y_pred": finite_or_null("y_pred")})
    out = rank_within(rows, [entity, *by], list(by), {"predicted_rank": ("y_pred", average_rank_desc), "realized_rank": ("y_true", average_rank_desc)})
    return out.withColumn("rank_error", F.abs(F.col("predicted_rank") - F.col("realized_rank")))


def feature_coverage(df: DataFrame, cols: Sequence[str], keys: Sequence[str]) -> DataFrame:
    """(keys, feature_coverage): share of the columns that a row has."""
    return df.select(*keys, (sum((finite_or_null(c).isNotNull().cast("int") for c in cols), F.lit(0)) / len(cols)).alias("feature_coverage"))


def join_coverage(rows: DataFrame, coverage: DataFrame, keys: Sequence[str]) -> DataFrame:
    """rows with feature_coverage and coverage_status: a row that the coverage lacks is unknown, not zero."""
    out = rows.join(coverage, list(keys), "left")
    return out.withColumn("coverage_status", F.when(F.col("feature_coverage").isNull(), "missing_input_row").otherwise("observed"))


def quantile_edges(df: DataFrame, value: str, bins: int = 10) -> DataFrame:
    """One row (edges, distinct_values): the distinct quantiles 0, 1/q ... 1 of the values, q the lesser of `bins` and the number of distinct values.

    Quantiles interpolate linearly; the two positions of each are looked up in the tally, whose ranges hold them, so no column is collected.
    """
    placed = tally_ranks(df, [], value)
    size = placed.agg(F.max("n").alias("rows"), F.count(F.lit(1)).alias("distinct_values"))
    q = F.least(F.lit(bins), F.col("distinct_values")).cast("int")
    spots = size.where("distinct_values > 0").select("distinct_values", F.explode(F.transform(F.sequence(F.lit(0), q), lambda i: (F.col("rows") - 1) * i / q)).alias("spot"))
    holds = lambda k: (F.col("below") <= k) & (k < F.col("below") + F.col("ties"))
    # at most bins + 1 rows
    near = placed.join(F.broadcast(spots), holds(F.floor("spot")) | holds(F.ceil("spot")))
    part = F.col("spot") - F.floor("spot")
    weight = F.when(holds(F.floor("spot")), 1 - part).otherwise(0.0) + F.when(holds(F.ceil("spot")), part).otherwise(0.0)
    edges = near.groupBy("spot", "distinct_values").agg(F.sum(F.col(value) * weight).alias("edge"))
    return edges.groupBy("distinct_values").agg(F.array_sort(F.collect_set("edge")).alias("edges"))


def calibration_bins(rows: DataFrame, value: str = "confidence", error: str = "rank_error", coverage: str = "feature_coverage", entity: str = "entity", period: str = "period", bins: int = 10) -> DataFrame:
    """Per bin of the value: status, least, greatest and mean value, rows, entity-periods, mean and median error, mean coverage.

    A bin is open on the left and closed on the right, so equal values are never split; the first holds the least value. One
    distinct value is one bin, `not_estimable`. Rows without the value are in no bin.
    """
    known = rows.withColumn(value, finite_or_null(value)).where(F.col(value).isNotNull())
    binned = known.join(F.broadcast(quantile_edges(known, value, bins)))  # one row
    at = F.greatest(F.lit(1), F.size(F.filter("edges", lambda e: e < F.col(value))))
    binned = binned.withColumn("confidence_bin", F.when(F.col("distinct_values") == 1, 1).otherwise(at).cast("int"))
    out = binned.groupBy("confidence_bin").agg(
        F.when(F.max("distinct_values") == 1, "not_estimable").otherwise("estimated").alias("calibration_status"),
        F.min(value).alias("confidence_min"),
        F.max(value).alias("confidence_max"),
        F.avg(value).alias("mean_confidence"),
        F.count(F.lit(1)).alias("n_model_rows"),
        F.avg(error).alias("mean_rank_error"),
        F.avg(coverage).alias("mean_feature_coverage"),
    )
    pairs = binned.select("confidence_bin", entity, period).distinct().groupBy("confidence_bin").agg(F.count(F.lit(1)).alias("n_entity_periods"))
    middle = group_quantiles(binned.select("confidence_bin", F.col(error).alias("__e")), ["confidence_bin"], "__e", {"median_rank_error": 0.5}).drop("n")
    return out.join(pairs, "confidence_bin", "left").join(middle, "confidence_bin", "left")


def classification_report(rows: DataFrame, by: Sequence[str], keys: Sequence[str], label: str = "label", probability: str = "probability", threshold: float = 0.5) -> DataFrame:
    """(by, n, positives, accuracy, precision, recall, f1, auc, tn, fp, fn, tp, mean_predicted, mean_actual, calibration_gap).

    Rows need label (0 or 1) and probability. Precision, recall and F1 are 0 where they have no denominator. The area under the curve is
    that of Mann and Whitney, from average ranks over both classes; null with one class.
    """
    by = list(by)
    held = rows.select(*by, *[k for k in keys if k not in by], F.col(label).cast("double").alias("y"), finite_or_null(probability).alias("p")).where("y IS NOT NULL AND p IS NOT NULL")
    held = rank_within(held, list(dict.fromkeys([*by, *keys])), by, {"rank": ("p", average_rank)})
    said, is_ = F.col("p") >= threshold, F.col("y") == 1
    cells = {"tn": ~said & ~is_, "fp": said & ~is_, "fn": ~said & is_, "tp": said & is_}
    out = held.groupBy(*by).agg(
        F.count(F.lit(1)).alias("n"), F.count_if(is_).alias("positives"), F.sum(F.when(is_, F.col("rank"))).alias("__r"), F.avg("p").alias("mean_predicted"), F.avg("y").alias("mean_actual"),
        *[F.count_if(c).alias(k) for k, c in cells.items()],
    )
    share = lambda a, b: F.coalesce(F.try_divide(a, b), F.lit(0.0))
    tp, fp, fn, pos, neg = F.col("tp"), F.col("fp"), F.col("fn"), F.col("positives"), F.col("n") - F.col("positives")
    return out.select(
        *by, "n", "positives",
        ((tp + F.col("tn")) / F.col("n")).alias("accuracy"),
        share(tp, tp + fp).alias("precision"),
        share(tp, tp + fn).alias("recall"),
        share(2 * tp, 2 * tp + fp + fn).alias("f1"),
        F.try_divide(F.col("__r") - pos * (pos + 1) / 2, pos * neg).alias("auc"),
        "tn", "fp", "fn", "tp", "mean_predicted", "mean_actual",
        F.abs(F.col("mean_predicted") - F.col("mean_actual")).alias("calibration_gap"),
    )


def topk_agreement(ranks: DataFrame, k: int = 10, run: str = "run", entity: str = "entity", rank: str = "rank", by: Sequence[str] = ()) -> DataFrame:
    """(by, run, previous_run, overlap_at_k, rank_stability) of each run with the one before it, on ranks 1..k.

    Overlap is the common entities over the smaller of the two lists; stability one less the mean rank difference of common entities over k,
    0 at least, null without any.
    """
    by = list(by)
    top = ranks.where(F.col(rank) <= k).select(*by, F.col(run).alias("run"), F.col(entity).alias("e"), F.col(rank).alias("r"))
    runs = top.groupBy(*by, "run").agg(F.count(F.lit(1)).alias("size"))
    pairs = runs.join(runs.select(*by, F.col("run").alias("__p"), F.col("size").alias("psize")), by) if by else runs.crossJoin(runs.select(F.col("run").alias("__p"), F.col("size").alias("psize")))
    # one row a run: its predecessor is the largest smaller one
    before = pairs.where(F.col("__p") < F.col("run")).groupBy(*by, "run", "size").agg(F.max(F.struct("__p", "psize")).alias("b"))
    before = before.select(*by, "run", "size", F.col("b.__p").alias("previous_run"), F.col("b.psize").alias("psize"))
    old = top.select(*by, F.col("run").alias("previous_run"), "e", F.col("r").alias("old"))
    common = top.join(before, [*by, "run"]).join(old, [*by, "previous_run", "e"]).groupBy(*by, "run").agg(F.count(F.lit(1)).alias("common"), F.avg(F.abs(F.col("r") - F.col("old"))).alias("gap"))
    out = before.join(common, [*by, "run"], "left")
    stability = F.when(F.col("gap").isNotNull(), F.greatest(F.lit(0.0), 1 - F.col("gap") / k))
    return out.select(*by, "run", "previous_run", (F.coalesce("common", F.lit(0)) / F.least("size", "psize")).alias("overlap_at_k"), stability.alias("rank_stability"))


def backtest_diagnostics(board: DataFrame) -> DataFrame:
    """(split, baseline_spearman, best_ml_spearman, ml_beats_baseline, mean_spearman, consistent, weak_backtest); split is null for the whole.

    board: (split, kind, spearman), kind `baseline` or `ml`. The whole is weak where the mean is missing, not above 0, under 0.15 in size, or a split's best
    model does not beat its baselines' mean.
    """
    of = lambda kind: F.when(F.col("kind") == kind, F.col("spearman"))
    each = board.groupBy("split").agg(F.avg(of("baseline")).alias("baseline_spearman"), F.max(of("ml")).alias("best_ml_spearman"))
    each = each.withColumn("ml_beats_baseline", F.coalesce(F.col("best_ml_spearman") > F.col("baseline_spearman"), F.lit(False)))
    whole = each.agg(F.coalesce(F.bool_and("ml_beats_baseline"), F.lit(False)).alias("consistent"), F.lit(1).alias("__one")).join(board.agg(F.avg("spearman").alias("mean_spearman"), F.lit(1).alias("__one")), "__one")
    weak = F.col("mean_spearman").isNull() | (F.abs("mean_spearman") < 0.15) | (F.col("mean_spearman") <= 0) | ~F.col("consistent")
    none = lambda kind: F.lit(None).cast(kind)
    total = whole.select(none(dict(each.dtypes)["split"]).alias("split"), none("double").alias("baseline_spearman"), none("double").alias("best_ml_spearman"), none("boolean").alias("ml_beats_baseline"), "mean_spearman", "consistent", weak.alias("weak_backtest"))
    return each.withColumns({"mean_spearman": none("double"), "consistent": none("boolean"), "weak_backtest": none("boolean")}).unionByName(total)


def feature_stability(rows: DataFrame, cols: Sequence[str], keys: Sequence[str], by: Sequence[str] = ("split",), target: str = "target", least: int = 5) -> DataFrame:
    """(feature, mean_abs_spearman, std_abs_spearman, splits_observed): rank correlation of each column with the target in every split's training rows."""
    pairs = [F.struct(F.lit(c).alias("feature"), finite_or_null(c).alias("x")) for c in cols]
    long = rows.select(*by, *keys, finite_or_null(target).alias("y"), F.explode(F.array(*pairs)).alias("p")).select(*by, *keys, "y", "p.*").where("x IS NOT NULL AND y IS NOT NULL")
    group = [*by, "feature"]
    ranked = rank_within(long, [*group, *keys], group, {"rx": ("x", average_rank), "ry": ("y", average_rank)})
    each = ranked.groupBy(*group).agg(F.abs(guarded_corr("rx", "ry", least)).alias("r"))
    return each.groupBy("feature").agg(F.avg("r").alias("mean_abs_spearman"), F.coalesce(F.stddev_samp("r"), F.lit(0.0)).alias("std_abs_spearman"), F.count("r").alias("splits_observed"))


def coverage_impact(df: DataFrame, cols: Sequence[str], target: str = "target") -> DataFrame:
    """(coverage_bucket, n, mean_target, median_target) for rows with up to half, up to 80 %, and more of the columns."""
    share: Column = sum((finite_or_null(c).isNotNull().cast("int") for c in cols), F.lit(0)) / len(cols)
    bucket = F.when(share <= 0.5, "low").when(share <= 0.8, "medium").otherwise("high")
    rows = df.select(bucket.alias("coverage_bucket"), finite_or_null(target).alias("__t")).where("__t IS NOT NULL")
    middle = group_quantiles(rows, ["coverage_bucket"], "__t", {"median_target": 0.5}).drop("n")
    return rows.groupBy("coverage_bucket").agg(F.count(F.lit(1)).alias("n"), F.avg("__t").alias("mean_target")).join(middle, "coverage_bucket")
