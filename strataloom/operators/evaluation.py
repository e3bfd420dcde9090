"""Evaluation of predictions: rank correlation, split metrics, agreement of models, baskets and their costs.

Predictions are rows (entity, period, model, y_true, y_pred), unique by the first three.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window as W

from strataloom.functions.numbers import finite_or_null, guarded_corr
from strataloom.operators.ranking import average_rank, rank_within
from strataloom.session import cut_lineage

MIN_ROWS = 3


def usable(pred: DataFrame) -> DataFrame:
    """Rows with a finite outcome and a finite prediction."""
    rows = pred.withColumns({"y_true": finite_or_null("y_true"), "y_pred": finite_or_null("y_pred")})
    return rows.where("y_true IS NOT NULL AND y_pred IS NOT NULL")


def with_ranks(pred: DataFrame, by: Sequence[str] = ("model", "period"), entity: str = "entity") -> DataFrame:
    """Usable rows with average-tie ranks ``true_rank`` and ``pred_rank`` inside the group."""
    keys = list(dict.fromkeys([entity, *by]))
    return rank_within(usable(pred), keys, by, {"true_rank": ("y_true", average_rank), "pred_rank": ("y_pred", average_rank)})


def spearman_ic(pred: DataFrame, by: Sequence[str] = ("model", "period"), entity: str = "entity") -> DataFrame:
    """(by, n, ic): Pearson correlation of average ranks; null for fewer than three rows or constant ranks."""
    ic = guarded_corr("true_rank", "pred_rank", MIN_ROWS)
    return with_ranks(pred, by, entity).groupBy(*by).agg(F.count(F.lit(1)).alias("n"), ic.alias("ic"))


def pooled_ic(ics: DataFrame, by: Sequence[str] = ("model",)) -> DataFrame:
    """(by, periods, pooled_ic): equal-weight mean of the periods' correlations; null if any is undefined."""
    mean = F.when(F.count("ic") == F.count(F.lit(1)), F.avg("ic"))
    return ics.groupBy(*by).agg(F.count(F.lit(1)).alias("periods"), mean.alias("pooled_ic"))


def split_metrics(pred: DataFrame, k: int = 5, by: Sequence[str] = ("model", "period"), entity: str = "entity") -> DataFrame:
    """Per group of three rows or more: n, mae, rmse, spearman, precision_at_k, top_mean, median_true, directional_acc.

    The first k by prediction and by outcome are taken with the entity ascending inside ties. Direction is
    above or not above the group's median. Medians, sides and the few rows that can be among the first k all follow
    from one ranking.
    """
    by = list(by)
    keys = list(dict.fromkeys([entity, *by]))
    outputs = {}
    for c, tag in (("y_true", "t"), ("y_pred", "p")):
        outputs |= {f"__rank_{tag}": (c, average_rank), f"__below_{tag}": (c, lambda below, ties, n: below), f"__ties_{tag}": (c, lambda below, ties, n: ties)}
    rows = rank_within(usable(pred).select(*keys, "y_true", "y_pred"), keys, by, outputs | {"__n": ("y_true", lambda below, ties, n: n)})
    rows = cut_lineage(rows.where("__n IS NOT NULL"))
    gap = F.col("y_true") - F.col("y_pred")
    mid = F.floor((F.col("__n") - 1) / 2)  # the upper middle row is this one or the next
    held = lambda at: (F.col("__below_t") <= at) & (at < F.col("__below_t") + F.col("__ties_t"))
    same = (F.col("__below_p") > mid) == (F.col("__below_t") > mid)
    out = rows.groupBy(*by).agg(
        F.count(F.lit(1)).alias("n"),
        F.avg(F.abs(gap)).alias("mae"),
        F.sqrt(F.avg(gap * gap)).alias("rmse"),
        guarded_corr("__rank_t", "__rank_p", MIN_ROWS).alias("spearman"),
        F.max(F.when(held(mid), F.col("y_true"))).alias("__low"),
        F.max(F.when(held(F.ceil((F.col("__n") - 1) / 2)), F.col("y_true"))).alias("__high"),
        F.avg(same.cast("int")).alias("directional_acc"),
    )

    def first(value: str, tag: str) -> DataFrame:
        near = rows.where(F.col("__n") - F.col(f"__below_{tag}") - F.col(f"__ties_{tag}") < k)
        spot = F.row_number().over(W.partitionBy(*by).orderBy(F.desc(value), entity))
        return near.withColumn("__at", spot).where(F.col("__at") <= k).select(*keys, "y_true", F.lit(tag == "p").alias("__p"))

    tops = first("y_pred", "p").unionByName(first("y_true", "t"))
    tops = tops.groupBy(*keys).agg(F.first("y_true").alias("y_true"), F.max("__p").alias("__top"), F.min("__p").alias("__only"))
    tops = tops.groupBy(*by).agg((F.count_if(F.col("__top") & ~F.col("__only")) / F.lit(k)).alias("precision_at_k"), F.avg(F.when(F.col("__top"), F.col("y_true"))).alias("top_mean"))
    out = out.where(F.col("n") >= MIN_ROWS).join(tops, by)
    half = (F.col("n") - 1) / 2 - F.floor((F.col("n") - 1) / 2)
    return out.select(*by, "n", "mae", "rmse", "spearman", "precision_at_k", "top_mean", (F.col("__low") + (F.col("__high") - F.col("__low")) * half).alias("median_true"), "directional_acc")


def prediction_ranks(pred: DataFrame) -> DataFrame:
    """(entity, period, model, rank): average rank of every finite prediction in its model and period."""
    rows = pred.select("entity", "period", "model", finite_or_null("y_pred").alias("y_pred"))
    return rank_within(rows, ["entity", "period", "model"], ["model", "period"], {"rank": ("y_pred", average_rank)}).drop("y_pred")


def model_rank_correlation(ranks: DataFrame) -> DataFrame:
    """(period, row_model, column_model, shared, correlation, status) for all ordered pairs of a period's models."""
    left = ranks.select("entity", "period", F.col("model").alias("row_model"), F.col("rank").alias("a"))
    right = ranks.select("entity", "period", F.col("model").alias("column_model"), F.col("rank").alias("b"))
    both = left.join(right, ["entity", "period"]).groupBy("period", "row_model", "column_model")
    out = both.agg(F.count_if(F.col("a").isNotNull() & F.col("b").isNotNull()).alias("shared"), guarded_corr("a", "b", MIN_ROWS).alias("correlation"))
    status = (
        F.when(F.col("shared") < MIN_ROWS, "insufficient_data_fewer_than_3_shared_ranked_tickers")
        .when(F.col("correlation").isNull(), "insufficient_data_constant_or_nonfinite_rank")
        .otherwise("complete")
    )
    return out.withColumn("status", status)


def entity_rank_spread(ranks: DataFrame, models: int) -> DataFrame:
    """(entity, period, ranked_models, rank_spread, rank_iqr, status); spreads only where all ``models`` rank the entity."""
    out = ranks.groupBy("entity", "period").agg(
        F.count("rank").alias("ranked_models"),
        (F.max("rank") - F.min("rank")).alias("rank_spread"),
        F.percentile("rank", F.array(F.lit(0.25), F.lit(0.75))).alias("__q"),
    )
    out = out.select("entity", "period", "ranked_models", "rank_spread", (F.col("__q")[1] - F.col("__q")[0]).alias("rank_iqr"))
    whole = (F.col("ranked_models") == models) & F.lit(models >= 2)
    out = out.withColumns({c: F.when(whole, F.col(c)) for c in ("rank_spread", "rank_iqr")})
    return out.withColumn("status", F.when(whole, "complete").otherwise("insufficient_data_missing_model_rank"))


def topk_basket(pred: DataFrame, k: int) -> DataFrame:
    """Members (model, period, entity, position, y_true) of each basket of the k highest predictions, entity breaking ties.

    Groups with fewer than k finite predictions form no basket.
    """
    rows = pred.withColumns({"y_true": finite_or_null("y_true"), "y_pred": finite_or_null("y_pred")}).where("y_pred IS NOT NULL")
    order = W.partitionBy("model", "period").orderBy(F.desc("y_pred"), "entity")
    picked = rows.withColumn("position", F.row_number().over(order)).where(F.col("position") <= k)
    full = picked.groupBy("model", "period").agg(F.count(F.lit(1)).alias("__n")).where(F.col("__n") == k)
    return picked.join(full, ["model", "period"]).select("model", "period", "entity", "position", "y_true")


def basket_returns(members: DataFrame) -> DataFrame:
    """(model, period, basket_size, gross, missing_realised); gross is null if any member has no outcome."""
    missing = F.count_if(F.col("y_true").isNull())
    return members.groupBy("model", "period").agg(
        F.count(F.lit(1)).alias("basket_size"), F.when(missing == 0, F.avg("y_true")).alias("gross"), missing.alias("missing_realised")
    )


def basket_turnover(members: DataFrame) -> DataFrame:
    """(model, period, turnover): half the absolute change of equal weights since the model's basket before; null for its first."""
    sizes = members.groupBy("model", "period").agg(F.count(F.lit(1)).alias("__n"))
    before = F.lag("period").over(W.partitionBy("model").orderBy("period"))
    sizes = sizes.withColumn("__before", before)
    held = members.join(sizes, ["model", "period"])
    now = held.select("model", "period", "entity", (1 / F.col("__n")).alias("w"))
    after = sizes.select("model", F.col("__before").alias("period"), F.col("period").alias("__next"))
    then = held.join(after, ["model", "period"]).select("model", F.col("__next").alias("period"), "entity", (-1 / F.col("__n")).alias("w"))
    change = now.unionByName(then).groupBy("model", "period", "entity").agg(F.sum("w").alias("w"))
    half = change.groupBy("model", "period").agg((F.sum(F.abs("w")) / 2).alias("turnover"))
    return sizes.join(half, ["model", "period"]).select("model", "period", F.when(F.col("__before").isNotNull(), F.col("turnover")).alias("turnover"))


def cost_scenarios(returns: DataFrame, turnover: DataFrame, bps: Sequence[float]) -> DataFrame:
    """Each basket under each cost in basis points: drag and net in percentage points.

    Both are null without a gross return, and without a turnover unless the cost is zero.
    """
    if any(b < 0 for b in bps):
        raise ValueError("costs must not be negative")
    rows = returns.join(turnover, ["model", "period"]).withColumn("cost_bps", F.explode(F.array(*[F.lit(float(b)) for b in bps])))
    drag = F.when(F.col("gross").isNull(), None).when(F.col("cost_bps") == 0, 0.0).otherwise(F.col("turnover") * F.col("cost_bps") / 100)
    return rows.withColumn("drag", drag).withColumn("net", F.col("gross") - F.col("drag"))


def feature_correlation(df: DataFrame, cols: Sequence[str]) -> DataFrame:
    """(a, b, shared, correlation) of every pair of columns in one aggregate: sums for columns squared, not rows squared."""
    pairs = [(a, b) for i, a in enumerate(cols) for b in cols[i:]]
    both = lambda a, b: F.count_if(F.col(a).isNotNull() & F.col(b).isNotNull())
    row = df.agg(*[F.struct(F.lit(a).alias("a"), F.lit(b).alias("b"), both(a, b).alias("shared"), guarded_corr(a, b).alias("correlation")).alias(f"p{i}") for i, (a, b) in enumerate(pairs)])
    return row.select(F.explode(F.array(*[f"p{i}" for i in range(len(pairs))])).alias("p")).select("p.*")


BOARD = ["n", "mae", "rmse", "spearman", "precision_at_k", "top_mean", "median_true", "directional_acc"]


def rebuild_leaderboard(pred: DataFrame, stored: DataFrame, k: int = 5, by: Sequence[str] = ("model", "period"), tolerance: float = 1e-6) -> DataFrame:
    """(by, metric, stored, rebuilt, status) of every metric of a stored board and of the rows it came from.

    status: `match` within the tolerance (relative above 1) or both null, `mismatch`, `missing_stored`, `missing_rows`.
    """
    by = list(by)

    def long(df: DataFrame, out: str) -> DataFrame:
        pairs = [F.struct(F.lit(c).alias("metric"), F.col(c).cast("double").alias(out)) for c in BOARD if c in df.columns]
        return df.select(*by, F.explode(F.array(*pairs)).alias("p")).select(*by, "p.*", F.lit(True).alias(f"__{out}"))

    both = long(stored, "stored").join(long(split_metrics(pred, k, by), "rebuilt"), [*by, "metric"], "full")
    near = F.abs(F.col("stored") - F.col("rebuilt")) <= tolerance * F.greatest(F.lit(1.0), F.abs("stored"))
    same = F.col("stored").eqNullSafe(F.col("rebuilt")) | F.coalesce(near, F.lit(False))
    status = F.when(F.col("__stored").isNull(), "missing_stored").when(F.col("__rebuilt").isNull(), "missing_rows").when(same, "match").otherwise("mismatch")
    return both.select(*by, "metric", "stored", "rebuilt", status.alias("status"))


def multi_target(boards: dict[str, DataFrame], value: str = "spearman") -> DataFrame:
    """(model, target, splits, mean, best_model) over boards (model, ..., value) of several targets: each model's mean and whether it leads its target."""
    whole = None
    for name, board in boards.items():
        part = board.select(F.lit(name).alias("target"), "model", F.col(value).alias("v"))
        whole = part if whole is None else whole.unionByName(part)
    each = whole.groupBy("target", "model").agg(F.count("v").alias("splits"), F.avg("v").alias("mean"))
    best = each.where("mean IS NOT NULL").groupBy("target").agg(F.min_by("model", F.struct((-F.col("mean")).alias("d"), "model")).alias("__best"))
    return each.join(best, "target", "left").withColumn("best_model", F.coalesce(F.col("model") == F.col("__best"), F.lit(False))).drop("__best")
