"""Cross-sectional scores, peer statistics, learned weights, reports per entity."""

from __future__ import annotations

from collections.abc import Mapping, Sequence
from dataclasses import dataclass
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window as W

from strataloom.functions.numbers import as_col, clamp, count_nonnull, finite_or_null, guarded_corr, row_mean
from strataloom.operators.ranking import (
    group_order_stats,
    group_quantiles,
    long_values,
    min_rank_desc,
    midrank,
    ordinal,
    pct_average,
    rank_input,
    rank_within,
    share_below,
    share_below_others,
    tally,
    tally_ranks,
    with_group_stats,
)


@dataclass(frozen=True)
class Feature:
    """One scored feature. ``direction`` is 'higher' or 'lower'."""

    name: str
    category: str
    direction: str = "higher"
    positive_only: bool = False


# ---- percentiles and category scores -----------------------------------------------------------------


def directional_pct(df: DataFrame, keys: Sequence[str], by: Sequence[str], features: Sequence[Feature], suffix: str = "__dp") -> DataFrame:
    """Percentile where more is better; positive-only features ignore values <= 0."""
    src = df.withColumns(
        {f"__s_{f.name}": F.when(F.col(f.name) > 0, F.col(f.name)) if f.positive_only else F.col(f.name) for f in features}
    )
    out = rank_within(src, keys, by, {f"{f.name}{suffix}": (f"__s_{f.name}", pct_average) for f in features})
    flip = {f"{f.name}{suffix}": 1 - F.col(f"{f.name}{suffix}") for f in features if f.direction == "lower"}
    return out.withColumns(flip).drop(*[f"__s_{f.name}" for f in features]) if flip else out.drop(*[f"__s_{f.name}" for f in features])


def category_scores(df: DataFrame, features: Sequence[Feature], suffix: str = "__dp") -> DataFrame:
    """``cat_<c>`` means of available percentiles, their mean ``score`` and the ``missingness`` share."""
    cats = list(dict.fromkeys(f.category for f in features))
    named = {f"cat_{c}": row_mean([f"{f.name}{suffix}" for f in features if f.category == c]) for c in cats}
    out = df.withColumns(named)
    have = count_nonnull([f"{f.name}{suffix}" for f in features])
    return out.withColumns({"score": row_mean(list(named)), "missingness": 1 - have / F.lit(len(features))})


def score_period(
    df: DataFrame,
    entity: str,
    period: str,
    features: Sequence[Feature],
    market: Sequence[Feature],
    outcome: str,
) -> DataFrame:
    """Fundamental score, market score and their min ranks from the top, per period."""
    keys = [entity, period]
    out = category_scores(directional_pct(df, keys, [period], [*features, *market]), features)
    out = out.withColumns(
        {
            "fundamental_score": rank_input(F.col("score") * 100, 6),
            "market_score": row_mean([f"{m.name}__dp" for m in market]) * 100 if market else F.lit(None).cast("double"),
        }
    )
    ranks = rank_within(
        out, keys, [period], {"score_rank": ("fundamental_score", min_rank_desc), "return_rank": (outcome, min_rank_desc)}
    )
    return ranks.withColumns({c: F.col(c).cast("bigint") for c in ("score_rank", "return_rank")})


def explain(df: DataFrame, entity: str, period: str, features: Sequence[Feature], suffix: str = "__dp") -> DataFrame:
    """Long (entity, period, category, feature, percentile, raw) of directional percentiles."""
    items = [
        F.struct(
            F.lit(f.category).alias("category"),
            F.lit(f.name).alias("feature"),
            (F.col(f"{f.name}{suffix}") * 100).alias("percentile"),
            F.col(f.name).cast("double").alias("raw"),
        )
        for f in features
    ]
    return df.select(entity, period, F.explode(F.array(*items)).alias("x")).select(entity, period, "x.*")


def pct_below(df: DataFrame, keys: Sequence[str], by: Sequence[str], cols: Sequence[str], others: bool = False) -> DataFrame:
    """Share strictly below: x100 over n, or over n-1 (0.5 when alone) with ``others``."""
    rule = share_below_others if others else share_below
    return rank_within(df, keys, by, {f"{c}__below": (c, rule) for c in cols})


def midrank_fill(df: DataFrame, keys: Sequence[str], by: Sequence[str], cols: Sequence[str]) -> DataFrame:
    """``<c>__mid`` in [0, 1] with 0.5 for missing values; ``<c>__seen`` keeps what was observed."""
    out = rank_within(df, keys, by, {f"{c}__mid": (c, midrank) for c in cols})
    filled = {f"{c}__mid": F.coalesce(f"{c}__mid", F.lit(0.5)) for c in cols}
    return out.withColumns({**filled, **{f"{c}__seen": F.col(c).isNotNull() for c in cols}})


def minmax(df: DataFrame, by: Sequence[str], cols: Sequence[str], flat: float | None = None) -> DataFrame:
    """``<c>__mm`` = (v - min) / span. A zero span counts as 1, or gives ``flat`` for every value."""
    lo, hi = {c: f"__lo_{c}" for c in cols}, {c: f"__hi_{c}" for c in cols}
    out = with_group_stats(df, by, *[F.min(c).alias(lo[c]) for c in cols], *[F.max(c).alias(hi[c]) for c in cols])

    def scaled(c: str) -> Column:
        span = F.col(hi[c]) - F.col(lo[c])
        v = F.col(c) - F.col(lo[c])
        if flat is None:
            return v / F.when(span == 0, F.lit(1.0)).otherwise(span)
        return F.when(F.col(c).isNotNull(), F.when(span <= 1e-12, F.lit(flat)).otherwise(F.try_divide(v, span)))

    return out.withColumns({f"{c}__mm": scaled(c) for c in cols}).drop(*lo.values(), *hi.values())


def zscore(df: DataFrame, by: Sequence[str], cols: Sequence[str]) -> DataFrame:
    """``<c>__z`` with the population deviation; 0 where the group does not vary."""
    out = with_group_stats(
        df, by, *[F.avg(c).alias(f"__m_{c}") for c in cols], *[F.stddev_pop(c).alias(f"__d_{c}") for c in cols]
    )
    z = {
        f"{c}__z": F.when(F.col(f"__d_{c}") == 0, F.when(F.col(c).isNotNull(), F.lit(0.0))).otherwise(
            F.try_divide(F.col(c) - F.col(f"__m_{c}"), F.col(f"__d_{c}"))
        )
        for c in cols
    }
    return out.withColumns(z).drop(*[f"__m_{c}" for c in cols], *[f"__d_{c}" for c in cols])


# ---- peer groups -------------------------------------------------------------------------------------


def group_benchmarks(long: DataFrame, by: Sequence[str], value: str) -> DataFrame:
    """Mean, population deviation, median, p25 = sorted[floor(.25 n)], p75 = sorted[floor(.75 n)], n per group."""
    rows = long.where(F.col(value).isNotNull())
    moments = rows.groupBy(*by).agg(F.avg(value).alias("mean_value"), F.stddev_pop(value).alias("std_value"))
    mid = group_quantiles(rows, by, value, {"median_value": 0.5}).drop("n")
    edges = group_order_stats(rows, by, value, {"p25": 0.25, "p75": 0.75}).withColumnRenamed("n", "sample_count")
    return moments.join(mid, list(by)).join(edges, list(by))


def group_normalise(long: DataFrame, keys: Sequence[str], by: Sequence[str], value: str, min_peers: int = 2) -> DataFrame:
    """z-score and strict-below percentage against the peers of a group."""
    out = rank_within(long, keys, by, {"percentile_rank": (value, share_below)})
    out = with_group_stats(
        out, by, F.avg(value).alias("__m"), F.stddev_pop(value).alias("__d"), F.count(value).alias("__n")
    )
    enough = F.col("__n") >= min_peers
    z = F.when(enough & (F.col("__d") > 0), F.try_divide(F.col(value) - F.col("__m"), F.col("__d")))
    return out.withColumns({"z_score": z, "percentile_rank": F.when(enough, F.col("percentile_rank"))}).drop("__m", "__d", "__n")


def mean_impute(df: DataFrame, by: Sequence[str], cols: Sequence[str]) -> DataFrame:
    out = with_group_stats(df, by, *[F.avg(c).alias(f"__m_{c}") for c in cols])
    return out.withColumns({c: F.coalesce(c, f"__m_{c}") for c in cols}).drop(*[f"__m_{c}" for c in cols])


def heatmap(df: DataFrame, by: Sequence[str], cols: Sequence[str]) -> DataFrame:
    """Mean, observed and missing counts per (group, feature); NaN and infinities are missing."""
    long = long_values(df, by, cols).withColumn("value", finite_or_null("value"))
    return long.groupBy(*by, "feature").agg(
        F.avg("value").alias("value"),
        F.count("value").alias("n_observed"),
        F.count_if(F.col("value").isNull()).alias("n_missing"),
    )


# ---- rule score --------------------------------------------------------------------------------------

# Weight and the two band edges of the scored metrics (current_ratio has its own bands).
RULE_WEIGHTS = {
    "roa": 15, "roe": 15, "operating_margin": 10, "net_margin": 5,
    "current_ratio": 10, "quick_ratio": 5, "cash_ratio": 5,
    "debt_to_equity": 10, "debt_to_assets": 5,
    "ocf_to_debt": 10, "ocf_to_assets": 5, "cash_flow_margin": 5,
}
RULE_BANDS = {
    "roa": (0.05, 0.10, "higher"), "roe": (0.08, 0.15, "higher"),
    "operating_margin": (0.10, 0.20, "higher"), "net_margin": (0.05, 0.12, "higher"),
    "quick_ratio": (0.8, 1.5, "higher"), "cash_ratio": (0.2, 0.5, "higher"),
    "debt_to_equity": (0.5, 1.5, "lower"), "debt_to_assets": (0.3, 0.6, "lower"),
    "ocf_to_debt": (0.15, 0.25, "higher"), "ocf_to_assets": (0.05, 0.15, "higher"),
    "cash_flow_margin": (0.08, 0.18, "higher"),
}
# Metric families.
METRIC_CATEGORIES = {
    "profitability": ["roa", "roe", "operating_margin", "net_margin"],
    "liquidity": ["current_ratio", "quick_ratio", "cash_ratio"],
    "leverage": ["debt_to_equity", "debt_to_assets"],
    "cash_flow": ["ocf_to_debt", "ocf_to_assets", "cash_flow_margin"],
}


def rule_points(metric: str, cur: str | Column, prev: str | Column, weight: float) -> Column:
    """Banded points of one metric with the trend adjustment; null for a missing metric."""
    v, p, w = as_col(cur), as_col(prev), float(weight)
    if metric == "current_ratio":
        base = (
            F.when(v.between(1.5, 3.0), w)
            .when(((v >= 1.2) & (v < 1.5)) | ((v > 3.0) & (v <= 4.0)), w * 0.60)
            .when((v >= 1.0) & (v < 1.2), w * 0.25)
            .when(v > 4.0, w * 0.45)
            .otherwise(0.0)
        )
        pts = F.when(F.abs(v - 2.0) < F.abs(p - 2.0), F.least(base + w * 0.15, F.lit(w))).otherwise(base)
        return F.when(v.isNotNull(), pts)
    low, high, way = RULE_BANDS[metric]
    if way == "higher":
        base = F.when(v >= high, w).when(v >= low, w * 0.65).when(v > 0, w * 0.30).otherwise(0.0)
        better, worse = v > p, v < p
    else:
        base = F.when(v <= low, w).when(v <= high, w * 0.60).otherwise(0.0)
        better, worse = v < p, v > p
    pts = (
        F.when(better, F.least(base + w * 0.20, F.lit(w))).when(worse, F.greatest(base - w * 0.20, F.lit(0.0))).otherwise(base)
    )
    return F.when(v.isNotNull(), pts)


def rule_score(df: DataFrame, weights: Mapping[str, float] = RULE_WEIGHTS, prev_suffix: str = "_lag") -> DataFrame:
    """``<m>__pts`` per metric and ``total_score`` over the available weight (0 without any metric)."""
    out = df.withColumns({f"{m}__pts": rule_points(m, m, f"{m}{prev_suffix}", w) for m, w in weights.items()})
    pts = sum((F.coalesce(f"{m}__pts", F.lit(0.0)) for m in weights), F.lit(0.0))
    avail = sum((F.when(F.col(f"{m}__pts").isNotNull(), float(w)).otherwise(0.0) for m, w in weights.items()), F.lit(0.0))
    return out.withColumn("total_score", F.coalesce(F.try_divide(pts, avail) * 100, F.lit(0.0)))


def rule_details(scored: DataFrame, keys: Sequence[str], weights: Mapping[str, float] = RULE_WEIGHTS) -> DataFrame:
    """Long (keys, metric, category, value, weight, contribution) of a rule score."""
    family = {m: c for c, ms in METRIC_CATEGORIES.items() for m in ms}
    items = [
        F.struct(
            F.lit(m).alias("metric"),
            F.lit(family[m]).alias("category"),
            F.col(m).alias("metric_value"),
            F.lit(float(w)).alias("weight"),
            F.col(f"{m}__pts").alias("contribution"),
        )
        for m, w in weights.items()
    ]
    return scored.select(*keys, "total_score", F.explode(F.array(*items)).alias("x")).select(*keys, "total_score", "x.*")


def sector_blend(details: DataFrame, norm: DataFrame, keys: Sequence[str]) -> DataFrame:
    """0.7 points + 0.3 sector percentile x weight, clamped, rescored over the blended metrics.

    norm: keys, metric, percentile_rank in 0..100.
    """
    j = details.join(norm, [*keys, "metric"]).where("contribution is not null and percentile_rank is not null")
    pct = clamp(F.col("percentile_rank") / 100, 0.0, 1.0)
    own = F.least(F.greatest(F.col("contribution"), F.lit(0.0)), F.col("weight"))
    blended = F.least(F.greatest(0.7 * own + 0.3 * pct * F.col("weight"), F.lit(0.0)), F.col("weight"))
    return j.groupBy(*keys).agg((F.try_divide(F.sum(blended), F.sum("weight")) * 100).alias("blended_score"))


def driver_summary(details: DataFrame, keys: Sequence[str], target: float = 70.0) -> DataFrame:
    """Per key: family shares, up to three strongest and weakest drivers, completeness, counterfactual gap."""
    c = F.coalesce("contribution", F.lit(0.0))
    fam = lambda name: F.try_divide(
        F.sum(F.when(F.col("category") == name, c)), F.sum(F.when(F.col("category") == name, F.col("weight")))
    ) * 100
    ranked = lambda way, cond: F.array_join(
        F.transform(
            F.slice(F.array_sort(F.collect_list(F.when(cond, F.struct((way * c).alias("k"), F.col("metric"))))), 1, 3),
            lambda x: x["metric"],
        ),
        ",",
    )
    headroom = F.col("weight") - c
    gap = F.lit(target) - F.col("total_score")
    reachable = (
        F.col("metric_value").isNotNull() & (headroom >= 0.2 * F.col("weight")) & (gap > 0) & (gap <= headroom * 1.5)
    )
    return details.groupBy(*keys).agg(
        *[fam(n).alias(f"{n}_pct") for n in METRIC_CATEGORIES],
        ranked(-1, c >= 0.6 * F.col("weight")).alias("strongest"),
        ranked(1, c < 0.3 * F.col("weight")).alias("weakest"),
        (F.count("metric_value") / F.count(F.lit(1))).alias("completeness"),
        F.count_if(reachable).alias("counterfactuals"),
        F.max(F.when(reachable, gap)).alias("gap_to_band"),
    )


# ---- weighted scores and learned weights ----------------------------------------------------------------

RISK_FACTORS = {"low": 0.90, "medium": 1.0, "high": 1.10}
SECTOR_RISK_FACTORS = {"low": 0.85, "medium": 1.0, "high": 1.15}


def weighted_score(df: DataFrame, entity: str, period: str, weights: Mapping[str, float], risk: str = "medium") -> DataFrame:
    """Σ w·percentile / Σ w x risk factor in [0, 1], confidence, ordinal rank, top five contributions."""
    keys = [entity, period]
    cols = sorted(weights)
    total_w = sum(weights.values()) or 1.0
    pct_two = lambda below, ties, n: F.when(n >= 2, pct_average(below, ties, n))
    out = rank_within(df, keys, [period], {f"{c}__pct": (c, pct_two) for c in cols})
    total = sum((F.coalesce(F.col(f"{c}__pct") * weights[c], F.lit(0.0)) for c in cols), F.lit(0.0))
    items = F.array_compact(
        F.array(
            *[
                F.when(F.col(f"{c}__pct").isNotNull(), F.struct((-F.round(F.col(f"{c}__pct") * weights[c], 9)).alias("k"), F.lit(c).alias("name")))
                for c in cols
            ]
        )
    )
    top = F.array_join(F.transform(F.slice(F.array_sort(items), 1, 5), lambda x: x["name"]), ",")
    conf = count_nonnull([f"{c}__pct" for c in cols]) / F.lit(max(1, len(cols)))
    out = out.withColumns(
        {
            "score": F.round(clamp(total / F.lit(total_w) * RISK_FACTORS[risk], 0.0, 1.0), 4),
            "confidence": conf,
            "confidence_label": confidence_label(conf),
            "top_parameters": top,
        }
    )
    return ordinal(out, [period], "score", entity, "rank")


def winner_weights(df: DataFrame, period: str, target: str, features: Sequence[str], q: float = 0.75, top_n: int = 12) -> DataFrame:
    """Feature weights from winners (at or above the period's q quantile of the target) against all rows."""
    rows = df.where(F.col(target).isNotNull())
    edge = group_quantiles(rows, [period], target, {"__edge": q}).drop("n")
    rows = rows.join(edge, period).withColumn("__win", F.col(target) >= F.col("__edge"))
    long = long_values(rows, ["__win"], features)
    win = F.col("__win")
    s = long.groupBy("feature").agg(
        F.avg(F.when(win, F.col("value"))).alias("winner_mean"),
        F.avg("value").alias("overall_mean"),
        F.stddev_samp("value").alias("__sd"),
        F.count(F.when(win, F.col("value"))).alias("n_winners"),
        F.count("value").alias("n_values"),
        F.count_if(win).alias("__w"),
    )
    sd = F.coalesce(F.nullif(F.col("__sd"), F.lit(0.0)), F.lit(1.0))
    raw = F.abs((F.col("winner_mean") - F.col("overall_mean")) / sd) * F.col("n_winners") / F.col("__w")
    enough = (F.col("n_winners") >= 3) & (F.col("n_values") >= 5)
    s = s.withColumn("raw_score", F.when(enough, raw).otherwise(0.0))
    # one row per feature from here on: bounded by the column count
    scaled = s.withColumn("weight", F.round(F.try_divide("raw_score", F.max("raw_score").over(W.partitionBy(F.lit(1)))), 4))
    out = scaled.withColumn("rank", F.row_number().over(W.partitionBy(F.lit(1)).orderBy(F.desc("weight"), "feature")))
    return out.where(F.col("rank") <= top_n).drop("__sd", "__w")


LEARNING_RATE = 0.35
MIN_SAMPLES = 5


def category_strength(df: DataFrame, entity: str, period: str, lower_better: Sequence[str] = ("leverage",)) -> DataFrame:
    """``<category>`` mean of share-below-others ranks of the available metrics (inverted for leverage)."""
    metrics = [m for ms in METRIC_CATEGORIES.values() for m in ms]
    two = lambda below, ties, n: F.when(n >= 2, share_below_others(below, ties, n))
    out = rank_within(df, [entity, period], [period], {f"{m}__r": (m, two) for m in metrics})
    oriented = lambda cat, m: 1 - F.col(f"{m}__r") if cat in lower_better else F.col(f"{m}__r")
    return out.withColumns({cat: row_mean([oriented(cat, m) for m in ms]) for cat, ms in METRIC_CATEGORIES.items()})


def category_multipliers(strength: DataFrame, ret: str) -> DataFrame:
    """(category, correlation, samples, multiplier) of category strength with the realised return."""
    long = long_values(strength.where(F.col(ret).isNotNull()), [ret], list(METRIC_CATEGORIES))
    n = F.count("value")
    corr = F.coalesce(clamp(guarded_corr("value", ret), -1.0, 1.0), F.lit(0.0))
    out = long.groupBy("feature").agg(F.when(n >= MIN_SAMPLES, corr).otherwise(0.0).alias("correlation"), n.alias("samples"))
    return out.select(
        F.col("feature").alias("category"),
        "correlation",
        "samples",
        F.round(1 + LEARNING_RATE * F.col("correlation"), 4).alias("multiplier"),
    )


def dominant_category(strength: DataFrame, sector: str, ret: str, entity: str, period: str) -> DataFrame:
    """Per sector the category in which its top-quartile rows are strongest, with their number.

    Rows are ordered by return over the whole sector, whatever its size.
    """
    rows = strength.where(F.col(ret).isNotNull() & F.col(sector).isNotNull())
    rows = rows.withColumn("__row", F.struct(entity, period))
    placed = ordinal(rows, [sector], ret, "__row", "__pos")
    placed = with_group_stats(placed, [sector], F.count(F.lit(1)).alias("__n"))
    best = placed.where((F.col("__n") >= 3) & (F.col("__pos") <= F.greatest(F.lit(1), F.floor(F.col("__n") / 4))))
    long = long_values(best, [sector], list(METRIC_CATEGORIES))
    mean = long.groupBy(sector, "feature").agg(F.round(F.avg("value"), 3).alias("strength"), F.count(F.lit(1)).alias("n_top"))
    first = list(METRIC_CATEGORIES)
    pos = F.array_position(F.array(*[F.lit(c) for c in first]), F.col("feature"))
    best_of = F.max_by(F.struct("feature", "strength", "n_top"), F.struct(F.col("strength"), -pos))
    return mean.groupBy(sector).agg(best_of.alias("b")).select(
        sector, F.col("b.feature").alias("dominant_category"), F.col("b.strength").alias("strength"), F.col("b.n_top").alias("top_rows")
    )


def adaptive_weights(mult: DataFrame, base: Mapping[str, float], boost: str | None = None) -> DataFrame:
    """(metric, category, weight): base weight x category multiplier, rescaled to the base total.

    ``mult`` has one row per category. ``boost`` raises one category by 10 % and rescales again.
    """
    pairs = [F.struct(F.lit(m).alias("metric"), F.lit(float(base[m])).alias("base")) for ms in METRIC_CATEGORIES.values() for m in ms if m in base]
    family = F.create_map(*[F.lit(x) for c, ms in METRIC_CATEGORIES.items() for m in ms for x in (m, c)])
    rows = mult.groupBy().agg(F.map_from_entries(F.collect_list(F.struct("category", "multiplier"))).alias("m"))
    rows = rows.select("m", F.explode(F.array(*pairs)).alias("p")).select("m", "p.*")
    rows = rows.withColumn("category", family[F.col("metric")])
    every = W.partitionBy(F.lit(1))
    rows = rows.withColumn("w0", F.col("base") * F.coalesce(F.try_element_at("m", F.col("category")), F.lit(1.0)))
    rows = rows.withColumn("weight", F.round(F.col("w0") * F.sum("base").over(every) / F.sum("w0").over(every), 4))
    if boost:
        rows = rows.withColumn("w1", F.round(F.col("weight") * F.when(F.col("category") == boost, 1.10).otherwise(1.0), 4))
        rows = rows.withColumn("weight", F.round(F.col("w1") * F.sum("base").over(every) / F.sum("w1").over(every), 4)).drop("w1")
    return rows.select("metric", "category", "weight")


def parameter_scores(df: DataFrame, entity: str, period: str, at: int, ratios: Sequence[str]) -> DataFrame:
    """Per ratio: cross-section 1/(1+cv) at one period, mean of per-entity temporal scores, mean positive z."""
    inv_cv = lambda mean, sd: 1 / (1 + F.when(mean != 0, sd / F.abs(mean)).otherwise(sd))
    long = long_values(df, [entity, period], ratios).where("value is not null")
    now = long.where(F.col(period) == at)
    cross = now.groupBy("feature").agg(F.avg("value").alias("m"), F.stddev_pop("value").alias("d"), F.count(F.lit(1)).alias("n"))
    z = now.join(cross, "feature").withColumn(
        "z", F.when(F.col("d") == 0, 0.0).otherwise(F.greatest(F.try_divide(F.col("value") - F.col("m"), F.col("d")), F.lit(0.0)))
    )
    trans = z.groupBy("feature").agg(F.avg("z").alias("transition_score"))
    per_entity = long.groupBy("feature", entity).agg(
        F.avg("value").alias("m"), F.stddev_pop("value").alias("d"), F.count(F.lit(1)).alias("n")
    )
    temporal = per_entity.where("n >= 2").groupBy("feature").agg(F.avg(inv_cv(F.col("m"), F.col("d"))).alias("temporal_score"))
    out = cross.where("n >= 2").withColumn("cross_score", inv_cv(F.col("m"), F.col("d")))
    out = out.join(temporal, "feature", "left").join(trans, "feature", "left")
    return out.select("feature", "cross_score", F.coalesce("temporal_score", F.lit(0.0)).alias("temporal_score"), "transition_score")


def combine_parameter_scores(parts: DataFrame, ensemble: Column | None = None) -> DataFrame:
    ens = F.lit(0.0) if ensemble is None else ensemble
    return parts.withColumn(
        "score",
        F.round(0.30 * F.col("cross_score") + 0.20 * F.col("temporal_score") + 0.10 * F.col("transition_score") + 0.40 * ens, 6),
    )


def top_parameters(scores: DataFrame, by: Sequence[str], n: int) -> DataFrame:
    """First n parameters per group by score, name breaking ties (partial top-k before the shuffle)."""
    w = W.partitionBy(*by).orderBy(F.desc("score"), "feature")
    return scores.withColumn("rank", F.row_number().over(w)).where(F.col("rank") <= n)


def shape_value(v: Column, shape: str, hint: Column | None = None) -> Column:
    """Optional transform of a normalised value in [0, 1]."""
    hint = F.lit(0.0) if hint is None else hint
    return {
        "linear": v,
        "peak": 1 - F.abs(v - 0.5) * 2,
        "bell": F.exp(-F.pow(v - 0.6, 2) / 0.08),
        "convex": F.pow(v, 1.15),
        "momentum": clamp(v * 0.7 + 0.3 * (0.5 + F.tanh(hint / 100) / 2), 0.0, 1.0),
        "trend": clamp(v * 0.65 + 0.35 * (0.5 + F.tanh(hint / 120) / 2), 0.0, 1.0),
    }[shape]


def sector_forecast(
    df: DataFrame,
    entity: str,
    by: Sequence[str],
    weights: Mapping[str, float],
    g1: str,
    g2: str,
    shape: str = "linear",
    risk: str = "medium",
) -> DataFrame:
    """Min-max x weight, shaped, 0..100, with trend from two growth columns, confidence and ordinal rank."""
    cols = list(weights)
    out = minmax(df, by, cols)
    if shape == "momentum":
        hint = F.coalesce(F.col(g1) - F.col(g2), F.lit(0.0))
    elif shape == "trend":
        hint = F.coalesce(row_mean([c for c in ("roe", "roa", "net_margin") if c in df.columns]), F.lit(0.0))
    else:
        hint = None
    part = {c: shape_value(F.col(f"{c}__mm"), shape, hint) * float(weights[c]) for c in cols}
    total = sum((F.coalesce(p, F.lit(0.0)) for p in part.values()), F.lit(0.0))
    score = clamp(total / sum(weights.values()) * 100 * SECTOR_RISK_FACTORS[risk], 0.0, 100.0)
    delta = F.col(g1) - F.col(g2)
    out = out.withColumns(
        {
            "score": F.round(score, 4),
            "confidence": count_nonnull([f"{c}__mm" for c in cols]) / F.lit(len(cols)),
            "trend": F.when(delta > 0, "up").when(delta < 0, "down").otherwise("flat"),
        }
    )
    return ordinal(out.drop(*[f"{c}__mm" for c in cols]), by, "score", entity, "rank")


def portfolio_extremes(scored: DataFrame, holdings: DataFrame, entity: str, by: Sequence[str], score: str = "score", k: int = 3) -> DataFrame:
    """(side, position, ...) of the k weakest and k strongest held entities per group."""
    held = scored.join(holdings.select(entity).distinct(), entity, "left_semi")
    side = lambda name, action, order: (
        held.withColumn("position", F.row_number().over(W.partitionBy(*by).orderBy(order, entity)))
        .where(F.col("position") <= k)
        .withColumns({"side": F.lit(name), "action": F.lit(action)})
    )
    return side("weak", "reduce", F.asc(score)).unionByName(side("strong", "increase", F.desc(score)))


# ---- labels, buckets, reports ---------------------------------------------------------------------------


def signal_label(c: str | Column) -> Column:
    v = as_col(c)
    return F.when(v >= 0.66, "HIGH").when(v >= 0.40, "MEDIUM").when(v.isNotNull(), "LOW")


def confidence_label(c: str | Column) -> Column:
    v = as_col(c)
    return F.when(v >= 0.80, "high").when(v >= 0.50, "medium").when(v.isNotNull(), "low")


LABEL_RULES = ("absolute", "sector_median", "upper_quartile", "risk_adjusted")


def label_distribution(scores: DataFrame, score: str, debt: str, threshold: float) -> DataFrame:
    """Balance of labels under each of ``LABEL_RULES``, one row a rule.

    Median and upper quartile come from one ranked tally, and one conditional aggregate counts all rules.
    """
    rows = scores.where(F.col(score).isNotNull()).select(F.lit(1).alias("__g"), F.col(score).alias("__s"), F.col(debt).alias("__d"))
    ranked = tally_ranks(rows, ["__g"], "__s")
    holds = lambda k: (F.col("below") <= k) & (k < F.col("below") + F.col("ties"))
    at = lambda k: F.max(F.when(holds(k), F.col("__s")))
    half = (F.col("n") - 1) * F.lit(0.5)
    edges = ranked.agg(
        ((at(F.floor(half)) + at(F.ceil(half))) / 2).alias("median_score"), at(F.floor(F.col("n") * F.lit(0.75))).alias("p75_score")
    ).withColumn("__g", F.lit(1))
    s = F.col("__s")
    hits = {
        "absolute": s >= threshold,
        "sector_median": s >= F.col("median_score"),
        "upper_quartile": s >= F.col("p75_score"),
        "risk_adjusted": (s >= threshold) & (F.coalesce("__d", F.lit(1.0)) <= 0.7),
    }
    # the edges are one row whatever the input
    counted = rows.join(F.broadcast(edges), "__g").agg(
        F.count(F.lit(1)).alias("total_rows"),
        F.max("median_score").alias("median_score"),
        F.max("p75_score").alias("p75_score"),
        *[F.count_if(hits[r]).alias(r) for r in LABEL_RULES],
    )
    each = F.explode(F.array(*[F.struct(F.lit(r).alias("rule"), F.col(r).alias("positive_count")) for r in LABEL_RULES]))
    out = counted.select("total_rows", "median_score", "p75_score", each.alias("r")).select("total_rows", "median_score", "p75_score", "r.*")
    rate = F.try_divide("positive_count", "total_rows")
    return out.withColumns(
        {"negative_count": F.col("total_rows") - F.col("positive_count"), "positive_rate": rate, "imbalance_warning": F.abs(rate - 0.5) > 0.35}
    )


def profit_buckets(df: DataFrame, period: str, score: str, ret: str, income: str) -> DataFrame:
    """One of seven buckets per row from the period medians of score and return and the sign of income."""
    s = group_quantiles(df, [period], score, {"__sm": 0.5}).drop("n")
    r = group_quantiles(df, [period], ret, {"__rm": 0.5}).drop("n")
    out = df.join(s, period, "left").join(r, period, "left")
    hs = F.coalesce(F.col(score) >= F.col("__sm"), F.lit(False))
    hr = F.coalesce(F.col(ret) >= F.col("__rm"), F.lit(False))
    profit = F.coalesce(F.col(income) > 0, F.lit(False))
    bucket = (
        F.when(hs & hr & profit, "high_score_profit_strong_return")
        .when(hs & profit & ~hr, "high_score_profit_weak_return")
        .when(~hs & ~hr, "low_score_weak_return")
        .when(~hs & hr, "low_score_strong_return")
        .when(profit & ~hr, "profitable_but_underperformed")
        .when(~profit & hr, "unprofitable_but_outperformed")
        .otherwise("other")
    )
    return out.withColumn("bucket", bucket).drop("__sm", "__rm")


def composite_score(ml: Column, confidence: Column, research: Column, weights: Mapping[str, float]) -> Column:
    """Weighted mean over the components present; a research score outside (0, 1] counts as absent."""
    research = F.when((research > 0) & (research <= 1), research)
    parts = [(ml, weights["ml"]), (confidence, weights["confidence"]), (research, weights["research"])]
    top = sum((F.coalesce(v * w, F.lit(0.0)) for v, w in parts), F.lit(0.0))
    have = sum((F.when(v.isNotNull(), float(w)).otherwise(0.0) for v, w in parts), F.lit(0.0))
    return F.try_divide(top, have)


def shrink_to_neutral(base: Column, confidence: Column) -> Column:
    """0.5 + (base - 0.5) x confidence, base 0.5 when absent."""
    return clamp(0.5 + (F.coalesce(base, F.lit(0.5)) - 0.5) * confidence, 0.0, 1.0)


def outperformers(df: DataFrame, period: str, flag: str, excess: str, entity: str, limit: int, at: int | None = None) -> DataFrame:
    """Best excess rows of the requested (else latest) completed period with the period's counts."""
    done = df.where(F.col(flag).isNotNull())
    if at is None:
        done = done.join(done.agg(F.max(period).alias(period)), period, "left_semi")
    else:
        done = done.where(F.col(period) == at)
    n = done.groupBy(period).agg(F.count_if(F.col(flag)).alias("outperformer_count"), F.count(F.lit(1)).alias("total_in_period"))
    top = done.where(F.col(flag)).orderBy(F.desc(excess), entity).limit(limit)
    return top.join(n, period)


def top_ranked(df: DataFrame, period: str, rank: str, limit: int) -> DataFrame:
    """Best ranks of the latest period."""
    last = df.agg(F.max(period).alias(period))
    return df.join(last, period, "left_semi").orderBy(rank).limit(limit)


def verdict_counts(df: DataFrame, keys: Sequence[str], verdict: str, verdicts: Sequence[str], reason: Column, reasons: Sequence[str]) -> DataFrame:
    """Zero-filled counts over fixed vocabularies and their total; notes never enter."""
    return df.groupBy(*keys).agg(
        *[F.count_if(F.col(verdict) == v).alias(f"verdict_{v}") for v in verdicts],
        *[F.count_if(reason == r).alias(f"reason_{r}") for r in reasons],
        F.count_if(F.col(verdict).isin(*verdicts)).alias("total"),
    )


def extreme_features(df: DataFrame, keys: Sequence[str], cols: Sequence[str], k: int, suffix: str = "__below") -> DataFrame:
    """(keys, side, position, feature, percentile): the k highest and lowest percentiles of a row.

    Rows with fewer than 2k percentiles are left out. Works inside one row's few features.
    """
    items = F.array_compact(
        F.array(*[F.when(F.col(f"{c}{suffix}").isNotNull(), F.struct(F.col(f"{c}{suffix}").alias("p"), F.lit(c).alias("f"))) for c in cols])
    )
    rows = df.withColumn("__i", items).where(F.size("__i") >= 2 * k)
    low = F.slice(F.array_sort("__i"), 1, k)
    high = F.slice(F.array_sort(F.transform("__i", lambda x: F.struct((-x["p"]).alias("p"), x["f"].alias("f")))), 1, k)
    side = lambda name, arr, sign: rows.select(*keys, F.lit(name).alias("side"), F.posexplode(arr).alias("pos", "x")).select(
        *keys, "side", (F.col("pos") + 1).alias("position"), F.col("x.f").alias("feature"), (sign * F.col("x.p")).alias("percentile")
    )
    return side("low", low, 1).unionByName(side("high", high, -1))


def entity_signals(df: DataFrame, entity: str, period: str, cols: Sequence[str], suffix: str = "__below") -> DataFrame:
    """Latest row of each entity in long form: percentile, above/below median, top-8 and bottom-4 flags, missing."""
    last = df.groupBy(entity).agg(F.max(period).alias(period))
    rows = df.join(last, [entity, period], "left_semi")
    items = F.array(*[F.struct(F.lit(c).alias("feature"), F.col(f"{c}{suffix}").alias("percentile"), F.col(c).isNull().alias("missing")) for c in cols])
    long = rows.select(entity, period, F.explode(items).alias("x")).select(entity, period, "x.*")
    have = W.partitionBy(entity, F.col("percentile").isNull())
    n = F.count("percentile").over(have)
    hi = F.row_number().over(have.orderBy(F.desc("percentile"), "feature"))
    lo = F.row_number().over(have.orderBy("percentile", F.desc("feature")))
    known = F.col("percentile").isNotNull()
    return long.withColumns(
        {
            "signal": F.when(known, F.when(F.col("percentile") >= 50, "above_median").otherwise("below_median")),
            "is_top": known & (hi <= 8),
            "is_bottom": known & (n > 4) & (lo <= 4),
        }
    )


def trend_series(df: DataFrame, entity: str, value: object, period: str, cols: Sequence[str]) -> DataFrame:
    return df.where(F.col(entity) == F.lit(value)).select(period, *cols).orderBy(period)


def distinct_filters(tables: Sequence[DataFrame], period: str, group: str) -> DataFrame:
    """(kind, item): distinct periods and groups over several tables."""
    one = lambda t, kind, c: t.select(F.lit(kind).alias("kind"), F.col(c).cast("string").alias("item"))
    parts = [one(t, k, c) for t in tables for k, c in (("period", period), ("group", group))]
    return reduce(DataFrame.unionByName, parts).distinct()


def compare_entities(probs: DataFrame, entity: str, model: str, prob: str, weights: Mapping[str, float]) -> DataFrame:
    """Weighted mean over the models available for an entity, weights renormalised, and how many were missing."""
    w = F.create_map(*[F.lit(x) for k, v in weights.items() for x in (k, float(v))])[F.col(model)]
    seen = probs.where(F.col(prob).isNotNull() & w.isNotNull())
    return seen.groupBy(entity).agg(
        F.try_divide(F.sum(F.col(prob) * w), F.sum(w)).alias("ensemble_prob"),
        F.count(F.lit(1)).alias("n_models"),
        (F.lit(len(weights)) - F.count(F.lit(1))).alias("n_missing_models"),
    )
