"""Queries: cross-sectional ranks, scores, peer statistics, learned weights."""

from pyspark.sql import functions as F

from strataloom.functions import numbers as N
from strataloom.functions import ratios as R
from strataloom.operators import panel as B
from strataloom.operators import ranking as K
from strataloom.operators import score as S
from strataloom.operators import sensitivity as X
from strataloom.plans import panels as P
from strataloom.plans.registry import query, rounded, table

KEYS = ["entity", "period"]


@query(
    "pct_rank_within",
    f"WITH {P.RANKED} SELECT entity, period, " + ", ".join(f"round({c}__pct, 9) AS {c}" for c in P.FEATURES) + " FROM ranked",
)
def _(spark, sf):
    r = P.ranked(spark, sf)
    return r.select("entity", "period", *[F.round(f"{c}__pct", 9).alias(c) for c in P.FEATURES])


REGISTRY = [
    S.Feature("revenue", "size"),
    S.Feature("quantity", "size"),
    S.Feature("discount", "price", "lower", True),
    S.Feature("returned", "quality", "lower"),
]
MARKET = [S.Feature("tax", "market")]

_DP = f"""WITH {P.TARGETS}, s AS (SELECT *, CASE WHEN discount > 0 THEN discount END AS dpos FROM targets),
d AS (SELECT entity, period, revenue, quantity, discount, returned, tax, target, {P.sql_pct('revenue', 'period')} AS rev_dp, {P.sql_pct('quantity', 'period')} AS qty_dp, 1 - ({P.sql_pct('dpos', 'period')}) AS disc_dp,
 1 - ({P.sql_pct('returned', 'period')}) AS ret_dp, {P.sql_pct('tax', 'period')} AS tax_dp FROM s)"""
_CAT = (
    _DP
    + """, c AS (SELECT *, (rev_dp + qty_dp) / 2 AS cat_size, disc_dp AS cat_price, ret_dp AS cat_quality FROM d),
sc AS (SELECT *, (coalesce(cat_size, 0) + coalesce(cat_price, 0) + coalesce(cat_quality, 0)) / nullif(CAST(cat_size IS NOT NULL AS INTEGER) + CAST(cat_price IS NOT NULL AS INTEGER) + CAST(cat_quality IS NOT NULL AS INTEGER), 0) AS score,
 1 - (2 + CAST(disc_dp IS NOT NULL AS INTEGER) + CAST(ret_dp IS NOT NULL AS INTEGER)) / 4.0 AS missingness FROM c),
fs AS (SELECT *, round(score * 100, 6) AS fundamental_score, tax_dp * 100 AS market_score FROM sc)"""
)


@query("directional_percentile", f"{_DP} SELECT entity, period, round(rev_dp, 9) AS revenue__dp, round(disc_dp, 9) AS discount__dp, round(ret_dp, 9) AS returned__dp FROM d")
def _(spark, sf):
    out = S.directional_pct(P.targets(spark, sf), KEYS, ["period"], [REGISTRY[0], REGISTRY[2], REGISTRY[3]])
    return rounded(out.select(*KEYS, "revenue__dp", "discount__dp", "returned__dp"), 9)


@query(
    "category_scores",
    f"{_CAT} SELECT entity, period, round(cat_size, 9) AS cat_size, round(cat_price, 9) AS cat_price, round(cat_quality, 9) AS cat_quality, round(score, 9) AS score, round(missingness, 9) AS missingness FROM fs",
)
def _(spark, sf):
    out = S.category_scores(S.directional_pct(P.targets(spark, sf), KEYS, ["period"], REGISTRY), REGISTRY)
    return rounded(out.select(*KEYS, "cat_size", "cat_price", "cat_quality", "score", "missingness"), 9)


def _scored(spark, sf):
    return S.score_period(P.targets(spark, sf), "entity", "period", REGISTRY, MARKET, "target")


@query(
    "score_period",
    f"""{_CAT} SELECT entity, period, fundamental_score, round(market_score, 6) AS market_score,
 rank() OVER (PARTITION BY period ORDER BY fundamental_score DESC NULLS LAST) AS score_rank,
 CASE WHEN target IS NOT NULL THEN rank() OVER (PARTITION BY period ORDER BY target DESC NULLS LAST) END AS return_rank FROM fs""",
)
def _(spark, sf):
    return rounded(_scored(spark, sf).select(*KEYS, "fundamental_score", "market_score", "score_rank", "return_rank"))


@query(
    "explain_entity",
    f"""{_DP} SELECT entity, period, 'size' AS category, 'revenue' AS feature, round(rev_dp * 100, 6) AS percentile, revenue AS raw FROM d WHERE entity = 3
UNION ALL SELECT entity, period, 'size', 'quantity', round(qty_dp * 100, 6), quantity FROM d WHERE entity = 3
UNION ALL SELECT entity, period, 'price', 'discount', round(disc_dp * 100, 6), round(discount, 6) FROM d WHERE entity = 3
UNION ALL SELECT entity, period, 'quality', 'returned', round(ret_dp * 100, 6), returned FROM d WHERE entity = 3""",
)
def _(spark, sf):
    d = S.directional_pct(P.targets(spark, sf), KEYS, ["period"], REGISTRY)
    return rounded(S.explain(d, "entity", "period", REGISTRY).where("entity = 3"))


@query(
    "strict_below_percentile",
    f"""WITH {P.MONTHS} SELECT entity, period, round((rank() OVER (PARTITION BY period ORDER BY quantity) - 1) * 100.0 / count(*) OVER (PARTITION BY period), 6) AS below,
 round(CASE WHEN returned IS NULL THEN NULL WHEN count(returned) OVER (PARTITION BY period) > 1 THEN (rank() OVER (PARTITION BY period ORDER BY returned NULLS LAST) - 1)::DOUBLE / (count(returned) OVER (PARTITION BY period) - 1) ELSE 0.5 END, 9) AS below_others FROM months""",
)
def _(spark, sf):
    out = K.rank_within(
        P.supplier_month(spark, sf), KEYS, ["period"], {"below": ("quantity", K.share_below), "below_others": ("returned", K.share_below_others)}
    )
    return rounded(out.select(*KEYS, "below", "below_others"), 9).withColumn("below", F.round("below", 6))


@query(
    "midrank_fill",
    f"""WITH {P.MONTHS} SELECT entity, period, round(coalesce(CASE WHEN returned IS NULL THEN NULL WHEN count(returned) OVER (PARTITION BY period) > 1 THEN
 (rank() OVER (PARTITION BY period ORDER BY returned NULLS LAST) - 1 + (count(*) OVER (PARTITION BY period, returned) - 1) / 2.0) / (count(returned) OVER (PARTITION BY period) - 1) ELSE 0.5 END, 0.5), 9) AS returned__mid,
 returned IS NOT NULL AS returned__seen FROM months""",
)
def _(spark, sf):
    out = S.midrank_fill(P.supplier_month(spark, sf), KEYS, ["period"], ["returned"])
    return rounded(out.select(*KEYS, "returned__mid", "returned__seen"), 9)


@query(
    "minmax_normalise",
    f"""WITH {P.MONTHS}, g AS (SELECT period, min(revenue) AS a, max(revenue) AS b, min(returned) AS c, max(returned) AS d FROM months GROUP BY 1)
SELECT entity, period, round((revenue - a) / CASE WHEN b = a THEN 1 ELSE b - a END, 9) AS revenue__mm, round((returned - c) / CASE WHEN d = c THEN 1 ELSE d - c END, 9) AS returned__mm FROM months JOIN g USING (period)""",
)
def _(spark, sf):
    out = S.minmax(P.supplier_month(spark, sf), ["period"], ["revenue", "returned"])
    return rounded(out.select(*KEYS, "revenue__mm", "returned__mm"), 9)


@query(
    "zscore",
    f"""WITH {P.MONTHS}, g AS (SELECT period, avg(revenue) AS m, stddev_pop(revenue) AS d FROM months GROUP BY 1)
SELECT entity, period, round(CASE WHEN d = 0 THEN 0 ELSE (revenue - m) / d END, 6) AS revenue__z FROM months JOIN g USING (period)""",
)
def _(spark, sf):
    return rounded(S.zscore(P.supplier_month(spark, sf), ["period"], ["revenue"]).select(*KEYS, "revenue__z"))


_LONG = f"""WITH {P.YEARS}, {P.SECTORS}, l AS (SELECT entity, sector, period, 'revenue' AS feature, revenue AS value FROM years JOIN sectors USING (entity)
 UNION ALL SELECT entity, sector, period, 'returned', returned FROM years JOIN sectors USING (entity) WHERE returned IS NOT NULL)"""


def _long(spark, sf):
    y = P.supplier_year(spark, sf).join(P.sectors(spark, sf), "entity")
    return K.long_values(y, ["entity", "sector", "period"], ["revenue", "returned"]).where("value is not null")


@query(
    "group_benchmarks",
    f"""{_LONG}, o AS (SELECT *, row_number() OVER w AS rn, count(*) OVER (PARTITION BY sector, period, feature) AS n FROM l WINDOW w AS (PARTITION BY sector, period, feature ORDER BY value))
SELECT sector, period, feature, round(avg(value), 4) AS mean_value, round(stddev_pop(value), 4) AS std_value, round(median(value), 4) AS median_value,
 max(CASE WHEN rn = floor(0.25 * n) + 1 THEN value END) AS p25, max(CASE WHEN rn = floor(0.75 * n) + 1 THEN value END) AS p75, count(*) AS sample_count FROM o GROUP BY 1, 2, 3""",
)
def _(spark, sf):
    return rounded(S.group_benchmarks(_long(spark, sf), ["sector", "period", "feature"], "value"), 4)


@query(
    "group_normalise",
    f"""{_LONG}, g AS (SELECT sector, period, feature, avg(value) AS m, stddev_pop(value) AS d, count(*) AS n FROM l GROUP BY 1, 2, 3)
SELECT entity, sector, period, feature, round(CASE WHEN n >= 2 AND d > 0 THEN (value - m) / d END, 6) AS z_score,
 round(CASE WHEN n >= 2 THEN (rank() OVER (PARTITION BY sector, period, feature ORDER BY value) - 1) * 100.0 / n END, 6) AS percentile_rank FROM l JOIN g USING (sector, period, feature)""",
)
def _(spark, sf):
    out = S.group_normalise(_long(spark, sf), ["entity", "sector", "period", "feature"], ["sector", "period", "feature"], "value")
    return rounded(out.select("entity", "sector", "period", "feature", "z_score", "percentile_rank"))


# ---- rule score -----------------------------------------------------------------------------------------

METRICS = list(R.SCORING_RATIOS)


def _ratios(spark, sf):
    return R.financial_ratios(P.statements(spark, sf))


def _rules(spark, sf):
    r = _ratios(spark, sf)
    r = r.select(*KEYS, *[F.round(m, 9).alias(m) for m in METRICS])
    return S.rule_score(B.lag_columns(r, "entity", "period", METRICS))


_RATIO_CTE = (
    f"{P.STATEMENTS}, ratios AS (SELECT entity, period, "
    + ", ".join(f"round({n} / nullif({d}, 0), 9) AS {k}" for k, (n, d) in R.SCORING_RATIOS.items()).replace("quick_assets", "(current_assets - inventory)")
    + " FROM stmt)"
)


def _points_sql(m: str) -> str:
    w = float(S.RULE_WEIGHTS[m])
    v, p = f"a.{m}", f"b.{m}"
    if m == "current_ratio":
        base = f"CASE WHEN {v} BETWEEN 1.5 AND 3 THEN {w} WHEN ({v} >= 1.2 AND {v} < 1.5) OR ({v} > 3 AND {v} <= 4) THEN {w} * 0.6 WHEN {v} >= 1 AND {v} < 1.2 THEN {w} * 0.25 WHEN {v} > 4 THEN {w} * 0.45 ELSE 0 END"
        pts = f"CASE WHEN abs({v} - 2) < abs({p} - 2) THEN least({base} + {w} * 0.15, {w}) ELSE {base} END"
    else:
        lo, hi, way = S.RULE_BANDS[m]
        if way == "higher":
            base = f"CASE WHEN {v} >= {hi} THEN {w} WHEN {v} >= {lo} THEN {w} * 0.65 WHEN {v} > 0 THEN {w} * 0.3 ELSE 0 END"
            up, down = f"{v} > {p}", f"{v} < {p}"
        else:
            base = f"CASE WHEN {v} <= {lo} THEN {w} WHEN {v} <= {hi} THEN {w} * 0.6 ELSE 0 END"
            up, down = f"{v} < {p}", f"{v} > {p}"
        pts = f"CASE WHEN {up} THEN least({base} + {w} * 0.2, {w}) WHEN {down} THEN greatest({base} - {w} * 0.2, 0) ELSE {base} END"
    return f"CAST(CASE WHEN {v} IS NOT NULL THEN {pts} END AS DOUBLE) AS {m}__pts"


_RULE_CTE = (
    f"WITH {_RATIO_CTE}, pts AS (SELECT a.*, "
    + ", ".join(_points_sql(m) for m in METRICS)
    + " FROM ratios a LEFT JOIN ratios b ON b.entity = a.entity AND b.period = a.period - 1), ruled AS (SELECT *, coalesce(("
    + " + ".join(f"coalesce({m}__pts, 0)" for m in METRICS)
    + ") / nullif("
    + " + ".join(f"CASE WHEN {m}__pts IS NOT NULL THEN {S.RULE_WEIGHTS[m]} ELSE 0 END" for m in METRICS)
    + ", 0) * 100, 0) AS total_score FROM pts)"
)


@query("rule_score", f"{_RULE_CTE} SELECT entity, period, round(total_score, 6) AS total_score, round(current_ratio__pts, 6) AS current_pts, round(debt_to_equity__pts, 6) AS debt_pts, round(roe__pts, 6) AS roe_pts FROM ruled")
def _(spark, sf):
    r = _rules(spark, sf)
    return rounded(
        r.select(*KEYS, "total_score", F.col("current_ratio__pts").alias("current_pts"), F.col("debt_to_equity__pts").alias("debt_pts"), F.col("roe__pts").alias("roe_pts"))
    )


@query(
    "mean_impute",
    f"WITH {P.STATEMENTS}, m AS (SELECT period, avg(inventory) AS mi FROM stmt GROUP BY 1) SELECT entity, period, round(coalesce(inventory, mi), 4) AS inventory FROM stmt JOIN m USING (period)",
)
def _(spark, sf):
    return rounded(S.mean_impute(P.statements(spark, sf), ["period"], ["inventory"]).select(*KEYS, "inventory"), 4)


_DETAILS = ", details AS (" + " UNION ALL ".join(
    f"SELECT entity, period, total_score, '{m}' AS metric, '{c}' AS category, {m} AS metric_value, {float(S.RULE_WEIGHTS[m])}::DOUBLE AS weight, {m}__pts AS contribution FROM ruled"
    for c, ms in S.METRIC_CATEGORIES.items()
    for m in ms
) + ")"


@query(
    "sector_blend",
    f"""{_RULE_CTE}{_DETAILS}, {P.SECTORS}, n AS (SELECT entity, period, metric, CASE WHEN count(metric_value) OVER g >= 2 THEN (rank() OVER (PARTITION BY sector, period, metric ORDER BY metric_value) - 1) * 100.0 / count(metric_value) OVER g END AS pr
 FROM details JOIN sectors USING (entity) WHERE metric_value IS NOT NULL WINDOW g AS (PARTITION BY sector, period, metric))
SELECT entity, period, round(sum(least(greatest(0.7::DOUBLE * least(greatest(contribution, 0), weight) + 0.3::DOUBLE * least(greatest(pr / 100, 0), 1) * weight, 0), weight)) / sum(weight) * 100, 6) AS blended_score
FROM details JOIN n USING (entity, period, metric) WHERE pr IS NOT NULL AND contribution IS NOT NULL GROUP BY 1, 2""",
)
def _(spark, sf):
    d = S.rule_details(_rules(spark, sf), KEYS)
    peers = d.where("metric_value is not null").join(P.sectors(spark, sf), "entity")
    norm = S.group_normalise(peers, ["entity", "sector", "period", "metric"], ["sector", "period", "metric"], "metric_value")
    return rounded(S.sector_blend(d, norm.select(*KEYS, "metric", "percentile_rank"), KEYS))


@query(
    "driver_summary",
    f"""{_RULE_CTE}{_DETAILS}, f AS (SELECT *, coalesce(contribution, 0) AS c FROM details), r AS (SELECT *,
  CASE WHEN c >= 0.6 * weight THEN row_number() OVER (PARTITION BY entity, period, c >= 0.6 * weight ORDER BY -c, metric) END AS hi,
  CASE WHEN c < 0.3 * weight THEN row_number() OVER (PARTITION BY entity, period, c < 0.3 * weight ORDER BY c, metric) END AS lo,
  coalesce(metric_value IS NOT NULL AND weight - c >= 0.2 * weight AND 70 - total_score > 0 AND 70 - total_score <= (weight - c) * 1.5, FALSE) AS reach FROM f)
SELECT entity, period, round(sum(c) FILTER (WHERE category = 'profitability') / sum(weight) FILTER (WHERE category = 'profitability') * 100, 6) AS profitability_pct,
 round(sum(c) FILTER (WHERE category = 'leverage') / sum(weight) FILTER (WHERE category = 'leverage') * 100, 6) AS leverage_pct,
 coalesce(string_agg(metric, ',' ORDER BY hi) FILTER (WHERE hi <= 3), '') AS strongest, coalesce(string_agg(metric, ',' ORDER BY lo) FILTER (WHERE lo <= 3), '') AS weakest,
 round(count(metric_value) / count(*), 6) AS completeness, count(*) FILTER (WHERE reach) AS counterfactuals, round(max(CASE WHEN reach THEN 70 - total_score END), 6) AS gap_to_band FROM r GROUP BY 1, 2""",
)
def _(spark, sf):
    out = S.driver_summary(S.rule_details(_rules(spark, sf), KEYS), KEYS)
    return rounded(out.select(*KEYS, "profitability_pct", "leverage_pct", "strongest", "weakest", "completeness", "counterfactuals", "gap_to_band"))


# ---- weighted scores ----------------------------------------------------------------------------------------

WEIGHTS = {"revenue": 1.0, "quantity": 0.6, "discount": 0.8, "returned": 0.5}
_W_SQL = (
    P.RANKED
    + """, w AS (SELECT *, round(least(greatest((coalesce(discount__pct * 0.8::DOUBLE, 0) + coalesce(quantity__pct * 0.6::DOUBLE, 0) + coalesce(returned__pct * 0.5::DOUBLE, 0) + coalesce(revenue__pct * 1.0::DOUBLE, 0)) / 2.9::DOUBLE * 1.0, 0), 1), 4) AS score,
 (3 + CAST(returned__pct IS NOT NULL AS INTEGER)) / 4.0 AS confidence FROM ranked)"""
)


@query(
    "weighted_percentile_score",
    f"WITH {_W_SQL} SELECT entity, period, score, round(confidence, 6) AS confidence, row_number() OVER (PARTITION BY period ORDER BY score DESC, entity) AS rank FROM w",
)
def _(spark, sf):
    out = S.weighted_score(P.supplier_month(spark, sf), "entity", "period", WEIGHTS)
    return rounded(out.select(*KEYS, "score", "confidence", "rank"))


@query(
    "weighted_score_contributions",
    f"""WITH {P.RANKED}, c AS (SELECT entity, period, 'revenue' AS name, round(revenue__pct * 1.0::DOUBLE, 9) AS k FROM ranked UNION ALL SELECT entity, period, 'quantity', round(quantity__pct * 0.6::DOUBLE, 9) FROM ranked
 UNION ALL SELECT entity, period, 'discount', round(discount__pct * 0.8::DOUBLE, 9) FROM ranked UNION ALL SELECT entity, period, 'returned', round(returned__pct * 0.5::DOUBLE, 9) FROM ranked WHERE returned IS NOT NULL)
SELECT entity, period, string_agg(name, ',' ORDER BY k DESC, name) AS top_parameters FROM c GROUP BY 1, 2""",
)
def _(spark, sf):
    return S.weighted_score(P.supplier_month(spark, sf), "entity", "period", WEIGHTS).select(*KEYS, "top_parameters")


@query(
    "baseline_scores",
    f"WITH {P.RANKED} SELECT entity, period, {P.SQL_MEAN} AS equal_weight, {P.SQL_MEDIAN} AS robust_median FROM ranked",
)
def _(spark, sf):
    pct = [f"{c}__pct" for c in P.FEATURES]
    return P.ranked(spark, sf).select(*KEYS, K.rank_input(N.row_mean(pct)).alias("equal_weight"), K.rank_input(N.row_median(pct)).alias("robust_median"))


_WINNER = f"""WITH {P.TARGETS}, q AS (SELECT period, quantile_cont(target, 0.75) AS e FROM targets WHERE target IS NOT NULL GROUP BY 1),
r AS (SELECT t.*, target >= e AS win FROM targets t JOIN q USING (period) WHERE target IS NOT NULL), l AS ("""  + " UNION ALL ".join(
    f"SELECT win, '{c}' AS feature, {c} AS v FROM r" for c in P.FEATURES
) + """), s AS (SELECT feature, avg(v) FILTER (WHERE win) AS winner_mean, avg(v) AS overall_mean, stddev_samp(v) AS sd, count(v) FILTER (WHERE win) AS n_winners, count(v) AS n_values, count(*) FILTER (WHERE win) AS w FROM l GROUP BY 1),
z AS (SELECT *, CASE WHEN n_winners >= 3 AND n_values >= 5 THEN abs((winner_mean - overall_mean) / sd) * n_winners / w ELSE 0 END AS raw_score FROM s)"""


@query(
    "winner_effect_weights",
    f"{_WINNER} SELECT feature, round(winner_mean, 4) AS winner_mean, round(overall_mean, 4) AS overall_mean, n_winners, n_values, round(raw_score, 6) AS raw_score, round(raw_score / max(raw_score) OVER (), 3) AS weight FROM z",
)
def _(spark, sf):
    out = S.winner_weights(P.targets(spark, sf), "period", "target", P.FEATURES)
    return out.select(
        "feature", F.round("winner_mean", 4).alias("winner_mean"), F.round("overall_mean", 4).alias("overall_mean"), "n_winners", "n_values", F.round("raw_score", 6).alias("raw_score"), F.round("weight", 3).alias("weight")
    )


def _strength(spark, sf):
    r = _ratios(spark, sf).select(*KEYS, *[F.round(m, 9).alias(m) for m in METRICS])
    ret = B.next_period_target(P.statements(spark, sf).select(*KEYS, "net_income"), "entity", "period", "net_income", "ret").select(*KEYS, "ret")
    return S.category_strength(r, "entity", "period").join(ret, KEYS)


def _below_others(m: str) -> str:
    return f"CASE WHEN {m} IS NOT NULL AND count({m}) OVER (PARTITION BY period) >= 2 THEN (rank() OVER (PARTITION BY period ORDER BY {m} NULLS LAST) - 1)::DOUBLE / (count({m}) OVER (PARTITION BY period) - 1) END"


def _mean_sql(cols):
    return "(" + " + ".join(f"coalesce({c}, 0)" for c in cols) + ") / nullif(" + " + ".join(f"CAST({c} IS NOT NULL AS INTEGER)" for c in cols) + ", 0)"


_STRENGTH = (
    f"WITH {_RATIO_CTE}, rk AS (SELECT entity, period, "
    + ", ".join(f"{'1 - ' if c == 'leverage' else ''}({_below_others(m)}) AS {m}" for c, ms in S.METRIC_CATEGORIES.items() for m in ms)
    + " FROM ratios), strength AS (SELECT rk.entity, rk.period, "
    + ", ".join(f"{_mean_sql(ms)} AS {c}" for c, ms in S.METRIC_CATEGORIES.items())
    + ", n.net_income AS ret FROM rk LEFT JOIN stmt n ON n.entity = rk.entity AND n.period = rk.period + 1), lg AS ("
    + " UNION ALL ".join(f"SELECT entity, period, ret, '{c}' AS category, {c} AS v FROM strength WHERE ret IS NOT NULL" for c in S.METRIC_CATEGORIES)
    + "), cr AS (SELECT category, CASE WHEN count(v) >= 5 AND stddev_pop(v) > 0 AND stddev_pop(ret) FILTER (WHERE v IS NOT NULL) > 0 THEN corr(v, ret) ELSE 0 END AS correlation, count(v) AS samples FROM lg GROUP BY 1)"
)


@query(
    "adaptive_category_multipliers",
    f"{_STRENGTH} SELECT category, round(correlation, 6) AS correlation, samples, round(1 + 0.35::DOUBLE * correlation, 3) AS multiplier FROM cr",
)
def _(spark, sf):
    m = S.category_multipliers(_strength(spark, sf), "ret")
    return m.select("category", F.round("correlation", 6).alias("correlation"), "samples", F.round(1 + 0.35 * F.col("correlation"), 3).alias("multiplier"))


_BASE = " UNION ALL ".join(f"SELECT '{m}' AS metric, '{c}' AS category, {float(S.RULE_WEIGHTS[m])}::DOUBLE AS base" for c, ms in S.METRIC_CATEGORIES.items() for m in ms)


@query(
    "adaptive_weights",
    f"""{_STRENGTH}, bw AS ({_BASE}), w AS (SELECT metric, category, base, base * round(1 + 0.35::DOUBLE * correlation, 4) AS w0 FROM bw JOIN cr USING (category)),
w1 AS (SELECT metric, category, base, round(w0 * sum(base) OVER () / sum(w0) OVER (), 4) AS w1 FROM w), w2 AS (SELECT *, round(w1 * CASE WHEN category = 'leverage' THEN 1.1 ELSE 1.0 END::DOUBLE, 4) AS w2 FROM w1)
SELECT metric, category, round(w2 * sum(base) OVER () / sum(w2) OVER (), 2) AS weight FROM w2""",
)
def _(spark, sf):
    m = S.category_multipliers(_strength(spark, sf), "ret")
    return rounded(S.adaptive_weights(m, S.RULE_WEIGHTS, "leverage"), 2)


@query(
    "adaptive_dominant_category",
    f"""{_STRENGTH}, {P.SECTORS}, o AS (SELECT s.*, sector, row_number() OVER (PARTITION BY sector ORDER BY ret DESC, entity * 100000 + period) AS pos, count(*) OVER (PARTITION BY sector) AS n FROM strength s JOIN sectors USING (entity) WHERE ret IS NOT NULL),
t AS (SELECT * FROM o WHERE n >= 3 AND pos <= greatest(1, floor(n / 4))), a AS ("""
    + " UNION ALL ".join(f"SELECT sector, '{c}' AS dominant_category, {i} AS o, round(avg({c}), 3) AS strength, count(*) AS top_rows FROM t GROUP BY 1" for i, c in enumerate(S.METRIC_CATEGORIES))
    + ") SELECT sector, dominant_category, strength, top_rows FROM a QUALIFY row_number() OVER (PARTITION BY sector ORDER BY strength DESC, o) = 1",
)
def _(spark, sf):
    s = _strength(spark, sf).join(P.sectors(spark, sf), "entity")
    return S.dominant_category(s, "sector", "ret", "entity", "period")


_PARAMS = ["roa", "roe", "net_margin", "current_ratio"]
_PSQL = f"""WITH {_RATIO_CTE}, l AS (""" + " UNION ALL ".join(f"SELECT entity, period, '{m}' AS feature, {m} AS v FROM ratios WHERE {m} IS NOT NULL" for m in _PARAMS) + """),
c AS (SELECT feature, avg(v) AS m, stddev_pop(v) AS d, count(*) AS n FROM l WHERE period = 1998 GROUP BY 1),
z AS (SELECT feature, avg(CASE WHEN d = 0 THEN 0 ELSE greatest((v - m) / d, 0) END) AS transition_score FROM l JOIN c USING (feature) WHERE period = 1998 GROUP BY 1),
e AS (SELECT feature, entity, avg(v) AS m, stddev_pop(v) AS d, count(*) AS n FROM l GROUP BY 1, 2),
t AS (SELECT feature, avg(1 / (1 + CASE WHEN m <> 0 THEN d / abs(m) ELSE d END)) AS temporal_score FROM e WHERE n >= 2 GROUP BY 1),
ps AS (SELECT feature, 1 / (1 + CASE WHEN m <> 0 THEN d / abs(m) ELSE d END) AS cross_score, coalesce(temporal_score, 0) AS temporal_score, transition_score FROM c LEFT JOIN t USING (feature) LEFT JOIN z USING (feature) WHERE n >= 2)"""


def _params(spark, sf):
    r = _ratios(spark, sf).select(*KEYS, *[F.round(m, 9).alias(m) for m in _PARAMS])
    return S.parameter_scores(r, "entity", "period", 1998, _PARAMS)


@query("parameter_scores", f"{_PSQL} SELECT feature, round(cross_score, 6) AS cross_score, round(temporal_score, 6) AS temporal_score, round(transition_score, 6) AS transition_score FROM ps")
def _(spark, sf):
    return rounded(_params(spark, sf))


@query(
    "store_top_parameters",
    f"{_PSQL}, f AS (SELECT feature, round(0.3 * cross_score + 0.2 * temporal_score + 0.1 * transition_score, 6) AS score FROM ps) SELECT feature, round(score, 5) AS score, CAST(row_number() OVER (ORDER BY score DESC, feature) AS INTEGER) AS rank FROM f QUALIFY row_number() OVER (ORDER BY score DESC, feature) <= 2",
)
def _(spark, sf):
    scored = S.combine_parameter_scores(_params(spark, sf)).withColumn("g", F.lit(1))
    return rounded(S.top_parameters(scored, ["g"], 2).select("feature", "score", "rank"), 5)


_SW = {"roa": 0.5, "roe": 0.3, "net_margin": 0.2}


def _forecast(spark, sf, shape="linear"):
    q = R.exact_ratios(P.quarterly_names(P.statements(spark, sf))).join(P.sectors(spark, sf), "entity")
    cols = ["roa", "roe", "net_margin", "net_income_growth", "revenue_growth"]
    q = q.select("entity", "period", "sector", *[F.round(c, 9).alias(c) for c in cols])
    return S.sector_forecast(q, "entity", ["sector", "period"], _SW, "net_income_growth", "revenue_growth", shape)


_FC = f"""WITH {P.STATEMENTS}, {P.SECTORS}, q AS (SELECT entity, period, sector, round(net_income / nullif(total_assets, 0), 9) AS roa, round(net_income / nullif(total_equity, 0), 9) AS roe, round(net_income / nullif(revenue, 0), 9) AS net_margin,
 round(net_income / nullif(lag(net_income) OVER w, 0) - 1, 9) AS g1, round(revenue / nullif(lag(revenue) OVER w, 0) - 1, 9) AS g2 FROM stmt JOIN sectors USING (entity) WINDOW w AS (PARTITION BY entity ORDER BY period)),
n AS (SELECT *, """ + ", ".join(
    f"({c} - min({c}) OVER g) / CASE WHEN max({c}) OVER g = min({c}) OVER g THEN 1 ELSE max({c}) OVER g - min({c}) OVER g END AS {c}_n" for c in _SW
) + """ FROM q WINDOW g AS (PARTITION BY sector, period)),
f AS (SELECT *, {score} AS score, CASE WHEN g1 - g2 > 0 THEN 'up' WHEN g1 - g2 < 0 THEN 'down' ELSE 'flat' END AS trend FROM n)"""
_LIN = "round(least(greatest((coalesce(roa_n * 0.5::DOUBLE, 0) + coalesce(roe_n * 0.3::DOUBLE, 0) + coalesce(net_margin_n * 0.2::DOUBLE, 0)) / 1.0 * 100, 0), 100), 4)"


@query(
    "sector_forecast",
    _FC.replace("{score}", _LIN) + " SELECT entity, period, sector, score, trend, 1.0::DOUBLE AS confidence, row_number() OVER (PARTITION BY sector, period ORDER BY score DESC, entity) AS rank FROM f",
)
def _(spark, sf):
    return _forecast(spark, sf).select("entity", "period", "sector", "score", "trend", "confidence", "rank")


@query(
    "sector_forecast_shaped",
    _FC.replace(
        "{score}",
        "round(least(greatest((coalesce(exp(-pow(roa_n - 0.6, 2) / 0.08) * 0.5::DOUBLE, 0) + coalesce(exp(-pow(roe_n - 0.6, 2) / 0.08) * 0.3::DOUBLE, 0) + coalesce(exp(-pow(net_margin_n - 0.6, 2) / 0.08) * 0.2::DOUBLE, 0)) * 100, 0), 100), 4)",
    )
    + " SELECT entity, period, sector, score, row_number() OVER (PARTITION BY sector, period ORDER BY score DESC, entity) AS rank FROM f",
)
def _(spark, sf):
    return _forecast(spark, sf, "bell").select("entity", "period", "sector", "score", "rank")


@query(
    "portfolio_extremes",
    f"""WITH {_W_SQL}, h AS (SELECT s_suppkey FROM supplier WHERE s_acctbal > 3000), x AS (SELECT * FROM w WHERE entity IN (SELECT s_suppkey FROM h)),
a AS (SELECT entity, period, score, 'weak' AS side, row_number() OVER (PARTITION BY period ORDER BY score, entity) AS position FROM x UNION ALL SELECT entity, period, score, 'strong', row_number() OVER (PARTITION BY period ORDER BY score DESC, entity) FROM x)
SELECT entity, period, score, side, CAST(position AS INTEGER) AS position FROM a WHERE position <= 3""",
)
def _(spark, sf):
    s = S.weighted_score(P.supplier_month(spark, sf), "entity", "period", WEIGHTS)
    h = table(spark, sf, "supplier").where("s_acctbal > 3000").select(F.col("s_suppkey").alias("entity"))
    return S.portfolio_extremes(s, h, "entity", ["period"]).select(*KEYS, "score", "side", "position")


@query(
    "group_heatmap",
    f"""WITH {P.YEARS}, {P.SECTORS} SELECT sector, period, 'revenue' AS feature, round(avg(revenue), 4) AS value, count(revenue) AS n_observed, count(*) - count(revenue) AS n_missing FROM years JOIN sectors USING (entity) GROUP BY 1, 2
UNION ALL SELECT sector, period, 'returned', round(avg(returned), 4), count(returned), count(*) - count(returned) FROM years JOIN sectors USING (entity) GROUP BY 1, 2""",
)
def _(spark, sf):
    y = P.supplier_year(spark, sf).join(P.sectors(spark, sf), "entity")
    return rounded(S.heatmap(y, ["sector", "period"], ["revenue", "returned"]), 4)


@query("trend_series", f"WITH {P.YEARS} SELECT period, revenue, quantity FROM years WHERE entity = 7 ORDER BY period")
def _(spark, sf):
    return S.trend_series(P.supplier_year(spark, sf), "entity", 7, "period", ["revenue", "quantity"])


@query(
    "filters_distinct",
    """SELECT DISTINCT 'period' AS kind, CAST(year(o_orderdate) AS VARCHAR) AS item FROM orders UNION SELECT 'group', o_orderpriority FROM orders
UNION SELECT 'period', CAST(year(l_shipdate) AS VARCHAR) FROM lineitem UNION SELECT 'group', l_returnflag FROM lineitem""",
)
def _(spark, sf):
    o = table(spark, sf, "orders").select(F.year("o_orderdate").alias("p"), F.col("o_orderpriority").alias("g"))
    li = table(spark, sf, "lineitem").select(F.year("l_shipdate").alias("p"), F.col("l_returnflag").alias("g"))
    return S.distinct_filters([o, li], "p", "g")


@query(
    "compare_entities",
    f"""WITH {P.PREDICTIONS}, m AS (SELECT * FROM preds WHERE NOT (model = 'momentum' AND y_pred < 0.5))
SELECT entity, round(sum(y_pred * w) / sum(w), 6) AS ensemble_prob, count(*) AS n_models, 3 - count(*) AS n_missing_models FROM m JOIN (VALUES ('equal_weight', 0.5::DOUBLE), ('momentum', 0.3::DOUBLE), ('robust_median', 0.2::DOUBLE)) t(model, w) USING (model)
WHERE period = 23940 GROUP BY 1""",
)
def _(spark, sf):
    p = P.predictions(spark, sf).where("not (model = 'momentum' and y_pred < 0.5) and period = 23940")
    return rounded(S.compare_entities(p, "entity", "model", "y_pred", {"equal_weight": 0.5, "momentum": 0.3, "robust_median": 0.2})).withColumn(
        "n_missing_models", F.col("n_missing_models").cast("bigint")
    )


_LABELS = f"""{_RULE_CTE}, s AS (SELECT round(total_score, 6) AS score, round(debt_to_assets / 1000, 9) AS debt FROM ruled),
t AS (SELECT (SELECT median(score) FROM s) AS med, (SELECT score FROM (SELECT score, row_number() OVER (ORDER BY score) AS rn, count(*) OVER () AS n FROM s) WHERE rn = floor(0.75 * n) + 1) AS p75),
l AS (SELECT 'absolute' AS rule, score >= 40 AS hit FROM s UNION ALL SELECT 'sector_median', score >= (SELECT med FROM t) FROM s UNION ALL SELECT 'upper_quartile', score >= (SELECT p75 FROM t) FROM s
 UNION ALL SELECT 'risk_adjusted', score >= 40 AND coalesce(debt, 1) <= 0.7 FROM s)
SELECT rule, count(*) AS total_rows, count(*) FILTER (WHERE hit) AS positive_count, count(*) FILTER (WHERE NOT hit) AS negative_count, round(count(*) FILTER (WHERE hit) / count(*), 6) AS positive_rate,
 abs(count(*) FILTER (WHERE hit) / count(*) - 0.5) > 0.35 AS imbalance_warning, round((SELECT med FROM t), 5) AS median_score, round((SELECT p75 FROM t), 5) AS p75_score FROM l GROUP BY 1"""


@query("label_distribution", _LABELS)
def _(spark, sf):
    s = _rules(spark, sf).select(F.round("total_score", 6).alias("score"), F.round(F.col("debt_to_assets") / 1000, 9).alias("debt"))
    out = S.label_distribution(s, "score", "debt", 40.0)
    return rounded(out, 5).withColumn("positive_rate", F.round(F.col("positive_count") / F.col("total_rows"), 6))


@query(
    "profit_buckets",
    f"""WITH {P.STATEMENTS}, m AS (SELECT period, median(revenue) AS sm, median(operating_cash_flow) AS rm FROM stmt GROUP BY 1),
f AS (SELECT entity, s.period, coalesce(revenue >= sm, FALSE) AS hs, coalesce(operating_cash_flow >= rm, FALSE) AS hr, coalesce(net_income > 0, FALSE) AS p FROM stmt s JOIN m USING (period))
SELECT entity, period, CASE WHEN hs AND hr AND p THEN 'high_score_profit_strong_return' WHEN hs AND p AND NOT hr THEN 'high_score_profit_weak_return' WHEN NOT hs AND NOT hr THEN 'low_score_weak_return'
 WHEN NOT hs AND hr THEN 'low_score_strong_return' WHEN p AND NOT hr THEN 'profitable_but_underperformed' WHEN NOT p AND hr THEN 'unprofitable_but_outperformed' ELSE 'other' END AS bucket FROM f""",
)
def _(spark, sf):
    s = P.statements(spark, sf)
    return S.profit_buckets(s, "period", "revenue", "operating_cash_flow", "net_income").select(*KEYS, "bucket")


@query(
    "composite_score",
    f"""WITH {P.RANKED}, c AS (SELECT entity, period, returned__pct AS ml, (3 + CAST(returned IS NOT NULL AS INTEGER)) / 4.0 AS cf, CASE WHEN discount__pct > 0 AND discount__pct <= 1 AND tax > 0.04 THEN discount__pct END AS rs FROM ranked)
SELECT entity, period, round((coalesce(ml * 0.6::DOUBLE, 0) + coalesce(cf * 0.2::DOUBLE, 0) + coalesce(rs * 0.2::DOUBLE, 0)) / (CASE WHEN ml IS NOT NULL THEN 0.6 ELSE 0 END::DOUBLE + 0.2::DOUBLE + CASE WHEN rs IS NOT NULL THEN 0.2 ELSE 0 END::DOUBLE), 6) AS composite,
 round(0.5 + (coalesce(ml, 0.5) - 0.5) * cf, 6) AS shrunk FROM c""",
)
def _(spark, sf):
    r = P.ranked(spark, sf)
    conf = (3 + F.col("returned").isNotNull().cast("int")) / 4.0
    research = F.when(F.col("tax") > 0.04, F.col("discount__pct"))
    return rounded(
        r.select(
            *KEYS,
            S.composite_score(F.col("returned__pct"), conf, research, {"ml": 0.6, "confidence": 0.2, "research": 0.2}).alias("composite"),
            S.shrink_to_neutral(F.col("returned__pct"), conf).alias("shrunk"),
        )
    )


@query(
    "benchmark_outperformers",
    f"""WITH {P.TARGETS}, b AS (SELECT period AS target_period, round(avg(revenue), 4) AS bench FROM months GROUP BY 1), e AS (SELECT entity, target_period, round(target - bench, 4) AS excess FROM targets JOIN b USING (target_period) WHERE target IS NOT NULL),
l AS (SELECT * FROM e WHERE target_period = (SELECT max(target_period) FROM e))
SELECT entity, target_period, excess, (SELECT count(*) FROM l WHERE excess > 0) AS outperformer_count, (SELECT count(*) FROM l) AS total_in_period FROM l WHERE excess > 0 ORDER BY excess DESC, entity LIMIT 10""",
)
def _(spark, sf):
    bench = P.supplier_month(spark, sf).groupBy(F.col("period").alias("target_period")).agg(F.round(F.avg("revenue"), 4).alias("bench"))
    e = B.benchmark_excess(P.targets(spark, sf), bench, "target_period", "target", "bench")
    e = e.select("entity", "target_period", F.round("excess", 4).alias("excess"), "outperform")
    return S.outperformers(e, "target_period", "outperform", "excess", "entity", 10).drop("outperform")


@query(
    "top_ranked",
    f"WITH {_W_SQL}, r AS (SELECT entity, period, score, row_number() OVER (PARTITION BY period ORDER BY score DESC, entity) AS rank FROM w) SELECT * FROM r WHERE period = (SELECT max(period) FROM r) ORDER BY rank LIMIT 10",
)
def _(spark, sf):
    s = S.weighted_score(P.supplier_month(spark, sf), "entity", "period", WEIGHTS).select(*KEYS, "score", "rank")
    return S.top_ranked(s, "period", "rank", 10)


@query(
    "signal_label",
    f"""WITH {_W_SQL} SELECT entity, period, CASE WHEN score >= 0.66 THEN 'HIGH' WHEN score >= 0.4 THEN 'MEDIUM' ELSE 'LOW' END AS signal, CASE WHEN confidence >= 0.8 THEN 'high' WHEN confidence >= 0.5 THEN 'medium' ELSE 'low' END AS confidence_label FROM w""",
)
def _(spark, sf):
    s = S.weighted_score(P.supplier_month(spark, sf), "entity", "period", WEIGHTS)
    return s.select(*KEYS, S.signal_label("score").alias("signal"), "confidence_label")


@query(
    "verdict_pivot",
    """SELECT user_id, CAST(ts AS DATE) AS day, count(*) FILTER (WHERE event_type = 'view') AS verdict_view, count(*) FILTER (WHERE event_type = 'click') AS verdict_click, count(*) FILTER (WHERE event_type = 'purchase') AS verdict_purchase,
 count(*) FILTER (WHERE value < 20) AS reason_small, count(*) FILTER (WHERE value >= 20) AS reason_large, count(*) FILTER (WHERE event_type IN ('view', 'click', 'purchase')) AS total FROM events GROUP BY 1, 2""",
)
def _(spark, sf):
    e = table(spark, sf, "events").withColumn("day", F.to_date("ts"))
    reason = F.when(F.col("value") < 20, "small").otherwise("large")
    return S.verdict_counts(e, ["user_id", "day"], "event_type", ["view", "click", "purchase"], reason, ["small", "large"])


_BELOW = f"WITH {P.MONTHS}, b AS (SELECT entity, period, returned, " + ", ".join(
    f"CASE WHEN {c} IS NOT NULL THEN (rank() OVER (PARTITION BY period ORDER BY {c} NULLS LAST) - 1) * 100.0 / count({c}) OVER (PARTITION BY period) END AS {c}_b" for c in P.FEATURES
) + " FROM months), l AS (" + " UNION ALL ".join(f"SELECT entity, period, '{c}' AS feature, {c}_b AS p, {c}_b IS NULL AS missing FROM b" for c in P.FEATURES) + ")"


@query(
    "persona_extremes",
    f"""{_BELOW}, k AS (SELECT *, row_number() OVER (PARTITION BY entity, period ORDER BY p, feature) AS lo, row_number() OVER (PARTITION BY entity, period ORDER BY p DESC, feature) AS hi, count(*) OVER (PARTITION BY entity, period) AS n FROM l WHERE p IS NOT NULL)
SELECT entity, period, 'low' AS side, CAST(lo AS INTEGER) AS position, feature, round(p, 6) AS percentile FROM k WHERE n >= 4 AND lo <= 2 UNION ALL SELECT entity, period, 'high', CAST(hi AS INTEGER), feature, round(p, 6) FROM k WHERE n >= 4 AND hi <= 2""",
)
def _(spark, sf):
    b = S.pct_below(P.supplier_month(spark, sf), KEYS, ["period"], P.FEATURES)
    return rounded(S.extreme_features(b, KEYS, P.FEATURES, 2))


@query(
    "entity_feature_signals",
    f"""{_BELOW}, x AS (SELECT * FROM l QUALIFY period = max(period) OVER (PARTITION BY entity)), k AS (SELECT *, row_number() OVER (PARTITION BY entity, missing ORDER BY p, feature DESC) AS lo, row_number() OVER (PARTITION BY entity, missing ORDER BY p DESC, feature) AS hi, count(p) OVER (PARTITION BY entity) AS n FROM x)
SELECT entity, period, feature, round(p, 6) AS percentile, missing, CASE WHEN p >= 50 THEN 'above_median' WHEN p < 50 THEN 'below_median' END AS signal, NOT missing AND hi <= 8 AS is_top, NOT missing AND n > 4 AND lo <= 4 AS is_bottom FROM k""",
)
def _(spark, sf):
    b = S.pct_below(P.supplier_month(spark, sf), KEYS, ["period"], P.FEATURES)
    return rounded(S.entity_signals(b, "entity", "period", P.FEATURES))


MASK_CATEGORIES = {"price": ["discount"], "volume": ["quantity", "returned"], "sales": ["revenue"]}


@query("mask_scenarios")
def _(spark, sf):
    return rounded(X.mask_scenarios(P.supplier_year(spark, sf), WEIGHTS, MASK_CATEGORIES))


@query("mask_scenario_summary")
def _(spark, sf):
    return rounded(X.grouped_scenarios(X.mask_scenarios(P.supplier_year(spark, sf), WEIGHTS, MASK_CATEGORIES), ["family", "mask_name"]))
