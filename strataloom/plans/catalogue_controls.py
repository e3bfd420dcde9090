"""Queries: controls (permutations, noise, reordering, faults, differences) and structure of columns (support, components, tails)."""

from pyspark.sql import functions as F

from strataloom.operators import controls as C
from strataloom.operators import structure as S
from strataloom.operators.evaluation import feature_correlation, spearman_ic
from strataloom.operators.panel import next_period_target
from strataloom.plans import panels as P
from strataloom.plans.catalogue_eval import sql_corr
from strataloom.plans.registry import query, rounded

KEYS, SEED = ["entity", "period"], 7
WINDOWS = {"early": [1993, 1994], "late": [1995, 1996, 1997], "edge": [1992, 1999]}


def _hash(*parts: str) -> str:
    return f"CAST(('0x' || substr(md5(concat_ws('|', {', '.join(parts)})), 1, 15)) AS BIGINT)"


def _panel(spark, sf):
    """Supplier-years with next year's revenue as target and some quantities missing."""
    rows = next_period_target(P.supplier_year(spark, sf), "entity", "period", "revenue")
    return rows.withColumn("quantity", F.when(F.col("entity") % 7 != 3, F.col("quantity"))).select("entity", "period", "revenue", "quantity", "returned", "discount", "target")


_PANEL = f"""{P.YEARS}, p AS (SELECT a.entity, a.period, a.revenue, CASE WHEN a.entity % 7 <> 3 THEN a.quantity END AS quantity, a.returned, a.discount, b.revenue AS target FROM years a LEFT JOIN years b ON b.entity = a.entity AND b.period = a.period + 1)"""


@query(
    "permute_column",
    f"""WITH {_PANEL}, k AS (SELECT entity, period, quantity, row_number() OVER (PARTITION BY period ORDER BY entity) AS s, row_number() OVER (PARTITION BY period ORDER BY {_hash("'7'", 'period', 'entity')}, entity) AS h FROM p WHERE quantity IS NOT NULL)
SELECT p.entity, p.period, b.quantity FROM p LEFT JOIN k a USING (entity, period) LEFT JOIN k b ON b.period = a.period AND b.h = a.s""",
)
def _(spark, sf):
    return C.permute_column(_panel(spark, sf), "quantity", ["period"], KEYS, SEED).select("entity", "period", "quantity")


@query(
    "permute_mask",
    f"""WITH {_PANEL}, k AS (SELECT entity, period, quantity IS NULL AS mq, returned IS NULL AS mr, row_number() OVER (PARTITION BY period ORDER BY entity) AS s, row_number() OVER (PARTITION BY period ORDER BY {_hash("'7'", 'period', 'entity')}, entity) AS h FROM p)
SELECT p.entity, p.period, CASE WHEN NOT b.mq THEN p.quantity END AS quantity, CASE WHEN NOT b.mr THEN p.returned END AS returned FROM p JOIN k a USING (entity, period) JOIN k b ON b.period = a.period AND b.h = a.s""",
)
def _(spark, sf):
    df, cols = _panel(spark, sf), ["quantity", "returned"]
    return C.apply_mask(df, C.permute_mask(df, cols, ["period"], KEYS, SEED), cols, KEYS).select(*KEYS, *cols)


_Z = "sqrt(-2 * ln(({0} + 0.5::DOUBLE) / 1152921504606846976)) * cos(2 * pi() * (({1} + 0.5::DOUBLE) / 1152921504606846976))"


@query(
    "noise_panel",
    f"WITH {_PANEL} SELECT entity, period, "
    + ", ".join("round(" + _Z.format(_hash("'7'", "'1'", f"'{c}'", "entity", "period"), _hash("'7'", "'2'", f"'{c}'", "entity", "period")) + f", 6) AS {c}" for c in ("revenue", "quantity"))
    + " FROM p",
)
def _(spark, sf):
    return rounded(C.noise_panel(_panel(spark, sf), ["revenue", "quantity"], KEYS, SEED).select(*KEYS, "revenue", "quantity"))


@query(
    "rank_matched",
    f"""WITH {_PANEL}, k AS (SELECT entity, period, quantity, row_number() OVER (PARTITION BY period ORDER BY target NULLS LAST, entity) AS l, row_number() OVER (PARTITION BY period ORDER BY quantity, entity) AS v FROM p WHERE quantity IS NOT NULL)
SELECT p.entity, p.period, b.quantity FROM p LEFT JOIN k a USING (entity, period) LEFT JOIN k b ON b.period = a.period AND b.v = a.l""",
)
def _(spark, sf):
    return C.rank_matched(_panel(spark, sf), "quantity", "target", ["period"], KEYS).select("entity", "period", "quantity")


_ICS = f"""{P.YEARLY_PREDICTIONS}, rk AS (SELECT model, period, {P.sql_avg_rank('y_true', 'model, period')} AS rt, {P.sql_avg_rank('y_pred', 'model, period')} AS rp FROM preds WHERE y_true IS NOT NULL AND y_pred IS NOT NULL),
ic AS (SELECT model, period AS stage, round({sql_corr('rt', 'rp')}, 9) AS ic FROM rk GROUP BY 1, 2)"""


@query(
    "attenuation",
    f"""WITH {_ICS} SELECT model, stage, ic, CASE WHEN row_number() OVER w > 1 THEN round(ic / nullif(first_value(ic) OVER w, 0), 6) END AS ratio_to_injected, round(ic / nullif(lag(ic) OVER w, 0), 6) AS ratio_to_previous FROM ic WINDOW w AS (PARTITION BY model ORDER BY stage)""",
)
def _(spark, sf):
    ics = spearman_ic(P.yearly_predictions(spark, sf)).select("model", F.col("period").alias("stage"), F.round("ic", 9).alias("ic"))
    out = C.attenuation(ics)
    return out.withColumns({c: F.round(c, 6) + 0.0 for c in ("ratio_to_injected", "ratio_to_previous")})


def _fault(kind):
    def run(spark, sf):
        return C.inject_fault(_panel(spark, sf), kind, "revenue").select("entity", "period", "revenue", "target")

    return run


query(
    "inject_future_value",
    f"WITH {_PANEL} SELECT a.entity, a.period, CASE WHEN b.entity IS NOT NULL THEN b.revenue ELSE a.revenue END AS revenue, a.target FROM p a LEFT JOIN p b ON b.entity = a.entity AND b.period = a.period + 1",
)(_fault("future_value"))
query(
    "inject_rotated_target",
    f"""WITH {_PANEL}, k AS (SELECT entity, period, coalesce(lag(target) OVER (PARTITION BY entity ORDER BY period), last_value(target) OVER (PARTITION BY entity ORDER BY period ROWS BETWEEN UNBOUNDED PRECEDING AND UNBOUNDED FOLLOWING)) AS t FROM p WHERE target IS NOT NULL)
SELECT p.entity, p.period, p.revenue, k.t AS target FROM p LEFT JOIN k USING (entity, period)""",
)(_fault("rotated_target"))
query("inject_outcome_selected_rows", f"WITH {_PANEL} SELECT entity, period, revenue, target FROM (SELECT *, median(target) OVER (PARTITION BY period) AS m FROM p) WHERE target IS NULL OR target >= m")(_fault("outcome_selected_rows"))
query("inject_duplicated_period", f"WITH {_PANEL} SELECT entity, period, revenue, target FROM p UNION ALL SELECT entity, period, revenue, target FROM p WHERE period = (SELECT min(period) FROM p)")(_fault("duplicated_period"))


@query(
    "frame_diff",
    f"""WITH {_PANEL}, q AS (SELECT a.entity, a.period, CASE WHEN b.entity IS NOT NULL THEN b.revenue ELSE a.revenue END AS revenue, a.target FROM p a LEFT JOIN p b ON b.entity = a.entity AND b.period = a.period + 1 WHERE a.period < 1998),
j AS (SELECT p.entity AS l, q.entity AS r, p.revenue IS DISTINCT FROM q.revenue AS dr, p.target IS DISTINCT FROM q.target AS dt FROM p FULL JOIN q ON p.entity = q.entity AND p.period = q.period),
c AS (SELECT count(*) FILTER (WHERE l IS NOT NULL AND r IS NOT NULL AND dr) AS revenue, count(*) FILTER (WHERE l IS NOT NULL AND r IS NOT NULL AND dt) AS target, count(*) FILTER (WHERE r IS NULL) AS only_left, count(*) FILTER (WHERE l IS NULL) AS only_right FROM j)
SELECT 'revenue' AS "column", revenue AS changed, only_left, only_right, revenue + only_left + only_right = 0 AS equal FROM c UNION ALL SELECT 'target', target, only_left, only_right, target + only_left + only_right = 0 FROM c""",
)
def _(spark, sf):
    df = _panel(spark, sf)
    return C.frame_diff(df, C.inject_fault(df, "future_value", "revenue").where("period < 1998"), KEYS, ["revenue", "target"])


@query("multiset_diff", f"WITH {_PANEL} SELECT period, CASE WHEN period = (SELECT min(period) FROM p) THEN count(*) ELSE 0 END AS differing FROM p GROUP BY period")
def _(spark, sf):
    df = C.permute_column(_panel(spark, sf), "quantity", ["period"], KEYS, SEED)
    return C.multiset_diff(_panel(spark, sf), C.inject_fault(df, "duplicated_period", "revenue"), ["period"], ["quantity"])


def _guards(spark, sf):
    clean = _panel(spark, sf)
    base = P.supplier_year(spark, sf).select("entity", "period", F.col("revenue").alias("__r"))
    nxt = base.select("entity", (F.col("period") - 1).alias("period"), F.col("__r").alias("__n"))
    return {
        "unique_keys": lambda df: df.groupBy(*KEYS).agg(F.count(F.lit(1)).alias("n")).where("n > 1"),
        "feature_of_its_period": lambda df: df.join(base, KEYS).where("revenue <> __r"),
        "target_of_next_period": lambda df: df.join(nxt, KEYS).where("target <> __n"),
        "declared_columns": lambda df: df if set(df.columns) - set(clean.columns) else df.limit(0),
        "whole_universe": lambda df: base.join(df.select(*KEYS), KEYS, "left_anti"),
    }


@query(
    "fault_matrix",
    f"""WITH {_PANEL}, f AS (SELECT a.*, CASE WHEN b.entity IS NOT NULL THEN b.revenue ELSE a.revenue END AS fr FROM p a LEFT JOIN p b ON b.entity = a.entity AND b.period = a.period + 1),
k AS (SELECT entity, period, target, coalesce(lag(target) OVER (PARTITION BY entity ORDER BY period), last_value(target) OVER (PARTITION BY entity ORDER BY period ROWS BETWEEN UNBOUNDED PRECEDING AND UNBOUNDED FOLLOWING)) AS t FROM p WHERE target IS NOT NULL),
m AS (SELECT *, median(target) OVER (PARTITION BY period) AS mid FROM p),
v AS (SELECT 'future_value' AS fault, 'feature_of_its_period' AS guard, (SELECT count(*) FROM f WHERE fr <> revenue) AS violations UNION ALL SELECT 'rotated_target', 'target_of_next_period', (SELECT count(*) FROM k WHERE t <> target)
 UNION ALL SELECT 'leaked_column', 'declared_columns', (SELECT count(*) FROM p) UNION ALL SELECT 'outcome_selected_rows', 'whole_universe', (SELECT count(*) FROM m WHERE target < mid) UNION ALL SELECT 'duplicated_period', 'unique_keys', (SELECT count(*) FROM p WHERE period = (SELECT min(period) FROM p))),
g AS (SELECT * FROM (SELECT DISTINCT fault FROM v), (SELECT DISTINCT guard FROM v))
SELECT fault, guard, coalesce(violations, 0) AS violations, 0::BIGINT AS clean_violations, coalesce(violations, 0) > 0 AS detected FROM g LEFT JOIN v USING (fault, guard)""",
)
def _(spark, sf):
    return C.fault_matrix(_panel(spark, sf), "revenue", _guards(spark, sf))


# ---- structure ---------------------------------------------------------------------------------------

_PAIRS = [(a, b) for i, a in enumerate(P.FEATURES) for b in P.FEATURES[i:]]
_OVER = " UNION ALL ".join(f"SELECT '{a}' AS a, '{b}' AS b, count(*) FILTER (WHERE {a} IS NOT NULL AND {b} IS NOT NULL) AS \"both\" FROM p" for a, b in _PAIRS)


@query("support_overlap", f"WITH {_PANEL} {_OVER}")
def _(spark, sf):
    return S.support_overlap(_panel(spark, sf), P.FEATURES)


@query("overlap_summary", f'WITH {_PANEL}, o AS ({_OVER}) SELECT count(*) AS pairs, min("both") AS minimum, max("both") AS maximum, round(avg("both"), 6) AS mean, median("both") AS median, round(stddev_pop("both"), 6) AS population_std FROM o WHERE a <> b')
def _(spark, sf):
    return rounded(S.overlap_summary(S.support_overlap(_panel(spark, sf), P.FEATURES)))


_COR = f"{P.YEARLY_RANKED}, c AS (" + " UNION ALL ".join(f"SELECT '{a}' AS a, '{b}' AS b, {sql_corr(f'{a}__pct', f'{b}__pct')} AS r FROM ranked WHERE {a}__pct IS NOT NULL AND {b}__pct IS NOT NULL" for a, b in _PAIRS) + ")"


def _correlations(spark, sf):
    plain = lambda c: F.regexp_replace(c, "__pct$", "").alias(c)
    return feature_correlation(P.yearly_ranked(spark, sf), [f"{c}__pct" for c in P.FEATURES]).select(plain("a"), plain("b"), "correlation")


@query(
    "threshold_components",
    f"""WITH RECURSIVE {_COR}, e AS (SELECT a, b FROM c WHERE a <> b AND abs(r) >= 0.5 UNION SELECT b, a FROM c WHERE a <> b AND abs(r) >= 0.5), n AS (SELECT a AS v FROM c UNION SELECT b FROM c),
w AS (SELECT v, v AS u FROM n UNION SELECT w.v, e.b FROM w JOIN e ON e.a = w.u), l AS (SELECT v, min(u) AS component FROM w GROUP BY 1)
SELECT component, list_sort(list(v))::VARCHAR AS members, count(*) AS size, (SELECT count(*) FROM c JOIN l x ON x.v = c.a JOIN l y ON y.v = c.b WHERE a <> b AND abs(r) >= 0.5 AND x.component = l.component AND y.component = l.component) AS edge_count,
 (SELECT round(min(abs(r)), 6) FROM c JOIN l x ON x.v = c.a JOIN l y ON y.v = c.b WHERE a <> b AND x.component = l.component AND y.component = l.component) AS min_abs_corr,
 (SELECT round(median(abs(r)), 6) FROM c JOIN l x ON x.v = c.a JOIN l y ON y.v = c.b WHERE a <> b AND x.component = l.component AND y.component = l.component) AS median_abs_corr FROM l GROUP BY component""",
)
def _(spark, sf):
    out = rounded(S.threshold_components(_correlations(spark, sf), 0.5))
    return out.withColumn("members", F.concat(F.lit("["), F.array_join("members", ", "), F.lit("]")))


@query("participation_ratio", f"WITH {_COR} SELECT 4 AS columns, round(16 / (4 + 2 * sum(r * r) FILTER (WHERE a <> b)), 6) AS participation_ratio FROM c")
def _(spark, sf):
    return rounded(S.effective_rank(_correlations(spark, sf)).drop("effective_rank"))


@query("effective_rank")
def _(spark, sf):
    return rounded(S.effective_rank(_correlations(spark, sf)))


_WIN = "w AS (SELECT * FROM (VALUES " + ", ".join(f"('{w}', {p})" for w, ps in WINDOWS.items() for p in ps) + ") t(win, period))"


@query(
    "support_eligibility",
    f"""WITH {_PANEL}, {_WIN}, s AS ({" UNION ALL ".join(f"SELECT '{c}' AS feature, win, w.period, count({c}) AS n FROM w LEFT JOIN p ON p.period = w.period GROUP BY win, w.period" for c in P.FEATURES)}),
e AS (SELECT feature, win, min(n) AS least_support, min(n) >= 2 AS eligible FROM s GROUP BY 1, 2) SELECT feature, win AS "window", least_support, eligible, bool_and(eligible) OVER (PARTITION BY feature) AS eligible_everywhere FROM e""",
)
def _(spark, sf):
    return S.support_eligibility(_panel(spark, sf), WINDOWS, P.FEATURES)


@query(
    "window_missingness",
    f"""WITH {_PANEL}, {_WIN}, j AS (SELECT * FROM w JOIN p USING (period)) """
    + " UNION ALL ".join(f"SELECT win AS \"window\", '{c}' AS feature, count(*) AS total_rows, count({c}) AS known, count(*) - count({c}) AS missing, round((count(*) - count({c})) / count(*), 6) AS missing_rate FROM j GROUP BY win" for c in P.FEATURES),
)
def _(spark, sf):
    return rounded(S.window_missingness(_panel(spark, sf), WINDOWS, P.FEATURES))


_TAIL = f"""{_PANEL}, th AS ({" UNION ALL ".join(f"SELECT '{c}' AS feature, count({c}) AS n, quantile_cont({c}, 0.05) AS low, quantile_cont({c}, 0.95) AS high FROM p WHERE period <= 1995" for c in ("revenue", "quantity"))})"""


def _thresholds(df):
    return S.tail_thresholds(df.where("period <= 1995"), ["revenue", "quantity"], 0.05)


@query("tail_thresholds", f"WITH {_TAIL} SELECT feature, n, round(low, 6) AS low, round(high, 6) AS high, 'ready' AS status FROM th")
def _(spark, sf):
    return rounded(_thresholds(_panel(spark, sf)))


def _sql_tail(low: str, high: str) -> str:
    cell = lambda c: f"CASE WHEN {c} < (SELECT low FROM th WHERE feature = '{c}') THEN {low.format(c)} WHEN {c} > (SELECT high FROM th WHERE feature = '{c}') THEN {high.format(c)} ELSE {c} END"
    return f"WITH {_TAIL} SELECT entity, period, round({cell('revenue')}, 6) AS revenue, round({cell('quantity')}, 6) AS quantity FROM p"


@query("winsorise", _sql_tail("(SELECT low FROM th WHERE feature = '{0}')", "(SELECT high FROM th WHERE feature = '{0}')"))
def _(spark, sf):
    df = _panel(spark, sf)
    return rounded(S.winsorise(df, _thresholds(df), ["revenue", "quantity"]).select(*KEYS, "revenue", "quantity"))


@query("trim_tails", _sql_tail("NULL", "NULL"))
def _(spark, sf):
    df = _panel(spark, sf)
    return rounded(S.trim(df, _thresholds(df), ["revenue", "quantity"]).select(*KEYS, "revenue", "quantity"))


@query(
    "tail_audit",
    f"""WITH {_TAIL}, l AS (SELECT CASE WHEN period <= 1995 THEN 'train' ELSE 'test' END AS role, 'revenue' AS feature, revenue AS v FROM p UNION ALL SELECT CASE WHEN period <= 1995 THEN 'train' ELSE 'test' END, 'quantity', quantity FROM p)
SELECT role, feature, count(*) AS n, count(*) FILTER (WHERE v < low) AS below, count(*) FILTER (WHERE v > high) AS above, round(count(*) FILTER (WHERE v < low OR v > high) / count(*), 6) AS affected_share, CASE WHEN count(*) FILTER (WHERE v < low OR v > high) > 0 THEN 'ready' ELSE 'no_op' END AS status
 FROM l JOIN th USING (feature) WHERE v IS NOT NULL GROUP BY 1, 2""",
)
def _(spark, sf):
    df = _panel(spark, sf).withColumn("role", F.when(F.col("period") <= 1995, "train").otherwise("test"))
    return rounded(S.tail_audit(df, _thresholds(df), ["revenue", "quantity"]))


@query(
    "surface_delta",
    f"""WITH {_ICS}, n AS (SELECT model, period AS split, count(*) AS n FROM rk GROUP BY 1, 2), s AS (SELECT ic.model, stage AS split, ic, n, 1 - abs(ic) AS p_value FROM ic JOIN n ON n.model = ic.model AND split = stage)
SELECT 'equal_weight' AS model, a.split, round(a.ic - b.ic, 6) AS delta_ic, a.n - b.n AS delta_n, (a.p_value < 0.9) <> (b.p_value < 0.9) AS verdict_changed FROM s a JOIN s b USING (split) WHERE a.model = 'momentum' AND b.model = 'equal_weight'""",
)
def _(spark, sf):
    ics = spearman_ic(P.yearly_predictions(spark, sf)).select("model", F.col("period").alias("split"), F.round("ic", 9).alias("ic"), "n")
    board = ics.withColumn("p_value", 1 - F.abs("ic"))
    stress = board.where("model = 'momentum'").withColumn("model", F.lit("equal_weight"))
    return rounded(S.surface_delta(stress, board.where("model = 'equal_weight'"), alpha=0.9))
