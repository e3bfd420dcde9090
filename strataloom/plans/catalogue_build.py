"""Queries: panel construction and set operations."""

from pyspark.sql import functions as F

from strataloom.operators import panel as B
from strataloom.plans import panels as P
from strataloom.plans.registry import query, rounded, table


@query(
    "duplicate_keys",
    "SELECT user_id, event_type, count(*) AS n_rows FROM events GROUP BY 1, 2 HAVING count(*) > 1",
)
def _(spark, sf):
    return B.duplicate_keys(table(spark, sf, "events"), ["user_id", "event_type"])


@query(
    "next_period_target",
    f"WITH {P.TARGETS} SELECT entity, period, revenue, target, target_period FROM targets",
)
def _(spark, sf):
    return P.targets(spark, sf).select("entity", "period", "revenue", "target", "target_period")


@query(
    "cross_section_targets",
    f"""WITH {P.TARGETS}, r AS (SELECT entity, target_period, target, {P.sql_pct('target', 'target_period')} * 100 AS p,
 CASE WHEN target IS NOT NULL THEN rank() OVER (PARTITION BY target_period ORDER BY target DESC NULLS LAST) END AS target_rank FROM targets)
SELECT entity, target_period, target_rank, round(p, 6) AS target_pct, p >= 90 AS target_top10, p >= 80 AS target_top20 FROM r""",
)
def _(spark, sf):
    out = B.cross_section_targets(P.targets(spark, sf), ["entity", "target_period"], "target_period", "target")
    return rounded(out.select("entity", "target_period", "target_rank", "target_pct", "target_top10", "target_top20"))


def _bench(spark, sf, name="target_period"):
    m = P.supplier_month(spark, sf)
    return m.groupBy(F.col("period").alias(name)).agg(F.round(F.avg("revenue"), 4).alias("bench"))


@query(
    "benchmark_excess",
    f"""WITH {P.TARGETS}, b AS (SELECT period, round(avg(revenue), 4) AS bench FROM months GROUP BY 1)
SELECT entity, t.period, bench AS benchmark, round(target - bench, 4) AS excess, target - bench > 0 AS outperform FROM targets t LEFT JOIN b ON b.period = t.target_period""",
)
def _(spark, sf):
    out = B.benchmark_excess(P.targets(spark, sf), _bench(spark, sf), "target_period", "target", "bench")
    return rounded(out.select("entity", "period", "benchmark", "excess", "outperform"), 4)


def _yearly_prices(spark, sf):
    return P.supplier_year(spark, sf).select("entity", F.col("period").alias("year"), F.col("revenue").alias("price"))


def _year_bench(spark, sf):
    y = P.supplier_year(spark, sf).groupBy(F.col("period").alias("year")).agg(F.round(F.avg("discount") * 100, 6).alias("benchmark_return"))
    return y


_YB = "yb AS (SELECT period AS year, round(avg(discount) * 100, 6) AS benchmark_return FROM years GROUP BY 1)"


@query(
    "yearly_price_features",
    f"""WITH {P.YEARS}, {_YB}, f AS (SELECT y.entity, y.period AS year, y.revenue AS price, count(*) OVER (PARTITION BY y.entity ORDER BY y.period) AS history_years,
  (y.revenue / a.revenue - 1) * 100 AS momentum_1y, (y.revenue / b.revenue - 1) * 100 AS momentum_2y,
  (y.revenue / max(y.revenue) OVER (PARTITION BY y.entity ORDER BY y.period RANGE BETWEEN 2 PRECEDING AND CURRENT ROW) - 1) * 100 AS drawdown_3y
  FROM years y LEFT JOIN years a ON a.entity = y.entity AND a.period = y.period - 1 LEFT JOIN years b ON b.entity = y.entity AND b.period = y.period - 2)
SELECT entity, year, price, history_years, round(momentum_1y, 6) AS momentum_1y, round(momentum_2y, 6) AS momentum_2y, round(drawdown_3y, 6) AS drawdown_3y,
  benchmark_return, round(momentum_1y - benchmark_return, 6) AS relative_1y FROM f LEFT JOIN yb USING (year)""",
)
def _(spark, sf):
    return rounded(B.yearly_price_features(_yearly_prices(spark, sf), _year_bench(spark, sf)))


@query(
    "yearly_return_first_last",
    f"""WITH {P.PRICES} SELECT symbol, CAST(year(date) AS INTEGER) AS year, count(*) AS n_quotes, arg_min(close, date) AS first_price, arg_max(close, date) AS last_price,
 round(CASE WHEN count(*) >= 2 AND arg_min(close, date) > 0 THEN (arg_max(close, date) / arg_min(close, date) - 1) * 100 END, 6) AS return_pct FROM prices GROUP BY 1, 2""",
)
def _(spark, sf):
    daily = P.daily_prices(spark, sf).withColumn("year", F.year("date"))
    return rounded(B.yearly_return_first_last(daily, ["symbol"], "year", "date", "close"))


@query(
    "yearly_return_prev",
    f"WITH {P.YEARS} SELECT y.entity, y.period AS year, round((y.revenue / p.revenue - 1) * 100, 6) AS return_pct FROM years y LEFT JOIN years p ON p.entity = y.entity AND p.period = y.period - 1",
)
def _(spark, sf):
    return rounded(B.yearly_return_prev(_yearly_prices(spark, sf)))


@query(
    "event_carry_forward",
    """WITH e AS (SELECT o_custkey AS entity, year(o_orderdate) AS effective, arg_min(o_totalprice, o_orderkey) AS shares FROM orders WHERE o_orderpriority = '1-URGENT' AND o_totalprice > 0 GROUP BY 1, 2),
r AS (SELECT min(year(o_orderdate)) AS low, max(year(o_orderdate)) AS high FROM orders),
g AS (SELECT c_custkey AS entity, CAST(unnest(range(low, high + 1)) AS INTEGER) AS period FROM customer, r)
SELECT g.entity, g.period, e.shares, CAST(e.effective AS INTEGER) AS effective, CASE WHEN e.shares IS NULL THEN 'missing_prior_event' ELSE 'carried_forward' END AS status
FROM g ASOF LEFT JOIN e ON e.entity = g.entity AND e.effective <= g.period""",
)
def _(spark, sf):
    ev = table(spark, sf, "orders").where("o_orderpriority = '1-URGENT'").select(
        F.col("o_custkey").alias("entity"), F.year("o_orderdate").alias("effective"), "o_orderkey", F.col("o_totalprice").alias("shares")
    )
    span = table(spark, sf, "orders").agg(F.min(F.year("o_orderdate")).alias("low"), F.max(F.year("o_orderdate")).alias("high"))
    customers = table(spark, sf, "customer").select(F.col("c_custkey").alias("entity"))
    # one row
    grid = customers.join(F.broadcast(span)).select("entity", F.explode(F.sequence("low", "high")).alias("period"))
    return B.carry_forward(ev, grid, "entity", "period", "effective", "o_orderkey", "shares")


def _members(spark, sf):
    s = table(spark, sf, "supplier")
    return s.select(
        F.col("s_suppkey").alias("entity"), (F.col("s_acctbal") > 5000).alias("is_public"), (F.col("s_acctbal") > 0).alias("is_training")
    )


@query(
    "membership_split",
    f"""WITH {P.YEARS}, m AS (SELECT s_suppkey AS entity, s_acctbal > 5000 AS p, s_acctbal > 0 AS t FROM supplier)
SELECT y.entity, y.period, coalesce(p, FALSE) AS is_public, coalesce(t, FALSE) AS is_training, CASE WHEN p THEN 'public' WHEN t THEN 'training_only' ELSE 'unknown' END AS universe_source
FROM years y LEFT JOIN m USING (entity)""",
)
def _(spark, sf):
    out = B.membership_split(P.supplier_year(spark, sf), _members(spark, sf), "entity")
    return out.select("entity", "period", "is_public", "is_training", "universe_source")


@query(
    "missing_members",
    "SELECT c_custkey AS user_id FROM customer WHERE c_custkey NOT IN (SELECT user_id FROM events)",
)
def _(spark, sf):
    members = table(spark, sf, "customer").select(F.col("c_custkey").alias("user_id"))
    return B.missing_members(table(spark, sf, "events"), members, "user_id")


@query(
    "universe_sets",
    """WITH e AS (SELECT DISTINCT o_custkey AS id FROM orders WHERE o_totalprice > 300000), x AS (SELECT DISTINCT user_id AS id FROM events), p AS (SELECT c_custkey AS id FROM customer WHERE c_acctbal > 8000),
n AS (SELECT id FROM e EXCEPT SELECT id FROM x)
SELECT id, 'new' AS role FROM n UNION ALL SELECT id, 'conflict' FROM n WHERE id IN (SELECT id FROM p) UNION ALL SELECT id, 'common' FROM e WHERE id IN (SELECT id FROM x)""",
)
def _(spark, sf):
    e = table(spark, sf, "orders").where("o_totalprice > 300000").select(F.col("o_custkey").alias("id"))
    x = table(spark, sf, "events").select(F.col("user_id").alias("id"))
    p = table(spark, sf, "customer").where("c_acctbal > 8000").select(F.col("c_custkey").alias("id"))
    return B.universe_sets(e, x, p, "id")


@query(
    "lag_columns",
    f"WITH {P.MONTHS} SELECT a.entity, a.period, a.revenue, b.revenue AS revenue_lag, b.returned AS returned_lag FROM months a LEFT JOIN months b ON b.entity = a.entity AND b.period = a.period - 1",
)
def _(spark, sf):
    out = B.lag_columns(P.supplier_month(spark, sf), "entity", "period", ["revenue", "returned"])
    return out.select("entity", "period", "revenue", "revenue_lag", "returned_lag")


@query(
    "listed_rows",
    f"""WITH {P.YEARS}, q AS (SELECT l_suppkey AS entity, min(year(l_shipdate)) AS f FROM lineitem WHERE l_tax = 0.08 AND l_discount = 0.1 GROUP BY 1)
SELECT y.entity, y.period, y.revenue FROM years y JOIN q USING (entity) WHERE y.period >= q.f""",
)
def _(spark, sf):
    q = table(spark, sf, "lineitem").where("l_tax = 0.08 and l_discount = 0.1").select(F.col("l_suppkey").alias("entity"), F.year("l_shipdate").alias("qy"))
    return B.listed_rows(P.supplier_year(spark, sf), q, "entity", "period", "qy").select("entity", "period", "revenue")


@query(
    "derive_alt_targets",
    f"""WITH {P.YEARS}, n AS (SELECT a.entity, a.period AS year, (b.revenue / a.revenue - 1) * 100 AS nominal FROM years a LEFT JOIN years b ON b.entity = a.entity AND b.period = a.period + 1),
cpi AS (SELECT period AS year, round(avg(tax) * 100, 6) AS cpi FROM years WHERE period <> 1996 GROUP BY 1), fx AS (SELECT period AS year, round(avg(discount), 6) AS q FROM years WHERE period <> 1999 GROUP BY 1)
SELECT n.entity, n.year, CAST(n.year + 1 AS INTEGER) AS target_year, round(nominal, 6) AS nominal, round(((1 + nominal / 100) / (1 + cpi / 100) - 1) * 100, 6) AS real_return,
 round(((1 + nominal / 100) * f0.q / f1.q - 1) * 100, 6) AS fx_return,
 CASE WHEN nominal IS NULL THEN 'missing_nominal_target' WHEN cpi IS NULL THEN 'missing_cpi_target_year' ELSE 'derived' END AS real_status,
 CASE WHEN nominal IS NULL THEN 'missing_nominal_target' WHEN f0.q IS NULL THEN 'missing_fx_start_year' WHEN f1.q IS NULL THEN 'missing_fx_target_year' ELSE 'derived' END AS fx_status
FROM n LEFT JOIN cpi ON cpi.year = n.year + 1 LEFT JOIN fx f0 ON f0.year = n.year LEFT JOIN fx f1 ON f1.year = n.year + 1""",
)
def _(spark, sf):
    y = P.supplier_year(spark, sf)
    nominal = B.next_period_target(y, "entity", "period", "revenue").select(
        "entity", F.col("period").alias("year"), ((F.try_divide("target", "revenue") - 1) * 100).alias("nominal")
    )
    cpi = y.where("period <> 1996").groupBy(F.col("period").alias("year")).agg(F.round(F.avg("tax") * 100, 6).alias("cpi_pct"))
    fx = y.where("period <> 1999").groupBy(F.col("period").alias("year")).agg(F.round(F.avg("discount"), 6).alias("quote"))
    return rounded(B.alt_targets(nominal, cpi, fx))


_TRANS = f"""WITH {P.YEARS}, t AS (
  SELECT entity, 'revenue' AS feature, lag(period) OVER w AS from_period, period AS to_period, lag(revenue) OVER w AS old_value, revenue AS new_value FROM years WINDOW w AS (PARTITION BY entity ORDER BY period)
  UNION ALL SELECT entity, 'returned', lag(period) OVER w, period, lag(returned) OVER w, returned FROM years WINDOW w AS (PARTITION BY entity ORDER BY period)),
tr AS (SELECT *, round(new_value - old_value, 4) AS abs_change, round((new_value - old_value) / nullif(abs(old_value), 0), 9) AS pct_change FROM t WHERE from_period IS NOT NULL)"""


@query("period_transitions", f"{_TRANS} SELECT * FROM tr")
def _(spark, sf):
    t = B.period_transitions(P.supplier_year(spark, sf), "entity", "period", ["revenue", "returned"])
    return t.withColumns({"abs_change": F.round("abs_change", 4), "pct_change": F.round("pct_change", 9)})


@query("latest_transitions", f"{_TRANS} SELECT entity, to_period, feature, abs_change FROM tr QUALIFY to_period = max(to_period) OVER (PARTITION BY entity)")
def _(spark, sf):
    t = B.period_transitions(P.supplier_year(spark, sf), "entity", "period", ["revenue", "returned"])
    return rounded(B.latest_transitions(t, "entity").select("entity", "to_period", "feature", "abs_change"), 4)


@query(
    "target_key_mismatch",
    f"""WITH {P.YEARS}, t AS (SELECT entity, period - 1 AS period FROM years)
SELECT count(*) FILTER (WHERE t.entity IS NULL) AS only_left, count(*) FILTER (WHERE y.entity IS NULL) AS only_right, count(*) FILTER (WHERE y.entity IS NOT NULL AND t.entity IS NOT NULL) AS "both"
FROM years y FULL JOIN t ON t.entity = y.entity AND t.period = y.period""",
)
def _(spark, sf):
    y = P.supplier_year(spark, sf)
    return B.key_mismatch(y, y.select("entity", (F.col("period") - 1).alias("period")), ["entity", "period"])


@query(
    "attach_target_exact",
    f"WITH {P.YEARS} SELECT entity, period, revenue, round(quantity / lines, 9) AS target FROM years",
)
def _(spark, sf):
    y = P.supplier_year(spark, sf)
    t = y.select("entity", "period", (F.col("quantity") / F.col("lines")).alias("q"))
    out = B.attach_target(y.select("entity", "period", "revenue"), t, ["entity", "period"], "q", "target")
    return rounded(out, 9)


@query(
    "inject_partial_target",
    f"""WITH {P.TARGETS}, mx AS (SELECT max(period) AS p FROM months)
SELECT t.entity, t.period, CASE WHEN t.period = 23987 THEN s.s_acctbal ELSE t.target END AS target, (CASE WHEN t.period = 23987 THEN s.s_acctbal ELSE t.target END) IS NOT NULL AS has_target
FROM targets t LEFT JOIN (SELECT * FROM supplier WHERE s_acctbal > 0) s ON s.s_suppkey = t.entity""",
)
def _(spark, sf):
    part = table(spark, sf, "supplier").where("s_acctbal > 0").select(F.col("s_suppkey").alias("entity"), F.col("s_acctbal").alias("partial"))
    out = B.inject_partial_target(P.targets(spark, sf), part, "entity", "period", 23987, "target")
    return out.select("entity", "period", "target", "has_target")


@query(
    "target_window_policy",
    f"""WITH {P.TARGETS}, s AS (SELECT period, count(target) AS n_targets FROM targets GROUP BY 1)
SELECT period, n_targets, CASE WHEN period <= 23980 AND n_targets > 0 THEN 'finalized' WHEN period = 23981 AND n_targets > 0 THEN 'partial' ELSE 'excluded' END AS role,
CASE WHEN (period <= 23980 AND n_targets > 0) OR (period = 23981 AND n_targets > 0) THEN NULL WHEN n_targets = 0 THEN 'no_target' ELSE 'inference_only' END AS reason FROM s""",
)
def _(spark, sf):
    return B.training_periods(P.targets(spark, sf), "period", "target", 23980, 23981, True)


_VAL_SQL = f"""WITH {P.STATEMENTS}, v0 AS (SELECT entity, period, operating_income AS price, inventory AS shares, net_income, total_equity AS equity, operating_cash_flow AS ebitda, total_liabilities - cash AS net_debt FROM stmt),
v1 AS (SELECT *, CASE WHEN round(price * (shares / 1000), 4) > 0 THEN round(price * (shares / 1000), 4) END AS market_cap FROM v0),
v2 AS (SELECT *, CASE WHEN net_income > 0 THEN round(market_cap / net_income, 4) END AS pe0, CASE WHEN equity > 0 AND period <> 1998 THEN round(market_cap / equity, 4) END AS pb0, CASE WHEN period <> 1998 THEN round(market_cap + net_debt, 4) END AS ev FROM v1),
v3 AS (SELECT *, CASE WHEN ebitda > 0 THEN round(ev / ebitda, 4) END AS ee0 FROM v2),
v4 AS (SELECT *, CASE WHEN abs(pe0) <= 1000 THEN pe0 END AS pe, CASE WHEN abs(pb0) <= 100 THEN pb0 END AS pb, CASE WHEN abs(ee0) <= 500 THEN ee0 END AS ev_ebitda FROM v3),
v5 AS (SELECT *, CASE WHEN price IS NULL THEN 'missing_price' WHEN shares IS NULL THEN 'missing_shares' WHEN market_cap IS NULL THEN 'non_positive' END AS cap_reason,
 CASE WHEN market_cap IS NULL THEN 'missing_market_cap' WHEN net_income IS NULL THEN 'missing_net_income' WHEN net_income <= 0 THEN 'non_positive_net_income' WHEN pe IS NULL THEN 'absurd_value' END AS pe_reason,
 CASE WHEN market_cap IS NULL THEN 'missing_market_cap' WHEN equity IS NULL THEN 'missing_equity' WHEN period = 1998 THEN 'suspect_equity' WHEN equity <= 0 THEN 'non_positive_equity' WHEN pb IS NULL THEN 'absurd_value' END AS pb_reason,
 CASE WHEN market_cap IS NULL THEN 'missing_market_cap' WHEN net_debt IS NULL THEN 'missing_net_debt' WHEN period = 1998 THEN 'suspect_net_debt' END AS ev_reason,
 CASE WHEN ev IS NULL THEN 'missing_enterprise_value' WHEN ebitda IS NULL THEN 'missing_ebitda' WHEN ebitda <= 0 THEN 'non_positive_ebitda' WHEN ev_ebitda IS NULL THEN 'absurd_value' END AS ev_ebitda_reason FROM v4)"""


def _valued(spark, sf):
    s = P.statements(spark, sf).select(
        "entity",
        "period",
        F.col("operating_income").alias("price"),
        (F.col("inventory") / 1000).alias("shares"),
        "net_income",
        F.col("total_equity").alias("equity"),
        F.col("operating_cash_flow").alias("ebitda"),
        (F.col("total_liabilities") - F.col("cash")).alias("net_debt"),
    )
    return B.valuation(s, F.col("period") == 1998)


_VAL_COLS = ["entity", "period", "market_cap", "pe", "pb", "ev", "ev_ebitda", "cap_reason", "pe_reason", "pb_reason", "ev_reason", "ev_ebitda_reason"]


@query(
    "valuation_history",
    f"{_VAL_SQL} SELECT entity, period, round(market_cap, 5) AS market_cap, round(pe, 5) AS pe, round(pb, 5) AS pb, round(ev, 5) AS ev, round(ev_ebitda, 5) AS ev_ebitda, cap_reason, pe_reason, pb_reason, ev_reason, ev_ebitda_reason FROM v5",
)
def _(spark, sf):
    return rounded(_valued(spark, sf).select(*_VAL_COLS), 5)


@query(
    "valuation_rejections",
    _VAL_SQL
    + ", l AS ("
    + " UNION ALL ".join(f"SELECT '{c}' AS column_name, {c} AS reason FROM v5" for c in ("cap_reason", "pe_reason", "pb_reason", "ev_reason", "ev_ebitda_reason"))
    + ") SELECT column_name, reason, count(*) AS n FROM l WHERE reason IS NOT NULL GROUP BY 1, 2",
)
def _(spark, sf):
    return B.rejection_counts(_valued(spark, sf))


@query(
    "next_period_label",
    f"""WITH {P.STATEMENTS}, l AS (SELECT entity, period, lead(period) OVER w AS next_period, lead(net_income) OVER w AS nx, net_income, inventory FROM stmt WINDOW w AS (PARTITION BY entity ORDER BY period))
SELECT entity, period, next_period, CAST(nx > net_income AND (inventory IS NULL OR inventory > 50000) AS INTEGER) AS label FROM l WHERE nx IS NOT NULL""",
)
def _(spark, sf):
    s = P.statements(spark, sf).withColumn("ret", F.col("inventory") - 50000)
    return B.next_period_label(s, "entity", "period", "net_income", "ret").select("entity", "period", "next_period", "label")


@query(
    "estimand_rank_invariance",
    f"""WITH {P.TARGETS}, b AS (SELECT period AS target_period, round(avg(revenue), 4) AS bench FROM months GROUP BY 1),
e AS (SELECT t.entity, t.period, target, round(target - bench, 4) AS ex FROM targets t JOIN b USING (target_period) WHERE target IS NOT NULL),
r AS (SELECT *, round(target - ex, 6) AS gap, rank() OVER (PARTITION BY period ORDER BY target DESC) AS ra, rank() OVER (PARTITION BY period ORDER BY ex DESC) AS rb FROM e)
SELECT period, count(*) AS n, round(max(gap) - min(gap), 4) AS subtrahend_spread, round(avg(gap), 4) AS subtrahend, count(*) FILTER (WHERE ra <> rb) AS rank_mismatches FROM r GROUP BY 1""",
)
def _(spark, sf):
    out = B.benchmark_excess(P.targets(spark, sf), _bench(spark, sf), "target_period", "target", "bench")
    out = out.withColumn("excess", F.round("excess", 4))
    return rounded(B.rank_invariance(out, ["entity", "period"], "period", "target", "excess"), 4)


@query(
    "common_periods",
    f"""WITH {P.MONTHS}, ids AS (SELECT s_suppkey AS entity FROM supplier WHERE s_nationkey = 3)
SELECT period, count(DISTINCT entity) AS n_entities FROM months WHERE entity IN (SELECT entity FROM ids) GROUP BY 1 HAVING count(DISTINCT entity) = (SELECT count(*) FROM ids)""",
)
def _(spark, sf):
    ids = P.sectors(spark, sf).where("sector = 3")
    return B.common_periods(P.supplier_month(spark, sf), ids, "entity", "period")


@query(
    "search_entities",
    "SELECT p_partkey, p_name, p_brand, p_type FROM part WHERE (p_name ILIKE '%red%' OR p_type ILIKE '%red%') AND p_partkey IN (SELECT l_partkey FROM lineitem WHERE l_returnflag = 'R') ORDER BY p_partkey LIMIT 25",
)
def _(spark, sf):
    p = table(spark, sf, "part").select("p_partkey", "p_name", "p_brand", "p_type")
    members = table(spark, sf, "lineitem").where("l_returnflag = 'R'").select(F.col("l_partkey").alias("p_partkey"))
    return B.search(p.join(members, "p_partkey", "left_semi"), ["p_name", "p_type"], "red", "p_partkey", 25)


_NEW = "SELECT s_suppkey FROM supplier WHERE s_nationkey < 12"


@query(
    "append_cohort",
    f"""WITH {P.YEARS}, base AS (SELECT * FROM years WHERE entity IN ({_NEW})), co AS (SELECT * FROM years WHERE entity NOT IN (SELECT entity FROM base)),
n AS (SELECT a.entity, a.period, a.revenue, b.revenue AS target, CAST(a.period + 1 AS INTEGER) AS target_period FROM co a LEFT JOIN co b ON b.entity = a.entity AND b.period = a.period + 1)
SELECT entity, period, revenue, NULL AS target, NULL AS target_period, NULL AS target_rank, NULL AS target_pct FROM base
UNION ALL SELECT entity, period, revenue, target, target_period, CASE WHEN target IS NOT NULL THEN rank() OVER (PARTITION BY target_period ORDER BY target DESC NULLS LAST) END,
 round({P.sql_pct('target', 'target_period')} * 100, 6) FROM n""",
)
def _(spark, sf):
    y = P.supplier_year(spark, sf).select("entity", "period", "revenue")
    base = y.join(P.sectors(spark, sf).where("sector < 12"), "entity", "left_semi")
    out = B.append_cohort(base, y, "entity", "period", "revenue")
    return rounded(out.select("entity", "period", "revenue", "target", "target_period", "target_rank", "target_pct"))


@query(
    "assemble_panel",
    f"""WITH {P.YEARS}, {_YB}, r AS (SELECT a.entity, a.period AS year, (a.revenue / b.revenue - 1) * 100 AS return_pct FROM years a LEFT JOIN years b ON b.entity = a.entity AND b.period = a.period - 1),
t AS (SELECT a.entity, a.year, b.return_pct AS next_return FROM r a LEFT JOIN r b ON b.entity = a.entity AND b.year = a.year + 1)
SELECT y.entity, y.period AS year, y.revenue, s.sector, round(t.next_return, 6) AS next_return, yb.benchmark_return AS next_benchmark, round(t.next_return - yb.benchmark_return, 6) AS next_excess,
 t.next_return - yb.benchmark_return > 0 AS next_outperform, t.next_return IS NOT NULL AS has_target, t.next_return IS NULL AS is_inference, round(r.return_pct, 6) AS momentum_1y
FROM years y LEFT JOIN t ON t.entity = y.entity AND t.year = y.period LEFT JOIN (SELECT s_suppkey AS entity, s_nationkey AS sector FROM supplier) s ON s.entity = y.entity
LEFT JOIN yb ON yb.year = y.period + 1 LEFT JOIN r ON r.entity = y.entity AND r.year = y.period""",
)
def _(spark, sf):
    prices = _yearly_prices(spark, sf)
    feats = P.supplier_year(spark, sf).select("entity", F.col("period").alias("year"), "revenue")
    out = B.assemble_panel(
        feats, B.yearly_return_prev(prices), P.sectors(spark, sf), _year_bench(spark, sf), B.yearly_price_features(prices).select("entity", "year", "momentum_1y")
    )
    return rounded(
        out.select("entity", "year", "revenue", "sector", "next_return", "next_benchmark", "next_excess", "next_outperform", "has_target", "is_inference", "momentum_1y")
    )


@query(
    "year_overview",
    f"""WITH {P.YEARS}, b AS (SELECT period, max(quantity) AS best_return, arg_max(entity, (quantity, -entity)) AS best_entity, count(quantity) AS n_returns, round(avg(quantity), 6) AS benchmark FROM years GROUP BY 1)
SELECT y.entity, y.period, rank() OVER (PARTITION BY y.period ORDER BY revenue DESC) AS score_rank, rank() OVER (PARTITION BY y.period ORDER BY quantity DESC) AS return_rank,
 best_entity, best_return - quantity AS gap_to_best, round(quantity - benchmark, 6) AS excess, n_returns FROM years y JOIN b USING (period)""",
)
def _(spark, sf):
    y = P.supplier_year(spark, sf).select("entity", "period", "revenue", "quantity")
    bench = y.groupBy("period").agg(F.round(F.avg("quantity"), 6).alias("benchmark"))
    out = B.year_overview(y, "entity", "period", "revenue", "quantity", bench)
    return rounded(out.select("entity", "period", "score_rank", "return_rank", "best_entity", "gap_to_best", "excess", "n_returns"))
