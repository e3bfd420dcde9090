"""Queries: point-in-time operators on daily prices, late publications and event streams."""

from pyspark.sql import functions as F

from strataloom.operators import panel as B
from strataloom.operators import pointintime as T
from strataloom.operators.asof import asof_join
from strataloom.plans import panels as P
from strataloom.plans.registry import query, rounded, table

JUMP = 60.0


def _years(spark, sf, column):
    """One row a year of the ship dates, from the first to the last."""
    bounds = table(spark, sf, "lineitem").agg(F.min(F.year("l_shipdate")).alias("lo"), F.max(F.year("l_shipdate")).alias("hi"))
    return bounds.select(F.lit(1).alias("__all"), F.explode(F.sequence("lo", "hi")).alias(column))


def _per_year(spark, sf, rows, column):
    """Every row once a year; years are bounded by the calendar."""
    return rows.withColumn("__all", F.lit(1)).join(F.broadcast(_years(spark, sf, column)), "__all").drop("__all")


def _grid(spark, sf):
    s = table(spark, sf, "supplier").select(F.col("s_suppkey").alias("symbol"))
    g = _per_year(spark, sf, s, "fiscal_year")
    return g.withColumns({"cutoff": T.uniform_cutoff(F.col("fiscal_year")), "next_cutoff": T.uniform_cutoff(F.col("fiscal_year") + 1)})


_Y = "(SELECT unnest(range(min(year(l_shipdate)), max(year(l_shipdate)) + 1)) AS y FROM lineitem)"
_G = f"""g AS (SELECT s_suppkey AS symbol, CAST(y AS INTEGER) AS fiscal_year, make_date(y + 1, 5, 31) AS cutoff, make_date(y + 2, 5, 31) AS next_cutoff FROM supplier, {_Y} t(y))"""
_J = f"""jumps AS (SELECT symbol, date, move FROM (SELECT symbol, date, close / lag(close) OVER (PARTITION BY symbol ORDER BY date) - 1 AS move FROM prices) WHERE abs(move) > {JUMP})"""


@query(
    "last_on_or_before",
    f"""WITH {P.PRICES}, {_G}, j AS (SELECT g.symbol, fiscal_year, p.date, p.close, cutoff FROM g ASOF LEFT JOIN prices p ON p.symbol = g.symbol AND p.date <= g.cutoff)
SELECT symbol, fiscal_year, CASE WHEN date >= cutoff - INTERVAL 7 DAY THEN date END AS quote_date, CASE WHEN date >= cutoff - INTERVAL 7 DAY THEN close END AS close FROM j""",
)
def _(spark, sf):
    out = T.last_on_or_before(_grid(spark, sf), P.daily_prices(spark, sf), "cutoff", prefix="q_")
    return out.select("symbol", "fiscal_year", F.col("q_date").alias("quote_date"), F.col("q_close").alias("close"))


@query(
    "first_after",
    f"""WITH {P.PRICES}, {_G}, j AS (SELECT g.symbol, fiscal_year, p.date, p.close, cutoff FROM g ASOF LEFT JOIN prices p ON p.symbol = g.symbol AND p.date > g.cutoff)
SELECT symbol, fiscal_year, CASE WHEN date <= cutoff + INTERVAL 7 DAY THEN date END AS quote_date, CASE WHEN date <= cutoff + INTERVAL 7 DAY THEN close END AS close FROM j""",
)
def _(spark, sf):
    out = T.first_after(_grid(spark, sf), P.daily_prices(spark, sf), "cutoff", prefix="q_")
    return out.select("symbol", "fiscal_year", F.col("q_date").alias("quote_date"), F.col("q_close").alias("close"))


@query(
    "asof_events",
    """WITH r AS (SELECT user_id, ts, max(value) AS value FROM events WHERE event_type = 'view' GROUP BY 1, 2), l AS (SELECT event_id, user_id, ts FROM events WHERE event_type = 'purchase'),
j AS (SELECT l.event_id, l.user_id, l.ts, r.ts AS view_ts, r.value AS view_value FROM l ASOF LEFT JOIN r ON r.user_id = l.user_id AND r.ts < l.ts)
SELECT event_id, user_id, CASE WHEN view_ts >= ts - INTERVAL 1 DAY THEN view_value END AS view_value, CASE WHEN view_ts >= ts - INTERVAL 1 DAY THEN view_ts END AS view_ts FROM j""",
)
def _(spark, sf):
    e = table(spark, sf, "events")
    right = e.where("event_type = 'view'").groupBy("user_id", F.col("ts").alias("view_ts")).agg(F.max("value").alias("view_value"))
    left = e.where("event_type = 'purchase'").select("event_id", "user_id", "ts")
    out = asof_join(left, right, ["user_id"], "ts", "view_ts", ["view_value"], allow_exact=False, tolerance="1 day", bucket="day")
    return out.select("event_id", "user_id", "view_value", "view_ts")


_SF = """sfac AS (SELECT p.symbol, p.date, p.close, coalesce(product(s.ratio), 1.0) AS split_factor FROM prices p LEFT JOIN splits s ON s.symbol = p.symbol AND s.ex_date > p.date GROUP BY 1, 2, 3)"""


@query("split_factor_after", f"WITH {P.PRICES}, {P.SPLITS}, {_SF} SELECT symbol, date, split_factor FROM sfac")
def _(spark, sf):
    return T.split_factor(P.daily_prices(spark, sf), P.split_events(spark, sf), "date").select("symbol", "date", "split_factor")


@query("quoted_close", f"WITH {P.PRICES}, {P.SPLITS}, {_SF} SELECT symbol, date, round(close * split_factor, 2) AS quoted_close FROM sfac")
def _(spark, sf):
    return rounded(T.quoted_close(P.daily_prices(spark, sf), P.split_events(spark, sf)).select("symbol", "date", "quoted_close"), 2)


def _jumps(spark, sf):
    return T.jump_days(P.daily_prices(spark, sf), "close", JUMP)


@query("jump_days", f"WITH {P.PRICES}, {_J} SELECT symbol, date, round(move, 6) AS move FROM jumps")
def _(spark, sf):
    return rounded(_jumps(spark, sf))


@query(
    "window_has_jump",
    f"WITH {P.PRICES}, {_J}, {_G} SELECT symbol, fiscal_year, EXISTS (SELECT 1 FROM jumps j WHERE j.symbol = g.symbol AND j.date > g.cutoff AND j.date <= g.next_cutoff) AS has_jump FROM g",
)
def _(spark, sf):
    return T.window_has_jump(_grid(spark, sf), _jumps(spark, sf), "cutoff", "next_cutoff").select("symbol", "fiscal_year", "has_jump")


def _asof_sql(alias: str, at: str) -> str:
    return f"""{alias} AS (SELECT g.symbol, g.fiscal_year, CASE WHEN p.date >= {at} - INTERVAL 7 DAY THEN p.date END AS date, CASE WHEN p.date >= {at} - INTERVAL 7 DAY THEN p.close END AS close FROM g ASOF LEFT JOIN prices p ON p.symbol = g.symbol AND p.date <= {at})"""


def _jump_in(a: str, b: str) -> str:
    return f"EXISTS (SELECT 1 FROM jumps j WHERE j.symbol = g.symbol AND j.date > {a} AND j.date <= {b})"


_RET = (
    _asof_sql("e", "g.cutoff")
    + ", "
    + _asof_sql("s1", "(g.cutoff - INTERVAL 365 DAY)")
    + f""", ret AS (SELECT g.symbol, g.fiscal_year, CASE WHEN NOT {_jump_in('s1.date', 'e.date')} THEN (e.close / s1.close - 1) * 100 END AS momentum_1y
 FROM g JOIN e USING (symbol, fiscal_year) JOIN s1 USING (symbol, fiscal_year))"""
)


@query("trailing_return", f"WITH {P.PRICES}, {_J}, {_G}, {_RET} SELECT symbol, fiscal_year, round(momentum_1y, 6) AS momentum_1y FROM ret")
def _(spark, sf):
    out = T.trailing_return(_grid(spark, sf), P.daily_prices(spark, sf), _jumps(spark, sf), "cutoff", 1, "momentum_1y")
    return rounded(out.select("symbol", "fiscal_year", "momentum_1y"))


_DD = f"""f AS (SELECT symbol, min(date) AS first FROM prices GROUP BY 1), dd AS (SELECT g.symbol, g.fiscal_year, CASE WHEN NOT {_jump_in("greatest(CAST(g.cutoff - INTERVAL 1095 DAY AS DATE), f.first)", "e.date")} THEN
 (e.close / (SELECT max(close) FROM prices p WHERE p.symbol = g.symbol AND p.date BETWEEN g.cutoff - INTERVAL 1095 DAY AND e.date) - 1) * 100 END AS drawdown_3y FROM g JOIN e USING (symbol, fiscal_year) JOIN f USING (symbol) WHERE e.date IS NOT NULL
 UNION ALL SELECT symbol, fiscal_year, NULL FROM e WHERE date IS NULL)"""


@query("drawdown_from_high", f"WITH {P.PRICES}, {_J}, {_G}, {_asof_sql('e', 'g.cutoff')}, {_DD} SELECT symbol, fiscal_year, round(drawdown_3y, 6) AS drawdown_3y FROM dd")
def _(spark, sf):
    out = T.drawdown_from_high(_grid(spark, sf), P.daily_prices(spark, sf), _jumps(spark, sf), "cutoff", 3, "drawdown_3y")
    return rounded(out.select("symbol", "fiscal_year", "drawdown_3y"))


_TW = (
    """en AS (SELECT g.symbol, g.fiscal_year, CASE WHEN p.date <= g.cutoff + INTERVAL 7 DAY THEN p.date END AS date, CASE WHEN p.date <= g.cutoff + INTERVAL 7 DAY THEN p.close END AS close FROM g ASOF LEFT JOIN prices p ON p.symbol = g.symbol AND p.date > g.cutoff), """
    + _asof_sql("ex", "g.next_cutoff")
    + f""", lf AS (SELECT symbol, min(date) AS first, max(date) AS last FROM prices GROUP BY 1), tw0 AS (SELECT g.symbol, g.fiscal_year, en.date AS entry_date, ex.date AS exit_date, (ex.close / en.close - 1) * 100 AS r,
 CASE WHEN lf.first IS NULL OR lf.first > g.cutoff + INTERVAL 7 DAY THEN 'not_listed_at_prediction' WHEN en.date IS NULL THEN 'no_entry_quote' WHEN ex.date IS NULL OR lf.last < g.next_cutoff THEN 'window_incomplete'
 WHEN {_jump_in('en.date', 'ex.date')} THEN 'unexplained_jump_in_window' ELSE 'ok' END AS target_status FROM g JOIN en USING (symbol, fiscal_year) JOIN ex USING (symbol, fiscal_year) LEFT JOIN lf USING (symbol)),
tw AS (SELECT symbol, fiscal_year, CASE WHEN target_status <> 'not_listed_at_prediction' THEN entry_date END AS entry_date, CASE WHEN target_status IN ('ok', 'unexplained_jump_in_window') THEN exit_date END AS exit_date,
 CASE WHEN target_status IN ('ok', 'unexplained_jump_in_window') THEN r END AS target_return_pct, target_status FROM tw0)"""
)


@query("target_window", f"WITH {P.PRICES}, {_J}, {_G}, {_TW} SELECT symbol, fiscal_year, entry_date, exit_date, round(target_return_pct, 6) AS target_return_pct, target_status FROM tw")
def _(spark, sf):
    out = T.target_window(_grid(spark, sf), P.daily_prices(spark, sf), _jumps(spark, sf), "cutoff", "next_cutoff")
    return rounded(out.select("symbol", "fiscal_year", "entry_date", "exit_date", "target_return_pct", "target_status"))


def _shares(spark, sf):
    """Year-end share counts that follow the splits for most suppliers and stay flat for the rest."""
    s = table(spark, sf, "supplier").select(F.col("s_suppkey").alias("symbol"), (F.col("s_acctbal") > 4000).alias("moves"))
    g = _per_year(spark, sf, s, "year")
    g = g.withColumn("ye", F.make_date("year", F.lit(12), F.lit(31)))
    g = T.split_factor(g, P.split_events(spark, sf), "ye", "after")
    return g.select("symbol", "year", F.when(F.col("moves"), 1e6 / F.col("after")).otherwise(1e6).alias("shares"))


_SH = f"""sh AS (SELECT s_suppkey AS symbol, CAST(y AS INTEGER) AS year, CASE WHEN s_acctbal > 4000 THEN 1e6 / (SELECT coalesce(product(ratio), 1.0) FROM splits x WHERE x.symbol = s_suppkey AND x.ex_date > make_date(y, 12, 31)) ELSE 1e6 END AS shares FROM supplier, {_Y} t(y)),
sr AS (SELECT symbol, year(ex_date) AS year, product(ratio) AS r FROM splits GROUP BY 1, 2),
ok AS (SELECT a.symbol, a.year, coalesce(abs(a.shares / b.shares / coalesce(r, 1.0) - 1) <= 0.02, TRUE) AS ok FROM sh a LEFT JOIN sh b ON b.symbol = a.symbol AND b.year = a.year - 1 LEFT JOIN sr ON sr.symbol = a.symbol AND sr.year = a.year),
cons AS (SELECT a.symbol, a.year, a.ok AND coalesce(b.ok, TRUE) AS consistent FROM ok a LEFT JOIN ok b ON b.symbol = a.symbol AND b.year = a.year + 1)"""


@query("share_split_consistency", f"WITH {P.SPLITS}, {_SH} SELECT symbol, year, consistent FROM cons")
def _(spark, sf):
    return T.share_consistency(_shares(spark, sf), P.split_events(spark, sf))


_MV = f"""mv AS (SELECT g.symbol, g.fiscal_year, CASE WHEN sh.shares IS NULL THEN 'no_share_count' WHEN NOT coalesce(consistent, TRUE) THEN 'share_count_disagrees_with_split_history'
 WHEN EXISTS (SELECT 1 FROM jumps j WHERE j.symbol = g.symbol AND j.date > make_date(g.fiscal_year, 12, 31)) THEN 'unexplained_jump_after_year_end' WHEN e.date IS NULL THEN 'no_quote_at_reference_date' ELSE 'ok' END AS market_value_status,
 e.close * (SELECT coalesce(product(ratio), 1.0) FROM splits x WHERE x.symbol = g.symbol AND x.ex_date > make_date(g.fiscal_year, 12, 31)) * sh.shares AS v
 FROM g LEFT JOIN sh ON sh.symbol = g.symbol AND sh.year = g.fiscal_year LEFT JOIN cons ON cons.symbol = g.symbol AND cons.year = g.fiscal_year JOIN e ON e.symbol = g.symbol AND e.fiscal_year = g.fiscal_year)"""


@query(
    "pit_market_value",
    f"WITH {P.PRICES}, {_J}, {_G}, {P.SPLITS}, {_SH}, {_asof_sql('e', 'g.cutoff')}, {_MV} SELECT symbol, fiscal_year, market_value_status, round(CASE WHEN market_value_status = 'ok' THEN v END / 1e6, 4) AS market_value_pit FROM mv",
)
def _(spark, sf):
    out = T.pit_market_value(_grid(spark, sf), P.daily_prices(spark, sf), P.split_events(spark, sf), _shares(spark, sf), _jumps(spark, sf), "cutoff")
    return out.select("symbol", "fiscal_year", "market_value_status", F.round(F.col("market_value_pit") / 1e6, 4).alias("market_value_pit"))


_RAW = f"""rawp AS (SELECT l_suppkey AS symbol, CAST(l_shipdate AS DATE) AS date, max(l_extendedprice) AS close FROM lineitem GROUP BY 1, 2),
rawj AS (SELECT symbol, date, move FROM (SELECT symbol, date, close / lag(close) OVER (PARTITION BY symbol ORDER BY date) - 1 AS move FROM rawp) WHERE abs(move) > {JUMP})"""
_RET2 = (
    _asof_sql("s2", "(g.cutoff - INTERVAL 730 DAY)")
    + f""", ret2 AS (SELECT g.symbol, g.fiscal_year, CASE WHEN NOT {_jump_in('s2.date', 'e.date')} THEN (e.close / s2.close - 1) * 100 END AS momentum_2y
 FROM g JOIN e USING (symbol, fiscal_year) JOIN s2 USING (symbol, fiscal_year))"""
)
_RAW_MV = _MV.replace("FROM jumps j", "FROM rawj j").replace("JOIN e ON e.symbol = g.symbol AND e.fiscal_year", "JOIN re ON re.symbol = g.symbol AND re.fiscal_year").replace("WHEN e.date", "WHEN re.date").replace(" e.close *", " re.close *")


@query(
    "price_panel",
    f"""WITH {P.PRICES.replace('max(l_extendedprice)', 'min(l_extendedprice)')}, {_J}, {_RAW}, {_G}, {P.SPLITS}, {_SH}, {_RET}, {_RET2}, {_DD}, {_TW}, {_asof_sql("re", "g.cutoff").replace("JOIN prices p", "JOIN rawp p")}, {_RAW_MV},
bp AS (SELECT date, round(avg(close), 4) AS close FROM prices GROUP BY 1), c AS (SELECT DISTINCT cutoff FROM g),
be AS (SELECT c.cutoff, CASE WHEN b.date >= c.cutoff - INTERVAL 7 DAY THEN b.close END AS close FROM c ASOF LEFT JOIN bp b ON b.date <= c.cutoff), bs AS (SELECT c.cutoff, CASE WHEN b.date >= c.cutoff - INTERVAL 372 DAY THEN b.close END AS close FROM c ASOF LEFT JOIN bp b ON b.date <= c.cutoff - INTERVAL 365 DAY)
SELECT g.symbol, g.fiscal_year, tw.target_status, tw.entry_date, tw.exit_date, round(tw.target_return_pct, 6) AS target_return_pct, round(ret.momentum_1y, 6) AS momentum_1y, round(ret2.momentum_2y, 6) AS momentum_2y, round(dd.drawdown_3y, 6) AS drawdown_3y,
 mv.market_value_status, round(CASE WHEN market_value_status = 'ok' THEN v END / 1e6, 4) AS market_value_m, round(ret.momentum_1y - (be.close / bs.close - 1) * 100, 6) AS relative_1y
FROM g JOIN tw USING (symbol, fiscal_year) JOIN ret USING (symbol, fiscal_year) JOIN ret2 USING (symbol, fiscal_year) JOIN dd USING (symbol, fiscal_year) JOIN mv USING (symbol, fiscal_year) JOIN be USING (cutoff) JOIN bs USING (cutoff)""",
)
def _(spark, sf):
    li = table(spark, sf, "lineitem")
    days = li.groupBy(F.col("l_suppkey").alias("symbol"), F.to_date("l_shipdate").alias("date"))
    adjusted, raw = days.agg(F.min("l_extendedprice").alias("close")), P.daily_prices(spark, sf)
    bench = adjusted.groupBy("date").agg(F.round(F.avg("close"), 4).alias("close")).withColumn("symbol", F.lit(-1).cast("bigint"))
    jumps, raw_jumps = T.jump_days(adjusted, threshold=JUMP), T.jump_days(raw, threshold=JUMP)
    # the benchmark has no jumps of its own
    out = T.price_panel(
        _grid(spark, sf), adjusted, P.split_events(spark, sf), _shares(spark, sf), jumps, raw, raw_jumps, bench, jumps.where(F.lit(False)), -1
    )
    out = out.withColumn("market_value_m", F.round(F.col("market_value_pit") / 1e6, 4))
    names = ["symbol", "fiscal_year", "target_status", "entry_date", "exit_date", "target_return_pct", "momentum_1y", "momentum_2y"]
    return rounded(out.select(*names, "drawdown_3y", "market_value_status", "market_value_m", "relative_1y"))


@query(
    "cutoff_dates",
    """SELECT DISTINCT CAST(year(o_orderdate) AS INTEGER) AS fiscal_year, make_date(year(o_orderdate) + 1, 5, 31) AS uniform_cutoff, last_day(CAST(o_orderdate AS DATE)) AS deadline_cutoff FROM orders""",
)
def _(spark, sf):
    o = table(spark, sf, "orders")
    y = F.year("o_orderdate")
    return o.select(y.alias("fiscal_year"), T.uniform_cutoff(y).alias("uniform_cutoff"), T.deadline_cutoff(F.to_date("o_orderdate")).alias("deadline_cutoff")).distinct()


@query(
    "statement_availability",
    f"""WITH {P.YEARS}, own AS (SELECT o_custkey AS entity, year(o_orderdate) AS y, max(CAST(o_orderdate AS DATE)) AS d FROM orders WHERE o_orderpriority = '1-URGENT' GROUP BY 1, 2),
gen AS (SELECT year(o_orderdate) AS y, max(CAST(o_orderdate AS DATE)) AS d FROM orders WHERE o_orderpriority = '5-LOW' AND year(o_orderdate) <> 1997 GROUP BY 1)
SELECT f.entity, f.period, coalesce(own.d, gen.d) + INTERVAL '23 hours 59 minutes 59 seconds' AS statement_at FROM years f LEFT JOIN own ON own.entity = f.entity AND own.y = f.period LEFT JOIN gen ON gen.y = f.period""",
)
def _(spark, sf):
    o = table(spark, sf, "orders").withColumns({"period": F.year("o_orderdate"), "d": F.to_date("o_orderdate")})
    own = o.where("o_orderpriority = '1-URGENT'").groupBy(F.col("o_custkey").alias("entity"), "period").agg(F.min("d").alias("solo"), F.max("d").alias("consolidated"))
    gen = o.where("o_orderpriority = '5-LOW' and period <> 1997").groupBy("period").agg(F.min("d").alias("solo"), F.max("d").alias("consolidated"))
    deadlines = own.unionByName(gen.withColumn("entity", F.lit(None).cast("bigint")))
    return T.statement_available_at(P.supplier_year(spark, sf).select("entity", "period"), deadlines, "entity", "period")


def _orders(spark, sf):
    o = table(spark, sf, "orders")
    at = o.select(
        "o_orderkey",
        "o_custkey",
        F.col("o_totalprice").alias("total"),
        F.when(F.col("o_orderstatus") != "P", F.col("o_totalprice") / 2).alias("half"),
        (F.col("o_orderdate") + F.make_dt_interval((F.col("o_orderkey") % 90).cast("int"))).alias("published_at"),
        F.when(F.col("o_orderpriority") != "4-NOT SPECIFIED", F.col("o_orderdate")).alias("closed_at"),
        (F.last_day("o_orderdate").cast("timestamp_ntz") + F.expr("interval 18 hours")).alias("prediction_time"),
    )
    at = at.withColumn("ratio", F.col("half") / F.col("total"))
    return T.feature_available_at(at, {"total": "published_at", "half": "closed_at", "ratio": ["total", "half"]})


_AV = """o AS (SELECT o_orderkey, o_custkey, o_totalprice AS total, CASE WHEN o_orderstatus <> 'P' THEN o_totalprice / 2 END AS half, o_orderdate + to_days(CAST(o_orderkey % 90 AS INTEGER)) AS total_at,
 CASE WHEN o_orderpriority <> '4-NOT SPECIFIED' THEN o_orderdate END AS half_at, last_day(CAST(o_orderdate AS DATE)) + INTERVAL 18 HOUR AS pt FROM orders),
av AS (SELECT *, half / total AS ratio, CASE WHEN total_at IS NOT NULL AND half_at IS NOT NULL THEN greatest(total_at, half_at) END AS ratio_at FROM o)"""


@query("feature_availability", f"WITH {_AV} SELECT o_orderkey, total_at AS total__at, half_at AS half__at, ratio_at AS ratio__at FROM av")
def _(spark, sf):
    return _orders(spark, sf).select("o_orderkey", "total__at", "half__at", "ratio__at")


@query(
    "mask_unavailable",
    f"""WITH {_AV} SELECT o_orderkey, CASE WHEN total_at <= pt THEN total END AS total, CASE WHEN half_at <= pt THEN half END AS half, CASE WHEN ratio_at <= pt THEN ratio END AS ratio,
 CAST(total IS NOT NULL AND NOT coalesce(total_at <= pt, FALSE) AS INTEGER) + CAST(half IS NOT NULL AND NOT coalesce(half_at <= pt, FALSE) AS INTEGER) + CAST(ratio IS NOT NULL AND NOT coalesce(ratio_at <= pt, FALSE) AS INTEGER) AS masked FROM av""",
)
def _(spark, sf):
    return T.mask_unavailable(_orders(spark, sf), ["total", "half", "ratio"], "prediction_time").select("o_orderkey", "total", "half", "ratio", "masked")


@query(
    "pit_violations",
    f"""WITH {_AV}, l AS (SELECT o_orderkey, pt, 'total' AS feature, total AS v, total_at AS a FROM av UNION ALL SELECT o_orderkey, pt, 'half', half, half_at FROM av UNION ALL SELECT o_orderkey, pt, 'ratio', ratio, ratio_at FROM av)
SELECT o_orderkey, pt AS prediction_time, feature, a AS available_at FROM l WHERE v IS NOT NULL AND (a IS NULL OR a > pt)""",
)
def _(spark, sf):
    return T.pit_violations(_orders(spark, sf), ["o_orderkey"], ["total", "half", "ratio"], "prediction_time")


@query(
    "labels_realized",
    """WITH t AS (SELECT max(o_orderdate) AS last_label_end, count(*) FILTER (WHERE o_orderdate IS NULL) AS missing_label_ends FROM orders WHERE o_orderdate < TIMESTAMP '1998-06-01'),
p AS (SELECT min(o_orderdate) AS first_prediction FROM orders WHERE o_orderdate >= TIMESTAMP '1998-06-01')
SELECT last_label_end, missing_label_ends, first_prediction, missing_label_ends = 0 AND last_label_end < first_prediction AS ok FROM t, p""",
)
def _(spark, sf):
    o = table(spark, sf, "orders")
    cut = F.expr("timestamp_ntz '1998-06-01 00:00:00'")
    return T.label_realisation(o.where(F.col("o_orderdate") < cut), o.where(F.col("o_orderdate") >= cut), "o_orderdate", "o_orderdate")


@query(
    "pit_valuation",
    f"""WITH {P.PRICES}, {_J}, {_G}, {P.SPLITS}, {_SH}, {_asof_sql('e', 'g.cutoff')}, {_MV}, {P.STATEMENTS},
d AS (SELECT mv.symbol, mv.fiscal_year, CASE WHEN market_value_status = 'ok' AND v > 0 THEN v END AS cap, net_income, total_equity AS equity, operating_cash_flow AS ebitda, total_liabilities - cash AS net_debt, inventory FROM mv JOIN stmt ON stmt.entity = mv.symbol AND stmt.period = mv.fiscal_year),
x AS (SELECT *, CASE WHEN inventory IS NOT NULL THEN cap + net_debt END AS ev FROM d)
SELECT symbol, fiscal_year, round(cap / 1e6, 3) AS cap_m, round(CASE WHEN inventory IS NOT NULL AND net_income > 0 AND abs(cap / net_income) <= 1000 THEN cap / net_income END, 4) AS pe_ratio,
 round(CASE WHEN inventory IS NOT NULL AND equity > 0 AND abs(cap / equity) <= 100 THEN cap / equity END, 4) AS pb_ratio, round(CASE WHEN inventory IS NOT NULL AND ebitda > 0 AND abs(ev / ebitda) <= 500 THEN ev / ebitda END, 4) AS ev_ebitda FROM x""",
)
def _(spark, sf):
    mv = T.pit_market_value(_grid(spark, sf), P.daily_prices(spark, sf), P.split_events(spark, sf), _shares(spark, sf), _jumps(spark, sf), "cutoff")
    s = P.statements(spark, sf).select(
        F.col("entity").alias("symbol"),
        F.col("period").alias("fiscal_year"),
        "net_income",
        F.col("total_equity").alias("equity"),
        F.col("operating_cash_flow").alias("ebitda"),
        (F.col("total_liabilities") - F.col("cash")).alias("net_debt"),
        *[F.col("inventory").alias(f"{c}_published") for c in ("pe", "pb", "ev", "ev_ebitda")],
    )
    out = T.pit_valuation(mv.join(s, ["symbol", "fiscal_year"]))
    return out.select(
        "symbol", "fiscal_year", F.round(F.col("market_cap") / 1e6, 3).alias("cap_m"), *[F.round(c, 4).alias(c) for c in ("pe_ratio", "pb_ratio", "ev_ebitda")]
    )


@query(
    "pit_panel",
    f"""WITH {P.PRICES}, {_J}, {_G}, {_TW}, {P.STATEMENTS}, x AS (SELECT tw.symbol, tw.fiscal_year, tw.target_return_pct, s.net_income, s.inventory, tw.entry_date + INTERVAL 18 HOUR AS pt,
 make_date(tw.fiscal_year + 1, 6, 1) + to_days(CAST(s.total_assets AS INTEGER) % 9) AS sa FROM tw JOIN stmt s ON s.entity = tw.symbol AND s.period = tw.fiscal_year WHERE target_status = 'ok' AND target_return_pct IS NOT NULL)
SELECT symbol, fiscal_year, round(target_return_pct, 6) AS target_return_pct, CASE WHEN sa <= pt THEN net_income END AS net_income, CASE WHEN sa <= pt THEN inventory END AS inventory,
 CASE WHEN sa <= pt THEN 0 ELSE CAST(net_income IS NOT NULL AS INTEGER) + CAST(inventory IS NOT NULL AS INTEGER) END AS masked FROM x""",
)
def _(spark, sf):
    w = T.target_window(_grid(spark, sf), P.daily_prices(spark, sf), _jumps(spark, sf), "cutoff", "next_cutoff")
    clock = lambda c: F.col(c).cast("timestamp_ntz") + F.expr("interval 18 hours")
    w = w.withColumns({"prediction_time": clock("entry_date"), "label_end": clock("exit_date")})
    s = P.statements(spark, sf).select(
        F.col("entity").alias("symbol"),
        F.col("period").alias("fiscal_year"),
        "net_income",
        "inventory",
        F.date_add(F.make_date(F.col("period") + 1, F.lit(6), F.lit(1)), (F.col("total_assets").cast("int") % 9)).cast("timestamp_ntz").alias("statement_at"),
    )
    out = T.pit_panel(s, w, ["symbol", "fiscal_year"], {"net_income": "statement_at", "inventory": "statement_at"})
    return rounded(out.select("symbol", "fiscal_year", "target_return_pct", "net_income", "inventory", "masked"))


_REG = """reg AS (SELECT o_orderpriority AS regime, make_date(1992 + CAST(substr(o_orderpriority, 1, 1) AS INTEGER), 3, 1) AS start_date, make_date(1993 + CAST(substr(o_orderpriority, 1, 1) AS INTEGER), 1, 31) AS end_date FROM orders GROUP BY ALL)"""


def _regimes(spark, sf):
    d = table(spark, sf, "orders").select(F.col("o_orderpriority").alias("regime")).distinct()
    n = F.substring("regime", 1, 1).cast("int")
    return d.select("regime", F.make_date(n + 1992, F.lit(3), F.lit(1)).alias("start_date"), F.make_date(n + 1993, F.lit(1), F.lit(31)).alias("end_date"))


@query(
    "assign_regime",
    f"WITH {_REG} SELECT o_orderkey, CASE WHEN count(regime) = 1 THEN min(regime) END AS regime, count(regime) AS n_matches FROM orders LEFT JOIN reg ON CAST(o_orderdate AS DATE) BETWEEN start_date AND end_date GROUP BY 1",
)
def _(spark, sf):
    o = table(spark, sf, "orders").select("o_orderkey", F.to_date("o_orderdate").alias("d"))
    return T.interval_join(o, _regimes(spark, sf), "d", "start_date", "end_date", "regime").select("o_orderkey", "regime", "n_matches")


@query(
    "overlapping_regimes",
    f"WITH {_REG} SELECT a.regime, b.regime AS other FROM reg a JOIN reg b ON a.regime < b.regime AND a.start_date <= b.end_date + 60 AND b.start_date <= a.end_date + 60",
)
def _(spark, sf):
    longer = _regimes(spark, sf).withColumn("end_date", F.date_add("end_date", 60))
    return T.overlapping_intervals(longer, "start_date", "end_date", "regime")


@query(
    "macro_context_contract",
    f"""WITH {P.YEARS}, c AS (SELECT entity, period, revenue AS v, CASE WHEN returned IS NOT NULL THEN make_date(CASE WHEN quantity > 1500 THEN period + 1 ELSE period END, 12, 31) END AS d FROM years)
SELECT entity, period, concat_ws(',', CASE WHEN (v IS NOT NULL) <> (d IS NOT NULL) THEN 'cpi_metadata' END, CASE WHEN v IS NOT NULL AND d IS NOT NULL AND year(d) <> period THEN 'cpi_year' END) AS errors FROM c""",
)
def _(spark, sf):
    y = P.supplier_year(spark, sf).select(
        "entity",
        "period",
        F.col("revenue").alias("cpi"),
        F.when(F.col("returned").isNotNull(), F.make_date(F.col("period") + (F.col("quantity") > 1500).cast("int"), F.lit(12), F.lit(31))).alias("d"),
        F.lit("survey").alias("src"),
    )
    return T.metadata_complete(y, [("cpi", "d", "src")], "period").select("entity", "period", F.array_join("errors", ",").alias("errors"))


@query(
    "snapshot_admission",
    """WITH f AS (SELECT l_orderkey, l_linenumber, l_suppkey, l_returnflag, l_extendedprice, l_shipdate AS valid_from, CASE WHEN l_returnflag = 'R' THEN l_shipdate + INTERVAL 400 DAY END AS valid_to,
 l_shipdate + to_days(CAST(l_quantity AS INTEGER)) AS known_at_upper, l_shipdate + to_days(CAST(l_quantity AS INTEGER) + l_linenumber) AS recorded_at FROM lineitem)
SELECT l_suppkey, l_returnflag, l_extendedprice, recorded_at FROM f WHERE valid_from <= TIMESTAMP '1998-03-01' AND (valid_to IS NULL OR TIMESTAMP '1998-03-01' < valid_to) AND known_at_upper <= TIMESTAMP '1998-03-15' AND recorded_at <= TIMESTAMP '1998-03-10'
QUALIFY row_number() OVER (PARTITION BY l_suppkey, l_returnflag ORDER BY recorded_at DESC, l_orderkey * 8 + l_linenumber DESC) = 1""",
)
def _(spark, sf):
    li = table(spark, sf, "lineitem")
    days = lambda n: F.col("l_shipdate") + F.make_dt_interval(n)
    q = F.col("l_quantity").cast("int")
    facts = li.select(
        "l_suppkey",
        "l_returnflag",
        "l_extendedprice",
        F.col("l_shipdate").alias("valid_from"),
        F.when(F.col("l_returnflag") == "R", days(F.lit(400))).alias("valid_to"),
        days(q).alias("known_at_upper"),
        days(q + F.col("l_linenumber")).alias("recorded_at"),
        (F.col("l_orderkey") * 8 + F.col("l_linenumber")).alias("version"),
    )
    at = lambda s: F.expr(f"timestamp_ntz '{s} 00:00:00'")
    out = T.snapshot_facts(facts, ["l_suppkey", "l_returnflag"], at("1998-03-15"), at("1998-03-01"), at("1998-03-10"), "version")
    return out.select("l_suppkey", "l_returnflag", "l_extendedprice", "recorded_at")
