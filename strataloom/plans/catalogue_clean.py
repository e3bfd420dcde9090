"""Queries: sources, ingestion and cleaning."""

from pyspark.sql import functions as F

from strataloom.functions import keys as K
from strataloom.functions import numbers as N
from strataloom.functions import ratios as R
from strataloom.functions import text as X
from strataloom.operators import cleaning as C
from strataloom.operators.ranking import group_quantiles, rank_within, share_below
from strataloom.plans import panels as P
from strataloom.plans.registry import query, rounded, table
from strataloom.sources import ingest as I
from strataloom.sources import panel_files as S
from strataloom.sources import quotes as Q

CSV_LINE = "concat_ws(',', concat(' supplier-', cast(entity as string), ' '), cast(period as string), cast(lines as string))"


@query(
    "read_panel_lines",
    f"WITH {P.YEARS} SELECT 'SUPPLIER-' || entity AS entity, period, lines FROM years WHERE period <> 1995",
)
def _(spark, sf):
    rows = P.supplier_year(spark, sf)
    # the 1995 lines are written as comments and must be skipped
    text = F.concat(F.when(F.col("period") == 1995, "#").otherwise(""), F.expr(CSV_LINE))
    return S.parse_panel_lines(rows.select(text.alias("line")), "line", "entity string, period int, lines bigint", "entity")


@query(
    "best_file_per_period",
    """WITH f AS (SELECT CAST(year(o_orderdate) AS INTEGER) AS period, o_orderpriority AS file, count(*) AS n_rows,
  count(DISTINCT o_orderstatus) AS n_columns FROM orders GROUP BY 1, 2)
SELECT period, file, n_rows, n_columns FROM f
QUALIFY row_number() OVER (PARTITION BY period ORDER BY n_rows DESC, n_columns DESC, file DESC) = 1""",
)
def _(spark, sf):
    o = table(spark, sf, "orders").groupBy(F.year("o_orderdate").alias("period"), F.col("o_orderpriority").alias("file"), "o_orderstatus")
    per = o.agg(F.count(F.lit(1)).alias("c")).groupBy("period", "file")
    files = per.agg(F.sum("c").alias("n_rows"), F.count(F.lit(1)).alias("n_columns"))
    return S.best_file_per_period(files, "period", "file", "n_rows", "n_columns")


@query(
    "year_end_quote",
    f"""WITH {P.PRICES}, b AS (SELECT year(min(date)) - 1 AS lo, year(max(date)) + 1 AS hi FROM prices), g AS (SELECT s_suppkey AS symbol, CAST(y AS INTEGER) AS year, make_date(y, 12, 31) AS at FROM supplier, (SELECT unnest(range(lo, hi + 1)) AS y FROM b))
SELECT g.symbol, g.year, p.date AS quote_date, p.close, p.close AS adjclose,
  CASE WHEN p.close IS NULL THEN 'error' ELSE 'success' END AS status FROM g ASOF LEFT JOIN prices p ON p.symbol = g.symbol AND p.date <= g.at""",
)
def _(spark, sf):
    p = P.daily_prices(spark, sf).withColumn("adjclose", F.lit(None).cast("double"))
    # every year of the data, one before and one after
    bounds = p.agg(F.year(F.min("date")).alias("lo"), F.year(F.max("date")).alias("hi"))
    years = bounds.select(F.lit(1).alias("k"), F.explode(F.expr("sequence(lo - 1, hi + 1)")).alias("year"))
    symbols = table(spark, sf, "supplier").select(F.col("s_suppkey").alias("symbol"), F.lit(1).alias("k"))
    grid = symbols.join(F.broadcast(years), "k").drop("k")
    return Q.year_end_quote(p, ["symbol"], "date", "close", "adjclose", grid)


@query("flatten_quote_documents", f"WITH {P.PRICES} SELECT symbol, date, close, close AS adjclose FROM prices")
def _(spark, sf):
    """Chart documents built from the daily prices, flattened again."""
    p = P.daily_prices(spark, sf).withColumn("sec", F.unix_timestamp(F.col("date").cast("timestamp")))
    # one document per symbol and year: at most 366 quotes
    per = p.groupBy("symbol", F.year("date").alias("y")).agg(F.array_sort(F.collect_list(F.struct("sec", "close"))).alias("q"))
    doc = F.to_json(
        F.struct(
            F.struct(
                F.array(
                    F.struct(
                        F.col("q.sec").alias("timestamp"),
                        F.struct(
                            F.array(F.struct(F.col("q.close").alias("close"))).alias("quote"),
                            F.array(F.struct(F.col("q.close").alias("adjclose"))).alias("adjclose"),
                        ).alias("indicators"),
                    )
                ).alias("result")
            ).alias("chart")
        )
    )
    prices, _ = Q.flatten_quotes(per.select("symbol", doc.alias("body")), "symbol", "body")
    return prices


@query(
    "first_available_source",
    """WITH s AS (
  SELECT l_suppkey AS entity, year(l_shipdate) AS year, l_extendedprice AS price, l_shipdate AS ts, 0 AS source_rank FROM lineitem WHERE l_returnflag = 'R' AND l_quantity >= 49
  UNION ALL SELECT l_suppkey, year(l_shipdate), l_extendedprice, l_shipdate, 1 FROM lineitem WHERE l_returnflag = 'A'
  UNION ALL SELECT l_suppkey, year(l_shipdate), l_extendedprice, l_shipdate, 2 FROM lineitem),
d AS (SELECT entity, CAST(year AS INTEGER) AS year, CAST(source_rank AS INTEGER) AS source_rank, max(ts) AS ts FROM s GROUP BY ALL),
k AS (SELECT d.*, max(s.price) AS price FROM d JOIN s ON s.entity = d.entity AND s.year = d.year AND s.source_rank = d.source_rank AND s.ts = d.ts GROUP BY ALL)
SELECT entity, year, source_rank, price FROM k QUALIFY source_rank = min(source_rank) OVER (PARTITION BY entity)""",
)
def _(spark, sf):
    li = table(spark, sf, "lineitem")
    pick = lambda d: d.select(
        F.col("l_suppkey").alias("entity"), F.year("l_shipdate").alias("year"), F.col("l_extendedprice").alias("price"), F.struct("l_shipdate", "l_extendedprice").alias("at")
    )
    sources = [li.where("l_returnflag = 'R' and l_quantity >= 49"), li.where("l_returnflag = 'A'"), li]
    return S.first_available_source([pick(s) for s in sources], "entity", "year", "price", "at")


@query(
    "load_predictions",
    f"WITH {P.PREDICTIONS} SELECT * FROM preds",
)
def _(spark, sf):
    return S.load_predictions(P.predictions(spark, sf))


@query(
    "validate_and_quarantine",
    """WITH e AS (SELECT event_id, user_id, event_type, value, TRY_CAST(json_extract_string(props, '$.k') AS INTEGER) AS k FROM events),
i AS (SELECT event_id, user_id, 'bad_type' AS issue_type FROM e WHERE event_type = 'error'
 UNION ALL SELECT event_id, user_id, 'key_out_of_range' FROM e WHERE NOT coalesce(k BETWEEN 0 AND 79, FALSE)
 UNION ALL SELECT event_id, user_id, 'value_missing' FROM e WHERE NOT coalesce(value > 1, FALSE)
 UNION ALL SELECT event_id, user_id, 'unknown_entity' FROM e WHERE user_id NOT IN (SELECT c_custkey FROM customer WHERE c_acctbal > 0))
SELECT event_id, user_id, issue_type, 'error' AS severity FROM i""",
)
def _(spark, sf):
    e = table(spark, sf, "events")
    dim = table(spark, sf, "customer").where("c_acctbal > 0").select(F.col("c_custkey").alias("user_id"))
    rules = {
        "bad_type": F.col("event_type") != "error",
        "key_out_of_range": F.get_json_object("props", "$.k").try_cast("int").between(0, 79),
        "value_missing": F.col("value") > 1,
    }
    _, bad = I.split_valid(e, rules, dim, "user_id")
    return bad.select("event_id", "user_id", "issue_type", "severity")


@query(
    "upsert_by_key",
    f"""WITH {P.YEARS}, batch AS (SELECT entity, CAST(period + 1 AS INTEGER) AS period, revenue * 2 AS revenue FROM years)
SELECT entity, period, round(revenue, 2) AS revenue, 'batch' AS origin FROM batch
UNION ALL SELECT entity, period, round(revenue, 2), 'base' FROM years y WHERE NOT EXISTS (SELECT 1 FROM batch b WHERE b.entity = y.entity AND b.period = y.period)""",
)
def _(spark, sf):
    y = P.supplier_year(spark, sf).select("entity", "period", "revenue")
    batch = y.select("entity", (F.col("period") + 1).alias("period"), (F.col("revenue") * 2).alias("revenue"), F.lit("batch").alias("origin"))
    return rounded(I.upsert(y.withColumn("origin", F.lit("base")), batch, ["entity", "period"]), 2)


@query(
    "upsert_counts",
    f"""WITH {P.YEARS}, batch AS (SELECT entity, period + 1 AS period FROM years)
SELECT count(*) FILTER (WHERE y.entity IS NULL) AS created, count(y.entity) AS updated FROM batch b LEFT JOIN years y ON y.entity = b.entity AND y.period = b.period""",
)
def _(spark, sf):
    y = P.supplier_year(spark, sf)
    return I.upsert_counts(y, y.withColumn("period", F.col("period") + 1), ["entity", "period"])


def _ingest(spark, sf):
    dim = P.sectors(spark, sf)
    bounds = table(spark, sf, "nation").groupBy().agg(F.count(F.lit(1)).alias("n")).select(
        F.explode(F.array(*[F.struct(F.lit(f).alias("feature"), F.lit(a).alias("lo"), F.lit(b).alias("hi")) for f, a, b in (("net_margin", -0.002, 0.012), ("roe", -1.0, 1.0), ("current_ratio", 0.4, 3.0))])).alias("x")
    ).select("x.*")
    rules = {"non_positive_equity": F.col("total_equity") > 0, "missing_income": F.col("operating_income").isNotNull()}
    return I.run_ingest(P.statements(spark, sf), dim, rules, bounds)


_GOOD = "good AS (SELECT * FROM stmt WHERE coalesce(total_equity > 0, FALSE) AND operating_income IS NOT NULL)"


@query(
    "ingest_run_job",
    f"""WITH {P.STATEMENTS}, {_GOOD}, c AS (SELECT (SELECT count(*) FROM stmt) AS items_total, (SELECT count(*) FROM good) AS items_success)
SELECT items_total, items_success, items_total - items_success AS items_failed,
  CASE WHEN items_total = items_success THEN 'success' ELSE 'partial' END AS job_status FROM c""",
)
def _(spark, sf):
    return _ingest(spark, sf)["job"]


@query(
    "ingest_run_warnings",
    f"""WITH {P.STATEMENTS}, {_GOOD}, m AS (
  SELECT entity, period, 'net_margin' AS feature, net_income / nullif(revenue, 0) AS value, -0.002 AS lo, 0.012 AS hi FROM good
  UNION ALL SELECT entity, period, 'roe', net_income / nullif(total_equity, 0), -1.0, 1.0 FROM good
  UNION ALL SELECT entity, period, 'current_ratio', current_assets / nullif(current_liabilities, 0), 0.4, 3.0 FROM good)
SELECT entity, period, feature, round(value, 9) AS value, 'warning' AS severity FROM m WHERE value < lo OR value > hi""",
)
def _(spark, sf):
    return rounded(_ingest(spark, sf)["warnings"].select("entity", "period", "feature", "value", "severity"), 9)


@query(
    "ingest_health",
    """WITH l AS (SELECT user_id, max(ts) AS latest FROM events GROUP BY 1)
SELECT (SELECT max(ts) FROM events WHERE event_type = 'purchase') AS last_success_at,
 (SELECT count(*) FROM events WHERE event_type = 'error') AS failed_jobs, (SELECT count(*) FROM events) AS total_jobs,
 (SELECT count(*) FROM l) AS n_entities, (SELECT count(*) FROM l WHERE latest < TIMESTAMP '2024-01-29 12:00:00') AS stale_entities""",
)
def _(spark, sf):
    e = table(spark, sf, "events")
    status = F.when(F.col("event_type") == "purchase", "success").when(F.col("event_type") == "error", "failed").otherwise("other")
    jobs = e.select(status.alias("job_status"), F.col("ts").alias("finished_at"))
    cutoff = __import__("datetime").datetime(2024, 1, 29, 12)
    return I.ingest_health(jobs, e, cutoff, "user_id", "ts")


_TIERS = """t AS (SELECT l_suppkey AS entity, year(l_shipdate) AS period, l_linenumber AS prio,
  CASE WHEN l_linenumber < 5 AND max(l_discount) > 0.02 THEN max(l_discount) END AS discount,
  CASE WHEN min(l_tax) > 0 THEN min(l_tax) END AS tax FROM lineitem GROUP BY 1, 2, 3)"""


@query(
    "priority_coalesce",
    f"""WITH {_TIERS} SELECT entity, CAST(period AS INTEGER) AS period, arg_min(discount, prio) FILTER (WHERE discount IS NOT NULL) AS discount,
  arg_min(tax, prio) FILTER (WHERE tax IS NOT NULL) AS tax FROM t GROUP BY 1, 2""",
)
def _(spark, sf):
    li = table(spark, sf, "lineitem").groupBy(F.col("l_suppkey").alias("entity"), F.year("l_shipdate").alias("period"), F.col("l_linenumber").alias("prio"))
    tiers = li.agg(F.max("l_discount").alias("discount"), F.min("l_tax").alias("tax"))
    tiers = tiers.withColumns({"discount": F.when(F.col("discount") > 0.02, F.col("discount")), "tax": F.when(F.col("tax") > 0, F.col("tax"))})
    return S.priority_coalesce(S.block_columns(tiers, "prio", 5, ["discount"]), ["entity", "period"], ["discount", "tax"], "prio")


@query(
    "override_merge",
    f"""WITH {P.YEARS}, patch AS (SELECT l_suppkey AS entity, year(l_shipdate) AS period, max(l_extendedprice) AS corrected, count(*) AS n_fixes FROM lineitem WHERE l_returnflag = 'R' AND l_discount = 0.1 AND l_tax >= 0.05 GROUP BY 1, 2)
SELECT y.entity, y.period, coalesce(p.corrected, y.revenue) AS revenue, p.n_fixes FROM years y LEFT JOIN patch p ON p.entity = y.entity AND p.period = y.period""",
)
def _(spark, sf):
    base = P.supplier_year(spark, sf).select("entity", "period", "revenue")
    return S.override_merge(base, _patch(spark, sf), ["entity", "period"], {"corrected": "revenue"})


def _patch(spark, sf):
    li = table(spark, sf, "lineitem").where("l_returnflag = 'R' and l_discount = 0.1 and l_tax >= 0.05")
    return li.groupBy(F.col("l_suppkey").alias("entity"), F.year("l_shipdate").alias("period")).agg(
        F.max("l_extendedprice").alias("corrected"), F.count(F.lit(1)).alias("n_fixes")
    )


@query(
    "override_counts",
    f"""WITH {P.YEARS}, patch AS (SELECT DISTINCT l_suppkey AS entity, year(l_shipdate) AS period FROM lineitem WHERE l_returnflag = 'R' AND l_discount = 0.1 AND l_tax >= 0.05)
SELECT 'revenue' AS column_name, count(*) AS overrides FROM patch p JOIN years y ON y.entity = p.entity AND y.period = p.period""",
)
def _(spark, sf):
    return S.override_counts(P.supplier_year(spark, sf), _patch(spark, sf), ["entity", "period"], {"corrected": "revenue"})


@query(
    "entity_documents",
    f"""WITH {P.MONTHS}, b AS (SELECT *, CASE WHEN returned IS NOT NULL THEN (rank() OVER (PARTITION BY period ORDER BY returned NULLS LAST) - 1) * 100.0 / count(returned) OVER (PARTITION BY period) END AS rb,
  (rank() OVER (PARTITION BY period ORDER BY revenue) - 1) * 100.0 / count(revenue) OVER (PARTITION BY period) AS vb FROM months),
m AS (SELECT period, median(revenue) AS revenue_med FROM months GROUP BY 1)
SELECT b.entity, b.period, CAST(CASE WHEN returned IS NULL THEN 1 ELSE 0 END AS INTEGER) AS n_missing, b.revenue AS revenue,
  round(b.vb, 6) AS revenue_below, round(b.rb, 6) AS returned_below, round(m.revenue_med, 4) AS revenue_med FROM b JOIN m USING (period)""",
)
def _(spark, sf):
    p = P.supplier_month(spark, sf)
    cols = ["revenue", "returned"]
    stats = rank_within(p.select("entity", "period", *cols), ["entity", "period"], ["period"], {f"{c}__below": (c, share_below) for c in cols})
    med = group_quantiles(p, ["period"], "revenue", {"revenue__med": 0.5}).drop("n").join(
        group_quantiles(p, ["period"], "returned", {"returned__med": 0.5}).drop("n"), "period", "left"
    )
    docs = I.entity_documents(p, stats.drop(*cols), med, ["entity", "period"], "period", cols)
    doc = lambda path: F.get_json_object("document", path).try_cast("double")
    return docs.select(
        "entity",
        "period",
        "n_missing",
        doc("$.values.revenue").alias("revenue"),
        F.round(doc("$.benchmarks.percentiles.revenue"), 6).alias("revenue_below"),
        F.round(doc("$.benchmarks.percentiles.returned"), 6).alias("returned_below"),
        F.round(doc("$.benchmarks.medians.revenue"), 4).alias("revenue_med"),
    )


_RECORD_SQL = """r AS (SELECT conv_id, turn, role, text, length(text) AS n FROM conversations),
e AS (SELECT 'bad_role' AS error FROM r WHERE role NOT IN ('user', 'assistant')
 UNION ALL SELECT 'score_out_of_range' FROM r WHERE NOT (turn / 4.0 BETWEEN 0 AND 1)
 UNION ALL SELECT 'forbidden_advice' FROM r WHERE regexp_matches(text, '(?i)the the|le le')
 UNION ALL SELECT 'too_long' FROM r WHERE n > 400
 UNION ALL SELECT 'missing_theme' FROM r WHERE NOT regexp_matches(text, '(?i)the|le|la'))"""


@query("record_rule_validation", f"WITH {_RECORD_SQL} SELECT error, count(*) AS n FROM e GROUP BY 1")
def _(spark, sf):
    c = table(spark, sf, "conversations")
    doc = F.to_json(F.struct("text", "role", (F.col("turn") / 4.0).alias("score")))
    v = I.validate_records(
        c.select("conv_id", "turn", doc.alias("body")),
        "body",
        "text string, role string, score double",
        ["text", "role", "score"],
        "score",
        ("role", ["user", "assistant"]),
        "text",
        {"advice": "(?i)the the|le le"},
        400,
        "(?i)the|le|la",
    )
    return I.error_summary(v)


@query(
    "sync_dimension",
    """SELECT c_custkey AS user_id, c_name AS name, TRUE AS active, c_mktsegment AS sector FROM customer WHERE c_mktsegment <> 'BUILDING'
UNION ALL SELECT DISTINCT user_id, CAST(user_id AS VARCHAR), TRUE, NULL FROM events WHERE user_id NOT IN (SELECT c_custkey FROM customer WHERE c_mktsegment <> 'BUILDING')""",
)
def _(spark, sf):
    dim = table(spark, sf, "customer").where("c_mktsegment <> 'BUILDING'").select(
        F.col("c_custkey").alias("user_id"), F.col("c_name").alias("name"), F.lit(True).alias("active"), F.col("c_mktsegment").alias("sector")
    )
    return I.sync_dimension(table(spark, sf, "events"), dim, "user_id")


# ---- scalar cleaning ------------------------------------------------------------------------------------


@query(
    "finite_or_null",
    """SELECT l_orderkey, l_linenumber, CASE WHEN l_tax = 0 OR l_discount = 0 THEN NULL ELSE l_extendedprice END AS value FROM lineitem""",
)
def _(spark, sf):
    li = table(spark, sf, "lineitem")
    raw = (
        F.when(F.col("l_tax") == 0, F.lit(float("inf"))).when(F.col("l_discount") == 0, F.lit(float("nan"))).otherwise(F.col("l_extendedprice"))
    )
    return li.select("l_orderkey", "l_linenumber", N.finite_or_null(raw).alias("value"))


@query(
    "parse_locale_number",
    "SELECT l_orderkey, l_linenumber, l_extendedprice AS eu, l_extendedprice AS us, CASE WHEN l_quantity >= 10 THEN l_quantity * 1000 ELSE NULL END AS grouped FROM lineitem",
)
def _(spark, sf):
    li = table(spark, sf, "lineitem")
    us = F.format_number("l_extendedprice", 2)
    eu = F.translate(us, ",.", ".,")
    grouped = F.when(F.col("l_quantity") >= 10, F.format_number(F.col("l_quantity") * 1000, 0)).otherwise("n/a")
    return li.select(
        "l_orderkey",
        "l_linenumber",
        N.parse_number(F.concat(eu, F.lit(" TL"))).alias("eu"),
        N.parse_number(F.concat(F.lit("$"), us)).alias("us"),
        N.parse_number(grouped).alias("grouped"),
    )


@query(
    "numeric_failure_rate",
    """SELECT 'p_brand' AS column_name, 1.0::DOUBLE AS failure_rate, TRUE AS misaligned
UNION ALL SELECT 'p_size', 0.0::DOUBLE, FALSE
UNION ALL SELECT 'mixed', round(count(*) FILTER (WHERE p_size < 20)::DOUBLE / count(*), 9), count(*) FILTER (WHERE p_size < 20)::DOUBLE / count(*) > 0.5 FROM part""",
)
def _(spark, sf):
    p = table(spark, sf, "part").select(
        "p_brand", F.col("p_size").cast("string").alias("p_size"), F.when(F.col("p_size") < 20, F.col("p_type")).otherwise(F.col("p_size").cast("string")).alias("mixed")
    )
    return rounded(C.numeric_failure_rate(p, ["p_brand", "p_size", "mixed"]), 9)


@query(
    "parse_period",
    """SELECT o_orderkey, CAST(year(o_orderdate) AS INTEGER) AS year, CAST(CASE WHEN o_orderstatus = 'P' THEN NULL ELSE quarter(o_orderdate) END AS INTEGER) AS quarter FROM orders""",
)
def _(spark, sf):
    o = table(spark, sf, "orders")
    good = F.concat(F.lit(" "), F.year("o_orderdate").cast("string"), F.lit("q"), F.quarter("o_orderdate").cast("string"))
    bad = F.concat(F.year("o_orderdate").cast("string"), F.lit("Q7"))
    text = F.when(F.col("o_orderstatus") == "P", bad).otherwise(good)
    name = F.concat(F.lit("files/"), F.year("o_orderdate").cast("string"), F.lit(" annual.csv"))
    return o.select("o_orderkey", K.year_in_name(name).alias("year"), K.period_quarter(text).alias("quarter"))


@query(
    "normalise_key",
    "SELECT c_custkey, upper(c_name) AS entity, lpad(CAST(c_nationkey * 97 AS VARCHAR), 4, '0') AS year FROM customer",
)
def _(spark, sf):
    c = table(spark, sf, "customer")
    return c.select(
        "c_custkey",
        K.normalise_entity(F.concat(F.lit("  "), F.lower("c_name"), F.lit(" "))).alias("entity"),
        K.normalise_year((F.col("c_nationkey") * 97).cast("double").cast("string")).alias("year"),
    )


_RATIO_SQL = ", ".join(
    f"round({n} / nullif({d}, 0), 9) AS {k}" for k, (n, d) in R.SCORING_RATIOS.items()
).replace("quick_assets", "(current_assets - inventory)")


@query("financial_ratios", f"WITH {P.STATEMENTS} SELECT entity, period, {_RATIO_SQL} FROM stmt")
def _(spark, sf):
    out = R.financial_ratios(P.statements(spark, sf))
    return rounded(out.select("entity", "period", *R.SCORING_RATIOS), 9)


_Q_SQL = ", ".join(f"round({n} / nullif({d}, 0), 9) AS {k}" for k, (n, d) in R.QUARTERLY_RATIOS.items())


@query(
    "exact_ratios",
    f"""WITH {P.STATEMENTS}, q AS (SELECT *, total_equity AS equity, operating_income AS ebit, operating_cash_flow AS ocf, total_liabilities AS total_debt,
  current_assets - inventory AS quick_assets, total_liabilities - cash AS net_debt FROM stmt)
SELECT entity, period, {_Q_SQL},
  round(net_income / nullif(lag(net_income) OVER w, 0) - 1, 9) AS net_income_growth, round(revenue / nullif(lag(revenue) OVER w, 0) - 1, 9) AS revenue_growth
FROM q WINDOW w AS (PARTITION BY entity ORDER BY period)""",
)
def _(spark, sf):
    out = R.exact_ratios(P.quarterly_names(P.statements(spark, sf)))
    return rounded(out.select("entity", "period", *R.QUARTERLY_RATIOS, "net_income_growth", "revenue_growth"), 9)


@query(
    "derived_scores",
    f"""WITH {P.STATEMENTS} SELECT entity, period, round(CASE WHEN revenue > 0 THEN operating_cash_flow / revenue * 100 END, 6) AS fcf_margin_pct,
  round(operating_cash_flow / nullif(net_income, 0), 6) AS cfo_to_net_income, round(CASE WHEN net_income > 0 THEN ln(net_income) END, 6) AS log_market_cap FROM stmt""",
)
def _(spark, sf):
    s = P.statements(spark, sf).select(
        "entity", "period", "revenue", "net_income", F.col("operating_cash_flow").alias("ocf"), F.col("operating_cash_flow").alias("free_cash_flow"), F.col("net_income").alias("market_cap")
    )
    return rounded(R.derived_features(s).select("entity", "period", "fcf_margin_pct", "cfo_to_net_income", "log_market_cap"))


@query(
    "safe_change_and_deflation",
    f"""WITH {P.TARGETS}, c AS (SELECT *, (target - revenue) / nullif(abs(revenue), 0) AS chg FROM targets)
SELECT entity, period, round(chg, 9) AS pct_change, round(CASE WHEN 1 + (tax * 100 - 3) / 100 > 0 THEN ((1 + chg) / (1 + (tax * 100 - 3) / 100) - 1) * 100 END, 6) AS real_return,
 round(CASE WHEN discount > 0 AND tax > 0 THEN ((1 + chg) * discount / tax - 1) * 100 END, 6) AS fx_return FROM c""",
)
def _(spark, sf):
    t = P.targets(spark, sf).withColumn("chg", N.safe_pct_change("target", "revenue"))
    return t.select(
        "entity",
        "period",
        F.round("chg", 9).alias("pct_change"),
        F.round(N.real_return(F.col("chg") * 100, F.col("tax") * 100 - 3), 6).alias("real_return"),
        F.round(N.fx_return(F.col("chg") * 100, "discount", "tax"), 6).alias("fx_return"),
    )


@query(
    "shape_check_money_ratio",
    """SELECT o_orderkey, CASE WHEN o_totalprice >= 30000 THEN o_totalprice / 30 END AS money, CASE WHEN o_totalprice <= 400000 THEN o_totalprice / 40 END AS ratio,
  CAST(o_totalprice < 30000 AS INTEGER) + CAST(o_totalprice > 400000 AS INTEGER) AS shape_issues FROM orders""",
)
def _(spark, sf):
    o = table(spark, sf, "orders").select("o_orderkey", (F.col("o_totalprice") / 30).alias("money"), (F.col("o_totalprice") / 40).alias("ratio"))
    return C.shape_check(o, ["money"], ["ratio"])


@query(
    "misalignment_by_median",
    f"""WITH {P.YEARS}, l AS (SELECT period, 'revenue' AS feature, abs(revenue) AS v FROM years UNION ALL SELECT period, 'tax', abs(tax) FROM years UNION ALL SELECT period, 'discount', abs(discount) FROM years),
m AS (SELECT period, feature, median(v) AS m FROM l GROUP BY 1, 2)
SELECT period, feature, round(m, 6) AS median_abs, CASE WHEN feature = 'revenue' AND m > 1e4 THEN 'pct_column_has_currency_like_magnitudes'
 WHEN feature = 'tax' AND m > 0 AND m < 1 THEN 'money_column_has_tiny_decimal_values' END AS reason FROM m""",
)
def _(spark, sf):
    y = P.supplier_year(spark, sf)
    return rounded(C.median_misalignment(y, {"revenue": "pct", "tax": "money", "discount": "ratio"}, ["period"]))


@query(
    "misalignment_vs_own_history",
    f"""WITH {P.YEARS}, s AS (SELECT entity, period, CASE WHEN period = 1998 THEN lines::DOUBLE ELSE revenue END AS revenue FROM years),
m AS (SELECT entity, median(abs(revenue)) FILTER (WHERE period <> 1998) AS med FROM s GROUP BY 1)
SELECT s.entity, s.period, CASE WHEN coalesce(s.period = 1998 AND med > 1000 AND abs(revenue) < 0.05 * med, FALSE) THEN NULL ELSE revenue END AS revenue,
 CAST(coalesce(s.period = 1998 AND med > 1000 AND abs(revenue) < 0.05 * med, FALSE) AS INTEGER) AS misaligned FROM s JOIN m USING (entity)""",
)
def _(spark, sf):
    y = P.supplier_year(spark, sf)
    shifted = y.select("entity", "period", F.when(F.col("period") == 1998, F.col("lines").cast("double")).otherwise(F.col("revenue")).alias("revenue"))
    return C.period_misalignment(shifted, "entity", "period", 1998, ["revenue"], floor=1000.0)


@query(
    "complete_case_filter",
    f"""WITH {P.STATEMENTS} SELECT entity, period, concat_ws(',', CASE WHEN operating_income IS NULL THEN 'operating_income' END, CASE WHEN inventory IS NULL THEN 'inventory' END) AS missing,
 (operating_income IS NULL AND inventory IS NULL) AS no_any FROM stmt WHERE operating_income IS NULL OR inventory IS NULL""",
)
def _(spark, sf):
    _, dropped = C.complete_cases(P.statements(spark, sf), ["operating_income", "inventory"], ["operating_income", "inventory"])
    return dropped.select("entity", "period", F.array_join("missing", ",").alias("missing"), "no_any")


@query(
    "coverage_by_column",
    f"""WITH {P.STATEMENTS} SELECT 'operating_income' AS feature, count(operating_income) AS n_observed, count(*) AS n_rows, round(count(operating_income) / count(*), 9) AS coverage FROM stmt
UNION ALL SELECT 'inventory', count(inventory), count(*), round(count(inventory) / count(*), 9) FROM stmt""",
)
def _(spark, sf):
    return rounded(C.coverage_by_column(P.statements(spark, sf), ["operating_income", "inventory"]), 9)


@query("normalise_text")
def _(spark, sf):
    return table(spark, sf, "documents").select("doc_id", X.normalise_text("text").alias("text"))


@query(
    "pattern_screen",
    """SELECT doc_id, concat_ws(',', CASE WHEN regexp_matches(text, '(?i)\\bthe\\s+the\\b') THEN 'doubled_word' END,
 CASE WHEN regexp_matches(text, '\\d{3}') THEN 'digits' END, CASE WHEN regexp_matches(text, '(?i)\\bcalibrated confidence\\b') THEN 'claim' END) AS hits FROM documents""",
)
def _(spark, sf):
    hits = X.pattern_hits("text", {"doubled_word": r"(?i)\bthe\s+the\b", "digits": r"\d{3}", "claim": X.CLAIM_PATTERNS["calibrated_confidence_claim"]})
    return table(spark, sf, "documents").select("doc_id", F.array_join(hits, ",").alias("hits"))
