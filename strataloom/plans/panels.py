"""The driver tables as panels, and the same panels as SQL common table expressions."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from strataloom.functions.numbers import row_mean, row_median
from strataloom.operators.panel import next_period_target
from strataloom.operators.ranking import pct_rank, rank_input
from strataloom.plans.registry import table
from strataloom.session import cut_lineage

FEATURES = ["revenue", "quantity", "discount", "returned"]


def _cells(li: DataFrame, period) -> DataFrame:
    price = F.col("l_extendedprice")
    returned = F.sum(F.when(F.col("l_returnflag") == "R", price).otherwise(0.0))
    return li.groupBy(F.col("l_suppkey").alias("entity"), period.alias("period")).agg(
        F.round(F.sum("l_extendedprice"), 2).alias("revenue"),
        F.sum("l_quantity").alias("quantity"),
        (F.round(F.sum("l_discount"), 2) / F.count(F.lit(1))).alias("discount"),
        (F.round(F.sum("l_tax"), 2) / F.count(F.lit(1))).alias("tax"),
        F.nullif(F.round(returned, 2), F.lit(0.0)).alias("returned"),
        F.count(F.lit(1)).alias("lines"),
    )


def month_index(c: str):
    return (F.year(c) * 12 + F.month(c) - 1).cast("int")


def supplier_month(spark: SparkSession, sf: str) -> DataFrame:
    """Unique (entity, period): supplier and month number of the ship date. An entity has one row per month."""
    return _cells(table(spark, sf, "lineitem"), month_index("l_shipdate"))


def supplier_year(spark: SparkSession, sf: str) -> DataFrame:
    return _cells(table(spark, sf, "lineitem"), F.year("l_shipdate"))


def sectors(spark: SparkSession, sf: str) -> DataFrame:
    """(entity, sector): supplier and nation key."""
    return table(spark, sf, "supplier").select(F.col("s_suppkey").alias("entity"), F.col("s_nationkey").alias("sector"))


def statements(spark: SparkSession, sf: str) -> DataFrame:
    """Yearly statement-like rows per supplier with signed and missing items."""
    li = table(spark, sf, "lineitem")
    price = F.col("l_extendedprice")
    part = lambda cond, d=2: F.round(F.sum(F.when(cond, price).otherwise(0.0)), d)
    return li.groupBy(F.col("l_suppkey").alias("entity"), F.year("l_shipdate").alias("period")).agg(
        F.round(F.sum(price), 2).alias("revenue"),
        F.round(F.sum(price * (F.lit(0.05) - F.col("l_discount"))), 4).alias("net_income"),
        F.round(F.sum(price * (F.lit(0.05) - F.col("l_tax"))), 4).alias("total_equity"),
        F.sum("l_quantity").alias("total_assets"),
        part(F.col("l_returnflag") == "N").alias("gross_profit"),
        F.nullif(part(F.col("l_returnflag") == "A"), F.lit(0.0)).alias("operating_income"),
        part(F.col("l_linestatus") == "F").alias("total_liabilities"),
        part(F.col("l_linestatus") == "O").alias("current_assets"),
        part(F.col("l_linenumber") <= 3).alias("current_liabilities"),
        F.nullif(part((F.col("l_returnflag") == "R") & (F.col("l_linenumber") == 1)), F.lit(0.0)).alias("inventory"),
        F.sum(F.when(F.col("l_linestatus") == "O", F.col("l_quantity")).otherwise(0.0)).alias("cash"),
        F.round(
            F.sum(F.when(F.col("l_linenumber") == 1, price).when(F.col("l_linenumber") == 2, -price).otherwise(0.0)), 2
        ).alias("operating_cash_flow"),
    )


def quarterly_names(stmt: DataFrame) -> DataFrame:
    return stmt.withColumnsRenamed(
        {"total_equity": "equity", "operating_income": "ebit", "operating_cash_flow": "ocf", "total_liabilities": "total_debt"}
    )


def targets(spark: SparkSession, sf: str) -> DataFrame:
    """supplier_month with the next month's revenue as target."""
    return next_period_target(supplier_month(spark, sf), "entity", "period", "revenue")


def ranked(spark: SparkSession, sf: str) -> DataFrame:
    """targets with percentile ranks of the features within the month."""
    return pct_rank(targets(spark, sf), ["entity", "period"], ["period"], FEATURES)


def yearly_ranked(spark: SparkSession, sf: str) -> DataFrame:
    """supplier_year with the next year's revenue as target and percentile ranks of the features within the year."""
    rows = next_period_target(supplier_year(spark, sf), "entity", "period", "revenue")
    return pct_rank(rows, ["entity", "period"], ["period"], FEATURES)


def predictions(spark: SparkSession, sf: str) -> DataFrame:
    """(entity, period, model, y_true, y_pred) of three baseline scorers; rows with a realised target."""
    return baseline_predictions(_feature_ranks(targets(spark, sf)))


def yearly_predictions(spark: SparkSession, sf: str) -> DataFrame:
    """The same scorers by year: suppliers ship in every year, so the panel is balanced."""
    return baseline_predictions(_feature_ranks(next_period_target(supplier_year(spark, sf), "entity", "period", "revenue")))


def _feature_ranks(rows: DataFrame) -> DataFrame:
    """Percentile ranks as in `ranked`; only what the scorers read goes through the ranking, which reads its input twice."""
    rows = cut_lineage(rows.select("entity", "period", "target", *FEATURES))
    return pct_rank(rows, ["entity", "period"], ["period"], FEATURES)


def baseline_predictions(r: DataFrame) -> DataFrame:
    """Scores are written down once, one row an entity and period: they are ranked next, and ranking reads its input twice."""
    r = r.where(F.col("target").isNotNull())
    pct = [f"{c}__pct" for c in FEATURES]
    scores = {"equal_weight": rank_input(row_mean(pct)), "momentum": F.col("revenue__pct"), "robust_median": rank_input(row_median(pct))}
    r = cut_lineage(r.select("entity", "period", F.col("target").alias("y_true"), *[c.alias(m) for m, c in scores.items()]))
    long = F.array(*[F.struct(F.lit(m).alias("model"), F.col(m).alias("y_pred")) for m in scores])
    return r.select("entity", "period", F.explode(long).alias("s"), "y_true").select("entity", "period", "s.model", "y_true", "s.y_pred")


def daily_prices(spark: SparkSession, sf: str) -> DataFrame:
    """(symbol, date, close): highest line price per supplier and ship day."""
    li = table(spark, sf, "lineitem")
    return li.groupBy(F.col("l_suppkey").alias("symbol"), F.to_date("l_shipdate").alias("date")).agg(
        F.max("l_extendedprice").alias("close")
    )


def split_events(spark: SparkSession, sf: str) -> DataFrame:
    """(symbol, ex_date, ratio): large, highly taxed returns as dated share events."""
    li = table(spark, sf, "lineitem").where((F.col("l_returnflag") == "R") & (F.col("l_tax") >= 0.08) & (F.col("l_quantity") >= 45))
    return li.groupBy(F.col("l_suppkey").alias("symbol"), F.to_date("l_shipdate").alias("ex_date")).agg(
        (F.min("l_linenumber") % 2 + 2).cast("double").alias("ratio")
    )


# ---- the same panels as SQL -------------------------------------------------------------------------


def sql_pct(x: str, by: str) -> str:
    return (
        f"CASE WHEN {x} IS NOT NULL THEN (rank() OVER (PARTITION BY {by} ORDER BY {x} NULLS LAST) - 1 + "
        f"(count(*) OVER (PARTITION BY {by}, {x}) + 1) / 2.0) / count({x}) OVER (PARTITION BY {by}) END"
    )


def sql_avg_rank(x: str, by: str, desc: bool = False) -> str:
    way = "DESC" if desc else "ASC"
    return (
        f"CASE WHEN {x} IS NOT NULL THEN rank() OVER (PARTITION BY {by} ORDER BY {x} {way} NULLS LAST) - 1 + "
        f"(count(*) OVER (PARTITION BY {by}, {x}) + 1) / 2.0 END"
    )


def _sql_cells(name: str, period: str) -> str:
    return f"""{name} AS (SELECT l_suppkey AS entity, {period} AS period,
  round(sum(l_extendedprice), 2) AS revenue, sum(l_quantity) AS quantity,
  round(sum(l_discount), 2) / count(*) AS discount, round(sum(l_tax), 2) / count(*) AS tax,
  nullif(round(sum(CASE WHEN l_returnflag = 'R' THEN l_extendedprice ELSE 0 END), 2), 0) AS returned,
  count(*) AS lines FROM lineitem GROUP BY 1, 2)"""


MONTHS = _sql_cells("months", "CAST(year(l_shipdate) * 12 + month(l_shipdate) - 1 AS INTEGER)")
YEARS = _sql_cells("years", "CAST(year(l_shipdate) AS INTEGER)")
SECTORS = "sectors AS (SELECT s_suppkey AS entity, s_nationkey AS sector FROM supplier)"


def _part(cond: str) -> str:
    return f"round(sum(CASE WHEN {cond} THEN l_extendedprice ELSE 0 END), 2)"


STATEMENTS = f"""stmt AS (SELECT l_suppkey AS entity, CAST(year(l_shipdate) AS INTEGER) AS period,
  round(sum(l_extendedprice), 2) AS revenue,
  round(sum(l_extendedprice * (0.05::DOUBLE - l_discount)), 4) AS net_income,
  round(sum(l_extendedprice * (0.05::DOUBLE - l_tax)), 4) AS total_equity,
  sum(l_quantity) AS total_assets, {_part("l_returnflag = 'N'")} AS gross_profit,
  nullif({_part("l_returnflag = 'A'")}, 0) AS operating_income, {_part("l_linestatus = 'F'")} AS total_liabilities,
  {_part("l_linestatus = 'O'")} AS current_assets, {_part("l_linenumber <= 3")} AS current_liabilities,
  nullif({_part("l_returnflag = 'R' AND l_linenumber = 1")}, 0) AS inventory,
  sum(CASE WHEN l_linestatus = 'O' THEN l_quantity ELSE 0 END) AS cash,
  round(sum(CASE WHEN l_linenumber = 1 THEN l_extendedprice WHEN l_linenumber = 2 THEN -l_extendedprice ELSE 0 END), 2)
    AS operating_cash_flow
  FROM lineitem GROUP BY 1, 2)"""

TARGETS = (
    MONTHS
    + """, targets AS (SELECT a.*, b.revenue AS target, CAST(a.period + 1 AS INTEGER) AS target_period
  FROM months a LEFT JOIN months b ON b.entity = a.entity AND b.period = a.period + 1)"""
)
RANKED = (
    TARGETS
    + ", ranked AS (SELECT *, "
    + ", ".join(f"{sql_pct(c, 'period')} AS {c}__pct" for c in FEATURES)
    + " FROM targets)"
)
YEARLY_RANKED = (
    YEARS
    + """, targets AS (SELECT a.*, b.revenue AS target, CAST(a.period + 1 AS INTEGER) AS target_period
  FROM years a LEFT JOIN years b ON b.entity = a.entity AND b.period = a.period + 1)"""
    + ", ranked AS (SELECT *, "
    + ", ".join(f"{sql_pct(c, 'period')} AS {c}__pct" for c in FEATURES)
    + " FROM targets)"
)
_PCTS = [f"{c}__pct" for c in FEATURES]
SQL_MEAN = (
    "round(("
    + " + ".join(f"coalesce({c}, 0)" for c in _PCTS)
    + ") / nullif("
    + " + ".join(f"CAST({c} IS NOT NULL AS INTEGER)" for c in _PCTS)
    + ", 0), 9)"
)
SQL_MEDIAN = f"round(list_aggregate([{', '.join(_PCTS)}], 'median'), 9)"
_PREDS = (
    f""", preds AS (
  SELECT entity, period, 'equal_weight' AS model, target AS y_true, {SQL_MEAN} AS y_pred FROM ranked WHERE target IS NOT NULL
  UNION ALL SELECT entity, period, 'momentum', target, revenue__pct FROM ranked WHERE target IS NOT NULL
  UNION ALL SELECT entity, period, 'robust_median', target, {SQL_MEDIAN} FROM ranked WHERE target IS NOT NULL)"""
)
PREDICTIONS = RANKED + _PREDS
YEARLY_PREDICTIONS = YEARLY_RANKED + _PREDS
PRICES = "prices AS (SELECT l_suppkey AS symbol, CAST(l_shipdate AS DATE) AS date, max(l_extendedprice) AS close FROM lineitem GROUP BY 1, 2)"
SPLITS = """splits AS (SELECT l_suppkey AS symbol, CAST(l_shipdate AS DATE) AS ex_date,
  CAST(min(l_linenumber) % 2 + 2 AS DOUBLE) AS ratio FROM lineitem
  WHERE l_returnflag = 'R' AND l_tax >= 0.08 AND l_quantity >= 45 GROUP BY 1, 2)"""
