"""Chart documents to daily quotes, year-end quotes."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from strataloom.operators.asof import asof_join

# Shape of a chart document with parallel arrays.
CHART_SCHEMA = (
    "chart struct<result array<struct<timestamp array<bigint>,"
    "events struct<splits map<string, struct<date bigint, numerator double, denominator double>>>,"
    "indicators struct<quote array<struct<close array<double>>>, adjclose array<struct<adjclose array<double>>>>>>>"
)


def flatten_quotes(docs: DataFrame, symbol: str, body: str, zone: str = "UTC") -> tuple[DataFrame, DataFrame]:
    """(prices, splits) from chart JSON text: local dates, null quotes dropped, last quote per date kept."""
    one = docs.select(F.col(symbol).alias("symbol"), F.from_json(body, CHART_SCHEMA)["chart"]["result"][0].alias("r"))
    local = lambda sec: F.to_date(F.from_utc_timestamp(F.timestamp_seconds(sec), zone))
    rows = one.select(
        "symbol",
        F.posexplode(
            F.arrays_zip(
                F.col("r.timestamp").alias("at"),
                F.col("r.indicators.quote")[0]["close"].alias("close"),
                F.col("r.indicators.adjclose")[0]["adjclose"].alias("adjclose"),
            )
        ).alias("pos", "q"),
    )
    rows = rows.select("symbol", "pos", local(F.col("q.at")).alias("date"), "q.close", "q.adjclose").na.drop()
    prices = rows.groupBy("symbol", "date").agg(F.max_by("close", "pos").alias("close"), F.max_by("adjclose", "pos").alias("adjclose"))
    ev = one.select("symbol", F.explode("r.events.splits").alias("k", "s"))
    splits = ev.select("symbol", local(F.col("s.date")).alias("ex_date"), F.try_divide("s.numerator", "s.denominator").alias("ratio"))
    return prices, splits


def year_end_quote(prices: DataFrame, by: Sequence[str], date: str, close: str, adjclose: str, grid: DataFrame) -> DataFrame:
    """Last quote on or before 31 December, of that year or an earlier one, per row of a grid (by, year); status ok or missing."""
    p = prices.where(F.col(close).isNotNull()).groupBy(*by, F.col(date).alias("quote_date")).agg(
        F.max(close).alias("close"), F.max(F.coalesce(adjclose, close)).alias("adjclose")
    )
    at = grid.withColumn("__end", F.make_date("year", F.lit(12), F.lit(31)))
    out = asof_join(at, p, by, "__end", "quote_date", ["close", "adjclose"]).drop("__end")
    return out.withColumn("status", F.when(F.col("close").isNull(), "error").otherwise("success"))
