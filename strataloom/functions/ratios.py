"""Statement ratios and derived features as projections."""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window as W

from strataloom.functions.numbers import finite_or_null, growth, safe_div

# The twelve scoring ratios as (numerator, denominator) columns.
SCORING_RATIOS = {
    "roa": ("net_income", "total_assets"),
    "roe": ("net_income", "total_equity"),
    "operating_margin": ("operating_income", "revenue"),
    "net_margin": ("net_income", "revenue"),
    "current_ratio": ("current_assets", "current_liabilities"),
    "quick_ratio": ("quick_assets", "current_liabilities"),
    "cash_ratio": ("cash", "current_liabilities"),
    "debt_to_equity": ("total_liabilities", "total_equity"),
    "debt_to_assets": ("total_liabilities", "total_assets"),
    "ocf_to_debt": ("operating_cash_flow", "total_liabilities"),
    "ocf_to_assets": ("operating_cash_flow", "total_assets"),
    "cash_flow_margin": ("operating_cash_flow", "revenue"),
}

# Quarterly ratios without growth.
QUARTERLY_RATIOS = {
    "roe": ("net_income", "equity"),
    "roa": ("net_income", "total_assets"),
    "gross_margin": ("gross_profit", "revenue"),
    "operating_margin": ("ebit", "revenue"),
    "net_margin": ("net_income", "revenue"),
    "ocf_margin": ("ocf", "revenue"),
    "debt_to_equity": ("total_debt", "equity"),
    "debt_to_assets": ("total_debt", "total_assets"),
    "net_debt_to_equity": ("net_debt", "equity"),
    "asset_turnover": ("revenue", "total_assets"),
    "inventory_turnover": ("revenue", "inventory"),
    "current_ratio": ("current_assets", "current_liabilities"),
    "quick_ratio": ("quick_assets", "current_liabilities"),
    "cash_ratio": ("cash", "current_liabilities"),
}


def _project(df: DataFrame, helpers: Mapping[str, Column], ratios: Mapping[str, tuple[str, str]], extra: Sequence[Column]) -> DataFrame:
    src = df.withColumns(dict(helpers))
    kept = [F.col(c) for c in df.columns if c not in ratios]
    return src.select(*kept, *[safe_div(n, d).alias(k) for k, (n, d) in ratios.items()], *extra)


def financial_ratios(df: DataFrame) -> DataFrame:
    """Twelve ratios per statement. Unknown inventory leaves the quick ratio unknown."""
    return _project(df, {"quick_assets": F.col("current_assets") - F.col("inventory")}, SCORING_RATIOS, [])


def exact_ratios(df: DataFrame, entity: str = "entity", period: str = "period") -> DataFrame:
    """Quarterly ratios plus growth against the entity's previous observed row (one row per period)."""
    w = W.partitionBy(entity).orderBy(period)
    grow = [
        growth(finite_or_null(c), F.lag(finite_or_null(c)).over(w)).alias(f"{c}_growth") for c in ("net_income", "revenue")
    ]
    helpers = {
        "quick_assets": F.col("current_assets") - F.col("inventory"),
        "net_debt": F.col("total_debt") - F.col("cash"),
    }
    return _project(df, helpers, QUARTERLY_RATIOS, grow)


def derived_features(df: DataFrame) -> DataFrame:
    """FCF margin for positive revenue only, cash earnings quality for non-zero income, log of a positive cap."""
    return df.withColumns(
        {
            "fcf_margin_pct": F.when(F.col("revenue") > 0, F.try_divide("free_cash_flow", "revenue") * 100),
            "cfo_to_net_income": F.try_divide("ocf", "net_income"),
            "log_market_cap": F.when(F.col("market_cap") > 0, F.ln("market_cap")),
        }
    )
