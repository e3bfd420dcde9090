"""Cell- and column-level cleaning: shape checks, misalignment, completeness."""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from strataloom.functions.numbers import as_col
from strataloom.operators.ranking import group_quantiles, long_values

MONEY_MIN_ABS = 1_000.0
RATIO_MAX_ABS = 10_000.0
MISALIGNED_SHARE = 0.05
MARGIN_ABS_LIMIT = 300.0


def failure_rate(c: str | Column, parsed: Column) -> Column:
    """Aggregate: share of the non-blank cells whose parsed value is null (0 without any cell)."""
    filled = as_col(c).isNotNull() & (F.trim(as_col(c)) != "")
    return F.coalesce(F.try_divide(F.count_if(filled & parsed.isNull()), F.count_if(filled)), F.lit(0.0))


def numeric_failure_rate(df: DataFrame, cols: Sequence[str], limit: float = 0.5) -> DataFrame:
    """(column, failure_rate, misaligned) from one aggregate over the table."""
    plain = lambda c: F.trim(F.regexp_replace(F.col(c), "[%,]", "")).try_cast("double")
    one = df.agg(*[failure_rate(c, plain(c)).alias(c) for c in cols])
    return long_values(one, [], cols).select(
        F.col("feature").alias("column_name"), F.col("value").alias("failure_rate"), (F.col("value") > limit).alias("misaligned")
    )


def shape_check(df: DataFrame, money: Sequence[str], ratio: Sequence[str]) -> DataFrame:
    """Null money cells that look like ratios and ratio cells that look like money; count them in ``shape_issues``."""
    bad = {c: F.abs(c) < MONEY_MIN_ABS for c in money} | {c: F.abs(c) > RATIO_MAX_ABS for c in ratio}
    issues = [F.coalesce(b, F.lit(False)).cast("int") for b in bad.values()]
    total = issues[0]
    for i in issues[1:]:
        total = total + i
    fixed = {c: F.when(~F.coalesce(b, F.lit(False)), F.col(c)) for c, b in bad.items()}
    return df.select(*[fixed.get(c, F.col(c)).alias(c) for c in df.columns], total.alias("shape_issues"))


def median_misalignment(df: DataFrame, kinds: Mapping[str, str], by: Sequence[str]) -> DataFrame:
    """Columns whose median magnitude contradicts their kind (pct, ratio or money), per group."""
    long = long_values(df, by, list(kinds)).withColumn("value", F.abs("value"))
    med = group_quantiles(long, [*by, "feature"], "value", {"median_abs": 0.5})
    kind = F.create_map(*[F.lit(x) for kv in kinds.items() for x in kv])[F.col("feature")]
    m = F.col("median_abs")
    reason = (
        F.when((kind == "pct") & (m > 1e4), "pct_column_has_currency_like_magnitudes")
        .when((kind == "ratio") & (m > 1e5), "ratio_column_has_balance_sheet_like_magnitudes")
        .when((kind == "money") & (m > 0) & (m < 1), "money_column_has_tiny_decimal_values")
    )
    return med.select(*by, "feature", "median_abs", reason.alias("reason"))


def period_misalignment(
    df: DataFrame, entity: str, period: str, target: int, money: Sequence[str], ratio: Sequence[str] = (), floor: float = 1e6
) -> DataFrame:
    """Flag cells of one period that do not fit the entity's own median magnitude elsewhere.

    Money collapsing below 5 % of a median above ``floor`` and ratios exploding past it are nulled;
    ``misaligned`` counts them per row. The medians are one row per entity over its few periods.
    """
    cols = [*money, *ratio]
    med = df.groupBy(entity).agg(
        *[F.percentile(F.when(F.col(period) != target, F.abs(c)), 0.5).alias(f"__m_{c}") for c in cols]
    )
    here = F.col(period) == target
    bad = {c: here & (F.col(f"__m_{c}") > floor) & (F.abs(c) < MISALIGNED_SHARE * F.col(f"__m_{c}")) for c in money}
    bad |= {c: here & (F.col(f"__m_{c}") < 1e3) & (F.abs(c) > floor) for c in ratio}
    bad = {c: F.coalesce(b, F.lit(False)) for c, b in bad.items()}
    total = sum((b.cast("int") for b in bad.values()), F.lit(0))
    return df.join(med, entity, "left").select(
        *[F.when(~bad[c], F.col(c)).alias(c) if c in bad else F.col(c) for c in df.columns], total.alias("misaligned")
    )


def limit_abs(c: str | Column, limit: float = MARGIN_ABS_LIMIT) -> Column:
    return F.when(F.abs(as_col(c)) <= limit, as_col(c))


def completeness(df: DataFrame, all_of: Sequence[str], any_of: Sequence[str]) -> DataFrame:
    """Add ``missing`` (names of absent required columns), ``no_any`` and ``complete``."""
    missing = F.array_compact(F.array(*[F.when(F.col(c).isNull(), F.lit(c)) for c in all_of]))
    no_any = F.coalesce(*[F.col(c) for c in any_of]).isNull() if any_of else F.lit(False)
    return df.withColumns({"missing": missing, "no_any": no_any}).withColumn("complete", (F.size("missing") == 0) & ~F.col("no_any"))


def complete_cases(df: DataFrame, all_of: Sequence[str], any_of: Sequence[str] = ()) -> tuple[DataFrame, DataFrame]:
    """(kept, dropped): dropped rows carry the names of what is missing."""
    marked = completeness(df, all_of, any_of)
    return marked.where("complete").select(*df.columns), marked.where(~F.col("complete")).drop("complete")


def coverage_by_column(df: DataFrame, cols: Sequence[str]) -> DataFrame:
    """(feature, n_observed, n_rows, coverage) from one aggregate."""
    one = df.agg(F.count(F.lit(1)).alias("__n"), *[F.count(c).alias(c) for c in cols])
    long = long_values(one, ["__n"], cols)
    return long.select(
        "feature",
        F.col("value").cast("bigint").alias("n_observed"),
        F.col("__n").alias("n_rows"),
        F.try_divide(F.col("value"), F.col("__n")).alias("coverage"),
    )
