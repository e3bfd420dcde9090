"""Numeric column expressions: missing-value contract, safe arithmetic, locale parsing."""

from __future__ import annotations

from collections.abc import Sequence
from functools import reduce

from pyspark.sql import Column
from pyspark.sql import functions as F


def as_col(c: str | Column) -> Column:
    return F.col(c) if isinstance(c, str) else c


def finite_or_null(c: str | Column) -> Column:
    """NaN and both infinities become null; text is cast first, and -0.0 becomes 0.0."""
    v = as_col(c).try_cast("double")
    return F.when(~F.isnan(v) & (F.abs(v) < F.lit(float("inf"))), v + F.lit(0.0))


def safe_div(n: str | Column, d: str | Column) -> Column:
    """n / d, null when a side is missing, the denominator is 0 or the quotient overflows."""
    return finite_or_null(F.try_divide(finite_or_null(n), finite_or_null(d)))


def safe_pct_change(new: str | Column, old: str | Column) -> Column:
    new, old = as_col(new).cast("double"), as_col(old).cast("double")
    return F.try_divide(new - old, F.abs(old))


def growth(new: str | Column, old: str | Column) -> Column:
    """new / old - 1, null on a zero base."""
    return finite_or_null(F.try_divide(as_col(new), as_col(old)) - 1)


def parse_number(c: str | Column, lone_comma: str = "auto") -> Column:
    """Text in a European or US number format to double; junk to null.

    ``lone_comma`` says what a comma without a dot means: ``auto`` reads it as a thousands mark only in a
    fully grouped number (1,234,567), ``decimal`` always as the decimal mark, ``len3`` as a thousands
    mark when exactly three digits follow the last comma.
    """
    s = F.regexp_replace(as_col(c), r"[%₺$€\s ]|TL|TRY", "")
    last_comma = F.length(s) - F.instr(F.reverse(s), ",")
    last_dot = F.length(s) - F.instr(F.reverse(s), ".")
    has_comma, has_dot = F.instr(s, ",") > 0, F.instr(s, ".") > 0
    no_commas = F.replace(s, F.lit(","), F.lit(""))
    comma_is_point = F.replace(s, F.lit(","), F.lit("."))
    eu = F.replace(F.replace(s, F.lit("."), F.lit("")), F.lit(","), F.lit("."))
    lone = {
        "auto": F.when(s.rlike(r"^-?\d{1,3}(,\d{3})+$"), no_commas).otherwise(comma_is_point),
        "decimal": comma_is_point,
        "len3": F.when(s.rlike(r",\d{3}$"), no_commas).otherwise(comma_is_point),
    }[lone_comma]
    plain = (
        F.when(has_comma & has_dot, F.when(last_comma > last_dot, eu).otherwise(no_commas))
        .when(has_comma, lone)
        .otherwise(s)
    )
    return finite_or_null(F.regexp_replace(plain, r"[^0-9+\-.eE]", ""))


def row_mean(cols: Sequence[str | Column]) -> Column:
    """Mean of the non-null values of a row; null when all are null."""
    cols = [as_col(c) for c in cols]
    total = reduce(lambda a, b: a + b, [F.coalesce(c, F.lit(0.0)) for c in cols])
    n = reduce(lambda a, b: a + b, [c.isNotNull().cast("int") for c in cols])
    return F.try_divide(total, n)


def row_median(cols: Sequence[str | Column]) -> Column:
    """Median of the non-null values of a row; null when all are null."""
    kept = F.array_sort(F.array_compact(F.array(*[as_col(c) for c in cols])))
    n = F.size(kept)
    lower = F.get(kept, F.floor((n - 1) / 2).cast("int"))
    upper = F.get(kept, F.floor(n / 2).cast("int"))
    return F.when(n > 0, (lower + upper) / 2)


def count_nonnull(cols: Sequence[str | Column]) -> Column:
    return reduce(lambda a, b: a + b, [as_col(c).isNotNull().cast("int") for c in cols])


def clamp(c: Column, lo: float, hi: float) -> Column:
    return F.when(c.isNotNull(), F.least(F.greatest(c, F.lit(lo)), F.lit(hi)))


def strict_greatest(cols: Sequence[str | Column]) -> Column:
    """Maximum that is null as soon as one input is null (Spark's greatest skips nulls)."""
    cols = [as_col(c) for c in cols]
    if len(cols) == 1:
        return cols[0]
    known = reduce(lambda a, b: a & b, [c.isNotNull() for c in cols])
    return F.when(known, F.greatest(*cols))


def real_return(nominal_pct: str | Column, cpi_pct: str | Column) -> Column:
    """Nominal percentage return deflated by a percentage price change."""
    deflator = 1 + as_col(cpi_pct) / 100
    return F.when(deflator > 0, (F.try_divide(1 + as_col(nominal_pct) / 100, deflator) - 1) * 100)


def fx_return(nominal_pct: str | Column, fx0: str | Column, fx1: str | Column) -> Column:
    """Nominal percentage return in another currency, from start and end quotes."""
    fx0, fx1 = as_col(fx0), as_col(fx1)
    gross = (1 + as_col(nominal_pct) / 100) * fx0
    return F.when((fx0 > 0) & (fx1 > 0), (F.try_divide(gross, fx1) - 1) * 100)


def guarded_corr(x: str | Column, y: str | Column, min_n: int = 2) -> Column:
    """Pearson correlation aggregate that is null for constant or too few pairs."""
    x, y = as_col(x), as_col(y)
    both = x.isNotNull() & y.isNotNull()
    xx, yy = F.when(both, x), F.when(both, y)
    r = F.try_divide(F.covar_pop(xx, yy), F.stddev_pop(xx) * F.stddev_pop(yy))
    return F.when(F.count_if(both) >= min_n, r)


