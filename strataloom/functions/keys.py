"""Key normalisation, period parsing and keyed hashes."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from strataloom.functions.numbers import as_col

HASH_DIGITS = 15


def normalise_entity(c: str | Column) -> Column:
    return F.upper(F.trim(as_col(c)))


def normalise_year(c: str | Column) -> Column:
    """Year text such as '2024' or '2024.0' to four digits; null outside 0..9999."""
    v = as_col(c).try_cast("double")
    year = F.when((v >= 0) & (v < 10000), F.floor(v).cast("int"))
    return F.lpad(year.cast("string"), 4, "0")


def period_year(c: str | Column) -> Column:
    """Year of a YYYYQn period, null when the text is not such a period."""
    return F.regexp_extract(F.upper(F.trim(as_col(c))), r"^(\d{4})Q([1-4])$", 1).try_cast("int")


def period_quarter(c: str | Column) -> Column:
    return F.regexp_extract(F.upper(F.trim(as_col(c))), r"^(\d{4})Q([1-4])$", 2).try_cast("int")


def year_in_name(c: str | Column) -> Column:
    """Leading four-digit year of a file name."""
    return F.regexp_extract(as_col(c), r"(?:^|/)\s*(\d{4})[^/]*$", 1).try_cast("int")


def keyed_hash(*parts: str | Column | int) -> Column:
    """60-bit integer from md5 of the parts: the same on every engine and under any partitioning."""
    cols = [F.lit(str(p)) if isinstance(p, int) else as_col(p).cast("string") for p in parts]
    digest = F.md5(F.concat_ws("|", *cols))
    return F.conv(F.substring(digest, 1, HASH_DIGITS), 16, 10).cast("bigint")
