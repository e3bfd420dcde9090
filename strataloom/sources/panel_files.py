"""Reading keyed panel files, choosing among sources, writing predictions."""

from __future__ import annotations

import re
from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.window import Window as W

from strataloom.functions.keys import normalise_entity, year_in_name
from strataloom.functions.numbers import finite_or_null
from strataloom.operators.panel import PanelError, duplicate_keys


def read_panel(spark: SparkSession, path: str | Sequence[str], schema: T.StructType, entity: str = "entity") -> DataFrame:
    """Keyed CSV with a header; '#' lines skipped; entity upper-cased and trimmed."""
    df = spark.read.csv(path, header=True, comment="#", schema=schema, ignoreLeadingWhiteSpace=True, ignoreTrailingWhiteSpace=True)
    return df.withColumn(entity, normalise_entity(entity))


def parse_panel_lines(lines: DataFrame, line: str, schema: str, entity: str) -> DataFrame:
    """The same for CSV text held in a column (one record per row)."""
    rows = lines.where(~F.ltrim(line).startswith("#"))
    out = rows.select(F.from_csv(line, schema, {"mode": "PERMISSIVE"}).alias("r")).select("r.*")
    return out.withColumn(entity, normalise_entity(entity))


def normalise_header(name: str) -> str:
    return re.sub(r"_+", "_", re.sub(r"[\W_]", "_", name.strip().lower())).strip("_")


def canonicalise_columns(
    df: DataFrame, aliases: Mapping[str, str], keep: Sequence[str] = (), leaky: Sequence[str] = ()
) -> tuple[DataFrame, dict[str, list[str]]]:
    """Rename headers through an alias table (driver-side, on column names only).

    Refuses duplicate headers after normalisation and several headers for one field. Unknown and leaky
    columns are dropped and reported.
    """
    norm = [normalise_header(c) for c in df.columns]
    doubled = sorted({c for c in norm if norm.count(c) > 1})
    if doubled:
        raise PanelError(f"duplicate headers after normalisation: {doubled}")
    report: dict[str, list[str]] = {"mapped": [], "unknown": [], "leaky": []}
    picked: dict[str, str] = {}
    for raw, name in zip(df.columns, norm):
        target = name if name in keep else aliases.get(name)
        if name in leaky:
            report["leaky"].append(raw)
        elif target is None:
            report["unknown"].append(raw)
        elif target in picked:
            raise PanelError(f"several columns map to {target}: {picked[target]}, {raw}")
        else:
            picked[target] = raw
            report["mapped"].append(target)
    if not any(t not in keep for t in picked):
        raise PanelError("no recognised data column")
    return df.select(*[F.col(f"`{raw}`").alias(t) for t, raw in picked.items()]), report


def read_period_files(
    spark: SparkSession,
    paths: Sequence[str],
    aliases: Mapping[str, str],
    keep: Sequence[str],
    return_regex: str | None = None,
    return_name: str = "annual_return",
) -> DataFrame:
    """One text-typed CSV per period; the year comes from the file name; columns are united by name.

    ``return_regex`` finds a per-file return column such as '2023 return %'.
    """
    frames = []
    for path in paths:
        raw = spark.read.csv(path, header=True)
        if return_regex:
            found = [c for c in raw.columns if re.search(return_regex, c, re.I)]
            if len(found) == 1:
                raw = raw.withColumnRenamed(found[0], return_name)
        stamped = raw.withColumn("__file", F.col("_metadata.file_path"))
        known = {**aliases, return_name: return_name, "file": "__file"}
        named, _ = canonicalise_columns(stamped, known, keep)
        frames.append(named.withColumnRenamed("__file", "source_file").withColumn("year", year_in_name("source_file")))
    out = frames[0]
    for f in frames[1:]:
        out = out.unionByName(f, allowMissingColumns=True)
    return out


def best_file_per_period(files: DataFrame, period: str, name: str, rows: str, columns: str) -> DataFrame:
    """Of several files for a period the one with most rows, then most recognised columns, then name."""
    best = F.max_by(F.struct(*files.columns), F.struct(F.col(rows), F.col(columns), F.col(name)))
    return files.groupBy(period).agg(best.alias("b")).select("b.*")


def first_available_source(sources: Sequence[DataFrame], entity: str, key: str, value: str, order: str) -> DataFrame:
    """Per entity the rows of the first source that has any row of it; the last row per key wins, then must be positive."""
    tagged = None
    for i, s in enumerate(sources):
        one = s.withColumn("source_rank", F.lit(i))
        tagged = one if tagged is None else tagged.unionByName(one)
    per_key = tagged.groupBy(entity, key, "source_rank").agg(F.max_by(value, order).alias(value))
    first = per_key.groupBy(entity).agg(F.min("source_rank").alias("source_rank"))
    return per_key.join(first, [entity, "source_rank"]).where(F.col(value) > 0)


def priority_coalesce(df: DataFrame, keys: Sequence[str], cols: Sequence[str], priority: str) -> DataFrame:
    """Per key and column the first non-null value in source priority order (plain aggregation)."""
    picks = [F.min_by(c, F.when(F.col(c).isNotNull(), F.col(priority))).alias(c) for c in cols]
    return df.groupBy(*keys).agg(*picks)


def block_columns(df: DataFrame, priority: str, tier: int, cols: Sequence[str]) -> DataFrame:
    """Sources at or beyond a tier may not supply the listed columns."""
    return df.withColumns({c: F.when(F.col(priority) < tier, F.col(c)) for c in cols})


def override_merge(base: DataFrame, patch: DataFrame, keys: Sequence[str], override: Mapping[str, str]) -> DataFrame:
    """Patch values replace base values where present; other patch columns are added."""
    renamed = patch.select(*keys, *[F.col(c).alias(f"__p_{c}") for c in patch.columns if c not in keys])
    out = base.join(renamed, list(keys), "left")
    fixed = {t: F.coalesce(f"__p_{s}", t) for s, t in override.items() if t in base.columns}
    added = [c for c in patch.columns if c not in keys and override.get(c) not in base.columns]
    return out.select(
        *[fixed.get(c, F.col(c)).alias(c) for c in base.columns], *[F.col(f"__p_{c}").alias(c) for c in added]
    )


def override_counts(base: DataFrame, patch: DataFrame, keys: Sequence[str], override: Mapping[str, str]) -> DataFrame:
    """How many base cells each patch column overrides."""
    hit = patch.join(base.select(*keys), list(keys), "left_semi")
    one = hit.agg(*[F.count(s).alias(t) for s, t in override.items()])
    pairs = F.array(*[F.struct(F.lit(t).alias("column_name"), F.col(t).alias("overrides")) for t in override.values()])
    return one.select(F.explode(pairs).alias("x")).select("x.*")


PREDICTION_COLUMNS = ["entity", "period", "model", "y_true", "y_pred"]


def load_predictions(df: DataFrame) -> DataFrame:
    """Contract of persisted predictions: exact columns, no blank ids, unique key, non-finite to null."""
    if df.columns != PREDICTION_COLUMNS:
        raise PanelError(f"columns {df.columns} are not {PREDICTION_COLUMNS}")
    blank = lambda c: F.col(c).isNull() | (F.trim(F.col(c).cast("string")) == "")
    bad = df.where(blank("entity") | blank("model") | F.col("period").isNull()).limit(1).count()
    if bad:
        raise PanelError("blank entity, model or period")
    if duplicate_keys(df, ["entity", "period", "model"]).limit(1).count():
        raise PanelError("duplicate (entity, period, model)")
    return df.withColumns({"y_true": finite_or_null("y_true"), "y_pred": finite_or_null("y_pred")})


def write_predictions(df: DataFrame, path: str, by: Sequence[str] = ("period", "model")) -> None:
    """Rows per split and model as partitioned parquet (full double precision)."""
    df.write.mode("overwrite").partitionBy(*by).parquet(path)
