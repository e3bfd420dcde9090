"""Batch ingestion: validation, quarantine, upsert, health, documents, records."""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from strataloom.functions.ratios import SCORING_RATIOS, financial_ratios
from strataloom.operators.panel import period_transitions
from strataloom.operators.quality import bounds_outliers
from strataloom.operators.ranking import long_values
from strataloom.operators.score import group_benchmarks


def issue_codes(rules: Mapping[str, Column]) -> Column:
    """Codes of the broken rules of a row, in rule order; a null predicate counts as broken."""
    return F.array_compact(F.array(*[F.when(~F.coalesce(ok, F.lit(False)), F.lit(code)) for code, ok in rules.items()]))


def split_valid(
    batch: DataFrame, rules: Mapping[str, Column], dim: DataFrame | None = None, key: str | None = None
) -> tuple[DataFrame, DataFrame]:
    """(good, issues). Rules are true for valid rows. Rows of entities outside ``dim`` are unknown_entity issues."""
    rows = batch
    if dim is not None:
        rows = rows.join(dim.select(key).distinct().withColumn("__known", F.lit(True)), key, "left")
        rules = {**rules, "unknown_entity": F.col("__known")}
    rows = rows.withColumn("issues", issue_codes(rules))
    good = rows.where(F.size("issues") == 0).select(*batch.columns)
    bad = rows.where(F.size("issues") > 0).select(*batch.columns, F.explode("issues").alias("issue_type"))
    return good, bad.withColumn("severity", F.lit("error"))


def upsert(base: DataFrame, batch: DataFrame, keys: Sequence[str]) -> DataFrame:
    """Batch rows replace base rows of the same key; others are kept or added."""
    return base.join(batch.select(*keys), list(keys), "left_anti").unionByName(batch, allowMissingColumns=True)


def upsert_counts(base: DataFrame, batch: DataFrame, keys: Sequence[str]) -> DataFrame:
    b = batch.select(*keys).join(base.select(*keys).withColumn("__old", F.lit(1)), list(keys), "left")
    return b.agg(F.count_if(F.col("__old").isNull()).alias("created"), F.count("__old").alias("updated"))


def sync_dimension(facts: DataFrame, dim: DataFrame, key: str) -> DataFrame:
    """Add entities seen in facts but absent from the dimension: active, named by their key, no sector."""
    new = facts.select(key).distinct().join(dim, key, "left_anti")
    new = new.select(key, F.col(key).cast("string").alias("name"), F.lit(True).alias("active"))
    return dim.unionByName(new, allowMissingColumns=True)


def run_ingest(
    batch: DataFrame,
    dim: DataFrame,
    rules: Mapping[str, Column],
    bounds: DataFrame,
    entity: str = "entity",
    period: str = "period",
    sector: str = "sector",
) -> dict[str, DataFrame]:
    """Set-based upload: validate, ratios, outlier warnings, transitions, sector statistics, job summary."""
    good, issues = split_valid(batch, rules, dim, entity)
    ratios = financial_ratios(good)
    metrics = list(SCORING_RATIOS)
    long = long_values(ratios, [entity, period], metrics).where("value is not null")
    warnings = bounds_outliers(long, bounds)
    sectors = long.join(dim.select(entity, sector), entity).where(F.col(sector).isNotNull())
    seen = batch.select(F.lit(1).alias("t"), F.lit(0).alias("s")).unionByName(good.select(F.lit(0).alias("t"), F.lit(1).alias("s")))
    job = seen.agg(F.sum("t").alias("items_total"), F.sum("s").alias("items_success"))
    job = job.withColumn("items_failed", F.col("items_total") - F.col("items_success"))
    status = F.when(F.col("items_failed") == 0, "success").otherwise("partial")
    return {
        "statements": good,
        "issues": issues,
        "ratios": ratios,
        "warnings": warnings,
        "transitions": period_transitions(ratios, entity, period, metrics),
        "benchmarks": group_benchmarks(sectors, [sector, period, "feature"], "value"),
        "job": job.withColumn("job_status", status),
    }


def ingest_health(jobs: DataFrame, statements: DataFrame, cutoff: object, entity: str, period: str) -> DataFrame:
    """One row: last success, failed jobs, total jobs, entities whose latest period is before ``cutoff``.

    jobs: (job_status, finished_at).
    """
    j = jobs.agg(
        F.lit(1).alias("__k"),
        F.max(F.when(F.col("job_status") == "success", F.col("finished_at"))).alias("last_success_at"),
        F.count_if(F.col("job_status") == "failed").alias("failed_jobs"),
        F.count(F.lit(1)).alias("total_jobs"),
    )
    latest = statements.groupBy(entity).agg(F.max(period).alias("latest"))
    s = latest.agg(
        F.lit(1).alias("__k"), F.count(F.lit(1)).alias("n_entities"), F.count_if(F.col("latest") < F.lit(cutoff)).alias("stale_entities")
    )
    return j.join(s, "__k").drop("__k")


def validate_records(
    df: DataFrame,
    body: str,
    schema: str,
    required: Sequence[str],
    score: str,
    enum: tuple[str, Sequence[str]],
    text: str,
    forbidden: Mapping[str, str],
    max_chars: int,
    theme: str,
) -> DataFrame:
    """Error codes of JSON records: bad JSON, missing keys, score range, enum, forbidden phrases, length, theme."""
    rows = df.withColumn("__r", F.from_json(body, schema, {"mode": "PERMISSIVE"}))
    r = lambda c: F.col(f"__r.{c}")
    parsed = F.coalesce(*[r(c).cast("string") for c in required]).isNotNull()
    codes = [F.when(~parsed, F.lit("invalid_json"))]
    codes += [F.when(parsed & r(c).isNull(), F.lit(f"missing_{c}")) for c in required]
    codes += [
        F.when(~r(score).between(0.0, 1.0), F.lit("score_out_of_range")),
        F.when(~r(enum[0]).isin(*enum[1]), F.lit(f"bad_{enum[0]}")),
    ]
    codes += [F.when(r(text).rlike(p), F.lit(f"forbidden_{name}")) for name, p in forbidden.items()]
    codes += [
        F.when(F.length(r(text)) > max_chars, F.lit("too_long")),
        F.when(~r(text).rlike(theme), F.lit("missing_theme")),
    ]
    return rows.withColumn("errors", F.array_compact(F.array(*codes))).drop("__r")


def error_summary(validated: DataFrame) -> DataFrame:
    return validated.select(F.explode("errors").alias("error")).groupBy("error").agg(F.count(F.lit(1)).alias("n"))


def instruction_records(scored: DataFrame, entity: str, period: str, score: str, label: str) -> DataFrame:
    """instruction/input/output JSON documents from scored rows."""
    doc = F.to_json(
        F.struct(
            F.lit("Summarise the evidence for the entity without giving advice.").alias("instruction"),
            F.format_string("entity=%s period=%s score=%.4f", F.col(entity).cast("string"), F.col(period).cast("string"), F.col(score)).alias("input"),
            F.format_string("The relative score is %.4f (%s). Research support only.", F.col(score), F.col(label)).alias("output"),
        )
    )
    return scored.select(entity, period, doc.alias("record"))


def entity_documents(
    panel: DataFrame, stats: DataFrame, medians: DataFrame, keys: Sequence[str], period: str, cols: Sequence[str]
) -> DataFrame:
    """One nested document per row: values, percentiles (``<c>__below``), period medians, missing names.

    ``stats`` holds the panel keys with the percentile columns, ``medians`` one row per period with ``<c>__med``.
    """
    out = panel.join(stats, list(keys), "left").join(medians, period, "left")
    pack = lambda suffix: F.struct(*[F.col(f"{c}{suffix}").alias(c) for c in cols])
    missing = F.array_compact(F.array(*[F.when(F.col(c).isNull(), F.lit(c)) for c in cols]))
    doc = F.struct(
        *[F.col(k) for k in keys],
        pack("").alias("values"),
        F.struct(pack("__below").alias("percentiles"), pack("__med").alias("medians")).alias("benchmarks"),
        F.struct(missing.alias("missing_fields"), (F.size(missing) > 0).alias("has_warnings")).alias("data_quality"),
    )
    return out.select(*keys, F.to_json(doc).alias("document"), F.size(missing).alias("n_missing"))
