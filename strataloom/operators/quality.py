"""Column quality, dataset profiles, digests, chained ledgers and outcome checks."""

from __future__ import annotations

from collections.abc import Mapping, Sequence
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window as W

from strataloom.operators.ranking import long_values


def _entity_variety(df: DataFrame, entity: str, cols: Sequence[str]) -> DataFrame:
    """(feature, entity, n_values, n_distinct, has_null). Distinct pairs first, so no entity set is collected."""
    long = long_values(df, [entity], cols)
    pairs = long.groupBy("feature", entity, "value").agg(F.count(F.lit(1)).alias("c"))
    return pairs.groupBy("feature", entity).agg(
        F.coalesce(F.sum(F.when(F.col("value").isNotNull(), F.col("c"))), F.lit(0)).alias("n_values"),
        F.count("value").alias("n_distinct"),
        F.max(F.col("value").isNull()).alias("has_null"),
    )


def column_variability(df: DataFrame, entity: str, cols: Sequence[str], min_share: float = 0.5) -> DataFrame:
    """A column varies when enough entities have more than one distinct value; null counts as a value."""
    v = _entity_variety(df, entity, cols)
    moving = (F.col("n_distinct") + F.col("has_null").cast("int")) > 1
    out = v.groupBy("feature").agg(
        F.count(F.lit(1)).alias("n_entities"), F.count_if(moving).alias("n_varying"), F.bool_or(moving).alias("any_entity_varies")
    )
    return out.withColumn("varies", F.col("n_varying") / F.col("n_entities") >= min_share)


def column_status(df: DataFrame, entity: str, cols: Sequence[str], min_nonnull: int = 2, min_share: float = 0.5) -> DataFrame:
    """all_null, insufficient_history, frozen_across_years or varying, judged on entities with two or more values."""
    s = _entity_variety(df, entity, cols).groupBy("feature").agg(
        F.sum("n_values").alias("n_values"),
        F.count_if(F.col("n_values") >= 2).alias("n_multi"),
        F.count_if((F.col("n_values") >= 2) & (F.col("n_distinct") > 1)).alias("n_moving"),
    )
    status = (
        F.when(F.col("n_values") == 0, "all_null")
        .when((F.col("n_values") < min_nonnull) | (F.col("n_multi") == 0), "insufficient_history")
        .when(F.try_divide("n_moving", "n_multi") >= min_share, "varying")
        .otherwise("frozen_across_years")
    )
    return s.withColumn("status", status)


def frozen_evidence(df: DataFrame, entity: str, cols: Sequence[str]) -> DataFrame:
    """Entities holding at most one distinct non-null value, their share, and the smallest value as a sample."""
    v = _entity_variety(df, entity, cols).groupBy("feature").agg(
        F.count(F.lit(1)).alias("n_entities"), F.count_if(F.col("n_distinct") <= 1).alias("frozen_entities")
    )
    sample = long_values(df, [], cols).groupBy("feature").agg(F.min("value").alias("sample_value"))
    return v.join(sample, "feature").withColumn("frozen_share", F.col("frozen_entities") / F.col("n_entities"))


def source_acceptance(
    df: DataFrame, entity: str, cols: Sequence[str], declared: Sequence[str], leaky: Sequence[str], frozen_share: float = 0.5
) -> DataFrame:
    """Lifecycle per declared column: leakage_field, absent, all_null, frozen_snapshot or accepted."""
    seen = [c for c in declared if c in cols]
    facts = frozen_evidence(df, entity, seen)
    n = long_values(df, [], seen).groupBy("feature").agg(F.count("value").alias("n_values"))
    reg = df.groupBy().agg(F.lit(1).alias("__x")).select(F.explode(F.array(*[F.lit(c) for c in declared])).alias("feature"))
    out = reg.join(facts, "feature", "left").join(n, "feature", "left")
    reason = (
        F.when(F.col("feature").isin(*leaky), "leakage_field")
        .when(F.col("n_values").isNull(), "absent")
        .when(F.col("n_values") == 0, "all_null")
        .when(F.col("frozen_share") >= frozen_share, "frozen_snapshot")
    )
    return out.select(
        "feature",
        F.when(reason.isNull(), "accepted").otherwise("rejected").alias("status"),
        reason.alias("reason"),
        F.coalesce("n_values", F.lit(0)).alias("n_values"),
    )


def bounds_outliers(long: DataFrame, bounds: DataFrame) -> DataFrame:
    """Long (…, feature, value) rows outside [lo, hi] of their feature. ``bounds`` has one row per feature."""
    j = long.join(bounds, "feature").where((F.col("value") < F.col("lo")) | (F.col("value") > F.col("hi")))
    return j.withColumns({"issue_type": F.lit("outlier"), "severity": F.lit("warning")})


def missingness(df: DataFrame, cols: Sequence[str]) -> DataFrame:
    """(feature, n_missing, missing_rate) from one aggregate."""
    one = df.agg(F.count(F.lit(1)).alias("__n"), *[F.count(c).alias(c) for c in cols])
    return long_values(one, ["__n"], cols).select(
        "feature",
        (F.col("__n") - F.col("value")).cast("bigint").alias("n_missing"),
        F.try_divide(F.col("__n") - F.col("value"), F.col("__n")).alias("missing_rate"),
    )


def quality_report(df: DataFrame, entity: str, period: str, target: str, growth: Sequence[str], extreme: float) -> DataFrame:
    """One row per period: rows, target coverage, cells beyond an extreme growth bound."""
    big = sum((F.count_if(F.abs(g) > extreme) for g in growth), F.lit(0))
    return df.groupBy(period).agg(
        F.count(F.lit(1)).alias("n_rows"),
        F.count(target).alias("n_targets"),
        (F.count(target) / F.count(F.lit(1))).alias("target_coverage"),
        big.cast("bigint").alias("extreme_growth"),
    )


def profile(tables: Mapping[str, tuple[DataFrame, str, str, str]]) -> DataFrame:
    """Per table (df, entity, period, target): rows, distinct keys, duplicates, period range, target availability."""
    parts = []
    for name, (df, entity, period, target) in tables.items():
        per_key = df.groupBy(entity, period).agg(F.count(F.lit(1)).alias("c"), F.count(target).alias("t"))
        one = per_key.agg(
            F.sum("c").alias("n_rows"),
            F.count(F.lit(1)).alias("n_keys"),
            F.count_if(F.col("c") > 1).alias("duplicate_keys"),
            F.min(period).cast("bigint").alias("first_period"),
            F.max(period).cast("bigint").alias("last_period"),
            F.sum("t").alias("n_targets"),
        )
        parts.append(one.withColumns({"table_name": F.lit(name), "n_columns": F.lit(len(df.columns))}))
    return reduce(DataFrame.unionByName, parts)


def feature_passports(df: DataFrame, registry: Sequence[tuple[str, str, str, str]]) -> DataFrame:
    """(feature, source_class, acceptance, transformation, coverage) of registered features."""
    names = [r[0] for r in registry]
    look = lambda i: F.create_map(*[F.lit(x) for r in registry for x in (r[0], r[i])])[F.col("feature")]
    m = missingness(df, names)
    return m.select(
        "feature",
        look(1).alias("source_class"),
        look(2).alias("acceptance_status"),
        look(3).alias("transformation"),
        (1 - F.col("missing_rate")).alias("coverage"),
    )


def coverage_facts(df: DataFrame, entity: str, period: str, target: str, features: Sequence[str]) -> DataFrame:
    """One row: rows, entities, periods, target rows, feature cells observed, features that vary inside entities."""
    base = df.agg(F.count(F.lit(1)).alias("n_rows"), F.count(target).alias("n_targets"), *[F.count(f).alias(f) for f in features])
    cells = sum((F.col(f) for f in features), F.lit(0))
    base = base.select(F.lit(1).alias("__k"), "n_rows", "n_targets", cells.cast("bigint").alias("n_cells"))
    ents = df.groupBy(entity).agg(F.lit(1).alias("x")).agg(F.count(F.lit(1)).alias("n_entities")).withColumn("__k", F.lit(1))
    pers = df.groupBy(period).agg(F.lit(1).alias("x")).agg(F.count(F.lit(1)).alias("n_periods")).withColumn("__k", F.lit(1))
    var = column_variability(df, entity, features).agg(F.count_if("any_entity_varies").alias("n_varying")).withColumn("__k", F.lit(1))
    return base.join(ents, "__k").join(pers, "__k").join(var, "__k").drop("__k")


def benchmark_status(bench: DataFrame, period: str, first: int, last: int) -> DataFrame:
    """Every supported period with present/missing."""
    want = bench.groupBy().agg(F.lit(1).alias("x")).select(F.explode(F.sequence(F.lit(first), F.lit(last))).alias(period))
    have = bench.select(period).distinct().withColumn("__h", F.lit(True))
    return want.join(have, period, "left").select(period, F.when(F.col("__h"), "present").otherwise("missing").alias("status"))


# Deductions of the dataset confidence.
CONFIDENCE_DEDUCTIONS = {
    "small_sample": 0.25,
    "benchmark_missing": 0.15,
    "no_accepted_features": 0.20,
    "weak_backtest": 0.20,
    "frozen_columns": 0.10,
}


def dataset_confidence(flags: DataFrame) -> DataFrame:
    """1 minus fixed deductions for the flag columns, the reasons, and a level."""
    score = F.lit(1.0)
    for name, d in CONFIDENCE_DEDUCTIONS.items():
        score = score - F.when(F.col(name), d).otherwise(0.0)
    score = F.round(F.greatest(F.lit(0.0), F.least(F.lit(1.0), score)), 3)
    reasons = F.array_compact(F.array(*[F.when(F.col(n), F.lit(n)) for n in CONFIDENCE_DEDUCTIONS]))
    out = flags.withColumns({"confidence_score": score, "confidence_reasons": F.array_join(reasons, ",")})
    level = F.when(F.col("confidence_score") >= 0.66, "high").when(F.col("confidence_score") >= 0.33, "medium").otherwise("low")
    return out.withColumn("confidence_level", level)


def table_checks(df: DataFrame, entity: str, period: str, expected: Sequence[int], bounded: Mapping[str, tuple[float, float]]) -> DataFrame:
    """(check_name, n_violations): unexpected and missing periods, rows without the prior period, values out of bounds."""
    seen = df.groupBy(period).agg(F.count(F.lit(1)).alias("n"))
    odd = seen.agg(
        F.count_if(~F.col(period).isin(*expected)).alias("unexpected_period"),
        (F.lit(len(expected)) - F.count_if(F.col(period).isin(*expected))).alias("missing_period"),
    )
    keys = df.select(entity, period).distinct()
    prior = keys.select(entity, (F.col(period) + 1).alias(period))
    first = min(expected)
    lone = keys.where(F.col(period) > first).join(prior, [entity, period], "left_anti")
    lone = lone.agg(F.count(F.lit(1)).alias("no_prior_period"))
    out = df.agg(*[F.count_if(~F.col(c).between(lo, hi)).alias(f"bounds_{c}") for c, (lo, hi) in bounded.items()])
    flat = lambda one: one.select(
        F.explode(F.array(*[F.struct(F.lit(c).alias("check_name"), F.col(c).cast("bigint").alias("n_violations")) for c in one.columns])).alias("x")
    ).select("x.*")
    return flat(odd).unionByName(flat(lone)).unionByName(flat(out))


# ---- digests ------------------------------------------------------------------------------------------


def row_digest(cols: Sequence[str]) -> Column:
    """Digest of a row as JSON with its nulls, so that no text can stand for a null or for two fields."""
    fields = F.struct(*[F.col(c).cast("string").alias(c) for c in cols])
    return F.sha2(F.to_json(fields, {"ignoreNullFields": "false"}), 256)


def table_digest(df: DataFrame, by: Sequence[str], cols: Sequence[str]) -> DataFrame:
    """Order-independent digest per group: sums of 60-bit pieces of the row digests, combined map-side.

    The decimal sums do not depend on row order and no group is collected.
    """
    d = row_digest(cols)
    piece = lambda at: F.sum(F.conv(F.substring(d, at, 15), 16, 10).cast("decimal(38,0)"))
    out = df.groupBy(*by).agg(F.count(F.lit(1)).alias("n_rows"), piece(1).alias("a"), piece(16).alias("b"))
    text = F.concat_ws("-", F.col("n_rows").cast("string"), F.col("a").cast("string"), F.col("b").cast("string"))
    return out.select(*by, "n_rows", F.sha2(text, 256).alias("digest"))


def freeze(df: DataFrame, by: Sequence[str], cols: Sequence[str], rank: str) -> DataFrame:
    """Digest of a frozen ranking per group, and whether its ranks are 1..n."""
    d = table_digest(df, by, cols)
    r = df.groupBy(*by).agg(
        F.min(rank).alias("lo"), F.max(rank).alias("hi"), F.sum(F.col(rank).cast("decimal(38,0)")).alias("s"), F.count(rank).alias("n")
    )
    ok = (F.col("lo") == 1) & (F.col("hi") == F.col("n")) & (F.col("s") * 2 == F.col("n").cast("decimal(38,0)") * (F.col("n") + 1))
    return d.join(r.select(*by, ok.alias("contiguous")), list(by))


def manifest_diff(recorded: DataFrame, current: DataFrame, key: str = "path") -> DataFrame:
    """(path, status): missing, added, changed or equal by digest."""
    a = recorded.select(key, F.col("digest").alias("d1"), F.lit(True).alias("in1"))
    b = current.select(key, F.col("digest").alias("d2"), F.lit(True).alias("in2"))
    status = (
        F.when(F.col("in2").isNull(), "missing").when(F.col("in1").isNull(), "added").when(F.col("d1").eqNullSafe(F.col("d2")), "equal").otherwise("changed")
    )
    return a.join(b, key, "full").select(key, status.alias("status"))


def ledger_hash(previous: Column, body: Column) -> Column:
    return F.sha2(F.concat_ws("|", previous, body), 256)


GENESIS = "0" * 64


def ledger_verify(df: DataFrame, ledger: str, seq: str, time: str | None = None) -> DataFrame:
    """Per ledger: lines, and the first failing line with its code.

    Lines: event_id, previous_hash, body, hash and, if named, a time that never goes back. Line numbers run from 1
    without gaps. Only the first line may point to the genesis; a null in any field fails. A line and what its
    predecessor tells of itself meet by the line number in one shuffle, so one long ledger is spread over all tasks; bodies are
    hashed before it and stay behind. Of an event's lines only the first two can decide.
    """
    at, known = F.col(seq), F.col(ledger).isNotNull()
    early = F.when(F.col("event_id").isNull(), "missing_event_id").when(F.col("previous_hash").isNull() | F.col("body").isNull() | F.col("hash").isNull() | at.isNull(), "missing_field")
    wrong = F.col("hash") != ledger_hash(F.col("previous_hash"), F.col("body"))
    when = F.col(time) if time else F.lit(None).cast("boolean")
    parts = lambda own, place, link, early, wrong: F.struct(F.lit(own).alias("own"), place.alias("at"), link.alias("link"), early.alias("early"), wrong.alias("wrong"), when.alias("time"))
    own = parts(True, at, F.col("previous_hash"), early, wrong)
    told = parts(False, at + 1, F.col("hash"), F.lit(None).cast("string"), F.lit(None).cast("boolean"))
    # lines without a ledger follow nothing and stay apart
    apart = F.when(~known, F.monotonically_increasing_id()).alias("__apart")
    met = df.select(ledger, apart, F.explode(F.array(own, told)).alias("l")).where(F.col("l.own") | (known & F.col("l.at").isNotNull()))
    mine = lambda c: F.when(F.col("l.own"), F.col(f"l.{c}"))
    prior = lambda c: F.when(~F.col("l.own"), F.col(f"l.{c}"))
    lines = met.groupBy(ledger, "__apart", F.col("l.at").alias("__at")).agg(
        F.count_if("l.own").alias("__lines"),
        F.count(mine("early")).alias("__n_early"),
        F.min(mine("early")).alias("__early"),
        F.max(mine("link")).alias("previous_hash"),
        F.max(mine("wrong")).alias("__wrong"),
        F.max(~F.col("l.own")).alias("__has"),
        F.max(prior("link")).alias("__ph"),
        *([F.max(mine("time")).alias("__time"), F.max(prior("time")).alias("__pt")] if time else []),
    ).where("__lines > 0")
    first = F.col("__at") == 1
    whole = F.when(F.col("__n_early") == F.col("__lines"), F.col("__early")).when((F.col("__lines") > 1) | (F.col("__at") < 1), "bad_line_number")
    late = (
        F.when(~first & ~F.col("__has"), "missing_line")
        .when(F.when(first, F.col("previous_hash") != GENESIS).otherwise(~F.col("previous_hash").eqNullSafe(F.col("__ph"))), "broken_link")
        .when(F.col("__wrong"), "hash_mismatch")
    )
    if time:
        late = late.when(F.col("__time").isNull() | F.coalesce(F.col("__time") < F.col("__pt"), F.lit(False)), "time_goes_back")
    # on one line the codes of its form come first, then a repeated event, then the others
    fault = lambda line, order, code: F.when(code.isNotNull(), F.struct(line.alias("line"), order.alias("order"), code.alias("code")))
    line = F.coalesce("__at", F.lit(0))
    out = lines.select(ledger, "__lines", fault(line, F.when(whole.isNotNull(), 0).otherwise(2), F.coalesce(whole, late)).alias("__fault"))
    events = df.where(known & F.col("event_id").isNotNull() & at.isNotNull()).select(ledger, "event_id", at.alias("__at"))
    spot = F.row_number().over(W.partitionBy(ledger, "event_id").orderBy("__at"))
    twice = events.withColumn("__spot", spot).where("__spot <= 2").groupBy(ledger, "event_id").agg(F.min("__at").alias("__first"), F.max("__at").alias("__at")).where("__at > __first")
    twice = twice.select(ledger, F.lit(0).cast("bigint").alias("__lines"), fault(line, F.lit(1), F.lit("duplicate_event_id")).alias("__fault"))
    return out.unionByName(twice).groupBy(ledger).agg(F.sum("__lines").alias("n_lines"), F.min("__fault").alias("__fault")).select(
        ledger, "n_lines", F.col("__fault.line").alias("first_bad_line"), F.col("__fault.code").alias("code")
    )


def validate_outcomes(frozen: DataFrame, outcomes: DataFrame, entity: str, lo: Column, hi: Column, tolerance: float = 1e-6) -> DataFrame:
    """First failing code per outcome row, in a fixed order; accepted rows have none.

    outcomes: entity, start_price, end_price, return_pct, source, as_of.
    """
    dup = outcomes.groupBy(entity).agg(F.count(F.lit(1)).alias("__n"))
    known = frozen.select(entity).distinct().withColumn("__k", F.lit(True))
    j = outcomes.join(dup, entity, "left").join(known, entity, "left")
    recomputed = (F.try_divide("end_price", "start_price") - 1) * 100
    code = (
        F.when(F.col(entity).isNull() | (F.trim(F.col(entity).cast("string")) == ""), "blank_entity")
        .when(F.col("__n") > 1, "duplicate_entity")
        .when(F.col("__k").isNull(), "unknown_entity")
        .when(F.col("return_pct").isNull(), "non_numeric_return")
        .when(F.col("source").isNull() | (F.trim("source") == ""), "missing_provenance")
        .when(~F.coalesce(F.col("as_of").between(lo, hi), F.lit(False)), "date_outside_window")
        .when(~F.coalesce((F.col("start_price") > 0) & (F.col("end_price") > 0), F.lit(False)), "non_positive_price")
        .when(F.abs(F.col("return_pct") - recomputed) > tolerance * F.greatest(F.lit(1.0), F.abs(recomputed)), "return_mismatch")
    )
    return j.withColumn("code", code).drop("__n", "__k")
