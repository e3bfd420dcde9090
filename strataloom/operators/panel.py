"""Panel construction: exact-period targets, merges, carry-forward, universes, valuation."""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window as W

from strataloom.functions.numbers import finite_or_null, fx_return, real_return, safe_pct_change
from strataloom.operators.asof import asof_join
from strataloom.operators.ranking import long_values, min_rank_desc, ordinal, pct_average, rank_within


class PanelError(ValueError):
    """A structural contract is broken."""


def duplicate_keys(df: DataFrame, keys: Sequence[str]) -> DataFrame:
    return df.groupBy(*keys).agg(F.count(F.lit(1)).alias("n_rows")).where("n_rows > 1")


def assert_unique(df: DataFrame, keys: Sequence[str]) -> DataFrame:
    """Fail on the first duplicate key."""
    hit = duplicate_keys(df, keys).take(1)
    if hit:
        raise PanelError(f"duplicate key {hit[0].asDict()}")
    return df


def lag_columns(df: DataFrame, entity: str, period: str, cols: Sequence[str], k: int = 1, suffix: str = "_lag") -> DataFrame:
    """Values of the same entity exactly ``k`` periods earlier (later when negative); gaps give null."""
    past = df.select(entity, (F.col(period) + k).alias(period), *[F.col(c).alias(f"{c}{suffix}") for c in cols])
    return df.join(past, [entity, period], "left")


def next_period_target(df: DataFrame, entity: str, period: str, value: str, out: str = "target") -> DataFrame:
    """Target of T is the entity's own value at exactly T+1, with the target period."""
    nxt = df.select(entity, (F.col(period) - 1).alias(period), F.col(value).alias(out))
    return df.join(nxt, [entity, period], "left").withColumn("target_period", F.col(period) + 1)


def cross_section_targets(df: DataFrame, keys: Sequence[str], by: str, value: str) -> DataFrame:
    """Within the target period: min-rank from the top, average percentile x100, top-decile and top-quintile flags."""
    out = rank_within(
        df, keys, [by], {"target_rank": (value, min_rank_desc), "__p": (value, pct_average)}
    )
    pct = F.col("__p") * 100
    return out.withColumns(
        {
            "target_rank": F.col("target_rank").cast("bigint"),
            "target_pct": pct,
            "target_top10": pct >= 90,
            "target_top20": pct >= 80,
        }
    ).drop("__p")


def benchmark_excess(df: DataFrame, bench: DataFrame, on: str, value: str, bench_value: str) -> DataFrame:
    """Join one benchmark value per period; excess and outperform flag keep null."""
    out = df.join(bench.select(on, F.col(bench_value).alias("benchmark")), on, "left")
    out = out.withColumn("excess", F.col(value) - F.col("benchmark"))
    return out.withColumn("outperform", F.col("excess") > 0)


def yearly_price_features(prices: DataFrame, bench: DataFrame | None = None) -> DataFrame:
    """(entity, year, price) to momentum by exact year, drawdown from the 3-year high, history length."""
    p = prices.where(F.col("price").isNotNull())
    w = W.partitionBy("entity").orderBy("year")
    p = p.withColumns(
        {
            "history_years": F.count(F.lit(1)).over(w.rowsBetween(W.unboundedPreceding, 0)),
            "__high": F.max("price").over(w.rangeBetween(-2, 0)),
            # exact years: a one-year range frame holds the row of that year or nothing
            "__p1": F.max("price").over(w.rangeBetween(-1, -1)),
            "__p2": F.max("price").over(w.rangeBetween(-2, -2)),
        }
    )
    change = lambda old: (F.try_divide(F.col("price"), F.col(old)) - 1) * 100
    out = p.select(
        "entity",
        "year",
        "price",
        "history_years",
        change("__p1").alias("momentum_1y"),
        change("__p2").alias("momentum_2y"),
        change("__high").alias("drawdown_3y"),
    )
    if bench is None:
        return out
    out = out.join(bench.select("year", F.col("benchmark_return")), "year", "left")
    return out.withColumn("relative_1y", F.col("momentum_1y") - F.col("benchmark_return"))


def yearly_return_first_last(daily: DataFrame, by: Sequence[str], year: str, date: str, price: str) -> DataFrame:
    """Last over first price of the year; needs two quotes and a positive first."""
    g = daily.where(F.col(price).isNotNull()).groupBy(*by, year)
    out = g.agg(
        F.count(F.lit(1)).alias("n_quotes"),
        F.min_by(price, date).alias("first_price"),
        F.max_by(price, date).alias("last_price"),
    )
    ok = (F.col("n_quotes") >= 2) & (F.col("first_price") > 0)
    return out.withColumn("return_pct", F.when(ok, (F.try_divide("last_price", "first_price") - 1) * 100))


def yearly_return_prev(prices: DataFrame) -> DataFrame:
    """(entity, year, price): change against the exact previous year, null without it."""
    out = lag_columns(prices.where(F.col("price").isNotNull()), "entity", "year", ["price"])
    return out.select("entity", "year", ((F.try_divide("price", "price_lag") - 1) * 100).alias("return_pct"))


def period_grid(entities: DataFrame, entity: str, first: int, last: int, period: str = "period") -> DataFrame:
    """Every entity with every period of a driver-known range."""
    return entities.select(entity).distinct().withColumn(period, F.explode(F.sequence(F.lit(first), F.lit(last))))


def carry_forward(events: DataFrame, grid: DataFrame, entity: str, period: str, effective: str, order: str, value: str) -> DataFrame:
    """Last event with effective period <= period. Of duplicate events the first in ``order`` counts."""
    ev = events.where((F.col(value) > 0) & F.col(effective).isNotNull())
    ev = ev.groupBy(entity, effective).agg(F.min_by(value, order).alias(value))
    out = asof_join(grid, ev, [entity], period, effective, [value])
    status = F.when(F.col(value).isNull(), "missing_prior_event").otherwise("carried_forward")
    return out.withColumn("status", status)


def membership_split(df: DataFrame, members: DataFrame, entity: str) -> DataFrame:
    """Attach public/training flags and a source label; ``members`` is (entity, is_public, is_training)."""
    m = members.select(entity, F.col("is_public").alias("__p"), F.col("is_training").alias("__t"))
    out = df.join(m, entity, "left")
    public, training = F.coalesce("__p", F.lit(False)), F.coalesce("__t", F.lit(False))
    label = F.when(public, "public").when(training, "training_only").otherwise("unknown")
    return out.withColumns({"is_public": public, "is_training": training, "universe_source": label}).drop("__p", "__t")


def missing_members(df: DataFrame, members: DataFrame, entity: str) -> DataFrame:
    return members.join(df, entity, "left_anti")


def universe_sets(eligible: DataFrame, existing: DataFrame, public: DataFrame, key: str) -> DataFrame:
    """(key, role): new = eligible - existing, conflict = new and public, common = eligible and existing."""
    new = eligible.select(key).subtract(existing.select(key))
    return (
        new.withColumn("role", F.lit("new"))
        .unionByName(new.intersect(public.select(key)).withColumn("role", F.lit("conflict")))
        .unionByName(eligible.select(key).intersect(existing.select(key)).withColumn("role", F.lit("common")))
    )


def listed_rows(df: DataFrame, quotes: DataFrame, entity: str, period: str, quote_period: str) -> DataFrame:
    """Rows not before the entity's first quoted period."""
    first = quotes.groupBy(entity).agg(F.min(quote_period).alias("__first"))
    return df.join(first, entity).where(F.col(period) >= F.col("__first")).drop("__first")


def alt_targets(panel: DataFrame, cpi: DataFrame, fx: DataFrame) -> DataFrame:
    """Deflated and foreign-currency targets with exclusive status codes.

    panel (entity, year, nominal), cpi (year, cpi_pct), fx (year, quote): one row per year each.
    """
    out = panel.withColumn("target_year", F.col("year") + 1)
    out = out.join(cpi.select(F.col("year").alias("target_year"), "cpi_pct"), "target_year", "left")
    out = out.join(fx.select("year", F.col("quote").alias("fx_start")), "year", "left")
    out = out.join(fx.select(F.col("year").alias("target_year"), F.col("quote").alias("fx_end")), "target_year", "left")
    no_nominal = F.col("nominal").isNull()
    return out.select(
        "entity",
        "year",
        "target_year",
        "nominal",
        real_return("nominal", "cpi_pct").alias("real_return"),
        fx_return("nominal", "fx_start", "fx_end").alias("fx_return"),
        F.when(no_nominal, "missing_nominal_target")
        .when(F.col("cpi_pct").isNull(), "missing_cpi_target_year")
        .otherwise("derived")
        .alias("real_status"),
        F.when(no_nominal, "missing_nominal_target")
        .when(F.col("fx_start").isNull(), "missing_fx_start_year")
        .when(F.col("fx_end").isNull(), "missing_fx_target_year")
        .otherwise("derived")
        .alias("fx_status"),
    )


def period_transitions(df: DataFrame, entity: str, period: str, metrics: Sequence[str]) -> DataFrame:
    """Long (entity, feature, from_period, to_period, old, new, changes) over adjacent observed periods."""
    w = W.partitionBy(entity).orderBy(period)
    before = df.select(
        entity, F.lag(period).over(w).alias("from_period"), F.col(period).alias("to_period"), *metrics,
        *[F.lag(m).over(w).alias(f"__o_{m}") for m in metrics],
    ).where("from_period is not null")
    pairs = [F.struct(F.lit(m).alias("feature"), F.col(f"__o_{m}").alias("old_value"), F.col(m).alias("new_value")) for m in metrics]
    out = before.select(entity, "from_period", "to_period", F.explode(F.array(*pairs)).alias("x")).select(
        entity, "from_period", "to_period", "x.*"
    )
    return out.withColumns(
        {
            "abs_change": F.col("new_value") - F.col("old_value"),
            "pct_change": finite_or_null(safe_pct_change("new_value", "old_value")),
        }
    )


def latest_transitions(t: DataFrame, entity: str) -> DataFrame:
    """Transitions at the last to_period of each entity."""
    last = t.groupBy(entity).agg(F.max("to_period").alias("to_period"))
    return t.join(last, [entity, "to_period"])


def key_mismatch(a: DataFrame, b: DataFrame, keys: Sequence[str]) -> DataFrame:
    """(only_left, only_right, both) counts of a full outer join on keys."""
    l = a.select(*keys).withColumn("__l", F.lit(1))
    r = b.select(*keys).withColumn("__r", F.lit(1))
    j = l.join(r, list(keys), "full")
    return j.agg(
        F.count_if(F.col("__r").isNull()).alias("only_left"),
        F.count_if(F.col("__l").isNull()).alias("only_right"),
        F.count_if(F.col("__l").isNotNull() & F.col("__r").isNotNull()).alias("both"),
    )


def attach_target(df: DataFrame, targets: DataFrame, keys: Sequence[str], value: str, out: str) -> DataFrame:
    """Replace the target from another table; refuses unless both key sets are identical and unique."""
    assert_unique(df, keys)
    assert_unique(targets, keys)
    counts = key_mismatch(df, targets, keys).first()
    if counts["only_left"] or counts["only_right"]:
        raise PanelError(f"key sets differ: {counts.asDict()}")
    return df.drop(out).join(targets.select(*keys, F.col(value).alias(out)), list(keys), "left")


def inject_partial_target(df: DataFrame, partial: DataFrame, entity: str, period: str, at: int, target: str) -> DataFrame:
    """Set the target of one period from a partial table (entity, partial); recompute has_target."""
    out = df.join(partial.select(entity, F.col("partial").alias("__x")), entity, "left")
    value = F.when(F.col(period) == at, F.col("__x")).otherwise(F.col(target))
    return out.withColumn(target, value).withColumn("has_target", F.col(target).isNotNull()).drop("__x")


def training_periods(df: DataFrame, period: str, target: str, finalized_to: int, partial_period: int, include_partial: bool) -> DataFrame:
    """(period, role, reason): periods that train and the excluded one with why."""
    seen = df.groupBy(period).agg(F.count(target).alias("n_targets"))
    final = (F.col(period) <= finalized_to) & (F.col("n_targets") > 0)
    partial_ok = (F.col(period) == partial_period) & F.lit(include_partial) & (F.col("n_targets") > 0)
    role = F.when(final, "finalized").when(partial_ok, "partial").otherwise("excluded")
    reason = F.when(role != "excluded", F.lit(None).cast("string")).when(
        F.col("n_targets") == 0, "no_target"
    ).otherwise("inference_only")
    return seen.select(period, "n_targets", role.alias("role"), reason.alias("reason"))


PE_ABS_MAX = 1000.0
PB_ABS_MAX = 100.0
EV_EBITDA_ABS_MAX = 500.0


def _bounded(ratio: Column, limit: float) -> Column:
    return F.when(F.abs(ratio) <= limit, ratio)


def valuation(
    df: DataFrame,
    suspect: Column | None = None,
    pe_max: float = PE_ABS_MAX,
    pb_max: float = PB_ABS_MAX,
    ev_ebitda_max: float = EV_EBITDA_ABS_MAX,
) -> DataFrame:
    """Cap, P/E, P/B, EV and EV/EBITDA with the first failing reason per column.

    Input: price, shares, net_income, equity, ebitda, net_debt. ``suspect`` marks rows whose balance
    sheet is not trusted.
    """
    suspect = F.lit(False) if suspect is None else suspect
    raw_cap = F.round(F.col("price") * F.col("shares"), 4)
    df = df.withColumn("market_cap", F.when(raw_cap > 0, raw_cap)).withColumn("__bad", suspect)
    df = df.withColumn(
        "cap_reason",
        F.when(F.col("price").isNull(), "missing_price")
        .when(F.col("shares").isNull(), "missing_shares")
        .when(F.col("market_cap").isNull(), "non_positive"),
    )
    no_cap = F.col("market_cap").isNull()
    pe = F.when(F.col("net_income") > 0, F.round(F.try_divide("market_cap", "net_income"), 4))
    pb = F.when((F.col("equity") > 0) & ~F.col("__bad"), F.round(F.try_divide("market_cap", "equity"), 4))
    ev = F.when(~F.col("__bad"), F.round(F.col("market_cap") + F.col("net_debt"), 4))
    df = df.withColumns({"__pe": pe, "__pb": pb, "ev": ev})
    df = df.withColumn("__ee", F.when(F.col("ebitda") > 0, F.round(F.try_divide("ev", "ebitda"), 4)))
    df = df.withColumns(
        {"pe": _bounded(F.col("__pe"), pe_max), "pb": _bounded(F.col("__pb"), pb_max), "ev_ebitda": _bounded(F.col("__ee"), ev_ebitda_max)}
    )
    reasons = {
        "pe_reason": F.when(no_cap, "missing_market_cap")
        .when(F.col("net_income").isNull(), "missing_net_income")
        .when(F.col("net_income") <= 0, "non_positive_net_income")
        .when(F.col("pe").isNull(), "absurd_value"),
        "pb_reason": F.when(no_cap, "missing_market_cap")
        .when(F.col("equity").isNull(), "missing_equity")
        .when(F.col("__bad"), "suspect_equity")
        .when(F.col("equity") <= 0, "non_positive_equity")
        .when(F.col("pb").isNull(), "absurd_value"),
        "ev_reason": F.when(no_cap, "missing_market_cap")
        .when(F.col("net_debt").isNull(), "missing_net_debt")
        .when(F.col("__bad"), "suspect_net_debt"),
        "ev_ebitda_reason": F.when(F.col("ev").isNull(), "missing_enterprise_value")
        .when(F.col("ebitda").isNull(), "missing_ebitda")
        .when(F.col("ebitda") <= 0, "non_positive_ebitda")
        .when(F.col("ev_ebitda").isNull(), "absurd_value"),
    }
    return df.withColumns(reasons).drop("__bad", "__pe", "__pb", "__ee")


def rejection_counts(valued: DataFrame) -> DataFrame:
    """(column_name, reason, n) over the reason columns of ``valuation``."""
    cols = ["cap_reason", "pe_reason", "pb_reason", "ev_reason", "ev_ebitda_reason"]
    pairs = F.array(*[F.struct(F.lit(c).alias("column_name"), F.col(c).alias("reason")) for c in cols])
    long = valued.select(F.explode(pairs).alias("x")).select("x.*").where("reason is not null")
    return long.groupBy("column_name", "reason").agg(F.count(F.lit(1)).alias("n"))


def next_period_label(df: DataFrame, entity: str, period: str, income: str, period_return: str | None = None) -> DataFrame:
    """1 when income grows to the next observed period (and the period's return, when known, is positive).

    Rows without a next period, or with a missing income on either side, have no label and are left out.
    """
    w = W.partitionBy(entity).orderBy(period)
    out = df.withColumn("next_period", F.lead(period).over(w)).withColumn("__next", F.lead(income).over(w))
    out = out.where(F.col("next_period").isNotNull() & F.col("__next").isNotNull() & F.col(income).isNotNull())
    ok = F.col("__next") > F.col(income)
    if period_return:
        ok = ok & (F.col(period_return).isNull() | (F.col(period_return) > 0))
    return out.withColumn("label", ok.cast("int")).drop("__next")


def rank_invariance(df: DataFrame, keys: Sequence[str], period: str, a: str, b: str) -> DataFrame:
    """Per period: spread of a - b, its mean, and how many rows rank differently under the two targets."""
    both = df.where(F.col(a).isNotNull() & F.col(b).isNotNull())
    ranked = rank_within(both, keys, [period], {"__ra": (a, min_rank_desc), "__rb": (b, min_rank_desc)})
    gap = F.round(F.col(a) - F.col(b), 6)
    return ranked.groupBy(period).agg(
        F.count(F.lit(1)).alias("n"),
        (F.max(gap) - F.min(gap)).alias("subtrahend_spread"),
        F.avg(gap).alias("subtrahend"),
        F.count_if(F.col("__ra") != F.col("__rb")).alias("rank_mismatches"),
    )


def common_periods(df: DataFrame, ids: DataFrame, entity: str, period: str) -> DataFrame:
    """Periods observed for every given entity."""
    wanted = ids.select(entity).distinct()
    total = wanted.agg(F.count(F.lit(1)).alias("__k"))
    # distinct pairs first: the count distinct of a hot period is then a plain, map-side combined count
    seen = df.join(wanted, entity, "left_semi").select(entity, period).distinct()
    per = seen.groupBy(period).agg(F.count(F.lit(1)).alias("n_entities"))
    return per.join(total, F.col("n_entities") == F.col("__k")).select(period, "n_entities")


def search(dim: DataFrame, cols: Sequence[str], text: str, order: str, limit: int) -> DataFrame:
    """Case-insensitive contains over several columns, ordered and limited."""
    pattern = f"%{text}%"
    hit = F.lit(False)
    for c in cols:
        hit = hit | F.coalesce(F.col(c).ilike(pattern), F.lit(False))
    return dim.where(hit).orderBy(order).limit(limit)


def append_cohort(base: DataFrame, cohort: DataFrame, entity: str, period: str, value: str) -> DataFrame:
    """Add rows of new entities only; target and ranks are computed inside the new cohort."""
    new = cohort.join(base.select(entity).distinct(), entity, "left_anti")
    new = next_period_target(new, entity, period, value)
    new = cross_section_targets(new, [entity, "target_period"], "target_period", "target")
    new = new.withColumn("has_target", F.col("target").isNotNull())
    return base.unionByName(new, allowMissingColumns=True)


def assemble_panel(
    features: DataFrame,
    returns: DataFrame,
    universe: DataFrame,
    bench: DataFrame,
    price_features: DataFrame,
    entity: str = "entity",
    year: str = "year",
) -> DataFrame:
    """features ⟕ returns ⟕ universe ⟕ benchmark ⟕ price features, with target and inference flags.

    returns: (entity, year, return_pct); bench: (year, benchmark_return). The benchmark has one row per year.
    """
    own = next_period_target(returns, entity, year, "return_pct", "next_return").withColumnRenamed("target_period", "target_year")
    out = features.join(own, [entity, year], "left").join(universe, entity, "left")
    bn = bench.select(F.col(year).alias("target_year"), F.col("benchmark_return").alias("next_benchmark"))
    out = out.join(bn, "target_year", "left").join(price_features, [entity, year], "left")
    excess = F.col("next_return") - F.col("next_benchmark")
    return out.withColumns(
        {
            "next_excess": excess,
            "next_outperform": excess > 0,
            "has_target": F.col("next_return").isNotNull(),
            "is_inference": F.col("next_return").isNull(),
        }
    )


def year_overview(scored: DataFrame, entity: str, period: str, score: str, ret: str, bench: DataFrame) -> DataFrame:
    """Per row: score and return ranks, benchmark, gap to the period's best return."""
    out = rank_within(scored, [entity, period], [period], {"score_rank": (score, min_rank_desc), "return_rank": (ret, min_rank_desc)})
    best = scored.where(F.col(ret).isNotNull()).groupBy(period).agg(
        F.max(ret).alias("best_return"),
        # equal returns: the entity first in order, of whatever type
        F.min(F.struct((-F.col(ret)).alias("r"), F.col(entity).alias("e"))).alias("__b"),
        F.count(F.lit(1)).alias("n_returns"),
    ).withColumn("best_entity", F.col("__b.e")).drop("__b")
    out = out.join(best, period, "left").join(bench, period, "left")
    return out.withColumns(
        {
            "score_rank": F.col("score_rank").cast("bigint"),
            "return_rank": F.col("return_rank").cast("bigint"),
            "gap_to_best": F.col("best_return") - F.col(ret),
            "excess": F.col(ret) - F.col("benchmark"),
        }
    )
