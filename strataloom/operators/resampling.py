"""Permutation and bootstrap inference for rank correlations.

Draws are functions of a key, the draw's number and a row's slot in its group, so results don't depend on partitioning
or on the order of rows; ranks under a sample with replacement follow from how often each row is in it. See `draws`.
"""

from __future__ import annotations

import math
from collections.abc import Sequence

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from strataloom.functions.numbers import finite_or_null, guarded_corr
from strataloom.operators import draws as D
from strataloom.operators.evaluation import MIN_ROWS, usable, with_ranks
from strataloom.operators.ranking import cumulate, key_positions, ordinal
from strataloom.session import cut_lineage

BY = ("model", "period")


def place(pred: DataFrame, by: Sequence[str] = BY, entity: str = "entity") -> DataFrame:
    """Usable rows with true_rank, pred_rank, their slot by entity and n, checkpointed: what every test below starts from."""
    return cut_lineage(key_positions(with_ranks(pred, by, entity), list(by), entity, "slot"))


def keyed(rows: DataFrame, seed: int, apart: Sequence[str]) -> DataFrame:
    """Adds `key`: groups that differ in the columns `apart` draw apart, all others alike."""
    return rows.withColumn("key", F.xxhash64(F.lit(seed), *[F.col(c).cast("string") for c in apart]))


def _apart(by: Sequence[str], apart: Sequence[str] | None) -> list[str]:
    return [c for c in by if c != "model"] if apart is None else list(apart)


def _by_size(rows: DataFrame, draws: int, small, large, names: Sequence[str], least: int | None = None) -> DataFrame:
    """Groups of up to GROUP_ROWS rows by one way, larger ones by another that gives the same."""
    copies, tasks, larger = D.unit_plan(rows, draws, least)
    out = small(rows.where(F.col("n") <= D.GROUP_ROWS), copies, tasks).select(*names)
    return out.unionByName(large(rows.where(F.col("n") > D.GROUP_ROWS)).select(*names)) if larger else out


def _permuted_by_join(rows: DataFrame, by: list[str], draws: int) -> DataFrame:
    spot = rows.groupBy(*by).agg(*[f(c).alias(f"__{k}_{c}") for c in ("x", "y") for k, f in (("m", F.avg), ("s", F.stddev_pop))])
    z = lambda c: F.try_divide(F.col(c) - F.col(f"__m_{c}"), F.nullif(F.col(f"__s_{c}"), F.lit(0.0)) * F.sqrt("n")).alias(f"z{c}")
    rows = rows.join(spot, by).select(*by, "key", "slot", "n", z("x"), z("y"))
    sent = D.spread_rows(rows, D.permuted, [*by, "zy"], draws).withColumnRenamed("to", "slot")
    met = sent.join(rows.select(*by, "slot", "zx"), [*by, "slot"])
    return met.groupBy(*by, "draw").agg(F.when(F.count(F.lit(1)) >= MIN_ROWS, F.sum(F.col("zx") * F.col("zy"))).alias("ic"))


def permutation_null(pred: DataFrame, draws: int, seed: int, by: Sequence[str] = BY, entity: str = "entity", apart: Sequence[str] | None = None, placed: DataFrame | None = None) -> DataFrame:
    """(by, draw, ic): outcome ranks sent round within the group by a keyed bijection, predictions kept.

    Groups that agree in the columns `apart` (default: `by` without model) and in size are permuted alike. Ranks are taken
    once; a permutation keeps them. `placed`: rows of `place`, if they are there already.
    """
    by = list(by)
    rows = place(pred, by, entity) if placed is None else placed
    rows = keyed(rows, seed, _apart(by, apart)).select(*by, "key", "slot", "n", F.col("true_rank").alias("x"), F.col("pred_rank").alias("y"))
    return _by_size(rows, draws, lambda r, *plan: D.drawn_ics(r, by, D.Permuted, draws, *plan), lambda r: _permuted_by_join(r, by, draws), [*by, "draw", "ic"])


def _resampled_by_join(rows: DataFrame, by: list[str], draws: int) -> DataFrame:
    """Samples with replacement row by row: counts of picks, then ranks from running sums of counts in (group, draw, value)."""
    taken = D.spread_rows(rows.select(*by, "key", "slot", "n"), D.picked, by, draws).withColumnRenamed("to", "slot")
    taken = taken.groupBy(*by, "draw", "slot").agg(F.count(F.lit(1)).alias("times")).join(rows.select(*by, "slot", "x", "y"), [*by, "slot"])
    taken = cut_lineage(taken)
    for c in ("x", "y"):
        ties = taken.groupBy(*by, "draw", c).agg(F.sum("times").alias("ties"))
        ranks = cumulate(ties, [*by, "draw"], [c], "ties")
        centred = F.col("below") + (F.col("ties") + 1) / 2 - (F.col("n") + 1) / 2
        taken = taken.join(ranks.select(*by, "draw", c, centred.alias(f"r{c}")), [*by, "draw", c])
    sums = [F.sum(F.col("times") * F.col(a) * F.col(b)) for a, b in (("rx", "ry"), ("rx", "rx"), ("ry", "ry"))]
    both = sums[1] * sums[2]
    return taken.groupBy(*by, "draw").agg(F.when((F.sum("times") >= MIN_ROWS) & (both > 0), sums[0] / F.sqrt(both)).alias("ic"))


def bootstrap_dist(pred: DataFrame, draws: int, seed: int, by: Sequence[str] = BY, entity: str = "entity", apart: Sequence[str] | None = None, placed: DataFrame | None = None) -> DataFrame:
    """(by, draw, ic): rows resampled with replacement within the group and ranked anew.

    Ranks of a sample come from how often each row is in it: values are sorted once a group, not once a draw.
    """
    by = list(by)
    rows = key_positions(usable(pred), by, entity, "slot") if placed is None else placed
    rows = keyed(rows, seed, _apart(by, apart)).select(*by, "key", "slot", "n", F.col("y_true").alias("x"), F.col("y_pred").alias("y"))
    rows = cut_lineage(rows) if placed is None else rows
    return _by_size(rows, draws, lambda r, *plan: D.drawn_ics(r, by, D.Resampled, draws, *plan), lambda r: _resampled_by_join(r, by, draws), [*by, "draw", "ic"])


def pooled_draws(dist: DataFrame, by: Sequence[str] = ("model",)) -> DataFrame:
    """(by, draw, ic): mean over the groups of a draw; null if any is undefined."""
    mean = F.when(F.count("ic") == F.count(F.lit(1)), F.avg("ic"))
    return dist.groupBy(*by, "draw").agg(mean.alias("ic"))


def two_sided_p(observed: Column, value: Column) -> Column:
    """Aggregate: (draws as far from 0 as the observed one + 1) / (valid draws + 1)."""
    return (F.count_if(F.abs(value) >= F.abs(observed)) + 1) / (F.count(value) + 1)


def null_summary(observed: DataFrame, null: DataFrame, boot: DataFrame, by: Sequence[str] = ("model",), digits: int = 12) -> DataFrame:
    """(by, observed_ic, p_value, null_percentile, ci_low, ci_high, draws).

    observed: (by, ic). Draws are compared after rounding to ``digits``, so that equal statistics count as
    equal whatever the order of their sums. Without a finite observed value or a valid draw all is null.
    """
    by = list(by)
    seen = observed.select(*by, F.round("ic", digits).alias("__o"))
    v, o = F.round("ic", digits), F.col("__o")
    left = null.join(seen, by).groupBy(*by).agg(
        F.max("__o").alias("observed_ic"),
        F.when(F.max("__o").isNotNull() & (F.count("ic") > 0), two_sided_p(o, v)).alias("p_value"),
        (100 * F.try_divide(F.count_if(v < o) + 0.5 * F.count_if(v == o), F.when(F.max("__o").isNotNull(), F.count("ic")))).alias("null_percentile"),
        F.count("ic").alias("draws"),
    )
    right = boot.groupBy(*by).agg(F.percentile("ic", F.lit(0.025)).alias("ci_low"), F.percentile("ic", F.lit(0.975)).alias("ci_high"))
    return left.join(right, by, "left")


def null_histogram(null: DataFrame, by: Sequence[str] = ("model",), bins: int = 40) -> DataFrame:
    """(by, bin, n): draws in equal bins of [-1, 1]; 1 itself falls into the last."""
    at = F.least(F.floor((F.col("ic") + 1) / 2 * bins), F.lit(bins - 1)).cast("int")
    return null.where(F.col("ic").between(-1, 1)).groupBy(*by, at.alias("bin")).agg(F.count(F.lit(1)).alias("n"))


def family_correction(tests: DataFrame, family: Sequence[str], alpha: float = 0.05) -> DataFrame:
    """tests (model, p_value) with adjusted_p, significant and headline: Bonferroni over the family's models.

    The headline is the smallest p-value of the family, the model's name breaking ties. Models outside the
    family get nulls.
    """
    inside = F.col("model").isin(list(family))
    adjusted = F.when(inside, F.least(F.lit(1.0), F.col("p_value") * len(family)))
    best = tests.where(inside & F.col("p_value").isNotNull()).agg(F.min_by("model", F.struct("p_value", "model")).alias("__best"))
    out = tests.withColumns({"adjusted_p": adjusted, "significant": adjusted < alpha, "__one": F.lit(1)})
    # one row whatever the number of tests
    out = out.join(F.broadcast(best.withColumn("__one", F.lit(1))), "__one", "left")
    return out.withColumn("headline", F.coalesce(F.col("model") == F.col("__best"), F.lit(False))).drop("__one", "__best")


def analyze(pred: DataFrame, draws: int, seed: int, by: Sequence[str] = BY, entity: str = "entity", digits: int = 12) -> DataFrame:
    """(by, scope, observed_ic, p_value, null_percentile, ci_low, ci_high, draws): every group, and per model all its groups.

    scope is `split` or `pooled`; the columns of `by` but model are null for pooled rows. The pooled statistic of a draw is the mean over the
    model's groups, null if any is undefined. Ranks are taken and checkpointed once for the observed values and both distributions.
    """
    by = list(by)
    placed = place(pred, by, entity)
    seen = placed.groupBy(*by).agg(guarded_corr("true_rank", "pred_rank", MIN_ROWS).alias("ic"))
    null = cut_lineage(permutation_null(pred, draws, seed, by, entity, placed=placed))
    boot = cut_lineage(bootstrap_dist(pred, draws, seed, by, entity, placed=placed))
    splits = null_summary(seen, null, boot, by, digits)
    whole = F.when(F.count("ic") == F.count(F.lit(1)), F.avg("ic")).alias("ic")
    pooled = null_summary(seen.groupBy("model").agg(whole), pooled_draws(null), pooled_draws(boot), ["model"], digits)
    pooled = pooled.withColumn("scope", F.lit("pooled"))
    for c in by:
        if c != "model":
            pooled = pooled.withColumn(c, F.lit(None).cast(placed.schema[c].dataType))
    return splits.withColumn("scope", F.lit("split")).unionByName(pooled)


# ---- entities drawn once for all their periods --------------------------------------------------------


def panel_balance(pred: DataFrame, least: int = 2, by: str = "model", period: str = "period", entity: str = "entity") -> DataFrame:
    """(model, entities, periods, observations, status) of each model's panel: `complete` where every entity has one usable row a period.

    Else `duplicate_rows`, `unusable_values`, `too_few_entities` (fewer than `least`) or `inconsistent_coverage`, the first that holds.
    """
    cells = pred.groupBy(by, period, entity).agg(F.count(F.lit(1)).alias("__n"))
    good = usable(pred).groupBy(by).agg(F.count(F.lit(1)).alias("__good"))
    out = cells.groupBy(by).agg(
        F.count_distinct(entity).alias("entities"), F.count_distinct(period).alias("periods"), F.sum("__n").alias("observations"), F.count(F.lit(1)).alias("__cells")
    )
    status = (
        F.when(F.col("__cells") < F.col("observations"), "duplicate_rows")
        .when(F.coalesce("__good", F.lit(0)) < F.col("observations"), "unusable_values")
        .when(F.col("entities") < least, "too_few_entities")
        .when(F.col("entities") * F.col("periods") != F.col("observations"), "inconsistent_coverage")
        .otherwise("complete")
    )
    return out.join(good, by, "left").withColumn("status", status).drop("__good", "__cells")


def _balanced(pred: DataFrame, least: int, entity: str) -> tuple[DataFrame, DataFrame]:
    balance = cut_lineage(panel_balance(pred, least, entity=entity))
    return balance, pred.join(balance.where("status = 'complete'").select("model"), "model", "left_semi")


def _mean_of_valid(dist: DataFrame) -> DataFrame:
    """(model, draw, ic): mean of the defined correlations of a draw's periods."""
    return dist.groupBy("model", "draw").agg(F.avg("ic").alias("ic"))


def _enough(valid: Column, draws: int, share: float) -> Column:
    return valid >= max(1, math.ceil(share * draws))


def cluster_bootstrap(pred: DataFrame, draws: int, seed: int, least: int = 2, valid_share: float = 0.95, entity: str = "entity") -> DataFrame:
    """(model, period, entities, periods, observed_ic, ci_low, ci_high, valid_draws, status): entities resampled with all their periods.

    One sample of entities with replacement serves every period of a draw, and an entity drawn twice counts twice in each.
    Rows with a period describe that period, those without the mean of a draw's defined periods. The panel must be balanced; a model whose
    panel is not, or with fewer than `valid_share` of its draws defined, has its status and no interval.
    """
    balance, good = _balanced(pred, least, entity)
    placed = place(good, BY, entity)
    seen = placed.groupBy(*BY).agg(guarded_corr("true_rank", "pred_rank", MIN_ROWS).alias("observed_ic"))
    dist = cut_lineage(bootstrap_dist(good, draws, seed, BY, entity, apart=[], placed=placed))
    ends = [F.percentile("ic", F.lit(q)).alias(c) for c, q in (("ci_low", 0.025), ("ci_high", 0.975))]
    each = dist.groupBy(*BY).agg(*ends, F.count("ic").alias("valid_draws")).join(seen, list(BY), "left")
    whole = _mean_of_valid(dist).groupBy("model").agg(*ends, F.count("ic").alias("valid_draws"))
    whole = whole.join(seen.groupBy("model").agg(F.avg("observed_ic").alias("observed_ic")), "model", "left")
    whole = whole.withColumn("period", F.lit(None).cast(placed.schema["period"].dataType))
    out = balance.join(each.unionByName(whole), "model", "left")
    status = F.when(F.col("status") != "complete", F.col("status")).when(~_enough(F.col("valid_draws"), draws, valid_share), "too_few_valid_draws").otherwise("complete")
    out = out.withColumn("status", status)
    held = {c: F.when(F.col("status") == "complete", F.col(c)) for c in ("ci_low", "ci_high")}
    return out.withColumns(held).select("model", "period", "entities", "periods", "observed_ic", "ci_low", "ci_high", "valid_draws", "status")


def trajectory_permutation(pred: DataFrame, draws: int, seed: int, least: int = 2, valid_share: float = 0.95, entity: str = "entity") -> DataFrame:
    """(model, entities, periods, observed_ic, p_value, null_percentile, extreme_draws, valid_draws, status): outcomes permuted as whole trajectories.

    A draw sends every entity's outcomes of all periods to one other entity; predictions stay. The statistic is the mean of a draw's
    defined periods. The panel must be balanced, as in `cluster_bootstrap`; the observed value must be defined in every period.
    """
    balance, good = _balanced(pred, least, entity)
    placed = place(good, BY, entity)
    seen = placed.groupBy(*BY).agg(guarded_corr("true_rank", "pred_rank", MIN_ROWS).alias("ic"))
    observed = seen.groupBy("model").agg(F.when(F.count("ic") == F.count(F.lit(1)), F.round(F.avg("ic"), 12)).alias("observed_ic"))
    null = _mean_of_valid(permutation_null(good, draws, seed, BY, entity, apart=[], placed=placed))
    v, o = F.round("ic", 12), F.col("observed_ic")
    sums = null.join(observed, "model").groupBy("model").agg(
        F.max("observed_ic").alias("observed_ic"),
        F.count_if(F.abs(v) >= F.abs(o)).alias("extreme_draws"),
        F.count("ic").alias("valid_draws"),
        (100 * F.try_divide(F.count_if(v < o) + 0.5 * F.count_if(v == o), F.count("ic"))).alias("null_percentile"),
    )
    out = balance.join(sums, "model", "left")
    status = (
        F.when(F.col("status") != "complete", F.col("status"))
        .when(F.col("observed_ic").isNull(), "undefined_observed_ic")
        .when(~_enough(F.col("valid_draws"), draws, valid_share), "too_few_valid_draws")
        .otherwise("complete")
    )
    out = out.withColumn("status", status).withColumn("p_value", (F.col("extreme_draws") + 1) / (F.col("valid_draws") + 1))
    held = {c: F.when(F.col("status") == "complete", F.col(c)) for c in ("p_value", "null_percentile")}
    return out.withColumns(held).select("model", "entities", "periods", "observed_ic", "p_value", "null_percentile", "extreme_draws", "valid_draws", "status")


# ---- how firm a ranking is ---------------------------------------------------------------------------


def _presence(by: Sequence[str]):
    def ranks(batches):
        for batch in batches:
            for row in range(batch.num_rows):
                one = batch.slice(row, 1)
                key, n, first, last = (one.column(c)[0].as_py() for c in ("key", "n", "first", "last"))
                held = [[], []]
                for d in D.steps(n, first, last):
                    present = (D.counts_of_picks(D.draw_keys(key, d), n) > 0).T
                    held[0].append(present.sum(axis=1))
                    held[1].append(np.cumsum(present, axis=0, dtype=np.int32)[present])
                # a slot's ranks of all pieces one after another
                counts = np.stack(held[0])
                lines = np.concatenate([np.repeat(np.arange(n), c) for c in counts])
                values = np.concatenate(held[1])[np.argsort(lines, kind="stable")]
                ends = np.append(0, np.cumsum(counts.sum(axis=0)))
                same = pa.array(np.zeros(n, np.int64))
                lists = pa.ListArray.from_arrays(pa.array(ends, pa.int32()), pa.array(values, pa.int32()))
                yield pa.record_batch([*[one.column(c).take(same) for c in by], pa.array(np.arange(1, n + 1), pa.int64()), lists], [*by, "slot", "ranks"])

    return ranks


def _presence_by_join(rows: DataFrame, by: list[str], draws: int) -> DataFrame:
    taken = D.spread_rows(rows, D.picked, by, draws).select(*by, "draw", F.col("to").alias("slot")).distinct()
    placed = cumulate(taken, [*by, "draw"], ["slot"])
    return placed.groupBy(*by, "slot").agg(F.collect_list((F.col("below") + 1).cast("int")).alias("ranks"))


def _at_share(ordered: str, q: float) -> Column:
    """Linear interpolation in a sorted array."""
    spot = (F.size(ordered) - 1) * F.lit(q)
    low, high = (F.get(ordered, f(spot).cast("int")).cast("double") for f in (F.floor, F.ceil))
    return low + (high - low) * (spot - F.floor(spot))


def rank_stability(pred: DataFrame, draws: int, seed: int, k: int = 10, by: Sequence[str] = BY, entity: str = "entity") -> DataFrame:
    """(by, entity, full_rank, times_drawn, topk_frequency, rank_p2_5, rank_median, rank_p97_5, status) per prediction.

    A draw samples the group's n rows with replacement; an entity's rank in it is one more than the distinct drawn entities before it by
    descending prediction, entity breaking ties. Frequencies and quantiles are over the draws that hold the entity; one that
    none holds has status `insufficient_data_never_drawn`. Rows without a finite prediction are not ranked.
    """
    by = list(by)
    rows = pred.select(*by, entity, finite_or_null("y_pred").alias("y_pred")).where("y_pred IS NOT NULL")
    rows = ordinal(rows, by, "y_pred", entity, "slot")
    rows = cut_lineage(keyed(rows, seed, _apart(by, None)).select(*by, "key", entity, "slot"))
    rows = rows.join(rows.groupBy(*by, "key").agg(F.count(F.lit(1)).alias("n")), [*by, "key"])
    # groups of one key and size draw alike: their ranks are drawn and summed up once
    alike = ["key", "n"]
    schema = f"{D.schema_of(rows, alike)}slot long, ranks array<int>"
    drawn = _by_size(
        cut_lineage(rows.select(*alike).distinct()),
        draws,
        lambda g, *plan: D.unit_rows(g, draws, *plan).mapInArrow(_presence(alike), schema),
        lambda g: _presence_by_join(rows.select(*alike, "slot").distinct().join(g, alike).withColumn("size", F.col("n")), ["key", "size"], draws).withColumnRenamed("size", "n"),
        [*alike, "slot", "ranks"],
        least=draws,
    )
    drawn = drawn.groupBy(*alike, "slot").agg(F.array_sort(F.flatten(F.collect_list("ranks"))).alias("__ranks"))
    times = F.coalesce(F.size("__ranks"), F.lit(0))
    top = F.size(F.filter("__ranks", lambda r: r <= k))
    drawn = drawn.select(
        *alike,
        "slot",
        F.greatest(times, F.lit(0)).cast("long").alias("__times"),
        F.when(times > 0, top / times).alias("topk_frequency"),
        *[F.when(times > 0, _at_share("__ranks", q)).alias(c) for c, q in (("rank_p2_5", 0.025), ("rank_median", 0.5), ("rank_p97_5", 0.975))],
    )
    out = rows.join(drawn, [*alike, "slot"], "left").withColumn("times_drawn", F.coalesce("__times", F.lit(0).cast("long")))
    return out.select(
        *by,
        entity,
        F.col("slot").alias("full_rank"),
        "times_drawn",
        "topk_frequency",
        "rank_p2_5",
        "rank_median",
        "rank_p97_5",
        F.when(F.col("times_drawn") > 0, "complete").otherwise("insufficient_data_never_drawn").alias("status"),
    )
