import itertools
import math
import random
import tracemalloc
from collections import Counter, defaultdict

import numpy as np
import pytest

from strataloom.operators import draws as D
from strataloom.operators import resampling as G


@pytest.mark.parametrize("n", [1, 2, 3, 4, 5, 10, 80, 1000])
def test_permuted_is_a_bijection(n):
    out = D.permuted(D.draw_keys(7, np.arange(50)), np.arange(n), n)
    assert (np.sort(out, axis=1) == np.arange(n)).all()
    part = D.permuted(D.draw_keys(7, np.arange(50)), np.arange(0, n, 3), n)
    assert (part == out[:, ::3]).all()


@pytest.mark.parametrize("n", [2, 3, 4, 5])
def test_all_permutations_are_about_as_frequent(n):
    draws = 24_000
    seen = Counter(map(tuple, D.permuted(D.draw_keys(3, np.arange(draws)), np.arange(n), n)))
    expected = draws / math.factorial(n)
    chi = sum((seen[p] - expected) ** 2 / expected for p in itertools.permutations(range(n)))
    freedom = math.factorial(n) - 1
    assert chi < freedom + 5 * math.sqrt(2 * freedom) + 5


def test_positions_and_pairs_are_even():
    n, draws = 30, 40_000
    out = D.permuted(D.draw_keys(11, np.arange(draws)), np.arange(n), n)
    for slot in (0, 7, 29):
        counts = np.bincount(out[:, slot], minlength=n)
        assert ((counts - draws / n) ** 2 / (draws / n)).sum() < (n - 1) + 5 * math.sqrt(2 * (n - 1))
    pairs = np.bincount(out[:, 3] * n + out[:, 4], minlength=n * n)
    expected = draws / (n * (n - 1))
    off = ~np.eye(n, dtype=bool).ravel()
    assert ((pairs[off] - expected) ** 2 / expected).sum() < n * (n - 1) + 5 * math.sqrt(2 * n * (n - 1))
    x = np.arange(n, dtype=float)
    ics = D.evaluated(D.Permuted, [(x, x)], 5, n, 0, 40_000)[0]
    # variance of the rank correlation under the null is 1 / (n - 1)
    assert abs(ics.mean()) < 0.005 and abs(ics.var() * (n - 1) - 1) < 0.03


def test_picks_are_even():
    n = 13
    counts = D.counts_of_picks(D.draw_keys(2, np.arange(20_000)), n)
    assert (counts.sum(axis=1) == n).all()
    assert np.abs(counts.mean(axis=0) - 1).max() < 0.04 and np.abs(counts.var(axis=0) - (1 - 1 / n)).max() < 0.05


def ranks(values):
    return [sum(w < v for w in values) + (sum(w == v for w in values) + 1) / 2 for v in values]


def corr(x, y):
    n = len(x)
    if n < 3:
        return None
    mx, my = sum(x) / n, sum(y) / n
    sxy, sxx, syy = (sum((a - m) * (b - o) for a, b, m, o in zip(p, q, itertools.repeat(m_), itertools.repeat(o_))) for p, q, m_, o_ in ((x, y, mx, my), (x, x, mx, mx), (y, y, my, my)))
    return sxy / math.sqrt(sxx * syy) if sxx > 1e-12 and syy > 1e-12 else None


def panel(seed=0, models=("a", "b"), periods=(1, 2, 3), entities=9, ragged=True):
    r = random.Random(seed)
    rows = []
    for m in models:
        for p in periods:
            for e in range(entities - (p % 3 if ragged else 0)):
                y = r.choice([1.0, 2.0, 3.0, r.random()])
                rows.append((f"e{e}", p, m, y, r.choice([0.5, y, r.random()])))
    if ragged:
        rows += [("lone", 9, "a", 1.0, 1.0), ("x", 10, "a", None, 1.0), ("y", 10, "a", 2.0, float("nan")), *[(f"c{i}", 11, "a", 5.0, float(i)) for i in range(5)]]
    return rows


def frame(spark, rows):
    return spark.createDataFrame(rows, "entity string, period long, model string, y_true double, y_pred double").repartition(4)


def groups(rows):
    out = defaultdict(list)
    for e, p, m, y, x in rows:
        if y is not None and x is not None and math.isfinite(y) and math.isfinite(x):
            out[m, p].append((e, y, x))
    return {k: sorted(v) for k, v in out.items()}


def keys(spark, rows, seed, apart):
    df = G.keyed(frame(spark, rows).select("model", "period").distinct(), seed, apart)
    return {(r.model, r.period): r.key for r in df.collect()}


def expected(spark, rows, draws, seed, kind, apart=("period",)):
    """ICs of every draw by plain loops over the same draws."""
    key = keys(spark, rows, seed, list(apart))
    out = {}
    for g, held in groups(rows).items():
        n = len(held)
        for d in range(draws):
            k = D.draw_keys(key[g], np.array([d]))
            y, x = [h[1] for h in held], [h[2] for h in held]
            if kind == "permute":
                to = D.permuted(k, np.arange(n), n)[0]
                out[(*g, d)] = corr([ranks(y)[t] for t in to], ranks(x))
            else:
                at = D.picked(k, np.arange(n), n)[0]
                out[(*g, d)] = corr(ranks([y[t] for t in at]), ranks([x[t] for t in at]))
    return out


def same(found, wanted):
    assert found.keys() == wanted.keys()
    for k, v in wanted.items():
        assert (found[k] is None) == (v is None) and (v is None or abs(found[k] - v) < 1e-9), (k, found[k], v)


def collected(df):
    return {(r.model, r.period, r.draw): r.ic for r in df.collect()}


@pytest.mark.parametrize("limit", [D.GROUP_ROWS, 4])
def test_draws_against_plain_loops(spark, monkeypatch, limit):
    """With a limit of 4 rows most groups take the way through joins; results are the same."""
    monkeypatch.setattr(D, "GROUP_ROWS", limit)
    monkeypatch.setattr(D, "UNIT_CELLS", 60)
    monkeypatch.setattr(D, "LEAST_DRAWS", 2)
    monkeypatch.setattr(D, "STEP_CELLS", 25)
    rows = panel()
    same(collected(G.permutation_null(frame(spark, rows), 17, 5)), expected(spark, rows, 17, 5, "permute"))
    same(collected(G.bootstrap_dist(frame(spark, rows), 17, 5)), expected(spark, rows, 17, 5, "resample"))


def test_no_rows(spark):
    none = frame(spark, panel()).limit(0)
    assert G.permutation_null(none, 3, 1).count() == 0 and G.bootstrap_dist(none, 3, 1).count() == 0
    assert G.rank_stability(none, 3, 1).count() == 0 and G.cluster_bootstrap(none, 3, 1).count() == 0


def test_analyze(spark):
    rows = panel(3, ragged=False)
    draws = 200
    out = {(r.model, r.period): r for r in G.analyze(frame(spark, rows), draws, 1).collect()}
    null, boot = (expected(spark, rows, draws, 1, k) for k in ("permute", "resample"))
    for (m, p), held in groups(rows).items():
        seen = corr(ranks([h[1] for h in held]), ranks([h[2] for h in held]))
        far = sum(abs(null[m, p, d]) >= abs(seen) - 1e-12 for d in range(draws))
        assert abs(out[m, p].observed_ic - seen) < 1e-9 and abs(out[m, p].p_value - (far + 1) / (draws + 1)) < 1e-12
        valid = [v for d in range(draws) if (v := boot[m, p, d]) is not None]
        assert np.allclose([out[m, p].ci_low, out[m, p].ci_high], np.quantile(valid, [0.025, 0.975]))
    for m in ("a", "b"):
        mean = [np.mean([null[m, p, d] for p in (1, 2, 3)]) for d in range(draws)]
        seen = out[m, None].observed_ic
        assert out[m, None].scope == "pooled" and out[m, None].p_value == (sum(abs(v) >= abs(seen) - 1e-12 for v in mean) + 1) / (draws + 1)


def test_a_strong_effect_is_significant_at_production_draws(spark):
    rows = [(f"e{i}", p, m, float(i), float(i + (i * 7919 + p) % 11) if m == "good" else float((i * 7919 + p * 31) % 101)) for m in ("good", "noise") for p in (1, 2, 3) for i in range(60)]
    tests = G.analyze(frame(spark, rows), 10_000, 42).where("scope = 'pooled'").select("model", "p_value")
    out = {r.model: r for r in G.family_correction(tests, ["good", "noise"]).collect()}
    assert out["good"].significant and out["good"].headline and out["good"].adjusted_p < 0.001
    assert not out["noise"].significant


def test_cluster_bootstrap_moves_whole_trajectories(spark):
    rows, draws = panel(4, ragged=False), 120
    out = {(r.model, r.period): r for r in G.cluster_bootstrap(frame(spark, rows), draws, 8).collect()}
    each = expected(spark, rows, draws, 8, "resample", apart=())
    for m in ("a", "b"):
        pooled = []
        for d in range(draws):
            valid = [v for p in (1, 2, 3) if (v := each[m, p, d]) is not None]
            pooled.append(np.mean(valid))
        assert np.allclose([out[m, None].ci_low, out[m, None].ci_high], np.quantile(pooled, [0.025, 0.975]))
        one = [v for d in range(draws) if (v := each[m, 2, d]) is not None]
        assert np.allclose([out[m, 2].ci_low, out[m, 2].ci_high], np.quantile(one, [0.025, 0.975])) and out[m, 2].valid_draws == len(one)
    uneven = [*rows, ("extra", 1, "a", 1.0, 1.0)]
    out = {(r.model, r.period): r.status for r in G.cluster_bootstrap(frame(spark, uneven), 10, 8).collect()}
    assert out["a", None] == "inconsistent_coverage" and out["b", None] == "complete"


def test_balance_statuses(spark):
    base = [("e1", p, "m", 1.0, 2.0) for p in (1, 2)] + [("e2", p, "m", 2.0, 1.0) for p in (1, 2)]
    status = lambda rows, least=2: G.panel_balance(frame(spark, rows), least).first().status
    assert status(base) == "complete" and status(base, 3) == "too_few_entities"
    assert status([*base, base[0]]) == "duplicate_rows" and status([*base[:-1], ("e2", 2, "m", None, 1.0)]) == "unusable_values"
    assert status(base[:-1]) == "inconsistent_coverage"


def test_trajectory_permutation(spark):
    rows, draws = panel(6, ragged=False), 150
    out = {r.model: r for r in G.trajectory_permutation(frame(spark, rows), draws, 2).collect()}
    each = expected(spark, rows, draws, 2, "permute", apart=())
    held = groups(rows)
    for m in ("a", "b"):
        seen = np.mean([corr(ranks([h[1] for h in held[m, p]]), ranks([h[2] for h in held[m, p]])) for p in (1, 2, 3)])
        mean = [np.mean([each[m, p, d] for p in (1, 2, 3)]) for d in range(draws)]
        extreme = sum(abs(v) >= abs(seen) - 1e-11 for v in mean)
        assert out[m].extreme_draws == extreme and abs(out[m].p_value - (extreme + 1) / (draws + 1)) < 1e-12 and out[m].status == "complete"
    alike = [(e, p, m, 1.0, x) for e, p, m, _, x in rows]
    assert {r.status for r in G.trajectory_permutation(frame(spark, alike), 5, 2).collect()} == {"undefined_observed_ic"}


@pytest.mark.parametrize("limit", [D.GROUP_ROWS, 4])
def test_rank_stability(spark, monkeypatch, limit):
    monkeypatch.setattr(D, "GROUP_ROWS", limit)
    monkeypatch.setattr(D, "UNIT_CELLS", 100)
    monkeypatch.setattr(D, "STEP_CELLS", 30)
    rows, draws, k = panel(5), 40, 3
    out = {(r.model, r.period, r.entity): r for r in G.rank_stability(frame(spark, rows), draws, 3, k).collect()}
    key = keys(spark, rows, 3, ["period"])
    held = defaultdict(list)
    for e, p, m, _, x in rows:
        if x is not None and math.isfinite(x):
            held[m, p].append((-x, e))
    for g, order in held.items():
        order.sort()
        n, found = len(order), defaultdict(list)
        for d in range(draws):
            drawn = sorted(set(D.picked(D.draw_keys(key[g], np.array([d])), np.arange(n), n)[0].tolist()))
            for place, slot in enumerate(drawn):
                found[slot].append(place + 1)
        for slot, (_, e) in enumerate(order):
            r, seen = out.pop((*g, e)), found[slot]
            assert r.full_rank == slot + 1 and r.times_drawn == len(seen)
            if seen:
                assert r.status == "complete" and abs(r.topk_frequency - sum(x <= k for x in seen) / len(seen)) < 1e-12
                assert np.allclose([r.rank_p2_5, r.rank_median, r.rank_p97_5], np.percentile(seen, [2.5, 50, 97.5]))
            else:
                assert r.status == "insufficient_data_never_drawn" and r.rank_median is None
    assert not out


@pytest.mark.parametrize("n", [3_000, 60_000, 360_000])
def test_large_groups_are_dealt_in_few_copies(spark, n):
    """The rows of a group were copied for every 32 draws, 313 times here, however large it was."""
    groups = spark.createDataFrame([(k, n) for k in range(12)], "key long, n long")
    copies, tasks, larger = D.unit_plan(groups, 10_000)
    units = D.unit_rows(groups, 10_000, copies, tasks).collect()
    assert copies == D.COPIES and not larger and len(units) <= 12 * copies
    assert sum(u["last"] - u["first"] for u in units) == 12 * 10_000
    lone = D.unit_plan(groups.limit(1), 10_000)
    assert D.unit_rows(groups.limit(1), 10_000, *lone[:2]).count() <= D.UNITS


@pytest.mark.parametrize("n", [4_096, 20_000])
def test_whole_permutations_and_counts_are_those_of_single_slots(n):
    keys = D.draw_keys(9, np.arange(2))
    whole = D.permuted(keys, np.arange(n), n)
    part = np.arange(0, n, 7)
    assert (whole[:, part] == D.permuted(keys, part, n)).all() and (np.sort(whole, axis=1) == np.arange(n)).all()
    counts = D.counts_of_picks(keys, n)
    at = D.picked(keys, np.arange(n), n)
    assert all((np.bincount(a, minlength=n) == c).all() for a, c in zip(at, counts))


def test_models_that_draw_alike_are_drawn_once(spark, monkeypatch):
    """Their ranks were drawn and shuffled once for each model."""
    units, whole = [], D.unit_rows
    monkeypatch.setattr(D, "unit_rows", lambda g, *a: units.append(g.count()) or whole(g, *a))
    rows = panel(4, models=("a", "b", "c"), ragged=False)
    out = G.rank_stability(frame(spark, rows), 20, 3)
    assert units == [3] and out.count() == len(rows)


@pytest.mark.parametrize("n", [7, 2_500, 17_000])
def test_models_with_other_outcomes_and_many_ties_against_plain_ranks(n):
    """Sums of tied values come from running sums or value by value; memory used again by one model must not reach another."""
    r = np.random.default_rng(n)
    x = r.integers(0, n, n).astype(float)
    held = [(x, r.random(n)), (x, np.floor(r.random(n) * n / 2)), (r.random(n), x), (x, np.floor(r.random(n) * 3)), (x, np.ones(n))]
    keys = D.draw_keys(8, np.arange(3))
    boot, null = D.evaluated(D.Resampled, held, 8, n, 0, 3), D.evaluated(D.Permuted, [(D.average_ranks(a), D.average_ranks(b)) for a, b in held], 8, n, 0, 3)
    for d in range(3):
        at, to = D.picked(keys[d : d + 1], np.arange(n), n)[0], D.permuted(keys[d : d + 1], np.arange(n), n)[0]
        for g, (a, b) in enumerate(held):
            for ic, p, q in ((boot[g, d], D.standard(D.average_ranks(a[at])), D.standard(D.average_ranks(b[at]))), (null[g, d], D.standard(D.average_ranks(a)[to]), D.standard(D.average_ranks(b)))):
                assert np.isnan(ic) if p is None or q is None else abs(ic - p @ q) < 1e-9


def test_a_draw_takes_no_fresh_memory():
    """Each draw of a large group took a dozen new arrays of its size, whose pages cost more than the draw."""
    n = 200_000
    x, y = np.random.default_rng(1).random((2, n))
    for statistic in (D.Permuted, D.Resampled):
        made = statistic(x, y)
        for d in range(2):
            made.ics(statistic.drawn(D.draw_keys(1, np.array([d])), n))
        tracemalloc.start()
        made.ics(statistic.drawn(D.draw_keys(1, np.array([3])), n))
        peak = tracemalloc.get_traced_memory()[1]
        tracemalloc.stop()
        assert peak < 2 * 8 * n, (statistic, peak / n)


def test_groups_of_millions_of_rows_are_not_joined_draw_by_draw(spark):
    """A model's rows of all years at six times the large tables: draws times rows would pass a shuffle."""
    groups = spark.createDataFrame([(k, 2_160_000) for k in range(3)], "key long, n long")
    copies, _, larger = D.unit_plan(groups, 2_000)
    assert not larger and copies <= D.UNITS
