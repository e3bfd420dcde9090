import math
import random

import numpy as np
import pytest

from strataloom.operators import draws as D
from strataloom.operators import inference as N
from tests.test_draws import corr, frame, groups, keys, panel, ranks


@pytest.mark.parametrize("k", [1, 4])
def test_leave_k_out_against_plain_loops(spark, k):
    rows, draws, seed = panel(7), 30, 9
    rows = [r for r in rows if r[1] < 9]
    out = {(r.model, r.draw): r.pooled_ic for r in N.leave_k_out(frame(spark, rows), draws, seed, k).collect()}
    held = groups(rows)
    key = keys(spark, rows, seed, [])
    assert len(out) == 2 * draws
    for m in ("a", "b"):
        flat = [(p, i) for p in (1, 2, 3) for i in range(len(held[m, p]))]
        for d in range(draws):
            gone = {flat[t] for t in D.permuted(D.draw_keys(key[m, 1], np.array([d])), np.arange(k), len(flat))[0]}
            assert len(gone) == k
            each = []
            for p in (1, 2, 3):
                kept = [h for i, h in enumerate(held[m, p]) if (p, i) not in gone]
                each.append(corr(ranks([h[1] for h in kept]), ranks([h[2] for h in kept])))
            want = None if None in each else sum(each) / 3
            assert (out[m, d] is None) == (want is None) and (want is None or abs(out[m, d] - want) < 1e-9)
    summary = {r.model: r for r in N.distribution_summary(N.leave_k_out(frame(spark, rows), draws, seed, k), "pooled_ic").collect()}
    values = [v for (m, _), v in out.items() if m == "a" and v is not None]
    assert summary["a"]["count"] == len(values) and np.allclose([summary["a"].p2_5, summary["a"].std], [np.percentile(values, 2.5), np.std(values, ddof=1)])


def test_binomial_tail_and_wilson(spark):
    rows = [(f"c{k}", (0.01 if i < k else 0.5) if i < 40 else None) for k in (0, 1, 5, 40) for i in range(42)]
    out = {r.control: r for r in N.rejection_rates(spark.createDataFrame(rows, "control string, p_value double")).collect()}
    for k in (0, 1, 5, 40):
        r = out[f"c{k}"]
        tail = sum(math.comb(40, x) * 0.05**x * 0.95 ** (40 - x) for x in range(k, 41))
        assert (r.repetitions, r.analyzable, r.rejections) == (42, 40, k) and abs(r.upper_tail - tail) < 1e-9
        z, p = 1.959963984540054, k / 40
        centre, radius = (p + z * z / 80) / (1 + z * z / 40), z * math.sqrt(p * (1 - p) / 40 + z * z / 6400) / (1 + z * z / 40)
        assert abs(r.wilson_low - max(0, centre - radius)) < 1e-9 and abs(r.wilson_high - min(1, centre + radius)) < 1e-9
    assert out["c5"].fails == (out["c5"].upper_tail < 0.01) and out["c40"].fails and not out["c1"].fails


def test_forward_test_cells(spark):
    r = random.Random(1)
    frozen = spark.createDataFrame([(f"e{i}", float(i)) for i in range(40)], "entity string, score double")
    told = lambda f, n=40: spark.createDataFrame([(f"e{i}", f(i)) for i in range(n)] + [("stranger", 1.0)], "entity string, outcome double")
    up = N.forward_test(frozen, told(lambda i: i + r.random() * 10, 35), 2000, 1).first()
    assert up.interpretation == "positive_and_statistically_distinguishable" and (up.frozen, up.usable) == (40, 35) and up.p_value < 0.01
    down = N.forward_test(frozen, told(lambda i: -float(i)), 500, 1).first()
    assert down.interpretation == "negative_and_statistically_distinguishable" and down.ic == -1
    assert N.forward_test(frozen, told(lambda i: None), 500, 1).first().interpretation == "outcomes_absent"


def test_monotonicity_and_equivalence(spark):
    rows = [("m", f"e{i}", float(i), float(50 - i)) for i in range(30)] + [("flat", f"e{i}", 1.0, float(i)) for i in range(30)]
    out = {r.model: r for r in N.monotonicity(spark.createDataFrame(rows, "model string, entity string, confidence double, rank_error double"), 200, 3).collect()}
    assert out["m"].observed == pytest.approx(1) and out["m"].ci_low == pytest.approx(1) and out["m"].status == "estimated"
    assert out["flat"].status == "not_estimable" and out["flat"].ci_low is None
    reps = spark.createDataFrame([("a", 0.01), ("a", -0.01), ("a", 0.0), ("b", 0.2), ("b", 0.3), ("c", 0.01)], "model string, ic double")
    same = {r.model: r for r in N.equivalence_summary(reps, 0.05).collect()}
    assert same["a"].equivalent_to_zero and not same["b"].equivalent_to_zero and same["c"].low == same["c"].high == pytest.approx(0.01)
