import math
import random
from hashlib import sha256

import numpy as np
import pytest
from pyspark.sql import functions as F

from strataloom.operators import score as S
from strataloom.operators import sensitivity as X

WEIGHTS = {"a": 1.0, "b": 0.6, "c": 0.5}
CATEGORIES = {"money": ["a", "b"], "other": ["c"]}


def panel(seed=3, n=9, periods=2):
    r = random.Random(seed)
    return [(f"e{i}", p, *(None if r.random() < 0.2 else float(r.randrange(5)) for _ in WEIGHTS)) for p in range(periods) for i in range(n)]


def frame(spark, rows):
    return spark.createDataFrame(rows, "entity string, period int, a double, b double, c double").repartition(3)


def scored(rows):
    """{entity: (score, rank, known share)} of one period by the definition."""
    total = {r[0]: 0.0 for r in rows}
    known = dict.fromkeys(total, 0)
    for i, c in enumerate(sorted(WEIGHTS)):
        held = [r[2 + i] for r in rows if r[2 + i] is not None]
        for r in rows:
            v = r[2 + i]
            if v is not None and len(held) >= 2:
                total[r[0]] += (sum(h < v for h in held) + (sum(h == v for h in held) + 1) / 2) / len(held) * WEIGHTS[c]
                known[r[0]] += 1
    score = {e: math.floor(min(1.0, t / sum(WEIGHTS.values())) * 1e4 + 0.5 + 1e-9) / 1e4 for e, t in total.items()}
    order = sorted(score, key=lambda e: (-score[e], e))
    return {e: (score[e], order.index(e) + 1, known[e] / len(WEIGHTS)) for e in score}


def test_every_scenario_against_masked_panels(spark):
    rows = panel()
    out = {(r.period, r.mask_name, r.masked_entity): r for r in X.mask_scenarios(frame(spark, rows), WEIGHTS, CATEGORIES).collect()}
    assert len(out) == 2 * 5 * 10
    cols = sorted(WEIGHTS)
    for p in range(2):
        held = [r for r in rows if r[1] == p]
        base = scored(held)
        for name, feats in [*CATEGORIES.items(), *((c, [c]) for c in cols)]:
            for who in ["", *base]:
                masked = scored([tuple(None if j >= 2 and cols[j - 2] in feats and who in ("", r[0]) else v for j, v in enumerate(r)) for r in held])
                delta = {e: masked[e][1] - base[e][1] for e in sorted(base)}
                r, size = out[p, name, who], [abs(d) for d in delta.values()]
                assert (r.moved, r.max_abs_delta) == (sum(d > 0 for d in size), max(size)) and r.mean_abs_delta == pytest.approx(np.mean(size))
                assert (r.median_abs_delta, r.p90_abs_delta) == (pytest.approx(np.median(size)), pytest.approx(np.percentile(size, 90)))
                assert (r.up_entity, r.up_delta) == min(((e, d) for e, d in delta.items()), key=lambda t: (t[1], t[0]))
                assert (r.down_entity, r.down_delta) == min(((e, d) for e, d in delta.items()), key=lambda t: (-t[1], t[0]))
                assert r.mean_abs_confidence_delta == pytest.approx(np.mean([abs(masked[e][2] - base[e][2]) for e in base]))
                scores = [s for s, _, _ in masked.values()]
                assert r.tie_groups == sum(scores.count(s) > 1 for s in set(scores)) and r.directly_masked == (1 if who else len(base))
                assert r.family == ("B" if who else "A") if name in CATEGORIES else r.family == ("D" if who else "C")
                assert r.membership_sha256 == sha256(",".join(sorted(base)).encode()).hexdigest()


def test_the_base_is_the_weighted_score(spark):
    rows = panel(5, 12, 1)
    out = {r.entity: (r.score, r.rank) for r in S.weighted_score(frame(spark, rows), "entity", "period", WEIGHTS).collect()}
    assert out == {e: (pytest.approx(s), k) for e, (s, k, _) in scored(rows).items()}


def test_small_groups_and_unknown_features(spark):
    assert X.mask_scenarios(frame(spark, panel()).limit(0), WEIGHTS, CATEGORIES).count() == 0
    one = X.mask_scenarios(frame(spark, [("x", 1, 1.0, None, 2.0)]), WEIGHTS, CATEGORIES)
    assert {r.moved for r in one.collect()} == {0} and one.count() == 10
    with pytest.raises(ValueError):
        X.mask_scenarios(frame(spark, panel()), WEIGHTS, {"odd": ["z"]})
    grouped = {r.family: r.scenarios for r in X.grouped_scenarios(X.mask_scenarios(frame(spark, panel()), WEIGHTS, CATEGORIES)).collect()}
    assert grouped == {"A": 4, "B": 36, "C": 6, "D": 54}


def test_a_large_period_goes_to_a_bounded_number_of_tasks_and_sorts_by_digits(spark, monkeypatch):
    rows = frame(spark, panel(7, 40, 1))
    whole = {tuple(r) for r in X.mask_scenarios(rows, WEIGHTS, CATEGORIES).collect()}
    monkeypatch.setattr(X, "UNIT_SCENARIOS", 4)
    monkeypatch.setattr(X, "UNITS", 2)
    cut = X.mask_scenarios(rows, WEIGHTS, CATEGORIES)
    assert {tuple(r) for r in cut.collect()} == whole
    assert cut.select(F.spark_partition_id().alias("p"), "masked_entity").where("masked_entity = 'e0'").count() == 5
    values = np.array([[1.0, 2.0, np.nan], [2.0, 2.0, 1.0], [3.0, np.nan, 1.0], [2.0, 5.0, 4.0]])
    assert X.Scored(values, [1.0, 0.6, 0.5], 1.0).without((0,), 1).dtype == np.int16
