import math
import random
from collections import Counter, defaultdict

import numpy as np
import pytest
from pyspark.sql import functions as F

from strataloom.operators import controls as C
from strataloom.operators import structure as S

KEYS = ["entity", "period"]


def panel(n=60, periods=3):
    r = random.Random(1)
    return [(f"e{i}", p, None if r.random() < 0.2 else float(r.randrange(20)), None if r.random() < 0.3 else r.random(), r.random()) for i in range(n) for p in range(periods)]


def frame(spark, rows):
    return spark.createDataFrame(rows, "entity string, period int, x double, y double, target double").repartition(4)


def by_period(rows, at):
    out = defaultdict(list)
    for r in rows:
        out[r[1]].append(r[at])
    return out


def test_permuted_columns_keep_multiset_and_nulls(spark):
    rows = panel()
    out = [tuple(r) for r in C.permute_column(frame(spark, rows), "x", ["period"], KEYS, 3).select("entity", "period", "x", "y", "target").collect()]
    assert {k: Counter(v) for k, v in by_period(out, 2).items()} == {k: Counter(v) for k, v in by_period(rows, 2).items()}
    old = {r[:2]: r for r in rows}
    assert all((r[2] is None) == (old[r[:2]][2] is None) and r[3:] == old[r[:2]][3:] for r in out)
    assert sum(r[2] != old[r[:2]][2] for r in out) > 50
    again = [tuple(r) for r in C.permute_column(frame(spark, rows[::-1]), "x", ["period"], KEYS, 3).select("entity", "period", "x", "y", "target").collect()]
    assert sorted(out, key=str) == sorted(again, key=str)


def test_masks_move_as_whole_rows(spark):
    rows = panel()
    mask = C.permute_mask(frame(spark, rows), ["x", "y"], ["period"], KEYS, 4).collect()
    before = {p: Counter((r[2] is None, r[3] is None) for r in rows if r[1] == p) for p in range(3)}
    assert {p: Counter(tuple(m.missing) for m in mask if m.period == p) for p in range(3)} == before
    full = frame(spark, [(e, p, 1.0, 2.0, t) for e, p, _, _, t in rows])
    held = C.apply_mask(full, C.permute_mask(frame(spark, rows), ["x", "y"], ["period"], KEYS, 4), ["x", "y"], KEYS).collect()
    said = {(m.entity, m.period): tuple(m.missing) for m in mask}
    assert all((r.x is None, r.y is None) == said[r.entity, r.period] for r in held)


def test_noise_is_standard_normal_and_repeats(spark):
    df = spark.range(20_000).select(F.concat(F.lit("e"), "id").alias("entity"), F.lit(1).alias("period"))
    got = np.array([r[0] for r in C.noise_panel(df, ["x"], KEYS, 9).select("x").collect()])
    assert abs(got.mean()) < 0.03 and abs(got.std() - 1) < 0.02 and abs((got**4).mean() - 3) < 0.25
    assert C.noise_panel(df.repartition(7), ["x"], KEYS, 9).agg(F.sum("x")).first()[0] == pytest.approx(got.sum())


def test_rank_matched_follows_the_latent_order(spark):
    rows = panel()
    out = C.rank_matched(frame(spark, rows), "x", "target", ["period"], KEYS).collect()
    old = {r[:2]: r[2] for r in rows}
    for p in range(3):
        known = sorted((r for r in out if r.period == p and r.x is not None), key=lambda r: r.target)
        assert [r.x for r in known] == sorted(v for k, v in old.items() if k[1] == p and v is not None)
    assert all((r.x is None) == (old[r.entity, r.period] is None) for r in out)


def test_faults_and_matrix(spark):
    rows = [(f"e{i}", p, float(10 * i + p), 0.0, float(i + p) if p < 3 else None) for i in range(6) for p in range(4)]
    df = frame(spark, rows)
    get = lambda kind: {(r.entity, r.period): r for r in C.inject_fault(df, kind, "x").collect()}
    assert get("future_value")["e2", 1].x == 22.0 and get("future_value")["e2", 3].x == 23.0
    moved = get("rotated_target")
    assert [moved["e2", p].target for p in range(4)] == [4.0, 2.0, 3.0, None]
    assert C.inject_fault(df, "duplicated_period", "x").count() == 30 and get("leaked_column")["e1", 1].leaked == 2.0
    assert {(e, p) for e, p in get("outcome_selected_rows") if p == 0} == {("e3", 0), ("e4", 0), ("e5", 0)}
    with pytest.raises(ValueError):
        C.inject_fault(df, "other", "x")
    guards = {"keys": lambda d: d.groupBy(*KEYS).count().where("count > 1"), "always": lambda d: d}
    out = {(r.fault, r.guard): r for r in C.fault_matrix(df, "x", guards).collect()}
    assert out["duplicated_period", "keys"].detected and not out["rotated_target", "keys"].detected
    assert not any(r.detected for (_, g), r in out.items() if g == "always")


def test_differences(spark):
    a, b = frame(spark, [("a", 1, 1.0, None, 1.0), ("b", 1, 2.0, 1.0, 1.0), ("c", 1, 3.0, 1.0, 1.0)]), frame(spark, [("a", 1, 1.0, None, 1.0), ("b", 1, None, 1.0, 1.0), ("d", 1, 3.0, 1.0, 1.0)])
    out = {r.column: r for r in C.frame_diff(a, b, KEYS, ["x", "y"]).collect()}
    assert (out["x"].changed, out["y"].changed, out["x"].only_left, out["x"].only_right, out["y"].equal) == (1, 0, 1, 1, False)
    assert C.multiset_diff(a, b, ["period"], ["x"]).first().differing == 2


def test_attenuation(spark):
    rows = [("m", 0, 0.5), ("m", 1, 0.25), ("m", 2, None), ("m", 3, 0.1), ("z", 0, 0.0), ("z", 1, 0.1)]
    out = {(r.model, r.stage): r for r in C.attenuation(spark.createDataFrame(rows, "model string, stage int, ic double")).collect()}
    assert out["m", 1].ratio_to_injected == out["m", 1].ratio_to_previous == 0.5 and out["m", 0].ratio_to_injected is None
    assert out["m", 3].ratio_to_injected == pytest.approx(0.2) and out["m", 3].ratio_to_previous is None and out["z", 1].ratio_to_injected is None


def test_components_on_paths_and_cliques(spark):
    r = random.Random(2)
    nodes = list(range(200))
    edges = [(i, i + 1) for i in range(60)] + [(a, b) for a in range(100, 110) for b in range(a, 110)] + [(r.randrange(120, 200), r.randrange(120, 200)) for _ in range(50)]
    found = {x.node: x.label for x in S.component_labels(spark.createDataFrame([(n,) for n in nodes], "node int"), spark.createDataFrame(edges, "a int, b int")).collect()}
    label = dict(zip(nodes, nodes))
    for _ in nodes:
        for a, b in edges:
            label[a] = label[b] = min(label[a], label[b])
    assert found == label


def test_effective_rank(spark):
    ratio, rank = S.spectrum(np.eye(5))
    assert ratio == pytest.approx(5) and rank == pytest.approx(5)
    ratio, rank = S.spectrum(np.ones((4, 4)))
    assert ratio == pytest.approx(1) and rank == pytest.approx(1)
    rows = [("a", "b", 0.5), ("a", "a", 1.0), ("b", "b", 1.0)]
    row = S.effective_rank(spark.createDataFrame(rows, "a string, b string, correlation double")).first()
    assert row.participation_ratio == pytest.approx(4 / (1.5**2 + 0.5**2)) and row.effective_rank == pytest.approx(math.exp(-(0.75 * math.log(0.75) + 0.25 * math.log(0.25))))
    assert S.effective_rank(spark.createDataFrame([("a", "b", None)], "a string, b string, correlation double")).first().effective_rank is None


def test_tails(spark):
    train = frame(spark, [(f"e{i}", 0, float(i), float(i) if i < 5 else None, 0.0) for i in range(41)])
    limits = S.tail_thresholds(train, ["x", "y"], 0.05)
    held = {r.feature: r for r in limits.collect()}
    assert (held["x"].low, held["x"].high, held["y"].status, held["y"].low) == (2.0, 38.0, "insufficient_support", None)
    wide, cut = (f(train, limits, ["x", "y"]) for f in (S.winsorise, S.trim))
    assert wide.agg(F.min("x"), F.max("x")).first()[:] == (2.0, 38.0) and cut.where("x IS NULL").count() == 4 and wide.where("y IS NOT NULL").count() == 5
    audit = {r.feature: r for r in S.tail_audit(train.withColumn("role", F.lit("train")), limits, ["x", "y"]).collect()}
    assert (audit["x"].below, audit["x"].above, audit["y"].status) == (2, 2, "no_op")
