import numpy as np
from pyspark.sql import functions as F

from strataloom.llm.vectors import near_vectors


def brute(rows):
    kept, units = [], []
    for i, v in rows:
        if v and None not in v and np.isfinite(v).all() and np.any(np.array(v) != 0):
            x = np.array(v, float)
            kept.append(i)
            units.append(x / np.sqrt(x @ x))
    s = np.stack(units)
    near = s @ s.T >= 0.9
    np.fill_diagonal(near, False)
    low = np.arange(len(kept))
    ids = np.array(kept)
    order = ids.copy()
    while True:
        new = order.copy()
        for a in low:
            if near[a].any():
                new[a] = min(order[a], order[near[a]].min())
        if (new == order).all():
            break
        order = new
    out = {i: (int(near[k].sum()), int(order[k])) for k, i in enumerate(kept)}
    return [(i, *out.get(i, (0, i))) for i, _ in rows]


def test_brute_force_and_recall(spark):
    r = np.random.default_rng(1)
    rows = []
    for c in range(30):
        centre = r.normal(size=24)
        for _ in range(int(r.integers(1, 14))):
            rows.append(centre + r.normal(size=24) * r.choice([0.02, 0.1, 0.2]))
    hot = r.normal(size=24)
    rows += [hot + r.normal(size=24) * 0.03 for _ in range(150)] + [hot * 2.0] * 30
    rows = [(i, [float(x) for x in v]) for i, v in enumerate(rows)]
    n = len(rows)
    rows += [(n, None), (n + 1, []), (n + 2, [0.0] * 24), (n + 3, [float("nan")] + [1.0] * 23), (n + 4, [None] + [1.0] * 23), (n + 5, [float("inf")] + [1.0] * 23)]
    table = spark.createDataFrame(rows, "vec_id long, embedding array<double>").withColumns({"node": F.lit("x"), "unit": F.lit(1), "label": F.lit(2)})
    out = near_vectors(table, block=64).collect()
    expected = brute(rows)
    assert len(out) == len(rows)
    links, exact = sum(x.n_links for x in out), sum(e[1] for e in expected)
    assert 0.97 * exact <= links <= exact
    got = {x.vec_id: (x.n_links, x.component_id) for x in out}
    assert sum(got[i] == (k, c) for i, k, c in expected) >= 0.97 * len(expected)
    assert all(x.kept == (x.vec_id == x.component_id) for x in out)


def test_other_lengths_repeated_ids_and_empty(spark):
    rows = [(4, [1.0, 0.0]), (4, [1.0, 0.0]), (9, [1.0, 0.0, 0.0]), (2, [2.0, 0.01]), (None, [3.0, 0.0])]
    table = spark.createDataFrame(rows, "vec_id long, embedding array<double>")
    out = sorted((str(x.vec_id), x.n_links, x.component_id) for x in near_vectors(table).collect())
    assert out == [("2", 3, 2), ("4", 3, 2), ("4", 3, 2), ("9", 0, 9), ("None", 3, 2)]
    assert near_vectors(table.limit(0)).count() == 0
