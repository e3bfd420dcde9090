import math
import random

from pyspark.sql import functions as F

from strataloom.operators import ranking as K

SCHEMA = "entity int, period int, a double, b double, name string, held array<int>"


def panel(n=1500):
    r = random.Random(1)
    rows = [(i, r.choice([1, 2, None]) if i < 50 else r.choice([1, 2]), r.choice([None, -0.0, 0.0, 1.0, float("nan"), 2.5]), r.random(), f"x{i}", [i]) for i in range(n)]
    return rows + [(n, 1, None, None, None, None)]


def test_ranks_where_a_value_spans_ranges(spark):
    rows = panel()
    # the group's rows fill several ranges and so does each of its values
    df = spark.createDataFrame(rows, SCHEMA).repartition(5)
    out = K.rank_within(df, ["entity", "period"], ["period"], {"ra": ("a", K.average_rank), "rd": ("a", K.min_rank_desc), "rb": ("b", K.pct_average)})
    assert out.columns == [*df.columns, "ra", "rd", "rb"]
    found = {r.entity: r for r in out.collect()}
    assert len(found) == len(rows)
    place = lambda v: math.inf if math.isnan(v) else v
    for e, p, a, b, name, held in rows:
        got = found[e]
        assert (got.period, got.b, got.name, got.held) == (p, b, name, held) and str(got.a) == str(a)
        for value, at, names in ((a, 2, ("ra", "rd")), (b, 3, ("rb",))):
            if p is None or value is None:
                assert all(got[c] is None for c in names)
                continue
            group = [place(x[at]) for x in rows if x[1] == p and x[at] is not None]
            below, ties = sum(v < place(value) for v in group), sum(v == place(value) for v in group)
            wanted = {"ra": below + (ties + 1) / 2, "rd": len(group) - below - ties + 1, "rb": (below + (ties + 1) / 2) / len(group)}
            assert all(abs(got[c] - wanted[c]) < 1e-12 for c in names)


def test_the_ranked_table_is_worked_out_once(spark):
    """Besides the sample that fixes the ranges. It was worked out three times: for the tallies, the ranked rows and the others."""
    seen = spark.sparkContext.accumulator(0)

    def counted(batches):
        for batch in batches:
            seen.add(batch.num_rows)
            yield batch

    df = spark.createDataFrame(panel(400), SCHEMA).mapInArrow(counted, SCHEMA)
    K.pct_rank(df, ["entity", "period"], ["period"], ["a", "b"]).agg(F.count(F.lit(1))).collect()
    assert seen.value <= 2 * 401
