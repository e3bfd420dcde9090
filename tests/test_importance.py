import numpy as np
from pyspark.sql import functions as F

from strataloom.operators import importance as I

COLS = ["strong", "weak", "noise", "flat"]


def made(spark, n=300):
    r = np.random.default_rng(4)
    rows = []
    for i in range(n):
        a, b, c = r.normal(size=3)
        rows.append((i, float(a), float(b), None if i % 13 == 0 else float(c), 1.0, float(4 * a + b + 0.1 * r.normal())))
    return spark.createDataFrame(rows, "id int, strong double, weak double, noise double, flat double, target double")


def test_methods_put_the_strong_column_first(spark):
    found = I.importances(made(spark), COLS, ["id"], "target", trees=30)
    out = {(r.feature, r.method): r for r in found.collect()}
    assert len(out) == len(COLS) * len(I.METHODS)
    for m in ("pearson", "spearman", "mutual_information", "lasso", "forest", "shap"):
        assert out["strong", m].normalised == 1 and out["noise", m].raw < out["weak", m].raw
    assert out["flat", "pearson"].raw == out["flat", "lasso"].raw == out["flat", "cluster"].raw == 0
    assert out["strong", "elimination"].raw == 1 and sum(out[c, "elimination"].raw for c in COLS) == 2
    assert {r.method: r.feature for r in I.strongest(found).collect()}["pearson"] == "strong"


def test_mutual_information_by_hand(spark):
    rows = [(i, float(i % 4), float(i % 4), float(i)) for i in range(40)]
    df = spark.createDataFrame(rows, "id int, x double, y double, z double")
    out = I.mutual_information(df, ["x"], ["id"], "y").first()
    assert abs(out.mutual_information - np.log(4)) < 1e-9
    two = spark.createDataFrame([(i, float(i % 2), float(i // 2 % 2)) for i in range(40)], "id int, x double, y double")
    assert abs(I.mutual_information(two, ["x"], ["id"], "y").first().mutual_information) < 1e-9


def test_medians_fill(spark):
    df = spark.createDataFrame([(1, 1.0, None), (2, 3.0, None), (3, None, None), (4, float("nan"), None)], "id int, a double, b double")
    assert {r.id: (r.a, r.b) for r in I.median_filled(df, ["a", "b"]).collect()} == {1: (1.0, 0.0), 2: (3.0, 0.0), 3: (2.0, 0.0), 4: (2.0, 0.0)}
    equal = df.select(F.lit("m").alias("m"), F.lit(2.0).alias("raw")).withColumn("p", I.minmax_share("raw", "m"))
    assert {r.p for r in equal.collect()} == {0.5}
