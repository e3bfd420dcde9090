from strataloom.operators import provenance as V


def cells(spark, rows):
    return spark.createDataFrame(rows, "entity string, period int, column string, number double, text string")


def test_priorities_tolerance_and_notes(spark):
    specs = [
        V.ColumnSpec("x", "source", "vendor", candidates=(V.Candidate("one", "x", "first", "T1"), V.Candidate("two", "x", "second", "T2"), V.Candidate("three", "x", "third", "T3", 7))),
        V.ColumnSpec("name", "source", "vendor", numeric=False, candidates=(V.Candidate("two", "name", "second", "T2"),)),
        V.ColumnSpec("said", "asserted", "manual", "TA"),
        V.ColumnSpec("made", "chained", "derived", "TC"),
    ]
    sources = {
        "one": spark.createDataFrame([("a", 1, "100.000001", "r1"), ("b", 1, "oops", "r2"), ("c", 1, "5", "r3"), ("d", 1, "", "r4")], "entity string, period int, x string, retrieved_at string"),
        "two": spark.createDataFrame([("a", 1, 100.0, "n"), ("c", 1, 6.0, "m")], "entity string, period int, x double, name string"),
        "three": spark.createDataFrame([(7, 9.0), (1, 3.0)], "period int, x double"),
    }
    rows = [(e, p, "x", v, str(v)) for e, p, v in (("a", 1, 100.0), ("b", 1, 1.0), ("c", 1, 7.0), ("d", 1, 2.0), ("e", 1, 3.0), ("e", 7, 9.0))]
    rows += [("f", 1, "x", None, None), ("a", 1, "name", None, "n"), ("c", 1, "name", None, "other"), ("a", 1, "said", 1.0, "1"), ("a", 1, "made", 1.0, "1"), ("b", 1, "made", None, None)]
    out = {(r.entity, r.period, r.column): r for r in V.cell_provenance(cells(spark, rows), specs, sources).collect()}
    assert len(out) == len(rows)
    x = lambda e, p=1: out[e, p, "x"]
    # off by more than the tolerance in the first source, equal in the second
    assert (x("a").source, x("a").source_class, x("a").transform, x("a").note) == ("two", "second", "T2", "")
    assert (x("b").evidence_level, x("b").note, x("b").transform) == ("unknown", "value_unparseable", "T_UNRESOLVED")
    assert x("c").note == "value_mismatch_all_candidates" and x("d").note == "value_unparseable"
    # the third source is asked in period 7 only, and has no entities
    assert x("e").note == "no_upstream_row" and (x("e", 7).source, x("e", 7).source_period) == ("three", 7)
    assert (x("f").value_state, x("f").evidence_level, x("f").note) == ("null", "column_asserted", "null_preserved")
    assert out["a", 1, "name"].evidence_level == "cell_verified" and out["c", 1, "name"].evidence_level == "unknown"
    assert (out["a", 1, "said"].source_class, out["a", 1, "made"].evidence_level, out["b", 1, "made"].evidence_level) == ("manual", "derived_chain", "derived_chain")


def test_two_matches_take_the_first(spark):
    specs = [V.ColumnSpec("x", "source", "v", candidates=(V.Candidate("one", "x", "first", "T1"), V.Candidate("two", "x", "second", "T2")))]
    source = spark.createDataFrame([("a", 1, 2.0 + 1e-12)], "entity string, period int, x double")
    row = V.cell_provenance(cells(spark, [("a", 1, "x", 2.0, "2.0")]), specs, {"one": source, "two": source}).first()
    assert (row.source, row.note) == ("one", "multi_candidate_priority_applied")


def test_edges_and_checks(spark):
    rows = [(e, p, c, 1.0, "1") for e in "ab" for p in range(1, 5) for c in ("base", "mom", "hist") if not (e == "b" and p == 2 and c == "base")]
    held = cells(spark, rows)
    edges = V.lineage_edges(held, [V.Rule("mom", "base", (-1, 0)), V.Rule("hist", "base"), V.Rule("base", "gone", (0,))])
    names = {(r.cell, r.upstream) for r in edges.collect()}
    want = set()
    have = {(e, p, c) for e, p, c, *_ in rows}
    for e, p, c in have:
        ups = [p - 1, p] if c == "mom" else range(1, p + 1) if c == "hist" else []
        want |= {(f"{e}|{p}|{c}", f"{e}|{q}|base") for q in ups if (e, q, "base") in have}
    assert names == want
    found = {r.check: r.violations for r in V.lineage_checks(held, edges, 8, ["base", "mom", "hist"]).collect()}
    assert found == {"record_count": 1, "duplicate_cells": 0, "short_columns": 1, "self_edges": 0, "missing_upstream": 0, "cyclic_edges": 0}
    more = spark.createDataFrame([("a|1|base", "a|2|mom"), ("a|9|x", "a|9|x"), ("a|1|mom", "lost")], "cell string, upstream string")
    found = {r.check: r.violations for r in V.lineage_checks(held, edges.unionByName(more), 8, ["base", "mom", "hist"]).collect()}
    # a|2|mom -> a|1|base -> a|2|mom, and what leads there, and the edge to itself
    assert found["self_edges"] == 1 and found["missing_upstream"] == 2 and found["cyclic_edges"] > 2


def test_peeling_finds_exactly_the_cycles_and_what_leads_to_them(spark):
    edges = [("a", "b"), ("b", "c"), ("c", "a"), ("x", "a"), ("c", "end"), ("p", "q"), ("q", "r")]
    left = {(r.cell, r.upstream) for r in V.cyclic_edges(spark.createDataFrame(edges, "cell string, upstream string")).collect()}
    assert left == {("a", "b"), ("b", "c"), ("c", "a"), ("x", "a")}
    assert V.cyclic_edges(spark.createDataFrame([], "cell string, upstream string")).count() == 0
