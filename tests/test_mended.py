"""Faults that were found in the operators, each on a few rows; and plans that read their input a bounded number of times."""

import datetime as dt
import hashlib
import random

import pytest

from strataloom.operators import panel as B
from strataloom.operators import pointintime as T
from strataloom.operators import quality as Q
from strataloom.operators.asof import asof_join
from strataloom.operators.ranking import average_rank, ordinal, rank_within, tally_ranks
from strataloom.sources.panel_files import first_available_source
from strataloom.sources.quotes import year_end_quote


def leaves(df):
    """Reads of files in the analysed plan."""
    return df._jdf.queryExecution().analyzed().toString().count("Relation [")


def test_next_label_leaves_out_last_rows(spark):
    rows = [("a", 1, 1.0, -1.0), ("a", 2, 2.0, -1.0), ("a", 3, None, 1.0), ("a", 4, 5.0, 1.0)]
    df = spark.createDataFrame(rows, "e string, p int, income double, ret double")
    assert [(r.p, r.label) for r in B.next_period_label(df, "e", "p", "income", "ret").collect()] == [(1, 0)]


def test_ledger_faults(spark):
    def line(n, previous, body, event=None):
        return ("l", n, event or f"e{n}", previous, body, hashlib.sha256(f"{previous}|{body}".encode()).hexdigest())

    schema = "ledger string, seq long, event_id string, previous_hash string, body string, hash string"
    good = [line(1, Q.GENESIS, "a")]
    good.append(line(2, good[0][5], "b"))
    good.append(line(3, good[1][5], "c"))
    code = lambda rows: Q.ledger_verify(spark.createDataFrame(rows, schema), "ledger", "seq").first()
    assert (code(good).code, code(good).n_lines) == (None, 3)
    assert (code([good[0], line(3, Q.GENESIS, "c")]).first_bad_line, code([good[0], line(3, Q.GENESIS, "c")]).code) == (3, "missing_line")
    assert code([good[0], line(2, Q.GENESIS, "b")]).code == "broken_link"
    assert code([good[0], ("l", 2, "e2", None, "b", None)]).code == "missing_field"
    assert code([good[0], good[1][:5] + ("0" * 64,)]).code == "hash_mismatch"
    assert code([good[0], line(2, good[0][5], "b", "e1")]).code == "duplicate_event_id"


def test_digests_tell_fields_and_nulls_apart(spark):
    rows = [("a|b", "c"), ("a", "b|c"), ("~", "x"), (None, "x")]
    digests = [Q.table_digest(spark.createDataFrame([r], "x string, y string"), [], ["x", "y"]).first().digest for r in rows]
    assert len(set(digests)) == 4


def test_target_refuses_duplicate_base_keys(spark):
    base = spark.createDataFrame([(1, 1), (1, 2)], "k int, v int")
    with pytest.raises(B.PanelError):
        B.attach_target(base, spark.createDataFrame([(1, 5.0)], "k int, t double"), ["k"], "t", "out")


def test_overview_of_text_entities(spark):
    df = spark.createDataFrame([("B", 1, 1.0, 5.0), ("A", 1, 2.0, 5.0), ("C", 1, 3.0, None)], "e string, p int, s double, r double")
    bench = spark.createDataFrame([(1, 1.0)], "p int, benchmark double")
    assert {r.best_entity for r in B.year_overview(df, "e", "p", "s", "r", bench).collect()} == {"A"}


def test_overlapping_regimes_have_no_label(spark):
    d = dt.date
    reg = spark.createDataFrame([(d(2020, 1, 1), d(2020, 6, 30), "x"), (d(2020, 6, 1), d(2020, 12, 31), "y")], "s date, e date, label string")
    days = spark.createDataFrame([(d(2020, 2, 1),), (d(2020, 6, 15),), (d(2021, 1, 1),)], "d date")
    out = {r.d.month: (r.label, r.n_matches) for r in T.interval_join(days, reg, "d", "s", "e", "label").collect()}
    assert out == {2: ("x", 1), 6: (None, 2), 1: (None, 0)}


def test_year_end_quote_of_an_earlier_year(spark):
    p = spark.createDataFrame([("s", dt.date(2020, 3, 1), 7.0, None), ("s", dt.date(2022, 1, 2), 9.0, 8.0)], "symbol string, date date, close double, adjclose double")
    grid = spark.createDataFrame([("s", 2019), ("s", 2021), ("s", 2022)], "symbol string, year int")
    out = {r.year: (r.close, r.adjclose, r.status) for r in year_end_quote(p, ["symbol"], "date", "close", "adjclose", grid).collect()}
    assert out == {2019: (None, None, "error"), 2021: (7.0, 7.0, "success"), 2022: (9.0, 8.0, "success")}


def test_first_source_by_presence(spark):
    a = spark.createDataFrame([("x", 1, -5.0, 1), ("x", 2, 3.0, 1), ("x", 2, 0.0, 2)], "e string, k int, v double, o int")
    b = spark.createDataFrame([("x", 1, 9.0, 1), ("y", 1, 4.0, 1)], "e string, k int, v double, o int")
    assert [(r.e, r.v) for r in first_available_source([a, b], "e", "k", "v", "o").collect()] == [("y", 4.0)]


def test_ranks_of_awkward_values(spark):
    r = random.Random(3)
    values = [0.0] * 200 + [float("inf"), float("-inf"), float("nan")] + [r.gauss(0, 1) ** 9 for _ in range(300)] + [None] * 5
    rows = [("g", f"Customer#000000{i:06d}", v) for i, v in enumerate(values)]
    df = spark.createDataFrame(rows, "g string, key string, v double").repartition(9)
    known = sorted((v for v in values if v is not None), key=lambda v: (v != v, v))
    for row in tally_ranks(df, ["g"], "v").collect():
        first = next(i for i, v in enumerate(known) if v == row.v or (v != v and row.v != row.v))
        assert (row.below, row.n) == (first, len(known))
    out = {x.key: x.rank for x in ordinal(df, ["g"], "v", "key", "rank", descending=False).collect()}
    order = sorted((x for x in rows if x[2] is not None), key=lambda x: (x[2] != x[2], x[2] if x[2] == x[2] else 0.0, x[1]))
    assert out == {x[1]: i for i, x in enumerate(order, 1)}


def test_plans_read_their_input_a_bounded_number_of_times(spark, tmp_path):
    def stored(rows, schema, name):
        spark.createDataFrame(rows, schema).write.parquet(str(tmp_path / name))
        return spark.read.parquet(str(tmp_path / name))

    df = stored([("g", "a", 1.0), ("g", "b", 2.0)], "g string, key string, v double", "df")
    assert leaves(df) == 1
    assert leaves(rank_within(df, ["g", "key"], ["g"], {"r": ("v", average_rank)})) <= 2
    assert leaves(ordinal(df, ["g"], "v", "key", "rank")) == 0  # everything comes from the checkpoint
    left = stored([("k", 1)], "k string, t int", "left")
    right = stored([("k", 0, 5.0)], "k string, at int, x double", "right")
    chain = left
    for i in range(12):
        chain = asof_join(chain, right.withColumnsRenamed({"at": f"at{i}", "x": f"x{i}"}), ["k"], "t", f"at{i}", [f"x{i}"])
    assert leaves(chain) == 13
    assert [r.x11 for r in chain.collect()] == [5.0]


def test_ledger_without_joins_against_a_walk_line_by_line(spark):
    import random

    r, rows = random.Random(6), []
    digest = lambda previous, body: hashlib.sha256(f"{previous}|{body}".encode()).hexdigest()
    for ledger in range(60):
        previous = Q.GENESIS
        for n in range(1, 8):
            h = digest(previous, f"b{n}")
            rows.append([f"l{ledger}", n, f"e{n}", previous, f"b{n}", h])
            previous = h
        for _ in range(r.randrange(3)):
            at, what = r.randrange(len(rows) - 7, len(rows)), r.randrange(7)
            if what < 5:
                rows[at][(1, 2, 3, 4, 5)[what]] = r.choice([None, {0: 4, 1: "e2", 2: Q.GENESIS, 3: "x", 4: "0"}[what]])
            elif what == 5:
                rows.append([*rows[at][:2], "extra", *rows[at][3:]])
            else:
                rows[at][1] = 0

    def walk(own):
        held, seen, bad = {}, {}, []
        for row in own:
            held.setdefault(row[1], []).append(row)
            if None not in row[1:3]:
                seen[row[2]] = min(seen.get(row[2], row[1]), row[1])
        for _, n, event, previous, body, h in own:
            before = held.get(n - 1) if n is not None else None
            code = (
                "missing_event_id" if event is None
                else "missing_field" if None in (n, previous, body, h)
                else "bad_line_number" if len(held[n]) > 1 or n < 1
                else "duplicate_event_id" if n != seen[event]
                else "missing_line" if n != 1 and before is None
                else "broken_link" if (previous != Q.GENESIS if n == 1 else previous not in [b[5] for b in before])
                else "hash_mismatch" if h != digest(previous, body)
                else None
            )
            if code:
                bad.append((n or 0, code))
        return (len(own), *(min(bad) if bad else (None, None)))

    out = Q.ledger_verify(spark.createDataFrame([tuple(x) for x in rows], "ledger string, seq long, event_id string, previous_hash string, body string, hash string"), "ledger", "seq")
    assert "Join" not in out._jdf.queryExecution().executedPlan().toString()
    told = {x.ledger: (x.n_lines, x.first_bad_line, x.code) for x in out.collect()}
    assert told == {name: walk([x for x in rows if x[0] == name]) for name in {x[0] for x in rows}}
