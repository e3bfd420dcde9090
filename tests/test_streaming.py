import datetime as dt
import hashlib

from pyspark.sql import functions as F

from strataloom.operators.quality import GENESIS
from strataloom.streaming import streams as K

T0 = dt.datetime(2024, 1, 1)


def hours(n):
    return T0 + dt.timedelta(hours=n)


def fed(spark, folder, batches, schema, build, mode, key):
    """Run the stream over files that arrive one by one; the last row told for each key, or all rows in append mode."""
    source = folder / "in"
    source.mkdir()
    stream = spark.readStream.schema(schema).option("maxFilesPerTrigger", 1).json(str(source))
    seen = []
    query = None
    for i, rows in enumerate(batches):
        spark.createDataFrame(rows, schema).coalesce(1).write.mode("append").json(str(source))
        query = build(stream).writeStream.outputMode(mode).option("checkpointLocation", str(folder / "cp")).foreachBatch(lambda b, n: seen.extend(b.collect())).trigger(availableNow=True).start()
        query.awaitTermination()
    return {tuple(r[k] for k in key): r for r in seen} if key else seen


def test_verdict_counts_drop_late_rows(spark, tmp_path):
    schema = "entity string, at timestamp, verdict string"
    batches = [[("a", hours(0), "buy"), ("a", hours(1), "sell"), ("b", hours(1), "buy")], [("a", hours(30), "buy")], [("a", hours(2), "buy"), ("a", hours(31), "buy")], [("b", hours(90), "buy")]]
    build = lambda s: K.stream_verdict_counts(s, "entity", "at", "verdict", ["buy", "sell"], "24 hours")
    out = fed(spark, tmp_path, batches, schema, build, "update", ["entity", "window_start"])
    assert (out["a", hours(0)].n_buy, out["a", hours(0)].n_sell) == (1, 1)  # the late row at hour 2 is not counted
    assert out["a", hours(24)].n_buy == 2 and out["b", hours(72)].n_buy == 1
    kept = [r for b in batches for r in b if r != ("a", hours(2), "buy")]
    batch = build(spark.createDataFrame(kept, schema)).collect()
    assert {(r.entity, r.window_start): r.n_buy for r in batch} == {k: r.n_buy for k, r in out.items()}
    sliding = K.stream_verdict_counts(spark.createDataFrame(kept, schema), "entity", "at", "verdict", ["buy"], "24 hours", "12 hours")
    assert sliding.where("entity = 'b'").count() == 4


def test_latest_period_and_ledger(spark, tmp_path):
    (tmp_path / "p").mkdir()
    (tmp_path / "l").mkdir()
    out = fed(spark, tmp_path / "p", [[("a", 2001), ("b", 1999)], [("a", 2000)], [("b", 2002)]], "entity string, period long", lambda s: K.stream_latest_period(s, "entity", "period"), "update", ["entity"])
    assert {k[0]: (r.latest, r.n_rows) for k, r in out.items()} == {"a": (2001, 2), "b": (2002, 2)}

    def line(n, previous, body):
        return (n, previous, body, hashlib.sha256(f"{previous}|{body}".encode()).hexdigest())

    good = [line(1, GENESIS, "x")]
    for n in (2, 3):
        good.append(line(n, good[-1][3], f"x{n}"))
    forged = [line(1, GENESIS, "y"), (2, None, "y2", None)]
    batches = [[("good", *good[0]), ("bad", *forged[0])], [("good", *good[2]), ("good", *good[1])], [("bad", *forged[1])]]
    schema = "ledger string, seq long, previous_hash string, body string, hash string"
    out = fed(spark, tmp_path / "l", batches, schema, lambda s: K.stream_ledger_check(s, "ledger", "seq"), "update", ["ledger"])
    assert (out["good",].n_lines, out["good",].code) == (3, None)
    assert (out["bad",].first_bad_line, out["bad",].code) == (2, "missing_field")


def test_pit_guard_and_ingest(spark, tmp_path):
    values = spark.createDataFrame([("a", hours(1), 1.0), ("b", hours(5), 2.0), ("b", hours(900), 3.0)], "ticker string, available timestamp, v double")
    predictions = spark.createDataFrame([("a", hours(4)), ("b", hours(4)), ("c", hours(4))], "ticker string, at timestamp")
    out = K.stream_pit_guard(values, predictions, "ticker", "available", "at", delay="2 hours").collect()
    assert {(r.ticker, r.status) for r in out} == {("a", "on_time"), ("b", "late"), ("c", "missing")}

    bad, folder = {}, str(tmp_path / "table")
    handle = K.ingest_batch({"positive": F.col("v") > 0}, ["ticker"], ["turn"], K.write_changes(folder), lambda d, n: bad.__setitem__(n, d.collect()))
    schema = "ticker string, turn long, v double"
    source = tmp_path / "in"
    source.mkdir()
    batches = [[("a", 2, 1.0), ("a", 1, 2.0), ("b", 1, -1.0), ("d", 1, 5.0)], [("c", 1, None), ("d", 2, 6.0)]]
    for rows in batches:
        spark.createDataFrame(rows, schema).coalesce(1).write.mode("append").json(str(source))
        spark.readStream.schema(schema).json(str(source)).writeStream.foreachBatch(handle).option("checkpointLocation", str(tmp_path / "cp")).trigger(availableNow=True).start().awaitTermination()
    now = lambda: sorted((r.ticker, r.v) for r in K.current_rows(spark, folder, ["ticker"]).collect())
    # the last by turn, not by place in the file; a later batch replaces its keys
    assert now() == [("a", 1.0), ("d", 6.0)]
    assert [(r.ticker, r.issue_type) for n in sorted(bad) for r in bad[n]] == [("b", "positive"), ("c", "positive")]
    handle(spark.createDataFrame(batches[1], schema), 1)
    assert now() == [("a", 1.0), ("d", 6.0)]


def test_sessions_and_repeats(spark, tmp_path):
    (tmp_path / "s").mkdir()
    (tmp_path / "d").mkdir()
    schema = "entity string, at timestamp, event string"
    batches = [[("a", hours(0), "x"), ("a", hours(1), "y"), ("a", hours(1), "y")], [("a", hours(2), "z"), ("a", hours(1), "y")], [("a", hours(20), "w"), ("b", hours(20), "q")], [("b", hours(60), "end")], [("b", hours(90), "end2")]]
    out = fed(spark, tmp_path / "s", batches, schema, lambda s: K.stream_sessions(s, "entity", "at", "5 hours"), "append", None)
    assert {(r.entity, r.session_start, r.session_end, r.n_events) for r in out} >= {("a", hours(0), hours(7), 5), ("a", hours(20), hours(25), 1), ("b", hours(20), hours(25), 1)}
    kept = fed(spark, tmp_path / "d", batches, schema, lambda s: K.stream_distinct(s, ["entity", "event"], "at"), "append", None)
    assert sorted((r.entity, r.event) for r in kept) == [("a", "w"), ("a", "x"), ("a", "y"), ("a", "z"), ("b", "end"), ("b", "end2"), ("b", "q")]


def test_ledger_codes_in_one_batch(spark, tmp_path):
    """Every code, on a batch of many lines, against the plain chain."""

    def line(n, previous, body):
        return [n, previous, body, hashlib.sha256(f"{previous}|{body}".encode()).hexdigest()]

    chains = {}
    for name in ("fine", "missing_line", "broken_link", "hash_mismatch", "missing_field"):
        chain = [line(1, GENESIS, "x")]
        for n in range(2, 40):
            chain.append(line(n, chain[-1][3], f"x{n}"))
        chains[name] = chain
    del chains["missing_line"][20]
    chains["broken_link"][20] = line(21, "0" * 64, "x21")
    chains["hash_mismatch"][20][2] = "changed"
    chains["missing_field"][20][1] = None
    rows = [(name, *held) for name, chain in chains.items() for held in reversed(chain)]
    out = fed(spark, tmp_path, [rows[:1], rows[1:]], "ledger string, seq long, previous_hash string, body string, hash string", lambda s: K.stream_ledger_check(s, "ledger", "seq"), "update", ["ledger"])
    found = {k[0]: (r.first_bad_line, r.code) for k, r in out.items()}
    # the first line of `fine` to arrive is its last, alone in its batch
    assert found["fine"] == (39, "missing_line")
    assert {k: v for k, v in found.items() if k != "fine"} == {"missing_line": (22, "missing_line"), "broken_link": (21, "broken_link"), "hash_mismatch": (21, "hash_mismatch"), "missing_field": (21, "missing_field")}
