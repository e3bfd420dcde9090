"""Structured Streaming forms of ingest, guard, counts, ledger check and freshness.

Every function takes and returns streaming frames (the batch ones work as well) and keeps bounded state: keys
within the watermark, or one row an entity or a ledger. The checkpoint of a query belongs to the shared folder.
"""

from __future__ import annotations

from collections.abc import Callable, Mapping, Sequence

import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

from strataloom.operators.quality import GENESIS, ledger_hash
from strataloom.sources.ingest import split_valid


def ingest_batch(
    rules: Mapping[str, Column],
    keys: Sequence[str],
    order: Sequence[str],
    write_good: Callable[[DataFrame, int], None],
    write_issues: Callable[[DataFrame, int], None],
) -> Callable[[DataFrame, int], None]:
    """For ``foreachBatch``: valid rows, the last of each key by the columns `order`, to one writer and issues to the other.

    Equal orders are told apart by the row's values, so a batch given twice after a failure has the same last rows. The writers get
    the batch number; one that replaces what it wrote under the same number, as `write_changes` does, makes the result exact.
    """

    def handle(batch: DataFrame, number: int) -> None:
        good, issues = split_valid(batch, rules)
        write_good(last_rows(good, keys, order), number)
        write_issues(issues, number)

    return handle


def last_rows(rows: DataFrame, keys: Sequence[str], order: Sequence[str]) -> DataFrame:
    """The last row of each key by `order`, then by all its values."""
    whole = F.struct(*[F.col(c) for c in rows.columns])
    return rows.groupBy(*keys).agg(F.max(F.struct(*[F.col(c).alias(f"o{i}") for i, c in enumerate(order)], whole.alias("r"))).alias("m")).select("m.r.*")


BATCH = "batch_number"


def write_changes(folder: str) -> Callable[[DataFrame, int], None]:
    """A writer that puts a micro-batch's rows under its number, replacing what stood there: a repeated batch changes nothing."""

    def write(rows: DataFrame, number: int) -> None:
        rows.write.mode("overwrite").parquet(f"{folder.rstrip('/')}/{BATCH}={number}")

    return write


def current_rows(spark: SparkSession, folder: str, keys: Sequence[str]) -> DataFrame:
    """The table that the written changes make: of each key the row of its latest batch."""
    changes = spark.read.option("basePath", folder).parquet(folder)
    own = [c for c in changes.columns if c != BATCH]
    return changes.groupBy(*keys).agg(F.max_by(F.struct(*own), BATCH).alias("r")).select("r.*")


def stream_distinct(events: DataFrame, keys: Sequence[str], time: str, lateness: str = "1 hour") -> DataFrame:
    """Events without repeats of a key within the watermark; state is the keys of that span."""
    return events.withWatermark(time, lateness).dropDuplicatesWithinWatermark(list(keys))


def stream_sessions(events: DataFrame, entity: str, time: str, gap: str, lateness: str = "1 hour") -> DataFrame:
    """(entity, session_start, session_end, n_events) of each run of an entity's events less than `gap` apart; for append mode."""
    held = events.withWatermark(time, lateness).groupBy(F.session_window(time, gap).alias("s"), entity).agg(F.count(F.lit(1)).alias("n_events"))
    return held.select(entity, F.col("s.start").alias("session_start"), F.col("s.end").alias("session_end"), "n_events")


def stream_pit_guard(values: DataFrame, predictions: DataFrame, key: str, available: str, time: str, delay: str = "1 hour", reach: str = "30 days") -> DataFrame:
    """Each prediction (key, time) with its values of the last ``reach``: on_time, late, or missing where none came.

    Values published up to ``delay`` after the prediction are seen and called late. Both sides have watermarks, so
    the state of either is bounded by the reach.
    """
    v = values.withWatermark(available, delay).select(F.col(key).alias("__key"), available, *[c for c in values.columns if c not in (key, available)])
    p = predictions.withWatermark(time, delay)
    near = F.expr(f"{key} = __key AND {available} >= {time} - INTERVAL {reach} AND {available} <= {time} + INTERVAL {delay}")
    status = F.when(F.col(available).isNull(), "missing").when(F.col(available) > F.col(time), "late").otherwise("on_time")
    return p.join(v, near, "leftOuter").drop("__key").withColumn("status", status)


def stream_verdict_counts(events: DataFrame, entity: str, time: str, verdict: str, verdicts: Sequence[str], width: str, slide: str | None = None, lateness: str = "1 hour") -> DataFrame:
    """Counts of each verdict per entity and event-time window, tumbling or sliding; rows behind the watermark are dropped."""
    window = F.window(time, width, slide) if slide else F.window(time, width)
    counts = [F.count_if(F.col(verdict) == v).alias(f"n_{v}") for v in verdicts]
    out = events.withWatermark(time, lateness).groupBy(window.alias("w"), entity).agg(*counts)
    return out.select(entity, F.col("w.start").alias("window_start"), F.col("w.end").alias("window_end"), *[f"n_{v}" for v in verdicts])


def stream_latest_period(rows: DataFrame, entity: str, period: str, time: str | None = None) -> DataFrame:
    """Latest period of each entity, kept current; run in update mode. State is one row an entity."""
    extra = [F.max(time).alias("last_seen")] if time else []
    return rows.groupBy(entity).agg(F.max(period).alias("latest"), F.count(F.lit(1)).alias("n_rows"), *extra)


LEDGER_OUT = "ledger string, n_lines long, first_bad_line long, code string"
LEDGER_STATE = "n_lines long, last_seq long, last_hash string, first_bad_line long, code string"


def stream_ledger_check(lines: DataFrame, ledger: str, seq: str) -> DataFrame:
    """The chain of each ledger as its lines arrive in order: lines so far, first failing line and its code.

    State is the last line number and hash of a ledger. Lines of one micro-batch are ordered by number; one that
    comes after a later line of an earlier batch fails as ``missing_line``. A chain is sequential, so a ledger's micro-batch is
    in one task; it is checked by columns, and the source's limit of a micro-batch bounds it.
    """
    named = lines.select(F.col(ledger).cast("string").alias("ledger"), F.col(seq).cast("long").alias("seq"), "previous_hash", "hash", ledger_hash(F.col("previous_hash"), F.col("body")).alias("own"))

    def check(key, frames, state: GroupState):
        n, last, last_hash, first, code = state.get if state.exists else (0, 0, GENESIS, None, None)
        rows = pd.concat(list(frames)).sort_values("seq", kind="stable", na_position="first").reset_index(drop=True)
        numbered = rows[rows["seq"].notna()]
        # what stood last before each line: the numbered line before it, or what the state says
        before = numbered["seq"].shift(1, fill_value=last).reindex(rows.index)
        link = numbered["hash"].shift(1, fill_value=last_hash).reindex(rows.index)
        missing = rows["seq"].isna() | rows["previous_hash"].isna() | rows["hash"].isna()
        codes = pd.Series(None, index=rows.index, dtype=object)
        for wrong, bad in (("hash_mismatch", rows["hash"] != rows["own"]), ("broken_link", rows["previous_hash"] != link), ("missing_line", rows["seq"] != before + 1), ("missing_field", missing)):
            codes[bad] = wrong
        if code is None and codes.notna().any():
            at = codes.first_valid_index()
            number = rows["seq"][at]
            first, code = (0 if pd.isna(number) else int(number)), codes[at]
        if len(numbered):
            last, last_hash = int(numbered["seq"].iloc[-1]), numbered["hash"].iloc[-1]
        n += len(rows)
        state.update((n, last, last_hash, first, code))
        yield pd.DataFrame({"ledger": [key[0]], "n_lines": [n], "first_bad_line": pd.array([first], "Int64"), "code": [code]})

    return named.groupBy("ledger").applyInPandasWithState(check, LEDGER_OUT, LEDGER_STATE, "update", GroupStateTimeout.NoTimeout)
