"""Where each cell of a panel comes from: candidate sources by priority, edges between derived cells, checks of both.

Cells are rows (entity, period, column, number, text); a cell's name is entity|period|column.
"""

from __future__ import annotations

from collections.abc import Mapping, Sequence
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from strataloom.functions.numbers import finite_or_null
from strataloom.session import cut_lineage

TOLERANCE = 1e-9
ANY_ENTITY = "*"
# Evidence levels, transforms and notes of a cell.
VERIFIED, CHAIN, ASSERTED, UNKNOWN = "cell_verified", "derived_chain", "column_asserted", "unknown"
NULL_KEPT, UNRESOLVED = "T_NULL_PRESERVED", "T_UNRESOLVED"


@dataclass(frozen=True)
class Candidate:
    """A source's field that may hold the column's value. `only_period`: asked for cells of that period only."""

    source: str
    field: str
    source_class: str
    transform: str
    only_period: int | None = None


@dataclass(frozen=True)
class ColumnSpec:
    """kind: `source` (candidates in order of priority), `chained` (derived from other cells) or `asserted` (no source by cell)."""

    column: str
    kind: str
    source_class: str
    transform: str = ""
    candidates: tuple[Candidate, ...] = ()
    numeric: bool = True


def long_cells(df: DataFrame, columns: Sequence[str], entity: str = "entity", period: str = "period", numeric: Sequence[str] | None = None) -> DataFrame:
    """(entity, period, column, number, text), one row a cell; empty text counts as null, non-finite numbers too."""
    numeric = columns if numeric is None else numeric
    cells = [
        F.struct(F.lit(c).alias("column"), (finite_or_null(c) if c in numeric else F.lit(None).cast("double")).alias("number"), F.nullif(F.col(c).cast("string"), F.lit("")).alias("text"))
        for c in columns
    ]
    return df.select(F.col(entity).cast("string").alias("entity"), F.col(period).alias("period"), F.explode(F.array(*cells)).alias("c")).select("entity", "period", "c.*")


def _source_fields(name: str, df: DataFrame, fields: Sequence[str]) -> DataFrame:
    entity = F.col("entity").cast("string") if "entity" in df.columns else F.lit(ANY_ENTITY)
    retrieved = F.col("retrieved_at").cast("string") if "retrieved_at" in df.columns else F.lit(None).cast("string")
    held = [F.struct(F.lit(f).alias("field"), F.col(f).cast("string").alias("found")) for f in fields]
    return df.select(F.lit(name).alias("source"), entity.alias("at"), F.col("period"), retrieved.alias("retrieved_at"), F.explode(F.array(*held)).alias("f")).select(
        "source", "at", "period", "retrieved_at", "f.*"
    )


def _outcome(has_row: Column) -> Column:
    """MATCH, MISMATCH, UNPARSEABLE or NO_ROW of one candidate."""
    number = finite_or_null(F.col("found").try_cast("double"))
    same = F.abs(F.col("number") - number) <= TOLERANCE * F.greatest(F.lit(1.0), F.abs(F.col("number")))
    numbers = F.when(number.isNull() | F.col("number").isNull(), "UNPARSEABLE").when(same, "MATCH").otherwise("MISMATCH")
    texts = F.when(F.col("text").isNull(), "UNPARSEABLE").when(F.col("text") == F.col("found"), "MATCH").otherwise("MISMATCH")
    blank = F.col("found").isNull() | (F.trim("found") == "")
    return F.when(~has_row, "NO_ROW").when(blank, "UNPARSEABLE").when(F.col("numeric"), numbers).otherwise(texts)


def cell_provenance(cells: DataFrame, specs: Sequence[ColumnSpec], sources: Mapping[str, DataFrame]) -> DataFrame:
    """(entity, period, column, value_state, evidence_level, source_class, source, field, source_period, retrieved_at, transform, note) per cell.

    A cell of a `source` column is verified by its first candidate, in order, whose row for the cell's entity and period (period
    alone where the source has no entity) holds the same value: equal text, or a number within 1e-9 of the cell's, relative
    above 1. Null cells keep their null and are never looked up. Sources are unique by entity and period. The specs are
    literals; cells and sources meet in one equi-join by (source, field, entity, period).
    """
    spark = cells.sparkSession
    kinds = [(s.column, s.kind, s.source_class, s.transform, s.numeric) for s in specs]
    wanted = [(s.column, i, c.source, c.field, c.source_class, c.transform, c.only_period, "entity" in sources[c.source].columns) for s in specs for i, c in enumerate(s.candidates)]
    kinds = spark.createDataFrame(kinds, "column string, kind string, nominal string, transform string, numeric boolean")
    wanted = spark.createDataFrame(wanted, "column string, priority int, source string, field string, source_class string, by string, only_period int, per_entity boolean")
    # as many rows as columns and candidates were written out by the caller
    rows = cells.join(F.broadcast(kinds), "column")
    asked = rows.where((F.col("kind") == "source") & F.col("text").isNotNull()).join(F.broadcast(wanted), "column")
    asked = asked.where(F.col("only_period").isNull() | (F.col("only_period") == F.col("period")))
    asked = asked.withColumn("at", F.when(F.col("per_entity"), F.col("entity")).otherwise(ANY_ENTITY))
    named = {}
    for s in specs:
        for c in s.candidates:
            named.setdefault(c.source, set()).add(c.field)
    hit = None
    for name, fields in named.items():
        part = _source_fields(name, sources[name], sorted(fields))
        hit = part if hit is None else hit.unionByName(part)
    keys = ["entity", "period", "column"]
    if hit is None:
        found = rows.limit(0).select(*keys).withColumns({"best": F.lit(None).cast("struct<source:string,field:string,source_class:string,by:string,retrieved_at:string>"), "matches": F.lit(0), "outcomes": F.array().cast("array<string>")})
    else:
        met = asked.join(hit.withColumn("__hit", F.lit(True)), ["source", "field", "at", "period"], "left").withColumn("outcome", _outcome(F.col("__hit").isNotNull()))
        best = F.min_by(F.struct("source", "field", "source_class", "by", "retrieved_at"), F.when(F.col("outcome") == "MATCH", F.col("priority")))
        found = met.groupBy(*keys).agg(
            F.when(F.count_if(F.col("outcome") == "MATCH") > 0, best).alias("best"), F.count_if(F.col("outcome") == "MATCH").alias("matches"), F.collect_set("outcome").alias("outcomes")
        )
    out = rows.join(found, keys, "left")
    null, chained, asserted, ok = F.col("text").isNull(), F.col("kind") == "chained", F.col("kind") == "asserted", F.col("best").isNotNull()
    pick = lambda *values: F.when(null, values[0]).when(asserted, values[1]).when(chained, values[2]).when(ok, values[3]).otherwise(values[4])
    unknown = (
        F.when(F.coalesce(F.size("outcomes"), F.lit(0)) < 1, "no_upstream_row")
        .when((F.size("outcomes") == 1) & F.array_contains("outcomes", "NO_ROW"), "no_upstream_row")
        .when(F.array_contains("outcomes", "UNPARSEABLE"), "value_unparseable")
        .otherwise("value_mismatch_all_candidates")
    )
    verified = lambda c: F.when(~null & (F.col("kind") == "source") & ok, F.col(f"best.{c}"))
    return out.select(
        *keys,
        F.when(null, "null").otherwise("present").alias("value_state"),
        pick(F.when(chained, CHAIN).otherwise(ASSERTED), F.lit(ASSERTED), F.lit(CHAIN), F.lit(VERIFIED), F.lit(UNKNOWN)).alias("evidence_level"),
        pick(F.col("nominal"), F.col("nominal"), F.lit("derived"), F.col("best.source_class"), F.lit(UNKNOWN)).alias("source_class"),
        verified("source").alias("source"),
        verified("field").alias("field"),
        F.when(verified("source").isNotNull(), F.col("period")).alias("source_period"),
        verified("retrieved_at").alias("retrieved_at"),
        pick(F.lit(NULL_KEPT), F.col("transform"), F.col("transform"), F.col("best.by"), F.lit(UNRESOLVED)).alias("transform"),
        pick(F.lit("null_preserved"), F.lit("column_asserted_no_cell_source"), F.lit("derived_from_dataset_cells"), F.when(F.col("matches") > 1, "multi_candidate_priority_applied").otherwise(""), unknown).alias("note"),
    )


@dataclass(frozen=True)
class Rule:
    """`column` is derived from `upstream` of the same entity at each of `offsets` from its period; no offsets: at every period up to it."""

    column: str
    upstream: str
    offsets: tuple[int, ...] = ()


def cell_name(entity: str = "entity", period: str = "period", column: str = "column") -> Column:
    return F.concat_ws("|", F.col(entity).cast("string"), F.col(period).cast("string"), F.col(column))


def lineage_edges(cells: DataFrame, rules: Sequence[Rule]) -> DataFrame:
    """(cell, upstream): every existing cell that a derived cell's rules name. Fixed offsets meet by key, histories by entity and column."""
    spark = cells.sparkSession
    held = cells.select("entity", "period", "column")
    up = held.select("entity", F.col("period").alias("up_period"), F.col("column").alias("up_column"))
    fixed = spark.createDataFrame([(r.column, r.upstream, o) for r in rules for o in r.offsets], "column string, up_column string, offset int")
    whole = spark.createDataFrame([(r.column, r.upstream) for r in rules if not r.offsets], "column string, up_column string")
    # as many rows as rules
    near = held.join(F.broadcast(fixed), "column").withColumn("up_period", F.col("period") + F.col("offset")).join(up, ["entity", "up_column", "up_period"])
    past = held.join(F.broadcast(whole), "column").join(up, ["entity", "up_column"]).where(F.col("up_period") <= F.col("period"))
    names = [cell_name().alias("cell"), cell_name("entity", "up_period", "up_column").alias("upstream")]
    return near.select(*names).unionByName(past.select(*names)).distinct()


def cyclic_edges(edges: DataFrame, rounds: int = 1000) -> DataFrame:
    """Edges that lie on a cycle or lead to one: those left when cells without an upstream are taken away until nothing changes.

    A round takes away one level of the graph; rounds are as many as the longest chain of derivations, and their state is checkpointed.
    """
    left, before = cut_lineage(edges.select("cell", "upstream")), None
    for _ in range(rounds):
        n = left.count()
        if n in (0, before):
            return left
        before = n
        left = cut_lineage(left.join(left.select(F.col("cell").alias("upstream")).distinct(), "upstream", "left_semi").select("cell", "upstream"))
    raise ValueError(f"derivations are longer than {rounds} levels")


def lineage_checks(cells: DataFrame, edges: DataFrame, rows: int | Column, columns: Sequence[str]) -> DataFrame:
    """(check, violations): record count, repeated names, cells a column is short of, self edges, upstream cells that are missing, cyclic edges."""
    spark = cells.sparkSession
    names = cells.select(cell_name().alias("cell"), "column")
    rows = F.lit(rows) if isinstance(rows, int) else rows
    per = spark.createDataFrame([(c,) for c in columns], "column string").join(names.groupBy("column").agg(F.count("*").alias("n")), "column", "left")
    missing = edges.join(names.select(F.col("cell").alias("upstream")), "upstream", "left_anti")
    parts = [
        ("record_count", names.agg(F.abs(F.count("*") - rows * len(columns)).alias("v"))),
        ("duplicate_cells", names.groupBy("cell").agg((F.count("*") - 1).alias("n")).agg(F.sum("n").alias("v"))),
        ("short_columns", per.agg(F.sum(F.abs(F.coalesce("n", F.lit(0)) - rows)).alias("v"))),
        ("self_edges", edges.agg(F.count_if(F.col("cell") == F.col("upstream")).alias("v"))),
        ("missing_upstream", missing.agg(F.count("*").alias("v"))),
        ("cyclic_edges", cyclic_edges(edges).agg(F.count("*").alias("v"))),
    ]
    out = None
    for name, df in parts:
        row = df.select(F.lit(name).alias("check"), F.coalesce("v", F.lit(0)).cast("long").alias("violations"))
        out = row if out is None else out.unionByName(row)
    return out


def provenance_counts(found: DataFrame) -> DataFrame:
    """(column, evidence_level, source_class, n) with subtotals: a null stands for all of them, from the right."""
    return found.rollup("column", "evidence_level", "source_class").agg(F.count("*").alias("n"))
