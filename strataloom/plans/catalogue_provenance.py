"""Queries: provenance and lineage of the cells of a supplier-year panel."""

from pyspark.sql import functions as F

from strataloom.operators import provenance as V
from strataloom.plans import panels as P
from strataloom.plans.registry import query

COLUMNS = ["revenue", "quantity", "returned", "discount", "growth", "peak"]
SPECS = [
    V.ColumnSpec("revenue", "source", "vendor", candidates=(V.Candidate("reported", "revenue", "vendor", "T_COPY"), V.Candidate("archive", "revenue", "archive", "T_RESTORE"))),
    V.ColumnSpec("quantity", "source", "vendor", candidates=(V.Candidate("archive", "quantity", "archive", "T_RESTORE", 1995), V.Candidate("market", "quantity", "market", "T_TOTAL"))),
    V.ColumnSpec("returned", "source", "vendor", candidates=(V.Candidate("reported", "returned", "vendor", "T_COPY"),)),
    V.ColumnSpec("discount", "asserted", "manual", "T_ASSERT"),
    V.ColumnSpec("growth", "chained", "derived", "T_GROWTH"),
    V.ColumnSpec("peak", "chained", "derived", "T_PEAK"),
]
RULES = [V.Rule("growth", "revenue", (-1, 0)), V.Rule("peak", "revenue"), V.Rule("returned", "quantity", (0,))]

_PANEL = f"""{P.YEARS}, panel AS (SELECT a.entity, a.period, a.revenue, a.quantity, a.returned, a.discount, round(a.revenue / b.revenue - 1, 6) AS growth, max(a.revenue) OVER (PARTITION BY a.entity ORDER BY a.period) AS peak
 FROM years a LEFT JOIN years b ON b.entity = a.entity AND b.period = a.period - 1),
reported AS (SELECT entity, period, revenue * 1.0000000000001 + CASE WHEN entity % 5 = 0 THEN 1 ELSE 0 END AS revenue, CASE WHEN entity % 4 = 1 THEN returned ELSE returned + 0.5 END AS returned FROM years WHERE entity % 3 <> 0),
archive AS (SELECT entity, period, revenue, quantity FROM years WHERE period <= 1995),
market AS (SELECT period, max(quantity) AS quantity FROM years GROUP BY 1),
cells AS ({" UNION ALL ".join(f"SELECT entity::VARCHAR AS entity, period, '{c}' AS col, {c}::DOUBLE AS x FROM panel" for c in COLUMNS)})"""


def _panel(spark, sf):
    years = P.supplier_year(spark, sf)
    before = years.select("entity", (F.col("period") + 1).alias("period"), F.col("revenue").alias("__before"))
    peak = years.select("entity", "period", "revenue").alias("a").join(years.select(F.col("entity"), F.col("period").alias("p"), F.col("revenue").alias("r")).alias("b"), "entity").where("p <= period")
    peak = peak.groupBy("entity", "period").agg(F.max("r").alias("peak"))
    return years.join(before, ["entity", "period"], "left").withColumn("growth", F.round(F.col("revenue") / F.col("__before") - 1, 6)).join(peak, ["entity", "period"])


def _sources(spark, sf):
    years = P.supplier_year(spark, sf)
    return {
        "reported": years.where("entity % 3 <> 0").select(
            "entity", "period",
            (F.col("revenue") * 1.0000000000001 + F.when(F.col("entity") % 5 == 0, 1).otherwise(0)).alias("revenue"),
            F.when(F.col("entity") % 4 == 1, F.col("returned")).otherwise(F.col("returned") + 0.5).alias("returned"),
        ),
        "archive": years.where("period <= 1995").select("entity", "period", "revenue", "quantity"),
        "market": years.groupBy("period").agg(F.max("quantity").alias("quantity")),
    }


def _cells(spark, sf):
    return V.long_cells(_panel(spark, sf), COLUMNS)


_SAME = "abs(x - {0}) <= 1e-9 * greatest(1.0, abs(x))"
_FOUND = f"""{_PANEL}, m AS (SELECT c.entity, c.period, col, x, CASE col WHEN 'revenue' THEN
  CASE WHEN {_SAME.format('r.revenue')} THEN 'reported' WHEN {_SAME.format('a.revenue')} THEN 'archive' END
  WHEN 'quantity' THEN CASE WHEN c.period = 1995 AND {_SAME.format('a.quantity')} THEN 'archive' WHEN {_SAME.format('k.quantity')} THEN 'market' END
  WHEN 'returned' THEN CASE WHEN {_SAME.format('r.returned')} THEN 'reported' END END AS source,
 CASE col WHEN 'revenue' THEN coalesce(({_SAME.format('r.revenue')})::INT, 0) + coalesce(({_SAME.format('a.revenue')})::INT, 0)
  WHEN 'quantity' THEN coalesce((c.period = 1995 AND {_SAME.format('a.quantity')})::INT, 0) + coalesce(({_SAME.format('k.quantity')})::INT, 0) ELSE 1 END AS matches,
 CASE col WHEN 'revenue' THEN r.entity IS NULL AND a.entity IS NULL WHEN 'quantity' THEN false ELSE r.entity IS NULL END AS no_row,
 col = 'returned' AND r.entity IS NOT NULL AND r.returned IS NULL AS blank
 FROM cells c LEFT JOIN reported r ON r.entity::VARCHAR = c.entity AND r.period = c.period LEFT JOIN archive a ON a.entity::VARCHAR = c.entity AND a.period = c.period LEFT JOIN market k ON k.period = c.period),
f AS (SELECT entity, period, col AS "column", CASE WHEN x IS NULL THEN 'null' ELSE 'present' END AS value_state,
 CASE WHEN col IN ('growth', 'peak') THEN 'derived_chain' WHEN x IS NULL OR col = 'discount' THEN 'column_asserted' WHEN source IS NOT NULL THEN 'cell_verified' ELSE 'unknown' END AS evidence_level,
 CASE WHEN col IN ('growth', 'peak') THEN 'derived' WHEN col = 'discount' THEN 'manual' WHEN x IS NULL THEN 'vendor' WHEN source = 'reported' THEN 'vendor' ELSE coalesce(source, 'unknown') END AS source_class,
 CASE WHEN x IS NOT NULL THEN source END AS source,
 CASE WHEN x IS NULL THEN 'null_preserved' WHEN col = 'discount' THEN 'column_asserted_no_cell_source' WHEN col IN ('growth', 'peak') THEN 'derived_from_dataset_cells'
  WHEN source IS NOT NULL THEN CASE WHEN matches > 1 THEN 'multi_candidate_priority_applied' ELSE '' END WHEN no_row THEN 'no_upstream_row' WHEN blank THEN 'value_unparseable' ELSE 'value_mismatch_all_candidates' END AS note FROM m)"""


@query("cell_provenance", f'WITH {_FOUND} SELECT entity, period, "column", value_state, evidence_level, source_class, source, note FROM f')
def _(spark, sf):
    out = V.cell_provenance(_cells(spark, sf), SPECS, _sources(spark, sf))
    return out.select("entity", "period", "column", "value_state", "evidence_level", "source_class", "source", "note")


@query(
    "provenance_counts",
    f'WITH {_FOUND} SELECT "column", evidence_level, source_class, count(*) AS n FROM f GROUP BY ROLLUP ("column", evidence_level, source_class)',
)
def _(spark, sf):
    return V.provenance_counts(V.cell_provenance(_cells(spark, sf), SPECS, _sources(spark, sf)))


_EDGES = f"""{_PANEL}, rules AS (SELECT * FROM (VALUES ('growth', 'revenue', -1, 0), ('peak', 'revenue', -100000, 0), ('returned', 'quantity', 0, 0)) t(col, up, low, high)),
e AS (SELECT concat_ws('|', c.entity, c.period, c.col) AS cell, concat_ws('|', u.entity, u.period, u.col) AS upstream FROM cells c JOIN rules USING (col) JOIN cells u ON u.entity = c.entity AND u.col = up AND u.period BETWEEN c.period + low AND c.period + high)"""


@query("lineage_edges", f"WITH {_EDGES} SELECT cell, upstream FROM e")
def _(spark, sf):
    return V.lineage_edges(_cells(spark, sf), RULES)


@query(
    "lineage_checks",
    f"""WITH RECURSIVE {_EDGES}, reach AS (SELECT cell, upstream FROM e UNION SELECT r.cell, e.upstream FROM reach r JOIN e ON e.cell = r.upstream), names AS (SELECT concat_ws('|', entity, period, col) AS cell, col FROM cells)
SELECT 'record_count' AS "check", abs((SELECT count(*) FROM names) - 6 * (SELECT count(*) FROM panel)) AS violations UNION ALL SELECT 'duplicate_cells', (SELECT count(*) - count(DISTINCT cell) FROM names)
UNION ALL SELECT 'short_columns', (SELECT sum(abs(n - (SELECT count(*) FROM panel)))::BIGINT FROM (SELECT count(*) AS n FROM names GROUP BY col)) UNION ALL SELECT 'self_edges', (SELECT count(*) FROM e WHERE cell = upstream)
UNION ALL SELECT 'missing_upstream', (SELECT count(*) FROM e ANTI JOIN names ON names.cell = e.upstream) UNION ALL SELECT 'cyclic_edges', (SELECT count(*) FROM reach WHERE cell = upstream)""",
)
def _(spark, sf):
    cells = _cells(spark, sf)
    return V.lineage_checks(cells, V.lineage_edges(cells, RULES), _panel(spark, sf).count(), COLUMNS)
