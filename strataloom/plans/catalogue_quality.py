"""Queries: column quality, dataset profiles, frozen rankings, manifests, ledgers and outcome checks."""

from pyspark.sql import functions as F

from strataloom.operators import quality as Q
from strataloom.operators.ranking import ordinal
from strataloom.plans import panels as P
from strataloom.plans.registry import query, rounded, table

COLS = ["revenue", "returned", "flat", "gone"]


def _panel(spark, sf):
    """Yearly panel with a column that moves, one with gaps, one frozen within entities and one that is empty."""
    y = P.supplier_year(spark, sf)
    return y.select("entity", "period", "revenue", "returned", (F.col("entity") % 10).cast("double").alias("flat"), F.lit(None).cast("double").alias("gone"))


_PANEL = f"""{P.YEARS}, q AS (SELECT entity, period, revenue, returned, CAST(entity % 10 AS DOUBLE) AS flat, CAST(NULL AS DOUBLE) AS gone FROM years)"""
_LONG = f"{_PANEL}, lg AS (" + " UNION ALL ".join(f"SELECT entity, period, '{c}' AS feature, {c} AS value FROM q" for c in COLS) + ")"
_VAR = f"""{_LONG}, ev AS (SELECT feature, entity, count(value) AS n_values, count(DISTINCT value) AS n_distinct, bool_or(value IS NULL) AS has_null FROM lg GROUP BY 1, 2)"""


@query(
    "column_variability",
    f"""WITH {_VAR}, m AS (SELECT feature, n_distinct + CAST(has_null AS INTEGER) > 1 AS moving FROM ev)
SELECT feature, count(*) AS n_entities, count(*) FILTER (WHERE moving) AS n_varying, bool_or(moving) AS any_entity_varies, count(*) FILTER (WHERE moving) / count(*) >= 0.5 AS varies FROM m GROUP BY 1""",
)
def _(spark, sf):
    return Q.column_variability(_panel(spark, sf), "entity", COLS)


@query(
    "sparse_column_status",
    f"""WITH {_VAR}, s AS (SELECT feature, CAST(sum(n_values) AS BIGINT) AS n_values, count(*) FILTER (WHERE n_values >= 2) AS n_multi, count(*) FILTER (WHERE n_values >= 2 AND n_distinct > 1) AS n_moving FROM ev GROUP BY 1)
SELECT *, CASE WHEN n_values = 0 THEN 'all_null' WHEN n_values < 2 OR n_multi = 0 THEN 'insufficient_history' WHEN n_moving / n_multi >= 0.5 THEN 'varying' ELSE 'frozen_across_years' END AS status FROM s""",
)
def _(spark, sf):
    return Q.column_status(_panel(spark, sf), "entity", COLS)


_FROZEN = "fe AS (SELECT feature, count(*) AS n_entities, count(*) FILTER (WHERE n_distinct <= 1) AS frozen_entities FROM ev GROUP BY 1), sv AS (SELECT feature, min(value) AS sample_value, count(value) AS n_values FROM lg GROUP BY 1)"


@query(
    "frozen_evidence",
    f"WITH {_VAR}, {_FROZEN} SELECT feature, n_entities, frozen_entities, sample_value, round(frozen_entities / n_entities, 6) AS frozen_share FROM fe JOIN sv USING (feature)",
)
def _(spark, sf):
    return rounded(Q.frozen_evidence(_panel(spark, sf), "entity", COLS))


@query(
    "source_acceptance",
    f"""WITH {_VAR}, {_FROZEN}, d AS (SELECT unnest(['revenue', 'returned', 'flat', 'gone', 'never', 'target']) AS feature),
r AS (SELECT feature, CASE WHEN feature = 'target' THEN 'leakage_field' WHEN n_values IS NULL THEN 'absent' WHEN n_values = 0 THEN 'all_null' WHEN frozen_entities / n_entities >= 0.5 THEN 'frozen_snapshot' END AS reason, coalesce(n_values, 0) AS n_values
 FROM d LEFT JOIN fe USING (feature) LEFT JOIN sv USING (feature))
SELECT feature, CASE WHEN reason IS NULL THEN 'accepted' ELSE 'rejected' END AS status, reason, n_values FROM r""",
)
def _(spark, sf):
    return Q.source_acceptance(_panel(spark, sf), "entity", COLS, [*COLS, "never", "target"], ["target"])


@query(
    "missingness",
    f"WITH {_LONG} SELECT feature, count(*) - count(value) AS n_missing, round((count(*) - count(value)) / count(*), 6) AS missing_rate FROM lg GROUP BY 1",
)
def _(spark, sf):
    return rounded(Q.missingness(_panel(spark, sf), COLS))


@query(
    "quality_report",
    f"""WITH {P.TARGETS} SELECT period, count(*) AS n_rows, count(target) AS n_targets, round(count(target) / count(*), 6) AS target_coverage,
 count(*) FILTER (WHERE abs(target / nullif(revenue, 0) - 1) > 3) + count(*) FILTER (WHERE abs(returned / nullif(revenue, 0)) > 0.9) AS extreme_growth FROM targets GROUP BY 1""",
)
def _(spark, sf):
    t = P.targets(spark, sf)
    growth = [(F.try_divide("target", "revenue") - 1) / 3, F.try_divide("returned", "revenue") / 0.9]
    return rounded(Q.quality_report(t, "entity", "period", "target", growth, 1.0))


def _profile_sql(name, source, columns):
    return f"""SELECT '{name}' AS table_name, {columns} AS n_columns, CAST(sum(c) AS BIGINT) AS n_rows, count(*) AS n_keys, count(*) FILTER (WHERE c > 1) AS duplicate_keys, CAST(min(p) AS BIGINT) AS first_period, CAST(max(p) AS BIGINT) AS last_period, CAST(sum(t) AS BIGINT) AS n_targets FROM ({source})"""


@query(
    "dataset_profile",
    _profile_sql("orders", "SELECT o_custkey AS e, year(o_orderdate) AS p, count(*) AS c, count(CASE WHEN o_totalprice > 100000 THEN 1 END) AS t FROM orders GROUP BY 1, 2", 4)
    + " UNION ALL "
    + _profile_sql("lines", "SELECT l_suppkey AS e, year(l_shipdate) AS p, count(*) AS c, count(CASE WHEN l_returnflag = 'R' THEN 1 END) AS t FROM lineitem GROUP BY 1, 2", 4),
)
def _(spark, sf):
    o, li = table(spark, sf, "orders"), table(spark, sf, "lineitem")
    o = o.select(F.col("o_custkey").alias("e"), F.year("o_orderdate").alias("p"), F.when(F.col("o_totalprice") > 100000, 1).alias("t"), "o_orderkey")
    li = li.select(F.col("l_suppkey").alias("e"), F.year("l_shipdate").alias("p"), F.when(F.col("l_returnflag") == "R", 1).alias("t"), "l_orderkey")
    return Q.profile({"orders": (o, "e", "p", "t"), "lines": (li, "e", "p", "t")})


@query(
    "feature_passports",
    f"""WITH {_LONG}, r AS (SELECT * FROM (VALUES ('revenue', 'statement', 'accepted', 'none'), ('returned', 'event', 'accepted', 'rank'), ('gone', 'vendor', 'rejected', 'log')) t(feature, source_class, acceptance_status, transformation)),
m AS (SELECT feature, count(value) / count(*) AS coverage FROM lg GROUP BY 1) SELECT r.*, round(coverage, 6) AS coverage FROM r JOIN m USING (feature)""",
)
def _(spark, sf):
    registry = [("revenue", "statement", "accepted", "none"), ("returned", "event", "accepted", "rank"), ("gone", "vendor", "rejected", "log")]
    return rounded(Q.feature_passports(_panel(spark, sf), registry))


@query(
    "coverage_facts",
    f"""WITH {_VAR} SELECT (SELECT count(*) FROM q) AS n_rows, (SELECT count(returned) FROM q) AS n_targets, (SELECT count(revenue) + count(flat) + count(gone) FROM q) AS n_cells,
 (SELECT count(DISTINCT entity) FROM q) AS n_entities, (SELECT count(DISTINCT period) FROM q) AS n_periods,
 (SELECT count(*) FROM (SELECT feature FROM ev WHERE feature <> 'returned' GROUP BY 1 HAVING bool_or(n_distinct + CAST(has_null AS INTEGER) > 1))) AS n_varying""",
)
def _(spark, sf):
    return Q.coverage_facts(_panel(spark, sf), "entity", "period", "returned", ["revenue", "flat", "gone"])


@query(
    "benchmark_status",
    """SELECT CAST(p AS INTEGER) AS period, CASE WHEN y IS NULL THEN 'missing' ELSE 'present' END AS status FROM range(1990, 2006) t(p) LEFT JOIN (SELECT DISTINCT year(l_shipdate) AS y FROM lineitem) ON y = p""",
)
def _(spark, sf):
    years = table(spark, sf, "lineitem").select(F.year("l_shipdate").alias("period"))
    return Q.benchmark_status(years, "period", 1990, 2005)


@query(
    "dataset_confidence",
    f"""WITH {P.YEARS}, f AS (SELECT period, count(*) < 60 AS small_sample, sum(revenue) < 1e7 AS benchmark_missing, period % 2 = 0 AS no_accepted_features, period % 3 = 0 AS weak_backtest, count(returned) < count(*) AS frozen_columns FROM years GROUP BY 1),
s AS (SELECT *, round(greatest(0, least(1, 1.0::DOUBLE - CASE WHEN small_sample THEN 0.25::DOUBLE ELSE 0 END - CASE WHEN benchmark_missing THEN 0.15::DOUBLE ELSE 0 END - CASE WHEN no_accepted_features THEN 0.2::DOUBLE ELSE 0 END
 - CASE WHEN weak_backtest THEN 0.2::DOUBLE ELSE 0 END - CASE WHEN frozen_columns THEN 0.1::DOUBLE ELSE 0 END)), 3) AS confidence_score FROM f)
SELECT period, confidence_score, concat_ws(',', CASE WHEN small_sample THEN 'small_sample' END, CASE WHEN benchmark_missing THEN 'benchmark_missing' END, CASE WHEN no_accepted_features THEN 'no_accepted_features' END,
 CASE WHEN weak_backtest THEN 'weak_backtest' END, CASE WHEN frozen_columns THEN 'frozen_columns' END) AS confidence_reasons,
 CASE WHEN confidence_score >= 0.66 THEN 'high' WHEN confidence_score >= 0.33 THEN 'medium' ELSE 'low' END AS confidence_level FROM s""",
)
def _(spark, sf):
    n = F.count(F.lit(1))
    flags = P.supplier_year(spark, sf).groupBy("period").agg(
        (n < 60).alias("small_sample"), (F.sum("revenue") < 1e7).alias("benchmark_missing"), (F.count("returned") < n).alias("frozen_columns")
    )
    flags = flags.withColumns({"no_accepted_features": F.col("period") % 2 == 0, "weak_backtest": F.col("period") % 3 == 0})
    return Q.dataset_confidence(flags).select("period", "confidence_score", "confidence_reasons", "confidence_level")


@query(
    "table_checks",
    f"""WITH {P.YEARS}, k AS (SELECT DISTINCT entity, period FROM years), s AS (SELECT DISTINCT period FROM years)
SELECT 'unexpected_period' AS check_name, count(*) AS n_violations FROM s WHERE period NOT BETWEEN 1996 AND 2003
UNION ALL SELECT 'missing_period', 8 - count(*) FROM s WHERE period BETWEEN 1996 AND 2003
UNION ALL SELECT 'no_prior_period', count(*) FROM k WHERE period > 1996 AND NOT EXISTS (SELECT 1 FROM k p WHERE p.entity = k.entity AND p.period = k.period - 1)
UNION ALL SELECT 'bounds_discount', count(*) FILTER (WHERE discount NOT BETWEEN 0.04 AND 0.06) FROM years UNION ALL SELECT 'bounds_tax', count(*) FILTER (WHERE tax NOT BETWEEN 0 AND 1) FROM years""",
)
def _(spark, sf):
    y = P.supplier_year(spark, sf)
    return Q.table_checks(y, "entity", "period", list(range(1996, 2004)), {"discount": (0.04, 0.06), "tax": (0.0, 1.0)})


@query(
    "bounds_outliers",
    f"""WITH {P.YEARS}, b AS (SELECT * FROM (VALUES ('discount', 0.045::DOUBLE, 0.055::DOUBLE), ('tax', 0.03::DOUBLE, 0.05::DOUBLE)) t(feature, lo, hi)),
l AS (SELECT entity, period, 'discount' AS feature, discount AS value FROM years UNION ALL SELECT entity, period, 'tax', tax FROM years)
SELECT entity, period, feature, round(value, 6) AS value, 'outlier' AS issue_type, 'warning' AS severity FROM l JOIN b USING (feature) WHERE value < lo OR value > hi""",
)
def _(spark, sf):
    y = P.supplier_year(spark, sf)
    bounds = y.groupBy().agg(F.count(F.lit(1)).alias("n")).select(
        F.explode(F.array(*[F.struct(F.lit(f).alias("feature"), F.lit(lo).alias("lo"), F.lit(hi).alias("hi")) for f, lo, hi in (("discount", 0.045, 0.055), ("tax", 0.03, 0.05))])).alias("b")
    ).select("b.*")
    out = Q.bounds_outliers(Q.long_values(y, ["entity", "period"], ["discount", "tax"]), bounds)
    return rounded(out.select("entity", "period", "feature", "value", "issue_type", "severity"))


@query(
    "freeze_ranking",
    f"WITH {P.YEARS} SELECT period, count(*) AS n_rows, TRUE AS contiguous FROM years GROUP BY 1",
)
def _(spark, sf):
    y = ordinal(P.supplier_year(spark, sf), ["period"], "revenue", "entity", "rank")
    return Q.freeze(y, ["period"], ["entity", "rank"], "rank").select("period", "n_rows", "contiguous")


@query(
    "run_manifest_diff",
    """WITH a AS (SELECT s_suppkey AS path, md5(CAST(s_nationkey AS VARCHAR)) AS digest FROM supplier WHERE s_suppkey % 7 <> 0),
b AS (SELECT s_suppkey AS path, md5(CAST(CASE WHEN s_acctbal < 0 THEN s_nationkey + 1 ELSE s_nationkey END AS VARCHAR)) AS digest FROM supplier WHERE s_suppkey % 5 <> 0)
SELECT path, CASE WHEN b.digest IS NULL THEN 'missing' WHEN a.digest IS NULL THEN 'added' WHEN a.digest <> b.digest THEN 'changed' ELSE 'equal' END AS status FROM a FULL JOIN b USING (path)""",
)
def _(spark, sf):
    s = table(spark, sf, "supplier")
    digest = lambda c: F.md5(c.cast("string")).alias("digest")
    nation = F.col("s_nationkey")
    a = s.where("s_suppkey % 7 <> 0").select(F.col("s_suppkey").alias("path"), digest(nation))
    b = s.where("s_suppkey % 5 <> 0").select(F.col("s_suppkey").alias("path"), digest(F.when(F.col("s_acctbal") < 0, nation + 1).otherwise(nation)))
    return Q.manifest_diff(a, b)


@query(
    "validate_outcomes",
    """WITH o AS (SELECT l_orderkey AS entity, l_extendedprice AS start_price, l_extendedprice * (1 + l_discount) - CASE WHEN l_quantity > 45 THEN 1e6 ELSE 0 END AS end_price, CASE WHEN l_linenumber <> 3 THEN l_discount * 100 + CASE WHEN l_tax > 0.06 THEN 1 ELSE 0 END END AS return_pct,
 CASE WHEN l_linenumber <> 4 THEN l_returnflag ELSE ' ' END AS source, CAST(l_shipdate AS DATE) AS as_of FROM lineitem WHERE l_returnflag <> 'A'),
k AS (SELECT o_orderkey AS entity FROM orders WHERE o_orderpriority <> '5-LOW'), n AS (SELECT *, count(*) OVER (PARTITION BY entity) AS c, (end_price / start_price - 1) * 100 AS r FROM o)
SELECT CASE WHEN entity IS NULL THEN 'blank_entity' WHEN c > 1 THEN 'duplicate_entity' WHEN entity NOT IN (SELECT entity FROM k) THEN 'unknown_entity' WHEN return_pct IS NULL THEN 'non_numeric_return' WHEN source IS NULL OR trim(source) = '' THEN 'missing_provenance'
 WHEN NOT (as_of BETWEEN DATE '1995-06-01' AND DATE '2001-06-01') THEN 'date_outside_window' WHEN NOT (start_price > 0 AND end_price > 0) THEN 'non_positive_price' WHEN abs(return_pct - r) > 1e-6 * greatest(1, abs(r)) THEN 'return_mismatch' END AS code, count(*) AS n FROM n GROUP BY 1""",
)
def _(spark, sf):
    li = table(spark, sf, "lineitem").where("l_returnflag <> 'A'")
    o = li.select(
        F.col("l_orderkey").alias("entity"),
        F.col("l_extendedprice").alias("start_price"),
        (F.col("l_extendedprice") * (1 + F.col("l_discount")) - F.when(F.col("l_quantity") > 45, 1e6).otherwise(0.0)).alias("end_price"),
        F.when(F.col("l_linenumber") != 3, F.col("l_discount") * 100 + F.when(F.col("l_tax") > 0.06, 1).otherwise(0)).alias("return_pct"),
        F.when(F.col("l_linenumber") != 4, F.col("l_returnflag")).otherwise(" ").alias("source"),
        F.to_date("l_shipdate").alias("as_of"),
    )
    known = table(spark, sf, "orders").where("o_orderpriority <> '5-LOW'").select(F.col("o_orderkey").alias("entity"))
    out = Q.validate_outcomes(known, o, "entity", F.lit("1995-06-01").cast("date"), F.lit("2001-06-01").cast("date"))
    return out.groupBy("code").agg(F.count(F.lit(1)).alias("n"))


@query(
    "ledger_verify",
    """WITH RECURSIVE o AS (SELECT o_custkey AS ledger, row_number() OVER (PARTITION BY o_custkey ORDER BY o_orderkey) AS seq, o_orderkey, CAST(o_orderkey AS VARCHAR) AS body FROM orders),
c AS (SELECT ledger, seq, o_orderkey, body, repeat('0', 64) AS previous_hash, sha256(repeat('0', 64) || '|' || body) AS hash FROM o WHERE seq = 1
 UNION ALL SELECT o.ledger, o.seq, o.o_orderkey, o.body, c.hash, sha256(c.hash || '|' || o.body) FROM c JOIN o ON o.ledger = c.ledger AND o.seq = c.seq + 1),
t AS (SELECT ledger, seq, previous_hash, hash, CASE WHEN o_orderkey % 37 = 0 THEN body || 'x' ELSE body END AS body FROM c WHERE o_orderkey % 41 <> 0),
v AS (SELECT t.ledger, t.seq, CASE WHEN t.seq > 1 AND p.seq IS NULL THEN 'missing_line' WHEN t.hash <> sha256(t.previous_hash || '|' || t.body) THEN 'hash_mismatch' END AS code FROM t LEFT JOIN t p ON p.ledger = t.ledger AND p.seq = t.seq - 1)
SELECT ledger, count(*) AS n_lines, min(seq) FILTER (WHERE code IS NOT NULL) AS first_bad_line, arg_min(code, seq) FILTER (WHERE code IS NOT NULL) AS code FROM v GROUP BY 1""",
)
def _(spark, sf):
    """A chain of hashes over each customer's orders, some of them changed or taken out afterwards."""
    bodies = table(spark, sf, "orders").groupBy(F.col("o_custkey").alias("ledger")).agg(F.array_sort(F.collect_list("o_orderkey")).alias("keys"))
    line = lambda previous, key, n: F.struct(n.alias("seq"), key.alias("key"), previous.alias("previous_hash"), Q.ledger_hash(previous, key.cast("string")).alias("hash"))
    none = F.array().cast("array<struct<seq: bigint, key: bigint, previous_hash: string, hash: string>>")
    last = lambda lines: F.coalesce(F.get(lines, F.size(lines) - 1)["hash"], F.lit(Q.GENESIS))
    lines = bodies.select("ledger", F.explode(F.aggregate("keys", none, lambda held, k: F.concat(held, F.array(line(last(held), k, (F.size(held) + 1).cast("bigint")))))).alias("l"))
    body = F.concat(F.col("l.key").cast("string"), F.when(F.col("l.key") % 37 == 0, "x").otherwise(""))
    kept = lines.where("l.key % 41 <> 0").select("ledger", "l.seq", F.concat_ws("-", "ledger", F.col("l.key").cast("string")).alias("event_id"), "l.previous_hash", "l.hash", body.alias("body"))
    return Q.ledger_verify(kept, "ledger", "seq")
