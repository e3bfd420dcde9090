import importlib
import math
import os
import sys

import duckdb
import pytest

import __spark_entry__ as entry

SF = "/root/testdata/sf0.001"
SAMPLE = ["pooled_ic", "cost_scenarios", "panel_balance", "next_period_label", "label_distribution", "year_end_quote", "assign_regime", "table_checks", "validate_outcomes", "score_period"]


def canon(rows, names):
    order = sorted(range(len(names)), key=lambda i: names[i])
    shown = lambda v: "~" if v is None or isinstance(v, float) and math.isnan(v) else repr(round(v, 6) + 0.0) if isinstance(v, float) else str(v)
    return sorted(tuple(shown(r[i]) for i in order) for r in rows)


@pytest.mark.skipif(not os.path.isdir(SF), reason="needs the driver's tables")
@pytest.mark.parametrize("name", SAMPLE)
def test_query_gives_the_rows_of_its_sql(spark, name):
    con = duckdb.connect()
    for file in os.listdir(SF):
        con.execute(f"CREATE VIEW {file.split('.')[0]} AS SELECT * FROM '{SF}/{file}'")
    cursor = con.execute(entry.oracle_sql()[name])
    names = [d[0] for d in cursor.description]
    df = entry.queries()[name](spark, SF)
    assert sorted(df.columns) == sorted(names)
    assert canon(df.collect(), df.columns) == canon(cursor.fetchall(), names)


def test_every_sql_belongs_to_a_query():
    assert set(entry.oracle_sql()) <= set(entry.queries())


def test_entry_stands_without_the_training_data_folder(monkeypatch):
    whole = set(entry.queries())
    for name in [m for m in sys.modules if m == "corpus_pipeline" or m.startswith("strataloom.llm")]:
        monkeypatch.delitem(sys.modules, name)
    monkeypatch.setitem(sys.modules, "strataloom.llm.queries", None)
    rest = set(importlib.reload(entry).queries())
    assert "pooled_ic" in rest and rest <= whole
    assert not any(name.startswith("op") and name[2].isdigit() or name == "pipeline" for name in rest)
