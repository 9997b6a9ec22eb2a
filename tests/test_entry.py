"""The registered queries against their SQL in DuckDB, where the driver's tables are at hand."""

import os

import duckdb
import pytest

import __spark_entry__ as entry

SF = "/root/testdata/sf0.001"
SLOW = ("sage", "louvain", "kway", "pipeline")
NAMES = sorted(n for n in entry.oracle_sql() if not n.startswith(SLOW))


def test_names():
    assert set(entry.oracle_sql()) <= set(entry.queries())


@pytest.mark.parametrize("name", NAMES)
def test_matches_sql(spark, name):
    con = duckdb.connect()
    for f in os.listdir(SF):
        con.execute(f"CREATE VIEW {f.split('.')[0]} AS SELECT * FROM '{SF}/{f}'")
    df = entry.queries()[name](spark, SF)
    found = con.execute(entry.oracle_sql()[name])
    columns = [d[0] for d in found.description]
    assert sorted(columns) == sorted(df.columns)
    cell = lambda x: str(round(x, 5)) if isinstance(x, float) else str(x)
    want = sorted(tuple(cell(r[columns.index(c)]) for c in sorted(columns)) for r in found.fetchall())
    assert sorted(tuple(cell(r[c]) for c in sorted(columns)) for r in df.collect()) == want


def test_entry(spark):
    assert entry.entry(spark).count() > 0
