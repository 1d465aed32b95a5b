"""The registered queries: names, and results against SQL on the smallest tables."""

import glob
import os

import __spark_entry__ as entry
import duckdb
import pytest

QUERIES, ORACLES = entry.catalog.QUERIES, entry.catalog.ORACLES


def test_names():
    assert set(ORACLES) <= set(QUERIES)
    assert set(entry.oracle_sql()) <= set(entry.queries())


def test_entry(spark):
    assert entry.entry(spark).count() > 0


def plain(value):
    if value is None or value != value:
        return None
    if isinstance(value, float):
        return float(f"{value:.9g}")
    return [plain(x) for x in value] if isinstance(value, (list, tuple)) else value


@pytest.fixture(scope="module")
def con(data):
    c = duckdb.connect()
    for f in glob.glob(f"{data}/*.parquet"):
        c.execute(f"CREATE VIEW {os.path.basename(f)[:-8]} AS SELECT * FROM read_parquet('{f}')")
    return c


@pytest.mark.parametrize("name", sorted(ORACLES))
def test_against_sql(spark, data, con, name):
    df = QUERIES[name](spark, data)
    rows = con.execute(ORACLES[name])
    columns = [d[0] for d in rows.description]
    assert sorted(df.columns) == sorted(columns)
    ours = sorted(([plain(r[c]) for c in sorted(columns)] for r in df.collect()), key=repr)
    theirs = sorted(([plain(r[columns.index(c)]) for c in sorted(columns)] for r in rows.fetchall()), key=repr)
    assert ours == theirs
