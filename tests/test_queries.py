"""Every query that has SQL gives the same rows as DuckDB, whatever the partitioning."""

import math
import os

import duckdb
import pytest

import __spark_entry__ as entry

CORE = {k: q for m in entry.MODULES for k, q in __import__("importlib").import_module(m).QUERIES.items()}
SQL = {k: q for m in entry.MODULES for k, q in __import__("importlib").import_module(m).SQL.items()}


def norm(value):
    if isinstance(value, float):
        return "nan" if math.isnan(value) else float(f"{value:.8g}")
    return value


@pytest.fixture(scope="module")
def db(data):
    c = duckdb.connect()
    for f in os.listdir(data):
        c.execute(f"CREATE VIEW {f[:-8]} AS SELECT * FROM '{data}/{f}'")
    return c


@pytest.mark.parametrize("name", sorted(SQL))
def test_same_rows_as_sql(spark, data, db, name):
    df = CORE[name](spark, data)
    columns = sorted(df.columns)
    got = sorted(([norm(r[c]) for c in columns] for r in df.collect()), key=str)
    result = db.execute(SQL[name])
    names = [d[0] for d in result.description]
    assert sorted(names) == columns
    want = sorted(([norm(r[names.index(c)]) for c in columns] for r in result.fetchall()), key=str)
    assert got == want


@pytest.mark.parametrize("name", sorted(set(CORE) - set(SQL)))
def test_others_run(spark, data, name):
    assert CORE[name](spark, data).count() > 0


def test_entry(spark):
    assert entry.entry(spark).columns == ["kept_seq", "dup_seq"]
