"""The driver's contract on the smallest tables: every query runs, and equals its SQL."""

from __future__ import annotations

import glob
import os

import duckdb
import pytest

import __spark_entry__ as entry
from tidemark.plans.queries import queries as log_queries

SF = "/root/testdata/sf0.001"


@pytest.fixture(scope="module")
def db():
    con = duckdb.connect()
    for p in glob.glob(f"{SF}/*.parquet"):
        con.sql(f"CREATE VIEW {os.path.basename(p)[:-8]} AS SELECT * FROM '{p}'")
    return con


def canonical(rows, columns):
    order = sorted(range(len(columns)), key=lambda i: columns[i])
    return sorted(repr([rows_i if not isinstance(rows_i, float) else round(rows_i, 9) for rows_i in (r[i] for i in order)]) for r in rows)


@pytest.mark.parametrize("name", sorted(log_queries()))
def test_query(spark, db, name):
    df = entry.queries()[name](spark, SF)
    rows = [tuple(r) for r in df.collect()]
    sql = entry.oracle_sql().get(name)
    if sql is None:
        assert rows
        return
    want = db.sql(sql)
    assert sorted(df.columns) == sorted(want.columns)
    if df.columns and any(t == "timestamp" for _, t in df.dtypes):
        rows = [tuple(v.replace(tzinfo=None) if hasattr(v, "tzinfo") else v for v in r) for r in rows]
    assert canonical(rows, df.columns) == canonical(want.fetchall(), want.columns)


def test_flagship(spark):
    assert entry.entry(spark).count() == 12


def test_oracles_name_queries():
    assert set(entry.oracle_sql()) <= set(entry.queries())
