"""Every query with an oracle, on the smallest tables; and the contract of the entry module."""

import math

import duckdb
import pandas as pd
import pytest

import __spark_entry__ as entry
from slotlog.carriers import TABLES

SF = "/root/testdata/sf0.001"
QUERIES, ORACLES = entry.queries(), entry.oracle_sql()
SLOW = {"validate_sources", "jaccard_table", "stream_outcome_files", "permutation_test_log_loss"}


@pytest.fixture(scope="module")
def duck():
    con = duckdb.connect()
    for t in TABLES:
        con.execute(f"create view {t} as select * from '{SF}/{t}.parquet'")
    return con


def cell(v):
    if v is None or v is pd.NaT or (isinstance(v, float) and math.isnan(v)):
        return "~"
    if isinstance(v, bool):
        return str(v)
    if hasattr(v, "isoformat"):
        return pd.Timestamp(v).isoformat()
    return f"{float(v) + 0.0:.6f}" if isinstance(v, (int, float)) else str(v)


def rows(names, data):
    order = sorted(range(len(names)), key=lambda i: names[i])
    return sorted(tuple(cell(r[i]) for i in order) for r in data)


def test_contract(spark):
    assert set(ORACLES) <= set(QUERIES) and len(QUERIES) > 149
    assert entry.entry(spark).count() > 0


@pytest.mark.parametrize("name", [n for n in ORACLES if n not in SLOW])
def test_query_matches_oracle(spark, duck, name):
    df = QUERIES[name](spark, SF)
    cur = duck.execute(ORACLES[name])
    cols = [d[0] for d in cur.description]
    assert sorted(df.columns) == sorted(cols)
    assert rows(df.columns, df.collect()) == rows(cols, cur.fetchall())
