"""Every query against its SQL on the smallest tables."""

import duckdb
import numpy as np
import pandas as pd
import pytest

import __spark_entry__ as entry_points
from lodestone.plans.registry import ORACLES, QUERIES

DATA = "/root/testdata/sf0.001"
TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()


@pytest.fixture(scope="module")
def sql():
    db = duckdb.connect()
    for t in TABLES:
        db.sql(f"create view {t} as select * from '{DATA}/{t}.parquet'")
    return db


def rows(frame):
    def cell(x):
        if x is None or x is pd.NA or x is pd.NaT or x != x:
            return None
        if isinstance(x, (float, np.floating, int, np.integer)) and not isinstance(x, bool):
            return round(float(x), 6)
        return str(x)

    columns = sorted(frame.columns)
    return sorted(([cell(x) for x in r] for r in frame[columns].astype(object).itertuples(index=False)), key=str)


@pytest.mark.parametrize("name", sorted(QUERIES))
def test_query_equals_its_sql(spark, sql, name):
    got = QUERIES[name](spark, DATA).toPandas()
    if name not in ORACLES:  # held against small cases elsewhere
        assert len(got)
        return
    want = sql.sql(ORACLES[name]).df()
    assert sorted(got.columns) == sorted(want.columns)
    assert rows(got) == rows(want)


def test_entry_gives_rows(spark):
    assert entry_points.entry(spark).count() > 0


def test_every_query_is_listed():
    assert set(QUERIES) <= set(entry_points.queries())
    assert set(entry_points.oracle_sql()) <= set(entry_points.queries())
