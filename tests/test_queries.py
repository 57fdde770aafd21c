"""Each registered query with SQL gives the same rows as that SQL."""

import duckdb
import numpy as np
import pandas as pd
import pytest

from palimpsest.plans import queries as plans

TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()


@pytest.fixture(scope="module")
def oracle(sf):
    con = duckdb.connect()
    for t in TABLES:
        con.sql(f"CREATE VIEW {t} AS SELECT * FROM '{sf}/{t}.parquet'")
    return con


def same(a: pd.DataFrame, b: pd.DataFrame) -> None:
    assert sorted(a.columns) == sorted(b.columns)
    names = sorted(a.columns)
    tidy = lambda x: x.assign(**{c: x[c].map(str) for c in names if x[c].dtype == object})[names].sort_values(names).reset_index(drop=True)
    a, b = tidy(a), tidy(b)
    assert len(a) == len(b)
    for c in names:
        if a[c].dtype == object:
            assert (a[c] == b[c]).all(), c
        else:
            assert np.array_equal(a[c].astype(float), b[c].astype(float), equal_nan=True), c


@pytest.mark.parametrize("name", sorted(plans.queries()))
def test_query(spark, sf, oracle, name):
    got = plans.queries()[name](spark, sf).toPandas()
    sql = plans.oracle_sql().get(name)
    if sql:
        same(got, oracle.sql(sql).df())
    else:
        assert len(got)
