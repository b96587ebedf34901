"""Every registered query against its SQL, on the smallest data."""

import math

import duckdb
import pytest
from conftest import DATA

import __spark_entry__ as driver

TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations"
NAMES = sorted(driver.queries())


@pytest.fixture(scope="module")
def sql():
    con = duckdb.connect()
    for t in TABLES.split():
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM '{DATA}/{t}.parquet'")
    return con


def plain(v):
    if hasattr(v, "item"):
        v = v.item()
    if isinstance(v, float):
        return None if math.isnan(v) else round(v, 9) + 0.0
    return v


def canon(values, columns):
    order = sorted(range(len(columns)), key=columns.__getitem__)
    return sorted((tuple(plain(v[i]) for i in order) for v in values), key=repr)


@pytest.mark.parametrize("name", NAMES)
def test_query_matches_sql(spark, sql, name):
    df = driver.queries()[name](spark, str(DATA))
    plan = df._jdf.queryExecution().executedPlan().toString()
    assert "CartesianProduct" not in plan and "NestedLoopJoin" not in plan
    got = canon([tuple(r) for r in df.collect()], df.columns)
    text = driver.oracle_sql().get(name)
    if text is None:
        assert got
        return
    result = sql.execute(text)
    columns = [d[0] for d in result.description]
    assert sorted(columns) == sorted(df.columns)
    assert got == canon(result.fetchall(), columns)


def test_entry(spark):
    assert driver.entry(spark).count() > 0


def test_every_sql_has_a_query():
    assert set(driver.oracle_sql()) <= set(driver.queries())
