"""Every query with SQL equals DuckDB's answer on the smallest tables."""

import datetime
import decimal
import os

import duckdb
import pandas as pd
import pytest

from voltlake.plans import catalogue

FOLDER = "/root/testdata/sf0.001"
TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()

pytestmark = pytest.mark.skipif(not os.path.isdir(FOLDER), reason="the driver's tables are not here")


def plain(v):
    if isinstance(v, float):
        return None if v != v else round(v, 6) + 0.0
    if isinstance(v, decimal.Decimal):
        return round(float(v), 6) + 0.0
    if isinstance(v, (datetime.datetime, pd.Timestamp)):
        return str(v)
    return v


@pytest.fixture(scope="module")
def duck():
    c = duckdb.connect()
    c.execute("SET timezone = 'UTC'")
    for t in TABLES:
        c.execute(f"CREATE VIEW {t} AS SELECT * FROM read_parquet('{FOLDER}/{t}.parquet')")
    return c


@pytest.mark.parametrize("name", sorted(catalogue.oracle_sql()))
def test_query_equals_sql(spark, duck, name):
    df = catalogue.queries()[name](spark, FOLDER)
    names = sorted(df.columns)
    got = sorted((tuple(plain(r[c]) for c in names) for r in df.collect()), key=repr)
    r = duck.execute(catalogue.oracle_sql()[name])
    there = [d[0] for d in r.description]
    assert sorted(there) == names
    want = sorted((tuple(plain(x[there.index(c)]) for c in names) for x in r.fetchall()), key=repr)
    assert got == want


@pytest.mark.parametrize("name", sorted(set(catalogue.queries()) - set(catalogue.oracle_sql())))
def test_query_runs(spark, name):
    assert catalogue.queries()[name](spark, FOLDER).count() > 0


def test_no_python_in_hot_plans(spark):
    for name in ("zone_loads", "overlap_merge", "pip_join", "feeder_rank", "dq_verdict", "fold_names"):
        plan = catalogue.queries()[name](spark, FOLDER)._jdf.queryExecution().executedPlan().toString()
        assert "Python" not in plan and "Pandas" not in plan, name


def test_filters_reach_the_scan(spark):
    plan = catalogue.queries()["dup_rows"](spark, FOLDER)._jdf.queryExecution().executedPlan().toString()
    assert "l_shipdate" not in plan
