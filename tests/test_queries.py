"""Every query with SQL, side by side with DuckDB on the smallest tables."""

import math
import os

import duckdb
import pandas as pd
import pytest

from pitchside.plans import catalog

FOLDER = os.environ.get("TEST_SF_DIR", "/root/testdata/sf0.001")
TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations"
pytestmark = pytest.mark.skipif(not os.path.isdir(FOLDER), reason="no test tables")


@pytest.fixture(scope="module")
def duck():
    con = duckdb.connect()
    con.execute("SET TimeZone = 'UTC'")
    for t in TABLES.split():
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM read_parquet('{FOLDER}/{t}.parquet')")
    return con


def plain(v):
    if v is None or v is pd.NaT or v is pd.NA:
        return None
    if hasattr(v, "item"):
        v = v.item()
    if isinstance(v, float):
        return None if math.isnan(v) else int(v) if v == int(v) else v
    return v


def rows(df):
    return sorted(repr(tuple(plain(v) for v in r)) for r in df[sorted(df.columns)].itertuples(index=False, name=None))


@pytest.mark.parametrize("name", sorted(catalog.oracle_sql()))
def test_same_rows(spark, duck, name):
    got = catalog.queries()[name](spark, FOLDER).toPandas()
    want = duck.sql(catalog.oracle_sql()[name]).df()
    assert sorted(got.columns) == sorted(want.columns)
    assert rows(got) == rows(want)


def test_every_query_runs_without_sql(spark):
    for name in sorted(set(catalog.queries()) - set(catalog.oracle_sql())):
        got = catalog.queries()[name](spark, FOLDER)
        assert got.count() > 0 and len(set(got.columns)) == len(got.columns), name


def test_entry(spark):
    import __spark_entry__

    assert __spark_entry__.entry(spark).count() > 0
    assert set(__spark_entry__.oracle_sql()) <= set(__spark_entry__.queries())


def test_plans_push_down(spark):
    plan = catalog.queries()["win_06_latest_price"](spark, FOLDER)._jdf.queryExecution().toString()
    assert "Window" not in plan
    physical = plan.split("Physical Plan")[-1]
    assert "l_tax" not in physical and "l_commitdate" not in physical


def test_all_of_positive_value_in_order(spark):
    q = catalog.queries()
    got = [tuple(r) for r in q["top_01_by_ev"](spark, FOLDER).select("match_id", "selection", "odds", "ev").collect()]
    want = [tuple(r) for r in q["flt_05_positive_ev"](spark, FOLDER).select("match_id", "selection", "odds", "ev").collect()]
    assert len(got) > 50
    assert got == sorted(want, key=lambda r: (-r[3], r[0], r[1]))
