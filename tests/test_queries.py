"""Every registered query of the engine against its SQL twin on the smallest tables."""

import os

import duckdb
import pandas as pd
import pytest

import __spark_entry__ as entry
from inkspark.plans.queries import ORACLES, QUERIES

DATA = "/root/testdata/sf0.001"


@pytest.fixture(scope="module")
def duck():
    con = duckdb.connect()
    con.execute("SET TimeZone = 'UTC'")
    for name in os.listdir(DATA):
        con.execute(f"CREATE VIEW {name.removesuffix('.parquet')} AS SELECT * FROM '{DATA}/{name}'")
    return con


def rows(frame: pd.DataFrame) -> list[tuple]:
    def cell(v):
        if v is None or v is pd.NA or isinstance(v, float) and v != v:
            return ""
        return str(int(v)) if isinstance(v, float) and v == int(v) else str(v)

    return sorted(tuple(cell(v) for v in r) for r in frame[sorted(frame.columns)].itertuples(index=False))


@pytest.mark.parametrize("name", sorted(ORACLES))
def test_matches_sql(spark, duck, name):
    got, want = QUERIES[name](spark, DATA).toPandas(), duck.execute(ORACLES[name]).df()
    assert sorted(got.columns) == sorted(want.columns)
    assert rows(got) == rows(want)


@pytest.mark.parametrize("name", sorted(set(QUERIES) - set(ORACLES)))
def test_runs(spark, name):
    assert QUERIES[name](spark, DATA).count() > 0


def test_entry(spark):
    assert entry.entry(spark).count() > 0
    assert set(entry.oracle_sql()) <= set(entry.queries())


def test_path_condition_reaches_below_the_page_reader(spark):
    from inkspark.plans import dql
    from inkspark.sources import derived

    pages = dql.pages(derived.notes(spark, DATA))
    plan = dql.plan(pages, dql.parse('LIST FROM "en"'))._jdf.queryExecution().optimizedPlan().toString()
    assert plan.index("Generate") < plan.index("Filter")
