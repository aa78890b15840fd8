"""Every query against its SQL in DuckDB, on the smallest tables, by value."""

import duckdb
import pytest

import __spark_entry__ as entry
from inkstream.plans import queries as plans

TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()


def plain(v):
    if isinstance(v, float):
        return float(f"{v:.9g}")
    if isinstance(v, (list, tuple)):
        return tuple(plain(x) for x in v)
    return v


def rows(names, data):
    order = sorted(range(len(names)), key=lambda i: names[i])
    return sorted(([plain(r[i]) for i in order] for r in data), key=repr)


@pytest.fixture(scope="module")
def duck(sf):
    con = duckdb.connect()
    for t in TABLES:
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM '{sf}/{t}.parquet'")
    return con


@pytest.mark.parametrize("name", sorted(plans.ORACLES))
def test_matches_sql(spark, sf, duck, name):
    df = plans.QUERIES[name](spark, sf)
    got = duck.execute(plans.ORACLES[name])
    names = [c[0] for c in got.description]
    assert sorted(names) == sorted(df.columns)
    assert rows(df.columns, df.collect()) == rows(names, got.fetchall())


@pytest.mark.parametrize("name", sorted(set(plans.QUERIES) - set(plans.ORACLES)))
def test_gives_rows(spark, sf, name):
    assert plans.QUERIES[name](spark, sf).count() > 0


def test_every_branch_of_the_cleaner_fires(spark):
    d = "/root/testdata/sf0.01"
    lines = plans._decided(spark, d)
    r = lines.selectExpr("count_if(cut)", "count_if(cut AND NOT fu AND NOT pc)", "count_if(cut AND fu AND NOT pc)", "count_if(cut AND pc AND NOT fu)", "count_if(rm)", "count_if(blank AND pc)").first()
    assert r[0] == 334 and r[1] == 240 and r[2] == 79 and r[3] == 10 and r[4] == 343 and r[5] == 46


def test_entry(spark):
    assert entry.entry(spark).count() > 0


def test_filters_reach_the_scan(spark, sf):
    plan = plans.objects_per_source(spark, sf)._jdf.queryExecution().executedPlan().toString()
    assert "ReadSchema: struct<source:string>" in plan
