"""Every query with SQL gives DuckDB's rows on the smallest tables."""

from __future__ import annotations

import math

import duckdb
import pytest

from tidemill.plans import queries as plans

TABLES = "region nation customer supplier part orders lineitem events".split()
DATA = "/root/testdata/sf0.001"


@pytest.fixture(scope="module")
def duck():
    con = duckdb.connect()
    for t in TABLES:
        con.sql(f"CREATE VIEW {t} AS FROM '{DATA}/{t}.parquet'")
    return con


def rows(names, data):
    order = sorted(range(len(names)), key=lambda i: names[i])

    def cell(v):
        if v is None or isinstance(v, float) and math.isnan(v):
            return "null"
        return str(v) if isinstance(v, (bool, str)) else repr(float(v)) if isinstance(v, (int, float)) else str(v)

    return sorted(tuple(cell(r[i]) for i in order) for r in data)


@pytest.mark.parametrize("name", sorted(plans.SQL))
def test_query_gives_the_rows_of_its_sql(spark, duck, name):
    got = plans.QUERIES[name](spark, DATA)
    want = duck.sql(plans.SQL[name])
    assert sorted(got.columns) == sorted(want.columns)
    assert rows(got.columns, got.collect()) == rows(want.columns, want.fetchall())


def test_sweep_selects_among_seventeen(spark):
    from tidemill.operators import models

    scores = plans.QUERIES["sweep"](spark, DATA).cache()
    assert {r["config"] for r in scores.select("config").distinct().collect()} <= set(range(17))
    assert models.summary(scores).count() == scores.select("config").distinct().count()


def test_ceiling_is_not_beaten_by_the_policy(spark):
    best = plans.QUERIES["ceiling"](spark, DATA).first()
    assert best["trades"] > 0 and best["pnl_ticks"] > 0


def test_all_queries_are_named_once_and_have_rows_or_sql():
    assert set(plans.SQL) <= set(plans.QUERIES)
