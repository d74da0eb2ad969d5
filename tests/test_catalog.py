"""Every query with an SQL twin returns the twin's rows on the smallest tables."""

import decimal
import os

import duckdb
import pytest

from railbird.plans import catalog, catalog_more, catalog_pages  # noqa: F401


@pytest.fixture(scope="module")
def duck(sf):
    c = duckdb.connect()
    for f in os.listdir(sf):
        c.sql(f"create view {f.split('.')[0]} as select * from '{sf}/{f}'")
    return c


def plain(x):
    if isinstance(x, float):
        return round(x, 6)
    return str(x) if isinstance(x, decimal.Decimal) else x


@pytest.mark.parametrize("name", sorted(catalog.QUERIES))
def test_query(spark, sf, duck, name):
    df = catalog.QUERIES[name](spark, sf)
    columns = sorted(df.columns)
    got = sorted((tuple(map(plain, r)) for r in df.select(columns).collect()), key=str)
    if name in catalog.ORACLES:
        rel = duck.sql(catalog.ORACLES[name])
        assert sorted(rel.columns) == columns
        at = [rel.columns.index(c) for c in columns]
        assert got == sorted((tuple(plain(r[i]) for i in at) for r in rel.fetchall()), key=str)
    assert got or name in catalog.MAY_BE_EMPTY


@pytest.mark.parametrize("name", ["change_feed", "settle_bets", "past_races", "extract_rss_changes", "match_scratch_names"])
def test_plans_stay_native(spark, sf, name):
    plan = catalog.QUERIES[name](spark, sf)._jdf.queryExecution().toString()
    assert "CartesianProduct" not in plan and "Python" not in plan and "Arrow" not in plan


def test_scans_are_pruned(spark, sf):
    plan = catalog.QUERIES["filter_family"](spark, sf)._jdf.queryExecution().executedPlan().toString()
    assert "o_totalprice" not in plan.split("ReadSchema")[1].split("\n")[0] or "lineitem" not in plan
