"""Every query against its SQL, as the driver compares them."""

import math
import os

import duckdb
import pytest

import __spark_entry__ as entry

SF = "/root/testdata/sf0.001"
TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()


@pytest.fixture(scope="module")
def duck():
    c = duckdb.connect()
    for t in TABLES:
        p = f"{SF}/{t}.parquet"
        c.execute(f"create view {t} as select * from '{p + '/*.parquet' if os.path.isdir(p) else p}'")
    return c


def rows(names, data):
    order = sorted(range(len(names)), key=lambda i: names[i])
    clean = lambda v: round(v, 9) if isinstance(v, float) and math.isfinite(v) else v
    return sorted(map(str, ([clean(r[i]) for i in order] for r in data)))


@pytest.mark.parametrize("name", sorted(entry.oracle_sql()))
def test_matches_sql(spark, duck, name):
    got = entry.queries()[name](spark, SF)
    want = duck.execute(entry.oracle_sql()[name])
    names = [d[0] for d in want.description]
    assert sorted(got.columns) == sorted(names)
    assert rows(got.columns, [tuple(r) for r in got.collect()]) == rows(names, want.fetchall())


def test_entry(spark):
    assert entry.entry(spark).count() == 210
    assert set(entry.oracle_sql()) <= set(entry.queries())


@pytest.mark.parametrize("name", sorted(set(entry.catalog.QUERIES) - set(entry.catalog.ORACLES)))
def test_runs_without_sql(spark, name):
    assert entry.queries()[name](spark, SF).count() > 0


def test_ghost_scenario_runs_at_the_operators_defaults(monkeypatch):
    from causeway import catalog
    from causeway.plans import scenarios

    monkeypatch.setattr(scenarios, "ghost_result", lambda spark, **options: options)
    assert catalog.ghost_scenario(None, SF) == {}
