"""The queries that SQL can express against it."""

import os

import duckdb
import pytest

from causeway.llm import queries

SF = "/root/testdata/sf0.01"


@pytest.mark.parametrize("name", sorted(queries.ORACLES))
def test_matches(spark, name):
    c = duckdb.connect()
    for t in ("documents", "benchmark", "conversations"):
        p = f"{SF}/{t}.parquet"
        c.execute(f"create view {t} as select * from '{p + '/*.parquet' if os.path.isdir(p) else p}'")
    want = c.execute(queries.ORACLES[name])
    names = sorted(d[0] for d in want.description)
    place = {d[0]: i for i, d in enumerate(want.description)}
    got = queries.QUERIES[name](spark, SF)
    assert sorted(got.columns) == names
    assert sorted(str([r[n] for n in names]) for r in got.collect()) == sorted(str([r[place[n]] for n in names]) for r in want.fetchall())
