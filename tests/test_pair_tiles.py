"""Tables of all pairs: every pair once, in files that stay small."""

from pathlib import Path

import pytest
from pyspark.sql import functions as F

from causeway import catalog as K
from causeway.operators import dyads as D
from causeway.sources import events as E

SF = "/root/testdata/sf0.1"


@pytest.mark.parametrize(("name", "bytes_a_pair"), [("dyad_similarity", 1.0), ("dyad_counts_of_first_days", 1.0), ("pair_matrix", 1.0), ("repair_cost", 1.0), ("touching_pairs", 1.2)])
def test_pairs_are_written_small_and_whole(spark, tmp_path, name, bytes_a_pair):
    df = K.QUERIES[name](spark, SF)
    df.write.parquet(f"file://{tmp_path}/out")
    out = spark.read.parquet(f"file://{tmp_path}/out")
    r = out.agg(F.count("*").alias("rows"), F.count_distinct(F.concat_ws(" ", "ego_id", "alter_id")).alias("pairs")).first()
    n = E.packed(spark, SF, E.SLICE if "days" in name else None)[1].count()
    ending = E.packed(spark, SF)[1].where("model_id like '%7'").count()
    want = {"pair_matrix": n * n, "touching_pairs": n * (n - 1) - (n - ending) * (n - ending - 1)}.get(name, n * (n - 1))
    assert r["rows"] == r["pairs"] == want
    assert sum(p.stat().st_size for p in Path(tmp_path, "out").glob("*.parquet")) <= bytes_a_pair * want
    spark.catalog.clearCache()


def test_records_are_written_small_and_whole(spark, tmp_path):
    """Ids of pairs are all different, so files are small only if a string is kept by what differs from the one before."""
    spark.conf.unset("parquet.writer.version")
    try:
        K.dyad_records(spark, SF).write.parquet(f"file://{tmp_path}/out")
        spark.conf.set("parquet.writer.version", "v1")
        K.dyad_records(spark, SF)
        assert spark.conf.get("parquet.writer.version") == "v1"  # a user's choice stays
    finally:
        spark.conf.unset("parquet.writer.version")
        spark.catalog.clearCache()
    out, n = spark.read.parquet(f"file://{tmp_path}/out"), E.packed(spark, SF)[1].count()
    assert out.count() == out.select("dyad_id").distinct().count() == n * (n - 1)
    assert sum(p.stat().st_size for p in Path(tmp_path, "out").glob("*.parquet")) <= n * (n - 1)


def test_tiles_of_any_size(spark, monkeypatch):
    reg, m = E.packed(spark, "/root/testdata/sf0.001")
    want = sorted(map(tuple, D.counts(D.pairs(m, reg), reg).collect()))
    assert len(want) == m.count() * (m.count() - 1)
    monkeypatch.setattr(D, "BROADCAST_BYTES", 0)
    for tile in (1, 4, 1000):
        monkeypatch.setattr(D, "TILE", tile)
        assert sorted(map(tuple, D.counts(D.pairs(m, reg), reg).collect())) == want
    assert D.pairs(m.limit(0), reg).count() == 0 == D.pairs(m, reg, m.limit(0)).count()


@pytest.mark.parametrize("held", ["both", "egos"])
def test_no_row_meets_more_than_a_tile(spark, monkeypatch, held):
    """A nested loop over all egos keeps a whole tile's pairs in memory until the first is read: with 90,000 users 11.5 million rows a task."""
    reg, m = E.packed(spark, "/root/testdata/sf0.001")
    few = m.orderBy("model_id").limit(3).persist()
    want = sorted(map(tuple, D.counts(D.pairs(few, reg, m), reg).collect()))
    assert len(want) == 3 * (m.count() - 1)
    if held == "egos":  # the alters are too many to broadcast
        monkeypatch.setattr(D, "BROADCAST_BYTES", 5 * (64 + 32 * reg.words + 8 * len(reg.nodes)))
    monkeypatch.setattr(D, "TILE", 4)
    out = D.counts(D.pairs(few, reg, m), reg)
    plan = out._jdf.queryExecution().executedPlan().toString()
    assert "NestedLoop" not in plan and "CartesianProduct" not in plan
    assert sorted(map(tuple, out.collect())) == want
    if held == "both":
        assert "Generate" not in plan and "Range (0" in plan
