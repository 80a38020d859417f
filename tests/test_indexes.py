"""Stored cells, inserts beside them, versioned snapshots and look-ups by id."""

import json

import numpy as np
import pytest
from pyspark.sql import functions as F

from loomspan.functions.filters import AtLeast, AtMost, Between, Equals
from loomspan.operators import search as S
from loomspan.operators.cells import CellIndex
from loomspan.operators.graph import GraphConfig
from loomspan.sources.records import Records


def clustered(spark, n=1200, dims=8, groups=20, seed=0, first=0):
    """Points around a few directions; group and year follow the direction, wet does not."""
    rng = np.random.default_rng(seed)
    centre = np.random.default_rng(99).normal(size=(groups, dims))
    at = rng.integers(groups, size=n)
    v = centre[at] + 0.1 * rng.normal(size=(n, dims))
    rows = [(first + i, v[i].tolist(), f"g{at[i]}", float(2000 + at[i]) if i % 17 else None, bool(i % 2)) for i in range(n)]
    return spark.createDataFrame(rows, "id long, vector array<float>, grp string, year double, wet boolean")


def found(hits):
    return sorted((r.query_id, r.rank, r.id, round(r.distance, 9)) for r in hits.collect())


def some_queries(points, every=60):
    return points.where(f"id % {every} = 0").select(F.col("id").alias("query_id"), "vector")


FILTERS = [(), (Equals("grp", "g3"),), (AtLeast("year", 2015),), (AtMost("year", 2002), Equals("wet", True)), (Between("year", 2004, 2006),), (Equals("grp", "none"),), (Equals("year", "2001"),), (Equals("gone", 1),), (AtLeast("grp", 3),)]


@pytest.mark.parametrize("conditions", FILTERS, ids=str)
def test_bounds_lose_nothing(spark, conditions):
    p = clustered(spark)
    index = spark_index(p)
    assert found(index.search(some_queries(p), 7, conditions)) == found(S.exact_topk(p, some_queries(p), 7, conditions))


_INDEX = {}


def spark_index(p):
    if "one" not in _INDEX:
        _INDEX["one"] = CellIndex.build(p, 24)
    return _INDEX["one"]


def test_search_opens_few_cells_and_files(spark):
    p = clustered(spark)
    index = spark_index(p)
    one = p.where("id = 5").select(F.col("id").alias("query_id"), "vector")
    whole = sum(b.size for part in index.parts for b in part.cells.values())
    hits = index.search(one, 5)
    assert hits.count() == 5
    assert sum(v.rows for v in index.visits) < 0.5 * 1200 and sum(v.size for v in index.visits) < 0.5 * whole
    some = list(index.parts[0].cells)[:3]
    read = index._read(index.parts[0], some)
    scan = read._jdf.queryExecution().executedPlan().toString()
    assert "PartitionFilters: [cell" in scan and {r.cell for r in read.select("cell").distinct().collect()} == set(some)
    index.search(one, 5, [Equals("grp", "g3")])
    assert sum(v.rows for v in index.visits) < 0.3 * 1200
    index.search(one, 5, [Equals("grp", "none")])
    assert index.visits == []


def test_points_that_do_not_cluster_and_ties(spark):
    rng = np.random.default_rng(4)
    rows = [(i, rng.integers(-1, 2, size=4).astype(float).tolist()) for i in range(300)] + [(900, None)]
    p = spark.createDataFrame(rows, "id long, vector array<float>")
    q = some_queries(p.where("id < 900"), 25)
    index = CellIndex.build(p, 9)
    assert found(index.search(q, 20, block=5)) == found(S.exact_topk(p.where("vector is not null"), q, 20))
    assert found(CellIndex.build(p.limit(0), 4).search(q, 3)) == []


def test_inserts_keep_the_index_and_merge(spark):
    first, more = clustered(spark, 400), [clustered(spark, 60, seed=s, first=1000 * s) for s in range(1, 7)]
    index, every = CellIndex.build(first, 12, fanout=3), first
    sizes = []
    for rows in more:
        index.add(rows)
        every = every.unionByName(rows)
        sizes.append(len(index.parts))
    assert sum(p.n for p in index.parts) == 760 and max(sizes) <= 4 and len(index.parts) < 7
    q = some_queries(every)
    whole = CellIndex.build(every, 12)
    assert found(index.search(q, 6)) == found(whole.search(q, 6)) == found(S.exact_topk(every, q, 6))
    empty = CellIndex.build(first.limit(0), 4).add(first)
    assert found(empty.search(q, 6)) == found(S.exact_topk(first, q, 6))


def test_table_inserts_after_both_indexes(spark):
    t = S.VectorTable(spark, 8).insert(clustered(spark, 300)).build_index(8).build_graph(GraphConfig(m=8, ef_construction=60, shard_rows=200))
    t.insert(clustered(spark, 100, seed=3, first=5000))
    q = some_queries(t.points, 50)
    exact = S.exact_topk(t.points, q, 5)
    assert t.cells is not None and t.graphs is not None and len(t.cells.parts) == 2
    assert found(t.search(q, 5)) == found(exact)
    assert S.recall(t.search(q, 5, ef=80), exact).first().recall >= 0.9
    assert S.recall(t.search(q, 5, nprobe=6), exact).first().recall >= 0.9
    assert {r.id for r in t.search(q, 5, ef=80).collect()} & set(range(5000, 5100))


def test_snapshot_keeps_indexes_and_versions(spark, tmp_path, monkeypatch):
    path = str(tmp_path / "snap")
    t = S.VectorTable(spark, 8).insert(clustered(spark, 300)).build_index(8).build_graph(GraphConfig(m=8, ef_construction=60))
    q = some_queries(t.points, 50)
    want, walked = found(t.search(q, 5)), found(t.search(q, 5, ef=50))
    assert t.save(path, {"name": "wells"}) == 1
    old = S.VectorTable.load(spark, path)
    t.insert(clustered(spark, 50, seed=9, first=7000))
    with monkeypatch.context() as m:  # a save that ends before its manifest
        m.setattr(json, "dumps", lambda *a, **k: (_ for _ in ()).throw(RuntimeError("stopped")))
        with pytest.raises(RuntimeError):
            t.save(path)
    assert S.VectorTable.load(spark, path).info()["count"] == 300
    assert t.save(path) == 2
    new = S.VectorTable.load(spark, path)
    assert new.info()["count"] == 350 and old.info()["count"] == 300 and S.VectorTable.load(spark, path, 1).info()["count"] == 300
    assert found(old.search(q, 5)) == want and found(old.search(q, 5, ef=50)) == walked
    assert found(new.search(q, 5)) == found(S.exact_topk(new.points, q, 5)) and new.cells is not None and new.graphs is not None
    assert old.get(3) == t.get(3)
    with pytest.raises(KeyError):
        old.get(7001)
    with pytest.raises(PermissionError):
        old.save(path)
    with pytest.raises(ValueError):
        S.VectorTable.load(spark, path, 9)


def test_records_open_few_files(spark, tmp_path):
    rows = spark.range(4000).selectExpr("id", "id % 7 AS v", "0 AS seq").unionByName(spark.createDataFrame([(17, 99, 1), (17, 98, 2), (None, 5, 0)], "id long, v long, seq int"))
    path = str(tmp_path / "r")
    with_parts = rows.sparkSession.conf.get("spark.sql.adaptive.coalescePartitions.enabled")
    spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "false")
    try:
        Records.write(rows, path)
    finally:
        spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", with_parts)
    r = Records(spark, path)
    files = len(r.rows.inputFiles())
    assert files >= 4 and len(r.find([1500]).inputFiles()) == 1 and len(r.files([2, 3])) == 1
    assert [x.v for x in r.find([1500]).collect()] == [1500 % 7]
    assert sorted(x.v for x in r.find([17]).collect()) == [3, 98, 99] and r.latest([17]).first().v == 98
    assert r.find([10**9]).collect() == [] and r.find([]).collect() == []
    hits = spark.createDataFrame([(1, 17), (2, 3999), (3, 10**9), (4, None)], "query_id long, id long")
    assert sorted((x.query_id, x.v) for x in r.of_hits(hits).collect()) == [(1, 3), (1, 98), (1, 99), (2, 3999 % 7)]


def test_search_by_bounds_needs_one_set_of_workers(spark, monkeypatch):
    """tables made from lists in the driver start Python workers of their own, beside those of the scans."""
    p = clustered(spark, 300)
    q = some_queries(p)
    want = found(S.exact_topk(p, q, 4))
    monkeypatch.setattr(type(spark), "createDataFrame", lambda *a, **k: pytest.fail("a table from a list"))
    index = CellIndex.build(p, 8)
    assert found(index.search(q, 4)) == want
    assert found(index.search(q.limit(0), 4)) == found(index.search(q, 4, [Equals("grp", "none")])) == []
    assert CellIndex.build(p.limit(0), 4).search(q, 4).count() == 0
