import numpy as np
from pyspark.sql import functions as F

from loomspan.operators import search as S
from loomspan.operators.neighbours import _from_orders, descended_graph


def frame(spark, vectors):
    return spark.createDataFrame([(i * 3, None if v is None else [float(x) for x in v]) for i, v in enumerate(vectors)], "id long, vector array<float>")


def pairs(graph):
    return graph.select(F.col("src").alias("query_id"), F.col("dst").alias("id"))


def test_descent_finds_what_blocks_miss(spark):
    p = frame(spark, np.random.default_rng(1).normal(size=(1200, 24)))
    exact = S.neighbour_graph(p, 5)
    got = descended_graph(p, 5, block=60)
    start = descended_graph(p, 5, block=60, rounds=0)
    assert got.count() == 6000 and got.where("src = dst").count() == 0 and got.select("src", "dst").distinct().count() == 6000
    first, last = (S.recall(pairs(g), pairs(exact)).first().recall for g in (start, got))
    assert last >= 0.9 and last > first + 0.1
    both = got.join(exact.withColumnRenamed("distance", "d"), ["src", "dst"])
    assert both.where("abs(distance - d) > 1e-9").count() == 0


def test_descent_of_small_and_hard_tables(spark):
    assert descended_graph(frame(spark, []), 3).collect() == []
    assert descended_graph(frame(spark, [[1.0, 2.0]]), 3).collect() == []
    few = frame(spark, [[1.0, 0.0], [0.9, 0.1], [0.0, 1.0], None])
    assert sorted((r.src, r.dst, r.rank) for r in descended_graph(few, 1).collect()) == [(0, 3, 1), (3, 0, 1), (6, 3, 1)]
    hub = frame(spark, [*np.ones((150, 3)), *np.random.default_rng(2).normal(size=(150, 3))])  # a group of copies
    got = descended_graph(hub, 3, block=40, pool=12)
    assert got.groupBy("src").count().where("count <> 3").count() == 0
    assert got.where("src < 450 AND distance > 1e-9").count() == 0


def test_blocks_of_points_give_the_exact_graph(spark):
    """Any number of blocks gives the rows of brute force: ties, copies, repeated ids, points at zero and without a vector."""
    rng = np.random.default_rng(4)
    v = rng.integers(-2, 3, size=(150, 3)).astype(float)
    v[3] = 0
    ids = [*range(140), *range(10)]
    unit = v / np.maximum(np.sqrt((v * v).sum(1, keepdims=True)), 1e-12)
    p = spark.createDataFrame([(i, x.tolist()) for i, x in zip(ids, v)] + [(999, None)], "id long, vector array<double>")
    want = {}
    for i in set(ids):
        d = [(round(float(1 - unit[a] @ unit[b]), 9), ids[b]) for a in range(150) if ids[a] == i for b in range(150) if ids[b] != i]
        want[i] = [x for x, _ in sorted(d)[:4]]
    for size in (32 << 20, 1200, 200):
        got = {}
        for r in S.neighbour_graph(p, 4, size).orderBy("src", "rank").collect():
            assert r.src != r.dst
            got.setdefault(r.src, []).append(round(r.distance, 9) + 0.0)
        assert got.keys() == want.keys() and all(np.allclose(got[i], want[i]) for i in want)
    assert S.neighbour_graph(p.where("id = 999"), 4).collect() == S.neighbour_graph(p.where("id = 0").limit(1), 4).collect() == []


def test_each_pair_of_blocks_has_a_partition(spark):
    """a task compares one pair of blocks of bounded size, however many points there are."""
    p = frame(spark, np.random.default_rng(5).normal(size=(300, 4)))
    plan = S.neighbour_graph(p, 4, 2400)._jdf.queryExecution().executedPlan().toString()  # 300 * 4 * 8 bytes: at least 4 blocks, 10 pairs
    assert "shufflepartitionidpassthrough" in plan and "REPARTITION_BY_NUM" in plan


def test_descent_goes_on_until_a_sample_is_found(spark):
    """F2: with too small a pool and too few rounds, further random orders bring the recall up."""
    p = frame(spark, np.random.default_rng(6).normal(size=(500, 24)))
    got = descended_graph(p, 3, block=100, starts=2, rounds=1, pool=4)
    assert S.recall(pairs(got), pairs(S.neighbour_graph(p, 3))).first().recall >= 0.9


def test_pairs_found_by_floats_are_exact():
    """many copies, points closer together than floats tell, repeated ids, rows with a reach; one side and two."""
    rng = np.random.default_rng(7)
    v = rng.normal(size=(700, 24))
    v[100:300] = v[50]
    v[300:400] = v[60] + rng.normal(size=(100, 24)) * 1e-6
    v = S._unit(v)
    ids = rng.permutation(700)
    ids[:20] = ids[20:40]
    d = S.pair_distances(v, *(x.ravel() for x in np.indices((700, 700)))).reshape(700, 700)
    d[ids[:, None] == ids] = np.inf
    for cut, reach in ((700, None), (333, None), (333, np.where(np.arange(700) % 3, np.inf, 0.5))):
        sides = [slice(0, 700)] if cut == 700 else [slice(0, cut), slice(cut, 700)]
        row, near, dist = S.closest_pairs(ids, v, sides, 5, reach, tile=64)
        for i in range(700):
            other = np.arange(700) if cut == 700 else np.arange(cut, 700) if i < cut else np.arange(cut)
            far = np.inf if reach is None else reach[i]
            want = sorted((d[i, j], ids[j]) for j in other if d[i, j] <= far and np.isfinite(d[i, j]))[:5]
            assert list(zip(dist[row == i], near[row == i])) == want


def test_each_block_of_an_order_has_a_partition(spark):
    """blocks of all orders are spread evenly, and give nothing beyond what a point has."""
    p = frame(spark, np.random.default_rng(8).normal(size=(400, 8))).withColumn("reach", F.when(F.col("id") % 2 == 0, 0.2).otherwise(float("inf")))
    found = _from_orders(p, 8, 6, 100, range(3), 400)
    plan = found._jdf.queryExecution().executedPlan().toString()
    assert "shufflepartitionidpassthrough" in plan and "REPARTITION_BY_NUM" in plan
    assert found.where("src % 2 = 0 AND distance > 0.2").count() == 0 and found.where("src % 2 = 1").groupBy("src").count().where("count < 6").count() == 0
    assert found.select("src", "dst").distinct().count() == found.count()
