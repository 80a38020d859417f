"""Neighbour graphs without comparing all points: neighbours of neighbours in rounds of shuffled joins.

The start: points are numbered along several random orders in which close points tend to stand together (by the nearest of
random centres and the distance to it), and each block of ``block`` consecutive ones is compared within itself. The links of ``SAMPLE``
points are compared with those of an exact search, made once; while fewer than ``least`` of these are found and ``starts`` orders added
``gain`` to them, as many further orders add their blocks' links, of each point only those closer than what it has. A round then
gathers, for each point, its closest neighbours in both directions with their vectors, compares these with each other where one of
the two links is new, and keeps the ``pool`` closest of each point. Rounds end when ``least`` of the sample is found, a round added less than ``gain``,
fewer than ``share`` of the links have changed, or after ``rounds``; orders and rounds go on in turn until the sample is found. Rounds alone find the fewer
the more points there are, and move 2 * pool vectors a point; an order moves one, and what it adds falls slowly with the number of points.

A point has at most 2 * pool neighbours in a round, however many points name it, so hubs stay bounded; no query and no
vector passes through the driver besides the random centres of the start. The result is approximate; ``neighbour_graph`` is the exact way.
Ids are distinct; points without a vector have no neighbours.
"""

from __future__ import annotations

import functools
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from loomspan.operators.search import _unit, closest_pairs, exact_topk, matrix, nearest, pair_distances
from loomspan.operators.segment import number_rows
from loomspan.sources.snapshot import scratch

EDGES = "src long, dst long, distance double"
#: So many points, by a hash of their ids, have their links compared with the exact ones.
SAMPLE = 1024


def _kept(df: DataFrame) -> DataFrame:
    path = scratch(df.sparkSession)
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def _closest_of(edges: DataFrame, most: int, by: str = "src", other: str = "dst") -> DataFrame:
    order = Window.partitionBy(by).orderBy("distance", other)
    return edges.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= most)


def _along_centres(points: DataFrame, dims: int, centres: int, seed: int) -> DataFrame:
    """points(id, vector, reach) with the nearest of random centres and the similarity to it."""
    sent = points.sparkSession.sparkContext.broadcast(_unit(np.random.default_rng(seed).normal(size=(centres, dims))))

    def place(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            near = matrix(b.column(1)) @ sent.value.T if b.num_rows else np.zeros((0, 1))
            yield pa.RecordBatch.from_arrays([*b.columns, pa.array(near.argmax(1), pa.int64()), pa.array(near.max(1), pa.float64())], ["id", "vector", "reach", "centre", "near"])

    return points.mapInArrow(place, f"id long, vector {points.schema['vector'].dataType.simpleString()}, reach double, centre long, near double")


def _from_orders(points: DataFrame, dims: int, pool: int, block: int, seeds: range, n: int) -> DataFrame:
    """(src, dst, distance), a row a link: the pool closest others of each point(id, vector, reach) in its block of each random order, none beyond its reach."""
    blocks = -(-n // block)
    placed = []
    for k, seed in enumerate(seeds):
        order = number_rows(_along_centres(points, dims, max(1, min(256, n // block)), seed), ["centre", "near", "id"], "pos")
        placed.append(order.select("id", "vector", "reach", (F.expr(f"pos div {block}") + k * blocks).cast("int").alias("block")))

    def compare(rows: pa.Table) -> pa.Table:
        names, m, reach = rows["id"].to_numpy(), matrix(rows["vector"].combine_chunks()), rows["reach"].to_numpy()
        row, near, dist = closest_pairs(names, m, [slice(0, len(names))], pool, reach)
        return pa.table([names[row], near, dist], ["src", "dst", "distance"])

    dealt = functools.reduce(DataFrame.unionByName, placed).repartitionById(blocks * len(seeds), "block")  # a hash would deal several blocks to one partition
    return dealt.groupBy("block").applyInArrow(compare, EDGES).groupBy("src", "dst").agg(F.min("distance").alias("distance"))


def _compared(lists: DataFrame) -> DataFrame:
    """From rows (hub, id, vector, is_new, reach), a few a hub: links between the rows of a hub, one of them new, that are closer than what the source has."""

    def pairs(hub: np.ndarray, names: np.ndarray, m: np.ndarray, new: np.ndarray, reach: np.ndarray) -> Iterator[pa.RecordBatch]:
        ends = np.append(np.flatnonzero(hub[1:] != hub[:-1]) + 1, len(hub))
        start, out = 0, []
        for end in ends.tolist():
            d = 1.0 - m[start:end] @ m[start:end].T
            good = (new[start:end, None] | new[None, start:end]) & (d <= reach[start:end, None]) & (names[start:end, None] != names[None, start:end])
            i, j = np.nonzero(good)
            out.append((names[start + i], names[start + j], pair_distances(m, start + i, start + j)))
            start = end
        columns = [np.concatenate(c) for c in zip(*out, strict=True)]
        yield pa.RecordBatch.from_arrays([pa.array(c) for c in columns], ["src", "dst", "distance"])

    def compare(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        left = None
        for b in batches:
            if not b.num_rows:
                continue
            now = [b.column(k).to_numpy(zero_copy_only=False) for k in (0, 1)] + [matrix(b.column(2))] + [b.column(k).to_numpy(zero_copy_only=False) for k in (3, 4)]
            if left is not None:
                now = [np.concatenate((x, y)) for x, y in zip(left, now, strict=True)]
            # The last hub may go on in the next batch.
            cut = int(np.searchsorted(now[0], now[0][-1]))
            if cut:
                yield from pairs(*(x[:cut] for x in now))
            left = [x[cut:] for x in now]
        if left is not None:
            yield from pairs(*left)

    return lists.repartition("hub").sortWithinPartitions("hub").select("hub", "id", "vector", "is_new", "reach").mapInArrow(compare, EDGES)


def _sample(base: DataFrame, m: int, seed: int) -> DataFrame:
    """(src, reach, n): of the sampled points, how far the m nearest others reach by an exact search, and their number."""
    some = base.orderBy(F.xxhash64("id", F.lit(seed)), "id").limit(SAMPLE).select(F.col("id").alias("query_id"), "vector")
    others = nearest(exact_topk(base, some, m + 1).where("id <> query_id").drop("rank"), m)
    return _kept(others.groupBy(F.col("query_id").alias("src")).agg(F.max("distance").alias("reach"), F.count("*").alias("n")))


def _sampled_recall(edges: DataFrame, sample: DataFrame, m: int) -> float:
    """The share of the m links of the sampled points that are as close in edges(src, dst, distance, rank) as in the exact search; which of equally close ones does not matter."""
    found = edges.where(F.col("rank") <= m).join(F.broadcast(sample), "src").groupBy("src").agg(F.count_if(F.col("distance") <= F.col("reach") + 1e-9).alias("hits"))
    return sample.join(found, "src", "left").agg(F.coalesce(F.sum(F.coalesce("hits", F.lit(0))) / F.sum("n"), F.lit(1.0)).alias("r")).first().r


def _reaches(edges: DataFrame, pool: int) -> DataFrame:
    """(id, reach): how far the links of a point reach, without end while it has fewer than pool."""
    return edges.groupBy(F.col("src").alias("id")).agg(F.when(F.count("*") >= pool, F.max("distance")).otherwise(float("inf")).alias("reach"))


def _with_reach(base: DataFrame, edges: DataFrame, pool: int) -> DataFrame:
    return base.join(_reaches(edges, pool), "id", "left").withColumn("reach", F.coalesce("reach", F.lit(float("inf"))))


def _with_found(edges: DataFrame, found: DataFrame, pool: int) -> DataFrame:
    """The pool closest of each point among its links and found ones, which are new if it had them not."""
    old = edges.select("src", "dst", "distance", F.lit(False).alias("is_new"))
    every = old.unionByName(found.withColumn("is_new", F.lit(True))).groupBy("src", "dst").agg(F.min("distance").alias("distance"), F.min("is_new").alias("is_new"))
    return _kept(_closest_of(every, pool))


def _descend(edges: DataFrame, base: DataFrame, n: int, m: int, pool: int, rounds: int, share: float, least: float, gain: float, before: float, sample: DataFrame) -> tuple[DataFrame, float]:
    """edges after rounds of neighbours of neighbours, and the sample's recall."""
    for _ in range(rounds):
        # A point's closest links in both directions.
        back = _closest_of(edges.select(F.col("dst").alias("src"), F.col("src").alias("dst"), "distance", "is_new"), pool)
        both = edges.unionByName(back).groupBy(F.col("src").alias("hub"), F.col("dst").alias("id")).agg(F.max("is_new").alias("is_new"))
        lists = both.join(_with_reach(base, edges, pool), "id")
        edges = _with_found(edges, _compared(lists).groupBy("src", "dst").agg(F.min("distance").alias("distance")), pool)
        now = _sampled_recall(edges, sample, m)
        if now >= least or now < before + gain or edges.where("is_new").count() <= share * n * min(pool, m):
            return edges, now
        before = now
    return edges, before


def descended_graph(
    points: DataFrame, m: int, *, pool: int | None = None, block: int = 16384, starts: int = 4, rounds: int = 12, share: float = 0.002, seed: int = 3, least: float = 0.93, gain: float = 0.05
) -> DataFrame:
    """(src, dst, distance, rank): about the m nearest others of every point of points(id, vector), ``least`` of them by a sample."""
    spark, pool = points.sparkSession, pool or max(4 * m, 16)
    base = _kept(points.where("vector is not null").select(F.col("id").cast("long").alias("id"), "vector"))
    size = base.agg(F.count("*").alias("n"), F.max(F.size("vector")).alias("dims")).first()
    if not size.n:
        return spark.createDataFrame([], EDGES + ", rank int")
    seeds = range(seed, seed + (starts if size.n > block else 1))
    first = _from_orders(base.withColumn("reach", F.lit(float("inf"))), size.dims, pool, block, seeds, size.n)
    edges = _kept(_closest_of(first, pool).withColumn("is_new", F.lit(True)))
    if size.n > block and rounds:
        sample = _sample(base, m, seed)
        before, found = 0.0, _sampled_recall(edges, sample, m)
        while True:
            while found < least and found >= before + gain:
                seeds = range(seeds.stop, seeds.stop + starts)
                more = _from_orders(_kept(_with_reach(base, edges, pool)), size.dims, pool, block, seeds, size.n)
                edges = _with_found(edges, more, pool)
                before, found = found, _sampled_recall(edges, sample, m)
            edges, found = _descend(edges, base, size.n, m, pool, rounds, share, least, gain, found, sample)
            if found >= least:
                break
            before = 0.0
    return edges.where(F.col("rank") <= m).select("src", "dst", "distance", "rank")
