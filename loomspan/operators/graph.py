"""Layered navigable graphs over shards of the points: insertion, greedy descent and beam search.

Each task cuts its rows into shards of at most ``shard_rows`` and builds one graph of each, so nothing is
shuffled, no key can be hot, and a lost task builds its shards again. A shard is one row of byte columns
in a file of its own. A search sends blocks of queries to all shards; each walks its graph and gives k rows
a query, of which the nearest are kept as in the exact search.

Links go to the closest points only, so more than 2 m copies of one point may link to nothing else: such a
shard's recall falls, and the exact search is the way for it.
"""

from __future__ import annotations

import functools
import json
import math
from collections.abc import Iterator
from dataclasses import dataclass
from heapq import heappop, heappush, heapreplace

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession

from loomspan.operators.search import HITS, _unit, in_blocks, matrix, nearest, query_blocks
from loomspan.sources.snapshot import scratch

SEED = 0xDEADBEEFCAFE1337  # fixed value
SHARD = "ids binary, vectors binary, levels binary, sizes binary, links binary, entry int"
_MASK = (1 << 64) - 1


@dataclass(frozen=True)
class GraphConfig:
    """m links a point and layer (twice as many in the lowest), and the widths of the beams that build and search."""

    m: int = 16
    ef_construction: int = 200
    ef_search: int = 100
    shard_rows: int = 8192

    def __post_init__(self):
        if self.m < 2 or min(self.ef_construction, self.ef_search, self.shard_rows) < 1:
            raise ValueError("m is at least 2, widths and shards at least 1")

    def most(self, layer: int) -> int:
        return self.m if layer else 2 * self.m

    @property
    def scale(self) -> float:
        return 1 / math.log(self.m)


def _step(x: int) -> int:
    """The 64-bit xorshift generator (13, 7, 17: fixed values)."""
    x ^= x << 13 & _MASK
    x ^= x >> 7
    return x ^ x << 17 & _MASK


def _times(columns: list[int], x: int) -> int:
    out = 0
    for j, c in enumerate(columns):
        if x >> j & 1:
            out ^= c
    return out


def _jumped(steps: int, x: int = SEED) -> int:
    """The generator's state after so many steps: it is linear, so powers of one matrix of bits do."""
    power = [_step(1 << j) for j in range(64)]
    while steps:
        if steps & 1:
            x = _times(power, x)
        power, steps = [_times(power, c) for c in power], steps >> 1
    return x


def drawn_layers(n: int, scale: float, state: int = SEED) -> np.ndarray:
    """The layers of n points in order of insertion."""
    draws = np.empty(n)
    for i in range(n):
        state = _step(state)
        draws[i] = state / 2**64
    return (-np.log(np.maximum(draws, 1e-18)) * scale).astype(np.int32)


def layer_counts(spark: SparkSession, n: int, config: GraphConfig = GraphConfig(), block: int = 1 << 16) -> DataFrame:
    """(layer, n) of n points inserted one after the other; blocks of the sequence are drawn in tasks of their own."""

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for i in b.column(0).to_pylist():
                found = np.bincount(drawn_layers(min(block, n - i * block), config.scale, _jumped(i * block)))
                yield pa.RecordBatch.from_arrays([pa.array(range(len(found)), pa.int32()), pa.array(found, pa.int64())], ["layer", "n"])

    blocks = spark.range(-(-n // block)).mapInArrow(count, "layer int, n long")
    return blocks.groupBy("layer").sum("n").withColumnRenamed("sum(n)", "n").where("n > 0")


class Graph:
    """One shard's graph; nodes are places in ``vectors`` (unit rows)."""

    def __init__(self, config: GraphConfig, vectors: np.ndarray):
        self.config, self.vectors = config, vectors
        self.links: list[list[list[int]]] = []
        self.entry = -1

    @classmethod
    def built(cls, config: GraphConfig, vectors: np.ndarray) -> Graph:
        g = cls(config, vectors)
        for layer in drawn_layers(len(vectors), config.scale).tolist():
            g._insert(layer)
        return g

    def _distances(self, q: np.ndarray, nodes: list[int]) -> list[float]:
        return (1.0 - self.vectors[nodes] @ q).tolist()

    def _descend(self, q: np.ndarray, at: int, layer: int) -> int:
        """Goes to the nearest neighbour as long as that is nearer."""
        best = self._distances(q, [at])[0]
        while near := self.links[at][layer]:
            d, node = min(zip(self._distances(q, near), near, strict=True))
            if d >= best:
                break
            at, best = node, d
        return at

    def _beam(self, q: np.ndarray, at: int, width: int, layer: int) -> list[tuple[float, int]]:
        """The nearest nodes found (distance, node), at most ``width``, nearest first."""
        start = self._distances(q, [at])[0]
        seen, frontier, kept = {at}, [(start, at)], [(-start, -at)]
        while frontier:
            d, node = heappop(frontier)
            if len(kept) >= width and d > -kept[0][0]:
                break
            fresh = [n for n in self.links[node][layer] if n not in seen]
            if not fresh:
                continue
            seen.update(fresh)
            for x, n in zip(self._distances(q, fresh), fresh, strict=True):
                if len(kept) < width:
                    heappush(kept, (-x, -n))
                elif x < -kept[0][0]:
                    heapreplace(kept, (-x, -n))
                else:
                    continue
                heappush(frontier, (x, n))
        return sorted((-x, -n) for x, n in kept)

    def _insert(self, layer: int) -> None:
        node, top = len(self.links), len(self.links[self.entry]) - 1 if self.links else -1
        q = self.vectors[node]
        self.links.append([[] for _ in range(layer + 1)])
        at = self.entry
        for high in range(top, layer, -1):
            at = self._descend(q, at, high)
        for low in range(min(layer, top), -1, -1):
            near = self._beam(q, at, self.config.ef_construction, low)[: self.config.m]
            at = near[0][1]
            self.links[node][low] = [n for _, n in near]
            for _, n in near:
                self._link(n, node, low)
        if layer > top:
            self.entry = node

    def _link(self, node: int, other: int, layer: int) -> None:
        near = self.links[node][layer]
        near.append(other)
        if len(near) > self.config.most(layer):
            closest = sorted(zip(self._distances(self.vectors[node], near), near, strict=True))
            self.links[node][layer] = [n for _, n in closest[: self.config.most(layer)]]

    def search(self, q: np.ndarray, k: int, width: int) -> list[tuple[float, int]]:
        at = self.entry
        for layer in range(len(self.links[at]) - 1, 0, -1):
            at = self._descend(q, at, layer)
        return self._beam(q, at, max(width, k), 0)[:k]

    def packed(self, ids: np.ndarray) -> pa.RecordBatch:
        levels = np.array([len(x) for x in self.links], np.int32)
        lists = [near for node in self.links for near in node]
        sizes = np.array([len(x) for x in lists], np.int32)
        flat = np.array([n for x in lists for n in x], np.int32)
        parts = (ids.astype(np.int64), self.vectors.astype(np.float64), levels, sizes, flat)
        return pa.RecordBatch.from_arrays([pa.array([p.tobytes()], pa.binary()) for p in parts] + [pa.array([self.entry], pa.int32())], ["ids", "vectors", "levels", "sizes", "links", "entry"])

    @classmethod
    def unpacked(cls, config: GraphConfig, row: dict) -> tuple[np.ndarray, Graph]:
        ids = np.frombuffer(row["ids"], np.int64)
        g = cls(config, np.frombuffer(row["vectors"], np.float64).reshape(len(ids), -1))
        ends = np.cumsum(np.frombuffer(row["sizes"], np.int32))
        lists = iter([x.tolist() for x in np.split(np.frombuffer(row["links"], np.int32), ends[:-1])])
        g.links = [[next(lists) for _ in range(n)] for n in np.frombuffer(row["levels"], np.int32).tolist()]
        g.entry = row["entry"]
        return ids, g


def build_graphs(points: DataFrame, config: GraphConfig = GraphConfig(), path: str | None = None) -> DataFrame:
    """Writes the graphs of points(id, vector, ...) to the shared folder, one shard a row and file, and reads them back."""
    spark = points.sparkSession

    def shard(ids: list[np.ndarray], rows: list[np.ndarray]) -> pa.RecordBatch:
        return Graph.built(config, np.concatenate(rows)).packed(np.concatenate(ids))

    def build(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        ids, rows, n = [], [], 0
        for b in batches:
            at = 0
            while at < b.num_rows:
                part = b.slice(at, config.shard_rows - n)
                ids.append(part.column(0).to_numpy(zero_copy_only=False))
                rows.append(matrix(part.column(1)))
                at, n = at + part.num_rows, n + part.num_rows
                if n == config.shard_rows:
                    yield shard(ids, rows)
                    ids, rows, n = [], [], 0
        if n:
            yield shard(ids, rows)

    path = path or scratch(spark)
    points.where("vector is not null").select("id", "vector").mapInArrow(build, SHARD).write.option("maxRecordsPerFile", 1).parquet(path)
    return spark.read.schema(SHARD).parquet(path)


def graph_topk(graphs: DataFrame, queries: DataFrame, k: int, config: GraphConfig = GraphConfig(), ef_search: int | None = None, block: int = 1024) -> DataFrame:
    """As exact_topk, by a walk of each shard's graph; a wider beam finds more."""
    spark, width = graphs.sparkSession, ef_search or config.ef_search

    def walk(sent):
        def scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            names, vectors = sent.value
            for b in batches:
                for row in range(b.num_rows):
                    ids, g = Graph.unpacked(config, b.slice(row, 1).to_pylist()[0])
                    hits = [(q, int(ids[n]), d) for q, v in zip(names.tolist(), vectors, strict=True) for d, n in g.search(v, k, width)]
                    yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*hits, strict=True), (pa.int64(), pa.int64(), pa.float64()), strict=True)], ["query_id", "id", "distance"])

        return scan

    blocks = ((names, _unit(vectors)) for names, vectors in query_blocks(queries, block))
    return nearest(in_blocks(spark, blocks, lambda sent: graphs.mapInArrow(walk(sent), HITS)), k)


class GraphIndex:
    """Graphs of all points inserted so far: each insert gets shards of its own, and ``fanout`` inserts of one size class are built anew together."""

    def __init__(self, spark: SparkSession, config: GraphConfig = GraphConfig(), fanout: int = 4):
        self.spark, self.config, self.fanout = spark, config, fanout
        self.parts: list[tuple[int, DataFrame, DataFrame]] = []  # points, their rows, their graphs

    def add(self, points: DataFrame) -> GraphIndex:
        rows = points.where("vector is not null").select("id", "vector")
        path = scratch(self.spark)
        rows.write.parquet(path)
        self._build(self.spark.read.schema(rows.schema).parquet(path))
        tier = lambda p: int(math.log(max(1, p[0]), self.fanout))
        while len(same := [p for p in self.parts if tier(p) == min(map(tier, self.parts))]) >= self.fanout:
            self.parts = [p for p in self.parts if p not in same]
            self._build(functools.reduce(DataFrame.unionByName, (p[1] for p in same)))
        return self

    def _build(self, rows: DataFrame) -> None:
        n = rows.count()
        if n:
            dealt = rows.repartition(-(-n // self.config.shard_rows))
            self.parts.append((n, rows, build_graphs(dealt, self.config)))

    def search(self, queries: DataFrame, k: int, ef: int | None = None) -> DataFrame:
        graphs = functools.reduce(DataFrame.unionByName, (p[2] for p in self.parts), self.spark.createDataFrame([], SHARD))
        return graph_topk(graphs, queries, k, self.config, ef)

    def save(self, path: str) -> None:
        for i, (n, rows, graphs) in enumerate(self.parts):
            rows.write.parquet(f"{path}/rows-{i}")
            graphs.write.option("maxRecordsPerFile", 1).parquet(f"{path}/graphs-{i}")
        facts = json.dumps({"config": vars(self.config), "fanout": self.fanout, "sizes": [p[0] for p in self.parts]})
        self.spark.createDataFrame([(facts,)], "value string").coalesce(1).write.text(f"{path}/facts")

    @classmethod
    def load(cls, spark: SparkSession, path: str) -> GraphIndex:
        facts = json.loads(spark.read.text(f"{path}/facts").first()[0])
        index = cls(spark, GraphConfig(**facts["config"]), facts["fanout"])
        index.parts = [(n, spark.read.parquet(f"{path}/rows-{i}"), spark.read.schema(SHARD).parquet(f"{path}/graphs-{i}")) for i, n in enumerate(facts["sizes"])]
        return index
