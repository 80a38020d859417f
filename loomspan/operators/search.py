"""Nearest neighbours: exact and by inverted cells, neighbour graphs, recall, and the vector table.

Queries are taken in blocks of ``BLOCK`` (2 MB of 64-d vectors), each broadcast to one scan of the
points; a scan multiplies matrices in Arrow batches and keeps k rows per query and task, so only
those are shuffled. Filters are applied to the points before any distance and reach the scan.
"""

from __future__ import annotations

import json
import uuid
from collections.abc import Iterator
from dataclasses import dataclass, field
from typing import TYPE_CHECKING

import numpy as np
import pyarrow as pa
from pyspark.errors import AnalysisException
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from loomspan.config import EMBED_DIM, ZERO_NORM
from loomspan.functions.filters import matching
from loomspan.functions.vectors import valid_vectors
from loomspan.sources.records import Records
from loomspan.sources.snapshot import scratch

if TYPE_CHECKING:
    from loomspan.operators.cells import CellIndex
    from loomspan.operators.graph import GraphIndex

BLOCK = 4096
#: Distances are taken between so many queries and points at once (4 MB), however many there are of either.
TILE_QUERIES, TILE_POINTS = 256, 2048
#: Pairs of blocks of a neighbour graph are dealt to no more partitions.
MOST_PAIRS = 8192
HITS = "query_id long, id long, distance double"


def matrix(column: pa.Array) -> np.ndarray:
    """Rows of an array column as unit vectors in doubles."""
    flat = column.flatten().to_numpy(zero_copy_only=False).astype(np.float64)
    m = flat.reshape(len(column), -1) if len(column) else flat.reshape(0, 0)
    length = np.sqrt((m * m).sum(1, keepdims=True))
    return m / np.where(length < ZERO_NORM, np.inf, length)


def query_blocks(queries: DataFrame, block: int = BLOCK) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """Ids and vectors of queries(query_id, vector), at most about ``block`` at once. More are first dealt to stored blocks."""
    rows = queries.select("query_id", "vector").where("vector is not null")
    held = rows.limit(block + 1).toArrow()
    if held.num_rows > block:
        number = F.pmod(F.xxhash64(F.monotonically_increasing_id()), F.lit(-(-rows.count() // block)))
        path = scratch(rows.sparkSession)
        rows.withColumn("block", number).write.partitionBy("block").parquet(path)
        stored = rows.sparkSession.read.schema(T.StructType([*rows.schema.fields]).add("block", "long")).parquet(path)
        names = sorted(r.block for r in stored.select("block").distinct().collect())
    else:
        stored, names = None, [0] if held.num_rows else []
    for n in names:
        if stored is not None:
            held = stored.where(F.col("block") == n).toArrow()
        vectors = held["vector"].combine_chunks()
        yield held["query_id"].to_numpy().astype(np.int64), vectors.flatten().to_numpy(zero_copy_only=False).astype(np.float64).reshape(len(vectors), -1)


def in_blocks(spark: SparkSession, blocks: Iterator, search) -> DataFrame:
    """The hits of search(broadcast) for each block's content: lazily for one block; several are appended to one table, and their broadcasts freed."""
    path, held = None, None
    for content in blocks:
        if held is not None:
            path = path or scratch(spark)
            held[0].write.mode("append").parquet(path)
            held[1].destroy()
        sent = spark.sparkContext.broadcast(content)
        held = search(sent), sent
    if held is None:
        return no_hits(spark)
    if path is None:
        return held[0]
    held[0].write.mode("append").parquet(path)
    held[1].destroy()
    return spark.read.schema(HITS).parquet(path)


def no_hits(spark: SparkSession) -> DataFrame:
    """An empty table of hits, made without Python workers."""
    return spark.range(0).select(F.col("id").alias("query_id"), "id", F.lit(0.0).alias("distance"))


def _unit(m: np.ndarray) -> np.ndarray:
    length = np.sqrt((m * m).sum(1, keepdims=True))
    return m / np.where(length < ZERO_NORM, np.inf, length)


def _closest(dist: np.ndarray, near: np.ndarray, d: np.ndarray, ids: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The k best of each row, by distance and then id, among those kept so far, which are in order, and new ones.

    Only what is no farther than a row's k-th distance is sorted, a slice of the rows at a time; of many at just that distance, the k least ids.
    """
    k, dist, near = dist.shape[1], dist.copy(), near.copy()
    for start in range(0, len(dist) if d.shape[1] else 0, 256):
        part, kept, names = d[start : start + 256], dist[start : start + 256], near[start : start + 256]
        row, col = _selected(part, kept[:, k - 1], k, ids)
        if len(row):
            _enter(kept, names, row, part[row, col], ids[col])
    return dist, near


def _selected(part: np.ndarray, limit: np.ndarray, k: int, ids: np.ndarray, error: float = 0.0) -> tuple[np.ndarray, np.ndarray]:
    """Places in rows of distances that are no farther than the row's limit and among its k least, up to an error; of many at just that distance, the k least ids."""
    limit = np.minimum(limit, np.finfo(np.float64).max)
    good = part <= limit[:, None]
    many = np.flatnonzero(np.count_nonzero(good, axis=1) > k)
    if len(many):
        some = part[many]
        limit = np.partition(some, k - 1, axis=1)[:, k - 1 : k]
        good[many] = some <= limit + error
        tied = np.flatnonzero(np.count_nonzero(good[many], axis=1) > 4 * k)
        if len(tied):
            order = np.argsort(ids, kind="stable")
            equal = np.abs(some[np.ix_(tied, order)] - limit[tied]) <= error
            good[np.ix_(many[tied], order)] &= ~(equal & (np.cumsum(equal, axis=1) > k))
    return np.nonzero(good)


def _enter(dist: np.ndarray, near: np.ndarray, row: np.ndarray, far: np.ndarray, name: np.ndarray) -> np.ndarray:
    """Enters points into the k best of rows, which stay in order, in place; gives the rows."""
    changed = np.unique(row)
    old, at = np.nonzero(np.isfinite(dist[changed]))
    old = changed[old]
    far, name, row = np.concatenate((dist[old, at], far)), np.concatenate((near[old, at], name)), np.concatenate((old, row))
    order = np.lexsort((name, far, row))
    row, far, name = row[order], far[order], name[order]
    rank = np.arange(len(row)) - np.searchsorted(row, row)
    keep = rank < dist.shape[1]
    dist[changed], near[changed] = np.inf, np.iinfo(np.int64).max
    dist[row[keep], rank[keep]] = far[keep]
    near[row[keep], rank[keep]] = name[keep]
    return changed


def _keep_closest(dist: np.ndarray, near: np.ndarray, asked: np.ndarray, distances, ids: np.ndarray) -> None:
    """Enters points into the k best of the queries at ``asked``, in place; distances(at) gives those of a tile of the queries."""
    for start in range(0, len(asked), TILE_QUERIES):
        at = asked[start : start + TILE_QUERIES]
        dist[at], near[at] = _closest(dist[at], near[at], distances(at), ids)


def _best(sent, k: int, probe: bool):
    """A scan that keeps the k nearest points of each query of the block."""

    def scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        ids, vectors, cells = sent.value
        dist = np.full((len(ids), k), np.inf)
        near = np.full((len(ids), k), np.iinfo(np.int64).max)

        def distances(at: np.ndarray) -> np.ndarray:
            d = vectors[at] @ m.T
            np.subtract(1.0, d, out=d)
            if probe:
                d[~(cells[at][:, :, None] == cell[None, None, :]).any(1)] = np.inf
            return d

        for b in batches:
            for start in range(0, b.num_rows, TILE_POINTS):
                part = b.slice(start, TILE_POINTS)
                m = matrix(part.column(1))
                cell = part.column(2).to_numpy(zero_copy_only=False) if probe else None
                _keep_closest(dist, near, np.arange(len(ids)), distances, part.column(0).to_numpy(zero_copy_only=False))
        row, col = np.nonzero(np.isfinite(dist))
        if len(row):
            yield pa.RecordBatch.from_arrays([pa.array(ids[row]), pa.array(near[row, col]), pa.array(dist[row, col])], ["query_id", "id", "distance"])

    return scan


def nearest(hits: DataFrame, k: int) -> DataFrame:
    """The k nearest of each query, by distance and then id, with rank from 1."""
    order = Window.partitionBy("query_id").orderBy("distance", "id")
    return hits.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= k)


def exact_topk(points: DataFrame, queries: DataFrame, k: int, conditions=(), block: int = BLOCK) -> DataFrame:
    """(query_id, id, distance, rank) over points(id, vector, ...) for queries(query_id, vector)."""
    rows = matching(points, conditions).select("id", "vector")
    blocks = ((ids, _unit(vectors), None) for ids, vectors in query_blocks(queries, block))
    return nearest(in_blocks(points.sparkSession, blocks, lambda sent: rows.mapInArrow(_best(sent, k, False), HITS)), k)


def centroids(points: DataFrame, by: str) -> DataFrame:
    """(cell, vector): the mean unit vector of each value of a column, one row per cell."""
    item = points.select(F.col(by).alias("cell"), F.posexplode("vector").alias("pos", "x"))
    mean = item.groupBy("cell", "pos").agg(F.avg(F.col("x").cast("double")).alias("x"))
    return mean.groupBy("cell").agg(F.transform(F.array_sort(F.collect_list(F.struct("pos", "x"))), lambda s: s["x"]).alias("vector"))


def train_centroids(points: DataFrame, cells: int, seed: int = 7, rounds: int = 10, sample: int = 20_000) -> DataFrame:
    """(cell, vector): spherical k-means on a bounded sample (at most ``sample`` rows, by hash of id); all points are indexed later."""
    c = trained(points, cells, seed, rounds, sample)
    return points.sparkSession.createDataFrame([(j, v.tolist()) for j, v in enumerate(c)], "cell int, vector array<double>")


def trained(points: DataFrame, cells: int, seed: int = 7, rounds: int = 10, sample: int = 20_000) -> np.ndarray:
    """The vectors of ``train_centroids`` in the driver, one row per cell."""
    rows = points.select("id", "vector").where("vector is not null").orderBy(F.xxhash64("id", F.lit(seed)), "id").limit(sample).collect()
    if not rows:
        return np.zeros((0, 0))
    m = _unit(np.array([r.vector for r in rows], np.float64))
    c = m[: min(cells, len(m))].copy()
    for _ in range(rounds):
        at = (m @ c.T).argmax(1)
        c = _unit(np.array([m[at == j].sum(0) if (at == j).any() else c[j] for j in range(len(c))]))
    return c


def assign_cells(points: DataFrame, cells: DataFrame) -> DataFrame:
    """points with the cell of the nearest centroid; the least cell wins ties."""
    table = sorted((r.cell, r.vector) for r in cells.collect())
    names = np.array([c for c, _ in table], np.int64)
    sent = points.sparkSession.sparkContext.broadcast((names, _unit(np.array([v for _, v in table], np.float64))))

    def assign(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        labels, m = sent.value
        for b in batches:
            at = (matrix(b.column(1)) @ m.T).argmax(1) if b.num_rows else np.zeros(0, np.int64)
            yield pa.RecordBatch.from_arrays([b.column(0), b.column(1), pa.array(labels[at])], ["id", "vector", "cell"])

    kind = points.schema["vector"].dataType.simpleString()
    return points.select("id", "vector").mapInArrow(assign, f"id long, vector {kind}, cell long")


def store_cells(celled: DataFrame, path: str | None = None) -> DataFrame:
    """Writes points with their cells, a folder a cell, and reads them back: a search then opens the folders of its cells only. Large cells go to several tasks."""
    path = path or scratch(celled.sparkSession)
    celled.hint("rebalance", "cell").write.partitionBy("cell").parquet(path)
    return celled.sparkSession.read.schema(celled.schema).parquet(path)


def ivf_topk(cell_points: DataFrame, cells: DataFrame, queries: DataFrame, k: int, nprobe: int, block: int = 1024) -> DataFrame:
    """As exact_topk, among the points of each query's nprobe nearest cells. Stored by cell, others are not read."""
    spark = cell_points.sparkSession
    table = sorted((r.cell, r.vector) for r in cells.collect())
    names, m = np.array([c for c, _ in table], np.int64), _unit(np.array([v for _, v in table], np.float64))

    def probes() -> Iterator[tuple]:
        for ids, vectors in query_blocks(queries, block):
            unit = _unit(vectors)
            yield ids, unit, names[np.lexsort((np.broadcast_to(names, (len(ids), len(names))), -(unit @ m.T)), axis=1)[:, :nprobe]]

    def search(sent) -> DataFrame:
        rows = cell_points.where(F.col("cell").isin([int(c) for c in np.unique(sent.value[2])])).select("id", "vector", "cell")
        return rows.mapInArrow(_best(sent, k, True), HITS)

    return nearest(in_blocks(spark, probes(), search), k)


def least_nprobe(cell_points: DataFrame, cells: DataFrame, queries: DataFrame, k: int, least: float = 0.9) -> int:
    """The fewest probed cells with which ivf_topk reaches this recall on these queries: a stated set, whose k rows a query come to the driver.

    Ids are distinct. A neighbour is found exactly if its cell is probed, so one exact search tells the recall of every number.
    """
    table = sorted((r.cell, r.vector) for r in cells.collect())
    names, m = np.array([c for c, _ in table], np.int64), _unit(np.array([v for _, v in table], np.float64))
    rows = exact_topk(cell_points, queries, k).join(cell_points.select("id", "cell"), "id").select("query_id", "cell").collect()
    place = {}
    for ids, vectors in query_blocks(queries):
        order = np.lexsort((np.broadcast_to(names, (len(ids), len(names))), -(_unit(vectors) @ m.T)), axis=1)
        place |= dict(zip(ids.tolist(), order.argsort(1), strict=True))
    at = np.searchsorted(names, [c for _, c in rows])
    hits = np.bincount([place[q][j] for (q, _), j in zip(rows, at, strict=True)], minlength=len(names)).cumsum()
    return int((hits < least * len(rows)).sum()) + 1 if len(rows) else len(names)


def pair_distances(x: np.ndarray, i: np.ndarray, j: np.ndarray) -> np.ndarray:
    """Distances of the unit vectors at i from those at j. They depend on the two vectors only, so copies have one distance, wherever they are compared."""
    out = np.empty(len(i))
    for start in range(0, len(i), 16384):
        part = slice(start, start + 16384)
        out[part] = 1.0 - np.einsum("ij,ij->i", x[i[part]], x[j[part]])
    return out


def _places(mask: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """np.nonzero of a matrix that is true in few places, eight at a time."""
    flat = mask.reshape(-1)
    if len(flat) % 8 == 0:
        word = np.flatnonzero(flat.view(np.uint64))
        at, byte = np.nonzero(flat.reshape(-1, 8)[word])
        found = word[at] * 8 + byte
    else:
        found = np.flatnonzero(flat)
    return np.divmod(found, mask.shape[1])


def closest_pairs(ids: np.ndarray, vectors: np.ndarray, sides: list[slice], k: int, reach: np.ndarray | None = None, tile: int = 1024) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(row, id, distance): the k nearest of each row of unit vectors in the other side, or in its own if there is one side; exactly.

    Each tile of similarities is taken once, in floats, for both its sides. What may be among a row's k nearest by these, allowing for their
    error, gets its distance in doubles. Of rows with a reach only what is no farther is wanted. Rows of one id are no neighbours.
    """
    dist, near = np.full((len(ids), k), np.inf), np.full((len(ids), k), np.iinfo(np.int64).max)
    limit = np.full(len(ids), np.inf) if reach is None else reach.astype(np.float64)
    slack = 1e-6 + vectors.shape[1] * 2.0**-23  # the error of a product in floats is at most half of it
    floats, floor = vectors.astype(np.float32), (1.0 - limit - slack).astype(np.float32)
    held: list[tuple[np.ndarray, np.ndarray]] = []

    def enter() -> None:
        row, col = (np.concatenate(c) for c in zip(*held, strict=True))
        held.clear()
        other = ids[row] != ids[col]
        row, col = row[other], col[other]
        far = pair_distances(vectors, row, col)
        good = far <= limit[row]
        if good.any():
            changed = _enter(dist, near, row[good], far[good], ids[col[good]])
            limit[changed] = np.minimum(limit[changed], dist[changed, k - 1])
            floor[changed] = 1.0 - limit[changed] - slack

    def add(x: slice, y: slice, mask: np.ndarray, flipped: bool) -> None:
        found = np.count_nonzero(mask)
        if found > (x.stop - x.start) * max(4 * k, (y.stop - y.start) // 32):  # at the start, or many copies
            for start in range(x.start, x.stop, TILE_QUERIES):
                at = slice(start, min(start + TILE_QUERIES, x.stop))
                d = 1.0 - vectors[at] @ vectors[y].T
                d[ids[at][:, None] == ids[y]] = np.inf
                row, col = _selected(d, limit[at] + slack, k, ids[y], vectors.shape[1] * 2.0**-52)
                held.append((start + row, y.start + col))
        elif found:
            row, col = _places(mask)
            held.append((x.start + col, y.start + row) if flipped else (x.start + row, y.start + col))
        if sum(len(r) for r, _ in held) > 4 * k * tile or (found and not np.isfinite(limit[x]).all()):
            enter()

    tiles = [[slice(j, min(j + tile, side.stop)) for j in range(side.start, side.stop, tile)] for side in sides]
    pairs = [(x, y) for x in tiles[0] for y in tiles[1]] if len(sides) == 2 else [(x, y) for j, x in enumerate(tiles[0]) for y in tiles[0][j:]]
    for x, y in pairs:
        s = floats[x] @ floats[y].T
        add(x, y, s >= floor[x, None], False)
        if x is not y:
            add(y, x, s >= floor[y], True)
    if held:
        enter()
    row, col = np.nonzero(np.isfinite(dist))
    return row, near[row, col], dist[row, col]


def _compare_own(m: int):
    """The rows of a block with the m nearest of each in it, and how far these reach."""

    def compare(rows: pa.Table) -> pa.Table:
        rows = rows.combine_chunks()
        row, near, dist = closest_pairs(rows["id"].to_numpy(), matrix(rows["vector"].combine_chunks()), [slice(0, rows.num_rows)], m)
        ends = np.searchsorted(row, np.arange(rows.num_rows + 1))
        reach = np.full(rows.num_rows, np.inf)
        full = np.diff(ends) == m
        reach[full] = dist[ends[1:][full] - 1]
        lists = [pa.ListArray.from_arrays(pa.array(ends, pa.int32()), pa.array(x)) for x in (near, dist)]
        return pa.table([rows["id"], rows["vector"], rows["block"], pa.array(reach), *lists], ["id", "vector", "block", "reach", "dst", "distance"])

    return compare


def _compare_blocks(m: int):
    """For the rows of two blocks: the m nearest of each row in the other block, none beyond its reach."""

    def compare(rows: pa.Table) -> pa.Table:
        second = rows["block"].to_numpy() == rows["high"][0].as_py()
        rows = rows.take(pa.array(np.argsort(second, kind="stable")))
        cut = rows.num_rows - int(second.sum())
        ids, vectors, reach = rows["id"].to_numpy(), matrix(rows["vector"].combine_chunks()), rows["reach"].to_numpy()
        row, near, dist = closest_pairs(ids, vectors, [slice(0, cut), slice(cut, len(ids))], m, reach)
        return pa.table([ids[row], near, dist], ["src", "dst", "distance"])

    return compare


def neighbour_graph(points: DataFrame, m: int, block_bytes: int = 8 << 20) -> DataFrame:
    """(src, dst, distance, rank): the m nearest others of every point, exactly.

    Points are dealt to stored blocks of about ``block_bytes``. Each block is compared within itself first, so it is known how far a point's
    nearest can be; then each pair of blocks is compared once, in one task, for both
    its sides, so no vector passes through the driver. There is a partition for every pair (up to ``MOST_PAIRS``), so a task's work and
    memory are those of a few pairs, whatever the points. A point goes to as many tasks as there are blocks: work
    and shuffle grow with the square of the points, for which ``descended_graph`` is the other way. Rows of one id are no
    neighbours of each other; points without a vector take no part; an empty table gives an empty result.
    """
    spark = points.sparkSession
    rows = points.where("vector is not null").select(F.col("id").cast("long").alias("id"), "vector")
    size = rows.agg(F.count("*").alias("n"), F.max(F.size("vector")).alias("dims")).first()
    if not size.n:
        return spark.createDataFrame([], "src long, dst long, distance double, rank int")
    # Small tables are cut further, so that there is a pair for every core.
    blocks = max(-(-size.n * size.dims * 8 // block_bytes), min(-(-size.n // 1024), int((2 * spark.sparkContext.defaultParallelism) ** 0.5)))
    own = rows.withColumn("block", F.pmod(F.xxhash64(F.monotonically_increasing_id()), F.lit(blocks)).cast("int")).repartitionById(blocks, "block")
    kind = rows.schema["vector"].dataType.simpleString()
    own = own.groupBy("block").applyInArrow(_compare_own(m), f"id long, vector {kind}, block int, reach double, dst array<long>, distance array<double>")
    path = scratch(spark)
    own.write.parquet(path)
    own = spark.read.schema(own.schema).parquet(path)
    near = own.select(F.col("id").alias("src"), F.explode(F.arrays_zip("dst", "distance")).alias("x")).select("src", "x.dst", "x.distance")
    if blocks > 1:
        dealt = own.select("id", "vector", "reach", "block", F.explode(F.sequence(F.lit(0), F.lit(blocks - 1))).alias("other")).where("block <> other")
        dealt = dealt.select("id", "vector", "reach", "block", F.least("block", "other").cast("long").alias("low"), F.greatest("block", "other").cast("long").alias("high"))
        parts = min(blocks * (blocks - 1) // 2, MOST_PAIRS)
        number = (F.col("low") * blocks - F.shiftright(F.col("low") * (F.col("low") + 1), 1) + F.col("high") - F.col("low") - 1) % parts
        dealt = dealt.withColumn("part", number.cast("int")).repartitionById(parts, "part")  # a hash would deal several pairs to one partition
        near = near.unionByName(dealt.groupBy("part", "low", "high").applyInArrow(_compare_blocks(m), "src long, dst long, distance double"))
    order = Window.partitionBy("src").orderBy("distance", "dst")
    return near.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= m).select("src", "dst", "distance", "rank")


def prune_graph(edges: DataFrame, most: int) -> DataFrame:
    """Edges in both directions, of which each point keeps the ``most`` nearest."""
    both = edges.select("src", "dst", "distance").unionByName(edges.select(F.col("dst").alias("src"), F.col("src").alias("dst"), "distance")).groupBy("src", "dst").agg(F.min("distance").alias("distance"))
    order = Window.partitionBy("src").orderBy("distance", "dst")
    return both.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= most)


def recall(found: DataFrame, exact: DataFrame) -> DataFrame:
    """One row: hits of found that are in exact, all of exact, and their ratio."""
    hits = exact.join(found.select("query_id", "id").withColumn("hit", F.lit(1)), ["query_id", "id"], "left")
    return hits.agg(F.count("hit").alias("n_hit"), F.count("*").alias("n_exact")).withColumn("recall", F.col("n_hit") / F.col("n_exact"))


@dataclass
class VectorTable:
    """Points in Parquet: create, insert, search, save, load and info, as a vector store has them.

    Indexes are built on request and follow later inserts. A snapshot is a folder of versions with a manifest
    that gets a row once a version is written whole; older versions stay as they are.
    """

    spark: SparkSession
    dim: int = EMBED_DIM
    points: DataFrame | None = None
    read_only: bool = False
    cells: CellIndex | None = None
    graphs: GraphIndex | None = None
    records: Records | None = field(default=None, repr=False)

    def insert(self, rows: DataFrame, strict: bool = True) -> VectorTable:
        """Adds points (id, vector, payload columns), to the indexes as well. Ids may repeat: all stay searchable, ``get`` sees the last insert.

        An index whose columns the new points do not have, or lack, goes and is to be built again.
        """
        if self.read_only:
            raise PermissionError("a loaded snapshot is read-only")
        seq = 0 if self.points is None else self.points.agg(F.max("seq")).first()[0]
        seq = 0 if seq is None else seq + 1
        rows = valid_vectors(rows, "vector", self.dim, strict).withColumn("seq", F.lit(seq))
        self.points = rows if self.points is None else self.points.unionByName(rows, allowMissingColumns=True)
        self.records = None
        if self.cells is not None:
            same = {f.name: f.dataType for f in self.cells.schema} == {f.name: f.dataType for f in rows.schema}
            self.cells = self.cells.add(rows) if same else None
        if self.graphs is not None:
            self.graphs.add(rows)
        return self

    def build_index(self, cells: int) -> VectorTable:
        from loomspan.operators.cells import CellIndex

        self.cells = CellIndex.build(self.points, cells)
        return self

    def build_graph(self, config=None) -> VectorTable:
        from loomspan.operators.graph import GraphConfig, GraphIndex

        self.graphs = GraphIndex(self.spark, config or GraphConfig()).add(self.points)
        return self

    def least_nprobe(self, queries: DataFrame, k: int, least: float = 0.9) -> int:
        centres = [(j, v) for j, v in enumerate(self.cells.centres.tolist())]
        celled = self.cells.points().withColumnRenamed(self.cells.cell, "cell")
        return least_nprobe(celled, self.spark.createDataFrame(centres, "cell int, vector array<double>"), queries, k, least)

    def search(self, queries: DataFrame, k: int, conditions=(), nprobe: int | None = None, ef: int | None = None) -> DataFrame:
        """Exact, by the cells that can matter if there is an index, else by a scan. nprobe asks for so many cells only, ef (the width of the beam) for the graphs, which know no conditions."""
        if self.points is None or self.points.isEmpty():
            raise ValueError("the collection is empty")
        if ef is not None and self.graphs is not None and not conditions:
            return self.graphs.search(queries, k, ef)
        if self.cells is not None:
            return self.cells.search(queries, k, conditions, nprobe)
        return exact_topk(self.points, queries, k, conditions)

    def get(self, point_id: int) -> list[float]:
        """The vector of the last insert of an id; of a loaded table only files are read that may hold the id."""
        rows = self.points if self.records is None else self.records.find([point_id])
        row = rows.where(F.col("id") == point_id).agg(F.max_by("vector", "seq")).first()[0]
        if row is None:
            raise KeyError(f"no point {point_id}")
        return row

    def info(self) -> dict[str, int]:
        return {"count": 0 if self.points is None else self.points.count(), "dim": self.dim}

    def save(self, path: str, meta: dict | None = None) -> int:
        """Writes points and indexes as a new version, and last a row of the manifest; gives the version's number."""
        if self.read_only:
            raise PermissionError("a loaded snapshot is read-only")
        held = _manifest(self.spark, path)
        number, folder = 1 + max((m["number"] for m in held), default=0), f"{path}/version-{uuid.uuid4().hex}"
        Records.write(self.points, f"{folder}/points")
        for name in ("cells", "graphs"):
            if getattr(self, name) is not None:
                getattr(self, name).save(f"{folder}/{name}")
        facts = {"version": 2, "dim": self.dim, "cells": self.cells is not None, "graphs": self.graphs is not None}
        line = json.dumps(facts | (meta or {}) | {"number": number, "folder": folder.rpartition("/")[2]}, sort_keys=True)
        self.spark.createDataFrame([(line,)], "value string").coalesce(1).write.mode("append").text(f"{path}/manifest")
        return number

    @classmethod
    def load(cls, spark: SparkSession, path: str, number: int | None = None) -> VectorTable:
        """The latest version of a snapshot, or a stated one, with its indexes. Snapshots without a manifest have points alone."""
        held = _manifest(spark, path)
        if not held:
            meta = json.loads(spark.read.text(f"{path}/meta").first()[0])
            folder = path
        else:
            wanted = [m for m in held if number in (None, m["number"])]
            if not wanted:
                raise ValueError(f"no version {number}")
            meta = max(wanted, key=lambda m: (m["number"], m["folder"]))
            folder = f"{path}/{meta['folder']}"
        if meta["version"] not in (1, 2):
            raise ValueError(f"unknown snapshot version {meta['version']}")
        out = cls(spark, meta["dim"], spark.read.parquet(f"{folder}/points"), read_only=meta["version"] == 2)
        if held:
            out.records = Records(spark, f"{folder}/points")
        if meta.get("cells"):
            from loomspan.operators.cells import CellIndex

            out.cells = CellIndex.load(spark, f"{folder}/cells")
        if meta.get("graphs"):
            from loomspan.operators.graph import GraphIndex

            out.graphs = GraphIndex.load(spark, f"{folder}/graphs")
        return out


def _manifest(spark: SparkSession, path: str) -> list[dict]:
    try:
        return [json.loads(r.value) for r in spark.read.text(f"{path}/manifest").collect()]
    except AnalysisException as e:
        if e.getCondition() != "PATH_NOT_FOUND":
            raise
        return []
