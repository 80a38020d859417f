"""Points stored by cell: exact search that opens only cells that can improve a result, and inserts beside what is stored.

Each cell has a centre; a point lies in the cell of the centre nearest to it. Of a cell the index knows how far from the centre its
points lie (least and most) and, for payload columns, their least and greatest value and, if there are few, all
values. Between unit vectors the chord obeys the triangle inequality, so no point of a cell is closer to a query
than the centre's distance less the most, or the least less the centre's distance. Cells whose values fail a condition are left out at
once; the others are opened in the order of that bound, in rounds of four times as many, until no bound is within the
k-th distance found. The result is the exact one.

Inserted points become a part of their own, with the same centres. When ``fanout`` parts of one size class have come
together they are written as one part of the next; searches cover all parts. The driver holds the centres and
one row of bounds a part and cell: at most a few thousand rows a part.
"""

from __future__ import annotations

import functools
import json
import math
from collections.abc import Iterator
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from loomspan.functions.filters import AtLeast, AtMost, Between, Equals, _kind, matching
from loomspan.operators.search import HITS, TILE_POINTS, _keep_closest, _unit, matrix, nearest, no_hits, query_blocks, trained
from loomspan.operators.segment import fresh
from loomspan.sources.snapshot import scratch

#: Distances of doubles are told apart down to this.
SLACK = 1e-9
#: A cell's values of a column are listed if there are no more.
VALUES = 32


@dataclass
class Bounds:
    """What is known of the points of one cell in one part."""

    n: int
    least: float
    most: float
    size: int
    ranges: dict[str, list] = field(default_factory=dict)
    values: dict[str, list] = field(default_factory=dict)

    def may_meet(self, c) -> bool:
        """Whether some point of the cell may meet a condition, as far as is known of its column."""
        if c.key not in self.ranges:
            return True
        low, high = self.ranges[c.key]
        if low is None or _kind(low) != (_kind(c.value) if isinstance(c, Equals) else "number"):
            return False
        if isinstance(c, Equals):
            return c.value != c.value or (c.value in self.values[c.key] if c.key in self.values else low <= c.value <= high)
        least = c.least if isinstance(c, (AtLeast, Between)) else -math.inf
        most = c.most if isinstance(c, (AtMost, Between)) else math.inf
        return high >= least and low <= most


def _ordered(v):
    """Not a number counts as the greatest, as Spark has it."""
    return math.inf if isinstance(v, float) and math.isnan(v) else v


@dataclass
class Part:
    path: str
    n: int
    cells: dict[int, Bounds]
    rows: DataFrame | None = None


@dataclass
class Visit:
    """What one round of a search has opened."""

    cells: int
    rows: int
    size: int


def _place(rows: DataFrame, centres: np.ndarray, cell: str, reach: str) -> DataFrame:
    """rows with the cell of the nearest centre, the least of equal ones, and the chord to it."""
    sent = rows.sparkSession.sparkContext.broadcast(centres)
    at = rows.columns.index("vector")

    def place(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        c = sent.value
        for b in batches:
            near, chord = np.zeros(b.num_rows, np.int64), np.zeros(b.num_rows)
            for start in range(0, b.num_rows, TILE_POINTS):
                m, tile = matrix(b.column(at).slice(start, TILE_POINTS)), slice(start, start + TILE_POINTS)
                near[tile] = (m @ c.T).argmax(1)
                chord[tile] = np.sqrt(((m - c[near[tile]]) ** 2).sum(1))
            yield pa.RecordBatch.from_arrays([*b.columns, pa.array(near, pa.int64()), pa.array(chord, pa.float64())], [*b.schema.names, cell, reach])

    return rows.mapInArrow(place, T.StructType([*rows.schema.fields]).add(cell, "long").add(reach, "double"))


def _best_by_cell(sent, k: int):
    """A scan of (id, vector, cell) that keeps the k nearest for the queries that look into a cell, within what they have already."""

    def scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        ids, vectors, who, limit = sent.value
        dist = np.full((len(ids), k), np.inf)
        near = np.full((len(ids), k), np.iinfo(np.int64).max)

        def distances(at: np.ndarray) -> np.ndarray:
            d = vectors[at] @ inside.T
            np.subtract(1.0, d, out=d)
            d[d > limit[at, None] + SLACK] = np.inf
            return d

        for b in batches:
            for start in range(0, b.num_rows, TILE_POINTS):
                part = b.slice(start, TILE_POINTS)
                m, names, cell = matrix(part.column(1)), part.column(0).to_numpy(zero_copy_only=False), part.column(2).to_numpy(zero_copy_only=False)
                for c in np.unique(cell).tolist():
                    asked, rows = who.get(c), cell == c
                    if asked is None:
                        continue
                    inside = m[rows]
                    _keep_closest(dist, near, asked, distances, names[rows])
        row, col = np.nonzero(np.isfinite(dist))
        if len(row):
            yield pa.RecordBatch.from_arrays([pa.array(ids[row]), pa.array(near[row, col]), pa.array(dist[row, col])], ["query_id", "id", "distance"])

    return scan


class CellIndex:
    """points(id, vector, payload columns) by cell. ``visits`` tells what the last search has opened."""

    def __init__(self, spark: SparkSession, centres: np.ndarray, schema: T.StructType, cell: str, reach: str, root: str | None = None, fanout: int = 4):
        self.spark, self.centres, self.schema, self.cell, self.reach, self.root, self.fanout = spark, centres, schema, cell, reach, root or scratch(spark), fanout
        self.parts: list[Part] = []
        self.visits: list[Visit] = []
        self.written = 0

    @classmethod
    def build(cls, points: DataFrame, cells: int = 64, centres: DataFrame | None = None, root: str | None = None, fanout: int = 4) -> CellIndex:
        """centres(cell, vector): by default trained on a bounded sample; all points are indexed."""
        found = trained(points, cells) if centres is None else np.array([v for _, v in sorted((r.cell, r.vector) for r in centres.collect())], float)
        cell, reach = fresh("cell", points), fresh("reach", points)
        index = cls(points.sparkSession, _unit(found) if len(found) else np.zeros((0, 0)), points.schema, cell, reach, root, fanout)
        return index.add(points)

    def add(self, points: DataFrame) -> CellIndex:
        """Inserts points of the same columns as a part of their own, then merges parts that have come together."""
        if not len(self.centres):
            found = trained(points, 64)
            self.centres = _unit(found) if len(found) else self.centres
        rows = points.select([c.name for c in self.schema]).where("vector is not null")
        if len(self.centres):
            self._store(_place(rows, self.centres, self.cell, self.reach))
        tier = lambda p: int(math.log(max(1, p.n), self.fanout))
        while len(same := [p for p in self.parts if tier(p) == min(map(tier, self.parts))]) >= self.fanout:
            merged = self._read(same[0], same[0].cells)
            for p in same[1:]:
                merged = merged.unionByName(self._read(p, p.cells))
            self._store(merged)
            self.parts = [p for p in self.parts if p not in same]
        return self

    def _store(self, placed: DataFrame) -> None:
        path = f"{self.root}/part-{self.written}"
        placed.hint("rebalance", self.cell).sortWithinPartitions(self.cell, self.reach).write.partitionBy(self.cell).parquet(path)
        self.written += 1
        part = Part(path, 0, {})
        part.cells = self._bounds(self.spark.read.schema(placed.schema).parquet(path))
        part.n = sum(b.n for b in part.cells.values())
        if part.n:
            self.parts.append(part)

    def _bounds(self, stored: DataFrame) -> dict[int, Bounds]:
        kinds = {f.name: f.dataType for f in self.schema if f.name not in ("id", "vector") and isinstance(f.dataType, (T.NumericType, T.StringType, T.BooleanType)) and not isinstance(f.dataType, T.DecimalType)}
        sides = [side(c).alias(f"{name}_{i}") for i, c in enumerate(kinds) for name, side in (("low", F.min), ("high", F.max))]
        rows = stored.groupBy(self.cell).agg(F.count("*").alias("n"), F.min(self.reach).alias("least"), F.max(self.reach).alias("most"), *sides).collect()
        files = stored.select(F.col(self.cell).alias("cell"), F.col("_metadata.file_path").alias("f"), F.col("_metadata.file_size").alias("size")).distinct()
        sizes = {r.cell: r.size for r in files.groupBy("cell").agg(F.sum("size").alias("size")).collect()}
        out = {r[self.cell]: Bounds(r.n, r.least, r.most, sizes[r[self.cell]], {c: [_ordered(r[f"low_{i}"]), _ordered(r[f"high_{i}"])] for i, c in enumerate(kinds)}) for r in rows}
        for c in kinds:
            some = stored.select(F.col(self.cell).alias("cell"), F.col(c).alias("v")).where("v is not null").distinct()
            first = some.withColumn("at", F.row_number().over(Window.partitionBy("cell").orderBy("v"))).where(f"at <= {VALUES + 1}")
            for r in first.groupBy("cell").agg(F.collect_list("v").alias("vs")).where(f"size(vs) <= {VALUES}").collect():
                if all(v == v for v in r.vs):
                    out[r.cell].values[c] = r.vs
        return out

    def _read(self, part: Part, cells) -> DataFrame:
        """The points of some cells of a part, whose folders are listed once; other folders are not opened."""
        if part.rows is None:
            schema = T.StructType([*self.schema.fields]).add(self.reach, "double").add(self.cell, "long")
            part.rows = self.spark.read.schema(schema).parquet(part.path)
        return part.rows if len(cells) == len(part.cells) else part.rows.where(F.col(self.cell).isin(sorted(map(int, cells))))

    def points(self) -> DataFrame:
        """All stored points, with their cells."""
        out = self.spark.createDataFrame([], T.StructType([*self.schema.fields]).add(self.reach, "double").add(self.cell, "long"))
        for p in self.parts:
            out = out.unionByName(self._read(p, p.cells))
        return out

    def search(self, queries: DataFrame, k: int, conditions=(), nprobe: int | None = None, block: int = 1024) -> DataFrame:
        """(query_id, id, distance, rank) of the k nearest that meet all conditions: all cells that can matter, or the nprobe nearest cells only."""
        self.visits = []
        found = [hits for ids, vectors in query_blocks(queries, block) for hits in self._rounds(ids, _unit(vectors), k, conditions, nprobe)]
        return nearest(functools.reduce(DataFrame.unionByName, found) if found else no_hits(self.spark), k)

    def _rounds(self, ids: np.ndarray, q: np.ndarray, k: int, conditions, nprobe: int | None) -> Iterator[DataFrame]:
        places = [(p, c) for p in self.parts for c in sorted(p.cells) if all(p.cells[c].may_meet(x) for x in conditions)]
        if not places:
            return
        cell = np.array([c for _, c in places])
        near = q @ self.centres.T
        # Zero vectors are at distance 1 from all; chords of at most that are bounds for them as well.
        chord = np.sqrt(np.maximum(0, (q * q).sum(1)[:, None] + (self.centres**2).sum(1) - 2 * near))
        low, high = (np.array([getattr(p.cells[c], name) for p, c in places]) for name in ("least", "most"))
        bound = np.maximum(0, np.maximum(chord[:, cell] - high, low - chord[:, cell])) ** 2 / 2 - SLACK
        if nprobe is not None:
            known = np.unique(cell)
            chosen = known[np.lexsort((np.broadcast_to(known, (len(q), len(known))), -near[:, known]), axis=1)[:, :nprobe]]
            yield self._open(places, (cell[None, :, None] == chosen[:, None, :]).any(2), ids, q, np.full(len(q), np.inf), k, conditions)
            return
        order = np.lexsort((np.broadcast_to(chord[:, cell], bound.shape), bound), axis=1)
        limit, left, hits, take = np.full(len(q), np.inf), np.ones(bound.shape, bool), [], 4
        while (left := left & (bound <= limit[:, None])).any():
            now = np.zeros(bound.shape, bool)
            ahead = np.take_along_axis(left, order, 1)
            first = ahead & (np.cumsum(ahead, 1) <= take)
            np.put_along_axis(now, order, first, 1)
            hits.append(self._open(places, now, ids, q, limit, k, conditions))
            left, take = left & ~now, take * 4
            if left.any():
                best = hits[0]
                for h in hits[1:]:
                    best = best.unionByName(h)
                full = nearest(best, k).groupBy("query_id").agg(F.max("distance").alias("d"), F.count("*").alias("n")).where(f"n = {k}").collect()
                known = {r.query_id: r.d for r in full}
                limit = np.array([known.get(i, np.inf) for i in ids.tolist()])
        yield from hits

    def _open(self, places: list, now: np.ndarray, ids: np.ndarray, q: np.ndarray, limit: np.ndarray, k: int, conditions) -> DataFrame:
        """The hits in the cells that each query looks into, stored."""
        out = []
        used = np.flatnonzero(now.any(0))
        self.visits.append(Visit(len(used), *(sum(getattr(places[j][0].cells[places[j][1]], a) for j in used) for a in ("n", "size"))))
        sent = []
        for p in {id(places[j][0]): places[j][0] for j in used}.values():
            who = {places[j][1]: np.flatnonzero(now[:, j]) for j in used if places[j][0] is p}
            sent.append(self.spark.sparkContext.broadcast((ids, q, who, limit)))
            rows = matching(self._read(p, who), conditions).select("id", "vector", self.cell)
            out.append(rows.mapInArrow(_best_by_cell(sent[-1], k), HITS))
        path = scratch(self.spark)
        nearest(functools.reduce(DataFrame.unionByName, out) if out else no_hits(self.spark), k).drop("rank").write.parquet(path)
        for s in sent:
            s.destroy()
        return self.spark.read.schema(HITS).parquet(path)

    def save(self, path: str) -> None:
        """A copy of all parts, with their bounds and centres, under a new path."""
        facts = {"centres": self.centres.tolist(), "schema": self.schema.json(), "cell": self.cell, "reach": self.reach, "fanout": self.fanout, "written": len(self.parts)}
        lines = [json.dumps(facts)]
        for i, p in enumerate(self.parts):
            self._read(p, p.cells).write.partitionBy(self.cell).parquet(f"{path}/part-{i}")
            lines += [json.dumps([i, c, vars(b)]) for c, b in p.cells.items()]
        self.spark.createDataFrame([(i, x) for i, x in enumerate(lines)], "i long, value string").coalesce(1).sortWithinPartitions("i").write.parquet(f"{path}/bounds")

    @classmethod
    def load(cls, spark: SparkSession, path: str) -> CellIndex:
        head, *lines = (json.loads(r.value) for r in spark.read.parquet(f"{path}/bounds").orderBy("i").collect())
        index = cls(spark, np.array(head["centres"], float), T.StructType.fromJson(json.loads(head["schema"])), head["cell"], head["reach"], None, head["fanout"])
        index.parts = [Part(f"{path}/part-{i}", 0, {}) for i in range(head["written"])]
        for i, c, facts in lines:
            index.parts[i].cells[c] = Bounds(**facts)
            index.parts[i].n += facts["n"]
        return index
