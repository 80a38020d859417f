"""Whitening of embeddings through a one-sided Jacobi SVD of the R factor of all centred rows.

The fit list holds each distinct vector of whole numbers once. Its counts and sums are exact; rows are centred as (n x - S) / n.
Tasks compress their centred rows block by block to an upper triangle R (a QR of the triangle so far and
the next block), triangles of up to ``fanout`` tasks are compressed to one until few are left, and the driver compresses
the last ones: at most ``fanout`` triangles of dims x dims numbers, whatever the input. No covariance is formed on the way,
so small standard deviations keep their digits. Plane rotations then make the columns of R orthogonal; their
product has the components as columns, and the lengths of R's columns are the standard deviations times sqrt(n).

Defined results: vectors null or holding null or non-finite entries take no part; of the others only those of the commonest length
do (of two as common the longer one), as the rest have no entry for some dimension; repeated rows are all
reported and count once in the fit; a component without variance (to double precision) has explained 0 and whitened null, and
identity_error leaves it out; a deviation beyond a long is null; numbers are held
within 2^62; an empty table gives an empty result.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from loomspan.llm._common import column, stored
from loomspan.llm.impact_topk import usable

_LONG = 1 << 63


def rotations(columns: np.ndarray, sweeps: int = 60) -> tuple[np.ndarray, np.ndarray]:
    """One-sided Jacobi: rotates pairs of columns until all are orthogonal to double precision. Gives the columns and the product of the rotations.

    A sweep takes every pair once, in rounds of disjoint pairs.
    """
    d = columns.shape[1]
    a, v = columns.copy(), np.eye(d)
    ring = list(range(d + d % 2))
    eps = np.finfo(float).eps * np.sqrt(max(1, len(a)))
    for _ in range(sweeps):
        turned = False
        for _ in range(len(ring) - 1):
            pairs = [(ring[i], ring[-1 - i]) for i in range(len(ring) // 2)]
            i, j = np.array([sorted(p) for p in pairs if max(p) < d], np.int64).reshape(-1, 2).T
            ring = [ring[0], ring[-1], *ring[1:-1]]
            x, y = a[:, i], a[:, j]
            alpha, beta, gamma = (x * x).sum(0), (y * y).sum(0), (x * y).sum(0)
            turn = np.abs(gamma) > eps * np.sqrt(alpha) * np.sqrt(beta)
            if not turn.any():
                continue
            turned = True
            i, j, alpha, beta, gamma = i[turn], j[turn], alpha[turn], beta[turn], gamma[turn]
            with np.errstate(over="ignore"):
                zeta = (beta - alpha) / (2 * gamma)
            t = np.where(zeta < 0, -1.0, 1.0) / (np.abs(zeta) + np.hypot(1, zeta))
            c = 1 / np.hypot(1, t)
            s = c * t
            for m in (a, v):
                m[:, i], m[:, j] = c * m[:, i] - s * m[:, j], s * m[:, i] + c * m[:, j]
        if not turned:
            break
    return a, v


def triangle(blocks: Iterator[np.ndarray], dims: int) -> np.ndarray:
    """The R of all rows of the blocks, one block at a time."""
    r = np.zeros((0, dims))
    for b in blocks:
        r = np.linalg.qr(np.vstack((r, b)), mode="r")
    return r


def _matrix(batch: pa.RecordBatch, name: str, dims: int) -> np.ndarray:
    return column(batch, name).flatten().to_numpy(zero_copy_only=False).reshape(-1, dims)


def _centred(x: np.ndarray, n: int, sums: list[int]) -> np.ndarray:
    """n x - S, exactly: as long numbers where they suffice, else as Python's."""
    wide = n * max(int(x.max(initial=0)), -int(x.min(initial=0))) >= _LONG >> 1 or max(map(abs, sums), default=0) >= _LONG >> 1
    kind = object if wide else np.int64
    return x.astype(kind) * n - np.array(sums, kind)


def _ratio(centred: np.ndarray, n: int) -> np.ndarray:
    return np.array([[int(v) / n for v in row] for row in centred], float).reshape(centred.shape) if centred.dtype == object else centred / float(n)


def _deviations(centred: np.ndarray) -> pa.Array:
    """Sums of squares, exactly."""
    if centred.dtype != object and np.abs(centred).max(initial=0) < 1 << 31 and centred.shape[1] * int(np.abs(centred).max(initial=0)) ** 2 < _LONG:
        return pa.array((centred * centred).sum(1), pa.int64())
    found = [sum(int(v) ** 2 for v in row) for row in centred.tolist()]
    return pa.array([d if d < _LONG else None for d in found], pa.int64())


class Whitening:
    """What a fit gives: n, the sums, and components (rows) with standard deviations, in falling order."""

    def __init__(self, n: int, sums: list[int], components: np.ndarray, deviations: np.ndarray):
        self.n, self.sums, self.components, self.deviations = n, sums, components, deviations
        least = np.finfo(float).eps * max(1, len(sums)) * deviations.max(initial=0)
        self.proper = deviations > least
        variance = np.where(self.proper, deviations, 0.0) ** 2
        self.explained = variance / variance.sum() if variance.sum() > 0 else variance
        self.identity_error = 0.0

    def project(self, centred: np.ndarray, most: int) -> np.ndarray:
        """Whitened coordinates of n x - S; not a number without variance."""
        sigma = np.where(self.proper, self.deviations, np.nan)[:most]
        return _ratio(centred, self.n) @ self.components[:most].T / sigma


def whole_vectors(points: DataFrame, scale: int = 64, shift: int = 1_000_000) -> tuple[DataFrame, int]:
    """(vec_id, x) of the rows of points(vec_id, vector) that take part, x = floor(scale * entry) + shift, and their length."""
    rows = points.where(usable(F.col("vector")))
    sizes = rows.groupBy(F.size("vector").alias("dims")).count().orderBy(F.desc("count"), F.desc("dims")).first()
    dims = sizes.dims if sizes else 0
    held = lambda c: F.least(F.greatest(F.floor(c.cast("double") * scale), F.lit(-(1 << 62))), F.lit(1 << 62)) + shift
    return rows.where(F.size("vector") == dims).select("vec_id", F.transform("vector", held).alias("x")), dims


def fit(rows: DataFrame, dims: int, *, components: int = 16, fanout: int = 16) -> Whitening | None:
    """Fits on the distinct vectors of rows(x); None if there are none. identity_error is measured over them for the first components."""
    spark = rows.sparkSession
    distinct = stored(rows.select("x").distinct())
    sums = distinct.select(F.posexplode("x").alias("pos", "v")).groupBy("pos").agg(F.sum(F.col("v").cast("decimal(38,0)")).alias("s")).orderBy("pos").collect()
    n = distinct.count()
    if not n or not dims:
        return None
    total = [int(r.s) for r in sums]

    def compress(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        r = triangle((_ratio(_centred(_matrix(b.slice(a, 4096), "x", dims), n, total), n) for b in batches for a in range(0, b.num_rows, 4096)), dims)
        if len(r):
            yield pa.RecordBatch.from_arrays([pa.array([r.tobytes()], pa.binary())], ["r"])

    def combine(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        r = triangle((np.frombuffer(m, float).reshape(-1, dims) for b in batches for m in column(b, "r").to_pylist()), dims)
        if len(r):
            yield pa.RecordBatch.from_arrays([pa.array([r.tobytes()], pa.binary())], ["r"])

    rs = stored(distinct.mapInArrow(compress, "r binary"), narrow=True)
    while (left := rs.count()) > fanout:
        rs = stored(rs.repartition(-(-left // fanout)).mapInArrow(combine, "r binary"))
    r = triangle((np.frombuffer(bytes(m.r), float).reshape(-1, dims) for m in rs.collect()), dims)
    columns, turned = rotations(r)
    length = np.sqrt((columns * columns).sum(0))
    order = np.argsort(-length, kind="stable")
    found = Whitening(n, total, turned[:, order].T, length[order] / np.sqrt(n))
    sent = spark.sparkContext.broadcast(found)

    def products(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        model, made = sent.value, 0.0
        for b in batches:
            for a in range(0, b.num_rows, 4096):
                w = model.project(_centred(_matrix(b.slice(a, 4096), "x", dims), n, total), components)[:, model.proper[:components]]
                made = made + np.hstack((w.T @ w, w.sum(0)[:, None]))
        if isinstance(made, np.ndarray):
            i, j = np.indices(made.shape)
            yield pa.RecordBatch.from_arrays([pa.array(i.ravel()), pa.array(j.ravel()), pa.array(made.ravel())], ["i", "j", "v"])

    cells = distinct.mapInArrow(products, "i long, j long, v double").groupBy("i", "j").agg(F.sum("v").alias("v")).collect()
    sent.destroy()
    k = int(found.proper[:components].sum())
    table = np.zeros((k, k + 1))
    for c in cells:
        table[c.i, c.j] = c.v / n
    mean = table[:, k]
    found.identity_error = float(np.abs(table[:, :k] - np.outer(mean, mean) - np.eye(k)).max(initial=0.0))
    return found


def whiten(points: DataFrame, *, components: int = 16, scale: int = 64, shift: int = 1_000_000, fanout: int = 16) -> DataFrame:
    """(vec_id, component, n, deviation, whitened, explained, identity_error) of points(vec_id, vector), a row for each vector and component."""
    spark = points.sparkSession
    kind = points.schema["vec_id"].dataType.simpleString()
    schema = f"vec_id {kind}, component int, n long, deviation long, whitened double, explained double, identity_error double"
    rows, dims = whole_vectors(points, scale, shift)
    model = fit(rows, dims, components=components, fanout=fanout)
    if model is None:
        return spark.createDataFrame([], schema)
    sent = spark.sparkContext.broadcast(model)
    names = [c.split()[0] for c in schema.split(", ")]

    def project(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        m = sent.value
        k = min(components, len(m.components))
        for b in batches:
            for a in range(0, b.num_rows, 2048):
                part = b.slice(a, 2048)
                centred = _centred(_matrix(part, "x", dims), m.n, m.sums)
                w, each = m.project(centred, k).ravel(), np.repeat(np.arange(part.num_rows), k)
                repeat = lambda v: pa.array(np.tile(v, part.num_rows))
                yield pa.RecordBatch.from_arrays(
                    [column(part, "vec_id").take(pa.array(each)), repeat(np.arange(1, k + 1, dtype=np.int32)), pa.array(np.full(len(w), m.n)), _deviations(centred).take(pa.array(each)),
                     pa.array(w, mask=np.isnan(w)), repeat(m.explained[:k]), pa.array(np.full(len(w), m.identity_error))], names
                )

    return rows.mapInArrow(project, schema)
