"""Exact top-k by inner product over vectors of whole numbers: an impact-ordered index, processed score at a time.

The index cuts the rows into shards. In a shard each dimension has a posting list in segments: the rows whose
component falls into one step of ``width`` share a segment and its quantised impact, the middle of the step.
Segments of all dimensions are stored by descending size of the impact, in bands over which it halves.

A shard is searched band by band for many queries at once: each posting adds weight times quantised impact to the
score of its row. What a row may still gain or lose is bounded by the query's length times the length of what the
processed postings leave of the row, the error of the steps included. Where a row's upper bound lies below the k-th best lower bound, or
below the k-th exact score that the task knows, the row is no member; that is the only proof by which a search
may stop. It stops when the rows that may still be members are few (``share``) or all bands are processed, and all of those rows, however
many, are scored exactly in whole numbers. So results do not depend on width, bands or share.

Queries come in blocks, each broadcast (8 MB at most, or one query) to one scan of the index; a task sends k rows a
query. If there are several blocks, each appends its rows to one table.

Defined results: vectors null or holding null or non-finite entries take no part, neither as queries nor as candidates; a
shorter vector counts as zero beyond its end; a row is no candidate of its own query, but another row with the
same id is; ties go to the smaller id, null ids last. Components beyond 2^20 in size are scored in whole numbers of
any length without the index, and scores beyond a long are held at its ends. An empty table gives an empty result.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from loomspan.llm._common import column, shared_folder, stored

#: Bytes of a block of queries, numbers of a shard, rows of a shard, and pairs that are worked on at once.
BLOCK_BYTES, SHARD_CELLS, SHARD_ROWS, TILE = 8 << 20, 1 << 20, 1 << 14, 1 << 21
#: Larger components are scored without the index. Sums of 2^13 products are exact in doubles.
MOST, MOST_DIMS = 1 << 20, 1 << 13
INDEX = "dims int, uids binary, ids array<long>, matrix binary, segment_dim binary, segment_impact binary, segment_size binary, postings binary"
HITS = "query_uid long, query_id long, uid long, vec_id long, score long"
_END = (1 << 63) - 1


def usable(vector: Column) -> Column:
    """Whether a vector is there and all its entries are finite."""
    finite = F.forall(vector, lambda v: v.isNotNull() & ~F.isnan(v.cast("double")) & (F.abs(v.cast("double")) < float("inf")))
    return F.coalesce(finite, F.lit(False))


def whole(vectors: pa.Array, scale: int) -> np.ndarray:
    """floor(scale * x) of a list column, in doubles, filled up with zeros on the right."""
    if isinstance(vectors, pa.ChunkedArray):
        vectors = vectors.combine_chunks()
    sizes = vectors.value_lengths().to_numpy(zero_copy_only=False)
    out = np.zeros((len(vectors), int(sizes.max(initial=0))))
    with np.errstate(over="ignore"):
        flat = np.nan_to_num(np.floor(vectors.flatten().to_numpy(zero_copy_only=False).astype(np.float64) * scale))
    out[np.arange(out.shape[1]) < sizes[:, None]] = flat
    return out


def segments(x: np.ndarray, width: int) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Posting segments of a shard by descending size of their impact: dimension, impact and size of each, and the rows of all."""
    step = np.floor(x / width).astype(np.int64)
    impact = step * width + (width - 1) / 2
    dim = np.broadcast_to(np.arange(x.shape[1]), x.shape)
    row = np.broadcast_to(np.arange(len(x))[:, None], x.shape)
    order = np.lexsort((row.ravel(), dim.ravel(), impact.ravel(), -np.abs(impact).ravel()))
    impact, dim = impact.ravel()[order], dim.ravel()[order]
    first = np.flatnonzero(np.concatenate(([True], (impact[1:] != impact[:-1]) | (dim[1:] != dim[:-1])))) if len(order) else np.zeros(0, np.int64)
    return dim[first].astype(np.int32), impact[first], np.diff(np.append(first, len(order))).astype(np.int32), row.ravel()[order].astype(np.int32)


def build_index(points: DataFrame, *, scale: int = 256, width: int | None = None, shard_rows: int | None = None) -> DataFrame:
    """The stored index of points(vec_id, vector): a row a shard. width: of a step, by default an eighth of a shard's root mean square."""
    spark = points.sparkSession
    rows = points.where(usable(F.col("vector"))).select(F.col("vec_id").cast("long").alias("vec_id"), "vector")
    size = rows.agg(F.count("*").alias("n"), F.max(F.size("vector")).alias("dims")).first()
    most = shard_rows or max(1, min(SHARD_ROWS, SHARD_CELLS // max(1, size.dims or 1)))
    parts = max(1, -(-size.n // most), min(spark.sparkContext.defaultParallelism, size.n))

    def shard(ids: pa.Array, x: np.ndarray, first: int) -> pa.RecordBatch:
        plain = np.abs(x).max(1, initial=0) <= MOST if x.shape[1] <= MOST_DIMS else np.zeros(len(x), bool)
        used = np.where(plain[:, None], x, 0.0)
        step = width or max(1, int(np.sqrt((used * used).mean()) / 8)) if x.size else 1
        dim, impact, count, postings = segments(used, step)
        blobs = [np.arange(first, first + len(x)), x, dim, impact, count, postings]
        uids, *rest = [pa.array([b.tobytes()], pa.binary()) for b in blobs]
        return pa.RecordBatch.from_arrays([pa.array([x.shape[1]], pa.int32()), uids, pa.array([ids.to_pylist()], pa.list_(pa.int64())), *rest], [c.split()[0] for c in INDEX.split(", ")])

    def build(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        first, held = TaskContext.get().partitionId() << 33, []
        for b in batches:
            held.append(b)
            while sum(h.num_rows for h in held) >= most:
                table = pa.Table.from_batches(held)
                yield shard(table["vec_id"].slice(0, most), whole(table["vector"].slice(0, most), scale), first)
                first, held = first + most, table.slice(most).to_batches()
        if held and sum(h.num_rows for h in held):
            table = pa.Table.from_batches(held)
            yield shard(table["vec_id"], whole(table["vector"], scale), first)

    return stored(rows.repartition(parts).mapInArrow(build, INDEX))


class Shard:
    """A row of the index, as arrays."""

    def __init__(self, row: dict):
        dims = row["dims"]
        read = lambda c, kind: np.frombuffer(row[c], kind)
        self.uids = read("uids", np.int64)
        self.x = read("matrix", np.float64).reshape(len(self.uids), dims)
        self.null = np.array([i is None for i in row["ids"]], bool)
        self.ids = np.array([0 if i is None else i for i in row["ids"]], np.int64)
        self.dim, self.impact = read("segment_dim", np.int32), read("segment_impact", np.float64)
        self.end, self.postings = np.cumsum(read("segment_size", np.int32)), read("postings", np.int32)
        self.plain = np.abs(self.x).max(1, initial=0) <= MOST if dims <= MOST_DIMS else np.zeros(len(self.x), bool)

    def bands(self) -> Iterator[tuple[np.ndarray, np.ndarray]]:
        """What each band of segments adds to the rows, as (dimension x row) values, and the lengths of what all bands so far leave of the rows."""
        left = np.where(self.plain[:, None], self.x, 0.0)
        size, start = np.abs(self.impact), 0
        while start < len(size):
            stop = int(np.searchsorted(-size, -size[start] / 2, "right")) if size[start] > 0 else len(size)
            a, b = (int(self.end[start - 1]) if start else 0), int(self.end[stop - 1])
            count = np.diff(self.end[start:stop], prepend=a)
            dim, value, row = np.repeat(self.dim[start:stop], count), np.repeat(self.impact[start:stop], count), self.postings[a:b]
            made = np.zeros(self.x.shape[::-1])
            made[dim, row] = value
            left[row, dim] -= value
            yield made, np.sqrt((left * left).sum(1))
            start = stop


def _kth(scores: np.ndarray, k: int) -> np.ndarray:
    """The k-th largest of each row, minus infinity if there are fewer."""
    if scores.shape[1] < k:
        return np.full(len(scores), -np.inf)
    return np.partition(scores, scores.shape[1] - k, axis=1)[:, scores.shape[1] - k]


def possible(shard: Shard, bands: list, q: np.ndarray, own: tuple, floor: np.ndarray, k: int, share: float) -> np.ndarray:
    """Which rows of the shard may be among the k best of each query. bands: as Shard.bands; own: (query, row) pairs that are no candidates; floor: the k-th score known so far."""
    shape = len(q), len(shard.x)
    score, length = np.zeros(shape), np.sqrt((q * q).sum(1))[:, None]
    alive = np.ones(shape, bool)
    out = ~shard.plain
    for made, left in bands:
        score += q @ made
        # Doubles err by far less than the slack, which is a billionth of the largest sizes there are.
        error = length * left[None, :] * (1 + 1e-9) + 1e-9 * length * length.max(initial=1)
        low = score - error
        low[own] = -np.inf
        low[:, out] = -np.inf
        least = np.maximum(_kth(low, k), floor)
        alive = score + error >= least[:, None]
        alive[own] = False
        alive[:, out] = True
        if alive.sum() <= share * alive.size:
            break
    alive[own] = False
    return alive


def exact(q: np.ndarray, x: np.ndarray, plain: np.ndarray) -> np.ndarray:
    """Inner products of rows of whole numbers, pair by pair; where not plain, in Python's whole numbers."""
    out = np.einsum("ij,ij->i", np.where(plain[:, None], q, 0.0), np.where(plain[:, None], x, 0.0)).astype(np.int64)
    for i in np.flatnonzero(~plain).tolist():
        sum_ = sum(int(a) * int(b) for a, b in zip(q[i].tolist(), x[i].tolist(), strict=True))
        out[i] = max(-_END, min(_END, sum_))
    return out


def _searched(sent, k: int, share: float):
    def scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        q_uid, q_id, vectors = sent.value
        plain = np.abs(vectors).max(1, initial=0) <= MOST
        best = [np.zeros(0, np.int64) for _ in range(3)] + [np.zeros(0, bool), np.zeros(0, np.int64)]  # query, score, id, null, uid
        floor = np.full(len(q_uid), -np.inf)
        for b in batches:
            for r in range(b.num_rows):
                s = Shard(b.slice(r, 1).to_pylist()[0])
                q = np.zeros((len(vectors), s.x.shape[1]))
                cut = min(q.shape[1], vectors.shape[1])
                q[:, :cut] = vectors[:, :cut]
                bands, own = list(s.bands()), np.argsort(s.uids)
                for a in range(0, len(q), step := max(1, TILE // max(1, len(s.x)))):
                    tile = slice(a, a + step)
                    at = np.searchsorted(s.uids, q_uid[tile], sorter=own)
                    at = own[np.minimum(at, len(own) - 1)]
                    mine = np.flatnonzero(s.uids[at] == q_uid[tile])
                    used = np.where(plain[tile, None], q[tile], 0.0)
                    alive = possible(s, bands, used, (mine, at[mine]), floor[tile], k, share)
                    alive[~plain[tile]] = True
                    alive[mine, at[mine]] = False
                    query, row = np.nonzero(alive)
                    query = query + a
                    for c in range(0, len(query), chunk := max(1, TILE // max(1, q.shape[1]))):
                        i, j = query[c : c + chunk], row[c : c + chunk]
                        found = [i, exact(q[i], s.x[j], plain[i] & s.plain[j]), s.ids[j], s.null[j], s.uids[j]]
                        best = _merged([np.concatenate(p) for p in zip(best, found, strict=True)], k)
                floor = np.full(len(q_uid), -np.inf)
                last = np.flatnonzero(np.bincount(best[0], minlength=len(q_uid)) == k)
                floor[last] = best[1][np.searchsorted(best[0], last, "right") - 1]
        if len(best[0]):
            ids = pa.array(best[2], mask=best[3])
            yield pa.RecordBatch.from_arrays([pa.array(q_uid[best[0]]), pa.array(q_id[best[0]]), pa.array(best[4]), ids, pa.array(best[1])], [c.split()[0] for c in HITS.split(", ")])

    return scan


def _merged(rows: list[np.ndarray], k: int) -> list[np.ndarray]:
    """The k best of each query, by score, then id (null last), then uid."""
    query, score, name, null, uid = rows
    order = np.lexsort((uid, name, null, -score, query))
    rank = np.arange(len(order)) - np.searchsorted(query[order], query[order])
    return [p[order[rank < k]] for p in rows]


def own_queries(index: DataFrame, every: int) -> DataFrame:
    """(query_uid, query_id, vector) of the rows of the index whose id is divisible by ``every``."""

    def take(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for r in range(b.num_rows):
                s = Shard(b.slice(r, 1).to_pylist()[0])
                at = np.flatnonzero(~s.null & (s.ids % every == 0))
                yield pa.RecordBatch.from_arrays([pa.array(s.uids[at]), pa.array(s.ids[at]), pa.array(list(s.x[at]), pa.list_(pa.float64()))], ["query_uid", "query_id", "vector"])

    return stored(index.select("dims", "uids", "ids", "matrix", *(F.lit(b"").alias(c) for c in ("segment_dim", "segment_impact", "segment_size", "postings"))).mapInArrow(take, "query_uid long, query_id long, vector array<double>"))


def search(index: DataFrame, queries: DataFrame, k: int, *, share: float = 0.02, block_bytes: int = BLOCK_BYTES) -> DataFrame:
    """(query_id, rank, vec_id, score) of the k best rows of the index for queries(query_uid, query_id, vector of whole numbers). query_uid: the query's own row in the index, or a negative number of its own."""
    spark = index.sparkSession
    size = queries.agg(F.count("*").alias("n"), F.max(F.size("vector")).alias("dims")).first()
    blocks = max(1, -(-size.n * max(1, size.dims or 1) * 8 // block_bytes))
    number = F.pmod(F.xxhash64("query_uid"), F.lit(blocks))
    path, found = shared_folder(spark), None
    for b in range(blocks):
        block = queries.where(number == b).toArrow()
        sent = spark.sparkContext.broadcast((block["query_uid"].to_numpy(), block["query_id"].to_numpy(), whole(block["vector"], 1)))
        found = index.mapInArrow(_searched(sent, k, share), HITS)
        if blocks > 1:
            found.write.mode("append").parquet(path)
            sent.destroy()
    if blocks > 1:
        found = spark.read.schema(HITS).parquet(path)
    order = Window.partitionBy("query_uid").orderBy(F.desc("score"), F.asc_nulls_last("vec_id"), "uid")
    return found.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= k).select("query_id", "rank", "vec_id", "score")


def self_search(points: DataFrame, k: int, every: int, **options) -> DataFrame:
    """The k best others of each row of points(vec_id, vector) whose id is divisible by ``every``, against all rows."""
    index = build_index(points, **options)
    return search(index, own_queries(index, every), k)
