"""Shared pieces: tables in the shared folder and vectorised hashing of words in Arrow batches."""

from __future__ import annotations

import ctypes
import hashlib
import os
import re
import sys
import tempfile
import uuid
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

U64 = np.uint64
_M1, _M2 = U64(0xBF58476D1CE4E5B9), U64(0x94D049BB133111EB)
_BASE = U64(0x9E3779B97F4A7C15)


def shared_folder(spark: SparkSession) -> str:
    """A new folder path that the driver and all executors can reach.

    It lies in ``spark.checkpoint.dir``. Only a session on this machine alone may lack that setting
    (tests); it gets a temporary folder.
    """
    root = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getCheckpointDir()
    if not root:
        if not re.fullmatch(r"local(\[.*\])?", spark.sparkContext.master):
            raise ValueError("spark.checkpoint.dir is not set: it names the folder that all executors share")
        root = tempfile.mkdtemp(prefix="loomspan-")
        spark.sparkContext.setCheckpointDir(root)
    return f"{root.rstrip('/')}/loomspan/{uuid.uuid4().hex}"


#: Where the shared folder is a mounted path, Hadoop starts one process for the mode of each file, and one more for that
#: of a checksum file beside it. Parquet pages have checksums of their own, which ``stored`` has
#: verified on reading, so the latter are left out. Other file systems ignore this.
MOUNTED = {"fs.file.impl": "org.apache.hadoop.fs.RawLocalFileSystem", "fs.file.impl.disable.cache": "true", "parquet.page.write-checksum.enabled": "true"}


def stored(df: DataFrame, *, narrow: bool = False) -> DataFrame:
    """df as a Parquet table in the shared folder, read again: it survives lost executors.

    narrow: df has a few numbers for some of the rows that it comes from, after a shuffle; it is
    written by as many tasks as there are cores, not in as many files as there are partitions.
    """
    spark = df.sparkSession
    path = shared_folder(spark)
    schema = df.schema
    if narrow:
        df = df.coalesce(spark.sparkContext.defaultParallelism)
    df.write.options(**MOUNTED).option("mapreduce.fileoutputcommitter.marksuccessfuljobs", "false").parquet(path)
    return spark.read.option("parquet.page.verify-checksum.enabled", "true").schema(schema).parquet(path)


#: Bits of a bitmap over keys: 2 MB, whatever the input, in rows of 4 KB.
FILTER_BITS = 1 << 24
_ROW_BITS = 32768


def _place(key: str) -> Column:
    return F.pmod(F.xxhash64(key), F.lit(FILTER_BITS))


def key_filter(rows: DataFrame, key: str) -> DataFrame:
    """A bitmap over the hashes of a column, as at most FILTER_BITS / 32768 rows."""
    at = rows.select(_place(key).alias("at"))
    return at.groupBy((F.col("at") / _ROW_BITS).cast("int").alias("bucket")).agg(F.bitmap_construct_agg(F.pmod("at", F.lit(_ROW_BITS))).alias("bits"))


def flag_keys(rows: DataFrame, key: str, bitmap: DataFrame, flag: str) -> DataFrame:
    """rows with a flag: true for every key in the bitmap, and perhaps for some more; broadcasts 2 MB at most."""
    at = _place(key)
    bucket, bits = fresh("__bucket", rows), fresh("__bits", rows)
    bitmap = bitmap.select(F.col("bucket").alias(bucket), F.col("bits").alias(bits))
    place = F.pmod(at, F.lit(_ROW_BITS)).cast("int")
    byte = F.ascii(F.decode(F.substring(bits, (place / 8).cast("int") + 1, F.lit(1)), "ISO-8859-1"))
    bit = F.call_function("shiftright", byte, F.pmod(place, F.lit(8))).bitwiseAND(1)
    joined = rows.withColumn(bucket, (at / _ROW_BITS).cast("int")).join(F.broadcast(bitmap), bucket, "left")
    return joined.withColumn(flag, F.coalesce(bit == 1, F.lit(False))).drop(bucket, bits)


def mix(h: np.ndarray) -> np.ndarray:
    """Finaliser of splitmix64, element by element."""
    h = (h ^ (h >> U64(30))) * _M1
    h = (h ^ (h >> U64(27))) * _M2
    return h ^ (h >> U64(31))


LOWER = np.arange(256, dtype=np.uint8)
LOWER[65:91] += 32
#: Bytes of words: everything but ASCII white space; or digits, a-z and all of non-ASCII characters.
NOT_SPACE = np.ones(256, bool)
NOT_SPACE[[32, 9, 10, 11, 12, 13]] = False
ALNUM = np.zeros(256, bool)
ALNUM[48:58] = ALNUM[97:123] = ALNUM[128:] = True


#: Rows of a slice at most.
MOST_ROWS = 1 << 15


class Texts:
    """Some rows of a batch: UTF-8 bytes of a text column (null counts as empty) with offsets."""

    def __init__(self, batch: pa.RecordBatch, column: str):
        col = batch.column(batch.schema.get_field_index(column))
        col = pc.fill_null(col, "").cast(pa.large_string())
        _, offsets, data = col.buffers()
        n = len(col)
        off = np.frombuffer(offsets, np.int64)[col.offset : col.offset + n + 1] if n else np.zeros(1, np.int64)
        raw = np.frombuffer(data, np.uint8) if data is not None else np.zeros(0, np.uint8)
        self.batch, self.rows = batch, n
        self.offsets = off - off[0]
        self.data = raw[off[0] : off[-1]]
        self._words: dict[bool, np.ndarray] = {}

    def text(self, i: int) -> bytes:
        return self.data[self.offsets[i] : self.offsets[i + 1]].tobytes()

    def pieces(self, keep: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Maximal runs of kept bytes within a row, as (row, start, end)."""
        if not len(self.data):
            return (np.zeros(0, np.int64),) * 3
        inside = np.zeros(len(self.data) + 1, bool)
        inside[:-1] = keep
        first = np.zeros(len(self.data) + 1, bool)
        first[self.offsets] = True
        before = np.concatenate(([False], inside[:-1])) & ~first
        starts = np.flatnonzero(inside & ~before)
        after = np.concatenate((inside[1:] & ~first[1:], [False]))
        ends = np.flatnonzero(inside & ~after) + 1
        return np.searchsorted(self.offsets, starts, "right") - 1, starts, ends

    def words(self, lower: bool = False) -> np.ndarray:
        """The 8 bytes from each place on, as whole numbers; lower: of A-Z lower-cased."""
        if lower not in self._words:
            self._words[lower] = words_at(LOWER[self.data] if lower else self.data)
        return self._words[lower]

    def hashes(self, start: np.ndarray, end: np.ndarray, lower: bool = False, kind: int = 0) -> np.ndarray:
        return hashes(self.words(lower), start, end, kind)


#: What is left of 8 bytes when only the first k count.
_MASK = np.array([(1 << 8 * k) - 1 for k in range(9)], U64)
#: Ranges of more bytes are hashed and compared one by one.
_LONG = 512
#: Bits of a hash: fewer only in tests, which let hashes collide.
_KEPT_BITS = U64((1 << int(os.environ.get("LOOMSPAN_HASH_BITS", "64"))) - 1)
_SEED = (U64(0x5851F42D4C957F2D), U64(0xDA942042E4DD58B5))


def words_at(data: np.ndarray) -> np.ndarray:
    """The 8 bytes from each place of data on, zero past its end."""
    padded = np.zeros(len(data) + 8, np.uint8)
    padded[:-8] = data
    return np.ndarray(len(data) + 1, "<u8", padded, strides=(1,))


def _bytes(words: np.ndarray, start: int, end: int) -> bytes:
    return words.base[start:end].tobytes()


def hashes(words: np.ndarray, start: np.ndarray, end: np.ndarray, kind: int = 0) -> np.ndarray:
    """64-bit hashes of byte ranges: equal bytes give equal hashes wherever they stand.

    Ranges of up to 7 bytes differ in their hashes whenever they differ. Longer ones go through a
    mixer of 8 bytes a step, or a keyed BLAKE2b. kind: one of two independent hashes.
    """
    n = end - start
    key = words[start] & _MASK[np.minimum(n, 8)]
    key |= np.where(n < 8, n, 0).astype(U64) << U64(56)
    longer = np.flatnonzero(n > 7)
    if len(longer):
        acc = mix(key[longer] + _SEED[kind] + n[longer].astype(U64) * _BASE)
        left, k = np.flatnonzero((n[longer] > 8) & (n[longer] <= _LONG)), 8
        s, z = start[longer], n[longer]
        while len(left):
            acc[left] = mix((acc[left] ^ (words[s[left] + k] & _MASK[np.minimum(z[left] - k, 8)])) + _SEED[kind])
            k += 8
            left = left[z[left] > k]
        for i in np.flatnonzero(z > _LONG).tolist():
            raw = hashlib.blake2b(_bytes(words, int(s[i]), int(s[i] + z[i])), digest_size=8, key=bytes([kind]))
            acc[i] = int.from_bytes(raw.digest(), "little")
        key[longer] = acc | U64(1 << 63)
    return mix(key ^ _SEED[kind]) & _KEPT_BITS


def same_ranges(a: np.ndarray, at_a: np.ndarray, b: np.ndarray, at_b: np.ndarray, n: np.ndarray) -> np.ndarray:
    """Whether the n bytes at these places of a and b (both of words_at) are the same."""
    same = np.ones(len(n), bool)
    left, k = np.flatnonzero((n > 0) & (n <= _LONG)), 0
    while len(left):
        ok = ((a[at_a[left] + k] ^ b[at_b[left] + k]) & _MASK[np.minimum(n[left] - k, 8)]) == 0
        same[left[~ok]] = False
        k += 8
        left = left[ok & (n[left] > k)]
    for i in np.flatnonzero(n > _LONG).tolist():
        z = int(n[i])
        same[i] = _bytes(a, int(at_a[i]), int(at_a[i]) + z) == _bytes(b, int(at_b[i]), int(at_b[i]) + z)
    return same


def grouped(words: np.ndarray, start: np.ndarray, end: np.ndarray, h: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Distinct ranges by hash, with bytes compared: one range of each hash, the place of each range's hash among these, and the ranges whose bytes are not those of that one."""
    order = np.argsort(h)
    first = np.ones(len(h), bool)
    first[1:] = h[order[1:]] != h[order[:-1]]
    lead = order[first]
    group = np.empty(len(h), np.int64)
    group[order] = np.cumsum(first) - 1
    own = lead[group]
    n = end - start
    check = np.flatnonzero(own != np.arange(len(h)))
    ok = n[check] == n[own[check]]
    ok[ok] = same_ranges(words, start[check[ok]], words, start[own[check[ok]]], n[check[ok]])
    return lead, group, check[~ok]


_KEPT: dict[str, tuple] = {}


def kept(name: str, key, make):
    """An object that this Python worker keeps for its next tasks of the same kind; one of each name."""
    if name not in _KEPT or _KEPT[name][0] != key:
        _KEPT[name] = (key, make())
    return _KEPT[name][1]


def trim() -> None:
    """Gives memory that this Python worker has freed back to the system, for workers live on between stages."""
    pa.default_memory_pool().release_unused()
    if sys.platform == "linux":
        trim_heap = getattr(ctypes.CDLL(None), "malloc_trim", None)
        if trim_heap is not None:
            trim_heap(0)


def text_slices(batches: Iterator[pa.RecordBatch], column: str = "text", budget: int = 1 << 20, keep: str = "") -> Iterator[Texts]:
    """The rows in slices of about budget bytes of text, so that the arrays beside a slice stay small.

    What the worker has kept under other names than keep is forgotten.
    """
    for name in [n for n in _KEPT if n != keep]:
        del _KEPT[name]
    yield from _slices(batches, column, budget)
    trim()


def _slices(batches: Iterator[pa.RecordBatch], column: str, budget: int) -> Iterator[Texts]:
    for batch in batches:
        if not batch.num_rows:
            continue
        col = batch.column(batch.schema.get_field_index(column))
        ends = np.cumsum(pc.fill_null(pc.binary_length(col), 0).to_numpy(zero_copy_only=False).astype(np.int64))
        start = 0
        while start < batch.num_rows:
            base = ends[start - 1] if start else 0
            stop = max(start + 1, int(np.searchsorted(ends, base + budget, "right")))
            stop = min(stop, start + MOST_ROWS)
            yield Texts(batch.slice(start, stop - start), column)
            start = stop


def windows(rows: np.ndarray, word_hashes: np.ndarray, size: int) -> tuple[np.ndarray, np.ndarray]:
    """First words and hashes of all runs of size words that lie in one row."""
    n = len(rows) - size + 1
    if n <= 0:
        return np.zeros(0, np.int64), np.zeros(0, U64)
    first = np.flatnonzero(rows[:n] == rows[size - 1 :])
    h = np.zeros(len(first), U64)
    for k in range(size):
        h = mix(h * _BASE + word_hashes[first + k] + U64(k + 1))
    return first, h


def fresh(name: str, docs: DataFrame) -> str:
    """A column name that docs does not have."""
    taken = {c.lower() for c in docs.columns}
    while name in taken:
        name += "_"
    return name


def others(docs: DataFrame, *new: str) -> list[str]:
    """The columns of docs that results with these new columns keep: those of the same names, whatever their case, are replaced."""
    taken = {n.lower() for n in new}
    return [c for c in docs.columns if c.lower() not in taken]


def hash_bitmap(hashed: DataFrame, key: str, bits: int = 1 << 26) -> np.ndarray:
    """A bitmap (8 MB) over a column of hashes: ask it with in_bitmap. When it fills up it lets more hashes through and loses none."""
    at = hashed.select(F.pmod(key, F.lit(bits)).alias("at"))
    found = at.groupBy((F.col("at") / _ROW_BITS).cast("int").alias("bucket")).agg(F.bitmap_construct_agg(F.pmod("at", F.lit(_ROW_BITS))).alias("bits"))
    out = np.zeros(bits // 8, np.uint8)
    for r in found.toLocalIterator():
        out[r.bucket * _ROW_BITS // 8 : (r.bucket + 1) * _ROW_BITS // 8] = np.frombuffer(r.bits, np.uint8)
    return out


def in_bitmap(bitmap: np.ndarray, h: np.ndarray) -> np.ndarray:
    at = h & U64(len(bitmap) * 8 - 1)
    return (bitmap[(at >> U64(3)).astype(np.int64)] >> (at & U64(7)).astype(np.uint8)) & 1 == 1


def column(batch: pa.RecordBatch, name: str) -> pa.Array:
    return batch.column(batch.schema.get_field_index(name))


def hex_of(parts: list[bytes]) -> list[str]:
    return [p.hex() for p in parts]
