"""Exact deduplication through a log-structured merge index of text digests.

Each task fills memtables (digest -> identifier to keep, rows) and flushes each full one as a sorted
run; runs are Parquet files in the shared folder with min/max statistics and Bloom filters on the
digest, so ``lookup`` of an incremental load's digests reads only row groups that may hold them; ``add`` takes
such a load and merges levels as they fill. The query itself compacts all runs and needs no filter. Compaction merges the runs by
digest range into one sorted level, keeps one identifier per digest and adds up the rows. A
memtable holds a digest once, so a hot text costs each task one row.

Hits (digests of more than one row) are verified byte by byte: the least and the greatest text of a
digest are the same bytes exactly if all its texts are. Both are aggregated map-side, so a group of
any size moves two texts per task. A bitmap of fixed size over the hits keeps the other texts from
moving at all; when full it lets more texts through and loses none. Texts of a digest that turn out to differ are grouped by their bytes instead.

Defined results: null text equals the empty text; rows that repeat a doc_id with the same text are
one document and are all reported, kept alike; a null doc_id is the smallest; an empty table gives
an empty result.
"""

from __future__ import annotations

from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from loomspan.llm._common import column, flag_keys, key_filter, shared_folder, stored


def sha256_digest(text: Column) -> Column:
    return F.unhex(F.sha2(text, 256))


#: Of a digest and two numbers, before encoding.
_ROW_BYTES = 48


class MergeIndex:
    """Sorted digest runs in one folder of the shared file system, in levels: ``fanout`` tables of a level become one of the next."""

    def __init__(self, spark, root: str | None = None, *, keep: str = "largest", memtable_rows: int = 200_000, fanout: int = 8):
        self.spark, self.root, self.keep, self.memtable_rows, self.fanout = spark, root or shared_folder(spark), keep, memtable_rows, fanout
        self.levels: list[list[str]] = [[]]
        self.written = 0

    def _write(self, df: DataFrame, level: int) -> None:
        path = f"{self.root}/level{level}-{self.written}"
        # A row group has about as many rows as a memtable, for which its filter is sized.
        group = {"parquet.block.size": str(_ROW_BYTES * self.memtable_rows), "parquet.bloom.filter.enabled#digest": "true", "parquet.bloom.filter.expected.ndv#digest": str(self.memtable_rows)}
        df.write.options(**group).parquet(path)
        self.written += 1
        self.levels.extend([] for _ in range(level + 1 - len(self.levels)))
        self.levels[level].append(path)

    def flush(self, rows: DataFrame) -> None:
        """Adds runs from (digest, id)."""
        best, limit = max if self.keep == "largest" else min, self.memtable_rows

        def run(table: dict) -> pa.RecordBatch:
            order = sorted(table)
            return pa.RecordBatch.from_arrays(
                [pa.array(order, pa.binary()), pa.array([table[d][0] for d in order], pa.int64()), pa.array([table[d][1] for d in order], pa.int64())], ["digest", "keep_id", "n"]
            )

        def memtables(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            table: dict[bytes, list] = {}
            for b in batches:
                for d, i in zip(column(b, "digest").to_pylist(), column(b, "id").to_pylist(), strict=True):
                    if (old := table.get(d)) is None:
                        table[d] = [i, 1]
                    else:
                        old[0] = i if old[0] is None else old[0] if i is None else best(old[0], i)
                        old[1] += 1
                if len(table) >= limit:
                    yield run(table)
                    table = {}
            if table:
                yield run(table)

        self._write(rows.mapInArrow(memtables, "digest binary, keep_id long, n long"), 0)

    def add(self, rows: DataFrame) -> None:
        """An incremental load: new runs, and then compaction of each level that has got full, lowest first."""
        self.flush(rows)
        level = 0
        while level < len(self.levels):
            if len(self.levels[level]) >= self.fanout:
                self._merge(self.levels[level], level + 1)
                self.levels[level] = []
            level += 1

    def runs(self, paths: list[str] | None = None) -> DataFrame:
        """(digest, keep_id, n) of some tables, of all by default; a digest may come once from each run."""
        paths = [p for level in self.levels for p in level] if paths is None else paths
        schema = "digest binary, keep_id long, n long"
        return self.spark.read.schema(schema).parquet(*paths) if paths else self.spark.createDataFrame([], schema)

    def lookup(self, digests: list[bytes]) -> DataFrame:
        """(digest, keep_id, n) of the given digests, of all runs that hold one. Spark pushes the digests into the scan, where Bloom filters and statistics pass over row groups."""
        best = F.max if self.keep == "largest" else F.min
        some = F.lit(False)
        for start in range(0, len(digests), 10):  # Spark hands lists of up to 10 values to Parquet whole
            some |= F.col("digest").isin([bytearray(d) for d in digests[start : start + 10]])
        found = self.runs().where(some)
        return found.groupBy("digest").agg(best("keep_id").alias("keep_id"), F.sum("n").alias("n"))

    def _merge(self, paths: list[str], level: int) -> None:
        best = F.max if self.keep == "largest" else F.min
        merged = self.runs(paths).repartitionByRange("digest").groupBy("digest").agg(best("keep_id").alias("keep_id"), F.sum("n").alias("n")).sortWithinPartitions("digest")
        self._write(merged, level)

    def compact(self) -> DataFrame:
        """Merges all runs into one sorted table of the topmost level and returns it."""
        top = max(1, len(self.levels) - 1)
        self._merge([p for level in self.levels for p in level], top)
        self.levels = [[] for _ in range(top)] + [self.levels[top][-1:]]
        return self.runs()


def exact_dedup(docs: DataFrame, *, text: str = "text", doc_id: str = "doc_id", keep: str = "largest", digest=sha256_digest, memtable_rows: int = 200_000) -> DataFrame:
    """(doc_id, keep_id, group_size, kept, text_sha256) for each row of docs."""
    spark = docs.sparkSession
    body = F.coalesce(F.col(text), F.lit(""))
    rows = docs.select(F.col(doc_id).cast("long").alias("id"), body.alias("text")).withColumn("digest", digest(F.col("text")))
    index = MergeIndex(spark, keep=keep, memtable_rows=memtable_rows)
    index.flush(rows.select("digest", "id"))
    hits = stored(index.compact().where("n > 1"))
    suspects = flag_keys(rows, "digest", key_filter(hits, "digest"), "hit").where("hit").drop("hit")
    verified = suspects.groupBy("digest").agg(F.min("text").alias("least"), F.max("text").alias("most"))
    mixed = stored(verified.where("least != most").select("digest"), narrow=True)
    out = rows.withColumn("sha", F.col("digest") if digest is sha256_digest else F.unhex(F.sha2("text", 256)))
    if mixed.isEmpty():
        out = out.drop("text").join(hits, "digest", "left")
    else:
        best = F.max if keep == "largest" else F.min
        again = suspects.join(mixed, "digest", "left_semi").groupBy("digest", "text").agg(best("id").alias("keep_id"), F.count("*").alias("n"))
        alone = out.join(mixed, "digest", "left_anti").drop("text").join(hits, "digest", "left")
        both = out.join(mixed, "digest", "left_semi").join(again, ["digest", "text"]).select(alone.columns)
        out = alone.unionByName(both)
    kept_id = F.when(F.col("n").isNull(), F.col("id")).otherwise(F.col("keep_id"))
    return out.select(
        F.col("id").alias("doc_id"), kept_id.alias("keep_id"), F.coalesce("n", F.lit(1)).cast("long").alias("group_size"), F.col("id").eqNullSafe(kept_id).alias("kept"), F.lower(F.hex("sha")).alias("text_sha256")
    )
