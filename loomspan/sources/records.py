"""Rows by id in Parquet files that hold a range of ids each: a look-up opens only files that may hold an id.

Rows are dealt by range of id and sorted within a file; files have Bloom filters on the id and small row groups, and a table
beside them has the least and the greatest id of each file. A look-up reads that table, one row a file, once.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

#: Look-ups of up to so many ids choose files on the driver; more are joined.
MOST_IDS = 10_000


class Records:
    """rows(id, ...) as ``write`` has left them at a path."""

    def __init__(self, spark: SparkSession, path: str):
        self.spark, self.path = spark, path
        self.rows, self.map = spark.read.parquet(path), spark.read.parquet(f"{path}-files")
        self._files: list | None = None

    @classmethod
    def write(cls, rows: DataFrame, path: str, row_group: int = 8 << 20) -> None:
        placed = rows.repartitionByRange(F.asc_nulls_first("id")).sortWithinPartitions("id")
        options = {"parquet.bloom.filter.enabled#id": "true", "parquet.block.size": str(row_group)}
        placed.write.options(**options).parquet(path)
        ids = rows.sparkSession.read.parquet(path).select("id", F.col("_metadata.file_name").alias("file"))
        ids.groupBy("file").agg(F.min("id").alias("least"), F.max("id").alias("most")).coalesce(1).write.parquet(f"{path}-files")

    def files(self, ids: list[int]) -> list[str]:
        """The files whose range holds one of these ids. The map is read once: a row a file."""
        if self._files is None:
            self._files = self.map.where("least is not null").collect()
        return sorted(f"{self.path}/{f.file}" for f in self._files if any(f.least <= i <= f.most for i in ids))

    def find(self, ids: list[int]) -> DataFrame:
        """All rows with one of these ids."""
        if len(ids) > MOST_IDS:
            return self.rows.join(self.spark.createDataFrame([(i,) for i in set(ids)], "id long"), "id", "left_semi")
        chosen = self.files(ids)
        found = self.spark.read.schema(self.rows.schema).parquet(*chosen) if chosen else self.rows.limit(0)
        return found.where(F.col("id").isin(list(ids)))

    def latest(self, ids: list[int], order: str = "seq") -> DataFrame:
        """One row an id: the last by order."""
        whole = F.struct(*self.rows.columns)
        return self.find(ids).groupBy("id").agg(F.max_by(whole, order).alias("r")).select("r.*")

    def of_hits(self, hits: DataFrame) -> DataFrame:
        """hits(id, ...) with the rows of their ids; hits without one go. Few distinct ids open few files, more are joined with all."""
        some = hits.select("id").distinct().limit(MOST_IDS + 1).collect()
        rows = self.rows if len(some) > MOST_IDS else self.find([r.id for r in some if r.id is not None])
        return hits.join(rows, "id")
