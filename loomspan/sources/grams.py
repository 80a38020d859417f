"""Texts in files with postings of their n-grams, so that a search for a substring opens only files that can hold it.

Rows are dealt by an order of the caller's (texts that are alike should stand together) and sorted within a file. For each file the
postings have the slots of all runs of four bytes of its lower-cased texts, a row a slot and file, sorted by slot. A search
reads the postings of its own slots only, takes the files that have all of them, and filters these by the text. Slots are hashes to
``SLOTS`` values: collisions open a file too many and lose none. Shorter needles than four bytes open all files.

Case is folded as Spark's lower does. Null texts hold nothing; the empty needle is in every text that is not null.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

WIDTH, SLOTS_BITS = 4, 20
#: Grams are taken of so many bytes at a time, rows of a batch and parts of long texts alike.
PIECE = 1 << 20


def slots(texts: list[bytes]) -> np.ndarray:
    """The distinct slots of the grams of some texts."""
    data = np.frombuffer(b"\xff".join(texts), np.uint8).astype(np.uint64)  # no text has this byte
    if len(data) < WIDTH:
        return np.zeros(0, np.int32)
    gram = sum(data[k : len(data) - WIDTH + 1 + k] << np.uint64(8 * k) for k in range(WIDTH))
    edge = sum((data[k : len(data) - WIDTH + 1 + k] == 255).astype(np.int8) for k in range(WIDTH)) > 0
    hashed = (gram[~edge] * np.uint64(0x9E3779B97F4A7C15)) >> np.uint64(64 - SLOTS_BITS)
    return np.unique(hashed).astype(np.int32)


def pieces(texts: Iterator[bytes], most: int) -> Iterator[list[bytes]]:
    """Texts in lists of about ``most`` bytes; longer ones in parts that share WIDTH - 1 bytes, so that no gram is lost."""
    held, size = [], 0
    for text in texts:
        for start in range(0, max(1, len(text) - WIDTH + 1), most):
            part = text[start : start + most + WIDTH - 1]
            if held and size + len(part) > most:
                yield held
                held, size = [], 0
            held.append(part)
            size += len(part)
    if held:
        yield held


class GramFiles:
    """Rows with a text column as ``write`` has left them at a path."""

    def __init__(self, spark: SparkSession, path: str, text: str = "text"):
        self.spark, self.path, self.text = spark, path, text
        self.rows, self.postings = spark.read.parquet(path), spark.read.parquet(f"{path}-grams")

    @classmethod
    def write(cls, rows: DataFrame, path: str, order: list[str], text: str = "text", files: int | None = None) -> GramFiles:
        """files: how many, by default as many as Spark makes of the rows."""
        spark = rows.sparkSession
        dealt = rows.repartitionByRange(files, *order) if files else rows.repartitionByRange(*order)
        dealt.sortWithinPartitions(*order).write.parquet(path)
        stored = spark.read.parquet(path).select(F.col("_metadata.file_name").alias("file"), F.lower(text).alias("t")).where("t is not null")

        def grams(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            # A bit a slot of the file that is being read; its rows may come in several batches.
            name, seen = None, np.zeros(1 << SLOTS_BITS, bool)

            def rows() -> pa.RecordBatch:
                found = np.flatnonzero(seen).astype(np.int32)
                return pa.RecordBatch.from_arrays([pa.array(found), pa.array([name], pa.string()).take(pa.array(np.zeros(len(found), np.int32)))], ["slot", "file"])

            for b in batches:
                changes = pc.run_end_encode(b.column(0))
                start = 0
                for end, file in zip(changes.run_ends.to_pylist(), changes.values.to_pylist(), strict=True):
                    if file != name:
                        if name is not None:
                            yield rows()
                        name, seen = file, np.zeros(1 << SLOTS_BITS, bool)
                    for some in pieces((t.as_buffer().to_pybytes() for t in b.column(1)[start:end].cast(pa.binary())), PIECE):
                        seen[slots(some)] = True
                    start = end
            if name is not None:
                yield rows()

        found = stored.mapInArrow(grams, "slot int, file string").distinct()
        found.repartitionByRange("slot").sortWithinPartitions("slot").write.option("parquet.block.size", str(4 << 20)).parquet(f"{path}-grams")
        return cls(spark, path, text)

    def files(self, needle: str) -> list[str] | None:
        """The files that may hold a needle; None for all."""
        # Lower-cased by Spark, as the texts are.
        folded = self.spark.range(1).select(F.lower(F.lit(needle))).first()[0]
        asked = slots([folded.encode()]).tolist()
        if not asked:
            return None
        held = self.postings.where(F.col("slot").isin(asked)).groupBy("file").agg(F.count("*").alias("n")).where(F.col("n") == len(asked))
        return sorted(f"{self.path}/{r.file}" for r in held.collect())

    def search(self, needle: str) -> DataFrame:
        """The rows whose text holds the needle, whatever the case."""
        chosen = self.files(needle)
        rows = self.rows if chosen is None else self.spark.read.schema(self.rows.schema).parquet(*chosen) if chosen else self.rows.limit(0)
        return rows.where(F.contains(F.lower(self.text), F.lower(F.lit(needle))))
