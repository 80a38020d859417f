"""Token ids in Parquet files made for selective reads, and reading them back.

Documents are range-partitioned and sorted by id, encoded, and written as (doc_id, n_tokens, tokens)
with dictionary-encoded token lists, small row groups and pages, and page indexes (which Spark's
writer adds), so that a reader of some documents or of the metadata alone skips the other pages.
Positions in the stream of all tokens are not stored: they follow from the counts, by a sum per
file, a sum over files (one row each) and a running sum within each file.

Defined results: null text is the end id alone; rows are ordered by doc_id, then text, null doc_id
first; repeated rows are kept; an empty table gives files without rows.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from loomspan.llm._bpe import WordTable, gather, split, valid, word_ids
from loomspan.llm._common import Texts, column, kept, shared_folder, text_slices
from loomspan.llm.token_counts import library_ids, special_rows, tokenizer

SCHEMA = "doc_id long, n_tokens int, tokens array<int>"
#: Options of the writer: 8 MB row groups, 64 KB pages of at most 1000 rows, dictionaries.
WRITER = {
    "compression": "zstd",
    "parquet.block.size": str(8 << 20),
    "parquet.page.size": str(64 << 10),
    "parquet.page.row.count.limit": "1000",
    "parquet.enable.dictionary": "true",
    "parquet.columnindex.truncate.length": "64",
}


class Encoder:
    """Token ids of texts. Each distinct pre-token goes through the library's model once a worker (in a table of bounded size)."""

    def __init__(self, path: str):
        self.path = path
        self.specials = [t.content for t in tokenizer(path).get_added_tokens_decoder().values()]
        self.table = WordTable(word_ids(tokenizer(path).model))

    def encode(self, t: Texts) -> list[np.ndarray]:
        t = valid(t)
        row, start, end, unsure = split(t)
        if not len(row):
            return [np.zeros(0, np.int32)] * t.rows
        place = self.table.find(t, start, end)
        size = self.table.sizes(place)
        ids = gather(self.table.values, self.table.offsets[place], size)
        ends = np.concatenate(([0], np.cumsum(np.bincount(row, size, minlength=t.rows).astype(np.int64))))
        out = [ids[a:b] for a, b in zip(ends[:-1], ends[1:], strict=True)]
        for i in np.union1d(unsure, special_rows(t, self.specials)):
            out[i] = np.array(library_ids(self.path, t.text(i).decode()), np.int32)
        return out


def encode_documents(docs: DataFrame, path: str, *, text: str = "text", doc_id: str = "doc_id", end_id: int = 0) -> DataFrame:
    """(doc_id, n_tokens, tokens) in ascending order of doc_id."""
    end = np.array([end_id], np.int32)

    def encoded(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encoder = kept("encoder", path, lambda: Encoder(path))
        for t in text_slices(batches, keep="encoder"):
            parts = encoder.encode(t)
            n = np.array([len(x) + 1 for x in parts], np.int32)
            offsets = np.concatenate(([0], np.cumsum(n))).astype(np.int32)
            tokens = pa.ListArray.from_arrays(pa.array(offsets), pa.array(np.concatenate([y for x in parts for y in (x, end)])))
            yield pa.RecordBatch.from_arrays([column(t.batch, "doc_id"), pa.array(n), tokens], ["doc_id", "n_tokens", "tokens"])

    rows = docs.select(F.col(doc_id).cast("long").alias("doc_id"), F.col(text).alias("text"))
    placed = rows.repartitionByRange("doc_id", F.xxhash64("text")).sortWithinPartitions("doc_id", "text")
    return placed.mapInArrow(encoded, SCHEMA)


def write_tokens(encoded: DataFrame, folder: str, **options: str) -> None:
    encoded.write.options(**(WRITER | options)).parquet(folder)


def read_tokens(spark: SparkSession, folder: str) -> DataFrame:
    """(doc_id, n_tokens, tokens, file, row): a read of some columns or ids touches only their pages."""
    return spark.read.schema(SCHEMA).parquet(folder).select("*", F.col("_metadata.file_name").alias("file"), F.col("_metadata.row_index").alias("row"))


def starts(rows: DataFrame, counts: DataFrame) -> DataFrame:
    """rows with start, the number of tokens of all documents before. counts(file, n_tokens): a read of these columns alone."""
    files = counts.groupBy("file").agg(F.sum("n_tokens").alias("n"))
    # Part files are numbered in the order of their ranges; beyond 99 999 names do not sort as numbers do.
    number = F.regexp_extract("file", r"part-(\d+)", 1).cast("long")
    before = F.coalesce(F.sum("n").over(Window.orderBy(number, "file").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    files = files.select("file", before.alias("base"))
    own = F.coalesce(F.sum("n_tokens").over(Window.partitionBy("file").orderBy("row").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    return rows.join(files, "file").withColumn("start", F.col("base") + own).drop("base")


def token_index(spark: SparkSession, folder: str) -> DataFrame:
    """(doc_id, start, n_tokens, ids_crc32) read back from the files."""

    def sums(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            lists = column(b, "tokens")
            values = lists.flatten().to_numpy(zero_copy_only=False).astype("<u4")
            ends = np.concatenate(([0], np.cumsum(np.diff(lists.offsets.to_numpy()))))
            crc = [zlib.crc32(values[s:e].tobytes()) for s, e in zip(ends[:-1], ends[1:], strict=True)]
            yield pa.RecordBatch.from_arrays([*(column(b, c) for c in ("doc_id", "n_tokens", "file", "row")), pa.array(crc, pa.int64())], ["doc_id", "n_tokens", "file", "row", "ids_crc32"])

    rows = read_tokens(spark, folder).select("doc_id", "n_tokens", "tokens", "file", "row").mapInArrow(sums, "doc_id long, n_tokens int, file string, row long, ids_crc32 long")
    return starts(rows, read_tokens(spark, folder).select("file", "n_tokens")).select("doc_id", F.col("start").cast("long").alias("start"), F.col("n_tokens").cast("long").alias("n_tokens"), "ids_crc32")


def token_round_trip(docs: DataFrame, path: str, **options) -> DataFrame:
    """Writes docs as token files into the shared folder and reads the index back."""
    spark = docs.sparkSession
    folder = shared_folder(spark)
    write_tokens(encode_documents(docs, path, **options), folder)
    return token_index(spark, folder)
