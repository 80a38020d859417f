"""From raw documents to token ids: toxic documents go, repeated lines go, one document of each
group of near copies stays, documents with benchmark windows go, and the rest is encoded.

Each stage takes (spark, docs, sf_dir) and works on all that its predecessor kept. Texts change in
the second stage only; n_chars follows them. Rows that share a doc_id are kept or dropped alike where
a decision is by document (third stage); null texts count as empty and pass all stages.
"""

from __future__ import annotations

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from loomspan.llm import byte_bpe, toxicity
from loomspan.llm._common import flag_keys, key_filter, stored
from loomspan.llm.decontaminate import find_benchmark
from loomspan.llm.line_dedup import dedup_lines
from loomspan.llm.ngram_jaccard import similar_components

#: Documents that score this or more are rejected as toxic.
TOXIC_FROM = 0.3
VOCABULARY = "byte_bpe_multi_50k.tiktoken"


def _table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


#: Columns that a stage works with; all others pass by under names that nothing else has.
_USED = ("doc_id", "text", "n_chars")


def _apart(docs: DataFrame) -> DataFrame:
    """docs with all other columns called something else, so that no column of a stage clashes with one of theirs."""
    return docs.toDF(*(c if c in _USED else f"passed_{i}" for i, c in enumerate(docs.columns)))


def _back(out: DataFrame, docs: DataFrame) -> DataFrame:
    """What became of ``_apart(docs)``, with the columns of docs."""
    return out.select(_apart(docs).columns).toDF(*docs.columns)


def drop_toxic(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    own = _apart(docs)
    model = toxicity.train(own, _table(spark, sf_dir, "labels"))
    return _back(toxicity.score_toxicity(own, model).where(F.col("score") < TOXIC_FROM), docs)


def drop_repeated_lines(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    out = dedup_lines(_apart(docs))
    if "n_chars" in docs.columns:
        kind = out.schema["n_chars"].dataType
        out = out.withColumn("n_chars", F.when(F.col("n_dropped") > 0, F.length("text").cast(kind)).otherwise(F.col("n_chars")))
    return _back(out, docs)


def drop_near_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Keeps the document with the least doc_id of each component. Only texts that may go are shuffled."""
    own = _apart(docs)
    found = similar_components(own)
    gone = stored(found.where("component_id <> doc_id").select("doc_id").distinct(), narrow=True)
    flagged = flag_keys(own, "doc_id", key_filter(gone, "doc_id"), "maybe")
    sure = flagged.where("not maybe").select(own.columns)
    return _back(sure.unionByName(flagged.where("maybe").select(own.columns).join(gone, "doc_id", "left_anti").select(own.columns)), docs)


def drop_benchmark(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return _back(find_benchmark(_apart(docs), _table(spark, sf_dir, "benchmark")).where("n_hit = 0"), docs)


def encode(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    out = byte_bpe.encode_documents(_apart(docs), public_tokenizers.path(VOCABULARY), keep_ids=True)
    return out.select("doc_id", "n_tokens", "token_ids", "ids_sha256", "decoded_sha256")


STAGES = [
    ("toxicity", drop_toxic),
    ("line_dedup", drop_repeated_lines),
    ("ngram_jaccard", drop_near_copies),
    ("decontamination", drop_benchmark),
    ("byte_bpe", encode),
]

#: SQL cannot express the trained classifier of the first stage.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = _table(spark, sf_dir, "documents")
    for _, stage in STAGES:
        docs = stored(stage(spark, docs, sf_dir))
    return docs
