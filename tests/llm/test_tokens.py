import base64
import glob
import hashlib
import random
import struct
import zlib

import numpy as np
import public_tokenizers
import pyarrow as pa
import pyarrow.parquet as pq
import pytest
import tiktoken
from pyspark.sql import functions as F
from tokenizers import Tokenizer

from loomspan.llm import byte_bpe
from loomspan.llm._bpe import merge, pre_tokens, split
from loomspan.llm._common import Texts
from loomspan.llm.token_counts import count_tokens, prove_whole
from loomspan.llm.token_files import encode_documents, read_tokens, starts, token_round_trip, write_tokens
from tests.llm.cases import documents, empty, frame

JSON, RANKS = public_tokenizers.path("byte_bpe_50k.json"), public_tokenizers.path("byte_bpe_multi_50k.tiktoken")


@pytest.fixture(scope="module")
def wanted():
    tok = Tokenizer.from_file(JSON)
    return {i: tok.encode(t or "", add_special_tokens=False).ids for i, t in documents()}


def test_split_follows_the_pattern():
    random.seed(3)
    letters = list("ab'stmdrevl  \n\t\r 12½.,!-é　漢​\U0001f600٣\x1c")
    rows = ["".join(random.choices(letters, k=random.randint(0, 25))) for _ in range(3000)]
    t = Texts(pa.RecordBatch.from_arrays([pa.array(rows, pa.large_string())], ["text"]), "text")
    row, start, end, unsure = split(t)
    got = [[] for _ in rows]
    for r, s, e in zip(row, start, end, strict=True):
        got[r].append(t.data[s:e].tobytes().decode())
    assert got == [pre_tokens(x) for x in rows] and not len(unsure)


def test_counts(spark, wanted):
    got = {r.doc_id: r.n_tokens for r in count_tokens(frame(spark), JSON).collect()}
    assert got == {i: len(x) for i, x in wanted.items()}
    assert count_tokens(empty(spark), JSON).collect() == []
    assert len(prove_whole(JSON)) > 40_000


def test_files(spark, wanted, tmp_path):
    want, start = {}, 0
    for i in sorted(wanted):
        ids = [*wanted[i], 0]
        want[i] = (start, len(ids), zlib.crc32(struct.pack(f"<{len(ids)}I", *ids)))
        start += len(ids)
    got = {r.doc_id: (r.start, r.n_tokens, r.ids_crc32) for r in token_round_trip(frame(spark), JSON).collect()}
    assert got == want
    assert token_round_trip(empty(spark), JSON).collect() == []
    folder = str(tmp_path / "tokens")
    write_tokens(encode_documents(frame(spark), JSON), folder)
    one = read_tokens(spark, folder).where("doc_id = 3")
    assert one.first().tokens == [*wanted[3], 0]
    assert "PushedFilters: [IsNotNull(doc_id), EqualTo(doc_id,3)]" in one._jdf.queryExecution().toString()


def test_file_layout(spark, tmp_path):
    """Dictionaries, several row groups and pages, and an index for each column."""
    folder = str(tmp_path / "tokens")
    rows = spark.range(6000).selectExpr("id AS doc_id", "repeat(concat('word ', id % 50, ' '), 40) AS text")
    write_tokens(encode_documents(rows, JSON).coalesce(1), folder, **{"parquet.block.size": "20000"})
    (path,) = glob.glob(f"{folder}/part-*.parquet")
    meta = pq.ParquetFile(path).metadata
    assert meta.num_row_groups > 1
    for g in range(meta.num_row_groups):
        for c in range(meta.row_group(g).num_columns):
            col = meta.row_group(g).column(c)
            assert col.has_column_index and col.has_offset_index and col.compression == "ZSTD"
            if col.path_in_schema.startswith("tokens"):
                assert any("DICTIONARY" in e for e in col.encodings)


def test_starts_follow_file_numbers(spark):
    counts = spark.createDataFrame([("part-99999-a.parquet", 5), ("part-100000-a.parquet", 7), ("part-00002-a.parquet", 2)], "file string, n_tokens int")
    rows = counts.withColumn("row", F.lit(0).cast("long"))
    assert {r.file[:11]: r.start for r in starts(rows, counts).collect()} == {"part-00002-": 0, "part-99999-": 2, "part-100000": 7}


@pytest.mark.parametrize("head_bytes", [96 << 20, 300])
def test_byte_bpe(spark, head_bytes):
    ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, open(RANKS, "rb"))}
    enc = tiktoken.Encoding("own", pat_str=public_tokenizers.PATTERN, mergeable_ranks=ranks, special_tokens={})
    out = byte_bpe.encode_documents(frame(spark), RANKS, head_bytes=head_bytes, keep_ids=True)
    got = {r.doc_id: r for r in out.collect()}
    for i, t in documents():
        ids = enc.encode_ordinary(t or "")
        assert got[i].token_ids == ids and got[i].n_tokens == len(ids)
        assert got[i].ids_sha256 == hashlib.sha256(",".join(map(str, ids)).encode()).hexdigest()
        assert got[i].decoded_sha256 == hashlib.sha256((t or "").encode()).hexdigest()
    assert byte_bpe.encode_documents(empty(spark), RANKS, head_bytes=head_bytes).collect() == []


def test_heap_merge_equals_the_plain_rule():
    ranks = {b"ab": 1, b"ba": 0, b"aba": 2, b"bb": 3, b"abab": 4}

    def plain(piece):
        parts = [piece[k : k + 1] for k in range(len(piece))]
        while True:
            best = min(((ranks[a + b], k) for k, (a, b) in enumerate(zip(parts, parts[1:], strict=False)) if a + b in ranks), default=None)
            if best is None:
                return parts
            parts[best[1] : best[1] + 2] = [parts[best[1]] + parts[best[1] + 1]]

    rng = np.random.default_rng(0)
    for _ in range(300):
        piece = bytes(rng.choice([97, 98], rng.integers(1, 14)).tolist())
        assert merge(piece, lambda a, b: ranks.get(a + b)) == plain(piece)


@pytest.mark.parametrize("texts", [["a"], [None], [""], [" \t\n"], ["the", " and", "of", "in", "to"], ["a"] * 7])
def test_counts_where_every_word_is_proved_whole(spark, texts):
    tok = Tokenizer.from_file(JSON)
    rows = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string").repartition(len(texts))
    got = {r.doc_id: r.n_tokens for r in count_tokens(rows, JSON).collect()}
    assert got == {i: len(tok.encode(t or "", add_special_tokens=False).ids) for i, t in enumerate(texts)}
    assert {r.doc_id: r.n_tokens - 1 for r in token_round_trip(rows, JSON).collect()} == got
