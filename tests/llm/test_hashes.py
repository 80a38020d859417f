"""Words, lines and shingles whose hashes collide, or would under a weak hash."""

import base64
import hashlib

import numpy as np
import public_tokenizers
import pyarrow as pa
import pytest
import tiktoken
from tokenizers import Tokenizer

from loomspan.llm import _common
from loomspan.llm._common import Texts, grouped
from loomspan.llm.byte_bpe import encode_documents
from loomspan.llm.decontaminate import find_benchmark
from loomspan.llm.line_dedup import dedup_lines
from loomspan.llm.ngram_jaccard import similar_components
from loomspan.llm.token_counts import count_tokens
from loomspan.llm.token_files import encode_documents as token_lists
from tests.llm.cases import documents, frame
from tests.llm.test_dedup import brute_components, brute_lines

JSON, RANKS = public_tokenizers.path("byte_bpe_50k.json"), public_tokenizers.path("byte_bpe_multi_50k.tiktoken")


def mirrored(n):
    """Two strings of a and b that many polynomial hashes take for the same."""
    s = "a"
    while len(s) < n:
        s += s.translate({97: 98, 98: 97})
    return s, s.translate({97: 98, 98: 97})


def mirrored_documents():
    rows = []
    for n in (1024, 2048, 4096):
        a, b = mirrored(n)
        rows += [a, b, b + " ", b + "  ", f"{a} {b} one two three four", f"{b} {a} one two three four"]
    return list(enumerate(rows))


def check_all(spark, rows, parts):
    docs = frame(spark, rows, extra=False).repartition(parts)
    tok = Tokenizer.from_file(JSON)
    ids = {i: tok.encode(t or "", add_special_tokens=False).ids for i, t in rows}
    assert {r.doc_id: r.n_tokens for r in count_tokens(docs, JSON).collect()} == {i: len(x) for i, x in ids.items()}
    assert {r.doc_id: r.tokens for r in token_lists(docs, JSON).collect()} == {i: [*x, 0] for i, x in ids.items()}
    ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, open(RANKS, "rb"))}
    enc = tiktoken.Encoding("own", pat_str=public_tokenizers.PATTERN, mergeable_ranks=ranks, special_tokens={})
    want = {i: (enc.encode_ordinary(t or ""), hashlib.sha256((t or "").encode()).hexdigest()) for i, t in rows}
    for head_bytes in (96 << 20, 200):
        assert {r.doc_id: (r.token_ids, r.decoded_sha256) for r in encode_documents(docs, RANKS, head_bytes=head_bytes, keep_ids=True).collect()} == want
    for max_bytes in (64 << 20, 0):
        assert {r.doc_id: (r.n_lines, r.n_dropped, r.text or "") for r in dedup_lines(docs, max_bytes=max_bytes).collect()} == brute_lines(rows)


@pytest.mark.parametrize("parts", [1, 4])
def test_mirrored_strings(spark, parts):
    rows = mirrored_documents()
    check_all(spark, rows, parts)
    got = {r.doc_id: (r.n_shingles, r.component_id) for r in similar_components(frame(spark, rows, extra=False).repartition(parts)).collect()}
    assert got == brute_components(rows)


@pytest.fixture
def weak(spark, monkeypatch):
    """Hashes of eight bits, in the driver and in new Python workers."""
    env = spark.sparkContext.environment
    env["LOOMSPAN_HASH_BITS"] = "8"
    monkeypatch.setattr(_common, "_KEPT_BITS", np.uint64(255))
    yield
    del env["LOOMSPAN_HASH_BITS"]


@pytest.mark.parametrize("parts", [1, 3])
def test_weak_hashes(spark, weak, parts):
    check_all(spark, documents(), parts)


def test_weak_hashes_of_windows(spark, weak):
    t = "a window of the benchmark has ten words or some more"
    got = {r.doc_id: (r.n_hit, r.hit_items) for r in find_benchmark(frame(spark, [(1, f"so {t} here"), (2, t[2:]), (3, documents()[3][1])], extra=False), spark.createDataFrame([(7, t)], "item_id long, text string")).collect()}
    assert got == {1: (11, ["7"]), 2: (10, ["7"]), 3: (0, [])}


def test_short_ranges_never_collide_and_groups_compare_bytes():
    rng = np.random.default_rng(0)
    found = {bytes(rng.integers(97, 101, rng.integers(1, 14)).astype(np.uint8)) for _ in range(20000)}
    words = [*found, *sorted(found)[:500]]
    t = Texts(pa.RecordBatch.from_arrays([pa.array([b"".join(words).decode()], pa.large_string())], ["text"]), "text")
    end = np.cumsum([len(w) for w in words])
    start = end - [len(w) for w in words]
    for kind in (0, 1):
        h = t.hashes(start, end, kind=kind)
        assert len(np.unique(h)) == len(found)
    lead, group, apart = grouped(t.words(), start, end, h & np.uint64(255))
    assert len(lead) == 256 and set(apart.tolist()) == {k for k, w in enumerate(words) if w != words[lead[group[k]]]}
