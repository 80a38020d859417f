import hashlib
from collections import Counter, defaultdict

import numpy as np
import pyarrow as pa
import pyarrow.parquet as pq
import pytest
from pyspark.sql import functions as F

from loomspan.llm import ngram_jaccard
from loomspan.llm.exact_dedup import MergeIndex, exact_dedup
from loomspan.llm._common import words_at
from loomspan.llm.components import components
from loomspan.llm.line_dedup import Shard, _hashed, build_shard, dedup_lines
from loomspan.llm.ngram_jaccard import similar_components
from tests.llm.cases import documents, empty, frame, near, text


def brute_exact(rows):
    groups = defaultdict(list)
    for i, t in rows:
        groups[t or ""].append(i)
    return {(i, max(groups[t or ""]), len(groups[t or ""]), i == max(groups[t or ""]), hashlib.sha256((t or "").encode()).hexdigest()) for i, t in rows}


def test_exact(spark):
    assert {tuple(r) for r in exact_dedup(frame(spark)).collect()} == brute_exact(documents())
    assert exact_dedup(empty(spark)).collect() == []


def test_exact_verifies_bytes(spark):
    """With a digest of four bits most texts collide, and the groups are still those of equal bytes."""
    weak = lambda c: F.unhex(F.concat(F.lit("0"), F.substring(F.sha2(c, 256), 1, 1)))
    assert {tuple(r) for r in exact_dedup(frame(spark), digest=weak, memtable_rows=3).collect()} == brute_exact(documents())


def test_lookup_probes_the_runs_by_digest(spark):
    index = MergeIndex(spark, memtable_rows=4)
    sha = lambda k: hashlib.sha256(str(k).encode()).digest()
    for ids in (range(0, 20), range(10, 30)):
        index.flush(spark.createDataFrame([(sha(k), 100 + k) for k in ids], "digest binary, id long"))
    found = index.lookup([sha(3), sha(15), sha(99)])
    for _ in range(2):
        assert {bytes(r.digest): (r.keep_id, r.n) for r in found.collect()} == {sha(3): (103, 1), sha(15): (115, 2)}
        index.compact()
        found = index.lookup([sha(3), sha(15), sha(99)])
    plan = found._jdf.queryExecution().executedPlan().toString()
    assert "PushedFilters: [In(digest" in plan or "PushedFilters: [IsNotNull(digest), In(digest" in plan
    assert index.lookup([]).collect() == []
    assert {bytes(r.digest) for r in index.lookup([sha(k) for k in range(50)]).collect()} == {sha(k) for k in range(30)}


def test_filters_are_sized_for_their_row_groups(spark, tmp_path):
    """Runs and compacted levels have row groups of about a memtable, for which the filters are sized."""
    index = MergeIndex(spark, str(tmp_path), memtable_rows=2000)
    index.flush(spark.range(20_000).select(F.unhex(F.sha2(F.col("id").cast("string"), 256)).alias("digest"), "id").coalesce(1))
    for _ in range(2):
        files = [pq.ParquetFile(f).metadata for f in tmp_path.glob(f"level{len(index.levels) - 1}-*/*.parquet")]
        groups = [m.row_group(k).num_rows for m in files for k in range(m.num_row_groups)]
        assert sum(groups) == 20_000 and max(groups) < 4000 and len(groups) >= 6
        index.compact()
    sha = hashlib.sha256(b"77").digest()
    assert [(r.keep_id, r.n) for r in index.lookup([sha]).collect()] == [(77, 1)]


@pytest.mark.parametrize("keep", ["largest", "smallest"])
def test_levels_fill_and_merge(spark, keep):
    """Loads one after the other: at most ``fanout`` - 1 tables wait in a level, and no row is lost or counted twice."""
    index, best, want = MergeIndex(spark, keep=keep, memtable_rows=3, fanout=2), max if keep == "largest" else min, {}
    sha = lambda k: hashlib.sha256(str(k).encode()).digest()
    for load in range(5):
        rows = [(sha(k % 7), 10 * load + k) for k in range(load, load + 6)]
        index.add(spark.createDataFrame(rows, "digest binary, id long"))
        for d, i in rows:
            old = want.get(d, (i, 0))
            want[d] = (best(old[0], i), old[1] + 1)
        assert {bytes(r.digest): (r.keep_id, r.n) for r in index.lookup(sorted(want)).collect()} == want
    assert [len(x) for x in index.levels] == [1, 0, 1]
    assert {bytes(r.digest): (r.keep_id, r.n) for r in index.compact().collect()} == want
    assert [len(x) for x in index.levels] == [0, 0, 1]
    assert MergeIndex(spark).lookup([sha(1)]).collect() == []


def test_exact_smallest_and_nulls(spark):
    rows = [(5, "a"), (2, "a"), (None, "a"), (None, None), (7, "")]
    got = {(r.doc_id, r.keep_id, r.group_size, r.kept) for r in exact_dedup(frame(spark, rows)).collect()}
    assert got == {(5, 5, 3, True), (2, 5, 3, False), (None, 5, 3, False), (None, 7, 2, False), (7, 7, 2, True)}
    got = {(r.doc_id, r.keep_id) for r in exact_dedup(frame(spark, rows), keep="smallest").collect()}
    assert (5, 2) in got and (2, 2) in got


def brute_lines(rows, least=20, docs=3):
    strip = " \t\n\x0b\x0c\r"
    key = lambda x: "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in x.strip(strip))
    holders = defaultdict(set)
    for i, t in rows:
        for line in (t or "").split("\n"):
            holders[key(line)].add(i)
    out = {}
    for i, t in rows:
        lines = (t or "").split("\n")
        gone = [len(key(x)) >= least and len(holders[key(x)]) >= docs and max(holders[key(x)]) != i for x in lines]
        out[i] = (len(lines), sum(gone), "\n".join(x for x, g in zip(lines, gone, strict=True) if not g))
    return out


@pytest.mark.parametrize("max_bytes", [64 << 20, 0])
def test_lines(spark, max_bytes):
    got = {r.doc_id: (r.n_lines, r.n_dropped, r.text or "") for r in dedup_lines(frame(spark), max_bytes=max_bytes, shard_keys=2).collect()}
    assert got == brute_lines(documents())
    assert dedup_lines(empty(spark), max_bytes=max_bytes).collect() == []
    assert "lang" in dedup_lines(frame(spark)).columns


@pytest.mark.parametrize("max_bytes", [64 << 20, 0])
def test_lines_keep_columns_of_any_name(spark, max_bytes):
    line = "this line is long enough to count"
    docs = frame(spark, [(k, f"{line}\n{k}") for k in range(4)], extra=False).selectExpr("doc_id AS id", "text", "'a' AS __drop", "'b' AS __digest", "'c' AS key")
    out = dedup_lines(docs, doc_id="id", max_bytes=max_bytes)
    assert out.columns == ["id", "text", "__drop", "__digest", "key", "n_lines", "n_dropped"]
    assert sorted(map(tuple, out.collect())) == [(k, f"{line}\n3" if k == 3 else str(k), "a", "b", "c", 2, int(k < 3)) for k in range(4)]


@pytest.mark.parametrize("max_bytes", [64 << 20, 0])
def test_lines_of_repeated_documents(spark, max_bytes):
    """Rows that share a doc_id are holders one by one, and all of the largest keep the line."""
    line = "this line is long enough to count"
    got = sorted((r.doc_id, r.n_dropped, r.text) for r in dedup_lines(frame(spark, [(1, line), (2, line), (2, line + "\nx")]), max_bytes=max_bytes).collect())
    assert got == [(1, 1, ""), (2, 0, line), (2, 0, line + "\nx")]


def test_lines_null_ids(spark):
    line = "this line is long enough to count"
    got = [(r.doc_id, r.n_dropped) for r in dedup_lines(frame(spark, [(None, line), (1, line), (2, line)])).collect()]
    assert sorted(got, key=str) == [(1, 1), (2, 0), (None, 1)]


def test_perfect_hash_is_minimal():
    """Every line is found by its bytes, also where hashes are shared, and no other line is."""
    keys = [f"line {k}".encode() for k in range(5000)]
    ends = np.cumsum([len(k) for k in keys])
    starts = ends - [len(k) for k in keys]
    words = words_at(np.frombuffer(b"".join(keys), np.uint8))
    for hi, lo in ((_hashed(keys, 0), _hashed(keys, 1)), (_hashed(keys, 0) % 700, _hashed(keys, 1) % 3)):
        shard = Shard(build_shard(hi, lo, np.arange(5000), np.arange(5000) * 7, keys))
        found, last = shard.probe(hi, lo, words, starts, ends)
        assert found.all() and (last == np.arange(5000) * 7).all() and len(shard.count) == len(np.unique(hi))
        found, _ = shard.probe(hi, lo, words, starts, ends - 1)
        assert not found[5:10].any() and found[10:].any() == (len(shard.count) < 5000)


def brute_components(rows):
    sets = {}
    for i, t in rows:
        w = (t or "").encode().lower().split()
        sets[i] = frozenset(tuple(w[k : k + 5]) for k in range(max(1, len(w) - 4))) if w else frozenset()
    parent = {i: i for i in sets}

    def find(x):
        while parent[x] != x:
            x = parent[x]
        return x

    for a in sets:
        for b in sets:
            if a < b and sets[a] and 100 * len(sets[a] & sets[b]) >= 75 * len(sets[a] | sets[b]):
                x, y = sorted((find(a), find(b)))
                parent[y] = x
    return {i: (len(s), find(i)) for i, s in sets.items()}


def test_components(spark):
    got = {r.doc_id: (r.n_shingles, r.component_id) for r in similar_components(frame(spark)).collect()}
    assert got == brute_components(documents())
    assert max(Counter(c for _, c in got.values()).values()) >= 4
    assert similar_components(empty(spark)).collect() == []


def test_components_in_blocks_and_refined(spark, monkeypatch):
    """Tiny bounds send the groups through the refinement and the pairs of blocks; the links are the same."""
    monkeypatch.setattr(ngram_jaccard, "BLOCK", 4)
    monkeypatch.setattr(ngram_jaccard, "REFINE_FROM", 2)
    base = text(7, 120)
    rows = [(i, near(base, i % 9, i)) for i in range(40)] + [(100 + i, text(7, 60) + " " + text(200 + i, 40)) for i in range(20)]
    got = {r.doc_id: (r.n_shingles, r.component_id) for r in similar_components(frame(spark, rows)).collect()}
    assert got == brute_components(rows)


def test_all_shingles_are_counted(spark):
    """Every shared shingle passes the steps of its count, in all the hash range; few others pass one."""
    rows = [(i, text(7, 60) + f" end{i} " + text(300 + i // 3, 30)) for i in range(30)]
    t = ngram_jaccard.Texts(pa.RecordBatch.from_arrays([pa.array([t for _, t in rows], pa.large_string())], ["text"]), "text")
    h, n = np.unique(ngram_jaccard.shingle_sets(t, 5)[1], return_counts=True)
    source = ngram_jaccard.Source(frame(spark, rows).select(F.col("doc_id").alias("id"), "text"), 5, np.zeros(0, np.uint64))
    blocks = ngram_jaccard._blocks(source, 8, ngram_jaccard.Threshold(75), None, True)
    levels = ngram_jaccard.Levels(*ngram_jaccard._levels(blocks, 8).value)
    got = levels.of(h, ngram_jaccard._fragment(h, 8))
    want = (n[:, None] >= np.array(ngram_jaccard.THRESHOLDS)).sum(1)
    assert len(np.unique(want)) == 3 and (got >= want).all() and (got > want).mean() < 0.15


def test_levels_without_room_for_the_rarer(spark):
    rng = np.random.default_rng(4)
    token = np.unique(rng.integers(0, 1 << 40, 50_000).astype(np.uint64))
    n = np.where(np.arange(len(token)) % 50 == 0, 100, 2)
    levels = ngram_jaccard.Levels([(1, ngram_jaccard.level_filters(token, n, 9000))], 3)
    got = levels.of(token, np.ones(len(token), np.int64))
    assert (got[n == 100] == 8).all() and (got[n == 2] > 0).mean() < 0.05
    assert not levels.of(token, np.zeros(len(token), np.int64)).any()


@pytest.mark.parametrize("most", [1 << 60, 1 << 32, 1 << 20, 3])
def test_packed_tokens(most):
    rng = np.random.default_rng(2)
    for n in (0, 1, 2, 50, 40_000):
        tokens = np.sort(rng.integers(0, most, n, dtype=np.uint64))
        raw = ngram_jaccard.packed(tokens)
        assert ngram_jaccard.unpacked(raw).tolist() == tokens.tolist() and len(raw) <= 8 * n + 9


@pytest.mark.parametrize("alone", [1 << 20, 0])
def test_components_of_links(spark, monkeypatch, alone):
    monkeypatch.setattr("loomspan.llm.components.MOST_ALONE", alone)
    rng = np.random.default_rng(5)
    links = [(int(a), int(b)) for a, b in rng.integers(-400, 400, (300, 2))] + [(1000 + k, 1001 + k) for k in range(60)] + [(2000, 2000 + k) for k in range(40)]
    parent = {}

    def find(x):
        while parent.setdefault(x, x) != x:
            x = parent[x]
        return x

    for a, b in links:
        x, y = sorted((find(a), find(b)))
        parent[y] = x
    want = {x: find(x) for a, b in links if a != b for x in (a, b)}
    got = components(spark.createDataFrame(links, "a long, b long").repartition(3))
    assert {r.node: r.component for r in got.collect()} == want and got.count() == len(want)
    assert components(spark.createDataFrame([], "a long, b long")).collect() == []


def test_sets_that_share_a_digest_are_different_nodes(spark, monkeypatch):
    rows = [(k, f"some words {k % 3} and more and more") for k in range(9)]
    t = ngram_jaccard.Texts(pa.RecordBatch.from_arrays([pa.array([t for _, t in rows], pa.large_string())], ["text"]), "text")
    row, h, n = ngram_jaccard.shingle_sets(t, 5)
    whole = ngram_jaccard.digests_of
    monkeypatch.setattr(ngram_jaccard, "digests_of", lambda *a: whole(*a) if a[3] else whole(*a) * np.uint64(0))
    assert set(ngram_jaccard.nodes_of(row, h, n, np.zeros(0, np.uint64)).tolist()) == {0}
    nodes = ngram_jaccard.nodes_of(row, h, n, np.zeros(1, np.uint64)).tolist()
    assert len(set(nodes)) == 3 and nodes[:3] * 3 == nodes


def test_every_link_is_offered(spark, monkeypatch):
    """All pairs of near copies, in one unit and in pairs of blocks, not only those of a spanning forest."""
    base = text(7, 120)
    rows = [(i, near(base, i % 9, i)) for i in range(30)] + [(100 + i, text(200 + i, 40)) for i in range(5)] + [(200, text(200, 40))]
    sets, first = {}, {}
    for i, t in rows:
        w = t.encode().lower().split()
        sets[i] = frozenset(tuple(w[k : k + 5]) for k in range(max(1, len(w) - 4)))
        first.setdefault(sets[i], i)
    ids = sorted(first.values())
    want = [(a, b) for a in ids for b in ids if a < b and 100 * len(sets[a] & sets[b]) >= 75 * len(sets[a] | sets[b])]
    assert len(want) > len(ids)
    for block in (4096, 4):
        monkeypatch.setattr(ngram_jaccard, "BLOCK", block)
        assert sorted(map(tuple, ngram_jaccard.similar_links(frame(spark, rows)).collect())) == want


def test_small_pairs_are_counted_by_fragment(monkeypatch):
    """Two small sets that differ too much in their first fragment are given up there."""
    a, b = (np.sort(np.array([(k << 58) + x for k in range(64)], np.uint64)) for x in (1, 2))
    unit, calls, plain = ngram_jaccard.Unit([1, 2], [0, 0], [a, b], 75), [], np.intersect1d
    monkeypatch.setattr(np, "intersect1d", lambda *x, **y: calls.append(1) or plain(*x, **y))
    assert len(unit.links()[0]) == 0 and len(calls) == 1


def test_components_null_ids(spark):
    t = text(5)
    got = sorted(((r.doc_id, r.component_id) for r in similar_components(frame(spark, [(None, t), (4, t), (5, None), (None, None)])).collect()), key=str)
    assert got == [(4, None), (5, 5), (None, None), (None, None)]
