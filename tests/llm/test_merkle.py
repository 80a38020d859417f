import hashlib
import zlib

import pytest

from loomspan.llm.merkle import audited, fold, manifest


def sha(*parts):
    return hashlib.sha256("".join(parts).encode()).hexdigest()


def leaf(row):
    return sha(*("-" if v is None else f"{len(str(v).encode())}:{v}" for v in row))


def tree(nodes):
    """The root of a list of digests, and the siblings of each, by the rule."""
    paths, at = [[] for _ in nodes], list(range(len(nodes)))
    while len(nodes) > 1:
        for p, i in zip(paths, at, strict=True):
            p.append((nodes[i ^ 1] if i ^ 1 < len(nodes) else "", i & 1))
        nodes = [sha(*nodes[k : k + 2]) for k in range(0, len(nodes), 2)]
        at = [i // 2 for i in at]
    return nodes[0], paths


def brute(rows):
    """rows (doc_id, source, lang, n_chars, text)."""
    groups = {}
    for r in rows:
        groups.setdefault(r[2], []).append(r)
    names = sorted(groups, key=lambda g: (g is not None, (g or "").encode()))
    own, subroots = {}, []
    for g in names:
        own[g] = sorted(groups[g], key=lambda r: (r[0] is not None, r[0] or 0, leaf(r)))
        sub, paths = tree([leaf(r) for r in own[g]])
        subroots.append(sub)
        own[g] = list(zip(own[g], paths, strict=True))
    root, upper = tree(subroots)
    out = []
    for g, sub, up in zip(names, subroots, upper, strict=True):
        for r, path in own[g]:
            bad = r[0] is not None and zlib.crc32(str(r[0]).encode()) % 7 == 0 and r[3] is not None
            start = at = leaf((*r[:3], r[3] + 1, r[4])) if bad else leaf(r)
            for other, odd in path + up:
                at = sha(other, at) if odd else sha(at, other)
            assert bad or at == root
            out.append((r[0], leaf(r), sub, root, sha(*(o for o, _ in path + up)), at, at == root))
    return sorted(out, key=str)


def docs(spark, rows):
    return spark.createDataFrame(rows, "doc_id long, source string, lang string, n_chars long, text string").repartition(3)


def many():
    rows = [(k * 7 % 211, f"s{k % 3}", ["en", "de", None, "ü", ""][k % 5] if k % 3 else "en", None if k % 11 == 0 else k, None if k % 13 == 0 else "é" * (k % 4)) for k in range(150)]
    return [*rows, (None, None, None, None, None), (None, "a", "en", 1, ""), (2**62 + 1, "a", "en", 2**63 - 1, "x" * 50_000), *[(9, "b", "en", 3, "same")] * 4, (9, "b", "en", 3, "other")]


@pytest.mark.parametrize(("block_bits", "top"), [(12, 16384), (2, 64), (1, 3), (2, 2)])
def test_equals_the_rule(spark, block_bits, top):
    rows = many()
    got = audited(docs(spark, rows).selectExpr("*", "1 AS leaf", "'x' AS `group`", "2 AS pos", "3 AS ID"), block_bits=block_bits, top=top)
    assert sorted(map(tuple, got.collect()), key=str) == brute(rows)


@pytest.mark.parametrize("rows", [[(1, "a", "en", 5, "x")], [(k, None, None, None, None) for k in range(5)], [(4, "a", f"l{k}", 1, "y") for k in range(9)]])
def test_small_tables(spark, rows):
    assert sorted(map(tuple, audited(docs(spark, rows), top=4).collect()), key=str) == brute(rows)


def test_empty_table(spark):
    assert audited(docs(spark, [])).collect() == []


def test_each_proof_leads_to_the_root_and_no_other_leaf_does(spark):
    rows = manifest(docs(spark, many()), block_bits=3).collect()
    assert all(fold(r.leaf, bytes(r.path)) == r.root for r in rows)
    assert all(fold(sha(r.leaf), bytes(r.path)) != r.root for r in rows)
