"""N-gram Jaccard join by vertical partitioning, to components of linked documents.

A document's set is its distinct 64-bit shingle hashes; equal sets are one node. The global n-gram
order puts shingles of one document first, by hash, and then those of more, in steps of THRESHOLDS. All
shingles of all documents are counted, equal sets of a task once, and Bloom filters of HEAVY_BYTES at
most hold the steps. They only order, and decide no link. Two sets that reach the threshold share a
shingle of their prefixes in that order.

1. The order is cut into fragments. Each is one unit of work that sees only its part of every
   prefix, packed in blocks, and joins the nodes of each shared shingle to a spanning forest, not to
   all pairs. The forests' components are clusters: linked nodes always lie in one cluster.
   The nodes of large clusters (texts made of common passages) go through the fragments once more
   with their set sizes and bitmaps of 1024 bits: then only pairs of a shared shingle that pass the
   bounds of size and bitmap are joined, so what shares passages without being similar falls apart.
2. A cluster's sets meet in one task, a large cluster's in blocks, each pair of blocks in a task of its
   own. A pair is dropped when the bits in which two hashed bitmaps differ, a lower bound of the
   symmetric difference, are more than a link allows. The others are counted vertically: the overlap
   in each fragment of hash order is counted separately and the overlaps are summed per pair, until
   the sum decides. Pairs already joined by links are not counted again, hubs come first, and a task
   returns only links that join something new.
3. Links give the components.

So no link between different texts is lost, and a group of near copies gives rows in proportion to its
size. Nodes are 64-bit digests of sets; a second digest finds those that different sets share, and
splits them. Shingles are 64-bit hashes: two sets of 20 000 shingles hold two different ones with
the same hash once in some 10^10 pairs.

Defined results: no words or null text is the empty set, linked with nothing; fewer words than the
shingle size make one shingle; a null doc_id counts as the smallest and gives a null component; rows
that share doc_id and text are reported alike; an empty table gives an empty result.
"""

from __future__ import annotations

import uuid
from collections.abc import Callable, Iterator
from dataclasses import dataclass, replace

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from loomspan.llm._common import NOT_SPACE, U64, Texts, column, kept, mix, stored, text_slices, trim, windows
from loomspan.llm.components import components

#: Documents of a shingle from which it counts as more frequent, and bytes of the filters that say so:
#: where the first steps would take more, shingles that pass no further one count as rare.
THRESHOLDS = (2, 3, 4, 6, 8, 12, 16, 32, 64, 128, 256, 1024, 4096, 16384, 65536)
HEAVY_BYTES = 64 << 20
FILTER_BITS = 1 << 24
#: Nodes and bytes of a cluster that are compared in one block, bytes for one task, and vertical fragments of a count.
BLOCK, LEAST_BLOCK, BLOCK_BYTES, TASK_BYTES, SLICES = 2048, 192, 16 << 20, 32 << 20, 4
#: Clusters of more nodes are formed again from pairs that pass the length and bitmap bounds.
REFINE_FROM, SKETCH_BITS = 256, 1024
NULL_ID = -(1 << 63)


class Threshold:
    """100 * intersection >= percent * union, in whole numbers."""

    def __init__(self, percent: int):
        self.percent = percent

    def prefix(self, n: np.ndarray) -> np.ndarray:
        return n - -(-self.percent * n // 100) + 1

    def least_overlap(self, both: np.ndarray) -> np.ndarray:
        return -(-self.percent * both // (100 + self.percent))


def shingle_sets(t: Texts, size: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Row and hash of each distinct shingle, sorted by both, and the set size of each row."""
    row, s, e = t.pieces(NOT_SPACE[t.data])
    words = t.hashes(s, e, lower=True)
    first, h = windows(row, words, size)
    rows, found = [row[first]], [h]
    count = np.bincount(row, minlength=t.rows)
    for k in range(1, size):
        if (count == k).any():
            first, h = windows(row, words, k)
            whole = count[row[first]] == k
            rows.append(row[first][whole])
            found.append(h[whole])
    row, h = np.concatenate(rows), np.concatenate(found)
    # Rows are short of 2**16, so one word orders by row and then by the hash's upper bits.
    key = row.astype(U64) << U64(48) | h >> U64(16)
    order = np.argsort(key)
    key = key[order]
    if ((key[1:] == key[:-1]) & (h[order[1:]] != h[order[:-1]])).any():  # equal hashes may lie apart
        order = np.lexsort((h, row))
    row, h = row[order], h[order]
    new = np.ones(len(row), bool)
    new[1:] = (row[1:] != row[:-1]) | (h[1:] != h[:-1])
    row, h = row[new], h[new]
    return row, h, np.bincount(row, minlength=t.rows)


def digests_of(row: np.ndarray, h: np.ndarray, n: np.ndarray, kind: int) -> np.ndarray:
    """A digest of each row's set, one of two independent ones."""
    ends = np.concatenate(([0], np.cumsum(n)))
    total = np.concatenate((np.zeros(1, U64), np.cumsum(mix(h * U64(2 * kind + 1) + U64(1 + kind)))))
    return mix((total[ends[1:]] - total[ends[:-1]]) + n.astype(U64) * U64(0x9E3779B97F4A7C15))


def nodes_of(row: np.ndarray, h: np.ndarray, n: np.ndarray, shared: np.ndarray) -> np.ndarray:
    """The node of each row: a digest of its set, or of two digests where different sets have the first."""
    node = digests_of(row, h, n, 0)
    again = np.isin(node, shared)
    if again.any():
        node[again] = mix(node[again] ^ digests_of(row, h, n, 1)[again])
    return node


@dataclass(frozen=True)
class Source:
    """Documents (id, text) with the shingle size and the digests that different sets share."""

    docs: DataFrame
    size: int
    shared: np.ndarray
    #: Bits of a hash that tell shingles apart where they are counted: nine more than their number has, so one in a thousand is mixed up.
    token_bits: int = 64


def _sets(docs: DataFrame, size: int) -> tuple[DataFrame, Source]:
    """(id, n, node) of each document, stored."""

    def digests(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for t in text_slices(batches):
            row, h, n = shingle_sets(t, size)
            first, second = (pa.array(digests_of(row, h, n, kind).view(np.int64)) for kind in (0, 1))
            yield pa.RecordBatch.from_arrays([column(t.batch, "id"), pa.array(n.astype(np.int64)), first, second], ["id", "n", "node", "second"])

    def renamed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            node, second = (column(b, c).to_numpy().view(U64) for c in ("node", "second"))
            node = np.where(np.isin(node, shared), mix(node ^ second), node)
            yield pa.RecordBatch.from_arrays([column(b, "id"), column(b, "n"), pa.array(node.view(np.int64))], ["id", "n", "node"])

    found = stored(docs.mapInArrow(digests, "id long, n long, node long, second long"))
    mixed = found.groupBy("node").agg(F.min("second").alias("a"), F.max("second").alias("b")).where("a <> b")
    # With 64 bits, about one pair of digests for 2**32 different sets: a few numbers in any corpus.
    shared = np.array(sorted(r.node for r in mixed.select("node").toLocalIterator()), np.int64).view(U64)
    if len(shared):
        return stored(found.mapInArrow(renamed, "id long, n long, node long")), Source(docs, size, shared)
    return found.drop("second"), Source(docs, size, shared)


def _new_nodes(t: Texts, size: int, shared: np.ndarray, seen: set[int], wanted: np.ndarray | None) -> tuple[np.ndarray, ...]:
    """As shingle_sets with nodes, for rows whose node this task meets for the first time."""
    row, h, n = shingle_sets(t, size)
    node = nodes_of(row, h, n, shared)
    fresh = n > 0
    if wanted is not None:
        at = node % U64(FILTER_BITS)
        fresh &= (wanted[(at >> U64(3)).astype(np.int64)] >> (at & U64(7)).astype(np.uint8)) & 1 == 1
    for i in np.flatnonzero(fresh):
        if (k := int(node[i])) in seen:
            fresh[i] = False
        seen.add(k)
    keep = fresh[row]
    return row[keep], h[keep], n, node


def _fragment(tokens: np.ndarray, fragments: int) -> np.ndarray:
    """The fragment of each hash: equal ranges of the hash order."""
    return ((tokens >> U64(32)) * U64(fragments) >> U64(32)).astype(np.int64)


def sketches(row: np.ndarray, h: np.ndarray, rows: int) -> np.ndarray:
    """Bitmaps of SKETCH_BITS over the hashes of each row."""
    flat = np.zeros(rows * SKETCH_BITS, np.uint8)
    flat[row * SKETCH_BITS + (h & U64(SKETCH_BITS - 1)).astype(np.int64)] = 1
    return np.packbits(flat, bitorder="little").view(U64).reshape(rows, -1)


def packed(tokens: np.ndarray) -> bytes:
    """Sorted 64-bit tokens by their gaps, in digits of as few bytes as most gaps need; the largest digit says that more follows."""
    gap = np.diff(tokens)
    mean = int(tokens[-1] - tokens[0]) // max(1, len(gap)) if len(tokens) else 0
    width = next(w for w in range(2, 9) if w == 8 or 1 << 8 * w >= 2 * mean)
    base = U64((1 << 8 * width) - 1)
    at = np.cumsum(gap // base + U64(1)).astype(np.int64) - 1
    digits = np.full(at[-1] + 1 if len(at) else 0, base, U64)
    digits[at] = gap % base
    return bytes([width]) + tokens[:1].tobytes() + digits.view(np.uint8).reshape(-1, 8)[:, :width].tobytes()


def unpacked(raw: bytes) -> np.ndarray:
    width, first = raw[0], np.frombuffer(raw[1:9], U64)
    digits = np.zeros((max(0, len(raw) - 9) // width, 8), np.uint8)
    digits[:, :width] = np.frombuffer(raw, np.uint8, digits.shape[0] * width, min(9, len(raw))).reshape(-1, width)
    digits = digits.view(U64).ravel()
    return np.concatenate((first, (first[:1] + np.cumsum(digits))[digits != U64((1 << 8 * width) - 1)])) if len(first) else first


class Levels:
    """How frequent shingles are, in steps of THRESHOLDS, by a Bloom filter for each step and fragment.

    A filter may take a shingle for a more frequent one, but says the same of it everywhere, so the order by levels is one order.
    """

    def __init__(self, rows: list[tuple[int, list[bytes | None]]], fragments: int):
        self.fragments, self.size, self.at, self.open, self.bits = fragments, [], [], [], []
        by = dict(rows)
        for k in range(len(THRESHOLDS)):
            own = [by[f][k] if f in by else b"" for f in range(fragments)]
            size = np.array([len(x or b"") for x in own], np.int64)
            self.size.append(size.astype(U64) * U64(8))
            self.at.append(np.cumsum(size) - size)
            self.open.append(np.array([x is None for x in own], bool))
            self.bits.append(np.frombuffer(b"".join(x or b"" for x in own), np.uint8))

    def of(self, token: np.ndarray, frag: np.ndarray) -> np.ndarray:
        """The number of steps that each token passes."""
        out = np.zeros(len(token), np.uint8)
        idx, x = np.arange(len(token)), mix(token)
        for size, at, open_, bits in zip(self.size, self.at, self.open, self.bits, strict=True):
            held = np.ones(len(idx), bool)
            for k in range(3):
                left = np.flatnonzero(held)
                i = idx[left]
                f = frag[i]
                p = _place(x[i], k, size[f])
                byte = np.minimum(at[f] + (p >> U64(3)).astype(np.int64), max(0, len(bits) - 1))
                hit = (bits[byte] >> (p & U64(7)).astype(np.uint8)) & 1 == 1 if len(bits) else np.zeros(len(left), bool)
                held[left] = hit & (size[f] > 0)
            out[idx[held]] += 1
            idx = idx[held | open_[frag[idx]]]
            if not len(idx):
                break
        return out


def _place(x: np.ndarray, k: int, size) -> np.ndarray:
    """The k-th place of mixed tokens in a filter of size bits."""
    part = x >> U64(32) if k == 0 else x & U64(0xFFFFFFFF) if k == 1 else mix(x) >> U64(32)
    return part * size >> U64(32)


def level_filters(token: np.ndarray, n: np.ndarray, most: int) -> list[bytes | None]:
    """For each of THRESHOLDS a filter of the tokens that are as frequent, of a byte a token; None for the first ones where all take more than most bytes."""
    out: list[bytes | None] = []
    room = np.cumsum([np.count_nonzero(n >= least) for least in THRESHOLDS[::-1]])[::-1] <= most
    for least, fits in zip(THRESHOLDS, room, strict=True):
        if not fits:
            out.append(None)
            continue
        x = mix(token[n >= least])
        flat = np.zeros(8 * len(x), np.uint8)
        for k in range(3):
            flat[_place(x, k, U64(8 * len(x))).astype(np.int64)] = 1
        out.append(np.packbits(flat, bitorder="little").tobytes())
    return out


def _blocks(source: Source, fragments: int, threshold: Threshold, heavy, counting: bool, wanted=None) -> DataFrame:
    """(frag, payload): the prefixes, cut into fragments.

    Inside a fragment 40 bits tell shingles apart; a mix-up joins two clusters and decides no link.
    counting: tokens alone, to count. wanted: a filter of nodes, whose sizes and bitmaps go along.
    """
    heavy_name = uuid.uuid4().hex
    docs, size, shared, drop = source.docs, source.size, source.shared, U64(64 - source.token_bits)

    def flush(held: list[tuple[np.ndarray, ...]]) -> Iterator[pa.RecordBatch]:
        frag, *cols = (np.concatenate(x) for x in zip(*held, strict=True))
        order = np.argsort(cols[0] if counting else frag, kind="stable")  # fragments are ranges of tokens
        frag, cols = frag[order], [c[order] for c in cols]
        at = np.flatnonzero(np.concatenate(([True], frag[1:] != frag[:-1], [True])))
        payload = []
        for a, b in zip(at[:-1], at[1:], strict=True):
            part = [packed(cols[0][a:b])] if counting else [c[a:b].tobytes() for c in cols]
            if wanted is not None:
                own, place = np.unique(cols[2][a:b], return_inverse=True)
                first = np.zeros(len(own), np.int64)
                first[place] = np.arange(a, b)
                part = [np.array([b - a, len(own)], np.int64).tobytes(), part[0], part[1], place.astype(np.uint32).tobytes(), own.tobytes(), cols[3][first].tobytes(), cols[4][first].tobytes()]
            payload.append(b"".join(part))
        yield pa.RecordBatch.from_arrays([pa.array(frag[at[:-1]].astype(np.int32)), pa.array(payload, pa.binary())], ["frag", "payload"])

    def blocks(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        levels = kept("levels", heavy_name, lambda: Levels(*heavy.value)) if heavy is not None else None
        mask = wanted.value if wanted is not None else None
        held, total, seen = [], 0, set()
        for t in text_slices(batches, keep="levels"):
            row, h, n, node = _new_nodes(t, size, shared, seen, mask)
            starts = np.concatenate(([0], np.cumsum(np.bincount(row, minlength=t.rows))))
            pos = np.arange(len(row)) - starts[row]
            if levels is not None:
                level = levels.of(h >> drop, _fragment(h, fragments))
                late = level > 0
                if late.any():
                    # Rare shingles keep their order and the others follow them by level.
                    before = np.concatenate(([0], np.cumsum(late)))
                    pos -= before[:-1] - before[starts[row]]
                    k = np.flatnonzero(late)
                    k = k[np.lexsort((h[k], level[k], row[k]))]
                    r = row[k]
                    rank = np.arange(len(k)) - np.searchsorted(r, r)
                    pos[k] = n[r] - (before[starts[r + 1]] - before[starts[r]]) + rank
            keep = np.ones(len(row), bool) if counting else pos < threshold.prefix(n)[row]
            frag = _fragment(h[keep], fragments).astype(np.uint16 if fragments < 1 << 16 else np.int64)
            if counting:
                held.append((frag, h >> drop))
            else:
                r, token = row[keep], h[keep]
                own = (frag, token.astype(np.uint32), (token >> U64(32)).astype(np.uint8), node[r])
                held.append(own if mask is None else (*own, n[r], sketches(row, h, t.rows)[r]))
            total += int(keep.sum())
            if total > (1 << 21 if counting else 1 << 19):
                yield from flush(held)
                held, total = [], 0
        if total:
            yield from flush(held)

    return docs.mapInArrow(blocks, "frag int, payload binary")


def _by_fragment(blocks: DataFrame, fragments: int, work: Callable, schema: str, numbered: bool = False) -> DataFrame:
    """work(payloads) -> batches, once for each fragment; numbered: work((fragment, payloads))."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        at, held = None, []
        for b in batches:
            for f, p in zip(column(b, "frag").to_pylist(), column(b, "payload").to_pylist(), strict=True):
                if f != at and held:
                    yield from work((at, held) if numbered else held)
                    held = []
                at = f
                held.append(p)
        if held:
            yield from work((at, held) if numbered else held)
        trim()

    return blocks.repartition(min(fragments, 100_000), "frag").sortWithinPartitions("frag").mapInArrow(run, schema)


def _unpack(parts: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
    """The shared tokens of a fragment with their nodes, each pair once, sorted by both."""
    low, high, node = (np.concatenate([np.frombuffer(raw, kind, len(raw) // 13, k * (len(raw) // 13)) for raw in parts]) for k, kind in ((0, np.uint32), (4, np.uint8), (5, U64)))
    tok = high.astype(U64) << U64(32) | low
    order = np.lexsort((node, tok))
    tok, node = tok[order], node[order]
    new = np.ones(len(tok), bool)
    new[1:] = (tok[1:] != tok[:-1]) | (node[1:] != node[:-1])
    tok, node = tok[new], node[new]
    shared = np.zeros(len(tok), bool)
    same = tok[1:] == tok[:-1]
    shared[1:] |= same
    shared[:-1] |= same
    return tok[shared], node[shared]


def _groups(tok: np.ndarray) -> np.ndarray:
    return np.flatnonzero(np.concatenate(([True], tok[1:] != tok[:-1], [True]))) if len(tok) else np.zeros(1, np.int64)


def _forest() -> Callable:
    """Pairs of nodes that join the nodes of each shared token."""

    def work(held: list[bytes]) -> Iterator[pa.RecordBatch]:
        tok, node = _unpack(held)
        names, index = np.unique(node, return_inverse=True)
        parent = list(range(len(names)))

        def find(x: int) -> int:
            while parent[x] != x:
                parent[x] = parent[parent[x]]
                x = parent[x]
            return x

        at = _groups(tok)
        idx = index.tolist()
        left, right = [], []
        for s, e in zip(at[:-1].tolist(), at[1:].tolist(), strict=True):
            first = idx[s]
            root = find(first)
            for i in range(s + 1, e):
                x = idx[i]
                if (r := find(x)) != root:
                    parent[r] = root
                    left.append(first)
                    right.append(x)
        a, b = (names[np.array(x, np.int64)].view(np.int64) for x in (left, right))
        yield pa.RecordBatch.from_arrays([pa.array(a), pa.array(b)], ["a", "b"])

    return work


def _filtered_forest(percent: int) -> Callable:
    """As _forest, of pairs that pass the bounds of size and bitmap."""
    threshold = Threshold(percent)

    def work(held: list[bytes]) -> Iterator[pa.RecordBatch]:
        toks, highs, places, names, sizes, maps, base = [], [], [], [], [], [], 0
        for raw in held:
            m, k = np.frombuffer(raw, np.int64, 2).tolist()
            at = 16
            for out, kind, count, width in ((toks, np.uint32, m, 4), (highs, np.uint8, m, 1), (places, np.uint32, m, 4), (names, U64, k, 8), (sizes, np.int64, k, 8), (maps, U64, k * SKETCH_BITS // 64, 8)):
                out.append(np.frombuffer(raw, kind, count, at))
                at += count * width
            places[-1] = places[-1].astype(np.int64) + base
            base += k
        low, high, place, name, size, sketch = (np.concatenate(x) for x in (toks, highs, places, names, sizes, maps))
        tok = high.astype(U64) << U64(32) | low
        sketch = sketch.reshape(len(name), -1)
        own, first, same = np.unique(name, return_index=True, return_inverse=True)
        size, sketch, place = size[first], sketch[first], same[place]
        order = np.lexsort((place, tok))
        tok, place = tok[order], place[order]
        root = np.arange(len(own))
        left, right = [], []
        bounds = _groups(tok)
        for s, e in zip(bounds[:-1], bounds[1:], strict=True):
            members = np.unique(place[s:e])
            while len(members) > 1:
                i, members = members[0], members[1:]
                js = members[root[members] != root[i]]
                if not len(js) and (root[members] == root[members[0]]).all():
                    break
                both = size[js] + size[i]
                least = threshold.least_overlap(both)
                fits = least <= np.minimum(size[js], size[i])
                js, spare = js[fits], (both - 2 * least)[fits]
                js = js[np.bitwise_count(sketch[js] ^ sketch[i]).sum(1, dtype=np.int64) <= spare]
                for j in js.tolist():
                    if root[j] != root[i]:
                        left.append(i)
                        right.append(j)
                        root[root == root[j]] = root[i]
        a, b = (own[np.array(x, np.int64)].view(np.int64) for x in (left, right))
        yield pa.RecordBatch.from_arrays([pa.array(a), pa.array(b)], ["a", "b"])

    return work


def node_filter(nodes: DataFrame) -> np.ndarray:
    """A bitmap of fixed size over the column node."""
    at = nodes.select(F.pmod("node", F.lit(FILTER_BITS)).alias("at"))
    rows = at.groupBy((F.col("at") / 32768).cast("int").alias("bucket")).agg(F.bitmap_construct_agg(F.pmod("at", F.lit(32768))).alias("bits"))
    out = np.zeros(FILTER_BITS // 8, np.uint8)
    for r in rows.toLocalIterator():
        out[r.bucket * 4096 : (r.bucket + 1) * 4096] = np.frombuffer(r.bits, np.uint8)
    return out


def _whole_sets(source: Source, wanted) -> DataFrame:
    """(node, tokens) of the wanted nodes, once for each task that meets them."""
    docs, size, shared = source.docs, source.size, source.shared

    def sets(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        seen: set[int] = set()
        for t in text_slices(batches):
            row, h, _, node = _new_nodes(t, size, shared, seen, wanted.value)
            at = _groups(row)
            who = node[row[at[:-1]]].view(np.int64) if len(row) else np.zeros(0, np.int64)
            raw = [h[a:b].tobytes() for a, b in zip(at[:-1], at[1:], strict=True)]
            yield pa.RecordBatch.from_arrays([pa.array(who), pa.array(raw, pa.binary())], ["node", "tokens"])

    return docs.mapInArrow(sets, "node long, tokens binary")


def _units(clusters: DataFrame) -> DataFrame:
    """(node, n, unit, side) from (node, n, cluster): where each node is compared.

    A small cluster is one unit (side 0). A larger one is cut by hash into eight blocks, more where one
    would have more than BLOCK nodes or BLOCK_BYTES of sets, fewer where one would have less than
    LEAST_BLOCK, and each pair of blocks is a unit whose two sides are compared; a block with itself
    has side 0.
    """
    count = F.count("*")
    own = F.least(F.lit(BLOCK), F.greatest(F.lit(LEAST_BLOCK), F.ceil(count / 8)))
    blocks = F.greatest(F.ceil(count / own), F.ceil(F.sum("n") * 8 / BLOCK_BYTES)).cast("int")
    many = clusters.groupBy("cluster").agg(blocks.alias("k")).where("k > 1")
    small = clusters.join(many, "cluster", "left_anti").select("node", "n", F.xxhash64("cluster").alias("unit"), F.lit(0).alias("side"))
    large = clusters.join(many, "cluster").withColumn("i", F.pmod(F.xxhash64("node"), F.col("k")).cast("int"))
    large = large.withColumn("j", F.explode(F.sequence(F.lit(0), F.col("k") - 1)))
    unit = F.xxhash64("cluster", F.least("i", "j"), F.greatest("i", "j"))
    large = large.select("node", "n", unit.alias("unit"), F.when(F.col("i") == F.col("j"), 0).when(F.col("i") < F.col("j"), 1).otherwise(2).alias("side"))
    return small.unionByName(large)


def _levels(blocks: DataFrame, fragments: int):
    """A broadcast of the Levels of all shingles, HEAVY_BYTES at most."""

    def counted(batches: Iterator[bytes]) -> Iterator[pa.RecordBatch]:
        frag, held = batches
        token, n = np.unique(np.concatenate([unpacked(p) for p in held]), return_counts=True)
        filters = level_filters(token, n, HEAVY_BYTES // fragments)
        yield pa.RecordBatch.from_arrays([pa.array([frag], pa.int32()), pa.array([filters], pa.list_(pa.binary()))], ["frag", "filters"])

    found = _by_fragment(blocks, fragments, counted, "frag int, filters array<binary>", numbered=True)
    rows = [(r.frag, [None if x is None else bytes(x) for x in r.filters]) for r in found.toLocalIterator()]
    sent = blocks.sparkSession.sparkContext.broadcast((rows, fragments))
    sent.__dict__.pop("_value", None)  # the driver needs no copy beside the one that is sent
    del rows
    trim()
    return sent


class Unit:
    """Finds links among the sets of a unit: those that join something new, or every one."""

    def __init__(self, nodes: list[int], sides: list[int], sets: list[np.ndarray], percent: int):
        first = {x: k for k, x in reversed(list(enumerate(nodes)))}
        pick = sorted(first.values())
        self.nodes = np.array([nodes[k] for k in pick], np.int64)
        self.side = np.array([sides[k] for k in pick], np.int8)
        self.sets = [sets[k] for k in pick]
        self.n = np.array([len(x) for x in self.sets], np.int64)
        self.threshold = Threshold(percent)

    def bitmaps(self) -> np.ndarray:
        bits = 1 << int(np.clip(np.ceil(np.log2(6 * max(1, np.median(self.n)))), 8, 13))
        out = np.zeros((len(self.n), bits // 64), U64)
        for row, x in zip(out, self.sets, strict=True):
            flat = np.zeros(bits, np.uint8)
            flat[(x & U64(bits - 1)).astype(np.int64)] = 1
            row[:] = np.packbits(flat, bitorder="little").view(U64)
        return out

    def linked(self, i: int, j: int) -> bool:
        a, b = self.sets[i], self.sets[j]
        least = int(self.threshold.least_overlap(np.int64(len(a) + len(b))))
        spare = len(a) + len(b) - 2 * least
        total = 0
        for k in range(SLICES):
            x, y = a[self.cuts[i][k] : self.cuts[i][k + 1]], b[self.cuts[j][k] : self.cuts[j][k + 1]]
            common = len(np.intersect1d(x, y, assume_unique=True))
            total += common
            spare -= len(x) + len(y) - 2 * common
            if spare < 0:
                return False
        return total >= least

    def links(self, every: bool = False) -> tuple[np.ndarray, np.ndarray]:
        m = len(self.n)
        edges = (np.arange(SLICES + 1, dtype=np.float64) / SLICES * 2.0**64)[1:-1].astype(U64)
        self.cuts = [np.concatenate(([0], np.searchsorted(x, edges), [len(x)])) for x in self.sets]
        if m == 2:
            found = [(0, 1)] if self.linked(0, 1) and self.side[0] + self.side[1] in (0, 3) else []
            return tuple(self.nodes[np.array([p[k] for p in found], np.int64)] for k in (0, 1))
        tokens, inverse, count = np.unique(np.concatenate(self.sets), return_inverse=True, return_counts=True)
        owner = np.repeat(np.arange(m), self.n)
        order = np.argsort(-np.bincount(owner, count[inverse], minlength=m) / np.maximum(self.n, 1), kind="stable")
        del tokens, inverse, count, owner
        maps, root, open_ = self.bitmaps(), np.arange(m), np.ones(m, bool)
        left, right = [], []
        for i in order:
            open_[i] = False
            js = np.flatnonzero(open_ & ((root != root[i]) | every) & ((self.side != self.side[i]) | (self.side[i] == 0)))
            both = self.n[js] + self.n[i]
            least = self.threshold.least_overlap(both)
            js, both, least = (x[least <= np.minimum(self.n[js], self.n[i])] for x in (js, both, least))
            if len(js):
                apart = np.bitwise_count(maps[js] ^ maps[i]).sum(1, dtype=np.int64)
                js = js[apart <= both - 2 * least]
            for j in js.tolist():
                if (every or root[j] != root[i]) and self.linked(i, j):
                    left.append(i)
                    right.append(j)
                    root[root == root[j]] = root[i]
        return self.nodes[np.array(left, np.int64)], self.nodes[np.array(right, np.int64)]


def cluster_links(source: Source, clusters: DataFrame, percent: int, every: bool = False) -> DataFrame:
    """(a, b): links that join the nodes of each cluster (node, n, cluster) as all its links do, or every link, once."""
    spark = source.docs.sparkSession
    wanted = spark.sparkContext.broadcast(node_filter(clusters.select("node")))
    units = _units(clusters)
    count, total = units.agg(F.count("*"), F.coalesce(F.sum("n"), F.lit(0))).first()
    # Each set then goes to its units in one shuffle; more units than these 32 MB are joined by one more.
    placed = F.broadcast(units) if count <= 1 << 20 else units
    rows = _whole_sets(source, wanted).join(placed, "node").select("unit", "side", "node", "tokens")

    def compare(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        def done() -> pa.RecordBatch:
            a, b = Unit(*held, percent).links(every) if len(set(held[0])) > 1 else (np.zeros(0, np.int64),) * 2
            return pa.RecordBatch.from_arrays([pa.array(a), pa.array(b)], ["a", "b"])

        at, held = None, ([], [], [])
        for batch in batches:
            cols = [column(batch, c).to_pylist() for c in ("unit", "side", "node", "tokens")]
            for unit, side, node, raw in zip(*cols, strict=True):
                if unit != at and held[0]:
                    yield done()
                    held = ([], [], [])
                at = unit
                for x, v in zip(held, (node, side, np.frombuffer(raw, U64)), strict=True):
                    x.append(v)
        if held[0]:
            yield done()
        trim()

    parts = max(int(spark.conf.get("spark.sql.shuffle.partitions")), -(-8 * total // TASK_BYTES))
    return rows.repartition(parts, "unit").sortWithinPartitions("unit").mapInArrow(compare, "a long, b long")


def _clusters(source: Source, sets: DataFrame, percent: int, fragment_tokens: int) -> DataFrame:
    """(node, n, cluster): linked nodes always lie in one cluster."""
    spark, threshold = source.docs.sparkSession, Threshold(percent)
    total = sets.agg(F.sum(F.col("n") * (100 - percent) / 100 + 1)).first()[0] or 0
    fragments = max(8, int(-(-total // fragment_tokens)))

    source = replace(source, token_bits=min(64, max(32, int(sets.agg(F.coalesce(F.sum("n"), F.lit(0))).first()[0]).bit_length() + 9)))
    sent = _levels(_blocks(source, fragments, threshold, None, True), fragments)
    forests = _by_fragment(_blocks(source, fragments, threshold, sent, False), fragments, _forest(), "a long, b long")
    clusters = stored(components(stored(forests)).withColumnRenamed("component", "cluster"), narrow=True)
    large = clusters.groupBy("cluster").count().where(F.col("count") > REFINE_FROM)
    if not large.isEmpty():
        again = clusters.join(large, "cluster", "left_semi")
        wanted = spark.sparkContext.broadcast(node_filter(again.select("node")))
        blocks = _blocks(source, fragments, threshold, sent, False, wanted)
        finer = components(stored(_by_fragment(blocks, fragments, _filtered_forest(percent), "a long, b long"))).withColumnRenamed("component", "cluster")
        # The filter may let nodes of other clusters in; these stay where they were.
        finer = finer.join(again.select("node"), "node", "left_semi")
        clusters = clusters.join(large, "cluster", "left_anti").select("node", "cluster").unionByName(finer.select("node", "cluster"))
    return stored(clusters.join(sets.groupBy("node").agg(F.max("n").alias("n")), "node").select("node", "n", "cluster"), narrow=True)


def _representatives(sets: DataFrame) -> DataFrame:
    """(node, least): the least id of each set."""
    return sets.where("n > 0").groupBy("node").agg(F.min(F.coalesce("id", F.lit(NULL_ID))).alias("least"))


def similar_links(docs: DataFrame, *, text: str = "text", doc_id: str = "doc_id", shingle: int = 5, percent: int = 75, fragment_tokens: int = 750_000) -> DataFrame:
    """(a, b), a before b: every pair of different sets that reaches the threshold, each set by the least id of its documents.

    K sets that are all close to each other give K^2 / 2 rows; similar_components needs only those that join.
    """
    docs = docs.select(F.col(doc_id).cast("long").alias("id"), F.col(text).alias("text"))
    sets, source = _sets(docs, shingle)
    found = cluster_links(source, _clusters(source, sets, percent, fragment_tokens), percent, every=True)
    name = _representatives(sets)
    left, right = (name.select(F.col("node").alias(c), F.col("least").alias(f"least_{c}")) for c in ("a", "b"))
    out = found.join(left, "a").join(right, "b").select(F.least("least_a", "least_b").alias("a"), F.greatest("least_a", "least_b").alias("b"))
    return out.select(F.nullif("a", F.lit(NULL_ID)).alias("a"), "b")


def similar_components(docs: DataFrame, *, text: str = "text", doc_id: str = "doc_id", shingle: int = 5, percent: int = 75, fragment_tokens: int = 750_000) -> DataFrame:
    """(doc_id, n_shingles, component_id) for each row of docs."""
    docs = docs.select(F.col(doc_id).cast("long").alias("id"), F.col(text).alias("text"))
    sets, source = _sets(docs, shingle)
    clusters = _clusters(source, sets, percent, fragment_tokens)
    label = components(stored(cluster_links(source, clusters, percent)))

    named = _representatives(sets).join(label, "node", "left").withColumn("component", F.coalesce("component", "node"))
    linked = named.join(label.select("component").distinct(), "component", "left_semi")
    lowest = linked.groupBy("component").agg(F.min("least").alias("lowest"))
    named = named.join(lowest, "component", "left").select("node", F.coalesce("lowest", "least").alias("lowest"))
    out = sets.join(named.withColumn("some", F.lit(1)), (sets.node == named.node) & (sets.n > 0), "left").select("id", "n", "lowest")
    component = F.when(F.col("n") == 0, F.col("id")).otherwise(F.nullif("lowest", F.lit(NULL_ID)))
    return out.select(F.col("id").alias("doc_id"), F.col("n").alias("n_shingles"), component.alias("component_id"))
