"""Benchmark decontamination as a prefix-filtered set join over item-sized windows.

Items are cut into windows of ``window`` words (a shorter item is one window). A window is a set of
short shingles; for full containment one shingle of it suffices as prefix, and the rarest is taken,
by counts over all documents. A document scans its shingles against the prefix shingles (the join),
the shingle's place in the window fixes where the window would lie (position and length bounds), and
the words there are compared, first by hash and then byte by byte.

Items are a query set in blocks of at most ``block_windows`` windows. One block is broadcast (about
250 bytes a window) and joined by a scan of the documents, so neither the driver nor a task holds
more than one; each block beyond the first is one more scan over a table in the shared folder.

Defined results: null or wordless texts and items have no words and no windows; items of one
item_id are one item; an item with null id marks words but is not listed; rows that share a doc_id
are reported one by one; columns of docs named as the new ones are replaced; empty tables give no
rows or no hits.
"""

from __future__ import annotations

import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from loomspan.llm._common import ALNUM, LOWER, U64, Texts, column, others, stored, text_slices, windows

_WORD = re.compile(rb"[0-9a-z\x80-\xff]+")
_LUT = 1 << 20
NEW = ("n_words", "n_hit", "hit_spans", "hit_items")


def words_of(text: str | None) -> list[bytes]:
    return _WORD.findall((text or "").encode("utf-8", "surrogatepass").lower())


def item_windows(text: str | None, size: int) -> set[bytes]:
    words = words_of(text)
    if not words:
        return set()
    return {b" ".join(words[k : k + size]) for k in range(max(1, len(words) - size + 1))}


def blocks(items: DataFrame, item_id: str, text: str, size: int, most: int) -> Iterator[dict[bytes, set]]:
    """Windows with the ids of their items, block by block."""
    held: dict[bytes, set] = {}
    for r in items.select(F.col(item_id).cast("string").alias("i"), F.col(text).alias("t")).toLocalIterator():
        for w in item_windows(r.t, size):
            if len(held) >= most and w not in held:
                yield held
                held = {}
            held.setdefault(w, set()).add(r.i)
    if held:
        yield held


def _hash_words(joined: list[bytes]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Window, start of the window's words, and hash of each word."""
    t = Texts(pa.RecordBatch.from_arrays([pa.array(joined, pa.large_binary()).view(pa.large_string())], ["text"]), "text")
    row, s, e = t.pieces(ALNUM[t.data])
    return row, np.searchsorted(row, np.arange(len(joined) + 1)), t.hashes(s, e, lower=True)


class Block:
    """One block of windows, ready to be probed."""

    def __init__(self, held: dict[bytes, set], shingle: int):
        self.windows = sorted(held)
        self.items = [sorted(x for x in held[w] if x is not None) for w in self.windows]
        row, at, self.words = _hash_words(self.windows)
        self.at, self.length = at[:-1], np.diff(at)
        self.sizes = sorted({min(shingle, int(n)) for n in np.unique(self.length)})
        #: By shingle size: window, place in the window and hash of every shingle.
        self.shingles = {}
        for k in self.sizes:
            first, h = windows(row, self.words, k)
            fits = np.minimum(self.length[row[first]], shingle) == k
            self.shingles[k] = (row[first][fits], (first - self.at[row[first]])[fits], h[fits])
        self.keys = {k: np.unique(h) for k, (_, _, h) in self.shingles.items()}

    def choose(self, count: dict[tuple[int, int], int]) -> None:
        """Keeps for each window the rarest of its shingles as prefix."""
        self.prefix = {}
        for k, (win, place, h) in self.shingles.items():
            n = np.array([count.get((k, int(x)), 0) for x in h.view(np.int64).tolist()], np.int64)
            order = np.lexsort((place, n, win))
            best = order[np.flatnonzero(np.concatenate(([True], win[order][1:] != win[order][:-1])))] if len(order) else order
            best = best[np.argsort(h[best], kind="stable")]
            keys, first = np.unique(h[best], return_index=True)
            self.prefix[k] = (keys, np.append(first, len(best)), win[best], place[best])
        del self.shingles


def _lut(keys: np.ndarray) -> np.ndarray:
    out = np.zeros(_LUT, bool)
    out[(keys & U64(_LUT - 1)).astype(np.int64)] = True
    return out


def _probe(h: np.ndarray, keys: np.ndarray, lut: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Places in h and in keys of the hashes that both have."""
    if not len(keys):
        return (np.zeros(0, np.int64),) * 2
    maybe = np.flatnonzero(lut[(h & U64(_LUT - 1)).astype(np.int64)])
    at = np.minimum(np.searchsorted(keys, h[maybe]), len(keys) - 1)
    hit = keys[at] == h[maybe]
    return maybe[hit], at[hit]


class Words:
    def __init__(self, t: Texts):
        self.data = LOWER[t.data]
        self.row, self.start, self.end = t.pieces(ALNUM[self.data])
        self.hash = t.hashes(self.start, self.end, lower=True)

    def joined(self, a: int, b: int) -> bytes:
        return b" ".join(self.data[s:e].tobytes() for s, e in zip(self.start[a:b], self.end[a:b], strict=True))


def shingle_counts(docs: DataFrame, block) -> DataFrame:
    """(size, hash, n): how often all documents hold the block's shingles."""

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        b = block.value
        found = {k: np.zeros(len(keys), np.int64) for k, keys in b.keys.items()}
        luts = {k: _lut(keys) for k, keys in b.keys.items()}
        for t in text_slices(batches):
            w = Words(t)
            for k, keys in b.keys.items():
                _, at = _probe(windows(w.row, w.hash, k)[1], keys, luts[k])
                found[k] += np.bincount(at, minlength=len(keys))
        for k, n in found.items():
            some = n > 0
            yield pa.RecordBatch.from_arrays([pa.array(np.full(some.sum(), k, np.int32)), pa.array(b.keys[k][some].view(np.int64)), pa.array(n[some])], ["size", "hash", "n"])

    return docs.select("text").mapInArrow(count, "size int, hash long, n long").groupBy("size", "hash").agg(F.sum("n").alias("n"))


def matches(w: Words, block: Block, luts: dict[int, np.ndarray]) -> tuple[np.ndarray, np.ndarray]:
    """First word and window of every occurrence."""
    starts, wins = [], []
    for k, (keys, first, win, place) in block.prefix.items():
        head, h = windows(w.row, w.hash, k)
        i, key = _probe(h, keys, luts[k])
        times = first[key + 1] - first[key]
        at = np.repeat(first[key], times) + np.arange(times.sum()) - np.repeat(np.cumsum(times) - times, times)
        p, win = np.repeat(head[i], times), win[at]
        start, size = p - place[at], block.length[win]
        end = start + size - 1
        ok = (start >= 0) & (end < len(w.row))
        p, win, start, size, end = p[ok], win[ok], start[ok], size[ok], end[ok]
        ok = (w.row[start] == w.row[p]) & (w.row[end] == w.row[p])
        for j in range(int(size.max()) if len(size) else 0):
            inside = ok & (j < size)
            ok[inside] = w.hash[start[inside] + j] == block.words[block.at[win[inside]] + j]
        starts.append(start[ok])
        wins.append(win[ok])
    start, win = np.concatenate(starts), np.concatenate(wins)
    same = [w.joined(s, s + n) == block.windows[x] for s, n, x in zip(start.tolist(), block.length[win].tolist(), win.tolist(), strict=True)]
    same = np.array(same, bool)
    return start[same], win[same]


def _mark(docs: DataFrame, block, names: list[str], text: str) -> DataFrame:
    schema = T.StructType([docs.schema[c] for c in names])
    for c, kind in zip(NEW, (T.LongType(), T.LongType(), T.ArrayType(T.IntegerType()), T.ArrayType(T.StringType())), strict=True):
        schema = schema.add(c, kind)

    def mark(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        b = block.value if block is not None else None
        luts = {k: _lut(p[0]) for k, p in b.prefix.items()} if b else {}
        for t in text_slices(batches, text):
            w = Words(t)
            start, win = matches(w, b, luts) if b else (np.zeros(0, np.int64),) * 2
            n = np.bincount(w.row, minlength=t.rows)
            base = np.concatenate(([0], np.cumsum(n)))
            edge = np.zeros(len(w.row) + 1, np.int64)
            items: list[set] = [set(x or ()) for x in column(t.batch, "hit_items").to_pylist()]
            for r, spans in enumerate(column(t.batch, "hit_spans").to_pylist()):
                for a, z in zip(spans[::2], spans[1::2], strict=True):
                    edge[base[r] + a] += 1
                    edge[base[r] + z] -= 1
            if len(start):
                np.add.at(edge, start, 1)
                np.add.at(edge, start + b.length[win], -1)
                for r, x in set(zip(w.row[start].tolist(), win.tolist(), strict=True)):
                    items[r].update(b.items[x])
            hit = np.cumsum(edge)[:-1] > 0
            n_hit = np.bincount(w.row[hit], minlength=t.rows)
            spans = [[] for _ in range(t.rows)]
            for r in np.flatnonzero(n_hit):
                own = np.concatenate(([0], hit[base[r] : base[r + 1]].astype(np.int8), [0]))
                spans[r] = np.flatnonzero(np.diff(own)).tolist()
            new = [pa.array(n.astype(np.int64)), pa.array(n_hit.astype(np.int64)), pa.array(spans, pa.list_(pa.int32())), pa.array([sorted(x) for x in items], pa.list_(pa.string()))]
            yield pa.RecordBatch.from_arrays([*(column(t.batch, c) for c in names), *new], [*names, *NEW])

    return docs.mapInArrow(mark, schema)


def find_benchmark(docs: DataFrame, items: DataFrame, *, text: str = "text", item_id: str = "item_id", item_text: str = "text", window: int = 10, shingle: int = 3, block_windows: int = 100_000) -> DataFrame:
    """docs with n_words, n_hit, hit_spans (word ranges, flat) and hit_items (ids as sorted strings)."""
    sc = docs.sparkSession.sparkContext
    names = others(docs, *NEW)
    plain = docs.select(F.col(text).alias("text"))
    state = docs.select(*names, F.array().cast("array<int>").alias("hit_spans"), F.array().cast("array<string>").alias("hit_items"))
    done = 0
    for held in blocks(items, item_id, item_text, window, block_windows):
        block = Block(held, shingle)
        sent = sc.broadcast(block)
        count = {(r["size"], r["hash"]): r["n"] for r in shingle_counts(plain, sent).toLocalIterator()}
        sent.unpersist()
        block.choose(count)
        if done:
            state = stored(state)
        state = _mark(state, sc.broadcast(block), names, text)
        done += 1
    return state if done else _mark(state, None, names, text)
