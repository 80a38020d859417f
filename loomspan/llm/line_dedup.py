"""Line deduplication by probing sharded minimal perfect hash arrays.

Every document gives the 128-bit hashes of its distinct long lines; Spark counts the documents of each
hash. Lines whose hash is in enough documents are then counted by their bytes, each task's own first
(documents holding the line, largest doc_id). Those held by enough documents are cut into shards of
bounded size, and each shard becomes a minimal perfect hash over the lines' hashes with arrays:
fingerprint, document count, last holder and the line. Documents are scanned again and probe the
arrays, and a line counts as found only if its bytes are the same.

The arrays are broadcast while their measured size is within ``max_bytes``. Beyond it the lines that a
bitmap lets through go to the shards instead: each task holds one shard's arrays at a time and probes
the lines that come with them; a shard with a very frequent line is dealt to several tasks.

Defined results: a null text is one empty line; a null doc_id never holds the last copy unless all
holders are null; rows sharing a doc_id count as holders one by one and all of them keep the line
if that doc_id is the largest; an empty table gives an empty result.
"""

from __future__ import annotations

import struct
import uuid
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from loomspan.llm._common import LOWER, NOT_SPACE, U64, Texts, column, fresh, hash_bitmap, hashes, in_bitmap, kept, mix, others, same_ranges, stored, text_slices, words_at

_GAMMA = 2.0
_LEVEL = U64(0xD6E8FEB86659FD93)
NULL_ID = -(1 << 63)


def _salt(level: int) -> np.uint64:
    return U64(level * int(_LEVEL) & 0xFFFFFFFFFFFFFFFF)


class Lines:
    """The lines of some texts: row, byte range, stripped range and hashes of the key."""

    def __init__(self, texts: Texts, min_chars: int):
        data, offsets = texts.data, texts.offsets
        breaks = np.flatnonzero(data == 10)
        row = np.concatenate((np.arange(texts.rows), np.searchsorted(offsets, breaks, "right") - 1))
        start = np.concatenate((offsets[:-1], breaks + 1))
        order = np.lexsort((start, row))
        self.row, self.start = row[order], start[order]
        end = offsets[self.row + 1].copy()
        same = self.row[:-1] == self.row[1:]
        end[:-1][same] = self.start[1:][same] - 1
        self.end = end
        solid = np.flatnonzero(NOT_SPACE[data])
        at = np.searchsorted(solid, self.start)
        past = np.searchsorted(solid, self.end)
        filled = at < past
        s, e = self.start.copy(), self.start.copy()
        s[filled], e[filled] = solid[at[filled]], solid[past[filled] - 1] + 1
        chars = np.concatenate(([0], np.cumsum((data & 0xC0) != 0x80)))
        self.long = chars[e] - chars[s] >= min_chars
        picked = np.flatnonzero(self.long)
        self.picked, self.key_start, self.key_end = picked, s[picked], e[picked]
        self.words = texts.words(lower=True)
        self.hi, self.lo = (hashes(self.words, self.key_start, self.key_end, kind) for kind in (0, 1))

    def key(self, k: int) -> bytes:
        """The key of the k-th long line."""
        return self.words.base[self.key_start[k] : self.key_end[k]].tobytes()


def line_keys(docs: DataFrame, text: str, doc_id: str, min_chars: int) -> DataFrame:
    """(hi, lo, id): each distinct key of each document, once per row of docs."""

    def keys(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for t in text_slices(batches, "text"):
            lines = Lines(t, min_chars)
            row = lines.row[lines.picked]
            order = np.lexsort((lines.lo, lines.hi, row))
            r, h, lo = row[order], lines.hi[order], lines.lo[order]
            new = np.ones(len(r), bool)
            new[1:] = (r[1:] != r[:-1]) | (h[1:] != h[:-1]) | (lo[1:] != lo[:-1])
            ids = column(t.batch, "id").take(pa.array(r[new]))
            yield pa.RecordBatch.from_arrays([pa.array(h[new].view(np.int64)), pa.array(lo[new].view(np.int64)), ids], ["hi", "lo", "id"])

    return docs.select(F.col(text).alias("text"), F.col(doc_id).cast("long").alias("id")).mapInArrow(keys, "hi long, lo long, id long")


def held_lines(docs: DataFrame, text: str, doc_id: str, min_chars: int, min_docs: int, most: int = 16 << 20) -> DataFrame:
    """(key, n, last): every line held by min_docs documents or more, by its bytes."""
    keys = line_keys(docs, text, doc_id, min_chars)
    maybe = keys.groupBy("hi", "lo").agg(F.count("*").alias("n")).where(F.col("n") >= min_docs)
    sent = docs.sparkSession.sparkContext.broadcast(hash_bitmap(maybe, "hi"))

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        bitmap = sent.value
        found: dict[bytes, list[int]] = {}
        size = 0

        def flush() -> pa.RecordBatch:
            n, last = zip(*found.values(), strict=True)
            return pa.RecordBatch.from_arrays([pa.array(list(found), pa.binary()), pa.array(n, pa.int64()), pa.array(last, pa.int64())], ["key", "n", "last"])

        for t in text_slices(batches, "text"):
            lines = Lines(t, min_chars)
            ids = column(t.batch, "id").fill_null(NULL_ID).to_pylist()
            hit = np.flatnonzero(in_bitmap(bitmap, lines.hi))
            for row, key in {(int(r), lines.key(k)) for r, k in zip(lines.row[lines.picked[hit]], hit, strict=True)}:
                if (own := found.get(key)) is None:
                    found[key] = [1, ids[row]]
                    size += len(key) + 128
                else:
                    own[0] += 1
                    own[1] = max(own[1], ids[row])
            if size > most:
                yield flush()
                found, size = {}, 0
        if found:
            yield flush()

    rows = docs.select(F.col(text).alias("text"), F.col(doc_id).cast("long").alias("id")).mapInArrow(count, "key binary, n long, last long")
    return rows.groupBy("key").agg(F.sum("n").alias("n"), F.max("last").alias("last")).where(F.col("n") >= min_docs)


def build_shard(hi: np.ndarray, lo: np.ndarray, count: np.ndarray, last: np.ndarray, keys: list[bytes]) -> bytes:
    """A minimal perfect hash of the hashes hi, then the arrays in its order.

    Each level sets the bits that exactly one of the hashes left reaches; the others go on. A line's
    place is the number of set bits before its own. Lines whose hash another line has follow at the end.
    """
    _, first = np.unique(hi, return_index=True)
    twice = np.setdiff1d(np.arange(len(hi)), first)
    left, levels, place = first, [], np.zeros(len(hi), np.int64)
    done = 0
    while len(left):
        size = max(64, int(_GAMMA * len(left)))
        at = (mix(hi[left] + _salt(len(levels))) % U64(size)).astype(np.int64)
        once = np.bincount(at, minlength=size) == 1
        hit = once[at]
        rank = np.cumsum(once)
        place[left[hit]] = done + rank[at[hit]] - 1
        done += int(rank[-1])
        levels.append(once)
        left = left[~hit]
    order = np.empty(len(first), np.int64)
    order[place[first]] = first
    head = struct.pack(f"<qqq{len(levels)}q", len(first), len(twice), len(levels), *map(len, levels))
    bits = b"".join(np.packbits(b).tobytes() for b in levels)
    size = np.array([len(keys[k]) for k in (*order, *twice)], np.uint32)
    return head + bits + lo[order].tobytes() + count[order].astype(np.uint32).tobytes() + last[[*order, *twice]].tobytes() + size.tobytes() + b"".join(keys[k] for k in (*order, *twice))


class Shard:
    def __init__(self, raw: bytes):
        n, more, k = struct.unpack_from("<qqq", raw)
        sizes = struct.unpack_from(f"<{k}q", raw, 24)
        at = 24 + 8 * k
        self.levels, done = [], 0
        for size in sizes:
            bits = np.unpackbits(np.frombuffer(raw, np.uint8, -(-size // 8), at))[:size]
            rank = done + np.cumsum(bits, dtype=np.int32)
            self.levels.append((U64(size), bits.astype(bool), rank - 1))
            done, at = int(rank[-1]), at + -(-size // 8)
        self.fingerprint = np.frombuffer(raw, U64, n, at)
        self.count = np.frombuffer(raw, np.uint32, n, at + 8 * n)
        self.last = np.frombuffer(raw, np.int64, n + more, at + 12 * n)
        at += 20 * n + 8 * more
        self.size = np.frombuffer(raw, np.uint32, n + more, at).astype(np.int64)
        at += 4 * (n + more)
        self.words = words_at(np.frombuffer(raw, np.uint8, len(raw) - at, at))
        self.at = np.cumsum(self.size) - self.size
        self.others = {self.words.base[self.at[j] : self.at[j] + self.size[j]].tobytes(): int(self.last[j]) for j in range(n, n + more)}

    def probe(self, hi: np.ndarray, lo: np.ndarray, words: np.ndarray, start: np.ndarray, end: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Whether each line is held, and its last holder. words, start and end: where the lines' keys stand."""
        place = np.full(len(hi), -1, np.int64)
        left = np.arange(len(hi))
        for k, (size, bits, rank) in enumerate(self.levels):
            at = (mix(hi[left] + _salt(k)) % size).astype(np.int64)
            hit = bits[at]
            place[left[hit]] = rank[at[hit]]
            left = left[~hit]
        found = place >= 0
        found[found] = (self.fingerprint[place[found]] == lo[found]) & (self.size[place[found]] == (end - start)[found])
        p = place[found]
        found[found] = same_ranges(self.words, self.at[p], words, start[found], self.size[p])
        last = np.zeros(len(hi), np.int64)
        last[found] = self.last[place[found]]
        if self.others:
            for k in np.flatnonzero(~found).tolist():
                own = self.others.get(words.base[start[k] : end[k]].tobytes())
                found[k], last[k] = own is not None, own or 0
        return found, last


def shard_of(hi: np.ndarray, shards: int) -> np.ndarray:
    return (mix(hi ^ _LEVEL) % U64(shards)).astype(np.int64)


def _hashed(keys: pa.Array, kind: int) -> np.ndarray:
    size = np.array([len(k) for k in keys], np.int64)
    ends = np.cumsum(size)
    return hashes(words_at(np.frombuffer(b"".join(keys), np.uint8)), ends - size, ends, kind)


def build_index(repeated: DataFrame, shards: int) -> DataFrame:
    """(shard, payload) from (key, n, last)."""

    def build(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        if not (held := list(batches)):
            return
        table = pa.Table.from_batches(held)
        at = table["shard"].to_numpy()
        for s in np.unique(at):
            part = table.filter(pa.array(at == s))
            keys = part["key"].to_pylist()
            raw = build_shard(_hashed(keys, 0), _hashed(keys, 1), part["n"].to_numpy(), part["last"].to_numpy(), keys)
            yield pa.RecordBatch.from_arrays([pa.array([int(s)], pa.int32()), pa.array([raw], pa.binary())], ["shard", "payload"])

    def number(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            s = shard_of(_hashed(column(b, "key").to_pylist(), 0), shards).astype(np.int32)
            yield pa.RecordBatch.from_arrays([*b.columns, pa.array(s)], [*b.schema.names, "shard"])

    cut = repeated.mapInArrow(number, "key binary, n long, last long, shard int")
    return cut.repartition(min(shards, 4096), "shard").mapInArrow(build, "shard int, payload binary")


def dedup_lines(docs: DataFrame, *, text: str = "text", doc_id: str = "doc_id", min_chars: int = 20, min_docs: int = 3, shard_keys: int = 1 << 16, max_bytes: int = 64 << 20) -> DataFrame:
    """docs with repeated lines cut from text, plus n_lines and n_dropped.

    Lines whose key (ASCII white space stripped, A-Z lower-cased) has at least min_chars code points
    and is held by at least min_docs documents stay only in the holder with the largest doc_id.
    Columns of docs named n_lines or n_dropped are replaced.
    """
    repeated = stored(held_lines(docs, text, doc_id, min_chars, min_docs), narrow=True)
    n, size, most = repeated.agg(F.count("*"), F.coalesce(F.sum(F.octet_length("key")), F.lit(0)), F.coalesce(F.max("n"), F.lit(0))).first()
    shards = max(1, -(-n // shard_keys), -(-size // (shard_keys * 128)))
    index = build_index(repeated, shards)
    if size + 28 * n > max_bytes:  # what the arrays take, but for a few bits a line
        return _routed(docs, text, doc_id, min_chars, repeated, index, shards, 1 + most // 1_000_000)
    sent = docs.sparkSession.sparkContext.broadcast({r.shard: bytes(r.payload) for r in index.toLocalIterator()})
    name = uuid.uuid4().hex

    def dropped(lines: Lines, batch: pa.RecordBatch, ids: np.ndarray) -> np.ndarray:
        arrays = kept("lines", name, lambda: {s: Shard(raw) for s, raw in sent.value.items()})
        drop = np.zeros(len(lines.picked), bool)
        s = shard_of(lines.hi, shards)
        for k in np.unique(s):
            if k in arrays:
                mine = np.flatnonzero(s == k)
                found, last = arrays[k].probe(lines.hi[mine], lines.lo[mine], lines.words, lines.key_start[mine], lines.key_end[mine])
                drop[mine] = found & (last != ids[lines.row[lines.picked[mine]]])
        return drop

    return _apply(docs, text, doc_id, min_chars, dropped)


def _routed(docs: DataFrame, text: str, doc_id: str, min_chars: int, repeated: DataFrame, index: DataFrame, shards: int, deals: int) -> DataFrame:
    """As dedup_lines with the lines sent to the arrays."""

    def hashed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            yield pa.RecordBatch.from_arrays([pa.array(_hashed(column(b, "key").to_pylist(), 0).view(np.int64))], ["hi"])

    sent = docs.sparkSession.sparkContext.broadcast(hash_bitmap(repeated.select("key").mapInArrow(hashed, "hi long"), "hi"))
    schema = "shard int, deal int, payload binary, id long, digest binary, key binary"

    def lines_of(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        bitmap = sent.value
        for t in text_slices(batches, "text"):
            lines = Lines(t, min_chars)
            hit = np.flatnonzero(in_bitmap(bitmap, lines.hi))
            row, shard = lines.row[lines.picked[hit]], shard_of(lines.hi[hit], shards).astype(np.int32)
            keys = [lines.key(k) for k in hit]
            deal = (mix(row.astype(U64) + lines.hi[hit]) % U64(deals)).astype(np.int32)
            own = pa.array(row)
            yield pa.RecordBatch.from_arrays(
                [pa.array(shard), pa.array(deal), pa.nulls(len(row), pa.binary()), column(t.batch, "id").take(own), column(t.batch, "digest").take(own), pa.array(keys, pa.binary())],
                ["shard", "deal", "payload", "id", "digest", "key"],
            )

    keyed = docs.select(F.coalesce(F.col(doc_id).cast("long"), F.lit(NULL_ID)).alias("id"), F.unhex(F.sha2(F.coalesce(text, F.lit("")), 256)).alias("digest"), F.col(text).alias("text"))
    lines = keyed.mapInArrow(lines_of, schema)
    arrays = index.select("shard", F.explode(F.sequence(F.lit(0), F.lit(deals - 1))).alias("deal"), "payload", F.lit(None).cast("long").alias("id"), F.lit(None).cast("binary").alias("digest"), F.lit(None).cast("binary").alias("key"))

    def probe(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        at, arrays = None, None
        for b in batches:
            shard, payload = column(b, "shard").to_numpy(), column(b, "payload")
            new = np.flatnonzero(payload.is_valid().to_numpy(zero_copy_only=False))
            bounds = sorted({0, *new.tolist(), b.num_rows})
            for s, e in zip(bounds[:-1], bounds[1:], strict=True):
                if s in new:
                    at, arrays = int(shard[s]), Shard(payload[s].as_py())
                    s += 1
                part = b.slice(s, e - s)
                if not part.num_rows or arrays is None or at != int(shard[s]):
                    continue
                keys = column(part, "key").to_pylist()
                size = np.array([len(x) for x in keys], np.int64)
                ends = np.cumsum(size)
                words = words_at(np.frombuffer(b"".join(keys), np.uint8))
                found, last = arrays.probe(hashes(words, ends - size, ends, 0), hashes(words, ends - size, ends, 1), words, ends - size, ends)
                yield part.filter(pa.array(found & (last != column(part, "id").fill_null(NULL_ID).to_numpy(zero_copy_only=False)))).select(["id", "digest", "key"])

    parts = min(shards * deals, 4096)
    dealt = lines.unionByName(arrays).repartition(parts, "shard", "deal").sortWithinPartitions("shard", "deal", F.col("payload").isNull())
    gone = dealt.mapInArrow(probe, "id long, digest binary, key binary")
    own_id, digest, drop = (fresh(c, docs) for c in ("__id", "__digest", "__drop"))
    gone = gone.groupBy(F.col("id").alias(own_id), F.col("digest").alias(digest)).agg(F.collect_set("key").alias(drop))
    joined = docs.withColumn(own_id, F.coalesce(F.col(doc_id).cast("long"), F.lit(NULL_ID))).withColumn(digest, F.unhex(F.sha2(F.coalesce(text, F.lit("")), 256)))
    joined = joined.join(gone, [own_id, digest], "left").drop(own_id, digest)

    def dropped(lines: Lines, batch: pa.RecordBatch, ids: np.ndarray) -> np.ndarray:
        sets = [set(x or ()) for x in column(batch, drop).to_pylist()]
        return np.array([bool(sets[r]) and lines.key(k) in sets[r] for k, r in enumerate(lines.row[lines.picked].tolist())], bool)

    return _apply(joined, text, doc_id, min_chars, dropped, drop)


def _apply(docs: DataFrame, text: str, doc_id: str, min_chars: int, dropped, beside: str | None = None) -> DataFrame:
    """docs without the lines that dropped(lines, batch, ids) marks. beside: a column that it needs and the result does not."""
    names = others(docs, "n_lines", "n_dropped", beside or "n_lines")
    counts = [T.StructField("n_lines", T.LongType()), T.StructField("n_dropped", T.LongType())]
    schema = T.StructType([docs.schema[c] for c in names] + counts)

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for t in text_slices(batches, text, keep="lines"):
            lines = Lines(t, min_chars)
            ids = column(t.batch, doc_id).cast(pa.int64()).fill_null(NULL_ID).to_numpy(zero_copy_only=False)
            gone = np.zeros(len(lines.row), bool)
            gone[lines.picked[dropped(lines, t.batch, ids)]] = True
            n_lines = np.bincount(lines.row, minlength=t.rows)
            n_gone = np.bincount(lines.row[gone], minlength=t.rows)
            new = column(t.batch, text).to_pylist() if n_gone.any() else None
            for r in np.flatnonzero(n_gone):
                a, b = np.searchsorted(lines.row, [r, r + 1])
                keep = [t.data[s:e].tobytes() for s, e, g in zip(lines.start[a:b], lines.end[a:b], gone[a:b], strict=True) if not g]
                new[r] = b"\n".join(keep).decode("utf-8", "replace")
            cols = []
            for c in names:
                old = column(t.batch, c)
                cols.append(pa.array(new, old.type) if c == text and new is not None else old)
            cols += [pa.array(n_lines.astype(np.int64)), pa.array(n_gone.astype(np.int64))]
            yield pa.RecordBatch.from_arrays(cols, [*names, "n_lines", "n_dropped"])

    return docs.select(*names, *([beside] if beside else [])).mapInArrow(cut, schema)
