"""Byte-level BPE by Spark higher-order functions over distinct words.

The distinct pre-tokens of the corpus are counted, and each is encoded once in the JVM: ``aggregate``
folds its bytes, and every step merges the leftmost pair of least rank. Ranks come from a literal map
of all pairs of ids that merge (cut into buckets, so a look-up reads a few entries); a step asks it
for the two new pairs only. Decoding takes the binary piece of each id from a literal table and
concatenates the pieces. Pre-tokens over ``fold_bytes`` bytes, for which the fold's cost grows with the
square of their length, are merged by the same rule with a heap in Python.

Documents are then split again, in arrays, and put together from the encoded words. These are found
by a 64-bit hash, and what they decode to is compared with the text; a word that meets another's
hash is merged on the spot. The most frequent words, at most ``head_bytes``, are broadcast packed;
documents holding other words get those through a shuffled join by the words' bytes, so that the
vocabulary may grow with the corpus.

Defined results: null text is the empty text, which has no ids; no string is special; repeated rows
are encoded alike; an empty table gives an empty result.
"""

from __future__ import annotations

import base64
import contextlib
import functools
import hashlib
import json
import uuid
from collections.abc import Iterator

import numpy as np
import public_tokenizers
import pyarrow as pa
import regex
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from loomspan.llm._bpe import gather, merge, split, valid
from loomspan.llm._common import U64, Texts, column, fresh, grouped, hashes, kept, others, same_ranges, stored, text_slices, trim, words_at

#: Buckets of the literal rank map (a prime), and bits of an id in its entries.
_BUCKETS, _BITS = 65521, 20
_ENTRY = 12


@functools.lru_cache(maxsize=2)
def load_ranks(path: str) -> dict[bytes, int]:
    with open(path, "rb") as f:
        return {base64.b64decode(a): int(b) for a, b in map(bytes.split, f)}


@functools.cache
def _library_split() -> regex.Pattern:
    """The pattern with the classes that the tiktoken library has, found by asking it.

    In this encoding a letter, digit or mark and the first byte of the character after it merge if
    both are one pre-token.
    """
    import tiktoken

    ranks = {bytes([b]): b for b in range(256)}
    for x in b"a1!":
        for b in range(256):
            ranks[bytes([x, b])] = len(ranks)
    probe = tiktoken.Encoding("probe", pat_str=public_tokenizers.PATTERN, mergeable_ranks=ranks, special_tokens={})
    kinds: dict[str, list[str]] = {"L": [], "N": [], "S": []}
    for c in range(0x110000):
        if not 0xD800 <= c < 0xE000:
            ch = chr(c)
            n = len(ch.encode())
            own = next((k for k, x in (("L", "a"), ("N", "1"), ("O", "!")) if len(probe.encode_ordinary(x + ch)) == n), "S")
            if own != "O":
                kinds[own].append(f"\\U{c:08x}")
    sets = {k: "".join(v) for k, v in kinds.items()}
    pattern = public_tokenizers.PATTERN.replace(r"[^\s\p{L}\p{N}]", f"[^{sets['S']}{sets['L']}{sets['N']}]")
    pattern = pattern.replace(r"\p{L}", f"[{sets['L']}]").replace(r"\p{N}", f"[{sets['N']}]").replace(r"\S", f"[^{sets['S']}]").replace(r"\s", f"[{sets['S']}]")
    return regex.compile(pattern)


def words_of(t: Texts) -> tuple[Texts, np.ndarray, np.ndarray, np.ndarray]:
    """t (mended if broken) with row, first byte and end of each pre-token, as the library splits."""
    t = valid(t)
    row, start, end, unsure = split(t)
    if len(unsure):
        keep = ~np.isin(row, unsure)
        rows, starts, ends = [row[keep]], [start[keep]], [end[keep]]
        for i in unsure.tolist():
            size = np.array([len(w.encode()) for w in _library_split().findall(t.text(i).decode())], np.int64)
            stop = t.offsets[i] + np.cumsum(size)
            rows.append(np.full(len(size), i))
            starts.append(stop - size)
            ends.append(stop)
        row, start, end = (np.concatenate(x) for x in (rows, starts, ends))
        order = np.argsort(start, kind="stable")
        row, start, end = row[order], start[order], end[order]
    return t, row, start, end


def merging_pairs(ranks: dict[bytes, int]) -> Iterator[tuple[int, int, int]]:
    """All (left, right, merged) ids."""
    for piece, merged in ranks.items():
        for k in range(1, len(piece)):
            left, right = ranks.get(piece[:k]), ranks.get(piece[k:])
            if left is not None and right is not None:
                yield left, right, merged


def _literal_pairs(ranks: dict[bytes, int]) -> Column:
    """The literal rank map: buckets of entries left << 40 | right << 20 | merged, by (left << 20 | right) modulo _BUCKETS."""
    buckets: list[list[int]] = [[] for _ in range(_BUCKETS)]
    for left, right, merged in merging_pairs(ranks):
        key = left << _BITS | right
        buckets[key % _BUCKETS].append(key << _BITS | merged)
    return F.from_json(F.lit(json.dumps(buckets, separators=(",", ":"))), "array<array<bigint>>")


def _let(value: Column, body) -> Column:
    """body(value) with value evaluated once."""
    return F.get(F.transform(F.array(value), body), F.lit(0))


def fold_merges(ids: Column, ranks: Column, pairs: Column) -> Column:
    """The ids after all ranked merges. ranks: of each id with the next, the id they merge to or NULL."""
    none = F.array().cast("array<int>")

    def find(key: Column) -> Column:
        hit = F.filter(F.get(pairs, (key % _BUCKETS).cast("int")), lambda e: F.shiftright(e, _BITS) == key)
        return F.get(hit, F.lit(0)).bitwiseAND((1 << _BITS) - 1).cast("int")

    def step(s: Column) -> Column:
        def at(least: Column) -> Column:
            def merged(k: Column) -> Column:
                base = least.cast("long")
                keys = F.array(F.get(s["ids"], k - 2).cast("long") * F.lit(1 << _BITS) + base, base * F.lit(1 << _BITS) + F.get(s["ids"], k + 1))

                def with_ranks(r: Column) -> Column:
                    before = F.when(k > 1, F.slice(r, F.lit(1), F.lit(1))).otherwise(none)
                    after = F.when(k + 1 < F.size(s["ids"]), F.slice(r, F.lit(2), F.lit(1))).otherwise(none)
                    new_ids = F.concat(F.slice(s["ids"], F.lit(1), k - 1), F.array(least), F.slice(s["ids"], k + 2, F.size(s["ids"])))
                    new_ranks = F.concat(F.slice(s["ranks"], F.lit(1), F.greatest(k - 2, F.lit(0))), before, after, F.slice(s["ranks"], k + 2, F.size(s["ids"])))
                    return F.struct(new_ids.alias("ids"), new_ranks.alias("ranks"))

                return _let(F.transform(keys, find), with_ranks)

            return F.when(least.isNull(), s).otherwise(_let(F.array_position(s["ranks"], least).cast("int"), merged))

        return _let(F.array_min(s["ranks"]), at)

    first = F.struct(ids.alias("ids"), ranks.alias("ranks"))
    return F.aggregate(F.sequence(F.lit(1), F.greatest(F.size(ids) - 1, F.lit(1))), first, lambda s, _: step(s))["ids"]


def distinct_words(docs: DataFrame, text: str = "text", most: int = 250_000) -> DataFrame:
    """(word, n) over all documents, counted in the tasks first."""

    def words(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        def flush() -> pa.RecordBatch:
            return pa.RecordBatch.from_arrays([pa.array(list(count), pa.binary()), pa.array(list(count.values()), pa.int64())], ["word", "n"])

        count: dict[bytes, int] = {}
        for t in text_slices(batches, text):
            t, _, start, end = words_of(t)
            if not len(start):
                continue
            lead, group, apart = grouped(t.words(), start, end, t.hashes(start, end))
            n = np.bincount(group, minlength=len(lead)) - np.bincount(group[apart], minlength=len(lead))
            found = np.concatenate((lead, apart))
            raw = t.data.tobytes()
            for s, e, c in zip(start[found].tolist(), end[found].tolist(), [*n.tolist(), *[1] * len(apart)], strict=True):
                w = raw[s:e]
                count[w] = count.get(w, 0) + c
            if len(count) >= most:
                yield flush()
                count = {}
        if count:
            yield flush()

    return docs.select(text).mapInArrow(words, "word binary, n long").groupBy("word").agg(F.sum("n").alias("n"))


def word_hashes(words: list[bytes]) -> np.ndarray:
    ends = np.cumsum([len(w) for w in words], dtype=np.int64)
    return hashes(words_at(np.frombuffer(b"".join(words), np.uint8)), np.concatenate(([0], ends[:-1])), ends).view(np.int64)


def merged_ids(word: bytes, ranks: dict[bytes, int]) -> list[int]:
    return [ranks[p] for p in merge(word, lambda x, y: ranks.get(x + y))]


def _started(words: DataFrame, ranks: dict[bytes, int], fold_bytes: int) -> DataFrame:
    """words with their hash, the ids of their single bytes and the ids that neighbours merge to; longer words with their ids and NULL."""
    single = np.array([ranks[bytes([b])] for b in range(256)], np.int32)
    keys, merged = np.array(sorted((left << _BITS | right, m) for left, right, m in merging_pairs(ranks)), np.int64).T
    sent = words.sparkSession.sparkContext.broadcast((single, keys.copy(), merged.astype(np.int32), ranks))

    def start(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        single, keys, merged, ranks = sent.value
        for b in batches:
            raw = column(b, "word").to_pylist()
            far = [len(w) > fold_bytes for w in raw]
            known = [w[:1] if x else w for w, x in zip(raw, far, strict=True)]
            size = np.array([len(w) for w in known], np.int64)
            ids = single[np.frombuffer(b"".join(known), np.uint8)]
            key = (ids[:-1].astype(np.int64) << _BITS) | ids[1:]
            at = np.minimum(np.searchsorted(keys, key), len(keys) - 1)
            rank, held = merged[at], keys[at] == key
            ends = np.cumsum(size)
            inside = np.ones(len(key), bool)
            inside[ends[:-1] - 1] = False
            rank = pa.array(rank[inside], mask=~held[inside])
            at_ids, at_ranks = np.concatenate(([0], ends)), np.concatenate(([0], np.cumsum(size - 1)))
            ids, rank = (pa.ListArray.from_arrays(pa.array(o.astype(np.int32)), v) for o, v in ((at_ids, pa.array(ids)), (at_ranks, rank)))
            if any(far):
                ids = pa.array([merged_ids(w, ranks) if x else own for w, x, own in zip(raw, far, ids.to_pylist(), strict=True)], pa.list_(pa.int32()))
                rank = pa.array([None if x else own for x, own in zip(far, rank.to_pylist(), strict=True)], pa.list_(pa.int32()))
            yield pa.RecordBatch.from_arrays([*b.columns, pa.array(word_hashes(raw)), ids, rank], [*b.schema.names, "hash", "ids", "ranks"])
        trim()

    schema = T.StructType([*words.schema.fields]).add("hash", "long")
    for c in ("ids", "ranks"):
        schema = schema.add(c, T.ArrayType(T.IntegerType()))
    return words.mapInArrow(start, schema)


def encode_words(words: DataFrame, ranks: dict[bytes, int], fold_bytes: int = 256) -> DataFrame:
    """words (not empty) with their hash, ids and the bytes that the ids decode to."""
    folded = fold_merges(F.col("ids"), F.col("ranks"), _literal_pairs(ranks))
    started = _started(words, ranks, fold_bytes).withColumn("ids", F.when(F.col("ranks").isNull(), F.col("ids")).otherwise(folded)).drop("ranks")
    names = [""] * (max(ranks.values()) + 1)
    for piece, k in ranks.items():
        names[k] = piece.hex()
    pieces = F.split(F.lit(",".join(names)), ",")
    return started.withColumn("decoded", F.unhex(F.array_join(F.transform("ids", lambda k: F.get(pieces, k)), "")))


class Vocabulary:
    """Encoded words by hash, and the binary piece of each id."""

    def __init__(self, packed: list[tuple[bytes, ...]], pieces: list[bytes]):
        wide = len(pieces) > 1 << 16
        self.keys, n_ids, self.ids = (np.concatenate([np.zeros(0, kind), *(np.frombuffer(p[k], kind) for p in packed)]) for k, kind in enumerate((U64, np.uint32, np.int32 if wide else np.uint16)))
        if (self.keys[1:] < self.keys[:-1]).any():
            raise ValueError("packed words are not in the order of their hashes")
        total = int(n_ids.sum(dtype=np.int64))
        self.at_ids = np.zeros(len(n_ids) + 1, np.uint32 if total < 1 << 32 else np.int64)
        np.cumsum(n_ids, out=self.at_ids[1:])
        self.pieces = pieces
        self.size = np.array([len(p) for p in pieces], np.int32)
        self.at = np.cumsum(self.size, dtype=np.int64) - self.size
        self.data = np.frombuffer(b"".join(pieces), np.uint8)
        self.shown = list(map(str, range(len(pieces))))

    @functools.cached_property
    def ranks(self) -> dict[bytes, int]:
        return {p: k for k, p in enumerate(self.pieces) if p}

    def find(self, h: np.ndarray) -> np.ndarray:
        """Places of hashes; -1 for those not held."""
        if not len(self.keys):
            return np.full(len(h), -1)
        order = np.argsort(h)
        at = np.minimum(np.searchsorted(self.keys, h[order]), len(self.keys) - 1)
        out = np.empty(len(h), np.int64)
        out[order] = np.where(self.keys[at] == h[order], at, -1)
        return out

    def ids_of(self, place: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """The ids of the words at these places, one after the other, and their counts."""
        start = self.at_ids[place].astype(np.int64)
        n = self.at_ids[place + 1] - start
        return gather(self.ids, start, n), n

    def decode(self, ids: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """The pieces of the ids one after the other, and their sizes."""
        return gather(self.data, self.at[ids], self.size[ids]), self.size[ids]

    def holds(self, t: Texts, start: np.ndarray, end: np.ndarray, place: np.ndarray) -> np.ndarray:
        """Whether the ids at these places decode to the words: a hash alone does not say so."""
        ids, n = self.ids_of(place)
        data, size = self.decode(ids)
        total = np.concatenate((np.zeros(1, np.int64), np.cumsum(size, dtype=np.int64)))
        ends = np.cumsum(n)
        sizes = total[ends] - total[ends - n]
        same = sizes == end - start
        if same.all() and len(data) == len(t.data) and np.array_equal(data, t.data):
            return same
        same[same] = same_ranges(words_at(data), total[ends - n][same], t.words(), start[same], sizes[same])
        return same


def _loaded(sent, name: str) -> Vocabulary:
    """The broadcast vocabulary of this name, built once in each Python worker, which then drops what was sent."""

    def build() -> Vocabulary:
        out = Vocabulary(*sent.value)
        sent.__dict__.pop("_value", None)
        trim()
        return out

    return kept("vocabulary", name, build)


_PACKED = ("keys", "n_ids", "ids")


def _pack(encoded: DataFrame, wide: bool) -> DataFrame:
    """The encoded words in the order of their hashes (unsigned), packed."""

    def pack(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            ids = column(b, "ids")
            n = np.diff(ids.offsets.to_numpy()).astype(np.uint32)
            raw = [column(b, "hash").to_numpy().tobytes(), n.tobytes(), ids.flatten().to_numpy().astype(np.int32 if wide else np.uint16).tobytes()]
            yield pa.RecordBatch.from_arrays([pa.array([x], pa.binary()) for x in raw], list(_PACKED))

    # A hash with its top bit turned sorts as a signed number as it does unsigned.
    ordered = encoded.select("hash", "ids").withColumn("place", F.col("hash").bitwiseXOR(F.lit(-(1 << 63))))
    ordered = ordered.repartitionByRange("place").sortWithinPartitions("place").select("hash", "ids")
    return ordered.mapInArrow(pack, ", ".join(f"{c} binary" for c in _PACKED))


@contextlib.contextmanager
def _short_plans(spark: SparkSession) -> Iterator[None]:
    """Cuts descriptions of plans short: the literal map is megabytes long, and the driver keeps several copies of each description."""
    name = "spark.sql.maxPlanStringLength"
    old = spark.conf.get(name)
    spark.conf.set(name, "10000")
    try:
        yield
    finally:
        spark.conf.set(name, old)


def encode_documents(docs: DataFrame, path: str, *, text: str = "text", head_bytes: int = 96 << 20, keep_ids: bool = False) -> DataFrame:
    """docs with n_tokens, ids_sha256 and decoded_sha256, and token_ids if keep_ids; columns of these names are replaced."""
    spark = docs.sparkSession
    ranks = load_ranks(path)
    wide = max(ranks.values()) >= 1 << 16
    encoded = encode_words(stored(distinct_words(docs.select(F.col(text).alias("text")))), ranks)
    with _short_plans(spark):
        vocabulary = stored(encoded.select("hash", "word", "n", "ids", (F.col("decoded") == F.col("word")).alias("same")))
    weight = _ENTRY + (4 if wide else 2) * F.size("ids")
    words, same, size = vocabulary.agg(F.count("*"), F.count_if("same"), F.coalesce(F.sum(weight), F.lit(0))).first()
    if words != same:
        raise ValueError("a word does not decode to itself: the ranks lack a single byte")
    head, tail = vocabulary, None
    if size > head_bytes:
        # Words are taken by count: all above the least count for which they fit.
        level = (F.log2("n") * 8).cast("int")
        counts = vocabulary.groupBy(level.alias("level")).agg(F.sum(weight).alias("size")).orderBy(F.desc("level")).collect()  # a row for each eighth of a power of two
        total, least = 0, None
        for r in counts:
            if (total := total + r["size"]) > head_bytes:
                break
            least = r.level
        is_head = F.lit(False) if least is None else level >= least
        head, tail = vocabulary.where(is_head), vocabulary.where(~is_head)
    pieces = [b""] * (max(ranks.values()) + 1)
    for piece, k in ranks.items():
        pieces[k] = piece
    sent = spark.sparkContext.broadcast(([tuple(bytes(r[c]) for c in _PACKED) for r in _pack(head, wide).toLocalIterator()], pieces))
    sent.__dict__.pop("_value", None)  # the driver needs no copy beside the one that is sent
    trim()
    return _assemble(docs, text, tail, sent, uuid.uuid4().hex, keep_ids)


def _with_tail(docs: DataFrame, text: str, tail: DataFrame, sent, name: str, listed: str) -> DataFrame:
    """docs with the column listed: the entries of their words that are not broadcast."""

    def lacking(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known = _loaded(sent, name)
        for t in text_slices(batches, "text", keep="vocabulary"):
            batch = t.batch
            t, row, start, end = words_of(t)
            if len(start):
                miss = np.flatnonzero(known.find(t.hashes(start, end)) < 0)
                raw = t.data.tobytes()
                pairs = {(r, raw[s:e]) for r, s, e in zip(row[miss].tolist(), start[miss].tolist(), end[miss].tolist(), strict=True)}
                keys = column(batch, "key").take(pa.array([r for r, _ in pairs], pa.int64()))
                yield pa.RecordBatch.from_arrays([keys, pa.array([w for _, w in pairs], pa.binary())], ["key", "word"])

    key = fresh("__key", docs)
    keyed = docs.withColumn(key, F.sha2(F.coalesce(text, F.lit("")), 256))
    need = keyed.select(F.col(key).alias("key"), F.col(text).alias("text")).mapInArrow(lacking, "key string, word binary").distinct()
    lists = need.join(tail.select("word", "ids"), "word").groupBy(F.col("key").alias(key)).agg(F.collect_list(F.struct("word", "ids")).alias(listed))
    return keyed.join(lists, key, "left").drop(key)


def _assemble(docs: DataFrame, text: str, tail: DataFrame | None, sent, name: str, keep_ids: bool) -> DataFrame:
    new = ["n_tokens", "ids_sha256", "decoded_sha256"] + ["token_ids"] * keep_ids
    names = others(docs, *new)
    schema = T.StructType([docs.schema[c] for c in names]).add("n_tokens", "long").add("ids_sha256", "string").add("decoded_sha256", "string")
    if keep_ids:
        schema = schema.add("token_ids", T.ArrayType(T.IntegerType()))
    needed, listed = list(dict.fromkeys([*names, text])), fresh("__tail", docs)
    has_tail = tail is not None
    if has_tail:
        docs = _with_tail(docs, text, tail, sent, name, listed)
        needed.append(listed)

    def words_with(batch: pa.RecordBatch, t: Texts, start: np.ndarray, end: np.ndarray, place: np.ndarray, known: Vocabulary) -> tuple[np.ndarray, np.ndarray]:
        """Ids and their counts when some words (place -1) come from the lists beside the documents, or have the hash of another word."""
        own = {e["word"]: e["ids"] for entries in column(batch, listed).to_pylist() for e in entries or ()} if has_tail else {}
        lists = [None] * len(place)
        raw = t.data.tobytes()
        for k in np.flatnonzero(place < 0).tolist():
            word = raw[start[k] : end[k]]
            if word not in own:
                own[word] = merged_ids(word, known.ranks)
            lists[k] = own[word]
        held = np.flatnonzero(place >= 0)
        ids, n = known.ids_of(place[held])
        size = np.array([0 if x is None else len(x) for x in lists], np.int64)
        size[held] = n
        out = np.empty(int(size.sum()), np.int32)
        at = np.cumsum(size) - size
        out[gather(np.arange(len(out)), at[held], n)] = ids
        rest = np.flatnonzero(place < 0)
        out[gather(np.arange(len(out)), at[rest], size[rest])] = [x for k in rest.tolist() for x in lists[k]]
        return out, size

    def assemble(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known = _loaded(sent, name)
        for t in text_slices(batches, text, keep="vocabulary"):
            batch = t.batch
            t, row, start, end = words_of(t)
            place = known.find(t.hashes(start, end))
            held = np.flatnonzero(place >= 0)
            place[held[~known.holds(t, start[held], end[held], place[held])]] = -1
            ids, n_ids = words_with(batch, t, start, end, place, known) if (place < 0).any() else known.ids_of(place)
            n = np.bincount(row, n_ids, minlength=t.rows).astype(np.int64)
            a = np.concatenate(([0], np.cumsum(n)))
            data, size = known.decode(ids)
            data = data.tobytes()
            z = np.concatenate(([0], np.cumsum(size, dtype=np.int64)))[a]
            texts = list(map(known.shown.__getitem__, ids.tolist()))
            ids_sha = [hashlib.sha256(",".join(texts[a[k] : a[k + 1]]).encode()).hexdigest() for k in range(t.rows)]
            dec_sha = [hashlib.sha256(data[z[k] : z[k + 1]]).hexdigest() for k in range(t.rows)]
            cols = [*(column(batch, c) for c in names), pa.array(n), pa.array(ids_sha), pa.array(dec_sha)]
            if keep_ids:
                cols.append(pa.ListArray.from_arrays(pa.array(a.astype(np.int32)), pa.array(ids.astype(np.int32))))
            yield pa.RecordBatch.from_arrays(cols, [*names, *new])

    return docs.select(*needed).mapInArrow(assemble, schema)
