"""Many names in many texts at once, as substrings or between word borders.

Names go in shards of about ``SHARD_BYTES``, by hash; each shard is broadcast to one scan of the texts. Of each name
the scan knows one run of up to four bytes, its anchor: the run that the fewest other names and the fewest texts of a small sample have.
A slice of texts is looked through for anchors in arrays; only where one stands the whole name is compared, byte by
byte. So the work follows the texts, not texts times names, and no pattern is compiled. The sample decides nothing but speed.

Defined results: null texts and null or empty names match nothing; names that repeat under several ids match for each;
a text that repeats is reported for each row; one row a text and name, with the place of the first match in code points.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from loomspan.functions.text import clean, lead_phrase, quote_fragments, quote_pattern, squeeze
from loomspan.operators.segment import fresh
from loomspan.sources.snapshot import scratch

#: Bytes of names that are broadcast at once, of texts that are worked on at once, pairs compared at once, and texts of the sample.
SHARD_BYTES, SLICE, PAIRS, SAMPLE = 4 << 20, 1 << 20, 1 << 18, 500
_MASK = np.array([(1 << 8 * k) - 1 for k in range(9)], np.uint64)


def _words_at(data: np.ndarray) -> np.ndarray:
    """The 8 bytes from each place on, zero past the end."""
    padded = np.zeros(len(data) + 8, np.uint8)
    padded[: len(data)] = data
    return np.ndarray(len(data) + 1, "<u8", padded, strides=(1,))


def _bytes_of(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """Bytes and offsets of a string column."""
    column = column.cast(pa.large_string())
    _, offsets, data = column.buffers()
    ends = np.frombuffer(offsets, np.int64)[column.offset : column.offset + len(column) + 1] if len(column) else np.zeros(1, np.int64)
    raw = np.frombuffer(data, np.uint8) if data is not None else np.zeros(0, np.uint8)
    return raw[ends[0] : ends[-1]], ends - ends[0]


def _same(a: np.ndarray, at_a: np.ndarray, b: np.ndarray, at_b: np.ndarray, n: np.ndarray) -> np.ndarray:
    """Whether n bytes at these places are the same. a, b: as of _words_at."""
    ok, left, k = np.ones(len(n), bool), np.flatnonzero(n > 0), 0
    while len(left):
        same = ((a[at_a[left] + k] ^ b[at_b[left] + k]) & _MASK[np.minimum(n[left] - k, 8)]) == 0
        ok[left[~same]] = False
        k += 8
        left = left[same & (n[left] > k)]
    return ok


def _slots(grams: np.ndarray) -> np.ndarray:
    return ((grams * np.uint64(0x9E3779B97F4A7C15)) >> np.uint64(44)).astype(np.int64)


class Matcher:
    """The names of a shard with their anchors, by the width of these."""

    def __init__(self, names: pa.Array, sample: pa.Array):
        self.data, offsets = _bytes_of(names)
        self.start, self.size = offsets[:-1], np.diff(offsets)
        self.tables = []
        words, seen = _words_at(self.data), _words_at(_bytes_of(sample)[0])[:-1]
        for width in range(1, 5):
            own = np.flatnonzero(self.size >= 4 if width == 4 else self.size == width)
            if not len(own):
                continue
            runs = self.size[own] - width + 1
            name = np.repeat(own, runs)
            offset = np.arange(len(name)) - np.repeat(np.cumsum(runs) - runs, runs)
            gram = words[self.start[name] + offset] & _MASK[width]
            kinds, kind = np.unique(gram, return_inverse=True)
            common = np.bincount(kind) * (1.0 + np.bincount(_slots(seen & _MASK[width]), minlength=1 << 20)[_slots(kinds)])
            best = np.lexsort((offset, common[kind], name))
            first = best[np.concatenate(([True], name[best][1:] != name[best][:-1]))]
            order = np.argsort(kind[first], kind="stable")
            first = first[order]
            anchors, count = np.unique(gram[first], return_counts=True)
            there = np.zeros(1 << 20, bool)
            there[_slots(anchors)] = True
            self.tables.append((width, anchors, np.cumsum(count) - count, count, name[first], offset[first], there))
        self.words = words

    def __getstate__(self):
        return self.data, self.start, self.size, self.tables

    def __setstate__(self, state):
        self.data, self.start, self.size, self.tables = state
        self.words = _words_at(self.data)

    def find(self, data: np.ndarray, offsets: np.ndarray, bordered: bool) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Row, name and first place (in code points) of each match."""
        words, found = _words_at(data), []
        inside = _word_bytes(data) if bordered else None
        for width, anchors, begin, count, name, offset, there in self.tables:
            gram = words[:-1] & _MASK[width]
            at = np.flatnonzero(there[_slots(gram)])
            which = np.minimum(np.searchsorted(anchors, gram[at]), len(anchors) - 1)
            hit = anchors[which] == gram[at]
            at, which = at[hit], which[hit]
            ends = np.cumsum(count[which])
            start = 0
            while start < len(at):
                base = ends[start - 1] if start else 0
                stop = max(start + 1, int(np.searchsorted(ends, base + PAIRS, "right")))
                n = count[which[start:stop]]
                pair = np.repeat(begin[which[start:stop]] - (np.cumsum(n) - n), n) + np.arange(n.sum())
                found.append(self._checked(words, offsets, np.repeat(at[start:stop], n) - offset[pair], name[pair], inside))
                start = stop
        if not found:
            return (np.zeros(0, np.int64),) * 3
        row, name, place = (np.concatenate(x) for x in zip(*found, strict=True))
        order = np.lexsort((place, name, row))
        row, name, place = row[order], name[order], place[order]
        first = np.ones(len(row), bool)
        first[1:] = (row[1:] != row[:-1]) | (name[1:] != name[:-1])
        row, name, place = row[first], name[first], place[first]
        points = np.concatenate(([0], np.cumsum((data & 0xC0) != 0x80)))
        return row, name, points[place] - points[offsets[row]]

    def _checked(self, words, offsets, place, name, inside) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        row = np.searchsorted(offsets, place, "right") - 1
        end = place + self.size[name]
        ok = (place >= 0) & (row >= 0)
        ok[ok] = end[ok] <= offsets[row[ok] + 1]
        row, name, place, end = row[ok], name[ok], place[ok], end[ok]
        ok = _same(words, place, self.words, self.start[name], self.size[name])
        if inside is not None:
            before = np.where(place > offsets[row], inside[place - 1], False)
            after = np.where(end < offsets[row + 1], inside[np.minimum(end, len(inside) - 1)], False)
            ok &= (before != inside[place]) & (after != inside[end - 1])
        return row[ok], name[ok], place[ok]


def _word_bytes(data: np.ndarray) -> np.ndarray:
    """Which bytes belong to word characters: letters, numbers and the low line."""
    table = np.zeros(256, bool)
    table[[ord(c) for c in "_0123456789abcdefghijklmnopqrstuvwxyzABCDEFGHIJKLMNOPQRSTUVWXYZ"]] = True
    out = table[data]
    if (data >= 128).any():
        points = np.frombuffer(data.tobytes().decode("utf-8", "surrogatepass").encode("utf-32-le", "surrogatepass"), np.uint32)
        kinds, kind = np.unique(points, return_inverse=True)
        word = np.array([chr(c).isalnum() or c == 95 for c in kinds.tolist()], bool)[kind]
        out = np.repeat(word, 1 + (points > 0x7F) + (points > 0x7FF) + (points > 0xFFFF))
    return out


def find_names(texts: DataFrame, names: DataFrame, *, text: str = "text", fold: bool = False, bordered: bool = False, shard_bytes: int = SHARD_BYTES) -> DataFrame:
    """(columns of texts without the text, name_id, start) for each row of texts and name of names(name_id, name) that it holds.

    fold: whatever the case. bordered: with a border of a word at both ends of the match, as patterns have it.
    """
    spark = texts.sparkSession
    case = F.lower if fold else lambda c: c
    kept = [c for c in texts.columns if c.lower() != text.lower()]
    body = fresh("body", texts)
    rows = texts.select(*kept, F.coalesce(case(F.col(text)), F.lit("")).alias(body))
    ids = names.schema["name_id"]
    schema = T.StructType([*(texts.schema[c] for c in kept), T.StructField(fresh("name_id", texts), ids.dataType), T.StructField(fresh("start", texts), T.LongType())])
    asked = names.select("name_id", case(F.col("name")).alias("name")).where("name <> ''")
    size = asked.agg(F.sum(F.octet_length("name")).alias("bytes")).first().bytes or 0
    shards = max(1, -(-size // shard_bytes))
    sample = rows.select(body).limit(SAMPLE).toArrow()[body].combine_chunks()
    path, found = scratch(spark), None

    def scan(sent):
        def match(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            name_ids, matcher = sent.value
            for b in batches:
                column = b.column(len(kept))
                ends, start = np.cumsum(pc.binary_length(column).to_numpy().astype(np.int64)), 0
                while start < b.num_rows:
                    stop = max(start + 1, int(np.searchsorted(ends, (ends[start - 1] if start else 0) + SLICE, "right")))
                    row, name, place = matcher.find(*_bytes_of(column.slice(start, stop - start)), bordered)
                    taken = [b.column(k).take(pa.array(row + start)) for k in range(len(kept))]
                    yield pa.RecordBatch.from_arrays([*taken, name_ids.take(pa.array(name)), pa.array(place)], schema.names)
                    start = stop

        return match

    for s in range(shards):
        some = asked.where(F.pmod(F.xxhash64("name"), F.lit(shards)) == s).toArrow()
        held = some["name_id"].combine_chunks(), Matcher(some["name"].combine_chunks(), sample)
        sent = spark.sparkContext.broadcast(held)
        found = rows.mapInArrow(scan(sent), schema)
        if shards > 1:
            found.write.mode("append").parquet(path)
            sent.destroy()
    return found if shards == 1 else spark.read.schema(schema).parquet(path)


def first_phrase(texts: DataFrame, passages: DataFrame, *, text: str = "text", sizes: tuple[int, ...] = (8, 4)) -> DataFrame:
    """(columns of texts, passage_id, words, start): for each text and passage(passage_id, text) the first of the passage's opening phrases that the text holds, whatever the case.

    Phrases are tried from the longest on and end with the first that is under 12 characters. All are looked for in one scan.
    """
    phrases, so_far = [], F.lit(True)
    for n in sizes:
        phrase = lead_phrase(F.col("text"), n)
        so_far = so_far & phrase.isNotNull()
        phrases.append(F.struct(F.struct(F.col("passage_id").alias("passage_id"), F.lit(n).alias("words")).alias("name_id"), F.when(so_far, phrase).alias("name")))
    names = passages.select(F.inline(F.array(*phrases))).where("name is not null")
    kept = [c for c in texts.columns if c.lower() != text.lower()]
    row = fresh("row_of", texts)  # rows of texts may repeat
    hits = find_names(texts.select(*kept, F.monotonically_increasing_id().alias(row), clean(F.col(text)).alias(text)), names, text=text, fold=True)
    best = hits.groupBy(row, *kept, F.col("name_id.passage_id").alias("passage_id")).agg(F.max_by(F.struct("name_id.words", "start"), "name_id.words").alias("best"))
    return best.select(*kept, "passage_id", "best.words", "best.start")


def quotes_in(documents: DataFrame, quotes: DataFrame) -> DataFrame:
    """(quote_id, doc_id, start, end) of each quote(quote_id, quote) in each document(doc_id, text) that holds one of its fragments, the longest that is there.

    Squeezed fragments are looked for in squeezed documents, all in one scan; only documents and fragments that meet there are compared by pattern.
    Documents with the same id are told apart by their texts.
    """
    pieces = quotes.select("quote_id", F.posexplode(quote_fragments(F.col("quote"))).alias("k", "fragment")).where(F.coalesce(squeeze(F.col("fragment")), F.lit("")) != "")
    names = pieces.select(F.struct("quote_id", "k", "fragment").alias("name_id"), squeeze(F.col("fragment")).alias("name"))
    bare = documents.select("doc_id", F.md5("text").alias("version"), squeeze(F.col("text")).alias("text")).dropDuplicates(["doc_id", "version"])
    found = find_names(bare, names).select("doc_id", "version", "name_id.*")
    texts = documents.select("doc_id", "text", F.md5("text").alias("version")).dropDuplicates(["doc_id", "version"])
    hit = F.regexp_substr("text", quote_pattern(F.col("fragment")))
    seen = found.join(texts, ["doc_id", "version"]).withColumn("hit", hit).where("hit <> ''").withColumn("start", F.position("hit", "text") - 1)
    first = seen.groupBy("quote_id", "doc_id", "version").agg(F.min_by(F.struct("start", (F.col("start") + F.length("hit")).alias("end")), "k").alias("at"))
    return first.select("quote_id", "doc_id", "at.start", "at.end")
