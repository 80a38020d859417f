"""Token counts by the whole-token shortcut.

Once on the driver, every vocabulary string that is one pre-token is put through the tokenizer; those
that come back as their own single id are proved to be one token wherever that pre-token stands,
for merges never cross pre-tokens. Texts are split into pre-tokens; proved ones count one by a table
look-up and only the rest is merged, by the library's model, each distinct one once a worker (in a table of bounded size).

Splitting and counting work on arrays of a slice of documents; words are known by 64-bit hashes.
Texts that hold a special string (a single token that splits them, by the tokenizer's default) or
code points that engines may class differently go through the tokenizer itself.

Defined results: null text counts as empty (no tokens); all rows are counted, whatever repeats; an
empty table gives an empty result; a column of docs named n_tokens is replaced.
"""

from __future__ import annotations

import functools
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import types as T

from loomspan.llm._bpe import WordTable, as_bytes, pre_tokens, split, valid, word_ids
from loomspan.llm._common import Texts, column, kept, others, text_slices


@functools.lru_cache(maxsize=2)
def tokenizer(path: str):
    from tokenizers import Tokenizer

    return Tokenizer.from_file(path)


def library_ids(path: str, text: str) -> list[int]:
    return tokenizer(path).encode(text, add_special_tokens=False).ids


def prove_whole(path: str) -> list[str]:
    """Vocabulary strings that the tokenizer encodes, alone, as their own single id."""
    tok = tokenizer(path)
    special = {t.content for t in tok.get_added_tokens_decoder().values()}
    strings, ids = [], []
    for token, i in tok.get_vocab(with_added_tokens=False).items():
        try:
            text = as_bytes(token).decode()
        except (KeyError, UnicodeDecodeError):
            continue
        if text not in special and pre_tokens(text) == [text]:
            strings.append(text)
            ids.append(i)
    found = tok.encode_batch(strings, add_special_tokens=False)
    return [s for s, i, e in zip(strings, ids, found, strict=True) if e.ids == [i]]


def special_rows(t: Texts, specials: list[str]) -> np.ndarray:
    """Rows that hold a special string."""
    found = set()
    raw = t.data.tobytes()
    for special in map(str.encode, specials):
        at = raw.find(special)
        while at >= 0:
            found.add(int(np.searchsorted(t.offsets, at, "right")) - 1)
            at = raw.find(special, at + 1)
    return np.array(sorted(found), np.int64)


class Counter:
    """Counts tokens of texts."""

    def __init__(self, path: str, whole: list[str], specials: list[str]):
        self.path, self.specials = path, specials
        known = {w.encode() for w in whole}
        merged = word_ids(tokenizer(path).model)

        def counts(t: Texts, start: np.ndarray, end: np.ndarray) -> list[list[int]]:
            words = [t.data[s:e].tobytes() for s, e in zip(start.tolist(), end.tolist(), strict=True)]
            rest = np.array([w not in known for w in words], bool)
            out = [[1]] * len(words)
            for k, ids in zip(np.flatnonzero(rest).tolist(), merged(t, start[rest], end[rest]), strict=True):
                out[k] = [len(ids)]
            return out

        self.table = WordTable(counts)

    def count(self, t: Texts) -> np.ndarray:
        t = valid(t)
        row, start, end, unsure = split(t)
        n = np.zeros(t.rows, np.int64)
        if len(row):
            place = self.table.find(t, start, end)
            n = np.bincount(row, self.table.values[place], minlength=t.rows).astype(np.int64)
        for i in np.union1d(unsure, special_rows(t, self.specials)):
            n[i] = len(library_ids(self.path, t.text(i).decode()))
        return n


def count_tokens(docs: DataFrame, path: str, *, text: str = "text", n_tokens: str = "n_tokens") -> DataFrame:
    """docs with the number of tokens of text."""
    names = others(docs, n_tokens)
    schema = T.StructType([docs.schema[c] for c in names]).add(n_tokens, "long")
    special = sorted(t.content for t in tokenizer(path).get_added_tokens_decoder().values())
    sent = docs.sparkSession.sparkContext.broadcast((prove_whole(path), special))

    def counted(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        counter = kept("counter", path, lambda: Counter(path, *sent.value))
        for t in text_slices(batches, text, keep="counter"):
            n = counter.count(t)
            yield pa.RecordBatch.from_arrays([*(column(t.batch, c) for c in names), pa.array(n)], [*names, n_tokens])

    return docs.mapInArrow(counted, schema)
