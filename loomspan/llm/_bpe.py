"""Splitting into pre-tokens, in arrays, and ranked merges of byte pairs."""

from __future__ import annotations

import functools
import heapq
import unicodedata
from collections.abc import Callable

import numpy as np
import public_tokenizers
import pyarrow as pa
import regex

from loomspan.llm._common import Texts, grouped, same_ranges, words_at

_PATTERN = regex.compile(public_tokenizers.PATTERN)
#: Below this all the engines agree on letters, digits and white space.
_FIRST_UNSURE = 0x540
_LETTER, _DIGIT, _SPACE, _OTHER, _UNSURE = range(5)
#: The code points of White_Space (fixed values).
_WHITE = [*range(9, 14), 0x20, 0x85, 0xA0, 0x1680, *range(0x2000, 0x200B), 0x2028, 0x2029, 0x202F, 0x205F, 0x3000]


@functools.cache
def _classes() -> np.ndarray:
    """The class of each code point. Engines may disagree on those not assigned yet in this Python's tables."""
    out = np.full(0x110000, _OTHER, np.uint8)
    for c in range(0x110000):
        kind = unicodedata.category(chr(c))
        if kind[0] in "LN":
            out[c] = _LETTER if kind[0] == "L" else _DIGIT
        elif kind == "Cn" and c >= _FIRST_UNSURE:
            out[c] = _UNSURE
    out[_WHITE] = _SPACE
    return out


def pre_tokens(text: str) -> list[str]:
    return _PATTERN.findall(text)


def valid(t: Texts) -> Texts:
    """t, or its copy with broken UTF-8 replaced."""
    try:
        t.data.tobytes().decode()
        return t
    except UnicodeDecodeError:
        fixed = [t.text(i).decode("utf-8", "replace") for i in range(t.rows)]
        out = Texts(pa.RecordBatch.from_arrays([pa.array(fixed, pa.large_string())], ["text"]), "text")
        out.batch = t.batch
        return out


def split(t: Texts) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Row, first byte and end of each pre-token, and rows that need an engine's own tables instead.

    Runs of letters, digits, white space and others are found in arrays. A space before another run
    belongs to it; the white space before that, or before a last character that is no space, stands
    alone; an apostrophe that begins its run takes the ending of a contraction from the letters.
    """
    codes = np.frombuffer(t.data.tobytes().decode().encode("utf-32-le"), np.uint32)
    n = len(codes)
    none = np.zeros(0, np.int64)
    if not n:
        return none, none, none, none
    at = np.append(np.flatnonzero((t.data & 0xC0) != 0x80), len(t.data))
    kind = _classes()[codes]
    rows = np.searchsorted(at, t.offsets)
    first = np.zeros(n + 1, bool)
    first[rows] = True
    first[n] = True
    unsure = np.unique(np.searchsorted(rows, np.flatnonzero(kind == _UNSURE), "right") - 1) if (kind == _UNSURE).any() else none
    begins = first[:n].copy()
    begins[1:] |= kind[1:] != kind[:-1]
    space = kind == _SPACE
    last = np.zeros(n, bool)  # of white space before something else in the row
    last[:-1] = space[:-1] & ~space[1:] & ~first[1:n]
    joins = last & (codes == 32)
    starts = begins | last
    starts[1:] &= ~(joins[:-1] & ~space[1:])
    quote = np.flatnonzero((codes == 39) & begins & starts)
    quote = quote[quote + 1 < n]
    quote = quote[(kind[quote + 1] == _LETTER) & ~first[quote + 1]]
    if len(quote):
        c1 = codes[quote + 1]
        two = np.minimum(quote + 2, n - 1)
        c2 = np.where((quote + 2 < n) & ~first[np.minimum(quote + 2, n)], codes[two], 0)
        size = np.zeros(len(quote), np.int64)
        for letter in "stmd":
            size[c1 == ord(letter)] = 1
        for a, b in ("re", "ve", "ll"):
            size[(c1 == ord(a)) & (c2 == ord(b))] = 2
        quote, size = quote[size > 0], size[size > 0]
        starts[quote + 1] = False
        rest = quote + 1 + size
        rest = rest[rest < n]
        starts[rest] |= (kind[rest] == _LETTER) & ~first[rest]
    s = np.flatnonzero(starts)
    return np.searchsorted(rows, s, "right") - 1, at[s], at[np.append(s[1:], n)], unsure


class WordTable:
    """Values of distinct words: ``make`` gives a list of integers for each new word.

    Words are found by hash and their bytes are compared; one whose hash belongs to another word is
    kept by its bytes. The table forgets everything when it holds ``most`` words or ``most_bytes``
    of them, so its memory is bounded.
    """

    def __init__(self, make: Callable[[Texts, np.ndarray, np.ndarray], list[list[int]]], most: int = 300_000, most_bytes: int = 8 << 20):
        self.make, self.most, self.most_bytes = make, most, most_bytes
        self.clear()

    def clear(self) -> None:
        self.keys, self.places = np.zeros(0, np.uint64), np.zeros(0, np.int32)
        self.offsets, self.values = np.zeros(1, np.int64), np.zeros(0, np.int32)
        self.at, self.size, self.bytes = np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(0, np.uint8)
        self.others: dict[bytes, int] = {}

    def _add(self, t: Texts, start: np.ndarray, end: np.ndarray) -> np.ndarray:
        made = self.make(t, start, end)
        place = len(self.offsets) - 1 + np.arange(len(made))
        self.offsets = np.append(self.offsets, self.offsets[-1] + np.cumsum([len(m) for m in made]))
        self.values = np.append(self.values, np.array([x for m in made for x in m], np.int32))
        return place.astype(np.int32)

    def find(self, t: Texts, start: np.ndarray, end: np.ndarray) -> np.ndarray:
        """The place of each word in the table."""
        if len(self.offsets) > self.most or len(self.bytes) > self.most_bytes:
            self.clear()
        words = t.words()
        h = t.hashes(start, end)
        lead, group, apart = grouped(words, start, end, h)
        u = h[lead]
        at = np.searchsorted(self.keys, u)
        known = np.zeros(len(u), bool)
        known[at < len(self.keys)] = self.keys[at[at < len(self.keys)]] == u[at < len(self.keys)]
        place = np.full(len(u), -1, np.int32)
        spot, size = self.places[at[known]], (end - start)[lead[known]]
        same = self.size[spot] == size
        same[same] = same_ranges(words, start[lead[known]][same], words_at(self.bytes), self.at[spot[same]], size[same])
        place[known] = np.where(same, spot, -1)
        new = ~known
        if new.any():
            s, e = start[lead[new]], end[lead[new]]
            place[new] = self._add(t, s, e)
            self.keys, self.places = np.insert(self.keys, at[new], u[new]), np.insert(self.places, at[new], place[new])
            self._keep(gather(t.data, s, e - s), e - s)
        out = place[group]
        rest = {i: t.data[start[i] : end[i]].tobytes() for i in np.union1d(apart, np.flatnonzero(out < 0)).tolist()}
        new = {w: i for i, w in rest.items() if w not in self.others}
        if new:
            i = np.array(list(new.values()))
            self.others |= zip(new, self._add(t, start[i], end[i]).tolist(), strict=True)
            self._keep(np.zeros(0, np.uint8), np.zeros(len(new), np.int64))
        for i, word in rest.items():
            out[i] = self.others[word]
        return out

    def _keep(self, data: np.ndarray, size: np.ndarray) -> None:
        self.at = np.append(self.at, len(self.bytes) + np.cumsum(size) - size)
        self.size = np.append(self.size, size)
        self.bytes = np.append(self.bytes, data)

    def sizes(self, place: np.ndarray) -> np.ndarray:
        return self.offsets[place + 1] - self.offsets[place]


def word_ids(model) -> Callable[[Texts, np.ndarray, np.ndarray], list[list[int]]]:
    """Ids of pre-tokens by a byte-level model of the tokenizers library, whose letters stand for single bytes."""
    letters = {b: c for c, b in byte_letters().items()}

    def make(t: Texts, start: np.ndarray, end: np.ndarray) -> list[list[int]]:
        shown = gather(t.data, start, end - start).tobytes().decode("latin-1").translate(letters)
        size = end - start
        ends = np.cumsum(size)
        return [[x.id for x in model.tokenize(shown[s:e])] for s, e in zip((ends - size).tolist(), ends.tolist(), strict=True)]

    return make


def gather(values: np.ndarray, start: np.ndarray, size: np.ndarray) -> np.ndarray:
    """The ranges of values one after the other."""
    ends = np.cumsum(size)
    return values[np.repeat(start - (ends - size), size) + np.arange(ends[-1] if len(ends) else 0)]


def merge(piece: bytes, rank: Callable[[bytes, bytes], int | None]) -> list[bytes]:
    """Merges the neighbours of least rank, leftmost first, until none has a rank; n log n steps."""
    parts: list[bytes | None] = [piece[k : k + 1] for k in range(len(piece))]
    n = len(parts)
    after, before = list(range(1, n + 1)), list(range(-1, n - 1))
    heap = [(r, k, 2) for k in range(n - 1) if (r := rank(parts[k], parts[k + 1])) is not None]
    heapq.heapify(heap)
    while heap:
        _, k, size = heapq.heappop(heap)
        if parts[k] is None or (j := after[k]) >= n or len(parts[k]) + len(parts[j]) != size:
            continue
        parts[k] += parts[j]
        parts[j] = None
        after[k] = after[j]
        if after[k] < n:
            before[after[k]] = k
            if (r := rank(parts[k], parts[after[k]])) is not None:
                heapq.heappush(heap, (r, k, len(parts[k]) + len(parts[after[k]])))
        if (i := before[k]) >= 0 and (r := rank(parts[i], parts[k])) is not None:
            heapq.heappush(heap, (r, i, len(parts[i]) + len(parts[k])))
    return [p for p in parts if p is not None]


@functools.cache
def byte_letters() -> dict[str, int]:
    """The printable letter that stands for each byte in byte-level vocabularies, to the byte."""
    shown = [*range(33, 127), *range(161, 173), *range(174, 256)]
    hidden = [b for b in range(256) if b not in set(shown)]
    return {chr(b): b for b in shown} | {chr(256 + k): b for k, b in enumerate(hidden)}


def as_bytes(token: str) -> bytes:
    letters = byte_letters()
    return bytes(letters[c] for c in token)
