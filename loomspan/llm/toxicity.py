"""Toxicity by a counterfactually regularised linear classifier.

Features are the presence of hashed words and of their first four, five and six bytes, so stems with
changing endings are learnt too. A logistic regression is fitted on at most ``max_rows`` labelled
rows (those with the least hash of their id: a documented bound on the sample; scoring covers all
rows). Sentences of these rows that name a group, at most ``pairs_per_row`` of a row, are copied with the name swapped for another of
its list, and the squared change of their score is penalised, so a neutral mention of a group
carries little weight by itself. Every name is also placed in a sentence by itself and swapped, so
the penalty has its pairs where no labelled sentence names a group. (The rest of a sentence is the
same on both sides and cancels out in a linear score, so any neutral sentence gives the same pair.)

Defined results: null text scores as the empty text; labels that are null or whose doc_id is null or
absent from docs teach nothing; several labels of one doc_id count as the largest, and of several texts the least is learnt; with no labels,
or labels of one kind, every score is the smoothed share of toxic labels; a null doc_id is not held
out.
"""

from __future__ import annotations

import re
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from loomspan.llm._common import ALNUM, LOWER, U64, Texts, column, mix, others, stored, text_slices, trim

BITS = 20
PREFIXES = (4, 5, 6)
#: Names of groups that may stand for each other, in the languages of the documents; a name is in one list only.
IDENTITY_TERMS = (
    ("women", "men", "girls", "boys"),
    ("woman", "man", "girl", "boy"),
    ("muslims", "christians", "jews", "hindus", "buddhists", "atheists"),
    ("muslim", "christian", "jewish", "hindu", "buddhist", "atheist"),
    ("black", "white", "asian", "latino"),
    ("gay", "straight", "lesbian", "bisexual", "transgender"),
    ("immigrants", "refugees", "foreigners", "natives"),
    ("old", "young"),
    ("disabled", "blind", "deaf"),
    # French
    ("femmes", "hommes", "filles", "garçons"),
    ("femme", "homme", "fille", "garçon"),
    ("musulmans", "chrétiens", "juifs", "hindous", "bouddhistes", "athées"),
    ("musulman", "chrétien", "juif", "hindou", "bouddhiste", "athée"),
    ("noirs", "blancs", "asiatiques"),
    ("noir", "blanc", "asiatique"),
    ("homosexuel", "hétérosexuel", "bisexuel", "transgenre"),
    ("immigrés", "réfugiés", "étrangers", "autochtones"),
    ("vieux", "jeune"),
    ("vieille", "jeunes"),
    ("handicapés", "aveugles", "sourds"),
    # German
    ("frauen", "männer", "mädchen", "jungs"),
    ("frau", "mann"),
    ("muslime", "christen", "juden", "buddhisten", "atheisten"),
    ("muslimisch", "christlich", "jüdisch", "hinduistisch", "buddhistisch", "atheistisch"),
    ("schwarze", "weiße", "asiatische"),
    ("schwul", "heterosexuell", "lesbisch", "bisexuell"),
    ("einwanderer", "flüchtlinge", "ausländer", "einheimische"),
    ("alte", "junge"),
    ("alten", "jungen"),
    ("behinderte", "blinde", "gehörlose"),
    # Spanish
    ("mujeres", "hombres", "niñas", "niños"),
    ("mujer", "hombre", "niña", "niño"),
    ("musulmanes", "cristianos", "judíos", "hindúes", "budistas", "ateos"),
    ("musulmán", "cristiano", "judío", "hindú", "budista", "ateo"),
    ("negros", "blancos", "asiáticos"),
    ("negro", "blanco", "asiático"),
    ("homosexuales", "heterosexuales", "bisexuales"),
    ("inmigrantes", "refugiados", "extranjeros", "nativos"),
    ("viejo", "joven"),
    ("viejos", "jóvenes"),
    ("discapacitados", "ciegos", "sordos"),
)
_SENTENCE = re.compile(r"[^.!?\n]+")


def held_out(doc_id: Column, modulus: int = 4, remainder: int = 2) -> Column:
    return F.coalesce(F.crc32(doc_id.cast("string")) % modulus == remainder, F.lit(False))


def features(t: Texts) -> tuple[np.ndarray, np.ndarray]:
    """Row and bucket of every word and stem; repeats included."""
    row, s, e = t.pieces(ALNUM[LOWER[t.data]])
    rows, found = [row], [t.hashes(s, e, lower=True)]
    for k in PREFIXES:
        longer = e - s > k
        rows.append(row[longer])
        found.append(mix(t.hashes(s[longer], s[longer] + k, lower=True) + U64(k)))
    return np.concatenate(rows), (np.concatenate(found) >> U64(64 - BITS)).astype(np.int64)


def distinct(row: np.ndarray, bucket: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    key = np.unique((row << BITS) | bucket)
    return key >> BITS, key & ((1 << BITS) - 1)


def of_texts(texts: list[str]) -> list[np.ndarray]:
    t = Texts(pa.RecordBatch.from_arrays([pa.array(texts, pa.large_string())], ["text"]), "text")
    row, bucket = distinct(*features(t))
    at = np.searchsorted(row, np.arange(len(texts) + 1))
    return [bucket[a:b] for a, b in zip(at[:-1], at[1:], strict=True)]


class Swaps:
    """Rewrites of sentences with another name of the same list."""

    def __init__(self, groups=IDENTITY_TERMS):
        self.other = {w: g[(k + 1) % len(g)] for g in groups for k, w in enumerate(g)}
        self.find = re.compile(r"\b(?:" + "|".join(map(re.escape, self.other)) + r")\b", re.I) if self.other else re.compile(r"(?!)")

    def pairs(self, text: str) -> list[tuple[str, str]]:
        out = []
        if self.find.search(text):
            for m in _SENTENCE.finditer(text):
                if self.find.search(m[0]):
                    out.append((m[0], self.find.sub(lambda w: self.other[w[0].lower()], m[0])))
        return out


def placed_names(groups=IDENTITY_TERMS) -> list[tuple[np.ndarray, np.ndarray]]:
    """Each name and the next of its list, as features."""
    pairs = [(w, g[(k + 1) % len(g)]) for g in groups for k, w in enumerate(g)]
    found = of_texts([w for p in pairs for w in p])
    return list(zip(found[::2], found[1::2], strict=True))


@dataclass
class Model:
    weights: np.ndarray
    bias: float
    #: Sentences with a swapped name that training had, and names placed by themselves.
    swapped: int = 0
    placed: int = 0

    def score(self, t: Texts) -> np.ndarray:
        row, bucket = features(t)
        some = self.weights[bucket] != 0
        row, bucket = distinct(row[some], bucket[some])
        z = self.bias + np.bincount(row, self.weights[bucket].astype(np.float64), minlength=t.rows)
        return 1 / (1 + np.exp(-np.clip(z, -60, 60)))


def _csr(lists: list[np.ndarray], keep: np.ndarray, place: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    kept = [place[x[keep[x]]] for x in lists]
    return np.repeat(np.arange(len(kept)), [len(x) for x in kept]), np.concatenate(kept) if kept else np.zeros(0, np.int64)


def fit(lists: list[np.ndarray], y: np.ndarray, pairs: list[tuple[np.ndarray, np.ndarray]], *, penalty: float = 1.0, l2: float = 3e-4, most: int = 6000, min_docs: int = 3, rounds: int = 400) -> Model:
    """Logistic regression with penalty * mean squared score change over the swapped sentences."""
    size = 1 << BITS
    n, n1 = len(y), int(y.sum())
    if n1 in (0, n):
        share = (n1 + 0.5) / (n + 1) if n else 0.5 / 11
        return Model(np.zeros(size, np.float32), float(np.log(share / (1 - share))))
    df, df1 = np.zeros(size, np.int32), np.zeros(size, np.int32)
    for x, toxic in zip(lists, y, strict=True):
        df[x] += 1
        if toxic:
            df1[x] += 1

    def gain(a, b):  # a of b rows are toxic: log-likelihood ratio against the share of all
        p = np.clip(a / np.maximum(b, 1), 1e-12, 1 - 1e-12)
        return a * np.log(p * n / n1) + (b - a) * np.log((1 - p) * n / (n - n1))

    worth = np.where(df >= min_docs, gain(df1, df), 0)
    keep = np.zeros(size, bool)
    best = np.argsort(-worth, kind="stable")[:most]
    keep[best[worth[best] > 2]] = True
    for a, b in pairs:
        changed = np.setxor1d(a, b)
        keep[changed[df[changed] >= min_docs]] = True
    used = np.flatnonzero(keep)
    place = np.zeros(size, np.int64)
    place[used] = np.arange(len(used))
    row, col = _csr(lists, keep, place)
    prow, pcol, psign = np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(0)
    if pairs:
        ra, ca = _csr([a for a, _ in pairs], keep, place)
        rb, cb = _csr([b for _, b in pairs], keep, place)
        prow, pcol, psign = np.concatenate((ra, rb)), np.concatenate((ca, cb)), np.concatenate((np.ones(len(ra)), -np.ones(len(rb))))
    w, bias = np.zeros(len(used)), float(np.log(n1 / (n - n1)))
    m, v = np.zeros(len(used) + 1), np.zeros(len(used) + 1)
    for k in range(1, rounds + 1):
        z = bias + np.bincount(row, w[col], minlength=n)
        miss = (1 / (1 + np.exp(-np.clip(z, -60, 60))) - y) / n
        g = np.bincount(col, miss[row], minlength=len(used)) + l2 * w
        if len(pairs):
            change = np.bincount(prow, psign * w[pcol], minlength=len(pairs))
            g += 2 * penalty / len(pairs) * np.bincount(pcol, psign * change[prow], minlength=len(used))
        g = np.append(g, miss.sum())
        m, v = 0.9 * m + 0.1 * g, 0.999 * v + 0.001 * g * g
        step = 0.1 * (m / (1 - 0.9**k)) / (np.sqrt(v / (1 - 0.999**k)) + 1e-8)
        w, bias = w - step[:-1], bias - step[-1]
    weights = np.zeros(size, np.float32)
    weights[used] = w
    return Model(weights, float(bias))


def train(docs: DataFrame, labels: DataFrame, *, text: str = "text", doc_id: str = "doc_id", label: str = "toxic", max_rows: int = 8000, pairs_per_row: int = 4, groups=IDENTITY_TERMS, penalty: float = 1.0) -> Model:
    """Fits on the labelled rows of docs that are not held out."""
    known = labels.select(F.col(doc_id).alias("id"), F.col(label).cast("int").alias("y")).where("id is not null and y is not null").where(~held_out(F.col("id")))
    known = known.groupBy("id").agg(F.max("y").alias("y"))
    known = known.join(docs.select(F.col(doc_id).alias("id")).distinct(), "id", "left_semi").orderBy(F.xxhash64("id"), "id").limit(max_rows)
    sample = docs.select(F.col(doc_id).alias("id"), F.col(text).alias("text")).join(F.broadcast(known), "id").groupBy("id", "y").agg(F.min("text").alias("text"))
    swaps = Swaps(groups)

    def extract(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        pack = lambda x: x.astype(np.int32).tobytes()
        for t in text_slices(batches):
            row, bucket = distinct(*features(t))
            at = np.searchsorted(row, np.arange(t.rows + 1))
            ids, y, a, b = column(t.batch, "id").to_pylist(), column(t.batch, "y").to_pylist(), [], []
            a = [pack(bucket[s:e]) for s, e in zip(at[:-1], at[1:], strict=True)]
            b = [None] * t.rows
            for i, whole in enumerate(column(t.batch, "text").to_pylist()):
                for before, after in swaps.pairs(whole or "")[:pairs_per_row]:
                    x, z = of_texts([before, after])
                    ids.append(ids[i])
                    y.append(y[i])
                    a.append(pack(x))
                    b.append(pack(z))
            yield pa.RecordBatch.from_arrays([pa.array(ids, pa.int64()), pa.array(y, pa.int32()), pa.array(a, pa.binary()), pa.array(b, pa.binary())], ["id", "y", "a", "b"])

    rows = sample.select(F.col("id").cast("long").alias("id"), "y", "text").mapInArrow(extract, "id long, y int, a binary, b binary")
    # Written by all tasks, then read one partition at a time: the driver holds the packed features (some 4 KB a row) and little else.
    rows = stored(rows)
    found = [(r.id, bytes(r.a), bytes(r.b) if r.b is not None else None, r.y) for r in rows.toLocalIterator()]
    lists, y, pairs = [], [], []
    for _, a, b, toxic in sorted(found, key=lambda r: (r[0], r[1], r[2] or b"")):
        a = np.frombuffer(a, np.int32)
        if b is not None:
            pairs.append((a, np.frombuffer(b, np.int32)))
        else:
            lists.append(a)
            y.append(toxic > 0)
    del found
    placed = placed_names(groups)
    model = fit(lists, np.array(y, np.float64), pairs + placed, penalty=penalty)
    model.swapped, model.placed = len(pairs), len(placed)
    del lists, pairs
    trim()
    return model


def score_toxicity(docs: DataFrame, model: Model, *, text: str = "text", score: str = "score") -> DataFrame:
    """docs with a column of scores; a column of that name is replaced."""
    names = others(docs, score)
    schema = T.StructType([docs.schema[c] for c in names]).add(score, "double")
    sent = docs.sparkSession.sparkContext.broadcast(model)

    def scored(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        m = sent.value
        for t in text_slices(batches, text):
            yield pa.RecordBatch.from_arrays([*(column(t.batch, c) for c in names), pa.array(m.score(t))], [*names, score])

    return docs.mapInArrow(scored, schema)
