"""Ordering and choosing of hits: floors, deduplication, diversity, hybrid scores, budgets."""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from loomspan.config import CONTEXT_CHARS, MMR_K, MMR_LAMBDA, PASSAGE_CHARS, PASSAGES_CHOSEN, SCORE_FLOOR, SECTION_SHORT


def first_of(rows: DataFrame, keys: list[str], order: list) -> DataFrame:
    """The first row of each key in an order; null keys are equal."""
    w = Window.partitionBy(*keys).orderBy(*order)
    return rows.withColumn("__n", F.row_number().over(w)).where("__n = 1").drop("__n")


def score_floor(hits: DataFrame, floor: float = SCORE_FLOOR) -> DataFrame:
    """hits with score = 1 - distance, of which those below the floor go."""
    return hits.withColumn("score", 1 - F.col("distance")).where(F.col("score") >= floor)


def dedup_max_score(hits: DataFrame, keys: list[str], arrival: str) -> DataFrame:
    """For each key the highest score; the first to arrive wins ties."""
    return first_of(hits, keys, [F.desc("score"), F.col(arrival)])


def mmr(candidates: DataFrame, k: int = MMR_K, lam: float = MMR_LAMBDA) -> DataFrame:
    """(query_id, id, pick) of candidates(query_id, id, pos, score, vector), chosen greedily.

    Each pick has the greatest lam * score - (1 - lam) * (highest similarity to a pick so far), 0 for
    the first, to nine decimals; the earliest candidate wins ties. Up to k candidates stay as they are. A query's
    candidates are few (a top-k), so a group is bounded.
    """

    def choose(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values("pos", kind="stable").reset_index(drop=True)
        if len(pdf) <= k:
            return pd.DataFrame({"query_id": pdf.query_id, "id": pdf.id, "pick": np.arange(1, len(pdf) + 1)})
        m = np.array(pdf.vector.tolist(), np.float64)
        m /= np.sqrt((m * m).sum(1, keepdims=True))
        closest, open_, picks = np.zeros(len(m)), np.ones(len(m), bool), []
        for n in range(k):
            value = np.where(open_, np.round(lam * pdf.score.to_numpy() - (1 - lam) * closest, 9), -np.inf)
            best = int(value.argmax())
            picks.append(best)
            open_[best] = False
            near = m @ m[best]
            closest = near if n == 0 else np.maximum(closest, near)
        return pd.DataFrame({"query_id": pdf.query_id[picks], "id": pdf.id[picks], "pick": np.arange(1, k + 1)})

    return candidates.groupBy("query_id").applyInPandas(choose, "query_id long, id long, pick int")


def keyword_overlap(a: Column, b: Column) -> Column:
    """Share of the terms a that b has."""
    return F.size(F.array_intersect(a, b)) / F.greatest(F.size(a), F.lit(1))


def hybrid_score(cosine: Column, keyword: Column) -> Column:
    return 0.7 * cosine + 0.3 * keyword


def passage_select(scores: DataFrame, k: int = PASSAGES_CHOSEN, short: int = SECTION_SHORT) -> DataFrame:
    """(doc_id, passage_id, place) from scores(doc_id, section, pos, chars, passage_id, score).

    Sections take turns: every section's best passage first, sections by their best score, then the
    second best, skipping what is chosen. Short sections do not take part unless all of a document's are short.
    """
    doc = Window.partitionBy("doc_id")
    s = scores.withColumn("longest", F.max("chars").over(doc)).where((F.col("chars") >= short) | (F.col("longest") < short))
    section = Window.partitionBy("doc_id", "section")
    s = s.withColumn("n", F.row_number().over(section.orderBy(F.desc("score"), "passage_id"))).withColumn("best", F.max("score").over(section))
    s = s.where(F.col("n") <= k)
    s = s.withColumn("turn", F.dense_rank().over(doc.orderBy(F.desc("best"), "pos")))
    s = s.groupBy("doc_id", "passage_id").agg(F.min(F.struct("n", "turn")).alias("first"))
    s = s.withColumn("place", F.row_number().over(doc.orderBy("first.n", "first.turn", "passage_id")))
    return s.where(F.col("place") <= k).select("doc_id", "passage_id", "place")


def cut(text: Column, most: int, tail: str) -> Column:
    return F.when(F.length(text) > most, F.concat(F.substring(text, 1, most), F.lit(tail))).otherwise(text)


def passage_label(*parts: Column) -> Column:
    """"  [a, b]" of the parts that say something, or nothing."""
    some = F.filter(F.array(*(p.cast("string") for p in parts)), lambda x: x.isNotNull() & (x != ""))
    return F.when(F.size(some) > 0, F.concat(F.lit("  ["), F.array_join(some, ", "), F.lit("]"))).otherwise("")


def context_budget(parts: DataFrame, key: str, order: str, text: str, label: Column | None = None, budget: int = CONTEXT_CHARS, part: int = PASSAGE_CHARS) -> DataFrame:
    """The parts of each key, headed by their place and label, before their summed length passes the budget; the first always stays."""
    w = Window.partitionBy(key).orderBy(order)
    t = parts.withColumn("place", F.row_number().over(w))
    head = F.concat(F.lit("--- Passage "), F.col("place"), F.lit("") if label is None else label, F.lit(" ---\n"))
    t = t.withColumn("part", F.concat(head, cut(F.col(text), part, " ...")))
    t = t.withColumn("total", F.sum(F.length("part")).over(w.rowsBetween(Window.unboundedPreceding, 0)))
    return t.where((F.col("place") == 1) | (F.col("total") <= budget))
