"""Question answering over a vector table: expansion, retrieval, floor, deduplication, diversity, context, answer."""

from __future__ import annotations

import json
import re
from dataclasses import dataclass

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from loomspan.config import MMR_K, SCORE_FLOOR, TOP_K
from loomspan.functions.filters import Equals
from loomspan.functions.text import INSUFFICIENT
from loomspan.models import Embedder, LanguageModel
from loomspan.operators.rank import context_budget, dedup_max_score, mmr, score_floor
from loomspan.operators.search import VectorTable


NOT_FOUND = "Nothing in the indexed documents answers this."
NOT_RELEVANT = "Documents were found, but none of them helps to answer this."


def expand(model: LanguageModel, question: str, n: int = 3) -> list[str]:
    """The question, up to n other wordings and a made-up answer; the question alone if the model fails."""
    try:
        reply = model.call([{"role": "user", "content": f"Reword as JSON with alternatives and passage: {question}"}])
        body = json.loads(re.search(r"\{.*\}", reply, re.S)[0])
        extra = [str(x) for x in body.get("alternatives", [])][:n] + [str(body["passage"])] * ("passage" in body)
    except Exception:  # a model may fail in any way; the question itself is always searched
        extra = []
    return [question, *(x for x in extra if x.strip())]


def retrieve(points: DataFrame, hits: DataFrame, floor: float = SCORE_FLOOR, k: int = MMR_K) -> DataFrame:
    """(query_id, id, pick): hits of several wordings (query_id, wording, id, distance), deduplicated and diversified."""
    good = dedup_max_score(score_floor(hits, floor), ["query_id", "id"], "wording")
    order = F.row_number().over(_by_score())
    near = good.withColumn("pos", order).join(points.select("id", "vector"), "id")
    return mmr(near.select("query_id", "id", "pos", "score", "vector"), k)


def _by_score():
    return Window.partitionBy("query_id").orderBy(F.desc(F.round("score", 9)), "wording", "id")


def relevant(model: LanguageModel, question: str, texts: list[str]) -> list[bool]:
    """What a model says of each text; a reply that is not a flag for each keeps all."""
    listed = "\n".join(f"[{i}] {t}" for i, t in enumerate(texts))
    try:
        reply = model.call([{"role": "user", "content": f"A JSON array of {len(texts)} booleans: which texts help to answer?\n{question}\n{listed}"}])
        flags = json.loads(re.sub(r"^```(?:json)?|```$", "", reply.strip()).strip())
    except Exception:  # a model may fail in any way; nothing is dropped then
        return [True] * len(texts)
    return [bool(f) for f in flags] if isinstance(flags, list) and len(flags) == len(texts) else [True] * len(texts)


def condensed(model: LanguageModel, question: str, text: str) -> str:
    """The sentences of a text that matter to the question, which may be none; the text itself if the model fails."""
    try:
        return model.call([{"role": "user", "content": f"Only the sentences that help to answer, or nothing.\n{question}\n{text}"}]).strip()
    except Exception:  # as above
        return text.strip()


def says_nothing(answer: str) -> bool:
    return answer.strip().strip("`*_ .").upper().startswith(INSUFFICIENT)


@dataclass
class Pipeline:
    """evaluator judges the passages before the answer; with condense, each is cut to what matters."""

    spark: SparkSession
    table: VectorTable
    chunks: DataFrame
    embedder: Embedder
    model: LanguageModel
    evaluator: LanguageModel | None = None
    condense: bool = False

    def _without(self, question: str, wordings: list[str], message: str, general: bool) -> dict:
        """The answer when no passage serves: from the model's own knowledge, marked so, or a message."""
        if general:
            answer = self.model.call([{"role": "user", "content": f"Answer from general knowledge, without citing documents: {question}"}])
            return {"answer": answer, "chunks": [], "queries": wordings, "answer_source": "general"}
        return {"answer": message, "chunks": [], "queries": wordings, "answer_source": "none"}

    def query(self, question: str, country: str | None = None, k: int = TOP_K, general_fallback: bool = False) -> dict:
        wordings = expand(self.model, question)
        vectors = self.embedder.encode(wordings)
        queries = self.spark.createDataFrame([(i, v.tolist()) for i, v in enumerate(vectors)], "query_id long, vector array<float>")
        hits = self.table.search(queries, k, [Equals("country", country)] if country else [])
        hits = hits.select(F.lit(0).cast("long").alias("query_id"), F.col("query_id").alias("wording"), "id", "distance")
        picked = retrieve(self.table.points, hits).join(self.chunks.select("id", "text"), "id").select("pick", "id", "text").orderBy("pick").collect()  # MMR_K rows
        if not picked:
            return self._without(question, wordings, NOT_FOUND, general_fallback)
        if self.evaluator is not None:
            flags = relevant(self.evaluator, question, [r.text for r in picked])
            picked = [r for r, keep in zip(picked, flags, strict=True) if keep]
            if not picked:
                return self._without(question, wordings, NOT_RELEVANT, general_fallback)
        parts = [(0, r.pick, r.id, condensed(self.model, question, r.text) if self.condense else r.text) for r in picked]
        parts = [p for p in parts if p[3]]
        context = context_budget(self.spark.createDataFrame(parts, "query_id long, pick long, id long, text string"), "query_id", "pick", "text").orderBy("place").collect()
        text = "\n\n".join(r.part for r in context)
        answer = self.model.call([{"role": "user", "content": f"{text}\n\n{question}\nReply {INSUFFICIENT} if the passages do not answer this."}])
        if says_nothing(answer):
            return self._without(question, wordings, NOT_FOUND, general_fallback)
        return {"answer": answer, "chunks": [p[2] for p in parts], "queries": wordings, "answer_source": "knowledge_base"}
