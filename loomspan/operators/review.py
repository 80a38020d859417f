"""Review of documents against passages: validation, deduplication, order and report of findings."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from loomspan.config import BATCH_CHARS, MAX_BATCHES, SUMMARY_CHARS
from loomspan.functions.text import json_body, locate, severity, squeeze, strip
from loomspan.models import LanguageModel
from loomspan.operators.rank import first_of
from loomspan.operators.segment import batches, fresh, leading_text
from loomspan.sources.snapshot import scratch

_ORDER = {"high": 0, "medium": 1, "low": 2}


def stored(rows: DataFrame) -> DataFrame:
    path = scratch(rows.sparkSession)
    rows.write.parquet(path)
    return rows.sparkSession.read.schema(rows.schema).parquet(path)


def law_ordinal(mark: Column) -> Column:
    """The number of a mark L7 or [L7], whatever its case; NULL for anything else."""
    n = F.regexp_extract(F.trim(mark), r"(?i)^\[?L([0-9]{1,9})\]?$", 1)
    return F.when(n != "", n.cast("int"))


def validate(raw: DataFrame, sections: DataFrame, passages: DataFrame, quote_most: int = 400) -> DataFrame:
    """Findings whose passage exists, each with its quote's place.

    raw(finding, doc_id, section, quote, law, severity), sections(doc_id, section, pos, text),
    passages(ordinal, passage_id), of all documents or with a doc_id of their own. A quote is looked for in the section that is named (brackets around
    the name do not count) and, if that lacks it, in all sections of the document, in order (moved).
    Without a place a finding stays, unverified, in the section that it names, and goes if there is none.
    """
    r = raw.withColumn("ordinal", law_ordinal(F.col("law"))).join(passages, ["doc_id", "ordinal"] if "doc_id" in passages.columns else "ordinal")
    r = r.withColumn("quote", F.substring("quote", 1, quote_most)).withColumn("named", F.regexp_replace("section", r"^[\[\] ]+|[\[\] ]+$", "")).drop("section")
    bare = fresh("squeezed", sections)
    sections = sections.withColumn(bare, squeeze(F.col("text")))
    start, end = locate(F.col("text"), F.col("quote"), F.col(bare))
    home = sections.withColumnRenamed("section", "named")
    own = r.join(home, ["doc_id", "named"], "left").withColumn("start", start).withColumn("end", end)
    lost = own.where("start is null").select(*r.columns, F.col("pos").alias("home"))
    # A quote that several findings of a document share is looked for once.
    asked = lost.select("doc_id", "quote").distinct()
    places = asked.join(sections, "doc_id").withColumn("start", start).withColumn("end", end).where("start is not null")
    places = first_of(places, ["doc_id", "quote"], [F.col("pos")]).select("doc_id", "quote", "section", "pos", "text", "start", "end")
    hits = lost.drop("home").join(places, ["doc_id", "quote"])
    out = ["finding", "doc_id", "section", "pos", "passage_id", "start", "end", "verified", "moved", "severity"]

    def shown(rows: DataFrame, section: str, verified: bool, moved: bool) -> DataFrame:
        rows = rows.withColumn("section", F.col(section)).withColumn("verified", F.lit(verified)).withColumn("moved", F.lit(moved))
        return rows.withColumn("severity", severity(F.col("severity"))).select(*out)

    nowhere = lost.where("home is not null").join(hits.select("finding"), "finding", "left_anti").withColumn("pos", F.col("home"))
    nowhere = nowhere.withColumn("start", F.lit(None).cast("int")).withColumn("end", F.lit(None).cast("int"))
    return shown(own.where("start is not null"), "named", True, False).unionByName(shown(hits, "section", True, True)).unionByName(shown(nowhere, "named", False, False))


def dedup(findings: DataFrame) -> DataFrame:
    """The first finding of each (doc, section, passage, start); unknown starts are equal."""
    return first_of(findings, ["doc_id", "section", "passage_id", "start"], [F.col("finding")])


def rank(findings: DataFrame) -> DataFrame:
    """Numbered F1, F2, ... per document, by severity and then section."""
    order = F.element_at(F.create_map(*(F.lit(x) for kv in _ORDER.items() for x in kv)), F.col("severity"))
    w = Window.partitionBy("doc_id").orderBy(order, "pos", "finding")
    return findings.withColumn("name", F.concat(F.lit("F"), F.row_number().over(w)))


def severity_counts(findings: DataFrame, key: str) -> DataFrame:
    return findings.groupBy(key).agg(*(F.count_if(F.col("severity") == s).alias(s) for s in _ORDER))


def report(findings: DataFrame, key: str, line: Column, order: str, title: Column) -> DataFrame:
    """(key, report): a Markdown text with one line per finding."""
    lines = F.transform(F.array_sort(F.collect_list(F.struct(F.col(order).alias("o"), line.alias("t")))), lambda x: x["t"])
    return findings.groupBy(key).agg(F.concat(title, F.lit("\n\n"), F.array_join(lines, "\n")).alias("report"))


#: What a model is asked to give, as JSON.
REPLY = "findings array<struct<section:string,quote:string,law:string,severity:string,title:string,explanation:string,remediation:string>>, summary string"
UNREADABLE = "The reply was not in the expected format."


def batched(sections: DataFrame, most: int = BATCH_CHARS, number: int = MAX_BATCHES) -> DataFrame:
    """sections(doc_id, section, pos, text) with the batch, from 1, that each goes to, filled greedily; those beyond ``number`` batches have a greater one."""
    items = F.array_sort(F.collect_list(F.struct("pos", F.length("text").cast("long").alias("n"))))
    lists = sections.groupBy("doc_id").agg(items.alias("items"))
    numbered = lists.select("doc_id", F.explode(F.arrays_zip(F.col("items")["pos"].alias("pos"), batches(F.transform("items", lambda x: x["n"]), most).alias("batch"))).alias("b"))
    return sections.join(numbered.select("doc_id", "b.pos", "b.batch"), ["doc_id", "pos"])


def run_review(sections: DataFrame, choose: Callable[[DataFrame], DataFrame], model: Callable[[], LanguageModel], most: int = BATCH_CHARS, number: int = MAX_BATCHES) -> tuple[DataFrame, DataFrame]:
    """A review of all documents: batches, one question to a model for each, and validated, distinct and ranked findings.

    sections(doc_id, section, pos, text); ``choose`` gives passages(doc_id, batch, ordinal, passage_id, text) for batched sections;
    the model is made once a task. Returns findings (doc_id, name, section, pos, passage_id, start, end, verified, moved, severity, title,
    explanation, remediation) and documents (doc_id, summary, analysed, total, truncated, problem); the problem is that of a reply which is no JSON object.
    """
    every = batched(sections, most, number)
    used = stored(every.where(F.col("batch") <= number))
    passages = stored(choose(used).select("doc_id", "batch", "ordinal", "passage_id", "text"))

    def listed(rows: DataFrame, order: str, mark: Column) -> DataFrame:
        parts = F.transform(F.array_sort(F.collect_list(F.struct(F.col(order).alias("o"), F.concat(mark, F.lit(" "), "text").alias("t")))), lambda p: p["t"])
        return rows.groupBy("doc_id", "batch").agg(F.array_join(parts, "\n").alias(order))

    asked = listed(used, "pos", F.concat(F.lit("["), "section", F.lit("]"))).join(listed(passages, "ordinal", F.concat(F.lit("[L"), "ordinal", F.lit("]"))), ["doc_id", "batch"], "left")
    prompt = F.concat(F.lit("Compare the sections with the laws and reply in JSON with findings (section, quote, law, severity, title, explanation, remediation) and a summary.\n\n"), F.coalesce("ordinal", F.lit("")), F.lit("\n\n"), "pos")

    @F.pandas_udf(T.StringType())
    def ask(prompts: Iterator[pd.Series]) -> Iterator[pd.Series]:
        one = model()
        for p in prompts:
            yield pd.Series([one.call([{"role": "user", "content": x}]) for x in p], index=p.index)

    # Stored, as a model may answer otherwise when it is asked again.
    replies = stored(asked.select("doc_id", "batch", ask(prompt).alias("reply"))).withColumn("data", F.from_json(json_body(F.col("reply")), REPLY))
    raw = replies.select("doc_id", "batch", F.posexplode("data.findings").alias("k", "f")).where("f is not null")
    # Quotes are looked for in the sections of their batch, and marks are its passages.
    part = F.struct("doc_id", "batch")
    raw = raw.select(F.struct("doc_id", "batch", "k").alias("finding"), part.alias("doc_id"), "f.*")
    for_batch = lambda rows, *names: rows.select(part.alias("doc_id"), *names)
    kept_rows = validate(raw.select("finding", "doc_id", "section", "quote", "law", "severity"), for_batch(used, "section", "pos", "text"), for_batch(passages, "ordinal", "passage_id"))
    found = rank(dedup(kept_rows.withColumn("doc_id", F.col("doc_id.doc_id"))))
    found = found.join(raw.select("finding", "title", "explanation", "remediation"), "finding")
    found = found.select("doc_id", "name", "section", "pos", "passage_id", "start", "end", "verified", "moved", "severity", "title", "explanation", "remediation")
    summaries = leading_text(replies.select("doc_id", "batch", strip(F.col("data.summary")).alias("summary")).where("summary <> ''"), "doc_id", "batch", "summary", SUMMARY_CHARS)
    bad = replies.where("data is null").select("doc_id").distinct().withColumn("problem", F.lit(UNREADABLE))
    counts = every.groupBy("doc_id").agg(F.count_if(F.col("batch") <= number).alias("analysed"), F.count("*").alias("total"))
    documents = counts.withColumn("truncated", F.col("analysed") < F.col("total")).join(summaries, "doc_id", "left").join(bad, "doc_id", "left")
    return found, documents.select("doc_id", F.coalesce("summary", F.lit("")).alias("summary"), "analysed", "total", "truncated", "problem")
