import json

from pyspark.sql import functions as F

from loomspan.operators.review import UNREADABLE, run_review


class Reviewer:
    """Finds the word rig in the first section of what it is shown, and answers document 3 with talk."""

    def call(self, messages):
        text = messages[0]["content"].rpartition("\n\n")[2]
        if "nonsense" in text:
            return "I cannot say."
        first = text.split("]")[0].lstrip("[")
        finding = {"section": f"[{first}]", "quote": "THE rig...", "law": "[L1]", "severity": "Severe", "title": "t", "explanation": "e", "remediation": "r"}
        other = finding | {"law": "L9"}
        lost = finding | {"quote": "no such words", "severity": "minor", "law": "l2"}
        return "Sure:\n```json\n" + json.dumps({"findings": [finding, finding, other, lost], "summary": f" about {first} "}) + "\n```"


def test_run_over_many_documents(spark):
    rows = [(d, f"S{k}", k, f"section {k} says the, rig stands here " + "x" * 30) for d in (1, 2) for k in range(1, 8)] + [(3, "S1", 1, "nonsense")]
    sections = spark.createDataFrame(rows, "doc_id long, section string, pos int, text string")

    def choose(batched):
        own = batched.select("doc_id", "batch").distinct()
        return own.select("doc_id", "batch", F.explode(F.array(*(F.struct(F.lit(n).alias("ordinal"), (F.lit(100 * n) + F.col("batch")).alias("passage_id"), F.lit("law").alias("text")) for n in (1, 2)))).alias("p")).select("doc_id", "batch", "p.*")

    found, documents = run_review(sections, choose, Reviewer, most=140, number=3)
    docs = {r.doc_id: r for r in documents.collect()}
    assert [(docs[d].analysed, docs[d].total, docs[d].truncated) for d in (1, 2, 3)] == [(6, 7, True), (6, 7, True), (1, 1, False)]
    assert docs[1].summary == "about S1 about S3 about S5" and docs[1].problem is None
    assert docs[3].problem == UNREADABLE and docs[3].summary == ""
    got = [(r.doc_id, r.name, r.section, r.passage_id, r.verified, r.severity, r.title) for r in found.orderBy("doc_id", F.length("name"), "name").collect()]
    one = [("F1", "S1", 101, True, "high"), ("F2", "S3", 102, True, "high"), ("F3", "S5", 103, True, "high"), ("F4", "S1", 201, False, "low"), ("F5", "S3", 202, False, "low"), ("F6", "S5", 203, False, "low")]
    assert got == [(d, *x, "t") for d in (1, 2) for x in one]
    assert {r.start for r in found.where("verified").collect()} == {"section 1 says the".index("the")}
