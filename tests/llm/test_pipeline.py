import hashlib

from pyspark.sql import functions as F

import corpus_pipeline as P
from loomspan.llm import toxicity
from tests.llm.cases import documents, text
from tests.llm.test_dedup import brute_components, brute_lines
from tests.llm.test_text_ops import words

ITEM = text(2, 200).split()[30:45]


def write(spark, folder):
    docs = [(i, t, "en", "s", len(t or "")) for i, t in documents()] + [(500 + k, text(900 + k, 30) + (" vile scum " if k % 3 == 0 else ""), "en", "s", 1) for k in range(60)]
    spark.createDataFrame(docs, "doc_id long, text string, lang string, source string, n_chars long").write.parquet(f"{folder}/documents.parquet")
    spark.createDataFrame([(500 + k, 1, int(k % 3 == 0)) for k in range(60)], "doc_id long, quality int, toxic int").write.parquet(f"{folder}/labels.parquet")
    spark.createDataFrame([(1, " ".join(ITEM))], "item_id long, text string").write.parquet(f"{folder}/benchmark.parquet")
    return {d[0]: d[1] for d in docs}


def test_pipeline_equals_brute_force(spark, tmp_path):
    folder = str(tmp_path)
    docs = write(spark, folder)
    df = spark.read.parquet(f"{folder}/documents.parquet")
    model = toxicity.train(df, spark.read.parquet(f"{folder}/labels.parquet"))
    bad = {r.doc_id for r in toxicity.score_toxicity(df, model).collect() if r.score >= P.TOXIC_FROM}
    assert {500 + k for k in range(0, 60, 3)} <= bad and len(bad) < 25
    docs = {i: t for i, t in docs.items() if i not in bad}
    docs = {i: t for i, (_, _, t) in brute_lines(list(docs.items())).items()}
    docs = {i: docs[i] for i, (_, c) in brute_components(list(docs.items())).items() if c == i}
    grams = {tuple(words(" ".join(ITEM))[k : k + 10]) for k in range(len(words(" ".join(ITEM))) - 9)}
    clean = lambda t: not any(tuple(words(t)[k : k + 10]) in grams for k in range(len(words(t))))
    docs = {i: t for i, t in docs.items() if clean(t)}
    got = P.run(spark, folder).collect()
    assert {r.doc_id: r.decoded_sha256 for r in got} == {i: hashlib.sha256(t.encode()).hexdigest() for i, t in docs.items()}
    assert [n for n, _ in P.STAGES] == ["toxicity", "line_dedup", "ngram_jaccard", "decontamination", "byte_bpe"]


def test_stages_keep_the_columns(spark, tmp_path):
    folder = str(tmp_path)
    write(spark, folder)
    names = ["n_lines", "N_HIT", "n_tokens", "__score", "Score", "__maybe", "maybe", "__bucket", "TEXT", "passed_3", "hit_items", "N_DROPPED"]
    docs = spark.read.parquet(f"{folder}/documents.parquet")
    width = len(docs.columns)
    docs = docs.select("*", *(F.lit(f"own {c}") for c in names)).toDF(*docs.columns, *names)
    for _, stage in P.STAGES[:-1]:
        out = stage(spark, docs, folder)
        assert out.columns == docs.columns
        assert {tuple(r)[width:] for r in out.collect()} == {tuple(f"own {c}" for c in names)}
        assert stage(spark, docs.limit(0), folder).collect() == []
    last = P.STAGES[-1][1](spark, docs, folder)
    assert last.count() == docs.count()


def test_repeated_and_null_ids_pass_all_stages(spark, tmp_path):
    folder = str(tmp_path)
    write(spark, folder)
    docs = spark.createDataFrame([(1, "a clean text", "en", "s", 12), (1, "another clean text", "en", "s", 18), (None, "no id", None, None, None), (None, None, None, None, None)], "doc_id long, text string, lang string, source string, n_chars long")
    for _, stage in P.STAGES:
        out = stage(spark, docs, folder)
        assert out.count() == 4
