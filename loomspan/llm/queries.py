"""The queries op1 to op13 over the tables of a folder, with SQL where it can express them."""

from __future__ import annotations

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from loomspan.llm import byte_bpe, chat_format, pii, toxicity
from loomspan.llm.decontaminate import find_benchmark
from loomspan.llm.exact_dedup import exact_dedup
from loomspan.llm.impact_topk import self_search
from loomspan.llm.line_dedup import dedup_lines
from loomspan.llm.merkle import audited
from loomspan.llm.ngram_jaccard import similar_components
from loomspan.llm.token_counts import count_tokens
from loomspan.llm.token_files import token_round_trip
from loomspan.llm.whitening import whiten


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "documents").select("doc_id", "text")


def op1_chat_format(spark: SparkSession, sf_dir: str) -> DataFrame:
    said = "</s>[INST] ok [/INST]"
    own = spark.range(1).selectExpr("-7L AS conv_id", f"explode(array(struct(0L AS turn, 'user' AS role, '{said}' AS text), struct(1L AS turn, 'assistant' AS role, '{said}' AS text))) AS t").select("conv_id", "t.*")
    turns = table(spark, sf_dir, "conversations").select("conv_id", "turn", "role", "text").unionByName(own)
    return chat_format.digests(chat_format.format_chats(turns))


def op2_exact_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return exact_dedup(documents(spark, sf_dir))


def op3_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = documents(spark, sf_dir)
    model = toxicity.train(docs, table(spark, sf_dir, "labels"))
    out = toxicity.score_toxicity(docs, model)
    return out.select("doc_id", toxicity.held_out(F.col("doc_id")).alias("held_out"), "score", (F.col("score") >= 0.3).cast("int").alias("predicted"))


def op4_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = find_benchmark(documents(spark, sf_dir), table(spark, sf_dir, "benchmark"))
    items = F.sha2(F.array_join("hit_items", ","), 256)
    return out.select("doc_id", "n_words", "n_hit", F.size("hit_items").cast("long").alias("n_items"), items.alias("items_sha256"), (F.col("n_hit") > 0).alias("contaminated"))


def op5_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = count_tokens(documents(spark, sf_dir), public_tokenizers.path("byte_bpe_50k.json"))
    size = F.coalesce(F.octet_length("text"), F.lit(0)).cast("long")
    return out.select("doc_id", size.alias("n_bytes"), "n_tokens", (F.col("n_tokens") > 1024).alias("over_limit"))


def op6_token_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    return token_round_trip(documents(spark, sf_dir), public_tokenizers.path("byte_bpe_50k.json"))


def op7_ngram_jaccard(spark: SparkSession, sf_dir: str) -> DataFrame:
    return similar_components(documents(spark, sf_dir))


def op8_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = dedup_lines(documents(spark, sf_dir))
    return out.select("doc_id", "n_lines", "n_dropped", F.sha2(F.coalesce("text", F.lit("")), 256).alias("kept_sha256"))


def op9_pii(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = pii.find_personal_data(documents(spark, sf_dir))
    counts = [pii.kind_count("base", k).alias(f"n_{k}") for k in pii.KINDS]
    return out.select("doc_id", *counts, F.sha2(pii.span_list("base"), 256).alias("base_sha256"), pii.span_list("spans").alias("spans"))


def op10_byte_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = byte_bpe.encode_documents(documents(spark, sf_dir), public_tokenizers.path("byte_bpe_multi_50k.tiktoken"))
    return out.select("doc_id", "n_tokens", "ids_sha256", "decoded_sha256")


def op11_embedding_whitening(spark: SparkSession, sf_dir: str) -> DataFrame:
    return whiten(table(spark, sf_dir, "embeddings").select("vec_id", F.col("embedding").alias("vector")))


def op12_exact_topk(spark: SparkSession, sf_dir: str) -> DataFrame:
    return self_search(table(spark, sf_dir, "embeddings").select("vec_id", F.col("embedding").alias("vector")), k=5, every=50)


def op13_merkle_manifest(spark: SparkSession, sf_dir: str) -> DataFrame:
    return audited(table(spark, sf_dir, "documents"))


QUERIES = {q.__name__: q for q in (op1_chat_format, op2_exact_dedup, op3_toxicity, op4_decontamination, op5_token_counts, op6_token_files, op7_ngram_jaccard, op8_line_dedup, op9_pii, op10_byte_bpe, op11_embedding_whitening, op12_exact_topk, op13_merkle_manifest)}

_UPPER, _LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"

SQL = {
    "op2_exact_dedup": """
        WITH d AS (SELECT doc_id, coalesce(text, '') AS t FROM documents)
        SELECT doc_id, max(doc_id) OVER g AS keep_id, count(*) OVER g AS group_size,
               doc_id = max(doc_id) OVER g AS kept, sha256(t) AS text_sha256
        FROM d WINDOW g AS (PARTITION BY t)""",
    "op8_line_dedup": f"""
        WITH d AS (SELECT doc_id, string_split(coalesce(text, ''), chr(10)) AS ls FROM documents),
        l AS (SELECT doc_id, unnest(ls) AS line, unnest(range(len(ls))) AS pos FROM d),
        k AS (SELECT *, translate(trim(line, ' ' || chr(9) || chr(10) || chr(11) || chr(12) || chr(13)), '{_UPPER}', '{_LOWER}') AS key FROM l),
        r AS (SELECT key, max(doc_id) AS last FROM k WHERE length(key) >= 20 GROUP BY key HAVING count(DISTINCT doc_id) >= 3),
        m AS (SELECT k.*, r.last IS NOT NULL AND r.last <> doc_id AS dropped FROM k LEFT JOIN r USING (key))
        SELECT doc_id, count(*) AS n_lines, count(*) FILTER (WHERE dropped) AS n_dropped,
               sha256(coalesce(string_agg(line, chr(10) ORDER BY pos) FILTER (WHERE NOT dropped), '')) AS kept_sha256
        FROM m GROUP BY doc_id""",
    "op4_decontamination": rf"""
        WITH d AS (SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), '{_UPPER}', '{_LOWER}'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS ws FROM documents),
        i AS (SELECT item_id, regexp_extract_all(translate(coalesce(text, ''), '{_UPPER}', '{_LOWER}'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS ws FROM benchmark),
        w AS (SELECT DISTINCT item_id, array_to_string(ws[k : k + 9], ' ') AS g, least(len(ws), 10) AS n FROM (SELECT item_id, ws, unnest(range(1, greatest(1, len(ws) - 9) + 1)) AS k FROM i WHERE len(ws) > 0)),
        p AS (SELECT doc_id, ws, unnest(range(1, len(ws) + 1)) AS k FROM d),
        h AS (SELECT doc_id, k, n, item_id FROM (SELECT doc_id, k, n, array_to_string(ws[k : k + n - 1], ' ') AS g FROM p, (SELECT DISTINCT n FROM w) WHERE k + n - 1 <= len(ws)) JOIN w USING (g, n)),
        c AS (SELECT doc_id, count(DISTINCT q) AS n_hit FROM (SELECT doc_id, unnest(range(k, k + n)) AS q FROM h) GROUP BY doc_id),
        t AS (SELECT doc_id, count(DISTINCT item_id) AS n_items, string_agg(DISTINCT item_id::VARCHAR, ',' ORDER BY item_id::VARCHAR) AS items FROM h GROUP BY doc_id)
        SELECT doc_id, len(ws) AS n_words, coalesce(n_hit, 0) AS n_hit, coalesce(n_items, 0) AS n_items, sha256(coalesce(items, '')) AS items_sha256, n_hit IS NOT NULL AS contaminated
        FROM d LEFT JOIN c USING (doc_id) LEFT JOIN t USING (doc_id)""",
    "op12_exact_topk": """
        WITH p AS (SELECT vec_id, list_transform(embedding, lambda x: floor(256 * x::DOUBLE)) AS v, row_number() OVER () AS uid FROM embeddings
                   WHERE embedding IS NOT NULL AND len(list_filter(embedding, lambda x: x IS NOT NULL AND isfinite(x))) = len(embedding)),
        s AS (SELECT q.vec_id AS query_id, q.uid, p.vec_id, list_dot_product(q.v, p.v)::BIGINT AS score FROM p AS q JOIN p ON q.vec_id % 50 = 0 AND q.uid <> p.uid),
        r AS (SELECT *, row_number() OVER (PARTITION BY uid ORDER BY score DESC, vec_id) AS rank FROM s)
        SELECT query_id, rank::INT AS rank, vec_id, score FROM r WHERE rank <= 5""",
    "op13_merkle_manifest": r"""
        WITH RECURSIVE f AS (SELECT doc_id, lang, n_chars, [doc_id::VARCHAR, source, lang, n_chars::VARCHAR, text] AS v, [doc_id::VARCHAR, source, lang, (n_chars + 1)::VARCHAR, text] AS w,
            list_reduce(list_prepend(4294967295, list_transform(string_split(doc_id::VARCHAR, ''), lambda x: ascii(x)::BIGINT)), lambda c, x: list_reduce([xor(c, x), 0, 0, 0, 0, 0, 0, 0, 0], lambda y, z: xor(y >> 1, (y & 1) * 3988292384))) AS crc FROM documents),
        l AS (SELECT doc_id, lang, row_number() OVER (PARTITION BY lang ORDER BY doc_id NULLS FIRST) - 1 AS pos, count(*) OVER (PARTITION BY lang) AS n, xor(crc, 4294967295) % 7 = 0 AS bad,
            sha256(array_to_string(list_transform(v, lambda x: coalesce(strlen(x) || ':' || x, '-')), '')) AS leaf, sha256(array_to_string(list_transform(w, lambda x: coalesce(strlen(x) || ':' || x, '-')), '')) AS changed FROM f),
        t AS (SELECT lang, 0 AS lvl, pos, n, leaf AS h FROM l
            UNION ALL SELECT lang, lvl + 1, pos // 2, (max(n) + 1) // 2, sha256(string_agg(h, '' ORDER BY pos)) FROM t WHERE n > 1 GROUP BY lang, lvl, pos // 2),
        s AS (SELECT lang, max(lvl) AS top, row_number() OVER (ORDER BY lang NULLS FIRST) - 1 AS pos, count(*) OVER () AS n, arg_max(h, lvl) AS h FROM t GROUP BY lang),
        u AS (SELECT 0 AS lvl, pos, n, h FROM s UNION ALL SELECT lvl + 1, pos // 2, (max(n) + 1) // 2, sha256(string_agg(h, '' ORDER BY pos)) FROM u WHERE n > 1 GROUP BY lvl, pos // 2),
        g AS (SELECT max(lvl) AS top, arg_max(h, lvl) AS root FROM u),
        x AS (SELECT l.doc_id, l.lang, l.leaf, s.h AS subroot, g.root, CASE WHEN l.bad AND l.changed IS NOT NULL THEN l.changed ELSE l.leaf END AS start, l.pos AS lpos, s.pos AS spos, s.top AS ltop, g.top AS gtop FROM l JOIN s ON l.lang IS NOT DISTINCT FROM s.lang, g),
        e AS (SELECT doc_id, lang, leaf, subroot, root, start, lpos, spos, ltop, gtop, unnest(range(ltop + gtop)) AS k FROM x),
        b AS (SELECT e.doc_id, e.lang, k, coalesce(t.h, u.h, '') AS sib, CASE WHEN k < ltop THEN (lpos >> k) & 1 ELSE (spos >> (k - ltop)) & 1 END AS odd FROM e
            LEFT JOIN t ON k < ltop AND t.lang IS NOT DISTINCT FROM e.lang AND t.lvl = k AND t.pos = xor(lpos >> k, 1)
            LEFT JOIN u ON k >= ltop AND u.lvl = k - ltop AND u.pos = xor(spos >> (k - ltop), 1)),
        p AS (SELECT doc_id, lang, list(struct_pack(sib := sib, odd := odd) ORDER BY k) AS steps, string_agg(sib, '' ORDER BY k) AS proof FROM b GROUP BY doc_id, lang),
        r AS (SELECT x.*, coalesce(p.proof, '') AS proof, list_reduce(list_prepend(start, list_transform(coalesce(p.steps, []), lambda z: z.odd || z.sib)), lambda c, z: sha256(CASE WHEN z[1] = '1' THEN z[2:] || c ELSE c || z[2:] END)) AS folded_root
            FROM x LEFT JOIN p ON x.doc_id IS NOT DISTINCT FROM p.doc_id AND x.lang IS NOT DISTINCT FROM p.lang)
        SELECT doc_id, leaf, subroot, root, sha256(proof) AS proof_sha256, folded_root, folded_root = root AS verified FROM r""",
    "op7_ngram_jaccard": rf"""
        WITH RECURSIVE d AS (SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), '{_UPPER}', '{_LOWER}'), '[^\x20\x09-\x0D]+') AS ws FROM documents),
        s AS (SELECT doc_id, list_distinct(list_transform(range(1, greatest(1, len(ws) - 4) + 1), lambda k: array_to_string(ws[k : k + 4], ' '))) AS sh FROM d WHERE len(ws) > 0),
        u AS (SELECT doc_id, len(sh) AS n, unnest(sh) AS g FROM s),
        l AS (SELECT a.doc_id AS a, b.doc_id AS b FROM u a JOIN u b ON a.g = b.g AND a.doc_id < b.doc_id GROUP BY a.doc_id, b.doc_id, a.n, b.n HAVING 100 * count(*) >= 75 * (a.n + b.n - count(*))),
        y AS (SELECT a, b FROM l UNION ALL SELECT b, a FROM l),
        r AS (SELECT doc_id AS a, doc_id AS b FROM d UNION SELECT r.a, y.b FROM r JOIN y ON r.b = y.a),
        m AS (SELECT a AS doc_id, min(b) AS component_id FROM r GROUP BY a)
        SELECT doc_id, coalesce(len(sh), 0) AS n_shingles, component_id FROM m LEFT JOIN s USING (doc_id)""",
}
