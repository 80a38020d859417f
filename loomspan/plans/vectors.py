"""Queries over vectors: arithmetic, search, filters, graphs, ranking."""

from __future__ import annotations

from pyspark.sql import functions as F

from loomspan.config import EMBED_DIM
from loomspan.functions import vectors as V
from loomspan.functions.filters import AtLeast, AtMost, Between, Equals
from loomspan.operators import graph as G
from loomspan.operators import rank as R
from loomspan.operators import search as S
from loomspan.operators.catalog import count_by
from loomspan.operators.cells import CellIndex
from loomspan.operators.neighbours import descended_graph
from loomspan.pipeline import retrieve
from loomspan.plans._base import point_queries, points, query, table
from loomspan.sources.records import Records
from loomspan.sources.snapshot import scratch

DIM = 64
_SCORED = """
    q AS (SELECT vec_id AS query_id, embedding::DOUBLE[] AS e FROM embeddings WHERE vec_id % 50 = 0),
    p AS (SELECT vec_id AS id, embedding::DOUBLE[] AS e, label FROM embeddings),
    s AS (SELECT query_id, id, label, 1 - list_cosine_similarity(q.e, p.e) AS distance FROM q, p)"""


def _topk_sql(where: str = "true", k: int = 10) -> str:
    return f"""WITH {_SCORED},
    r AS (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY distance, id) AS rank FROM s WHERE {where})
    SELECT query_id, id, rank::INT AS rank, round(distance, 6) + 0.0 AS distance FROM r WHERE rank <= {k}"""


def _shown(hits):
    return hits.select("query_id", "id", "rank", (F.round("distance", 6) + 0.0).alias("distance"))


def _search(spark, d, *conditions):
    return _shown(S.exact_topk(points(spark, d), point_queries(spark, d), 10, conditions))


@query(_topk_sql())
def knn_topk(spark, d):
    return _search(spark, d)


@query(_topk_sql("label = 3"))
def knn_filter_equals(spark, d):
    return _search(spark, d, Equals("label", 3))


@query(_topk_sql("label >= 5"))
def knn_filter_gte(spark, d):
    return _search(spark, d, AtLeast("label", 5))


@query(_topk_sql("label <= 2"))
def knn_filter_lte(spark, d):
    return _search(spark, d, AtMost("label", 2))


@query(_topk_sql("label BETWEEN 2 AND 6"))
def knn_filter_range(spark, d):
    return _search(spark, d, Between("label", 2, 6))


@query(_topk_sql("label >= 2 AND label <= 8 AND label = 4"))
def knn_filter_and(spark, d):
    return _search(spark, d, AtLeast("label", 2), AtMost("label", 8), Equals("label", 4))


def _celled(spark, d, conditions=(), inserts=False):
    """Search by bounds over stored cells; inserts: most points come in three later inserts, each part with its own cells."""
    p = points(spark, d)
    if inserts:
        index = CellIndex.build(p.where("id % 4 = 0"), 32)
        for n in (1, 2, 3):
            index.add(p.where(F.col("id") % 4 == n))
    else:
        index = CellIndex.build(p, 32)
    return _shown(index.search(point_queries(spark, d), 10, conditions))


@query(_topk_sql())
def knn_bounds(spark, d):
    return _celled(spark, d)


@query(_topk_sql("label BETWEEN 3 AND 4"))
def knn_bounds_filter(spark, d):
    return _celled(spark, d, [Between("label", 3, 4)])


@query(_topk_sql())
def knn_after_inserts(spark, d):
    return _celled(spark, d, inserts=True)


def _against_first(spark, d, value):
    """Each point against the mean vector of all points, which is one vector and becomes a literal."""
    p = points(spark, d)
    mean = p.select(F.posexplode("vector").alias("i", "x")).groupBy("i").agg(F.round(F.avg(F.col("x").cast("double")), 3).alias("x"))
    one = F.array(*(F.lit(r.x) for r in mean.orderBy("i").collect()))
    return p.select("id", (F.round(value(F.col("vector"), one), 6) + 0.0).alias("value"))


def _against_sql(value: str) -> str:
    return f"""WITH p AS (SELECT vec_id AS id, embedding::DOUBLE[] AS e FROM embeddings),
    x AS (SELECT unnest(range(1, 65)) AS i, unnest(e) AS x FROM p),
    m AS (SELECT list(v ORDER BY i) AS m FROM (SELECT i, round(avg(x), 3) AS v FROM x GROUP BY i))
    SELECT id, round({value}, 6) + 0.0 AS value FROM p, m"""


@query(_against_sql("list_dot_product(e, m)"))
def vec_dot(spark, d):
    return _against_first(spark, d, V.dot)


@query(_against_sql("1 - list_dot_product(e, m) / sqrt(list_dot_product(m, m)) / sqrt(list_dot_product(e, e))"))
def vec_cosine(spark, d):
    return _against_first(spark, d, lambda a, b: V.cosine_distance(V.normalize(a), V.normalize(b)))


@query(_against_sql("list_dot_product(e, e) - 2 * list_dot_product(e, m) + list_dot_product(m, m)"))
def vec_l2sq(spark, d):
    return _against_first(spark, d, V.l2_squared)


@query("""SELECT vec_id AS id, label, round(embedding[1]::DOUBLE / sqrt(list_dot_product(embedding::DOUBLE[], embedding::DOUBLE[])), 6) + 0.0 AS first,
    round(embedding[64]::DOUBLE / sqrt(list_dot_product(embedding::DOUBLE[], embedding::DOUBLE[])), 6) + 0.0 AS last FROM embeddings""")
def normalize_vectors(spark, d):
    rows = V.valid_vectors(points(spark, d), "vector", DIM, strict=False)
    item = lambda i: F.round(F.element_at("vector", i), 6) + 0.0
    return rows.select("id", "label", item(1).alias("first"), item(DIM).alias("last"))


@query("""WITH v AS (SELECT vec_id AS id, CASE WHEN label = 0 THEN embedding[1:32] WHEN label = 1 THEN list_transform(embedding, lambda x: 0::FLOAT) ELSE embedding END AS e FROM embeddings)
    SELECT id, CASE WHEN len(e) <> 64 THEN 'DimensionMismatch' WHEN sqrt(list_dot_product(e::DOUBLE[], e::DOUBLE[])) < 1.1920929e-07 THEN 'ZeroVector' ELSE 'ok' END AS problem FROM v""")
def vector_validate(spark, d):
    v = F.when(F.col("label") == 0, F.slice("vector", 1, 32)).when(F.col("label") == 1, F.transform("vector", lambda x: F.lit(0).cast("float"))).otherwise(F.col("vector"))
    return points(spark, d).select("id", F.coalesce(V.vector_problem(v, DIM), F.lit("ok")).alias("problem"))


@query(f"""WITH {_SCORED}, r AS (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY distance, id) AS rank FROM s)
    SELECT query_id, id, round(1 - distance, 6) AS score FROM r WHERE rank <= 20 AND 1 - distance >= 0.25""")
def score_floor(spark, d):
    hits = S.exact_topk(points(spark, d), point_queries(spark, d), 20)
    return R.score_floor(hits).select("query_id", "id", F.round("score", 6).alias("score"))


@query("SELECT count(*) AS n, max(len(embedding)) AS dim FROM embeddings")
def collection_info(spark, d):
    return points(spark, d).agg(F.count("*").alias("n"), F.max(F.size("vector")).alias("dim"))


@query("SELECT label AS id, max(vec_id) AS seq, round(arg_max(embedding[1], vec_id)::DOUBLE, 6) AS first FROM embeddings GROUP BY label")
def vector_lookup(spark, d):
    """The label taken as an id that repeats: a look-up sees the latest vector."""
    latest = points(spark, d).groupBy("label").agg(F.max("id").alias("seq"), F.max_by("vector", "id").alias("vector"))
    return latest.select(F.col("label").alias("id"), "seq", F.round(F.element_at("vector", 1).cast("double"), 6).alias("first"))


_GRAPH = """WITH p AS (SELECT vec_id AS id, embedding::DOUBLE[] AS e FROM embeddings),
    s AS (SELECT a.id AS src, b.id AS dst, 1 - list_cosine_similarity(a.e, b.e) AS distance FROM p a, p b WHERE a.id <> b.id),
    g AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY src ORDER BY distance, dst) AS rank FROM s) WHERE rank <= 4)"""


@query(f"{_GRAPH} SELECT src, dst, rank::INT AS rank, round(distance, 6) AS distance FROM g")
def knn_graph(spark, d):
    return S.neighbour_graph(points(spark, d), 4).select("src", "dst", "rank", F.round("distance", 6).alias("distance"))


@query(f"""{_GRAPH}, b AS (SELECT src, dst, min(distance) AS distance FROM (SELECT src, dst, distance FROM g UNION ALL SELECT dst, src, distance FROM g) GROUP BY src, dst)
    SELECT src, dst, rank::INT AS rank, round(distance, 6) AS distance FROM (SELECT *, row_number() OVER (PARTITION BY src ORDER BY distance, dst) AS rank FROM b) WHERE rank <= 6""")
def knn_graph_pruned(spark, d):
    return S.prune_graph(S.neighbour_graph(points(spark, d), 4), 6).select("src", "dst", "rank", F.round("distance", 6).alias("distance"))


@query("SELECT 4 * count(*) AS n_exact, true AS reached FROM embeddings")
def knn_graph_descent(spark, d):
    """Whether the graph by neighbours of neighbours has nine in ten of the exact graph's links."""
    p = points(spark, d)
    sides = [g.select(F.col("src").alias("query_id"), F.col("dst").alias("id")) for g in (descended_graph(p, 4), S.neighbour_graph(p, 4))]
    return S.recall(*sides).select("n_exact", (F.col("recall") >= 0.9).alias("reached"))


@query()
def hnsw_layer_hist(spark, d):
    """How many points each layer of a navigable graph gets, by a generator in insertion order."""
    return G.layer_counts(spark, points(spark, d).count())


@query()
def ann_graph_topk(spark, d):
    """The nearest by walks of navigable graphs; what they find depends on the shards, so recall is tested instead."""
    return _shown(G.graph_topk(G.build_graphs(points(spark, d)), point_queries(spark, d), 10))


@query("SELECT 10 * count(*) AS n_exact, true AS reached FROM embeddings WHERE vec_id % 50 = 0")
def ann_graph_recall(spark, d):
    """Whether walks of the graphs find nine in ten of the ten nearest."""
    p, q = points(spark, d), point_queries(spark, d)
    found = G.GraphIndex(spark, G.GraphConfig(ef_construction=100)).add(p).search(q, 10)
    return S.recall(found, S.exact_topk(p, q, 10)).select("n_exact", (F.col("recall") >= 0.9).alias("reached"))


_CELLS = """WITH p AS (SELECT vec_id AS id, embedding::DOUBLE[] AS e, label FROM embeddings),
    x AS (SELECT label, unnest(range(1, 65)) AS i, unnest(e) AS x FROM p),
    c AS (SELECT label AS cell, list(v ORDER BY i) AS c FROM (SELECT label, i, avg(x) AS v FROM x GROUP BY label, i) GROUP BY label),
    a AS (SELECT id, e, cell FROM (SELECT id, e, cell, row_number() OVER (PARTITION BY id ORDER BY list_cosine_similarity(e, c) DESC, cell) AS n FROM p, c) WHERE n = 1),
    q AS (SELECT id AS query_id, e FROM p WHERE id % 50 = 0),
    w AS (SELECT query_id, e, cell FROM (SELECT query_id, e, cell, row_number() OVER (PARTITION BY query_id ORDER BY list_cosine_similarity(e, c) DESC, cell) AS n FROM q, c) WHERE n <= 8),
    f AS (SELECT query_id, id, rank, distance FROM (SELECT query_id, id, 1 - list_cosine_similarity(w.e, a.e) AS distance, row_number() OVER (PARTITION BY query_id ORDER BY 1 - list_cosine_similarity(w.e, a.e), id) AS rank FROM w JOIN a USING (cell)) WHERE rank <= 10)"""


def _ivf(spark, d, nprobe=8):
    p = points(spark, d)
    cells = S.centroids(p.withColumn("label", F.col("label").cast("long")), "label")
    return S.ivf_topk(S.store_cells(S.assign_cells(p, cells)), cells, point_queries(spark, d), 10, nprobe)


@query(f"{_CELLS} SELECT query_id, id, rank::INT AS rank, round(distance, 6) + 0.0 AS distance FROM f")
def ann_ivf_topk(spark, d):
    return _shown(_ivf(spark, d))


@query(f"""{_CELLS}, t AS (SELECT query_id, id FROM (SELECT query_id, p.id, row_number() OVER (PARTITION BY query_id ORDER BY 1 - list_cosine_similarity(q.e, p.e), p.id) AS n FROM q, p) WHERE n <= 10)
    SELECT count(f.id) AS n_hit, count(*) AS n_exact, round(count(f.id) / count(*), 6) AS recall FROM t LEFT JOIN f USING (query_id, id)""")
def ann_recall(spark, d):
    exact = S.exact_topk(points(spark, d), point_queries(spark, d), 10)
    return S.recall(_ivf(spark, d), exact).withColumn("recall", F.round("recall", 6))


@query("""SELECT event_type, round(avg(value), 6) AS mean, list(value ORDER BY value)[floor(0.95 * count(*))::INT + 1] AS p95 FROM events GROUP BY event_type""")
def latency_p95(spark, d):
    """Mean and the value at place floor(0.95 n) of the sorted values: a rank, not an interpolation, without gathering a group."""
    from pyspark.sql import Window

    e = table(spark, d, "events")
    whole = e.groupBy("event_type").agg(F.round(F.avg("value"), 6).alias("mean"), F.count("*").alias("n"))
    levels = e.groupBy("event_type", "value").agg(F.count("*").alias("c"))
    upto = F.sum("c").over(Window.partitionBy("event_type").orderBy("value"))
    levels = levels.withColumn("upto", upto).join(whole.select("event_type", "n"), "event_type")
    p95 = levels.where(F.col("upto") > F.floor(0.95 * F.col("n"))).groupBy("event_type").agg(F.min("value").alias("p95"))
    return whole.join(p95, "event_type").select("event_type", "mean", "p95")


@query("""WITH q AS (SELECT vec_id AS query_id, embedding::DOUBLE[] AS e FROM embeddings WHERE vec_id % 50 = 0), p AS (SELECT vec_id AS id, embedding::DOUBLE[] AS e FROM embeddings),
    r AS (SELECT query_id, id, row_number() OVER (PARTITION BY query_id ORDER BY 1 - list_cosine_similarity(q.e, p.e), id) AS rank FROM q, p)
    SELECT query_id, id, rank::INT AS rank, source FROM r JOIN documents ON doc_id = id WHERE rank <= 10""")
def hits_lookup(spark, d):
    """Records of hits by id from files that hold a range of ids each; only files that may hold a hit are opened."""
    path = scratch(spark)
    Records.write(table(spark, d, "documents").select(F.col("doc_id").alias("id"), "source"), path)
    hits = S.exact_topk(points(spark, d), point_queries(spark, d), 10)
    return Records(spark, path).of_hits(hits).select("query_id", "id", "rank", "source")


@query(_topk_sql("label = 3"))
def snapshot_search(spark, d):
    """A table with an index, saved and loaded, searches by the loaded index."""
    t = S.VectorTable(spark, DIM).insert(points(spark, d), strict=False).build_index(32)
    path = scratch(spark)
    t.save(path)
    return _shown(S.VectorTable.load(spark, path).search(point_queries(spark, d), 10, [Equals("label", 3)]))


@query(_topk_sql().replace("SELECT query_id, id, rank::INT AS rank, round(distance, 6) + 0.0 AS distance FROM r WHERE rank <= 10", "SELECT query_id, id, source, lang, rank::INT AS rank FROM r JOIN documents ON id = doc_id WHERE rank <= 10"))
def hits_join_records(spark, d):
    hits = S.exact_topk(points(spark, d), point_queries(spark, d), 10)
    docs = table(spark, d, "documents").select(F.col("doc_id").alias("id"), "source", "lang")
    return hits.join(docs, "id").select("query_id", "id", "source", "lang", "rank")


_WORDINGS = """WITH q AS (SELECT vec_id AS wording, vec_id // 200 AS query_id, embedding::DOUBLE[] AS e FROM embeddings WHERE vec_id % 50 = 0),
    p AS (SELECT vec_id AS id, embedding::DOUBLE[] AS e FROM embeddings),
    s AS (SELECT query_id, wording, id, 1 - list_cosine_similarity(q.e, p.e) AS distance FROM q, p),
    h AS (SELECT query_id, wording, id, distance FROM (SELECT *, row_number() OVER (PARTITION BY wording ORDER BY distance, id) AS n FROM s) WHERE n <= 20)"""


def _wordings(spark, d):
    """Four neighbouring queries stand for the wordings of one question."""
    hits = S.exact_topk(points(spark, d), point_queries(spark, d), 20)
    return hits.select((F.col("query_id") / 200).cast("long").alias("query_id"), F.col("query_id").alias("wording"), "id", "distance")


@query(f"{_WORDINGS} SELECT query_id, wording, id, round(distance, 6) + 0.0 AS distance FROM h")
def expand_union(spark, d):
    return _wordings(spark, d).select("query_id", "wording", "id", (F.round("distance", 6) + 0.0).alias("distance"))


@query(f"""{_WORDINGS} SELECT query_id, id, wording, round(1 - distance, 6) AS score FROM (SELECT *, row_number() OVER (PARTITION BY query_id, id ORDER BY distance, wording) AS n FROM h WHERE 1 - distance >= 0.25) WHERE n = 1""")
def dedup_max_score(spark, d):
    best = R.dedup_max_score(R.score_floor(_wordings(spark, d)), ["query_id", "id"], "wording")
    return best.select("query_id", "id", "wording", F.round("score", 6).alias("score"))


def _mmr_sql(start: str) -> str:
    return f"""WITH RECURSIVE {start},
    st AS (SELECT 0 AS step, query_id, pos, id, score, e, NULL::DOUBLE AS near, 0 AS pick FROM cand
      UNION ALL
      SELECT step + 1, query_id, pos, id, score, e,
             CASE WHEN pick > 0 THEN near ELSE greatest(coalesce(near, -2), list_cosine_similarity(e, best_e)) END,
             CASE WHEN pos = best AND pick = 0 THEN step + 1 ELSE pick END
      FROM (SELECT *, first_value(pos) OVER w AS best, first_value(e) OVER w AS best_e FROM st WHERE step < 10
            WINDOW w AS (PARTITION BY query_id ORDER BY pick > 0, round(0.6 * score - 0.4 * coalesce(near, 0), 9) DESC, pos))),
    fin AS (SELECT query_id, id, pos, pick, count(*) OVER (PARTITION BY query_id) AS n FROM st WHERE step = 10)
    SELECT query_id, id, (CASE WHEN n <= 10 THEN pos ELSE pick END)::INT AS pick FROM fin WHERE n <= 10 OR pick > 0"""


@query(_mmr_sql(_SCORED.strip() + """,
    cand AS (SELECT query_id, r.id, n AS pos, 1 - distance AS score, p.e FROM (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY distance, id) AS n FROM s) r JOIN p ON p.id = r.id WHERE n <= 20)"""))
def mmr_rerank(spark, d):
    p = points(spark, d)
    hits = S.exact_topk(p, point_queries(spark, d), 20).withColumn("score", 1 - F.col("distance")).withColumnRenamed("rank", "pos")
    return R.mmr(hits.join(p.select("id", "vector"), "id").select("query_id", "id", "pos", "score", "vector"))


@query(_mmr_sql(_WORDINGS.removeprefix("WITH ") + """,
    b AS (SELECT query_id, id, wording, 1 - distance AS score FROM (SELECT *, row_number() OVER (PARTITION BY query_id, id ORDER BY distance, wording) AS n FROM h WHERE 1 - distance >= 0.25) WHERE n = 1),
    cand AS (SELECT query_id, b.id, row_number() OVER (PARTITION BY query_id ORDER BY round(score, 9) DESC, wording, b.id) AS pos, score, p.e FROM b JOIN p ON p.id = b.id)"""))
def retrieval_pipeline(spark, d):
    """Multi-query search, floor, deduplication and diversity in one plan."""
    return retrieve(points(spark, d), _wordings(spark, d))


@query("SELECT vec_id AS id, label, round(embedding[1]::DOUBLE, 6) + 0.0 AS first FROM embeddings")
def snapshot_roundtrip(spark, d):
    t = S.VectorTable(spark, DIM)
    t.points = points(spark, d).withColumn("seq", F.lit(0))
    path = scratch(spark)
    t.save(path)
    loaded = S.VectorTable.load(spark, path).points
    return loaded.select("id", "label", (F.round(F.element_at("vector", 1).cast("double"), 6) + 0.0).alias("first"))


@query(f"SELECT label, count(*) AS n, {EMBED_DIM} AS default_dim FROM embeddings GROUP BY label")
def points_by_label(spark, d):
    return count_by(points(spark, d), "label").withColumn("default_dim", F.lit(EMBED_DIM))
