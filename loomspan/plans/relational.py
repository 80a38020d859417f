"""Queries over files, catalogues, findings and events: joins, aggregates, windows."""

from __future__ import annotations

import functools
from datetime import timedelta

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from loomspan.config import CHUNK_OVERLAP, CHUNK_WORDS, SUMMARY_CHARS
from loomspan.functions import text as X
from loomspan.operators import catalog as C
from loomspan.operators import rank as R
from loomspan.operators import review as V
from loomspan.operators.segment import leading_text
from loomspan.plans._base import query, table
from loomspan.plans.texts import docs, paths, sql_fragments, sql_hit
from loomspan.sources import files as S
from loomspan.sources.grams import GramFiles
from loomspan.sources.snapshot import scratch

_PATHS = "SELECT page_id, regexp_replace(url, '^https?://', '') AS path FROM pages"


@query(f"""SELECT page_id, CASE WHEN regexp_extract(path, '([^/]*)$', 1) = '25' THEN 'India' WHEN contains(path, '/') THEN split_part(path, '/', 1) ELSE 'Global' END AS country
    FROM ({_PATHS}) WHERE NOT regexp_matches(lower(path), '(^|/)zips/')""")
def corpus_country_tag(spark, d):
    p = paths(spark, d).where(~S.in_skipped_folder(F.col("path")))
    return p.select("page_id", S.country_of(F.col("path"), {"25": "India"}).alias("country"))


@query("""SELECT path, length FROM (SELECT source || '/' || doc_id || CASE WHEN doc_id % 2 = 0 THEN '.TXT' ELSE '.csv' END AS path, strlen(text)::BIGINT AS length FROM documents)
    WHERE NOT (ends_with(lower(path), '.txt') AND length > 4096)""")
def corpus_size_skip(spark, d):
    ext = F.when(F.col("doc_id") % 2 == 0, ".TXT").otherwise(".csv")
    files = docs(spark, d).select(F.concat("source", F.lit("/"), F.col("doc_id").cast("string"), ext).alias("path"), F.octet_length("text").cast("long").alias("length"))
    return S.small_enough(files, 4096)


_FILES = """f AS (SELECT p_brand || '/' || p_name || '.pdf' AS path FROM part WHERE p_size % 3 > 0
      UNION ALL SELECT p_brand || '/' || p_name || ' (' || p_size || ').pdf' FROM part),
    n AS (SELECT path, split_part(path, '/', 1) AS folder, split_part(path, '/', 2) AS name FROM f),
    b AS (SELECT *, regexp_extract(name, '^(.*?) ?\\([0-9]+\\)(\\.[^.]*)$', 1) || regexp_extract(name, '^(.*?) ?\\([0-9]+\\)(\\.[^.]*)$', 2) AS original FROM n)""".replace("\\\\", "\\")


@query(f"WITH {_FILES} SELECT path FROM b WHERE NOT EXISTS (SELECT 1 FROM n WHERE n.folder = b.folder AND n.name = b.original AND b.original <> '')")
def duplicate_download_anti(spark, d):
    p = table(spark, d, "part")
    base = F.concat("p_brand", F.lit("/"), "p_name")
    files = p.where("p_size % 3 > 0").select(F.concat(base, F.lit(".pdf")).alias("path")).unionByName(p.select(F.concat(base, F.lit(" ("), F.col("p_size").cast("string"), F.lit(").pdf")).alias("path")))
    return S.drop_download_copies(files)


@query("""SELECT c_custkey, 'customer: ' || concat_ws(', ', 'c_name: ' || c_name, CASE WHEN c_nationkey % 4 > 0 THEN 'c_nationkey: ' || c_nationkey END, 'c_mktsegment: ' || c_mktsegment) AS text FROM customer""")
def row_to_text(spark, d):
    c = table(spark, d, "customer").withColumn("c_nationkey", F.when(F.col("c_nationkey") % 4 > 0, F.col("c_nationkey")))
    return c.select("c_custkey", S.row_to_text(F.lit("customer"), ["c_name", "c_nationkey", "c_mktsegment"]).alias("text"))


@query("""SELECT o_custkey AS sheet, min(o_orderkey) AS header_row FROM orders WHERE (o_orderstatus <> 'O')::INT + (o_orderkey % 3 = 0)::INT + (o_orderkey % 2 = 0)::INT >= 2 GROUP BY o_custkey""")
def header_row_detect(spark, d):
    o = table(spark, d, "orders")
    cells = F.array(F.when(F.col("o_orderstatus") != "O", F.col("o_orderstatus")), F.when(F.col("o_orderkey") % 3 == 0, F.lit("x")).otherwise(" "), F.when(F.col("o_orderkey") % 2 == 0, "y"))
    return S.header_row(o.select(F.col("o_custkey").alias("sheet"), "o_orderkey", cells.alias("cells")), "sheet", "o_orderkey", "cells")


@query(f"SELECT count(*) AS num_chunks, 'documents' AS source, 'hashing' AS model, {CHUNK_WORDS} AS chunk_size, {CHUNK_OVERLAP} AS chunk_overlap FROM documents")
def index_meta(spark, d):
    return S.index_meta(docs(spark, d), "documents", "hashing", CHUNK_WORDS, CHUNK_OVERLAP)


@query("SELECT s_suppkey AS id, round(s_acctbal / 100, 6) AS lat, s_nationkey::DOUBLE AS lng, s_name AS name FROM supplier WHERE s_acctbal > 0")
def asset_dim(spark, d):
    s = table(spark, d, "supplier").select(F.col("s_suppkey").alias("id"), F.round(F.when(F.col("s_acctbal") > 0, F.col("s_acctbal")) / 100, 6).alias("lat"), F.col("s_nationkey").cast("double").alias("lng"), F.col("s_name").alias("name"))
    return s.dropna(subset=["id", "lat", "lng"])


@query("SELECT doc_id, source, lang FROM documents WHERE lower(lang) = 'fr' AND contains(lower(source), 'src1') AND contains(lower(text), 'eau') ORDER BY doc_id LIMIT 10")
def browse_filter(spark, d):
    """The head of a filtered listing: the limit is the feature."""
    found = docs(spark, d).where((F.lower("lang") == "fr") & C.contains_fold(F.col("source"), "SRC1") & C.contains_fold(F.col("text"), "eau"))
    return found.orderBy("doc_id").limit(10).select("doc_id", "source", "lang")


@query(f"SELECT page_id FROM ({_PATHS}) WHERE regexp_matches(path, '/(fr|en)/') AND contains(lower(path), 'example.com')")
def library_filter(spark, d):
    p = paths(spark, d)
    return p.where(p.path.rlike("/(fr|en)/") & C.contains_fold(p.path, "Example.com")).select("page_id")


@query("SELECT p_partkey FROM part WHERE contains(lower(p_name), 'ring') OR contains(lower(p_brand), 'ring') OR contains(lower(p_type), 'ring')")
def multi_field_search(spark, d):
    p = table(spark, d, "part")
    return p.where(C.contains_fold(p.p_name, "ring") | C.contains_fold(p.p_brand, "ring") | C.contains_fold(p.p_type, "ring")).select("p_partkey")


@query("SELECT event_id, event_type FROM events WHERE event_type IN ('click', 'error')")
def facet_in_set(spark, d):
    return table(spark, d, "events").where(F.col("event_type").isin("click", "error")).select("event_id", "event_type")


@query("""WITH c AS (SELECT conv_id, list(turn ORDER BY turn) AS ts FROM conversations GROUP BY conv_id)
    SELECT conv_id, CASE WHEN conv_id % 3 = 0 THEN ts ELSE list_filter(ts, lambda t: t % 2 = 0) END AS kept FROM c""")
def corrective_filter(spark, d):
    """Turns of a conversation as chunks with an evaluator's flags; flags of the wrong length keep all."""
    c = table(spark, d, "conversations").groupBy("conv_id").agg(F.array_sort(F.collect_list("turn")).alias("chunks"))
    flags = F.transform("chunks", lambda t: t % 2 == 0)
    c = c.withColumn("flags", F.when(F.col("conv_id") % 3 == 0, F.array(F.lit(True))).otherwise(flags))
    kept = F.transform(F.filter(F.arrays_zip("chunks", "flags"), lambda z: z["flags"]), lambda z: z["chunks"])
    return c.select("conv_id", F.when(F.size("flags") == F.size("chunks"), kept).otherwise(F.col("chunks")).alias("kept"))


@query("""SELECT conv_id, turn, length(coalesce(short, text)) AS n FROM (SELECT conv_id, turn, text, CASE turn % 3 WHEN 0 THEN ' ' WHEN 1 THEN substr(text, 1, 40) END AS short FROM conversations) WHERE trim(coalesce(short, text)) <> ''""")
def compress_drop_empty(spark, d):
    short = F.when(F.col("turn") % 3 == 0, " ").when(F.col("turn") % 3 == 1, F.substring("text", 1, 40))
    c = table(spark, d, "conversations").withColumn("t", F.coalesce(short, F.col("text")))
    return c.where(F.trim("t") != "").select("conv_id", "turn", F.length("t").alias("n"))


@query("""WITH s AS (SELECT l_orderkey AS doc_id, l_linenumber AS section, l_linenumber AS pos, (l_quantity * 10)::INT AS chars, p AS passage_id, round((l_extendedprice * (p + 1)) % 997, 3) AS score FROM lineitem, range(5) r(p)),
    g AS (SELECT *, max(chars) OVER (PARTITION BY doc_id) AS longest FROM s),
    k AS (SELECT *, row_number() OVER (PARTITION BY doc_id, section ORDER BY score DESC, passage_id) AS n, max(score) OVER (PARTITION BY doc_id, section) AS best FROM g WHERE chars >= 150 OR longest < 150),
    t AS (SELECT *, dense_rank() OVER (PARTITION BY doc_id ORDER BY best DESC, pos) AS turn FROM k WHERE n <= 3),
    f AS (SELECT doc_id, passage_id, min((n, turn)) AS first FROM t GROUP BY doc_id, passage_id),
    z AS (SELECT doc_id, passage_id, row_number() OVER (PARTITION BY doc_id ORDER BY first, passage_id) AS place FROM f)
    SELECT doc_id, passage_id::INT AS passage_id, place::INT AS place FROM z WHERE place <= 3""")
def passage_select(spark, d):
    """Lines of an order as sections, each scored against five passages."""
    l = table(spark, d, "lineitem").withColumn("p", F.explode(F.array(*map(F.lit, range(5)))))
    s = l.select(
        F.col("l_orderkey").alias("doc_id"), F.col("l_linenumber").alias("section"), F.col("l_linenumber").alias("pos"), F.round(F.col("l_quantity") * 10).cast("int").alias("chars"), F.col("p").alias("passage_id"),
        F.round((F.col("l_extendedprice") * (F.col("p") + 1)) % 997, 3).alias("score"),
    )
    return R.passage_select(s, k=3)


_FINDINGS = rf"""raw AS (SELECT event_id AS finding, user_id AS doc_id, CASE event_id % 3 WHEN 0 THEN 'S' || (event_id % 8) WHEN 1 THEN '[S' || (event_id % 4) || ']' ELSE 'none' END AS section,
        CASE WHEN event_id % 11 = 0 THEN '"user ' || (event_id % 7) || ' ... of no part"' ELSE 'user ' || (event_id % 7) END AS quote,
        CASE event_id % 5 WHEN 0 THEN '[L' || (event_id % 30) || ']' WHEN 1 THEN 'L' || (event_id % 30) WHEN 2 THEN ' [l' || (event_id % 30) || ']' ELSE 'x' || event_id END AS law, event_type AS severity FROM events),
    u AS (SELECT DISTINCT user_id FROM events),
    sec AS (SELECT user_id AS doc_id, 'S' || i AS section, i AS pos, 'The User, ' || ((user_id + i) % 9) || ' of part ' || i AS text FROM u, range(5) t(i)),
    law AS (SELECT n_nationkey AS ordinal, n_regionkey AS passage_id FROM nation),
    r AS (SELECT finding, doc_id, trim(section, '[] ') AS named, {sql_fragments('left(quote, 400)')} AS fs, passage_id,
        CASE WHEN lower(trim(severity)) IN ('critical', 'severe', 'high') THEN 'high' WHEN lower(trim(severity)) IN ('minor', 'info', 'low') THEN 'low' ELSE 'medium' END AS severity
        FROM raw JOIN law ON ordinal = try_cast(regexp_extract(trim(law), '(?i)^\[?L([0-9]+)\]?$', 1) AS INT)),
    every AS (SELECT finding, doc_id, named, passage_id, severity, section, pos, text, fs, unnest(range(1, len(fs) + 1)) AS k FROM r JOIN sec USING (doc_id)),
    hits AS (SELECT finding, section, pos, any_value(text) AS text, arg_min(hit, k) AS hit FROM (SELECT *, {sql_hit('text', 'fs[k]')} AS hit FROM every) WHERE hit <> '' GROUP BY finding, section, pos),
    best AS (SELECT finding, section, pos, text, hit FROM (SELECT hits.*, row_number() OVER (PARTITION BY finding ORDER BY CASE WHEN section = named THEN 0 ELSE 1 END, pos) AS n FROM hits JOIN r USING (finding)) WHERE n = 1),
    v AS (SELECT r.finding, r.doc_id, coalesce(b.section, home.section) AS section, coalesce(b.pos, home.pos) AS pos, passage_id, strpos(b.text, hit) - 1 AS start, strpos(b.text, hit) - 1 + length(hit) AS stop,
        b.finding IS NOT NULL AS verified, b.finding IS NOT NULL AND b.section <> named AS moved, severity
        FROM r LEFT JOIN best b ON b.finding = r.finding LEFT JOIN sec home ON home.doc_id = r.doc_id AND home.section = named WHERE b.finding IS NOT NULL OR home.section IS NOT NULL)"""


def findings(spark, d):
    """Findings made from events: a section by its name, by its name in brackets or none, a quote, whole or around dots, and a law mark."""
    e = table(spark, d, "events")
    m, n = F.col("event_id") % 5, F.col("event_id") % 3
    law = F.when(m == 0, F.concat(F.lit("[L"), F.col("event_id") % 30, F.lit("]"))).when(m == 1, F.concat(F.lit("L"), F.col("event_id") % 30))
    law = law.when(m == 2, F.concat(F.lit(" [l"), F.col("event_id") % 30, F.lit("]"))).otherwise(F.concat(F.lit("x"), "event_id"))
    section = F.when(n == 0, F.concat(F.lit("S"), F.col("event_id") % 8)).when(n == 1, F.concat(F.lit("[S"), F.col("event_id") % 4, F.lit("]"))).otherwise("none")
    user = F.concat(F.lit("user "), F.col("event_id") % 7)
    quote = F.when(F.col("event_id") % 11 == 0, F.concat(F.lit('"'), user, F.lit(' ... of no part"'))).otherwise(user)
    raw = e.select(F.col("event_id").alias("finding"), F.col("user_id").alias("doc_id"), section.alias("section"), quote.alias("quote"), law.alias("law"), F.col("event_type").alias("severity"))
    parts = e.select("user_id").distinct().select(F.col("user_id").alias("doc_id"), F.explode(F.sequence(F.lit(0), F.lit(4))).alias("pos"))
    text = F.concat(F.lit("The User, "), (F.col("doc_id") + F.col("pos")) % 9, F.lit(" of part "), "pos")
    sections = parts.select("doc_id", F.concat(F.lit("S"), "pos").alias("section"), "pos", text.alias("text"))
    laws = table(spark, d, "nation").select(F.col("n_nationkey").alias("ordinal"), F.col("n_regionkey").alias("passage_id"))
    return V.validate(raw, sections, laws)


def _shown(f):
    return f.select("finding", "doc_id", "section", "pos", "passage_id", "start", F.col("end").alias("stop"), "verified", "moved", "severity")


@query(f"WITH {_FINDINGS} SELECT finding, doc_id, section, pos::INT AS pos, passage_id, start, stop, verified, moved, severity FROM v")
def finding_validate(spark, d):
    return _shown(findings(spark, d))


@query(f"WITH {_FINDINGS} SELECT finding, section, start, stop FROM v WHERE moved")
def quote_locate_fallback(spark, d):
    return _shown(findings(spark, d)).where("moved").select("finding", "section", "start", "stop")


_DEDUP = f"{_FINDINGS}, f AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY doc_id, section, passage_id, start ORDER BY finding) AS n FROM v) WHERE n = 1)"


@query(f"WITH {_DEDUP} SELECT finding, doc_id, section, passage_id, start FROM f")
def finding_dedup(spark, d):
    return V.dedup(findings(spark, d)).select("finding", "doc_id", "section", "passage_id", "start")


_RANKED = f"{_DEDUP}, k AS (SELECT *, 'F' || row_number() OVER (PARTITION BY doc_id ORDER BY CASE severity WHEN 'high' THEN 0 WHEN 'medium' THEN 1 ELSE 2 END, pos, finding) AS name FROM f)"


@query(f"WITH {_RANKED} SELECT finding, doc_id, name, severity FROM k")
def finding_rank(spark, d):
    return V.rank(V.dedup(findings(spark, d))).select("finding", "doc_id", "name", "severity")


@query(f"WITH {_FINDINGS} SELECT doc_id, section, count(*) AS n, list(finding ORDER BY finding) AS findings FROM v GROUP BY doc_id, section")
def findings_by_section(spark, d):
    return findings(spark, d).groupBy("doc_id", "section").agg(F.count("*").alias("n"), F.array_sort(F.collect_list("finding")).alias("findings"))


@query(f"WITH {_FINDINGS} SELECT doc_id, count(*) FILTER (WHERE severity = 'high') AS high, count(*) FILTER (WHERE severity = 'medium') AS medium, count(*) FILTER (WHERE severity = 'low') AS low FROM v GROUP BY doc_id")
def severity_counts(spark, d):
    return V.severity_counts(findings(spark, d), "doc_id")


@query(f"WITH {_DEDUP} SELECT doc_id, '# Report ' || doc_id || chr(10) || chr(10) || string_agg('- ' || section || ' (' || severity || '): law ' || passage_id, chr(10) ORDER BY finding) AS report FROM f GROUP BY doc_id")
def findings_report(spark, d):
    line = F.concat(F.lit("- "), "section", F.lit(" ("), "severity", F.lit("): law "), F.col("passage_id"))
    return V.report(V.dedup(findings(spark, d)), "doc_id", line, "finding", F.concat(F.lit("# Report "), F.col("doc_id")))


@query("SELECT doc_id, source FROM documents WHERE source IN (SELECT 'src' || n_nationkey FROM nation WHERE n_regionkey < 2)")
def law_corpus_semi(spark, d):
    laws = table(spark, d, "nation").where("n_regionkey < 2").select(F.concat(F.lit("src"), "n_nationkey").alias("source"))
    return docs(spark, d).join(laws, "source", "left_semi").select("doc_id", "source")


@query("SELECT lang, list_sort(list_distinct(list(source))) AS names FROM documents GROUP BY lang")
def law_source_names(spark, d):
    return docs(spark, d).groupBy("lang").agg(F.array_sort(F.collect_set("source")).alias("names"))


_WORD = r"[\p{L}\p{N}_]+"
_MARKS = r"""m AS (SELECT doc_id, line::INT AS line, mark || ' [Passage ' || ((doc_id + line) % 50) || ']' AS mark FROM (SELECT doc_id, unnest(ls) AS mark, unnest(range(len(ls))) AS line FROM (SELECT doc_id, string_split(text, chr(10)) AS ls FROM documents))),
    s AS (SELECT item_id, regexp_extract(text, '[\p{L}\p{N}_]+') AS name FROM benchmark)"""


@query(f"""WITH {_MARKS}
    SELECT doc_id, line, item_id AS cited, 'name' AS how FROM m JOIN s ON name <> '' AND contains(mark, name)
    UNION SELECT doc_id, line, item_id, 'ordinal' FROM m JOIN s ON list_contains(regexp_extract_all(mark, '(?i)Passage\\s+(\\d+)', 1)::BIGINT[], item_id)""".replace("\\\\", "\\"))
def citation_resolve(spark, d):
    """Each line of a document as a mark: which sources it names, by the first word of a passage anywhere in it, or by a passage's ordinal."""
    line = docs(spark, d).select("doc_id", F.posexplode(F.split("text", "\n")).alias("line", "mark"))
    marks = line.withColumn("mark", F.concat("mark", F.lit(" [Passage "), (F.col("doc_id") + F.col("line")) % 50, F.lit("]")))
    sources = table(spark, d, "benchmark").select(F.col("item_id").alias("ordinal"), F.regexp_extract("text", _WORD, 0).alias("name"), F.col("item_id").alias("source_id"))
    return C.resolve_marks(marks, sources)


_HITS = r"""w AS (SELECT item_id, regexp_extract_all(text, '[\p{L}\p{N}_]+') AS ws FROM benchmark),
    s AS (SELECT ws[5] AS asset_id, min(item_id) AS lat, max(item_id) AS lng, arg_min(ws[7] || ' ' || ws[8], item_id) AS name FROM w WHERE len(ws) >= 8 GROUP BY ws[5]),
    a AS (SELECT doc_id, regexp_replace(translate(text, chr(160) || chr(8239) || chr(8208) || chr(8209), '  --'), '\s*<br\s*/?>\s*', '; ', 'gi') AS t FROM documents),
    h AS (SELECT doc_id, asset_id FROM (SELECT doc_id, unnest(list_distinct(regexp_extract_all(t, '[\p{L}\p{N}_]+'))) AS asset_id FROM a) JOIN s USING (asset_id)
        UNION SELECT doc_id, asset_id FROM (SELECT doc_id, lower(t) AS t FROM a) JOIN s ON contains(t, lower(name)))"""


def _highlights(spark, d):
    """Documents as answers; a word of each passage as an asset's id, and two later ones as its name."""
    w = table(spark, d, "benchmark").select("item_id", F.regexp_extract_all("text", F.lit(_WORD), F.lit(0)).alias("ws")).where("size(ws) >= 8")
    w = w.select("item_id", F.get("ws", F.lit(4)).alias("asset_id"), F.concat_ws(" ", F.get("ws", F.lit(6)), F.get("ws", F.lit(7))).alias("name"))
    assets = w.groupBy("asset_id").agg(F.min("item_id").alias("lat"), F.max("item_id").alias("lng"), F.min_by("name", "item_id").alias("name"))
    return C.highlight(docs(spark, d).select("doc_id", "text"), assets, "text"), assets


@query(f"WITH {_HITS} SELECT doc_id, asset_id FROM h")
def asset_highlight(spark, d):
    return _highlights(spark, d)[0]


@query(f"WITH {_HITS} SELECT doc_id, round(avg(lat), 6) AS lat, round(avg(lng), 6) AS lng, CASE WHEN count(*) = 1 THEN 9 ELSE 6 END AS zoom FROM h JOIN s USING (asset_id) GROUP BY doc_id")
def asset_centroid(spark, d):
    found, assets = _highlights(spark, d)
    c = C.centroid(found.join(assets, "asset_id"), "doc_id", "lat", "lng")
    return c.select("doc_id", F.round("lat", 6).alias("lat"), F.round("lng", 6).alias("lng"), "zoom")


_CHUNKS = """c AS (SELECT doc_id // 12 AS answer, doc_id AS pos, 'C' || doc_id AS chunk_id, CASE WHEN doc_id % 11 > 0 THEN 'laws\\' || lang || '/' || lang || '-laws and provisions.pdf' END AS source_file, lang AS country,
        (doc_id % 3)::INT AS page, (doc_id % 5)::INT AS row, text FROM documents),
    p AS (SELECT *, CASE WHEN source_file IS NULL THEN 'unknown' ELSE regexp_extract(source_file, '[^/]*$') END AS name, CASE WHEN page > 0 THEN 'pg.' WHEN row <> 0 THEN 'row' END AS unit, CASE WHEN page > 0 THEN page WHEN row <> 0 THEN row END AS number FROM c),
    g AS (SELECT answer, name, min(pos) AS first, arg_min(source_file, pos) AS file, arg_min(country, pos) AS country, coalesce(arg_max(unit, pos) FILTER (WHERE unit IS NOT NULL), 'pg.') AS unit,
        coalesce(list_sort(list_distinct(list(number) FILTER (WHERE number IS NOT NULL))), []) AS pages,
        string_agg(chunk_id || ':' || CASE WHEN unit = 'pg.' THEN number::VARCHAR ELSE '-' END || ':' || CASE WHEN unit = 'row' THEN number::VARCHAR ELSE '-' END || ':' || md5(CASE WHEN length(text) > 1500 THEN left(text, 1500) || ' ...' ELSE text END), ' ' ORDER BY pos) AS excerpts FROM p GROUP BY answer, name)"""


@query(f"""WITH {_CHUNKS} SELECT answer, (row_number() OVER (PARTITION BY answer ORDER BY first, name))::INT AS id, name, CASE WHEN length(name) > 18 THEN left(name, 18) || '...' ELSE name END AS short_name,
    left(sha1(replace(file, chr(92), '/')), 16) AS source_id, country, unit, pages, excerpts FROM g""".replace("\\\\", "\\"))
def sources_excerpts(spark, d):
    """Twelve documents a group as the chunks of an answer, the language's file as their source, with excerpts."""
    c = docs(spark, d)
    file = F.when(F.col("doc_id") % 11 > 0, F.concat(F.lit("laws\\"), "lang", F.lit("/"), "lang", F.lit("-laws and provisions.pdf")))
    chunks = c.select(
        F.expr("doc_id div 12").alias("answer"), F.col("doc_id").alias("pos"), F.concat(F.lit("C"), "doc_id").alias("chunk_id"), file.alias("source_file"), F.col("lang").alias("country"),
        (F.col("doc_id") % 3).cast("int").alias("page"), (F.col("doc_id") % 5).cast("int").alias("row"), F.lit(None).cast("string").alias("sheet"), "text",
    )
    at = lambda v: F.coalesce(v.cast("string"), F.lit("-"))
    shown = F.array_join(F.transform("excerpts", lambda e: F.concat_ws(":", e["chunk_id"], at(e["page"]), at(e["row"]), F.md5(e["text"]))), " ")
    return C.sources_of(chunks, ["answer"]).withColumn("excerpts", shown)


@query("""SELECT needle, doc_id FROM (VALUES ('ering on'), ('THE OF'), ('tion en'), ('#unseen#')) n(needle) JOIN documents ON contains(lower(text), lower(needle))""")
def browse_by_grams(spark, d):
    """Documents that hold a needle, from files by language and source whose n-grams are known; only files that can hold it are opened."""
    path = scratch(spark)
    texts = GramFiles.write(table(spark, d, "documents").select("doc_id", "lang", "source", "text"), path, ["lang", "source", "doc_id"], files=16)
    found = [texts.search(n).select(F.lit(n).alias("needle"), "doc_id") for n in ("ering on", "THE OF", "tion en", "#unseen#")]
    return functools.reduce(DataFrame.unionByName, found)


@query("SELECT c_custkey, n_name FROM customer LEFT JOIN nation ON c_nationkey + 5 = n_nationkey")
def refs_left_join(spark, d):
    n = table(spark, d, "nation").select((F.col("n_nationkey") - 5).alias("c_nationkey"), "n_name")
    return table(spark, d, "customer").join(n, "c_nationkey", "left").select("c_custkey", "n_name")


@query("""WITH s AS (SELECT c_nationkey, count(*) AS chunks, round(sum(c_acctbal), 2) AS size FROM customer WHERE c_mktsegment = 'MACHINERY' GROUP BY c_nationkey)
    SELECT n_name, coalesce(chunks, 0) AS chunks, size FROM nation LEFT JOIN s ON n_nationkey = c_nationkey""")
def source_catalog(spark, d):
    c = table(spark, d, "customer").where("c_mktsegment = 'MACHINERY'").groupBy(F.col("c_nationkey").alias("key")).agg(F.count("*").alias("chunks"), F.round(F.sum("c_acctbal"), 2).alias("size"))
    n = table(spark, d, "nation").select(F.col("n_nationkey").alias("key"), "n_name")
    return C.catalog(n, c, "key").select("n_name", "chunks", "size").orderBy(F.lower("n_name"))


@query("SELECT source, count(*) AS n FROM documents GROUP BY source")
def count_by_source(spark, d):
    return C.count_by(docs(spark, d), "source").orderBy(F.desc("n"), "source")


@query(f"SELECT ext, count(*) AS n FROM (SELECT regexp_extract(path, '\\.([a-z]+)/', 1) AS ext FROM ({_PATHS})) GROUP BY ext")
def count_by_format(spark, d):
    return C.count_by(paths(spark, d).select(F.regexp_extract("path", r"\.([a-z]+)/", 1).alias("ext")), "ext")


@query("SELECT source, n, lang FROM (SELECT source, lang, sum(c) OVER (PARTITION BY source)::BIGINT AS n, row_number() OVER (PARTITION BY source ORDER BY c DESC, seen) AS r FROM (SELECT source, lang, count(*) AS c, min(doc_id) AS seen FROM documents GROUP BY source, lang)) WHERE r = 1")
def source_modal_country(spark, d):
    return C.modal_value(docs(spark, d), "source", "lang", "doc_id")


@query("SELECT facet, count(*) AS n FROM (SELECT coalesce(nullif(CASE WHEN p_size % 5 = 0 THEN '' WHEN p_size % 7 = 0 THEN NULL ELSE p_type END, ''), 'Other') AS facet FROM part) GROUP BY facet")
def facet_counts(spark, d):
    p = table(spark, d, "part").withColumn("kind", F.when(F.col("p_size") % 5 == 0, "").when(F.col("p_size") % 7 == 0, F.lit(None)).otherwise(F.col("p_type")))
    return C.facet_counts(p, "kind")


@query("SELECT count(*) AS documents, sum(n_chars)::BIGINT AS chars, sum(strlen(text))::BIGINT AS bytes FROM documents")
def library_totals(spark, d):
    return docs(spark, d).agg(F.count("*").alias("documents"), F.sum("n_chars").alias("chars"), F.sum(F.octet_length("text")).cast("long").alias("bytes"))


@query(f"SELECT conv_id, substr(string_agg(text, ' ' ORDER BY turn), 1, {SUMMARY_CHARS}) AS summary FROM conversations GROUP BY conv_id")
def summary_concat(spark, d):
    return leading_text(table(spark, d, "conversations"), "conv_id", "turn", "text", SUMMARY_CHARS).withColumnRenamed("text", "summary")


@query("""SELECT user_id, CASE WHEN arg_max(event_type, event_id) = 'error' THEN 'failed' WHEN arg_max(event_type, event_id) = 'purchase' THEN 'succeeded' WHEN count(*) < 3 THEN 'queued' ELSE 'running' END AS state,
    CASE WHEN arg_max(event_type, event_id) = 'purchase' THEN count(*) END AS n FROM events GROUP BY user_id""")
def job_state(spark, d):
    """A job per user; its last event decides the state, and only a finished one has a count."""
    j = table(spark, d, "events").groupBy("user_id").agg(F.max_by("event_type", "event_id").alias("last"), F.count("*").alias("c"))
    state = F.when(F.col("last") == "error", "failed").when(F.col("last") == "purchase", "succeeded").when(F.col("c") < 3, "queued").otherwise("running")
    return j.select("user_id", state.alias("state"), F.when(F.col("last") == "purchase", F.col("c")).alias("n"))


@query("SELECT l_suppkey, list_sort(list_distinct(list(l_linenumber) FILTER (WHERE l_linenumber > 1))) AS pages FROM lineitem GROUP BY l_suppkey HAVING count(*) FILTER (WHERE l_linenumber > 1) > 0")
def cited_pages(spark, d):
    pages = table(spark, d, "lineitem").where("l_linenumber > 1")
    return pages.groupBy("l_suppkey").agg(F.array_sort(F.collect_set("l_linenumber")).alias("pages"))


@query("""SELECT o_custkey, o_orderpriority, (row_number() OVER (PARTITION BY o_custkey ORDER BY first))::INT AS id, pages, unit, n FROM (
    SELECT o_custkey, o_orderpriority, min(o_orderkey) AS first, list_sort(list_distinct(list(o_orderkey % 7) FILTER (WHERE o_orderkey % 7 > 0))) AS pages, arg_max(o_orderstatus, o_orderkey) AS unit, count(*) AS n FROM orders GROUP BY o_custkey, o_orderpriority)""".replace("list_sort(", "coalesce(list_sort(").replace("> 0))) AS pages", "> 0))), []) AS pages"))
def build_sources(spark, d):
    """Orders of a customer as chunks, their priority as the source's name."""
    o = table(spark, d, "orders").withColumn("page", F.col("o_orderkey") % 7)
    return C.build_sources(o, "o_custkey", "o_orderpriority", "page", "o_orderkey", "o_orderstatus", "o_orderkey")


@query("""SELECT o_custkey, o_orderpriority, o_orderstatus, (row_number() OVER (PARTITION BY o_custkey ORDER BY o_orderkey))::INT AS ref FROM (
    SELECT *, row_number() OVER (PARTITION BY o_custkey, o_orderpriority, o_orderstatus ORDER BY o_orderkey) AS n FROM orders) WHERE n = 1""")
def build_refs(spark, d):
    return C.build_refs(table(spark, d, "orders"), "o_custkey", "o_orderpriority", "o_orderstatus", "o_orderkey")


@query("SELECT o_orderkey, o_orderdate FROM orders WHERE o_orderstatus = 'F'")
def recent_first(spark, d):
    return table(spark, d, "orders").where("o_orderstatus = 'F'").select("o_orderkey", "o_orderdate").orderBy(F.desc("o_orderdate"), "o_orderkey")


@query("SELECT event_id, ts FROM events WHERE ts >= (SELECT max(ts) - INTERVAL 24 HOUR FROM events)")
def retention_filter(spark, d):
    """Events of the last 24 hours before the newest one; the cutoff is a literal, so it reaches the scan."""
    e = table(spark, d, "events")
    cutoff = e.agg(F.max("ts")).first()[0]
    if cutoff is None:
        return e.select("event_id", "ts")
    return e.where(F.col("ts") >= F.lit(cutoff - timedelta(hours=24))).select("event_id", "ts")


_KNOWN = {"id": -1, "page": -1, "country": "", "source_file": ""}


@query("SELECT doc_id AS id, -1 AS page, coalesce(lang, '') AS country, '' AS source_file, 'n_chars=' || coalesce(n_chars::VARCHAR, '') || ';source=' || coalesce(source, '') AS extra FROM documents")
def payload_split(spark, d):
    """Fixed fields of a record with their defaults, and the rest as extra fields."""
    rows = table(spark, d, "documents").select(F.col("doc_id").alias("id"), F.col("lang").alias("country"), "n_chars", "source")
    pair = lambda e: F.concat(e["key"], F.lit("="), F.coalesce(e["value"], F.lit("")))
    extra = F.array_join(F.array_sort(F.transform(F.map_entries("extra"), pair)), ";")
    return C.split_payload(rows, _KNOWN).withColumn("extra", extra)


_BROWSED = [("search", None, None, "eau"), ("source", None, "SRC1", "eau"), ("country", "FR", None, None)]


@query("""WITH d AS (SELECT lang, contains(lower(source), 'src1') AS s, contains(lower(text), 'eau') AS t, lower(lang) = 'fr' AS f FROM documents),
    c AS (SELECT count(*) FILTER (t) AS a, count(*) FILTER (s AND t) AS b, count(*) FILTER (f) AS c FROM d)
    SELECT 'search' AS scope, (SELECT a FROM c) AS matched, lang AS country, count(*) AS n FROM d GROUP BY lang
    UNION ALL SELECT 'source', (SELECT b FROM c), lang, count(*) FROM d WHERE s AND t GROUP BY lang
    UNION ALL SELECT 'country', (SELECT c FROM c), lang, count(*) FROM d WHERE f GROUP BY lang""")
def browse_summary(spark, d):
    """Counts by country of three listings: a search alone summarises all rows, a country or source what it leaves."""
    rows = table(spark, d, "documents").select(F.col("lang").alias("country"), F.col("source").alias("source_file"), "text")
    out = []
    for scope, country, source, search in _BROWSED:
        shown, counted = C.browse(rows, country, source, search)
        matched = shown.agg(F.count("*").alias("matched")).scalar()
        out.append(C.count_by(counted, "country").select(F.lit(scope).alias("scope"), matched.alias("matched"), "country", "n"))
    return out[0].unionByName(out[1]).unionByName(out[2])


@query("""WITH r AS (SELECT DISTINCT conv_id, unnest([conv_id, conv_id * 3, conv_id, -1]) AS id FROM conversations)
    SELECT conv_id, id, md5(text) AS text FROM r JOIN documents ON id = doc_id WHERE text IS NOT NULL""")
def chunk_texts(spark, d):
    """The texts of listed chunks; ids that no chunk has, and chunks without text, give no row."""
    c = table(spark, d, "conversations").select("conv_id").distinct()
    ids = F.array(F.col("conv_id"), F.col("conv_id") * 3, F.col("conv_id"), F.lit(-1).cast("long"))
    chunks = table(spark, d, "documents").where("text is not null").select(F.col("doc_id").alias("id"), "text")
    return C.texts_of(c.withColumn("ids", ids), "ids", chunks).select("conv_id", "id", F.md5("text").alias("text"))


@query("""WITH s AS (SELECT o_custkey, o_orderpriority, (row_number() OVER (PARTITION BY o_custkey ORDER BY min(o_orderkey)))::INT AS id FROM orders GROUP BY o_custkey, o_orderpriority)
    SELECT o_custkey, o_orderpriority, id FROM s WHERE (o_custkey, id) IN (SELECT (o_custkey, (o_orderkey % 5)::INT) FROM orders)""")
def cited_sources(spark, d):
    """The sources of a customer's answer that its citations (here: remainders of order keys) name."""
    o = table(spark, d, "orders").withColumn("page", F.col("o_orderkey") % 7)
    sources = C.build_sources(o, "o_custkey", "o_orderpriority", "page", "o_orderkey", "o_orderstatus", "o_orderkey")
    cites = o.select("o_custkey", (F.col("o_orderkey") % 5).cast("int").alias("id"))
    return C.cited(sources, cites, ["o_custkey", "id"]).select("o_custkey", "o_orderpriority", "id")
