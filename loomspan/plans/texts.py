"""Queries over texts: cleaning, cutting, locating, labelling."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from loomspan.functions import text as X
from loomspan.operators import catalog as C
from loomspan.operators import rank as R
from loomspan.operators import segment as G
from loomspan.operators.long_texts import pack_rows, word_window_rows
from loomspan.operators.names import find_names, first_phrase, quotes_in
from loomspan.plans._base import query, table
from loomspan.sources import files as S


def docs(spark, d):
    return table(spark, d, "documents").withColumn("text", F.coalesce("text", F.lit("")))


def once(rows, **columns):
    """rows with columns that are computed once a row: later uses and filters do not repeat their expressions, as they may after withColumn."""
    for name, value in columns.items():
        rows = rows.select("*", F.explode_outer(F.array(value)).alias(name))
    return rows


_CTRL = r"[\x00-\x08\x0B\x0C\x0E-\x1F\x7F]"
_STRIP = r"regexp_replace({}, '^\s+|\s+$', '', 'g')"


def _sql_clean(x: str) -> str:
    return _STRIP.format(rf"regexp_replace(regexp_replace({x}, '{_CTRL}', '', 'g'), '\s+', ' ', 'g')")


def _sql_clean_line(x: str) -> str:
    return _STRIP.format(rf"regexp_replace(regexp_replace({x}, '{_CTRL}', '', 'g'), '[ \t]+', ' ', 'g')")


@query(f"SELECT doc_id, md5({_sql_clean('text')}) AS cleaned, length({_sql_clean('text')}) AS n FROM documents")
def clean_text(spark, d):
    c = X.clean(F.col("text"))
    return docs(spark, d).select("doc_id", F.md5(c).alias("cleaned"), F.length(c).alias("n"))


@query("SELECT doc_id, length(text) // 4 AS n FROM documents")
def token_approx(spark, d):
    return docs(spark, d).select("doc_id", X.token_approx(F.col("text")).alias("n"))


@query("SELECT doc_id, md5(text) AS hash, count(*) OVER (PARTITION BY md5(text)) AS n FROM documents")
def content_hash(spark, d):
    hashed = docs(spark, d).select("doc_id", F.md5("text").alias("hash"))
    return hashed.join(hashed.groupBy("hash").agg(F.count("*").alias("n")), "hash").select("doc_id", "hash", "n")


_JOINED = r"(SELECT source || '/' || lang AS key, string_agg(text, chr(10) || ' ' || chr(10) ORDER BY doc_id) AS text FROM documents GROUP BY 1)"


def _joined(spark, d):
    """Documents of one source and language as one text of paragraphs: a bounded group only in these tables, so a derived input."""
    parts = F.array_sort(F.collect_list(F.struct("doc_id", "text")))
    return docs(spark, d).groupBy(F.concat_ws("/", "source", "lang").alias("key")).agg(F.array_join(F.transform(parts, lambda p: p["text"]), "\n \n").alias("text"))


@query(rf"""WITH j AS {_JOINED}, p AS (SELECT key, string_split_regex(text, '\n\s*\n') AS ps FROM j),
    u AS (SELECT key, unnest(range(1, len(ps) + 1)) AS row, {_STRIP.format("unnest(ps)")} AS t FROM p)
    SELECT key, row, md5(t) AS hash FROM u WHERE length(t) >= 100""")
def paragraph_blocks(spark, d):
    return S.paragraph_blocks(_joined(spark, d), "key", "text").select("key", "row", F.md5("text").alias("hash"))


@query(f"""WITH l AS (SELECT doc_id, list_filter(list_transform(string_split(text, chr(10)), lambda x: {_sql_clean_line('x')}), lambda x: x <> '') AS ls FROM documents),
    k AS (SELECT * FROM l WHERE list_sum(list_transform(ls, lambda x: length(x))) >= 40)
    SELECT doc_id, unnest(range(1, len(ls) + 1)) AS pos, 'S' || unnest(range(1, len(ls) + 1)) AS section_id, md5(unnest(ls)) AS hash FROM k""")
def sections_from_text(spark, d):
    return S.sections(docs(spark, d), "doc_id", "text").select("doc_id", "pos", "section_id", F.md5("text").alias("hash"))


_WINDOWS = rf"""w AS (SELECT doc_id, text, string_split_regex({_STRIP.format("text")}, '\s+') AS ws FROM documents),
    c AS (SELECT doc_id, ws, unnest(range(0, greatest(0, ceil((len(ws) - 512) / 432)::INT) + 1)) AS k FROM w)"""


@query(f"WITH {_WINDOWS} SELECT doc_id, k::INT AS k, md5(array_to_string(ws[k * 432 + 1 : k * 432 + 512], ' ')) AS hash FROM c")
def chunk_words(spark, d):
    return docs(spark, d).select("doc_id", F.posexplode(G.word_windows(F.col("text"))).alias("k", "t")).select("doc_id", "k", F.md5("t").alias("hash"))


@query(f"""WITH {_WINDOWS}, a AS (SELECT doc_id, text AS t FROM documents WHERE length(text) // 4 <= 512
      UNION ALL SELECT doc_id, array_to_string(ws[k * 432 + 1 : k * 432 + 512], ' ') FROM c WHERE doc_id IN (SELECT doc_id FROM documents WHERE length(text) // 4 > 512))
    SELECT doc_id, md5(t) AS hash, length(t) AS n FROM a WHERE length(t) >= 100""")
def create_chunks(spark, d):
    return docs(spark, d).select("doc_id", F.explode(G.chunks(F.col("text"))).alias("t")).select("doc_id", F.md5("t").alias("hash"), F.length("t").alias("n"))


def _pack_sql(pieces: str, most: int, joint: str) -> str:
    return f"""WITH RECURSIVE s AS ({pieces}),
    r AS (SELECT doc_id, ps, 1 AS i, '' AS cur, []::VARCHAR[] AS done FROM s
      UNION ALL
      SELECT doc_id, ps, i + 1, CASE WHEN cur = '' OR length(cur) + {1} + length(ps[i]) > {most} THEN ps[i] ELSE cur || {joint} || ps[i] END,
             CASE WHEN cur <> '' AND length(cur) + {1} + length(ps[i]) > {most} THEN [cur] ELSE [] END
      FROM r WHERE i <= len(ps)),
    o AS (SELECT doc_id, i, unnest(done) AS t FROM r UNION ALL SELECT doc_id, i + 1, cur FROM r WHERE i = len(ps) + 1 AND cur <> '')
    SELECT doc_id, (row_number() OVER (PARTITION BY doc_id ORDER BY i) - 1)::INT AS k, md5(t) AS hash FROM o"""


_SENTENCES = rf"""SELECT doc_id, list_filter(list_transform(string_split_regex(regexp_replace(text, '([.;:])\s+', '\1' || chr(1), 'g'), chr(1) || '|\n+'),
    lambda x: {_STRIP.format("x")}), lambda x: x <> '') AS ps FROM documents"""


@query(_pack_sql(_SENTENCES, 700, "' '"))
def passage_split(spark, d):
    return docs(spark, d).select("doc_id", F.posexplode(G.passages(F.col("text"))).alias("k", "t")).select("doc_id", "k", F.md5("t").alias("hash"))


@query(_pack_sql(_SENTENCES, 700, "' '"))
def passage_rows(spark, d):
    """The same passages from rows of sentences, as very long texts need it."""
    found = F.filter(F.transform(F.split("text", r"(?<=[.;:])\s+|\n+"), X.strip), lambda x: x != "")
    pieces = docs(spark, d).select("doc_id", F.posexplode(found).alias("pos", "text"))
    k = F.row_number().over(Window.partitionBy("doc_id").orderBy("pos")) - 1
    return pack_rows(pieces, ["doc_id"], 700, " ").select("doc_id", k.alias("k"), F.md5("text").alias("hash"))


@query(rf"""WITH w AS (SELECT doc_id, string_split_regex({_STRIP.format("text")}, '\s+') AS ws FROM documents),
    n AS (SELECT doc_id, ws, unnest(range(greatest(0, ceil((len(ws) - 50) / 40.0)::INT) + 1)) AS k FROM w)
    SELECT doc_id, k::INT AS k, md5(array_to_string(ws[k * 40 + 1 : k * 40 + 50], ' ')) AS hash FROM n""".replace("\\\\", "\\"))
def window_rows(spark, d):
    """Windows of fifty words, forty apart, from rows of words."""
    found = word_window_rows(docs(spark, d).select("doc_id", "text"), ["doc_id"], "text", 50, 10)
    return found.select("doc_id", F.col("window").alias("k"), F.md5("text").alias("hash"))


_LINES = "SELECT doc_id, string_split(text, chr(10)) AS ps FROM documents"


@query(_pack_sql(_LINES + " WHERE length(text) > 1500", 1500, "chr(10)") + " UNION ALL SELECT doc_id, 0, md5(text) FROM documents WHERE length(text) <= 1500")
def split_long(spark, d):
    return docs(spark, d).select("doc_id", F.posexplode(G.split_long(F.col("text"))).alias("k", "t")).select("doc_id", "k", F.md5("t").alias("hash"))


@query("""WITH RECURSIVE s AS (SELECT doc_id, list_filter(string_split(text, chr(10)), lambda x: x <> '') AS ps FROM documents),
    r AS (SELECT doc_id, ps, 1 AS i, NULL::VARCHAR AS cur, 0 AS page, []::VARCHAR[] AS done FROM s
      UNION ALL
      SELECT doc_id, ps, i + 1, CASE WHEN length(own) < 80 THEN own END, p,
        CASE WHEN cur IS NOT NULL AND page <> p THEN [cur] ELSE [] END || CASE WHEN length(own) >= 80 THEN [own] ELSE [] END
      FROM (SELECT *, (i - 1) // 3 AS p, CASE WHEN cur IS NOT NULL AND page = (i - 1) // 3 THEN cur || chr(10) || ps[i] ELSE ps[i] END AS own FROM r WHERE i <= len(ps))),
    o AS (SELECT doc_id, i, generate_subscripts(done, 1) AS j, unnest(done) AS t FROM r UNION ALL SELECT doc_id, i + 1, 1, cur FROM r WHERE i = len(ps) + 1 AND cur IS NOT NULL)
    SELECT doc_id, (row_number() OVER (PARTITION BY doc_id ORDER BY i, j) - 1)::INT AS k, md5(t) AS hash FROM o""")
def merge_headings(spark, d):
    """Three lines make a page."""
    lines = F.transform(F.filter(F.split("text", "\n"), lambda x: x != ""), lambda x, i: F.struct(F.floor(i / 3).cast("int").alias("page"), x.alias("text")))
    return docs(spark, d).select("doc_id", F.posexplode(G.merge_headings(lines)).alias("k", "t")).select("doc_id", "k", F.md5("t.text").alias("hash"))


_STOP = "[" + ", ".join(f"'{w}'" for w in X.STOPWORDS) + "]"


def _sql_terms(x: str) -> str:
    return f"list_sort(list_distinct(list_filter(regexp_extract_all(lower({x}), '[a-z0-9]+'), lambda w: (length(w) >= 3 OR regexp_full_match(w, '[0-9]+')) AND NOT list_contains({_STOP}, w))))"


@query(f"SELECT doc_id, len({_sql_terms('text')}) AS n, md5(array_to_string({_sql_terms('text')}, ' ')) AS hash FROM documents")
def term_sets(spark, d):
    t = X.terms(F.col("text"))
    return docs(spark, d).select("doc_id", F.size(t).alias("n"), F.md5(F.array_join(t, " ")).alias("hash"))


_PAIRS = f"""s AS (SELECT conv_id, turn, {_sql_terms('text')} AS st FROM conversations WHERE role = 'user'),
    p AS (SELECT conv_id, turn, {_sql_terms('text')} AS pt FROM conversations WHERE role = 'assistant'),
    k AS (SELECT s.conv_id, s.turn, p.turn AS reply, len(list_intersect(st, pt)) / greatest(len(st), 1) AS keyword FROM s JOIN p ON p.conv_id = s.conv_id AND p.turn = s.turn + 1)"""


def _question_terms(spark, d):
    """Terms of each user turn with those of the answer to it."""
    c = table(spark, d, "conversations").select("conv_id", "turn", "role", X.terms(F.coalesce("text", F.lit(""))).alias("terms"))
    s = c.where("role = 'user'").select("conv_id", "turn", F.col("terms").alias("st"))
    p = c.where("role = 'assistant'").select("conv_id", F.col("turn").alias("reply"), (F.col("turn") - 1).alias("turn"), F.col("terms").alias("pt"))
    return s.join(p, ["conv_id", "turn"]).withColumn("keyword", R.keyword_overlap(F.col("st"), F.col("pt")))


@query(f"WITH {_PAIRS} SELECT conv_id, turn, reply, round(keyword, 6) AS keyword FROM k")
def keyword_overlap(spark, d):
    return _question_terms(spark, d).select("conv_id", "turn", "reply", F.round("keyword", 6).alias("keyword"))


@query(f"WITH {_PAIRS} SELECT conv_id, turn, round(0.7 * (1.0 / (1 + turn)) + 0.3 * keyword, 6) AS score FROM k")
def hybrid_score(spark, d):
    """The cosine's part is played by 1 / (1 + turn)."""
    score = R.hybrid_score(1.0 / (1 + F.col("turn")), F.col("keyword"))
    return _question_terms(spark, d).select("conv_id", "turn", F.round(score, 6).alias("score"))


def sql_fragments(quote: str) -> str:
    """The pieces of a quote around its dots that have two words or more, or the whole, longest first."""
    whole = f"replace(regexp_replace(regexp_replace({quote}, '^\\s+|\\s+$', '', 'g'), '^[\"''“”‘’]+|[\"''“”‘’]+$', '', 'g'), '…', '...')"
    good = f"list_filter(string_split({whole}, '...'), lambda x: len(regexp_extract_all(x, '{_WORD}')) >= 2)"
    return f"CASE WHEN len({good}) > 0 THEN list_transform(list_sort(list_transform({good}, lambda x, i: {{'n': -length(x), 'i': i, 't': x}})), lambda x: x.t) ELSE [{whole}] END"


def sql_hit(text: str, fragment: str) -> str:
    """What a text has of a fragment; empty if nothing."""
    words = f"regexp_extract_all({fragment}, '{_WORD}')"
    return f"CASE WHEN len({words}) = 0 THEN '' ELSE regexp_extract({text}, '(?i)' || array_to_string({words}, '[^\\p{{L}}\\p{{N}}_]*')) END"


_WORD = r"[\p{L}\p{N}_]+"


@query(f"""WITH w AS (SELECT doc_id, text, regexp_extract_all(text, '{_WORD}') AS ws FROM documents),
    q AS (SELECT doc_id, text, '“' || ws[3] || ' ' || lower(ws[4]) || '… ' || ws[6] || CASE WHEN doc_id % 2 = 1 THEN ' not-here' ELSE '' END || ' ' || ws[7] || ', ' || ws[8] || '” ' AS quote FROM w WHERE len(ws) >= 8),
    f AS (SELECT doc_id, text, fs, unnest(range(1, len(fs) + 1)) AS k FROM (SELECT doc_id, text, {sql_fragments('quote')} AS fs FROM q)),
    h AS (SELECT doc_id, text, k, {sql_hit('text', 'fs[k]')} AS hit FROM f),
    b AS (SELECT doc_id, arg_min(text, k) AS text, arg_min(hit, k) AS hit FROM h WHERE hit <> '' GROUP BY doc_id)
    SELECT doc_id, strpos(text, hit) - 1 AS start, strpos(text, hit) - 1 + length(hit) AS "end" FROM b""")
def quote_locate(spark, d):
    """Two pieces of a text around dots; the longer one is altered in every other text, so that the shorter one is found."""
    # The first eight words are all that is asked for; the rest of a text is not cut into words.
    first = F.regexp_extract("text", r"^(?:[^\p{L}\p{N}_]*+[\p{L}\p{N}_]++){8}", 0)
    q = once(docs(spark, d), ws=F.regexp_extract_all(first, F.lit(_WORD), F.lit(0))).where(F.size("ws") >= 8)
    w = lambda k: F.get("ws", F.lit(k - 1))
    extra = F.when(F.col("doc_id") % 2 == 1, " not-here").otherwise("")
    quote = F.concat(F.lit("“"), w(3), F.lit(" "), F.lower(w(4)), F.lit("… "), w(6), extra, F.lit(" "), w(7), F.lit(", "), w(8), F.lit("” "))
    q = once(q.select("doc_id", "text", quote.alias("quote")), squeezed=X.squeeze(F.col("text")))
    hit = once(q, hit=F.get(X.quote_hits(F.col("text"), F.col("quote"), F.col("squeezed")), F.lit(0))).where("hit is not null")
    start = F.position("hit", "text") - 1
    return hit.select("doc_id", start.alias("start"), (start + F.length("hit")).alias("end"))


_FLAT = _sql_clean("text")


@query(f"""WITH t AS (SELECT item_id, {_FLAT} AS t FROM benchmark), p AS (SELECT item_id, t, array_to_string(string_split(t, ' ')[1:8], ' ') AS p8, array_to_string(string_split(t, ' ')[1:4], ' ') AS p4 FROM t),
    c AS (SELECT {_FLAT} AS t FROM documents)
    SELECT item_id, count(*) FILTER (WHERE length(p8) >= 12 AND contains(' ' || c.t || ' ', ' ' || p8 || ' ')) AS n8, count(*) FILTER (WHERE length(p4) >= 12 AND contains(' ' || c.t || ' ', ' ' || p4 || ' ')) AS n4 FROM p, c GROUP BY item_id""")
def phrase_match(spark, d):
    """How many documents hold the first eight, and the first four, words of each item, found in one scan."""
    items = table(spark, d, "benchmark").select("item_id", F.coalesce("text", F.lit("")).alias("text"))
    spaced = docs(spark, d).select("doc_id", F.concat(F.lit(" "), X.clean(F.col("text")), F.lit(" ")).alias("text"))
    phrases = [items.select(F.struct("item_id", F.lit(n).alias("n")).alias("name_id"), F.concat(F.lit(" "), X.lead_phrase(F.col("text"), n), F.lit(" ")).alias("name")) for n in (8, 4)]
    found = find_names(spaced, phrases[0].unionByName(phrases[1])).groupBy(F.col("name_id.item_id").alias("item_id"))
    counts = found.agg(*(F.count_if(F.col("name_id.n") == n).alias(f"n{n}") for n in (8, 4)))
    return items.select("item_id").join(counts, "item_id", "left").select("item_id", F.coalesce("n8", F.lit(0)).alias("n8"), F.coalesce("n4", F.lit(0)).alias("n4"))


@query(f"""WITH t AS (SELECT item_id, {_FLAT} AS t FROM benchmark), p AS (SELECT item_id, lower(array_to_string(string_split(t, ' ')[1:8], ' ')) AS p8, lower(array_to_string(string_split(t, ' ')[1:4], ' ')) AS p4 FROM t),
    c AS (SELECT doc_id, lower({_FLAT}) AS t FROM documents),
    h AS (SELECT item_id, doc_id, CASE WHEN contains(c.t, p8) THEN 8 WHEN length(p4) >= 12 AND contains(c.t, p4) THEN 4 END AS words, c.t AS t, p8, p4 FROM p JOIN c ON length(p8) >= 12)
    SELECT item_id, doc_id, words, strpos(t, CASE WHEN words = 8 THEN p8 ELSE p4 END) - 1 AS start FROM h WHERE words IS NOT NULL""")
def lead_phrase_first(spark, d):
    """Where each document has the opening of an item: eight words, or else four, in one scan."""
    items = table(spark, d, "benchmark").select(F.col("item_id").alias("passage_id"), F.coalesce("text", F.lit("")).alias("text"))
    found = first_phrase(docs(spark, d).select("doc_id", "text"), items)
    return found.select(F.col("passage_id").alias("item_id"), "doc_id", "words", "start")


@query()
def quote_anywhere(spark, d):
    """Quotes of the items, altered in case and punctuation and some with a fragment that is nowhere, in all documents. A pattern for each pair is too slow in SQL; a test compares with one."""
    w = table(spark, d, "benchmark").select("item_id", F.regexp_extract_all("text", F.lit(_WORD), F.lit(0)).alias("ws")).where("size(ws) >= 9")
    some = lambda first, joint: F.array_join(F.slice("ws", first, 3), joint)
    lead = F.when(F.col("item_id") % 3 == 0, "no such words here and there at all in any text ... ").otherwise("")
    tail = F.when(F.col("item_id") % 2 == 0, F.concat(F.lit("…"), some(7, " "))).otherwise("")
    quote = F.concat(F.lit('"'), lead, F.upper(F.get("ws", F.lit(1))), F.lit(", "), some(3, " – "), tail, F.lit('"'))
    found = quotes_in(docs(spark, d), w.select(F.col("item_id").alias("quote_id"), quote.alias("quote")))
    return found.withColumnRenamed("quote_id", "item_id")


_PATHS = "SELECT page_id, regexp_replace(url, '^https?://', '') AS path FROM pages"


def paths(spark, d):
    return table(spark, d, "pages").select("page_id", F.regexp_replace("url", "^https?://", "").alias("path"))


@query(f"SELECT page_id, substr(sha1(path), 1, 16) AS id FROM ({_PATHS})")
def source_ids(spark, d):
    return paths(spark, d).select("page_id", X.source_id(F.col("path")).alias("id"))


@query(rf"""SELECT page_id, CASE WHEN ends_with(p, '.pdf') THEN 'pdf' WHEN regexp_matches(p, '\.xlsx?$') THEN 'spreadsheet' WHEN ends_with(p, '.csv') THEN 'csv' ELSE 'text' END AS kind
    FROM (SELECT page_id, lower(path) || CASE page_id % 4 WHEN 0 THEN '.pdf' WHEN 1 THEN '.xlsx' WHEN 2 THEN '.csv' ELSE '.txt' END AS p FROM ({_PATHS}))""")
def source_kind(spark, d):
    ext = F.element_at(F.array(*map(F.lit, (".pdf", ".XLSX", ".csv", ".txt"))), (F.col("page_id") % 4 + 1).cast("int"))
    return paths(spark, d).select("page_id", X.source_kind(F.concat("path", ext)).alias("kind"))


@query(f"SELECT page_id, regexp_extract(path, '([^/\\\\]*)$', 1) AS name FROM ({_PATHS})")
def source_name(spark, d):
    return paths(spark, d).select("page_id", X.source_name(F.col("path")).alias("name"))


@query(f"""SELECT page_id, CASE WHEN n = '' THEN 'document' ELSE n END AS name FROM (SELECT page_id, substr(regexp_extract(path, '([^/]*)$', 1), 1, 150) AS n FROM ({_PATHS}))""")
def display_name(spark, d):
    return paths(spark, d).select("page_id", X.display_name(F.col("path")).alias("name"))


@query("SELECT l_orderkey, l_linenumber, CASE WHEN l_linenumber % 3 > 0 THEN 'Page ' || (l_linenumber % 3) WHEN l_linenumber < 6 THEN 'Row ' || l_orderkey ELSE '-' END AS label FROM lineitem")
def location_label(spark, d):
    row = F.when(F.col("l_linenumber") < 6, F.col("l_orderkey"))
    return table(spark, d, "lineitem").select("l_orderkey", "l_linenumber", X.location(F.col("l_linenumber") % 3, row).alias("label"))


@query("SELECT doc_id, CASE WHEN length(text) > 200 THEN substr(text, 1, 200) || '...' ELSE text END AS preview FROM documents")
def truncate_text(spark, d):
    return docs(spark, d).select("doc_id", X.shorten(F.col("text"), 200).alias("preview"))


_LABELS = {"alpha": "(?i)th[ae]", "beta": "[çêÇÊ]", "gamma": "(?i)ung|sch", "delta": "[Cc]i[óÓ]n|[Ll]l"}


@query(f"""WITH f AS (SELECT doc_id, list_filter([{', '.join(f"CASE WHEN regexp_matches(text, '{p}') THEN '{k}' END" for k, p in _LABELS.items())}], lambda x: x IS NOT NULL) AS hits FROM documents)
    SELECT doc_id, CASE WHEN len(hits) = 1 THEN hits[1] END AS label FROM f""")
def detect_label(spark, d):
    return docs(spark, d).select("doc_id", X.detect_label(F.col("text"), _LABELS).alias("label"))


@query("SELECT doc_id, md5(regexp_replace(translate(text, chr(160) || chr(8239) || chr(8208) || chr(8209), '  --'), '\\s*<br\\s*/?>\\s*', '; ', 'gi')) AS hash FROM documents")
def normalize_text(spark, d):
    return docs(spark, d).select("doc_id", F.md5(X.normalize(F.col("text"))).alias("hash"))


@query(r"""SELECT conv_id, turn, starts_with(upper(regexp_replace(trim(t), '^[`*_ .]+|[`*_ .]+$', '', 'g')), 'INSUFFICIENT_CONTEXT') AS insufficient
    FROM (SELECT conv_id, turn, CASE WHEN turn % 3 = 1 THEN ' **Insufficient_Context' || text || '**' ELSE text END AS t FROM conversations)""")
def sentinel_detect(spark, d):
    c = table(spark, d, "conversations").withColumn("t", F.when(F.col("turn") % 3 == 1, F.concat(F.lit(" **Insufficient_Context"), "text", F.lit("**"))).otherwise(F.col("text")))
    return c.select("conv_id", "turn", X.is_insufficient(F.col("t")).alias("insufficient"))


@query("SELECT o_orderkey, CASE WHEN p IN ('critical', 'severe', 'high') THEN 'high' WHEN p IN ('minor', 'info', 'low') THEN 'low' ELSE 'medium' END AS severity FROM (SELECT o_orderkey, lower(trim(substr(o_orderpriority, 3))) AS p FROM orders)")
def severity_normalize(spark, d):
    return table(spark, d, "orders").select("o_orderkey", X.severity(F.substring("o_orderpriority", 3, 100)).alias("severity"))


@query("SELECT event_id, (regexp_extract('```json ' || props || ' ```', '(?s)(\\{.*\\})', 1)::JSON ->> 'k')::INT AS k FROM events".replace("\\\\", "\\"))
def json_extract(spark, d):
    body = X.json_body(F.concat(F.lit("```json "), "props", F.lit(" ```")))
    return table(spark, d, "events").select("event_id", F.get_json_object(body, "$.k").cast("int").alias("k"))


@query("SELECT event_id, round(greatest(least(value / 10, 3.0), 0.5), 6) AS zoom FROM events")
def clamp_value(spark, d):
    return table(spark, d, "events").select("event_id", F.round(X.clamp(F.col("value") / 10, 0.5, 3.0), 6).alias("zoom"))


@query("SELECT p_partkey, CASE WHEN p_type <> '' AND NOT contains(lower(s), lower(p_type)) THEN s || ' - ' || p_type ELSE s END AS label FROM (SELECT p_partkey, p_type, replace(replace(p_name, ' ', '_') || CASE WHEN p_partkey % 3 = 0 THEN '_' || p_type ELSE '' END, '_', ' ') AS s FROM part)")
def dataset_label(spark, d):
    stem = F.concat(F.replace("p_name", F.lit(" "), F.lit("_")), F.when(F.col("p_partkey") % 3 == 0, F.concat(F.lit("_"), "p_type")).otherwise(""))
    return table(spark, d, "part").select("p_partkey", X.dataset_label(stem, F.col("p_type")).alias("label"))


_SEGMENTS = {"HOUSEHOLD": "Homes", "MACHINERY": "Machines", "BUILDING": "Buildings"}


@query("SELECT c_custkey, CASE c_mktsegment WHEN 'HOUSEHOLD' THEN 'Homes' WHEN 'MACHINERY' THEN 'Machines' WHEN 'BUILDING' THEN 'Buildings' ELSE c_mktsegment END AS name FROM customer")
def map_lookup(spark, d):
    names = S.header_names(F.array("c_mktsegment"), _SEGMENTS)
    return table(spark, d, "customer").select("c_custkey", F.get(names, F.lit(0)).alias("name"))


@query("SELECT doc_id, CASE WHEN n < 1024 THEN n || ' B' WHEN n < 1048576 THEN printf('%.1f KB', round(n / 1024, 1)) ELSE printf('%.1f MB', round(n / 1048576, 1)) END AS label FROM (SELECT doc_id, strlen(text) * 17 AS n FROM documents)")
def size_label(spark, d):
    return docs(spark, d).select("doc_id", X.size_label(F.octet_length("text").cast("long") * 17).alias("label"))


_ERRORS = {"error": "The service failed. Try again.", "purchase": "The request was refused."}


@query("SELECT event_id, CASE event_type WHEN 'error' THEN 'The service failed. Try again.' WHEN 'purchase' THEN 'The request was refused.' ELSE 'Something went wrong.' END AS message FROM events")
def error_classify(spark, d):
    table_ = F.create_map(*(F.lit(x) for kv in _ERRORS.items() for x in kv))
    return table(spark, d, "events").select("event_id", F.coalesce(F.element_at(table_, F.col("event_type")), F.lit("Something went wrong.")).alias("message"))


@query(r"""WITH l AS (SELECT conv_id, string_agg('[S' || (turn + 1) || '] ' || text, chr(10) ORDER BY turn) AS prompt FROM conversations GROUP BY conv_id)
    SELECT conv_id, md5(prompt) AS hash FROM l""")
def prompt_sections(spark, d):
    line = F.concat(F.lit("[S"), F.col("turn") + 1, F.lit("] "), F.col("text"))
    parts = F.transform(F.array_sort(F.collect_list(F.struct("turn", line.alias("t")))), lambda p: p["t"])
    return table(spark, d, "conversations").groupBy("conv_id").agg(F.md5(F.array_join(parts, "\n")).alias("hash"))


_CITED = r"""WITH a AS (SELECT conv_id, turn, text || ' [src' || (conv_id % 25) || ', p. 3] end [note]' || chr(10) || ' ' || chr(10) || '*Source: 【Passage 2】.*' || chr(10) || chr(10) || 'More' || chr(160) || 'of it [passage  ' || (turn % 5) || '; src' || ((conv_id + 1) % 25) || '] and [Passage 9].' AS t
        FROM conversations WHERE role = 'assistant'),
    c AS (SELECT DISTINCT conv_id, o AS ordinal, 'src' || ((conv_id + o) % 25) AS name, (conv_id + o) % 25 AS source_id FROM conversations, range(0, 4) r(o)),
    b AS (SELECT conv_id, turn, unnest(range(len(bs))) AS paragraph, unnest(bs) AS block FROM (SELECT conv_id, turn, string_split_regex(regexp_replace(translate(t, chr(160), ' '), '^\s+|\s+$', '', 'g'), '\n\s*\n') AS bs FROM a)),
    m AS (SELECT DISTINCT conv_id, turn, paragraph, mark, regexp_extract(mark, '[\[【](.*)[\]】]', 1) AS inside FROM (SELECT conv_id, turn, paragraph, unnest(regexp_extract_all(block, '[ \t]*[\[【][^\[\]【】]+[\]】]')) AS mark FROM b)),
    h AS (SELECT m.*, source_id FROM m JOIN c USING (conv_id) WHERE contains(inside, name) OR list_contains(regexp_extract_all(inside, '(?i)passage\s+(\d+)', 1), ordinal::VARCHAR)),
    k AS (SELECT conv_id, turn, paragraph, list_sort(list_distinct(list(source_id))) AS cites, list_sort(list_distinct(list(mark))) AS marks FROM h GROUP BY ALL),
    x AS (SELECT b.conv_id, b.turn, b.paragraph, regexp_replace(list_reduce([block] || list_transform(list_sort(list_transform(coalesce(marks, []), lambda q: {'n': -length(q), 'm': q})), lambda q: q.m), lambda t, q: replace(t, q, '')), '^\s+|\s+$', '', 'g') AS text, coalesce(cites, []) AS cites
        FROM b LEFT JOIN k USING (conv_id, turn, paragraph)),
    v AS (SELECT * FROM x WHERE text <> '' AND NOT regexp_matches(text, '(?i)^[^\p{L}\p{N}_]*(sources?|citations?)[^\p{L}\p{N}_]*$'))"""


def _cited(spark, d):
    """Answers with marks of a source by name, of passages by ordinal, of both and of neither, and a label that only a mark fills."""
    c = table(spark, d, "conversations")
    t = F.concat(
        "text", F.lit(" [src"), (F.col("conv_id") % 25).cast("string"), F.lit(", p. 3] end [note]\n \n*Source: 【Passage 2】.*\n\nMore of it [passage  "), (F.col("turn") % 5).cast("string"),
        F.lit("; src"), ((F.col("conv_id") + 1) % 25).cast("string"), F.lit("] and [Passage 9]."),
    )
    answers = c.where("role = 'assistant'").select("conv_id", "turn", t.alias("answer"))
    o = F.col("ordinal")
    made = answers.select("conv_id", "turn", F.explode(F.array(*map(F.lit, range(4)))).alias("ordinal"))
    chunks = made.select("conv_id", "turn", "ordinal", F.concat(F.lit("src"), (F.col("conv_id") + o) % 25).alias("name"), ((F.col("conv_id") + o) % 25).alias("source_id"))
    return C.cited_paragraphs(answers, chunks, ["conv_id", "turn"])


@query(_CITED + " SELECT conv_id, turn, paragraph::INT AS paragraph, md5(text) AS hash, array_to_string(cites, ',') AS cites FROM v")
def paragraph_citations(spark, d):
    return _cited(spark, d).select("conv_id", "turn", "paragraph", F.md5("text").alias("hash"), F.array_join(F.transform("cites", lambda x: x.cast("string")), ",").alias("cites"))


@query(_CITED + """, n AS (SELECT *, row_number() OVER (PARTITION BY conv_id, turn ORDER BY paragraph) AS n FROM v)
    SELECT conv_id, turn, md5(max(text) FILTER (WHERE n = 1)) AS headline, md5(coalesce(string_agg(text, chr(10) || chr(10) ORDER BY n) FILTER (WHERE n > 1), '')) AS detail FROM n GROUP BY conv_id, turn""")
def headline_detail(spark, d):
    """The first paragraph, and the others, of an answer without its citations."""
    ps = F.transform(F.array_sort(F.collect_list(F.struct("paragraph", "text"))), lambda p: p["text"])
    g = _cited(spark, d).groupBy("conv_id", "turn").agg(ps.alias("ps"))
    return g.select("conv_id", "turn", F.md5(F.get("ps", F.lit(0))).alias("headline"), F.md5(F.array_join(F.slice("ps", F.lit(2), F.size("ps")), "\n\n")).alias("detail"))


@query("""WITH n AS (SELECT *, row_number() OVER (PARTITION BY source ORDER BY doc_id) AS place FROM documents),
    t AS (SELECT doc_id, source, place, '--- Passage ' || place || '  [' || source || ', ' || lang || '] ---' || chr(10) || CASE WHEN length(text) > 2500 THEN substr(text, 1, 2500) || ' ...' ELSE text END AS part FROM n),
    c AS (SELECT doc_id, source, place, sum(length(part)) OVER (PARTITION BY source ORDER BY doc_id) AS total FROM t)
    SELECT doc_id, source, place, total::BIGINT AS total FROM c WHERE place = 1 OR total <= 18000""")
def context_budget(spark, d):
    label = R.passage_label(F.col("source"), F.col("lang"))
    kept = R.context_budget(docs(spark, d).select("doc_id", "source", "lang", "text"), "source", "doc_id", "text", label)
    return kept.select("doc_id", "source", "place", F.col("total").cast("long").alias("total"))


@query("""WITH m AS (SELECT conv_id, turn, text, role, CASE WHEN role = lag(role) OVER w THEN 0 ELSE 1 END AS c FROM (SELECT *, turn // 2 AS r2 FROM conversations) WINDOW w AS (PARTITION BY conv_id ORDER BY turn)),
    g AS (SELECT *, sum(c) OVER (PARTITION BY conv_id ORDER BY turn) AS run FROM m)
    SELECT conv_id, run::BIGINT AS run, role, md5(string_agg(text, ' ' ORDER BY turn)) AS hash FROM g GROUP BY conv_id, run, role""")
def merge_blocks(spark, d):
    """Turns of one role in a row, the role playing the page."""
    merged = G.merge_blocks(table(spark, d, "conversations"), "conv_id", "turn", "role", "text")
    return merged.select("conv_id", F.col("run").cast("long").alias("run"), "role", F.md5("text").alias("hash"))


_RAW = """(SELECT l_orderkey AS key, l_linenumber AS line, l_partkey % 100 AS s, l_partkey % 100 + l_quantity::INT AS e FROM lineitem)"""
_MERGED = f"""WITH r AS (SELECT key, line, s, e, CASE WHEN s >= max(e) OVER (PARTITION BY key ORDER BY s, e ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) THEN 1 ELSE 0 END AS f FROM {_RAW}),
    i AS (SELECT *, sum(f) OVER (PARTITION BY key ORDER BY s, e ROWS UNBOUNDED PRECEDING) AS g FROM r),
    m AS (SELECT key, min(s) AS start, max(e) AS stop, array_to_string(list(line ORDER BY s, line), ',') AS names FROM i GROUP BY key, g)"""


def _merged(spark, d):
    r = table(spark, d, "lineitem").select(
        F.col("l_orderkey").alias("key"), F.col("l_linenumber").alias("line"), (F.col("l_partkey") % 100).alias("start"), (F.col("l_partkey") % 100 + F.col("l_quantity").cast("int")).alias("stop")
    )
    return G.merge_intervals(r, "key", "start", "stop", "line")


@query(f"{_MERGED} SELECT key, start, stop, names FROM m")
def interval_merge(spark, d):
    return _merged(spark, d).select("key", "start", "stop", F.array_join(F.transform("names", lambda x: x.cast("string")), ",").alias("names"))


@query(f"""{_MERGED}, t AS (SELECT key, repeat('a' || (key % 7), 70) AS text FROM (SELECT DISTINCT key FROM m)),
    c AS (SELECT key, start, stop, names, coalesce(lag(stop) OVER w, 0) AS before, lead(start) OVER w IS NULL AS last FROM m WINDOW w AS (PARTITION BY key ORDER BY start)),
    p AS (SELECT key, 2 * start AS o, substr(text, before::INT + 1, (start - before)::INT) AS run, '' AS names FROM c JOIN t USING (key) WHERE start > before
      UNION ALL SELECT key, 2 * start + 1, substr(text, start::INT + 1, (stop - start)::INT), names FROM c JOIN t USING (key)
      UNION ALL SELECT key, 1000, substr(text, stop::INT + 1), '' FROM c JOIN t USING (key) WHERE last AND stop < length(text))
    SELECT key, (row_number() OVER (PARTITION BY key ORDER BY o) - 1)::INT AS pos, run, names FROM p""")
def text_segments(spark, d):
    """A text's plain and marked runs, the merged intervals being its marks."""
    marks = F.array_sort(F.collect_list(F.struct("start", F.col("stop").alias("end"), "names")))
    g = _merged(spark, d).groupBy("key").agg(marks.alias("marks")).withColumn("text", F.repeat(F.concat(F.lit("a"), F.col("key") % 7), F.lit(70)))
    runs = g.select("key", F.posexplode(G.segments(F.col("text"), F.col("marks"))).alias("pos", "r"))
    names = F.array_join(F.transform("r.names", lambda x: x.cast("string")), ",")
    return runs.select("key", "pos", F.col("r.text").alias("run"), F.coalesce(names, F.lit("")).alias("names"))


@query("""WITH RECURSIVE s AS (SELECT conv_id, list(length(text)::BIGINT ORDER BY turn) AS ls FROM conversations GROUP BY conv_id),
    r AS (SELECT conv_id, ls, 0 AS i, 1 AS n, 0::BIGINT AS total FROM s UNION ALL
      SELECT conv_id, ls, i + 1, CASE WHEN total > 0 AND total + ls[i + 1] > 900 THEN n + 1 ELSE n END, CASE WHEN total > 0 AND total + ls[i + 1] > 900 THEN ls[i + 1] ELSE total + ls[i + 1] END FROM r WHERE i < len(ls))
    SELECT conv_id, (count(*) FILTER (WHERE n <= 3))::INT AS analysed, count(*)::INT AS total, least(max(n), 3)::INT AS n_batches, count(*) FILTER (WHERE n <= 3) < count(*) AS truncated FROM r WHERE i > 0 GROUP BY conv_id""")
def batch_sections(spark, d):
    return G.batch_sections(table(spark, d, "conversations"), "conv_id", "turn", "text", most=900)


@query("SELECT row_number() OVER (ORDER BY source, doc_id) - 1 AS id, source, doc_id, md5(text) AS hash FROM documents")
def finalize_ids(spark, d):
    rows = docs(spark, d).select("source", "doc_id", F.md5("text").alias("hash"))
    return G.number_rows(rows, ["source", "doc_id"]).select("id", "source", "doc_id", "hash")


_QUESTIONS = ("What does Norway produce?", "british rigs and UKCS wells", "Texas", "gas price and indian fields", "nothing named", "the U.S. market", "Brent oil prices")


@query("SELECT event_id, CASE event_id % 7 WHEN 0 THEN 'Norway' WHEN 1 THEN 'UK' WHEN 2 THEN 'US' WHEN 6 THEN 'Global' END AS country FROM events")
def detect_country(spark, d):
    """The one country that a question names. The dots of "the U.S. market" are followed by a space, so no word ends there, and that question names none."""
    q = F.element_at(F.array(*map(F.lit, _QUESTIONS)), (F.col("event_id") % 7 + 1).cast("int"))
    return table(spark, d, "events").select("event_id", X.detect_country(q).alias("country"))


@query("SELECT event_id, round(value * 100, 1)::DECIMAL(38, 1)::VARCHAR || '%' AS label FROM events")
def score_percent(spark, d):
    return table(spark, d, "events").select("event_id", X.score_percent(F.col("value")).alias("label"))
