"""Catalogues of sources: counts, facets, modal values, citations."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from loomspan.functions.text import CITATION, CITED_PASSAGE, EMPTY_LABEL, answer_paragraphs, normalize, shorten, source_id, source_name, strip
from loomspan.operators.names import find_names
from loomspan.operators.rank import first_of


def count_by(rows: DataFrame, *keys: str) -> DataFrame:
    return rows.groupBy(*keys).agg(F.count("*").alias("n"))


def facet_counts(rows: DataFrame, key: str, other: str = "Other") -> DataFrame:
    """Rows per value; NULL and empty count as other."""
    value = F.coalesce(F.nullif(F.col(key).cast("string"), F.lit("")), F.lit(other))
    return rows.groupBy(value.alias("facet")).agg(F.count("*").alias("n"))


def modal_value(rows: DataFrame, key: str, value: str, pos: str) -> DataFrame:
    """(key, n, value): rows of each key and its most frequent value; of ties the first seen."""
    counts = rows.groupBy(key, value).agg(F.count("*").alias("c"), F.min(pos).alias("seen"))
    total = Window.partitionBy(key)
    return first_of(counts.withColumn("n", F.sum("c").over(total)), [key], [F.desc("c"), F.col("seen")]).select(key, "n", value)


def build_sources(chunks: DataFrame, group: str, name: str, page: str, pos: str, unit: str, excerpt: str) -> DataFrame:
    """(group, source, id, pages, unit, n): distinct names in first-seen order, with sorted pages and the last unit."""
    agg = chunks.groupBy(group, name).agg(
        F.min(pos).alias("first"), F.array_sort(F.collect_set(F.when(F.col(page) > 0, F.col(page)))).alias("pages"), F.max_by(unit, pos).alias("unit"), F.count(excerpt).alias("n")
    )
    return agg.withColumn("id", F.row_number().over(Window.partitionBy(group).orderBy("first"))).drop("first")


#: Characters of a short name and of an excerpt.
SHORT_NAME, EXCERPT = 18, 1500


def sources_of(chunks: DataFrame, keys: list[str]) -> DataFrame:
    """(keys, id, name, short_name, source_id, country, unit, pages, excerpts) of each distinct file that an answer's chunks come from, numbered in the order of retrieval.

    chunks(keys, pos, chunk_id, source_file, country, page, row, sheet, text), a few an answer. A chunk lies on its page if that is
    positive, else in its row, else nowhere; the unit is that of the last chunk with a place, `pg.` without one.
    """
    name = F.when(F.coalesce(F.col("source_file"), F.lit("")) != "", source_name(F.col("source_file"))).otherwise("unknown")
    on_page, in_row = F.coalesce(F.col("page") > 0, F.lit(False)), F.coalesce(F.col("row") != 0, F.lit(False))
    unit = F.when(on_page, "pg.").when(in_row, "row")
    number = F.when(on_page, F.col("page")).when(in_row, F.col("row")).cast("int")
    placed = chunks.withColumns({"name": name, "unit": unit, "number": number})
    excerpt = F.struct(
        F.col("pos"), F.col("chunk_id").cast("string").alias("chunk_id"), F.when(F.col("unit") == "pg.", F.col("number")).alias("page"), F.when(F.col("unit") == "row", F.col("number")).alias("row"),
        F.col("sheet"), shorten(F.col("text"), EXCERPT, " ...").alias("text"),
    )
    agg = placed.groupBy(*keys, "name").agg(
        F.min("pos").alias("first"), F.min_by("source_file", "pos").alias("file"), F.min_by("country", "pos").alias("country"), F.coalesce(F.max_by("unit", F.when(F.col("unit").isNotNull(), F.col("pos"))), F.lit("pg.")).alias("unit"),
        F.array_sort(F.collect_set("number")).alias("pages"), F.array_sort(F.collect_list(excerpt)).alias("excerpts"),
    )
    excerpts = F.transform("excerpts", lambda e: e.dropFields("pos"))
    made = agg.withColumn("id", F.row_number().over(Window.partitionBy(*keys).orderBy("first", "name")))
    file_id = F.when(F.col("file") != "", source_id(F.col("file")))
    return made.select(*keys, "id", "name", shorten(F.col("name"), SHORT_NAME).alias("short_name"), file_id.alias("source_id"), "country", "unit", "pages", excerpts.alias("excerpts"))


def highlight(answers: DataFrame, assets: DataFrame, answer: str = "answer") -> DataFrame:
    """(columns of answers without the answer, asset_id): the assets(asset_id, name) whose id stands in an answer as a word, or whose name does in any case."""
    rows = answers.withColumn(answer, normalize(F.col(answer)))
    by_id = find_names(rows, assets.select(F.col("asset_id").alias("name_id"), F.col("asset_id").cast("string").alias("name")), text=answer, bordered=True)
    by_name = find_names(rows, assets.select(F.col("asset_id").alias("name_id"), "name"), text=answer, fold=True)
    return by_id.unionByName(by_name).drop("start").distinct().withColumnRenamed("name_id", "asset_id")


def resolve_marks(marks: DataFrame, sources: DataFrame, mark: str = "mark") -> DataFrame:
    """(columns of marks without the mark, cited, how): the sources(ordinal, name, source_id) that a mark names, by holding the name or `Passage n` with the ordinal."""
    kept = [c for c in marks.columns if c != mark]
    by_name = find_names(marks, sources.select(F.col("source_id").alias("name_id"), "name"), text=mark).select(*kept, F.col("name_id").alias("cited"), F.lit("name").alias("how"))
    numbers = F.array_distinct(F.regexp_extract_all(mark, F.lit(CITED_PASSAGE), F.lit(1)))
    placed = marks.select(*kept, F.explode(numbers).alias("n")).withColumn("ordinal", F.expr("try_cast(n AS INT)"))
    by_ordinal = placed.join(sources.select("ordinal", "source_id"), "ordinal").select(*kept, F.col("source_id").alias("cited"), F.lit("ordinal").alias("how"))
    return by_name.unionByName(by_ordinal).distinct()


def build_refs(chunks: DataFrame, group: str, name: str, place: str, pos: str) -> DataFrame:
    """The first of each (name, place), renumbered from 1."""
    first = first_of(chunks, [group, name, place], [F.col(pos)])
    return first.withColumn("ref", F.row_number().over(Window.partitionBy(group).orderBy(pos))).select(group, name, place, "ref")


def catalog(registry: DataFrame, stats: DataFrame, key: str) -> DataFrame:
    """All registered sources with their chunk counts, 0 if they have none."""
    return registry.join(stats, key, "left").withColumn("chunks", F.coalesce("chunks", F.lit(0)))


def centroid(rows: DataFrame, key: str, lat: str, lng: str) -> DataFrame:
    """Mean place of the points of each key and a zoom: 9 for one point, 6 for more."""
    return rows.groupBy(key).agg(F.avg(lat).alias("lat"), F.avg(lng).alias("lng"), F.when(F.count("*") == 1, 9).otherwise(6).alias("zoom"))


def contains_fold(text: Column, part: str) -> Column:
    return F.contains(F.lower(text), F.lit(part.lower()))


def cited_paragraphs(answers: DataFrame, chunks: DataFrame, key: list[str]) -> DataFrame:
    """(key, paragraph, text, cites): an answer's paragraphs, each with the ids of the sources that its marks name.

    answers(key, answer), chunks(key, ordinal, name, source_id): what the answer was made from, a few
    rows a key. A mark names a source by holding its name, or a passage by its ordinal; marks that name
    something are cut, others stay, and a label left without its citation goes.
    """
    block = answers.select(*key, F.posexplode(answer_paragraphs(F.col("answer"))).alias("paragraph", "block"))
    marks = F.array_distinct(F.regexp_extract_all("block", F.lit(CITATION), F.lit(0)))
    mark = block.select(*key, "paragraph", F.explode(marks).alias("mark"))
    inside = F.regexp_extract("mark", CITATION, 1)
    ordinals = F.transform(F.regexp_extract_all(inside, F.lit(CITED_PASSAGE), F.lit(1)), lambda x: x.try_cast("int"))
    mark = mark.withColumn("inside", inside).withColumn("ordinals", ordinals)
    hit = mark.join(chunks, key).where(F.contains("inside", F.col("name")) | F.array_contains("ordinals", F.col("ordinal")))
    found = hit.groupBy(*key, "paragraph").agg(F.collect_set("mark").alias("marks"), F.array_sort(F.collect_set("source_id")).alias("cites"))
    out = block.join(found, [*key, "paragraph"], "left")
    longest = F.array_sort(F.transform("marks", lambda m: F.struct((-F.length(m)).alias("n"), m.alias("m"))))
    cut = F.aggregate(longest, F.col("block"), lambda t, m: F.replace(t, m["m"], F.lit("")))
    text = strip(F.when(F.col("marks").isNull(), F.col("block")).otherwise(cut))
    none = F.array().cast(found.schema["cites"].dataType)
    out = out.select(*key, "paragraph", text.alias("text"), F.coalesce("cites", none).alias("cites"))
    return out.where((F.col("text") != "") & ~F.col("text").rlike(EMPTY_LABEL))


def split_payload(rows: DataFrame, known: dict[str, object]) -> DataFrame:
    """(known columns, extra): fixed fields with what stands for a missing one, and all others by name in a map of texts."""
    fields = [F.coalesce(F.col(c), F.lit(v)).alias(c) if c in rows.columns else F.lit(v).alias(c) for c, v in known.items()]
    others = [c for c in rows.columns if c not in known]
    pairs = [x for c in others for x in (F.lit(c), F.col(f"`{c}`").cast("string"))]
    extra = F.create_map(*pairs) if pairs else F.create_map()
    return rows.select(*fields, extra.cast("map<string,string>").alias("extra"))


def browse(rows: DataFrame, country: str | None = None, source: str | None = None, search: str | None = None) -> tuple[DataFrame, DataFrame]:
    """What a listing shows of rows(country, source_file, text), and what its summary counts: filtered rows if a country or source is given, else all."""
    shown = rows
    if country:
        shown = shown.where(F.lower("country") == country.lower())
    if source:
        shown = shown.where(contains_fold(F.col("source_file"), source))
    if search:
        shown = shown.where(contains_fold(F.col("text"), search))
    return shown, shown if country or source else rows


def texts_of(requests: DataFrame, ids: str, chunks: DataFrame) -> DataFrame:
    """(request columns, id, text): the chunks(id, text) whose ids a request lists; unknown ids give nothing."""
    asked = requests.withColumn("id", F.explode(F.array_distinct(ids))).drop(ids)
    return asked.join(chunks.select("id", "text"), "id")


def cited(sources: DataFrame, cites: DataFrame, keys: list[str]) -> DataFrame:
    """The sources that a citation names."""
    return sources.join(cites.select(keys), keys, "left_semi")
