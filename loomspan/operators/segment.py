"""Cutting and joining of text units: greedy packing, windows of words, islands, intervals."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from loomspan.config import BATCH_CHARS, CHUNK_MIN_CHARS, CHUNK_OVERLAP, CHUNK_WORDS, HEADING_SHORT, MAX_BATCHES, PASSAGE_PACK, SECTION_LONG
from loomspan.functions.text import strip, token_approx
from loomspan.sources.snapshot import scratch


def pack(pieces: Column, most: int, joint: str) -> Column:
    """Pieces joined in order while a joined one has at most ``most`` characters. Empty ones stay inside a joined one."""
    empty = F.array().cast("array<string>")
    start = F.struct(empty.alias("out"), F.lit("").alias("cur"))

    def step(s: Column, x: Column) -> Column:
        fits = F.length(s["cur"]) + len(joint) + F.length(x) <= most
        return (
            F.when(s["cur"] == "", F.struct(s["out"].alias("out"), x.alias("cur")))
            .when(fits, F.struct(s["out"].alias("out"), F.concat(s["cur"], F.lit(joint), x).alias("cur")))
            .otherwise(F.struct(F.array_append(s["out"], s["cur"]).alias("out"), x.alias("cur")))
        )

    return F.aggregate(pieces, start, step, lambda s: F.when(s["cur"] == "", s["out"]).otherwise(F.array_append(s["out"], s["cur"])))


def passages(text: Column, most: int = PASSAGE_PACK) -> Column:
    """Sentences packed to passages."""
    pieces = F.filter(F.transform(F.split(text, r"(?<=[.;:])\s+|\n+"), strip), lambda x: x != "")
    return pack(pieces, most, " ")


def split_long(text: Column, most: int = SECTION_LONG) -> Column:
    """A text over ``most`` characters, packed from its lines, blank ones included; a shorter one alone."""
    return F.when(F.length(text) > most, pack(F.split(text, "\n"), most, "\n")).otherwise(F.array(text))


def merge_headings(pieces: Column, short: int = HEADING_SHORT) -> Column:
    """Pieces (page, text): what is short, also with a short one before it, goes before the next piece of its page, or else stands alone."""
    empty = F.array().cast("array<struct<page:int,text:string>>")
    none = F.lit(None).cast("struct<page:int,text:string>")
    start = F.struct(empty.alias("out"), none.alias("cur"))

    def step(s: Column, x: Column) -> Column:
        same = s["cur"].isNotNull() & s["cur"]["page"].eqNullSafe(x["page"])
        own = F.struct(x["page"].cast("int").alias("page"), F.when(same, F.concat(s["cur"]["text"], F.lit("\n"), x["text"])).otherwise(x["text"]).alias("text"))
        out = F.when(s["cur"].isNotNull() & ~same, F.array_append(s["out"], s["cur"])).otherwise(s["out"])
        return F.when(F.length(own["text"]) < short, F.struct(out.alias("out"), own.alias("cur"))).otherwise(F.struct(F.array_append(out, own).alias("out"), none.alias("cur")))

    return F.aggregate(pieces, start, step, lambda s: F.when(s["cur"].isNull(), s["out"]).otherwise(F.array_append(s["out"], s["cur"])))


def word_windows(text: Column, size: int = CHUNK_WORDS, overlap: int = CHUNK_OVERLAP) -> Column:
    """Windows of words, ``size - overlap`` apart, until one reaches the end."""
    words = F.split(strip(text), r"\s+")
    step = max(1, size - overlap)
    last = F.greatest(F.lit(0), F.ceil((F.size(words) - size) / step)).cast("int")
    return F.transform(F.sequence(F.lit(0), last), lambda k: F.array_join(F.slice(words, k * step + 1, F.lit(size)), " "))


def runs(words: Column, k: int) -> Column:
    """All runs of k words of an array of at least k."""
    return F.transform(F.sequence(F.lit(1), F.size(words) - k + 1), lambda i: F.array_join(F.slice(words, i, F.lit(k)), " "))


def chunks(text: Column, size: int = CHUNK_WORDS, overlap: int = CHUNK_OVERLAP, least: int = CHUNK_MIN_CHARS) -> Column:
    """The text whole if it is about ``size`` tokens at most, else its windows; short ones go."""
    pieces = F.when(token_approx(text) <= size, F.array(text)).otherwise(word_windows(text, size, overlap))
    return F.filter(pieces, lambda x: F.length(x) >= least)


def merge_blocks(blocks: DataFrame, key: str, order: str, page: str, text: str) -> DataFrame:
    """Runs of blocks on one page joined by spaces: (key, run, page, text)."""
    w = Window.partitionBy(key).orderBy(order)
    changed = F.coalesce((F.col(page) != F.lag(page).over(w)).cast("int"), F.lit(1))
    run = blocks.withColumn("run", F.sum(changed).over(w.rowsBetween(Window.unboundedPreceding, 0)))
    parts = F.array_sort(F.collect_list(F.struct(F.col(order).alias("o"), F.col(text).alias("t"))))
    return run.groupBy(key, "run", page).agg(F.array_join(F.transform(parts, lambda p: p["t"]), " ").alias(text))


def batches(sizes: Column, most: int = BATCH_CHARS) -> Column:
    """The batch number (from 1) of each size, filled greedily in order."""
    start = F.struct(F.array().cast("array<int>").alias("out"), F.lit(1).alias("n"), F.lit(0).cast("long").alias("sum"))

    def step(s: Column, x: Column) -> Column:
        full = (s["sum"] > 0) & (s["sum"] + x > most)
        n = F.when(full, s["n"] + 1).otherwise(s["n"])
        return F.struct(F.array_append(s["out"], n).alias("out"), n.alias("n"), F.when(full, x).otherwise(s["sum"] + x).cast("long").alias("sum"))

    return F.aggregate(sizes, start, step)["out"]


def batch_sections(sections: DataFrame, key: str, pos: str, text: str, most: int = BATCH_CHARS, number: int = MAX_BATCHES) -> DataFrame:
    """(key, analysed, total, n_batches, truncated): what fits the first batches of each document."""
    items = F.transform(F.array_sort(F.collect_list(F.struct(F.col(pos).alias("p"), F.length(text).cast("long").alias("n")))), lambda x: x["n"])
    b = sections.groupBy(key).agg(batches(items, most).alias("b"))
    inside = F.size(F.filter("b", lambda n: n <= number))
    return b.select(key, inside.alias("analysed"), F.size("b").alias("total"), F.least(F.array_max("b"), F.lit(number)).alias("n_batches"), (inside < F.size("b")).alias("truncated"))


def leading_text(rows: DataFrame, key: str, order: str, text: str, most: int, joint: str = " ") -> DataFrame:
    """(key, text): the first ``most`` characters of each key's texts in order, joined; null texts are passed over.

    Each text adds a character of its joint, so only the first most + 1 rows can matter: a task sends no more of a key than these, each cut.
    """
    if not joint:
        raise ValueError("texts are joined by at least one character")
    some = rows.where(F.col(text).isNotNull()).select(key, F.col(order).alias("o"), F.substring(text, 1, most).alias("t"))
    some = some.withColumn("n", F.row_number().over(Window.partitionBy(key).orderBy("o"))).where(F.col("n") <= most + 1)
    parts = F.transform(F.array_sort(F.collect_list(F.struct("n", "t"))), lambda p: p["t"])
    return some.groupBy(key).agg(F.substring(F.array_join(parts, joint), 1, most).alias(text))


def merge_intervals(rows: DataFrame, key: str, start: str, end: str, name: str) -> DataFrame:
    """(key, start, end, names): overlapping intervals as one, with their names by start; touching ones stay apart."""
    w = Window.partitionBy(key).orderBy(start, end)
    reach = F.max(end).over(w.rowsBetween(Window.unboundedPreceding, -1))
    fresh = F.coalesce((F.col(start) >= reach).cast("int"), F.lit(1))
    island = rows.withColumn("__reach", fresh).withColumn("__island", F.sum("__reach").over(w.rowsBetween(Window.unboundedPreceding, 0)))
    names = F.transform(F.array_sort(F.collect_list(F.struct(F.col(start).alias("s"), F.col(name).alias("n")))), lambda x: x["n"])
    return island.groupBy(key, "__island").agg(F.min(start).alias(start), F.max(end).alias(end), names.alias("names")).drop("__island")


def segments(text: Column, marks: Column) -> Column:
    """The runs of a text, plain and marked: (text, names), names being NULL in plain ones. marks(start, end, names) ascend and do not overlap."""
    ends = F.concat(F.array(F.lit(0)), F.transform(marks, lambda m: m["end"].cast("int")))
    starts = F.concat(F.transform(marks, lambda m: m["start"].cast("int")), F.array(F.length(text)))
    plain = F.zip_with(ends, starts, lambda a, b: F.substring(text, a + 1, b - a))
    marked = F.transform(marks, lambda m: F.struct(F.substring(text, m["start"].cast("int") + 1, (m["end"] - m["start"]).cast("int")).alias("text"), m["names"].alias("names")))
    bare = F.transform(plain, lambda p, i: F.struct(p.alias("text"), F.when(F.lit(False), F.get(marked, i)["names"]).alias("names")))
    runs_ = F.flatten(F.transform(bare, lambda p, i: F.when(i < F.size(marked), F.array(p, F.get(marked, i))).otherwise(F.array(p))))
    return F.filter(runs_, lambda r: r["names"].isNotNull() | (r["text"] != ""))


def number_rows(rows: DataFrame, order: list, name: str = "id") -> DataFrame:
    """rows with numbers 0, 1, ... in an order, without gathering them in one task.

    Rows are range-partitioned, sorted and written once, as a second exchange could place them
    elsewhere; a row's number is its place in its partition after the rows of all partitions before
    (their counts are one small row each).
    """
    spark = rows.sparkSession
    place = fresh("__place", rows)
    placed = rows.repartitionByRange(*order).sortWithinPartitions(*order).withColumn(place, F.monotonically_increasing_id())
    path = scratch(spark)
    placed.write.parquet(path)
    placed = spark.read.schema(placed.schema).parquet(path)
    part, own = F.shiftright(place, 33), F.col(place).bitwiseAND((1 << 33) - 1)
    counts = placed.groupBy(part.alias("p")).agg(F.count("*").alias("n"))
    base = F.coalesce(F.sum("n").over(Window.orderBy("p").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    before = F.broadcast(counts.select("p", base.alias("base")))  # a row for each partition
    numbered = placed.join(before, part == F.col("p")).withColumn(name, (F.col("base") + own).cast("long"))
    return numbered.select(*(c for c in rows.columns if c != name), name)


def fresh(name: str, rows: DataFrame) -> str:
    """A column name that rows do not have."""
    taken = {c.lower() for c in rows.columns}
    while name in taken:
        name += "_"
    return name
