"""Discovery and loading of files into blocks, and index metadata.

Directories are listed and files are read by Spark's own sources, so any store it can read will do.
A PDF raises ImportError if its parser is not installed.
"""

from __future__ import annotations

import csv
import io
import zipfile
from collections.abc import Callable, Iterator
from xml.etree import ElementTree

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from loomspan.config import CHUNK_MIN_CHARS, DOCX_XML_MOST, PDF_BLOCK_LEAST, PDF_PAGES_MOST, TEXT_FILE_MOST
from loomspan.functions.text import clean, clean_line, dataset_label, folder_of, paragraphs, source_name
from loomspan.models import Embedder, embed
from loomspan.operators.search import VectorTable
from loomspan.operators.segment import chunks, merge_blocks, number_rows
from loomspan.sources.workbook import HEADERS, workbook_rows

_COPY = r"^(.*?) ?\([0-9]+\)(\.[^.]*)$"
_W = "{http://schemas.openxmlformats.org/wordprocessingml/2006/main}"
#: Documents whose folder says nothing of their country (fixed values).
COUNTRY_OVERRIDES = {"source.pdf": "India"}


def country_of(path: Column, overrides: dict[str, str] = COUNTRY_OVERRIDES) -> Column:
    """The top folder of a relative path; Global for files at the top."""
    top = F.when(F.contains(path, F.lit("/")), F.substring_index(path, "/", 1)).otherwise(F.lit("Global"))
    for name, country in overrides.items():
        top = F.when(source_name(path) == name, F.lit(country)).otherwise(top)
    return top


def in_skipped_folder(path: Column, name: str = "zips") -> Column:
    return F.lower(path).rlike(rf"(^|/){name}/")


def extension(path: Column) -> Column:
    return F.lower(F.regexp_extract(path, r"\.([^./]+)$", 1))


def small_enough(files: DataFrame, most: int = TEXT_FILE_MOST) -> DataFrame:
    """Files without text files of more than ``most`` bytes."""
    return files.where(~((extension(F.col("path")) == "txt") & (F.col("length") > most)))


def drop_download_copies(files: DataFrame) -> DataFrame:
    """Files without ``name (1).ext`` where ``name.ext`` lies in the same folder."""
    base = F.concat(F.regexp_extract("name", _COPY, 1), F.regexp_extract("name", _COPY, 2))
    f = files.withColumn("folder", folder_of(F.col("path"))).withColumn("name", source_name(F.col("path"))).withColumn("original", F.when(base != "", base))
    there = f.select(F.col("folder").alias("folder"), F.col("name").alias("original")).distinct()
    return f.join(there, ["folder", "original"], "left_anti").select(files.columns)


def discover(spark: SparkSession, root: str) -> DataFrame:
    """(path, country, length) of the files below root that are to be loaded, sorted by path."""
    base = root.rstrip("/") + "/"
    found = spark.read.format("binaryFile").option("recursiveFileLookup", "true").load(root).select("path", "length")
    relative = F.substring_index(F.col("path"), base, -1)
    files = found.withColumn("full", F.col("path")).withColumn("path", relative).where(~in_skipped_folder(relative))
    kept = drop_download_copies(small_enough(files))
    return kept.select("full", "path", country_of(F.col("path")).alias("country"), "length").orderBy("path")


def row_to_text(stem: Column, columns: list[str]) -> Column:
    """``stem: name: value, name: value`` of the filled cells; NULL if none is."""
    cells = [F.when(F.trim(F.col(c).cast("string")) != "", F.concat(F.lit(f"{c}: "), F.trim(F.col(c).cast("string")))) for c in columns]
    text = F.concat_ws(", ", *cells)
    return F.when(text != "", F.concat(stem, F.lit(": "), text))


def load_csv(spark: SparkSession, path: str, stem: str) -> DataFrame:
    """(text, row): a line per data row; rows count from 1, empty rows included and then left out."""
    rows = spark.read.option("header", True).option("multiLine", True).option("encoding", "UTF-8").csv(path)
    names = [c.lstrip("﻿") for c in rows.columns]
    rows = rows.toDF(*names).withColumn("__id", F.monotonically_increasing_id())
    numbered = rows.withColumn("row", F.row_number().over(Window.orderBy("__id")))  # one file is one task
    return numbered.select(row_to_text(F.lit(stem), names).alias("text"), "row").where("text is not null")


def paragraph_blocks(docs: DataFrame, key: str, text: str, least: int = CHUNK_MIN_CHARS) -> DataFrame:
    """(key, row, text): paragraphs of ``least`` characters, numbered before the short ones go."""
    p = docs.select(key, F.posexplode(paragraphs(F.col(text))).alias("p", "text"))
    return p.select(key, (F.col("p") + 1).alias("row"), "text").where(F.length("text") >= least)


def load_text(spark: SparkSession, path: str) -> DataFrame:
    return paragraph_blocks(spark.read.text(path, wholetext=True).withColumn("path", F.input_file_name()), "path", "value")


def header_row(cells: DataFrame, sheet: str, row: str, values: str) -> DataFrame:
    """(sheet, header_row): the first row with two filled cells or more."""
    filled = F.size(F.filter(values, lambda v: F.coalesce(F.trim(v), F.lit("")) != ""))
    return cells.where(filled >= 2).groupBy(sheet).agg(F.min(row).alias("header_row"))


def header_names(cells: Column, translations: dict[str, str]) -> Column:
    """Translated header cells; a blank first one is Period."""
    table = F.create_map(*(F.lit(x) for kv in translations.items() for x in kv)) if translations else F.create_map().cast("map<string,string>")
    named = F.transform(cells, lambda h: F.coalesce(F.element_at(table, F.trim(h)), h))
    return F.when(F.coalesce(F.trim(F.get(cells, F.lit(0))), F.lit("")) == "", F.concat(F.array(F.lit("Period")), F.slice(named, F.lit(2), F.size(named)))).otherwise(named)


SHEET_ROWS = "path string, place int, sheet string, row int, cells array<string>"


def sheet_rows(files: DataFrame) -> DataFrame:
    """(path, place, sheet, row, cells) of each row of the spreadsheets in files(path, content), cells as texts."""

    def read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for path, data in zip(b.column(0).to_pylist(), b.column(1).to_pylist(), strict=True):
                for place, (sheet, rows) in enumerate(workbook_rows(data)):
                    for start in range(0, len(rows), 10_000):
                        part = rows[start : start + 10_000]
                        cells = [[None if v is None else str(v) for v in cells] for _, cells in part]
                        columns = [pa.array([path] * len(part)), pa.array([place] * len(part), pa.int32()), pa.array([sheet] * len(part), pa.string()), pa.array([n for n, _ in part], pa.int32()), pa.array(cells, pa.list_(pa.string()))]
                        yield pa.RecordBatch.from_arrays(columns, ["path", "place", "sheet", "row", "cells"])

    return files.select("path", "content").mapInArrow(read, SHEET_ROWS)


def sheet_texts(rows: DataFrame, translations: dict[str, str] = HEADERS) -> DataFrame:
    """(path, place, sheet, row, text) of the filled rows below each sheet's header; rows as of ``sheet_rows``.

    A sheet without a row of two filled cells has its first row as header. A text is labelled by the file and the first
    filled cell above the header, or else the sheet's name, if that says more than the file's.
    """
    filled = lambda v: F.coalesce(F.trim(v), F.lit("")) != ""
    own = rows.withColumn("of", F.struct("path", "place"))
    at = own.groupBy("of").agg(F.min("row").alias("first")).join(header_row(own, "of", "row", "cells"), "of", "left").select("of", F.coalesce("header_row", "first").alias("at"))
    placed = own.join(at, "of")
    said = F.get(F.filter("cells", filled), F.lit(0))
    title = F.min_by(said, F.when((F.col("row") < F.col("at")) & said.isNotNull(), F.col("row")))
    heads = placed.where("row <= at").groupBy("of").agg(F.max_by("cells", "row").alias("header"), title.alias("title"))
    body = placed.where("row > at").join(heads, "of")
    stem = F.regexp_extract("path", r"([^/]*?)(\.[^./]*)?$", 1)
    titled, bare = dataset_label(stem, F.col("title")), F.replace(stem, F.lit("_"), F.lit(" "))
    label = F.when(titled != bare, titled).otherwise(dataset_label(stem, F.col("sheet")))
    parts = F.zip_with(header_names(F.col("header"), translations), F.col("cells"), lambda h, v: F.when(h.isNotNull() & filled(v), F.concat(h, F.lit(": "), v)))
    text = F.array_join(F.array_compact(parts), ", ")
    return body.where(F.size(F.array_compact(parts)) > 0).select("path", "place", "sheet", "row", F.concat(label, F.lit(": "), text).alias("text"))


def sections(docs: DataFrame, key: str, text: str, least: int = 40) -> DataFrame:
    """(key, pos, section_id, text): cleaned filled lines; documents of under ``least`` characters are rejected."""
    lines = F.filter(F.transform(F.split(text, "\n"), clean_line), lambda x: x != "")
    d = docs.select(key, lines.alias("lines"))
    long_enough = F.aggregate("lines", F.lit(0), lambda s, x: s + F.length(x)) >= least
    s = d.where(long_enough).select(key, F.posexplode("lines").alias("p", "text"))
    return s.select(key, (F.col("p") + 1).alias("pos"), F.concat(F.lit("S"), F.col("p") + 1).alias("section_id"), "text")


class UnreadableDocument(ValueError):
    """The file is not a readable document of its kind; the message may be shown."""


def docx_paragraphs(data: bytes, most: int = DOCX_XML_MOST) -> list[str]:
    """Paragraph texts of a DOCX file, tabs as spaces. A body that unpacks to more than ``most`` bytes is refused."""
    marks = {f"{_W}tab": " ", f"{_W}br": "\n", f"{_W}cr": "\n"}
    try:
        with zipfile.ZipFile(io.BytesIO(data)) as z:
            body = z.getinfo("word/document.xml")
            if body.file_size > most:
                raise UnreadableDocument("The Word document unpacks to too much data.")
            tree = ElementTree.fromstring(z.read(body))
    except (zipfile.BadZipFile, KeyError, ElementTree.ParseError) as e:
        raise UnreadableDocument("The file is no Word document.") from e
    return ["".join((t.text or "") if t.tag == f"{_W}t" else marks.get(t.tag, "") for t in p.iter()) for p in tree.iter(f"{_W}p")]


def decode(data: bytes) -> str:
    """UTF-8 with or without a mark, else Windows-1252; text with NUL is refused."""
    if b"\0" in data:
        raise UnreadableDocument("The file is no text.")
    try:
        return data.decode("utf-8-sig")
    except UnicodeDecodeError:
        return data.decode("cp1252", "replace")


def text_lines(data: bytes) -> list[str]:
    return decode(data).replace("\r\n", "\n").replace("\r", "\n").split("\n")


def pdf_blocks(data: bytes, most_pages: int | None = None) -> list[tuple[int, str]]:
    """(page, text) of the text blocks of a PDF. Uploads are refused beyond ``most_pages`` or with a password."""
    if not data.startswith(b"%PDF-"):
        raise UnreadableDocument("The file is no PDF.")
    import fitz

    try:
        book = fitz.open(stream=data, filetype="pdf")
    except Exception as e:
        raise UnreadableDocument("The PDF cannot be opened.") from e
    with book:
        if book.needs_pass:
            raise UnreadableDocument("The PDF is locked by a password.")
        if most_pages is not None and book.page_count > most_pages:
            raise UnreadableDocument(f"A PDF may have {most_pages} pages.")
        return [(n, b[4]) for n, page in enumerate(book, 1) for b in page.get_text("blocks") if b[6] == 0]


#: Parsers of uploads, by suffix: (page, text) pieces.
PARSERS: dict[str, Callable[[bytes], list[tuple[int | None, str]]]] = {
    "docx": lambda d: [(None, t) for t in docx_paragraphs(d)],
    "txt": lambda d: [(None, t) for t in text_lines(d)],
    "md": lambda d: [(None, t) for t in text_lines(d)],
    "pdf": lambda d: pdf_blocks(d, PDF_PAGES_MOST),
}


def load_documents(spark: SparkSession, path: str) -> DataFrame:
    """(path, pos, page, text, problem): pieces of uploaded documents, parsed where their bytes are read.

    A file that cannot be read, or of a kind that is not taken, gives one row with its problem and no text.
    """

    def pieces(name: str, data: bytes) -> list[tuple]:
        kind = name.rsplit(".", 1)[-1].lower()
        try:
            if kind not in PARSERS:
                raise UnreadableDocument("Files of this kind are not taken.")
            return [(name, i, page, text, None) for i, (page, text) in enumerate(PARSERS[kind](data), 1)]
        except UnreadableDocument as e:
            return [(name, 0, None, None, str(e))]

    kind = "path string, pos int, page int, text string, problem string"
    raw = _parsed(spark.read.format("binaryFile").option("recursiveFileLookup", "true").load(path).select("path", "content"), pieces, kind)
    return raw.withColumn("text", clean_line(F.col("text"))).where("text <> '' or problem is not null")


def _parsed(files: DataFrame, pieces: Callable[[str, bytes], list[tuple]], schema: str) -> DataFrame:
    """Rows that a parser makes of (path, content): a batch holds the rows of one file."""

    def parse(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        kinds = {"string": pa.string(), "int": pa.int32()}
        fields = [f.split() for f in schema.split(", ")]
        for b in batches:
            for i in range(b.num_rows):
                rows = pieces(b.column(0)[i].as_py(), b.column(1)[i].as_py())
                columns = zip(*rows, strict=True) if rows else [()] * len(fields)
                yield pa.RecordBatch.from_arrays([pa.array(c, kinds[k]) for c, (_, k) in zip(columns, fields, strict=True)], [n for n, _ in fields])

    return files.mapInArrow(parse, schema)


def _csv_blocks(stem: str, data: bytes) -> list[tuple[int, str]]:
    rows = csv.reader(io.StringIO(data.decode("utf-8-sig", "replace"), newline=""))
    names = next(rows, [])
    out = []
    for n, row in enumerate((r for r in rows if r), 1):
        cells = [f"{h}: {v.strip()}" for h, v in zip(names, row, strict=False) if v.strip()]
        if cells:
            out.append((n, f"{stem}: " + ", ".join(cells)))
    return out


def load_corpus(spark: SparkSession, root: str) -> DataFrame:
    """(source_file, country, page, row, text): the blocks of all files below root that are to be loaded, by their formats.

    CSV, text, spreadsheets (xlsx, xlsm) and PDF; others are passed over. PDF blocks of one page are joined and cut into
    chunks; rows and paragraphs are chunks as they are. A file is parsed in one task, by its bytes; a broken one fails the load.
    """
    kept = discover(spark, root).where(extension(F.col("path")).isin("csv", "txt", "xlsx", "xlsm", "pdf"))
    names = kept.select(F.col("full").alias("path"), F.col("path").alias("source_file"), "country")
    files = spark.read.format("binaryFile").option("recursiveFileLookup", "true").load(root).select("path", "content")
    small = names.count() < 100_000  # paths of some hundred bytes: contents move only beyond this
    files = files.join(F.broadcast(names) if small else names, "path")

    def pieces(name: str, data: bytes) -> list[tuple]:
        stem, _, kind = name.rsplit("/", 1)[-1].rpartition(".")
        if kind.lower() == "csv":
            return [(name, None, n, t) for n, t in _csv_blocks(stem, data)]
        if kind.lower() == "pdf":
            return [(name, page, n, t) for n, (page, t) in enumerate(pdf_blocks(data), 1)]
        return [(name, None, None, decode(data))]

    kind = extension(F.col("source_file"))
    is_book = kind.isin("xlsx", "xlsm")
    raw = _parsed(files.where(~is_book).select("source_file", "content"), pieces, "source_file string, page int, row int, text string")
    books = sheet_texts(sheet_rows(files.where(is_book).select(F.col("source_file").alias("path"), "content")))
    rows = raw.where(kind == "csv").unionByName(books.select(F.col("path").alias("source_file"), F.lit(None).cast("int").alias("page"), "row", "text"))
    texts = paragraph_blocks(raw.where(kind == "txt"), "source_file", "text").select("source_file", F.lit(None).cast("int").alias("page"), "row", "text")
    block = raw.where(kind == "pdf").withColumn("text", clean(F.col("text"))).where(F.length("text") >= PDF_BLOCK_LEAST)
    joined = merge_blocks(block, "source_file", "row", "page", "text")
    pdf = joined.select("source_file", "page", F.lit(None).cast("int").alias("row"), F.explode(chunks(F.col("text"))).alias("text"))
    found = rows.unionByName(texts).unionByName(pdf).withColumn("country", country_of(F.col("source_file")))
    return found.select("source_file", "country", "page", "row", "text")


def rebuild(spark: SparkSession, root: str, path: str, model: Callable[[], Embedder], dim: int) -> VectorTable:
    """Reads the whole corpus again and replaces the snapshot at path: ids without gaps, by file, page, row and text."""
    rows = number_rows(load_corpus(spark, root), ["source_file", "page", "row", "text"])
    table = VectorTable(spark, dim).insert(rows.withColumn("vector", embed(F.col("text"), model)), strict=False)
    table.save(path, {"source": root})
    return VectorTable.load(spark, path)


def index_meta(rows: DataFrame, source: str, model: str, size: int, overlap: int) -> DataFrame:
    return rows.agg(F.count("*").alias("num_chunks"), F.lit(source).alias("source"), F.lit(model).alias("model"), F.lit(size).alias("chunk_size"), F.lit(overlap).alias("chunk_overlap"))
