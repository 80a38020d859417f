import io
import zipfile

import pytest
from pyspark.sql import functions as F

from loomspan.models import HashingEmbedder
from loomspan.operators.segment import number_rows
from loomspan.sources import files as S
from loomspan.streaming.ingest import append_points


def test_discovery(spark, tmp_path):
    for name, size in (("India/a.pdf", 5), ("India/a (1).pdf", 5), ("India/b (2).pdf", 5), ("US/Zips/c.csv", 5), ("US/d.txt", 10), ("top.csv", 3), ("US/source.pdf", 2)):
        path = tmp_path / name
        path.parent.mkdir(parents=True, exist_ok=True)
        path.write_bytes(b"x" * size)
    found = [(r.path, r.country) for r in S.discover(spark, str(tmp_path)).collect()]
    assert found == [("India/a.pdf", "India"), ("India/b (2).pdf", "India"), ("US/d.txt", "US"), ("US/source.pdf", "India"), ("top.csv", "Global")]
    files = spark.createDataFrame([("a.txt", 11), ("a.csv", 11), ("b.TXT", 10)], "path string, length long")
    assert sorted(r.path for r in S.small_enough(files, 10).collect()) == ["a.csv", "b.TXT"]


def test_csv_rows(spark, tmp_path):
    (tmp_path / "wells.csv").write_text("﻿name,depth\nA,10\n,\nB,\n", encoding="utf-8")
    got = [(r.text, r.row) for r in S.load_csv(spark, str(tmp_path / "wells.csv"), "wells").orderBy("row").collect()]
    assert got == [("wells: name: A, depth: 10", 1), ("wells: name: B", 3)]


def test_paragraphs_keep_their_numbers(spark, tmp_path):
    (tmp_path / "t.txt").write_text("title\n\n" + "a" * 120 + "\n \n" + "b" * 120)
    assert [(r.row, r.text[0]) for r in S.load_text(spark, str(tmp_path / "t.txt")).orderBy("row").collect()] == [(2, "a"), (3, "b")]


def test_documents(spark, tmp_path):
    raw = io.BytesIO()
    w = 'xmlns:w="http://schemas.openxmlformats.org/wordprocessingml/2006/main"'
    with zipfile.ZipFile(raw, "w") as z:
        z.writestr("word/document.xml", f"<w:document {w}><w:body><w:p><w:r><w:t>One </w:t><w:t>two</w:t></w:r></w:p><w:p/></w:body></w:document>")
    (tmp_path / "a.docx").write_bytes(raw.getvalue())
    (tmp_path / "b.md").write_bytes("caf\xe9".encode("cp1252"))
    (tmp_path / "c.bin").write_bytes(b"?")
    (tmp_path / "d.docx").write_bytes(b"PK no archive")
    (tmp_path / "e.pdf").write_bytes(b"not a pdf")
    got = {(r.path.rsplit("/", 1)[1], r.text, r.problem) for r in S.load_documents(spark, str(tmp_path)).collect()}
    refused = {("c.bin", None, "Files of this kind are not taken."), ("d.docx", None, "The file is no Word document."), ("e.pdf", None, "The file is no PDF.")}
    assert got == {("a.docx", "One two", None), ("b.md", "café", None)} | refused
    with pytest.raises(S.UnreadableDocument):
        S.decode(b"a\0b")
    with pytest.raises(S.UnreadableDocument, match="too much"):
        S.docx_paragraphs(raw.getvalue(), most=20)


def workbook(sheets, strings=()):
    m = 'xmlns="http://schemas.openxmlformats.org/spreadsheetml/2006/main"'
    r = "http://schemas.openxmlformats.org/officeDocument/2006/relationships"
    raw = io.BytesIO()
    with zipfile.ZipFile(raw, "w") as z:
        listed = "".join(f'<sheet name="{n}" sheetId="{i}" r:id="r{i}"/>' for i, n in enumerate(sheets))
        z.writestr("xl/workbook.xml", f'<workbook {m} xmlns:r="{r}"><sheets>{listed}</sheets></workbook>')
        z.writestr("xl/_rels/workbook.xml.rels", "<Relationships>" + "".join(f'<Relationship Id="r{i}" Target="worksheets/s{i}.xml"/>' for i in range(len(sheets))) + "</Relationships>")
        z.writestr("xl/sharedStrings.xml", f"<sst {m}>" + "".join(f"<si><t>{s}</t></si>" for s in strings) + "</sst>")
        z.writestr("xl/styles.xml", f'<styleSheet {m}><cellXfs><xf numFmtId="0"/><xf numFmtId="14"/></cellXfs></styleSheet>')
        for i, rows in enumerate(sheets.values()):
            z.writestr(f"xl/worksheets/s{i}.xml", f"<worksheet {m}><sheetData>{rows}</sheetData></worksheet>")
    return raw.getvalue()


def test_spreadsheet_rows(spark):
    words = ["Fields of the north", "Feltnavn", "Depth", "Draugen", "Year"]
    first = (
        '<row r="1"><c r="A1" t="s"><v>0</v></c></row><row r="3"><c r="B3" t="s"><v>1</v></c><c r="C3" t="s"><v>2</v></c></row>'
        '<row r="4"><c r="A4" s="1"><v>43832</v></c><c r="B4" t="s"><v>3</v></c><c r="C4"><v>251.5</v></c></row>'
        '<row r="6"><c r="B6" t="inlineStr"><is><t> </t></is></c></row><row r="7"><c r="C7"><v>9</v></c><c r="D7"><v>1</v></c></row>'
    )
    second = '<row r="1"><c r="A1" t="s"><v>4</v></c></row><row r="2"><c r="A2"><v>2020</v></c></row>'
    third = '<row r="2"><c r="A2" t="inlineStr"><is><t>only</t></is></c></row><row r="3"><c r="A3"><v>7</v></c></row>'
    books = [("a/my_wells.xlsx", bytearray(workbook({"Sheet": first, "wells": second, "none": ""}, words))), ("b.v2/My.book.xlsm", bytearray(workbook({"Deep": third})))]
    rows = S.sheet_rows(spark.createDataFrame(books, "path string, content binary"))
    got = [(r.sheet, r.row, r.text) for r in S.sheet_texts(rows).orderBy("path", "place", "row").collect()]
    assert S.sheet_texts(rows.limit(0)).collect() == []
    assert got == [
        ("Sheet", 4, "my wells - Fields of the north: Period: 2020-01-02 00:00:00, Field name: Draugen, Depth: 251.5"),
        ("Sheet", 7, "my wells - Fields of the north: Depth: 9"),
        ("wells", 2, "my wells: Year: 2020"),
        ("Deep", 3, "My.book - Deep: only: 7"),
    ]


def test_corpus_is_loaded_by_format_and_rebuilt(spark, tmp_path):
    root = tmp_path / "corpus"
    (root / "Norway").mkdir(parents=True)
    (root / "Norway" / "w.csv").write_text("name,depth\nA,10\n\n,\nB,7\n")
    (root / "Norway" / "t.txt").write_text("short\n\n" + "ab " * 60)
    (root / "Norway" / "x.xlsx").write_bytes(workbook({"x": '<row><c><v>1</v></c><c><v>2</v></c></row><row><c><v>3</v></c><c><v>4</v></c></row>'}))
    (root / "y.bin").write_bytes(b"?")
    got = {(r.source_file, r.country, r.row, r.text) for r in S.load_corpus(spark, str(root)).collect()}
    assert got == {
        ("Norway/w.csv", "Norway", 1, "w: name: A, depth: 10"), ("Norway/w.csv", "Norway", 3, "w: name: B, depth: 7"),
        ("Norway/t.txt", "Norway", 2, ("ab " * 60).strip()), ("Norway/x.xlsx", "Norway", 2, "x: 1: 3, 2: 4"),
    }
    out = str(tmp_path / "index")
    for _ in range(2):
        table = S.rebuild(spark, str(root), out, lambda: HashingEmbedder(32), 32)
        assert sorted(r.id for r in table.points.collect()) == [0, 1, 2, 3]


def test_numbers_have_no_gaps(spark):
    rows = spark.range(1000).select((F.col("id") * 7 % 1000).alias("x"))
    got = number_rows(rows, ["x"]).collect()
    assert all(r.id == r.x for r in got) and len(got) == 1000


def test_streamed_points_land_once(spark, tmp_path):
    src, out, check = (str(tmp_path / n) for n in ("in", "out", "check"))
    for part in ([(1, [1.0, 0.0]), (2, [0.0, 0.0])], [(3, [0.0, 2.0])]):
        spark.createDataFrame(part, "id long, vector array<float>").write.mode("append").parquet(src)
        append_points(spark, src, "id long, vector array<float>", out, check, 2).awaitTermination()
    assert sorted(r.id for r in spark.read.parquet(out).collect()) == [1, 3]
