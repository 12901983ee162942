"""Files of each format, made here, through the readers."""

import io
import tarfile
import zipfile

import pytest
from pyspark.sql import functions as F

from lectern.sources import files
from lectern.streaming import ingest


def zipped(parts):
    out = io.BytesIO()
    with zipfile.ZipFile(out, "w") as z:
        for name, text in parts.items():
            z.writestr(name, text)
    return out.getvalue()


WORKBOOK = zipped(
    {
        "xl/workbook.xml": '<workbook xmlns:r="urn:r"><sheets><sheet name="Second" r:id="r2"/><sheet name="Empty" r:id="r3"/><sheet name="First" r:id="r1"/></sheets></workbook>',
        "xl/_rels/workbook.xml.rels": '<Relationships><Relationship Id="r1" Target="worksheets/sheet1.xml"/><Relationship Id="r2" Target="/xl/worksheets/sheet2.xml"/><Relationship Id="r3" Target="worksheets/sheet3.xml"/></Relationships>',
        "xl/sharedStrings.xml": "<sst><si><t>name</t></si><si><r><t>a|</t></r><r><t>b</t></r></si><si><t>Report</t></si></sst>",
        "xl/worksheets/sheet1.xml": '<worksheet><sheetData><row><c r="A1" t="s"><v>0</v></c><c r="AB1" t="inlineStr"><is><t>n</t></is></c></row><row><c r="A3" t="s"><v>1</v></c><c r="AB3"><v>3.0</v></c></row><row><c r="AB4"><f>SUM(B1)</f></c></row></sheetData><mergeCells><mergeCell ref="A3:A4"/></mergeCells></worksheet>',
        "xl/worksheets/sheet2.xml": '<worksheet><sheetData><row><c r="A1" t="s"><v>2</v></c></row><row><c r="A2"><v>1.5</v></c><c r="B2" t="b"><v>1</v></c></row><row><c r="A3"><v>2</v></c></row></sheetData></worksheet>',
        "xl/worksheets/sheet3.xml": "<worksheet><sheetData/></worksheet>",
    }
)
DOCUMENT = zipped({"word/document.xml": '<d xmlns:w="urn:w"><w:body><w:p><w:pPr><w:pStyle w:val="Heading2"/></w:pPr><w:r><w:t>Head</w:t></w:r></w:p><w:p><w:r><w:t>Text</w:t></w:r></w:p><w:p><w:pPr><w:numPr/></w:pPr><w:r><w:t>item</w:t></w:r></w:p><w:tbl><w:tr><w:tc><w:p><w:r><w:t>h</w:t></w:r></w:p></w:tc></w:tr><w:tr><w:tc><w:p><w:r><w:t>1</w:t></w:r></w:p></w:tc></w:tr></w:tbl></w:body></d>'})
SLIDES = zipped(
    {
        "ppt/slides/slide2.xml": "<s><sp><txBody><p><pPr lvl='1'/><r><t>deep</t></r></p></txBody></sp></s>",
        "ppt/slides/slide1.xml": "<s><sp><nvPr><ph type='title'/></nvPr><txBody><p><r><t>Start</t></r></p></txBody></sp></s>",
        "ppt/slides/_rels/slide1.xml.rels": '<R><Relationship Id="x" Type="http://x/notesSlide" Target="../notesSlides/notesSlide1.xml"/></R>',
        "ppt/notesSlides/notesSlide1.xml": "<n><sp><nvPr><ph type='sldNum'/></nvPr><p><r><t>7</t></r></p></sp><sp><nvPr><ph type='body'/></nvPr><p><r><t>say hello</t></r></p></sp></n>",
    }
)
FILES = {
    "a.csv": "﻿Banner,,\nname,n,\n\"x|y\",1,\n,,\nz,2,\n".encode(), "b.tsv": "型号\t价\n甲\t1\n".encode("gb18030"), "c.xlsx": WORKBOOK, "d.docx": DOCUMENT, "e.pptx": SLIDES,
    "f.md": "﻿# T\r\nx ".encode(), "g.xlsx": b"no zip", "h.pdf": b"%PDF", "i.txt": b" \n",
}
WANT = {
    "a.csv": "| name | n |\n| --- | --- |\n| x\\|y | 1 |\n| z | 2 |",
    "b.tsv": "| 型号 | 价 |\n| --- | --- |\n| 甲 | 1 |",
    "c.xlsx": "# Second\n\n| 1.5 | True |\n| --- | --- |\n| 2 |  |\n\n# First\n\n| name | n |\n| --- | --- |\n| a\\|b | 3 |\n| a\\|b | =SUM(B1) |",
    "d.docx": "## Head\n\nText\n\n- item\n\n| h |\n| --- |\n| 1 |",
    "e.pptx": "## Start\n> 备注：say hello\n\n## 幻灯片 2\n  - deep",
    "f.md": "# T\nx", "g.xlsx": None, "h.pdf": None, "i.txt": None,
}


@pytest.fixture(scope="module")
def folder(tmp_path_factory):
    path = tmp_path_factory.mktemp("files")
    for name, content in FILES.items():
        (path / name).write_bytes(content)
    return path


def test_formats(spark, folder):
    rows = {r.path.rpartition("/")[2]: r for r in files.parse_files(files.read_files(spark, str(folder))).collect()}
    assert {n: r.markdown for n, r in rows.items()} == WANT
    assert rows["h.pdf"].error == "no parser" and rows["i.txt"].error == "empty" and rows["g.xlsx"].error.startswith("BadZipFile") and rows["a.csv"].error is None


def test_archives(spark):
    tar = io.BytesIO()
    with tarfile.open(fileobj=tar, mode="w:gz") as t:
        for name, content in {"x/a.md": b"hi", "x/._a.md": b"junk", "b.exe": b"1", "c.txt": b"", "d.zip": b"1"}.items():
            info = tarfile.TarInfo(name)
            info.size = len(content)
            t.addfile(info, io.BytesIO(content))
        link = tarfile.TarInfo("l.md")
        link.type, link.linkname = tarfile.SYMTYPE, "/etc/passwd"
        t.addfile(link)
    rows = spark.createDataFrame([("t.tar.gz", tar.getvalue()), ("z.zip", zipped({"m.csv": "a,b", "__MACOSX/m.csv": "x"})), ("bad.zip", b"PK nothing")], "path string, content binary")
    got = {(r.archive, r.name): (r.skipped, r.content is not None) for r in files.expand_archives(rows).collect()}
    assert got[("t.tar.gz", "x/a.md")] == (None, True) and got[("z.zip", "m.csv")] == (None, True)
    assert {k[1]: v[0] for k, v in got.items() if v[0] and k[1]} == {"x/._a.md": "junk", "b.exe": "unsupported", "c.txt": "empty", "d.zip": "archive", "l.md": "link", "__MACOSX/m.csv": "junk"}
    assert got[("bad.zip", None)][0].startswith("unreadable")


def test_lines_and_scans(spark):
    merged = files.merge_visual_lines
    assert merged(["The first line of a paragraph runs", "on here.", "- a bullet stands apart", ""]) == ["The first line of a paragraph runs on here.", "- a bullet stands apart"]
    assert merged(["这是第一行文字没有句号", "接着写。", "下一段"]) == ["这是第一行文字没有句号接着写。", "下一段"]
    pages = spark.createDataFrame([("a", 1000, 0.0, 0.0, 0.1), ("b", 3, 0.0, 0.0, 0.0), ("c", 900, 0.0, 0.2, 0.0), ("d", 500, 0.0, 0.0, 0.9)], "doc string, chars long, junk double, cid double, unmapped double")
    assert {r.doc: r.scanned for r in files.looks_scanned(pages, "doc").collect()} == {"a": False, "b": True, "c": True, "d": True}


def test_files_to_ingest(spark):
    found = spark.createDataFrame([("/x/doc_1a.md",), ("/x/doc_2.pdf",), ("/x/other.md",)], "path string")
    ready = spark.createDataFrame([("doc_2",)], "doc_id string")
    assert [r.doc_id for r in files.files_to_ingest(found, ready).collect()] == ["doc_1a"]
    assert files.files_to_ingest(found, ready, force=True).count() == 2


def test_stream(spark, tmp_path):
    """Each new file of documents is chunked once; a document that comes again brings no chunk twice."""
    source, chunks, checkpoint = (str(tmp_path / n) for n in ("in", "chunks", "checkpoint"))
    first = spark.createDataFrame([(1, "# A\n\nbody"), (2, "text")], ingest.DOCS)
    first.coalesce(1).write.parquet(source)
    ingest.ingest(spark, source, chunks, checkpoint).awaitTermination()
    assert spark.read.parquet(chunks).count() == 2
    spark.createDataFrame([(2, "text"), (3, "new")], ingest.DOCS).coalesce(1).write.mode("append").parquet(source)
    ingest.ingest(spark, source, chunks, checkpoint).awaitTermination()
    assert sorted(r.chunk_id for r in spark.read.parquet(chunks).select("chunk_id").collect()) == ["1_c0000", "2_c0000", "3_c0000"]
