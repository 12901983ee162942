"""Files by format: routing, plain text, delimited tables, archives, office documents, ingest listings.

Every reader takes ``spark.read.format("binaryFile")`` rows (path, content), so Spark lists, splits and retries; per-file parsing is
a small helper in ``mapInPandas``. Files that can't be parsed keep a row with ``error`` and null markdown.
"""

from __future__ import annotations

import csv
import io
import re
import tarfile
import zipfile
from collections.abc import Callable, Iterator
from xml.etree import ElementTree

import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

# Extensions by parser.
FORMATS = {"text": ("txt", "md", "markdown"), "table": ("csv", "tsv"), "workbook": ("xlsx",), "document": ("docx",), "slides": ("pptx",), "pdf": ("pdf",), "archive": ("zip", "tar", "tar.gz", "tgz")}
MOST_FILES, MOST_BYTES = 300, 1 << 30


def extension(path: Column) -> Column:
    """Lower-case extension; compound archive extensions are kept."""
    return F.regexp_extract(F.lower(path), r"\.(tar\.gz|tar\.bz2|[a-z0-9]+)$", 1)


def file_format(path: Column) -> Column:
    """Which parser takes a file; null for none."""
    ext = extension(path)
    out = F.lit(None).cast("string")
    for name, known in FORMATS.items():
        out = F.when(ext.isin(*known), name).otherwise(out)
    return out


def mount_name(path: Column) -> Column:
    ext = extension(path)
    return F.concat(F.lit("input."), F.when(ext == "", "bin").otherwise(ext))


def read_files(spark: SparkSession, path: str) -> DataFrame:
    files = spark.read.format("binaryFile").option("recursiveFileLookup", "true").load(path)
    return files.withColumn("format", file_format(F.col("path")))


def plain_text(text: Column, *, ends: str = r"\r\n?", blanks: str = " \t\n\v\f\r") -> Column:
    """Without a byte order mark, line ends (``ends``, a pattern) as \\n, trimmed of ``blanks``; empty texts are null."""
    bare = F.regexp_replace(F.regexp_replace(text, "^\N{ZERO WIDTH NO-BREAK SPACE}", ""), ends, "\n")
    return F.nullif(F.btrim(bare, F.lit(blanks)), F.lit(""))


def decoded(content: bytes) -> str:
    """Text of unknown encoding: UTF-8 with or without a mark, then GB 18030, then what can be read of UTF-8."""
    for encoding in ("utf-8-sig", "gb18030"):
        try:
            return content.decode(encoding)
        except UnicodeDecodeError:
            continue
    return content.decode("utf-8", "replace")


def _cell(value: object) -> str:
    if isinstance(value, float) and value.is_integer():
        value = int(value)
    return re.sub(r"\s*[\r\n]+\s*", " ", "" if value is None else str(value)).strip()


def _numeric(value: str) -> bool:
    return bool(re.fullmatch(r"-?[\d.,]+%?", value))


def grid_markdown(grid: list[list[object]]) -> str:
    """A cleaned grid as a markdown table: no blank rows or columns, equal widths, no banner rows above the header."""
    rows = [[_cell(c) for c in r] for r in grid]
    rows = [r for r in rows if any(r)]
    width = max(map(len, rows), default=0)
    rows = [r + [""] * (width - len(r)) for r in rows]
    used = [j for j in range(width) if any(r[j] for r in rows)]
    rows = [[r[j] for j in used] for r in rows]
    while len(used) >= 2 and len(rows) >= 3:
        first, second = ({c for c in r if c} for r in rows[:2])
        if len(first) != 1 or _numeric(next(iter(first))) or len(second) < 2:
            break
        rows = rows[1:]
    if not rows:
        return ""
    lines = ["| " + " | ".join(c.replace("|", "\\|") for c in r) + " |" for r in rows]
    return "\n".join([lines[0], "|" + " --- |" * len(used), *lines[1:]])


def delimited_markdown(content: bytes, path: str) -> str:
    text = decoded(content)
    return grid_markdown(list(csv.reader(io.StringIO(text, newline=""), delimiter="\t" if path.lower().endswith(".tsv") else ",")))


def _local(tag: str) -> str:
    return tag.rpartition("}")[2]


def _text(node: ElementTree.Element) -> str:
    return "".join(t.text or "" for t in node.iter() if _local(t.tag) == "t")


def _attribute(node: ElementTree.Element | None, name: str) -> str:
    return next((v for k, v in (node.attrib if node is not None else {}).items() if _local(k) == name), "")


def document_markdown(content: bytes, path: str) -> str:
    """A word-processor document in body order: heading styles, lists, tables."""
    with zipfile.ZipFile(io.BytesIO(content)) as z:
        body = ElementTree.fromstring(z.read("word/document.xml"))[0]
    out = []
    for node in body:
        if _local(node.tag) == "tbl":
            grid = [["\n".join(map(_text, (p for p in c if _local(p.tag) == "p"))) for c in r if _local(c.tag) == "tc"] for r in node if _local(r.tag) == "tr"]
            out.append(grid_markdown(grid))
        elif _local(node.tag) == "p" and (text := _text(node).strip()):
            style = _attribute(next((s for s in node.iter() if _local(s.tag) == "pStyle"), None), "val").lower()
            listed = any(_local(s.tag) == "numPr" for s in node.iter()) or "list" in style
            level = re.fullmatch(r"heading\s*(\d)", style)
            mark = "#" * min(6, int(level[1])) + " " if level else "# " if style in ("title", "标题") else "- " if listed else ""
            out.append(mark + text)
    return "\n\n".join(x for x in out if x)


def _notes(z: zipfile.ZipFile, slide: str) -> str:
    """What the speaker notes of a slide say."""
    links = slide.replace("slides/", "slides/_rels/") + ".rels"
    if links not in z.namelist():
        return ""
    found = [r.get("Target") for r in ElementTree.fromstring(z.read(links)) if "notesSlide" in (r.get("Type") or "")]
    if not found:
        return ""
    root = ElementTree.fromstring(z.read("ppt/notesSlides/" + found[0].rpartition("/")[2]))
    bodies = [s for s in root.iter() if _local(s.tag) == "sp" and _attribute(next((x for x in s.iter() if _local(x.tag) == "ph"), None), "type") == "body"]
    return "\n".join(_text(p) for s in bodies for p in s.iter() if _local(p.tag) == "p").strip()


def slides_markdown(content: bytes, path: str) -> str:
    """Slides in order: title or number, indented text, tables, speaker notes."""
    out = []
    with zipfile.ZipFile(io.BytesIO(content)) as z:
        names = sorted((n for n in z.namelist() if re.fullmatch(r"ppt/slides/slide\d+\.xml", n)), key=lambda n: int(re.search(r"\d+", n)[0]))
        for number, name in enumerate(names, 1):
            title, lines = f"幻灯片 {number}", []
            for shape in ElementTree.fromstring(z.read(name)).iter():
                if _local(shape.tag) == "tbl":
                    lines.append(grid_markdown([[_text(c) for c in r if _local(c.tag) == "tc"] for r in shape if _local(r.tag) == "tr"]))
                if _local(shape.tag) != "sp":
                    continue
                kind = _attribute(next((s for s in shape.iter() if _local(s.tag) == "ph"), None), "type")
                for p in (p for p in shape.iter() if _local(p.tag) == "p"):
                    if text := _text(p).strip():
                        if kind in ("title", "ctrTitle"):
                            title = text
                        else:
                            level = _attribute(next((s for s in p if _local(s.tag) == "pPr"), None), "lvl") or "0"
                            lines.append("  " * int(level) + "- " + text)
            notes = _notes(z, name)
            out.append("\n".join([f"## {title}", *lines, *([f"> 备注：{notes}"] if notes else [])]))
    return "\n\n".join(out)


def _place(reference: str) -> tuple[int, int]:
    """(row, column) from 0 of a cell such as AB12."""
    letters, digits = re.fullmatch(r"([A-Z]+)(\d+)", reference.replace("$", "")).groups()
    column = 0
    for c in letters:
        column = column * 26 + ord(c) - 64
    return int(digits) - 1, column - 1


def _sheet_grid(sheet: ElementTree.Element, shared: list[str]) -> list[list[object]]:
    """A sheet's cells; the value of merged cells stands in each of them, and a formula where no result was stored."""
    held: dict[tuple[int, int], object] = {}
    for cell in (x for x in sheet.iter() if _local(x.tag) == "c"):
        inner = {_local(x.tag): x for x in cell}
        kind, value = cell.get("t"), inner["v"].text if "v" in inner else None
        if kind == "inlineStr":
            value = _text(inner["is"]) if "is" in inner else None
        elif kind == "s" and value is not None:
            value = shared[int(value)]
        elif kind == "b" and value is not None:
            value = "True" if value == "1" else "False"
        elif kind in (None, "n") and value is not None:
            value = float(value)
        if value is None and "f" in inner and inner["f"].text:
            value = "=" + inner["f"].text
        if value is not None and cell.get("r"):
            held[_place(cell.get("r"))] = value
    for merged in (x for x in sheet.iter() if _local(x.tag) == "mergeCell"):
        (top, left), (bottom, right) = map(_place, merged.get("ref").split(":"))
        if (top, left) in held:
            held |= {(r, c): held[top, left] for r in range(top, bottom + 1) for c in range(left, right + 1)}
    rows: dict[int, dict[int, object]] = {}
    for (r, c), value in held.items():
        rows.setdefault(r, {})[c] = value
    # blank rows and columns would go anyway
    columns = sorted({c for _, c in held})
    return [[row.get(c) for c in columns] for _, row in sorted(rows.items())]


def workbook_markdown(content: bytes, path: str) -> str:
    """Each sheet that isn't empty as a heading and a table, in the workbook's order."""
    out = []
    with zipfile.ZipFile(io.BytesIO(content)) as z:
        names = set(z.namelist())
        shared = [_text(si) for si in ElementTree.fromstring(z.read("xl/sharedStrings.xml")) if _local(si.tag) == "si"] if "xl/sharedStrings.xml" in names else []
        targets = {_attribute(r, "Id"): r.get("Target") for r in ElementTree.fromstring(z.read("xl/_rels/workbook.xml.rels"))}
        for sheet in (x for x in ElementTree.fromstring(z.read("xl/workbook.xml")).iter() if _local(x.tag) == "sheet"):
            target = targets[next(v for k, v in sheet.attrib.items() if k.endswith("}id"))]
            part = target.lstrip("/") if target.startswith("/") else f"xl/{target}"
            table = grid_markdown(_sheet_grid(ElementTree.fromstring(z.read(part)), shared)) if part in names else ""
            if table:
                out.append(f"# {sheet.get('name')}\n\n{table}")
    return "\n\n".join(out)


PARSERS: dict[str, Callable[[bytes, str], str]] = {"text": lambda c, p: decoded(c).replace("\r\n", "\n").replace("\r", "\n").strip(), "table": delimited_markdown, "workbook": workbook_markdown, "document": document_markdown, "slides": slides_markdown}


def parse_files(files: DataFrame, parsers: dict[str, Callable[[bytes, str], str]] | None = None) -> DataFrame:
    """(path, format, markdown, error) of files (path, content, format). ``parsers`` adds or replaces parsers by format."""
    known = PARSERS | (parsers or {})

    def batches(parts: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for part in parts:
            rows = []
            for path, content, kind in zip(part["path"], part["content"], part["format"], strict=True):
                try:
                    text = known[kind](content, path) if kind in known else None
                    error = "no parser" if text is None else "empty" if not text else None
                except Exception as e:  # a bad file is a row, not a failed job
                    text, error = None, f"{type(e).__name__}: {e}"
                rows.append((path, kind, text or None, error))
            yield pd.DataFrame(rows, columns=["path", "format", "markdown", "error"])

    return files.select("path", "content", "format").mapInPandas(batches, "path string, format string, markdown string, error string")


def left_out(name: str, size: int, link: bool) -> str | None:
    """Why a member of an archive isn't taken; null if it is."""
    base, ext = name.rpartition("/")[2], name.lower().rpartition(".")[2]
    if link:
        return "link"
    if base.startswith((".", "~$")) or "__MACOSX" in name or base in ("Thumbs.db", "desktop.ini"):
        return "junk"
    if ext in ("zip", "tar", "gz", "tgz", "rar", "7z"):
        return "archive"
    return "unsupported" if not any(ext in known for kind, known in FORMATS.items() if kind != "archive") else "empty" if not size else None


def expand_archives(files: DataFrame) -> DataFrame:
    """(archive, name, size, content, skipped): members of each archive; those left out say why and have no content.

    Links, junk, nested archives, unsupported and empty members are skipped; at most ``MOST_FILES`` members and ``MOST_BYTES``.
    """
    def members(content: bytes) -> Iterator[tuple[str, int, bool, Callable[[], bytes]]]:
        if zipfile.is_zipfile(io.BytesIO(content)):
            with zipfile.ZipFile(io.BytesIO(content)) as z:
                for m in z.infolist():
                    if not m.is_dir():
                        yield m.filename, m.file_size, (m.external_attr >> 28) == 0xA, lambda m=m: z.read(m)
        else:
            with tarfile.open(fileobj=io.BytesIO(content)) as t:
                for m in t:
                    if not m.isdir():
                        yield m.name, m.size, not m.isfile(), lambda m=m: t.extractfile(m).read()

    def batches(parts: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for part in parts:
            for path, content in zip(part["path"], part["content"], strict=True):
                taken, room, rows = 0, MOST_BYTES, []
                try:
                    for name, size, link, read in members(content):
                        why = left_out(name, size, link) or ("too many" if taken >= MOST_FILES else "too large" if size > room else None)
                        if why is None:
                            taken, room = taken + 1, room - size
                        rows.append((path, name, size, read() if why is None else None, why))
                except (tarfile.TarError, zipfile.BadZipFile, OSError) as e:
                    rows.append((path, None, None, None, f"unreadable: {e}"))
                yield pd.DataFrame(rows, columns=["archive", "name", "size", "content", "skipped"])

    return files.select("path", "content").mapInPandas(batches, "archive string, name string, size long, content binary, skipped string")


def files_to_ingest(files: DataFrame, ready: DataFrame, force: bool = False) -> DataFrame:
    """(doc_id, path) of files named doc_<id>.<ext> whose document isn't ready yet."""
    named = files.withColumn("doc_id", F.regexp_extract("path", r"/(doc_[0-9a-z]+)\.[^./]+$", 1)).where("doc_id != ''").select("doc_id", "path")
    return named if force else named.join(ready.select("doc_id"), "doc_id", "left_anti")


def merge_visual_lines(lines: list[str]) -> list[str]:
    """Lines of a printed page joined to paragraphs: a line goes on the one before if that has no closing mark and is at least
    three quarters as long as the 75th percentile; bullets start anew; CJK joins without a space."""
    lines = [x.strip() for x in lines if x.strip()]
    if not lines:
        return []
    typical, out = sorted(map(len, lines))[min(int(len(lines) * 0.75), len(lines) - 1)], []
    for line, before in zip(lines, [None, *lines], strict=False):
        bullet = re.match(r"([-*•·●▪◦]|\(?\d+[.)、])\s*\S", line)
        if before and not bullet and before[-1] not in "。！？；：.!?;:" and len(before) >= 0.75 * typical:
            cjk = all("㐀" <= c <= "鿿" for c in (before[-1], line[0]))
            out[-1] += ("" if cjk else " ") + line
        else:
            out.append(line)
    return out


def merge_lines(lines: DataFrame, keys: list[str], order: str = "line_no", line: str = "line") -> DataFrame:
    """(keys, paragraph, text): as :func:`merge_visual_lines`, of the lines of many pages at once; paragraphs count from 0 per page."""
    text = F.regexp_replace(line, r"^\s+|\s+$", "")
    rows = lines.select(*keys, order, text.alias("__line")).where("__line != ''").withColumn("__size", F.length("__line"))
    page = Window.partitionBy(*keys)
    place = F.row_number().over(page.orderBy("__size", order))
    n = F.count("*").over(page)
    rows = rows.withColumn("__place", place).withColumn("__n", n)
    typical = F.max(F.when(F.col("__place") == F.least(F.floor(F.col("__n") * 0.75), F.col("__n") - 1) + 1, F.col("__size"))).over(page)
    rows = rows.withColumn("__typical", typical).withColumn("__before", F.lag("__line").over(page.orderBy(order)))
    goes_on = (
        F.col("__before").isNotNull()
        & ~F.rlike("__line", F.lit(r"^([-*•·●▪◦]|\(?\d+[.)、])\s*\S"))
        & ~F.rlike("__before", F.lit("[。！？；：.!?;:]$"))
        & (F.length("__before") >= F.col("__typical") * 0.75)
    )
    tight = F.rlike("__before", F.lit("[㐀-鿿]$")) & F.rlike("__line", F.lit("^[㐀-鿿]"))
    rows = rows.withColumn("__on", goes_on).withColumn("__piece", F.when(F.col("__on") & ~tight, F.concat(F.lit(" "), "__line")).otherwise(F.col("__line")))
    starts = F.sum((~F.col("__on")).cast("int")).over(page.orderBy(order).rowsBetween(Window.unboundedPreceding, 0)) - 1
    pieces = F.transform(F.array_sort(F.collect_list(F.struct(order, "__piece"))), lambda x: x["__piece"])
    return rows.withColumn("paragraph", starts.cast("int")).groupBy(*keys, "paragraph").agg(F.array_join(pieces, "").alias("text"))


def looks_scanned(pages: DataFrame, doc: str) -> DataFrame:
    """(doc, scanned) from page statistics (chars, junk, cid, unmapped: ratios): means weighted by length."""
    weight = F.greatest(F.sum("chars"), F.lit(1))
    mean = {c: F.sum(F.col(c) * F.col("chars")) / weight for c in ("junk", "cid", "unmapped")}
    return pages.groupBy(doc).agg(((F.avg("chars") < 8) | (mean["junk"] > 0.4) | (mean["cid"] > 0.05) | (mean["unmapped"] > 0.5)).alias("scanned"))
