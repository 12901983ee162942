"""Markdown structure: blocks, headings, chunks.

All of it is built-in expressions within a document's row: a regular expression parts the text into blocks, and a fold over these
makes the chunks. So nothing is shuffled and no text leaves the JVM.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.text import SPACE, chunk_id, estimate_tokens, let, pack, sentences, trimmed
from . import tables

# What starts a fence, what a heading and a table's row look like; blanks are white space within a line.
BLANK = f"[{SPACE}&&[^\\n]]"
FENCE = "```|~~~"
HEADING = rf"#{{1,6}}{BLANK}+[^{SPACE}].*"
ROW = rf"{BLANK}*\|.*\|{BLANK}*"
#: A fence ends at the mark that opened it, or with the text. Loops over lines are possessive, so long texts need no stack.
FENCED = rf"^{BLANK}*({FENCE}).*(?:\n(?!{BLANK}*\1).*)*+(?:\n{BLANK}*\1.*)?"
PARAGRAPH_LINE = rf"^(?!{BLANK}*(?:{FENCE})|{HEADING}|{ROW}$).*[^{SPACE}].*$"
BLOCK = rf"(?dm){FENCED}|^{HEADING}$|(?:^{ROW}$\n?)++|(?:{PARAGRAPH_LINE}\n?)++"
SEGMENT = rf"(?dm){FENCED}\n?|^.*\n|^.+"


def lines_as_one(text: Column) -> Column:
    """Line ends as \\n."""
    return F.regexp_replace(text, r"\r\n?", "\n")


def segments(text: Column) -> Column:
    """array<struct<raw, level, title>>: a text's lines with their ends, each fenced block as one; ``level`` is 0 but for headings.
    All of ``raw`` together are the text."""

    def segment(raw: Column) -> Column:
        line = F.regexp_extract(raw, rf"^({HEADING})\n?$", 1)
        title = trimmed(F.regexp_replace(line, "^#+", ""))
        head = F.struct(raw.alias("raw"), F.length(F.regexp_extract(line, "^#*", 0)).alias("level"), title.alias("title"))
        return F.when(F.startswith(raw, F.lit("#")), head).otherwise(F.struct(raw.alias("raw"), F.lit(0).alias("level"), F.lit("").alias("title")))

    return F.transform(F.regexp_extract_all(lines_as_one(text), F.lit(SEGMENT), F.lit(0)), segment)


def headings(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Headings outside fences: (id, line_no, level, title)."""
    parts = docs.select(F.col(id_col).alias("id"), F.posexplode(segments(F.col(text_col))).alias("place", "s"))
    before = Window.partitionBy("id").orderBy("place").rowsBetween(Window.unboundedPreceding, -1)
    line_no = F.coalesce(F.sum(F.regexp_count("s.raw", F.lit(r"\n"))).over(before), F.lit(0)).cast("int")
    return parts.select("id", line_no.alias("line_no"), "s.level", "s.title").where("level > 0")


def lines_of(docs: DataFrame, id_col: str, text_col: str) -> DataFrame:
    """(id, line_no, line), line ends normalised."""
    return docs.select(F.col(id_col).alias("id"), F.posexplode(F.split(lines_as_one(F.col(text_col)), "\n")).alias("line_no", "line"))


def heading_paths(found: DataFrame, deepest: int = 6) -> DataFrame:
    """``headings`` with ``path``: the titles above and at each heading. A title stands until one of its level or above."""
    so_far = Window.partitionBy("id").orderBy("line_no").rowsBetween(Window.unboundedPreceding, 0)
    parts = []
    for level in range(1, deepest + 1):
        latest = F.max(F.when(F.col("level") == level, F.struct("line_no", "title"))).over(so_far)
        above = F.max(F.when(F.col("level") < level, F.col("line_no"))).over(so_far)
        stands = (level <= F.col("level")) & (latest["line_no"] > F.coalesce(above, F.lit(-1)))
        parts.append(F.when(stands, latest["title"]))
    return found.withColumn("path", F.array_compact(F.array(*parts)))


def blocks(text: Column) -> Column:
    """array<struct<kind, text, size, level, title>> in order: code, heading, table or para; ``size`` in tokens."""

    def block(raw: Column) -> Column:
        kind = F.when(F.rlike(raw, F.lit(rf"^{BLANK}*(?:{FENCE})")), "code").when(F.rlike(raw, F.lit(rf"^(?d:{HEADING})$")), "heading")
        kind = kind.when(F.rlike(raw, F.lit(rf"(?d)^{ROW}(?:\n|$)")), "table").otherwise("para")
        return let(F.struct(kind.alias("kind"), raw.alias("raw")), told)

    def told(x: Column) -> Column:
        body = F.when(x["kind"] == "code", x["raw"]).when(x["kind"] == "table", F.regexp_replace(x["raw"], r"\n$", "")).otherwise(trimmed(x["raw"]))
        return let(F.struct(x["kind"].alias("kind"), body.alias("text")), measured)

    def measured(x: Column) -> Column:
        head = x["kind"] == "heading"
        level = F.when(head, F.length(F.regexp_extract(x["text"], "^#*", 0))).otherwise(0)
        title = F.when(head, trimmed(F.regexp_replace(x["text"], "^#+", ""))).otherwise("")
        return F.struct(x["kind"].alias("kind"), x["text"].alias("text"), estimate_tokens(x["text"]).alias("size"), level.alias("level"), title.alias("title"))

    return F.transform(F.regexp_extract_all(lines_as_one(text), F.lit(BLOCK), F.lit(0)), block)


def overlap_tail(text: Column, budget: int) -> Column:
    """Sentences from the end within ``budget``, one at least; nothing for a budget of 0."""
    start = F.struct(F.lit("").alias("tail"), F.lit(False).alias("full"))

    def step(s: Column, piece: Column) -> Column:
        more = F.concat(piece, s["tail"])
        full = s["full"] | ((s["tail"] != "") & (estimate_tokens(more) > budget))
        return let(full, lambda f: F.struct(F.when(f, s["tail"]).otherwise(more).alias("tail"), f.alias("full")))

    return F.aggregate(F.reverse(sentences(text)), start, step, lambda s: trimmed(s["tail"])) if budget > 0 else F.lit("")


def _piece(how: str, text: Column, size: Column, level: Column | int = 0, title: Column | str = "", packs: Column | None = None) -> Column:
    """A part that the fold of :func:`chunks` takes; ``how`` says what becomes of it. All packs of a table's rows are one."""
    of = {"level": level, "title": title, "packs": F.lit(None).cast("array<string>") if packs is None else packs}
    return F.struct(F.lit(how).alias("how"), text.alias("text"), size.alias("size"), *[(v if isinstance(v, Column) else F.lit(v)).alias(k) for k, v in of.items()])


def table_pieces(text: Column, target: int, most: int, summary: bool) -> Column:
    """A table's overview and its packs of rows; the table itself if it has no row."""
    lines = F.filter(F.split(text, "\n"), lambda x: F.rlike(x, F.lit(f"[^{SPACE}]")))
    parted = F.rlike(F.get(lines, F.lit(1)), F.lit(r"-")) & (F.regexp_replace(F.get(lines, F.lit(1)), f"[{SPACE}|:-]", "") == "")
    head = F.when(F.coalesce(parted, F.lit(False)), 2).otherwise(1)

    def pieces(x: Column) -> Column:
        rows = F.slice(x["lines"], x["head"] + 1, F.greatest(F.size(x["lines"]) - x["head"], F.lit(0)))
        table = F.struct(F.array_join(F.slice(x["lines"], F.lit(1), x["head"]), "\n").alias("top"), tables.cells_of(F.get(x["lines"], F.lit(0))).alias("header"), rows.alias("rows"), F.transform(rows, tables.cells_of).alias("cells"))
        return let(table, packs)

    def packs(t: Column) -> Column:
        groups = let(tables.group_index(t["cells"]), lambda g: F.when(g >= 0, F.transform(t["cells"], lambda r: F.coalesce(F.get(r, g), F.lit("")))))
        packed = F.array(_piece("rows", F.lit(""), F.lit(0).cast("long"), packs=tables.pack_rows(t["rows"], groups, t["top"], target, most)))
        told = F.array(_piece("overview", tables.overview_text(t["header"], t["cells"]), F.lit(0).cast("long")))
        every = F.concat(F.filter(told, lambda p: p["text"].isNotNull()), packed) if summary else packed
        return F.when(F.size(t["rows"]) > 0, every).otherwise(F.array(_piece("rows", F.lit(""), F.lit(0).cast("long"), packs=F.array(text))))

    return let(F.struct(lines.alias("lines"), head.alias("head")), pieces)


_STATE = "struct<done:array<struct<content:string,chunk_type:string,heading_path:array<string>,is_table_row:boolean>>,stack:array<struct<level:int,title:string>>,text:string,kinds:int,size:bigint,body:boolean>"
_TEXT, _TABLE, _CODE = 1, 2, 4


def chunks(text: Column, title: Column, *, target: int = 700, most: int = 800, overlap: int = 80, row_mode: bool = False, summary: bool = True) -> Column:
    """array<struct<content, chunk_type, heading_path, is_table_row>> of a markdown text.

    A chunk gathers blocks under its headings up to ``target`` tokens; a new heading starts another. Paragraphs over ``most`` are cut
    at sentences, tables and code over it stand alone, whole. Where text runs on from one chunk to the next, about ``overlap`` tokens
    are repeated. In ``row_mode`` tables are packs of rows under their header, with an overview before them.
    """

    def pieces(b: Column) -> Column:
        whole = F.array(_piece("text", b["text"], b["size"]))
        cut = F.transform(pack(sentences(b["text"]), target), lambda s: _piece("text", s, estimate_tokens(s)))
        out = F.when(b["kind"] == "heading", F.array(_piece("heading", b["text"], b["size"], b["level"], b["title"]))).when(b["kind"] == "para", F.when(b["size"] > most, cut).otherwise(whole))
        if row_mode:
            out = out.when(b["kind"] == "table", table_pieces(b["text"], target, most, summary))
        for kind in ("table", "code"):
            out = out.when(b["kind"] == kind, F.when(b["size"] > most, F.array(_piece(f"whole {kind}", b["text"], b["size"]))).otherwise(F.array(_piece(kind, b["text"], b["size"]))))
        return out

    def state(**fields: Column) -> Column:
        return F.struct(*[fields[k].alias(k) for k in ("done", "stack", "text", "kinds", "size", "body")])

    def chunk(s: Column, content: Column, kind: Column, is_row: bool) -> Column:
        path = F.transform(s["stack"], lambda x: x["title"])
        return F.array(F.struct(content.alias("content"), kind.alias("chunk_type"), path.alias("heading_path"), F.lit(is_row).alias("is_table_row")))

    def flushed(s: Column, carry: bool = False) -> Column:
        kind = F.when(s["kinds"] == _TABLE, "table").when(s["kinds"] == _CODE, "code").otherwise("text")

        def out(content: Column) -> Column:
            tail = F.when((kind == "text") & (content != ""), F.nullif(overlap_tail(content, overlap), F.lit(""))) if carry else F.lit(None).cast("string")
            done = F.when(content == "", s["done"]).otherwise(F.concat(s["done"], chunk(s, content, kind, False)))
            return let(tail, lambda t: state(done=done, stack=s["stack"], text=t, kinds=F.when(t.isNull(), 0).otherwise(_TEXT), size=F.coalesce(estimate_tokens(t), F.lit(0).cast("long")), body=F.lit(False)))

        return let(trimmed(F.coalesce(s["text"], F.lit(""))), out)

    def alone(s: Column, contents: Column, kind: str, is_row: bool) -> Column:
        path = F.transform(s["stack"], lambda x: x["title"])
        held = F.filter(F.transform(contents, trimmed), lambda c: c != "")
        each = F.transform(held, lambda c: F.struct(c.alias("content"), F.lit(kind).alias("chunk_type"), path.alias("heading_path"), F.lit(is_row).alias("is_table_row")))
        done = F.concat(s["done"], each)
        return state(done=done, stack=s["stack"], text=F.lit(None).cast("string"), kinds=F.lit(0), size=F.lit(0).cast("long"), body=F.lit(False))

    def added(s: Column, p: Column, kind: int, body: bool) -> Column:
        stack = s["stack"] if body else F.concat(F.filter(s["stack"], lambda x: x["level"] < p["level"]), F.array(F.struct(p["level"].alias("level"), p["title"].alias("title"))))
        kinds = F.when(F.rlike(p["text"], F.lit(f"[^{SPACE}]")), s["kinds"].bitwiseOR(F.lit(kind))).otherwise(s["kinds"])
        return state(done=s["done"], stack=stack, text=F.concat_ws("\n\n", s["text"], p["text"]), kinds=kinds, size=s["size"] + p["size"], body=F.lit(True) if body else s["body"])

    def standing(p: Column, kind: str) -> Callable[[Column], Column]:
        return lambda s: alone(s, F.array(p["text"]), kind, False)

    def adding(p: Column, kind: int) -> Callable[[Column], Column]:
        return lambda s: added(s, p, kind, True)

    def step(s: Column, p: Column) -> Column:
        def freed(carry: bool, full: Column) -> Column:
            return F.when(full, flushed(s, carry)).otherwise(s)

        over = s["body"] & (s["size"] + p["size"] > target)
        above = F.coalesce(F.element_at(F.transform(s["stack"], lambda x: x["title"]), F.when(F.size(s["stack"]) > 0, -1)), title)
        headed = F.when(p["how"] == "overview", F.concat(F.when(above != "", F.concat(above, F.lit(" — "))).otherwise(""), p["text"])).otherwise(p["text"])
        out = F.when(p["how"] == "heading", let(freed(False, s["body"]), lambda t: added(t, p, _TEXT, False)))
        out = out.when(p["how"].isin("rows", "overview"), let(freed(False, s["body"]), lambda t: alone(t, F.coalesce(p["packs"], F.array(headed)), "table", True)))
        for kind in ("table", "code"):
            out = out.when(p["how"] == f"whole {kind}", let(freed(False, s["text"].isNotNull()), standing(p, kind)))
        for kind, bit in (("text", _TEXT), ("table", _TABLE), ("code", _CODE)):
            out = out.when(p["how"] == kind, let(freed(True, over), adding(p, bit)))
        return out

    start = F.from_json(F.lit('{"done": [], "stack": [], "kinds": 0, "size": 0, "body": false}'), _STATE)
    return F.aggregate(F.flatten(F.transform(blocks(text), pieces)), start, step, lambda s: F.when(s["body"], flushed(s)["done"]).otherwise(s["done"]))


def chunk_markdown(docs: DataFrame, *, id_col: str = "doc_id", text_col: str = "text", title: Column | None = None, **options) -> DataFrame:
    """Chunks of each document with their ids and their neighbours' ids; see :func:`chunks` for the options."""
    made = chunks(F.coalesce(F.col(text_col), F.lit("")), title if title is not None else F.lit(""), **options)

    def placed(m: Column) -> Column:
        return F.transform(m, lambda x, i: F.struct(i.alias("chunk_index"), (i + 1 < F.size(m)).alias("more"), x.alias("x")))

    # each chunk knows whether another follows, so that rows don't carry all of them
    rows = docs.select(F.col(id_col).cast("long").alias("id"), F.explode(let(made, placed)).alias("p")).select("id", "p.chunk_index", "p.more", "p.x.*")
    i, index = F.col("id"), F.col("chunk_index")
    return rows.select(
        "id", "chunk_index", "content", "chunk_type", "heading_path", "is_table_row", estimate_tokens(F.col("content")).cast("int").alias("token_estimate"),
        chunk_id(i, index).alias("chunk_id"), F.when(index > 0, chunk_id(i, index - 1)).alias("prev_chunk_id"), F.when(F.col("more"), chunk_id(i, index + 1)).alias("next_chunk_id"),
    )


def apply_inserts(docs: DataFrame, inserts: DataFrame, *, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Headings put before numbered blocks: inserts (id, before, level, title); the first per place, none before a heading."""
    parts = F.filter(F.transform(F.split(F.regexp_replace(text_col, r"\r\n?", "\n"), r"\n\s*\n"), lambda b: F.regexp_replace(b, r"^\s+|\s+$", "")), lambda b: b != "")
    numbered = docs.select(F.col(id_col).alias("id"), F.posexplode(parts).alias("before", "block"))
    valid = inserts.where("trim(title) != ''").withColumn("level", F.when(F.col("level") == 3, 3).otherwise(2))
    first = valid.groupBy("id", "before").agg(F.min_by(F.struct("level", "title"), "place").alias("head"))
    rows = numbered.join(first, ["id", "before"], "left")
    heads = F.col("head").isNotNull() & ~F.rlike("block", F.lit(r"^#{1,6}\s"))
    text = F.when(heads, F.concat(F.repeat(F.lit("#"), F.col("head.level")), F.lit(" "), F.trim("head.title"), F.lit("\n\n"), F.col("block"))).otherwise(F.col("block"))
    return rows.select("id", "before", text.alias("block")).groupBy("id").agg(
        F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("before", "block"))), lambda x: x["block"]), "\n\n").alias("markdown")
    )
