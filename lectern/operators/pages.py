"""Whole-section pages of markdown documents, their outline, and the pages that chunks belong to.

:func:`paginate` works within a document's row, by built-in expressions; only pages that are too long go through a Python function.
"""

from __future__ import annotations

import math
import re

import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.text import CJK, let, tokens_of, trimmed, weight
from .blocks import segments

WHOLE = "全文"
# Fixed value: what follows the title of a page that continues another.
CONTINUED = ("（续", "）")
_CJK, _ROW = re.compile(f"[{CJK}]"), re.compile(r"\s*\|.*\|\s*")


def split_levels(found: DataFrame) -> DataFrame:
    """(id, split_level): the shallowest level with two headings or more, else the shallowest."""
    counted = found.groupBy("id", "level").agg(F.count("*").alias("n"))
    return counted.groupBy("id").agg(F.coalesce(F.min(F.when(F.col("n") >= 2, F.col("level"))), F.min("level")).alias("split_level"))


def cut_pages(lines: DataFrame, found: DataFrame) -> DataFrame:
    """(id, page_index, title, content): a page starts at each heading of the split level; what stands before the first belongs to it;
    documents without headings are one page."""
    cuts = found.join(split_levels(found), "id").where("level = split_level").select("id", "line_no", "title")
    marked = lines.join(cuts, ["id", "line_no"], "left")
    page = F.greatest(F.sum(F.col("title").isNotNull().cast("int")).over(Window.partitionBy("id").orderBy("line_no")), F.lit(1))
    body = F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("line_no", "line"))), lambda x: x["line"]), "\n")
    pages = marked.withColumn("page_index", page).groupBy("id", "page_index").agg(
        F.coalesce(F.min_by("title", F.when(F.col("title").isNotNull(), F.col("line_no"))), F.lit(WHOLE)).alias("title"), trimmed(body).alias("content")
    )
    return pages.where("content != ''")


def outline(pages: DataFrame) -> DataFrame:
    """(id, outline): numbered titles in order."""
    line = F.struct("page_index", F.concat(F.col("page_index").cast("string"), F.lit(". "), F.col("title")).alias("line"))
    return pages.groupBy("id").agg(F.array_join(F.transform(F.array_sort(F.collect_list(line)), lambda x: x["line"]), "\n").alias("outline"))


def chunk_pages(chunks: DataFrame, pages: DataFrame) -> DataFrame:
    """(chunk_id, page_index): the page whose heading path is the longest prefix of the chunk's, the first on ties, and the
    document's first page if none is. Each prefix of a chunk's path is looked up by equality, so pages aren't compared in pairs."""
    prefixes = F.transform(F.sequence(F.lit(1), F.size("heading_path")), lambda n: F.slice("heading_path", F.lit(1), n))
    some = F.when(F.size("heading_path") > 0, prefixes).otherwise(F.array().cast("array<array<string>>"))
    looked = chunks.select("id", "chunk_id", F.explode(some).alias("path"))
    known = pages.where(F.size("heading_path") > 0).groupBy("id", F.col("heading_path").alias("path")).agg(F.min("page_index").alias("page_index"))
    best = looked.join(known, ["id", "path"]).groupBy("chunk_id").agg(F.max_by("page_index", F.size("path")).alias("page_index"))
    first = pages.groupBy("id").agg(F.min("page_index").alias("first_page"))
    return chunks.select("id", "chunk_id").join(best, "chunk_id", "left").join(first, "id", "left").select("chunk_id", F.coalesce("page_index", "first_page").alias("page_index"))


def estimate(text: str) -> int:
    """What :func:`lectern.functions.text.estimate_tokens` gives, of one string."""
    cjk = len(_CJK.findall(text))
    return cjk + math.ceil((len(text.encode("utf-16-le")) // 2 - cjk) / 4)


def cut_by_budget(text: str, budget: int) -> list[str]:
    """Pieces of at most ``budget`` tokens: a CJK character weighs 1, any other a quarter. No character is split or lost."""
    out, start, weight = [], 0, 0.0
    for at, char in enumerate(text):
        own = 1.0 if _CJK.match(char) else 0.25
        if weight + own > budget and at > start:
            out.append(text[start:at])
            start, weight = at, 0.0
        weight += own
    return [*out, text[start:]]


def _filled(pieces: list[str], glue: str, budget: int) -> list[str]:
    """Neighbouring pieces joined until they hold ``budget`` tokens or more."""
    out, start = [], 0
    for end in range(1, len(pieces) + 1):
        if end == len(pieces) or estimate(glue.join(pieces[start:end])) >= budget:
            out.append(glue.join(pieces[start:end]))
            start = end
    return out


def _by_sections(text: str, level: int, budget: int) -> list[str]:
    """Sections under sub-headings, neighbours joined while they stay within ``budget``."""
    starts = [m.start() for m in re.finditer(rf"(?m)^#{{{level + 1}}}\s+\S", text)]
    edges = [0, *starts[1:], len(text)] if len(starts) > 1 else []
    out, room = [], 0
    for section in filter(None, (text[a:z].strip() for a, z in zip(edges, edges[1:], strict=False))):
        need = estimate(section)
        if out and need <= room:
            out[-1], room = f"{out[-1]}\n\n{section}", room - need
        else:
            out.append(section)
            room = budget - need
    return out


def _by_rows(lines: list[str], table: range, budget: int) -> list[str]:
    """The rows of a table, each part under its two header lines and what leads in, which stands by itself where it leaves the rows
    less than a hundred tokens or three tenths of the budget."""
    lead, header = ("\n".join(x) for x in (lines[: table.start], lines[table.start : table.start + 2]))
    rest = budget - estimate(header)
    apart = bool(lead) and rest - estimate(lead) < max(100, int(budget * 0.3))
    top = "\n".join(filter(None, [None if apart else lead, header]))
    packs = _filled(lines[table.start + 2 : table.stop], "\n", max(1, rest if apart else rest - estimate(lead)))
    after = "\n".join(lines[table.stop :]).strip()
    return [*([lead] if apart else []), *(f"{top}\n{p}".strip() for p in packs), *([after] if after else [])]


def shrink(text: str, budget: int, level: int, depth: int = 0) -> list[str]:
    """Parts of a page that is too long: by sub-headings, else by the rows of its first table, else at blank lines, else by weight."""
    if estimate(text) <= budget or depth > 10:
        return [text]
    parts = _by_sections(text, level, budget)
    if not parts:
        lines = text.split("\n")
        found = re.search("r{3,}", "".join("r" if _ROW.fullmatch(x) else "." for x in lines))
        if found:
            parts = _by_rows(lines, range(*found.span()), budget)
        else:
            parts = [p.strip() for p in _filled(re.split(r"\n\s*\n", text), "\n\n", budget)]
            if len(parts) == 1:
                parts = cut_by_budget(parts[0], budget)
    return [text] if len(parts) <= 1 else [piece for part in parts for piece in shrink(part, budget, level, depth + 1)]


def sections(text: Column) -> Column:
    """(level, pages) as a struct: the level at which a document is cut, and its sections there as array<struct<title, content, path, weight>>.
    The first holds what stands before it. A text without headings is one page."""
    def weighed(title: Column, content: Column, path: Column) -> Column:
        return let(content, lambda c: F.struct(title.alias("title"), c.alias("content"), path.alias("path"), weight(c).alias("weight")))

    whole = weighed(F.lit(WHOLE), trimmed(text), F.array().cast("array<string>"))
    place = "array<struct<place:int,title:string,path:array<string>>>"

    def levelled(parts: Column) -> Column:
        levels = F.filter(F.transform(parts, lambda s: s["level"]), lambda n: n > 0)
        repeated = F.filter(F.sequence(F.lit(1), F.lit(6)), lambda k: F.size(F.filter(levels, lambda n: n == k)) >= 2)
        return let(F.struct(parts.alias("parts"), F.coalesce(F.array_min(repeated), F.array_min(levels)).alias("level")), cut)

    def cut(x: Column) -> Column:
        heads = F.filter(F.transform(x["parts"], lambda s, i: F.struct(i.alias("place"), s["level"].alias("level"), s["title"].alias("title"))), lambda h: (h["level"] > 0) & (h["level"] <= x["level"]))
        start = F.struct(F.array().cast("array<struct<level:int,title:string>>").alias("stack"), F.array().cast(place).alias("cuts"))

        def step(s: Column, h: Column) -> Column:
            stack = F.concat(F.filter(s["stack"], lambda t: t["level"] < h["level"]), F.array(F.struct(h["level"].alias("level"), h["title"].alias("title"))))

            def then(stack: Column) -> Column:
                here = F.array(F.struct(h["place"].alias("place"), h["title"].alias("title"), F.transform(stack, lambda t: t["title"]).alias("path")))
                return F.struct(stack.alias("stack"), F.when(h["level"] == x["level"], F.concat(s["cuts"], here)).otherwise(s["cuts"]).alias("cuts"))

            return let(stack, then)

        return let(F.aggregate(heads, start, step, lambda s: s["cuts"]), lambda cuts: pages(x, cuts))

    def pages(x: Column, cuts: Column) -> Column:
        def page(c: Column, i: Column) -> Column:
            first = F.when(i == 0, 0).otherwise(c["place"])
            last = F.coalesce(F.get(cuts, i + 1)["place"], F.size(x["parts"]))
            raw = F.array_join(F.transform(F.slice(x["parts"], first + 1, last - first), lambda s: s["raw"]), "")
            return weighed(c["title"], trimmed(raw), c["path"])

        found = F.when(x["level"].isNull(), F.array(whole)).otherwise(F.transform(cuts, page))
        return F.struct(F.coalesce(x["level"], F.lit(0)).alias("level"), F.filter(found, lambda p: p["content"] != "").alias("pages"))

    return let(segments(text), levelled)


def size_of(page: Column) -> Column:
    """A page's tokens, from its weight."""
    return tokens_of(page["weight"]["c"], page["weight"]["u"])


def merge_short(pages: Column, least: int) -> Column:
    """Pages below ``least`` tokens join the next one, the last one the page before; the longer side gives title and path. A page is
    weighed once: weights add up."""
    none = F.filter(pages, lambda p: F.lit(False))

    def joined(a: Column, b: Column) -> Column:
        larger = size_of(b) > size_of(a)
        weight = F.struct((a["weight"]["c"] + b["weight"]["c"]).alias("c"), (a["weight"]["u"] + b["weight"]["u"] + 2).alias("u"))
        title, path = (F.when(larger, b[c]).otherwise(a[c]).alias(c) for c in ("title", "path"))
        return F.struct(title, F.concat(a["content"], F.lit("\n\n"), b["content"]).alias("content"), path, weight.alias("weight"))

    def short(p: Column) -> Column:
        return size_of(p) < least

    def step(s: Column, p: Column) -> Column:
        grows = s["now"].isNotNull() & short(s["now"])
        done = F.when(s["now"].isNull() | grows, s["done"]).otherwise(F.concat(s["done"], F.array(s["now"])))
        return F.struct(done.alias("done"), F.when(grows, joined(s["now"], p)).otherwise(p).alias("now"))

    def finish(s: Column) -> Column:
        back = F.array(joined(F.element_at(s["done"], -1), s["now"]))
        ends = (F.size(s["done"]) > 0) & short(s["now"])
        return F.when(s["now"].isNull(), s["done"]).when(ends, F.concat(F.slice(s["done"], F.lit(1), F.size(s["done"]) - 1), back)).otherwise(F.concat(s["done"], F.array(s["now"])))

    return F.aggregate(pages, F.struct(none.alias("done"), F.get(none, F.lit(0)).alias("now")), step, finish)


def numbered(pages: Column) -> Column:
    """Pages that continue one numbered by title, as real titles leave room."""
    mark, end = map(F.lit, CONTINUED)

    def taking(real: Column) -> Column:
        def named(p: Column, i: Column) -> Column:
            nth = F.size(F.filter(F.slice(pages, F.lit(1), i + 1), lambda x: x["continued"] & (x["title"] == p["title"])))
            free = F.filter(F.sequence(F.lit(1), nth + F.size(real)), lambda k: ~F.array_contains(real, F.concat(p["title"], mark, k.cast("string"), end)))
            title = F.concat(p["title"], mark, F.get(free, nth - 1).cast("string"), end)
            return F.when(p["continued"], p.withField("title", title)).otherwise(p)

        return F.transform(pages, named)

    return let(F.array_distinct(F.transform(F.filter(pages, lambda p: ~p["continued"]), lambda p: p["title"])), taking)


def paginate(docs: DataFrame, *, id_col: str = "doc_id", text_col: str = "text", most: int = 8000, least: int = 300) -> DataFrame:
    """(id, page_index, title, content, heading_path, continued): pages of each document, numbered from 1. Nothing is shuffled."""

    @F.pandas_udf("array<array<string>>")
    def shrunk(texts: pd.Series, levels: pd.Series) -> pd.Series:
        return pd.Series([[None if t is None else shrink(t, most, level) for t in held] for held, level in zip(texts, levels, strict=True)])

    rows = docs.select(F.col(id_col).cast("long").alias("id"), sections(F.coalesce(F.col(text_col), F.lit(""))).alias("s"))
    kept = merge_short(F.col("s.pages"), least) if least > 0 else F.col("s.pages")
    rows = rows.select("id", "s.level", kept.alias("pages"))
    # only what is too long goes to Python
    rows = rows.withColumn("parts", shrunk(F.transform("pages", lambda p: F.when(size_of(p) > most, p["content"])), "level"))

    def of_page(p: Column, i: Column) -> Column:
        parts = F.coalesce(F.get("parts", i), F.array(p["content"]))
        return F.transform(parts, lambda c, k: F.struct(p["title"].alias("title"), c.alias("content"), p["path"].alias("heading_path"), (k > 0).alias("continued")))

    rows = rows.select("id", F.flatten(F.transform("pages", of_page)).alias("pages"))
    rows = rows.select("id", F.posexplode(numbered(F.col("pages"))).alias("place", "p"))
    return rows.select("id", (F.col("place") + 1).alias("page_index"), "p.*")
