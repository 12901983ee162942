"""Text functions: token estimates, truncation, splitting, citations. All are Column expressions; only a dictionary needs Python at run time."""

from __future__ import annotations

import re
from collections.abc import Callable, Sequence

from pyspark.sql import Column
from pyspark.sql import functions as F

# The characters that count as one token each, as first and last code points.
CJK_RANGES = ((0x3400, 0x9FFF), (0xF900, 0xFAFF), (0x3040, 0x30FF), (0xFF00, 0xFFEF))
CJK = "".join(f"{chr(a)}-{chr(z)}" for a, z in CJK_RANGES)
# What counts as white space, for use within brackets.
SPACE = r"\s\u00A0\u1680\u2000-\u200A\u2028\u2029\u202F\u205F\u3000\uFEFF"
# C1 controls, private use, the replacement character.
JUNK_RANGES = ((0x80, 0x9F), (0xE000, 0xF8FF), (0xFFFD, 0xFFFD))
JUNK = "[" + "".join(f"{chr(a)}-{chr(z)}" for a, z in JUNK_RANGES) + "]"
ASTRAL = r"[\x{10000}-\x{10FFFF}]"
# Codes such as GSP-9050MBE, v1.2.0 or 12ab. A code that starts inside a run starts at its last digit before a letter,
# so the other two kinds are only tried where a run starts, and no run is read more than once.
CODE = r"(?<![A-Za-z0-9])(?:[A-Za-z0-9]++(?:[-./][A-Za-z0-9]++)+|[A-Za-z]++\d[A-Za-z0-9]*+)|\d[A-Za-z][A-Za-z0-9]*+"
# A citation mark, [1] or [1, 2].
CITATION = r"\[\s*(\d+(?:\s*[,，、\s]\s*\d+)*)\s*\]"


def let(value: Column, then: Callable[[Column], Column]) -> Column:
    """``then(value)`` with the value computed once per row, however often ``then`` or a lambda in it refers to it."""
    return F.element_at(F.transform(F.array(value), then), 1)


def trimmed(text: Column) -> Column:
    return F.regexp_replace(text, f"^[{SPACE}]+|[{SPACE}]+$", "")


def utf16_length(text: Column) -> Column:
    """Length in UTF-16 units."""
    return F.length(text) + F.regexp_count(text, F.lit(ASTRAL))


def weight(text: Column) -> Column:
    """struct<c, u>: a text's CJK characters, and the UTF-16 units of all others. Weights of parts add up to that of the whole."""
    cjk = F.regexp_count(text, F.lit(f"[{CJK}]"))
    exact = F.struct(cjk.cast("long").alias("c"), (utf16_length(text) - cjk).cast("long").alias("u"))
    length = F.length(text)
    # ASCII needs no look at its characters, and texts without any from the first CJK range on no count of them
    plain = (F.octet_length(text) == length) | ~F.rlike(text, F.lit(f"[{chr(min(a for a, _ in CJK_RANGES))}-\\x{{10FFFF}}]"))
    return F.when(plain, F.struct(F.lit(0).cast("long").alias("c"), length.cast("long").alias("u"))).otherwise(exact)


def tokens_of(c: Column, u: Column) -> Column:
    """The estimate for a text of this weight."""
    return (c + F.ceil(u / 4)).cast("long")


def estimate_tokens(text: Column) -> Column:
    """One token per CJK character, one per four other UTF-16 units, rounded up."""
    return let(weight(text), lambda w: tokens_of(w["c"], w["u"]))


def cut_places(items: Column, ends: Callable[[Column, Column, dict[str, Column]], Column], glue: int) -> Column:
    """array<int>: where greedy packs of ``items`` (array<struct<c, u, group>>, weights of texts that ``glue`` characters join) start
    after the first. ``ends(pack, item, joined)`` says whether a pack ends before an item; ``joined`` is the weight of both.

    A fold over numbers: no text is put together or measured again, and what is done is touched at cuts alone.
    """

    def state(cuts: Column, i: Column, c: Column, u: Column, group: Column) -> Column:
        return F.struct(cuts.alias("cuts"), i.alias("i"), c.alias("c"), u.alias("u"), group.alias("group"))

    def step(s: Column, x: Column) -> Column:
        # spelt out rather than bound once: what a binding returns is copied, and the cuts so far must not be at each item
        joined = {"c": s["c"] + x["c"], "u": s["u"] + x["u"] + glue}
        cut = (s["i"] > 0) & ends(s, x, joined)
        fresh = (s["i"] == 0) | ends(s, x, joined)
        cuts = F.when(cut, F.concat(s["cuts"], F.array(s["i"]))).otherwise(s["cuts"])
        return state(cuts, s["i"] + 1, F.when(fresh, x["c"]).otherwise(joined["c"]), F.when(fresh, x["u"]).otherwise(joined["u"]), x["group"])

    zero = F.lit(0).cast("long")
    return F.aggregate(items, state(F.array().cast("array<int>"), F.lit(0), zero, zero, F.lit(None).cast("string")), step, lambda s: s["cuts"])


def between_cuts(items: Column, cuts: Column, glue: str) -> Column:
    """array<string>: the runs of ``items`` (array<string>) from cut to cut, each joined by ``glue``; none of none."""

    def runs(x: Column) -> Column:
        starts = F.concat(F.array(F.lit(0)), x["cuts"])
        return F.transform(starts, lambda a, i: F.array_join(F.slice(x["items"], a + 1, F.coalesce(F.get(x["cuts"], i), F.size(x["items"])) - a), glue))

    return F.when(F.size(items) > 0, let(F.struct(items.alias("items"), cuts.alias("cuts")), runs)).otherwise(F.array().cast("array<string>"))


def truncate_utf16(text: Column, units: int) -> Column:
    """The longest head of at most ``units`` UTF-16 units that splits no surrogate pair."""
    head = F.left(text, F.lit(units))
    chars = F.split(head, "")

    def step(state: Column, c: Column) -> Column:
        size = state["n"] + F.when(F.rlike(c, F.lit(ASTRAL)), 2).otherwise(1)
        grows = ~state["full"] & (size <= units)
        return F.struct(F.when(grows, F.concat(state["s"], c)).otherwise(state["s"]).alias("s"), F.when(grows, size).otherwise(state["n"]).alias("n"), (~grows).alias("full"))

    start = F.struct(F.lit("").alias("s"), F.lit(0).alias("n"), F.lit(False).alias("full"))
    exact = F.aggregate(chars, start, step, lambda s: s["s"])
    return F.when(F.rlike(head, F.lit(ASTRAL)), exact).otherwise(head)


def code_tokens(text: Column) -> Column:
    """Distinct lower-case codes that hold a letter and a digit, in order of appearance."""
    found = F.transform(F.regexp_extract_all(text, F.lit(CODE), F.lit(0)), lambda x: F.lower(x))
    held = F.array_distinct(F.filter(found, lambda x: (F.length(x) >= 2) & F.rlike(x, F.lit("[a-z]")) & F.rlike(x, F.lit(r"\d"))))
    return F.when(text.isNull() | F.rlike(text, F.lit(r"\d")), held).otherwise(F.array().cast("array<string>"))


def custom_words(listed: str) -> list[str]:
    """The words of a dictionary as one text, parted by commas and white space."""
    return [w for w in re.split(r"[,，\s]+", listed) if w]


def tokens(text: Column, words: Sequence[str] = ()) -> Column:
    """Lower-case runs of letters and of digits, single CJK characters, and the codes once more (they then count twice). The
    ``words`` of a dictionary stay whole where they stand, longer ones first, but not within a run of other letters; an index and its
    queries must share them. Without a dictionary all is built-in expressions; with one, the cut is a trie in Arrow batches."""
    low = F.lower(text)
    if words:
        from .dictionary import cut  # which needs this module's character ranges

        return F.concat(cut(low, words), code_tokens(text))
    plain = F.regexp_extract_all(low, F.lit(r"[0-9]+|\p{L}+"), F.lit(0))
    mixed = F.regexp_extract_all(low, F.lit(rf"[{CJK}]|[0-9]+|[\p{{L}}&&[^{CJK}]]+"), F.lit(0))
    return F.concat(F.when(F.rlike(low, F.lit(f"[{CJK}]")), mixed).otherwise(plain), code_tokens(text))


def sentences(text: Column) -> Column:
    """Pieces that end after any of 。！？!? or a line break, those without content dropped. A full stop ends nothing."""
    return F.filter(F.split(text, r"(?<=[。！？!?\n])"), lambda s: F.rlike(s, F.lit(f"[^{SPACE}]")))


def pack(pieces: Column, target: int) -> Column:
    """Neighbouring pieces joined while their estimate stays within ``target``; each trimmed."""
    weighed = F.transform(pieces, lambda p: let(weight(p), lambda w: F.struct(w["c"].alias("c"), w["u"].alias("u"), F.lit(None).cast("string").alias("group"))))
    cuts = cut_places(weighed, lambda s, x, j: tokens_of(j["c"], j["u"]) > target, 0)
    return F.transform(between_cuts(pieces, cuts, ""), lambda s: F.regexp_replace(s, r"^\s+|\s+$", ""))


def paragraphs(text: Column, most: int = 1000) -> Column:
    """Paragraphs of at most ``most`` code points: sentences (ASCII stops end them too) packed in order, longer ones cut hard."""
    whole = F.regexp_replace(text, r"^\s+|\s+$", "")
    parts = F.regexp_extract_all(whole, F.lit(r"[^。！？；\n.!?]*[。！？；\n.!?]+|[^。！？；\n.!?]+$"), F.lit(0))

    def cut(s: Column) -> Column:
        n = F.greatest(F.ceil(F.length(s) / most), F.lit(1))
        return F.transform(F.sequence(F.lit(0).cast("long"), n - 1), lambda i: F.substring(s, (i * most + 1).cast("int"), F.lit(most)))

    def step(state: Column, s: Column) -> Column:
        long = F.length(s) > most
        full = F.length(state["now"]) + F.length(s) > most
        flush = F.when((state["now"] != "") & (long | full), F.concat(state["done"], F.array(state["now"]))).otherwise(state["done"])
        return F.struct(
            F.when(long, F.concat(flush, cut(s))).otherwise(flush).alias("done"),
            F.when(long, F.lit("")).when((state["now"] != "") & full, s).otherwise(F.concat(state["now"], s)).alias("now"),
        )

    start = F.struct(F.array().cast("array<string>").alias("done"), F.lit("").alias("now"))
    packed = F.aggregate(parts, start, step, lambda s: F.when(s["now"] == "", s["done"]).otherwise(F.concat(s["done"], F.array(s["now"]))))
    packed = F.filter(F.transform(packed, lambda s: F.regexp_replace(s, r"^\s+|\s+$", "")), lambda s: s != "")
    return F.when(whole == "", F.array().cast("array<string>")).when(F.length(whole) <= most, F.array(whole)).otherwise(packed)


def normalise(text: Column) -> Column:
    """White space to single spaces, trimmed, lower case."""
    return F.lower(F.trim(F.regexp_replace(text, r"\s+", " ")))


def covers(text: Column, span: Column) -> Column:
    """Whether a text holds a span: spans of ASCII letters and digits as whole runs, others with all white space ignored."""
    text, span = normalise(text), normalise(span)
    plain = F.rlike(span, F.lit("^[a-z0-9]+$"))
    whole = F.rlike(text, F.concat(F.lit("(^|[^a-z0-9])"), F.when(plain, span).otherwise("x"), F.lit("([^a-z0-9]|$)")))
    return F.when(plain, whole).otherwise(F.contains(F.regexp_replace(text, r"\s+", ""), F.regexp_replace(span, r"\s+", "")))


def cited(answer: Column, most: Column) -> Column:
    """Numbers that an answer's marks cite, within 1 to ``most``, once each in order of appearance."""
    marks = F.regexp_extract_all(answer, F.lit(CITATION), F.lit(1))
    numbers = F.flatten(F.transform(marks, lambda m: F.transform(F.split(m, r"[,，、\s]+"), lambda x: F.try_to_number(x, F.lit("999999999")).cast("int"))))
    return F.array_distinct(F.filter(numbers, lambda n: n.between(F.lit(1), most)))


def without_citations(answer: Column) -> Column:
    """An answer without its marks, and without the spaces that they leave."""
    bare = F.regexp_replace(F.regexp_replace(answer, CITATION, ""), r"[ \t]{2,}", " ")
    return F.regexp_replace(F.regexp_replace(bare, r"[ \t]+([，。；：、！？）】」』])", "$1"), r"^\s+|\s+$", "")


def blank_to_null(text: Column) -> Column:
    return F.nullif(F.trim(text), F.lit(""))


def context_prefix(written: Column, title: Column, path: Column) -> Column:
    """A written prefix if it isn't blank, else 《title》 and the heading path."""
    return F.coalesce(blank_to_null(written), F.array_join(F.concat(F.array(F.concat(F.lit("《"), title, F.lit("》"))), path), " · "))


def junk_ratio(text: Column) -> Column:
    """Share of private-use, C1 control and replacement characters."""
    junk = F.regexp_count(text, F.lit(JUNK))
    return F.when(F.length(text) > 0, junk / F.length(text)).otherwise(0.0)


def cid_ratio(text: Column) -> Column:
    """Share of (cid:N) marks, which extractors print for characters they cannot map."""
    marks = F.length(text) - F.length(F.regexp_replace(text, r"\(cid:\d+\)", ""))
    return F.when(F.length(text) > 0, marks / F.length(text)).otherwise(0.0)


def needs_structure(markdown: Column) -> Column:
    """Whether a text has no heading but four blocks or more, and isn't mostly a table with under four lines of prose."""
    lines = F.filter(F.split(markdown, "\n"), lambda s: F.trim(s) != "")
    rows = F.size(F.filter(lines, lambda s: F.rlike(s, F.lit(r"^\s*\|"))))
    tabular = (F.size(lines) > 0) & (rows / F.greatest(F.size(lines), F.lit(1)) > 0.6) & (F.size(lines) - rows < 4)
    blocks = F.size(F.filter(F.split(markdown, r"\n\s*\n"), lambda s: F.trim(s) != ""))
    return ~tabular & (F.regexp_count(markdown, F.lit(r"(?m)^#{1,6}\s")) == 0) & (blocks >= 4)


def page_id_parts(page_id: Column) -> tuple[Column, Column]:
    """(document id, page number) of an id such as page_doc_7_3."""
    pattern = r"^page_(.*)_(\d+)$"
    return F.regexp_extract(page_id, pattern, 1), F.try_to_number(F.nullif(F.regexp_extract(page_id, pattern, 2), F.lit("")), F.lit("999999999")).cast("int")


def chunk_id(doc_id: Column, index: Column) -> Column:
    """doc_id and the chunk's number of at least four digits."""
    return F.concat(doc_id.cast("string"), F.lit("_c"), F.format_string("%04d", index))


def domain(url: Column) -> Column:
    """https:// and the address without its scheme and trailing slashes."""
    return F.concat(F.lit("https://"), F.regexp_replace(F.regexp_replace(F.trim(url), r"^(?i)https?://", ""), r"/+$", ""))
