"""Markdown tables: rendering, cells, profiles, group columns, packs of rows."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.text import between_cuts, cut_places, let, tokens_of, weight

SEPARATOR = r"^[\s|:-]*-[\s|:-]*$"
#: Values of a column that a profile lists, at most.
MOST_LISTED = 40


def escape(cell: Column) -> Column:
    """A cell on one line with its bars escaped; null is empty."""
    return F.replace(F.regexp_replace(F.coalesce(cell.cast("string"), F.lit("")), r"\s*[\r\n]+\s*", " "), F.lit("|"), F.lit("\\|"))


def row_line(*cells: Column) -> Column:
    return F.concat(F.lit("| "), F.concat_ws(" | ", *[escape(c) for c in cells]), F.lit(" |"))


def render(rows: DataFrame, key: str, order: list[str], columns: list[str]) -> DataFrame:
    """(key, markdown): the rows of each key as one table, in ``order``."""
    lines = F.array_sort(F.collect_list(F.struct(*order, row_line(*[F.col(c) for c in columns]).alias("__line"))))
    head = F.lit("| " + " | ".join(columns) + " |\n" + "|" + " --- |" * len(columns) + "\n")
    return rows.groupBy(key).agg(F.concat(head, F.array_join(F.transform(lines, lambda x: x["__line"]), "\n")).alias("markdown"))


def cells_of(line: Column) -> Column:
    """A row's cells: outer bars off, split at bars that aren't escaped, unescaped, trimmed."""
    inner = F.regexp_replace(F.trim(line), r"^\||\|$", "")
    return F.transform(F.split(inner, r"(?<!\\)\|"), lambda c: F.trim(F.replace(c, F.lit("\\|"), F.lit("|"))))


def parse(tables: DataFrame, key: str, text_col: str) -> DataFrame:
    """(key, header, row_idx, cells) of each data row; tables without one give none."""
    lines = F.filter(F.split(text_col, "\n"), lambda s: F.trim(s) != "")
    rows = tables.select(key, cells_of(F.get(lines, F.lit(0))).alias("header"), F.when(F.rlike(F.get(lines, F.lit(1)), F.lit(SEPARATOR)), F.slice(lines, 3, 1 << 30)).otherwise(F.slice(lines, 2, 1 << 30)).alias("data"))
    return rows.select(key, "header", F.posexplode("data").alias("row_idx", "line")).select(key, "header", "row_idx", cells_of(F.col("line")).alias("cells"))


def exploded(parsed: DataFrame, key: str) -> DataFrame:
    """(key, row_idx, col_idx, name, value): one row per cell."""
    return parsed.select(key, "row_idx", "header", F.posexplode("cells").alias("col_idx", "value")).select(
        key, "row_idx", "col_idx", F.get("header", F.col("col_idx")).alias("name"), "value"
    )


def profile(cells: DataFrame, key: str) -> DataFrame:
    """Per column: rows, filled and distinct values, changes from row to row (empty cells count), numbers and their range.
    Changes are found per part of 4,096 rows and across parts, so a long table is no single group."""
    size = 4096
    part = Window.partitionBy(key, "col_idx", "part").orderBy("row_idx")
    marked = cells.withColumn("part", F.floor(F.col("row_idx") / size)).withColumn("prior", F.lag("value").over(part))
    edge = marked.groupBy(key, "col_idx", "part").agg(F.max_by("value", "row_idx").alias("last")).withColumn("part", F.col("part") + 1)
    marked = marked.join(edge, [key, "col_idx", "part"], "left")
    before = F.when(F.pmod("row_idx", F.lit(size)) == 0, F.col("last")).otherwise(F.col("prior"))
    number = number_of(F.col("value"))
    filled = F.col("value") != ""
    return marked.withColumn("changes", (F.col("row_idx") == 0) | (F.col("value") != before)).groupBy(key, "col_idx").agg(
        F.max("name").alias("name"),
        F.count("*").alias("n_rows"),
        F.count_if(filled).alias("n_filled"),
        F.count_distinct(F.when(filled, F.col("value"))).alias("n_distinct"),
        F.count_if("changes").alias("n_runs"),
        F.count_if(filled & number.isNotNull()).alias("n_numbers"),
        F.min(F.when(filled, number)).alias("low"),
        F.max(F.when(filled, number)).alias("high"),
    )


def group_columns(profiles: DataFrame, key: str) -> DataFrame:
    """(key, group_col): the column whose equal values stand together best; -1 where none does."""
    ratio = F.col("n_distinct") / F.col("n_runs")
    fits = (F.col("n_rows") >= 4) & (F.col("n_filled") * 2 >= F.col("n_rows")) & (F.col("n_distinct") >= 2) & (F.col("n_distinct") * 2 <= F.col("n_rows")) & (ratio >= 0.8)
    score = F.round(ratio * (1 - F.col("n_distinct") / F.col("n_rows")), 9)
    best = F.max(F.when(fits, F.struct(score.alias("score"), (-F.col("col_idx")).alias("minus"))))
    return profiles.groupBy(key).agg(F.coalesce(-best["minus"], F.lit(-1)).cast("int").alias("group_col"))


def overview(cells: DataFrame, profiles: DataFrame, key: str) -> DataFrame:
    """(key, col_idx, name, summary): values in order of appearance if few, else the range if numbers; unnamed columns are numbered."""
    few = F.col("n_distinct") <= F.least(F.lit(MOST_LISTED), F.floor(F.col("n_rows") / 2))
    kept = profiles.where("n_rows >= 4").withColumn("few", few)
    firsts = cells.where("value != ''").groupBy(key, "col_idx", "value").agg(F.min("row_idx").alias("first"))
    # only columns with few values are listed, so a list has at most MOST_LISTED of them
    listed = firsts.join(kept.where("few").select(key, "col_idx"), [key, "col_idx"], "left_semi").groupBy(key, "col_idx").agg(
        F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("first", "value"))), lambda x: x["value"]), "、").alias("values")
    )
    rows = kept.join(listed, [key, "col_idx"], "left")
    span = F.concat(plain_number(F.col("low")), F.lit(" ~ "), plain_number(F.col("high")))
    summary = F.when(F.col("few"), F.col("values")).when(F.col("n_numbers") >= 0.8 * F.col("n_filled"), span)
    name = F.when(F.col("name") == "", F.concat(F.lit("第"), (F.col("col_idx") + 1).cast("string"), F.lit("列"))).otherwise(F.col("name"))
    return rows.select(key, "col_idx", name.alias("name"), summary.alias("summary"))


def number_of(value: Column) -> Column:
    """A cell as a number, commas left out; null if it is none."""
    digits = F.trim(F.regexp_replace(value, "[,，]", ""))
    known = F.rlike(digits, F.lit(r"^[+-]?(\d+\.?\d*|\.\d+)([eE][+-]?\d+)?$"))
    return F.when(known, digits.try_cast("double")).when((digits == "") & (value != ""), 0.0)


def plain_number(x: Column) -> Column:
    """30 rather than 30.0, and no exponent."""
    written = x.cast("string")
    return F.coalesce(F.regexp_replace(written.try_cast("decimal(38,18)").cast("string"), r"\.?0+$", ""), written)


def group_index(cells: Column) -> Column:
    """The column of rows (array<array<string>>) whose equal values stand together best; -1 where none does. As :func:`group_columns`,
    for a table within one row."""
    n = F.size(cells)

    def scored(j: Column) -> Column:
        def score(values: Column) -> Column:
            filled = F.filter(values, lambda v: v != "")
            changes = F.zip_with(F.slice(values, F.lit(1), n - 1), F.slice(values, F.lit(2), n - 1), lambda a, b: a != b)
            distinct, runs = F.size(F.array_distinct(filled)), 1 + F.size(F.filter(changes, lambda c: c))
            return let(F.struct(distinct.alias("d"), (distinct / runs).alias("r"), F.size(filled).alias("f")), fits)

        def fits(x: Column) -> Column:
            ok = (x["f"] * 2 >= n) & (x["d"] >= 2) & (x["d"] * 2 <= n) & (x["r"] >= 0.8)
            return F.when(ok, F.struct((x["r"] * (1 - x["d"] / n)).alias("score"), (-j).alias("minus")))

        return let(F.transform(cells, lambda r: F.coalesce(F.get(r, j), F.lit(""))), score)

    widest = F.array_max(F.transform(cells, lambda r: F.size(r)))
    best = F.array_max(F.transform(F.sequence(F.lit(0), widest - 1), scored))
    return F.when(n >= 4, F.coalesce(-best["minus"], F.lit(-1))).otherwise(-1)


# The wording of a table's overview.
OVERVIEW = ("表格概览：共 ", " 行数据、", " 列。", "列名：", "。", "「", "」取值：", "」数值区间 ", " ~ ")


def overview_text(header: Column, cells: Column) -> Column:
    """A table's size, its columns' names, and for each column its values if they are few, else its range if it holds numbers; null
    for tables of less than four rows. As :func:`overview`, for a table within one row."""
    about, of_rows, of_columns, names, stop, before, values_are, range_is, to = map(F.lit, OVERVIEW)
    n = F.size(cells)
    named = F.filter(header, lambda h: h != "")

    def column(j: Column) -> Column:
        label = F.when(F.get(header, j) == "", F.concat(F.lit("第"), (j + 1).cast("string"), F.lit("列"))).otherwise(F.get(header, j))

        def described(values: Column) -> Column:
            distinct = F.array_distinct(values)
            numbers = F.filter(F.transform(values, number_of), lambda x: x.isNotNull())
            span = F.concat(before, label, range_is, plain_number(F.array_min(numbers)), to, plain_number(F.array_max(numbers)), stop)
            few = F.size(distinct) <= F.least(F.lit(float(MOST_LISTED)), n / 2)
            listed = F.concat(before, label, values_are, F.array_join(distinct, "、"), stop)
            return F.when(F.size(values) == 0, None).when(few, listed).when(F.size(numbers) >= F.size(values) * 0.8, span)

        return let(F.filter(F.transform(cells, lambda r: F.coalesce(F.get(r, j), F.lit(""))), lambda v: v != ""), described)

    first = F.concat(about, n.cast("string"), of_rows, F.size(named).cast("string"), of_columns)
    second = F.when(F.size(named) > 0, F.concat(names, F.array_join(named, " | "), stop))
    lines = F.array_compact(F.concat(F.array(first, second), F.transform(F.sequence(F.lit(0), F.size(header) - 1), column)))
    return F.when((n >= 4) & (F.size(lines) > 1), F.array_join(lines, "\n"))


def clean_grid(rows: Column) -> Column:
    """array<array<string>> without blank rows and columns, padded to its widest row, banner rows above the header dropped."""
    full = F.filter(rows, lambda r: F.exists(r, lambda c: F.trim(c) != ""))
    width = F.array_max(F.transform(full, lambda r: F.size(r)))
    padded = F.transform(full, lambda r: F.concat(r, F.array_repeat(F.lit(""), width - F.size(r))))
    used = F.filter(F.sequence(F.lit(0), width - 1), lambda j: F.exists(padded, lambda r: F.trim(F.get(r, j)) != ""))
    trimmed = F.transform(padded, lambda r: F.transform(used, lambda j: F.trim(F.get(r, j))))

    def distinct(r: Column) -> Column:
        return F.array_distinct(F.filter(r, lambda c: c != ""))

    def banner(i: Column) -> Column:
        values = distinct(F.get(trimmed, i))
        one = (F.size(values) == 1) & ~F.rlike(F.get(values, F.lit(0)), F.lit(r"^-?[0-9.,]+%?$"))
        return one & (F.size(trimmed) - i >= 3) & (F.size(distinct(F.get(trimmed, i + 1))) >= 2) & (F.size(used) >= 2)

    lead = F.filter(F.sequence(F.lit(0), F.size(trimmed) - 1), lambda i: ~banner(i))
    return F.when(F.size(full) == 0, rows).otherwise(F.slice(trimmed, F.get(lead, F.lit(0)) + 1, F.greatest(F.size(trimmed), F.lit(1))))


def pack_rows(rows: Column, groups: Column | None, header: Column, target: int, most: int) -> Column:
    """Packs of row lines (array<string>), each under ``header``. With ``groups`` (a value per row, or null for none) a pack ends
    where the value changes or ``most`` would be passed; without, where ``most`` would be passed or ``target`` is reached. A pack
    holds a row at least. Rows are weighed once each: packs are cut by sums of weights."""
    of_rows = groups if groups is not None else F.lit(None).cast("array<string>")

    def packs(t: Column) -> Column:
        def under(x: Column | dict[str, Column]) -> Column:
            return tokens_of(t["top"]["c"] + x["c"], t["top"]["u"] + 1 + x["u"])

        def ends(s: Column, x: Column, joined: dict[str, Column]) -> Column:
            full = F.when(x["group"].isNull(), under(s) >= target).otherwise(x["group"] != s["group"])
            return full | (under(joined) > most)

        weighed = F.transform(t["rows"], lambda r, i: let(weight(r), lambda w: F.struct(w["c"].alias("c"), w["u"].alias("u"), F.get(t["groups"], i).alias("group"))))
        return between_cuts(t["rows"], cut_places(weighed, ends, 1), "\n")

    # each once per table, not once per row
    held = F.struct(rows.alias("rows"), of_rows.alias("groups"), weight(header).alias("top"))
    return F.transform(let(held, packs), lambda p: F.concat(header, F.lit("\n"), p))
