"""Line deduplication by a suffix array over line ids, built by distributed prefix doubling.

A document is its sequence of lines that hold a word. Every run of consecutive lines with at least ``min_words`` words that
stands earlier in the corpus (by document id, then line) is deleted, and the first copy stays. That is: a line goes if and only
if it lies in such a run.

1. Lines that stand once can be in no repeated run; the rest are ranked by line id (level 0).
2. Level j + 1 ranks the runs of 2^(j+1) lines by the pair of ranks of their halves, in order, for pairs that stand twice or
   more: these are the intervals of the suffix array whose common prefix is that long. A run that must be told apart has at
   most ``min_words`` lines, so log2(min_words) rounds end the doubling, whatever the length of documents.
3. From each line, the shortest run of ``min_words`` words that starts, and the one that ends, there: longer repeated runs are
   their union. A run of L lines is named by the ranks of its first and its last 2^j lines, 2^j <= L < 2^(j+1); runs of one name
   are an interval of common prefix L, and all but the first in corpus order are deleted.

Distinct lines, pairs and names are aggregated before they are shuffled, and joined back from tables of one row each, where Spark
splits the rows of one that a third of all documents hold. Lines without the white space around them are told apart by two hashes,
96 bits in all. Runs of L lines are named by the ranks of their ends in place of intervals of a suffix array kept whole.

Defined cases: null and empty texts have no line and stay as they are; lines without a word are never deleted or counted; rows
that repeat both id and text are one document; documents that share an id are ordered by their texts' hashes; null ids come
first; an empty table gives an empty result; other columns are kept as they are.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import WORD, materialise

#: Words of the shortest repeated run that is deleted.
MIN_WORDS = 30


def sorted_ranks(keys: DataFrame, by: list[str]) -> DataFrame:
    """Distinct ``keys`` with ``rank``, their place in the order of ``by`` over all of them, from 1: each range-sorted part
    numbers its own rows and adds the number of rows in the parts before it."""
    parted = materialise(keys.repartitionByRange(*by).withColumn("__part", F.spark_partition_id()), "line-ranks")
    sizes = parted.groupBy("__part").agg(F.count("*").alias("n"))  # one row per part
    before = sizes.select("__part", (F.sum("n").over(Window.orderBy("__part")) - F.col("n")).alias("__before"))
    local = F.row_number().over(Window.partitionBy("__part").orderBy(*by))
    return parted.join(F.broadcast(before), "__part").select(*by, (F.col("__before") + local).alias("rank"))


def _lines(docs: DataFrame, id_col: str, text_col: str) -> DataFrame:
    """(doc, line_no, line, words, at): lines with words; ``doc`` is (id, text hash), ``at`` counts such lines from 0."""
    doc = F.struct(F.col(id_col).cast("long").alias("id"), F.xxhash64(F.col(text_col)).alias("mark"))
    rows = docs.select(doc.alias("doc"), F.posexplode(F.split(F.col(text_col), "\n")).alias("line_no", "line"))
    trimmed = F.btrim("line", F.lit(" \t\r\x0b\f"))
    words = F.regexp_count("line", F.lit(WORD))
    return rows.select("doc", "line_no", F.struct(F.xxhash64(trimmed).alias("a"), F.hash(trimmed).alias("b")).alias("line"), words.cast("long").alias("words")).where("words > 0")


def ranked_lines(docs: DataFrame, *, id_col: str = "doc_id", text_col: str = "text", min_words: int = MIN_WORDS) -> tuple[DataFrame, int]:
    """(lines, levels): repeated lines (doc, line_no, at, words, ranks) and the number of levels in ``ranks``.

    ``ranks[j]`` is the suffix rank of the line by its first 2^j lines, null where no other place holds the same run.
    """
    lines = materialise(_lines(docs, id_col, text_col), "lines")
    place = F.struct("doc", "line_no")
    repeated = lines.groupBy("line").agg(F.min(place).alias("a"), F.max(place).alias("z")).where("a != z").select("line")
    ordered = sorted_ranks(repeated, ["line"])
    # places among the document's lines with words, before the unique ones go
    at = F.row_number().over(Window.partitionBy("doc").orderBy("line_no")) - 1
    lines = lines.select("doc", "line_no", "line", "words").dropDuplicates(["doc", "line_no"]).withColumn("at", at)
    lines = lines.join(ordered, "line").select("doc", "line_no", "at", "words", F.array("rank").alias("ranks"))
    lines, level = materialise(lines, "lines-ranked"), 0
    within = Window.partitionBy("doc").orderBy("at")
    while 2 << level <= min_words:
        half = 1 << level
        there = F.lead("at", half).over(within) == F.col("at") + half
        second = F.when(there, F.lead(F.element_at("ranks", level + 1), half).over(within))
        paired = lines.withColumn("a", F.element_at("ranks", level + 1)).withColumn("b", second)
        pairs = paired.where("a IS NOT NULL AND b IS NOT NULL").groupBy("a", "b").count().where("count > 1").select("a", "b")
        ordered = sorted_ranks(pairs, ["a", "b"])
        # places without a pair stay out of the join, where they would be one group
        has = F.col("a").isNotNull() & F.col("b").isNotNull()
        ranked = paired.where(has).join(ordered, ["a", "b"], "left").select(*lines.columns, "rank")
        ranked = ranked.unionByName(paired.where(~has).select(*lines.columns, F.lit(None).cast(ordered.schema["rank"].dataType).alias("rank")))
        lines = ranked.select("doc", "line_no", "at", "words", F.concat("ranks", F.array("rank")).alias("ranks"))
        lines, level = materialise(lines, "lines-ranked"), level + 1
    return lines, level + 1


def repeated_runs(lines: DataFrame, levels: int, min_words: int = MIN_WORDS) -> DataFrame:
    """(doc, at, length): the shortest runs of ``min_words`` words that stand earlier in the corpus."""
    stretch = F.col("at") - F.row_number().over(Window.partitionBy("doc").orderBy("at"))
    inside = Window.partitionBy("doc", "stretch")
    upto = F.sum("words").over(inside.orderBy("at").rowsBetween(Window.unboundedPreceding, 0))
    lines = lines.withColumn("stretch", stretch).withColumn("upto", upto).withColumn("before", upto - F.col("words"))
    whole = inside.rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)
    # the other way round, as frames that start at the first row are the ones that grow row by row
    after = F.last("at").over(inside.orderBy(F.desc("before")).rangeBetween(Window.unboundedPreceding, -min_words))
    end = F.coalesce(after, F.when(F.max("upto").over(whole) - F.col("before") >= min_words, F.max("at").over(whole) + 1))
    ahead = F.last("at").over(inside.orderBy("upto").rangeBetween(Window.unboundedPreceding, -min_words))
    start = F.coalesce(ahead + 1, F.when(F.col("upto") >= min_words, F.min("at").over(whole)))
    reach = materialise(lines.withColumn("end", end).withColumn("start", start), "line-reach")
    runs = reach.where("end IS NOT NULL").select("doc", "at", (F.col("end") - F.col("at")).alias("length"))
    runs = runs.unionByName(reach.where("start IS NOT NULL").select("doc", F.col("start").alias("at"), (F.col("at") - F.col("start") + 1).alias("length"))).distinct()
    level = reduce(lambda c, j: c.when(F.col("length") >= (1 << j), j), range(levels - 2, -1, -1), F.when(F.col("length") >= (1 << (levels - 1)), levels - 1))
    runs = runs.withColumn("level", level.cast("int"))
    runs = runs.withColumn("tail", F.col("at") + F.col("length") - F.get(F.array(*[F.lit(1 << j) for j in range(levels)]), F.col("level")))
    ranks = reach.select("doc", "at", "ranks")
    runs = runs.join(ranks, ["doc", "at"]).withColumn("a", F.get("ranks", F.col("level"))).drop("ranks")
    tails = ranks.select("doc", F.col("at").alias("tail"), F.col("ranks").alias("tail_ranks"))
    runs = runs.join(tails, ["doc", "tail"]).withColumn("b", F.get("tail_ranks", F.col("level"))).where("a IS NOT NULL AND b IS NOT NULL")
    runs = materialise(runs.select("doc", "at", "length", "a", "b"), "line-runs")
    name, place = ["length", "a", "b"], F.struct("doc", "at")
    firsts = runs.groupBy(*name).agg(F.min(place).alias("first"), F.max(place).alias("last")).where("first != last").drop("last")
    firsts = materialise(firsts, "line-firsts")  # apart from the join, so that Spark may split the rows of a name that many share
    return runs.join(firsts, name).where(place != F.col("first")).select("doc", "at", "length")


def deleted_lines(docs: DataFrame, *, id_col: str = "doc_id", text_col: str = "text", min_words: int = MIN_WORDS) -> DataFrame:
    """(doc, deleted): for each document that loses lines, their numbers (from 0) in order."""
    lines, levels = ranked_lines(docs, id_col=id_col, text_col=text_col, min_words=min_words)
    runs = repeated_runs(lines, levels, min_words)
    gone = runs.select("doc", F.explode(F.sequence(F.col("at"), F.col("at") + F.col("length") - 1)).alias("at")).distinct()
    numbered = gone.join(lines.select("doc", "at", "line_no"), ["doc", "at"])
    return numbered.groupBy("doc").agg(F.sort_array(F.collect_list("line_no")).alias("deleted"))


def dedup_lines(docs: DataFrame, *, id_col: str = "doc_id", text_col: str = "text", min_words: int = MIN_WORDS) -> DataFrame:
    """``docs`` with all its columns, the text without its repeated runs, and ``deleted_lines`` (their numbers, often none)."""
    gone = materialise(deleted_lines(docs, id_col=id_col, text_col=text_col, min_words=min_words), "deleted-lines")
    gone = gone.select(F.col("doc.id").alias("__id"), F.col("doc.mark").alias("__mark"), F.col("deleted").alias("__deleted"))
    same = F.col(f"__row.{id_col}").cast("long").eqNullSafe(F.col("__id")) & (F.xxhash64(F.col(f"__row.{text_col}")) == F.col("__mark"))
    # a merge at every size: what loses lines grows with the corpus, so it is never broadcast
    rows = docs.select(F.struct("*").alias("__row")).join(gone.hint("merge"), same, "left")

    def kept(lines: Column) -> Column:
        left = F.array_except(F.sequence(F.lit(0), F.size(lines) - 1), "__deleted")
        return F.array_join(F.transform(left, lambda i: F.get(lines, i)), "\n")

    text = F.when(F.col("__deleted").isNull(), F.col(f"__row.{text_col}")).otherwise(F.element_at(F.transform(F.array(F.split(f"__row.{text_col}", "\n")), kept), 1))
    columns = [text.alias(c) if c == text_col else F.col(f"__row.`{c}`").alias(c) for c in docs.columns]
    return rows.select(*columns, F.coalesce("__deleted", F.array().cast("array<int>")).alias("deleted_lines"))
