"""Document fingerprints: bottom-k sketches of word-shingle hashes (DataFrame functions only).

The sketch of a text is the k least distinct hashes of its shingles of ``width`` words (a shorter text is one shingle), in
order. Sketches merge: the k least of the union of two sketches is the sketch of both texts' shingles together. They estimate
resemblance (the share of the merged sketch that both hold), containment and the number of distinct shingles.

:func:`with_next` brings each document together with the next one by id, without a window over the whole table: ids are cut
into blocks at approximate quantiles, each block is ordered by itself, and the first document of each block is lent to the
block before it. Texts are shuffled once.

Defined cases: a null text is empty; an empty text has an empty sketch, alike (1.0) only to another empty one; rows that repeat
an id follow each other by their texts, rows that repeat both follow themselves; null ids come first; an empty table gives an
empty result; other columns are left alone.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import GAP, let, materialise

#: Length of a sketch.
K = 128
#: Documents per block, and most blocks, in :func:`with_next`.
BLOCK, MOST_BLOCKS = 2048, 1 << 14


def shingle_hashes(text: Column, width: int = 5) -> Column:
    """array<bigint> of the XXH64 of each shingle's word hashes; empty for a text without words."""
    words = F.split(F.btrim(text, F.lit(" \t\n\x0b\f\r")), GAP)

    def shingles(hashes: Column) -> Column:
        last = F.greatest(F.size(hashes) - (width - 1), F.lit(1))
        return F.transform(F.sequence(F.lit(1), last), lambda i: F.xxhash64(*[F.try_element_at(hashes, (i + j).cast("int")) for j in range(width)]))

    full = let(F.transform(words, lambda w: F.xxhash64(w)), shingles)
    return F.when(F.rlike(text, F.lit(r"[^\x20\x09-\x0D]")), full).otherwise(F.array().cast("array<bigint>"))


def sketch(text: Column, k: int = K, width: int = 5) -> Column:
    """The bottom-k sketch of a text."""
    return F.slice(F.sort_array(F.array_distinct(shingle_hashes(text, width))), 1, k)


def merged(a: Column, b: Column, k: int = K) -> Column:
    """The sketch of what two sketches stand for together."""
    return F.slice(F.sort_array(F.array_union(a, b)), 1, k)


def merged_over(rows: DataFrame, keys: list[str], column: str, k: int = K) -> DataFrame:
    """One merged sketch per group. Each part is cut to its least hashes before anything is gathered, so a group of any size
    sends few values from each task: the k-th least of a part bounds the k least of the whole."""
    salted = rows.withColumn("__part", F.spark_partition_id() % 64)

    def least(df: DataFrame, by: list[str]) -> DataFrame:
        distinct = df.select(*by, F.explode(column).alias("__h")).distinct()
        order = Window.partitionBy(*by).orderBy("__h")
        return distinct.withColumn("__n", F.row_number().over(order)).where(F.col("__n") <= k).groupBy(*by).agg(F.sort_array(F.collect_list("__h")).alias(column))

    return least(least(salted, [*keys, "__part"]), keys)


def resemblance(a: Column, b: Column, k: int = K) -> Column:
    """Estimated share of common shingles among all of both."""

    def share(both: Column) -> Column:
        common = F.size(F.array_intersect(both, F.array_intersect(a, b))) / F.greatest(F.size(both), F.lit(1))
        return F.when(F.size(both) == 0, 1.0).otherwise(common)

    return let(merged(a, b, k), share)


def distinct_estimate(a: Column, k: int = K) -> Column:
    """Estimated number of distinct shingles; exact below k."""
    kth = (F.element_at(a, -1).cast("double") + float(1 << 63)) / float(1 << 64)
    return F.when(F.size(a) < k, F.size(a).cast("double")).otherwise((k - 1) / kth)


def containment(a: Column, b: Column, k: int = K) -> Column:
    """Estimated share of a's shingles that b holds too."""
    common = resemblance(a, b, k) * let(merged(a, b, k), lambda both: distinct_estimate(both, k))
    return F.least(F.lit(1.0), F.when(F.size(a) == 0, 1.0).otherwise(common / distinct_estimate(a, k)))


def digest(a: Column) -> Column:
    """A sketch as a string that holds it whole: each hash in 16 hexadecimal digits."""
    return F.array_join(F.transform(a, lambda h: F.lower(F.lpad(F.hex(h), 16, "0"))), "")


def undigested(text: Column) -> Column:
    """The sketch that :func:`digest` wrote, to be merged or compared."""
    halves = F.regexp_extract_all(text, F.lit("[0-9a-f]{8}"), F.lit(0))
    whole = F.sequence(F.lit(0), F.floor(F.size(halves) / 2).cast("int") - 1)
    read = F.transform(whole, lambda i: F.shiftleft(F.conv(F.get(halves, 2 * i), 16, 10).cast("long"), 32).bitwiseOR(F.conv(F.get(halves, 2 * i + 1), 16, 10).cast("long")))
    return F.when(text == "", F.array().cast("array<bigint>")).otherwise(read)


def _block(doc_id: Column, cuts: list[int]) -> list[tuple[str, Column]]:
    """Columns that find, bit by bit, how many of the sorted ``cuts`` lie at or below an id; the last is ``block``."""
    at, steps = F.lit(0), []
    known = F.array(*[F.lit(c) for c in cuts]) if cuts else None
    bit = 1 << (len(cuts).bit_length() - 1) if cuts else 0
    while bit:
        step = at + F.when(F.coalesce(doc_id >= F.get(known, at + (bit - 1)), F.lit(False)), bit).otherwise(0)
        steps.append((f"__at{bit}", step))
        at, bit = F.col(f"__at{bit}"), bit >> 1
    return [*steps, ("block", at.cast("int"))]


def with_next(rows: DataFrame) -> DataFrame:
    """rows (doc_id, text, ...) with ``next``: a struct of the next row by id, then text; after the last the first."""
    ids = rows.select("doc_id")
    n, low = ids.agg(F.count("*"), F.min("doc_id")).first()
    blocks = min(MOST_BLOCKS, n // BLOCK)
    # what comes to the driver is one cut per block, at most MOST_BLOCKS numbers
    cuts = ids.agg(F.percentile_approx("doc_id", [i / blocks for i in range(1, blocks)], max(10_000, 10 * blocks))).first()[0] if blocks > 1 else []
    cuts = sorted({c for c in cuts or [] if c > low})
    names = rows.columns

    def blocked(df: DataFrame) -> DataFrame:
        for name, step in _block(F.col("doc_id"), cuts):
            df = df.withColumn(name, step)
        return df.drop(*[c for c in df.columns if c.startswith("__at")])

    # the first document of each block that has any: its id and its text's hash
    mark = F.struct(F.col("doc_id").alias("doc_id"), F.xxhash64("text").alias("mark"))
    first = blocked(rows.select("doc_id", "text")).groupBy("block").agg(F.min_by(mark, F.struct("doc_id", "text")).alias("mark"))
    around = Window.orderBy("block")
    back = F.coalesce(F.lag("block").over(around), F.last("block").over(around.rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)))
    lent = materialise(first.select("mark", back.alias("lent_to")), "sketch-lent")
    firsts = rows.join(F.broadcast(lent), F.col("doc_id").eqNullSafe(F.col("mark.doc_id")) & (F.xxhash64("text") == F.col("mark.mark")))
    firsts = firsts.select(*names, F.col("lent_to").alias("block"), F.lit(1).alias("lent"))
    every = blocked(rows).select(*names, "block", F.lit(0).alias("lent")).unionByName(firsts).repartition("block")
    order = Window.partitionBy("block").orderBy("lent", "doc_id", "text")
    return every.withColumn("next", F.lead(F.struct(*names)).over(order)).where("lent = 0").drop("lent", "block")


def fingerprints(docs: DataFrame, *, id_col: str = "doc_id", text_col: str = "text", k: int = K) -> DataFrame:
    """(doc_id, n_chars, edited, sketch, edited_sketch, near_edited, near_next, in_next, distinct_shingles) of every document;
    ``in_next`` is the estimated share of its shingles that the next one holds too.

    ``edited`` is the text with its last quarter replaced by as many characters from the head of the next document, or by all.
    """
    text = F.coalesce(F.col(text_col).cast("string"), F.lit(""))
    rows = docs.select(F.col(id_col).alias("doc_id"), text.alias("text"))
    rows = with_next(rows.withColumn("sketch", sketch(F.col("text"), k)))
    n_chars = F.length("text").cast("long")
    quarter = F.floor(n_chars / 4).cast("int")
    edited = F.concat(F.substring("text", F.lit(1), (n_chars - quarter).cast("int")), F.substring("next.text", F.lit(1), quarter))
    rows = rows.select("doc_id", n_chars.alias("n_chars"), edited.alias("edited"), "sketch", F.col("next.sketch").alias("next_sketch"))
    rows = rows.withColumn("edited_sketch", sketch(F.col("edited"), k))
    return rows.select(
        "doc_id", "n_chars", "edited", "sketch", "edited_sketch", resemblance(F.col("sketch"), F.col("edited_sketch"), k).alias("near_edited"), resemblance(F.col("sketch"), F.col("next_sketch"), k).alias("near_next"),
        containment(F.col("sketch"), F.col("next_sketch"), k).alias("in_next"), distinct_estimate(F.col("sketch"), k).alias("distinct_shingles"),
    )
