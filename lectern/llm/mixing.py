"""Mixing sources to target weights by Efraimidis-Spirakis sampling (DataFrame functions only).

Every document draws an exponential key, scaled by its quality weight; sorted by key within its source, the documents are a
weighted random permutation. A source's target is met by whole epochs of all its documents, then by the leading part of that
permutation: its sizes are prefix-summed and a document is taken while the middle of its span lies within the budget, so what
is taken misses the target by half a document at most.

The prefix sums run in two steps, so that a source with any share of all rows is never one group: sums per (source, key range)
find the range in which the budget ends, and only that range (one in ``RANGES`` of a source) is sorted. The result is one cut
key per source, against which each row is decided where it lies.

Defined cases: a null text has size 0; a null source is a source of its own, ordered last; null ids and repeated rows draw keys
from what they hold, and rows alike in every way are taken alike; documents of size 0 are never taken; empty tables give empty
results; other columns, whatever their names, are left alone.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import materialise, word_count

#: Key ranges per source in the first step of the prefix sums.
RANGES = 4096


def text_quality(text: Column) -> Column:
    """A weight between 0.1 and 1: the square of the share of letters, digits and spaces in the text; 0.1 for empty and null."""
    rest = F.length(F.regexp_replace(text, r"[\p{L}\p{N}\s]+", ""))
    share = 1 - rest / F.greatest(F.length(text), F.lit(1))
    return F.coalesce(F.greatest(F.lit(0.1), F.when(F.length(text) > 0, share * share)), F.lit(0.1))


def exponential_key(weight: Column, seed: int, *parts: Column) -> Column:
    """-ln(u) / weight with u uniform in (0, 1), drawn from the hash of ``parts``."""
    u = (F.shiftrightunsigned(F.xxhash64(F.lit(seed), *parts), 11).cast("double") + 0.5) / float(1 << 53)
    return -F.log(u) / weight


def source_targets(sizes: DataFrame, weights: Sequence[float], share: float, ceiling: float) -> DataFrame:
    """(source, source_size, target) from one row per source with its size.

    Sources by code point, null last, take ``weights`` in turn and share ``share`` of all sizes; a target stops at ``ceiling``
    times its source's size and the excess is shared again by weight until none is above. That is water filling: with sources
    ordered by ceiling per weight, the first k are full, the level of the rest is what remains over their weight, and k is the
    first for which that level keeps under the next ceiling. The table has one row per source, so one task orders it.
    """
    turn = F.array(*[F.lit(float(w)) for w in weights])
    everything = Window.rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)
    place = (F.row_number().over(Window.orderBy(F.col("source").asc_nulls_last())) - 1) % len(weights)
    ranked = sizes.withColumn("weight", F.element_at(turn, place + 1)).withColumn("most", F.col("source_size") * F.lit(float(ceiling)))
    by_ceiling = Window.orderBy(F.col("most") / F.col("weight"), F.col("source").asc_nulls_last())
    before = by_ceiling.rowsBetween(Window.unboundedPreceding, -1)
    level = (F.sum("source_size").over(everything) * F.lit(float(share)) - F.coalesce(F.sum("most").over(before), F.lit(0.0))) / (
        F.sum("weight").over(everything) - F.coalesce(F.sum("weight").over(before), F.lit(0.0))
    )
    levelled = ranked.withColumn("level", level).withColumn("full", F.row_number().over(by_ceiling) - 1)
    holds = F.col("level") <= F.col("most") / F.col("weight")
    stops = F.min(F.when(holds, F.struct("full", "level"))).over(everything)["level"]
    target = F.least("most", F.coalesce(stops * F.col("weight"), F.col("most")))
    return levelled.select("source", "source_size", target.alias("target"))


def plan_mix(
    docs: DataFrame,
    *,
    id_col: str = "doc_id",
    text_col: str = "text",
    source_col: str = "source",
    quality: Column | None = None,
    weights: Sequence[float] = (3, 1, 2),
    share: float = 1.5,
    ceiling: float = 2.0,
    seed: int = 42,
) -> tuple[DataFrame, DataFrame]:
    """(keys, cuts): each document's source, size and key; each source's size, target, epochs and the last key it takes besides."""
    text = F.col(text_col)
    drawn = docs.select(
        F.col(id_col).alias("doc_id"),
        F.col(source_col).cast("string").alias("source"),
        word_count(text).alias("size"),
        mix_key(id_col, text_col, quality, seed).alias("key"),
    )
    keys = materialise(drawn, "mix-keys")
    span = F.floor((1 - F.exp(-F.col("key.draw") / 2)) * RANGES).cast("int")
    ranges = materialise(keys.groupBy("source", span.alias("span")).agg(F.sum("size").alias("size")), "mix-ranges")
    targets = source_targets(ranges.groupBy("source").agg(F.sum("size").alias("source_size")), weights, share, ceiling)
    epochs = F.when(F.col("source_size") > 0, F.floor(F.col("target") / F.col("source_size") + 1e-12)).otherwise(0).cast("int")
    budgets = targets.withColumn("epochs", epochs).withColumn("rest", F.greatest(F.col("target") - F.col("epochs") * F.col("source_size"), F.lit(0.0)))
    budgets = materialise(budgets, "mix-budgets")
    # the range in which each budget ends, and what lies before it
    running = Window.partitionBy("source").orderBy("span").rowsBetween(Window.unboundedPreceding, 0)
    ends = ranges.withColumn("before", F.sum("size").over(running) - F.col("size")).alias("r")
    ends = ends.join(budgets.alias("b"), F.col("r.source").eqNullSafe(F.col("b.source")))
    ends = ends.where((F.col("before") <= F.col("rest")) & (F.col("rest") > 0)).groupBy(F.col("r.source").alias("source")).agg(
        F.max(F.struct("span", "before", "rest")).alias("end")
    )
    inside = keys.withColumn("span", span).alias("k").join(
        ends.alias("e"), F.col("k.source").eqNullSafe(F.col("e.source")) & (F.col("k.span") == F.col("e.end.span"))
    )
    order = Window.partitionBy("k.source").orderBy("k.key").rowsBetween(Window.unboundedPreceding, 0)
    middle = F.col("end.before") + F.sum("k.size").over(order) - F.col("k.size") / 2
    cut = inside.select(F.col("k.source").alias("source"), "k.key", (middle <= F.col("end.rest")).alias("takes"))
    cut = cut.groupBy("source").agg(F.max(F.when(F.col("takes"), F.col("key"))).alias("last"))
    # where the ending range takes nothing itself, all keys of lower ranges are still taken
    cuts = budgets.alias("b").join(ends.alias("e"), F.col("b.source").eqNullSafe(F.col("e.source")), "left")
    cuts = cuts.join(cut.alias("c"), F.col("b.source").eqNullSafe(F.col("c.source")), "left").select(
        F.col("b.source").alias("source"), "source_size", "target", "epochs", F.col("end.span").alias("end_span"), "last"
    )
    return keys, materialise(cuts, "mix-cuts")


def mix_key(id_col: str, text_col: str, quality: Column | None, seed: int) -> Column:
    """What orders a source's documents: the draw, then the id and the text's hash for ties."""
    doc_id, text = F.col(id_col), F.col(text_col)
    mark = F.xxhash64(text)
    weight = F.greatest(F.coalesce(quality if quality is not None else text_quality(text), F.lit(0.1)), F.lit(1e-6))
    return F.struct(exponential_key(weight, seed, doc_id, mark).alias("draw"), doc_id.cast("string").alias("id"), mark.alias("mark"))


def _copies(size: Column, key: Column) -> Column:
    """How often a row joined with its source's cut is taken."""
    span = F.floor((1 - F.exp(-key["draw"] / 2)) * RANGES).cast("int")
    extra = F.coalesce((span < F.col("end_span")) | (key <= F.col("last")), F.lit(False))
    return F.when(size > 0, F.col("epochs") + extra.cast("int")).otherwise(0)


def mix(docs: DataFrame, **options) -> DataFrame:
    """(doc_id, source, size, source_size, target, copies, taken) for every document; see :func:`plan_mix` for the options."""
    keys, cuts = plan_mix(docs, **options)
    rows = keys.alias("k").join(cuts.alias("c"), F.col("k.source").eqNullSafe(F.col("c.source")), "left")
    copies = _copies(F.col("k.size"), F.col("k.key"))
    return rows.select("k.doc_id", "k.source", "k.size", "source_size", "target", copies.alias("copies")).withColumn(
        "taken", F.col("size") * F.col("copies")
    )


def mixed(docs: DataFrame, *, id_col: str = "doc_id", text_col: str = "text", source_col: str = "source", quality: Column | None = None, seed: int = 42, **options) -> DataFrame:
    """The mix itself: rows of ``docs`` with all their columns, each as often as the mix takes it. Texts aren't shuffled."""
    _, cuts = plan_mix(docs, id_col=id_col, text_col=text_col, source_col=source_col, quality=quality, seed=seed, **options)
    cuts = cuts.select(F.struct("source", "epochs", "end_span", "last").alias("__cut"))
    rows = docs.select(F.struct("*").alias("__row"), word_count(F.col(text_col)).alias("__size"), mix_key(id_col, text_col, quality, seed).alias("__key"), F.col(source_col).cast("string").alias("__source"))
    rows = rows.join(cuts, F.col("__source").eqNullSafe(F.col("__cut.source"))).select("__row", "__size", "__key", "__cut.epochs", "__cut.end_span", "__cut.last")
    copies = _copies(F.col("__size"), F.col("__key"))
    rows = rows.withColumn("__copies", copies).where("__copies > 0")
    return rows.select("__row", F.explode(F.array_repeat(F.lit(1), F.col("__copies"))).alias("__copy")).select("__row.*")
