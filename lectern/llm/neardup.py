"""SimHash near-duplicates by covering locality-sensitive hashing.

For radius r, each bit of a fingerprint gets a vector of r + 1 bits, and table v (every non-zero vector of r + 1 bits) keeps the
bits whose vector has an odd product with v. Two fingerprints that differ in at most r bits meet in some table: r vectors never
span a space of r + 1 dimensions, so some v is orthogonal to all of them, and that table keeps none of the bits that differ.

Copies meet first: tables hold distinct fingerprints. A bucket with more than ``most`` of them is split by the same construction
over the bits that it has not fixed, three levels deep; what is left free then is too few bits for a large bucket. So no bucket
is capped, none is compared whole when large, and no pair within the radius is lost.

Defined cases: a null or empty text has fingerprint 0 and links as any other does; repeated rows share their fingerprint; a null
id keeps its row and never becomes a component's id unless all are null; an empty table gives an empty result.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import materialise
from .components import components
from .fingerprint import with_fingerprints

BITS = 64


def covering_masks(radius: int, free: list[int]) -> list[int]:
    """The masks of all tables over the ``free`` bit places, as signed 64-bit integers."""
    tables = (1 << (radius + 1)) - 1
    # spread by a step that is coprime to the number of tables, so that neighbouring bits get unlike vectors
    vectors = {bit: 1 + (i * 11) % tables for i, bit in enumerate(free)}
    masks = [sum(1 << bit for bit in free if bin(vectors[bit] & v).count("1") % 2) for v in range(1, tables + 1)]
    return [m - (1 << BITS) if m >> (BITS - 1) else m for m in masks]


def _free(mask: int) -> list[int]:
    return [i for i in range(BITS) if not (mask >> i) & 1]


def _split(rows: DataFrame, radius: int, fixed: list[int]) -> tuple[DataFrame, list[int]]:
    """rows (fp, fixed: index into ``fixed``) dealt to one row per table of the next level, and that level's masks."""
    masks = [f | m for f in fixed for m in covering_masks(radius, _free(f))]
    per = (1 << (radius + 1)) - 1
    deal = F.transform(F.sequence(F.lit(0), F.lit(per - 1)), lambda i: (F.col("table") * per + i).cast("int"))
    dealt = rows.select("fp", F.explode(deal).alias("table"))
    if len(masks) <= 1000:
        mask = F.element_at(F.array(*[F.lit(m) for m in masks]), F.col("table") + 1)
        return dealt.withColumn("key", F.col("fp").bitwiseAND(mask)), masks
    # the third level's masks are a fixed small table
    known = rows.sparkSession.createDataFrame(list(enumerate(masks)), "table int, mask long")
    return dealt.join(F.broadcast(known), "table").select("fp", "table", F.col("fp").bitwiseAND(F.col("mask")).alias("key")), masks


def distance(a: Column, b: Column) -> Column:
    return F.bit_count(a.bitwiseXOR(b))


def _met(buckets: DataFrame, radius: int) -> DataFrame:
    """Pairs (a, b), a < b, within the radius that share a bucket. Spark takes the buckets for as small as the fingerprints that they
    were dealt from, 31 times fewer, and would broadcast them: hence the hint."""
    a, b = buckets.alias("a"), buckets.alias("b").hint("merge")
    near = (distance(F.col("a.fp"), F.col("b.fp")) <= radius) & (F.col("a.fp") < F.col("b.fp"))
    met = a.join(b, (F.col("a.table") == F.col("b.table")) & (F.col("a.key") == F.col("b.key")) & near)
    return met.select(F.col("a.fp").alias("a"), F.col("b.fp").alias("b"))


def near_pairs(fps: DataFrame, radius: int = 4, most: int = 128, levels: int = 3) -> DataFrame:
    """All pairs (a, b) of the distinct fingerprints ``fps`` (fp) that differ in at most ``radius`` bits; a pair may repeat."""
    rows, fixed, found = fps.select("fp", F.lit(0).alias("table")), [0], []
    for level in range(levels):
        buckets, fixed = _split(rows, radius, fixed)
        if level == levels - 1:
            found.append(_met(buckets, radius))
            break
        large = buckets.groupBy("table", "key").count().where(F.col("count") > most).drop("count")
        large = materialise(large, "large-buckets")
        if large.isEmpty():
            found.append(_met(buckets, radius))
            break
        found.append(_met(buckets.join(large, ["table", "key"], "left_anti"), radius))
        rows = buckets.join(large, ["table", "key"], "left_semi").select("fp", "table")
    out = found[0]
    for more in found[1:]:
        out = out.unionByName(more)
    return out


def _rooted(marked: DataFrame, radius: int) -> DataFrame:
    """(fp, first_id, root): each distinct fingerprint of ``marked`` (doc_id, fp), its least id and its component's least fingerprint."""
    fps = materialise(marked.groupBy("fp").agg(F.min("doc_id").alias("first_id")), "distinct-fingerprints")
    roots = components(near_pairs(fps, radius))
    return fps.join(roots, fps.fp == roots.node, "left").select("fp", "first_id", F.coalesce("root", "fp").alias("root"))


def near_duplicates(docs: DataFrame, *, id_col: str = "doc_id", text_col: str = "text", radius: int = 4) -> DataFrame:
    """(doc_id, fp, component_id): every document's fingerprint and the least id that links reach from it, itself included."""
    marked = materialise(with_fingerprints(docs, id_col, text_col), "fingerprints")
    rooted = materialise(_rooted(marked, radius), "fingerprint-roots")
    first = materialise(rooted.groupBy("root").agg(F.min("first_id").alias("component_id")), "component-ids")  # a giant component's rows may be split
    named = materialise(rooted.join(first, "root").select("fp", "component_id"), "fingerprint-components")
    return marked.join(named, "fp").select("doc_id", "fp", F.coalesce("component_id", "doc_id").alias("component_id"))


def one_of_each(docs: DataFrame, *, id_col: str = "doc_id", text_col: str = "text", radius: int = 4) -> DataFrame:
    """One row, with all its columns, of each component: that with the least id, nulls last, then the least hash of its text, then of
    its other columns. Unlike texts that share an id, or have none, are components of their own and stay."""
    text_hash = F.xxhash64(F.col(text_col).cast("string"))
    marked = materialise(with_fingerprints(docs.withColumn("__hash", text_hash), id_col, text_col, "__hash"), "fingerprints")
    # components are told apart by their roots: an id may stand in several
    rooted = marked.join(_rooted(marked, radius).select("fp", "root"), "fp")
    first = rooted.groupBy("root").agg(F.min(F.struct(F.isnull("doc_id").alias("none"), F.coalesce("doc_id", F.lit(0)).alias("id"), F.col("__hash").alias("hash"))).alias("kept"))
    kept = first.select(*[F.col(f"kept.{k}").alias(f"__{k}") for k in ("none", "id", "hash")])
    ids = F.col(id_col).cast("long")
    keyed = docs.select(F.struct("*").alias("__row"), F.isnull(ids).alias("__none"), F.coalesce(ids, F.lit(0)).alias("__id"), text_hash.alias("__hash"))
    met = keyed.join(kept, ["__none", "__id", "__hash"], "left_semi")
    rest = F.xxhash64(*[F.col("__row").getField(c) for c, kind in docs.dtypes if "map<" not in kind])
    return met.groupBy("__none", "__id", "__hash").agg(F.min_by("__row", rest).alias("__row")).select("__row.*")
