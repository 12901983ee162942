"""A stored inverted index: what keyword search needs, written once, so that a search reads no text.

An index is a table of versions (:mod:`lectern.sources.versions`) made of segments. A segment holds

- ``rows``: postings, one row per term and block of documents, with their ids, term frequencies and lengths, the largest frequency and
  the least length; in folders by bucket of the term's hash, sorted by term. Documents are dealt to blocks by hash, so a term that all
  documents hold is many rows, and the bucket it lies in is written by several tasks. Beside them a row per block lists its documents.
- ``terms``: document frequency and the same two extremes of each term. Frequencies of segments add up.
- ``docs``: ids and lengths. Numbers of documents and words are in the manifest.

New documents are a new segment. Documents that go, or are indexed anew, are listed by a later segment (``removed``), which also takes
their terms off the frequencies; so statistics are exact at any time. A dictionary belongs to the version: :func:`reindexed` makes the
next one for another dictionary, from those documents whose tokens change alone; searches on the version before go on beside it.

Search is exact. The postings of the terms asked for meet block by block, and blocks of documents are scored against blocks of
queries, each a small dense matrix. A term weighs at most its largest frequency at its least length in any document of a block: where
a query's terms cannot reach its k-th score so far in this way, the block isn't opened for it.
"""

from __future__ import annotations

from collections.abc import Sequence
from dataclasses import dataclass
from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import text as T
from ..functions.dictionary import holds_any
from ..sources.versions import Versions
from . import postings as P
from . import search as S
from .postings import Best  # noqa: F401

#: Bytes of text per bucket.
BUCKET = 32 << 20
#: Folders of a segment: the rows of terms, and, written beside them, those that list a block's documents.
POSTINGS, LISTED = "rows/kind=postings", "rows/kind=listed"


@dataclass(frozen=True)
class Index:
    """One version of the index at ``root``; the last unless ``version`` says which."""

    spark: SparkSession
    root: str
    version: int
    state: dict

    @staticmethod
    def at(spark: SparkSession, root: str, version: int | None = None) -> Index:
        known = Versions(spark, root)
        number, state = known.latest() if version is None else (version, known.state(version))
        if not number:
            raise FileNotFoundError(f"no index at {root}")
        return Index(spark, known.root, number, state)

    @property
    def words(self) -> list[str]:
        return self.state["words"]

    @property
    def segments(self) -> list[dict]:
        return self.state["segments"]

    @property
    def n_docs(self) -> int:
        return sum(s["docs"] for s in self.segments)

    @property
    def avg_length(self) -> float:
        """Of documents that aren't empty."""
        filled = sum(s["filled"] for s in self.segments)
        return sum(s["length"] for s in self.segments) / filled if filled else 0.0

    def _table(self, name: str, segment: dict) -> DataFrame:
        return self.spark.read.schema(segment["schemas"][name]).parquet(f"{segment['path']}/{POSTINGS if name == 'postings' else name}")

    def _live(self, rows: DataFrame, place: int) -> DataFrame:
        """rows (id, ...) of the segment at ``place`` without those that later segments have removed."""
        for later in self.segments[place + 1 :]:
            if later["removes"]:
                rows = rows.join(self._table("removed", later), "id", "left_anti")
        return rows

    def doc_freq(self) -> DataFrame:
        """(term, df, max_tf, min_length); the extremes are bounds: they may be those of documents that have gone."""
        parts = [self._table("terms", s) for s in self.segments]
        if len(parts) == 1:
            return parts[0]
        every = reduce(DataFrame.unionByName, parts).groupBy("term")
        return every.agg(F.sum("df").alias("df"), F.max("max_tf").alias("max_tf"), F.min("min_length").alias("min_length")).where("df > 0")

    def docs(self) -> DataFrame:
        """(id, length) of all documents."""
        return reduce(DataFrame.unionByName, [self._live(self._table("docs", s), i) for i, s in enumerate(self.segments)])

    def blocks(self, terms: DataFrame | None = None) -> DataFrame:
        """(segment, term, block, ids, tfs, lengths, max_tf, min_length): the rows of postings; with ``terms`` (term), of their
        buckets alone."""
        parts = []
        for i, s in enumerate(self.segments):
            rows = self._table("postings", s)
            if terms is not None:
                # what comes to the driver is one number per bucket at most
                asked = [r.bucket for r in terms.select(bucket_of(F.col("term"), s["buckets"]).alias("bucket")).distinct().collect()]
                rows = rows.where(F.col("bucket").isin(asked)) if len(asked) < s["buckets"] else rows
            parts.append(rows.drop("bucket").withColumn("segment", F.lit(i)))
        return reduce(DataFrame.unionByName, parts)

    def _removed(self) -> DataFrame | None:
        """(segment, id): documents that no longer count in a segment."""
        gone = [
            self._table("removed", later).select(F.explode(F.sequence(F.lit(0), F.lit(i - 1))).alias("segment"), "id")
            for i, later in enumerate(self.segments)
            if later["removes"] and i
        ]
        return reduce(DataFrame.unionByName, gone) if gone else None

    def keyword_search(self, queries: DataFrame, k: int, *, scope: DataFrame | None = None) -> DataFrame:
        """(query_id, id, score, rank) as :func:`lectern.operators.search.keyword_search` gives them."""
        terms = S.query_terms(queries, self.words)
        freq = self.doc_freq().join(terms.select("term").distinct(), "term", "left_semi")
        known = self._written(terms.join(freq, "term").select("query_id", "term", S.idf(F.lit(self.n_docs), F.col("df")).alias("idf")))
        asked = known.select("term").distinct()
        opened = P.sketched(self.blocks(asked), P.sketch(asked))  # a few other terms pass: no query has them
        rows = P.packed(opened.select("segment", "block", *P.HELD), "held", "segment", "block")
        rows = self._masked(rows, "gone", self._removed(), "left")
        if scope is not None:
            every = scope.select(F.col(scope.columns[0]).alias("id"), F.explode(F.sequence(F.lit(0), F.lit(len(self.segments) - 1))).alias("segment"))
            rows = self._masked(rows, "scope", every, "inner")
        rows = rows.withColumn("of", F.concat_ws("/", "segment", "block"))
        scores = P.scored(rows, known, k, self.avg_length, self.docs().schema["id"].dataType.simpleString())
        return S.top(scores.select("query_id", "id", F.round("score", 6).alias("score")), k)

    def _masked(self, rows: DataFrame, name: str, ids: DataFrame | None, how: str) -> DataFrame:
        """``rows`` (segment, block, ...) with the ``ids`` (segment, id) that fall in the block as column ``name``."""
        if ids is None:
            return rows
        block = F.lit(0)
        for i, s in enumerate(self.segments):
            block = F.when(F.col("segment") == i, P.block_of(F.col("id"), s["blocks"])).otherwise(block)
        listed = ids.select("segment", block.cast("int").alias("block"), "id").groupBy("segment", "block").agg(F.collect_set("id").alias(name))
        return rows.join(listed, ["segment", "block"], how)

    def _written(self, rows: DataFrame) -> DataFrame:
        """``rows`` by way of a table of the index, which :meth:`Versions.vacuum` clears away."""
        path = Versions(self.spark, self.root).folder("search")
        rows.write.parquet(path)
        return self.spark.read.schema(rows.schema).parquet(path)


def bucket_of(term: Column, buckets: int) -> Column:
    return F.pmod(F.xxhash64(term), F.lit(buckets)).cast("int")


def _segment(known: Versions, docs: DataFrame, words: Sequence[str], removed: DataFrame | None = None, gone: DataFrame | None = None) -> dict:
    """Write a segment of docs (id, text); its entry in the manifest. ``removed`` (id, length) lists documents of earlier segments
    that it takes off, ``gone`` (term, df) how often their terms stood."""
    spark, path = known.spark, known.folder("segment")
    n, size = docs.agg(F.count("*"), F.coalesce(F.sum(F.octet_length("text")), F.lit(0))).first()
    buckets, blocks = max(8, size // BUCKET), max(1, -(-n // P.BLOCK))
    rows = P.term_blocks(docs, T.tokens(F.coalesce("text", F.lit("")), words), blocks, buckets)
    kind = F.when(F.col("term").isNull(), "listed").otherwise("postings").alias("kind")
    rows = rows.select("term", "block", "ids", "tfs", "lengths", "max_tf", "min_length", F.when(F.col("term").isNull(), 0).otherwise(bucket_of(F.col("term"), buckets)).alias("bucket"), kind)
    rows.sortWithinPartitions("kind", "bucket", "term", "block").write.partitionBy("kind", "bucket").parquet(f"{path}/rows")
    rows = rows.drop("kind")
    for folder in (POSTINGS, LISTED):  # where there are no rows of a kind
        known.made(f"{path}/{folder}")
    P.listed(spark.read.schema(rows.schema).parquet(f"{path}/{LISTED}")).write.parquet(f"{path}/docs")
    stored = spark.read.schema(rows.schema).parquet(f"{path}/{POSTINGS}")
    terms = stored.groupBy("term").agg(F.sum(F.size("ids")).cast("long").alias("df"), F.max("max_tf").alias("max_tf"), F.min("min_length").alias("min_length"))
    if gone is not None:
        none = F.lit(None).cast("int")
        terms = terms.unionByName(gone.select("term", (-F.col("df")).alias("df"), none.alias("max_tf"), none.alias("min_length")))
    terms.sort("term").write.parquet(f"{path}/terms")
    totals = [F.count("*"), F.count_if(F.col("length") > 0), F.coalesce(F.sum("length"), F.lit(0))]
    sizes = list(spark.read.parquet(f"{path}/docs").agg(*totals).first())
    if removed is not None:
        removed.select("id").write.parquet(f"{path}/removed")
        sizes = [a - b for a, b in zip(sizes, removed.agg(*totals).first(), strict=True)]
    schemas = {"postings": rows.schema, "terms": terms.schema, "docs": spark.read.parquet(f"{path}/docs").schema, "removed": docs.select("id").schema}
    ddl = {k: ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in v) for k, v in schemas.items()}
    return {"path": path, "buckets": buckets, "blocks": blocks, "docs": sizes[0], "filled": sizes[1], "length": sizes[2], "removes": removed is not None, "schemas": ddl}


def build(docs: DataFrame, root: str, *, words: Sequence[str] = (), id_col: str = "doc_id", text_col: str = "text") -> Index:
    """The index of ``docs`` as the next version at ``root``, in place of what is there."""
    known = Versions(docs.sparkSession, root)
    after, _ = known.latest()
    segment = _segment(known, docs.select(F.col(id_col).alias("id"), F.col(text_col).alias("text")), words)
    state = {"words": list(words), "segments": [segment]}
    return Index(docs.sparkSession, known.root, known.commit(after, state), state)


def _taken_off(index: Index, ids: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(removed, gone) for :func:`_segment`: those of ``ids`` (id) that the index holds, with their lengths, and their terms' counts."""
    removed = index.docs().join(ids.select("id").distinct(), "id", "left_semi")
    places = index.blocks().select("segment", "block", "term", F.explode("ids").alias("id"))
    gone_before = index._removed()
    places = places.join(ids.select("id").distinct(), "id", "left_semi")
    if gone_before is not None:
        places = places.join(gone_before, ["segment", "id"], "left_anti")
    return removed, places.groupBy("term").agg(F.count("*").alias("df"))


def added(index: Index, docs: DataFrame, *, id_col: str = "doc_id", text_col: str = "text") -> Index:
    """The next version: ``docs`` added, or in place of documents of the same ids."""
    known = Versions(index.spark, index.root)
    rows = docs.select(F.col(id_col).alias("id"), F.col(text_col).alias("text"))
    removed, gone = _taken_off(index, rows)
    old = not removed.isEmpty()
    segment = _segment(known, rows, index.words, removed if old else None, gone if old else None)
    state = {"words": index.words, "segments": [*index.segments, segment]}
    return Index(index.spark, index.root, known.commit(index.version, state), state)


def removed(index: Index, ids: DataFrame) -> Index:
    """The next version without the documents of ``ids`` (id)."""
    known = Versions(index.spark, index.root)
    off, gone = _taken_off(index, ids)
    none = ids.select("id").limit(0).withColumn("text", F.lit(""))
    state = {"words": index.words, "segments": [*index.segments, _segment(known, none, index.words, off, gone)]}
    return Index(index.spark, index.root, known.commit(index.version, state), state)


def reindexed(index: Index, docs: DataFrame, words: Sequence[str], *, id_col: str = "doc_id", text_col: str = "text") -> Index:
    """The next version, with another dictionary: of ``docs``, the indexed documents, those whose tokens change are indexed anew.

    Only texts that hold a word that has come or gone are tokenised, by both dictionaries. The version before stays as it is.
    """
    known = Versions(index.spark, index.root)
    rows = docs.select(F.col(id_col).alias("id"), F.col(text_col).alias("text"))
    changed = sorted({w.lower() for w in words} ^ {w.lower() for w in index.words})
    holds = holds_any(F.lower(F.coalesce("text", F.lit(""))), changed) if changed else F.lit(False)
    touched = rows.where(holds)
    touched = touched.where(T.tokens(F.coalesce("text", F.lit("")), words) != T.tokens(F.coalesce("text", F.lit("")), index.words))
    off, gone = _taken_off(index, touched)
    state = {"words": list(words), "segments": [*index.segments, _segment(known, touched, words, off, gone)]}
    return Index(index.spark, index.root, known.commit(index.version, state), state)


def compacted(index: Index) -> Index:
    """The next version with one segment in place of many: postings are merged, no text is read."""
    known = Versions(index.spark, index.root)
    path, n = known.folder("segment"), index.n_docs
    buckets, blocks = max(s["buckets"] for s in index.segments), max(1, -(-n // P.BLOCK))
    parts = []
    for i, s in enumerate(index.segments):
        rows = index._table("postings", s).select("term", F.explode(F.arrays_zip("ids", "tfs", "lengths")).alias("p")).select("term", F.col("p.ids").alias("id"), F.col("p.tfs").alias("tf"), F.col("p.lengths").alias("length"))
        parts.append(index._live(rows, i))
    block = F.pmod(F.xxhash64("id"), F.lit(blocks)).cast("int")
    rows = reduce(DataFrame.unionByName, parts).select(bucket_of(F.col("term"), buckets).alias("bucket"), block.alias("block"), "term", "id", "tf", "length")
    rows = rows.withColumn("part", F.col("block") % 16).repartition("bucket", "part").groupBy("bucket", "part", "block", "term")
    rows = rows.agg(F.array_sort(F.collect_list(F.struct("id", "tf", "length"))).alias("p"), F.max("tf").alias("max_tf"), F.min("length").alias("min_length"))
    rows = rows.select("bucket", "term", "block", F.col("p.id").alias("ids"), F.col("p.tf").alias("tfs"), F.col("p.length").alias("lengths"), "max_tf", "min_length")
    rows.sortWithinPartitions("bucket", "term", "block").write.partitionBy("bucket").parquet(f"{path}/{POSTINGS}")
    index.docs().write.parquet(f"{path}/docs")
    stored = index.spark.read.schema(rows.schema).parquet(f"{path}/{POSTINGS}")
    terms = stored.groupBy("term").agg(F.sum(F.size("ids")).cast("long").alias("df"), F.max("max_tf").alias("max_tf"), F.min("min_length").alias("min_length"))
    terms.sort("term").write.parquet(f"{path}/terms")
    one = {k: sum(s[k] for s in index.segments) for k in ("docs", "filled", "length")}
    segment = {"path": path, "buckets": buckets, "blocks": blocks, "removes": False, "schemas": index.segments[0]["schemas"]} | one
    state = {"words": index.words, "segments": [segment]}
    return Index(index.spark, index.root, known.commit(index.version, state), state)
