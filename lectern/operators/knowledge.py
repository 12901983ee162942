"""A knowledge base of chunks: documents are chunked, prefixed, tokenised and embedded once, and chunks are what searches find.

At ``root`` lie ``chunks`` (a table of :class:`lectern.sources.pagestore.DocumentRows`, so that a document is ingested whole or not at
all) with each chunk's prefix, content and vector, and ``index``, the stored inverted index of the chunks' contents by chunk id.
"""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..functions import text as T
from ..functions import vectors as V
from ..sources.pagestore import DocumentRows
from . import index as I
from . import search as S
from .blocks import chunk_markdown

#: Table rows of a document beyond which none of them gets a written prefix.
MOST_ROWS = 400


def row_guard(chunks: DataFrame, most: int = MOST_ROWS) -> Column:
    """Whether a chunk of ``chunks`` (id, is_table_row) may have a written prefix: rows of documents with very many have none."""
    rows = F.count_if("is_table_row").over(Window.partitionBy("id"))
    return ~F.col("is_table_row") | (rows <= most)


def embedded(text: Column, words: list[str] | tuple[str, ...] = ()) -> Column:
    """The vector of a text: signed feature hashing of its tokens, in place of a model."""
    return V.hashed(T.tokens(text, words))


def prepared(docs: DataFrame, *, id_col: str = "doc_id", text_col: str = "text", title: Column | None = None, written: Callable[[DataFrame], DataFrame] | None = None, words: tuple[str, ...] = (), **options) -> DataFrame:
    """(chunk_id, doc_id, position, content_original, context_prefix, content, heading_path, chunk_type, is_table_row, vector) of docs.

    ``written`` gives chunks a ``prefix`` of their own (null for none); those that :func:`row_guard` keeps from it, and those without,
    are headed by title and heading path.
    """
    name = title if title is not None else F.col(id_col).cast("string")
    chunks = chunk_markdown(docs, id_col=id_col, text_col=text_col, title=name, **options)
    titles = docs.select(F.col(id_col).cast("long").alias("id"), name.alias("title")).dropDuplicates(["id"])
    rows = chunks.join(titles, "id")
    rows = written(rows).withColumn("prefix", F.when(row_guard(rows), F.col("prefix"))) if written else rows.withColumn("prefix", F.lit(None).cast("string"))
    prefix = T.context_prefix(F.col("prefix"), F.col("title"), F.col("heading_path"))
    rows = rows.withColumn("context_prefix", prefix).withColumn("full", F.concat("context_prefix", F.lit("\n"), "content"))
    return rows.select(
        "chunk_id", F.col("id").alias("doc_id"), F.col("chunk_index").alias("position"), F.col("content").alias("content_original"), "context_prefix",
        F.col("full").alias("content"), "heading_path", "chunk_type", "is_table_row", embedded(F.col("full"), words).alias("vector"),
    )


@dataclass(frozen=True)
class KnowledgeBase:
    """Chunks and their index at ``root``."""

    spark: SparkSession
    root: str

    @property
    def store(self) -> DocumentRows:
        return DocumentRows(self.spark, f"{self.root}/chunks")

    def index(self) -> I.Index:
        return I.Index.at(self.spark, f"{self.root}/index")

    def chunks(self) -> DataFrame:
        return self.store.read()

    def ingest(self, docs: DataFrame, *, words: tuple[str, ...] = (), **options) -> None:
        """Chunk, embed and index documents; those that are there already are replaced, chunks that they no longer have go. ``words``
        is the dictionary of the first ingest; later ones keep that of the index."""
        old = self.store.read()
        known = self.index() if old is not None else None
        rows = prepared(docs, words=tuple(known.words) if known else words, **options)
        self.store.replace_all(rows)
        # read from what was written: nothing is chunked or embedded twice
        latest = self.spark.read.parquet(f"{self.store.versions.latest()[1]['parts'][-1]['path']}/rows")
        if known is None:
            I.build(latest, f"{self.root}/index", words=words, id_col="chunk_id", text_col="content")
            return
        gone = old.join(latest.select("doc_id").distinct(), "doc_id", "left_semi").join(latest.select("chunk_id"), "chunk_id", "left_anti").select(F.col("chunk_id").alias("id"))
        if not gone.isEmpty():
            known = I.removed(known, gone)
        I.added(known, latest, id_col="chunk_id", text_col="content")

    def retrieve(self, queries: DataFrame, *, scope: DataFrame | None = None, **options) -> DataFrame:
        """(query_id, id, via, rank) of queries (query_id, query): the hybrid ranking over chunks, and the chunks beside the hits.
        ``scope`` (doc_id) keeps it to the chunks of some documents."""
        chunks, index = self.chunks(), self.index()
        asked = queries.select("query_id", "query", embedded(F.col("query"), index.words).alias("vector"))
        vectors = chunks.select(F.col("chunk_id").alias("vec_id"), F.col("vector").alias("embedding"))
        chain = chunks.select(F.col("chunk_id").alias("id"), F.col("doc_id").alias("doc"), "position")
        within = chunks.join(scope.select("doc_id").distinct(), "doc_id", "left_semi").select("chunk_id") if scope is not None else None
        return S.retrieve(index, vectors, asked, chain=chain, scope=within, **options)
