"""What a reader of documents asks for, in batches: which documents are ready, their pages, headings and titles; what a push came to."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

# Fixed value: names that sheets get by default, which are no titles.
GENERIC = r"(?i)^(sheet\s*\d*|工作表\s*\d*|表\s*\d*|根|untitled)$"
TITLE_LENGTH = 80


def ready_documents(docs: DataFrame, pages: DataFrame) -> DataFrame:
    """(doc_id, title, n_pages) of the ready documents (doc_id, title, ready) that have any page (doc_id, page_index). Page 0 is the
    outline and isn't counted: a document with nothing else has 0 pages, one without an outline or page isn't listed."""
    counted = pages.groupBy("doc_id").agg(F.count_if(F.col("page_index") > 0).alias("n_pages"))
    return docs.where("ready").select("doc_id", "title").join(counted, "doc_id")


def by_title(docs: DataFrame, collation: str = "zh") -> DataFrame:
    """Documents in the order that readers of a language expect of titles, then by id."""
    return docs.orderBy(F.collate("title", collation), "doc_id")


def read_pages(asked: DataFrame, pages: DataFrame, scope: DataFrame) -> DataFrame:
    """(asked_id, doc_id, page_index, title, content, last_page, problem) for each row of ``asked`` (asked_id, doc_id, page_index).

    ``problem`` is null where the page is found; else "scope" (the document isn't in ``scope`` (doc_id)), "index" (null or negative)
    or "page" (the document has no such page; ``last_page`` says how far they go, null where it has none). Title, content and
    last_page are null for documents out of scope.
    """
    known = scope.select("doc_id").distinct().withColumn("__known", F.lit(True))
    last = pages.groupBy("doc_id").agg(F.max("page_index").alias("last_page"))
    found = pages.select("doc_id", "page_index", "title", "content", F.lit(True).alias("__found"))
    rows = asked.join(known, "doc_id", "left").join(last, "doc_id", "left").join(found, ["doc_id", "page_index"], "left")
    problem = F.when(F.col("__known").isNull(), "scope").when(F.col("page_index").isNull() | (F.col("page_index") < 0), "index").when(F.col("__found").isNull(), "page")
    seen = [F.when(F.col("__known"), F.col(c)).alias(c) for c in ("title", "content", "last_page")]
    return rows.select("asked_id", "doc_id", "page_index", *seen, problem.alias("problem"))


def heading_listing(chunks: DataFrame) -> DataFrame:
    """(doc_id, chunk_index, heading_path) of chunks (doc_id, chunk_index, metadata: JSON); an empty path where the JSON has none or is
    no JSON."""
    path = F.from_json(F.get_json_object("metadata", "$.heading_path"), "array<string>")
    return chunks.select("doc_id", "chunk_index", F.coalesce(path, F.array().cast("array<string>")).alias("heading_path"))


def title_of(heading: Column) -> Column:
    """A title from a heading: white space folded, cut to 80 characters; null for blank ones and names that say nothing."""
    folded = F.trim(F.regexp_replace(heading, r"\s+", " "))
    return F.when((folded != "") & ~F.rlike(folded, F.lit(GENERIC)), F.left(folded, F.lit(TITLE_LENGTH)))


def recovered_titles(headings: DataFrame) -> DataFrame:
    """(doc_id, title) from the first part of the heading path of each document's first chunk (doc_id, chunk_index, heading_path)."""
    first = headings.groupBy("doc_id").agg(F.min_by("heading_path", "chunk_index").alias("path"))
    return first.select("doc_id", title_of(F.get("path", F.lit(0))).alias("title"))


def visible(hits: DataFrame) -> DataFrame:
    """Hits without the neighbours that only give context; those without a ``via`` stay."""
    return hits.where(~F.col("via").eqNullSafe("neighbor"))


def push_outcomes(results: DataFrame, shown: int = 3) -> DataFrame:
    """(doc_id, n_total, n_pushed, n_failed, n_kinds, first_errors) of pushed paragraphs (doc_id, place, error: null if it went
    through): different errors in the order in which they came up, the first ``shown`` of them. Documents with a failure are to be
    taken back. Counted by (document, error) first, so a document with very many paragraphs is never gathered."""
    kinds = results.groupBy("doc_id", "error").agg(F.count("*").alias("n"), F.min("place").alias("first"))
    rank = F.row_number().over(Window.partitionBy("doc_id").orderBy(F.col("error").isNull(), "first", "error"))
    failed = F.col("error").isNotNull()
    early = F.array_sort(F.collect_list(F.when(failed & (F.col("rank") <= shown), F.struct("rank", "error"))))
    out = kinds.withColumn("rank", rank).groupBy("doc_id").agg(
        F.sum("n").alias("n_total"),
        F.sum(F.when(failed, 0).otherwise(F.col("n"))).alias("n_pushed"),
        F.sum(F.when(failed, F.col("n")).otherwise(0)).alias("n_failed"),
        F.count("error").alias("n_kinds"),
        F.array_join(F.transform(early, lambda e: e["error"]), " | ").alias("first_errors"),
    )
    return out
