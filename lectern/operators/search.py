"""Keyword search by Okapi BM25, exact vector search, fusion, guards and neighbours.

Batches of queries go through one plan: every frame of hits is keyed by ``query_id``. Statistics are of the whole corpus, never of
a scope. Scores are rounded before they rank, and every order ends in an id, so ranks are the same on every run.
"""

from __future__ import annotations

import uuid
from collections.abc import Callable, Sequence
from typing import TYPE_CHECKING

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions import text as T
from ..functions import vectors as V
from ..sources.versions import shared_dir
from . import postings as P
from .postings import K1, B

if TYPE_CHECKING:
    from .index import Index

RRF = 60
#: Parts that the postings of a term are dealt to; queries in one matrix.
PARTS, QUERY_BLOCK = 32, 1024


def tokenised(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(id, tokens, length)"""
    return docs.select(F.col(id_col).alias("id"), T.tokens(F.coalesce(text_col, F.lit(""))).alias("tokens")).withColumn("length", F.size("tokens"))


def postings(tokens: DataFrame) -> DataFrame:
    """(term, id, tf, length): the inverted index, one row per term and document. Ids are unique, so rows of a document combine
    in the task that made them."""
    return tokens.select("id", "length", F.explode("tokens").alias("term")).groupBy("term", "id", "length").agg(F.count("*").alias("tf"))


def corpus_stats(tokens: DataFrame) -> DataFrame:
    """One row: documents, mean length of those that aren't empty."""
    return tokens.agg(F.count("*").alias("n_docs"), F.coalesce(F.avg(F.when(F.col("length") > 0, F.col("length"))), F.lit(0.0)).alias("avg_length"))


def doc_freq(posts: DataFrame) -> DataFrame:
    return posts.groupBy("term").agg(F.count("*").alias("df"))


def idf(n_docs: Column, df: Column) -> Column:
    return F.log(1 + (n_docs - df + 0.5) / (df + 0.5))


def bm25_weight(tf: Column, length: Column, n_docs: Column, avg_length: Column, df: Column) -> Column:
    """A term's part of a document's score."""
    average = F.when(avg_length > 0, avg_length).otherwise(1.0)
    return idf(n_docs, df) * tf * (K1 + 1) / (tf + K1 * (1 - B + B * length / average))


def query_terms(queries: DataFrame, words: Sequence[str] = ()) -> DataFrame:
    """(query_id, term) from (query_id, query): distinct tokens."""
    return queries.select("query_id", F.explode(F.array_distinct(T.tokens(F.col("query"), words))).alias("term"))


def weighted(posts: DataFrame, terms: DataFrame, stats: DataFrame, parts: int = PARTS) -> DataFrame:
    """(query_id, id, w): what each posting weighs for each query that has its term; terms (query_id, term, df), stats one row. A
    term's postings are dealt to ``parts`` parts by id, so that a term in all documents is no single group."""
    asked = terms.crossJoin(F.broadcast(stats)).withColumn("part", F.explode(F.sequence(F.lit(0), F.lit(parts - 1))))
    held = posts.withColumn("part", F.pmod(F.xxhash64("id"), F.lit(parts)).cast("int")).join(asked, ["term", "part"])
    return held.select("query_id", "id", bm25_weight(F.col("tf"), F.col("length"), F.col("n_docs"), F.col("avg_length"), F.col("df")).alias("w"))


def keyword_search(docs: DataFrame, queries: DataFrame, k: int, *, id_col: str = "doc_id", text_col: str = "text", scope: DataFrame | None = None) -> DataFrame:
    """(query_id, id, score, rank): the ``k`` best documents that hold any term; of the ids in ``scope`` if given. For a table that is
    searched once: others are better indexed (:mod:`lectern.operators.index`). Texts are shuffled by block of documents, and each block
    is one row, written to the shared folder, with the postings of the terms asked for; a match of a query and a document is no row."""
    spark, terms = docs.sparkSession, query_terms(queries)
    rows = docs.select(F.col(id_col).alias("id"), F.coalesce(text_col, F.lit("")).alias("text"))
    blocks = max(1, -(-rows.count() // P.BLOCK))
    held = P.gathered_blocks(rows, T.tokens(F.col("text")), blocks, P.sketch(terms.select("term").distinct()))
    kept, known = (f"{shared_dir(spark)}/search-{uuid.uuid4().hex}/{x}" for x in ("blocks", "known"))
    held.write.option("parquet.block.size", 8 << 20).parquet(kept)  # a row is a whole block, and a reader takes a group of rows at once
    met = spark.read.schema(held.schema).parquet(kept)
    n_docs, average = met.agg(F.coalesce(F.sum("docs"), F.lit(0)), F.coalesce(F.try_divide(F.sum("length"), F.sum("filled")), F.lit(0.0))).first()
    counted = met.select(F.explode(F.arrays_zip("terms", "counts")).alias("c"))
    freq = counted.groupBy(F.col("c.terms").alias("term")).agg(F.sum("c.counts").alias("df"))
    weighed = terms.join(freq, "term").select("query_id", "term", idf(F.lit(n_docs), F.col("df")).alias("idf"))
    weighed.write.parquet(known)
    if scope is not None:
        ids = scope.select(F.col(scope.columns[0]).alias("id"))
        met = met.select("block", "held").join(ids.groupBy(P.block_of(F.col("id"), blocks).alias("block")).agg(F.collect_set("id").alias("scope")), "block")
    scores = P.scored(met.withColumn("of", F.col("block")), spark.read.schema(weighed.schema).parquet(known), k, average, rows.schema["id"].dataType.simpleString())
    return top(scores.select("query_id", "id", F.round("score", 6).alias("score")), k)


def top(scores: DataFrame, k: int) -> DataFrame:
    """(query_id, id, score, rank) of the ``k`` best per query."""
    order = Window.partitionBy("query_id").orderBy(F.desc("score"), "id")
    return scores.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= k)


def vector_search(vectors: DataFrame, queries: DataFrame, k: int, *, id_col: str = "vec_id", vector_col: str = "embedding", scope: DataFrame | None = None) -> DataFrame:
    """(query_id, id, score, rank): the ``k`` nearest vectors by cosine for each query (query_id, vector); a stated set of queries
    against all rows, block by block: a block of rows times a block of queries is one matrix product, of which each task keeps the
    ``k`` best per query. Nulls aren't compared; a vector of zeros has score 0."""
    rows = vectors.where(F.col(vector_col).isNotNull())
    if scope is not None:
        rows = rows.join(scope.select(F.col(scope.columns[0]).alias(id_col)), id_col, "left_semi")
    rows = rows.select(F.col(id_col).alias("id"), F.col(vector_col).cast("array<float>").alias("v"))
    asked = queries.where("vector IS NOT NULL").select(F.col("query_id").alias("id"), F.col("vector").cast("array<float>").alias("v"))
    # Spark broadcasts the blocks of queries if they are small, else it takes the two sides' partitions pair by pair
    pairs = V.packed(rows).select(*[F.col(c).alias(f"row_{c}") for c in V.PACKED]).crossJoin(V.packed(asked, QUERY_BLOCK).select(*[F.col(c).alias(f"query_{c}") for c in V.PACKED]))
    types = {f.name: f.dataType.simpleString() for f in [*rows.schema, *asked.withColumnRenamed("id", "query_id").schema]}
    scores = V.nearest(pairs, k, types["query_id"], types["id"])
    return top(scores.select("query_id", "id", F.round("score", 6).alias("score")), k)


def fuse(first: DataFrame, second: DataFrame, k: int) -> DataFrame:
    """Reciprocal rank fusion of two rankings (query_id, id, rank); ties by place in the first, then in the second."""
    a = first.select("query_id", "id", F.col("rank").alias("rank_a"))
    b = second.select("query_id", "id", F.col("rank").alias("rank_b"))
    both = a.join(b, ["query_id", "id"], "full_outer")
    score = F.coalesce(1 / (RRF + F.col("rank_a")), F.lit(0.0)) + F.coalesce(1 / (RRF + F.col("rank_b")), F.lit(0.0))
    both = both.withColumn("score", F.round(score, 9))
    order = Window.partitionBy("query_id").orderBy(F.desc("score"), F.col("rank_a").asc_nulls_last(), F.col("rank_b").asc_nulls_last(), "id")
    return both.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= k)


def candidate_union(pool: DataFrame, keyword: DataFrame, n: int) -> DataFrame:
    """The pool, then the first ``n`` keyword hits that aren't in it: (query_id, id, rank)."""
    more = keyword.where(F.col("rank") <= n).join(pool, ["query_id", "id"], "left_anti")
    both = pool.select("query_id", "id", F.lit(0).alias("side"), "rank").unionByName(more.select("query_id", "id", F.lit(1).alias("side"), "rank"))
    order = Window.partitionBy("query_id").orderBy("side", "rank")
    return both.select("query_id", "id", F.row_number().over(order).alias("rank"))


def keep_order_rerank(hits: DataFrame) -> DataFrame:
    """The stand-in for a reranker: order is kept, scores fall by a millionth a rank."""
    return hits.withColumn("score", 1 - (F.col("rank") - 1) * 1e-6)


def lexical_guard(core: DataFrame, keyword: DataFrame, k: int, n: int) -> DataFrame:
    """At most min(n, max(1, k // 3)) leading keyword hits that the core lacks take the places of its tail:
    (query_id, id, rank, via)."""
    if n <= 0 or k <= 0:
        return core.select("query_id", "id", "rank", F.lit(None).cast("string").alias("via"))
    most = min(n, max(1, k // 3))
    # windows over both at once, so that each side's search is made once
    both = core.select("query_id", "id", "rank").join(keyword.select("query_id", "id", F.col("rank").alias("rank_k")), ["query_id", "id"], "full_outer")
    of_query, missing = Window.partitionBy("query_id"), F.col("rank").isNull()
    nth = F.sum(missing.cast("int")).over(of_query.orderBy(F.col("rank_k").asc_nulls_last(), "id").rowsBetween(Window.unboundedPreceding, 0))
    both = both.withColumn("nth", nth).withColumn("added", missing & (F.col("nth") <= most))
    both = both.withColumn("n_added", F.sum(F.col("added").cast("int")).over(of_query)).withColumn("kept", ~missing & (F.col("rank") <= k - F.col("n_added")))
    both = both.withColumn("n_kept", F.sum(F.col("kept").cast("int")).over(of_query)).where("kept OR added")
    return both.select("query_id", "id", F.when(F.col("kept"), F.col("rank")).otherwise(F.col("n_kept") + F.col("nth")).cast("int").alias("rank"), F.when(F.col("added"), "lexguard").alias("via"))


def expand_neighbours(core: DataFrame, chain: DataFrame, hops: int) -> DataFrame:
    """Hits and the chunks up to ``hops`` places before and after them in ``chain`` (id, doc, position), unseen ones only:
    core first, then by hop, by the core hit's rank, before then after. (query_id, id, via, rank); ``core`` may have a ``via``."""
    own = F.col("via") if "via" in core.columns else F.lit(None).cast("string")
    hits = core.select("query_id", "id", "rank", own.alias("own"))
    steps = [(0, 0)] + [(h, d) for h in range(1, hops + 1) for d in (-1, 1)]
    step = F.explode(F.array(*[F.struct(F.lit(h).alias("hop"), F.lit(d).alias("side")) for h, d in steps])).alias("step")
    placed = hits.join(chain, "id", "left").select("query_id", "id", "rank", "own", "doc", "position", step)
    wanted = placed.select("query_id", "id", "rank", "own", "doc", (F.col("position") + F.col("step.hop") * F.col("step.side")).alias("position"), "step.hop", "step.side")
    met = wanted.join(chain.select(F.col("id").alias("near"), "doc", "position"), ["doc", "position"], "left")
    met = met.select("query_id", F.when(F.col("hop") == 0, F.col("id")).otherwise(F.col("near")).alias("id"), "own", F.struct("hop", "rank", "side").alias("at")).where("id IS NOT NULL")
    found = met.groupBy("query_id", "id").agg(F.min("at").alias("at"), F.max(F.when(F.col("at.hop") == 0, F.col("own"))).alias("own"))
    order = Window.partitionBy("query_id").orderBy("at", "id")
    return found.select("query_id", "id", F.when(F.col("at.hop") > 0, "neighbor").otherwise(F.col("own")).alias("via"), F.row_number().over(order).alias("rank"))


def retrieve(
    docs: DataFrame | Index,
    vectors: DataFrame,
    queries: DataFrame,
    *,
    k: int = 5,
    pool: int = 20,
    hops: int = 1,
    guard: int = 2,
    chain: DataFrame | None = None,
    scope: DataFrame | None = None,
    rerank: Callable[[DataFrame], DataFrame] | None = None,
) -> DataFrame:
    """The whole ranking of (query_id, query, vector), of the ids in ``scope`` if given: both pools, fusion, guard and neighbours.
    (query_id, id, via, rank); ``docs`` is a table of texts or its stored index.

    ``rerank`` gives candidates (query_id, id, place) a ``score`` of their own: the pool and the leading keyword hits are then ranked
    by it together, guarded hits among them. Each search is made once; what follows are windows over its few rows per query.
    """
    asked = queries.where("query IS NOT NULL").select("query_id", "query")
    found = keyword_search(docs, asked, max(pool, guard), scope=scope) if isinstance(docs, DataFrame) else docs.keyword_search(asked, max(pool, guard), scope=scope)
    keyword = found.select("query_id", "id", F.col("rank").alias("rank_k"))
    vector = vector_search(vectors, queries, pool, scope=scope).select("query_id", "id", F.col("rank").alias("rank_v"))
    both = vector.join(keyword, ["query_id", "id"], "full_outer")
    rank_k = F.when(F.col("rank_k") <= pool, F.col("rank_k"))
    score = F.coalesce(1 / (RRF + F.col("rank_v")), F.lit(0.0)) + F.coalesce(1 / (RRF + rank_k), F.lit(0.0))
    of_query = Window.partitionBy("query_id")
    fused = of_query.orderBy(F.desc("score"), F.col("rank_v").asc_nulls_last(), F.col("rank_k").asc_nulls_last(), "id")
    hits = both.withColumn("score", F.round(score, 9)).withColumn("place", F.row_number().over(fused))
    hits = hits.withColumn("guarded", F.coalesce(F.col("rank_k") <= guard, F.lit(False))).where((F.col("place") <= pool) | F.col("guarded"))
    by = F.col("rank_k")
    if rerank is not None:
        scored = rerank(hits.select("query_id", "id", F.row_number().over(of_query.orderBy("place")).alias("place"), "guarded"))
        hits = scored.withColumn("place", F.row_number().over(of_query.orderBy(F.desc("score"), "place")))
        by = F.col("place")
    most = min(guard, max(1, k // 3)) if guard > 0 and k > 0 else 0
    core = F.col("place") <= k
    nth = F.sum((F.col("guarded") & ~core).cast("int")).over(of_query.orderBy(by.asc_nulls_last(), "id").rowsBetween(Window.unboundedPreceding, 0))
    hits = hits.withColumn("added", F.col("guarded") & ~core & (nth <= most)).withColumn("nth", nth)
    n_added = F.sum(F.col("added").cast("int")).over(of_query)
    kept = hits.withColumn("n_added", n_added).where(F.col("added") | (F.col("place") <= F.lit(k) - F.col("n_added")))
    last = of_query.orderBy("added", F.when(F.col("added"), F.col("nth")).otherwise(F.col("place"))) if rerank is None else of_query.orderBy(F.desc("score"), "place")
    found = kept.select("query_id", "id", F.when(F.col("added"), "lexguard").alias("via"), F.row_number().over(last).alias("rank"))
    return found if chain is None else expand_neighbours(found, chain, hops)


def in_order(ids: DataFrame, rows: DataFrame, on: str) -> DataFrame:
    """Rows for a list column ``ids`` (ids: array) with their place in the list."""
    return ids.select(F.posexplode("ids").alias("place", on)).join(rows, on)


def hits_to_pages(hits: DataFrame, chunk_pages: DataFrame) -> DataFrame:
    """Pages that hits fall on, each once, by its best hit: (query_id, page_id, rank)."""
    met = hits.join(chunk_pages.where(F.col("page_id").isNotNull()), "id").groupBy("query_id", "page_id").agg(F.min("rank").alias("best"))
    return met.withColumn("rank", F.row_number().over(Window.partitionBy("query_id").orderBy("best", "page_id"))).drop("best")
