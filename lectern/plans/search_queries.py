"""Keyword, vector and hybrid search over documents and embeddings, batched by query."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..operators import evaluate as E
from ..operators import search as S
from .registry import Tables, query
from .text_queries import TOKENS

#: Every document and vector whose id is divisible by it is a query against all: a document by its first line.
EVERY = 50

STATS = f"""toks AS (SELECT doc_id AS id, {TOKENS.format("coalesce(text, '')")} AS tokens FROM documents),
stats AS (SELECT CAST(count(*) AS DOUBLE) AS n, avg(CASE WHEN len(tokens) > 0 THEN len(tokens) END) AS avgdl FROM toks),
posts AS (SELECT id, dl, term, count(*) AS tf FROM (SELECT id, len(tokens) AS dl, unnest(tokens) AS term FROM toks) GROUP BY 1, 2, 3),
freq AS (SELECT term, count(*) AS df FROM posts GROUP BY 1)"""
TERMS = "terms AS (SELECT DISTINCT query_id, unnest(" + TOKENS.format("query") + ") AS term FROM ({asked}) a)"


def terms(asked: str) -> str:
    return TERMS.replace("{asked}", asked)


ASKED = f"SELECT doc_id AS query_id, string_split(text, chr(10))[1] AS query FROM documents WHERE doc_id % {EVERY} = 0"
WEIGHT = "ln(1 + (n - df + 0.5) / (df + 0.5)) * tf * 2.2 / (tf + 1.2 * (0.25 + 0.75 * dl / avgdl))"
SCORES = f"scores AS (SELECT query_id, id, round(sum({WEIGHT}), 6) AS score FROM posts JOIN freq USING (term) JOIN terms USING (term), stats {{where}} GROUP BY 1, 2)"
RANKED = "{name} AS (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, id) AS rank FROM {scores})"
KEYWORD = f"WITH {STATS}, {terms(ASKED)}, {SCORES.format(where='')}, {RANKED.format(name='kw', scores='scores')}"
DOT = "list_sum(list_transform(list_zip({a}, {b}), lambda z: CAST(z[1] AS DOUBLE) * CAST(z[2] AS DOUBLE)))"
VEC = "vscores AS (SELECT q.vec_id AS query_id, e.vec_id AS id, round(" + DOT.format(a="e.embedding", b="q.embedding") + " / (sqrt(" + DOT.format(a="e.embedding", b="e.embedding") + ") * sqrt(" + DOT.format(a="q.embedding", b="q.embedding") + ")), 6) AS score FROM embeddings e, embeddings q WHERE q.vec_id % 50 = 0 {where})"
PAIR = f"WITH {STATS}, {terms(ASKED)}, {SCORES.format(where='')}, {RANKED.format(name='kw', scores='scores')}, {VEC.format(where='')}, {RANKED.format(name='vec', scores='vscores')}"
FUSED = "fused AS (SELECT coalesce(v.query_id, k.query_id) AS query_id, coalesce(v.id, k.id) AS id, v.rank AS ra, k.rank AS rb, round(coalesce(1.0 / (60 + v.rank), 0) + coalesce(1.0 / (60 + k.rank), 0), 9) AS score FROM (SELECT * FROM vec WHERE rank <= 20) v FULL OUTER JOIN (SELECT * FROM kw WHERE rank <= 20) k ON v.query_id = k.query_id AND v.id = k.id), hybrid AS (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, ra NULLS LAST, rb NULLS LAST, id) AS rank FROM fused)"
OUT = "SELECT query_id, id, CAST(score AS DOUBLE) AS score, CAST(rank AS INTEGER) AS rank FROM {0} WHERE rank <= {1}"


def asked(t: Tables) -> DataFrame:
    return t.documents.where(F.col("doc_id") % EVERY == 0).select(F.col("doc_id").alias("query_id"), F.get(F.split("text", "\n"), F.lit(0)).alias("query"))


def asked_vectors(t: Tables) -> DataFrame:
    return t.embeddings.where(F.col("vec_id") % EVERY == 0).select(F.col("vec_id").alias("query_id"), F.col("embedding").alias("vector"))


def both_pools(t: Tables, pool: int = 20) -> tuple[DataFrame, DataFrame]:
    return S.vector_search(t.embeddings, asked_vectors(t), pool), t.index().keyword_search(asked(t), pool)


@query(f"{KEYWORD} {OUT.format('kw', 10)}")
def bm25_topk(t: Tables):
    return t.index().keyword_search(asked(t), 10)


@query(f"WITH {STATS}, {terms(ASKED)}, {SCORES.format(where='WHERE id IN (SELECT doc_id FROM documents WHERE source = ' + chr(39) + 'src1' + chr(39) + ')')}, {RANKED.format(name='kw', scores='scores')} {OUT.format('kw', 10)}")
def bm25_scoped(t: Tables):
    return t.index().keyword_search(asked(t), 10, scope=t.documents.where("source = 'src1'").select("doc_id"))


@query(f"{KEYWORD} {OUT.format('kw', 10)}")
def bm25_unindexed(t: Tables):
    """The same search, over the texts themselves."""
    return S.keyword_search(t.documents, asked(t), 10)


@query(f"WITH {STATS} SELECT CAST(n AS BIGINT) AS n_docs, round(avgdl, 6) AS avg_length FROM stats")
def corpus_stats(t: Tables):
    return S.corpus_stats(S.tokenised(t.documents)).select("n_docs", F.round("avg_length", 6).alias("avg_length"))


@query(f"WITH {STATS} SELECT term, df FROM freq")
def doc_freq(t: Tables):
    return t.index().doc_freq().select("term", "df")


@query(f"WITH {STATS} SELECT id, term, tf FROM posts")
def term_freq(t: Tables):
    return S.postings(S.tokenised(t.documents)).select("id", "term", "tf")


@query(f"WITH {STATS} SELECT term, round(ln(1 + (n - df + 0.5) / (df + 0.5)), 6) AS idf FROM freq, stats")
def idf_table(t: Tables):
    known = t.index()
    return known.doc_freq().select("term", F.round(S.idf(F.lit(known.n_docs), F.col("df")), 6).alias("idf"))


@query(f"WITH {VEC.format(where='AND q.vec_id = 0')}, {RANKED.format(name='vec', scores='vscores')} {OUT.format('vec', 5)}")
def vector_topk(t: Tables):
    return S.vector_search(t.embeddings, asked_vectors(t).where("query_id = 0"), 5)


@query(f"WITH {VEC.format(where='')}, {RANKED.format(name='vec', scores='vscores')} {OUT.format('vec', 10)}")
def vector_topk_batch(t: Tables):
    return S.vector_search(t.embeddings, asked_vectors(t), 10)


@query(f"WITH {VEC.format(where='AND e.label = 1')}, {RANKED.format(name='vec', scores='vscores')} {OUT.format('vec', 10)}")
def vector_scoped(t: Tables):
    return S.vector_search(t.embeddings, asked_vectors(t), 10, scope=t.embeddings.where("label = 1").select("vec_id"))


@query(f"{PAIR}, {FUSED} {OUT.format('hybrid', 10)}")
def rrf_hybrid(t: Tables):
    vector, keyword = both_pools(t)
    return S.fuse(vector, keyword, 10).select("query_id", "id", "score", "rank")


@query(f"""{PAIR}, {FUSED}, pool AS (SELECT query_id, id, 0 AS side, rank FROM hybrid WHERE rank <= 10), more AS (SELECT query_id, id, 1 AS side, rank FROM kw WHERE rank <= 4 AND NOT EXISTS (SELECT 1 FROM pool p WHERE p.query_id = kw.query_id AND p.id = kw.id))
SELECT query_id, id, CAST(row_number() OVER (PARTITION BY query_id ORDER BY side, rank) AS INTEGER) AS rank FROM (SELECT * FROM pool UNION ALL SELECT * FROM more)""")
def candidate_union(t: Tables):
    vector, keyword = both_pools(t)
    return S.candidate_union(S.fuse(vector, keyword, 10), keyword, 4)


@query(f"{KEYWORD} SELECT query_id, id, CAST(rank AS INTEGER) AS rank, round(1 - (rank - 1) * 1e-6, 9) AS score FROM kw WHERE rank <= 10")
def noop_rerank(t: Tables):
    return S.keep_order_rerank(t.index().keyword_search(asked(t), 10)).select("query_id", "id", "rank", F.round("score", 9).alias("score"))


GUARD = """core AS (SELECT query_id, id, rank FROM {core} WHERE rank <= {k}), miss AS (SELECT query_id, id, row_number() OVER (PARTITION BY query_id ORDER BY rank) AS place FROM (SELECT * FROM kw WHERE rank <= {n}) m WHERE NOT EXISTS (SELECT 1 FROM core c WHERE c.query_id = m.query_id AND c.id = m.id)),
added AS (SELECT * FROM miss WHERE place <= {most}), cnt AS (SELECT query_id, count(*) AS n FROM added GROUP BY 1),
kept AS (SELECT c.query_id, c.id, c.rank FROM core c LEFT JOIN cnt USING (query_id) WHERE c.rank <= {k} - coalesce(cnt.n, 0)),
guarded AS (SELECT query_id, id, CAST(rank AS INTEGER) AS rank, CAST(NULL AS VARCHAR) AS via FROM kept UNION ALL SELECT a.query_id, a.id, CAST(coalesce(k.n, 0) + a.place AS INTEGER), 'lexguard' FROM added a LEFT JOIN (SELECT query_id, count(*) AS n FROM kept GROUP BY 1) k USING (query_id))"""


@query(f"{PAIR}, {GUARD.format(core='vec', k=9, n=6, most=3)} SELECT query_id, id, rank, via FROM guarded")
def lexguard(t: Tables):
    vector, keyword = both_pools(t)
    return S.lexical_guard(vector.where("rank <= 9"), keyword.where("rank <= 6"), 9, 6)


CHAIN = "chain AS (SELECT conv_id * 1000 + turn AS id, conv_id AS doc, turn AS position FROM conversations)"
SEEDS = "seeds AS (SELECT conv_id // 10 AS query_id, conv_id * 1000 + turn AS id, conv_id AS doc, turn AS position, CAST(row_number() OVER (PARTITION BY conv_id // 10 ORDER BY conv_id, turn) AS INTEGER) AS rank FROM conversations WHERE (conv_id * 7 + turn) % 11 = 0)"


def neighbour_sql(hops: int) -> str:
    steps = ", ".join(f"({h}, {d})" for h in range(1, hops + 1) for d in (-1, 1))
    return f"""WITH {CHAIN}, {SEEDS}, near AS (SELECT s.query_id, c.id, min(st.hop * 100000000 + s.rank * 10 + st.side) AS pos FROM seeds s, (VALUES {steps}) st(hop, side), chain c WHERE c.doc = s.doc AND c.position = s.position + st.hop * st.side AND c.id NOT IN (SELECT id FROM seeds) GROUP BY 1, 2),
allof AS (SELECT query_id, id, CAST(NULL AS VARCHAR) AS via, rank * 10 AS pos FROM seeds UNION ALL SELECT query_id, id, 'neighbor', pos FROM near)
SELECT query_id, id, via, CAST(row_number() OVER (PARTITION BY query_id ORDER BY pos, id) AS INTEGER) AS rank FROM allof"""


def neighbours(t: Tables, hops: int) -> DataFrame:
    chain = t.conversations.select((F.col("conv_id") * 1000 + F.col("turn")).alias("id"), F.col("conv_id").alias("doc"), F.col("turn").alias("position"))
    seeds = chain.where("(doc * 7 + position) % 11 = 0").withColumn("query_id", F.floor(F.col("doc") / 10))
    seeds = seeds.withColumn("rank", F.row_number().over(Window.partitionBy("query_id").orderBy("doc", "position")))
    return S.expand_neighbours(seeds.select("query_id", "id", "rank"), chain, hops)


@query(neighbour_sql(1))
def neighbors_1(t: Tables):
    return neighbours(t, 1)


@query(neighbour_sql(2))
def neighbors_2(t: Tables):
    return neighbours(t, 2)


@query("""SELECT conv_id, turn, lag(turn) OVER w AS prev_turn, lead(turn) OVER w AS next_turn FROM conversations WINDOW w AS (PARTITION BY conv_id ORDER BY turn)""")
def chain_links(t: Tables):
    order = Window.partitionBy("conv_id").orderBy("turn")
    return t.conversations.select("conv_id", "turn", F.lag("turn").over(order).alias("prev_turn"), F.lead("turn").over(order).alias("next_turn"))


NEAR = """near AS (SELECT g.query_id, g.id + st.side AS id, min(g.rank * 10 + st.side) AS pos FROM guarded g, (VALUES (-1), (1)) st(side) WHERE EXISTS (SELECT 1 FROM documents d JOIN documents e ON e.doc_id = d.doc_id + st.side AND e.doc_id // 10 = d.doc_id // 10 WHERE d.doc_id = g.id) AND NOT EXISTS (SELECT 1 FROM guarded x WHERE x.query_id = g.query_id AND x.id = g.id + st.side) GROUP BY 1, 2),
allof AS (SELECT query_id, id, via, 0 AS hop, rank * 10 AS pos FROM guarded UNION ALL SELECT query_id, id, 'neighbor', 1, pos FROM near)
SELECT query_id, id, via, CAST(row_number() OVER (PARTITION BY query_id ORDER BY hop, pos, id) AS INTEGER) AS rank FROM allof"""


def chained(t: Tables) -> DataFrame:
    return t.documents.select(F.col("doc_id").alias("id"), F.floor(F.col("doc_id") / 10).alias("doc"), F.col("doc_id").alias("position"))


def asked_both(t: Tables) -> DataFrame:
    return asked(t).join(asked_vectors(t), "query_id", "full_outer")


@query(f"""{PAIR}, {FUSED}, {GUARD.format(core='hybrid', k=5, n=2, most=1)}, {NEAR}""")
def retrieve_full(t: Tables):
    return S.retrieve(t.index(), t.embeddings, asked_both(t), chain=chained(t))


def by_hash(candidates: DataFrame) -> DataFrame:
    """A stand-in for a reranker: scores that only depend on query and id."""
    return candidates.withColumn("score", F.pmod(F.col("id") * 7919 + F.col("query_id") * 31, F.lit(1009)) / 1009)


@query(f"""{PAIR}, {FUSED}, cand AS (SELECT query_id, id, rank AS place, coalesce(krank <= 2, false) AS guarded FROM (SELECT h.query_id, h.id, h.rank, k.rank AS krank FROM hybrid h LEFT JOIN kw k ON k.query_id = h.query_id AND k.id = h.id WHERE h.rank <= 20)
UNION ALL SELECT query_id, id, 100 + rank, true FROM kw WHERE rank <= 2 AND NOT EXISTS (SELECT 1 FROM hybrid h WHERE h.rank <= 20 AND h.query_id = kw.query_id AND h.id = kw.id)),
scored AS (SELECT *, (id * 7919 + query_id * 31) % 1009 AS score FROM cand), ranked AS (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, place) AS r FROM scored),
extra AS (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY r) AS nth FROM ranked WHERE guarded AND r > 5), n AS (SELECT query_id, count(*) AS n FROM extra WHERE nth <= 1 GROUP BY 1),
final AS (SELECT r.query_id, r.id, CAST(NULL AS VARCHAR) AS via, r.r FROM ranked r LEFT JOIN n USING (query_id) WHERE r.r <= 5 - coalesce(n.n, 0) UNION ALL SELECT query_id, id, 'lexguard', r FROM extra WHERE nth <= 1)
SELECT query_id, id, via, CAST(row_number() OVER (PARTITION BY query_id ORDER BY r) AS INTEGER) AS rank FROM final""")
def retrieve_reranked(t: Tables):
    return S.retrieve(t.index(), t.embeddings, asked_both(t), rerank=by_hash)


SCOPE = "WHERE id IN (SELECT doc_id FROM documents WHERE lang = 'en')"


@query(f"""WITH {STATS}, {terms(ASKED)}, {SCORES.format(where=SCOPE)}, {RANKED.format(name='kw', scores='scores')}, {VEC.format(where="AND e.vec_id IN (SELECT doc_id FROM documents WHERE lang = 'en')")}, {RANKED.format(name='vec', scores='vscores')}, {FUSED}, {GUARD.format(core='hybrid', k=5, n=2, most=1)} SELECT query_id, id, via, rank FROM guarded""")
def retrieve_scoped(t: Tables):
    return S.retrieve(t.index(), t.embeddings, asked_both(t), scope=t.documents.where("lang = 'en'").select("doc_id"))


@query(f"""{PAIR}, {FUSED}, met AS (SELECT query_id, id // 10 AS page_id, min(rank) AS best FROM hybrid WHERE rank <= 10 AND id % 10 <> 3 AND id IN (SELECT doc_id FROM documents) GROUP BY 1, 2) SELECT query_id, page_id, CAST(row_number() OVER (PARTITION BY query_id ORDER BY best, page_id) AS INTEGER) AS rank FROM met""")
def search_pages(t: Tables):
    vector, keyword = both_pools(t)
    return S.hits_to_pages(S.fuse(vector, keyword, 10), pages_of_documents(t))


def pages_of_documents(t: Tables) -> DataFrame:
    return t.documents.select(F.col("doc_id").alias("id"), F.when(F.col("doc_id") % 10 != 3, F.floor(F.col("doc_id") / 10)).alias("page_id"))


@query("""SELECT place, d.doc_id, d.source FROM (SELECT unnest([7, 3, 11, 3]) AS doc_id, unnest([0, 1, 2, 3]) AS place) i JOIN documents d USING (doc_id)""")
def order_preserving_lookup(t: Tables):
    ids = t.spark.createDataFrame([([7, 3, 11, 3],)], "ids array<long>")
    return S.in_order(ids, t.documents.select("doc_id", "source"), "doc_id").select("place", "doc_id", "source")


@query(f"""{KEYWORD}, met AS (SELECT query_id, id // 10 AS page_id, min(rank) AS best FROM kw WHERE rank <= 10 AND id % 10 <> 3 GROUP BY 1, 2) SELECT query_id, page_id, CAST(row_number() OVER (PARTITION BY query_id ORDER BY best, page_id) AS INTEGER) AS rank FROM met""")
def hits_to_pages(t: Tables):
    return S.hits_to_pages(t.index().keyword_search(asked(t), 10), pages_of_documents(t))


CLAMPED = "WHERE id IN (SELECT doc_id FROM documents WHERE lang IN ('en', 'fr') AND source IN ('src1', 'src2'))"


@query(f"""WITH {STATS}, {terms(ASKED)}, {SCORES.format(where=CLAMPED)}, {RANKED.format(name='kw', scores='scores')}, met AS (SELECT query_id, id // 10 AS page_id, min(rank) AS best FROM kw WHERE rank <= 10 AND id % 10 <> 3 GROUP BY 1, 2) SELECT query_id, page_id, CAST(row_number() OVER (PARTITION BY query_id ORDER BY best, page_id) AS INTEGER) AS rank FROM met""")
def grep_clamped(t: Tables):
    """Pages with a keyword, of the documents asked for that are allowed: the scope is what both have in common."""
    allowed, wanted = t.documents.where("lang IN ('en', 'fr')").select("doc_id"), t.documents.where("source IN ('src1', 'src2')").select("doc_id")
    return S.hits_to_pages(t.index().keyword_search(asked(t), 10, scope=wanted.join(allowed, "doc_id", "left_semi")), pages_of_documents(t))


@query()
def retrieve_chunks(t: Tables):
    """From documents to chunks: chunked, embedded and indexed once; the hybrid ranking of each fiftieth document's first line."""
    return t.knowledge().retrieve(asked(t))


BY_ITEM = f"WITH {STATS}, {terms('SELECT item_id AS query_id, text AS query FROM benchmark')}, {SCORES.format(where='')}, {RANKED.format(name='kw', scores='scores')}"
CASES = """cases AS (SELECT item_id AS case_id, unnest([string_split(text, ' ')[1] || ' ' || string_split(text, ' ')[2], string_split(text, ' ')[3], 'nowhere at all']) AS span FROM benchmark),
spans AS (SELECT DISTINCT case_id, span FROM cases),
hits AS (SELECT query_id AS case_id, text AS content FROM kw JOIN documents ON doc_id = id WHERE rank <= 5),
nrm AS (SELECT case_id, lower(trim(regexp_replace(content, '\\s+', ' ', 'g'))) AS c FROM hits),
sp AS (SELECT case_id, span, lower(trim(regexp_replace(span, '\\s+', ' ', 'g'))) AS s FROM spans),
found AS (SELECT sp.case_id, sp.span, coalesce(bool_or(CASE WHEN regexp_full_match(s, '[a-z0-9]+') THEN regexp_matches(c, '(^|[^a-z0-9])' || s || '([^a-z0-9]|$)') ELSE contains(regexp_replace(c, '\\s+', '', 'g'), regexp_replace(s, '\\s+', '', 'g')) END), false) AS found FROM sp LEFT JOIN nrm USING (case_id) GROUP BY 1, 2)"""


def found_spans(t: Tables) -> DataFrame:
    words = F.split("text", " ")
    spans = F.array(F.concat_ws(" ", F.get(words, F.lit(0)), F.get(words, F.lit(1))), F.get(words, F.lit(2)), F.lit("nowhere at all"))
    cases = t.benchmark.select(F.col("item_id").alias("case_id"), F.array_distinct(spans).alias("spans"))
    found = t.index().keyword_search(t.benchmark.select(F.col("item_id").alias("query_id"), F.col("text").alias("query")), 5)
    hits = found.join(t.documents, F.col("id") == F.col("doc_id")).select(F.col("query_id").alias("case_id"), F.col("text").alias("content"))
    return E.span_hits(cases, hits)


@query(f"{BY_ITEM}, {CASES}, r AS (SELECT case_id, bool_and(found) AS passed, count(*) FILTER (WHERE found) AS n_hit, count(*) AS n_total FROM found GROUP BY 1) SELECT count(*) AS n_cases, coalesce(avg(CAST(passed AS INTEGER)), 0.0) AS coverage, coalesce(CAST(sum(n_hit) AS DOUBLE) / sum(n_total), 0.0) AS span_coverage FROM r")
def coverage_at_k(t: Tables):
    return E.coverage(E.case_report(found_spans(t)))


@query(f"{BY_ITEM}, {CASES} SELECT case_id, coalesce(string_agg(CASE WHEN NOT found THEN span END, '|' ORDER BY span), '') AS missing FROM found GROUP BY 1")
def missing_spans(t: Tables):
    return E.case_report(found_spans(t)).select("case_id", F.array_join("missing", "|").alias("missing"))
