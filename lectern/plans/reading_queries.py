"""A reader's batches: orders stand for documents and their lines for pages, the first line for the outline."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions import text as T
from ..operators import reading as D
from ..operators import relational as R
from .registry import Tables, query
from .search_queries import neighbour_sql, neighbours


def lines_as_pages(t: Tables) -> DataFrame:
    page = (F.col("l_linenumber") - 1).alias("page_index")
    return t.lineitem.groupBy(F.col("l_orderkey").alias("doc_id"), page).agg(F.max("l_returnflag").alias("title"), F.max("l_shipdate").cast("date").cast("string").alias("content"))


PAGES = "pages AS (SELECT l_orderkey AS doc_id, l_linenumber - 1 AS page_index, max(l_returnflag) AS title, CAST(CAST(max(l_shipdate) AS DATE) AS VARCHAR) AS content FROM lineitem GROUP BY 1, 2)"


@query(f"WITH {PAGES} SELECT o_orderkey AS doc_id, o_orderpriority AS title, count(*) FILTER (WHERE page_index > 0) AS n_pages FROM orders JOIN pages ON o_orderkey = doc_id WHERE o_orderstatus = 'F' GROUP BY 1, 2")
def ready_documents(t: Tables):
    docs = t.orders.select(F.col("o_orderkey").alias("doc_id"), F.col("o_orderpriority").alias("title"), (F.col("o_orderstatus") == "F").alias("ready"))
    return D.ready_documents(docs, lines_as_pages(t))


@query("SELECT c_custkey AS doc_id, c_name AS title FROM customer ORDER BY c_name, c_custkey")
def locale_sort(t: Tables):
    return D.by_title(t.customer.select(F.col("c_custkey").alias("doc_id"), F.col("c_name").alias("title")))


@query(f"""WITH {PAGES}, asked AS (SELECT event_id AS asked_id, user_id AS doc_id, CASE WHEN event_id % 10 <> 9 THEN CAST(event_id % 10 - 1 AS INTEGER) END AS page_index FROM events),
ends AS (SELECT doc_id, max(page_index) AS last_page FROM pages GROUP BY 1), a AS (SELECT a.*, o_orderkey IS NOT NULL AS known FROM asked a LEFT JOIN orders ON o_orderkey = a.doc_id AND o_orderstatus <> 'P')
SELECT asked_id, a.doc_id, a.page_index, CASE WHEN known THEN p.title END AS title, CASE WHEN known THEN p.content END AS content, CASE WHEN known THEN last_page END AS last_page,
CASE WHEN NOT known THEN 'scope' WHEN a.page_index IS NULL OR a.page_index < 0 THEN 'index' WHEN p.doc_id IS NULL THEN 'page' END AS problem
FROM a LEFT JOIN ends e ON e.doc_id = a.doc_id LEFT JOIN pages p ON p.doc_id = a.doc_id AND p.page_index = a.page_index""")
def read_pages(t: Tables):
    index = F.when(F.col("event_id") % 10 != 9, (F.col("event_id") % 10 - 1).cast("int")).alias("page_index")
    asked = t.events.select(F.col("event_id").alias("asked_id"), F.col("user_id").alias("doc_id"), index)
    scope = t.orders.where("o_orderstatus != 'P'").select(F.col("o_orderkey").alias("doc_id"))
    return D.read_pages(asked, lines_as_pages(t), scope)


def turns_as_chunks(t: Tables) -> DataFrame:
    """Turns of conversations as chunks; every third without a path in its metadata, some of whose paths start with a default name."""
    first = F.when(F.col("conv_id") % 7 == 0, F.lit(" Sheet  1")).otherwise(F.concat(F.lit(" "), "text"))
    whole = F.to_json(F.struct(F.array(first, F.col("role")).alias("heading_path")))
    metadata = F.when(F.col("turn") % 3 == 2, F.lit("{}")).otherwise(whole)
    return t.conversations.select(F.col("conv_id").alias("doc_id"), F.col("turn").alias("chunk_index"), metadata.alias("metadata"))


@query("""SELECT conv_id AS doc_id, turn AS chunk_index, CASE WHEN turn % 3 = 2 THEN CAST([] AS VARCHAR[]) ELSE [CASE WHEN conv_id % 7 = 0 THEN ' Sheet  1' ELSE ' ' || text END, role] END AS heading_path FROM conversations""")
def heading_listing(t: Tables):
    return D.heading_listing(turns_as_chunks(t))


@query("""WITH f AS (SELECT conv_id AS doc_id, arg_min(text, turn) AS heading, min(turn) AS turn FROM conversations GROUP BY 1)
SELECT doc_id, CASE WHEN doc_id % 7 <> 0 AND turn % 3 <> 2 AND trim(regexp_replace(heading, '\\s+', ' ', 'g')) <> '' THEN left(trim(regexp_replace(heading, '\\s+', ' ', 'g')), 80) END AS title FROM f""")
def title_recovery(t: Tables):
    return D.recovered_titles(D.heading_listing(turns_as_chunks(t)))


@query(f"SELECT * FROM ({neighbour_sql(1)}) WHERE via IS DISTINCT FROM 'neighbor'")
def visible_hits(t: Tables):
    return D.visible(neighbours(t, 1))


@query("""WITH k AS (SELECT user_id AS doc_id, CASE WHEN event_id % 3 = 0 THEN event_type END AS error, count(*) AS n, min(event_id) AS first FROM events GROUP BY 1, 2)
SELECT doc_id, CAST(sum(n) AS BIGINT) AS n_total, CAST(coalesce(sum(n) FILTER (WHERE error IS NULL), 0) AS BIGINT) AS n_pushed, CAST(coalesce(sum(n) FILTER (WHERE error IS NOT NULL), 0) AS BIGINT) AS n_failed,
count(error) AS n_kinds, coalesce(array_to_string((array_agg(error ORDER BY first) FILTER (WHERE error IS NOT NULL))[1:3], ' | '), '') AS first_errors FROM k GROUP BY 1""")
def push_outcomes(t: Tables):
    results = t.events.select(F.col("user_id").alias("doc_id"), F.col("event_id").alias("place"), F.when(F.col("event_id") % 3 == 0, F.col("event_type")).alias("error"))
    return D.push_outcomes(results)


@query("""SELECT o_orderkey, CASE WHEN o_orderkey % 4 <> 0 THEN o_clerk_group WHEN EXISTS (SELECT 1 FROM customer WHERE c_custkey = o_custkey + o_orderkey % 3 AND c_nationkey = o_custkey % 25) THEN o_custkey + o_orderkey % 3 ELSE o_clerk_group END AS group_id
FROM (SELECT *, CASE WHEN o_orderkey % 2 = 0 THEN o_custkey END AS o_clerk_group FROM orders)""")
def conditional_update(t: Tables):
    owner = F.col("o_custkey") % 25
    docs = t.orders.select("o_orderkey", owner.alias("owner"), F.when(F.col("o_orderkey") % 2 == 0, F.col("o_custkey")).alias("group_id"))
    changes = t.orders.where("o_orderkey % 4 = 0").select("o_orderkey", owner.alias("owner"), (F.col("o_custkey") + F.col("o_orderkey") % 3).alias("group_id"))
    groups = t.customer.select(F.col("c_custkey").alias("group_id"), F.col("c_nationkey").cast("long").alias("owner"))
    return R.update_where_exists(docs, changes, groups, "o_orderkey", "owner", "group_id").select("o_orderkey", "group_id")


@query(r"""SELECT doc_id, array_to_string(regexp_extract_all(lower('润度的 ' || text), '\bof the\b|润度|\bthe\b|\bof\b|\ben\b|[㐀-鿿]|[0-9]+|[a-z]+'), ' ') AS tokens FROM (SELECT doc_id, regexp_replace(text, '[^A-Za-z ]+', ' ', 'g') AS text FROM documents)""")
def custom_tokens(t: Tables):
    text = F.concat(F.lit("润度的 "), F.regexp_replace("text", "[^A-Za-z ]+", " "))
    return t.documents.select("doc_id", F.array_join(T.tokens(text, ["of the", *T.custom_words("the of，润度, en")]), " ").alias("tokens"))
