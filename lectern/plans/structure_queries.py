"""Tables, chunks and pages, over markdown that each query renders from the test tables."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..functions import text as T
from ..operators import blocks as B
from ..operators import knowledge as K
from ..operators import prompts as O
from ..operators import pages as P
from ..operators import tables as M
from .registry import Tables, query

COLUMNS = ["p_brand", "p_type", "p_size", "p_name"]


def part_tables(t: Tables) -> DataFrame:
    """(k, markdown): parts as tables of 20 rows, in order of brand."""
    rows = t.part.withColumn("k", F.floor(F.col("p_partkey") / 20))
    return M.render(rows, "k", ["p_brand", "p_partkey"], COLUMNS)


def part_cells(t: Tables) -> DataFrame:
    return M.exploded(M.parse(part_tables(t), "k", "markdown"), "k")


ROWS = "rows AS (SELECT p_partkey // 20 AS k, row_number() OVER (PARTITION BY p_partkey // 20 ORDER BY p_brand, p_partkey) - 1 AS r, * FROM part)"
CELLS = ROWS + ", cells AS (" + " UNION ALL ".join(f"SELECT k, r, {j} AS c, '{name}' AS name, trim(CAST({name} AS VARCHAR)) AS value FROM rows" for j, name in enumerate(COLUMNS)) + ")"
PROFILE = CELLS + """, marked AS (SELECT *, CASE WHEN lag(value) OVER (PARTITION BY k, c ORDER BY r) IS DISTINCT FROM value THEN 1 ELSE 0 END AS change FROM cells),
prof AS (SELECT k, c, name, count(*) AS n_rows, count(*) FILTER (WHERE value <> '') AS n_filled, count(DISTINCT value) FILTER (WHERE value <> '') AS n_distinct, CAST(sum(change) AS BIGINT) AS n_runs,
count(*) FILTER (WHERE TRY_CAST(replace(value, ',', '') AS DOUBLE) IS NOT NULL) AS n_numbers, min(TRY_CAST(replace(value, ',', '') AS DOUBLE)) AS low, max(TRY_CAST(replace(value, ',', '') AS DOUBLE)) AS high FROM marked GROUP BY 1, 2, 3)"""


@query(f"WITH {ROWS} SELECT k, '| p_brand | p_type | p_size | p_name |' || chr(10) || '| --- | --- | --- | --- |' || chr(10) || string_agg('| ' || p_brand || ' | ' || p_type || ' | ' || CAST(p_size AS VARCHAR) || ' | ' || p_name || ' |', chr(10) ORDER BY p_brand, p_partkey) AS markdown FROM rows GROUP BY k")
def table_render(t: Tables):
    return part_tables(t)


@query(f"WITH {CELLS} SELECT k, CAST(r AS INTEGER) AS row_idx, c AS col_idx, name, value FROM cells")
def cell_split(t: Tables):
    return part_cells(t)


@query("""SELECT p_partkey, p_brand || '|' || p_type AS first_cell, CAST(2 AS BIGINT) AS n_cells FROM part""")
def escaped_cells(t: Tables):
    cells = M.cells_of(M.row_line(F.concat("p_brand", F.lit("|"), "p_type"), F.col("p_name")))
    return t.part.select("p_partkey", F.get(cells, F.lit(0)).alias("first_cell"), F.size(cells).cast("long").alias("n_cells"))


@query(f"WITH {PROFILE} SELECT k, c AS col_idx, name, n_rows, n_filled, n_distinct, n_runs, n_numbers, low, high FROM prof")
def column_profile(t: Tables):
    return M.profile(part_cells(t), "k")


@query(f"""WITH {PROFILE}, s AS (SELECT k, c, round(CAST(n_distinct AS DOUBLE) / n_runs * (1 - CAST(n_distinct AS DOUBLE) / n_rows), 9) AS score FROM prof WHERE n_rows >= 4 AND n_filled * 2 >= n_rows AND n_distinct >= 2 AND n_distinct * 2 <= n_rows AND CAST(n_distinct AS DOUBLE) / n_runs >= 0.8)
SELECT k, CAST(coalesce((SELECT c FROM s WHERE s.k = p.k ORDER BY score DESC, c LIMIT 1), -1) AS INTEGER) AS group_col FROM (SELECT DISTINCT k FROM prof) p""")
def group_column(t: Tables):
    return M.group_columns(M.profile(part_cells(t), "k"), "k")


@query(f"""WITH {PROFILE}, firsts AS (SELECT k, c, value, min(r) AS f FROM cells WHERE value <> '' GROUP BY 1, 2, 3), listed AS (SELECT k, c, string_agg(value, '、' ORDER BY f, value) AS vals FROM firsts GROUP BY 1, 2)
SELECT k, c AS col_idx, name, CASE WHEN n_distinct <= least(40, n_rows // 2) THEN vals WHEN n_numbers >= 0.8 * n_filled THEN CAST(CAST(low AS BIGINT) AS VARCHAR) || ' ~ ' || CAST(CAST(high AS BIGINT) AS VARCHAR) END AS summary FROM prof JOIN listed USING (k, c) WHERE n_rows >= 4""")
def table_overview(t: Tables):
    cells = part_cells(t)
    return M.overview(cells, M.profile(cells, "k"), "k")


@query("""SELECT n_nationkey, '| ' || n_name || ' | ' || CAST(n_regionkey AS VARCHAR) || ' |' AS line FROM nation""")
def grid_clean(t: Tables):
    cell = F.array("n_name", F.lit(" "), F.col("n_regionkey").cast("string"))
    grid = F.array(F.array(F.lit("Nations")), F.array(F.lit(""), F.lit(" ")), F.array(F.lit("name"), F.lit(""), F.lit("region")), cell)
    last = F.element_at(M.clean_grid(grid), -1)
    return t.nation.select("n_nationkey", M.row_line(F.get(last, F.lit(0)), F.get(last, F.lit(1))).alias("line"))


@query()
def table_row_pack(t: Tables):
    lines = F.array_sort(F.collect_list(F.struct("p_brand", "p_partkey", M.row_line(*[F.col(c) for c in COLUMNS]).alias("line"))))
    rows = t.part.withColumn("k", F.floor((F.col("p_partkey") - 1) / 200)).groupBy("k").agg(lines.alias("rows"))
    packs = M.pack_rows(F.transform("rows", lambda x: x["line"]), F.transform("rows", lambda x: x["p_brand"]), F.lit("| p_brand | p_type | p_size | p_name |"), 300, 400)
    return rows.select("k", F.posexplode(packs).alias("place", "pack"))


def markdown(t: Tables) -> DataFrame:
    """(doc_id, text): each document's lines under headings: a chapter per nine lines, a section per three, so that short documents
    have one chapter with sections and are cut at these."""
    line = F.posexplode(F.split("text", "\n")).alias("n", "line")
    rows = t.documents.select("doc_id", "source", "lang", line)
    head = F.when(F.col("n") % 9 == 0, F.concat(F.lit("# Chapter "), (F.col("n") / 9 + 1).cast("int").cast("string"), F.lit("\n\n"))).when(F.col("n") % 3 == 2, F.lit("## Section\n\n")).otherwise("")
    lines = F.transform(F.array_sort(F.collect_list(F.struct("n", F.concat(head, "line").alias("s")))), lambda x: x["s"])
    return rows.groupBy("doc_id").agg(F.array_join(lines, "\n\n").alias("text"))


MD = """src AS (SELECT doc_id, CAST(generate_subscripts(string_split(text, chr(10)), 1) - 1 AS INTEGER) AS n, unnest(string_split(text, chr(10))) AS line FROM documents),
md AS (SELECT doc_id, string_agg(CASE WHEN n % 9 = 0 THEN '# Chapter ' || CAST(n // 9 + 1 AS VARCHAR) || chr(10) || chr(10) WHEN n % 3 = 2 THEN '## Section' || chr(10) || chr(10) ELSE '' END || line, chr(10) || chr(10) ORDER BY n) AS text FROM src GROUP BY 1),
lines AS (SELECT doc_id AS id, CAST(generate_subscripts(string_split(text, chr(10)), 1) - 1 AS INTEGER) AS line_no, unnest(string_split(text, chr(10))) AS line FROM md),
heads AS (SELECT id, line_no, CAST(length(regexp_extract(line, '^(#{1,6})\\s+(.*\\S)\\s*$', 1)) AS INTEGER) AS level, regexp_extract(line, '^(#{1,6})\\s+(.*\\S)\\s*$', 2) AS title FROM lines WHERE regexp_matches(line, '^(#{1,6})\\s+(.*\\S)\\s*$')),
lev AS (SELECT id, level, count(*) AS n FROM heads GROUP BY 1, 2), split AS (SELECT id, coalesce(min(level) FILTER (WHERE n >= 2), min(level)) AS split_level FROM lev GROUP BY 1),
cuts AS (SELECT h.* FROM heads h JOIN split USING (id) WHERE level = split_level),
paged AS (SELECT l.id, l.line_no, l.line, c.title, greatest(sum(CASE WHEN c.title IS NOT NULL THEN 1 ELSE 0 END) OVER (PARTITION BY l.id ORDER BY l.line_no), 1) AS page FROM lines l LEFT JOIN cuts c ON c.id = l.id AND c.line_no = l.line_no),
pages AS (SELECT id, CAST(page AS BIGINT) AS page_index, coalesce(first(title ORDER BY line_no) FILTER (WHERE title IS NOT NULL), '全文') AS title, regexp_replace(string_agg(line, chr(10) ORDER BY line_no), '^\\s+|\\s+$', '', 'g') AS content FROM paged GROUP BY 1, 2)"""


def pages(t: Tables) -> DataFrame:
    docs = markdown(t)
    return P.cut_pages(B.lines_of(docs, "doc_id", "text"), B.headings(docs))


@query(f"WITH {MD} SELECT id, line_no, level, title FROM heads")
def heading_scan(t: Tables):
    return B.headings(markdown(t))


@query(f"WITH {MD} SELECT h.id, h.line_no, CASE WHEN level = 1 THEN title ELSE (SELECT max_by(g.title, g.line_no) FROM heads g WHERE g.id = h.id AND g.level = 1 AND g.line_no < h.line_no) || ' > ' || title END AS path FROM heads h")
def heading_path(t: Tables):
    found = B.heading_paths(B.headings(markdown(t)))
    return found.select("id", "line_no", F.array_join("path", " > ").alias("path"))


@query(f"WITH {MD} SELECT level, count(*) AS n FROM heads GROUP BY 1")
def heading_histogram(t: Tables):
    return B.headings(markdown(t)).groupBy("level").agg(F.count("*").alias("n"))


@query(f"WITH {MD} SELECT id, split_level FROM split")
def split_level(t: Tables):
    return P.split_levels(B.headings(markdown(t)))


@query(f"WITH {MD} SELECT id, page_index, title, content FROM pages WHERE content <> ''")
def page_cut(t: Tables):
    return pages(t)


@query(f"WITH {MD} SELECT id, string_agg(CAST(page_index AS VARCHAR) || '. ' || title, chr(10) ORDER BY page_index) AS outline FROM pages WHERE content <> '' GROUP BY 1")
def outline(t: Tables):
    return P.outline(pages(t))


@query(f"WITH {MD} SELECT id, count(*) AS n_pages, max(page_index) AS last_page FROM pages WHERE content <> '' GROUP BY 1")
def page_doc_counts(t: Tables):
    return pages(t).groupBy("id").agg(F.count("*").alias("n_pages"), F.max("page_index").alias("last_page"))


@query()
def block_split(t: Tables):
    chunks = B.chunk_markdown(markdown(t), target=1, most=1 << 30)
    return chunks.select("id", "chunk_index", "chunk_type", "token_estimate")


@query()
def chunk_markdown(t: Tables):
    chunks = B.chunk_markdown(markdown(t), title=F.col("doc_id").cast("string"))
    return chunks.select("chunk_id", "prev_chunk_id", "next_chunk_id", "chunk_type", F.array_join("heading_path", " > ").alias("path"), "content", "token_estimate")


@query()
def chunk_table_rows(t: Tables):
    chunks = B.chunk_markdown(part_tables(t), id_col="k", text_col="markdown", title=F.lit("parts"), row_mode=True, target=200, most=300)
    return chunks.select("chunk_id", "content", "is_table_row", "token_estimate")


@query()
def paginate(t: Tables):
    return P.paginate(markdown(t)).select("id", "page_index", "title", "content", "continued")


@query()
def page_merge(t: Tables):
    return P.paginate(markdown(t), most=400, least=100).select("id", "page_index", "title", "content", "continued")


@query("""WITH p AS (SELECT n_nationkey, n_regionkey, n_name FROM nation), c AS (SELECT n_regionkey AS id, 'c' || CAST(n_nationkey AS VARCHAR) AS chunk_id, n_nationkey FROM nation)
SELECT chunk_id, CASE WHEN n_nationkey % 3 = 2 THEN (SELECT min(n_nationkey) FROM nation m WHERE m.n_regionkey = c.id) WHEN n_nationkey % 3 = 1 THEN (SELECT min(n_nationkey) FROM nation m WHERE m.n_regionkey = c.id AND m.n_nationkey % 2 = 0) ELSE CASE WHEN n_nationkey % 2 = 0 THEN (SELECT min(n_nationkey) FROM nation m WHERE m.n_regionkey = c.id AND m.n_nationkey % 2 = 0) ELSE n_nationkey END END AS page_index FROM c
WHERE (SELECT min(n_nationkey) FROM nation m WHERE m.n_regionkey = c.id AND m.n_nationkey % 2 = 0) IS NOT NULL""")
def chunk_to_page(t: Tables):
    # pages of even nations have the path [top], of odd ones [top, name]; chunks have [top, name, x], [top, other] or none
    path = F.when(F.col("n_nationkey") % 2 == 0, F.array(F.lit("top"))).otherwise(F.array(F.lit("top"), "n_name"))
    made = t.nation.select(F.col("n_regionkey").alias("id"), F.col("n_nationkey").alias("page_index"), path.alias("heading_path"))
    none = F.array().cast("array<string>")
    own = F.when(F.col("n_nationkey") % 3 == 2, none).when(F.col("n_nationkey") % 3 == 1, F.array(F.lit("top"), F.lit("other"))).otherwise(F.array(F.lit("top"), "n_name", F.lit("x")))
    chunks = t.nation.select(F.col("n_regionkey").alias("id"), F.concat(F.lit("c"), F.col("n_nationkey").cast("string")).alias("chunk_id"), own.alias("heading_path"))
    with_even = t.nation.where("n_nationkey % 2 = 0").select(F.col("n_regionkey").alias("id"))
    return P.chunk_pages(chunks.join(with_even, "id", "left_semi"), made)


@query("""SELECT doc_id, string_agg(CASE WHEN n = 1 THEN '### Part' || chr(10) || chr(10) || line WHEN n = 2 THEN '## Other' || chr(10) || chr(10) || line ELSE line END, chr(10) || chr(10) ORDER BY n) AS markdown
FROM (SELECT doc_id, row_number() OVER (PARTITION BY doc_id ORDER BY i) - 1 AS n, line FROM (SELECT doc_id, generate_subscripts(string_split(text, chr(10)), 1) AS i, trim(unnest(string_split(text, chr(10)))) AS line FROM documents) WHERE line <> '') GROUP BY doc_id""")
def heading_inserts(t: Tables):
    docs = t.documents.select("doc_id", F.replace("text", F.lit("\n"), F.lit("\n\n")).alias("text"))
    given = F.from_json(F.lit('[{"before":1,"level":3,"title":" Part "},{"before":2,"level":9,"title":"Other"},{"before":1,"level":2,"title":"late"},{"before":0,"level":2,"title":" "}]'), "array<struct<before:int,level:int,title:string>>")
    inserts = t.documents.select(F.col("doc_id").alias("id"), F.posexplode(given).alias("place", "x")).select("id", "place", "x.*")
    return B.apply_inserts(docs, inserts).withColumnRenamed("id", "doc_id")


@query("""SELECT conv_id, turn, turn % 2 <> 0 OR count(*) FILTER (WHERE turn % 2 = 0) OVER (PARTITION BY conv_id) <= 3 AS uses_model FROM conversations""")
def row_guard(t: Tables):
    rows = t.conversations.select("turn", F.col("conv_id").alias("id"), (F.col("turn") % 2 == 0).alias("is_table_row"))
    return rows.select(F.col("id").alias("conv_id"), "turn", K.row_guard(rows, 3).alias("uses_model"))


@query("""SELECT doc_id, CASE WHEN length(text) / 4.0 > 500 THEN '【' || source || ' 第1页 · ' || lang || '】' || chr(10) || left(text, greatest(1, CAST(floor(length(text) * CAST(500 AS DOUBLE) / ceil(length(text) / 4.0)) AS INTEGER))) || '…' ELSE '【' || source || ' 第1页 · ' || lang || '】' || chr(10) || text END AS page FROM documents""")
def page_render(t: Tables):
    return t.documents.select("doc_id", O.page_text(F.col("source"), F.lit(1), F.col("lang"), F.col("text"), 500).alias("page"))
