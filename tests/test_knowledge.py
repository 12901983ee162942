"""From documents to retrieved chunks: what the knowledge base finds is what a search over its chunks' texts finds."""

import random
import zlib

import numpy as np
from pyspark.sql import functions as F

from lectern.functions import vectors as V
from lectern.operators import knowledge as K
from lectern.operators import search as S


def text_of(rng):
    words = ["storm", "river", "stone", "bridge", "winter", "market", "harbor", "signal", "copper", "orchard", "7", "x-90b"]
    parts = [f"# Head {rng.randrange(5)}\n\n" + " ".join(rng.choice(words) for _ in range(rng.choice([5, 80, 400]))) + "!" for _ in range(rng.randrange(1, 4))]
    return "\n\n".join(parts)


def docs_of(spark, seed, ids):
    rng = random.Random(seed)
    return spark.createDataFrame([(i, text_of(rng)) for i in ids], "doc_id long, text string")


def ranked(df):
    return sorted(map(tuple, df.select("query_id", "rank", "id", "via").collect()))


def test_from_documents_to_retrieved_chunks(spark, tmp_path):
    base = K.KnowledgeBase(spark, str(tmp_path / "base"))
    first = docs_of(spark, 1, range(40))
    base.ingest(first, target=60, most=80)
    queries = spark.createDataFrame([(1, "storm bridge"), (2, "x-90b copper"), (3, "nowhere"), (4, "harbor harbor winter signal")], "query_id int, query string")
    chunks = base.chunks()
    assert chunks.count() > 80 and chunks.select("chunk_id").distinct().count() == chunks.count()
    assert all(r.content == f"{r.context_prefix}\n{r.content_original}" and r.context_prefix.startswith("《") for r in chunks.collect())

    def plain(scope=None):
        rows = base.chunks()
        vectors = rows.select(F.col("chunk_id").alias("vec_id"), F.col("vector").alias("embedding"))
        asked = queries.select("query_id", "query", K.embedded(F.col("query")).alias("vector"))
        chain = rows.select(F.col("chunk_id").alias("id"), F.col("doc_id").alias("doc"), "position")
        texts = rows.select(F.col("chunk_id").alias("doc_id"), F.col("content").alias("text"))
        return ranked(S.retrieve(texts, vectors, asked, chain=chain, scope=scope))

    assert ranked(base.retrieve(queries)) == plain()
    within = first.where("doc_id < 7").select("doc_id")
    found = base.retrieve(queries, scope=within)
    assert ranked(found) == plain(chunks.where("doc_id < 7").select("chunk_id"))
    assert {int(r.id.split("_")[0]) for r in found.where("via IS NULL OR via != 'neighbor'").collect()} <= set(range(7))
    # documents that come again replace what they had; new ones are found beside the old
    base.ingest(docs_of(spark, 2, range(30, 60)), target=120, most=150)
    assert {r.doc_id for r in base.chunks().select("doc_id").distinct().collect()} == set(range(60))
    assert base.index().n_docs == base.chunks().count()
    assert ranked(base.retrieve(queries)) == plain()


def test_rows_of_large_tables_get_no_written_prefix(spark, tmp_path):
    table = "| a | b |\n| --- | --- |\n" + "\n".join(f"| g{i} | {i} |" for i in range(60))
    docs = spark.createDataFrame([(1, "# T\n\nprose here\n\n" + table), (2, "# T\n\n" + table[:200])], "doc_id long, text string")

    def written(rows):
        return rows.withColumn("prefix", F.concat(F.lit("written "), "chunk_id"))

    rows = K.prepared(docs, written=written, row_mode=True, target=5, most=8).collect()
    assert sum(r.is_table_row for r in rows if r.doc_id == 1) < K.MOST_ROWS and all(r.context_prefix.startswith("written") for r in rows)
    guarded = spark.createDataFrame([(1, True)] * 401 + [(1, False), (2, True)], "id int, is_table_row boolean")
    got = {(r.id, r.is_table_row): r.ok for r in guarded.withColumn("ok", K.row_guard(guarded)).collect()}
    assert got == {(1, True): False, (1, False): True, (2, True): True}


def test_hashed_vectors(spark):
    rows = spark.createDataFrame([(["a", "b", "a"],), ([],), (None,), (["b"],)], "t array<string>")
    got = [r.v for r in rows.select(V.hashed(F.col("t"), 8).alias("v")).collect()]
    each = {r.w: r.v for r in spark.createDataFrame([("a",), ("b",)], "w string").select("w", V.hashed(F.array("w"), 8).alias("v")).collect()}
    assert np.array_equal(got[0], 2 * np.array(each["a"]) + np.array(each["b"])) and got[1] == [0.0] * 8 and got[2] is None and got[3] == each["b"]
    assert all(sorted(map(abs, v)) == [0.0] * 7 + [1.0] for v in each.values())
    assert zlib.crc32(repr(each).encode()) == zlib.crc32(repr(each).encode())


def test_blocks_of_vectors_equal_pairs(spark):
    rng = np.random.default_rng(3)
    vectors = [(i, (None if i == 5 else [float(x) for x in rng.integers(-3, 4, 6)])) for i in range(300)] + [(1000 + i, [1.0, 0.0, 0.0, 0.0, 0.0, 0.0]) for i in range(50)]
    rows = spark.createDataFrame(vectors, "vec_id long, embedding array<float>").repartition(5)
    asked = spark.createDataFrame([(q, v) for q, (_, v) in enumerate(vectors[:40])], "query_id int, vector array<float>")
    got = {}
    for r in S.vector_search(rows, asked, 7).collect():
        got.setdefault(r.query_id, []).append((r["rank"], r.id, r.score))

    def unit(v):
        n = float(np.sqrt(sum(float(x) ** 2 for x in v)))
        return np.array(v, float) / n if n else np.zeros(len(v))

    for q, (_, v) in enumerate(vectors[:40]):
        if v is None:
            assert q not in got
            continue
        want = sorted((-round(float(unit(v) @ unit(w)), 6) + 0.0, i) for i, w in vectors if w is not None)[:7]
        assert [(r, i) for r, i, _ in sorted(got[q])] == [(r, i) for r, (_, i) in enumerate(want, 1)]


def test_a_term_in_all_documents_is_no_hot_group(spark):
    """Without broadcasts, no partition holds a multiple of the others' rows."""
    docs = spark.createDataFrame([(i, f"the w{i % 50}") for i in range(4000)], "doc_id long, text string")
    posts = S.postings(S.tokenised(docs))
    terms = spark.createDataFrame([(q, "the", 4000) for q in range(3)], "query_id int, term string, df long")
    stats = spark.createDataFrame([(4000, 2.0)], "n_docs long, avg_length double")
    held = {k: spark.conf.get(k) for k in ("spark.sql.autoBroadcastJoinThreshold", "spark.sql.adaptive.enabled", "spark.sql.shuffle.partitions")}
    try:
        spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
        spark.conf.set("spark.sql.adaptive.enabled", "false")
        spark.conf.set("spark.sql.shuffle.partitions", "8")
        sizes = sorted(r["count"] for r in S.weighted(posts, terms, stats).groupBy(F.spark_partition_id()).count().collect())
    finally:
        for k, v in held.items():
            spark.conf.set(k, v)
    assert sum(sizes) == 12_000 and len(sizes) >= 6 and sizes[-1] <= 3 * sizes[len(sizes) // 2]
