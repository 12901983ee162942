"""Search over small cases: zero vectors, guards, chains."""

from lectern.functions import vectors as V
from lectern.operators import search as S


def test_zero_vectors(spark):
    rows = spark.createDataFrame([(1, [1.0, 0.0]), (2, [0.0, 0.0]), (3, None), (4, [3.0, 4.0])], "vec_id long, embedding array<float>")
    asked = spark.createDataFrame([(1, [2.0, 0.0]), (2, [0.0, 0.0]), (3, None)], "query_id int, vector array<float>")
    got = {(r.query_id, r.id): (r.score, r["rank"]) for r in S.vector_search(rows, asked, 5).collect()}
    assert got == {(1, 1): (1.0, 1), (1, 4): (0.6, 2), (1, 2): (0.0, 3), (2, 1): (0.0, 1), (2, 2): (0.0, 2), (2, 4): (0.0, 3)}
    assert [r[0] for r in rows.where("vec_id < 3").select(V.cosine(rows.embedding, rows.embedding)).collect()] == [1.0, 0.0]


def test_guard_and_neighbours(spark):
    def hits(*ids):
        return spark.createDataFrame([(1, i, n) for n, i in enumerate(ids, 1)], "query_id int, id string, rank int")

    def ids(frame):
        return [r.id for r in frame.orderBy("rank").collect()]

    assert ids(S.lexical_guard(hits(*"abc"), hits(*"za"), 3, 2)) == list("abz")
    assert ids(S.lexical_guard(hits(*"abcdef"), hits(*"uvwxy"), 6, 5)) == list("abcduv")
    assert ids(S.lexical_guard(hits(*"abc"), hits(*"ba"), 3, 0)) == list("abc")
    chain = spark.createDataFrame([(f"c{i}", 1, i) for i in range(1, 5)], "id string, doc int, position int")
    assert ids(S.expand_neighbours(hits("c2", "x"), chain, 1)) == ["c2", "x", "c1", "c3"]
    assert ids(S.expand_neighbours(hits("c2"), chain, 2)) == ["c2", "c1", "c3", "c4"]
    assert ids(S.expand_neighbours(hits("c2"), chain, 0)) == ["c2"]
    assert ids(S.expand_neighbours(hits("c2", "c3"), chain, 1)) == ["c2", "c3", "c1", "c4"]


def test_guard_makes_each_search_once(spark):
    core, keyword = (spark.range(a, a + 6).selectExpr("id % 2 AS query_id", "id", "CAST(id AS INT) AS rank") for a in (1, 4))
    plan = S.lexical_guard(core, keyword, 6, 3)._jdf.queryExecution().optimizedPlan().toString()
    assert plan.count("Range (") == 2
