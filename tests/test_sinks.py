from lectern.operators import reading
from lectern.sources import sinks

ROWS = "doc_id long, place long, content string"


def test_append_and_truncate(spark, tmp_path):
    path = str(tmp_path / "t")
    for k in range(2):
        sinks.append(spark.createDataFrame([(k, 0, "a"), (k, 1, None)], ROWS), path)
    assert spark.read.parquet(path).count() == 4
    sinks.truncate(spark, path)
    assert spark.read.parquet(path).count() == 0 and spark.read.parquet(path).columns == ["doc_id", "place", "content"]


def client():
    tried = {}

    def send(row):
        key = (row["doc_id"], row["place"])
        tried[key] = tried.get(key, 0) + 1
        if row["content"] is None or row["content"].startswith("bad"):
            raise ValueError(f"refused {row['content']}")
        if row["content"] == "late" and tried[key] < 3:
            raise TimeoutError

    return send


def test_push(spark):
    rows = [(1, 0, "a"), (1, 1, "late"), (2, 0, "bad x"), (2, 1, "bad y"), (2, 2, "bad x"), (2, 3, "ok"), (None, 0, None), (3, 0, "")]
    sent = sinks.push(spark.createDataFrame(rows, ROWS), client, wait=0.0)
    got = {r.doc_id: tuple(r)[1:] for r in reading.push_outcomes(sent).collect()}
    assert got == {1: (2, 2, 0, 0, ""), 2: (4, 1, 3, 2, "refused bad x | refused bad y"), None: (1, 0, 1, 1, "refused None"), 3: (1, 1, 0, 0, "")}
    hasty = sinks.push(spark.createDataFrame(rows[:2], ROWS), client, tries=2, wait=0.0)
    assert [r.error for r in hasty.orderBy("place").collect()] == [None, "TimeoutError"]
    assert reading.push_outcomes(sinks.push(spark.createDataFrame([], ROWS), client)).count() == 0


def test_titles_and_order(spark):
    paths = [(1, 0, '{"heading_path": ["  A \\n b ", "x"]}'), (1, 1, '{"heading_path": ["later"]}'), (2, 3, '{"heading_path": ["工作表 2"]}'), (3, 0, "no JSON"), (4, 0, None), (5, 0, '{"heading_path": ["' + "y" * 99 + '"]}')]
    chunks = spark.createDataFrame(paths, "doc_id long, chunk_index long, metadata string")
    got = {r.doc_id: r.title for r in reading.recovered_titles(reading.heading_listing(chunks)).collect()}
    assert got == {1: "A b", 2: None, 3: None, 4: None, 5: "y" * 80}
    docs = spark.createDataFrame([(1, "b"), (2, "A"), (3, "a"), (4, "阿"), (5, "B")], "doc_id long, title string")
    assert [r.doc_id for r in reading.by_title(docs, "en").collect()][:2] == [3, 2]
    assert {r.doc_id for r in reading.by_title(docs).collect()} == {1, 2, 3, 4, 5}
