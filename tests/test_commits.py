"""What must hold where something fails between two steps: streams, replaced documents, pushes; and archives with bad members."""

import io
import os
import tarfile
import zipfile

import pytest
from pyspark.sql import functions as F

from lectern.operators import blocks as B
from lectern.operators import reading
from lectern.sources import archives, files, sinks
from lectern.sources.pagestore import DocumentRows
from lectern.sources.versions import Conflict
from lectern.streaming import ingest as stream

DOCS = "doc_id long, text string"


def test_epoch_that_runs_again_keeps_its_output(spark, tmp_path):
    source, chunks, checkpoint = (str(tmp_path / x) for x in ("in", "out", "check"))
    spark.createDataFrame([(1, "one text"), (2, "# a\n\nanother")], DOCS).coalesce(1).write.parquet(source)
    stream.ingest(spark, source, chunks, checkpoint).awaitTermination()
    before = {r.chunk_id for r in spark.read.parquet(chunks).collect()}
    assert len(before) == 2
    # the driver was lost after the files were written and before the epoch was committed
    for name in os.listdir(f"{checkpoint}/commits"):
        os.remove(f"{checkpoint}/commits/{name}")
    stream.ingest(spark, source, chunks, checkpoint).awaitTermination()
    assert {r.chunk_id for r in spark.read.parquet(chunks).collect()} == before
    # what comes once more in another file isn't written twice
    spark.createDataFrame([(2, "# a\n\nanother"), (3, "new")], DOCS).coalesce(1).write.mode("append").parquet(source)
    stream.ingest(spark, source, chunks, checkpoint).awaitTermination()
    rows = spark.read.parquet(chunks).collect()
    assert len(rows) == len({r.chunk_id for r in rows}) == 3


def test_late_submissions_merge(spark, tmp_path):
    source, out = str(tmp_path / "in"), str(tmp_path / "out")
    at = "2024-01-01 10:{}:00"
    rows = [(at.format("05"), 1, "a", 1.0), (at.format("50"), 1, "a", 3.0), (at.format("20"), 1, "a", 2.0), (at.format("20"), 2, "a", 5.0), ("2024-01-01 14:00:00", 9, "z", 0.0)]
    events = spark.createDataFrame(rows, "ts string, user_id long, event_type string, value double").select(F.to_timestamp("ts").alias("ts"), "user_id", "event_type", "value")
    events.coalesce(1).write.parquet(source)
    query = stream.merged_submissions(spark.readStream.schema(events.schema).parquet(source)).writeStream.format("parquet").option("checkpointLocation", str(tmp_path / "c"))
    query.trigger(availableNow=True).start(out).awaitTermination()
    assert {(r.user_id, r.n, r.value) for r in spark.read.parquet(out).collect()} == {(1, 3, 3.0), (2, 1, 5.0)}


def pages(spark, *rows):
    return spark.createDataFrame(rows, "doc_id string, page_index int, title string")


def listed(df):
    return sorted(map(tuple, df.collect()))


def test_document_replaced_whole_or_not_at_all(spark, tmp_path, monkeypatch):
    store = DocumentRows(spark, str(tmp_path / "pages"))
    assert store.read() is None
    store.replace_all(pages(spark, ("a", 1, "x"), ("a", 2, "y"), ("b", 1, "z")))
    assert store.replace(pages(spark, ("a", 1, "new"))) == 2
    now = [("a", 1, "new"), ("b", 1, "z")]
    assert listed(store.read()) == now and len(listed(store.read(1))) == 3
    # a failure between writing and commit leaves all as it was
    monkeypatch.setattr(store.versions, "commit", lambda *_: (_ for _ in ()).throw(OSError("lost")))
    with pytest.raises(OSError):
        store.replace(pages(spark, ("b", 1, "never")))
    monkeypatch.undo()
    assert listed(store.read()) == now
    for wrong in (pages(spark, ("a", 1, "x"), ("b", 1, "x")), pages(spark, ("a", 1, "x")).limit(0), pages(spark, (None, 1, "x"))):
        with pytest.raises(ValueError):
            store.replace(wrong)
    store.replace(pages(spark, ("c", 1, "gone soon")))
    store.replace(pages(spark, ("c", 1, "x")).limit(0), doc_id="c")
    assert listed(store.read()) == now
    store.compact()
    assert listed(store.read()) == now and store.versions.vacuum() >= 4 and listed(store.read()) == now


def test_two_writers_conflict(spark, tmp_path, monkeypatch):
    one, two = (DocumentRows(spark, str(tmp_path / "pages")) for _ in range(2))
    one.replace(pages(spark, ("a", 1, "x")))
    stale = two.versions.latest()
    one.replace(pages(spark, ("a", 1, "y")))
    monkeypatch.setattr(two.versions, "latest", lambda: stale)
    with pytest.raises(Conflict):
        two.replace(pages(spark, ("b", 1, "z")))
    assert listed(one.read()) == [("a", 1, "y")]


class Store:
    """An outer store in a folder, so that all tasks and the test see the same; it fails as the content says."""

    def __init__(self, folder):
        self.folder, self.login = folder, True

    def seen(self, name):
        path = f"{self.folder}/{name}"
        n = int(open(path).read()) if os.path.exists(path) else 0
        with open(path, "w") as f:
            f.write(str(n + 1))
        return n + 1

    def create(self, doc_id):
        if doc_id == 9:
            raise sinks.Refused(400, "bad name")
        if doc_id == 8:
            return None
        os.makedirs(f"{self.folder}/doc-{doc_id}", exist_ok=True)
        return f"doc-{doc_id}"

    def add(self, remote_id, content):
        n = self.seen(f"tries-{remote_id}-{abs(hash(content)) % 10**9}")
        if content == "late" and n < 3:
            raise sinks.Refused(503)
        if content == "slow" and n < 2:
            raise sinks.Refused(429)
        if content == "login" and self.login:
            self.login = False
            raise sinks.Refused(401)
        if content.startswith("bad") and not os.path.exists(f"{self.folder}/mended"):
            raise sinks.Refused(422, content)
        if content == "never":
            raise sinks.Refused(500)
        if content == "no id":
            return None
        with open(f"{self.folder}/{remote_id}/{content}", "w"):
            return content

    def delete(self, remote_id):
        if remote_id == "doc-5":
            raise sinks.Refused(403)
        os.rename(f"{self.folder}/{remote_id}", f"{self.folder}/deleted-{remote_id}-{self.seen('deletes')}")

    def refresh(self):
        self.seen("refreshes")


def test_push_rolls_back_what_is_not_whole(spark, tmp_path):
    folder, ledger = str(tmp_path / "store"), str(tmp_path / "ledger")
    os.makedirs(folder)
    rows = [(1, 0, "a"), (1, 1, "late"), (1, 2, "slow"), (2, 0, "b"), (2, 1, "bad x"), (3, 0, "never"), (4, 0, "login"), (5, 0, "bad y"), (6, 0, "no id"), (8, 0, "c"), (9, 0, "d"), (9, 1, "e")]
    frame = spark.createDataFrame(rows, "doc_id long, place long, content string").repartition(3)
    out = sinks.push_documents(frame, lambda: Store(folder), ledger, wait=0.0)
    got = {(r.doc_id, r.place): (r.error, r.rolled_back) for r in out.collect()}
    assert [got[1, k] for k in range(3)] == [(None, None)] * 3 and got[4, 0] == (None, None)
    assert got[2, 0] == (None, True) and got[2, 1] == ("HTTP 422 bad x", True) and got[3, 0] == ("HTTP 500", True)
    assert got[5, 0] == ("HTTP 422 bad y", False) and got[6, 0] == ("no id in the answer", True)
    assert got[8, 0] == ("no id in the answer", None) and got[9, 0] == got[9, 1] == ("HTTP 400 bad name", None)
    assert sorted(n for n in os.listdir(folder) if n.startswith("doc-")) == ["doc-1", "doc-4", "doc-5"]
    tries = {n: int(open(f"{folder}/{n}").read()) for n in os.listdir(folder) if n.startswith("tries-doc-3") or n.startswith("tries-doc-2")}
    assert sorted(tries.values()) == [1, 1, 4]  # a refusal isn't tried again, a failing store three times more
    summary = {r.doc_id: tuple(r)[1:4] for r in reading.push_outcomes(out.select("doc_id", "place", "error")).collect()}
    assert summary[1] == (3, 3, 0) and summary[2] == (2, 1, 1) and summary[9] == (2, 0, 2)
    # run again with the same ledger: what is done isn't sent again
    open(f"{folder}/mended", "w").close()
    again = sinks.push_documents(frame, lambda: Store(folder), ledger, wait=0.0)
    whole = again.groupBy("doc_id", "remote_id").agg(F.count("*").alias("n"))
    assert {r.doc_id for r in again.where("error IS NULL AND rolled_back IS NULL").collect()} >= {1, 2, 4, 5}
    assert [r.n for r in whole.where("doc_id = 1").collect()] == [3]


def archive_folder(path):
    os.makedirs(path)
    table = "name,n\n" + "\n".join(f"row {i},{i}" for i in range(30))
    with zipfile.ZipFile(path / "a.zip", "w") as z:
        for i in range(150):
            z.writestr(f"texts/t{i:03d}.md", f"# Title {i}\n\nSome text of member {i}.")
        z.writestr("t.csv", table)
        z.writestr("short.csv", "a\n1")
        z.writestr("bad.docx", b"no document")
        z.writestr("empty.txt", "")
        z.writestr("__MACOSX/x.md", "junk")
        z.writestr("inner.zip", b"PK")
        z.writestr("tool.exe", "x")
    with tarfile.open(path / "b.tar.gz", "w:gz") as t:
        for name, data in (("d/n.txt", "plain text in here"), ("u.tsv", table.replace(",", "\t")), ("s.pptx", "broken")):
            info = tarfile.TarInfo(name)
            info.size = len(data.encode())
            t.addfile(info, io.BytesIO(data.encode()))
        link = tarfile.TarInfo("l.md")
        link.type, link.linkname = tarfile.SYMTYPE, "d/n.txt"
        t.addfile(link)
    (path / "c.zip").write_bytes(b"no archive")
    (path / "d.tar").write_bytes(b"no archive either")


def backup(content, name):
    if name == "s.pptx":
        raise ValueError("no luck")
    return f"by other means: {name}"


@pytest.mark.parametrize("other", [None, backup])
def test_archives_stream_into_parsers_and_chunks(spark, tmp_path, other):
    archive_folder(tmp_path / "in")
    spark.dataSource.register(archives.source(fallback=other))
    frame = spark.read.format("archived_documents").load(str(tmp_path / "in"))
    assert frame.rdd.getNumPartitions() >= 6  # a.zip in three parts and one for what is left out
    rows = {(r.archive.rpartition("/")[2], r.name): r for r in frame.collect()}
    assert sum(r.markdown is not None for k, r in rows.items() if k[1] and k[1].startswith("texts/")) == 150
    assert rows["a.zip", "t.csv"].markdown.startswith("| name | n |") and rows["b.tar.gz", "u.tsv"].markdown == rows["a.zip", "t.csv"].markdown
    assert rows["b.tar.gz", "d/n.txt"].markdown == "plain text in here"
    short, bad, broken = rows["a.zip", "short.csv"], rows["a.zip", "bad.docx"], rows["b.tar.gz", "s.pptx"]
    if other is None:
        assert short.markdown is None and short.error.startswith("too little") and bad.error.startswith("BadZipFile") and broken.error.startswith("BadZipFile")
    else:
        assert short.markdown == "by other means: short.csv" and bad.markdown == "by other means: bad.docx" and bad.error is None
        assert broken.markdown is None and broken.error.startswith("BadZipFile") and broken.error.endswith("fallback: ValueError: no luck")
    left = {k[1]: r.skipped for k, r in rows.items() if r.skipped}
    assert left == {"empty.txt": "empty", "__MACOSX/x.md": "junk", "inner.zip": "archive", "tool.exe": "unsupported", "l.md": "link"}
    assert all(rows[a, None].error.startswith("unreadable") for a in ("c.zip", "d.tar"))
    # from archives to chunks in one plan
    docs = frame.where("markdown IS NOT NULL").select(F.xxhash64("archive", "name").alias("doc_id"), F.col("markdown").alias("text"))
    chunks = B.chunk_markdown(docs)
    assert chunks.where("content LIKE '%Some text of member%'").count() == 150


def test_archive_limits(monkeypatch):
    monkeypatch.setattr(archives, "MOST_FILES", 2)
    monkeypatch.setattr(archives, "MOST_BYTES", 100)
    taken, skipped = archives.chosen([("a.md", 60, False), ("b.md", 50, False), ("c.md", 40, False), ("d.md", 1, False), ("e.md", 1, True)])
    assert taken == ["a.md", "c.md"] and [(n, w) for n, _, w in skipped] == [("b.md", "too large"), ("d.md", "too many"), ("e.md", "link")]
    assert files.left_out("x/._a.md", 5, False) == "junk"
