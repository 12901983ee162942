import hashlib
import re

import pytest
from pyspark.sql import functions as F

from lectern.llm import sketch

from .conftest import ODD


def shingles(text):
    words = re.findall(r"[^\x20\x09-\x0D]+", text or "")
    return {tuple(words[i : i + 5]) for i in range(max(1, len(words) - 4))} if words else set()


def jaccard(a, b):
    a, b = shingles(a), shingles(b)
    return len(a & b) / len(a | b) if a | b else 1.0


@pytest.mark.parametrize("block", [8, 100_000])
def test_fingerprints(docs, sample, monkeypatch, block):
    monkeypatch.setattr(sketch, "BLOCK", block)
    texts = [t or "" for t in ODD + [r.text for r in sample.collect()]]
    ids = [3 * i + 7 for i in range(len(texts))]
    frame = docs(ODD + texts[len(ODD) :], ids=ids).repartition(5)
    rows = {r.doc_id: r for r in sketch.fingerprints(frame).withColumn("sha", F.sha2("edited", 256)).collect()}
    assert len(rows) == len(texts)
    off = []
    for i, text in enumerate(texts):
        r, following = rows[ids[i]], texts[(i + 1) % len(texts)]
        cut = len(text) // 4
        edited = text[: len(text) - cut] + following[:cut]
        assert r.n_chars == len(text) and r.sha == hashlib.sha256(edited.encode()).hexdigest()
        off += [r.near_edited - jaccard(text, edited), r.near_next - jaccard(text, following)]
        assert len(r.sketch) == min(sketch.K, len(shingles(text)))
    assert max(map(abs, off)) < 0.2 and abs(sum(off) / len(off)) < 0.01


def test_merging_and_estimates(spark, sample):
    big = " ".join(f"w{i}" for i in range(5000))
    frame = spark.createDataFrame([(big, big[: len(big) // 2])], "a string, b string").select(sketch.sketch(F.col("a")).alias("a"), sketch.sketch(F.col("b")).alias("b"))
    r = frame.select(
        sketch.distinct_estimate(F.col("a")).alias("n"), sketch.resemblance(F.col("a"), F.col("b")).alias("j"), sketch.containment(F.col("b"), F.col("a")).alias("c"), (sketch.merged(F.col("a"), F.col("b")) == F.col("a")).alias("same")
    ).first()
    assert 4000 < r.n < 6000 and 0.35 < r.j < 0.65 and r.c > 0.8 and r.same
    parts = sample.select("source", sketch.sketch(F.col("text")).alias("s"))
    one = sketch.merged_over(parts.repartition(4), ["source"], "s").collect()
    for got in one:
        want = sorted({h for r in parts.where(F.col("source") == got.source).collect() for h in r.s})[: sketch.K]
        assert got.s == want


def test_ties_and_empty(docs):
    assert sketch.fingerprints(docs([]).selectExpr("*", "1 AS next", "2 AS block", "3 AS lent")).count() == 0
    rows = sketch.fingerprints(docs(["aaaa", "bbbb", "aaaa"], ids=[5, 5, None])).orderBy("edited").collect()
    assert [r.edited for r in rows] == ["aaaa", "aaab", "bbba"]
    rows = sketch.fingerprints(docs(["only"])).collect()
    assert rows[0].edited == "onlo"
    rows = sketch.fingerprints(docs(["same text", "same text"], ids=[1, 1])).collect()
    assert len(rows) == 2


def test_digests_are_whole(docs):
    """A sketch read back from its digest is the sketch, so digests can be merged later."""
    frame = docs(["a b c d e f g h", "", None, " ".join(f"w{i}" for i in range(900))])
    both = frame.select(sketch.sketch(F.coalesce("text", F.lit(""))).alias("s")).select("s", sketch.undigested(sketch.digest(F.col("s"))).alias("again")).collect()
    assert all(r.s == r.again for r in both) and len(both[3].s) == sketch.K and min(both[3].s) < 0


def test_next_columns(docs):
    """A document within the next one is contained there, and short ones have their shingles counted exactly."""
    head = " ".join(f"w{i}" for i in range(40))
    rows = {r.doc_id: r for r in sketch.fingerprints(docs([head, head + " " + " ".join(f"x{i}" for i in range(40)), ""])).collect()}
    assert rows[0].in_next == 1.0 and rows[0].near_next < 0.6 and rows[0].distinct_shingles == 36 and rows[1].distinct_shingles == 76 and rows[2].distinct_shingles == 0
