import re

import pytest

from lectern.llm import mixing

from .conftest import ODD


def targets(sizes, weights=(3, 1, 2), share=1.5, ceiling=2.0):
    """Targets by literally resharing the excess until none is above."""
    names = sorted((s for s in sizes if s is not None), key=lambda s: s.encode()) + [None] * (None in sizes)
    weight = {s: weights[i % len(weights)] for i, s in enumerate(names)}
    total, full = share * sum(sizes.values()), {}
    while True:
        left = {s: w for s, w in weight.items() if s not in full}
        rest = total - sum(full.values())
        now = {s: rest * w / sum(left.values()) for s, w in left.items()} if left else {}
        over = {s for s, t in now.items() if t > ceiling * sizes[s]}
        if not over:
            return full | now
        full |= {s: ceiling * sizes[s] for s in over}


def words(text):
    return len(re.findall(r"[^\x20\x09-\x0D]+", text or ""))


@pytest.mark.parametrize("skew", [False, True])
def test_targets_and_budgets(docs, sample, skew):
    texts = ODD + [r.text for r in sample.collect()]
    sources = ["hot" if skew and i % 3 else ("b", "a", "é", "", None, "zz", "only-empty")[i % 7] for i in range(len(texts))]
    sources = [s if words(t) or s != "only-empty" else s for s, t in zip(sources, texts)]
    frame = docs(texts, sources=sources).cache()
    rows = mixing.mix(frame).collect()
    assert len(rows) == len(texts)
    sizes = {}
    for s, t in zip(sources, texts):
        sizes[s] = sizes.get(s, 0) + words(t)
    want, taken = targets(sizes), dict.fromkeys(sizes, 0)
    for r in rows:
        assert r.size == words(texts[r.doc_id]) and r.source_size == sizes[r.source]
        assert r.target == pytest.approx(want[r.source])
        assert 0 <= r.taken <= 2 * r.size and (r.size == 0 or r.taken % r.size == 0)
        taken[r.source] += r.taken
    longest = max(map(words, texts))
    for s in sizes:
        assert abs(taken[s] - want[s]) <= longest / 2 + 1
    again = {r.doc_id: r.taken for r in mixing.mix(frame.repartition(7)).collect()}
    assert again == {r.doc_id: r.taken for r in rows}
    out = mixing.mixed(frame)
    assert out.columns == frame.columns
    assert out.groupBy("doc_id").count().collect() and {r.doc_id: r["count"] for r in out.groupBy("doc_id").count().collect()} == {
        r.doc_id: r.copies for r in rows if r.copies
    }


def test_quality_raises_the_chance(spark):
    from pyspark.sql import functions as F

    frame = spark.range(4000).select(F.col("id").alias("doc_id"), F.lit("one two").alias("text"), F.when(F.col("id") < 2000, "a").otherwise("b").alias("source"))
    good = F.when(F.col("doc_id") % 2 == 0, 1.0).otherwise(0.1)
    rows = mixing.mix(frame, quality=good, weights=(1, 9), share=0.9, ceiling=1.5).where("source = 'a'").groupBy((F.col("doc_id") % 2).alias("odd")).agg(F.sum("taken").alias("taken")).collect()
    taken = {r.odd: r.taken for r in rows}
    assert taken[0] > 3 * taken[1] and abs(sum(taken.values()) - 1200) <= 2


def test_empty_and_null(docs):
    assert mixing.mix(docs([])).count() == 0
    assert mixing.mixed(docs([]).selectExpr("*", "1 AS key", "2 AS size", "3 AS __x")).count() == 0
    rows = mixing.mix(docs([None, None], sources=[None, None])).collect()
    assert [(r.size, r.target, r.taken) for r in rows] == [(0, 0.0, 0)] * 2
    rows = mixing.mix(docs(["a b", "a b", "a b"], ids=[1, 1, None], sources=["s"] * 3)).collect()
    assert len(rows) == 3 and {r.target for r in rows} == {9.0}
