import random
import re

import pytest
import xxhash
from pyspark.sql import functions as F

from lectern.llm import components, neardup
from lectern.llm.fingerprint import simhash64

from .conftest import ODD


def brute_simhash(text):
    words = re.findall(r"[^\x20\x09-\x0D]+", re.sub("[A-Z]", lambda m: m[0].lower(), text or ""))
    if not words:
        return 0
    shingles = [" ".join(words[i : i + 4]) for i in range(max(1, len(words) - 3))]
    hashes = [xxhash.xxh64_intdigest(s.encode(), 42) for s in shingles]
    return sum(1 << b for b in range(64) if 2 * sum(h >> b & 1 for h in hashes) > len(hashes))


def brute_components(items, near):
    """items: {id: fp}; least id reachable, by search."""
    out = {}
    for start in sorted(items):
        if start in out:
            continue
        todo, out[start] = [start], start
        while todo:
            x = todo.pop()
            for y in items:
                if y not in out and near(items[x], items[y]):
                    out[y] = start
                    todo.append(y)
    return out


def test_fingerprints_and_components(docs, sample):
    rng = random.Random(3)
    texts = ODD + [r.text for r in sample.collect()]
    for text in [t for t in texts if t and len(t.split()) > 60][:12]:
        words = text.split(" ")
        for _ in range(4):
            words[rng.randrange(len(words))] = "changed"
            texts.append(" ".join(words))
    rows = neardup.near_duplicates(docs(texts)).collect()
    assert len(rows) == len(texts)
    fps = {i: brute_simhash(t) for i, t in enumerate(texts)}
    want = brute_components(fps, lambda a, b: bin(a ^ b).count("1") <= 4)
    for r in rows:
        assert r.fp % (1 << 64) == fps[r.doc_id]
        assert r.component_id == want[r.doc_id]
    assert len({r.component_id for r in rows}) < len(rows) - 12


def test_spark_hash_is_the_same(spark):
    text = "Zwölf words 😀 of text"
    assert spark.range(1).select(F.xxhash64(F.lit("zwölf words 😀 of")).alias("h")).first().h % (1 << 64) == xxhash.xxh64_intdigest("zwölf words 😀 of".encode(), 42)
    assert simhash64(text[:-5]) % (1 << 64) == brute_simhash(text[:-5])


@pytest.mark.parametrize("free", [list(range(64)), list(range(3, 40))])
def test_covering(free):
    rng, masks = random.Random(1), neardup.covering_masks(4, free)
    assert len(masks) == 31
    for _ in range(3000):
        apart = sum(1 << b for b in rng.sample(free, 4))
        assert any(apart & m == 0 for m in masks)


def test_large_buckets_lose_no_pair(spark):
    rng = random.Random(2)
    centres = [rng.getrandbits(64) for _ in range(3)]
    fps = {c ^ sum(1 << b for b in rng.sample(range(64), rng.randrange(5))) for c in centres for _ in range(120)}
    signed = [f - (1 << 64) if f >> 63 else f for f in fps]
    want = {(a, b) for a in signed for b in signed if a < b and ((a ^ b) % (1 << 64)).bit_count() <= 4}
    frame = spark.createDataFrame([(f,) for f in signed], "fp long")
    for most in (2, 20, 10_000):
        assert {(r.a, r.b) for r in neardup.near_pairs(frame, 4, most=most).collect()} == want


def test_buckets_are_not_broadcast(spark):
    """A table of few bytes is 31 times as large when dealt to buckets: these meet by shuffles, not in the driver's memory."""
    fps = neardup.materialise(spark.range(100).select(F.col("id").alias("fp")), "few-fingerprints")
    for most, joins in ((10_000, 1), (2, 3)):
        plan = neardup.near_pairs(fps, 4, most=most)._jdf.queryExecution().sparkPlan().toString()
        assert plan.count("SortMergeJoin [table") == joins


def test_components_of_chains_and_hubs(spark):
    links = [(i, i + 1) for i in range(100)] + [(1000, i) for i in range(1001, 1100)] + [(5, 5), (None, 3)]
    got = {r.node: r.root for r in components.components(spark.createDataFrame(links, "a long, b long")).collect()}
    assert got == {i: 0 for i in range(1, 101)} | {i: 1000 for i in range(1001, 1100)}


def test_one_of_each(docs):
    frame = docs(["a b c d e f g", "A b  c d e f g", "other words stand here now", None, ""], ids=[4, 2, 7, 9, 8]).selectExpr("*", "0 AS fp", "1 AS component_id")
    kept = neardup.one_of_each(frame)
    assert sorted(r.doc_id for r in kept.collect()) == [2, 7, 8] and kept.columns == frame.columns
    assert neardup.one_of_each(docs([])).count() == 0
    assert neardup.near_duplicates(docs(["x", "x"], ids=[None, 3])).where("component_id = 3").count() == 2


def test_one_of_each_with_null_and_repeated_ids(docs):
    """Unlike texts stay whatever their ids; of near-duplicates the least id stays, nulls last, also where its id stands elsewhere."""
    base = " ".join(f"word{i}" for i in range(400))
    near = base.upper()  # the same fingerprint, another text
    texts = ["alone with no id", "also alone, and without an id", base, near, near, "quite another text of id 3", "one of two texts", "the second text of this id", "one of two texts"]
    ids = [None, None, 3, 2, None, 3, 5, 5, 5]
    kept = sorted(((r.doc_id, r.text) for r in neardup.one_of_each(docs(texts, ids)).collect()), key=str)
    want = [(None, texts[0]), (None, texts[1]), (2, near), (3, texts[5]), (5, texts[6]), (5, texts[7])]
    assert kept == sorted(want, key=str)
