"""Phrases against plain Python counts, over random and odd texts."""

import random
import re
from collections import Counter, defaultdict

import numpy as np
import pytest
from pyspark.sql import functions as F

from lectern.llm import phrases as P

from .conftest import ODD


def brute(rows, least=30, first=2000):
    pieces = defaultdict(list)
    for text, lang in rows:
        low = re.sub("[A-Z]", lambda m: m[0].lower(), text or "")
        pieces[lang or "und" if lang is None else lang] += [[w for w in re.split(r"[\x20\x09]+", p) if w] for p in re.split(r"[.,;:!?\x0A-\x0D]", low)]
    out = set()
    for lang, held in pieces.items():
        f = Counter(tuple(p[i : i + k]) for p in held for k in range(1, 5) for i in range(len(p) - k + 1))
        n = sum(map(len, held))
        found = {g: c for g, c in f.items() if len(g) > 1 and c >= least}
        kept = []
        for g, a in found.items():
            longer = [b for h, b in found.items() if len(h) > len(g) and any(h[i : i + len(g)] == g for i in range(len(h) - len(g) + 1))]
            if any(100 * b >= 80 * a for b in longer):
                continue
            score, k = min((2000000 * a // (f[g[:k]] + f[g[k:]]), k) for k in range(1, len(g)))
            kept.append((-score, -a, " ".join(g).encode(), f[g[:k]], f[g[k:]]))
        out |= {(lang, i, g.decode(), -a, l, r, n, -score) for i, (score, a, g, l, r) in enumerate(sorted(kept)[:first], 1)}
    return out


def random_texts(seed, n=400):
    rng = random.Random(seed)
    words = ["the", "The", "of", "in", "new", "york", "city", "hall", "é", "汉字", "x\x0by", "\x01", "a-b", "<m>"] + [f"rare{i}" for i in range(200)]
    fixed = ["new york city hall", "new york", "in the city of", "a-b 汉字"]
    glue = [" ", "  ", "\t", ". ", ",", "\n", "! ? ", " "]
    return [("".join(rng.choice([rng.choice(words), rng.choice(fixed)]) + rng.choice(glue) for _ in range(rng.randrange(60))), rng.choice(["en", "en", "de", None, "und", ""])) for _ in range(n)]


def frame(spark, rows):
    return spark.createDataFrame(rows, "text string, lang string")


@pytest.mark.parametrize(("seed", "first"), [(1, 2000), (2, 5)])
def test_equals_plain_counts(spark, seed, first):
    rows = random_texts(seed) + [(t, "odd") for t in ODD * 8]
    got = {tuple(r) for r in P.collocations(frame(spark, rows).repartition(5), first=first).collect()}
    assert got == brute(rows, first=first) and len(got) > 10


def test_small_chunks_and_parts(spark, monkeypatch):
    """Runs that go over many chunks, rows and range partitions are counted whole."""
    monkeypatch.setattr(P, "PART", 300)
    monkeypatch.setattr(P, "EVERY", 7)
    monkeypatch.setattr(P, "SAMPLED", 2)
    rows = random_texts(3)
    got = {tuple(r) for r in P.collocations(frame(spark, rows).repartition(7), least=20).collect()}
    assert got == brute(rows, least=20)


def test_chunks_part_by_size(monkeypatch):
    monkeypatch.setattr(P, "CHUNK", 50)
    import pyarrow as pa

    rows = [(t, lang or "und") for t, lang in random_texts(4, 60)]
    batches = [pa.RecordBatch.from_pydict({"lang": [x for _, x in rows], "text": [t for t, _ in rows]})]
    total, names = 0, Counter()
    for b in P._coded(iter(batches)):
        for r in b.to_pylist():
            names[r["chunk"]] += 1
            total += sum(r["counts"])
            codes = P._unpacked(r["codes"], r["size"], np.int32)
            assert Counter(codes[codes > 0].tolist()) == {k: n for k, n in enumerate(r["counts"], 1)}
    assert total == sum(len(re.findall(r"[^.,;:!?\x0A-\x0D\x20\x09]+", t)) for t, _ in rows)
    assert len(names) > 10 and set(names.values()) == {1}


def test_radix_order_and_runs():
    rng = np.random.default_rng(0)
    keys = rng.integers(0, 3, (5000, 8)).astype(np.uint8) * np.array([1, 100, 1, 1, 100, 1, 0, 1], np.uint8)
    order = P.radix_order(keys)
    assert [k.tobytes() for k in keys[order]] == sorted(k.tobytes() for k in keys)
    starts, sums = P.runs(keys[order], np.ones(len(keys), np.int64))
    assert Counter(k.tobytes() for k in keys) == {keys[order][s].tobytes(): n for s, n in zip(starts, sums)}
    assert len(P.radix_order(keys[:0])) == 0


def test_keys_break_at_zero():
    ids = np.array([5, 6, 0, 7, 0, 8, 9, 10, 11, 12, 0], np.int64)
    got = [list(k.reshape(4, 2)[:, 1]) for k in P.keys_of(ids, 2)]
    assert got == [[5, 6, 0, 0], [8, 9, 10, 11], [9, 10, 11, 12], [10, 11, 12, 0], [11, 12, 0, 0]]


def test_no_rows_and_clashing_columns(spark):
    assert P.collocations(frame(spark, [])).count() == 0
    assert P.collocations(frame(spark, [(None, None), ("", "en"), ("a b", None)])).count() == 0
    rows = [("good words", "en")] * 40
    out = P.collocations(frame(spark, rows).withColumns({c: F.lit("clash") for c in ("key", "n", "rank", "word", "words", "codes", "chunk", "total")})).collect()
    assert [tuple(r) for r in out] == [("en", 1, "good words", 40, 40, 40, 80, 1000000)]


def test_scores_past_64_bits(spark):
    """The arithmetic of scores is exact where products pass 64 bits."""
    big = 9_000_000_000_000_000
    row = spark.createDataFrame([(big, big + 1, big)], "a long, l long, r long").select(F.expr("CAST(a AS decimal(38,0)) * 2000000 DIV (CAST(l AS decimal(38,0)) + CAST(r AS decimal(38,0)))").alias("s")).first()
    assert row.s == big * 2000000 // (2 * big + 1)
