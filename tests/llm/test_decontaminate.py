"""Benchmark windows in documents against plain Python."""

import hashlib
import random
import re

import pytest
from pyspark.sql import functions as F

from lectern.llm import decontaminate as D
from lectern.llm import queries

from .conftest import ODD


def words_of(text):
    return re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", re.sub("[A-Z]", lambda m: m[0].lower(), text or ""))


def brute(texts, items, window=10):
    """(words, hit words, item ids) of each text."""
    named = [(i, words_of(t)) for i, t in items]
    windows = [(i, [w[k : k + window] for k in range(max(1, len(w) - window + 1))]) for i, w in named if w]
    out = []
    for text in texts:
        words, hit, ids = words_of(text), set(), set()
        for item, held in windows:
            for w in held:
                for at in range(len(words) - len(w) + 1):
                    if words[at : at + len(w)] == w:
                        hit |= set(range(at, at + len(w)))
                        ids |= {item} - {None}
        out.append((len(words), hit, ids))
    return out


def random_case(seed):
    """Few words, so that items, their parts and documents meet often and in many ways."""
    rng = random.Random(seed)
    vocabulary = ["a", "b", "c"] if seed % 2 else [f"w{i}" for i in range(12)]

    def text(n):
        return rng.choice([" ", ", ", "_-"]).join(rng.choice(vocabulary) for _ in range(n))

    items = [(f"i{k}", text(rng.choice([0, 1, 2, 3, 5, 7, 9, 10, 11, 14, 25]) if seed % 3 else rng.choice([10, 12, 30]))) for k in range(12)]
    texts = []
    for _ in range(40):
        parts = [text(rng.randrange(6))]
        for _ in range(rng.randrange(4)):
            words = words_of(rng.choice(items)[1])
            a = rng.randrange(len(words) + 1)
            parts += [" ".join(words[a : a + rng.choice([4, 9, 10, 12, 40])]).upper(), rng.choice(["", "zzz", text(3)])]
        texts.append(" ".join(parts))
    return texts, items


def frames(spark, docs, texts, items):
    return docs(texts), spark.createDataFrame(items, "item_id string, text string")


@pytest.mark.parametrize("seed", range(12))
def test_automaton_equals_brute_force(seed):
    window = 4 if seed % 4 == 0 else 10
    texts, items = random_case(seed)
    automaton = D.Automaton.of([(i, " ".join(words_of(t)).encode()) for i, t in items], window)
    import numpy as np

    for text, (n, hit, ids) in zip(texts, brute(texts, items, window)):
        numbers = np.array([automaton.words.get(w.encode(), -1) for w in words_of(text)], np.int32)
        spans, named = automaton.spans(numbers) if n else ([], set())
        assert {k for a, z in spans for k in range(a, z)} == hit and named == ids, text
        assert all(a[1] < b[0] for a, b in zip(spans, spans[1:]))


@pytest.mark.parametrize("block", [1 << 20, 40])
def test_operator_equals_brute_force(spark, docs, sample, block):
    texts, items = random_case(5)
    texts += [*ODD, texts[0], items[3][1]] + [r.text for r in sample.collect()]
    items += [(None, "only a null id has these ten words in all of it here"), ("twice", "b c a b"), ("twice", "b c a b"), ("none", None), ("empty", " .,")]
    texts.append("x only a null id has these ten words in all of it here x")
    d, b = frames(spark, docs, texts, items)
    out = {r.doc_id: r for r in D.overlaps(d, b, block=block).collect()}
    assert len(out) == len(texts)
    for i, (n, hit, ids) in enumerate(brute(texts, items)):
        r = out[i]
        assert r.n_words == n and r["items"] == sorted(ids) and {k for s in r.spans for k in range(s.start, s.end)} == hit, texts[i]
    assert sum(bool(r.spans) for r in out.values()) > 20


def test_pieces_lose_no_window(spark, docs, monkeypatch):
    monkeypatch.setattr(D, "PIECE", 25)
    words = [f"w{i}" for i in range(200)]
    texts = [" ".join(words[a : a + 10]) for a in range(191)] + [" ".join(words)]
    d, b = frames(spark, docs, texts, [("long", " ".join(words))])
    out = D.overlaps(d, b).withColumn("n_hit", D.n_hit(F.col("spans"))).collect()
    assert all(r.n_hit == r.n_words for r in out)


def test_query_digests(spark, docs, tmp_path):
    texts, items = random_case(7)
    d, b = frames(spark, docs, texts, items)
    d.withColumns({"key": F.lit(1), "spans": F.lit(2), "items": F.lit(3)}).write.parquet(str(tmp_path / "documents.parquet"))
    b.withColumn("words", F.lit(1)).write.parquet(str(tmp_path / "benchmark.parquet"))
    got = {r.doc_id: r for r in queries.op13_decontaminate(spark, str(tmp_path)).collect()}
    for i, (n, hit, ids) in enumerate(brute(texts, items)):
        r = got[i]
        assert (r.n_words, r.n_hit, r.n_items, r.contaminated) == (n, len(hit), len(ids), bool(hit))
        assert r.items_sha256 == hashlib.sha256(",".join(sorted(ids)).encode()).hexdigest()


def test_no_items_no_rows_null_ids(spark, docs):
    d, b = frames(spark, docs, ["a b c"], [("x", "a b c")])
    assert [len(r.spans) for r in D.overlaps(d, b.limit(0)).collect()] == [0]
    assert D.overlaps(d.limit(0), b).count() == 0
    got = D.overlaps(docs(["a b c", "a b c", "a b c d"], ids=[None, None, 4]), b).collect()
    assert [(r.doc_id, r.n_words, len(r.spans)) for r in sorted(got, key=lambda r: r.n_words)] == [(None, 3, 1), (None, 3, 1), (4, 4, 1)]


def test_spans_go_and_covered_documents(spark, docs):
    item = "one two three four five six seven eight nine ten eleven"
    clean = " ".join(f"clean{i}" for i in range(40))
    texts = [f"{clean}. One, two (three) four five six seven eight nine TEN eleven! The rest.", f"so: {item}", clean, None, ""]
    d, b = frames(spark, docs, texts, [("i", item)])
    frame = d.withColumns({c: F.lit("clash") for c in ("key", "spans", "items", "n_words")})
    out = {r.doc_id: r for r in D.decontaminate(frame, b).collect()}
    assert set(out) == {0, 2, 3, 4} and out[0].text == f"{clean}. ! The rest." and out[2].text == clean and out[3].text is None and out[0].key == "clash"
    # spans below the limit stay, whatever is hit
    assert {r.doc_id: r.text for r in D.decontaminate(d, b, longest=12, coverage=1.0).collect()} == dict(enumerate(texts))
