"""Fill-in-the-middle against plain Python, and its boundary lists."""

import hashlib

import numpy as np
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from lectern.llm import fill_middle as M

from .conftest import ODD

MARKED = ["a <P> b", "<M>", "x<S>", "<<P><S", "<P", "S><M", "ends with <", "<S", ">" * 9]
TEXTS = [*ODD, *MARKED, "汉字と😀 mixed é" * 50, "汉" * 999, *["one text with many copies"] * 300, *MARKED, "汉" * 999]


def brute(doc_id, text, seed=1):
    text = text or ""
    h = hashlib.sha256(f"{seed}:{'' if doc_id is None else doc_id}".encode()).hexdigest()
    h1, h2, h3, h4 = (int(h[i : i + 8], 16) for i in range(0, 32, 8))
    n = len(text)
    if not text or any(m in text for m in ("<P>", "<S>", "<M>")) or h3 % 100 >= 90:
        return n, "plain", None, None, text
    a, z = sorted((h1 % (n + 1), h2 % (n + 1)))
    p, m, s = text[:a], text[a:z], text[z:]
    return (n, "spm", a, z - a, f"<S>{s}<P>{p}<M>{m}") if h4 % 100 < 20 else (n, "psm", a, z - a, f"<P>{p}<S>{s}<M>{m}")


@settings(max_examples=200, deadline=None)
@given(st.lists(st.integers(0, 5000), min_size=1, max_size=200), st.data())
def test_select_gives_each_number(values, data):
    values = np.sort(np.array(values, np.int64))
    held = M.Boundaries.of(values)
    places = data.draw(st.lists(st.integers(0, len(values) - 1), min_size=1, max_size=5))
    assert held.select(places) == values[places].tolist()
    assert len(held.high) * 8 <= 3 * len(values) + 8 and len(held.low) * 8 <= len(values) * held.width + 8


@given(st.text(max_size=300))
def test_boundaries_of_utf8(text):
    held = M.Boundaries.in_utf8(text.encode())
    assert held.size == len(text) + 1
    assert held.select(list(range(len(text) + 1))) == [len(text[:i].encode()) for i in range(len(text) + 1)]


def test_equals_plain_python_and_restores(docs, sample):
    texts = TEXTS + [r.text for r in sample.collect()]
    out = M.fill_middle(docs(texts)).withColumn("back", M.restored(F.col("output"), F.col("form"))).collect()
    assert len(out) == len(texts)
    for r in out:
        assert (r.n, r.form, r.prefix_chars, r.middle_chars, r.output) == brute(r.doc_id, texts[r.doc_id]), texts[r.doc_id]
        assert r.back == (texts[r.doc_id] or "")
    assert {r.form for r in out} == {"plain", "psm", "spm"}
    assert len({r.output for r in out if texts[r.doc_id] == "one text with many copies"}) > 100  # each copy has its own cuts


def test_index_holds_each_text_once(spark):
    rows = spark.createDataFrame([(1, "a"), (1, "b"), (1, "a"), (2, "é"), (2, "é"), (2, "")], "key long, text string")  # 1: two texts of one hash
    got = M.text_index(rows).collect()
    assert sorted((r.key, r.text) for r in got) == [(1, "a"), (1, "b"), (2, ""), (2, "é")]
    assert all(M.Boundaries(**r.bounds.asDict()).select([len(r.text)]) == [len(r.text.encode())] for r in got)


@pytest.mark.parametrize("texts", [[], [None], ["", None, "", None]])
def test_few_rows(docs, texts):
    assert [(r.n, r.form, r.output) for r in M.fill_middle(docs(texts)).collect()] == [(0, "plain", "")] * len(texts)


def test_null_ids_repeats_and_clashes(docs):
    frame = docs(["some words here"] * 3 + ["other words"], ids=[None, None, 5, 5]).withColumns({c: F.lit("clash") for c in ("key", "bounds", "known", "form", "n", "output")})
    out = M.fill_middle(frame).collect()
    assert sorted(map(str, ((r.doc_id, r.output) for r in out))) == sorted(str((i, brute(i, t)[4])) for i, t in [(None, "some words here")] * 2 + [(5, "some words here"), (5, "other words")])


def test_seeds_differ(docs):
    a, b = ({r.doc_id: r.output for r in M.fill_middle(docs(["some words in a row"] * 40), seed=s).collect()} for s in (1, 2))
    assert sum(a[i] != b[i] for i in a) > 20
