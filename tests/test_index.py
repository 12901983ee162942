"""The stored index: searches equal those over texts, whatever versions came before; what is read; dictionaries; commits."""

import math
import random
from collections import Counter

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from lectern.functions import dictionary as D
from lectern.functions import text as T
from lectern.operators import index as I
from lectern.operators import search as S
from lectern.sources.versions import Conflict, Versions

WORDS = ["the"] * 30 + [f"w{i}" for i in range(40)] + ["管", "理", "制度", "gsp-90a", "é", "7"]


def texts_of(seed, n):
    rng = random.Random(seed)
    return [" ".join(rng.choice(WORDS) for _ in range(rng.choice([0, 1, 5, 20, 60]))) for _ in range(n)]


def frame(spark, texts, start=0):
    return spark.createDataFrame([(start + i, t) for i, t in enumerate(texts)], "doc_id long, text string")


QUERIES = ["the", "w1 w2 the", "管理 制度", "gsp-90a", "nothing here", "", "the w3 w4 w5 w6 w7 w8 w9 é 7", "w1 w1 w1"]


@pytest.fixture(scope="module")
def queries(spark):
    return spark.createDataFrame(list(enumerate(QUERIES)), "query_id int, query string")


def found(df):
    return sorted(map(tuple, df.select("query_id", "id", "score", "rank").collect()))


def brute(texts, k, ids=None, words=(), scope=None):
    """BM25 from tokens as they are defined, without Spark."""
    known = D.Dictionary(words)

    def tokens(t):
        low = (t or "").lower()
        own = known.cut(low)
        import re

        codes = []
        for m in re.finditer(T.CODE, low.replace("\n", "\n")):
            x = m[0]
            if len(x) >= 2 and re.search("[a-z]", x) and re.search(r"\d", x) and x not in codes:
                codes.append(x)
        return own + codes

    held = {i: Counter(tokens(t)) for i, t in zip(ids or range(len(texts)), texts)}
    sizes = {i: sum(c.values()) for i, c in held.items()}
    filled = [n for n in sizes.values() if n]
    avg = sum(filled) / len(filled) if filled else 1.0
    out = []
    for q, text in enumerate(QUERIES):
        scores = []
        terms = set(tokens(text))
        df = {t: sum(t in c for c in held.values()) for t in terms}
        for i, c in held.items():
            hit = [t for t in terms if t in c]
            if hit and (scope is None or i in scope):
                s = sum(math.log(1 + (len(held) - df[t] + 0.5) / (df[t] + 0.5)) * c[t] * 2.2 / (c[t] + 1.2 * (0.25 + 0.75 * sizes[i] / avg)) for t in hit)
                scores.append((-round(s, 6), i))
        out += [(q, i, -s, r) for r, (s, i) in enumerate(sorted(scores)[:k], 1)]
    return out


def close(got, want):
    assert [(q, r) for q, _, _, r in got] == [(q, r) for q, _, _, r in want]
    assert all(abs(a[2] - b[2]) < 3e-6 for a, b in zip(got, want))
    same = sum(a[1] == b[1] for a, b in zip(got, want))
    assert same >= len(want) - 2  # rounding may turn a tie


def by_query(rows):
    return sorted(rows, key=lambda r: (r[0], r[3]))


def test_search_equals_brute_force(spark, queries, tmp_path):
    texts = [*texts_of(1, 700), None, ""]
    docs = frame(spark, texts)
    index = I.build(docs, str(tmp_path / "index"))
    assert index.n_docs == len(texts)
    close(by_query(found(index.keyword_search(queries, 5))), brute(texts, 5))
    assert found(index.keyword_search(queries, 20)) == found(S.keyword_search(docs, queries, 20))
    scope = docs.where("doc_id % 3 = 1").select("doc_id")
    close(by_query(found(index.keyword_search(queries, 4, scope=scope))), brute(texts, 4, scope={i for i in range(len(texts)) if i % 3 == 1}))
    assert found(index.keyword_search(queries, 4, scope=scope.limit(0))) == []
    assert found(index.keyword_search(queries.limit(0), 4)) == []
    freq = {r.term: r.df for r in index.doc_freq().collect()}
    assert freq == {r.term: r.df for r in S.doc_freq(S.postings(S.tokenised(docs))).collect()}


def test_versions(spark, queries, tmp_path):
    """Added, replaced, removed and merged documents give what an index of the documents as they are gives."""
    first, more = texts_of(2, 300), texts_of(3, 200)
    one = I.build(frame(spark, first), str(tmp_path / "index"))
    two = I.added(one, frame(spark, more, start=200))  # 200 to 299 are replaced
    now = first[:200] + more
    close(by_query(found(two.keyword_search(queries, 6))), brute(now, 6))
    three = I.removed(two, spark.range(50, 120).withColumnRenamed("id", "id"))
    ids = [i for i in range(400) if not 50 <= i < 120]
    close(by_query(found(three.keyword_search(queries, 6))), brute([now[i] for i in ids], 6, ids))
    four = I.added(three, frame(spark, now[60:80], start=60))
    ids = sorted([*ids, *range(60, 80)])
    want = brute([now[i] for i in ids], 6, ids)
    close(by_query(found(four.keyword_search(queries, 6))), want)
    assert (four.n_docs, four.docs().count()) == (len(ids), len(ids))
    five = I.compacted(four)
    assert len(five.segments) == 1 and found(five.keyword_search(queries, 6)) == found(four.keyword_search(queries, 6))
    assert {r.term: r.df for r in five.doc_freq().collect()} == {r.term: r.df for r in four.doc_freq().collect()}
    # what was read before can still be read
    again = I.Index.at(spark, one.root, 1)
    close(by_query(found(again.keyword_search(queries, 6))), brute(first, 6))
    assert I.Index.at(spark, one.root).version == 5
    assert Versions(spark, one.root).vacuum() >= 4
    assert found(I.Index.at(spark, one.root).keyword_search(queries, 6)) == found(five.keyword_search(queries, 6))


def test_reindex_for_another_dictionary(spark, queries, tmp_path):
    texts = texts_of(4, 200) + ["管理 is two signs", "管理制度 four of them", "the w1 only"]
    docs = frame(spark, texts)
    old = I.build(docs, str(tmp_path / "index"))
    new = I.reindexed(old, docs, ["管理", "W1 the"])
    assert new.words == ["管理", "W1 the"]
    # only texts whose tokens change were indexed anew
    changed = sum(("管理" in t) or ("w1 the" in D.Dictionary(["w1 the"]).cut(t)) for t in texts)
    assert new._table("removed", new.segments[-1]).count() == changed < len(texts) / 2
    close(by_query(found(new.keyword_search(queries, 5))), brute(texts, 5, words=["管理", "w1 the"]))
    close(by_query(found(old.keyword_search(queries, 5))), brute(texts, 5))  # the version before, side by side
    back = I.reindexed(new, docs, [])
    close(by_query(found(back.keyword_search(queries, 5))), brute(texts, 5))


def test_string_ids(spark, queries, tmp_path):
    texts = texts_of(5, 100)
    docs = frame(spark, texts).select(F.format_string("c%04d", "doc_id").alias("chunk_id"), "text")
    index = I.added(I.build(docs.where("chunk_id < 'c0050'"), str(tmp_path / "index"), id_col="chunk_id"), docs.where("chunk_id >= 'c0040'"), id_col="chunk_id")
    got = [(q, int(i[1:]), s, r) for q, i, s, r in by_query(found(index.keyword_search(queries, 5)))]
    close(got, brute(texts, 5))
    some = docs.where("chunk_id < 'c0010'").select("chunk_id")
    assert {i for _, i, _, _ in found(index.keyword_search(queries, 9, scope=some))} <= {f"c{i:04d}" for i in range(10)}


def test_search_reads_no_text_and_only_its_buckets(spark, tmp_path):
    docs = frame(spark, texts_of(6, 500))
    index = I.build(docs, str(tmp_path / "index"))
    one = spark.createDataFrame([(1, "w7")], "query_id int, query string")
    rows = index.blocks(S.query_terms(one).select("term"))
    files = {f.rsplit("/", 2)[1] for f in rows.inputFiles()}
    every = {f.rsplit("/", 2)[1] for f in index.blocks().inputFiles()}
    plan = rows._jdf.queryExecution().executedPlan().toString()
    assert len(every) == 8 and "bucket" in plan.split("PartitionFilters")[1].split("PushedFilters")[0] and len(files) >= 1
    assert rows.select("term").distinct().count() < index.blocks().select("term").distinct().count()
    search = index.keyword_search(one, 5)
    assert all("/index/" in f for f in search.inputFiles())


def test_search_over_texts_shuffles_no_match(spark):
    """A term that all documents and queries hold makes neither a row per match nor one per posting in any shuffle."""
    docs = frame(spark, [f"the w{i % 50}" for i in range(2000)])
    asked = spark.createDataFrame([(q, f"the w{q}") for q in range(40)], "query_id int, query string")

    def stages():
        lists, doubles = spark._jvm.java.util.ArrayList, spark.sparkContext._gateway.new_array(spark._jvm.double, 0)
        spark.sparkContext._jsc.sc().listenerBus().waitUntilEmpty(30_000)
        listed = spark.sparkContext._jsc.sc().statusStore().stageList(lists(), False, False, doubles, lists())
        return {(s.stageId(), s.attemptId()): s.shuffleWriteRecords() for s in (listed.apply(i) for i in range(listed.size()))}

    before = stages()
    rows = S.keyword_search(docs, asked, 3).collect()
    assert len(rows) == 120 and all(r.id % 50 == r.query_id for r in rows)
    written = [n for stage, n in stages().items() if stage not in before]
    assert written and max(written) <= 2000  # the texts


def test_repeated_ids_in_search_over_texts(spark):
    """Rows that share an id count as one document, whose postings add up where its lengths differ, as in the SQL."""
    docs = spark.createDataFrame([(1, "a b"), (1, "a b"), (1, "a c d"), (2, "a x y z"), (3, "q")], "doc_id long, text string")
    asked = spark.createDataFrame([(9, "a")], "query_id int, query string")
    n, average, df = 5, (2 + 2 + 3 + 4 + 1) / 5, 3
    weight = lambda tf, length: math.log(1 + (n - df + 0.5) / (df + 0.5)) * tf * 2.2 / (tf + 1.2 * (0.25 + 0.75 * length / average))
    got = {r.id: r.score for r in S.keyword_search(docs, asked, 5).collect()}
    assert got == {1: round(weight(2, 2) + weight(1, 3), 6), 2: round(weight(1, 4), 6)}


def test_blocks_that_cannot_win_are_not_opened():
    """A query's blocks are passed over once its k-th score is out of their reach; the result is the same."""
    rng = np.random.default_rng(0)
    kind = pa.struct([("term", pa.string()), ("ids", pa.list_(pa.int64())), ("tfs", pa.list_(pa.int32())), ("lengths", pa.list_(pa.int32())), ("max_tf", pa.int32()), ("min_length", pa.int32())])
    blocks, every = [], Counter()
    idfs = {"rare": 5.0, "common": 0.1}
    best = I.Best(3, 50.0)
    for b in range(40):
        rows = []
        for term in ("rare", "common") if b < 4 else ("common",):
            ids = np.sort(rng.choice(100, 20, replace=False)) + b * 100
            tfs, lengths = rng.integers(1, 9, 20), 20 + ids % 77
            rows.append({"term": term, "ids": ids.tolist(), "tfs": tfs.tolist(), "lengths": lengths.tolist(), "max_tf": int(tfs.max()), "min_length": int(lengths.min())})
            for i, w in zip(ids.tolist(), best.weights(tfs, lengths, np.full(20, idfs[term]))):
                every[i] += w
        blocks.append(pa.array(rows, kind))
    for held in blocks:
        best.add(held, {7: ["rare", "common", "none"], 8: ["nowhere"]}, idfs)
    queries, scores, ids = best.rows()
    want = sorted(every.items(), key=lambda x: (-round(x[1], 6), x[0]))[:3]
    assert queries == [7] * 3 and ids.tolist() == [i for i, _ in want] and np.allclose(scores, [s for _, s in want])
    assert best.met == 40 and best.opened <= 5


def test_commits(spark, tmp_path):
    store = Versions(spark, str(tmp_path / "table"))
    assert store.latest() == (0, {})
    assert store.commit(0, {"a": "é"}) == 1 and store.latest() == (1, {"a": "é"})
    with pytest.raises(Conflict):
        store.commit(0, {"a": 2})
    assert store.commit(1, {"a": 3}) == 2 and store.state(1) == {"a": "é"} and store.numbers() == [1, 2]
    with pytest.raises(FileNotFoundError):
        I.Index.at(spark, str(tmp_path / "none"))


@pytest.mark.parametrize("seed", range(4))
def test_dictionary_cuts_as_a_pattern_does(seed):
    """Forward maximum match against trying every word at every place."""
    rng = random.Random(seed)
    letters = "ab7管理制度é_- "
    words = {"".join(rng.choice(letters) for _ in range(rng.randrange(1, 5))).strip() for _ in range(60)} - {""}
    known = D.Dictionary(words)

    def inner(c):
        return bool(D._INNER.match(c))

    def plain(text):
        out, at = [], 0
        while at < len(text):
            fits = []
            for w in words:
                if text.startswith(w, at):
                    end = at + len(w)
                    head = D._EDGE.match(w[0]) and at and inner(text[at - 1])
                    tail = D._EDGE.match(w[-1]) and end < len(text) and inner(text[end])
                    if not head and not tail:
                        fits.append(w)
            m = D._RUN.match(text, at)
            piece = max(fits, key=len) if fits else m[0] if m else ""
            out += [piece] if piece else []
            at += len(piece) or 1
        return out

    for _ in range(300):
        text = "".join(rng.choice(letters) for _ in range(40))
        assert known.cut(text) == plain(text)
        assert known.holds(text) == any(w in text for w in words)


def test_dictionary_of_100_000_words(spark):
    rng = random.Random(9)
    signs = [chr(0x4E00 + i) for i in range(3000)]
    words = {"".join(rng.choice(signs) for _ in range(rng.randrange(2, 5))) for _ in range(100_000)}
    listed = sorted(words)
    planted = [rng.choice(listed) for _ in range(2000)]
    texts = ["".join(planted[i : i + 20]) for i in range(0, 2000, 20)]
    longest = max(map(len, words))

    def plain(text):
        out, at = [], 0
        while at < len(text):
            size = next((n for n in range(longest, 1, -1) if text[at : at + n] in words), 1)
            out.append(text[at : at + size])
            at += size
        return out

    docs = frame(spark, [*texts, None, ""])
    got = [r.t for r in docs.orderBy("doc_id").select(T.tokens(F.col("text"), listed).alias("t")).collect()]
    assert got == [*map(plain, texts), None, []]
