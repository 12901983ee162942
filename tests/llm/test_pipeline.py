"""The pipeline on a small corpus, each stage against what plain Python makes of its input."""

import pytest

import corpus_pipeline
from lectern.llm import neardup
from lectern.llm.packing import public_byte_bpe

from .test_lines import brute
from .test_mixing import words
from .test_neardup import brute_components, brute_simhash

SHARED = " ".join(f"shared{i}" for i in range(60))


@pytest.fixture(scope="module")
def stages(spark, tmp_path_factory):
    """(documents, rows that each stage returns)"""
    folder = str(tmp_path_factory.mktemp("corpus"))
    docs = spark.read.parquet("/root/testdata/sf0.001/documents.parquet").where("doc_id < 150")
    more = [(1000 + i, f"own line {i} of words\n{SHARED}\nlast {i}", "en", "x", None) for i in range(4)] + [(2000, None, None, None, None), (2001, "", "en", "x", 0)]
    docs = docs.unionByName(spark.createDataFrame(more, docs.schema))
    docs.coalesce(2).write.parquet(f"{folder}/documents.parquet")
    spark.read.parquet("/root/testdata/sf0.001/labels.parquet").write.parquet(f"{folder}/labels.parquet")
    now, made = spark.read.parquet(f"{folder}/documents.parquet"), []
    for name, stage in corpus_pipeline.STAGES:
        stage(spark, now, folder).write.parquet(f"{folder}/{name}")
        made.append(now := spark.read.parquet(f"{folder}/{name}"))
    return docs, [m.collect() for m in made], folder


def test_stage_columns_and_order(stages):
    _, rows, _ = stages
    assert [n for n, _ in corpus_pipeline.STAGES] == ["toxicity", "line_dedup", "simhash", "mix", "packing"]
    assert all(tuple(r.__fields__) == corpus_pipeline.COLUMNS for stage in rows[:-1] for r in stage[:1])


def test_toxicity_drops_some_and_keeps_the_rest_as_it_was(stages):
    docs, rows, _ = stages
    before = {r.doc_id: r.text for r in docs.collect()}
    assert 0.8 * len(before) < len(rows[0]) <= len(before)
    assert all(before[r.doc_id] == r.text for r in rows[0])


def test_lines(stages):
    _, (before, after, *_), _ = stages
    before = sorted(before, key=lambda r: r.doc_id)
    gone = brute([r.text for r in before], 30)
    want = {}
    for r, lost in zip(before, gone, strict=True):
        text = r.text if not lost else "\n".join(x for k, x in enumerate(r.text.split("\n")) if k not in lost)
        if not lost or text.strip():
            want[r.doc_id] = text
    assert {r.doc_id: r.text for r in after} == want
    assert any(gone)


def test_near_duplicates(stages):
    _, (_, before, after, *_), _ = stages
    prints = {r.doc_id: brute_simhash(r.text) for r in before}
    roots = brute_components(prints, lambda a, b: bin(a ^ b).count("1") <= 4)
    assert {r.doc_id for r in after} == set(roots.values())


def test_mix_takes_whole_documents_near_the_target(stages):
    _, (_, _, before, after, _), _ = stages
    sizes = {r.doc_id: words(r.text) for r in before}
    taken = [r.doc_id for r in after]
    assert set(taken) <= set(sizes) and all(taken.count(i) <= 2 for i in set(taken))
    total = sum(sizes.values())
    assert total * 1.3 < sum(sizes[i] for i in taken) < total * 1.55


def test_packing_holds_every_copy(stages):
    _, (*_, before, after), _ = stages
    encode = public_byte_bpe()
    tokens = sum(len(encode(r.text)) + 1 if r.text else 1 for r in before)
    assert sum(r.length for r in after) == tokens
    assert len({(r.sequence_id, r.offset) for r in after}) == len(after)


def test_run_equals_its_stages(spark, stages):
    _, rows, folder = stages
    out = corpus_pipeline.run(spark, folder).collect()
    assert sum(r.length for r in out) == sum(r.length for r in rows[-1])


def test_near_dedup_broadcasts_no_buckets(stages, spark, monkeypatch):
    """What the stage deals to buckets is 31 times its fingerprints, and isn't built in the driver's memory."""
    _, _, folder = stages
    plans, whole = [], neardup.components
    monkeypatch.setattr(neardup, "components", lambda links: plans.append(links._jdf.queryExecution().sparkPlan().toString()) or whole(links))
    kept = dict(corpus_pipeline.STAGES)["simhash"](spark, spark.read.parquet(f"{folder}/line_dedup"), folder)
    assert kept.count() and plans[0].count("SortMergeJoin [table") == 1 and "BroadcastHashJoin [table" not in plans[0]
