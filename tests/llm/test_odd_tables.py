"""Every stage of the pipeline, and operators not tested so elsewhere, on odd tables: nulls anywhere, repeated rows and ids, columns
whose names clash with inner ones, and no row."""

import zlib

import pytest
from pyspark.sql import functions as F

import corpus_pipeline
from lectern.llm import decontaminate, fill_middle, license_scan, neardup, packing, phrases, secret_scan
from lectern.llm.packing import public_byte_bpe

from .conftest import ODD
from .test_neardup import brute_simhash

CLASHES = ("fp", "mark", "root", "label", "size", "taken", "rank", "line", "words", "at", "table", "key", "token", "kind", "spans", "start", "length", "__row", "__hash", "__id", "ids", "held_out", "score")
TEXTS = [*ODD, "word", None, " ".join(f"only{i}" for i in range(200_000)), "one text of its own here", "another text, quite unlike it there"]
IDS = [*range(len(ODD)), 3, None, None, 3, None]


@pytest.fixture(scope="module")
def folder(spark, tmp_path_factory):
    path = str(tmp_path_factory.mktemp("odd"))
    spark.read.parquet("/root/testdata/sf0.001/labels.parquet").write.parquet(f"{path}/labels.parquet")
    return path


@pytest.fixture(scope="module")
def odd(docs):
    """Odd documents with columns that clash, each row of the first two twice."""
    frame = docs(TEXTS + TEXTS[:2], ids=IDS + IDS[:2])
    frame = frame.withColumn("lang", F.when(F.col("doc_id") > 2, "en")).withColumn("n_chars", F.when(F.col("doc_id") > 3, F.col("n_chars")))
    return frame.withColumns({c: F.lit("clash") for c in CLASHES})


def rows_of(df):
    return sorted((r.doc_id is None, r.doc_id or 0, r.text is None, zlib.crc32((r.text or "").encode()), r.source or "") for r in df.collect())


@pytest.mark.parametrize("name", [n for n, _ in corpus_pipeline.STAGES])
def test_stage_of_no_row(spark, odd, folder, name):
    assert dict(corpus_pipeline.STAGES)[name](spark, odd.limit(0), folder).count() == 0


@pytest.mark.parametrize("name", ["toxicity", "line_dedup"])
def test_stages_that_keep_all_of_it(spark, odd, folder, name):
    out = dict(corpus_pipeline.STAGES)[name](spark, odd, folder)
    assert tuple(out.columns) == corpus_pipeline.COLUMNS and rows_of(out) == rows_of(odd)


def test_simhash_stage(spark, odd, folder):
    out = dict(corpus_pipeline.STAGES)["simhash"](spark, odd, folder)
    assert tuple(out.columns) == corpus_pipeline.COLUMNS
    # one row for each group of linked fingerprints, none of which is far from the ones left
    left = [brute_simhash(r.text) for r in out.collect()]
    assert len(set(left)) == len(left) and all(min(bin(brute_simhash(t) ^ f).count("1") for f in left) <= 4 * 3 for t in TEXTS)
    assert {"one text of its own here", "another text, quite unlike it there"} <= {r.text for r in out.collect()}


def test_mix_stage(spark, odd, folder):
    out = dict(corpus_pipeline.STAGES)["mix"](spark, odd, folder)
    assert tuple(out.columns) == corpus_pipeline.COLUMNS and set(rows_of(out)) <= set(rows_of(odd))


def test_packing_stage(spark, odd, folder):
    encode = public_byte_bpe()
    out = dict(corpus_pipeline.STAGES)["packing"](spark, odd, folder).collect()
    assert sum(r.length for r in out) == sum(len(encode(t or "")) + 1 for t in TEXTS + TEXTS[:2])
    assert all(r.offset + r.length <= 1024 for r in out)


def overlaps(docs):
    items = docs.sparkSession.createDataFrame([("long", " ".join(f"only{i}" for i in range(199_000, 200_000))), ("none", None)], "item_id string, text string")
    return decontaminate.overlaps(docs, items)


@pytest.mark.parametrize("operator", [secret_scan.scan, license_scan.scan, neardup.near_duplicates, fill_middle.fill_middle, overlaps])
def test_one_row_each_with_null_ids_and_clashes(odd, operator):
    out = operator(odd)
    assert sorted((r.doc_id is None, r.doc_id or 0) for r in out.select("doc_id").collect()) == sorted((i is None, i or 0) for i in IDS + IDS[:2])


def test_packing_null_ids(odd):
    ids = {r.doc_id for r in packing.pack(odd, public_byte_bpe).select("doc_id").distinct().collect()}
    assert ids == set(IDS)


def test_long_text_is_read_whole(odd):
    """The item's thousand words stand at the end of a text of 200,000."""
    found = overlaps(odd).where("size(spans) > 0").collect()
    assert [[(s.start, s.end) for s in r.spans] for r in found] == [[(199_000, 200_000)]]


def test_phrases_of_odd_documents(odd):
    got = {(r.lang, r.phrase): r.a for r in phrases.collocations(odd).collect()}
    assert got["en", "a b c d"] == 400 and got["en", "j a b c"] == 399 and all(len(p.split()) == 4 for _, p in got)
