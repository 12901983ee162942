import hashlib
import re

import pytest
from pyspark.sql import functions as F

from lectern.llm import license_scan, queries, secret_scan

from .conftest import ODD

KEY = "A" * 16


def spans_of(text):
    text = text or ""
    found = []
    for place, (kind, pattern, group, least) in enumerate(
        [
            ("assign", r"""(?i)(password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", 2, 12),
            ("access", r"AKIA[A-Z0-9]+", 0, 18),
            ("hex", r"[0-9a-f]+", 0, 16),
        ]
    ):
        found += [(m.start(), place, kind, m.end()) for m in re.finditer(pattern, text, re.ASCII) if len(m[group]) >= least]
    return [f"{k}:{a}:{z}" for a, _, k, z in sorted(found)]


SECRETS = [
    "password = 'abcdefghijklmnop' and token: short",
    "😀😀 token=token: abcdefghijklmnop",
    "API_KEY=0123456789abcdef0123 apikey:\"zzzzzzzzzzzz\"",
    "AKIA" + "B" * 14 + " AKIA" + "B" * 13 + " xAKIAAKIA" + "C" * 20,
    "deadbeefdeadbeef DEADBEEFDEADBEEF 0123456789abcdefg 0123456789abcde",
    "Passwd  =  aaaaaaaaaaaaaaa=secret:bbbbbbbbbbbbbbbb" * 3,
    "ghp_" + "a1B2" * 9 + " xoxb-12345678901 AIza" + "x" * 35,
    "x" * 50_000 + " secret: 0123456789abcdef",
]


def test_secret_spans_equal_brute_force(docs, sample):
    texts = SECRETS + ODD + [r.text for r in sample.collect()]
    out = {r.doc_id: r for r in secret_scan.scan(docs(texts)).select("doc_id", secret_scan.listed(F.col("base")).alias("base"), secret_scan.listed(F.col("spans")).alias("spans")).collect()}
    assert len(out) == len(texts)
    for i, text in enumerate(texts):
        assert out[i].base == ",".join(spans_of(text)), text
        more = [f"{k}:{a}:{z}" for rule in secret_scan.MORE for k, a, z in secret_scan.matches_in(text or "", rule)]
        assert sorted(out[i].spans.split(",")) == sorted(x for x in (spans_of(text) + more or [""]))


@pytest.mark.parametrize("count", [255, 256, 257, 30_000])
def test_many_secrets_in_one_text(docs, count):
    """Runs of matches meet without a gap, and the time of a text grows as its matches."""
    text = "".join(f"é secret={'k' * (i % 5 + 9)}{i:05d}\n{i:020x} " for i in range(count))
    row = secret_scan.scan(docs([text])).select(secret_scan.listed(F.col("base")).alias("base")).first()
    want = sorted((a, place, z) for place, rule in enumerate(secret_scan.BASE) for _, a, z in secret_scan.matches_in(text, rule))
    assert row.base.split(",") == [f"{secret_scan.BASE[place].kind}:{a}:{z}" for a, place, z in want] and len(want) == 2 * count


def test_secret_query_counts(spark, docs, tmp_path):
    docs(SECRETS).withColumn("key", F.lit(1)).write.parquet(str(tmp_path / "documents.parquet"))
    for r in queries.op6_secrets(spark, str(tmp_path)).collect():
        listed = spans_of(SECRETS[r.doc_id])
        assert (r.n_assign, r.n_access, r.n_hex) == tuple(sum(x.startswith(k) for x in listed) for k in ("assign", "access", "hex"))
        assert r.base_sha256 == hashlib.sha256(",".join(listed).encode()).hexdigest()


def test_trigram_queries():
    assert secret_scan.trigram_queries(r"[0-9a-f]+") == []
    assert secret_scan.trigram_queries(r"AKIA[A-Z]+") == [frozenset([frozenset(["aki", "kia"])])]
    assert secret_scan.trigram_queries(r"(abcd|xyz)?q*") == []
    assert secret_scan.trigram_queries(r"(abc|xyz)\d") == [frozenset([frozenset(["abc"]), frozenset(["xyz"])])]


LICENSES = [
    "Licensed under CC BY-NC 4.0.",
    "x\nThis work is licensed under the GNU General Public License, version 3.",
    "All rights reserved. All Rights  Reserved! cc by cc-by",
    "Released under the MIT License.",
    "the mit and the license are apart",
    "Licensed under the Apache License, Version 2.0.",
    "cc byte all rights reservedly general publicé license",
]


def words_of(text):
    return re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", re.sub("[A-Z]", lambda m: m[0].lower(), text or ""))


def test_license_places_equal_brute_force(docs, sample):
    texts = LICENSES + ODD + [r.text for r in sample.collect()]
    out = {r.doc_id: r for r in license_scan.scan(docs(texts)).collect()}
    assert len(out) == len(texts)
    for i, text in enumerate(texts):
        words, places, labels = words_of(text), [], set()
        for phrase, label in license_scan.PHRASES.items():
            p = phrase.split()
            at = [k for k in range(len(words)) if words[k : k + len(p)] == p]
            places += at
            labels |= {label} if at else set()
        r = out[i]
        assert (r.n_words, r.n_base) == (len(words), len(places)), text
        assert (r.first_word, r.last_word) == ((min(places), max(places)) if places else (None, None))
        assert r.base_labels == sorted(labels) and set(r.base_labels) <= set(r.labels)
        assert 0 <= r.score <= 1


def test_license_templates(docs):
    out = {r.doc_id: r.labels for r in license_scan.scan(docs(LICENSES)).collect()}
    assert "cc-by-nc" in out[0] and "gpl" in out[1] and out[3] == ["mit"] and out[4] == [] and out[5] == ["apache-2.0"] and out[6] == []


def test_empty_table_and_clashing_columns(docs):
    none = docs([]).selectExpr("*", "1 AS key", "2 AS kinds", "3 AS words", "4 AS seen")
    assert secret_scan.scan(none).count() == 0
    assert license_scan.scan(none).count() == 0
