import pytest

from lectern.llm import line_dedup

from .conftest import ODD


def brute(texts, min_words):
    """Line numbers that go: those in a run of ``min_words`` words or more whose lines stand, in order, at an earlier place."""
    seqs = [[(k, l.strip(" \t\r\x0b\f")) for k, l in enumerate((t or "").split("\n")) if l.split()] for t in texts]
    first, gone = {}, [set() for _ in texts]
    for d, seq in enumerate(seqs):
        for a in range(len(seq)):
            for z in range(a + 1, min(len(seq), a + min_words) + 1):
                run = tuple(l for _, l in seq[a:z])
                if sum(len(l.split()) for l in run) < min_words:
                    continue
                if first.setdefault(run, (d, a)) != (d, a):
                    gone[d] |= {k for k, _ in seq[a:z]}
    return gone


SHORT = "one two\nthree four\nfive six\nseven eight nine"
CASES = [
    "a b c d e f g h\nunique line here\n" + SHORT,
    SHORT,
    "x\n" + SHORT + "\n\n \ny",
    "three four\none two\nfive six\n" + "three four\n\nfive six",
    "a b c d e f g h\nother",
    " a b c d e f g h \n" * 5,
    "\n".join(f"l{i % 3}" for i in range(40)),
    "\n".join(f"l{i % 3}" for i in range(41)),
]


@pytest.mark.parametrize("min_words", [1, 4, 8, 30])
def test_equal_to_brute_force(docs, sample, min_words):
    texts = CASES + ODD + [r.text for r in sample.limit(60).collect()]
    frame = docs(texts)
    rows = {r.doc_id: r for r in line_dedup.dedup_lines(frame, min_words=min_words).collect()}
    assert len(rows) == len(texts)
    for i, gone in enumerate(brute(texts, min_words)):
        assert set(rows[i].deleted_lines) == gone, (i, texts[i])
        left = None if texts[i] is None else "\n".join(l for k, l in enumerate(texts[i].split("\n")) if k not in gone)
        assert rows[i].text == left


def test_ranks_are_in_order(docs):
    lines, levels = line_dedup.ranked_lines(docs(CASES), min_words=8)
    rows = lines.collect()
    at = {(r.doc.id, r.at): r for r in rows}
    for level in range(1, levels):
        ranked = sorted((r.ranks[level - 1], at[r.doc.id, r.at + (1 << level - 1)].ranks[level - 1], r.ranks[level]) for r in rows if r.ranks[level])
        assert [r[2] for r in ranked] == sorted(r[2] for r in ranked)


def test_odd_tables(docs):
    assert line_dedup.dedup_lines(docs([]).selectExpr("*", "1 AS doc", "2 AS at", "3 AS line")).count() == 0
    frame = docs(["a b c d", "a b c d", "a b c d"], ids=[1, 1, None])
    assert sorted((str(r.doc_id), r.text) for r in line_dedup.dedup_lines(frame, min_words=3).collect()) == [("1", ""), ("1", ""), ("None", "a b c d")]
