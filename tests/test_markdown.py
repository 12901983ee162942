"""Chunks and pages against plain Python, over random markdown and stated cases."""

import random

import pytest
from pyspark.sql import functions as F

from lectern.operators import blocks as B
from lectern.operators import pages as P

from . import plain_markdown as plain

CJK = "管理制度规定了每个部门的职责。"


def table(rows, columns=3, seed=0):
    rng = random.Random(seed)
    head = "| " + " | ".join(f"c{j}" for j in range(columns)) + " |\n|" + " --- |" * columns
    return "\n".join([head, *("| " + " | ".join([f"g{i * 4 // max(1, rows)}", str(rng.randrange(900)), f"x\\|{i}"][:columns]) + " |" for i in range(rows))])


def random_markdown(seed):
    rng, out = random.Random(seed), []
    for _ in range(rng.randrange(1, 30)):
        n = rng.randrange(1, 60)
        out.append(
            rng.choice(
                [
                    lambda: "#" * rng.randrange(1, 5) + f" Head {rng.randrange(9)}  ",
                    lambda: " ".join(rng.choice(["word", "and", "stop!", "why?", "😀", CJK]) for _ in range(n * 3)),
                    lambda: "\n".join(f"line {i} of some prose!" for i in range(n // 6 + 1)),
                    lambda: rng.choice(["```", "~~~"]) + "py\n# no heading\n~~~ \n" * rng.randrange(3) + "\n" + rng.choice(["```", "~~~", ""]),
                    lambda: table(rng.randrange(0, 30), 3, seed),
                    lambda: "| only | header |",
                    lambda: "  \n\t",
                    lambda: "#nospace\n　",
                ]
            )()
        )
    return rng.choice(["\n", "\n\n", "\r\n"]).join(out)


SALES = "# sales\n\n| region | product | units | revenue |\n| --- | --- | --- | --- |\n" + "\n".join(f"| {r} | p{i} | {u} | {u * 10} |" for i, (r, u) in enumerate(zip(["APAC"] * 3 + ["EMEA"] * 2 + ["AMER"], [120, 90, 45, 200, 30, 310])))
CASES = [
    "", " \n ", "no heading at all", SALES, "# T\n\n" + table(3), "# T\n\n" + table(200), table(60, 2), "| a | b |\n| --- | --- |", "```\nopen fence\n# no\n~~~\n",
    "# 标题\n## 小节\n" + CJK * 40, "# T\n" + "x" * 9000, "# A\n\n" + "word. " * 900 + "\n\n# B\n\nshort!", "# A\npre\n\n" + table(20) + "\n\nafter " * 30,
    "pre\n# Doc\n## One\n" + "a b c! " * 200 + "\n## Two\n### Two a\n" + "d? " * 400 + "\n### Two b\n" + "e. " * 700 + "\n## 附录\n" + "f " * 2000 + "\n## 附录（续1）\nreal",
    "\n\n".join(f"## S{i}\n" + "\n".join(f"### S{i}.{j}\n" + CJK * (5 + i * j) for j in range(5)) for i in range(8)),
]
TEXTS = CASES + [random_markdown(i) for i in range(120)]


@pytest.fixture(scope="module")
def docs(spark):
    return spark.createDataFrame(list(enumerate(TEXTS)) + [(9999, None)], "doc_id long, text string").repartition(4)


@pytest.mark.parametrize("options", [{}, {"target": 40, "most": 60, "overlap": 20}, {"target": 60, "most": 90, "row_mode": True}, {"row_mode": True, "summary": False, "overlap": 0, "target": 15, "most": 20}])
def test_chunks(docs, options):
    got = {}
    rows = B.chunk_markdown(docs, title=F.lit("Doc"), **options).orderBy("id", "chunk_index").collect()
    for r in rows:
        got.setdefault(r.id, []).append((r.content, r.chunk_type, r.heading_path, r.is_table_row))
        assert r.token_estimate == plain.estimate(r.content)
    for i, text in enumerate(TEXTS):
        assert got.get(i, []) == plain.chunks(text, "Doc", **options), (i, text)
    ids = {r.chunk_id for r in rows}
    assert len(ids) == len(rows) and all(r.prev_chunk_id in ids for r in rows if r.chunk_index) and all(r.prev_chunk_id is None for r in rows if not r.chunk_index)


@pytest.mark.parametrize("options", [{}, {"most": 300, "least": 0}, {"most": 120, "least": 60}])
def test_pages(docs, options):
    got = {}
    for r in P.paginate(docs, **options).orderBy("id", "page_index").collect():
        got.setdefault(r.id, []).append((r.title, r.content, r.heading_path, r.continued))
        assert r.page_index == len(got[r.id])
    for i, text in enumerate(TEXTS):
        assert got.get(i, []) == plain.pages(text, P.shrink, **options), (i, text)
        assert len({p[0] for p in got.get(i, []) if p[3]}) == sum(p[3] for p in got.get(i, []))


def test_headings_and_cuts(docs):
    want = set()
    for i, text in enumerate(TEXTS):
        at, fence = 0, None
        for at, line in enumerate(text.replace("\r\n", "\n").split("\n")):
            if mark := plain.FENCE.match(line):
                fence = None if fence == mark[1] else fence or mark[1]
            elif fence is None and (head := plain.HEADING.match(line)):
                want.add((i, at, len(head[1]), head[2]))
    found = B.headings(docs)
    assert {tuple(r) for r in found.collect()} == want
    cut = {}
    for r in P.cut_pages(B.lines_of(docs, "doc_id", "text"), found).collect():
        cut.setdefault(r.id, set()).add((r.title, r.content))
    for i, text in enumerate(TEXTS):
        assert cut.get(i, set()) == {(t, c.replace("\r\n", "\n")) for t, c, *_ in plain.pages(text, lambda body, *_: [body], least=0)}, (i, text)


def test_shrink():
    lines = table(300).split("\n")
    parts = P.shrink("\n".join(lines), 500, 1)
    assert all(p.startswith("\n".join(lines[:2])) for p in parts) and [x for p in parts for x in p.split("\n")[2:]] == lines[2:]
    assert all(plain.estimate(p) <= 200 for p in P.shrink("L" * 500 + "\n" + table(20, 2), 150, 1))
    assert all(plain.estimate(p) <= 150 for p in P.shrink("汉" * 1000, 100, 1))
    assert "".join(P.shrink("ab😀c" * 500, 200, 1)) == "ab😀c" * 500
    assert len(P.shrink("x y. " * 400, 300, 1)) > 1 and P.shrink("short", 300, 1) == ["short"]
    sections = P.shrink("## T\n" + "\n".join(f"### {i}\n" + "w " * 300 for i in range(9)), 800, 2)
    assert len(sections) <= 3 and all(plain.estimate(s) > 100 for s in sections)


def test_large_table(spark):
    rows = "\n".join(f"| A{i} | c{i % 5} | {i} |" for i in range(150_000))
    docs = spark.createDataFrame([(1, "| m | c | n |\n| --- | --- | --- |\n" + rows)], "doc_id long, text string")
    out = B.chunk_markdown(docs, row_mode=True).collect()
    assert sum(r.content.count("\n| A") for r in out) == 150_000
