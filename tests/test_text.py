"""Text functions by value: paragraphs to push, lines of printed pages, prompts, codes, estimates."""

import datetime
import random
import re

from pyspark.sql import functions as F

from lectern.functions import text as T
from lectern.operators import prompts as P
from lectern.plans import catalogue
from lectern.sources import files

from . import plain_markdown as plain
from .compare import connect, difference


def paragraphs(text, most):
    whole, out, now = text.strip(), [], ""
    if len(whole) <= most:
        return [whole] if whole else []
    for s in re.findall(r"[^。！？；\n.!?]*[。！？；\n.!?]+|[^。！？；\n.!?]+$", whole):
        if len(s) > most:
            out += [now, *(s[i : i + most] for i in range(0, len(s), most))]
            now = ""
        elif now and len(now) + len(s) > most:
            out.append(now)
            now = s
        else:
            now += s
    return [p.strip() for p in [*out, now] if p.strip()]


def random_text(rng):
    return "".join(rng.choice(["word ", "a. ", "第三条。", "why? ", "\n", "；", "😀", "x" * rng.randrange(40), " "]) for _ in range(rng.randrange(80)))


def test_paragraphs(spark):
    rng = random.Random(1)
    texts = ["", "  ", "short", "x" * 100, *(random_text(rng) for _ in range(150))]
    rows = spark.createDataFrame(list(enumerate(texts)), "i int, t string")
    got = {r.i: r.p for r in rows.select("i", T.paragraphs(F.col("t"), 30).alias("p")).collect()}
    for i, t in enumerate(texts):
        assert got[i] == paragraphs(t, 30), t
        assert all(len(p) <= 30 for p in got[i])


def test_estimates_and_packs(spark):
    rng = random.Random(2)
    texts = ["", "é" * 7, "😀" * 3, "汉a", "、，", "ﾊ", "x", *(random_text(rng) for _ in range(100))]
    rows = spark.createDataFrame(list(enumerate(texts)), "i int, t string")
    out = rows.select("i", T.estimate_tokens(F.col("t")).alias("n"), T.pack(T.sentences(F.col("t")), 12).alias("p")).collect()
    assert {r.i: r.n for r in out} == {i: plain.estimate(t) for i, t in enumerate(texts)}
    assert {r.i: r.p for r in out} == {i: plain.packed(plain.sentences(t), 12) for i, t in enumerate(texts)}


def test_lines_of_printed_pages(spark):
    rng = random.Random(3)
    pool = ["The first line of a paragraph runs on", "and on here.", "- a bullet stands apart", "1) numbered", "", "  ", "这是第一行文字没有句号也很长", "接着写。", "x", "short line", "ends with a colon:"]
    pages = {(d, p): [rng.choice(pool) for _ in range(rng.randrange(1, 25))] for d in range(6) for p in range(5)}
    rows = [(d, p, n, line) for (d, p), lines in pages.items() for n, line in enumerate(lines)]
    got = {}
    for r in files.merge_lines(spark.createDataFrame(rows, "doc int, page int, line_no int, line string").repartition(4), ["doc", "page"]).orderBy("paragraph").collect():
        got.setdefault((r.doc, r.page), []).append(r.text)
    assert got == {k: files.merge_visual_lines(v) for k, v in pages.items() if any(x.strip() for x in v)}


def test_codes(spark):
    now = datetime.datetime(2024, 1, 1, 12)
    rows = [
        ("ok", "1", now - datetime.timedelta(seconds=600), 0, "1"), ("expired", "1", now - datetime.timedelta(seconds=601), 0, "1"), ("wrong", "1", now, 4, "2"),
        ("expired", "1", now, 5, "1"), ("expired", None, None, None, "1"),
    ]
    frame = spark.createDataFrame(rows, "want string, code string, sent timestamp, attempts int, entered string").withColumn("now", F.lit(now))
    got = frame.select("want", P.check_code(F.sha2("code", 256), P.expires(F.col("sent")), F.col("attempts"), F.col("entered"), F.col("now")).alias("got"), P.in_cooldown(F.col("sent"), F.col("now")).alias("waits")).collect()
    assert all(r.got == r.want for r in got)
    assert [r.waits for r in got] == [False, False, True, True, None]
    at = spark.createDataFrame([(now - datetime.timedelta(seconds=s),) for s in (59, 60)], "sent timestamp")
    assert [r[0] for r in at.select(P.in_cooldown(F.col("sent"), F.lit(now))).collect()] == [True, False]


def test_page_text_is_cut_in_proportion(spark):
    rows = spark.createDataFrame([("x" * 400,), ("汉" * 50,), ("short",)], "t string")
    got = [r.p for r in rows.select(P.page_text(F.lit("D"), F.lit(3), F.lit("T"), F.col("t"), 20).alias("p")).collect()]
    assert got == ["【D 第3页 · T】\n" + "x" * 80 + "…", "【D 第3页 · T】\n" + "汉" * 20 + "…", "【D 第3页 · T】\nshort"]


def test_plain_text_of_odd_documents_equals_sql(spark, tmp_path):
    rng = random.Random(5)
    texts = [None, "", " ", "\r", "\t a\t", "a\r\nb", "a\rb", "\r\r\n", "\ufeff\ufeffa", "a \x85", "\u3000a ", "a\x0b"]
    texts += ["".join(rng.choice(["a", " ", "\n", "\r", "\r\n", "\t", "\ufeff", "\u2028"]) for _ in range(rng.randrange(12))) for _ in range(500)]
    spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string").toPandas().to_parquet(tmp_path / "documents.parquet")
    assert difference(catalogue.queries()["plain_text_load"](spark, str(tmp_path)), connect(str(tmp_path)), catalogue.oracle_sql()["plain_text_load"]) == ""


def test_plain_text_of_files(spark):
    rows = spark.createDataFrame([("\ufeff a\r\nb\rc\t\r\n",), (" \r\n\t",), (None,)], "t string")
    assert [r[0] for r in rows.select(files.plain_text(F.col("t"))).collect()] == ["a\nb\nc", None, None]
