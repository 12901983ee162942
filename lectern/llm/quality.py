"""Quality classifier: histogram gradient-boosted trees over statistics of the text.

The trees are grown on at most ``MOST_TRAINING`` labelled documents, the first by hash of their ids; held-out documents (crc32 of
the id modulo 5 is 0) never train. Every document is scored where it lies, in Arrow batches, by traversing the flattened trees.
A score looks at the text alone.

Defined cases: null and empty texts have all statistics 0 and are scored as such; documents without a label, or with a null
label, don't train, and a document with several labels trains with each; a null id is held out; repeated rows train once and
score alike; an empty table or no label gives the same score to all; texts of any length are read whole; other columns are left alone.
"""

from __future__ import annotations

import re
from collections import Counter
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .boosting import Forest, grow
from .common import held_out

#: Most labelled documents that train.
MOST_TRAINING = 12_000
FEATURES = (
    "words", "characters", "word_length", "distinct_words", "top_word", "runs", "letters", "upper", "digits", "marks", "odd_marks",
    "upper_words", "title_words", "marked_words", "bars", "lines", "distinct_lines", "line_words", "sentences", "short_words", "long_words", "distinct_pairs",
)

_LETTER, _UPPER, _DIGIT = re.compile(r"[^\W\d_]+"), re.compile(r"[A-ZÀ-ÖØ-Þ]+"), re.compile(r"\d+")
_MARK, _ODD = re.compile(r"[^\w\s]+"), re.compile(r"[^\w\s.,;:!?'\"()-]+")


def statistics(text: str | None) -> list[float]:
    """The ``FEATURES`` of a text."""
    text = text or ""
    words = text.split()
    if not words:
        return [0.0] * len(FEATURES)
    n, size = len(words), len(text)
    lengths = list(map(len, words))
    counts = Counter(words)
    lines = text.split("\n")
    held = [sum(map(len, p.findall(text))) for p in (_LETTER, _UPPER, _DIGIT, _MARK, _ODD)]
    repeats = sum(map(str.__eq__, words, words[1:]))
    return [
        float(n), float(size), sum(lengths) / n, len(counts) / n, max(counts.values()) / n, repeats / n, *[h / size for h in held],
        sum(map(str.isupper, words)) / n, sum(map(str.istitle, words)) / n, sum(not w[-1].isalnum() for w in words) / n, text.count("|") / n,
        float(len(lines)), len(set(lines)) / len(lines), n / len(lines), text.count(". ") / n, sum(x < 3 for x in lengths) / n, sum(x > 14 for x in lengths) / n,
        len(set(zip(words, words[1:], strict=False))) / n,
    ]


def table(texts: list[str | None]) -> np.ndarray:
    return np.array([statistics(t) for t in texts]).reshape(len(texts), len(FEATURES))


def training_rows(docs: DataFrame, labels: DataFrame, label: str, id_col: str, text_col: str, most: int) -> DataFrame:
    """At most ``most`` labels that aren't held out, the first by hash of their ids, with their documents: (id, text, label). Rows that
    repeat id, text and label are one; an id with several texts has a row for each."""
    marked = labels.select(F.col("doc_id").alias("__id"), F.col(label).cast("int").alias("__label")).where(F.col("__label").isNotNull() & ~held_out(F.col("doc_id")))
    chosen = marked.orderBy(F.xxhash64("__id"), "__id", "__label").limit(most)
    joined = docs.select(F.col(id_col).alias("__doc"), F.col(text_col).cast("string").alias("text")).join(F.broadcast(chosen), F.col("__doc") == F.col("__id"))
    return joined.select(F.col("__id").alias("id"), "text", F.col("__label").alias("label")).distinct()


def training_table(rows: DataFrame, describe: Callable[[list[str | None]], np.ndarray], width: int, most: int) -> tuple[np.ndarray, np.ndarray]:
    """(x, y) of at most ``most`` training rows, the first by hash of their ids, described by the executors: what comes to the driver is
    numbers, however long the texts."""

    def batches(parts: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part in parts:
            x = describe(part.column(0).to_pylist())
            yield pa.RecordBatch.from_arrays([pa.array(list(x), pa.list_(pa.float64())), *part.columns[1:]], ["x", "label", "key", "id"])

    keyed = rows.select("text", "label", F.xxhash64("id").alias("key"), F.col("id").cast("string").alias("id"))
    got = keyed.mapInArrow(batches, "x array<double>, label int, key long, id string").orderBy("key", "id", "x", "label").limit(most).toArrow()
    x = np.array(got.column("x").to_pylist(), float).reshape(got.num_rows, width)
    return x, np.array(got.column("label").to_pylist(), float)


def scored(docs: DataFrame, score: Callable[[list[str | None]], np.ndarray], *, id_col: str, text_col: str, threshold: float, batch: int = 256) -> DataFrame:
    """(doc_id, held_out, score, predicted) of every document, in Arrow batches where the rows lie."""

    def batches(parts: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part in parts:
            for at in range(0, len(part), batch):
                piece = part.slice(at, batch)
                values = score(piece.column(2).to_pylist())
                yield pa.RecordBatch.from_arrays(
                    [piece.column(0), piece.column(1), pa.array(values, pa.float64()), pa.array(values >= threshold).cast(pa.int32())], ["doc_id", "held_out", "score", "predicted"]
                )

    slim = docs.select(F.col(id_col).cast("long").alias("doc_id"), held_out(F.col(id_col)).alias("held_out"), F.col(text_col).cast("string").alias("text"))
    return slim.mapInArrow(batches, "doc_id long, held_out boolean, score double, predicted int")


def fit(docs: DataFrame, labels: DataFrame, *, id_col: str = "doc_id", text_col: str = "text", label: str = "quality", most: int = MOST_TRAINING) -> Forest:
    rows = training_rows(docs, labels, label, id_col, text_col, most)
    return grow(*training_table(rows, table, len(FEATURES), most))


def classify(docs: DataFrame, labels: DataFrame, *, id_col: str = "doc_id", text_col: str = "text", threshold: float = 0.3) -> DataFrame:
    """(doc_id, held_out, score, predicted) for every document."""
    forest = fit(docs, labels, id_col=id_col, text_col=text_col)
    return scored(docs, lambda texts: forest.scores(table(texts)), id_col=id_col, text_col=text_col, threshold=threshold)
