"""Where results go: tables as Parquet, and stores behind a call per row."""

from __future__ import annotations

import time
import uuid
from collections.abc import Callable, Iterator

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def append(rows: DataFrame, path: str) -> None:
    """Add rows to the table at ``path``; it is made if it isn't there."""
    rows.write.mode("append").parquet(path)


def truncate(spark: SparkSession, *paths: str) -> None:
    """Empty the tables at ``paths``, those that refer to others first; their columns stay."""
    for path in paths:
        spark.createDataFrame([], spark.read.parquet(path).schema).write.mode("overwrite").parquet(path)


def push(rows: DataFrame, client: Callable[[], Callable[[dict], None]], *, tries: int = 3, wait: float = 0.2) -> DataFrame:
    """(doc_id, place, error) of rows (doc_id, place, content) sent to an outer store; ``error`` is null where it went through.

    ``client`` makes, once per task, the function that sends a row and raises where that fails; a row is tried ``tries`` times, with
    growing waits. A failure of one row doesn't keep others from being sent. Partitions are sent side by side; repartition to bound
    how many. A task that Spark repeats sends its rows again, so the store must take a row twice.
    """

    def batches(parts: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        send = client()
        for part in parts:
            yield part[["doc_id", "place"]].assign(error=[_sent(send, row, tries, wait) for row in part.to_dict("records")])

    return rows.select("doc_id", "place", "content").mapInPandas(batches, "doc_id long, place long, error string")


def _sent(send: Callable[[dict], None], row: dict, tries: int, wait: float) -> str | None:
    error = None
    for turn in range(tries):
        try:
            send(row)
            return None
        except Exception as e:  # whatever the store raises is this row's outcome
            error = str(e) or type(e).__name__
        if turn + 1 < tries:
            time.sleep(wait * 2**turn)
    return error


class Refused(Exception):
    """A store's answer that isn't a success, with its HTTP status."""

    def __init__(self, status: int, text: str = ""):
        super().__init__(f"HTTP {status} {text}".strip())
        self.status = status


# Client errors that may pass if tried again.
PASSING = (408, 425, 429)


def passing(error: Exception) -> bool:
    """Whether an error may go away: all but a client error of another kind."""
    status = getattr(error, "status", None)
    return status is None or not 400 <= status < 500 or status in PASSING


class Caller:
    """A store's calls with retries: passing errors are tried ``tries`` times more, with growing waits; where the store says that the
    login has run out, once more after ``refresh``."""

    def __init__(self, store: object, tries: int, wait: float):
        self.store, self.tries, self.wait = store, tries, wait

    def call(self, name: str, *args: object) -> object:
        refreshed = False
        turn = 0
        while True:
            try:
                return getattr(self.store, name)(*args)
            except Exception as e:  # whatever the store raises
                if getattr(e, "status", None) == 401 and not refreshed:
                    refreshed = True
                    self.store.refresh()
                    continue
                if not passing(e) or turn >= self.tries:
                    raise
                turn += 1
                time.sleep(self.wait * turn)

    def outcome(self, name: str, *args: object) -> tuple[str | None, str | None]:
        """(id, error) of a call that makes something; an answer without an id is an error."""
        try:
            made = self.call(name, *args)
            return (None, "no id in the answer") if made is None else (str(made), None)
        except Exception as e:
            return None, str(e) or type(e).__name__


def push_documents(rows: DataFrame, store: Callable[[], object], ledger: str, *, tries: int = 3, wait: float = 0.3) -> DataFrame:
    """Make each document of rows (doc_id, place, content) in an outer store, whole or not at all: (doc_id, place, remote_id, error,
    rolled_back), one row per paragraph, kept under ``ledger``.

    ``store()`` makes, once per task, an object with ``create(doc_id)`` and ``add(remote_id, content)``, which return ids,
    ``delete(remote_id)`` and ``refresh()``. Three steps, each of which writes what it did before the next begins:

    1. documents that the ledger doesn't have as done are created;
    2. their paragraphs are sent, partition by partition side by side; a paragraph that fails for good keeps no other from being sent;
    3. documents of which a paragraph failed are deleted again; where that fails too, ``rolled_back`` is false: they are left over.

    Run again with the same ledger, it sends what isn't done. A task that Spark repeats may have created a document twice; the ledger
    names the one that was filled.
    """
    spark = rows.sparkSession
    path = spark._jvm.org.apache.hadoop.fs.Path(f"{ledger}/done")
    exists = path.getFileSystem(spark._jsc.hadoopConfiguration()).exists(path)
    run = f"{ledger}/run-{uuid.uuid4().hex}"
    todo = rows.select("doc_id", "place", "content")
    kind = rows.schema["doc_id"].dataType.simpleString()
    if exists:
        done = spark.read.parquet(f"{ledger}/done")
        done = done.groupBy("doc_id").agg(F.count("error").alias("failed")).where("failed = 0")
        todo = todo.join(done, "doc_id", "left_anti")

    def created(parts: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        calls = Caller(store(), tries, wait)
        for part in parts:
            out = [calls.outcome("create", i) for i in part["doc_id"]]
            yield part.assign(remote_id=[i for i, _ in out], failure=[e for _, e in out])

    def sent(parts: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        calls = Caller(store(), tries, wait)
        for part in parts:
            errors = [f if f else calls.outcome("add", i, c)[1] for i, c, f in zip(part["remote_id"], part["content"], part["failure"], strict=True)]
            yield part[["doc_id", "place", "remote_id"]].assign(error=errors)

    def deleted(parts: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        calls = Caller(store(), tries, wait)
        for part in parts:
            yield part[["doc_id"]].assign(rolled_back=[_went(calls, i) for i in part["remote_id"]])

    def written(df: DataFrame, name: str) -> DataFrame:
        df.write.parquet(f"{run}/{name}")
        return spark.read.schema(df.schema).parquet(f"{run}/{name}")

    documents = written(todo.select("doc_id").distinct().mapInPandas(created, f"doc_id {kind}, remote_id string, failure string"), "documents")
    paragraphs = written(todo.join(documents, "doc_id").mapInPandas(sent, f"doc_id {kind}, place long, remote_id string, error string"), "paragraphs")
    failed = paragraphs.where("error IS NOT NULL AND remote_id IS NOT NULL").select("doc_id", "remote_id").distinct()
    back = written(failed.mapInPandas(deleted, f"doc_id {kind}, rolled_back boolean"), "deleted")
    out = paragraphs.join(back, "doc_id", "left").select("doc_id", "place", "remote_id", "error", "rolled_back")
    out.write.mode("append").parquet(f"{ledger}/done")
    return spark.read.schema(out.schema).parquet(f"{ledger}/done")


def _went(calls: Caller, remote_id: str) -> bool:
    try:
        calls.call("delete", remote_id)
    except Exception:  # the document is left over, and the ledger says so
        return False
    return True
