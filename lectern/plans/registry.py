"""Registration of named queries with their SQL."""

from __future__ import annotations

import uuid
from collections.abc import Callable
from typing import TypeVar

from pyspark.sql import DataFrame, SparkSession

from ..operators import index as I
from ..operators import knowledge as K
from ..sources.versions import shared_dir

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
SQL: dict[str, str] = {}
#: Stored indexes and knowledge bases of this process, by session and by the files that they are made of.
STORED: dict[tuple, object] = {}
T = TypeVar("T")


class Tables:
    """The tables of one folder: ``t.orders`` reads orders.parquet."""

    def __init__(self, spark: SparkSession, folder: str):
        self.spark, self.folder = spark, folder

    def __getattr__(self, name: str) -> DataFrame:
        if name.startswith("_"):
            raise AttributeError(name)
        return self.spark.read.parquet(f"{self.folder}/{name}.parquet")

    def _once(self, kind: str, make: Callable[[str], T]) -> T:
        """What ``make`` stores in a folder of its own, made where this session has none of ``documents`` as it is."""
        path = self.spark._jvm.org.apache.hadoop.fs.Path(f"{self.folder}/documents.parquet")
        store = path.getFileSystem(self.spark._jsc.hadoopConfiguration())
        files = [path] if store.getFileStatus(path).isFile() else [f.getPath() for f in store.listStatus(path)]
        status = sorted((f.toString(), store.getFileStatus(f).getLen(), store.getFileStatus(f).getModificationTime()) for f in files)
        key = (kind, self.spark.sparkContext.applicationId, repr(status))
        if key not in STORED:
            STORED[key] = make(f"{shared_dir(self.spark)}/{kind}-{uuid.uuid4().hex}")
        return STORED[key]

    def index(self) -> I.Index:
        """The stored index of ``documents``."""
        return self._once("index", lambda root: I.build(self.documents, root))

    def knowledge(self) -> K.KnowledgeBase:
        """The stored chunks of ``documents`` and their index."""

        def make(root: str) -> K.KnowledgeBase:
            base = K.KnowledgeBase(self.spark, root)
            base.ingest(self.documents)
            return base

        return self._once("knowledge", make)


def query(sql: str | None = None) -> Callable:
    """Register a function of :class:`Tables` under its name, with DuckDB SQL that gives the same rows."""

    def register(f: Callable[[Tables], DataFrame]) -> Callable[[Tables], DataFrame]:
        QUERIES[f.__name__] = lambda spark, folder: f(Tables(spark, folder))
        if sql:
            SQL[f.__name__] = sql
        return f

    return register
