"""A table of documents' rows in which a document is replaced whole, or not at all.

Rows of a replaced document go to a new folder; a manifest (:mod:`lectern.sources.versions`) makes it part of the table, in the same
moment as it puts the document's older rows out of it. A writer that fails before that has changed nothing.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .versions import Versions


class DocumentRows:
    """Rows keyed by document at ``root``: pages, say, with their document's id in ``key``."""

    def __init__(self, spark: SparkSession, root: str, key: str = "doc_id"):
        self.spark, self.key, self.versions = spark, key, Versions(spark, root)

    def read(self, version: int | None = None) -> DataFrame | None:
        """The rows as of a version, the last unless one is named; none before the first."""
        state = self.versions.latest()[1] if version is None else self.versions.state(version)
        return self._rows(state["parts"]) if state else None

    def _rows(self, parts: list[dict]) -> DataFrame:
        """Of each document the rows of the last part that names it."""
        named = reduce(DataFrame.unionByName, [self.spark.read.parquet(f"{p['path']}/documents").withColumn("__part", F.lit(i)) for i, p in enumerate(parts)])
        last = named.groupBy(self.key).agg(F.max("__part").alias("__part"))
        rows = reduce(DataFrame.unionByName, [self.spark.read.parquet(f"{p['path']}/rows").withColumn("__part", F.lit(i)) for i, p in enumerate(parts)])
        return rows.join(last, [self.key, "__part"], "left_semi").drop("__part") if len(parts) > 1 else rows.drop("__part")

    def _written(self, rows: DataFrame, documents: DataFrame) -> dict:
        path = self.versions.folder("part")
        rows.write.parquet(f"{path}/rows")
        documents.write.parquet(f"{path}/documents")
        return {"path": path}

    def replace(self, rows: DataFrame, doc_id: object | None = None) -> int:
        """Put ``rows`` in the place of what their document has. They must be of one document: ``doc_id``, if given, which may then
        have no row left. The new version's number; :class:`lectern.sources.versions.Conflict` if another writer came first."""
        ids = [r[0] for r in rows.select(self.key).distinct().limit(2).collect()]
        if len(ids) > 1 or (not ids and doc_id is None) or (ids and doc_id is not None and ids != [doc_id]) or None in ids:
            raise ValueError(f"rows of one document are needed, not of {ids}")
        kind = rows.schema[self.key].dataType.simpleString()
        return self._replaced(rows, self.spark.createDataFrame([(ids[0] if ids else doc_id,)], f"`{self.key}` {kind}"))

    def replace_all(self, rows: DataFrame) -> int:
        """Put ``rows`` in the place of what each of their documents has, all in one version."""
        return self._replaced(rows, rows.select(self.key).distinct())

    def _replaced(self, rows: DataFrame, documents: DataFrame) -> int:
        after, state = self.versions.latest()
        part = self._written(rows, documents)
        return self.versions.commit(after, {"parts": [*state.get("parts", []), part]})

    def compact(self) -> int:
        """One part in place of many; the rows stay as they are."""
        after, state = self.versions.latest()
        rows = self._rows(state["parts"])
        return self.versions.commit(after, {"parts": [self._written(rows, rows.select(self.key).distinct())]})
