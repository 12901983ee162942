"""Continuous ingestion with Structured Streaming: files of documents become chunks; late submissions merge."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from ..operators.blocks import chunk_markdown

DOCS = "doc_id long, text string"
#: Folders of an epoch by the document's hash: a batch looks up what is known in those of its own documents.
BUCKETS = 64


def _epochs(spark: SparkSession, chunks: str) -> list[int]:
    """Epochs that have written to ``chunks``."""
    path = spark._jvm.org.apache.hadoop.fs.Path(chunks)
    store = path.getFileSystem(spark._jsc.hadoopConfiguration())
    names = [f.getPath().getName() for f in store.listStatus(path)] if store.exists(path) else []
    return sorted(int(n.removeprefix("epoch=")) for n in names if n.startswith("epoch="))


def append(batch: DataFrame, epoch: int, chunks: str) -> None:
    """Write the chunks of a batch that no other epoch has written. An epoch that runs again, after its files were written and before
    its commit was, replaces its own output: that doesn't count as known, or it would take itself for done and write nothing."""
    spark = batch.sparkSession
    made = chunk_markdown(batch).withColumn("bucket", F.pmod(F.xxhash64("id"), F.lit(BUCKETS)).cast("int"))
    others = [f"{chunks}/epoch={n}" for n in _epochs(spark, chunks) if n != epoch]
    if others:
        asked = [r.bucket for r in made.select("bucket").distinct().collect()]  # BUCKETS numbers at most
        known = spark.read.schema("chunk_id string, bucket int").option("basePath", chunks).parquet(*others)
        made = made.join(known.where(F.col("bucket").isin(asked)).select("chunk_id"), "chunk_id", "left_anti")
    made.write.mode("overwrite").partitionBy("bucket").parquet(f"{chunks}/epoch={epoch}")


def ingest(spark: SparkSession, source: str, chunks: str, checkpoint: str, *, once: bool = True) -> StreamingQuery:
    """Chunk each new Parquet file of documents under ``source`` and append those chunks that ``chunks`` lacks."""
    stream = spark.readStream.schema(DOCS).parquet(source)
    writer = stream.writeStream.foreachBatch(lambda batch, epoch: append(batch, epoch, chunks)).option("checkpointLocation", checkpoint)
    return (writer.trigger(availableNow=True) if once else writer).start()


def merged_submissions(events: DataFrame, *, late: str = "1 hour", key: tuple[str, ...] = ("user_id", "event_type")) -> DataFrame:
    """Submissions (ts, key, value) merged per key and window of ``late``: how many, and the last value, once the window closes."""
    windowed = events.withWatermark("ts", late).groupBy(F.window("ts", late), *key)
    return windowed.agg(F.count("*").alias("n"), F.max_by("value", "ts").alias("value"))
