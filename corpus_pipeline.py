"""A training corpus from ``documents`` in five stages, each over all that the one before it kept.

Defined cases, in every stage: a null id, a null, empty or very long text and a null in any other column keep their row, unless the
stage's own rule takes it; rows that share an id are told apart by their texts; columns beyond those of documents are dropped,
whatever their names; an empty table gives an empty one. Of rows alike in all columns near-dedup keeps one.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lectern.llm import line_dedup, mixing, neardup, packing, toxicity
from lectern.llm.common import materialise

COLUMNS = ("doc_id", "text", "lang", "source", "n_chars")


def drop_toxic(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the toxicity classifier doesn't reject."""
    return toxicity.without_toxic(docs, spark.read.parquet(f"{sf_dir}/labels.parquet")).select(*COLUMNS)


def dedup_lines(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents without the line runs that stand earlier in the corpus; those of which nothing is left go."""
    out = line_dedup.dedup_lines(docs)
    left = (F.size("deleted_lines") == 0) | F.rlike("text", F.lit(r"\S"))
    out = out.where(left).withColumn("n_chars", F.when(F.size("deleted_lines") > 0, F.length("text").cast("long")).otherwise(F.col("n_chars")))
    return out.select(*COLUMNS)


def dedup_near(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document, that with the least id, of each group of near-duplicates."""
    return neardup.one_of_each(docs).select(*COLUMNS)


def mix_sources(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents as often as the mix of sources takes them."""
    return mixing.mixed(docs).select(*COLUMNS)


def pack_windows(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Pieces of documents in windows of 1,024 tokens."""
    return packing.pack(docs, packing.public_byte_bpe)


STAGES = [("toxicity", drop_toxic), ("line_dedup", dedup_lines), ("simhash", dedup_near), ("mix", mix_sources), ("packing", pack_windows)]

#: The stages learn, iterate and tokenise, which SQL cannot express; tests hold each against a brute-force version.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over ``documents``; what each keeps is written to the shared folder and read again."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for name, stage in STAGES[:-1]:
        docs = materialise(stage(spark, docs, sf_dir), f"pipeline-{name}")
    return STAGES[-1][1](spark, docs, sf_dir)
