"""Retrieval quality and run analytics."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions import text as T


def span_hits(cases: DataFrame, hits: DataFrame) -> DataFrame:
    """(case_id, span, found): whether any hit of a case holds each of its spans. cases (case_id, spans), hits (case_id, content)."""
    spans = cases.select("case_id", F.explode("spans").alias("span"))
    hits = hits.withColumn("content", T.normalise(F.col("content")))  # once per hit, not once per span
    met = spans.join(hits, "case_id", "left").select("case_id", "span", F.coalesce(T.covers(F.col("content"), F.col("span")), F.lit(False)).alias("found"))
    return met.groupBy("case_id", "span").agg(F.bool_or("found").alias("found"))


def case_report(found: DataFrame) -> DataFrame:
    """(case_id, passed, n_hit, n_total, missing)"""
    return found.groupBy("case_id").agg(
        F.bool_and("found").alias("passed"),
        F.count_if("found").alias("n_hit"),
        F.count("*").alias("n_total"),
        F.sort_array(F.collect_list(F.when(~F.col("found"), F.col("span")))).alias("missing"),
    )


def coverage(report: DataFrame) -> DataFrame:
    """One row: share of cases passed and of spans found, 0 where there are none."""
    return report.agg(
        F.count("*").alias("n_cases"),
        F.coalesce(F.avg(F.col("passed").cast("int")), F.lit(0.0)).alias("coverage"),
        F.coalesce(F.sum("n_hit") / F.sum("n_total"), F.lit(0.0)).alias("span_coverage"),
    )


def arm_summary(runs: DataFrame, arms: dict[str, tuple[str, str]], verdict: str) -> DataFrame:
    """Per verdict: runs, and for each arm (tokens, latency) the sum and the mean."""
    parts = [x for name, (tokens, ms) in arms.items() for x in (F.sum(tokens).alias(f"{name}_tokens"), F.avg(ms).alias(f"{name}_ms"))]
    return runs.groupBy(verdict).agg(F.count("*").alias("n_runs"), *parts)
