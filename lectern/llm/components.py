"""Connected components of a link table, by alternating large and small stars."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import discard, materialise


def _starred(links: DataFrame, large: bool) -> DataFrame:
    """One half round over links (u, v) with u > v: neighbours are hung under the least of each neighbourhood."""
    sides = links.unionByName(links.select(F.col("v").alias("u"), F.col("u").alias("v"))) if large else links
    least = sides.groupBy("u").agg(F.min("v").alias("m")).withColumn("m", F.least("u", "m"))
    # apart from the join, so that Spark may split the links of a hub
    least = materialise(least, "least-neighbours")
    met = sides.join(least, "u")
    if large:
        out = met.where("v > u").select(F.col("v").alias("u"), F.col("m").alias("v"))
    else:
        out = met.select(F.col("v").alias("u"), F.col("m").alias("v")).unionByName(least.select("u", F.col("m").alias("v")))
    return out.where("u > v").distinct()


def components(links: DataFrame, rounds: int = 60) -> DataFrame:
    """(node, root): for every node of ``links`` (a, b) that isn't its component's least node, that least node.

    Nodes may be of any ordered type. Each round is written to the shared folder and halves the depth of the trees at least. A hub's
    least neighbour is aggregated before the shuffle and written; its links join that one row from a table, where Spark splits them.
    Links to null and from a node to itself say nothing. No link gives no row.
    """
    now = links.where("a != b").select(F.greatest("a", "b").alias("u"), F.least("a", "b").alias("v")).distinct()
    now, before = materialise(now, "links"), None
    for _ in range(rounds):
        mark = now.agg(F.count("*"), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)"))).first()
        if mark == before:
            return now.select(F.col("u").alias("node"), F.col("v").alias("root"))
        before = mark
        then, now = now, materialise(_starred(_starred(now, True), False), "links")
        discard(then)
    raise RuntimeError(f"components have not settled in {rounds} rounds")
