"""The relational layer: counts per parent, scopes, upserts, cascades. Everything is set-based over whole frames."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def counts_per_parent(parents: DataFrame, key: str, children: dict[str, tuple[DataFrame, str]]) -> DataFrame:
    """``parents`` with one count per kind of children, 0 where there are none. Each kind is aggregated before it is joined, so
    kinds don't multiply each other."""
    out = parents
    for name, (rows, foreign) in children.items():
        counted = rows.groupBy(F.col(foreign).alias(key)).agg(F.count("*").alias(name))
        out = out.join(counted, key, "left").withColumn(name, F.coalesce(name, F.lit(0)))
    return out


def in_scope(rows: DataFrame, key: str, scope: DataFrame | None) -> DataFrame:
    """Rows whose key is in ``scope``; None is no restriction, an empty scope lets nothing through."""
    return rows if scope is None else rows.join(scope.select(F.col(scope.columns[0]).alias(key)).distinct(), key, "left_semi")


def clamp_ids(asked: Column, allowed: Column) -> Column:
    """The asked ids that are allowed, in their order, repeats kept; all that is allowed if none is asked."""
    return F.when(asked.isNull() | (F.size(asked) == 0), allowed).otherwise(F.filter(asked, lambda x: F.array_contains(allowed, x)))


def insert_ignore(target: DataFrame, rows: DataFrame, key: list[str], order: list[str]) -> DataFrame:
    """``target`` and those rows whose key it lacks; of rows that share a key the first in ``order``."""
    first = _first(rows, key, [F.col(c) for c in order])
    return target.unionByName(first.join(target, key, "left_anti"))


def upsert_latest(target: DataFrame, rows: DataFrame, key: list[str], order: list[str]) -> DataFrame:
    """``target`` with rows replaced by the last in ``order`` that shares their key."""
    last = _first(rows, key, [F.desc(c) for c in order])
    return target.join(last, key, "left_anti").unionByName(last)


def _first(rows: DataFrame, key: list[str], order: list[Column]) -> DataFrame:
    rank = F.row_number().over(Window.partitionBy(*key).orderBy(*order))
    return rows.withColumn("__rank", rank).where("__rank = 1").drop("__rank")


def upsert_coalesce(rows: DataFrame, key: list[str], order: list[str], first: list[str], last: list[str]) -> DataFrame:
    """Rows merged per key in arrival order: ``first`` columns keep the first arrival, ``last`` columns their last value that
    isn't null. Aggregated map-side, so a key with very many arrivals is never gathered."""
    at = F.struct(*order)
    kept = [F.min_by(c, at).alias(c) for c in first]
    merged = [F.max_by(c, F.when(F.col(c).isNotNull(), at)).alias(c) for c in last]
    return rows.groupBy(*key).agg(*kept, *merged)


def partial_update(target: DataFrame, changes: DataFrame, key: str, columns: list[str]) -> DataFrame:
    """``changes`` (key, values: map of column to text): columns named there are set, to null too; others keep their value."""
    rows = target.join(changes, key, "left")
    named = F.coalesce(F.map_keys("values"), F.array().cast("array<string>"))
    new = [F.when(F.array_contains(named, c), F.get(F.map_values(F.map_filter("values", _is(c))), F.lit(0)).cast(target.schema[c].dataType)).otherwise(F.col(c)).alias(c) for c in columns]
    return rows.select(*[c for c in target.columns if c not in columns], *new).select(*target.columns)


def update_where_exists(target: DataFrame, changes: DataFrame, allowed: DataFrame, key: str, owner: str, column: str) -> DataFrame:
    """``target`` with ``column`` set from ``changes`` (key, owner, column) where key and owner are those of the row, and the new value
    is null or in ``allowed`` (column, owner) for that owner. All else stays; of changes to one key the greatest value is taken."""
    pairs = allowed.select(column, owner).distinct()
    fits = changes.join(pairs, [column, owner], "left_semi").unionByName(changes.where(F.col(column).isNull()), allowMissingColumns=True)
    new = fits.groupBy(key, owner).agg(F.max(column).alias("__new")).withColumn("__set", F.lit(True))
    rows = target.join(new, [key, owner], "left")
    return rows.select(*[F.when(F.col("__set"), F.col("__new")).otherwise(F.col(c)).alias(c) if c == column else F.col(c) for c in target.columns])


def _is(name: str):
    return lambda k, v: k == name


def delete_cascade(parents: DataFrame, children: list[tuple[DataFrame, str]], gone: DataFrame, key: str) -> list[DataFrame]:
    """Parents and children without the keys in ``gone``."""
    ids = gone.select(key).distinct()
    return [parents.join(ids, key, "left_anti"), *[c.join(ids.withColumnRenamed(key, f), f, "left_anti") for c, f in children]]


def set_null(children: DataFrame, foreign: str, parents: DataFrame, key: str) -> DataFrame:
    """Children whose parent is gone point to null."""
    known = parents.select(F.col(key).alias("__known")).distinct()
    rows = children.join(known, F.col(foreign) == F.col("__known"), "left")
    return rows.select(*[F.col("__known").alias(foreign) if c == foreign else F.col(c) for c in children.columns])


def replace_documents(target: DataFrame, pages: DataFrame, key: str = "doc_id") -> DataFrame:
    """All rows of the documents in ``pages`` replaced by them."""
    return target.join(pages.select(key).distinct(), key, "left_anti").unionByName(pages)


def find_or_create(names: DataFrame, known: DataFrame, name: str, key: str, new_key: Column) -> DataFrame:
    """Each name with its known key, or ``new_key``."""
    rows = names.select(name).distinct().join(known.select(name, F.col(key).alias("__known")), name, "left")
    return rows.select(name, F.coalesce("__known", new_key).alias(key), F.col("__known").isNull().alias("created"))


def histogram(rows: DataFrame, column: str) -> DataFrame:
    return rows.groupBy(column).agg(F.count("*").alias("n"))


def recent_counts(rows: DataFrame, ts: str, now: Column, days: list[int]) -> DataFrame:
    """One row: how many rows fall in each of the last so many days before ``now``."""
    return rows.agg(*[F.count_if(F.col(ts) > now - F.expr(f"INTERVAL {d} DAYS")).alias(f"last_{d}d") for d in days])


def all_of(conditions: list[Column]) -> Column:
    return reduce(Column.__and__, conditions, F.lit(True))
