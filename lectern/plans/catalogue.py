"""All named queries of the engine, without those of the training-data operators."""

from __future__ import annotations

from . import reading_queries, relational_queries, search_queries, structure_queries, text_queries  # noqa: F401  they register themselves
from .registry import QUERIES, SQL

FLAGSHIP = "rrf_hybrid"


def queries() -> dict:
    return dict(QUERIES)


def oracle_sql() -> dict[str, str]:
    return dict(SQL)
