"""All registered queries of the engine."""

from lodestone.catalog import evaluation, feeds, filters, heuristics, hybrid, keyword, store, vectors  # noqa: F401
from lodestone.catalog.registry import QUERIES, SQL

__all__ = ["QUERIES", "SQL"]
