"""Predicates on memories and messages. All push below ranking; a request's filters are a conjunction."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def by_author(author: str) -> Column:
    return F.col("author") == author


def has_all_tags(tags: Sequence[str]) -> Column:
    """Every tag asked for is present; none asked for is true."""
    out = F.lit(True)
    for tag in tags:
        out = out & F.array_contains("tags", tag)
    return out


def in_window(since: str | None = None, until: str | None = None, column: str = "created_at") -> Column:
    """since is inclusive, until exclusive."""
    out = F.lit(True)
    if since is not None:
        out = out & (F.col(column) >= F.lit(since).cast("timestamp"))
    if until is not None:
        out = out & (F.col(column) < F.lit(until).cast("timestamp"))
    return out


def live(memories: DataFrame, *deleted: DataFrame) -> DataFrame:
    """Rows whose id is in none of the tables of deleted ids."""
    for ids in deleted:
        memories = memories.join(ids.select("id"), "id", "left_anti")
    return memories


def has_vector(dims: int, column: str = "embedding") -> Column:
    return F.col(column).isNotNull() & (F.size(column) == dims)


def not_blank(column: str = "text") -> Column:
    return F.coalesce(F.trim(F.regexp_replace(column, r"\s+", " ")) != "", F.lit(False))


def visible_to(did: str) -> Column:
    """Broadcast messages, those addressed to `did`, and its own."""
    return (F.size("to") == 0) | F.array_contains("to", did) | (F.col("author") == did)


def view_similarity(similarity: Column) -> Column:
    """Similarity as thousandths, clamped to 0..1 and truncated."""
    return F.floor(F.least(F.lit(1.0), F.greatest(F.lit(0.0), similarity)) * 1000.0).cast("int")
