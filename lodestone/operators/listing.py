"""Newest-first lists and keyset pages."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def newest_first(memories: DataFrame, limit: int) -> DataFrame:
    """One distributed top-k: created_at, author, rkey, all descending."""
    return memories.orderBy(F.desc("created_at"), F.desc("author"), F.desc("rkey")).limit(limit)


def before_key(created_us: int, author: str, rkey: str) -> Column:
    """Strictly after the cursor in newest-first order; the bound on created_at alone can prune files."""
    at = F.timestamp_micros(F.lit(created_us))
    c = F.col("created_at")
    return (c <= at) & ((c < at) | (F.col("author") < author) | ((F.col("author") == author) & (F.col("rkey") < rkey)))


def prepend(page: DataFrame, arrived: DataFrame, key: str) -> DataFrame:
    """A page with what has come since in front of it, each key once: `fresh` marks what the page lacked."""
    new = arrived.join(F.broadcast(page.select(key)), key, "left_anti").select(*page.columns)  # a page at most
    return new.withColumn("fresh", F.lit(True)).unionByName(page.withColumn("fresh", F.lit(False)))


def encode_cursor(created: Column, author: Column, rkey: Column) -> Column:
    return F.concat_ws("~", F.unix_micros(created).cast("string"), author, rkey)


def decode_cursor(cursor: str) -> tuple[int, str, str]:
    created, author, rkey = cursor.split("~", 2)
    return int(created), author, rkey


def after_message(created_s: int, uri: str) -> Column:
    """Messages run oldest first by (created, uri)."""
    return (F.col("created_s") > created_s) | ((F.col("created_s") == created_s) & (F.col("uri") > uri))
