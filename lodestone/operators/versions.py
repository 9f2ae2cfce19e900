"""One version of each name: whose it is, then how new it is."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: Seconds that a writer's clock may be ahead.
AHEAD = 3600


def readable_time(text: Column, now: Column) -> Column:
    """The instant that a full date, time and zone name; null if it is none, no such day, or more than AHEAD after `now`."""
    whole = text.rlike(r"^\d{4}-\d{2}-\d{2}T\d{2}:\d{2}:\d{2}(\.\d+)?(Z|[+-]\d{2}:\d{2})$")
    at = F.when(whole, F.try_to_timestamp(text))
    return F.when(at <= now + F.make_dt_interval(secs=F.lit(AHEAD)), at)


def resolve(versions: DataFrame, me: str, authority: str, now: Column) -> DataFrame:
    """(name, uri, shadowed_by) for each row of `versions` (name, author, updated, uri): null for the version that stands.

    One's own version comes first, then the authority's, then all others (an unknown author is one of these); within
    these the newest, where a time that can't be read or lies ahead counts as the oldest; then the smallest uri. Rows
    without a name or uri take no part; rows that repeat a uri all stand if it does. No rows give no rows. The
    choice is one partial minimum a name, so a name with many versions gathers nowhere.
    """
    rank = F.when(F.col("author") == me, 0).when(F.col("author") == authority, 1).otherwise(2)
    age = F.coalesce(-F.unix_micros(readable_time(F.col("updated"), now)), F.lit(2**63 - 1))
    held = versions.where("name IS NOT NULL AND uri IS NOT NULL").select("name", "uri", F.struct(rank.alias("rank"), age.alias("age"), "uri").alias("place"))
    best = held.groupBy("name").agg(F.min("place").alias("first"))
    return held.join(best, "name").select("name", "uri", F.nullif(F.col("first.uri"), F.col("uri")).alias("shadowed_by"))
