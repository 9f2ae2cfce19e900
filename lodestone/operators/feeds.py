"""Change feeds and the store's life cycle as set operations on tables."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from lodestone.operators.running import SPAN, id_range, preceding, running


def latest(changes: DataFrame, key: Sequence[str], order: Sequence[str], values: Sequence[str]) -> DataFrame:
    """The last change of each key: one aggregation with a partial maximum, so a hot key gathers nowhere."""
    top = F.max(F.struct(*order, *[v for v in values if v not in order])).alias("x")
    return changes.groupBy(*key).agg(top).select(*key, *[F.col(f"x.{c}").alias(c) for c in dict.fromkeys([*order, *values])])


def upsert(stored: DataFrame, folded: DataFrame) -> DataFrame:
    """`stored` (path, value) after the last changes (path, op, value): deletes go, upserts replace, others stay."""
    rest = stored.join(folded.select("path"), "path", "left_anti")
    return rest.select("path", "value").unionByName(folded.where("op = 'upsert'").select("path", "value"))


def visible(rows: DataFrame, gone: DataFrame, key: str, generation: str) -> DataFrame:
    """`rows` but for those that a tombstone (key, generation) of a later generation hides."""
    last = gone.groupBy(key).agg(F.max(generation).alias("__gone"))
    return rows.join(last, key, "left").where(F.col("__gone").isNull() | (F.col("__gone") <= F.col(generation))).select(*rows.columns)


def model_progress(rows: DataFrame, has_vector: Column, *group: str) -> DataFrame:
    """For each group of rows: how many there are, have the new model's vector and lack it, and whether the new slot can
    take over: when nothing is missing.
    """
    done = F.count_if(has_vector)
    return rows.groupBy(*group).agg(F.count("*").alias("n"), done.alias("done"), (F.count("*") - done).alias("missing"), (F.count("*") == done).alias("ready"))


def snapshot_replace(stored: DataFrame, snapshot: DataFrame) -> DataFrame:
    """A full snapshot of some authors: their rows that it lacks go, all others stay."""
    listed = snapshot.select("author").distinct()
    others = stored.join(listed, "author", "left_anti")
    return others.select(*stored.columns).unionByName(snapshot.select(*stored.columns))


def removed(known: DataFrame, listed: DataFrame, key: str) -> DataFrame:
    return known.join(listed.select(key), key, "left_anti")


def gaps(feed: DataFrame, key: str, rev: str, span: int = SPAN) -> DataFrame:
    """Rows whose revision does not follow the one before it."""
    held = preceding(feed, [key], rev, id_range(rev, span))
    return held.where(F.col("before").isNotNull() & (F.col(rev) > F.col("before") + 1))


def resync(stored: DataFrame, changes: DataFrame, snapshot: DataFrame, gapped: DataFrame, space: str) -> DataFrame:
    """`stored` (space, path, value) after `changes` (space, path, op, value), the last of each path.

    A space whose feed has skipped revisions (`gapped`) can't be trusted to its changes: its rows are those of the snapshot.
    """
    lost = gapped.select(space).distinct()
    whole = changes.join(lost, space, "left_anti")
    kept = stored.join(lost, space, "left_anti").join(whole.select(space, "path"), [space, "path"], "left_anti")
    columns = [space, "path", "value"]
    return kept.select(*columns).unionByName(whole.where("op = 'upsert'").select(*columns)).unionByName(snapshot.join(lost, space, "left_semi").select(*columns))


def daily_quota(writes: DataFrame, limit: int, order: Sequence[str], bucket: Column) -> DataFrame:
    """Which writes of a (space, day) fit the limit, in order; later ones are held back. `bucket` never falls along the order."""
    return running(writes, ["space", "day"], order, bucket).withColumn("held", F.col("n") > limit)


def over_budget(entries: DataFrame, budget: int, last_used: str, size: str, id: str, part: str, span: int = 1) -> DataFrame:
    """Least recently used entries beyond the budget of each part; the most recent one always stays.

    `last_used` is a number; `span` of its units make a bucket.
    """
    held = running(entries, [part], [F.desc(last_used), F.desc(id)], -F.floor(F.col(last_used) / span), {"total": size})
    return held.where((F.col("n") > 1) & (F.col("total") > budget))


def merge_inputs(segments: DataFrame, most: int = 8, dead_ratio: float = 0.25) -> DataFrame:
    """Segments (segment, n, dead, old) to merge: none while there are few and little is dead; else the old ones
    if at least two of them suffice to get down to `most`, else all."""
    w = Window.partitionBy()  # a row for each segment: thousands at most
    s = segments.withColumns({"count": F.count("*").over(w), "rows": F.sum("n").over(w), "gone": F.sum("dead").over(w), "olds": F.sum(F.col("old").cast("int")).over(w)})
    due = (F.col("count") > most) | ((F.col("rows") > 0) & (F.col("gone") / F.col("rows") > dead_ratio))
    suffice = (F.col("olds") >= 2) & (F.col("count") - F.col("olds") + 1 <= most)
    pick = F.when(suffice, F.col("old")).otherwise((F.col("count") >= 2) | (F.col("gone") > 0))
    return s.where(due & pick).select("segment", "n", "dead", "old")
