"""Row numbers, running sums and the row before, along an order within keys of any size.

A window over a key orders all of its rows in one task. Here each key is parted by `bucket`, a value that never falls
along the order (a minute, a range of ids): rows are ordered within a bucket only, and what came before a bucket comes
from the buckets' totals, one row each.
"""

from __future__ import annotations

from collections.abc import Mapping, Sequence
from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

#: Ids in a bucket.
SPAN = 65536
_B = "__bucket"


def id_range(column: str, span: int = SPAN) -> Column:
    return F.floor(F.col(column) / span)


def _with(rows: DataFrame, before: DataFrame, keys: Sequence[str]) -> DataFrame:
    """`rows` with the columns of `before`, one row for each of their keys; null keys count as equal."""
    named = before.select(*(F.col(c).alias(f"__of_{c}") if c in keys else F.col(c) for c in before.columns))
    same = reduce(lambda a, b: a & b, (F.col(c).eqNullSafe(F.col(f"__of_{c}")) for c in keys))
    return rows.join(named, same, "left").drop(*(f"__of_{c}" for c in keys))


def running(rows: DataFrame, part: Sequence[str], order: Sequence[str | Column], bucket: Column, sums: Mapping[str, str] | None = None) -> DataFrame:
    """`rows` with `n`, their number within `part` from 1, and for each (name, column) of `sums` the sum so far.

    A sum is null until its column has had a value.
    """
    sums, keys = dict(sums or {}), [*part, _B]
    held = rows.withColumn(_B, bucket)
    totals = held.groupBy(*keys).agg(F.count("*").alias("__n"), *(F.sum(c).alias(f"__{name}") for name, c in sums.items()))
    earlier = Window.partitionBy(*part).orderBy(_B).rowsBetween(Window.unboundedPreceding, -1)
    before = totals.select(*keys, *(F.sum(f"__{x}").over(earlier).alias(f"__{x}") for x in ("n", *sums)))
    own = Window.partitionBy(*keys).orderBy(*order)
    so_far = own.rowsBetween(Window.unboundedPreceding, Window.currentRow)
    out = _with(held.withColumns({"n": F.row_number().over(own), **{name: F.sum(c).over(so_far) for name, c in sums.items()}}), before, keys)
    both = {name: F.coalesce(F.col(name) + F.col(f"__{name}"), F.col(name), F.col(f"__{name}")) for name in ("n", *sums)}
    return out.withColumns(both).drop(_B, *(f"__{x}" for x in both))


def preceding(rows: DataFrame, part: Sequence[str], value: str, bucket: Column) -> DataFrame:
    """`rows` with `before`, the next smaller or equal value of another row of the same part."""
    keys = [*part, _B]
    held = rows.withColumn(_B, bucket)
    tops = held.groupBy(*keys).agg(F.max(value).alias("__top"))
    earlier = tops.select(*keys, F.lag("__top").over(Window.partitionBy(*part).orderBy(_B)).alias("__top"))
    lag = F.lag(value).over(Window.partitionBy(*keys).orderBy(value))
    return _with(held.withColumn("before", lag), earlier, keys).withColumn("before", F.coalesce("before", "__top")).drop(_B, "__top")


def recent(rows: DataFrame, part: Sequence[str], at: str, window: int, wide: int = 8) -> DataFrame:
    """`rows` with `recent`, how many of the same part lie in the `window` that ends with the row, itself included.

    `at` is a whole number. A bucket is `wide` windows; the rows of its last window are counted in the next one too.
    """
    width = window * wide
    bucket = F.floor(F.col(at) / width)
    both = F.when(F.pmod(F.col(at), F.lit(width)) >= width - window, F.array(bucket, bucket + 1)).otherwise(F.array(bucket))
    dealt = rows.withColumn(_B, F.explode(both))
    frame = Window.partitionBy(*part, _B).orderBy(at).rangeBetween(-window, Window.currentRow)
    return dealt.withColumn("recent", F.count("*").over(frame)).where(F.col(_B).eqNullSafe(bucket)).drop(_B)
