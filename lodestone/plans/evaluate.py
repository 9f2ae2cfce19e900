"""Offline evaluation: pooling, judgments, tuning over a grid of configurations."""

from __future__ import annotations

from itertools import product

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

#: Values tried in tuning (fixed values): stem, parts, part-stem weights, k1, b, alpha; None fuses by ranks.
GRID = {"stem": (0.5, 0.7, 0.85, 1.0), "parts": (0.3, 0.4, 0.6), "part_stem": (0.5, 0.8), "k1": (0.9, 1.2, 1.6), "b": (0.4, 0.75), "alpha": (0.4, 0.5, 0.6, None)}


def grid(**limits: tuple) -> list[dict[str, float | None]]:
    axes = {k: limits.get(k, v) for k, v in GRID.items()}
    return [dict(zip(axes, values, strict=True)) for values in product(*axes.values())]


def query_id(category: Column, text: Column, target: Column) -> Column:
    """Twelve hex digits of the hash of category, text and target, parted by zero bytes."""
    return F.substring(F.sha2(F.concat(category, F.lit("\0"), text, F.lit("\0"), target), 256), 1, 12)


def is_tuning(id: Column) -> Column:
    """Four of ten queries tune; the others are held out."""
    first = F.conv(F.substring(F.sha2(F.concat(F.lit("split\0"), id), 256), 1, 2), 16, 10).cast("int")
    return first % 10 < 4


def pool(run: DataFrame, depth: int) -> DataFrame:
    """(query, doc, first system) of each system's first `depth`, each document once, systems in name order."""
    top = run.where(F.col("rank") <= depth)
    return top.groupBy("query", "doc").agg(F.min("system").alias("system"))


def unjudged(pooled: DataFrame, judged: DataFrame) -> DataFrame:
    return pooled.join(judged.select("query", "doc"), ["query", "doc"], "left_anti")


def ranked(scores: DataFrame) -> DataFrame:
    """(system, query, doc, score) with its rank, ties to the smaller doc."""
    return scores.withColumn("rank", F.row_number().over(Window.partitionBy("system", "query").orderBy(F.desc("score"), "doc")))
