"""Retrieval metrics over tables run(system, query, doc, rank) and grades(query, doc, grade)."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from lodestone.functions.scores import d

KEYS = ["system", "query"]


def graded(run: DataFrame, grades: DataFrame) -> DataFrame:
    """The run with each document's grade, 0 where it was not judged."""
    return run.join(grades, ["query", "doc"], "left").withColumn("grade", F.coalesce("grade", F.lit(0)))


def _per_query(run: DataFrame, grades: DataFrame) -> DataFrame:
    """Every (system, query) with judgments' totals, so that queries without a hit count as well."""
    totals = grades.groupBy("query").agg(F.count_if(F.col("grade") >= 1).alias("relevant"))
    return run.select("system", "query").distinct().join(totals, "query", "left").withColumn("relevant", F.coalesce("relevant", F.lit(0)))


def recall(run: DataFrame, grades: DataFrame, k: int) -> DataFrame:
    """Relevant documents (grade 1 or more) in the first k, over all relevant; null if there are none."""
    hits = graded(run.where(F.col("rank") <= k), grades).groupBy(*KEYS).agg(F.count_if(F.col("grade") >= 1).alias("hits"))
    both = _per_query(run, grades).join(hits, KEYS, "left")
    return both.select(*KEYS, F.when(F.col("relevant") > 0, F.round(d(F.coalesce("hits", F.lit(0))) / d(F.col("relevant")), 6)).alias("recall"))


def mrr(run: DataFrame, grades: DataFrame, k: int) -> DataFrame:
    """1 over the first relevant rank within k, else 0; null if nothing is relevant."""
    first = graded(run.where(F.col("rank") <= k), grades).where("grade >= 1").groupBy(*KEYS).agg(F.min("rank").alias("first"))
    both = _per_query(run, grades).join(first, KEYS, "left")
    return both.select(*KEYS, F.when(F.col("relevant") > 0, F.round(F.coalesce(d(1) / d(F.col("first")), d(0)), 6)).alias("mrr"))


def _gain(grade: Column, rank: Column) -> Column:
    return (F.pow(d(2), d(grade)) - d(1)) / F.log2(d(rank) + d(1))


def ideal_gains(grades: DataFrame, k: int) -> DataFrame:
    """(query, ideal): the gain of each query's ideal order of all judged."""
    best = grades.withColumn("r", F.row_number().over(Window.partitionBy("query").orderBy(F.desc("grade"), "doc"))).where(F.col("r") <= k)
    return best.groupBy("query").agg(F.sum(_gain(F.col("grade"), F.col("r"))).alias("ideal"))


def ndcg(run: DataFrame, grades: DataFrame, k: int) -> DataFrame:
    """Gain 2^grade - 1, discount log2(rank + 1), over the ideal order of all judged; null without an ideal."""
    got = graded(run.where(F.col("rank") <= k), grades).groupBy(*KEYS).agg(F.sum(_gain(F.col("grade"), F.col("rank"))).alias("dcg"))
    best = ideal_gains(grades, k)
    both = run.select(*KEYS).distinct().join(got, KEYS, "left").join(best, "query", "left")
    return both.select(*KEYS, F.when(F.col("ideal") > 0, F.round(F.coalesce("dcg", d(0)) / F.col("ideal"), 6)).alias("ndcg"))


def kappa(pairs: DataFrame) -> DataFrame:
    """Cohen's kappa of (a, b) over all rows: one row, null for none, 1 if chance alone would agree always."""
    cells = pairs.groupBy("a", "b").agg(F.count("*").alias("c"))
    both = cells.select(F.explode(F.array(F.struct(F.lit("a").alias("side"), F.col("a").alias("v")), F.struct(F.lit("b").alias("side"), F.col("b").alias("v")))).alias("x"), "c")
    sums = both.groupBy("x.v").agg(F.sum(F.when(F.col("x.side") == "a", F.col("c")).otherwise(0)).alias("na"), F.sum(F.when(F.col("x.side") == "b", F.col("c")).otherwise(0)).alias("nb"))
    chance = sums.agg(F.sum(d(F.col("na")) * d(F.col("nb"))).alias("cross"))
    total = cells.agg(F.sum("c").alias("n"), F.sum(F.when(F.col("a") == F.col("b"), F.col("c")).otherwise(0)).alias("same"))
    t = total.crossJoin(chance)  # one row each
    n, po = d(F.col("n")), d(F.col("same")) / d(F.col("n"))
    pe = F.col("cross") / (n * n)
    return t.select(F.coalesce("n", F.lit(0)).alias("n"), F.round(F.when(pe == 1, d(1)).otherwise((po - pe) / (d(1) - pe)), 6).alias("kappa"), F.round(po * 100, 4).alias("agreement"))


def bootstrap(diffs: DataFrame, rounds: int = 1000, seed: int = 1) -> DataFrame:
    """Mean paired difference and its 95 % interval from resamples.

    Each row enters a resample a Poisson(1) number of times, drawn by a hash of (seed, round, key): so a
    resample is a grouped sum, whatever the number of rows. `diffs` has (key, diff); nulls are left out.
    """
    has = diffs.where("diff IS NOT NULL")
    u = F.pmod(F.xxhash64(F.lit(seed), "round", "key"), F.lit(1 << 30)).cast("double") / float(1 << 30)
    p, total, times = 0.36787944117144233, 0.0, F.lit(0)
    for i in range(8):
        total += p
        times = times + F.when(u >= F.lit(total), 1).otherwise(0)
        p /= i + 1
    drawn = has.withColumn("round", F.explode(F.sequence(F.lit(1), F.lit(rounds)))).withColumn("w", times)
    means = drawn.groupBy("round").agg((F.sum(F.col("diff") * F.col("w")) / F.greatest(F.sum("w"), F.lit(1))).alias("m"))
    ends = means.agg(F.percentile("m", F.lit(0.025)).alias("low"), F.percentile("m", F.lit(0.975)).alias("high"))
    return has.agg(F.count("*").alias("n"), F.round(F.avg("diff"), 6).alias("mean")).crossJoin(ends)
