"""Tuning over the whole grid: leaf scores are factored once, every setting is a column of a small matrix.

A query's candidates (CANDIDATES at most) and the counts of its terms in them go to one task. Each (k1, b) gives the
leaves' scores, each set of weights a column of keyword scores, each fusion a ranking: 576 settings without a row for
any pair of a setting and a document. Only a row of nDCG for each query and setting leaves the task.
"""

from __future__ import annotations

from collections.abc import Sequence

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from lodestone.functions.scores import RRF_K
from lodestone.plans import evaluate

#: Documents that a query's rankings order.
CANDIDATES = 200
#: A group's leaves in their order: the word, its stem, two parts and the parts' stems.
LEAVES = ("exact", "stem", "part0", "part0_stem", "part1", "part1_stem")


def keyword_scores(tf: np.ndarray, dl: np.ndarray, idf: np.ndarray, average: float, k1: float, b: float, weights: Sequence[tuple[float, float, float]]) -> np.ndarray:
    """Documents by weights (stem, parts, part_stem): the sum over groups of six leaves of the best alternative of each."""
    norm = 1 - b + b * dl / average if average > 0 else np.ones(len(dl))
    s = np.where(tf > 0, idf * tf * (k1 + 1) / (np.maximum(tf, 1e-300) + k1 * norm[:, None]), 0.0).reshape(len(dl), -1, len(LEAVES))
    out = np.empty((len(dl), len(weights)))
    for j, (stem, parts, part_stem) in enumerate(weights):
        both = np.maximum(s[:, :, 2], part_stem * s[:, :, 3]) + np.maximum(s[:, :, 4], part_stem * s[:, :, 5])
        out[:, j] = np.maximum(np.maximum(s[:, :, 0], stem * s[:, :, 1]), parts * both).sum(1)
    return np.round(out, 6)


def _ranks(scores: np.ndarray) -> np.ndarray:
    """1-based ranks down each column, ties to the row above; infinite where the score isn't over 0."""
    order = np.argsort(-scores, axis=0, kind="stable")
    rank = np.empty(scores.shape)
    np.put_along_axis(rank, order, np.broadcast_to(np.arange(1.0, len(scores) + 1)[:, None], scores.shape), axis=0)
    return np.where(scores > 0, rank, np.inf)


def fused(sim: np.ndarray, kw: np.ndarray, alpha: float | None) -> np.ndarray:
    """Each column of keyword scores fused with the similarities (NaN for none): convex, or by ranks without an alpha."""
    known = sim[~np.isnan(sim)]
    if alpha is None:
        near = _ranks(np.nan_to_num(sim, nan=0.0)[:, None])
        return np.round(1 / (RRF_K + near) + 1 / (RRF_K + _ranks(kw)), 6)
    wide = len(known) and known.max() > known.min()
    v = np.nan_to_num((sim - known.min()) / (known.max() - known.min()), nan=0.0) if wide else np.zeros(len(sim))
    top = kw.max(0)
    return np.round((1 - alpha) * v[:, None] + alpha * np.where(top > 0, kw / np.where(top > 0, top, 1), 0), 6)


def ndcg_of_settings(doc: np.ndarray, tf: np.ndarray, dl: np.ndarray, sim: np.ndarray, grade: np.ndarray, idf: np.ndarray, average: float, ideal: float, grid: Sequence[dict], k: int = 10) -> np.ndarray:
    """nDCG@k of one query under every setting of `grid`; NaN without an ideal gain."""
    order = np.argsort(doc, kind="stable")  # ties go to the smaller document
    tf, dl, sim, grade = tf[order], dl[order], sim[order], grade[order]
    out = np.full(len(grid), np.nan)
    if not ideal > 0:
        return out
    gain = (2.0**grade - 1)[:, None]
    discount = 1 / np.log2(np.arange(2, min(k, len(doc)) + 2))[:, None]
    by_factor: dict[tuple[float, float], list[int]] = {}
    for i, c in enumerate(grid):
        by_factor.setdefault((c["k1"], c["b"]), []).append(i)
    for (k1, b), own in by_factor.items():
        weights = list(dict.fromkeys((grid[i]["stem"], grid[i]["parts"], grid[i]["part_stem"]) for i in own))
        kw = keyword_scores(tf, dl, idf, average, k1, b, weights)
        for alpha in dict.fromkeys(grid[i]["alpha"] for i in own):
            top = np.argsort(-fused(sim, kw, alpha), axis=0, kind="stable")[:k]
            dcg = (np.take_along_axis(np.broadcast_to(gain, kw.shape), top, axis=0) * discount).sum(0)
            value = dict(zip(weights, dcg / ideal, strict=True))
            for i in own:
                if grid[i]["alpha"] == alpha:
                    out[i] = value[grid[i]["stem"], grid[i]["parts"], grid[i]["part_stem"]]
    return out


def tune(candidates: DataFrame, grid: Sequence[dict] | None = None, k: int = 10) -> DataFrame:
    """(query, setting, ndcg) for every setting, numbered as in `grid`; queries without a relevant document have null.

    `candidates`: query, doc, tf (array of doubles, six leaves for each group), dl, sim (null for none), grade (null for
    not judged), idf (array), average, ideal. Of a query's documents the CANDIDATES most similar take part, ties to the smaller
    doc.
    """
    grid = evaluate.grid() if grid is None else list(grid)
    first = F.row_number().over(Window.partitionBy("query").orderBy(F.desc_nulls_last("sim"), "doc"))
    few = candidates.withColumn("__n", first).where(F.col("__n") <= CANDIDATES).drop("__n")
    few = few.select("query", "doc", "tf", F.col("dl").cast("double").alias("dl"), F.col("sim").cast("double").alias("sim"), F.coalesce("grade", F.lit(0)).cast("double").alias("grade"), "idf", F.col("average").cast("double").alias("average"), F.col("ideal").cast("double").alias("ideal"))
    schema = few.select("query").schema.add("setting", "integer").add("ndcg", "double")

    def judge(group: pa.Table) -> pa.Table:
        col = lambda c: group.column(c).to_numpy()
        tf = np.array(group.column("tf").to_pylist(), np.float64)
        ideal = group.column("ideal")[0].as_py() or 0.0
        found = ndcg_of_settings(col("doc"), tf, col("dl"), col("sim").astype(np.float64), col("grade"), np.array(group.column("idf")[0].as_py(), np.float64), col("average")[0], ideal, grid, k)
        one = group.column("query").slice(0, 1).combine_chunks()
        return pa.table({"query": one.take(pa.array(np.zeros(len(grid), np.int64))), "setting": pa.array(range(len(grid)), pa.int32()), "ndcg": pa.array(found, from_pandas=True)})

    return few.groupBy("query").applyInArrow(judge, schema)


def macro(scores: DataFrame, category: Column) -> DataFrame:
    """(setting, ndcg, n): the mean over categories of their queries' means, so that no category's size decides."""
    per = scores.where("ndcg IS NOT NULL").groupBy("setting", category.alias("category")).agg(F.avg("ndcg").alias("mean"), F.count("*").alias("n"))
    return per.groupBy("setting").agg(F.avg("mean").alias("ndcg"), F.sum("n").alias("n"))
