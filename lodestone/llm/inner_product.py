"""Exact top-k by inner product over buckets of vectors of similar length (norm).

Vectors ordered by norm fall into blocks. A query goes through a group's blocks from the longest vectors down,
with its k-th best product so far as threshold. A block whose longest vector cannot reach it ends the walk.
Otherwise the threshold over both lengths is the cosine that a vector of the block needs: where that is
high, candidates must lie in the feasible interval of the query's largest coordinates; where it is low,
only vectors long enough are kept. What is left is verified by its exact product.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from lodestone.llm.common import cut
from lodestone.llm.vector_blocks import Q_ROWS, V_ROWS, asked, best, blocks, grouped, meet, usable

#: From this local cosine threshold on, coordinates prune more than lengths; and how many coordinates are used.
COORDINATE_FROM, FOCUS = 0.6, 4
SLACK = 1e-9
#: The threshold of a query that has not found k yet.
NONE = np.iinfo(np.int64).min


def _products(q: np.ndarray, v: np.ndarray) -> np.ndarray:
    """Exact integer products: doubles hold them below 2**53, 64-bit integers below 2**63."""
    bound = np.abs(q).max(initial=0) * np.abs(v).max(initial=0) * max(1, q.shape[1])
    if bound < 2.0**53:
        return np.rint(q @ v.T).astype(np.int64)
    if bound < 2.0**63:
        return q.astype(np.int64) @ v.astype(np.int64).T
    raise ValueError("inner products do not fit 64 bits")


def _walk(q_ids: np.ndarray, q: np.ndarray, bodies: list[tuple[float, np.ndarray, np.ndarray]], k: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    n = len(q)
    length = np.sqrt((q**2).sum(1))
    unit = q / np.maximum(length, 1e-300)[:, None]
    focus = np.argsort(-np.abs(unit), axis=1)[:, :FOCUS]
    threshold = np.full(n, NONE)
    row, vec, product = (np.zeros(0, np.int64) for _ in range(3))
    for top, ids, v in bodies:
        # the bounds are in floating point and a little wide; products and thresholds are whole numbers
        live = np.flatnonzero((threshold == NONE) | (length * top * (1 + SLACK) + SLACK >= threshold))
        if not len(live):
            break
        size = np.sqrt((v**2).sum(1))
        with np.errstate(divide="ignore", invalid="ignore"):
            cosine = np.where(threshold[live] > 0, threshold[live] / (length[live] * top), -1.0)
        by_coordinate = live[cosine >= COORDINATE_FROM]
        by_length = live[cosine < COORDINATE_FROM]
        new = []
        if len(by_length):
            # the block is ordered by norm: the vectors that can reach the lowest threshold are its first ones
            need = np.where(threshold[by_length] > 0, threshold[by_length] / np.maximum(length[by_length], 1e-300), 0.0).min()
            m = int(np.count_nonzero(size * (1 + SLACK) + SLACK >= need))
            s = _products(q[by_length], v[:m])
            a, b = np.nonzero((s >= threshold[by_length][:, None]) & (q_ids[by_length][:, None] != ids[None, :m]))
            new.append((by_length[a], ids[b], s[a, b]))
        if len(by_coordinate):
            direction = v / np.maximum(size, 1e-300)[:, None]
            for i in by_coordinate.tolist():
                need = min(1.0, threshold[i] / (length[i] * top)) - SLACK
                x = unit[i, focus[i]]
                half = np.sqrt(np.maximum(0, 1 - x**2) * max(0.0, 1 - need**2))
                # the candidate's angle to an axis is the query's, give or take the angle of `need`
                low = np.where(x <= -need, -1.0, x * need - half) - 1e-7
                high = np.where(x >= need, 1.0, x * need + half) + 1e-7
                near = direction[:, focus[i]]
                keep = np.flatnonzero(((near >= low) & (near <= high)).all(1) & (ids != q_ids[i]))
                if len(keep):
                    s = _products(q[i : i + 1], v[keep])[0]
                    ok = s >= threshold[i]
                    new.append((np.full(int(ok.sum()), i), ids[keep][ok], s[ok]))
        row, vec, product = (np.concatenate([old, *(x[c] for x in new)]) for c, old in enumerate((row, vec, product)))
        kept = best(row, vec, ~product, k)  # ascending, without overflow
        row, vec, product = row[kept], vec[kept], product[kept]
        count = np.bincount(row, minlength=n)
        lowest = np.full(n, np.iinfo(np.int64).max)
        np.minimum.at(lowest, row, product)
        threshold = np.where(count >= k, lowest, NONE)
    return q_ids[row], vec, product


def _least_norm(q_ids: np.ndarray, q: np.ndarray, row_ids: np.ndarray, score: np.ndarray, k: int) -> float:
    """The norm that a vector needs to get into any of the queries' first k; 0 if one of them takes any vector."""
    need = np.inf
    for i, length in zip(q_ids.tolist(), np.sqrt((q**2).sum(1)).tolist(), strict=True):
        own = score[row_ids == i]
        need = min(need, own.min() / length if len(own) >= k and own.min() > 0 else 0.0)
    return float(need)


def top_products(embeddings: DataFrame, queries: DataFrame, k: int = 5, id: str = "vec_id", vector: str = "embedding") -> DataFrame:
    """Each query's k highest products of floor(256 x) vectors: (query_id, rank, vec_id, score), exact.

    A vector whose id is the query's own is no candidate. Null or empty vectors and those with null or
    non-finite components take no part; zero vectors do; vectors of different lengths never meet. Of rows that
    repeat an id the best counts, and repeated query rows count as one. Ties go to the smaller vec_id. An
    empty table gives no rows. Products beyond 64 bits raise an error.
    """

    def clean(df: DataFrame) -> DataFrame:
        return df.where(usable(vector) & F.col(id).isNotNull()).select(F.col(id).cast("long").alias("id"), F.col(vector).cast("array<double>").alias("v"))

    vectors = cut(grouped(blocks(clean(embeddings), V_ROWS, integers=True)))
    ask = cut(asked(blocks(clean(queries), Q_ROWS, integers=True)))
    groups = vectors.groupBy("dims", "g").agg(F.max("top").alias("longest"))
    head = groups.groupBy("dims").agg(F.max_by("g", F.struct("longest", "g")).alias("g"))

    def walk(need: bool):
        def run(block: int, q_ids: np.ndarray, q: np.ndarray, bodies: list[tuple[float, np.ndarray, np.ndarray]]) -> pa.Table:
            a, b, s = _walk(q_ids, q, bodies, k)
            out = {"query_id": pa.array(a, pa.int64()), "vec_id": pa.array(b, pa.int64()), "score": pa.array(s, pa.int64())}
            if not need:
                return pa.table(out)
            rows = pa.ListArray.from_arrays(pa.array([0, len(a)], pa.int32()), pa.StructArray.from_arrays(list(out.values()), list(out)))
            return pa.table({"block": pa.array([block], pa.int64()), "need": pa.array([_least_norm(q_ids, q, a, s, k)]), "found": rows})

        return run

    # the longest vectors settle how long the others must be; a block of queries meets only groups that long
    schema = "query_id long, vec_id long, score long"
    first = cut(meet(ask.join(head, "dims"), vectors, walk(True), "block long, need double, found array<struct<query_id:long,vec_id:long,score:long>>", together=1))
    left = ask.join(first.select("block", "need"), "block").join(groups.join(head, ["dims", "g"], "left_anti"), "dims").where("longest * (1 + 1e-9) + 1e-9 >= need")
    found = first.select(F.inline("found")).unionByName(meet(left, vectors, walk(False), schema))
    once = found.groupBy("query_id", "vec_id").agg(F.max("score").alias("score"))
    rank = F.row_number().over(Window.partitionBy("query_id").orderBy(F.desc("score"), "vec_id"))
    return once.withColumn("rank", rank).where(F.col("rank") <= k).select("query_id", "rank", "vec_id", "score")
