"""Centroid clustering by equal-average equal-variance search, in whole numbers.

Centroids are sorted by the sum of their components. A vector starts at its own sum and scans outward, nearest sum
first. Two inequalities reject a centroid without measuring it: for d components, with S their sum and V the
root of d * (sum of squares) - S * S,

    d * distance >= (S - S')^2    and    d * distance >= (S - S')^2 + (V - V')^2.

The first grows along the scan, so it ends the scan of a vector; the second passes one centroid over. What is
left is measured exactly, in 64-bit integers. All vectors of a batch scan in step.

Spark maps batches of vectors against the centroids, a table of `k` rows by `dims` whole numbers, and sums
what falls to each centroid before anything is shuffled; only these sums reach the driver between rounds.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lodestone.llm.common import cut, ranges

#: Largest component, in either direction: sums of squares of 64 differences then stay within 63 bits.
LARGEST = 1 << 27
#: Vectors that scan in step.
ROWS = 4096


def _whole(lists: pa.Array, dims: int, scale: int) -> tuple[np.ndarray, np.ndarray]:
    """Which lists have exactly `dims` components, all of them finite numbers, and these as floor(scale * x)."""
    lengths = lists.value_lengths().fill_null(-1).to_numpy(zero_copy_only=False).astype(np.int64)
    flat = lists.flatten().to_numpy(zero_copy_only=False).astype(np.float64)  # nulls become NaN
    own = np.flatnonzero(lengths == dims)
    held = np.maximum(lengths, 0)
    x = flat[ranges((np.cumsum(held) - held)[own], held[own])].reshape(-1, dims)
    good = np.isfinite(x).all(1)
    whole = np.floor(x[good] * scale)
    if len(whole) and np.abs(whole).max() > LARGEST:
        raise ValueError(f"a component lies beyond {LARGEST}: distances would not fit a long")
    return own[good], whole.astype(np.int64)


def _spread(x: np.ndarray, sums: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """V of each row, and how far rounding may have moved it: a part of the root of d * (sum of squares)."""
    squares = x.shape[1] * (x * x).sum(1).astype(np.float64)
    return np.sqrt(np.maximum(squares - sums.astype(np.float64) ** 2, 0)), 1e-7 * np.sqrt(squares) + 1e-3


class Search:
    """Centroids in the order of their sums; `nearest` gives each vector's number and squared distance."""

    def __init__(self, centroids: np.ndarray):
        sums = centroids.sum(1)
        self.order = np.argsort(sums, kind="stable")
        self.c, self.sums = centroids[self.order], sums[self.order]
        self.dims = centroids.shape[1]
        self.spread, self.slack = _spread(self.c, self.sums)
        self.measured = 0

    def nearest(self, x: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Ties go to the smaller number of the centroid."""
        n, k = len(x), len(self.c)
        sums = x.sum(1)
        spread, slack = _spread(x, sums)
        right = np.searchsorted(self.sums, sums)
        left = right - 1
        best, number = np.full(n, np.iinfo(np.int64).max), np.full(n, k)
        live = np.arange(n)
        for _ in range(k):
            down = np.where(left[live] >= 0, sums[live] - self.sums[np.maximum(left[live], 0)], np.iinfo(np.int64).max)
            up = np.where(right[live] < k, self.sums[np.minimum(right[live], k - 1)] - sums[live], np.iinfo(np.int64).max)
            below = down <= up
            apart = np.where(below, down, up).astype(np.float64)
            at = np.where(below, left[live], right[live])
            left[live] -= below
            right[live] += ~below
            bound = apart * apart * (1 - 1e-12)
            limit = self.dims * best[live].astype(np.float64)
            open_ = bound <= limit
            live, at, bound, limit = live[open_], at[open_], bound[open_], limit[open_]
            if not len(live):
                break
            aside = np.maximum(np.abs(spread[live] - self.spread[at]) - slack[live] - self.slack[at], 0)
            may = bound + aside * aside <= limit
            rows, at = live[may], at[may]
            self.measured += len(rows)
            gap = x[rows] - self.c[at]
            distance, own = np.einsum("ij,ij->i", gap, gap), self.order[at]
            better = (distance < best[rows]) | ((distance == best[rows]) & (own < number[rows]))
            best[rows[better]], number[rows[better]] = distance[better], own[better]
        return number, best


def start(vectors: DataFrame, k: int, dims: int, scale: int, seed: int, id: str = "vec_id", vector: str = "embedding") -> np.ndarray:
    """The k kept vectors of smallest sha256 of `<seed>:<id>`, in that order; equal ids by their components."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows, whole = _whole(batch.column(1), dims, scale)
            v = pa.ListArray.from_arrays(pa.array(np.arange(len(rows) + 1, dtype=np.int32) * dims), pa.array(whole.ravel()))
            yield pa.RecordBatch.from_arrays([batch.column(0).take(pa.array(rows)), v], ["hash", "v"])

    hashed = vectors.select(F.sha2(F.concat(F.lit(f"{seed}:"), F.coalesce(F.col(id).cast("string"), F.lit(""))), 256).alias("hash"), vector)
    rows = hashed.mapInArrow(run, "hash string, v array<long>").orderBy("hash", "v").limit(k).collect()
    return np.array([r.v for r in rows], np.int64).reshape(-1, dims)


def _sums(vectors: DataFrame, centroids: np.ndarray, scale: int, vector: str) -> dict[int, tuple[int, list[int]]]:
    """For each centroid that is nearest to a vector: how many, and the sums of their components."""
    dims = centroids.shape[1]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        search = Search(centroids)
        total, count = np.zeros(centroids.shape, np.int64), np.zeros(len(centroids), np.int64)
        for batch in batches:
            for lo in range(0, batch.num_rows, ROWS):
                _, x = _whole(batch.column(0).slice(lo, ROWS), dims, scale)
                number, _ = search.nearest(x)
                by = np.argsort(number, kind="stable")
                own, first = np.unique(number[by], return_index=True)
                total[own] += np.add.reduceat(x[by], first) if len(own) else 0
                count += np.bincount(number, minlength=len(count))
        hit = np.flatnonzero(count)
        at, of = np.tile(np.arange(dims), len(hit)), np.repeat(hit, dims)
        yield pa.RecordBatch.from_pydict({"cluster": pa.array(of, pa.int32()), "at": pa.array(at, pa.int32()), "n": pa.array(count[of]), "s": pa.array(total[hit].ravel())})

    sums = vectors.select(vector).mapInArrow(run, "cluster int, at int, n long, s long").groupBy("cluster", "at").agg(F.sum("n").alias("n"), F.sum(F.col("s").cast("decimal(38,0)")).alias("s"))
    out: dict[int, tuple[int, list[int]]] = {}
    for r in sums.orderBy("cluster", "at").collect():  # k rows by dims at most
        out.setdefault(r["cluster"], (r["n"], []))[1].append(int(r["s"]))
    return out


def refine(vectors: DataFrame, centroids: np.ndarray, scale: int, vector: str = "embedding") -> np.ndarray:
    """Every centroid that is nearest to some vectors becomes their mean, rounded down; the others stay."""
    new = centroids.copy()
    for cluster, (n, sums) in _sums(vectors, centroids, scale, vector).items():
        new[cluster] = [s // n for s in sums]
    return new


def assign(vectors: DataFrame, centroids: np.ndarray, scale: int, id: str = "vec_id", vector: str = "embedding") -> DataFrame:
    """(id, cluster, distance) of every kept vector; a map without a shuffle."""
    dims = centroids.shape[1]
    source = vectors.select(id, F.col(vector).alias("__v"))
    schema = source.select(id).schema.add("cluster", "integer").add("distance", "long")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        search = Search(centroids)
        for batch in batches:
            for lo in range(0, batch.num_rows, ROWS):
                part = batch.slice(lo, ROWS)
                rows, x = _whole(part.column(1), dims, scale)
                number, distance = search.nearest(x)
                yield pa.RecordBatch.from_arrays([part.column(0).take(pa.array(rows)), pa.array(number, pa.int32()), pa.array(distance, pa.int64())], [id, "cluster", "distance"])

    return source.mapInArrow(run, schema)


def cluster(vectors: DataFrame, k: int = 16, rounds: int = 3, dims: int = 64, scale: int = 64, seed: int = 1, id: str = "vec_id", vector: str = "embedding") -> DataFrame:
    """Rows (id, cluster, distance, cluster_inertia, inertia, centroid_sha256), one for each kept vector.

    Kept are vectors of exactly `dims` components, none of them null or not finite; a component x counts as
    floor(scale * x) in double precision. Fewer vectors than `k` give as many centroids. Repeated rows count and
    are returned each; a null id is hashed as an empty one and returned as null; of equal distances the smaller
    centroid wins. Other columns are left out. An empty table, or one without a kept vector, gives no rows.
    Components beyond LARGEST raise, as their distances would not fit a long.
    """
    centroids = start(vectors, k, dims, scale, seed, id, vector)
    for _ in range(rounds if len(centroids) else 0):
        centroids = refine(vectors, centroids, scale, vector)
    placed = cut(assign(vectors, centroids, scale, id, vector)) if len(centroids) else assign(vectors.limit(0), np.zeros((1, dims), np.int64), scale, id, vector)
    shown = placed.sparkSession.createDataFrame([(i, ",".join(map(str, c))) for i, c in enumerate(centroids.tolist())], "cluster int, shown string")
    # k rows of sums and texts
    each = placed.groupBy("cluster").agg(F.sum("distance").alias("cluster_inertia"))
    total = each.agg(F.sum("cluster_inertia").alias("inertia"))
    facts = each.join(shown, "cluster").crossJoin(F.broadcast(total)).select("cluster", "cluster_inertia", "inertia", F.sha2("shown", 256).alias("centroid_sha256"))
    return placed.join(F.broadcast(facts), "cluster").select(id, "cluster", "distance", "cluster_inertia", "inertia", "centroid_sha256")
