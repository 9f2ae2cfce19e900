"""Vectors packed into blocks of rows, and query blocks met with vector blocks."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from lodestone.llm.common import cut

Q_ROWS, V_ROWS, BLOCKS_A_GROUP = 256, 512, 8
#: Query blocks that come to a group of vector blocks at once; both sides of such a meeting are then about as large.
TOGETHER = 16


def usable(column: str) -> Column:
    """Neither null nor empty, and every component is a finite number."""
    finite = F.forall(column, lambda x: x.isNotNull() & ~F.isnan(x.cast("double")) & (F.abs(x.cast("double")) < float("inf")))
    return F.col(column).isNotNull() & (F.size(column) > 0) & F.coalesce(finite, F.lit(False))


def blocks(vectors: DataFrame, rows: int, integers: bool = False) -> DataFrame:
    """(dims, top, ids, vectors) for runs of at most `rows` vectors of equal length, ordered by norm.

    `vectors` has (id long, v array<double>). Runs come from a range partition on (dims, norm, id), so equal
    norms spread over tasks. `top` is the largest norm of the block; ids and vectors are packed binaries.
    With `integers` each component x becomes floor(256 x).
    """
    v = F.transform("v", lambda x: F.floor(x * 256.0).cast("double")) if integers else F.col("v")
    source = vectors.select("id", v.alias("v")).withColumn("dims", F.size("v"))
    source = source.withColumn("norm", F.aggregate("v", F.lit(0.0), lambda a, x: a + x * x))
    source = source.repartitionByRange(F.col("dims"), F.col("norm").desc(), F.col("id")).sortWithinPartitions("dims", F.desc("norm"), "id")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            dims, ids = batch.column("dims").to_numpy(), batch.column("id").to_numpy(zero_copy_only=False)
            flat = batch.column("v").flatten().to_numpy(zero_copy_only=False)
            at = np.r_[0, np.cumsum(dims.astype(np.int64))]
            norm = batch.column("norm").to_numpy()
            cuts = np.unique(np.r_[0, np.flatnonzero(np.diff(dims)) + 1, len(dims)])
            for lo, hi in zip(cuts[:-1].tolist(), cuts[1:].tolist(), strict=True):
                for a in range(lo, hi, rows):
                    b = min(hi, a + rows)
                    yield pa.RecordBatch.from_pydict({"dims": pa.array([int(dims[a])], pa.int32()), "top": [float(norm[a] ** 0.5)], "ids": pa.array([ids[a:b].astype("<i8").tobytes()], pa.binary()), "vectors": pa.array([flat[at[a] : at[b]].astype("<f8").tobytes()], pa.binary())})

    return source.mapInArrow(run, "dims int, top double, ids binary, vectors binary")


def meet(asked: DataFrame, vectors: DataFrame, kernel: Callable[[int, np.ndarray, np.ndarray, list[tuple[float, np.ndarray, np.ndarray]]], pa.Table], schema: str, together: int = TOGETHER) -> DataFrame:
    """The kernel's rows for each query block and each group of vector blocks that it is to meet.

    `asked` has (dims, g, block, q_ids, q_vectors), a row for each such meeting; `vectors` are blocks with their group `g`.
    Up to `together` query blocks that follow each other come to a group at once: a task gets these and the
    group's blocks beside them, each a single time, so that no pair of blocks becomes a row. The kernel
    gets the query block's number, ids and matrix and the group's blocks (top, ids, matrix), largest norm first.
    """
    place = F.col("block").bitwiseAND(F.lit((1 << 33) - 1))
    key = ["dims", "g", "batch"]
    asked = asked.select("dims", "g", "block", "q_ids", "q_vectors", (F.col("block") - place + F.floor(place / together)).alias("batch"))
    met = vectors.join(asked.select(*key).distinct(), ["dims", "g"])
    met = met.select(*[F.col(c).alias(f"v_{c}") for c in key], "top", "ids", "vectors")  # both sides come from the same blocks

    def run(queries: pa.Table, group: pa.Table) -> pa.Table:
        bodies = unpacked(group)
        out = []
        for dims, block, ids, vecs in zip(*(queries.column(c).to_pylist() for c in ("dims", "block", "q_ids", "q_vectors")), strict=True):
            out.append(kernel(block, np.frombuffer(ids, "<i8"), np.frombuffer(vecs, "<f8").reshape(-1, dims), bodies))
        return pa.concat_tables(out)

    return asked.groupBy(*key).cogroup(met.groupBy(*[f"v_{c}" for c in key])).applyInArrow(run, schema)


def grid(queries: DataFrame, vectors: DataFrame, kernel: Callable[[np.ndarray, np.ndarray, list[tuple[float, np.ndarray, np.ndarray]]], tuple[np.ndarray, np.ndarray, np.ndarray]], score: str) -> DataFrame:
    """Every query block against every vector block of its length: rows (query_id, vec_id, score).

    The kernel gets a query block (ids, matrix) and a group's blocks (top, ids, matrix), largest norm first, and
    returns the few best of each query there.
    """
    queries, vectors = cut(asked(queries)), cut(grouped(vectors))

    def run(_: int, q_ids: np.ndarray, q: np.ndarray, bodies: list[tuple[float, np.ndarray, np.ndarray]]) -> pa.Table:
        a, b, s = kernel(q_ids, q, bodies)
        return pa.table({"query_id": pa.array(a, pa.int64()), "vec_id": pa.array(b, pa.int64()), "score": pa.array(s, pa.int64() if score == "long" else pa.float64())})

    return meet(queries.join(vectors.select("dims", "g").distinct(), "dims"), vectors, run, f"query_id long, vec_id long, score {score}")


def grouped(vectors: DataFrame) -> DataFrame:
    """Vector blocks with `g`, the group of at most BLOCKS_A_GROUP blocks that follow each other by norm."""
    n = F.monotonically_increasing_id()  # the partition's number, then the row's in 33 bits
    place = n.bitwiseAND(F.lit((1 << 33) - 1))
    return vectors.withColumn("g", n - place + F.floor(place / BLOCKS_A_GROUP))


def asked(queries: DataFrame) -> DataFrame:
    """Query blocks (dims, block, q_ids, q_vectors)."""
    return queries.select("dims", F.monotonically_increasing_id().alias("block"), F.col("ids").alias("q_ids"), F.col("vectors").alias("q_vectors"))


def unpacked(group: pa.Table) -> list[tuple[float, np.ndarray, np.ndarray]]:
    """A group's vector blocks (top, ids, matrix), largest norm first."""
    group = group.sort_by([("top", "descending")])
    return [(t, np.frombuffer(i, "<i8"), np.frombuffer(v, "<f8").reshape(-1, n)) for n, t, i, v in zip(*(group.column(c).to_pylist() for c in ("v_dims", "top", "ids", "vectors")), strict=True)]


def best(query: np.ndarray, vec: np.ndarray, cost: np.ndarray, k: int) -> np.ndarray:
    """Indices of each query's k rows of least cost, ties to the smaller id, each id once."""
    order = np.lexsort((vec, cost, query))
    q, v, c = query[order], vec[order], cost[order]
    if len(q):
        # an id found twice has equal cost if its row is the same; the cheaper of two rows comes first
        by = np.lexsort((order, c, v, q))
        first = np.ones(len(q), bool)
        first[by[1:]] = (q[by[1:]] != q[by[:-1]]) | (v[by[1:]] != v[by[:-1]])
        order, q = order[first], q[first]
    start = np.r_[0, np.flatnonzero(np.diff(q)) + 1] if len(q) else np.zeros(0, np.int64)
    rank = np.arange(len(q)) - np.repeat(start, np.diff(np.r_[start, len(q)]))
    return order[rank < k]
