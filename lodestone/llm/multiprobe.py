"""Approximate nearest neighbours by multiprobe p-stable hashing.

Each of `tables` tables hashes a vector with `hashes` Gaussian projections cut into cells of one width. A query
visits its own bucket and the perturbed ones with the least sum of squared distances to the crossed cell
walls, which is the order of estimated success. Vectors of one bucket travel in packed blocks; a task
compares a block of queries with a block of vectors and keeps each query's nearest, so candidates of all
tables merge without a row for each pair. Distances are exact, in double precision: a matrix product with a bound
on its error only tells which pairs can be among the nearest.

Few tables with many probes reach the recall of many tables with few, and store each vector less often.
"""

from __future__ import annotations

import heapq
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.types import FloatType

from lodestone.llm.common import cut, mix, ranges
from lodestone.llm.vector_blocks import Q_ROWS, V_ROWS, best, blocks, grid, usable

TABLES, HASHES, PROBES = 3, 6, 75
#: Cell width as a multiple of the median distance of the sample's pairs, and the sample's size.
WIDTH, SAMPLE = 1.6, 1000
#: Vectors in a block of one bucket.
BUCKET_ROWS = 256
#: A bucket with over this share of all members, as 1 / HEAVY, is spread over tasks; there are fewer than HEAVY of them. Then
#: so many of its blocks, on either side, share a join key.
HEAVY, TILE = 1000, 4


def cell_width(vectors: DataFrame, sample: int = SAMPLE, width: float = WIDTH) -> float:
    """`width` times the median distance between vectors of a sample: the `sample` rows of lowest id hash."""
    rows = vectors.orderBy(F.xxhash64("id"), "id").limit(sample).select("v").collect()
    lengths = [len(r.v) for r in rows]
    own = [r.v for r in rows if len(r.v) == max(set(lengths), key=lengths.count)]
    x = np.array(own, np.float64)
    if len(x) < 2:
        return 1.0
    squares = (x**2).sum(1)
    apart = np.sqrt(np.maximum(0, squares[:, None] + squares - 2 * x @ x.T))[np.triu_indices(len(x), 1)]
    return float(width * (np.median(apart) or apart.max() or 1.0))


def _projections(dims: int, tables: int, hashes: int, width: float, seed: int) -> tuple[np.ndarray, np.ndarray]:
    rng = np.random.default_rng([seed, dims])
    return rng.normal(size=(dims, tables * hashes)) / width, rng.uniform(size=tables * hashes)


def _keys(cells: np.ndarray, dims: int, t: int) -> np.ndarray:
    """One 64-bit key for each row of cell numbers in table t."""
    h = np.full(len(cells), dims * 1009 + t, np.uint64)
    for column in cells.T:
        h = mix(h * np.uint64(0x9E3779B97F4A7C15) + column.astype(np.int64).view(np.uint64))
    return h.view(np.int64)


def perturbations(to_wall: np.ndarray, axis: np.ndarray, probes: int) -> list[tuple[int, ...]]:
    """The empty set and `probes` sets of indices into `to_wall` (sorted squared distances to walls), least sum first.

    `axis` tells which projection each wall belongs to; a set that would move one both ways is passed over. There
    are fewer sets only if the walls have no more.
    """
    out: list[tuple[int, ...]] = [()]
    heap = [(float(to_wall[0]), (0,))]
    while heap and len(out) <= probes:
        total, chosen = heapq.heappop(heap)
        if len(set(axis[list(chosen)].tolist())) == len(chosen):
            out.append(chosen)
        last = chosen[-1]
        if last + 1 < len(to_wall):
            step = float(to_wall[last + 1])
            heapq.heappush(heap, (total - float(to_wall[last]) + step, (*chosen[:-1], last + 1)))
            heapq.heappush(heap, (total + step, (*chosen, last + 1)))
    return out


def probe_keys(q: np.ndarray, dims: int, tables: int, hashes: int, probes: int, width: float, seed: int) -> tuple[np.ndarray, np.ndarray]:
    """(row of q, key) for every bucket that each query visits."""
    a, b = _projections(dims, tables, hashes, width, seed)
    at = q @ a + b
    rows, keys = [], []
    for t in range(tables):
        part = at[:, t * hashes : (t + 1) * hashes]
        cell = np.floor(part)
        walls = np.concatenate([part - cell, 1 - (part - cell)], 1) ** 2  # down, then up
        order = np.argsort(walls, axis=1, kind="stable")
        moved, owner = [], []
        for i in range(len(q)):
            sets = perturbations(walls[i, order[i]], order[i] % hashes, probes)
            for chosen in sets:
                walk = order[i, list(chosen)]
                new = cell[i].copy()
                new[walk % hashes] += np.where(walk < hashes, -1, 1)
                moved.append(new)
            owner += [i] * len(sets)
        rows.append(np.array(owner, np.int64))
        keys.append(_keys(np.array(moved).reshape(-1, hashes), dims, t))
    return np.concatenate(rows), np.concatenate(keys)


def _hashed(vectors: DataFrame, tables: int, hashes: int, probes: int, width: float, seed: int, code: str | None) -> DataFrame:
    """(key, dims, id, vec): each vector once a table, or with probes > 0 once for every bucket it visits.

    Vectors are packed as numbers of type `code`; None leaves them out.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for lo in range(0, batch.num_rows, 1024):
                part = batch.slice(lo, 1024)
                ids, lists = part.column(0).to_numpy(zero_copy_only=False), part.column(1)
                lengths = lists.value_lengths().to_numpy(zero_copy_only=False).astype(np.int64)
                flat, at = lists.flatten().to_numpy(zero_copy_only=False), np.r_[0, np.cumsum(lengths)]
                for dims in np.unique(lengths).tolist():
                    own = np.flatnonzero(lengths == dims)
                    x = flat[ranges(at[own], lengths[own])].reshape(-1, dims).astype(np.float64)
                    if probes:
                        row, key = probe_keys(x, dims, tables, hashes, probes, width, seed)
                    else:
                        a, b = _projections(dims, tables, hashes, width, seed)
                        cells = np.floor(x @ a + b)
                        key = np.concatenate([_keys(cells[:, t * hashes : (t + 1) * hashes], dims, t) for t in range(tables)])
                        row = np.tile(np.arange(len(x)), tables)
                    raw = [r.tobytes() for r in x.astype(code)] if code else [b""] * len(x)
                    yield pa.RecordBatch.from_pydict({"key": pa.array(key), "dims": pa.array(np.full(len(row), dims, np.int32)), "id": pa.array(ids[own][row]), "vec": pa.array([raw[i] for i in row.tolist()], pa.binary())})

    return vectors.select("id", "v").mapInArrow(run, "key long, dims int, id long, vec binary")


def _parts(members: DataFrame, rows: int) -> DataFrame:
    """(key, n, parts): each bucket's members, and into how many blocks of about `rows` it is cut."""
    return members.groupBy("key").agg(F.count("*").alias("n"), F.ceil(F.count("*") / rows).cast("int").alias("parts"))


def _heavy(parts: DataFrame) -> DataFrame:
    """(key, split) of the heavy buckets, fewer than HEAVY rows; the other ones are small against the whole."""
    whole = F.broadcast(parts.agg(F.sum("n").alias("all")))  # one row
    return F.broadcast(parts.crossJoin(whole).where(F.col("n") * HEAVY > F.col("all")).select("key", F.col("parts").alias("split")))


def _bucket_blocks(members: DataFrame, parts: DataFrame, ids: str, vecs: str, block: str) -> DataFrame:
    """(key, dims, block, ids, vecs): each bucket cut into its parts by a hash of the id; parts of a heavy one are dealt apart."""
    heavy, place = _heavy(parts), F.xxhash64("id", "vec")
    dealt = parts.join(heavy, "key", "left").select("key", "parts", F.explode(F.sequence(F.lit(0), F.coalesce("split", F.lit(1)) - 1)).alias("salt"))
    salted = members.join(heavy, "key", "left").withColumn("salt", F.coalesce(F.pmod(place, "split"), F.lit(0)).cast("int"))
    cut_up = salted.join(dealt, ["key", "salt"]).withColumn(block, F.pmod(place, "parts"))
    return cut_up.groupBy("key", "salt", "dims", block).agg(F.collect_list("id").alias(ids), F.collect_list("vec").alias(vecs)).drop("salt")


def _tiled(blocks: DataFrame, block: str, own: str, mine: DataFrame, other: str, theirs: DataFrame) -> DataFrame:
    """Blocks with their stretch of TILE blocks of the bucket (`own`), once for each stretch of the other side's (`other`).

    `mine` and `theirs` are the heavy buckets of both sides; any other bucket is one stretch.
    """
    stretch = F.when(F.col("split").isNull(), 0).otherwise(F.floor(F.col(block) / TILE)).cast("int")
    tiled = blocks.join(mine, "key", "left").withColumn(own, stretch).drop("split").join(theirs, "key", "left")
    stretches = F.sequence(F.lit(0), F.floor((F.coalesce("split", F.lit(1)) - 1) / TILE).cast("int"))
    return tiled.withColumn(other, F.explode(stretches)).drop("split")


def nearest(embeddings: DataFrame, queries: DataFrame, k: int = 10, id: str = "vec_id", vector: str = "embedding", tables: int = TABLES, hashes: int = HASHES, probes: int = PROBES, seed: int = 20) -> DataFrame:
    """Each query's k nearest found: (query_id, rank, vec_id, score), ties to the smaller vec_id.

    `queries` is a subset of `embeddings`; a vector whose id is the query's own is no candidate. Vectors that
    are null, empty, zero or hold null or non-finite components take no part; vectors of different lengths
    never meet. Of rows that repeat an id the nearest counts, and a repeated query row counts once. A query
    that found fewer than k goes through all vectors, so it gets k wherever there are k. An empty table gives
    no rows.
    """

    def clean(df: DataFrame) -> DataFrame:
        ok = df.where(usable(vector) & F.exists(vector, lambda x: x != 0) & F.col(id).isNotNull())
        return ok.select(F.col(id).cast("long").alias("id"), F.col(vector).cast("array<double>").alias("v"))

    all_vectors, asked = clean(embeddings), cut(clean(queries))
    width = cell_width(all_vectors)
    code = "<f4" if embeddings.schema[vector].dataType.elementType == FloatType() else "<f8"  # floats stay exact in four bytes

    def hashed(rows: DataFrame, probes: int) -> Callable[[bool], DataFrame]:
        return lambda full: _hashed(rows, tables, hashes, probes, width, seed, code if full else None)

    stored, visited = hashed(all_vectors, 0), hashed(asked, probes)
    # buckets' sizes are counted without the vectors
    v_parts, q_parts = cut(_parts(stored(False), BUCKET_ROWS)), cut(_parts(visited(False), BUCKET_ROWS))
    v_heavy, q_heavy = _heavy(v_parts), _heavy(q_parts)
    index = _tiled(_bucket_blocks(stored(True), v_parts, "ids", "vecs", "v_block"), "v_block", "v_tile", v_heavy, "q_tile", q_heavy)
    visits = _tiled(_bucket_blocks(visited(True), q_parts, "q_ids", "q_vecs", "q_block"), "q_block", "q_tile", q_heavy, "v_tile", v_heavy)
    met = visits.join(index, ["key", "dims", "q_tile", "v_tile"]).select("dims", "q_ids", "q_vecs", "ids", "vecs")

    def compare(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[tuple[np.ndarray, ...]] = []
        size = 0
        for batch in batches:
            for row in range(batch.num_rows):
                dims, q_ids, q_vecs, ids, vecs = (batch.column(c)[row].as_py() for c in range(5))
                q, v = (np.frombuffer(b"".join(x), code).reshape(-1, dims).astype(np.float64) for x in (q_vecs, vecs))
                held.append(_near(np.array(q_ids), q, np.array(ids), v, k))
                size += len(held[-1][0])
                if size > 200_000:
                    held = [_merge(held, k)]
                    yield _found(held.pop())
                    size = 0
        if held:
            yield _found(_merge(held, k))

    found = cut(met.mapInArrow(compare, "query_id long, vec_id long, score double"))
    ranked = _top(found, k)
    enough = ranked.groupBy("query_id").count().where(F.col("count") >= k)
    short = cut(asked.join(enough, asked.id == enough.query_id, "left_anti"))
    if not short.isEmpty():
        kernel = lambda q_ids, q, bodies: _merge([_near(q_ids, q, ids, v, k) for _, ids, v in bodies], k)
        rest = grid(blocks(short, Q_ROWS), blocks(all_vectors, V_ROWS), kernel, "double")
        ranked = ranked.join(short.select("id").distinct(), F.col("query_id") == F.col("id"), "left_anti").unionByName(_top(rest, k))
    return ranked.select("query_id", "rank", "vec_id", "score")


def _near(q_ids: np.ndarray, q: np.ndarray, ids: np.ndarray, v: np.ndarray, k: int) -> tuple[np.ndarray, ...]:
    """The k nearest of one block to each query of another.

    Squares by a matrix product are off by no more than `slack`; pairs that they can't rule out are measured by
    differences of the vectors themselves. Squares beyond a double's range rule nothing out.
    """
    by_id = np.argsort(ids, kind="stable")
    ids, v = ids[by_id], v[by_id]
    first = np.flatnonzero(np.r_[True, ids[1:] != ids[:-1]])
    other = q_ids[:, None] != ids[None]
    with np.errstate(over="ignore", invalid="ignore"):
        q2, v2 = (q**2).sum(1), (v**2).sum(1)
        rough = q2[:, None] + v2 - 2 * q @ v.T
        slack = 8 * (q.shape[1] + 8) * np.finfo(np.float64).eps * (q2 + v2.max())
    rough[~other] = np.inf
    limit = np.full(len(q), np.inf)
    if len(first) > k:  # rows that repeat an id count once
        limit = np.partition(np.minimum.reduceat(rough, first, axis=1), k - 1, axis=1)[:, k - 1] + 2 * slack
    a, b = np.nonzero(other & ~(rough > limit[:, None]))
    cost = np.concatenate([np.sqrt(((q[a[lo : lo + 8192]] - v[b[lo : lo + 8192]]) ** 2).sum(1)) for lo in range(0, max(1, len(a)), 8192)])
    q_of, v_of = q_ids[a], ids[b]
    top = best(q_of, v_of, cost, k)
    return q_of[top], v_of[top], cost[top]


def _merge(parts: list[tuple[np.ndarray, ...]], k: int) -> tuple[np.ndarray, ...]:
    q, v, cost = (np.concatenate(x) for x in zip(*parts, strict=True))
    top = best(q, v, cost, k)
    return q[top], v[top], cost[top]


def _found(x: tuple[np.ndarray, ...]) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array(x[0], pa.int64()), pa.array(x[1], pa.int64()), pa.array(x[2], pa.float64())], ["query_id", "vec_id", "score"])


def _top(found: DataFrame, k: int) -> DataFrame:
    once = found.groupBy("query_id", "vec_id").agg(F.min("score").alias("score"))
    rank = F.row_number().over(Window.partitionBy("query_id").orderBy("score", "vec_id"))
    return once.withColumn("rank", rank).where(F.col("rank") <= k)
