"""Spherical k-means: a sample drawn by hash, centres as mean directions, empty clusters begun again.

Everything that decides is a hash or a whole number, so a run gives the same centres on any number of tasks: sums
of directions are taken in fixed point, products are rounded before they are compared, ties go to the smaller cluster.
Centres (4,096 at most) travel to the tasks; a task returns one row of sums for each cluster that it has met.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: Sampled vectors for each centre, rounds of training, and centres that a vector is measured against.
PER_CENTER, ROUNDS, SHORTLIST = 32, 6, 8
#: Components of unit vectors count in these parts.
FIXED = 1 << 30


def draw(seed: str, id: str = "id") -> Column:
    """A hash of the id, in hexadecimal digits."""
    return F.md5(F.concat(F.lit(f"{seed}:"), F.col(id).cast("string")))


def sample(vectors: DataFrame, n: int, limit: int) -> DataFrame:
    """About `limit` of `n` vectors: those whose hash lies in the first part of its range; all if there are fewer."""
    share = F.conv(F.substring(draw("sample"), 1, 8), 16, 10).cast("double") / float(1 << 32)
    return vectors.where(share * n < limit) if n > limit else vectors


def _units(batch: pa.RecordBatch, dims: int) -> tuple[np.ndarray, np.ndarray]:
    """Rows of (id, embedding) that have a direction in `dims` dimensions, and these as unit vectors."""
    lists = batch.column(1)
    size = lists.value_lengths().fill_null(-1).to_numpy(zero_copy_only=False).astype(np.int64)
    flat = lists.flatten().to_numpy(zero_copy_only=False).astype(np.float64)
    own = np.flatnonzero(size == dims)
    held = np.maximum(size, 0)
    x = flat[(np.cumsum(held) - held)[own][:, None] + np.arange(dims)]
    norm = np.sqrt((x * x).sum(1))
    good = np.isfinite(norm) & (norm > 0)
    return own[good], x[good] / norm[good, None]


def _bits(x: np.ndarray) -> np.ndarray:
    """Sign codes as rows of 64-bit words."""
    positive = np.pad(x > 0, ((0, 0), (0, -x.shape[1] % 64)))
    return np.packbits(positive, axis=1, bitorder="little").view("<u8")


def nearest(x: np.ndarray, centers: np.ndarray, shortlist: int | None = None) -> np.ndarray:
    """The centre of the largest product with each row, to six decimals, ties to the smaller number.

    With a shortlist only that many centres are measured: those of the fewest differing sign bits, ties to the smaller number.
    """
    if shortlist is None or shortlist >= len(centers):
        return np.round(x @ centers.T, 6).argmax(1)
    out, words = np.zeros(len(x), np.int64), _bits(centers)
    for lo in range(0, len(x), 1024):
        part = x[lo : lo + 1024]
        apart = sum(np.bitwise_count(a[:, None] ^ b[None, :]).astype(np.int64) for a, b in zip(_bits(part).T, words.T, strict=True))
        few = np.sort(np.argsort(apart * len(centers) + np.arange(len(centers)), axis=1)[:, :shortlist], axis=1)
        products = np.round(np.einsum("ij,ikj->ik", part, centers[few]), 6)
        out[lo : lo + 1024] = few[np.arange(len(part)), products.argmax(1)]
    return out


def _collected(rows: DataFrame, dims: int) -> np.ndarray:
    """A bounded number of vectors in their order, as unit vectors."""
    x = np.array([r.embedding for r in rows.collect()], np.float64).reshape(-1, dims)
    return x / np.sqrt((x * x).sum(1))[:, None]


def directed(vectors: DataFrame, dims: int) -> DataFrame:
    """(id, embedding) of the vectors of `dims` components, all finite and not all of them zero."""
    square = F.aggregate("embedding", F.lit(0.0), lambda a, x: a + x.cast("double") * x.cast("double"))
    return vectors.select("id", "embedding").where((F.size("embedding") == dims) & (square > 0) & (square < float("inf")))


def round_of(drawn: DataFrame, centers: np.ndarray, number: int) -> np.ndarray:
    """Centres after one more round over the drawn vectors. Empty clusters, in order, begin again on the drawn vectors
    of the least hashes of this round.
    """
    k, dims = centers.shape

    def sums(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros((k, dims), np.int64)
        seen = np.zeros(k, bool)
        for batch in batches:
            _, x = _units(batch, dims)
            own = nearest(x, centers)
            by = np.argsort(own, kind="stable")
            met, first = np.unique(own[by], return_index=True)
            if len(met):
                total[met] += np.add.reduceat(np.floor(x[by] * FIXED + 0.5).astype(np.int64), first)
                seen[met] = True
        met = np.flatnonzero(seen)
        yield pa.RecordBatch.from_pydict({"cluster": pa.array(met, pa.int32()), "sums": pa.array([r.tobytes() for r in total[met]], pa.binary())})

    def added(group: pa.Table) -> pa.Table:
        both = sum(np.frombuffer(r.as_py(), np.int64) for r in group.column("sums"))
        return pa.table({"cluster": group.column("cluster").slice(0, 1), "sums": pa.array([both.tobytes()], pa.binary())})

    each = drawn.mapInArrow(sums, "cluster int, sums binary").groupBy("cluster").applyInArrow(added, "cluster int, sums binary")
    new, filled = centers.copy(), np.zeros(k, bool)
    for r in each.collect():  # a row for each centre
        s = np.frombuffer(r.sums, np.int64).astype(np.float64)
        length = np.sqrt((s * s).sum())
        if length > 0:
            new[r.cluster], filled[r.cluster] = s / length, True
    empty = np.flatnonzero(~filled)
    if len(empty):
        again = _collected(drawn.orderBy(draw(f"round{number}"), "id").limit(len(empty)), dims)
        new[empty[: len(again)]] = again
    return new


def train(vectors: DataFrame, k: int, dims: int, rounds: int = ROUNDS, per_center: int = PER_CENTER) -> np.ndarray:
    """k centres, or as many as there are vectors with a direction; `vectors` is (id, embedding)."""
    held = directed(vectors, dims)
    drawn = sample(held, held.count(), per_center * k)
    centers = _collected(drawn.orderBy(draw("start"), "id").limit(k), dims)
    for number in range(rounds if len(centers) else 0):
        centers = round_of(drawn, centers, number)
    return centers


def assign(vectors: DataFrame, centers: np.ndarray, shortlist: int | None = SHORTLIST) -> DataFrame:
    """`vectors` (id, embedding, more) that have a direction, with their `cluster`; a map without a shuffle."""
    dims = centers.shape[1]
    source = vectors.select("id", "embedding", *(c for c in vectors.columns if c not in ("id", "embedding", "cluster")))
    names = [*source.columns, "cluster"]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            own, x = _units(batch, dims)
            kept = batch.take(pa.array(own))
            yield pa.RecordBatch.from_arrays([*kept.columns, pa.array(nearest(x, centers, shortlist), pa.int32())], names)

    return source.mapInArrow(run, source.select("*").schema.add("cluster", "integer"))
