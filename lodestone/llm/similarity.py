"""Exact links between texts by the Jaccard similarity of their shingle sets, within proposed components."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lodestone.llm.common import cut, ranges, runs, sums_between, whole_groups

#: Shingles of one block; components with more are dealt out as pairs of blocks.
BLOCK_SHINGLES = 1 << 19


def alike(ids: np.ndarray, bounds: np.ndarray, similarity: float, block: np.ndarray | None = None) -> np.ndarray:
    """For sets of small integers, one after the other: the first set of each one's component.

    Sets of n members, in order of rarity, that are similar enough share one of their first
    n - ceil(similarity * n) + 1. So only sets that share such a member are compared: each in turn is marked in a
    table and counted against the others there that are not in its component yet and whose size allows
    the similarity. After a few, which unite near copies, a pair counts only under the rarest member that it shares,
    so that none is compared again and again. With `block`, only sets of different blocks are compared.
    """
    size = np.diff(bounds)
    root = np.arange(len(size))
    if not len(ids):
        return root
    often = np.bincount(ids)
    rarity = np.empty(len(often), np.int64)
    rarity[np.argsort(often, kind="stable")] = np.arange(len(often))
    owner = np.repeat(root, size)
    ids = rarity[ids]
    ids = ids[np.lexsort((ids, owner))]
    place = np.arange(len(ids)) - np.repeat(bounds[:-1], size)
    head = place < np.repeat(size - np.ceil(similarity * size - 1e-9).astype(np.int64) + 1, size)
    by = np.lexsort((owner[head], ids[head]))
    member, of, at = ids[head][by], owner[head][by], place[head][by]
    starts = np.flatnonzero(np.r_[True, member[1:] != member[:-1]])
    count = np.diff(np.r_[starts, len(member)])
    marked = np.zeros(len(often), bool)
    shared_groups = np.flatnonzero(count > 1)
    for g in shared_groups[np.argsort(-count[shared_groups], kind="stable")].tolist():
        sets, places = of[starts[g] : starts[g] + count[g]], at[starts[g] : starts[g] + count[g]]
        turn = 0
        while len(sets) > 1 and (root[sets] != root[sets[0]]).any():
            i, p, sets, places = sets[0], places[0], sets[1:], places[1:]
            turn += 1
            ratio = np.minimum(size[sets], size[i]) / np.maximum(size[sets], size[i])
            want = (root[sets] != root[i]) & (ratio >= similarity)
            if block is not None:
                want &= block[sets] != block[i]
            other, before = sets[want], places[want]
            if turn > 4 and p and len(other):
                marked[ids[bounds[i] : bounds[i] + p]] = True
                sooner = sums_between(marked[ids[ranges(bounds[other], before)]].astype(np.int64), np.r_[0, np.cumsum(before)]) > 0
                marked[ids[bounds[i] : bounds[i] + p]] = False
                other = other[~sooner]
            if not len(other):
                continue
            own = ids[bounds[i] : bounds[i + 1]]
            marked[own] = True
            shared = np.add.reduceat(marked[ids[ranges(bounds[other], size[other])]], np.cumsum(size[other]) - size[other], dtype=np.int64)
            marked[own] = False
            hit = other[shared / (size[i] + size[other] - shared) >= similarity]
            if len(hit):
                roots = np.unique(np.r_[root[hit], root[i]])
                into = np.arange(len(root))
                into[roots] = roots[0]
                root = into[root]
    return root


def similar_links(members: DataFrame, texts: DataFrame, sets: Callable[[list[str]], tuple[np.ndarray, np.ndarray]], similarity: float) -> DataFrame:
    """Edges (a, b) that connect what is alike within the components of `members` (set_key, root, n_shingles, __text_key).

    `texts` has (text, __text_key); `sets` gives sorted hashes of each text's shingles and where each text's begin.
    Each member's text is read once and its set sent to its component's task; a component of more than
    BLOCK_SHINGLES goes to a task for each pair of its blocks, so no task holds more than two blocks (or two
    sets, if longer), and no pair is left out.
    """
    large = cut(members.groupBy("root").agg(F.ceil(F.sum("n_shingles") / BLOCK_SHINGLES).cast("int").alias("blocks")).where("blocks > 1"))
    members = members.join(large, "root", "left").withColumn("blocks", F.coalesce("blocks", F.lit(1))) if not large.isEmpty() else members.withColumn("blocks", F.lit(1))
    members = members.select("set_key", "root", "blocks", "__text_key", F.pmod(F.xxhash64("set_key", F.lit(7)), "blocks").cast("int").alias("block"))
    met = texts.join(members, "__text_key").dropDuplicates(["__text_key"]).select("set_key", "root", "blocks", "block", "text")

    def gather(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            own = batch.column(4).to_pylist()
            for a, b in runs(own):
                h, at = sets(own[a:b])
                packed = pa.array([h[i:j].tobytes() for i, j in zip(at[:-1].tolist(), at[1:].tolist(), strict=True)], pa.binary())
                part = batch.slice(a, b - a)
                yield pa.RecordBatch.from_arrays([*part.columns[:4], packed], [*part.schema.names[:4], "shingles"])

    rows = met.mapInArrow(gather, "set_key binary, root binary, blocks int, block int, shingles binary")
    rows = rows.withColumn("other", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)))
    pair = F.xxhash64("root", F.least("block", "other"), F.greatest("block", "other"))
    # blocks of a pair are told apart; within a block of its own all rows are compared
    rows = rows.select(pair.alias("node"), F.when(F.col("block") != F.col("other"), F.col("block")).otherwise(F.lit(-1)).alias("block"), "set_key", "shingles")

    def judge(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for found in whole_groups(batches, 4 << 20):
            node, block = found.column(0).to_numpy(), found.column(1).to_numpy()
            held = found.column(3).to_pylist()
            keys = found.column(2).combine_chunks()
            starts = np.flatnonzero(np.r_[True, node[1:] != node[:-1]])
            first, then = [], []
            for s, e in zip(starts.tolist(), [*starts[1:].tolist(), len(node)], strict=True):
                raw = np.frombuffer(b"".join(held[s:e]), np.uint64)
                bounds = np.cumsum([0, *(len(x) // 8 for x in held[s:e])])
                root = alike(np.unique(raw, return_inverse=True)[1], bounds, similarity, block[s:e] if block[s] >= 0 else None)
                moved = np.flatnonzero(root != np.arange(e - s))
                first.append(s + root[moved])
                then.append(s + moved)
            if first:
                yield pa.RecordBatch.from_arrays([keys.take(pa.array(np.concatenate(first))), keys.take(pa.array(np.concatenate(then)))], ["a", "b"])

    return rows.repartition("node").sortWithinPartitions("node").mapInArrow(judge, "a binary, b binary")
