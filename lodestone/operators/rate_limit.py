"""Token buckets: a call takes one token if there is one, and a refused call takes nothing.

Tokens are counted in whole units, so results are exact: one token is 1000 * `seconds` units, and each millisecond
brings `tokens` units, up to `burst` tokens.

Whether a call passes depends on all calls before it. A key's calls are therefore cut into chunks. The first pass makes
each chunk of a key with several of them a table: from every level that the bucket may have when the chunk begins
to the level that it has at the end. Few levels stay apart for long, so a table costs little more than one
walk. Tables are chained, a small row for each chunk; then every chunk is folded from its own first level, all at the same time.
No key's calls lie in one task together.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lodestone.operators.running import running

#: Refill of `TOKENS` every `SECONDS` seconds, and what a bucket holds.
TOKENS, SECONDS, BURST = 2, 1, 20
#: Calls in a chunk.
CHUNK = 1 << 16
#: Milliseconds in a bucket of the order by which calls are numbered.
SPAN_MS = 60_000


def step(level: int, wait_ms: int, unit: int, tokens: int, full: int) -> tuple[int, bool]:
    """The level after a call that comes `wait_ms` after the one before, and whether it passes."""
    level = min(full, level + max(0, wait_ms) * tokens)
    return (level - unit, True) if level >= unit else (level, False)


def level_table(ms: np.ndarray, unit: int, tokens: int, full: int) -> np.ndarray:
    """For every level at the first call's time (refilled), the level after the last call."""
    held, which = np.arange(full + 1), np.arange(full + 1)
    waits = np.maximum(np.diff(ms, prepend=ms[:1]), 0) * tokens
    for i, wait in enumerate(waits.tolist()):
        held = np.minimum(held + wait, full)
        held = np.where(held >= unit, held - unit, held)
        if i & 31 == 31 or i < 2:  # levels that have met stay together
            held, at = np.unique(held, return_inverse=True)
            which = at[which]
    return held[which]


def _numbered(calls: DataFrame, key: str, ms: str, id: str, chunk: int) -> DataFrame:
    """(key, ms, id, chunk, n) of rows with a key and a time, n their number within the key."""
    rows = calls.where(F.col(key).isNotNull() & F.col(ms).isNotNull()).select(F.col(key).alias("key"), F.col(ms).cast("long").alias("ms"), F.col(id).alias("id"))
    return running(rows, ["key"], ["ms", "id"], F.floor(F.col("ms") / SPAN_MS)).withColumn("chunk", F.floor((F.col("n") - 1) / chunk))


def _entries(numbered: DataFrame, chunk: int, unit: int, tokens: int, full: int) -> DataFrame:
    """(key, chunk, level, at): level after the last call before each chunk but a key's first, and that call's time."""
    many = numbered.where("chunk > 0").select("key").distinct()
    inside = numbered.join(many, "key", "left_semi")
    calls = inside.groupBy("key", "chunk").agg(F.array_sort(F.collect_list(F.struct("ms", "id"))).alias("c")).select("key", "chunk", F.col("c.ms").alias("ms"))  # a chunk
    schema = calls.select("key", "chunk").schema.add("first", "long").add("last", "long").add("levels", "binary")

    def tables(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for i in range(batch.num_rows):
                ms = batch.column(2)[i].values.to_numpy()
                raw = level_table(ms, unit, tokens, full).astype("<i4").tobytes()
                yield pa.RecordBatch.from_arrays([batch.column(0).slice(i, 1), batch.column(1).slice(i, 1), pa.array(ms[:1]), pa.array(ms[-1:]), pa.array([raw], pa.binary())], ["key", "chunk", "first", "last", "levels"])

    linked = calls.mapInArrow(tables, schema).repartition("key").sortWithinPartitions("key", "chunk")
    out_schema = calls.select("key", "chunk").schema.add("level", "long").add("at", "long")

    def chain(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held, level, at = None, full, 0
        for batch in batches:
            keys, firsts, lasts = (batch.column(c).to_pylist() for c in (0, 2, 3))
            levels, ats = [], []
            for i, key in enumerate(keys):
                level, at, held = (full, firsts[i], key) if key != held else (level, at, held)
                begin = min(full, level + max(0, firsts[i] - at) * tokens)
                level, at = int(np.frombuffer(batch.column(4)[i].as_py(), "<i4")[begin]), lasts[i]
                levels.append(level)
                ats.append(at)
            after = pa.array([c + 1 for c in batch.column(1).to_pylist()], pa.int64())
            yield pa.RecordBatch.from_arrays([batch.column(0), after, pa.array(levels, pa.int64()), pa.array(ats, pa.int64())], ["key", "chunk", "level", "at"])

    return linked.mapInArrow(chain, out_schema)


def token_bucket(calls: DataFrame, key: str, ms: str, id: str, tokens: int = TOKENS, seconds: int = SECONDS, burst: int = BURST, chunk: int = CHUNK) -> DataFrame:
    """(key, ms, id, allowed, left): each call in the order of (ms, id) within its key, and the tokens left after it.

    Buckets begin full. Calls without a key or a time are left out; repeated calls count each.
    """
    unit, full = 1000 * seconds, 1000 * seconds * burst
    numbered = _numbered(calls, key, ms, id, chunk)
    held = numbered.join(_entries(numbered, chunk, unit, tokens, full), ["key", "chunk"], "left")
    rows = held.select("key", "chunk", "n", "ms", "id", "level", "at")
    schema = rows.select("key", "ms", "id").schema.add("allowed", "boolean").add("left", "double")

    # A grouping, not a repartition: after a join by the same columns Spark drops a repartition, and the join may then be
    # run as a broadcast that leaves the rows where they are.
    def fold(calls: pa.Table) -> pa.Table:
        calls = calls.sort_by("n")
        level, at = (calls.column(c)[0].as_py() for c in ("level", "at"))
        times = calls.column("ms").to_pylist()
        level, at = (full, times[0]) if level is None else (level, at)
        passed, left = [], []
        for t in times:
            level, ok = step(level, t - at, unit, tokens, full)
            at = max(at, t)
            passed.append(ok)
            left.append(level / unit)
        return calls.select(["key", "ms", "id"]).append_column("allowed", pa.array(passed, pa.bool_())).append_column("left", pa.array(left, pa.float64()))

    return rows.groupBy("key", "chunk").applyInArrow(fold, schema)
