"""Shared helpers: reading tables, cutting lineage on shared storage, ragged text arrays."""

from __future__ import annotations

import re
import tempfile
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def shared_folder(spark: SparkSession) -> str:
    """The folder that the session names in spark.checkpoint.dir; a temporary one where it names none and all runs in
    one process (tests); else an error, as executors don't see each other's folders.
    """
    named = spark.conf.get("spark.checkpoint.dir", None)
    if named:
        return named.rstrip("/")
    master = spark.sparkContext.master
    if not re.fullmatch(r"local(\[.*\])?", master):
        raise RuntimeError(f"set spark.checkpoint.dir to a folder that all executors of {master} share")
    return tempfile.mkdtemp(prefix="spark-shared-")


def cut(df: DataFrame) -> DataFrame:
    """A reliable checkpoint in the shared folder.

    With spark.cleaner.referenceTracking.cleanCheckpoints Spark deletes it once the result is out of use.
    """
    sc = df.sparkSession.sparkContext
    if sc.getCheckpointDir() is None:
        sc.setCheckpointDir(shared_folder(df.sparkSession))
    return df.checkpoint()


def runs(texts: list[str], limit: int = 1 << 21) -> Iterator[tuple[int, int]]:
    """Ranges of `texts` of about `limit` characters each; a longer text is a range of its own."""
    lo = size = 0
    for i, t in enumerate(texts):
        if size and size + len(t) > limit:
            yield lo, i
            lo, size = i, 0
        size += len(t)
    if lo < len(texts):
        yield lo, len(texts)


def whole_groups(batches: Iterator[pa.RecordBatch], least: int) -> Iterator[pa.Table]:
    """Runs of rows of about `least` bytes that never split a group; rows are sorted by the first column, a long."""
    held, size = [], 0
    for batch in batches:
        held.append(batch)
        size += batch.nbytes
        if size >= least:
            rows = pa.Table.from_batches(held)
            group = rows.column(0).to_numpy()
            n = int(np.searchsorted(group, group[-1])) if len(group) else 0
            if n:
                yield rows.slice(0, n)
                held = rows.slice(n).combine_chunks().to_batches()
                size = sum(b.nbytes for b in held)
    if size:
        yield pa.Table.from_batches(held)


def codepoints(texts: list[str]) -> tuple[np.ndarray, np.ndarray]:
    """All code points in one array, and where each text starts (one more entry at the end)."""
    ends = np.zeros(len(texts) + 1, np.int64)
    np.cumsum(np.fromiter(map(len, texts), np.int64, len(texts)), out=ends[1:])
    return np.frombuffer("".join(texts).encode("utf-32-le", "surrogatepass"), np.uint32), ends


def ranges(starts: np.ndarray, lengths: np.ndarray) -> np.ndarray:
    """The indices start, start + 1, ... of every range, one range after the other."""
    ends = np.cumsum(lengths)
    if not len(ends) or not ends[-1]:
        return np.zeros(0, np.int64)
    return np.repeat(starts - ends + lengths, lengths) + np.arange(ends[-1])


_POWERS = np.zeros(0, np.uint64)


def _powers(n: int) -> np.ndarray:
    """Fixed odd random multipliers, one for each position in a word."""
    global _POWERS
    if len(_POWERS) < n:
        _POWERS = np.random.default_rng(20240607).integers(1, 1 << 63, max(n, 256), dtype=np.uint64) * np.uint64(2) + np.uint64(1)
    return _POWERS


def mix(x: np.ndarray) -> np.ndarray:
    """The splitmix64 finaliser."""
    x = x ^ (x >> np.uint64(30))
    x = x * np.uint64(0xBF58476D1CE4E5B9)
    x = x ^ (x >> np.uint64(27))
    x = x * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


def segment_hashes(codes: np.ndarray, starts: np.ndarray, lengths: np.ndarray) -> np.ndarray:
    """64-bit hashes of adjacent segments that cover `codes`; each length is 1 or more."""
    if not len(starts):
        return np.zeros(0, np.uint64)
    at = np.arange(len(codes)) - np.repeat(starts, lengths)
    weighed = (codes.astype(np.uint64) + np.uint64(0x9E3779B97F4A7C15)) * _powers(int(lengths.max()))[at]
    weighed ^= weighed >> np.uint64(29)
    return mix(np.add.reduceat(weighed, starts) + lengths.astype(np.uint64) * np.uint64(0xD1B54A32D192ED03))


def sums_between(values: np.ndarray, bounds: np.ndarray) -> np.ndarray:
    """Sums of values[bounds[i]:bounds[i + 1]]; empty ranges give 0."""
    total = np.zeros(len(values) + 1, values.dtype if values.dtype.kind == "f" else np.int64)
    np.cumsum(values, out=total[1:])
    return total[bounds[1:]] - total[bounds[:-1]]
