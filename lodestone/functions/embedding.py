"""A hashing embedder: deterministic vectors for texts, without a model."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F


def fnv1a_32(data: bytes) -> int:
    h = 0x811C9DC5
    for b in data:
        h = ((h ^ b) * 0x01000193) & 0xFFFFFFFF
    return h


def fnv1a_64(data: bytes) -> int:
    h = 0xCBF29CE484222325
    for b in data:
        h = ((h ^ b) * 0x100000001B3) & 0xFFFFFFFFFFFFFFFF
    return h


def hash_embed(text: Column, dims: int) -> Column:
    """Counts of words (runs of letters and digits, lower case) by hash, normalised; no word gives the first axis."""

    @F.pandas_udf("array<float>")
    def embed(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        seen: dict[str, int] = {}
        for texts in batches:
            out = []
            for t in texts:
                v = np.zeros(dims, np.float32)
                for w in "".join(c if c.isalnum() else " " for c in (t or "").lower()).split():
                    i = seen.get(w)
                    if i is None:
                        i = fnv1a_32(w.encode()) % dims
                        if len(seen) < 200_000:
                            seen[w] = i
                    v[i] += 1
                n = float(np.sqrt((v.astype(np.float64) ** 2).sum()))
                if n:
                    v = (v / n).astype(np.float32)
                else:
                    v[0] = 1
                out.append(v)
            yield pd.Series(out)

    return embed(text)


def decode_f16(raw: Column) -> Column:
    """Little-endian half floats as floats; null for an odd length or a value that isn't finite."""

    @F.pandas_udf("array<float>")
    def decode(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        for s in batches:
            out = []
            for b in s:
                v = np.frombuffer(b, "<f2").astype(np.float32) if b is not None and len(b) % 2 == 0 and len(b) else None
                out.append(v if v is not None and np.isfinite(v).all() else None)
            yield pd.Series(out)

    return decode(raw)


def encode_f16(vector: Column) -> Column:
    @F.pandas_udf("binary")
    def encode(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        for s in batches:
            yield s.map(lambda v: None if v is None else np.asarray(v, np.float32).astype("<f2").tobytes())

    return encode(vector)


def decode_query_vector(encoded: Column) -> Column:
    """A vector sent as unpadded URL-safe base64 of half floats."""
    return decode_f16(F.unbase64(F.translate(encoded, "-_", "+/")))
