"""Scoring arithmetic as columns. Everything is DOUBLE: decimal literals would change results."""

from __future__ import annotations

from functools import lru_cache

from pyspark.sql import Column
from pyspark.sql import functions as F

from lodestone.functions.vectors import let

#: BM25 parameters, weights of a term's alternatives, and fusion constants.
K1, B = 1.2, 0.4
W_EXACT, W_STEM, W_PARTS, W_PART_STEM = 1.0, 1.0, 0.3, 0.5
ALPHA, RRF_K = 0.5, 60.0
EXACT_LENGTHS = 40


def d(x: Column | float) -> Column:
    return F.lit(float(x)) if isinstance(x, (int, float)) else x.cast("double")


def idf(n: Column, df: Column) -> Column:
    df = F.least(d(df), d(n))
    return F.log(d(1) + (d(n) - df + d(0.5)) / (df + d(0.5)))


def tf_factor(tf: Column, length: Column, average: Column, k1: float = K1, b: float = B) -> Column:
    """Saturating term frequency with length normalization; an average of zero leaves lengths out."""
    norm = F.when(d(average) > 0, d(1 - b) + d(b) * d(length) / d(average)).otherwise(d(1))
    return F.when(d(tf) > 0, d(tf) * d(k1 + 1) / (d(tf) + d(k1) * norm)).otherwise(d(0))


@lru_cache(maxsize=1)
def length_table() -> tuple[int, ...]:
    """256 length codes: exact up to EXACT_LENGTHS - 1, then steps of a 29th of the last, at least 1."""
    t = list(range(EXACT_LENGTHS))
    while len(t) < 256:
        t.append(t[-1] + max(1, t[-1] // 29))
    return tuple(t)


def length_array() -> Column:
    return F.expr("array(" + ",".join(map(str, length_table())) + ")")


def length_code(n: Column) -> Column:
    """The largest code whose length is at most n."""
    return let(n, lambda n: F.size(F.filter(length_array(), lambda x: x <= n)) - 1)


def decoded_length(n: Column) -> Column:
    """n as the code keeps it: rounded down to a length of the table."""

    def down(n: Column) -> Column:
        return F.when(n < EXACT_LENGTHS, n).otherwise(F.array_max(F.filter(length_array(), lambda x: x <= n))).cast("long")

    return let(n, down)


def convex(sim: Column, low: Column, high: Column, kw: Column, top: Column, alpha: float = ALPHA) -> Column:
    """Min-max similarity and keyword score over its maximum, weighed; degenerate ranges give 0."""
    v = F.when(high > low, (sim - low) / (high - low)).otherwise(d(0))
    k = F.when(top > 0, kw / top).otherwise(d(0))
    return d(1 - alpha) * F.coalesce(v, d(0)) + d(alpha) * F.coalesce(k, d(0))


def rrf(*ranks: Column, k: float = RRF_K) -> Column:
    """Sum of 1 / (k + rank); an absent rank adds nothing."""
    out = d(0)
    for r in ranks:
        out = out + F.coalesce(d(1) / (d(k) + d(r)), d(0))
    return out
