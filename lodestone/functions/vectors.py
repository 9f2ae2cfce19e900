"""Vector columns: normalisation, 1-bit and int8 codes, distances."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column
from pyspark.sql import functions as F


def let(value: Column, body) -> Column:
    """body(value) with the value computed once, also where the body uses it inside a lambda."""
    return F.element_at(F.transform(F.array(value), body), 1)


def doubles(values: Sequence[float]) -> Column:
    """A literal array of doubles."""
    return F.expr("array(" + ",".join(f"{float(x)!r}D" for x in values) + ")")


def as_double(v: Column | str) -> Column:
    return F.transform(v, lambda x: x.cast("double"))


def norm(v: Column | str) -> Column:
    return F.sqrt(F.aggregate(v, F.lit(0.0), lambda a, x: a + x.cast("double") * x.cast("double")))


def normalized(v: Column | str) -> Column:
    """Unit length; null for a zero or non-finite norm."""
    v = F.col(v) if isinstance(v, str) else v

    def scaled(s: Column) -> Column:
        ok = (s["n"] > 0) & (s["n"] < float("inf")) & ~F.isnan(s["n"])
        return F.when(ok, F.transform(s["v"], lambda x: x.cast("double") / s["n"]))

    return let(v, lambda v: let(F.struct(v.alias("v"), norm(v).alias("n")), scaled))


def dot(a: Column | str, b: Column | str) -> Column:
    return F.aggregate(F.zip_with(a, b, lambda x, y: x.cast("double") * y.cast("double")), F.lit(0.0), lambda s, x: s + x)


def sign_word(v: Column | str, word: int = 0) -> Column:
    """Bits 64 * word to 64 * word + 63 of the sign code as a long: bit i is set if component i is over 0."""
    part = F.slice(v, word * 64 + 1, 64)
    return F.aggregate(F.transform(part, lambda x, i: F.when(x > 0, F.call_function("shiftleft", F.lit(1).cast("long"), i)).otherwise(F.lit(0).cast("long"))), F.lit(0).cast("long"), lambda a, x: a.bitwiseOR(x))


def sign_words(v: Column | str, dims: int) -> Column:
    return F.array(*(sign_word(v, w) for w in range(-(-dims // 64))))


def hamming(a: Column, b: Column) -> Column:
    """Differing bits of two arrays of longs."""
    return F.aggregate(F.zip_with(a, b, lambda x, y: F.bit_count(x.bitwiseXOR(y))), F.lit(0), lambda s, x: s + x)


def int8_scale(v: Column | str) -> Column:
    """max |x| / 127 as a float."""
    top = F.array_max(F.transform(v, lambda x: F.abs(x)))
    return (top.cast("double") / F.lit(127.0)).cast("float")


def int8_code(v: Column | str, scale: Column) -> Column:
    """Each component over the scale, rounded half away from zero, within -127..127."""
    def code(s: Column) -> Column:
        def one(x: Column) -> Column:
            q = (x.cast("double") / s.cast("double")).cast("float").cast("double")
            return F.greatest(F.lit(-127), F.least(F.lit(127), F.round(q).cast("int")))

        return F.when(s > 0, F.transform(v, one)).otherwise(F.transform(v, lambda x: F.lit(0)))

    return let(scale, code)


def int8_dot(query: Sequence[float], code: Column, scale: Column) -> Column:
    """Product of a query vector of floats with a code."""
    return F.aggregate(F.zip_with(doubles(query), code, lambda x, y: x * y.cast("double")), F.lit(0.0), lambda s, x: s + x) * scale.cast("double")


def cosine_estimate(distance: Column, dims: int) -> Column:
    """Cosine that a Hamming distance of 1-bit codes suggests."""
    return F.cos(F.lit(3.141592653589793) * distance.cast("double") / F.lit(float(dims)))
