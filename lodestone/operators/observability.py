"""Counters and histograms as a dashboard reads them: increases over windows, quantiles out of cumulative buckets."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from lodestone.functions.scores import d
from lodestone.functions.vectors import let


def increase(samples: DataFrame, series: Sequence[str], at: str, value: str, window: int) -> DataFrame:
    """(series, end, n, increase): how much each counter has grown in the windows that end at multiples of `window`.

    A window holds the samples in (end - window, end], times in whole units. A fall is a reset, after which the counter
    begins at zero. What was seen is carried on to the window's ends: by the time to the end, or by half the
    mean distance of samples if the end lies farther off than 1.1 of it, and at the start never beyond where the counter was
    zero. Windows of fewer than two samples have no increase. Samples without a time or a value are left out; a
    time that repeats counts once, with its largest value.
    """
    end = F.ceil(F.col(at) / window) * window
    once = samples.where(F.col(at).isNotNull() & F.col(value).isNotNull()).groupBy(*series, F.col(at).cast("long").alias("__at"), end.cast("long").alias("end")).agg(F.max(F.col(value).cast("double")).alias("__v"))
    held = once.groupBy(*series, "end").agg(F.array_sort(F.collect_list(F.struct(F.col("__at").alias("at"), F.col("__v").alias("v")))).alias("__s"))  # a window's samples
    fall = lambda a, b: F.when(b["v"] < a["v"], b["v"]).otherwise(b["v"] - a["v"])
    steps = F.zip_with(F.slice("__s", 1, F.size("__s") - 1), F.slice("__s", 2, F.size("__s") - 1), fall)
    known = held.where(F.size("__s") > 1).select(
        *series,
        "end",
        F.size("__s").cast("long").alias("n"),
        F.aggregate(steps, d(0), lambda a, x: a + x).alias("seen"),
        F.element_at("__s", 1).alias("first"),
        F.element_at("__s", -1).alias("last"),
    )
    span = d(F.col("last.at") - F.col("first.at"))
    each = span / d(F.col("n") - 1)
    near = lambda gap: F.when(gap < each * 1.1, gap).otherwise(each / 2)
    before, after = near(d(F.col("first.at") - (F.col("end") - window))), near(d(F.col("end") - F.col("last.at")))
    to_zero = F.when((F.col("seen") > 0) & (F.col("first.v") >= 0), span * F.col("first.v") / F.col("seen"))
    before = F.when(to_zero < before, to_zero).otherwise(before)
    return known.select(*series, "end", "n", (F.col("seen") * (span + before + after) / span).alias("increase"))


def histogram_quantile(buckets: DataFrame, group: Sequence[str], quantiles: Sequence[float], le: str = "le", n: str = "n") -> DataFrame:
    """(group, quantile, value) from cumulative counts `n` of values up to `le`, the last one infinite.

    Within a bucket values are taken as evenly spread, from zero in the first. A quantile in the infinite bucket is the
    largest finite bound. A group without an infinite bucket, with no other, or without values has none (null), and so has a null
    quantile; below 0 and above 1 it is infinite. Counts that fall along the bounds are lifted to the largest before them.
    """
    both = F.struct(F.col(le).cast("double").alias("le"), F.col(n).cast("double").alias("n"))
    per = buckets.where(F.col(le).isNotNull()).groupBy(*group, F.col(le)).agg(F.sum(n).alias(n)).groupBy(*group).agg(F.array_sort(F.collect_list(both)).alias("__b"))  # bounds are few
    lifted = F.transform("__b", lambda x, i: F.named_struct(F.lit("le"), x["le"], F.lit("n"), F.array_max(F.transform(F.slice("__b", 1, i + 1), lambda y: y["n"]))))
    asked = per.select(*group, lifted.alias("__b"), F.explode(F.array(*(F.lit(q).cast("double") for q in quantiles))).alias("quantile"))

    def inside(b: Column) -> Column:
        total, top = F.element_at(b, -1)["n"], F.element_at(b, -1)["le"]
        rank = F.col("quantile") * total
        at = F.size(F.filter(b, lambda x: x["n"] < rank))  # buckets that end before the rank
        here, last = F.get(b, at), F.get(b, at - 1)
        low, count = F.when(at > 0, last["le"]).otherwise(d(0)), F.when(at > 0, last["n"]).otherwise(d(0))
        even = low + (here["le"] - low) * (rank - count) / (here["n"] - count)
        value = F.when(here["le"] == float("inf"), F.element_at(b, -2)["le"]).when((at == 0) & (here["le"] <= 0), here["le"]).when(here["n"] == count, low).otherwise(even)
        return F.when((F.size(b) < 2) | (top != float("inf")) | (total <= 0), F.lit(None)).when(F.col("quantile") < 0, d(float("-inf"))).when(F.col("quantile") > 1, d(float("inf"))).otherwise(value)

    return asked.select(*group, "quantile", let(F.col("__b"), inside).alias("value"))
