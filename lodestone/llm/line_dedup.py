"""Cross-site boilerplate lines, by distinct-site spread; DataFrame functions only.

For each line a HyperLogLog sketch of its sites is merged by aggregation, before and after the shuffle.
Lines whose estimate is well over the threshold are boilerplate; those near it get an exact distinct count.
Boilerplate stays in one document (the smallest doc_id that has it) and goes from all others.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from lodestone.llm.common import cut

#: A line on so many distinct sites is boilerplate. Ordinary copies of documents lie on two to four sites whatever the
#: input's size, so five is the fewest that tells them apart; a passage in few documents, or one beside a site that
#: holds much of the rows, reaches no more. The keeper holds each line still, so no text is lost.
MIN_SITES = 5
#: Sketch size (2**LG_K cells, standard error about 1.6 %), and the share around the threshold that is counted exactly.
LG_K, NEAR = 12, 0.25


def _lines(text: str) -> Column:
    return F.split(F.col(text), "\n", -1)


def _key(line: Column) -> Column:
    """128 bits, so that no two lines of a large corpus share one."""
    return F.unhex(F.md5(F.trim(line)))


def _occurrences(docs: DataFrame, site: str, text: str) -> DataFrame:
    own = F.array_distinct(F.transform(_lines(text), lambda x: F.trim(x)))  # strings, which Spark tells apart by hash
    keys = F.transform(F.filter(own, lambda x: x != ""), _key)
    return docs.select("doc_id", F.coalesce(F.col(site), F.lit("")).alias("site"), F.explode(keys).alias("line"))


def _row(text: str) -> Column:
    """What rows with the same lines to lose share: 128 bits of the id and the text."""
    return F.unhex(F.md5(F.concat(F.coalesce(F.col("doc_id").cast("string"), F.lit("")), F.lit("\n"), F.coalesce(F.col(text), F.lit("")))))


def boilerplate(docs: DataFrame, min_sites: int = MIN_SITES, site: str = "source", text: str = "text") -> DataFrame:
    """(line, keeper): hash of each line on min_sites or more sites, and the smallest doc_id that has it."""
    seen = _occurrences(docs, site, text)
    spread = seen.groupBy("line").agg(F.hll_sketch_agg("site", F.lit(LG_K)).alias("sites"), F.min("doc_id").alias("keeper"))
    likely = cut(spread.select("line", "keeper", F.hll_sketch_estimate("sites").alias("n")).where(F.col("n") >= min_sites * (1 - NEAR)))
    sure = likely.where(F.col("n") > min_sites * (1 + NEAR)).select("line", "keeper")
    near = likely.where(F.col("n") <= min_sites * (1 + NEAR)).select("line", "keeper")
    # a very common line is a row for each site before it meets the join
    pairs = seen.select("line", "site").distinct().join(near, "line")
    exact = pairs.groupBy("line", "keeper").agg(F.count("*").alias("n")).where(F.col("n") >= min_sites)
    return sure.unionByName(exact.select("line", "keeper"))


def dedup_lines(docs: DataFrame, min_sites: int = MIN_SITES, site: str = "source", text: str = "text") -> DataFrame:
    """`docs` with its text cleaned, and n_lines, n_removed.

    Lines compare without spaces at their ends; blank lines always stay. A null site is a site of its own, the
    empty one. A null text stays null, with no lines. Rows that share a doc_id share what is removed; rows
    with a null id count as last, so they keep a line only if no other document has it. Rows are never
    dropped: a document of boilerplate alone gets an empty text. Columns named n_lines or n_removed are replaced.
    """
    lines = cut(boilerplate(docs, min_sites, site, text))
    # the row's hash is taken before its lines become rows, once for each text
    found = docs.select("doc_id", _row(text).alias("__row"), _lines(text).alias("line")).select("doc_id", "__row", F.posexplode("line").alias("at", "line")).where(F.trim("line") != "")
    bad = found.select("doc_id", "__row", "at", _key(F.col("line")).alias("line")).join(lines, "line").where(~F.col("doc_id").eqNullSafe(F.col("keeper")))
    bad = bad.groupBy("__row").agg(F.collect_set("at").alias("__bad"))  # places in one document
    both = docs.drop("n_lines", "n_removed").withColumn("__row", _row(text)).join(bad, "__row", "left")
    # places are whole numbers, which array_except tells apart by hash: the work grows with the lines, not their square
    places = F.sequence(F.lit(0), F.size(_lines(text)) - 1)

    def rest(lines: Column) -> Column:
        return F.array_join(F.transform(F.array_except(places, "__bad"), lambda i: F.get(lines, i)), "\n")

    kept = F.element_at(F.transform(F.array(_lines(text)), rest), 1)  # an array of one, so that the text is split once
    total = F.coalesce(F.size(_lines(text)), F.lit(0))
    clean = both.withColumn("n_lines", F.when(F.col(text).isNull(), 0).otherwise(total).cast("long"))
    clean = clean.withColumn("n_removed", F.coalesce(F.size("__bad"), F.lit(0)).cast("long"))
    clean = clean.withColumn(text, F.when(F.col("n_removed") > 0, kept).otherwise(F.col(text)))
    return clean.select(*[c for c in docs.columns if c not in ("n_lines", "n_removed")], "n_lines", "n_removed")
