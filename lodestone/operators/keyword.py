"""Inverted index and BM25 ranking.

Postings are a table (term, id, tf). Statistics are groupings with partial aggregation; a query's few terms are
broadcast (their number is capped by the parser), so scoring prunes postings to them before any shuffle.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from lodestone.functions.scores import d, decoded_length, idf, tf_factor
from lodestone.functions.vectors import let

#: Terms that a query has at most.
MOST_TERMS = 128
BLOCK, CHUNK = 128, 65536


def simple_tokens(text: Column) -> Column:
    """Runs of ASCII letters and digits, lower case."""
    return F.regexp_extract_all(F.lower(F.coalesce(text, F.lit(""))), F.lit("([a-z0-9]+)"), F.lit(1))


def occurrences(docs: DataFrame, tokens: Column) -> DataFrame:
    return docs.select("id", F.explode(tokens).alias("term"))


def postings(docs: DataFrame, tokens: Column) -> DataFrame:
    """(term, id, tf)."""
    return occurrences(docs, tokens).groupBy("term", "id").agg(F.count("*").alias("tf"))


def postings_with_lengths(docs: DataFrame, tokens: Column) -> DataFrame:
    """(term, id, tf, dl). Lengths are coded before the tokens become rows."""
    held = docs.select("id", tokens.alias("t")).select("id", decoded_length(F.size("t")).alias("dl"), "t")
    return held.select("id", "dl", F.explode("t").alias("term")).groupBy("term", "id", "dl").agg(F.count("*").alias("tf"))


def lengths(docs: DataFrame, tokens: Column) -> DataFrame:
    """(id, dl): each document's number of tokens, without a shuffle."""
    return docs.select("id", F.size(tokens).cast("long").alias("dl"))


def corpus_stats(docs: DataFrame, tokens: Column) -> DataFrame:
    """One row: n, total of the lengths as their codes keep them, average. Filters and deletions don't count."""
    dl = decoded_length(F.size(tokens))
    return docs.select(dl.alias("dl")).agg(F.count("*").alias("n"), F.coalesce(F.sum("dl"), F.lit(0)).alias("total")).select("n", "total", F.when(F.col("n") > 0, d(F.col("total")) / d(F.col("n"))).otherwise(d(0)).alias("avg_dl"))


def document_frequency(posted: DataFrame) -> DataFrame:
    return posted.groupBy("term").agg(F.count("*").alias("df"))


def query_terms(terms: Sequence[str]) -> list[str]:
    """Distinct terms in order, as many as a query may have."""
    return list(dict.fromkeys(terms))[:MOST_TERMS]


def counted(docs: DataFrame, tokens: Column, terms: Sequence[str]) -> DataFrame:
    """(id, x: struct<dl, tf array>): coded length and counts of the terms; the tokens are found once for both."""

    def counts(hits: Column) -> Column:
        def one(term: str) -> Column:
            return F.size(F.filter(hits, lambda x: x == term)).cast("long")

        return F.array(*map(one, terms))

    def both(t: Column) -> Column:
        return F.struct(decoded_length(F.size(t)).alias("dl"), let(F.filter(t, lambda x: x.isin(list(terms))), counts).alias("tf"))

    return docs.select("id", let(tokens, both).alias("x"))


def term_scores(docs: DataFrame, tokens: Column, terms: Sequence[str]) -> DataFrame:
    """(id, term, tf, dl, df, score) of the given terms: one pass over the texts.

    Token arrays shrink to the query's terms inside the scan, so what is shuffled are the matches only.
    """
    terms = query_terms(terms)
    each = F.arrays_zip(F.array(*map(F.lit, terms)).alias("term"), F.col("x.tf").alias("tf"))
    found = counted(docs, tokens, terms).select("id", F.col("x.dl").alias("dl"), F.explode(F.filter(each, lambda e: e["tf"] > 0)).alias("e")).select("id", "dl", "e.term", "e.tf")
    stats = F.broadcast(corpus_stats(docs, tokens))  # one row
    df = F.broadcast(found.groupBy("term").agg(F.count("*").alias("df")))  # a row for each query term
    scored = found.join(df, "term").crossJoin(stats)
    return scored.select("id", "term", "tf", "dl", "df", (idf(F.col("n"), F.col("df")) * tf_factor(F.col("tf"), F.col("dl"), F.col("avg_dl"))).alias("score"))


def bm25(docs: DataFrame, tokens: Column, terms: Sequence[str]) -> DataFrame:
    """(id, kw): sum of the terms' scores, over 0 only.

    A document's counts stay in its row: one pass gathers all statistics as one row, a second scores. Nothing
    is shuffled but that row.
    """
    terms = query_terms(terms)
    held = counted(docs, tokens, terms).select("id", F.col("x.dl").alias("dl"), F.col("x.tf").alias("tf"))
    seen = [F.count_if(F.element_at("tf", i + 1) > 0) for i in range(len(terms))]
    stats = held.agg(F.count("*").alias("n"), F.avg("dl").alias("avg_dl"), F.array(*seen).alias("df"))
    scored = held.crossJoin(F.broadcast(stats))  # one row
    each = F.zip_with("tf", "df", lambda tf, df: F.when(tf > 0, idf(F.col("n"), df) * tf_factor(tf, F.col("dl"), F.col("avg_dl"))).otherwise(d(0)))
    return scored.select("id", F.round(F.aggregate(each, d(0), lambda a, x: a + x), 6).alias("kw")).where("kw > 0")


def bm25_batch(docs: DataFrame, tokens: Column, queries: DataFrame, k: int) -> DataFrame:
    """(query, rank, id, kw) for many queries (query, term) at once: queries meet postings by term.

    Common terms are where the work is; they are plain keys of a join of two tables, which Spark can split.
    """
    posted = postings_with_lengths(docs, tokens)
    wanted = queries.select("query", "term").distinct()
    df = document_frequency(posted.join(wanted.select("term").distinct(), "term", "left_semi"))
    stats = F.broadcast(corpus_stats(docs, tokens))  # one row
    weighed = wanted.join(df, "term").crossJoin(stats).select("query", "term", "avg_dl", idf(F.col("n"), F.col("df")).alias("w"))
    hits = posted.join(weighed, "term").select("query", "id", (F.col("w") * tf_factor(F.col("tf"), F.col("dl"), F.col("avg_dl"))).alias("s"))
    scored = hits.groupBy("query", "id").agg(F.round(F.sum("s"), 6).alias("kw")).where("kw > 0")
    rank = F.row_number().over(Window.partitionBy("query").orderBy(F.desc("kw"), "id"))
    return scored.withColumn("rank", rank).where(F.col("rank") <= k).select("query", "rank", "id", "kw")


def top(scored: DataFrame, score: str, limit: int) -> DataFrame:
    """Score descending, id ascending: Spark keeps a heap for each partition."""
    return scored.orderBy(F.desc(score), "id").limit(limit)


def numbered(posted: DataFrame) -> DataFrame:
    """Postings of each term and chunk in id order, numbered from 0, with the gap to the one before and the block.

    A chunk is a range of CHUNK ids, so the longest list that one task orders has a fixed bound.
    """
    w = Window.partitionBy("term", "chunk").orderBy("id")
    rn = F.row_number().over(w) - 1
    chunked = posted.withColumn("chunk", F.floor(F.col("id") / CHUNK).cast("long"))
    gap = F.col("id") - F.lag("id").over(w) - 1
    return chunked.withColumn("pos", rn.cast("long")).withColumn("delta", F.coalesce(gap, F.col("id") - F.col("chunk") * CHUNK)).withColumn("block", F.floor(rn / BLOCK))


def tree_scores(leaves: DataFrame) -> DataFrame:
    """(id, kw) from leaves (id, grp, alt, part, weight, score): parts add up, the best alternative stands for a group.

    Within a part only its best form counts, each form by its own weight; the alternative's weight comes
    last, in `alt_weight`.
    """
    part = leaves.groupBy("id", "grp", "alt", "alt_weight", "part").agg(F.max(F.col("weight") * F.col("score")).alias("s"))
    alt = part.groupBy("id", "grp", "alt", "alt_weight").agg(F.sum("s").alias("s"))
    group = alt.groupBy("id", "grp").agg(F.max(F.col("alt_weight") * F.col("s")).alias("s"))
    return group.groupBy("id").agg(F.round(F.sum("s"), 6).alias("kw")).where("kw > 0")


def strongest(hits: DataFrame, filler: Sequence[str], least: float = 0.4) -> DataFrame:
    """(id, terms) from hits (id, term, n, df): the terms that explain a hit, strongest first.

    Common and filler words only stand, the best of them, where nothing else matched.
    """
    w = F.round(idf(F.col("n"), F.col("df")), 6)
    held = hits.groupBy("id").agg(F.array_sort(F.collect_list(F.struct((-w).alias("w"), "term"))).alias("t"))
    strong = F.filter("t", lambda x: (x["w"] <= -least) & ~x["term"].isin(*filler))
    return held.select("id", F.when(F.size(strong) > 0, strong).otherwise(F.slice("t", 1, 1))["term"].alias("terms"))
