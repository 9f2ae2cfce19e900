"""Hybrid search: candidates of both sides, completed, fused; merging of several spaces' answers."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from lodestone.functions.scores import convex, d, rrf
from lodestone.functions.text import snippet
from lodestone.operators import keyword
from lodestone.operators import vector_search as S
from lodestone.operators.filters import view_similarity


def mode_of(query: str | None, vector: Sequence[float] | None, mode: str | None, has_model: bool = True) -> str:
    """hybrid, vector or keyword. A mode that was asked for never falls back."""
    if mode == "keyword":
        if not query:
            raise ValueError("keyword search needs words")
        return "keyword"
    if mode in ("hybrid", "vector"):
        if vector is None and not has_model:
            raise ValueError(f"{mode} search needs a vector or a model")
        return mode
    if vector is not None:
        return "hybrid" if query else "vector"
    if not query:
        raise ValueError("nothing to search for")
    return "hybrid" if has_model else "keyword"


def candidates(codes: DataFrame, kw: DataFrame, query: Sequence[float], n: int = S.CANDIDATES, keep: DataFrame | None = None) -> DataFrame:
    """(id, dist, sim, kw) of the vector and the keyword candidates, each side's score filled in for both.

    `kw` has the keyword scores (id, kw), from a stored index or from the texts. Filters (`keep`, ids) come before both top-k. Both candidate lists are at most n rows, so completion is
    two joins with a broadcast of bounded size.
    """
    near, words = codes, kw
    if keep is not None:
        near, words = codes.join(keep, "id", "left_semi"), kw.join(keep, "id", "left_semi")
    ids = S.hamming_candidates(near, query, n).select("id").union(keyword.top(words, "kw", n).select("id")).distinct()
    few = F.broadcast(ids)  # 2 n rows at most
    sims = S.similarity(codes.join(few, "id"), query)
    qw = F.array(*(F.lit(w).cast("long") for w in S.query_words(query)))
    from lodestone.functions.vectors import hamming

    sims = sims.select("id", hamming(F.col("words"), qw).alias("dist"), "sim")
    return ids.join(sims, "id", "left").join(kw.join(few, "id"), "id", "left").select("id", "dist", "sim", F.coalesce("kw", d(0)).alias("kw"))


def fuse_convex(cands: DataFrame, limit: int) -> DataFrame:
    """Convex fusion over the whole candidate set, which is two candidate lists at most."""
    w = Window.partitionBy()
    fused = F.round(convex(F.col("sim"), F.min("sim").over(w), F.max("sim").over(w), F.col("kw"), F.max("kw").over(w)), 6)
    return cands.withColumn("fused", fused).orderBy(F.desc("fused"), "id").limit(limit)


def ranks(cands: DataFrame, score: str, out: str) -> DataFrame:
    """1-based rank by score, ties by id; rows without a positive score have none."""
    has = F.coalesce(F.col(score), d(0)) > 0
    r = F.row_number().over(Window.partitionBy(has).orderBy(F.desc(score), "id"))
    return cands.withColumn(out, F.when(has, r))


def fuse_rrf(cands: DataFrame, limit: int) -> DataFrame:
    both = ranks(ranks(cands, "sim", "vector_rank"), "kw", "keyword_rank")
    return both.withColumn("fused", F.round(rrf(F.col("vector_rank"), F.col("keyword_rank")), 6)).orderBy(F.desc("fused"), "id").limit(limit)


def explain(page: DataFrame, terms: DataFrame, docs: DataFrame) -> DataFrame:
    """Why each hit of a page (id, sim, kw, fused) is there: its place on the page by either score, both scores, the
    matched terms (`terms`: id, terms) and a piece of the text around the strongest.

    A side that has no score for the hit says nothing; ties keep the page's order.
    """
    r = page  # a page is at most a few hundred rows
    for score, has, out in (("sim", F.col("sim").isNotNull(), "vector_rank"), ("kw", F.col("kw") > 0, "keyword_rank")):
        place = F.row_number().over(Window.partitionBy(has).orderBy(F.desc(score), F.desc("fused"), "id"))
        r = r.withColumn(out, F.when(has, place))
    few = F.broadcast(r)
    said = docs.select("id", "text").join(few, "id").join(terms.join(F.broadcast(page.select("id")), "id", "left_semi"), "id", "left")
    words = F.when(F.col("kw") > 0, F.col("terms"))
    return said.select(
        "id",
        "fused",
        "vector_rank",
        F.when(F.col("sim").isNotNull(), view_similarity(F.col("sim"))).alias("similarity"),
        "keyword_rank",
        F.when(F.col("kw") > 0, F.round(F.col("kw") * 100).cast("int")).alias("score"),
        F.array_join(words, " ").alias("terms"),
        snippet(F.col("text"), F.get(words, 0)).alias("snippet"),
    )


def merge_spaces(lists: DataFrame, limit: int) -> DataFrame:
    """Answers of several spaces (space, mode, pos, uri, sim) as one list (uri, space, score, rank).

    One space keeps its order; if all searched by vector the similarity decides; otherwise the place in each
    list, then the similarity. Of a uri found twice its best place stays.
    """
    seen = lists.agg((F.min("space") == F.max("space")).alias("alone"), (F.min((F.col("mode") == "vector").cast("int")) == 1).alias("by_sim"))
    lists = lists.crossJoin(F.broadcast(seen))  # one row
    score = F.when(F.col("by_sim") & ~F.col("alone"), F.col("sim")).otherwise(rrf(F.col("pos")))
    scored = lists.withColumn("score", F.round(score, 6))
    once = scored.withColumn("n", F.row_number().over(Window.partitionBy("uri").orderBy(F.desc("score"), F.desc("sim"), "space"))).where("n = 1")
    top = once.orderBy(F.desc("score"), F.desc("sim"), "uri").limit(limit)
    return top.withColumn("rank", F.row_number().over(Window.orderBy(F.desc("score"), F.desc("sim"), "uri"))).select("uri", "space", "score", "rank")
