"""Vector ranking: 1-bit candidates re-ranked by int8 products, scans for batches of queries, probing, graphs."""

from __future__ import annotations

from collections.abc import Iterator, Sequence

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from lodestone.functions import vectors as V

#: Candidates before re-ranking, at least; the most nodes a graph has.
CANDIDATES, GRAPH_NODES = 200, 500
#: Vectors in a block of queries and of the corpus, and corpus blocks in a group.
QUERY_ROWS, CORPUS_ROWS, BLOCKS_A_GROUP = 256, 1024, 16


def unit(v: Sequence[float]) -> list[float]:
    x = np.asarray(v, np.float64)
    n = float(np.sqrt((x**2).sum()))
    if not np.isfinite(n) or n == 0:
        raise ValueError("the query vector has no direction")
    return (x / n).tolist()


def query_words(v: Sequence[float]) -> list[int]:
    """The sign code of a query vector as signed 64-bit words."""
    bits = np.zeros(-(-len(v) // 64) * 64, np.uint8)
    bits[: len(v)] = np.asarray(v) > 0
    return [int(x) for x in np.packbits(bits.reshape(-1, 64), axis=1, bitorder="little").view("<i8").ravel()]


def coded(memories: DataFrame, dims: int, *more: str) -> DataFrame:
    """(id, words, scale, code, more) of rows with a vector of `dims` components."""
    has = memories.where(F.col("embedding").isNotNull() & (F.size("embedding") == dims))
    signs = has.select("id", V.sign_words("embedding", dims).alias("words"), V.int8_scale("embedding").alias("scale"), "embedding", *more)
    return signs.select("id", "words", "scale", V.int8_code("embedding", F.col("scale")).alias("code"), *more)


def hamming_candidates(codes: DataFrame, query: Sequence[float], limit: int = CANDIDATES) -> DataFrame:
    """The first `limit` rows by (distance, id)."""
    words = F.array(*(F.lit(w).cast("long") for w in query_words(query)))
    return codes.withColumn("dist", V.hamming(F.col("words"), words)).orderBy("dist", "id").limit(limit)


def similarity(codes: DataFrame, query: Sequence[float]) -> DataFrame:
    """`sim`: the int8 product with the unit query, to six decimals."""
    return codes.withColumn("sim", F.round(V.int8_dot(unit(query), F.col("code"), F.col("scale")), 6))


def vector_search(codes: DataFrame, query: Sequence[float], limit: int, candidates: int = CANDIDATES) -> DataFrame:
    """(id, dist, sim): 1-bit candidates, then the int8 order."""
    found = similarity(hamming_candidates(codes, query, max(candidates, limit)), query)
    return found.select("id", "dist", "sim").orderBy(F.desc("sim"), "id").limit(limit)


def packed(vectors: DataFrame, rows: int, ids: str, block: str) -> DataFrame:
    """(dims, ids, block): unit vectors of (id, embedding) as doubles, at most `rows` of one length in a block."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            size = np.diff(batch.column(1).offsets.to_numpy())
            flat = batch.column(1).flatten().to_numpy(zero_copy_only=False)
            first = np.cumsum(size) - size
            for dims in np.unique(size).tolist():
                own = np.flatnonzero(size == dims)
                x = flat[first[own][:, None] + np.arange(dims)]
                norm = np.sqrt((x**2).sum(1))
                good = np.isfinite(norm) & (norm > 0)
                own, x = own[good], x[good] / norm[good, None]
                key = batch.column(0).to_numpy()[own]
                for k in range(0, len(own), rows):
                    raw = pa.array([x[k : k + rows].astype("<f8").tobytes()], pa.binary())
                    yield pa.RecordBatch.from_arrays([pa.array([dims], pa.int32()), pa.array([key[k : k + rows].astype("<i8").tobytes()], pa.binary()), raw], ["dims", ids, block])

    has = vectors.where("id IS NOT NULL AND size(embedding) > 0 AND forall(embedding, x -> x IS NOT NULL)")
    return has.select("id", F.col("embedding").cast("array<double>")).mapInArrow(run, f"dims int, {ids} binary, {block} binary")


def scan(corpus: DataFrame, queries: DataFrame, k: int) -> DataFrame:
    """(query_id, rank, id, sim) for a batch of queries by exact cosine, a query itself left out.

    Queries and corpus are packed into blocks. Corpus blocks are dealt to groups, query blocks go to each group
    once; a pair of blocks gives k rows for each query, so no pair of vectors becomes a row and nothing passes
    through the driver. Zero vectors and those with a null or non-finite component take no part; vectors of different
    lengths never meet.
    """
    blocks = packed(corpus, CORPUS_ROWS, "ids", "vectors")
    groups = max(1, corpus.count() // (CORPUS_ROWS * BLOCKS_A_GROUP))
    dealt = blocks.withColumn("g", F.pmod(F.xxhash64("ids"), F.lit(groups)))
    asked = packed(queries, QUERY_ROWS, "q_ids", "q_vectors").withColumn("g", F.explode(F.sequence(F.lit(0).cast("long"), F.lit(groups - 1).cast("long"))))
    met = asked.join(dealt, ["dims", "g"]).select("dims", "q_ids", "q_vectors", "ids", "vectors")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for row in range(batch.num_rows):
                dims, *raw = (batch.column(c)[row].as_py() for c in range(5))
                (q_ids, ids), (q, v) = ([np.frombuffer(x, "<i8") for x in raw[::2]], [np.frombuffer(x, "<f8").reshape(-1, dims) for x in raw[1::2]])
                s = np.round(q @ v.T, 6)
                s[q_ids[:, None] == ids[None]] = -np.inf
                order = np.lexsort((np.broadcast_to(ids, s.shape), -s), axis=1)[:, :k]
                best = np.take_along_axis(s, order, 1)
                r, c = np.nonzero(np.isfinite(best))
                yield pa.RecordBatch.from_arrays([pa.array(q_ids[r]), pa.array(ids[order[r, c]]), pa.array(best[r, c])], ["query_id", "id", "sim"])

    found = met.mapInArrow(run, "query_id long, id long, sim double")
    rank = F.row_number().over(Window.partitionBy("query_id").orderBy(F.desc("sim"), "id"))
    return found.withColumn("rank", rank).where(F.col("rank") <= k).select("query_id", "rank", "id", "sim")


def graph_nodes(memories: DataFrame, limit: int) -> DataFrame:
    """The newest memories with a vector, GRAPH_NODES at most, as unit int8 vectors."""
    has = memories.where("embedding IS NOT NULL").orderBy(F.desc("created_at"), F.desc("author"), F.desc("rkey")).limit(min(limit, GRAPH_NODES))
    unit8 = V.normalized(V.int8_code("embedding", V.int8_scale("embedding")))
    return has.select("id", "label", "created_at", unit8.alias("unit"))


def knn_pairs(nodes: DataFrame, k: int, least: float) -> DataFrame:
    """(a, b, sim, rank): each node's k nearest with a similarity of `least` or more. Nodes are at most GRAPH_NODES."""
    left, right = nodes.select(F.col("id").alias("a"), F.col("unit").alias("u")), nodes.select(F.col("id").alias("b"), F.col("unit").alias("v"))
    pairs = left.join(F.broadcast(right), F.col("a") != F.col("b"))
    pairs = pairs.withColumn("sim", F.round(F.least(F.lit(1.0), V.dot("u", "v")), 5)).where(F.col("sim") >= least)
    rank = F.row_number().over(Window.partitionBy("a").orderBy(F.desc("sim"), "b"))
    return pairs.withColumn("rank", rank).where(F.col("rank") <= k).select("a", "b", "sim", "rank")


def knn_edges(pairs: DataFrame) -> DataFrame:
    """Each unordered pair once."""
    return pairs.groupBy(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b")).agg(F.max("sim").alias("sim"))


def cluster_means(vectors: DataFrame, dims: int) -> DataFrame:
    """(cluster, center): normalised mean direction of each cluster, summed component by component."""
    each = vectors.select("cluster", F.posexplode("embedding").alias("i", "x")).groupBy("cluster", "i").agg(F.sum(F.col("x").cast("double")).alias("s"))
    rows = each.groupBy("cluster").agg(F.array_sort(F.collect_list(F.struct("i", "s"))).alias("c"))
    return rows.select("cluster", V.normalized(F.transform("c", lambda x: x["s"])).alias("center"))


def assign(vectors: DataFrame, centers: DataFrame) -> DataFrame:
    """(id, cluster): the center of the largest product, to six decimals, ties to the smaller cluster.

    Centers (cluster, center) are 4,096 at most (see `cluster_count`) and travel to the tasks, where a block of vectors
    meets them as a matrix product. Vectors that are null or of another length have no cluster and no row.
    """
    rows = centers.where("center IS NOT NULL").orderBy("cluster").collect()
    numbers, matrix = np.array([r.cluster for r in rows], np.int32), np.array([r.center for r in rows], np.float64)
    source = vectors.select("id", "embedding")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            size = batch.column(1).value_lengths().fill_null(-1).to_numpy(zero_copy_only=False).astype(np.int64)
            flat = batch.column(1).flatten().to_numpy(zero_copy_only=False).astype(np.float64)
            own = np.flatnonzero(size == matrix.shape[1]) if len(matrix) else np.zeros(0, np.int64)
            held = np.maximum(size, 0)
            x = flat[(np.cumsum(held) - held)[own][:, None] + np.arange(matrix.shape[1] if len(matrix) else 0)]
            best = np.round(x @ matrix.T, 6).argmax(1) if len(own) else own
            yield pa.RecordBatch.from_arrays([batch.column(0).take(pa.array(own)), pa.array(numbers[best], pa.int32())], ["id", "cluster"])

    return source.mapInArrow(run, source.select("id").schema.add("cluster", "integer"))


def cluster_count(n: int) -> int:
    return int(min(4096, max(2, round(n**0.5))))


def probes(k: int) -> int:
    """Clusters that a search visits."""
    return max(4, k // 8)
