"""Vector queries: codes, scans, re-ranking, graphs, clusters."""

from __future__ import annotations

import numpy as np
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from lodestone.catalog.registry import query
from lodestone.functions import embedding as E
from lodestone.functions import vectors as V
from lodestone.operators import filters, spherical
from lodestone.operators import vector_search as S
from lodestone.sources.tables import MEMORIES_SQL, memories, table, tombstones
from lodestone.sources.vector_index import VectorIndex

DIMS = 64
#: The memory whose vector stands for the query.
QUERY_ID = 7


def codes(spark: SparkSession, sf_dir: str) -> DataFrame:
    e = table(spark, sf_dir, "embeddings").select(F.col("vec_id").alias("id"), "embedding")
    return S.coded(e, DIMS)


def query_vector(spark: SparkSession, sf_dir: str) -> list[float]:
    return list(table(spark, sf_dir, "embeddings").where(F.col("vec_id") == QUERY_ID).select("embedding").first()[0])


Q_SQL = "q AS (SELECT embedding AS e, sqrt(list_dot_product(CAST(embedding AS DOUBLE[]), CAST(embedding AS DOUBLE[]))) AS n FROM embeddings WHERE vec_id = 7)"
CODE_SQL = """sc AS (SELECT vec_id AS id, label, embedding, CAST(CAST(list_max(list_transform(embedding, lambda x: abs(x))) AS DOUBLE) / 127.0::DOUBLE AS FLOAT) AS scale FROM embeddings WHERE len(embedding) = 64),
cd AS (SELECT *, CASE WHEN scale > 0 THEN list_transform(embedding, lambda x: greatest(-127, least(127, CAST(round(CAST(CAST(CAST(x AS DOUBLE) / CAST(scale AS DOUBLE) AS FLOAT) AS DOUBLE)) AS INTEGER))))
  ELSE list_transform(embedding, lambda x: 0) END AS code FROM sc)"""
DIST_SQL = "CAST(list_sum(list_transform(range(1, 65), lambda i: CASE WHEN (c.embedding[i] > 0) <> (q.e[i] > 0) THEN 1 ELSE 0 END)) AS INTEGER)"
SIM_SQL = "round(list_dot_product(list_transform(q.e, lambda x: CAST(x AS DOUBLE) / q.n), CAST(c.code AS DOUBLE[])) * CAST(c.scale AS DOUBLE), 6)"
SEARCH_SQL = f"{Q_SQL}, {CODE_SQL}, cand AS (SELECT c.id, {DIST_SQL} AS dist, {SIM_SQL} AS sim FROM cd c CROSS JOIN q ORDER BY dist, id LIMIT 200)"


@query("SELECT vec_id AS id, round(sqrt(list_dot_product(CAST(embedding AS DOUBLE[]), CAST(embedding AS DOUBLE[]))), 6) AS norm, round(CAST(embedding[1] AS DOUBLE) / sqrt(list_dot_product(CAST(embedding AS DOUBLE[]), CAST(embedding AS DOUBLE[]))), 6) AS first FROM embeddings")
def normalize_vec(spark: SparkSession, sf_dir: str) -> DataFrame:
    e = table(spark, sf_dir, "embeddings")
    return e.select(F.col("vec_id").alias("id"), F.round(V.norm("embedding"), 6).alias("norm"), F.round(F.element_at(V.normalized("embedding"), 1), 6).alias("first"))


@query("SELECT vec_id AS id, CAST(list_sum(list_transform(range(64), lambda i: CASE WHEN embedding[i + 1] > 0 THEN (CASE WHEN i = 63 THEN -9223372036854775808::HUGEINT ELSE CAST(pow(2, i) AS HUGEINT) END) ELSE 0::HUGEINT END)) AS BIGINT) AS bits FROM embeddings")
def sign_bits(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "embeddings").select(F.col("vec_id").alias("id"), V.sign_word("embedding").alias("bits"))


@query(f"WITH {CODE_SQL} SELECT id, round(CAST(scale AS DOUBLE), 9) AS scale, array_to_string(code, ',') AS code FROM cd")
def int8_quantize(spark: SparkSession, sf_dir: str) -> DataFrame:
    return codes(spark, sf_dir).select("id", F.round(F.col("scale").cast("double"), 9).alias("scale"), F.array_join(F.col("code").cast("array<string>"), ",").alias("code"))


@query(f"WITH {Q_SQL}, {CODE_SQL} SELECT c.id, {DIST_SQL} AS dist FROM cd c CROSS JOIN q ORDER BY dist, id LIMIT 50")
def hamming_topk(spark: SparkSession, sf_dir: str) -> DataFrame:
    return S.hamming_candidates(codes(spark, sf_dir), query_vector(spark, sf_dir), 50).select("id", "dist")


@query(f"WITH {Q_SQL} SELECT vec_id AS id, round(list_dot_product(CAST(q.e AS DOUBLE[]), CAST(embedding AS DOUBLE[])) / q.n / sqrt(list_dot_product(CAST(embedding AS DOUBLE[]), CAST(embedding AS DOUBLE[]))), 6) AS sim FROM embeddings CROSS JOIN q ORDER BY sim DESC, id LIMIT 20")
def cosine_topk(spark: SparkSession, sf_dir: str) -> DataFrame:
    q = V.doubles(S.unit(query_vector(spark, sf_dir)))
    e = table(spark, sf_dir, "embeddings").select(F.col("vec_id").alias("id"), "embedding")
    return e.select("id", F.round(V.dot(q, V.normalized("embedding")), 6).alias("sim")).orderBy(F.desc("sim"), "id").limit(20)


@query(f"WITH {Q_SQL}, {CODE_SQL} SELECT c.id, {DIST_SQL} AS dist, round(cos(pi() * {DIST_SQL} / 64.0::DOUBLE), 6) AS estimate FROM cd c CROSS JOIN q")
def approx_cosine(spark: SparkSession, sf_dir: str) -> DataFrame:
    words = F.array(*(F.lit(w).cast("long") for w in S.query_words(query_vector(spark, sf_dir))))
    d = codes(spark, sf_dir).select("id", V.hamming(F.col("words"), words).alias("dist"))
    return d.withColumn("estimate", F.round(V.cosine_estimate(F.col("dist"), DIMS), 6))


@query(f"WITH {SEARCH_SQL}, top AS (SELECT * FROM cand ORDER BY sim DESC, id LIMIT 10) SELECT top.id, dist, sim, text FROM top JOIN documents ON doc_id = top.id")
def vector_search(spark: SparkSession, sf_dir: str) -> DataFrame:
    top = S.vector_search(codes(spark, sf_dir), query_vector(spark, sf_dir), 10)
    docs = table(spark, sf_dir, "documents").select(F.col("doc_id").alias("id"), "text")
    return docs.join(F.broadcast(top), "id").select("id", "dist", "sim", "text")  # ten rows


@query(f"""WITH {Q_SQL}, {CODE_SQL}, {MEMORIES_SQL}, f AS (SELECT id FROM mem WHERE author = 'src0' AND created_at >= TIMESTAMP '2024-01-01 00:30:00' AND id NOT IN (SELECT doc_id FROM documents WHERE doc_id % 17 = 0)),
cand AS (SELECT c.id, {DIST_SQL} AS dist, {SIM_SQL} AS sim FROM cd c CROSS JOIN q WHERE id IN (SELECT id FROM f) ORDER BY dist, id LIMIT 200) SELECT * FROM cand ORDER BY sim DESC, id LIMIT 10""")
def filtered_vector_search(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Filters and tombstones come before the candidates."""
    keep = memories(spark, sf_dir).where(filters.by_author("src0") & filters.in_window("2024-01-01 00:30:00"))
    keep = filters.live(keep, tombstones(spark, sf_dir)).select("id")
    return S.vector_search(codes(spark, sf_dir).join(keep, "id", "left_semi"), query_vector(spark, sf_dir), 10)


@query(f"WITH {Q_SQL}, {CODE_SQL}, cand AS (SELECT c.id, {DIST_SQL} AS dist FROM cd c CROSS JOIN q ORDER BY dist, id LIMIT 10) SELECT id, dist, round(cos(pi() * dist / 64.0::DOUBLE), 6) AS sim FROM cand")
def approx_search(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The answer without re-ranking: similarity estimated from the distance."""
    top = S.hamming_candidates(codes(spark, sf_dir), query_vector(spark, sf_dir), 10)
    return top.select("id", "dist", F.round(V.cosine_estimate(F.col("dist"), DIMS), 6).alias("sim"))


NODES_SQL = f"{MEMORIES_SQL}, {CODE_SQL}, nodes AS (SELECT m.id, m.label, list_transform(c.code, lambda x: CAST(x AS DOUBLE) / sqrt(list_dot_product(CAST(c.code AS DOUBLE[]), CAST(c.code AS DOUBLE[])))) AS u FROM mem m JOIN cd c ON c.id = m.id ORDER BY m.created_at DESC, m.author DESC, m.rkey DESC LIMIT 200)"
PAIRS_SQL = f"""{NODES_SQL}, sims AS (SELECT a.id AS a, b.id AS b, round(least(1.0::DOUBLE, list_dot_product(a.u, b.u)), 5) AS sim FROM nodes a JOIN nodes b ON a.id <> b.id),
pairs AS (SELECT * FROM (SELECT *, CAST(row_number() OVER (PARTITION BY a ORDER BY sim DESC, b) AS INTEGER) AS rank FROM sims WHERE sim >= 0.25) WHERE rank <= 3)"""
EDGES_SQL = f"{PAIRS_SQL}, edges AS (SELECT least(a, b) AS a, greatest(a, b) AS b, max(sim) AS sim FROM pairs GROUP BY 1, 2)"


def _pairs(spark: SparkSession, sf_dir: str) -> DataFrame:
    return S.knn_pairs(S.graph_nodes(memories(spark, sf_dir, vectors=True), 200), 3, 0.25)


@query(f"WITH {PAIRS_SQL} SELECT a, b, sim, rank FROM pairs")
def knn_pairs(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _pairs(spark, sf_dir)


@query(f"WITH {EDGES_SQL} SELECT a, b, sim FROM edges")
def knn_graph(spark: SparkSession, sf_dir: str) -> DataFrame:
    return S.knn_edges(_pairs(spark, sf_dir))


@query(f"WITH {EDGES_SQL}, ends AS (SELECT a AS id FROM edges WHERE sim >= 0.3 UNION ALL SELECT b FROM edges WHERE sim >= 0.3) SELECT id, count(*) AS degree FROM ends GROUP BY id")
def graph_degree(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Edges of each node at a similarity slider of 30 percent."""
    e = S.knn_edges(_pairs(spark, sf_dir)).where("sim >= 0.3")
    return e.select(F.explode(F.array("a", "b")).alias("id")).groupBy("id").agg(F.count("*").alias("degree"))


@query(f"""WITH {NODES_SQL}, p AS (SELECT a.id AS x, b.id AS y, round(pow(a.u[1] - b.u[1], 2) + pow(a.u[2] - b.u[2], 2), 6) AS d FROM nodes a JOIN nodes b ON a.label = b.label AND a.id <> b.id),
r AS (SELECT *, row_number() OVER (PARTITION BY x ORDER BY d, y) AS rn FROM p) SELECT DISTINCT least(x, y) AS a, greatest(x, y) AS b FROM r WHERE rn <= 2""")
def cluster_neighbors(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The two nearest of a node in the plane within its own cluster, each pair once; nodes of a graph only."""
    n = S.graph_nodes(memories(spark, sf_dir, vectors=True), 200).select("id", "label", F.element_at("unit", 1).alias("px"), F.element_at("unit", 2).alias("py"))
    b = F.broadcast(n.select(F.col("id").alias("y"), F.col("label").alias("l"), F.col("px").alias("qx"), F.col("py").alias("qy")))  # 200 rows
    d = F.round(F.pow(F.col("px") - F.col("qx"), 2) + F.pow(F.col("py") - F.col("qy"), 2), 6)
    p = n.withColumnRenamed("id", "x").join(b, (F.col("label") == F.col("l")) & (F.col("x") != F.col("y"))).withColumn("d", d)
    p = p.withColumn("rn", F.row_number().over(Window.partitionBy("x").orderBy("d", "y"))).where("rn <= 2")
    return p.select(F.least("x", "y").alias("a"), F.greatest("x", "y").alias("b")).distinct()


@query("""WITH e AS (SELECT vec_id AS id, CAST(embedding AS DOUBLE[]) AS v FROM embeddings), s AS (
  SELECT q.id AS query_id, c.id, round(list_dot_product(q.v, c.v) / sqrt(list_dot_product(q.v, q.v)) / sqrt(list_dot_product(c.v, c.v)), 6) AS sim FROM e q JOIN e c ON q.id % 10 >= 8 AND c.id % 10 < 8),
r AS (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY sim DESC, id) AS rank FROM s)
SELECT query_id, max(sim) AS best, CAST(count(*) FILTER (WHERE sim >= 0.3) AS BIGINT) AS related, bool_or(sim >= 0.86) AS skip FROM r WHERE rank <= 5 GROUP BY query_id""")
def near_dupes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """New memories (the buffer) against the stored ones: those with a near twin are skipped."""
    e = table(spark, sf_dir, "embeddings").select(F.col("vec_id").alias("id"), "embedding")
    found = S.scan(e.where("id % 10 < 8"), e.where("id % 10 >= 8"), 5)
    return found.groupBy("query_id").agg(F.max("sim").alias("best"), F.count_if(F.col("sim") >= 0.3).alias("related"), F.bool_or(F.col("sim") >= 0.86).alias("skip"))


def _labelled(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "embeddings").select(F.col("vec_id").alias("id"), F.col("label").alias("cluster"), "embedding")


CENTERS_SQL = """s AS (SELECT label AS cluster, i, sum(CAST(embedding[i] AS DOUBLE)) AS x FROM embeddings, unnest(range(1, 65)) AS r(i) GROUP BY 1, 2),
c0 AS (SELECT cluster, list(x ORDER BY i) AS c FROM s GROUP BY cluster), centers AS (SELECT cluster, list_transform(c, lambda x: x / sqrt(list_dot_product(c, c))) AS center FROM c0)"""


@query(f"""WITH {CENTERS_SQL}, d AS (SELECT vec_id AS id, cluster, round(list_dot_product(CAST(embedding AS DOUBLE[]), center), 6) AS s FROM embeddings CROSS JOIN centers),
r AS (SELECT *, row_number() OVER (PARTITION BY id ORDER BY s DESC, cluster) AS rn FROM d) SELECT id, cluster FROM r WHERE rn = 1""")
def assign_clusters(spark: SparkSession, sf_dir: str) -> DataFrame:
    v = _labelled(spark, sf_dir)
    return S.assign(v, S.cluster_means(v, DIMS))


@query(f"WITH {CENTERS_SQL}, {Q_SQL} SELECT cluster, round(list_dot_product(CAST(q.e AS DOUBLE[]), center) / q.n, 6) AS s FROM centers CROSS JOIN q ORDER BY s DESC, cluster LIMIT 4")
def cluster_probe(spark: SparkSession, sf_dir: str) -> DataFrame:
    q = V.doubles(S.unit(query_vector(spark, sf_dir)))
    c = S.cluster_means(_labelled(spark, sf_dir), DIMS)
    return c.select("cluster", F.round(V.dot(q, "center"), 6).alias("s")).orderBy(F.desc("s"), "cluster").limit(S.probes(10))


@query(f"""WITH {CENTERS_SQL}, {Q_SQL}, {CODE_SQL}, d AS (SELECT vec_id AS id, cluster, round(list_dot_product(CAST(embedding AS DOUBLE[]), center), 6) AS s FROM embeddings CROSS JOIN centers),
r AS (SELECT *, row_number() OVER (PARTITION BY id ORDER BY s DESC, cluster) AS rn FROM d),
probed AS (SELECT cluster FROM centers CROSS JOIN q ORDER BY round(list_dot_product(CAST(q.e AS DOUBLE[]), center) / q.n, 6) DESC, cluster LIMIT 4),
inside AS (SELECT id FROM r WHERE rn = 1 AND cluster IN (SELECT cluster FROM probed)),
cand AS (SELECT c.id, {DIST_SQL} AS dist, {SIM_SQL} AS sim FROM cd c CROSS JOIN q WHERE c.id IN (SELECT id FROM inside) ORDER BY dist, id LIMIT 200)
SELECT id, dist, sim FROM cand ORDER BY sim DESC, id LIMIT 10""")
def ivf_search(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Vector search among the clusters nearest to the query only."""
    v = _labelled(spark, sf_dir)
    centers = S.cluster_means(v, DIMS)
    q = V.doubles(S.unit(query_vector(spark, sf_dir)))
    probed = centers.orderBy(F.desc(F.round(V.dot(q, "center"), 6)), "cluster").limit(S.probes(10)).select("cluster")
    inside = S.assign(v, centers).join(F.broadcast(probed), "cluster", "left_semi").select("id")  # a few clusters
    return S.vector_search(codes(spark, sf_dir).join(inside, "id", "left_semi"), query_vector(spark, sf_dir), 10)


def _kmeans_sql() -> str:
    """Six rounds of spherical k-means over a sample drawn by hash, then every vector at the best of eight centres."""
    parts = [
        "u0 AS (SELECT vec_id AS id, CAST(embedding AS DOUBLE[]) AS v FROM embeddings WHERE len(embedding) = 64)",
        "u AS (SELECT id, list_transform(v, lambda x: x / sqrt(list_dot_product(v, v))) AS v FROM u0 WHERE list_dot_product(v, v) > 0)",
        "size AS (SELECT count(*) AS n, least(4096, greatest(2, CAST(round_even(sqrt(count(*)), 0) AS BIGINT))) AS k FROM u)",
        "smp AS (SELECT id, v FROM u CROSS JOIN size WHERE n <= 32 * k OR CAST(('0x' || substr(md5('sample:' || id), 1, 8)) AS BIGINT) / 4294967296.0::DOUBLE * n < 32 * k)",
        "k0 AS (SELECT cluster, v AS c FROM (SELECT CAST(row_number() OVER (ORDER BY md5('start:' || id), id) - 1 AS INTEGER) AS cluster, v FROM smp) CROSS JOIN size WHERE cluster < k)",
    ]
    for r in range(6):
        parts += [
            f"""a{r} AS (SELECT id, v, min(struct_pack(s, cluster)) AS best FROM (SELECT id, v, cluster, -round(list_dot_product(v, c), 6) AS s FROM smp CROSS JOIN k{r}) GROUP BY id, v)""",
            f"""s{r} AS (SELECT cluster, list(x ORDER BY i) AS x FROM (SELECT best.cluster AS cluster, i, CAST(sum(CAST(floor(v[i] * 1073741824 + 0.5) AS BIGINT)) AS DOUBLE) AS x FROM a{r}, unnest(range(1, 65)) AS g(i) GROUP BY ALL) GROUP BY cluster)""",
            f"""m{r} AS (SELECT cluster, list_transform(x, lambda y: y / sqrt(list_dot_product(x, x))) AS c FROM s{r} WHERE list_dot_product(x, x) > 0)""",
            f"""e{r} AS (SELECT cluster, row_number() OVER (ORDER BY cluster) AS n FROM k{r} WHERE cluster NOT IN (SELECT cluster FROM m{r}))""",
            f"""k{r + 1} AS (SELECT cluster, c FROM m{r} UNION ALL SELECT cluster, v FROM e{r} JOIN (SELECT v, row_number() OVER (ORDER BY md5('round{r}:' || id), id) AS n FROM smp) USING (n))""",
        ]
    parts += [
        "far AS (SELECT id, v, cluster, c, CAST(list_sum(list_transform(range(1, 65), lambda i: CASE WHEN (v[i] > 0) <> (c[i] > 0) THEN 1 ELSE 0 END)) AS INTEGER) AS apart FROM u CROSS JOIN k6)",
        "few AS (SELECT *, row_number() OVER (PARTITION BY id ORDER BY apart, cluster) AS n FROM far)",
        "near AS (SELECT id, min(struct_pack(s, cluster)).cluster AS cluster FROM (SELECT id, cluster, -round(list_dot_product(v, c), 6) AS s FROM few WHERE n <= 8) GROUP BY id)",
    ]
    return ", ".join(parts)


KMEANS_SQL = _kmeans_sql()


def vector_index(spark: SparkSession, sf_dir: str) -> VectorIndex:
    """The stored vector index; the session's first search builds it, and any after the table has changed."""
    path = f"{sf_dir}/embeddings.parquet"
    return VectorIndex.shared(spark, path, lambda: table(spark, sf_dir, "embeddings").select(F.col("vec_id").alias("id"), "embedding"), DIMS)


@query(f"WITH {KMEANS_SQL} SELECT cluster, count(*) AS n FROM near GROUP BY cluster")
def kmeans(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Sizes of spherical k-means clusters, k about the square root of the number of vectors."""
    v = table(spark, sf_dir, "embeddings").select(F.col("vec_id").alias("id"), "embedding")
    centers = spherical.train(v, S.cluster_count(spherical.directed(v, DIMS).count()), DIMS)
    return spherical.assign(spherical.directed(v, DIMS), centers if len(centers) else np.zeros((1, DIMS))).groupBy("cluster").agg(F.count("*").alias("n"))


@query(f"""WITH {KMEANS_SQL}, {Q_SQL}, {CODE_SQL},
probed AS (SELECT cluster FROM k6 CROSS JOIN q CROSS JOIN size QUALIFY row_number() OVER (ORDER BY round(list_dot_product(list_transform(q.e, lambda x: CAST(x AS DOUBLE) / q.n), c), 6) DESC, cluster) <= greatest(4, k // 8)),
cand AS (SELECT c.id, {DIST_SQL} AS dist, {SIM_SQL} AS sim FROM cd c CROSS JOIN q WHERE c.id IN (SELECT id FROM near WHERE cluster IN (SELECT cluster FROM probed)) ORDER BY dist, id LIMIT 200)
SELECT id, dist, sim FROM cand ORDER BY sim DESC, id LIMIT 10""")
def vector_index_search(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Vector search in a stored index: the folders of the nearest clusters are all that it opens."""
    return vector_index(spark, sf_dir).search(query_vector(spark, sf_dir), 10)


@query(f"""WITH {KMEANS_SQL}, {CODE_SQL},
ask AS (SELECT id AS query_id, v FROM u WHERE id % 10 >= 8),
probed AS (SELECT query_id, v, cluster FROM ask CROSS JOIN k6 CROSS JOIN size QUALIFY row_number() OVER (PARTITION BY query_id ORDER BY round(list_dot_product(v, c), 6) DESC, cluster) <= greatest(4, k // 8)),
s AS (SELECT query_id, cd.id, round(list_dot_product(v, list_transform(cd.code, lambda x: CAST(x AS DOUBLE) * CAST(scale AS DOUBLE))), 6) AS sim FROM probed JOIN near USING (cluster) JOIN cd ON cd.id = near.id),
r AS (SELECT *, CAST(row_number() OVER (PARTITION BY query_id ORDER BY sim DESC, id) AS INTEGER) AS rank FROM s) SELECT query_id, rank, id, sim FROM r WHERE rank <= 5""")
def vector_index_batch(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The buffered memories' vectors against the stored index, cluster by cluster in blocks."""
    ask = table(spark, sf_dir, "embeddings").where("vec_id % 10 >= 8").select(F.col("vec_id").alias("query_id"), "embedding")
    return vector_index(spark, sf_dir).search_batch(ask, 5)


@query(r"""WITH w AS (SELECT DISTINCT doc_id AS id, unnest(regexp_extract_all(lower(coalesce(text, '')), '[\p{L}\p{N}]+')) AS w FROM documents),
h AS (SELECT DISTINCT w, hex(encode(w)) AS x FROM w),
b AS (SELECT w, list_reduce(list_prepend(CAST(2166136261 AS BIGINT), list_transform(range(0, length(x) // 2), lambda i: CAST(('0x' || substr(x, CAST(2 * i + 1 AS BIGINT), 2)) AS BIGINT))), lambda a, c: (xor(a, c) * 16777619) & 4294967295) % 256 AS bucket FROM h)
SELECT doc_id AS id, 1.0::DOUBLE AS norm, CAST(greatest(1, count(DISTINCT bucket)) AS INTEGER) AS used FROM documents LEFT JOIN (SELECT id, bucket FROM w JOIN b USING (w)) t ON t.id = doc_id GROUP BY doc_id""")
def hash_embed(spark: SparkSession, sf_dir: str) -> DataFrame:
    d = table(spark, sf_dir, "documents").select(F.col("doc_id").alias("id"), E.hash_embed(F.col("text"), 256).alias("v"))
    return d.select("id", F.round(V.norm("v"), 4).alias("norm"), F.size(F.filter("v", lambda x: x != 0)).alias("used"))


HALF_SQL = "CASE WHEN x = 0 THEN 0 ELSE round_even(x / pow(2, greatest(floor(log2(abs(x))), -14) - 10), 0) * pow(2, greatest(floor(log2(abs(x))), -14) - 10) END"


@query(f"""WITH h AS (SELECT vec_id AS id, list_transform(CAST(embedding AS DOUBLE[]), lambda x: {HALF_SQL}) AS back, CAST(embedding AS DOUBLE[]) AS v FROM embeddings)
SELECT id, len(back) AS dims, 2 * len(back) AS n_bytes, round(list_sum(list_transform(range(1, len(back) + 1), lambda i: i * back[i])), 5) AS weighed,
round(list_max(list_transform(range(1, len(back) + 1), lambda i: abs(back[i] - v[i]))), 7) AS off FROM h""")
def f16_round_trip(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Vectors through half-precision bytes and back."""
    e = table(spark, sf_dir, "embeddings").select(F.col("vec_id").alias("id"), "embedding", E.encode_f16(F.col("embedding")).alias("raw"))
    back = e.select("id", "embedding", "raw", E.decode_f16(F.col("raw")).alias("back"))
    off = F.aggregate(F.zip_with("embedding", "back", lambda a, b: F.abs(a.cast("double") - b.cast("double"))), F.lit(0.0), lambda s, x: F.greatest(s, x))
    weighed = F.aggregate(F.transform("back", lambda x, i: (i + 1) * x.cast("double")), F.lit(0.0), lambda s, x: s + x)
    return back.select("id", F.size("back").cast("long").alias("dims"), F.octet_length("raw").cast("long").alias("n_bytes"), F.round(weighed, 5).alias("weighed"), F.round(off, 7).alias("off"))
