"""Spherical k-means against a plain loop, and the stored vector index: recall, files opened, tables that change."""

import hashlib

import numpy as np
import pytest
from pyspark.sql import functions as F

from lodestone.catalog import vectors as cv
from lodestone.operators import spherical
from lodestone.operators import vector_search as S
from lodestone.sources.vector_index import VectorIndex

DIMS = 16
SCHEMA = "id long, embedding array<float>"


def topical(n=3000, dims=64, topics=20, seed=1):
    rng = np.random.default_rng(seed)
    center = rng.normal(size=(topics, dims))
    x = center[rng.integers(0, topics, n)] + 0.6 * rng.normal(size=(n, dims))
    return (x / np.linalg.norm(x, axis=1)[:, None]).astype(np.float32)


def frame(spark, x, extra=()):
    return spark.createDataFrame([*((i, [float(v) for v in row]) for i, row in enumerate(x)), *extra], SCHEMA)


ODD = [(9001, None), (9002, []), (9003, [0.0] * DIMS), (9004, [float("nan")] * DIMS), (9005, [1.0] * (DIMS - 1)), (9006, [1.0] * (DIMS - 1) + [None]), (9007, [float("inf")] * DIMS)]


def plain(ids, x, k, rounds):
    """One row at a time, in the same fixed point."""
    u = x.astype(np.float64) / np.sqrt((x.astype(np.float64) ** 2).sum(1))[:, None]
    md5 = lambda seed: sorted(range(len(ids)), key=lambda i: (hashlib.md5(f"{seed}:{ids[i]}".encode()).hexdigest(), ids[i]))
    n, limit = len(ids), 32 * k
    drawn = [i for i in range(n) if n <= limit or int(hashlib.md5(f"sample:{ids[i]}".encode()).hexdigest()[:8], 16) / 2**32 * n < limit]
    order = lambda seed: [i for i in md5(seed) if i in set(drawn)]
    centers = [u[i] for i in order("start")[:k]]
    for r in range(rounds):
        sums = [np.zeros(x.shape[1]) for _ in centers]
        met = [0] * len(centers)
        for i in drawn:
            s = [round(float(u[i] @ c), 6) for c in centers]
            j = s.index(max(s))
            sums[j] += np.floor(u[i] * spherical.FIXED + 0.5)
            met[j] += 1
        again = iter(order(f"round{r}"))
        centers = [s / np.sqrt((s * s).sum()) if m and (s * s).sum() > 0 else u[next(again)] for s, m in zip(sums, met, strict=True)]
    return np.array(centers)


@pytest.mark.parametrize("k,n", [(3, 200), (40, 60)])
def test_centres_equal_a_plain_loop(spark, k, n):
    x = topical(n, DIMS, 5, seed=k)
    x[10:40] = x[9]  # repeated vectors leave clusters empty, which begin again
    df = frame(spark, x, ODD)
    got = spherical.train(df.repartition(5), k, DIMS, rounds=3)
    assert np.allclose(got, plain(list(range(n)), x, k, 3), atol=1e-12)
    assert (got == spherical.train(df.repartition(2), k, DIMS, rounds=3)).all()


def test_few_and_no_vectors(spark):
    assert len(spherical.train(frame(spark, topical(3, DIMS)), 8, DIMS)) == 3
    assert len(spherical.train(spark.createDataFrame([], SCHEMA), 8, DIMS)) == 0


def test_the_shortlist_measures_the_nearest_codes_only():
    rng = np.random.default_rng(0)
    x, c = rng.normal(size=(500, 70)), rng.normal(size=(40, 70))
    x, c = x / np.linalg.norm(x, axis=1)[:, None], c / np.linalg.norm(c, axis=1)[:, None]
    c[7] = c[3]
    got = spherical.nearest(x, c, 8)
    for row, mine in zip(x, got, strict=True):
        apart = [int(((row > 0) != (y > 0)).sum()) for y in c]
        few = sorted(range(40), key=lambda j: (apart[j], j))[:8]
        assert mine == max(few, key=lambda j: (round(float(row @ c[j]), 6), -j))
    assert (spherical.nearest(x, c, 40) == spherical.nearest(x, c)).all() and 7 not in got


@pytest.fixture(scope="module")
def stored(spark, tmp_path_factory):
    x = topical()
    df = frame(spark, x, [(9001, None), (9002, [0.0] * 64), (9003, [1.0] * 8)])
    return x, VectorIndex.build(df, 64, str(tmp_path_factory.mktemp("vectors") / "v"))


def test_recall_of_a_hundred_queries(spark, stored):
    x, index = stored
    ask = spark.createDataFrame([(i, [float(v) for v in x[i]]) for i in range(0, 3000, 30)], "query_id long, embedding array<float>")
    got = {}
    for r in index.search_batch(ask, 10).collect():
        got.setdefault(r.query_id, set()).add(r.id)
    hits = sum(len(got[i] & set(np.argsort(-(x @ x[i]), kind="stable")[:10].tolist())) for i in range(0, 3000, 30))
    assert len(got) == 100 and hits >= 950
    assert index.codes().count() == 3000
    first = sum(i in got[i] for i in got)
    assert first >= 95


def test_a_search_opens_the_probed_folders_only(stored):
    x, index = stored
    query = [float(v) for v in x[5]]
    probed = index.probed(query)
    inside = index.codes().where(F.col("cluster").isin(probed))
    plan = index.search(query, 10)._jdf.queryExecution().executedPlan().toString()
    assert "PartitionFilters" in plan and f"cluster" in plan.split("PartitionFilters")[1][:200]
    assert {int(r[0].split("cluster=")[1].split("/")[0]) for r in inside.select(F.input_file_name()).distinct().collect()} <= set(probed)
    assert len(probed) == S.probes(len(index.centers)) < len(index.centers) / 2
    got = index.search(query, 10).collect()
    assert got[0].id == 5 and [(r.sim, -r.id) for r in got] == sorted(((r.sim, -r.id) for r in got), reverse=True)
    # all clusters: the exact search over codes
    everything = S.vector_search(index.codes(), query, 10).collect()
    assert index.search(query, 10, probes=len(index.centers)).collect() == everything


def test_batches_and_odd_queries(spark, stored):
    x, index = stored
    ask = spark.createDataFrame([(1, [float(v) for v in x[1]]), (2, None), (3, [0.0] * 64), (4, [1.0]), (None, [1.0] * 64), (1, [float(v) for v in x[1]])], "query_id long, embedding array<float>")
    got = index.search_batch(ask.limit(1), 5, probes=len(index.centers)).orderBy("rank").collect()
    everything = S.similarity(index.codes(), x[1].tolist()).orderBy(F.desc("sim"), "id").limit(5).collect()
    assert [(r.id, r.sim) for r in got] == [(r.id, r.sim) for r in everything]
    assert {r.query_id for r in index.search_batch(ask, 5).collect()} == {1}


def test_an_index_of_nothing(spark, tmp_path):
    index = VectorIndex.build(spark.createDataFrame(ODD, SCHEMA), 64, str(tmp_path / "none"))
    assert index.search([1.0] * 64, 5).count() == 0
    assert index.search_batch(spark.createDataFrame([(1, [1.0] * 64)], "query_id long, embedding array<float>"), 5).count() == 0


def test_the_shared_vector_index_follows_its_table(spark, tmp_path):
    sf = str(tmp_path)

    def put(seed):
        rows = frame(spark, topical(50, 64, 3, seed)).select(F.col("id").alias("vec_id"), "embedding", F.lit(0).alias("label"))
        rows.write.mode("overwrite").parquet(f"{sf}/embeddings.parquet")

    put(1)
    first = cv.vector_index(spark, sf)
    assert cv.vector_index(spark, sf) is first
    put(2)
    second = cv.vector_index(spark, sf)
    assert second.root != first.root and not np.allclose(second.centers, first.centers)


def test_assignment_to_given_centres(spark):
    centers = spark.createDataFrame([(5, [1.0, 0.0]), (2, [0.0, 1.0]), (9, [0.0, 1.0]), (1, None)], "cluster int, center array<double>")
    rows = spark.createDataFrame([(1, [3.0, 1.0]), (2, [0.5, 2.0]), (3, [1.0, 1.0]), (4, None), (5, [1.0]), (6, [])], SCHEMA)
    assert {r.id: r.cluster for r in S.assign(rows, centers).collect()} == {1: 5, 2: 2, 3: 2}
    assert S.assign(rows, centers.limit(0)).count() == 0
