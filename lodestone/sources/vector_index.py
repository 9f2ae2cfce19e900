"""A stored vector index: codes in one folder for each cluster, so that a search opens the folders it probes.

Centres come from spherical k-means on a sample; every vector goes to the best of the eight centres whose sign
codes are nearest to its own. A search measures the centres, opens the nearest clusters' folders and ranks their
codes: candidates by differing sign bits, then by int8 products. Batches of queries meet each cluster in blocks.
"""

from __future__ import annotations

from collections.abc import Iterator, Sequence

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from lodestone.operators import spherical
from lodestone.operators import vector_search as S
from lodestone.sources.index import shared
from lodestone.sources.tables import scratch

#: Rows of a block in which a batch of queries meets a cluster.
ROWS = 512


class VectorIndex:
    def __init__(self, spark: SparkSession, root: str):
        self.spark, self.root = spark, root.rstrip("/")
        rows = spark.read.parquet(f"{self.root}/centers").orderBy("cluster").collect()  # 4,096 at most
        self.centers = np.array([r.center for r in rows], np.float64) if rows else np.zeros((0, 0))
        self._codes: DataFrame | None = None

    @classmethod
    def build(cls, vectors: DataFrame, dims: int, root: str, k: int | None = None) -> VectorIndex:
        """Write the index of (id, embedding) rows. Vectors of other lengths or without a direction are left out."""
        spark = vectors.sparkSession
        held = spherical.directed(vectors, dims)
        centers = spherical.train(held, k or S.cluster_count(held.count()), dims)
        spark.createDataFrame([(i, c) for i, c in enumerate(centers.tolist())], "cluster int, center array<double>").coalesce(1).write.parquet(f"{root}/centers")
        if not len(centers):
            centers = np.zeros((1, dims))  # nothing to place
        codes = S.coded(spherical.assign(held, centers), dims, "cluster")
        # a crowded cluster spreads over files; each is sorted by id
        codes.repartitionByRange("cluster", "id").sortWithinPartitions("cluster", "id").write.partitionBy("cluster").parquet(f"{root}/codes")
        return cls(spark, root)

    @classmethod
    def temporary(cls, vectors: DataFrame, dims: int) -> VectorIndex:
        return cls.build(vectors, dims, scratch(vectors.sparkSession, "vectors"))

    @classmethod
    def shared(cls, spark: SparkSession, table: str, vectors, dims: int) -> VectorIndex:
        """The application's index of the table at this path, built again once the table's files have changed."""
        return shared(spark, f"vectors{dims}", table, lambda: cls.temporary(vectors(), dims))

    def codes(self) -> DataFrame:
        """(id, words, scale, code, cluster); clusters are folders."""
        if self._codes is None:
            schema = "id long, words array<long>, scale float, code array<int>, cluster int"
            self._codes = self.spark.read.schema(schema).parquet(f"{self.root}/codes")
        return self._codes

    def probed(self, query: Sequence[float], probes: int | None = None) -> list[int]:
        """The clusters that a query visits, nearest first, ties to the smaller number."""
        if not len(self.centers):
            return []
        products = np.round(self.centers @ np.asarray(S.unit(query)), 6)
        return np.lexsort((np.arange(len(products)), -products))[: probes or S.probes(len(products))].tolist()

    def search(self, query: Sequence[float], limit: int, probes: int | None = None, candidates: int = S.CANDIDATES) -> DataFrame:
        """(id, dist, sim) of the best `limit` in the clusters nearest to the query."""
        inside = self.codes().where(F.col("cluster").isin(self.probed(query, probes)))
        return S.vector_search(inside, query, limit, candidates)

    def search_batch(self, queries: DataFrame, k: int, probes: int | None = None) -> DataFrame:
        """(query_id, rank, id, sim) for queries (query_id, embedding), by int8 products in the clusters that each visits."""
        centers, dims = self.centers, self.centers.shape[1] if len(self.centers) else 0
        most = probes or S.probes(max(1, len(centers)))

        def ask(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for batch in batches:
                own, x = spherical._units(batch, dims)
                if not len(own):
                    continue
                ids = batch.column(0).to_numpy()[own]
                order = np.argsort(-np.round(x @ centers.T, 6), axis=1, kind="stable")[:, :most]
                row, at = np.repeat(np.arange(len(x)), order.shape[1]), order.ravel()
                for c in np.unique(at).tolist():
                    mine = row[at == c]
                    for lo in range(0, len(mine), ROWS):
                        few = mine[lo : lo + ROWS]
                        yield pa.RecordBatch.from_pydict({"cluster": pa.array([c], pa.int32()), "q_ids": pa.array([ids[few].astype("<i8").tobytes()], pa.binary()), "queries": pa.array([x[few].tobytes()], pa.binary())})

        def pack(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for batch in batches:
                cluster = batch.column(0).to_numpy()
                cuts = np.unique(np.r_[0, np.flatnonzero(np.diff(cluster)) + 1, len(cluster)])
                for a, b in zip(cuts[:-1].tolist(), cuts[1:].tolist(), strict=True):
                    for lo in range(a, b, ROWS):
                        n = min(b, lo + ROWS) - lo
                        part = batch.slice(lo, n)
                        code = part.column(3).flatten().to_numpy().astype(np.float64).reshape(n, -1) * part.column(2).to_numpy().astype(np.float64)[:, None]
                        yield pa.RecordBatch.from_pydict({"cluster": part.column(0).slice(0, 1), "ids": pa.array([part.column(1).to_numpy().astype("<i8").tobytes()], pa.binary()), "vectors": pa.array([code.tobytes()], pa.binary())})

        def meet(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for batch in batches:
                for q_ids, q, ids, v in zip(*(batch.column(c) for c in ("q_ids", "queries", "ids", "vectors")), strict=True):
                    q_ids, ids = np.frombuffer(q_ids.as_py(), "<i8"), np.frombuffer(ids.as_py(), "<i8")
                    s = np.round(np.frombuffer(q.as_py()).reshape(len(q_ids), -1) @ np.frombuffer(v.as_py()).reshape(len(ids), -1).T, 6)
                    order = np.lexsort((np.broadcast_to(ids, s.shape), -s), axis=1)[:, :k]
                    yield pa.RecordBatch.from_pydict({"query_id": pa.array(np.repeat(q_ids, order.shape[1])), "id": pa.array(ids[order].ravel()), "sim": pa.array(np.take_along_axis(s, order, 1).ravel())})

        asked = queries.where("query_id IS NOT NULL").select("query_id", "embedding").dropDuplicates(["query_id"]).mapInArrow(ask, "cluster int, q_ids binary, queries binary")
        blocks = self.codes().select("cluster", "id", "scale", "code").mapInArrow(pack, "cluster int, ids binary, vectors binary")
        found = asked.join(blocks, "cluster").mapInArrow(meet, "query_id long, id long, sim double")
        rank = F.row_number().over(Window.partitionBy("query_id").orderBy(F.desc("sim"), "id"))
        return found.withColumn("rank", rank).where(F.col("rank") <= k).select("query_id", "rank", "id", "sim")

