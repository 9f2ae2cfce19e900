"""The tables and the views that queries share. The same views exist as SQL for the oracle."""

from __future__ import annotations

import re
import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

#: First created_at of the memories view: 2024-01-01T00:00:00Z.
EPOCH_S = 1_704_067_200


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def scratch(spark: SparkSession, name: str) -> str:
    """A new folder that all executors share: under spark.checkpoint.dir, or a temporary one on a single machine."""
    shared = spark.conf.get("spark.checkpoint.dir", None)
    master = spark.sparkContext.master
    if not shared and not re.fullmatch(r"local(\[.*\])?", master):
        raise RuntimeError(f"set spark.checkpoint.dir to a folder that all executors of {master} share")
    return f"{(shared or tempfile.mkdtemp(prefix='spark-scratch-')).rstrip('/')}/{name}-{uuid.uuid4().hex}"


def spread(rows: DataFrame) -> DataFrame:
    """`rows` over all cores if the files give fewer partitions than there are: a small table in one row group.

    A table of many files already has more partitions and stays as it is, so large inputs are never shuffled.
    """
    cores = rows.sparkSession.sparkContext.defaultParallelism
    return rows.repartition(cores) if rows.rdd.getNumPartitions() < cores else rows


def memories(spark: SparkSession, sf_dir: str, vectors: bool = False) -> DataFrame:
    """Documents as memories: one a minute, tagged with language and a topic; with vectors where asked for."""
    d = table(spark, sf_dir, "documents")
    out = d.select(
        F.col("doc_id").alias("id"),
        F.col("source").alias("author"),
        F.col("doc_id").cast("string").alias("rkey"),
        "text",
        F.array(F.col("lang"), F.concat(F.lit("t"), (F.col("doc_id") % 4).cast("string"))).alias("tags"),
        F.col("source"),
        F.timestamp_seconds(F.lit(EPOCH_S) + F.col("doc_id") * 60).alias("created_at"),
    )
    if vectors:
        e = table(spark, sf_dir, "embeddings").select(F.col("vec_id").alias("id"), "embedding", "label")
        out = out.join(e, "id", "left")
    return out


MEMORIES_SQL = """mem AS (
  SELECT d.doc_id AS id, d.source AS author, CAST(d.doc_id AS VARCHAR) AS rkey, d.text, [d.lang, 't' || (d.doc_id % 4)] AS tags,
         d.source, TIMESTAMP '2024-01-01' + to_minutes(CAST(d.doc_id AS INTEGER)) AS created_at, e.embedding, e.label
  FROM documents d LEFT JOIN embeddings e ON d.doc_id = e.vec_id
)"""


def events(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Events with an instant: ts is read without a zone and taken as UTC."""
    return table(spark, sf_dir, "events").withColumn("ts", F.col("ts").cast("timestamp"))


def messages(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Conversation turns as messages: one a second, system turns to everybody, others to the other side."""
    c = table(spark, sf_dir, "conversations")
    other = F.when(F.col("role") == "user", F.array(F.lit("assistant"))).when(F.col("role") == "assistant", F.array(F.lit("user")))
    created = F.lit(EPOCH_S) + F.col("conv_id") * 60 + F.col("turn")
    return c.select(
        F.concat(F.lit("m/"), F.col("conv_id").cast("string"), F.lit("/"), F.col("turn").cast("string")).alias("uri"),
        F.col("conv_id").alias("thread"),
        "turn",
        F.col("role").alias("author"),
        F.coalesce(other, F.array().cast("array<string>")).alias("to"),
        "text",
        created.alias("created_s"),
        (created + 3600 * (1 + F.col("conv_id") % 3)).alias("expires_s"),
    )


MESSAGES_SQL = f"""msg AS (
  SELECT 'm/' || conv_id || '/' || turn AS uri, conv_id AS thread, turn, role AS author,
         CASE role WHEN 'user' THEN ['assistant'] WHEN 'assistant' THEN ['user'] ELSE CAST([] AS VARCHAR[]) END AS "to",
         text, {EPOCH_S} + conv_id * 60 + turn AS created_s, {EPOCH_S} + conv_id * 60 + turn + 3600 * (1 + conv_id % 3) AS expires_s
  FROM conversations
)"""


def placed(memories: DataFrame) -> DataFrame:
    """Where each memory lies: eight of ten flushed to segments 0 to 3, the others in the write buffer (null)."""
    return memories.withColumn("segment", F.when(F.col("id") % 10 < 8, F.col("id") % 4))


def tombstones(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Ids that a later change deleted."""
    return table(spark, sf_dir, "documents").where(F.col("doc_id") % 17 == 0).select(F.col("doc_id").alias("id"))
