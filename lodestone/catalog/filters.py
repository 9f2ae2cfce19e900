"""Scans, filters, projections, lists."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from lodestone.catalog.registry import query
from lodestone.operators import filters, listing
from lodestone.sources.tables import MEMORIES_SQL, MESSAGES_SQL, memories, messages, placed, table, tombstones

SHOW = ("id", "author", "rkey")
US = "CAST(epoch_us(created_at) AS BIGINT)"


@query(f"WITH {MEMORIES_SQL} SELECT id, author, rkey, array_to_string(tags, ',') AS tags, {US} AS created_us, length(text) AS n_chars FROM mem")
def scan_memories(spark: SparkSession, sf_dir: str) -> DataFrame:
    m = memories(spark, sf_dir)
    return m.select(*SHOW, F.array_join("tags", ",").alias("tags"), F.unix_micros("created_at").alias("created_us"), F.length("text").cast("long").alias("n_chars"))


@query(f"WITH {MEMORIES_SQL} SELECT id, author, rkey FROM mem WHERE author = 'src3'")
def filter_author(spark: SparkSession, sf_dir: str) -> DataFrame:
    return memories(spark, sf_dir).where(filters.by_author("src3")).select(*SHOW)


@query(f"WITH {MEMORIES_SQL} SELECT id, author, rkey FROM mem WHERE list_has_all(tags, ['en', 't1'])")
def filter_tags_all(spark: SparkSession, sf_dir: str) -> DataFrame:
    return memories(spark, sf_dir).where(filters.has_all_tags(["en", "t1"])).select(*SHOW)


@query(f"WITH {MEMORIES_SQL} SELECT id, author, rkey FROM mem WHERE created_at >= TIMESTAMP '2024-01-01 02:00:00' AND created_at < TIMESTAMP '2024-01-01 09:30:00'")
def filter_time_window(spark: SparkSession, sf_dir: str) -> DataFrame:
    return memories(spark, sf_dir).where(filters.in_window("2024-01-01 02:00:00", "2024-01-01 09:30:00")).select(*SHOW)


@query(f"WITH {MEMORIES_SQL} SELECT id, author, rkey FROM mem WHERE id NOT IN (SELECT doc_id FROM documents WHERE doc_id % 17 = 0)")
def filter_tombstones(spark: SparkSession, sf_dir: str) -> DataFrame:
    return filters.live(memories(spark, sf_dir), tombstones(spark, sf_dir)).select(*SHOW)


@query(f"WITH {MEMORIES_SQL} SELECT id, author, rkey FROM mem WHERE embedding IS NOT NULL AND len(embedding) = 64")
def filter_has_vector(spark: SparkSession, sf_dir: str) -> DataFrame:
    return memories(spark, sf_dir, vectors=True).where(filters.has_vector(64)).select(*SHOW)


@query(f"WITH {MEMORIES_SQL} SELECT id, author, rkey FROM mem WHERE text IS NOT NULL AND trim(regexp_replace(text, '\\s+', ' ', 'g')) <> ''")
def filter_nonblank(spark: SparkSession, sf_dir: str) -> DataFrame:
    return memories(spark, sf_dir).where(filters.not_blank()).select(*SHOW)


@query(f"""WITH {MEMORIES_SQL} SELECT id, author, rkey FROM mem
WHERE author = 'src0' AND list_contains(tags, 'en') AND created_at >= TIMESTAMP '2024-01-01 01:00:00'
  AND id NOT IN (SELECT doc_id FROM documents WHERE doc_id % 17 = 0)""")
def filter_conjunction(spark: SparkSession, sf_dir: str) -> DataFrame:
    m = memories(spark, sf_dir).where(filters.by_author("src0") & filters.has_all_tags(["en"]) & filters.in_window("2024-01-01 01:00:00"))
    return filters.live(m, tombstones(spark, sf_dir)).select(*SHOW)


@query(f"""WITH {MESSAGES_SQL} SELECT uri, author, created_s FROM msg WHERE len("to") = 0 OR list_contains("to", 'user') OR author = 'user'""")
def messages_for(spark: SparkSession, sf_dir: str) -> DataFrame:
    return messages(spark, sf_dir).where(filters.visible_to("user")).select("uri", "author", "created_s")


@query(f"""WITH {MEMORIES_SQL} SELECT id, CAST(floor(least(1.0::DOUBLE, greatest(0.0::DOUBLE, CAST(embedding[1] AS DOUBLE) * 3)) * 1000.0::DOUBLE) AS INTEGER) AS similarity,
  strftime(created_at, '%Y-%m-%dT%H:%M:%S.%gZ') AS created_at, array_to_string(coalesce(tags, []), ',') AS tags FROM mem""")
def view_projection(spark: SparkSession, sf_dir: str) -> DataFrame:
    m = memories(spark, sf_dir, vectors=True)
    sim = F.element_at("embedding", 1).cast("double") * 3.0
    sim = F.when(F.col("embedding").isNotNull(), filters.view_similarity(sim)).otherwise(F.lit(0))
    return m.select("id", sim.alias("similarity"), F.date_format("created_at", "yyyy-MM-dd'T'HH:mm:ss.SSS'Z'").alias("created_at"), F.array_join(F.coalesce("tags", F.array()), ",").alias("tags"))


@query(f"WITH {MEMORIES_SQL} SELECT id, strftime(created_at, '%Y-%m-%dT%H:%M:%S.%gZ') AS created_at FROM mem")
def fmt_ts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return memories(spark, sf_dir).select("id", F.date_format("created_at", "yyyy-MM-dd'T'HH:mm:ss.SSS'Z'").alias("created_at"))


@query("""WITH s AS (SELECT event_id, user_id, CAST(floor(least(1.0::DOUBLE, greatest(0.0::DOUBLE, value / 100)) * 1000) AS INTEGER) AS sim FROM events WHERE value IS NOT NULL),
f AS (SELECT *, max(sim) OVER (PARTITION BY user_id) AS best FROM s WHERE sim >= 600),
r AS (SELECT *, row_number() OVER (PARTITION BY user_id ORDER BY sim DESC, event_id) AS rn FROM f WHERE sim >= greatest(650, best - 80))
SELECT user_id, event_id, sim FROM r WHERE rn <= 6""")
def recall_floor(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Candidates of a session within 80 of its best and over 650, six at most."""
    sim = F.floor(F.least(F.lit(1.0), F.greatest(F.lit(0.0), F.col("value") / 100)) * 1000.0).cast("int")
    s = table(spark, sf_dir, "events").where("value IS NOT NULL").select("event_id", "user_id", sim.alias("sim")).where("sim >= 600")
    s = s.withColumn("best", F.max("sim").over(Window.partitionBy("user_id"))).where(F.col("sim") >= F.greatest(F.lit(650), F.col("best") - 80))
    rn = F.row_number().over(Window.partitionBy("user_id").orderBy(F.desc("sim"), "event_id"))
    return s.withColumn("rn", rn).where("rn <= 6").select("user_id", "event_id", "sim")


@query(f"""WITH {MEMORIES_SQL}, top AS (SELECT id, created_at FROM mem WHERE author = 'src1' ORDER BY created_at DESC, id LIMIT 10)
SELECT top.id, mem.author, mem.text FROM top JOIN mem USING (id)""")
def late_fetch(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Rank on narrow columns, then fetch the documents of the few winners."""
    m = memories(spark, sf_dir)
    top = m.where(filters.by_author("src1")).select("id", "created_at").orderBy(F.desc("created_at"), "id").limit(10)
    docs = memories(spark, sf_dir).select("id", "author", "text")
    return docs.join(F.broadcast(top.select("id")), "id").select("id", "author", "text")  # ten rows


@query("SELECT doc_id AS id, CASE WHEN doc_id % 10 < 8 THEN doc_id % 4 ELSE -1 END AS segment FROM documents")
def union_segments_buffer(spark: SparkSession, sf_dir: str) -> DataFrame:
    m = placed(memories(spark, sf_dir)).select("id", "segment")
    buffer = m.where("segment IS NULL").withColumn("segment", F.lit(-1).cast("long"))
    return m.where("segment IS NOT NULL").unionByName(buffer)


@query(f"WITH {MEMORIES_SQL} SELECT id, author, rkey, {US} AS created_us FROM mem ORDER BY created_at DESC, author DESC, rkey DESC LIMIT 25")
def list_newest(spark: SparkSession, sf_dir: str) -> DataFrame:
    return listing.newest_first(memories(spark, sf_dir), 25).select(*SHOW, F.unix_micros("created_at").alias("created_us"))


@query(f"""WITH {MEMORIES_SQL} SELECT id, {US} || '~' || author || '~' || rkey AS cursor FROM mem
WHERE created_at < TIMESTAMP '2024-01-01 02:00:00' OR (created_at = TIMESTAMP '2024-01-01 02:00:00' AND (author < 'src5' OR (author = 'src5' AND rkey < '120')))
ORDER BY created_at DESC, author DESC, rkey DESC LIMIT 25""")
def list_page2(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The page after the cursor 1704074400000000~src5~120."""
    m = memories(spark, sf_dir).where(listing.before_key(*listing.decode_cursor("1704074400000000~src5~120")))
    return listing.newest_first(m, 25).select("id", listing.encode_cursor(F.col("created_at"), F.col("author"), F.col("rkey")).alias("cursor"))


@query(f"""WITH {MESSAGES_SQL} SELECT uri, created_s FROM msg WHERE created_s > 1704067500 OR (created_s = 1704067500 AND uri > 'm/5/0') ORDER BY created_s, uri LIMIT 50""")
def messages_page(spark: SparkSession, sf_dir: str) -> DataFrame:
    return messages(spark, sf_dir).where(listing.after_message(1704067500, "m/5/0")).orderBy("created_s", "uri").limit(50).select("uri", "created_s")


@query(f"""WITH {MEMORIES_SQL}, t AS (SELECT max(created_at) - INTERVAL 10 MINUTE AS seen FROM mem),
page AS (SELECT id, author, created_at, rkey FROM mem CROSS JOIN t WHERE created_at < seen ORDER BY created_at DESC, author DESC, rkey DESC LIMIT 25),
came AS (SELECT id, author FROM mem ORDER BY created_at DESC, author DESC, rkey DESC LIMIT 25)
SELECT id, author, false AS fresh FROM page UNION ALL SELECT id, author, true FROM came WHERE id NOT IN (SELECT id FROM page)""")
def list_prepend(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A page read ten minutes ago, with what a poll brings now in front of it."""
    m = memories(spark, sf_dir)
    at = F.broadcast(m.agg((F.max("created_at") - F.expr("INTERVAL 10 MINUTES")).alias("at")))  # one row
    page = listing.newest_first(m.crossJoin(at).where("created_at < at"), 25).select("id", "author")
    return listing.prepend(page, listing.newest_first(m, 25).select("id", "author"), "id")


@query("SELECT author, count(*) AS nodes FROM (SELECT source AS author FROM documents) GROUP BY author")
def author_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return memories(spark, sf_dir).groupBy("author").agg(F.count("*").alias("nodes"))
