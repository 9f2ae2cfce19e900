"""Change feeds, store life cycle and control tables."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from lodestone.catalog.registry import query
from lodestone.operators import feeds, filters, running, versions
from lodestone.operators import model_change as changing
from lodestone.sources.store import missing_embeddings
from lodestone.sources.tables import MEMORIES_SQL, events, memories, placed, table, tombstones

OPS_SQL = """ops AS (SELECT row_number() OVER (ORDER BY ts, event_id) AS seq, event_id, ts, user_id AS path, CASE WHEN event_type = 'error' THEN 'delete' ELSE 'upsert' END AS op, value FROM events),
fold AS (SELECT path, max_by({'op': op, 'value': value, 'event_id': event_id}, {'t': ts, 'i': event_id}) AS x, count(*) AS changes FROM ops GROUP BY path)"""


def _folded(spark: SparkSession, sf_dir: str) -> DataFrame:
    e = events(spark, sf_dir)
    ops = e.select(F.col("user_id").alias("path"), "ts", "event_id", F.when(F.col("event_type") == "error", "delete").otherwise("upsert").alias("op"), "value")
    return feeds.latest(ops, ["path"], ["ts", "event_id"], ["op", "value"])


@query(f"WITH {OPS_SQL} SELECT path, x.event_id AS event_id, x.op AS op, CASE WHEN x.op = 'upsert' THEN x.value END AS value FROM fold")
def cdc_latest(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _folded(spark, sf_dir).select("path", "event_id", "op", F.when(F.col("op") == "upsert", F.col("value")).alias("value"))


@query(f"""WITH {OPS_SQL} SELECT c_custkey AS path, c_acctbal AS value FROM customer WHERE c_custkey NOT IN (SELECT path FROM fold)
UNION ALL SELECT path, x.value FROM fold WHERE x.op = 'upsert'""")
def cdc_upsert(spark: SparkSession, sf_dir: str) -> DataFrame:
    stored = table(spark, sf_dir, "customer").select(F.col("c_custkey").cast("long").alias("path"), F.col("c_acctbal").cast("double").alias("value"))
    return feeds.upsert(stored, _folded(spark, sf_dir))


@query("""WITH s AS (SELECT doc_id AS id, source AS author FROM documents WHERE doc_id % 10 < 8), n AS (SELECT doc_id AS id, source AS author FROM documents WHERE source IN ('src1', 'src2') AND doc_id % 3 = 0)
SELECT id, author FROM s WHERE author NOT IN (SELECT author FROM n) UNION ALL SELECT id, author FROM n""")
def snapshot_replace(spark: SparkSession, sf_dir: str) -> DataFrame:
    m = memories(spark, sf_dir).select("id", "author")
    return feeds.snapshot_replace(m.where("id % 10 < 8"), m.where("author IN ('src1', 'src2') AND id % 3 = 0"))


@query("SELECT DISTINCT source AS author FROM documents WHERE source NOT IN (SELECT source FROM documents JOIN labels USING (doc_id) WHERE toxic = 1)")
def removed_repos(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Known authors that a listing (of those with a toxic document) lacks."""
    d = table(spark, sf_dir, "documents")
    known = d.select(F.col("source").alias("author")).distinct()
    return feeds.removed(known, d.join(table(spark, sf_dir, "labels").where("toxic = 1"), "doc_id").select(F.col("source").alias("author")), "author")


@query(f"WITH {MEMORIES_SQL} SELECT author, count(*) FILTER (WHERE embedding IS NULL OR len(embedding) <> 64) AS skipped FROM mem GROUP BY author")
def skipped_by_author(spark: SparkSession, sf_dir: str) -> DataFrame:
    ok = F.coalesce(filters.has_vector(64), F.lit(False))
    return memories(spark, sf_dir, vectors=True).groupBy("author").agg(F.count_if(~ok).alias("skipped"))


@query(f"""WITH {MEMORIES_SQL}, p AS (SELECT *, CASE WHEN id % 10 < 8 THEN id % 4 END AS segment, id % 17 = 0 AS dead FROM mem)
SELECT count(*) FILTER (WHERE NOT dead) AS live, count(*) FILTER (WHERE segment IS NULL AND NOT dead) AS buffered, count(*) FILTER (WHERE dead) AS deleted, count(DISTINCT segment) AS segments,
count(*) FILTER (WHERE embedding IS NULL) AS skipped FROM p""")
def space_status(spark: SparkSession, sf_dir: str) -> DataFrame:
    p = placed(memories(spark, sf_dir, vectors=True)).join(tombstones(spark, sf_dir).withColumn("gone", F.lit(True)), "id", "left")
    dead = F.col("gone").isNotNull()
    return p.agg(F.count_if(~dead).alias("live"), F.count_if(F.col("segment").isNull() & ~dead).alias("buffered"), F.count_if(dead).alias("deleted"), F.count_distinct("segment").alias("segments"), F.count_if(F.col("embedding").isNull()).alias("skipped"))


@query("SELECT doc_id % 4 AS segment, count(*) AS n, count(*) FILTER (WHERE doc_id % 17 = 0) AS dead, round(avg(CASE WHEN doc_id % 17 = 0 THEN 1.0 ELSE 0.0 END), 6) AS ratio FROM documents WHERE doc_id % 10 < 8 GROUP BY 1")
def dead_ratio(spark: SparkSession, sf_dir: str) -> DataFrame:
    p = placed(memories(spark, sf_dir)).where("segment IS NOT NULL").join(tombstones(spark, sf_dir).withColumn("gone", F.lit(1)), "id", "left")
    gone = F.coalesce("gone", F.lit(0))
    return p.groupBy("segment").agg(F.count("*").alias("n"), F.count_if(gone == 1).alias("dead"), F.round(F.avg(gone), 6).alias("ratio"))


@query("SELECT source AS author, CAST(sum(octet_length(encode(text)) + octet_length(encode(source))) AS BIGINT) AS bytes FROM documents WHERE doc_id % 17 <> 0 GROUP BY 1")
def live_bytes(spark: SparkSession, sf_dir: str) -> DataFrame:
    m = filters.live(memories(spark, sf_dir), tombstones(spark, sf_dir))
    return m.groupBy("author").agg(F.sum(F.octet_length("text") + F.octet_length("source")).alias("bytes"))


@query("""WITH s AS (SELECT CAST(o_orderkey % 11 AS INTEGER) AS segment, count(*) AS n, count(*) FILTER (WHERE o_orderstatus = 'F' AND o_orderkey % 3 = 0) AS dead, o_orderkey % 11 < 6 AS old FROM orders GROUP BY ALL),
t AS (SELECT *, count(*) OVER () AS c, sum(n) OVER () AS rows_, sum(dead) OVER () AS gone, sum(CASE WHEN old THEN 1 ELSE 0 END) OVER () AS olds FROM s)
SELECT segment, n, dead, old FROM t WHERE (c > 8 OR (rows_ > 0 AND gone / rows_ > 0.25)) AND CASE WHEN olds >= 2 AND c - olds + 1 <= 8 THEN old ELSE c >= 2 OR gone > 0 END""")
def merge_candidates(spark: SparkSession, sf_dir: str) -> DataFrame:
    o = table(spark, sf_dir, "orders")
    seg = (F.col("o_orderkey") % 11).cast("int")
    s = o.groupBy(seg.alias("segment")).agg(F.count("*").alias("n"), F.count_if((F.col("o_orderstatus") == "F") & (F.col("o_orderkey") % 3 == 0)).alias("dead"))
    return feeds.merge_inputs(s.withColumn("old", F.col("segment") < 6))


MAN_SQL = "man AS (SELECT CAST(o_custkey % 7 AS INTEGER) AS space, CAST(o_orderkey % 5 AS INTEGER) AS token, CAST(o_orderkey AS BIGINT) AS generation FROM orders)"


def _manifests(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "orders").select((F.col("o_custkey") % 7).cast("int").alias("space"), (F.col("o_orderkey") % 5).cast("int").alias("token"), F.col("o_orderkey").cast("long").alias("generation"))


@query(f"WITH {MAN_SQL}, r AS (SELECT *, row_number() OVER (PARTITION BY space ORDER BY token DESC, generation DESC) AS n FROM man) SELECT space, token, generation FROM r WHERE n = 1")
def latest_manifest(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The highest token wins, then the highest generation: a writer with an old token is fenced off."""
    return feeds.latest(_manifests(spark, sf_dir), ["space"], ["token", "generation"], [])


@query("""WITH m AS (SELECT l_orderkey % 400 AS segment, max(l_shipdate) AS written FROM lineitem GROUP BY 1), used AS (SELECT DISTINCT o_orderkey % 400 AS segment FROM orders WHERE o_orderkey % 4 = 0), t AS (SELECT max(l_shipdate) AS now FROM lineitem)
SELECT CAST(segment AS INTEGER) AS segment FROM m CROSS JOIN t WHERE segment NOT IN (SELECT segment FROM used) AND written < now - INTERVAL 1 DAY""")
def gc_candidates(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Files that no manifest names and that are past their retention."""
    li = table(spark, sf_dir, "lineitem")
    m = li.groupBy((F.col("l_orderkey") % 400).alias("segment")).agg(F.max("l_shipdate").alias("written"))
    used = table(spark, sf_dir, "orders").where("o_orderkey % 4 = 0").select((F.col("o_orderkey") % 400).alias("segment")).distinct()
    now = F.broadcast(li.agg(F.max("l_shipdate").alias("now")))  # one row
    return m.join(used, "segment", "left_anti").crossJoin(now).where(F.col("written") < F.col("now") - F.expr("INTERVAL 1 DAY")).select(F.col("segment").cast("int").alias("segment"))


@query("SELECT DISTINCT doc_id AS id FROM (SELECT doc_id FROM documents WHERE doc_id % 17 = 0 UNION SELECT doc_id FROM documents WHERE doc_id % 23 = 0) WHERE doc_id NOT IN (SELECT doc_id FROM labels WHERE toxic = 1)")
def bitmap_andnot(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(published or new tombstones) but not those still held."""
    d = table(spark, sf_dir, "documents").select(F.col("doc_id").alias("id"))
    dead = d.where("id % 17 = 0").union(d.where("id % 23 = 0")).distinct()
    return dead.join(table(spark, sf_dir, "labels").where("toxic = 1").select(F.col("doc_id").alias("id")), "id", "left_anti")


@query("SELECT CAST(p_partkey % 50 AS INTEGER) AS segment, count(*) AS n, CAST(max(p_size) AS INTEGER) AS analyzer FROM part GROUP BY 1 HAVING max(p_size) <> 50")
def uncovered_segments(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Segments whose analyzer version is not the current one (50)."""
    p = table(spark, sf_dir, "part").groupBy((F.col("p_partkey") % 50).cast("int").alias("segment")).agg(F.count("*").alias("n"), F.max("p_size").cast("int").alias("analyzer"))
    return p.where("analyzer <> 50")


@query("""WITH w AS (SELECT user_id % 5 AS space, CAST(ts AS DATE) AS day, event_id, row_number() OVER (PARTITION BY user_id % 5, CAST(ts AS DATE) ORDER BY ts, event_id) AS n FROM events)
SELECT space, strftime(day, '%Y-%m-%d') AS day, count(*) FILTER (WHERE n <= 50) AS taken, count(*) FILTER (WHERE n > 50) AS held FROM w GROUP BY ALL""")
def daily_quota(spark: SparkSession, sf_dir: str) -> DataFrame:
    e = events(spark, sf_dir).select((F.col("user_id") % 5).alias("space"), F.to_date("ts").alias("day"), "ts", "event_id")
    q = feeds.daily_quota(e, 50, ["ts", "event_id"], F.date_trunc("minute", F.col("ts")))
    return q.groupBy("space", F.date_format("day", "yyyy-MM-dd").alias("day")).agg(F.count_if(~F.col("held")).alias("taken"), F.count_if(F.col("held")).alias("held"))


@query("""WITH r AS (SELECT source AS space, doc_id, octet_length(encode(text)) AS size, sum(octet_length(encode(text))) OVER (PARTITION BY source ORDER BY doc_id ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW) AS total, row_number() OVER (PARTITION BY source ORDER BY doc_id) AS n FROM documents)
SELECT space, count(*) FILTER (WHERE total <= 200000 AND n <= 300) AS taken, coalesce(min(doc_id) FILTER (WHERE total > 200000 OR n > 300), -1) AS held_from FROM r GROUP BY space""")
def limit_holdback(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Writes of a space in order until its bytes or count are over the limit; from there on they are held."""
    d = table(spark, sf_dir, "documents").select(F.col("source").alias("space"), "doc_id", F.octet_length("text").cast("long").alias("size"))
    d = running.running(d, ["space"], ["doc_id"], running.id_range("doc_id"), {"total": "size"})
    fits = (F.col("total") <= 200000) & (F.col("n") <= 300)
    return d.groupBy("space").agg(F.count_if(fits).alias("taken"), F.coalesce(F.min(F.when(~fits, F.col("doc_id"))), F.lit(-1)).alias("held_from"))


@query("""WITH k AS (SELECT DISTINCT substr(sha256('m1' || chr(0) || text), 1, 32) AS key FROM documents), c AS (SELECT substr(sha256('m1' || chr(0) || text), 1, 32) AS key FROM documents WHERE lang = 'en')
SELECT key FROM k WHERE key NOT IN (SELECT key FROM c)""")
def embed_cache_missing(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Distinct texts whose vector the cache (that of the English ones) lacks."""
    d = table(spark, sf_dir, "documents")
    cache = d.where("lang = 'en'").select(F.substring(F.sha2(F.concat(F.lit("m1\0"), F.col("text")), 256), 1, 32).alias("key"))
    return missing_embeddings(d.select("text"), cache, "m1").select("key")


@query("""WITH f AS (SELECT user_id, event_id AS rev, lag(event_id) OVER (PARTITION BY user_id % 3 ORDER BY event_id) AS before FROM events) SELECT rev, before FROM f WHERE before IS NOT NULL AND rev > before + 1""")
def feed_gaps(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Revisions of a space's feed that skip some: a sign of missed updates."""
    f = table(spark, sf_dir, "events").select((F.col("user_id") % 3).alias("space"), F.col("event_id").alias("rev"))
    return feeds.gaps(f, "space", "rev").select("rev", "before")


@query("""WITH r AS (SELECT doc_id AS id, source AS node, n_chars, row_number() OVER (PARTITION BY source ORDER BY (doc_id * 31) % 997 DESC, doc_id DESC) AS n,
sum(n_chars) OVER (PARTITION BY source ORDER BY (doc_id * 31) % 997 DESC, doc_id DESC ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW) AS total FROM documents) SELECT id, node FROM r WHERE n > 1 AND total > 50000""")
def lru_evict(spark: SparkSession, sf_dir: str) -> DataFrame:
    d = table(spark, sf_dir, "documents").select(F.col("doc_id").alias("id"), F.col("source").alias("node"), "n_chars", ((F.col("doc_id") * 31) % 997).alias("used"))
    return feeds.over_budget(d, 50000, "used", "n_chars", "id", "node").select("id", "node")


@query("""WITH r AS (SELECT o_custkey, o_orderkey, row_number() OVER (PARTITION BY o_custkey ORDER BY o_orderdate DESC, o_orderkey DESC) AS n FROM orders) SELECT o_custkey, o_orderkey FROM r WHERE n <= 3""")
def lru_per_account(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The three most recently used grants of each account."""
    n = F.row_number().over(Window.partitionBy("o_custkey").orderBy(F.desc("o_orderdate"), F.desc("o_orderkey")))
    return table(spark, sf_dir, "orders").select("o_custkey", "o_orderkey", "o_orderdate").withColumn("n", n).where("n <= 3").select("o_custkey", "o_orderkey")


@query("SELECT c_custkey FROM customer WHERE NOT EXISTS (SELECT 1 FROM orders WHERE o_custkey = c_custkey AND o_orderstatus = 'F') ORDER BY c_acctbal, c_custkey LIMIT 1")
def oldest_unreferenced(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The client that no grant refers to, the oldest first."""
    o = table(spark, sf_dir, "orders").where("o_orderstatus = 'F'").select(F.col("o_custkey").alias("c_custkey"))
    return table(spark, sf_dir, "customer").join(o, "c_custkey", "left_anti").orderBy("c_acctbal", "c_custkey").limit(1).select("c_custkey")


@query("SELECT o_orderkey FROM orders WHERE o_orderdate < TIMESTAMP '1996-01-01' AND o_orderkey NOT IN (SELECT l_orderkey FROM lineitem WHERE l_quantity > 45)")
def stale_sessions(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Old sessions that no grant uses."""
    o = table(spark, sf_dir, "orders").where(F.col("o_orderdate") < F.lit("1996-01-01").cast("timestamp_ntz"))
    used = table(spark, sf_dir, "lineitem").where("l_quantity > 45").select(F.col("l_orderkey").alias("o_orderkey"))
    return o.join(used, "o_orderkey", "left_anti").select("o_orderkey")


@query("SELECT count(*) FILTER (WHERE o_orderstatus = 'F') AS expired, count(*) FILTER (WHERE o_orderstatus = 'O' AND o_totalprice < 1000) AS dropped, count(*) FILTER (WHERE o_orderstatus = 'F' OR (o_orderstatus = 'O' AND o_totalprice < 1000)) AS total FROM orders")
def delete_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Rows that two deletes take, and both together."""
    a, b = F.col("o_orderstatus") == "F", (F.col("o_orderstatus") == "O") & (F.col("o_totalprice") < 1000)
    return table(spark, sf_dir, "orders").agg(F.count_if(a).alias("expired"), F.count_if(b).alias("dropped"), F.count_if(a | b).alias("total"))


VER_SQL = """v AS (SELECT 'skill' || (doc_id % 40) AS name, doc_id AS uri, CASE WHEN source = 'src0' THEN 0 WHEN source = 'src1' THEN 1 ELSE 2 END AS who, (doc_id * 37) % 1000 AS updated FROM documents),
r AS (SELECT *, row_number() OVER (PARTITION BY name ORDER BY who, updated DESC, uri) AS n, count(*) OVER (PARTITION BY name) - 1 AS shadowed FROM v)"""


@query(f"WITH {VER_SQL} SELECT name, uri, shadowed FROM r WHERE n = 1")
def resolve_versions(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Of each name one's own version wins, then the authority's, then the newest; others are shadowed."""
    who = F.when(F.col("source") == "src0", 0).when(F.col("source") == "src1", 1).otherwise(2)
    v = table(spark, sf_dir, "documents").select(F.concat(F.lit("skill"), (F.col("doc_id") % 40).cast("string")).alias("name"), who.alias("who"), (-((F.col("doc_id") * 37) % 1000)).alias("age"), F.col("doc_id").alias("uri"))
    best = v.groupBy("name").agg(F.min(F.struct("who", "age", "uri")).alias("x"), (F.count("*") - 1).alias("shadowed"))
    return best.select("name", "x.uri", "shadowed")


# Documents as versions of forty names, at times of several spellings: unreadable, missing, no such month, ahead, in three zones.
WHEN_SQL = """CASE doc_id % 9 WHEN 0 THEN 'yesterday' WHEN 1 THEN '2099-01-01T00:00:00Z' WHEN 2 THEN NULL WHEN 3 THEN '2024-13-05T00:00:00Z' WHEN 4 THEN '2024-06-01T00:59:00Z'
ELSE concat('2024-0', doc_id % 5 + 1, '-1', doc_id * 37 % 10, 'T0', doc_id % 8, ':30:00.250', CASE doc_id % 3 WHEN 0 THEN 'Z' WHEN 1 THEN '+05:30' ELSE '-08:00' END) END"""


@query(f"""WITH v AS (SELECT concat('skill', doc_id % 40) AS name, doc_id AS uri, CASE source WHEN 'src0' THEN 0 WHEN 'src1' THEN 1 ELSE 2 END AS rank, {WHEN_SQL} AS updated FROM documents WHERE source NOT IN ('src0', 'src1') OR doc_id % 40 < 20),
t AS (SELECT *, CASE WHEN regexp_full_match(updated, '\\d{{4}}-\\d{{2}}-\\d{{2}}T\\d{{2}}:\\d{{2}}:\\d{{2}}(\\.\\d+)?(Z|[+-]\\d{{2}}:\\d{{2}})') THEN try_cast(updated AS TIMESTAMPTZ) END AS moment FROM v),
w AS (SELECT *, first_value(uri) OVER (PARTITION BY name ORDER BY rank, CASE WHEN moment <= TIMESTAMPTZ '2024-06-01T01:00:00Z' THEN moment END DESC NULLS LAST, uri) AS best FROM t)
SELECT name, uri, nullif(best, uri) AS shadowed_by FROM w""")
def skill_versions(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Which version of each name stands, and by which the others are shadowed; at midnight of 1 June 2024."""
    d = table(spark, sf_dir, "documents").where("source NOT IN ('src0', 'src1') OR doc_id % 40 < 20")
    v = d.select(F.concat(F.lit("skill"), (F.col("doc_id") % 40).cast("string")).alias("name"), F.col("source").alias("author"), F.expr(WHEN_SQL).alias("updated"), F.col("doc_id").alias("uri"))
    return versions.resolve(v, "src0", "src1", F.to_timestamp(F.lit("2024-06-01T00:00:00Z")))


@query("SELECT text AS name, min_by(source, {'s': CAST(substr(source, 4) AS INTEGER), 'i': doc_id}) AS source FROM documents GROUP BY text")
def first_source_wins(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Spaces in settings order: the first that has a name gives it."""
    d = table(spark, sf_dir, "documents").select(F.col("text").alias("name"), F.substring("source", 4, 10).cast("int").alias("s"), "doc_id", "source")
    return d.groupBy("name").agg(F.min(F.struct("s", "doc_id", "source")).alias("x")).select("name", "x.source")


GEN_SQL = """seg AS (SELECT doc_id % 500 AS id, doc_id // 500 AS generation, n_chars FROM documents),
dead AS (SELECT doc_id % 500 AS id, max((doc_id * 7919) % 40) AS generation FROM labels WHERE toxic = 1 GROUP BY 1)"""


@query(f"WITH {GEN_SQL} SELECT s.id, s.generation, s.n_chars FROM seg s LEFT JOIN dead d ON d.id = s.id WHERE d.generation IS NULL OR d.generation <= s.generation")
def generation_visibility(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Rows that tombstones of later generations do not hide; a row added again after its deletion is visible."""
    rows = table(spark, sf_dir, "documents").select((F.col("doc_id") % 500).alias("id"), F.expr("doc_id div 500").alias("generation"), "n_chars")
    gone = table(spark, sf_dir, "labels").where("toxic = 1").select((F.col("doc_id") % 500).alias("id"), ((F.col("doc_id") * 7919) % 40).alias("generation"))
    return feeds.visible(rows, gone, "id", "generation")


# Events as the configuration log of seven spaces. A model is written name@digest/dims; it is null if a part is missing.
CONFIG_SQL = """l AS (SELECT user_id % 7 AS space, event_id AS seq, CASE event_type WHEN 'signup' THEN 'declare' WHEN 'view' THEN 'next' WHEN 'purchase' THEN 'promote' WHEN 'error' THEN 'cancel' ELSE event_type END AS action,
  CASE WHEN k % 13 > 0 THEN CASE WHEN k % 3 = 0 THEN 'nomic-embed-text' ELSE 'm' || (k % 3) END || '@d' || (k % 2) || '/' || (64 + k % 2 * 32) END AS m, row_number() OVER (PARTITION BY user_id % 7 ORDER BY event_id) AS n
  FROM (SELECT *, CAST(json_extract(props, '$.k') AS BIGINT) AS k FROM events)),
f AS (SELECT space, CAST(0 AS BIGINT) AS n, CAST(NULL AS BIGINT) AS seq, '' AS action, CAST(NULL AS VARCHAR) AS refusal, CAST(NULL AS VARCHAR) AS model, CAST(NULL AS VARCHAR) AS "next", '' AS dp, '' AS qp, CAST(NULL AS VARCHAR) AS active, CAST(NULL AS VARCHAR) AS building, false AS resync FROM l GROUP BY space
  UNION ALL
  SELECT space, n, seq, action, refusal, model, "next", dp, qp, active,
    CASE WHEN refusal IS NOT NULL THEN b1 ELSE want END, refusal IS NULL AND (fresh OR (want IS NOT NULL AND want IS DISTINCT FROM b1))
  FROM (SELECT *, CASE WHEN "next" IS DISTINCT FROM model THEN "next" END AS want FROM (
    SELECT space, n, seq, action, refusal, model, "next", CASE WHEN new AND starts_with(model, 'nomic-embed-text') THEN 'search_document: ' WHEN new THEN '' ELSE dp END AS dp, CASE WHEN new AND starts_with(model, 'nomic-embed-text') THEN 'search_query: ' WHEN new THEN '' ELSE qp END AS qp,
      CASE WHEN refusal IS NULL THEN model ELSE a0 END AS active, refusal IS NULL AND a0 IS DISTINCT FROM model AND b0 IS DISTINCT FROM model AS fresh,
      CASE WHEN refusal IS NULL AND a0 IS DISTINCT FROM model AND b0 IS NOT DISTINCT FROM model THEN NULL ELSE b0 END AS b1
    FROM (SELECT space, n, seq, action, refusal, dp, qp, a0, b0, refusal IS NULL AND action IN ('declare', 'promote') AS new,
        CASE WHEN refusal IS NULL AND action = 'declare' THEN m WHEN refusal IS NULL AND action = 'promote' THEN x0 ELSE m0 END AS model,
        CASE WHEN refusal IS NOT NULL THEN x0 WHEN action = 'next' THEN m END AS "next"
      FROM (SELECT l.space, l.n, l.seq, l.action, l.m, f.model AS m0, f."next" AS x0, f.dp, f.qp, f.active AS a0, f.building AS b0,
          CASE l.action WHEN 'declare' THEN CASE WHEN m IS NULL THEN 'incomplete model' END
            WHEN 'next' THEN CASE WHEN f.model IS NULL THEN 'no model' WHEN m IS NULL THEN 'incomplete model' WHEN m = f.model THEN 'same model' END
            WHEN 'promote' THEN CASE WHEN f."next" IS NULL THEN 'no change in progress' END
            WHEN 'cancel' THEN CASE WHEN f.model IS NULL THEN 'no model' END ELSE 'unknown action' END AS refusal
        FROM f JOIN l ON l.space = f.space AND l.n = f.n + 1)))))"""


def _config_states(spark: SparkSession, sf_dir: str) -> DataFrame:
    k = F.get_json_object("props", "$.k").cast("long")
    actions = F.create_map(*(F.lit(x) for pair in (("signup", "declare"), ("view", "next"), ("purchase", "promote"), ("error", "cancel")) for x in pair))
    e = table(spark, sf_dir, "events").withColumn("k", k)
    log = e.select(
        (F.col("user_id") % 7).alias("space"),
        F.col("event_id").alias("seq"),
        F.coalesce(F.element_at(actions, F.col("event_type")), F.col("event_type")).alias("action"),
        F.when(F.col("k") % 13 > 0, F.when(F.col("k") % 3 == 0, "nomic-embed-text").otherwise(F.concat(F.lit("m"), (F.col("k") % 3).cast("string")))).alias("name"),
        F.concat(F.lit("d"), (F.col("k") % 2).cast("string")).alias("digest"),
        (64 + F.col("k") % 2 * 32).alias("dims"),
        F.lit("").alias("document_prefix"),
        F.lit("").alias("query_prefix"),
    )
    return changing.fold(log)


@query(f"""WITH RECURSIVE {CONFIG_SQL} SELECT space, seq, action, refusal, model, "next", dp AS document_prefix, qp AS query_prefix, active, building, resync FROM f WHERE n > 0""")
def config_log(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every entry of the spaces' configuration logs and the state after it: models, slots, and who must sync again."""
    return _config_states(spark, sf_dir)


@query(f"""WITH RECURSIVE {CONFIG_SQL}, cur AS (SELECT space, max_by(active, n) AS active, arg_max_null(building, n) AS building FROM f GROUP BY space),
mem AS (SELECT doc_id % 7 AS space, CASE WHEN doc_id % 3 = 0 THEN ['m1@d1/96', 'nomic-embed-text@d0/64', 'm2@d0/64'] ELSE ['m1@d1/96', 'm2@d0/64', 'm2@d1/96', 'nomic-embed-text@d1/96', 'm1@d0/64'] END AS models FROM documents)
SELECT space, count(*) AS n, count(*) FILTER (WHERE list_contains(models, active)) AS searchable, count(*) FILTER (WHERE list_contains(models, building)) AS built,
  building IS NOT NULL AND count(*) FILTER (WHERE list_contains(models, building)) = count(*) AS ready FROM mem JOIN cur USING (space) GROUP BY space, building""")
def slot_progress(spark: SparkSession, sf_dir: str) -> DataFrame:
    """How far the spaces' slots are filled, and which building slot can be promoted."""
    some, most = (F.array(*map(F.lit, x)) for x in (("m1@d1/96", "nomic-embed-text@d0/64", "m2@d0/64"), ("m1@d1/96", "m2@d0/64", "m2@d1/96", "nomic-embed-text@d1/96", "m1@d0/64")))
    m = table(spark, sf_dir, "documents").select((F.col("doc_id") % 7).alias("space"), F.when(F.col("doc_id") % 3 == 0, some).otherwise(most).alias("models"))
    return changing.slot_progress(_config_states(spark, sf_dir), m, F.col("models"))


@query("""SELECT d.source AS author, count(*) AS n, count(e.embedding) AS done, count(*) - count(e.embedding) AS missing, count(*) = count(e.embedding) AS ready
FROM documents d LEFT JOIN embeddings e ON d.doc_id = e.vec_id GROUP BY 1""")
def model_change(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A change between two models: for each author what has the new model's vector, what lacks it, and who is done."""
    return feeds.model_progress(memories(spark, sf_dir, vectors=True), F.col("embedding").isNotNull(), "author")


RESYNC_SQL = """f AS (SELECT event_id % 20 AS space, event_id // 20 AS rev, user_id AS path, event_type, {'op': CASE WHEN event_id % 7 = 0 THEN 'delete' ELSE 'upsert' END, 'value': CAST(value AS DOUBLE)} AS x FROM events),
got AS (SELECT * FROM f WHERE NOT (event_type = 'error' AND space < 5)),
lost AS (SELECT DISTINCT space FROM (SELECT space, rev, lag(rev) OVER (PARTITION BY space ORDER BY rev) AS before FROM got) WHERE rev > before + 1),
last AS (SELECT space, path, max_by(x, rev) AS x FROM got WHERE space NOT IN (SELECT space FROM lost) GROUP BY ALL),
snap AS (SELECT space, path, max_by(x, rev) AS x FROM f WHERE space IN (SELECT space FROM lost) GROUP BY ALL),
st AS (SELECT c_custkey % 20 AS space, c_custkey AS path, CAST(c_acctbal AS DOUBLE) AS value FROM customer)"""


@query(f"""WITH {RESYNC_SQL} SELECT space, path, value FROM st WHERE space NOT IN (SELECT space FROM lost) AND (space, path) NOT IN (SELECT (space, path) FROM last)
UNION ALL SELECT space, path, x.value FROM last WHERE x.op = 'upsert' UNION ALL SELECT space, path, x.value FROM snap WHERE x.op = 'upsert'""")
def feed_resync(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Spaces after their feeds' changes; those whose feed has lost some take the snapshot of the other side instead."""
    e = table(spark, sf_dir, "events")
    op = F.when(F.col("event_id") % 7 == 0, "delete").otherwise("upsert")
    sent = e.select((F.col("event_id") % 20).alias("space"), F.expr("event_id div 20").alias("rev"), F.col("user_id").alias("path"), op.alias("op"), F.col("value").cast("double").alias("value"), "event_type")
    received = sent.where(~((F.col("event_type") == "error") & (F.col("space") < 5)))
    c = table(spark, sf_dir, "customer")
    stored = c.select((F.col("c_custkey") % 20).alias("space"), F.col("c_custkey").alias("path"), F.col("c_acctbal").cast("double").alias("value"))
    changes, whole = (feeds.latest(x, ["space", "path"], ["rev"], ["op", "value"]) for x in (received, sent))
    return feeds.resync(stored, changes, whole.where("op = 'upsert'"), feeds.gaps(received, "space", "rev"), "space")
