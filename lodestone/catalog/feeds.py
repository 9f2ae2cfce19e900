"""Presence, messages, event logs and observability, as batch queries over the feed's tables."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from lodestone.catalog.registry import query
from lodestone.functions import text as T
from lodestone.operators import lounge, observability, rate_limit, running
from lodestone.sources.tables import MESSAGES_SQL, events, messages, scratch, table

PRES_SQL = """pres AS (SELECT user_id AS did, CASE WHEN x = 'error' THEN 'ended' ELSE x END AS state, CAST(epoch_us(t) // 1000000 AS BIGINT) AS updated_s, CAST(epoch_us(t) // 1000000 AS BIGINT) + 300 AS lease_s
FROM (SELECT user_id, max_by(event_type, {'t': ts, 'i': event_id}) AS x, max(ts) AS t FROM events GROUP BY user_id))"""
NOW_SQL = "now AS (SELECT CAST(epoch_us(max(ts)) // 1000000 AS BIGINT) - 600 AS now FROM events)"


def _now(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Ten minutes before the feed's end: one row."""
    return F.broadcast(events(spark, sf_dir).agg((F.unix_seconds(F.max("ts")) - 600).alias("now")))


@query(f"WITH {PRES_SQL} SELECT did, state, updated_s, lease_s FROM pres")
def presence_latest(spark: SparkSession, sf_dir: str) -> DataFrame:
    return lounge.presence(events(spark, sf_dir))


@query(f"WITH {PRES_SQL}, {NOW_SQL} SELECT did, state, state <> 'ended' AND now < lease_s AS online FROM pres CROSS JOIN now")
def online_agents(spark: SparkSession, sf_dir: str) -> DataFrame:
    return lounge.presence(events(spark, sf_dir)).crossJoin(_now(spark, sf_dir)).select("did", "state", lounge.is_online(F.col("now")).alias("online"))


@query(f"WITH {PRES_SQL}, {NOW_SQL} SELECT count(*) FILTER (WHERE state <> 'ended' AND now < lease_s AND did <> 1) AS online FROM pres CROSS JOIN now")
def online_count(spark: SparkSession, sf_dir: str) -> DataFrame:
    p = lounge.presence(events(spark, sf_dir)).crossJoin(_now(spark, sf_dir))
    return p.agg(F.count_if(lounge.is_online(F.col("now")) & (F.col("did") != 1)).alias("online"))


@query(f"WITH {PRES_SQL}, {NOW_SQL} SELECT did, updated_s FROM pres CROSS JOIN now ORDER BY (state <> 'ended' AND now < lease_s) DESC, updated_s DESC, did LIMIT 50")
def presence_list(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Online ones first, then the latest updates."""
    p = lounge.presence(events(spark, sf_dir)).crossJoin(_now(spark, sf_dir))
    return p.orderBy(F.desc(lounge.is_online(F.col("now"))), F.desc("updated_s"), "did").limit(50).select("did", "updated_s")


@query("""WITH g AS (SELECT *, CASE WHEN lag(ts) OVER w IS NULL OR ts - lag(ts) OVER w >= INTERVAL 300 SECONDS THEN 1 ELSE 0 END AS new FROM events WINDOW w AS (PARTITION BY user_id ORDER BY ts, event_id)),
s AS (SELECT *, sum(new) OVER (PARTITION BY user_id ORDER BY ts, event_id) AS k FROM g)
SELECT user_id, CAST(epoch_us(min(ts)) // 1000000 AS BIGINT) AS start_s, CAST(epoch_us(max(ts) + INTERVAL 300 SECONDS) // 1000000 AS BIGINT) AS end_s, count(*) AS n FROM s GROUP BY user_id, k""")
def sessions(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Online spans: a lease of five minutes, renewed by each record."""
    g = events(spark, sf_dir).groupBy(F.session_window("ts", "300 seconds"), "user_id").agg(F.count("*").alias("n"))
    return g.select("user_id", F.unix_seconds("session_window.start").alias("start_s"), F.unix_seconds("session_window.end").alias("end_s"), "n")


@query(f"WITH {MESSAGES_SQL}, t AS (SELECT max(created_s) AS now FROM msg) SELECT uri, created_s, expires_s FROM msg CROSS JOIN t WHERE expires_s > now AND created_s > now - 259200")
def ttl_messages(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Messages neither expired nor older than 72 hours when the last one came."""
    m = messages(spark, sf_dir)
    now = F.broadcast(m.agg(F.max("created_s").alias("now")))  # one row
    return m.crossJoin(now).where((F.col("expires_s") > F.col("now")) & (F.col("created_s") > F.col("now") - 259200)).select("uri", "created_s", "expires_s")


@query("SELECT user_id, event_type, CAST(value AS DOUBLE) AS value, min(event_id) AS event_id, count(*) AS deliveries FROM events GROUP BY user_id, event_type, value")
def dedup_events(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Records delivered again count once: the first stays."""
    return table(spark, sf_dir, "events").groupBy("user_id", "event_type", F.col("value").cast("double").alias("value")).agg(F.min("event_id").alias("event_id"), F.count("*").alias("deliveries"))


@query("WITH l AS (SELECT event_id AS seq, event_type, user_id FROM events), m AS (SELECT max(seq) AS last FROM l) SELECT seq, event_type, user_id FROM l CROSS JOIN m WHERE seq > 100 AND seq > last - 2000 ORDER BY seq LIMIT 500")
def resume_from_cursor(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The log's next 500 events after cursor 100, as far as the last 2000 that it keeps go back."""
    log = table(spark, sf_dir, "events").select(F.col("event_id").alias("seq"), "event_type", "user_id")
    last = F.broadcast(log.agg(F.max("seq").alias("last")))  # one row
    return log.where("seq > 100").crossJoin(last).where(F.col("seq") > F.col("last") - 2000).orderBy("seq").limit(500).select("seq", "event_type", "user_id")


# The log of each type's events: presence of every third user, messages to one user in eleven or to all.
LOUNGE_SQL = """log AS (SELECT event_type AS space, row_number() OVER (PARTITION BY event_type ORDER BY event_id) AS seq, 'e/' || event_id AS ref, user_id,
  CASE WHEN user_id % 3 = 0 THEN 'presence' ELSE 'message' END AS kind, CASE WHEN user_id % 3 > 0 AND user_id % 4 > 0 THEN ['u' || (user_id % 11)] ELSE CAST([] AS VARCHAR[]) END AS "to" FROM events),
newest AS (SELECT space, max(seq) AS last FROM log GROUP BY space),
pres AS (SELECT space, 'p/' || user_id AS ref FROM log WHERE kind = 'presence' GROUP BY ALL), mess AS (SELECT space, "to", ref FROM log JOIN newest USING (space) WHERE kind = 'message' AND seq > last - 100)"""


def _lounge(spark: SparkSession, sf_dir: str) -> DataFrame:
    e = table(spark, sf_dir, "events").select(F.col("event_type").alias("space"), "event_id", "user_id")
    numbered = running.running(e, ["space"], ["event_id"], running.id_range("event_id"))
    is_message = F.col("user_id") % 3 > 0
    return numbered.select(
        "space",
        F.col("n").cast("long").alias("seq"),
        F.concat(F.lit("e/"), F.col("event_id").cast("string")).alias("ref"),
        "user_id",
        F.when(is_message, "message").otherwise("presence").alias("kind"),
        F.when(is_message & (F.col("user_id") % 4 > 0), F.array(F.concat(F.lit("u"), (F.col("user_id") % 11).cast("string")))).otherwise(F.array().cast("array<string>")).alias("to"),
    )


@query(f"""WITH {LOUNGE_SQL}, c AS (SELECT s_suppkey AS subscriber, ['view', 'click', 'error', 'signup', 'purchase'][1 + s_suppkey % 5] AS space, CASE WHEN s_suppkey % 4 = 0 THEN '' ELSE 'u' || (s_suppkey % 11) END AS me, s_suppkey % 7 AS k FROM supplier),
a AS (SELECT subscriber, space, me, coalesce(last, 0) AS last, CASE k WHEN 1 THEN 'e1-' || (last - 10 - subscriber % 20) WHEN 2 THEN 'e0-' || last WHEN 3 THEN 'e1-0' WHEN 4 THEN 'e1-x' WHEN 5 THEN 'e1-' || (last + 5) WHEN 6 THEN 'e1-' || last ELSE '' END AS cursor,
  CASE k WHEN 1 THEN last - 10 - subscriber % 20 WHEN 3 THEN CASE WHEN last <= 2000 THEN 0 END WHEN 6 THEN last END AS pos FROM c LEFT JOIN newest USING (space)),
b AS (SELECT *, pos IS NULL AND cursor <> '' AS reset FROM a)
SELECT subscriber, 'event' AS kind, seq, ref, reset, 'e1-' || seq AS cursor FROM b JOIN log USING (space) WHERE pos IS NOT NULL AND seq > pos AND seq > last - 2000 AND (me = '' OR len("to") = 0 OR list_contains("to", me))
UNION ALL SELECT subscriber, 'presence', NULL, ref, reset, NULL FROM b JOIN pres USING (space) WHERE pos IS NULL
UNION ALL SELECT subscriber, 'message', NULL, ref, reset, NULL FROM b JOIN mess USING (space) WHERE pos IS NULL AND (me = '' OR len("to") = 0 OR list_contains("to", me))
UNION ALL SELECT subscriber, 'ready', last, NULL, reset, 'e1-' || last FROM b""")
def resume_subscribers(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every supplier as a subscriber that comes back: with the tail of the log after its cursor, or with a snapshot."""
    log = _lounge(spark, sf_dir)
    newest = log.groupBy("space").agg(F.max("seq").alias("last"))
    s = table(spark, sf_dir, "supplier").select(F.col("s_suppkey").alias("subscriber"))
    spaces = F.array(*map(F.lit, ("view", "click", "error", "signup", "purchase")))
    s = s.withColumn("space", F.get(spaces, (F.col("subscriber") % 5).cast("int"))).join(newest, "space", "left")
    me = F.when(F.col("subscriber") % 4 == 0, "").otherwise(F.concat(F.lit("u"), (F.col("subscriber") % 11).cast("string")))
    k, last = F.col("subscriber") % 7, F.col("last")
    at = lambda epoch, n: F.concat(F.lit(f"{epoch}-"), n.cast("string"))
    cursor = F.when(k == 1, at("e1", last - 10 - F.col("subscriber") % 20)).when(k == 2, at("e0", last)).when(k == 3, "e1-0").when(k == 4, "e1-x").when(k == 5, at("e1", last + 5)).when(k == 6, at("e1", last)).otherwise("")
    presence = log.where("kind = 'presence'").select("space", F.concat(F.lit("p/"), F.col("user_id").cast("string")).alias("ref")).distinct()
    recent = log.join(newest, "space").where("kind = 'message' AND seq > last - 100")
    return lounge.resume(log, s.select("subscriber", "space", me.alias("me"), cursor.alias("cursor")), presence, recent, "e1")


@query("SELECT user_id % 7 AS space, CAST(epoch_us(date_trunc('minute', ts)) // 1000000 AS BIGINT) AS minute_s, count(*) AS n FROM events GROUP BY ALL HAVING count(*) > 2")
def rate_limit_violations(spark: SparkSession, sf_dir: str) -> DataFrame:
    e = events(spark, sf_dir).groupBy((F.col("user_id") % 7).alias("space"), F.unix_seconds(F.date_trunc("minute", F.col("ts"))).alias("minute_s")).agg(F.count("*").alias("n"))
    return e.where("n > 2")


def _calls(rows: DataFrame) -> DataFrame:
    """Events as calls of their type's bucket, ten thousand times as fast: ten seconds become a millisecond."""
    return rows.select(F.col("event_type").alias("key"), F.floor(F.unix_micros("ts") / 10_000_000).alias("ms"), F.col("event_id").alias("id"))


# A bucket of 20 tokens that gains 2 a second, in thousandths of a token; the n-th call of each key follows from the one before.
BUCKET_SQL = """WITH RECURSIVE c AS (
  SELECT event_type AS key, CAST(epoch_us(ts) // 10000000 AS BIGINT) AS ms, event_id AS id, row_number() OVER (PARTITION BY event_type ORDER BY epoch_us(ts) // 10000000, event_id) AS n FROM events
), b AS (
  SELECT key, ms, id, n, true AS allowed, CAST(19000 AS BIGINT) AS units FROM c WHERE n = 1
  UNION ALL
  SELECT key, ms, id, n, has >= 1000, CASE WHEN has >= 1000 THEN has - 1000 ELSE has END
  FROM (SELECT c.*, least(20000, b.units + 2 * (c.ms - b.ms)) AS has FROM b JOIN c ON c.key = b.key AND c.n = b.n + 1)
) SELECT key, ms, id, allowed, units / 1000.0::DOUBLE AS "left" FROM b"""


@query(BUCKET_SQL)
def token_bucket(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Which calls a bucket of 20 tokens, two more each second, lets through; refused calls take nothing."""
    return rate_limit.token_bucket(_calls(events(spark, sf_dir)), "key", "ms", "id")


@query(BUCKET_SQL)
def token_bucket_stream(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Streaming: the same buckets, their levels kept as state."""
    from lodestone.streaming import jobs

    rows = jobs.read_events(spark, f"{sf_dir}/events.parquet", "event_id long, ts timestamp_ntz, user_id long, event_type string, value double, props string")
    return jobs.drain(jobs.token_bucket(_calls(rows)), scratch(spark, "bucket"))


@query("WITH r AS (SELECT event_id, event_type, row_number() OVER (PARTITION BY event_type ORDER BY ts DESC, event_id DESC) AS n FROM events) SELECT event_id, event_type FROM r WHERE n <= 200")
def keep_newest_n(spark: SparkSession, sf_dir: str) -> DataFrame:
    return lounge.newest(events(spark, sf_dir), 200, ["event_type"], [F.desc("ts"), F.desc("event_id")]).select("event_id", "event_type")


@query("""WITH e AS (SELECT event_id, user_id, CAST(epoch_us(ts) // 1000000 AS BIGINT) AS s FROM events), r AS (SELECT event_id, user_id, count(*) OVER (PARTITION BY user_id ORDER BY s RANGE BETWEEN 600 PRECEDING AND CURRENT ROW) AS recent FROM e)
SELECT event_id, user_id, recent, recent > 2 AS over FROM r""")
def thread_rate(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Wake-ups of each thread in the ten minutes up to each one, and which exceed the budget."""
    e = events(spark, sf_dir).select("event_id", "user_id", F.unix_seconds("ts").alias("s"))
    return lounge.within_rate(e, "user_id", "s", 2, 600).select("event_id", "user_id", "recent", "over")


@query(f"WITH {MESSAGES_SQL} SELECT uri, lag(uri) OVER w AS parent, CASE WHEN row_number() OVER w > 1 THEN first_value(uri) OVER w END AS root FROM msg WINDOW w AS (PARTITION BY thread ORDER BY turn)")
def thread_roots(spark: SparkSession, sf_dir: str) -> DataFrame:
    return lounge.thread_roots(messages(spark, sf_dir))


@query("SELECT c_custkey AS agent, s_suppkey AS principal FROM customer JOIN supplier ON c_nationkey = s_nationkey AND c_custkey % 10 = s_suppkey % 10")
def confirmed_agents(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Declarations that the other side endorses: both halves must name each other."""
    c = table(spark, sf_dir, "customer").select(F.col("c_custkey").alias("agent"), F.col("c_nationkey").alias("nation"), (F.col("c_custkey") % 10).alias("code"))
    s = table(spark, sf_dir, "supplier").select(F.col("s_suppkey").alias("principal"), F.col("s_nationkey").alias("nation"), (F.col("s_suppkey") % 10).alias("code"))
    return lounge.paired(c, s, ["nation", "code"], "agent", "principal", blocks=4).select("agent", "principal")


@query("""WITH b(le) AS (VALUES (1.0::DOUBLE), (5.0), (10.0), (25.0), (50.0), (100.0), (250.0)), e AS (SELECT event_type, value FROM events WHERE value IS NOT NULL)
SELECT event_type, le, count(*) FILTER (WHERE value <= le) AS n FROM e CROSS JOIN b GROUP BY ALL""")
def latency_histogram(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Cumulative histogram with fixed buckets: one pass, all buckets as columns, then a row for each."""
    edges = [1.0, 5.0, 10.0, 25.0, 50.0, 100.0, 250.0]
    e = table(spark, sf_dir, "events").where("value IS NOT NULL").groupBy("event_type").agg(*(F.count_if(F.col("value") <= x).alias(f"n{i}") for i, x in enumerate(edges)))
    return e.select("event_type", F.explode(F.array(*(F.struct(F.lit(x).alias("le"), F.col(f"n{i}").alias("n")) for i, x in enumerate(edges)))).alias("b")).select("event_type", "b.le", "b.n")


@query("""SELECT event_type, CAST(epoch_us(date_trunc('hour', ts)) // 1000000 AS BIGINT) AS hour_s, count(*) AS n, round(count(*) / 3600.0::DOUBLE, 6) AS rate, round(coalesce(sum(CAST(value AS DOUBLE)), 0), 4) AS total FROM events GROUP BY ALL""")
def event_rates(spark: SparkSession, sf_dir: str) -> DataFrame:
    g = events(spark, sf_dir).groupBy("event_type", F.window("ts", "1 hour").alias("w")).agg(F.count("*").alias("n"), F.round(F.coalesce(F.sum("value"), F.lit(0.0)), 4).alias("total"))
    return g.select("event_type", F.unix_seconds("w.start").alias("hour_s"), "n", F.round(F.col("n") / F.lit(3600.0), 6).alias("rate"), "total")


@query("""WITH c AS (SELECT event_type, CAST(epoch_us(ts) // 1000000 AS BIGINT) AS t, row_number() OVER (PARTITION BY event_type ORDER BY event_id) % 50 AS v FROM events),
o AS (SELECT event_type, t, CAST(-floor(-t / 21600.0::DOUBLE) AS BIGINT) * 21600 AS "end", CAST(max(v) AS DOUBLE) AS v FROM c GROUP BY ALL),
l AS (SELECT *, lag(v) OVER w AS before FROM o WINDOW w AS (PARTITION BY event_type, "end" ORDER BY t)),
g AS (SELECT event_type, "end", count(*) AS n, coalesce(sum(CASE WHEN v < before THEN v ELSE v - before END), 0) AS seen, min(t) AS first, max(t) AS last, min_by(v, t) AS v0 FROM l GROUP BY ALL HAVING count(*) > 1),
s AS (SELECT *, CAST(last - first AS DOUBLE) AS span, CAST(last - first AS DOUBLE) / (n - 1) AS each, CAST(first - ("end" - 21600) AS DOUBLE) AS b0, CAST("end" - last AS DOUBLE) AS a0 FROM g),
e AS (SELECT *, CASE WHEN b0 < each * 1.1::DOUBLE THEN b0 ELSE each / 2 END AS b1, CASE WHEN a0 < each * 1.1::DOUBLE THEN a0 ELSE each / 2 END AS a1, CASE WHEN seen > 0 AND v0 >= 0 THEN span * v0 / seen END AS z FROM s)
SELECT event_type, "end" AS end_s, n, round(seen * (span + CASE WHEN z < b1 THEN z ELSE b1 END + a1) / span, 6) AS increase FROM e""")
def counter_increase(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Growth of each type's counter, which begins again after every 49 events, in windows of six hours."""
    e = table(spark, sf_dir, "events").select("event_type", "event_id", F.unix_seconds(F.col("ts").cast("timestamp")).alias("at"))
    counted = running.running(e, ["event_type"], ["event_id"], running.id_range("event_id")).withColumn("v", F.col("n") % 50)
    grown = observability.increase(counted, ["event_type"], "at", "v", 21600)
    return grown.select("event_type", F.col("end").alias("end_s"), "n", F.round("increase", 6).alias("increase"))


@query("""WITH b(le, i) AS (VALUES (1.0::DOUBLE, 0), (5.0, 1), (10.0, 2), (25.0, 3), (50.0, 4), (100.0, 5), (250.0, 6), ('Infinity'::DOUBLE, 7)),
h AS (SELECT event_type, le, i, CAST(count(*) FILTER (WHERE value <= le) AS DOUBLE) AS n FROM events CROSS JOIN b WHERE value IS NOT NULL GROUP BY ALL),
w AS (SELECT *, max(n) OVER (PARTITION BY event_type) AS total, coalesce(lag(n) OVER o, 0) AS below, coalesce(lag(le) OVER o, 0) AS low FROM h WINDOW o AS (PARTITION BY event_type ORDER BY le)),
q(quantile) AS (VALUES (0.5::DOUBLE), (0.95), (0.99)), r AS (SELECT *, row_number() OVER (PARTITION BY event_type, quantile ORDER BY le) AS rn FROM w CROSS JOIN q WHERE n >= quantile * total)
SELECT event_type, quantile, round(CASE WHEN le = 'Infinity'::DOUBLE THEN 250.0::DOUBLE ELSE low + (le - low) * (quantile * total - below) / (n - below) END, 6) AS value FROM r WHERE rn = 1""")
def latency_quantiles(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Median, 95th and 99th percentile of each type's values out of the buckets of its histogram."""
    edges = [1.0, 5.0, 10.0, 25.0, 50.0, 100.0, 250.0, float("inf")]
    e = table(spark, sf_dir, "events").where("value IS NOT NULL").groupBy("event_type").agg(*(F.count_if(F.col("value") <= x).alias(f"n{i}") for i, x in enumerate(edges)))
    b = e.select("event_type", F.inline(F.array(*(F.struct(F.lit(x).alias("le"), F.col(f"n{i}").alias("n")) for i, x in enumerate(edges)))))
    return observability.histogram_quantile(b, ["event_type"], [0.5, 0.95, 0.99]).select("event_type", "quantile", F.round("value", 6).alias("value"))


@query("SELECT event_id, CAST(json_extract(props, '$.k') AS BIGINT) AS k FROM events")
def json_props(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Fields of a record's JSON; a field of a wrong type is null, not an error."""
    return table(spark, sf_dir, "events").select("event_id", F.from_json("props", "k long").k.alias("k"))


@query("SELECT DISTINCT event_id, user_id FROM events")
def live_new_memories(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Streaming: newest records as they come, each once though polled again."""
    from lodestone.streaming import jobs

    schema = "event_id long, ts timestamp_ntz, user_id long, event_type string, value double, props string"
    stream = jobs.deduplicated(jobs.read_events(spark, f"{sf_dir}/events.parquet", schema), ["event_id"], "3650 days")
    return jobs.drain(stream.select("event_id", "user_id"), scratch(spark, "live"))


@query("""WITH e AS (SELECT user_id AS did, event_id, ts, CASE WHEN event_type = 'error' THEN 'ended' ELSE event_type END AS state, CAST(epoch_us(ts) // 1000000 AS BIGINT) AS s FROM events),
l AS (SELECT *, lag(state) OVER w AS held, lag(s) OVER w + 300 AS lease FROM e WINDOW w AS (PARTITION BY did ORDER BY ts, event_id))
SELECT did, 'offline' AS state, lease AS at_s FROM l WHERE held <> 'ended' AND s >= lease
UNION ALL SELECT did, state, s FROM l WHERE held IS NULL OR held <> state OR (held <> 'ended' AND s >= lease)""")
def presence_stream(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Streaming: presence changes, with leases that run out in event time."""
    from lodestone.streaming import jobs

    schema = "event_id long, ts timestamp_ntz, user_id long, event_type string, value double, props string"
    stream = jobs.read_events(spark, f"{sf_dir}/events.parquet", schema).select("event_id", "ts", "user_id", "event_type")
    return jobs.drain(jobs.presence_changes(stream, "3650 days"), scratch(spark, "presence"))


WRITTEN_SQL = """w AS (SELECT event_id, ts, CASE event_id % 8
  WHEN 0 THEN strftime(ts, '%Y-%m-%dT%H:%M:%SZ') WHEN 1 THEN strftime(ts, '%Y-%m-%dt%H:%M:%Sz') WHEN 2 THEN strftime(ts, '%Y-%m-%d %H:%M:%S')
  WHEN 3 THEN strftime(ts, '%Y-%m-%dT%H:%M:%S') || '+0230' WHEN 4 THEN strftime(ts, '%Y-%m-%dT%H:%M:%S') || '-00:00' WHEN 5 THEN strftime(ts, ' %Y-%m-%d ')
  WHEN 6 THEN strftime(ts, '%Y/%m/%d') ELSE NULL END AS written FROM events)"""


@query(f"""WITH {WRITTEN_SQL} SELECT event_id, written, CAST(epoch(CASE event_id % 8 WHEN 3 THEN date_trunc('second', ts) - INTERVAL 150 MINUTE WHEN 5 THEN date_trunc('day', ts)
  WHEN 6 THEN TIMESTAMP '2024-01-01' WHEN 7 THEN TIMESTAMP '2024-01-01' ELSE date_trunc('second', ts) END) AS BIGINT) AS at_s FROM w""")
def lenient_times(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Times as records write them, some badly; what is no time gets the fallback."""
    e = table(spark, sf_dir, "events").select("event_id", F.col("ts").cast("timestamp").alias("ts"))
    forms = {0: "yyyy-MM-dd'T'HH:mm:ss'Z'", 1: "yyyy-MM-dd't'HH:mm:ss'z'", 2: "yyyy-MM-dd HH:mm:ss", 3: "yyyy-MM-dd'T'HH:mm:ss'+0230'", 4: "yyyy-MM-dd'T'HH:mm:ss'-00:00'", 5: "' 'yyyy-MM-dd' '", 6: "yyyy/MM/dd"}
    written = F.coalesce(*(F.when(F.col("event_id") % 8 == k, F.date_format("ts", f)) for k, f in forms.items()))
    at = T.lenient_time(F.col("written"), F.lit("2024-01-01T00:00:00Z").cast("timestamp"))
    return e.select("event_id", written.alias("written")).withColumn("at_s", F.unix_seconds(at))
