"""Hybrid ranking queries."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lodestone.catalog.keyword import BM25_SQL, FILLER, TERMS, index
from lodestone.catalog.registry import query
from lodestone.catalog.vectors import CODE_SQL, DIST_SQL, Q_SQL, SIM_SQL, codes, query_vector
from lodestone.functions.highlight import highlights
from lodestone.operators import filters, keyword
from lodestone.operators import vector_search as S
from lodestone.plans import search
from lodestone.sources.tables import MEMORIES_SQL, memories, table, tombstones

#: Candidates a side.
N = S.CANDIDATES

UNION_SQL = f"""{BM25_SQL}, {Q_SQL}, {CODE_SQL}, alls AS (SELECT c.id, {DIST_SQL} AS dist, {SIM_SQL} AS sim FROM cd c CROSS JOIN q),
ids AS (SELECT id FROM (SELECT id FROM alls ORDER BY dist, id LIMIT {N}) UNION SELECT id FROM (SELECT id FROM bm ORDER BY kw DESC, id LIMIT {N})),
cands AS (SELECT ids.id, dist, sim, coalesce(kw, 0::DOUBLE) AS kw FROM ids LEFT JOIN alls USING (id) LEFT JOIN bm USING (id))"""
FUSE_SQL = """st AS (SELECT min(sim) AS lo, max(sim) AS hi, max(kw) AS top FROM cands),
fused AS (SELECT id, dist, sim, kw, round(0.5::DOUBLE * coalesce(CASE WHEN hi > lo THEN (sim - lo) / (hi - lo) ELSE 0 END, 0) + 0.5::DOUBLE * coalesce(CASE WHEN top > 0 THEN kw / top ELSE 0 END, 0), 6) AS fused FROM cands CROSS JOIN st)"""
RANK_SQL = """ranked AS (SELECT *, CASE WHEN sim > 0 THEN row_number() OVER (PARTITION BY coalesce(sim, 0) > 0 ORDER BY sim DESC, id) END AS vector_rank,
CASE WHEN kw > 0 THEN row_number() OVER (PARTITION BY kw > 0 ORDER BY kw DESC, id) END AS keyword_rank FROM cands)"""


def _candidates(spark: SparkSession, sf_dir: str, keep: DataFrame | None = None) -> DataFrame:
    return search.candidates(codes(spark, sf_dir), index(spark, sf_dir).scores(TERMS), query_vector(spark, sf_dir), N, keep)


@query(f"WITH {UNION_SQL} SELECT id, coalesce(dist, -1) AS dist, sim, kw FROM cands")
def hybrid_candidates(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _candidates(spark, sf_dir).withColumn("dist", F.coalesce("dist", F.lit(-1)))


@query(f"WITH {UNION_SQL}, {FUSE_SQL} SELECT id, sim, kw, fused FROM fused ORDER BY fused DESC, id LIMIT 20")
def hybrid_convex(spark: SparkSession, sf_dir: str) -> DataFrame:
    return search.fuse_convex(_candidates(spark, sf_dir), 20).select("id", "sim", "kw", "fused")


@query(f"WITH {UNION_SQL}, {RANK_SQL}, f AS (SELECT id, round(coalesce(1.0::DOUBLE / (60 + vector_rank), 0) + coalesce(1.0::DOUBLE / (60 + keyword_rank), 0), 6) AS fused FROM ranked) SELECT * FROM f ORDER BY fused DESC, id LIMIT 20")
def hybrid_rrf(spark: SparkSession, sf_dir: str) -> DataFrame:
    return search.fuse_rrf(_candidates(spark, sf_dir), 20).select("id", "fused")


@query(f"WITH {UNION_SQL}, {RANK_SQL} SELECT id, CAST(coalesce(vector_rank, 0) AS INTEGER) AS vector_rank, CAST(coalesce(keyword_rank, 0) AS INTEGER) AS keyword_rank FROM ranked")
def dual_ranks(spark: SparkSession, sf_dir: str) -> DataFrame:
    c = search.ranks(search.ranks(_candidates(spark, sf_dir), "sim", "vector_rank"), "kw", "keyword_rank")
    return c.select("id", F.coalesce("vector_rank", F.lit(0)).alias("vector_rank"), F.coalesce("keyword_rank", F.lit(0)).alias("keyword_rank"))


@query(f"""WITH {BM25_SQL}, {Q_SQL}, {CODE_SQL}, {MEMORIES_SQL}, f AS (SELECT id FROM mem WHERE list_contains(tags, 'en') AND id NOT IN (SELECT doc_id FROM documents WHERE doc_id % 17 = 0)),
alls AS (SELECT c.id, {DIST_SQL} AS dist, {SIM_SQL} AS sim FROM cd c CROSS JOIN q),
ids AS (SELECT id FROM (SELECT id FROM alls WHERE id IN (SELECT id FROM f) ORDER BY dist, id LIMIT {N}) UNION SELECT id FROM (SELECT id FROM bm WHERE id IN (SELECT id FROM f) ORDER BY kw DESC, id LIMIT {N})),
cands AS (SELECT ids.id, dist, sim, coalesce(kw, 0::DOUBLE) AS kw FROM ids LEFT JOIN alls USING (id) LEFT JOIN bm USING (id)), {FUSE_SQL},
page AS (SELECT * FROM fused ORDER BY fused DESC, id LIMIT 10)
SELECT page.id, CAST(floor(least(1.0::DOUBLE, greatest(0.0::DOUBLE, coalesce(sim, 0))) * 1000.0::DOUBLE) AS INTEGER) AS similarity, CAST(round(kw * 100) AS INTEGER) AS keyword, fused, author, text FROM page JOIN mem USING (id)""")
def hybrid_search(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Filters, both rankings, fusion, the page, then the documents of the page."""
    m = memories(spark, sf_dir)
    keep = filters.live(m.where(filters.has_all_tags(["en"])), tombstones(spark, sf_dir)).select("id")
    page = search.fuse_convex(_candidates(spark, sf_dir, keep), 10)
    view = page.select("id", filters.view_similarity(F.coalesce("sim", F.lit(0.0))).alias("similarity"), F.round(F.col("kw") * 100).cast("int").alias("keyword"), "fused")
    return m.select("id", "author", "text").join(F.broadcast(view), "id").select("id", "similarity", "keyword", "fused", "author", "text")  # ten rows


@query(f"""WITH {UNION_SQL}, {FUSE_SQL}, page AS (SELECT id, sim, kw, fused FROM fused ORDER BY fused DESC, id LIMIT 20),
i AS (SELECT id, term, round(ln(1::DOUBLE + (n - df + 0.5::DOUBLE) / (df + 0.5::DOUBLE)), 6) AS idf FROM leaf CROSS JOIN stats WHERE id IN (SELECT id FROM page)),
m AS (SELECT *, row_number() OVER (PARTITION BY id ORDER BY idf DESC, term) AS rn, max(CASE WHEN idf >= 0.4 THEN 1 ELSE 0 END) OVER (PARTITION BY id) AS strong FROM i),
w AS (SELECT id, string_agg(term, ' ' ORDER BY rn) AS terms, min_by(term, rn) AS first FROM m WHERE idf >= 0.4 OR (strong = 0 AND rn = 1) GROUP BY id),
r AS (SELECT *, CASE WHEN sim IS NOT NULL THEN row_number() OVER (PARTITION BY sim IS NOT NULL ORDER BY sim DESC, fused DESC, id) END AS vr, CASE WHEN kw > 0 THEN row_number() OVER (PARTITION BY kw > 0 ORDER BY kw DESC, fused DESC, id) END AS kr FROM page),
x AS (SELECT r.*, text, w.terms, instr(lower(text), w.first) AS pos, greatest(1, instr(lower(text), w.first) - 50) AS start FROM r JOIN documents ON doc_id = r.id LEFT JOIN w ON w.id = r.id)
SELECT id, fused, CAST(vr AS INTEGER) AS vector_rank, CASE WHEN sim IS NOT NULL THEN CAST(floor(least(1.0::DOUBLE, greatest(0.0::DOUBLE, sim)) * 1000.0::DOUBLE) AS INTEGER) END AS similarity,
CAST(kr AS INTEGER) AS keyword_rank, CASE WHEN kw > 0 THEN CAST(round(kw * 100) AS INTEGER) END AS score, CASE WHEN kw > 0 THEN terms END AS terms,
CASE WHEN kw > 0 AND pos > 0 THEN CASE WHEN start > 1 THEN '…' ELSE '' END || trim(substr(text, start, 200)) || CASE WHEN start + 199 < length(text) THEN '…' ELSE '' END END AS snippet FROM x""")
def explain(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A page of hybrid hits with what either side has to say for each."""
    page = search.fuse_convex(_candidates(spark, sf_dir), 20)
    terms = keyword.strongest(index(spark, sf_dir).hits(TERMS), FILLER)
    return search.explain(page, terms, memories(spark, sf_dir))


@query("""WITH l AS (SELECT 's' || (event_id % 3) AS space, CASE event_id % 3 WHEN 0 THEN 'vector' ELSE 'hybrid' END AS mode, 'u' || user_id AS uri, max(value) AS v FROM events WHERE value IS NOT NULL GROUP BY ALL),
p AS (SELECT space, mode, uri, round(v / 100, 6) AS sim, row_number() OVER (PARTITION BY space ORDER BY v DESC, uri) AS pos FROM l),
s AS (SELECT *, round(1.0::DOUBLE / (60 + pos), 6) AS score FROM p), o AS (SELECT *, row_number() OVER (PARTITION BY uri ORDER BY score DESC, sim DESC, space) AS n FROM s),
t AS (SELECT * FROM o WHERE n = 1 ORDER BY score DESC, sim DESC, uri LIMIT 30)
SELECT uri, space, score, CAST(row_number() OVER (ORDER BY score DESC, sim DESC, uri) AS INTEGER) AS rank FROM t""")
def merge_spaces(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Three spaces' lists of users by their best value."""
    from pyspark.sql import Window

    e = table(spark, sf_dir, "events").where("value IS NOT NULL")
    space = F.concat(F.lit("s"), (F.col("event_id") % 3).cast("string"))
    mode = F.when(F.col("event_id") % 3 == 0, "vector").otherwise("hybrid")
    best = e.groupBy(space.alias("space"), mode.alias("mode"), F.concat(F.lit("u"), F.col("user_id").cast("string")).alias("uri")).agg(F.max("value").alias("v"))
    lists = best.select("space", "mode", "uri", F.round(F.col("v") / 100, 6).alias("sim"), F.row_number().over(Window.partitionBy("space").orderBy(F.desc("v"), "uri")).alias("pos"))
    # a place beyond the 30th has 30 better ones in its own list
    return search.merge_spaces(lists.where("pos <= 30"), 30)


@query(rf"""WITH {BM25_SQL}, {MEMORIES_SQL}, top AS (SELECT id, kw FROM bm ORDER BY kw DESC, id LIMIT 20),
page AS (SELECT top.id, kw, text, tags, source FROM top JOIN mem USING (id)),
fld AS (SELECT id, 0 AS f, 0 AS tag, text AS src FROM page UNION ALL SELECT id, 1, CAST(unnest(range(len(tags))) AS INTEGER), unnest(tags) FROM page UNION ALL SELECT id, 2, 0, source FROM page),
cut AS (SELECT id, f, tag, src, regexp_extract_all(src, '[A-Za-z0-9]+|[^A-Za-z0-9]+') AS parts FROM fld WHERE src <> ''),
pieces AS (SELECT id, f, tag, i, parts[i] AS w, octet_length(encode(parts[i])) AS n FROM cut, unnest(range(1, len(parts) + 1)) AS g(i)),
placed AS (SELECT *, CAST(sum(n) OVER (PARTITION BY id, f, tag ORDER BY i) AS INTEGER) AS stop FROM pieces),
spot AS (SELECT id, f, tag, stop - n AS start, stop FROM placed WHERE lower(w) IN ('the', 'licensed', 'ouwhea', 'tion', 'license')),
best AS (SELECT id, f, tag, count(*) AS matches, min(start) AS first FROM spot GROUP BY id, f, tag QUALIFY row_number() OVER (PARTITION BY id ORDER BY count(*) DESC, f, tag) = 1),
chars AS (SELECT id, k, substr(src, k, 1) AS c, CAST(sum(octet_length(encode(substr(src, k, 1)))) OVER (PARTITION BY id ORDER BY k) AS INTEGER) AS stop FROM (SELECT id, src, unnest(range(1, length(src) + 1)) AS k FROM best JOIN fld USING (id, f, tag))),
win AS (SELECT id, max(CASE WHEN stop - octet_length(encode(c)) <= greatest(0, first - 50) THEN stop - octet_length(encode(c)) END) AS lo, max(stop) AS total FROM chars JOIN best USING (id) GROUP BY id),
ends AS (SELECT id, lo, total, coalesce(min(CASE WHEN stop >= lo + 200 THEN stop END), total) AS hi FROM win JOIN chars USING (id) GROUP BY id, lo, total),
said AS (SELECT id, lo, hi, total, string_agg(c, '' ORDER BY k) AS s FROM ends JOIN chars USING (id) WHERE stop > lo AND stop <= hi GROUP BY ALL),
bare AS (SELECT *, CASE WHEN lo > 0 THEN '…' ELSE '' END AS pre, CASE WHEN hi < total THEN '…' ELSE '' END AS post, octet_length(encode(s)) - octet_length(encode(ltrim(s, chr(9) || chr(10) || chr(11) || chr(12) || chr(13) || ' ' || chr(133) || chr(160)))) AS lead FROM said)
SELECT best.id, kw, ['text', 'tag', 'source'][f + 1] AS field, tag, CAST(matches AS INTEGER) AS matches, pre || trim(s, chr(9) || chr(10) || chr(11) || chr(12) || chr(13) || ' ' || chr(133) || chr(160)) || post AS snippet, highlights
FROM best JOIN bare USING (id) JOIN top USING (id) LEFT JOIN (
  SELECT id, string_agg((start + shift) || '-' || (stop + shift), ' ' ORDER BY start) AS highlights
  FROM (SELECT spot.id, spot.start, spot.stop, octet_length(encode(pre)) - lo - lead AS shift FROM spot JOIN best USING (id, f, tag) JOIN bare USING (id) WHERE spot.start >= lo AND spot.stop <= hi) GROUP BY id) USING (id)""")
def highlighted_search(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The page of a keyword search with snippets and the byte ranges of its matches."""
    top = index(spark, sf_dir).search(TERMS, 20)
    page = memories(spark, sf_dir).select("id", "text", "tags", "source").join(F.broadcast(top), "id").withColumn("terms", F.array(*map(F.lit, TERMS)))  # twenty rows
    shown = F.array_join(F.transform("highlights", lambda h: F.concat(h["start"].cast("string"), F.lit("-"), h["end"].cast("string"))), " ")
    return highlights(page).withColumn("highlights", F.when(F.size("highlights") > 0, shown))
