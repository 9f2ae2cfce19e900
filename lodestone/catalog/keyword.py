"""Index statistics and keyword ranking, with the simple analyzer that SQL shares."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lodestone.catalog.registry import query
from lodestone.functions.scores import EXACT_LENGTHS, W_PART_STEM, W_PARTS, length_array, length_code
from lodestone.operators import filters, keyword
from lodestone.sources.index import KeywordIndex
from lodestone.sources.tables import MEMORIES_SQL, memories, placed, spread, tombstones

TERMS = ["the", "licensed", "ouwhea", "tion", "license"]

TOK_SQL = "tok AS (SELECT doc_id AS id, unnest(regexp_extract_all(lower(coalesce(text, '')), '([a-z0-9]+)', 1)) AS term FROM documents)"
POST_SQL = f"{TOK_SQL}, post AS (SELECT term, id, count(*) AS tf FROM tok GROUP BY term, id)"
# The length codes, by their rule, as a recursive table.
CODES_SQL = f"""RECURSIVE codes(code, len) AS (
  SELECT 0, CAST(0 AS BIGINT) UNION ALL
  SELECT code + 1, CASE WHEN code + 1 < {EXACT_LENGTHS} THEN code + 1 ELSE len + greatest(1, len // 29) END FROM codes WHERE code < 255
)"""
LEN_SQL = "raw AS (SELECT doc_id AS id, len(regexp_extract_all(lower(coalesce(text, '')), '([a-z0-9]+)', 1)) AS n FROM documents), dls AS (SELECT id, max(len) AS dl FROM raw JOIN codes ON codes.len <= raw.n GROUP BY id)"
STATS_SQL = "stats AS (SELECT CAST(count(*) AS DOUBLE) AS n, CAST(sum(dl) AS DOUBLE) AS total, CAST(sum(dl) AS DOUBLE) / count(*) AS avg_dl FROM dls)"
IN = "('the', 'licensed', 'ouwhea', 'tion', 'license')"
LEAF_SQL = f"""{CODES_SQL}, {LEN_SQL}, {STATS_SQL}, {POST_SQL},
hit AS (SELECT * FROM post WHERE term IN {IN}),
dfs AS (SELECT term, CAST(count(*) AS DOUBLE) AS df FROM hit GROUP BY term),
leaf AS (SELECT hit.id, hit.term, hit.tf, CAST(dl AS BIGINT) AS dl, df,
  ln(1::DOUBLE + (n - df + 0.5::DOUBLE) / (df + 0.5::DOUBLE)) * (CAST(tf AS DOUBLE) * 2.2::DOUBLE / (CAST(tf AS DOUBLE) + 1.2::DOUBLE * (0.6::DOUBLE + 0.4::DOUBLE * CAST(dl AS DOUBLE) / avg_dl))) AS score
  FROM hit JOIN dfs USING (term) JOIN dls USING (id) CROSS JOIN stats)"""
BM25_SQL = f"{LEAF_SQL}, bm AS (SELECT id, round(sum(score), 6) AS kw FROM leaf GROUP BY id HAVING round(sum(score), 6) > 0)"


def tokens():
    return keyword.simple_tokens(F.col("text"))


def docs(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spread(memories(spark, sf_dir).select("id", "text"))


def index(spark: SparkSession, sf_dir: str) -> KeywordIndex:
    """The stored index of the documents; the session's first search builds it, and any after the table has changed."""
    return KeywordIndex.shared(spark, f"{sf_dir}/documents.parquet", lambda: docs(spark, sf_dir), tokens())


@query(f"WITH {POST_SQL} SELECT term, id, tf FROM post")
def build_postings(spark: SparkSession, sf_dir: str) -> DataFrame:
    return keyword.postings(docs(spark, sf_dir), tokens())


@query(f"WITH {TOK_SQL} SELECT id, count(*) AS tokens, count(DISTINCT term) AS terms, max(c) AS top_tf FROM (SELECT id, term, count(*) OVER (PARTITION BY id, term) AS c FROM tok) GROUP BY id")
def term_freq(spark: SparkSession, sf_dir: str) -> DataFrame:
    # texts are dealt by id, which are fewer bytes than their postings; both groupings find their rows in place
    return keyword.postings(docs(spark, sf_dir).repartition("id"), tokens()).groupBy("id").agg(F.sum("tf").alias("tokens"), F.count("*").alias("terms"), F.max("tf").alias("top_tf"))


@query(f"WITH {POST_SQL} SELECT term, count(*) AS df, CAST(sum(tf) AS BIGINT) AS total_tf FROM post GROUP BY term")
def doc_freq(spark: SparkSession, sf_dir: str) -> DataFrame:
    return keyword.postings(docs(spark, sf_dir), tokens()).groupBy("term").agg(F.count("*").alias("df"), F.sum("tf").alias("total_tf"))


@query(f"WITH {CODES_SQL}, {LEN_SQL}, {STATS_SQL} SELECT CAST(n AS BIGINT) AS n, CAST(total AS BIGINT) AS total, round(avg_dl, 6) AS avg_dl FROM stats")
def corpus_stats(spark: SparkSession, sf_dir: str) -> DataFrame:
    return keyword.corpus_stats(docs(spark, sf_dir), tokens()).select("n", "total", F.round("avg_dl", 6).alias("avg_dl"))


@query(f"WITH {CODES_SQL}, {LEN_SQL} SELECT raw.id, n AS length, CAST(max(code) AS INTEGER) AS code, CAST(max(len) AS BIGINT) AS decoded FROM raw JOIN codes ON codes.len <= raw.n GROUP BY raw.id, n")
def length_codes(spark: SparkSession, sf_dir: str) -> DataFrame:
    n = keyword.lengths(docs(spark, sf_dir), tokens())
    return n.select("id", F.col("dl").alias("length"), length_code(F.col("dl")).alias("code")).withColumn("decoded", F.element_at(length_array(), F.col("code") + 1).cast("long"))


@query("SELECT CASE WHEN doc_id % 10 < 8 THEN doc_id % 4 ELSE -1 END AS segment, count(*) AS n, CAST(min(1704067200 + doc_id * 60) AS BIGINT) AS min_s, CAST(max(1704067200 + doc_id * 60) AS BIGINT) AS max_s FROM documents GROUP BY 1")
def segment_stats(spark: SparkSession, sf_dir: str) -> DataFrame:
    s = F.unix_seconds("created_at")
    return placed(memories(spark, sf_dir)).groupBy(F.coalesce("segment", F.lit(-1)).cast("long").alias("segment")).agg(F.count("*").alias("n"), F.min(s).alias("min_s"), F.max(s).alias("max_s"))


@query(f"WITH {POST_SQL} SELECT term, count(*) AS df, CAST(sum(tf) AS BIGINT) AS total_tf FROM post WHERE term IN {IN} GROUP BY term")
def term_lookup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return index(spark, sf_dir).dictionary(TERMS)


@query(f"WITH {LEAF_SQL} SELECT id, term, tf, dl FROM leaf")
def terms_join_postings(spark: SparkSession, sf_dir: str) -> DataFrame:
    return index(spark, sf_dir).postings(TERMS).select("id", "term", "tf", "dl")


@query(f"""WITH {POST_SQL}, c AS (SELECT *, id // 65536 AS chunk FROM post), n AS (SELECT *, row_number() OVER w - 1 AS pos, id - coalesce(lag(id) OVER w, chunk * 65536 - 1) - 1 AS delta FROM c WINDOW w AS (PARTITION BY term, chunk ORDER BY id))
SELECT term, chunk, id, pos, delta, pos // 128 AS block FROM n""")
def posting_deltas(spark: SparkSession, sf_dir: str) -> DataFrame:
    return keyword.numbered(index(spark, sf_dir).postings()).select("term", "chunk", "id", "pos", "delta", "block")


@query(f"""WITH {CODES_SQL}, {LEN_SQL}, {POST_SQL}, n AS (SELECT post.*, dl, id // 65536 AS chunk, (row_number() OVER (PARTITION BY term, id // 65536 ORDER BY id) - 1) // 128 AS block FROM post JOIN dls USING (id))
SELECT term, chunk, block, max(tf) AS max_tf, CAST(min(dl) AS BIGINT) AS min_dl, max(id) AS last_id, count(*) AS n FROM n GROUP BY term, chunk, block""")
def block_bounds(spark: SparkSession, sf_dir: str) -> DataFrame:
    return keyword.numbered(index(spark, sf_dir).postings()).groupBy("term", "chunk", "block").agg(F.max("tf").alias("max_tf"), F.min("dl").alias("min_dl"), F.max("id").alias("last_id"), F.count("*").alias("n"))


@query(f"""WITH {POST_SQL}, df AS (SELECT term, count(*) AS df FROM post GROUP BY term)
SELECT CASE WHEN df = 1 THEN '1' WHEN df < 10 THEN '2-9' WHEN df < 100 THEN '10-99' WHEN df < 1000 THEN '100-999' ELSE '1000+' END AS bucket,
count(*) AS lists, CAST(sum(df) AS BIGINT) AS postings FROM df GROUP BY 1""")
def df_buckets(spark: SparkSession, sf_dir: str) -> DataFrame:
    df = keyword.document_frequency(keyword.postings(docs(spark, sf_dir), tokens()))
    b = F.when(F.col("df") == 1, "1").when(F.col("df") < 10, "2-9").when(F.col("df") < 100, "10-99").when(F.col("df") < 1000, "100-999").otherwise("1000+")
    return df.groupBy(b.alias("bucket")).agg(F.count("*").alias("lists"), F.sum("df").alias("postings"))


@query(f"""WITH {POST_SQL} SELECT count(*) FILTER (WHERE tf < 1) AS bad_tf, count(*) FILTER (WHERE term = '' OR octet_length(encode(term)) > 100000) AS bad_terms,
count(*) - count(DISTINCT (term, id)) AS repeated, count(*) FILTER (WHERE id NOT IN (SELECT doc_id FROM documents)) AS dangling, count(*) AS postings FROM post""")
def verify_index(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Violations of the index's rules; all but the count should be 0."""
    m = docs(spark, sf_dir).repartition("id")  # texts are dealt by id once, so postings, join and grouping find their rows in place
    p = keyword.postings(m, tokens())
    known = m.select("id", F.lit(True).alias("known"))
    per = p.join(known, "id", "left").groupBy("term", "id").agg(F.count("*").alias("c"), F.min("tf").alias("tf"), F.first("known").alias("known"))
    return per.agg(
        F.count_if(F.col("tf") < 1).alias("bad_tf"),
        F.count_if((F.col("term") == "") | (F.octet_length("term") > 100000)).alias("bad_terms"),
        F.coalesce(F.sum(F.col("c") - 1), F.lit(0)).alias("repeated"),
        F.count_if(F.col("known").isNull()).alias("dangling"),
        F.count("*").alias("postings"),
    )


@query(f"WITH {BM25_SQL} SELECT id, kw FROM bm ORDER BY kw DESC, id LIMIT 20")
def bm25_topk(spark: SparkSession, sf_dir: str) -> DataFrame:
    return keyword.top(keyword.bm25(docs(spark, sf_dir), tokens(), TERMS), "kw", 20)


@query(f"""WITH {BM25_SQL}, {MEMORIES_SQL}, f AS (SELECT id FROM mem WHERE author = 'src0' AND list_contains(tags, 'en') AND id NOT IN (SELECT doc_id FROM documents WHERE doc_id % 17 = 0)),
top AS (SELECT id, kw FROM bm WHERE id IN (SELECT id FROM f) ORDER BY kw DESC, id LIMIT 10) SELECT top.id, kw, author, text FROM top JOIN mem USING (id)""")
def keyword_search(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Statistics over the whole space, filters before the top-k, documents fetched for the winners only."""
    m = memories(spark, sf_dir)
    keep = filters.live(m.where(filters.by_author("src0") & filters.has_all_tags(["en"])), tombstones(spark, sf_dir))
    top = keyword.top(index(spark, sf_dir).scores(TERMS).join(keep.select("id"), "id", "left_semi"), "kw", 10)
    return m.select("id", "author", "text").join(F.broadcast(top), "id").select("id", "kw", "author", "text")  # ten rows


# A query of two groups: a compound with parts, and a plain word with a stem.
LEAVES = [("g0", "exact", 1.0, "", 1.0, "ouwhea"), ("g0", "parts", W_PARTS, "p0", 1.0, "licensed"), ("g0", "parts", W_PARTS, "p0", W_PART_STEM, "license"), ("g0", "parts", W_PARTS, "p1", 1.0, "tion"), ("g1", "exact", 1.0, "", 1.0, "the"), ("g1", "stem", 1.0, "", 1.0, "license")]


@query(f"""WITH {LEAF_SQL}, l(grp, alt, aw, part, w, term) AS (VALUES ('g0', 'exact', 1.0::DOUBLE, '', 1.0::DOUBLE, 'ouwhea'), ('g0', 'parts', 0.3, 'p0', 1.0, 'licensed'), ('g0', 'parts', 0.3, 'p0', 0.5, 'license'),
 ('g0', 'parts', 0.3, 'p1', 1.0, 'tion'), ('g1', 'exact', 1.0, '', 1.0, 'the'), ('g1', 'stem', 1.0, '', 1.0, 'license')),
p AS (SELECT id, grp, alt, aw, part, max(w * score) AS s FROM leaf JOIN l USING (term) GROUP BY ALL),
a AS (SELECT id, grp, alt, aw, sum(s) AS s FROM p GROUP BY ALL), g AS (SELECT id, grp, max(aw * s) AS s FROM a GROUP BY ALL),
t AS (SELECT id, round(sum(s), 6) AS kw FROM g GROUP BY id) SELECT id, kw FROM t WHERE kw > 0 ORDER BY kw DESC, id LIMIT 20""")
def scoring_tree(spark: SparkSession, sf_dir: str) -> DataFrame:
    tree = spark.createDataFrame(LEAVES, "grp string, alt string, alt_weight double, part string, weight double, term string")
    leaves = index(spark, sf_dir).leaf_scores(TERMS).join(F.broadcast(tree), "term")
    return keyword.top(keyword.tree_scores(leaves), "kw", 20)


@query(f"""WITH {CODES_SQL}, {LEN_SQL}, {STATS_SQL}, {POST_SQL}, ask AS (SELECT DISTINCT item_id AS query, unnest(regexp_extract_all(lower(text), '([a-z0-9]+)', 1)) AS term FROM benchmark),
dfs AS (SELECT term, CAST(count(*) AS DOUBLE) AS df FROM post WHERE term IN (SELECT term FROM ask) GROUP BY term),
s AS (SELECT query, post.id, round(sum(ln(1::DOUBLE + (n - df + 0.5::DOUBLE) / (df + 0.5::DOUBLE)) * (CAST(tf AS DOUBLE) * 2.2::DOUBLE / (CAST(tf AS DOUBLE) + 1.2::DOUBLE * (0.6::DOUBLE + 0.4::DOUBLE * CAST(dl AS DOUBLE) / avg_dl)))), 6) AS kw
 FROM ask JOIN post USING (term) JOIN dfs USING (term) JOIN dls ON dls.id = post.id CROSS JOIN stats GROUP BY query, post.id),
r AS (SELECT *, CAST(row_number() OVER (PARTITION BY query ORDER BY kw DESC, id) AS INTEGER) AS rank FROM s WHERE kw > 0) SELECT query, rank, id, kw FROM r WHERE rank <= 10""")
def keyword_batch(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The ten best documents for every benchmark passage: bounds first, then the blocks that can still matter."""
    from lodestone.sources.tables import table

    ask = table(spark, sf_dir, "benchmark").select(F.col("item_id").alias("query"), F.explode(F.array_distinct(tokens())).alias("term"))
    return index(spark, sf_dir).search_batch(ask, 10)


@query(f"WITH {BM25_SQL} SELECT id, kw FROM bm ORDER BY kw DESC, id LIMIT 20")
def indexed_search(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Keyword ranking from a stored index: pruned by its blocks' bounds, equal to scoring all."""
    return index(spark, sf_dir).search(TERMS, 20)


@query(f"""WITH {CODES_SQL}, {LEN_SQL}, {POST_SQL} SELECT term, id // 128 AS "window", count(*) AS n, max(tf) AS max_tf, CAST(min(dl) AS BIGINT) AS min_dl, CAST(sum(tf) AS BIGINT) AS total_tf, min(id) AS first_id, max(id) AS last_id
FROM post JOIN dls USING (id) GROUP BY term, id // 128""")
def stored_blocks(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The stored index's blocks with their bounds, read without their postings' counts and lengths."""
    b = index(spark, sf_dir).blocks()
    return b.select("term", "window", "n", "max_tf", "min_dl", "total_tf", F.element_at("ids", 1).alias("first_id"), F.element_at("ids", -1).alias("last_id"))


@query(f"""WITH {POST_SQL} SELECT count(*) AS postings, count(DISTINCT (term, id // 128)) AS blocks, count(DISTINCT term) AS terms, 0::BIGINT AS bad_blocks, 0::BIGINT AS bad_bounds, 0::BIGINT AS bad_terms, 0::BIGINT AS bad_lengths, 0::BIGINT AS dangling, 0::BIGINT AS bad_stats FROM post""")
def verify_stored_index(spark: SparkSession, sf_dir: str) -> DataFrame:
    return index(spark, sf_dir).verify(docs(spark, sf_dir))


FILLER = ["what", "which", "who", "when", "where", "why", "how", "i", "we", "you", "it", "they", "do", "be", "have", "has", "was"]


@query(f"""WITH {LEAF_SQL}, i AS (SELECT id, term, round(ln(1::DOUBLE + (n - df + 0.5::DOUBLE) / (df + 0.5::DOUBLE)), 6) AS idf FROM leaf CROSS JOIN stats),
r AS (SELECT *, row_number() OVER (PARTITION BY id ORDER BY idf DESC, term) AS rn, max(CASE WHEN idf >= 0.4 THEN 1 ELSE 0 END) OVER (PARTITION BY id) AS any_strong FROM i)
SELECT id, string_agg(term, ' ' ORDER BY rn) AS terms FROM r WHERE idf >= 0.4 OR (any_strong = 0 AND rn = 1) GROUP BY id""")
def matched_terms(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Terms that explain a hit, strongest first: common and filler words only if nothing else matched."""
    return keyword.strongest(index(spark, sf_dir).hits(TERMS), FILLER).select("id", F.array_join("terms", " ").alias("terms"))
