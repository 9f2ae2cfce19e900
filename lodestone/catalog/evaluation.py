"""Offline evaluation queries. Benchmark items are queries, labels are judgments, label clusters categories."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from lodestone.catalog.keyword import CODES_SQL, LEN_SQL, POST_SQL, STATS_SQL, index
from lodestone.catalog.registry import query
from lodestone.functions import vectors as V
from lodestone.functions.scores import d, idf
from lodestone.operators import keyword, metrics
from lodestone.operators import vector_search as S
from lodestone.plans import evaluate, tuning
from lodestone.sources.tables import table

QUERIES = 40

# Two systems rank the judged documents of each query: by length and by a hash-like order.
RUN_SQL = f"""base AS (SELECT l.doc_id % {QUERIES} AS query, l.doc_id AS doc, d.n_chars, quality, toxic FROM labels l JOIN documents d ON d.doc_id = l.doc_id),
grades AS (SELECT query, doc, CAST(quality + quality * (1 - toxic) AS INTEGER) AS grade FROM base WHERE doc % 3 <> 2),
run AS (SELECT 'length' AS system, query, doc, row_number() OVER (PARTITION BY query ORDER BY n_chars DESC, doc) AS rank FROM base
  UNION ALL SELECT 'spread' AS system, query, doc, row_number() OVER (PARTITION BY query ORDER BY (doc * 7919) % 1009, doc) AS rank FROM base)"""
NDCG_SQL = """gr AS (SELECT run.*, coalesce(grade, 0) AS grade FROM run LEFT JOIN grades USING (query, doc)),
dcg AS (SELECT system, query, sum((pow(2, grade) - 1) / log2(CAST(rank AS DOUBLE) + 1)) AS v FROM gr WHERE rank <= 10 GROUP BY ALL),
idl AS (SELECT query, sum((pow(2, grade) - 1) / log2(CAST(r AS DOUBLE) + 1)) AS v FROM (SELECT *, row_number() OVER (PARTITION BY query ORDER BY grade DESC, doc) AS r FROM grades) WHERE r <= 10 GROUP BY query),
nd AS (SELECT s.system, s.query, CASE WHEN idl.v > 0 THEN round(coalesce(dcg.v, 0) / idl.v, 6) END AS ndcg FROM (SELECT DISTINCT system, query FROM run) s LEFT JOIN dcg USING (system, query) LEFT JOIN idl USING (query))"""


def _base(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "n_chars")
    labels = table(spark, sf_dir, "labels")
    return labels.join(docs, "doc_id").select((F.col("doc_id") % QUERIES).alias("query"), F.col("doc_id").alias("doc"), "n_chars", "quality", "toxic")


def _grades(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Two of three labelled documents are judged: quality counts, more if not toxic."""
    grade = (F.col("quality") + F.col("quality") * (1 - F.col("toxic"))).cast("int")
    return _base(spark, sf_dir).where("doc % 3 <> 2").select("query", "doc", grade.alias("grade"))


def _run(spark: SparkSession, sf_dir: str) -> DataFrame:
    b = _base(spark, sf_dir)
    long = b.select(F.lit("length").alias("system"), "query", "doc", F.col("n_chars").cast("long").alias("score"))
    spread = b.select(F.lit("spread").alias("system"), "query", "doc", (-((F.col("doc") * 7919) % 1009)).alias("score"))
    return evaluate.ranked(long.unionByName(spread))


@query(f"WITH {RUN_SQL} SELECT query, doc, grade FROM grades")
def grades(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _grades(spark, sf_dir)


@query(f"""WITH {RUN_SQL}, hits AS (SELECT system, run.query, count(*) FILTER (WHERE grade >= 1 AND rank <= 10) AS h FROM run LEFT JOIN grades USING (query, doc) GROUP BY ALL),
rel AS (SELECT query, count(*) FILTER (WHERE grade >= 1) AS n FROM grades GROUP BY query)
SELECT system, hits.query, CASE WHEN n > 0 THEN round(CAST(h AS DOUBLE) / n, 6) END AS recall FROM hits LEFT JOIN rel USING (query)""")
def recall_at_k(spark: SparkSession, sf_dir: str) -> DataFrame:
    return metrics.recall(_run(spark, sf_dir), _grades(spark, sf_dir), 10)


@query(f"""WITH {RUN_SQL}, f AS (SELECT system, query, min(rank) FILTER (WHERE grade >= 1 AND rank <= 10) AS r FROM run LEFT JOIN grades USING (query, doc) GROUP BY ALL),
rel AS (SELECT query, count(*) FILTER (WHERE grade >= 1) AS n FROM grades GROUP BY query)
SELECT system, f.query, CASE WHEN n > 0 THEN round(coalesce(1.0::DOUBLE / r, 0), 6) END AS mrr FROM f LEFT JOIN rel USING (query)""")
def mrr_at_k(spark: SparkSession, sf_dir: str) -> DataFrame:
    return metrics.mrr(_run(spark, sf_dir), _grades(spark, sf_dir), 10)


@query(f"WITH {RUN_SQL}, {NDCG_SQL} SELECT system, query, ndcg FROM nd")
def ndcg_at_k(spark: SparkSession, sf_dir: str) -> DataFrame:
    return metrics.ndcg(_run(spark, sf_dir), _grades(spark, sf_dir), 10)


@query(f"WITH {RUN_SQL}, {NDCG_SQL}, c AS (SELECT system, query % 5 AS category, avg(ndcg) AS m FROM nd GROUP BY ALL) SELECT system, round(avg(m), 6) AS macro, count(*) AS categories FROM c WHERE m IS NOT NULL GROUP BY system")
def macro_ndcg(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Mean of the categories' means, so that no category's size decides."""
    n = metrics.ndcg(_run(spark, sf_dir), _grades(spark, sf_dir), 10)
    c = n.groupBy("system", (F.col("query") % 5).alias("category")).agg(F.avg("ndcg").alias("m")).where("m IS NOT NULL")
    return c.groupBy("system").agg(F.round(F.avg("m"), 6).alias("macro"), F.count("*").alias("categories"))


@query("""WITH p AS (SELECT quality AS a, 1 - toxic AS b FROM labels), n AS (SELECT CAST(count(*) AS DOUBLE) AS n, CAST(count(*) FILTER (WHERE a = b) AS DOUBLE) AS same FROM p),
m AS (SELECT v, CAST(count(*) FILTER (WHERE side = 'a') AS DOUBLE) AS na, CAST(count(*) FILTER (WHERE side = 'b') AS DOUBLE) AS nb FROM (SELECT a AS v, 'a' AS side FROM p UNION ALL SELECT b, 'b' FROM p) GROUP BY v),
pe AS (SELECT sum(na * nb) AS x FROM m)
SELECT CAST(n AS BIGINT) AS n, round(CASE WHEN x / (n * n) = 1 THEN 1 ELSE (same / n - x / (n * n)) / (1 - x / (n * n)) END, 6) AS kappa, round(same / n * 100, 4) AS agreement FROM n CROSS JOIN pe""")
def cohens_kappa(spark: SparkSession, sf_dir: str) -> DataFrame:
    return metrics.kappa(table(spark, sf_dir, "labels").select(F.col("quality").alias("a"), (1 - F.col("toxic")).alias("b")))


@query()
def bootstrap_diff(spark: SparkSession, sf_dir: str) -> DataFrame:
    n = metrics.ndcg(_run(spark, sf_dir), _grades(spark, sf_dir), 10)
    by = n.groupBy("query").agg(F.max(F.when(F.col("system") == "length", F.col("ndcg"))).alias("a"), F.max(F.when(F.col("system") == "spread", F.col("ndcg"))).alias("b"))
    return metrics.bootstrap(by.select(F.col("query").alias("key"), (F.col("a") - F.col("b")).alias("diff")))


@query(f"WITH {RUN_SQL} SELECT query, doc, min(system) AS system FROM run WHERE rank <= 10 GROUP BY ALL")
def pool(spark: SparkSession, sf_dir: str) -> DataFrame:
    return evaluate.pool(_run(spark, sf_dir), 10)


@query(f"WITH {RUN_SQL}, p AS (SELECT DISTINCT query, doc FROM run WHERE rank <= 10) SELECT query, doc FROM p WHERE NOT EXISTS (SELECT 1 FROM grades g WHERE g.query = p.query AND g.doc = p.doc)")
def unjudged_pool(spark: SparkSession, sf_dir: str) -> DataFrame:
    return evaluate.unjudged(evaluate.pool(_run(spark, sf_dir), 10), _grades(spark, sf_dir)).select("query", "doc")


ID_SQL = "ids AS (SELECT item_id, 'c' || (item_id % 5) AS category, text, substr(sha256('c' || (item_id % 5) || chr(0) || text || chr(0)), 1, 12) AS id FROM benchmark)"


@query(f"WITH {ID_SQL} SELECT item_id, id, CAST('0x' || substr(sha256('split' || chr(0) || id), 1, 2) AS INTEGER) % 10 < 4 AS tuning FROM ids")
def tuning_split(spark: SparkSession, sf_dir: str) -> DataFrame:
    b = table(spark, sf_dir, "benchmark")
    cat = F.concat(F.lit("c"), (F.col("item_id") % 5).cast("string"))
    b = b.select("item_id", evaluate.query_id(cat, F.col("text"), F.lit("")).alias("id"))
    return b.withColumn("tuning", evaluate.is_tuning(F.col("id")))


@query("SELECT 'c' || (item_id % 5) AS category, count(*) AS n FROM benchmark GROUP BY 1")
def query_categories(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "benchmark").groupBy(F.concat(F.lit("c"), (F.col("item_id") % 5).cast("string")).alias("category")).agg(F.count("*").alias("n"))


@query(f"""WITH {RUN_SQL}, t AS (SELECT query, min(doc) AS target FROM grades WHERE grade = 2 GROUP BY query),
f AS (SELECT t.query, bool_or(run.system = 'length') AS one, count(run.doc) > 0 AS any_ FROM t LEFT JOIN run ON run.query = t.query AND run.doc = t.target AND run.rank <= {S.CANDIDATES} GROUP BY t.query)
SELECT count(*) AS n, round(avg(CASE WHEN one THEN 1.0 ELSE 0.0 END), 6) AS one_system, round(avg(CASE WHEN any_ THEN 1.0 ELSE 0.0 END), 6) AS in_union FROM f""")
def candidate_recall(spark: SparkSession, sf_dir: str) -> DataFrame:
    """How often a query's target is among one system's candidates, and among all systems'."""
    target = _grades(spark, sf_dir).where("grade = 2").groupBy("query").agg(F.min("doc").alias("target"))
    run = _run(spark, sf_dir).where(F.col("rank") <= S.CANDIDATES)
    f = target.join(run, (run.query == target.query) & (run.doc == target.target), "left").groupBy(target.query).agg(F.max((F.col("system") == "length").cast("int")).alias("one"), F.count("doc").alias("hits"))
    return f.agg(F.count("*").alias("n"), F.round(F.avg(F.coalesce("one", F.lit(0))), 6).alias("one_system"), F.round(F.avg((F.col("hits") > 0).cast("int")), 6).alias("in_union"))


@query(f"""WITH {RUN_SQL}, top AS (SELECT run.query, b.n_chars AS score, coalesce(grade, 0) AS grade FROM run JOIN base b USING (query, doc) LEFT JOIN grades USING (query, doc) WHERE system = 'spread' AND rank = 1),
tun AS (SELECT score, row_number() OVER (ORDER BY score) - 1 AS i, count(*) OVER () AS n FROM top WHERE query % 5 < 2 AND grade > 0),
th AS (SELECT score AS t FROM tun WHERE i = n // 10)
SELECT CAST(t AS BIGINT) AS threshold, count(*) AS n, round(avg(CASE WHEN score >= t THEN 1.0 ELSE 0.0 END), 6) AS rate FROM top CROSS JOIN th WHERE query % 5 >= 2 AND grade = 0 GROUP BY t""")
def noanswer_fp(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A threshold that nine of ten good first results of tuning queries clear, and how often unanswered queries clear it."""
    first = _run(spark, sf_dir).where("system = 'spread' AND rank = 1").select("query", "doc")
    top = metrics.graded(first, _grades(spark, sf_dir)).join(_base(spark, sf_dir).select("doc", F.col("n_chars").alias("score")), "doc")
    tun = top.where("query % 5 < 2 AND grade > 0")  # one row a query
    held = tun.agg(F.array_sort(F.collect_list("score")).alias("s")).select(F.expr("CASE WHEN size(s) > 0 THEN element_at(s, CAST(floor(size(s) / 10) AS INT) + 1) END").cast("long").alias("threshold"))
    out = top.where("query % 5 >= 2 AND grade = 0").crossJoin(F.broadcast(held)).where("threshold IS NOT NULL")  # one row
    return out.groupBy("threshold").agg(F.count("*").alias("n"), F.round(F.avg((F.col("score") >= F.col("threshold")).cast("int")), 6).alias("rate"))


TERMS = ["the", "tion", "licensed"]
TUNE_SQL = f"""{RUN_SQL}, tokens AS (SELECT doc, query, regexp_extract_all(lower(coalesce(d.text, '')), '([a-z0-9]+)', 1) AS t FROM base JOIN documents d ON d.doc_id = doc),
x AS (SELECT doc, query, CAST(len(t) AS DOUBLE) AS dl, CAST(len(list_filter(t, lambda w: w = 'the')) AS DOUBLE) AS a, CAST(len(list_filter(t, lambda w: w = 'tion')) AS DOUBLE) AS b0, CAST(len(list_filter(t, lambda w: w = 'licensed')) AS DOUBLE) AS c FROM tokens),
s AS (SELECT avg(dl) AS avg FROM x), k(k1) AS (VALUES (0.9::DOUBLE), (1.2::DOUBLE), (1.6::DOUBLE)), bb(b) AS (VALUES (0.4::DOUBLE), (0.75::DOUBLE)), w(stem) AS (VALUES (0.5::DOUBLE), (1.0::DOUBLE)),
sc AS (SELECT k1, b, stem, query, doc, round(a * (k1 + 1) / (a + k1 * (1 - b + b * dl / avg)) + stem * b0 * (k1 + 1) / (b0 + k1 * (1 - b + b * dl / avg)) + c * (k1 + 1) / (c + k1 * (1 - b + b * dl / avg)), 6) AS score FROM x CROSS JOIN s CROSS JOIN k CROSS JOIN bb CROSS JOIN w),
rr AS (SELECT *, row_number() OVER (PARTITION BY k1, b, stem, query ORDER BY score DESC, doc) AS rank FROM sc),
dc AS (SELECT k1, b, stem, rr.query, sum((pow(2, coalesce(grade, 0)) - 1) / log2(CAST(rank AS DOUBLE) + 1)) AS v FROM rr LEFT JOIN grades USING (query, doc) WHERE rank <= 10 GROUP BY ALL),
il AS (SELECT query, sum((pow(2, grade) - 1) / log2(CAST(r AS DOUBLE) + 1)) AS v FROM (SELECT *, row_number() OVER (PARTITION BY query ORDER BY grade DESC, doc) AS r FROM grades) WHERE r <= 10 GROUP BY query),
n AS (SELECT k1, b, stem, dc.query, CASE WHEN il.v > 0 THEN round(dc.v / il.v, 6) END AS nd FROM dc LEFT JOIN il USING (query))"""


@query(f"WITH {TUNE_SQL} SELECT k1, b, stem, round(avg(nd), 6) AS ndcg, count(nd) AS n FROM n GROUP BY k1, b, stem")
def grid_tune(spark: SparkSession, sf_dir: str) -> DataFrame:
    """nDCG of a keyword ranking under every setting of k1, b and stem weight: settings cross documents in one job."""
    texts = table(spark, sf_dir, "documents").select(F.col("doc_id").alias("doc"), keyword.simple_tokens(F.col("text")).alias("t"))

    def count(term):
        return F.size(F.filter("t", lambda w: w == term)).cast("double")

    counts = [count(t).alias(f"n{i}") for i, t in enumerate(TERMS)]
    x = _base(spark, sf_dir).select("query", "doc").join(texts, "doc").select("query", "doc", F.size("t").cast("double").alias("dl"), *counts)
    settings = [(c["k1"], c["b"], c["stem"]) for c in evaluate.grid(stem=(0.5, 1.0), parts=(0.3,), part_stem=(0.5,), alpha=(0.5,))]
    conf = F.broadcast(spark.createDataFrame(settings, "k1 double, b double, stem double"))  # twelve rows
    avg = F.broadcast(x.agg(F.avg("dl").alias("avg")))  # one row
    all_ = x.crossJoin(avg).crossJoin(conf)

    def part(n):
        return F.col(n) * (F.col("k1") + 1) / (F.col(n) + F.col("k1") * (d(1) - F.col("b") + F.col("b") * F.col("dl") / F.col("avg")))

    score = F.round(part("n0") + F.col("stem") * part("n1") + part("n2"), 6)
    system = F.concat_ws("/", "k1", "b", "stem")
    run = evaluate.ranked(all_.select(system.alias("system"), "query", "doc", score.alias("score")))
    nd = metrics.ndcg(run, _grades(spark, sf_dir), 10).groupBy("system").agg(F.round(F.avg("ndcg"), 6).alias("ndcg"), F.count("ndcg").alias("n"))
    parts = F.split("system", "/")
    return nd.select(parts[0].cast("double").alias("k1"), parts[1].cast("double").alias("b"), parts[2].cast("double").alias("stem"), "ndcg", "n")


# Twelve terms of each query, in two groups of a word, its stem, two parts and their stems; every setting of the grid.
GRID_SQL = f"""{CODES_SQL}, {RUN_SQL}, {LEN_SQL}, {STATS_SQL}, {POST_SQL},
ask AS (SELECT query, CAST(row_number() OVER (PARTITION BY query ORDER BY i) - 1 AS INTEGER) AS leaf, term FROM (
  SELECT item_id AS query, term, min(i) AS i FROM (SELECT item_id, unnest(t) AS term, unnest(range(len(t))) AS i FROM (SELECT item_id, regexp_extract_all(lower(coalesce(text, '')), '([a-z0-9]+)', 1) AS t FROM benchmark WHERE item_id < {QUERIES})) GROUP BY ALL) QUALIFY row_number() OVER (PARTITION BY query ORDER BY i) <= 12),
dfs AS (SELECT term, CAST(count(*) AS DOUBLE) AS df FROM post WHERE term IN (SELECT term FROM ask) GROUP BY term),
un AS (SELECT vec_id AS id, list_transform(CAST(embedding AS DOUBLE[]), lambda x: x / sqrt(list_dot_product(CAST(embedding AS DOUBLE[]), CAST(embedding AS DOUBLE[])))) AS v FROM embeddings),
cnd AS (SELECT base.query, base.doc, CAST(dls.dl AS DOUBLE) AS dl, grade, round(list_dot_product(a.v, q.v), 6) AS sim FROM base JOIN dls ON dls.id = base.doc LEFT JOIN grades g ON g.query = base.query AND g.doc = base.doc LEFT JOIN un a ON a.id = base.doc LEFT JOIN un q ON q.id = base.query
  QUALIFY row_number() OVER (PARTITION BY base.query ORDER BY sim DESC NULLS LAST, base.doc) <= 200),
kb AS (SELECT * FROM (VALUES (0.9::DOUBLE), (1.2::DOUBLE), (1.6::DOUBLE)) k(k1) CROSS JOIN (VALUES (0.4::DOUBLE), (0.75::DOUBLE)) x(b)),
lf AS (SELECT cnd.query, doc, k1, b, leaf, ln(1::DOUBLE + (n - df + 0.5::DOUBLE) / (df + 0.5::DOUBLE)) * tf * (k1 + 1) / (tf + k1 * (1 - b + b * dl / avg_dl)) AS s
  FROM cnd JOIN ask USING (query) JOIN post ON post.id = cnd.doc AND post.term = ask.term JOIN dfs ON dfs.term = ask.term CROSS JOIN stats CROSS JOIN kb),
pv AS (SELECT query, doc, k1, b, {", ".join(f"coalesce(max(s) FILTER (WHERE leaf = {i}), 0::DOUBLE) AS s{i}" for i in range(12))} FROM cnd CROSS JOIN kb LEFT JOIN lf USING (query, doc, k1, b) GROUP BY query, doc, k1, b),
w AS (SELECT * FROM (VALUES (0.5::DOUBLE), (0.7::DOUBLE), (0.85::DOUBLE), (1.0::DOUBLE)) a(stem) CROSS JOIN (VALUES (0.3::DOUBLE), (0.4::DOUBLE), (0.6::DOUBLE)) c(parts) CROSS JOIN (VALUES (0.5::DOUBLE), (0.8::DOUBLE)) e(ps)),
kw AS (SELECT pv.query, pv.doc, k1, b, stem, parts, ps, sim, grade, round(greatest(s0, stem * s1, parts * (greatest(s2, ps * s3) + greatest(s4, ps * s5))) + greatest(s6, stem * s7, parts * (greatest(s8, ps * s9) + greatest(s10, ps * s11))), 6) AS kw FROM pv JOIN cnd USING (query, doc) CROSS JOIN w),
nm AS (SELECT *, min(sim) OVER p AS lo, max(sim) OVER p AS hi, max(kw) OVER p AS top, CASE WHEN sim > 0 THEN row_number() OVER (PARTITION BY query, k1, b, stem, parts, ps ORDER BY greatest(coalesce(sim, 0), 0) DESC, doc) END AS vr, CASE WHEN kw > 0 THEN row_number() OVER (PARTITION BY query, k1, b, stem, parts, ps ORDER BY kw DESC, doc) END AS kr FROM kw WINDOW p AS (PARTITION BY query, k1, b, stem, parts, ps)),
fu AS (SELECT nm.*, alpha, round(CASE WHEN alpha IS NULL THEN coalesce(1 / (60 + CAST(vr AS DOUBLE)), 0) + coalesce(1 / (60 + CAST(kr AS DOUBLE)), 0)
  ELSE (1 - alpha) * CASE WHEN hi > lo THEN coalesce((sim - lo) / (hi - lo), 0) ELSE 0 END + alpha * CASE WHEN top > 0 THEN kw / top ELSE 0 END END, 6) AS f FROM nm CROSS JOIN (VALUES (0.4::DOUBLE), (0.5::DOUBLE), (0.6::DOUBLE), (NULL)) al(alpha)),
rk AS (SELECT *, row_number() OVER (PARTITION BY query, k1, b, stem, parts, ps, alpha ORDER BY f DESC, doc) AS r FROM fu),
gi AS (SELECT query, sum((pow(2, grade) - 1) / log2(CAST(r AS DOUBLE) + 1)) AS v FROM (SELECT *, row_number() OVER (PARTITION BY query ORDER BY grade DESC, doc) AS r FROM grades) WHERE r <= 10 GROUP BY query),
qn AS (SELECT rk.query, k1, b, stem, parts, ps, alpha, sum((pow(2, coalesce(grade, 0)) - 1) / log2(CAST(r AS DOUBLE) + 1)) / min(gi.v) AS nd FROM rk JOIN gi ON gi.query = rk.query AND gi.v > 0 WHERE r <= 10 GROUP BY ALL),
cn AS (SELECT query % 5 AS category, k1, b, stem, parts, ps, alpha, avg(nd) AS m, count(*) AS n FROM qn GROUP BY ALL)"""


@query(f"""WITH {GRID_SQL} SELECT stem, parts, ps AS part_stem, k1, b, alpha, round(avg(m), 6) AS ndcg, CAST(sum(n) AS BIGINT) AS n FROM cn GROUP BY ALL""")
def full_grid(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All 576 settings of weights, BM25 and fusion, with the queries' own terms: mean nDCG@10 over categories."""
    at = index(spark, sf_dir)
    texts = table(spark, sf_dir, "benchmark").where(F.col("item_id") < QUERIES).select(F.col("item_id").alias("query"), F.slice(F.array_distinct(keyword.simple_tokens(F.col("text"))), 1, 12).alias("terms"))
    ask = texts.select("query", F.posexplode("terms").alias("leaf", "term"))
    stats = F.broadcast(at._part("stats"))  # one row
    weighed = ask.join(at.dictionary().select("term", "df"), "term", "left").crossJoin(stats).withColumn("idf", F.when(F.col("df") > 0, idf(F.col("n"), F.col("df"))).otherwise(d(0)))
    filled = lambda found, value: F.transform(F.sequence(F.lit(0), F.lit(11)), lambda i: F.coalesce(F.get(F.transform(F.filter(found, lambda e: e["leaf"] == i), lambda e: e[value]), F.lit(0)), d(0)))
    per_query = weighed.groupBy("query").agg(F.collect_list(F.struct("leaf", "idf")).alias("e")).select("query", filled(F.col("e"), "idf").alias("idf"))  # twelve
    base = _base(spark, sf_dir).select("query", "doc")
    # only the queries' terms of the judged documents leave the index
    posted = at.postings(ask).select("term", F.col("id").alias("doc"), "tf")
    counts = posted.join(base, "doc").join(ask, ["query", "term"]).groupBy("query", "doc").agg(F.collect_list(F.struct("leaf", F.col("tf").cast("double").alias("tf"))).alias("e"))
    lengths = at.lengths().withColumnRenamed("id", "doc")
    unit = table(spark, sf_dir, "embeddings").select("vec_id", V.normalized(F.col("embedding")).alias("v"))
    near = base.join(unit.select(F.col("vec_id").alias("doc"), F.col("v").alias("a")), "doc").join(unit.select(F.col("vec_id").alias("query"), F.col("v").alias("q")), "query")
    near = near.select("query", "doc", F.round(V.dot("a", "q"), 6).alias("sim"))
    judged = _grades(spark, sf_dir)
    ideal = metrics.ideal_gains(judged, 10)
    none = F.expr("cast(array() as array<struct<leaf:int,tf:double>>)")
    c = base.join(counts, ["query", "doc"], "left").join(lengths, "doc").join(near, ["query", "doc"], "left").join(judged, ["query", "doc"], "left").join(per_query, "query").join(ideal, "query", "left").crossJoin(stats)
    c = c.select("query", "doc", filled(F.coalesce("e", none), "tf").alias("tf"), "dl", "sim", "grade", "idf", F.col("avg_dl").alias("average"), "ideal")
    grid = evaluate.grid()
    settings = F.broadcast(spark.createDataFrame([(i, *(g[k] for k in evaluate.GRID)) for i, g in enumerate(grid)], "setting int, " + ", ".join(f"{k} double" for k in evaluate.GRID)))  # 576 rows
    found = tuning.macro(tuning.tune(c, grid), F.col("query") % 5).join(settings, "setting")
    return found.select("stem", "parts", "part_stem", "k1", "b", "alpha", F.round("ndcg", 6).alias("ndcg"), "n")


@query(f"""WITH {RUN_SQL}, {NDCG_SQL}, p AS (SELECT a.query, a.ndcg AS a, b.ndcg AS b FROM nd a JOIN nd b ON a.query = b.query AND a.system = 'length' AND b.system = 'spread')
SELECT 'c' || (query % 5) AS category, count(a) AS n, round(avg(a), 6) AS length_ndcg, round(avg(b), 6) AS spread_ndcg, round(avg(a - b), 6) AS difference FROM p GROUP BY 1""")
def eval_report(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Systems side by side for each category, with the mean difference."""
    n = metrics.ndcg(_run(spark, sf_dir), _grades(spark, sf_dir), 10)
    by = n.groupBy("query").agg(F.max(F.when(F.col("system") == "length", F.col("ndcg"))).alias("a"), F.max(F.when(F.col("system") == "spread", F.col("ndcg"))).alias("b"))
    return by.groupBy(F.concat(F.lit("c"), (F.col("query") % 5).cast("string")).alias("category")).agg(F.count("a").alias("n"), F.round(F.avg("a"), 6).alias("length_ndcg"), F.round(F.avg("b"), 6).alias("spread_ndcg"), F.round(F.avg(F.col("a") - F.col("b")), 6).alias("difference"))


@query("""WITH u AS (SELECT 0 AS priority, 'have' AS origin, doc_id % 50 AS id FROM documents UNION ALL SELECT 1, 'known', doc_id % 70 FROM labels UNION ALL SELECT 2, 'logged', item_id FROM benchmark)
SELECT id, min_by(origin, priority) AS origin FROM u GROUP BY id""")
def queries_by_source(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Queries of several sources, each id once, from the first source that has it."""
    u = table(spark, sf_dir, "documents").select(F.lit(0).alias("priority"), F.lit("have").alias("origin"), (F.col("doc_id") % 50).alias("id"))
    u = u.union(table(spark, sf_dir, "labels").select(F.lit(1), F.lit("known"), F.col("doc_id") % 70))
    u = u.union(table(spark, sf_dir, "benchmark").select(F.lit(2), F.lit("logged"), "item_id"))
    return u.groupBy("id").agg(F.min_by("origin", "priority").alias("origin"))
