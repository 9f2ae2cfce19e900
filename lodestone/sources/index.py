"""A stored inverted index: posting blocks by term, bounds beside them, a dictionary, statistics as one row.

A block holds a term's postings within a window of BLOCK_IDS ids, so blocks of different terms cover the same windows.
Its highest count and lowest length bound every score in it. Blocks are Parquet folders by a hash of the term,
sorted by term and window: a query opens a few folders and the files' statistics skip other terms.

A top-k search first reads bounds only. It adds up each window's bounds, scores the windows of the highest sums,
and so knows a score that the k-th hit reaches at least; then only blocks of windows that can still reach it are joined.
The rows are those of scoring everything.
"""

from __future__ import annotations

import hashlib
from collections.abc import Callable, Sequence
from functools import reduce
from typing import Any

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from lodestone.functions.scores import d, decoded_length, idf, tf_factor
from lodestone.operators import keyword
from lodestone.sources.tables import scratch

#: Folders by a hash of the term; one more holds the documents' lengths.
FOLDERS = 64
#: Ids of one window.
BLOCK_IDS = 128
#: Windows that a file of a folder spans.
FILE_WINDOWS = 2048
#: Rows (query, term) of a batch that are broadcast; more are left to Spark.
MOST_ASKED = 65536
#: Rows (query, window) of a batch that are broadcast at once; more go in parts, by stretches of windows.
MOST_WINDOWS = 1 << 20
#: Scores are rounded to six decimals; a bound this much below the threshold can still reach it.
SLACK = 2e-6
SCHEMAS = {
    "blocks": "term string, window long, n long, max_tf long, min_dl long, total_tf long, ids array<long>, tfs array<long>, dls array<long>, folder int",
    "terms": "folder int, term string, df long, total_tf long",
    "stats": "n long, total long, avg_dl double",
}
MADE = "term string, window long, n long, max_tf long, min_dl long, total_tf long, ids array<long>, tfs array<long>, dls array<long>"
#: The indexes that this process has built, by application, kind and table, each with the table's state at that time.
_BUILT: dict[tuple[str, str, str], tuple[str, Any]] = {}


def _folder(term: Column) -> Column:
    return F.pmod(F.xxhash64(term), F.lit(FOLDERS)).cast("int")


def _at(spark: SparkSession, name: str):
    path = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(name)
    return path.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()), path


def _exists(spark: SparkSession, name: str) -> bool:
    fs, path = _at(spark, name)
    return fs.exists(path)


def table_state(spark: SparkSession, name: str) -> str:
    """A digest of a table's files: their names, sizes and times of change. Empty for a table that isn't there."""
    fs, path = _at(spark, name)
    if not fs.exists(path):
        return ""
    seen, folders = [], [path]
    while folders:
        for s in fs.listStatus(folders.pop()):
            if s.isDirectory():
                folders.append(s.getPath())
            else:
                seen.append(f"{s.getPath()} {s.getLen()} {s.getModificationTime()}")
    return hashlib.sha256("\n".join(sorted(seen)).encode()).hexdigest()


def shared(spark: SparkSession, kind: str, table: str, build: Callable[[], Any]) -> Any:
    """The application's index (with a `root`) of the table at this path: built by the first query that asks for it, read
    by later ones, built again once the table's files have changed. The outdated folder goes then.
    """
    key, state = (spark.sparkContext.applicationId, kind, table), table_state(spark, table)
    old_state, old = _BUILT.get(key, ("", None))
    if old is None or old_state != state or not _exists(spark, old.root):  # scratch folders may be cleared
        _BUILT[key] = (state, build())
        if old is not None:
            fs, path = _at(spark, old.root)
            fs.delete(path, True)
    return _BUILT[key][1]


def window_blocks(docs: pa.Table) -> pa.Table:
    """The blocks of one window's documents (window, id, dl, t: tokens), and one without a term for all documents' lengths.

    A posting is a whole number, the word's place in the window's vocabulary times the documents plus the document's
    place, so sorting these orders postings by word and id. A null token is no word.
    """
    docs = docs.sort_by([("id", "ascending"), ("dl", "ascending")]).combine_chunks()
    id_, dl = docs.column("id").to_numpy(), pc.fill_null(docs.column("dl"), 0).to_numpy()
    lists = docs.column("t").combine_chunks()
    words = lists.flatten().dictionary_encode()
    place = np.cumsum(np.r_[0, (np.diff(id_) != 0) | (np.diff(dl) != 0)])  # rows of one id and length count as one document
    of_token = np.repeat(place, pc.fill_null(pc.list_value_length(lists), 0).to_numpy())
    known = words.indices.is_valid().to_numpy(zero_copy_only=False)
    posted, tf = np.unique(words.indices.drop_null().to_numpy().astype(np.int64) * len(id_) + of_token[known], return_counts=True)
    word, row = posted // len(id_), np.searchsorted(place, posted % len(id_))
    first = np.flatnonzero(np.r_[True, np.diff(word) != 0][: len(word)])
    ids, dls = id_[row], dl[row]
    sums = lambda f, values: f.reduceat(values, first) if len(first) else values
    parts = {
        "term": pa.concat_arrays([words.dictionary.take(pa.array(word[first])), pa.nulls(1, words.dictionary.type)]),
        "window": np.full(len(first) + 1, docs.column("window")[0].as_py()),
        "n": np.r_[np.diff(np.r_[first, len(word)]), len(id_)],
        "max_tf": np.r_[sums(np.maximum, tf), 0],
        "min_dl": np.r_[sums(np.minimum, dls), dl.min()],
        "total_tf": np.r_[sums(np.add, tf), dl.sum()],
    }
    ends = pa.array(np.r_[first, len(word), len(word) + len(id_)].astype(np.int32))
    for name, of_words, of_all in (("ids", ids, id_), ("tfs", tf, np.zeros_like(id_)), ("dls", dls, dl)):
        parts[name] = pa.ListArray.from_arrays(ends, pa.array(np.r_[of_words, of_all]))
    return pa.table(parts)


class KeywordIndex:
    def __init__(self, spark: SparkSession, root: str):
        self.spark, self.root = spark, root.rstrip("/")
        self._parts: dict[str, DataFrame] = {}

    def _part(self, name: str) -> DataFrame:
        """A part of the index, whose files are listed once: they don't change."""
        if name not in self._parts:
            self._parts[name] = self.spark.read.schema(SCHEMAS[name]).parquet(f"{self.root}/{name}")
        return self._parts[name]

    @classmethod
    def build(cls, docs: DataFrame, tokens: Column, root: str, block_ids: int = BLOCK_IDS) -> KeywordIndex:
        """Write the index of (id, text) rows; ids are whole numbers, rows without one are left out."""
        out = cls(docs.sparkSession, root)
        window = F.floor(F.col("id") / block_ids).cast("long")
        # texts are dealt by window, which are fewer bytes than their postings; blocks form in place from then on
        dealt = docs.where("id IS NOT NULL").withColumn("window", window).repartition("window").sortWithinPartitions("window")
        held = dealt.select("window", F.col("id").cast("long").alias("id"), tokens.alias("t")).select("window", "id", decoded_length(F.size("t")).alias("dl"), "t")
        made = held.groupBy("window").applyInArrow(window_blocks, MADE)  # block_ids ids a group
        folder = F.when(F.col("term").isNull(), FOLDERS).otherwise(_folder(F.col("term")))
        # a common term spreads over tasks by its windows
        placed = made.withColumn("folder", folder).repartition("folder", F.floor(F.col("window") / FILE_WINDOWS))
        placed.sortWithinPartitions("folder", "term", "window").write.partitionBy("folder").parquet(f"{out.root}/blocks")
        words = out.blocks().groupBy("folder", "term").agg(F.sum("n").alias("df"), F.sum("total_tf").alias("total_tf"))
        words.repartition("folder").sortWithinPartitions("folder", "term").write.parquet(f"{out.root}/terms")
        sums = out._lengths().agg(F.coalesce(F.sum("n"), F.lit(0)).alias("n"), F.coalesce(F.sum("total_tf"), F.lit(0)).alias("total"))
        sums.select("n", "total", F.when(F.col("n") > 0, d(F.col("total")) / d(F.col("n"))).otherwise(d(0)).alias("avg_dl")).write.parquet(f"{out.root}/stats")
        return out

    @classmethod
    def temporary(cls, spark: SparkSession, docs: DataFrame, tokens: Column) -> KeywordIndex:
        """An index in a folder that the cluster shares."""
        return cls.build(docs, tokens, scratch(spark, "index"))

    @classmethod
    def shared(cls, spark: SparkSession, table: str, docs: Callable[[], DataFrame], tokens: Column) -> KeywordIndex:
        """The application's index of the table at this path; see `shared`."""
        return shared(spark, "keyword", table, lambda: cls.temporary(spark, docs(), tokens))

    def blocks(self) -> DataFrame:
        """(folder, term, window, n, max_tf, min_dl, total_tf, ids, tfs, dls)."""
        return self._part("blocks").where(F.col("folder") < FOLDERS)

    def _lengths(self) -> DataFrame:
        """Blocks of all documents, those without a token too: ids and dls, their number and their lengths' sum as total_tf."""
        return self._part("blocks").where(F.col("folder") == FOLDERS)

    def lengths(self) -> DataFrame:
        """(id, dl): each document's length as its code keeps it."""
        return self._lengths().select(F.inline(F.arrays_zip(F.col("ids").alias("id"), F.col("dls").alias("dl"))))

    def _of(self, rows: DataFrame, terms: Sequence[str]) -> DataFrame:
        wanted = keyword.query_terms(terms)
        # one row of constants, which Spark folds without a job
        folders = self.spark.sql("SELECT 0").select(F.array(*(_folder(F.lit(t)) for t in wanted)).cast("array<int>")).first()[0]
        return rows.where(F.col("folder").isin(folders) & F.col("term").isin(wanted))

    def postings(self, terms: Sequence[str] | DataFrame | None = None) -> DataFrame:
        """(term, id, tf, dl) of the terms' lists (names, or rows with a term), or of all."""
        rows = self.blocks()
        if isinstance(terms, DataFrame):
            rows = rows.join(terms.select("term", _folder(F.col("term")).alias("folder")), ["folder", "term"], "left_semi")
        elif terms is not None:
            rows = self._of(rows, terms)
        return rows.select("term", F.inline(F.arrays_zip(F.col("ids").alias("id"), F.col("tfs").alias("tf"), F.col("dls").alias("dl"))))

    def dictionary(self, terms: Sequence[str] | None = None) -> DataFrame:
        """(term, df, total_tf)."""
        return (self._part("terms") if terms is None else self._of(self._part("terms"), terms)).select("term", "df", "total_tf")

    def hits(self, terms: Sequence[str]) -> DataFrame:
        """(term, id, tf, dl, df, n, total, avg_dl) of the terms' lists."""
        df = F.broadcast(self.dictionary(terms).select("term", "df"))  # a row for each query term
        stats = F.broadcast(self._part("stats"))  # one row
        return self.postings(terms).join(df, "term").crossJoin(stats)

    def leaf_scores(self, terms: Sequence[str]) -> DataFrame:
        """(id, term, score) of every document and term that meet."""
        return self.hits(terms).select("id", "term", (idf(F.col("n"), F.col("df")) * tf_factor(F.col("tf"), F.col("dl"), F.col("avg_dl"))).alias("score"))

    def scores(self, terms: Sequence[str]) -> DataFrame:
        """(id, kw) of every document that has one of the terms."""
        return self.leaf_scores(terms).groupBy("id").agg(F.round(F.sum("score"), 6).alias("kw")).where("kw > 0")

    def search(self, terms: Sequence[str], limit: int, keep: DataFrame | None = None) -> DataFrame:
        """(id, kw): the best `limit` documents, of those in `keep` (ids) if it is given."""
        asked = self.spark.createDataFrame([(0, t) for t in keyword.query_terms(terms)], "query int, term string")
        best = PrunedSearch(self, asked, limit, keep, self._of(self.blocks(), terms) if terms else None).top()
        return best.select("id", "kw").orderBy(F.desc("kw"), "id")

    def search_batch(self, queries: DataFrame, k: int, keep: DataFrame | None = None) -> DataFrame:
        """(query, rank, id, kw): the best k documents for each query of (query, term) rows."""
        return PrunedSearch(self, queries, k, keep).top()

    def verify(self, docs: DataFrame) -> DataFrame:
        """One row that counts what breaks the stored index's rules, and what it holds.

        Blocks: ids ascend and lie in the block's window, counts are 1 or more, bounds are those of the postings.
        The dictionary has the sums of its lists. Each document's counts add up to its coded length. Every id is one of
        `docs` (id, text), and the statistics count them all.
        """
        b = self.blocks()
        lo, hi = F.floor(F.element_at("ids", 1) / BLOCK_IDS), F.floor(F.element_at("ids", -1) / BLOCK_IDS)
        ordered = (F.array_sort(F.array_distinct("ids")) == F.col("ids")) & (lo == F.col("window")) & (hi == F.col("window"))
        sized = (F.size("ids") == F.col("n")) & (F.size("tfs") == F.col("n")) & (F.size("dls") == F.col("n")) & (F.array_min("tfs") >= 1)
        bounded = (F.array_max("tfs") == F.col("max_tf")) & (F.array_min("dls") == F.col("min_dl")) & (F.aggregate("tfs", F.lit(0).cast("long"), lambda a, x: a + x) == F.col("total_tf"))
        bad = lambda c: F.count_if(~F.coalesce(c, F.lit(False)))
        of_blocks = b.agg(F.count("*").alias("blocks"), F.coalesce(F.sum("n"), F.lit(0)).alias("postings"), bad(ordered & sized).alias("bad_blocks"), bad(bounded).alias("bad_bounds"))
        lists = b.groupBy("term").agg(F.sum("n").alias("df2"), F.sum("total_tf").alias("tf2"))
        words = self.dictionary().join(lists, "term", "full")
        of_terms = words.agg(F.count("*").alias("terms"), bad((F.col("df") == F.col("df2")) & (F.col("total_tf") == F.col("tf2"))).alias("bad_terms"))
        per = self.postings().groupBy("id").agg(F.sum("tf").alias("tokens"), F.min("dl").alias("least"), F.max("dl").alias("most"))
        known = docs.select("id", F.lit(1).alias("known")).distinct()
        coded = decoded_length(F.col("tokens"))
        of_docs = per.join(known, "id", "left").agg(bad((coded == F.col("least")) & (coded == F.col("most"))).alias("bad_lengths"), F.count_if(F.col("known").isNull()).alias("dangling"))
        counted = docs.where("id IS NOT NULL").agg(F.count("*").alias("docs"))
        stats = self._part("stats").crossJoin(counted).select((F.col("n") != F.col("docs")).cast("long").alias("bad_stats"))
        return of_blocks.crossJoin(of_terms).crossJoin(of_docs).crossJoin(stats)  # one row each


class PrunedSearch:
    """Top-k by bounds first, for queries of (query, term) rows. `blocks` may already be narrowed to the terms of one query.

    Work grows with the bounds, one for each query, term and window that meet, and with the postings of the windows that
    stay; never with the documents that a common term has. A batch holds its bounds and windows in files, and a part of the
    windows is broadcast to the blocks: no block is shuffled, though many queries ask for its term.
    """

    def __init__(self, index: KeywordIndex, queries: DataFrame, k: int, keep: DataFrame | None = None, blocks: DataFrame | None = None):
        self.k, self.keep, self.blocks, self.batch = k, keep, index.blocks() if blocks is None else blocks, blocks is None
        self._bounds: DataFrame | None = None
        asked = queries.select("query", "term").where("term IS NOT NULL").distinct().withColumn("folder", _folder(F.col("term")))
        few = blocks is not None or asked.limit(MOST_ASKED + 1).count() <= MOST_ASKED
        sent = F.broadcast if few else lambda rows: rows  # MOST_ASKED rows at most, so no block of another term is shuffled
        stats = F.broadcast(index._part("stats"))  # one row
        weights = index._part("terms").select("folder", "term", "df").join(sent(asked), ["folder", "term"]).crossJoin(stats)
        self.weights = sent(weights.select("query", "folder", "term", idf(F.col("n"), F.col("df")).alias("w"), "avg_dl").where("w > 0"))

    def bounds(self) -> DataFrame:
        """(query, window, bound): what a document of the window can score at most. Reads no postings."""
        met = self.blocks.select("folder", "term", "window", "max_tf", "min_dl").join(self.weights, ["folder", "term"])
        most = F.col("w") * tf_factor(F.col("max_tf"), F.col("min_dl"), F.col("avg_dl"))
        return met.groupBy("query", "window").agg(F.sum(most).alias("bound"))

    def _held(self, rows: DataFrame, name: str) -> DataFrame:
        """A batch's `rows` in files, made once."""
        folder = scratch(rows.sparkSession, name)
        rows.write.parquet(folder)
        return rows.sparkSession.read.schema(rows.schema).parquet(folder)

    def _bounds_once(self) -> DataFrame:
        if self._bounds is None:
            self._bounds = self._held(self.bounds(), "bounds") if self.batch else self.bounds()
        return self._bounds

    def first(self) -> DataFrame:
        """The k windows of highest bounds for each query."""
        rank = F.row_number().over(Window.partitionBy("query").orderBy(F.desc("bound"), "window"))
        return self._bounds_once().withColumn("r", rank).where(F.col("r") <= self.k).select("query", "window")

    def parts(self, windows: DataFrame) -> list[tuple[DataFrame, DataFrame]]:
        """`blocks` and `windows` in parts that together hold all pairs: stretches of windows, of MOST_WINDOWS rows at most.

        These are broadcast; a single stretch of more rows is left to Spark. One query's windows are, too: it asks for each block once.
        """
        if not self.batch:
            return [(self.blocks, windows)]
        held, stretch = self._held(windows, "windows"), F.floor(F.col("window") / FILE_WINDOWS)
        spans: list[tuple[int, int, int]] = []  # first and last stretch, rows
        for s, n in held.groupBy(stretch.alias("s")).count().orderBy("s").collect():  # a row for each FILE_WINDOWS windows
            if spans and spans[-1][2] + n <= MOST_WINDOWS:
                spans[-1] = (spans[-1][0], s, spans[-1][2] + n)
            else:
                spans.append((s, s, n))
        if len(spans) < 2:
            return [(self.blocks, F.broadcast(held) if not spans or spans[0][2] <= MOST_WINDOWS else held)]
        within = lambda rows, lo, hi: rows.where((F.col("window") >= lo * FILE_WINDOWS) & (F.col("window") < (hi + 1) * FILE_WINDOWS))
        return [(within(self.blocks, lo, hi), F.broadcast(w) if n <= MOST_WINDOWS else w) for lo, hi, n in spans for w in [within(held, lo, hi)]]

    def scored(self, windows: DataFrame) -> DataFrame:
        """(query, rank, id, kw): the best k of the documents in these windows (query, window)."""

        def sums(blocks: DataFrame, windows: DataFrame) -> DataFrame:
            met = blocks.select("folder", "term", "window", "ids", "tfs", "dls").join(self.weights, ["folder", "term"]).join(windows, ["query", "window"])
            each = met.select("query", "w", "avg_dl", F.inline(F.arrays_zip(F.col("ids").alias("id"), F.col("tfs").alias("tf"), F.col("dls").alias("dl"))))
            if self.keep is not None:
                each = each.join(self.keep.select("id"), "id", "left_semi")
            s = F.col("w") * tf_factor(F.col("tf"), F.col("dl"), F.col("avg_dl"))
            return each.groupBy("query", "id").agg(F.round(F.sum(s), 6).alias("kw")).where("kw > 0")

        found = reduce(DataFrame.unionByName, (sums(*p) for p in self.parts(windows)))  # an id lies in one window, so in one part
        rank = F.row_number().over(Window.partitionBy("query").orderBy(F.desc("kw"), "id"))
        return found.withColumn("rank", rank).where(F.col("rank") <= self.k).select("query", "rank", "id", "kw")

    def windows(self) -> DataFrame:
        """(query, window) of the windows that can hold one of the best k."""
        reached = self.scored(self.first()).where(F.col("rank") == self.k).select("query", F.col("kw").alias("least"))
        b = self._bounds_once().join(reached, "query", "left")
        return b.where(F.col("least").isNull() | (F.col("bound") + SLACK >= F.col("least"))).select("query", "window")

    def top(self) -> DataFrame:
        return self.scored(self.windows())

    def postings_read(self) -> DataFrame:
        """(query, postings, read): postings of the query's terms, and those in windows that stay."""
        met = self.blocks.select("folder", "term", "window", "n").join(self.weights, ["folder", "term"])
        stay = self.windows().withColumn("stays", F.lit(True))
        per = met.join(stay, ["query", "window"], "left").groupBy("query")
        return per.agg(F.sum("n").alias("postings"), F.coalesce(F.sum(F.when(F.col("stays"), F.col("n"))), F.lit(0)).alias("read"))
