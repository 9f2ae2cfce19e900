"""URL filters: rules on hosts and paths, and exact membership of listed hosts by a Bloom filter cascade.

The cascade is built over the complete universe of keys. Level 1 encodes the listed keys; level 2 those other
keys that level 1 lets through wrongly; level 3 the listed ones that level 2 catches wrongly; and so on until
no key is wrong. A key of the universe is listed if the first level that lacks it has an even number.

Keys are dealt to shards by their hash, each with a cascade of its own that one task builds, so the universe may be of
any size. Filters that fit a checked size together are broadcast, and tasks look rows up where they are. Larger ones
travel to the rows: a shard's filters come first in its partitions, its rows stream past them.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from lodestone.llm.common import cut, mix, whole_groups

BITS_A_KEY, HASHES = 10, 5
#: Bytes that all filters may take together to be broadcast.
MOST_BYTES = 64 << 20
#: Keys of a shard, and rows that one partition looks up in a shard's filters that are not broadcast.
SHARD_KEYS, SHARD_ROWS = 1 << 20, 1 << 20
#: Levels after which keys are taken to be one and the same, listed and not.
MOST_LEVELS = 100


def host_and_path(url: str = "url") -> tuple[Column, Column]:
    """Host and path of a url; both empty where it is null or has no `://`."""
    pattern = r"(?s)^.*?://([^/?#]*)([^?#]*)"
    host = F.translate(F.regexp_extract(url, pattern, 1), "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")
    return F.coalesce(host, F.lit("")), F.coalesce(F.regexp_extract(url, pattern, 2), F.lit(""))


def rule_column(rules: list[tuple[str, str]], host: Column, path: Column) -> Column:
    """The longest fitting rule of [(verdict, `host/path`)] as struct<rule, verdict>, else null."""
    out = F.lit(None).cast("struct<rule:string,verdict:string>")
    for verdict, rule in sorted(rules, key=lambda x: (len(x[1]), x[1])):
        name, _, rest = rule.partition("/")
        fits = ((host == name) | host.endswith(f".{name}")) & path.startswith(f"/{rest}")
        out = F.when(fits, F.struct(F.lit(rule).alias("rule"), F.lit(verdict).alias("verdict"))).otherwise(out)
    return out


@dataclass
class Cascade:
    levels: list[np.ndarray]  # each an array of 64-bit words

    def listed(self, h1: np.ndarray, h2: np.ndarray) -> np.ndarray:
        out = np.zeros(len(h1), bool)
        left = np.arange(len(h1))
        for n, words in enumerate(self.levels):
            hit = _has(words, n, h1[left], h2[left])
            out[left[~hit]] = n % 2 == 1
            left = left[hit]
        out[left] = len(self.levels) % 2 == 1
        return out


def _places(size: int, level: int, h1: np.ndarray, h2: np.ndarray) -> np.ndarray:
    """HASHES bit numbers of each key on a level, by double hashing."""
    a = mix(h1.view(np.uint64) + np.full(1, level, np.uint64) * np.uint64(0x9E3779B97F4A7C15))
    b = mix(h2.view(np.uint64) ^ a) | np.uint64(1)
    return (a[:, None] + np.arange(HASHES, dtype=np.uint64) * b[:, None]) % np.uint64(size * 64)


def _has(words: np.ndarray, level: int, h1: np.ndarray, h2: np.ndarray) -> np.ndarray:
    at = _places(len(words), level, h1, h2)
    return ((words[(at >> np.uint64(6)).astype(np.int64)] >> (at & np.uint64(63))) & np.uint64(1)).all(1)


def _words(keys: int) -> int:
    return max(1, -(-keys * BITS_A_KEY // 64))


def build_cascade(h1: np.ndarray, h2: np.ndarray, listed: np.ndarray) -> Cascade:
    """The cascade of one shard's distinct keys."""
    wrong, others, levels = np.flatnonzero(listed), np.flatnonzero(~listed), []
    while len(wrong):
        if len(levels) == MOST_LEVELS:
            raise ValueError("a key is listed and not listed")
        words = np.zeros(_words(len(wrong)), np.uint64)
        at = _places(len(words), len(levels), h1[wrong], h2[wrong]).ravel()
        np.bitwise_or.at(words, (at >> np.uint64(6)).astype(np.int64), np.uint64(1) << (at & np.uint64(63)))
        passed = others[_has(words, len(levels), h1[others], h2[others])]
        levels.append(words)
        wrong, others = passed, wrong
    return Cascade(levels)


def cascades(universe: DataFrame, shards: int) -> DataFrame:
    """(shard, level, words): the filters of `universe` (h1, h2, listed), whose keys are distinct."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for found in whole_groups(batches, 1 << 20):
            shard, h1, h2 = (found.column(c).to_numpy() for c in range(3))
            listed = found.column(3).to_numpy(zero_copy_only=False)
            cuts = [0, *(np.flatnonzero(np.diff(shard)) + 1).tolist(), len(shard)]
            for a, b in zip(cuts, cuts[1:], strict=False):
                for n, words in enumerate(build_cascade(h1[a:b], h2[a:b], listed[a:b]).levels):
                    yield pa.RecordBatch.from_pydict({"shard": pa.array([int(shard[a])]), "level": pa.array([n], pa.int32()), "words": pa.array([words.tobytes()], pa.binary())})

    keyed = universe.select(_shard(F.col("h1"), shards).alias("shard"), "h1", "h2", "listed")
    return keyed.repartition("shard").sortWithinPartitions("shard").mapInArrow(run, "shard long, level int, words binary")


def _shard(h1: Column, shards: int) -> Column:
    return F.pmod(F.xxhash64(h1), F.lit(shards).cast("long"))


def mark_listed(rows: DataFrame, key: str, universe: DataFrame, most_bytes: int = MOST_BYTES) -> DataFrame:
    """`rows` with a boolean `listed`, looked up for `key`; `universe` (key, listed) holds every key once.

    Keys enter as two independent 64-bit hashes. A null key is not listed. A column named listed is replaced.
    """
    h1, h2 = F.xxhash64(F.lit(1), F.col(key)), F.xxhash64(F.lit(2), F.col(key))
    hashed = cut(universe.where(F.col(key).isNotNull()).select(h1.alias("h1"), h2.alias("h2"), "listed"))
    shards = max(1, -(-hashed.count() // SHARD_KEYS))
    filters = cut(cascades(hashed, shards))
    size = filters.agg(F.coalesce(F.sum(F.octet_length("words")), F.lit(0))).first()[0]
    rows = rows.drop("listed")
    source = rows.select(*rows.columns, h1.alias("__h1"), h2.alias("__h2"), _shard(h1, shards).alias("__shard"))
    out = _with_broadcast(source, filters) if size <= most_bytes else _with_streamed(source, filters)
    return out.withColumn("listed", F.col("listed") & F.col(key).isNotNull())


def _with_broadcast(source: DataFrame, filters: DataFrame) -> DataFrame:
    held: dict[int, list[np.ndarray]] = {}
    for r in filters.orderBy("shard", "level").collect():  # most_bytes at most
        held.setdefault(r.shard, []).append(np.frombuffer(r.words, np.uint64))
    shared = source.sparkSession.sparkContext.broadcast({n: Cascade(levels) for n, levels in held.items()})
    schema = source.drop("__h1", "__h2", "__shard").withColumn("listed", F.lit(True)).schema

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            a, b, shard = (batch.column(batch.num_columns - k).to_numpy() for k in (3, 2, 1))
            listed = np.zeros(batch.num_rows, bool)
            for n in np.unique(shard).tolist():
                own = np.flatnonzero(shard == n)
                if n in shared.value:
                    listed[own] = shared.value[n].listed(a[own], b[own])
            yield pa.RecordBatch.from_arrays([*batch.columns[:-3], pa.array(listed)], schema.names)

    return source.mapInArrow(run, schema)


def _with_streamed(source: DataFrame, filters: DataFrame) -> DataFrame:
    """Rows meet their shard's filters in sorted partitions; a shard of very many rows is cut into parts by the rows' hash."""
    row = F.struct(*[c for c in source.columns if c not in ("__h1", "__h2", "__shard")])
    parts = cut(source.groupBy(F.col("__shard").alias("shard")).agg(F.ceil(F.count("*") / SHARD_ROWS).alias("parts")))
    data = source.select(F.col("__shard").alias("shard"), F.col("__h1").alias("h1"), F.col("__h2").alias("h2"), row.alias("row")).join(parts, "shard")
    data = data.select("shard", F.pmod(F.xxhash64("row"), "parts").alias("part"), F.lit(1).alias("kind"), F.lit(0).alias("level"), F.lit(None).cast("binary").alias("words"), "h1", "h2", "row")
    sent = filters.join(parts, "shard").withColumn("part", F.explode(F.sequence(F.lit(0).cast("long"), F.col("parts") - 1)))
    none = F.lit(None).cast("long")
    sent = sent.select("shard", "part", F.lit(0).alias("kind"), "level", "words", none.alias("h1"), none.alias("h2"), F.lit(None).cast(data.schema["row"].dataType).alias("row"))
    met = data.unionByName(sent).repartition("shard", "part").sortWithinPartitions("shard", "part", "kind", "level")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        at, levels = None, []
        for batch in batches:
            shard, part, kind = (batch.column(c).to_numpy() for c in range(3))
            cuts = [0, *(np.flatnonzero((np.diff(shard) != 0) | (np.diff(part) != 0) | (np.diff(kind) != 0)) + 1).tolist(), len(shard)]
            for a, b in zip(cuts, cuts[1:], strict=False):
                if (shard[a], part[a]) != at:
                    at, levels = (shard[a], part[a]), []
                run_of = batch.slice(a, b - a)
                if kind[a] == 0:
                    levels += [np.frombuffer(x, np.uint64) for x in run_of.column(4).to_pylist()]
                else:
                    listed = Cascade(levels).listed(run_of.column(5).to_numpy(), run_of.column(6).to_numpy())
                    yield pa.RecordBatch.from_arrays([run_of.column(7), pa.array(listed)], ["row", "listed"])

    from pyspark.sql.types import BooleanType, StructField, StructType

    out = met.mapInArrow(run, StructType([StructField("row", data.schema["row"].dataType), StructField("listed", BooleanType())]))
    return out.select("row.*", "listed")


def judge(pages: DataFrame, rules: list[tuple[str, str]], url: str = "url", most_bytes: int = MOST_BYTES) -> DataFrame:
    """`pages` without other columns than page_id, with host, path, rule, listed and verdict.

    The longest fitting rule decides. A page that no rule fits is blocked if its host is listed, else
    allowed. A host is listed if rules block at least half of its pages. A null url, or one without `://`, has
    an empty host and path, which no rule fits and no list holds. Repeated rows stay, each judged; an empty
    table gives an empty table.
    """
    host, path = host_and_path(url)
    parts = pages.select("page_id", host.alias("host"), path.alias("path"))
    ruled = parts.withColumn("__rule", rule_column(rules, F.col("host"), F.col("path")))
    ruled = ruled.select("page_id", "host", "path", F.col("__rule.rule").alias("rule"), F.col("__rule.verdict").alias("__verdict"))
    blocked = F.coalesce(F.avg(F.when(F.col("__verdict") == "block", 1.0).otherwise(0.0)), F.lit(0.0))
    universe = ruled.groupBy("host").agg((blocked >= 0.5).alias("listed"))
    marked = mark_listed(ruled, "host", universe, most_bytes)
    verdict = F.coalesce("__verdict", F.when(F.col("listed"), "block").otherwise("allow"))
    return marked.select("page_id", "host", "path", "rule", "listed", verdict.alias("verdict"))
