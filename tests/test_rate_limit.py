"""Token buckets: chunks against one plain walk, streams against batches, ties, nulls and empty input."""

import random

import numpy as np
import pytest

from lodestone.operators import rate_limit
from lodestone.streaming import jobs

SCHEMA = "key string, ms long, id long"


def walk(rows, tokens=2, seconds=1, burst=20):
    """In fractions of a token, key by key."""
    out, level, at = [], {}, {}
    for key, ms, id in sorted((r for r in rows if r[0] is not None and r[1] is not None), key=lambda r: (r[0], r[1], r[2])):
        has = min(burst * 1000 * seconds, level.get(key, burst * 1000 * seconds) + (ms - at.get(key, ms)) * tokens)
        ok = has >= 1000 * seconds
        level[key], at[key] = has - 1000 * seconds * ok, ms
        out.append((key, ms, id, ok, level[key] / (1000 * seconds)))
    return sorted(out)


def calls(seed):
    rng = random.Random(seed)
    rows, t = [], {"hot": 10_000, "slow": 0, "bursts": -5_000}
    for i in range(1500):
        key = rng.choice(["hot", "hot", "hot", "slow", "bursts"])
        t[key] += {"hot": rng.randint(0, 300), "slow": rng.randint(0, 5000), "bursts": 0 if rng.random() < 0.95 else 15_000}[key]
        rows.append((key, t[key], i))
    rng.shuffle(rows)
    return [*rows, rows[0], rows[1], (None, 5, 1), ("hot", None, 2), ("once", 7, 3)]


@pytest.mark.parametrize("chunk", [1, 7, 100, 1 << 16])
def test_chunks_equal_one_walk(spark, chunk):
    rows = calls(chunk)
    df = spark.createDataFrame(rows, SCHEMA).repartition(3)
    for args in ({}, {"tokens": 3, "seconds": 10, "burst": 2}):
        got = sorted(tuple(r) for r in rate_limit.token_bucket(df, "key", "ms", "id", chunk=chunk, **args).collect())
        assert got == walk(rows, **args)
    assert 100 < sum(not r[3] for r in walk(rows)) < 1400


def test_no_calls(spark):
    assert rate_limit.token_bucket(spark.createDataFrame([], SCHEMA), "key", "ms", "id").count() == 0


def test_refused_calls_take_nothing(spark):
    rows = [("a", 0, i) for i in range(30)] + [("a", 499, 30), ("a", 500, 31), ("a", 600, 32), ("a", 999, 33), ("a", 1000, 34)]
    got = [r.allowed for r in rate_limit.token_bucket(spark.createDataFrame(rows, SCHEMA), "key", "ms", "id").orderBy("id").collect()]
    assert got == [True] * 20 + [False] * 11 + [True, False, False, True]


def test_tables_follow_every_level():
    rng = np.random.default_rng(1)
    ms = np.cumsum(rng.integers(0, 400, 300))
    table = rate_limit.level_table(ms, 1000, 2, 20_000)
    for begin in (0, 1, 999, 1000, 5555, 20_000):
        level, at = begin, ms[0]
        for t in ms.tolist():
            level, _ = rate_limit.step(level, t - int(at), 1000, 2, 20_000)
            at = t
        assert table[begin] == level


def test_stream_equals_batch_over_several_files(spark, tmp_path):
    rows = sorted(((k, ms + 10_000, i) for k, ms, i in calls(5)[:1500]), key=lambda r: (r[1], r[2]))
    for n in range(0, 1500, 500):
        spark.createDataFrame(rows[n : n + 500], SCHEMA).coalesce(1).write.mode("append").parquet(str(tmp_path / "in"))
    stream = spark.readStream.schema(SCHEMA).option("maxFilesPerTrigger", 1).option("latestFirst", False).parquet(str(tmp_path / "in"))
    got = jobs.drain(jobs.token_bucket(stream), str(tmp_path / "out"))
    assert sorted(tuple(r) for r in got.collect()) == walk(rows)


def test_chunks_stay_whole_when_the_join_becomes_a_broadcast(spark):
    """Over many buckets of time, with the join planned by a sort and changed to a broadcast while it runs."""
    rows = [("hot", i * 120, i) for i in range(6000)]
    confs = {"spark.sql.autoBroadcastJoinThreshold": "-1", "spark.sql.adaptive.autoBroadcastJoinThreshold": "10m", "spark.sql.adaptive.coalescePartitions.enabled": "false"}
    for k, v in confs.items():
        spark.conf.set(k, v)
    try:
        df = spark.createDataFrame(rows, SCHEMA).repartition(3)
        got = sorted(tuple(r) for r in rate_limit.token_bucket(df, "key", "ms", "id", chunk=4000).collect())
    finally:
        for k in confs:
            spark.conf.unset(k)
    assert got == walk(rows)


def test_a_stream_gives_slices(spark, tmp_path, monkeypatch):
    monkeypatch.setattr(jobs, "SLICE", 64)
    rows = sorted(((k, ms + 10_000, i) for k, ms, i in calls(6)[:1500]), key=lambda r: (r[1], r[2]))
    spark.createDataFrame(rows, SCHEMA).coalesce(1).write.parquet(str(tmp_path / "in"))
    got = jobs.drain(jobs.token_bucket(spark.readStream.schema(SCHEMA).parquet(str(tmp_path / "in"))), str(tmp_path / "out"))
    assert sorted(tuple(r) for r in got.collect()) == walk(rows)
