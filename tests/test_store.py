"""The versioned store: finished manifests, appends that read nothing, partial merges, verified copies."""

import os

import pytest
from pyspark.sql import functions as F

from lodestone.sources import store as st


def rows(spark, *pairs):
    return spark.createDataFrame(list(pairs), "id long, v string")


def live(s):
    return sorted((r.id, r.v) for r in s.read().collect())


@pytest.fixture
def store(spark, tmp_path):
    return st.Store(spark, f"file://{tmp_path}/store")


def names(s):
    return [x["name"] for x in s.latest()["segments"]]


def test_an_unfinished_manifest_stops_nobody(spark, store, tmp_path):
    store.append(rows(spark, (1, "a")), token=1)
    for rest in (b"", b'{"token": 1, "gen'):
        path = tmp_path / "store" / "manifests" / f"{store.latest()['generation'] + 1:020d}.json"
        path.write_bytes(rest)
        assert live(store)[0] == (1, "a")
        store.append(rows(spark, (len(rest) + 2, "b")), token=1)
        assert (len(rest) + 2, "b") in live(store)
    assert not [n for n in os.listdir(tmp_path / "store" / "manifests") if n.endswith(".part")]


def test_of_two_writers_one_fails_and_nothing_is_lost(spark, store):
    store.append(rows(spark, (1, "a")), token=1)
    base = store.base(1)
    store.append(rows(spark, (2, "b")), token=1)
    with pytest.raises(st.StaleBase):
        store.commit(1, base, base["segments"], [])
    assert live(store) == [(1, "a"), (2, "b")]


def test_the_last_row_of_an_id_wins(spark, store):
    batch = spark.createDataFrame([(1, "old", 1), (1, "new", 2), (2, "x", None), (2, "y", 0), (3, "same", 5), (3, "same", 5)], "id long, v string, rev int")
    store.append(batch, token=1, order=["rev"])
    assert live(store) == [(1, "new"), (2, "y"), (3, "same")]
    store.append(batch.where("v = 'old'"), token=1, order=["rev"])
    assert live(store) == [(1, "old"), (2, "y"), (3, "same")]
    with pytest.raises(Exception, match="lacks its id"):
        store.append(rows(spark, (None, "z")), token=1)


def test_appending_reads_its_batch_only(spark, store, tmp_path):
    store.append(rows(spark, (1, "a"), (2, "b")), token=1)
    folder = tmp_path / "store" / "segments" / names(store)[0]
    folder.rename(tmp_path / "aside")
    store.append(rows(spark, (1, "again"), (3, "c")), token=1)
    (tmp_path / "aside").rename(folder)
    assert live(store) == [(1, "again"), (2, "b"), (3, "c")]


def test_rows_of_equal_content_change_nothing(spark, store):
    store.append(rows(spark, (1, "a"), (2, None)), token=1)
    before = store.latest()
    assert store.append(rows(spark, (1, "a"), (2, None)), token=1, same="v")["generation"] == before["generation"]
    store.append(rows(spark, (1, "a"), (2, "new"), (3, None)), token=1, same="v")
    assert store.latest()["segments"][-1]["fingerprint"]["n"] == 2
    assert sorted((r.id, str(r.v)) for r in store.read().collect()) == [(1, "a"), (2, "new"), (3, "None")]


def test_a_merge_touches_what_it_picks(spark, store):
    for n in range(6):
        store.append(rows(spark, *((n * 10 + i, f"{n}") for i in range(10))), token=1)
    store.append(rows(spark, (5, "late"), (15, "late")), token=1)
    store.delete(rows(spark, (25, ""), (55, "")), token=1)
    want, before = live(store), store.latest()
    aged = {**before, "segments": [{**s, "at": s["at"] - (1000 if i < 3 else 0)} for i, s in enumerate(before["segments"])]}
    store.commit(1, before, aged["segments"], aged["deleted"])
    store.merge(1, most=5, min_age_s=500)
    after = store.latest()
    kept = [s["name"] for s in before["segments"][3:]]
    assert names(store)[:4] == kept and len(after["segments"]) == 5
    assert live(store) == want
    # the merged segment has no dead rows, and one tombstone is left: that of a row in a segment that stayed
    assert after["segments"][-1]["fingerprint"]["n"] == 27
    gone = spark.read.parquet(*(f"{store.root}/deleted/{d}" for d in after["deleted"]))
    assert [r.id for r in gone.collect()] == [55]
    # a row that is deleted and comes again is visible, before and after the next merge
    store.append(rows(spark, (25, "back"), (55, "back")), token=1)
    want = live(store)
    store.compact(1)
    assert live(store) == want and store.latest()["deleted"] == [] and len(names(store)) == 1


def test_merges_by_dead_rows_and_none(spark, store):
    store.append(rows(spark, *((i, "a") for i in range(10))), token=1)
    store.append(rows(spark, *((i, "b") for i in range(100, 110))), token=1)
    assert store.merge(1) == store.latest() and len(names(store)) == 2
    store.delete(rows(spark, *((i, "") for i in range(8))), token=1)
    store.merge(1)
    assert len(names(store)) == 1 and len(live(store)) == 12
    store.delete(store.read().select("id"), token=1)
    store.merge(1)
    assert names(store) == [] and store.read() is None
    store.append(rows(spark, (1, "z")), token=1)
    assert live(store) == [(1, "z")]


def test_a_racing_append_fails_a_merge_cleanly(spark, store, monkeypatch):
    store.append(rows(spark, (1, "a")), token=1)
    store.append(rows(spark, (2, "b")), token=1)
    write = store._write

    def slow(*args, **more):
        out = write(*args, **more)
        monkeypatch.setattr(store, "_write", write)
        st.Store(spark, store.root).append(rows(spark, (3, "c")), token=1)
        return out

    monkeypatch.setattr(store, "_write", slow)
    with pytest.raises(st.StaleBase):
        store.compact(1)
    assert live(store) == [(1, "a"), (2, "b"), (3, "c")]
    store.compact(1)
    assert live(store) == [(1, "a"), (2, "b"), (3, "c")]


def test_uncovered_segments_are_rewritten(spark, store):
    store.append(rows(spark, (1, "a b"), (2, "c")), token=1)
    store.append(rows(spark, (3, "d e")).withColumn("words", F.split("v", " ")), token=1, analyzer="v2")
    store.append(rows(spark, (2, "c d")), token=1, analyzer="v1")
    fresh = store.latest()["segments"][1]["name"]
    store.rewrite(1, "v2", lambda r: r.withColumn("words", F.split("v", " ")))
    assert {s["analyzer"] for s in store.latest()["segments"]} == {"v2"} and names(store)[0] == fresh
    assert sorted((r.id, r.words) for r in store.read().collect()) == [(1, ["a", "b"]), (2, ["c", "d"]), (3, ["d", "e"])]
    assert store.rewrite(1, "v2", lambda r: r) == store.latest()


def test_fingerprints_merge_and_see_repeats(spark):
    a, b = rows(spark, (1, "a"), (1, "a"), (2, None)), rows(spark, (None, "2"), (3, ""))
    assert st.merged([st.fingerprint(a), st.fingerprint(b)]) == st.fingerprint(b.unionByName(a).repartition(3))
    assert st.fingerprint(a) != st.fingerprint(a.distinct())
    assert st.fingerprint(rows(spark, (1, "a"), (1, "a"))) != st.fingerprint(rows(spark, (2, "b"), (2, "b")))
    assert st.fingerprint(a.limit(0)) == st.NOTHING


def test_damage_is_found(spark, store, tmp_path):
    store.append(rows(spark, (1, "a"), (2, "b")), token=1)
    store.append(rows(spark, (3, "c")), token=1)
    assert store.verify() == []
    bad = names(store)[1]
    rows(spark, (3, "changed")).withColumn(st.GENERATION, F.lit(2)).write.mode("overwrite").parquet(f"{store.root}/segments/{bad}")
    assert store.verify() == [bad]


def test_copies_are_verified(spark, store, tmp_path):
    store.append(rows(spark, (1, "a"), (2, "b"), (3, None)), token=1)
    store.delete(rows(spark, (2, "")), token=1)
    made = store.export_to(f"file://{tmp_path}/copy")
    assert made["fingerprint"]["n"] == 2
    other = st.Store(spark, f"file://{tmp_path}/other")
    other.import_from(f"file://{tmp_path}/copy", token=1)
    assert [r.id for r in other.read().orderBy("id").collect()] == [1, 3]
    rows(spark, (1, "a"), (3, "x")).write.mode("overwrite").parquet(f"file://{tmp_path}/copy/rows")
    with pytest.raises(st.Damaged, match="not those"):
        other.import_from(f"file://{tmp_path}/copy", token=1)
    os.remove(tmp_path / "copy" / "manifest.json")
    with pytest.raises(st.Damaged, match="no manifest"):
        other.import_from(f"file://{tmp_path}/copy", token=1)
