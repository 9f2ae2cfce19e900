"""Directly addressable codes, spelling variants and centroid clusters against plain Python; edge cases on small tables."""

import hashlib
import re
import time
import zlib
from collections import Counter

import duckdb
import numpy as np
import public_tokenizers
import pyarrow as pa
import pytest
from pyspark.sql import functions as F
from tokenizers import Tokenizer

from lodestone.llm import centroids, direct_codes, line_dedup, multiprobe, quality, queries, simhash, similarity, spelling, vector_blocks

WORDS = public_tokenizers.path("word_bpe_49k.json")
DOCS = "doc_id long, text string"


# 11: token ids in files


def crc(ids):
    return zlib.crc32(np.array(ids, "<u4").tobytes())


@pytest.mark.parametrize("top", [1, 255, 256, 70_000, 2**32 - 1])
@pytest.mark.parametrize("n", [1, 511, 512, 513, 5000])
def test_codes_give_any_id(n, top):
    ids = np.random.default_rng(n).integers(0, top, n, dtype=np.uint32, endpoint=True)
    ids[-1] = top
    raw = direct_codes.encode_file(3, 4, [7, None], np.array([n - 1, 1]), ids)
    c = direct_codes.Codes(raw + b"\n", check=True)
    assert (c.part, c.place, c.n, len(c.chunks)) == (3, 4, n, max(1, (top.bit_length() + 7) // 8))
    assert c.null.tolist() == [False, True] and c.bounds().tolist() == [0, n - 1, n]
    at = np.random.default_rng(1).permutation(n)
    assert (c.get(at) == ids[at]).all() and (c.get(at[:0]) == []).all()
    for lo, hi in [(0, n), (0, 0), (n, n), (n // 3, n // 2), (n - 1, n)]:
        assert (c.slice(lo, hi) == ids[lo:hi]).all()
    with pytest.raises(IndexError):
        c.get(np.array([n]))


def test_damaged_and_short_files_are_told():
    raw = direct_codes.encode_file(0, 0, [1], np.array([600]), np.arange(600, dtype=np.uint32))
    with pytest.raises(ValueError, match="damaged"):
        direct_codes.Codes(raw[:-9] + b"x" + raw[-8:], check=True)
    with pytest.raises(ValueError, match="short"):
        direct_codes.Codes(raw[:-700])
    with pytest.raises(ValueError, match="not a file"):
        direct_codes.Codes(b"something else")


def test_codes_keep_the_tokenizers_ids(spark, data):
    t = Tokenizer.from_file(WORDS)
    got = {r.doc_id: r for r in queries.op11_direct_codes(spark, data).collect()}
    rows = spark.read.parquet(f"{data}/documents.parquet").orderBy("doc_id").collect()
    at = 0
    for r in rows:
        ids = [*t.encode(r.text or "", add_special_tokens=False).ids, 1]
        assert (got[r.doc_id].start, got[r.doc_id].n_tokens, got[r.doc_id].ids_crc32) == (at, len(ids), crc(ids))
        at += len(ids)
    assert len(got) == len(rows)


def test_odd_rows_in_files_and_ids_by_position(spark, tmp_path):
    rows = [(5, None), (3, ""), (9, "z " * 5000), (3, "ab cd"), (3, "ab cd"), (None, "no id"), (-2, "日本語 😀\x00 <|endoftext|>"), (4, "one two three")]
    docs = spark.createDataFrame([(*r, "x") for r in rows], DOCS + ", start string").repartition(3)
    folder = str(tmp_path / "ids")
    direct_codes.write(docs, folder, WORDS, file_ids=8)
    t = Tokenizer.from_file(WORDS)
    got = sorted(direct_codes.documents(spark, folder).collect(), key=lambda r: r.start)
    key = lambda d: (d is not None, d or 0)
    assert [r.doc_id for r in got] == sorted([d for d, _ in rows], key=key)
    whole = []
    want = Counter((d, tuple([*t.encode(x or "", add_special_tokens=False).ids, 1])) for d, x in rows)
    assert Counter((r.doc_id, tuple(np.frombuffer(r.ids, "<u4").tolist())) for r in got) == want
    for r in got:
        assert r.start == len(whole) and r.n_tokens == len(r.ids) // 4
        whole += np.frombuffer(r.ids, "<u4").tolist()
    index = spark.read.parquet(f"{folder}/index")
    assert index.count() > 2 and index.agg({"ids": "sum"}).first()[0] == len(whole)
    asked = [*range(0, len(whole), 3), 0, len(whole), -1, None]
    found = direct_codes.tokens_at(spark, folder, spark.createDataFrame([(p,) for p in asked], "position long"), span=16).collect()
    assert sorted((r.position, r.id) for r in found) == [(p, whole[p]) for p in range(0, len(whole), 3)]


def test_no_documents_give_no_ids(spark, tmp_path):
    folder = str(tmp_path / "none")
    direct_codes.write(spark.createDataFrame([], DOCS), folder, WORDS)
    assert direct_codes.documents(spark, folder).count() == 0
    assert direct_codes.tokens_at(spark, folder, spark.range(3).toDF("position")).count() == 0


# 12: spelling variants


def counts_of(rows):
    n = Counter()
    for d, text in rows:
        for run in re.findall("[A-Za-zÀ-ÿ]+", text or ""):
            w = re.sub("[A-Z]", lambda m: m[0].lower(), run)
            h = zlib.crc32(f"{'' if d is None else d}:{w}".encode())
            if h % 97 == 0:
                at = h % len(w)
                w = w[:at] + w[at + 1 :]
            n[w] += 1
    return {w: c for w, c in n.items() if len(w) >= 5 and c >= 3}


def one_edit(a, b):
    if len(a) > len(b):
        a, b = b, a
    if len(a) == len(b):
        return sum(x != y for x, y in zip(a, b, strict=True)) == 1
    return len(b) == len(a) + 1 and any(b[:i] + b[i + 1 :] == a for i in range(len(b)))


def plain_variants(n):
    words = sorted(n)
    near = {w: [] for w in words}
    by_length = {}
    for w in words:
        by_length.setdefault(len(w), []).append(w)
    for w in words:
        near[w] = [v for k in (len(w) - 1, len(w), len(w) + 1) for v in by_length.get(k, ()) if v != w and one_edit(w, v)]
    out = {}
    for w in words:
        best = min(near[w], key=lambda v: (-n[v], v), default=None)
        form = best if best is not None and n[best] >= 2 * n[w] else None
        out[w] = (form, n[w], len(near[w]), n[form] if form else None)
    rows = set()
    for w, (form, c, k, fn) in out.items():
        root = w
        while out[root][0]:
            root = out[root][0]
        rows.add((w, form, root, c, k, fn))
    return rows


def as_set(df):
    rows = [tuple(r[c] for c in ("word", "form", "root", "n", "n_near", "form_n")) for r in df.collect()]
    assert len(rows) == len(set(rows))
    return set(rows)


def test_words_are_counted_with_slips(spark):
    text = "Über GÀRTEN ÿéÿéÿé gàrten abcd aBcDe×÷ x don't abcde naïve-naïve " * 3
    rows = [(i, text) for i in range(60)] + [(1, None), (None, "nulls nulls nulls nulls"), (2, ""), (3, "9 8 7 Ābcdef Ābcdef Ābcdef")]
    got = spelling.word_counts(spark.createDataFrame(rows, DOCS))
    want = counts_of(rows)
    assert {r.word: r.n for r in got.collect()} == want
    assert any(w not in ("gÀrten", "gàrten", "ÿéÿéÿé", "abcde×÷", "abcde", "naïve", "bcdef", "nulls") for w in want), "some slip"


def test_variants_equal_brute_force_on_the_table(spark, data):
    rows = [(r.doc_id, r.text) for r in spark.read.parquet(f"{data}/documents.parquet").collect()]
    assert as_set(queries.op12_spelling_variants(spark, data)) == plain_variants(counts_of(rows))


@pytest.mark.parametrize("group", [2, 5, 1000])
def test_parting_groups_loses_and_repeats_no_pair(spark, group):
    rng = np.random.default_rng(group)
    words = {"".join(rng.choice(list("abé"), size=k)) for k in (5, 5, 6, 6, 7, 8) for _ in range(60)}
    words |= {"a" * k for k in range(5, 14)} | {"x" * 3000, "x" * 3001, "x" * 1500 + "y" + "x" * 1500, "y" + "x" * 2999}
    n = {w: int(rng.integers(3, 40)) for w in words}
    table = spark.createDataFrame(list(n.items()), "word string, n long")
    assert as_set(spelling.variants(table, group=group)) == plain_variants(n)


@pytest.mark.parametrize("rows", [3, 7, 64])
def test_tiles_of_any_size_give_the_same(spark, rows):
    words = {f"stem{a}{b}" for a in "abcdefg" for b in "abcdefg"} | {f"stem{a}" for a in "abcdefg"}
    n = {w: 3 + i for i, w in enumerate(sorted(words))}
    table = spark.createDataFrame(list(n.items()), "word string, n long")
    got = {r.word: (r.n_near, r.form, r.form_n) for r in spelling.links(spelling.groups(table, 1000), rows).collect()}
    want = {}
    for w in words:
        own = [v for v in words if v != w and one_edit(w, v)]
        best = min(own, key=lambda v: (-n[v], v))
        want[w] = (len(own), best, n[best])
    assert got == want


def test_ties_chains_and_empty(spark):
    n = {"abcde": 3, "abcdf": 6, "abcdg": 6, "abcdfh": 12, "abcdfhi": 24, "zzzzz": 5, "zzzzzz": 9}
    table = spark.createDataFrame([(w, c, 1, "x") for w, c in n.items()], "word string, n long, root int, form string")
    got = {r.word: r for r in spelling.variants(table).collect()}
    assert {w: r.form for w, r in got.items()} == {"abcde": "abcdf", "abcdf": "abcdfh", "abcdg": None, "abcdfh": "abcdfhi", "abcdfhi": None, "zzzzz": None, "zzzzzz": None}
    assert got["abcde"].root == "abcdfhi" and got["zzzzz"].n_near == 1
    assert spelling.variants(table.limit(0)).count() == 0
    assert spelling.word_counts(spark.createDataFrame([], DOCS)).count() == 0


# 13: centroids


def plain_clusters(rows, k, rounds, dims, scale, seed):
    kept = [(i, [int(np.floor(scale * float(x))) for x in v]) for i, v in rows if v is not None and len(v) == dims and all(x is not None and np.isfinite(x) for x in v)]
    first = sorted((hashlib.sha256(f"{seed}:{'' if i is None else i}".encode()).hexdigest(), v) for i, v in kept)[:k]
    c = [v for _, v in first]

    def place():
        return [min((sum((a - b) ** 2 for a, b in zip(v, w, strict=True)), j) for j, w in enumerate(c)) for _, v in kept]

    for _ in range(rounds):
        at = place()
        for j in range(len(c)):
            own = [v for (_, v), (_, n) in zip(kept, at, strict=True) if n == j]
            if own:
                c[j] = [sum(x) // len(own) for x in zip(*own, strict=True)]
    at = place()
    inertia = Counter()
    for s, j in at:
        inertia[j] += s
    return sorted((-1 if i is None else i, j, s, inertia[j], sum(inertia.values()), hashlib.sha256(",".join(map(str, c[j])).encode()).hexdigest()) for (i, _), (s, j) in zip(kept, at, strict=True))


def found(df):
    return sorted((-1 if r.vec_id is None else r.vec_id, r.cluster, r.distance, r.cluster_inertia, r.inertia, r.centroid_sha256) for r in df.collect())


def test_clusters_equal_brute_force_with_odd_rows(spark):
    rng = np.random.default_rng(5)
    rows = [(i, [float(x) for x in rng.normal(size=6) * (1 + i % 3)]) for i in range(150)]
    rows += [(7, rows[7][1]), (8, [0.0] * 6), (None, [1.0] * 6), (200, None), (201, []), (202, [1.0] * 5), (203, [1.0] * 5 + [None]), (204, [float("nan")] * 6), (205, [float("inf")] + [0.0] * 5), (206, [-0.001] * 6), (207, [1e6] * 6)]
    df = spark.createDataFrame([(i, v, 3) for i, v in rows], "vec_id long, embedding array<double>, cluster int").repartition(3)
    for k, rounds in ((5, 3), (16, 1), (1, 2), (500, 2)):
        assert found(centroids.cluster(df, k=k, rounds=rounds, dims=6)) == plain_clusters(rows, k, rounds, 6, 64, 1)


def test_ties_go_to_the_smaller_centroid(spark):
    rows = [(i, [float(i % 4), 0.0]) for i in range(40)]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<float>")
    assert found(centroids.cluster(df, k=9, rounds=2, dims=2, scale=2)) == plain_clusters(rows, 9, 2, 2, 2, 1)


def test_no_vectors_give_no_clusters(spark):
    df = spark.createDataFrame([(1, None), (2, [1.0])], "vec_id long, embedding array<float>")
    assert centroids.cluster(df).count() == 0 and centroids.cluster(df.limit(0)).count() == 0


def test_components_too_large_for_a_long_are_told(spark):
    df = spark.createDataFrame([(1, [1e30] * 64)], "vec_id long, embedding array<double>")
    with pytest.raises(Exception, match="would not fit a long"):
        centroids.cluster(df).count()


def test_inequalities_pass_centroids_over_and_change_nothing():
    rng = np.random.default_rng(0)
    c = (rng.normal(size=(64, 16)) * 30 + rng.integers(-200, 200, 64)[:, None]).astype(np.int64)
    x = (rng.normal(size=(3000, 16)) * 30 + rng.integers(-200, 200, 3000)[:, None]).astype(np.int64)
    c[10], x[5] = c[3], c[3]
    search = centroids.Search(c)
    number, distance = search.nearest(x)
    all_ = ((x[:, None] - c[None]) ** 2).sum(2)
    assert (number == all_.argmin(1)).all() and (distance == all_.min(1)).all()
    assert search.measured < 0.25 * all_.size


def test_clusters_equal_their_sql(spark):
    sf = "/root/testdata/sf0.01"
    con = duckdb.connect()
    con.execute(f"CREATE VIEW embeddings AS SELECT * FROM '{sf}/embeddings.parquet'")
    rows = con.execute("SELECT vec_id, cluster, distance, cluster_inertia, inertia, centroid_sha256 FROM (" + queries.oracle_sql()["op13_centroid_clusters"] + ")").fetchall()
    assert found(queries.op13_centroid_clusters(spark, sf)) == sorted(rows)


# 7, 8 and 5: what this round has changed


def plain_components(sets, least, block=None):
    root = list(range(len(sets)))

    def top(x):
        while root[x] != x:
            x = root[x]
        return x

    for i in range(len(sets)):
        for j in range(i + 1, len(sets)):
            if (block is None or block[i] != block[j]) and len(sets[i] & sets[j]) / len(sets[i] | sets[j]) >= least:
                a, b = sorted((top(i), top(j)))
                root[b] = a
    return [top(i) for i in range(len(sets))]


def packed(sets):
    return np.concatenate([np.array(sorted(s), np.int64) for s in sets]), np.cumsum([0, *map(len, sets)])


def test_comparing_rare_members_loses_no_link():
    rng = np.random.default_rng(0)
    for trial in range(150):
        base = [set(rng.integers(0, 60, int(rng.integers(1, 25))).tolist()) for _ in range(6)]
        sets = [set(base[int(rng.integers(6))]) | set(rng.integers(0, 60, int(rng.integers(0, 3))).tolist()) for _ in range(int(rng.integers(2, 40)))]
        least, block = float(rng.choice([0.5, 0.8, 1.0])), rng.integers(0, 3, len(sets)) if trial % 3 == 0 else None
        assert similarity.alike(*packed(sets), least, block).tolist() == plain_components(sets, least, block)
    assert similarity.alike(np.zeros(0, np.int64), np.array([0]), 0.8).tolist() == []


def test_many_sets_alike_or_not_take_little_time():
    n, start = 26_000, time.time()
    own = np.arange(n)[:, None]
    forms = np.concatenate([np.tile(np.arange(14), (n, 1)), 14 + 6 * own + np.arange(6)], 1).ravel()
    assert len(set(similarity.alike(forms, np.arange(n + 1) * 20, 0.8).tolist())) == n
    copies = np.concatenate([np.tile(np.arange(19), (n, 1)), 19 + own], 1).ravel()
    assert set(similarity.alike(copies, np.arange(n + 1) * 20, 0.8).tolist()) == {0}
    assert time.time() - start < 5


def test_a_shingle_of_very_many_documents_hides_no_pair(spark):
    """Over BLOCK documents share a passage, and among them are pairs of a similarity just over 0.8."""
    rng = np.random.default_rng(3)
    passage = " ".join(f"p{i}" for i in range(12))
    words = lambda n: [f"w{x}" for x in rng.integers(0, 10**9, n)]
    texts = [f"{passage} {' '.join(words(8))}" for _ in range(simhash.BLOCK + 400)]
    pairs = []
    for _ in range(150):
        tail = words(78)
        other = [*tail[:-8], *words(8)]  # 86 shingles each, 78 shared: 0.83
        pairs.append((len(texts), len(texts) + 1))
        texts += [f"{passage} {' '.join(tail)}", f"{passage} {' '.join(other)}"]
    df = spark.createDataFrame(list(enumerate(texts)), DOCS).repartition(8)
    root = {r.doc_id: r.component_id for r in simhash.similar_duplicates(df).collect()}
    assert sum(root[a] == root[b] for a, b in pairs) == len(pairs)
    assert len(set(root.values())) == len(texts) - len(pairs)


def test_lines_go_in_linear_time_and_from_rows_that_share_an_id(spark):
    lines = [f"line number {k} of all" for k in range(16_000)]
    rows = [(i, f"s{i % 12}", "\n".join([f"own {i}", *lines])) for i in range(24)]
    schema = "doc_id long, source string, text string"
    line_dedup.dedup_lines(spark.createDataFrame(rows[:2], schema)).count()
    start = time.time()
    got = {r.doc_id: r for r in line_dedup.dedup_lines(spark.createDataFrame(rows, schema)).collect()}
    assert time.time() - start < 25
    assert got[0].text == rows[0][2] and all(got[i].text == f"own {i}" and got[i].n_removed == 16_000 for i in range(1, 24))
    rows = [(i, f"s{i}", "menu\nkept %d\nmenu\n\n menu " % i) for i in range(6)] + [(3, "s3", "another\nmenu"), (None, "x", "menu\nz"), (None, "y", "menu"), (7, "z", None), (8, "z", "menu")]
    got = sorted(((r.doc_id, r.n_lines, r.n_removed, r.text) for r in line_dedup.dedup_lines(spark.createDataFrame(rows, schema)).collect()), key=str)
    want = [(0, 5, 0, rows[0][2])] + [(i, 5, 3, f"kept {i}\n") for i in range(1, 6)] + [(3, 2, 1, "another"), (None, 2, 1, "z"), (None, 1, 1, ""), (7, 0, 0, None), (8, 1, 1, "")]
    assert got == sorted(want, key=str)


def test_a_word_after_itself_is_one_feature():
    (buckets, owner) = quality.features(["aa aa bb", "zz zz", "aa bb"])[-1]
    assert buckets[owner == 1].tolist() == [quality.REPEATED] and buckets[owner == 0].tolist().count(quality.REPEATED) == 1 and quality.REPEATED not in buckets[owner == 2]


def test_a_query_block_meets_each_group_once(spark, monkeypatch):
    """Whatever number of query blocks comes to a group together, each meets the group's whole blocks, a single time."""
    rng = np.random.default_rng(4)
    df = spark.createDataFrame([(i, [float(c) for c in v]) for i, v in enumerate(rng.normal(size=(90, 3)))], "id long, v array<double>").coalesce(1)
    monkeypatch.setattr(vector_blocks, "BLOCKS_A_GROUP", 2)
    ask = vector_blocks.cut(vector_blocks.asked(vector_blocks.blocks(df.where("id % 2 = 0"), 4)))
    vectors = vector_blocks.cut(vector_blocks.grouped(vector_blocks.blocks(df, 8)))

    def seen(block, q_ids, q, bodies):
        tops = [t for t, _, _ in bodies]
        assert tops == sorted(tops, reverse=True) and q.shape == (len(q_ids), 3)
        ids = [i for _, own, _ in bodies for i in own.tolist()]
        return pa.table({"q": pa.array(np.repeat(q_ids, len(ids))), "id": pa.array(ids * len(q_ids), pa.int64())})

    for together in (1, 3, 100):
        every = ask.join(vectors.select("dims", "g").distinct(), "dims")
        got = sorted(map(tuple, vector_blocks.meet(every, vectors, seen, "q long, id long", together).collect()))
        assert got == [(q, i) for q in range(0, 90, 2) for i in range(90)]
    nothing = ask.where("block < 0").join(vectors.select("dims", "g").distinct(), "dims")
    assert vector_blocks.meet(nothing, vectors, seen, "q long, id long").collect() == []


@pytest.mark.parametrize(("tile", "heavy"), [(1, 1000), (2, 1000), (4, 2), (2, 1.25)])
def test_blocks_of_a_hot_bucket_meet_once(spark, monkeypatch, tile, heavy):
    """Seven vector blocks and five query blocks in one bucket, one of each in another, and a bucket of one side only."""
    monkeypatch.setattr(multiprobe, "TILE", tile)
    monkeypatch.setattr(multiprobe, "HEAVY", heavy)  # with the last, only the queries' bucket is heavy
    v = spark.createDataFrame([(1, b) for b in range(7)] + [(2, 0), (3, 0)], "key long, v_block int")
    q = spark.createDataFrame([(1, b) for b in range(5)] + [(2, 0)], "key long, q_block int")
    v_heavy, q_heavy = (multiprobe._heavy(multiprobe._parts(x, 1)) for x in (v, q))
    v = multiprobe._tiled(v, "v_block", "v_tile", v_heavy, "q_tile", q_heavy)
    q = multiprobe._tiled(q, "q_block", "q_tile", q_heavy, "v_tile", v_heavy)
    met = q.join(v, ["key", "q_tile", "v_tile"])
    pairs = sorted((r.key, r.q_block, r.v_block) for r in met.collect())
    assert pairs == [(1, a, b) for a in range(5) for b in range(7)] + [(2, 0, 0)]
    assert met.groupBy("key", "q_tile", "v_tile").count().agg(F.max("count")).first()[0] <= tile * (tile if heavy > 1.25 else 7)


def test_many_queries_of_a_hot_bucket(spark):
    """Queries and vectors that are mostly one point: both sides of its bucket are cut, and ties go to the smaller ids."""
    x = np.random.default_rng(8).normal(size=(40, 8))
    rows = [(i, (x[0] if i < 1500 else x[i - 1490]).tolist()) for i in range(1520)]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<float>")
    got = multiprobe.nearest(df, df.where("vec_id < 1200"), k=3).collect()
    found = {(r.query_id, r["rank"]): (r.vec_id, r.score) for r in got}
    assert len(got) == len(found) == 3600
    for q in range(1200):
        assert [found[q, n] for n in (1, 2, 3)] == [(i, 0.0) for i in range(4) if i != q][:3]


@pytest.mark.parametrize("heavy", [1000, 3, 0])
def test_buckets_are_cut_into_the_same_blocks_heavy_or_not(spark, monkeypatch, heavy):
    monkeypatch.setattr(multiprobe, "HEAVY", heavy)
    rows = [(i % 7 if i % 3 else 1, 2, i, bytes([i % 256])) for i in range(400)]
    members = spark.createDataFrame([*rows, *rows[:20]], "key long, dims int, id long, vec binary")
    parts = multiprobe._parts(members, 16)
    cut_up = multiprobe._bucket_blocks(members, parts, "ids", "vecs", "block").collect()
    held = sorted((r.key, r.dims, i, bytes(v)) for r in cut_up for i, v in zip(r.ids, r.vecs, strict=True))
    assert held == sorted([*rows, *rows[:20]])
    assert len({(r.key, r.block) for r in cut_up}) == len(cut_up)
    assert all(r.block < p for r in cut_up for k, n, p in parts.collect() if k == r.key)
    assert (multiprobe._heavy(parts).count() > 0) == (heavy > 0)
