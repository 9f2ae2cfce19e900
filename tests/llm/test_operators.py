"""The ten operators against brute force, exact round trips, SQL and held-out accuracy; edge cases on small tables."""

import hashlib
import math
import time
import tracemalloc
import zlib
from collections import defaultdict

import duckdb
import numpy as np
import public_tokenizers
import pytest
import xxhash
from pyspark.sql import functions as F

from lodestone.llm import agenda, bpe, chat, components, inner_product, line_dedup, multiprobe, packing, piece_dropout, quality, queries, simhash, similarity, token_counts, url_filter, vector_blocks
from lodestone.llm.common import mix, segment_hashes

PIECES = public_tokenizers.path("piece_bpe_32k.model")
WORDS = public_tokenizers.path("word_bpe_49k.json")
DOCS = "doc_id long, text string, lang string, source string, n_chars long"
ODD = ["", None, " ", "a", "  two  spaces ", "日本語テスト😀 ▁x\x00y\n\n\t<s></s><unk>", "ab" * 3000, "=" * 500, "né́e ﬁ Ⅻ", "<|endoftext|> foo<|endoftext|>bar", "\x1c\x85x y　z ΣΑΣ İ don't!'s"]


def odd_docs(spark):
    rows = [(i, t, "en", "s", 0) for i, t in enumerate(ODD)] + [(3, "a", "en", "s", 0), (None, "no id", None, None, None), (None, None, None, None, None)]
    return spark.createDataFrame(rows, DOCS)


# 1, 2: vectors


def vectors(spark, n=400, dims=16, seed=0):
    rng = np.random.default_rng(seed)
    x = rng.normal(size=(n, dims)).astype(np.float32)
    x[5] = x[4]
    rows = [(i, [float(v) for v in row]) for i, row in enumerate(x)]
    rows += [(1000, None), (1001, []), (1002, [0.0] * dims), (1003, [1.0] * (dims - 1) + [None]), (1004, [float("nan")] + [1.0] * (dims - 1)), (1005, [float("inf")] * dims), (1006, [1.0, 2.0]), (7, [float(v) for v in x[7]])]
    return spark.createDataFrame(rows, "vec_id long, embedding array<float>"), x.astype(np.float64)


def test_nearest_reaches_the_recall(spark):
    df, x = vectors(spark)
    got = multiprobe.nearest(df, df.where("vec_id % 20 = 0"), k=10).collect()
    found = defaultdict(dict)
    for r in got:
        found[r.query_id][r["rank"]] = (r.vec_id, r.score)
    hits = total = 0
    for q in range(0, 400, 20):
        d = np.sqrt(((x - x[q]) ** 2).sum(1))
        d[q] = np.inf
        own = found[q]
        assert sorted(own) == list(range(1, 11))
        for v, s in own.values():
            assert v < 400 and abs(s - d[v]) < 1e-12
        assert [own[k] for k in sorted(own)] == sorted(own.values(), key=lambda p: (p[1], p[0]))
        hits += len({v for v, _ in own.values()} & set(np.argsort(d, kind="stable")[:10].tolist()))
        total += 10
    assert hits / total >= 0.9
    # vectors that take no part, and the only vector of its length, find nothing
    assert not {1000, 1002, 1003, 1004, 1005, 1006} & set(found)


def test_nearest_recall_on_the_table(spark):
    e = spark.read.parquet("/root/testdata/sf0.1/embeddings.parquet").select("vec_id", "embedding")
    got = multiprobe.nearest(e, e.where("vec_id % 100 = 0"), k=10).collect()
    rows = e.collect()
    ids, x = np.array([r.vec_id for r in rows]), np.array([r.embedding for r in rows], np.float64)
    hits = 0
    asked = sorted({r.query_id for r in got})
    for q in asked:
        d = np.sqrt(((x - x[ids == q][0]) ** 2).sum(1))
        d[ids == q] = np.inf
        hits += len({r.vec_id for r in got if r.query_id == q} & set(ids[np.lexsort((ids, d))[:10]].tolist()))
    assert len(asked) == 20 and hits / (10 * len(asked)) >= 0.9


def test_nearest_with_few_candidates_finds_all(spark):
    df = spark.createDataFrame([(i, [float(i), 1.0]) for i in range(4)], "vec_id long, embedding array<double>")
    got = multiprobe.nearest(df, df.where("vec_id = 0")).orderBy("rank").collect()
    assert [(r.vec_id, r.score) for r in got] == [(1, 1.0), (2, 2.0), (3, 3.0)]
    assert multiprobe.nearest(df.where("vec_id < 0"), df.where("vec_id < 0")).count() == 0


@pytest.mark.parametrize("scale", [1.0, 1e-160, 1e160])
def test_near_measures_what_the_bound_leaves(scale):
    rng = np.random.default_rng(11)
    v = rng.normal(size=(300, 7)) * scale
    v[50:90] = v[50] * (1 + 1e-15 * rng.integers(0, 2, size=(40, 1)))
    ids = np.r_[np.arange(290), np.arange(10)]  # ten ids have two rows
    q_ids, q = np.arange(40, 60), v[40:60]
    with np.errstate(over="ignore"):
        got = list(zip(*(x.tolist() for x in multiprobe._near(q_ids, q, ids, v, 5)), strict=True))
        for i, own in zip(q_ids.tolist(), q, strict=True):
            cost = {}
            for j, row in zip(ids.tolist(), v, strict=True):
                if j != i:
                    cost[j] = min(cost.get(j, np.inf), float(np.sqrt(((own - row) ** 2).sum())))
            assert [(b, c) for a, b, c in got if a == i] == sorted(cost.items(), key=lambda x: (x[1], x[0]))[:5]


def test_nearest_takes_null_ids_clashing_columns_and_doubles(spark):
    x = np.random.default_rng(4).normal(size=(120, 6))
    rows = [(i, row.tolist(), 1, "k", 0.5) for i, row in enumerate(x)] + [(None, x[0].tolist(), 1, "k", 0.5)]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<double>, rank int, key string, score double")
    got = multiprobe.nearest(df, df.where("vec_id % 40 = 0"), k=3, tables=1, probes=0).collect()
    assert len(got) == 9 and all(r.vec_id is not None for r in got)
    for r in got:
        assert r.score == np.sqrt(((x[r.query_id] - x[r.vec_id]) ** 2).sum())


def test_nearest_in_a_hot_bucket(spark):
    """A vector that is most of the table fills many blocks of one bucket; ties go to the smaller ids."""
    x = np.random.default_rng(8).normal(size=(40, 8))
    rows = [(i, (x[0] if i < 1500 else x[i - 1490]).tolist()) for i in range(1520)]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<float>")
    got = multiprobe.nearest(df, df.where("vec_id IN (0, 3, 700)"), k=4).collect()
    found = {(r.query_id, r["rank"]): (r.vec_id, r.score) for r in got}
    for q, own in ((0, [1, 2, 3, 4]), (3, [0, 1, 2, 4]), (700, [0, 1, 2, 3])):
        assert [found[q, n + 1] for n in range(4)] == [(i, 0.0) for i in own]


def test_probes_come_in_order_of_their_sums():
    walls = np.sort(np.random.default_rng(2).random(8))
    axis = np.random.default_rng(3).permutation(8) % 4
    sets = multiprobe.perturbations(walls, axis, 60)
    sums = [sum(walls[list(s)]) for s in sets]
    assert sums[0] == 0 and sums == sorted(sums) and len(set(sets)) == 61
    assert all(len({axis[i] for i in s}) == len(s) for s in sets)
    # each of four projections stays, goes down or goes up
    assert len(multiprobe.perturbations(walls, axis, 1000)) == 3**4


@pytest.mark.parametrize("threshold", [0.0, 0.6, 2.0])
def test_products_are_exact(spark, threshold, monkeypatch):
    df, x = vectors(spark, n=300)
    monkeypatch.setattr(inner_product, "COORDINATE_FROM", threshold)
    got = inner_product.top_products(df, df.where("vec_id % 50 = 0")).collect()
    whole = {i: np.floor(256 * v).astype(np.int64) for i, v in enumerate(x)} | {1002: np.zeros(16, np.int64)}
    for q in range(0, 300, 50):
        want = sorted((-int(whole[q] @ v), i) for i, v in whole.items() if i != q)[:5]
        assert [(-r.score, r.vec_id) for r in sorted(got, key=lambda r: r["rank"]) if r.query_id == q] == want


def test_products_prune_groups_by_length(spark, monkeypatch):
    """Norms over several orders of magnitude, in many small groups; and products beyond 2**53."""
    monkeypatch.setattr(inner_product, "V_ROWS", 8)
    monkeypatch.setattr(vector_blocks, "BLOCKS_A_GROUP", 2)
    rng = np.random.default_rng(9)
    x = rng.normal(size=(300, 6)) * rng.lognormal(0, 1.2, (300, 1)) * 1e4
    x[7] = x[3]
    rows = [(i, [float(v) for v in row], "other") for i, row in enumerate(x)] + [(None, [1.0] * 6, "no id")]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<double>, score string")
    got = inner_product.top_products(df, df.where("vec_id % 50 = 0")).collect()
    whole = [[math.floor(256 * float(v)) for v in row] for row in x]
    assert max(abs(a) for v in whole for a in v) ** 2 > 2**53
    for q in range(0, 300, 50):
        want = sorted((-sum(a * b for a, b in zip(whole[q], v, strict=True)), i) for i, v in enumerate(whole) if i != q)[:5]
        assert [(-r.score, r.vec_id) for r in sorted(got, key=lambda r: r["rank"]) if r.query_id == q] == want


def test_products_beyond_doubles_are_whole_numbers(spark):
    """Products over 2**53 that differ in their last digits, beside null ids and columns named like the results."""
    rng = np.random.default_rng(9)
    base = rng.integers(1 << 26, 1 << 27, size=8)
    whole = [[int(c) for c in base + rng.integers(-1, 2, size=8)] for _ in range(60)]
    rows = [(i, [c / 256 for c in w], 7, "x") for i, w in enumerate(whole)] + [(None, [1e6] * 8, 7, "x")]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<double>, rank int, score string")
    got = inner_product.top_products(df, df.where("vec_id % 20 = 0"), k=5).collect()
    for q in (0, 20, 40):
        every = sorted((-sum(a * b for a, b in zip(whole[q], v, strict=True)), i) for i, v in enumerate(whole) if i != q)
        assert -every[0][0] > 2**53
        assert [(-r.score, r.vec_id) for r in sorted((r for r in got if r.query_id == q), key=lambda r: r["rank"])] == every[:5]


def test_products_beyond_64_bits_are_an_error(spark):
    df = spark.createDataFrame([(0, [1e10] * 4), (50, [1e10] * 4)], "vec_id long, embedding array<double>")
    with pytest.raises(Exception, match="64 bits"):
        inner_product.top_products(df, df).collect()


def test_pruned_walk_equals_all_products():
    rng = np.random.default_rng(5)
    v = np.floor(rng.normal(size=(600, 8)) * rng.lognormal(0, 1, (600, 1)) * 256)
    order = np.argsort(-np.sqrt((v**2).sum(1)), kind="stable")
    v, ids = v[order], order
    bodies = [(float(np.sqrt((v[a] ** 2).sum())), ids[a : a + 100], v[a : a + 100]) for a in range(0, 600, 100)]
    q, vec, s = inner_product._walk(ids[:50], v[:50], bodies, 5)
    for i in range(50):
        want = sorted((-int(v[i] @ w), int(j)) for w, j in zip(v, ids, strict=True) if j != ids[i])[:5]
        assert sorted((-int(p), int(j)) for a, j, p in zip(q, vec, s, strict=True) if a == ids[i]) == want


# 3: packing


def test_pieces_hold_the_tokenizers_ids(spark):
    from tokenizers import Tokenizer

    t = Tokenizer.from_file(WORDS)
    got = defaultdict(list)
    for r in packing.token_pieces(odd_docs(spark).where("doc_id <> 3"), WORDS, 64).collect():
        got[r.doc_id].append((r.piece, r.start, r.length, np.frombuffer(r.ids, "<u4").tolist()))
    for i, text in enumerate(ODD):
        if i != 3:
            ids = t.encode(text or "", add_special_tokens=False).ids + [0]
            want = [(k, k * 64, len(ids[k * 64 : k * 64 + 64]), ids[k * 64 : k * 64 + 64]) for k in range(-(-len(ids) // 64))]
            assert sorted(got[i]) == want


def held(rows, capacity):
    places = defaultdict(list)
    for r in rows:
        places[r.sequence_id].append((r.offset, r.length))
    for p in places.values():
        p.sort()
        assert [o for o, _ in p] == [sum(n for _, n in p[:i]) for i in range(len(p))] and sum(n for _, n in p) <= capacity
    return len(places)


def test_packing_is_gapless_and_tight(spark):
    docs = spark.read.parquet("/root/testdata/sf0.01/documents.parquet")
    rows = queries.packed_documents(docs).collect()
    n = held(rows, 2048)
    assert n == math.ceil(sum(r.length for r in rows) / 2048)
    assert len(rows) == len({(r.doc_id, r.piece) for r in rows})


def test_packing_equals_best_fit_decreasing(spark):
    rng = np.random.default_rng(3)
    lengths = rng.integers(1, 101, 400).tolist() + [100] * 30
    bins = []
    for x in sorted(lengths, reverse=True):
        fits = [i for i, room in enumerate(bins) if room >= x]
        if fits:
            bins[min(fits, key=lambda i: bins[i])] -= x
        else:
            bins.append(100 - x)
    df = spark.createDataFrame([(i, int(x)) for i, x in enumerate(lengths)], "doc_id long, length long")
    rows = packing.pack(df, 100).collect()
    assert len(rows) == len(lengths) and held(rows, 100) == len(bins)
    assert packing.pack(df.where("length < 0"), 100).count() == 0
    with pytest.raises(ValueError):
        packing.pack(df, 50)


def test_packing_of_odd_documents(spark):
    rows = queries.packed_documents(odd_docs(spark)).collect()
    assert held(rows, 2048) and len([r for r in rows if r.doc_id is None]) == 2


# 4: chat


def test_chat_round_trip(spark):
    turns = [(1, 0, "user", "<|im_end|> <\\|im_start|> <\\\\| | < \\"), (1, 1, "assistant", "é<|im_start|>x\n"), (2, 0, "assistant", "wrong start"), (2, 1, None, None), (3, 0, "us%er\n<|x", "t"), (3, 0, "us%er\n<|x", "t"), (None, 5, "user", "no id"), (4, 0, "system", "s"), (4, 1, "user", "u"), (4, 2, "assistant", "")]
    df = spark.createDataFrame([(*t, 9) for t in turns], "conv_id long, turn long, role string, text string, formatted long")
    out = chat.format_chats(df).withColumn("turns", chat.parse_chats(F.col("formatted"))).withColumn("loss", chat.loss_text(F.col("segments"))).collect()
    by = {r.conv_id: r for r in out}
    for c in (1, 2, 3, 4, None):
        want = sorted((t[1], t[2] or "", t[3] or "") for t in turns if t[0] == c)
        assert [(t.role, t.text) for t in by[c].turns] == [w[1:] for w in want]
        assert by[c].loss == "".join(w[2] for w in want if w[1] == "assistant")
        assert by[c].formatted == "".join(s.text for s in by[c].segments)
    assert [by[c].state for c in (1, 2, 3, 4)] == ["assistant", "invalid", "invalid", "assistant"] and by[4].valid and not by[None].valid
    assert chat.format_chats(df.where("turn < 0")).count() == 0


def test_very_long_turns(spark):
    text = "<|im_end|>long text é\n" * 60_000
    df = spark.createDataFrame([(1, 0, "user", text, "a", "b"), (1, 1, "assistant", text, "a", "b")], "conv_id long, turn long, role string, text string, segments string, valid string")
    out = chat.format_chats(df).select(chat.parse_chats(F.col("formatted")).alias("turns"), chat.loss_text(F.col("segments")).alias("loss"), "valid").first()
    assert [(t.role, t.text) for t in out.turns] == [("user", text), ("assistant", text)] and out.loss == text and out.valid is True


OTHER_TEMPLATES = [
    {"assistant": [("<|bot|>", False), ("<|me|>", False), (chat.TEXT, True), ("<|end|>", True)], None: [("<|bot|>", False), ("<|as|>", False), (chat.ROLE, False), ("<|says|>", False), (chat.TEXT, False), ("<|end|>", False), ("\n\n", False)]},
    {None: [("<|t|>", False), ("* ", False), (chat.ROLE, True), ("\n", False), ("> ", False), (chat.TEXT, True), ("<|/t|>", False)]},
    {"user": [("<|t|>", False), (chat.ROLE, False), ("\nQ: ", False), (chat.TEXT, False), ("<|x|>", False)], None: [("<|t|>", False), (chat.ROLE, False), ("\n", False), (chat.TEXT, True), ("<|x|>", False)]},
]


@pytest.mark.parametrize("n", range(3))
def test_other_templates_read_back(spark, n):
    said = ["plain", "", "<|t|> <|bot|><|end|>x", "a\n> b <\\|says|>", "long " * 20000]
    turns = [(c, i, role, text, "clash") for c, text in enumerate(said) for i, role in enumerate(("system", "user", "assistant", "t%\n<|as|>"))]
    df = spark.createDataFrame(turns, "conv_id long, turn long, role string, text string, state string")
    out = chat.format_chats(df, OTHER_TEMPLATES[n]).withColumn("turns", chat.parse_chats(F.col("formatted"), OTHER_TEMPLATES[n])).collect()
    assert len(out) == len(said)
    for r in out:
        assert [(t.role, t.text) for t in r.turns] == [(t[2], t[3]) for t in turns if t[0] == r.conv_id]
        assert r.formatted == "".join(s.text for s in r.segments)


def test_entries_that_look_alike_are_errors():
    general = [("<|t|>", False), (chat.ROLE, False), ("\n", False), (chat.TEXT, False), ("<|x|>", False)]
    for own in ([("<|t|>", False), (chat.TEXT, True), ("<|x|>", False)], [("<|t|>", False), ("Q: ", False), (chat.ROLE, False), ("\n", False), (chat.TEXT, False), ("<|x|>", False)]):
        with pytest.raises(ValueError):
            chat.check_template({None: general, "user": own})


@pytest.mark.parametrize("parts", [[(chat.ROLE, False), (chat.TEXT, False), ("<|x|>", False)], [("<|t|>", False), (chat.ROLE, False), ("\n", False), (chat.TEXT, False), ("end", False)], [("<|t|>", False), (chat.ROLE, False), (": ", False), (chat.TEXT, False), ("<|x|>", False)], [("<|t|>", False), (chat.TEXT, False), ("<|x|>", False)]])
def test_templates_that_cannot_be_read_back_are_errors(parts):
    with pytest.raises(ValueError):
        chat.check_template({None: parts})


def test_chat_digest(spark, data):
    r = [x for x in queries.op4_chat_formatting(spark, data).collect() if x.conv_id == -1][0]
    text = queries.TRICKY
    assert r.n_turns == 2 and r.turns_sha256 == hashlib.sha256(f"user\n{text}\nassistant\n{text}\n".encode()).hexdigest()
    assert r.loss_chars == len(text) and r.loss_sha256 == hashlib.sha256(text.encode()).hexdigest()


# 5: quality


def test_quality_on_held_out_labels(spark):
    sf = "/root/testdata/sf0.1"
    out = {r.doc_id: r for r in queries.op5_quality_classifier(spark, sf).collect()}
    labels = spark.read.parquet(f"{sf}/labels.parquet").collect()
    kept = [r for r in labels if zlib.crc32(str(r.doc_id).encode()) % 3 == 1 and r.doc_id in out]
    assert kept and all(out[r.doc_id].held_out for r in kept)
    good = [out[r.doc_id].predicted for r in kept if r.quality == 1]
    bad = [out[r.doc_id].predicted for r in kept if r.quality == 0]
    assert np.mean(good) >= 0.98 and np.mean(bad) <= 0.1


def test_scores_equal_plain_python(spark):
    """Every text of the small table and the odd ones, feature by feature."""
    golden, shift, word_hash = 1 << 64, 64 - quality.BITS, {}

    def words_of(text):
        out, here = [], ""
        for c in text + " ":
            if ord(c) in quality.WHITE:
                if here:
                    out.append(here)
                here = ""
            else:
                here += c
        return out

    def hashed(word):
        if word not in word_hash:
            codes = np.array(list(map(ord, word)), np.uint32)
            word_hash[word] = int(segment_hashes(codes, np.array([0]), np.array([len(codes)]))[0])
        return word_hash[word]

    def mixed(x):
        return int(mix(np.array([x % golden], np.uint64))[0]) >> shift

    rng = np.random.default_rng(0)
    model = quality.Model(rng.normal(size=quality.BUCKETS).astype(np.float32), 0.25)
    texts = [r.text or "" for r in spark.read.parquet("/root/testdata/sf0.001/documents.parquet").limit(40).collect()] + [t or "" for t in ODD if len(t or "") < 2000]
    steps = [int(x) for x in quality._STEPS]
    grams = {}
    for text, got in zip(texts, model.scores(texts), strict=True):
        found = []
        plain = "".join(" " if ord(c) in quality.WHITE else c for c in text)
        for n in quality.NGRAMS:
            for i in range(len(plain) - n + 1):
                gram = plain[i : i + n]
                if " " not in gram[1:-1]:
                    if gram not in grams:
                        grams[gram] = mixed(n + sum(ord(c) * s for c, s in zip(gram, steps, strict=False)))
                    found.append(grams[gram])
        own = words_of(text)
        found += [hashed(w) >> shift for w in own]
        found += [mixed((hashed(a) ^ hashed(b)) + steps[0]) for a, b in zip(own, own[1:], strict=False)]
        odds = 0.25 + (float(np.mean(model.weight[found].astype(np.float64))) if found else 0.0)
        assert abs(got - 1 / (1 + math.exp(-odds))) < 1e-9


def test_training_stays_within_its_bounds(spark):
    docs = spark.createDataFrame([(i, " ".join(f"w{i}x{j}" for j in range(200))) for i in range(30)], "doc_id long, text string")
    labels = spark.createDataFrame([(i, i % 2) for i in range(30)], "doc_id long, quality int")
    whole, part = quality.train(docs, labels), quality.train(docs, labels, max_features=5000)
    few = quality.train(docs, labels, max_rows=3)
    assert np.count_nonzero(whole.weight != part.weight) and np.count_nonzero(part.weight != few.weight)
    assert quality.train(docs, labels, max_features=10).weight.any() == False  # noqa: E712  nothing fits


def test_quality_edges(spark):
    docs = odd_docs(spark)
    none = spark.createDataFrame([], "doc_id long, quality int")
    scored = quality.score(docs.withColumn("score", F.lit("x")), quality.train(docs, none)).collect()
    assert len(scored) == docs.count() and all(r.score == 0.5 and r.predicted == 1 for r in scored)
    one = spark.createDataFrame([(3, 1), (4, 1), (4, None), (None, 0)], "doc_id long, quality int")
    assert all(r.predicted == 1 for r in quality.score(docs, quality.train(docs, one)).collect())
    both = spark.createDataFrame([(3, 1), (6, 0), (7, 0)], "doc_id long, quality int")
    model = quality.train(docs, both, max_rows=2)
    assert quality.score(docs, model, keep_text=True).where("text IS NULL").count() == 2
    assert quality.score(docs.where("doc_id < 0"), model).count() == 0


# 6, 9: pieces


def test_counts_equal_the_library(spark):
    v = bpe.vocabulary(PIECES)
    docs = spark.read.parquet("/root/testdata/sf0.001/documents.parquet").select("doc_id", "text").unionByName(odd_docs(spark).select((F.col("doc_id") + 100000).alias("doc_id"), "text"))
    texts = {(r.doc_id, r.text) for r in docs.collect()}
    got = token_counts.token_counts(docs.withColumn("n_tokens", F.lit(-1)), PIECES, limit=50).collect()
    want = defaultdict(list)
    for i, t in texts:
        want[i].append((len((t or "").encode()), len(v.processor.encode(t or ""))))
    for r in got:
        assert (r.n_bytes, r.n_tokens) in want[r.doc_id] and r.over_limit == (r.n_tokens > 50)
    assert token_counts.token_counts(docs.where("doc_id < 0"), PIECES).count() == 0


def by_hand(v, rank, chars, key, p):
    """One pre-token merged place by place; what is popped and skipped is never looked at again."""
    parts, gone = [(c, i) for i, c in enumerate(chars)], set()
    while True:
        best = None
        for (a, i), (b, _) in zip(parts, parts[1:], strict=False):
            if a + b in rank and (i, len(a), len(b)) not in gone and (best is None or rank[a + b] < best[0]):
                best = (rank[a + b], i, len(a), len(b))
        if best is None:
            return [x for x, _ in parts]
        _, i, a, b = best
        if agenda.skipped(np.array([key], np.uint64), np.array([i]), np.array([a]), np.array([b]), p)[0]:
            gone.add((i, a, b))
        else:
            parts = [(chars[i : i + a + b], i) if x == i else (t, x) for t, x in parts if x != i + a]


def ranks(v):
    return {v.pieces[i]: -v.processor.get_score(i) for i in range(3, v.size) if not v.processor.is_byte(i)}


@pytest.mark.parametrize("p", [0.0, 0.3, 1.0])
@pytest.mark.parametrize("widest", [64, 2])
def test_agendas_in_step_and_by_heap(p, widest, monkeypatch):
    monkeypatch.setattr(agenda, "WIDEST", widest)
    v = bpe.vocabulary(PIECES)
    words = ["▁tokenization", "aaaaaaaaaaaaa", "▁▁▁▁▁▁▁", "xyzzyxyzzy", "▁internationalisation", "q", "▁the", "ab" * 70, "=" * 200]
    codes = np.array([ord(c) for w in words for c in w], np.uint32)
    keys = np.arange(1, len(words) + 1, dtype=np.uint64) * np.uint64(7919)
    (sym, at, size, seq), popped = agenda.work_agendas(v, codes, np.array([len(w) for w in words]), keys, p)
    for n, w in enumerate(words):
        got = [w[a : a + s] for a, s, q in zip(at, size, seq, strict=True) if q == n]
        assert "".join(got) == w and got == by_hand(v, ranks(v), w, int(keys[n]), p)
    if not p:
        s, a, z, q = bpe.merged(v, codes, np.array([len(w) for w in words]))
        assert [x.tolist() for x in (sym, at, size, seq)] == [x.tolist() for x in (s, a, z, q)]
        assert len(popped[0]) == len(codes) - len(sym)  # every pop merges


def test_op9_equals_a_plain_agenda(spark, data):
    """The query's ids, for every word of every text of the small table."""
    v = bpe.vocabulary(PIECES)
    rank, piece = ranks(v), {p: i for i, p in enumerate(v.pieces)}
    got = {r.doc_id: r for r in queries.op9_merge_dropout(spark, data).collect()}
    seed = mix(np.array([13], np.uint64))
    rows = spark.read.parquet(f"{data}/documents.parquet").collect()
    for r in rows:
        text = r.text or ""
        chars = "".join("\ud800" if c == bpe.SPACE else bpe.SPACE if c == " " else c for c in (" " + text if text else ""))
        doc = np.array([xxhash.xxh64_intdigest(f"{r.doc_id}\0{text}".encode(), 42)], np.uint64)
        codes = np.frombuffer(chars.encode("utf-32-le", "surrogatepass"), np.uint32)
        starts = [*bpe.cut_places(v, codes, np.array([0, len(codes)])).tolist(), len(codes)]
        ids = []
        for a, b in zip(starts, starts[1:], strict=False):
            key = int(mix(np.array([a], np.uint64) + mix(doc ^ seed))[0])
            for part in by_hand(v, rank, chars[a:b], key, 0.1):
                ids += [piece[part]] if part in rank else v.byte_ids[list(part.replace("\ud800", bpe.SPACE).encode())].tolist()
        own = got[r.doc_id]
        assert own.lossless and own.n_tokens == len(ids) and own.ids_crc32 == zlib.crc32(np.array(ids, "<i4").tobytes())
    assert len(got) == len(rows)


def test_dropout_varies_and_decodes(spark):
    docs = odd_docs(spark)
    plain = piece_dropout.encode(docs, PIECES, dropout=0.0)
    one, two = (piece_dropout.encode(docs.withColumn("ids", F.lit(1)), PIECES, seed=s, dropout=0.3) for s in (1, 2))
    for e in (plain, one, two):
        back = sorted((r.doc_id if r.doc_id is not None else -1, r.text) for r in piece_dropout.decode(e, PIECES).collect())
        assert back == sorted((r.doc_id if r.doc_id is not None else -1, r.text or "") for r in docs.collect())
    a, b, again = ([bytes(r.ids) for r in x.collect()] for x in (one, two, piece_dropout.encode(docs, PIECES, seed=1, dropout=0.3)))
    assert a == again and a != b
    v = bpe.vocabulary(PIECES)
    for r in plain.join(docs.dropDuplicates(["doc_id"]).select("doc_id", "text"), "doc_id").where("NOT contains(text, '\u2581')").collect():
        assert np.frombuffer(r.ids, "<i4").tolist() == v.processor.encode(r.text or "")


def test_dropout_draws_at_every_place(spark):
    word = "international"
    docs = spark.createDataFrame([(i, word) for i in range(3000)], "doc_id long, text string")
    got = [bytes(r.ids) for r in piece_dropout.encode(docs, PIECES, seed=5, dropout=0.1).collect()]
    assert len(set(got)) > 8
    v = bpe.vocabulary(PIECES)
    codes = np.array([ord(bpe.SPACE), *map(ord, word)], np.uint32)
    n = len(agenda.work_agendas(v, codes, np.array([len(codes)]))[1][0])
    plain = np.array(v.processor.encode(word), "<i4").tobytes()
    # without a skip the library's pieces come out; with one they may still
    assert sum(g == plain for g in got) / 3000 > 0.9**n - 0.03
    # sharing gives what merging each place by itself would
    texts = [r.text or "" for r in odd_docs(spark).collect()]
    keys = list(range(len(texts)))
    ids, at = piece_dropout.encode_texts(v, texts, 3, 0.2, keys)
    for i, t in enumerate(texts):
        one, _ = piece_dropout.encode_texts(v, [t], 3, 0.2, [i])
        assert ids[at[i] : at[i + 1]].tolist() == one.tolist()


# 7: lines


def test_lines_against_brute_force(spark):
    shared, local = "All rights reserved.", "only here"
    rows = [(i, f"own {i}\n{shared}  \n\n{local}" if i < 12 else f"{shared}", "en", f"s{i % 11}" if i < 11 else None, 0) for i in range(14)]
    rows += [(20, None, "en", "s1", 0), (None, f"{shared}\nx", "en", "s2", 0), (13, f"{shared}", "en", "s3", 0)]
    df = spark.createDataFrame(rows, DOCS)
    out = {(r.doc_id, r.source): r for r in line_dedup.dedup_lines(df.withColumn("n_lines", F.lit("x")), min_sites=11).collect()}
    assert out[0, "s0"].text == f"own 0\n{shared}  \n\n{local}"  # the keeper
    assert out[1, "s1"].text == "own 1\n" and out[1, "s1"].n_removed == 2 and out[1, "s1"].n_lines == 4
    assert out[13, "s3"].text == "" and out[20, "s1"].text is None and out[20, "s1"].n_lines == 0
    assert out[None, "s2"].text == "x"
    same = line_dedup.dedup_lines(df, min_sites=14).collect()
    assert all(r.n_removed == 0 for r in same) and len(same) == len(rows)
    assert line_dedup.dedup_lines(df.where("doc_id < 0")).count() == 0


def test_lines_of_very_long_texts(spark):
    long = "\n".join(f"line {n}" for n in range(40_000))
    rows = [(i, long + f"\nown {i}" if i in (2, 5) else "line 77\nline 78", "en", f"s{i}", 0) for i in range(8)]
    out = {r.doc_id: r for r in line_dedup.dedup_lines(spark.createDataFrame(rows, DOCS), min_sites=8).collect()}
    assert out[0].n_removed == 0 and out[1].text == ""
    assert out[5].n_lines == 40_001 and out[5].n_removed == 2 and out[5].text == out[2].text.replace("own 2", "own 5")
    assert out[5].text == "\n".join(f"line {n}" for n in range(40_000) if n not in (77, 78)) + "\nown 5"


def test_a_passage_on_few_sites_beside_a_hot_one(spark):
    passage, copied = "this passage stands in a few documents only", "a line of ordinary copies"
    rows = [(i, f"own line {i}\n{passage}", "en", "hot" if i < 4 else f"s{i}", 0) for i in range(12)]
    rows += [(100 + i, f"hot line {i}", "en", "hot", 0) for i in range(60)]
    rows += [(200 + i, f"one more {i}\n{copied}", "en", f"s{i}", 0) for i in range(4)]
    out = {r.doc_id: r.text for r in queries.without_boilerplate(spark.createDataFrame(rows, DOCS)).collect()}
    assert len(out) == len(rows) and [d for d, t in out.items() if passage in t] == [0]
    assert sum(copied in t for t in out.values()) == 4


# 8: simhash


def fingerprint(text, words=3):
    parts = (text or "").encode().lower().split()
    shingles = [b" ".join(parts[i : i + words]) for i in range(max(1, len(parts) - words + 1))] if parts else []
    votes = [sum(xxhash.xxh64_intdigest(s, 42) >> b & 1 for s in shingles) for b in range(64)]
    return sum(1 << b for b in range(64) if votes[b] * 2 > len(shingles))


def groups(links, n):
    root = list(range(n))

    def find(i):
        while root[i] != i:
            i = root[i]
        return i

    for i, j in links:
        a, b = find(i), find(j)
        root[max(a, b)] = min(a, b)
    return [find(i) for i in range(n)]


def test_components_against_brute_force(spark):
    docs = spark.read.parquet("/root/testdata/sf0.01/documents.parquet").select("doc_id", "text").unionByName(odd_docs(spark).where("doc_id IS NOT NULL").select((F.col("doc_id") + 5000).alias("doc_id"), "text"))
    got = simhash.near_duplicates(docs, words=3, bits=64, budget=2).collect()
    rows = docs.collect()
    own = [fingerprint(r.text) for r in rows]
    a = np.array(own, np.uint64)
    links = [(i, int(j)) for i in range(len(a)) for j in np.flatnonzero(np.bitwise_count(a ^ a[i]) <= 2) if j > i]
    root = groups(links, len(a))
    least = defaultdict(lambda: 1 << 60)
    for r, g in zip(rows, root, strict=True):
        least[g] = min(least[g], r.doc_id)
    want = sorted((r.doc_id, f"{f:016x}", least[g]) for r, f, g in zip(rows, own, root, strict=True))
    assert sorted((r.doc_id, bytes(r.fingerprint).hex(), r.component_id) for r in got) == want


@pytest.mark.parametrize("budget", [0, 2, 5])
def test_trie_finds_every_pair(budget, monkeypatch):
    rng = np.random.default_rng(1)
    base = rng.integers(0, 256, (40, 8), dtype=np.uint8)
    near = np.repeat(base, 6, 0)
    flips = rng.random(near.shape) < 0.2
    near[flips] ^= (1 << rng.integers(0, 8, int(flips.sum()))).astype(np.uint8)
    prints = np.unique(near, axis=0)
    group = np.sort(rng.integers(0, 3, len(prints)))
    order = np.lexsort((*prints.T[::-1], group))
    prints, group = np.ascontiguousarray(prints[order]), group[order]
    bits = np.unpackbits(prints, axis=1)
    links = [(i, j) for i in range(len(prints)) for j in range(i + 1, len(prints)) if group[i] == group[j] and (bits[i] != bits[j]).sum() <= budget]
    for leaf, piece in ((32, 1 << 14), (1, 16)):
        monkeypatch.setattr(simhash, "LEAF", leaf)
        monkeypatch.setattr(simhash, "SLICE", piece)
        assert simhash.trie_components(prints, group, budget, most=500).tolist() == groups(links, len(prints))
    # equal fingerprints reach the last bit together
    twice = np.repeat(prints, 9, 0)
    assert simhash.trie_components(twice, np.repeat(group, 9), budget).tolist() == [9 * r for r in groups(links, len(prints)) for _ in range(9)]


def test_thousands_of_near_copies_stay_cheap():
    rng = np.random.default_rng(8)
    flips = np.packbits(rng.random((5000, 256)) < 0.01, axis=1)
    near = np.frombuffer(rng.bytes(32), np.uint8) ^ flips
    other = rng.integers(0, 256, (4000, 32), dtype=np.uint8)
    prints = np.concatenate([near, other])
    order = np.lexsort(prints.T[::-1])
    prints, is_near = np.ascontiguousarray(prints[order]), order < 5000
    tracemalloc.start()
    began = time.process_time()
    root = simhash.trie_components(prints, np.zeros(9000, np.int64), 64)
    took, (_, peak) = time.process_time() - began, tracemalloc.get_traced_memory()
    tracemalloc.stop()
    assert len(set(root[is_near].tolist())) == 1 and len(set(root[~is_near].tolist())) == 4000
    assert peak < 200 << 20 and took < 60


def test_large_groups_are_compared_in_blocks(spark, monkeypatch):
    monkeypatch.setattr(simhash, "BLOCK", 8)
    rng = np.random.default_rng(4)
    center = int(rng.integers(1 << 62))
    prints = sorted({center ^ (1 << int(a)) ^ (1 << int(b)) for a, b in rng.integers(0, 20, (60, 2))})
    df = spark.createDataFrame([(p.to_bytes(8, "big"),) for p in prints], "fingerprint binary").withColumn("id", F.col("fingerprint"))
    edges = components.connected_components(simhash.linked(simhash.section_nodes(df, 64, 2), 2)).collect()
    a = np.array(prints, np.uint64)
    root = groups([(i, j) for i in range(len(a)) for j in range(i + 1, len(a)) if int(a[i] ^ a[j]).bit_count() <= 2], len(a))
    want = {prints[i]: prints[r] for i, r in enumerate(root) if root.count(r) > 1}
    assert {int.from_bytes(r.node, "big"): int.from_bytes(r.root, "big") for r in edges} == want


def test_components_of_paths_and_stars(spark):
    edges = [(i, i + 1) for i in range(40)] + [(100, i) for i in range(101, 160)] + [(7, 7), (200, 201), (201, 200), (None, 3)]
    got = {r.node: r.root for r in components.connected_components(spark.createDataFrame(edges, "a long, b long")).collect()}
    assert got == {i: 0 for i in range(41)} | {i: 100 for i in range(100, 160)} | {200: 200, 201: 200}


def test_near_copies_are_found_and_others_left(spark):
    rng = np.random.default_rng(6)
    words = ["w" + str(x) for x in range(3000)]
    rows, n = [], 0
    for g in range(60):
        text = [str(x) for x in rng.choice(words, 200)]
        rows.append((n, g, " ".join(text)))
        if g % 2:
            for _ in range(2):
                copy = list(text)
                copy[int(rng.integers(200))] = "changed"
                n += 1
                rows.append((n, g, " ".join(copy)))
        n += 1
    df = spark.createDataFrame(rows, "doc_id long, g long, text string")
    out = simhash.similar_duplicates(df).collect()
    first = {}
    for r in sorted(out, key=lambda r: r.doc_id):
        first.setdefault(r.g, r.doc_id)
    assert all(r.component_id == first[r.g] for r in out)


def test_near_copies_of_very_long_texts(spark):
    rng = np.random.default_rng(12)
    text = [str(x) for x in rng.integers(0, 10**6, 60_000)]
    changed = [*text[:30_000], "changed", *text[30_001:]]
    rows = [(1, " ".join(text)), (2, " ".join(changed)), (3, " ".join(text[:5_000])), (4, "w" * 2_000_000)]
    df = spark.createDataFrame(rows, "doc_id long, text string")
    assert {r.doc_id: r.component_id for r in simhash.similar_duplicates(df).collect()} == {1: 1, 2: 1, 3: 3, 4: 4}
    got = {r.doc_id: int.from_bytes(r.fingerprint, "big") for r in simhash.near_duplicates(df, words=3).collect()}
    assert got == {i: fingerprint(t) for i, t in rows}


def overlapping(rng, n, least):
    """Two texts of n words each: their ends differ so that the five-word similarity is just as asked, or a step over."""
    words = ["w" + str(x) for x in rng.integers(0, 10**9, 2 * n)]
    for k in range(n, 0, -1):
        shared = n - 4 - k
        if shared / (n - 4 + k) >= least:
            return " ".join(words[:n]), " ".join(words[: n - k] + words[n : n + k]), k
    raise AssertionError


def test_near_copies_at_the_threshold(spark):
    rng = np.random.default_rng(11)
    rows, below = [], 0
    for g in range(0, 400, 2):
        a, b, k = overlapping(rng, 184, 0.8)  # 160 of 200 shingles
        if g >= 200:  # one word more differs: under 0.8
            b = " ".join(b.split()[: 184 - k - 1] + ["other"] + b.split()[184 - k :])
            below += 1
        rows += [(g, a), (g + 1, b)]
    df = spark.createDataFrame(rows, "doc_id long, text string")
    got = {r.doc_id: r.component_id for r in simhash.similar_duplicates(df).collect()}
    joined = [got[g + 1] == g for g in range(0, 400, 2)]
    assert sum(joined[:100]) >= 97 and below == 100 and not any(joined[100:])
    kept = {r.doc_id for r in queries.one_of_each_group(df).collect()}
    assert kept == {d for d, c in got.items() if d == c}


@pytest.mark.parametrize(("block", "held"), [(4096, 1 << 19), (8, 300)])
def test_groups_lose_no_link(spark, monkeypatch, block, held):
    """Whole groups, and groups parted by further samples and dealt out as blocks."""
    monkeypatch.setattr(simhash, "BLOCK", block)
    monkeypatch.setattr(similarity, "BLOCK_SHINGLES", held)
    rng = np.random.default_rng(12)
    base = ["w" + str(x) for x in rng.integers(0, 10**9, 120)]
    texts = []
    for _ in range(60):
        own = list(base)
        for x in rng.integers(0, 120, int(rng.integers(1, 5))):
            own[x] = "c" + str(rng.integers(10**9))
        texts.append(" ".join(own))
    sets = [{tuple(t.split()[i : i + 5]) for i in range(116)} for t in texts]
    links = [(i, j) for i in range(60) for j in range(i + 1, 60) if len(sets[i] & sets[j]) / len(sets[i] | sets[j]) >= 0.8]
    root = groups(links, 60)
    assert len(set(root)) > 1
    df = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    got = {r.doc_id: r.component_id for r in simhash.similar_duplicates(df).collect()}
    assert [got[i] for i in range(60)] == root


def test_short_texts_at_the_threshold(spark):
    """Four shingles against five: votes tie often, so these differ in more bits."""
    rng = np.random.default_rng(13)
    rows = []
    for g in range(0, 600, 2):
        own = ["w" + str(x) for x in rng.integers(0, 10**9, 9)]
        rows += [(g, " ".join(own[:8])), (g + 1, " ".join(own))]
    got = {r.doc_id: r.component_id for r in simhash.similar_duplicates(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    assert sum(got[g + 1] == g for g in range(0, 600, 2)) >= 295


# 10: urls


@pytest.mark.parametrize(("most", "keys"), [(1 << 20, 1 << 20), (1 << 20, 500), (8, 500)])
def test_cascade_is_exact(spark, monkeypatch, most, keys):
    """One cascade, cascades in shards, and filters that travel to the rows."""
    monkeypatch.setattr(url_filter, "SHARD_KEYS", keys)
    monkeypatch.setattr(url_filter, "SHARD_ROWS", 400)
    rows = [(f"host{i}.example", i % 7 == 0) for i in range(3000)]
    universe = spark.createDataFrame(rows, "host string, listed boolean")
    hot = spark.createDataFrame([(None, 0), *((rows[7 * (i % 2)][0], i) for i in range(900))], "host string, n int")
    ask = universe.select("host", F.lit(-1).alias("n")).union(hot)
    got = url_filter.mark_listed(ask, "host", universe, most).collect()
    assert {r.host: r.listed for r in got} == dict(rows) | {None: False}
    assert sorted((r.host or "", r.n) for r in got) == sorted((r.host or "", r.n) for r in ask.collect())
    none = url_filter.mark_listed(ask, "host", universe.withColumn("listed", F.lit(False)), most)
    assert none.where("listed").count() == 0 and none.count() == 3901


def test_url_edges(spark):
    urls = ["https://A.ExAmple.org/es/x?q#f", "http://x.com/de/1", "http://xcom/de/1", "ftp://example.org/en/12", "no scheme", None, "https://example.org", "//x://com/fr/#a", "http://com/fr/", "https://b.net/de/"]
    df = spark.createDataFrame([(i, u, "h") for i, u in enumerate(urls)] + [(1, urls[1], "h")], "page_id long, url string, host string")
    out = {r.page_id: r for r in url_filter.judge(df, queries.URL_RULES).collect()}
    assert (out[0].host, out[0].path, out[0].rule, out[0].verdict) == ("a.example.org", "/es/x", "example.org/es/", "block")
    assert out[1].rule == "com/de/" and out[2].rule is None and out[3].rule == "example.org/en/1"
    assert (out[4].host, out[4].path, out[4].verdict) == ("", "", "allow") and out[5].host == ""
    assert out[6].rule is None and (out[7].host, out[7].rule) == ("com", "com/fr/") and out[8].verdict == "allow" and out[9].rule is None
    assert url_filter.judge(df.where("page_id < 0"), queries.URL_RULES).count() == 0


# the queries with SQL, and the pipeline


@pytest.mark.parametrize("name", sorted(queries.oracle_sql()))
def test_query_equals_sql(name, spark, data):
    con = duckdb.connect()
    for t in ("documents", "embeddings", "pages", "conversations"):
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM '{data}/{t}.parquet'")
    want = con.execute(queries.oracle_sql()[name])
    names = [c[0] for c in want.description]
    got = queries.queries()[name](spark, data).select(*names).collect()
    assert sorted(map(repr, (tuple(r) for r in got))) == sorted(map(repr, want.fetchall()))


def test_pipeline_against_brute_force(spark):
    import corpus_pipeline

    sf = "/root/testdata/sf0.01"
    docs = spark.read.parquet(f"{sf}/documents.parquet")
    steps = [docs]
    for _, stage in corpus_pipeline.STAGES[:3]:
        steps.append(stage(spark, steps[-1], sf).cache())
        assert steps[-1].schema.names == docs.schema.names
    labels = {r.doc_id: r.quality for r in spark.read.parquet(f"{sf}/labels.parquet").collect()}
    kept = {r.doc_id for r in steps[1].collect()}
    assert np.mean([i in kept for i, q in labels.items() if q == 1]) > 0.97 and np.mean([i in kept for i, q in labels.items() if q == 0]) < 0.15
    # lines: what stays is each keeper's, or on too few sites
    before = {r.doc_id: r for r in steps[1].collect()}
    sites, keeper = defaultdict(set), {}
    for i in sorted(before):
        for line in before[i].text.split("\n"):
            if line.strip(" "):
                sites[line.strip(" ")].add(before[i].source)
                keeper.setdefault(line.strip(" "), i)
    after = {r.doc_id: r.text for r in steps[2].collect()}
    for i, r in before.items():
        lines = [x for x in r.text.split("\n") if not x.strip(" ") or len(sites[x.strip(" ")]) < line_dedup.MIN_SITES or keeper[x.strip(" ")] == i]
        if len(lines) == len(r.text.split("\n")) or "".join(lines).strip(" "):
            assert after[i] == "\n".join(lines)
        else:
            assert i not in after
    # near-duplicates: five-word shingle sets of 0.8 or more never both stay, but for rare misses; loners all stay
    shingles = {i: {tuple(w[k : k + 5]) for k in range(max(1, len(w) - 4))} for i, t in after.items() for w in [t.encode().lower().split()]}
    by = defaultdict(list)
    for i, s in shingles.items():
        for x in s:
            by[x].append(i)
    shared = defaultdict(int)
    for ids in by.values():
        for a in range(len(ids)):
            for b in range(a + 1, len(ids)):
                shared[ids[a], ids[b]] += 1
    alike = {p: n / len(shingles[p[0]] | shingles[p[1]]) for p, n in shared.items()}
    left = {r.doc_id for r in steps[3].collect()}
    twins = [p for p, j in alike.items() if j >= 0.85]
    assert twins and sum(p[0] in left and p[1] in left for p in twins) <= 0.02 * len(twins)
    loners = set(after) - {i for p, j in alike.items() if j >= 0.6 for i in p}
    assert loners <= left
    rows = corpus_pipeline.STAGES[3][1](spark, steps[3], sf).collect()
    assert {r.doc_id for r in rows} == left
    held(rows, 2048)


def test_pipeline_stages_take_odd_rows(spark, tmp_path):
    import corpus_pipeline

    docs = odd_docs(spark)
    docs.write.parquet(f"{tmp_path}/documents.parquet")
    spark.createDataFrame([(3, 1, 0), (6, 0, 0)], "doc_id long, quality int, toxic int").write.parquet(f"{tmp_path}/labels.parquet")
    rows = corpus_pipeline.run(spark, str(tmp_path)).collect()
    assert {r.doc_id for r in rows} <= {r.doc_id for r in docs.collect()} and held(rows, 2048)
    kept = queries.one_of_each_group(docs.union(docs)).collect()
    # null and empty texts, and one that is white space, are one component; everything else is on its own
    assert sorted(r.text for r in kept if (r.text or "").split()) == sorted({t for t in [*ODD, "no id"] if (t or "").encode().split()})
    assert sum(not (r.text or "").split() for r in kept) == 1
