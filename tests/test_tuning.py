"""The tuning matrix against one plain ranking at a time."""

import itertools
import math

import numpy as np
import pytest

from lodestone.plans import evaluate, tuning


def plain(rows, idf, average, ideal, c, k=10):
    """One setting, one document after the other."""
    if not ideal > 0:
        return math.nan

    def leaf(tf, dl, w):
        return w * tf * (c["k1"] + 1) / (tf + c["k1"] * (1 - c["b"] + c["b"] * dl / average)) if tf else 0.0

    kw = {}
    for doc, tf, dl, _, _ in rows:
        total = 0.0
        for g in range(0, len(tf), 6):
            s = [leaf(tf[g + i], dl, idf[g + i]) for i in range(6)]
            total += max(s[0], c["stem"] * s[1], c["parts"] * (max(s[2], c["part_stem"] * s[3]) + max(s[4], c["part_stem"] * s[5])))
        kw[doc] = round(total, 6)
    sims = {r[0]: r[3] for r in rows}
    known = [s for s in sims.values() if s is not None]
    if c["alpha"] is None:
        near = sorted((d for d in sims if (sims[d] or 0) > 0), key=lambda d: (-sims[d], d))
        words = sorted((d for d in kw if kw[d] > 0), key=lambda d: (-kw[d], d))
        f = {d: round((1 / (61 + near.index(d)) if d in near else 0) + (1 / (61 + words.index(d)) if d in words else 0), 6) for d in kw}
    else:
        lo, hi, top = min(known, default=0), max(known, default=0), max(kw.values())
        f = {d: round((1 - c["alpha"]) * ((sims[d] - lo) / (hi - lo) if hi > lo and sims[d] is not None else 0) + c["alpha"] * (kw[d] / top if top > 0 else 0), 6) for d in kw}
    grade = {r[0]: r[4] for r in rows}
    order = sorted(f, key=lambda d: (-f[d], d))[:k]
    return sum((2 ** grade[d] - 1) / math.log2(n + 2) for n, d in enumerate(order)) / ideal


def made(seed, n=30):
    rng = np.random.default_rng(seed)
    rows = [(int(d), [float(x) for x in rng.integers(0, 4, 12) * (rng.random(12) < 0.4)], float(rng.integers(1, 50)), None if rng.random() < 0.3 else round(float(rng.normal()), 6), int(rng.integers(0, 3))) for d in rng.permutation(100)[:n]]
    rows[1] = (rows[1][0], [0.0] * 12, 5.0, 0.0, 1)
    return rows, [float(x) for x in rng.random(12) * 3], 20.0, 5.0


@pytest.mark.parametrize("seed", range(4))
def test_every_setting_equals_a_plain_ranking(seed):
    rows, idf, average, ideal = made(seed)
    grid = evaluate.grid()
    assert len(grid) == 576
    cols = list(zip(*rows, strict=True))
    sim = np.array([np.nan if s is None else s for s in cols[3]])
    got = tuning.ndcg_of_settings(np.array(cols[0]), np.array(cols[1]), np.array(cols[2]), sim, np.array(cols[4], float), np.array(idf), average, ideal, grid)
    for i in range(0, 576, 7):
        assert got[i] == pytest.approx(plain(rows, idf, average, ideal, grid[i]), abs=1e-9), grid[i]


def test_no_similarity_no_words_no_ideal():
    grid = [{"stem": 1.0, "parts": 0.3, "part_stem": 0.5, "k1": 1.2, "b": 0.4, "alpha": a} for a in (0.5, None)]
    one = lambda sim, ideal: tuning.ndcg_of_settings(np.array([3, 1, 2]), np.zeros((3, 6)), np.ones(3), np.array(sim), np.array([2.0, 0, 0]), np.ones(6), 1.0, ideal, grid)
    assert np.allclose(one([np.nan] * 3, 3.0), 3 / math.log2(4) / 3)  # by the smaller document
    assert np.allclose(one([0.9, 0.1, 0.1], 3.0), 1.0)
    assert np.isnan(one([0.9, 0.1, 0.1], 0.0)).all()


def test_queries_of_any_kind(spark):
    rows = [(q, *r) for q in (1, 2) for r in made(q, 12)[0]]
    idf = [1.0] * 12
    data = [(q, d, tf, dl, sim, g if q == 1 else None, idf, 20.0, 5.0 if q == 1 else None) for q, d, tf, dl, sim, g in rows]
    df = spark.createDataFrame(data, "query int, doc long, tf array<double>, dl double, sim double, grade int, idf array<double>, average double, ideal double")
    grid = evaluate.grid(stem=(1.0,), parts=(0.3,))
    got = tuning.tune(df, grid).collect()
    assert len(got) == 2 * len(grid) and all(r.ndcg is None for r in got if r["query"] == 2)
    mine = [(d, tf, dl, sim, g) for q, d, tf, dl, sim, g in rows if q == 1]
    for r in itertools.islice((r for r in got if r["query"] == 1), 0, None, 5):
        assert r.ndcg == pytest.approx(plain(mine, idf, 20.0, 5.0, grid[r.setting]), abs=1e-9)
    assert tuning.tune(df.limit(0), grid).count() == 0
