"""Snippets: windows of whole characters, ranges in bytes, the field of most matches, odd rows."""

import random

import pytest

from lodestone.functions.highlight import best_field, highlights, snippet, spans


def test_ranges_point_at_matches():
    rng = random.Random(4)
    words = ["alpha", "Beta", "gamma", "ÿÿé", "日本", "😀", "x", " ", "\n", "—"]
    for _ in range(400):
        text = " ".join(rng.choice(words) for _ in range(rng.randint(1, 80)))
        raw, terms = text.encode(), {b"alpha", b"beta"}
        found = spans(raw, terms)
        assert [raw[a:b].lower() for a, b in found] == [w.lower().encode() for w in text.split() if w.lower() in ("alpha", "beta")]
        if not found:
            continue
        said, ranges = snippet(raw, found, width=rng.choice([20, 50, 200]))
        assert ranges and all(said.encode()[a:b].lower() in terms for a, b in ranges)
        assert said.strip("…") in text and "�" not in said


def test_windows_begin_a_quarter_before_and_whole():
    raw = ("é" * 100 + " alpha " + "é" * 200).encode()
    said, ranges = snippet(raw, spans(raw, {b"alpha"}))
    assert said.startswith("…é") and said.endswith("é…") and len(said.encode()) in range(200, 210)
    assert said.encode()[slice(*ranges[0])] == b"alpha" and ranges[0][0] - len("…".encode()) in (50, 51)
    # a match that the window cuts is no range
    raw = b"alpha" + b" " * 193 + b"alpha"
    assert snippet(raw, spans(raw, {b"alpha"}))[1] == [(0, 5)]
    raw = b"  \n alpha"
    assert snippet(raw, spans(raw, {b"alpha"})) == ("alpha", [(0, 5)])


def test_the_field_of_most_matches():
    assert best_field("one alpha", ["alpha alpha", "alpha"], "alpha", {b"alpha"})[:3] == ("tag", 0, 2)
    assert best_field("alpha", ["alpha"], "alpha", {b"alpha"})[:3] == ("text", 0, 1)
    assert best_field(None, [None, "x", "Alpha"], "", {b"alpha"}) == ("tag", 2, 1, "Alpha", [(0, 5)])
    assert best_field("alphabet", None, None, {b"alpha"}) is None


@pytest.mark.parametrize("terms", [["alpha"], [], None, [None, ""]])
def test_rows_of_any_kind(spark, terms):
    rows = [(1, terms, "see alpha", ["t"], "s", "old"), (2, terms, None, None, None, "old"), (3, terms, "", [], "alpha", "old"), (1, terms, "see alpha", ["t"], "s", "old")]
    df = spark.createDataFrame(rows, "id long, terms array<string>, text string, tags array<string>, source string, snippet string")
    got = highlights(df).orderBy("id").collect()
    assert got[0].asDict().keys() == {"id", "field", "tag", "matches", "snippet", "highlights"}
    if terms == ["alpha"]:
        assert [r.snippet for r in got] == ["see alpha", "see alpha", None, "alpha"] and [tuple(h) for h in got[0].highlights] == [(4, 9)] and got[3].field == "source"
    else:
        assert all(r.snippet is None and r.highlights is None for r in got)
    assert highlights(df.limit(0)).count() == 0
