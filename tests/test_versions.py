"""Versions of a name, and identifiers and their grounding: against plain Python or worked cases."""

import random
import re

import pytest
from pyspark.sql import functions as F

from lodestone.functions import text
from lodestone.functions.grounding import is_grounded, read_source
from lodestone.operators import versions

NOW = "2026-03-01T12:00:00Z"
ROWS = "name string, author string, updated string, uri string, rank int"


def resolved(spark, rows):
    df = spark.createDataFrame([(*r, 9) for r in rows], ROWS)
    return {r.uri: r.shadowed_by for r in versions.resolve(df, "me", "boss", F.to_timestamp(F.lit(NOW))).collect()}


def test_own_then_authority_then_newest_then_smallest_uri(spark):
    rows = [
        ("a", "x", "2026-02-01T00:00:00Z", "a1"), ("a", "boss", "2020-01-01T00:00:00Z", "a2"), ("a", "me", None, "a3"),
        ("b", "x", "2026-02-01T00:00:00Z", "b1"), ("b", "boss", "never", "b2"),
        ("c", "x", "2026-02-01T01:00:00+02:00", "c1"), ("c", "y", "2026-01-31T23:30:00Z", "c2"), ("c", None, "2026-01-31T23:30:00.000Z", "c3"),
    ]
    got = resolved(spark, rows)
    assert got == {"a1": "a3", "a2": "a3", "a3": None, "b1": "b2", "b2": None, "c1": "c2", "c2": None, "c3": "c2"}


def test_times_ahead_or_unreadable_are_the_oldest(spark):
    late, ahead = "2026-03-01T13:00:00Z", "2026-03-01T13:00:00.001Z"
    bad = [ahead, "2999-01-01T00:00:00Z", "2026-02-30T00:00:00Z", "2026-02-01", "2026-02-01 00:00:00Z", "", None]
    for i, t in enumerate(bad):
        assert resolved(spark, [("n", "x", t, "a"), ("n", "y", "1999-01-01T00:00:00-08:00", "b")]) == {"a": "b", "b": None}, (i, t)
    assert resolved(spark, [("n", "x", late, "b"), ("n", "y", "2026-03-01T12:59:59Z", "a")]) == {"a": "b", "b": None}
    assert resolved(spark, [("n", "x", t, f"u{i}") for i, t in enumerate(bad)]) == {f"u{i}": "u0" if i else None for i in range(len(bad))}


def test_versions_without_a_name_and_repeated_ones(spark):
    assert resolved(spark, []) == {}
    assert resolved(spark, [(None, "me", NOW, "a"), ("n", "me", NOW, None)]) == {}
    df = spark.createDataFrame([("n", "x", NOW, "a", 1)] * 3 + [("n", "x", NOW, "b", 1)], ROWS)
    got = versions.resolve(df, "me", "boss", F.to_timestamp(F.lit(NOW)))
    assert got.columns == ["name", "uri", "shadowed_by"]
    assert sorted((r.uri, r.shadowed_by or "") for r in got.collect()) == [("a", ""), ("a", ""), ("a", ""), ("b", "a")]


def plain_identifiers(s):
    """The same rule a token at a time: marks off its ends, then its shape, else a flag."""
    out = []
    for raw in re.findall(r"[A-Za-z0-9_./:#@~-]+", s):
        core = re.sub(r"^[^A-Za-z0-9_~/#@]+|[^A-Za-z0-9_/]+$", "", raw)
        flag = re.sub(r"[^A-Za-z0-9_]+$", "", raw)
        if len(core) < 3:
            continue
        if any(c.isdigit() or c in "/_" for c in core) or re.search(r"[A-Za-z0-9_]\.[A-Za-z0-9_]|[a-z][A-Z]", core):
            out.append(core.lower())
        elif re.fullmatch(r"--?[A-Za-z][A-Za-z0-9_-]{2,}", flag):
            out.append(flag.lower())
    return list(dict.fromkeys(out))


def test_identifiers_equal_the_rule_token_by_token(spark):
    rng = random.Random(6)
    texts = ["".join(rng.choice("abZ1_./:#@~- \n-é,") for _ in range(rng.randint(0, 40))) for _ in range(1500)]
    texts += ["", "plain words only", "--update-input -x --no", "a.b a..b .ab. camelCase CAMEL x" + "y" * 50_000, "/" * 20_000, "-" * 20_000, "z" * 200_000 + "1"]
    df = spark.createDataFrame([(i, t) for i, t in enumerate(texts)] + [(-1, None)], "i int, t string")
    got = {r.i: r.x for r in df.select("i", text.identifiers(F.col("t")).alias("x")).collect()}
    assert got.pop(-1) is None
    for i, t in enumerate(texts):
        assert got[i] == plain_identifiers(t), t[:80]


@pytest.mark.parametrize(
    ("name", "source", "want"),
    [
        ("vfoo-1", "uses foo-1 now", True), ("vfoo-1", "uses vfoo-1", True), ("foo-1", "uses vfoo-1", False), ("#12", "see 12.", True), ("12", "see #12", True),
        ("v1.2", "at 1.2", True), ("1.2", "at v1.2", True), ("114152", "at 1141528", False), ("/etc/x", "in /etc/x,", True), ("/etc/x", "in a/etc/x", False),
        ("etc/x/", "in /etc/x", True), ("@who_1", "mail@who_1", False), ("@who_1", "to @who_1", True),
    ],
)
def test_grounding(name, source, want):
    assert is_grounded(name, read_source(source)) is want
