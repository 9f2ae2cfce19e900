"""Model changes, resumed logs, counters and histograms: each against plain Python or worked figures."""

import math

import pytest
from pyspark.sql import functions as F

from lodestone.operators import lounge, model_change, observability

LOG = "space string, seq long, action string, name string, digest string, dims int, document_prefix string, query_prefix string"


def entry(space, seq, action, name=None, digest="d", dims=8, dp=None, qp=None):
    return (space, seq, action, name, digest, dims, dp, qp)


def test_a_model_change_from_declaration_to_promotion(spark):
    log = [
        entry("a", 1, "next", "m1"),
        entry("a", 2, "declare", "m1", dp="x: "),
        entry("a", 3, "next", "m1"),
        entry("a", 4, "next", "m2"),
        entry("a", 5, "next", "m3"),
        entry("a", 6, "cancel"),
        entry("a", 7, "promote"),
        entry("a", 8, "next", "nomic-embed-text:v1.5"),
        entry("a", 9, "promote"),
        entry("a", 10, "declare", "m9", digest=None),
        entry("a", 11, "rename", "m9"),
        entry("a", 12, None),
        entry("a", 13, "declare", "m1"),
        entry("b", 1, "cancel"),
        entry("b", 2, "declare", "m1", dims=0),
        entry(None, 3, "declare", "m1"),
    ]
    got = {(r.space, r.seq): r for r in model_change.fold(spark.createDataFrame(log, LOG).repartition(4)).collect()}
    assert len(got) == 15
    a = [got["a", n] for n in range(1, 14)]
    assert [r.refusal for r in a] == ["no model", None, "same model", None, None, None, "no change in progress", None, None, "incomplete model", "unknown action", "unknown action", None]
    assert [r.resync for r in a] == [False, True, False, True, True, False, False, True, False, False, False, False, True]
    assert [r.active for r in a][1:] == ["m1@d/8"] * 7 + ["nomic-embed-text:v1.5@d/8"] * 4 + ["m1@d/8"]
    assert [r.building for r in a] == [None, None, None, "m2@d/8", "m3@d/8", None, None, "nomic-embed-text:v1.5@d/8", None, None, None, None, None]
    assert (a[1].document_prefix, a[1].query_prefix) == ("x: ", "") and (a[8].document_prefix, a[8].query_prefix) == ("search_document: ", "search_query: ")
    assert [got["b", n].refusal for n in (1, 2)] == ["no model", "incomplete model"]
    assert model_change.fold(spark.createDataFrame([], LOG)).count() == 0


def test_slots_fill_and_are_ready(spark):
    log = [entry("a", 1, "declare", "m1"), entry("a", 2, "next", "m2"), entry("b", 1, "declare", "m1"), entry("c", 1, "declare", "m1"), entry("c", 2, "next", "m3")]
    states = model_change.fold(spark.createDataFrame(log, LOG))
    m = spark.createDataFrame([("a", ["m1@d/8", "m2@d/8"]), ("a", ["m2@d/8"]), ("b", ["m1@d/8"]), ("b", None), ("c", ["m1@d/8"]), ("d", ["m1@d/8"])], "space string, held array<string>")
    got = {r.space: tuple(r)[1:] for r in model_change.slot_progress(states, m, F.col("held")).collect()}
    assert got == {"a": (2, 1, 2, True), "b": (2, 1, 0, False), "c": (1, 1, 0, False)}


def test_cursors_go_on_or_begin_again(spark):
    log = spark.createDataFrame([("s", n, [], f"e{n}") if n % 3 else ("s", n, ["u1"], f"e{n}") for n in range(1, 31)] + [("t", 1, None, "t1")], "space string, seq long, to array<string>, ref string")
    cursors = [(1, "s", "", "e1-27"), (2, "s", "u2", "e1-26"), (3, "s", "", "e1-30"), (4, "s", "", "e1-20"), (5, "s", "", "e1-19"), (6, "s", "", "e0-29"), (7, "s", "", "e1-31"), (8, "s", "", "e1-9x"), (9, "s", "u2", ""), (10, "s", None, None), (11, "t", "u1", "e1-0"), (12, "none", "", "e1-0"), (13, "none", "", "e1-5"), (14, "s", "", "nonsense"), (15, "s", "", "e1-99999999999999999999")]
    asked = spark.createDataFrame(cursors, "subscriber int, space string, me string, cursor string")
    presence = spark.createDataFrame([("s", "p1"), ("s", "p2")], "space string, ref string")
    messages = log.where("seq > 27").select("space", "to", "ref")
    rows = lounge.resume(log, asked, presence, messages, "e1", keep=10).collect()
    of = lambda s: sorted((r.kind, r.ref or "", r.seq or 0) for r in rows if r.subscriber == s and r.kind != "ready")
    event = lambda *ns: sorted(("event", f"e{n}", n) for n in ns)
    whole = [("message", f"e{n}", 0) for n in (28, 29, 30)] + [("presence", "p1", 0), ("presence", "p2", 0)]
    assert of(1) == event(28, 29, 30) and of(2) == event(28, 29) and of(3) == [] and of(4) == event(*range(21, 31))
    assert of(5) == of(6) == of(7) == of(8) == of(10) == of(14) == of(15) == whole
    assert of(9) == [w for w in whole if w[1] != "e30"] and of(11) == [("event", "t1", 1)] and of(12) == of(13) == []
    ready = {r.subscriber: r for r in rows if r.kind == "ready"}
    assert len(ready) == 15 and ready[1].cursor == "e1-30" and ready[12].cursor == "e1-0" and ready[11].cursor == "e1-1"
    assert [s for s in ready if ready[s].reset] == [5, 6, 7, 8, 13, 14, 15] or {s for s in ready if ready[s].reset} == {5, 6, 7, 8, 13, 14, 15}


def test_increase_over_resets_and_edges(spark):
    rows = [("a", t, v) for t, v in [(10, 5.0), (20, 8.0), (30, 2.0), (40, 2.0), (50, 6.0), (60, 9.0)]] + [("a", 60, 7.0), ("a", None, 1.0), ("a", 65, None)]
    rows += [("once", 10, 3.0), ("flat", 5, 2.0), ("flat", 55, 2.0), ("new", 30, 1.0), ("new", 40, 21.0), (None, 70, 0.0), (None, 80, 4.0)]
    got = {(r.s, r.end): (r.n, r.increase) for r in observability.increase(spark.createDataFrame(rows, "s string, at long, v double"), ["s"], "at", "v", 60).collect()}
    # seen 3 + 2 + 0 + 4 + 3 in 50 seconds; ten seconds before the first sample are within 1.1 of the mean distance
    assert got["a", 60] == (6, pytest.approx(12 * 60 / 50))
    assert got["flat", 60] == (2, 0.0) and ("once", 60) not in got
    # the counter was at zero half a second before its first sample; the end lies 2 distances off
    assert got["new", 60] == (2, pytest.approx(20 * (10 + 0.5 + 5) / 10))
    assert got[None, 120][0] == 2
    assert observability.increase(spark.createDataFrame([], "s string, at long, v double"), ["s"], "at", "v", 60).count() == 0


def test_quantiles_out_of_buckets(spark):
    inf = float("inf")
    rows = [("a", 1.0, 2), ("a", 2.0, 6), ("a", 4.0, 8), ("a", inf, 10), ("b", 1.0, 0), ("b", inf, 0), ("c", inf, 4), ("d", 1.0, 3), ("d", 2.0, 3), ("e", -1.0, 5), ("e", inf, 5), ("f", 1.0, 4), ("f", 2.0, 3), ("f", inf, 8), ("a", None, 5), ("g", 1.0, 1), ("g", 1.0, 1), ("g", inf, 2)]
    found = observability.histogram_quantile(spark.createDataFrame(rows, "s string, le double, n long"), ["s"], [-0.5, 0.1, 0.5, 0.7, 0.95, 1.5])
    got = {(r.s, r.quantile): r.value for r in found.collect()}
    assert [got["a", q] for q in (0.1, 0.5, 0.7, 0.95)] == [0.5, 1.75, 3.0, 4.0]
    assert got["a", -0.5] == -inf and got["a", 1.5] == inf
    assert all(got[s, 0.5] is None for s in "bcd") and got["e", 0.5] == -1.0
    assert got["f", 0.5] == 1.0 and got["f", 0.7] == 2.0 and got["g", 0.5] == 0.5
    assert not any(v is not None and math.isnan(v) for v in got.values())


def test_pairs_of_one_key_come_from_many_tasks(spark):
    from pyspark.sql import functions as F

    from lodestone.operators import lounge

    a = spark.range(300).select(F.col("id").alias("a"), F.floor(F.col("id") / 1000).alias("space"))
    b = spark.range(200).select(F.col("id").alias("b"), F.floor(F.col("id") / 1000).alias("space"))
    got = lounge.paired(a, b, ["space"], "a", "b").select("a", "b", F.spark_partition_id().alias("p"))
    per = got.groupBy("p").count().collect()
    assert sum(r["count"] for r in per) == 60_000 == got.select("a", "b").distinct().count()
    assert len(per) > 20 and max(r["count"] for r in per) < 6_000


def test_presence_comes_in_handfuls(spark):
    """F2 of round 4: a subscriber got all references of a block before the next one did, so no page of a written result was like itself."""
    from pyspark.sql import Window

    log = spark.createDataFrame([("s", 1, None, "e1")], "space string, seq long, to array<string>, ref string")
    asked = spark.range(480).selectExpr("id AS subscriber", "'s' AS space", "'' AS me", "'' AS cursor")
    presence = spark.range(6400).selectExpr("'s' AS space", "concat('p/', id * 7919 % 100003) AS ref")
    pairs = lounge.resume(log, asked, presence, log.select("space", "to", "ref"), "e1").where("kind = 'presence'")
    at = pairs.select("subscriber", "ref", F.monotonically_increasing_id().alias("at"), F.spark_partition_id().alias("task")).localCheckpoint()
    assert at.select("subscriber", "ref").distinct().count() == 480 * 6400 == at.count()
    gap = F.col("at") - F.lag("at").over(Window.partitionBy("task", "ref").orderBy("at"))
    far, all_ = at.select(gap.alias("gap")).where("gap IS NOT NULL").agg(F.count_if(F.col("gap") > 256), F.count("*")).first()
    assert far < 0.1 * all_


def test_handfuls_hold_every_reference(spark):
    rows = [("s", f"p{i}") for i in range(1000)] + [("s", "p1"), ("s", None), ("t", None), ("t", "x")]
    got = lounge.handfuls(spark.createDataFrame(rows, "space string, ref string"), most=50).collect()
    assert sorted((r.space, x.ref or "") for r in got for x in r.refs) == sorted((s, ref or "") for s, ref in rows)
    assert max(len(r.refs) for r in got) == 50 and len({r.handful for r in got if r.space == "s"}) == sum(r.space == "s" for r in got)
