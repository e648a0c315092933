"""Blocked windows equal plain windows, whatever the keys, gaps and block size."""

import random

import pytest
from pyspark.sql import Window
from pyspark.sql import functions as F

from siftlane.operators import ordered as O


def table(spark, seed, n=400, spread=3000):
    rng = random.Random(seed)
    spots = [(None if k == 3 else f"k{k}", p) for k in range(4) for p in rng.sample(range(-spread, spread), n // 4)]
    hot = [("hot", p) for p in range(n)]
    rows = [(k, p, rng.choice(["a", "b", None])) for k, p in spots + hot]
    return spark.createDataFrame(rows, "k string, p long, v string").cache()


@pytest.mark.parametrize("seed,block", [(1, 1 << 16), (2, 50), (3, 7), (4, 1), (5, 20)])
def test_blocked_equals_plain(spark, seed, block):
    df = table(spark, seed)
    window = Window.partitionBy("k").orderBy("p")
    plain = df.select(
        "k", "p", F.last("v", ignorenulls=True).over(window.rowsBetween(Window.unboundedPreceding, -1)).alias("prev"),
        F.row_number().over(window).cast("long").alias("n"))
    got = O.with_index(O.asof_last(df, ["k"], "p", "v", "prev", block=block), ["k"], "p", "n", 1, block=block)
    key = lambda r: (r[0] or "", r[1])
    assert sorted(map(tuple, got.select("k", "p", "prev", "n").collect()), key=key) == sorted(map(tuple, plain.collect()), key=key)


@pytest.mark.parametrize("block", [1 << 16, 4, 1])
def test_changed_only_keeps_every_change(spark, block):
    states = ["A", "A", "B", "A", "A", "C", "C", "A"]
    df = spark.createDataFrame([("x", i * 3, s) for i, s in enumerate(states)], "k string, p long, v string")
    assert [r.v for r in O.changed_only(df, ["k"], "p", "v", block=block).orderBy("p").collect()] == ["A", "B", "A", "C", "A"]


def test_first_n_is_limited_before_the_shuffle(spark):
    df = spark.range(0, 1000, 1, 4).withColumn("k", F.expr("id div 100000"))
    kept = O.first_n(df, ["k"], ["id"], 3, rank="r")
    assert [r.id for r in kept.orderBy("r").collect()] == [0, 1, 2]
    plan = kept._jdf.queryExecution().executedPlan().toString()
    assert plan.count("WindowGroupLimit") == 2


@pytest.mark.parametrize("scale, shift", [(1, 0), (1_000_000, -(10**15)), (7, -20_000)])
def test_a_hot_key_is_cut_evenly(spark, scale, shift):
    """One key has nine rows in ten, at microsecond or negative positions: no task's share of it passes the bound, and the results are the plain window's."""
    rng = random.Random(3)
    rows = [("hot", shift + scale * i + rng.randrange(scale), rng.choice(["a", "b", None])) for i in range(9000)]
    rows += [(f"k{i % 50}", i - 500, rng.choice(["a", None])) for i in range(1000)]
    df = spark.createDataFrame(rows, "k string, p long, v string").cache()
    cuts = O.cuts_of_hot_keys(df, ["k"], "p", 600)
    assert [r["__key0"] for r in cuts.collect()] == ["hot"]
    shares = O._blocked(df, cuts, ["k"], "p").groupBy("k", "__block").count().collect()
    assert max(r["count"] for r in shares) <= 600 and sum(r["count"] for r in shares) == 10000
    window = Window.partitionBy("k").orderBy("p")
    plain = df.withColumn("prev", F.last("v", ignorenulls=True).over(window.rowsBetween(Window.unboundedPreceding, -1))).withColumn("n", F.row_number().over(window).cast("long"))
    got = O.with_index(O.asof_last(df, ["k"], "p", "v", "prev", block=600), ["k"], "p", "n", 1, block=600)
    key = lambda r: r[:2]
    assert sorted(map(tuple, got.select(plain.columns).collect()), key=key) == sorted(map(tuple, plain.collect()), key=key)


def test_rows_of_one_position_stay_together(spark):
    """Positions that hardly differ give few cuts; ties order the rows across them."""
    df = spark.range(3000).select(F.lit("x").alias("k"), (F.col("id") % 3).alias("p"), F.col("id").alias("t"), F.when(F.col("id") % 5 == 0, F.col("id")).alias("v"))
    window = Window.partitionBy("k").orderBy("p", "t").rowsBetween(Window.unboundedPreceding, -1)
    want = df.withColumn("o", F.last("v", ignorenulls=True).over(window))
    got = O.asof_last(df, ["k"], "p", "v", "o", ["t"], block=100)
    assert sorted(map(str, got.select(want.columns).collect())) == sorted(map(str, want.collect()))


def test_no_nested_loops_for_one_feed(spark):
    feed = spark.range(100).select(F.lit("all").alias("feed"), F.col("id").alias("p"), F.lit("x").alias("v"))
    for out in (O.changed_only(feed, ["feed"], "p", "v"), O.with_index(feed, ["feed"], "p", "n")):
        assert "NestedLoop" not in out._jdf.queryExecution().executedPlan().toString()


def test_short_keys_need_no_carry(spark):
    """Without a hot key there is only the plain window."""
    df = spark.createDataFrame([("a", 1, "x"), ("a", 2, None)], "k string, p long, v string")
    out = O.asof_last(df, ["k"], "p", "v", "prev")
    assert {r.p: r.prev for r in out.collect()} == {1: None, 2: "x"}
    final = out._jdf.queryExecution().executedPlan().toString().split("Initial Plan")[0]
    assert final.count("Window [") == 1
