"""Exact top-k against brute force."""

import math

import numpy as np
from pyspark.sql import functions as F

from siftlane.llm.topk import top_k


def brute_top(rows, queries, k, scale=256):
    def usable(vec):
        return vec is not None and all(x is not None and math.isfinite(x) for x in vec)

    def whole(vec):
        return [math.floor(scale * x) for x in vec]

    out = []
    for q, v in queries:
        if q is None or not usable(v):
            continue
        found = sorted((-sum(a * b for a, b in zip(whole(v), whole(w))), i) for i, w in rows if i is not None and i != q and usable(w) and len(w) == len(v))
        out += [(q, n + 1, i, -s) for n, (s, i) in enumerate(found[:k])]
    return sorted(out)


def got(spark, rows, queries, k):
    schema = "id long, vec array<double>"
    out = top_k(spark.createDataFrame(rows, schema).repartition(5), spark.createDataFrame(queries, schema), k)
    assert dict(out.dtypes) == {"query_id": "bigint", "rank": "int", "vec_id": "bigint", "score": "bigint"}
    return sorted(map(tuple, out.collect()))


def test_random_with_ties(spark):
    rng = np.random.default_rng(3)
    rows = [(i, rng.integers(-2, 3, 6).astype(float).tolist()) for i in range(300)]
    rows += [(300 + i, [0.5] * 6) for i in range(200)]  # a third of all rows are one vector
    queries = [r for r in rows if r[0] % 25 == 0]
    assert got(spark, rows, queries, 5) == brute_top(rows, queries, 5)


def test_odd_vectors(spark):
    rows = [(1, [1.0, 2.0]), (2, None), (3, [1.0, None]), (4, [float("nan"), 1.0]), (5, [float("inf"), 1.0]), (None, [9.0, 9.0]), (6, [1.0, 2.0]),
            (7, [-1.5, 0.25]), (8, [1.0, 2.0, 3.0]), (9, []), (10, [])]
    queries = [(1, [1.0, 2.0]), (2, None), (8, [1.0, 2.0, 3.0]), (9, [])]
    assert got(spark, rows, queries, 3) == brute_top(rows, queries, 3)
    assert got(spark, rows, [], 3) == [] == got(spark, [], [(1, [1.0, 2.0])], 3)


def test_wide_scores_need_more_passes(spark):
    rows = [(i, [float(i) * 1e5, float(i % 7) * 1e4]) for i in range(60)]
    assert got(spark, rows, rows[:4], 4) == brute_top(rows, rows[:4], 4)


def test_repeated_query_counts_once(spark):
    rows = [(1, [1.0]), (2, [2.0]), (3, [3.0])]
    out = got(spark, rows, [(1, [1.0]), (1, [1.0])], 2)
    assert out == [(1, 1, 3, 256 * 768), (1, 2, 2, 256 * 512)]


def test_many_blocks_in_many_partitions(spark, monkeypatch):
    """Blocks and groups meet also where Spark does not put small partitions together."""
    from siftlane.llm import topk
    monkeypatch.setattr(topk, "QUERIES_PER_BLOCK", 4)
    monkeypatch.setattr(topk, "BLOCKS_PER_GROUP", 1)
    rng = np.random.default_rng(4)
    rows = [(i, rng.integers(-9, 9, 5).astype(float).tolist()) for i in range(120)]
    queries = [r for r in rows if r[0] % 3 == 0]
    spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "false")
    try:
        assert got(spark, rows, queries, 5) == brute_top(rows, queries, 5)
    finally:
        spark.conf.unset("spark.sql.adaptive.coalescePartitions.enabled")


def test_extra_columns_do_not_matter(spark):
    rows = spark.createDataFrame([(1, [1.0], 5), (2, [2.0], 6)], "id long, vec array<double>, block int").withColumn("dim", F.lit("x"))
    assert top_k(rows, rows, 1).count() == 2
