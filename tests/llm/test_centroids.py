"""Centroid clustering against a plain version with Python integers; the tree against all distances."""

import hashlib
import math

import numpy as np
import pytest
from pyspark.sql import functions as F

from siftlane.llm.centroids import VantageTree, centroid_clusters

SCHEMA = "id long, vec array<float>"


def plain_clusters(rows, k, rounds, dimensions, scale):
    kept = [(i, [math.floor(x * scale) for x in v]) for i, v in rows
            if v is not None and len(v) == dimensions and all(x is not None and math.isfinite(x) for x in v)]
    digest = lambda i: hashlib.sha256(f"3:{i}".encode()).hexdigest()
    centroids = [q for _, q in sorted(kept, key=lambda r: (r[0] is None, "" if r[0] is None else digest(r[0]), r[1]))[:k]]

    def nearest(q):
        return min((sum((a - b) ** 2 for a, b in zip(q, c)), n) for n, c in enumerate(centroids))

    for _ in range(rounds):
        groups = [[] for _ in centroids]
        for _, q in kept:
            groups[nearest(q)[1]].append(q)
        centroids = [[sum(x) // len(g) for x in zip(*g)] if g else c for g, c in zip(groups, centroids)]
    found = [(i, *nearest(q)) for i, q in kept]
    own = [sum(d for _, d, n in found if n == c) for c in range(len(centroids))]
    digests = [hashlib.sha256(",".join(map(str, c)).encode()).hexdigest() for c in centroids]
    return sorted(((i, n, d, own[n], sum(own), digests[n]) for i, d, n in found), key=str)


def told(df):
    return sorted((tuple(r) for r in df.collect()), key=str)


def vectors(seed, n, dimensions, step=0.25):
    rng = np.random.default_rng(seed)
    return [(i, (rng.integers(-8, 8, dimensions) * step).tolist()) for i in range(n)]


@pytest.mark.parametrize("n, k, dimensions", [(300, 8, 64), (200, 20, 3), (5, 8, 4), (1, 1, 1)])
def test_equals_plain_version(spark, n, k, dimensions):
    rows = vectors(n, n, dimensions)
    df = spark.createDataFrame(rows, SCHEMA).repartition(4)
    assert told(centroid_clusters(df, k, 4, dimensions, 16)) == plain_clusters(rows, k, 4, dimensions, 16)


def test_odd_rows(spark):
    rows = vectors(2, 60, 2) + [(7, [0.5, 0.5])] * 40 + [(None, [1.0, 2.0]), (None, [1.0, 2.0]), (100, None), (101, []), (102, [1.0]), (103, [1.0, None]),
                                                       (104, [float("nan"), 1.0]), (105, [float("inf"), 1.0]), (106, [-1e-30, 0.0])]
    df = spark.createDataFrame(rows, SCHEMA).repartition(3).withColumns({"cluster": F.lit("clash"), "q": F.lit(1)})
    assert told(centroid_clusters(df, 6, 3, 2, 16)) == plain_clusters(rows, 6, 3, 2, 16)
    empty = centroid_clusters(df.where("false"), 6, 3, 2, 16)
    assert empty.collect() == [] and empty.columns == ["id", "cluster", "distance", "cluster_inertia", "inertia", "centroid_sha256"]


def test_equal_centroids_and_ties(spark):
    """All vectors equal: every centroid is the same, all go to number 0, the others stay as they are."""
    rows = [(i, [1.0, -1.0]) for i in range(30)]
    got = told(centroid_clusters(spark.createDataFrame(rows, SCHEMA), 5, 3, 2, 8))
    assert got == plain_clusters(rows, 5, 3, 2, 8) and {r[1] for r in got} == {0}


@pytest.mark.parametrize("k, dimensions", [(1, 2), (2, 2), (7, 1), (64, 2), (300, 8)])
def test_tree_finds_the_nearest(k, dimensions):
    """Small grids, so that ties abound; in few dimensions most distances are not computed."""
    rng = np.random.default_rng(k)
    points, queries = rng.integers(-9, 9, (k, dimensions)), rng.integers(-12, 12, (500, dimensions))
    number, distance, computed = VantageTree(points.tolist()).nearest(queries.astype(np.int64))
    every = ((queries[:, None] - points[None]) ** 2).sum(axis=2)
    assert (number == every.argmin(axis=1)).all() and (distance == every.min(axis=1)).all()
    assert k < 50 or dimensions > 2 or computed < 0.4 * every.size


def test_large_components(spark):
    rows = [(i, [131071.0 * (-1) ** i, float(i)]) for i in range(9)]
    assert told(centroid_clusters(spark.createDataFrame(rows, SCHEMA), 3, 2, 2, 1024)) == plain_clusters(rows, 3, 2, 2, 1024)
    with pytest.raises(Exception, match="component beyond"):
        centroid_clusters(spark.createDataFrame([(1, [1e30, 0.0])], SCHEMA), 3, 2, 2, 1024).collect()
