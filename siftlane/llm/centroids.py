"""Centroid clustering of integer vectors, with a vantage-point tree over the centroids.

Each round the driver builds a tree over the k centroids and broadcasts it (k vectors, whatever the table's size). Tasks search it best-first for every vector: the node with
the least lower bound is opened first, a node is pruned only if its bound exceeds the best distance (equal ones stay, since a tie goes to the smaller number), and the
distances that decide are exact integers. A task returns counts, sums and squared distances per centroid, at most k * (dimensions + 2) rows.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from siftlane.session import stored

#: Components up to this keep squared distances of up to 64 components inside 64 bits.
MOST_COMPONENT = 1 << 27
#: Centroids in a leaf; vectors that are searched at once; what float roots may be off, relatively.
LEAF, AT_ONCE, SLACK = 2, 4096, 1e-9
_COUNT, _INERTIA = -2, -1


@dataclass
class _Node:
    """A leaf names centroids; an inner node its vantage point and, per child, the node and the least and greatest distance of its points from there."""

    points: list[int]
    children: list[tuple[int, float, float]]


class VantageTree:
    """Nearest centroid by best-first branch and bound."""

    def __init__(self, centroids: list[list[int]]):
        self.points = np.array(centroids, np.int64)
        self.nodes: list[_Node] = []
        if len(centroids):
            self._grow(list(range(len(centroids))))

    def _grow(self, some: list[int]) -> int:
        at = len(self.nodes)
        self.nodes.append(_Node(some, []))
        if len(some) > LEAF:
            vantage, rest = some[0], np.array(some[1:])
            away = np.sqrt(self.distances(self.points[rest], vantage).astype(float))
            order = np.argsort(away, kind="stable")
            halves = [h for h in np.array_split(order, 2) if len(h)]
            self.nodes[at] = _Node([vantage], [(self._grow(sorted(rest[h].tolist())), float(away[h[0]]), float(away[h[-1]])) for h in halves])
        return at

    def distances(self, vectors: np.ndarray, centroid: int) -> np.ndarray:
        """Exact squared distances."""
        gap = vectors - self.points[centroid]
        return np.einsum("ij,ij->i", gap, gap)

    def nearest(self, vectors: np.ndarray) -> tuple[np.ndarray, np.ndarray, int]:
        """For each vector (int64) the number of the nearest centroid, the smaller of ties, and the squared distance; and how many distances were computed."""
        n, opened = len(vectors), 0
        best, number = np.full(n, np.iinfo(np.int64).max), np.full(n, len(self.points))
        bounds = np.full((n, len(self.nodes)), np.inf)
        bounds[:, 0] = 0.0
        searching = np.arange(n)
        while len(searching):
            node = bounds[searching].argmin(axis=1)
            low = bounds[searching, node]
            going = low <= np.sqrt(best[searching].astype(float)) * (1 + SLACK)
            searching, node, low = searching[going], node[going], low[going]
            bounds[searching, node] = np.inf
            for which in np.unique(node).tolist():
                rows, least = searching[node == which], low[node == which]
                for point in self.nodes[which].points:
                    d = self.distances(vectors[rows], point)
                    opened += len(rows)
                    better = (d < best[rows]) | ((d == best[rows]) & (point < number[rows]))
                    best[rows[better]], number[rows[better]] = d[better], point
                away = np.sqrt(d.astype(float))
                for child, inner, outer in self.nodes[which].children:
                    off = SLACK * (away + outer)
                    bounds[rows, child] = np.maximum(least, np.maximum(away - outer, inner - away) - off)
        return number, best, opened


def integer_vectors(rows: DataFrame, dimensions: int, scale: int) -> DataFrame:
    """id and q (integers floor(scale * x), x as double) of the vectors with that many components, none null or non-finite."""
    def whole(x: Column) -> Column:
        q = F.floor(x.cast("double") * scale)
        return F.when(F.abs(q) <= MOST_COMPONENT, q).otherwise(F.raise_error(F.lit(f"a component beyond +-{MOST_COMPONENT} after scaling")).cast("long")).cast("int")

    def usable(x: Column) -> Column:
        return F.coalesce(~F.isnan(x.cast("double")) & (F.abs(x.cast("double")) < float("inf")), F.lit(False))

    kept = rows.where((F.size("vec") == dimensions) & F.forall("vec", usable))
    return kept.select(F.col("id").cast("long").alias("id"), F.transform("vec", whole).alias("q"))


def _matrix(column: pa.Array, dimensions: int) -> np.ndarray:
    return column.flatten().to_numpy(zero_copy_only=False).astype(np.int64).reshape(-1, dimensions)


def _round(spark: SparkSession, vectors: DataFrame, centroids: list[list[int]]) -> list[dict[int, int]]:
    """Per centroid its number of vectors, the sum of their squared distances and the sums of their components, by key."""
    k, dimensions = len(centroids), len(centroids[0])
    tree = spark.sparkContext.broadcast(VantageTree(centroids))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        told = np.zeros((k, dimensions + 2), np.int64)
        for batch in batches:
            every = _matrix(batch.column(0), dimensions)
            for i in range(0, len(every), AT_ONCE):
                some = every[i:i + AT_ONCE]
                number, distance, _ = tree.value.nearest(some)
                for c in np.unique(number).tolist():
                    mine = number == c
                    told[c] += np.r_[mine.sum(), distance[mine].sum(), some[mine].sum(axis=0)]
        c, key = np.nonzero(told)
        yield pa.RecordBatch.from_arrays([pa.array(c), pa.array(key - 2), pa.array(told[c, key])], ["c", "key", "n"])

    parts = vectors.select("q").mapInArrow(run, "c long, key long, n long")
    found: list[dict[int, int]] = [{} for _ in range(k)]
    for r in parts.groupBy("c", "key").agg(F.sum(F.col("n").cast("decimal(38,0)")).alias("n")).collect():  # k * (dimensions + 2) rows at most
        found[r.c][r.key] = int(r.n)
    tree.unpersist()
    return found


def centroid_clusters(rows: DataFrame, k: int = 8, rounds: int = 10, dimensions: int = 64, scale: int = 1024, seed: str = "3:") -> DataFrame:
    """Cluster the vectors ``vec`` of rows (id, vec): id, cluster, distance (squared), cluster_inertia, inertia, centroid_sha256.

    Vectors that are null, of another length, or hold a null or a non-finite component take no part; the others become integers floor(scale * x). The first centroids
    are the k vectors with the smallest sha256 of ``seed`` and id (rows that share an id: the smaller vector first; null ids last), fewer if there are fewer vectors.
    Each of ``rounds`` rounds assigns every vector to the nearest centroid (ties: smaller number) and replaces each centroid that has vectors by the
    componentwise floor of their mean; then vectors are assigned once more. Repeated rows count as often as they occur; null ids are kept. Other columns are ignored; an
    empty table gives no rows. Components beyond +-2^27 after scaling, or more than 64 dimensions, would leave 64 bits and end in an error.
    """
    if dimensions > 64 or k < 1:
        raise ValueError("64 dimensions at most, one cluster at least")
    spark = rows.sparkSession
    vectors = stored(integer_vectors(rows, dimensions, scale), "vectors")
    digest = F.sha2(F.concat(F.lit(seed), F.col("id").cast("string")), 256)
    centroids = [list(r.q) for r in vectors.orderBy(digest.asc_nulls_last(), "q").limit(k).collect()]
    schema = "id long, cluster int, distance long, cluster_inertia long, inertia long, centroid_sha256 string"
    if not centroids:
        return spark.createDataFrame([], schema)
    for _ in range(rounds):
        centroids = [[t.get(i, 0) // t[_COUNT] for i in range(dimensions)] if _COUNT in t else c for t, c in zip(_round(spark, vectors, centroids), centroids)]
    inertia = np.array([t.get(_INERTIA, 0) for t in _round(spark, vectors, centroids)], np.int64)
    digests = np.array([hashlib.sha256(",".join(map(str, c)).encode()).hexdigest() for c in centroids], object)
    tree = spark.sparkContext.broadcast(VantageTree(centroids))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            every = _matrix(batch.column(1), dimensions)
            for i in range(0, len(every), AT_ONCE):
                number, distance, _ = tree.value.nearest(every[i:i + AT_ONCE])
                yield pa.RecordBatch.from_arrays([
                    batch.column(0).slice(i, AT_ONCE), pa.array(number.astype(np.int32)), pa.array(distance), pa.array(inertia[number]),
                    pa.array(np.full(len(number), inertia.sum())), pa.array(digests[number], pa.string())],
                    ["id", "cluster", "distance", "cluster_inertia", "inertia", "centroid_sha256"])

    return vectors.mapInArrow(run, schema)
