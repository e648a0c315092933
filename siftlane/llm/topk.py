"""Exact top-k search by distributed histogram selection.

Everything is scored, in blocks of candidates against blocks of queries. A pass counts, for each query, scores by bins; the counts of all blocks are added up and the
bin that holds the kth score is split further in the next pass, until a bin is one score wide. A last pass keeps scores that reach the kth and breaks ties by
the smaller id. A block counts only bins from its own kth score up, since the global kth cannot lie below it, and returns k rows a query at most.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from siftlane.llm import chunks as C
from siftlane.session import stored

#: Bins of a histogram pass; vectors in a block of queries, in a block of candidates, and candidate blocks that meet a query block in one group.
BINS, QUERIES_PER_BLOCK, ROWS_PER_BLOCK, BLOCKS_PER_GROUP = 4096, 512, 4096, 4
PACKED = "dim int, n int, largest double, ids binary, matrix binary"


def _usable(rows: DataFrame, scale: int) -> DataFrame:
    """id and vec: floor(scale * x) of every component, for rows with an id whose components all are finite numbers."""
    vec = F.transform("vec", lambda x: x.cast("double"))
    bad = F.exists("vec", lambda x: x.isNull() | F.isnan(x) | (F.abs(x) == float("inf")))
    return (rows.where("id is not null and vec is not null").withColumn("vec", vec).where(~bad)
            .select("id", F.transform("vec", lambda x: F.floor(x * scale).cast("long")).alias("vec")))


def _pack_row(pdf: pd.DataFrame, dim: int) -> dict:
    pdf = pdf.sort_values("id")
    matrix = np.array(pdf["vec"].tolist(), np.int64).reshape(len(pdf), dim)
    largest = float(np.sqrt((matrix.astype(np.float64) ** 2).sum(axis=1).max())) if len(pdf) else 0.0
    return {"dim": dim, "n": len(pdf), "largest": largest, "ids": pdf["id"].to_numpy(np.int64).tobytes(), "matrix": C.squeeze(matrix)}


def _packed(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    for pdf in batches:
        for dim, same in pdf.groupby(pdf["vec"].map(len)):
            yield pd.DataFrame([_pack_row(same.iloc[i:i + ROWS_PER_BLOCK], int(dim)) for i in range(0, len(same), ROWS_PER_BLOCK)])


def _scores(left: pd.DataFrame, right: pd.DataFrame) -> Iterator[tuple]:
    """Scores of every candidate block against the query block: (query rows, candidate ids, scores, taking part)."""
    dim = int(right["dim"].iloc[0])
    right = right.sort_values("query_id").reset_index(drop=True)
    queries = np.array(right["vec"].tolist(), np.int64).reshape(len(right), dim)
    own = right["query_id"].to_numpy(np.int64)
    for n, ids, matrix in zip(left["n"], left["ids"], left["matrix"]):
        ids = np.frombuffer(ids, np.int64)
        matrix = C.expand(matrix, np.int64).reshape(int(n), dim)
        exact = float(np.abs(matrix).max(initial=0)) * float(np.abs(queries).max(initial=0)) * max(dim, 1) < 2 ** 53
        scores = (queries.astype(np.float64) @ matrix.T.astype(np.float64)).astype(np.int64) if exact else queries @ matrix.T
        yield right, ids, scores, ids[None, :] != own[:, None]


def _kth(scores: np.ndarray, part: np.ndarray, k: int) -> np.ndarray:
    """The kth highest score of each row among those that take part; the least number where there are fewer."""
    least = np.iinfo(np.int64).min
    held = np.where(part, scores, least)
    if held.shape[1] < k:
        return np.full(len(held), least)
    return np.partition(held, held.shape[1] - k, axis=1)[:, held.shape[1] - k]


def _count(left: pd.DataFrame, right: pd.DataFrame, k: int) -> pd.DataFrame:
    out = []
    for rows, _, scores, part in _scores(left, right):
        low, width = rows["low"].to_numpy(np.int64), rows["width"].to_numpy(np.int64)
        floor = np.maximum(low, _kth(scores, part, k))
        floor = low + (floor - low) // width * width
        q, c = np.nonzero(part & (scores >= floor[:, None]))
        bins = np.minimum((scores[q, c] - low[q]) // width[q], BINS)
        cell, times = np.unique(q * (BINS + 1) + bins, return_counts=True)
        out.append(pd.DataFrame({"query_id": rows["query_id"].to_numpy()[cell // (BINS + 1)], "bin": cell % (BINS + 1), "n": times}))
    return pd.concat(out)


def _select(left: pd.DataFrame, right: pd.DataFrame, k: int) -> pd.DataFrame:
    out = []
    for rows, ids, scores, part in _scores(left, right):
        floor = np.maximum(rows["low"].to_numpy(np.int64), _kth(scores, part, k))
        q, c = np.nonzero(part & (scores >= floor[:, None]))
        order = np.lexsort((ids[c], -scores[q, c], q))
        q, c = q[order], c[order]
        begin = np.r_[0, np.flatnonzero(np.diff(q)) + 1][:len(q)]
        place = np.arange(len(q)) - np.repeat(begin, np.diff(np.r_[begin, len(q)]))
        q, c = q[place < k], c[place < k]
        out.append(pd.DataFrame({"query_id": rows["query_id"].to_numpy()[q], "vec_id": ids[c], "score": scores[q, c]}))
    return pd.concat(out)


def top_k(rows: DataFrame, queries: DataFrame, k: int = 5, scale: int = 256) -> DataFrame:
    """The k candidates of highest integer inner product for every query: query_id, rank (int, from 1), vec_id, score.

    ``rows`` and ``queries`` have columns id (long) and vec (array of numbers); components become floor(scale * x), x as double. A candidate with the query's
    own id is left out; ties go to the smaller id, then repeated rows of one id follow each other. Fewer than k candidates are all returned. Rows with a
    null id, a null vector, or a null or non-finite component take no part; vectors meet only vectors of their length. A query id that repeats counts once,
    with its least vector. Empty tables give no rows. Scores must fit 64 bits.
    """
    asked = _usable(queries, scale).groupBy(F.col("id").alias("query_id")).agg(F.min("vec").alias("vec")).withColumn("dim", F.size("vec"))
    n_blocks = max(1, -(-asked.count() // QUERIES_PER_BLOCK))
    asked = stored(asked.withColumn("block", F.pmod(F.xxhash64("query_id"), F.lit(n_blocks)).cast("long")), "queries")
    packed = stored(_usable(rows, scale).mapInPandas(_packed, PACKED), "candidates")
    n_groups = max(1, -(-packed.count() // BLOCKS_PER_GROUP))

    def every(n: int) -> Column:
        # long like the other side's key: a cogroup deals both sides by the hash of the key, which depends on its type
        return F.explode(F.sequence(F.lit(0).cast("long"), F.lit(n - 1).cast("long")))

    packed = packed.withColumn("group", F.pmod(F.xxhash64("ids"), F.lit(n_groups)).cast("long")).withColumn("block", every(n_blocks))

    def meet(state: DataFrame, run, schema: str) -> DataFrame:
        spread = state.withColumn("group", every(n_groups))
        keys = ["dim", "group", "block"]
        nothing = {part.split()[0]: [] for part in schema.split(",")}
        return packed.groupBy(keys).cogroup(spread.groupBy(keys)).applyInPandas(
            lambda a, b: run(a, b, k) if len(a) and len(b) else pd.DataFrame(nothing), schema)

    longest = packed.groupBy("dim").agg(F.max("largest").alias("longest"))
    norm = F.sqrt(F.aggregate("vec", F.lit(0.0), lambda a, x: a + x.cast("double") * x.cast("double")))
    bound = F.ceil(norm * F.coalesce("longest", F.lit(0.0)) + 1).cast("long")
    state = asked.join(longest, "dim", "left").withColumn("low", -bound).withColumn("width", F.ceil((2 * bound + 1) / BINS).cast("long")).drop("longest")
    while True:
        state = stored(state, "state")
        counts = meet(state, _count, "query_id long, bin long, n long").groupBy("query_id", "bin").agg(F.sum("n").alias("n"))
        down = Window.partitionBy("query_id").orderBy(F.desc("bin"))
        reached = counts.withColumn("above", F.sum("n").over(down) - F.col("n"))
        kth = reached.where(F.col("above") < k).groupBy("query_id").agg(F.min("bin").alias("bin"))
        state = (state.join(kth, "query_id", "left").withColumn("low", F.col("low") + F.coalesce("bin", F.lit(0)) * F.col("width"))
                 .withColumn("done", F.col("width") == 1).withColumn("width", F.ceil(F.col("width") / BINS).cast("long")).drop("bin"))
        state = stored(state, "state")
        if not state.where("not done").limit(1).count():
            break
        state = state.drop("done")
    best = meet(state.drop("done"), _select, "query_id long, vec_id long, score long")
    rank = F.row_number().over(Window.partitionBy("query_id").orderBy(F.desc("score"), "vec_id"))
    return best.withColumn("rank", rank).where(F.col("rank") <= k).select("query_id", "rank", "vec_id", "score")
