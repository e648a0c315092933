"""Mixing sources to target weights, with a multivariate-hypergeometric splitting tree.

Each source is a permutation of its documents by hash, cut into blocks (hash ranges). A source's quota is the number of blocks whose words come to its target: whole
rounds over the source, then a beginning of the permutation, whose last block is taken up to the document that comes nearest (equal documents one by one). The quotas are exact; the tree only
decides where blocks go: at each node the output shards are halved and a multivariate-hypergeometric draw, seeded by the node, splits the quotas of
all sources between the halves. A shard takes its share of each source as the next blocks of the permutation, so shards are disjoint, and is shuffled by hash inside.
"""

from __future__ import annotations

from fractions import Fraction

import numpy as np
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from siftlane.session import stored

#: Words of a text.
WORD = "[^\\x20\\x09-\\x0D]+"
#: Bits of the permutation hash that number a block; words of an output shard, about; most rows of the table of sources that the driver holds.
BLOCK_BITS, SHARD_WORDS, MOST_SOURCES = 10, 2_000_000, 100_000
#: Shards that the tree splits into at most; beyond, a shard is cut into pieces of SHARD_WORDS by hash.
MOST_SHARDS = 1024
#: No document is taken more often than this.
MOST = 3


def targets(sizes: list[int], weights: list[int], most: int = MOST) -> list[Fraction]:
    """Share the sum of the sizes by weight; a target stops at ``most`` times its size and the excess is shared again among the others."""
    out = [Fraction(0)] * len(sizes)
    rest, open_weight = Fraction(sum(sizes)), sum(weights)
    order = sorted(range(len(sizes)), key=lambda i: Fraction(sizes[i], weights[i]))
    for at, i in enumerate(order):
        if rest * weights[i] < most * sizes[i] * open_weight:
            for j in order[at:]:
                out[j] = rest * weights[j] / open_weight
            break
        out[i] = Fraction(most * sizes[i])
        rest -= out[i]
        open_weight -= weights[i]
    return out


def split_quotas(quotas: np.ndarray, shards: int, seed: int) -> np.ndarray:
    """How many blocks of each source (rows) each shard (columns) gets: exact in every source, equal in size (but for one) over shards."""
    out = np.zeros((len(quotas), shards), np.int64)

    def node(left: np.ndarray, begin: int, end: int) -> None:
        if end - begin == 1:
            out[:, begin] = left
            return
        middle = (begin + end) // 2
        total = int(left.sum())
        first = total * (middle - begin) // (end - begin)
        draw = np.random.default_rng([seed, begin, end]).multivariate_hypergeometric(left, first, method="marginals") if total else left
        node(draw, begin, middle)
        node(left - draw, middle, end)

    if len(quotas):
        node(quotas.astype(np.int64), 0, shards)
    return out


def _permuted(docs: DataFrame, seed: int, whole: bool) -> DataFrame:
    """Stored rows: doc_id, source, size, place in the permutation (63 bits), block, row number n and, if ``whole``, the document itself.

    Rows that agree in doc_id and text share a place; their numbers, which differ, order them. Numbers are fixed by storing them.
    """
    text, doc_id = F.col("text").cast("string"), F.col("doc_id").cast("long")
    place = F.xxhash64(F.lit(seed), doc_id, F.xxhash64(text)).bitwiseAND(F.lit((1 << 63) - 1))
    doc = [F.struct(*[F.col(f"`{c}`") for c in docs.columns]).alias("doc")] if whole else []
    rows = docs.select(*doc, doc_id.alias("doc_id"), F.col("source").cast("string").alias("source"),
                       F.coalesce(F.regexp_count(text, F.lit(WORD)), F.lit(0)).cast("long").alias("size"), place.alias("place"))
    return stored(rows.withColumns({"block": F.shiftright("place", 63 - BLOCK_BITS).cast("long"), "n": F.monotonically_increasing_id()}), "permuted")


def _row_cuts(facts: DataFrame, cells: list[tuple]) -> dict:
    """For cells (source, place, size, k) of tied rows the number of the row behind the first k, by source.

    Rows are counted by the partition that numbered them, so that a tie of any size meets in no task: only the partition that holds the row sought is ordered.
    """
    if not cells:
        return {}
    asked = facts.sparkSession.createDataFrame(cells, "s string, p long, z long, k long")
    same = facts["source"].eqNullSafe(asked["s"]) & (F.col("place") == F.col("p")) & (F.col("size") == F.col("z"))
    tied = facts.join(F.broadcast(asked), same).select("s", "k", "n", F.shiftright("n", 33).alias("part"))  # one row per source at most
    parts = tied.groupBy("s", "k", "part").agg(F.count("*").alias("rows"))
    before = F.sum("rows").over(Window.partitionBy("s").orderBy("part")) - F.col("rows")
    held = parts.withColumn("before", before).where("before <= k and k < before + rows").select(F.col("s").alias("s2"), F.col("part").alias("part2"), "before")
    at = F.row_number().over(Window.partitionBy("s", "part").orderBy("n")) - 1 + F.col("before")
    inside = tied.join(held, tied["s"].eqNullSafe(held["s2"]) & (F.col("part") == F.col("part2"))).withColumn("at", at)
    return {r["s"]: r["n"] for r in inside.where("at = k").select("s", "n").collect()}


def _plan(facts: DataFrame) -> tuple[DataFrame, list[tuple], list[int]]:
    """The numbered blocks; one row per source with its size, target, whole rounds, where the permutation is cut (place, size and row number of the first row that is not
    taken) and blocks in a round; block quotas."""
    blocks = facts.groupBy("source", "block").agg(F.sum("size").alias("size"))
    in_order = Window.partitionBy("source").orderBy("block")
    blocks = stored(blocks.select("source", "block", "size", (F.sum("size").over(in_order) - F.col("size")).alias("before"),
                                  (F.row_number().over(in_order) - 1).alias("number")), "blocks")
    sources = blocks.groupBy("source").agg(F.sum("size").alias("size"), F.count("*").alias("blocks"))
    if sources.count() > MOST_SOURCES:
        raise ValueError(f"more than {MOST_SOURCES} sources")
    told = sorted(sources.collect(), key=lambda r: (r["source"] is None, (r["source"] or "").encode()))
    aims = targets([r["size"] for r in told], [1 + i % 3 for i in range(len(told))])
    rounds = [int(t / r["size"]) if r["size"] else 0 for t, r in zip(aims, told)]
    wanted = facts.sparkSession.createDataFrame([(r["source"], float(t - k * r["size"])) for r, t, k in zip(told, aims, rounds)], "s string, rest double")
    # the block in which the target is reached, and in it the first rows that are not all taken: equal rows are one cell, of which k are taken
    edge = (blocks.join(wanted, blocks["source"].eqNullSafe(wanted["s"])).where("rest > 0 and before <= rest and rest < before + size")
            .select("s", F.col("block").alias("b"), "number", (F.col("rest") - F.col("before")).alias("rest")))
    edges = {r["s"]: r for r in edge.collect()}
    inside = facts.join(edge, facts["source"].eqNullSafe(F.col("s")) & (F.col("block") == F.col("b")))
    cells = inside.groupBy("source", "rest", "place", "size").agg(F.count("*").alias("rows"))
    words = F.col("size") * F.col("rows")
    cells = cells.withColumn("before", F.sum(words).over(Window.partitionBy("source").orderBy("place", "size")) - words)
    k = F.expr("case when size > 0 then least(rows, greatest(0, floor((rest - before) / size + 0.5))) when before <= rest then rows else 0 end").cast("long")
    first = cells.withColumn("k", k).where("k < rows").groupBy("source").agg(F.min(F.struct("place", "size", "k")).alias("cut"))
    cuts = {r["source"]: r["cut"] for r in first.collect()}
    row_cuts = _row_cuts(facts, [(s, c["place"], c["size"], c["k"]) for s, c in cuts.items() if c["k"]])
    rows, quotas = [], []
    for r, t, whole in zip(told, aims, rounds):
        at, cut = edges.get(r["source"]), cuts.get(r["source"])
        if at is None:
            where = (0, 0, 0)
        elif cut is None:
            where = ((at["b"] + 1) << (63 - BLOCK_BITS), 0, 0) if at["b"] + 1 < 1 << BLOCK_BITS else ((1 << 63) - 1, (1 << 63) - 1, (1 << 63) - 1)
        else:
            where = (cut["place"], cut["size"], row_cuts.get(r["source"], 0))
        rows.append((r["source"], r["size"], float(t), whole, *where, r["blocks"]))
        quotas.append(whole * r["blocks"] + (0 if at is None else at["number"] + 1))
    return blocks, rows, quotas


class _Mix:
    """The stored rows with their number of copies, and the draws that place the copies in shards."""

    def __init__(self, docs: DataFrame, seed: int, whole: bool):
        self.seed, spark = seed, docs.sparkSession
        rows = _permuted(docs, seed, whole)
        self.blocks, self.plan, self.quotas = _plan(rows.drop("doc"))
        told = spark.createDataFrame(self.plan, "s string, source_size long, target double, rounds int, cut long, cut_size long, cut_n long, blocks long")
        # one row per source, of which there are at most MOST_SOURCES
        joined = rows.join(F.broadcast(told), rows["source"].eqNullSafe(told["s"])).drop("s")
        begun = F.struct("place", "size", "n") < F.struct("cut", "cut_size", "cut_n")
        self.rows = joined.withColumn("copies", F.least(F.col("rounds") + begun.cast("int"), F.lit(MOST)))
        self.total = sum(r[1] for r in self.plan)
        self.shards = min(MOST_SHARDS, max(16, -(-self.total // SHARD_WORDS)))

    def _shards_of_blocks(self) -> DataFrame:
        """For each source and block the shards of its copies."""
        share = split_quotas(np.array(self.quotas, np.int64), self.shards, self.seed)
        edges = self.blocks.sparkSession.createDataFrame([(r[0], r[-1], np.cumsum(x)[:-1].tolist()) for r, x in zip(self.plan, share)], "s string, blocks long, edges array<long>")
        placed = self.blocks.join(edges, self.blocks["source"].eqNullSafe(edges["s"]))

        def shard_of(copy: int) -> Column:
            return F.size(F.filter("edges", lambda edge: edge <= F.col("number") + copy * F.col("blocks")))

        return placed.select("s", F.col("block").alias("b"), F.array(*[shard_of(c) for c in range(MOST)]).alias("shards"))

    def drawn(self, *what: str) -> DataFrame:
        """One row per drawn copy, dealt to shards and shuffled inside them: shard and the columns named."""
        pieces = max(1, -(-self.total // (self.shards * SHARD_WORDS)))
        of_blocks, taken = self._shards_of_blocks(), self.rows.where("copies > 0")
        placed = taken.join(of_blocks, taken["source"].eqNullSafe(of_blocks["s"]) & (taken["block"] == of_blocks["b"]))
        rows = placed.select(*what, "place", "n", F.posexplode(F.slice("shards", F.lit(1), F.col("copies"))).alias("copy", "shard"))
        rows = rows.withColumns({"key": F.xxhash64(F.lit(self.seed), "place", "copy")}).withColumn("piece", F.pmod(F.xxhash64("key", "n"), F.lit(pieces)))
        return rows.repartition(self.shards * pieces, "shard", "piece").sortWithinPartitions("shard", "piece", "key", "n").select("shard", *what)


def mix(docs: DataFrame, seed: int = 20) -> DataFrame:
    """How often each document is drawn: doc_id, source, size, source_size, target, copies (0 to 3), counted over the copies that the tree has dealt to shards.

    Size is the number of words [^\\x20\\x09-\\x0D]+ (null text: 0). Sources in the order of their code points, null last, weigh 1, 2, 3, repeating, and share the sum
    of all sizes; a target stops at 3 times its source's size and the excess is shared again by weight. A source's words taken differ from its target by half
    a document at most. Every row counts on its own: of rows equal in doc_id and text, and of null ids, as many are taken as come nearest to the target. Other columns
    are ignored; an empty table gives no rows. The table of sources is held by the driver: more than 100,000 sources are refused. The tree splits into 1,024 shards at
    most; beyond, shards are cut by hash. The same rows and seed give the same mix, whatever the partitioning (of equal rows, any may be the ones taken).
    """
    mixed = _Mix(docs, seed, whole=False)
    copies = mixed.drawn("n").groupBy("n").agg(F.count("*").cast("int").alias("copies"))
    rows = mixed.rows.drop("copies").join(copies, "n", "left")
    return rows.select("doc_id", "source", "size", "source_size", "target", F.coalesce("copies", F.lit(0)).alias("copies"))


def mixed_documents(docs: DataFrame, seed: int = 20, shard: str | None = None) -> DataFrame:
    """The mix itself: every document as often as it is taken, all columns kept, dealt to shards by the splitting tree and shuffled inside them.

    A shard (of a very large mix: a piece of a shard) is one task's share; with ``shard`` its number is added as a column of that name. The documents are stored once,
    with their row numbers.
    """
    return _Mix(docs, seed, whole=True).drawn("doc").select("doc.*", *([F.col("shard").alias(shard)] if shard else []))
