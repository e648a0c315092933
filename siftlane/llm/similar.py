"""Near-dedup by the similarity of word shingles: op 8's SimHash covering and MinHash bands propose candidates, exact Jaccard similarity of the shingle sets links them.

A text's shingles are the distinct runs of five lower-cased words, as 64-bit hashes. Their 64-bit SimHash fingerprints are linked by anchor points (``simhash_covering.linked``) where they
differ in at most 4 bits. Similarity 0.8 means about 10 bits, which anchors cannot cover, so bands add what is further apart: 144 minima of the set in 24 bands of 6 make a pair of similarity 0.8 meet in some
band with a probability of 0.9993 (0.85: 0.999998). Texts that meet, and what they reach, are walked breadth-first with their whole sets: no two that meet are
linked by less than the similarity asked for, and no link inside such a group is missed.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from siftlane.llm import chunks as C
from siftlane.llm import graph
from siftlane.llm.simhash_covering import BITS, VOTES_AT_ONCE, first_rows, keyed_rows, linked, named_classes, spanning
from siftlane.llm.worker import release
from siftlane.session import stored

BANDS, ROWS = 24, 6
#: Shingles whose minima are taken at once; entries that one task receives, about; texts whose sets one task receives, about.
SHINGLES_AT_ONCE, ENTRIES_PER_BUCKET, SETS_PER_BUCKET = 1 << 12, 1 << 20, 1 << 12
#: Words that a worker remembers; idle workers keep them beside the later stages.
KNOWN_WORDS = 100_000
#: Rows whose sets a task holds at once.
ROWS_AT_ONCE = 1 << 10

_KNOWN_WORDS = C.WordHashes()


def shingles(text: str | None, width: int) -> np.ndarray:
    """Ascending distinct hashes of all runs of ``width`` words (fewer words: the whole sequence; none: no shingle)."""
    words = (text or "").encode().lower().split()  # bytes: A-Z and the six blanks only
    _KNOWN_WORDS.trim(KNOWN_WORDS)
    hashes = np.fromiter(map(_KNOWN_WORDS.__getitem__, words), np.uint64, len(words))
    width = min(width, len(words))
    return np.unique(C.linear_hash(hashes, np.arange(len(words) - width + 1), C.multipliers(60 + width, width))) if width else hashes


def _pieces(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """A task holds the texts and sets of a few rows at once, and gives their memory back."""
    for batch in batches:
        for i in range(0, batch.num_rows, ROWS_AT_ONCE):
            yield batch.slice(i, ROWS_AT_ONCE)
        release()


def set_print(found: np.ndarray) -> int:
    """A signed number that names the set."""
    return int(np.uint64(xxhash.xxh64_intdigest(found.tobytes(), 42)).view(np.int64))


def simhash(found: np.ndarray) -> int:
    """The fingerprint of a set as a signed number: a bit is set if it is set in over half the hashes."""
    votes = np.zeros(BITS, np.int64)
    for i in range(0, len(found), VOTES_AT_ONCE):
        votes += np.unpackbits(found[i:i + VOTES_AT_ONCE].astype(">u8").view(np.uint8).reshape(-1, 8), axis=1).sum(axis=0, dtype=np.int64)
    return int.from_bytes(np.packbits(votes * 2 > len(found)).tobytes(), "big", signed=True)


def bands(found: np.ndarray) -> np.ndarray:
    """One key for each band."""
    factors = C.multipliers(50, BANDS * ROWS)
    least = np.full(BANDS * ROWS, np.iinfo(np.uint64).max)
    for i in range(0, len(found), SHINGLES_AT_ONCE):
        least = np.minimum(least, (found[i:i + SHINGLES_AT_ONCE, None] * factors).min(axis=0))
    rows = C.mixed(least).reshape(BANDS, ROWS) * C.multipliers(51, ROWS)
    return C.mixed(rows.sum(axis=1, dtype=np.uint64) + np.arange(BANDS, dtype=np.uint64))


def print_column(text, width: int) -> F.Column:
    def run(texts: pa.Array) -> pa.Array:
        found = pa.array([set_print(shingles(t.as_py(), width)) for t in texts], pa.int64())
        release()
        return found

    return F.arrow_udf(run, "long")(text)


def _prints(docs: DataFrame, width: int) -> DataFrame:
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part in _pieces(batches):
            sets = [shingles(t.as_py(), width) for t in part.column(1)]
            fps, keys = pa.array([set_print(s) for s in sets], pa.int64()), pa.array([bands(s).tobytes() if len(s) else b"" for s in sets], pa.binary())
            sims = pa.array([simhash(s) for s in sets], pa.int64())
            yield pa.RecordBatch.from_arrays([part.column(0), fps, keys, sims], ["doc_id", "fp", "bands", "sim"])

    rows = docs.select(F.col("doc_id").cast("long"), F.col("text").cast("string").alias("text"))
    return stored(rows.mapInArrow(run, "doc_id long, fp long, bands binary, sim long"), "prints")


def candidates(least: DataFrame) -> DataFrame:
    """Spanning links (u, v) between the prints that share a band."""
    n = max(8, -(-least.count() * BANDS // ENTRIES_PER_BUCKET))

    def send(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            pdf = pdf[pdf["bands"].str.len() > 0]
            keys = np.frombuffer(b"".join(pdf["bands"]), np.uint64)
            fps = np.repeat(pdf["fp"].to_numpy(np.int64), BANDS)
            order = np.argsort(keys, kind="stable")
            keys, fps = keys[order], fps[order]
            parts = list(C.by_bucket(keys, n)) if len(keys) else []
            yield pd.DataFrame({"bucket": [p[0] for p in parts], "keys": [keys[a:b].tobytes() for _, a, b in parts], "fps": [fps[a:b].tobytes() for _, a, b in parts]})

    def settle(key, pdf):
        keys = np.frombuffer(b"".join(pdf["keys"]), np.uint64)
        fps = np.frombuffer(b"".join(pdf["fps"]), np.int64)
        order = np.argsort(keys, kind="stable")
        keys, fps = keys[order], fps[order]
        new = np.r_[True, np.diff(keys) != 0]
        first = fps[np.flatnonzero(new)[np.cumsum(new) - 1]]
        u, v = spanning(fps[~new].view(np.uint64), first[~new].view(np.uint64))
        return pd.DataFrame({"u": u.view(np.int64), "v": v.view(np.int64)})

    sent = least.select("fp", "bands").mapInPandas(send, "bucket long, keys binary, fps binary")
    return sent.groupBy("bucket").applyInPandas(settle, "u long, v long")


def anchored(least: DataFrame, radius: int = 4) -> DataFrame:
    """Links (u, v) whose components join the prints with SimHash fingerprints of ``radius`` differing bits or fewer; a fingerprint is a node beside the prints."""
    sims = least.where(F.length("bands") > 0).select("fp", "sim")
    distinct = stored(sims.groupBy("sim").agg(F.count("*").alias("n")), "sims")
    links = stored(linked(distinct.select(F.col("sim").alias("fp")), radius), "anchored")
    met = distinct.where("n > 1").select("sim").union(links.select("u")).union(links.select("v")).distinct()
    return links.union(sims.join(met, "sim", "left_semi").select("fp", "sim"))


def walk(sets: list[np.ndarray], similarity: float) -> tuple[list[int], list[int]]:
    """Links with the components of all pairs of ``similarity`` or more. What has been reached is not compared again."""
    size = np.array([len(s) for s in sets])
    u, v = [], []
    left = np.arange(len(sets))
    while len(left):
        frontier, left = [left[0]], left[1:]
        while frontier and len(left):
            a = frontier.pop()
            some = left[np.minimum(size[left], size[a]) >= similarity * np.maximum(size[left], size[a])]
            if not len(some):
                continue
            every = np.concatenate([sets[i] for i in some])
            at = np.minimum(np.searchsorted(sets[a], every), size[a] - 1)
            both = np.add.reduceat((sets[a][at] == every).astype(np.int64), np.cumsum(size[some]) - size[some])
            near = some[both / (size[a] + size[some] - both) >= similarity]
            u += [a] * len(near)
            v += near.tolist()
            frontier += near.tolist()
            left = np.setdiff1d(left, near, assume_unique=True)
    return u, v


def similar_links(docs: DataFrame, least: DataFrame, width: int, similarity: float) -> DataFrame:
    """Links (u, v) between prints with the components of all pairs that meet and have the similarity."""
    groups = stored(graph.components(candidates(least).union(anchored(least))).withColumnRenamed("node", "fp"), "groups")
    n = max(8, -(-groups.count() // SETS_PER_BUCKET))
    chosen = least.join(groups, "fp").select(F.coalesce("least", F.lit(0)).alias("id"), F.col("least").isNull().alias("none"), "fp", "root")
    keys = ["id", "none", "fp"]
    text = F.col("text").cast("string")
    texts = keyed_rows(docs, print_column(text, width), text.alias("text")).join(chosen, keys).dropDuplicates(keys).select("root", "fp", "text")

    def send(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part in _pieces(batches):
            roots, fps = (part.column(c).to_numpy() for c in (0, 1))
            own = (C.mixed(roots.view(np.uint64)) % np.uint64(n)).astype(np.int64)
            for bucket in np.unique(own).tolist():
                rows = np.flatnonzero(own == bucket)
                sets = [shingles(part.column(2)[i].as_py(), width) for i in rows.tolist()]
                packed = [roots[rows].tobytes(), fps[rows].tobytes(), np.array([len(s) for s in sets], np.int64).tobytes(), C.squeeze(np.concatenate(sets))]
                yield pa.RecordBatch.from_arrays([pa.array([bucket]), *[pa.array([x], pa.binary()) for x in packed]], ["bucket", "roots", "fps", "lens", "sets"])

    def settle(key, pdf):
        roots, fps, lens = (np.frombuffer(b"".join(pdf[c]), np.int64) for c in ("roots", "fps", "lens"))
        sets = np.split(np.concatenate([C.expand(s, np.uint64) for s in pdf["sets"]]), np.cumsum(lens)[:-1])
        order = np.lexsort((fps, roots))
        out_u, out_v = [], []
        for group in np.split(order, np.flatnonzero(np.diff(roots[order])) + 1):
            u, v = walk([sets[i] for i in group], similarity)
            out_u += fps[group[u]].tolist() if u else []
            out_v += fps[group[v]].tolist() if v else []
        release()
        return pd.DataFrame({"u": np.array(out_u, np.int64), "v": np.array(out_v, np.int64)})

    sent = texts.mapInArrow(send, "bucket long, roots binary, fps binary, lens binary, sets binary")
    return sent.groupBy("bucket").applyInPandas(settle, "u long, v long")


def keep_similar(docs: DataFrame, width: int = 5, similarity: float = 0.8) -> DataFrame:
    """The documents less all but one of each component of texts whose sets of ``width``-word shingles have a Jaccard similarity of ``similarity`` or more.

    Words are [^\\x20\\x09-\\x0D]+ with A-Z lower-cased; fewer than ``width`` words are one shingle. Texts with equal sets are always linked (also texts without words, with each
    other); other pairs are found with the probability that they share a band or have fingerprints within 4 bits. The row with the smallest doc_id stays, with all its columns, as in ``simhash_covering.keep_one``.
    """
    if not 0 < similarity <= 1:
        raise ValueError("a similarity above 0, 1 at most")
    least = stored(_prints(docs, width).groupBy("fp").agg(F.min("doc_id").alias("least"), F.first("bands").alias("bands"), F.first("sim").alias("sim")), "distinct")
    links = similar_links(docs, least, width, similarity)
    named = named_classes(least.drop("bands", "sim"), graph.components(links).withColumnRenamed("node", "fp"))
    return first_rows(docs, named, print_column(F.col("text").cast("string"), width))
