"""SimHash near-dedup: 64-bit fingerprints linked by anchor-point covering.

The 64 bits are cut into three parts of 21, 21 and 22 bits. Two fingerprints that differ in at most 4 bits differ in at most one bit of some part. The anchors of
a part are the words of a covering code: the [15, 11] Hamming code on 15 of its bits, every value on the rest. The code's covering radius is 1, so each
fingerprint has one home anchor at distance 0 or 1, and whatever lies within one bit of it on that part lies within 2 of that anchor. Each fingerprint is
sent to every anchor within 2 (7 or 14 of them, as at most one bit outside the code may differ), and at each anchor those at home are compared with all.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from siftlane.llm import chunks as C
from siftlane.llm import graph
from siftlane.llm.worker import release
from siftlane.session import stored

BITS, PARTS = 64, ((0, 21), (21, 21), (42, 22))
CODE_BITS = 15
SHINGLE, SEED = 4, 42
#: Shingles whose bits are unpacked at once; pairs that are compared at once; members from which an anchor's group is walked instead of paired.
VOTES_AT_ONCE, PAIRS_AT_ONCE, WALKED = 1 << 16, 1 << 21, 4096
#: Entries that one task receives, about.
ENTRIES_PER_BUCKET = 1 << 20


def fingerprint(text: str | None) -> int:
    """The 64-bit fingerprint as a signed number: a bit is set if it is set in over half the shingle hashes."""
    words = (text or "").encode().lower().split()  # bytes: A-Z and the six blanks only
    if not words:
        return 0
    line = b" ".join(words)
    lens = np.fromiter(map(len, words), np.int64, len(words))
    ends = np.cumsum(lens + 1) - 1
    n = max(1, len(words) - SHINGLE + 1)
    starts = (ends - lens)[:n].tolist()
    ends = ends[-n:].tolist()
    votes = np.zeros(BITS, np.int64)
    digest = xxhash.xxh64_digest
    for i in range(0, n, VOTES_AT_ONCE):
        raw = b"".join([digest(line[a:b], SEED) for a, b in zip(starts[i:i + VOTES_AT_ONCE], ends[i:i + VOTES_AT_ONCE])])
        votes += np.unpackbits(np.frombuffer(raw, np.uint8).reshape(-1, 8), axis=1).sum(axis=0, dtype=np.int64)
    return int.from_bytes(np.packbits(votes * 2 > n).tobytes(), "big", signed=True)


def fingerprint_column(text) -> F.Column:
    def run(texts: pd.Series) -> pd.Series:
        found = pd.Series([fingerprint(t) for t in texts], dtype="int64")
        release()
        return found

    return F.pandas_udf(run, "long")(text)


def _syndromes(values: np.ndarray) -> np.ndarray:
    """Syndrome of the low 15 bits: the exclusive or of the numbers 1 to 15 of the bits that are set."""
    out = np.zeros(len(values), np.int64)
    for i in range(CODE_BITS):
        out ^= np.where((values >> i) & 1, i + 1, 0)
    return out


def _patterns(width: int, threshold: int = 1) -> tuple[np.ndarray, np.ndarray]:
    """For each syndrome the flips that lead to an anchor within reach, padded with -1; the first leads home."""
    raw = [0] + [1 << i for i in range(CODE_BITS, width)] * (threshold > 0)
    rows = []
    for s in range(CODE_BITS + 1):
        home = 1 << (s - 1) if s else 0
        pairs = [(1 << (a - 1)) | (1 << ((a ^ s) - 1)) for a in range(1, CODE_BITS + 1) if s and a < a ^ s]
        rows.append([home | r for r in raw] + pairs * (threshold > 0))
    size = max(map(len, rows))
    return np.array([r + [-1] * (size - len(r)) for r in rows], np.int64), np.array([len(r) for r in rows])


def anchor_entries(fps: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """All (anchor, fingerprint, at home) entries of fingerprints; an anchor is the number of the part and the code word."""
    cells, which, home = [], [], []
    for part, (shift, width) in enumerate(PARTS):
        flips, _ = _patterns(width)
        bits = ((fps >> np.uint64(shift)) & np.uint64((1 << width) - 1)).astype(np.int64)
        own = flips[_syndromes(bits)]
        row, col = np.nonzero(own >= 0)
        cells.append((bits[row] ^ own[row, col]) | (part << 22))
        which.append(row)
        home.append(col == 0)
    return np.concatenate(cells).astype(np.uint32), fps[np.concatenate(which)], np.concatenate(home)


def near_pairs(cells: np.ndarray, fps: np.ndarray, home: np.ndarray, radius: int) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """Linked fingerprints of whole anchor groups, in blocks; large groups give a spanning set of links instead of all."""
    order = np.argsort(cells, kind="stable")
    cells, fps, home = cells[order], fps[order], home[order]
    begin = np.flatnonzero(np.r_[True, np.diff(cells) != 0])
    size = np.diff(np.r_[begin, len(cells)])
    large = size > WALKED
    for a, n in zip(begin[large].tolist(), size[large].tolist()):
        yield from _walk(np.unique(fps[a:a + n]), radius)
    group = np.repeat(np.arange(len(begin)), size)
    homes = np.flatnonzero(home & ~large[group])
    work = np.cumsum(size[group[homes]])
    for i, j in _slices(work):
        part = homes[i:j]
        n = size[group[part]]
        left = np.repeat(part, n)
        right = np.repeat(begin[group[part]] - np.cumsum(n) + n, n) + np.arange(n.sum())
        a, b = fps[left], fps[right]
        near = (a != b) & (np.bitwise_count(a ^ b) <= radius)
        yield a[near], b[near]


def _slices(work: np.ndarray) -> Iterator[tuple[int, int]]:
    i = 0
    while i < len(work):
        done = work[i - 1] if i else 0
        j = max(i + 1, int(np.searchsorted(work, done + PAIRS_AT_ONCE, "right")))
        yield i, j
        i = j


def _walk(fps: np.ndarray, radius: int) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """Breadth-first over one large group: what has been reached is not compared again, so dense groups cost little more than their size."""
    left = fps
    while len(left):
        frontier, left = left[:1], left[1:]
        while len(frontier) and len(left):
            rest = []
            step = max(1, PAIRS_AT_ONCE // len(left))
            for i in range(0, len(frontier), step):
                some = frontier[i:i + step]
                near = np.bitwise_count(some[:, None] ^ left[None, :]) <= radius
                hit = near.any(axis=0)
                yield some[near.argmax(axis=0)[hit]], left[hit]
                rest.append(left[hit])
                left = left[~hit]
                if not len(left):
                    break
            frontier = np.concatenate(rest)


def linked(fingerprints: DataFrame, radius: int = 4) -> DataFrame:
    """Links (u, v; longs) between distinct fingerprints (fp, long) whose components are those of all pairs within ``radius`` (4 at most) bits."""
    if not 0 <= radius <= 4:
        raise ValueError("three parts cover a radius of 4 at most")
    each = sum(CODE_BITS - 1 for _ in PARTS)
    n = max(8, -(-fingerprints.count() * each // ENTRIES_PER_BUCKET))

    def send(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            cells, fps, home = anchor_entries(pdf["fp"].to_numpy(np.int64).view(np.uint64))
            spread = C.mixed(cells.astype(np.uint64))
            order = np.argsort(spread, kind="stable")
            cells, fps, home = cells[order], fps[order], home[order]
            parts = list(C.by_bucket(spread[order], n))
            yield pd.DataFrame({"bucket": [p[0] for p in parts], "cells": [C.squeeze(cells[a:b]) for _, a, b in parts],
                                "fps": [fps[a:b].tobytes() for _, a, b in parts], "home": [C.squeeze(home[a:b]) for _, a, b in parts]})

    def settle(key, pdf):
        cells = np.concatenate([C.expand(x, np.uint32) for x in pdf["cells"]])
        fps = np.concatenate([np.frombuffer(x, np.uint64) for x in pdf["fps"]])
        home = np.concatenate([C.expand(x, bool) for x in pdf["home"]])
        u, v = np.zeros(0, np.uint64), np.zeros(0, np.uint64)
        for a, b in near_pairs(cells, fps, home, radius):
            u, v = np.r_[u, a], np.r_[v, b]
            if len(u) > PAIRS_AT_ONCE:
                u, v = spanning(u, v)
        u, v = spanning(u, v)
        return pd.DataFrame({"u": u.view(np.int64), "v": v.view(np.int64)})

    sent = fingerprints.select("fp").mapInPandas(send, "bucket long, cells binary, fps binary, home binary")
    return sent.groupBy("bucket").applyInPandas(settle, "u long, v long")


def spanning(u: np.ndarray, v: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """As few links with the same components."""
    nodes, place = np.unique(np.concatenate([u, v]), return_inverse=True)
    root = graph.local_roots(len(nodes), place[:len(u)], place[len(u):])
    moved = root != np.arange(len(nodes))
    return nodes[moved], nodes[root[moved]]


def classes(docs: DataFrame, radius: int = 4) -> tuple[DataFrame, DataFrame]:
    """The stored fingerprints (doc_id, fp) of all rows, and for each distinct fp its component: fp, component_id, first_fp.

    component_id is the smallest doc_id of the component and first_fp the smallest fingerprint that carries it (of all its fingerprints, where no row of the component has a doc_id).
    """
    prints = stored(docs.select(F.col("doc_id").cast("long"), fingerprint_column(F.col("text").cast("string")).alias("fp")), "fingerprints")
    least = stored(prints.groupBy("fp").agg(F.min("doc_id").alias("least")), "distinct")
    roots = graph.components(linked(least, radius)).withColumnRenamed("node", "fp")
    return prints, named_classes(least, roots)


def named_classes(least: DataFrame, roots: DataFrame) -> DataFrame:
    """The stored component (fp, component_id, first_fp) of each distinct fingerprint (fp, least), from the roots (fp, root) of those that have links."""
    every = least.join(roots, "fp", "left").withColumn("root", F.coalesce("root", "fp"))
    first = F.min(F.struct(F.col("least").isNull().alias("none"), "least", "fp"))
    named = every.groupBy("root").agg(first.alias("first")).select("root", F.col("first.least").alias("component_id"), F.col("first.fp").alias("first_fp"))
    return stored(every.join(named, "root").select("fp", "component_id", "first_fp"), "classes")


def near_duplicates(docs: DataFrame, radius: int = 4) -> DataFrame:
    """One row per document: doc_id, fingerprint (16 hex digits), component_id (smallest doc_id that it reaches over links of ``radius`` bits or fewer).

    Fingerprints: A-Z lower-cased, words [^\\x20\\x09-\\x0D]+, shingles of 4 words with repeats (fewer words: the whole sequence), XXH64 with seed 42, majority
    by bit. A null, empty or blank text has fingerprint zero and is linked like any other. A null doc_id gets the component's smallest known doc_id (null if there is none).
    Rows that repeat a doc_id are fingerprinted one by one. Other columns are ignored; an empty table gives no rows. Texts are taken whole.
    """
    prints, named = classes(docs, radius)
    return prints.join(named, "fp").select("doc_id", F.lower(F.lpad(F.hex("fp"), 16, "0")).alias("fingerprint"), "component_id")


def keep_one(docs: DataFrame, radius: int = 4) -> DataFrame:
    """The documents less all but one of each component: the row with the smallest doc_id stays, with all its columns.

    Of rows that repeat this doc_id, one with the smallest fingerprint stays. Where no row of a component has a doc_id, one of its rows stays.
    """
    _, named = classes(docs, radius)
    return first_rows(docs, named, fingerprint_column(F.col("text").cast("string")))


def keyed_rows(docs: DataFrame, fp: F.Column, what: F.Column) -> DataFrame:
    """``what`` of each row, keyed by its doc_id (0 if null), whether that is null, and its fingerprint: columns id, none, fp and ``what``."""
    doc_id = F.col("doc_id").cast("long")
    return docs.select(F.coalesce(doc_id, F.lit(0)).alias("id"), doc_id.isNull().alias("none"), fp.alias("fp"), what)


def first_rows(docs: DataFrame, named: DataFrame, fp: F.Column) -> DataFrame:
    """One row of each component, with all its columns."""
    keys = ["id", "none", "fp"]
    stay = named.select(F.coalesce("component_id", F.lit(0)).alias("id"), F.col("component_id").isNull().alias("none"), F.col("first_fp").alias("fp")).distinct()
    keyed = keyed_rows(docs, fp, F.struct(*[F.col(f"`{c}`") for c in docs.columns]).alias("doc"))
    return keyed.join(stay, keys, "left_semi").dropDuplicates(keys).select("doc.*")
