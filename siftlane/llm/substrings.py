"""Substring dedup over words, by difference-cover anchors.

A word is removed if some window of 20 words that covers it also starts earlier in the corpus (smaller doc_id, or same document and earlier start).

The residues 0, 1, 3, 9 cover all differences modulo 13. So for any two positions p and q there is a shift j < 13 such that p + j and q + j both are
cover positions. Only the eight words that begin at a cover position are hashed (4 of 13 positions); two equal windows of 20 words always share such an
anchor at the same shift, since 12 + 8 <= 20. Anchors that occur once in the corpus end there. Windows that hold a repeated anchor are extended to
all 20 words, hashed with 128 bits, and the earliest of each class stays.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame

from siftlane.llm import chunks as C

PERIOD, COVER = 13, (0, 1, 3, 9)
SPANS = "doc_id long, n_words long, n_removed long, spans array<struct<start:long,end:long>>, kept_text string"


def _anchors(hashes: np.ndarray, lens: np.ndarray, window: int) -> np.ndarray:
    """Positions of anchors, in documents that hold a whole window."""
    width = window - PERIOD + 1
    first = np.cumsum(lens) - lens
    place = np.arange(len(hashes)) - np.repeat(first, lens)
    own = np.repeat(lens, lens)
    return np.flatnonzero(np.isin(place % PERIOD, COVER) & (place + width <= own) & (own >= window))


def _anchor_keys(hashes: np.ndarray, at: np.ndarray, window: int):
    return C.distinct(C.linear_hash(hashes, at, C.multipliers(1, window - PERIOD + 1)))


def _windows(chunk: C.Chunk, totals: np.ndarray, window: int):
    """Windows with a repeated anchor: their hashes and positions; the place and document of each word; words per document."""
    hashes, lens = C.word_hashes(chunk)
    at = _anchors(hashes, lens, window)
    _, _, key = _anchor_keys(hashes, at, window)
    again = np.zeros(len(hashes) + window + 1, np.int32)
    again[at] = totals[key] > 1 if len(at) else 0
    seen = np.r_[0, np.cumsum(again)]
    doc = np.repeat(np.arange(len(lens)), lens)
    ends = np.cumsum(lens)
    p = np.arange(len(hashes))
    p = p[(p + window <= np.repeat(ends, lens)) & (seen[p + PERIOD] > seen[p])]
    one = C.linear_hash(hashes, p, C.multipliers(2, window))
    two = C.linear_hash(hashes, p, C.multipliers(3, window))
    order = np.lexsort((two, one))
    new = np.r_[True, (np.diff(one[order]) != 0) | (np.diff(two[order]) != 0)][:len(order)]
    return lens, doc, p[order], one[order], two[order], new


def substring_dedup(docs: DataFrame, window: int = 20) -> DataFrame:
    """Remove every word covered by a window of ``window`` words that also starts earlier.

    Returns doc_id, n_words, n_removed, spans (maximal runs of removed words, by word number) and kept_text (kept words joined by one space).
    Words are [^\\x20\\x09-\\x0D]+. A null or empty text has no words. A null doc_id comes after all others; rows that repeat a doc_id are told
    apart by the chunk they lie in, so all but one of them lose what they share. Other columns are ignored; an empty table gives no rows. Texts are taken whole.
    """
    if window < PERIOD:
        raise ValueError(f"a window has {PERIOD} words or more")
    chunks = C.packed(docs)
    n = C.buckets_for(chunks)

    def keys_of(chunk: C.Chunk):
        hashes, lens = C.word_hashes(chunk)
        keys, counts, _ = _anchor_keys(hashes, _anchors(hashes, lens, window), window)
        return keys, counts

    totals = C.global_counts(chunks, keys_of, n, most=2)

    def send(chunk: C.Chunk, got: dict) -> pd.DataFrame:
        _, doc, p, one, two, new = _windows(chunk, got[0], window)
        p, one, two = p[new], one[new], two[new]
        when = chunk.order()[doc[p]]
        parts = list(C.by_bucket(one, n))
        return pd.DataFrame({"bucket": [x[0] for x in parts], "chunk": chunk.number,
                             "one": [one[a:b].tobytes() for _, a, b in parts],
                             "two": [(two[a:b] >> np.uint64(32)).astype(np.uint32).tobytes() for _, a, b in parts],
                             "whence": [C.squeeze(when[a:b]) for _, a, b in parts]})

    def settle(key, pdf):
        ones = [np.frombuffer(x, np.uint64) for x in pdf["one"]]
        sizes = [len(x) for x in ones]
        one = np.concatenate(ones)
        two = np.concatenate([np.frombuffer(x, np.uint32) for x in pdf["two"]])
        when = np.concatenate([C.expand(x, np.int64) for x in pdf["whence"]])
        chunk = np.repeat(pdf["chunk"].to_numpy(), sizes)
        order = np.lexsort((chunk, when, two, one))
        later = np.zeros(len(one), np.uint8)
        later[order[1:]] = (np.diff(one[order]) == 0) & (np.diff(two[order].astype(np.int64)) == 0)
        return pd.DataFrame({"chunk": pdf["chunk"], "kind": 1, "bucket": int(key[0]), "answer": [C.squeeze(x) for x in np.split(later, np.cumsum(sizes)[:-1])]})

    sent = C.with_answers(chunks, totals, send, "bucket long, chunk long, one binary, two binary, whence binary", {0: np.uint64})
    later = sent.groupBy("bucket").applyInPandas(settle, "chunk long, kind int, bucket long, answer binary")

    def finish(chunk: C.Chunk, got: dict) -> pd.DataFrame:
        lens, doc, p, _, _, new = _windows(chunk, got[0], window)
        gone = ~new
        gone[new] = got[1] > 0
        removed = C.covered(p[gone], window, len(doc))
        return pd.DataFrame(_rows(chunk, lens, removed), columns=["doc_id", "n_words", "n_removed", "spans", "kept_text"]).assign(doc_id=chunk.doc_ids())

    return C.with_answers(chunks, totals.unionByName(later), finish, SPANS, {0: np.uint64, 1: np.uint8})


def _rows(chunk: C.Chunk, lens: np.ndarray, removed: np.ndarray) -> Iterator[tuple]:
    first = np.cumsum(lens) - lens
    for text, a, n in zip(chunk.texts(), first.tolist(), lens.tolist()):
        own = removed[a:a + n]
        words = text.split()
        if own.any():
            spans = [{"start": int(s), "end": int(e)} for s, e in zip(*C.runs(own))]
            words = [w for w, r in zip(words, own.tolist()) if not r]
        else:
            spans = []
        yield None, n, int(own.sum()), spans, b" ".join(words).decode()
