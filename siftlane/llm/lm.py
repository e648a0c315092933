"""LM scores: stupid backoff over n-gram count tables.

The n-grams of all documents are counted in tables partitioned by their hash; the counts are joined back to the exploded n-grams of each document and their
log scores are summed per document. Both the counting shuffle and the join move packed arrays (``chunks``), one entry per distinct n-gram of a chunk.

A document is scored by the rest of the corpus: its own occurrences are taken off every count. Otherwise no n-gram would ever be unseen.
"""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame

from siftlane.llm import chunks as C

#: The key whose count is the number of words.
ALL_WORDS = np.uint64(1)
#: From trigrams on, bytes of text in a chunk and chunks whose keys one bucket holds: the larger a chunk, the fewer keys travel.
CHUNK_BYTES, CHUNKS_PER_BUCKET = 8 << 20, 1
SCORES = "doc_id long, n_words long, n_backoff long, log_score double, mean_log_score double"


def _new(values: np.ndarray) -> np.ndarray:
    """Whether each value differs from the one before."""
    return np.r_[True, values[1:] != values[:-1]][:len(values)]


class _Grams:
    """Keys of the 1- to order-grams of a chunk, ascending, and how often each occurs. ``at[k]`` holds where the grams of k + 1 words begin.

    Each length is sorted by itself, so that no array holds the grams of all lengths. With ``places``, ``by_key[k]`` are the grams of k + 1 words in the order
    of their keys (equal keys as they stand in the chunk) and ``of[k]`` the place of each distinct one among all keys.
    """

    def __init__(self, chunk: C.Chunk, order: int, places: bool = True):
        self.words, self.lens = C.word_hashes(chunk)
        n = len(self.words)
        left = np.repeat(np.cumsum(self.lens, dtype=np.int32), self.lens) - np.arange(n, dtype=np.int32)
        self.at = [np.flatnonzero(left >= k).astype(np.int32) for k in range(1, order + 1)]
        del left
        self.by_key, self.of, found = [], [], [(np.array([ALL_WORDS]), np.array([n], np.uint32))]
        for k in range(order):
            grams = self.hashes(k)
            if places:
                self.by_key.append(np.argsort(grams, kind="stable").astype(np.int32))
                grams = grams[self.by_key[k]]
            else:
                grams.sort()
            first = np.flatnonzero(_new(grams))
            found.append((grams[first], np.diff(np.append(first, len(grams))).astype(np.uint32)))
            del grams, first
        if not places:  # what is only sent needs no words any more
            del self.words, self.at
        keys = np.concatenate([keys for keys, _ in found])
        keys.sort(kind="stable")  # merges sorted parts
        self.keys = keys[_new(keys)]
        del keys
        self.counts = np.zeros(len(self.keys), np.uint32)
        for own, counts in found:
            place = np.searchsorted(self.keys, own)
            self.counts[place] += counts
            if places:
                self.of.append(place)
        if places:
            self.all_words = self.of.pop(0)[0]
            self.doc = np.repeat(np.arange(len(self.lens), dtype=np.int32), self.lens)
            self.place = np.arange(n) - np.repeat(np.cumsum(self.lens) - self.lens, self.lens)

    def hashes(self, k: int) -> np.ndarray:
        return C.linear_hash(self.words, self.at[k], C.multipliers(20 + k, k + 1))

    def in_others(self, k: int, total: np.ndarray) -> np.ndarray:
        """Of the gram of k + 1 words at each place (0 where there is none): its count by ``total``, which goes with ``keys``, less its own document's."""
        keys, doc = self.hashes(k)[self.by_key[k]], self.doc[self.at[k]][self.by_key[k]]
        new = _new(keys)
        del keys
        first = new | _new(doc)  # equal keys stand in the order of documents
        del doc
        times = np.diff(np.append(np.flatnonzero(first), len(first)))
        found = total[self.of[k]][np.cumsum(new, dtype=np.int32) - 1] - times[np.cumsum(first, dtype=np.int32) - 1]
        out = np.zeros(len(self.words), np.int64)
        out[self.at[k][self.by_key[k]]] = found
        return out


def stupid_backoff(docs: DataFrame, order: int = 3, alpha: float = 0.4) -> DataFrame:
    """Score every document by the n-gram counts of all others.

    With c = corpus count less the document's own, a word scores c(k words) / c(first k - 1 of them) for the longest k <= order with c > 0, times ``alpha``
    for each step down; at one word it scores (c + 1) / (words of the other documents + 1). Returns doc_id, n_words, n_backoff (words scored below the
    longest k that their place allows), log_score (sum of natural logarithms, each rounded to 1e-6, so that the order of summing does not matter) and
    mean_log_score (null without words). Words are [^\\x20\\x09-\\x0D]+ as they stand. A null text has no words, score 0. Every row is a document of its
    own, also if it repeats a doc_id or has none. Other columns are ignored; an empty table gives no rows. Texts are taken whole, counts cover all rows.
    """
    large = order > 2
    chunks = C.packed(docs, CHUNK_BYTES if large else C.CHUNK_BYTES, dealt=large)

    def keys_of(chunk: C.Chunk):
        grams = _Grams(chunk, order, places=False)
        return grams.keys, grams.counts

    def run(chunk: C.Chunk, got: dict) -> pd.DataFrame:
        grams = _Grams(chunk, order)
        total, n = got[0].astype(np.int64), len(grams.words)
        others = [grams.in_others(k, total) for k in range(order)]
        rest = total[grams.all_words] - grams.lens[grams.doc]
        score = (others[0] + 1) / (rest + 1)
        length = np.ones(n, np.int64)
        for k in range(2, order + 1):
            last = grams.at[k - 1] + k - 1  # the word that a gram scores
            seen = others[k - 1][last - k + 1]
            score[last] *= alpha
            hit = last[seen > 0]
            score[hit] = seen[seen > 0] / others[k - 2][hit - k + 1]
            length[hit] = k
        logs = np.rint(np.log(score) * 1e6)
        size = len(grams.lens)
        total_log = np.bincount(grams.doc, logs, size)[:size] / 1e6
        short = np.bincount(grams.doc, length < np.minimum(order, grams.place + 1), size)[:size].astype(np.int64)
        mean = np.where(grams.lens > 0, total_log / np.maximum(grams.lens, 1), np.nan)
        return pd.DataFrame({"doc_id": chunk.doc_ids(), "n_words": grams.lens, "n_backoff": short, "log_score": total_log,
                             "mean_log_score": pd.Series(mean, dtype=object).where(grams.lens > 0, None)})

    counted = C.global_counts(chunks, keys_of, C.buckets_for(chunks, CHUNKS_PER_BUCKET if large else C.CHUNKS_PER_BUCKET), tight=large)
    return C.with_answers(chunks, counted, run, SCORES, {0: np.uint64})
