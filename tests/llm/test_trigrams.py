"""The query that backs off from trigrams, and the keys that travel for it."""

import os

import numpy as np
import pytest

import __spark_entry__ as entry
from check_queries import compare, connect
from siftlane.llm import chunks as C

SF_DIR = os.environ.get("TEST_SF_DIR", "/root/testdata/sf0.001")


@pytest.mark.skipif(not os.path.isdir(SF_DIR), reason="driver tables not present")
def test_trigram_query(spark):
    three, two = (entry.queries()[n](spark, SF_DIR) for n in ("op10_lm_scores", "op10_bigram_scores"))
    for rows, name in ((three, "op10_lm_scores"), (two, "op10_bigram_scores")):
        assert compare(rows, connect(SF_DIR), entry.oracle_sql()[name]) is None
    backed_off = lambda rows: sum(r.n_backoff for r in rows.collect())
    assert backed_off(three) > backed_off(two)


def test_keys_come_back():
    rng = np.random.default_rng(3)
    for keys in (np.zeros(0, np.uint64), np.array([0, 2**64 - 1], np.uint64), np.unique(rng.integers(0, 2**64, 10_000, dtype=np.uint64))):
        assert C.expand_keys(C.squeeze_keys(keys)).tolist() == keys.tolist()
    assert len(C.squeeze_keys(keys)) < 0.9 * keys.nbytes


def test_keys_alone_take_less_memory():
    """What a chunk sends needs no place of each gram: same keys and counts, at two thirds of the memory or less."""
    import tracemalloc

    import numpy as np
    from siftlane.llm import chunks as C
    from siftlane.llm.lm import _Grams
    rng = np.random.default_rng(3)
    texts = [" ".join(f"w{i}" for i in rng.integers(5000, size=n)).encode() for n in (0, 1, 2, 60_000, 60_000)]
    chunk = C._chunk_of(0, list(range(len(texts))), texts, [""] * len(texts))
    found, peak = [], []
    _Grams(chunk, 3)  # words are remembered from here on
    for places in (True, False):
        tracemalloc.start()
        grams = _Grams(chunk, 3, places)
        peak.append(tracemalloc.get_traced_memory()[1])
        tracemalloc.stop()
        found.append((grams.keys.tolist(), grams.counts.tolist()))
    assert found[0] == found[1] and peak[1] < peak[0] * 0.67, peak


def test_texts_are_not_shuffled(spark, odd):
    """Only answers travel to the chunks, which lie in buckets."""
    from siftlane.llm.lm import stupid_backoff
    plan = stupid_backoff(odd)._jdf.queryExecution().executedPlan().toString()
    assert plan.count("Exchange hashpartitioning(chunk") == 1, plan


def test_places_take_less_memory():
    """Places are found per length: at most three quarters of what it takes to number all grams at once."""
    import tracemalloc

    from siftlane.llm.lm import _Grams
    rng = np.random.default_rng(5)
    texts = [" ".join(f"w{i}" for i in rng.integers(5000, size=n)).encode() for n in (0, 1, 2, 1000, 60_000, 60_000)]
    chunk = C._chunk_of(0, list(range(len(texts))), texts, [""] * len(texts))
    grams = _Grams(chunk, 3)
    every = np.concatenate([grams.hashes(k) for k in range(3)])
    total = np.arange(len(grams.keys))
    peak = []
    for work in (lambda: np.unique(every, return_inverse=True, return_counts=True), lambda: _Grams(chunk, 3), lambda: [grams.in_others(k, total) for k in range(3)]):
        tracemalloc.start()
        work()
        peak.append(tracemalloc.get_traced_memory()[1])
        tracemalloc.stop()
    assert max(peak[1:]) < 0.75 * peak[0], peak
    for k in range(3):  # counts of other documents, one gram at a time
        found, key = grams.in_others(k, total), np.searchsorted(grams.keys, grams.hashes(k))
        doc = grams.doc[grams.at[k]]
        for i in range(0, len(key), 9973):
            assert found[grams.at[k][i]] == total[key[i]] - ((key == key[i]) & (doc == doc[i])).sum()
