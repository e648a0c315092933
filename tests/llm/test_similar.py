"""Near-dedup by shingle similarity against a plain version, and its recall by similarity."""

import os

import numpy as np
import pytest

import brute
import corpus_pipeline
from siftlane.llm import similar as S

SF_DIR = os.environ.get("TEST_SF_DIR", "/root/testdata/sf0.001")


def brute_kept(docs: dict) -> set:
    """The smallest doc_id of each component of pairs of similarity 0.8."""
    sets = {}
    for d, t in docs.items():
        words = brute.words((t or "").translate({c: c + 32 for c in range(65, 91)}))
        sets[d] = {tuple(words[i:i + 5]) for i in range(max(1, len(words) - 4))}
    root = {d: d for d in docs}

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    for a in docs:
        for b in docs:
            if a < b and len(sets[a] & sets[b]) / len(sets[a] | sets[b]) >= 0.8:
                x, y = find(a), find(b)
                root[max(x, y)] = min(x, y)
    return {find(d) for d in docs}


def edited(rng, words, share):
    return [f"e{rng.integers(1 << 40)}" if rng.random() < share else w for w in words]


def test_stage_removes_copies_of_similarity_from_08(spark):
    rng = np.random.default_rng(4)
    rows = []
    for i in range(40):
        words = [f"w{x}" for x in rng.integers(0, 5000, 300)]
        rows += [(10 * i + k, " ".join(edited(rng, words, share)), "en", "a", 0) for k, share in enumerate((0, 0.005, 0.01, 0.02, 0.03, 0.05))]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long").repartition(3)
    kept = corpus_pipeline.near_dedup(spark, docs, SF_DIR)
    want = brute_kept({r[0]: r[1] for r in rows})
    assert {r.doc_id for r in kept.collect()} == want and 40 < len(want) < 160


@pytest.mark.skipif(not os.path.isdir(SF_DIR), reason="driver tables not present")
def test_stage_on_documents(spark):
    docs = spark.read.parquet(f"{SF_DIR}/documents.parquet").where("doc_id is not null")
    kept = corpus_pipeline.near_dedup(spark, docs, SF_DIR)
    assert {r.doc_id for r in kept.collect()} == brute_kept({r.doc_id: r.text for r in docs.collect()})


def test_odd_rows(odd, nothing):
    kept = S.keep_similar(odd)
    assert kept.columns == odd.columns and S.keep_similar(nothing).count() == 0
    ids = [r.doc_id for r in kept.collect()]
    assert ids.count(15) == 1 and ids.count(None) <= 1 and {1, 4, 7, 12, 13, 20, 21} <= set(ids) and not {2, 5, 6, 14, 22} & set(ids)


def test_anchors_of_simhash_link_what_shares_no_band(spark, monkeypatch):
    """Texts whose fingerprints lie within 4 bits are candidates without any band; the exact check still decides."""
    rng = np.random.default_rng(4)
    base = [f"w{i}" for i in rng.integers(1 << 30, size=3000)]
    rows = [(0, " ".join(base)), (1, " ".join([*base[:-1], "last"])), (2, " ".join(base[::-1])), (3, None)]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    bits = [S.simhash(S.shingles(t, 5)) & (2 ** 64 - 1) for _, t in rows[:3]]
    assert (bits[0] ^ bits[1]).bit_count() <= 4 < (bits[0] ^ bits[2]).bit_count()
    monkeypatch.setattr(S, "candidates", lambda least: least.select("fp", "fp").toDF("u", "v").limit(0))
    assert sorted(r.doc_id for r in S.keep_similar(docs).collect()) == [0, 2, 3]
