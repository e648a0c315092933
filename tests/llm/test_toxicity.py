"""Toxicity by held-out results, the swap penalty on planted group mentions, and a plain version of one training step."""

import os

import numpy as np
import pytest
from pyspark.sql import functions as F

from siftlane.llm import toxicity as T

SF_DIR = os.environ.get("TEST_SF_DIR", "/root/testdata/sf0.001").replace("sf0.001", "sf0.01")
LABELS = "doc_id long, toxic int"


def test_held_out_results(spark):
    if not os.path.isdir(SF_DIR):
        pytest.skip("driver tables not present")
    docs, labels = spark.read.parquet(f"{SF_DIR}/documents.parquet"), spark.read.parquet(f"{SF_DIR}/labels.parquet")
    model = T.train(docs, labels.where(~T.held_out()))
    rows = T.toxicity(docs, model).collect()
    assert len(rows) == docs.count() and all(0 <= r.score <= 1 and r.predicted == (r.score >= 0.5) for r in rows)
    truth = {r.doc_id: r.toxic for r in labels.collect()}
    told = [(truth[r.doc_id], r.predicted) for r in rows if r.held_out and r.doc_id in truth]
    assert sum(p for y, p in told if y == 0) <= 1 and sum(y == p for y, p in told) / len(told) > 0.9


def test_held_out_rule(spark):
    from zlib import crc32
    rows = spark.range(200).select(F.col("id").alias("doc_id")).union(spark.createDataFrame([(None,)], "doc_id long"))
    got = {r.doc_id: r.h for r in rows.select("doc_id", T.held_out().alias("h")).collect()}
    assert got == {**{i: crc32(str(i).encode()) % 5 == 0 for i in range(200)}, None: False}


def planted(spark):
    """Insults name muslims more often than others do; the insult itself is another word."""
    rng = np.random.default_rng(3)
    rows = []
    for i in range(1200):
        toxic = i % 3 == 0
        group = "Muslims" if rng.random() < (0.9 if toxic else 0.1) else "christians"
        words = [f"word{x}" for x in rng.integers(0, 300, 12)] + [group] + (["vermin"] if toxic and rng.random() < 0.6 else [])
        rows.append((i, " ".join(rng.permutation(words)), int(toxic)))
    return spark.createDataFrame(rows, "doc_id long, text string, toxic int").repartition(4)


def test_swap_penalty_spares_neutral_mentions(spark):
    rows = planted(spark)
    neutral, other, insult = b"word1 word2 muslims word3", b"word1 word2 christians word3", b"word1 vermin muslims word3"
    free, fair = (T.train(rows.drop("toxic"), rows, swap_penalty=p) for p in (0.0, T.SWAP_PENALTY))
    odds = lambda m, t: np.log(m.score(t) / (1 - m.score(t)))
    assert odds(free, neutral) - odds(free, other) > 1.0
    assert abs(odds(fair, neutral) - odds(fair, other)) < 0.4 * (odds(free, neutral) - odds(free, other))
    assert fair.score(neutral) < min(0.5, free.score(neutral)) and fair.score(insult) > 0.5


def test_swapped_texts():
    assert T.swapped(b"nothing here", T.IDENTITIES, 0) is None and T.swapped(None, T.IDENTITIES, 0) is None
    assert T.swapped("Women and MÄNNER".encode(), [("women", "men")], 5) == "men and mÄnner".encode()
    for turn in range(7):
        out = T.swapped(b"a muslim said", T.IDENTITIES, turn).split()
        assert out[0] == b"a" and out[1] != b"muslim" and out[1].decode() in T.IDENTITIES[5]


def plain_learn(rows, labels, swap_penalty, rounds):
    """Follow-the-regularised-leader with dictionaries, one coordinate after the other."""
    z, n, l1 = {}, {}, T.L1 * len(rows) ** 0.5

    def weight(i):
        cut = 0.0 if i == T.BIAS else l1
        a = z.get(i, 0.0)
        return 0.0 if abs(a) <= cut else -(a - (cut if a > 0 else -cut)) / ((T.BETA + n.get(i, 0.0) ** 0.5) / T.ALPHA + T.L2)

    for _ in range(rounds):
        for (at, values, other), y in zip(rows, labels):
            w = {i: weight(i) for i in at.tolist()}
            error = 1 / (1 + np.exp(-sum(w[i] * v for i, v in zip(at.tolist(), values)))) - y
            change = 0.0 if other is None else swap_penalty * sum(w[i] * (v - o) for i, v, o in zip(at.tolist(), values, other))
            for j, i in enumerate(at.tolist()):
                g = error * values[j] + (0.0 if other is None else change * (values[j] - other[j]))
                s = ((n.get(i, 0.0) + g * g) ** 0.5 - n.get(i, 0.0) ** 0.5) / T.ALPHA
                z[i], n[i] = z.get(i, 0.0) + g - s * w[i], n.get(i, 0.0) + g * g
    return {i: weight(i) for i in z}


def test_learner_equals_plain_version():
    rng = np.random.default_rng(1)
    texts = [" ".join(["bad"] * (i % 3 == 0) + [f"w{x}" for x in rng.integers(0, 20, 5)] + ["women"] * (i % 4 == 0)).encode() for i in range(80)]
    rows = [T.features(t, T.IDENTITIES, i) for i, t in enumerate(texts)]
    labels = np.array([int(i % 3 == 0) for i in range(80)])
    got, want = T.learn(rows, labels), plain_learn(rows, labels, T.SWAP_PENALTY, T.ROUNDS)
    assert any(w for w in want.values()) and all(abs(got[i] - w) < 1e-9 for i, w in want.items())


def test_odd_rows(spark, odd, nothing):
    labels = spark.createDataFrame([(1, 1), (1, 0), (3, 0), (4, 0), (5, None), (6, 7), (None, 1), (15, 0), (99, 1), (8, 1)], LABELS)
    model = T.train(odd, labels)
    rows = T.toxicity(odd.withColumns({"score": F.lit("clash"), "toxic": F.lit(1)}), model).collect()
    assert len(rows) == odd.count() and all(0 <= r.score <= 1 for r in rows)
    empty = {r.score for r in rows if r.doc_id in (4, 5)}
    assert len(empty) == 1 and T.toxicity(nothing, model).count() == 0
    none = spark.createDataFrame([], LABELS)
    assert {(r.score, r.predicted) for r in T.toxicity(odd, T.train(odd, none)).collect()} == {(0.0, 0)}
    one = T.train(odd, labels.where("toxic = 0"))
    assert {r.predicted for r in T.toxicity(odd, one).collect()} == {0}
    assert T.train(nothing, labels).score(b"x") == T.train(nothing, labels).score(b"")


def test_sample_is_bounded(spark):
    rows = planted(spark)
    docs = rows.unionByName(rows.where("doc_id = 3").crossJoin(spark.range(2000)).drop("id"))  # one id holds most rows
    some, every = T.train(docs, rows, per_label=50), T.train(docs, rows)
    assert len(some.at) < len(every.at) and T.train(docs, rows, per_label=50).score(b"vermin") == some.score(b"vermin")
