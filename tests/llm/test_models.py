"""Language ID by held-out accuracy, LM scores against a plain version."""

import math
import os
from collections import Counter

import pytest
from pyspark.sql import functions as F

import brute
from siftlane.llm.langid import UNKNOWN, held_out, identify, keep_identified, train
from siftlane.llm.lm import stupid_backoff

SF_DIR = os.environ.get("TEST_SF_DIR", "/root/testdata/sf0.001")


@pytest.fixture(scope="module")
def documents(spark):
    if not os.path.isdir(SF_DIR):
        pytest.skip("driver tables not present")
    return spark.read.parquet(f"{SF_DIR}/documents.parquet")


def test_held_out_accuracy(documents):
    model = train(documents.where(~held_out()))
    rows = identify(documents, model).join(documents.select("doc_id", "lang"), "doc_id").where("held_out and lang is not null").collect()
    assert len(rows) > 30 and sum(r.lang_pred == r.lang for r in rows) / len(rows) > 0.95
    assert all(0 <= r.score <= 1 for r in rows)


def test_held_out_rule(spark):
    from zlib import crc32
    rows = spark.range(200).select(F.col("id").alias("doc_id")).union(spark.createDataFrame([(None,)], "doc_id long"))
    got = {r.doc_id: r.h for r in rows.select("doc_id", held_out().alias("h")).collect()}
    assert got == {**{i: crc32(str(i).encode()) % 3 == 1 for i in range(200)}, None: False}


def test_odd_rows(odd, nothing):
    model = train(odd)
    rows = identify(odd.withColumn("score", F.lit("clash")), model).collect()
    assert len(rows) == odd.count() and identify(nothing, model).count() == 0
    assert {r.doc_id for r in rows if r.lang_pred == UNKNOWN} == {4, 5, 6}
    assert {r.lang_pred for r in rows} <= {UNKNOWN, *model.languages}
    kept = keep_identified(odd, model, min_score=0.0)
    assert kept.columns == odd.columns and kept.count() == odd.count() - 3
    blank = train(nothing)
    assert {(r.lang_pred, r.score) for r in identify(odd, blank).collect()} == {(UNKNOWN, 0.0)}


def brute_scores(docs: dict, alpha=0.4, order=2) -> dict:
    words = {d: brute.words(t) for d, t in docs.items()}
    grams = {d: [Counter(tuple(w[i:i + k]) for i in range(len(w) - k + 1)) for k in range(1, order + 1)] for d, w in words.items()}
    every = [sum((g[k] for g in grams.values()), Counter()) for k in range(order)]
    total = sum(map(len, words.values()))
    out = {}
    for d, w in words.items():
        log, short = 0, 0
        for i in range(len(w)):
            left = lambda g: every[len(g) - 1][g] - grams[d][len(g) - 1][g]
            top = min(order, i + 1)
            for k in range(top, 0, -1):
                g = tuple(w[i - k + 1:i + 1])
                if k == 1:
                    s = (left(g) + 1) / (total - len(w) + 1)
                elif left(g):
                    s = left(g) / left(g[:-1])
                else:
                    continue
                break
            log += round(math.log(s * alpha ** (top - k)) * 1e6)
            short += k < top
        out[d] = (len(w), short, log)
    return out


@pytest.mark.parametrize("order", [1, 2, 3])
def test_scores(plain, order):
    got = {r.doc_id: (r.n_words, r.n_backoff, round(r.log_score * 1e6)) for r in stupid_backoff(plain, order).collect()}
    want = brute_scores({r.doc_id: r.text for r in plain.collect()}, order=order)
    assert {d: v[:2] for d, v in got.items()} == {d: v[:2] for d, v in want.items()}
    assert all(abs(got[d][2] - want[d][2]) <= 1 + want[d][0] // 100 for d in want)  # a log may round either way


def test_scores_of_odd_rows(odd, nothing):
    rows = stupid_backoff(odd.withColumn("n_words", F.lit("clash"))).collect()
    assert len(rows) == odd.count() and stupid_backoff(nothing).count() == 0
    assert [(r.log_score, r.mean_log_score) for r in rows if r.doc_id == 4] == [(0.0, None)]
