"""Targets, quotas and the mix."""

from collections import Counter
from fractions import Fraction

import numpy as np
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

import brute
from siftlane.llm.mixing import mix, mixed_documents, split_quotas, targets


def brute_targets(sizes, weights):
    """Share by weight again and again until no target is above three times its size."""
    capped = set()
    while True:
        rest = Fraction(sum(sizes)) - sum(3 * sizes[i] for i in capped)
        weight = sum(w for i, w in enumerate(weights) if i not in capped)
        aims = [Fraction(3 * s) if i in capped else rest * w / weight for i, (s, w) in enumerate(zip(sizes, weights))]
        over = {i for i, a in enumerate(aims) if i not in capped and a > 3 * sizes[i]}
        if not over:
            return aims
        capped |= over


@settings(max_examples=200, deadline=None)
@given(st.lists(st.integers(0, 1000), min_size=1, max_size=9))
def test_targets(sizes):
    weights = [1 + i % 3 for i in range(len(sizes))]
    found = targets(sizes, weights)
    assert found == brute_targets(sizes, weights) and sum(found) == sum(sizes)


@settings(max_examples=50, deadline=None)
@given(st.lists(st.integers(0, 300), min_size=1, max_size=6), st.integers(1, 20))
def test_quotas_are_exact(quotas, shards):
    share = split_quotas(np.array(quotas), shards, 7)
    assert share.sum(axis=1).tolist() == quotas and (share >= 0).all()
    assert share.sum(axis=0).max() - share.sum(axis=0).min() <= np.ceil(np.log2(shards)) + 1


def large(spark):
    return spark.range(3000).select(
        F.col("id").alias("doc_id"), F.expr("trim(repeat('w ', cast(1 + id * 7919 % 60 as int)))").alias("text"), F.lit("en").alias("lang"),
        F.expr("case when id % 3 = 0 then 'hot' when id % 50 = 1 then null else concat('s', id % 5) end").alias("source"), F.lit(0).cast("long").alias("n_chars"))


def test_taken_is_near_the_target(spark):
    docs = large(spark)
    rows = mix(docs).collect()
    sizes, taken, aims = Counter(), Counter(), {}
    for r in rows:
        sizes[r.source] += r["size"]
        taken[r.source] += r["copies"] * r["size"]
        aims[r.source] = r.target
        assert 0 <= r.copies <= 3
    order = sorted(sizes, key=lambda s: (s is None, (s or "").encode()))
    want = brute_targets([sizes[s] for s in order], [1 + i % 3 for i in range(len(order))])
    for s, t in zip(order, want):
        assert abs(aims[s] - float(t)) < 1e-6 and abs(taken[s] - t) <= 30
    again = mix(docs.repartition(13)).collect()
    assert sorted(map(str, rows)) == sorted(map(str, again))


def check_repeated(docs, most_size):
    rows = mix(docs).collect()
    sizes, taken, aims = Counter(), Counter(), {}
    for r in rows:
        sizes[r.source] += r["size"]
        taken[r.source] += r["copies"] * r["size"]
        aims[r.source] = r.target
        assert 0 <= r.copies <= 3
    order = sorted(sizes, key=lambda s: (s is None, (s or "").encode()))
    want = dict(zip(order, brute_targets([sizes[s] for s in order], [1 + i % 3 for i in range(len(order))])))
    assert all(abs(taken[s] - want[s]) <= most_size / 2 + 1e-6 for s in want), (taken, want)
    assert Counter(tuple(r) for r in mix(docs.repartition(3)).collect()) == Counter(tuple(r) for r in rows)
    drawn = Counter((r.doc_id, r.source) for r in mixed_documents(docs).collect())
    assert sum(drawn.values()) == sum(r.copies for r in rows)
    return rows


def test_repeated_rows_are_cut_inside_a_tie(spark):
    """A third of all rows are one row; another third have no id and one text."""
    same = spark.range(1000).select(F.lit(5).cast("long").alias("doc_id"), F.lit("a b c").alias("text"), F.lit("en").alias("lang"), F.lit("s0").alias("source"))
    null = spark.range(1000).select(F.lit(None).cast("long").alias("doc_id"), F.lit("one two").alias("text"), F.lit("en").alias("lang"), F.lit("s1").alias("source"))
    rest = spark.range(1000).select("id", F.expr("repeat('w ', cast(1 + id % 9 as int))").alias("text"), F.lit("en").alias("lang"), F.expr("concat('s', 2 + id % 3)").alias("source"))
    rows = check_repeated(same.union(null).union(rest).repartition(5), 9)
    assert 0 < sum(r.copies for r in rows if r.source == "s0") < 1000


def test_only_repeated_rows(spark):
    same = spark.range(100).select(F.lit(1).cast("long").alias("doc_id"), F.lit("x y").alias("text"), F.concat(F.lit("s"), F.col("id") % 2).alias("source"))
    check_repeated(same, 2)
    blank = spark.range(50).select(F.col("id").alias("doc_id"), F.lit("").alias("text"), F.lit(None).cast("string").alias("source"))
    assert {r.copies for r in check_repeated(blank.union(same), 2) if r.source is None} <= {0, 1}


def test_documents_of_the_mix(spark):
    docs = large(spark).withColumnRenamed("n_chars", "size")
    copies = {r.doc_id: r.copies for r in mix(docs).collect()}
    out = mixed_documents(docs, shard="shard")
    assert out.columns == [*docs.columns, "shard"]
    rows = out.collect()
    assert Counter(r.doc_id for r in rows) == {d: c for d, c in copies.items() if c}
    assert len({r.shard for r in rows}) == 16


def test_odd_rows(odd, nothing):
    rows = mix(odd.withColumn("target", F.lit(1))).collect()
    assert len(rows) == odd.count()
    texts = {r.doc_id: r.text for r in odd.collect()}
    assert all(r["size"] == len(brute.words(texts[r.doc_id])) for r in rows)
    assert mix(nothing).count() == mixed_documents(nothing).count() == 0
    assert mixed_documents(odd).columns == odd.columns
