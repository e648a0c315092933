"""Substring dedup over words and over bytes against brute force."""

import random

import numpy as np
import pytest
from pyspark.sql import functions as F

import brute
from siftlane.llm.chunks import packed
from siftlane.llm.substrings import COVER, PERIOD, substring_dedup
from siftlane.llm.suffixes import byte_dedup, dedup_documents, rolling_hashes


def word_rows(docs):
    rows = substring_dedup(docs).withColumn("sha", F.sha2("kept_text", 256)).collect()
    return {r.doc_id: (r.n_words, r.n_removed, r.sha) for r in rows}


def byte_rows(docs, **options):
    """Very frequent triggers take another way."""
    rows = byte_dedup(docs, **options).withColumn("sha", F.sha2("kept", 256)).collect()
    return {r.doc_id: (r.n_bytes, r.n_removed, len(r.spans), r.sha) for r in rows}


def by_id(docs):
    return {r.doc_id: r.text for r in docs.collect()}


def test_cover_holds_every_difference():
    assert {(a - b) % PERIOD for a in COVER for b in COVER} == set(range(PERIOD))


def test_words(plain):
    assert word_rows(plain) == brute.substring_rows(by_id(plain))


def test_bytes(plain):
    assert byte_rows(plain) == brute.byte_rows(by_id(plain))


@pytest.mark.parametrize("seed", range(2))
def test_random_overlaps(spark, seed):
    """Short alphabets and shared pieces at any shift; many chunks and buckets."""
    rnd = random.Random(seed)
    pieces = [" ".join(rnd.choice("ab cd efé g hi".split()) for _ in range(rnd.randint(5, 60))) for _ in range(12)]
    docs = {i: " ".join(rnd.choice(pieces) for _ in range(rnd.randint(0, 5))) for i in range(60)}
    table = spark.createDataFrame(list(docs.items()), "doc_id long, text string").repartition(7)
    assert word_rows(table) == brute.substring_rows(docs)
    assert byte_rows(table) == byte_rows(table, frequent=9) == byte_rows(table, frequent=1) == brute.byte_rows(docs)


def test_odd_rows(odd, nothing):
    clash = odd.withColumns({"chunk": F.lit(1), "bucket": F.lit("x"), "kept": F.lit(None).cast("string")})
    assert substring_dedup(clash).count() == byte_dedup(clash).count() == odd.count()
    assert substring_dedup(nothing).count() == byte_dedup(nothing).count() == 0
    twice = [r for r in substring_dedup(odd).where("doc_id = 15").collect()]
    assert sorted(r.n_removed for r in twice) == [0, 6000]  # one of two equal rows stays whole
    assert byte_dedup(odd).where("doc_id is null").first().n_removed > 1000


def test_documents_keep_their_columns(odd):
    out = dedup_documents(odd.withColumn("extra", F.struct("lang", "source")))
    assert out.columns == [*odd.columns, "extra"] and out.count() == odd.count()
    assert out.where("doc_id = 4").first().text is None
    assert {r.extra.source for r in out.collect()} == {r.source for r in odd.collect()}
    assert out.where("n_chars <> length(text)").count() == 0


def test_columns_of_any_type_travel_unchanged(odd):
    extra = {"at": F.expr("timestamp'2024-01-02 03:04:05.123456'"), "kinds": F.create_map(F.lit(1), F.lit("a"), F.lit(2), F.lit(None).cast("string")), "tag": F.lit(None).cast("date"),
             "price": F.expr("cast(12.345 as decimal(9,3))"), "raw": F.encode("lang", "UTF-8"), "kept": F.array(F.col("n_chars"), F.lit(None).cast("long")),
             "none": F.struct(F.lit(1.5).alias("none"), F.col("source"))}
    rows = odd.withColumns(extra)
    out = dedup_documents(rows)
    assert [(f.name, f.dataType) for f in out.schema] == [(f.name, f.dataType) for f in rows.schema]
    own = lambda df: sorted(str(r) for r in df.drop("text", "n_chars").collect())
    assert own(out) == own(rows)


def test_long_document_is_one_chunk(spark):
    docs = spark.createDataFrame([(i, "word " * n) for i, n in enumerate([10, 500, 3, 2000, 1])], "doc_id long, text string").coalesce(1)
    assert packed(docs, limit=1000).count() >= 3
    assert {r.doc_id: r.n_words for r in substring_dedup(docs).collect()} == {0: 10, 1: 500, 2: 3, 3: 2000, 4: 1}


def test_hash_depends_on_the_gram_alone():
    a = rolling_hashes(np.frombuffer(b"x" * 40 + b"0123456789" * 5 + b"y" * 9, np.uint8))
    b = rolling_hashes(np.frombuffer(b"0123456789" * 5, np.uint8))
    assert (a[40:40 + len(b)] == b).all() and len(b) == 50 - 31
