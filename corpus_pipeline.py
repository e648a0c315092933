"""From raw documents to token ids, in five stages that each call one operator of ``siftlane.llm``.

Each stage takes (spark, docs, sf_dir) and returns a DataFrame, which is written as Parquet and reread as the next one's docs. All but the last return the
columns of documents. The mix repeats documents, so doc_ids may repeat from there on.
"""

from __future__ import annotations

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession

from siftlane.llm import bpe
from siftlane.llm.langid import held_out, keep_identified, train
from siftlane.llm.mixing import mixed_documents
from siftlane.llm.queries import with_digests
from siftlane.llm.similar import keep_similar
from siftlane.llm.suffixes import dedup_documents
from siftlane.session import stored


def language(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Language ID; documents without a letter, or whose best language scores under 0.3, go."""
    return keep_identified(docs, train(docs.where(~held_out())))


def near_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Near-dedup by five-word shingles of similarity 0.8 or more; one document of each component stays."""
    return keep_similar(docs, width=5, similarity=0.8)


def suffix_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Bytes covered by a string of 100 bytes that also starts earlier go from the texts."""
    return dedup_documents(docs)


def mixing(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents as often as the mix of sources takes them."""
    return mixed_documents(docs)


def tokens(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Token ids of every text, and what they decode to, as digests."""
    path = public_tokenizers.path("byte_bpe_50k.json")
    rows = docs.select("doc_id", "lang", "source", "text")
    # the stages before leave several idle workers in each executor, which take turns here
    return with_digests(bpe.round_trip(rows, path, most=100_000)).drop("decoded")


STAGES = [("language", language), ("near_dedup", near_dedup), ("suffix_dedup", suffix_dedup), ("mixing", mixing), ("tokens", tokens)]

#: XXH64 shingle fingerprints, learnt languages and BPE merges are beyond SQL; tests/llm compares the stages with brute-force versions.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over documents; every stage but the last is stored in the shared folder."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for name, stage in STAGES[:-1]:
        docs = stored(stage(spark, docs, sf_dir), name)
    return STAGES[-1][1](spark, docs, sf_dir)
