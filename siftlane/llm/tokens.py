"""Token counts by a tokenizer file: batch encoding in Arrow functions that return lengths only.

White space is a safe boundary for the tokenizer (it drops white space before any merge, and no piece of its pattern spans it), so texts, however long,
are split there, and a text's count is the sum over its words. Only words that the worker has not met are encoded, in batches of equal bytes.
"""

from __future__ import annotations

import os
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from siftlane.llm.worker import remembered

#: Bytes of words in one call of the tokenizer; words whose counts a worker remembers.
BATCH_BYTES, REMEMBERED = 1 << 18, 500_000


def _load(path: str):
    os.environ.setdefault("TOKENIZERS_PARALLELISM", "false")  # a task has one core
    from tokenizers import Tokenizer

    tokenizer = Tokenizer.from_file(path)
    tokenizer.no_truncation()
    tokenizer.no_padding()
    return tokenizer


def _balanced(words: list[bytes]) -> Iterator[list[bytes]]:
    batch, size = [], 0
    for word in words:
        if batch and size + len(word) > BATCH_BYTES:
            yield batch
            batch, size = [], 0
        batch.append(word)
        size += len(word) + 8
    if batch:
        yield batch


def _learn(tokenizer, counts: dict, words: set[bytes]) -> None:
    for batch in _balanced(sorted(words.difference(counts), key=len)):
        found = tokenizer.encode_batch_fast([w.decode() for w in batch], add_special_tokens=False)
        counts.update(zip(batch, map(len, found)))


def token_counts(docs: DataFrame, path: str, limit: int = 2048) -> DataFrame:
    """Count tokens per document with the tokenizer file at ``path`` (a file that all executors have).

    Returns doc_id, n_bytes, n_tokens, over_limit (more than ``limit`` tokens). No special tokens are added, nothing is truncated or padded; special strings
    inside texts are handled as the library does by default. The tokenizer must drop white space, as this library's word-level files do: others are refused. A null
    text is an empty one and counts 0. Rows are taken one by one, so repeated and null doc_ids are kept; other columns are ignored; an empty table gives no rows.
    """
    if _load(path).encode("a b", add_special_tokens=False).ids != [i for w in ("a", "b") for i in _load(path).encode(w, add_special_tokens=False).ids]:
        raise ValueError("this tokenizer keeps white space, so words cannot be counted one by one")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        tokenizer = remembered(f"tokenizer {path}", lambda: _load(path))
        counts = remembered(f"counts {path}", dict)
        for batch in batches:
            sizes, totals = [], []
            for text in batch.column(1):
                data = (text.as_py() or "").encode()
                words = data.split()
                try:
                    total = sum(map(counts.__getitem__, words))
                except KeyError:
                    if len(counts) > REMEMBERED:
                        counts.clear()
                    _learn(tokenizer, counts, set(words))
                    total = sum(map(counts.__getitem__, words))
                sizes.append(len(data))
                totals.append(total)
            yield pa.RecordBatch.from_pydict({"doc_id": batch.column(0), "n_bytes": pa.array(sizes, pa.int64()), "n_tokens": pa.array(totals, pa.int64()),
                                              "over_limit": pa.array([t > limit for t in totals], pa.bool_())})

    rows = docs.select(F.col("doc_id").cast("long"), F.col("text").cast("string"))
    return rows.mapInArrow(run, "doc_id long, n_bytes long, n_tokens long, over_limit boolean")
