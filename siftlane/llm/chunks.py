"""Packed chunks of documents, and exchanges of 64-bit keys between them.

Work on every word or byte of a corpus would shuffle one row per word or byte. Here documents are packed into chunks of a few MB (one row each, stored in
the shared folder, so a chunk keeps its number when tasks are repeated), tasks compute sorted keys per chunk with numpy, and only packed key arrays travel:

* a chunk sends each distinct key once, with its count, to the key's bucket (so a key that holds a third of the corpus arrives once per chunk),
* the bucket adds up and answers each chunk with one array in the order in which the keys came.

A bucket's memory is the keys of a few chunks: the number of buckets follows the number of chunks.
"""

from __future__ import annotations

import json
from collections.abc import Callable, Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
import xxhash
import zstandard
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from siftlane.llm.worker import release
from siftlane.session import stored, stored_by

#: Bytes of text in a chunk; a longer document is a chunk of its own.
CHUNK_BYTES = 4 << 20
#: Chunks whose keys one bucket holds at once, about.
CHUNKS_PER_BUCKET = 4


class Chunk:
    """Whole documents in the order of doc_id (null last). ``ids`` are 0 where ``known`` is false; ``data`` is their UTF-8 text, end to end."""

    def __init__(self, number: int, ids: np.ndarray, known: np.ndarray, lens: np.ndarray, data: bytes, tags: list[str]):
        self.number, self.ids, self.known, self.lens, self.data, self.tags = number, ids, known, lens, data, tags
        self.ends = np.cumsum(lens)
        self.starts = self.ends - lens

    def __len__(self) -> int:
        return len(self.ids)

    def texts(self) -> Iterator[bytes]:
        for a, b in zip(self.starts.tolist(), self.ends.tolist()):
            yield self.data[a:b]

    def doc_ids(self) -> pd.Series:
        return pd.Series(self.ids, dtype="Int64").mask(~self.known)

    def order(self) -> np.ndarray:
        """Sort keys of the documents: null ids come last."""
        return np.where(self.known, self.ids, np.iinfo(np.int64).max)

    def pack(self) -> bytes:
        tags = json.dumps(self.tags).encode() if any(self.tags) else b""
        head = np.array([len(self), len(tags)], np.int64).tobytes()
        raw = head + self.ids.tobytes() + self.known.tobytes() + self.lens.tobytes() + tags + self.data
        return zstandard.ZstdCompressor(level=6).compress(raw)

    @staticmethod
    def unpack(number: int, payload: bytes) -> Chunk:
        raw = zstandard.ZstdDecompressor().decompress(payload)
        n, tagged = np.frombuffer(raw, np.int64, 2).tolist()
        at = 16 + 17 * n
        ids = np.frombuffer(raw, np.int64, n, 16)
        known = np.frombuffer(raw, bool, n, 16 + 8 * n)
        lens = np.frombuffer(raw, np.int64, n, 16 + 9 * n)
        return Chunk(number, ids, known, lens, raw[at + tagged:], json.loads(raw[at:at + tagged]) if tagged else [""] * n)


def _chunk_of(number: int, ids: list, texts: list[bytes], tags: list[str]) -> Chunk:
    order = sorted(range(len(ids)), key=lambda i: (ids[i] is None, ids[i] or 0))
    known = np.array([ids[i] is not None for i in order], bool)
    values = np.array([ids[i] or 0 for i in order], np.int64)
    lens = np.array([len(texts[i]) for i in order], np.int64)
    return Chunk(number, values, known, lens, b"".join(texts[i] for i in order), [tags[i] for i in order])


def packed(docs: DataFrame, limit: int = CHUNK_BYTES, tag: Column | None = None, dealt: bool = False) -> DataFrame:
    """Store documents as chunks: columns chunk, payload. A null text is an empty one. ``tag`` is a string that stays with each document.

    With ``dealt`` they are stored in buckets, so that answers come to the chunks where they lie and texts are not shuffled.
    """
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        base, made = TaskContext.get().partitionId() << 32, 0
        ids: list = []
        texts: list[bytes] = []
        tags: list[str] = []
        size = 0

        def row() -> pa.RecordBatch:
            chunk = _chunk_of(base + made, ids, texts, tags)
            return pa.RecordBatch.from_pydict({"chunk": pa.array([chunk.number], pa.int64()), "payload": pa.array([chunk.pack()], pa.binary())})

        for batch in batches:
            for doc_id, text, own in zip(batch.column(0).to_pylist(), batch.column(1), batch.column(2).to_pylist()):
                text = (text.as_py() or "").encode()
                if ids and size + len(text) > limit:
                    yield row()
                    made, ids, texts, tags, size = made + 1, [], [], [], 0
                ids.append(doc_id)
                texts.append(text)
                tags.append(own or "")
                size += len(text)
        if ids:
            yield row()

    rows = docs.select(F.col("doc_id").cast("long"), F.col("text").cast("string"), F.lit("") if tag is None else tag).mapInArrow(run, "chunk long, payload binary")
    return stored_by(rows, "chunk", "chunks") if dealt else stored(rows, "chunks")


def buckets_for(chunks: DataFrame, per_bucket: int = CHUNKS_PER_BUCKET) -> int:
    """Buckets for keys of stored chunks: a bucket holds the keys of about ``per_bucket`` chunks, however many chunks there are."""
    return max(8, -(-chunks.count() // per_bucket))


def by_bucket(keys: np.ndarray, n: int) -> Iterator[tuple[int, int, int]]:
    """(bucket, from, to) over ascending keys; a bucket is a range of the keys' upper half."""
    bucket = ((keys >> np.uint64(32)) * np.uint64(n)) >> np.uint64(32)
    cuts = np.flatnonzero(np.diff(bucket)) + 1
    for a, b in zip([0, *cuts.tolist()], [*cuts.tolist(), len(keys)]):
        if b > a:
            yield int(bucket[a]), a, b


def squeeze(values: np.ndarray) -> bytes:
    return zstandard.ZstdCompressor(level=1).compress(values.tobytes())


def expand(data: bytes, dtype) -> np.ndarray:
    return np.frombuffer(zstandard.ZstdDecompressor().decompress(data), dtype)


def squeeze_keys(keys: np.ndarray) -> bytes:
    """Ascending keys as differences, all first bytes before all second ones: n keys take about 64 - log2(n) + 1.5 bits each."""
    return squeeze(np.ascontiguousarray(np.diff(keys, prepend=np.uint64(0)).view(np.uint8).reshape(-1, 8).T))


def expand_keys(data: bytes) -> np.ndarray:
    planes = expand(data, np.uint8).reshape(8, -1)
    return np.cumsum(np.ascontiguousarray(planes.T).view(np.uint64).ravel(), dtype=np.uint64)


def each_chunk(batches: Iterator[pd.DataFrame]) -> Iterator[Chunk]:
    for pdf in batches:
        for number, payload in zip(pdf["chunk"], pdf["payload"]):
            yield Chunk.unpack(int(number), payload)
            release()


def global_counts(chunks: DataFrame, keys_of: Callable[[Chunk], tuple[np.ndarray, np.ndarray]], n_buckets: int, most: int = 0, tight: bool = False) -> DataFrame:
    """Count keys over all chunks. With ``tight`` keys travel as differences.

    ``keys_of`` gives a chunk's distinct keys, ascending, and how often the chunk holds each. Returns rows (chunk, kind 0, bucket, answer); a chunk's
    answers, in the order of buckets, hold the total of each of its keys (uint64; with ``most``, totals above it are stated as ``most``).
    """
    def send(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for chunk in each_chunk(batches):
            keys, counts = keys_of(chunk)
            parts = list(by_bucket(keys, n_buckets))
            yield pd.DataFrame({"bucket": [p[0] for p in parts], "chunk": chunk.number,
                                "keys": [squeeze_keys(keys[a:b]) if tight else keys[a:b].tobytes() for _, a, b in parts],
                                "counts": [squeeze(counts[a:b].astype(np.uint32)) for _, a, b in parts]})

    def settle(key, pdf):
        arrays = [expand_keys(k) if tight else np.frombuffer(k, np.uint64) for k in pdf["keys"]]
        sizes = [len(a) for a in arrays]
        counts = np.concatenate([expand(c, np.uint32) for c in pdf["counts"]])
        keys = np.concatenate(arrays)
        del arrays
        order = np.argsort(keys)
        keys = keys[order]
        first = np.flatnonzero(np.r_[True, keys[1:] != keys[:-1]])
        del keys
        sums = np.add.reduceat(counts[order], first, dtype=np.uint64)
        total = np.empty(len(order), np.uint64)
        total[order] = np.repeat(sums, np.diff(np.append(first, len(order))))
        del order, first, sums
        total = np.minimum(total, np.uint64(most)) if most else total
        answers = [squeeze(x) for x in np.split(total, np.cumsum(sizes)[:-1])]
        del total
        release()
        return pd.DataFrame({"chunk": pdf["chunk"], "kind": 0, "bucket": int(key[0]), "answer": answers})

    sent = chunks.mapInPandas(send, "bucket long, chunk long, keys binary, counts binary")
    return sent.groupBy("bucket").applyInPandas(settle, "chunk long, kind int, bucket long, answer binary")


def with_answers(chunks: DataFrame, answers: DataFrame, run: Callable[[Chunk, dict[int, np.ndarray]], Iterator[pd.DataFrame] | pd.DataFrame], schema: str, dtypes: dict) -> DataFrame:
    """Run a function on each chunk together with its answers, joined in the order of buckets, by kind."""
    def one(left: pd.DataFrame, right: pd.DataFrame) -> pd.DataFrame:
        right = right.sort_values(["kind", "bucket"])
        got = {}
        for kind, dtype in dtypes.items():
            parts = [expand(a, dtype) for a in right.loc[right["kind"] == kind, "answer"]]
            got[kind] = np.concatenate(parts) if parts else np.zeros(0, dtype)
        out = run(Chunk.unpack(int(left["chunk"].iloc[0]), left["payload"].iloc[0]), got)
        release()
        return out

    return chunks.groupBy("chunk").cogroup(answers.groupBy("chunk")).applyInPandas(lambda a, b: one(a, b), schema)


class WordHashes(dict):
    """64-bit hashes of words, remembered; ``trim`` bounds the memory."""

    def __missing__(self, word: bytes) -> int:
        value = self[word] = xxhash.xxh64_intdigest(word, 7)
        return value

    def trim(self, most: int = 400_000) -> None:
        if len(self) > most:
            self.clear()


_KNOWN_WORDS = WordHashes()


def word_hashes(chunk: Chunk) -> tuple[np.ndarray, np.ndarray]:
    """The hashes of all words ([^\\x20\\x09-\\x0D]+, which is what bytes.split keeps) of a chunk, and the number of words of each document."""
    _KNOWN_WORDS.trim()
    known = _KNOWN_WORDS.__getitem__
    parts, lens = [], []
    for text in chunk.texts():
        words = text.split()
        lens.append(len(words))
        parts.append(np.fromiter(map(known, words), np.uint64, len(words)))
    return np.concatenate(parts) if parts else np.zeros(0, np.uint64), np.array(lens, np.int64)


def multipliers(seed: int, n: int) -> np.ndarray:
    """Odd random factors of a multilinear hash; the same in every task."""
    return np.random.default_rng(seed).integers(0, 1 << 63, n, dtype=np.uint64) * np.uint64(2) + np.uint64(1)


def mixed(h: np.ndarray) -> np.ndarray:
    """Spread a hash over all its bits (the finalizer of splitmix64)."""
    h = (h ^ (h >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    h = (h ^ (h >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return h ^ (h >> np.uint64(31))


def linear_hash(values: np.ndarray, at: np.ndarray, factors: np.ndarray) -> np.ndarray:
    """Hash the len(factors) values that begin at each position."""
    h = np.zeros(len(at), np.uint64)
    for i, factor in enumerate(factors):
        h += values[at + i] * factor
    return mixed(h)


def distinct(keys: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Ascending distinct keys, their counts, and each key's place among them."""
    u, place, counts = np.unique(keys, return_inverse=True, return_counts=True)
    return u, counts, place


def covered(starts: np.ndarray, length: int, n: int) -> np.ndarray:
    """Which of n positions lie in [start, start + length) of any start."""
    edge = np.zeros(n + 1, np.int32)
    np.add.at(edge, starts, 1)
    np.add.at(edge, np.minimum(starts + length, n), -1)
    return np.cumsum(edge[:-1]) > 0


def runs(mask: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Starts and ends of the runs of true."""
    edge = np.diff(np.r_[0, mask.astype(np.int8), 0])
    return np.flatnonzero(edge == 1), np.flatnonzero(edge == -1)
