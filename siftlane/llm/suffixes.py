"""Substring dedup over bytes, by phrases as in prefix-free parsing and suffixes sorted to depth 100 per trigger bucket.

The parse itself is neither built nor suffix-sorted: equal strings of 100 bytes share their trigger, so sorting inside trigger buckets finds all of them.

A byte is removed if some string of 100 bytes that covers it also starts earlier in the corpus (smaller doc_id, or same document and earlier start).

* Parse. Rolling-hash triggers cut each document into phrases: a string's trigger is the 32-byte gram with the smallest rolling hash among those inside
  it, and all starts with one trigger form a phrase (about 35 starts). The trigger depends on the string alone, so equal strings are parsed alike wherever
  they lie, and phrases have bounded length, which a trigger by a fixed modulus would not give.
* Phrases whose trigger occurs once in the corpus can hold no repeat; they leave after one exchange of 8 bytes each.
* Dictionary. The others, with the bytes that follow in the parse up to the last start's 100th, form a dictionary of distinct phrases, per chunk and then
  per trigger bucket. Only an entry's first occurrence is looked at further; all starts in its later occurrences repeat.
* Suffix array. The suffixes of a bucket's dictionary are sorted by their first 100 bytes and ties by corpus order (entry by first occurrence, then offset);
  neighbours that agree form a class, of which the first in corpus order stays. Equal strings share a trigger, so they meet in one bucket.
* A trigger that is very frequent (a passage in a large part of all documents, with ever other text around it) would fill one bucket. Strings with such
  a trigger are hashed, with 96 bits, and each class goes to its own place. The bound is a size switch: below it strings are compared byte by byte, above it by their
  hashes, so the rows are the same but for collisions.
* A document longer than a chunk is a chunk of its own, and a chunk takes some fifty bytes of arrays per byte: one text of 20 MB needs a GB in its task.
"""

from __future__ import annotations

import base64
import pickle
from collections.abc import Iterator
from copy import copy

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.pandas.types import to_arrow_schema

from siftlane.llm import chunks as C
from siftlane.llm.worker import release

#: Bytes of a trigger gram (a power of two), entries whose suffixes are sorted at once, suffixes compared at once, records made at once, rows restored at once.
GRAM, SORTED_ENTRIES, AT_ONCE, RECORDS_AT_ONCE, ROWS_AT_ONCE = 32, 6_000, 1 << 16, 1 << 12, 256
#: Occurrences in the corpus from which a trigger counts as very frequent: no bucket holds more phrases of one trigger than that.
FREQUENT = 2_000
#: Every byte of a chunk takes some fifty bytes of arrays here, so chunks are smaller than elsewhere, and so are buckets.
CHUNK_BYTES, CHUNKS_PER_BUCKET = 1 << 20, 4
SPANS = "doc_id long, n_bytes long, n_removed long, spans array<struct<start:long,end:long>>, kept binary"


def rolling_hashes(data: np.ndarray) -> np.ndarray:
    """Hash of the GRAM bytes at each position, by doubling."""
    h = C.multipliers(11, 256)[data]
    width = 1
    for factor in C.multipliers(12, GRAM.bit_length() - 1):
        h = h[:-width] * factor + h[width:] if len(h) > width else h[:0]
        width *= 2
    return C.mixed(h)


def _least(grams: np.ndarray, reach: int) -> np.ndarray:
    """For each position the place of the smallest hash among the next ``reach``, the leftmost of equals."""
    low = np.uint64(0xFFFFFFFF)
    best = (grams & ~low) | np.arange(len(grams), dtype=np.uint64)
    width = 1
    while width * 2 <= reach and len(best) > width:
        best = np.minimum(best[:-width], best[width:])
        width *= 2
    rest = reach - width
    if rest:
        best = np.minimum(best[:-rest], best[rest:]) if len(best) > rest else best[:0]
    return (best & low).astype(np.int64)


class Phrases:
    """The phrases of a chunk: first and last start, place of the trigger, its hash, document."""

    def __init__(self, chunk: C.Chunk, window: int):
        self.data, self.window = np.frombuffer(chunk.data, np.uint8), window
        grams = rolling_hashes(self.data)
        trigger = _least(grams, window - GRAM + 1)
        doc = np.repeat(np.arange(len(chunk), dtype=np.int32), chunk.lens)
        inside = np.arange(len(trigger)) + window <= chunk.ends[doc[:len(trigger)]]
        starts = np.flatnonzero(inside)
        trigger = trigger[starts]
        new = np.flatnonzero(np.r_[True, np.diff(trigger) != 0][:len(trigger)])
        self.first = starts[new]
        self.count = np.diff(np.r_[new, len(starts)])
        self.trigger = trigger[new]
        self.key = C.mixed(grams[self.trigger])  # a trigger's hash is a least one: mixed again, keys spread evenly over buckets
        self.doc = doc[self.first]

    def keep(self, mask: np.ndarray) -> None:
        for name in ("first", "count", "trigger", "key", "doc"):
            setattr(self, name, getattr(self, name)[mask])

    def starts(self, order: np.ndarray) -> np.ndarray:
        """All starts of the phrases, in the order given, phrase by phrase."""
        count = self.count[order]
        return np.repeat(self.first[order], count) + np.arange(count.sum()) - np.repeat(np.cumsum(count) - count, count)

    def records(self) -> np.ndarray:
        """Each phrase as bytes of fixed length: the text its starts reach, place of the trigger, number of starts."""
        reach = self.window - GRAM + 1
        width = self.window + reach - 1
        out = np.zeros((len(self.first), width + 4), np.uint8)
        every = np.lib.stride_tricks.sliding_window_view(np.r_[self.data, np.zeros(width, np.uint8)], width)
        for i in range(0, len(self.first), RECORDS_AT_ONCE):
            these = slice(i, i + RECORDS_AT_ONCE)
            out[these, :width] = every[self.first[these]] * (np.arange(width) < (self.count[these] + self.window - 1)[:, None])
        out[:, width:width + 2] = (self.trigger - self.first).astype("<u2")[:, None].view(np.uint8)
        out[:, width + 2:] = self.count.astype("<u2")[:, None].view(np.uint8)
        return out


def _as_one(records: np.ndarray) -> np.ndarray:
    return np.ascontiguousarray(records).view(f"V{records.shape[1]}").ravel()


def _dictionary(phrases: Phrases):
    """Order of the phrases by key, record and place, and which of them are the first of their record."""
    records = phrases.records()
    flat = _as_one(records)
    order = np.lexsort((np.arange(len(flat)), np.unique(flat, return_inverse=True)[1], phrases.key)) if len(flat) else np.zeros(0, np.int64)
    new = np.r_[True, flat[order][1:] != flat[order][:-1]][:len(order)]
    return records, order, new


def _hashed(phrases: Phrases):
    """Starts of the phrases and hashes of their strings, in the order of the hashes, and which of them are the first of their string."""
    start = phrases.starts(np.arange(len(phrases.first)))
    letters = C.multipliers(13, 256)[phrases.data] if len(start) else np.zeros(0, np.uint64)
    one, two = (C.linear_hash(letters, start, C.multipliers(seed, phrases.window)) for seed in (14, 15))
    two >>= np.uint64(32)
    order = np.lexsort((start, two, one))
    new = np.r_[True, (np.diff(one[order]) != 0) | (np.diff(two[order]) != 0)][:len(order)]
    return start[order], one[order], two[order], new


def _later_of_hashed(one: np.ndarray, two: np.ndarray, *place: np.ndarray) -> np.ndarray:
    """Which strings have an equal one before them."""
    order = np.lexsort((*place, two, one))
    later = np.zeros(len(one), bool)
    later[order[1:]] = (np.diff(one[order]) == 0) & (np.diff(two[order]) == 0)
    return later


def _repeats(entries: np.ndarray, count: np.ndarray, trigger: np.ndarray, window: int) -> np.ndarray:
    """For distinct dictionary entries in corpus order: which of their starts (end to end) have an equal start before them.

    Equal strings have their trigger at one distance, so suffixes are sorted distance by distance; one distance takes at most one start of an entry.
    """
    width = entries.shape[1]
    every = np.lib.stride_tricks.sliding_window_view(np.ascontiguousarray(entries).reshape(-1), window)
    base = np.cumsum(count) - count
    later = np.zeros(int(count.sum()), bool)
    for distance in range(window - GRAM + 1):
        offset = trigger - distance
        entry = np.flatnonzero((offset >= 0) & (offset < count))
        if len(entry) < 2:
            continue
        place = base[entry] + offset[entry]
        suffix = every[entry * width + offset[entry]].view(f"V{window}").ravel()
        order = np.argsort(suffix, kind="stable")
        for i in range(1, len(order), AT_ONCE):
            these = order[i:i + AT_ONCE]
            later[place[these]] = suffix[these] == suffix[order[i - 1:i - 1 + len(these)]]
    return later


def byte_dedup(docs: DataFrame, window: int = 100, tag: Column | None = None, frequent: int = FREQUENT) -> DataFrame:
    """Remove every byte covered by a string of ``window`` bytes that also starts earlier; matches never cross documents.

    Returns doc_id, n_bytes, n_removed, spans (maximal removed runs, in bytes) and kept (the remaining bytes, which may cut a character). A null text is an
    empty one. A null doc_id comes after all others; rows that repeat a doc_id are told apart by the chunk they lie in, so all but one of them lose
    what they share. Other columns are ignored, but a ``tag`` (a string) is returned as a last column; an empty table gives no rows. Texts are taken whole.
    """
    if window < 2 * GRAM:
        raise ValueError(f"a window has {2 * GRAM} bytes or more")
    chunks, tagged = C.packed(docs, CHUNK_BYTES, tag), tag is not None
    n = C.buckets_for(chunks, CHUNKS_PER_BUCKET)

    def keys_of(chunk: C.Chunk):
        keys, counts, _ = C.distinct(Phrases(chunk, window).key)
        return keys, counts

    totals = C.global_counts(chunks, keys_of, n, most=max(2, frequent))

    def candidates(chunk: C.Chunk, totals: np.ndarray) -> tuple[Phrases, Phrases]:
        """Phrases whose trigger repeats, and those whose trigger is very frequent."""
        phrases = Phrases(chunk, window)
        _, _, place = C.distinct(phrases.key)
        total = totals[place] if len(place) else np.zeros(0, np.uint64)
        hot = copy(phrases)
        hot.keep(total >= max(2, frequent))
        phrases.keep((total > 1) & (total < max(2, frequent)))
        return phrases, hot

    def send(chunk: C.Chunk, got: dict) -> pd.DataFrame:
        phrases, hot = candidates(chunk, got[0])
        records, order, new = _dictionary(phrases)
        order = order[new]
        rows = _rows(chunk, False, phrases.key[order], records[order], phrases.first[order], n)
        start, one, two, new = _hashed(hot)
        rows += _rows(chunk, True, one[new], two[new].astype(np.uint32), start[new], n)
        return pd.DataFrame(rows, columns=["bucket", "hot", "chunk", "n", "keys", "records", "whence"])

    def settle(bucket, pdf):
        sizes = pdf["n"].to_numpy()
        key = np.concatenate([C.expand(x, np.uint64) for x in pdf["keys"]])
        when, place = np.concatenate([C.expand(x, np.int64).reshape(2, -1) for x in pdf["whence"]], axis=1)
        chunk = np.repeat(pdf["chunk"].to_numpy(), sizes)
        if bucket[1]:
            two = np.concatenate([C.expand(x, np.uint32) for x in pdf["records"]]).astype(np.int64)
            later = _later_of_hashed(key, two, chunk, place, when)
            answers = np.split(later, np.cumsum(sizes)[:-1])
            return pd.DataFrame({"chunk": pdf["chunk"], "kind": 2, "bucket": int(bucket[0]), "answer": [C.squeeze(x) for x in answers]})
        records = np.concatenate([C.expand(x, np.uint8).reshape(m, -1) for x, m in zip(pdf["records"], sizes)])
        trigger, count = records[:, -4:].copy().view("<u2").astype(np.int64).T
        corpus = np.lexsort((chunk, place, when))
        _, entry = np.unique(_as_one(records), return_inverse=True)
        first = np.full(entry.max() + 1, -1)
        first[entry[corpus[::-1]]] = corpus[::-1]
        first = first[np.argsort(key[first], kind="stable")]
        alone = np.r_[True, np.diff(key[first]) != 0]
        alone &= np.r_[alone[1:], True]
        ends = np.cumsum(count)
        later = np.ones(ends[-1], bool)
        for i in first[alone]:
            later[ends[i] - count[i]:ends[i]] = False
        rank = np.empty(len(corpus), np.int64)
        rank[corpus] = np.arange(len(corpus))
        for batch in _batches(first[~alone], key):
            batch = batch[np.argsort(rank[batch])]
            found = _repeats(records[batch], count[batch], trigger[batch], window)
            for i, part in zip(batch, np.split(found, np.cumsum(count[batch])[:-1])):
                later[ends[i] - count[i]:ends[i]] = part
        cuts = ends[np.cumsum(sizes)[:-1] - 1]
        return pd.DataFrame({"chunk": pdf["chunk"], "kind": 1, "bucket": int(bucket[0]), "answer": [C.squeeze(x) for x in np.split(later, cuts)]})

    sent = C.with_answers(chunks, totals, send, "bucket long, hot boolean, chunk long, n long, keys binary, records binary, whence binary", {0: np.uint64})
    later = sent.groupBy("bucket", "hot").applyInPandas(settle, "chunk long, kind int, bucket long, answer binary")

    def finish(chunk: C.Chunk, got: dict) -> pd.DataFrame:
        phrases, hot = candidates(chunk, got[0])
        _, order, new = _dictionary(phrases)
        gone = np.repeat(~new, phrases.count[order])
        gone[~gone] = got[1]
        start, _, _, new = _hashed(hot)
        gone_hot = ~new
        gone_hot[new] = got[2]
        gone = np.concatenate([phrases.starts(order)[gone], start[gone_hot]])
        removed = C.covered(gone, window, len(phrases.data))
        rows = []
        for text, a, b in zip(chunk.texts(), chunk.starts.tolist(), chunk.ends.tolist()):
            own = removed[a:b]
            if own.any():
                spans = [{"start": int(s), "end": int(e)} for s, e in zip(*C.runs(own))]
                text = phrases.data[a:b][~own].tobytes()
            else:
                spans = []
            rows.append((b - a, int(own.sum()), spans, text))
        out = pd.DataFrame(rows, columns=["n_bytes", "n_removed", "spans", "kept"])
        out.insert(0, "doc_id", chunk.doc_ids())
        return out.assign(tag=chunk.tags) if tagged else out

    schema = SPANS + ", tag string" * tagged
    return C.with_answers(chunks, totals.unionByName(later), finish, schema, {0: np.uint64, 1: bool, 2: bool})


def _rows(chunk: C.Chunk, hot: bool, key: np.ndarray, records: np.ndarray, first: np.ndarray, n: int) -> list[tuple]:
    """Packed rows for the buckets of ascending keys, with the corpus place of each record."""
    doc = np.searchsorted(chunk.ends, first, side="right")
    when, place = chunk.order()[doc], first - chunk.starts[doc]
    return [(bucket, hot, chunk.number, b - a, C.squeeze(key[a:b]), C.squeeze(np.ascontiguousarray(records[a:b])), C.squeeze(np.stack([when[a:b], place[a:b]])))
            for bucket, a, b in C.by_bucket(key, n)]


def _batches(entries: np.ndarray, key: np.ndarray):
    """Entries (ascending by key) in batches that keep equal keys together."""
    if not len(entries):
        return
    ends = np.r_[np.flatnonzero(np.diff(key[entries])) + 1, len(entries)].tolist()
    begin = 0
    for end, following in zip(ends, [*ends[1:], None]):
        if following is None or following - begin > SORTED_ENTRIES:
            yield entries[begin:end]
            begin = end


def _packed_values(rows: pa.Array) -> pa.Array:
    """Each row of a struct array as text, exactly."""
    return pa.array([base64.b64encode(pickle.dumps(tuple(r.values()))).decode() for r in rows.to_pylist()], pa.string())


def dedup_documents(docs: DataFrame, window: int = 100) -> DataFrame:
    """The documents, all columns kept, with repeated bytes taken out of ``text`` and ``n_chars`` (if there is one) counted anew. A null text stays null.

    The pieces of characters that a cut has left are dropped. The other columns, of any type that Arrow has, travel unchanged with their text, so nothing is joined back
    by doc_id.
    """
    others = [f for f in docs.schema.fields if f.name != "text"]
    names = [f"c{i}" for i in range(len(others))]
    own = F.struct(F.col("text").isNull().alias("none"), *[F.col(f"`{f.name}`").alias(n) for f, n in zip(others, names)])
    rows = byte_dedup(docs, window, F.arrow_udf(_packed_values, "string")(own)).select("kept", "tag")
    schema = T.StructType([T.StructField("kept", T.StringType())] + [T.StructField(n, f.dataType) for f, n in zip(others, names)])
    types = to_arrow_schema(schema)

    def restore(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for at in range(0, batch.num_rows, ROWS_AT_ONCE):
                part = batch.slice(at, ROWS_AT_ONCE)
                values = [pickle.loads(base64.b64decode(tag)) for tag in part.column(1).to_pylist()]
                texts = [None if v[0] else kept.decode("utf-8", "ignore") for v, kept in zip(values, part.column(0).to_pylist())]
                columns = [texts, *([v[i + 1] for v in values] for i in range(len(names)))]
                yield pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(columns, types)], schema=types)
            release()

    found = rows.mapInArrow(restore, schema)
    place = {f.name: F.col(n) for f, n in zip(others, names)} | {"text": F.col("kept")}
    if "n_chars" in place:
        place["n_chars"] = F.length("kept").cast("long")
    return found.select(*[place[c].alias(c) for c in docs.columns])
