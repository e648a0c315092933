"""Byte-level BPE encoding and decoding with a tokenizer file.

A text is cut at its special strings, then by the tokenizer's pattern into short words. A word is held as part boundaries and the ranks of
adjacent parts, in contiguous arrays: find the least rank (the leftmost of equals), delete that boundary, refresh the two neighbouring ranks, until no
rank is left. Words of one length are worked on together, as rows of an array. What stands between single blanks is looked up if the worker has met it before.
"""

from __future__ import annotations

import heapq
import json
import re
from collections.abc import Callable, Iterator
from itertools import chain

import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from siftlane.llm.worker import release, remembered

#: Fixed value: the pattern that byte-level tokenizers of this kind split text by.
PATTERN = r"""'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"""
#: Longer words are merged with a heap; words of one length that are merged at once; pieces of text that a worker remembers; rows worked on at once.
SHORT, AT_ONCE, REMEMBERED, ROWS = 48, 20_000, 300_000, 512
NONE = np.iinfo(np.int32).max
_TWO_BLANKS, _SINGLE_BLANK = re.compile(r"\s\s"), re.compile(r"(?<=\S) (?=\S)")


def byte_letters() -> dict[int, str]:
    """The visible letter that stands for each byte: printable bytes stand for themselves, the others for letters from 256 on."""
    plain = [*range(33, 127), *range(161, 173), *range(174, 256)]
    rest = [b for b in range(256) if b not in plain]
    return {b: chr(b) for b in plain} | {b: chr(256 + i) for i, b in enumerate(rest)}


class ByteBPE:
    """Vocabulary and merges of a byte-level tokenizer file."""

    def __init__(self, path: str):
        with open(path, encoding="utf-8") as f:
            told = json.load(f)
        vocab = told["model"]["vocab"]
        letters = byte_letters()
        back = {c: b for b, c in letters.items()}
        self.special = {t["content"]: t["id"] for t in told["added_tokens"]}
        self.bytes_of = {i: bytes(back[c] for c in s) for s, i in vocab.items()} | {i: s.encode() for s, i in self.special.items()}
        self.table = [self.bytes_of.get(i, b"") for i in range(max(self.bytes_of) + 1)]
        self.byte_ids = np.array([vocab[letters[b]] for b in range(256)], np.int32)
        merges = [m if isinstance(m, list) else m.split(" ") for m in told["model"]["merges"]]
        self.size = max(self.bytes_of) + 1
        pairs = np.array([vocab[a] * self.size + vocab[b] for a, b in merges], np.int64)
        order = np.argsort(pairs)
        self.pairs, self.ranks = pairs[order], order.astype(np.int32)
        self.merged = np.array([vocab[a + b] for a, b in merges], np.int32)
        self.pattern = regex.compile(PATTERN)
        self.cut = re.compile("(" + "|".join(map(re.escape, sorted(self.special, key=len, reverse=True))) + ")") if self.special else None
        self.after_blank: dict[str, bytes] = {}  # ids of a blank and this piece, as the bytes of int32 numbers

    def rank(self, a: np.ndarray, b: np.ndarray) -> np.ndarray:
        """Ranks of adjacent parts; NONE where they do not merge."""
        key = a.astype(np.int64) * self.size + b
        at = np.minimum(np.searchsorted(self.pairs, key), len(self.pairs) - 1)
        return np.where(self.pairs[at] == key, self.ranks[at], NONE)

    def merge_rows(self, parts: np.ndarray) -> list[bytes]:
        """Merge words of one length, one in each row; the ids of each as the bytes of int32 numbers."""
        n, width = parts.shape
        parts = np.concatenate([parts, np.full((n, 1), -1, np.int32)], axis=1)
        ranks = np.full((n, width + 1), NONE, np.int32)
        ranks[:, :width - 1] = self.rank(parts[:, :width - 1], parts[:, 1:width])
        left = np.full(n, width)
        rows = np.arange(n)
        while len(rows):
            at = ranks[rows].argmin(axis=1)
            least = ranks[rows, at]
            rows, at, least = rows[least < NONE], at[least < NONE], least[least < NONE]
            if not len(rows):
                break
            gone = np.arange(width)[None, :] + (np.arange(width)[None, :] > at[:, None])
            moved = np.take_along_axis(parts[rows], gone, axis=1)
            shifted = np.take_along_axis(ranks[rows], gone, axis=1)
            own = np.arange(len(rows))
            moved[own, at] = self.merged[least]
            left[rows] -= 1
            behind = at + 1 < left[rows]
            shifted[own, at] = NONE
            shifted[own[behind], at[behind]] = self.rank(moved[own[behind], at[behind]], moved[own[behind], at[behind] + 1])
            before = at > 0
            shifted[own[before], at[before] - 1] = self.rank(moved[own[before], at[before] - 1], moved[own[before], at[before]])
            parts[rows, :width], ranks[rows, :width] = moved, shifted
        flat = parts[:, :width][np.arange(width)[None, :] < left[:, None]].tobytes()
        ends = (4 * np.cumsum(left)).tolist()
        return [flat[i:j] for i, j in zip([0, *ends], ends)]

    def merge_long(self, data: bytes) -> np.ndarray:
        """Merge one long word: the same steps, with the least rank from a heap."""
        parts = self.byte_ids[np.frombuffer(data, np.uint8)].tolist()
        n = len(parts)
        after, before = [*range(1, n), -1], list(range(-1, n - 1))
        first = self.rank(np.array(parts[:-1]), np.array(parts[1:])).tolist()
        known = dict(zip(zip(parts, parts[1:]), first))
        heap = [(r, i, parts[i], parts[i + 1]) for i, r in enumerate(first) if r < NONE]
        heapq.heapify(heap)

        def offer(i: int, j: int) -> None:
            pair = parts[i], parts[j]
            if pair not in known:
                known[pair] = int(self.rank(np.array([pair[0]]), np.array([pair[1]]))[0])
            if known[pair] < NONE:
                heapq.heappush(heap, (known[pair], i, *pair))

        while heap:
            r, i, a, b = heapq.heappop(heap)
            j = after[i]
            if parts[i] != a or j < 0 or parts[j] != b:
                continue
            parts[i], parts[j] = int(self.merged[r]), -1
            after[i] = after[j]
            if after[j] >= 0:
                before[after[j]] = i
                offer(i, after[i])
            if before[i] >= 0:
                offer(before[i], i)
        return np.array([p for p in parts if p >= 0], np.int32)

    def merge_words(self, words: set[str]) -> dict[str, bytes]:
        found: dict[str, bytes] = {}
        by_length: dict[int, list[tuple[str, bytes]]] = {}
        for word in words:
            data = word.encode()
            if len(data) > SHORT:
                found[word] = self.merge_long(data).tobytes()
            else:
                by_length.setdefault(len(data), []).append((word, data))
        for length, some in by_length.items():
            for i in range(0, len(some), AT_ONCE):
                part = some[i:i + AT_ONCE]
                rows = self.byte_ids[np.frombuffer(b"".join([d for _, d in part]), np.uint8)].reshape(-1, length)
                found.update(zip([w for w, _ in part], self.merge_rows(rows)))
        return found

    def encode_pieces(self, pieces: list[str]) -> list[bytes]:
        """The ids of pieces that can be encoded one by one."""
        # letters, also after a blank, are one word of the pattern
        cut = [(p,) if p.isalpha() or p[:1] == " " and p[1:].isalpha() else self.pattern.findall(p) for p in pieces]
        found = self.merge_words({w for words in cut for w in words})
        return [found[words[0]] if len(words) == 1 else b"".join([found[w] for w in words]) for words in cut]

    def encode(self, texts: list[str], most: int | None = None) -> list[bytes]:
        """The ids of each text, as the bytes of int32 numbers. ``most`` bounds the pieces kept beside those of these texts."""
        cut = [self._parts(t) for t in texts]  # of each text: lists of pieces between single blanks, and ids of special strings
        lists = [part for parts in cut for part in parts if part.__class__ is list]
        met = set(chain.from_iterable([part[1:] for part in lists]))
        if len(self.after_blank) > (most or REMEMBERED):  # common pieces are met again and stay
            self.after_blank = {p: self.after_blank[p] for p in met.intersection(self.after_blank)}
        new = list(met.difference(self.after_blank))
        self.after_blank.update(zip(new, self.encode_pieces([" " + p for p in new])))
        heads = list({part[0] for part in lists})
        first = dict(zip(heads, self.encode_pieces(heads)))
        look = self.after_blank.__getitem__
        return [b"".join([np.int32(part).tobytes() if part.__class__ is int else first[part[0]] + b"".join(map(look, part[1:])) for part in parts])
                for parts in cut]

    def _parts(self, text: str) -> list:
        if self.special and any(s in text for s in self.special):
            return [self.special[part] if part in self.special else _at_blanks(part) for part in self.cut.split(text)]
        return [_at_blanks(text)]


def _at_blanks(text: str) -> list[str]:
    """Cut at every blank that has no white space beside it; no word of the pattern goes across the place before such a blank."""
    return _SINGLE_BLANK.split(text) if _TWO_BLANKS.search(text) else text.split(" ")


def _worked(batches: Iterator[pa.RecordBatch], work: Callable[[pa.RecordBatch], pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Work on a few rows at a time. Memory goes back after each batch and at the end, when the last one is free: idle workers stay beside those that work."""
    for batch in batches:
        for i in range(0, batch.num_rows, ROWS):
            yield work(batch.slice(i, ROWS))
        del batch
        release()
    release()


def _encoded(batch: pa.RecordBatch, path: str, most: int | None = None) -> pa.RecordBatch:
    """The batch with ``ids`` in place of ``text``."""
    bpe = remembered(f"bpe {path}", lambda: ByteBPE(path))
    found = bpe.encode([t or "" for t in batch.column("text").to_pylist()], most)
    ends = np.cumsum([0] + [len(x) // 4 for x in found])
    ids = pa.ListArray.from_arrays(pa.array(ends, pa.int32()), pa.array(np.frombuffer(b"".join(found), np.int32)))
    names = [n for n in batch.schema.names if n not in ("text", "ids")]
    return pa.RecordBatch.from_arrays([*(batch.column(n) for n in names), ids], names=[*names, "ids"])


def _decoded(batch: pa.RecordBatch, path: str) -> pa.RecordBatch:
    """The batch with ``decoded`` beside ``ids``."""
    bpe = remembered(f"bpe {path}", lambda: ByteBPE(path))
    table, column, texts = bpe.table, batch.column("ids"), []
    for i in range(len(column)):
        ids = column[i].values
        ids = np.zeros(0, np.int32) if ids is None else ids.to_numpy(zero_copy_only=False)
        known = ids if not len(ids) or (ids.min() >= 0 and ids.max() < len(table)) else ids[(ids >= 0) & (ids < len(table))]
        texts.append(b"".join(map(table.__getitem__, known.tolist())).decode("utf-8", "replace"))
    names = [n for n in batch.schema.names if n != "decoded"]
    return pa.RecordBatch.from_arrays([*(batch.column(n) for n in names), pa.array(texts, pa.string())], names=[*names, "decoded"])


def _texts(docs: DataFrame) -> DataFrame:
    """Text as a string, and the other columns but ids."""
    others = [F.col(f"`{c}`") for c in docs.columns if c not in ("text", "ids")]
    return docs.select(*others, F.col("text").cast("string").alias("text"))


def encode(docs: DataFrame, path: str) -> DataFrame:
    """Add a column ``ids`` (array<int>) with the tokens of ``text`` under the byte-level BPE file at ``path`` (a file that all executors have).

    Special strings inside texts become their tokens, as the library does by default; none are added, nothing is truncated or padded. A null or empty text
    has no tokens. Columns other than text are kept as they are (one named ids is replaced); text is dropped. Every row is encoded on its own. An empty
    table gives no rows. Texts are taken whole.
    """
    rows = _texts(docs)
    schema = rows.drop("text").withColumn("ids", F.array(F.lit(0))).schema
    return rows.mapInArrow(lambda batches: _worked(batches, lambda b: _encoded(b, path)), schema)


def decode(rows: DataFrame, path: str) -> DataFrame:
    """Add a column ``decoded`` with the text of the tokens in ``ids``, special tokens as their strings.

    Bytes that form no UTF-8 become U+FFFD; ids that the file does not have are skipped; null ids give an empty text.
    """
    schema = rows.withColumn("decoded", F.lit("")).schema
    return rows.mapInArrow(lambda batches: _worked(batches, lambda b: _decoded(b, path)), schema)


def round_trip(docs: DataFrame, path: str, most: int | None = None) -> DataFrame:
    """``encode`` and then ``decode`` of the ids, in one pass over the rows: one Python worker a task instead of two.

    ``most`` bounds the pieces of text that a worker keeps; fewer take less memory and more time, with the same result.
    """
    rows = _texts(docs)
    schema = rows.drop("text", "decoded").withColumns({"ids": F.array(F.lit(0)), "decoded": F.lit("")}).schema
    return rows.mapInArrow(lambda batches: _worked(batches, lambda b: _decoded(_encoded(b, path, most), path)), schema)
