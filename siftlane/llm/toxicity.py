"""Toxicity: a sparse logistic classifier of terms, regularised by counterfactuals.

Labelled texts that name a group of people are scored a second time with the group swapped for another one, and the training penalises the squared change of the score (in
log-odds), so that naming a group teaches nothing by itself and neutral mentions stay below the threshold. Features are terms and their beginnings, hashed into 262,144
buckets, with 1 + ln(count), scaled down in long texts. Weights are learnt with per-coordinate rates and L1 and L2 penalties on a bounded, documented sample of labelled
rows, balanced by label; the intercept is then set back to the share of labels in all labelled rows.
"""

from __future__ import annotations

from collections.abc import Iterator, Sequence
from dataclasses import dataclass
from functools import cached_property

import numpy as np
import pandas as pd
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from siftlane.llm.terms import term_parts
from siftlane.llm.worker import release, remembered

BUCKET_BITS = 18
#: The intercept's place, behind the buckets.
BIAS = 1 << BUCKET_BITS
#: Bytes of a term's beginnings that are features too (forms of one stem share them); length beyond which a text's values are scaled down.
BEGINNINGS, NORM = (5, 7), 20.0
#: Rate and its offset, L1 (times the root of the sample's size, as the noise of summed gradients grows), L2, rounds over the sample, weight of the swap penalty.
ALPHA, BETA, L1, L2, ROUNDS, SWAP_PENALTY = 0.3, 1.0, 0.12, 0.01, 4, 4.0
#: Distinct terms that a worker remembers.
KNOWN_TERMS = 200_000
#: Groups of terms that name people and can stand for each other.
IDENTITIES = (
    ("women", "men"), ("woman", "man"), ("girls", "boys"), ("female", "male"), ("gay", "lesbian", "straight", "bisexual", "transgender"),
    ("muslim", "christian", "jewish", "hindu", "buddhist", "atheist"), ("muslims", "christians", "jews", "hindus", "buddhists", "atheists"),
    ("black", "white", "asian", "latino", "arab"), ("immigrants", "refugees", "natives", "citizens"), ("blind", "deaf", "disabled"), ("old", "young"),
    ("frauen", "männer"), ("muslime", "christen", "juden"), ("femmes", "hommes"), ("musulmans", "chrétiens", "juifs"), ("mujeres", "hombres"),
    ("musulmanes", "cristianos", "judíos"),
)


class _Known:
    """Terms that a worker remembers, with the buckets of each: its own and those of its beginnings (none: -1)."""

    def __init__(self):
        self.clear()

    def clear(self) -> None:
        self.numbers: dict[bytes, int] = {}
        self.table = np.zeros((1 << 12, 1 + len(BEGINNINGS)), np.int32)

    def number(self, term: bytes) -> int:
        at = self.numbers[term] = len(self.numbers)
        if at == len(self.table):
            self.table = np.concatenate([self.table, np.zeros_like(self.table)])
        self.table[at] = [_bucket(term, 0), *[_bucket(term[:n], n) if len(term) > n else -1 for n in BEGINNINGS]]
        return at


def _bucket(term: bytes, kind: int) -> int:
    return xxhash.xxh64_intdigest(term, kind) >> (64 - BUCKET_BITS)


def _weighted(text: bytes | None) -> tuple[np.ndarray, np.ndarray]:
    """Ascending buckets of a text and their values."""
    known = remembered("toxicity_terms", _Known)
    if len(known.numbers) > KNOWN_TERMS:
        known.clear()
    numbers = known.numbers
    found = [np.zeros(0, np.int64)]
    for terms in term_parts(text):
        for term in set(terms).difference(numbers):
            known.number(term)
        found.append(np.fromiter(map(numbers.__getitem__, terms), np.int64, len(terms)))
    number, times = np.unique(np.concatenate(found), return_counts=True)
    buckets = known.table[number].ravel()
    times = np.repeat(times, known.table.shape[1])[buckets >= 0]
    at, place = np.unique(buckets[buckets >= 0], return_inverse=True)
    values = 1 + np.log(np.bincount(place, times, len(at)))
    return at, values / max(1.0, np.sqrt((values ** 2).sum()) / NORM)


def swapped(text: bytes | None, identities: Sequence[Sequence[str]], turn: int) -> bytes | None:
    """The folded text with every identity term replaced by the one ``turn`` places on in its group (never by itself); None if it has no such term."""
    place = {term.encode(): (group, i) for group in identities for i, term in enumerate(group) if len(group) > 1}
    out, found = [], False
    for terms in term_parts(text):
        for term in terms:
            if term in place:
                group, i = place[term]
                term, found = group[(i + 1 + turn % (len(group) - 1)) % len(group)].encode(), True
            out.append(term)
    return b" ".join(out) if found else None


Row = tuple[np.ndarray, np.ndarray, np.ndarray | None]


def features(text: bytes | None, identities: Sequence[Sequence[str]], turn: int) -> Row:
    """Ascending buckets (the intercept last), their values and, on the same buckets, the values of the swapped text (None: nothing to swap)."""
    at, values = _weighted(text)
    other = swapped(text, identities, turn)
    if other is None:
        return np.r_[at, BIAS], np.r_[values, 1.0], None
    at2, values2 = _weighted(other)
    both = np.union1d(at, at2)
    one, two = np.zeros(len(both)), np.zeros(len(both))
    one[np.searchsorted(both, at)], two[np.searchsorted(both, at2)] = values, values2
    return np.r_[both, BIAS], np.r_[one, 1.0], np.r_[two, 1.0]


def learn(rows: Sequence[Row], labels: np.ndarray, swap_penalty: float = SWAP_PENALTY, rounds: int = ROUNDS) -> np.ndarray:
    """Weights by bucket and of the intercept, from rows in the order given: log loss, plus ``swap_penalty`` / 2 times the squared change of the log-odds by a swap."""
    z, n = np.zeros(BIAS + 1), np.zeros(BIAS + 1)
    l1 = np.full(BIAS + 1, L1 * np.sqrt(len(rows)))
    l1[BIAS] = 0.0

    def weights(at) -> np.ndarray:
        some = z[at]
        w = -(some - np.sign(some) * l1[at]) / ((BETA + np.sqrt(n[at])) / ALPHA + L2)
        return np.where(np.abs(some) > l1[at], w, 0.0)

    for _ in range(rounds):
        for (at, values, other), label in zip(rows, labels):
            w = weights(at)
            g = values * (1 / (1 + np.exp(-np.clip(values @ w, -30, 30))) - label)
            if other is not None:
                g = g + swap_penalty * ((values - other) @ w) * (values - other)
            sigma = (np.sqrt(n[at] + g * g) - np.sqrt(n[at])) / ALPHA
            z[at] += g - sigma * w
            n[at] += g * g
    return weights(slice(None))


@dataclass
class Model:
    """Buckets with a weight, ascending, their weights, and the intercept (None: nothing was learnt)."""

    at: np.ndarray
    weights: np.ndarray
    intercept: float | None

    @cached_property
    def dense(self) -> np.ndarray:
        every = np.zeros(BIAS)
        every[self.at] = self.weights
        return every

    def score(self, text: bytes | None) -> float:
        """The probability of label 1; 0 if nothing was learnt."""
        if self.intercept is None:
            return 0.0
        at, values = _weighted(text)
        z = self.intercept + float(values @ self.dense[at])
        return round(float(1 / (1 + np.exp(-np.clip(z, -30, 30)))), 6)


def held_out(doc_id: str = "doc_id") -> Column:
    """True for documents whose labels are never learnt from: crc32 of the doc_id as text is divisible by 5. False for a null doc_id."""
    return F.coalesce(F.crc32(F.col(doc_id).cast("string").cast("binary")) % 5 == 0, F.lit(False))


def train(docs: DataFrame, labels: DataFrame, per_label: int = 3000, identities: Sequence[Sequence[str]] = IDENTITIES, swap_penalty: float = SWAP_PENALTY) -> Model:
    """Learn a model from the texts of docs (doc_id, text) that labels (doc_id, toxic) mark 0 or 1.

    ``per_label`` bounds the sample: per label the doc_ids whose hash lies in the share of the hash range that holds so many (within the spread of a hash, some percent).
    Several labels of a doc_id count as the greatest; other values, null labels and null ids teach nothing. Of rows that share a doc_id, the least text is learnt
    from, a null text as an empty one. The sample's ids are broadcast (2 * per_label rows, about) and its sparse vectors meet in one task. Without rows of both
    labels the weights are zero and the score is the share of label 1; without any row it is 0.
    """
    told = labels.where("doc_id is not null and toxic in (0, 1)").groupBy(F.col("doc_id").cast("long").alias("doc_id")).agg(F.max("toxic").cast("int").alias("toxic"))
    told = told.withColumn("h", F.xxhash64("doc_id"))
    sizes = {r.toxic: r.n for r in told.groupBy("toxic").agg(F.count("*").alias("n")).collect()}
    if not sizes:
        return Model(np.zeros(0, np.int32), np.zeros(0), None)
    prior = np.log((sizes.get(1, 0) + 0.5) / (sizes.get(0, 0) + 0.5))
    if len(sizes) < 2:
        return Model(np.zeros(0, np.int32), np.zeros(0), float(prior))
    last = {x: min((1 << 63) - 1, (per_label << 64) // n - (1 << 63)) for x, n in sizes.items()}
    sample = told.where(F.col("h") <= F.when(F.col("toxic") == 1, last[1]).otherwise(last[0]))
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.coalesce(F.col("text").cast("string"), F.lit("")).alias("text"))
    # 2 * per_label rows, about
    texts = rows.join(F.broadcast(sample), "doc_id").groupBy("doc_id").agg(F.min("text").alias("text"), F.first("toxic").alias("toxic"), F.first("h").alias("h"))

    def vectors(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            found = [features(t.encode(), identities, h & 0xFFFF) for t, h in zip(pdf["text"], pdf["h"])]
            yield pd.DataFrame({"h": pdf["h"], "toxic": pdf["toxic"], "at": [a.astype(np.int32).tobytes() for a, _, _ in found], "v": [v.tobytes() for _, v, _ in found],
                                "s": [None if s is None else s.tobytes() for _, _, s in found]})
            release()

    def fit(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values(["h"])
        sparse = [(np.frombuffer(a, np.int32), np.frombuffer(v), None if s is None else np.frombuffer(s)) for a, v, s in zip(pdf["at"], pdf["v"], pdf["s"])]
        truth = pdf["toxic"].to_numpy()
        w = learn(sparse, truth, swap_penalty)
        at = np.flatnonzero(w[:BIAS]).astype(np.int32)
        own = np.log((truth.sum() + 0.5) / ((truth == 0).sum() + 0.5))
        return pd.DataFrame({"at": [at.tobytes()], "w": [w[at].tobytes()], "b": [float(w[BIAS] - own)]})

    sent = texts.mapInPandas(vectors, "h long, toxic int, at binary, v binary, s binary")
    found = sent.withColumn("all", F.lit(0)).groupBy("all").applyInPandas(fit, "at binary, w binary, b double").first()
    if found is None:  # labels without documents
        return Model(np.zeros(0, np.int32), np.zeros(0), float(prior))
    return Model(np.frombuffer(bytes(found.at), np.int32), np.frombuffer(bytes(found.w)), found.b + float(prior))


def toxicity(docs: DataFrame, model: Model) -> DataFrame:
    """doc_id, held_out, score (0 to 1), predicted (1 from a score of 0.5) for every row, from its whole text alone.

    A null text is scored as an empty one: by the share of label 1. Repeated and null doc_ids are kept; other columns are ignored; an empty table gives no rows.
    """
    def run(texts: pd.Series) -> pd.Series:
        found = texts.map(model.score)
        release()
        return found

    score = F.pandas_udf(run, "double")(F.coalesce(F.col("text").cast("string"), F.lit("")).cast("binary"))
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), held_out().alias("held_out"), score.alias("score"))
    return rows.withColumn("predicted", (F.col("score") >= 0.5).cast("int"))
